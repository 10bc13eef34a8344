"""Merkle manifest, order MinHash and centroid clustering against brute force."""

import hashlib
import random
import re
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from topicloom.llm import clusters, merkle, minhash, substrings

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def climb(nodes):
    """The top of a list of nodes, and for each node what stands left and right of it at each level."""
    paths, at = [[] for _ in nodes], [*range(len(nodes))]
    while len(nodes) > 1:
        for i, j in enumerate(at):
            lo = j - j % 8
            paths[i].append(("".join(nodes[lo:j]), "".join(nodes[j + 1 : lo + 8])))
        nodes, at = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)], [j // 8 for j in at]
    return nodes[0], paths


@pytest.mark.parametrize("block", [8, 512])
def test_merkle(spark, monkeypatch, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    monkeypatch.setattr(merkle, "LEVELS", 1 if block == 8 else 3)
    sizes = {None: 9, "a": 1, "b": 65, "c": 8, "d": 600, "e": 2, "é": 64, **{f"z{i}": 1 for i in range(5)}}
    rows = [(g, i if i % 11 else None, f"{g}-{i}") for g, n in sizes.items() for i in range(n)] + [("b", 3, "b-3"), ("b", 3, "other")]
    df = spark.createDataFrame(rows, "lang string, doc_id long, text string").withColumn("root", F.lit(7)).withColumn("g", F.lit("x"))
    leaf = lambda r: sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in r[::-1]))
    df = df.drop("root").withColumn("leaf", merkle.leaf(F.col("text"), F.col("doc_id"), F.col("lang"))).repartition(7)
    out = merkle.verified(merkle.manifest(df, "lang", ["doc_id"]).withColumn("again", F.when(F.col("doc_id") == 5, sha("forged")).otherwise(F.col("leaf")))).collect()
    assert len(out) == len(rows)
    want, subs = {}, []
    for g in sorted(sizes, key=lambda x: (x is not None, (x or "").encode())):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, leaf(r)))
        top, paths = climb([leaf(r) for r in own])
        subs.append(top)
        for r, p in zip(own, paths, strict=True):
            want.setdefault(r, []).append((len(subs) - 1, p))
    root, ups = climb(subs)
    got = {}
    for r in out:
        got.setdefault((r.lang, r.doc_id, r.text), []).append(r)
    for key, places in want.items():
        mine = sorted((r.subroot, r.proof_sha256) for r in got[key])
        assert mine == sorted((subs[i], sha("".join(a + b for a, b in p + ups[i]))) for i, p in places)
        assert all(r.root == root and r.verified == (key[1] != 5) and (r.folded_root == root) == r.verified for r in got[key])
    assert merkle.manifest(df.where("doc_id < -1"), "lang", ["doc_id"]).count() == 0
    one = merkle.verified(merkle.manifest(df.where("lang = 'a'"), "lang", ["doc_id"]).withColumn("again", F.col("leaf"))).first()
    assert one.root == one.subroot == one.leaf == one.folded_root and one.proof_sha256 == sha("")


def kmer_hash(*values, seed=42):
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<i", v) if isinstance(v, np.int32) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed


def signature(text, k=minhash.WORDS, size=minhash.TUPLE, places=minhash.PLACES):
    cjk = minhash.CHARACTERS
    words = re.findall(rf"[{cjk}]|[^\x20\x09-\x0D{cjk}]{{1,16}}", text or "")
    seen, items = {}, []
    for i in range(max(len(words) - k + 1, 1) if words else 0):
        h = kmer_hash(*words[i : i + k]) >> 25
        n = seen[h] = seen.get(h, -1) + 1
        items.append((kmer_hash(h, np.int32(n)) >> 25 if n else h, i))
    items.sort()
    out = []
    for b in range(places):
        start = b * 2**39 // places
        chosen = ([x for x in items if x[0] >= start] + [x for x in items if x[0] < start])[:size]
        v = kmer_hash(*[h for h, _ in sorted(chosen, key=lambda x: x[::-1])]) if chosen else 0
        out.append(f"{v & 0xFFFFFFFF:08X}")
    return "".join(out)


def test_order_minhash(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 4)))
    texts = [None, "", " \t\n", "a", "a a", "a a a a a a a a a", "我们去北京ab", "x" * 100, "ab\x85c d", "a b a b a b a b c", " ".join(word() for _ in range(3000)), " ".join(["x y"] * 700)]
    texts += [" ".join(word() for _ in range(r.randint(1, 90))) for _ in range(20)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3).select("t", minhash.fingerprint(F.col("t")).alias("f")).collect()
    assert {x.t: x.f for x in got} == {t: signature(t) for t in texts}
    # order counts, unlike in a set of words
    a = [word() + str(i) for i in range(400)]
    b = a[200:] + a[:200]
    both = spark.createDataFrame([(" ".join(a), " ".join(b), " ".join(a[:390] + ["new"] + a[391:]))], "a string, b string, c string")
    near = both.select(*[minhash.likeness(minhash.fingerprint(F.col("a")), minhash.fingerprint(F.col(c))) for c in "abc"]).first()
    assert near[0] == 1 and near[2] > 0.9 and 0.25 < near[1] < 0.75


@pytest.mark.parametrize("run", [1, 4, 1024])
def test_neighbours(spark, monkeypatch, run):
    monkeypatch.setattr(minhash, "RUN", run)
    rows = [(i, "abcdé f"[i % 7 :] * (i % 5 + 1)) for i in range(0, 40, 3)] + [(6, "zz"), (6, "zz"), (None, "last"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("row", F.lit(2)).repartition(5)
    h = lambda t: np.uint64(xxhash.xxh64_intdigest((t or "").encode(), 42)).view(np.int64)
    own = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, h(x[1])))
    want = []
    for (k, t), (_, u) in zip(own, own[1:] + own[:1], strict=True):
        t, u = t or "", u or ""
        want.append((str(k), len(t), t[: len(t) - len(t) // 2], u[: len(t) // 2], signature(t), signature(u)))
    got = [(str(r.doc_id), r.n_chars, r.text_head, r.next_head, r.fingerprint, r.next_fingerprint) for r in minhash.neighbours(df).collect()]
    assert sorted(got) == sorted(want)
    one = minhash.neighbours(df.where("doc_id = 3")).first()
    assert one.text_head + one.next_head == one.text_head + own[[x[0] for x in own].index(3)][1][: one.n_chars // 2] and minhash.neighbours(df.where("doc_id < 0")).count() == 0


def lloyd(rows, k, rounds, size, scale=64):
    most = clusters.MOST
    own = [(key, [int(np.floor(min(max(float(np.float32(x)) * scale, -most), most))) for x in v]) for key, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(own, key=lambda x: (x[0] is None, sha(f"1:{x[0]}"), x[1]))[:k]
    centres = [v for _, v in first]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for i in range(rounds + 1):
        at = [min(range(len(centres)), key=lambda j: (dist(v, centres[j]), j)) for _, v in own]
        if i < rounds:
            centres = [[sum(x) // len(vs) for x in zip(*vs, strict=True)] if (vs := [v for (_, v), a in zip(own, at, strict=True) if a == j]) else c for j, c in enumerate(centres)]
    d = [dist(v, centres[a]) for (_, v), a in zip(own, at, strict=True)]
    each = [sum(x for x, b in zip(d, at, strict=True) if b == a) for a in range(len(centres))]
    return sorted((str(key), a, x, each[a], sum(d), clusters.centre_digest(centres[a])) for (key, _), a, x in zip(own, at, d, strict=True))


@pytest.mark.parametrize("spread", [1.0, 1e5])
def test_clusters(spark, spread):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(r.integers(0, 4), 0.5, 8) * spread]) for i in range(400)]
    rows += [rows[3], rows[3], (None, [0.5] * 8), (900, None), (901, [1.0] * 7), (902, [float("nan")] + [0.0] * 7), (903, [float("inf")] * 8), (904, [None] + [0.0] * 7), (905, [1e30] * 8), (906, [-0.001] * 8)]
    rows += [(1000 + i, [0.0] * 8) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("x")).repartition(5)
    for k, rounds in ((16, 3), (1, 2), (3, 0), (5, 6)):
        got = clusters.cluster(df, k=k, rounds=rounds, size=8).collect()
        assert sorted((str(x.vec_id), x.cluster, x.distance, x.cluster_inertia, x.inertia, x.centroid_sha256) for x in got) == lloyd(rows, k, rounds, 8)
    few = clusters.cluster(df.where("vec_id < 5"), size=8).collect()
    assert sorted((str(x.vec_id), x.cluster, x.distance, x.cluster_inertia, x.inertia, x.centroid_sha256) for x in few) == lloyd([x for x in rows if x[0] is not None and x[0] < 5], 16, 3, 8)
    assert clusters.cluster(df.where("vec_id < 0"), size=8).count() == 0


def test_bounds_spare_scans_and_change_nothing():
    r = np.random.default_rng(5)
    centres = r.integers(-900, 900, (16, 64))
    q = (centres[r.integers(0, 16, 5000)] + r.integers(-60, 60, (5000, 64))).astype(np.int32)
    state, drift, scans = None, None, []
    for _ in range(5):
        *state, n = clusters.assign(q, centres, state, drift)
        scans.append(n)
        d = np.array([((q.astype(np.int64) - c) ** 2).sum(1) for c in centres]).T
        assert (d.argmin(1) == state[0]).all() and (state[1] >= np.sqrt(d.min(1))).all()
        rest = d.copy()
        rest[np.arange(len(q)), state[0]] = np.iinfo(np.int64).max
        assert (state[2] <= np.sqrt(rest.min(1))).all()
        moved = np.array([q[state[0] == j].astype(np.int64).sum(0) // max(1, (state[0] == j).sum()) for j in range(16)])
        drift, centres = np.nextafter(np.sqrt(((moved - centres) ** 2).sum(1).astype(float)), np.inf), moved
    assert scans[0] == 5000 and max(scans[1:]) < 500


def test_substrings_split_hot_slots_at_any_size(spark, monkeypatch):
    """No bucket holds more unsplit strings than an absolute number; a common window goes about once a task."""
    r = random.Random(12)
    fill = lambda n: ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    passage = fill(25)
    rows = [(i, " ".join(fill(10) + passage + fill(10))) for i in range(600)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, t string").repartition(3).select("k", substrings.number_of(F.col("t")).alias("d"), "t")
    first, gone = {}, {}
    for k, t in sorted(rows):
        w = t.split()
        gone[k] = {x for i in range(len(w) - 19) if first.setdefault(tuple(w[i : i + 20]), (k, i)) != (k, i) for x in range(i, i + 20)}
    monkeypatch.setattr(substrings, "SLOTS", 1 << 12)
    monkeypatch.setattr(substrings, "HEAVY", 1)  # the share alone splits nothing
    for most, hot in ((1 << 17, False), (256, True)):
        monkeypatch.setattr(substrings, "BUCKET_STRINGS", most)
        bits, strings = substrings.heavy_slots(df, 20, 4)
        assert strings >= 600 and bool(bits.any()) == hot
        sent = substrings.packed(df, 20, 4, 4, bits, flush=2000).where("not done").collect()
        copies = sum(substrings._unblob(x.blob)[-1].count(" ".join(passage[:20]).encode()) for x in sent)
        assert (copies < 60) == hot  # some 25 flushes of 8 documents a task
        got = substrings.repeated_windows(df, "k", "t", flush=2000).collect()
        assert {x.key: {w for run in x.runs for w in range(run.start, run.end)} for x in got} == {k: g for k, g in gone.items() if g}


def test_substrings_replace_columns_in_any_case(spark):
    df = spark.createDataFrame([(1, "a b", 5)], "doc_id long, text string, Kept int")
    assert substrings.remove_repeats(df).select("kept").first().kept == "a b"
