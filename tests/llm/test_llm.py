"""Operators against brute force on small fixtures with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from topicloom.llm import bpe, common, exact, licenses, near, packing, quality, shards, simhash, substrings, suffixes, vectors

RANKS, PATTERN, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("word_bpe_49k.json")


def texts():
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 6)))
    passage = " ".join(word() for _ in range(120))
    out = [None, "", " \t\n", "a", "A a", "a  a", "a\ta"]
    for i in range(30):
        own = " ".join(word() for _ in range(r.randint(1, 200)))
        out.append(own if i % 3 else f"{own} {passage[: r.randint(300, len(passage))]} {word()}")
    return out + out[10:14] + [passage, passage, " ".join(["x"] * 500), " ".join(word() for _ in range(3000))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [*enumerate(texts())]
    rows.append(rows[20])  # a repeated row
    return spark.createDataFrame([(i, t, "k", 7) for i, t in rows], "doc_id long, text string, key string, `_k` int").repartition(5)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id < -1")


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_suffixes(docs, none):
    rows, t = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()], 60
    seen = Counter(b[i : i + t] for _, b in rows for i in range(len(b) - t + 1))
    for group in (4096, 1):
        got = {r.doc_id: r for r in suffixes.remove_repeats(docs, threshold=t, reach=30, gram=8, local_group=group).collect()}
        for k, b in rows:
            gone = [any(seen[b[j : j + t]] > 1 for j in range(max(0, i - t + 1), min(i, len(b) - t) + 1)) for i in range(len(b))]
            spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
            assert (got[k].n_removed, got[k].n_spans, bytes(got[k].kept)) == (sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g)), (k, group)
            left = [bytes(c for c, _ in part) for g, part in itertools.groupby(zip(b, gone), key=lambda x: x[1]) if not g]
            assert got[k].kept_text == "".join(x.decode(errors="ignore") for x in left)
    assert suffixes.remove_repeats(none).count() == 0


def test_suffixes_of_null_and_repeated_keys(spark):
    r = random.Random(9)
    fill = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    a, b, c, shared = fill(900), fill(900), fill(900), fill(450)
    long = fill(suffixes.SEGMENT - 200) + shared + fill(300)  # the passage lies across the border of segments
    rows = [(None, a + shared), (None, b), (None, c), (7, shared + b[:300]), (7, c[:350]), (8, long)]
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id or 0, x.kept_text) for x in got) == sorted([(0, a), (0, b), (0, c), (7, b[:300]), (7, c[:350]), (8, long.replace(shared, ""))])


def test_substrings(docs, none):
    rows = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    words, first = {k: [w for w in b.translate(substrings._TO_SPACE).split(b" ") if w] for k, b in rows.items()}, {}
    gone = {k: set() for k in rows}
    for k in sorted(rows):
        for i in range(len(words[k]) - 9):
            if first.setdefault(tuple(words[k][i : i + 10]), (k, i)) != (k, i):
                gone[k] |= {*range(i, i + 10)}
    out = substrings.remove_repeats(docs, window=10, gram=3)
    assert out.columns[:4] == docs.columns and out.count() == docs.count()
    for r in out.collect():
        assert (r.n_words, r.n_removed) == (len(words[r.doc_id]), len(gone[r.doc_id]))
        assert r.kept.encode() == b" ".join(w for i, w in enumerate(words[r.doc_id]) if i not in gone[r.doc_id])
    assert substrings.remove_repeats(none).count() == 0


def test_substrings_of_a_common_passage_long_texts_and_null_keys(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9)))
    fill = lambda n: [word() for _ in range(n)]
    passage = fill(70)
    rows = [(i if i % 7 else None, " ".join(fill(r.randint(1, 40)) + passage + fill(r.randint(1, 40)))) for i in range(200)]
    long = fill(2000)
    for _ in range(170):
        long += fill(2000) + passage[:30] + long[-90:]
    rows += [(500, " ".join(long)), (None, None), (None, ""), (3, "other " + " ".join(passage)), rows[5]]
    assert len(rows[200][1]) > 2 * substrings.BLOCK  # crosses borders of blocks
    own = sorted({(2**63 if k is None else k, np.uint64(xxhash.xxh64_intdigest(t or "", 42)).view(np.int64).item(), t or "") for k, t in rows})
    first, gone = {}, {}
    for k, h, t in own:
        w, cut = t.split(), set()
        for i in range(len(w) - 19):
            if first.setdefault(tuple(w[i : i + 20]), (k, h, i)) != (k, h, i):
                cut |= {*range(i, i + 20)}
        gone[t] = (len(w), len(cut), " ".join(x for i, x in enumerate(w) if i not in cut))
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert len(got) == len(rows) and all((x.n_words, x.n_removed, x.kept) == gone[x.text or ""] for x in got)


def test_runs_merge_by_document():
    k, d, s, n = (np.array(x) for x in ([2, 1, 1, 1, 1], [0, 0, 0, 9, 0], [4, 5, 1, 2, 8], [1, 3, 4, 2, 1]))
    assert [x.tolist() for x in substrings.merged(k, d, s, n)] == [[1, 1, 2], [0, 9, 0], [1, 2, 4], [8, 2, 1]]


def test_hash_collisions_are_compared_as_bytes(monkeypatch):
    real = substrings._hashed
    monkeypatch.setattr(substrings, "_hashed", lambda *a: (np.zeros_like((x := real(*a))[0]), *x[1:]))
    entries = [(1, 5, 0, 1, b"a b"), (2, 6, 0, 1, b"c d"), (3, 7, 0, 1, b"a b")]
    assert [x.tolist() for x in substrings._repeats([substrings._blob(entries)], 2)] == [[3], [7], [0], [1]]


def test_bpe(docs, none):
    enc = bpe.encoding(RANKS, PATTERN)
    for r in bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN).collect():
        assert r.ids == enc.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(none, RANKS, PATTERN).count() == 0
    for t in ("ab1 2c  d's\n\n x" * 50, "word  " * 40, "1a" * 99, "é ü  z" * 30):
        assert [i for p in bpe.safe_pieces(t, 7) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(t)
    assert bpe.encode_text(enc, "a" + " " * 60000 + "b").tolist() == enc.encode_ordinary("a") + enc._encode_single_piece(b" " * 59999) + enc.encode_ordinary(" b")


def test_exact(docs, none):
    norm = {r.doc_id: re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in docs.collect()}
    rows = [norm[r.doc_id] for r in docs.collect()]
    n, least = Counter(rows), {}
    for k in sorted(norm):
        least.setdefault(norm[k], k)
    for huge in (exact.HUGE, 100):
        for r in exact.groups(docs, huge=huge).collect():
            t = norm[r.doc_id]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (least[t], n[t], least[t] == r.doc_id, sha(t.encode()))
    kept = exact.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(least.values())
    assert exact.groups(none).count() == 0
    a, b = b"hello " * 9, b"world"
    assert exact.combine(exact.fingerprint(a), exact.fingerprint(b), len(b)) == exact.fingerprint(a + b)


def test_colliding_fingerprints_split(docs, monkeypatch):
    monkeypatch.setattr(exact, "_prints", lambda xs: pa.array([b"same"] * len(xs), pa.binary()))
    got = exact.groups(docs).collect()
    assert len({r.keep_id for r in got}) == len({r.text_sha256 for r in got})
    odd = docs.sparkSession.createDataFrame([(None, "aa"), (None, "bb"), (3, "cc"), (3, "dd"), (None, "bb"), (4, "cc")], docs.select("doc_id", "text").schema)
    got = sorted((r.text_sha256, r.group_size, r.keep_id) for r in exact.groups(odd).collect())
    assert got == sorted((sha(x), n, k) for x, n, k in ((b"aa", 1, None), (b"bb", 2, None), (b"bb", 2, None), (b"cc", 2, 3), (b"cc", 2, 3), (b"dd", 1, 3)))


def test_packing(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    packed = packing.pack(packing.pieces(docs, WORDS, capacity=64, with_ids=True), capacity=64).collect()
    own = {}
    for r in docs.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [0]
        own.update({(r.doc_id, i // 64): ids[i : i + 64] for i in range(0, len(ids), 64)})
    at = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.ids == own[r.doc_id, r.piece] and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.start == 64 * r.piece
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 64 and len(packed) == len(own) + sum(k[0] == 20 for k in own)
    assert len(at) <= -(-sum(at.values()) // 64) * 1.05 + 1
    assert packing.pack(packing.pieces(none, WORDS)).count() == 0
    s = ["a\x01b x", "İ. x'. 'S. A'll: ǅ! <|endoftext|> 日本", "ﬁ́  é\n\n12"]
    s += ["a <|endoftext|> b", "a<|startoftext|>b <|endoftext|", " ".join(f"w{i % 7000}x" for i in range(300_000))]  # more than a block
    for path in (WORDS, public_tokenizers.path("byte_bpe_50k.json")):  # the second keeps spaces
        t, ours = Tokenizer.from_file(path), packing.WordIds(path)
        assert ours.by_words == (path == WORDS) and ours(s) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in s]


def test_plan_places_all():
    r = random.Random(3)
    h = {n: r.randint(1, 50) for n in r.sample(range(1, 101), 60)}
    runs, used = packing.plan(h, 100), Counter()
    for n, lo, hi, seq, at in runs:
        for k in range(hi - lo):
            for x in range(at, at + n):
                used[seq + k, x] += 1
    assert set(used.values()) == {1} and {n: sum(b - a for m, a, b, *_ in runs if m == n) for n in h} == h


def test_simhash(docs, none):
    rows = {r.doc_id: simhash.fingerprint(r.text) for r in docs.collect()}
    up = {k: k for k in rows}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in rows:
        for b in rows:
            if (rows[a] ^ rows[b]).bit_count() <= 3:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    for most in (simhash.ANCHOR_ROWS, 2):
        assert {r.doc_id: (r.simhash % 2**64, r.component_id) for r in simhash.groups(docs, most=most).collect()} == {k: (rows[k], root(k)) for k in rows}
    kept = simhash.deduplicate(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({root(k) for k in rows}) and kept.columns == docs.columns
    assert simhash.groups(none).count() == 0


def test_simhash_fingerprints_bit_by_bit(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcDEÉ.") for _ in range(r.randint(1, 5)))
    rows = [None, "", " \t", "One", "one  TWO", "A b\nc d", "É à ü", "x x x x x", *(" ".join(word() for _ in range(n)) for n in (3, 4, 50, 2000, 70_000))]

    def bits(text):
        data = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
        w = [x for x in re.split(rb"[\x20\x09-\x0D]+", data) if x]
        grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))

    df = spark.createDataFrame([*enumerate(rows), (None, "lone one")], "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in simhash.groups(df).select("doc_id", simhash.hexadecimal().alias("fingerprint")).collect()}
    assert got == {k: f"{bits(t):016x}" for k, t in [*enumerate(rows), (None, "lone one")]}


def test_null_keys_of_exact_dedup(spark):
    rows = [(None, "a b"), (None, "c"), (None, "c "), (4, "a  b"), (4, "a b"), (3, None), (None, "")]
    got = sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in exact.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0, 1, True), (0, 0, 1, True), (0, 3, 2, False), (0, 4, 3, False), (3, 3, 2, True), (4, 4, 3, True), (4, 4, 3, True)]
    kept = exact.deduplicate(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string"))
    assert sorted((r.doc_id or 0, re.sub(" +", " ", r.text or "")) for r in kept.collect()) == [(0, "c"), (0, "c "), (3, ""), (4, "a b")]


def test_simhash_replaces_rows_only_within_groups(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(None, a), (None, b), (None, c), (None, a), (7, b), (8, a.upper() + " more"), (8, c + " other"), (8, "another")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    prints = [simhash.fingerprint(t) for t in (a, b, c, rows[5][1], rows[6][1], "another")]
    near = {(i, j) for i in range(6) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3}
    kept = sorted((r.doc_id or 0, r.text) for r in simhash.deduplicate(df).collect())
    want = {7: [b], 8: [rows[5][1], rows[6][1], "another"], 0: [t for t, i, j in ((a, 0, 3), (c, 2, 4)) if (j, i) not in near]}
    assert near <= {(3, 0), (4, 2)} and kept == sorted((k, t) for k, ts in want.items() for t in ts)


def test_simhash_covering_meets_all_links():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**64, 300, np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    home = simhash.replicas(a)[0][: len(a)]
    anchor, row, _ = simhash.replicas(b)
    near = {(int(r), int(k)) for r, k in zip(row, anchor)}
    assert all((i, int(h)) in near for i, h in enumerate(home))


def test_simhash_links_of_split_anchors(spark):
    rng = np.random.default_rng(4)
    centre = rng.integers(0, 2**64, 6, np.uint64).repeat(60)
    for i in range(len(centre)):
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            centre[i] ^= np.uint64(1) << np.uint64(bit)
    x = np.unique(centre)
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "simhash long")
    near = np.bitwise_count(x[:, None] ^ x[None]) <= 3
    while ((more := (near.astype(int) @ near) > 0) != near).any():
        near = more
    want = {int(v): int(x[n][0]) for v, n in zip(x, near)}
    for most in (simhash.ANCHOR_ROWS, 40, 1):
        forest = simhash._Forest()
        for a, b in simhash.links(df, most=most).collect():
            assert ((a ^ b) % 2**64).bit_count() <= 3
            forest.join(a % 2**64, b % 2**64)
        assert {int(v): forest.root(int(v)) for v in x} == want


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((t or "").lower().split() for t in (a, b)))
    return len(a & b) / len(a | b)


def test_near(spark, monkeypatch):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    line, rows = " ".join(word() for _ in range(30)), [None, "", "a", "A ", "a b"]
    for n in (20, 64, 150, 400):
        for _ in range(4):
            base = [word() for _ in range(n)]
            rows.append(" ".join(base) + " " + line)
            for share in (0.004, 0.01, 0.02, 0.03, 0.06):
                rows.append(" ".join(word() if r.random() < share else w for w in base) + " " + line)
    ids = [*range(100, 100 + len(rows))]
    df = spark.createDataFrame([*zip(ids, rows)], "doc_id long, text string").repartition(3)
    up = [*range(len(rows))]
    for i in up:
        for j in range(i):
            if jaccard(rows[i], rows[j]) >= 0.8:
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    want = sorted({ids[x] for x in up})
    assert len(want) < len(rows) - 20
    for heavy in (near.HEAVY, 1):
        monkeypatch.setattr(near, "HEAVY", heavy)
        got = near.deduplicate(df)
        assert got.columns == df.columns and sorted(x.doc_id for x in got.collect()) == want
    assert near.deduplicate(df.where("doc_id < 0")).count() == 0


def test_pipeline_near_stage_joins_similar_texts(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(100)]
    texts = [" ".join(words), " ".join([*words[:97], "x", "y", "z"]), " ".join([*words[:50], *(f"v{i}" for i in range(50))])]
    assert jaccard(*texts[:2]) >= 0.8 and (simhash.fingerprint(texts[0]) ^ simhash.fingerprint(texts[1])).bit_count() > 3
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_dedup(spark, df, "").collect()) == [0, 2]


def test_near_tells_rows_apart(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(None, a), (None, b), (None, c), (None, a), (7, b), (8, c + " more"), (8, a + " more"), (8, "another")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in near.deduplicate(df).collect()) == [(7, b), (8, a + " more"), (8, "another"), (8, c + " more")]


def test_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((60, 8))
    v = [*x, *(x[:30] + rng.standard_normal((30, 8)) * 0.02), *x[:5]]
    rows = [(i, [float(c) for c in w], int(i % 2)) for i, w in enumerate(v)]
    odd = [None, [], [0.0] * 8, [None] * 8, [float("nan")] * 8, [float("inf")] * 8, [1.0]]
    rows += [(100 + i, w, 0) for i, w in enumerate(odd)] + [(200, rows[0][1], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    m = np.array([r.embedding for r in df.where("vec_id < 100").orderBy("vec_id").collect()], float)
    label = np.arange(len(v)) % 2
    u = m / np.linalg.norm(m, axis=1)[:, None]
    s = (u @ u.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(s, False)
    for block in (512, 3):
        got = {r.vec_id: r for r in vectors.near_duplicates(df, block=block, bits=4).collect()}
        assert [got[i].n_links for i in range(len(v))] == s.sum(1).tolist()
        assert all(got[k].n_links == 0 and got[k].kept for k in [*range(100, 107), 200])
        assert all(got[i].component_id == min(j for j in range(len(v)) if got[j].component_id == got[i].component_id) for i in range(len(v)))
    assert vectors.near_duplicates(df.where("vec_id < 0")).count() == 0


def test_vectors_recall_of_the_shipped_tables():
    rng = np.random.default_rng(6)
    x, y = rng.standard_normal((2, 30_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y -= (x * y).sum(1)[:, None] * x
    y = 0.98 * x + (1 - 0.98**2) ** 0.5 * y / np.linalg.norm(y, axis=1)[:, None]  # pairs at the very cosine
    for n in (1000, 1_000_000, 100_000_000):
        tables, bits = vectors.hashing(n)
        a, b = (vectors.signatures(v, tables, bits) for v in (x[: 30_000 if n < 10_000 else 4000], y[: 30_000 if n < 10_000 else 4000]))
        assert (a == b).any(1).mean() >= 0.999 and n / 2**bits <= vectors.BUCKET
    assert vectors.hashing(1000) == (16, 12)


def test_vectors_of_dense_groups_and_odd_keys(spark):
    rng = np.random.default_rng(3)
    near = rng.standard_normal(16) + rng.standard_normal((700, 16)) * 0.03  # a group larger than a block
    far = rng.standard_normal((500, 16))
    v = np.concatenate([near, far]).astype(np.float32)
    rows = [(i, [float(c) for c in w], 3) for i, w in enumerate(v)] + [(5, [float(c) for c in v[6]], 3), (None, [float(c) for c in v[0]], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("kept", F.lit("x")).repartition(5)
    u = np.concatenate([v, v[6:7]]).astype(float)
    n = np.linalg.norm(u, axis=1)
    s = (u @ u.T) / (n[:, None] * n[None]) >= 0.98
    np.fill_diagonal(s, False)
    want = sorted([*zip(range(1200), s[:1200].sum(1).tolist()), (5, int(s[1200].sum())), (-1, 0)])
    got = vectors.near_duplicates(df).collect()
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.n_links) for r in got) == want
    reach = {r.vec_id: r.component_id for r in got if r.vec_id is not None}
    assert {reach[i] for i in range(700) if s[i].any()} == {min(i for i in range(700) if s[i].any())}


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in common.components(e, "t").collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100}


def test_shards(docs, none):
    out = shards.shuffle(docs.select("doc_id", "key"), shards=4).collect()
    assert len(out) == docs.count()
    for s in range(4):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == [*range(len(slots))] and len(slots) in (len(out) // 4, len(out) // 4 + 1)
    assert shards.shuffle(none.select("doc_id")).count() == 0
    m = shards.communication_matrix(np.array([5, 0, 7]), np.array([4, 4, 4]), 1)
    assert m.sum(0).tolist() == [4, 4, 4] and m.sum(1).tolist() == [5, 0, 7]


def chance(good, bad, n):
    """The hypergeometric law, by integers."""
    return {k: math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) for k in range(max(0, n - bad), min(n, good) + 1)}


def fits(seen, law, draws):
    """Pearson's statistic, of cells of 8 expected draws or more, stays within five deviations."""
    x, cells = 0.0, 0
    for k, p in law.items():
        if p * draws >= 8:
            x, cells = x + (seen[k] - p * draws) ** 2 / (p * draws), cells + 1
    return cells > 3 and abs(x - cells + 1) < 5 * (2 * cells) ** 0.5


def test_hypergeometric_law():
    rng = np.random.default_rng(11)
    for good, bad, n in ((60, 200, 90), (200, 60, 90), (60, 200, 220), (900, 5000, 1000), (40, 4000, 2000), (12, 500, 300), (5000, 45, 60)):
        seen = Counter(shards.hypergeometric(rng, good, bad, n, most=0) for _ in range(1500))
        assert fits(seen, chance(good, bad, n), 1500), (good, bad, n)
    good, bad, n = 10**15, 15 * 10**15, 10**13  # far beyond numpy: mean and variance
    x = [shards.hypergeometric(rng, good, bad, n) - n // 16 for _ in range(800)]
    sd = (n / 16 * 15 / 16 * (1 - n / (good + bad))) ** 0.5
    assert abs(np.mean(x)) < 5 * sd / 800**0.5 and abs(np.std(x) / sd - 1) < 5 / 1600**0.5


def test_communication_matrix_law():
    counts, sizes = np.array([30, 50, 0, 40]), np.array([40, 40, 40])
    for most in (shards.NUMPY_MOST, 0):  # numpy's draws, and those of larger numbers
        drawn = [shards.communication_matrix(counts, sizes, s, most) for s in range(500)]
        assert all((m.sum(0) == sizes).all() and (m.sum(1) == counts).all() and (m >= 0).all() for m in drawn)
        for i, n in enumerate(counts):
            for j, size in enumerate(sizes):
                assert not n or fits(Counter(int(m[i, j]) for m in drawn), chance(int(size), int(120 - size), int(n)), 500), (most, i, j)


def test_shuffle_is_uniform(spark):
    n = 32_000
    got = shards.shuffle(spark.range(0, n, 1, 5).withColumnRenamed("id", "shard_row"), shards=16).collect()
    at = np.zeros((20, 64))  # blocks of rows against quarters of shards
    for r in got:
        at[r.shard_row * 20 // n, r.shard * 4 + r.slot * 4 // 2000] += 1
    x = ((at - n / 1280) ** 2 / (n / 1280)).sum()
    assert (at.sum(0) == 500).all() and abs(x - 19 * 63) < 5 * (2 * 19 * 63) ** 0.5


def test_licenses(spark):
    t = licenses.TEMPLATES
    rows = [(0, None), (1, ""), (2, "x\n" + t["MIT-line"] + "\ny"), (3, t["ISC"].upper().replace(" ", "\n ")), (4, "about the license"), (5, "p\n\n" + t["GPL-3.0"] + "\n\nq"), (2, "x\n" + t["MIT-line"])]
    df = spark.createDataFrame([(k, x, "z") for k, x in rows], "doc_id long, text string, license string")
    got = licenses.scan(df).collect()
    assert sorted((r.doc_id, r.license) for r in got if r.license) == [(2, "MIT-line"), (2, "MIT-line"), (3, "ISC"), (5, "GPL-3.0")] and len(got) == 7
    assert licenses.scan(df.where("doc_id < 0")).count() == 0


def test_licenses_whole_texts(spark):
    t, wrap = licenses.TEMPLATES, lambda s: "\n".join(textwrap.wrap(s, 72))
    names = ["MIT-full", "BSD-2-Clause-full", "BSD-3-Clause-full", "ISC-full", "GPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "Zlib", "Unlicense", "EPL-2.0"]
    head = "Some Project\nCopyright (c) 2020 A. Nobody. All rights reserved.\n"
    rows = [(i, f(t[n]), n) for i, (n, f) in enumerate((n, f) for n in names for f in (str, wrap, lambda x: head + wrap(x), lambda x: "Unlike words stand here.\n\n" + wrap(x) + "\n\nAnd here."))]
    got = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    assert got == {i: n for i, _, n in rows}
    tie = licenses.scan(spark.createDataFrame([(1, "alpha beta gamma delta")], "doc_id long, text string"), templates={"b": "alpha beta gamma delta", "a": "Alpha, beta gamma delta"}).first()
    assert (tie.license, tie.dice, tie.n_matches) == ("a", 1.0, 2)


def test_quality(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, d, "documents"), common.table(spark, d, "labels")
    model = quality.train(docs, labels)
    got = quality.score(docs, model).join(labels, "doc_id").where(quality.held_out()).select("score", "quality").collect()
    pos, neg = ([r.score for r in got if r.quality == q] for q in (1, 0))
    assert np.mean([[p > n for n in neg] for p in pos]) > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "a")], "doc_id long, text string")
    assert all(0 <= r.score <= 1 for r in quality.score(odd, model).collect())
    assert {r.score for r in quality.score(odd, quality.train(docs.where("doc_id < 0"), labels.where("doc_id < 0"))).collect()} == {0.5}


def test_risk_and_prior():
    rng = np.random.default_rng(1)
    for z in (rng.normal(0, 2, 40), np.concatenate([rng.normal(4, 1, 20), rng.normal(-6, 1, 20)])):  # the second cuts the negatives' risk off
        value = lambda z: (lambda p, n: p + n if n >= 0 else -n)(*quality.risk(z, 20, 0.6))
        step = [(value(z + d) - value(z - d)) / 2e-5 for d in np.eye(40) * 1e-5]
        assert np.allclose(quality.risk_slope(z, 20, 0.6), step, atol=1e-8)
    assert quality.risk(np.concatenate([np.full(20, 9.0), np.full(20, -9.0)]), 20, 0.6)[1] < 0
    for share in (0.2, 0.5, 0.8):
        good, bad = rng.normal(1, 1, (4000, 6)), rng.normal(-1, 1, (4000, 6))
        mixed = np.where((rng.random(4000) < share)[:, None], good[::-1], bad)
        assert abs(quality.estimated_prior(good[:2000], mixed) - share) < 0.07
    assert quality.estimated_prior(good[:5], mixed) == 0.5


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = common.table(spark, d, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = common.staged(stage(spark, docs, d), name)
        assert docs.columns == before.columns and 0 < docs.count() <= before.count()
    packed = corpus_pipeline.run(spark, d)
    assert packed.select("doc_id").distinct().count() == docs.count()
