"""Chunks and verbs by statistics, against plain Python."""

import math
import random
from collections import Counter

from topicloom import queries
from topicloom.functions import lexicon
from topicloom.operators import assign, chunking, grams
from topicloom.plans import pipeline


def coined(n=600):
    """Names of two words, and a few words between them that are in no list."""
    r = random.Random(6)
    names, small = [f"na{i} me{i}" for i in range(40)], ["zu", "ek", "ol"]
    return names, small, [(i, " ".join([r.choice(small), r.choice(names), r.choice(small), r.choice(names), r.choice(small)][r.randint(0, 1) :])) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, t) for i, t in rows], "q_id long, question string, normalized string")


def test_words_of_no_list_part_names(spark):
    names, small, rows = coined()
    q = frame(spark, [*rows, (900, None), (901, ""), (902, "?!"), (903, "zu"), (904, "na1, me1"), (904, "na2 me2")])
    got = chunking.statistical_chunks(q).collect()
    assert {" ".join(x.chunk) for x in got if x.q_id < 900} == set(names)
    want = Counter(" ".join(n.split()) for _, t in rows for n in names if f" {n} " in f" {t} ")
    assert {k: v for k, v in Counter(" ".join(x.chunk) for x in got if x.q_id < 900).items()}.keys() == want.keys()
    for i, t in rows:
        own = [" ".join(x.chunk) for x in sorted((x for x in got if x.q_id == i), key=lambda x: x.c)]
        assert own == [f"{a} {b}" for a, b in zip(t.split(), t.split()[1:]) if a.startswith("na")] and [x.c for x in got if x.q_id == i and x.c == 0]
    assert [x.chunk for x in sorted((x for x in got if x.q_id == 904), key=lambda x: x.c) if x.chunk != ["na2", "me2"]][0][0] == "na1"  # a mark parts
    assert not [x for x in got if x.q_id in (900, 901, 902, 903)]
    assert chunking.statistical_chunks(q.where("q_id < 0")).count() == 0
    # in place of a stop list: topics are the names, not the words between them
    terms = {t for x in pipeline.build_graph(frame(spark, rows), [], verbs=[], chunker=chunking.statistical_chunks).collect() for t in x.terms} - {assign.ROOT}
    assert terms and terms <= set(names) | {w for n in names for w in n.split()} and not terms & set(small)
    phrases = lambda chunker: {x.term for x in grams.count(grams.mine(frame(spark, rows), [], [], chunker)).where("kind = 'phrase'").collect()}
    assert phrases(chunking.statistical_chunks) == set(names) and any(set(t.split()) & set(small) for t in phrases(None))


def test_branching_and_bonds_against_python(spark):
    _, _, rows = coined(200)
    rows += [(500, "ein, zwei drei"), (501, "ein"), (502, None)]
    met, words = Counter(), Counter()
    for _, t in rows:
        w = ["", *["" if x == "," else x for x in (t or "").replace(",", " ,").split()], ""] if t is not None else []
        met.update((a, b) for a, b in zip(w, w[1:]) if a or b)
        words.update(x for x in w if x)
    bits = lambda c: round(1000 * (math.log2(sum(c)) - sum(n * math.log2(n) for n in c) / sum(c)))
    left, right = ({x: bits([n for p, n in met.items() if p[i] == x]) for x in words} for i in (1, 0))
    pairs = chunking.pairs(frame(spark, rows))
    assert {(x.a, x.b): x.n for x in pairs.collect()} == met
    got = chunking.branching(pairs)
    assert {x.word: (x.n, x.left_bits, x.right_bits) for x in got.collect()} == {x: (words[x], left[x], right[x]) for x in words}
    total, hub = sum(met.values()), {x for x in words if min(left[x], right[x]) >= 3000}
    npmi = lambda a, b, n: round(1000 * math.log(n * total / words[a] / words[b]) / math.log(total / n))
    want = {(a, b): npmi(a, b, n) for (a, b), n in met.items() if a and b and n >= 3 and not {a, b} & hub and npmi(a, b, n) >= 100}
    assert hub == {"zu", "ek", "ol"} == {x.word for x in chunking.hubs(got, 3000).collect()}
    assert {(x.a, x.b): x.npmi for x in chunking.bonds(pairs, got, hub=3000).collect()} == want


def rounds_of(rows, seeds, rounds):
    seen = Counter()
    for _, t in rows:
        w = ["", *t.split(), ""]
        seen.update(zip(w[1:], w, w[2:]))
    verbs = {v: 0 for v in seeds if any(k[0] == v for k in seen)}
    for i in range(1, rounds + 1):
        by, own = Counter(), Counter()
        for (w, a, b), n in seen.items():
            by[a, b] += n
            own[a, b] += n * (w in verbs)
        kinds = Counter((a, b) for w, a, b in seen if w in verbs)
        good = {f for f in by if own[f] * 100 >= by[f] * 60 and kinds[f] >= 2}
        new = set()
        for w in {k[0] for k in seen} - {*verbs}:
            places = {k[1:]: n for k, n in seen.items() if k[0] == w}
            hit = {f: n for f, n in places.items() if f in good}
            if len(hit) >= 2 and sum(hit.values()) * 100 >= 20 * sum(places.values()):
                new.add(w)
        if not new:
            break
        verbs |= dict.fromkeys(new, i)
    return verbs


def test_verbs_join_round_by_round_to_a_fixpoint(spark):
    d = "/root/testdata/sf0.001"
    asked = queries.verb_questions(spark, d)
    rows = [(x.q_id, x.normalized) for x in asked.collect()]
    seeds = spark.createDataFrame([(v,) for v in (*queries.LISTED, "buy", "unseen")], "word string")
    got = {x.word: x["round"] for x in chunking.bootstrapped_verbs(asked, seeds).collect()}
    assert got == rounds_of(rows, {*queries.LISTED}, 10) == {**dict.fromkeys(queries.LISTED, 0), "lease": 1, "refurbish": 1, "swap": 2, "acquire": 3}
    assert not {"lease", "refurbish", "swap", "acquire"} & {*lexicon.verb_table()}
    # a fixpoint: one more round adds nothing; a bound on rounds ends it before
    found = spark.createDataFrame([(w,) for w in got], "word string")
    assert chunking.joining(chunking.frames(asked), found).isEmpty()
    assert {x.word for x in chunking.bootstrapped_verbs(asked, seeds, rounds=2).collect()} == {w for w, r in got.items() if r < 3}
    assert chunking.bootstrapped_verbs(asked.where("q_id < 0"), seeds).count() == 0
    r = random.Random(1)
    noise = [(i, " ".join(r.choice("abcdefg") for _ in range(r.randint(1, 5)))) for i in range(300)]
    few = {x.word: x["round"] for x in chunking.bootstrapped_verbs(frame(spark, noise), spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "word string"), rounds=4).collect()}
    assert few == rounds_of(noise, "abcd", 4)


def test_found_verbs_are_tagged(spark):
    asked = queries.verb_questions(spark, "/root/testdata/sf0.001")
    verbs = spark.createDataFrame([("swap",), ("lease",)], "word string")
    tagger = chunking.verb_tagger(verbs, spark.createDataFrame([("lease", "rent")], "word string, base string"))
    got = {x.term for x in grams.mine(asked, ["the"], tagger=tagger).where("kind = 'verb'").collect()}
    assert got == {"swap", "rent"}
    where = [(x.q_id, x.i) for x in tagger(frame(spark, [(1, "we swap it"), (2, None)])).collect()]
    assert where == [(1, 1)]
