"""Tests of the findings of round 3."""

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Word2Vec

from topicloom.operators import synonyms


def _brute(q, v, k):
    unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1)) > 0, n, 1)[:, None]
    s = np.round(unit(q) @ unit(v).T, 6) + 0.0
    names = [f"w{i:05}" for i in range(len(v))]
    return {(f"w{i:05}", names[j], s[i, j]) for i in range(len(q)) for j in sorted((j for j in range(len(v)) if j != i), key=lambda j: (-s[i, j], j))[:k]}


def test_nearest_words_are_screened_and_exact(monkeypatch):
    r = np.random.default_rng(3)
    v = r.normal(size=(1500, 40))
    v[100:104] = v[7]  # ties
    v[200] = v[8] * (1 + 1e-7)
    v[300:303] = 0
    v[400] = v[9] + r.normal(size=40) * 1e-5  # apart by less than single precision tells
    v[401] = v[9] + r.normal(size=40) * 1e-5
    pairs, exact = [], synonyms._cosines
    monkeypatch.setattr(synonyms, "_cosines", lambda q, v, row, col: pairs.append(len(row)) or exact(q, v, row, col))
    monkeypatch.setattr(synonyms, "TILE", 1 << 18)

    def got(q, v):
        t = synonyms._top(3)(pa.table({"q": [f"w{i:05}" for i in range(len(q))], "qv": pa.array(list(q))}), pa.table({"word": [f"w{i:05}" for i in range(len(v))], "v": pa.array(list(v))}))
        return set(zip(*(t[c].to_pylist() for c in ("word", "neighbor", "similarity")), strict=True))

    assert got(v, v) == _brute(v, v, 3)
    assert 0 < sum(pairs) < 1500 * 1500 / 10  # of all pairs, few are computed in double precision
    same = np.tile(v[:2], (300, 1))  # many ties
    assert got(same, same) == _brute(same, same, 3)
    assert got(v[:3], v[:3]) == _brute(v[:3], v[:3], 3)


def test_word_vectors_are_trained_by_the_whole_cluster(spark, monkeypatch):
    used = []
    monkeypatch.setattr(synonyms, "Word2Vec", lambda **b: used.append(b["numPartitions"]) or Word2Vec(**b))
    rows = spark.createDataFrame([("one two three",), ("two three four",)], "text string").repartition(2)
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", property(lambda self: 7))
    assert {len(x.vector) for x in synonyms.train_vectors(rows, size=4).collect()} == {4} and used == [7]


def test_pipeline_near_stage_links_by_fingerprints(spark, monkeypatch):
    """SimHash alone finds copies of few changed bits, and whole texts verify what it finds."""
    import corpus_pipeline

    from topicloom.llm import near, simhash

    words = [f"w{i}" for i in range(2000)]
    texts = [" ".join(words), " ".join(words).upper(), " ".join([*words, "x"]), " ".join(f"v{i}" for i in range(300))]
    assert 0 < (simhash.fingerprint(texts[0], 5) ^ simhash.fingerprint(texts[2], 5)).bit_count() <= 3
    df = spark.createDataFrame([*enumerate(texts), (9, None), (10, " ")], "doc_id long, text string")
    shared = near._shared
    monkeypatch.setattr(near, "_shared", lambda tokens: shared(tokens).where("false"))  # without prefix filtering
    got = lambda: sorted(r.doc_id for r in corpus_pipeline.simhash_dedup(spark, df, "").collect())
    assert got() == [0, 3, 9]
    every = lambda prints, column: prints.select(prints[column].alias("a")).distinct().crossJoin(prints.select(prints[column].alias("b")).distinct()).where("a < b")
    monkeypatch.setattr(simhash, "links", lambda prints, column="simhash", **b: every(prints, column))
    assert got() == [0, 3, 9]
    monkeypatch.setattr(simhash, "links", lambda prints, column="simhash", **b: every(prints, column).where("false"))
    assert got() == [0, 2, 3, 9]


def test_equal_questions_are_mined_and_assigned_once(spark):
    from pyspark.sql import functions as F

    from topicloom.functions import text
    from topicloom.operators import assign, grams

    asked = ["How do I pay the red ring?", "how do i pay the red ring", "red ring price", "red ring price", "red ring price", "Pay", None, None, "", "the blue ring price"]
    q = spark.createDataFrame([(40 - i if i % 3 else 100 + i, a) for i, a in enumerate(asked * 3)], "q_id long, question string").withColumn("normalized", text.normalize(F.col("question")))
    stop = ["how", "do", "i", "the"]
    rows = lambda df: sorted(map(str, df.collect()))
    counts = grams.count(grams.mine(q, stop))
    assert rows(grams.statistics(q, stop)) == rows(counts) and counts.where("kind = 'phrase' and cnt > 2").count() > 1
    got = assign.assign(q, counts, stop, "R")
    alone = {a: assign.assign(spark.createDataFrame([(1, a)], "q_id long, question string").withColumn("normalized", text.normalize(F.col("question"))), counts, stop, "R").first() for a in dict.fromkeys(asked)}
    assert sorted(r.q_id for r in got.collect()) == sorted(r.q_id for r in q.collect())
    own = {r.q_id: alone[r.question] for r in q.collect()}
    assert all((r.terms, r.tags) == (own[r.q_id].terms, own[r.q_id].tags) for r in got.collect()) and len(set(map(str, alone.values()))) > 3


def test_rows_of_a_small_file_go_to_all_cores(spark):
    from topicloom import queries

    assert queries.part_faqs(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_segmenting_holds_little_at_once(spark, monkeypatch):
    """A worker turns distinct runs into strings, not each occurrence; slices and bounds change nothing."""
    from topicloom.operators import segment

    model = spark.createDataFrame([("a", 900), ("b", 900), ("ab", 700), ("c", 2000), ("abc", 1500)], "word string, cost int")
    texts = ["abcab ab", None, "", "zz abc", "ab " * 50, "cabz" * 20, "-"] * 3
    lattice = segment._held(model)
    want = [[w for r in (t or "").replace("-", " ").split() for w in lattice.cut([r])[0]] for t in texts]
    seen, kept = [], []
    monkeypatch.setattr(segment, "arrow_udf", lambda f, kind: kept.append(f) or (lambda c: c))
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    segment.document_words(docs, model, r"\p{L}")
    monkeypatch.setattr(segment.Lattice, "cut", lambda self, runs, cut=segment.Lattice.cut: seen.append(len(runs)) or cut(self, runs))
    lists = pa.array([[r for r in (t or "").replace("-", " ").split()] for t in texts], pa.list_(pa.string()))
    assert kept[0](lists).to_pylist() == want and seen == [5]
    for runs, met in ((1, 2), (7, 0), (40, 1 << 16)):
        monkeypatch.setattr(segment, "RUNS", runs)
        monkeypatch.setattr(segment, "MET", met)
        assert kept[0](lists).to_pylist() == want and kept[0](lists.slice(3, 5)).to_pylist() == want[3:8] and kept[0](lists[:0]).to_pylist() == []


def test_contractions_are_expanded_again_only_where_an_apostrophe_is_left(spark, monkeypatch):
    from topicloom.functions import lexicon, text

    rows = spark.createDataFrame([("why isn't it?",), ("what's up",), ("plain",), (None,), ("",)], "s string")
    double = spark.createDataFrame([("she'd've gone",), ("ann's cat isn't here",), ("i couldn't've",)], "s string")
    got = lambda df: [r[0] for r in df.select(text.expand_contractions(df["s"])).collect()]
    assert got(double) == ["she would have gone", "ann's cat is not here", "i could not have"]

    class Rounds(dict):
        met = 0

        def items(self):
            Rounds.met += 1
            return super().items() if Rounds.met == 1 else {"(": "no regular expression"}.items()  # fails where it is evaluated

    monkeypatch.setattr(lexicon, "CONTRACTIONS", Rounds(lexicon.CONTRACTIONS))
    assert got(rows) == ["why is not it?", "what is up", "plain", None, ""] and Rounds.met == 2
