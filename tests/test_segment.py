"""Cutting of runs without spaces against all cuts of short strings."""

import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from topicloom.functions import lexicon
from topicloom.operators import assign, grams, segment
from topicloom.plans import pipeline


def cuts(run):
    for marks in itertools.product((0, 1), repeat=len(run) - 1):
        out, at = [], 0
        for i, m in enumerate((*marks, 1), 1):
            if m:
                out.append(run[at:i])
                at = i
        yield out


def model_of(words):
    return segment.Lattice([*words], np.array([*words.values()]))


def test_best_path_and_soft_counts_over_all_cuts():
    r = random.Random(3)
    for n in range(40):
        words = {"".join(r.choice("ab中") for _ in range(r.randint(1, 4))): r.choice([500, 1000, 1500, 3000]) for _ in range(12)} if n else {}
        lattice = model_of(words)
        runs = ["".join(r.choice("ab中x") for _ in range(r.randint(1, 9))) for _ in range(7)] + ["", "x"]
        cost = lambda c: sum(words.get(w, segment.UNKNOWN if len(w) == 1 else math.inf) for w in c)
        weights, soft = np.array([r.randint(1, 5) for _ in runs]), {}
        for run, k in zip(runs, weights, strict=True):
            all_ = [c for c in cuts(run)] if run else []
            each = [math.exp(-cost(c) / 1000) for c in all_]
            for c, p in zip(all_, each, strict=True):
                for w in c:
                    soft[w] = soft.get(w, 0) + k * p / sum(each)
        # of equal paths the last word is the longest, and so on backwards
        assert lattice.cut(runs) == [min(cuts(run), key=lambda c: (cost(c), [-len(w) for w in reversed(c)])) if run else [] for run in runs]
        other = lambda w: min(cost(c) for c in cuts(w) if len(c) > 1)
        assert [*lattice.savings(lattice.words)] == [other(w) - words[w] if len(w) > 1 else math.inf for w in lattice.words]
        got = lattice.soft(runs, weights)
        assert np.allclose(got[:-1], [soft.get(w, 0) for w in lattice.words])
        assert np.isclose(got[-1], sum(v for w, v in soft.items() if w not in words and len(w) == 1))


def corpus(spark, n=600):
    r = random.Random(5)
    words, marks = ["信用卡", "账户", "密码", "余额", "银行", "转账", "手机", "天"], ["的", "在", "是", "什麼"]
    rows = [("".join(r.choice(words) + (r.choice(marks) if r.random() < 0.5 else "") for _ in range(r.randint(2, 7))),) for _ in range(n)]
    return words, spark.createDataFrame(rows, "text string")


def test_learnt_model_finds_the_words(spark):
    words, texts = corpus(spark)
    model = segment.learn(texts, least=5).collect()
    lattice = model_of({x.word: x.cost for x in model})
    assert lattice.cut(["我的信用卡密码", "银行账户余额是", "密码"]) == [["我", "的", "信用卡", "密码"], ["银行", "账户", "余额", "是"], ["密码"]]
    own = {w for w in lattice.words if len(w) > 1 and lattice.cut([w]) == [[w]]}
    assert {w for w in words if len(w) > 1} <= own
    # soft counts of Spark's tasks add up to those of one lattice
    runs = segment.runs(texts)
    rows = runs.collect()
    spark_soft = {x.word: x.cnt for x in segment.soft_counts(runs.repartition(5), spark.createDataFrame(model)).collect()}
    alone = dict(zip(lattice.words, lattice.soft([x.run for x in rows], np.array([x.n for x in rows])), strict=False))
    assert all(math.isclose(v, spark_soft.get(w, 0), rel_tol=1e-9, abs_tol=1e-12) for w, v in alone.items() if v > 1e-9)
    assert segment.learn(texts.where("text = 'none'")).count() == 0


def test_spaces_nulls_and_other_scripts(spark):
    model = spark.createDataFrame([("信用卡", 900), ("密码", 1000), ("の", 500)], "word string, cost int")
    rows = [("我的信用卡密码abc，密码!",), ("plain words",), ("",), (None,), ("カードのパス",), ("한국어 단어",), ("密" * 3000,)]
    got = [x.s for x in spark.createDataFrame(rows, "t string").select(segment.spaced(F.col("t"), model).alias("s")).collect()]
    assert got[:4] == [" 我 的 信用卡 密码 abc， 密码 !", "plain words", "", None] and got[4] == " カ ー ド の パ ス " and got[5] == "한국어 단어" and got[6].split() == ["密"] * 3000
    docs = spark.createDataFrame([(1, "密码信用卡 x"), (1, "密码"), (None, None), (3, "")], "doc_id long, text string")
    assert sorted((x.doc_id or 0, x.words) for x in segment.document_words(docs, model, segment.UNSPACED).collect()) == [(0, []), (1, ["密码"]), (1, ["密码", "信用卡"]), (3, [])]


def test_chinese_graph_counts_matches_and_drops_stop_words(spark):
    words, texts = corpus(spark)
    model = segment.learn(texts, least=5)
    r = random.Random(2)
    asked = [(i, f"{r.choice(words[:4])}{'在' if i % 2 else '是'}{r.choice(words[4:7])}什麼？") for i in range(80)] + [(80, "信用卡？")]
    q = spark.createDataFrame([(i, t, t) for i, t in asked], "q_id long, question string, normalized string")
    stop = lexicon.stop_words("zh")
    got = {x.q_id: x for x in pipeline.build_graph(q, stop, verbs=[], segments=model).collect()}
    terms = {t for x in got.values() for t in x.terms} - {assign.ROOT}
    assert terms <= {*words} | {f"{a} {b}" for a in words for b in words} and {"信用卡", "账户"} <= {w for t in terms for w in t.split()} | {w for x in got.values() for w in x.tags}
    assert not terms & {*stop}
    counts = {x.term: x.cnt for x in grams.count(grams.mine(segment.segmented(q, model), stop, [])).where("kind = 'unigram'").collect()}
    assert counts["信用卡"] == sum(t.count("信用卡") for _, t in asked)
    assert pipeline.build_graph(q, stop, verbs=[], segments=True).count() == 81  # a model of the questions alone
    # without segmentation a whole question is one word
    assert all("信用卡" not in x.terms for x in pipeline.build_graph(q, stop, verbs=[]).where("q_id < 80").collect())
