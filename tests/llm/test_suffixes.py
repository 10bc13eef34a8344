import random

from pyspark.sql import functions as F

from topicloom.llm import suffixes


def words(r, size):
    """So many bytes, words of at most 7 letters."""
    out = ""
    while len(out) < size:
        out += "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) + " "
    return out[: size - 1] + "z"


def test_rows_of_a_common_passage_are_dealt_to_all_files(spark, monkeypatch):
    r, wrote, staged = random.Random(3), {}, suffixes.staged
    monkeypatch.setattr(suffixes, "staged", lambda df, tag: wrote.setdefault(tag, staged(df, tag)))
    passage = words(r, 900)
    rows = [(i, "A" * (i % 7) + words(r, 60) + passage + words(r, 60)) for i in range(80)]
    large = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # as for large tables
    for k, v in large.items():
        spark.conf.set(k, v)
    try:
        got = {x.doc_id: x.kept_text for x in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        files = wrote["suffix-first"].groupBy("d", F.input_file_name().alias("f")).count().groupBy("d").agg(F.sum("count").alias("rows"), F.max("count").alias("most")).collect()
    finally:
        for k in large:
            spark.conf.unset(k)
    # the bytes beside the passage may be equal by chance in two documents
    assert all(t not in got.values() and len(t) - len(got[i]) >= 900 and passage[:50] not in got[i] for i, t in rows)
    common = max(files, key=lambda x: x.rows)
    assert common.rows >= 80 and common.most < common.rows // 2


def test_passages_of_over_50_words_go_from_400_bytes_on(spark):
    r = random.Random(4)
    short, long = words(r, 399), words(r, 400)
    assert len(short.split()) > 50 and len(long.split()) > 50
    sides = [(words(r, 500) + a, b + words(r, 500)) for a, b in ("AB", "CD", "EF", "GH")]
    rows = [(i, x + p + y) for i, ((x, y), p) in enumerate(zip(sides, (short, short, long, long), strict=True))] + [(4, words(r, 1500))]
    got = {x.doc_id: (x.n_removed, x.kept_text) for x in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (400, t.replace(long, "")) if i in (2, 3) else (0, t) for i, t in rows}
