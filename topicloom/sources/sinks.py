"""Sinks: the graph as JSON, the analyzer's report and the synonym list as CSV."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.operators.analyze import ORDER


def export_faqs(questions: DataFrame, assigned: DataFrame) -> DataFrame:
    """One row for each primary, as exported: ``question, alternateQuestions, terms, tags, refId, responseType, answer, alternateAnswers, dialogRefId``.

    An alternate's tags are its own and its terms that the primary lacks, sorted; its terms are the primary's.
    """
    both = questions.join(assigned, "q_id")
    form = lambda a: F.struct(F.coalesce(a.text, F.lit("test")).alias("text"), a.type.alias("type"), a.channel.alias("channel"))
    prime = both.where("is_primary").withColumnRenamed("q_id", "id")
    alt = both.where("not is_primary").join(prime.select(F.col("id").alias("primary_id"), F.col("terms").alias("_pt")), "primary_id")
    extra = F.array_sort(F.array_distinct(F.array_except("terms", "_pt")))
    alt = alt.select("primary_id", F.struct("ord", "question", F.concat("tags", extra).alias("tags"), F.col("_pt").alias("terms")).alias("a"))
    alt = alt.groupBy("primary_id").agg(F.transform(F.array_sort(F.collect_list("a")), lambda a: F.struct(a.question.alias("question"), a.tags.alias("tags"), a.terms.alias("terms"))).alias("alts"))
    out = prime.drop("primary_id").join(alt, F.col("id") == F.col("primary_id"), "left")
    none = F.array().cast("array<struct<question:string,tags:array<string>,terms:array<string>>>")
    return out.select(
        F.col("id").alias("q_id"), "question", F.coalesce("alts", none).alias("alternateQuestions"), "terms", "tags", F.lit("").alias("refId"), F.col("response_type").alias("responseType"),
        F.transform("answer", form).alias("answer"), F.transform(F.coalesce("sub_answers", F.array().cast("array<array<struct<text:string,type:string,channel:string>>>")), lambda s: F.transform(s, form)).alias("alternateAnswers"),
        F.when(F.col("response_type") == "dialog", F.lit("")).alias("dialogRefId"),
    )


def write_graph(faqs: DataFrame, synonyms: DataFrame | None, path: str, single: bool = False) -> None:
    """JSON lines of FAQs and of synonyms in two folders; ``single`` gives one document ``{faqs, synonyms}``.

    The document is one file of many lines: a line a FAQ, by id, between the lines that open and close it. One
    task sorts (on disk, where they are many) and writes the lines, none of which holds the graph; what is
    large goes out as JSON lines.
    """
    rows = faqs.drop("q_id")
    if not single:
        rows.write.mode("overwrite").json(f"{path}/faqs")
        if synonyms is not None:
            synonyms.write.mode("overwrite").json(f"{path}/synonyms")
        return
    line = F.to_json(F.struct(*rows.columns))
    parts = faqs.select(F.lit(1).alias("s"), F.col("q_id").alias("o"), F.lit("").alias("t"), line.alias("v"))
    if synonyms is not None:
        entry = F.regexp_replace(F.to_json(F.map_from_entries(F.array(F.struct("term", "synonyms")))), r"^\{|\}$", "")
        of_term = synonyms.where("term is not null").groupBy("term").agg(F.flatten(F.collect_list("synonyms")).alias("synonyms"))  # of one term
        parts = parts.unionByName(of_term.select(F.lit(3).alias("s"), F.lit(0).cast("bigint").alias("o"), F.col("term").alias("t"), entry.alias("v")))
    # a comma stands before each line but the first of its list
    firsts = {r["s"]: (r["x"]["o"], r["x"]["t"]) for r in parts.groupBy("s").agg(F.min(F.struct("o", "t")).alias("x")).collect()}  # two rows at most
    first = F.lit(False)
    for s, (o, t) in firsts.items():
        first = first | ((F.col("s") == s) & (F.col("o") == o) & (F.col("t") == t))
    parts = parts.withColumn("v", F.when(first, F.col("v")).otherwise(F.concat(F.lit(","), "v")))
    frame = faqs.sparkSession.createDataFrame([(0, 0, "", '{"faqs":['), (2, 0, "", '],"synonyms":{'), (4, 0, "", "}}")], "s int, o bigint, t string, v string")
    parts.unionByName(frame).repartition(1).sortWithinPartitions("s", "o", "t").select(F.col("v").alias("value")).write.mode("overwrite").text(path)


#: Which sink serves which kind of output.
SINKS = {"json": lambda faqs, synonyms, path: write_graph(faqs, synonyms, path, single=True), "json_lines": write_graph}


def write(kind: str, faqs: DataFrame, synonyms: DataFrame | None, path: str) -> None:
    if kind not in SINKS:
        raise ValueError(f"unknown sink {kind!r}; there are {', '.join(SINKS)}")
    SINKS[kind](faqs, synonyms, path)


REPORT = ("timestamp", "language", "error_type", "question", "path", "tags")


def report_rows(issues: DataFrame, language: str = "en") -> DataFrame:
    """The analyzer's report, in its order: ``timestamp, language, error_type, question, path, tags``, lists joined by commas."""
    now = F.concat(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    order = [c for c in ORDER if c in issues.columns]
    ordered = issues.orderBy(*order) if order else issues
    return ordered.select(now.alias("timestamp"), F.lit(language).alias("language"), "error_type", "question", F.array_join("path", ",").alias("path"), F.array_join("tags", ",").alias("tags"))


def write_report(issues: DataFrame, path: str, language: str = "en") -> None:
    """Appends the report. Files read in its order by name: ``part-<run>-<part>.csv``; run 0 is the header alone.

    Rows are written beside ``path`` first, in as many files as there are tasks, then get their names. Without
    issues nothing is written, no header either.
    """
    spark = issues.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path
    at, new = place(path), place(f"{path.rstrip('/')}.run-{uuid.uuid4().hex}")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    report_rows(issues, language).write.csv(new.toString())
    parts = [f.getPath() for f in fs.listStatus(new) if f.getPath().getName().startswith("part-") and f.getLen()]
    if parts:
        fs.mkdirs(at)
        runs = [int(f.getPath().getName().split("-")[1]) for f in fs.listStatus(at) if f.getPath().getName().startswith("part-")]
        if not runs:
            out = fs.create(place(at, "part-000000-00000.csv"), False)
            out.write(bytearray((",".join(REPORT) + "\n").encode()))
            out.close()
        run = max(runs, default=0) + 1
        for no, part in enumerate(sorted(parts, key=lambda p: (int(p.getName().split("-")[1]), p.getName()))):
            if not fs.rename(part, place(at, f"part-{run:06d}-{no:05d}.csv")):
                raise OSError(f"{part.toString()} could not be moved to {path}")
    fs.delete(new, True)


def write_synonyms(suggestions: DataFrame, path: str) -> None:
    suggestions.select("word", "synonyms").write.mode("overwrite").csv(path)
