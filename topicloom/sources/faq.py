"""FAQ sources: JSON export, CSV export and plain CSV files, or any table. All give the ``questions`` schema."""

from __future__ import annotations

import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.functions import lexicon, text
from topicloom.operators import scans
from topicloom.sources import documents, splits
from topicloom.store import spread

ANSWER = "struct<text:string,type:string,channel:string>"
JSON_SCHEMA = (
    f"faqs array<struct<question:string,alternateQuestions:array<struct<question:string,tags:array<string>,terms:array<string>>>,answer:array<{ANSWER}>,"
    f"alternateAnswers:array<array<{ANSWER}>>,responseType:string,terms:array<string>,tags:array<string>>>,"
    "synonyms map<string,array<string>>,kgParams struct<stopWords:array<string>>,unmappedpath array<struct<terms:array<string>>>"
)
FIRST_ID = 10001


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """A JSON export as the elements of its lists and objects, ``(no, section, text)``. Many tasks read a large document."""
    return documents.json_elements(spark, path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON export as one row, for small ones; what takes the rows of ``read_elements`` takes this too."""
    return spark.read.schema(JSON_SCHEMA).option("multiLine", True).json(path)


def _kind(name: str):
    return T.StructType.fromDDL(JSON_SCHEMA)[name].dataType


def elements(doc: DataFrame, name: str) -> DataFrame:
    """``(no, x)``: the elements of a list of an export, of ``read_elements`` or as one row; ``no`` orders them."""
    if "section" not in doc.columns:
        return doc.select(F.posexplode(name).alias("no", "x"))
    return doc.where(F.col("section") == name).select("no", F.from_json("text", _kind(name).elementType).alias("x"))


def members(doc: DataFrame, name: str) -> DataFrame:
    """``(x)``: an object of an export, in parts of a member each if it comes of ``read_elements``."""
    if "section" not in doc.columns:
        return doc.select(F.col(name).alias("x"))
    whole = F.concat(F.lit("{"), "text", F.lit("}"))
    return doc.where(F.col("section") == name).select(F.from_json(whole, _kind(name)).alias("x"))


def _listed(doc: DataFrame) -> list[str]:
    """The stop words that an export lists."""
    found = members(doc, "kgParams").select("x.stopWords").where("stopWords is not null").first()
    return [*found.stopWords] if found else []


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """``(row_no, cells)`` of headerless CSV files: ragged, blank and multi-line rows kept, in order. Many tasks read a large file."""
    return splits.csv_rows(spark, path)


def _answer(column) -> F.Column:
    return F.array(F.struct(column.alias("text"), F.lit("basic").alias("type"), F.lit("default").alias("channel")))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Adds ``q_id``: 10001 and on, by the columns of ``order``; their values are distinct."""
    return scans.positioned(rows, *order, name="q_id", first=FIRST_ID)


def _questions(rows: DataFrame, lang: str) -> DataFrame:
    """Ids from 10001 by ``ord``; ``primary_ord`` names the primary of a row."""
    named = numbered(rows, "ord")
    first = named.select(F.col("ord").alias("primary_ord"), F.col("q_id").alias("primary_id"))
    out = named.join(first, "primary_ord")
    return out.select("q_id", "ord", "primary_id", (F.col("q_id") == F.col("primary_id")).alias("is_primary"), "question", text.normalize(F.col("question"), lang).alias("normalized"), "answer", "sub_answers", "response_type")


def from_json(doc: DataFrame, lang: str = "en") -> DataFrame:
    """Questions of a JSON export; a primary is followed by its alternates. ``ord`` is struct(FAQ, place in it)."""
    faqs = elements(doc, "faqs").withColumnRenamed("no", "f")
    rows = faqs.select("f", "x", F.posexplode(F.concat(F.array("x.question"), F.coalesce(F.col("x.alternateQuestions.question"), F.array().cast("array<string>")))).alias("a", "question"))
    of_first = lambda c: F.when(F.col("a") == 0, F.col(c))
    own = rows.select(
        F.struct("f", "a").alias("ord"), F.struct("f", F.lit(0).alias("a")).alias("primary_ord"), "question", of_first("x.answer").alias("answer"),
        of_first("x.alternateAnswers").alias("sub_answers"), of_first("x.responseType").alias("response_type"),
    )
    return _questions(own, lang)


def _typed(rows: DataFrame, lang: str) -> DataFrame:
    out = rows.withColumn("sub_answers", F.lit(None).cast(f"array<array<{ANSWER}>>")).withColumn("response_type", F.lit("message"))
    return _questions(out, lang)


def from_csv(rows: DataFrame, lang: str = "en", strict: bool = False) -> DataFrame:
    """Plain CSV: question and answer cells, no header. Short rows are skipped; ``strict`` stops at the first one."""
    if strict:
        bad = rows.where(F.size("cells") < 2).agg(F.min("row_no").alias("_bad"))
        rows = rows.crossJoin(F.broadcast(bad)).where(F.col("_bad").isNull() | (F.col("row_no") < F.col("_bad"))).drop("_bad")  # one row
    own = rows.where(F.size("cells") >= 2).select(F.col("row_no").cast("long").alias("ord"), F.col("row_no").cast("long").alias("primary_ord"), F.col("cells")[0].alias("question"), _answer(F.col("cells")[1]).alias("answer"))
    return _typed(own, lang)


def csv_export_rows(rows: DataFrame) -> DataFrame:
    """The leading ``faq`` rows with the row number of their primary: an alternate belongs to the primary before it."""
    stop = rows.where(F.coalesce(F.get("cells", F.lit(0)), F.lit("")) != "faq").agg(F.min("row_no").alias("_stop"))
    lead = rows.crossJoin(F.broadcast(stop)).where(F.col("_stop").isNull() | (F.col("row_no") < F.col("_stop")))  # one row
    kind = F.get("cells", F.lit(2))
    filled = scans.carried(lead.withColumn("kind", kind), F.when(F.col("kind") == "primary", F.col("row_no")), "row_no", "primary_row")
    return filled.where("kind in ('primary', 'alternate')").drop("_stop")


def from_csv_export(rows: DataFrame, lang: str = "en") -> DataFrame:
    """CSV export; an alternate before any primary or a row without a question is an error."""
    own = csv_export_rows(rows)
    if not own.where(F.col("primary_row").isNull() | F.get("cells", F.lit(3)).isNull()).isEmpty():
        raise ValueError("an alternate before any primary, or a row without a question")
    answer = F.when(F.col("kind") == "primary", _answer(F.get("cells", F.lit(4))))
    return _typed(own.select(F.col("row_no").cast("long").alias("ord"), F.col("primary_row").cast("long").alias("primary_ord"), F.get("cells", F.lit(3)).alias("question"), answer.alias("answer")), lang)


def csv_stop_words(rows: DataFrame, lang: str = "en") -> list[str]:
    found = rows.where(F.get("cells", F.lit(0)) == "kgParams").orderBy("row_no").select(F.slice("cells", 5, 1 << 20).alias("w")).first()
    return lexicon.stop_words(lang, [w for w in found.w if w] if found else None)


def json_stop_words(doc: DataFrame, lang: str = "en") -> list[str]:
    return lexicon.stop_words(lang, _listed(doc))


def analyzer_stop_words(doc: DataFrame, lang: str = "en") -> list[str]:
    """The stop words of a graph document alone: none if it lists none, none for ``kk``; ``en_kore`` adds question words."""
    own = {*_listed(doc)} if lang != "kk" else set()
    return sorted(own | ({*lexicon.QUESTION_WORDS} if lang == "en_kore" else set()))


def graph_synonyms(doc: DataFrame) -> DataFrame:
    """``(term, synonyms)`` of a JSON export."""
    return members(doc, "synonyms").select(F.explode("x").alias("term", "synonyms"))


def synonym_file(rows: DataFrame) -> DataFrame:
    """``(term, synonyms)`` of a generated synonym CSV: rows of two cells or more."""
    return rows.where(F.size("cells") > 1).select(F.col("cells")[0].alias("term"), F.col("cells")[1].alias("synonyms"))


def from_table(df: DataFrame, question: str, answer: str, key: str, lang: str = "en") -> DataFrame:
    """Any table as FAQs: the key serves as id and order, so nothing is sorted in one place. Rows are dealt to all cores before their texts are normalised."""
    k = F.col(key).cast("long")
    return spread(df, key).select(k.alias("q_id"), k.alias("ord"), k.alias("primary_id"), F.lit(True).alias("is_primary"), F.col(question).alias("question"), text.normalize(F.col(question), lang).alias("normalized"), _answer(F.col(answer)).alias("answer"), F.lit(None).cast(f"array<array<{ANSWER}>>").alias("sub_answers"), F.lit("message").alias("response_type"))


SOURCES = {"json_export": lambda s, p, lang: from_json(read_elements(s, p), lang), "csv": lambda s, p, lang: from_csv(csv_rows(s, p), lang), "csv_export": lambda s, p, lang: from_csv_export(csv_rows(s, p), lang)}


def read(spark: SparkSession, kind: str, path: str, lang: str = "en") -> DataFrame:
    if kind not in SOURCES:
        raise ValueError(f"unknown source {kind!r}; there are {', '.join(SOURCES)}")
    return SOURCES[kind](spark, path, lang)


def read_corpus(spark: SparkSession, path: str, extract=None) -> DataFrame:
    """``(text)`` lines of text files; with ``extract`` (bytes to str) of binary files such as PDF, or of the members of ZIP files, folders within them too."""
    if extract is None:
        return spark.read.text(path).withColumnRenamed("value", "text")

    def lines(batches):
        import zipfile

        import pandas as pd

        for pdf in batches:
            for name, body in zip(pdf["path"], pdf["content"], strict=True):
                members = [body]
                if name.lower().endswith(".zip"):
                    z = zipfile.ZipFile(io.BytesIO(body))
                    members = (z.read(n) for n in sorted(z.namelist()) if not n.endswith("/"))
                for b in members:
                    yield pd.DataFrame({"text": [x for x in extract(bytes(b)).splitlines() if x.strip()]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(lines, "text string")


def named_function(name: str):
    """The function that ``module:function`` names."""
    import importlib

    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``(word, vector array<float>)`` from Parquet, word2vec binary files (``.bin``), or word2vec text files (a header line is skipped)."""
    path = path.rstrip("/")
    if path.endswith(".parquet"):
        return spark.read.parquet(path).select("word", "vector")
    if path.endswith(".bin"):
        return binary_vectors(spark, path)
    cells = spark.read.text(path).select(F.split(F.trim("value"), " ").alias("c")).where(F.size("c") > 2)
    return cells.select(F.col("c")[0].alias("word"), F.slice("c", F.lit(2), F.size("c") - 1).cast("array<float>").alias("vector"))


#: Bytes of a binary vector file that a task reads.
VECTOR_BLOCK = 64 << 20
#: Longest word of a binary vector file, in bytes.
LONGEST_WORD = 4096


def binary_vectors(spark: SparkSession, path: str, block: int | None = None, whole: int = 1 << 30) -> DataFrame:
    """A word2vec binary file: a line ``words size``, then for each word its name, a space and ``size`` little-endian floats.

    Words have no fixed length, so a file is walked by one reader, on an executor; vectors leave it in
    batches of about a block. Spark hands over files of up to ``whole`` bytes; larger ones are opened by pyarrow.
    """
    block = block or VECTOR_BLOCK
    files = spark.read.format("binaryFile").load(path)
    kind = "word string, vector array<float>"

    def read(batches):
        from pyarrow import fs

        for batch in batches:
            for body in batch.column(0):
                body = body.as_py()
                if isinstance(body, bytes):  # content
                    yield from _vector_batches(io.BytesIO(body), block)
                else:  # a path: the file is larger than a value of Spark may be
                    store, at = fs.FileSystem.from_uri(body if "://" in body else body.replace("file:", "file://", 1))
                    with store.open_input_stream(at) as f:
                        yield from _vector_batches(f, block)

    small, large = files.where(F.col("length") <= whole).select("content"), files.where(F.col("length") > whole).select("path")
    return small.mapInArrow(read, kind).unionByName(large.mapInArrow(read, kind))


def _vector_batches(f, block: int):
    import numpy as np
    import pyarrow as pa

    def batch():
        numbers = pa.array(np.frombuffer(b"".join(vectors), "<f4"))
        return pa.RecordBatch.from_arrays([pa.array(words), pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * size), numbers)], ["word", "vector"])

    data = f.read(block)
    while b"\n" not in data and (more := f.read(block)):
        data += more
    head, _, data = data.partition(b"\n")
    rows, size = map(int, head.split())
    words, vectors = [], []
    while rows:
        at = 0
        while rows and (space := data.find(b" ", at, at + LONGEST_WORD)) >= 0 and len(data) >= space + 1 + 4 * size:
            words.append(data[at:space].lstrip(b"\n").decode(errors="replace"))
            vectors.append(data[space + 1 : space + 1 + 4 * size])
            at, rows = space + 1 + 4 * size, rows - 1
        if words:
            yield batch()
            words, vectors = [], []
        if rows:
            more = f.read(block)
            if not more:
                raise ValueError("the file ends before its last vector")
            data = data[at:] + more
