"""The three programs: build a graph, analyze it, suggest synonyms."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom import store
from topicloom.functions import lexicon, text
from topicloom.operators import analyze, assign, grams, lemmas, optimise, segment, synonyms
from topicloom.sources import faq, sinks

STRATEGIES = {"gram_based": assign.assign}
log = logging.getLogger("topicloom")


def term_statistics(questions: DataFrame, stop, verbs=None, chunker=None, tagger=None) -> DataFrame:
    return grams.statistics(questions, stop, verbs, chunker, tagger)


def lemmatized(questions: DataFrame, stop, table: DataFrame | None = None) -> DataFrame:
    """``questions`` with nouns by their lemmas; the table ``(word, lemma)`` is made from their own words if none is given."""
    table = store.staged(lemmas.noun_lemmas(lemmas.vocabulary(questions), stop), "lemmas") if table is None else table
    return lemmas.lemmatize(questions, table)


def build_graph(questions: DataFrame, stop=None, strategy: str = "gram_based", counts: DataFrame | None = None, verbs=None, chunker=None, tagger=None, noun_lemmas: DataFrame | bool = False, segments: DataFrame | bool = False) -> DataFrame:
    """``(q_id, terms, tags)``: every question is assigned, primaries are optimised.

    ``verbs``, ``chunker`` and ``tagger`` are those of ``grams.mine``; ``noun_lemmas`` is a table ``(word, lemma)``,
    or True for one of the questions' own words; ``segments`` is a model ``(word, cost)`` that puts words of
    scripts without spaces apart, or True for one learnt from the questions. Statistics are computed once, and the terms
    made of them written.
    """
    stop = lexicon.stop_words() if stop is None else stop
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; there are {', '.join(STRATEGIES)}")
    if segments is not False:
        questions = store.staged(segment.segmented(questions, None if segments is True else segments), "segmented")
    if noun_lemmas is not False:
        questions = store.staged(lemmatized(questions, stop, None if noun_lemmas is True else noun_lemmas), "lemmatized")
    if segments is False and noun_lemmas is False:
        questions = store.staged(questions, "questions")  # read several times
    counts = term_statistics(questions, stop, verbs, chunker, tagger) if counts is None else counts
    terms = store.staged(assign.model(counts, stop), "terms") if "sort_cnt" not in counts.columns else counts
    found = STRATEGIES[strategy](questions, terms, stop)
    if "is_primary" not in questions.columns:
        return optimise.optimise(found)
    found = store.staged(found.join(questions.select("q_id", "is_primary"), "q_id"), "assigned")
    return optimise.optimise(found.where("is_primary").drop("is_primary")).unionByName(found.where("not is_primary").drop("is_primary"))


def _names(column) -> F.Column:
    name = lambda t: F.when(F.startswith(t, F.lit("{")), F.coalesce(F.get_json_object(t, "$.name"), t)).otherwise(t)
    return F.transform(F.coalesce(column, F.array().cast("array<string>")), name)


def graph_faqs(doc: DataFrame) -> DataFrame:
    """``(ord, terms, tags, question, alternates)`` of a graph document, as the analyzer reads it."""
    rows = faq.elements(doc, "faqs").withColumnRenamed("no", "ord")
    alts = F.transform(F.coalesce("x.alternateQuestions", F.array().cast("array<struct<question:string,tags:array<string>,terms:array<string>>>")), lambda a: F.struct(a.question.alias("question"), _names(a.tags).alias("tags")))
    return rows.select(F.col("ord").cast("long").alias("ord"), _names(F.col("x.terms")).alias("terms"), _names(F.col("x.tags")).alias("tags"), F.col("x.question").alias("question"), alts.alias("alternates"))


#: More than a document has FAQs.
AFTER = 1 << 48


def graph_unmapped(doc: DataFrame) -> DataFrame:
    """``(ord, terms)`` of the document's paths without questions; they come after its FAQs."""
    if "section" in doc.columns:
        rows = faq.elements(doc, "unmappedpath").select((F.col("no") + AFTER).alias("ord"), "x")
    else:
        rows = doc.select(F.size(F.coalesce("faqs", F.array())).alias("n"), F.posexplode("unmappedpath").alias("i", "x")).select((F.col("n") + F.col("i")).cast("long").alias("ord"), "x")
    return rows.select("ord", _names(F.col("x.terms")).alias("terms"))


def analyze_graph(doc: DataFrame, stop=None, lang: str = "en", limits: dict[str, int] | None = None) -> DataFrame:
    """Issues of a graph document (see ``read_json`` and ``read_elements``), with the columns that order the report; its own stop words hold unless some are given."""
    stop = faq.analyzer_stop_words(doc, lang) if stop is None else stop
    return analyze.issues(graph_faqs(doc), stop, faq.graph_synonyms(doc), graph_unmapped(doc), limits)


def suggest_synonyms(words: DataFrame, vectors: DataFrame, k: int = 3) -> DataFrame:
    return synonyms.suggestions(synonyms.nearest(words, vectors, k))


def main(argv=None) -> None:
    p = argparse.ArgumentParser(prog="topicloom")
    sub = p.add_subparsers(dest="program", required=True)
    g = sub.add_parser("graph")
    g.add_argument("path")
    g.add_argument("output")
    g.add_argument("--type", default="json_export", choices=[*faq.SOURCES])
    g.add_argument("--sink", default="json", choices=[*sinks.SINKS])
    g.add_argument("--strategy", default="gram_based", choices=[*STRATEGIES])
    g.add_argument("--language", default="en")
    g.add_argument("--synonyms", help="a generated synonym CSV to merge")
    g.add_argument("--chunker", help="module:function, see grams.mine")
    g.add_argument("--tagger", help="module:function, see grams.mine")
    g.add_argument("--verbs", help="a CSV of verb forms and their bases")
    g.add_argument("--no-lemmas", action="store_true")
    g.add_argument("--analyze", help="where to append the report on the new graph")
    a = sub.add_parser("analyze")
    a.add_argument("path")
    a.add_argument("report")
    a.add_argument("--language", default="en")
    a.add_argument("--limit", action="append", default=[], help="KIND=ROWS")
    s = sub.add_parser("synonyms")
    s.add_argument("path")
    s.add_argument("output")
    s.add_argument("--corpus", help="text files")
    s.add_argument("--documents", help="binary files or ZIP files, with --extract")
    s.add_argument("--extract", help="module:function, bytes to text, of --documents")
    s.add_argument("--vectors")
    s.add_argument("--epochs", type=int, default=1)
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("topicloom").getOrCreate()
    log.info("%s of %s", args.program, args.path)
    if args.program == "graph":
        doc = faq.read_elements(spark, args.path) if args.type == "json_export" else None
        rows = None if doc is not None else faq.csv_rows(spark, args.path)
        asked = faq.read(spark, args.type, args.path, args.language)
        stop = faq.json_stop_words(doc, args.language) if doc is not None else faq.csv_stop_words(rows, args.language) if args.type == "csv_export" else lexicon.stop_words(args.language)
        table = faq.graph_synonyms(doc) if doc is not None else None
        if args.synonyms:
            new = faq.synonym_file(faq.csv_rows(spark, args.synonyms))
            table = synonyms.merge_synonyms(table if table is not None else new.select("term", F.array().cast("array<string>").alias("synonyms")).distinct(), new)
        verbs = {r.cells[0]: r.cells[1] for r in faq.csv_rows(spark, args.verbs).where(F.size("cells") > 1).collect()} if args.verbs else None  # the caller's word table
        named = {n: faq.named_function(f) for n, f in (("chunker", args.chunker), ("tagger", args.tagger)) if f}
        found = build_graph(asked, stop, args.strategy, verbs=verbs, noun_lemmas=args.language == "en" and not args.no_lemmas, segments=args.language in segment.LANGUAGES, **named)
        faqs = store.staged(sinks.export_faqs(asked, found), "export")
        sinks.write(args.sink, faqs, table, args.output)
        if args.analyze:
            own = faqs.select(F.col("q_id").alias("ord"), "terms", "tags", "question", F.transform("alternateQuestions", lambda x: F.struct(x.question.alias("question"), x.tags.alias("tags"))).alias("alternates"))
            sinks.write_report(analyze.issues(own, (), table), args.analyze, args.language)
    elif args.program == "analyze":
        limits = {k: int(v) for k, _, v in (x.partition("=") for x in args.limit)}
        sinks.write_report(analyze_graph(faq.read_elements(spark, args.path), lang=args.language, limits=limits), args.report, args.language)
    else:
        doc = faq.read_elements(spark, args.path)
        faqs = faq.elements(doc, "faqs").select(F.col("no").alias("ord"), F.col("x.answer")[0]["text"].alias("answer"), *[F.coalesce(f"x.{c}", F.array().cast("array<string>")).alias(c) for c in ("terms", "tags")])
        if args.documents and not args.extract:
            p.error("--documents needs --extract")
        if args.documents:
            corpus = faq.read_corpus(spark, args.documents, faq.named_function(args.extract))
        else:
            corpus = faq.read_corpus(spark, args.corpus) if args.corpus else synonyms.answer_corpus(faqs).select(F.col("answer").alias("text"))
        vectors = faq.read_vectors(spark, args.vectors) if args.vectors else synonyms.train_vectors(corpus, epochs=args.epochs)
        sinks.write_synonyms(suggest_synonyms(synonyms.retrieve_words(faqs), vectors), args.output)
    store.clear(spark)


if __name__ == "__main__":
    main()
