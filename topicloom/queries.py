"""Queries over the driver's tables, one or more for each operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicloom.functions import lexicon, text
from topicloom.operators import analyze, assign, chunking, grams, lemmas, optimise, segment, synonyms, tree
from topicloom.plans import pipeline
from topicloom.sources import faq, sinks
from topicloom.store import staged

STOP = lexicon.stop_words()
PATH, LIST = ">", "|"
#: Passes over the corpus when word vectors are trained: gensim's own number, without the 1000 more of the reference.
EPOCHS = 5
#: Sentences with inflected verbs and adverbs, around the name ``n``.
VERB_TEMPLATES = (
    "'Customers usually buy and later returned the ', n, '.'", "'Paying for ', n, ' was never easily cancelled'", "'He only just shipped ', n", "'Supply of ', n, ' daily, quickly'",
    "'They have already been sending, stopped, and carried ', n", "n, ' isn''t paid'",
)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- fixtures -------------------------------------------------------------------------------------


def part_faqs(spark: SparkSession, d: str) -> DataFrame:
    """Templated questions, one for each part."""
    k, t = F.col("p_partkey") % 4, F.col("p_type")
    q = (
        F.when(k == 0, F.concat(F.lit("What's the "), t, F.lit(" price of the "), "p_name", F.lit("?")))
        .when((k == 2) & (t != "PROMO"), F.concat(F.lit("What is the "), t, F.lit(" price?")))
        .when(k == 3, F.concat(F.lit("Why isn't "), "p_brand", F.lit(" available?")))
        .otherwise(F.concat(F.lit("How do I order a "), "p_name", F.lit("?")))
    )
    return faq.from_table(table(spark, d, "part").withColumn("q", q), "q", "p_brand", "p_partkey")


def conversation_faqs(spark: SparkSession, d: str) -> DataFrame:
    """The first answered user turn of a conversation is a primary; its later user turns are alternates."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, d, "conversations").withColumn("next", F.lead("role").over(by)).withColumn("reply", F.lead("text").over(by)).where("role = 'user'")
    first = F.min(F.when(F.col("next") == "assistant", F.col("turn"))).over(Window.partitionBy("conv_id"))
    return turns.withColumn("first", first).where("turn >= first").select("conv_id", "turn", "text", F.col("first"), F.when(F.col("turn") == F.col("first"), F.col("reply")).alias("answer"))


def geo_faqs(spark: SparkSession, d: str) -> DataFrame:
    """``(ord, terms, tags, question, alternates)``: a tree of regions, nations and market segments with term syntax; some nodes are spelt in two ways."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n = n.select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"), F.lower("n_name").alias("low"), F.col("r_name").alias("r"))
    seg = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("k"), F.col("c_mktsegment").alias("s")).distinct()
    none = F.array().cast("array<string>")
    marked = lambda more: F.when(F.col("k") % 3 == 0, F.concat(F.lit("**"), "name", more)).when(F.col("k") % 3 == 1, F.concat(F.lit("!!"), "name")).otherwise(F.col("name"))
    raw = marked(F.when(F.ascii("s") % 2 == 0, "/land:geo").otherwise(" / state /land"))
    leaf = n.join(seg, "k").select((F.col("k") * 1000 + F.ascii("s")).alias("ord"), F.array("s", raw, "r", F.lit(" World ")).alias("terms"), F.when(F.col("k") % 4 == 0, F.array(F.concat(F.lower("r"), F.lit("/zone")))).otherwise(none).alias("tags"), F.concat(F.lit("Which "), F.lower("s"), F.lit(" offers are in "), "low", F.lit("?")).alias("question"))
    inner = n.where("k % 5 = 0").select((F.col("k") * 1000).alias("ord"), F.array(marked(F.lit("/country")), F.col("r"), F.lit(" World ")).alias("terms"), none.alias("tags"), F.concat(F.lit("Where's "), "low", F.lit("?")).alias("question"))
    top = spark.range(1).select(F.lit(-1).cast("long").alias("ord"), F.array(F.lit(" World ")).alias("terms"), none.alias("tags"), F.lit("Where are you?").alias("question"))
    alts = F.array(F.struct(F.lit("Tell me more about it").alias("question"), none.alias("tags")), F.struct(F.lit("||hidden").alias("question"), none.alias("tags")))
    return leaf.unionByName(inner).unionByName(top).withColumn("alternates", alts)


def geo_unmapped(spark: SparkSession, d: str) -> DataFrame:
    """``(ord, terms)``: paths without questions; some lead to nodes that are there."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey").cast("long")
    return n.where("n_nationkey % 2 = 0").select((k + 1_000_000).alias("ord"), F.array(F.concat("n_name", F.when(k % 4 == 0, "/left").otherwise("")), F.when(k % 3 == 0, F.col("r_name")).otherwise("Nowhere"), F.lit(" World ")).alias("terms"))


def geo_synonyms(spark: SparkSession, d: str) -> DataFrame:
    """``(term, synonyms)`` of the regions, and of the root."""
    return table(spark, d, "region").select(F.col("r_name").alias("term"), F.array(F.concat(F.lower("r_name"), F.lit(" area")), F.lit("region")).alias("synonyms"))


#: More than a conversation's turns.
TURNS = 1 << 20
HAND_PATHS = [(1, ["c", "b", "a", "R"]), (2, ["a", "R"]), (3, ["d", "R"]), (4, ["d", "R"]), (5, ["f", "e", "R"])]


def hand_paths(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, t, []) for i, t in HAND_PATHS], "q_id long, terms array<string>, tags array<string>")


def joined(df: DataFrame) -> DataFrame:
    return df.select("q_id", F.array_join("terms", PATH).alias("terms"), F.array_join("tags", LIST).alias("tags"))


def counts(spark: SparkSession, d: str) -> DataFrame:
    return grams.statistics(part_faqs(spark, d), STOP)


def shown_place(df: DataFrame) -> DataFrame:
    return df.withColumn("first_seen", F.concat_ws(":", *[F.col(f"first_seen.{x}").cast("string") for x in "qcki"]))


def assigned(spark: SparkSession, d: str) -> DataFrame:
    asked = staged(part_faqs(spark, d).select("q_id", "question", "normalized"), "asked")
    return assign.assign(asked, staged(assign.model(grams.statistics(asked, STOP), STOP), "terms"), STOP)


def paired_faqs(spark: SparkSession, d: str) -> DataFrame:
    """The templated FAQs in pairs: a question of odd number is an alternate of the one before it."""
    odd = F.col("q_id") % 2
    return part_faqs(spark, d).withColumn("primary_id", F.col("q_id") - odd).withColumn("is_primary", odd == 0)


def exported(spark: SparkSession, d: str) -> DataFrame:
    asked = paired_faqs(spark, d)
    return sinks.export_faqs(asked, pipeline.build_graph(asked, STOP))


def graph_document(spark: SparkSession, d: str) -> DataFrame:
    """A JSON export of the nations as one document, as ``read_json`` gives it."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    alts = F.when(F.col("n_nationkey") % 3 == 0, F.array(F.concat(F.lit("Tell me about "), "n_name"), F.concat(F.lit("What's "), "r_name"))).when(F.col("n_nationkey") % 3 == 1, F.array(F.col("r_name")))
    q = n.select("n_nationkey", F.to_json(F.struct(F.concat(F.lit("Where is "), "n_name", F.lit("?")).alias("question"), F.transform(alts, lambda a: F.struct(a.alias("question"))).alias("alternateQuestions"), F.when(F.col("n_nationkey") % 2 == 0, "dialog").alias("responseType"))).alias("j"))
    body = q.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "j"))), lambda x: x.j), ",").alias("j"))  # 25 rows
    return body.select(F.from_json(F.concat(F.lit('{"faqs":['), "j", F.lit("]}")), faq.JSON_SCHEMA).alias("x")).select("x.*")


# --- text -----------------------------------------------------------------------------------------


def normalize_text(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.normalize(F.col("text")).alias("normalized"))


def normalize_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.normalize(F.coalesce("text", F.lit("")), "en")).alias("normalized_md5"))


def expand_contractions(spark, d):
    return part_faqs(spark, d).select("q_id", text.expand_contractions(F.lower("question")).alias("expanded"))


def single_word_tag(spark, d):
    o = table(spark, d, "orders")
    q = F.concat(F.lit("What is the "), F.regexp_replace("o_orderpriority", "^[0-9]-", ""), F.lit("? "))
    return o.select("o_orderkey", text.single_word_tag(q, STOP).alias("tag"))


def tokenize_stopfilter(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(text.valid_words(text.without(text.tokens(text.normalize(F.col("text"))), STOP)), " ").alias("words"))


def analyzer_tokens(spark, d):
    return part_faqs(spark, d).select("q_id", F.array_join(text.analyzer_normalize(F.col("question")), " ").alias("words"))


# --- sources --------------------------------------------------------------------------------------


def faq_ids_altmap(spark, d):
    q = faq.numbered(conversation_faqs(spark, d), "conv_id", "turn")
    first = q.groupBy("conv_id").agg(F.min("q_id").alias("primary_id"))
    return q.join(first, "conv_id").select("q_id", "primary_id", F.md5("text").alias("question_md5"), F.md5("answer").alias("answer_md5"))


def json_export_ids(spark, d):
    return faq.from_json(graph_document(spark, d)).select("q_id", "primary_id", "is_primary", "question", "normalized", "response_type")


def csv_export_ffill(spark, d):
    """Users' turns as rows of a CSV export: a conversation's first is a primary, the others name none."""
    kind = F.when(F.col("turn") == 0, "primary").otherwise("alternate")
    turns = table(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * TURNS + F.col("turn")).alias("row_no"), F.array(F.lit("faq"), F.lit(""), kind, F.col("text")).alias("cells"))
    last = spark.createDataFrame([(2**62, ["header"])], "row_no long, cells array<string>")
    rows = faq.csv_export_rows(turns.unionByName(last))
    return rows.select("row_no", "kind", F.col("cells")[3].alias("question"), "primary_row")


def faq_table_source(spark, d):
    return part_faqs(spark, d).select("q_id", "question", "normalized", F.col("answer")[0]["text"].alias("answer"))


# --- words of runs without spaces ---------------------------------------------------------------


LETTERS = r"\p{L}"
#: Letters of a unit, and units of the model.
UNIT, UNITS = 5, 1 << 15


def unit_costs(spark: SparkSession, d: str) -> DataFrame:
    """The fixed model of ``segmented_documents``: counts of substrings of the documents' runs of letters."""
    own = segment.runs(table(spark, d, "documents").select(F.lower("text").alias("text")), script=LETTERS)
    return staged(segment.costs(segment.candidates(staged(own, "letter-runs"), UNIT, 20), UNITS), "units")


def segmented_documents(spark, d):
    """The units that the runs of letters of each document are cut into; null texts have none."""
    docs = table(spark, d, "documents").select("doc_id", F.lower("text").alias("text"))
    found = segment.document_words(docs, unit_costs(spark, d), LETTERS)
    return found.select("doc_id", F.size("words").cast("long").alias("n_units"), F.md5(F.array_join("words", " ")).alias("units_md5"))


# --- n-grams and statistics -----------------------------------------------------------------------


def _grams(n):
    def q(spark, d):
        words = text.without(text.tokens(text.normalize(F.col("text"))), STOP)
        return table(spark, d, "conversations").select(F.explode(text.ngrams(words, n)).alias("term")).groupBy("term").agg(F.count("*").alias("cnt")).where("cnt > 2")

    return q


def noun_lemmas(spark, d):
    words = text.words(F.lower("text"))
    return lemmas.noun_lemmas(table(spark, d, "documents").where("lang = 'en'").select(F.explode(words).alias("word")), STOP)


def lemmatized_questions(spark, d):
    """Questions on several things each; the singulars occur in other questions."""
    many = F.concat(F.lit("which "), F.regexp_replace("p_name", " ", "s "), F.lit(" and "), F.lower("p_type"), F.lit("s have addresses, boxes, keys or children? A box, a key")).alias("n")
    asked = table(spark, d, "part").select(F.col("p_partkey").alias("q_id"), F.when(F.col("p_partkey") % 2 == 0, many).otherwise(F.concat("p_name", F.lit(" "), "p_type")).alias("n"))
    asked = asked.select("q_id", text.normalize(F.col("n")).alias("normalized"))
    return lemmas.lemmatize(asked, lemmas.noun_lemmas(lemmas.vocabulary(asked), STOP)).select("q_id", F.array_join(text.words(F.col("normalized")), " ").alias("lemmas"))


def verb_phrases(spark, d):
    says = [f"when k % 6 = {i} then concat({x})" for i, x in enumerate(VERB_TEMPLATES)]
    asked = table(spark, d, "part").selectExpr("p_partkey q_id", "p_partkey k", "p_name n").selectExpr("q_id", f"case {' '.join(says)} end q")
    return grams.tag_verbs(asked.select("q_id", text.normalize(F.col("q")).alias("normalized")), STOP, lexicon.verb_table()).select("q_id", "i", "term")


#: Coined words that stand between names of two words; they are in no table.
COINED = ("zu", "ek", "ol", "mi", "ta", "re")


def coined_questions(spark: SparkSession, d: str) -> DataFrame:
    """``(q_id, question, normalized)``: two names for each part, by brand and size, between coined words."""
    k, b, s = F.col("p_partkey"), F.regexp_replace("p_brand", "[^0-9]", ""), F.col("p_size").cast("string")
    coined = lambda n: F.element_at(F.array(*[F.lit(x) for x in COINED]), (F.floor(k / n) % len(COINED) + 1).cast("int"))
    q = F.concat_ws(" ", coined(1), F.concat(F.lit("unit"), b), F.concat(F.lit("frame"), b), coined(6), F.concat(F.lit("grade"), s), F.concat(F.lit("steel"), s), coined(36))
    return table(spark, d, "part").select(k.alias("q_id"), q.alias("question"), text.normalize(q).alias("normalized"))


def word_branching(spark, d):
    """How the neighbours of each word of the templated questions branch."""
    return chunking.branching(staged(chunking.pairs(part_faqs(spark, d)), "word-pairs"))


def word_bonds(spark, d):
    """Neighbours in the conversations that hold together, with their normalised mutual information."""
    met = staged(chunking.pairs(table(spark, d, "conversations").select(F.lower("text").alias("normalized"))), "word-pairs")
    return chunking.bonds(met, staged(chunking.branching(met), "branching"))


def statistical_chunks(spark, d):
    """Chunks of the questions in coined words, by statistics alone."""
    found = chunking.statistical_chunks(coined_questions(spark, d))
    return found.select("q_id", "c", F.array_join("chunk", " ").alias("chunk"))


#: Verbs of the table, and frames of questions on parts with the words that stand in them; some are in no table, and two are no verbs.
LISTED = ("order", "return", "cancel", "buy")
VERB_FRAMES = (
    ("How do I {v} a {n}?", (*LISTED, "lease", "refurbish")), ("Can I {v} my {n} today?", (*LISTED, "lease", "refurbish")), ("They will {v} the {n}", ("lease", "refurbish", "swap")), ("We could {v} your {n}", ("lease", "refurbish", "swap")),
    ("You might {v} that {n}", ("lease", "swap", "acquire")), ("Let me {v} this {n}", ("refurbish", "swap", "acquire")), ("We may {v} one {n}", ("acquire", "swap", "haggle")), ("Where is the {v} {n}?", ("small", "zip")),
)


def verb_questions(spark: SparkSession, d: str) -> DataFrame:
    """``(q_id, question, normalized)``: templated questions on parts, with verbs that are in no table."""
    n = len(VERB_FRAMES)
    k, t = F.col("p_partkey"), F.col("p_partkey") % n
    q = F.lit(None).cast("string")
    for i, (frame, verbs) in enumerate(VERB_FRAMES):
        verb = F.element_at(F.array(*[F.lit(v) for v in verbs]), (F.floor(k / n) % len(verbs) + 1).cast("int"))
        head, tail = (F.replace(F.lit(x), F.lit("{n}"), F.col("p_name")) for x in frame.split("{v}"))
        q = F.when(t == i, F.concat(head, verb, tail)).otherwise(q)
    return table(spark, d, "part").select(k.alias("q_id"), q.alias("question"), text.normalize(q).alias("normalized"))


def bootstrapped_verbs(spark, d):
    """Verbs of the templated questions, from those of the table: some join because others did."""
    seeds = spark.createDataFrame([(v,) for v in LISTED], "word string")
    return chunking.bootstrapped_verbs(verb_questions(spark, d), seeds, rounds=4)


def ngrams_1_4(spark, d):
    g = text.ngrams_up_to(text.tokens(F.lower("text")))
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(g).alias("n"), F.md5(F.array_join(F.array_sort(g), LIST)).alias("grams_md5"))


def unigram_counts(spark, d):
    return shown_place(counts(spark, d).where("kind = 'unigram'").select("term", "cnt", "first_seen"))


def phrase_counts(spark, d):
    return shown_place(counts(spark, d).where("kind = 'phrase'").select("term", "cnt", "first_seen"))


def ranked_terms(spark, d):
    return shown_place(grams.ranked(grams.frequent(counts(spark, d))))


def subphrase_elimination(spark, d):
    return grams.without_subphrases(grams.frequent(counts(spark, d))).where("kind = 'phrase'").select("term", "cnt")


def merged_sort_keys(spark, d):
    return grams.sort_keys(counts(spark, d))


# --- assignment and optimiser ---------------------------------------------------------------------


def term_assignment(spark, d):
    return joined(assigned(spark, d))


def verb_tag(spark, d):
    return assigned(spark, d).where(F.size("tags") > 0).select(F.col("tags")[0].alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def path_groups(spark, d):
    return optimise.path_groups(assigned(spark, d)).select(F.array_join("path", PATH).alias("path"), "n")


def empty_node_to_tags(spark, d):
    return joined(optimise.empty_nodes_to_tags(staged(assigned(spark, d), "assigned")))


def collapse_thin_nodes(spark, d):
    return joined(optimise.collapse_thin_nodes(staged(assigned(spark, d), "assigned")))


def optimised_hand_paths(spark, d):
    return joined(optimise.optimise(hand_paths(spark)))


def optimised_graph(spark, d):
    return joined(optimise.optimise(assigned(spark, d)))


def export_faq_rows(spark, d):
    out = exported(spark, d)
    return out.select("q_id", "question", F.array_join("terms", PATH).alias("terms"), F.array_join("tags", LIST).alias("tags"), F.col("responseType").alias("response_type"), F.col("answer")[0]["text"].alias("answer"), F.size("alternateQuestions").cast("long").alias("n_alternates"))


def alternate_tags(spark, d):
    """The alternates as exported: their tags and the terms that their primary lacks, and the primary's terms."""
    out = exported(spark, d).select("q_id", F.inline("alternateQuestions"))
    return out.select("q_id", "question", F.array_join("tags", LIST).alias("tags"), F.array_join("terms", PATH).alias("terms"))


# --- tree and analyzer ----------------------------------------------------------------------------


def parse_term_syntax(spark, d):
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("**"), "p_name", F.lit("/"), "p_type", F.lit("/item: "), "p_brand")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit(" !!"), "p_name")).otherwise(F.concat("p_name", F.lit(" / "), "p_brand"))
    t = table(spark, d, "part").select("p_partkey", text.parse_term(raw).alias("t"))
    return t.select("p_partkey", "t.key", "t.name", "t.usage", "t.trait", F.array_join("t.synonyms", LIST).alias("synonyms"))


def _nodes(spark, d):
    return tree.nodes(geo_faqs(spark, d), geo_synonyms(spark, d), geo_unmapped(spark, d))


def tree_nodes(spark, d):
    n = _nodes(spark, d)
    return n.select("node_id", "parent_id", F.array_join("path", PATH).alias("path"), "depth", "name", "usage", F.array_join("synonyms", LIST).alias("synonyms"), "has_faq", "first_seen")


def tree_preorder(spark, d):
    n = tree.preorder(_nodes(spark, d))
    return n.select(F.array_join("path", PATH).alias("path"), F.array_join(F.col("preorder").cast("array<string>"), ",").alias("preorder"))


def node_questions(spark, d):
    n = tree.node_questions(geo_faqs(spark, d))
    return n.select("node_id", "faq_ord", "q_idx", "question", F.array_join("tags", LIST).alias("tags"))


def _issues(found):
    return found.select("error_type", F.array_join("path", PATH).alias("path"), "question", F.array_join("tags", LIST).alias("tags"))


def unreachable_questions(spark, d):
    return _issues(analyze.unreachable(geo_faqs(spark, d), (), geo_synonyms(spark, d), unmapped=geo_unmapped(spark, d)))


def questions_at_root(spark, d):
    return _issues(analyze.at_root(geo_faqs(spark, d)))


def _all_issues(spark, d, **limits):
    return analyze.issues(geo_faqs(spark, d), (), geo_synonyms(spark, d), geo_unmapped(spark, d), **limits)


def issue_report(spark, d):
    """The report's rows with what orders them: kind, walk, FAQ, question."""
    found = _all_issues(spark, d)
    rows = found.select("error_type", "question", F.array_join("path", ",").alias("path"), F.array_join("tags", ",").alias("tags"), F.lit("en").alias("language"), F.array_join(F.col("_walk").cast("array<string>"), ",").alias("walk"), F.col("_faq").alias("faq_ord"), F.col("_q").alias("q_idx"))
    return rows


def limited_report(spark, d):
    """At most ten issues of each kind, the first of the report."""
    return sinks.report_rows(_all_issues(spark, d, limits={k: 10 for k in analyze.KINDS})).drop("timestamp")


def issue_summary(spark, d):
    return analyze.summary(_all_issues(spark, d))


# --- synonyms -------------------------------------------------------------------------------------


def answer_corpus_dedup(spark, d):
    docs = table(spark, d, "documents")
    return synonyms.answer_corpus(docs, "doc_id", "text").select("doc_id", F.md5("text").alias("text_md5"))


def retrieve_words(spark, d):
    a = assigned(spark, d).withColumn("tags", F.concat("tags", F.array(F.lit("**pay/settle:due"), F.lit("!!misc*/{x"), F.lit('{"name":"fee/cost"}'))))
    a = a.withColumnRenamed("q_id", "ord").join(part_faqs(spark, d).select(F.col("q_id").alias("ord"), F.col("answer")[0]["text"].alias("answer")), "ord")
    return synonyms.retrieve_words(a)


def corpus_tokens(spark, d):
    t = synonyms.corpus_tokens("text")
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(t).cast("long").alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


def nearest_vectors_top3(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("word"), F.col("embedding").alias("vector"))
    asked = v.where(F.col("word").cast("long") % 20 == 0).select("word").unionByName(spark.createDataFrame([("unknown",)], "word string"))
    return synonyms.nearest(asked, v)


def merge_synonyms(spark, d):
    p = table(spark, d, "part")
    old = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").cast("string").alias("term"), F.array("p_type").alias("synonyms"))
    new = p.where("p_partkey % 3 = 0").select(F.col("p_partkey").cast("string").alias("term"), F.when(F.col("p_partkey") % 9 == 0, "").otherwise(F.concat("p_brand", F.lit("/ "), "p_type")).alias("synonyms"))
    return synonyms.merge_synonyms(old, new).select("term", F.array_join("synonyms", LIST).alias("synonyms"))


def word2vec_synonyms(spark, d):
    c = table(spark, d, "documents").where("lang = 'en'").select("text")
    words = staged(c.select(F.explode(synonyms.corpus_tokens("text")).alias("word")).distinct(), "words")
    return synonyms.suggestions(synonyms.nearest(words, synonyms.train_vectors(c, epochs=EPOCHS)))


QUERIES = {
    f.__name__: f
    for f in (
        optimised_graph, normalize_text, normalize_documents, noun_lemmas, lemmatized_questions, verb_phrases, segmented_documents, word_branching, word_bonds, statistical_chunks, bootstrapped_verbs, json_export_ids, limited_report, expand_contractions, single_word_tag, tokenize_stopfilter, analyzer_tokens, faq_ids_altmap, csv_export_ffill, faq_table_source, ngrams_1_4, unigram_counts,
        phrase_counts, ranked_terms, subphrase_elimination, merged_sort_keys, term_assignment, verb_tag, path_groups, empty_node_to_tags, collapse_thin_nodes, optimised_hand_paths, export_faq_rows, alternate_tags,
        parse_term_syntax, tree_nodes, tree_preorder, node_questions, unreachable_questions, questions_at_root, issue_report, issue_summary, answer_corpus_dedup, retrieve_words, corpus_tokens, nearest_vectors_top3,
        merge_synonyms, word2vec_synonyms,
    )
} | {"question_bigrams": _grams(2), "question_trigrams": _grams(3)}
