import json

import pytest
from pyspark.sql import functions as F

from topicloom import queries
from topicloom.functions import lexicon, text
from topicloom.operators import analyze, assign, grams, lemmas, optimise, synonyms, tree
from topicloom.plans import pipeline
from topicloom.sources import faq, sinks


def one(spark, column, **values):
    return spark.range(1).select(column(*[F.lit(v) for v in values.values()]).alias("x")).first().x


def test_contractions(spark):
    get = lambda s: one(spark, text.expand_contractions, s=s)
    assert get("isn't it what's mine") == "is not it what is mine"
    assert get("can't won't i'd've") == "cannot will not i would have"
    assert get("the bank's price") == "the bank's price"


def test_normalize_keeps_letters_of_any_script(spark):
    assert one(spark, text.normalize, s="Héllo, wörld_1 — ok?") == "héllo wörld_1 ok "
    assert spark.range(1).select(text.normalize(F.lit("A, B?"), "de").alias("x")).first().x == "a, b?"


def test_single_word_tag(spark):
    f = lambda s: spark.range(1).select(text.single_word_tag(F.lit(s), ["what", "is"]).alias("x")).first().x
    assert f(" What is NEFT? ") == "neft"
    assert f("What is NEFT now?") is None


def test_ngrams_guard_short_inputs(spark):
    assert spark.range(1).select(text.ngrams(F.array(F.lit("a")), 2).alias("x")).first().x == []


def test_parse_term(spark):
    f = lambda s: spark.range(1).select(text.parse_term(F.lit(s)).alias("x")).first().x
    t = f(" **card/visa/amex: pay ")
    assert (t.key, t["name"], t.usage, t.trait, t.synonyms) == ("**card", "card", "mandatory", " pay", ["amex", "visa"])
    assert (f("card / visa ")["name"], f("card / visa ").synonyms) == ("card ", [" visa"])  # only the whole term is trimmed
    assert f("!!misc").usage == "organizer"
    assert f("a:b:c") is None


def test_assignment_golden(spark):
    rows = [("phrase", "saving account", 5, 1), ("unigram", "saving", 9, 2), ("unigram", "account", 8, 3), ("unigram", "open", 6, 4), ("verb", "open", 7, 5)]
    stats = spark.createDataFrame([(k, t, n, (i, 0, 0, 0)) for k, t, n, i in rows], f"kind string, term string, cnt long, first_seen {grams.PLACE}")
    q = spark.createDataFrame([(1, "How to open saving account?", "how to open saving account "), (2, "a a", "a a"), (3, None, None)], "q_id long, question string, normalized string")
    got = {r.q_id: (r.terms, r.tags) for r in assign.assign(q, stats, ["how", "to", "a"], "ROOT").collect()}
    assert got[1] == (["saving account", "open", "ROOT"], [])
    assert got[2] == (["ROOT"], [])
    assert got[3][1] == []


def test_optimiser_golden(spark):
    got = {r.q_id: (r.terms, r.tags) for r in optimise.optimise(queries.hand_paths(spark)).collect()}
    assert got == {1: (["c", "a", "R"], ["b"]), 2: (["R"], ["a"]), 3: (["d", "R"], []), 4: (["d", "R"], []), 5: (["R"], ["e", "f"])}


def test_tree_root_and_reports(spark):
    alt = "array<struct<question:string,tags:array<string>>>"
    rows = [(0, ["World"], [], "Where?", []), (1, ["card", "World"], [], "How does a card work?", [("what about it", [])]), (2, ["!!misc", "World"], ["fee"], "which fee", [("||no", [])])]
    f = spark.createDataFrame(rows, f"ord long, terms array<string>, tags array<string>, question string, alternates {alt}")
    n = {tuple(r.path): r for r in tree.nodes(f).collect()}
    assert n[("World", "card")].parent_id == n[("World",)].node_id and n[("World", "!!misc")].usage == "organizer"
    assert [r.question for r in analyze.unreachable(f).collect()] == ["what about it"]
    assert [r.question for r in analyze.at_root(f).collect()] == ["Where?"]
    assert analyze.summary(analyze.issues(f)).first().asDict() == {"errors": 1, "warnings": 0, "suggestions": 1, "total": 2}
    two = spark.createDataFrame([(0, ["a"], [], "q", []), (1, ["b"], [], "r", [])], f"ord long, terms array<string>, tags array<string>, question string, alternates {alt}")
    assert {r.terms[-1] for r in tree.with_root(two).collect()} == {tree.FALLBACK_ROOT}


def test_tree_keys_unmapped_paths_and_synonyms(spark):
    alt = "array<struct<question:string,tags:array<string>>>"
    rows = [(0, ["card/visa", "World"], ["fee/cost: x"], "visa?", []), (1, ["pin", "card / amex:t", " World "], [], "the pin of my amex", []), (2, ["pin", "card/amex", "World"], [], "where is the pin of my visa", [])]
    f = spark.createDataFrame([(a, [x.strip() if x == " World " else x for x in b], c, d, e) for a, b, c, d, e in rows], f"ord long, terms array<string>, tags array<string>, question string, alternates {alt}")
    unmapped = spark.createDataFrame([(3, ["card/late", "World"]), (4, ["empty", "card", "World"])], "ord long, terms array<string>")
    more = spark.createDataFrame([("card", ["plastic", "visa"])], "term string, synonyms array<string>")
    n = {tuple(r.path): r for r in tree.nodes(f, more, unmapped).collect()}
    assert {k: (r["name"], r.synonyms, r.has_faq, r.first_seen) for k, r in n.items()} == {
        ("World",): ("World", [], True, 0), ("World", "card"): ("card", ["plastic", "visa"], True, 0), ("World", "card "): ("card ", [" amex"], True, 1),
        ("World", "card ", "pin"): ("pin", [], True, 1), ("World", "card", "pin"): ("pin", [], True, 2), ("World", "card", "empty"): ("empty", [], False, 4),
    }
    assert [r.tags for r in tree.node_questions(f).where("faq_ord = 0").collect()] == [["fee"]]
    # the node's synonyms are those of the first row, so the last question is reached by visa and pin
    got = analyze.issues(f, (), more, unmapped)
    assert [(r.question, r.path) for r in got.orderBy(*analyze.ORDER).collect()] == []
    assert [r.question for r in analyze.unreachable(f, ["visa", "pin"], more).collect()] == ["visa?", "where is the pin of my visa"]


def test_report_order_header_and_limits(spark, tmp_path):
    alt = "array<struct<question:string,tags:array<string>>>"
    rows = [(5, ["b", "a", "R"], [], "five", []), (1, ["c", "R"], [], "one", [("one more", [])]), (2, ["R"], [], "two", []), (3, ["a", "R"], [], "three", []), (4, ["d", "c", "R"], [], "four", []), (6, ["R"], [], "six", [])]
    f = spark.createDataFrame(rows, f"ord long, terms array<string>, tags array<string>, question string, alternates {alt}")
    want = ["one", "one more", "four", "three", "five", "two", "six"]
    path = str(tmp_path / "report")
    for limits, some in ((None, want), ({"UnreachableQuestions": 2, "QuestionsAtRoot": 1}, ["one", "one more", "two"])):
        sinks.write_report(analyze.issues(f, limits=limits), path)
        assert [r.question for r in sinks.report_rows(analyze.issues(f, limits=limits)).collect()] == some
    cells = [x.split(",") for p in sorted((tmp_path / "report").glob("part*")) for x in p.read_text().splitlines()]
    assert sum(c == [*sinks.REPORT] for c in cells) == 1 and len(cells) == 1 + len(want) + 3
    assert cells[0] == [*sinks.REPORT] and [c[3] for c in cells[1:]] == [*want, "one", "one more", "two"]
    before = sorted(p.name for p in (tmp_path / "report").iterdir())
    for folder in ("report", "none"):
        sinks.write_report(analyze.issues(f.where("false")), str(tmp_path / folder))
    assert sorted(p.name for p in (tmp_path / "report").iterdir()) == before and [p.name for p in tmp_path.iterdir()] == ["report"]


def test_places_of_long_questions_and_large_ids(spark):
    many = " the ".join(f"w{i}" for i in range(150))
    q = spark.createDataFrame([(10**13, many), (10**13 + 1, "alpha beta alpha"), (2**63 - 1, "beta")], "q_id long, normalized string")
    got = {(r.kind, r.term): tuple(r.first_seen) for r in grams.count(grams.mine(q, ["the"])).collect()}
    assert got["unigram", "w149"] == (10**13, 149, 0, 0) and got["unigram", "alpha"] == (10**13 + 1, 0, 0, 0) and got["phrase", "beta alpha"] == (10**13 + 1, 0, 1, 1)
    ranks = {r.term: r.rnk for r in grams.ranked(grams.count(grams.mine(q, ["the"]))).where("kind = 'unigram'").collect()}
    assert sorted(ranks.values()) == [*range(1, 153)] and ranks["alpha"] == 1 and ranks["beta"] == 2 and ranks["w149"] == 152


def test_terms_next_to_marks_are_met(spark):
    q = spark.createDataFrame([(i, f"Wo ist mein Konto? Mein Sparkonto-{i}!") for i in range(8)], "q_id long, question string")
    q = q.withColumn("normalized", text.normalize(F.col("question"), "de"))
    got = assign.assign(q, grams.count(grams.mine(q, ["wo", "ist", "mein"], [])), ["wo", "ist", "mein"], "R").collect()
    assert len(got) == 8 and all(r.terms == ["sparkonto", "R"] for r in got)  # konto is a part of it
    r = assign.assign(q, grams.count(grams.mine(q.withColumn("normalized", F.lit("konto, geld")), [], [])), [], "R").first()
    assert r.terms == ["konto", "R"]


def test_lemmas_and_verbs(spark):
    v = spark.createDataFrame([(w,) for w in "account accounts box boxes wolf wolves bus glass news new keys city cities women children us its fusses".split()], "word string")
    got = {r.word: r.lemma for r in lemmas.noun_lemmas(v, ["its"]).collect()}
    assert got == {"accounts": "account", "boxes": "box", "wolves": "wolf", "cities": "city", "women": "woman", "children": "child"}
    q = spark.createDataFrame([(1, "my accounts and boxes"), (2, "account box"), (3, None)], "q_id long, normalized string")
    assert {r.q_id: r.normalized for r in lemmas.lemmatize(q, lemmas.noun_lemmas(lemmas.vocabulary(q))).collect()} == {1: "my account and box", 2: "account box", 3: None}
    t = lexicon.verb_table()
    assert {f: t.get(f) for f in ("paying", "stopped", "carries", "carried", "used", "switches", "bought", "making", "seeing", "showed")} == {"paying": "pay", "stopped": "stop", "carries": "carry", "carried": "carry", "used": "use", "switches": "switch", "bought": "buy", "making": "make", "seeing": "see", "showed": "show"}
    q = spark.createDataFrame([(1, "how quickly and safely paid only then they never really returned it early")], "q_id long, normalized string")
    assert [(r.i, r.term) for r in grams.tag_verbs(q, ["only", "then"], t).orderBy("i").collect()] == [(3, "safely"), (4, "pay"), (8, "never"), (9, "really"), (10, "return")]


def test_own_chunker_and_tagger(spark):
    import pyarrow as pa

    def chunker(questions):
        def cut(batches):
            for b in batches:
                ws = [x.split() for x in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([0] * len(ws), pa.int32()), pa.array([w[-2:] for w in ws], pa.list_(pa.string()))], ["q_id", "c", "chunk"])

        return questions.select("q_id", "normalized").mapInArrow(cut, "q_id bigint, c int, chunk array<string>")

    tagger = lambda q: q.select("q_id", F.lit(0).alias("i"), F.lit("do").alias("term"))
    q = spark.createDataFrame([(i, "do open the golden account", "do open the golden account") for i in range(8)], "q_id long, question string, normalized string")
    got = pipeline.build_graph(q, ["the"], chunker=chunker, tagger=tagger).collect()
    assert len(got) == 8 and all(r.terms == ["golden account", assign.ROOT] and r.tags == ["do"] for r in got)


def test_graph_stop_words_and_registries(spark, tmp_path):
    doc = {"faqs": [{"question": "is it a card", "terms": ["card/it", "R"], "tags": [], "alternateQuestions": [], "answer": []}], "unmappedpath": [{"terms": ["x", "R"]}], "kgParams": {"stopWords": ["it"]}}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    read = faq.read_json(spark, str(tmp_path / "g.json"))
    assert faq.analyzer_stop_words(read) == ["it"] and faq.analyzer_stop_words(read, "kk") == [] and "how" in faq.analyzer_stop_words(read, "en_kore")
    assert pipeline.graph_unmapped(read).collect() == [(1, ["x", "R"])] and pipeline.analyze_graph(read).count() == 0
    for lang in ("ar", "hi", "ja", "zh", "ko", "ms", "sv", "de"):
        assert len(lexicon.stop_words(lang)) > 20
    for call in (lambda: lexicon.stop_words("xx"), lambda: sinks.write("xml", read, None, "x"), lambda: pipeline.build_graph(read, [], "other")):
        with pytest.raises(ValueError):
            call()


def test_binary_vectors_and_zip_corpora(spark, tmp_path):
    import struct
    import zipfile

    rows = [(f"wörd{i}", [i / 7, -i, 0.5]) for i in range(300)]
    body = b"300 3\n" + b"".join(w.encode() + b" " + struct.pack("<3f", *v) + b"\n" * (i % 2) for i, (w, v) in enumerate(rows))
    (tmp_path / "v.bin").write_bytes(body)
    for found in (faq.read_vectors(spark, str(tmp_path / "v.bin")), faq.binary_vectors(spark, str(tmp_path / "v.bin"), block=64), faq.binary_vectors(spark, str(tmp_path / "v.bin"), block=1000, whole=10)):
        assert sorted((r.word, tuple(r.vector)) for r in found.collect()) == sorted((w, struct.unpack("<3f", struct.pack("<3f", *v))) for w, v in rows)
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("a.txt", "one\n\ntwo")
        z.writestr("in/b.txt", "three")
    assert sorted(r.text for r in faq.read_corpus(spark, str(tmp_path / "c.zip"), bytes.decode).collect()) == ["one", "three", "two"]


def test_word2vec_puts_words_of_like_contexts_together(spark):
    import random

    r = random.Random(2)
    rows = [(f"the {r.choice(['cat', 'dog'])} eats {r.choice(['meat', 'fish'])} at {r.choice(['noon', 'night'])}",) if i % 2 else (f"a {r.choice(['stone', 'rock'])} lies below {r.choice(['water', 'sand'])} since {r.choice(['ages', 'years'])}",) for i in range(800)]
    v = {x.word: x.vector for x in synonyms.train_vectors(spark.createDataFrame(rows, "text string"), size=16, epochs=25, partitions=1).collect()}
    assert len(v) == 19 and {len(x) for x in v.values()} == {16}

    def cos(a, b):
        dot = lambda x, y: sum(i * j for i, j in zip(x, y, strict=True))
        return dot(v[a], v[b]) / (dot(v[a], v[a]) * dot(v[b], v[b])) ** 0.5

    assert cos("cat", "dog") > max(cos("cat", "stone"), cos("cat", "rock")) and cos("stone", "rock") > max(cos("stone", "cat"), cos("stone", "dog"))


def test_programs(spark, tmp_path):
    import struct

    faqs = [{"question": "what is it", "terms": ["card", "R"], "tags": ["fee"], "alternateQuestions": [], "answer": [{"text": f"answer {i}"}]} for i in range(2)]
    (tmp_path / "g.json").write_text(json.dumps({"faqs": faqs, "synonyms": {}}))
    pipeline.main(["analyze", str(tmp_path / "g.json"), str(tmp_path / "report"), "--limit", "UnreachableQuestions=1"])
    assert sum(len(p.read_text().splitlines()) for p in (tmp_path / "report").glob("part*")) == 2
    words = ["card", "fee", "pin", "cost"]
    (tmp_path / "v.bin").write_bytes(b"4 2\n" + b"".join(w.encode() + b" " + struct.pack("<2f", *x) for w, x in zip(words, [(1, 0), (0, 1), (1, 0.1), (0.1, 1)], strict=True)))
    pipeline.main(["synonyms", str(tmp_path / "g.json"), str(tmp_path / "s"), "--vectors", str(tmp_path / "v.bin")])
    got = dict(x.split(",") for p in (tmp_path / "s").glob("part*") for x in p.read_text().splitlines())
    assert {w: s.split("/")[0] for w, s in got.items()} == {"card": "pin", "fee": "cost", "R": '""'}


def test_graph_document_is_one_json(spark, tmp_path):
    rows = [(i, f"q{i}", [{"text": "a", "type": "b", "channel": "c"}]) for i in range(40)]
    faqs = spark.createDataFrame(rows, f"q_id long, question string, answer array<{faq.ANSWER}>").repartition(7)
    syn = spark.createDataFrame([("t", ["x", 'y"']), ("u{}", [])], "term string, synonyms array<string>")
    for table, want in ((syn, {"t": ["x", 'y"'], "u{}": []}), (None, {})):
        sinks.write("json", faqs, table, str(tmp_path / "g"))
        doc = json.loads("".join(p.read_text() for p in sorted((tmp_path / "g").glob("part*"))))
        assert [x["question"] for x in doc["faqs"]] == [f"q{i}" for i in range(40)] and doc["synonyms"] == want


def test_csv_sources(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text('faq,,primary,"How, do I\npay?",By card\nfaq,,alternate,Paying?\n\nkgParams,,,,the,a\n')
    rows = faq.csv_rows(spark, str(p))
    assert [r.cells for r in rows.orderBy("row_no").collect()][2] == []
    got = faq.from_csv_export(rows).orderBy("q_id").collect()
    assert [(r.q_id, r.primary_id, r.is_primary) for r in got] == [(10001, 10001, True), (10002, 10001, False)]
    assert got[0].question == "How, do I\npay?" and got[0].answer[0].text == "By card"
    assert "the" in faq.csv_stop_words(rows) and "what" in faq.csv_stop_words(rows)
    (tmp_path / "y.csv").write_text("q1,a1\nq2\nq3,a3\n")
    plain = faq.csv_rows(spark, str(tmp_path / "y.csv"))
    assert faq.from_csv(plain).count() == 2 and faq.from_csv(plain, strict=True).count() == 1
    with pytest.raises(ValueError):
        faq.read(spark, "xml", "x")


def test_json_round_trip(spark, tmp_path):
    faqs = [{"question": f"How do I open account {i}?", "alternateQuestions": [{"question": f"Opening account {i}", "tags": [], "terms": []}], "answer": [{"text": f"a{i}", "type": "basic", "channel": "default"}], "responseType": "message"} for i in range(8)]
    p = tmp_path / "in.json"
    p.write_text(json.dumps({"faqs": faqs, "synonyms": {"account": ["acct"]}}))
    pipeline.main(["graph", str(p), str(tmp_path / "out")])
    doc = faq.read_json(spark, str(tmp_path / "out"))
    back = doc.first()
    assert len(back.faqs) == 8 and back.synonyms == {"account": ["acct"]} and all(x.terms[-1] == assign.ROOT for x in back.faqs)
    assert pipeline.analyze_graph(doc).columns[:4] == ["error_type", "path", "question", "tags"]
    sinks.write_report(pipeline.analyze_graph(doc), str(tmp_path / "report"))


def test_synonyms(spark, monkeypatch):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 1.0])], "word string, vector array<double>")
    got = synonyms.nearest(spark.createDataFrame([("a",), ("zz",)], "word string"), v, 1).collect()
    assert {(r.word, r.neighbor) for r in got} == {("a", "b"), ("zz", "")}
    few = [("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [3.0, 0.0]), ("d", [0.0, 0.0]), ("e", [1.0])]
    v = spark.createDataFrame([*few, ("f", None)], "word string, vector array<double>")
    for name in ("QUERY_BLOCK", "WORD_BLOCK", "LEAST_BLOCK"):
        monkeypatch.setattr(synonyms, name, 1)
    got = sorted((r.word, r["rank"], r.neighbor, r.similarity) for r in synonyms.nearest(v.select("word"), v, 2).collect())
    assert got == [("a", 1, "b", 1.0), ("a", 2, "c", 1.0), ("b", 1, "a", 1.0), ("b", 2, "c", 1.0), ("c", 1, "a", 1.0), ("c", 2, "b", 1.0), ("d", 1, "a", 0.0), ("d", 2, "b", 0.0), ("f", 1, "", 0.0)]
    old = spark.createDataFrame([("t", ["x"])], "term string, synonyms array<string>")
    new = spark.createDataFrame([("t", "x/ y"), ("u", "")], "term string, synonyms string")
    assert {r.term: r.synonyms for r in synonyms.merge_synonyms(old, new).collect()} == {"t": ["x", "x", "y"], "u": []}


def test_word2vec_gives_every_word_a_row(spark, monkeypatch):
    rows = [("en", "One rare word here"), ("en", "another, quite rare one"), ("en", None), ("fr", "mot")]
    monkeypatch.setattr(queries, "table", lambda s, d, name: {"documents": spark.createDataFrame(rows, "lang string, text string")}[name])
    asked, train = [], synonyms.train_vectors
    monkeypatch.setattr(synonyms, "train_vectors", lambda *a, **b: asked.append(train(*a, **b)) or asked[0])
    got = queries.word2vec_synonyms(spark, "").collect()
    assert sorted(r.word for r in got) == sorted({"one", "rare", "word", "here", "another", ",", "quite"})
    assert all(len(r.synonyms.split("/")) == 3 for r in got) and {len(r.vector) for r in asked[0].collect()} == {100}


def test_properties_on_part(spark):
    d = "/root/testdata/sf0.001"
    a = queries.assigned(spark, d).persist()
    o = optimise.optimise(a)
    bag = lambda df: {(r.q_id, tuple(sorted(r.terms + r.tags))) for r in df.collect()}
    assert bag(a) == bag(o)
    assert a.where(F.element_at("terms", -1) != assign.ROOT).isEmpty()
    docs = queries.part_faqs(spark, d).select("q_id", "normalized")
    assert a.join(docs, "q_id").where(F.exists("terms", lambda t: (t != assign.ROOT) & ~F.contains("normalized", t))).isEmpty()


def test_stream_equals_batch(spark, tmp_path):
    from topicloom.streaming import assignment

    d = "/root/testdata/sf0.001"
    stats = queries.counts(spark, d).persist()
    q = queries.part_faqs(spark, d).select("q_id", "question")
    q.write.parquet(str(tmp_path / "in"))
    got = []
    s = assignment.tag_stream(spark.readStream.schema(q.schema).parquet(str(tmp_path / "in")), stats, queries.STOP, lambda df, n: got.extend(df.collect()), str(tmp_path / "cp"))
    s.processAllAvailable()
    s.stop()
    assert {(r.q_id, tuple(r.terms)) for r in got} == {(r.q_id, tuple(r.terms)) for r in queries.assigned(spark, d).collect()}


def test_registry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
