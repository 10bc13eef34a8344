import json
import random

import pytest
from pyspark.sql import functions as F

from topicloom.plans import pipeline
from topicloom.sources import documents, faq


@pytest.fixture
def small_ranges(spark):
    own = {"spark.sql.files.maxPartitionBytes": "701", "spark.sql.files.openCostInBytes": "1"}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k in own:
        spark.conf.unset(k)


def hostile(r: random.Random, most: int = 8) -> str:
    return "".join(r.choices(["a", "é", "日", " ", ",", '"', "\\", "\n", '","', "]},{[", '\\"', "word ", '":[{'], k=r.randint(0, most)))


def document(r: random.Random, n: int) -> dict:
    answer = lambda: [{"text": hostile(r), "type": "basic", "channel": "default"}]
    alt = lambda: {"question": hostile(r), "tags": [hostile(r)], "terms": []}
    one = lambda: {"question": hostile(r), "alternateQuestions": [alt() for _ in range(r.randint(0, 2))], "answer": answer(), "alternateAnswers": [answer()], "responseType": "message", "terms": [hostile(r)], "tags": []}
    faqs = [one() for _ in range(n)]
    if n > 10:
        faqs[7]["question"] = hostile(r, 400)  # over many ranges, which look like documents of their own
    return {
        "kgName": "a, [b", "synonyms": {f"{hostile(r)}{i}": [hostile(r)] * (i % 3) for i in range(n // 2)}, "none": [], "empty": {}, "faqs": faqs,
        "kgParams": {"lang": "en", "stopWords": ["it", "a,b"]}, "unmappedpath": [{"terms": [hostile(r), "R"]} for _ in range(n // 3)],
    }


def test_depth_and_strings():
    cases = {"": (False, 0), '{"a': (True, 1), '"a"': (False, 0), r'"a\"': (True, 0), r'"a\\"': (False, 0), "[{": (False, 2), '"{["]': (False, -1)}
    assert {c: documents.deepened(c, False) for c in cases} == cases
    assert documents.deepened('{"]', True) == (False, -1)


@pytest.mark.parametrize("size", range(1, 40, 3))
def test_cutting_anywhere_between_values(size):
    """Elements are the same wherever ranges begin: parts joined in order."""
    r = random.Random(size)
    doc = document(r, 12)
    body = json.dumps(doc, ensure_ascii=bool(size % 2), indent=2 if size % 3 else None)
    cuts, texts, inside, depth = body.split(","), [], False, 0
    for i in range(0, len(cuts), size):
        text = ("," if i else "") + ",".join(cuts[i : i + size])
        cutter = documents.Cutter(inside, depth)
        for at, section, t, whole in [*cutter.feed(text), *cutter.close()]:
            if at < 0:
                texts[-1][1] += t
            else:
                texts.append([section or texts[-1][0], t])
        inside, more = documents.deepened(text, inside)
        depth += more
    assert (inside, depth) == (False, 0)
    got = {k: [t for s, t in texts if s == k and t.strip()] for k in doc}
    assert [json.loads(t) for t in got["faqs"]] == doc["faqs"] and [json.loads(t) for t in got["unmappedpath"]] == doc["unmappedpath"]
    assert json.loads("{" + ",".join(got["synonyms"]) + "}") == doc["synonyms"] and not got["none"] and not got["empty"]


@pytest.mark.parametrize("indent", [None, 1])
def test_a_document_in_many_ranges_equals_one_row(spark, tmp_path, small_ranges, indent):
    doc = document(random.Random(4), 25)
    p = tmp_path / "g.json"
    p.write_text(json.dumps(doc, ensure_ascii=False, indent=indent))
    many, one = faq.read_elements(spark, str(p)), faq.read_json(spark, str(p))
    assert documents.pieces(spark, str(p), ",").select("b").distinct().count() > 10
    rows = lambda df: sorted(map(repr, df.drop("ord", "primary_ord").collect()))
    assert rows(faq.from_json(many)) == rows(faq.from_json(one))
    assert [x.question for x in faq.from_json(many).where("is_primary").orderBy("q_id").collect()] == [x["question"] for x in doc["faqs"]]
    for read in (faq.graph_synonyms, pipeline.graph_faqs, pipeline.graph_unmapped):
        assert rows(read(many)) == rows(read(one)) and read(many).count() > 0
    assert faq.json_stop_words(many) == faq.json_stop_words(one) and faq.analyzer_stop_words(many) == ["a,b", "it"]
    last = pipeline.graph_faqs(many).agg(F.max("ord")).first()[0]
    assert pipeline.graph_unmapped(many).agg(F.min("ord")).first()[0] > last


def test_documents_without_rows(spark, tmp_path):
    for i, body in enumerate(("", "{}", '{"faqs": [ ]}', '{"a": 1, "synonyms": {}}')):
        (tmp_path / f"{i}.json").write_text(body)
        assert faq.from_json(faq.read_elements(spark, str(tmp_path / f"{i}.json"))).collect() == []
    assert faq.read_elements(spark, str(tmp_path)).count() == 0 and faq.analyzer_stop_words(faq.read_elements(spark, str(tmp_path))) == []
