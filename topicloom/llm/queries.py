"""Queries over the driver's tables, one for each operator, and the SQL that states the same."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm import bpe, clusters, exact, licenses, merkle, minhash, packing, quality, shards, simhash, substrings, suffixes, vectors
from topicloom.llm.common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the licence that any of its units matches best; null and empty texts match none, repeated rows stand for themselves, ties go to the smaller name."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document, null and empty texts too. Rows without an id are scored and not held out; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that stay. Null texts have none; a repeated row equals the row that it repeats; a null id counts as the largest; an empty table gives no rows."""
    out = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with digests of its ids and of the bytes they decode to. Null counts as empty, repeated rows and null ids stay as they are, an empty table gives no rows."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ids = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, pattern).select("doc_id", "ids")
    both = bpe.decode(ids, ranks, pattern)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.digest(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its links and component. Vectors or labels that are null link with nothing; repeated ids are vectors of their own; an empty table gives no rows."""
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group. Null counts as empty; a group keeps its smallest id, a null one only without others; repeated rows count each; an empty table gives no rows."""
    return exact.groups(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place. A null or empty text is one piece of one id; repeated rows are packed each; an empty table gives no rows."""
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with fingerprint and component. Texts without words have fingerprint zero and are linked like others; null ids take part; an empty table gives no rows."""
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard and slot by the law of rows. Null texts count no bytes; repeated rows and null ids get slots of their own; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = shards.shuffle(rows, shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the bytes that stay, and their whole characters as ``text``. Null counts as empty; a repeated row is another place; rows of one id stand apart; an empty table gives no rows."""
    out = suffixes.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.col("kept_text").alias("text"))


LOWER = (string.ascii_uppercase, string.ascii_lowercase)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its leaf, subroot, root and proof, and whether its row, tampered with or not, leads to the root. Null ids come first and are not tampered with; repeated rows are leaves of their own; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    fields = lambda text: merkle.leaf(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], text)
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    own = fields(F.col("text")).alias("leaf")
    rows = docs.select("doc_id", "lang", own, F.when(hit, fields(F.translate("text", *LOWER))).alias("changed"))
    out = merkle.verified(merkle.manifest(rows, "lang", ["doc_id"]).withColumn("again", F.coalesce("changed", "leaf")))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and that of its edited text. Null texts count as empty; repeated rows follow each other; null ids come last; an empty table gives no rows."""
    place = F.struct("_metadata.file_path", "_metadata.row_index")
    near = minhash.neighbours(table(spark, sf_dir, "documents").withColumn("row", place), row="row")
    edited = near.withColumn("edited", F.concat("text_head", "next_head"))
    out = edited.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", minhash.fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint")
    likeness = lambda other: minhash.likeness(F.col("fingerprint"), F.col(other))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("edited_fingerprint").alias("near_edited"), likeness("next_fingerprint").alias("near_next"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of 64 finite components with its cluster. Other vectors, null ones too, give no row; repeated rows give one each; rows without an id start no cluster before others; an empty table gives no rows."""
    return clusters.cluster(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of ``corpus_pipeline`` over the whole table; what odd rows give stands with each stage."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_quality_classifier, op3_substring_dedup, op4_byte_bpe, op5_embedding_dedup, op6_exact_dedup, op7_best_fit_packing, op8_simhash_dedup, op9_sharding, op10_suffix_array_dedup, op11_merkle_manifest, op12_order_minhash, op13_centroid_clustering, pipeline)}

counted = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}, '-')"


def leaf(text: str) -> str:
    return f"sha256({' || '.join(map(counted, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


#: crc32 of the decimal doc_id, bit by bit, as a remainder in whole numbers.
CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
 lambda r, b: list_reduce(list_prepend(xor(r, b), range(8)), lambda x, _: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"""


def kmeans(rounds: int = 3) -> str:
    """The rounds one after the other; whole numbers stay exact in DOUBLE products below 2^53."""
    out = """WITH v AS (SELECT vec_id, row_number() OVER () i, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1 j, q c FROM v QUALIFY j < 16)"""
    for r in range(rounds + 1):
        out += f""", d{r} AS (SELECT vec_id, i, q, j, list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT d FROM v, c{r}),
a{r} AS (SELECT i, any_value(vec_id) vec_id, any_value(q) q, min(d) d, arg_min(j, d * 16 + j) j FROM d{r} GROUP BY i)"""
        if r < rounds:
            out += f""", s{r} AS (SELECT j, k, floor(sum(x) / count(*))::BIGINT x FROM (SELECT j, unnest(q) x, unnest(range(64)) k FROM a{r}) GROUP BY j, k),
c{r + 1} AS (SELECT c{r}.j, coalesce(n, c) c FROM c{r} LEFT JOIN (SELECT j, list(x ORDER BY k) n FROM s{r} GROUP BY j) m USING (j))"""
    return out + f""" SELECT vec_id, j::INT AS cluster, d distance, (sum(d) OVER (PARTITION BY j))::BIGINT cluster_inertia, (sum(d) OVER ())::BIGINT inertia, sha256(array_to_string(c, ',')) centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (j)"""


ORACLES = {
    "op1_license_scan": licenses.oracle(),
    "op3_substring_dedup": """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') ws FROM documents),
p AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') s FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 18)) i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) k FROM p) WHERE k > 1),
g AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 20)))) gone FROM r GROUP BY doc_id),
j AS (SELECT w.doc_id, ws, coalesce(gone, []) gone FROM w LEFT JOIN g ON w.doc_id = g.doc_id)
SELECT doc_id, len(ws)::BIGINT n_words, len(gone)::BIGINT n_removed,
  sha256(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(gone, i)), ' ')) kept_sha256 FROM j""",
    "op5_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, CASE WHEN label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN embedding::DOUBLE[] END e FROM embeddings),
l AS (SELECT a.vec_id a, b.vec_id b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) n FROM l GROUP BY a), m AS (SELECT a, min(b) b FROM r GROUP BY a)
SELECT vec_id, coalesce(n, 0) n_links, least(vec_id, coalesce(m.b, vec_id)) component_id, vec_id <= coalesce(m.b, vec_id) kept
FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN m ON m.a = vec_id""",
    "op6_exact_dedup": """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') s FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY s) keep_id, count(*) OVER (PARTITION BY s) group_size,
  doc_id = min(doc_id) OVER (PARTITION BY s) kept, sha256(s) text_sha256 FROM t""",
    "op10_suffix_array_dedup": """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) t FROM documents),
p AS (SELECT doc_id, i, md5(t[i:i + 399]) s FROM d, LATERAL (SELECT unnest(range(1, octet_length(t) - 398)) i)),
q AS (SELECT s FROM p GROUP BY s HAVING count(*) > 1),
x AS (SELECT doc_id, i, max(i + 400) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) e FROM p SEMI JOIN q USING (s)),
g AS (SELECT doc_id, i, sum(CASE WHEN e >= i THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) k FROM x),
r AS (SELECT doc_id, min(i) lo, max(i) + 400 hi FROM g GROUP BY doc_id, k),
c AS (SELECT doc_id, lo, hi, lag(hi, 1, 1) OVER (PARTITION BY doc_id ORDER BY lo) past FROM r),
y AS (SELECT doc_id, lo, hex(t[past:lo - 1]) x FROM c JOIN d USING (doc_id) UNION ALL SELECT doc_id, m, hex(t[m:]) FROM (SELECT doc_id, max(hi) m FROM r GROUP BY doc_id) JOIN d USING (doc_id)),
z AS (SELECT doc_id, lo, x, regexp_replace(regexp_replace(x, '^([89AB][0-9A-F])+', ''), '([CD][0-9A-F]|E[0-9A-F]([89AB][0-9A-F])?|F[0-9A-F]([89AB][0-9A-F]){0,2})$', '') e FROM y),
k AS (SELECT doc_id, string_agg(x, '' ORDER BY lo) k, string_agg(decode(unhex(e)), '' ORDER BY lo) kept FROM z GROUP BY doc_id),
h AS (SELECT doc_id, sum(hi - lo)::BIGINT n, count(*) m FROM r GROUP BY doc_id)
SELECT doc_id, octet_length(t)::BIGINT n_bytes, coalesce(n, 0) n_removed, coalesce(m, 0) n_spans, sha256(coalesce(unhex(k), t)) kept_sha256, coalesce(kept, decode(t)) AS text
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op11_merkle_manifest": f"""
WITH RECURSIVE l AS (SELECT doc_id, lang, {leaf("text")} leaf, CASE WHEN crc % 3 = 0 THEN {leaf(f"translate(text, '{LOWER[0]}', '{LOWER[1]}')")} ELSE {leaf("text")} END again
  FROM (SELECT *, {CRC} crc FROM documents)),
s AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 pos, count(*) OVER (PARTITION BY lang) n FROM l),
t(lang, lvl, pos, n, h) AS (SELECT lang, 0, pos, n, leaf FROM s UNION ALL SELECT lang, lvl + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY lang, lvl, pos // 8, n),
b AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 pos, count(*) OVER () n FROM t WHERE n = 1),
u(lvl, pos, n, h) AS (SELECT 0, pos, n, h FROM b UNION ALL SELECT lvl + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY lvl, pos // 8, n),
w AS (SELECT s.doc_id, s.lang, s.pos, t.lvl, coalesce(string_agg(o.h, '' ORDER BY o.pos) FILTER (o.pos < t.pos), '') lo, coalesce(string_agg(o.h, '' ORDER BY o.pos) FILTER (o.pos > t.pos), '') hi
  FROM s JOIN t ON t.lang IS NOT DISTINCT FROM s.lang AND t.n > 1 AND t.pos = s.pos // (8 ** t.lvl)::BIGINT JOIN t o ON o.lang IS NOT DISTINCT FROM t.lang AND o.lvl = t.lvl AND o.pos // 8 = t.pos // 8 GROUP BY ALL),
x AS (SELECT b.lang, u.lvl, coalesce(string_agg(o.h, '' ORDER BY o.pos) FILTER (o.pos < u.pos), '') lo, coalesce(string_agg(o.h, '' ORDER BY o.pos) FILTER (o.pos > u.pos), '') hi
  FROM b JOIN u ON u.n > 1 AND u.pos = b.pos // (8 ** u.lvl)::BIGINT JOIN u o ON o.lvl = u.lvl AND o.pos // 8 = u.pos // 8 GROUP BY b.lang, b.pos, u.lvl, u.pos),
p AS (SELECT lang, pos, list(lo || '|' || hi ORDER BY lvl) p FROM w GROUP BY lang, pos), q AS (SELECT lang, list(lo || '|' || hi ORDER BY lvl) q FROM x GROUP BY lang),
a AS (SELECT s.*, b.h subroot, (SELECT h FROM u WHERE n = 1) root, list_concat(coalesce(p, []), coalesce(q, [])) path FROM s JOIN b ON b.lang IS NOT DISTINCT FROM s.lang LEFT JOIN p ON p.lang IS NOT DISTINCT FROM s.lang AND p.pos = s.pos LEFT JOIN q ON q.lang IS NOT DISTINCT FROM s.lang),
f AS (SELECT *, list_reduce(list_prepend(again, path), lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2))) folded_root FROM a)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) proof_sha256, folded_root, folded_root = root verified FROM f""",
    "op13_centroid_clustering": kmeans(),
}
