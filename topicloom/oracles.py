"""The same queries as DuckDB SQL. Word tables and templates are shared with the code; formulas are not."""

from __future__ import annotations

from topicloom import queries as q
from topicloom.functions import lexicon
from topicloom.functions.text import ANALYZER_MARKS as marks, PRE_CLEAN

lit = lambda s: "'" + s.replace("'", "''") + "'"
listed = lambda words: ", ".join(lit(w) for w in words)
FORMS = lexicon.verb_table()
STOP, BOUND, VERBS = f"[{listed(q.STOP)}]", f"[{listed([*q.STOP, *FORMS])}]", f"[{listed(FORMS)}]"
BASES = "vf AS (SELECT * FROM (VALUES " + ", ".join(f"({lit(f)}, {lit(b)})" for f, b in FORMS.items()) + ") x(form, base))"


def contracted(x: str) -> str:
    for _ in range(2):
        for short, full in lexicon.CONTRACTIONS.items():
            x = f"regexp_replace({x}, {lit(chr(92) + 'b' + short + chr(92) + 'b')}, {lit(full)}, 'g')"
        for ending, full in lexicon.ENDINGS.items():
            x = f"regexp_replace({x}, {lit('([a-z])' + ending + chr(92) + 'b')}, {lit(chr(92) + '1' + full)}, 'g')"
        x = f"regexp_replace({x}, {lit(chr(92) + 'b(' + '|'.join(lexicon.IS_WORDS) + ')' + chr(39) + 's' + chr(92) + 'b')}, '\\1 is', 'g')"
    return x


norm = lambda x: f"regexp_replace({contracted(f'lower({x})')}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')"
toks = lambda x: f"list_filter(string_split_regex({x}, '\\s+'), lambda x: x <> '')"
stopped = lambda x: f"list_filter({x}, lambda x: NOT list_contains({STOP}, x))"
analyzed = lambda x: toks(f"translate({contracted(f'lower(regexp_replace({x}, {lit(PRE_CLEAN)}, {lit(" ")}, {lit("g")}))')}, {lit(marks)}, {lit(' ' * len(marks))})")
pad = lambda x: f"concat(' ', replace({x}, ' ', '  '), ' ')"

FAQ = """faq AS (SELECT p_partkey q_id, p_brand answer, CASE WHEN p_partkey % 4 = 0 THEN 'What''s the ' || p_type || ' price of the ' || p_name || '?'
 WHEN p_partkey % 4 = 2 AND p_type <> 'PROMO' THEN 'What is the ' || p_type || ' price?' WHEN p_partkey % 4 = 3 THEN 'Why isn''t ' || p_brand || ' available?'
 ELSE 'How do I order a ' || p_name || '?' END question FROM part)"""


def spoken(source: str) -> str:
    """``vb(q_id, i, term)``: bases of verbs, and of adverbs that lead to one, in ``source(q_id, w)``."""
    return f"""{BASES}, vk AS (SELECT q_id, w, array_to_string(list_transform(w, lambda x: CASE WHEN list_contains({VERBS}, x) THEN 'V'
 WHEN (list_contains([{listed(lexicon.ADVERBS)}], x) OR (length(x) > 4 AND ends_with(x, 'ly'))) AND NOT list_contains([{listed(lexicon.NO_ADVERBS)}], x) THEN 'A' ELSE 'x' END), '') kinds FROM {source}),
vi AS (SELECT q_id, (i - 1)::INT i, w[i] form FROM vk, LATERAL (SELECT unnest(range(1, len(w) + 1)) i) WHERE regexp_matches(substr(kinds, i), '^A*V')),
vb AS (SELECT q_id, i, coalesce(base, form) term FROM vi LEFT JOIN vf USING (form) WHERE length(coalesce(base, form)) > 1 AND NOT list_contains({STOP}, coalesce(base, form)))"""


CNT = f"""{FAQ}, norm AS (SELECT *, {norm('question')} normalized FROM faq), tok AS (SELECT *, {toks('normalized')} w FROM norm), {spoken('tok')},
ch AS (SELECT q_id, list_filter(list_transform(string_split(array_to_string(list_transform(w, lambda x: CASE WHEN list_contains({BOUND}, x) THEN '|' ELSE x END), ' '), '|'), lambda x: trim(x)), lambda x: x <> '') cs FROM tok),
cx AS (SELECT q_id, i - 1 c, string_split(cs[i], ' ') k FROM ch, LATERAL (SELECT unnest(range(1, len(cs) + 1)) i)),
occ AS (SELECT 'phrase' kind, array_to_string(k[i:i + 2], ' ') term, [q_id, c, 0, i - 1] ord FROM cx, LATERAL (SELECT unnest(range(1, len(k) - 1)) i)
 UNION ALL SELECT 'phrase', array_to_string(k[i:i + 1], ' '), [q_id, c, 1, i - 1] FROM cx, LATERAL (SELECT unnest(range(1, len(k))) i)
 UNION ALL SELECT 'unigram', k[i], [q_id, c, 0, i - 1] FROM cx, LATERAL (SELECT unnest(range(1, len(k) + 1)) i) WHERE length(k[i]) > 1
 UNION ALL SELECT 'verb', term, [q_id, 0, 0, i] FROM vb),
cnt AS (SELECT kind, term, count(*) cnt, min(ord) first_seen FROM occ GROUP BY kind, term),
freq AS (SELECT * FROM cnt WHERE cnt > CASE kind WHEN 'phrase' THEN 2 WHEN 'unigram' THEN 5 ELSE 1 END),
thin AS (SELECT * FROM freq a WHERE kind <> 'phrase' OR NOT EXISTS (SELECT 1 FROM freq b WHERE b.kind = 'phrase' AND b.cnt = a.cnt AND b.term <> a.term AND contains(b.term, a.term)))"""
rank = "CASE kind WHEN 'verb' THEN 3 WHEN 'unigram' THEN 2 ELSE 1 END"
ASG = f"""{CNT}, keys AS (SELECT term, arg_max(cnt, {rank}) sort_cnt FROM (SELECT * FROM cnt WHERE kind = 'verb' UNION ALL SELECT * FROM thin WHERE kind <> 'verb') GROUP BY term),
terms AS (SELECT term, CASE kind WHEN 'phrase' THEN 0 WHEN 'unigram' THEN 1 ELSE 2 END k, cnt, first_seen, sort_cnt FROM thin JOIN keys USING (term) WHERE kind = 'verb' OR NOT list_contains({STOP}, term)),
docs AS (SELECT q_id, question, {pad("array_to_string(w, ' ')")} d FROM tok),
cand AS (SELECT q_id, list(term ORDER BY k, cnt DESC, first_seen) ts FROM docs JOIN terms ON contains(d, {pad('term')}) WHERE k < 2 GROUP BY q_id),
st AS (SELECT docs.q_id, question, list_reduce(list_prepend(d || '|', coalesce(ts, [])), lambda acc, t: CASE WHEN contains(split_part(acc, '|', 1), {pad('t')})
 THEN replace(split_part(acc, '|', 1), {pad('t')}, ' ~~~~ ') || '|' || split_part(acc, '|', 2) || t || ';' ELSE acc END) s FROM docs LEFT JOIN cand USING (q_id)),
fold AS (SELECT q_id, question, split_part(s, '|', 1) d, list_filter(string_split(split_part(s, '|', 2), ';'), lambda x: x <> '') h FROM st),
vt AS (SELECT q_id, last(term ORDER BY cnt DESC, first_seen) v FROM fold JOIN terms ON k = 2 AND contains(d, {pad('term')}) GROUP BY q_id),
sw AS (SELECT q_id, list_filter(list_distinct({toks("lower(regexp_replace(trim(question), '[?]$', ''))")}), lambda x: NOT list_contains({STOP}, x)) l FROM fold),
hit AS (SELECT q_id, h, i, h[i] t FROM fold, LATERAL (SELECT unnest(range(1, len(h) + 1)) i)),
own AS (SELECT q_id, list(t ORDER BY sort_cnt, i) ts FROM hit JOIN keys ON t = term WHERE len(list_filter(h, lambda u: u <> t AND contains(u, t))) = 0 GROUP BY q_id),
asg AS (SELECT fold.q_id, list_append(coalesce(ts, []), 'Auto Ontology') terms, CASE WHEN v IS NOT NULL THEN [v] WHEN len(h) = 0 AND len(l) = 1 THEN l ELSE [] END tags
 FROM fold LEFT JOIN own USING (q_id) LEFT JOIN vt USING (q_id) LEFT JOIN sw USING (q_id))"""


def pruned(source: str, to: str) -> str:
    """Empty inner nodes to tags."""
    return f"""{to}_p AS (SELECT q_id, list_reverse(terms) p, tags FROM {source}),
{to}_m AS (SELECT q_id, i, p[i] t FROM {to}_p a, LATERAL (SELECT unnest(range(2, len(p))) i) WHERE NOT EXISTS (SELECT 1 FROM {to}_p b WHERE b.p = a.p[1:i])),
{to}_g AS (SELECT q_id, list(i) gone, list(t ORDER BY i DESC) gt FROM {to}_m GROUP BY q_id),
{to} AS (SELECT a.q_id, list_reverse(list_filter(p, lambda x, i: NOT list_contains(coalesce(gone, []), i))) terms, list_concat(tags, coalesce(gt, [])) tags FROM {to}_p a LEFT JOIN {to}_g USING (q_id))"""


def thinned(source: str, to: str) -> str:
    return f"""{to} AS (SELECT q_id, CASE WHEN len(terms) = 2 AND n < 2 THEN terms[2:2] ELSE terms END terms, CASE WHEN len(terms) = 2 AND n < 2 THEN list_append(tags, terms[1]) ELSE tags END tags
 FROM (SELECT *, count(*) OVER (PARTITION BY terms) n FROM {source}))"""


out = lambda s: f"SELECT q_id, array_to_string(terms, '>') terms, array_to_string(tags, '|') tags FROM {s}"
OPT = f"{ASG}, {pruned('asg', 'o2')}, {thinned('o2', 'opt')}"
HAND = "hand AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, [{listed(t)}], []::VARCHAR[])" for i, t in q.HAND_PATHS) + ") x(q_id, terms, tags))"

PAIR = f"{ASG}, prime AS (SELECT * FROM asg WHERE q_id % 2 = 0), {pruned('prime', 'o2')}, {thinned('o2', 'opt')}"


def LEMMAS(source: str) -> str:
    """``lem(word, lemma)`` of the words of ``source(word)``."""
    ruled = " UNION ALL ".join(f"SELECT word, {i} i, left(word, length(word) - {len(end)}) || {lit(new)} lemma FROM {source} WHERE ends_with(word, {lit(end)}) AND length(word) > {max(3, len(end))}" for i, (end, new) in enumerate(lexicon.NOUN_ENDINGS))
    odd = ", ".join(f"({lit(a)}, {lit(b)})" for a, b in lexicon.NOUN_FORMS.items())
    fixed = f"[{listed([*q.STOP, *lexicon.NO_PLURALS])}]"
    return f""", cand AS ({ruled}), odd AS (SELECT * FROM (VALUES {odd}) x(word, lemma)),
lem AS (SELECT word, arg_min(lemma, i) lemma FROM cand WHERE lemma IN (SELECT word FROM {source}) AND word NOT IN (SELECT word FROM odd) AND NOT ends_with(word, 'ss') AND NOT list_contains({fixed}, word) GROUP BY word
 UNION ALL SELECT word, lemma FROM odd JOIN {source} USING (word) WHERE lemma <> word AND NOT list_contains({fixed}, word))"""


CONV = """turns AS (SELECT *, lead(role) OVER w nx, lead(text) OVER w reply FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
f1 AS (SELECT *, min(CASE WHEN nx = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) f FROM turns WHERE role = 'user')"""

key = lambda t: f"regexp_replace(trim({t}), '[/:].*$', '')"
bare = lambda t: f"regexp_replace({key(t)}, '^(\\*\\*|!!)', '')"
GEO = f"""n AS (SELECT n_nationkey::BIGINT k, n_name nm, lower(n_name) low, r_name r FROM nation JOIN region ON n_regionkey = r_regionkey),
seg AS (SELECT DISTINCT c_nationkey::BIGINT k, c_mktsegment s FROM customer),
geo AS (SELECT k * 1000 + ascii(s) ord, [' World ', r, CASE k % 3 WHEN 0 THEN '**' || nm || CASE WHEN ascii(s) % 2 = 0 THEN '/land:geo' ELSE ' / state /land' END WHEN 1 THEN '!!' || nm ELSE nm END, s] p, CASE WHEN k % 4 = 0 THEN [lower(r)] ELSE [] END tags, 'Which ' || lower(s) || ' offers are in ' || low || '?' question FROM n JOIN seg USING (k)
 UNION ALL SELECT k * 1000, [' World ', r, CASE k % 3 WHEN 0 THEN '**' || nm || '/country' WHEN 1 THEN '!!' || nm ELSE nm END], [], 'Where''s ' || low || '?' FROM n WHERE k % 5 = 0 UNION ALL SELECT -1, [' World '], [], 'Where are you?'),
line AS (SELECT ord, p, true f FROM geo UNION ALL SELECT 1000000 + k, [' World ', CASE WHEN k % 3 = 0 THEN r ELSE 'Nowhere' END, nm || CASE WHEN k % 4 = 0 THEN '/left' ELSE '' END], false FROM n WHERE k % 2 = 0),
pre AS (SELECT list_transform(p[1:i], lambda t: {key('t')}) path, min(ord) first_seen, arg_min(f, ord) OR len(any_value(p[1:i])) = 1 has_faq, arg_min(p[i], ord) raw FROM line, LATERAL (SELECT unnest(range(1, len(p) + 1)) i) GROUP BY 1),
nd AS (SELECT path, first_seen, has_faq, {bare('raw')} AS name, CASE WHEN starts_with(trim(raw), '**') THEN 'mandatory' WHEN starts_with(trim(raw), '!!') THEN 'organizer' ELSE 'default' END usage,
 list_sort(list_distinct(list_concat(string_split(string_split(trim(raw), ':')[1], '/')[2:], CASE WHEN r_name IS NULL THEN [] ELSE [lower(r_name) || ' area', 'region'] END))) syn FROM pre LEFT JOIN region ON r_name = {bare('raw')}),
nq AS (SELECT list_transform(p, lambda t: {key('t')}) path, ord faq_ord, 0 q_idx, question, tags FROM geo UNION ALL SELECT list_transform(p, lambda t: {key('t')}), ord, 1, 'Tell me more about it', [] FROM geo)"""
node = lambda p: f"sha256(array_to_string({p}, chr(1)))"
plain = lambda x: f"array_to_string({analyzed(x)}, ' ')"
UNR = f"""{GEO}, ups AS (SELECT a.path, list(b.name ORDER BY len(b.path)) names, string_agg(b.first_seen, ',' ORDER BY len(b.path)) walk, coalesce(list({plain('b.name')}) FILTER (WHERE b.usage <> 'organizer' AND len(b.path) > 1), []) own,
 coalesce(flatten(list(list_transform(b.syn, lambda t: {plain('t')})) FILTER (WHERE b.usage <> 'organizer')), []) extra FROM nd a JOIN nd b ON b.path = a.path[1:len(b.path)] AND len(b.path) <= len(a.path) GROUP BY a.path),
x AS (SELECT *, {analyzed('question')} w FROM nq JOIN ups USING (path)),
y AS (SELECT *, list_distinct(list_concat(own, tags)) P, list_filter(list_distinct(list_concat(own, extra, tags)), lambda t: t <> '') C,
 flatten(list_transform([1, 2, 3, 4], lambda m: list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' ')))) g FROM x),
bad AS (SELECT 'UnreachableQuestions' error_type, names path, question, tags, walk, faq_ord, q_idx FROM y WHERE len(C) > 0 AND len(P) > 0 AND NOT ceil(len(list_intersect(C, g)) / len(P) * 100) >= 50),
top AS (SELECT 'QuestionsAtRoot' error_type, []::VARCHAR[] path, question, tags, '' walk, faq_ord, q_idx FROM nq WHERE len(path) = 1 AND len(tags) = 0), iss AS (SELECT * FROM bad UNION ALL SELECT * FROM top)"""
shown = lambda s: f"SELECT error_type, array_to_string(path, '>') path, question, array_to_string(tags, '|') tags FROM {s}"


def branched(source: str) -> str:
    """``pr(a, b, n)`` of the word lists ``w`` of ``source``, where marks are empty words, and ``br``, the branching of words."""
    return f"""pr AS (SELECT a, b, count(*) n FROM (SELECT CASE WHEN i > 0 THEN w[i] ELSE '' END a, CASE WHEN i < len(w) THEN w[i + 1] ELSE '' END b FROM {source}, LATERAL (SELECT unnest(range(len(w) + 1)) i)) WHERE a <> '' OR b <> '' GROUP BY a, b),
br AS (SELECT * FROM (SELECT b word, sum(n)::BIGINT n, round(1000 * (log2(sum(n)) - sum(n * log2(n)) / sum(n)))::BIGINT left_bits FROM pr WHERE b <> '' GROUP BY b)
 JOIN (SELECT a word, round(1000 * (log2(sum(n)) - sum(n * log2(n)) / sum(n)))::BIGINT right_bits FROM pr WHERE a <> '' GROUP BY a) USING (word))"""


def bonded(hub: int) -> str:
    return f"""al AS (SELECT sum(n) z FROM pr), bo AS (SELECT * FROM (SELECT pr.a, pr.b, CASE WHEN pr.n >= z THEN 1000 ELSE round(1000 * ln(pr.n / x.n * z / y.n) / ln(z / pr.n))::BIGINT END npmi
 FROM pr JOIN br x ON x.word = a JOIN br y ON y.word = b, al WHERE pr.n >= 3 AND least(x.left_bits, x.right_bits) < {hub} AND least(y.left_bits, y.right_bits) < {hub}) WHERE npmi >= 100)"""


coined = lambda n: f"[{listed(q.COINED)}][p_partkey // {n} % {len(q.COINED)} + 1]"


def bootstrapped(rounds: int) -> str:
    out = f"v0 AS (SELECT DISTINCT word, 0 AS round FROM fr WHERE word IN ({listed(q.LISTED)}))"
    for r in range(1, rounds + 1):
        out += f""", g{r} AS (SELECT l, r FROM fr GROUP BY l, r HAVING sum(CASE WHEN word IN (SELECT word FROM v{r - 1}) THEN n ELSE 0 END) * 100 >= sum(n) * 60 AND count(*) FILTER (word IN (SELECT word FROM v{r - 1})) >= 2),
v{r} AS (SELECT * FROM v{r - 1} UNION ALL SELECT word, {r} FROM fr LEFT JOIN (SELECT *, 1 k FROM g{r}) USING (l, r) WHERE word NOT IN (SELECT word FROM v{r - 1}) GROUP BY word HAVING sum(n * coalesce(k, 0)) * 100 >= sum(n) * 20 AND count(k) >= 2)"""
    return out


def grams_of(n: int) -> str:
    return f"WITH w AS (SELECT {stopped(toks(norm('text')))} w FROM conversations) SELECT array_to_string(w[i:i + {n - 1}], ' ') term, count(*) cnt FROM w, LATERAL (SELECT unnest(range(1, len(w) - {n - 2})) i) GROUP BY 1 HAVING count(*) > 2"


ORACLES = {
    "normalize_text": f"SELECT conv_id, turn, {norm('text')} normalized FROM conversations",
    "normalize_documents": f"SELECT doc_id, md5({norm("coalesce(text, '')")}) normalized_md5 FROM documents",
    "expand_contractions": f"WITH {FAQ} SELECT q_id, {contracted('lower(question)')} expanded FROM faq",
    "single_word_tag": f"""WITH o AS (SELECT o_orderkey, 'What is the ' || regexp_replace(o_orderpriority, '^[0-9]-', '') || '? ' t FROM orders),
 l AS (SELECT o_orderkey, list_filter(list_distinct({toks("lower(regexp_replace(trim(t), '[?]$', ''))")}), lambda x: NOT list_contains({STOP}, x)) l FROM o) SELECT o_orderkey, CASE WHEN len(l) = 1 THEN l[1] END tag FROM l""",
    "tokenize_stopfilter": f"SELECT conv_id, turn, array_to_string(list_filter({stopped(toks(norm('text')))}, lambda x: length(x) > 1), ' ') words FROM conversations",
    "analyzer_tokens": f"WITH {FAQ} SELECT q_id, {plain('question')} words FROM faq",
    "faq_ids_altmap": f"WITH {CONV}, i AS (SELECT *, 10000 + row_number() OVER (ORDER BY conv_id, turn) q_id FROM f1 WHERE turn >= f) SELECT q_id, min(q_id) OVER (PARTITION BY conv_id) primary_id, md5(text) question_md5, md5(CASE WHEN turn = f THEN reply END) answer_md5 FROM i",
    "csv_export_ffill": f"WITH r AS (SELECT conv_id * {q.TURNS} + turn AS row_no, CASE WHEN turn = 0 THEN 'primary' ELSE 'alternate' END AS kind, text AS question FROM conversations WHERE role = 'user') SELECT row_no, kind, question, max(CASE WHEN kind = 'primary' THEN row_no END) OVER (ORDER BY row_no) AS primary_row FROM r",
    "faq_table_source": f"WITH {FAQ} SELECT q_id, question, {norm('question')} normalized, answer FROM faq",
    "ngrams_1_4": f"WITH w AS (SELECT conv_id, turn, {toks('lower(text)')} w FROM conversations), g AS (SELECT conv_id, turn, flatten(list_transform([1, 2, 3, 4], lambda m: list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' ')))) g FROM w) SELECT conv_id, turn, len(g) n, md5(array_to_string(list_sort(g), '|')) grams_md5 FROM g",
    "question_bigrams": grams_of(2),
    "question_trigrams": grams_of(3),
    "unigram_counts": f"WITH {CNT} SELECT term, cnt, array_to_string(first_seen, ':') first_seen FROM cnt WHERE kind = 'unigram'",
    "phrase_counts": f"WITH {CNT} SELECT term, cnt, array_to_string(first_seen, ':') first_seen FROM cnt WHERE kind = 'phrase'",
    "ranked_terms": f"WITH {CNT} SELECT kind, term, cnt, array_to_string(first_seen, ':') first_seen, row_number() OVER (PARTITION BY kind ORDER BY cnt DESC, first_seen) rnk FROM freq",
    "subphrase_elimination": f"WITH {CNT} SELECT term, cnt FROM thin WHERE kind = 'phrase'",
    "merged_sort_keys": f"WITH {CNT} SELECT term, arg_max(cnt, {rank}) sort_cnt FROM cnt GROUP BY term",
    "term_assignment": f"WITH {ASG} {out('asg')}",
    "verb_tag": f"WITH {ASG} SELECT tags[1] tag, count(*) n FROM asg WHERE len(tags) > 0 GROUP BY 1",
    "path_groups": f"WITH {ASG} SELECT array_to_string(list_reverse(terms), '>') path, count(*) n FROM asg GROUP BY terms",
    "empty_node_to_tags": f"WITH {ASG}, {pruned('asg', 'o2')} {out('o2')}",
    "collapse_thin_nodes": f"WITH {ASG}, {thinned('asg', 'o4')} {out('o4')}",
    "optimised_hand_paths": f"WITH {HAND}, {pruned('hand', 'o2')}, {thinned('o2', 'opt')} {out('opt')}",
    "optimised_graph": f"WITH {OPT} {out('opt')}",
    "export_faq_rows": f"WITH {PAIR} SELECT q_id, question, array_to_string(terms, '>') terms, array_to_string(tags, '|') tags, 'message' response_type, answer, (q_id + 1 IN (SELECT q_id FROM faq))::BIGINT n_alternates FROM opt JOIN faq USING (q_id)",
    "alternate_tags": f"WITH {PAIR} SELECT p.q_id, question, array_to_string(list_concat(a.tags, list_sort(list_distinct(list_filter(a.terms, lambda t: NOT list_contains(p.terms, t))))), '|') tags, array_to_string(p.terms, '>') terms FROM asg a JOIN opt p ON a.q_id = p.q_id + 1 JOIN faq ON faq.q_id = a.q_id",
    "noun_lemmas": f"""WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+|[^\\s\\p{{L}}\\p{{N}}_]')) word FROM documents WHERE lang = 'en') {LEMMAS('v')} SELECT * FROM lem""",
    "lemmatized_questions": f"""WITH a AS (SELECT p_partkey q_id, {norm("CASE WHEN p_partkey % 2 = 0 THEN 'which ' || replace(p_name, ' ', 's ') || ' and ' || lower(p_type) || 's have addresses, boxes, keys or children? A box, a key' ELSE p_name || ' ' || p_type END")} s FROM part),
t AS (SELECT q_id, {toks('s')} w FROM a), v AS (SELECT DISTINCT unnest(w) word FROM t) {LEMMAS('v')}, e AS (SELECT q_id, i, w[i] word FROM t, LATERAL (SELECT unnest(range(1, len(w) + 1)) i))
SELECT q_id, string_agg(coalesce(lemma, word), ' ' ORDER BY i) lemmas FROM e LEFT JOIN lem USING (word) GROUP BY q_id""",
    "verb_phrases": f"""WITH a AS (SELECT p_partkey q_id, p_name n, p_partkey % 6 k FROM part), t AS (SELECT q_id, {toks(norm("CASE k " + " ".join(f"WHEN {i} THEN concat({x})" for i, x in enumerate(q.VERB_TEMPLATES)) + " END"))} w FROM a), {spoken('t')} SELECT * FROM vb""",
    "segmented_documents": f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(lower(text), ''), '[^\\p{{L}}]+'), lambda x: x <> '') ws FROM documents),
r AS (SELECT run, count(*) n FROM (SELECT unnest(ws) run FROM w) GROUP BY run),
c AS (FROM (SELECT substr(run, i, m) word, sum(n) cnt FROM r, range(1, {q.UNIT} + 1) t(m), LATERAL (SELECT unnest(range(1, length(run) - m + 2)) i) GROUP BY 1) WHERE cnt >= 20 OR length(word) = 1),
z AS (SELECT sum(cnt) z FROM c WHERE length(word) = 1),
m AS (SELECT word, greatest(1, least(round(ln(z / cnt) * 1000)::INT, 39999)) cost FROM (FROM c ORDER BY length(word) = 1 DESC, cnt * length(word) DESC, word LIMIT {q.UNITS}), z),
e AS (SELECT run, i + k - 1 j, k, cost FROM r, range(1, {q.UNIT} + 1) t(k), LATERAL (SELECT unnest(range(1, length(run) - k + 2)) i) JOIN m ON word = substr(run, i, k)
 UNION ALL SELECT run, i, 1, 40000 FROM r, LATERAL (SELECT unnest(range(1, length(run) + 1)) i) WHERE substr(run, i, 1) NOT IN (SELECT word FROM m)),
v AS (SELECT run, 0 j, [0]::INT[] best, []::INT[] back FROM r UNION ALL
 SELECT v.run, v.j + 1, list_append(any_value(best), min(best[e.j - e.k + 1] + cost)::INT), list_append(any_value(back), arg_min(k, (best[e.j - e.k + 1] + cost) * 100 - k)::INT) FROM v JOIN e ON e.run = v.run AND e.j = v.j + 1 GROUP BY v.run, v.j),
b AS (SELECT run, length(run)::INT t, back, []::VARCHAR[] ws FROM v WHERE j = length(run) UNION ALL SELECT run, t - back[t], back, list_prepend(substr(run, t - back[t] + 1, back[t]), ws) FROM b WHERE t > 0),
u AS (SELECT run, ws FROM b WHERE t = 0),
o AS (SELECT doc_id, unnest(ws) run, unnest(range(len(ws))) i FROM w),
g AS (SELECT doc_id, sum(len(u.ws))::BIGINT n, string_agg(array_to_string(u.ws, ' '), ' ' ORDER BY i) s FROM o JOIN u USING (run) GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) n_units, md5(coalesce(s, '')) units_md5 FROM w LEFT JOIN g USING (doc_id)""",
    "word_branching": f"WITH {FAQ}, t AS (SELECT {toks(norm('question'))} w FROM faq), {branched('t')} SELECT word, n, left_bits, right_bits FROM br",
    "word_bonds": f"""WITH t AS (SELECT list_transform(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+|[^\\s\\p{{L}}\\p{{N}}_]'), lambda x: CASE WHEN regexp_matches(x, '[\\p{{L}}\\p{{N}}_]') THEN x ELSE '' END) w FROM conversations WHERE text IS NOT NULL),
{branched('t')}, {bonded(4000)} SELECT * FROM bo""",
    "statistical_chunks": f"""WITH t AS (SELECT p_partkey q_id, [{coined(1)}, 'unit' || p_brand[7:], 'frame' || p_brand[7:], {coined(6)}, 'grade' || p_size, 'steel' || p_size, {coined(36)}] w FROM part), {branched('t')}, {bonded(4000)},
e AS (SELECT q_id, i, w[i] b, (w[i - 1], w[i]) IN (SELECT (a, b) FROM bo) tied FROM t, LATERAL (SELECT unnest(range(1, len(w) + 1)) i) WHERE w[i] NOT IN (SELECT word FROM br WHERE least(left_bits, right_bits) >= 4000)),
c AS (SELECT q_id, i, b, sum(CASE WHEN tied THEN 0 ELSE 1 END) OVER (PARTITION BY q_id ORDER BY i) - 1 c FROM e) SELECT q_id, c::INT c, string_agg(b, ' ' ORDER BY i) chunk FROM c GROUP BY q_id, c""",
    "bootstrapped_verbs": f"""WITH p AS (SELECT p_partkey k, p_name n FROM part), a AS (SELECT k, CASE k % {len(q.VERB_FRAMES)} {' '.join(f"WHEN {i} THEN replace(replace({lit(f)}, '{{v}}', [{listed(v)}][k // {len(q.VERB_FRAMES)} % {len(v)} + 1]), '{{n}}', n)" for i, (f, v) in enumerate(q.VERB_FRAMES))} END question FROM p),
t AS (SELECT {toks(norm('question'))} w FROM a), fr AS (SELECT w[i] word, CASE WHEN i > 1 THEN w[i - 1] ELSE '' END l, coalesce(w[i + 1], '') r, count(*) n FROM t, LATERAL (SELECT unnest(range(1, len(w) + 1)) i) GROUP BY 1, 2, 3),
{bootstrapped(4)} SELECT * FROM v4""",
    "json_export_ids": f"""WITH n AS (SELECT n_nationkey k, n_name nm, r_name r FROM nation JOIN region ON n_regionkey = r_regionkey),
a AS (SELECT k, 0 i, 'Where is ' || nm || '?' question, CASE WHEN k % 2 = 0 THEN 'dialog' END response_type FROM n UNION ALL SELECT k, 1, CASE k % 3 WHEN 0 THEN 'Tell me about ' || nm ELSE r END, NULL FROM n WHERE k % 3 < 2 UNION ALL SELECT k, 2, 'What''s ' || r, NULL FROM n WHERE k % 3 = 0),
b AS (SELECT *, 10000 + row_number() OVER (ORDER BY k, i) q_id FROM a) SELECT q_id, min(q_id) OVER (PARTITION BY k) primary_id, i = 0 is_primary, question, {norm('question')} normalized, response_type FROM b""",
    "parse_term_syntax": """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '**' || p_name WHEN 1 THEN '!!' || p_name ELSE p_name || ' ' END AS key, CASE p_partkey % 3 WHEN 2 THEN p_name || ' ' ELSE p_name END AS name, CASE p_partkey % 3 WHEN 0 THEN 'mandatory' WHEN 1 THEN 'organizer' ELSE 'default' END usage, CASE WHEN p_partkey % 3 = 0 THEN ' ' || p_brand END trait,
 CASE p_partkey % 3 WHEN 0 THEN array_to_string(list_sort([p_type, 'item']), '|') WHEN 1 THEN '' ELSE ' ' || p_brand END synonyms FROM part""",
    "tree_nodes": f"WITH {GEO} SELECT {node('path')} node_id, CASE WHEN len(path) > 1 THEN {node('path[1:len(path) - 1]')} END parent_id, array_to_string(path, '>') path, len(path) AS depth, name, usage, array_to_string(syn, '|') synonyms, has_faq, first_seen FROM nd",
    "tree_preorder": f"WITH {GEO} SELECT array_to_string(a.path, '>') path, string_agg(b.first_seen, ',' ORDER BY len(b.path)) preorder FROM pre a JOIN pre b ON b.path = a.path[1:len(b.path)] AND len(b.path) <= len(a.path) GROUP BY a.path",
    "node_questions": f"WITH {GEO} SELECT {node('path')} node_id, faq_ord, q_idx, question, array_to_string(tags, '|') tags FROM nq",
    "unreachable_questions": f"WITH {UNR} {shown('bad')}",
    "questions_at_root": f"WITH {UNR} {shown('top')}",
    "issue_report": f"WITH {UNR} SELECT 'en' AS language, error_type, question, array_to_string(path, ',') path, array_to_string(tags, ',') tags, walk, faq_ord, q_idx FROM iss",
    "limited_report": f"WITH {UNR}, o AS (SELECT *, row_number() OVER (PARTITION BY error_type ORDER BY list_transform(string_split(walk, ','), lambda x: TRY_CAST(x AS BIGINT)), faq_ord, q_idx) z FROM iss) SELECT 'en' AS language, error_type, question, array_to_string(path, ',') path, array_to_string(tags, ',') tags FROM o WHERE z <= 10",
    "issue_summary": f"WITH {UNR} SELECT max((error_type = 'UnreachableQuestions')::INT) errors, 0 warnings, max((error_type = 'QuestionsAtRoot')::INT) suggestions, max((error_type = 'UnreachableQuestions')::INT) + max((error_type = 'QuestionsAtRoot')::INT) total FROM iss",
    "answer_corpus_dedup": "SELECT min(doc_id) doc_id, md5(text) text_md5 FROM documents WHERE text IS NOT NULL AND NOT starts_with(text, '{{') GROUP BY text",
    "retrieve_words": f"WITH {ASG}, f AS (SELECT answer, arg_min(list_concat(terms, tags), q_id) raw FROM asg JOIN faq USING (q_id) GROUP BY answer) SELECT DISTINCT word FROM (SELECT unnest(raw) word FROM f) WHERE word <> '' UNION SELECT unnest(['pay', 'settle', 'misc', '{{x', 'fee', 'cost'])",
    "corpus_tokens": "WITH t AS (SELECT conv_id, turn, regexp_extract_all(lower(trim(text)), '[\\p{L}\\p{N}_]+|[^\\s\\p{L}\\p{N}_]') t FROM conversations) SELECT conv_id, turn, len(t) n_tokens, md5(array_to_string(t, ' ')) tokens_md5 FROM t",
    "nearest_vectors_top3": """WITH v AS (SELECT vec_id::VARCHAR AS word, embedding::DOUBLE[] e FROM embeddings), p AS (SELECT a.word, b.word neighbor, round(list_cosine_similarity(a.e, b.e), 6) similarity FROM v a JOIN v b ON a.word <> b.word WHERE a.word::BIGINT % 20 = 0)
 SELECT word, row_number() OVER (PARTITION BY word ORDER BY similarity DESC, neighbor) AS rank, neighbor, similarity FROM p QUALIFY row_number() OVER (PARTITION BY word ORDER BY similarity DESC, neighbor) <= 3 UNION ALL SELECT 'unknown', 1, '', 0.0""",
    "merge_synonyms": """SELECT p_partkey::VARCHAR term, array_to_string(list_concat(CASE WHEN p_partkey % 2 = 0 THEN [p_type] ELSE [] END, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 9 <> 0 THEN [p_brand, p_type] ELSE [] END), '|') synonyms FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0""",
}
