"""The registered queries in DuckDB's SQL."""

from __future__ import annotations

from ..functions.text import DESCRIPTION_STOPWORDS, INFORMAL, QUERY_STOPWORDS
from ..operators.dataset import ADVERSARIAL, AMBIGUOUS, CLEAN, SEED, split_counts
from ..operators.evaluate import GAP_GRID
from ..operators.explain import NOTHING
from ..operators.prompt import HEADER, NO_MATCH


def words_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


CAMEL = r"regexp_replace({}, '([a-z0-9])([A-Z])', '\1 \2', 'g')"


def tok(x: str) -> str:
    return f"regexp_extract_all(lower({CAMEL.format(x)}), '[a-z0-9]+')"


def action(x: str) -> str:
    return rf"lower(trim(regexp_replace({CAMEL.format(x)}, '[_\-.]+', ' ', 'g')))"


def human(x: str) -> str:
    return rf"lower(trim(regexp_replace(regexp_replace({CAMEL.format(x)}, '[_\-.:/]+', ' ', 'g'), '\s+', ' ', 'g')))"


def ordered_distinct(x: str) -> str:
    """Distinct elements of a list in order."""
    return f"list_filter({x}, lambda e, i: list_position({x}, e) = i)"


def content(x: str) -> str:
    return f"list_filter({tok(x)}, lambda e: length(e) >= 2 AND NOT list_contains({words_list(QUERY_STOPWORDS)}, e))"


def kw(x: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({x}), '[a-z][a-z\-]+'), lambda e: length(e) >= 3 AND NOT list_contains({words_list(DESCRIPTION_STOPWORDS)}, e))"


def ws(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '[ \t\n\x0B\f\r]+'), lambda e: e <> '')"


def estimate(x: str) -> str:
    return f"CAST(CASE WHEN coalesce(length({x}), 0) = 0 THEN 0 ELSE greatest(length({x}) // 4, len({ws(x)}) * 13 // 10, 1) END AS BIGINT)"


PARTS = """
parts AS (
  SELECT p_partkey AS position, replace(p_name, ' ', '_') || '_' || p_partkey AS name,
         p_name || ' of ' || lower(p_type) || ' make by ' || lower(p_brand) AS description, lower(p_type) AS server,
         ['size', lower(p_brand)] AS parameter_names, ['find a ' || p_name] AS examples FROM part)"""
KINDS = f"""
{PARTS},
kinds AS (
  SELECT base || '_' || server AS name, replace(base, '_', ' ') || ' of ' || server AS description, server, min(position) AS position
  FROM (SELECT regexp_replace(name, '_[0-9]+$', '') AS base, server, position FROM parts) GROUP BY base, server)"""

SCORES = f"""
q AS (SELECT doc_id AS query_id, text AS query, lang AS category FROM documents),
it AS (SELECT item_id, text FROM benchmark),
qt AS (SELECT query_id, t, count(*) AS n FROM (SELECT query_id, unnest({tok('query')}) AS t FROM q) GROUP BY ALL),
il AS (SELECT item_id, {tok('text')} AS ts FROM it),
itf AS (
  SELECT item_id, t, count(*) AS tf FROM (SELECT item_id, unnest(CASE WHEN len(ts) = 0 THEN ['__empty__'] ELSE ts END) AS t FROM il) GROUP BY ALL),
idl AS (SELECT item_id, sum(tf) AS dl FROM itf GROUP BY item_id),
st AS (SELECT count(*) AS n, avg(dl) AS mean FROM idl),
idf AS (SELECT t, count(*) AS df FROM itf GROUP BY t),
ip AS (
  SELECT item_id, t, greatest(0.0, ln(1 + (n - df + 0.5) / (df + 0.5))) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean)) AS w
  FROM itf JOIN idl USING (item_id) JOIN idf USING (t), st),
bm AS (SELECT query_id, item_id, sum(n * w) AS bm25 FROM qt JOIN ip USING (t) GROUP BY ALL),
dt AS (SELECT DISTINCT t FROM (SELECT t FROM qt UNION ALL SELECT unnest(ts) FROM il)),
feat AS (
  SELECT t, 'w:' || t AS f, CAST(1.0 AS DOUBLE) AS w FROM dt UNION ALL
  SELECT t, 'g:' || CASE WHEN length(t) <= 1 THEN '#' || t || '#' ELSE substr('#' || t || '#', i, 3) END, CAST(0.35 AS DOUBLE)
  FROM (SELECT t, unnest(range(1, greatest(length(t), 1) + 1)) AS i FROM dt)),
tb AS (
  SELECT t, CAST('0x' || substr(md5(f), 1, 8) AS BIGINT) % 384 AS b, sum(CASE WHEN substr(md5(f), 9, 1) >= '8' THEN -w ELSE w END) AS w
  FROM feat GROUP BY ALL),
qs AS (SELECT query_id, b, sum(n * w) AS s FROM qt JOIN tb USING (t) GROUP BY ALL),
ivs AS (SELECT item_id, b, sum(w) AS s FROM (SELECT item_id, unnest(ts) AS t FROM il) JOIN tb USING (t) GROUP BY ALL),
qv AS (SELECT query_id, b, sign(s) * ln(1 + abs(s)) AS v FROM qs),
iv AS (SELECT item_id, b, sign(s) * ln(1 + abs(s)) AS v FROM ivs),
qn AS (SELECT query_id, sqrt(sum(v * v)) AS z FROM qv GROUP BY query_id),
inm AS (SELECT item_id, sqrt(sum(v * v)) AS z FROM iv GROUP BY item_id),
ds AS (
  SELECT query_id, item_id, greatest(0.0, least(1.0, sum(qv.v * iv.v / (qn.z * inm.z)))) AS d
  FROM qv JOIN iv USING (b) JOIN qn USING (query_id) JOIN inm USING (item_id) WHERE qn.z > 0 AND inm.z > 0 GROUP BY ALL),
pair AS (
  SELECT q.query_id, q.query, q.category, it.item_id, it.text, coalesce(d, 0) AS dense_raw, coalesce(bm25, 0) AS bm25_raw
  FROM q CROSS JOIN it LEFT JOIN ds USING (query_id, item_id) LEFT JOIN bm USING (query_id, item_id) WHERE trim(q.query) <> ''),
mm AS (
  SELECT *, min(dense_raw) OVER w AS dlo, max(dense_raw) OVER w AS dhi, min(bm25_raw) OVER w AS blo, max(bm25_raw) OVER w AS bhi
  FROM pair WINDOW w AS (PARTITION BY query_id)),
norm AS (
  SELECT *, CASE WHEN dhi - dlo <= 1e-12 THEN CASE WHEN dhi > 0 THEN 1.0 ELSE 0.0 END ELSE (dense_raw - dlo) / (dhi - dlo) END AS dense,
         CASE WHEN bhi - blo <= 1e-12 THEN CASE WHEN bhi > 0 THEN 1.0 ELSE 0.0 END ELSE (bm25_raw - blo) / (bhi - blo) END AS bm25 FROM mm),
rd AS (
  SELECT *, dense_raw AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(dense_raw, 9) DESC, item_id) AS rank FROM norm),
rh AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank
  FROM (SELECT *, 0.7 * dense + (1 - 0.7) * bm25 AS score FROM norm)),
gold AS (SELECT d.doc_id AS query_id, min(b.item_id) AS gold FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.text <> '' GROUP BY 1)"""


def top(source: str, k: int = 5) -> str:
    """Per query: number of candidates and the first two scores."""
    return f"""top AS (
  SELECT q.query_id, q.category, count(r.rank) AS n, max(score) FILTER (WHERE rank = 1) AS s1, max(score) FILTER (WHERE rank = 2) AS s2,
         max(dense_raw) FILTER (WHERE rank = 1) AS f1, max(item_id) FILTER (WHERE rank = 1) AS i1, max(item_id) FILTER (WHERE rank = 2) AS i2
  FROM q LEFT JOIN {source} r ON r.query_id = q.query_id AND r.rank <= {k} GROUP BY ALL)"""


MODE = """CASE WHEN n = 0 THEN 'no_candidates' WHEN round(f1, 9) < 0.54 THEN 'no_confident_match' WHEN n < 2 THEN 'single_candidate'
       WHEN round(s1 - s2, 9) >= {thr} THEN 'confident' ELSE 'ambiguous' END"""
KEPT = "CASE WHEN mode IN ('no_candidates', 'no_confident_match') THEN 0 WHEN mode = 'ambiguous' THEN least(n, 5) ELSE least(n, 1) END"


_GAP_TEXT = "printf('Gap %.3f between ''%s'' (%.3f) and ''%s'' (%.3f) ', gap, i1::VARCHAR, s1, i2::VARCHAR, s2)"
REASON = f"""CASE mode WHEN 'no_candidates' THEN 'Retrieval returned no candidates; nothing to gate.'
       WHEN 'no_confident_match' THEN printf('Best candidate ''%s'' scored %.3f, below the absolute floor 0.54. No item plausibly serves this query, so no guess is returned.', i1::VARCHAR, f1)
       WHEN 'single_candidate' THEN printf('Only one candidate (''%s'', score %.3f) was retrieved, so no top1-top2 gap exists; returning it as-is.', i1::VARCHAR, s1)
       WHEN 'confident' THEN {_GAP_TEXT} || 'meets the threshold 0.03; narrowing to top-' || selected_k || '.'
       ELSE {_GAP_TEXT} || 'is below the threshold 0.03; widening to top-' || selected_k || ' so that the choice can be made later.' END"""


def gates(source: str) -> str:
    return f"""{top(source)},
gated AS (
  SELECT *, CAST({KEPT} AS INTEGER) AS selected_k, CASE WHEN mode IN ('confident', 'ambiguous') THEN round(s1 - s2, 9) END AS gap
  FROM (SELECT *, {MODE.format(thr='0.03')} AS mode FROM top))"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts)


def ranks(source: str, name: str) -> str:
    return f"""{name} AS (
  SELECT g.query_id, g.gold, q.category, r.rank FROM gold g JOIN q USING (query_id)
  LEFT JOIN {source} r ON r.query_id = g.query_id AND r.item_id = g.gold AND r.rank <= 5)"""


N_ITEMS = "(SELECT count(*) FROM benchmark)"
BLOCK = "'- item_' || item_id || '(server' || (item_id % 3) || ')' || chr(10) || '  ' || text || chr(10) || '  params: none'"

# As text of the same length and words: a character beyond ASCII is six in JSON.
JSON_BLOCK = (
    r"""'{' || chr(10) || '  "name": "item_' || item_id || '",' || chr(10) || '  "description": ' || regexp_replace(CAST(to_json(text) AS VARCHAR), '[^\x00-\x7F]', 'uXXXXX', 'g') || ',' """
    """|| chr(10) || '  "parameters": {},' || chr(10) || '  "server": "server' || (item_id % 3) || '"' || chr(10) || '}'"""
)


def block(rank: str, context: str = "least(5, " + N_ITEMS + ")") -> str:
    hit = lambda k: f"round(avg(CASE WHEN {rank} <= {k} THEN 1.0 ELSE 0.0 END), 6)"
    return f"""count(*) AS queries, {hit(1)} AS top_1_accuracy, {hit(3)} AS top_3_accuracy, round(avg(coalesce(1.0 / {rank}, 0)), 6) AS mrr,
       round(avg(CASE WHEN {rank} <= 5 THEN 1.0 / log2({rank} + 1.0) ELSE 0.0 END), 6) AS ndcg_at_5, {hit(1)} AS recall_at_1, {hit(3)} AS recall_at_3,
       {hit(5)} AS recall_at_5, round(avg(CAST({context} AS DOUBLE)), 6) AS avg_tools_in_context"""


HEAD = HEADER.replace("'", "''").split("%d %s")
GATED_RANK = """gr AS (
  SELECT d.*, a.mode, a.selected_k, CASE WHEN d.rank <= a.selected_k THEN d.rank END AS kept_rank FROM rk d JOIN gated a USING (query_id))"""

# A word's bare letters, and the swap of the typo rule.
_INFORMAL = "CASE bare " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in INFORMAL.items()) + " END"



def typos(source: str, keys: str, text: str, salt: str) -> str:
    """CTEs up to ``typos`` (keys, typo): the typo rule for rows of a source with unique keys."""
    both = lambda x, y: " AND ".join(f"{x}.{k} IS NOT DISTINCT FROM {y}.{k}" for k in keys.split(", "))
    return rf"""w AS (SELECT {keys}, {ws(text)} AS p FROM {source}),
e AS (SELECT {keys}, unnest(p) AS x, unnest(range(len(p))) AS i FROM w),
s AS (SELECT *, {_INFORMAL} AS r FROM (SELECT *, regexp_replace(lower(x), '[^a-z]', '', 'g') AS bare FROM e)),
l AS (
  SELECT {keys}, bool_or(r IS NOT NULL) AS known, lower(string_agg(coalesce(r, x), ' ' ORDER BY i)) AS informal, lower(string_agg(x, ' ' ORDER BY i)) AS plain
  FROM s GROUP BY {keys}),
c AS (
  SELECT *, {ws('plain')} AS lw, list_filter(range(len({ws('plain')})), lambda i: length({ws('plain')}[i + 1]) > 4) AS la, md5('{salt}' || plain) AS h FROM l),
a AS (SELECT *, CASE WHEN len(la) > 0 THEN la[CAST(('0x' || substr(h, 1, 7))::BIGINT % len(la) AS INTEGER) + 1] END AS ap FROM c),
b AS (SELECT *, lw[ap + 1] AS wd, 1 + ('0x' || substr(h, 9, 7))::BIGINT % (length(lw[ap + 1]) - 3) AS pos FROM a),
o AS (
  SELECT {keys}, CASE WHEN known THEN informal WHEN length(plain) > 8 AND ap IS NOT NULL THEN
         array_to_string(list_transform(lw, lambda x, i: CASE WHEN i - 1 = ap THEN substr(wd, 1, pos) || substr(wd, pos + 2, 1) || substr(wd, pos + 1, 1) || substr(wd, pos + 3) ELSE x END), ' ')
         ELSE plain END AS out FROM b),
typos AS (SELECT {', '.join(f'w.{k}' for k in keys.split(', '))}, regexp_replace(coalesce(out, ''), '[?.]+$', '') AS typo FROM w LEFT JOIN o ON {both('w', 'o')})"""


def filled(template: str, **fields: str) -> str:
    """A template with its fields put in, in the given order."""
    for name, value in fields.items():
        template = f"replace({template}, '{{{name}}}', {value})"
    return rf"trim(regexp_replace({template}, '\s+', ' ', 'g'))"


def picked(source: str, count: int, seed: int) -> str:
    order = f"own DESC, md5('{seed}|' || name || '|' || template), query"
    return f"SELECT name, query FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY {order}) AS r FROM {source}) WHERE r <= {count}"


PAIRS = f"""term AS (
  SELECT DISTINCT name, server, position, unnest(list_concat({ordered_distinct(kw('description'))}[1:16], string_split({action('name')}, ' '))) AS t FROM kinds),
pairs AS (
  SELECT a.name, b.name AS sibling, b.position, count(*) + CASE WHEN a.server <> b.server THEN 0.5 ELSE 0.0 END AS score
  FROM term a JOIN term b ON a.t = b.t AND a.name <> b.name GROUP BY a.name, b.name, a.server, b.server, b.position),
nearest AS (SELECT name, sibling, score FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, position) AS r FROM pairs) WHERE r = 1)"""


def generated(per_item: int = 12, seed: int = SEED) -> str:
    n = split_counts(per_item)
    fields = {"action": "act", "object": "obj", "param2": "'size code'", "param": "'size code'", "first_kw": "kws[1]", "second_kw": "coalesce(kws[2], '')"}
    return rf"""WITH {KINDS},
{PAIRS},
parted AS (SELECT *, {action('name')} AS act, {ws(action('name'))} AS parts, {ordered_distinct(kw('description'))} AS found FROM kinds),
told AS (SELECT *, array_to_string(CASE WHEN len(parts) > 1 THEN parts[2:] ELSE parts END, ' ') AS obj FROM parted),
item AS (SELECT *, CASE WHEN len(found) > 0 THEN found[1:8] ELSE [obj] END AS kws, list_concat(found[1:16], parts) AS terms FROM told),
clean AS (
  SELECT name, template, {filled('template', **fields)} AS query, FALSE AS own FROM item, (SELECT unnest({words_list(CLEAN)}) AS template) UNION ALL
  SELECT name, 'Find me a ' || description || '?', regexp_replace(lower('Find me a ' || description || '?'), '[?.]+$', ''), TRUE FROM item),
shared AS (
  SELECT i.*, list_sort(list_filter(list_distinct(i.terms), lambda t: list_contains(coalesce(s.terms, []), t) AND length(t) > 3 AND t <> i.parts[1])) AS common
  FROM item i LEFT JOIN nearest USING (name) LEFT JOIN item s ON s.name = nearest.sibling),
noun AS (
  SELECT name, parts[1] AS verb, unnest(CASE WHEN len(common) > 0 THEN common WHEN len(list_filter(parts[2:], lambda w: length(w) > 2)) > 0 THEN list_filter(parts[2:], lambda w: length(w) > 2)
         WHEN len(found) > 0 THEN found[1:3] ELSE ['request'] END) AS noun FROM shared),
vague AS (
  SELECT name, noun || '|' || form AS template, {filled('form', verb='verb', noun='noun')} AS query, FALSE AS own FROM noun, (SELECT unnest({words_list(AMBIGUOUS)}) AS form)),
hostile AS (SELECT name, template, {filled('template', action='act')} AS query, FALSE AS own FROM item, (SELECT unnest({words_list(ADVERSARIAL)}) AS template)),
misspelt AS ({picked('clean', n['typo'], seed + 1)}),
{typos('misspelt', 'name, query', 'query', str(seed))},
every AS (
  SELECT query, name, 'clean' AS category, 0 AS place FROM ({picked('clean', n['clean'], seed)}) UNION ALL
  SELECT query, name, 'ambiguous', 1 FROM ({picked('vague', n['ambiguous'], seed)}) UNION ALL
  SELECT typo, name, 'typo', 2 FROM typos UNION ALL SELECT query, name, 'adversarial', 3 FROM ({picked('hostile', n['adversarial'], seed)}))
SELECT query, name AS correct_item, arg_min(category, place) AS category FROM every GROUP BY query, name"""


SQL: dict[str, str] = {
    "tokenize": f"SELECT doc_id, CAST(len(k) AS INTEGER) AS n, array_to_string(k, ' ') AS tokens FROM (SELECT doc_id, {tok('text')} AS k FROM documents)",
    "char_ngrams": f"""
WITH k AS (SELECT item_id, {tok('text')} AS ts FROM benchmark),
e AS (SELECT item_id, unnest(ts) AS t, unnest(range(len(ts))) AS pos FROM k)
SELECT item_id, CAST(pos AS INTEGER) AS pos,
       CASE WHEN length(t) <= 1 THEN '#' || t || '#' ELSE array_to_string(list_transform(range(1, length(t) + 1), lambda i: substr('#' || t || '#', i, 3)), ' ') END AS grams
FROM e""",
    "content_terms": f"""
WITH k AS (SELECT doc_id, {content('text')} AS c FROM documents),
e AS (SELECT doc_id, unnest(c) AS w, unnest(range(len(c))) AS i FROM k),
f AS (SELECT doc_id, w, min(i) AS i FROM e GROUP BY ALL)
SELECT k.doc_id, coalesce(string_agg(w, ' ' ORDER BY i), '') AS terms FROM k LEFT JOIN f USING (doc_id) GROUP BY k.doc_id""",
    "keywords": f"""
WITH k AS (SELECT doc_id, {kw('text')} AS c FROM documents),
e AS (SELECT doc_id, unnest(c) AS w, unnest(range(len(c))) AS i FROM k),
f AS (SELECT doc_id, w, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM (SELECT doc_id, w, min(i) AS i FROM e GROUP BY ALL))
SELECT k.doc_id, coalesce(string_agg(w, ' ' ORDER BY i), '') AS keywords FROM k LEFT JOIN f ON f.doc_id = k.doc_id AND r <= 16 GROUP BY k.doc_id""",
    "term_overlap": f"""
WITH k AS (
  SELECT conv_id, turn, {content('c.text')} AS c, {tok('d.text')} AS target FROM conversations c JOIN documents d ON conv_id = doc_id),
u AS (SELECT conv_id, turn, list_filter(c, lambda e: list_contains(target, e)) AS c FROM k),
e AS (SELECT conv_id, turn, unnest(c) AS w, unnest(range(len(c))) AS i FROM u),
f AS (SELECT conv_id, turn, w, min(i) AS i FROM e GROUP BY ALL)
SELECT u.conv_id, u.turn, coalesce(string_agg(w, ' ' ORDER BY i), '') AS overlap FROM u LEFT JOIN f USING (conv_id, turn) GROUP BY u.conv_id, u.turn""",
    "humanize_identifier": f"""
WITH n AS (SELECT p_partkey, p_name || '_' || p_type || 'partType.code' || '_' || p_brand AS name FROM part)
SELECT p_partkey, {human('name')} AS human, {action('name')} || ' ' || array_to_string(string_split({action('name')}, ' ')[2:], ' ') AS phrases FROM n""",
    "embedding_text": f"""
WITH {PARTS}
SELECT position, server || '.' || name AS qualified,
       name || ' - ' || {human('name')} || ' - ' || description || ' - ' || array_to_string(parameter_names, ', ') || ' - ' || array_to_string(examples, ' | ') AS text
FROM parts""",
    "first_present_alias": """
SELECT event_id, coalesce(nullif(props ->> '$.name', ''), nullif(props ->> '$.key', ''), nullif(props ->> '$.k', '')) AS value FROM events""",
    "json_keys": "SELECT event_id, array_to_string(json_keys(props), ' ') AS keys FROM events",
    "token_estimate": f"SELECT doc_id, {estimate('text')} AS tokens FROM documents",
    "typo_map": f"""WITH {typos("conversations", "conv_id, turn", "text", "s")} SELECT conv_id, turn, typo FROM typos""",
    "adversarial_templates": f"""
WITH {PARTS}
SELECT name, trim(regexp_replace(replace(t, '{{action}}', {action('name')}), '\\s+', ' ', 'g')) AS query FROM parts, (SELECT unnest({words_list(ADVERSARIAL)}) AS t)""",
    "score_band": """
SELECT event_id, CASE WHEN s >= 0.85 THEN 'very high' WHEN s >= 0.70 THEN 'high' WHEN s >= 0.55 THEN 'moderate' ELSE 'low' END AS band
FROM (SELECT event_id, value / max(value) OVER (PARTITION BY event_type) AS s FROM events)""",
    "doc_freq": f"""
WITH k AS (SELECT doc_id, {tok('text')} AS ts FROM documents)
SELECT t AS term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ts) = 0 THEN ['__empty__'] ELSE ts END) AS t FROM k) GROUP BY t""",
    "bm25_stats": f"SELECT count(*) AS n, round(avg(greatest(len({tok('text')}), 1)), 6) AS avgdl FROM documents",
    "idf": f"""
WITH k AS (SELECT doc_id, {tok('text')} AS ts FROM documents),
f AS (SELECT t, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ts) = 0 THEN ['__empty__'] ELSE ts END) AS t FROM k) GROUP BY t)
SELECT t AS term, round(greatest(0.0, ln(1 + ((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5))), 6) AS idf FROM f""",
    "postings": f"{with_(SCORES)} SELECT item_id, t AS term, round(w, 6) AS weight FROM ip",
    "bm25_topk": f"""{with_(SCORES)}
SELECT query_id, CAST(r AS INTEGER) AS rank, item_id, round(bm25_raw, 6) AS bm25
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25_raw, 9) DESC, item_id) AS r FROM pair) WHERE r <= 5""",
    "l2_normalize": """
WITH z AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings)
SELECT vec_id, CAST(i AS INTEGER) AS i, round(x / n, 6) AS u FROM (SELECT vec_id, n, unnest(e) AS x, unnest(range(len(e))) AS i FROM z)""",
    "vector_validate": """
SELECT 'dimension' AS problem, 2 * count(*) AS n FROM nation UNION ALL SELECT 'duplicate id', count(*) FROM nation""",
    "dense_topk": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, greatest(0.0, least(1.0, list_cosine_similarity(q.e, v.e))) AS score
  FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, vec_id, CAST(r AS INTEGER) AS rank, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS r FROM s) WHERE r <= 5""",
    "hash_embed": f"{with_(SCORES)} SELECT query_id AS doc_id, CAST(b AS INTEGER) AS bucket, round(v / z, 6) AS v FROM qv JOIN qn USING (query_id) WHERE abs(v) > 1e-12",
    "minmax_normalize": """
SELECT event_id, round(CASE WHEN hi - lo <= 1e-12 THEN CASE WHEN hi > 0 THEN 1.0 ELSE 0.0 END ELSE (value - lo) / (hi - lo) END, 6) AS scaled
FROM (SELECT event_id, value, min(value) OVER (PARTITION BY user_id) AS lo, max(value) OVER (PARTITION BY user_id) AS hi FROM events)""",
    "hybrid_topk": f"""{with_(SCORES)}
SELECT query_id, item_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score, round(dense, 6) AS dense, round(bm25, 6) AS bm25,
       round(dense_raw, 6) AS dense_raw, round(bm25_raw, 6) AS bm25_raw FROM rh WHERE rank <= 5""",
    "server_filter_topk": f"""{with_(SCORES)}
SELECT query_id, item_id, CAST(r AS INTEGER) AS rank, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM rd WHERE rank <= 20 AND item_id % 3 = 1) WHERE r <= 5""",
    "score_gap": f"""{with_(SCORES, gates('rd'))}
SELECT query_id, round(s1, 6) AS top_score, round(s2, 6) AS runner_up_score, round(s1 - s2, 6) AS gap FROM gated""",
    "confidence_gate": f"""{with_(SCORES, gates('rh'))}
SELECT query_id, mode, selected_k, round(gap, 6) AS gap, round(s1, 6) AS top_score, round(s2, 6) AS runner_up_score, mode = 'ambiguous' AS widened, selected_k > 0 AS has_match, {REASON} AS reason FROM gated""",
    "gate_select": f"""{with_(SCORES, gates('rd'))}
SELECT query_id, item_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM gated JOIN rd USING (query_id) WHERE rank <= selected_k""",
    "gate_modes": f"{with_(SCORES, gates('rd'))} SELECT mode, count(*) AS n FROM gated GROUP BY mode",
    "rank_of_gold": f"""{with_(SCORES, ranks('rd', 'a'), ranks('rh', 'b'))}
SELECT query_id, 'dense' AS baseline, gold, CAST(rank AS INTEGER) AS rank FROM a UNION ALL SELECT query_id, 'hybrid', gold, CAST(rank AS INTEGER) FROM b""",
    "ir_metrics": f"""{with_(SCORES, ranks('rh', 'a'))}
SELECT query_id, round(coalesce(1.0 / rank, 0), 6) AS rr, round(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1.0) ELSE 0 END, 6) AS ndcg,
       CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0.0 END AS top1, CASE WHEN rank <= 3 THEN 1.0::DOUBLE ELSE 0.0 END AS recall3 FROM a""",
    "eval_metrics": f"{with_(SCORES, ranks('rd', 'a'))} SELECT {block('rank')} FROM a",
    "eval_by_category": f"{with_(SCORES, ranks('rh', 'a'))} SELECT coalesce(category, '(all)') AS category, {block('rank')} FROM a GROUP BY GROUPING SETS ((category), ())",
    "ambiguous_behaviour": f"""{with_(SCORES, gates('rd'), ranks('rd', 'rk'), GATED_RANK)}
SELECT count(*) AS ambiguous_queries, round(avg(CASE WHEN mode = 'ambiguous' THEN 1.0 ELSE 0.0 END), 6) AS ambiguous_widen_rate,
       round(avg(CASE WHEN kept_rank = 1 THEN 1.0 ELSE 0.0 END), 6) AS ambiguous_top_1_accuracy,
       round(avg(CASE WHEN kept_rank IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS ambiguous_correct_in_context,
       round(coalesce(avg(CASE WHEN kept_rank IS NOT NULL THEN 1.0 ELSE 0.0 END) FILTER (WHERE coalesce(kept_rank, 0) <> 1), 0), 6) AS ambiguous_rescued_by_widening,
       round(avg(CAST(selected_k AS DOUBLE)), 6) AS ambiguous_avg_tools_in_context
FROM gr WHERE category = 'fr' HAVING count(*) > 0""",
    "gap_sweep": f"""{with_(SCORES, top('rd'), ranks('rd', 'rk'))},
sw AS (
  SELECT *, CAST({KEPT} AS INTEGER) AS kept FROM (
    SELECT thr, rk.category, rk.rank, n, {MODE.format(thr='thr')} AS mode FROM rk JOIN top USING (query_id), (SELECT unnest([{', '.join(map(str, GAP_GRID))}]::DOUBLE[]) AS thr))),
x AS (SELECT *, CASE WHEN rank <= kept THEN 1.0 ELSE 0.0 END AS inside FROM sw),
r AS (
  SELECT thr AS gap_threshold, coalesce(avg(CASE WHEN mode = 'confident' THEN 1.0 ELSE 0.0 END) FILTER (WHERE category = 'en'), 0) AS clean_narrow_rate,
         coalesce(avg(CASE WHEN kept = 1 THEN inside ELSE 0.0 END) FILTER (WHERE category = 'en'), 0) AS clean_correct_as_single,
         coalesce(avg(CASE WHEN mode = 'ambiguous' THEN 1.0 ELSE 0.0 END) FILTER (WHERE category = 'fr'), 0) AS ambiguous_widen_rate,
         coalesce(avg(inside) FILTER (WHERE category = 'fr'), 0) AS ambiguous_correct_in_context, avg(inside) AS overall_correct_in_context,
         avg(CAST(kept AS DOUBLE)) AS avg_tools_in_context FROM x GROUP BY thr)
SELECT gap_threshold, round(clean_narrow_rate, 6) AS clean_narrow_rate, round(clean_correct_as_single, 6) AS clean_correct_as_single,
       round(ambiguous_widen_rate, 6) AS ambiguous_widen_rate, round(ambiguous_correct_in_context, 6) AS ambiguous_correct_in_context,
       round(overall_correct_in_context, 6) AS overall_correct_in_context, round(avg_tools_in_context, 6) AS avg_tools_in_context,
       round(CASE WHEN clean_correct_as_single + ambiguous_correct_in_context > 0 THEN
         2 * clean_correct_as_single * ambiguous_correct_in_context / (clean_correct_as_single + ambiguous_correct_in_context) ELSE 0 END, 6) AS balance_score FROM r""",
    "score_floor_report": f"""{with_(SCORES, top('rd'))}
SELECT gold IS NOT NULL AS in_domain, count(*) AS n, round(min(s1), 6) AS min, round(quantile_cont(s1, 0.05), 6) AS p05, round(quantile_cont(s1, 0.25), 6) AS p25,
       round(quantile_cont(s1, 0.5), 6) AS median, round(quantile_cont(s1, 0.95), 6) AS p95, round(max(s1), 6) AS max
FROM top LEFT JOIN gold USING (query_id) WHERE s1 IS NOT NULL GROUP BY 1""",
    "percentiles": """
SELECT event_type, round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50,
       round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean FROM events GROUP BY event_type""",
    "baseline_compare": f"""{with_(SCORES, gates('rd'), ranks('rd', 'rk'), ranks('rh', 'hk'), GATED_RANK)},
al AS (SELECT *, (SELECT count(*) FROM it i WHERE i.item_id % 10 < gold % 10 OR i.item_id % 10 = gold % 10 AND i.item_id <= gold) AS place FROM rk)
SELECT 'all_tools' AS baseline, {block('place', N_ITEMS)}, 0.0::DOUBLE AS gate_widen_rate, 0.0::DOUBLE AS gate_no_match_rate FROM al
UNION ALL SELECT 'dense', {block('rank')}, 0.0, 0.0 FROM rk UNION ALL SELECT 'hybrid', {block('rank')}, 0.0, 0.0 FROM hk
UNION ALL SELECT 'confidence_gate', {block('kept_rank', 'selected_k')}, round(avg(CASE WHEN mode = 'ambiguous' THEN 1.0 ELSE 0.0 END), 6),
       round(avg(CASE WHEN mode = 'no_confident_match' THEN 1.0 ELSE 0.0 END), 6) FROM gr""",
    "token_reduction": f"""{with_(SCORES, gates('rd'))},
shown AS (
  SELECT 'dense' AS baseline, query_id, rank, {BLOCK} AS x FROM rd WHERE rank <= 5 UNION ALL
  SELECT 'hybrid', query_id, rank, {BLOCK} FROM rh WHERE rank <= 5 UNION ALL
  SELECT 'confidence_gate', query_id, rank, {BLOCK} FROM rd JOIN gated USING (query_id) WHERE rank <= selected_k),
p AS (
  SELECT b.baseline, g.query_id, coalesce(string_agg(x, chr(10) ORDER BY rank), '') AS x
  FROM gold g CROSS JOIN (SELECT unnest(['dense', 'hybrid', 'confidence_gate']) AS baseline) b LEFT JOIN shown s ON s.query_id = g.query_id AND s.baseline = b.baseline GROUP BY ALL),
every AS (SELECT {estimate("x")} AS t FROM (SELECT '[' || chr(10) || string_agg({JSON_BLOCK}, ',' || chr(10) ORDER BY item_id) || chr(10) || ']' AS x FROM it))
SELECT baseline, round(avg({estimate('x')}), 6) AS avg_prompt_tokens, round((max(t) - avg({estimate('x')})) / max(t), 6) AS token_reduction FROM p, every GROUP BY baseline""",
    "nearest_sibling": f"WITH {KINDS},\n{PAIRS}\nSELECT name, sibling, CAST(score AS DOUBLE) AS score FROM nearest",
    "generated_dataset": generated(),
    "dedup_keep_first": """
SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events) WHERE r = 1""",
    "semi_collisions": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    "anti_out_of_domain": "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "manifest_union_dups": "SELECT name, count(*) AS n FROM (SELECT p_name AS name FROM part UNION ALL SELECT p_type FROM part) GROUP BY name HAVING count(*) > 1",
    "distinct_servers": "SELECT source, min(doc_id) AS first_seen FROM documents GROUP BY source",
    "registry_by_server": f"WITH {PARTS} SELECT position, name, server FROM parts WHERE server = 'economy'",
    "category_counts": "SELECT lang AS category, count(*) AS n FROM documents GROUP BY lang",
    "agent_decisions": f"""{with_(SCORES, gates('rd'))}
SELECT g.query_id, g.mode, CASE WHEN selected_k = 0 THEN 'refuse' ELSE 'execute' END AS stage, r.item_id AS chosen
FROM gated g LEFT JOIN rd r ON r.query_id = g.query_id AND r.rank = 1 AND selected_k > 0""",
    "prompt_block": f"""{with_(SCORES, gates('rd'))},
p AS (SELECT query_id, string_agg({BLOCK}, chr(10) ORDER BY rank) AS x, count(*) AS shown FROM gated JOIN rd USING (query_id) WHERE rank <= selected_k GROUP BY query_id)
SELECT g.query_id, CASE WHEN x IS NULL THEN '{NO_MATCH}' ELSE '{HEAD[0]}' || shown || CASE WHEN shown = 1 THEN ' tool' ELSE ' tools' END || '{HEAD[1]}' || chr(10) || chr(10) || x END AS prompt,
       {estimate("coalesce(x, '')")} AS tokens FROM gated g LEFT JOIN p USING (query_id)""",
    "explain_rows": f"""{with_(SCORES, gates('rh'))},
s AS (
  SELECT g.query_id, r.rank, r.item_id, r.score, r.dense, r.bm25, {content('q.query')} AS c, {tok('it.text')} AS target, {tok("'item_' || r.item_id")} AS names, 'server' || (r.item_id % 3) AS server
  FROM gated g JOIN q USING (query_id) LEFT JOIN rh r ON r.query_id = g.query_id AND r.rank <= g.selected_k LEFT JOIN it ON it.item_id = r.item_id),
e AS (SELECT query_id, rank, target, names, server, unnest(c) AS w, unnest(range(len(c))) AS i FROM s),
f AS (
  SELECT query_id, rank, w, min(i) AS i, any_value(list_contains(target, w)) AS d, any_value(list_contains(names, w)) AS n, any_value(list_contains({tok('server')}, w)) AS v
  FROM e GROUP BY query_id, rank, w),
h AS (
  SELECT query_id, rank, string_agg(w, ' ' ORDER BY i) FILTER (WHERE d) AS description_terms, string_agg(w, ' ' ORDER BY i) FILTER (WHERE n) AS name_terms, count(*) FILTER (WHERE n) AS many,
         string_agg('''' || w || '''', ', ' ORDER BY i) FILTER (WHERE d) AS told, string_agg('''' || w || '''', ', ' ORDER BY i) FILTER (WHERE n) AS named,
         bool_or(w = 'size') AS sized, bool_or(v) AS served
  FROM f GROUP BY query_id, rank),
b AS (
  SELECT s.*, description_terms, name_terms, many, told, named, coalesce(sized, FALSE) AS sized, coalesce(served, FALSE) AS served,
         CASE WHEN s.rank IS NULL THEN 'none' WHEN score >= 0.85 THEN 'very high' WHEN score >= 0.70 THEN 'high' WHEN score >= 0.55 THEN 'moderate' ELSE 'low' END AS score_band
  FROM s LEFT JOIN h ON h.query_id = s.query_id AND h.rank IS NOT DISTINCT FROM s.rank)
SELECT query_id, CAST(coalesce(rank, 0) AS INTEGER) AS rank, item_id, score_band, CASE WHEN rank IS NULL THEN 'none' ELSE 'hybrid' END AS source, round(coalesce(score, 0), 6) AS score,
       CASE WHEN rank IS NULL THEN '' ELSE coalesce(description_terms, '') END AS description_terms, CASE WHEN rank IS NULL THEN '' ELSE coalesce(name_terms, '') END AS name_terms,
       CASE WHEN rank IS NULL THEN '{NOTHING}' ELSE concat_ws('; ',
         printf('Ranked #%d with a %s fused dense+lexical score (dense %.2f, BM25 %.2f, both min-max normalised) of %.3f', CAST(rank AS INTEGER), score_band, dense, bm25, score),
         CASE WHEN many > 1 THEN 'query terms ' || named || ' appear in the item name' WHEN many = 1 THEN 'query term ' || named || ' appears in the item name' END,
         'description mentions ' || told, CASE WHEN sized THEN 'parameter names include ''size''' END, CASE WHEN served THEN 'query references the ''' || server || ''' server directly' END,
         CASE WHEN told IS NULL AND named IS NULL AND NOT sized AND NOT served THEN 'no literal term overlap: selected on semantic similarity alone' END) || '.' END AS reason
FROM b""",
}
for _name, _source in (("route_dense", "rd"), ("route_hybrid", "rh")):
    SQL[_name] = f"""{with_(SCORES, gates(_source))}
SELECT g.query_id, mode, selected_k, round(gap, 6) AS gap, r.item_id, CAST(r.rank AS INTEGER) AS rank, round(r.score, 6) AS score
FROM gated g LEFT JOIN {_source} r ON r.query_id = g.query_id AND r.rank <= g.selected_k"""
