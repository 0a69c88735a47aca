"""The registered queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import spread
from . import decontam, lm, minhash, packing, secrets, tokcount, topk, toxicity, warc
from .common import table
from .line_dedup import dedup_lines


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(documents(spark, sf_dir)).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_literal"
    )


def byte_bpe() -> Callable[[str], bytes]:
    import public_tokenizers

    return packing.byte_bpe(
        public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


def op2_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), byte_bpe)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return topk.top_k(docs, docs.where("doc_id % 50 = 0"))


def piece_scores() -> list[tuple[str, float]]:
    import public_tokenizers

    return lm.sentencepiece_scores(public_tokenizers.path("piece_bpe_32k.model"))


def op5_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(documents(spark, sf_dir), piece_scores)


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return decontam.contamination(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op9_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def piece_automaton() -> tokcount.PieceAutomaton:
    import public_tokenizers

    return tokcount.PieceAutomaton(tokcount.sentencepiece_pieces(public_tokenizers.path("piece_bpe_32k.model")), "▁")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokcount.count_tokens(documents(spark, sf_dir), piece_automaton)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_sum_of_squares_packing": op2_sum_of_squares_packing,
    "op3_line_dedup": op3_line_dedup,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_lattice_scores": op5_lattice_scores,
    "op6_warc_round_trip": op6_warc_round_trip,
    "op7_toxicity": op7_toxicity,
    "op8_decontamination": op8_decontamination,
    "op9_minmax_near_dedup": op9_minmax_near_dedup,
    "op10_token_counts": op10_token_counts,
}

#: A-Z lower-cased and nothing else, in DuckDB.
ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANKS_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
GAPS_SQL = r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

ORACLE: dict[str, str] = {
    "op3_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT *, trim({ASCII_LOWER.format('line')}, {BLANKS_SQL}) AS k FROM lines),
shared AS (
  SELECT k, min(doc_id) AS keeper FROM keyed WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
flagged AS (
  SELECT d.*, s.k IS NOT NULL AND d.doc_id <> s.keeper AS gone
  FROM keyed d LEFT JOIN shared s ON d.k = s.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
""",
    "op4_exact_top_k": f"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex({ASCII_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (
  SELECT q.doc_id AS query_id, t.doc_id,
         round(sum(ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * len(d.w) / st.mean))), 9) AS s
  FROM tf q JOIN tf t ON q.term = t.term AND q.doc_id % 50 = 0 JOIN df ON df.term = q.term JOIN d ON d.doc_id = t.doc_id, st
  GROUP BY 1, 2)
SELECT query_id, CAST(r AS INTEGER) AS rank, doc_id, round(s, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS r FROM sc) WHERE r <= 10
""",
    "op6_warc_round_trip": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT html, min(page_id) AS keeper FROM p WHERE strlen(html) >= 100 GROUP BY html)
SELECT p.page_id, strlen(p.html) AS payload_bytes, sha256(p.html) AS payload_digest,
       CASE WHEN k.keeper <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN k.keeper <> p.page_id THEN k.keeper END AS refers_to
FROM p LEFT JOIN k ON p.html = k.html
""",
    "op8_decontamination": f"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex({ASCII_LOWER.format("coalesce(text, '')")}, {GAPS_SQL}), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex({ASCII_LOWER.format("coalesce(text, '')")}, {GAPS_SQL}), lambda x: x <> '') AS w
  FROM benchmark),
sized AS (SELECT *, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM sized)),
spots AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT d.*, z.n, unnest(range(1, greatest(1, len(w) - z.n + 2))) AS i FROM d, (SELECT DISTINCT n FROM win) z)),
occ AS (SELECT spots.doc_id, spots.i, spots.n, win.item_id FROM spots JOIN win ON spots.s = win.s AND spots.n = win.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
ids AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(t, ',' ORDER BY t)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(hit.n_hit, 0) AS n_hit, coalesce(ids.n_items, 0) AS n_items,
       coalesce(ids.items_sha256, sha256('')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
""",
    "op9_minmax_near_dedup": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex({ASCII_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
inter AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM inter JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM comp LEFT JOIN n USING (doc_id)
""",
}
