"""Registered queries: each operator over whole tables.

The catalogue is ``benchmark`` (item_id, text), the queries are all ``documents``, a query's category is its
language and its gold item the one whose text it holds, if any.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import metrics as m
from ..functions import text as t
from ..functions.vectors import HashEmbedder, embedded, l2_normalize
from ..operators import agent, bm25, dataset, dense, evaluate, explain, gate, prompt, registry, scoring
from ..sources.manifest import first_present
from ..sources.tables import read_table as table
from ..sources.tables import spread

K = 5
#: Languages that stand for the categories of labelled queries.
CLEAN, AMBIGUOUS = "en", "fr"


def six(name: str) -> Column:
    return F.round(F.col(name), 6).alias(name)


def joined(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def documents(spark: SparkSession, d: str, *columns: Column | str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text", "lang")).select("doc_id", *columns)


# --- text functions ---------------------------------------------------------------------------------


def tokenize(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d, t.tokenize(F.col("text")).alias("k")).select("doc_id", F.size("k").alias("n"), joined(F.col("k")).alias("tokens"))


def char_ngrams(spark: SparkSession, d: str) -> DataFrame:
    tokens = table(spark, d, "benchmark").select("item_id", F.posexplode(t.tokenize(F.col("text"))).alias("pos", "token"))
    return tokens.select("item_id", "pos", joined(t.char_ngrams(F.col("token"))).alias("grams"))


def content_terms(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d, joined(t.content_terms(F.col("text"))).alias("terms"))


def keywords(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d, joined(t.keywords(F.col("text"), 16)).alias("keywords"))


def term_overlap(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "conversations").alias("c").join(documents(spark, d, F.col("text").alias("target")), F.col("conv_id") == F.col("doc_id"))
    return both.select("conv_id", "turn", joined(t.term_overlap(t.content_terms(F.col("c.text")), F.col("target"))).alias("overlap"))


def humanize_identifier(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat_ws("_", "p_name", F.concat("p_type", F.lit("partType.code")), "p_brand")
    return table(spark, d, "part").select("p_partkey", t.humanize_identifier(name).alias("human"), joined(F.array(t.action_phrase(name), t.object_phrase(name))).alias("phrases"))


def parts_as_items(spark: SparkSession, d: str) -> DataFrame:
    """Parts as catalogue items: one per part, servers by type."""
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("position"),
        F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), "p_partkey").alias("name"),
        F.concat("p_name", F.lit(" of "), F.lower("p_type"), F.lit(" make by "), F.lower("p_brand")).alias("description"),
        F.lower("p_type").alias("server"),
        F.array(F.lit("size"), F.lower("p_brand")).alias("parameter_names"),
        F.array(F.concat(F.lit("find a "), "p_name")).alias("examples"),
    )


def embedding_text(spark: SparkSession, d: str) -> DataFrame:
    text = registry.embedding_text(F.col("name"), F.col("description"), F.col("parameter_names"), F.col("examples"))
    return parts_as_items(spark, d).select("position", text.alias("text"), registry.qualified_name(F.col("name"), F.col("server")).alias("qualified"))


def first_present_alias(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", first_present(F.col("props"), ("name", "key", "k")).alias("value"))


def json_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", joined(F.json_object_keys("props")).alias("keys"))


def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d, t.token_estimate(F.col("text")).alias("tokens"))


def typo_map(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", t.typo_map(F.col("text"), "s").alias("typo"))


def adversarial_templates(spark: SparkSession, d: str) -> DataFrame:
    return dataset.adversarial_queries(parts_as_items(spark, d)).select("name", "query")


def score_band(spark: SparkSession, d: str) -> DataFrame:
    share = F.col("value") / F.max("value").over(Window.partitionBy("event_type"))
    return table(spark, d, "events").select("event_id", t.score_band(share).alias("band"))


# --- BM25 and vectors -------------------------------------------------------------------------------


def doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return bm25.document_frequency(documents(spark, d, "text"), "doc_id")


def bm25_stats(spark: SparkSession, d: str) -> DataFrame:
    return bm25.corpus_statistics(table(spark, d, "documents")).select("n", six("avgdl"))


def idf(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d, "text")
    df = bm25.document_frequency(docs, "doc_id").join(F.broadcast(docs.agg(F.count(F.lit(1)).alias("n"))))  # one row
    return df.select("term", F.round(bm25.idf(F.col("n"), F.col("df")), 6).alias("idf"))


def postings(spark: SparkSession, d: str) -> DataFrame:
    return bm25.weighted_postings(table(spark, d, "benchmark")).select("item_id", "term", six("weight"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    queries = documents(spark, d, F.col("text").alias("query")).withColumnRenamed("doc_id", "query_id")
    return bm25.top_k(table(spark, d, "benchmark"), queries, K).select("query_id", "rank", "item_id", six("bm25"))


def l2_norm(spark: SparkSession, d: str) -> DataFrame:
    unit = l2_normalize(F.col("embedding"))
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(unit).alias("i", "u"))
    return rows.select("vec_id", "i", six("u"))


def vector_validate(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of the table, those of user 0's events (wrong dimension) and repeated ids."""
    good = table(spark, d, "embeddings").select("vec_id", "embedding")
    bad = table(spark, d, "nation").select((F.col("n_nationkey") + 1_000_000).cast("long").alias("vec_id"), F.array(F.lit(1.0).cast("float")).alias("embedding"))
    return dense.problems(good.unionByName(bad).unionByName(bad), 64).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    return dense.top_k_vectors(vectors, vectors.where("vec_id % 50 = 0"), K).select("query_id", "vec_id", "rank", six("score"))


def hash_embed(spark: SparkSession, d: str) -> DataFrame:
    vectors = embedded(documents(spark, d, "text"), HashEmbedder())
    rows = vectors.select("doc_id", F.posexplode("embedding").alias("bucket", "v"))
    return rows.where("abs(v) > 1e-12").select("doc_id", "bucket", F.round("v", 6).alias("v"))


def minmax_normalize(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id")
    low, high = F.min("value").over(w), F.max("value").over(w)
    scaled = F.when(high - low <= scoring.FLAT, F.when(high > 0, 1.0).otherwise(0.0)).otherwise((F.col("value") - low) / (high - low))
    return table(spark, d, "events").select("event_id", F.round(scaled, 6).alias("scaled"))


# --- routing ----------------------------------------------------------------------------------------


def catalogue(spark: SparkSession, d: str) -> tuple[DataFrame, scoring.ItemIndex]:
    """All documents as queries, and the index of the items."""
    index = scoring.build_index(table(spark, d, "benchmark"))
    queries = table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"), F.col("lang").alias("category"))
    return spread(queries), index


def found(spark: SparkSession, d: str, hybrid: bool, k: int = K, gold: bool = False) -> DataFrame:
    queries, index = catalogue(spark, d)
    return scoring.retrieve(queries, index, k, hybrid, gold=gold)


def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = scoring.exploded(found(spark, d, True), "query_id")
    return rows.select("query_id", "item_id", "rank", six("score"), six("dense"), six("bm25"), six("dense_raw"), six("bm25_raw"))


def server_of(item_id: Column) -> Column:
    return F.concat(F.lit("server"), item_id % 3)


def server_filter_topk(spark: SparkSession, d: str) -> DataFrame:
    queries, index = catalogue(spark, d)
    kept = scoring.retrieve(queries, index, K, allowed=[i for i in index.ids if i % 3 == 1])
    return scoring.exploded(kept, "query_id").select("query_id", "item_id", "rank", six("score"))


def gated(spark: SparkSession, d: str, hybrid: bool, gold: bool = False) -> DataFrame:
    return gate.confidence_gate(found(spark, d, hybrid, gold=gold))


def score_gap(spark: SparkSession, d: str) -> DataFrame:
    rows = gated(spark, d, False)
    return rows.select("query_id", six("top_score"), six("runner_up_score"), F.round(F.col("top_score") - F.col("runner_up_score"), 6).alias("gap"))


def confidence_gate(spark: SparkSession, d: str) -> DataFrame:
    return gated(spark, d, True).select("query_id", "mode", "selected_k", six("gap"), six("top_score"), six("runner_up_score"), "widened", "has_match", "reason")


def gate_select(spark: SparkSession, d: str) -> DataFrame:
    return scoring.exploded(gate.selected(gated(spark, d, False)), "query_id").select("query_id", "item_id", "rank", six("score"))


def gate_modes(spark: SparkSession, d: str) -> DataFrame:
    return gated(spark, d, False).groupBy("mode").agg(F.count(F.lit(1)).alias("n"))


def routed(spark: SparkSession, d: str, hybrid: bool) -> DataFrame:
    rows = gate.selected(gated(spark, d, hybrid))
    out = rows.select("query_id", "mode", "selected_k", six("gap"), F.explode_outer("candidates").alias("c"))
    return out.select("query_id", "mode", "selected_k", "gap", "c.item_id", "c.rank", F.round("c.score", 6).alias("score"))


def route_dense(spark: SparkSession, d: str) -> DataFrame:
    return routed(spark, d, False)


def route_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return routed(spark, d, True)


# --- evaluation -------------------------------------------------------------------------------------


def blocks(index: scoring.ItemIndex) -> tuple[dict[int, str], dict[int, str]]:
    fields = [(i, f"item_{i}", f"server{i % 3}", text) for i, text in zip(index.ids, index.texts, strict=True)]
    return {i: prompt.compact_block(n, s, x, None) for i, n, s, x in fields}, {i: prompt.json_block(n, s, x, None) for i, n, s, x in fields}


def labelled(spark: SparkSession, d: str) -> tuple[DataFrame, scoring.ItemIndex]:
    """Documents that hold an item's text, with the smallest such item as ``gold``."""
    queries, index = catalogue(spark, d)
    return scoring.retrieve(queries, index, 0, {}, gold=True).where("gold IS NOT NULL"), index


def outcomes(spark: SparkSession, d: str, *baselines: str) -> DataFrame:
    """Outcomes of labelled queries; the manifest's order is by the ids' last digit."""
    queries, index = labelled(spark, d)
    order = sorted(index.ids, key=lambda i: (i % 10, i))
    return evaluate.run_baselines(queries, index, *blocks(index), K, baselines or evaluate.BASELINES, order=order)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def rank_of_gold(spark: SparkSession, d: str) -> DataFrame:
    return outcomes(spark, d, "dense", "hybrid").select("query_id", "baseline", "gold", "rank")


def ir_metrics(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("rank")
    rows = outcomes(spark, d, "hybrid").select("query_id", m.reciprocal_rank(r).alias("rr"), m.ndcg(r, 5).alias("ndcg"), m.within(r, 1).alias("top1"), m.within(r, 3).alias("recall3"))
    return rounded(rows)


METRICS = ("queries", "top_1_accuracy", "top_3_accuracy", "mrr", "ndcg_at_5", "recall_at_1", "recall_at_3", "recall_at_5", "avg_tools_in_context")


def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.evaluate(outcomes(spark, d, "dense"), by_category=False).select(*METRICS))


def eval_by_category(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.evaluate(outcomes(spark, d, "hybrid")).select(F.coalesce("category", F.lit("(all)")).alias("category"), *METRICS))


def ambiguous_behaviour(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.ambiguous_behaviour(outcomes(spark, d, "confidence_gate"), AMBIGUOUS).drop("baseline"))


def gap_sweep(spark: SparkSession, d: str) -> DataFrame:
    rows = found(spark, d, False, gold=True).where("gold IS NOT NULL")
    return rounded(evaluate.gap_sweep(rows, k=K, clean=CLEAN, ambiguous=AMBIGUOUS))


def score_floor_report(spark: SparkSession, d: str) -> DataFrame:
    tops = gated(spark, d, False, gold=True).select(F.col("gold").isNotNull().alias("in_domain"), "top_score")
    return rounded(evaluate.score_floor_report(tops))


def percentiles(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    rows = table(spark, d, "events").groupBy("event_type").agg(*(m.percentile(v, q).alias(f"p{q}") for q in (5, 25, 50, 95)), m.mean(v).alias("mean"))
    return rounded(rows)


def baseline_compare(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.evaluate(outcomes(spark, d), by_category=False).select("baseline", *METRICS, "gate_widen_rate", "gate_no_match_rate"))


def token_reduction(spark: SparkSession, d: str) -> DataFrame:
    """Against the JSON listing of all items."""
    queries, index = labelled(spark, d)
    compact, full = blocks(index)
    out = evaluate.run_baselines(queries, index, compact, full, K, ("dense", "hybrid", "confidence_gate"))
    listed = spark.createDataFrame([([full[i] for i in index.ids],)], "x array<string>").select(prompt.prompt_tokens(F.col("x"), "json")).first()[0]
    return rounded(evaluate.token_reduction(out, listed))


# --- catalogue, data set, agent ---------------------------------------------------------------------


def distinct_types(spark: SparkSession, d: str) -> DataFrame:
    """One item per kind of part (name and type), which is a bounded catalogue."""
    kinds = parts_as_items(spark, d).select("position", F.regexp_replace("name", "_[0-9]+$", "").alias("base"), "server")
    first = kinds.groupBy("base", "server").agg(F.min("position").alias("position"))
    return first.select(
        F.concat_ws("_", "base", "server").alias("name"), F.concat(F.replace("base", F.lit("_"), F.lit(" ")), F.lit(" of "), "server").alias("description"), "server", "position"
    )


def nearest_sibling(spark: SparkSession, d: str) -> DataFrame:
    return dataset.nearest_sibling(distinct_types(spark, d))


def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return registry.keep_first(rows, ["user_id", "event_type"], "event_id")


def semi_collisions(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(known, "c_custkey", "left_semi").select("c_custkey", "c_name")


def anti_out_of_domain(spark: SparkSession, d: str) -> DataFrame:
    labelled = table(spark, d, "labels").select("doc_id")
    return table(spark, d, "documents").join(labelled, "doc_id", "left_anti").select("doc_id", "lang")


def manifest_union_dups(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "part").select(F.col("p_name").alias("name"))
    two = table(spark, d, "part").select(F.col("p_type").alias("name"))
    return registry.duplicates(one.unionByName(two))


def distinct_servers(spark: SparkSession, d: str) -> DataFrame:
    return registry.distinct_servers(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id")


def registry_by_server(spark: SparkSession, d: str) -> DataFrame:
    return registry.by_server(parts_as_items(spark, d), "economy").select("position", "name", "server")


def category_counts(spark: SparkSession, d: str) -> DataFrame:
    return dataset.category_counts(table(spark, d, "documents").select(F.col("lang").alias("category")))


def agent_decisions(spark: SparkSession, d: str) -> DataFrame:
    rows = agent.decide(gate.selected(gated(spark, d, False)))
    return rows.select("query_id", "mode", "stage", "chosen")


def prompt_block(spark: SparkSession, d: str) -> DataFrame:
    queries, index = catalogue(spark, d)
    compact = blocks(index)[0]
    found = scoring.retrieve(queries, index, K, attach={"block": [compact[i] for i in index.ids]})
    kept = gate.selected(gate.confidence_gate(found))
    shown = F.transform("candidates", lambda c: c["block"])
    return kept.select("query_id", prompt.prompt(shown).alias("prompt"), prompt.prompt_tokens(shown).alias("tokens"))


def explain_rows(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark").select(
        "item_id", F.concat(F.lit("item_"), "item_id").alias("name"), F.col("text").alias("description"), server_of(F.col("item_id")).alias("server"),
        F.array(F.lit("size")).alias("parameter_names"),
    )
    rows = explain.explain(gate.selected(gated(spark, d, True)), F.broadcast(items), "hybrid")
    return rows.select("query_id", "rank", "item_id", "score_band", "source", six("score"), joined(F.col("hits_description")).alias("description_terms"), joined(F.col("hits_name")).alias("name_terms"), "reason")


def generated_dataset(spark: SparkSession, d: str) -> DataFrame:
    kinds = distinct_types(spark, d).withColumns({"parameter_names": F.array(F.lit("size_code")), "examples": F.array(F.concat(F.lit("Find me a "), "description", F.lit("?")))})
    return dataset.generate(kinds)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        tokenize, char_ngrams, content_terms, keywords, term_overlap, humanize_identifier, embedding_text, first_present_alias, json_keys,
        token_estimate, typo_map, adversarial_templates, score_band, doc_freq, bm25_stats, idf, postings, bm25_topk, vector_validate, dense_topk,
        hash_embed, minmax_normalize, hybrid_topk, server_filter_topk, score_gap, confidence_gate, gate_select, gate_modes, route_dense, route_hybrid,
        rank_of_gold, ir_metrics, eval_metrics, eval_by_category, ambiguous_behaviour, gap_sweep, score_floor_report, percentiles, baseline_compare,
        token_reduction, nearest_sibling, dedup_keep_first, semi_collisions, anti_out_of_domain, manifest_union_dups, distinct_servers,
        registry_by_server, category_counts, agent_decisions, prompt_block, explain_rows, generated_dataset,
    )
} | {"l2_normalize": l2_norm}
