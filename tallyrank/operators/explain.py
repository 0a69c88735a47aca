"""Reasons for each selected candidate, from signals that the ranking used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_terms, score_band, term_overlap

NOTHING = "No item was selected for this query: nothing was retrieved, or every candidate scored below the floor."


def _quoted(terms: Column) -> Column:
    return F.concat(F.lit("'"), F.array_join(terms, "', '"), F.lit("'"))


def explain(selected_rows: DataFrame, items: DataFrame, source: str = "dense") -> DataFrame:
    """One row per selected candidate with band, matched terms and ``reason``; a row of rank 0 for a query without any.

    ``selected_rows`` has query_id, query, reason (the gate's) and candidates; ``items`` has item_id, name,
    description, server and parameter_names and is the small side.
    """
    terms = content_terms(F.col("query"))
    rows = selected_rows.select("query_id", "query", terms.alias("terms"), F.col("reason").alias("gate_reason"), F.explode_outer("candidates").alias("c"))
    joined = rows.join(items, F.col("c.item_id") == items["item_id"], "left").withColumn("score", F.col("c.score"))
    fields = {"name": F.col("name"), "description": F.col("description"), "parameters": F.array_join("parameter_names", " "), "server": F.col("server")}
    hits = {k: F.when(v.isNotNull(), term_overlap(F.col("terms"), v)).otherwise(F.array().cast("array<string>")) for k, v in fields.items()}
    h = {k: F.col(f"hits_{k}") for k in hits}
    has = {k: F.size(v) > 0 for k, v in h.items()}
    phrase = {
        "dense": F.lit("dense embedding cosine similarity"),
        "bm25": F.lit("lexical BM25 score"),
        "hybrid": F.format_string("fused dense+lexical score (dense %.2f, BM25 %.2f, both min-max normalised)", "c.dense", "c.bm25"),
    }[source]
    several = F.size(h["name"]) > 1
    clauses = F.concat_ws(
        "; ",
        F.concat(F.format_string("Ranked #%d with a %s ", "c.rank", score_band(F.col("score"))), phrase, F.format_string(" of %.3f", "score")),
        F.when(has["name"], F.concat(F.when(several, "query terms ").otherwise("query term "), _quoted(h["name"]), F.when(several, " appear").otherwise(" appears"), F.lit(" in the item name"))),
        F.when(has["description"], F.concat(F.lit("description mentions "), _quoted(h["description"]))),
        F.when(has["parameters"], F.concat(F.lit("parameter names include "), _quoted(h["parameters"]))),
        F.when(has["server"], F.concat(F.lit("query references the '"), F.col("server"), F.lit("' server directly"))),
        F.when(~(has["name"] | has["description"] | has["parameters"] | has["server"]), "no literal term overlap: selected on semantic similarity alone"),
    )
    found = F.col("c").isNotNull()
    return joined.withColumns({f"hits_{k}": v for k, v in hits.items()}).select(
        "query_id",
        F.coalesce("c.rank", F.lit(0)).alias("rank"),
        F.col("c.item_id").alias("item_id"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.when(found, score_band(F.col("score"))).otherwise("none").alias("score_band"),
        F.when(found, source).otherwise("none").alias("source"),
        *(F.col(f"hits_{k}") for k in hits),
        F.when(found, F.concat(clauses, F.lit("."))).otherwise(NOTHING).alias("reason"),
        "gate_reason",
    )
