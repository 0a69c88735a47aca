"""BM25 statistics and scores as relations: postings, document frequencies and a postings join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize

K1, B = 1.5, 0.75
#: The one token of a document without any.
EMPTY = "__empty__"
#: Bytes of all items' texts up to which their terms and weights are broadcast.
TERMS_BYTES = 8 << 20


def postings(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, term, tf, dl): one row per distinct term of an item, counted within the row, without a shuffle."""
    tokens = tokenize(F.col(text))
    tokens = F.when(F.size(tokens) == 0, F.array(F.lit(EMPTY))).otherwise(tokens)
    return (
        items.select(item_id, tokens.alias("tokens"))
        .select(item_id, F.size("tokens").cast("long").alias("dl"), F.explode("tokens").alias("term"))
        .groupBy(item_id, "dl", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
        .select(item_id, "term", "tf", "dl")
    )


def document_frequency(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(term, df): distinct tokens within each row first, then one aggregation with map-side sums."""
    tokens = tokenize(F.col(text))
    tokens = F.when(F.size(tokens) == 0, F.array(F.lit(EMPTY))).otherwise(F.array_distinct(tokens))
    return items.select(F.explode(tokens).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_statistics(items: DataFrame, text: str = "text") -> DataFrame:
    """One row: n documents, avgdl."""
    dl = F.greatest(F.size(tokenize(F.col(text))), F.lit(1))
    return items.select(dl.alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.greatest(F.lit(0.0), F.log(1 + (n - df + 0.5) / (df + 0.5)))


def term_score(tf: Column, dl: Column, avgdl: Column, weight: Column) -> Column:
    return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def weighted_postings(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, term, weight): what one occurrence of the term in a query adds to the item's score."""
    own = postings(items, item_id, text)
    stats = corpus_statistics(items, text)
    return (
        own.join(document_frequency(items, item_id, text), "term")
        .join(F.broadcast(stats))  # one row
        .select(item_id, "term", term_score(F.col("tf"), F.col("dl"), F.col("avgdl"), idf(F.col("n"), F.col("df"))).alias("weight"))
    )


def scores_by_join(items: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, item_id, bm25) of pairs that share a term, for items of any size: an equi-join on terms.

    Of the queries' tokens only those that some item has are counted and moved. The items' terms are broadcast where their texts are
    within TERMS_BYTES, else shuffled.
    """
    weighted = weighted_postings(items)
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    terms = weighted.select("term").distinct()
    tokens = queries.select("query_id", F.explode(tokenize(F.col("query"))).alias("term"))
    asked = tokens.join(F.broadcast(terms) if size <= TERMS_BYTES else terms, "term", "left_semi").groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    return (
        asked.join(F.broadcast(weighted) if size <= TERMS_BYTES else weighted, "term")
        .groupBy("query_id", "item_id")
        .agg(F.sum(F.col("qtf") * F.col("weight")).alias("bm25"))
    )


def top_k(items: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, item_id, bm25): the k best items of each query by ``scores_by_join``.

    Ties in nine decimals go to the smaller id. A query that shares terms with fewer than k items gets items of score 0 behind them, by
    id; blank and null queries get none. ``queries`` has query_id (each once) and query.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("bm25", 9)), "item_id")
    scored = scores_by_join(items, queries).where(F.round("bm25", 9) > 0)
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    found = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id", "bm25"))).alias("found"))
    # A query lacks at most k items, and at most k of those with the smallest ids are found: 2 k of them are enough.
    first = [r[0] for r in items.select("item_id").distinct().orderBy("item_id").limit(2 * k).collect()]
    rows = queries.where(F.trim("query") != "").select("query_id").join(found, "query_id", "left")
    hits = F.coalesce("found", F.array().cast("array<struct<rank:int,item_id:bigint,bm25:double>>"))
    others = F.array_except(F.array(*(F.lit(i) for i in first)).cast("array<bigint>"), F.transform(hits, lambda h: h["item_id"]))
    zeros = F.transform(others, lambda i, at: F.struct((F.size(hits) + at + 1).cast("int").alias("rank"), i.alias("item_id"), F.lit(0.0).alias("bm25")))
    return rows.select("query_id", F.explode(F.slice(F.concat(hits, zeros), 1, k)).alias("h")).select("query_id", "h.*")
