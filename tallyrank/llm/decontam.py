"""Benchmark decontamination as a prefix-filtered set join, with DataFrame functions only.

A window of an item occurs in a document only if all its word shingles do, so its rarest shingle
(counted over all documents) is the one token that must be joined: the prefix. Documents emit
hashes of those shingles alone that some item has; prefixes are looked up among them, bounded by
position and length, and each surviving alignment of an item with a document is verified word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, folded, unfolded, written

WINDOW = 10
SHINGLE = 3
#: Texts of all items together, in bytes, up to which their shingles are broadcast; beyond it they are shuffled.
BROADCAST_BYTES = 16 << 20
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Runs of digits, a-z and characters beyond ASCII, A-Z lower-cased first."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _GAPS), "")


def shingle_hashes(words: Column, size: int) -> Column:
    """64-bit hashes of all runs of ``size`` words, by position; matches are verified on words later."""
    n = F.size(words)
    at = F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.lit(size), *(F.get(words, i + k) for k in range(size))))


def _small(spark_side: DataFrame, is_small: bool) -> DataFrame:
    return F.broadcast(spark_side) if is_small else spark_side


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The columns of ``docs`` with n_words, n_hit, items (sorted item ids as strings) and contaminated.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text. A window is ``window`` consecutive
    words of an item, or all of an item that has fewer; a document word inside an occurrence of a
    window is hit. Other columns of ``docs`` pass through, but for those four names, which are replaced.

    Null or empty texts have no words and no windows. Rows that repeat a doc_id are searched one
    by one; a null doc_id is searched like any. Items with equal texts or ids all count (an id once);
    a null item_id adds hits but no id. Empty tables give no hits.
    """
    own = ("n_words", "n_hit", "items", "contaminated")
    columns = [c for c in docs.columns if c not in own]
    docs = folded(docs.drop(*own))
    items = (
        benchmark.select("item_id", words_of(F.col("text")).alias("iw"))
        .where(F.size("iw") > 0)
        .distinct()
        .withColumns({"item": F.xxhash64("item_id", "iw"), "len": F.least(F.size("iw"), F.lit(window))})
        .withColumn("size", F.least("len", F.lit(shingle)))
    )
    told = benchmark.agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    small = (told["b"] or 0) + 64 * told["n"] <= BROADCAST_BYTES
    sizes = sorted(r[0] for r in items.select("size").distinct().collect()) or [shingle]

    def by_size(words: Column, size: Column) -> Column:
        out = shingle_hashes(words, shingle)
        for s in range(1, shingle):
            out = F.when(size == s, shingle_hashes(words, s)).otherwise(out)
        return out

    item_shingles = items.select(
        "item", "len", "size", F.size("iw").alias("m"), F.posexplode(by_size(F.col("iw"), F.col("size"))).alias("ipos", "sh")
    )
    doc_words = docs.select("doc_id", F.xxhash64("text").alias("row"), words_of(F.col("text")).alias("w"))
    occurrences = written(
        _exploded(doc_words, sizes).join(_small(item_shingles.select("sh").distinct(), small), "sh", "left_semi"), "shingles"
    )
    rarity = occurrences.groupBy("sh").agg(F.count(F.lit(1)).alias("seen"))
    # A window that an item repeats is looked for once, at its first place; so repetitive texts cost what their different windows do.
    places = items.select("item", "len", "iw", F.explode(F.sequence(F.lit(0), F.size("iw") - F.col("len"))).alias("k"))
    content = F.md5(F.array_join(F.slice("iw", F.col("k") + 1, F.col("len")), " "))
    different = places.select("item", "k", content.alias("content")).groupBy("item", "content").agg(F.min("k").alias("k")).select("item", "k")
    # Each shingle of an item stands in the windows that begin up to len - size places before it.
    windows = item_shingles.join(rarity, "sh", "left").select(
        "item", "len", "ipos", "sh", "seen",
        F.explode(
            F.sequence(
                F.greatest(F.lit(0), F.col("ipos") - (F.col("len") - F.col("size"))), F.least(F.col("ipos"), F.col("m") - F.col("len"))
            )
        ).alias("k"),
    )
    prefixes = (
        windows.join(_small(different, small), ["item", "k"], "left_semi").groupBy("item", "len", "k")
        .agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "sh", "ipos")).alias("p"))
        .where("p.seen > 0")
        .groupBy("item", "len", F.col("p.sh").alias("sh"), F.col("p.ipos").alias("ipos"))
        .agg(F.min("k").alias("first"), F.max("k").alias("last"))
    )
    diagonal = F.col("pos") - F.col("ipos")
    aligned = (
        occurrences.join(_small(prefixes, small), "sh")
        .where((diagonal + F.col("last") >= 0) & (diagonal + F.col("first") + F.col("len") <= F.col("n")))
        .groupBy("doc_id", "row", "item", "len", diagonal.alias("diagonal"))
        .agg(F.min("first").alias("first"), F.max("last").alias("last"))
        .groupBy("doc_id", "row", "item", "len")
        .agg(F.collect_list(F.struct("diagonal", "first", "last")).alias("places"))
        .join(_small(items.select("item", "item_id", "iw"), small), "item")
        .groupBy(F.col("doc_id").alias("_doc"), F.col("row").alias("_row"))
        .agg(F.collect_list(F.struct("item_id", "places", "len", "iw")).alias("_aligned"))
    )

    def starts(c: Column) -> Column:
        """Places of the document where a window of the item stands, compared word by word."""

        def of(place: Column) -> Column:
            low = F.greatest(place["first"], -place["diagonal"])
            high = F.least(place["last"], F.size("_words") - c["len"] - place["diagonal"])
            same = lambda k: F.slice(F.col("_words"), place["diagonal"] + k + 1, c["len"]) == F.slice(c["iw"], k + 1, c["len"])
            found = F.transform(F.filter(F.sequence(low, high), same), lambda k: place["diagonal"] + k)
            return F.when(high >= low, found).otherwise(F.array().cast("array<int>"))

        return F.flatten(F.transform(c["places"], of))

    same_row = F.col("doc_id").eqNullSafe(F.col("_doc")) & F.xxhash64("text").eqNullSafe(F.col("_row"))
    verified = (
        docs.join(aligned, same_row, "left")
        .withColumn("_words", words_of(F.col("text")))
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn(
            "_found",
            F.filter(
                F.transform(
                    "_aligned",
                    lambda c: F.struct(c["item_id"].alias("item_id"), c["len"].alias("len"), starts(c).alias("at")),
                ),
                lambda c: F.size(c["at"]) > 0,
            ),
        )
    )
    hit = F.array_distinct(
        F.flatten(
            F.transform(
                "_found",
                lambda c: F.flatten(F.transform(c["at"], lambda at: F.sequence(at, at + c["len"] - 1))),
            )
        )
    )
    ids = F.array_sort(F.array_distinct(F.array_compact(F.transform("_found", lambda c: c["item_id"].cast("string")))))
    return (
        verified.withColumns(
            {
                "n_hit": F.when(F.col("_found").isNull(), 0).otherwise(F.size(hit)).cast("long"),
                "items": F.coalesce(ids, F.array().cast("array<string>")),
            }
        )
        .withColumn("contaminated", F.col("n_hit") > 0)
        .select(*unfolded(columns), *own)
    )


def _exploded(doc_words: DataFrame, sizes: list[int]) -> DataFrame:
    """doc_id, row, n, pos, sh for each shingle of the given sizes."""
    out = None
    for s in sizes:
        part = doc_words.select("doc_id", "row", F.size("w").alias("n"), F.posexplode(shingle_hashes(F.col("w"), s)).alias("pos", "sh"))
        out = part if out is None else out.unionByName(part)
    return out
