"""Corpus-wide removal of repeated lines with DataFrame functions only.

Lines are exploded as 128-bit hashes of their normalised keys (never as text), documents are
counted per hash with map-side partial sums, and the positions of dropped lines come back to
their document in one equi-join. Only that last join moves text, once. The most common lines are looked up in a broadcast of
at most HEAVY keys, so no line gathers its documents in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, folded, join_skewed, unfolded, written

MIN_CHARS = 10
MIN_DOCS = 2


def line_key(line: Column) -> Column:
    """The line stripped of ASCII white space at both ends (the case is folded beforehand)."""
    return F.btrim(line, F.lit(BLANKS))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    r"""Drop lines whose key occurs in at least ``min_docs`` documents, except in the smallest doc_id.

    ``docs`` has doc_id and text; further columns, whatever their names, are carried through, but
    for ``n_lines``, ``n_dropped`` and ``kept_text``, which are replaced. Each text is split at
    ``\n``; a line's key is the line without ASCII white space at both ends and with A-Z
    lower-cased; keys under ``min_chars`` code points stay. Returned: the input columns with
    ``n_lines`` (before dropping), ``n_dropped`` and ``kept_text`` (other lines joined by ``\n``).

    Nulls and ties: a null or empty text is one empty line and stays. A row with null doc_id
    neither counts as a document nor loses lines. Rows that repeat a doc_id are one document when
    documents are counted, and each row is split and reassembled by itself. Within the keeping
    document all copies of the line stay. An empty table gives an empty table.
    """
    own = ("n_lines", "n_dropped", "kept_text")
    columns = [c for c in docs.columns if c not in own]
    docs = folded(docs.drop(*own))
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = F.transform(F.split(ascii_lower(text), "\n"), line_key)
    hashes = F.transform(keys, lambda k: F.when(F.length(k) >= min_chars, F.unhex(F.md5(k))))
    lines = (
        docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
        .select("doc_id", F.xxhash64("text").alias("_row"), F.posexplode(hashes).alias("_pos", "_key"))
        .where(F.col("_key").isNotNull())
    )
    spread = F.count_distinct("doc_id") if min_docs > 2 else F.when(F.min("doc_id") != F.max("doc_id"), 2).otherwise(1)
    common = (
        lines.groupBy(F.col("_key").alias("_common"))
        .agg(F.min("doc_id").alias("_keeper"), spread.alias("_docs"), F.count(F.lit(1)).alias("_n"))
        .where(F.col("_docs") >= min_docs)
        .select(F.col("_common").alias("_line"), "_keeper", "_n")
    )
    common = written(common, "common-lines")
    total = common.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    dropped = (
        join_skewed(lines.withColumnRenamed("_key", "_line"), common, "_line", "_n", total, F.col("doc_id"))
        .where(F.col("doc_id") != F.col("_keeper"))
        .groupBy(F.col("doc_id").alias("_doc"), F.col("_row").alias("_of"))
        .agg(F.collect_list("_pos").alias("_drop"))
    )
    split = F.split(text, "\n")
    n = F.size(split)
    kept_at = F.array_except(F.sequence(F.lit(0), n - 1), F.col("_drop"))
    kept = F.when(F.col("_drop").isNull(), text).otherwise(
        F.array_join(F.transform(kept_at, lambda i: F.get("_lines", i)), "\n")
    )
    joined = docs.join(
        dropped, (F.col("doc_id") == F.col("_doc")) & (F.xxhash64("text") == F.col("_of")), "left"
    )
    return (
        joined.withColumn("_lines", split)
        .withColumns(
            {
                "n_lines": F.size("_lines").cast("long"),
                "n_dropped": F.coalesce(F.size("_lines") - F.size(kept_at), F.lit(0)).cast("long"),
                "kept_text": kept,
            }
        )
        .select(*unfolded(columns), *own)
    )
