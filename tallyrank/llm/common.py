"""Column helpers and shared-folder tables used by the operators of this subpackage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The six white-space characters U+0020 and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` is several times faster and does the same where all is ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def split_words(text: str | None, lower: bool = True) -> list[bytes]:
    """Runs without U+0020 and U+0009 to U+000D as UTF-8, A-Z lower-cased; bytes methods know ASCII only."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def uncovered(spans: list[tuple[int, int]], covers: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The (start, end) that lie in none of ``covers``; both sorted by start, in one pass."""
    out, k, reach = [], 0, -1
    for start, end in spans:
        while k < len(covers) and covers[k][0] <= start:
            reach = max(reach, covers[k][1])
            k += 1
        if end > reach:
            out.append((start, end))
    return out


def crc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``."""
    return F.crc32(doc_id.cast("string")) % F.lit(modulus)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folded(docs: DataFrame) -> DataFrame:
    """doc_id and text, and all other columns in a struct ``_rest`` where no name of theirs can clash."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", *([F.struct(*(docs[f"`{c}`"] for c in rest)).alias("_rest")] if rest else []))


def unfolded(columns: list[str]) -> list[Column]:
    """The columns of a folded table under their own names, in the given order."""
    return [F.col(c) if c in ("doc_id", "text") else F.col(f"_rest.`{c}`").alias(c) for c in columns]


#: Keys that are broadcast in a join, at most: each has over a HEAVY-th of all rows.
HEAVY = 1000


def join_skewed(left: DataFrame, right: DataFrame, on: str, n: str, total: int, row: Column) -> DataFrame:
    """``left`` LEFT JOIN ``right`` on the column ``on``, with the other columns of ``right`` (null without a match).

    ``right`` has each key once, with the number of its rows in ``left`` in column ``n``; ``total`` is the number of all those rows. So
    at most HEAVY keys have more than total / HEAVY rows: those are broadcast and their rows stay where they
    are, and only lighter keys are joined by a shuffle. Rows with a heavy or null key are dealt out by ``row``.
    """
    values = [c for c in right.columns if c != on]
    limit = max(1, total // HEAVY)
    side = lambda df, key, value: df.select(F.col(on).alias(key), F.struct(*values).alias(value))
    heavy, light = side(right.where(F.col(n) > limit), "_heavy", "_of_heavy"), side(right.where(F.col(n) <= limit), "_light", "_of_light")
    first = left.join(F.broadcast(heavy), F.col(on) == F.col("_heavy"), "left")
    first = first.withColumn("_key", F.when(F.col("_heavy").isNull(), F.col(on))).withColumn("_deal", F.when(F.col("_key").isNull(), F.xxhash64(row)).otherwise(F.lit(0).cast("long")))
    # One key of two parts: with two keys Spark may deal by the first alone, which sends all null keys to one task.
    both = F.struct(F.col("_key").alias("k"), F.col("_deal").alias("d")) == F.struct(F.col("_light").alias("k"), F.lit(0).cast("long").alias("d"))
    second = first.join(light, both, "left")
    return second.select(*(F.col(c) for c in left.columns), *(F.coalesce(F.col("_of_heavy")[c], F.col("_of_light")[c]).alias(c) for c in values))


#: Marks that ``sieved`` broadcasts, at most.
MARKS = 1 << 18


def sieved(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose doc_id may be one of ``ids`` (doc_id): all that are, and few others while ids are few beside MARKS.

    So texts that an exact join would drop don't move for it. What is broadcast are the ids' hashes modulo MARKS, so its size is
    bounded; with more ids fewer rows are dropped here, and none is lost.
    """
    mark = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(MARKS))
    marks = ids.select(mark.alias("_mark")).distinct()
    return df.join(F.broadcast(marks), mark == F.col("_mark"), "left_semi")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where the setting is absent (local tests) a temporary folder is made and set for the session.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='tallyrank-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a shared folder through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _drop_quietly(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        drop_path(spark, path)


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder name in the shared folder; it is deleted when the driver ends in good order."""
    path = f"{shared_dir(spark)}/tallyrank-{label}-{uuid.uuid4().hex}"
    atexit.register(_drop_quietly, spark, path)
    return path


#: Bytes of a row group of a written table: a task that writes or reads it holds one in its heap.
ROW_GROUP = 16 << 20


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet to the shared folder and read it again.

    Unlike cached or locally checkpointed blocks the table survives the loss of any executor.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
