"""The catalogue of items as a table: lookups, collisions, duplicates, unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import humanize_identifier
from ..sources.manifest import ManifestError


def parameter_names(parameters: Column) -> Column:
    """Names of a JSON schema's properties in declared order."""
    return F.coalesce(F.json_object_keys(F.get_json_object(parameters, "$.properties")), F.array().cast("array<string>"))


def required_parameters(parameters: Column) -> Column:
    """The required names; no list, none."""
    listed = F.get_json_object(parameters, "$.required")
    return F.coalesce(F.when(listed.startswith("["), F.from_json(listed, "array<string>")), F.array().cast("array<string>"))


def qualified_name(name: Column, server: Column) -> Column:
    return F.concat_ws(".", F.when(server != "", server), name)


def embedding_text(name: Column, description: Column, names: Column, examples: Column) -> Column:
    """``name - humanized - description - parameters - examples`` without empty parts; a humanized form equal to the name is left out."""
    human = humanize_identifier(name)
    parts = (name, F.when(human != name, human), description, F.array_join(names, ", "), F.array_join(examples, " | "))
    return F.concat_ws(" - ", *(F.when(p != "", p) for p in parts))


def duplicates(items: DataFrame, name: str = "name") -> DataFrame:
    """(name, n) of names that occur more than once."""
    return items.groupBy(name).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def union_manifests(*manifests: DataFrame) -> DataFrame:
    """All items in order with positions counted on; ManifestError where two share a name."""
    numbered = [m.withColumn("manifest", F.lit(i)) for i, m in enumerate(manifests)]
    both = reduce(DataFrame.unionByName, numbered)
    clash = [r["name"] for r in duplicates(both).orderBy("name").limit(20).collect()]
    if clash:
        raise ManifestError(f"Manifests declare the same names: {clash}")
    # Catalogues are bounded; one window over them numbers the whole.
    return both.withColumn("position", F.row_number().over(Window.orderBy("manifest", "position"))).drop("manifest")


def append_manifest(items: DataFrame, more: DataFrame) -> DataFrame:
    """Items with another manifest behind them; ManifestError where it declares a known name again."""
    clash = [r["name"] for r in more.join(items, "name", "left_semi").select("name").distinct().orderBy("name").limit(20).collect()]
    if clash:
        raise ManifestError(f"Already registered: {clash}")
    return union_manifests(items, more)


def last_by_name(items: DataFrame) -> DataFrame:
    """One row a name, the one with the largest position."""
    return items.groupBy("name").agg(F.max_by(F.struct(*items.columns), "position").alias("r")).select("r.*")


def keep_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by ``order``: an aggregation, so that a hot key is combined where it is read."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def by_server(items: DataFrame, server: str) -> DataFrame:
    return items.where(F.col("server") == server)


def by_name(items: DataFrame, *names: str) -> DataFrame:
    return items.where(F.col("name").isin(*names))


def require(items: DataFrame, name: str) -> DataFrame:
    """The item of that name; KeyError where there is none."""
    found = by_name(items, name)
    if found.isEmpty():
        raise KeyError(name)
    return found


def distinct_servers(items: DataFrame, server: str = "server", position: str = "position") -> DataFrame:
    """(server, first): servers with the position at which they are first seen."""
    return items.groupBy(server).agg(F.min(position).alias("first_seen"))
