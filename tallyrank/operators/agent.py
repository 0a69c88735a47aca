"""What an agent does with each routed query: refuse, decline, reject, or execute."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Chooser = Callable[[Column], Column]


def top_ranked(candidates: Column) -> Column:
    """The chooser without a model: the best candidate's id."""
    return F.get(candidates, F.lit(0))["item_id"]


def placeholders(required: Column) -> Column:
    """Arguments as a map of each required name to ``<name>``: none is invented."""
    return F.map_from_arrays(required, F.transform(required, lambda p: F.concat(F.lit("<"), p, F.lit(">"))))


def decide(selected_rows: DataFrame, choose: Chooser = top_ranked) -> DataFrame:
    """Add ``choice``, ``stage`` and ``chosen`` to gated rows cut to their selection.

    refuse: nothing was routed; decline: the chooser gives null; reject: it names an item outside the
    routed subset; execute: otherwise, and only then is ``chosen`` not null.
    """
    ids = F.transform("candidates", lambda c: c["item_id"])
    stage = (
        F.when(F.size("candidates") == 0, "refuse")
        .when(F.col("choice").isNull(), "decline")
        .when(~F.array_contains(ids, F.col("choice")), "reject")
        .otherwise("execute")
    )
    return (
        selected_rows.withColumn("choice", choose(F.col("candidates")))
        .withColumn("stage", stage)
        .withColumn("chosen", F.when(F.col("stage") == "execute", F.col("choice")))
    )


def steps(echoed: DataFrame, all_tokens: int) -> DataFrame:
    """Add ``steps``, what was done in order as (step, detail), and the prompt's tokens against those of all items.

    Needs mode, reason, prompt_tokens and the columns of ``decide`` and ``echo``.
    """
    n = F.size("candidates")
    step = lambda name, detail: F.struct(F.lit(name).alias("step"), detail.alias("detail"))
    called = F.format_string("%s on %s with %s", "tool", "server", F.coalesce(F.to_json("arguments"), F.lit("{}")))
    told = {
        "refuse": F.lit("nothing was routed, so nothing is called"),
        "decline": F.lit("the chooser took none of the candidates"),
        "reject": F.format_string("the chooser named item %s, which wasn't routed", F.col("choice").cast("string")),
    }
    last = F.coalesce(*(F.when(F.col("stage") == k, v) for k, v in told.items()), called)
    log = F.array(
        step("route", F.concat("mode", F.lit(": "), "reason")),
        step("prompt", F.format_string("%d candidates in %d tokens", n, F.col("prompt_tokens"))),
        step("choose", F.coalesce(F.concat(F.lit("item "), F.col("choice").cast("string")), F.lit("none"))),
    )
    saved = F.lit(all_tokens) - F.col("prompt_tokens")
    share = F.round(saved / F.lit(float(all_tokens)), 6) if all_tokens else F.lit(0.0)
    return echoed.withColumns({"steps": F.concat(log, F.array(F.struct(F.col("stage").alias("step"), last.alias("detail")))), "all_tokens": F.lit(all_tokens).cast("long"), "tokens_saved": saved, "token_reduction": share})


def echo(decided: DataFrame, items: DataFrame) -> DataFrame:
    """Simulated execution: what would be called, with placeholder arguments; rows without a call keep nulls.

    ``items`` has item_id, name, server and required, and is the small side.
    """
    told = items.select("item_id", F.col("name").alias("tool"), "server", placeholders(F.col("required")).alias("arguments"))
    return decided.join(told, decided["chosen"] == told["item_id"], "left").drop(told["item_id"]).withColumn("simulated", F.col("chosen").isNotNull())
