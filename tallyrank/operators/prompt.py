"""Rendering of items into prompt blocks, with token accounting."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import token_estimate

# Texts of the blocks.
NO_MATCH = (
    "No tool in the connected MCP servers matched this request with sufficient confidence. Tell the user you cannot "
    "handle this request with the available tools rather than calling an unrelated tool."
)
HEADER = (
    "You have access to the following %d %s, pre-selected as relevant to the user's request. Choose the single best match "
    "and call it with the required parameters. If none of them fit, say so instead of guessing."
)
EXAMPLES_SHOWN = 3


def type_label(schema: Any) -> str:
    """Label of a JSON schema: enum(a|b), array<inner>, a|b for unions, any."""
    if not isinstance(schema, dict):
        return "any"
    if isinstance(schema.get("enum"), (list, str)):
        return f"enum({'|'.join(map(str, schema['enum']))})"
    kind = schema.get("type")
    if kind == "array":
        return f"array<{type_label(schema.get('items'))}>"
    return "|".join(map(str, kind)) if isinstance(kind, list) else str(kind or "any")


def compact_block(name: str, server: str, description: str, parameters: str | None, examples: list[str] | None = None) -> str:
    """An item as a few lines: name(server), description, parameters with types and, if given, examples."""
    schema = json.loads(parameters or "{}")
    properties, required = schema.get("properties"), schema.get("required")
    required = required if isinstance(required, list) else []
    shown = [f"{p}: {type_label(s)}{' (required)' if p in required else ''}" for p, s in properties.items()] if isinstance(properties, dict) else []
    lines = [f"- {name}({server})", f"  {description}", f"  params: {', '.join(shown) or 'none'}"]
    return "\n".join(lines + ([f"  examples: {' | '.join(examples[:EXAMPLES_SHOWN])}"] if examples else []))


def json_block(name: str, server: str, description: str, parameters: str | None) -> str:
    """An item with its full schema, as an agent without routing would send it."""
    return json.dumps({"name": name, "description": description, "parameters": json.loads(parameters or "{}"), "server": server}, indent=2)


# The walk over a schema is recursive, which no column expression is; items are few and come in Arrow batches.
compact_udf = F.udf(compact_block, T.StringType(), useArrow=True)
json_udf = F.udf(json_block, T.StringType(), useArrow=True)


def with_blocks(items, include_examples: bool = False):
    """Items with ``compact`` and ``json`` blocks."""
    fields = ("name", "server", "description", "parameters")
    return items.withColumns({"compact": compact_udf(*fields, *(["examples"] if include_examples else [])), "json": json_udf(*fields)})


def prompt(blocks: Column, style: str = "compact", header: bool = True) -> Column:
    """The prompt of an array of blocks in rank order; the no-match text for none."""
    if style not in ("compact", "json"):
        raise ValueError(f"style must be 'compact' or 'json', got {style!r}")
    n = F.size(blocks)
    body = F.array_join(blocks, "\n") if style == "compact" else F.concat(F.lit("[\n"), F.array_join(blocks, ",\n"), F.lit("\n]"))
    intro = F.format_string(HEADER + "\n\n", n, F.when(n == 1, "tool").otherwise("tools"))
    return F.when(n == 0, NO_MATCH).otherwise(F.concat(intro, body) if header else body)


def prompt_tokens(blocks: Column, style: str = "compact") -> Column:
    """Estimated tokens of the headerless block; 0 for no items."""
    return F.when(F.size(blocks) == 0, F.lit(0).cast("long")).otherwise(token_estimate(prompt(blocks, style, header=False)))


def function_schemas(items):
    """Items as function-calling envelopes in a JSON column ``schema``; the server stands in the description."""
    parameters = F.coalesce("parameters", F.lit('{"type":"object","properties":{}}'))
    described = F.when(F.col("server") != "", F.concat(F.lit("["), "server", F.lit("] "), "description")).otherwise(F.col("description"))
    head = F.to_json(F.struct(F.col("name"), described.alias("description")))
    whole = F.concat(F.lit('{"type":"function","function":'), F.regexp_replace(head, r"\}$", ""), F.lit(',"parameters":'), parameters, F.lit("}}"))
    return items.withColumn("schema", whole)
