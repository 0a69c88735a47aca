"""Scores of many queries against an index of items, without moving a query.

The index (texts of the items, hashed vectors, BM25 weights) is the small side: it is collected behind a
check of its size and sent to each task once. Queries are the big side and stay where they are read: a
row gets its k best items as an array, and all later steps (gate, selection, explanation) are expressions of that
row, so no route shuffles anything. Beyond the bound use ``bm25.scores_by_join`` and ``dense.top_k_vectors``.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import Embedder, HashEmbedder, best_places, tokens_of, unit
from .bm25 import EMPTY, K1, B

#: Bytes of item texts up to which an index is built and sent to the tasks.
INDEX_BYTES = 32 << 20
INDEX_ITEMS = 100_000
DENSE_WEIGHT = 0.7
#: Decimals in which scores are compared; ties go to the smaller item id.
DECIMALS = 9
FLAT = 1e-12

#: Scores (queries times items) that a task holds at once.
HELD_SCORES = 4_000_000
CANDIDATE_FIELDS = "item_id:bigint,score:double,dense:double,bm25:double,dense_raw:double,bm25_raw:double,rank:int"


class ItemIndex:
    """Dense matrix and BM25 term weights of the items, in order of item_id."""

    def __init__(self, ids: list[int], texts: list[str], embedder: Embedder | None = None) -> None:
        self.embedder = embedder or HashEmbedder()
        self.ids, self.texts, self.dim = ids, texts, self.embedder.dim
        self.matrix = unit(np.array([self.embedder.embed(t) for t in texts], float).reshape(len(texts), self.dim))
        tokens = [tokens_of(t) or [EMPTY] for t in texts]
        lengths = np.array([len(t) for t in tokens], float)
        mean = lengths.mean() if len(tokens) else 1.0
        df = Counter(t for ts in tokens for t in set(ts))
        by_term: dict[str, list[tuple[int, float]]] = {}
        for i, ts in enumerate(tokens):
            for t, tf in Counter(ts).items():
                weight = max(0.0, np.log(1 + (len(tokens) - df[t] + 0.5) / (df[t] + 0.5)))
                by_term.setdefault(t, []).append((i, weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[i] / mean))))
        self.terms = {t: (np.array([i for i, _ in p]), np.array([w for _, w in p])) for t, p in by_term.items()}

    def __getstate__(self) -> dict:
        """Embedders may be classes that the tasks can't import."""
        return self.__dict__ | {"embedder": cloudpickle.dumps(self.embedder)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state | {"embedder": cloudpickle.loads(state["embedder"])}

    def bm25(self, tokens: list[str]) -> np.ndarray:
        """Scores of all items; a repeated query token counts each time."""
        found = [(self.terms[t], n) for t, n in Counter(tokens).items() if t in self.terms]
        if not found:
            return np.zeros(len(self.ids))
        return np.bincount(np.concatenate([p[0] for p, _ in found]), np.concatenate([p[1] * n for p, n in found]), minlength=len(self.ids))


def check_size(items: DataFrame, *texts: Column) -> int:
    """The number of items; ValueError where they or their texts are too many to collect and send to tasks."""
    size = sum((F.coalesce(F.octet_length(t), F.lit(0)) for t in texts), F.lit(0))
    told = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    if told[0] > INDEX_ITEMS or told[1] > INDEX_BYTES:
        raise ValueError(f"{told[0]} items of {told[1]} bytes are too large an index; use the join forms")
    return told[0]


def build_index(items: DataFrame, embedder: Embedder | None = None) -> ItemIndex:
    """Collect the items (item_id, text) of a catalogue; ValueError where it is too large to send to tasks.

    Ids must be unique and not null; a null text is an empty one. Texts are embedded by feature hashes if no other embedder is given.
    """
    if check_size(items, F.col("text")) != items.agg(F.count_distinct("item_id")).first()[0]:
        raise ValueError("item ids must be unique and not null")
    rows = sorted((r["item_id"], r["text"] or "") for r in items.select("item_id", "text").collect())
    return ItemIndex([r[0] for r in rows], [r[1] for r in rows], embedder)


def min_max(scores: np.ndarray) -> np.ndarray:
    """Each row scaled to 0..1; a flat row becomes 1s, or 0s if nothing is over 0."""
    if not scores.shape[1]:
        return scores
    low, high = scores.min(axis=1, keepdims=True), scores.max(axis=1, keepdims=True)
    flat = high - low <= FLAT
    return np.where(flat, (high > 0).astype(float), (scores - low) / np.where(flat, 1.0, high - low))


def retrieve(
    queries: DataFrame, index: ItemIndex, k: int, hybrid: bool | dict[str, bool] = False, dense_weight: float = DENSE_WEIGHT, query: str = "query",
    allowed: Iterable[int] | None = None, gold: bool = False, attach: dict[str, list[str]] | None = None, timed: bool = False,
) -> DataFrame:
    """The columns of ``queries`` with ``candidates``: the k best items as structs, best first.

    Dense scores are cosines clamped to 0..1; hybrid scores blend the min-max scaled dense and BM25 scores of all items; ties go to the
    smaller item id. Blank and null queries and k <= 0 get no candidates. With ``allowed`` item ids the candidates are
    filtered after an over-fetch (all for hybrid, else the best max(4k, 20)), so fewer than k may be left.

    ``hybrid`` may name several columns of candidates, each dense or hybrid, that are made from the same scores. ``gold`` adds a column with
    the smallest id of an item whose text stands in the query. ``attach`` adds text fields to the candidates, each with a text for every item.
    ``timed`` adds for each column of candidates, as <column>_ms, the milliseconds that a row's scores and ranking took on average in its batch.

    All of a row's work (scores, blend, the k best) is done in the task that reads it, and only k items a row leave it.
    """
    if not 0 <= dense_weight <= 1:
        raise ValueError(f"dense_weight must be in [0, 1], got {dense_weight}")
    columns = hybrid if isinstance(hybrid, dict) else {"candidates": hybrid}
    fields, attach = queries.schema, attach or {}
    struct = f"array<struct<{CANDIDATE_FIELDS}{''.join(f',{c}:string' for c in attach)}>>"
    more = {c: struct for c in columns} | ({f"{c}_ms": "double" for c in columns} if timed else {}) | ({"gold": "long"} if gold else {})
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"{c} {kind}" for c, kind in more.items())])
    at = fields.names.index(query)
    open_to = None if allowed is None else np.isin(np.array(index.ids, np.int64), np.array(list(allowed), np.int64))
    shared = queries.sparkSession.sparkContext.broadcast((index, open_to, attach))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, open_to, attach = shared.value
        embedder, ids = index.embedder, np.array(index.ids, np.int64)
        extra = {c: pa.array(v, pa.string()) for c, v in attach.items()}
        step = max(1, HELD_SCORES // max(1, len(ids)))
        for whole in batches:
            for batch in (whole.slice(i, step) for i in range(0, len(whole), step)):
                texts = [t.as_py() or "" for t in batch.column(at)]
                made, spent = [], []
                if columns:
                    asked, began = np.array([bool(t.strip(" ")) for t in texts], bool), time.perf_counter()
                    dense = np.clip(unit(np.array([embedder.embed(t) for t in texts], float).reshape(len(texts), index.dim)) @ index.matrix.T, 0.0, 1.0)
                    by_dense = time.perf_counter() - began
                    bm25 = np.array([index.bm25(tokens_of(t)) for t in texts]).reshape(len(texts), len(ids))
                    scaled = min_max(dense), min_max(bm25)
                    by_both = time.perf_counter() - began
                    for h in columns.values():
                        began = time.perf_counter()
                        made.append(_candidates((dense, bm25), scaled, ids, asked, k, h, dense_weight, open_to, extra))
                        spent.append(time.perf_counter() - began + (by_both if h else by_dense))
                if timed:
                    made += [pa.array(np.full(len(texts), 1000 * s / max(1, len(texts)))) for s in spent]
                if gold:
                    made.append(pa.array([next((i for i, x in zip(index.ids, index.texts, strict=True) if x and x in t), None) for t in texts], pa.int64()))
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*fields.names, *more])

    return queries.mapInArrow(run, schema)


def _candidates(
    raw: tuple[np.ndarray, np.ndarray], scaled: tuple[np.ndarray, np.ndarray], ids: np.ndarray, asked: np.ndarray, k: int, hybrid: bool, weight: float,
    open_to: np.ndarray | None, extra: dict[str, pa.Array],
) -> pa.ListArray:
    """A list of structs for each row of scores."""
    score = weight * scaled[0] + (1 - weight) * scaled[1] if hybrid else raw[0]
    fetched = k if open_to is None else len(ids) if hybrid else max(4 * k, 20)
    found = best_places(np.round(score, DECIMALS), min(fetched, len(ids))) if k > 0 and len(ids) else np.zeros((len(asked), 0), np.int64)
    keep = np.broadcast_to(asked[:, None], found.shape)
    if open_to is not None:
        keep = keep & open_to[found]
        keep = keep & (np.cumsum(keep, axis=1) <= k)
    rank = np.cumsum(keep, axis=1)[keep]
    rows, place = np.nonzero(keep)[0], found[keep]
    parts = [pa.array(ids[place]), *(pa.array(x[rows, place]) for x in (score, *scaled, *raw)), pa.array(rank.astype(np.int32)), *(x.take(pa.array(place)) for x in extra.values())]
    names = ["item_id", "score", "dense", "bm25", "dense_raw", "bm25_raw", "rank", *extra]
    offsets = np.concatenate([[0], np.cumsum(keep.sum(axis=1))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(parts, names=names))


def looked_up(df: DataFrame, ids: list[int], texts: dict[str, list[str]], column: str = "candidates") -> DataFrame:
    """Add array columns with each candidate's text, null for unknown items. ``texts`` has lists by column name, in order of ``ids``.

    The items are the small side (an index's) and go to each task once; rows stay where they are.
    """
    fields = df.schema
    at = fields.names.index(column)
    order = np.argsort(np.array(ids, np.int64), kind="stable")
    shared = df.sparkSession.sparkContext.broadcast((np.array(ids, np.int64)[order], {c: [v[i] for i in order] for c, v in texts.items()}))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"`{c}` array<string>" for c in texts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, told = shared.value
        values = {c: pa.array(v, pa.string()) for c, v in told.items()}
        for batch in batches:
            lists = batch.column(at)
            asked = lists.flatten().field("item_id").to_numpy(zero_copy_only=False).astype(np.int64)
            place = np.searchsorted(known, asked)
            found = place < len(known)
            found[found] = known[place[found]] == asked[found]
            index = pa.array(np.where(found, place, 0), pa.int64(), mask=~found)
            offsets = np.concatenate([[0], np.cumsum(np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)))]).astype(np.int32)
            more = [pa.ListArray.from_arrays(pa.array(offsets), v.take(index)) for v in values.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*fields.names, *values])

    return df.mapInArrow(run, schema)


def exploded(df: DataFrame, *keep: str) -> DataFrame:
    """One row per candidate: the kept columns, item_id, score, rank and the score's parts."""
    return df.select(*keep, F.explode("candidates").alias("c")).select(*keep, "c.*")
