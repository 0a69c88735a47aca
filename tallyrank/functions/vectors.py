"""Vector functions as columns, and the feature hash of text embeddings."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 384
GRAM_WEIGHT = 0.35
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_TOKEN = re.compile(r"[a-z0-9]+")
_REMEMBERED = 200_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


def cosine01(a: Column, b: Column) -> Column:
    """Cosine of two normalised vectors, clamped to 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b)))


def vector_problem(v: Column, dim: int) -> Column:
    """Why a vector can't be indexed: null, dimension or not finite; null where it can."""
    finite = F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) != float("inf")) & x.isNotNull())
    return F.when(v.isNull(), "null").when(F.size(v) != dim, "dimension").when(~finite, "not finite")


def tokens_of(text: str | None) -> list[str]:
    """The Python form of ``text.tokenize``."""
    return _TOKEN.findall(_CAMEL.sub(" ", text or "").lower())


def best_places(keys: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest keys of each row, best first; equal keys in order of their places."""
    n = keys.shape[1]
    if k >= n or n <= 64:
        return np.argsort(-keys, axis=1, kind="stable")[:, :k]
    least = -np.partition(-keys, k - 1, axis=1)[:, k - 1]
    out = np.empty((len(keys), k), np.int64)
    for i, row in enumerate(keys):
        at = np.flatnonzero(row >= least[i])
        out[i] = at[np.argsort(-row[at], kind="stable")[:k]]
    return out


def unit(m: np.ndarray) -> np.ndarray:
    """Rows at length 1; zero rows stay."""
    norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


class Embedder(Protocol):
    """What an index needs: unit vectors of ``dim`` components. It is sent to the tasks once, pickled."""

    dim: int

    def embed(self, text: str | None) -> np.ndarray: ...


def embedded(df: DataFrame, embedder: Embedder, text: str = "text", vector: str = "embedding") -> DataFrame:
    """Add the vectors of a text column, a batch at a time; a null text has the vector of an empty one."""
    fields = df.schema
    at = fields.names.index(text)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{vector}` array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([embedder.embed(t.as_py()) for t in batch.column(at)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*fields.names, vector])

    return df.mapInArrow(run, schema)


class HashEmbedder:
    """Text to a normalised vector of damped hashed features: words at 1, their 3-grams at GRAM_WEIGHT.

    A feature's md5 gives its place (first 8 hex digits modulo ``dim``) and sign (top bit of the ninth).
    Each distinct token is hashed once and remembered.
    """

    def __init__(self, dim: int = DIM) -> None:
        self.dim = dim
        self._known: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def _feature(self, name: str, weight: float) -> tuple[int, float]:
        h = hashlib.md5(name.encode()).hexdigest()
        return int(h[:8], 16) % self.dim, -weight if h[8] >= "8" else weight

    def _token(self, token: str) -> tuple[np.ndarray, np.ndarray]:
        got = self._known.get(token)
        if got is None:
            padded = f"#{token}#"
            grams = [padded] if len(padded) <= 3 else [padded[i : i + 3] for i in range(len(padded) - 2)]
            places = [self._feature(f"w:{token}", 1.0), *(self._feature(f"g:{g}", GRAM_WEIGHT) for g in grams)]
            if len(self._known) > _REMEMBERED:
                self._known.clear()
            got = self._known[token] = (np.array([p for p, _ in places]), np.array([w for _, w in places]))
        return got

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        """A row for each text; TypeError for what isn't a text."""
        wrong = next((t for t in texts if not isinstance(t, str)), "")
        if wrong != "":
            raise TypeError(f"only texts can be embedded, not {type(wrong).__name__}")
        return np.array([self.embed(t) for t in texts]).reshape(len(texts), self.dim)

    def embed(self, text: str | None) -> np.ndarray:
        counts = Counter(tokens_of(text))
        found = [self._token(t) for t in counts]
        v = np.zeros(self.dim)
        if found:
            times = np.repeat(np.fromiter(counts.values(), float, len(counts)), [len(p) for p, _ in found])
            v = np.bincount(np.concatenate([p for p, _ in found]), np.concatenate([w for _, w in found]) * times, minlength=self.dim)
            v = np.sign(v) * np.log1p(np.abs(v))
            norm = np.sqrt(v @ v)
            v = v / norm if norm > 0 else v
        return v
