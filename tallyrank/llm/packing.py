"""Packing of token sequences into windows by the sum-of-squares rule.

Each task packs the rows it reads, in order and without a shuffle: it tokenises a text, cuts full
windows off its front and places the rest into the open window whose fill level makes the sum over
levels of squared window counts smallest. ``levels[h]`` counts the open windows filled to ``h``.
When a task has read all (or holds too many open windows) the open windows' pieces are strung
together and cut into full windows; what is left at the very end is cut into powers of two.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

WINDOW = 1024
END = 0
#: Open windows a task holds before it strings them together.
MAX_OPEN = 4096
#: Distinct words a task remembers the ids of.
CACHE = 300_000
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)
#: Sequence ids of a task lie in a block of this many.
STRIDE = 1 << 36

_AFTER_TEXT = re.compile(r"(?<=\S) ")
_SPECIAL = "<|endoftext|>"


def byte_bpe(json_path: str, ranks_path: str, pattern: str) -> Callable[[str], bytes]:
    """A function from text to its ids (little-endian 32 bit) under the vocabulary of ``json_path``.

    Ids are those of the ``tokenizers`` library without added tokens. The same vocabulary as ranks
    gives them several times faster for text without the special token's string. Pre-tokens
    never hold a space but at their front (or in runs of white space), so a text may be cut before
    each space that follows a non-blank, and each cut's ids are remembered.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    slow = None
    known: dict[str, bytes] = {}

    def packed(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def ids_of(text: str) -> bytes:
        nonlocal slow
        if _SPECIAL in text:
            slow = slow or Tokenizer.from_file(json_path)
            return packed(slow.encode(text, add_special_tokens=False).ids)
        first, *rest = _AFTER_TEXT.split(text)
        if len(known) > CACHE:
            known.clear()
        for word in {w for w in rest if w not in known}:
            known[word] = packed(fast.encode_ordinary(" " + word))
        return packed(fast.encode_ordinary(first)) + b"".join([known[w] for w in rest])

    return ids_of


class SumOfSquares:
    """Online packer. ``add`` and ``finish`` yield closed windows as lists of (document, start, ids)."""

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN) -> None:
        self.window, self.max_open = window, max_open
        self.levels = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list]] = {}

    def place(self, size: int) -> int:
        """The level to add ``size`` ids to; 0 is a new window. Of equal levels the fullest."""
        n, w = self.levels, self.window
        # Change of the sum of squares when a window goes from level h to h + size (a full one counts no more).
        to = n[size : w + 1]
        change = 2 * (to - n[: w + 1 - size]) + 2
        change[w - size] = 1 - 2 * n[w - size]
        change[0] = 2 * n[size] + 1 if size < w else 0
        usable = n[: w + 1 - size] > 0
        usable[0] = True
        at = np.flatnonzero(usable)
        best = at[::-1][np.argmin(change[at][::-1])]
        return int(best)

    def add(self, doc: tuple, ids: np.ndarray) -> Iterator[list]:
        w = self.window
        full = len(ids) // w * w
        for k in range(0, full, w):
            yield [(doc, k, ids[k : k + w])]
        if full == len(ids):
            return
        piece, size = (doc, full, ids[full:].copy()), len(ids) - full
        level = self.place(size)
        if level:
            held = self.open[level].pop()
            self.levels[level] -= 1
        else:
            held = []
        held.append(piece)
        if level + size == w:
            yield held
        else:
            self.open.setdefault(level + size, []).append(held)
            self.levels[level + size] += 1
            if int(self.levels.sum()) >= self.max_open:
                yield from self.string(last=False)

    def string(self, last: bool) -> Iterator[list]:
        """Cut the pieces of all open windows into full ones; the tail stays open or, at last, is
        cut into powers of two, which need no padding."""
        pieces = [p for h in sorted(self.open, reverse=True) for held in self.open[h] for p in held]
        self.open, self.levels = {}, np.zeros(self.window + 1, np.int64)
        left = sum(len(ids) for _, _, ids in pieces)
        room = self.next_size(left, last)
        held: list = []
        for doc, start, ids in pieces:
            while len(ids):
                if not room:
                    room = self.next_size(left, last)
                cut = min(room, len(ids))
                held.append((doc, start, ids[:cut]))
                ids, start, room, left = ids[cut:], start + cut, room - cut, left - cut
                if not room and (last or sum(len(x[2]) for x in held) == self.window):
                    yield held
                    held = []
        if held:
            level = sum(len(x[2]) for x in held)
            self.open[level] = [held]
            self.levels[level] = 1

    def next_size(self, left: int, last: bool) -> int:
        return min(self.window, 1 << (left.bit_length() - 1) if last and left < self.window and left else self.window)

    def finish(self) -> Iterator[list]:
        yield from self.string(last=True)


def pack_documents(docs: DataFrame, make_ids: Callable[[], Callable[[str], bytes]], window: int = WINDOW, max_open: int = MAX_OPEN) -> DataFrame:
    """Pack all ``docs`` (doc_id, text) into sequences of at most ``window`` ids; one row per piece.

    ``make_ids`` builds, once a task, the function from text to little-endian 32-bit ids; id 0 is
    added to each document. Columns: doc_id, start (its document's ids before the piece), length,
    ids_crc32 (of the ids as little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.
    A sequence id is unique over tasks. Sequences are full or a power of two long.

    A null or empty text is the single id 0. Repeated rows, also of one doc_id, are documents
    of their own; a null doc_id is kept; other columns are not read; an empty table gives an empty table.
    Each task's result depends only on its own rows, so a lost task can be run again alone.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = make_ids()
        packer = SumOfSquares(window, max_open)
        sequence = TaskContext.get().partitionId() * STRIDE
        rows: list[tuple] = []

        def note(windows: Iterator[list]) -> None:
            nonlocal sequence
            for held in windows:
                offset = 0
                for (doc_id, total), start, ids in held:
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, offset))
                    offset += len(ids)
                sequence += 1

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.frombuffer(ids_of(text.as_py() or "") + END.to_bytes(4, "little"), "<u4")
                note(packer.add((doc_id, len(ids)), ids))
                if len(rows) >= 10_000:
                    yield as_batch(rows)
                    rows = []
        note(packer.finish())
        if rows:
            yield as_batch(rows)

    return docs.select("doc_id", "text").mapInArrow(pack, SCHEMA)


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)
