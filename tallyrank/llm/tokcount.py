"""Counts of greedy longest-match pieces, by an automaton that never builds the pieces.

The vocabulary is a trie. Each node has a failure link, the node where matching goes on once no
longer piece fits, and the precomputed count of tokens popped on that way. So a word is read
once, left to right, with a constant number of steps a character on average.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import split_words

#: Distinct words a task remembers the counts of.
CACHE = 300_000
SCHEMA = "doc_id long, n_words long, n_tokens long, n_fallback long"


class PieceAutomaton:
    """Counter of the pieces that greedy longest match cuts ``prefix`` + word into.

    Where no piece matches, one character is cut off; it costs a token for each of its UTF-8 bytes
    and is counted as a fallback.
    """

    def __init__(self, pieces: Iterable[str], prefix: str = "") -> None:
        vocabulary = {p for p in pieces if p}
        self.prefix = prefix
        self.next: list[dict[str, int]] = [{}]
        ends: dict[int, tuple[int, int]] = {}
        # Each character is a node, so that every way down the trie can be popped to its end.
        for piece in [*sorted({c for p in vocabulary for c in p}), *vocabulary]:
            at = 0
            for c in piece:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                at = self.next[at][c]
            if piece in vocabulary:
                ends[at] = (1, 0)
            else:
                ends[at] = (_bytes(piece), 1)
        self.fail, self.pops, self.lost = [0] * len(self.next), [0] * len(self.next), [0] * len(self.next)
        level = [(0, c, v) for c, v in self.next[0].items()]
        while level:
            for u, c, v in level:
                if v in ends:
                    self.pops[v], self.lost[v] = ends[v]
                    continue
                back, pops, lost = self.fail[u], self.pops[u], self.lost[u]
                while c not in self.next[back]:
                    pops, lost, back = pops + self.pops[back], lost + self.lost[back], self.fail[back]
                self.fail[v], self.pops[v], self.lost[v] = self.next[back][c], pops, lost
            level = [(v, d, w) for _, _, v in level for d, w in self.next[v].items()]

    def count(self, word: str) -> tuple[int, int]:
        """Tokens of prefix + word, and how many of its characters fell back to bytes."""
        step, fail, pops, lost = self.next, self.fail, self.pops, self.lost
        at = tokens = fallback = 0
        for c in self.prefix + word:
            while at and c not in step[at]:
                tokens, fallback, at = tokens + pops[at], fallback + lost[at], fail[at]
            if c in step[at]:
                at = step[at][c]
            else:
                tokens, fallback = tokens + _bytes(c), fallback + 1
        while at:
            tokens, fallback, at = tokens + pops[at], fallback + lost[at], fail[at]
        return tokens, fallback


def _bytes(c: str) -> int:
    return len(c.encode("utf-8", "surrogatepass"))


def sentencepiece_pieces(path: str) -> list[str]:
    """The pieces of a sentencepiece model, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


def count_tokens(docs: DataFrame, make_automaton: Callable[[], PieceAutomaton]) -> DataFrame:
    """doc_id, n_words, n_tokens and n_fallback (characters cut to bytes), one row per input row.

    Words are runs without U+0020 and U+0009 to U+000D, each counted by the automaton by itself;
    whole texts, no shuffle. ``make_automaton`` runs once a task. A null or empty text has no words
    and no tokens; a word of any length takes linear time; repeated rows give repeated results; a
    null doc_id is kept; other columns are not read; an empty table gives an empty table.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = make_automaton()
        known: dict[bytes, tuple[int, int]] = {}
        for batch in batches:
            out = []
            for text in batch.column("text"):
                words = split_words(text.as_py(), lower=False)
                if len(known) > CACHE:
                    known.clear()
                for w in {w for w in words if w not in known}:
                    known[w] = automaton.count(w.decode("utf-8", "surrogatepass"))
                counts = [known[w] for w in words]
                out.append((len(words), sum(n for n, _ in counts), sum(n for _, n in counts)))
            columns = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in columns)],
                names=["doc_id", "n_words", "n_tokens", "n_fallback"],
            )

    return docs.select("doc_id", "text").mapInArrow(count, SCHEMA)
