"""Document log-likelihoods under a subword lattice.

The pieces and their first scores come from an existing vocabulary. A text is its words, each
behind a word mark, and one end; every way to segment it into pieces counts, weighted by the
product of piece probabilities, and a forward recursion sums over them: in log space for words of SHORT
characters or more, and for shorter ones in plain probabilities wherever their sum is at least LEAST, else
(many unknown characters) in log space too. Shorter words go through the recursion together, SLICE at a time, with
arrays: a step takes all words from one place to the next. Each word seen in
training is one more piece, over all of the word. Two rounds of expected counts over all training
documents fit the pieces' probabilities and the share of whole words to the corpus (a word's own
occurrence left out of its count, so that rare words leave mass to pieces). All pieces, one
"any character" event and the end share a total probability of 1, so scores of different texts add
up to at most 1.

Documents are dealt into blocks by a hash. A block sends each of its distinct words once, with a count; totals and
lattice scores come back once a block and word; texts are then scored block by block. So what is shuffled
is the texts and each block's distinct words, never every token.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, written

HELD_OUT = 10
MARK = "▁"
END = b""
ROUNDS = 2
SMOOTHING = 0.1
#: Characters of a word from which sums are formed in log space only.
SHORT = 32
#: Least sum of a shorter word that is taken from plain probabilities. What passes through a point where they get
#: lost or lose digits (under 2.3e-308) is at most that much, as no sum over a rest is above 1.
LEAST = 1e-280
#: Shorter words whose sums are formed together.
SLICE = 10_000
BLOCK_CHARS = 16_000_000
#: Texts that are split together.
SPLIT_BYTES = 4_000_000
LEAST_BLOCKS = 16
#: Codes of characters whose steps stand in a table by node.
COMMON = 64
#: Code points that the "any character" event is spread over.
CHARACTERS = 0x110000
ANY, STOP, WHOLE = "\0any", "\0end", "\0whole"

LOG10 = math.log(10)


def first_model(scored: Iterable[tuple[str, float]]) -> dict[str, float]:
    """Log probabilities from a vocabulary's (piece, score): scores are ranks below zero, taken by Zipf's law.

    Pieces may hold the word mark at their front only.
    """
    weights = {p: 1 / (10 + max(0.0, -s)) for p, s in scored if p and MARK not in p[1:]}
    weights |= {ANY: min(weights.values(), default=1.0), STOP: 1 / 1000}
    weights[WHOLE] = sum(weights.values())
    total = sum(weights.values())
    return {p: math.log(w / total) for p, w in weights.items()}


class Lattice:
    """Forward and backward sums over the segmentations of marked words.

    ``train_tokens`` is what counts of whole words are divided by.
    """

    def __init__(self, model: dict[str, float], train_tokens: int = 0) -> None:
        self.pieces = {p: v for p, v in model.items() if p not in (ANY, STOP, WHOLE)}
        self.whole = model[WHOLE] - math.log(max(1, train_tokens))
        # Probabilities of pieces, and 0 for what only begins a piece: a walk ends where nothing goes on.
        self.paths = {p[:k]: 0.0 for p in self.pieces for k in range(1, len(p))} | {p: math.exp(v) for p, v in self.pieces.items()}
        self.any = model[ANY] - math.log(CHARACTERS)
        self.stop = model[STOP]
        # The same walks for arrays: a path is a node from 1 on, 0 is the start and, as a piece, any character. Characters have codes,
        # the most frequent first; code 0 goes on nowhere. Steps by other than COMMON codes are looked for in a sorted array.
        self.names = [ANY, *self.paths]
        self.weights = np.array([math.exp(self.any), *self.paths.values()])
        nodes = dict(zip(self.paths, range(1, len(self.names)), strict=True)) | {"": 0}
        letters = {c: k for k, (c, _) in enumerate(Counter([p[-1] for p in self.paths]).most_common(), 1)}
        self.codes = np.zeros(CHARACTERS, np.int64)
        self.codes[[ord(c) for c in letters]] = list(letters.values())
        self.span = len(letters) + 1
        came = np.array([nodes[p[:-1]] for p in self.paths], np.int64)
        code = np.array([letters[p[-1]] for p in self.paths], np.int64)
        often = code < COMMON
        self.near = np.zeros(len(self.names) * COMMON, np.int32)
        self.near[came[often] * COMMON + code[often]] = np.flatnonzero(often) + 1
        steps = (came * self.span + code)[~often]
        order = np.argsort(steps)
        self.steps, self.targets = np.append(steps[order], np.iinfo(np.int64).max), np.append((np.flatnonzero(~often) + 1)[order], 0)

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The nodes that codes lead to; 0 where nothing goes on."""
        rare = np.flatnonzero(code >= COMMON)
        if not len(rare):
            return self.near[node * COMMON + code]
        to = self.near[node * COMMON + np.where(code < COMMON, code, 0)]
        wanted = node[rare] * self.span + code[rare]
        found = np.searchsorted(self.steps, wanted)
        to[rare] = np.where(self.steps[found] == wanted, self.targets[found], 0)
        return to

    def edges(self, text: str) -> list[list[tuple[int, float, str]]]:
        """By end: (start, log probability, piece) of every piece there."""
        get, n = self.paths.get, len(text)
        into: list[list[tuple[int, float, str]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            into[i + 1].append((i, self.any, ANY))
            for j in range(i + 1, n + 1):
                piece = text[i:j]
                p = get(piece)
                if p is None:
                    break
                if p:
                    into[j].append((i, self.pieces[piece], piece))
        return into

    def forward(self, into: list[list[tuple[int, float, str]]]) -> list[float]:
        a = [0.0] * len(into)
        for j in range(1, len(into)):
            terms = [a[i] + p for i, p, _ in into[j]]
            top = max(terms)
            a[j] = top + math.log(sum([math.exp(t - top) for t in terms])) if len(terms) > 1 else top
        return a

    def score(self, word: str, count: int = 0) -> float:
        """Log probability of a word that training has ``count`` times; of the end for an empty one."""
        return float(self.scores([word], [count])[0])

    def scores(self, words: list[str], counts: list[int]) -> np.ndarray:
        """Log probabilities of words that training has so many times."""
        parts, times = np.full(len(words), -np.inf), np.array(counts, float)
        for chosen in _short(words):
            sums = _Sums(self, [words[k] for k in chosen])
            good = sums.totals >= LEAST
            parts[chosen[good]] = np.log(sums.totals[good])
        for k in np.flatnonzero(np.isneginf(parts)):
            parts[k] = self.forward(self.edges(MARK + words[k]))[-1] if words[k] else self.stop
        known = times > 0
        parts[known] = np.logaddexp(parts[known], self.whole + np.log(times[known]))
        return parts

    def expect(self, word: str, times: int, into_counts: dict[str, float]) -> None:
        """Add the pieces expected in ``times`` occurrences of a training word that occurs no more."""
        self.expect_all([word], [times], into_counts)

    def expect_all(self, words: list[str], times: list[int], into_counts: dict[str, float]) -> None:
        """``expect`` of each word.

        Short words are summed over in probabilities, longer ones and those whose sum is under LEAST in log space.
        """
        n, rest = np.array(times, float), np.ones(len(words), bool)
        for chosen in _short(words):
            sums = _Sums(self, [words[k] for k in chosen])
            good = sums.totals >= LEAST
            each = np.zeros(len(chosen))
            each[good] = self._in_parts(np.log(sums.totals[good]), n[chosen[good]], into_counts) / sums.totals[good]
            found = sums.expected(each)
            for k in np.flatnonzero(found).tolist():
                into_counts[self.names[k]] += float(found[k])
            rest[chosen[good]] = False
        for k in np.flatnonzero(rest):
            if words[k]:
                self._expect_long(MARK + words[k], n[k], into_counts)
            else:
                into_counts[STOP] += float(self._in_parts(np.array([self.stop]), n[k : k + 1], into_counts)[0])

    def _in_parts(self, parts: np.ndarray, times: np.ndarray, into_counts: dict[str, float]) -> np.ndarray:
        """The occurrences that aren't the whole word's own piece, by word; those that are, are added."""
        share = np.zeros(len(parts))
        more = times > 1
        whole = self.whole + np.log(times[more] - 1)
        share[more] = np.exp(whole - np.logaddexp(parts[more], whole))
        if more.any():
            into_counts[WHOLE] += float(times @ share)
        return times * (1 - share)

    def _expect_long(self, text: str, times: float, into_counts: dict[str, float]) -> None:
        into = self.edges(text)
        a = self.forward(into)
        each = float(self._in_parts(np.array([a[-1]]), np.array([times], float), into_counts)[0])
        back = [-math.inf] * len(into)
        back[-1] = 0.0  # log probability of all ways from here to the end
        for j in range(len(into) - 1, 0, -1):
            for i, p, piece in into[j]:
                after = p + back[j]
                into_counts[piece] += each * math.exp(min(0.0, a[i] + after - a[-1]))
                back[i] = _sum(back[i], after)


def _short(words: list[str]) -> Iterator[np.ndarray]:
    """Places of the words of 1 to SHORT - 1 characters, SLICE at a time."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    places = np.flatnonzero((lengths > 0) & (lengths < SHORT))
    for k in range(0, len(places), SLICE):
        yield places[k : k + SLICE]


class _Sums:
    """Plain probabilities of some short words, by a forward recursion over all of them at once.

    The words lie behind each other, each with its mark and with one place more for its end. Edges are ordered by the place in the
    word that they start at, so that a word's sums are added in the same order whatever words are beside it.
    """

    def __init__(self, lattice: Lattice, words: list[str]) -> None:
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        self.ends = np.cumsum(sizes) - 1
        begins = self.ends + 1 - sizes
        codes = lattice.codes[np.frombuffer((MARK + f"\n{MARK}".join(words) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)]
        codes[self.ends] = 0
        places = np.ones(len(codes), bool)
        places[self.ends] = False
        at = np.flatnonzero(places)
        starts, lengths, nodes = [at], [1], [np.zeros(len(at), np.int64)]
        node, length = nodes[0], 0
        while len(at):
            to = lattice.step(node, codes[at + length])
            on = np.flatnonzero(to)
            at, node, length = at[on], to[on].astype(np.int64), length + 1
            whole = np.flatnonzero(lattice.weights[node])
            starts.append(at[whole])
            lengths.append(length)
            nodes.append(node[whole])
        self.word = np.repeat(np.arange(len(words)), sizes)
        start = np.concatenate(starts)
        column = (start - begins[self.word[start]]).astype(np.uint16)
        order = np.argsort(column, kind="stable")
        self.start, self.node = start[order], np.concatenate(nodes)[order]
        self.end = (start + np.repeat(lengths, [len(s) for s in starts]))[order]
        self.weight = lattice.weights[self.node]
        self.size = len(lattice.weights)
        bounds = [0, *np.cumsum(np.bincount(column)).tolist()]
        self.columns = [slice(i, j) for i, j in zip(bounds, bounds[1:], strict=False)]
        self.a = np.zeros(len(codes))
        self.a[begins] = 1.0
        for c in self.columns:
            np.add.at(self.a, self.end[c], self.a[self.start[c]] * self.weight[c])
        self.totals = self.a[self.ends]

    def expected(self, each: np.ndarray) -> np.ndarray:
        """By node: its occurrences, where each word's paths count ``each`` times their probabilities."""
        back = np.zeros(len(self.a))
        back[self.ends] = 1.0
        for c in reversed(self.columns):
            np.add.at(back, self.start[c], self.weight[c] * back[self.end[c]])
        x = self.a * each[self.word]
        return np.bincount(self.node, x[self.start] * (self.weight * back[self.end]), self.size)


def _sum(x: float, y: float) -> float:
    """log(exp(x) + exp(y))"""
    low, high = (x, y) if x < y else (y, x)
    return high + math.log1p(math.exp(low - high)) if low > -math.inf else high


def refit(model: dict[str, float], counts: dict[str, float]) -> dict[str, float]:
    total = sum(counts.values()) + SMOOTHING * len(model)
    return {p: math.log((counts.get(p, 0.0) + SMOOTHING) / total) for p in model}


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(block, rows) of batches sorted by block, a slice at a time."""
    for batch in batches:
        blocks = batch.column("block").to_pylist()
        at = 0
        for k in range(1, len(blocks) + 1):
            if k == len(blocks) or blocks[k] != blocks[at]:
                yield blocks[at], batch.slice(at, k - at)
                at = k


def split_texts(texts: pa.Array) -> Iterator[tuple[slice, pa.Array, np.ndarray]]:
    """``split_words`` of many texts, about SPLIT_BYTES at a time: (rows, their words behind each other, number of words by row)."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SPLIT_BYTES, side="right")))
        # Both functions know ASCII only. A blank at either end of a text leaves an empty word.
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.slice(at, to - at), "")))
        words, sizes = lists.flatten(), lists.value_lengths().to_numpy()
        full = pc.greater(pc.binary_length(words), 0)
        if full.false_count:
            words, sizes = words.filter(full), np.bincount(pc.list_parent_indices(lists).filter(full).to_numpy(), minlength=to - at)
        del lists, full
        yield slice(at, to), words, sizes
        at = to
    # What Arrow keeps for later would stay in idle workers.
    pa.default_memory_pool().release_unused()


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each block with their training counts (0 for words of held-out rows alone)."""

    def out(block: int, counts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        whole = pa.concat_tables(counts).group_by("word", use_threads=False).aggregate([("n", "sum")])
        for part in whole.select(["word", "n_sum"]).to_batches(max_chunksize=50_000):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block, np.int64)), *part.columns], names=["block", "word", "n"])

    def counted(words: pa.Array, n: np.ndarray) -> pa.Table:
        return pa.table({"word": words.cast(pa.string()), "n": pa.array(n, pa.int64())})

    now, counts = None, []
    for block, rows in _runs(batches):
        if block != now:
            if now is not None:
                yield from out(now, counts)
            now, counts = block, []
        trained = ~rows.column("held_out").to_numpy(zero_copy_only=False)
        counts.append(counted(pa.array([END.decode()]), np.array([trained.sum()])))
        for at, words, sizes in split_texts(rows.column("text")):
            coded = words.dictionary_encode()
            of_trained = coded.indices.to_numpy()[np.repeat(trained[at], sizes)]
            counts.append(counted(coded.dictionary, np.bincount(of_trained, minlength=len(coded.dictionary))))
    if now is not None:
        yield from out(now, counts)


SCHEMA = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def score_documents(docs: DataFrame, make_vocabulary: Callable[[], list[tuple[str, float]]], rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, one row per input row.

    Trained on the rows with crc32(doc_id as text) modulo HELD_OUT other than 0; ``score`` is the
    model's log10 probability of the text, ``base_score`` that of smoothed word counts. Tokens
    are runs without ASCII blanks, A-Z lower-cased, and one end. ``make_vocabulary`` gives (piece, score) pairs.

    A null or empty text is the end alone. A row with null doc_id is scored as held out. Rows that repeat
    count each time. Without training rows counts are 0 and the model is the vocabulary's own. Other
    columns are not read; an empty table gives an empty table.
    """
    held = F.coalesce(crc_bucket(F.col("doc_id"), HELD_OUT) == 0, F.lit(True))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = max(LEAST_BLOCKS, math.ceil(chars / BLOCK_CHARS))
    block = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(n_blocks)).cast("long")
    dealt = docs.select("doc_id", held.alias("held_out"), "text", block.alias("block"))
    words = written(
        dealt.select("block", "held_out", "text").repartition(n_blocks, "block").sortWithinPartitions("block").mapInArrow(
            count_words, "block long, word string, n long"
        ),
        "block-words",
    )
    counted = written(words.groupBy("word").agg(F.sum("n").alias("c")), "word-counts")
    totals = counted.repartition(n_blocks)
    n, v = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    model = first_model(make_vocabulary())

    def expected(model: dict[str, float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice, counts = Lattice(model, n), defaultdict(float)
            for batch in batches:
                lattice.expect_all(batch.column("word").to_pylist(), batch.column("c").to_pylist(), counts)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.float64())], names=["piece", "x"])

        return run

    for _ in range(rounds if n else 0):
        found = totals.where("c > 0").mapInArrow(expected(model), "piece string, x double")
        # At most a row for each piece of the vocabulary comes to the driver.
        model = refit(model, {r[0]: r[1] for r in found.groupBy("piece").agg(F.sum("x")).collect()})

    def lattice_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(model, n)
        for batch in batches:
            scores = lattice.scores(batch.column("word").to_pylist(), batch.column("c").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("c"), pa.array(scores, pa.float64())], names=["word", "c", "s"]
            )

    scored = totals.mapInArrow(lattice_scores, "word string, c long, s double")
    told = words.select("block", "word").join(scored, "word").select("block", "word", "c", "s")
    bottom = math.log(n + 0.1 * (v + 1))

    def of_block(left: pa.Table, right: pa.Table) -> pa.Table:
        words = right.column("word").combine_chunks()
        count, full = right.column("c").to_numpy().astype(float), right.column("s").to_numpy()
        known, base = count > 0, np.log(count + 0.1) - bottom
        end = pc.index(words, END.decode()).as_py()
        rows = []
        for texts in left.column("text").chunks:
            for _, found, sizes in split_texts(texts):
                at = pc.index_in(found, value_set=words).to_numpy()
                of_known, of_base, of_full = known[at], base[at], full[at]
                ends = np.cumsum(sizes).tolist()
                for i, j in zip([0, *ends], ends, strict=False):
                    sums = [float(of[i:j].sum() + last) / LOG10 for of, last in ((of_base, base[end]), (of_full, full[end]))]
                    rows.append((j - i + 1, int(of_known[i:j].sum()) + int(known[end]), n, *sums))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        numbers = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        return pa.table([left.column("doc_id").cast(pa.int64()), left.column("held_out"), *numbers], names=names)

    return dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(of_block, SCHEMA)


def sentencepiece_scores(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model, without control, unknown and byte pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        (m.id_to_piece(i), m.get_score(i))
        for i in range(m.get_piece_size())
        if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))
    ]
