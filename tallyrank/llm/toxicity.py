"""Toxicity scores from a weighted lexicon matched by an Aho-Corasick automaton.

Texts are folded first, one character to one: case, full-width forms, look-alike letters of other
scripts, and digits or signs that stand for letters. The lexicon holds whole words and stems, which match the start
of a longer word; it is learned, in folded letters, from labelled rows: what stands in significantly more toxic texts than
chance gives. A match inside an exception phrase doesn't count. The weights of the entries and the logistic curve that turns
the weighted hits, normalised by length, into a score come from the same rows; a few words of abuse are there from the start.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, uncovered, written

# Terms of abuse, known before any label.
LEXICON = (
    "idiot idiots idiotic moron morons moronic imbecile imbeciles cretin cretins stupid stupidity dumb dumbass fool fools "
    "loser losers pathetic worthless useless scum scumbag trash garbage filth filthy vermin disgusting disgrace despicable "
    "clown clowns jerk jerks bastard bastards bitch bitches asshole assholes crap shit shitty bullshit fuck fucking fucker "
    "dickhead douchebag prick slut whore pig pigs swine freak freaks weirdo creep creeps psycho lunatic degenerate subhuman "
    "parasite parasites coward cowards liar liars hypocrite retard retarded brainless clueless lowlife sleazy vile wretch "
    "dummkopf trottel idioten arschloch scheisse wichser hurensohn abschaum missgeburt vollidiot schwachkopf "
    "imbécile crétin abruti connard connasse salaud salope ordure débile minable "
    "imbécil estúpido estúpida idiota gilipollas cabrón pendejo escoria basura inútil"
).split()
# Phrases in which a term is harmless.
EXCEPTIONS = (
    "trash can",
    "trash bin",
    "trash bag",
    "trash collection",
    "garbage collector",
    "garbage collection",
    "garbage truck",
    "clown fish",
    "guinea pig",
    "guinea pigs",
    "idiot proof",
    "pathetic fallacy",
    "jerk chicken",
    "fool proof",
    "pig iron",
    "deaf and dumb",
    "dumb terminal",
)
# Look-alikes and the letter each stands for, in pairs.
HOMOGLYPHS = (
    "аaеeоoрpсcуyхxіiјjѕsԁdһhвbмmтtкkнhгrԛqԝwɡgʟlαaεeοoρpιiκkνvτtυuχxηnωwσsℓlıi"
)
# Digits and signs that stand for letters; 1, ! and | stand for i or l.
SUBSTITUTES = {"0": "o", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
EITHER = "1!|"

HELD_OUT = 5
#: Labelled ids that lexicon, weights and curve are fitted on, at most: those with the smallest hashes.
FIT_ROWS = 50_000
#: Entries that are learned, at most: the most significant ones.
MAX_ENTRIES = 20_000
PRIOR_WEIGHT = 3.0
#: Words that are candidates have this many characters; stems are as long and end before their word does.
LEAST_WORD, MOST_WORD = 3, 40
STEMS = range(4, 11)
#: Different words of toxic texts that a stem has to have.
STEM_WORDS = 3
#: Texts that hold a candidate, at least.
LEAST_TEXTS = 3
#: How far, in log likelihood, a candidate has to be from chance beyond what the number of candidates explains.
MARGIN = 2.0
#: Texts that a stem's odds count for in those of its words.
BELIEF = 2.0
#: Candidates a task counts before it hands them on.
HELD_ENTRIES = 300_000
#: Words added to a text's length before hits are divided by it.
SHORT = 50
THRESHOLD = 0.5

_WORD = re.compile(r"[^\W_]+")


def _fold_table() -> dict[int, str]:
    table = {ord(a): b for a, b in zip(HOMOGLYPHS[::2], HOMOGLYPHS[1::2], strict=True)}
    table |= {ord(a.upper()): b for a, b in zip(HOMOGLYPHS[::2], HOMOGLYPHS[1::2], strict=True) if len(a.upper()) == 1 and ord(a.upper()) > 127}
    table |= {0xFF01 + k: chr(0x21 + k) for k in range(94)}
    table |= {c: chr(c).lower() for c in range(0x250) if len(chr(c).lower()) == 1 and chr(c).lower() != chr(c)}
    table |= {ord(a): b for a, b in SUBSTITUTES.items()}
    table |= {k: SUBSTITUTES.get(v, v).lower() for k, v in table.items()}
    # l, i and what may stand for either share a letter.
    return {k: "i" if v in {"l", *EITHER} else v for k, v in table.items()} | {ord(c): "i" for c in "lLI" + EITHER} | {c: " " for c in (9, 10, 11, 12, 13)}


FOLD = _fold_table()


def fold(text: str) -> str:
    """The text with as many characters, look-alikes folded."""
    return text.translate(FOLD)


class Model(NamedTuple):
    """Weights of whole words and of stems, both in folded letters, and the curve's coefficients."""

    words: dict[str, float]
    stems: dict[str, float]
    curve: tuple[float, ...]


def first_model() -> Model:
    """What holds without labels."""
    return Model({fold(t): PRIOR_WEIGHT for t in LEXICON}, {}, (-3.0, 1.0, 6.0, 0.0))


class Matcher:
    """Words of the lexicon in a text, minus those inside exception phrases.

    A word counts once: as itself if it is an entry, else by its longest stem. Its ends are looked for in
    the text as it is: a mark ends a word even if it may stand for a letter.
    """

    def __init__(self, words: Iterable[str], stems: Iterable[str] = (), exceptions: tuple[str, ...] = EXCEPTIONS) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        kinds: dict[str, int] = {}
        for bit, entries in ((1, words), (2, stems), (4, map(fold, exceptions))):
            for e in entries:
                kinds[e] = kinds.get(e, 0) | bit
        for e, kind in kinds.items():
            self.automaton.add_word(e, (len(e), kind, e))
        if kinds:
            self.automaton.make_automaton()

    def hits(self, text: str) -> Counter[tuple[str, bool]]:
        """(entry, whether it is a whole word) with counts."""
        found: dict[int, tuple[int, bool, str]] = {}  # by start: end, whole, entry
        spared: list[tuple[int, int]] = []
        if not len(self.automaton):
            return Counter()
        n = len(text)
        for last, (size, kind, entry) in self.automaton.iter(fold(text)):
            start, end = last + 1 - size, last + 1
            if start and text[start - 1].isalnum():
                continue
            goes_on = end < n and text[end].isalnum()
            if goes_on:
                if kind & 2 and _lettered(text[start:end]):  # a longer stem of the word comes later and takes its place
                    found[start] = (end, False, entry)
                continue
            if kind & 1 and _lettered(text[start:end]):
                found[start] = (end, True, entry)
            if kind & 4:
                spared.append((start, end))
        if spared:
            left = uncovered(sorted((a, x[0]) for a, x in found.items()), sorted(spared))
            found = {a: found[a] for a, _ in left}
        return Counter((entry, whole) for _, whole, entry in found.values())


def _lettered(raw: str) -> bool:
    """At least a third of the characters are letters, so that numbers aren't read as words."""
    return 3 * sum(map(str.isalpha, raw)) >= len(raw)


def features(hits: dict[tuple[str, bool], int], n_words: int, model: Model) -> tuple[float, float, float]:
    """Weighted hits a hundred words on a log scale, whether the strongest entry is strong, and the weight of all on a log scale."""
    total = best = 0.0
    for (entry, whole), n in hits.items():
        w = (model.words if whole else model.stems).get(entry, 0.0)
        total, best = total + w * n, max(best, w)
    return math.log1p(100 * total / (n_words + SHORT)), best / (1 + best), math.log1p(total)


def score(hits: dict[tuple[str, bool], int], n_words: int, model: Model) -> float:
    z = model.curve[0] + sum(c * x for c, x in zip(model.curve[1:], features(hits, n_words, model), strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def candidates(text: str) -> set[str]:
    """Words of a text, folded and behind '=', and what may be their stems, behind '^'."""
    out = set()
    for w in set(_WORD.findall(text)):
        if LEAST_WORD <= len(w) <= MOST_WORD and _lettered(w):
            w = fold(w)
            out.add("=" + w)
            out.update(["^" + w[:k] for k in STEMS if k < len(w)])
    return out


def _odds(toxic: float, clean: float, n: tuple[int, int]) -> float:
    return max(0.0, math.log((toxic + 0.5) / (n[1] + 1)) - math.log((clean + 0.5) / (n[0] + 1)))


def weigh(rows: list[tuple[str, int, int]], n: tuple[int, int]) -> Model:
    """Weights from (entry, toxic texts, clean texts) and the numbers of (clean, toxic) texts; seeds without texts keep PRIOR_WEIGHT."""
    told = {e: (t, c) for e, t, c in rows}
    stems = {e[1:]: _odds(t, c, n) for e, (t, c) in told.items() if e[0] == "^"}
    words = first_model().words
    for e, (t, c) in told.items():
        if e[0] == "=":
            stem = next((told["^" + e[1 : k + 1]] for k in reversed(STEMS) if k < len(e) - 1 and "^" + e[1 : k + 1] in told), None)
            more = BELIEF / sum(stem) if stem else 0.0
            words[e[1:]] = _odds(t + more * stem[0], c + more * stem[1], n) if stem else _odds(t, c, n)
    return Model({w: x for w, x in words.items() if x > 0 or any(w[:k] in stems for k in STEMS)}, {s: x for s, x in stems.items() if x > 0}, ())


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """A ridge logistic curve by Newton steps; more or stronger hits never make a text less toxic."""
    used = [True] * x.shape[1]
    while True:
        z = np.column_stack([np.ones(len(x)), x[:, used]])
        beta, ridge = np.zeros(z.shape[1]), np.diag([1e-6, *[0.1] * sum(used)])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ beta)
            beta = beta + step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
            if np.abs(step).max() < 1e-9:
                break
        full = iter(beta[1:].tolist())
        out = [next(full) if u else 0.0 for u in used]
        if min(out, default=0.0) >= 0:
            return (float(beta[0]), *out)
        used = [u and v >= 0 for u, v in zip(used, out, strict=True)]


def _sample(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """family, text and toxic of the labelled rows to fit on, one row for texts that are near copies of each other.

    The ids are those with the smallest hashes, at most ``fit_rows`` of them, so that a broadcast finds their texts. Copies of one text
    would make its words look toxic or clean together: texts with the same least shingle hash count once.
    """
    from .minhash import shingle_hasher

    ids = (
        labels.where(F.col("toxic").isNotNull() & (crc_bucket(F.col("doc_id"), HELD_OUT) != 0))
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int") > 0).cast("int").alias("_toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(fit_rows)
    )

    def families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = shingle_hasher()
        for batch in batches:
            sets = (hashes(t.as_py()) for t in batch.column("text"))
            family = pa.array([int(s[0].view(np.int64)) if len(s) else 0 for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([family, batch.column("_toxic"), batch.column("text")], names=["family", "toxic", "text"])

    told = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("_toxic", "text")
    rows = told.mapInArrow(families, "family long, toxic int, text string")
    return rows.groupBy("family").agg(F.max_by(F.struct("toxic", "text"), F.struct("toxic", F.xxhash64("text"))).alias("row")).select("family", "row.toxic", "row.text")


def count_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entry, toxic, clean): partial numbers of texts; the entry '' has all texts."""

    def out(counts: tuple[Counter[str], Counter[str]]) -> pa.RecordBatch:
        entries = list(counts[0] | counts[1])
        return pa.RecordBatch.from_arrays([pa.array(entries), *(pa.array([counts[y][e] for e in entries], pa.int64()) for y in (1, 0))], names=["entry", "toxic", "clean"])

    counts = Counter(), Counter()
    for batch in batches:
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
            counts[toxic].update(candidates(text.as_py() or ""))
            counts[toxic][""] += 1
        if len(counts[0]) + len(counts[1]) >= HELD_ENTRIES:
            yield out(counts)
            counts = Counter(), Counter()
    if counts[0] or counts[1]:
        yield out(counts)


def _surprise(n: tuple[int, int]) -> Column:
    """Log likelihood ratio of an entry's texts against the share of toxic ones among all; 0 for entries of clean texts."""
    share = n[1] / sum(n)
    both = F.col("toxic") + F.col("clean")
    part = lambda x, p: F.when(x > 0, x * F.log(x / (both * p))).otherwise(0.0)
    return F.when(F.col("toxic") > both * share, part(F.col("toxic"), share) + part(F.col("clean"), 1 - share)).otherwise(0.0)


def learned_entries(counts: DataFrame, n: tuple[int, int]) -> list[tuple[str, int, int]]:
    """(entry, toxic texts, clean texts) of the seeds, of significant words and stems, and of the words on such stems."""
    common = counts.where(F.col("toxic") + F.col("clean") >= LEAST_TEXTS)
    many = common.count()
    if not many:
        return []
    telling = common.withColumn("g", _surprise(n)).where(F.col("g") >= math.log(many) + MARGIN)
    by_stem = lambda df: df.select("*", F.explode(F.array(*(F.substring("entry", 2, k) for k in STEMS))).alias("stem"))
    words = counts.where("entry LIKE '=%'")
    various = (
        by_stem(words.where("toxic > 0")).where("length(stem) < length(entry) - 1")
        .groupBy("stem").agg(F.countDistinct("entry").alias("different")).where(F.col("different") >= STEM_WORDS)
    )
    stems = telling.where("entry LIKE '^%'").withColumn("stem", F.substring("entry", 2, MOST_WORD)).join(various, "stem", "left_semi")
    best = telling.where("entry LIKE '=%'").select("entry", "toxic", "clean", "g").unionByName(stems.select("entry", "toxic", "clean", "g"))
    chosen = [tuple(r) for r in best.orderBy(F.desc("g"), "entry").limit(MAX_ENTRIES).select("entry", "toxic", "clean").collect()]
    told = counts.sparkSession.createDataFrame([(e[1:],) for e, _, _ in chosen if e[0] == "^"], "stem string")
    seeds = counts.sparkSession.createDataFrame([("=" + fold(t),) for t in LEXICON], "entry string").distinct()
    under = by_stem(words).join(F.broadcast(told), "stem", "left_semi").where(F.col("toxic") + F.col("clean") >= LEAST_TEXTS)
    others = under.select("entry", "toxic", "clean").unionByName(words.join(F.broadcast(seeds), "entry", "left_semi")).distinct()
    others = others.orderBy(F.desc(F.col("toxic") + F.col("clean")), "entry").limit(MAX_ENTRIES).collect()
    return sorted({*chosen, *map(tuple, others)})


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on at most ``fit_rows`` labelled ids that aren't held out.

    A doc_id with several labels is toxic if one of them is; null labels and null ids are left out. Without texts of both
    labels the model is that of the seeds. At most 2 * MAX_ENTRIES entries and ``fit_rows`` numbers come to the driver.
    """
    sample = written(_sample(docs, labels, fit_rows), "toxicity-sample")
    counts = written(
        sample.mapInArrow(count_candidates, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")),
        "toxicity-counts",
    )
    all_texts = counts.where("entry = ''").first()
    n = (all_texts["clean"], all_texts["toxic"]) if all_texts else (0, 0)
    if not all(n):
        return first_model()
    model = weigh(learned_entries(counts.where("entry <> ''"), n), n)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.words, model.stems)
        for batch in batches:
            texts = (x.as_py() or "" for x in batch.column("text"))
            x = [features(matcher.hits(t), len(t.split()), model) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("family"), batch.column("toxic"), pa.array(x, pa.list_(pa.float64()))], names=["family", "toxic", "x"])

    rows = sample.mapInArrow(measured, "family long, toxic int, x array<double>").orderBy(F.xxhash64("family"), "family").limit(fit_rows).collect()
    return model._replace(curve=fit_curve(np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], float)))


SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_hits long"


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from THRESHOLD) and n_hits, one row per input row.

    Only the text makes the score. A null or empty text scores as one without hits; repeated rows
    score alike; a null doc_id is kept and counts as not held out; other columns are not read; an
    empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.words, model.stems)
        for batch in batches:
            found = [(matcher.hits(t), len(t.split())) for t in (x.as_py() or "" for x in batch.column("text"))]
            scores = [score(h, n, model) for h, n in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    batch.column("held_out"),
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()),
                    pa.array([sum(h.values()) for h, _ in found], pa.int64()),
                ],
                names=["doc_id", "held_out", "score", "predicted", "n_hits"],
            )

    held = F.coalesce(crc_bucket(F.col("doc_id"), HELD_OUT) == 0, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(run, SCHEMA)


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores under THRESHOLD."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.words, model.stems)
        for batch in batches:
            texts = (x.as_py() or "" for x in batch.column(place))
            yield batch.filter(pa.array([score(matcher.hits(t), len(t.split()), model) < THRESHOLD for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
