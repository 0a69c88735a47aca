"""Near-duplicate components by min-max hashing.

1. Each text becomes its set of word-shingle hashes; documents with equal sets fall into one class by a
   map-side combined minimum over set fingerprints, and only class representatives go on.
2. Under each of PERMUTATIONS hash functions both the minimum and the maximum are kept, so the
   signature has twice as many values as functions. Bands of ROWS values give buckets.
3. Members of a bucket are compared by signature in bounded blocks; what is close enough becomes a
   spanning forest of edges, never all pairs. First each block by itself with some pivots that all blocks of the
   bucket hold; then members that this didn't tie to the bucket's main tree against all others, a pair of
   blocks at a time. So a bucket of copies costs linear work, one of unlike documents the square of its size.
   The components of the edges are the groups.
4. Within each group all documents are compared in bounded blocks, with their whole sets, and links
   (100 * intersection >= 75 * union) are confirmed exactly, those inside a known component
   skipped. First each block by itself with some pivots that all blocks of the group hold; then documents outside
   the group's main component against all others, a pair of blocks at a time. So a group of copies costs linear work and no
   task holds more than two blocks.
5. Components of the confirmed links are the result.

Keys that may hold much of the corpus (a set's copies, a bucket, a group) are joined with their heaviest values broadcast.

A link is missed only if no band ties its documents to one group, or their signatures agree too little: with 32
bands of 4 values at a similarity of 0.75 that has a probability of 5.2e-6 for no common band and 6.7e-5 for an
agreement under GROUPED, at most 7.2e-5 together, for a pair that has no other neighbour.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_skewed, sieved, split_words, written
from .components import components

SHINGLE = 5
PERCENT = 75
PERMUTATIONS = 64
ROWS = 4
BANDS = 2 * PERMUTATIONS // ROWS
#: Signature agreement from which two documents belong to one group: about four deviations under 0.75.
GROUPED = 0.60
COMPARED = 0.57
#: Documents of a bucket or group that a task compares with each other, and shingles of those of a group.
BLOCK_DOCS = 2000
BLOCK_SHINGLES = 2_000_000
PIVOTS = 48

_M1, _M2, _STEP = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
_SHIFT, _HALF = np.uint64(33), np.uint64(32)
_WORDS_KNOWN = 300_000


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _SHIFT)) * _M1
    x = (x ^ (x >> _SHIFT)) * _M2
    return x ^ (x >> _SHIFT)


_SEEDS = mix(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64) * _STEP)
_FACTORS, _OFFSETS = _SEEDS[:PERMUTATIONS] | np.uint64(1), _SEEDS[PERMUTATIONS:]


def shingle_hasher(size: int = SHINGLE) -> Callable[[str | None], np.ndarray]:
    """A function from a text to the sorted distinct 64-bit hashes of its word shingles."""
    import xxhash

    known: dict[bytes, int] = {}

    def hashes(text: str | None) -> np.ndarray:
        words = split_words(text)
        if not words:
            return np.zeros(0, np.uint64)
        if len(known) > _WORDS_KNOWN:
            known.clear()
        for w in {w for w in words if w not in known}:
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.array([known[w] for w in words], np.uint64)
        k = min(size, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = mix(out * _STEP + h[i : len(h) - k + 1 + i])
        return np.unique(out)

    return hashes


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima, then maxima, of the high halves under each hash function."""
    low = np.full(PERMUTATIONS, 2**32 - 1, np.uint32)
    high = np.zeros(PERMUTATIONS, np.uint32)
    for at in range(0, len(shingles), 512):
        v = ((shingles[at : at + 512, None] * _FACTORS + _OFFSETS) >> _HALF).astype(np.uint32)
        low, high = np.minimum(low, v.min(0)), np.maximum(high, v.max(0))
    return np.concatenate([low, high])


def band_keys(values: np.ndarray) -> np.ndarray:
    rows = values.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP
    for i in range(ROWS):
        key = mix(key * _STEP + rows[:, i])
    return key.view(np.int64)


def short(values: np.ndarray) -> bytes:
    """A byte of each signature value, for comparison."""
    return (values & np.uint32(255)).astype(np.uint8).tobytes()


def agreement(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Estimated similarities: share of equal bytes, less chance ones."""
    return ((many == one).mean(axis=1) * 256 - 1) / 255


def _set_id(shingles: bytes) -> bytes:
    return hashlib.blake2b(shingles, digest_size=16).digest()


def profiles(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, set_id (null for empty sets or ids), sig and bands of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = shingle_hasher(shingle)
        for batch in batches:
            n, ids, sigs, bands = [], [], [], []
            for text in batch.column("text"):
                s = hashes(text.as_py())
                n.append(len(s))
                if not len(s):
                    ids.append(None), sigs.append(None), bands.append(None)
                    continue
                v = signature(s)
                ids.append(_set_id(s.tobytes()))
                sigs.append(short(v))
                bands.append(band_keys(v))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary()),
                    pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "set_id", "sig", "bands"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_id binary, sig binary, bands array<long>")


class Forest:
    """Union-find over row numbers."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[x] = y
        return x != y


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of consecutive rows with one key, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held)


def _edges(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _signatures(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(table), 2 * PERMUTATIONS)


def group_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning forests of agreeing documents, a bucket's block at a time."""
    out: list[tuple[int, int]] = []
    for table in runs(batches, "task"):
        ids, sigs = table.column("doc_id").to_pylist(), _signatures(table)
        forest = Forest(len(ids))
        for i in range(len(ids) - 1):
            close = np.flatnonzero(agreement(sigs[i], sigs[i + 1 :]) >= GROUPED) + i + 1
            out += [(ids[i], ids[j]) for j in close.tolist() if ids[i] != ids[j] and forest.join(i, j)]
        if len(out) >= 10_000:
            yield _edges(out)
            out = []
    if out:
        yield _edges(out)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def confirmed_links(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Exact links of each block as a spanning forest; rows with one ``known`` root need no link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for table in runs(batches, "task"):
            ids, known, sigs = table.column("doc_id").to_pylist(), table.column("known").to_pylist(), _signatures(table)
            groups = np.array(table.column("grp").to_pylist())
            sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
            forest, first = Forest(len(ids)), {}
            for i, k in enumerate(known):
                forest.join(i, first.setdefault(k, i))
            for i in range(len(ids) - 1):
                near = agreement(sigs[i], sigs[i + 1 :])
                near[groups[i + 1 :] != groups[i]] = 0
                at = np.flatnonzero(near >= COMPARED)
                for j in (at[np.argsort(-near[at], kind="stable")] + i + 1).tolist():
                    if forest.find(i) != forest.find(j) and linked(sets[i], sets[j], percent):
                        forest.join(i, j)
                        out.append((ids[i], ids[j]))
            if len(out) >= 10_000:
                yield _edges(out)
                out = []
        if out:
            yield _edges(out)

    return run


def _stars(roots: DataFrame) -> DataFrame:
    """Known components as edges, from which a search for further ones goes on in few rounds."""
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b"))


def _by_task(df: DataFrame) -> DataFrame:
    return df.repartition("task").sortWithinPartitions("task")


def across(members: DataFrame) -> DataFrame:
    """The members, each once a ``task``: pairs of blocks of a bucket, where each member outside the main ``known`` meets all others.

    ``weight`` is a member's number of shingles, if those are compared; a block has at most about BLOCK_DOCS members and
    BLOCK_SHINGLES shingles, and no task more than two blocks.
    """
    blocks = lambda n, w: F.greatest(F.ceil(n / BLOCK_DOCS), F.ceil(w / BLOCK_SHINGLES)).cast("int")
    main = (
        members.groupBy("bucket", "known").agg(F.count(F.lit(1)).alias("size"), F.sum("weight").alias("w"))
        .groupBy("bucket").agg(
            F.max_by(F.struct("known", "size", "w"), F.struct("size", "known")).alias("m"), F.sum("size").alias("docs"), F.sum("w").alias("all_w")
        )
        .where("docs > m.size")
        .select("bucket", "docs", F.col("m.known").alias("main"), blocks(F.col("m.size"), F.col("m.w")).alias("inner"), blocks(F.col("docs") - F.col("m.size"), F.col("all_w") - F.col("m.w")).alias("outer"))
    )
    loose = F.col("known") != F.col("main")
    own = F.pmod(F.xxhash64("doc_id", F.lit("across")), F.when(loose, F.col("outer")).otherwise(F.col("inner"))).cast("int")
    outer, inner = (F.sequence(F.lit(0), F.col(c) - 1) for c in ("outer", "inner"))
    with_outer = F.transform(outer, lambda b: F.xxhash64("bucket", F.lit("outer"), F.least("own", b), F.greatest("own", b)))
    with_inner = F.transform(inner, lambda b: F.xxhash64("bucket", F.lit("inner"), F.col("own"), b))
    of_inner = F.transform(outer, lambda b: F.xxhash64("bucket", F.lit("inner"), b, F.col("own")))
    pairs = F.when(loose, F.concat(with_outer, with_inner)).otherwise(of_inner)
    joined = join_skewed(members, main, "bucket", "docs", members.count(), F.col("doc_id")).where("main IS NOT NULL")
    return joined.withColumn("own", own).select(F.explode(pairs).alias("task"), *(c for c in members.columns if c not in ("bucket", "weight")))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, among: DataFrame | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row per input row.

    ``docs`` has doc_id and text; other columns are not read. Words are runs without ASCII blanks, A-Z lower-cased; a
    text with fewer than ``shingle`` words is one shingle. Documents whose sets have a Jaccard
    similarity of ``percent`` / 100 or more are linked; component_id is the smallest doc_id reachable. With
    ``among`` (doc_id, each once) only rows of those ids count and are returned.

    Null, empty and blank texts have the empty set and are linked with nothing. Of rows that repeat a
    doc_id those with equal sets get one component; a doc_id with unlike texts is one document that is linked with all
    that one of them is. A row with a null doc_id is a component by itself, with a null
    component_id, and kept. An empty table gives an empty table.
    """
    found = profiles(docs, shingle)
    rows = written(found if among is None else found.join(among.select("doc_id"), "doc_id", "left_semi"), "profiles")
    total = rows.count()
    classes = rows.where("doc_id IS NOT NULL AND set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    reps = written(
        rows.join(classes, (rows["set_id"] == classes["set_id"]) & (rows["doc_id"] == classes["rep"]), "left_semi")
        .dropDuplicates(["doc_id", "set_id"]),
        "representatives",
    )
    places = reps.select("doc_id", "set_id", F.explode("bands").alias("bucket"))
    shared = written(places.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    in_buckets = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    placed = join_skewed(places, shared, "bucket", "n", in_buckets, F.col("doc_id")).where("n IS NOT NULL")
    blocks = F.ceil(F.col("n") / BLOCK_DOCS).cast("int")
    pivot = (blocks > 1) & (F.pmod(F.xxhash64("doc_id", F.lit("pivot")), F.col("n")) < PIVOTS)
    members = (
        placed.withColumn("blocks", blocks)
        .select(
            "doc_id", "set_id",
            F.explode(
                F.when(pivot, F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.xxhash64("bucket", b)))
                .when(F.col("blocks") == 1, F.array("bucket"))
                .otherwise(F.array(F.xxhash64("bucket", F.pmod(F.xxhash64("doc_id", "bucket"), F.col("blocks")).cast("int"))))
            ).alias("task"),
        )
        .join(reps.select("doc_id", "set_id", "sig"), ["doc_id", "set_id"])
    )
    near = written(_by_task(members.select("task", "doc_id", "sig")).mapInArrow(group_edges, "a long, b long"), "near")
    roots = components(near)
    if not shared.where(F.col("n") > BLOCK_DOCS).isEmpty():
        apart = (
            placed.where(F.col("n") > BLOCK_DOCS).join(roots, F.col("doc_id") == F.col("node"), "left")
            .select("bucket", "doc_id", "set_id", F.coalesce("root", "doc_id").alias("known"), F.lit(0).cast("long").alias("weight"))
            .join(reps.select("doc_id", "set_id", "sig"), ["doc_id", "set_id"])
        )
        rest = _by_task(across(written(apart, "large-buckets"))).select("task", "doc_id", "sig").mapInArrow(group_edges, "a long, b long")
        roots = components(_stars(roots).unionByName(rest))
    grouped = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = shingle_hasher(shingle)
        for batch in batches:
            sets = [hashes(t.as_py()).tobytes() for t in batch.column("text")]
            # A doc_id that repeats has met the sets of all its texts here: each text goes on with its own.
            own = pa.array([_set_id(s) == i for s, i in zip(sets, batch.column("set_id").to_pylist(), strict=True)], pa.bool_())
            names = ["doc_id", "grp", "set_id", "sig", "shingles"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:4]), pa.array(sets, pa.binary())], names=names).filter(own)

    chosen = written(reps.join(grouped, reps["doc_id"] == grouped["node"]).select(reps["doc_id"].alias("id"), "set_id", "sig", F.col("root").alias("grp")), "chosen")
    own = sieved(docs.select("doc_id", "text"), chosen.select(F.col("id").alias("doc_id")))
    sets = written(
        own.join(chosen, own["doc_id"] == chosen["id"])
        .select("doc_id", "text", "grp", "set_id", "sig")
        .mapInArrow(with_sets, "doc_id long, grp long, set_id binary, sig binary, shingles binary")
        .withColumn("n", (F.length("shingles") / 8).cast("long")),
        "sets",
    )
    sizes = sets.groupBy("grp").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"),
        F.count(F.lit(1)).alias("docs"),
    )
    placed = join_skewed(sets, sizes, "grp", "docs", sets.count(), F.col("doc_id"))
    own_block = F.pmod(F.xxhash64("doc_id", F.lit("block")), F.col("blocks")).cast("int")
    every_block = F.sequence(F.lit(0), F.col("blocks") - 1)
    is_pivot = F.pmod(F.xxhash64("doc_id", F.lit("pivot")), F.col("docs")) < PIVOTS
    links = confirmed_links(percent)
    columns = ("task", "grp", "doc_id", "known", "sig", "shingles")
    first = written(
        _by_task(
            placed.withColumn("block", F.explode(F.when(is_pivot, every_block).otherwise(F.array(own_block))))
            .select(F.xxhash64("grp", "block").alias("task"), "grp", "doc_id", F.col("doc_id").alias("known"), "sig", "shingles")
        ).mapInArrow(links, "a long, b long"),
        "links",
    )
    final = components(first)
    large = placed.where("blocks > 1")
    if not large.isEmpty():
        named = large.join(final, large["doc_id"] == final["node"], "left").select(
            F.col("grp").alias("bucket"), "grp", "doc_id", F.coalesce("root", "doc_id").alias("known"), "sig", "shingles", F.col("n").alias("weight")
        )
        second = _by_task(across(written(named, "large-groups"))).select(*columns).mapInArrow(links, "a long, b long")
        final = components(_stars(final).unionByName(second))
    labels = classes.join(final, F.col("rep") == F.col("node"), "left").select("set_id", F.coalesce("root", "rep").alias("label"), "copies")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    told = join_skewed(rows.select("doc_id", "n_shingles", "set_id"), labels, "set_id", "copies", total, F.col("doc_id"))
    return told.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
