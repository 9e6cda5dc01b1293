"""Near-duplicate detection: one-permutation hashing, optimal densification, banded buckets, stars.

Method. Each text becomes the set of its distinct word shingles. One hash of a shingle gives a
bin and a value; the least value of each bin is kept, and an empty bin borrows from the first
filled bin of a sequence that is the same for all texts (optimal densification). Groups of bins
(bands) name buckets. Texts with the same set form a class with one representative; in each
bucket of representatives one centre is linked with every other member, so candidates grow with
the members and not with their square. Candidates are confirmed on full sets. Later rounds draw
new centres in buckets whose members are still in different components, against the members of
other components only, as long as draws bring links; what then still lies in buckets of several
components is finished exactly: tokens in one order, rarest first, a pair that reaches the
threshold shares a token early in both (prefix and positional filters), so every such pair is a
candidate and is confirmed on full sets.

With 32 bands of 4 bins a pair at similarity 0.75 misses every common bucket with a
probability of 5e-6.

Hot buckets and classes: large ones are few and are met by a broadcast (see storage.by_size), so no
bucket is a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import components
from . import flattext as ft
from .common import materialize, maybe_among, rebatch, short_batches, slices, with_group

BINS, ROWS = 128, 4
BANDS = BINS // ROWS
U64 = np.uint64
_BAND_WEIGHTS = ft.mix(np.arange(1, BINS + 1, dtype=U64)).reshape(BANDS, ROWS) | U64(1)
_BAND_SALT = ft.mix(np.arange(1000, 1000 + BANDS, dtype=U64))


def bin_minima(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, filled) of shape (n, BINS); needs the shingles sorted by row, then hash."""
    bins = (hashes >> U64(64 - BINS.bit_length() + 1)).astype(np.int64)
    cell = rows * BINS + bins
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    values, filled = np.zeros(n * BINS, U64), np.zeros(n * BINS, bool)
    values[cell[first]], filled[cell[first]] = hashes[first], True
    return values.reshape(n, BINS), filled.reshape(n, BINS)


def densify(values: np.ndarray, filled: np.ndarray) -> None:
    """Give each empty bin the value of a filled one, drawn by (bin, attempt) alike for all texts."""
    row, col = np.nonzero(~filled & filled.any(axis=1)[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        draw = ft.mix(np.arange(BINS, dtype=U64) * U64(0x100000001B3) + U64(attempt << 20)) % U64(BINS)
        source = draw.astype(np.int64)[col]
        hit = filled[row, source]
        values[row[hit], col[hit]] = values[row[hit], source[hit]]
        row, col = row[~hit], col[~hit]


def band_keys(values: np.ndarray) -> np.ndarray:
    """(n, BANDS) bucket keys; a key holds its band."""
    grouped = ft.mix(values).reshape(len(values), BANDS, ROWS)
    return ft.mix((grouped * _BAND_WEIGHTS).sum(axis=2, dtype=U64) + _BAND_SALT)


_SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bands", pa.list_(pa.int64()))])
_SETS = pa.schema([("doc_id", pa.int64()), ("shingles", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])
#: Draws go on while at least this share of their candidates are links; then the exact way finishes.
PRODUCTIVE = 0.05
#: Bits of the bitmap of a set; what one bitmap has and another lacks bounds their common part.
BITS = 512


def _shingle_slices(batch: pa.RecordBatch, size: int):
    column = batch.column("text")
    for a, b in slices(np.diff(ft.utf8(column)[1])):
        raw, off = ft.utf8(column.slice(a, b - a))
        start, end, rows = ft.words(raw, off)
        yield a, b, *ft.shingles(ft.word_hashes(raw, start, end), rows, b - a, size)


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, rows, hashes in _shingle_slices(batch, size):
                n = b - a
                values, filled = bin_minima(rows, hashes, n)
                densify(values, filled)
                ends = np.searchsorted(rows, np.arange(n + 1))
                sums = [np.zeros(len(hashes) + 1, U64), np.zeros(len(hashes) + 1, U64)]
                np.cumsum(hashes, out=sums[0][1:])
                np.cumsum(ft.mix(hashes ^ U64(0x5851F42D4C957F2D)), out=sums[1][1:])
                keys = band_keys(values).view(np.int64).reshape(-1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), pa.array(keys))
                yield rebatch({"doc_id": batch.column("doc_id").slice(a, n), "n_shingles": np.diff(ends), "set_a": np.diff(sums[0][ends]).view(np.int64), "set_b": np.diff(sums[1][ends]).view(np.int64), "bands": lists}, _SKETCH)

    return run


def _full_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, rows, hashes in _shingle_slices(batch, size):
                ends = np.searchsorted(rows, np.arange(b - a + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes.view(np.int64)))
                marks = np.zeros((b - a, BITS), bool)
                marks[rows, (hashes % U64(BITS)).astype(np.int64)] = True
                words = np.packbits(marks, axis=1).view(np.int64).reshape(-1)
                bits = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a) * BITS // 64 + 1, BITS // 64, dtype=np.int32)), pa.array(words))
                yield rebatch({"doc_id": batch.column("doc_id").slice(a, b - a), "shingles": lists, "bits": bits}, _SETS)

    return run


def _stars(members: DataFrame, salt: int) -> DataFrame:
    """Candidate (a, b, ca, cb): in each bucket of (rep, bucket, component) one centre, drawn by
    hash, with every member of another component than its own; ca and cb are their components.

    The draw is the same in all buckets, so the buckets of a group of near copies have few
    centres between them, and their candidates fall together. The first draw (salt 0) prefers
    members of many shared buckets: a text that others are copies of is in more than each of them.
    """
    first = F.xxhash64("rep", F.lit(salt))
    drawing = members
    if salt == 0:
        drawing = members.join(members.groupBy("rep").agg((-F.count("*")).alias("rank")), "rep")
        drawn = F.struct("rank", first.alias("draw"), "rep", "component")
    else:
        drawn = F.struct(first.alias("draw"), "rep", "component")
    centres = drawing.groupBy("bucket").agg(F.min(drawn).alias("c"), F.count("*").alias("size"))
    centres = centres.select("bucket", F.col("c.rep").alias("centre"), F.col("c.component").alias("its"), "size")
    pairs = with_group(members, centres, "bucket", "size", members.count(), "rep").where("component <> its")
    low = F.least(F.struct("rep", "component"), F.struct(F.col("centre").alias("rep"), F.col("its").alias("component")))
    high = F.greatest(F.struct("rep", "component"), F.struct(F.col("centre").alias("rep"), F.col("its").alias("component")))
    pairs = pairs.select(low.alias("p"), high.alias("q")).select(F.col("p.rep").alias("a"), F.col("q.rep").alias("b"), F.col("p.component").alias("ca"), F.col("q.component").alias("cb"))
    return pairs.distinct()


def _mixed(members: DataFrame, total: int) -> DataFrame:
    """The members (of ``total`` rows) of buckets that hold more than one component."""
    buckets = members.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"))
    mixed = buckets.where("lo <> hi").select("bucket", "size")
    return with_group(members, mixed, "bucket", "size", total, "rep").where("size is not null").select(*members.columns)


def _confirmed(candidates: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The candidates (a, b, ...) whose full shingle sets reach the threshold."""
    left = candidates.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y")).cast("long")
    union = F.size("x") + F.size("y") - common
    return both.where(100 * common >= percent * union).select(*candidates.columns)


def _leftover(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b, ca, cb) of different components among all ``members`` (rep, component): every
    pair that reaches the threshold is among them.

    Tokens that one component alone has stand first in the order, then the others, rarest first.
    Sets that reach the threshold share a token that lies early in both: in the larger set x, with n
    tokens, at least percent * n tokens are left from it on; in the smaller set y, at least
    2 * percent / (100 + percent) * n. If the first token they share stands at i and j (from 0), they
    share min(nx - i, ny - j) tokens at most. So a passage that unlinked texts share is not looked at
    where what is their own is a seventh of the smaller text.
    """
    held = members.select(F.col("rep").alias("doc_id"), "component").distinct().join(sets, "doc_id").dropDuplicates(["doc_id"])
    held = materialize(held.select("doc_id", "component", F.size("shingles").cast("long").alias("n"), "shingles", "bits"))
    each = held.select("doc_id", "component", "n", F.explode("shingles").alias("token"))
    common = each.groupBy("token").agg(F.count("*").alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token", "df")
    own = Window.partitionBy("doc_id")
    placed = each.join(common, "token").withColumn("from_end", F.row_number().over(own.orderBy(F.desc("df"), F.desc("token"))).cast("long"))
    # from_end is n - i: tokens from here to the end of the order, this one too.
    placed = placed.where(100 * F.col("from_end") >= percent * F.col("n")).select("doc_id", "token", "from_end")
    placed = materialize(placed.join(held.select("doc_id", "component", "n", "bits"), "doc_id"))
    names = ("doc_id", "component", "n", "bits", "from_end")
    x = placed.select("token", *[F.col(c).alias(f"x_{c}") for c in names])
    y = placed.where((100 + percent) * F.col("from_end") >= 2 * percent * F.col("n")).select("token", *[F.col(c).alias(f"y_{c}") for c in names])
    lacks = lambda p, q: sum(F.bit_count(F.get(p, F.lit(k)).bitwiseAND(F.bitwise_not(F.get(q, F.lit(k))))) for k in range(BITS // 64))
    need = percent * (F.col("x_n") + F.col("y_n"))
    smaller = (F.col("y_n") < F.col("x_n")) | ((F.col("y_n") == F.col("x_n")) & (F.col("y_doc_id") < F.col("x_doc_id")))
    by_size = 100 * F.col("y_n") >= percent * F.col("x_n")
    by_place = (100 + percent) * F.least("x_from_end", "y_from_end") >= need
    by_bits = (100 + percent) * F.least(F.col("x_n") - lacks("x_bits", "y_bits"), F.col("y_n") - lacks("y_bits", "x_bits")) >= need
    met = (x["token"] == y["token"]) & smaller & by_size & (F.col("x_component") != F.col("y_component")) & by_place & by_bits
    return x.join(y, met).select(F.col("x_doc_id").alias("a"), F.col("y_doc_id").alias("b"), F.col("x_component").alias("ca"), F.col("y_component").alias("cb")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 75, shingle_words: int = 5, productive: float = PRODUCTIVE) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Texts are linked where 100 * |intersection| >= percent * |union| of their shingle sets;
    component_id is the least doc_id reachable over links, kept is doc_id = component_id.
    Null or blank text: no shingles, linked with nothing. Null doc_id: never linked,
    component_id null, kept. Equal sets are one class. doc_id should be unique: rows that repeat
    one are one node of the graph. No rows: no rows. Other columns of ``docs`` are ignored.
    ``productive`` moves work between draws and the exact way, and changes no result.
    """
    short_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = materialize(docs.mapInArrow(_sketches(shingle_words), "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"))
    same = ["n_shingles", "set_a", "set_b"]
    usable = sketch.where("n_shingles > 0 and doc_id is not null")
    classes = materialize(usable.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")))
    # A class's representative row is found by its id, which also deals out the rows of a large class.
    chosen = usable.join(classes.withColumn("doc_id", F.col("rep")), [*same, "doc_id"]).select("rep", F.explode("bands").alias("bucket"), F.col("rep").alias("component"))
    # The distinct drops what rows that repeat an id and a text bring twice.
    members = materialize(_mixed(chosen, classes.count() * BANDS).distinct())
    needed = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = materialize(docs.join(needed, "doc_id", "left_semi").mapInArrow(_full_sets(shingle_words), "doc_id long, shingles array<long>, bits array<long>"))

    named = classes.withColumn("component_id", F.col("rep"))
    turn, last = 0, False
    while not members.isEmpty():
        candidates = materialize(_leftover(members, sets, percent) if last else _stars(members, turn))
        found = materialize(_confirmed(candidates, sets, percent))
        links = found.count()
        if links:
            # Components of components: a graph that shrinks from turn to turn.
            moved = materialize(components(found.select(F.col("ca").alias("a"), F.col("cb").alias("b"))))
            members, named = _renamed(members, "component", moved), _renamed(named, "component_id", moved)
        if last:
            break
        last = links < productive * candidates.count()
        members = materialize(_mixed(members, members.count()))
        turn += 1
    # One value that names a class, to meet it by.
    key = F.concat_ws(",", *same).alias("key")
    named = materialize(named.select(key, "component_id", "size"))
    linked = with_group(usable.select("doc_id", "n_shingles", key), named, "key", "size", usable.count(), "doc_id", "n_shingles")
    linked = linked.select("doc_id", "n_shingles", "component_id")
    alone = sketch.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _renamed(rows: DataFrame, name: str, moved: DataFrame) -> DataFrame:
    """``rows`` with the components in ``moved`` (node, component) renamed."""
    met = rows.join(moved.select(F.col("node").alias(name), F.col("component").alias("__new")), name, "left")
    return met.withColumn(name, F.coalesce("__new", name)).select(*rows.columns)


def without_near_duplicates(docs: DataFrame, percent: int = 75, shingle_words: int = 5) -> DataFrame:
    """One document of each group of near copies of ``docs`` (doc_id, text, ...), all columns.

    Rows without an id stay. Rows that repeat an id stay or go together; they stay if any of them
    does. Rows that surely stay pass straight through a narrow scan, so only rows that may go are
    shuffled.
    """
    told = near_duplicates(docs.select("doc_id", "text"), percent, shingle_words).where("doc_id is not null")
    gone = materialize(told.groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).where("not kept").select(F.col("doc_id").alias("__id")))
    whole = docs.select(F.col("doc_id").cast("long").alias("__id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    marked = maybe_among(whole, gone, "__id")
    stays = marked.where("__hit").join(gone, "__id", "left_anti")
    return marked.where("not __hit").unionByName(stays).select("__row.*")
