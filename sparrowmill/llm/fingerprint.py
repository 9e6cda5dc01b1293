"""Document fingerprints from prefix polynomial hashes.

The prefix arrays of two polynomial hashes, modulo two primes, give the hash of any span in
constant time: spans are compared by it, and longest common extensions are found by binary
search. A fingerprint is the hash of the whole text; for each of a fixed number of bins, a few bits
of the least span hash that falls into the bin; the length; and a few bits of the hash of each prefix
that ends at a checkpoint. The share of bins in which two fingerprints agree estimates how many spans
their texts share, and the last checkpoint up to which their prefixes are equal tells how far they
are the same for certain.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flattext as ft
from .common import materialize, rebatch, short_batches, slices, table, text_list

PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
#: Code points of a span, and bins of a fingerprint.
SPAN, BINS = 8, 64
#: Checkpoints of prefixes: the first, and four to a doubling.
FIRST_CHECK, CHECKS_A_DOUBLING = 16, 4
#: Spans that are hashed at once: a bound on memory, whatever the length of a text.
BLOCK = 1 << 18
BUCKET_DOCS = 2_000
MAX_BUCKETS = 20_000
U64 = np.uint64
_powers: dict[int, np.ndarray] = {}


def powers(which: int, n: int) -> np.ndarray:
    """BASE**i modulo the prime for i < n, by doubling."""
    have = _powers.get(which, np.ones(1, U64))
    while len(have) < n:
        step = U64(pow(BASES[which], len(have), PRIMES[which]))
        have = np.concatenate([have, have * step % U64(PRIMES[which])])
    _powers[which] = have
    return have[:n]


class PrefixHashes:
    """Prefix arrays over one sequence of code points (a text, or several laid end to end)."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        values = codes.astype(U64) + U64(1)
        self.prefix = []
        for which, prime in enumerate(PRIMES):
            # Terms are below 2**31, so sums over fewer than 2**33 code points are exact.
            sums = np.zeros(self.n + 1, U64)
            np.cumsum(values * powers(which, self.n) % U64(prime), out=sums[1:])
            self.prefix.append(sums % U64(prime))

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """One 62-bit hash for each span [start, end): equal for equal spans, wherever they are."""
        out = np.zeros(len(start), U64)
        for which, prime in enumerate(PRIMES):
            p = self.prefix[which]
            diff = (p[end] + U64(prime) - p[start]) % U64(prime)
            # Shift every span to the same power, that of the end of the sequence.
            out = (out << U64(31)) | (diff * powers(which, self.n + 1)[self.n - start] % U64(prime))
        return out

    def equal(self, a: int, b: int, length: int) -> bool:
        """Whether the spans of ``length`` at a and b are the same."""
        x = self.spans(np.array([a, b]), np.array([a + length, b + length]))
        return bool(x[0] == x[1])

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How far the text at each a goes on like the text at b, up to ``most``; by binary search."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.spans(a, a + middle) == self.spans(b, b + middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low


def _canonical(prefix: PrefixHashes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans that do not depend on the sequence the span lies in."""
    out = np.zeros(len(start), U64)
    for which, prime in enumerate(PRIMES):
        back = U64(pow(pow(BASES[which], prefix.n, PRIMES[which]), -1, PRIMES[which]))
        p = prefix.prefix[which]
        diff = (p[end] + U64(prime) - p[start]) % U64(prime)
        moved = diff * powers(which, prefix.n + 1)[prefix.n - start] % U64(prime)
        out = (out << U64(31)) | (moved * back % U64(prime))
    return ft.mix(out + (end - start).astype(U64) * U64(0x9E3779B97F4A7C15))


def checkpoints(longest: int) -> np.ndarray:
    """Lengths of the prefixes that a fingerprint holds, up to ``longest``."""
    steps = max(0, math.floor(CHECKS_A_DOUBLING * math.log2(max(longest, 1) / FIRST_CHECK)) + 2)
    out = np.floor(FIRST_CHECK * 2.0 ** (np.arange(steps) / CHECKS_A_DOUBLING)).astype(np.int64)
    return out[out <= longest]


class Sketches:
    """What fingerprints are made of, a row for each text: whole-text hashes, bits of the least span
    hash of each bin (-1 where empty), lengths, bits of the prefixes at checkpoints (-1 beyond the end)."""

    def __init__(self, texts: list[str]):
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.off = np.concatenate([[0], np.cumsum(self.sizes)])
        self.prefix = PrefixHashes(codes)
        self.whole = _canonical(self.prefix, self.off[:-1], self.off[1:])
        # All spans of SPAN code points; a shorter text is one span.
        per_text = np.where(self.sizes == 0, 0, np.maximum(self.sizes - SPAN + 1, 1))
        least = np.full(len(texts) * BINS, np.iinfo(np.uint64).max, U64)
        filled = np.zeros(len(texts) * BINS, bool)
        ends = np.cumsum(per_text)
        for first in range(0, int(per_text.sum()), BLOCK):
            at = np.arange(first, min(first + BLOCK, int(ends[-1])))
            row = np.searchsorted(ends, at, "right")
            start = at - (ends - per_text)[row] + self.off[row]
            value = _canonical(self.prefix, start, np.minimum(start + SPAN, self.off[row + 1]))
            cell = row * BINS + (value >> U64(58)).astype(np.int64)
            np.minimum.at(least, cell, value)
            filled[cell] = True
        self.bins = np.where(filled, (ft.mix(least) & U64(0xFFFF)).astype(np.int64), -1).reshape(-1, BINS)
        self.at = checkpoints(int(self.sizes.max(initial=0)))
        self.checks = np.full((len(texts), len(self.at)), -1)
        row, k = np.nonzero(self.at[None, :] <= self.sizes[:, None])
        self.checks[row, k] = (ft.mix(_canonical(self.prefix, self.off[row], self.off[row] + self.at[k])) & U64(0xFFFF)).astype(np.int64)

    def fingerprints(self) -> list[str]:
        """16 hex digits of the whole text's hash, 4 for each bin (``....`` if empty), 8 of the length,
        4 for each checkpoint."""
        digits = np.array([f"{i:04x}" for i in range(65536)] + ["...."])
        words = digits[self.bins]
        counts = (self.checks >= 0).sum(axis=1)
        return [f"{h:016x}{''.join(w)}{n:08x}{''.join(digits[c[:k]])}" for h, w, n, c, k in zip(self.whole.tolist(), words, self.sizes.tolist(), self.checks, counts.tolist(), strict=True)]

    def likenesses(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """likeness() of the fingerprints of the texts at a and at b."""
        x, y = self.bins[a], self.bins[b]
        j = ((x == y) & (x >= 0)).sum(axis=1) / np.maximum(((x >= 0) | (y >= 0)).sum(axis=1), 1)
        c, d = self.checks[a], self.checks[b]
        steps = np.cumprod((c == d) & (c >= 0), axis=1).sum(axis=1)
        common = np.concatenate([[0], self.at])[steps]
        both = self.sizes[a] + self.sizes[b]
        equal = (self.whole[a] == self.whole[b]) & (x == y).all(axis=1) & (c == d).all(axis=1) & (self.sizes[a] == self.sizes[b])
        return np.where(equal, 1.0, np.maximum(2 * j / (1 + j), 2 * common / np.maximum(both, 1)))


def likeness(a: str, b: str) -> float:
    """How alike two fingerprints are, 0 to 1: an estimate of the share of spans in common.

    Equal fingerprints: 1. Otherwise the greater of 2j / (1 + j), where j is the share of bins in
    which both agree among the bins that either fills, and the share of both texts that lies before
    the last checkpoint up to which their prefixes are equal.
    """
    if a == b:
        return 1.0
    end = 16 + 4 * BINS
    parts = [(a[i : i + 4], b[i : i + 4]) for i in range(16, end, 4)]
    used = sum(x != "...." or y != "...." for x, y in parts)
    same = sum(x == y != "...." for x, y in parts)
    j = same / used if used else 0.0
    sizes = int(a[end : end + 8], 16), int(b[end : end + 8], 16)
    checks = [[x[i : i + 4] for i in range(end + 8, len(x), 4)] for x in (a, b)]
    steps = next((k for k, (x, y) in enumerate(zip(*checks, strict=False)) if x != y), min(map(len, checks)))
    common = int(checkpoints(min(sizes))[steps - 1]) if steps else 0
    return max(2 * j / (1 + j), 2 * common / max(sum(sizes), 1))


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("common_prefix", pa.int64())])


def compare(rows: list[tuple[int | None, str]], following: str) -> dict:
    """The result's columns for texts in order; ``following`` is the text after the last."""
    texts = [t for _, t in rows]
    after = [*texts[1:], following]
    edited = []
    for text, nxt in zip(texts, after, strict=True):
        cut = len(text) // 4
        edited.append(text[: len(text) - cut] + nxt[:cut])
    n = len(texts)
    sketch = Sketches([*texts, following, *edited])
    own, off = np.arange(n), sketch.off
    a, b = off[:n], off[n + 1 : 2 * n + 1]
    marks = sketch.fingerprints()
    return {
        "doc_id": [i for i, _ in rows],
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
        "fingerprint": marks[:n],
        "edited_fingerprint": marks[n + 1 :],
        "near_edited": sketch.likenesses(own, own + n + 1),
        "near_next": sketch.likenesses(own, own + 1),
        "common_prefix": sketch.prefix.common(a, b, np.minimum(sketch.sizes[:n], sketch.sizes[n + 1 :])),
    }


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket, then order; a row marked ahead only follows another."""
    held: list[tuple[int | None, str]] = []
    size, bucket = 0, None
    for batch in batches:
        texts, ids = batch.column("text"), batch.column("doc_id").to_pylist()
        buckets, ahead = batch.column("bucket").to_pylist(), batch.column("ahead").to_pylist()
        for a, b in slices(np.diff(ft.utf8(texts)[1]), 1 << 20):
            for i, text in enumerate(text_list(texts.slice(a, b - a)), a):
                if buckets[i] != bucket:
                    held, size, bucket = [], 0, buckets[i]
                if held and (size >= 1 << 20 or ahead[i]):
                    yield rebatch(compare(held, text), _RESULT)
                    held, size = [], 0
                if ahead[i]:
                    held, bucket = [], None
                    continue
                held.append((ids[i], text))
                size += len(text)
    # Every bucket ends with a row ahead, so nothing is held here.


def neighbour_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text of ``docs``, its edited text and the next document's.

    Columns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, and common_prefix (code points the text and the edited one share from the start).
    The edited text has its last floor(n/4) code points replaced by the first as many of the next
    document's, in ascending doc_id (nulls first; rows that repeat a doc_id by the hash of their
    text); after the last comes the first, alone a document follows itself. Null text: empty. An
    empty text is like another empty text only. No rows: no rows. Other columns are ignored.

    Documents are dealt out by ranges of ids, once; the first row of a range goes to the range
    before it too, so that every range is worked off alone, in order. Only the ranges' bounds, a
    number of at most MAX_BUCKETS ids, come to the driver.
    """
    spark = docs.sparkSession
    short_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = docs.select("doc_id")
    n = ids.count()
    wanted = int(min(MAX_BUCKETS, max(1, n // BUCKET_DOCS)))
    ranged = materialize(ids.repartitionByRange(wanted, "doc_id").withColumn("part", F.spark_partition_id()))
    bounds = sorted(r["lo"] for r in ranged.groupBy("part").agg(F.min("doc_id").alias("lo")).collect() if r["lo"] is not None)
    bounds = sorted(set(bounds[1:]))
    last = len(bounds)
    firsts = spark.sparkContext.broadcast(np.array(bounds, np.int64))

    @F.pandas_udf("int")
    def bucket_of(doc_id):
        place = np.searchsorted(firsts.value, doc_id.fillna(-(2**63)).to_numpy().astype(np.int64), "right")
        place[doc_id.isna().to_numpy()] = 0
        return __import__("pandas").Series(place.astype(np.int32))

    placed = docs.withColumn("bucket", bucket_of("doc_id")).withColumn("tie", F.xxhash64("text"))
    # The least row of every bucket, by id and tie: one for each bucket.
    heads = placed.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "tie")).alias("head"))
    heads = {r["bucket"]: (r["head"]["doc_id"], r["head"]["tie"]) for r in heads.collect()}
    return _dealt(placed, heads, last)


def _dealt(placed: DataFrame, heads: dict, last: int) -> DataFrame:
    spark = placed.sparkSession
    order = sorted(heads)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    rows = [(b, heads[b][0], heads[b][1], before[b]) for b in order]
    marks = spark.createDataFrame(rows, "bucket int, doc_id long, tie long, target int")
    own = placed.withColumn("ahead", F.lit(False))
    # At most MAX_BUCKETS rows of numbers: small enough to broadcast whatever the input.
    same = [placed["bucket"] == marks["bucket"], placed["doc_id"].eqNullSafe(marks["doc_id"]), placed["tie"] == marks["tie"]]
    copies = placed.join(F.broadcast(marks), same).select(placed["doc_id"], "text", F.col("target").alias("bucket"), placed["tie"], F.lit(True).alias("ahead"))
    copies = copies.dropDuplicates(["bucket"])
    dealt = own.select("doc_id", "text", "bucket", "tie", "ahead").unionByName(copies)
    dealt = dealt.repartition(max(1, len(order)), "bucket").sortWithinPartitions("bucket", "ahead", F.col("doc_id").asc_nulls_first(), "tie")
    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long"
    return dealt.drop("tie").mapInArrow(_neighbours, kinds)


def op8_fingerprints(spark, sf_dir):
    """Fingerprints of all documents."""
    return neighbour_fingerprints(table(spark, sf_dir, "documents", "doc_id", "text"))
