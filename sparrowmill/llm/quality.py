"""Quality classification by attention-based multiple-instance learning.

A document is a bag of passages, stretches of words. Every passage is encoded from counts over
its bytes and words; a small network turns the encoding into a representation, gated attention
learns from document labels alone how much each passage counts, and the weighted representation
is scored. Training is plain numpy on a bounded sample; scoring works on the byte buffers of
whole slices of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flattext as ft
from .common import crc_of_id, passing, rebatch, short_batches, slices, spread, table

PASSAGE_WORDS = 48
#: Bound of the labelled sample: at most so many documents, drawn by a hash of doc_id.
TRAIN_DOCS = 3000
HIDDEN, ATTENTION, EPOCHS, BATCH = 24, 16, 24, 64
THRESHOLD = 0.3

#: Byte classes: other control, blank, newline, lower, upper, digit, sentence marks, quotes and
#: brackets, other ASCII symbols (pipes apart), pipes, UTF-8 lead bytes, UTF-8 continuation bytes.
CLASSES = 12


def _byte_classes() -> np.ndarray:
    out = np.zeros(256, np.int64)
    groups = [b"", b" \t", b"\n\r\x0b\x0c", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".,;:?!", b"\"'()[]{}", b"#$%&*+-/<=>@\\^_`~", b"|"]
    for at, group in enumerate(groups):
        out[list(group)] = at
    out[0xC0:] = 10
    out[0x80:0xC0] = 11
    return out


_CLASS = _byte_classes()
FEATURES = CLASSES * CLASSES + 6


def passages(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each passage, (passages, FEATURES) encodings); a text without words is one passage."""
    n = len(off) - 1
    start, end, rows = ft.words(raw, off)
    counts = np.bincount(rows, minlength=n)
    per_row = np.maximum(1, -(-counts // PASSAGE_WORDS))
    first_passage = np.cumsum(per_row) - per_row
    total = int(per_row.sum())
    owner = np.repeat(np.arange(n), per_row)
    place = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    of_word = first_passage[rows] + place // PASSAGE_WORDS if len(rows) else np.zeros(0, np.int64)
    # A byte belongs to the passage of the word that began last before it, in its text.
    mark = np.zeros(len(raw) + 1, np.int64)
    lead = np.ones(len(start), bool)
    lead[1:] = of_word[1:] != of_word[:-1]
    begin = np.zeros(total, np.int64)
    begin[of_word[lead]] = start[lead]
    begin[first_passage] = off[:-1]
    np.add.at(mark, begin, 1)
    of_byte = np.cumsum(mark[:-1]) - 1 if len(raw) else np.zeros(0, np.int64)
    kinds = _CLASS[raw]
    pair = np.zeros((total, CLASSES * CLASSES))
    if len(raw) > 1:
        key = of_byte[1:] * (CLASSES * CLASSES) + kinds[:-1] * CLASSES + kinds[1:]
        # No pair over the border of two texts: a text's encoding does not depend on its neighbours.
        inside = np.ones(len(key), bool)
        border = off[1:-1]
        inside[border[(border > 0) & (border < len(raw))] - 1] = False
        pair = np.bincount(key[inside], minlength=total * CLASSES * CLASSES).reshape(total, -1).astype(np.float64)
    n_pairs = np.maximum(pair.sum(axis=1, keepdims=True), 1)
    x = np.zeros((total, FEATURES), np.float32)
    x[:, : CLASSES * CLASSES] = np.sqrt(pair / n_pairs) * 3
    words = np.bincount(of_word, minlength=total)
    some = np.maximum(words, 1)
    extra = x[:, CLASSES * CLASSES :]
    extra[:, 0] = np.log1p(words) / 4
    extra[:, 1] = np.log1p(counts[owner]) / 8
    if len(start):
        hashes = ft.word_hashes(raw, start, end)
        extra[:, 2] = np.bincount(of_word, weights=end - start, minlength=total) / some / 8
        again = np.zeros(len(hashes))
        again[1:] = (hashes[1:] == hashes[:-1]) & (of_word[1:] == of_word[:-1])
        extra[:, 3] = np.bincount(of_word, weights=again, minlength=total) / some
        rank = np.lexsort((hashes, of_word))
        h, p = hashes[rank], of_word[rank]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (p[1:] != p[:-1])
        extra[:, 4] = np.bincount(p[fresh], minlength=total) / some
    extra[:, 5] = np.arange(total) == first_passage[owner]
    return owner, x


def _sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, begin, axis=0)


@dataclass
class Network:
    """h = tanh(x w + b); attention logits (tanh(h v) * sigmoid(h u)) a; score of the weighted mean of h."""

    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    u: np.ndarray
    a: np.ndarray
    c: np.ndarray
    d: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    @classmethod
    def new(cls, mean: np.ndarray, scale: np.ndarray, seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        return cls(init(len(mean), HIDDEN), np.zeros(HIDDEN, np.float32), init(HIDDEN, ATTENTION), init(HIDDEN, ATTENTION), init(ATTENTION, 1), init(HIDDEN, 1), np.zeros(1, np.float32), mean, scale)

    def forward(self, x: np.ndarray, begin: np.ndarray):
        """Scores of the documents whose passages start at ``begin``, and what the gradient needs."""
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ self.w + self.b)
        t, g = np.tanh(h @ self.v), 1 / (1 + np.exp(-(h @ self.u)))
        logit = ((t * g) @ self.a)[:, 0]
        size = np.diff(np.append(begin, len(x)))
        e = np.exp(logit - np.repeat(np.maximum.reduceat(logit, begin), size))
        weight = e / np.repeat(_sums(e, begin), size)
        z = _sums(h * weight[:, None], begin)
        score = 1 / (1 + np.exp(-np.clip((z @ self.c)[:, 0] + self.d[0], -30, 30)))
        return score, (x, h, t, g, weight, z, size)

    def gradients(self, x: np.ndarray, begin: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        score, (x, h, t, g, weight, z, size) = self.forward(x, begin)
        out = (score - y).astype(np.float32)[:, None] / len(y)
        dz = np.repeat(out @ self.c.T, size, axis=0)
        dh = dz * weight[:, None]
        pull = (dz * h).sum(axis=1) * weight
        dlogit = (pull - weight * np.repeat(_sums(pull, begin), size))[:, None]
        dm = dlogit @ self.a.T
        dt, dg = dm * g * (1 - t * t), dm * t * g * (1 - g)
        dh = dh + dt @ self.v.T + dg @ self.u.T
        dx = dh * (1 - h * h)
        return {"w": x.T @ dx, "b": dx.sum(axis=0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ dlogit, "c": z.T @ out, "d": out.sum(axis=0)}


def fit(x: np.ndarray, sizes: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> Network:
    """Train on documents of ``sizes`` passages each with labels ``y``; Adam, decaying steps."""
    mean = x.mean(axis=0) if len(x) else np.zeros(FEATURES, np.float32)
    scale = (x.std(axis=0) if len(x) else np.zeros(FEATURES, np.float32)) + 0.05
    net = Network.new(mean.astype(np.float32), scale.astype(np.float32), seed)
    if not len(y):
        return net
    first = np.cumsum(sizes) - sizes
    rng, names = np.random.default_rng(seed), ["w", "b", "v", "u", "a", "c", "d"]
    m, s, turn = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    steps = epochs * -(-len(y) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            docs = order[at : at + BATCH]
            size = sizes[docs]
            begin = np.cumsum(size) - size
            pick = np.repeat(first[docs] - begin, size) + np.arange(size.sum())
            turn += 1
            rate = 0.01 * (1 - turn / (steps + 1)) + 1e-4
            for k, gradient in net.gradients(x[pick], begin, y[docs]).items():
                gradient = gradient + 1e-4 * getattr(net, k)
                m[k], s[k] = 0.9 * m[k] + 0.1 * gradient, 0.999 * s[k] + 0.001 * gradient**2
                step = m[k] / (1 - 0.9**turn) / (np.sqrt(s[k] / (1 - 0.999**turn)) + 1e-8)
                setattr(net, k, (getattr(net, k) - rate * step).astype(np.float32))
    return net


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        for a, b in slices(np.diff(ft.utf8(texts)[1])):
            owner, x = passages(*ft.utf8(texts.slice(a, b - a)))
            ends = np.searchsorted(owner, np.arange(b - a + 1))
            rows = [x[i:j].astype(np.float16).tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("quality").slice(a, b - a), pa.array(rows, pa.binary())], names=["doc_id", "quality", "x"])


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Network:
    """A network from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality).

    At most ``most`` labelled ids, the first by a hash, are used; they are few enough to broadcast.
    Null ids and labels are not used; of several labels of an id the least counts. No labelled
    rows: an untrained network.
    """
    usable = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = usable.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(most)
    short_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.select("doc_id", F.col("quality").cast("int").alias("quality"), "text")
    got = rows.mapInArrow(_encoded, "doc_id long, quality int, x binary").toPandas().sort_values(["doc_id", "x"])
    if not len(got):
        return fit(np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64), np.zeros(0))
    parts = [np.frombuffer(b, np.float16).reshape(-1, FEATURES) for b in got["x"]]
    return fit(np.concatenate(parts).astype(np.float32), np.array([len(p) for p in parts]), got["quality"].to_numpy(np.float32))


_RESULT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])


def score(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted (1 where score >= threshold) of every whole text of ``docs``.

    A null, empty or blank text is one passage without words, scored like any other. Repeated rows
    are scored each. No rows: no rows. Other columns of ``docs`` are ignored. A narrow scan.
    """
    short_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(net), threshold), "doc_id long, score double, predicted int")


def accepted(docs: DataFrame, net: Network) -> DataFrame:
    """The rows of ``docs``, all columns, whose own text the classifier does not reject."""
    return passing(docs, _scorer(docs.sparkSession.sparkContext.broadcast(net), THRESHOLD), lambda told: pc.equal(told["predicted"], 1))


def _scorer(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a, b in slices(np.diff(ft.utf8(texts)[1])):
                owner, x = passages(*ft.utf8(texts.slice(a, b - a)))
                value = shared.value.forward(x, np.searchsorted(owner, np.arange(b - a)))[0].astype(np.float64)
                yield rebatch({"doc_id": batch.column("doc_id").slice(a, b - a), "score": value, "predicted": (value >= threshold).astype(np.int32)}, _RESULT)

    return run


def op5_quality(spark, sf_dir):
    """Quality scores of all documents; rows with crc32(doc_id) mod 5 = 0 are held out."""
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text"))
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    net = train(docs, labels.where(F.pmod(crc_of_id(), F.lit(5)) != 0))
    return score(docs, net).withColumn("held_out", F.pmod(crc_of_id(), F.lit(5)) == 0)
