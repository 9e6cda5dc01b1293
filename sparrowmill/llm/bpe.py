"""Byte-level BPE over rank files, with padded numpy matrices.

Pieces of text that are not cached are grouped by length and laid out as rows of a padded matrix.
In each round every row merges its leftmost pair of least rank; ranks come from a hash table of
pairs, and rows and columns are compacted as rows get shorter or have no pair left.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flattext as ft
from .common import rebatch, short_batches, slices, text_list

NONE = np.int32(2**31 - 1)
#: Longest row of a matrix; a longer piece is merged alone, all equal pairs of a round together.
WIDEST = 2048
CACHE_CHUNKS = 300_000


class _Index(dict):
    def __missing__(self, word: str) -> int:
        self[word] = row = len(self)
        return row


class PairTable:
    """Open-addressing hash table (left id, right id) -> rank, looked up for whole arrays."""

    def __init__(self, pairs: np.ndarray, ranks: np.ndarray):
        self.bits = max(4, int(4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        slot, left = self._slot(pairs), np.arange(len(pairs))
        self.reach = 0
        while len(left):
            self.reach += 1
            free = self.keys[slot] == np.uint64(2**64 - 1)
            first = np.unique(slot[free], return_index=True)[1]
            put = np.flatnonzero(free)[first]
            self.keys[slot[put]], self.ranks[slot[put]] = pairs[left[put]], ranks[left[put]]
            stay = np.ones(len(left), bool)
            stay[put] = False
            left, slot = left[stay], (slot[stay] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair; NONE where there is none, or an id is negative."""
        shape = a.shape
        keys = ((a.astype(np.uint64) << np.uint64(32)) | (b.astype(np.uint64) & np.uint64(0xFFFFFFFF))).ravel()
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.ranks[slot], NONE)
        open_ = np.flatnonzero((found != keys) & (found != np.uint64(2**64 - 1)))
        keys, slot = keys[open_], slot[open_]
        while len(open_):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot]
            hit = found == keys
            out[open_[hit]] = self.ranks[slot[hit]]
            more = ~hit & (found != np.uint64(2**64 - 1))
            open_, keys, slot = open_[more], keys[more], slot[more]
        return out.reshape(shape)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class BytePairs:
    """Encoder and decoder for one rank file and one splitting pattern."""

    def __init__(self, path: str, pattern: str):
        import regex

        ranks = read_ranks(path)
        self.size = max(ranks.values()) + 1
        self.bytes_of = [b""] * self.size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        # Any two tokens whose bytes together are a token are a pair of that token's rank.
        pairs, of = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                if (a := ranks.get(token[:cut])) is not None and (b := ranks.get(token[cut:])) is not None:
                    pairs.append(a << 32 | b)
                    of.append(rank)
        self.table = PairTable(np.array(pairs, np.uint64), np.array(of, np.int32))
        self.text_of = [str(i) for i in range(self.size)]
        self.whole = {token: np.array([rank], "<u4").tobytes() for token, rank in ranks.items()}
        self.pieces = regex.compile(pattern).findall
        self.uneven = regex.compile(r"\s ").search
        self.cuts = regex.compile(r"(?<=\S)(?= )", flags=regex.V1).split
        self.index, self.ids = _Index(), []

    def merge_matrix(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """Little-endian ids of each row of a matrix, padded with -1 on the right, after all merges."""
        out: list[bytes] = [b""] * len(ids)
        rows = np.arange(len(ids))
        rank = self.table.get(ids[:, :-1], ids[:, 1:]) if ids.shape[1] > 1 else np.full((len(ids), 0), NONE)
        lost = 0
        while len(rows):
            if not ids.shape[1] or not rank.shape[1]:
                best = np.full(len(rows), NONE)
                at = np.zeros(len(rows), np.int64)
            else:
                at = rank.argmin(axis=1)
                best = rank[np.arange(len(rows)), at]
            done = best == NONE
            if done.any():
                # Every row that is still here has lost one id in each round.
                data, step = ids[done].astype("<u4").tobytes(), 4 * ids.shape[1]
                for i, (row, size) in enumerate(zip(rows[done].tolist(), sizes[rows[done]].tolist(), strict=True)):
                    out[row] = data[i * step : i * step + 4 * (size - lost)]
            live = np.flatnonzero(~done)
            if not len(live):
                break
            ids, rank, rows, at, best = ids[live], rank[live], rows[live], at[live], best[live]
            each = np.arange(len(rows))
            lost += 1
            # All rows lose one id: columns after the merged pair move left by one.
            column = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, column + (column > at[:, None]), axis=1)
            ids[each, at] = best
            column = np.arange(rank.shape[1] - 1)
            rank = np.take_along_axis(rank, column + (column >= at[:, None]), axis=1)
            if rank.shape[1]:
                some = at < rank.shape[1]
                rank[each[some], at[some]] = self.table.get(ids[each[some], at[some]], ids[each[some], at[some] + 1])
                some = at > 0
                rank[each[some], at[some] - 1] = self.table.get(ids[each[some], at[some] - 1], ids[each[some], at[some]])
        return out

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """Ids of one long piece. A round merges the occurrences of the least pair from the left,
        up to the first whose new neighbours rank below it: the order of single merges."""
        while len(ids) > 1:
            rank = self.table.get(ids[:-1], ids[1:])
            best = rank.min()
            if best == NONE:
                break
            at = np.flatnonzero(rank == best)
            if ids[at[0]] == ids[at[0] + 1]:  # runs of one id: every second of a run
                begin = np.concatenate([[True], np.diff(at) > 1])
                offset = np.arange(len(at)) - np.maximum.accumulate(np.where(begin, np.arange(len(at)), 0))
                at = at[offset % 2 == 0]
            left = np.where(at > 0, ids[at - 1], -1)
            left[1:] = np.where(np.diff(at) == 2, best, left[1:])
            right = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
            made = np.full(len(at), best)
            lower = (self.table.get(left, made) < best) | (self.table.get(made, right) < best)
            if lower.any():
                at = at[: int(lower.argmax()) + 1]
            ids = ids.copy()
            ids[at] = best
            ids = np.delete(ids, at + 1)
        return ids

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of distinct pieces, in buckets of like length."""
        out: list[bytes] = [self.whole.get(p, b"") for p in pieces]
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if p and not out[i]:
                buckets.setdefault((len(p) + 3) // 4 * 4 if len(p) <= 64 else 1 << len(p).bit_length(), []).append(i)
        for width, members in buckets.items():
            if width > WIDEST:
                for i in members:
                    ids = self.merge_long(self.single[np.frombuffer(pieces[i], np.uint8)])
                    out[i] = ids.astype("<u4").tobytes()
                continue
            block = max(1, 2_000_000 // width)
            for a in range(0, len(members), block):
                part = members[a : a + block]
                raw = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in part), np.uint8).reshape(-1, width)
                sizes = np.array([len(pieces[i]) for i in part])
                ids = np.where(np.arange(width) < sizes[:, None], self.single[raw], np.int32(-1))
                for i, found in zip(part, self.merge_matrix(ids, sizes), strict=True):
                    out[i] = found
        return out

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        split = [[p.encode("utf-8", "surrogatepass") for p in self.pieces(c)] for c in chunks]
        known = list(dict.fromkeys(chain.from_iterable(split)))
        ids = dict(zip(known, self.encode_pieces(known), strict=True))
        return [b"".join(map(ids.__getitem__, part)) for part in split]

    def chunks(self, text: str) -> list[str]:
        """The text in pieces that may be split apart: cut before a space that follows no white space."""
        if self.uneven(text):
            return self.cuts(text)
        first, *rest = text.split(" ")
        return [first, *(" " + x for x in rest)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.index) > CACHE_CHUNKS:
            self.index, self.ids = _Index(), []
        split = [self.chunks(t) for t in texts]
        codes = list(map(self.index.__getitem__, chain.from_iterable(split)))
        if new := len(self.index) - len(self.ids):
            self.ids += self.encode_chunks(list(islice(reversed(self.index), new))[::-1])
        out, at, get = [], 0, self.ids.__getitem__
        for part in split:
            out.append(np.frombuffer(b"".join(map(get, codes[at : at + len(part)])), "<u4"))
            at += len(part)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _runner(path: str, pattern: str, schema: pa.Schema, rows_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = BytePairs(path, pattern)
        for batch in batches:
            texts = batch.column("text")
            for a, b in slices(np.diff(ft.utf8(texts)[1])):
                rows = {name: [] for name in schema.names[1:]}
                for ids in coder.encode(text_list(texts.slice(a, b - a))):
                    for name, value in zip(schema.names[1:], rows_of(coder, ids), strict=True):
                        rows[name].append(value)
                yield rebatch({"doc_id": batch.column("doc_id").slice(a, b - a)} | rows, schema)

    return run


def _prepared(docs: DataFrame) -> DataFrame:
    short_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text; null or empty: no ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    return _prepared(docs).mapInArrow(_runner(path, pattern, schema, lambda coder, ids: (ids.astype(np.int32),)), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); bytes that are no UTF-8 become U+FFFD; null ids: empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = BytePairs(path, pattern)
        for batch in batches:
            texts = [coder.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    short_batches(encoded.sparkSession)
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each whole text encoded, then its ids decoded.

    One row for each row of ``docs``; null text is empty; no rows: no rows; other columns are
    ignored. A narrow scan without a shuffle.
    """

    def digests(coder: BytePairs, ids: np.ndarray):
        listed = ids.tolist()
        decimal = " ".join(map(coder.text_of.__getitem__, listed)).encode()
        return len(listed), hashlib.sha256(decimal).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()

    return _prepared(docs).mapInArrow(_runner(path, pattern, _DIGESTS, digests), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
