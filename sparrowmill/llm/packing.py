"""Packing of token sequences by minimum bin slack.

Documents become tokens, are cut at multiples of the window, and their remainders are packed: for
each window a bitset subset-sum programme over the multiset of remaining lengths finds the filling
closest to the window, and backtracking gives how many of each length it takes. What is left in
the end and fills no window is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flattext as ft
from .common import materialize, rebatch, short_batches, slices, text_list

WINDOW = 2048
#: A window with more padding than this is cut into powers of two instead.
SLACK = 8
#: Documents that one group packs together, about; the number of groups grows with the input.
GROUP_DOCS = 20_000
END_ID = 1
#: Words, and pieces of words, whose ids a worker keeps.
CACHE_WORDS = 300_000
#: What str.split() takes for white space and the vocabulary does not.
ODD = re.compile("[\x1c-\x1f]")

#: Words that the fast path reads: ASCII without blanks and controls, and Latin-1 letters. They are
#: in normal form C, and their lower case does not depend on what stands beside them.
PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: Fixed value: the vocabulary's own pattern, for words of that kind in lower case.
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable bytes are themselves,
    the others follow from U+0100 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Pieces(dict):
    """piece -> ids, by the tokenizer's model alone."""

    def __init__(self, tokenizer):
        super().__init__()
        self.model, self.letters = tokenizer.model, byte_letters()

    def __missing__(self, piece: str) -> bytes:
        written = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
        ids = array("I", [t.id for t in self.model.tokenize(written)])
        if sys.byteorder == "big":
            ids.byteswap()
        self[piece] = ids = ids.tobytes()
        return ids


class _Words(dict):
    """word -> ids; plain words by their pieces, others by the whole tokenizer."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.pieces = tokenizer, _Pieces(tokenizer)
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(word) < 200 and word.isascii() and word.isalpha():
            ids = self.pieces[word.lower()]  # one piece, whatever its letters
        elif len(word) < 200 and PLAIN.fullmatch(word) and not ("<" in word and any(x in word for x in self.special)):
            ids = b"".join(map(self.pieces.__getitem__, PIECES.findall(word.lower())))
        else:
            ids = self.whole(word)
        self[word] = ids
        return ids


_tokenizers: dict[str, WordTokenizer] = {}


class WordTokenizer:
    """Token ids of whole texts through a bounded cache of words.

    The vocabulary's patterns never cross white space, so a text's ids are those of its words.
    Texts with separators that Python alone takes for white space are encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = _Words(self.tokenizer)

    @classmethod
    def shared(cls, path: str) -> WordTokenizer:
        """One for each process, so that tasks of a worker share what it has seen."""
        if path not in _tokenizers:
            _tokenizers[path] = cls(path)
        return _tokenizers[path]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        # The two caches are bounded apart: pieces are fewer than words and dearer to get.
        for cache in (self.words, self.words.pieces):
            if len(cache) > CACHE_WORDS:
                cache.clear()
        get, whole = self.words.__getitem__, self.words.whole
        return [whole(t) if ODD.search(t) else b"".join(map(get, t.split())) for t in texts]


def powers_of_two(n: int) -> list[int]:
    """n as a sum of powers of two, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def fill(counts: dict[int, int], order: list[int], window: int) -> dict[int, int]:
    """How many pieces of each length fill a window most closely; the longest piece is taken.

    ``counts``: pieces left of each length; ``order``: the lengths with pieces left, descending.
    Bit s of a bitset says that some choice sums to s; the bitsets before each added piece are
    kept, and walking them back from the best sum gives the counts.
    """
    longest = order[0]
    room = window - longest
    chosen = {longest: 1}
    if not room:
        return chosen
    bits, mask, goal, history = 1, (1 << (room + 1)) - 1, 1 << room, []
    for length in order:
        if length > room:
            continue
        for _ in range(min(counts[length] - (length == longest), room // length)):
            more = bits | bits << length & mask
            if more == bits:
                break
            history.append((length, bits))
            bits = more
            if bits & goal:
                break
        if bits & goal:
            break
    best = bits.bit_length() - 1
    for length, before in reversed(history):
        if not before >> best & 1:
            chosen[length] = chosen.get(length, 0) + 1
            best -= length
    return chosen


def plan(lengths: list[int], window: int = WINDOW) -> list[list[int]]:
    """Windows as lists of positions in ``lengths``; each position is in one window."""
    waiting: dict[int, list[int]] = {}
    for at in range(len(lengths) - 1, -1, -1):
        waiting.setdefault(int(lengths[at]), []).append(at)
    counts = {n: len(w) for n, w in waiting.items()}
    order = sorted(counts, reverse=True)
    out = []
    while order:
        taken = fill(counts, order, window)
        row = []
        for length, n in taken.items():
            row += [waiting[length].pop() for _ in range(n)]
            counts[length] -= n
        if not all(counts[n] for n in taken):
            order = [n for n in order if counts[n]]
        out.append(row)
    return out


_TOKENS = pa.schema([("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("window_crcs", pa.list_(pa.int64())), ("rest_crc", pa.int64()), ("part_crcs", pa.list_(pa.int64()))])


def _tokenized(path: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer.shared(path)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            texts = batch.column("text")
            for a, b in slices(np.diff(ft.utf8(texts)[1])):
                rows = {name: [] for name in _TOKENS.names}
                for ids in tokenizer.encode(text_list(texts.slice(a, b - a))):
                    ids = memoryview(ids + end)
                    full = len(ids) // (4 * window)
                    rows["doc_tokens"].append(len(ids) // 4)
                    rows["window_crcs"].append([zlib.crc32(ids[4 * window * k : 4 * window * (k + 1)]) for k in range(full)])
                    rest = ids[4 * window * full :]
                    rows["rest_crc"].append(zlib.crc32(rest))
                    parts, at = [], 0
                    for size in powers_of_two(len(rest) // 4):
                        parts.append(zlib.crc32(rest[at : at + 4 * size]))
                        at += 4 * size
                    rows["part_crcs"].append(parts)
                rows["doc_id"] = batch.column("doc_id").slice(a, b - a)
                yield rebatch(rows, _TOKENS)

    return run


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _packed(window: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "doc_tokens", "rest_crc"], kind="stable")
        group = int(frame["grp"].iloc[0]) << 32
        sequence, out = 0, []
        docs = list(zip(frame["doc_id"].astype("Int64"), frame["doc_tokens"], frame["window_crcs"], frame["rest_crc"], frame["part_crcs"], strict=True))
        rests = []
        for at, (doc, total, crcs, *_) in enumerate(docs):
            for k, crc in enumerate(crcs):
                out.append((doc, k * window, window, crc, total, group + sequence, 0))
                sequence += 1
            if total % window:
                rests.append(at)
        for row in plan([docs[at][1] % window for at in rests], window):
            members = [docs[rests[i]] for i in row]
            used = sum(d[1] % window for d in members)
            if window - used <= SLACK or used & (used - 1) == 0:
                offset = 0
                for doc, total, _, crc, _ in members:
                    rest = total % window
                    out.append((doc, total - rest, rest, crc, total, group + sequence, offset))
                    offset += rest
                sequence += 1
                continue
            for doc, total, _, _, parts in members:
                start = total - total % window
                for size, crc in zip(powers_of_two(total % window), parts, strict=True):
                    out.append((doc, start, size, crc, total, group + sequence, 0))
                    start += size
                    sequence += 1
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in _PIECES.split(", ")])
        return frame.astype({"doc_id": "Int64"})

    return run


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, group_docs: int = GROUP_DOCS) -> DataFrame:
    """The pieces of all ``docs`` (doc_id, text) in sequences of at most ``window`` tokens.

    Columns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Every document ends
    with id 1; a null or empty text is that id alone. Pieces of a sequence lie gaplessly from
    offset 0. A sequence lacks at most SLACK tokens of ``window`` or is a power of two. Rows that
    repeat, or have a null doc_id, are documents of their own. No rows: no rows. Other columns of
    ``docs`` are ignored.

    Texts are tokenised once, in place; only lengths and checksums go to the packing groups, whose
    number grows with the documents. A document of any length is one row there.
    """
    short_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = "doc_id long, doc_tokens long, window_crcs array<long>, rest_crc long, part_crcs array<long>"
    tokens = materialize(docs.mapInArrow(_tokenized(tokenizer_path, window), kinds))
    groups = max(1, -(-tokens.count() // group_docs))
    key = F.pmod(F.xxhash64("doc_id", "doc_tokens", "rest_crc"), F.lit(groups))
    return tokens.withColumn("grp", key).groupBy("grp").applyInPandas(_packed(window), _PIECES)
