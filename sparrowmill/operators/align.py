"""Alignment of long texts by anchors: unique k-grams, rising chains, blocks, sentence spans."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.edits import increasing_chain, long_trace
from ..functions.text import ColumnLike, column


def kgrams(rows: DataFrame, key: str | None, text: ColumnLike, k: int) -> DataFrame:
    """(key, pos, gram) of every k code points of a text."""
    t = column(text)
    n = F.length(t) - k + 1
    positions = F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    picked = rows.select(*([F.col(key).alias("key")] if key else []), t.alias("__t"), F.explode(positions).alias("pos"))
    return picked.select(*(["key"] if key else []), (F.col("pos") - 1).alias("pos"), F.substring(F.col("__t"), F.col("pos"), F.lit(k)).alias("gram"))


def once(grams: DataFrame, *keys: str) -> DataFrame:
    """K-grams that occur exactly once on a side, with their position: no window, one aggregate."""
    return grams.groupBy(*keys, "gram").agg(F.count("*").alias("__n"), F.min("pos").alias("pos")).where("__n = 1").drop("__n")


def unique_anchors(a: DataFrame, b: DataFrame, k: int = 8, *keys: str) -> DataFrame:
    """(keys, gram, i, j): k-grams (pos, gram) that occur once on either side."""
    left = once(a, *keys).withColumnRenamed("pos", "i")
    return left.join(once(b, *keys).withColumnRenamed("pos", "j"), [*keys, "gram"])


def rising_chains(anchors: DataFrame, key: str) -> DataFrame:
    """(key, i, j): a longest chain of anchors that rises in both texts, for each pair of texts."""
    kind = dict(anchors.dtypes)[key]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        chain = increasing_chain(list(zip(frame["i"].tolist(), frame["j"].tolist(), strict=True)))
        return pd.DataFrame([(frame[key].iloc[0], i, j) for i, j in chain], columns=[key, "i", "j"])

    return anchors.select(key, "i", "j").groupBy(key).applyInPandas(run, f"{key} {kind}, i long, j long")


def align_by_anchors(a: str, b: str, k: int = 8) -> dict[int, int]:
    """Position in a -> position in b where characters stand beside each other.

    Anchors split the texts into blocks, each aligned alone, a long one in linear memory.
    """
    def singles(t: str) -> dict[str, int]:
        seen: dict[str, int] = {}
        for at in range(len(t) - k + 1):
            seen[t[at : at + k]] = -1 if t[at : at + k] in seen else at
        return {g: at for g, at in seen.items() if at >= 0}

    there = singles(b)
    chain = increasing_chain([(i, there[g]) for g, i in singles(a).items() if g in there])
    out: dict[int, int] = {}
    for i, j in chain:
        out.update((i + d, j + d) for d in range(k))
    fixed = sorted(out.items())
    edges = [(-1, -1), *fixed, (len(a), len(b))]
    for (i0, j0), (i1, j1) in zip(edges, edges[1:], strict=False):
        rows, cols = i1 - i0 - 1, j1 - j0 - 1
        if rows > 0 and cols > 0:
            for i, j in long_trace(a[i0 + 1 : i1], b[j0 + 1 : j1]):
                if i is not None and j is not None and a[i0 + 1 + i] == b[j0 + 1 + j]:
                    out[i0 + 1 + i] = j0 + 1 + j
    return out


def sentence_matches(pairs: DataFrame, key: str, k: int = 8, least_match: float = 0.6) -> DataFrame:
    """(key, sentence, text, start, end, match_rate, n_matched, reject_reason) of every transcript sentence.

    ``pairs`` holds for each recording (key) its sentences (array<string>) and the recognised
    characters (array<struct<char, start, end>>). A sentence is rejected (low_match) where the share
    of its characters that stand beside a recognised one is below ``least_match``; one without any
    has no times. Recordings are independent; one is aligned by one task.
    """
    kind = dict(pairs.dtypes)[key]
    names = ["sentence", "text", "start", "end", "match_rate", "n_matched", "reject_reason"]

    def run(frames):
        for frame in frames:
            out = []
            for name, sentences, chars in zip(frame[key], frame["sentences"], frame["chars"], strict=True):
                sentences, chars = (list(x) if x is not None else [] for x in (sentences, chars))
                found = align_by_anchors("".join(sentences), "".join(c["char"] for c in chars), k)
                at = 0
                for number, text in enumerate(sentences):
                    hits = [found[i] for i in range(at, at + len(text)) if i in found]
                    at += len(text)
                    rate = len(hits) / max(len(text), 1)
                    times = (float(chars[min(hits)]["start"]), float(chars[max(hits)]["end"])) if hits else (None, None)
                    out.append((name, number, text, *times, rate, len(hits), None if hits and rate >= least_match else "low_match"))
            yield pd.DataFrame(out, columns=[key, *names])

    return pairs.select(key, "sentences", "chars").mapInPandas(run, f"{key} {kind}, sentence int, text string, start double, end double, match_rate double, n_matched int, reject_reason string")


def aligned_sentences(pairs: DataFrame, key: str, k: int = 8, least_match: float = 0.6) -> DataFrame:
    """The sentences that sentence_matches() does not reject."""
    return sentence_matches(pairs, key, k, least_match).where("reject_reason is null").drop("reject_reason")


def word_kgrams(rows: DataFrame, text: str, k: int, *keys: str) -> DataFrame:
    """(keys, pos, gram) of every k words of a text, in lower case."""
    words = F.split(F.lower(text), r"\s+")
    n = F.size("__w") - k + 1
    grams = F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice("__w", i, k), " ")))
    return rows.select(*keys, words.alias("__w")).select(*keys, F.posexplode(grams).alias("pos", "gram"))
