"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

A model is learned for each language from the character n-grams of words (a word stands between
boundary marks, contexts do not cross it). All n-grams of an order, over all languages, are one
sorted array of hashes with aligned columns: for each language the discounted probability of the
n-gram, and the back-off weight of the n-gram as a context. A text's cross-entropy is the mean
over its characters; the language with the lowest wins. A text is rejected where even the lowest
is above what held-aside texts of that language show.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, islice
from unicodedata import category

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flattext as ft
from .common import crc_of_id, passing, rebatch, short_batches, slices, spread, table, text_list, uniform

ORDER = 4
#: Bounds of the labelled sample: expected documents of each language for counts, and as many more to calibrate.
DOCS_PER_LANGUAGE = 400
DISCOUNT = 0.75
MARK = "\x02"
#: Words whose scores a worker keeps, and their characters; a text's words come on top.
CACHE_WORDS, CACHE_CHARS = 250_000, 8_000_000
#: Characters that are scored at once: a bound on memory for words of any length.
BLOCK = 1 << 17
UNKNOWN = "und"
#: A text is rejected above this multiple of what is usual for its language.
SLACK = 1.5
U64 = np.uint64
_STEP = U64(0x9E3779B97F4A7C15)


def letters(word: str) -> str:
    """The letters of a word, in lower case, with the combining marks among them; empty without a letter."""
    word = word.lower()
    if word.isalpha():
        return word
    kept = "".join(c for c in word if c.isalpha() or (not c.isascii() and category(c)[0] == "M"))
    return kept if any(map(str.isalpha, kept)) else ""


def gram_hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each position, for n = 1..order (garbage before n)."""
    base = ft.mix(codes.astype(U64) + U64(1))
    out = [base]
    for n in range(1, order):
        longer = np.zeros(len(codes), U64)
        longer[n:] = ft.mix(out[-1][n:] * _STEP + base[:-n] + U64(n)) if len(codes) > n else 0
        out.append(longer)
    return out


@dataclass
class Model:
    """keys[n]: sorted hashes of (n+1)-grams; prob[n], weight[n]: a row of languages for each, and one for unseen."""

    languages: list[str]
    keys: list[np.ndarray] = field(default_factory=list)
    prob: list[np.ndarray] = field(default_factory=list)
    weight: list[np.ndarray] = field(default_factory=list)
    start: np.ndarray | None = None
    floor: float = 1e-4
    limit: np.ndarray | None = None
    temperature: float = 1.0

    def word_scores(self, words: list[str]) -> np.ndarray:
        """For words as letters() gives them, (words, languages + 1): minus log probability of the letters and the end, and how many these are."""
        count = len(self.languages)
        out = np.zeros((len(words), count + 1))
        used = np.array([i for i, w in enumerate(words) if w], np.int64)
        if not len(used):
            return out
        codes = np.frombuffer("".join(MARK + words[i] + MARK for i in used).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(words[i]) + 2 for i in used])
        out[used, count] = sizes - 1
        begin = np.cumsum(sizes) - sizes
        order = len(self.keys)
        for low in range(0, len(codes), BLOCK):
            # A block sees the characters before it that its first contexts reach back to.
            first, high = max(0, low - order), min(len(codes), low + BLOCK)
            word = np.searchsorted(begin, np.arange(first, high), "right") - 1
            loss = self._losses(codes[first:high], np.arange(first, high) - begin[word])[low - first :]
            word = word[low - first :]
            lead = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            out[used[word[lead]], :count] += np.add.reduceat(loss, lead, axis=0)
        return out

    def _losses(self, codes: np.ndarray, place: np.ndarray) -> np.ndarray:
        """(characters, languages): minus log probabilities; ``place`` is the position in the word."""
        prob = np.full((len(codes), len(self.languages)), self.floor, np.float32)
        context = np.full(len(codes), -1)
        for n, hashes in enumerate(gram_hashes(codes, len(self.keys))):
            index = np.searchsorted(self.keys[n], hashes)
            index[index == len(self.keys[n])] = 0
            # -1, the last row of the tables, stands for an n-gram that no language has.
            index[(self.keys[n][index] != hashes) | (place < n)] = -1
            if n == 0:
                prob *= self.start.astype(np.float32)
            else:
                # The context of this n-gram is the (n-1)-gram that ends one position before.
                before = np.concatenate([[-1], context[:-1]])
                before[place < n] = -1
                prob *= self.weight[n - 1].take(before, axis=0)
            prob += self.prob[n].take(index, axis=0)
            context = index
        loss = -np.log(prob)
        loss[place == 0] = 0
        return loss


def fit(counts: dict[str, Counter], order: int = ORDER) -> Model:
    """A model from {language: counts of n-grams of length 1..order, words between marks}."""
    languages = sorted(counts)
    size = len({g for c in counts.values() for g in c if len(g) == 1}) + 1
    tables: list[dict[str, list]] = [{} for _ in range(order)]
    contexts: list[dict[str, np.ndarray]] = [{} for _ in range(order)]
    start = np.ones(len(languages))
    for at, language in enumerate(languages):
        raw = counts[language]
        # Continuation counts below the top order: in how many longer n-grams does it end?
        # An n-gram that begins a word has nothing to its left, so its own count stands.
        left = Counter(g[1:] for g in raw if len(g) > 1)
        total, kinds = Counter(), Counter()
        value = {}
        for gram, n in raw.items():
            if gram == MARK and len(gram) == 1:
                n_used = left.get(gram, n)
            elif len(gram) == order or gram[0] == MARK:
                n_used = n
            else:
                n_used = left.get(gram, 0)
            if n_used > 0:
                value[gram] = n_used
                total[gram[:-1]] += n_used
                kinds[gram[:-1]] += 1
        for gram, n in value.items():
            tables[len(gram) - 1].setdefault(gram, [0.0] * len(languages))[at] = max(n - DISCOUNT, 0) / total[gram[:-1]]
        for context, n in kinds.items():
            share = DISCOUNT * n / total[context]
            if context:
                contexts[len(context) - 1].setdefault(context, np.ones(len(languages)))[at] = share
            else:
                start[at] = share
    model = Model(languages, start=start, floor=1.0 / (size + 1))
    for n in range(order):
        grams = list(dict.fromkeys([*tables[n], *(contexts[n] if n + 1 < order else ())]))
        if not grams:
            break
        codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32)
        hashes = gram_hashes(codes, n + 1)[n][n :: n + 1]
        rank = np.argsort(hashes)
        zero, one = [0.0] * len(languages), np.ones(len(languages))
        model.keys.append(hashes[rank])
        model.prob.append(np.array([*(tables[n].get(grams[i], zero) for i in rank), zero], np.float32))
        model.weight.append(np.array([*(contexts[n].get(grams[i], one) for i in rank), one], np.float32))
    return model


class Index(dict):
    """Word -> row; a word that is asked for first gets the next row."""

    def __missing__(self, word: str) -> int:
        self[word] = row = len(self)
        return row


class Scorer:
    """Scores texts with a bounded cache of word scores."""

    def __init__(self, model: Model):
        self.model, self.index, self.pure = model, Index(), Index()
        self.pure_of, self.chars = np.zeros(0, np.int64), 0
        self.rows = np.zeros((0, len(model.languages) + 1), np.float32)

    def texts(self, texts: list[str]) -> np.ndarray:
        """(texts, languages + 1): summed losses and number of characters."""
        out = np.zeros((len(texts), self.rows.shape[1]))
        split = [t.split() for t in texts]
        sizes = np.array([len(p) for p in split])
        some = np.flatnonzero(sizes)
        if not len(some):
            return out
        if len(self.index) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self.__init__(self.model)
        codes = np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        if (new := len(self.index) - len(self.pure_of)) > 0:
            words = list(islice(reversed(self.index), new))[::-1]
            self.chars += sum(map(len, words))
            # Words that differ in case or punctuation only are scored once.
            pure = np.fromiter(map(self.pure.__getitem__, map(letters, words)), np.int64, new)
            self.pure_of = np.concatenate([self.pure_of, pure])
            fresh = list(islice(reversed(self.pure), len(self.pure) - len(self.rows)))[::-1]
            parts = [self.model.word_scores(fresh[i : i + 20_000]) for i in range(0, len(fresh), 20_000)]
            self.rows = np.concatenate([self.rows, *(p.astype(np.float32) for p in parts)])
        gathered = self.rows.take(self.pure_of.take(codes), axis=0)
        out[some] = np.add.reduceat(gathered, (np.cumsum(sizes) - sizes)[some], axis=0, dtype=np.float64)
        return out


_RESULT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("cross_entropy", pa.float64()), ("rejected", pa.bool_())])


def judge(model: Model, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index of the best language or -1, its score, its cross-entropy, rejected)."""
    n = sums[:, -1]
    mean = sums[:, :-1] / np.maximum(n, 1)[:, None]
    best = mean.argmin(axis=1)
    lowest = mean[np.arange(len(mean)), best]
    # The longer the text the surer a gap, up to a hundred characters.
    odds = np.exp(-(mean - lowest[:, None]) * np.minimum(n, 100)[:, None] / model.temperature)
    score = 1.0 / odds.sum(axis=1)
    rejected = (n == 0) | (lowest > model.limit[best] * (1 + 4 / np.sqrt(np.maximum(n, 1))))
    return np.where(n > 0, best, -1), np.where(n > 0, score, 0.0), lowest, rejected


def calibrate(model: Model, sums: np.ndarray, truth: np.ndarray) -> None:
    """Set the rejection limits and the temperature from texts that were held aside.

    limit: for each language, SLACK times the cross-entropy that all but one in a hundred of its
    own texts of 50 letters or more stay below (under 20 such texts: no limit). temperature: of a few, the one with the least
    log loss.
    """
    n = sums[:, -1]
    own = sums[np.arange(len(sums)), truth] / np.maximum(n, 1) if len(sums) else np.zeros(0)
    model.limit = np.full(len(model.languages), np.inf)
    for at in range(len(model.languages)):
        if len(seen := own[(truth == at) & (n >= 50)]) >= 20:
            model.limit[at] = SLACK * np.quantile(seen, 0.99)
    best = (np.inf, 1.0)
    for temperature in (0.5, 1.0, 2.0, 4.0, 8.0):
        model.temperature = temperature
        if len(sums):
            mean = sums[:, :-1] / np.maximum(n, 1)[:, None]
            scaled = -mean * np.minimum(n, 100)[:, None] / temperature
            scaled -= scaled.max(axis=1)[:, None]
            loss = float((np.log(np.exp(scaled).sum(axis=1)) - scaled[np.arange(len(sums)), truth]).mean())
            best = min(best, (loss, temperature))
    model.temperature = best[1]


def _count_grams(order: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            grams: dict[str, Counter] = {}
            for text, lang in zip(frame["text"], frame["lang"], strict=True):
                mine = grams.setdefault(lang, Counter())
                for word, times in Counter((text or "").split()).items():
                    if not (word := letters(word)):
                        continue
                    marked = MARK + word + MARK
                    for n in range(1, order + 1):
                        for i in range(len(marked) - n + 1):
                            mine[marked[i : i + n]] += times
            rows = [(lang, gram, n) for lang, c in grams.items() for gram, n in c.items()]
            yield pd.DataFrame(rows, columns=["lang", "gram", "n"]).astype({"lang": str, "gram": str, "n": "int64"})

    return run


def train(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE, order: int = ORDER) -> Model:
    """A calibrated model from labelled ``docs`` (doc_id, text, lang).

    Learns from about ``per_language`` documents of each language and calibrates on about as many
    others; both are drawn by a hash of doc_id, whatever the size of ``docs``. Null lang or text:
    not used. No labelled rows: a model without languages.
    """
    docs = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([])
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(0.5, per_language / n))).otherwise(share)
    sample = docs.withColumn("draw", uniform("doc_id", seed=11)).withColumn("share", share).where("draw < 2 * share")
    counted = sample.where("draw < share").select("text", "lang").mapInPandas(_count_grams(order), "lang string, gram string, n long")
    counts: dict[str, Counter] = {lang: Counter() for lang in sizes}
    for lang, gram, n in counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas().itertuples(index=False):
        counts[lang][gram] = int(n)
    model = fit({lang: c for lang, c in counts.items() if c}, order)
    at = {lang: i for i, lang in enumerate(model.languages)}
    if not at:
        return model
    model.limit = np.full(len(at), np.inf)
    scored = sample.where("draw >= share").select("text", "lang").mapInArrow(_score_labelled(model), "lang string, sums array<double>").toPandas()
    scored = scored[scored["lang"].isin(list(at))]
    sums = np.array([list(x) for x in scored["sums"]]).reshape(-1, len(at) + 1)
    some = sums[:, -1] > 0 if len(sums) else np.zeros(0, bool)
    calibrate(model, sums[some], scored["lang"].map(at).to_numpy(np.int64)[some])
    return model


def _score_labelled(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            sums = scorer.texts(text_list(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(list(sums), pa.list_(pa.float64()))], names=["lang", "sums"])

    return run


def _predictor(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        scorer = Scorer(own)
        names = np.array([*own.languages, UNKNOWN], object)
        for batch in batches:
            texts = batch.column("text")
            for a, b in slices(np.diff(ft.utf8(texts)[1])):
                sums = scorer.texts(text_list(texts.slice(a, b - a)))
                best, score, entropy, rejected = judge(own, sums)
                yield rebatch({"doc_id": batch.column("doc_id").slice(a, b - a), "lang_pred": names[best], "score": score, "cross_entropy": entropy, "rejected": rejected}, _RESULT)

    return run


def _nothing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        yield rebatch({"doc_id": batch.column("doc_id"), "lang_pred": [UNKNOWN] * n, "score": np.zeros(n), "cross_entropy": np.zeros(n), "rejected": np.ones(n, bool)}, _RESULT)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy, rejected of every whole text of ``docs``.

    A text that is null or has no letter is ``und``, score 0, rejected. Rejected too: a text whose
    lowest cross-entropy is above its language's calibrated limit. Equal cross-entropies go to the
    language first in alphabetical order. A model without languages rejects all. No rows: no rows.
    """
    spark = docs.sparkSession
    short_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    run = _predictor(spark.sparkContext.broadcast(model)) if model.languages else _nothing
    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean")


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, whose own text is not rejected."""
    run = _predictor(docs.sparkSession.sparkContext.broadcast(model)) if model.languages else _nothing
    return passing(docs, run, lambda told: pc.invert(told["rejected"]))


def op1_language_id(spark, sf_dir):
    """The language of every document; rows with crc32(doc_id) mod 4 = 2 are held out."""
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    held_out = F.pmod(crc_of_id(), F.lit(4)) == 2
    model = train(docs.where(~held_out))
    return identify(docs.select("doc_id", "text"), model).withColumn("held_out", F.pmod(crc_of_id(), F.lit(4)) == 2)
