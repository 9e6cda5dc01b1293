"""Sampling and batching for training: caps, weights, length buckets, budgets, ranks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..plans.storage import numbered


def sample(rows: DataFrame, k: int, seed: int, *keys: str) -> DataFrame:
    """k rows drawn by a hash of their keys: a distributed top-k."""
    return rows.orderBy(uniform(seed, *keys), *keys).limit(k)


def stratified_cap(rows: DataFrame, share: str, strata: int, cap: int, seed: int, *keys: str) -> DataFrame:
    """At most ``cap`` rows of each stratum ``min(int(share * strata), strata - 1)``, drawn by hash."""
    stratum = F.least(F.floor(F.col(share) * strata), F.lit(strata - 1)).cast("long")
    drawn = rows.withColumn("stratum", stratum).withColumn("__u", uniform(seed, *keys))
    place = F.row_number().over(Window.partitionBy("stratum").orderBy("__u", *keys))
    return drawn.withColumn("__place", place).where(F.col("__place") <= cap).drop("__place", "__u")


def keep_some(condition: Column, probability: float, seed: int, *keys: str) -> Column:
    """Rows without the condition, and a share of those with it, by hash."""
    return ~condition | (uniform(seed, *keys) < probability)


def weighted_draws(rows: DataFrame, source: str, weights: dict[str, float], n: int, seed: int, *keys: str) -> DataFrame:
    """n draws with replacement: a source by weight, then a row of it alike likely; (draw, row).

    A draw is a pair of hashes of its number: one falls into the weights' cumulative ranges, one
    picks a row number within the source. Sources without rows get none; a weight for a source
    that is not there is an error. Rows are numbered by ranges of source and keys, so no source is a
    task of its own.
    """
    counts = rows.groupBy(source).agg(F.count("*").alias("__n"))
    have = {r[source]: r["__n"] for r in counts.where(F.col(source).isin(*weights)).collect()}
    if missing := sorted(set(weights) - set(have)):
        raise ValueError(f"weights for sources that are not there: {missing}")
    total, at, choice = sum(weights.values()), 0.0, F.lit(None).cast("string")
    parts = []
    for name in sorted(weights):
        parts.append((name, at / total))
        at += weights[name]
    number = F.col("draw").cast("string")
    draws = rows.sparkSession.range(n).withColumnRenamed("id", "draw").withColumn("__u", uniform(seed, number)).withColumn("__v", uniform(seed + 1, number))
    for name, low in parts:
        choice = F.when(F.col("__u") >= low, F.lit(name)).otherwise(choice)
    size = F.lit(0)
    for name in weights:
        size = F.when(F.col(source) == name, F.lit(have[name])).otherwise(size)
    draws = draws.withColumn(source, choice).withColumn("__row", F.floor(F.col("__v") * size) + 1)
    placed = numbered(rows.where(F.col(source).isin(*weights)), "__at", source, *keys)
    # One row for each weight.
    starts = placed.groupBy(source).agg(F.min("__at").alias("__start"))
    placed = placed.join(F.broadcast(starts), source).withColumn("__row", F.col("__at") - F.col("__start") + 1).drop("__at", "__start")
    return draws.drop("__u", "__v").join(placed, [source, "__row"]).drop("__row")


def shuffled(rows: DataFrame, seed: int, *keys: str, mega: int) -> DataFrame:
    """Numbers the mega-buckets of a seeded shuffle: about ``mega`` rows each, without a global sort.

    The bucket of a row is a hash range, so rows are dealt out by hash and sorted within buckets.
    """
    buckets = max(1, -(-rows.count() // mega))
    return rows.withColumn("mega", F.floor(uniform(seed, *keys) * buckets).cast("long"))


def length_batches(rows: DataFrame, length: str, batch: int, seed: int, *keys: str, mega: int = 10_000) -> DataFrame:
    """Batches of ``batch`` rows of like length: sorted by length within each mega-bucket."""
    w = Window.partitionBy("mega").orderBy(length, *keys)
    return shuffled(rows, seed, *keys, mega=mega).withColumn("batch", F.floor((F.row_number().over(w) - 1) / batch).cast("long"))


def budget_batches(rows: DataFrame, length: str, batch: int, budget: int, seed: int, *keys: str, mega: int = 10_000) -> DataFrame:
    """Batches whose longest row times rows is at most ``budget``; at most ``batch`` rows.

    Greedy in order of length within each mega-bucket, which is a bounded group; a row that is
    itself over the budget is a batch alone.
    """
    columns = [*keys, length, "mega"]
    placed = shuffled(rows, seed, *keys, mega=mega).select(*columns)
    schema = ", ".join(f"{c} {t}" for c, t in placed.dtypes) + ", batch long"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([length, *keys], kind="stable")
        numbers, number, size = [], 0, 0
        for n in frame[length]:
            # Lengths ascend, so the newest row is the longest of its batch.
            if size and (size == batch or n * (size + 1) > budget):
                number, size = number + 1, 0
            numbers.append(number)
            size += 1
        return frame.assign(batch=pd.Series(numbers, index=frame.index, dtype="int64"))

    return placed.groupBy("mega").applyInPandas(run, schema)


def for_ranks(batches: DataFrame, number: str, world: int) -> DataFrame:
    """Adds rank; the batches over a multiple of ``world`` are left out, so ranks have equal numbers."""
    total = batches.agg(F.max(number).alias("m")).first()["m"]
    usable = (0 if total is None else total + 1) // world * world
    return batches.where(F.col(number) < usable).withColumn("rank", F.pmod(F.col(number), F.lit(world)))


def evenly_spaced(n: int, k: int) -> list[int]:
    """k positions of n, evenly spaced, the last always among them."""
    if k >= n:
        return list(range(n))
    if k == 1:
        return [n - 1]
    return sorted({round(i * (n - 1) / (k - 1)) for i in range(k)})


def keep_spaced(rows: DataFrame, order: str, k: int) -> DataFrame:
    """The rows at evenly spaced ranks; for listings of a handful of rows, such as checkpoints."""
    ranked = rows.withColumn("__rank", F.row_number().over(Window.orderBy(order)) - 1)
    return ranked.where(F.col("__rank").isin(*evenly_spaced(rows.count(), k))).drop("__rank")


def padded(values: str, batch: list[str]) -> Column:
    """An array padded with zeros to the longest of its batch."""
    longest = F.max(F.size(values)).over(Window.partitionBy(*batch))
    return F.concat(F.col(values), F.array_repeat(F.lit(0), longest - F.size(values)))


def tiled(values: str, least: int) -> Column:
    """An array repeated until it has ``least`` items, then cut."""
    times = F.ceil(F.lit(least) / F.greatest(F.size(values), F.lit(1))).cast("int")
    return F.when(F.size(values) >= least, F.col(values)).otherwise(F.slice(F.flatten(F.array_repeat(values, times)), 1, least))


def chat_labels(prompt: str, answer: str, longest: int) -> tuple[Column, Column]:
    """(ids, labels) of prompt and answer token ids: prompt labelled -100, cut to ``longest``.

    A prompt that alone is too long is an error.
    """
    too_long = F.size(prompt) >= longest
    ids = F.when(too_long, F.raise_error(F.lit("the prompt alone is too long")).cast("array<int>")).otherwise(F.slice(F.concat(prompt, answer), 1, longest))
    labels = F.slice(F.concat(F.array_repeat(F.lit(-100), F.size(prompt)), F.col(answer)), 1, longest)
    return ids, labels
