"""Windows over ordered streams: majority votes, gap filling, islands, motion, correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def majority(label: str, keys: list[str], order: str, width: int) -> Column:
    """The most frequent label of a centred window of rows; the least of equally frequent ones."""
    half = width // 2
    return F.mode(F.col(label), True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-half, half))


def voiced_majority(rows: DataFrame, label: str, keys: list[str], order: str, hop: float, seconds: float = 0.3) -> DataFrame:
    """As majority(), over voiced rows (label >= 0) only; unvoiced rows keep their label."""
    width = max(int(seconds / hop) | 1, 3)
    half = width // 2
    voted = F.mode(F.when(F.col(label) >= 0, F.col(label)), True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-half, half))
    return rows.withColumn("smoothed", F.when(F.col(label) >= 0, voted).otherwise(F.col(label)))


def runs(rows: DataFrame, label: str, keys: list[str], order: str, name: str = "run") -> DataFrame:
    """Numbers the runs of equal labels within each key."""
    w = Window.partitionBy(*keys).orderBy(order)
    change = (~F.col(label).eqNullSafe(F.lag(label).over(w))).cast("long")
    return rows.withColumn("__change", change).withColumn(name, F.sum("__change").over(w)).drop("__change")


def fill_gaps(rows: DataFrame, label: str, keys: list[str], order: str, longest: int, name: str = "filled") -> DataFrame:
    """Runs of -1 of at most ``longest`` rows take the label on both sides, where that is one and voiced.

    What comes after is the last of the opposite order, so each row is looked at once.
    """
    w, back = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys).orderBy(F.col(order).desc())
    told = F.when(F.col(label) >= 0, F.col(label))
    out = runs(rows, label, keys, order, "__run").withColumn("__size", F.count("*").over(Window.partitionBy(*keys, "__run")))
    left = F.last(told, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    right = F.last(told, True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    fits = (F.col(label) == -1) & (F.col("__size") <= longest) & (F.col("__left") == F.col("__right"))
    out = out.withColumn("__left", left).withColumn("__right", right)
    return out.withColumn(name, F.when(fits, F.col("__left")).otherwise(F.col(label))).drop("__run", "__size", "__left", "__right")


def islands(rows: DataFrame, keys: list[str], order: str, same: list[str], step: float, shortest: int = 1) -> DataFrame:
    """Stretches of rows with the same values whose order grows by at most ``step``.

    (keys, same, first, last, n); stretches of fewer than ``shortest`` rows are left out.
    """
    w = Window.partitionBy(*keys).orderBy(order, *same)
    starts = F.lag(order).over(w).isNull() | (F.col(order) - F.lag(order).over(w) > step)
    for c in same:
        starts = starts | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    numbered = rows.withColumn("__start", starts.cast("long")).withColumn("__island", F.sum("__start").over(w))
    out = numbered.groupBy(*keys, *same, "__island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))
    return out.where(F.col("n") >= shortest).drop("__island")


def motion(rows: DataFrame, value: str, keys: list[str], order: str, step: int = 2) -> DataFrame:
    """Median absolute change between rows at most ``step`` apart."""
    w = Window.partitionBy(*keys).orderBy(order)
    near = F.col(order) - F.lag(order).over(w) <= step
    moved = rows.withColumn("__move", F.when(near, F.abs(F.col(value) - F.lag(value).over(w))))
    return moved.groupBy(*keys).agg(F.round(F.coalesce(F.median("__move"), F.lit(0.0)), 6).alias("motion"))


def winner_margin(scores: DataFrame, keys: list[str], score: str, name: str) -> DataFrame:
    """The best of each key, by score, then by name, and how far ahead it is (1.0 where alone).

    Two aggregates over partial results: the two least of (-score, name) are all that is kept.
    """
    best = scores.groupBy(*keys).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(name).alias("k"))).alias("b"))
    rest = scores.join(best, keys).where(F.col(name) != F.col("b.k")).groupBy(*keys).agg(F.max(score).alias("__next"))
    out = best.join(rest, keys, "left")
    return out.select(*keys, F.col("b.k").alias(name), (-F.col("b.s")).alias(score), F.coalesce(-F.col("b.s") - F.col("__next"), F.lit(1.0)).alias("margin"))


def correlation_curve(a: DataFrame, b: DataFrame, keys: list[str], at: str, value: str, max_lag: int) -> DataFrame:
    """(keys, lag, score): mean product of standardised a(t) and b(t + lag) for each lag."""
    def standard(rows: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy(*keys)
        z = (F.col(value) - F.avg(value).over(w)) / F.greatest(F.stddev_pop(value).over(w), F.lit(1e-9))
        return rows.select(*keys, at, z.alias(name))

    lags = standard(a, "x").withColumn("lag", F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag)))).withColumn("__at", F.col(at) + F.col("lag"))
    both = lags.join(standard(b, "y").withColumnRenamed(at, "__at"), [*keys, "__at"])
    return both.groupBy(*keys, "lag").agg(F.avg(F.col("x") * F.col("y")).alias("score"))


def curve_peak(curve: DataFrame, keys: list[str]) -> DataFrame:
    """The lag with the greatest score (the nearest to zero of equal ones), and the runner-up's score."""
    return winner_margin(curve.withColumn("__k", F.struct(F.abs("lag").alias("d"), "lag")), keys, "score", "__k").select(*keys, F.col("__k.lag").alias("lag"), "score", (F.col("score") - F.col("margin")).alias("runner_up"))


def distance_minimum(curve: DataFrame, keys: list[str], shift: str, distance: str) -> DataFrame:
    """The shift of least distance, and median minus least distance as confidence."""
    return curve.groupBy(*keys).agg(F.min(F.struct(F.col(distance), F.col(shift))).alias("m"), F.median(distance).alias("__median")).select(*keys, F.col(f"m.{shift}").alias("offset"), F.col(f"m.{distance}").alias("distance"), (F.col("__median") - F.col(f"m.{distance}")).alias("confidence"))


def median_filter(value: str, keys: list[str], order: str, width: int = 13) -> Column:
    """The median of a centred window of rows; fewer at the ends. Null values do not count."""
    half = width // 2
    seen = F.array_sort(F.collect_list(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-half, half)))
    middle = lambda n: F.get(seen, F.floor(n / 2).cast("int"))
    return (middle(F.size(seen) - 1) + middle(F.size(seen))) / 2


def bucket_energy(samples: DataFrame, keys: list[str], at: str, value: str, hop: int) -> DataFrame:
    """Root mean square of samples in buckets of ``hop`` positions."""
    return samples.groupBy(*keys, F.floor(F.col(at) / hop).alias("bucket")).agg(F.round(F.sqrt(F.avg(F.col(value) * F.col(value))), 6).alias("rms"))


def fill_linear(rows: DataFrame, keys: list[str], order: str, value: str, name: str = "filled") -> DataFrame:
    """Missing values by linear interpolation; at the ends the nearest value. Each row is looked at once a way."""
    w, back = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys).orderBy(F.col(order).desc())
    told = F.struct(F.col(order).cast("double").alias("t"), F.col(value).cast("double").alias("v"))
    told = F.when(F.col(value).isNotNull(), told)
    out = rows.withColumn("__a", F.last(told, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__b", F.last(told, True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    share = (F.col(order) - F.col("__a.t")) / (F.col("__b.t") - F.col("__a.t"))
    mixed = F.when(F.col("__a.t") == F.col("__b.t"), F.col("__a.v")).otherwise(F.col("__a.v") * (1 - share) + F.col("__b.v") * share)
    return out.withColumn(name, F.coalesce(mixed, F.col("__a.v"), F.col("__b.v"))).drop("__a", "__b")


def cue_span(start: Column, end: Column, fps: float, offset: float, pad: float) -> tuple[Column, Column]:
    """First and last frame of a cue, moved by an offset and padded, halves to even."""
    return F.bround((start + offset - pad) * fps).cast("long"), F.bround((end + offset + pad) * fps).cast("long")


def cue_frames(start: Column, end: Column, fps: float, offset: float, pad: float, last: Column) -> tuple[Column, Column]:
    """The span of a cue within the video."""
    first, end = cue_span(start, end, fps, offset, pad)
    return F.greatest(first, F.lit(0).cast("long")), F.least(end, last)
