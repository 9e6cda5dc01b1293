"""Joins: lookups, held-out exclusion, leakage, intervals, as-of interpolation, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(rows: DataFrame, table: DataFrame, key: str, value: str, default, name: str | None = None) -> DataFrame:
    """A left join with a default for keys that the table lacks; Spark broadcasts small tables."""
    got = table.select(F.col(key), F.col(value).alias("__value"))
    return rows.join(got, key, "left").withColumn(name or value, F.coalesce("__value", F.lit(default))).drop("__value")


def maps_by_key(base: DataFrame, key: str, **tables: DataFrame) -> DataFrame:
    """Left joins of key-value tables (key, value) on a base table, one column each."""
    for name, table in tables.items():
        base = base.join(table.select(F.col("key").alias(key), F.col("value").alias(name)), key, "left")
    return base


def excluding(rows: DataFrame, held_out: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is not held out, rows whose key is)."""
    keys = held_out.select(key).where(F.col(key).isNotNull()).distinct()
    return rows.join(keys, key, "left_anti"), rows.join(keys, key, "left_semi")


def leaks(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that occur in more than one split, with these in order."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)


def assert_no_leaks(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    if found := leaks(rows, key, split).limit(5).collect():
        raise ValueError(f"{key} in several splits: " + ", ".join(str(r[key]) for r in found))
    return rows


def interval_join(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, width: int) -> DataFrame:
    """Points within closed spans [start, end] of the same key.

    Both sides meet on (key, bucket of ``width``): a span lies in the buckets it touches, a point in
    one, so it is an equi-join with a filter, whatever the number of spans. Choose ``width`` near
    the usual length of a span.
    """
    cut = lambda c: F.floor(F.col(c) / F.lit(width))
    spread = spans.withColumn("__bucket", F.explode(F.sequence(cut(start), cut(end))))
    return points.withColumn("__bucket", cut(at)).join(spread, [key, "__bucket"]).where(F.col(at).between(F.col(start), F.col(end))).drop("__bucket")


def span_positions(spans: DataFrame, start: str, end: str, name: str) -> DataFrame:
    """One row for each position of a closed span; for short spans."""
    return spans.where(F.col(start) <= F.col(end)).withColumn(name, F.explode(F.sequence(F.col(start), F.col(end))))


def span_summary(spans: DataFrame, marks: DataFrame, key: str, at: str, width: int) -> DataFrame:
    """For each span (key, span, start, end): first and last mark inside and how many there are."""
    inside = interval_join(marks, spans, key, at, "start", "end", width)
    return inside.groupBy(key, "span").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))


def asof_interpolate(queries: DataFrame, samples: DataFrame, keys: list[str], at: str, value: str, max_gap: float) -> DataFrame:
    """``queries`` (keys, at) with ``value`` from ``samples`` (keys, at, value), and error.

    An exact hit is taken; between two samples at most ``max_gap`` + 1 apart the value is
    interpolated; before the first or after the last sample the nearest is taken within
    ``max_gap``. Else value is null and error tells why. Samples have one value for each point. One
    window over the union of both sides, sorted once for each key.
    """
    q = queries.select(*keys, F.col(at).alias("__at"), F.lit(1).alias("__query"), F.lit(None).cast("double").alias("__value"), F.lit(None).cast("double").alias("__sample"))
    s = samples.select(*keys, F.col(at).alias("__at"), F.lit(0).alias("__query"), F.col(value).cast("double").alias("__value"), F.col(at).cast("double").alias("__sample"))
    back = Window.partitionBy(*keys).orderBy("__at", "__query").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(F.col("__at").desc(), "__query").rowsBetween(Window.unboundedPreceding, 0)
    both = q.unionAll(s)
    both = both.select("*", F.last("__sample", True).over(back).alias("t0"), F.last("__value", True).over(back).alias("v0"), F.last("__sample", True).over(ahead).alias("t1"), F.last("__value", True).over(ahead).alias("v1")).where("__query = 1")
    gap, here = F.col("t1") - F.col("t0"), F.col("__at").cast("double")
    share = (here - F.col("t0")) / gap
    found = (
        F.when(F.col("t0") == here, F.col("v0"))
        .when(F.col("t0").isNotNull() & F.col("t1").isNotNull(), F.when(gap <= max_gap + 1, F.col("v0") * (1 - share) + F.col("v1") * share))
        .when(F.col("t0").isNotNull(), F.when(here - F.col("t0") <= max_gap, F.col("v0")))
        .otherwise(F.when(F.col("t1") - here <= max_gap, F.col("v1")))
    )
    error = F.when(F.col("t0").isNull() & F.col("t1").isNull(), "no samples").when(F.col("t1").isNull(), "trailing landmark gap").when(F.col("t0").isNull(), "leading landmark gap").otherwise("landmark gap")
    return both.withColumn(value, found).select(*keys, F.col("__at").alias(at), value, F.when(F.col(value).isNull(), error).alias("error"))


def at_rate(position: Column, from_step: float, to_rate: float, last: Column) -> Column:
    """The slower stream's row for a position of the faster one: floor, clamped to the last row."""
    return F.least((position * from_step * to_rate).cast("long"), last)


def rate_join(fast: DataFrame, slow: DataFrame, key: str, fast_at: str, slow_at: str, step: float, fps: float) -> DataFrame:
    """Rows of a fast stream with the slow stream's row at that time, by an equi-join."""
    last = slow.groupBy(key).agg(F.max(slow_at).alias("__last"))
    placed = fast.join(last, key).withColumn(slow_at, at_rate(F.col(fast_at), step, fps, F.col("__last"))).drop("__last")
    return placed.join(slow, [key, slow_at], "left")
