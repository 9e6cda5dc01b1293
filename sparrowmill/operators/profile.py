"""Profiles and metrics: counters, exact percentiles, error rates, timing, vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.edits import char_error_rate
from ..functions.text import ColumnLike, column
from ..plans.storage import numbered

PERCENTILES = {"p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99}


def counters(rows: DataFrame, *groups: tuple[str, ...]) -> DataFrame:
    """(counter, key, n) of several groupings in one pass: grouping sets over one expansion."""
    names = list(dict.fromkeys(c for g in groups for c in g))
    sets = ", ".join("(" + ", ".join(f"`{c}`" for c in g) + ")" for g in groups)
    rows.createOrReplaceTempView("__counted")
    ids = ", ".join(f"grouping(`{c}`) AS `__g_{c}`" for c in names)
    columns = ", ".join(f"`{c}`" for c in names)
    out = rows.sparkSession.sql(f"SELECT {columns}, {ids}, count(*) AS n FROM __counted GROUP BY GROUPING SETS ({sets})")
    used = lambda c: F.col(f"__g_{c}") == 0
    counter = F.concat_ws(":", *[F.when(used(c), F.lit(c)) for c in names])
    key = F.concat_ws(":", *[F.when(used(c), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in names])
    return out.select(counter.alias("counter"), key.alias("key"), "n")


def percentiles(rows: DataFrame, value: str, *keys: str, shares: dict[str, float] = PERCENTILES, digits: int = 6) -> DataFrame:
    """Exact, linearly interpolated percentiles and the maximum, for each value of ``keys``."""
    cells = [F.round(F.percentile(F.col(value), F.lit(p)), digits).alias(name) for name, p in shares.items()]
    return rows.groupBy(*keys).agg(*cells, F.max(value).alias("max"), F.count(value).alias("n"))


def moments(rows: DataFrame, value: str, *keys: str, digits: int = 6) -> DataFrame:
    """Mean and population deviation, from mergeable sums."""
    return rows.groupBy(*keys).agg(F.round(F.avg(value), digits).alias("mean"), F.round(F.stddev_pop(value), digits).alias("std"), F.count(value).alias("n"))


def timing_profile(cues: DataFrame, *keys: str) -> DataFrame:
    """Speech rate and gaps of cues (start, end, units; keys): counts, percentiles and shares.

    Rates are of cues longer than 0.2 s with units; a gap under -10 ms is an overlap. Without keys,
    cues are numbered by ranges and each meets the next number, so no window is over all.
    """
    if keys:
        seen = cues.withColumn("gap", F.lead("start").over(Window.partitionBy(*keys).orderBy("start", "end")) - F.col("end"))
    else:
        placed = numbered(cues, "__at", "start", "end")
        after = placed.select((F.col("__at") - 1).alias("__at"), F.col("start").alias("__next"))
        seen = placed.join(after, "__at", "left").withColumn("gap", F.col("__next") - F.col("end"))
    length = F.col("end") - F.col("start")
    seen = seen.withColumn("rate", F.when((length > 0.2) & (F.col("units") > 0), F.col("units") / length))
    return seen.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.round(F.percentile("rate", F.lit(0.5)), 6).alias("rate_p50"),
        F.round(F.percentile("rate", F.lit(0.1)), 6).alias("rate_p10"),
        F.round(F.percentile("rate", F.lit(0.9)), 6).alias("rate_p90"),
        F.round(F.avg(F.col("rate").between(3, 7).cast("double")), 6).alias("in_range"),
        F.round(F.percentile("gap", F.lit(0.5)) * 1000, 3).alias("gap_ms_p50"),
        F.round(F.avg((F.col("gap") < -0.01).cast("double")), 6).alias("overlap"),
    )


def micro_rate(rows: DataFrame, edits: ColumnLike, length: ColumnLike, *keys: str) -> DataFrame:
    """Sum of edits by sum of lengths; not the mean of rates."""
    return rows.groupBy(*keys).agg(F.sum(column(edits)).alias("edits"), F.sum(column(length)).alias("length"), F.round(F.sum(column(edits)) / F.greatest(F.sum(column(length)), F.lit(1)), 6).alias("rate"))


def oracle_candidate(ref: ColumnLike, candidates: ColumnLike) -> Column:
    """struct(rate, rank, text) of the candidate closest to the reference; the first of equal ones."""
    scored = F.transform(column(candidates), lambda c, i: F.struct(char_error_rate(ref, c).alias("rate"), i.alias("rank"), c.alias("text")))
    return F.array_min(scored)


def outcome(ref: ColumnLike, before: ColumnLike, after: ColumnLike) -> Column:
    """fixed, broken, same or neutral: what a correction did to a text."""
    r, b, a = column(ref), column(before), column(after)
    return F.when(a == b, "same").when((b != r) & (a == r), "fixed").when((b == r) & (a != r), "broken").otherwise("neutral")


def best_epoch(log: DataFrame, run: str, metric: str, order: str) -> DataFrame:
    """The least metric of each run and where it was first reached; nulls are passed over."""
    seen = log.where(F.col(metric).isNotNull())
    return seen.groupBy(run).agg(F.min(F.struct(F.col(metric), F.col(order))).alias("b")).select(run, f"b.{metric}", f"b.{order}")


def vocabulary(tokens: DataFrame, token: str = "token", first_id: int = 3) -> DataFrame:
    """(unit, id): distinct tokens in order, numbered from ``first_id``; null and blank are no units.

    Numbers come from sizes of ranges of units, not from one window over all.
    """
    units = tokens.select(F.col(token).alias("unit")).where("unit is not null and unit <> ''").distinct()
    return numbered(units, "id", "unit").select("unit", (F.col("id") + first_id).cast("long").alias("id"))


def encoded(rows: DataFrame, tokens: str, vocab: DataFrame, *keys: str, unknown: int = 2) -> DataFrame:
    """(keys, ids): arrays of tokens as ids of a vocabulary (unit, id) of any size, by an equi-join."""
    each = rows.select(*keys, F.posexplode(tokens).alias("__pos", "__unit"))
    met = each.join(vocab.select(F.col("unit").alias("__unit"), F.col("id").alias("__id")), "__unit", "left").withColumn("__id", F.coalesce("__id", F.lit(unknown).cast("long")))
    return met.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("__pos", "__id"))), lambda x: x["__id"]).alias("ids"))


def decoded(rows: DataFrame, ids: str, vocab: DataFrame, *keys: str) -> DataFrame:
    """(keys, units): arrays of ids as units; ids that the vocabulary lacks, the special ones too, are dropped."""
    each = rows.select(*keys, F.posexplode(ids).alias("__pos", "__id"))
    met = each.join(vocab.select(F.col("id").alias("__id"), F.col("unit").alias("__unit")), "__id")
    return met.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("__pos", "__unit"))), lambda x: x["__unit"]).alias("units"))


def oov_rate(tokens: DataFrame, vocab: DataFrame, *keys: str, token: str = "token", unit: str = "unit") -> DataFrame:
    """Share of tokens that a vocabulary lacks; counts are joined, not tokens."""
    counts = tokens.groupBy(*keys, token).agg(F.count("*").alias("n"))
    known = vocab.select(F.col(unit).alias(token), F.lit(True).alias("__known")).distinct()
    seen = counts.join(known, token, "left")
    missing = F.sum(F.when(F.col("__known").isNull(), F.col("n")).otherwise(0))
    return seen.groupBy(*keys).agg(missing.alias("missing"), F.sum("n").alias("tokens"), F.round(missing / F.sum("n"), 6).alias("rate"))


def corpus_syllables(rows: DataFrame, syllables: str, unknown: str) -> DataFrame:
    """Sorted distinct syllables, without the unknown mark."""
    return rows.select(F.explode(syllables).alias("syllable")).distinct().where(F.col("syllable") != unknown).orderBy("syllable")


def side_by_side(*metrics: tuple[str, DataFrame], key: str = "source") -> DataFrame:
    """Metrics of sources that any of them has: full outer joins."""
    out = None
    for name, frame in metrics:
        part = frame.select(key, F.col("value").alias(name))
        out = part if out is None else out.join(part, key, "full")
    return out


def yield_report(rows: DataFrame, seconds: str, reason: str = "reject_reason") -> DataFrame:
    """Rows kept, ratio, seconds kept, and a map of reasons to counts."""
    counts = rows.groupBy(reason).agg(F.count("*").alias("n"), F.sum(seconds).alias("s"))
    kept = F.sum(F.when(F.col(reason).isNull(), F.col("n")).otherwise(0))
    dropped = F.filter(F.collect_list(F.struct(F.col(reason).alias("k"), F.col("n").alias("v"))), lambda x: x["k"].isNotNull())
    return counts.agg(kept.alias("kept"), F.round(kept / F.sum("n"), 6).alias("yield"), F.round(F.coalesce(F.sum(F.when(F.col(reason).isNull(), F.col("s"))), F.lit(0.0)), 3).alias("seconds"), F.map_from_entries(F.sort_array(dropped)).alias("dropped"))
