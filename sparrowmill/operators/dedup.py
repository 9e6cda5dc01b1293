"""Deduplication: first wins, best of, stable distinct, and two keys at once."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import materialize


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, by ``order``: an aggregate with partial results, not a window,
    so a key that a third of the rows have is no task of its own."""
    whole = F.struct(*[F.col(c) for c in order], F.struct(*[F.col(c) for c in rows.columns]).alias("__row"))
    return rows.groupBy(*keys).agg(F.min(whole).alias("__first")).select("__first.__row.*")


def with_copies(rows: DataFrame, keys: list[str], order: list[str], name: str = "copy") -> DataFrame:
    """``rows`` numbered within their key by ``order``; 1 is the row that stays."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def best_of(rows: DataFrame, keys: list[str], score: str, order: list[str]) -> DataFrame:
    """The row of each key with the greatest score; the first by ``order`` of equal ones.

    Null scores come last.
    """
    whole = F.struct(F.col(score).isNull().alias("__none"), (-F.col(score)).alias("__score"), *[F.col(c) for c in order], F.struct(*[F.col(c) for c in rows.columns]).alias("__row"))
    return rows.groupBy(*keys).agg(F.min(whole).alias("__best")).select("__best.__row.*")


def stable_distinct(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, first position) of distinct values."""
    return rows.groupBy(key).agg(F.min(order).alias(order))


#: Undecided rows that one task reads in order.
FINISH = 20_000


def _in_order(rows: pd.DataFrame) -> pd.DataFrame:
    """The rows (o, a, b) that stay, read in order."""
    seen_a, seen_b, stays = set(), set(), []
    for at, (a, b) in enumerate(rows.sort_values("o")[["a", "b"]].itertuples(index=False)):
        if a not in seen_a and b not in seen_b:
            seen_a.add(a)
            seen_b.add(b)
            stays.append(at)
    return rows.sort_values("o").iloc[stays]


def greedy_two_keys(rows: DataFrame, order: str, first: str, second: str) -> DataFrame:
    """Adds reject_reason: null where the row stays, else ``duplicate_<key>``.

    In order, a row stays unless an earlier row that stays has its first or its second key; the
    first key is asked first. Rounds: undecided rows that are the least in both their groups stay;
    undecided rows that share a key with one that stays go. A round is two aggregates and joins and
    ends in a written table. Each round decides a good part of the rows; when FINISH or fewer are
    left, one task reads them in order, so a long alternating chain of keys costs no round for each
    of its last links. Order must be unique.
    """
    # A null key is a value like others.
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    open_rows = materialize(rows.select(F.col(order).alias("o"), key(first).alias("a"), key(second).alias("b")))
    kept, left = None, open_rows.count()
    while left:
        if left <= FINISH:
            stays = materialize(open_rows.groupBy().applyInPandas(_in_order, open_rows.schema))
            kept = stays if kept is None else kept.unionAll(stays)
            break
        least_a = open_rows.groupBy("a").agg(F.min("o").alias("la"))
        least_b = open_rows.groupBy("b").agg(F.min("o").alias("lb"))
        stays = materialize(open_rows.join(least_a, "a").join(least_b, "b").where("o = la and o = lb").select("o", "a", "b"))
        kept = stays if kept is None else kept.unionAll(stays)
        rest = open_rows.join(stays.select("o"), "o", "left_anti")
        rest = rest.join(stays.select("a", F.col("o").alias("by_a")), "a", "left").join(stays.select("b", F.col("o").alias("by_b")), "b", "left")
        # A row may be hit by a later row through one key only; it goes if an earlier one stays.
        open_rows = materialize(rest.where("not (coalesce(by_a < o, false) or coalesce(by_b < o, false))").select("o", "a", "b"))
        left = open_rows.count()
    if kept is None:
        return rows.withColumn("reject_reason", F.lit(None).cast("string"))
    # Of a first key at most one row stays. The reason is told at the end, as a row may go by its second key
    # before the one that has its first key is known to stay.
    by_first = kept.select(F.col("a").alias("__key"), F.col("o").alias("__by"))
    met = rows.withColumn("__key", key(first)).join(by_first, "__key", "left").join(kept.select(F.col("o").alias(order), F.lit(True).alias("__stays")), order, "left")
    reason = F.when(F.col("__stays"), F.lit(None)).when(F.col("__by") < F.col(order), f"duplicate_{first}").otherwise(f"duplicate_{second}")
    return met.withColumn("reject_reason", reason).select(*rows.columns, "reject_reason")
