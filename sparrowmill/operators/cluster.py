"""Clusters of sources: descriptors, similarity links, components, names, k-means."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components


def descriptors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """The element-wise mean vector of each key, scaled to unit length."""
    cells = rows.select(key, F.posexplode(vector).alias("pos", "x")).groupBy(key, "pos").agg(F.avg("x").alias("x"))
    vectors = cells.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v"))
    mean = F.transform("v", lambda p: p["x"])
    norm = F.sqrt(F.aggregate(mean, F.lit(0.0), lambda s, x: s + x * x))
    return vectors.select(key, F.transform(mean, lambda x: x / F.greatest(norm, F.lit(1e-12))).alias("descriptor"))


#: Rows of a block of vectors: a cell is a matrix of so many squared products at most, about.
BLOCK_ROWS = 2048


def similar_pairs(rows: DataFrame, key: str, vector: str, threshold: float, blocks: int | None = None, explicit: str | None = None) -> DataFrame:
    """(a, b, similarity) of rows with a dot product of at least ``threshold``; a < b.

    Exact, for tables of sources: rows are hashed into blocks of about BLOCK_ROWS, and each pair of
    blocks is one cell whose products are one matrix of that size, whatever the number of rows. Each
    pair of rows meets in one cell. The work is quadratic in the number of sources, as the question
    is; it is no operator for rows. With ``explicit`` (a name, or null), two named
    rows are linked where the names are equal, whatever the vectors. Keys are numbers or texts;
    rows without key or vector are left out.
    """
    if blocks is None:
        blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    kind = dict(rows.dtypes)[key]
    name = F.col(explicit).cast("string") if explicit else F.lit(None).cast("string")
    own = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"), name.alias("name"), F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.least("block", o) * blocks + F.greatest("block", o))
    spread = own.withColumn("cell", F.explode(cells))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        low, high = divmod(int(frame["cell"].iloc[0]), blocks)
        left, right = (frame[frame["block"] == b].reset_index(drop=True) for b in (low, high))
        if not len(left) or not len(right):
            return pd.DataFrame({"a": left["k"][:0], "b": left["k"][:0], "similarity": pd.Series([], dtype="float64")})
        products = np.stack(left["v"].to_numpy()) @ np.stack(right["v"].to_numpy()).T
        close = products >= threshold
        if explicit:
            x, y = left["name"].to_numpy(object)[:, None], right["name"].to_numpy(object)[None, :]
            close = np.where(pd.notna(x) & pd.notna(y), x == y, close)
        if low == high:
            close = np.triu(close, 1)
        i, j = np.nonzero(close)
        a, b = left["k"].to_numpy()[i], right["k"].to_numpy()[j]
        swap = a > b
        return pd.DataFrame({"a": np.where(swap, b, a), "b": np.where(swap, a, b), "similarity": products[i, j]})

    return spread.groupBy("cell").applyInPandas(run, f"a {kind}, b {kind}, similarity double")


def with_component(rows: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """``rows`` with component: the least key reachable over pairs (a, b); alone, its own."""
    found = components(pairs.select("a", "b"))
    return rows.join(found.withColumnRenamed("node", key), key, "left").withColumn("component", F.coalesce("component", F.col(key)))


def component_names(rows: DataFrame, order: str, explicit: str, prefix: str = "spk_", prefer_explicit: bool = False) -> DataFrame:
    """(component, name): the last row's explicit name, or a number from its root where it has none.

    With ``prefer_explicit``, the last explicit name of the component, if any.
    """
    fallback = F.format_string(f"{prefix}%05d", F.col("component").cast("long"))
    last = F.max(F.struct(F.col(order), F.col(explicit)))
    named = F.max(F.when(F.col(explicit).isNotNull(), F.struct(F.col(order), F.col(explicit))))
    out = rows.groupBy("component").agg((named if prefer_explicit else last).alias("l"))
    return out.select("component", F.coalesce(f"l.{explicit}", fallback).alias("name"))


def median_bits(vector: str) -> Column:
    """A hash of an array: the bits that say which items are above the median, as hex digits.

    The first item is the highest bit; the digits are filled up with zero bits in front. An empty or
    null array is ``0``.
    """
    items = F.coalesce(F.col(vector).cast("array<double>"), F.array().cast("array<double>"))
    ordered = F.array_sort(items)
    n = F.size(items)
    median = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2
    digits = F.ceil(n / 4).cast("int")
    # An array of one item names a value, so that it is computed once and not for each item.
    named = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))
    bits = named(median, lambda m: F.array_join(F.transform(items, lambda x: F.when(x > m, "1").otherwise("0")), ""))
    digit = lambda p, i: F.lower(F.conv(F.substring(p, i * 4 + 1, F.lit(4)), 2, 16))
    whole = named(F.lpad(bits, digits * 4, "0"), lambda p: F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(digits, F.lit(1)) - 1), lambda i: digit(p, i)), ""))
    return F.when(n == 0, "0").otherwise(whole)


def kmeans(rows: DataFrame, vector: str, k: int, seed: int = 0, reduce_to: int | None = None) -> DataFrame:
    """``rows`` with cluster: k-means|| over vectors, after principal components if wanted."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    data, name = rows.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>"))), "__v"
    if reduce_to:
        data, name = PCA(k=reduce_to, inputCol="__v", outputCol="__p").fit(data).transform(data), "__p"
    return KMeans(k=k, seed=seed, featuresCol=name, predictionCol="cluster").fit(data).transform(data).drop("__v", "__p")


def pitch_clusters(rows: DataFrame, f0: str, k: int, seed: int = 0) -> DataFrame:
    """Clusters of voiced pitches by their logarithm, numbered from the lowest mean up; unvoiced: -1."""
    voiced = kmeans(rows.where(F.col(f0) > 0).withColumn("__x", F.array(F.ln(f0))), "__x", k, seed)
    means = voiced.groupBy("cluster").agg(F.avg(F.get("__x", F.lit(0))).alias("m"))
    order = means.agg(F.sort_array(F.collect_list(F.struct("m", "cluster"))).alias("o")).select(F.posexplode("o").alias("number", "c")).select("number", F.col("c.cluster").alias("cluster"))
    named = voiced.join(F.broadcast(order.limit(k)), "cluster").drop("cluster", "__x").withColumnRenamed("number", "cluster")
    return named.unionByName(rows.where(~F.coalesce(F.col(f0) > 0, F.lit(False))).withColumn("cluster", F.lit(-1)))


def co_occurrence(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.where((F.col(a) >= 0) & (F.col(b) >= 0)).groupBy(a, b).agg(F.count("*").alias("n"))


def best_matching(counts: list[tuple[int, int, int]], most: int = 8) -> dict[int, int]:
    """The assignment of a to b with the greatest total count; of equal ones the first in order.

    By dynamic programming over subsets; for matrices of at most ``most`` columns.
    """
    left, right = sorted({a for a, _, _ in counts}), sorted({b for _, b, _ in counts})
    if len(right) > most:
        raise ValueError(f"over {most} columns")
    weight = {(a, b): n for a, b, n in counts}
    best: dict[int, tuple[int, tuple]] = {0: (0, ())}
    for a in left:
        step: dict[int, tuple[int, tuple]] = {}
        for used, (total, chosen) in best.items():
            options = [(used, total, (*chosen, None))]
            options += [(used | 1 << i, total + weight.get((a, b), 0), (*chosen, b)) for i, b in enumerate(right) if not used >> i & 1]
            for key, value, path in options:
                if key not in step or value > step[key][0]:
                    step[key] = (value, path)
        best = step
    _, path = max(best.values(), key=lambda v: v[0])
    return {a: b for a, b in zip(left, path, strict=True) if b is not None}
