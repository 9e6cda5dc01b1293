"""Cutting lineage through files in the shared folder; dealing out small tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.

    Where that is unset, a session on one machine (master ``local``) gets a folder of its own; on a
    cluster it is an error, as executors would write where nobody else reads.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/sparrowmill-checkpoints"


def materialize(frame: DataFrame) -> DataFrame:
    """Write frame once to the shared folder and read it back: lineage ends in shared files.

    The files are removed when the application ends, by the file system that they lie in.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/sparrowmill-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(frame.schema).parquet(path)


def spread(frame: DataFrame) -> DataFrame:
    """``frame``, dealt out anew where it has fewer splits than the cluster has cores.

    A small table in one file would keep one core busy; a large one has more splits than cores and
    is left as it is, without a shuffle.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """``rows`` numbered from 0 in ``order``, which should be unique, without one window over all.

    Rows are dealt out by ranges and sorted; a row's place in its range and the sizes of the ranges
    before, of which there are as many as partitions, make its number.
    """
    ranged = rows.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    ranged = materialize(ranged.withColumn("__range", F.shiftright(place, 33)).withColumn("__place", place.bitwiseAND((1 << 33) - 1)))
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return ranged.join(F.broadcast(starts), "__range").withColumn(name, F.col("__start") + F.col("__place")).drop("__range", "__place", "__start")


#: Groups that are met by a broadcast, at most; a size bound, whatever the input.
HOT_GROUPS = 10_000
LEAST_HOT = 200


def by_size(groups: DataFrame, size: str, total: int) -> tuple[DataFrame, DataFrame]:
    """(large groups, the others) of ``groups`` with sizes counted in ``total`` rows.

    A large group has ``total`` / HOT_GROUPS rows and more, so there are HOT_GROUPS of them at most:
    few enough to broadcast. The others are too small to load one task.
    """
    limit = max(LEAST_HOT, total // HOT_GROUPS)
    return groups.where(F.col(size) >= limit), groups.where(F.col(size) < limit)


def with_group(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, *spread_by: str) -> DataFrame:
    """``rows`` left-joined with ``groups`` (key, size, ...), which has one row for each key.

    Large groups (see by_size) are met by a broadcast, others by an equi-join. Rows of large groups
    are dealt out by a hash of ``spread_by`` there, so no key is a task of its own; what they meet is
    passed over. Null keys meet nothing. Keys are long integers or texts.
    """
    rest = [c for c in groups.columns if c != key]
    hot, cold = by_size(groups, size, total)
    hot = hot.select(key, F.lit(True).alias("__hot"), *[F.col(c).alias(f"__hot_{c}") for c in rest])
    cold = cold.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__cold_{c}") for c in rest])
    apart = F.col("__hot") | F.col(key).isNull()
    dealt = F.xxhash64(*spread_by, F.lit(1)).cast(groups.schema[key].dataType)
    met = rows.join(F.broadcast(hot), key, "left").withColumn("__key", F.when(apart, dealt).otherwise(F.col(key))).join(cold, "__key", "left")
    value = lambda c: F.when(apart, F.col(f"__hot_{c}")).otherwise(F.col(f"__cold_{c}")).alias(c)
    return met.select(*rows.columns, *[value(c) for c in rest])


#: Words of 64 bits of the bitmap of keys: a size bound of what is broadcast.
BITMAP_WORDS = 1 << 20


def maybe_among(rows: DataFrame, keys: DataFrame, *columns: str, name: str = "__hit") -> DataFrame:
    """``rows`` with a flag: false where the values of ``columns`` are surely none of those in ``keys``.

    A bitmap of 64 * BITMAP_WORDS slots, at most BITMAP_WORDS rows of two numbers, is broadcast
    whatever the number of keys. Two values may share a slot: more rows are flagged then, none fewer.
    """
    slot = F.pmod(F.xxhash64(*columns), F.lit(64 * BITMAP_WORDS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))
    words = keys.select(F.shiftright(slot, 6).alias("__word"), bit.alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    met = rows.withColumn("__word", F.shiftright(slot, 6)).join(F.broadcast(words), "__word", "left")
    flag = F.coalesce(F.getbit("__bits", slot.bitwiseAND(63).cast("int")) == 1, F.lit(False))
    return met.withColumn(name, flag).drop("__word", "__bits")
