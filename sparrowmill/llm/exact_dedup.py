"""Exact deduplication by progressive refinement, in DataFrame operations only.

Each text is read once; its length, a hash of its prefix and its full hash become a row of a table of
numbers. The steps read that table column by column: lengths that occur once drop out first, then
pairs of length and prefix hash that occur once, and full hashes are compared for what is left.
Groups are aggregated before the shuffle, so a group of any size costs one row for each task, and no
group is ever collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_size, materialize, maybe_among, with_group

#: White space that counts as one space, as a Java and RE2 pattern.
BLANKS = r"[\x20\x09-\x0D]+"
#: Code points of the text that the second step looks at.
PREFIX_CHARS = 64


def normalized(text: Column | str) -> Column:
    """Each run of blanks as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), BLANKS, " ")


def full_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the keys of the three steps: __len, __head and __full."""
    text = docs.withColumn("__text", normalized("text"))
    keys = {"__len": F.length("__text"), "__head": F.xxhash64(F.substring("__text", 1, PREFIX_CHARS)), "__full": full_hash(F.col("__text"))}
    return text.withColumns(keys).drop("__text")


def crowded(numbers: DataFrame) -> DataFrame:
    """(__len, __head) that more than one row of ``numbers`` has: what survives steps 1 and 2."""
    pairs = materialize(numbers.groupBy("__len", "__head").agg(F.count("*").alias("n")))
    lengths = pairs.groupBy("__len").agg(F.sum("n").alias("of_len")).where("of_len > 1").select("__len")
    return materialize(pairs.join(lengths, "__len", "left_semi").where("n > 1").select("__len", "__head"))


def repeated(survivors: DataFrame) -> DataFrame:
    """(__full, keep_id, group_size) of the full hashes that more than one survivor has."""
    groups = survivors.groupBy("__full").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return materialize(groups.where("group_size > 1"))


def _refined(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(numbers, pairs that survive, groups of equal texts, rows) of ``docs`` (doc_id, text)."""
    numbers = materialize(keyed(docs.select("doc_id", "text")).drop("text"))
    pairs = crowded(numbers)
    return numbers, pairs, repeated(maybe_among(numbers, pairs, "__len", "__head").where("__hit")), numbers.count()


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """(text_sha256, keep_id, group_size) of every group of two or more equal texts.

    keep_id is the least doc_id, nulls aside. Null text counts as empty. No rows: no groups. Other
    columns are ignored. No text is shuffled.
    """
    return _refined(docs)[2].withColumnRenamed("__full", "text_sha256")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the least doc_id stays (rows that repeat that doc_id stay with
    it); a row with a null doc_id stays only where its whole group has none. Null text is empty.
    No rows: no rows; other columns are ignored. Rows that do not survive the steps are alone and
    pass straight through; survivors meet their groups, the large ones by a broadcast.
    """
    numbers, pairs, groups, total = _refined(docs)
    marked = maybe_among(numbers, pairs, "__len", "__head")
    alone = marked.where("not __hit").select("doc_id", "__full", F.lit(None).cast(docs.schema["doc_id"].dataType).alias("keep_id"), F.lit(None).cast("long").alias("group_size"))
    alive = with_group(marked.where("__hit").select("doc_id", "__full"), groups, "__full", "group_size", total, "doc_id", "__full")
    met = alone.unionByName(alive)
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return met.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), F.col("__full").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text equals that of a row with a smaller doc_id.

    Columns stay as they are, whatever their names. Rows that do not survive the steps pass
    straight through a narrow scan; survivors meet their groups, the large ones by a broadcast, so
    that their copies are gone before anything is shuffled.
    """
    _, pairs, groups, total = _refined(docs)
    whole = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    marked = maybe_among(keyed(whole).drop("text"), pairs, "__len", "__head")
    alive = marked.where("__hit").select("doc_id", "__full", "__row")
    for part, met in zip(by_size(groups, "group_size", total), (F.broadcast, lambda d: d), strict=True):
        alive = alive.join(met(part.select("__full", F.col("keep_id").alias("__keep"))), "__full", "left")
        alive = alive.where("__keep is null or doc_id <=> __keep").drop("__keep")
    return marked.where("not __hit").unionByName(alive, allowMissingColumns=True).select("__row.*")
