"""Stable hashes and splits: the same on every engine and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ColumnLike, column, safe_name


def hash_number(key: ColumnLike, seed: int | None = None) -> Column:
    """The first 32 bits of sha1 of ``seed:key`` (or of the key alone), as a number."""
    text = column(key).cast("string")
    text = text if seed is None else F.concat(F.lit(f"{seed}:"), text)
    return F.conv(F.substring(F.sha1(text.cast("binary")), 1, 8), 16, 10).cast("long")


def split_label(key: ColumnLike, dev: int, test: int, seed: int | None = None, dev_name: str = "dev") -> Column:
    """test, dev or train by percentages of the key's hash; keys never straddle splits."""
    place = hash_number(key, seed) % 100
    return F.when(place < test, "test").when(place < test + dev, dev_name).otherwise("train")


def group_split(key: ColumnLike, ratio: float, seed: int) -> Column:
    """val or train at a resolution of 1/10000, by the hash of a group's key."""
    return F.when(hash_number(key, seed) % 10_000 < round(ratio * 10_000), "val").otherwise("train")


def fixed_or_split(given: ColumnLike, names: list[str], fallback: Column) -> Column:
    """An explicit split where it is one of ``names``, whatever its case; else the fallback."""
    low = F.lower(F.trim(column(given)))
    return F.when(low.isin(names), low).otherwise(fallback)


def row_id(source: ColumnLike, text: ColumnLike, size: int = 20) -> Column:
    return F.substring(F.sha1(F.concat_ws(":", column(source), column(text)).cast("binary")), 1, size)


def key_with_digest(key: ColumnLike, size: int = 12) -> Column:
    """A file name from a key: sanitised key, then digits of its digest."""
    return F.concat_ws("_", safe_name(key), F.substring(F.sha1(column(key).cast("binary")), 1, size))


def content_digest(content: ColumnLike) -> Column:
    return F.sha2(column(content), 256)


def uniform(seed: int, *keys: ColumnLike) -> Column:
    """A portable number in [0, 1) from keys: 32 bits of sha1."""
    return hash_number(F.concat_ws(":", *[column(k).cast("string") for k in keys]), seed) / float(1 << 32)
