"""Tar shards of (key.npy, key.json) pairs: writer, reader, addresses."""

from __future__ import annotations

import ast
import io
import json
import re
import tarfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import numbered

SCHEME = "wds://"
#: A number in the head of a portable picture; comments before it are passed over.
PNM_NUMBER = re.compile(rb"(?:\s|#[^\n]*\n)+(\d+)")


def shard_numbers(rows: DataFrame, per_shard: int, key: str = "key") -> DataFrame:
    """Adds shard: at most ``per_shard`` rows each, in the order of the key; numbers come from ranges of keys."""
    return numbered(rows, "__at", key).withColumn("shard", F.floor(F.col("__at") / per_shard).cast("long")).drop("__at")


def pack(rows: DataFrame) -> DataFrame:
    """(shard, content): one tar of each shard's rows (shard, key, array as npy bytes, meta as JSON)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as tar:
            for r in frame.sort_values("key").itertuples():
                for name, data in ((f"{r.key}.npy", r.array), (f"{r.key}.json", r.meta.encode())):
                    entry = tarfile.TarInfo(name)
                    entry.size = len(data)
                    tar.addfile(entry, io.BytesIO(data))
        return pd.DataFrame({"shard": [frame["shard"].iloc[0]], "content": [out.getvalue()]})

    return rows.select("shard", "key", "array", "meta").groupBy("shard").applyInPandas(run, "shard long, content binary")


def unpack(shards: DataFrame) -> DataFrame:
    """(key, array, meta) of tars (content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: dict[str, dict] = {}
            for content in frame["content"]:
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for entry in tar:
                        key, _, kind = entry.name.rpartition(".")
                        rows.setdefault(key, {})[kind] = tar.extractfile(entry).read()
            yield pd.DataFrame([(k, v.get("npy"), (v.get("json") or b"{}").decode()) for k, v in rows.items()], columns=["key", "array", "meta"])

    return shards.select("content").mapInPandas(run, "key string, array binary, meta string")


def write(rows: DataFrame, path: str) -> None:
    """Shards as a table of (shard, content): Spark's commit makes them appear whole or not at all."""
    pack(rows).write.mode("errorifexists").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return unpack(spark.read.parquet(path))


def address(shard: str, key: str) -> str:
    return f"{SCHEME}{shard}::{key}.npy"


def parse_address(uri: str) -> tuple[str, str]:
    if not uri.startswith(SCHEME) or "::" not in uri:
        raise ValueError(f"no shard address: {uri}")
    shard, _, name = uri.removeprefix(SCHEME).partition("::")
    return shard, name.removesuffix(".npy")


def array_bytes(values: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, values)
    return out.getvalue()


def load_array(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)


def gray(values: np.ndarray) -> np.ndarray:
    """(T, H, W) from (T, H, W[, C]) by the mean of the channels."""
    return values if values.ndim == 3 else values.mean(axis=3).astype(values.dtype)


def clips(media: DataFrame) -> DataFrame:
    """(path, frames, height, width, pixels) of .npy files (path, content), gray; pixels are bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                clip = gray(load_array(content))
                rows.append((path, *clip.shape, clip.tobytes()))
            yield pd.DataFrame(rows, columns=["path", "frames", "height", "width", "pixels"])

    return media.select("path", "content").mapInPandas(run, "path string, frames int, height int, width int, pixels binary")


def picture(data: bytes) -> np.ndarray:
    """(height, width[, 3]) of a binary portable graymap or pixmap (P5, P6), or of a .npy picture."""
    if data[:2] not in (b"P5", b"P6"):
        return load_array(data)
    head, at = [], 2
    while len(head) < 3:
        found = PNM_NUMBER.match(data, at)
        if not found:
            raise ValueError("no picture")
        head.append(int(found[1]))
        at = found.end()
    width, height, _ = head
    depth = 3 if data[:2] == b"P6" else 1
    values = np.frombuffer(data, np.uint8, width * height * depth, at + 1)
    return values.reshape(height, width, 3) if depth == 3 else values.reshape(height, width)


def frame_folders(media: DataFrame) -> DataFrame:
    """As clips(), from pictures (path, content): a folder is a clip, its files in order are the frames.

    Pictures that Python can read without a codec: P5, P6 and .npy. A clip is one value.
    """
    placed = media.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), "path", "content")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("path")
        frames = [picture(c) for c in part["content"]]
        clip = np.stack([f if f.ndim == 2 else f.mean(axis=2).astype(f.dtype) for f in frames])
        return pd.DataFrame([(part["folder"].iloc[0], *clip.shape, clip.tobytes())], columns=["path", "frames", "height", "width", "pixels"])

    return placed.groupBy("folder").applyInPandas(run, "path string, frames int, height int, width int, pixels binary")


def load_any(clips_: DataFrame, shards_: DataFrame, addresses: DataFrame) -> DataFrame:
    """(uri, frames, height, width, pixels) of addresses (uri): a shard's member where the uri names
    one, else the clip of that path. ``shards_`` is (shard, key, array), ``clips_`` as clips() gives."""
    named = F.col("uri").startswith(SCHEME)
    shard = F.regexp_extract("uri", f"^{SCHEME}(.*)::", 1)
    key = F.regexp_extract("uri", r"::(.*?)(?:\.npy)?$", 1)
    inside = addresses.where(named).select("uri", shard.alias("shard"), key.alias("key")).join(shards_.select("shard", "key", "array"), ["shard", "key"])
    read_ = clips(inside.select(F.col("uri").alias("path"), F.col("array").alias("content"))).withColumnRenamed("path", "uri")
    return read_.unionByName(addresses.where(~named).join(clips_.withColumnRenamed("path", "uri"), "uri"))


# -- track caches --------------------------------------------------------------------------------
def track_bytes(frames: np.ndarray, points: np.ndarray, fps: float, width: int, height: int, meta: dict, indices: np.ndarray | None = None) -> bytes:
    """A compressed cache of landmark tracks, with meta as JSON; points as half precision."""
    out = io.BytesIO()
    kept = np.asarray([] if indices is None else indices, np.int16)
    np.savez_compressed(out, frames=frames, landmarks=points.astype(np.float16), fps=fps, width=width, height=height, meta=np.array([describe_meta(meta)]), point_indices=kept)
    return out.getvalue()


def _meta(text: str) -> dict:
    """A cache's meta: JSON, or a literal of plain values; nothing is evaluated."""
    for read_ in (json.loads, ast.literal_eval):
        try:
            return dict(read_(text))
        except (ValueError, SyntaxError, TypeError):
            continue
    return {}


def tracks(caches: DataFrame, landmarks: int = 478) -> DataFrame:
    """(path, frame, points, fps, width, height) of track caches (path, content), a row for each frame.

    A cache of a subset of points is spread to all; points that are not there are NaN.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as d:
                    meta = _meta(str(d["meta"][0])) if "meta" in d else {}
                    values = d["landmarks"].astype(np.float32)
                    kept = d["point_indices"] if "point_indices" in d else []
                    if len(kept):
                        whole = np.full((len(values), int(meta.get("landmark_count", landmarks)), 2), np.nan, np.float32)
                        whole[:, kept] = values
                        values = whole
                    n, k, _ = values.shape
                    pairs = pa.ListArray.from_arrays(np.arange(0, 2 * n * k + 1, 2, dtype=np.int32), pa.array(values.ravel()))
                    points = pa.ListArray.from_arrays(np.arange(0, n * k + 1, max(k, 1), dtype=np.int32)[: n + 1], pairs)
                    same = {"fps": (float(d["fps"]), pa.float64()), "width": (int(d["width"]), pa.int32()), "height": (int(d["height"]), pa.int32())}
                    columns = [pa.array([path] * n), pa.array(d["frames"].astype(np.int64)), points, *(pa.array([v] * n, t) for v, t in same.values())]
                    yield pa.RecordBatch.from_arrays(columns, names=["path", "frame", "points", *same])

    return caches.select("path", "content").mapInArrow(run, "path string, frame long, points array<array<float>>, fps double, width int, height int")


def describe_meta(meta: dict) -> str:
    return json.dumps(meta, ensure_ascii=False, sort_keys=True)
