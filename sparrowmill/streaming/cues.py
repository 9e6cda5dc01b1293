"""Streams: frames through active cues, task states, bucket aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.joins import interval_join


def bucket_counts(events: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Tumbling counts and sums of a stream (or table); closed buckets only, by watermark."""
    stamped = events.withColumn("__t", F.col(time).cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark("__t", late)
    out = stamped.groupBy(F.window("__t", width).alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return out.select(F.col("w.start").alias("start"), *keys, "n", "value")


def closed_cues(frames: DataFrame, cues: DataFrame, key: str = "video", emit_incomplete: bool = False) -> DataFrame:
    """(key, cue, f0, f1, n, complete): cues whose last frame has been seen.

    ``frames`` is a table or a stream of (key, frame_no) in order; ``cues`` a table of (key, cue, f0,
    f1). A cue gathers the frames of [f0, f1] and closes with the first frame at or after f1; cues
    may overlap. Cues that are still open at the end are left out, or marked with
    ``emit_incomplete`` (tables only). A stream takes MOST_CUES cues at most, which go with the tasks.
    """
    if not frames.isStreaming:
        # Only frames inside a cue are met; that one comes at or after it is told by the key's last frame.
        keys = [key, "cue", "f0", "f1"]
        inside = interval_join(frames.select(key, "frame_no"), cues.select(*keys).where("f0 <= f1").distinct(), key, "frame_no", "f0", "f1", 64).groupBy(*keys).agg(F.count("*").alias("n"))
        last = frames.groupBy(key).agg(F.max("frame_no").alias("__last"))
        # A row that repeats a cue counts its frames again.
        out = cues.groupBy(*keys).agg(F.count("*").alias("__times")).join(last, key).where(F.col("__last") >= F.col("f0")).join(inside, keys, "left")
        out = out.select(*keys, (F.coalesce("n", F.lit(0)) * F.col("__times")).alias("n"), (F.col("__last") >= F.col("f1")).alias("complete"))
        return out if emit_incomplete else out.where("complete")
    few = cues.select(*[key, "cue", "f0", "f1"]).limit(MOST_CUES + 1).toPandas()
    if len(few) > MOST_CUES:
        raise ValueError(f"over {MOST_CUES} cues; give a stream the cues of its own videos")
    return _streamed(frames, few, key, cues)


#: Cues that go with the tasks of a stream, at most.
MOST_CUES = 1_000_000


def _streamed(frames: DataFrame, few: pd.DataFrame, key: str, cues: DataFrame) -> DataFrame:
    """Frames are grouped by key; the state of a key is the last frame seen and the counts of its open
    cues, so it grows with the cues that are open and not with the frames or with what is closed."""
    schema = T.StructType([frames.schema[key], *[cues.schema[c] for c in ("cue", "f0", "f1")], T.StructField("n", T.LongType()), T.StructField("complete", T.BooleanType())])
    tables = {name: part.sort_values(["f0", "f1", "cue"], kind="stable").reset_index(drop=True) for name, part in few.groupby(key)}
    shared = frames.sparkSession.sparkContext.broadcast(tables)

    def run(names: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, places, counts = state.get if state.exists else (None, [], [])
        arrived = np.sort(np.concatenate([p["frame_no"].to_numpy(np.int64) for p in parts]))
        own = shared.value.get(names[0])
        if own is None or not len(arrived):
            return
        last = int(arrived[-1]) if seen is None else max(seen, int(arrived[-1]))
        f0, f1 = own["f0"].to_numpy(np.int64), own["f1"].to_numpy(np.int64)
        held = dict(zip(places, counts, strict=True))
        # Cues that began with the frames of this batch join those that are open.
        started = range(int(np.searchsorted(f0, last, "right")))
        closed_before = (lambda at: seen is not None and max(f0[at], f1[at]) <= seen)
        out, still = [], {}
        for at in [*held, *(i for i in started if i not in held and not closed_before(i))]:
            n = held.get(at, 0) + int(np.searchsorted(arrived, f1[at], "right") - np.searchsorted(arrived, f0[at], "left"))
            if max(f0[at], f1[at]) <= last:
                out.append((names[0], *own.loc[at, ["cue", "f0", "f1"]], n, True))
            else:
                still[at] = n
        state.update((last, list(still), list(still.values())))
        yield pd.DataFrame(out, columns=schema.names)

    return frames.groupBy(key).applyInPandasWithState(run, schema, "seen long, places array<int>, counts array<long>", "append", GroupStateTimeout.NoTimeout)


def task_states(events: DataFrame) -> DataFrame:
    """(task_id, state, attempts) after each batch of a stream of (task_id, seq, verb, max_attempts).

    Verbs that do not apply to a state are passed over; a failure requeues while attempts are left.
    """
    from ..operators.tasks import TRANSITIONS

    def run(names: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, attempts, most = state.get if state.exists else ("new", 0, 1)
        for event in pd.concat(list(parts)).sort_values("seq").itertuples():
            before, after = TRANSITIONS.get(event.verb, ((), ""))
            if event.verb == "submit":
                now, most = "queued", int(event.max_attempts)
            elif event.verb == "fail" and now == "running":
                now = "queued" if attempts < most else "failed"
            elif now in before:
                attempts = attempts + 1 if event.verb == "claim" else 0 if event.verb == "retry" else attempts
                now = after
        if now == "succeeded":
            # Nothing applies to it any more, so nothing of it is kept.
            state.remove()
        else:
            state.update((now, attempts, most))
        yield pd.DataFrame([(*names, now, attempts)], columns=["task_id", "state", "attempts"])

    kind = dict(events.dtypes)["task_id"]
    return events.groupBy("task_id").applyInPandasWithState(run, f"task_id {kind}, state string, attempts int", "state string, attempts int, most int", "update", GroupStateTimeout.NoTimeout)


def last_write(stream: DataFrame, path: str, keys: list[str], order: str, checkpoint: str):
    """A sink that keeps the last row of each key: every micro-batch is merged into a new version.

    Versions are folders ``path/v=<batch>``; a batch that is run again writes the same folder.
    """
    from ..operators.tasks import latest

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if number:
            rows = spark.read.schema(batch.schema).parquet(f"{path}/v={number - 1}").unionByName(batch)
        latest(rows, keys, order).write.mode("overwrite").parquet(f"{path}/v={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
