"""Landmark tracks: geometry, association over frames, scores, selection."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of the association cost and of the selection strategies.
MAX_GAP, MAX_COST, SCALE_WEIGHT, GAP_WEIGHT = 5, 2.0, 0.4, 0.03
STRATEGIES = {
    "active": {"coverage": 0.50, "motion_score": 0.35, "area_score": 0.10, "center_score": 0.05},
    "largest": {"coverage": 0.65, "area_score": 0.30, "center_score": 0.05},
}


def _coordinate(points: str, axis: int) -> Column:
    return F.filter(F.transform(F.col(points), lambda p: p[axis]), lambda v: ~F.isnan(v) & v.isNotNull())


def geometry(points: str) -> Column:
    """struct(x, y, extent, area) of an array of points; NaN points are passed over."""
    x, y = _coordinate(points, 0), _coordinate(points, 1)
    width, height = F.array_max(x) - F.array_min(x), F.array_max(y) - F.array_min(y)
    return F.struct(((F.array_max(x) + F.array_min(x)) / 2).alias("x"), ((F.array_max(y) + F.array_min(y)) / 2).alias("y"), F.greatest(width, height).alias("extent"), (width * height).alias("area"))


def distance(points: str, a: int, b: int) -> Column:
    """Distance of two points of an array, such as lip opening or lip width."""
    p, q = F.get(points, F.lit(a)), F.get(points, F.lit(b))
    return F.hypot(p[0] - q[0], p[1] - q[1])


def yaw_proxy(points: str, left: int, right: int, nose: int) -> Column:
    """How far the nose lies off the middle of two points, by half their distance."""
    l, r, n = (F.get(points, F.lit(i))[0] for i in (left, right, nose))  # noqa: E741
    return F.abs(n - (l + r) / 2) / F.greatest(F.abs(r - l) / 2, F.lit(1e-6))


def anchor_box(points: str, keep: list[int]) -> Column:
    """struct(x0, y0, x1, y1) around chosen points; missing (NaN) ones do not count."""
    chosen = F.array(*[F.get(points, F.lit(i)) for i in keep])
    axis = lambda k: F.filter(F.transform(chosen, lambda p: p[k]), lambda v: v.isNotNull() & ~F.isnan(v))
    return F.struct(F.array_min(axis(0)).alias("x0"), F.array_min(axis(1)).alias("y0"), F.array_max(axis(0)).alias("x1"), F.array_max(axis(1)).alias("y1"))


def select_points(points: str, keep: list[int]) -> Column:
    return F.transform(F.array(*map(F.lit, keep)), lambda i: F.get(points, i))


def full_cost(last: dict, new: dict, gap: int) -> float:
    """Distance by mean size, change of size, and a little for each missed frame."""
    size = max((last["extent"] + new["extent"]) / 2, 1.0)
    moved = float(np.hypot(last["x"] - new["x"], last["y"] - new["y"])) / size
    return moved + SCALE_WEIGHT * abs(float(np.log(max(new["extent"], 1.0) / max(last["extent"], 1.0)))) + GAP_WEIGHT * (gap - 1)


def center_cost(last: dict, new: dict, gap: int) -> float:
    """Distance by size alone: nearest centre."""
    return float(np.hypot(last["x"] - new["x"], last["y"] - new["y"])) / max(last["extent"], 1.0)


def associate(detections: DataFrame, video: str = "video", cost: Callable = full_cost, max_gap: int = MAX_GAP, max_cost: float = MAX_COST) -> DataFrame:
    """Adds track to detections (video, frame, face, x, y, extent).

    Frame by frame, open tracks and detections are paired from the least cost up, each at most
    once; a detection without a pair begins a track. The state of a video is its last detection of
    each track seen within ``max_gap`` frames, so a video is worked off in order by one task;
    videos are independent of each other.
    """
    schema = ", ".join(f"{c} {t}" for c, t in detections.dtypes) + ", track long"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["frame", "face"], kind="stable").reset_index(drop=True)
        track, last, count = np.zeros(len(frame), np.int64), {}, 0
        for number, group in frame.groupby("frame", sort=True):
            last = {t: r for t, r in last.items() if number - r["frame"] <= max_gap}
            rows = group.to_dict("records")
            options = [(cost(r, new, number - r["frame"]), t, i) for t, r in last.items() for i, new in enumerate(rows)]
            taken: dict[int, int] = {}
            for price, t, i in sorted(options):
                if price <= max_cost and i not in taken and t not in taken.values():
                    taken[i] = t
            for i, new in enumerate(rows):
                if i not in taken:
                    taken[i], count = count, count + 1
                last[taken[i]] = new
                track[group.index[i]] = taken[i]
        return frame.assign(track=track)

    return detections.groupBy(video).applyInPandas(run, schema)


def track_scores(tracked: DataFrame, frames: int, width: int, height: int, strategy: str = "active", video: str = "video") -> DataFrame:
    """(video, track, frames, coverage, area, motion, ..., score) of detections with track and opening.

    Medians over a track; area and motion by the greatest of the video; the mean step of the
    opening counts between frames at most two apart.
    """
    w = Window.partitionBy(video, "track").orderBy("frame")
    moved = tracked.withColumn("__move", F.when(F.col("frame") - F.lag("frame").over(w) <= 2, F.abs(F.col("opening") - F.lag("opening").over(w))))
    diagonal = max(float(np.hypot(width, height)), 1.0)
    off = F.hypot(F.median("x") - width / 2, F.median("y") - height / 2) / diagonal
    raw = moved.groupBy(video, "track").agg(
        F.count("*").alias("frames"),
        (F.count("*") / max(frames, 1)).alias("coverage"),
        F.median("area").alias("area"),
        F.coalesce(F.median("__move"), F.lit(0.0)).alias("motion"),
        F.greatest(F.lit(0.0), 1 - 2 * off).alias("center_score"),
    )
    most = Window.partitionBy(video)
    scored = raw.withColumn("area_score", F.col("area") / F.greatest(F.max("area").over(most), F.lit(1.0)))
    scored = scored.withColumn("motion_score", F.when(F.max("motion").over(most) > 1e-7, F.col("motion") / F.max("motion").over(most)).otherwise(0.0))
    if strategy == "first":
        return scored.withColumn("score", F.when(F.col("track") == 0, 1.0).otherwise(0.0))
    total = sum((F.col(name) * weight for name, weight in STRATEGIES[strategy].items()), F.lit(0.0))
    return scored.withColumn("score", total)


def selected(scores: DataFrame, video: str = "video", least_margin: float = 0.0) -> DataFrame:
    """The best track of each video, its margin, and a reason where the margin is too small."""
    from .signals import winner_margin

    best = winner_margin(scores, [video], "score", "track")
    return best.withColumn("reject_reason", F.when(F.col("margin") < least_margin, "ambiguous_face"))


def track_report(tracked: DataFrame, frames: int, video: str = "video") -> DataFrame:
    """(video, track, coverage, jitter, yaw): mean step of the centre, mean absolute yaw and its deviation."""
    w = Window.partitionBy(video, "track").orderBy("frame")
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    return tracked.withColumn("__step", step).groupBy(video, "track").agg((F.count("*") / frames).alias("coverage"), F.avg("__step").alias("jitter"), F.avg(F.abs("yaw")).alias("yaw_mean"), F.stddev_pop("yaw").alias("yaw_std"))
