"""Clips, signals and model outputs: specifications, hashes, descriptors, pitch, beams, seams."""

from __future__ import annotations

import subprocess
import traceback
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ColumnLike, column


# -- specifications ------------------------------------------------------------------------------
@dataclass(frozen=True)
class RegionSpec:
    """What a model wants to see: side, colour, anchor, alignment, crop side by extent, shift."""

    name: str
    size: int = 96
    color: str = "gray"
    anchor: str = "lips"
    align: str = "crop"
    scale: float = 1.6
    y_shift: float = 0.0
    fps: int | None = None
    normalize: tuple[float, float] | None = None


# The models' specifications.
SPECS = {
    s.name: s
    for s in (
        RegionSpec("mouth", fps=25),
        RegionSpec("syncnet", size=224, color="bgr", anchor="face", scale=1.4, y_shift=0.4, fps=25),
        RegionSpec("avhubert", align="similarity", normalize=(0.421, 0.165)),
        RegionSpec("auto_avsr", align="similarity", normalize=(0.421, 0.165)),
        RegionSpec("cnvsrc_baseline", scale=1.5, fps=25),
    )
}
#: Five points of the mean face by the output's side: eyes, nose tip, mouth corners. Fixed values.
MEAN_FACE = ((0.073, -0.417), (0.927, -0.417), (0.500, 0.188), (0.167, 0.604), (0.833, 0.604))
#: Points that are averaged to the five, by the number of landmarks. Fixed values.
FIVE_POINTS = {98: (tuple(range(60, 68)), tuple(range(68, 76)), (54,), (76,), (82,)), 478: ((33, 133), (362, 263), (1,), (61,), (291,))}


def spec(name: str, **changes) -> RegionSpec:
    """A registered specification, with fields overridden."""
    if name not in SPECS:
        raise KeyError(f"unknown specification {name!r}; there are {sorted(SPECS)}")
    return replace(SPECS[name], **changes)


def spec_table(spark: SparkSession) -> DataFrame:
    rows = [asdict(s) | {"normalize": list(s.normalize) if s.normalize else None} for s in SPECS.values()]
    return spark.createDataFrame(rows, "name string, size int, color string, anchor string, align string, scale double, y_shift double, fps int, normalize array<double>")


def mean_face(size: int) -> list[tuple[float, float]]:
    return [(x * (size - 1), y * (size - 1)) for x, y in MEAN_FACE]


def five_points(points: str, landmarks: int) -> Column:
    """The five points of an array of landmarks; null where one of their landmarks is missing (NaN)."""
    def mean(group: tuple[int, ...], axis: int) -> Column:
        values = F.array(*[F.get(points, F.lit(i))[axis] for i in group])
        total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
        return total / len(group)

    out = F.array(*[F.array(mean(g, 0), mean(g, 1)) for g in FIVE_POINTS[landmarks]])
    whole = F.forall(out, lambda p: p[0].isNotNull() & ~F.isnan(p[0]) & ~F.isnan(p[1]))
    return F.when(whole, out)


def crop_box(points: str, keep: list[int], s: RegionSpec) -> Column:
    """struct(cx, cy, side): the crop around chosen landmarks, NaN ones aside."""
    axis = lambda k: F.filter(F.array(*[F.get(points, F.lit(i))[k] for i in keep]), lambda v: v.isNotNull() & ~F.isnan(v))
    x, y = axis(0), axis(1)
    mean = lambda v: F.try_divide(F.aggregate(v, F.lit(0.0), lambda a, b: a + b), F.size(v))
    middle = lambda v: (F.array_min(v) + F.array_max(v)) / 2
    centre = mean if s.anchor == "lips" else middle
    radius = F.greatest(F.array_max(x) - F.array_min(x), F.array_max(y) - F.array_min(y)) / 2
    return F.struct(centre(x).alias("cx"), (centre(y) + s.y_shift * radius).alias("cy"), (2 * s.scale * F.greatest(radius, F.lit(4.0))).alias("side"))


def pixel_landmarks(rows: DataFrame, normalized: bool = True) -> DataFrame:
    """Tracks of 98 landmarks (frame, points, width, height, fps, n_total) in pixels, with reject_reason."""
    from .gates import flag

    points = F.flatten("points")
    bad = F.exists(points, lambda v: v.isNull() | F.isnan(v))
    checks = [
        ("landmark_shape", (F.size("points") != 98) | F.exists("points", lambda p: F.size(p) != 2)),
        ("landmark_not_finite", bad),
        ("video_metadata", ~F.coalesce((F.col("width") > 0) & (F.col("height") > 0) & (F.col("fps") > 0), F.lit(False))),
    ]
    if normalized:
        checks.append(("not_normalized", F.array_max(F.transform(points, lambda v: F.abs(v))) > 4.0))
    scaled = F.transform("points", lambda p: F.array(p[0] * F.col("width"), p[1] * F.col("height"))) if normalized else F.col("points")
    flagged = flag(rows, checks)
    return flagged.withColumn("points", F.when(F.col("reject_reason").isNull(), scaled))


def frame_mismatch(rows: DataFrame, video: str = "video") -> DataFrame:
    """Videos whose number of landmark rows is not that of their frames."""
    return rows.groupBy(video).agg(F.count("*").alias("landmarks"), F.max("n_total").alias("frames")).where("frames > 0 and landmarks <> frames")


# -- pictures ------------------------------------------------------------------------------------
def grid_hash(picture: np.ndarray, cells: int = 8) -> str:
    """Which cells of a grid are brighter than their median, as hex digits, first cell lowest."""
    rows = np.linspace(0, picture.shape[0], cells + 1, dtype=int)
    cols = np.linspace(0, picture.shape[1], cells + 1, dtype=int)
    sums = np.add.reduceat(np.add.reduceat(picture.astype(np.float64), rows[:-1], axis=0), cols[:-1], axis=1)
    means = (sums / np.outer(np.diff(rows), np.diff(cols))).ravel()
    bits = means > np.median(means)
    return f"{sum(1 << i for i in np.flatnonzero(bits)):0{cells * cells // 4}x}"


def clip_hash(clips: DataFrame) -> DataFrame:
    """(path, hash) of clips (path, frames, height, width, pixels): first, middle and last frame."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in frames:
            out = []
            for r in part.itertuples():
                clip = np.frombuffer(r.pixels, np.uint8).reshape(r.frames, r.height, r.width)
                out.append("empty" if not len(clip) else grid_hash(np.median(clip[[0, len(clip) // 2, -1]], axis=0)))
            yield pd.DataFrame({"path": part["path"], "hash": out})

    return clips.select("path", "frames", "height", "width", "pixels").mapInPandas(run, "path string, hash string")


def spectral_descriptor(pictures: list[np.ndarray], side: int = 8) -> np.ndarray:
    """Low frequencies of the median picture, log-scaled, of unit length; zeros without pictures."""
    if not pictures:
        return np.zeros(side * side, np.float32)
    p = np.median(pictures, axis=0)
    spectrum = np.abs(np.fft.rfft2((p - p.mean()) / (p.std() + 1e-6)))[:side, :side]
    out = np.log1p(spectrum).ravel()
    return (out / (np.linalg.norm(out) + 1e-8)).astype(np.float32)


def source_spectra(clips: DataFrame, key: str, most: int = 12) -> DataFrame:
    """(key, descriptor) of each source from at most ``most`` of its clips, the first by path."""
    from pyspark.sql import Window

    few = clips.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("path"))).where(F.col("__n") <= most)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("path")
        shots = []
        for r in part.itertuples():
            clip = np.frombuffer(r.pixels, np.uint8).reshape(r.frames, r.height, r.width)
            if len(clip):
                shots.append(np.median(clip[:: max(1, len(clip) // 8)], axis=0))
        return pd.DataFrame({key: [part[key].iloc[0]], "descriptor": [spectral_descriptor(shots).tolist()]})

    kind = dict(clips.dtypes)[key]
    return few.select(key, "path", "frames", "height", "width", "pixels").groupBy(key).applyInPandas(run, f"{key} {kind}, descriptor array<float>")


def crop_place(size: int, height: ColumnLike, width: ColumnLike, train: bool = False, seed: int = 0, *keys: ColumnLike) -> Column:
    """struct(top, left, flip): the middle of a picture, or in training a place and a flip drawn by keys."""
    h, w = F.greatest(column(height) - size, F.lit(0)), F.greatest(column(width) - size, F.lit(0))
    if not train:
        return F.struct(F.floor(h / 2).cast("int").alias("top"), F.floor(w / 2).cast("int").alias("left"), F.lit(False).alias("flip"))
    draw = lambda n: F.pmod(F.xxhash64(F.lit(seed), F.lit(n), *[column(k) for k in keys]), F.lit(1 << 30)) / float(1 << 30)
    return F.struct(F.floor(draw(1) * (h + 1)).cast("int").alias("top"), F.floor(draw(2) * (w + 1)).cast("int").alias("left"), (draw(3) < 0.5).alias("flip"))


def cropped(pixels: ColumnLike, width: ColumnLike, place: Column, size: int) -> Column:
    """The pixels (row by row) of a square of ``size`` at a crop_place(), mirrored where it says so."""
    p, w = column(pixels), column(width)
    column_of = lambda i: F.when(place["flip"], size - 1 - i % size).otherwise(i % size)
    return F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda i: F.get(p, ((place["top"] + F.floor(i / size)) * w + place["left"] + column_of(i)).cast("int")))


def normalised(pixels: ColumnLike, mean: float = 0.421, std: float = 0.165) -> Column:
    """Pixel values of 0 to 255 as standardised numbers."""
    return F.transform(column(pixels), lambda x: (x / 255.0 - mean) / std)


def time_masked(clip: ColumnLike, most: int, seed: int, *keys: ColumnLike) -> Column:
    """An array of frames with up to ``most`` in a row zeroed, drawn by keys; clips of 2 * most frames
    or fewer stay."""
    c = column(clip)
    draw = lambda n: F.pmod(F.xxhash64(F.lit(seed), F.lit(n), *[column(k) for k in keys]), F.lit(1 << 30)) / float(1 << 30)
    n = F.when(F.size(c) > 2 * most, F.floor(draw(1) * (most + 1))).otherwise(0)
    first = F.floor(draw(2) * (F.size(c) - n + 1))
    return F.transform(c, lambda f, i: F.when((i >= first) & (i < first + n), F.transform(f, lambda x: x * 0)).otherwise(f))


# -- rendering -----------------------------------------------------------------------------------
#: What lies outside a frame: the models' grey. Fixed value.
OUTSIDE = 110


def resample(picture: np.ndarray, x: np.ndarray, y: np.ndarray, outside: float | None = OUTSIDE) -> np.ndarray:
    """Bilinear samples of (height, width[, 3]) at x, y; what lies outside is ``outside``, or with None
    the nearest pixel."""
    h, w = picture.shape[:2]
    values = picture.astype(np.float64)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)

    def at(yy, xx):
        got = values[np.clip(yy, 0, h - 1), np.clip(xx, 0, w - 1)]
        if outside is not None:
            off = (yy < 0) | (yy >= h) | (xx < 0) | (xx >= w)
            got = np.where(off[..., None] if got.ndim == 3 else off, outside, got)
        return got

    fx, fy = (x - x0), (y - y0)
    if values.ndim == 3:
        fx, fy = fx[..., None], fy[..., None]
    return (at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy


def window(picture: np.ndarray, cx: float, cy: float, side: float, size: int, outside: float | None = OUTSIDE) -> np.ndarray:
    """The square of ``side`` around a point, as ``size`` x ``size`` pixels."""
    half = max(int(side / 2), 4)
    at = (np.arange(size) + 0.5) * 2 * half / size - 0.5 - half
    x, y = np.meshgrid(int(cx) + at, int(cy) + at)
    return np.clip(np.rint(resample(picture, x, y, outside)), 0, 255).astype(np.uint8)


def similarity(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """(2, 3): the rotation, scale and shift that bring points closest to others, by least squares."""
    s, t = source - source.mean(axis=0), target - target.mean(axis=0)
    norm = (s**2).sum()
    if not np.isfinite(norm) or norm < 1e-9:
        raise ValueError("no similarity of such points")
    a, b = (s * t).sum() / norm, (s[:, 0] * t[:, 1] - s[:, 1] * t[:, 0]).sum() / norm
    turn = np.array([[a, -b], [b, a]])
    return np.column_stack([turn, target.mean(axis=0) - turn @ source.mean(axis=0)])


def aligned(picture: np.ndarray, five: np.ndarray, size: int) -> np.ndarray:
    """A picture turned so that its five points lie on those of the mean face."""
    matrix = similarity(five, np.array(mean_face(size)))
    back = np.linalg.inv(np.vstack([matrix, [0, 0, 1]]))
    x, y = np.meshgrid(np.arange(size), np.arange(size))
    return np.clip(np.rint(resample(picture, back[0, 0] * x + back[0, 1] * y + back[0, 2], back[1, 0] * x + back[1, 1] * y + back[1, 2])), 0, 255).astype(np.uint8)


def in_color(picture: np.ndarray, color: str) -> np.ndarray:
    """A blue-green-red picture as gray, rgb or as it is."""
    if picture.ndim == 2 or color == "bgr":
        return picture
    if color == "rgb":
        return picture[..., ::-1]
    return np.rint(picture @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def rendered(frames: DataFrame, s: RegionSpec, keep: list[int], landmarks: int) -> DataFrame:
    """(video, frame, size, pixels, error) of frames (video, frame, height, width, channels, pixels,
    points): the region that a specification wants, a row for each frame; an error stays with its row."""
    five = five_points("points", landmarks) if s.align == "similarity" else F.lit(None).cast("array<array<double>>")
    box = crop_box("points", keep, s) if s.align != "similarity" else F.lit(None).cast("struct<cx: double, cy: double, side: double>")
    placed_ = frames.select("video", "frame", "height", "width", "channels", "pixels", five.alias("five"), box.alias("box"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.itertuples():
                picture = np.frombuffer(r.pixels, np.uint8).reshape((r.height, r.width) if r.channels == 1 else (r.height, r.width, r.channels))
                try:
                    if s.align == "similarity":
                        if r.five is None:
                            raise ValueError("missing alignment points")
                        done = aligned(picture, np.array([list(p) for p in r.five]), s.size)
                    elif r.box is None or r.box["cx"] is None:
                        raise ValueError("missing landmarks")
                    else:
                        done = window(picture, r.box["cx"], r.box["cy"], r.box["side"], s.size)
                    out.append((r.video, r.frame, s.size, in_color(done, s.color).tobytes(), None))
                except ValueError as e:
                    out.append((r.video, r.frame, s.size, None, str(e)))
            yield pd.DataFrame(out, columns=["video", "frame", "size", "pixels", "error"])

    kinds = dict(frames.dtypes)
    return placed_.mapInPandas(run, f"video {kinds['video']}, frame {kinds['frame']}, size int, pixels binary, error string")


def probe_crop(picture: np.ndarray, points: np.ndarray, size: int, scale: float = 1.6) -> np.ndarray:
    """A quick look at the mouth: the square around the points' mean, with the border's pixels beyond it."""
    cx, cy = points.mean(axis=0)
    side = 2 * max(int((points.max(axis=0) - points.min(axis=0)).max() * scale / 2), 8)
    return window(picture, cx, cy, side, size, None)


# -- signals -------------------------------------------------------------------------------------
def band(values: np.ndarray, low: float, high: float, rate: float) -> np.ndarray:
    """Only the frequencies between ``low`` and ``high``; the mean goes."""
    spectrum, at = np.fft.rfft(values - values.mean()), np.fft.rfftfreq(len(values), 1 / rate)
    return np.fft.irfft(np.where((at >= low) & (at <= high), spectrum, 0), n=len(values))


def band_pass(values: ColumnLike, low: float, high: float, rate: float) -> Column:
    def run(part: pd.Series) -> pd.Series:
        return part.map(lambda v: band(np.asarray(v, np.float64), low, high, rate).tolist() if v is not None and len(v) else [])

    return F.pandas_udf(run, "array<double>")(column(values))


def pitches(wave: np.ndarray, rate: int, window: float = 0.04, hop: float = 0.02, low: float = 70, high: float = 320, quiet: float = 0.01, sure: float = 0.3) -> np.ndarray:
    """Fundamental frequencies of windows by autocorrelation; 0 where quiet or without a clear period.

    All windows at once: the autocorrelation is the inverse transform of the power spectrum.
    """
    size, step = int(window * rate), int(hop * rate)
    if len(wave) <= size:
        return np.zeros(0)
    frames = np.lib.stride_tricks.sliding_window_view(wave, size)[: len(wave) - size : step].astype(np.float64)
    frames = frames - frames.mean(axis=1, keepdims=True)
    spectrum = np.fft.rfft(frames, 2 * size, axis=1)
    auto = np.fft.irfft(np.abs(spectrum) ** 2, axis=1)[:, :size]
    auto = auto / (auto[:, :1] + 1e-9)
    first = int(rate / high)
    lag = auto[:, first : int(rate / low)].argmax(axis=1) + first
    loud = np.sqrt((frames**2).mean(axis=1)) >= quiet
    clear = auto[np.arange(len(auto)), lag] > sure
    return np.where(loud & clear, rate / lag, 0.0)


def pitch_track(wave: ColumnLike, rate: int, **options) -> Column:
    def run(part: pd.Series) -> pd.Series:
        return part.map(lambda v: pitches(np.asarray(v, np.float64), rate, **options).tolist() if v is not None else [])

    return F.pandas_udf(run, "array<double>")(column(wave))


# -- model outputs -------------------------------------------------------------------------------
def log_sum(values: ColumnLike) -> Column:
    """log of the sum of exponentials of an array, without overflow."""
    a = column(values)
    top = F.array_max(a)
    return top + F.ln(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def beams(logp: np.ndarray, width: int = 10, most: int = 5, tokens: int = 32, length_power: float = 0.0) -> list[tuple[list[int], float]]:
    """The best label sequences of (frames, labels) log probabilities with blank 0, by prefix search.

    A prefix carries two scores, ending in a blank or not. In a frame all prefixes meet the
    frame's best labels in one matrix; an extension that is a prefix already joins it.
    """
    prefixes: list[tuple[int, ...]] = [()]
    blank, label = np.array([0.0]), np.array([-np.inf])
    for frame in logp:
        keep = min(len(frame), max(tokens, 2 * width))
        best = np.argsort(-frame, kind="stable")[:keep]
        best = best[best != 0]
        whole = np.logaddexp(blank, label)
        last = np.array([p[-1] if p else -1 for p in prefixes])
        repeated = np.where(last >= 0, label + frame[np.maximum(last, 0)], -np.inf)
        # Only labels that the frame keeps may repeat.
        repeated = np.where(np.isin(last, best), repeated, -np.inf)
        grown = np.where(best[None, :] == last[:, None], blank[:, None], whole[:, None]) + frame[best][None, :]
        place = {p: i for i, p in enumerate(prefixes)}
        stay_blank, stay_label = whole + frame[0], repeated
        fresh: list[tuple[int, ...]] = []
        scores: list[float] = []
        for i, p in enumerate(prefixes):
            for k, token in enumerate(best):
                longer = (*p, int(token))
                if longer in place:
                    at = place[longer]
                    stay_label[at] = np.logaddexp(stay_label[at], grown[i, k])
                else:
                    fresh.append(longer)
                    scores.append(grown[i, k])
        prefixes = prefixes + fresh
        blank = np.concatenate([stay_blank, np.full(len(fresh), -np.inf)])
        label = np.concatenate([stay_label, scores])
        order = np.argsort(-np.logaddexp(blank, label), kind="stable")[:width]
        prefixes, blank, label = [prefixes[i] for i in order], blank[order], label[order]
    found = [(list(p), float(s / len(p) ** length_power)) for p, s in zip(prefixes, np.logaddexp(blank, label), strict=True) if p]
    return sorted(found, key=lambda x: -x[1])[:most]


def beam_search(logits: ColumnLike, **options) -> Column:
    """array<struct<ids, score>> of arrays of frames of logits."""

    def run(part: pd.Series) -> pd.Series:
        out = []
        for rows in part:
            x = np.array([list(r) for r in rows], np.float64) if rows is not None and len(rows) else np.zeros((0, 1))
            x = x - np.logaddexp.reduce(x, axis=1, keepdims=True) if len(x) else x
            out.append([{"ids": ids, "score": s} for ids, s in beams(x, **options)])
        return pd.Series(out)

    return F.pandas_udf(run, "array<struct<ids: array<int>, score: double>>")(column(logits))


def with_model(rows: DataFrame, load: Callable[[], Callable[[list], list]], source: str, name: str, kind: str = "string", batch: int = 32) -> DataFrame:
    """``rows`` with a model's output for ``source``: the seam for generators and encoders.

    ``load`` is called once for each Python worker; the model gets lists of at most ``batch`` values.
    """

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            values = part.tolist()
            yield pd.Series([y for i in range(0, len(values), batch) for y in model(values[i : i + batch])], dtype=object)

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return rows.withColumn(name, F.pandas_udf(run, kind)(F.col(source)))


def attempted(rows: DataFrame, work: Callable[[dict], dict], schema: str, key: str) -> DataFrame:
    """(key, schema, error): ``work`` on every row; an error becomes a text and the row stays."""
    names = [c.split()[0] for c in schema.split(", ")]
    kind = dict(rows.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                try:
                    done = work(row)
                    out.append((row[key], *[done.get(n) for n in names], None))
                except Exception as e:
                    out.append((row[key], *[None] * len(names), traceback.format_exception_only(e)[-1].strip()))
            yield pd.DataFrame(out, columns=[key, *names, "error"])

    return rows.mapInPandas(run, f"{key} {kind}, {schema}, error string")


def commanded(rows: DataFrame, key: str, argv: ColumnLike, seconds: float = 600.0) -> DataFrame:
    """(key, status, out, error): a program run for every row, by an array of its name and arguments.

    The seam for probes, decoders, downloads and recognisers that are programs. No shell is involved;
    a program that is not there, fails or takes too long is an error of its row.
    """
    kind = dict(rows.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for name, args in zip(frame[key], frame["__argv"], strict=True):
                try:
                    done = subprocess.run(list(args), capture_output=True, timeout=seconds, check=False)
                    out.append((name, done.returncode, done.stdout, done.stderr.decode("utf-8", "replace") if done.returncode else None))
                except (OSError, subprocess.TimeoutExpired, TypeError) as e:
                    out.append((name, None, None, str(e)))
            yield pd.DataFrame(out, columns=[key, "status", "out", "error"]).astype({"status": "Int32"})

    return rows.select(key, column(argv).alias("__argv")).mapInPandas(run, f"{key} {kind}, status int, out binary, error string")


def samples(pcm: ColumnLike) -> Column:
    """Signed 16-bit little-endian samples as numbers of -1 to 1."""

    def run(part: pd.Series) -> pd.Series:
        return part.map(lambda b: (np.frombuffer(b[: len(b) // 2 * 2], "<i2") / 32768.0).tolist() if b is not None else [])

    return F.pandas_udf(run, "array<double>")(column(pcm))


# -- schedules -----------------------------------------------------------------------------------
def inverse_root_rate(step: ColumnLike, rate: float, warmup: int) -> Column:
    """Linear warm-up, then falling with the root of the step."""
    s = F.greatest(column(step), F.lit(1))
    return F.when(s < warmup, rate * s / max(warmup, 1)).otherwise(rate * F.sqrt(F.lit(float(max(warmup, 1))) / s))


def cosine_factor(step: ColumnLike, total: int, warmup_share: float) -> Column:
    """Linear warm-up, then half a cosine to 0."""
    warmup = max(round(total * warmup_share), 1)
    done = F.least((column(step) - warmup) / max(total - warmup, 1), F.lit(1.0))
    return F.when(column(step) < warmup, F.greatest(column(step), F.lit(1)) / warmup).otherwise(0.5 * (1 + F.cos(F.pi() * done)))


def head_weights(alpha: float = 0.5, text: float | None = None, syllables: float | None = None) -> tuple[float, float]:
    """Normalised weights of two heads, from both or from one share."""
    if (text is None) != (syllables is None):
        raise ValueError("both weights or none")
    if text is None:
        if not 0 <= alpha <= 1:
            raise ValueError("alpha must be in [0, 1]")
        text, syllables = alpha, 1 - alpha
    if min(text, syllables) < 0 or text + syllables <= 0:
        raise ValueError("weights must not be negative and have a positive sum")
    return text / (text + syllables), syllables / (text + syllables)


def use_head(wanted: str, trained: bool, name: str) -> bool:
    """auto: if trained; on: if trained, else an error; off: no."""
    if wanted == "on" and not trained:
        raise ValueError(f"the {name} head was not trained")
    return trained and wanted != "off"
