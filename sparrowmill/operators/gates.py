"""Row gates: first failing reason, all failing reasons, validation, staged funnels."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ColumnLike, blank_to_null, column, latin_tokens, spoken_sentences

Check = tuple[str, Column]


def first_failure(checks: Iterable[Check]) -> Column:
    """The reason of the first check that holds, in order; null where none does."""
    out = F.lit(None).cast("string")
    for reason, failed in reversed(list(checks)):
        out = F.when(failed, F.lit(reason)).otherwise(out)
    return out


def all_failures(checks: Iterable[Check]) -> Column:
    """The reasons of all checks that hold, in order."""
    return F.array_compact(F.array(*[F.when(failed, F.lit(reason)) for reason, failed in checks]))


def flag(rows: DataFrame, checks: Iterable[Check], name: str = "reject_reason") -> DataFrame:
    return rows.withColumn(name, first_failure(checks))


def reject_counts(flagged: DataFrame, *keys: str, name: str = "reject_reason") -> DataFrame:
    """(keys, reason, n); accepted rows count under ``accepted``."""
    return flagged.groupBy(*keys, F.coalesce(F.col(name), F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


def problem_counts(rows: DataFrame, checks: Iterable[Check], *keys: str) -> DataFrame:
    """(keys, problem, n); a row counts once for each check that holds."""
    problems = rows.select(*keys, F.explode(all_failures(checks)).alias("problem"))
    return problems.groupBy(*keys, "problem").agg(F.count("*").alias("n"))


def fatal(report: DataFrame, problems: Iterable[str]) -> DataFrame:
    """The lines of a problem report that must stop a build."""
    return report.where(F.col("problem").isin(*problems))


def stop_on(report: DataFrame, problems: Iterable[str]) -> None:
    """Raise where a report has fatal problems; at most a few lines are read."""
    if found := fatal(report, problems).limit(20).collect():
        raise ValueError("fatal problems: " + ", ".join(f"{r['problem']}={r['n']}" for r in found))


def violations(rows: DataFrame, checks: Iterable[Check]) -> DataFrame:
    """The rows that break a rule, with the first rule they break."""
    return flag(rows, checks, "violation").where("violation is not null")


def validate(rows: DataFrame, checks: Iterable[Check]) -> DataFrame:
    """``rows``, or an error that names the first broken rule; one row is looked for."""
    if broken := violations(rows, checks).limit(1).collect():
        raise ValueError(broken[0]["violation"])
    return rows


def mouth_checks(fps: float | None = None) -> list[Check]:
    """What a row of model input must fulfil."""
    checks = [
        ("requires input_type=mouth_roi", ~F.col("input_type").eqNullSafe("mouth_roi")),
        ("missing roi_spec", blank_to_null("roi_spec").isNull()),
        ("invalid roi geometry", ~F.coalesce((F.col("roi_height") > 0) & (F.col("roi_width") > 0) & F.col("roi_channels").isin(1, 3), F.lit(False))),
        ("missing fps", ~F.coalesce(F.col("fps") > 0, F.lit(False))),
    ]
    return checks + ([("unexpected fps", F.abs(F.col("fps") - fps) > 1e-3)] if fps else [])


def resolve_first(*choices: ColumnLike) -> Column:
    """The first choice that is not blank; blank where all are."""
    return F.coalesce(*[blank_to_null(c) for c in choices], F.lit(""))


def speaker(row: dict[str, ColumnLike], pattern: str | None = None, part: int | None = None) -> Column:
    """A speaker's id: global id, id, a pattern's first group (or match) in the path, a part of the path."""
    choices = [row[k] for k in ("global_speaker_id", "speaker_id") if k in row]
    if pattern:
        group = 1 if "(" in pattern else 0
        choices.append(F.regexp_extract(column(row["path"]), pattern, group))
    if part is not None:
        parts = F.split(column(row["path"]), "/")
        choices.append(F.try_element_at(parts, F.lit(part + 1 if part >= 0 else part)))
    return resolve_first(*choices)


def funnel(rows: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame], Column]], keep: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """Stages from cheap to dear: (name, enrich, reasons). A row stops at the first stage whose
    reasons are not empty, and no later stage sees it.

    ``enrich`` adds what the stage looks at; ``reasons`` is an array of failures; ``keep`` writes
    the survivors where a stage is dear (see plans.storage.materialize). Adds stage, reasons and
    passed.
    """
    out, alive = None, rows
    for name, enrich, reasons in stages:
        seen = keep(enrich(alive).withColumn("reasons", reasons))
        failed = seen.where(F.size("reasons") > 0).withColumn("stage", F.lit(name)).withColumn("passed", F.lit(False))
        out = failed if out is None else out.unionByName(failed, allowMissingColumns=True)
        alive = seen.where(F.size("reasons") == 0).drop("reasons")
    passed = alive.withColumn("reasons", F.array().cast("array<string>")).withColumn("stage", F.lit("passed")).withColumn("passed", F.lit(True))
    return passed if out is None else out.unionByName(passed, allowMissingColumns=True)


def metadata_reasons(min_seconds: float, max_seconds: float, min_height: int, min_fps: float, languages: list[str]) -> Column:
    """All reasons why a video's metadata (duration, formats, subtitles) do not do."""
    def best(name: str) -> Column:
        return F.coalesce(F.array_max(F.transform("formats", lambda f: f[name])), F.lit(0))

    return all_failures([
        ("duration_short", F.coalesce(F.col("duration"), F.lit(0)) < min_seconds),
        ("duration_long", F.col("duration") > max_seconds),
        ("height", best("height") < min_height),
        ("fps", best("fps") < min_fps),
        ("no_manual_subtitles", F.size(F.array_intersect(F.coalesce("subtitles", F.array().cast("array<string>")), F.array(*map(F.lit, languages)))) == 0),
    ])


def subtitle_reasons(least_cues: int = 50, least_in_range: float = 0.85, most_overlap: float = 0.05) -> Column:
    """All reasons why subtitles do not do, from the columns that profile.timing_profile() gives."""
    return all_failures([
        ("few_cues", F.col("n") < least_cues),
        ("rate_out_of_range", F.coalesce("in_range", F.lit(0.0)) < least_in_range),
        ("overlap", F.coalesce("overlap", F.lit(0.0)) > most_overlap),
    ])


@dataclass(frozen=True)
class TrackRules:
    """What the faces of a video must be; a track below ``stable`` coverage does not count."""

    stable: float = 0.02
    most_tracks: int = 1
    main_coverage: float = 0.90
    face_coverage: float = 0.85
    lip_width: float = 55.0
    yaw: float = 0.12
    jitter: float = 4.0


def track_reasons(tracks: DataFrame, rules: TrackRules = TrackRules(), video: str = "video") -> DataFrame:
    """(video, n_tracks, main, reasons) of tracks (video, track, coverage, lip_width, yaw_mean, jitter,
    face_coverage): the main track is the one of greatest coverage, the first of equal ones.

    face_coverage is the share of a video's frames with any face, the same in all its rows.
    """
    counts = F.col("coverage") >= rules.stable
    main = F.min(F.when(counts, F.struct((-F.col("coverage")).alias("less"), F.col("track"), F.col("lip_width"), F.col("yaw_mean"), F.col("jitter"))))
    told = tracks.groupBy(video).agg(F.count_if(counts).alias("n_tracks"), main.alias("m"), F.max("face_coverage").alias("face_coverage"))
    some = F.col("n_tracks") > 0
    reasons = all_failures([
        ("no_stable_track", ~some),
        ("tracks", F.col("n_tracks") > rules.most_tracks),
        ("main_coverage", some & (-F.col("m.less") < rules.main_coverage)),
        ("face_coverage", some & (F.col("face_coverage") < rules.face_coverage)),
        ("lip_width", some & (F.col("m.lip_width") < rules.lip_width)),
        ("yaw", some & (F.col("m.yaw_mean") > rules.yaw)),
        ("jitter", some & (F.col("m.jitter") > rules.jitter)),
    ])
    return told.select(video, "n_tracks", F.col("m.track").alias("main"), reasons.alias("reasons"))


def transcript_flags(text: ColumnLike, low: int, high: int, chars: str, rescue: bool = False) -> Column:
    """Why a transcript sentence cannot be used: latin, digit, short, long; null where it can.

    With ``rescue``, sentences with Latin words or digits are let through.
    """
    t = column(text)
    units = F.regexp_count(t, F.lit(f"[{chars}]")) + (F.size(latin_tokens(t)) if rescue else 0)
    checks = [] if rescue else [("latin", t.rlike("[A-Za-z]")), ("digit", t.rlike(r"\d"))]
    return first_failure([*checks, ("short", units < low), ("long", units > high)])


def transcript_profile(turns: DataFrame, low: int, high: int, chars: str) -> DataFrame:
    """Sentences of turns (text) with their flags counted; Latin and digit shares apart."""
    s = turns.select(F.explode(spoken_sentences("text")).alias("s"))
    flagged = s.withColumn("why", transcript_flags("s", low, high, chars))
    return flagged.agg(
        F.count("*").alias("sentences"),
        F.count_if(F.col("s").rlike("[A-Za-z]")).alias("with_latin"),
        F.count_if(F.col("s").rlike(r"\d")).alias("with_digit"),
        F.count_if(F.col("why") == "short").alias("short"),
        F.count_if(F.col("why") == "long").alias("long"),
        F.count_if(F.col("why").isNull()).alias("usable"),
    )


def clean_values(values: DataFrame, name: str = "value") -> DataFrame:
    """(value, ord): entries between commas and line feeds, trimmed, first occurrences in order."""
    entries = values.select("ord", F.posexplode(F.split(F.col(name), "[,\n]")).alias("pos", "v")).select("ord", "pos", F.trim("v").alias("value")).where("value <> ''")
    return entries.groupBy("value").agg(F.min(F.struct("ord", "pos")).alias("ord"))


def downloads(values: DataFrame, name: str = "value") -> DataFrame:
    """Download tasks for the distinct URLs; ``error`` where a value is no http(s) URL."""
    urls = clean_values(values, name)
    return urls.select(F.lit("download").alias("kind"), F.col("value").alias("url"), "ord", F.when(~F.col("value").rlike("^https?://"), "not an http(s) url").alias("error"))


def renders(videos: DataFrame, specs: DataFrame, known: list[str]) -> DataFrame:
    """Render tasks: every video with every spec that is known; specs are a handful of names."""
    wanted = clean_values(specs).where(F.col("value").isin(*known)).select(F.col("value").alias("spec"))
    return clean_values(videos).select(F.col("value").alias("video")).crossJoin(F.broadcast(wanted.limit(len(known)))).withColumn("kind", F.lit("render"))
