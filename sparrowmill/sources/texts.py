"""Text corpora, subtitles, transcripts, diarisation, manifests, listings and configurations."""

from __future__ import annotations

import dataclasses
import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_mark
from ..plans.storage import numbered
from .annotations import files, line_numbers, placed

# Patterns of the formats.
SRT_TIMES = r"(\d+):(\d+):(\d+)[,.](\d+)\s*-->\s*(\d+):(\d+):(\d+)[,.](\d+)"
TURN = r"^([^：:]{2,10})[：:](.+)$"
EDITORIAL = r"^\s*([（(\[【]|片头|片尾|字幕|编者)"
CHECKPOINT = r"^ckpt_ep(\d+)\.pt$"


def corpus(spark: SparkSession, kind: str, path: str, text: str | int = "text", document: str | int | None = None, separator: str = "\t") -> DataFrame:
    """(document_id, text, ord); kinds: text (a document a line), jsonl, delimited."""
    if kind == "text":
        return line_numbers(spark.read.text(path)).select(F.col("line").cast("string").alias("document_id"), F.col("value").alias("text"), F.format_string("%015d", "line").alias("ord"))
    if kind == "jsonl":
        names = [str(text), *([str(document)] if document else [])]
        rows = placed(spark.read.schema(", ".join(f"`{n}` string" for n in names)).json(path))
        return rows.select((F.col(str(document)) if document else F.col("ord")).alias("document_id"), F.col(str(text)).alias("text"), "ord")
    if kind == "delimited":
        rows = placed(spark.read.text(path)).withColumn("cells", F.split(strip_mark("value"), re.escape(separator)))
        cell = lambda i: F.get("cells", F.lit(i))
        return rows.select((cell(document) if document is not None else F.col("ord")).alias("document_id"), cell(text).alias("text"), "ord").where("text is not null")
    raise ValueError(f"unknown kind of corpus: {kind}")


def model_texts(spark: SparkSession, path: str) -> DataFrame:
    """(text): lines that begin with ``{`` give their field ``text``, other lines themselves."""
    line = F.trim("value")
    text = F.when(line.startswith("{"), F.get_json_object(line, "$.text")).otherwise(line)
    return spark.read.text(path).select(text.alias("text")).where("text is not null and text <> ''")


def json3_cues(spark: SparkSession, path: str) -> DataFrame:
    """(path, start, end, text) of subtitle events in milliseconds; blank texts are left out."""
    schema = "events array<struct<tStartMs: double, dDurationMs: double, segs: array<struct<utf8: string>>>>"
    events = spark.read.schema(schema).json(path, multiLine=True).select(F.col("_metadata.file_path").alias("path"), F.explode("events").alias("e"))
    text = F.trim(F.regexp_replace(F.array_join(F.transform("e.segs", lambda s: F.coalesce(s["utf8"], F.lit(""))), ""), r"\s+", " "))
    start = F.coalesce("e.tStartMs", F.lit(0.0)) / 1000
    return events.select("path", start.alias("start"), (start + F.coalesce("e.dDurationMs", F.lit(0.0)) / 1000).alias("end"), text.alias("text")).where("text <> ''")


def srt_cues(spark: SparkSession, path: str) -> DataFrame:
    """(path, start, end, text); lines of digits alone are numbers, inside a text too."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.explode(F.split(strip_mark("value"), r"\r?\n\s*\r?\n")).alias("cue"))
    part = lambda k: F.regexp_extract("cue", SRT_TIMES, k).cast("double")
    fraction = lambda k: F.concat(F.lit("0."), F.regexp_extract("cue", SRT_TIMES, k)).cast("double")
    start = part(1) * 3600 + part(2) * 60 + part(3) + fraction(4)
    end = part(5) * 3600 + part(6) * 60 + part(7) + fraction(8)
    lines = F.filter(F.split("cue", r"\r?\n"), lambda x: ~x.rlike(r"^\s*\d*\s*$") & ~x.rlike("-->"))
    text = F.trim(F.array_join(F.transform(lines, lambda x: F.trim(x)), " "))
    return whole.where(F.col("cue").rlike(SRT_TIMES)).select("path", start.alias("start"), end.alias("end"), text.alias("text")).where("text <> ''")


def recognised_chars(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, char, start, end) of recognised characters."""
    rows = placed(spark.read.schema("char string, start double, `end` double").json(path))
    return rows.select(F.col("_metadata.file_path").alias("path"), "ord", "char", "start", "end")


def turns(spark: SparkSession, path: str) -> DataFrame:
    """(speaker, text, ord) of lines ``speaker: text``; editorial lines are left out."""
    lines = placed(spark.read.text(path)).withColumn("line", F.trim("value")).where(~F.col("line").rlike(EDITORIAL) & F.col("line").rlike(TURN))
    return lines.select(F.trim(F.regexp_extract("line", TURN, 1)).alias("speaker"), F.trim(F.regexp_extract("line", TURN, 2)).alias("text"), "ord")


def rttm_frames(lines: DataFrame, hop: float) -> DataFrame:
    """(frame, label): diarisation spans as labels of frames, speakers numbered by first appearance.

    ``lines`` is (value, line). A frame that several spans cover has the label of the last span.
    """
    p = F.split(F.trim("value"), r"\s+")
    spans = lines.where(F.col("value").startswith("SPEAKER")).select("line", F.get(p, F.lit(3)).cast("double").alias("start"), F.get(p, F.lit(4)).cast("double").alias("size"), F.get(p, F.lit(7)).alias("speaker"))
    first = spans.groupBy("speaker").agg(F.min("line").alias("first"))
    number = first.agg(F.sort_array(F.collect_list(F.struct("first", "speaker"))).alias("o")).select(F.posexplode("o").alias("label", "s")).select("label", F.col("s.speaker").alias("speaker"))
    cut = lambda c: F.floor(c / hop)
    frames = spans.join(number, "speaker").where("size > 0").withColumn("frame", F.explode(F.sequence(cut(F.col("start")), F.greatest(cut(F.col("start") + F.col("size")) - 1, cut(F.col("start"))))))
    return frames.groupBy("frame").agg(F.max_by("label", "line").alias("label"))


def speaking_frames(spark: SparkSession, path: str, fps: float) -> DataFrame:
    """(frame): frames in which the wanted speaker talks, from a segments file."""
    schema = "segments array<struct<start_s: double, end_s: double, is_speaker: boolean>>"
    s = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("segments").alias("s")).where("s.is_speaker")
    return s.select(F.explode(F.sequence(F.floor(F.col("s.start_s") * fps), F.floor(F.col("s.end_s") * fps))).alias("frame")).distinct()


def transcript(spark: SparkSession, path: str) -> DataFrame:
    """(id, text): parted by a tab, else by the first blank."""
    cut = F.when(F.contains("value", F.lit("\t")), F.split("value", "\t", 2)).otherwise(F.split(F.trim("value"), r"\s+", 2))
    return spark.read.text(path).select(cut.alias("c")).where("size(c) = 2").select(F.trim(F.col("c")[0]).alias("id"), F.trim(F.col("c")[1]).alias("text"))


def listed_urls(spark: SparkSession, path: str) -> DataFrame:
    """(url, ord) of lines; comments after ``#`` at a line's begin and blank lines are left out."""
    return placed(spark.read.text(path)).select(F.trim("value").alias("url"), "ord").where(~F.col("url").startswith("#") & (F.col("url") != ""))


def manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a stated schema; blank lines are passed over."""
    return placed(spark.read.schema(schema).json(path)).where("ord is not null")


def numbered_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(value, row): lines that are not blank with their ordinal, for access by position."""
    return numbered(placed(spark.read.text(path)).where("trim(value) <> ''"), "row", "ord").select("value", "row")


def row_at(rows: DataFrame, position: int) -> DataFrame:
    """The row at a position; negative positions count from the end."""
    if position < 0:
        position += rows.count()
    return rows.where(F.col("row") == position)


def checkpoints(listing: DataFrame) -> DataFrame:
    """(path, epoch) of checkpoint files, by epoch."""
    name = F.element_at(F.split("path", "/"), -1)
    return listing.where(name.rlike(CHECKPOINT)).select("path", F.regexp_extract(name, CHECKPOINT, 1).cast("int").alias("epoch")).orderBy("epoch")


def existing_media(transcripts: DataFrame, listing: DataFrame, candidates: list[Column], least: int) -> tuple[DataFrame, DataFrame]:
    """(rows with the first candidate path that exists and texts of ``least`` characters, counts of the rest)."""
    rows = transcripts
    for n, c in enumerate(candidates):
        rows = rows.withColumn(f"__c{n}", c).join(listing.select(F.col("path").alias(f"__c{n}"), F.lit(True).alias(f"__h{n}")), f"__c{n}", "left")
    media = F.coalesce(*[F.when(F.col(f"__h{n}"), F.col(f"__c{n}")) for n in range(len(candidates))])
    rows = rows.withColumn("media", media).select(*transcripts.columns, "media")
    why = F.when(F.col("media").isNull(), "missing_media").when(F.length("text") < least, "short_text")
    flagged = rows.withColumn("reject_reason", why)
    return flagged.where("reject_reason is null").drop("reject_reason"), flagged.where("reject_reason is not null").groupBy("reject_reason").agg(F.count("*").alias("n"))


def synthetic(spark: SparkSession, sentences: list[str], speakers: int, seed: int) -> DataFrame:
    """Speakers x sentences with hash-seeded lengths: rows of a made-up manifest."""
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(sentences)], "n int, text string")
    rows = spark.range(speakers).select(F.format_string("s%02d", "id").alias("speaker_id")).crossJoin(F.broadcast(texts))
    frames = F.length("text") * 6 + F.pmod(F.xxhash64("speaker_id", "n", F.lit(seed)), F.lit(5))
    return rows.select(F.format_string("%s_%04d", "speaker_id", "n").alias("id"), "text", "speaker_id", frames.alias("n_frames"))


def vocabulary_file(spark: SparkSession, path: str) -> DataFrame:
    """(unit, id) of a JSON array of units; ids 0 to 2 are the special units."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("id", "unit")).select("unit", F.col("id").cast("long").alias("id"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files, hashed where they are read."""
    return files(spark, path, True).select("path", "length", F.sha2("content", 256).alias("sha256"))


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, fingerprint): path, size and time of change, without a look at the content."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select("path", F.concat_ws(":", "path", F.col("length").cast("string"), F.col("modificationTime").cast("double").cast("string")).alias("fingerprint"))


def stale(wanted: DataFrame, done: DataFrame, key: str = "path") -> DataFrame:
    """What has no finished result with the same fingerprint and version."""
    return wanted.join(done.select(key, "fingerprint", "version"), [key, "fingerprint", "version"], "left_anti")


def read_config(spark: SparkSession, path: str, kind: type, overrides: list[str] = ()) -> object:
    """As config(), from a YAML file wherever Spark reads it; JSON is YAML too."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    try:
        import yaml
    except ImportError:  # YAML that is JSON can be read without the package
        return config(kind, json.loads(text) if text.strip() else {}, overrides)
    return config(kind, yaml.safe_load(text) or {}, overrides)


def expanded(entries: DataFrame, listed: Callable[[str, int], list[str]], most: int = 50) -> DataFrame:
    """(url, ord) of entries (url, ord): single videos as they are, others as the URLs that ``listed``
    (an adapter: entry, most -> URLs) gives for them, http ones only, in their order."""
    single = F.contains("url", F.lit("/watch?")) | F.contains("url", F.lit("youtu.be/"))

    def run(frames):
        for frame in frames:
            rows = [(u, f"{o}:{n:06d}") for e, o in zip(frame["url"], frame["ord"], strict=True) for n, u in enumerate(listed(e, most)[:most]) if u.startswith("http")]
            yield pd.DataFrame(rows, columns=["url", "ord"])

    rest = entries.where(~single).select("url", F.col("ord").cast("string").alias("ord")).mapInPandas(run, "url string, ord string")
    return entries.where(single).select("url", F.col("ord").cast("string").alias("ord")).unionAll(rest)


def config(kind: type, values: dict, overrides: list[str] = ()) -> object:
    """A dataclass from nested values and ``a.b=c`` overrides; unknown keys are errors."""
    for item in overrides:
        name, _, raw = item.partition("=")
        *parents, last = name.split(".")
        place = values
        for p in parents:
            place = place.setdefault(p, {})
        try:
            place[last] = json.loads(raw)
        except json.JSONDecodeError:
            place[last] = raw
    known = {f.name: f for f in dataclasses.fields(kind)}
    if extra := sorted(set(values) - set(known)):
        raise KeyError(f"unknown keys for {kind.__name__}: {extra}")
    inner = {k: config(t, v) if isinstance(v, dict) and dataclasses.is_dataclass(t := _type(kind, k)) else v for k, v in values.items()}
    return kind(**inner)


def _type(kind: type, name: str) -> type:
    import typing

    return typing.get_type_hints(kind)[name]
