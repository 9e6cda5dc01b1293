"""Readers of annotation formats into one schema: id, text, media, speaker_id, split, confidence, path, ord.

Every reader is a function of (spark, spec); READERS maps the format's name to it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, first_line, strip_mark, without_suffix
from ..plans.storage import numbered

COLUMNS = {"id": "string", "text": "string", "media": "string", "speaker_id": "string", "split": "string", "confidence": "double", "path": "string", "ord": "string"}


@dataclass
class Source:
    """One annotated source. ``path`` is a file, folder or glob that Spark can read."""

    name: str
    format: str
    path: str
    enabled: bool = True
    pseudo: bool = False
    confidence: float = 1.0
    split: str = ""
    fields: dict[str, str] = field(default_factory=dict)
    columns: dict[str, int] = field(default_factory=dict)
    separator: str = "\t"
    header: bool = False
    prefix: str = ""
    extra: list[str] = field(default_factory=list)
    kinds: dict[str, str] = field(default_factory=dict)


def unified(rows: DataFrame, extra: list[str] | tuple = ()) -> DataFrame:
    """The schema's columns, typed, absent ones null; blank texts are null."""
    cells = [(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()]
    cells = [blank_to_null(c).alias(n) if t == "string" else c for c, (n, t) in zip(cells, COLUMNS.items(), strict=True)]
    return rows.select(*cells, *[F.col(c) for c in extra if c in rows.columns])


def placed(rows: DataFrame) -> DataFrame:
    """Adds ord, a key of a row's place: file, block, and a number that ascends within the file.

    Spark has no row order; the key restores it for first-wins rules.
    """
    where = F.format_string("%s:%015d:%015d", F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return rows.withColumn("ord", where)


def line_numbers(lines: DataFrame) -> DataFrame:
    """(value, line): numbers of lines in the order of their places, from sizes of ranges of places."""
    return numbered(placed(lines), "line", "ord").select("value", "line")


def jsonl(spark: SparkSession, s: Source) -> DataFrame:
    """JSON lines; ``fields`` maps the schema's names to the file's."""
    names = {c: s.fields.get(c, c) for c in COLUMNS if c not in ("ord", "path")}
    kinds = {n: "double" if c == "confidence" else "string" for c, n in names.items()} | {c: "string" for c in s.extra}
    rows = placed(spark.read.schema(", ".join(f"`{n}` {t}" for n, t in kinds.items())).json(s.path))
    rows = rows.select(*[F.col(f"`{n}`").alias(c) for c, n in names.items()], *[c for c in s.extra if c not in names], "ord")
    split, sure = F.coalesce(blank_to_null("split"), F.lit(s.split or None)), F.coalesce("confidence", F.lit(s.confidence))
    return unified(rows.withColumn("split", split).withColumn("confidence", sure), s.extra)


def delimited(spark: SparkSession, s: Source) -> DataFrame:
    """Delimited text; ``columns`` maps names to positions. Rows that are too short are left out."""
    lines = placed(spark.read.text(s.path))
    cells = F.split(strip_mark("value"), re.escape(s.separator))
    rows = lines.withColumn("cells", cells).where(F.size("cells") > max(s.columns.values()))
    if s.header:
        rows = rows.where(F.col("cells") != cells_of_header(lines, s.separator)) if s.columns else rows
    return unified(rows.select(*[F.get("cells", F.lit(i)).alias(c) for c, i in s.columns.items()], F.lit(s.confidence).alias("confidence"), F.lit(s.split or None).alias("split"), "ord"))


def cells_of_header(lines: DataFrame, separator: str) -> Column:
    first = lines.orderBy("ord").limit(1).collect()
    cells = re.split(re.escape(separator), first[0]["value"].lstrip("﻿")) if first else []
    return F.array(*map(F.lit, cells)) if cells else F.array().cast("array<string>")


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """(key, value, ord) of lines ``key value``; the last line of a key counts. No such file: no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], "key string, value string, ord string")
    from ..operators.tasks import latest

    rows = placed(spark.read.text(path)).select(F.regexp_extract("value", r"^(\S+)\s(.*)$", 1).alias("key"), F.trim(F.regexp_extract("value", r"^(\S+)\s(.*)$", 2)).alias("value"), "ord")
    return latest(rows.where("key <> ''"), ["key"], "ord")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, asked of the file system that Spark would read it from."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where))


def kaldi(spark: SparkSession, s: Source) -> DataFrame:
    """A folder of text, utt2spk and video.scp, joined by utterance; a value that is a command is no medium."""
    base = key_values(spark, f"{s.path}/text").select(F.col("key").alias("id"), F.col("value").alias("text"), "ord")
    speakers = key_values(spark, f"{s.path}/utt2spk").select(F.col("key").alias("id"), F.col("value").alias("speaker_id"))
    media = key_values(spark, f"{s.path}/video.scp").select(F.col("key").alias("id"), F.when(~F.col("value").endswith("|"), F.col("value")).alias("media"))
    rows = base.join(speakers, "id", "left").join(media, "id", "left")
    return unified(rows.withColumn("confidence", F.lit(s.confidence)).withColumn("split", F.lit(s.split or None)))


def files(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """(path, length[, content]) of files below a folder or glob; only wanted columns are read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    rows = reader.load(path).withColumn("path", F.regexp_replace("path", "^file:/*(?=/)", ""))
    return rows.select("path", "length", *(["content"] if content else []))


def below(path: Column, root: str) -> Column:
    """A path relative to a root."""
    return F.regexp_replace(path, "^" + re.escape(root.rstrip("/")) + "/", "")


def sidecar(spark: SparkSession, s: Source) -> DataFrame:
    """A text file for each medium: its first line that has the prefix, without it; id is the relative path."""
    texts = files(spark, f"{s.path}", True).where(F.col("path").endswith(".txt"))
    lines = F.filter(F.split(strip_mark(F.decode("content", "UTF-8")), r"\r?\n"), lambda x: x.startswith(s.prefix) & (F.trim(x) != ""))
    text = F.substring(F.get(lines, F.lit(0)), len(s.prefix) + 1, 1 << 30)
    relative = without_suffix(below(F.col("path"), s.path))
    return unified(texts.select(relative.alias("id"), text.alias("text"), without_suffix("path").alias("media"), "path", F.col("path").alias("ord"), F.lit(s.confidence).alias("confidence"), F.lit(s.split or None).alias("split")))


#: What a release's landmarks are: 98 points in the face's own frame. Fixed value.
RELEASE_LANDMARKS = "wflw98_normalized"


def array_length(content: Column) -> Column:
    """The first dimension of a .npy file, from its header; null where there is none."""
    head = F.decode(F.substring(content, 1, 512), "ISO-8859-1")
    return F.nullif(F.regexp_extract(head, r"'shape': \((\d+)", 1), F.lit("")).cast("int")


def release_tree(spark: SparkSession, s: Source) -> DataFrame:
    """.../speaker/{txt,video,landmark,roi,audio}/stem.*, at any depth: the texts with what lies beside them.

    media is always the video's place. landmark_path is ``stem_landmark.npy``, or else ``stem.npy``,
    with landmark_format and n_frames; face_box_path and audio_path are null where there is no such file.
    """
    listing = files(spark, s.path).select("path", below(F.col("path"), s.path).alias("rel"))
    at = r"^(?:(.*)/)?([^/]+)/([^/]+)$"
    parts = listing.select("path", *[F.regexp_extract("rel", at, i).alias(c) for i, c in enumerate(("root", "kind", "name"), 1)])
    named = lambda kind, end: parts.where((F.col("kind") == kind) & F.col("name").endswith(end)).select("root", F.regexp_replace("name", re.escape(end) + "$", "").alias("stem"), "path")
    texts = named("txt", ".txt")
    content = files(spark, s.path, True).where(F.col("path").endswith(".txt")).select("path", first_line(strip_mark(F.decode("content", "UTF-8"))).alias("text"))
    rows = texts.join(content, "path")
    arrays = files(spark, s.path, True).where(F.col("path").endswith(".npy")).select("path", array_length(F.col("content")).alias("n_frames"))
    points = named("landmark", ".npy").join(arrays, "path").select("root", F.col("stem").alias("__stem"), F.struct("path", "n_frames").alias("found"))
    for n, suffix in enumerate(("_landmark", "")):
        rows = rows.withColumn("__stem", F.concat("stem", F.lit(suffix))).join(points.withColumnRenamed("found", f"__l{n}"), ["root", "__stem"], "left").drop("__stem")
    rows = rows.withColumn("landmark", F.coalesce("__l0", "__l1"))
    for kind, end, name in (("roi", ".json", "face_box_path"), ("audio", ".wav", "audio_path")):
        rows = rows.join(named(kind, end).withColumnRenamed("path", name), ["root", "stem"], "left")
    speaker = F.when(F.col("root") == "", F.element_at(F.split(F.lit(s.path.rstrip("/")), "/"), -1)).otherwise(F.element_at(F.split("root", "/"), -1))
    base = F.concat(F.lit(s.path.rstrip("/") + "/"), F.when(F.col("root") == "", "").otherwise(F.concat("root", F.lit("/"))))
    rows = rows.select(
        F.concat(F.lit(s.name + ":"), F.when(F.col("root") == "", F.col("stem")).otherwise(F.concat_ws("/", "root", "stem"))).alias("id"),
        "text",
        F.concat(base, F.lit("video/"), "stem", F.lit(".mp4")).alias("media"),
        F.concat(F.lit(s.name + ":"), speaker).alias("speaker_id"),
        "path",
        F.col("path").alias("ord"),
        F.lit(s.confidence).alias("confidence"),
        F.lit(s.split or None).alias("split"),
        F.col("landmark.path").alias("landmark_path"),
        F.when(F.col("landmark").isNotNull(), RELEASE_LANDMARKS).alias("landmark_format"),
        F.col("landmark.n_frames").alias("n_frames"),
        "face_box_path",
        "audio_path",
    )
    return unified(rows, ["landmark_path", "landmark_format", "n_frames", "face_box_path", "audio_path"])


def mirrored_tree(spark: SparkSession, s: Source) -> DataFrame:
    """text/speaker/.../x.txt beside speaker/.../x.mp4; ids are whole relative paths, so equal names never meet."""
    root = s.path.rstrip("/")
    texts = files(spark, f"{root}/text", True).where(F.col("path").endswith(".txt")).withColumn("rel", below(F.col("path"), f"{root}/text"))
    texts = texts.where(F.size(F.split("rel", "/")) >= 3)
    media = files(spark, root).where(~F.col("path").endswith(".txt")).select(F.col("path").alias("media"), without_suffix(below(F.col("path"), root)).alias("key"))
    rows = texts.withColumn("key", without_suffix("rel")).join(media, "key", "left")
    return unified(rows.select(F.concat(F.lit(s.name + ":"), "key").alias("id"), first_line(strip_mark(F.decode("content", "UTF-8"))).alias("text"), "media", F.element_at(F.split("rel", "/"), 1).alias("speaker_id"), "path", F.col("path").alias("ord"), F.lit(s.confidence).alias("confidence"), F.lit(s.split or None).alias("split")))


READERS: dict[str, Callable[[SparkSession, Source], DataFrame]] = {"jsonl": jsonl, "delimited": delimited, "kaldi": kaldi, "sidecar": sidecar, "cn_cvs": release_tree, "cmlr": mirrored_tree}


def read(spark: SparkSession, source: Source) -> DataFrame:
    """The rows of one source with its name."""
    if source.format not in READERS:
        raise ValueError(f"unknown format: {source.format}")
    return READERS[source.format](spark, source).withColumn("source", F.lit(source.name))


def read_all(spark: SparkSession, sources: list[Source], with_pseudo: bool = True) -> tuple[DataFrame | None, dict[str, int]]:
    """(rows of the enabled sources, counts of ``source:reason`` of the others); these are never opened."""
    left_out, rows = {}, None
    for s in sources:
        if not s.enabled or (s.pseudo and not with_pseudo):
            left_out[f"{s.name}:{'source_disabled' if not s.enabled else 'pseudo_disabled'}"] = 1
            continue
        part = read(spark, s)
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    return rows, left_out


def media_index(listing: DataFrame, root: str) -> DataFrame:
    """(key, media): relative paths always, bare names only where they occur once and are no relative path."""
    relative = listing.select(without_suffix(below(F.col("path"), root)).alias("key"), F.col("path").alias("media"))
    bare = relative.groupBy(F.element_at(F.split("key", "/"), -1).alias("key")).agg(F.count("*").alias("n"), F.min("media").alias("media")).where("n = 1").select("key", "media")
    return relative.unionByName(bare.join(relative.select("key"), "key", "left_anti"))


def resolve_media(rows: DataFrame, listing: DataFrame, index: DataFrame, root: str, extension: str) -> DataFrame:
    """media by its first hit: as given, speaker/id.ext, id.ext, id, the index."""
    there = listing.select(below(F.col("path"), root).alias("__key"), F.col("path").alias("__hit"))
    choices = [blank_to_null("media"), F.concat_ws("/", "speaker_id", F.concat("id", F.lit(extension))), F.concat("id", F.lit(extension)), F.col("id")]
    found = []
    for n, choice in enumerate(choices):
        table = there.select(F.col("__key").alias(f"__k{n}"), F.col("__hit").alias(f"__h{n}"))
        rows = rows.withColumn(f"__k{n}", choice).join(table, f"__k{n}", "left")
        found.append(F.col(f"__h{n}"))
    rows = rows.join(index.select(F.col("key").alias("__ki"), F.col("media").alias("__hi")), F.col("id") == F.col("__ki"), "left")
    kept = [c for c in rows.columns if not c.startswith("__") and c != "media"]
    return rows.select(*kept, F.coalesce(*found, F.col("__hi")).alias("media"))
