"""Registered queries of sources and sinks: tables are written in a format to the shared folder, read
back by the source, and compared with SQL over the tables themselves."""

from __future__ import annotations

import json
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text
from .operators import gates
from .plans.storage import numbered, shared_folder
from .queries import Tables, query
from .sources import annotations, shards, sinks, texts
from .sources.annotations import Source


def _place(t: Tables) -> str:
    """A new folder beside the intermediate tables, removed when the application ends."""
    path = f"{shared_folder(t.spark)}/sparrowmill-io-{uuid.uuid4().hex}"
    where = t.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(t.spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)
    return path


def _lines(rows: DataFrame, *parts) -> DataFrame:
    return rows.select(F.concat(*parts).alias("value"))


def _nations(t: Tables) -> list:
    """The rows of the table of nations, of fixed size, for formats that are a file for each row."""
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).orderBy("n_nationkey").collect()


# -- annotations ---------------------------------------------------------------------------------
@query("SELECT doc_id::VARCHAR AS id, md5(trim(text)) AS text, source AS speaker_id, CASE WHEN doc_id % 3 = 0 THEN 'dev' ELSE 'train' END AS split, CASE WHEN doc_id % 5 = 0 THEN 0.25 ELSE 0.5 END AS confidence, lang, 'd' AS source FROM documents")
def source_jsonl(t):
    path = f"{_place(t)}/d"
    rows = t.documents.select(F.col("doc_id").alias("utt"), F.col("text").alias("sentence"), F.col("source").alias("who"), F.when(F.col("doc_id") % 3 == 0, "dev").alias("part"), F.when(F.col("doc_id") % 5 == 0, 0.25).alias("confidence"), "lang")
    sinks.json_lines(rows, path)
    got = annotations.read(t.spark, Source("d", "jsonl", path, fields={"id": "utt", "text": "sentence", "speaker_id": "who", "split": "part"}, split="train", confidence=0.5, extra=["lang"]))
    return got.select("id", F.md5("text").alias("text"), "speaker_id", "split", "confidence", "lang", "source")


@query("SELECT c_custkey::VARCHAR AS id, c_name AS text, 'nation' || c_nationkey AS speaker_id, 'test' AS split, 1.0 AS confidence FROM customer")
def source_delimited(t):
    path = f"{_place(t)}/c"
    whole = _lines(t.customer, F.col("c_custkey").cast("string"), F.lit("|"), "c_name", F.lit("|nation"), F.col("c_nationkey").cast("string"))
    short = _lines(t.customer, F.col("c_custkey").cast("string"), F.lit("|"), "c_name")
    whole.unionAll(short).write.text(path)
    got = annotations.read(t.spark, Source("c", "delimited", path, separator="|", columns={"id": 0, "text": 1, "speaker_id": 2}, split="test"))
    return got.select("id", "text", "speaker_id", "split", "confidence")


@query("SELECT s_suppkey::VARCHAR AS id, s_name AS text, CASE WHEN s_nationkey < 20 THEN 'n' || s_nationkey END AS speaker_id, CASE WHEN s_suppkey % 2 = 0 THEN '/v/' || s_suppkey || '.mp4' END AS media FROM supplier")
def source_kaldi(t):
    path, key = _place(t), F.col("s_suppkey").cast("string")
    _lines(t.supplier, key, F.lit(" "), "s_name").write.text(f"{path}/text")
    _lines(t.supplier.where("s_nationkey < 20"), key, F.lit(" n"), F.col("s_nationkey").cast("string")).write.text(f"{path}/utt2spk")
    _lines(t.supplier, key, F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit(" /v/"), key, F.lit(".mp4"))).otherwise(" sox in.wav |")).write.text(f"{path}/video.scp")
    return annotations.read(t.spark, Source("k", "kaldi", path)).select("id", "text", "speaker_id", "media")


@query("SELECT r_name || '/' || n_nationkey AS id, n_name AS text FROM nation JOIN region ON n_regionkey = r_regionkey")
def source_sidecar(t):
    path = _place(t)
    for r in _nations(t):
        sinks.put_file(t.spark, f"{path}/{r['r_name'].replace(' ', '+')}/{r['n_nationkey']}.txt", f"Conf: 1\nText: {r['n_name']}\nText: second\n".encode())
    got = annotations.read(t.spark, Source("s", "sidecar", path, prefix="Text:"))
    return got.select(F.translate("id", "+", " ").alias("id"), "text")


@query("""SELECT 'cv:part' || n_regionkey || '/n' || n_nationkey || '/u' || n_nationkey AS id, n_name AS text, 'cv:n' || n_nationkey AS speaker_id, 'video/u' || n_nationkey || '.mp4' AS media,
    CASE WHEN n_nationkey % 2 = 0 THEN 'u' || n_nationkey || '_landmark.npy' WHEN n_nationkey % 3 = 0 THEN 'u' || n_nationkey || '.npy' END AS landmark, CASE WHEN n_nationkey % 2 = 0 OR n_nationkey % 3 = 0 THEN n_nationkey + 2 END AS n_frames,
    CASE WHEN n_nationkey % 2 = 0 OR n_nationkey % 3 = 0 THEN 'wflw98_normalized' END AS landmark_format, n_nationkey % 5 = 0 AS has_box, n_nationkey % 7 = 0 AS has_audio FROM nation""")
def source_release_tree(t):
    path = _place(t)
    for r in _nations(t):
        k = r["n_nationkey"]
        folder, array = f"{path}/part{r['n_regionkey']}/n{k}", shards.array_bytes(np.zeros((k + 2, 3, 2), np.float32))
        files = {f"txt/u{k}.txt": f"\n{r['n_name']}\nmore".encode()}
        if k % 2 == 0:
            files[f"landmark/u{k}_landmark.npy"] = array
        if k % 3 == 0:
            files[f"landmark/u{k}.npy"] = array
        if k % 5 == 0:
            files[f"roi/u{k}.json"] = b"{}"
        if k % 7 == 0:
            files[f"audio/u{k}.wav"] = b"RIFF"
        for name, data in files.items():
            sinks.put_file(t.spark, f"{folder}/{name}", data)
    last = lambda c, n: F.regexp_extract(c, rf"((?:[^/]+/){{{n}}}[^/]+)$", 1)
    got = annotations.read(t.spark, Source("cv", "cn_cvs", path))
    found = F.when(F.col("landmark_path").isNotNull(), last("landmark_path", 0)).alias("landmark")
    return got.select("id", "text", "speaker_id", last("media", 1).alias("media"), found, "n_frames", "landmark_format", F.col("face_box_path").isNotNull().alias("has_box"), F.col("audio_path").isNotNull().alias("has_audio"))


@query("SELECT 'm:s' || n_regionkey || '/d/x' || n_nationkey % 3 || '_' || n_nationkey AS id, n_name AS text, 's' || n_regionkey AS speaker_id, CASE WHEN n_nationkey % 4 > 0 THEN 's' || n_regionkey || '/d/x' || n_nationkey % 3 || '_' || n_nationkey || '.mp4' END AS media FROM nation")
def source_mirrored_tree(t):
    path = _place(t)
    for r in _nations(t):
        k, s = r["n_nationkey"], f"s{r['n_regionkey']}"
        sinks.put_file(t.spark, f"{path}/text/{s}/d/x{k % 3}_{k}.txt", r["n_name"].encode())
        sinks.put_file(t.spark, f"{path}/text/{s}_{k}.txt", b"too high in the tree")
        if k % 4:
            sinks.put_file(t.spark, f"{path}/{s}/d/x{k % 3}_{k}.mp4", b"v")
    got = annotations.read(t.spark, Source("m", "cmlr", path))
    return got.select("id", "text", "speaker_id", F.nullif(F.regexp_extract("media", r"((?:[^/]+/){2}[^/]+)$", 1), F.lit("")).alias("media"))


LISTED = "f AS (SELECT DISTINCT lang || '/n' || (doc_id % 300) AS key FROM documents)"


def _listing(t: Tables) -> DataFrame:
    return t.documents.select(F.concat(F.lit("/root/"), "lang", F.lit("/n"), F.col("doc_id") % 300, F.lit(".mp4")).alias("path")).distinct()


@query(f"WITH {LISTED} SELECT key, '/root/' || key || '.mp4' AS media FROM f UNION ALL SELECT string_split(key, '/')[2], '/root/' || min(key) || '.mp4' FROM f GROUP BY 1 HAVING count(*) = 1")
def media_index(t):
    return annotations.media_index(_listing(t), "/root")


@query(f"""WITH {LISTED}, b AS (SELECT string_split(key, '/')[2] AS bare, min(key) AS key FROM f GROUP BY 1 HAVING count(*) = 1),
    r AS (SELECT doc_id, 'n' || (doc_id % 300) AS id, CASE WHEN doc_id % 2 = 0 THEN lang END AS speaker, CASE WHEN doc_id % 7 = 0 THEN 'fr/n1.mp4' END AS given FROM documents)
    SELECT doc_id, '/root/' || coalesce(g.key, s.key, b.key) || '.mp4' AS media FROM r LEFT JOIN f g ON r.given = g.key || '.mp4' LEFT JOIN f s ON s.key = r.speaker || '/' || r.id LEFT JOIN b ON b.bare = r.id""")
def resolved_media(t):
    listing = _listing(t)
    rows = t.documents.select("doc_id", F.concat(F.lit("n"), F.col("doc_id") % 300).alias("id"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("speaker_id"), F.when(F.col("doc_id") % 7 == 0, "fr/n1.mp4").alias("media"))
    return annotations.resolve_media(rows, listing, annotations.media_index(listing, "/root"), "/root", ".mp4").select("doc_id", "media")


@query(r"SELECT doc_id, md5(list_filter(list_transform(string_split_regex(text, '\r?\n'), lambda x: trim(x)), lambda x: x <> '')[1]) AS line, regexp_replace(source || '/a.b/c.' || lang, '\.[^./]*$', '') AS path FROM documents")
def line_helpers(t):
    return t.documents.select("doc_id", F.md5(text.first_line("text")).alias("line"), text.without_suffix(F.concat("source", F.lit("/a.b/c."), "lang")).alias("path"))


@query("SELECT source, count(*) AS n FROM (SELECT 'a' AS source FROM nation UNION ALL SELECT 'b' FROM region) GROUP BY 1 UNION ALL SELECT 'off:source_disabled', 1 UNION ALL SELECT 'guessed:pseudo_disabled', 1")
def source_union(t):
    path = _place(t)
    _lines(t.nation, F.col("n_nationkey").cast("string"), F.lit("\t"), "n_name").write.text(f"{path}/a")
    sinks.json_lines(t.region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("text")), f"{path}/b")
    sources = [Source("a", "delimited", f"{path}/a", columns={"id": 0, "text": 1}), Source("b", "jsonl", f"{path}/b"), Source("off", "kaldi", "/nowhere", enabled=False), Source("guessed", "jsonl", "/nowhere", pseudo=True)]
    rows, left_out = annotations.read_all(t.spark, sources, with_pseudo=False)
    return rows.groupBy("source").agg(F.count("*").alias("n")).unionAll(t.spark.createDataFrame(list(left_out.items()), "source string, n long"))


# -- corpora, manifests, transcripts -------------------------------------------------------------
@query("SELECT (row_number() OVER (ORDER BY s_suppkey) - 1)::VARCHAR AS document_id, s_name AS text FROM supplier")
def corpus_lines(t):
    path = f"{_place(t)}/lines"
    t.supplier.orderBy("s_suppkey").select("s_name").coalesce(1).write.text(path)
    return texts.corpus(t.spark, "text", path).select("document_id", "text")


@query("SELECT doc_id::VARCHAR AS document_id, md5(text) AS text FROM documents")
def corpus_jsonl(t):
    path = f"{_place(t)}/docs"
    sinks.json_lines(t.documents.select("doc_id", "text"), path)
    return texts.corpus(t.spark, "jsonl", path, "text", "doc_id").select("document_id", F.md5("text").alias("text"))


@query("SELECT p_partkey::VARCHAR AS document_id, p_name AS text FROM part")
def corpus_delimited(t):
    path = f"{_place(t)}/parts"
    _lines(t.part, F.col("p_partkey").cast("string"), F.lit(";"), "p_brand", F.lit(";"), "p_name").unionAll(_lines(t.region, "r_name")).write.text(path)
    return texts.corpus(t.spark, "delimited", path, 2, 0, ";").select("document_id", "text")


@query("SELECT o_orderkey AS id, o_orderstatus AS status, CASE WHEN o_custkey % 2 = 0 THEN o_totalprice END AS price FROM orders")
def manifest_rows(t):
    path = f"{_place(t)}/manifest"
    sinks.json_lines(t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_totalprice")).alias("price")), path)
    return texts.manifest(t.spark, path, "id long, status string, price double").select("id", "status", "price")


@query("WITH r AS (SELECT s_name AS value, row_number() OVER (ORDER BY s_suppkey) - 1 AS row FROM supplier) SELECT row, value FROM r UNION ALL (SELECT -1, value FROM r ORDER BY row DESC LIMIT 1)")
def numbered_rows(t):
    path = f"{_place(t)}/rows"
    # Every line is followed by a blank one.
    t.supplier.orderBy("s_suppkey").select(F.concat("s_name", F.lit("\n")).alias("value")).coalesce(1).write.text(path)
    rows = texts.numbered_manifest(t.spark, path)
    return rows.select("row", "value").unionAll(texts.row_at(rows, -1).select(F.lit(-1).cast("long").alias("row"), "value"))


CUES = "SELECT n_regionkey::VARCHAR AS video, n_nationkey * 1.5 AS start, n_nationkey * 1.5 + 1.25 AS \"end\", n_name AS text FROM nation"


def _by_region(t: Tables) -> dict[int, list]:
    out: dict[int, list] = {}
    for r in _nations(t):
        out.setdefault(r["n_regionkey"], []).append(r)
    return out


@query(CUES)
def json3_cues(t):
    path = _place(t)
    for region, rows in _by_region(t).items():
        events = [{"tStartMs": r["n_nationkey"] * 1500, "dDurationMs": 1250, "segs": [{"utf8": r["n_name"][:3]}, {"utf8": r["n_name"][3:]}]} for r in rows]
        sinks.put_file(t.spark, f"{path}/{region}.json3", json.dumps({"events": [*events, {"tStartMs": 1, "segs": [{"utf8": " \n"}]}, {"tStartMs": 2}]}).encode())
    return texts.json3_cues(t.spark, path).select(F.regexp_extract("path", r"(\d+)\.json3$", 1).alias("video"), "start", "end", "text")


@query(CUES)
def srt_cues(t):
    path = _place(t)
    stamp = lambda s: f"{int(s // 3600):02d}:{int(s // 60 % 60):02d}:{s % 60:06.3f}".replace(".", ",")
    for region, rows in _by_region(t).items():
        cues = [f"{i}\n{stamp(r['n_nationkey'] * 1.5)} --> {stamp(r['n_nationkey'] * 1.5 + 1.25)}\n{r['n_name'].replace(' ', chr(10))}\n42\n" for i, r in enumerate(rows, 1)]
        sinks.put_file(t.spark, f"{path}/{region}.srt", "\n".join([*cues, "9\n00:00:09,000 --> 00:00:10,000\n\n"]).encode())
    return texts.srt_cues(t.spark, path).select(F.regexp_extract("path", r"(\d+)\.srt$", 1).alias("video"), "start", "end", "text")


@query("SELECT substr(event_type, 1, 1) AS char, round(sum(event_id * 0.5), 1) AS start, round(sum(event_id * 0.5 + 0.25), 2) AS \"end\", count(*) AS n FROM events GROUP BY 1")
def recognised_chars(t):
    path = f"{_place(t)}/asr"
    sinks.json_lines(t.events.select(F.substring("event_type", 1, 1).alias("char"), (F.col("event_id") * 0.5).alias("start"), (F.col("event_id") * 0.5 + 0.25).alias("end")), path)
    got = texts.recognised_chars(t.spark, path)
    return got.groupBy("char").agg(F.round(F.sum("start"), 1).alias("start"), F.round(F.sum("end"), 2).alias("end"), F.count("*").alias("n"))


@query(r"SELECT role AS speaker, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS text FROM conversations WHERE trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''")
def transcript_turns(t):
    path = f"{_place(t)}/turns"
    said = F.trim(F.regexp_replace("text", r"\s+", " "))
    _lines(t.conversations.where(said != ""), "role", F.lit("："), said).unionAll(_lines(t.region, F.lit("（编者注）"), "r_name")).write.text(path)
    return texts.turns(t.spark, path).select("speaker", F.md5("text").alias("text"))


@query("""WITH s AS (SELECT event_id AS line, event_type AS speaker, event_id * 3 AS f0, event_id * 3 + CASE WHEN event_id % 4 = 0 THEN 4 ELSE 1 END AS f1 FROM events), n AS (SELECT speaker, row_number() OVER (ORDER BY min(line)) - 1 AS label FROM s GROUP BY 1)
    SELECT frame, arg_max(label, line)::INT AS label FROM (SELECT line, label, unnest(generate_series(f0, f1)) AS frame FROM s JOIN n ON s.speaker = n.speaker) GROUP BY 1""")
def diarised_frames(t):
    size = F.when(F.col("event_id") % 4 == 0, "0.625").otherwise("0.25")
    lines = t.events.select(F.concat_ws(" ", F.lit("SPEAKER f 1"), (F.col("event_id") * 3 / 8).cast("decimal(20,3)").cast("string"), size, F.lit("<NA> <NA>"), "event_type", F.lit("<NA>")).alias("value"), F.col("event_id").alias("line"))
    return texts.rttm_frames(lines, 0.125)


@query("SELECT DISTINCT frame FROM (SELECT unnest(generate_series(n_nationkey * 10, n_nationkey * 10 + n_regionkey * 5)) AS frame FROM nation WHERE n_nationkey % 3 > 0)")
def speaking_mask(t):
    path = f"{_place(t)}/asd.json"
    segments = [{"start_s": r["n_nationkey"] * 0.4, "end_s": r["n_nationkey"] * 0.4 + r["n_regionkey"] * 0.2 + 0.001, "is_speaker": r["n_nationkey"] % 3 > 0} for r in _nations(t)]
    for s in segments:
        s["start_s"] += 0.001
    sinks.put_file(t.spark, path, json.dumps({"segments": segments}).encode())
    return texts.speaking_frames(t.spark, path, 25.0)


@query("SELECT c_custkey::VARCHAR AS id, c_name || ' of ' || c_mktsegment AS text FROM customer")
def transcript_lines(t):
    path = f"{_place(t)}/transcript"
    key = F.col("c_custkey").cast("string")
    _lines(t.customer, key, F.when(F.col("c_custkey") % 2 == 0, "\t").otherwise(" "), "c_name", F.lit(" of "), "c_mktsegment").unionAll(_lines(t.region, F.lit("alone"))).write.text(path)
    return texts.transcript(t.spark, path)


@query("SELECT p_name AS text FROM part")
def model_lines(t):
    path = f"{_place(t)}/lm"
    line = F.when(F.col("p_partkey") % 2 == 0, F.to_json(F.struct(F.col("p_name").alias("text"), "p_brand"))).otherwise(F.col("p_name"))
    t.part.select(line.alias("value")).unionAll(t.region.select(F.lit("  ").alias("value"))).write.text(path)
    return texts.model_texts(t.spark, path)


@query("SELECT url FROM pages WHERE page_id % 3 > 0 UNION ALL SELECT url || '/' || i FROM pages, (SELECT unnest(range(2)) AS i) WHERE page_id % 3 = 0")
def listed_urls(t):
    path = f"{_place(t)}/urls"
    t.pages.select(F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("  "), "url")).otherwise(F.concat(F.lit("list:"), "url")).alias("value")).unionAll(t.region.select(F.concat(F.lit("# "), "r_name").alias("value"))).write.text(path)
    entries = texts.listed_urls(t.spark, path)
    single = entries.where("not url like 'list:%'").select("url")
    lists = entries.where("url like 'list:%'").select(F.regexp_replace("url", "^list:", "").alias("url"), F.monotonically_increasing_id().alias("ord"))
    # Stands in for the program that lists a channel.
    return single.unionAll(texts.expanded(lists, lambda entry, most: [f"{entry}/{i}" for i in range(most)], 2).select("url"))


@query("SELECT printf('s%02d_%04d', s, n) AS id, text, printf('s%02d', s) AS speaker_id FROM (SELECT unnest(range(4)) AS s), (SELECT n_nationkey AS n, n_name AS text FROM nation)")
def synthetic_rows(t):
    return texts.synthetic(t.spark, [r["n_name"] for r in _nations(t)], 4, 7).select("id", "text", "speaker_id")


@query("""WITH r AS (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN doc_id || '.mp4' WHEN doc_id % 3 = 0 THEN lang || '/' || doc_id || '.mp4' END AS media FROM documents)
    SELECT CASE WHEN media IS NULL THEN 'missing_media' WHEN length(text) < 200 THEN 'short_text' ELSE 'kept' END AS outcome, count(*) AS n FROM r GROUP BY 1""")
def existing_media(t):
    flat, deep = F.concat(F.col("doc_id").cast("string"), F.lit(".mp4")), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".mp4"))
    listing = t.documents.where("doc_id % 2 = 0").select(flat.alias("path")).unionAll(t.documents.where("doc_id % 3 = 0").select(deep.alias("path")))
    kept, lost = texts.existing_media(t.documents, listing, [flat, deep], 200)
    return kept.agg(F.lit("kept").alias("outcome"), F.count("*").alias("n")).unionAll(lost.select(F.col("reject_reason").alias("outcome"), "n"))


@query("SELECT n_name AS unit, row_number() OVER (ORDER BY n_nationkey) + 2 AS id FROM nation UNION ALL SELECT unnest(['<blank>', '<sos/eos>', '<unk>']), unnest([0, 1, 2])")
def vocabulary_units(t):
    path = f"{_place(t)}/vocab.json"
    sinks.put_file(t.spark, path, json.dumps(["<blank>", "<sos/eos>", "<unk>", *(r["n_name"] for r in _nations(t))]).encode())
    return texts.vocabulary_file(t.spark, path)


@query("SELECT 'run/ckpt_ep' || o_orderkey || '.pt' AS path, o_orderkey::INT AS epoch FROM orders WHERE o_orderkey % 4 > 0")
def checkpoint_listing(t):
    name = F.when(F.col("o_orderkey") % 4 > 0, F.concat(F.lit("run/ckpt_ep"), F.col("o_orderkey").cast("string"), F.lit(".pt"))).otherwise("run/last.pt")
    return texts.checkpoints(t.orders.select(name.alias("path")))


# -- clips and shards ----------------------------------------------------------------------------
def _clips(t: Tables) -> DataFrame:
    """Vectors as clips of one frame of 8 x 8 bytes: key, array (.npy), meta."""

    def run(frames):
        for frame in frames:
            arrays = [shards.array_bytes((np.abs(np.asarray(v, np.float32)) * 100).astype(np.uint8).reshape(1, 8, 8)) for v in frame["embedding"]]
            yield pd.DataFrame({"key": frame["vec_id"].map("{:08d}".format), "array": arrays, "meta": [json.dumps({"label": int(x)}) for x in frame["label"]]})

    return t.embeddings.mapInPandas(run, "key string, array binary, meta string")


BYTES = "SELECT printf('%08d', vec_id) AS key, label, list_sum(list_transform(embedding, lambda x: floor(abs(x) * 100::FLOAT)::BIGINT % 256))::BIGINT AS total, vec_id FROM embeddings"


def _totals(clips: DataFrame, *keys: str) -> DataFrame:
    def run(frames):
        for frame in frames:
            yield frame[[*keys]].assign(total=[int(np.frombuffer(p, np.uint8).sum()) for p in frame["pixels"]])

    kinds = dict(clips.dtypes)
    return clips.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", total long")


@query(f"SELECT key, label::INT AS label, total, (row_number() OVER (ORDER BY key) - 1) // 40 AS shard FROM ({BYTES})")
def shard_round_trip(t):
    path = f"{_place(t)}/shards"
    shards.write(shards.shard_numbers(_clips(t), 40), path)
    tars = t.spark.read.parquet(path)
    got = shards.read(t.spark, path)
    read_ = _totals(shards.clips(got.select(F.col("key").alias("path"), F.col("array").alias("content"))), "path")
    labels = got.select(F.col("key").alias("path"), F.get_json_object("meta", "$.label").cast("int").alias("label"))
    # Shards are full but for the last, so a key's place tells its shard.
    placed = numbered(got.select(F.col("key").alias("path")), "at", "path").select("path", F.floor(F.col("at") / 40).alias("shard"))
    assert tars.count() == tars.select("shard").distinct().count()
    return read_.join(labels, "path").join(placed, "path").select(F.col("path").alias("key"), "label", "total", "shard")


@query(f"SELECT CASE WHEN vec_id % 2 = 0 THEN 'wds://part' || vec_id % 10 || '.tar::' || key || '.npy' ELSE 'clips/' || key END AS uri, 1 AS frames, 8 AS height, 8 AS width, total FROM ({BYTES})")
def loaded_clips(t):
    rows = _clips(t).withColumn("id", F.col("key").cast("long"))
    members = rows.select(F.concat(F.lit("part"), F.col("id") % 10, F.lit(".tar")).alias("shard"), "key", "array")
    files = shards.clips(rows.where("id % 2 > 0").select(F.concat(F.lit("clips/"), "key").alias("path"), F.col("array").alias("content")))
    uris = rows.select(F.when(F.col("id") % 2 == 0, F.concat(F.lit("wds://part"), F.col("id") % 10, F.lit(".tar::"), "key", F.lit(".npy"))).otherwise(F.concat(F.lit("clips/"), "key")).alias("uri"))
    return _totals(shards.load_any(files, members, uris), "uri", "frames", "height", "width")


@query("SELECT n_regionkey::VARCHAR AS path, count(*)::INT AS frames, 2 AS height, 3 AS width, sum(6 * n_nationkey)::BIGINT AS total FROM nation GROUP BY 1")
def frame_folders(t):
    path = _place(t)
    for r in _nations(t):
        sinks.put_file(t.spark, f"{path}/{r['n_regionkey']}/{r['n_nationkey']:04d}.pgm", b"P5\n3 2\n255\n" + bytes([r["n_nationkey"]] * 6))
    clips = shards.frame_folders(annotations.files(t.spark, path, True))
    return _totals(clips, "path", "frames", "height", "width").withColumn("path", F.element_at(F.split("path", "/"), -1))


@query("SELECT n_nationkey::BIGINT AS frame, 9 AS points, 3 * n_nationkey AS x FROM nation")
def track_cache(t):
    path = f"{_place(t)}/a.npz"
    rows = _nations(t)
    points = np.array([[[3 * r["n_nationkey"], 1], [2, 2]] for r in rows], np.float32)
    sinks.put_file(t.spark, path, shards.track_bytes(np.array([r["n_nationkey"] for r in rows]), points, 25.0, 640, 480, {"landmark_count": 9}, np.array([4, 8])))
    return shards.tracks(annotations.files(t.spark, path, True)).select("frame", F.size("points").alias("points"), F.col("points")[4][0].cast("int").alias("x"))


# -- sinks ---------------------------------------------------------------------------------------
@query("SELECT lang AS split, doc_id, md5(text) AS text FROM documents")
def sink_by_split(t):
    path = f"{_place(t)}/rows"
    sinks.json_by_split(t.documents.select("doc_id", "text", F.col("lang").alias("split")), path)
    return t.spark.read.schema("doc_id long, text string, split string").json(path).select("split", "doc_id", F.md5("text").alias("text"))


@query("SELECT conv_id, turn, role, md5(text) AS text, 2 AS n FROM conversations")
def sink_appended(t):
    path = f"{_place(t)}/chat"
    rows = t.conversations.select("conv_id", "turn", "role", "text")
    sinks.json_lines(rows, path)
    sinks.json_lines(rows, path, append=True)
    got = t.spark.read.schema("conv_id long, turn long, role string, text string").json(path)
    return got.groupBy("conv_id", "turn", "role", F.md5("text").alias("text")).agg(F.count("*").cast("int").alias("n"))


@query("SELECT o_orderkey AS n, o_orderstatus AS s FROM orders")
def sink_published(t):
    path = f"{_place(t)}/manifest.jsonl"
    sinks.publish_lines(t.region.select(F.lit(-1).alias("n")), path)
    sinks.publish_lines(t.orders.select(F.col("o_orderkey").alias("n"), F.col("o_orderstatus").alias("s")), path)
    return t.spark.read.schema("n long, s string").json(path)


@query("SELECT n_name AS name, n_nationkey % 2 = 0 AS copied, n_nationkey % 4 = 3 AS refused FROM nation")
def sink_immutable(t):
    path, out = _place(t), []
    for r in _nations(t):
        k = r["n_nationkey"]
        sinks.put_file(t.spark, f"{path}/in{k}", r["n_name"].encode())
        if k % 2:
            sinks.put_file(t.spark, f"{path}/out{k}", r["n_name"].encode() if k % 4 == 1 else b"other")
        try:
            out.append((r["n_name"], sinks.copy_immutable(t.spark, f"{path}/in{k}", f"{path}/out{k}"), False))
        except FileExistsError:
            out.append((r["n_name"], False, True))
    return t.spark.createDataFrame(out, "name string, copied boolean, refused boolean")


@query("SELECT url, CASE WHEN length(url) > 45 THEN 'long' END AS reason, length(url) <= 45 AS passed FROM pages")
def sink_verdicts(t):
    path = _place(t)
    long = gates.all_failures([("long", F.length("url") > 45)])
    sinks.verdicts(gates.funnel(t.pages.select("url"), [("metadata", lambda d: d, long)]), path)
    report = t.spark.read.schema("url string, reasons array<string>, passed boolean").json(f"{path}/report")
    passed = t.spark.read.text(f"{path}/passed").distinct().withColumn("__listed", F.lit(True))
    return report.join(passed, F.col("url") == F.col("value"), "left").select("url", F.get("reasons", F.lit(0)).alias("reason"), (F.col("passed") & F.coalesce("__listed", F.lit(False))).alias("passed"))


@query("SELECT '| ' || r_regionkey || ' | ' || r_name || ' |' AS line FROM region UNION ALL SELECT unnest(['| r_regionkey | r_name |', '| --- | --- |'])")
def sink_markdown(t):
    return t.spark.createDataFrame([(line,) for line in sinks.markdown(t.region.orderBy("r_regionkey")).split("\n")], "line string")


@query("SELECT event_id AS task_id, event_type AS message, user_id::VARCHAR AS who, round(value, 6) AS value FROM events")
def sink_event_log(t):
    path = f"{_place(t)}/events"
    rows = t.events.select(F.col("event_id").alias("task_id"), F.lit("info").alias("level"), F.col("event_type").alias("message"), F.lit(0.0).alias("created_at"), "user_id", "value")
    sinks.event_log(rows.where("task_id % 2 = 0"), path, "user_id", "value")
    sinks.event_log(rows.where("task_id % 2 > 0"), path, "user_id", "value")
    got = t.spark.read.schema("task_id long, level string, message string, data string, created_at double").json(path)
    data = F.from_json("data", "user_id string, value double")
    return got.select("task_id", "message", data.alias("d")).select("task_id", "message", F.col("d.user_id").alias("who"), F.round("d.value", 6).alias("value"))


@query("SELECT n_name AS path, length(n_name) AS length, sha256(n_name) AS sha256, n_nationkey % 2 = 0 AS stale FROM nation")
def file_digests(t):
    path = _place(t)
    for r in _nations(t):
        sinks.put_file(t.spark, f"{path}/{r['n_name'].replace(' ', '+')}", r["n_name"].encode())
    name = F.translate(F.element_at(F.split("path", "/"), -1), "+", " ")
    done = t.nation.where("n_nationkey % 2 > 0").select(F.col("n_name").alias("path"), F.lit("1").alias("version"))
    prints = texts.fingerprints(t.spark, path).select(name.alias("path"), "fingerprint", F.lit("1").alias("version"))
    left = texts.stale(prints, done.join(prints.select("path", "fingerprint"), "path")).select("path", F.lit(True).alias("stale"))
    got = texts.file_digests(t.spark, path).select(name.alias("path"), "length", "sha256")
    return got.join(left, "path", "left").withColumn("stale", F.coalesce("stale", F.lit(False)))
