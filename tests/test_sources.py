import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowmill.operators import tasks
from sparrowmill.sources import annotations, shards, sinks, texts
from sparrowmill.sources.annotations import Source
from sparrowmill.streaming import cues


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def test_delimited(spark, tmp_path):
    put(tmp_path / "a.tsv", "﻿u1\thello\ts1\nu2\tworld\ts2\nshort\n")
    rows, out = annotations.read_all(spark, [Source("a", "delimited", str(tmp_path / "a.tsv"), columns={"id": 0, "text": 1, "speaker_id": 2}), Source("future", "delimited", "/nowhere", enabled=False)])
    assert sorted((r["id"], r["text"], r["speaker_id"], r["source"]) for r in rows.collect()) == [("u1", "hello", "s1", "a"), ("u2", "world", "s2", "a")]
    assert out == {"future:source_disabled": 1}
    with pytest.raises(ValueError):
        annotations.read(spark, Source("x", "nothing", ""))


def test_jsonl(spark, tmp_path):
    put(tmp_path / "a.jsonl", '{"utt": "1", "sentence": "x", "split": "dev"}\n{"utt": "2", "sentence": " "}\n')
    got = annotations.read(spark, Source("a", "jsonl", str(tmp_path / "a.jsonl"), fields={"id": "utt", "text": "sentence"}, split="train", confidence=0.5)).orderBy("id").collect()
    assert [(r["id"], r["text"], r["split"], r["confidence"]) for r in got] == [("1", "x", "dev", 0.5), ("2", None, "train", 0.5)]


def test_kaldi(spark, tmp_path):
    put(tmp_path / "text", "u1 hello there\nu2 bye\n")
    put(tmp_path / "utt2spk", "u1 s1\nu1 s9\n")
    put(tmp_path / "video.scp", "u1 /v/1.mp4\nu2 cat x |\n")
    got = {r["id"]: r for r in annotations.read(spark, Source("k", "kaldi", str(tmp_path))).collect()}
    assert (got["u1"]["text"], got["u1"]["speaker_id"], got["u1"]["media"]) == ("hello there", "s9", "/v/1.mp4") and got["u2"]["media"] is None and got["u2"]["speaker_id"] is None


def test_release_and_mirrored_trees(spark, tmp_path):
    put(tmp_path / "r/part02/n004/txt/a.txt", "\n第一行\n第二行")
    put(tmp_path / "r/part02/n004/video/a.mp4", b"x")
    put(tmp_path / "r/part02/n004/landmark/a.npy", b"x")
    got = annotations.read(spark, Source("cn:news", "cn_cvs", str(tmp_path / "r"))).first()
    assert got["id"] == "cn:news:part02/n004/a" and got["text"] == "第一行" and got["media"].endswith("a.mp4") and got["landmark_path"].endswith("a.npy")
    for s in ("s1", "s2"):
        put(tmp_path / f"m/text/{s}/d/x.txt", s)
        put(tmp_path / f"m/{s}/d/x.mp4", b"v")
    rows = annotations.read(spark, Source("m", "cmlr", str(tmp_path / "m"))).collect()
    assert len({r["id"] for r in rows}) == 2 and all(r["media"].endswith(f"{r['speaker_id']}/d/x.mp4") for r in rows)


def test_sidecar_and_index(spark, tmp_path):
    put(tmp_path / "a/one.txt", "Text: hi\nConf: 1")
    put(tmp_path / "b/one.txt", "Text: ho")
    got = {r["id"]: r["text"] for r in annotations.read(spark, Source("s", "sidecar", str(tmp_path), prefix="Text:")).collect()}
    assert got == {"a/one": "hi", "b/one": "ho"}
    listing = annotations.files(spark, str(tmp_path))
    keys = {r["key"] for r in annotations.media_index(listing, str(tmp_path)).collect()}
    assert keys == {"a/one", "b/one"}
    rows = spark.createDataFrame([("a/one", None, None), ("zzz", None, None)], "id string, media string, speaker_id string")
    out = {r["id"]: r["media"] for r in annotations.resolve_media(rows, listing, annotations.media_index(listing, str(tmp_path)), str(tmp_path), ".txt").collect()}
    assert out["a/one"].endswith("a/one.txt") and out["zzz"] is None


def test_subtitles(spark, tmp_path):
    put(tmp_path / "a.srt", "1\n00:00:01,500 --> 00:00:02,250\nhello\n42\nworld\n\n2\n00:01:00,000 --> 00:01:01,000\n\n")
    put(tmp_path / "a.json3", json.dumps({"events": [{"tStartMs": 1000, "dDurationMs": 500, "segs": [{"utf8": "a"}, {"utf8": "b"}]}, {"tStartMs": 5, "segs": [{"utf8": "\n"}]}, {"tStartMs": 2000, "segs": [{"utf8": "c"}]}]}))
    assert [(r["start"], r["end"], r["text"]) for r in texts.srt_cues(spark, str(tmp_path / "a.srt")).collect()] == [(1.5, 2.25, "hello world")]
    assert [(r["start"], r["end"], r["text"]) for r in texts.json3_cues(spark, str(tmp_path / "a.json3")).orderBy("start").collect()] == [(1.0, 1.5, "ab"), (2.0, 2.0, "c")]


def test_corpora_and_transcripts(spark, tmp_path):
    p = put(tmp_path / "a.txt", "one\ntwo\n")
    assert [(r["document_id"], r["text"]) for r in texts.corpus(spark, "text", p).orderBy("ord").collect()] == [("0", "one"), ("1", "two")]
    with pytest.raises(ValueError):
        texts.corpus(spark, "xml", p)
    p = put(tmp_path / "t.txt", "张三：你好\n（编者注：略）\nbad line\n李四: 再见\n")
    assert [(r["speaker"], r["text"]) for r in texts.turns(spark, p).orderBy("ord").collect()] == [("张三", "你好"), ("李四", "再见")]
    p = put(tmp_path / "lm.txt", '{"text": "x"}\ny\n\n')
    assert sorted(r["text"] for r in texts.model_texts(spark, p).collect()) == ["x", "y"]
    p = put(tmp_path / "tr.txt", "u1\ta b\nu2 c d\n")
    assert {r["id"]: r["text"] for r in texts.transcript(spark, p).collect()} == {"u1": "a b", "u2": "c d"}


def test_positions_and_checkpoints(spark, tmp_path):
    p = put(tmp_path / "a.jsonl", '{"id": 1}\n\n{"id": 2}\n')
    rows = texts.numbered_manifest(spark, p)
    assert rows.count() == 2 and json.loads(texts.row_at(rows, -1).first()["value"]) == {"id": 2}
    listing = spark.createDataFrame([("x/ckpt_ep10.pt",), ("x/ckpt_ep9.pt",), ("x/last.pt",)], "path string")
    assert [r["epoch"] for r in texts.checkpoints(listing).collect()] == [9, 10]


def test_diarisation(spark):
    lines = spark.createDataFrame([("SPEAKER f 1 0.0 0.2 <NA> <NA> B <NA>", 0), ("SPEAKER f 1 0.2 0.1 <NA> <NA> A <NA>", 1)], "value string, line long")
    assert {r["frame"]: r["label"] for r in texts.rttm_frames(lines, 0.1).collect()} == {0: 0, 1: 0, 2: 1}


def test_shards_round_trip(spark, tmp_path):
    clip = np.arange(3 * 8 * 8, dtype=np.uint8).reshape(3, 8, 8)
    rows = spark.createDataFrame([(f"k{i}", bytearray(shards.array_bytes(clip + i)), json.dumps({"i": i})) for i in range(5)], "key string, array binary, meta string")
    shards.write(shards.shard_numbers(rows, 2), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    got = {r["key"]: r for r in shards.read(spark, str(tmp_path / "out")).collect()}
    assert (shards.load_array(bytes(got["k4"]["array"])) == clip + 4).all() and json.loads(got["k2"]["meta"]) == {"i": 2}
    assert shards.parse_address(shards.address("a.tar", "k1")) == ("a.tar", "k1")
    with pytest.raises(ValueError):
        shards.parse_address("a.tar")


def test_clips_are_gray(spark):
    out = io.BytesIO()
    np.save(out, np.full((2, 4, 4, 3), 9, np.uint8))
    row = shards.clips(spark.createDataFrame([("p", bytearray(out.getvalue()))], "path string, content binary")).first()
    assert (row["frames"], row["height"], row["width"]) == (2, 4, 4) and set(row["pixels"]) == {9}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "train", None), ("b", "dev", 2)], "id string, split string, n int")
    sinks.json_by_split(rows, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).where("split = 'dev'").first()["id"] == "b"
    assert sinks.markdown(rows.where("id = 'b'")).splitlines()[2] == "| b | dev | 2 |"
    with pytest.raises(Exception):
        sinks.json_by_split(rows, str(tmp_path / "m"))


def test_streamed_cues_match_the_table(spark, tmp_path):
    table = spark.createDataFrame([("v", 0, 3, 6), ("v", 1, 5, 9), ("v", 2, 90, 99), ("v", 3, 0, 40)], "video string, cue int, f0 int, f1 int")
    for part in range(3):
        spark.createDataFrame([("v", f) for f in range(part * 10, part * 10 + 10)], "video string, frame_no int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    frames = spark.readStream.schema("video string, frame_no int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = cues.closed_cues(frames, table).writeStream.format("memory").queryName("closed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    want = cues.closed_cues(spark.read.parquet(str(tmp_path / "in")), table)
    got = spark.table("closed")
    assert sorted(map(tuple, got.select("cue", "n").collect())) == sorted(map(tuple, want.select("cue", "n").collect())) == [(0, 4), (1, 5)]
    assert cues.closed_cues(spark.read.parquet(str(tmp_path / "in")), table, emit_incomplete=True).where("not complete").count() == 1


def test_streamed_task_states(spark, tmp_path):
    rows = [("t", 1, "submit", 2), ("t", 2, "claim", 0), ("t", 3, "fail", 0), ("t", 4, "claim", 0), ("t", 5, "complete", 0)]
    spark.createDataFrame(rows, "task_id string, seq int, verb string, max_attempts int").coalesce(1).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("task_id string, seq int, verb string, max_attempts int").parquet(str(tmp_path / "in"))
    q = cues.task_states(events).writeStream.format("memory").queryName("states").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert tuple(spark.table("states").first()) == ("t", "succeeded", 2)


def test_last_write_sink(spark, tmp_path):
    spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, seq int, v string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, seq int, v string").parquet(str(tmp_path / "in"))
    cues.last_write(stream, str(tmp_path / "out"), ["k"], "seq", str(tmp_path / "c")).awaitTermination(120)
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(str(tmp_path / "out/v=0")).collect()) == [("a", "y"), ("b", "z")]


def test_upsert_and_changed_content(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, sha256 string")
    new = spark.createDataFrame([("b", "3"), ("c", "4")], "k string, sha256 string")
    assert [(r["k"], r["sha256"]) for r in tasks.upsert(old, new, "k").collect()] == [("a", "1"), ("b", "3"), ("c", "4")]
    assert [r["k"] for r in tasks.changed_content(old, new, "k").collect()] == ["b"]
    done = spark.createDataFrame([(1, "download", "succeeded", "p")], "task_id int, kind string, status string, payload string")
    assert tasks.chained(done, {"download": "analyze"}).first()["kind"] == "analyze"
    assert F is not None


def npy(*shape):
    return shards.array_bytes(np.zeros(shape, np.float32))


def test_release_tree_reads_what_lies_beside_a_text(spark, tmp_path):
    """Names as the release has them, other depths, both names of landmarks, several files of one stem."""
    for folder in ("a/b/c/n1", "n2"):
        put(tmp_path / folder / "txt/x.txt", "\n\n hello \nrest")
        put(tmp_path / folder / "video/x.mp4", b"v")
        put(tmp_path / folder / "landmark/x_landmark.npy", npy(12, 98, 2))
        put(tmp_path / folder / "roi/x.json", "{}")
        put(tmp_path / folder / "roi/x.txt", "not a box")
        put(tmp_path / folder / "audio/x.wav", b"a")
        put(tmp_path / folder / "audio/x.flac", b"a")
        put(tmp_path / folder / "txt/y.txt", "no media")
        put(tmp_path / folder / "landmark/y.npy", npy(7, 98, 2))
    got = {r["id"]: r for r in annotations.read(spark, Source("cv", "cn_cvs", str(tmp_path))).collect()}
    assert sorted(got) == ["cv:a/b/c/n1/x", "cv:a/b/c/n1/y", "cv:n2/x", "cv:n2/y"]
    x, y = got["cv:a/b/c/n1/x"], got["cv:n2/y"]
    assert x["text"] == "hello" and x["speaker_id"] == "cv:n1" and x["media"].endswith("a/b/c/n1/video/x.mp4") and x["n_frames"] == 12 and x["landmark_format"] == "wflw98_normalized"
    assert x["landmark_path"].endswith("x_landmark.npy") and x["face_box_path"].endswith("roi/x.json") and x["audio_path"].endswith("x.wav")
    assert y["media"].endswith("n2/video/y.mp4") and y["n_frames"] == 7 and y["face_box_path"] is y["audio_path"] is None


def test_track_caches_round_trip(spark, tmp_path):
    points = np.arange(2 * 3 * 2, dtype=np.float32).reshape(2, 3, 2)
    put(tmp_path / "a.npz", shards.track_bytes(np.array([4, 6]), points, 25.0, 640, 480, {"landmark_count": 9}, np.array([1, 3, 8])))
    out = io.BytesIO()
    np.savez_compressed(out, frames=np.array([1]), landmarks=points[:1].astype(np.float16), fps=30.0, width=2, height=3, meta=np.array(["{'landmark_count': __import__('os').getpid()}"]), point_indices=np.array([], np.int16))
    put(tmp_path / "b.npz", out.getvalue())
    got = {(r["path"].rpartition("/")[2], r["frame"]): r for r in shards.tracks(annotations.files(spark, str(tmp_path), True)).collect()}
    a = got["a.npz", 6]
    assert len(a["points"]) == 9 and a["points"][3] == points[1, 1].tolist() and all(np.isnan(v) for v in a["points"][0]) and (a["fps"], a["width"], a["height"]) == (25.0, 640, 480)
    assert got["b.npz", 1]["points"] == points[0].tolist()


def test_clips_of_folders_and_addresses(spark, tmp_path):
    for i in range(3):
        put(tmp_path / f"v/{i:03d}.pgm", b"P5 # a comment\n4 2\n255\n" + bytes(range(i, i + 8)))
        put(tmp_path / f"w/{i:03d}.ppm", b"P6\n1 1\n255\n" + bytes([i, i + 3, i + 6]))
    clips = shards.frame_folders(annotations.files(spark, str(tmp_path), True))
    got = {r["path"].rpartition("/")[2]: r for r in clips.collect()}
    assert (got["v"]["frames"], got["v"]["height"], got["v"]["width"]) == (3, 2, 4) and got["v"]["pixels"][8:16] == bytearray(range(1, 9)) and list(got["w"]["pixels"]) == [3, 4, 5]
    members = spark.createDataFrame([("s.tar", "k", bytearray(shards.array_bytes(np.full((2, 1, 1), 7, np.uint8))))], "shard string, key string, array binary")
    uris = spark.createDataFrame([(shards.address("s.tar", "k"),), (got["v"]["path"],)], "uri string")
    assert sorted(r["frames"] for r in shards.load_any(clips, members, uris).collect()) == [2, 3]


def test_configurations_are_read_from_yaml(spark, tmp_path):
    from sparrowmill.plans.corpus import TextRules

    pytest.importorskip("yaml")
    path = put(tmp_path / "c.yaml", "# rules\nleast: 3\ndelimiters: '[.]'\n")
    got = texts.read_config(spark, path, TextRules, ["most=9"])
    assert (got.least, got.most, got.delimiters) == (3, 9, "[.]")
    with pytest.raises(KeyError):
        texts.read_config(spark, put(tmp_path / "d.yaml", "lest: 3"), TextRules)


def test_playlists_are_expanded(spark):
    entries = spark.createDataFrame([("http://x/watch?v=1", "1"), ("http://x/list", "2")], "url string, ord string")
    got = texts.expanded(entries, lambda e, most: [f"{e}/{i}" for i in range(9)] + ["no"], 3).orderBy("ord").collect()
    assert [r["url"] for r in got] == ["http://x/watch?v=1", "http://x/list/0", "http://x/list/1", "http://x/list/2"]


def test_files_appear_whole_and_are_not_replaced(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b"), (1, None)], "n int, s string")
    path = str(tmp_path / "m.jsonl")
    for frame in (rows.where("n < 0"), rows.orderBy("n")):
        sinks.publish_lines(frame, path)
    assert (tmp_path / "m.jsonl").read_text() == '{"n":1}\n{"n":2,"s":"b"}\n' and {f.name for f in tmp_path.iterdir() if not f.name.endswith(".crc")} == {"m.jsonl"}
    a, b = put(tmp_path / "a", b"x"), put(tmp_path / "b", b"y")
    target = str(tmp_path / "t")
    assert sinks.copy_immutable(spark, a, target) and not sinks.copy_immutable(spark, a, target)
    with pytest.raises(FileExistsError):
        sinks.copy_immutable(spark, b, target)
    assert (tmp_path / "t").read_bytes() == b"x"


def test_worker_claims_retries_and_fails(spark, tmp_path):
    from sparrowmill.streaming.worker import Queue, Worker

    queue = Queue(spark, str(tmp_path / "q"))
    done = []

    def work(payload):
        done.append(payload)
        if payload == "bad":
            raise ValueError("no")

    worker = Worker(queue, "n1", {"render": work})
    assert worker.run(once=True) == 0
    queue.submit("render", "low", now=1.0)
    queue.submit("render", "bad", priority=5, max_attempts=2, now=2.0)
    queue.submit("other", "never", priority=9, now=3.0)
    assert [worker.step(now=10.0) for _ in range(4)] == [2, 2, 1, None] and done == ["bad", "bad", "low"]
    got = {r["task_id"]: r for r in queue.tasks().collect()}
    assert [got[i]["status"] for i in (1, 2, 3)] == ["succeeded", "failed", "queued"] and "ValueError: no" in got[2]["error"] and got[2]["attempts"] == 2
    # A worker that dies leaves a lease that runs out.
    queue.submit("render", "left", max_attempts=2, now=4.0)
    queue.append([{"task_id": 4, "verb": "claim", "node": "dead", "lease_until": 20.0}])
    assert worker.step(now=15.0) is None and worker.step(now=25.0) == 4 and done[-1] == "left"


def test_streamed_cues_over_gaps_and_batches(spark, tmp_path):
    """Frames with gaps, in several batches and videos: as the table says, and no state of what is closed."""
    import random

    rng = random.Random(1)
    frames = [(v, f) for v in "ab" for f in sorted(rng.sample(range(400), 150))]
    table = spark.createDataFrame([(v, i, f, f + rng.randrange(0, 60)) for v in "abc" for i, f in enumerate(rng.sample(range(400), 60))], "video string, cue int, f0 int, f1 int")
    for part in range(4):
        mine = [r for r in frames if part * 100 <= r[1] < part * 100 + 100]
        spark.createDataFrame(mine, "video string, frame_no int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("video string, frame_no int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = cues.closed_cues(stream, table).writeStream.format("memory").queryName("closed_gaps").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(180)
    want = cues.closed_cues(spark.read.parquet(str(tmp_path / "in")), table)
    names = ["video", "cue", "f0", "f1", "n", "complete"]
    got = sorted(map(tuple, spark.table("closed_gaps").select(*names).collect()))
    assert got == sorted(map(tuple, want.select(*names).collect())) and len(got) > 80


def test_service_answers_and_guards_workers(spark, tmp_path):
    import threading
    import urllib.error
    import urllib.request

    from sparrowmill.streaming.service import Service, serve
    from sparrowmill.streaming.worker import Queue

    service = Service(Queue(spark, str(tmp_path / "q")), "secret")
    assert service.answer("POST", "/api/tasks", {"kind": "render", "payload": "p", "max_attempts": 1}) == (201, {"id": 1})
    assert service.answer("POST", "/api/worker/claim", {"kinds": ["render"], "node": "n"}, "wrong")[0] == 401
    assert service.answer("POST", "/api/worker/claim", {"kinds": ["render"], "node": "n"}, "secret")[1]["task"]["payload"] == "p"
    assert service.answer("POST", "/api/worker/complete", {"task_id": 1, "node": "other"}, "secret")[0] == 200
    assert service.answer("GET", "/api/tasks/1", {})[1]["task"]["status"] == "running"
    assert service.answer("POST", "/api/worker/fail", {"task_id": 1, "node": "n", "error": "e"}, "secret")[0] == 200
    assert [r["error"] for r in service.answer("GET", "/api/tasks?status=failed", {})[1]] == ["e"]
    assert service.answer("POST", "/api/tasks/1/retry", {})[0] == 200 and service.answer("GET", "/api/tasks/9", {})[0] == service.answer("POST", "/api/tasks/1/explode", {})[0] == 404
    assert service.answer("POST", "/api/tasks", {})[0] == 400
    server = serve(service, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_address[1]}"
    assert {"what": "status", "value": "queued", "n": 1} in json.loads(urllib.request.urlopen(f"{url}/api/summary").read())
    with pytest.raises(urllib.error.HTTPError):
        urllib.request.urlopen(urllib.request.Request(f"{url}/api/tasks", b"not json"))
    server.shutdown()


def test_tracker_and_survivors(spark, tmp_path):
    from sparrowmill.plans.corpus import built_survivors

    tracker = sinks.Tracker(spark, str(tmp_path / "m"), model="x")
    tracker.log(1, loss=0.5, skipped=None)
    sinks.Tracker(spark).log(1, loss=2.0)
    got = sorted((r["step"], r["name"], r["value"], r["text"]) for r in spark.read.schema("step long, name string, value double, text string").json(str(tmp_path / "m")).collect())
    assert got == [(0, "model", None, "x"), (1, "loss", 0.5, "0.5")]
    verdicts = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "url string, passed boolean")
    built = {r["url"]: r for r in built_survivors(verdicts, lambda r: {"size": {"a": 3}[r["url"]]}, "size int").collect()}
    assert sorted(built) == ["a", "c"] and built["a"]["size"] == 3 and "KeyError" in built["c"]["error"]
