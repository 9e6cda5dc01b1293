import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowmill.functions.lexicon import Lexicon
from sparrowmill.operators import align, augment, batching, cluster, dedup, faces, gates, graph, joins, ngram, signals, tasks
from sparrowmill.plans import corpus


def plain_two_keys(rows):
    ids, media, kept = set(), set(), []
    for o, a, b in rows:
        if a not in ids and b not in media:
            ids.add(a), media.add(b), kept.append(o)
    return kept


@pytest.mark.parametrize("rows", [[(1, "i1", "m1"), (2, "i2", "m1"), (3, "i2", "m2")], [(1, "i1", "m1"), (2, "i1", "m2"), (3, "i2", "m2")], None])
def test_two_keys_greedy(spark, rows):
    rng = random.Random(3)
    rows = rows or [(o, f"i{rng.randrange(12)}", f"m{rng.randrange(12)}") for o in range(60)]
    got = dedup.greedy_two_keys(spark.createDataFrame(rows, "o int, id string, media string"), "o", "id", "media")
    assert sorted(r["o"] for r in got.where("reject_reason is null").collect()) == plain_two_keys(rows)


def test_content_dedup_keeps_other_pictures(spark):
    rows = spark.createDataFrame([(1, "t", "A", 5, "s1"), (2, "t", "B", 5, "s2"), (3, "t", "A", 5, "s1")], "o int, text string, hash string, n int, spk string")
    got = dedup.best_of(rows, ["text", "hash"], "n", ["o"])
    assert sorted(r["o"] for r in got.collect()) == [1, 2]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert all(got.get(x, x) == p for x, p in parent.items())


def test_corpus_build_counts_and_splits(spark):
    docs = spark.createDataFrame([("d1", "s", 0, "今天天气很好。我们出去散步。"), ("d2", "s", 1, "今天天气很好。我的手机在桌上。")], "document_id string, source string, ord int, text string")
    held = spark.createDataFrame([("我的手机在桌上",)], "text string")
    rules = corpus.TextRules(least=2, val=30, test=30)
    counts = {r["reason"]: r["n"] for r in gates.reject_counts(corpus.gated_sentences(docs, held, rules)).collect()}
    assert counts == {"accepted": 2, "duplicate": 1, "heldout_contamination": 1}
    out = corpus.text_corpus(docs, held, rules)
    assert joins.leaks(out, "document_id").count() == 0


def test_manifest_reasons(spark):
    rows = [("1", "a", "x", "m1", "s"), ("2", "a", "x", "m2", "s"), ("3", "b", "x", None, "s"), ("4", "c", "x", "m1", "s"), ("5", None, "x", "m5", "s"), ("6", "d", "x" * 99, "m6", "s"), ("7", "e", "x", "m7", None), ("8", "d", "y", "m8", "s")]
    frame = spark.createDataFrame(rows, "ord string, id string, text string, media string, speaker_id string").withColumn("source", F.lit("q")).withColumn("split", F.lit(None).cast("string")).withColumn("confidence", F.lit(1.0))
    got = {r["ord"]: r["reject_reason"] for r in corpus.manifest(frame, corpus.ManifestRules()).collect()}
    assert got == {"1": None, "2": "duplicate_id", "3": "missing_media", "4": "duplicate_media", "5": "missing_id_or_text", "6": "text_length", "7": "missing_speaker", "8": None}


def test_validation_raises(spark):
    rows = spark.createDataFrame([("a", "raw_scene", "s", 1, 1, 1, 25.0)], "id string, input_type string, roi_spec string, roi_height int, roi_width int, roi_channels int, fps double")
    with pytest.raises(ValueError, match="requires input_type=mouth_roi"):
        gates.validate(rows, gates.mouth_checks())
    assert gates.validate(rows.withColumn("input_type", F.lit("mouth_roi")), gates.mouth_checks()).count() == 1


def test_submissions(spark):
    got = gates.downloads(spark.createDataFrame([(0, "http://a\nhttp://b"), (1, "http://a")], "ord int, value string"))
    assert sorted(r["url"] for r in got.collect()) == ["http://a", "http://b"]
    v, s = spark.createDataFrame([(0, "a,b")], "ord int, value string"), spark.createDataFrame([(0, "x,y,zzz")], "ord int, value string")
    assert gates.renders(v, s, ["x", "y"]).count() == 4


def test_interpolation_and_gaps(spark):
    samples = spark.createDataFrame([(0, 0.0), (2, 2.0)], "frame int, x double").withColumn("v", F.lit(1))
    queries = spark.createDataFrame([(1,), (4,), (2,)], "frame int").withColumn("v", F.lit(1))
    got = {r["frame"]: (r["x"], r["error"]) for r in joins.asof_interpolate(queries, samples, ["v"], "frame", "x", 1).collect()}
    assert got == {1: (1.0, None), 2: (2.0, None), 4: (None, "trailing landmark gap")}


def test_alignment_recovers_times(spark):
    rng = random.Random(7)
    spoken = ["今天我们来聊一聊人工智能的发展趋势", "这个模型在很多任务上表现非常好", "但是训练成本依然是最大的瓶颈问题", "未来几年算力会变得越来越便宜", "所以大家都在关注开源社区的进展", "谢谢各位朋友今天来到我们的节目"]
    chars, at = [], 0.0
    for c in "".join(spoken):
        chars.append((rng.choice("甲乙丙丁") if rng.random() < 0.12 else c, at, at + 0.08))
        at += 0.08
    sentences = [spoken[0], "片头编辑说明文字内容完全不同", *spoken[1:4], "以下部分由编辑整理补充材料", *spoken[4:]]
    frame = spark.createDataFrame([("v", sentences, chars)], "video string, sentences array<string>, chars array<struct<char: string, start: double, end: double>>")
    got = align.aligned_sentences(frame, "video", 6, 0.6).orderBy("sentence").collect()
    assert len(got) >= 5 and not {1, 5} & {r["sentence"] for r in got}
    assert all(a["start"] < b["start"] for a, b in zip(got, got[1:], strict=False))
    assert all(0.03 <= (r["end"] - r["start"]) / len(r["text"]) <= 0.2 for r in got)


def test_anchors_rise(spark):
    a, b = "零一二三四五六七八九甲乙丙丁戊己庚辛壬癸", "零一二三四五六七八九X甲乙丙丁戊己庚辛壬癸"
    grams = lambda t: align.kgrams(spark.createDataFrame([("p", t)], "k string, t string"), "k", "t", 8)
    anchors = align.unique_anchors(grams(a), grams(b), 8, "key")
    chain = align.rising_chains(anchors, "key").orderBy("i").collect()
    assert chain and all(x["i"] < y["i"] and x["j"] < y["j"] for x, y in zip(chain, chain[1:], strict=False))


def test_repair_of_homophones(spark):
    readings = {"我": "wo", "的": "de", "手": "shou", "机": "ji", "收": "shou", "集": "ji", "放": "fang", "在": "zai", "桌": "zhuo", "子": "zi", "上": "shang", "了": "le", "他": "ta", "正": "zheng", "比": "bi", "赛": "sai", "资": "zi", "料": "liao"}
    lines = spark.createDataFrame([("我的手机放在桌子上了",)] * 3 + [("他正在收集比赛的资料",)], "t string")
    lex = Lexicon(readings)
    table = ngram.counts(lines, "t")
    rows = spark.createDataFrame([(lex.read("我的手机放在桌子上了"), ["我的收集放在桌子上了"])], "pinyin array<string>, nbest array<string>")
    assert ngram.repaired(rows, table, lex).first()["refined"] == "我的手机放在桌子上了"


def test_noise_is_repeatable_and_never_empty(spark):
    noise = augment.Noise(clean=0, mild=0)
    near = {"wo": ["wu"], "de": ["da"]}
    said = "wo de shou ji fang zai zhuo zi shang".split()
    rows = spark.createDataFrame([(i, said if i < 300 else ["wo"] if i < 500 else []) for i in range(501)] + [(501, None)], "id long, s array<string>")
    made = rows.withColumn("x", augment.noisy("s", noise, near, 5, "id"))
    got = {r["id"]: r["x"] for r in made.collect()}
    assert got == {r["id"]: r["x"] for r in made.repartition(7).collect()}
    assert all(x["syllables"] for i, x in got.items() if i < 500) and got[500]["severity"] == got[501]["severity"] == "empty" and got[501]["syllables"] == []
    for i in range(300):
        x = got[i]
        ops = x["operations"]
        assert x["severity"] == "severe" and x["edits"] == len(ops) and 2 <= len(ops) <= 4
        assert len(x["syllables"]) == len(said) + ops.count("insert") - ops.count("delete") and x["syllables"].count("<mask>") <= ops.count("mask") + ops.count("insert")
        assert set(x["syllables"]) <= {*said, "wu", "da", "<mask>"}
    seen = [o for i in range(300) for o in got[i]["operations"]]
    assert abs(seen.count("substitute") / len(seen) - 0.45) < 0.07 and set(seen) == set(augment.OPERATIONS)
    assert all(x["operations"][0] in ("substitute", "insert", "mask") for i, x in got.items() if 300 <= i < 500)
    kinds = [r["x"]["severity"] for r in rows.where("id < 300").withColumn("x", augment.noisy("s", augment.Noise(), near, 6, "id")).collect()]
    assert abs(kinds.count("clean") / 300 - 0.25) < 0.1 and abs(kinds.count("mild") / 300 - 0.5) < 0.1
    with pytest.raises(ValueError):
        augment.Noise(clean=0.9, mild=0.5)


def test_homophones_are_substituted_at_their_rate(spark):
    rows = spark.createDataFrame([(i, "手机收集ab") for i in range(400)], "id long, t string")
    got = [r["x"] for r in rows.select(augment.substitute_homophones("t", 0.3, {"shou": ["手", "收"], "ji": ["机", "集"]}, 3, "id").alias("x")).collect()]
    changed = sum(a != b for t in got for a, b in zip(t, "手机收集ab", strict=True))
    assert all(t[4:] == "ab" and t[0] in "手收" for t in got) and abs(changed / 1600 - 0.3) < 0.05


def test_paths_and_scores_match_brute_force(spark):
    from itertools import product

    rng = random.Random(5)
    lines = spark.createDataFrame([("".join(rng.choice("甲乙丙丁戊己") for _ in range(rng.randrange(1, 9))),) for _ in range(60)] + [("abc",), (None,)], "t string")
    table = ngram.counts(lines, "t")
    plain = {}
    for t in (r["t"] for r in lines.collect()):
        marks = ["<s>", *(c for c in t or "" if "一" <= c <= "龥"), "</s>"] if t is not None else []
        for pair in zip(marks, marks[1:], strict=False):
            plain[pair] = plain.get(pair, 0) + 1
    assert {(r["prev"], r["cur"]): r["n"] for r in table.collect()} == plain
    single, row = {}, {}
    for (p, c), n in plain.items():
        single[c], row[p] = single.get(c, 0) + n, row.get(p, 0) + n
    total, v = sum(single.values()), len(set(single) - {"</s>"})

    def logp(p, c):
        uni = (single.get(c, 0) + 0.5) / (total + 0.5 * v)
        bi = (plain.get((p, c), 0) + 0.5) / (row[p] + 0.5 * v) if p in row else uni
        return math.log(0.8 * bi + 0.2 * uni)

    value = lambda t: sum(logp(p, c) for p, c in zip(["<s>", *t], [*t, "</s>"], strict=True))
    model = ngram.Model.from_frame(table)
    for t in ("甲", "甲乙丙", "庚甲", "己己己己"):
        assert abs(model.score(t) - value(t) / len(t)) < 1e-9
    for _ in range(20):
        columns = [rng.sample("甲乙丙丁戊己庚", rng.randrange(1, 4)) for _ in range(rng.randrange(1, 5))]
        bonus = [[rng.choice([0.0, 1.0]) for _ in c] for c in columns]
        got = model.path([np.array([ord(x) for x in c]) for c in columns], [np.array(b) for b in bonus])
        worth = lambda pick: value([c[i] for c, i in zip(columns, pick, strict=True)]) + sum(b[i] for b, i in zip(bonus, pick, strict=True))
        assert abs(worth(got) - max(worth(p) for p in product(*[range(len(c)) for c in columns]))) < 1e-9
    rows = lines.where("t is not null").withColumn("id", F.monotonically_increasing_id())
    near = sorted((r["id"], r["chars"], r["score"]) for r in ngram.scores(rows, "id", "t", table).collect())
    joined = sorted((r["id"], r["chars"], r["score"]) for r in ngram.scores(rows, "id", "t", table, most=3).collect())
    assert near == joined and len(near) == 61 and near[-1][2] == -1e9
    readings = spark.createDataFrame([(c, "x") for c in "甲乙丙庚"] + [("辛", "y"), ("壬", "y")], "unit string, syllable string")
    got = {r["syllable"]: r["units"] for r in ngram.choices(readings, table, 2).collect()}
    assert got == {"x": sorted("甲乙丙", key=lambda c: (-single[c], c))[:2], "y": ["壬", "辛"]}


def test_noisy_messages_expand(spark):
    rows = spark.createDataFrame([("1", "s", "我的手机", "wo de shou ji".split())], "id string, source string, text string, pinyin array<string>")
    got = augment.noisy_messages(rows, 3, augment.Noise(), {}, 1).collect()
    assert len(got) == 3 and all([m["role"] for m in r["messages"]] == ["system", "user", "assistant"] for r in got)
    again = augment.noisy_messages(rows.repartition(3), 3, augment.Noise(), {}, 1).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_instruction_rows(spark):
    hyps = spark.createDataFrame([("a", "我想去银行", ["wo"], [("我想去银航",)]), ("b", "我想去银行", ["wo"], [("今天天气好",)])], "id string, ref string, pinyin array<string>, nbest array<struct<text: string>>")
    got = augment.instruction_rows(hyps, 0.5, 1.0, 4, 1).collect()
    assert len(got) == 1 and got[0]["messages"][-1]["content"] == "我想去银行"


def test_budget_batches_hold_every_row(spark):
    rows = spark.createDataFrame([(i, n) for i, n in enumerate([100, 100, 400, 400])], "id int, n int")
    got = batching.budget_batches(rows, "n", 4, 500, 1, "id").collect()
    assert sorted(r["id"] for r in got) == [0, 1, 2, 3]
    for b in {(r["mega"], r["batch"]) for r in got}:
        group = [r["n"] for r in got if (r["mega"], r["batch"]) == b]
        assert max(group) * len(group) <= 500 or len(group) == 1


def test_weighted_draws(spark):
    rows = spark.createDataFrame([(i, "large" if i < 30 else "small") for i in range(40)], "id int, source string")
    got = batching.weighted_draws(rows, "source", {"large": 0.5, "small": 0.5}, 400, 7, "id").groupBy("source").count().collect()
    assert all(140 <= r["count"] <= 260 for r in got)
    with pytest.raises(ValueError):
        batching.weighted_draws(rows, "source", {"none": 1.0}, 4, 7, "id")


def test_evenly_spaced_keeps_the_last():
    assert batching.evenly_spaced(10, 3)[-1] == 9 and batching.evenly_spaced(3, 5) == [0, 1, 2] and batching.evenly_spaced(9, 1) == [8]


def test_chat_labels(spark):
    rows = spark.createDataFrame([([1, 2, 3], [4, 5])], "p array<int>, a array<int>")
    ids, labels = batching.chat_labels("p", "a", 4)
    assert tuple(rows.select(ids, labels).first()) == ([1, 2, 3, 4], [-100, -100, -100, 4])


def test_task_states(spark):
    rows = [("t", 1, "submit", "n", None, 2), ("t", 2, "claim", "n", None, 0), ("t", 3, "fail", "n", "boom", 0), ("t", 4, "claim", "n", None, 0), ("t", 5, "complete", "other", None, 0), ("t", 6, "complete", "n", None, 0), ("u", 1, "submit", "n", None, 1), ("u", 2, "pause", "n", None, 0)]
    got = {r["task_id"]: r for r in tasks.replay(spark.createDataFrame(rows, "task_id string, seq int, verb string, node string, error string, max_attempts int")).collect()}
    assert (got["t"]["state"], got["t"]["attempts"], got["t"]["error"]) == ("succeeded", 2, "boom") and got["u"]["state"] == "paused"


def test_claim_and_expire(spark):
    rows = spark.createDataFrame([(1, "d", "queued", 1, 5.0, None, 0, 1, None), (2, "d", "queued", 3, 6.0, None, 0, 2, None)], "task_id int, kind string, status string, priority int, created_at double, owner string, attempts int, max_attempts int, lease_until double")
    taken = tasks.claim(rows, tasks.claimable(rows, ["d"]), "n1", 10.0, 5.0)
    assert taken.where("status = 'running'").first()["task_id"] == 2
    assert tasks.expire(taken, 99.0).where("task_id = 2").first()["status"] == "queued"
    assert tasks.heartbeat(taken, spark.createDataFrame([(2, "n1")], "task_id int, node string"), 20.0, 5.0).where("task_id = 2").first()["lease_until"] == 25.0


def test_tracks_do_not_switch(spark):
    rows = []
    for f in range(12):
        left, right = ("v", f, 0, 50.0, 50.0, 40.0, 1.0, 1600.0), ("v", f, 1, 250.0, 50.0, 40.0, 5.0 * (f % 2), 1600.0)
        rows += [left, right] if f % 2 else [("v", f, 0, *right[3:]), ("v", f, 1, *left[3:])]
    frame = spark.createDataFrame(rows, "video string, frame int, face int, x double, y double, extent double, opening double, area double")
    tracked = faces.associate(frame)
    assert tracked.groupBy("track").agg(F.countDistinct("x").alias("n")).where("n <> 1").count() == 0
    scores = faces.track_scores(tracked, 12, 300, 100)
    best = faces.selected(scores).first()
    assert scores.where(F.col("track") == best["track"]).first()["motion_score"] == 1.0 and best["margin"] > 0


def test_anchor_box_ignores_missing_points(spark):
    nan = float("nan")
    rows = spark.createDataFrame([([[1.0, 2.0], [nan, nan], [3.0, 8.0]],)], "p array<array<double>>")
    assert tuple(rows.select(faces.anchor_box("p", [0, 1, 2]).alias("b")).first()["b"]) == (1.0, 2.0, 3.0, 8.0)


def test_matching_beats_greedy():
    assert cluster.best_matching([(0, 0, 31), (0, 1, 22), (1, 0, 459), (1, 1, 19)]) == {0: 1, 1: 0}


def test_pitch_clusters_rise(spark):
    rows = spark.createDataFrame([(i, 100.0 + i) for i in range(10)] + [(20 + i, 220.0 + i) for i in range(10)] + [(50, 0.0)], "t int, f0 double")
    got = {r["t"]: r["cluster"] for r in cluster.pitch_clusters(rows, "f0", 2, 1).collect()}
    assert {got[i] for i in range(10)} == {0} and {got[20 + i] for i in range(10)} == {1} and got[50] == -1


def test_speaker_segments(spark):
    f = spark.createDataFrame([("v", i, 0 if i < 50 else 1) for i in range(100)], "video string, frame int, face int")
    v = spark.createDataFrame([("v", i, 1 if i < 20 else 0) for i in range(40)], "video string, hop int, voice int")
    segments, share = corpus.speaker_segments(f, v, 0.1, 25.0, 3)
    assert share > 0.9 and segments.where("is_speaker").count() >= 2


def test_speaker_segments_refuse_too_many_meetings(spark, monkeypatch):
    monkeypatch.setattr(corpus, "MOST_MEETINGS", 2, raising=False)
    f = spark.createDataFrame([("v", i, i // 25) for i in range(100)], "video string, frame int, face int")
    v = spark.createDataFrame([("v", i, 0) for i in range(40)], "video string, hop int, voice int")
    with pytest.raises(ValueError, match="over 2 pairs"):
        corpus.speaker_segments(f, v, 0.1, 25.0, 3)


def test_cue_samples(spark):
    cues = spark.createDataFrame([("v", 1, 0.0, 1.0, "t", 5), ("v", 2, 2.0, 2.05, "t", 5), ("v", 3, 3.0, 4.0, "t", 5)], "video string, cue int, start double, end double, text string, units int")
    frames = spark.createDataFrame([("v", i, i < 60, True) for i in range(120)], "video string, frame int, has_face boolean, speaking boolean")
    got = {r["cue"]: r["reject_reason"] for r in corpus.cue_samples(cues, frames, 25.0, 0.0, 0.0, 119, 8, 0.8, 0.5, (2, 30)).collect()}
    assert got == {1: None, 2: "min_frames", 3: "face_coverage"}


def test_curve_peak(spark):
    a = spark.createDataFrame([("k", i, float((i * 7) % 11)) for i in range(60)], "k string, at int, v double")
    b = a.withColumn("at", F.col("at") + 3)
    got = signals.curve_peak(signals.correlation_curve(a, b, ["k"], "at", "v", 5), ["k"]).first()
    assert got["lag"] == 3 and got["score"] > got["runner_up"]


def test_similar_pairs_by_vector_and_by_name(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)], rng.choice([None, "x", "y"])) for i in range(60)]
    frame = spark.createDataFrame(rows, "k int, v array<double>, name string")
    value = lambda a, b: sum(p * q for p, q in zip(rows[a][1], rows[b][1], strict=True))
    pairs = [(a, b) for a in range(60) for b in range(a + 1, 60)]
    named = lambda a, b: rows[a][2] == rows[b][2] if rows[a][2] and rows[b][2] else value(a, b) >= 3
    assert sorted((r["a"], r["b"]) for r in cluster.similar_pairs(frame, "k", "v", 3.0).collect()) == [p for p in pairs if value(*p) >= 3]
    assert sorted((r["a"], r["b"]) for r in cluster.similar_pairs(frame, "k", "v", 3.0, explicit="name").collect()) == [p for p in pairs if named(*p)]


def test_gates_on_subtitles_and_tracks(spark):
    timing = spark.createDataFrame([("a", 60, 0.9, 0.01), ("b", 10, 0.5, 0.2), ("c", 60, None, None)], "v string, n long, in_range double, overlap double")
    assert [r["x"] for r in timing.select(gates.subtitle_reasons().alias("x")).collect()] == [[], ["few_cues", "rate_out_of_range", "overlap"], ["rate_out_of_range"]]
    tracks = spark.createDataFrame(
        [("ok", 0, 0.95, 60.0, 0.05, 1.0, 0.96), ("ok", 1, 0.01, 9.0, 9.0, 9.0, 0.96), ("two", 0, 0.5, 40.0, 0.3, 9.0, 0.6), ("two", 1, 0.6, 60.0, 0.05, 1.0, 0.6), ("none", 0, 0.01, 1.0, 1.0, 1.0, 0.01)],
        "video string, track int, coverage double, lip_width double, yaw_mean double, jitter double, face_coverage double",
    )
    got = {r["video"]: r for r in gates.track_reasons(tracks).collect()}
    assert got["ok"]["reasons"] == [] and got["ok"]["main"] == 0 and got["two"]["main"] == 1
    assert got["two"]["reasons"] == ["tracks", "main_coverage", "face_coverage"] and got["none"]["reasons"] == ["no_stable_track"]


def test_long_alignments_cost_the_least(monkeypatch):
    from sparrowmill.functions import edits

    rng = random.Random(2)
    a = [rng.choice("abcd") for _ in range(300)]
    b = [x for x in a if rng.random() < 0.9] + [rng.choice("abcd") for _ in range(40)]
    want = int(edits.distance_table(a, b)[-1, -1])
    monkeypatch.setattr(edits, "TABLE_CELLS", 200)
    pairs = edits.long_trace(a, b)
    assert sum(i is None or j is None or a[i] != b[j] for i, j in pairs) == want
    assert [i for i, _ in pairs if i is not None] == list(range(300)) and [j for _, j in pairs if j is not None] == list(range(len(b)))


def test_rejected_sentences_are_told(spark):
    frame = spark.createDataFrame([("v", ["abcdefghijkl", "xyzxyzxyz", ""], [(c, float(i), i + 1.0) for i, c in enumerate("abcdefghijkl")])], "video string, sentences array<string>, chars array<struct<char: string, start: double, end: double>>")
    got = align.sentence_matches(frame, "video").orderBy("sentence").collect()
    assert [(r["reject_reason"], round(r["match_rate"], 2), r["start"]) for r in got] == [(None, 1.0, 0.0), ("low_match", 0.0, None), ("low_match", 0.0, None)]


def test_numbers_timing_and_bits_without_windows_over_all(spark):
    from sparrowmill.operators import profile
    from sparrowmill.plans.storage import numbered

    rng = random.Random(3)
    rows = spark.createDataFrame([(i,) for i in rng.sample(range(10_000), 500)], "n int").repartition(7)
    got = [r["at"] for r in numbered(rows, "at", "n").orderBy("n").collect()]
    assert got == list(range(500)) and numbered(rows.where("n < 0"), "at", "n").count() == 0
    cues = spark.createDataFrame([(float(i), i + rng.random(), 5) for i in range(200)], "start double, end double, units int")
    assert tuple(profile.timing_profile(cues).first()) == tuple(profile.timing_profile(cues.withColumn("k", F.lit(1)), "k").drop("k").first())
    vectors = spark.createDataFrame([([1.0, 2.0, 3.0],), ([5.0],), ([],), (None,), ([float(i % 5) for i in range(9)],)], "v array<double>")

    def plain(v):
        bits = (np.asarray(v) > np.median(v)).astype(int) if v else []
        return f"{int('0' + ''.join(map(str, bits)), 2):0{max(1, -(-len(v) // 4))}x}"

    assert [r["b"] for r in vectors.select(cluster.median_bits("v").alias("b")).collect()] == [plain(v) for v in ([1.0, 2.0, 3.0], [5.0], [], [], [float(i % 5) for i in range(9)])]


def test_tracks_match_a_plain_greedy_reading(spark):
    """Frame by frame, the cheapest pairs first; as written down for one video at a time."""
    rng = random.Random(11)
    rows = [(v, f, i, 100.0 * i + rng.uniform(-60, 60), rng.uniform(0, 80), rng.uniform(20, 60)) for v in range(3) for f in range(40) if f % 9 for i in range(rng.randrange(0, 4))]
    got = {(r["video"], r["frame"], r["face"]): r["track"] for r in faces.associate(spark.createDataFrame(rows, "video int, frame long, face int, x double, y double, extent double")).collect()}
    for v in range(3):
        last, count = {}, 0
        for f in range(40):
            new = sorted(r for r in rows if r[:2] == (v, f))
            prices = []
            for t, o in last.items():
                for n, r in enumerate(new):
                    if f - o[1] <= 5:
                        size = max((o[5] + r[5]) / 2, 1.0)
                        prices.append((math.dist(o[3:5], r[3:5]) / size + 0.4 * abs(math.log(r[5] / o[5])) + 0.03 * (f - o[1] - 1), t, n))
            pairs = {}
            for price, t, n in sorted(prices):
                if price <= 2 and n not in pairs and t not in pairs.values():
                    pairs[n] = t
            for n, r in enumerate(new):
                if n not in pairs:
                    pairs[n], count = count, count + 1
                last[pairs[n]] = r
                assert got[r[:3]] == pairs[n]


@pytest.mark.parametrize("finish", [0, 20, 20_000])
def test_two_keys_match_a_plain_reading(spark, monkeypatch, finish):
    """Random rows, an alternating chain and null keys, by rounds alone, by both and by one task alone."""
    rng = random.Random(9)
    rows = [(i, rng.choice([None, *range(25)]), rng.choice([None, *range(30)])) for i in range(300)]
    rows += [(1000 + i, 100 + i // 2, 200 + (i + 1) // 2) for i in range(12)]
    rng.shuffle(rows)
    seen, want = (set(), set()), {}
    for o, a, b in sorted(rows):
        want[o] = "duplicate_a" if a in seen[0] else "duplicate_b" if b in seen[1] else None
        if want[o] is None:
            seen[0].add(a)
            seen[1].add(b)
    monkeypatch.setattr(dedup, "FINISH", finish)
    got = dedup.greedy_two_keys(spark.createDataFrame(rows, "o int, a int, b int"), "o", "a", "b").collect()
    assert {r["o"]: r["reject_reason"] for r in got} == want and len(got) == len(rows)
