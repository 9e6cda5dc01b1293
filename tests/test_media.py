import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowmill.operators import media


def test_specs(spark):
    assert media.spec("syncnet", size=112).size == 112 and media.spec_table(spark).count() == 5
    with pytest.raises(KeyError):
        media.spec("nothing")
    assert media.mean_face(97)[2] == (48.0, 0.188 * 96)


def test_grid_hash_and_descriptor():
    picture = np.zeros((16, 16))
    picture[:2, :2] = 9
    assert media.grid_hash(picture) == "0000000000000001"
    rng = np.random.default_rng(1)
    d = media.spectral_descriptor([rng.random((20, 20)) for _ in range(3)])
    assert d.shape == (64,) and abs(np.linalg.norm(d) - 1) < 1e-5 and not media.spectral_descriptor([]).any()


def test_clip_hashes_and_spectra(spark):
    rng = np.random.default_rng(3)
    rows = [(f"p{i}", "s", 4, 16, 16, bytearray(rng.integers(0, 255, 4 * 256, dtype=np.uint8).tobytes())) for i in range(3)] + [("e", "t", 0, 16, 16, bytearray())]
    clips = spark.createDataFrame(rows, "path string, source string, frames int, height int, width int, pixels binary")
    assert {r["path"]: r["hash"] for r in media.clip_hash(clips).collect()}["e"] == "empty"
    assert {r["source"]: len(r["descriptor"]) for r in media.source_spectra(clips, "source").collect()} == {"s": 64, "t": 64}


def test_pitch_of_a_tone():
    t = np.arange(16000) / 16000
    f0 = media.pitches(0.5 * np.sin(2 * np.pi * 160 * t), 16000)
    assert len(f0) and abs(np.median(f0) - 160) < 3 and not media.pitches(np.zeros(16000), 16000).any()


def test_band_keeps_its_frequencies():
    t = np.arange(250) / 25
    got = media.band(np.sin(2 * np.pi * 4 * t) + 5 + np.sin(2 * np.pi * 11 * t), 2, 8, 25)
    assert np.abs(got - np.sin(2 * np.pi * 4 * t)).max() < 1e-6


def brute_beams(logp):
    """Scores of all label sequences, summed over all paths."""
    from itertools import product

    total = {}
    for path in product(range(logp.shape[1]), repeat=len(logp)):
        ids = tuple(x for i, x in enumerate(path) if x and (i == 0 or path[i - 1] != x))
        total[ids] = np.logaddexp(total.get(ids, -np.inf), sum(logp[i, x] for i, x in enumerate(path)))
    return total


def test_beams_match_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(5):
        x = rng.standard_normal((5, 3))
        x = x - np.logaddexp.reduce(x, axis=1, keepdims=True)
        want = brute_beams(x)
        for ids, score in media.beams(x, width=200, most=9):
            assert abs(want[tuple(ids)] - score) < 1e-9
        assert tuple(media.beams(x, width=200)[0][0]) == max((k for k in want if k), key=want.get)


def test_columns(spark):
    row = spark.createDataFrame([([[0.1, 3.0], [2.0, 0.0]], [0.0, 0.0], 10)], "l array<array<double>>, a array<double>, s int")
    got = row.select(media.beam_search("l", most=1).alias("b"), media.log_sum("a").alias("z"), media.inverse_root_rate("s", 1.0, 40).alias("r"), media.cosine_factor("s", 10, 0.1).alias("c")).first()
    assert got["b"][0]["ids"] == [1] and abs(got["z"] - math.log(2)) < 1e-9 and got["r"] == 0.25 and abs(got["c"]) < 1e-9
    assert media.head_weights(0.25) == (0.25, 0.75) and media.use_head("auto", False, "x") is False
    with pytest.raises(ValueError):
        media.use_head("on", False, "x")


def test_landmarks(spark):
    good = [[0.5, 0.25]] * 98
    rows = spark.createDataFrame([("v", 0, good, 100, 200, 25.0, 2), ("v", 1, good[:5], 100, 200, 25.0, 2), ("w", 0, good, 100, 200, 25.0, 3)], "video string, frame int, points array<array<double>>, width int, height int, fps double, n_total int")
    got = media.pixel_landmarks(rows).orderBy("video", "frame").collect()
    assert got[0]["points"][3] == [50.0, 50.0] and got[1]["reject_reason"] == "landmark_shape"
    assert [r["video"] for r in media.frame_mismatch(rows).collect()] == ["w"]
    assert rows.where("frame = 0").select(media.five_points("points", 98).alias("p")).first()["p"] == [[0.5, 0.25]] * 5
    assert rows.limit(1).select(media.crop_box("points", [0, 1], media.spec("syncnet")).alias("b")).first()["b"]["side"] == 2 * 1.4 * 4


def test_model_seam_and_captured_errors(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 0)], "k string, n int")
    assert sorted(r["u"] for r in media.with_model(rows, lambda: lambda xs: [x.upper() for x in xs], "k", "u").collect()) == ["A", "B"]
    got = {r["k"]: r for r in media.attempted(rows, lambda r: {"q": 10 // r["n"]}, "q int", "k").collect()}
    assert got["a"]["q"] == 10 and "ZeroDivisionError" in got["b"]["error"]


def test_command_line(spark, data, tmp_path, capsys):
    from sparrowmill.__main__ import main

    assert main(["queries"]) == 0 and "corpus_build" in capsys.readouterr().out
    main(["run", "corpus_build", "--tables", data, "--out", str(tmp_path / "o")])
    assert spark.read.parquet(str(tmp_path / "o")).count() > 0
    (tmp_path / "d.txt").write_text("今天天气很好。我们出去散步。\n今天天气很好。我的手机在桌上。\n")
    (tmp_path / "h.txt").write_text("我的手机在桌上\n")
    main(["build-text", "--docs", str(tmp_path / "d.txt"), "--held-out", str(tmp_path / "h.txt"), "--out", str(tmp_path / "t")])
    assert spark.read.json(str(tmp_path / "t/rows")).count() == 2
    (tmp_path / "rows.jsonl").write_text(json.dumps({"id": "1", "source": "s", "text": "我", "pinyin": ["wo"]}) + "\n")
    main(["materialize", "--rows", str(tmp_path / "rows.jsonl"), "--out", str(tmp_path / "m")])
    assert spark.read.json(str(tmp_path / "m")).count() == 3
    (tmp_path / "hyps.jsonl").write_text(json.dumps({"id": "1", "ref": "我想去银行", "pinyin": ["wo"], "nbest": [{"text": "我想去银航"}]}) + "\n")
    main(["build-instructions", "--hyps", str(tmp_path / "hyps.jsonl"), "--out", str(tmp_path / "i")])
    assert spark.read.json(str(tmp_path / "i")).count() == 1 and F is not None


def test_crops_flips_masks_and_norms(spark):
    rows = spark.createDataFrame([(i, [float(v) for v in range(48)]) for i in range(60)], "id long, p array<double>")
    middle = rows.select(media.cropped("p", F.lit(8), media.crop_place(4, F.lit(6), F.lit(8)), 4).alias("c")).first()["c"]
    assert middle == [float((1 + r) * 8 + 2 + c) for r in range(4) for c in range(4)]
    place = media.crop_place(4, F.lit(6), F.lit(8), True, 3, "id")
    got = rows.select("id", place.alias("at"), media.cropped("p", F.lit(8), place, 4).alias("c")).collect()
    assert {r["at"]["top"] for r in got} == {0, 1, 2} and {r["at"]["left"] for r in got} == {0, 1, 2, 3, 4} and {r["at"]["flip"] for r in got} == {True, False}
    for r in got:
        want = np.arange(48.0).reshape(6, 8)[r["at"]["top"] : r["at"]["top"] + 4, r["at"]["left"] : r["at"]["left"] + 4]
        assert r["c"] == (want[:, ::-1] if r["at"]["flip"] else want).ravel().tolist()
    assert np.allclose(rows.select(media.normalised("p").alias("n")).first()["n"], (np.arange(48) / 255 - 0.421) / 0.165)
    clip = spark.createDataFrame([(i, [[1.0, 2.0]] * (20 if i else 8)) for i in range(50)], "id long, c array<array<double>>")
    for r in clip.select("id", media.time_masked("c", 4, 1, "id").alias("m")).collect():
        gone = [i for i, f in enumerate(r["m"]) if f == [0.0, 0.0]]
        assert len(gone) <= (4 if r["id"] else 0) and gone == list(range(gone[0], gone[-1] + 1) if gone else [])


def test_rendered_regions(spark):
    picture = np.zeros((40, 60, 3), np.uint8)
    picture[10:20, 20:30] = (10, 200, 30)
    points = [[20.0, 10.0], [30.0, 20.0], [25.0, 15.0]]
    frames = spark.createDataFrame([("v", 0, 40, 60, 3, bytearray(picture.tobytes()), points), ("v", 1, 40, 60, 3, bytearray(picture.tobytes()), [])], "video string, frame long, height int, width int, channels int, pixels binary, points array<array<double>>")
    spec = media.spec("mouth", size=10, scale=1.0, color="rgb")
    got = media.rendered(frames, spec, [0, 1, 2], 3).orderBy("frame").collect()
    whole = np.frombuffer(got[0]["pixels"], np.uint8).reshape(10, 10, 3)
    assert (whole == (30, 200, 10)).all() and got[1]["error"] == "missing landmarks"
    gray = media.in_color(picture, "gray")
    assert gray[12, 22] == round(0.114 * 10 + 0.587 * 200 + 0.299 * 30) and (media.window(gray, 0, 0, 20, 20)[:9, :9] == 110).all()
    # A turned and scaled face comes back to the mean face.
    five = np.array(media.mean_face(96))
    turn = np.array([[0.6, -0.8], [0.8, 0.6]]) * 1.7
    assert np.allclose(media.similarity(five @ turn.T + [5, 9], five) @ np.append(five[2] @ turn.T + [5, 9], 1), five[2])
    ramp = np.tile(np.arange(200, dtype=np.uint8), (200, 1))
    out = media.aligned(ramp, five + [60, 90], 96)
    assert abs(int(out[50, 40]) - 100) <= 1 and media.probe_crop(ramp, np.array([[2.0, 100.0], [12.0, 104.0]]), 16).shape == (16, 16)
    with pytest.raises(ValueError):
        media.similarity(np.zeros((5, 2)), five)


def test_programs_are_run_for_rows(spark):
    import sys

    code = "import sys; sys.stdout.buffer.write(bytes([0, 64, 0, 192])) if sys.argv[1] == 'a' else sys.exit('bad ' + sys.argv[1])"
    rows = spark.createDataFrame([("a", [sys.executable, "-c", code, "a"]), ("b; rm", [sys.executable, "-c", code, "b; rm"]), ("c", ["/no/such/program"]), ("d", None)], "k string, argv array<string>")
    got = {r["k"]: r for r in media.commanded(rows, "k", "argv").withColumn("wave", media.samples("out")).collect()}
    assert got["a"]["status"] == 0 and got["a"]["wave"] == [0.5, -0.5] and got["a"]["error"] is None
    assert got["b; rm"]["status"] == 1 and "bad b; rm" in got["b; rm"]["error"] and got["c"]["status"] is None and "no/such" in got["c"]["error"] and got["d"]["error"]


def test_models_answers_are_guarded(spark):
    from sparrowmill.operators import ngram

    rows = spark.createDataFrame([("a", ["wo", "hao"], ["我号"]), ("b", ["wo"], ["我"])], "id string, pinyin array<string>, nbest array<string>")
    got = {r["id"]: r["refined"] for r in ngram.refined_by_model(rows, lambda: lambda prompts: ["修正：我好" if "我号" in p else "这一句太长了" for p in prompts]).collect()}
    assert got == {"a": "我好", "b": "我"}


def test_command_lines_are_quoted(spark):
    import shlex

    from sparrowmill.functions import text

    row = spark.createDataFrame([("it's $x; y", 8, None)], "a string, b int, c string")
    line = row.select(text.command_line("train", data="a", rank="b", out="c").alias("l")).first()["l"]
    assert shlex.split(line) == ["train", "--data", "it's $x; y", "--rank", "8"]


def test_command_line_builds_decodes_and_refines(spark, tmp_path, capsys):
    from sparrowmill.__main__ import main

    (tmp_path / "s.txt").write_text("今天天气很好\n我的手机\n")
    main(["synth", "--sentences", str(tmp_path / "s.txt"), "--out", str(tmp_path / "synth"), "--speakers", "3"])
    assert spark.read.json(str(tmp_path / "synth")).count() == 6
    (tmp_path / "v.json").write_text(json.dumps(["<blank>", "<sos/eos>", "<unk>", "我", "好"]))
    (tmp_path / "l.jsonl").write_text(json.dumps({"id": "1", "logits": [[0, 0, 0, 9, 0], [9, 0, 0, 0, 0], [0, 0, 0, 0, 9]]}) + "\n")
    main(["decode", "--logits", str(tmp_path / "l.jsonl"), "--vocabulary", str(tmp_path / "v.json"), "--out", str(tmp_path / "d")])
    assert spark.read.json(str(tmp_path / "d")).first()["nbest"][0]["text"] == "我好"
    (tmp_path / "h.jsonl").write_text(json.dumps({"id": "1", "ref": "我的手机", "pinyin": ["wo", "de", "shou", "ji"], "nbest": [{"text": "我的收集"}]}) + "\n")
    (tmp_path / "r.jsonl").write_text("\n".join(json.dumps({"unit": u, "syllables": s}) for u, s in {"我": "wo", "的": "de", "手": "shou", "机": "ji", "收": "shou", "集": "ji"}.items()))
    main(["refine", "--hyps", str(tmp_path / "h.jsonl"), "--lm-texts", str(tmp_path / "s.txt"), "--readings", str(tmp_path / "r.jsonl"), "--out", str(tmp_path / "o")])
    assert spark.read.json(str(tmp_path / "o/rows")).first()["refined"] == "我的手机" and "| 0.5 | 0 |" in capsys.readouterr().out
