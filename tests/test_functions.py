import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparrowmill.functions import edits, hashing, lexicon, text
from sparrowmill.sources.texts import config

READINGS = {"我": "wo", "想": "xiang", "去": "qu", "行": "xing", "银": "yin", "银行": "yin hang", "办": "ban", "一": "yi", "张": "zhang", "卡": "ka", "手": "shou", "机": "ji", "收": "shou", "集": "ji", "放": "fang", "在": "zai", "桌": "zhuo", "子": "zi", "上": "shang", "了": "le", "的": "de"}


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"] if values else spark.range(1).select(column.alias("x")).first()["x"]


def test_edit_operations_of_a_substitution():
    assert edits.operations("我想去银行", "我想去银航") == (1, 0, 0)


@settings(max_examples=60, deadline=None)
@given(st.text("abc", max_size=9), st.text("abc", max_size=9))
def test_edit_totals_match_plain_recursion(a, b):
    def plain(i, j, memo={}):
        key = (a[:i], b[:j])
        if key not in memo:
            memo[key] = max(i, j) if not (i and j) else min(plain(i - 1, j) + 1, plain(i, j - 1) + 1, plain(i - 1, j - 1) + (a[i - 1] != b[j - 1]))
        return memo[key]

    s, d, i = edits.operations(a, b)
    assert s + d + i == plain(len(a), len(b)) and i - d == len(b) - len(a)


def test_increasing_chain_is_longest():
    rng = random.Random(4)
    pairs = [(i, v) for i, v in enumerate(rng.sample(range(40), 40))]
    chain = edits.increasing_chain(pairs)
    best = [1] * 40
    for i in range(40):
        best[i] = max([1, *(best[j] + 1 for j in range(i) if pairs[j][1] < pairs[i][1])])
    assert len(chain) == max(best) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(chain, chain[1:], strict=False))


def test_answers_are_parsed(spark):
    assert one(spark, text.last_answer(F.lit("修正后的句子：我想去银行。"))) == "我想去银行"
    assert one(spark, text.last_answer(F.lit("好的\n我想去银行"))) == "我想去银行"
    assert one(spark, text.last_answer(F.lit(None).cast("string"))) == ""


def test_guard_falls_back_to_the_first_candidate(spark):
    s, c = F.array(*map(F.lit, "wo xiang qu yin hang".split())), F.array(F.lit("我想去银航"), F.lit("我想去"))
    assert one(spark, text.guarded_answer(F.lit("我想去银行"), s, c)) == "我想去银行"
    assert one(spark, text.guarded_answer(F.lit("我想去银行办一张新的卡"), s, c)) == "我想去银航"
    assert one(spark, text.guarded_answer(F.lit("no"), s, c)) == "我想去银航"


def test_phrases_decide_between_readings(spark):
    lex = lexicon.Lexicon(READINGS)
    got = one(spark, lexicon.to_syllables(F.col("t"), lex), t="我想去银行办一张卡")
    assert len(got["chars"]) == len(got["syllables"]) == 9 and got["syllables"][3:5] == ["yin", "hang"]
    assert lex.read("行") == ["xing"] and lex.read("龙") == [text.UNKNOWN_SYLLABLE]


def test_mixed_tokens(spark):
    lex = lexicon.Lexicon({c: "x" for c in "用的方式去管理而不是我们都写在里了"})
    got = one(spark, lexicon.to_mixed_syllables(F.col("t"), lex), t="用RL的方式去管理，而不是用SFT")
    assert got["tokens"][1] == "RL" and got["syllables"][1:5] == ["a", "er", "ai", "er"] and not got["unknown"]
    assert one(spark, lexicon.to_mixed_syllables(F.col("t"), lex), t="我们都写在paper里写了")["syllables"][5:7] == ["pei", "po"]


@pytest.mark.parametrize(
    ("token", "said", "hit"),
    [("RL", "a er ai er", True), ("x", "ai ke si", True), ("paper", "pei po", True), ("2024", "er ling er si", True), ("ab-cd", "ei bi xi di", False), ("GPT-4", "ji pi ti si", True), ("don't", "di ou en ti", False), ("-the-", "ze", True)],
)
def test_latin_readings(spark, token, said, hit):
    got = one(spark, lexicon.latin_reading(F.col("t")), t=token)
    assert (" ".join(got["syllables"]), got["hit"]) == (said, hit)


def test_repeats_and_collapse(spark):
    row = spark.sql("select array('a','a','b','b','b') r, array('a') one, cast(array() as array<string>) none, array(0,1,1,0,1,2,2) p")
    got = row.select(text.adjacent_repeats("r"), text.adjacent_repeats("one"), text.adjacent_repeats("none"), text.collapse_path("p")).first()
    assert tuple(got) == (3, 0, 0, [1, 1, 2])


def test_splits_are_those_of_plain_sha1(spark):
    import hashlib

    keys = [f"k{i}" for i in range(50)]
    place = lambda k: int(hashlib.sha1(f"7:{k}".encode()).hexdigest()[:8], 16) % 100
    want = ["test" if place(k) < 20 else "dev" if place(k) < 50 else "train" for k in keys]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select(hashing.split_label("k", 30, 20, 7)).collect()
    assert [r[0] for r in got] == want


def test_sentences_and_classes(spark):
    assert one(spark, text.sentences(F.lit("今天天气很好。我们出去散步！ok"))) == ["今天天气很好", "我们出去散步"]
    assert one(spark, text.spoken_sentences(F.lit("你好（笑）。“再见”！"))) == ["你好", "再见"]
    assert one(spark, text.is_han(F.lit("银"))) and not one(spark, text.is_han(F.lit("ab")))


def test_config_refuses_unknown_keys():
    from sparrowmill.plans.corpus import TextRules

    assert config(TextRules, {"least": 3}, ["most=9"]).most == 9
    with pytest.raises(KeyError):
        config(TextRules, {"lest": 3})


def test_confusions_share_a_part_or_are_all_others(spark):
    rows = spark.createDataFrame([("ma",), ("mi",), ("ta",), ("o",)], "syllable string")
    got = {(r["syllable"], r["near"]) for r in lexicon.confusions(rows).collect()}
    assert got == {("ma", "mi"), ("mi", "ma"), ("ma", "ta"), ("ta", "ma"), ("o", "ma"), ("o", "mi"), ("o", "ta")}
