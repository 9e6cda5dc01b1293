"""Graphemes to syllables. The lexicon is a table (unit, syllables) supplied by the caller: single
characters and phrases; the longest phrase wins, so context decides between readings."""

from __future__ import annotations

import re
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import HAN, LATIN_TOKEN, MIXED_TOKEN, UNKNOWN_SYLLABLE, ColumnLike, column, tokens

# Spoken readings of letters, digits and loan words.
LETTERS = {
    "a": "ei", "b": "bi", "c": "xi", "d": "di", "e": "yi", "f": "ai fu", "g": "ji", "h": "ei chi", "i": "ai", "j": "jie", "k": "kei", "l": "ai er", "m": "ai mu",
    "n": "en", "o": "ou", "p": "pi", "q": "kiu", "r": "a er", "s": "ai si", "t": "ti", "u": "you", "v": "wei", "w": "da bu liu", "x": "ai ke si", "y": "wai", "z": "zei",
}
DIGITS = {"0": "ling", "1": "yi", "2": "er", "3": "san", "4": "si", "5": "wu", "6": "liu", "7": "qi", "8": "ba", "9": "jiu"}
LOAN_WORDS = {
    "agent": "ei zhen te", "agentic": "ei zhen ti ke", "attention": "a ten shen", "benchmark": "ben qi ma ke", "chat": "qia te", "coding": "kou ding",
    "context": "kang tai ke si te", "copilot": "ke pai luo te", "encoder": "yin kou de", "decoder": "di kou de", "embedding": "yin bei ding", "epoch": "yi pa ke",
    "loss": "luo si", "model": "mo dou", "paper": "pei po", "prompt": "pu lang pu te", "scaling": "si kei ling", "token": "tou ken", "tokens": "tou ken si",
    "transformer": "chuan si fu mo", "open": "ou pen", "review": "ri wei you", "case": "kei si", "test": "tai si te", "training": "chuei ning", "reward": "ri wo de",
    "hack": "hei ke", "bet": "bei te", "know": "nou", "how": "hao", "search": "se qi", "logit": "luo ji te", "clipping": "ke li ping", "efficiency": "yi fei shen xi",
    "innovation": "yin nuo wei shen", "infinity": "yin fei ni ti", "beginning": "bi gin ning", "the": "ze", "of": "ao fu", "vat": "wa te", "brain": "bu lei en", "in": "yin",
    "pass": "pa si", "time": "tai mu", "system": "xi si tan", "engineering": "en ji ni ling", "optimizer": "ao pu ti mai ze", "adam": "ya dang", "muon": "miu ang",
    "dependency": "di pen den xi",
}
INITIALS = ("zh", "ch", "sh", "b", "p", "m", "f", "d", "t", "n", "l", "g", "k", "h", "j", "q", "x", "r", "z", "c", "s", "y", "w")


def _readings(table: dict[str, str]) -> Column:
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.split(F.lit(v), " "))])


def spell(token: ColumnLike) -> Column:
    """Letter and digit readings of a token, one after another."""
    known = F.filter(F.split(F.lower(column(token)), ""), lambda c: c.rlike("^[a-z0-9]$"))
    return F.flatten(F.transform(known, lambda c: F.element_at(_readings(LETTERS | DIGITS), c)))


def is_acronym(token: ColumnLike) -> Column:
    """One letter, or at most five letters, all capitals."""
    letters = F.regexp_replace(column(token), "[^A-Za-z]", "")
    return (F.length(letters) == 1) | ((F.length(letters) <= 5) & (letters != "") & (letters == F.upper(letters)))


def latin_reading(token: ColumnLike) -> Column:
    """struct(syllables, hit): digits by digit, acronyms by letter, loan words by table; else spelt, no hit."""
    t = column(token)
    key = F.lower(F.regexp_replace(t, r"^[-']+|[-']+$", ""))
    word = F.element_at(_readings(LOAN_WORDS), key)
    plain = t.rlike(r"^\d+$") | is_acronym(t)
    return F.struct(F.when(plain, spell(t)).otherwise(F.coalesce(word, spell(t))).alias("syllables"), (plain | word.isNotNull()).alias("hit"))


def loan_coverage(found: DataFrame, token: str = "token", *keys: str) -> DataFrame:
    """(keys, hit_rate, unknown): the share of tokens that can be read, and how many distinct ones cannot.

    Tokens are counted first, so each distinct token of a key is looked up once.
    """
    counts = found.groupBy(*keys, token).agg(F.count("*").alias("__n")).withColumn("__hit", latin_reading(token)["hit"])
    rate = F.sum(F.when(F.col("__hit"), F.col("__n")).otherwise(0)) / F.sum("__n")
    return counts.groupBy(*keys).agg(rate.alias("hit_rate"), F.count_if(~F.col("__hit")).alias("unknown"))


def unknown_tokens(found: DataFrame, order: str, token: str = "token", k: int | None = None) -> DataFrame:
    """(token, n, first): tokens that cannot be read, the most frequent ones first, then by first
    place; with ``k``, the first k of them (a distributed top-k)."""
    counts = found.groupBy(token).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    out = counts.where(~latin_reading(token)["hit"])
    return out if k is None else out.orderBy(F.desc("n"), "first").limit(k)


def syllable_parts(syllable: ColumnLike) -> Column:
    """struct(initial, final); two-letter initials before one-letter ones."""
    pattern = f"^({'|'.join(INITIALS)})?(.*)$"
    return F.struct(F.regexp_extract(column(syllable), pattern, 1).alias("initial"), F.regexp_extract(column(syllable), pattern, 2).alias("final"))


class Lexicon:
    """Readings of characters and phrases, small enough to go with the tasks (its caller's table)."""

    def __init__(self, readings: Mapping[str, str]):
        self.readings = {k: tuple(v.split()) for k, v in readings.items()}
        self.longest = max(map(len, self.readings), default=1)

    @classmethod
    def from_frame(cls, table: DataFrame, limit: int = 500_000) -> Lexicon:
        """From (unit, syllables as text); a table of over ``limit`` rows is refused."""
        rows = table.select("unit", "syllables").limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError(f"the lexicon has over {limit} rows")
        return cls({r["unit"]: r["syllables"] for r in rows})

    def read(self, text: str) -> list[str]:
        """One syllable for each character, longest phrase first."""
        out, at = [], 0
        while at < len(text):
            for size in range(min(self.longest, len(text) - at), 0, -1):
                found = self.readings.get(text[at : at + size])
                if found and len(found) == size:
                    out += found
                    at += size
                    break
            else:
                out.append(UNKNOWN_SYLLABLE)
                at += 1
        return out

    def homophones(self) -> dict[str, list[str]]:
        """syllable -> single characters in code point order."""
        table: dict[str, list[str]] = {}
        for unit in sorted(u for u in self.readings if len(u) == 1):
            table.setdefault(self.readings[unit][0], []).append(unit)
        return table

    def syllables(self) -> list[str]:
        return sorted({s for v in self.readings.values() for s in v})


def to_syllables(text: ColumnLike, lexicon: Lexicon) -> Column:
    """struct(chars, syllables) of equal length over the Han characters of a text."""

    def run(texts: pd.Series) -> pd.DataFrame:
        kept = [[c for c in t or "" if re.match(f"[{HAN}]", c)] for t in texts]
        return pd.DataFrame({"chars": kept, "syllables": [lexicon.read("".join(k)) for k in kept]})

    return F.pandas_udf(run, "chars array<string>, syllables array<string>")(column(text))


def to_mixed_syllables(text: ColumnLike, lexicon: Lexicon) -> Column:
    """struct(tokens, syllables, unknown): a Latin word is one token and one or more syllables.

    Han characters are read as one run, so that phrases are seen across Latin words. Only that run
    goes to Python; Latin words are read by latin_reading().
    """
    latin = lambda t: t.rlike(f"^(?:{LATIN_TOKEN})$")
    found = tokens(F.coalesce(column(text), F.lit("")), MIXED_TOKEN)
    run = F.array_join(F.filter(found, lambda t: ~latin(t)), "")
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(0).alias("at"), to_syllables(run, lexicon)["syllables"].alias("han"), none.alias("syllables"), none.alias("unknown"))

    def step(s: Column, t: Column) -> Column:
        reading = latin_reading(t)
        spoken = F.when(F.size(reading["syllables"]) > 0, reading["syllables"]).otherwise(F.array(F.lit(UNKNOWN_SYLLABLE)))
        more = F.when(latin(t), spoken).otherwise(F.array(F.get(s["han"], s["at"])))
        missed = F.when(latin(t) & ~reading["hit"], F.array(t)).otherwise(none)
        return F.struct((s["at"] + F.when(latin(t), 0).otherwise(1)).alias("at"), s["han"].alias("han"), F.concat(s["syllables"], more).alias("syllables"), F.concat(s["unknown"], missed).alias("unknown"))

    whole = F.aggregate(found, start, step)
    return F.struct(found.alias("tokens"), whole["syllables"].alias("syllables"), whole["unknown"].alias("unknown"))


def confusions(syllables: DataFrame, name: str = "syllable") -> DataFrame:
    """(syllable, near): syllables that share initial or final; where none does, all others.

    Two equi-joins and a distinct. The table of syllables is an inventory of some hundreds; the
    rows without a near one are few, and only they meet all others.
    """
    parts = syllables.select(F.col(name).alias("syllable"), syllable_parts(name).alias("p")).select("syllable", "p.*").distinct()
    other = parts.select(F.col("syllable").alias("near"), *[F.col(c).alias(f"o_{c}") for c in ("initial", "final")])
    near = parts.join(other, F.col("initial") == F.col("o_initial")).unionAll(parts.join(other, F.col("final") == F.col("o_final")))
    near = near.where("syllable <> near").select("syllable", "near").distinct()
    alone = parts.select("syllable").join(near.select("syllable"), "syllable", "left_anti")
    rest = alone.join(other.select("near"), F.col("syllable") != F.col("near"))
    return near.unionAll(rest.select("syllable", "near"))
