"""URL filtering by mined association rules.

A URL is a set of tokens: scheme, host, domain suffixes, leading path segments, extension, query
keys. FP-growth over labelled URLs, each with its label as one more item, finds token combinations
that are frequent together with a label. They become rules where confidence and support suffice
and no simpler rule says the same as surely. Rules are matched through an inverted index: a rule
is filed under its rarest token, and only rules filed under a token of the URL are looked at.

Mining is bounded: only frequent tokens take part, of tokens that always occur together one, and of
a URL's tokens the MOST_TOKENS that tell most of the label. A basket so has at most 2^MOST_TOKENS
subsets, and as each frequent itemset needs the support, there are at most 2^MOST_TOKENS / support of
them; of those with LONGEST tokens at most, of which rules are made, 175 / support.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table, uniform

MIN_SUPPORT, MIN_CONFIDENCE, LONGEST = 0.005, 0.9, 3
#: Tokens of a URL that take part in mining, at most.
MOST_TOKENS = 10
LABEL = "label="
#: Of so many hosts one, by crc32, is held out of mining.
HELD_OUT = 5
#: Bound of the labelled sample, in expectation.
TRAIN_URLS = 20_000
DEFAULT = "allow"
#: Fixed rules: (host, path, verdict).
FIXED = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
URL = re.compile(r"([^:/?#]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", re.S)


def tokens(url: str | None) -> list[str]:
    """The distinct tokens of a URL, in order; none for null or what has no ``://``."""
    found = URL.match(url or "")
    if not found:
        return []
    scheme, host, path, query = found.groups()
    host = host.lower().rpartition("@")[2].partition(":")[0]
    labels = [x for x in host.split(".") if x]
    out = [f"scheme:{scheme.lower()}", f"host:{host}"]
    out += ["domain:" + ".".join(labels[-k:]) for k in range(1, min(3, len(labels)) + 1)]
    out += [f"label:{part}" for x in labels[:-1] for part in x.split("-") if part]
    segments = [x for x in path.split("/") if x]
    out += [f"path{i}:{re.sub('[0-9]+', '0', x)}" for i, x in enumerate(segments[:3])]
    if segments and "." in segments[-1]:
        out.append("ext:" + segments[-1].rpartition(".")[2].lower())
    out += ["key:" + x.partition("=")[0] for x in (query or "").split("&") if x]
    return list(dict.fromkeys(out))


@dataclass(frozen=True)
class Rule:
    tokens: frozenset[str]
    label: str
    confidence: float
    support: float


def prune(rules: list[Rule]) -> list[Rule]:
    """Without rules of which a simpler one with the same label is as sure."""
    sure = {(r.tokens, r.label): r.confidence for r in rules}

    def simpler(rule: Rule):
        for size in range(1, len(rule.tokens)):
            for part in combinations(sorted(rule.tokens), size):
                yield sure.get((frozenset(part), rule.label), -1.0)

    return [r for r in sorted(rules, key=lambda r: (len(r.tokens), -r.confidence, sorted(r.tokens))) if not any(c >= r.confidence for c in simpler(r))]


def telling_tokens(listed: DataFrame, least: int) -> DataFrame:
    """(token, weight, n): tokens that ``least`` baskets of ``listed`` (id, label, tokens) have.

    Tokens that occur in the same baskets are one: the first by kind, length and name stands for
    them. The weight is how far the share of the token's surest label is from that label's share of all.
    """
    total = listed.groupBy("label").agg(F.count("*").alias("of_label")).withColumn("share", F.col("of_label") / F.sum("of_label").over(Window.partitionBy()))
    each = listed.select("label", F.pmod(F.xxhash64("id"), F.lit(1 << 36)).alias("sign"), F.explode("tokens").alias("token"))
    by_label = each.groupBy("token", "label").agg(F.count("*").alias("n"), F.sum("sign").alias("sign")).join(total.select("label", "share"), "label")
    by_token = by_label.groupBy("token").agg(F.sum("n").alias("n"), F.sum("sign").alias("sign"), F.max(F.struct("n", "share")).alias("top")).where(F.col("n") >= least)
    weight = F.abs(F.col("top.n") / F.col("n") - F.col("top.share"))
    first = F.min(F.struct(F.length("token").alias("size"), "token", weight.alias("weight"))).alias("first")
    return by_token.groupBy("n", "sign").agg(first).select("first.token", "first.weight", "n")


def mine(labelled: DataFrame, most: int = TRAIN_URLS, support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE) -> list[Rule]:
    """Rules from ``labelled`` (url, label); about ``most`` rows, drawn by a hash of the URL.

    Null URLs and labels are not used; no labelled rows: no rules. FP-growth finds the combinations,
    175 / support at most; how sure they are is counted over whole token lists of the sample.
    """
    from pyspark.ml.fpm import FPGrowth

    labelled = labelled.where("url is not null and label is not null")
    n = labelled.count()
    if not n:
        return []
    sample = labelled.where(uniform("url", seed=29) < min(1.0, most / n))

    def token_lists(url: pd.Series) -> pd.Series:
        return url.map(tokens)

    url_tokens = F.pandas_udf(token_lists, "array<string>")
    listed = materialize(sample.select("label", url_tokens("url").alias("tokens")).withColumn("id", F.monotonically_increasing_id()))
    total = max(1, listed.count())
    telling = materialize(telling_tokens(listed, max(1, math.ceil(support * total))))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("weight"), F.desc("n"), "token"))
    kept = listed.select("id", "label", F.explode("tokens").alias("token")).join(telling, "token").withColumn("place", place).where(F.col("place") <= MOST_TOKENS)
    baskets = kept.groupBy("id", "label").agg(F.collect_list("token").alias("items")).select(F.concat("items", F.array(F.concat(F.lit(LABEL), F.col("label")))).alias("items"))
    # Baskets without a telling token count in the total alone.
    share = min(1.0, support * total / max(1, baskets.count()))
    frequent = FPGrowth(itemsCol="items", minSupport=share, minConfidence=0.0).fit(baskets).freqItemsets.where(F.size("items") <= LONGEST + 1)
    bases = frequent.select(F.array_sort(F.filter("items", lambda x: ~x.startswith(LABEL))).alias("base"), F.exists("items", lambda x: x.startswith(LABEL)).alias("told")).where("told and size(base) > 0")
    candidates = [frozenset(r["base"]) for r in bases.select("base").distinct().collect()]
    rules = [
        Rule(base, label, n / sum(by_label.values()), n / total)
        for base, by_label in counted(listed, candidates).items()
        for label, n in by_label.items()
        if n >= support * total and n >= confidence * sum(by_label.values())
    ]
    return prune(rules)


def counted(listed: DataFrame, bases: list[frozenset[str]]) -> dict[frozenset[str], dict[str, int]]:
    """How many baskets of ``listed`` (label, tokens) hold each base, by label.

    Over all tokens of a basket, also those that took no part in mining. A (base, label) is a row of
    the result.
    """
    shared = listed.sparkSession.sparkContext.broadcast([Rule(base, str(at), 0.0, 0.0) for at, base in enumerate(bases)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher, found = Matcher(shared.value), Counter()
        for frame in frames:
            for label, tokens_ in zip(frame["label"], frame["tokens"], strict=True):
                found.update((int(r.label), label) for r in matcher.met(set(tokens_)))
        yield pd.DataFrame([(at, label, n) for (at, label), n in found.items()], columns=["at", "label", "n"]).astype({"at": "int64", "label": str, "n": "int64"})

    out: dict[frozenset[str], dict[str, int]] = {}
    for r in listed.select("label", "tokens").mapInPandas(run, "at long, label string, n long").groupBy("at", "label").agg(F.sum("n").alias("n")).collect():
        out.setdefault(bases[r["at"]], {})[r["label"]] = r["n"]
    return out


class Matcher:
    """Rules filed under one token each, that which fewest rules have."""

    def __init__(self, rules: list[Rule]):
        often: dict[str, int] = {}
        for rule in rules:
            for token in rule.tokens:
                often[token] = often.get(token, 0) + 1
        self.index: dict[str, list[Rule]] = {}
        for rule in rules:
            self.index.setdefault(min(rule.tokens, key=lambda t: (often[t], t)), []).append(rule)

    def met(self, have: set[str]) -> list[Rule]:
        """The rules all of whose tokens are there."""
        return [r for t in have for r in self.index.get(t, ()) if r.tokens <= have]

    def best(self, url: str | None) -> Rule | None:
        """The surest rule that the URL meets; ties: more tokens, more support, then by name."""
        met = self.met(set(tokens(url)))
        return min(met, key=lambda r: (-r.confidence, -len(r.tokens), -r.support, r.label, sorted(r.tokens)), default=None)


def host(url: Column) -> Column:
    """What is between the first ``://`` and the next of ``/?#``, A-Z in lower case; else empty."""
    part = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(part, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def with_fixed_rule(pages: DataFrame, fixed=FIXED) -> DataFrame:
    """``pages`` (url, ...) with host, path, rule and fixed_verdict of the longest rule that fits."""
    out = pages.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, begin, what in sorted(fixed, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(begin)
        rule, verdict = F.when(fits, F.lit(name + begin)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return out.withColumn("rule", rule).withColumn("fixed_verdict", verdict)


def judge(pages: DataFrame, fixed=FIXED, labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule, confidence, mined_verdict, held_out of every page (page_id, url).

    A fixed rule that fits decides, the longest first. Else the surest mined rule; else ``allow``.
    mined_verdict is what mined rules alone say, null where none is met. Rules are mined from
    ``labels`` (url, label); without them from the URLs that fixed rules decide, without those of
    held-out hosts, whose pages tell how well mined rules carry over. Null url, or one without
    ``://``: empty host and path. Repeated rows are judged each. No rows: no rows. Other columns of
    ``pages`` are ignored. A narrow scan.
    """
    placed = with_fixed_rule(pages.select("page_id", F.col("url").cast("string").alias("url")), fixed)
    placed = placed.withColumn("held_out", F.pmod(F.crc32(F.col("host").cast("binary")), F.lit(HELD_OUT)) == 0)
    rules = mine(placed.where("not held_out").select("url", F.col("fixed_verdict").alias("label")) if labels is None else labels)
    shared = pages.sparkSession.sparkContext.broadcast(rules)

    def verdicts(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(shared.value)
        for part in parts:
            found = [matcher.best(u) for u in part]
            yield pd.DataFrame({
                "label": [r.label if r else None for r in found],
                "mined_rule": [" & ".join(sorted(r.tokens)) if r else None for r in found],
                "confidence": [r.confidence if r else None for r in found],
            }).astype({"label": object, "mined_rule": object, "confidence": "float64"})

    verdicts.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    match = F.pandas_udf(verdicts, "label string, mined_rule string, confidence double")
    judged = placed.withColumn("m", match("url"))
    verdict = F.coalesce("fixed_verdict", "m.label", F.lit(DEFAULT)).alias("verdict")
    return judged.select("page_id", "host", "path", "rule", verdict, "m.mined_rule", "m.confidence", F.col("m.label").alias("mined_verdict"), "held_out")


def op9_url_filter(spark, sf_dir):
    """Verdicts on all pages' URLs."""
    return judge(table(spark, sf_dir, "pages", "page_id", "url"))


def url_fixed_rules(spark, sf_dir):
    """Host, path and fixed rule of all pages: the part of op9 that SQL can say."""
    return with_fixed_rule(table(spark, sf_dir, "pages", "page_id", "url")).select("page_id", "host", "path", "rule", "fixed_verdict")
