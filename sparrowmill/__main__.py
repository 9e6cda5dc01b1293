"""Command line: lists and runs registered queries, builds and audits corpora.

python -m sparrowmill queries
python -m sparrowmill run NAME --tables DIR --out DIR
python -m sparrowmill build-text --docs FILE --held-out FILE --out DIR
python -m sparrowmill materialize --rows DIR --out DIR --variants N
python -m sparrowmill build-instructions --hyps FILE --out DIR
python -m sparrowmill synth --sentences FILE --out DIR
python -m sparrowmill decode --logits FILE --vocabulary FILE --out DIR
python -m sparrowmill refine --hyps FILE --lm-texts FILE --readings FILE --out DIR
python -m sparrowmill serve --queue DIR --port N
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


#: Sentences that made-up rows are drawn from, at most.
MOST_SENTENCES = 100_000


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("sparrowmill")
    sub = p.add_subparsers(dest="verb", required=True)
    sub.add_parser("queries")
    for verb, options in {
        "run": ["name", "--tables", "--out"],
        "build-text": ["--docs", "--held-out", "--out", "--kind?text", "--seed?2026"],
        "materialize": ["--rows", "--out", "--variants?3", "--seed?2026"],
        "build-instructions": ["--hyps", "--out", "--most?0.8", "--keep-correct?0.25", "--nbest?5", "--val-ratio?0.02", "--seed?0"],
        "synth": ["--sentences", "--out", "--speakers?4", "--seed?0"],
        "decode": ["--logits", "--vocabulary", "--out", "--beam?10", "--nbest?5"],
        "refine": ["--hyps", "--lm-texts", "--readings", "--out"],
        "serve": ["--queue", "--port?8080", "--token?-"],
    }.items():
        s = sub.add_parser(verb)
        for o in options:
            name, _, default = o.partition("?")
            s.add_argument(name, **({"default": default} if default else {"required": True} if name.startswith("--") else {}))
    a = p.parse_args(argv)

    from . import queries, queries_io  # noqa: F401

    if a.verb == "queries":
        print("\n".join(sorted(queries.QUERIES)))
        return 0
    spark = SparkSession.builder.appName("sparrowmill").getOrCreate()
    if a.verb == "run":
        queries.QUERIES[a.name](spark, a.tables).write.mode("errorifexists").parquet(a.out)
    elif a.verb == "build-text":
        from .plans.corpus import TextRules, gated_sentences, text_corpus
        from .operators.gates import reject_counts
        from .sources import sinks, texts

        docs = texts.corpus(spark, a.kind, a.docs).withColumn("source", F.lit(a.docs))
        held, rules = texts.model_texts(spark, a.held_out), TextRules(seed=int(a.seed))
        sinks.json_by_split(text_corpus(docs, held, rules), f"{a.out}/rows")
        print(sinks.markdown(reject_counts(gated_sentences(docs, held, rules))))
    elif a.verb == "materialize":
        from .operators import augment
        from .sources import sinks

        rows = spark.read.schema("id string, source string, text string, pinyin array<string>").json(a.rows)
        sinks.json_lines(augment.noisy_messages(rows, int(a.variants), augment.Noise(), {}, int(a.seed)), a.out)
    elif a.verb == "synth":
        from .sources import sinks, texts

        sentences = [r["value"] for r in spark.read.text(a.sentences).limit(MOST_SENTENCES + 1).collect() if r["value"].strip()]
        if len(sentences) > MOST_SENTENCES:
            raise ValueError(f"over {MOST_SENTENCES} sentences")
        sinks.json_lines(texts.synthetic(spark, sentences, int(a.speakers), int(a.seed)), a.out)
    elif a.verb == "decode":
        from .functions.text import decode_ids
        from .operators import media
        from .sources import sinks

        logits = spark.read.schema("id string, logits array<array<double>>").json(a.logits)
        units = spark.read.text(a.vocabulary, wholetext=True).select(F.from_json("value", "array<string>").alias("units")).first()["units"]
        found = logits.select("id", media.beam_search("logits", width=int(a.beam), most=int(a.nbest)).alias("b"))
        named = F.transform("b", lambda x: F.struct(F.array_join(decode_ids(x["ids"], F.array(*map(F.lit, units))), "").alias("text"), x["score"].alias("score")))
        sinks.json_lines(found.select("id", named.alias("nbest")), a.out)
    elif a.verb == "refine":
        from .functions.lexicon import Lexicon
        from .operators import ngram
        from .sources import sinks, texts

        hyps = spark.read.schema("id string, ref string, pinyin array<string>, nbest array<struct<text: string>>").json(a.hyps)
        lexicon = Lexicon.from_frame(spark.read.schema("unit string, syllables string").json(a.readings))
        rows = ngram.repaired(hyps.withColumn("nbest", F.transform("nbest", lambda x: x["text"])), ngram.counts(texts.model_texts(spark, a.lm_texts), "text"), lexicon)
        sinks.json_lines(rows, f"{a.out}/rows")
        told = rows.where("ref is not null").withColumn("first", F.get("nbest", F.lit(0)))
        print(sinks.markdown(ngram.before_after(told, "ref", "first", "refined")))
    elif a.verb == "serve":
        from .streaming.service import Service, serve
        from .streaming.worker import Queue

        serve(Service(Queue(spark, a.queue), a.token.strip("-")), port=int(a.port)).serve_forever()
    else:
        from .functions.hashing import group_split
        from .operators import augment
        from .sources import sinks

        hyps = spark.read.schema("id string, ref string, pinyin array<string>, nbest array<struct<text: string>>").json(a.hyps)
        rows = augment.instruction_rows(hyps, float(a.most), float(a.keep_correct), int(a.nbest), int(a.seed))
        sinks.json_by_split(rows.withColumn("split", group_split("meta.id", float(a.val_ratio), int(a.seed))), a.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
