"""Chat formatting with typed content parts.

A message's content is a list of parts: text, image, audio, document. A visitor flattens the parts
in order: texts are escaped, other parts become placeholders that carry the number of an
attachment and stand for a number of tokens. Turns are marked by control strings; control strings
inside texts and roles are escaped reversibly, so that a formatted conversation reads back exactly.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches, table

#: Fixed strings of the template.
START, END = "<|im_start|>", "<|im_end|>"
PLACEHOLDER = "<|{kind}:{number}|>"
#: Tokens of an image tile of TILE x TILE pixels, of a second of audio, of a document page.
TILE, TILE_TOKENS, SECOND_TOKENS, PAGE_TOKENS = 512, 170, 25, 600
MARKED = re.compile(r"<\|(image|audio|document):(\d+)\|>")


def escape(text: str) -> str:
    """No ``<|`` is left; a backslash is doubled, so unescape() gives the text back."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def escape_role(role: str) -> str:
    """As escape(), and a line feed, which ends the role, as ``\\n``."""
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S)


@dataclass
class Visitor:
    """Flattens content parts in order; collects attachment references and expanded tokens."""

    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict | str | None) -> str:
        if part is None:
            return ""
        if isinstance(part, str):
            return self.text({"text": part})
        handler = getattr(self, str(part.get("type", "text")), None)
        if handler is None or part.get("type") not in ("text", "image", "audio", "document"):
            raise ValueError(f"no such content part: {part.get('type')!r}")
        return handler(part)

    def text(self, part: dict) -> str:
        return escape(part.get("text") or "")

    def _attach(self, kind: str, part: dict, tokens: int) -> str:
        number = len(self.attachments)
        self.attachments.append({"number": number, "kind": kind, "ref": part.get("ref"), "tokens": tokens})
        return PLACEHOLDER.format(kind=kind, number=number)

    def image(self, part: dict) -> str:
        tiles = max(1, math.ceil((part.get("width") or 1) / TILE)) * max(1, math.ceil((part.get("height") or 1) / TILE))
        return self._attach("image", part, tiles * TILE_TOKENS)

    def audio(self, part: dict) -> str:
        return self._attach("audio", part, max(1, math.ceil((part.get("seconds") or 0) * SECOND_TOKENS)))

    def document(self, part: dict) -> str:
        return self._attach("document", part, max(1, part.get("pages") or 1) * PAGE_TOKENS)


@dataclass
class Formatted:
    text: str
    #: [start, end) spans of the assistant's contents in ``text``.
    loss: list[tuple[int, int]]
    attachments: list[dict]


def format_turns(turns: list[tuple[str | None, object]]) -> Formatted:
    """One conversation of (role, content); content is a text, a list of parts, or None (empty)."""
    visitor, out, at, loss = Visitor(), [], 0, []
    for role, content in turns:
        parts = content if isinstance(content, list) else [content]
        head = f"{START}{escape_role(role or '')}\n"
        body = "".join(visitor.visit(p) for p in parts)
        if role == "assistant":
            loss.append((at + len(head), at + len(head) + len(body)))
        piece = f"{head}{body}{END}\n"
        out.append(piece)
        at += len(piece)
    return Formatted("".join(out), loss, visitor.attachments)


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, content) of a formatted conversation; texts unescaped, placeholders as they are.

    Placeholders hold no backslash, so unescaping leaves them alone.
    """
    out, at = [], 0
    while at < len(text):
        if not text.startswith(START, at):
            raise ValueError(f"no turn begins at {at}")
        line = text.index("\n", at)
        end = text.index(END, line)
        out.append((unescape_role(text[at + len(START) : line]), unescape(text[line + 1 : end])))
        at = end + len(END) + 1
    return out


_SCHEMA = "conv_id long, text string, loss array<struct<start: long, end: long>>, attachments array<struct<number: long, kind: string, ref: string, tokens: long>>, attachment_tokens long"


def format_conversations(rows: DataFrame) -> DataFrame:
    """One formatted conversation for each conv_id of ``rows`` (conv_id, turn, role, text).

    Columns conv_id, text, loss spans, attachments, attachment_tokens. ``text`` is a string, or an
    array of part structs (type, text, ref, width, height, seconds, pages). Turns are in the order
    of turn (nulls first), ties by role, then text; repeated rows are turns of their own. Null
    role or text: empty. A row with a null conv_id is a conversation of its own, as nothing tells
    which rows belong together. No rows: no rows. Other columns are ignored. One group is one
    conversation, which is one value of the result.
    """
    short_batches(rows.sparkSession)
    turn = F.struct(F.col("turn").cast("long").alias("turn"), "role", F.col("text").alias("content"))
    said = rows.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    whole = said.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    whole = whole.unionAll(said.where("conv_id is null").select("conv_id", F.array("t").alias("turns")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for conv_id, turns in zip(frame["conv_id"].astype("Int64"), frame["turns"], strict=True):
                done = format_turns([(t["role"], _plain(t["content"])) for t in turns])
                out.append((conv_id, done.text, [{"start": a, "end": b} for a, b in done.loss], done.attachments, sum(x["tokens"] for x in done.attachments)))
            yield pd.DataFrame(out, columns=["conv_id", "text", "loss", "attachments", "attachment_tokens"]).astype({"conv_id": "Int64", "attachment_tokens": "int64"})

    return whole.mapInPandas(run, _SCHEMA)


def _plain(content):
    if content is None or isinstance(content, str):
        return content
    return [dict(p) if isinstance(p, dict) else p.asDict() if hasattr(p, "asDict") else p for p in content]


def digests(formatted: DataFrame) -> DataFrame:
    """What op7 returns, read back from the formatted text and its loss spans alone."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for conv_id, text, loss in zip(frame["conv_id"].astype("Int64"), frame["text"], frame["loss"], strict=True):
                turns = read_turns(text)
                said = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
                whole = "".join(f"{role}\n{content}\n" for role, content in turns)
                out.append((conv_id, len(turns), _hex(whole), len(said), _hex(said), len(text)))
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64", "n_turns": "int64", "loss_chars": "int64", "formatted_chars": "int64"})

    return formatted.select("conv_id", "text", "loss").mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _hex(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def op7_chat(spark, sf_dir):
    """All conversations and conversation -1, formatted and read back."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    said = f"{END}{START}assistant ok"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return digests(format_conversations(rows.unionByName(extra)))
