"""Column functions on text. Character classes and delimiters are parameters; the defaults are
those of Mandarin text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character ranges, delimiters and token patterns that results depend on.
HAN = "一-龥"
HAN_EXTENDED = "一-龥㐀-䶿"
ALNUM = "A-Za-z0-9"
SENTENCE_END = "[。！？!?；;\n]+"
LATIN_TOKEN = r"[A-Za-z][A-Za-z\-']*|\d+"
MIXED_TOKEN = rf"[A-Za-z][A-Za-z\-']*|\d+|[{HAN}]"
BRACKETS = r"[（(][^）)]*[）)]"
QUOTES = "[\"'“”‘’《》「」『』]"
UNKNOWN_SYLLABLE = "<unk_py>"

ColumnLike = Column | str


def column(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: ColumnLike) -> Column:
    """Trimmed text; empty counts as missing."""
    return F.nullif(F.trim(column(c).cast("string")), F.lit(""))


def is_han(c: ColumnLike) -> Column:
    """Whether the text is a single Han character."""
    return column(c).rlike(f"^[{HAN_EXTENDED}]$")


def keep_class(c: ColumnLike, chars: str = HAN_EXTENDED) -> Column:
    """Only the characters of a class."""
    return F.regexp_replace(column(c), f"[^{chars}]", "")


def drop_blanks(c: ColumnLike) -> Column:
    return F.regexp_replace(column(c), r"\s+", "")


def normal_form(c: ColumnLike, chars: str = HAN + ALNUM) -> Column:
    """Only the characters of a class, in lower case: the key texts are compared by."""
    return F.lower(keep_class(c, chars))


def tokens(c: ColumnLike, pattern: str = MIXED_TOKEN) -> Column:
    """All matches of a token pattern, in order."""
    return F.regexp_extract_all(column(c), F.lit(pattern), F.lit(0))


def latin_tokens(c: ColumnLike) -> Column:
    return tokens(c, LATIN_TOKEN)


def count_units(c: ColumnLike) -> Column:
    """Han characters plus Latin words."""
    return F.regexp_count(column(c), F.lit(f"[{HAN}]")) + F.regexp_count(column(c), F.lit(r"[A-Za-z]+"))


def sentences(c: ColumnLike, delimiters: str = SENTENCE_END, chars: str | None = HAN_EXTENDED) -> Column:
    """Non-empty sentences in order; with ``chars``, only the characters of that class."""
    parts = F.split(column(c), delimiters)
    clean = F.transform(parts, lambda s: keep_class(s, chars) if chars else F.trim(s))
    return F.filter(clean, lambda s: s != "")


def spoken_sentences(c: ColumnLike, delimiters: str = "[。！？!?；;]") -> Column:
    """Sentences of a transcript: brackets with content and quotes go, ends are trimmed."""
    plain = F.regexp_replace(F.regexp_replace(column(c), BRACKETS, ""), QUOTES, "")
    return F.filter(F.transform(F.split(plain, delimiters), lambda s: F.trim(s)), lambda s: s != "")


def first_line(c: ColumnLike) -> Column:
    """The first line that is not blank, trimmed; null where there is none."""
    lines = F.filter(F.transform(F.split(column(c), r"\r?\n"), lambda s: F.trim(s)), lambda s: s != "")
    return F.get(lines, F.lit(0))


def strip_mark(c: ColumnLike) -> Column:
    """Without a leading byte order mark."""
    return F.regexp_replace(column(c), "^﻿", "")


def without_suffix(path: ColumnLike) -> Column:
    """A path without the extension of its last part."""
    return F.regexp_replace(column(path), r"\.[^./]*$", "")


def stem(path: ColumnLike) -> Column:
    """The last part of a path, without extension."""
    return without_suffix(F.element_at(F.split(column(path), "/"), -1))


def safe_name(c: ColumnLike) -> Column:
    """Letters, digits, ``_`` and ``-``; anything else becomes ``_``."""
    return F.regexp_replace(column(c), r"(?U)[^\w-]", "_")


def adjacent_repeats(items: ColumnLike) -> Column:
    """How many items of an array equal the one before."""
    a = column(items)
    pairs = F.zip_with(F.slice(a, 2, F.greatest(F.size(a), F.lit(1))), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1))), lambda x, y: x == y)
    return F.when(F.size(a) < 2, F.lit(0)).otherwise(F.size(F.filter(pairs, lambda same: same)))


def collapse_path(labels: ColumnLike, blank: int = 0) -> Column:
    """A label path with repeats merged, then blanks removed."""
    a = column(labels)
    fresh = F.transform(a, lambda x, i: F.when((i == 0) | (x != F.get(a, i - 1)), x))
    return F.filter(fresh, lambda x: x.isNotNull() & (x != blank))


def encode_ids(items: ColumnLike, vocabulary: Column, unknown: int = 2) -> Column:
    """Ids of items by a map column; unknown items get ``unknown``."""
    return F.transform(column(items), lambda t: F.coalesce(F.element_at(vocabulary, t), F.lit(unknown)))


def decode_ids(ids: ColumnLike, units: Column, specials: int = 2) -> Column:
    """Items of ids by an array column; blank, sentence marks and ids out of range are dropped."""
    valid = F.filter(column(ids), lambda i: (i >= specials) & (i < F.size(units)))
    return F.transform(valid, lambda i: F.get(units, i))


def last_answer(c: ColumnLike, chars: str = HAN) -> Column:
    """The sentence in a model's reply: last line, after the last colon with a tail, class runs joined."""
    line = F.trim(F.element_at(F.split(F.trim(F.coalesce(column(c), F.lit(""))), r"\r?\n"), -1))
    for mark in ("：", ":"):
        tail = F.element_at(F.split(line, mark), -1)
        line = F.when(F.contains(line, F.lit(mark)) & (F.length(tail) > 1), tail).otherwise(line)
    return F.array_join(tokens(line, f"[{chars}]+"), "")


def guarded_answer(reply: ColumnLike, syllables: ColumnLike, candidates: ColumnLike, limit: float = 1.6, chars: str = HAN) -> Column:
    """The reply's sentence, or the first candidate where it is empty or too long for the syllables."""
    answer = last_answer(reply, chars)
    usable = (answer != "") & (F.length(answer) <= limit * F.greatest(F.size(column(syllables)), F.lit(1)))
    return F.when(usable, answer).otherwise(F.coalesce(F.get(column(candidates), F.lit(0)), F.lit("")))


def distinct_in_order(items: ColumnLike, *more: ColumnLike) -> Column:
    """Items of arrays in order, first occurrences only, blanks removed."""
    whole = F.concat(column(items), *[column(m) for m in more]) if more else column(items)
    return F.array_distinct(F.filter(whole, lambda x: x.isNotNull() & (x != "")))


def half_even(c: ColumnLike, scale: int = 0) -> Column:
    """Round half to even."""
    return F.bround(column(c), scale)


def command_line(program: str, **options: ColumnLike) -> Column:
    """A shell command of a program and its options (``--name value``); values are quoted, null ones left out."""
    def quoted(c: ColumnLike) -> Column:
        value = column(c).cast("string")
        plain = value.rlike("^[A-Za-z0-9_./:=@%+,-]+$")
        return F.when(plain, value).otherwise(F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("'\"'\"'")), F.lit("'")))

    return F.concat_ws(" ", F.lit(program), *[F.concat(F.lit(f"--{name} "), quoted(c)) for name, c in options.items()])
