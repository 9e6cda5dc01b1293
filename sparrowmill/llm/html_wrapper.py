"""Main-text extraction from HTML by wrappers inferred for each host.

Pages of a host are token streams of tags and texts. A wrapper is a union-free regular expression
over such tokens, inferred from all pages of the host: adjacent repeats fold into repeated groups, then
the streams are aligned one by one; texts become slots, and stretches that one stream has and another
lacks become optional groups. Everything that is counted is counted on all pages, by aggregates with
partial results; copies of an article share one page's weight. Slots decide what is main text: one that varies from page to page is
content, one that holds the same text on many pages is template, and a repeated group of links is a
menu. Content lies in the stretch of the expression between an open and a close tag that holds the
bulk of the varying text; pages are aligned with the expression to find that stretch in them. Where articles hold a good share of it, they are the stretch; where most of it lies in
regions that a class name marks as no part of an article, the class name gives way. Elements that
markup itself sets apart (menus, footers, asides, forms) are never content. Tags and classes alone
decide where a host has too few pages to tell.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.edits import increasing_chain
from . import flattext as ft
from .common import materialize, rebatch, short_batches, slices, spread, table, text_list

#: Longest group of tokens that may repeat.
LONGEST_GROUP = 40
#: Wrappers are broadcast if all together have at most so many characters, joined by host otherwise.
BROADCAST_CHARS = 16 << 20

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|math|iframe|object|canvas|textarea|select|title|audio|video)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end when another of their kind, or what holds them, begins or ends.
SHORT = frozenset("p li dt dd tr td th option h1 h2 h3 h4 h5 h6".split())
DROPPED = frozenset("head nav footer aside form button dialog menu fieldset".split())
ROLES = frozenset("navigation complementary contentinfo search dialog alertdialog menu menubar toolbar form".split())
MAIN = frozenset("article main".split())
MAIN_WORDS = frozenset("articlebody".split())
#: Words that mark a class or id as no part of an article, if all its other words are of LAYOUT.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored banner promo promotion nav navbar navigation menu menus breadcrumb breadcrumbs "
    "sidebar sidebars side footer foot cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup "
    "social share sharing related recommended comment comments commentlist reply replies respond disqus toolbar widget widgets pagination pager login search "
    "contentinfo complementary dialog skip masthead topbar".split()
)
#: Words that say where or how a region lies, not what it holds.
LAYOUT = frozenset(
    "area bar block box bottom button buttons col column container content desktop fixed form global group holder icon icons inner item items js left link links list "
    "main mobile module outer page panel post posts article articles primary reader readers right row secondary section site sticky top user users wrap wrapper x".split()
)
HEADERS = frozenset("header head masthead".split())
#: Pages of their own that a host needs for its slots to decide.
LEAST_PAGES = 3
#: The weight of a page that is no copy; integers, so that sums do not depend on their order.
UNIT = 1 << 32
#: What sums of rounded weights may lack.
SLACK = UNIT >> 6
#: Classes that the structures of a host are dealt into; each makes an expression, and these are aligned.
CLASSES = 64
#: Paths that a task counts before it passes the counts on, and structures that it tells apart.
HELD = 50_000
#: Articles decide on where they hold this share of its varying text.
ARTICLE_SHARE = 0.2
#: The stretch of content holds this share of the varying text.
BULK = 0.7
#: Cells of an alignment that is done by matching every stretch; longer streams are parted by anchors first.
CELLS = 1 << 20


class Element:
    """name, path (what it is, from the root), and where it lies: set apart by markup (``apart``),
    in a region that a class name marks (``marked``), in an article (``main``)."""

    __slots__ = ("name", "path", "apart", "marked", "main")

    def __init__(self, name: str, path: str, apart: bool, marked: bool, main: bool):
        self.name, self.path, self.apart, self.marked, self.main = name, path, apart, marked, main


def marks(token: str) -> bool:
    """Whether a class or id marks boilerplate: ``comment-list`` does, ``side-effects`` does not."""
    words = [w.lower() for w in WORD.findall(token)]
    return any(w in BOILERPLATE for w in words) and all(w in BOILERPLATE or w in LAYOUT or w.isdigit() for w in words)


def _attributes(attrs: str) -> tuple[str, bool, bool, bool, bool]:
    """(class name for the path, set apart, marked, a header, main) of a tag's attributes."""
    label, apart, marked, header, main = "", False, False, False, False
    for key, *values in ATTRIBUTE.findall(attrs):
        key, value = key.lower(), "".join(values)
        if key in ("class", "id"):
            tokens_ = value.split()
            if key == "class" and not label and tokens_:
                label = re.sub(r"\d+", "0", tokens_[0])
            marked = marked or any(map(marks, tokens_))
            header = header or any(t.lower() in HEADERS for t in tokens_)
        elif key == "role":
            role = value.strip().lower()
            main, apart, header = main or role in MAIN, apart or role in ROLES, header or role == "banner"
        elif key == "itemprop":
            main = main or value.strip().lower() in MAIN_WORDS
        elif key == "style":
            apart = apart or "display:none" in value.replace(" ", "").lower()
        else:
            apart = apart or value.lower() != "false"
    return label, apart, marked, header, main


def tokens(page: str) -> Iterator[tuple[str, str, Element]]:
    """(kind, value, element) of a page: kinds open, close, block, text, link, unlink.

    Elements nest by their tags; a close tag without its open tag is passed over, and an element
    left open ends with what holds it.
    """
    root = Element("", "", False, False, False)
    stack = [root]
    at = 0

    def close(depth: int):
        while len(stack) > depth:
            gone = stack.pop()
            yield "close", gone.name, gone

    for found in TOKEN.finditer(page):
        if found.start() > at:
            yield "text", page[at : found.start()], stack[-1]
        at = found.end()
        name = found["name"]
        if not name:
            continue
        name = name.lower()
        if name in INLINE:
            if name == "a":
                yield ("unlink" if found["close"] else "link"), name, stack[-1]
            continue
        if name in VOID:
            # A line break parts words, a rule parts blocks.
            yield ("text", " ", stack[-1]) if name == "br" else ("block", name, stack[-1])
            continue
        if found["close"]:
            depth = next((d for d in range(len(stack) - 1, 0, -1) if stack[d].name == name), 0)
            if depth:
                yield from close(depth)
            else:
                yield "block", name, stack[-1]
            continue
        if name == "body":
            depth = next((d for d in range(1, len(stack)) if stack[d].name == "head"), 0)
            if depth:
                yield from close(depth)
        if name in SHORT:
            ends = {"tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "li": {"li"}, "option": {"option"}}.get(name, set()) | {"p"}
        else:
            ends = {"p"}
        while stack[-1].name in ends:
            yield from close(len(stack) - 1)
        label, hidden, marked, header, main = _attributes(found["attrs"]) if "=" in found["attrs"] or "hidden" in found["attrs"] else ("", False, False, False, False)
        above = stack[-1]
        main = name in MAIN or main
        whole = name in ("html", "body")
        # A header is left out where it heads the page, and kept where it heads the article.
        heads = not above.main and not main and not whole
        apart = above.apart or name in DROPPED or (hidden and not whole) or (name == "header" and heads)
        marked = above.marked or (marked and not whole and name not in MAIN) or (header and heads)
        # The path tells elements apart that differ in what they are: ! is set apart, ^ is marked, * begins the article.
        sign = "!" * (apart and not above.apart) + "^" * (marked and not above.marked) + "*" * (main and not above.main)
        node = Element(name, f"{above.path}/{name}{sign}" + (f".{label}" if label else ""), apart, marked, above.main or main)
        stack.append(node)
        yield "open", name, node
    if at < len(page):
        rest = page[at:]
        yield "text", rest[: rest.find("<")] if re.search(r"<[a-zA-Z/!?]", rest) else rest, stack[-1]
    yield from close(1)


class Block:
    """A text between block tags: references decoded, blanks as one space; linked: all of it is links."""

    __slots__ = ("text", "path", "apart", "marked", "main", "linked")

    def __init__(self, text: str, element: Element, linked: bool):
        self.text, self.path, self.apart, self.marked, self.main, self.linked = text, element.path, element.apart, element.marked, element.main, linked

    @property
    def place(self) -> str:
        return f"{self.path}\t{self.text}"


def stream(page: str) -> list[tuple[str, Block | None]]:
    """(key, block) tokens in page order: open and close tags by path, blocks as slots (``#``, ``@`` if linked)."""
    out: list[tuple[str, Block | None]] = []
    parts: list[str] = []
    owner, in_link, plain = None, False, False

    def flush():
        nonlocal parts, owner, plain
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((f"#{owner.path}" + ("" if plain else "@"), Block(text, owner, not plain)))
        parts, owner, plain = [], None, False

    for kind, value, element in tokens(page):
        if kind == "text":
            parts.append(value)
            if owner is None:
                owner = element
            if not in_link and not value.isspace():
                plain = True
        elif kind == "link":
            in_link = True
        elif kind == "unlink":
            in_link = False
        else:
            flush()
            if kind == "close" and value not in SHORT:
                in_link = False
            if kind != "block":
                out.append((("<" if kind == "open" else ">") + element.path, None))
    flush()
    return out


def blocks(page: str) -> list[Block]:
    """The non-empty texts between block tags, in page order."""
    return [b for _, b in stream(page) if b]


class Item:
    """A token of a wrapper, or of a page: a tag, a slot, or a repeated group; optional or not."""

    __slots__ = ("key", "optional", "group", "blocks")

    def __init__(self, key: str, blocks: list[Block], group: list[Item] | None = None):
        self.key, self.blocks, self.optional, self.group = key, blocks, False, group

    def pattern(self) -> str:
        body = "(" + " ".join(i.pattern() for i in self.group) + ")+" if self.group else self.key
        return f"({body})?" if self.optional else body

    def slots(self) -> list[str]:
        """Keys of the text slots in it."""
        return [k for i in self.group for k in i.slots()] if self.group else [self.key] if self.key[0] == "#" else []

    def menu(self) -> bool:
        """A repeated group all of whose slots are links, outside articles."""
        return self.group is not None and all(k[-1] == "@" and "*" not in k for k in self.slots())


def fold(items: list[Item]) -> list[Item]:
    """Adjacent equal stretches become one repeated group, shorter stretches first."""
    size = 1
    while size <= min(LONGEST_GROUP, len(items) // 2):
        keys = [i.key for i in items]
        same = [a == b for a, b in zip(keys, keys[size:], strict=False)]
        out, at = [], 0
        # runs[i]: how many places from i on equal the place ``size`` further.
        runs = [0] * (len(items) + 1)
        for i in range(len(same) - 1, -1, -1):
            runs[i] = runs[i + 1] + 1 if same[i] else 0
        while at < len(items):
            run = runs[at] if at < len(same) else 0
            # A group of one tag alone is no repetition of content.
            if run >= size and any(i.group or i.key[0] == "#" for i in items[at : at + size]):
                body, end = items[at : at + size], at + (run // size + 1) * size
                group = body[0].group if size == 1 and body[0].group else body
                out.append(Item("(" + " ".join(i.key for i in group) + ")+", [b for i in items[at:end] for b in i.blocks], group))
                at = end
            else:
                out.append(items[at])
                at += 1
        items = out
        size += 1
    return items


def folded(page: str) -> list[Item]:
    return fold([Item(key, [block] if block else []) for key, block in stream(page)])


def squeezed(keys: list[str], begin: int, end: int, shared: set, gap: int) -> tuple[list[int], list]:
    """(places, keys) of a stretch where each run of keys that are not shared is one ``gap``: they match
    nothing, and part what they stand between however many they are."""
    at, out = [], []
    for i in range(begin, end):
        if keys[i] in shared:
            at.append(i)
            out.append(keys[i])
        elif not out or out[-1] is not gap:
            at.append(i)
            out.append(gap)
    return at, out


def matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Rising pairs of equal places in two lists. Short lists are matched stretch by stretch; long
    ones are parted at the keys that both have once, and what cannot be parted so is left unmatched."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        if (a1 - a0) * (b1 - b0) <= CELLS:
            at, own = squeezed(a, a0, a1, set(b[b0:b1]), 0)
            to, other = squeezed(b, b0, b1, set(own), 1)
            for i, j, n in SequenceMatcher(None, own, other, autojunk=False).get_matching_blocks():
                out += [(at[i + k], to[j + k]) for k in range(n)]
            continue
        once = [{k: at for k, at in zip(x, range(lo, hi), strict=True) if n[k] == 1} for x, lo, hi in ((a[a0:a1], a0, a1), (b[b0:b1], b0, b1)) for n in (Counter(x),)]
        chain = increasing_chain([(i, once[1][k]) for k, i in once[0].items() if k in once[1]])
        out += chain
        if chain:
            for (i0, j0), (i1, j1) in zip([(a0 - 1, b0 - 1), *chain], [*chain, (a1, b1)], strict=True):
                todo.append((i0 + 1, i1, j0 + 1, j1))
    return sorted(out)


def align(wrapper: list[Item], page: list[Item]) -> list[Item]:
    """The wrapper after one more page: what only one side has becomes optional."""
    out: list[Item] = []
    i = j = 0
    for a, b in [*matches([x.key for x in wrapper], [x.key for x in page]), (len(wrapper), len(page))]:
        for item in [*wrapper[i:a], *page[j:b]]:
            item.optional = True
            out.append(item)
        out += wrapper[a : a + 1]
        i, j = a + 1, b + 1
    return out


def telling(page: list[Block]) -> list[Block]:
    """What a page is told from others by: its article, or else what no region or link holds."""
    plain = [b for b in page if not (b.apart or b.marked or b.linked)]
    return [b for b in plain if b.main] or plain


def page_weight(counts: list[int]) -> int:
    """A page's weight, from how many pages have each of its telling blocks: a share of UNIT.

    Pages with over half of their telling blocks alike are copies of an article, whose text must not
    be taken for the host's own: the lower median of the counts is at least their number, and they
    weigh as much as one page together. A page that nothing tells from others weighs nothing.
    """
    return UNIT // sorted(counts)[(len(counts) + 1) // 2 - 1] if counts else 0


def digest(host: str, place: str) -> int:
    """64 bits that stand for a text at a path of a host."""
    return int.from_bytes(hashlib.blake2b(f"{host}\n{place}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def slot_paths(items: list[Item]) -> dict[str, bool]:
    """Paths of a page's slots outside articles and what markup sets apart: whether in a menu."""
    out = {k[1:].removesuffix("@"): False for i in items for k in i.slots()}
    out.update((k[1:-1], True) for i in items if i.menu() for k in i.slots())
    return {p: menu for p, menu in out.items() if "*" not in p and "!" not in p}


def varies(b: Block, template: set, links: set[str], place) -> bool:
    return not b.apart and place not in template and (b.main or b.path not in links)


def decisions(marked: int, main: int, opened: int) -> tuple[bool, bool]:
    """(articles decide, marked regions hold the content) from the varying text in code points that
    lies in marked regions, in articles and elsewhere."""
    articles = main > 0 and main >= ARTICLE_SHARE * (main + opened)
    return articles, marked > main + (0 if articles else opened)


def within(keys: tuple[str, ...], more: tuple[str, ...]) -> bool:
    rest = iter(more)
    return all(k in rest for k in keys)


def grown(keys: tuple[str, ...], more: tuple[str, ...]) -> tuple[str, ...]:
    """An expression's tokens after those of a page, or of another expression, are aligned with them."""
    if within(more, keys):
        return keys
    if within(keys, more):
        return more
    out: list[str] = []
    i = j = 0
    for a, b in [*matches(list(keys), list(more)), (len(keys), len(more))]:
        out += [*keys[i:a], *more[j:b], *keys[a : a + 1]]
        i, j = a + 1, b + 1
    return tuple(out)


def structure_class(keys: tuple[str, ...]) -> tuple[int, int, int]:
    """(class, minus length, digest): structures are aligned in this order, the longest of a class first."""
    own = digest("", "\n".join(keys))
    return own % CLASSES, -len(keys), own


def expression(structures: set[tuple[str, ...]]) -> tuple[str, ...]:
    """The tokens of the expression of all structures, aligned by classes."""
    parts: dict[int, tuple[str, ...]] = {}
    for (k, _, _), keys in sorted((structure_class(keys), keys) for keys in structures):
        parts[k] = grown(parts.get(k, ()), keys)
    return joined(parts)


def joined(parts: dict[int, tuple[str, ...]]) -> tuple[str, ...]:
    out: tuple[str, ...] = ()
    for k in sorted(parts):
        out = grown(out, parts[k])
    return out


def stretch(keys: list[str], mass: list[int]) -> tuple[int, int]:
    """The innermost stretch of an expression, from an open tag to its close tag, that holds the bulk
    of the varying text; all of it where none does."""
    total, before, found, opened = sum(mass), np.concatenate([[0], np.cumsum(mass)]), (0, len(keys)), []
    for at, key in enumerate(keys):
        if key[0] == "<":
            opened.append(at)
        elif key[0] == ">":
            depth = next((d for d in range(len(opened) - 1, -1, -1) if keys[opened[d]][1:] == key[1:]), None)
            if depth is not None:
                begin = opened[depth]
                del opened[depth:]
                # Inner stretches end first: the first one with the bulk is the innermost.
                if total and before[at + 1] - before[begin] >= BULK * total:
                    return begin, at
    return found


def infer(pages: list[str]) -> dict:
    """The wrapper of a host's pages and what its slots say; ``wrappers`` says the same of tables.

    pattern: the expression. template: path and text of what pages that weigh as LEAST_PAGES, and
    half of all, have alike. links: paths of slots outside articles that are in repeated groups, whose
    slots are all links, on half of the pages that have them. main: whether articles hold their share
    of the varying text, so that only they count. rescue: whether regions that a class name marks hold
    most of it. content: paths of the slots that hold main text; these may be in a marked region in
    that case. keys and stretch, where articles do not decide: the expression's tokens, and where in
    them the content lies. enough: whether the pages are enough to tell.
    """
    whole = [folded(page) for page in pages]
    wrapper: list[Item] = []
    for number, items in enumerate(whole):
        # A wrapper has tokens of its own: what becomes optional there stays as it is on the page.
        wrapper = align(wrapper, [Item(i.key, [], i.group) for i in items]) if number else [Item(i.key, [], i.group) for i in items]
    found = [[b for i in items for b in i.blocks] for items in whole]
    counts = Counter(place for page in found if telling(page) for place in {b.place for b in page})
    weights = [page_weight([counts[place] for place in {b.place for b in telling(page)}]) for page in found]
    total, weighed, slots, menus = sum(weights), Counter(), Counter(), Counter()
    for page, weight, items in zip(found, weights, whole, strict=True):
        for place in {b.place for b in page}:
            weighed[place] += weight
        paths = slot_paths(items)
        slots.update(paths.keys())
        menus.update(p for p, menu in paths.items() if menu)
    template = {place for place, n in weighed.items() if n >= LEAST_PAGES * UNIT - SLACK and 2 * n + SLACK >= total}
    links = {p for p, n in menus.items() if 2 * n >= slots[p]}
    mass: Counter = Counter()
    for b in (b for page in found for b in page if varies(b, template, links, b.place)):
        mass["marked" if b.marked else "main" if b.main else "open"] += len(b.text)
    main, rescue = decisions(mass["marked"], mass["main"], mass["open"])
    fits = lambda p: "!" not in p and (rescue or "^" not in p) and ("*" in p or p not in links) and (not main or "*" in p or "^" in p)
    out = {"pattern": " ".join(i.pattern() for i in wrapper), "enough": total >= LEAST_PAGES * UNIT - SLACK, "main": main, "rescue": rescue, "template": sorted(template), "links": sorted(links)}
    out["content"] = sorted(p for p in {k[1:].removesuffix("@") for i in wrapper for k in i.slots()} if fits(p))
    if out["enough"] and not main:
        keys = expression({tuple(i.key for i in items) for items in whole})
        held = np.zeros(len(keys), dtype=np.int64)
        for items in whole:
            _hold(held, keys, items, lambda b: varies(b, template, links, b.place) and (rescue or not b.marked))
        out["keys"], out["stretch"] = list(keys), stretch(list(keys), held.tolist())
    return out


def _hold(held: np.ndarray, keys, items: list[Item], counts: Callable[[Block], bool], places: dict | None = None) -> None:
    """Add a page's varying text to the tokens of the expression that hold it."""
    own = tuple(i.key for i in items)
    if places is None:
        places = {}
    if own not in places:
        places[own] = matches(list(keys), list(own))
    for i, j in places[own]:
        held[i] += sum(len(b.text) for b in items[j].blocks if counts(b))


def _in_stretch(items: list[Item], wrapper: dict) -> list[Item]:
    """The tokens of a page that lie in the wrapper's stretch: an unmatched one lies where the
    matched one before it does."""
    begin, end = wrapper["stretch"]
    own, known = tuple(i.key for i in items), wrapper.setdefault("known", {})
    if own not in known:
        if len(known) > 500:
            known.clear()
        known[own] = dict((j, i) for i, j in matches(wrapper["keys"], list(own)))
    place, at, out = known[own], -1, []
    for j, item in enumerate(items):
        at = place.get(j, at)
        if begin <= at < end:
            out.append(item)
    return out


def _in_template(wrapper: dict) -> Callable[[Block], bool]:
    """Whether a block's text is template, told by texts or by their digests."""
    if "digests" in wrapper:
        return lambda b: bool(wrapper["digests"]) and digest(wrapper["host"], b.place) in wrapper["digests"]
    template = set(wrapper["template"])
    return lambda b: b.place in template


def main_text(page: str, wrapper: dict | None = None) -> str:
    """The main text of a page, read with its host's wrapper; blocks joined by an empty line.

    Where articles decide on the host, blocks of the page's articles are kept; else the page is
    aligned with the expression, and what lies in its stretch of content and in no menu is kept. Left
    out are blocks whose text is template there, and those in regions that markup sets apart, or that
    a class name marks, unless such regions hold the host's content. A page of such a host without an article, without
    a wrapper, with one from too few pages, or of which nothing is kept so, is read by tags and classes.
    """
    if wrapper and wrapper["enough"]:
        repeated, links, rescue = _in_template(wrapper), wrapper["links"], wrapper["rescue"]
        content = lambda b: rescue and (b.main or b.path not in links)
        keeps = lambda b: not b.apart and (not b.marked or content(b)) and not repeated(b)
        if wrapper["main"]:
            found = blocks(page)
            kept = [b for b in found if (b.main or (b.marked and content(b))) and keeps(b)]
        else:
            items = folded(page)
            found = [b for i in items for b in i.blocks]
            kept = [b for i in _in_stretch(items, wrapper) if not i.menu() for b in i.blocks if keeps(b)]
        if not kept:
            # A page of another structure than the sample's.
            kept = [b for b in found if keeps(b) and not any(x.main for x in found) and b.path not in links]
        if kept:
            return "\n\n".join(b.text for b in kept)
    else:
        found = blocks(page)
    plain = [b for b in found if not (b.apart or b.marked)]
    return "\n\n".join(b.text for b in ([b for b in plain if b.main] or plain))


def host_of(url: str = "url"):
    """The host in lower case, without user and port; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[^/?#]*?://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each page (host, html) its id and its places as digests, telling ones first; then, for the
    paths of all pages of a task, on how many pages they are, and are in menus."""
    page_id, paths = TaskContext.get().partitionId() << 40, {}

    def counted():
        rows = [(host, path, n, menus) for (host, path), (n, menus) in paths.items()]
        paths.clear()
        empty = [None] * len(rows)
        return rebatch({"id": empty, "telling": empty, "places": empty} | {k: [r[i] for r in rows] for i, k in enumerate(("host", "path", "n", "menus"))}, _PLACES)

    for batch in batches:
        for a, b in slices(np.diff(ft.utf8(batch.column("html"))[1])):
            part = batch.slice(a, b - a)
            ids, telling_, places = [], [], []
            for host, page in zip(part.column("host").to_pylist(), text_list(part.column("html")), strict=True):
                items = folded(page)
                found = [x for i in items for x in i.blocks]
                own = {x.place for x in telling(found)}
                ids.append(page_id)
                telling_.append(len(own))
                places.append([digest(host, x) for x in [*own, *({x.place for x in found} - own)]])
                page_id += 1
                for path, menu in slot_paths(items).items():
                    n = paths.setdefault((host, path), [0, 0])
                    n[0] += 1
                    n[1] += menu
            empty = [None] * len(ids)
            yield rebatch({"host": part.column("host"), "id": ids, "telling": telling_, "places": places, "path": empty, "n": empty, "menus": empty}, _PLACES)
            if len(paths) > HELD:
                yield counted()
    yield counted()


_PLACES = pa.schema([("host", pa.string()), ("id", pa.int64()), ("telling", pa.int64()), ("places", pa.list_(pa.int64())), ("path", pa.string()), ("n", pa.int64()), ("menus", pa.int64())])


def _repeats(pages: DataFrame) -> DataFrame:
    """(host, digests, links) of the hosts whose pages (host, html) are enough to tell."""
    told = materialize(pages.mapInArrow(_places, "host string, id long, telling long, places array<long>, path string, n long, menus long"))
    # Pages that nothing tells from others weigh nothing.
    own = told.where("telling > 0").withColumn("h", F.xxhash64("host"))
    each = own.select("id", "h", "telling", F.posexplode("places").alias("pos", "place"))
    # A place that one page alone has says nothing more; the others meet their counts.
    common = each.groupBy("place").agg(F.count("*").alias("n")).where("n > 1")
    met = materialize(each.join(common, "place").select("id", "h", "place", "n", (F.col("pos") < F.col("telling")).alias("own"), "telling"))
    counts = met.where("own").groupBy("id").agg(F.sort_array(F.collect_list("n")).alias("c"), F.first("telling").alias("telling"))
    at = F.floor((F.col("telling") + 1) / 2) - 1 - (F.col("telling") - F.size("c"))
    copies = materialize(counts.where(at >= 0).select("id", F.expr(f"{UNIT}L div c[int(floor((telling + 1) / 2) - 1 - (telling - size(c)))]").alias("weight")))
    weight = F.coalesce("weight", F.lit(UNIT))
    total = own.select("id", "h", "host").join(copies, "id", "left").groupBy("h", "host").agg(F.sum(weight).alias("total")).where(F.col("total") >= LEAST_PAGES * UNIT - SLACK)
    total = materialize(total)
    weighed = met.where(F.col("n") >= LEAST_PAGES).join(copies, "id", "left").groupBy("h", "place").agg(F.sum(weight).alias("w")).where(F.col("w") >= LEAST_PAGES * UNIT - SLACK)
    template = weighed.join(total, "h").where(2 * F.col("w") + SLACK >= F.col("total")).groupBy("host").agg(F.collect_list("place").alias("digests"))
    paths = told.where("path is not null").groupBy("host", "path").agg(F.sum("n").alias("n"), F.sum("menus").alias("menus"))
    links = paths.where("menus > 0 and 2 * menus >= n").groupBy("host").agg(F.collect_list("path").alias("links"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    return total.select("host").join(template, "host", "left").join(links, "host", "left").select("host", none("digests", "long"), none("links", "string"))


def _read(pages: DataFrame, learned: DataFrame, each: Callable, schema: str) -> DataFrame:
    """``each`` on pairs of a batch of ``pages`` (host, html, ...) and its rows' wrappers, or None.

    ``learned`` is (host, wrapper as JSON). Wrappers are broadcast behind a check of their size;
    beyond it pages are joined with them by host, and Spark may split the hosts with most pages.
    """
    size = learned.agg(F.sum(F.length("wrapper") + F.length("host") + 64)).first()[0] or 0
    shared = None
    if size <= BROADCAST_CHARS:
        shared = pages.sparkSession.sparkContext.broadcast({r["host"]: r["wrapper"] for r in learned.collect()})
    else:
        pages = pages.join(learned, "host", "left")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[dict | None]]]:
        known: dict[str, dict] = {}
        for batch in batches:
            for a, b in slices(np.diff(ft.utf8(batch.column("html"))[1])):
                part = batch.slice(a, b - a)
                given = part.column("wrapper").to_pylist() if shared is None else [shared.value.get(h) for h in part.column("host").to_pylist()]
                out = []
                for wrapper in given:
                    if wrapper is not None and wrapper not in known:
                        if len(known) > 2000:
                            known.clear()
                        known[wrapper] = json.loads(wrapper)
                        for k in ("digests", "links"):
                            known[wrapper][k] = frozenset(known[wrapper][k])
                    out.append(known.get(wrapper))
                yield part, out

    return pages.mapInArrow(lambda batches: each(pairs(batches)), schema)


def _masses(pairs) -> Iterator[pa.RecordBatch]:
    """The varying text of a task's pages by host, in marked regions, in articles and elsewhere."""
    mass: dict[str, list[int]] = {}
    for part, wrappers_ in pairs:
        for page, wrapper in zip(text_list(part.column("html")), wrappers_, strict=True):
            if wrapper:
                own, repeated = mass.setdefault(wrapper["host"], [0, 0, 0]), _in_template(wrapper)
                for b in blocks(page):
                    if not b.apart and (b.main or b.path not in wrapper["links"]) and not repeated(b):
                        own[0 if b.marked else 1 if b.main else 2] += len(b.text)
    names = ("marked", "main", "open")
    yield rebatch({"host": list(mass)} | {k: [m[i] for m in mass.values()] for i, k in enumerate(names)}, pa.schema([("host", pa.string()), *((k, pa.int64()) for k in names)]))


_KEYS = pa.schema([("host", pa.string()), ("k", pa.int64()), ("len", pa.int64()), ("digest", pa.int64()), ("keys", pa.list_(pa.string()))])


def _structures(pairs) -> Iterator[pa.RecordBatch]:
    """The different structures of a task's pages."""
    seen: set[tuple[str, int]] = set()
    for part, wrappers_ in pairs:
        rows = []
        for page, wrapper in zip(text_list(part.column("html")), wrappers_, strict=True):
            if wrapper:
                keys = tuple(i.key for i in folded(page))
                order = structure_class(keys)
                if (wrapper["host"], order[2]) not in seen:
                    if len(seen) > HELD:
                        seen.clear()
                    seen.add((wrapper["host"], order[2]))
                    rows.append((wrapper["host"], *order, list(keys)))
        yield rebatch({f.name: [r[i] for r in rows] for i, f in enumerate(_KEYS)}, _KEYS)


def _by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One expression for each class of a host, from rows sorted by host, class and order."""
    now, keys = None, ()
    done = lambda: rebatch({"host": [now[0]], "k": [now[1]], "len": [0], "digest": [0], "keys": [list(keys)]}, _KEYS)
    for batch in batches:
        for host, k, more in zip(*(batch.column(c).to_pylist() for c in ("host", "k", "keys")), strict=True):
            if (host, k) != now:
                if now:
                    yield done()
                now, keys = (host, k), ()
            keys = grown(keys, tuple(more))
    if now:
        yield done()


def _held(pairs) -> Iterator[pa.RecordBatch]:
    """The varying text of a task's pages by host and token of its expression."""
    held: dict[str, np.ndarray] = {}
    places: dict[str, dict] = {}
    for part, wrappers_ in pairs:
        for page, wrapper in zip(text_list(part.column("html")), wrappers_, strict=True):
            if wrapper:
                host, repeated = wrapper["host"], _in_template(wrapper)
                own = held.setdefault(host, np.zeros(len(wrapper["keys"]), dtype=np.int64))
                known = places.setdefault(host, {})
                if len(known) > 500:
                    known.clear()
                _hold(own, wrapper["keys"], folded(page), lambda b: not b.apart and (wrapper["rescue"] or not b.marked) and (b.main or b.path not in wrapper["links"]) and not repeated(b), known)  # noqa: B023
    for host, own in held.items():
        yield rebatch({"host": [host] * len(own), "at": range(len(own)), "mass": own}, pa.schema([("host", pa.string()), ("at", pa.int64()), ("mass", pa.int64())]))


def _stretches(pages: DataFrame, learned: DataFrame) -> DataFrame:
    """(host, keys, stretch) of hosts where articles do not decide: the expression of all structures of
    all pages, aligned by classes, and the stretch of it that holds the bulk of all varying text."""
    as_json = lambda rows: rows.select("host", F.to_json(F.struct(*rows.columns)).alias("wrapper"))
    kinds = "host string, k long, len long, digest long, keys array<string>"
    met = pages.join(learned.select("host"), "host", "left_semi")
    found = materialize(_read(met, as_json(learned), _structures, kinds)).dropDuplicates(["host", "digest"])
    dealt = found.repartition("host", "k").sortWithinPartitions("host", "k", "len", "digest")
    parts = dealt.mapInArrow(_by_class, kinds)

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        keys = joined({int(k): tuple(keys) for k, keys in zip(frame["k"], frame["keys"], strict=True)})
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "keys": [list(keys)]})

    keyed = materialize(parts.groupBy("host").applyInPandas(whole, "host string, keys array<string>"))
    held = _read(met, as_json(learned.join(keyed, "host")), _held, "host string, at long, mass long").groupBy("host", "at").agg(F.sum("mass").alias("mass"))
    lists = held.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("at", "mass"))).alias("m")).select("host", F.col("m.mass").alias("mass"))

    def placed(frame: pd.DataFrame) -> pd.DataFrame:
        ends = [list(stretch(list(keys), [int(m) for m in mass])) for keys, mass in zip(frame["keys"], frame["mass"], strict=True)]
        return pd.DataFrame({"host": frame["host"], "keys": frame["keys"], "stretch": ends})

    return keyed.join(lists, "host").mapInPandas(lambda frames: map(placed, frames), "host string, keys array<string>, stretch array<long>")


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper as JSON) from all pages (host, html) with html, of hosts that have enough.

    What ``infer`` says of a list, with digests for the template's texts. Three readings: what pages
    have alike, by aggregates over digests; where the varying text lies; and only for hosts where
    articles do not decide, the expression and its stretch.
    """
    pages = pages.where("html is not null").select("host", "html")
    as_json = lambda rows: rows.select("host", F.to_json(F.struct(*rows.columns)).alias("wrapper"))
    alike = materialize(_repeats(pages))
    mass = _read(pages, as_json(alike), _masses, "host string, marked long, main long, open long").groupBy("host").agg(*[F.sum(c).alias(c) for c in ("marked", "main", "open")])
    decide = F.udf(lambda a, b, c: decisions(a or 0, b or 0, c or 0), "struct<main: boolean, rescue: boolean>")
    learned = alike.join(mass, "host", "left").withColumn("d", decide("marked", "main", "open"))
    learned = materialize(learned.select("host", F.lit(True).alias("enough"), "digests", "links", "d.main", "d.rescue"))
    if not learned.where("not main").isEmpty():
        learned = learned.join(_stretches(pages, learned.where("not main")), "host", "left")
    return as_json(learned)


def _texts(pairs) -> Iterator[pa.RecordBatch]:
    for part, wrappers_ in pairs:
        texts = [main_text(page, wrapper) for page, wrapper in zip(text_list(part.column("html")), wrappers_, strict=True)]
        yield rebatch({"page_id": part.column("page_id"), "url": part.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}, _RESULT)


_RESULT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: the main text of every whole page of ``pages``.

    Null or empty html: empty text. A page of a host without a wrapper (too few different pages) is
    read by tags and classes alone. Repeated rows are read each. No rows: no rows. Other columns of
    ``pages`` are ignored.
    """
    short_batches(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host_of())
    return _read(pages, materialize(wrappers(pages)), _texts, "page_id long, url string, text string, n_chars long")


def op3_html_extraction(spark, sf_dir):
    """The main text of all pages."""
    return extract(spread(table(spark, sf_dir, "pages", "page_id", "url", "html")))
