"""HTML extraction by union-free regular expressions.

The pages of a host are token streams of tags and texts. Consecutive equal groups of tokens are folded into a repeated group,
innermost first, so that pages of one layout share a skeleton however many items they list. A host's distinct skeletons are then
aligned one after the other, the commonest first: where wrapper and skeleton mismatch, the tokens of one side become optional,
and repeated groups of the same opening tag are aligned inside. The result is the host's wrapper, an expression of tags, text
slots, ``(..)?`` and ``(..)+`` without unions; every text of every page belongs to one of its slots. A slot is template text if
all of the host's pages with it (two different ones at least) have the same text there. A page's content is what its other slots
hold, outside navigation, headers, footers, titles and the like.

Only skeletons reach one place, once for a host and layout; texts are counted by slot with partial aggregation.

Defined results: a null html has null text and no slots, an empty one empty text. Pages of null or hostless urls share the
empty host. The slots of a host with one page are all content. Repeated rows give repeated results and no evidence of template.
Layouts that equally many pages have are aligned in the order of their text. Very long pages are read in whole, in time that grows
little faster than they do. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<[!?][^>]*>?|<(/?[a-z][a-z0-9:-]*)([^>]*)>|([^<]+|<)",
    re.I | re.S)
_CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_MARKS = re.compile(r"[#~()<>+]")
_SPACE = re.compile(r"\s+")
#: Elements whose texts are not content.
CHROME = frozenset("nav header footer aside title noscript button select form menu template".split())
CHROME_CLASSES = frozenset("ad ads advert advertisement banner sidebar breadcrumb breadcrumbs nav navbar menu footer header cookie share social"
    .split())
#: Of these, elements that may also enclose a page's content.
WRAPS = frozenset("form header aside menu template".split())
NEVER_WRAPS = frozenset("nav navbar footer breadcrumb breadcrumbs".split())
TEXT = "#"
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def tokens(page: str) -> tuple[list[str], list[str]]:
    """The symbols of a page, tags (with their class) or ``#``, ``~#`` inside chrome; and the texts in order.

    A form, header, aside or the like that holds more than half of the page's text is no chrome: it encloses the content.
    """
    symbols: list[str] = []
    texts: list[str] = []
    where: list[int] = []  # each text's innermost open element of such a name, -1 for none
    outer: list[int] = []  # by element, the one around it
    wraps: list[bool] = []  # by element, whether it may enclose the content
    chrome: list[tuple[str, int]] = []
    names: dict[str, int] = {}
    for m in TOKEN.finditer(page):
        tag, text = m.group(2), m.group(4)
        if text is not None:
            text = _SPACE.sub(" ", html.unescape(text) if "&" in text else text).strip()
            if not text:
                continue
            if symbols and symbols[-1] == TEXT:
                texts[-1] += " " + text
            else:
                symbols.append(TEXT)
                texts.append(text)
                where.append(chrome[-1][1] if chrome else -1)
        elif tag is not None:
            tag = tag.lower()
            if tag[0] == "/":
                if names.get(tag[1:]):
                    while True:  # what it leaves open ends with it
                        name, _ = chrome.pop()
                        names[name] -= 1
                        if name == tag[1:]:
                            break
            else:
                kinds: list[str] = []
                if "class" in m.group(3).lower() and (c := _CLASS.search(m.group(3))):
                    kinds = sorted({*(c.group(1) or c.group(2) or c.group(3) or "").split()})
                named = tag in CHROME or (tag not in VOID and not CHROME_CLASSES.isdisjoint(kinds))
                if named or names.get(tag):  # inside, elements of its name count up to its own end
                    chrome.append((tag, len(outer) if named else chrome[-1][1]))
                    names[tag] = names.get(tag, 0) + 1
                    if named:
                        outer.append(chrome[-2][1] if len(chrome) > 1 else -1)
                        wraps.append(tag in WRAPS if tag in CHROME else NEVER_WRAPS.isdisjoint(kinds))
                tag = ".".join([tag, *kinds])
            symbols.append("<" + _MARKS.sub("_", tag) + ">")
    if outer:
        held = [0] * len(outer)
        for k, t in zip(where, texts):
            if k >= 0:
                held[k] += len(t)
        for k in range(len(outer) - 1, -1, -1):  # an element comes after the one around it
            if outer[k] >= 0:
                held[outer[k]] += held[k]
        most = sum(map(len, texts)) / 2
        is_chrome = [False] * len(outer)
        for k in range(len(outer)):
            is_chrome[k] = not wraps[k] or held[k] <= most or (outer[k] >= 0 and is_chrome[outer[k]])
        marks = iter(where)
        symbols = ["~" + TEXT if x == TEXT and (k := next(marks)) >= 0 and is_chrome[k] else x for x in symbols]
    return symbols, texts


class Group(NamedTuple):
    """A repeated group of nodes."""

    body: tuple


Node = str | Group


def _opens(x: Node) -> str:
    while isinstance(x, Group):
        x = x.body[0]
    return x


def _element(head: Node, tail: Node) -> bool:
    """Whether nodes from ``head`` to ``tail`` could be an item: they begin with a tag that their end, if it closes anything, closes."""
    first = _opens(head)
    if first[0] != "<" or first[1] == "/":
        return False
    if isinstance(tail, Group) or tail[0] != "<":
        return True
    return tail[1] != "/" or tail[2:-1] == first[1:-1].split(".")[0]


def fold(symbols: list[str]) -> tuple[list[Node], list[list[list[int]]]]:
    """The nodes of a page with repeated groups folded, and each node's texts as places among the symbols.

    Texts are listed by slot of the node, so that all rounds of a group share one.
    """
    return fold_all([symbols])[0]


def fold_all(pages: list[list[str]]) -> list[tuple[list[Node], list[list[list[int]]]]]:
    """``fold`` for many pages at once.

    Each round finds all maximal repetitions and folds those that no foldable one of a shorter period overlaps; what they become is looked
    at in the next. All pages are one sequence, parted by numbers that occur once.
    """
    known: dict = {}
    nodes: list[list[Node]] = [list(p) for p in pages]
    held = [[[[i]] if s[-1] == TEXT else [] for i, s in enumerate(p)] for p in pages]
    ids = [[known.setdefault(x, len(known)) for x in p] for p in pages]
    active = list(range(len(pages)))
    while active:
        starts = np.zeros(len(active) + 1, np.int64)
        np.cumsum([len(ids[k]) + 1 for k in active], out=starts[1:])
        a = np.concatenate([np.array([*ids[k], len(known) + j], np.int64) for j, k in enumerate(active)])
        found = common.runs_of(a, most=max(len(ids[k]) for k in active) // 2)
        found = found[np.lexsort((found[:, 0], found[:, 2]))]
        page = np.searchsorted(starts, found[:, 0], "right") - 1
        folds: dict[int, list[tuple[int, int, int]]] = {}
        taken = bytearray(len(a) + 1)
        for j, (s, e, unit) in zip(page.tolist(), found.tolist()):
            base = int(starts[j])
            own = nodes[active[j]]
            s, e = s - base, e - base
            start = next((x for x in range(s, min(s + unit, e - 2 * unit + 1)) if _element(own[x], own[x + unit - 1])), -1)
            if start < 0:
                continue
            times = (e - start) // unit
            lo, hi = base + start, base + start + times * unit
            if taken.find(1, lo, hi) < 0:
                folds.setdefault(j, []).append((start, unit, times))
            taken[lo:hi] = b"\1" * (hi - lo)
        for j, cuts in folds.items():
            _fold_at(active[j], sorted(cuts), nodes, held, ids, known)
        active = [active[j] for j in folds]
    return list(zip(nodes, held))


def _fold_at(page: int, cuts: list[tuple[int, int, int]], nodes: list, held: list, ids: list, known: dict) -> None:
    """Puts groups in the place of (start, unit, times) of one page."""
    old, old_held, old_ids = nodes[page], held[page], ids[page]
    new: list[Node] = []
    new_held: list[list[list[int]]] = []
    new_ids: list[int] = []
    at = 0
    for start, unit, times in cuts:
        new += old[at:start]
        new_held += old_held[at:start]
        new_ids += old_ids[at:start]
        at = start + unit * times
        slots: list[list] = [[] for _ in range(sum(len(h) for h in old_held[start : start + unit]))]
        for t in range(times):
            k = 0
            for h in old_held[start + t * unit : start + (t + 1) * unit]:
                for x in h:
                    slots[k] += x
                    k += 1
        body = tuple(old[start : start + unit])
        again = unit == 1 and isinstance(body[0], Group)
        new.append(body[0] if again else Group(body))
        new_held.append(slots)
        new_ids.append(old_ids[start] if again else known.setdefault(tuple(old_ids[start : start + unit]), len(known)))
    nodes[page], held[page], ids[page] = new + old[at:], new_held + old_held[at:], new_ids + old_ids[at:]


def slots_of(nodes) -> int:
    return sum(slots_of(x.body) if isinstance(x, Group) else x[-1] == TEXT for x in nodes)


def shown(nodes) -> str:
    """A wrapper or skeleton as text."""
    return "".join("(" + shown(x.body) + ")+" if isinstance(x, Group) else x for x in nodes)


_PART = re.compile(r"\(|\)\+|<[^>]*>|~?#")


def parsed(text: str) -> list[Node]:
    """The inverse of ``shown``."""
    stack: list[list] = [[]]
    for m in _PART.finditer(text):
        p = m.group()
        if p == "(":
            stack.append([])
        elif p == ")+":
            body = tuple(stack.pop())
            stack[-1].append(Group(body))
        else:
            stack[-1].append(p)
    return stack[0]


class Item:
    """A node of a wrapper: a symbol, or a body for a repeated group; optional or not; a slot number for text."""

    __slots__ = ("symbol", "body", "optional", "slot")

    def __init__(self, node: Node, count: list[int]) -> None:
        self.symbol, self.body, self.optional, self.slot = None, None, False, -1
        if isinstance(node, Group):
            self.body = [Item(x, count) for x in node.body]
            self.symbol = "+" + _opens(node)
        else:
            self.symbol = node
            if node[-1] == TEXT:
                self.slot = count[0]
                count[0] += 1

    def slots(self) -> list[int]:
        return [s for x in self.body for s in x.slots()] if self.body is not None else [self.slot] if self.slot >= 0 else []

    def __str__(self) -> str:
        own = "(" + "".join(map(str, self.body)) + ")+" if self.body is not None else self.symbol
        return f"({own})?" if self.optional else own


#: Cells of a table of common subsequence lengths; longer pairs are halved first.
CELLS = 1 << 22


def common_places(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The places of a longest common subsequence, in linear memory."""
    n, m = len(a), len(b)
    if not n or not m:
        return []

    def lengths(x: np.ndarray, y: np.ndarray) -> Iterator[np.ndarray]:
        row = np.zeros(len(y) + 1, np.int32)
        yield row
        for v in x:
            after = row.copy()
            np.maximum(row[1:], row[:-1] + (y == v), out=after[1:])
            row = np.maximum.accumulate(after)
            yield row

    if n > 1 and n * m > CELLS:
        half = n // 2
        for fore in lengths(a[:half], b):
            pass
        for back in lengths(a[half:][::-1], b[::-1]):
            pass
        cut = int((fore + back[::-1]).argmax())
        return common_places(a[:half], b[:cut]) + [(half + i, cut + j) for i, j in common_places(a[half:], b[cut:])]
    table = list(lengths(a, b))
    out, i, j = [], n, m
    while i and j:
        if a[i - 1] == b[j - 1] and table[i][j] == table[i - 1][j - 1] + 1:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif table[i - 1][j] == table[i][j]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def align(wrapper: list[Item], nodes: list[Node], count: list[int]) -> tuple[list[Item], list[int]]:
    """The wrapper that also accepts ``nodes``, by longest common subsequence; and the slots of the nodes' texts in order."""
    names = ["+" + _opens(x) if isinstance(x, Group) else x for x in nodes]
    n, m = len(wrapper), len(names)
    lo = 0
    while lo < min(n, m) and wrapper[lo].symbol == names[lo]:
        lo += 1
    hi = 0
    while hi < min(n, m) - lo and wrapper[n - 1 - hi].symbol == names[m - 1 - hi]:
        hi += 1
    known: dict[str, int] = {}
    number = lambda x: np.array([known.setdefault(y, len(known)) for y in x], np.int64)
    inside = common_places(number([x.symbol for x in wrapper[lo : n - hi]]), number(names[lo : m - hi]))
    pairs = [(k, k) for k in range(lo)] + [(lo + i, lo + j) for i, j in inside] + [(n - hi + k, m - hi + k) for k in range(hi)]
    merged: list[Item] = []
    slots: list[int] = []
    i = j = 0
    for x, y in [*pairs, (n, m)]:
        for item in wrapper[i:x]:
            item.optional = True
            merged.append(item)
        for node in nodes[j:y]:
            fresh = Item(node, count)
            fresh.optional = True
            slots += fresh.slots()
            merged.append(fresh)
        if x < n:
            item = wrapper[x]
            if item.body is not None:
                item.body, inner = align(item.body, list(nodes[y].body), count)
                slots += inner
            elif item.slot >= 0:
                slots.append(item.slot)
            merged.append(item)
        i, j = x + 1, y + 1
    return merged, slots


def infer(skeletons: list[str]) -> tuple[str, list[list[int]]]:
    """The wrapper of skeletons in their order, and each one's slots."""
    count = [0]
    wrapper: list[Item] = []
    slots: list[list[int]] = []
    for k, s in enumerate(skeletons):
        nodes = parsed(s)
        if not k:
            wrapper = [Item(x, count) for x in nodes]
            slots.append([x for i in wrapper for x in i.slots()])
        else:
            wrapper, own = align(wrapper, nodes, count)
            slots.append(own)
    return "".join(map(str, wrapper)), slots


def host_of(url: str | None) -> str:
    if not url or "//" not in url:
        return ""
    return re.split(r"[/?#]", url.split("//", 1)[1], maxsplit=1)[0].rpartition("@")[2].partition(":")[0].lower()


PARTS = "page_id bigint, url string, host string, layout bigint, skeleton string, page bigint, texts array<struct<place:int,text:string,h:bigint>>"
_KIND = pa.list_(pa.struct([("place", pa.int32()), ("text", pa.string()), ("h", pa.int64())]))


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


#: Symbols of pages that are folded together.
TOGETHER = 50_000


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches):
        rows: list[list] = []
        waiting: dict[tuple, list[tuple[int, list[str]]]] = {}  # rows and texts by symbols
        size = 0

        def finish() -> None:
            for symbols, (nodes, held) in zip(list(waiting), fold_all([list(x) for x in waiting])):
                skeleton = shown(nodes)
                order = {s: k for k, s in enumerate(i for i, s in enumerate(symbols) if s[-1] == TEXT)}
                place = [0] * len(order)
                for k, own in enumerate(x for h in held for x in h):
                    for i in own:
                        place[order[i]] = k
                for at, texts in waiting[symbols]:
                    found = [{"place": p, "text": t, "h": _hash(t)} for p, t in zip(place, texts)]
                    rows[at] += [_hash(skeleton), skeleton, _hash("\0".join(texts)), found]
            waiting.clear()

        for page_id, url, page in zip(*(c.to_pylist() for c in batch.columns)):
            rows.append([page_id, url, host_of(url)])
            if page is None:
                rows[-1] += [None] * 4
                continue
            symbols, texts = tokens(page)
            key = tuple(symbols)
            size += len(key) if key not in waiting else 0
            waiting.setdefault(key, []).append((len(rows) - 1, texts))
            if size > TOGETHER:
                finish()
                size = 0
        finish()
        cols = list(zip(*rows)) or [()] * 7
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), _KIND]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
            ["page_id", "url", "host", "layout", "skeleton", "page", "texts"])


WRAPPERS = "host string, layout bigint, wrapper string, slots array<int>, chrome array<boolean>"


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for host, layouts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            layouts.sort(key=lambda x: (-x["n"], x["skeleton"]))
            wrapper, slots = infer([x["skeleton"] for x in layouts])
            chrome = [[m == "~#" for m in re.findall(r"~?#", x["skeleton"])] for x in layouts]
            cols = [pa.array([host] * len(layouts)), pa.array([x["layout"] for x in layouts], pa.int64()),
                pa.array([wrapper] * len(layouts)), pa.array(slots, pa.list_(pa.int32())), pa.array(chrome, pa.list_(pa.bool_()))]
            yield pa.RecordBatch.from_arrays(cols, ["host", "layout", "wrapper", "slots", "chrome"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, n_slots, n_template, text) of every page: slots of its wrapper that it fills, those of template, its content."""
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"))
    cut = common.saved(own.mapInArrow(_cut, PARTS), "cut")
    full = cut.where("layout IS NOT NULL")
    layouts = full.groupBy("host", "layout").agg(F.count("*").alias("n"), F.min("skeleton").alias("skeleton"))
    by_host = layouts.groupBy("host").agg(F.collect_list(F.struct("layout", "skeleton", "n")).alias("layouts"))
    wrappers = common.saved(by_host.mapInArrow(_infer, WRAPPERS), "wrappers")
    side = common.small(wrappers)

    seen = full.select("host", "layout", "page", F.inline("texts")).groupBy("host", "layout", "place")
    span = lambda d: d.agg(*(f(c).alias(f"{c}_{k}") for c in ("h", "page") for k, f in (("lo", F.min), ("hi", F.max))))
    again = lambda d: d.agg(*(f(f"{c}_{k}").alias(f"{c}_{k}") for c in ("h", "page") for k,
            f in (("lo", F.min), ("hi", F.max))))
    placed = span(seen).join(side, ["host", "layout"]).withColumn("slot", F.element_at("slots", F.col("place") + 1))
    fixed = again(placed.groupBy("host", "slot")).where("h_lo = h_hi AND page_lo <> page_hi").groupBy("host").agg(F.collect_set("slot")
        .alias("fixed"))
    plan = wrappers.join(fixed, "host", "left").select("host", "layout", F.size("slots").alias("n_slots"),
        F.zip_with("slots", "chrome", lambda s, c: F
            .named_struct(F.lit("fixed"), F.coalesce(F.array_contains("fixed", s), F.lit(False)), F.lit("chrome"), c)).alias("flags"))
    plan = common.saved(plan, "flags")
    out = cut.join(common.small(plan), ["host", "layout"], "left")
    flag = lambda x: F.element_at("flags", x["place"] + 1)
    kept = F.filter("texts", lambda x: ~flag(x)["fixed"] & ~flag(x)["chrome"])
    text = F.array_join(F.transform(kept, lambda x: x["text"]), "\n")
    return out.select("page_id", "url", "host", F.coalesce("n_slots", F.lit(0)).alias("n_slots"),
        F.coalesce(F.size(F.filter("flags", lambda f: f["fixed"])), F.lit(0)).alias("n_template"), text.alias("text"))
