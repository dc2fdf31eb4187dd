"""Secrets by the cost of guessing values in credential contexts.

A credential context is a key such as ``password``, ``api_key`` or ``token``, a ``:``, ``=``, ``:=`` or ``=>``, and a value. The
value's guess cost is that of its cheapest segmentation into dictionary words, dates, repeats, keyboard walks and brute-force
spans, found by dynamic programming over its characters: each segment costs the logarithm of its guesses, and every further
segment ``JOIN`` for where it begins. A value of at least ``THRESHOLD`` (decimal logarithm of guesses) is a secret; a cheaper one
is a placeholder, a sample or ordinary words.

Words are ranked by the ids of a public vocabulary file of ranks (the commoner, the lower), after well-known passwords.

Defined results: null and empty texts have no values; rows with a null id are scanned like others. Repeated rows repeat their
values. Of segmentations of equal cost one is shown; the cost is the same. A very long text is scanned, and a very long value
costed, in whole. Other columns are not read. An empty table gives an empty result. Values are not given out, only their place (in characters), length and segmentation by kind.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, token_store

THRESHOLD = 8.0
JOIN = math.log10(2)
#: Units of more characters are taken only from the two ends of their run, not from every place in it; the shortest word and walk.
LONG_UNIT, LEAST_WORD, LEAST_WALK = 64, 3, 3

_KEY = r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|auth(?:orization)?|credentials?)"
_SIGN = r"[\"']?[ \t]*(?::=|=>|=|:)"
#: Cheap test of whole texts, without captures, so that most rows never leave Arrow.
HINT = f"(?i){_KEY}{_SIGN}"
#: A bare value ends at a blank, at a closing tag or line break, or where punctuation leads to the next key and sign.
_BARE = rf"(?:(?![\"'<>,;&][^\s\"'<>,;&]*?{_KEY}{_SIGN}|</[a-z][a-z0-9]*>|<br */?>)\S)+"
#: A value that is itself a key and a sign, with a value after them; it is passed over before it is read.
_ITSELF = rf"[\"'(\[{{<]*[\w.-]*?{_KEY}{_SIGN}[ \t]*+\S"
CONTEXT = re.compile(rf"({_KEY}){_SIGN}[ \t]*+(?:(?:bearer|basic)[ \t]+)?+(?!{_ITSELF})(?:\"([^\"\n]+)\"|'([^'\n]+)'|[\"']?({_BARE}))",
    re.I)
_OPEN = {'"': re.compile('"'), "'": re.compile(r"(?<!\w)'|'(?!\w)")}
#: What is not a bare value's own at its end.
_TRAILING = ",;\"'<>"

#: Well-known passwords and placeholders, the commonest first.
KNOWN = (
    "password 123456 123456789 qwerty 12345678 111111 12345 1234567 admin letmein welcome monkey dragon master login abc123 iloveyou "
    "princess sunshine football baseball shadow superman trustno1 secret passw0rd changeme default example test guest root user "
    "hunter2 starwars whatever freedom batman michael jordan charlie ashley bailey donald qazwsx zaq1 access mustang killer pepper "
    "placeholder redacted none null true false undefined your token key here xxx foobar sample demo temp dummy insert enter value"
).split()
LEET = str.maketrans("013457@$!8", "oieastasib")
_ROWS = ["`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./"]
_SHIFTED = str.maketrans('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./")
_PLACE = {c: (x + y / 2, y) for y, row in enumerate(_ROWS) for x, c in enumerate(row, -1 if y == 0 else 0)}
_DATE = re.compile(r"(?=((?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\2(?:0[1-9]|[12]\d|3[01])(?!\d)|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\3(?:19|20)?\d\d|(?:19|20)\d\d))")
_WORDS: dict[str, ahocorasick.Automaton] = {}


def dictionary(path: str = token_store.VOCAB) -> ahocorasick.Automaton:
    """Words by rank: the known ones, then lower-cased words of the vocabulary in order of their ids."""
    if path not in _WORDS:
        rank: dict[str, int] = {}
        with open(path, "rb") as f:
            lines = sorted((int(n), base64.b64decode(t)) for t, n in map(bytes.split, f))
        for w in [*KNOWN, *(t[1:].decode().lower() for _, t in lines if t[:1] == b" " and t[1:].isalpha() and t.isascii())]:
            if len(w) >= LEAST_WORD:
                rank.setdefault(w, len(rank) + 1)
        auto = ahocorasick.Automaton()
        for w, n in rank.items():
            auto.add_word(w, (len(w), n))
        auto.make_automaton()
        _WORDS[path] = auto
    return _WORDS[path]


def alphabet(value: str) -> int:
    """The number of characters that a brute-force guesser of this value tries at each place."""
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
        return 10 if value.isdigit() else 16
    kinds = [(r"[a-z]", 26), (r"[A-Z]", 26), (r"[0-9]", 10), (r"[!-/:-@\[-`{-~ ]", 33), (r"[^ -~]", 100)]
    return max(sum(n for k, n in kinds if re.search(k, value)), 10)


def _near(a: str, b: str) -> tuple[float, float] | None:
    """The step from key to key if they are neighbours, else None."""
    p, q = _PLACE.get(a), _PLACE.get(b)
    if p is None or q is None or a == b:
        return None
    step = (q[0] - p[0], q[1] - p[1])
    return step if abs(step[0]) <= 1 and abs(step[1]) <= 1 else None


def walks(value: str) -> list[tuple[int, int, float]]:
    """(start, end, cost) of keyboard walks: of every maximal run its beginnings and its ends."""
    keys = value.lower().translate(_SHIFTED) if len(value.lower()) == len(value) else value.translate(_SHIFTED)
    steps = [_near(a, b) for a, b in zip(keys, keys[1:])]
    turned = np.concatenate([[0, 0], np.cumsum([a != b for a, b in zip(steps, steps[1:])], dtype=int)])  # changes of direction up to a step
    shifted = np.concatenate([[0], np.cumsum([a.lower() != b for a, b in zip(value, keys)], dtype=int)])
    out, s = [], 0
    for e in range(1, len(keys) + 1):
        if e < len(keys) and steps[e - 1] is not None:
            continue
        if e - s >= LEAST_WALK:
            for x, y in {(s, y) for y in range(s + LEAST_WALK, e + 1)} | {(x, e) for x in range(s, e - LEAST_WALK + 1)}:
                turns = 1 + int(turned[y - 1] - turned[x + 1])
                out.append((x, y, math.log10(47) + turns * math.log10(4.6) + math.log10(y - x) + (JOIN if shifted[y] > shifted[x] else 0)))
        s = e
    return out


def words(value: str, auto: ahocorasick.Automaton) -> list[tuple[int, int, float]]:
    """(start, end, cost) of dictionary words, capitals and look-alike digits costing extra."""
    low = value.lower()
    if len(low) != len(value):
        low = "".join(c.lower()[:1] or c for c in value)
    plain = low.translate(LEET)
    best: dict[tuple[int, int], float] = {}
    for text in {low, plain}:
        for end, (n, rank) in auto.iter(text):
            s, e = end - n + 1, end + 1
            own = value[s:e]
            cost = math.log10(rank)
            upper = sum(c.isupper() for c in own)
            if upper:
                cost += math.log10(2) if upper == n or (upper == 1
                    and (own[0].isupper() or own[-1].isupper())) else math.log10(sum(math.comb(n, k)
                        for k in range(1, min(upper, n - upper) + 1)) or 2)
            if text[s:e] != low[s:e]:
                cost += math.log10(2) * sum(a != b for a, b in zip(text[s:e], low[s:e]))
            if cost < best.get((s, e), math.inf):
                best[s, e] = cost
    return [(s, e, c) for (s, e), c in best.items()]


def dates(value: str) -> list[tuple[int, int, float]]:
    out = []
    for m in _DATE.finditer(value):
        t = m.group(1)
        cost = math.log10(120) if len(t) == 4 and t.isdigit() and t[:2] in ("19", "20") else math.log10(365 * 120)
        out.append((m.start(), m.start() + len(t), cost + (math.log10(4) if not t.isdigit() else 0)))
    return out


def repeats(value: str, cost_of) -> list[tuple[int, int, float]]:
    """(start, end, cost) of units of any length that follow one another at least twice."""
    a = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = []
    for u in range(1, min(LONG_UNIT, len(a) // 2) + 1):
        same = a[:-u] == a[u:]
        edge = np.flatnonzero(np.diff(same, prepend=False, append=False))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
            for x in range(s, min(s + u, e - u + 1)):
                times = (e + u - x) // u
                out.append((x, x + times * u, cost_of(value[x : x + u]) + math.log10(times)))
    for s, e, u in common.runs_of(a, LONG_UNIT + 1).tolist():
        times = (e - s) // u
        unit = value[s : s + u]
        for x in {s, e - times * u} if (unit + unit).find(unit, 1) == u else ():  # a unit that itself repeats is found by its own
            out.append((x, x + times * u, cost_of(value[x : x + u]) + math.log10(times)))
    return out


def cheapest(value: str, auto: ahocorasick.Automaton, units: dict[str, float] | None = None, char: float | None = None) -> tuple[float,
    list[tuple[str, int, int]]]:
    """The decimal logarithm of guesses of the cheapest segmentation, and its (kind, start, end) segments."""
    n = len(value)
    char = math.log10(alphabet(value)) if char is None else char
    units = {} if units is None else units

    def of_unit(unit: str) -> float:
        if unit not in units:
            units[unit] = len(unit) * char  # a unit's own repeats are found at their length
            units[unit] = cheapest(unit, auto, units, char)[0]
        return units[unit]

    ending: dict[int, list[tuple[int, float, str]]] = {}
    for kind, found in (("word", words(value, auto)), ("date", dates(value)), ("walk", walks(value)), ("repeat", repeats(value, of_unit))):
        for s, e, c in found:
            ending.setdefault(e, []).append((s, c, kind))
    # best[i]: any segmentation of the first i characters; loose[i]: one that ends in a brute-force span
    best, loose = [0.0] + [math.inf] * n, [math.inf] * (n + 1)
    back: list[tuple[int, str]] = [(0, "")] * (n + 1)
    from_best = [False] * (n + 1)
    for i in range(1, n + 1):
        fresh = best[i - 1] + char + (JOIN if i > 1 else 0)
        longer = loose[i - 1] + char
        from_best[i] = fresh < longer
        loose[i] = min(fresh, longer)
        best[i], back[i] = loose[i], (-1, "guess")
        for s, c, kind in ending.get(i, ()):
            total = best[s] + c + (JOIN if s else 0)
            if total < best[i]:
                best[i], back[i] = total, (s, kind)
    parts, i = [], n
    while i:
        s, kind = back[i]
        if s < 0:
            s = i
            while not from_best[s]:
                s -= 1
            s -= 1
        parts.append((kind, s, i))
        i = s
    return best[n], parts[::-1]


def values(text: str) -> Iterator[tuple[int, str, str]]:
    """(place, key, value) of the credential contexts of a text.

    A bare value runs to the next blank without punctuation at its end, or to the quote that was open before its key. A value that is
    itself a key and a sign is none; the search goes on inside it.
    """
    at = 0
    while m := CONTEXT.search(text, at):
        k, at = m.lastindex, m.end()
        start, value = m.start(k), m.group(k)
        if k == 4:
            line = text.rfind("\n", 0, m.start()) + 1
            for q, marks in _OPEN.items():
                if (cut := value.find(q)) >= 0 and sum(1 for _ in marks.finditer(text, line, m.start())) % 2:
                    value, at = value[:cut], start + cut
            value = value.rstrip(_TRAILING)
        if value:
            yield start, m.group(1).lower(), value


SCHEMA = "doc_id bigint, place int, context string, n_chars int, log10_guesses double, segments string, secret boolean"


def _scan(path: str, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = dictionary(path)
        for batch in batches:
            hit = batch.filter(pc.fill_null(pc.match_substring_regex(batch.column(1), HINT), False))
            rows = []
            for doc_id, text in zip(hit.column(0).to_pylist(), hit.column(1).to_pylist()):
                for place, key, value in values(text):
                    cost, parts = cheapest(value, auto)
                    rows.append((doc_id, place, key, len(value), round(cost, 6), " ".join(f"{k}:{e - s}" for k, s, e in parts),
                            cost >= threshold))
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                ["doc_id", "place", "context", "n_chars", "log10_guesses", "segments", "secret"])

    return run


def scan(docs: DataFrame, path: str = token_store.VOCAB, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, place, context, n_chars, log10_guesses, segments, secret) of every credential value."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("text").cast("string").alias("text")).mapInArrow(_scan(path, threshold), SCHEMA)
