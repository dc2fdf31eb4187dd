"""Toxicity by a weighted lexicon.

Texts are folded (look-alike letters of other scripts, accents, digit and symbol substitutions, invisible characters) and
matched by an Aho-Corasick automaton. Learned terms weigh by their odds. A hit counts at word borders and outside exception phrases; the score is the weight of
the hits per 100 words. Terms of other vocabularies are learned: word beginnings that mark documents labelled toxic, from a
sample of at most ``LABEL_ROWS`` labelled rows of each class (the only bounded part; scoring covers all texts in whole).

Defined results: null and empty texts score 0. Null ids are scored like others. Repeated rows score alike. A text that scores
exactly the threshold is rejected; of overlapping hits of equal weight and length the first counts. Very long texts are scored in
whole. Other columns of any name pass through the filter untouched. An empty table gives an empty result; without labels nothing
is learned.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Score from which a document is rejected, in weight per 100 words.
THRESHOLD = 0.8
#: Labelled rows of each class at most that terms are learned from.
LABEL_ROWS = 6000
#: A learned term begins at least so many sampled toxic documents' words, and its rate in words there is so many times (as a logarithm) that in others; the last is the same for documents.
LEAST_DOCS, LEAST_ODDS, LEAST_DOC_ODDS = 8, 3.0, 1.9
#: A learned term weighs its logarithm of odds over this one, at most so much.
UNIT_ODDS, MOST_LEARNED = 3.8, 2.0
PREFIXES = range(4, 10)

#: Insults by weight.
LEXICON = {
    "idiot": 3.0, "idiots": 3.0, "idiotic": 2.5, "moron": 3.0, "morons": 3.0, "moronic": 2.5, "stupid": 2.5, "stupidity": 2.0,
        "imbecile": 3.0, "dumb": 1.5, "dumbass": 4.0,
    "loser": 2.5, "losers": 2.5, "scum": 3.0, "scumbag": 4.0, "trash": 2.0, "garbage": 1.0, "clown": 2.0, "clowns": 1.5, "pathetic": 2.5,
        "worthless": 2.5, "disgusting": 2.0,
    "vermin": 3.0, "filth": 2.0, "parasite": 1.5, "degenerate": 2.5, "subhuman": 5.0, "freak": 2.0, "pig": 1.0, "cretin": 3.0,
        "retard": 4.0, "retarded": 4.0, "jerk": 2.0,
    "bastard": 3.5, "bitch": 4.0, "slut": 4.5, "whore": 4.5, "asshole": 4.0, "shit": 3.0, "bullshit": 2.5, "fuck": 4.0, "fucking": 3.5,
        "crap": 1.5, "damn": 0.5, "hate you": 3.0,
    "kill yourself": 6.0, "shut up": 2.0, "drop dead": 4.0, "go to hell": 3.0, "piece of shit": 4.0, "waste of space": 3.0,
        "nobody likes you": 3.0,
    "idiota": 3.0, "imbecil": 3.0, "estupido": 3.0, "estupida": 3.0, "basura": 2.0, "mierda": 3.0, "puta": 4.0, "idioten": 3.0,
        "dummkopf": 3.0, "arschloch": 4.0, "scheisse": 3.0,
    "abschaum": 3.0, "salaud": 3.5, "connard": 4.0, "merde": 3.0, "debile": 2.5, "cretino": 3.0,
}
EXCEPTIONS = ["trash can", "trash cans", "trash bin", "garbage collection", "garbage collector", "clown fish", "class clown", "idiot proof",
    "sore loser award", "guinea pig", "pig iron", "knee jerk", "jerk chicken", "dumb terminal", "dumb bell", "white trash cinema"]

_GONE, _GAP, _SYMBOL = 0, 32, 128


def _table() -> np.ndarray:
    """By code point: 0 goes, a space parts words, a letter or digit stands for what it looks like; symbols have 128 added."""
    t = np.full(0x20000, _GAP, np.uint8)
    like = {"l": "i", "1": "i", "0": "o", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "ß": "s", "æ": "a", "œ": "o",
        "ø": "o", "đ": "d", "ı": "i", "ł": "i"}
    cyrillic = dict(zip("абвгеёзикмнорстухцьіјѕһԁԛԝ", "abbreevukmhopcтyxubijshdqw".replace("т", "t")))
    cyrillic |= {"и": "u", "к": "k", "м": "m", "н": "h", "з": "e", "в": "b", "г": "r", "п": "n", "т": "t", "с": "c", "у": "y", "ѵ": "v",
        "ո": "n", "ս": "u"}
    greek = dict(zip("αβγδεζηικλνορστυχω", "abydeznikivopotuxw")) | {"μ": "u", "ς": "s", "σ": "o"}
    for cp in range(len(t)):
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind in ("Mn", "Me", "Cf"):
            t[cp] = _GONE
            continue
        base = unicodedata.normalize("NFKD", c)[0].lower()[:1] or c
        base = cyrillic.get(base, greek.get(base, like.get(base, base)))
        base = like.get(base, base)
        if base.isascii() and base.isalnum():
            t[cp] = ord(base)
        elif kind[0] in "LN":
            t[cp] = ord("~")  # a letter that is like none
    for c, to in {"$": "s", "@": "a", "!": "i", "|": "i", "+": "t", "€": "e", "£": "i", "¡": "i"}.items():
        t[ord(c)] = ord(to) + _SYMBOL
    return t


_FOLD: list[np.ndarray] = []


def fold(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The folded texts as one array of bytes, with a newline after each; where each begins; whether a byte was a letter or digit.

    Runs of what parts words are one space. A symbol stands for a letter only as it looks (``$`` as ``s``), and also parts words.
    """
    if not _FOLD:
        _FOLD.append(_table())
    whole = "\n".join("" if t is None else t.replace("\n", " ") for t in texts) + "\n"
    code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _FOLD[0][np.minimum(code, len(_FOLD[0]) - 1)]
    out[code == 10] = 10
    out = out[out != _GONE]
    gap = out == _GAP
    gap[1:] &= gap[:-1]
    gap[:1] = False
    out = out[~gap]
    solid = (out < _SYMBOL) & (out > 47)
    out &= 127
    starts = np.flatnonzero(out == 10) + 1
    return out, np.concatenate([[0], starts]), solid


def folded(term: str) -> str:
    return fold([term])[0].tobytes().decode()[:-1].strip()


class Matcher:
    """Counts words, hits and weight in batches of texts. Terms: {term: weight}; beginnings match at the start of a word only."""

    def __init__(self, terms: dict[str, float], beginnings: dict[str, float] | None = None, exceptions: list[str] = EXCEPTIONS) -> None:
        self.auto = ahocorasick.Automaton()
        found: dict[str, tuple[int, bool, float]] = {}
        for t, w in (beginnings or {}).items():
            found[folded(t)] = (len(folded(t)), False, w)
        for t, w in terms.items():
            found[folded(t)] = (len(folded(t)), True, w)
        for t in exceptions:
            found[folded(t)] = (len(folded(t)), True, 0.0)
        for t, x in found.items():
            if t:
                self.auto.add_word(t, x)
        self.auto.make_automaton()

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        text, starts, solid = fold(texts)
        word = np.concatenate([[False], solid, [False]])
        ends = np.flatnonzero(word[:-1] & ~word[1:])  # the place after each word
        words = np.diff(np.searchsorted(ends, starts, "right"))
        hits, weight = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        spans, safe = [], []
        for end, (n, closed, w) in self.auto.iter(text.tobytes().decode("ascii")):
            begin = end - n + 1
            if not word[begin] and (not closed or not word[end + 2]):
                (spans if w else safe).append((begin, end, w))
        if not spans:
            return words, hits, weight
        b, e, w = (np.array(x) for x in zip(*spans))
        keep = np.ones(len(b), bool)
        if safe:
            # inside an exception: of those that begin no later, the one that ends last ends no earlier
            safe.sort()
            sb, reach = np.array([x[0] for x in safe]), np.maximum.accumulate([x[1] for x in safe])
            before = np.searchsorted(sb, b, "right") - 1
            keep = (before < 0) | (reach[np.maximum(before, 0)] < e)
        # of overlapping hits the heaviest, then the longest counts
        order = np.lexsort((b - e, -w))
        taken = np.zeros(len(text), bool)
        for i in order[keep[order]]:
            if not taken[b[i] : e[i] + 1].any():
                taken[b[i] : e[i] + 1] = True
                d = np.searchsorted(starts, b[i], "right") - 1
                hits[d] += 1
                weight[d] += w[i]
        return words, hits, weight


@common.trimmed
def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        count: dict[tuple[str, int], list[int]] = {}
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = fold([text])[0].tobytes().decode("ascii").split()
            own: dict[str, int] = {"": len(words)}
            for w in words:
                for n in PREFIXES:
                    if len(w) >= n:
                        own[w[:n]] = own.get(w[:n], 0) + 1
            for p, n in own.items():
                x = count.setdefault((p, toxic), [0, 0])
                x[0] += 1
                x[1] += n
        if count:
            keys, n = list(count), list(count.values())
            cols = [pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int32()), pa.array([x[0] for x in n], pa.int64()),
                pa.array([x[1] for x in n], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["term", "toxic", "docs", "n"])


def learn(docs: DataFrame, labels: DataFrame, rows: int = LABEL_ROWS) -> dict[str, float]:
    """Word beginnings far more frequent in toxic documents, without those that a shorter one covers. No labels: none."""
    own = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = own.where("toxic = 1").orderBy(*order).limit(rows).unionByName(own.where("toxic = 0").orderBy(*order).limit(rows))
    joined = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text IS NOT NULL").join(F.broadcast(sample),
        "doc_id").select("text", "toxic").distinct()
    of = lambda k, c: F.coalesce(F.sum(F.when(F.col("toxic") == k, F.col(c))), F.lit(0)).cast("double")
    seen = joined.mapInArrow(_beginnings, "term string, toxic int, docs bigint, n bigint").groupBy("term")
    seen = common.saved(seen.agg(of(1, "docs").alias("d"), of(0, "docs").alias("e"), of(1, "n").alias("a"), of(0, "n").alias("b"))
        .where(f"term = '' OR d >= {LEAST_DOCS}"), "terms")
    whole = seen.where("term = ''").first()
    if whole is None or not whole.a or not whole.b:
        return {}
    odds = F.log((F.col("a") + 0.5) / whole.a) - F.log((F.col("b") + 0.5) / whole.b)
    in_docs = F.log((F.col("d") + 0.5) / whole.d) - F.log((F.col("e") + 0.5) / whole.e)
    told = seen.where("term <> ''").where((odds >= LEAST_ODDS) & (in_docs >= LEAST_DOC_ODDS)).select("term", odds.alias("odds")).collect()
    given = [folded(t) for t in LEXICON]  # these match as whole words
    kept: dict[str, float] = {}
    last = None
    for r in sorted(told, key=lambda r: r.term):
        if any(x.startswith(r.term) for x in given):
            continue
        weight = min(r.odds / UNIT_ODDS, MOST_LEARNED)
        if last is None or not r.term.startswith(last):
            last = r.term
            kept[last] = weight
    return kept


def _score(learned: dict[str, float]):
    @common.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(LEXICON, learned)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in common.chunks(texts):
                words, hits, weight = match(texts[i:j])
                score = 100 * weight / np.maximum(words, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(score), pa.array(hits), pa.array(words)],
                    ["doc_id", "score", "hits", "words"])

    return run


def scores(docs: DataFrame, labels: DataFrame | None = None, learned: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, score, hits, words) of every row."""
    if learned is None:
        learned = learn(docs, labels) if labels is not None else {}
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_score(learned),
        "doc_id bigint, score double, hits bigint, words bigint")


def toxic(docs: DataFrame, labels: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, hits, words) of the documents that the filter rejects."""
    return scores(docs, labels).where(F.col("score") >= threshold)


def reject(docs: DataFrame, labels: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose text scores ``threshold`` or more, in one pass over them."""
    learned = learn(docs, labels) if labels is not None else {}
    at = docs.columns.index("text")

    @common.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(LEXICON, learned)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            keep = []
            for i, j in common.chunks(texts):
                words, _, weight = match(texts[i:j])
                keep.append(100 * weight / np.maximum(words, 1) < threshold)
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names of any kind
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
