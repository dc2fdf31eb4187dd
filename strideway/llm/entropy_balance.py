"""Mixing sources to target weights by entropy balancing.

Document rates stay as near to 1 as the token constraints allow: with ``n`` the words of a document, the sum of
``n (r log r - r + 1)`` is least subject to the token totals of every source and language and to the token-weighted mean of
the log length. The solution tilts each document exponentially, ``r = exp(a[source] + b[language] + c z)``, and its
multipliers are the optimum of a convex dual, found by damped Newton steps. Each step is one distributed aggregation of the
gradient's and Hessian's sums by (source, language), the constraints' categories, so that what reaches the driver does not grow
with the documents. Targets that no rates can meet (a source whose only language is wanted less, say) are moved half-way to the
present totals until some can; the result says how far it went. Rates are rounded to copies: the whole part, and one more where a hash of the id falls below the rest.

Defined results: null sources and languages are categories of their own. Null and empty texts have no words, hence no part
in the constraints; their rate follows their categories with ``z = 0``. Rows that repeat an id get the same number of copies if
their rates are equal. Very long texts count with all their words. Other columns of any name stay. An empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A category's target share is its share of tokens to this power, rescaled to sum to 1.
TEMPERATURE = 0.7
STEPS = 60
TOLERANCE = 1e-9
#: A solution meets its constraints to this share of all tokens, with logarithms of rates below ``LARGEST``.
MET, LARGEST = 1e-7, 10.0
#: How often targets that no such rates meet are moved half-way to the present totals; then the present ones are kept.
HALVINGS = 8


def words(text):
    """Words of a text as a double, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("double")


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, n, z): words, and log length (both about 0 for none)."""
    out = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"), words(F.col("text")).alias("n"))
    return out.withColumn("z", F.when(F.col("n") > 0, F.log("n")).otherwise(0.0))


def targets(tokens: np.ndarray, temperature: float = TEMPERATURE) -> np.ndarray:
    """Target token totals of categories: their tempered shares of the sum."""
    w = np.where(tokens > 0, np.maximum(tokens, 1e-300) ** temperature, 0.0)
    return w / w.sum() * tokens.sum()


def solve(cells, sums, temperature: float = TEMPERATURE, source_weights: dict | None = None,
    lang_weights: dict | None = None) -> tuple[dict, dict, float, float, float]:
    """Multipliers by source and by language, that of z, the mean of z that z is taken from, and how far towards the targets it went (1: all the way).

    ``cells``: rows (source, lang, tokens, tokens * z); ``sums(c, mean)``: for each cell its sums of ``n e^(c (z - mean))`` times
    1, z - mean and its square.
    """
    sources = sorted({r[0] for r in cells}, key=lambda x: (x is not None, x))
    langs = sorted({r[1] for r in cells}, key=lambda x: (x is not None, x))
    si, li = {s: i for i, s in enumerate(sources)}, {x: i for i, x in enumerate(langs)}
    tokens = np.array([r[2] for r in cells])
    s, lg = np.array([si[r[0]] for r in cells]), np.array([li[r[1]] for r in cells])
    total = tokens.sum()
    mean = float(sum(r[3] for r in cells) / total)
    p, q = len(sources), len(langs)

    def want(at: np.ndarray, names: list, given: dict | None) -> np.ndarray:
        own = np.bincount(at, tokens, len(names))
        if given is None:
            return targets(own, temperature)
        w = np.array([given.get(x, 0.0) for x in names]) * (own > 0)
        return w / w.sum() * total

    goal = np.concatenate([want(s, sources, source_weights), want(lg, langs, lang_weights), [0.0]]) / total
    present = np.concatenate([np.bincount(s, tokens, p), np.bincount(lg, tokens, q), [0.0]]) / total
    rest = np.stack([lg, np.full(len(cells), q)], axis=1)  # a cell's constraints besides its source

    def dual(theta: np.ndarray, goal: np.ndarray):
        """Value, gradient and Hessian; of this the sources' part is a diagonal, as a cell has one source."""
        tilt = np.exp(np.clip(theta[s] + theta[p + lg], -50, 50))
        m = np.asarray(sums(theta[-1], mean), float) * tilt[:, None] / total
        value = m[:, 0].sum() - theta @ goal
        grad = np.concatenate([np.bincount(s, m[:, 0], p), np.bincount(lg, m[:, 0], q), [m[:, 1].sum()]]) - goal
        own = np.bincount(s, m[:, 0], p)
        cross, other = np.zeros((p, q + 1)), np.zeros((q + 1, q + 1))
        for k, w in enumerate((m[:, 0], m[:, 1])):
            np.add.at(cross, (s, rest[:, k]), w)
        other[np.arange(q), np.arange(q)] = np.bincount(lg, m[:, 0], q)
        other[-1, :-1] = other[:-1, -1] = np.bincount(lg, m[:, 1], q)
        other[-1, -1] = m[:, 2].sum()
        return value, grad, (own, cross, other)

    def downhill(hess, grad: np.ndarray) -> np.ndarray:
        """Newton's step: the sources are eliminated, so that what is solved is as small as the languages."""
        own, cross, other = hess
        own = np.maximum(own, 1e-300)
        left = other - cross.T @ (cross / own[:, None])
        small = np.linalg.lstsq(left + 1e-14 * np.eye(q + 1), grad[p:] - cross.T @ (grad[:p] / own), rcond=1e-12)[0]
        return -np.concatenate([(grad[:p] - cross @ small) / own, small])

    def newton(goal: np.ndarray) -> tuple[np.ndarray, bool]:
        theta = np.zeros(p + q + 1)
        value, grad, hess = dual(theta, goal)
        for _ in range(STEPS):
            if np.abs(grad).max() < TOLERANCE or np.abs(theta).max() > 2 * LARGEST:
                break
            step = downhill(hess, grad)
            size = 1.0
            while True:
                after = dual(theta + size * step, goal)
                # near the optimum values differ by less than their rounding, so that a smaller gradient counts too
                if after[0] <= value + 1e-4 * size * (grad @ step) or np.abs(after[1]).max() < np.abs(grad).max() / 2 or size < 1e-6:
                    break
                size /= 2
            if np.abs(after[1]).max() >= np.abs(grad).max() and (after[0] >= value or size < 1e-6):
                break  # as near as the numbers allow
            theta = theta + size * step
            value, grad, hess = after
        tilt = np.abs(theta[s] + theta[p + lg]).max() + np.log(1e6) * abs(theta[-1])
        return theta, bool(np.abs(grad).max() < MET and tilt < LARGEST)

    for share in (*(0.5**k for k in range(HALVINGS)), 0.0):
        theta, met = newton(present + share * (goal - present))
        if met:
            break
    return {v: float(theta[i]) for v, i in si.items()}, {v: float(theta[p + i]) for v, i in li.items()}, float(theta[-1]), mean, share


def fit(table: DataFrame, **how) -> tuple[dict, dict, float, float, float]:
    """``solve`` over a table of ``features``."""
    n, z = F.col("n"), F.col("z")
    full = table.where("n > 0")
    cells = [tuple(r) for r in full.groupBy("source", "lang").agg(F.sum("n"), F.sum(n * z)).collect()]
    if not cells:
        return {}, {}, 0.0, 0.0, 1.0
    place = {c[:2]: i for i, c in enumerate(cells)}

    def sums(c: float, mean: float) -> np.ndarray:
        d = z - F.lit(mean)
        w = n * F.exp(F.lit(c) * d)
        out = np.zeros((len(cells), 3))
        for r in full.groupBy("source", "lang").agg(F.sum(w), F.sum(w * d), F.sum(w * d * d)).collect():
            out[place[r[0], r[1]]] = r[2:]
        return out

    return solve(cells, sums, **how)


def _priced(df: DataFrame, columns: dict[str, str], found: tuple[dict, dict, float, float, float]) -> DataFrame:
    """``df`` with columns ``rate`` and ``copies`` under the given names; ``columns`` names its doc_id, source, lang and n too."""
    spark = df.sparkSession
    by_source, by_lang, c, mean, _ = found
    name = dict(columns)

    def joined(df: DataFrame, key: str, values: dict) -> DataFrame:
        k, m = f"{name['rate']}_{key}", f"{name['rate']}_{key}_value"
        side = spark.createDataFrame(list(values.items()), f"`{k}` string, `{m}` double")
        return df.join(common.small(common.saved(side, key)), F.col(name[key]).eqNullSafe(F.col(k)), "left").drop(k)

    out = joined(joined(df, "source", by_source), "lang", by_lang)
    extra = [f"{name['rate']}_{key}_value" for key in ("source", "lang")]
    n = F.col(name["n"])
    tilt = sum((F.coalesce(F.col(x), F.lit(0.0)) for x in extra), F.when(n > 0, F.lit(c) * (F.log(n) - F.lit(mean))).otherwise(0.0))
    unit = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(name["doc_id"]), F.lit(-1).cast("bigint"))), 11) / F.lit(float(1 << 53))
    rate = F.col(name["rate"])
    copies = (F.floor(rate) + F.when(unit < rate - F.floor(rate), 1).otherwise(0)).cast("int")
    return out.withColumn(name["rate"], F.exp(tilt)).drop(*extra).withColumn(name["copies"], copies)


def rates(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, source, lang, tokens, rate, copies, reached) of every row; ``reached`` is below 1 where targets that no rates meet were moved."""
    table = common.saved(features(docs), "features")
    found = fit(table, **how)
    out = _priced(table, {c: c for c in ("doc_id", "source", "lang", "n", "rate", "copies")}, found)
    return out.select("doc_id", "source", "lang", F.col("n").cast("bigint").alias("tokens"), "rate", "copies",
        F.lit(found[-1]).alias("reached"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with each row as often as its copies; columns as before. The texts are not shuffled."""
    found = fit(common.saved(features(docs).drop("doc_id"), "features"), **how)
    mark = common.fresh(docs.columns)
    name = {c: mark + c for c in ("doc_id", "source", "lang", "n", "rate", "copies")}
    own = docs.withColumns({name["doc_id"]: F.col("doc_id").cast("bigint"), name["source"]: F.col("source").cast("string"),
            name["lang"]: F.col("lang").cast("string"), name["n"]: words(F.col("text"))})
    out = _priced(own, name, found).where(F.col(name["copies"]) > 0)
    return out.withColumn(mark, F.explode(F.sequence(F.lit(1), F.col(name["copies"])))).select(*common.quoted(docs.columns))
