"""Statistics of measurements."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_F = float


def share_filter(df: DataFrame, key: list[str], weight: Column, percent: float) -> DataFrame:
    """(key, weight, pct) of the keys with at least ``percent`` of all weight; the total is one row, so it is broadcast."""
    own = df.groupBy(*key).agg(F.sum(weight).alias("weight"))
    total = F.broadcast(df.agg(F.sum(weight).alias("__total")))
    pct = F.try_divide(100.0 * F.col("weight"), F.col("__total"))
    return own.crossJoin(total).withColumn("pct", pct).where((F.col("__total") > 0) & (F.col("pct") >= percent)).drop("__total")


def floor_percentiles(df: DataFrame, key: list[str], value: str, ps: Sequence[float]) -> DataFrame:
    """(key, p, value) with the value at index ``floor(p (n - 1))`` of a key's sorted values.

    Counts of equal values are summed in order, so that a key's rows need not be sorted in one place but for its distinct values.
    """
    n = df.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("__c"))
    w = W.partitionBy(*key)
    upto = n.withColumn("__upto", F.sum("__c").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, 0))).withColumn("__n",
        F.sum("__c").over(w))
    at = F.explode(F.array(*(F.struct(F.lit(_F(p)).alias("p"), F.floor(F.lit(_F(p)) * (F.col("__n") - 1)).alias("i")) for p in ps)))
    hit = upto.select(*key, value, "__c", "__upto", at.alias("__at")).where("__at.i < __upto AND __at.i >= __upto - __c")
    return hit.select(*key, F.col("__at.p").alias("p"), F.col(value).alias("value"))


def p_step(t: Column) -> Column:
    """The two-sided p value of a large-sample t statistic, in steps."""
    a = F.abs(t)
    return F.when(a > 5, 0.0001).when(a > 3.3, 0.001).when(a > 2.58, 0.01).when(a > 1.96, 0.05).when(a > 1.64, 0.10).otherwise(0.50)


def welch(df: DataFrame, group: str, control: str, treated: str, value: str, least: int = 30) -> DataFrame:
    """One row (n, mean and population deviation of both, t, d, p): Welch's t and Cohen's d of treated against control."""
    own = lambda g: F.when(F.col(group) == g, F.col(value))
    aggs = [f(own(g)).alias(f"{n}_{k}") for g, k in ((control, "c"), (treated, "t")) for n,
        f in (("n", F.count), ("mean", F.avg), ("sd", F.stddev_pop))]
    one = df.where(F.col(group).isin(control, treated)).agg(*aggs)
    se = F.sqrt(F.try_divide(F.col("sd_c") ** 2, F.col("n_c")) + F.try_divide(F.col("sd_t") ** 2, F.col("n_t")))
    pooled = F.sqrt((F.col("sd_c") ** 2 + F.col("sd_t") ** 2) / 2)
    enough = (F.col("n_c") >= least) & (F.col("n_t") >= least)
    diff = F.col("mean_t") - F.col("mean_c")
    one = one.withColumn("t", F.when(enough & (se > 0), diff / se).otherwise(0.0)).withColumn("d",
        F.when(enough & (pooled > 0), diff / pooled).otherwise(0.0))
    return one.withColumn("p", F.when(enough, p_step(F.col("t"))).otherwise(1.0))


def normal_quantile(p: float) -> float:
    """The normal quantile for p in (0, 1), by bisection on [0, 10]."""
    if p < 0.5:
        return -normal_quantile(1 - p)
    lo, hi = 0.0, 10.0
    for _ in range(60):
        mid = (lo + hi) / 2
        if 0.5 * math.erfc(-mid / math.sqrt(2)) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def normal_cdf(x: np.ndarray) -> np.ndarray:
    """The normal distribution function of whole arrays, to 15 digits: a continued fraction in the tails, a series between."""
    a = np.minimum(np.abs(x), 40.0)
    density = np.exp(-a * a / 2) / np.sqrt(2 * np.pi)
    term, total = a.copy(), a.copy()
    for k in range(1, 60):
        term = term * a * a / (2 * k + 1)
        total = total + term
    part = a + 40.0
    for k in range(60, 0, -1):
        part = a + k / part
    upper = np.where(a < 4, 0.5 - density * np.minimum(total, 1e300), density / part)
    return np.where(x >= 0, 1 - upper, upper)


def achieved_power(df: DataFrame, mean_c: str, sd_c: str, n_c: str, sd_t: str, n_t: str, effect: float, alpha: float,
    name: str = "power") -> DataFrame:
    """The power to see a relative effect: 0 without data, 1 if the standard error is about 0."""
    z = normal_quantile(1 - alpha)

    @F.pandas_udf("double")
    def phi(x: pd.Series) -> pd.Series:
        return pd.Series(normal_cdf(x.to_numpy(float)))

    se = F.sqrt(F.try_divide(F.col(sd_c) ** 2, F.col(n_c)) + F.try_divide(F.col(sd_t) ** 2, F.col(n_t)))
    df = df.withColumn("__se", se).withColumn("__x",
        F.coalesce(F.when(F.col("__se") > 1e-12, effect * F.abs(mean_c) / F.col("__se") - z), F.lit(0.0)))
    none = (F.coalesce(F.col(n_c), F.lit(0)) == 0) | (F.coalesce(F.col(n_t), F.lit(0)) == 0)
    out = F.when(none, 0.0).when(F.col("__se") <= 1e-12, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), phi("__x"))))
    return df.withColumn(name, out).drop("__se", "__x")


def experiment_verdict(p: Column, d: Column, power: Column, alpha: float, effect: float) -> Column:
    return F.when((p <= alpha) & (d >= effect), "Confirmed").when((p > 0.10) & (power >= 0.80), "Refuted").otherwise("Inconclusive")


def label_quality(power: Column, turbo: Column, governor: Column, no_cores: Column) -> Column:
    """How far a measurement can be trusted: its power, less for an unsettled machine."""
    loss = F.when(turbo, 0.15).otherwise(0.0) + F.when(governor, 0.10).otherwise(0.0) + F.when(no_cores, 0.20).otherwise(0.0)
    return F.least(power, F.lit(1.0)) * F.greatest(F.lit(0.0), 1 - loss) * 0.95


def label(verdict: Column, quality: Column, power: Column, excluded: Column) -> Column:
    """Positive, Negative, Unlabeled or Excluded; a weak measurement labels nothing."""
    said = F.when(verdict == "Confirmed", "Positive").when(verdict == "Refuted", "Negative").otherwise("Unlabeled")
    return F.when(excluded, "Excluded").when((quality < 0.60) | ((power < 0.80) & (said == "Negative")), "Unlabeled").otherwise(said)


def counter_votes(df: DataFrame, key: list[str], counter: str, value: Column, seconds: Column,
    thresholds: Sequence[tuple[str, float, float]]) -> DataFrame:
    """(key, confirm, refute, verdict): a sample votes by its rate (its value without a duration) against its counter's thresholds."""
    dim = F.broadcast(df.sparkSession.createDataFrame([(c, _F(a), _F(b)) for c, a, b in thresholds],
            f"{counter} string, __yes double, __no double"))
    rate = F.when(seconds > 0, value / seconds).otherwise(value)
    voted = df.join(dim, counter).withColumn("__r", rate)
    out = voted.groupBy(*key).agg(F.count(F.when(F.col("__r") >= F.col("__yes"), 1)).alias("confirm"),
        F.count(F.when(F.col("__r") <= F.col("__no"), 1)).alias("refute"))
    return out.withColumn("verdict", F.when(F.col("confirm") > F.col("refute"), "Positive")
        .when(F.col("refute") > F.col("confirm"), "Negative").otherwise("Unlabeled"))


def smoothed_priors(df: DataFrame, key: list[str], confirmed: Column) -> DataFrame:
    """(key, n, confirmed, refuted, prior) with the prior (confirmed + 1) / (n + 2)."""
    out = df.groupBy(*key).agg(F.count("*").alias("n"), F.count(F.when(confirmed, 1)).alias("confirmed"))
    return out.withColumn("refuted", F.col("n") - F.col("confirmed")).withColumn("prior", (F.col("confirmed") + 1.0) / (F.col("n") + 2.0))


def blended(confidence: Column, prior: Column, n: Column) -> Column:
    """Confidence moved to the prior by how much evidence that has; untouched without any."""
    w = F.least(F.lit(1.0), n / 50.0)
    return F.when(F.coalesce(n, F.lit(0)) == 0,
        confidence).otherwise(F.greatest(F.lit(0.05), F.least(F.lit(0.99), confidence * (1 - w) + prior * w)))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The bounds of the score interval of a proportion; (0, 1) without data."""
    n = F.nullif(n, F.lit(0))
    p = k / n
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low = F.when(n.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), (mid - half) / (1 + z * z / n)))
    return low, F.when(n.isNull(), 1.0).otherwise(F.least(F.lit(1.0), (mid + half) / (1 + z * z / n)))


def precision_by(df: DataFrame, rule: str, mark: str) -> DataFrame:
    """(rule, tp, scored, precision, low, high) by rule and pooled (rule null): marks TP and TP-NWF are right, FP is wrong."""
    counts = df.where(F.col(mark).isin("TP", "TP-NWF", "FP")).rollup(rule).agg(F.count(F.when(F.col(mark) != "FP", 1)).alias("tp"),
        F.count("*").alias("scored"))
    low, high = wilson(F.col("tp"), F.col("scored"))
    return counts.withColumns({"precision": F.col("tp") / F.col("scored"), "low": low, "high": high})


def mask_verdicts(df: DataFrame, line: list[str], granule: str, mask: str, writes: str, hot: int = 100) -> DataFrame:
    """(line, mask, writers, pressure, verdict): how a cache line is shared, from writer masks by granule.

    Pressure is the second largest sum of writes by mask. One writer: PRIVATE; every granule with the line's whole mask: TRUE; otherwise
    FALSE from ``hot`` writes of pressure on, else COLD.
    """
    by_granule = df.groupBy(*line, granule).agg(F.bit_or(mask).alias("__m"), F.sum(writes).alias("__w"))
    by_mask = by_granule.groupBy(*line, "__m").agg(F.sum("__w").alias("__w"))
    ranked = F.sort_array(F.collect_list("__w"), asc=False)
    out = by_mask.groupBy(*line).agg(F.bit_or("__m").alias("mask"), F.count("*").alias("__masks"),
        F.coalesce(F.try_element_at(ranked, F.lit(2)), F.lit(0)).cast("bigint").alias("pressure"))
    verdict = F.when(F.bit_count("mask") <= 1, "PRIVATE").when(F.col("__masks") == 1, "TRUE").when(F.col("pressure") >= hot,
        "FALSE").otherwise("COLD")
    return out.select(*line, "mask", F.bit_count("mask").alias("writers"), "pressure", verdict.alias("verdict"))


def cliffs(df: DataFrame, key: list[str], step: str, value: str, least: int = 1000) -> DataFrame:
    """(key, cliff): the first step from 1 on at which a curve falls, to stay, to a hundredth of its greatest value from at least a quarter; 0 if none."""
    w = W.partitionBy(*key)
    top = F.max(value).over(w)
    later = F.max(value).over(w.orderBy(step).rowsBetween(0, W.unboundedFollowing))
    low = lambda c, k: c <= F.floor(top / k)
    is_cliff = (F.col(step) >= 1) & (top >= least) & low(later, 100) & (F.lag(value).over(w.orderBy(step)) >= F.floor(top / 4))
    return df.withColumn("__c", is_cliff).groupBy(*key).agg(F.coalesce(F.min(F.when(F.col("__c"), F.col(step))), F.lit(0)).cast("int")
        .alias("cliff"))


def ratio_lower_bound(t: Column, c: Column) -> Column:
    """A lower bound of the ratio of two Poisson counts."""
    return F.greatest(F.lit(0.0), t - 2 * F.sqrt(t)) / (c + 2 * F.sqrt(c) + 1)


def elected(scores: Column, margin: float = 0.10) -> Column:
    """The index of the elected entry of an array of scores: a later one must beat the best so far by more than the margin; -1 if empty."""
    start = F.struct(F.lit(-1).alias("i"), F.lit(0.0).alias("best"), F.lit(0).alias("at"))
    beats = lambda a, x: (a["i"] < 0) | (x > a["best"] * (1 + margin))
    step = lambda a, x: F.struct(F.when(beats(a, x), a["at"]).otherwise(a["i"]).alias("i"),
        F.when(beats(a, x), x.cast("double")).otherwise(a["best"]).alias("best"), (a["at"] + 1).alias("at"))
    return F.aggregate(scores, start, step, lambda a: a["i"])


def bootstrap_ci(df: DataFrame, key: list[str], order: list[str], group: str, value: str, control: str, treated: str, effect: float,
    q: float = 0.999, alpha: float = 0.01, reps: int = 2000, seed: int = 7) -> DataFrame:
    """(key, effect, low, high, drift, drift_low, drift_high, verdict): the relative change of the q-quantile of treated over control, with its
    percentile interval at ``1 - alpha``.

    CONFOUNDED if the later half of the control, in ``order``, differs from the earlier by the effect sought, and by an interval that
    leaves out 0; CONFIRMED if the interval lies above the effect, REFUTED if below, else INCONCLUSIVE. A key's samples are one group of rows;
    keys run side by side.
    """
    names = ["effect", "low", "high", "drift", "drift_low", "drift_high"]
    schema = df.select(*key).schema.simpleString()[7:-1] + "".join(f", {n} double" for n in names) + ", verdict string"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        c = pdf.loc[pdf[group] == control, value].dropna().to_numpy(float)
        t = pdf.loc[pdf[group] == treated, value].dropna().to_numpy(float)
        head = pdf.iloc[0][key].tolist()
        if len(c) < 2 or not len(t):
            return pd.DataFrame([[*head, *[0.0] * 6, "INCONCLUSIVE"]], columns=[*key, *names, "verdict"])
        rng = np.random.default_rng(seed)

        def at(x: np.ndarray) -> float:
            k = int(q * (len(x) - 1))
            return float(np.partition(x, k)[k])

        def change(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
            """How much a's quantile is above b's, and its interval over resamples."""
            rel = np.empty(reps)
            for r in range(reps):
                x, y = at(rng.choice(a, len(a))), at(rng.choice(b, len(b)))
                rel[r] = (x - y) / y if y else 0.0
            rel.sort()
            pick = lambda p: float(rel[int(p * (reps - 1))])
            base = at(b)
            return (at(a) - base) / base if base else 0.0, pick(alpha / 2), pick(1 - alpha / 2)

        half = len(c) // 2
        drift, drift_low, drift_high = change(c[half:], c[:half])
        point, low, high = change(t, c)
        drifted = (drift_low > 0 or drift_high < 0) and abs(drift) >= effect
        said = "CONFOUNDED" if drifted else "CONFIRMED" if low > effect else "REFUTED" if high < effect else "INCONCLUSIVE"
        return pd.DataFrame([[*head, point, low, high, drift, drift_low, drift_high, said]], columns=[*key, *names, "verdict"])

    return df.select(*dict.fromkeys([*key, *order, group, value])).groupBy(*key).applyInPandas(run, schema)


def fp_clusters(df: DataFrame, kind: str, order: list[str], features: str, radius: float = 0.25) -> DataFrame:
    """(kind, features, refutations) of false positives: each joins the first earlier cluster of its class within the radius, else founds one.

    The fold depends on order and goes class by class.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found: list[list] = []
        for x in pdf.sort_values(order, kind="stable")[features]:
            v = np.asarray(x, float)
            for f in found:
                if len(f[0]) == len(v) and np.linalg.norm(f[0] - v) <= radius:
                    f[1] += 1
                    break
            else:
                found.append([v, 1])
        return pd.DataFrame({kind: pdf[kind].iloc[0], "features": [f[0].tolist() for f in found], "refutations": [f[1] for f in found]})

    schema = f"{kind} {df.schema[kind].dataType.simpleString()}, features array<double>, refutations bigint"
    return df.select(kind, *order, features).groupBy(kind).applyInPandas(run, schema)


def interaction_catalog(df: DataFrame, key: list[str], d: str, super_additive: str) -> DataFrame:
    """(key, n, mean_d, super_additive) of observed combinations."""
    return df.groupBy(*key).agg(F.count("*").alias("n"), F.avg(d).alias("mean_d"), F.bool_or(super_additive).alias("super_additive"))


def counter_groups(required: Sequence[str], optional: Sequence[str], most: int) -> list[list[str]]:
    """Counters in groups that can be measured together, the required first."""
    both = list(dict.fromkeys([*required, *optional]))
    return [both[i : i + most] for i in range(0, len(both), most)]
