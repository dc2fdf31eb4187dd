"""From measurements back to grades: labels, priors, refuted clusters, diffs of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideway import schemas as S
from strideway.operators import setdiff, stats
from strideway.plans import reduce as R

#: Counters that speak for or against a class: (class, counter, confirms at, refutes at) a second.
THRESHOLDS = [
    ("CacheGeometry", "MEM_LOAD_RETIRED.L3_MISS", 10000, 100), ("CacheGeometry", "OFFCORE_RESPONSE.DEMAND_DATA_RD.L3_MISS", 5000, 50),
        ("FalseSharing", "MEM_LOAD_RETIRED.L3_MISS", 10000, 100), ("FalseSharing", "OFFCORE_RESPONSE.DEMAND_DATA_RD.L3_MISS", 5000, 50),
    ("AtomicOrdering", "MEM_INST_RETIRED.LOCK_LOADS", 1000, 10), ("AtomicOrdering", "MACHINE_CLEARS.MEMORY_ORDERING", 100, 1),
        ("AtomicContention", "MEM_INST_RETIRED.LOCK_LOADS", 1000, 10), ("AtomicContention", "MACHINE_CLEARS.MEMORY_ORDERING", 100, 1),
    ("LockContention", "MEM_INST_RETIRED.LOCK_LOADS", 5000, 50), ("LockContention", "RESOURCE_STALLS.SB", 10000, 100),
        ("HeapAllocation", "DTLB_LOAD_MISSES.WALK_COMPLETED", 1000, 10), ("HeapAllocation", "PAGE_WALKER_LOADS.DTLB_L1", 5000, 50),
    ("StackPressure", "DTLB_LOAD_MISSES.WALK_COMPLETED", 500, 5), ("VirtualDispatch", "BR_MISP_RETIRED.NEAR_CALL", 500, 5),
        ("VirtualDispatch", "FRONTEND_RETIRED.ITLB_MISS", 200, 2), ("StdFunction", "BR_MISP_RETIRED.NEAR_CALL", 500, 5),
        ("StdFunction", "FRONTEND_RETIRED.ITLB_MISS", 200, 2),
    ("DeepConditional", "BR_MISP_RETIRED.ALL_BRANCHES", 5000, 50),
        ("NUMALocality", "OFFCORE_RESPONSE.DEMAND_DATA_RD.ANY_RESPONSE", 50000, 500),
        ("NUMALocality", "UNC_CHA_TOR_INSERTS.IA_MISS", 10000, 100),
]


def trace_verdicts(findings: DataFrame, trace: DataFrame) -> DataFrame:
    """(record, cls, confirm, refute, verdict) of trace records matched to findings, by the thresholds of their class."""
    records = trace.select(F.col("record").alias("id"), "fn", "file", "line").distinct()
    matched = R.match_traces(findings, records)
    dim = F.broadcast(findings.sparkSession
        .createDataFrame([(c, n, float(a), float(b)) for c, n, a, b in THRESHOLDS], "cls string, counter string, yes double, no double"))
    rate = F.when(F.col("duration_ns") > 0, F.col("value") * 1e9 / F.col("duration_ns")).otherwise(F.col("value"))
    voted = trace.withColumn("rate", rate).join(matched, F.col("record") == F.col("id")).join(dim, ["cls", "counter"])
    out = voted.groupBy("record", "cls").agg(F.count(F.when(F.col("rate") >= F.col("yes"), 1)).alias("confirm"),
        F.count(F.when(F.col("rate") <= F.col("no"), 1)).alias("refute"))
    return out.withColumn("verdict", F.when(F.col("confirm") > F.col("refute"), "Positive")
        .when(F.col("refute") > F.col("confirm"), "Negative").otherwise("Unlabeled"))


def updated_priors(verdicts: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """A10: (cls, prior, fpr, tpr, n, confirmed, refuted) with counts added to those before; n counts undecided traces too."""
    own = verdicts.groupBy("cls").agg(F.count("*").alias("n"), F.count(F.when(F.col("verdict") == "Positive", 1)).alias("confirmed"),
        F.count(F.when(F.col("verdict") == "Negative", 1)).alias("refuted"))
    if before is not None:
        own = own.unionByName(before.select("cls", "n", "confirmed",
                "refuted")).groupBy("cls").agg(*(F.sum(c).alias(c) for c in ("n", "confirmed", "refuted")))
    share = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("n").cast("double")), F.lit(0.0))
    return own.select("cls", ((F.col("confirmed") + 1.0) / (F.col("n") + 2.0)).alias("prior"), share("refuted").alias("fpr"),
        share("confirmed").alias("tpr"), "n", "confirmed", "refuted")


def refuted_clusters(labelled: DataFrame, radius: float = 0.25) -> DataFrame:
    """(cls, features, refutations) of negative records (cls, ord, features, label)."""
    return stats.fp_clusters(labelled.where("label = 'Negative'"), "cls", ["ord"], "features", radius)


def diff_key(findings: DataFrame) -> DataFrame:
    """Findings by (rule, path, entity, at): the line only where there is no entity; paths without what all share."""
    entity = F.coalesce(F.nullif(R.ev("type_name"), F.lit("")), F.col("fn"), F.lit(""))
    own = setdiff.without_common_prefix(findings.withColumn("entity", entity), "file", "path")
    return own.select("rule", "path", "entity", F.when(F.col("entity") == "", F.col("line")).alias("at"),
        S.name_of(S.SEVERITIES, F.col("severity")).alias("severity"))


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(rule, path, entity, at, change) of the findings that are new or resolved, with multiplicity."""
    return setdiff.multiset_difference(diff_key(before), diff_key(after), ["rule", "path", "entity", "at"])


def diff_exit(changes: DataFrame) -> int:
    """0 if nothing is new, else 1."""
    return int(not changes.where("change = 'new'").isEmpty())


def coverage_warnings(findings: DataFrame, coverage: DataFrame, rules: list[str], disabled: list[str] = ()) -> tuple[list[str], bool]:
    """Rules that are enabled and fired nowhere; whether hot functions are thin (below 1 % of over 1000)."""
    fired = {r.rule for r in findings.select("rule").distinct().collect()}  # a row a rule
    c = coverage.first()
    return [r for r in rules if r not in fired and r not in disabled], bool(c.functions > 1000 and 100 * c.hot < c.functions)


def latency_verdict(samples: DataFrame, group: str, control: str, treated: str, value: str, effect: float = 0.05,
    alpha: float = 0.01) -> DataFrame:
    """One row with statistics, power and verdict of an experiment."""
    one = stats.welch(samples, group, control, treated, value)
    one = stats.achieved_power(one, "mean_c", "sd_c", "n_c", "sd_t", "n_t", effect, alpha)
    return one.withColumn("verdict", stats.experiment_verdict(F.col("p"), F.col("d"), F.col("power"), alpha, effect))
