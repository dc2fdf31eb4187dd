"""Row types and ordinal scales of findings and facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ["Informational", "Medium", "High", "Critical"]
INFO, MEDIUM, HIGH, CRITICAL = range(4)
#: The lower, the stronger.
TIERS = ["proven", "likely", "speculative"]
PROVEN, LIKELY, SPECULATIVE = range(3)
HOTNESS = ["none", "cross-tu-candidate", "inferred-shallow", "inferred-deep", "declared", "profile"]
COLD, CANDIDATE, SHALLOW, DEEP, DECLARED, PROFILED = range(6)
MAIN, WORKER = 1, 2
#: How often a function writes: unknown, now and then, for each connection or assignment, for each command.
UNKNOWN_RATE, TICK_RATE, DISPATCH_RATE, HOT_RATE = range(4)
RATES = ["unknown", "tick", "dispatch", "hot"]

CLAIM = "struct<effect:string,precondition:string,established:boolean,supports:int,gating:boolean>"
FINDING = (
    "rule string, title string, severity int, confidence double, tier int, suppressed boolean, file string, line int, col int, fn string, reasoning string, "
    f"evidence map<string,string>, mitigation string, escalations array<string>, hotness int, claims array<{CLAIM}>"
)
SIGNAL_FLAGS = "atomics sync shared_owner volatiles published thread_writers global_instance thread_borne standing layout".split()
SIGNAL = "type string, " + ", ".join(f"{f} boolean" for f in SIGNAL_FLAGS) + ", accessors int"
STRIPED = "key string, name string, type string, file string, line int, elem_size bigint, elem_count bigint, decl_align bigint, atomic boolean, volatile boolean, static boolean, tls boolean, head_pad boolean, writer_tier int, writers array<string>, aggregators array<string>"
#: Lowered code of a function: the lines of sequentially consistent atomics and of compare-exchanges are those of its own file; locks are calls and compare-exchanges.
PROFILE = (
    "mangled string, demangled string, file string, line int, site_lines array<int>, seq_csts bigint, atomics bigint, atomic_writes bigint, located_writes bigint, "
    "fences bigint, heap_calls bigint, calls bigint, indirect_calls bigint, locks bigint, lock_lines array<int>, frame bigint"
)

#: Hazard class by rule; rules without one take no part in interactions.
CLASSES = {
    "FL001": "CacheGeometry", "FL002": "FalseSharing", "FL003": "StripedArray", "FL010": "AtomicOrdering", "FL011": "AtomicContention",
        "FL012": "LockContention",
    "FL020": "HeapAllocation", "FL021": "StackPressure", "FL030": "VirtualDispatch", "FL031": "StdFunction", "FL040": "GlobalState",
        "FL041": "ContendedQueue",
    "FL050": "DeepConditional", "FL060": "NUMALocality", "FL061": "CentralizedDispatch", "FL090": "HazardAmplification",
        "FL091": "SynthesizedInteraction",
}
#: Rules whose findings identify a record or a variable, by place and type.
STRUCT_RULES = ("FL001", "FL002", "FL040", "FL041", "FL060", "FL061", "FL070", "FL090", "FL091")
WITHDRAWN_WHEN_COLD = ("FL010", "FL011", "FL012", "FL013", "FL020", "FL030", "FL031", "FL050", "FL061")
#: rule: (emissions, 0 for any number; least confidence; highest severity)
POLICIES = {
    "FL001": (0, 0.40, CRITICAL), "FL002": (0, 0.50, CRITICAL), "FL010": (50, 0.45, CRITICAL), "FL011": (50, 0.45, CRITICAL),
        "FL012": (50, 0.45, CRITICAL),
    "FL020": (100, 0.40, CRITICAL), "FL021": (30, 0.35, HIGH), "FL030": (30, 0.45, CRITICAL), "FL031": (30, 0.45, HIGH),
        "FL040": (0, 0.50, CRITICAL),
    "FL041": (0, 0.50, CRITICAL), "FL050": (20, 0.30, HIGH), "FL060": (20, 0.35, HIGH), "FL061": (20, 0.40, HIGH),
        "FL090": (0, 0.55, CRITICAL),
    "FL091": (0, 0.60, CRITICAL), "FL092": (0, 0.60, CRITICAL),
}
#: (id, classes) of hazards that amplify each other, by a fifth each.
INTERACTIONS = [
    ("IX-001", ("CacheGeometry", "AtomicContention")), ("IX-002", ("FalseSharing", "AtomicContention")),
        ("IX-003", ("AtomicOrdering", "AtomicContention")),
    ("IX-004", ("AtomicContention", "NUMALocality")), ("IX-005", ("LockContention", "HeapAllocation")),
        ("IX-006", ("VirtualDispatch", "DeepConditional")),
    ("IX-007", ("CacheGeometry", "AtomicContention", "NUMALocality")),
]
AMPLIFIED = 1.2


def name_of(names: list[str], value: Column) -> Column:
    """The name of an ordinal."""
    return F.element_at(F.array(*map(F.lit, names)), value + 1)


def ordinal_of(names: list[str], value: Column) -> Column:
    """The ordinal of a name, in any case; null for others."""
    out = F.lit(None).cast("int")
    for i, n in enumerate(names):
        out = F.when(F.lower(value) == n.lower(), i).otherwise(out)
    return out


def claim(effect: str | Column, precondition: str, established: bool | Column, supports: int | Column, gating: bool = False) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(effect).alias("effect"), F.lit(precondition).alias("precondition"), lit(established).alias("established"),
        lit(supports).cast("int").alias("supports"), F.lit(gating).alias("gating"))


def supported_severity(claims: Column) -> Column:
    """The highest severity that a finding's claims justify.

    The best established mechanism, at most the least of the gates; without mechanisms the gates alone; without claims no bound.
    """
    gates = F.transform(F.filter(claims, lambda c: c["gating"]), lambda c: c["supports"])
    cap = F.coalesce(F.array_min(gates), F.lit(CRITICAL))
    plain = F.filter(claims, lambda c: ~c["gating"])
    best = F.coalesce(F.array_max(F.transform(F.filter(plain, lambda c: c["established"]), lambda c: c["supports"])), F.lit(INFO))
    return F.when(F.coalesce(F.size(claims), F.lit(0)) <= 0, CRITICAL).when(F.size(plain) == 0,
        cap).otherwise(F.least(best, cap)).cast("int")


def hot_severity(hotness: Column, base: Column) -> Column:
    """The severity that a grade of hotness supports for a finding of severity ``base``."""
    down = lambda n: F.greatest(base - n, F.lit(INFO))
    return F.when(hotness >= DECLARED, CRITICAL).when(hotness == DEEP, down(1)).when(hotness.isin(SHALLOW, CANDIDATE),
        down(2)).otherwise(INFO).cast("int")
