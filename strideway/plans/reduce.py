"""The reduce pipeline: steps over findings and merged facts, each a function from table to table.

Findings carry ``ord``, their place in the canonical order, and ``stage``: what later steps add comes after all before. Side tables
are joined by key; rows without a key get one of their own, so that they spread over partitions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strideway import schemas as S
from strideway import storage
from strideway.functions import text
from strideway.operators import calls, graph, joins, merge, ranking

HOT_EFFECT = "this code runs often"
RECEIVER_EFFECT = "receiver type varies"
ROLES_NOTE = "writer roles disjoint across units"
AFFINITY = "pthread_setaffinity_np sched_setaffinity mbind set_mempolicy numa_bind numa_run_on_node numa_set_membind numa_alloc_onnode numa_tonode_memory".split()
PAGING = ["madvise", "posix_madvise", "mallopt"]


@dataclass
class Facts:
    """Merged facts of all units. Missing tables are empty; ``units`` is the number of translation units."""

    signals: DataFrame | None = None  # S.SIGNAL
    edges: DataFrame | None = None  # src, dst, loop_depth
    own_depth: DataFrame | None = None  # fn, depth
    entries: DataFrame | None = None  # fn
    writers: DataFrame | None = None  # field (Type::field), writer
    overridden: DataFrame | None = None  # fn
    striped: DataFrame | None = None  # S.STRIPED
    failures: DataFrame | None = None  # file, error
    profiles: DataFrame | None = None  # S.PROFILE
    lines: DataFrame | None = None  # file, line, text of sources that may suppress findings
    units: int = 2
    main_patterns: list[str] = field(default_factory=list)
    entry_patterns: list[str] = field(default_factory=list)
    line: int = 64
    l1d: int = 32768


def ev(key: str) -> Column:
    """A value of the evidence, null if missing."""
    return F.try_element_at("evidence", F.lit(key))


def put(evidence: Column, **values) -> Column:
    """The evidence with keys set."""
    keys = list(values)
    kept = F.map_filter(evidence, lambda k, v: ~k.isin(keys))
    fresh = F.create_map(*(x for k in keys for x in (F.lit(k), values[k].cast("string"))))
    return F.map_concat(kept, fresh)


def noted(when: Column, note: Column | str) -> Column:
    """The escalations with a note added where the condition holds."""
    n = note if isinstance(note, Column) else F.lit(note)
    return F.when(F.coalesce(when, F.lit(False)), F.concat("escalations", F.array(n))).otherwise(F.col("escalations"))


def side_join(df: DataFrame, side: DataFrame, key: Column, name: str) -> DataFrame:
    """Left join on a key that is often null: rows without one keep their own and never meet in one partition.

    The side is written first; if it is small the findings are not shuffled.
    """
    own = F.coalesce(key, F.concat(F.lit("\0"), F.col("stage"), F.lit(":"), F.col("ord")))
    held = storage.small(storage.saved(side.withColumnRenamed(name, "__k"), "side"))
    return df.withColumn("__k", own).join(held, "__k", "left").drop("__k")


def place_join(df: DataFrame, side: DataFrame) -> DataFrame:
    """Left join of what was found for some findings, by their place; written first, so that findings are not shuffled if it is small."""
    return df.join(storage.small(storage.saved(side, "found")), ["ord", "stage"], "left")


def content() -> list[Column]:
    """What orders findings of one place."""
    return [F.col("severity"), F.col("confidence"), F.col("tier"), F.col("fn"), F.col("title"), text.evidence_text(F.col("evidence")),
        F.array_join("escalations", "\n"), F.col("mitigation")]


def canonical(findings: DataFrame) -> DataFrame:
    """``ord`` by rule, place, function, then content."""
    order = [F.col(c) for c in ("rule", "file", "line", "col", "fn")] + content()
    return ranking.ordinal(findings, order).withColumn("stage", F.lit(0))


def global_writes(df: DataFrame) -> DataFrame:
    """R2: grades of mutable globals by their writes in all units."""
    mine = (F.col("rule") == "FL040") & ev("var").isNotNull()
    key = F.when(mine, F.concat_ws("|", ev("var"), ev("type")))
    n = lambda k: F.coalesce(ev(k).try_cast("bigint"), F.lit(0))
    agg = df.where(mine).groupBy(key.alias("k")).agg(F.sum(n("tu_write_count")).alias("__w"), F.sum(n("tu_loop_writes")).alias("__l"),
        F.bool_or(F.coalesce(ev("has_init") == "yes", F.lit(False))).alias("__i"))
    out = side_join(df, agg, key, "k")
    w, lw = F.col("__w"), F.col("__l")
    once = mine & (lw == 0) & ((w <= 1) | (F.col("__i") & (w == 0)))
    path = mine & ~once & ~F.coalesce(ev("atomics") == "yes", F.lit(False)) & (w <= 1)
    flat = mine & ~once & ~path & (F.col("severity") == S.CRITICAL) & (lw == 0) & (w < 4)
    note = F.when(once, "written at most once in all units").when(path, "one write site on a plain global: one write path").when(flat,
        "few flat write sites, none in a loop: lifecycle flag")
    kept = F.map_filter("evidence", lambda k, v: ~k.isin("tu_write_count", "tu_loop_writes", "has_init"))
    return out.withColumns(
        {
            "escalations": noted(note.isNotNull(), note),
            "severity": F.when(once | path, S.INFO).when(flat, S.HIGH).otherwise(F.col("severity")),
            "confidence": F.when(once, 0.30).when(path, 0.35).otherwise(F.col("confidence")),
            "tier": F.when(once | path, S.SPECULATIVE).otherwise(F.col("tier")),
            "evidence": F.when(mine, put(kept, write_once=F.when(once, "yes").otherwise("no"), global_write_count=w, global_loop_writes=lw))
                .otherwise(F.col("evidence")),
        }
    ).drop("__w", "__l", "__i")


def ir_refinement(df: DataFrame, f: Facts) -> DataFrame:
    """Findings moved by the lowered code of their functions."""
    if f.profiles is None:
        return df
    return calls.refined(df, f.profiles)


def merged_signals(signals: DataFrame) -> DataFrame:
    return merge.merge_facts(signals, ["type"], any_of=S.SIGNAL_FLAGS, sums=["accessors"])


def any_escape() -> Column:
    return fold(Column.__or__, (F.col(c)
            for c in ("atomics", "sync", "shared_owner", "volatiles", "published", "thread_writers", "global_instance")))


def sharing_route() -> Column:
    """A shared instance somewhere that a thread reaches, with standing writes."""
    return F.col("standing") & (F.col("published") | F.col("thread_writers") | (F.col("global_instance") & F.col("thread_borne")))


def escape_suppression(df: DataFrame, f: Facts) -> DataFrame:
    """What claims an escape that no unit evidences is suppressed, unless proven; only over several units."""
    if f.units <= 1 or f.signals is None:
        return df
    claims = ~F.col("suppressed") & ev("thread_escape").isin("true", "yes") & (F.col("tier") != S.PROVEN) & ev("type_name").isNotNull()
    known = merged_signals(f.signals).where(any_escape()).select(F.col("type").alias("k"), F.lit(True).alias("__e"))
    out = side_join(df, known, F.when(claims, ev("type_name")), "k")
    drop = F.coalesce(claims, F.lit(False)) & F.col("__e").isNull()
    return out.withColumn("escalations", noted(drop, f"no escape evidence in {f.units} units")).withColumn("suppressed",
        F.col("suppressed") | drop).drop("__e")


def sharing_verdict(df: DataFrame, f: Facts) -> DataFrame:
    """Contention between cores is capped where types are known and none is shared; unknown is not disproven."""
    if f.signals is None:
        return df
    mine = ~F.col("suppressed") & F.col("rule").isin("FL002", "FL041") & (F.coalesce(ev("type_name"), F.lit("")) != "")
    known = storage.small(storage.saved(merged_signals(f.signals).select("type", sharing_route().alias("shared")), "routes"))
    verdict = joins.any_shared(df.where(mine).select("ord", "stage", ev("type_name").alias("types")), ["ord", "stage"], "types", ";", known,
        "type", "shared")
    capped = verdict.where("known > 0 AND NOT shared").select("ord", "stage", F.lit(True).alias("__c"))
    out = place_join(df, capped)
    gate = S.claim("two threads reach the same instance", "a unit shows a shared instance and a thread that writes it", False, S.MEDIUM,
        gating=True)
    hit = F.coalesce("__c", F.lit(False))
    return out.withColumn("escalations",
        noted(hit, "no unit shows a thread at a shared instance: contention is not established")).withColumn("claims",
        F.when(hit, F.concat("claims", F.array(gate))).otherwise(F.col("claims"))).drop("__c")


def thread_roles(f: Facts) -> DataFrame | None:
    """(fn, mask) of the functions reached from main or from thread entries; none without a worker root."""
    spark = f.edges.sparkSession
    names = f.edges.select(F.col("src").alias("fn")).union(f.edges.select("dst"))
    if f.writers is not None:
        names = names.union(f.writers.select("writer"))
    names = names.distinct()
    is_main = (F.col("fn") == "main") | text.matches_glob(F.col("fn"), f.main_patterns)
    workers = names.where(text.matches_glob(F.col("fn"), f.entry_patterns)).select("fn")
    entries = f.entries if f.entries is not None else spark.createDataFrame([], "fn string")
    workers = storage.saved(workers.union(entries.select("fn")).distinct(), "workers")
    if workers.isEmpty():
        return None
    roots = names.where(is_main).select(F.col("fn").alias("node"), F.lit(S.MAIN).alias("mask")).union(workers.select("fn", F.lit(S.WORKER)))
    return graph.reachable(f.edges.select("src", "dst"), roots).select(F.col("node").alias("fn"), "mask")


def field_roles(f: Facts, roles: DataFrame) -> DataFrame:
    """(type, name, mask) of written fields; a writer of unknown role makes the mask 0."""
    w = f.writers.distinct().join(roles, F.col("writer") == F.col("fn"), "left")
    m = w.groupBy("field").agg(F.when(F.bool_or(F.col("mask").isNull()), 0).otherwise(F.bit_or("mask")).alias("mask"))
    at = F.col("field").substr(F.lit(1), F.length("field") - F.length(F.substring_index("field", "::", -1)) - 2)
    return m.select(at.alias("type"), F.substring_index("field", "::", -1).alias("name"), "mask")


def role_escalation(df: DataFrame, f: Facts, roles: DataFrame | None) -> DataFrame:
    """False sharing whose fields are written by disjoint roles only: the first such pair, in flagged order or by name."""
    if roles is None or f.writers is None:
        return df
    masks = storage.saved(field_roles(f, roles).where("mask <> 0"), "masks")
    mine = ~F.col("suppressed") & (F.coalesce(ev("type_name"), F.lit("")) != "")
    pairs = df.where(mine & (F.col("rule") == "FL002")).select("ord", "stage", ev("type_name").alias("type"),
        F.posexplode(F.split(ev("pair_fields"), ";")).alias("pos", "pair"))
    pairs = pairs.where(F.contains("pair", F.lit("|"))).select("ord", "stage", "type", "pos", F.substring_index("pair", "|", 1).alias("a"),
        F.expr("substring(pair, instr(pair, '|') + 1)").alias("b"))
    a, b = (masks.select("type", F.col("name").alias(n), F.col("mask").alias(f"m{n}")) for n in ("a", "b"))
    disjoint = F.col("ma").bitwiseAND(F.col("mb")) == 0
    flagged = pairs.join(a, ["type", "a"]).join(b, ["type", "b"]).where(disjoint).groupBy("ord",
        "stage").agg(F.min_by(F.struct("a", "b", "ma", "mb"), "pos").alias("__p"))
    per_type = a.join(b, "type").where((F.col("a") < F.col("b"))
        & disjoint).groupBy("type").agg(F.min(F.struct("a", "b", "ma", "mb")).alias("__p"))
    by_type = df.where(mine & (F.col("rule") == "FL090")).select("ord", "stage", ev("type_name").alias("type")).join(per_type,
        "type").select("ord", "stage", "__p")
    out = place_join(df, flagged.unionByName(by_type))
    hit = F.col("__p").isNotNull()
    role = lambda m: F.when(m == S.MAIN, "main").when(m == S.WORKER, "worker").otherwise("mixed")
    note = F.concat(F.lit(f"{ROLES_NOTE}: "), F.col("__p.a"), F.lit(" by "), role(F.col("__p.ma")), F.lit(", "), F.col("__p.b"),
        F.lit(" by "), role(F.col("__p.mb")))
    return out.withColumn("escalations", noted(hit, note)).withColumn("confidence",
        F.when(hit, F.least(F.col("confidence") + 0.08, F.lit(0.95))).otherwise(F.col("confidence"))).drop("__p")


def global_hotness(f: Facts) -> DataFrame:
    """(fn, hotness) from loop depths summed along calls from entries, at most 4; thinner beyond 8 calls."""
    spark = f.edges.sparkSession
    seeds = spark.createDataFrame([(m,) for m in f.main_patterns], "fn string")
    if f.entries is not None:
        seeds = seeds.union(f.entries.select("fn"))
    return calls.hotness(f.edges, seeds, f.own_depth)


def resolve_candidates(df: DataFrame, f: Facts) -> DataFrame:
    """Candidates take the hotness of the whole program; cold ones are withdrawn where the rule needs heat."""
    if f.edges is None:
        return df
    mine = F.col("hotness") == S.CANDIDATE
    out = side_join(df, global_hotness(f).select(F.col("fn").alias("k"), F.col("hotness").alias("__h")), F.when(mine, F.col("fn")), "k")
    found, lost = mine & F.col("__h").isNotNull(), mine & F.col("__h").isNull()
    gone = lost & F.col("rule").isin(*S.WITHDRAWN_WHEN_COLD)
    renamed = lambda c: F.when(c["gating"] & c["effect"].startswith(HOT_EFFECT),
        S.claim(F.concat(F.lit(f"{HOT_EFFECT} ("), S.name_of(S.HOTNESS, F.col("__h")), F.lit(", all units)")), "", False,
            S.hot_severity(F.col("__h"), F.col("severity")), True).withField("precondition", c["precondition"])
        .withField("established", c["established"])).otherwise(c)
    return out.withColumns(
        {
            "claims": F.when(found, F.transform("claims", renamed)).otherwise(F.col("claims")),
            "suppressed": F.col("suppressed") | gone,
            "hotness": F.when(found, F.col("__h")).when(lost & ~gone, S.COLD).otherwise(F.col("hotness")),
        }
    ).drop("__h")


def devirtualise(df: DataFrame, f: Facts) -> DataFrame:
    """Calls of what nothing overrides have one receiver: only the inlining barrier is paid."""
    if f.overridden is None:
        return df
    mine = ~F.col("suppressed") & F.col("rule").isin("FL030", "FL031") & ev("virtual_call").isNotNull()
    over = f.overridden.select(F.col("fn").alias("k"), F.lit(True).alias("__o")).distinct()
    out = side_join(df, over, F.when(mine, ev("virtual_call")), "k")
    mono = F.coalesce(mine, F.lit(False)) & F.col("__o").isNull()
    capped = lambda c: F.when(c["gating"] & c["effect"].startswith(RECEIVER_EFFECT),
        c.withField("supports", F.lit(S.MEDIUM))).otherwise(c)
    return out.withColumn("escalations", noted(mono, F.concat(F.lit("nothing overrides "), ev("virtual_call")))).withColumn("claims",
        F.when(mono, F.transform("claims", capped)).otherwise(F.col("claims"))).drop("__o")


def stripe_findings(f: Facts, roles: DataFrame | None) -> DataFrame:
    """Arrays written under a thread's index whose slots share lines, graded by roles, rate and the cost of padding."""
    s = merge.merge_facts(f.striped.select("*", F.monotonically_increasing_id().alias("__seq")), ["key"],
        any_of=["atomic", "volatile", "static", "tls", "head_pad"], maxes=["writer_tier"]).join(
        merge.first_wins(f.striped.withColumn("__o", F.concat_ws("|", "file", F.lpad(F.col("line").cast("string"), 9, "0"))), ["key"],
            ["name", "type", "file", "line", "elem_size", "elem_count", "decl_align"], "__o"), "key"
    )
    sets = f.striped.select("key", F.explode_outer("writers").alias("w")).groupBy("key").agg(F.array_sort(F.collect_set("w"))
        .alias("writers"))
    reads = f.striped.select("key", F.explode_outer("aggregators").alias("w")).groupBy("key").agg(F.array_sort(F.collect_set("w"))
        .alias("aggregators"))
    s = s.join(sets, "key").join(reads, "key")
    if roles is not None:
        masks = s.select("key", F.explode("writers").alias("fn")).join(roles, "fn",
            "left").groupBy("key").agg(F.when(F.bool_or(F.col("mask").isNull()), 0).otherwise(F.bit_or("mask")).alias("mask"))
        s = s.join(masks, "key", "left").withColumn("mask", F.coalesce("mask", F.lit(0)))
    else:
        s = s.withColumn("mask", F.lit(0))
    line = f.line
    s = s.withColumn("n_writers", F.size("writers")).withColumn("slots",
        F.when((F.col("elem_size") > 0) & (F.col("elem_size") < line), F.floor(F.lit(line) / F.col("elem_size"))).otherwise(0))
    s = s.where((F.col("n_writers") > 0) & (F.col("elem_size") % line != 0) & (F.col("slots") >= 2) & (F.col("mask") != S.MAIN))
    owner = F.lit(False)
    if f.signals is not None:
        s = s.crossJoin(F.broadcast(f.signals.agg(F.coalesce(F.bool_or("layout"), F.lit(False)).alias("__owner"))))
        owner = F.col("__owner")
    now, padded = F.col("elem_count") * F.col("elem_size"), F.col("elem_count") * line
    cost = (padded - now) / F.lit(float(f.l1d))
    hot, dear = F.col("writer_tier") == S.HOT_RATE, cost > 0.10
    fix = F.when(hot & ~dear, "full-pad").when(owner, "relocate-to-owner").when(hot, "head-pad").when(dear, "none").otherwise("head-pad")
    both = F.col("mask") == (S.MAIN | S.WORKER)
    strong = F.col("tls") | (F.col("n_writers") >= 2) | F.col("atomic")
    severity = F.when(fix == "none", S.INFO).when(hot,
        F.when(both, S.CRITICAL).otherwise(S.HIGH)).when(F.col("writer_tier") == S.UNKNOWN_RATE,
        F.when(both, S.CRITICAL).when(strong, S.HIGH).otherwise(S.MEDIUM)).otherwise(S.MEDIUM)
    head = F.col("head_pad")
    yes = lambda c: F.when(c, "yes").otherwise("no")
    evidence = F.create_map(
        *(x for k, v in {"symbol": F.col("name"), "elem_size": F.col("elem_size"), "elem_count": F.col("elem_count"),
                "slots_per_line": F.col("slots"), "contended_lines": F.ceil(F.col("elem_count") / F.col("slots")),
                "striped_writers": F.col("n_writers"), "tls_indexed": yes(F.col("tls")), "atomic_elem": yes(F.col("atomic")),
                "scope": F.when(F.col("static"), "file-static").otherwise("member"),
                "write_frequency": S.name_of(S.RATES, F.col("writer_tier")), "fix_shape": fix, "footprint_current": now,
                "footprint_padded": padded, "l1d_cost_pct": F.floor(cost * 100)}.items() for x in (F.lit(k), v.cast("string")))
    )
    evidence = F.when(F.coalesce(F.col("type"), F.lit("")) != "",
        F.map_concat(evidence, F.create_map(F.lit("type_name"), F.col("type")))).otherwise(evidence)
    claims = F.array(
        S.claim("several threads' slots share a line", "a stride below the line, without padding", True, S.MEDIUM),
        S.claim("each write moves the line between cores", "writers of several threads at separate slots",
            (F.col("n_writers") >= 2) | F.col("tls"), F.when(both, S.CRITICAL).otherwise(S.HIGH)),
        S.claim("the traffic lasts at hot rates", "writes on a path known to be hot", hot, S.CRITICAL),
    )
    notes = F.concat(F.transform("writers", lambda w: F.concat(F.lit("written under a thread's index in "), w)),
        F.transform("aggregators", lambda w: F.concat(F.lit("swept by a loop in "), w)),
        F.when(head, F.array(F.lit("only the first slot is alone on its line"))).otherwise(F.array().cast("array<string>")))
    return s.select(
        F.lit("FL003").alias("rule"), F.lit("Per-Thread Array False Sharing").alias("title"),
            F.when(head, F.least(severity, F.lit(S.MEDIUM))).otherwise(severity).alias("severity"),
        F.when(both, 0.88).when(strong, F.when(F.col("tls"), 0.78).otherwise(0.72)).otherwise(0.55).alias("confidence"),
            F.when(both, S.PROVEN).otherwise(S.LIKELY).alias("tier"), F.lit(False).alias("suppressed"),
        "file", "line", F.lit(1).alias("col"), F.lit("").alias("fn"),
            F.concat(F.lit("Slots of "), "name", F.lit(" that different cores write lie on one line.")).alias("reasoning"),
            evidence.alias("evidence"),
        F.concat(F.lit("Fix: "), fix).alias("mitigation"), notes.alias("escalations"), F.lit(S.COLD).alias("hotness"),
            claims.alias("claims"),
    )


def appended(df: DataFrame, more: DataFrame, stage: int, order: list[Column]) -> DataFrame:
    """``more`` after all findings so far, in its own order; it is worked out once, as sorting looks at it twice."""
    more = storage.saved(more, "more")
    return df.unionByName(ranking.ordinal(more, order).withColumn("stage", F.lit(stage)))


def policy_respect(df: DataFrame, f: Facts) -> DataFrame:
    """Where the program manages affinity or paging itself, the findings that presume nobody does are demoted."""
    if f.edges is None:
        return df
    seen = f.edges.agg(F.coalesce(F.bool_or(F.col("dst").isin(*AFFINITY)), F.lit(False)).alias("__aff"),
        F.coalesce(F.bool_or(F.col("dst").isin(*PAGING)), F.lit(False)).alias("__pag"))
    out = df.crossJoin(F.broadcast(seen))  # one row
    aff = ~F.col("suppressed") & (F.col("rule") == "FL060") & F.col("__aff")
    pag = ~F.col("suppressed") & (F.col("rule") == "FL070") & F.col("__pag")
    return out.withColumns(
        {
            "escalations": noted(aff | pag,
                F.when(aff, "placement is managed by the program").otherwise("paging is managed by the program")),
            "severity": F.when(aff, F.greatest(F.col("severity") - 1, F.lit(S.INFO))).when(pag, S.INFO).otherwise(F.col("severity")),
            "confidence": F.when(aff | pag, F.greatest(F.col("confidence") - 0.10, F.lit(0.05))).otherwise(F.col("confidence")),
        }
    ).drop("__aff", "__pag")


def dedup_key() -> Column:
    struct_key = F.concat_ws("|", F.lit("s"), "rule", "file", "line", F.nullif(ev("type_name"), F.lit("")))
    by_fn = F.when(F.coalesce(F.col("fn"), F.lit("")) != "",
        F.concat_ws("|", F.lit("f"), "rule", "fn", "line")).otherwise(F.concat_ws("|", F.lit("p"), "rule", "file", "line", "col"))
    return F.when((F.col("rule") == "FL040") & ev("var").isNotNull(),
        F.concat_ws("|", F.lit("v"), "rule", ev("var"), ev("type"))).when(F.col("rule").isin(*S.STRUCT_RULES), struct_key).otherwise(by_fn)


def deduplicate(df: DataFrame) -> DataFrame:
    """One finding a key: the most confident, then best evidenced, then of the shortest place; notes are united.

    If nothing repeats, notes keep their order. A group takes the place of its first member.
    """
    order = F.struct(-F.col("confidence"), F.col("tier"), F.length("file"), F.col("file"), F.col("line"), F.col("col"), F.col("fn"),
        *content(), F.col("stage"), F.col("ord"))
    best = F.min_by(F.struct(*df.columns), order).alias("__best")
    notes = F.array_distinct(F.flatten(F.collect_set("escalations"))).alias("__all")
    groups = df.groupBy(dedup_key().alias("__key")).agg(best, F.count("*").alias("__n"), F.min(F.struct("stage", "ord")).alias("__first"),
        notes)
    groups = storage.saved(groups.select("__best.*", "__n", "__first", "__all"), "ranked")
    repeats = bool(groups.agg(F.coalesce(F.max("__n") > 1, F.lit(False))).first()[0])
    # the survivor keeps its own repeats of a note
    merged = F.concat("__all", F.array(F
            .concat(F.lit("cross-TU: deduplicated from "), F.col("__n").cast("string"), F.lit(" translation unit(s)"))))
    said = F.array_sort(F.when(F.col("__n") == 1, F.col("escalations")).otherwise(merged)) if repeats else F.col("escalations")
    return groups.withColumns({"escalations": said, "stage": F.col("__first.stage"), "ord": F.col("__first.ord")}).select(df.columns)


def participant() -> Column:
    return F.concat(F.col("rule"), F.lit("@"), F.col("file"), F.lit(":"), F.col("line"))


def interactions(df: DataFrame) -> DataFrame:
    """Compound findings of classes that amplify each other at one place, type or function.

    Of each class the most confident finding of an entity takes part, the first of equals; a set of participants gives one compound a template.
    """
    spark = df.sparkSession
    cls = F.broadcast(spark.createDataFrame(list(S.CLASSES.items()), "rule string, cls string"))
    one = df.where(~F.col("suppressed") & ~F.col("rule").isin("FL090", "FL091")).join(cls, "rule")
    placed = F.when((F.coalesce(F.col("file"), F.lit("")) != "") & (F.col("line") > 0), F.concat("file", F.lit(":"), "line"))
    types = F.transform(F.filter(F.split(F.coalesce(ev("type_name"), F.lit("")), ";"), lambda t: t != ""),
        lambda t: F.concat(F.lit("type:"), t))
    named = F.when(F.coalesce(F.col("fn"), F.lit("")) != "", F.concat(F.lit("fn:"), "fn"))
    sites = F.array_distinct(F.concat(F.array_compact(F.array(placed, named)), types))
    keep = F.struct(participant().alias("p"), "rule", "title", "severity", "confidence", "tier", "file", "line", "col", "fn",
        S.supported_severity(F.col("claims")).alias("supported"), text.evidence_text(F.col("evidence")).alias("ev"), "stage", "ord")
    entries = one.select(sites.alias("sites"), "cls", keep.alias("d")).select(F.explode("sites").alias("site"), "cls", "d")
    best = entries.groupBy("site", "cls").agg(F.max_by("d", F.struct(F.col("d.confidence"), -F.col("d.stage"), -F.col("d.ord"))).alias("d"))
    best = best.withColumn("__c", F.count("*").over(W.partitionBy("site"))).where("__c > 1").drop("__c")
    # read once for each template
    per_site = storage.saved(best.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("cls", "d"))).alias("by")), "sites")
    found = None
    for ident, classes in S.INTERACTIONS:
        legs = [F.try_element_at("by", F.lit(c)) for c in classes]
        part = per_site.where(fold(Column.__and__, (x.isNotNull() for x in legs))).select("site", F.lit(ident).alias("template"),
            F.lit(" x ".join(classes)).alias("names"), F.array(*legs).alias("legs"))
        found = part if found is None else found.unionByName(part)
    # legs in the order of their findings, as they were met
    if_pair = F.size("legs") == 2
    by_order = F.array_sort("legs", lambda a,
        b: F.when(a["stage"] != b["stage"], a["stage"] - b["stage"]).when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0)
        .cast("int"))
    found = found.withColumn("legs", F.when(if_pair, by_order).otherwise(F.col("legs"))).withColumn("pk",
        F.array_join(F.array_sort(F.transform("legs", lambda x: x["p"])), "|"))
    once = found.groupBy("template", "pk").agg(F.min_by(F.struct("site", "names", "legs"), "site").alias("x")).select("template", "x.*")
    of = lambda k, how: how(F.transform("legs", lambda x: x[k]))
    rules = F.array_join(F.transform("legs", lambda x: x["rule"]), "+")
    a, b = F.col("legs")[0], F.col("legs")[1]
    base = {"interaction": F.col("template"), "components": rules, "site": F.col("site")}
    pair_only = {"threshold": F.lit(f"{S.AMPLIFIED - 1:.6f}"), "evidence_A": a["ev"], "evidence_B": b["ev"]}
    as_map = lambda m: F.create_map(*(x for k, v in m.items() for x in (F.lit(k), v)))
    return once.select(
        F.lit("FL091").alias("rule"), F.concat(F.lit("Synthesized Interaction: "), "names").alias("title"),
            F.when(if_pair, of("severity", F.array_max)).otherwise(S.CRITICAL).alias("severity"),
        F.least(F.lit(1.0), of("confidence", F.array_min) * S.AMPLIFIED).alias("confidence"), of("tier", F.array_min).alias("tier"),
            F.lit(False).alias("suppressed"), a["file"].alias("file"), a["line"].alias("line"), a["col"].alias("col"),
        F.when(if_pair & (F.coalesce(a["fn"], F.lit("")) == ""), b["fn"]).otherwise(a["fn"]).alias("fn"),
            F.concat(F.lit("Hazards that amplify each other at "), "site").alias("reasoning"),
        F.when(if_pair, as_map(base | pair_only)).otherwise(as_map(base)).alias("evidence"),
            F.lit("Mend the more severe of the hazards first; either alone relieves the other.").alias("mitigation"),
        F.concat(F.transform("legs", lambda x: F.concat(F.lit("Contributing: "), x["rule"], F.lit(", "), x["title"])),
            F.array(F.concat(F.lit("Interaction template: "), "template"))).alias("escalations"),
        F.lit(S.COLD).alias("hotness"), F
            .array(S.claim("hazards on one entity, paid together under load", "every component's own mechanism established", True,
                of("supported", F.array_min))).alias("claims"),
    )


def precedents(df: DataFrame, f: Facts) -> DataFrame | None:
    """Attributed false sharing in a type left as it is, while other types of the program are isolated on purpose; one a type."""
    if f.signals is None:
        return None
    known = merged_signals(f.signals).where("layout").select("type")
    cited = F.broadcast(known.agg(F.min("type").alias("__ex"), F.count("*").alias("__n")))  # one row
    mine = df.where(~F.col("suppressed") & F.col("rule").isin("FL002", "FL090") & (F.coalesce(ev("type_name"), F.lit("")) != "")
        & F.exists("escalations", lambda e: e.startswith(ROLES_NOTE)))
    mine = mine.withColumn("type", ev("type_name")).join(known, "type", "left_anti").crossJoin(cited).where("__n > 0")
    first = ranking.survivors(mine, ["type"], [F.col("stage"), F.col("ord")])
    n = F.col("__n").cast("string")
    return first.select(
        F.lit("FL092").alias("rule"), F.lit("Unapplied In-Tree Mitigation").alias("title"), "severity", "confidence", "tier",
            F.lit(False).alias("suppressed"), "file", "line", "col", "fn",
        F.concat(F.col("type"), F.lit(" is contended, while the program isolates other types, as "), "__ex").alias("reasoning"),
        F.create_map(F.lit("component"), F.col("rule"), F.lit("type_name"), F.col("type"), F.lit("mitigated_exemplar"), F.col("__ex"),
            F.lit("mitigated_type_count"), n).alias("evidence"),
        F.concat(F.lit("Isolate its fields as is done for "), "__ex").alias("mitigation"),
            F.array(F.concat(F.lit("precedents: "), n)).alias("escalations"), F.lit(S.COLD).alias("hotness"),
        F.array(S.claim("the component's own mechanism", "established by the attributed finding", True,
                S.supported_severity(F.col("claims"))), S
            .claim("the known fix was not applied here", "another type is isolated on purpose", True, F.col("severity"))).alias("claims"),
    )


def precision_budget(df: DataFrame, policies: dict[str, tuple[int, float, int]] | None = None) -> DataFrame:
    """Confidence floors, severity caps and budgets by rule, counted in the present order.

    Findings suppressed before use up budget; those suppressed here do not.
    """
    rows = [(k, *v) for k, v in (S.POLICIES | (policies or {})).items()]
    known = F.broadcast(df.sparkSession.createDataFrame(rows, "rule string, __most int, __floor double, __cap int"))
    out = df.join(known, "rule", "left").withColumn("__low",
        F.coalesce((F.col("confidence") < F.col("__floor")) & ~F.col("suppressed"), F.lit(False)))
    counted = F.coalesce((F.col("__most") > 0) & ~F.col("__low"), F.lit(False))
    # the last finding of a rule within its budget: only places are sorted
    places = out.where(counted).select("rule", "stage", "ord", "__most")
    last = ranking.running_budget(places, ["rule"], [F.col("stage"), F.col("ord")], F.col("__most"), "__run",
        "__demoted").where(F.col("__run") == F.col("__most"))
    last = storage.saved(last.select("rule", F.struct("stage", "ord").alias("__last")), "budgets")  # one row a rule
    out = out.join(storage.small(last), "rule", "left").withColumn("__over",
        counted & F.coalesce(F.struct("stage", "ord") > F.col("__last"), F.lit(False)))
    high = ~F.col("__low") & F.coalesce(F.col("severity") > F.col("__cap"), F.lit(False))
    empty = F.array().cast("array<string>")
    notes = F.concat(F.when(F.col("__low"), F.array(F.lit("budget: confidence below the floor"))).otherwise(empty),
        F.when(high, F.array(F.concat(F.lit("budget: severity capped to "), S.name_of(S.SEVERITIES, F.col("__cap"))))).otherwise(empty),
        F.when(F.col("__over"), F.array(F.lit("budget: emission limit exceeded"))).otherwise(empty))
    return out.withColumns({"escalations": F.concat("escalations", notes), "suppressed": F.col("suppressed") | F.col("__low"),
            "severity": F.when(F.col("__over"), S.INFO).when(high, F.col("__cap")).otherwise(F.col("severity"))}).select(df.columns)


def features() -> Column:
    """The ten numbers by which findings are compared."""
    n = lambda k: text.leading_number(ev(k))
    return F.array(F.col("severity").cast("double"), F.col("confidence"), F.size("escalations").cast("double"),
        *(n(k) for k in ("sizeof", "cache_lines", "atomic_writes", "mutable_fields", "estimated_frame", "depth", "callees")))


def hazard_class(strict: bool = True) -> Column:
    """P10: the class of a finding's rule; the lenient form takes CacheGeometry for rules without one."""
    out = F.lit(None if strict else "CacheGeometry")
    for rule, c in S.CLASSES.items():
        out = F.when(F.col("rule") == rule, c).otherwise(out)
    return out


def inferred_tier() -> Column:
    """The evidence tier that the evidence speaks for."""
    layout = ev("sizeof").isNotNull() | ev("cache_lines").isNotNull() | ev("straddling_fields").isNotNull()
    weak = (F.coalesce(ev("thread_escape"), F.lit("")) == "true") | (F.coalesce(ev("atomics"), F.lit("")) == "yes")
    return F.when(layout, F.when(weak, S.LIKELY).otherwise(S.PROVEN)).when(ev("ordering") == "seq_cst",
        S.PROVEN).when(ev("atomic_writes").isNotNull() | ev("virtual_call").isNotNull(), S.LIKELY).otherwise(S.SPECULATIVE)


def calibration_suppression(df: DataFrame, registry: DataFrame, radius: float = 0.25, least: int = 3) -> DataFrame:
    """Findings near what was refuted ``least`` times in their class go; never what is proven and at least High."""
    safe = (F.col("severity") >= S.HIGH) & (F.col("tier") == S.PROVEN)
    a = df.withColumn("__f", F.when(~safe, features())).withColumn("__cls", hazard_class(False))
    r = registry.where(F.col("refutations") >= least).select(F.col("cls").alias("__cls"), "features")
    return joins.radius_join(a, r, ["__cls"], "__f", "features", radius, "left_anti").select(df.columns)


def blended_confidence(df: DataFrame, priors: DataFrame) -> DataFrame:
    """Confidences moved to their class's prior (cls, prior, n) by its evidence."""
    from strideway.operators import stats

    known = storage.small(storage.saved(priors.select("cls", "prior", "n"), "priors"))  # one row a class
    out = df.withColumn("cls", hazard_class(False)).join(known, "cls", "left")
    return out.withColumn("confidence", stats.blended(F.col("confidence"), F.col("prior"), F.col("n"))).select(df.columns)


def match_traces(df: DataFrame, traces: DataFrame) -> DataFrame:
    """Each trace record (id, fn, file, line) with the class of the first finding of its function or place."""
    own = df.select(F.struct("stage", "ord").alias("__at"), hazard_class(False).alias("cls"), "fn", "file", "line")
    by_fn = traces.join(own.where("fn <> ''").select("fn", "__at", "cls"), "fn").select("id", "__at", "cls")
    by_place = traces.where("file <> ''").join(own.select("file", "line", "__at", "cls"), ["file", "line"]).select("id", "__at", "cls")
    return by_fn.unionByName(by_place).groupBy("id").agg(F.min_by("cls", "__at").alias("cls"))


def clamp(df: DataFrame) -> DataFrame:
    """No severity beyond what the claims support."""
    return df.withColumn("severity", F.least(F.col("severity"), S.supported_severity(F.col("claims"))))


def clamp_counts(df: DataFrame) -> DataFrame:
    """(rule, bound): how many findings the claims bound, by rule."""
    return df.where(F.col("severity") > S.supported_severity(F.col("claims"))).groupBy("rule").agg(F.count("*").alias("bound"))


def out_of_tree(df: DataFrame, root: str) -> DataFrame:
    """Findings outside the root are suppressed."""
    prefix = root.rstrip("/") + "/"
    return df.withColumn("suppressed", F.col("suppressed") | ~F.coalesce(F.col("file").startswith(prefix), F.lit(False)))


def inline_suppression(df: DataFrame, lines: DataFrame, marker: str = "hazard-suppress") -> DataFrame:
    """``marker`` on a finding's line or the one above suppresses it; with rule ids after it, only those."""
    tail = F.regexp_extract("text", marker + r"(.*)$", 1)
    marks = lines.where(F.contains("text", F.lit(marker))).select("file",
        F.explode(F.array(F.col("line"), F.col("line") + 1)).alias("line"),
        F.transform(F.filter(F.split(F.regexp_replace(F.trim(tail), r"\*/\s*$", ""), r"[,]"), lambda x: F.trim(x) != ""),
            lambda x: F.trim(x)).alias("ids"))
    marks = marks.groupBy("file", "line").agg(F.bool_or(F.size("ids") == 0).alias("__bare"),
        F.flatten(F.collect_list("ids")).alias("__ids"))
    out = df.join(storage.small(storage.saved(marks, "marks")), ["file", "line"], "left")
    hit = F.coalesce(F.col("__bare") | F.array_contains("__ids", F.col("rule")), F.lit(False))
    return out.withColumn("suppressed", F.col("suppressed") | hit).select(df.columns)


def final_filter(df: DataFrame, severity: int = S.INFO, tier: int = S.SPECULATIVE, disabled: list[str] | None = None) -> DataFrame:
    """P4 and P5."""
    out = df.where(~F.col("suppressed") & (F.col("severity") >= severity) & (F.col("tier") <= tier))
    return out.where(~F.col("rule").isin(*disabled)) if disabled else out


def missing_headers(failures: DataFrame, least: int = 3) -> DataFrame:
    """Findings of headers that at least so many units miss."""
    h = failures.select(F.regexp_extract("error", r"fatal error:[^']*'([^']+)'", 1).alias("h")).where("h <> ''").groupBy("h").agg(F
        .count("*").alias("n")).where(F.col("n") >= least)
    return h.select(
        F.lit("B001").alias("rule"), F.concat(F.lit("Header '"), "h", F.lit("' is missing in "), F.col("n").cast("string"), F.lit(" units"))
            .alias("title"), F.lit(S.MEDIUM).alias("severity"), F.lit(1.0).alias("confidence"), F.lit(S.SPECULATIVE).alias("tier"),
        F.lit(False).alias("suppressed"), F.lit("<pipeline>").alias("file"), F.lit(0).alias("line"), F.lit(0).alias("col"),
            F.lit("").alias("fn"), F.lit("").alias("reasoning"),
            F.create_map(F.lit("missing_header"), F.col("h"), F.lit("tu_count"), F.col("n").cast("string")).alias("evidence"),
        F.lit("").alias("mitigation"), F.array().cast("array<string>").alias("escalations"), F.lit(S.COLD).alias("hotness"),
            F.array().cast(f"array<{S.CLAIM}>").alias("claims"),
    )


def output_order() -> list[Column]:
    return [F.col("severity").desc(), F.col("file"), F.col("line"), F.col("col"), F.col("rule"), *content()]


def status(n_findings: int, n_failures: int) -> int:
    """1 with findings, else 2 with failures, else 0."""
    return 1 if n_findings else 2 if n_failures else 0


def run(findings: DataFrame, f: Facts, root: str | None = None, severity: int = S.INFO, tier: int = S.SPECULATIVE,
    registry: DataFrame | None = None, priors: DataFrame | None = None, policies: dict | None = None,
    progress: Callable[[str, str], None] | None = None) -> DataFrame:
    """All steps in order; the result has the findings' columns, in output order. ``progress`` is told (stage, detail) as stages begin."""
    told = progress or (lambda stage, detail: None)
    columns = findings.columns
    told("merge", f"{f.units} units")
    if f.lines is not None:
        findings = inline_suppression(findings, f.lines)
    df = ir_refinement(global_writes(canonical(findings)), f)
    df = sharing_verdict(escape_suppression(df, f), f)
    told("roles", "thread roles and hotness of the whole program")
    roles = storage.saved(r, "roles") if f.edges is not None and (r := thread_roles(f)) is not None else None
    df = role_escalation(df, f, roles)
    df = devirtualise(resolve_candidates(df, f), f)
    if f.striped is not None:
        df = appended(df, stripe_findings(f, roles).select(columns), 1, [F.col("file"), F.col("line"), *content()])
    told("deduplicate", "one finding a key")
    df = deduplicate(policy_respect(df, f))
    told("interactions", "compound findings and precedents")
    df = appended(df, interactions(df).select(columns), 2, [text.evidence_text(F.col("evidence")), *content()])
    more = precedents(df, f)
    if more is not None:
        df = appended(df, more.select(columns), 3, [F.col("file"), F.col("line"), *content()])
    told("budget", "floors, caps and emission limits")
    df = precision_budget(df, policies)
    if registry is not None:
        df = calibration_suppression(df, registry)
    if priors is not None:
        df = blended_confidence(df, priors)
    df = clamp(df)
    if root is not None:
        df = out_of_tree(df, root)
    df = final_filter(df, severity, tier).select(columns)
    if f.failures is not None:
        df = df.unionByName(missing_headers(f.failures).select(columns))
    # written, as sorting looks at it twice
    rows, by = ranking.keyed(storage.saved(df, "final"), output_order())
    return rows.orderBy(*by).select(columns)
