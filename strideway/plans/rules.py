"""Hazard rules: each a projection of fact rows to findings with a grade, evidence and claims.

Facts are one row a site (``fn``, ``file``, ``line``, ``col``, ``hotness``, ``in_loop`` ...) or one a record (``record_summary``). A rule
that needs heat takes rows with a hotness above none and adds a gate that bounds its severity by how the heat is known.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideway import schemas as S
from strideway import storage
from strideway.functions import text
from strideway.operators import layout
from strideway.plans.reduce import HOT_EFFECT, RECEIVER_EFFECT
from strideway.schemas import CRITICAL, HIGH, INFO, LIKELY, MEDIUM, PROVEN, SPECULATIVE

RULES: dict[str, Callable[..., DataFrame]] = {}
NEEDS: dict[str, str] = {}

REFCOUNTS = "ref refs refcount refcnt count cnt nref nrefs rc usecount refcountandflags".split()
HEAD = ("head", "front", "dequeue", "cons", "pop")
TAIL = ("tail", "back", "enqueue", "prod", "push")
QUEUES = ("queue", "buffer", "ring", "channel", "spsc", "mpmc", "mpsc")
#: Names of a queue's ends among atomic fields, where a looser sign will do.
ENDS = (*HEAD, *TAIL, "read", "write")
PLACEMENT = {"local-init": 0.3, "main-thread": 0.8, "any-thread": 1.0, "interleaved": 0.4, "explicit-bind": 0.1, "unknown": 1.0}
ALLOCATOR_FACTOR = {"thread-local-cache": 0.3, "arena-lock": 1.0, "syscall-mmap": 1.5, "pool-slab": 0.2, "unknown": 1.0}
#: Calls that pause, yield or wait: bare names, their beginnings, and qualified names.
RELAX = (
    "_mm_pause sched_yield pthread_yield nanosleep usleep sleep cpu_relax futex syscall _umwait _tpause _umonitor _mm_monitor _mm_mwait wait wait_for wait_until "
    "rte_pause rte_delay_us rte_delay_us_block epoll_wait epoll_pwait ppoll poll select pselect"
).split()
RELAX_STARTS = [f"__builtin_ia32_{x}" for x in ("umwait", "tpause", "monitor", "mwait")]
RELAX_QUALIFIED = [f"std::this_thread::{x}" for x in ("yield", "sleep_for", "sleep_until")]
PAGE, HUGE = 4096, 2 << 20


def rule(ident: str, needs: str):
    """Registers a rule by its id and the fact table that it reads."""

    def add(f):
        RULES[ident], NEEDS[ident] = f, needs
        return f

    return add


def yes(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), "yes").otherwise("no")


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def finding(df: DataFrame, ident: str, title: str, severity, confidence, tier, evidence: dict, claims: list[Column],
    notes: list[tuple] = (), gated: bool = False, why: str = "", fix: str = "") -> DataFrame:
    """Findings of rows of facts; notes are (condition, text). Null evidence is left out."""
    sev = lit(severity).cast("int")
    hot = F.coalesce(F.col("hotness"), F.lit(S.COLD)) if gated else F.lit(S.COLD)
    parts = list(claims)
    if gated:
        parts.append(S.claim(F.concat(F.lit(f"{HOT_EFFECT} ("), S.name_of(S.HOTNESS, hot), F.lit(")")),
                "a profile or a declaration says so", hot >= S.DECLARED, S.hot_severity(hot, sev), gating=True))
    facts = F.map_filter(F.create_map(*(x for k, v in evidence.items() for x in (F.lit(k), lit(v).cast("string")))), lambda k,
        v: v.isNotNull())
    said = F.array_compact(F.array(*(F.when(c, lit(t)) for c, t in notes))) if notes else F.array().cast("array<string>")
    fn = F.coalesce(F.col("fn"), F.lit("")) if "fn" in df.columns else F.lit("")
    return df.select(
        F.lit(ident).alias("rule"), F.lit(title).alias("title"), sev.alias("severity"), lit(confidence).cast("double").alias("confidence"),
            lit(tier).cast("int").alias("tier"), F.lit(False).alias("suppressed"),
        "file", F.col("line").cast("int").alias("line"), (F.col("col") if "col" in df.columns else F.lit(1)).cast("int").alias("col"),
            fn.alias("fn"), F.lit(why).alias("reasoning"), facts.alias("evidence"),
        F.lit(fix).alias("mitigation"), said.alias("escalations"), hot.cast("int").alias("hotness"), F.array(*parts).alias("claims"),
    )


def hot(df: DataFrame) -> DataFrame:
    return df.where(F.col("hotness") > S.COLD)


def distinct_writers(pairs: DataFrame, writers: DataFrame) -> DataFrame:
    """``pairs`` (type, a, b ...) with ``apart``: whether two functions write the pair, or one that several threads run.

    ``writers``: type, field, writer, pool. A field that nothing writes tells nothing.
    """
    w = written_by(writers)
    a, b = (w.select("type", F.col("field").alias(c), F.col("n").alias(f"{c}_n"), F.col("w").alias(f"{c}_w"),
            F.col("pool").alias(f"{c}_pool")) for c in ("a", "b"))
    out = pairs.join(a, ["type", "a"], "left").join(b, ["type", "b"], "left")
    two = (F.col("a_n") > 1) | (F.col("b_n") > 1) | (F.col("a_w") != F.col("b_w")) | F.col("a_pool") | F.col("b_pool")
    known = F.col("a_n").isNotNull() & F.col("b_n").isNotNull()
    return out.withColumn("apart", known & F.coalesce(two, F.lit(False))).drop("a_n", "a_w", "a_pool", "b_n", "b_w", "b_pool")


def mixed_lines(fields: DataFrame, line: int = 64) -> DataFrame:
    """(type, line_index) of the lines that an atomic shares with plain mutable fields, at any start of the record."""
    at = layout.buckets(fields.where(F.col("mutable") | F.col("atomic")), ["type"], line)
    by = at.groupBy("type", "line_index").agg(F.count(F.when(F.col("atomic"), 1)).alias("a"), F.count("*").alias("m"))
    return by.where("a > 0 AND m > a").select("type", "line_index")


def written_by(writers: DataFrame) -> DataFrame:
    """(type, field, n, w, pool): how many functions write a field, the first, and whether several threads run one."""
    return writers.groupBy("type", "field").agg(F.count_distinct("writer").alias("n"), F.min("writer").alias("w"),
        F.bool_or("pool").alias("pool"))


def _looks(c: Column, names: tuple) -> Column:
    return F.lower(c).rlike("|".join(names))


def field_pairs(can: DataFrame, writers: DataFrame | None, line: int) -> DataFrame:
    """(type, ``layout.PAIR_COUNTS``) of the fields that can be written, with their record's ``align``.

    Pairs are counted without being listed; only records that repeat a name or a place, or leave one out, list them.
    """
    can = storage.saved(can.select("type", "field", "ord", "offset", "size", "align", "n_elements", "atomic"), "fields")
    missing = F.lit(False)
    for c in ("field", "ord", "offset", "size", "align"):
        missing = missing | F.col(c).isNull()
    n = F.count("*")
    odd = can.groupBy("type").agg((F.bool_or(missing) | (F.count_distinct("field") < n) | (F.count_distinct("ord") < n)).alias("odd"))
    odd = storage.saved(odd.where("odd").select("type"), "odd")
    some = not odd.isEmpty()
    plain = can.join(storage.small(odd), "type", "left_anti") if some else can
    if writers is None:
        plain = plain.withColumns({"known": F.lit(True), "strong": F.lit(True), "writer": F.lit(None).cast("string")})
    else:
        by = written_by(writers).withColumnRenamed("w", "writer")
        plain = plain.join(by.hint("merge"), ["type", "field"], "left").withColumns({"known": F.col("n").isNotNull(),
                "strong": F.coalesce((F.col("n") > 1) | F.col("pool"), F.lit(False))})
    counted = layout.pair_counts(plain.select("type", "field", "ord", F.col("offset").cast("bigint").alias("offset"),
            layout.line_limit(F.col("offset"), F.col("size"), F.col("align"), line).cast("bigint").alias("limit"),
            (F.col("n_elements") >= 2).alias("own"), F.coalesce("atomic", F.lit(False)).alias("atomic"), "known", "strong",
            F.col("writer").cast("string").alias("writer"), _looks(F.col("field"), HEAD).alias("head"),
            _looks(F.col("field"), TAIL).alias("tail")), "type")
    if not some:
        return counted
    return counted.unionByName(_listed_pairs(can.join(storage.small(odd), "type", "left_semi"), writers, line))


def _listed_pairs(can: DataFrame, writers: DataFrame | None, line: int) -> DataFrame:
    """``field_pairs`` by the pairs themselves."""
    flag = can.select("type", F.col("field").alias("name"), F.col("atomic").alias("is_atomic"), F.col("ord").alias("place"))
    pairs = layout.line_pairs(can, ["type"], "ord", line)
    a, b = (flag.select("type", F.col("name").alias(n), F.col("is_atomic").alias(f"{n}_atomic"), F.col("place").alias(f"{n}_ord"))
        for n in ("a", "b"))
    pairs = pairs.join(a, ["type", "a"]).join(b, ["type", "b"])
    pairs = distinct_writers(pairs, writers) if writers is not None else pairs.withColumn("apart", F.lit(True))
    queue = (_looks(F.col("a"), HEAD) & _looks(F.col("b"), TAIL)) | (_looks(F.col("a"), TAIL) & _looks(F.col("b"), HEAD))
    return pairs.groupBy("type").agg(
        F.count(F.when(F.col("a") != F.col("b"), 1)).alias("pairs"),
            F.count(F.when((F.col("a") == F.col("b")) & F.col("apart"), 1)).alias("own_pairs"), F.bool_or("apart").alias("pair_writers"),
            F.count(F.when(F.col("a_atomic") & F.col("b_atomic"), 1)).alias("atomic_pairs"), F.bool_or(queue).alias("queue_pair"),
        F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("a_ord", "b_ord", "a", "b"))),
                    lambda p: F.concat(p["a"], F.lit("|"), p["b"])), 1, 64), ";").alias("pair_fields"),
    )


def record_summary(records: DataFrame, fields: DataFrame, escapes: DataFrame, line: int = 64,
    writers: DataFrame | None = None) -> DataFrame:
    """One row a record: geometry, field pairs and sharing evidence.

    With ``writers`` (type, field, writer, pool) a record counts as written by several where a pair of its fields is (G15), and of an array
    with itself only those pairs that are; without, ``escapes`` says so of the whole record.

    ``records``: type, file, line, size, align; ``fields``: type, field, ord, offset, size, granule, atomic, mutable, n_elements,
    char_array; ``escapes``: type, escapes, contention, multi_writer, sync, writes, signals beyond atomics and placement, where known.
    """
    head = records.select("type", "align", F.col("size").alias("record_size"))
    f = fields.join(head, "type")
    split = layout.splits(F.col("offset"), F.col("size"), F.col("granule"), F.col("align"), line)
    per = f.groupBy("type").agg(
        F.count(F.when(F.col("atomic"), 1)).alias("atomic_fields"), F.count(F.when(F.col("mutable"), 1)).alias("mutable_fields"),
            F.count(F.when(split, 1)).alias("straddling"),
        F.count_distinct(F.when(F.col("atomic"), layout.first_line(F.col("offset"), line))).alias("atomic_lines"),
            F.count_distinct(F.when(F.col("mutable") | F.col("atomic"), layout.first_line(F.col("offset"), line))).alias("writer_lines"),
        F.max_by(F.col("char_array") & (F.col("offset") + F.col("size") >= F.col("record_size")) & (F.col("record_size") % line == 0),
            F.col("ord")).alias("padded"),
        F.max(F.when(F.col("atomic"), F.lower(F.regexp_replace("field", "^_+|_+$", "")).isin(*REFCOUNTS))).alias("counts"),
        F.bool_or(F.col("atomic") & F.lower("field").rlike("|".join(ENDS))).alias("head_tail"),
    )
    can = f.where(F.col("mutable") | F.col("atomic"))
    mixed = mixed_lines(f, line).groupBy("type").agg(F.count("*").alias("mixed_lines"))
    paired = field_pairs(can.withColumn("n_elements", F.coalesce("n_elements", F.lit(1))), writers, line)
    out = records.join(per, "type").join(paired, "type", "left").join(mixed, "type", "left").join(escapes, "type", "left")
    if writers is not None:
        out = out.withColumn("multi_writer", F.coalesce("pair_writers", F.lit(False)))
    out = out.drop("pair_writers")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("pairs", "own_pairs", "atomic_pairs", "mixed_lines")}
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("escapes", "multi_writer", "sync", "padded", "queue_pair", "beyond_atomics")}
    out = out.withColumns(zero | flags | {"contention": F.coalesce("contention", F.lit(0.0)), "writes": F.coalesce("writes", F.lit(0)),
            "placement": F.coalesce("placement", F.lit("unknown"))})
    return out.withColumns({"lines": layout.lines_worst(F.col("size"), F.col("align"), line),
            "min_lines": layout.lines_best(F.col("size"), line), "deliberate": (F.col("align") >= line) | F.col("padded"),
            "refcount_only": (F.col("atomic_fields") == 1) & F.coalesce("counts", F.lit(False))})


def _sized(*more: str) -> dict:
    return {"sizeof": F.concat(F.col("size").cast("string"), F.lit("B")), **{m: F.col(m) for m in more}, "type_name": F.col("type")}


def no_more_than(c: Column, when: Column, most: int) -> Column:
    return F.when(when, F.least(c, F.lit(most))).otherwise(c)


@rule("FL001", "record")
def spanning_records(records: DataFrame, line: int = 64, **_) -> DataFrame:
    d = records.where("lines > 1")
    bare = F.col("atomic_fields") == 0
    sev = F.when((F.col("min_lines") >= 3) & ((F.col("writer_lines") == 0) | (F.col("writer_lines") >= 3)), CRITICAL).otherwise(HIGH)
    sev = no_more_than(sev, F.col("refcount_only"), MEDIUM)
    sev = no_more_than(sev, F.col("size") <= line, MEDIUM)
    sev = no_more_than(sev, ~F.col("escapes") & bare, MEDIUM)
    sev = no_more_than(sev, (F.col("contention") < 0.30) & bare, MEDIUM)
    sev = no_more_than(sev, F.col("deliberate") & ~bare, MEDIUM)
    conf = F.when(~F.col("escapes") & bare, F.when(F.col("min_lines") >= 3, 0.52).otherwise(0.42)).when(F.col("size") <= line,
        F.when(bare, 0.45).otherwise(0.55)).when(F.col("min_lines") >= 3, F.when(bare, 0.82).otherwise(0.90)).otherwise(0.72)
    ev = _sized() | {"lines_spanned": F.col("lines"), "writer_lines": F.col("writer_lines"), "straddling_fields": F.col("straddling"),
        "atomic_fields": F.col("atomic_fields"), "mutable_fields": F.col("mutable_fields"),
        "thread_escape": F.when(F.col("escapes"), "true").otherwise("false"),
        "contention": F.concat(F.floor(F.col("contention") * 100).cast("string"), F.lit("%"))}
    claims = [S.claim("the object takes several lines of L1D", "a record beyond one line", True, HIGH),
        S.claim("a transfer of ownership for each written line", "fields written on three lines or more", F.col("writer_lines") >= 3,
            CRITICAL), S.claim("accesses split over a border of lines", "a field whose granule crosses it", F.col("straddling") > 0, HIGH)]
    return finding(d, "FL001", "Cache Line Spanning Struct", sev, conf, PROVEN, ev, claims, [(F.col("deliberate"), "layout is deliberate")])


@rule("FL002", "record")
def false_sharing(records: DataFrame, **_) -> DataFrame:
    counted = F.col("pairs") + F.when(F.col("multi_writer"), F.col("own_pairs")).otherwise(0)
    d = records.where(F.col("escapes") & (counted > 0) & ((F.col("atomic_fields") > 0) | F.col("multi_writer"))
        & ~(F.col("refcount_only") & (F.col("atomic_pairs") == 0)))
    atomics, pairs = F.col("atomic_fields") > 0, F.col("atomic_pairs") > 0
    sev = F.when(pairs, CRITICAL).otherwise(HIGH)
    sev = no_more_than(sev, F.col("deliberate"), MEDIUM)
    sev = no_more_than(sev, ~atomics & F.col("sync"), MEDIUM)
    sev = F.when((F.col("writes") == 0) & (sev == CRITICAL), HIGH).otherwise(sev)
    conf = F.when(pairs & (F.col("align") >= 64), 0.88).when(pairs, 0.80).when(atomics, 0.68).otherwise(0.60)
    conf = F.when(F.col("multi_writer"), F.least(conf + 0.06, F.lit(0.95))).when(F.col("writes") == 0,
        F.greatest(conf - 0.08, F.lit(0.50))).otherwise(conf)
    ev = _sized() | {"lines": F.col("lines"), "mutable_pairs_same_line": F.col("pairs"), "atomic_pairs_same_line": F.col("atomic_pairs"),
        "thread_escape": "true", "atomics": yes(atomics), "pair_fields": F.col("pair_fields")}
    claims = [S.claim("mutable fields lie on one line", "both on it at some start", True, MEDIUM),
        S.claim("cores invalidate each other's line", "distinct writers of the pair, or atomics", pairs | F.col("multi_writer"),
            F.when(F.col("deliberate"), MEDIUM).otherwise(CRITICAL))]
    return finding(d, "FL002", "False Sharing Candidate", sev, conf, F.when(pairs & (F.col("align") >= 64), PROVEN).otherwise(LIKELY), ev,
        claims, [(F.col("deliberate"), "layout is deliberate"), (F.col("multi_writer"), "several writers"),
            (F.col("pairs") > 5, F.concat(F.lit("and "), (F.col("pairs") - 5).cast("string"), F.lit(" more pairs on shared lines")))])


@rule("FL010", "atomic_site")
def strong_ordering(sites: DataFrame, arm: bool = False, **_) -> DataFrame:
    d = hot(sites).where("ordering = 'seq_cst'")
    d = d if arm else d.where("op_class = 'store'")
    store = F.col("op_class") == "store"
    sev = F.when(store & F.col("in_loop"), CRITICAL).when(store, CRITICAL if arm else HIGH).otherwise(HIGH)
    conf = F.when(store & F.col("in_loop"), 0.92).when(store, 0.90 if arm else 0.85).otherwise(0.80)
    ev = {"op": F.col("op"), "op_class": F.col("op_class"), "var": F.col("var"), "ordering": "seq_cst", "function": F.col("fn"),
        "in_loop": yes(F.col("in_loop")), "target_arch": "arm64" if arm else "x86-64", "type_name": F.nullif("owner_type", F.lit(""))}
    claims = [S.claim("a full barrier where a weaker order would do", "an operation whose relaxed form is cheaper", True, sev),
        S.claim("the operation recurs", "it is in a loop", F.col("in_loop"), CRITICAL)]
    return finding(d, "FL010", "Overly Strong Atomic Ordering", sev, conf, PROVEN, ev, claims, gated=True)


@rule("FL011", "atomic_site")
def atomic_contention(sites: DataFrame, **_) -> DataFrame:
    w = hot(sites).where("op_class <> 'load'")
    d = w.groupBy("fn", "file").agg(F.min("line").alias("line"), F.max("hotness").alias("hotness"), F.count("*").alias("n"),
        F.bool_or("in_loop").alias("looped"), F.array_join(F.array_sort(F.collect_set("op")), ",").alias("ops"),
        F.array_join(F.array_sort(F.collect_set(F.nullif("owner_type", F.lit("")))), ";").alias("owners"))
    d = d.where("n >= 2 OR looped")
    sev = F.when(F.col("looped"), CRITICAL).when(F.col("n") >= 3, HIGH).otherwise(MEDIUM)
    ev = {"function": F.col("fn"), "atomic_writes": F.col("n"), "loop_writes": yes(F.col("looped")), "ops": F.col("ops"),
        "type_name": F.nullif("owners", F.lit(""))}
    claims = [S.claim("atomic writes serialise on the line's owner", "several atomic writes in a function", True, HIGH),
        S.claim("ownership is taken in each round", "an atomic write in a loop", F.col("looped"), CRITICAL)]
    return finding(d, "FL011", "Atomic Contention Hotspot", sev, F.when(F.col("looped"), 0.65).otherwise(0.50), LIKELY, ev, claims,
        gated=True)


@rule("FL012", "lock_site")
def hot_locks(sites: DataFrame, **_) -> DataFrame:
    both, one = F.col("in_loop") & F.col("nested"), F.col("in_loop") | F.col("nested")
    sev = F.when(both, CRITICAL).when(one, HIGH).otherwise(MEDIUM)
    ev = {"lock_type": F.col("kind"), "function": F.col("fn"), "nested": yes(F.col("nested")), "in_loop": yes(F.col("in_loop"))}
    claims = [S.claim("taking the lock and the width of its section", "a lock on a hot path", True, sev),
        S.claim("waiting threads are switched out", "a second thread at this lock", False, CRITICAL)]
    return finding(hot(sites), "FL012", "Lock in Hot Path", sev, 0.75, PROVEN, ev, claims, gated=True)


def relaxes(calls: Column, patterns: list[str] | tuple = ()) -> Column:
    """Whether any of the calls, separated by spaces, pauses, yields or waits; ``patterns`` are globs for further ones."""
    bare = lambda c: F.substring_index(c, "::", -1)
    one = lambda c: bare(c).isin(*RELAX) | c.isin(*RELAX_QUALIFIED) | bare(c).rlike("^(" + "|".join(RELAX_STARTS)
        + ")") | text.matches_glob(bare(c), list(patterns)) | text.matches_glob(c, list(patterns))
    return F.exists(F.split(F.coalesce(calls, F.lit("")), " "), lambda c: (c != "") & one(c))


@rule("FL013", "spin_site")
def bare_spins(sites: DataFrame, smt: bool = True, relax: list[str] | tuple = (), **_) -> DataFrame:
    d = hot(sites).where((F.col("body_stmts") <= 4) & ~relaxes(F.col("calls"), relax) & ~F.col("relaxed"))
    conf = F.when(F.col("form") == "tas", 0.78).when(F.col("form") == "cas", 0.62).otherwise(0.75)
    ev = {"polled": F.col("polled"), "form": F.concat("form", F.lit("-spin")), "body_stmts": F.col("body_stmts"),
        "smt_model": "on" if smt else "off"}
    claims = [S.claim("the pipeline is cleared when the awaited write lands", "a tight poll without a pause", True, MEDIUM),
        S.claim("the sibling thread starves", "two threads a core", smt, HIGH),
        S.claim("the line stays in the spinner's cache", "a spin that writes each round", F.col("form") == "tas", HIGH)]
    return finding(d, "FL013", "Spin Loop Without Pause", HIGH if smt else MEDIUM, conf, LIKELY, ev, claims, gated=True)


@rule("FL020", "alloc_site")
def hot_allocations(sites: DataFrame, **_) -> DataFrame:
    d = hot(sites)
    factor = F.coalesce(F.try_element_at(F.create_map(*(x for k, v in ALLOCATOR_FACTOR.items() for x in (F.lit(k), F.lit(v)))),
            F.col("allocator")), F.lit(1.0))
    sev = F.when(factor < 0.4, MEDIUM).when(factor < 0.8, HIGH).otherwise(CRITICAL)
    sev = F.when(F.col("in_loop") | F.col("flows_to_loop"), F.greatest(sev, F.lit(HIGH))).otherwise(sev)
    conf = F.greatest(F.lit(0.20), F.least(F.lit(1.0), 0.75 * factor))
    conf = F.when(F.col("escapes") & (conf < 0.85), conf + 0.10).otherwise(conf)
    ev = {"alloc_type": F.col("kind"), "allocator_class": F.col("allocator"), "function": F.col("fn"), "in_loop": yes(F.col("in_loop")),
        "hot_path": "true", "alloc_escapes": yes(F.col("escapes")), "flows_to_loop": yes(F.col("flows_to_loop"))}
    claims = [S.claim("a round trip to the allocator and lost locality", "an allocation on a hot path", True, MEDIUM),
        S.claim("arenas are contended", "a free on another thread", False, HIGH),
        S.claim("a system call and page faults", "an allocation beyond the mapping threshold", F.col("allocator") == "syscall-mmap",
            CRITICAL), S.claim("the cost is paid in each round", "an allocation in a loop", F.col("in_loop"), HIGH)]
    return finding(d, "FL020", "Heap Allocation in Hot Path", sev, conf, LIKELY, ev, claims, gated=True)


@rule("FL021", "local_var")
def stack_frames(locals_: DataFrame, threshold: int = 2048, **_) -> DataFrame:
    d = locals_.groupBy("fn", "file").agg(F.min("fn_line").alias("line"), F.max("hotness").alias("hotness"), F.sum("size").alias("frame"),
        F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("n"), "var"))), lambda x: x["var"]), 1,
                5), ",").alias("largest")).where(F.col("frame") >= threshold)
    warm, pages = F.col("hotness") > S.COLD, F.col("frame") > PAGE
    sev = F.when(warm & pages, CRITICAL).when(warm, HIGH).otherwise(MEDIUM)
    ev = {"estimated_frame": F.concat(F.col("frame").cast("string"), F.lit("B")), "threshold": f"{threshold}B",
        "large_locals": F.col("largest")}
    claims = [S.claim("lines of L1D touched on entry", "a frame of some size", True, F.when(warm, HIGH).otherwise(MEDIUM)),
        S.claim("pages beyond the TLB", "a frame beyond a page", pages, CRITICAL)]
    cold = finding(d.where(~warm), "FL021", "Large Stack Frame", sev, 0.80, LIKELY, ev, claims)
    return finding(d.where(warm), "FL021", "Large Stack Frame", sev, 0.80, LIKELY, ev, claims, gated=True).unionByName(cold)


@rule("FL030", "vcall_site")
def virtual_calls(sites: DataFrame, **_) -> DataFrame:
    loop = F.col("in_loop")
    ev = {"virtual_call": F.concat("class", F.lit("::"), "method"), "caller": F.col("fn"), "in_loop": yes(loop), "hot_path": "true"}
    claims = [S.claim("a call that cannot be inlined", "a virtual call on a hot path", True, HIGH),
        S.claim("the barrier is paid in each round", "a call in a loop", loop, CRITICAL),
        S.claim(f"{RECEIVER_EFFECT} beyond prediction", "many receivers seen at run time", False, F.when(loop, HIGH).otherwise(MEDIUM),
            gating=True)]
    return finding(hot(sites), "FL030", "Virtual Dispatch in Hot Path", F.when(loop, CRITICAL).otherwise(HIGH), 0.70, LIKELY, ev, claims,
        gated=True)


@rule("FL031", "stdfn_site")
def erased_calls(sites: DataFrame, **_) -> DataFrame:
    loop, param, made = F.col("in_loop"), F.col("kind") == "parameter", F.col("kind") == "construct"
    ev = {"std_function_kind": F.col("kind"), "caller": F.col("fn"), "in_loop": F.when(~param, yes(loop)), "hot_path": "true"}
    claims = [S.claim("an indirect call through erased storage", "such an object on a hot path", True, HIGH),
        S.claim("an allocation beyond the small buffer", "it is built here", made, HIGH),
        S.claim("call and allocation recur", "a use in a loop", loop, CRITICAL),
        S.claim("the stored target varies", "many targets seen at run time", made,
            F.when(made, CRITICAL).when(loop, HIGH).otherwise(MEDIUM), gating=True)]
    return finding(hot(sites), "FL031", "Type-Erased Call in Hot Path", F.when(loop & ~param, CRITICAL).otherwise(HIGH),
        F.when(param, 0.65).otherwise(0.70), LIKELY, ev, claims, gated=True)


@rule("FL040", "global")
def mutable_globals(globals_: DataFrame, **_) -> DataFrame:
    d = globals_.where("NOT const AND NOT tls")
    sev = F.when(F.col("atomic"), CRITICAL).when(~F.col("concurrent"), MEDIUM).otherwise(HIGH)
    ev = {"var": F.col("var"), "type": F.col("type"), "storage": "global", "const": "no", "thread_local": "no",
        "atomics": yes(F.col("atomic")), "has_init": yes(F.col("has_init")), "tu_write_count": F.col("writes"),
        "tu_loop_writes": F.col("loop_writes")}
    claims = [S.claim("state that any thread reaches", "a mutable global of all threads", True, MEDIUM),
        S.claim("the line moves between cores", "two writers, one on a spawned thread", F.col("concurrent"), CRITICAL)]
    return finding(d, "FL040", "Centralized Mutable Global State", sev, F.when(F.col("atomic"), 0.85).otherwise(0.60), LIKELY, ev, claims)


@rule("FL041", "record")
def contended_queues(records: DataFrame, **_) -> DataFrame:
    named = F.lower("type").rlike("|".join(QUEUES))
    atomic = (F.col("atomic_pairs") > 0) & (named | F.col("head_tail"))
    plain = ~atomic & F.col("escapes") & F.col("queue_pair")
    d = records.where(atomic | plain)
    conf = F.when(named & F.col("head_tail"), 0.82).otherwise(0.76) - F.when(atomic, 0.0).otherwise(0.14)
    ev = {"struct": F.substring_index("type", "::", -1)} | _sized() | {"lines": F.col("lines"), "atomic_fields": F.col("atomic_fields"),
        "atomic_pairs_same_line": F.col("atomic_pairs"), "queue_heuristic": yes(named), "head_tail_names": yes(F.col("head_tail"))}
    claims = [S.claim("both ends of the queue lie on one line", "names of a queue on one line", True, MEDIUM),
        S.claim("producer and consumer take the line from each other", "atomic ends, or a record that escapes", True, CRITICAL)]
    return finding(d, "FL041", "Contended Queue Pattern", CRITICAL, conf, F.when(atomic, PROVEN).otherwise(LIKELY), ev, claims)


@rule("FL050", "branch_site")
def deep_branches(sites: DataFrame, **_) -> DataFrame:
    from strideway.operators import ranking

    d = hot(sites)
    nests = ranking.survivors(d.where("kind = 'if' AND depth >= 4"), ["fn", "file"],
        [F.col("line"), F.col("col"), F.col("depth").desc(), F.col("hotness").desc()])
    switches = d.where("kind = 'switch' AND cases >= 8 AND NOT const_lookup")
    deepest = d.groupBy("fn", "file").agg(F.max("depth").alias("max_depth"))
    both = nests.unionByName(switches).join(deepest, ["fn", "file"])
    switch = F.col("kind") == "switch"
    sev = F.when(~switch & (F.col("depth") >= 6), HIGH).otherwise(MEDIUM)
    ev = {"function": F.col("fn"), "type": F.when(switch, "switch").otherwise("nested_if"), "depth": F.col("depth"),
        "max_depth": F.col("max_depth"), "cases": F.when(switch, F.col("cases"))}
    claims = [S.claim("branches to predict", "a deep nest or a wide switch in a hot function", True, MEDIUM),
        S.claim("an indirect jump to resolve", "arms that do work", switch, HIGH),
        S.claim("correlated mispredictions", "six levels or more", ~switch & (F.col("depth") >= 6), HIGH),
        S.claim("outcomes vary", "mispredictions seen at run time", False, MEDIUM, gating=True)]
    return finding(both, "FL050", "Deep Conditional Tree", sev, 0.50, SPECULATIVE, ev, claims, gated=True)


@rule("FL060", "record")
def remote_memory(records: DataFrame, sockets: int = 2, **_) -> DataFrame:
    d = records.where((F.col("size") >= 256) & F.col("escapes") & (F.col("mutable_fields") + F.col("atomic_fields") > 0)
        & F.lit(sockets != 1))
    sev = no_more_than(F.when(F.col("size") >= 4096, CRITICAL).otherwise(HIGH), F.col("placement").isin("explicit-bind", "local-init"),
        MEDIUM)
    factor = F.coalesce(F.try_element_at(F.create_map(*(x for k, v in PLACEMENT.items() for x in (F.lit(k), F.lit(v)))),
            F.col("placement")), F.lit(1.0))
    conf = F.when(F.col("atomic_fields") > 0, 0.55).otherwise(0.35) * (0.5 + 0.5 * F.col("contention")) * factor
    ev = {"struct": F.substring_index("type", "::", -1)} | _sized() | {"cache_lines": F.col("lines"),
        "mutable_fields": F.col("mutable_fields"), "atomics": yes(F.col("atomic_fields") > 0), "thread_escape": "yes",
        "numa_placement": F.col("placement")}
    claims = [S.claim("a large shared structure without placement", "its size, escape and mutable state", True, MEDIUM),
        S.claim("access to another node's memory", "several sockets", sockets >= 2, HIGH)]
    return finding(d, "FL060", "NUMA-Unfriendly Shared Structure", sev, conf, SPECULATIVE, ev, claims)


@rule("FL061", "dispatch")
def central_dispatch(facts: DataFrame, **_) -> DataFrame:
    d = hot(facts).where("callees >= 8 OR (switch_cases >= 6 AND callees >= 3) OR virtual_calls >= 3")
    sev = F.when(F.col("has_loop") | ((F.col("virtual_calls") >= 3) & (F.col("switch_cases") >= 4)), CRITICAL).otherwise(HIGH)
    ev = {"function": F.col("fn"), "callees": F.col("callees"), "virtual_calls": F.col("virtual_calls"),
        "switch_cases": F.col("switch_cases"), "has_loop": yes(F.col("has_loop"))}
    claims = [S.claim("a wide footprint of code and branch targets", "a hot function with many callees", True, MEDIUM),
        S.claim("indirect targets are mispredicted", "three virtual sites or more", F.col("virtual_calls") >= 3, HIGH),
        S.claim("the fan-out is walked in each round", "a dispatch in a loop", F.col("has_loop"), HIGH)]
    return finding(d, "FL061", "Centralized Dispatcher", sev, 0.55, LIKELY, ev, claims, gated=True)


@rule("FL070", "mapping")
def small_pages(maps: DataFrame, thp: bool = False, **_) -> DataFrame:
    """``maps``: kind (hot-global or the call), symbol, bytes, align, provable, huge (asked for), hotness."""
    d = maps.where((F.col("bytes") >= HUGE) & ~F.coalesce("huge", F.lit(False))
        & ((F.col("kind") != "hot-global") | (F.col("hotness") > S.COLD)))
    aligned, unproven = F.col("align") >= HUGE, ~F.col("provable")
    sev = F.when(aligned | unproven | F.lit(thp), INFO).otherwise(MEDIUM)
    conf = F.when(aligned, 0.35).when(unproven, 0.30).when(F.lit(thp), 0.40).otherwise(0.65)
    ev = {"bytes": F.col("bytes"), "base_pages": F.floor(F.col("bytes") / PAGE), "align": F.col("align"), "kind": F.col("kind"),
        "symbol": F.nullif("symbol", F.lit("")), "provable": yes(F.col("provable"))}
    claims = [S.claim("page walks beyond the TLB's reach", "a region of many base pages", True, F.when(aligned, INFO).otherwise(MEDIUM))]
    gate = F.col("kind") == "hot-global"
    return finding(d.where(gate), "FL070", "Large Region on Base Pages", sev, conf, LIKELY, ev, claims,
        gated=True).unionByName(finding(d.where(~gate), "FL070", "Large Region on Base Pages", sev, conf, LIKELY, ev, claims))


@rule("FL090", "record")
def amplified(records: DataFrame, **_) -> DataFrame:
    d = records.where((F.col("lines") >= 3) & (F.col("atomic_fields") >= 2) & (F.col("atomic_lines") >= 2) & F.col("escapes")
        & F.col("beyond_atomics"))
    ev = {"struct": F.substring_index("type", "::", -1)} | _sized() | {"cache_lines": F.col("lines"),
        "atomic_fields": F.col("atomic_fields"), "atomic_lines": F.col("atomic_lines"), "mutable_fields": F.col("mutable_fields"),
        "straddling": F.col("straddling"), "thread_escape": "yes"}
    claims = [S.claim("ownership moves for each line of the record", "atomics on two lines and a route of sharing besides", True,
            F.when(F.col("deliberate"), MEDIUM).otherwise(CRITICAL))]
    return finding(d, "FL090", "Hazard Amplification", F.when(F.col("deliberate"), MEDIUM).otherwise(CRITICAL),
        F.least(F.lit(1.0), 0.70 + 0.18 * F.col("contention")), LIKELY, ev, claims)


def findings(facts: dict[str, DataFrame], only: list[str] | None = None, disabled: list[str] = (), **options) -> DataFrame:
    """All findings of the rules whose fact tables are there; ``only`` and ``disabled`` choose rules."""
    out = None
    for ident, f in RULES.items():
        if NEEDS[ident] not in facts or (only and ident not in only) or ident in disabled:
            continue
        part = f(facts[NEEDS[ident]], **options)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no rule has its facts")
    return out
