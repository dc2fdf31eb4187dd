"""Facts of one program's functions from rows of sites: edges, entries, pools, taint, hotness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideway import schemas as S
from strideway import storage
from strideway.functions import text
from strideway.operators import graph, joins

#: Argument slots that a spawned function is passed in.
SPAWNERS = [("pthread_create", 2), ("thrd_create", 1), ("std::async", 0), ("std::async", 1), ("std::thread", 0), ("std::jthread", 0)]
#: What an index of a thread is called, in any case, and how such a name ends.
THREAD_NAMES = "tid thread_id thread_index thread_idx thread_num thd_id cur_tid running_tid core_id cpu_id shard_id gettid sched_getcpu omp_get_thread_num".split()
THREAD_SUFFIXES = ("_tid", "_thread_id", "_thread_index")
#: Calls whose memory comes from a pool; further ones are given.
POOLS = [f"{kind}_{verb}" for kind in ("arena", "slab", "pool") for verb in ("alloc", "allocate")] + [
    f"std::pmr::{x}" for x in ("polymorphic_allocator", "monotonic_buffer_resource", "unsynchronized_pool_resource",
        "synchronized_pool_resource")
] + [f"boost::{x}" for x in ("pool_allocator", "fast_pool_allocator", "object_pool", "singleton_pool")]
SYSTEM_CALLS = ("mmap", "mmap64", "munmap", "brk", "sbrk")
#: Calls that go to the linked allocator, and the containers whose names begin so.
STANDARD = "malloc calloc realloc free aligned_alloc posix_memalign".split() + ["operator new",
    "operator delete"] + [f"std::make_{x}{y}" for x in ("shared", "unique") for y in ("", "_for_overwrite")]
CONTAINERS = [f"std::{x}" for x in ("vector", "map", "unordered_map", "list", "deque", "set", "unordered_set", "basic_string",
        "__cxx11::basic_string", "shared_ptr", "function")]
#: Linked allocators that serve small requests from a cache of the thread.
CACHING = ("tcmalloc", "jemalloc", "mimalloc")


def call_edges(sites: DataFrame) -> DataFrame:
    """(src, dst, loop_depth) with the deepest loop of a pair's call sites."""
    return sites.groupBy("src", "dst").agg(F.max("loop_depth").alias("loop_depth"))


def node_name(qualified: Column, enclosing: Column, line: Column, col: Column) -> Column:
    """A function's qualified name; a lambda is named by where it stands."""
    return F.when(F.coalesce(qualified, F.lit("")) != "",
        qualified).otherwise(F.concat_ws(":", F.concat(enclosing, F.lit("::lambda")), line, col))


def thread_entries(arguments: DataFrame) -> DataFrame:
    """(fn, pool) of functions (callee, slot, fn, in_loop) passed to a spawner; spawned in a loop or twice makes a pool."""
    slots = F.broadcast(arguments.sparkSession.createDataFrame(SPAWNERS, "callee string, slot int"))
    found = arguments.join(slots, ["callee", "slot"])
    return found.groupBy("fn").agg((F.bool_or("in_loop") | (F.count("*") > 1)).alias("pool"))


def resolved_spawners(forwards: DataFrame, arguments: DataFrame) -> DataFrame:
    """T5: (fn, pool) of literals that reach a spawner through a function (spawner, slot) forwarding its parameter."""
    found = arguments.join(forwards.select(F.col("spawner").alias("callee"), "slot").distinct(), ["callee", "slot"])
    return found.groupBy("fn").agg((F.bool_or("in_loop") | (F.count_distinct("caller") > 1)).alias("pool"))


def pool_closure(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(fn) of everything that pool entries reach."""
    roots = entries.where("pool").select(F.col("fn").alias("node"), F.lit(1).alias("mask"))
    return graph.reachable(edges, roots).select(F.col("node").alias("fn"))


def strongest(*sources: DataFrame) -> DataFrame:
    """(fn, hotness) with the strongest source of each function."""
    out = sources[0].select("fn", "hotness")
    for s in sources[1:]:
        out = out.unionByName(s.select("fn", "hotness"))
    return out.groupBy("fn").agg(F.max("hotness").alias("hotness"))


def declared_hot(functions: DataFrame, profile: DataFrame | None = None, names: Sequence[str] = (), files: Sequence[str] = ()) -> DataFrame:
    """(fn, hotness) by profile (qualified or bare name), attribute, or globs of the qualified name or the file."""
    out = functions.select("fn", F.when(F.coalesce("hot_attr", F.lit(False)) | text.matches_glob(F.col("fn"), list(names))
            | text.matches_glob(F.col("file"), list(files)), S.DECLARED).otherwise(S.COLD).alias("hotness"))
    if profile is not None:
        seen = profile.select(F.col("name").alias("p")).distinct()
        whole = functions.join(seen, F.col("fn") == F.col("p"), "left_semi").select("fn")
        bare = functions.join(seen, F.substring_index("fn", "::", -1) == F.col("p"), "left_semi").select("fn")
        out = strongest(out, whole.union(bare).distinct().withColumn("hotness", F.lit(S.PROFILED)))
    return out


def candidates(functions: DataFrame, hot: DataFrame) -> DataFrame:
    """(fn, hotness) of what is visible outside and not hot yet: only the whole program can tell."""
    return functions.where("externally_visible").select("fn").join(hot.where(F.col("hotness") > S.COLD), "fn",
        "left_anti").withColumn("hotness", F.lit(S.CANDIDATE))


def hotness(edges: DataFrame, seeds: DataFrame, own_depth: DataFrame | None = None) -> DataFrame:
    """(fn, hotness) from loop depths summed along calls (src, dst, loop_depth) from seeds (fn), at most 4; what is in no loop is not hot, and beyond 8 calls heat is shallow."""
    held = storage.saved(seeds.select(F.col("fn").alias("node")).distinct().withColumn("depth", F.lit(0)), "seeds")
    depth = graph.max_relax(edges.select("src", "dst", F.coalesce("loop_depth", F.lit(0)).alias("weight")), held, 4)
    out = depth.where("depth > 0").join(graph.within(edges, held, 8).hint("merge"), "node", "left")
    if own_depth is not None:
        own = storage.saved(own_depth.groupBy(F.col("fn").alias("node")).agg(F.max("depth").alias("own")), "own")
        out = out.join(storage.small(own), "node", "left")
    else:
        out = out.withColumn("own", F.lit(0))
    graded = F.col("depth") + F.when(F.col("own") >= 2, 1).otherwise(0)
    return out.select(F.col("node").alias("fn"),
        F.when((graded >= 2) & F.col("hops").isNotNull(), S.DEEP).otherwise(S.SHALLOW).alias("hotness"))


def unit_hotness(edges: DataFrame, entries: DataFrame, own_depth: DataFrame | None = None) -> DataFrame:
    """(unit, fn, hotness) in each unit by itself, from its ``main`` and its thread entries; all tables carry ``unit``."""
    name = lambda c: F.concat("unit", F.lit("\x1f"), c)
    own = edges.select(name("src").alias("src"), name("dst").alias("dst"), "loop_depth")
    seeds = entries.select(name("fn").alias("fn")).union(edges.where("src = 'main'").select(name("src")))
    depth = None if own_depth is None else own_depth.select(name("fn").alias("fn"), "depth")
    cut = F.instr("fn", "\x1f")
    return hotness(own, seeds, depth).select(F.substring("fn", F.lit(1), cut - 1).alias("unit"),
        F.expr("substring(fn, instr(fn, '\x1f') + 1)").alias("fn"), "hotness")


def taint(bindings: DataFrame, uses: DataFrame) -> DataFrame:
    """(fn, kind, var, loop_lines, branches, passed, stored, returned) of names bound to allocations or atomic reads, by name and regardless of flow."""
    j = bindings.select("fn", "var", "kind").distinct().join(uses, ["fn", "var"])
    is_ = lambda c: F.bool_or(F.col("context") == c)
    return j.groupBy("fn", "kind", "var").agg(F.max("depth").alias("depth"),
        F.count_distinct(F.when(F.col("depth") > 0, F.col("line"))).alias("loop_lines"), is_("condition").alias("branches"),
        is_("argument").alias("passed"), is_("member").alias("stored"), is_("return").alias("returned"))


def write_facts(sites: DataFrame, key: list[str]) -> DataFrame:
    """(key, sites, loop_sites, standing, handed, writers) of write sites."""
    return sites.groupBy(*key).agg(F.count("*").alias("sites"), F.count(F.when(F.col("in_loop"), 1)).alias("loop_sites"),
        F.count(F.when(F.col("standing"), 1)).alias("standing"), F.count(F.when(~F.col("standing"), 1)).alias("handed"),
        F.array_sort(F.collect_set("fn")).alias("writers"))


def opaque_callers(sites: DataFrame, functions: DataFrame) -> DataFrame:
    """(fn) of the functions that call something without a known body."""
    return sites.join(functions.select(F.col("fn").alias("dst")), "dst", "left_anti").select(F.col("src").alias("fn")).distinct()


def effective_align(record_align: Column, offset: Column, type_align: Column, line: int = 64) -> Column:
    """The alignment of an array inside a record: the line's if record and place in it are so aligned, else that of its type."""
    return F.when((record_align >= line) & (offset % line == 0), F.lit(line).cast("bigint")).otherwise(type_align.cast("bigint"))


def striped_catalogue(arrays: DataFrame, line: int = 64) -> DataFrame:
    """Arrays of at least two elements smaller than a line that are not constant.

    With columns ``record_align``, ``offset`` and ``type_align``, of which the first is null outside records, ``decl_align`` is worked out.
    """
    out = arrays.where((F.col("elem_count") >= 2) & (F.col("elem_size") > 0) & (F.col("elem_size") < line))
    out = out.where(~F.coalesce("const", F.lit(False))).drop("const") if "const" in arrays.columns else out
    if "record_align" in arrays.columns:
        inside = effective_align(F.col("record_align"), F.col("offset"), F.col("type_align"), line)
        out = out.withColumn("decl_align",
            F.when(F.col("record_align").isNull(), F.col("type_align").cast("bigint")).otherwise(inside)).drop("record_align", "offset",
            "type_align")
    return out


def index_provenance(constant: Column, induction: Column, tls: Column, name: Column) -> Column:
    """What an array is indexed by: a constant, else the variable of a loop, else a thread's variable or what is named like a thread's index."""
    ident = F.lower(name).isin(*THREAD_NAMES)
    for s in THREAD_SUFFIXES:
        ident = ident | name.endswith(s)
    return F.when(constant, "constant").when(induction, "loop").when(tls | F.coalesce(ident, F.lit(False)), "thread").otherwise("unknown")


def write_tier(fn: Column, hot: Column, dispatch: Sequence[str], tick: Sequence[str]) -> Column:
    """How often a function writes: by globs of its qualified or bare name, which say more than heat, else by heat."""
    bare = F.substring_index(fn, "::", -1)
    named = lambda globs: text.matches_glob(bare, list(globs)) | text.matches_glob(fn, list(globs))
    return F.when(named(dispatch), S.DISPATCH_RATE).when(named(tick), S.TICK_RATE).when(hot, S.HOT_RATE).otherwise(S.UNKNOWN_RATE)


def through_aliases(writes: DataFrame, aliases: DataFrame) -> DataFrame:
    """Writes (target, ...) moved to the array that a pointer (alias, target, origin) stands for, one hop; with a non-zero origin marked."""
    a = aliases.select(F.col("alias").alias("__a"), F.col("target").alias("__t"), "origin")
    out = writes.join(a, F.col("target") == F.col("__a"), "left")
    return out.withColumn("target", F.coalesce("__t", "target")).withColumn("shifted",
        F.coalesce(F.col("origin") != 0, F.lit(False))).drop("__a", "__t", "origin")


def head_padded(arrays: DataFrame, aliases: DataFrame, line: int = 64) -> DataFrame:
    """``arrays`` (key, decl_align ...) with ``head_pad``: a pointer to an element beyond the first of an array that begins on a line."""
    shifted = aliases.where("origin > 0").select(F.col("target").alias("key"), F.lit(True).alias("__h")).distinct()
    return arrays.join(shifted, "key", "left").withColumn("head_pad",
        F.coalesce("__h", F.lit(False)) & (F.col("decl_align") >= line)).drop("__h")


def placements(instances: DataFrame) -> DataFrame:
    """(type, placement) from instances (type, tls, is_global)."""
    out = instances.groupBy("type").agg(F.bool_or("tls").alias("t"), F.bool_or("is_global").alias("g"))
    return out.select("type", F.when(F.col("t"), "local-init").when(F.col("g"), "main-thread").otherwise("any-thread").alias("placement"))


def allocator_class(callee: Column, bytes_: Column, linked: str = "", pools: Sequence[str] = ()) -> Column:
    """The kind of allocator behind a call; ``linked`` names the program's allocator, ``pools`` further calls to pools."""
    pool = callee.isin(*POOLS, *pools) | callee.startswith("std::pmr::") | F.contains(callee, F.lit("boost::pool")) | F.contains(callee,
        F.lit("boost::object_pool"))
    system = (F.coalesce(bytes_, F.lit(0)) >= 128 * 1024) | callee.isin(*SYSTEM_CALLS)
    std = callee.isin(*STANDARD)
    for c in CONTAINERS:
        std = std | callee.startswith(c)
    return F.when(pool, "pool-slab").when(system, "syscall-mmap").when(std,
        "thread-local-cache" if linked in CACHING else "arena-lock").otherwise("unknown")


def configured_atomics(spellings: Column, names: Sequence[str]) -> Column:
    """Whether any spelling of a type is configured as atomic."""
    return F.arrays_overlap(spellings, F.array(*map(F.lit, names))) if names else F.lit(False)


LOCK_CALLS = ("pthread_mutex_lock", "pthread_mutex_trylock", "pthread_spin_lock", "pthread_rwlock_rdlock", "pthread_rwlock_wrlock")


def ir_profiles(instructions: DataFrame) -> DataFrame:
    """One row a function of lowered code: blocks, frame, heap, direct and indirect calls, atomics by kind and order, fences, locks.

    ``instructions``: fn, block, kind, bytes, ordering, and callee, line where known. A compare-exchange and a call to a lock are locks.
    """
    d = instructions
    for c, kind in (("callee", "string"), ("line", "int")):
        d = d if c in d.columns else d.withColumn(c, F.lit(None).cast(kind))
    count = lambda cond: F.count(F.when(cond, 1))
    k = lambda c: count(F.col("kind") == c).alias(f"{c}s")
    atomic = F.col("kind").isin("atomic", "atomic_load", "atomic_store", "rmw", "cmpxchg")
    write = F.col("kind").isin("atomic_store", "rmw", "cmpxchg")
    strong = atomic & F.coalesce(F.col("ordering") == "seq_cst", F.lit(False))
    lock = (F.col("kind") == "cmpxchg") | F.coalesce((F.col("kind") == "call") & F.col("callee").isin(*LOCK_CALLS), F.lit(False))
    lines = lambda cond: F.array_sort(F.collect_set(F.when(cond & (F.col("line") > 0), F.col("line"))))
    return d.groupBy("fn").agg(
        F.max("block").alias("blocks"), F.sum(F.when(F.col("kind") == "alloca", F.col("bytes")).otherwise(0)).alias("frame"),
            k("heap_call"), k("call"), k("indirect_call"), count(atomic).alias("atomics"), F.bool_or(strong).alias("seq_cst"),
        count(strong).alias("seq_csts"), count(write).alias("atomic_writes"), count(write & (F.col("line") > 0)).alias("located_writes"),
            k("fence"), count(lock).alias("locks"), lines(strong).alias("site_lines"),
            lines(F.col("kind") == "cmpxchg").alias("lock_lines"),
    )


#: Rules whose findings lowered code speaks for or against.
REFINED = ("FL010", "FL011", "FL012", "FL020", "FL021", "FL030", "FL031")
ANONYMOUS = "(anonymous namespace)::"


def _pieces(demangled: Column) -> Column:
    """What the last component of a name that matches ``demangled`` can be: its components up to each ``(`` or ``<``, and the last as a whole."""
    parts = F.filter(F.split(demangled, "::"), lambda c: c != "")
    cut = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)),
        lambda i: F.when(c.substr(i, F.lit(1)).isin("(", "<"), c.substr(F.lit(1), i - 1)))
    return F.array_distinct(F.filter(F.concat(F.flatten(F.transform(parts, cut)), F.array(F.substring_index(demangled, "::", -1))),
            lambda c: c.isNotNull() & (c != "")))


def _within(demangled: Column, name: Column) -> Column:
    """Whether the name stands in a demangled one from its start or a ``::`` up to its end, a ``(`` or a ``<``."""
    return F.rlike(demangled, F.concat(F.lit(r"(?:\A|(?<=::))\Q"), name, F.lit(r"\E(?:\z|(?=[(<]))")))


def resolved_profiles(wanted: DataFrame, profiles: DataFrame) -> DataFrame:
    """Each distinct (name, file, line) with the measures of its profile, nulls without one.

    By mangled name, else exact demangled name, else component match, else that of the name without anonymous namespaces, else a line in
    a file of which one path ends with the other; of equals the lowest mangled name. Only the last component of names is joined on.
    """
    last = lambda c: F.substring_index(c, "::", -1)
    measures = [c for c in profiles.columns if c not in ("demangled", "file", "line")]
    own = storage.saved(wanted, "wanted")
    p = storage.saved(profiles.withColumn("base", text.base_name(F.col("file"))), "profiles")
    best = lambda df, of, rank: df.groupBy(*of).agg(F.min_by(F.struct(*measures), F.struct(F.col(rank), F.col("mangled"))).alias("__found"))
    # a name alone decides all ranks but the last, a file and line alone the last: neither is repeated for each wanted row
    names = own.where("name <> ''").select("name").distinct().withColumn("bare", F.replace("name", F.lit(ANONYMOUS), F.lit("")))
    names = storage.saved(names.withColumns({"piece": last("name"), "bare_piece": last("bare")}), "names")
    pieces = storage.saved(p.withColumn("piece", F.explode(_pieces(F.col("demangled")))), "pieces")
    left, right = (lambda c, side=side: F.col(f"{side}.{c}") for side in "lr")
    candidates = [
        (0, p, left("name") == right("mangled")),
        (1, p, left("name") == right("demangled")),
        (2, pieces, (left("piece") == right("piece")) & _within(right("demangled"), left("name"))),
        (3, pieces, (left("bare") != left("name")) & (left("bare_piece") == right("piece")) & _within(right("demangled"), left("bare"))),
    ]
    found = None
    for rank, table, cond in candidates:
        part = names.alias("l").join(table.alias("r").hint("merge"), cond).select(left("name"), F.lit(rank).alias("rank"),
            *(right(c) for c in measures))
        found = part if found is None else found.unionByName(part)
    by_name = storage.saved(best(found, ["name"], "rank"), "by_name")
    # of the profiles of one place the lowest name stands for all
    spots = storage.saved(best(p.where("line > 0 AND file <> ''").withColumn("rank", F.lit(4)), ["base", "file", "line"], "rank"), "spots")
    places = own.where("line > 0 AND file <> ''").select("file", "line").distinct().withColumn("base", text.base_name(F.col("file")))
    ends = lambda a, b: F.endswith(a, F.concat(F.lit("/"), b))
    same_file = (left("file") == right("file")) | ends(left("file"), right("file")) | ends(right("file"), left("file"))
    met = places.alias("l").join(spots.alias("r"), (left("base") == right("base")) & (left("line") == right("line")) & same_file)
    by_place = met.groupBy(left("file"), left("line")).agg(F.min_by("__found", "__found.mangled").alias("__at"))
    out = own.join(storage.small(by_name), "name", "left").join(storage.small(storage.saved(by_place, "by_place")), ["file", "line"], "left")
    one = F.coalesce("__found", "__at")
    return out.select("name", "file", "line", *(one[c].alias(c) for c in measures))


def refined(findings: DataFrame, profiles: DataFrame) -> DataFrame:
    """Confidences, tiers and notes by what lowered code keeps of a finding, clamped; frames below the threshold are suppressed.

    ``profiles`` is S.PROFILE, a row a lowered function: its names, where it is declared, the lines of its sequentially consistent atomics
    and of its compare-exchanges, and counts. Columns that are missing are taken as unknown; ``fn`` may stand for ``mangled``.
    """
    from strideway.plans import reduce as R

    known = {"mangled": F.col("fn") if "fn" in profiles.columns else None, "atomic_writes": F.col("atomics"),
        "located_writes": F.size("site_lines").cast("bigint")}
    fill = {f.name: known.get(f.name, F.lit(None).cast(f.dataType)) for f in T._parse_datatype_string(S.PROFILE)
        if f.name not in profiles.columns}
    p = profiles.withColumns(fill).select(*(f.name for f in T._parse_datatype_string(S.PROFILE)))
    name = F.coalesce(F.nullif("fn", F.lit("")), F.nullif(R.ev("function"), F.lit("")), F.nullif(R.ev("caller"), F.lit("")), F.lit(""))
    mine = findings.where(F.col("rule").isin(*REFINED)).withColumns({"__name": name, "__file": F.coalesce("file", F.lit("")),
            "__line": F.coalesce("line", F.lit(0))})
    found = resolved_profiles(mine.select(F.col("__name").alias("name"), F.col("__file").alias("file"), F.col("__line").alias("line"))
        .distinct(), p)
    found = found.select(*(F.col(c).alias(f"__{c}") for c in found.columns))
    m = lambda k: F.coalesce(f"__{k}", F.lit(0))
    out = mine.join(storage.small(storage.saved(found, "refining")), ["__name", "__file", "__line"], "left")
    there = F.col("__mangled").isNotNull() & ~F.col("suppressed")
    at = lambda k: F.coalesce(F.array_contains(f"__{k}", F.col("line")) & (F.col("line") > 0), F.lit(False))
    r, c, frame = F.col("rule"), F.col("confidence"), m("frame")
    moved = lambda d, least, most: F.greatest(F.lit(least), F.least(F.lit(most), c + d))
    say = lambda n, what: F.concat(F.lit("lowered code: "), n.cast("string"), F.lit(f" {what}"))
    small = (frame > 0) & (frame < text.leading_number(R.ev("threshold")))
    # rule, condition, confidence, note, proven; the first that holds counts
    steps = [
        ("FL010", at("site_lines"), moved(0.10, 0.10, 0.98), F.lit("lowered code: sequentially consistent at this line"), F.lit(True)),
        ("FL010", m("seq_csts") > 0, moved(0.05, 0.10, 0.92), say(m("seq_csts"), "sequentially consistent, none at this line"),
            F.lit(False)),
        ("FL010", m("atomics") > 0, moved(-0.20, 0.30, 0.98), F.lit("lowered code: nothing sequentially consistent is left"), F.lit(False)),
        ("FL011", m("atomic_writes") > 0, moved(0.10, 0.10, 0.95), say(m("atomic_writes"), "atomic writes"), m("located_writes") > 0),
        ("FL012", m("locks") > 0, moved(0.05, 0.10, 0.95), say(m("locks"), "locks"), at("lock_lines")),
        ("FL020", m("heap_calls") > 0, moved(0.05, 0.10, 0.98), say(m("heap_calls"), "heap calls"), F.lit(False)),
        ("FL020", F.lit(True), moved(-0.15, 0.40, 0.98), F.lit("lowered code: no heap calls are left"), F.lit(False)),
        ("FL021", small, c, say(frame, "bytes of frame, below the threshold"), F.lit(False)),
        ("FL021", frame > 0, moved(0.10, 0.10, 0.95), say(frame, "bytes of frame"), F.lit(True)),
        ("FL021", F.lit(True), c, say(frame, "bytes of frame"), F.lit(False)),
        ("FL030", m("indirect_calls") > 0, moved(0.10, 0.10, 0.95), say(m("indirect_calls"), "indirect calls"), F.lit(False)),
        ("FL030", m("calls") > 0, moved(-0.25, 0.30, 0.98), F.lit("lowered code: all calls are direct"), F.lit(False)),
        ("FL031", m("indirect_calls") > 0, moved(0.10, 0.10, 0.95), say(m("indirect_calls"), "indirect calls"), F.lit(False)),
        ("FL031", F.lit(True), moved(-0.20, 0.35, 0.98), F.lit("lowered code: no indirect calls are left"), F.lit(False)),
    ]
    did = F.lit(None).cast("struct<confidence:double,note:string,proven:boolean>")
    for rule, cond, new, note, proven in reversed(steps):
        did = F.when(there & (r == rule) & cond,
            F.struct(new.alias("confidence"), note.alias("note"), proven.alias("proven"))).otherwise(did)
    out = out.withColumn("__did", did)
    hit, framed = F.col("__did").isNotNull(), (r == "FL021") & (frame > 0)
    out = out.withColumns(
        {
            "confidence": F.coalesce("__did.confidence", "confidence"),
            "tier": F.when(F.coalesce("__did.proven", F.lit(False)), S.PROVEN).otherwise(F.col("tier")),
            "escalations": R.noted(hit, F.col("__did.note")),
            "suppressed": F.col("suppressed") | (hit & (r == "FL021") & small),
            "evidence": F.when(hit & framed & ~small, R.put(F.col("evidence"), ir_frame=F.concat(frame.cast("string"), F.lit("B"))))
                .otherwise(F.col("evidence")),
        }
    ).select(findings.columns)
    # compound findings of records only note what the whole program keeps
    whole = p.agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(f"__{k}") for k in ("atomic_writes", "fences", "indirect_calls")))
    rest = findings.where(~F.col("rule").isin(*REFINED)).crossJoin(F.broadcast(whole))  # one row
    told = ~F.col("suppressed") & F.col("rule").isin("FL090", "FL091") & ((F.col("__atomic_writes") > 0) | (F.col("__fences") > 0))
    note = F.concat(F.lit("lowered code: "), "__atomic_writes", F.lit(" atomic writes, "), "__fences", F.lit(" fences, "),
        "__indirect_calls", F.lit(" indirect calls in all"))
    return out.unionByName(rest.withColumn("escalations", R.noted(told, note)).select(findings.columns))


#: What an experiment on a class measures.
EXPERIMENTS = {
    "CacheGeometry": ("L1D misses", False, True, False), "FalseSharing": ("HITM loads", True, True, False),
        "StripedArray": ("HITM loads", True, False, False), "AtomicOrdering": ("locked loads", False, False, False),
    "AtomicContention": ("HITM loads", True, True, False), "LockContention": ("locked loads", True, False, False),
        "HeapAllocation": ("DTLB walks", False, False, False), "StackPressure": ("DTLB walks", False, False, False),
    "VirtualDispatch": ("mispredicted calls", False, False, True), "StdFunction": ("mispredicted calls", False, False, True),
        "DeepConditional": ("mispredicted branches", False, False, True), "NUMALocality": ("remote loads", False, True, False),
    "GlobalState": ("HITM loads", True, True, False), "ContendedQueue": ("HITM loads", True, False, False),
        "CentralizedDispatch": ("front-end misses", False, False, True), "HazardAmplification": ("HITM loads", True, True, False),
}


def hypotheses(findings: DataFrame, rule: str | None = None, least: float = 0.0, alpha: float = 0.01, power: float = 0.90,
    effect: float = 0.05) -> DataFrame:
    """What to measure for findings of a class with an experiment; those without have a null metric."""
    from strideway.plans import reduce as R

    dim = F.broadcast(findings.sparkSession
        .createDataFrame([(k, *v) for k, v in EXPERIMENTS.items()],
            "cls string, metric string, needs_c2c boolean, needs_numa boolean, needs_lbr boolean"))
    d = findings.where(F.col("confidence") >= least)
    d = d if rule is None else d.where(F.col("rule") == rule)
    d = d.withColumn("cls", R.hazard_class()).withColumn("features", R.features()).join(dim, "cls", "left")
    ident = F.concat(F.lit("H-"), "rule", F.lit("-"), F.hex(F.xxhash64("rule", "file", "line", "fn")))
    return d.select(ident.alias("id"), F.concat("file", F.lit(":"), "line").alias("site"), "cls", "metric", "needs_c2c", "needs_numa",
        "needs_lbr", "confidence", "features", F.lit(alpha).alias("alpha"), F.lit(power).alias("power"), F.lit(effect).alias("effect"))


def hypothesis_pairs(h: DataFrame) -> DataFrame:
    """(template, a, b) of hypotheses of one file whose classes amplify each other."""
    from strideway.operators import joins

    scoped = h.withColumn("scope", F.regexp_extract("site", r"^(.*):[^:]*$", 1)).where("cls IS NOT NULL")
    known = F.broadcast(h.sparkSession.createDataFrame([(i, *sorted(c)) for i, c in S.INTERACTIONS if len(c) == 2],
            "template string, a_cls string, b_cls string"))
    a, b = (scoped.select("scope", F.col("id").alias(n), F.col("cls").alias(f"{n}_cls")) for n in ("a", "b"))
    return a.join(b, "scope").where("a_cls < b_cls").join(known, ["a_cls", "b_cls"]).select("template", "a", "b").distinct()


def granule_writes(writes: DataFrame, address: Column, thread: Column) -> DataFrame:
    """(granule, mask, writes) by 8 bytes, with a bit for each of 64 threads."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (thread % 64).cast("int"))
    return writes.groupBy(F.floor(address / 8).alias("granule")).agg(F.bit_or(bit).alias("mask"), F.count("*").alias("writes"))
