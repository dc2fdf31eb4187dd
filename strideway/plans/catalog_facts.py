"""Facts for the registered queries: small literal ones on which every rule fires, and findings made of table rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideway import schemas as S
from strideway import storage
from strideway.plans import reduce, rules
from strideway.plans.registry import table


def fact_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """One positive row a rule at least, with clean rows beside them."""
    site = "fn string, file string, line int, col int, hotness int, in_loop boolean"
    records = spark.createDataFrame(
        [("SharedRegistry", "reg.h", 10, 8320, 64), ("AmplifiedCounters", "amp.h", 20, 192, 8), ("PoolCounters", "pool.h", 30, 16, 8),
            ("OrderQueue", "queue.h", 40, 16, 8), ("CompactOrder", "order.h", 50, 64, 64), ("Stats", "stats.h", 60, 16, 8)],
        "type string, file string, line int, size int, align int",
    )
    f = lambda t, n, o, off, size, atomic=False, mutable=True, many=1: (t, n, o, off, size, min(size, 8), atomic, mutable, many,
        False)
    fields = spark.createDataFrame(
        [
            f("SharedRegistry", "epoch", 0, 0, 8, True), f("SharedRegistry", "state", 1, 4096, 8, True),
                f("SharedRegistry", "slots", 2, 4160, 4096, many=512),
            f("AmplifiedCounters", "a", 0, 0, 8, True), f("AmplifiedCounters", "b", 1, 64, 8, True),
                f("AmplifiedCounters", "c", 2, 128, 8, True),
            f("PoolCounters", "in", 0, 0, 8), f("PoolCounters", "out", 1, 8, 8), f("OrderQueue", "head", 0, 0, 8, True),
                f("OrderQueue", "tail", 1, 8, 8, True),
            f("CompactOrder", "px", 0, 0, 8, mutable=False), f("Stats", "mainOps", 0, 0, 8, True), f("Stats", "workerOps", 1, 8, 8, True),
        ],
        "type string, field string, ord int, offset int, size int, granule int, atomic boolean, mutable boolean, n_elements int, char_array boolean",
    )
    escapes = spark.createDataFrame(
        [("SharedRegistry", True, 0.6, True, False, 4, True, "main-thread"),
            ("AmplifiedCounters", True, 0.8, True, False, 3, True, "any-thread"),
            ("PoolCounters", True, 0.4, True, False, 2, True, "any-thread"),
            ("OrderQueue", True, 0.8, False, False, 2, False, "any-thread"), ("Stats", True, 0.5, True, False, 2, True, "any-thread")],
        "type string, escapes boolean, contention double, multi_writer boolean, sync boolean, writes int, beyond_atomics boolean, placement string",
    )
    at = lambda fn, line, loop=False, hot=S.DECLARED: (fn, "core.cpp", line, 1, hot, loop)
    return {
        "record": storage.saved(rules.record_summary(records, fields, escapes), "records"),
        "atomic_site": spark.createDataFrame([(*at("publish", 1, True), "store", "store", "seq_cst", "seq", "Stats"),
                (*at("publish", 2), "fetch_add", "rmw", "relaxed", "n", "Stats"),
                (*at("cold", 3, hot=S.COLD), "store", "store", "seq_cst", "s", "")],
            f"{site}, op string, op_class string, ordering string, var string, owner_type string"),
        "lock_site": spark.createDataFrame([(*at("route", 5, True), "mutex", True), (*at("route", 6), "mutex", False)],
            f"{site}, kind string, nested boolean"),
        "spin_site": spark.createDataFrame([(*at("spin", 7, True), "flag", "tas", 1, False, ""),
                (*at("paused", 8, True), "flag", "load", 1, False, "_mm_pause")],
            f"{site}, polled string, form string, body_stmts int, relaxed boolean, calls string"),
        "alloc_site": spark.createDataFrame([(*at("route", 9, True), "new", "arena-lock", True, False),
                (*at("route", 10), "pool_get", "pool-slab", False, False)],
            f"{site}, kind string, allocator string, escapes boolean, flows_to_loop boolean"),
        "local_var": spark.createDataFrame([("decode", "core.cpp", 11, S.DECLARED, "buf", 8192),
                ("decode", "core.cpp", 11, S.DECLARED, "tmp", 64), ("small", "core.cpp", 12, S.COLD, "x", 16)],
            "fn string, file string, fn_line int, hotness int, var string, size bigint"),
        "vcall_site": spark.createDataFrame([(*at("dispatch", 13, True), "Strategy", "onTick"), (*at("dispatch", 14), "Venue", "send")],
            f"{site}, class string, method string"),
        "stdfn_site": spark.createDataFrame([(*at("dispatch", 15), "invoke"), (*at("dispatch", 16, True), "construct"),
                (*at("dispatch", 17), "parameter")], f"{site}, kind string"),
        "global": spark.createDataFrame([("g_state", "MarketState", "state.cpp", 18, False, False, True, False, True, 5, 1),
                ("g_conf", "Conf", "state.cpp", 19, True, False, False, True, False, 0, 0)],
            "var string, type string, file string, line int, const boolean, tls boolean, atomic boolean, has_init boolean, concurrent boolean, writes int, loop_writes int"),
        "branch_site": spark.createDataFrame([(*at("match", 20), "if", 6, 0, False), (*at("match", 21), "if", 4, 0, False),
                (*at("match", 22), "switch", 1, 9, False), (*at("match", 23), "switch", 1, 9, True)],
            f"{site}, kind string, depth int, cases int, const_lookup boolean"),
        "dispatch": spark.createDataFrame([("dispatch", "core.cpp", 24, S.DECLARED, 9, 0, 9, False),
                ("leaf", "core.cpp", 25, S.DECLARED, 2, 0, 0, False)],
            "fn string, file string, line int, hotness int, callees int, virtual_calls int, switch_cases int, has_loop boolean"),
        "mapping": spark.createDataFrame([("init", "mem.cpp", 26, S.COLD, "mmap", "", 4 << 20, 4096, True, False),
                ("scan", "mem.cpp", 27, S.DECLARED, "hot-global", "arena", 4 << 20, 64, True, False)],
            "fn string, file string, line int, hotness int, kind string, symbol string, bytes bigint, align bigint, provable boolean, huge boolean"),
    }


def canary(spark: SparkSession) -> tuple[DataFrame, reduce.Facts]:
    """Findings of all rules over the literal facts, and the merged facts of two units."""
    flags = lambda *on: tuple(x in on for x in S.SIGNAL_FLAGS)
    shared = ("atomics", "published", "thread_writers", "standing")
    signals = spark.createDataFrame([(t, *flags(*shared), 2)
            for t in ("AmplifiedCounters", "PoolCounters", "OrderQueue", "Stats", "SharedRegistry")]
        + [("CompactOrder", *flags("layout"), 1)], S.SIGNAL)
    fn = lambda *names: spark.createDataFrame([(n,) for n in names], "fn string")
    lowered = [
        ("_Z7publishv", "publish()", "core.cpp", 1, [1], 1, 2, 2, 2, 0, 0, 1, 0, 0, [], 0),
            ("_Z6decodePKc", "decode(char const*)", "core.cpp", 11, [], 0, 0, 0, 0, 0, 0, 1, 0, 0, [], 8256),
        ("_Z8dispatchRK5Order", "dispatch(Order const&)", "core.cpp", 12, [], 0, 0, 0, 0, 0, 0, 1, 3, 0, [], 0),
            ("_Z5routev", "route()", "core.cpp", 4, [], 0, 0, 0, 0, 0, 1, 4, 0, 2, [], 0),
    ]
    facts = reduce.Facts(
        profiles=spark.createDataFrame(lowered, S.PROFILE),
        signals=signals,
        edges=spark.createDataFrame([("main", "mainSide", 0), ("workerEntry", "dispatch", 1), ("dispatch", "match", 1)],
            "src string, dst string, loop_depth int"),
        own_depth=spark.createDataFrame([("match", 2)], "fn string, depth int"),
        entries=fn("workerEntry"),
        writers=spark.createDataFrame([("Stats::mainOps", "mainSide"), ("Stats::workerOps", "workerEntry")], "field string, writer string"),
        overridden=fn("Strategy::onTick"),
        striped=spark.createDataFrame([("bytes", "g_thread_bytes", "", "bytes.cpp", 53, 8, 64, 64, False, False, True, True, False,
                    S.HOT_RATE, ["workerEntry"], ["report"]),
                ("padded", "p", "", "bytes.cpp", 60, 64, 64, 64, False, False, True, True, False, S.HOT_RATE, ["workerEntry"], [])],
            S.STRIPED),
        failures=spark.createDataFrame([(f"{i}.cpp", "fatal error: 'gen.h' file not found") for i in range(3)],
            "file string, error string"),
    )
    return storage.saved(rules.findings(fact_tables(spark)), "raw"), facts


def text_of(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def tagged(tag: str, c: Column | str) -> Column:
    """A name: a tag and a number."""
    return F.concat(F.lit(tag), text_of(c))


def pick(names: tuple, n: Column) -> Column:
    """The name at a number from 0, modulo how many there are."""
    return F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))


def evidence(**values: Column) -> Column:
    """A map of what is not null."""
    return F.map_filter(F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v.cast("string")))), lambda k, v: v.isNotNull())


def finding_rows(df: DataFrame, ident: Column, **columns: Column) -> DataFrame:
    """Findings, a row each of ``df``, with ``ident`` as their place; columns not given are alike in all."""
    plain = {
        "rule": F.lit("FL001"), "title": F.lit("row"), "severity": F.lit(S.HIGH), "confidence": F.lit(0.5), "tier": F.lit(S.LIKELY),
            "suppressed": F.lit(False), "file": F.lit("a.cpp"), "line": F.lit(1), "col": F.lit(1), "fn": F.lit(""), "reasoning": F.lit(""),
        "evidence": F.create_map().cast("map<string,string>"), "mitigation": F.lit(""), "escalations": F.array().cast("array<string>"),
            "hotness": F.lit(S.COLD), "claims": F.array().cast(f"array<{S.CLAIM}>"),
    }
    kinds = {"severity": "int", "confidence": "double", "tier": "int", "line": "int", "col": "int", "hotness": "int"}
    own = plain | columns
    return df.select(*(own[c].cast(kinds[c]).alias(c) if c in kinds else own[c].alias(c) for c in plain), ident.cast("bigint").alias("ord"),
        F.lit(0).alias("stage"))


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than there are cores, dealt to all of them; others as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def lineitem_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings made of the rows of ``lineitem``: rules by flag and status, places by part, types by supplier."""
    li = spread(table(spark, sf_dir, "lineitem"))
    rule = F.element_at(F.array(*map(F.lit, ("FL001", "FL002", "FL011", "FL012", "FL020", "FL060"))),
        (F.ascii("l_returnflag") + F.ascii("l_linestatus")) % 6 + 1)
    evidence = F.create_map(F.lit("type_name"), F.concat(F.lit("S"), text_of("l_suppkey")), F.lit("thread_escape"),
        F.when(F.col("l_tax") > 0.02, "true").otherwise("false"), F.lit("sizeof"), F.concat(text_of("l_quantity"), F.lit("B")))
    claims = F.array(S.claim("m", "p", F.col("l_discount") > 0.02, (F.col("l_linenumber") % 4)),
        S.claim("g", "p", True, (F.col("l_quantity").cast("int") % 3) + 1, gating=True))
    return li.select(
        rule.alias("rule"), F.lit("row").alias("title"), (F.col("l_linenumber") % 4).cast("int").alias("severity"),
            F.round(0.3 + F.col("l_quantity") / 100, 4).alias("confidence"), (F.col("l_suppkey") % 3).cast("int").alias("tier"),
            F.lit(False).alias("suppressed"),
        F.concat(F.lit("src/p"), text_of("l_partkey")).alias("file"), F.col("l_linenumber").alias("line"), F.lit(1).alias("col"),
            F.lit("").alias("fn"), F.lit("").alias("reasoning"), evidence.alias("evidence"), F.lit("").alias("mitigation"),
        F.array(F.concat(F.lit("order "), text_of("l_orderkey"))).alias("escalations"), F.lit(S.COLD).alias("hotness"),
            claims.alias("claims"),
    )


def pipeline_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of ``lineitem`` in functions where their rule has one, those of locks and allocations hot only if the program makes them so."""
    rows = lineitem_findings(spark, sf_dir)
    in_fn = F.col("rule").isin("FL011", "FL012", "FL020")
    part = F.substring(F.col("file"), 6, 20)
    return rows.withColumns({"fn": F.when(in_fn, F.concat(F.lit("f"), part)).otherwise(""),
            "hotness": F.when(F.col("rule").isin("FL012", "FL020"), S.CANDIDATE).otherwise(F.col("hotness"))})


def pipeline_facts(spark: SparkSession, sf_dir: str) -> dict:
    """Everything that the reduce pipeline takes beside findings: facts of types, calls, writers, arrays, lowered code, failures, sources; refuted clusters and priors."""
    t = lambda n: table(spark, sf_dir, n)
    p, k, s = t("part"), F.col("p_partkey"), F.col("s_suppkey")
    signals = t("supplier").select(tagged("S", s).alias("type"), *((s % (3 + i) == 0).alias(f) for i, f in enumerate(S.SIGNAL_FLAGS)),
        F.lit(1).alias("accessors"))
    edges = p.select(tagged("f", k).alias("src"), F.explode(F.array(2 * k + 1, 2 * k + 2)).alias("d"),
        (F.col("p_size") % 10 == 0).cast("int").alias("loop_depth")).select("src", tagged("f", "d").alias("dst"), "loop_depth")
    striped = p.where("p_partkey % 5 = 0").select(
        tagged("a", k).alias("key"), tagged("a", k).alias("name"), F.lit("").alias("type"), F.lit("s.cpp").alias("file"),
            k.cast("int").alias("line"), (4 * (1 + F.col("p_size") % 17)).cast("bigint").alias("elem_size"),
            (2 + k % 200).cast("bigint").alias("elem_count"), F.lit(8).cast("bigint").alias("decl_align"), (k % 2 == 0).alias("atomic"),
        F.lit(False).alias("volatile"), F.lit(True).alias("static"), (k % 3 == 0).alias("tls"), F.lit(False).alias("head_pad"),
            (k % 4).cast("int").alias("writer_tier"), F.array(tagged("f", k)).alias("writers"),
            F.array().cast("array<string>").alias("aggregators"),
    )
    n = lambda x: x.cast("bigint")
    none = F.array().cast("array<int>")
    profiles = p.where("p_partkey % 3 = 0").select(
        tagged("f", k).alias("mangled"), tagged("f", k).alias("demangled"), F.lit("x.cpp").alias("file"), F.lit(0).alias("line"),
            none.alias("site_lines"), n(k % 2).alias("seq_csts"), n(k % 4).alias("atomics"), n(k % 5).alias("atomic_writes"),
            n(F.lit(0)).alias("located_writes"), n(F.lit(0)).alias("fences"),
        n(k % 2).alias("heap_calls"), n(k % 4).alias("calls"), n(k % 3).alias("indirect_calls"), n(k % 2).alias("locks"),
            none.alias("lock_lines"), n(F.lit(0)).alias("frame"),
    )
    fields = t("lineitem").select(F.concat(tagged("S", "l_suppkey"), tagged("::f", F.col("l_linenumber") % 2)).alias("field"),
        tagged("f", F.col("l_partkey") % 50).alias("writer")).distinct()
    pages = t("pages").select(text_of("page_id").alias("file"),
        F.concat(F.lit("fatal error: 'h"), text_of(F.col("page_id") % 9), F.lit(".h' file not found")).alias("error"))
    lines = p.where("p_partkey % 97 = 0").select(F.concat(F.lit("src/p"), text_of(k)).alias("file"), F.lit(3).alias("line"),
        F.lit("// hazard-suppress FL011").alias("text"))
    facts = reduce.Facts(
        signals=signals, edges=edges, own_depth=p.select(tagged("f", k).alias("fn"), (F.col("p_size") % 4).cast("int").alias("depth")),
            entries=p.where("p_partkey = 2").select(tagged("f", k).alias("fn")), writers=fields,
            overridden=p.where("p_partkey % 2 = 0").select(tagged("f", k).alias("fn")),
        striped=striped, failures=pages, profiles=profiles, lines=lines, main_patterns=["f1"],
    )
    refuted = p.where("p_partkey % 50 = 0").select(F.lit("CacheGeometry").alias("cls"),
        F.array((k % 4).cast("double"), F.lit(0.5), F.lit(1.0), F.col("p_size").cast("double"), *[F.lit(0.0)] * 6).alias("features"),
        F.lit(3).alias("refutations"))
    priors = spark.createDataFrame([("FalseSharing", 0.8, 40), ("HeapAllocation", 0.3, 200)], "cls string, prior double, n bigint")
    return {"f": facts, "registry": refuted, "priors": priors}
