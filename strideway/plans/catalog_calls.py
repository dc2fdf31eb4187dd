"""Facts of functions, readers and measurements over whole tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideway import schemas as S
from strideway import storage
from strideway.operators import calls
from strideway.plans.catalog_facts import evidence, finding_rows, pick, tagged, text_of
from strideway.plans.registry import query, table
from strideway.sources import facts, sinks


def written(lines: DataFrame, name: str) -> str:
    """The folder of a table of lines written as text, for readers."""
    path = storage.place(lines.sparkSession, name)
    lines.write.text(path)
    return path


@query("""SELECT 'c' || o_custkey AS src, 'p' || l_partkey AS dst, max(l_linenumber) AS loop_depth FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2""")
def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1."""
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return calls.call_edges(j.select(tagged("c", "o_custkey").alias("src"), tagged("p", "l_partkey").alias("dst"),
            F.col("l_linenumber").alias("loop_depth")))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'u::lambda:' || event_type || ':' || user_id WHEN event_id % 3 = 1 THEN 'u::lambda:' || event_type || ':' || user_id ELSE 'ns::' || event_type END AS name FROM events""")
def node_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2."""
    k = F.col("event_id")
    qualified = F.when(k % 3 == 2, F.concat(F.lit("ns::"), "event_type")).when(k % 3 == 1, "")
    return table(spark, sf_dir, "events").select("event_id",
        calls.node_name(qualified, F.lit("u"), F.col("event_type"), F.col("user_id")).alias("name"))


@query("""WITH a AS (SELECT o_orderkey, (['pthread_create', 'thrd_create', 'std::async', 'std::thread', 'qsort', 'std::jthread'])[o_orderkey % 6 + 1] AS callee, o_orderkey % 4 AS slot, 'f' || o_custkey AS fn, o_orderstatus = 'F' AS l FROM orders)
  SELECT fn, bool_or(l) OR count(*) > 1 AS pool FROM a WHERE (callee = 'pthread_create' AND slot = 2) OR (callee = 'thrd_create' AND slot = 1) OR (callee = 'std::async' AND slot IN (0, 1)) OR (callee IN ('std::thread', 'std::jthread') AND slot = 0) GROUP BY fn""")
def thread_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3 and T4."""
    k = F.col("o_orderkey")
    return calls.thread_entries(table(spark, sf_dir, "orders")
        .select(pick(("pthread_create", "thrd_create", "std::async", "std::thread", "qsort", "std::jthread"), k).alias("callee"),
            (k % 4).cast("int").alias("slot"), tagged("f", "o_custkey").alias("fn"), (F.col("o_orderstatus") == "F").alias("in_loop")))


@query("""WITH w AS (SELECT DISTINCT 's' || s_suppkey AS callee, s_nationkey % 3 AS slot FROM supplier WHERE s_acctbal > 0),
  a AS (SELECT 's' || l_suppkey AS callee, l_linenumber % 3 AS slot, 'f' || l_partkey AS fn, 'c' || (l_orderkey % 7) AS caller, l_quantity = 50 AS l FROM lineitem)
  SELECT fn, bool_or(l) OR count(DISTINCT caller) > 1 AS pool FROM a JOIN w USING (callee, slot) GROUP BY fn""")
def resolved_spawners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5."""
    forwards = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(tagged("s", "s_suppkey").alias("spawner"),
        (F.col("s_nationkey") % 3).alias("slot"))
    li = table(spark, sf_dir, "lineitem")
    arguments = li.select(tagged("s", "l_suppkey").alias("callee"), (F.col("l_linenumber") % 3).alias("slot"),
        tagged("f", "l_partkey").alias("fn"), tagged("c", F.col("l_orderkey") % 7).alias("caller"),
        (F.col("l_quantity") == 50).alias("in_loop"))
    return calls.resolved_spawners(forwards, arguments)


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS src, 2 * p_partkey + k AS dst FROM part, (VALUES (1), (2)) t(k)), r(node) AS (SELECT 5 UNION SELECT 17 UNION SELECT dst FROM r JOIN e ON src = node) SELECT 'f' || node AS fn FROM r""")
def pool_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T7."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"))
    edges = p.select(tagged("f", "p").alias("src"), F.explode(F.array(2 * F.col("p") + 1, 2 * F.col("p") + 2)).alias("d")).select("src",
        tagged("f", "d").alias("dst"))
    entries = p.where("p IN (5, 9, 17)").select(tagged("f", "p").alias("fn"), (F.col("p") != 9).alias("pool"))
    return calls.pool_closure(edges, entries)


@query("""SELECT user_id AS fn, max(CASE event_type WHEN 'purchase' THEN 5 WHEN 'click' THEN 4 WHEN 'view' THEN 1 ELSE 0 END) AS hotness FROM events GROUP BY 1""")
def strongest_hotness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T10."""
    e = table(spark, sf_dir, "events")
    part = lambda kind, h: e.where(F.col("event_type") == kind).select(F.col("user_id").alias("fn"),
        F.lit(h).alias("hotness"))
    rest = e.where("event_type NOT IN ('purchase', 'click', 'view')").select(F.col("user_id").alias("fn"), F.lit(S.COLD).alias("hotness"))
    return calls.strongest(part("purchase", S.PROFILED), part("click", S.DECLARED), part("view", S.CANDIDATE), rest)


@query("""WITH RECURSIVE e AS (SELECT p_partkey % 2 AS u, p_partkey // 2 AS src, 2 * (p_partkey // 2) + k AS dst, CAST(p_size % 7 = 0 AS INTEGER) AS w FROM part, (VALUES (1), (2)) t(k)),
  r(u, node, depth, hops) AS (SELECT u, n, 0, 0 FROM (VALUES (0, 0), (1, 0), (1, 3)) s(u, n) UNION SELECT e.u, dst, least(depth + w, 4), hops + 1 FROM r JOIN e ON e.u = r.u AND src = node),
  d AS (SELECT u, node, max(depth) AS depth, min(hops) AS hops FROM r GROUP BY 1, 2), o AS (SELECT p_partkey % 2 AS u, p_partkey // 2 AS node, p_size % 4 AS own FROM part)
  SELECT 'u' || d.u AS unit, CASE WHEN d.node = 0 THEN 'main' ELSE 'f' || d.node END AS fn, CASE WHEN depth + CASE WHEN coalesce(own, 0) >= 2 THEN 1 ELSE 0 END >= 2 AND hops <= 8 THEN 3 ELSE 2 END AS hotness FROM d LEFT JOIN o ON o.u = d.u AND o.node = d.node WHERE depth > 0""")
def unit_hotness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by parity as two units, each a tree of calls from ``main``."""
    p = table(spark, sf_dir, "part").select(tagged("u", F.col("p_partkey") % 2).alias("unit"), F.floor(F.col("p_partkey") / 2).alias("n"),
        "p_size")
    name = lambda c: F.when(c == 0, "main").otherwise(tagged("f", c))
    edges = p.select("unit", name(F.col("n")).alias("src"), F.explode(F.array(2 * F.col("n") + 1, 2 * F.col("n") + 2)).alias("d"),
        (F.col("p_size") % 7 == 0).cast("int").alias("loop_depth"))
    own = p.select("unit", name(F.col("n")).alias("fn"), (F.col("p_size") % 4).cast("int").alias("depth"))
    entries = p.where("unit = 'u1' AND n = 3").select("unit", name(F.col("n")).alias("fn"))
    return calls.unit_hotness(edges.select("unit", "src", name(F.col("d")).alias("dst"), "loop_depth"), entries, own)


_FUNCTIONS = "SELECT p_partkey, 'ns::' || replace(p_name, ' ', '_') || p_partkey AS fn, 'src/' || p_brand || '.cpp' AS file, p_size = 50 AS attr FROM part"


@query(f"""WITH f AS ({_FUNCTIONS}), p AS (SELECT 'ns::' || replace(p_name, ' ', '_') || p_partkey AS n FROM part WHERE p_partkey % 31 = 0 UNION ALL SELECT replace(p_name, ' ', '_') || p_partkey FROM part WHERE p_partkey % 37 = 0)
  SELECT fn, CASE WHEN fn IN (SELECT n FROM p) OR replace(fn, 'ns::', '') IN (SELECT n FROM p) THEN 5 WHEN attr OR regexp_matches(fn, '^ns::red_.*$') OR regexp_matches(file, '^.*#7\\.cpp$') THEN 4 ELSE 0 END AS hotness FROM f""")
def declared_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P14."""
    p, bare = table(spark, sf_dir, "part"), F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), text_of("p_partkey"))
    functions = p.select(F.concat(F.lit("ns::"), bare).alias("fn"), F.concat(F.lit("src/"), "p_brand", F.lit(".cpp")).alias("file"),
        (F.col("p_size") == 50).alias("hot_attr"))
    profile = p.where("p_partkey % 31 = 0").select(F.concat(F.lit("ns::"), bare).alias("name")).union(p.where("p_partkey % 37 = 0")
        .select(bare))
    return calls.declared_hot(functions, profile, ["ns::red_*"], ["*#7.cpp"])


@query("""SELECT 'f' || p_partkey AS fn, 1 AS hotness FROM part WHERE p_size > 20 AND p_partkey % 3 <> 0""")
def hot_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T9."""
    p = table(spark, sf_dir, "part")
    hot = p.select(tagged("f", "p_partkey").alias("fn"), F.when(F.col("p_partkey") % 3 == 0, S.SHALLOW).otherwise(S.COLD).alias("hotness"))
    return calls.candidates(p.select(tagged("f", "p_partkey").alias("fn"), (F.col("p_size") > 20).alias("externally_visible")), hot)


@query("""WITH b AS (SELECT DISTINCT o_custkey % 200 AS fn, 'v' || (o_orderkey % 9) AS var, CASE WHEN o_orderstatus = 'F' THEN 'alloc' ELSE 'atomic' END AS kind FROM orders),
  u AS (SELECT user_id % 200 AS fn, 'v' || (event_id % 9) AS var, (['condition', 'argument', 'member', 'return'])[event_id % 4 + 1] AS context, CAST(event_id % 3 AS INTEGER) AS depth, CAST(event_id % 50 AS INTEGER) AS line FROM events)
  SELECT fn, kind, var, max(depth) AS depth, count(DISTINCT CASE WHEN depth > 0 THEN line END) AS loop_lines, bool_or(context = 'condition') AS branches, bool_or(context = 'argument') AS passed, bool_or(context = 'member') AS stored, bool_or(context = 'return') AS returned FROM b JOIN u USING (fn, var) GROUP BY 1, 2, 3""")
def taint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T11."""
    o, e, k = table(spark, sf_dir, "orders"), table(spark, sf_dir, "events"), F.col("event_id")
    b = o.select((F.col("o_custkey") % 200).alias("fn"), tagged("v", F.col("o_orderkey") % 9).alias("var"),
        F.when(F.col("o_orderstatus") == "F", "alloc").otherwise("atomic").alias("kind"))
    u = e.select((F.col("user_id") % 200).alias("fn"), tagged("v", k % 9).alias("var"),
        pick(("condition", "argument", "member", "return"), k).alias("context"), (k % 3).cast("int").alias("depth"),
        (k % 50).cast("int").alias("line"))
    return calls.taint(b, u)


@query("""SELECT l_suppkey, l_linenumber, CAST(count(*) AS BIGINT) AS sites, CAST(count(*) FILTER (WHERE l_quantity > 40) AS BIGINT) AS loop_sites, CAST(count(*) FILTER (WHERE l_returnflag = 'A') AS BIGINT) AS standing, CAST(count(*) FILTER (WHERE l_returnflag <> 'A') AS BIGINT) AS handed,
  array_to_string(list_sort(list(DISTINCT 'w' || (l_partkey % 15))), ',') AS writers FROM lineitem GROUP BY 1, 2""")
def write_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T12."""
    w = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", (F.col("l_quantity") > 40).alias("in_loop"),
        (F.col("l_returnflag") == "A").alias("standing"), tagged("w", F.col("l_partkey") % 15).alias("fn"))
    return calls.write_facts(w, ["l_suppkey", "l_linenumber"]).withColumn("writers", F.array_join("writers", ","))


@query("""SELECT DISTINCT l_orderkey AS fn FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 45)""")
def opaque_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T13."""
    sites = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    return calls.opaque_callers(sites, table(spark, sf_dir, "part").where("p_size < 45").select(F.col("p_partkey").alias("fn")))


@query("""WITH a AS (SELECT p_partkey, p_partkey % 4 AS ec, p_size * 2 AS es, p_partkey % 9 = 0 AS const, CASE WHEN p_partkey % 2 = 0 THEN 1 << CAST(p_partkey % 8 AS INTEGER) END AS ra, p_partkey * 8 % 256 AS o, 1 << CAST(p_partkey % 5 AS INTEGER) AS ta FROM part),
  c AS (SELECT *, CAST(CASE WHEN ra IS NULL THEN ta WHEN ra >= 64 AND o % 64 = 0 THEN 64 ELSE ta END AS BIGINT) AS al FROM a WHERE ec >= 2 AND es > 0 AND es < 64 AND NOT const)
  SELECT p_partkey AS key, al AS decl_align, al >= 64 AND p_partkey % 3 = 0 AS head_pad FROM c""")
def striped_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays with the alignment they have in their records, and pointers to a later element."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    arrays = p.select(k.alias("key"), (k % 4).alias("elem_count"), (F.col("p_size") * 2).cast("bigint").alias("elem_size"),
        (k % 9 == 0).alias("const"), F.when(k % 2 == 0, F.expr("shiftleft(1, cast(p_partkey % 8 as int))")).alias("record_align"),
        (k * 8 % 256).alias("offset"), F.expr("shiftleft(1, cast(p_partkey % 5 as int))").alias("type_align"))
    aliases = p.select(tagged("q", k).alias("alias"), k.alias("target"), F.when(k % 3 == 0, 1).otherwise(0).alias("origin"))
    return calls.head_padded(calls.striped_catalogue(arrays), aliases).select("key", "decl_align", "head_pad")


@query("""WITH n AS (SELECT event_id, (['tid', 'THREAD_ID', 'worker_tid', 'my_thread_index', 'cpu', 'shard_id', 'i', 'a_thread_id', 'x_cpu', 'core_id', 'gettid', 'A_TID'])[event_id % 12 + 1] AS name FROM events)
  SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'constant' WHEN event_id % 5 = 0 THEN 'loop' WHEN event_id % 11 = 0 OR lower(name) IN ('tid', 'thread_id', 'shard_id', 'core_id', 'gettid') OR ends_with(name, '_tid') OR ends_with(name, '_thread_id') OR ends_with(name, '_thread_index') THEN 'thread' ELSE 'unknown' END AS provenance FROM n""")
def index_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T15."""
    k = F.col("event_id")
    name = pick(("tid", "THREAD_ID", "worker_tid", "my_thread_index", "cpu", "shard_id", "i", "a_thread_id", "x_cpu", "core_id", "gettid",
            "A_TID"), k)
    return table(spark, sf_dir, "events").select("event_id",
        calls.index_provenance(k % 7 == 0, k % 5 == 0, k % 11 == 0, name).alias("provenance"))


@query("""SELECT event_id, CASE WHEN event_type = 'click' OR user_id % 10 = 3 THEN 2 WHEN event_type = 'view' THEN 1 WHEN event_id % 2 = 0 THEN 3 ELSE 0 END AS tier FROM events""")
def write_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T16."""
    fn = F.concat(tagged("u", "user_id"), F.lit("::"), "event_type")
    return table(spark, sf_dir, "events").select("event_id",
        calls.write_tier(fn, F.col("event_id") % 2 == 0, ["cl?ck", "u*3::*"], ["view"]).alias("tier"))


@query("""WITH a AS (SELECT p_partkey AS al, p_partkey % 100 AS target, p_partkey % 4 AS origin FROM part WHERE p_partkey >= 1000)
  SELECT l_orderkey, l_linenumber, coalesce(target, l_partkey) AS target, coalesce(origin <> 0, false) AS shifted FROM lineitem LEFT JOIN a ON al = l_partkey""")
def through_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T17."""
    k = F.col("p_partkey")
    writes = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("target"))
    return calls.through_aliases(writes,
        table(spark, sf_dir, "part").where("p_partkey >= 1000")
        .select(k.alias("alias"), (k % 100).alias("target"), (k % 4).alias("origin")))


@query("""SELECT l_suppkey AS type, CASE WHEN bool_or(l_partkey % 97 = 0) THEN 'local-init' WHEN bool_or(l_partkey % 199 = 1) THEN 'main-thread' ELSE 'any-thread' END AS placement FROM lineitem GROUP BY 1""")
def placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T18."""
    k = F.col("l_partkey")
    return calls.placements(table(spark, sf_dir, "lineitem")
        .select(F.col("l_suppkey").alias("type"), (k % 97 == 0).alias("tls"), (k % 199 == 1).alias("is_global")))


_CALLEES = ("malloc", "std::vector", "pool_alloc", "mmap64", "std::pmr::vector", "boost::object_pool", "my_pool_get", "operator new",
    "std::sort", "strdup", "std::__cxx11::basic_string", "sbrk", "std::make_unique", "arena_allocate", "custom_get")


@query(f"""WITH c AS (SELECT event_id, ({list(_CALLEES)})[event_id % {len(_CALLEES)} + 1] AS f, CAST(value * 1500 AS BIGINT) AS b FROM events)
  SELECT event_id, CASE WHEN f IN ('pool_alloc', 'std::pmr::vector', 'boost::object_pool', 'arena_allocate', 'custom_get') THEN 'pool-slab' WHEN b >= 131072 OR f IN ('mmap64', 'sbrk') THEN 'syscall-mmap' WHEN f IN ('malloc', 'std::vector', 'operator new', 'std::__cxx11::basic_string', 'std::make_unique') THEN 'K' ELSE 'unknown' END AS kind FROM c""".replace("'K'", "CASE WHEN event_id % 2 = 0 THEN 'arena-lock' ELSE 'thread-local-cache' END"))
def allocator_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T19, with two linked allocators and a pool of the program."""
    k = F.col("event_id")
    of = lambda linked: calls.allocator_class(pick(_CALLEES, k), F.round(F.col("value") * 1500, 0).cast("bigint"), linked,
        ["custom_get"])
    return table(spark, sf_dir, "events").select("event_id", F.when(k % 2 == 0, of("")).otherwise(of("jemalloc")).alias("kind"))


@query("""SELECT p_partkey, p_brand = 'Brand#3' OR p_type = 'ECONOMY' AS atomic FROM part""")
def configured_atomics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T20."""
    return table(spark, sf_dir, "part").select("p_partkey",
        calls.configured_atomics(F.array("p_brand", "p_type"), ["Brand#3", "ECONOMY"]).alias("atomic"))


_INSTRUCTIONS = ("alloca", "heap_call", "call", "indirect_call", "atomic_load", "atomic_store", "rmw", "cmpxchg", "fence")


@query(f"""WITH i AS (SELECT 'f' || user_id AS fn, CAST(event_id % 20 AS INTEGER) AS block, ({list(_INSTRUCTIONS)})[event_id % 9 + 1] AS kind, user_id % 64 AS bytes, CASE WHEN event_id % 4 = 0 THEN 'seq_cst' WHEN event_id % 4 = 1 THEN 'relaxed' END AS o, CASE WHEN event_id % 5 = 0 THEN 'pthread_mutex_lock' ELSE 'g' END AS callee, CAST(event_id % 3 AS INTEGER) AS line FROM events)
  SELECT fn, max(block) AS blocks, CAST(sum(CASE WHEN kind = 'alloca' THEN bytes ELSE 0 END) AS BIGINT) AS frame, CAST(count(*) FILTER (WHERE kind = 'heap_call') AS BIGINT) AS heap_calls, CAST(count(*) FILTER (WHERE kind = 'call') AS BIGINT) AS calls, CAST(count(*) FILTER (WHERE kind = 'indirect_call') AS BIGINT) AS indirect_calls,
    CAST(count(*) FILTER (WHERE kind IN ('atomic_load', 'atomic_store', 'rmw', 'cmpxchg')) AS BIGINT) AS atomics, CAST(count(*) FILTER (WHERE kind IN ('atomic_load', 'atomic_store', 'rmw', 'cmpxchg') AND o = 'seq_cst') AS BIGINT) AS seq_csts, CAST(count(*) FILTER (WHERE kind IN ('atomic_store', 'rmw', 'cmpxchg')) AS BIGINT) AS atomic_writes,
    CAST(count(*) FILTER (WHERE kind = 'fence') AS BIGINT) AS fences, CAST(count(*) FILTER (WHERE kind = 'cmpxchg' OR (kind = 'call' AND callee = 'pthread_mutex_lock')) AS BIGINT) AS locks,
    coalesce(array_to_string(list_sort(list(DISTINCT line) FILTER (WHERE kind = 'cmpxchg' AND line > 0)), ','), '') AS lock_lines FROM i GROUP BY 1""")
def ir_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T21."""
    k = F.col("event_id")
    i = table(spark, sf_dir, "events").select(tagged("f", "user_id").alias("fn"), (k % 20).cast("int").alias("block"),
        pick(_INSTRUCTIONS, k).alias("kind"), (F.col("user_id") % 64).alias("bytes"),
        F.when(k % 4 == 0, "seq_cst").when(k % 4 == 1, "relaxed").alias("ordering"),
        F.when(k % 5 == 0, "pthread_mutex_lock").otherwise("g").alias("callee"), (k % 3).cast("int").alias("line"))
    out = calls.ir_profiles(i)
    return out.select("fn", "blocks", "frame", "heap_calls", "calls", "indirect_calls", "atomics", "seq_csts", "atomic_writes", "fences",
        "locks", F.array_join("lock_lines", ",").alias("lock_lines"))


@query("""WITH f AS (SELECT o_orderkey AS ord, CASE o_orderkey % 5 WHEN 0 THEN '_Zf' || o_custkey WHEN 1 THEN 'ns::f' || o_custkey || '(int)' WHEN 2 THEN 'f' || o_custkey WHEN 3 THEN '(anonymous namespace)::g' || o_custkey ELSE 'none' END AS name, 'x/src/' || (o_custkey % 7) || '.cpp' AS file, 1 + o_orderkey % 40 AS line FROM orders),
  p AS (SELECT c_custkey, '_Zf' || c_custkey AS m, 'ns::f' || c_custkey || '(int)' AS d, 'f' || c_custkey AS c, 'src/' || (c_custkey % 7) || '.cpp' AS file, 1 + c_custkey % 50 AS line FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, '_Zg' || c_custkey, 'g' || c_custkey || '<int>(char)', 'g' || c_custkey, 'y/' || (c_custkey % 7) || '.cpp', 1 + c_custkey % 50 FROM customer WHERE c_custkey % 3 = 0),
  j AS (SELECT ord, 0 AS rank, m FROM f JOIN p ON name = m UNION ALL SELECT ord, 1, m FROM f JOIN p ON name = d UNION ALL SELECT ord, 2, m FROM f JOIN p ON name = c UNION ALL SELECT ord, 3, m FROM f JOIN p ON replace(name, '(anonymous namespace)::', '') = c AND name <> c
    UNION ALL SELECT ord, 4, m FROM f JOIN p ON f.line = p.line AND ends_with(f.file, '/' || p.file)),
  b AS (SELECT ord, arg_min(m, (rank, m)) AS mangled FROM j GROUP BY ord) SELECT ord, mangled FROM f LEFT JOIN b USING (ord)""")
def resolved_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lowered function a finding's name or place means."""
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    name = F.when(k % 5 == 0, tagged("_Zf", "o_custkey")).when(k % 5 == 1,
        F.concat(tagged("ns::f", "o_custkey"), F.lit("(int)"))).when(k % 5 == 2, tagged("f", "o_custkey")).when(k % 5 == 3,
        tagged("(anonymous namespace)::g", "o_custkey")).otherwise("none")
    wanted = table(spark, sf_dir, "orders").select(k.alias("ord"), name.alias("name"),
        F.concat(tagged("x/src/", F.col("o_custkey") % 7), F.lit(".cpp")).alias("file"), (1 + k % 40).cast("int").alias("line"))
    customer = table(spark, sf_dir, "customer")
    line = (1 + c % 50).cast("int").alias("line")
    one = customer.where("c_custkey % 2 = 0").select(tagged("_Zf", c).alias("mangled"),
        F.concat(tagged("ns::f", c), F.lit("(int)")).alias("demangled"), F.concat(tagged("src/", c % 7), F.lit(".cpp")).alias("file"), line)
    two = customer.where("c_custkey % 3 = 0").select(tagged("_Zg", c), F.concat(tagged("g", c), F.lit("<int>(char)")),
        F.concat(tagged("y/", c % 7), F.lit(".cpp")), line)
    found = calls.resolved_profiles(wanted.select("name", "file", "line").distinct(), one.union(two))
    return wanted.join(found, ["name", "file", "line"], "left").select("ord", "mangled")


@query("""WITH f AS (SELECT o_orderkey AS ord, (['FL010', 'FL011', 'FL020', 'FL021', 'FL030', 'FL031'])[o_orderkey % 6 + 1] AS rule, o_custkey AS fn, 1 + o_orderkey % 3 AS line, o_orderkey % 9 / 10.0 AS c FROM orders),
  p AS (SELECT c_custkey AS fn, c_custkey % 3 AS sc, c_custkey % 4 AS ats, c_custkey % 5 AS aw, c_custkey % 2 AS heap, c_custkey % 7 * 600 AS frame, c_custkey % 3 AS ind, c_custkey % 4 AS calls FROM customer WHERE c_custkey % 10 < 7),
  j AS (SELECT f.*, p.fn IS NOT NULL AS there, sc, ats, aw, heap, frame, ind, calls, sc > 0 AND line = 2 AS here FROM f LEFT JOIN p USING (fn))
  SELECT ord, round(CAST(CASE WHEN NOT there THEN c WHEN rule = 'FL010' THEN CASE WHEN here THEN greatest(0.10, least(0.98, c + 0.10)) WHEN sc > 0 THEN greatest(0.10, least(0.92, c + 0.05)) WHEN ats > 0 THEN greatest(0.30, least(0.98, c - 0.20)) ELSE c END
    WHEN rule = 'FL011' THEN CASE WHEN aw > 0 THEN greatest(0.10, least(0.95, c + 0.10)) ELSE c END WHEN rule = 'FL020' THEN CASE WHEN heap > 0 THEN greatest(0.10, least(0.98, c + 0.05)) ELSE greatest(0.40, least(0.98, c - 0.15)) END
    WHEN rule = 'FL021' THEN CASE WHEN frame > 0 AND frame < 2048 THEN c WHEN frame > 0 THEN greatest(0.10, least(0.95, c + 0.10)) ELSE c END WHEN rule = 'FL030' THEN CASE WHEN ind > 0 THEN greatest(0.10, least(0.95, c + 0.10)) WHEN calls > 0 THEN greatest(0.30, least(0.98, c - 0.25)) ELSE c END
    ELSE CASE WHEN ind > 0 THEN greatest(0.10, least(0.95, c + 0.10)) ELSE greatest(0.35, least(0.98, c - 0.20)) END END AS DOUBLE), 6) AS confidence,
    CAST(CASE WHEN there AND ((rule = 'FL010' AND here) OR (rule = 'FL021' AND frame >= 2048)) THEN 0 ELSE 1 END AS INTEGER) AS tier, there AND rule = 'FL021' AND frame > 0 AND frame < 2048 AS suppressed FROM j""")
def ir_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lowered code keeps of findings."""
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    rows = finding_rows(table(spark, sf_dir, "orders"), k, rule=pick(("FL010", "FL011", "FL020", "FL021", "FL030", "FL031"), k),
        fn=tagged("fn", "o_custkey"), line=1 + k % 3, confidence=k % 9 / 10.0, file=F.lit("q.cpp"),
        evidence=evidence(threshold=F.lit("2048B")))
    n = lambda x: x.cast("bigint")
    profiles = table(spark, sf_dir, "customer").where("c_custkey % 10 < 7").select(
        tagged("fn", c).alias("mangled"), tagged("fn", c).alias("demangled"), F.lit("z.cpp").alias("file"), F.lit(0).alias("line"),
            F.when(c % 3 > 0, F.array(F.lit(2))).otherwise(F.array().cast("array<int>")).alias("site_lines"), n(c % 3).alias("seq_csts"),
            n(c % 4).alias("atomics"),
        n(c % 5).alias("atomic_writes"), n(F.lit(0)).alias("located_writes"), n(F.lit(0)).alias("fences"), n(c % 2).alias("heap_calls"),
            n(c % 4).alias("calls"), n(c % 3).alias("indirect_calls"), n(F.lit(0)).alias("locks"),
            F.array().cast("array<int>").alias("lock_lines"), n(c % 7 * 600).alias("frame"),
    )
    return calls.refined(rows, profiles).select("ord", F.round("confidence", 6).alias("confidence"), "tier", "suppressed")


@query("""WITH x(cls, metric, c2c, numa, lbr) AS (VALUES ('CacheGeometry', 'L1D misses', false, true, false), ('LockContention', 'locked loads', true, false, false), ('VirtualDispatch', 'mispredicted calls', false, false, true)),
  f AS (SELECT o_orderkey, (['CacheGeometry', 'LockContention', 'VirtualDispatch', NULL])[o_orderkey % 4 + 1] AS cls, 'p' || o_custkey || '.c:' || (o_orderkey % 50) AS site, o_orderkey % 9 / 10.0 AS confidence FROM orders)
  SELECT site, f.cls, metric, c2c AS needs_c2c, numa AS needs_numa, lbr AS needs_lbr, CAST(confidence AS DOUBLE) AS confidence FROM f LEFT JOIN x USING (cls) WHERE confidence >= 0.25""")
def hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T22, T24 and P13."""
    k = F.col("o_orderkey")
    rows = finding_rows(table(spark, sf_dir, "orders"), k, rule=pick(("FL001", "FL012", "FL030", "FL999"), k),
        file=F.concat(tagged("p", "o_custkey"), F.lit(".c")), line=k % 50, confidence=k % 9 / 10.0)
    return calls.hypotheses(rows, least=0.25).select("site", "cls", "metric", "needs_c2c", "needs_numa", "needs_lbr", "confidence")


@query("""WITH f AS (SELECT o_orderkey AS id, o_custkey AS scope, (['CacheGeometry', 'AtomicContention', 'LockContention', 'HeapAllocation'])[o_orderkey % 4 + 1] AS cls FROM orders)
  SELECT CASE WHEN a.cls = 'AtomicContention' THEN 'IX-001' ELSE 'IX-005' END AS template, a.id AS a, b.id AS b FROM f a JOIN f b USING (scope) WHERE (a.cls = 'AtomicContention' AND b.cls = 'CacheGeometry') OR (a.cls = 'HeapAllocation' AND b.cls = 'LockContention')""")
def hypothesis_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T23."""
    k = F.col("o_orderkey")
    h = table(spark, sf_dir, "orders").select(k.alias("id"), F.concat(tagged("p", "o_custkey"), F.lit(".c:"), text_of(k)).alias("site"),
        pick(("CacheGeometry", "AtomicContention", "LockContention", "HeapAllocation"), k).alias("cls"))
    return calls.hypothesis_pairs(h)


@query("""SELECT CAST(event_id // 8 AS BIGINT) AS granule, CAST(bit_or(CAST(1 AS BIGINT) << CAST(user_id % 62 AS INTEGER)) AS BIGINT) AS mask, CAST(count(*) AS BIGINT) AS writes FROM events GROUP BY 1""")
def granule_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T25."""
    return calls.granule_writes(table(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id") % 62)


@query("""SELECT 'fn_' || event_type AS name, CAST(sum(user_id) AS BIGINT) AS samples, round(100.0 * sum(user_id) / (SELECT sum(user_id) FROM events), 6) AS pct FROM events GROUP BY 1 HAVING 100.0 * sum(user_id) / (SELECT sum(user_id) FROM events) >= 15""")
def profile_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8 and A1."""
    path = written(table(spark, sf_dir, "events")
        .select(F.concat_ws(" ", F.concat(F.lit("fn_"), "event_type"), text_of("user_id")).alias("value")), "profile")
    return facts.profile(spark, path, 15.0).withColumn("pct", F.round("pct", 6))


@query("""SELECT event_type AS name, CAST(count(*) AS BIGINT) AS samples FROM events GROUP BY 1""")
def script_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stacks with an address, a symbol and its offset on a line."""
    frame = F.concat(F.lit("  ffff"), F.hex("event_id"), F.lit(" "), "event_type", F.lit("+0x1f (app)"))
    path = written(table(spark, sf_dir, "events").select(F.explode(F.array(F.lit("app 12 [000] 1.5: cycles:"), frame)).alias("value")),
        "script")
    return facts.profile(spark, path).select("name", "samples")


@query("""SELECT event_id, user_id * 16 AS address, event_id % 512 AS "offset", CAST(event_id % 255 AS BIGINT) AS mask, CAST(event_id % 9 AS INTEGER) AS threads, CAST(event_id % 1000 AS BIGINT) AS writes FROM events""")
def trace_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S14; the event's number stands in front of each count of writes."""
    k = F.col("event_id")
    row = F.concat_ws("\t", F.concat(F.lit("0x"), F.lower(F.hex(F.col("user_id") * 16))), F.hex(k % 512),
        F.concat(F.lit("0X"), F.hex(k % 255)), text_of(k % 9), text_of(k * 1000 + k % 1000))
    path = written(table(spark, sf_dir, "events").select(row.alias("value"))
        .union(spark.createDataFrame([("# base 0x1",), ("@ 0x20\t10\tnew",)], "value string")), "writes")
    writes, _, _ = facts.write_trace(spark, path)
    return writes.select(F.floor(F.col("writes") / 1000).alias("event_id"), "address", "offset", "mask", "threads",
        (F.col("writes") % 1000).alias("writes"))


@query("""SELECT o_orderkey AS address, CASE WHEN (o_orderkey % 64) < 16 + (o_orderkey // 64) % 40 THEN 'g_' || (o_orderkey // 64) END AS symbol FROM orders""")
def symbol_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data symbols of a table, and what addresses lie in."""
    o = table(spark, sf_dir, "orders").where("o_orderkey % 64 = 0").select(F.floor(F.col("o_orderkey") / 64).alias("k"))
    hexa = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    rows = o.select(F.concat_ws(" ", hexa(F.col("k") * 64), hexa(16 + F.col("k") % 40), F.lit("B"), tagged("g_", "k"))
        .alias("value")).union(o.select(F.concat_ws(" ", hexa(F.col("k") * 64), hexa(F.lit(64)), F.lit("T"), tagged("code_", "k"))))
    return facts.symbol_of(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("address")),
        facts.symbols(spark, written(rows, "symbols")))


@query("""SELECT event_id, CAST(event_id * 1000 AS DECIMAL(20, 0)) AS t0, CAST(event_id * 1000 + user_id AS DECIMAL(20, 0)) AS t1 FROM events WHERE user_id > 0""")
def latency_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of events written as binary files by the tasks, and read again."""
    import os

    from pyspark import TaskContext

    base = storage.place(spark, "ticks").removeprefix("file:")

    def write(batches):
        import numpy as np
        import pyarrow as pa

        os.makedirs(base, exist_ok=True)
        n = 0
        with open(f"{base}/{TaskContext.get().partitionId()}.bin", "wb") as f:
            for b in batches:
                f.write(np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1).astype("<u8").tobytes())
                n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    ticks = table(spark, sf_dir, "events").select((F.col("event_id") * 1000).alias("t0"),
        (F.col("event_id") * 1000 + F.col("user_id")).alias("t1"))
    ticks.mapInArrow(write, "n bigint").agg(F.sum("n")).collect()
    return facts.latency_samples(spark, base).select(F.floor(F.col("t0") / 1000).cast("bigint").alias("event_id"), "t0", "t1")


@query("""SELECT md5(length(event_type) || ':' || event_type || '|' || length(CAST(user_id AS VARCHAR)) || ':' || user_id || '|1') AS key, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type, user_id""")
def content_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache by content: half of the units are worked out first, then all, of which only the other half is left."""
    from strideway.sources import cache

    e = table(spark, sf_dir, "events").select(cache.content_key(F.col("event_type"), text_of("user_id")).alias("key"), "user_id")
    path = storage.place(spark, "cache")
    count = lambda d: d.groupBy("key").agg(F.count("*").alias("n"))
    cache.cached(e.where("user_id % 2 = 0"), path, count)
    return cache.cached(e, path, count)


@query("""SELECT o_orderkey AS ord, CASE CAST(o_orderkey % 4 AS INTEGER) WHEN 3 THEN 'error' WHEN 2 THEN 'warning' ELSE 'note' END AS level, CAST(greatest(o_orderkey % 5, 1) AS INTEGER) AS start, CAST(o_orderkey % 3 AS INTEGER) AS index FROM orders""")
def sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: the results of a log, read back from its lines."""
    k = F.col("o_orderkey")
    rows = finding_rows(table(spark, sf_dir, "orders"), k, rule=pick(("FL001", "FL002", "FL011"), k), severity=k % 4, line=k % 5,
        title=text_of(k), file=pick(("a", "b", "c"), k))
    # in output order FL001 of file a comes first, then FL002 of b
    lines = sinks.sarif_rows(rows).where("ord > 0 AND ord < 1000000000").select(F.regexp_replace("value", "^,", "").alias("v"))
    got = lambda p, kind: F.get_json_object("v", p).cast(kind)
    text = F.regexp_extract(F.get_json_object("v", "$.message.text"), r"^(\d+):", 1)
    return lines.select(text.cast("bigint").alias("ord"), got("$.level", "string").alias("level"),
        got("$.locations[0].physicalLocation.region.startLine", "int").alias("start"), got("$.ruleIndex", "int").alias("index"))


@query("""SELECT o_orderkey AS ord, (['Informational', 'Medium', 'High', 'Critical'])[o_orderkey % 4 + 1] AS severity, CAST(CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE o_orderkey % 9 / 10.0 END AS DOUBLE) AS confidence, 'C' || o_custkey AS type_name FROM orders""")
def json_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result document written line by line, and read again as a scan result's diagnostics."""
    k = F.col("o_orderkey")
    rows = finding_rows(table(spark, sf_dir, "orders"), k, severity=k % 4, title=text_of(k),
        confidence=F.when(k % 9 == 0, float("nan")).otherwise(k % 9 / 10.0), evidence=evidence(type_name=tagged("C", "o_custkey")))
    lines = sinks.json_rows(rows).where("ord > 0 AND ord < 1000000000").select(F.regexp_replace("value", "^,", "").alias("v"))
    d = lines.select(F.array(F.from_json("v", facts.DIAGNOSTIC)).alias("diagnostics"))
    out = facts.findings_of(d)
    return out.select(F.col("title").cast("bigint").alias("ord"), S.name_of(S.SEVERITIES, F.col("severity")).alias("severity"),
        "confidence", F.try_element_at("evidence", F.lit("type_name")).alias("type_name"))


@query("""SELECT 'u' || p_partkey || '.cpp' AS unit, CASE WHEN p_partkey % 2 = 0 THEN '/abs/' || p_brand ELSE '/root/' || p_brand END AS include, p_partkey % 3 = 0 AS as_list FROM part""")
def compile_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units with their commands as one text or as a list, include paths made absolute."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    file = F.concat(tagged("u", k), F.lit(".cpp"))
    include = F.when(k % 2 == 0, F.concat(F.lit("/abs/"), "p_brand")).otherwise(F.col("p_brand"))
    listed = F.when(k % 3 == 0, F.array(F.lit("cc"), F.lit("-I"), include, F.lit("-c"), file))
    command = F.when(k % 3 != 0, F.concat_ws("  ", F.lit("cc"), F.concat(F.lit("-I"), include), F.lit("-c"), file))
    row = F.to_json(F.struct(F.lit("/root").alias("directory"), file.alias("file"), command.alias("command"), listed.alias("arguments")))
    one = p.agg(F.concat(F.lit("["), F.array_join(F.collect_list(row), ",\n"), F.lit("]")).alias("value"))  # a build's units are one document
    found = facts.compile_db(spark, written(one, "compile"))
    as_list = F.element_at("arguments", 2) == "-I"
    path = F.when(as_list, F.element_at("arguments", 3)).otherwise(F.substring(F.element_at("arguments", 2), 3, 1000))
    return found.select(F.substring_index("file", "/", -1).alias("unit"), path.alias("include"), as_list.alias("as_list"))


@query("""WITH e AS (SELECT *, 'f' || (user_id % 3) AS fn, user_id % 2 AS line FROM events), r AS (SELECT *, CAST(lag(fn || '/' || line) OVER (ORDER BY event_id) IS DISTINCT FROM fn || '/' || line AS INTEGER) AS fresh FROM e),
  n AS (SELECT *, sum(fresh) OVER (ORDER BY event_id) AS run FROM r)
  SELECT CAST(min(event_id) AS BIGINT) AS first, fn, CAST(line AS INTEGER) AS line, CAST(count(*) AS BIGINT) AS samples, CAST(sum(event_id % 7) AS BIGINT) AS duration FROM n GROUP BY run, fn, line""")
def pmu_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a trace, which has an order and so is one file, as records of consecutive rows of a place."""
    k, u = F.col("event_id"), F.col("user_id")
    row = F.concat_ws("\t", tagged("f", u % 3), F.lit("a.c"), text_of(u % 2), "event_type", text_of(k), text_of(k % 7))
    # sorted part by part; the task that writes the one file only copies the parts, in their order
    parts = storage.saved(table(spark, sf_dir, "events").orderBy("event_id").select(row.alias("value")), "ordered").inputFiles()
    lines = fold(DataFrame.unionByName, (spark.read.parquet(f) for f in sorted(parts)))
    trace = facts.pmu_trace(spark, written(lines.coalesce(1), "trace"))
    by = trace.groupBy("record", "fn", "line").agg(F.min("value").alias("first"), F.count("*").alias("samples"), F.sum("duration_ns").alias("duration"))
    return by.select("first", "fn", "line", "samples", "duration")


@query("""SELECT 'C' || user_id AS cls, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS confirmed, round((count(*) FILTER (WHERE event_type = 'click') + 1) / (count(*) + 2), 6) AS prior FROM events GROUP BY 1, user_id""")
def priors_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priors written as a file of sorted lines, and read."""
    from strideway.plans import feedback

    said = F.when(F.col("event_type") == "click", "Positive").when(F.col("event_type") == "view", "Negative").otherwise("Unlabeled")
    priors = feedback.updated_priors(table(spark, sf_dir, "events").select(tagged("C", "user_id").alias("cls"), said.alias("verdict")))
    path = storage.place(spark, "priors")
    facts.write_priors(priors, path)
    return facts.priors(spark, path).select("cls", "n", "confirmed", F.round("prior", 6).alias("prior"))


@query("""SELECT 'a' || (o_orderkey % 3) || '.h' AS changed, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_orderkey % 3""")
def changed_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S17."""
    row = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("  "), tagged("a", F.col("o_orderkey") % 3), F.lit(".h  "))).otherwise(F.concat(tagged("a", F.col("o_orderkey") % 3), F.lit(".h")))
    lines = table(spark, sf_dir, "orders").select(row.alias("value")).union(spark.createDataFrame([("",), ("   ",)], "value string"))
    return facts.changed_files(spark, written(lines, "changed")).groupBy("changed").agg(F.count("*").alias("n"))


@query("""SELECT '[' || (['Informational', 'Medium', 'High', 'Critical'])[o_orderkey % 4 + 1] || '] FL001 c' || o_custkey || '.c:' || (o_orderkey % 5) || ':1 t' || o_orderkey || ' (' || (o_orderkey % 10 * 10) || '%, likely)' AS value FROM orders""")
def cli_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3."""
    k = F.col("o_orderkey")
    file = F.concat(tagged("c", "o_custkey"), F.lit(".c"))
    rows = finding_rows(table(spark, sf_dir, "orders"), k, severity=k % 4, file=file, line=k % 5, title=tagged("t", k), confidence=k % 10 / 10.0)
    return sinks.plain(rows).select("value")


@query("""WITH f AS (SELECT 'c' || o_custkey || '.c:' || greatest(o_orderkey % 5, 1) || ':1: ' AS place, CASE o_orderkey % 4 WHEN 3 THEN 'error' WHEN 0 THEN 'note' ELSE 'warning' END AS level, o_orderkey FROM orders)
  SELECT place || level || ': ' || CASE WHEN o_orderkey % 2 = 0 THEN 'First of ' || o_orderkey || '.' ELSE 'a title' END || ' [FL001]' AS value FROM f UNION ALL SELECT place || 'note: told ' || o_orderkey FROM f WHERE o_orderkey % 3 = 0""")
def tidy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4."""
    k = F.col("o_orderkey")
    file = F.concat(tagged("c", "o_custkey"), F.lit(".c"))
    told = F.when(k % 3 == 0, F.array(tagged("told ", k))).otherwise(F.array().cast("array<string>"))
    why = F.when(k % 2 == 0, F.concat(tagged("First of ", k), F.lit(". Second."))).otherwise("no end")
    rows = finding_rows(table(spark, sf_dir, "orders"), k, severity=k % 4, file=file, line=k % 5, title=F.lit("a title"), reasoning=why, escalations=told)
    return sinks.compiler_like(rows).select("value")


@query("""SELECT 'edge' AS kind, 'f' || l_partkey % 40 AS a, 'g' || l_suppkey AS b, CAST(max(CASE WHEN l_linenumber > 4 THEN l_linenumber ELSE 0 END) AS BIGINT) AS n FROM lineitem GROUP BY l_partkey % 40, l_suppkey
  UNION ALL SELECT 'entry', 'f' || l_partkey, '', 0 FROM lineitem WHERE l_quantity = 50 GROUP BY l_partkey
  UNION ALL SELECT 'coverage', '', '', CAST(sum(l_linenumber) AS BIGINT) FROM lineitem""")
def record_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of units written as their records, and merged over all units when read."""
    li = table(spark, sf_dir, "lineitem").withColumn("src", tagged("u", F.col("l_orderkey") % 25))
    deep = F.when(F.col("l_linenumber") > 4, F.col("l_linenumber")).otherwise(0)
    edges = li.groupBy("src", tagged("f", F.col("l_partkey") % 40).alias("caller"), tagged("g", "l_suppkey").alias("dst")).agg(F.max(deep).alias("loop_depth"))
    tables = {
        "edges": edges,
        "entries": li.where("l_quantity = 50").select("src", tagged("f", "l_partkey").alias("fn")),
        "coverage": li.select("src", F.col("l_linenumber").alias("functions"), F.lit(0).alias("hot"), F.lit(0).alias("records")),
    }
    none = finding_rows(spark.range(0), F.col("id")).withColumn("src", F.lit(""))
    path = storage.place(spark, "records")
    facts.write_shards(facts.records_of(none, tables), path)
    got = facts.facts_of(facts.shards(spark, path)[0])
    n = lambda c: F.col(c).cast("bigint").alias("n")
    out = got["edges"].select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), n("loop_depth"))
    out = out.unionByName(got["entries"].select(F.lit("entry").alias("kind"), F.col("fn").alias("a"), F.lit("").alias("b"), F.lit(0).cast("bigint").alias("n")))
    return out.unionByName(got["coverage"].select(F.lit("coverage").alias("kind"), F.lit("").alias("a"), F.lit("").alias("b"), n("functions")))
