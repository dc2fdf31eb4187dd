"""Every hazard rule over facts made of whole tables, with DuckDB SQL for its grades, and the record facts that rules read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideway import schemas as S
from strideway.plans import reduce, rules
from strideway.plans.catalog_facts import pick, tagged
from strideway.plans.registry import query, table

PLACES = ("local-init", "main-thread", "any-thread", "interleaved", "explicit-bind", "unknown")
TYPES = ("ns::RingBuf", "ns::Order", "MpscList", "Stats")


def graded(findings: DataFrame, *more) -> DataFrame:
    return findings.select("file", "severity", F.round("confidence", 6).alias("confidence"), "tier",
        S.supported_severity(F.col("claims")).alias("supported"), *more)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of records, one a part."""
    p, z = F.col("p_partkey"), F.col("p_size")
    size = z * F.when(p % 5 == 0, 128).otherwise(8)
    lines = F.ceil(size / 64).cast("int")
    columns = {
        "type": F.concat(pick(TYPES, p)), "file": tagged("p", p), "line": F.lit(1), "size": size,
            "align": F.when(p % 6 == 0, 64).otherwise(8), "min_lines": lines,
            "lines": F.when(p % 6 == 0, lines).otherwise(F.ceil((56 + size) / 64).cast("int")), "writer_lines": p % 5,
        "atomic_fields": p % 4, "mutable_fields": p % 3, "straddling": p % 2, "atomic_lines": F.floor(p / 4) % 4, "escapes": p % 7 != 0,
            "contention": p % 10 / 10.0, "multi_writer": F.floor(p / 4) % 3 == 1, "own_pairs": p % 2, "pairs": F.floor(p / 8) % 3,
            "atomic_pairs": F.when(p % 4 >= 2, F.floor(p / 16) % 2).otherwise(0),
        "deliberate": (p % 6 == 0) | (p % 11 == 0), "refcount_only": p % 8 == 1, "sync": p % 9 == 0, "writes": p % 5,
            "queue_pair": p % 13 == 0, "head_tail": p % 3 == 0, "beyond_atomics": p % 2 == 0, "placement": pick(PLACES, p),
            "pair_fields": F.lit("a|b"),
    }
    return table(spark, sf_dir, "part").select(*(v.alias(k) for k, v in columns.items()))


_RECORDS = """r AS (SELECT *, CAST(ceil(size / 64) AS INTEGER) AS min_lines, CAST(CASE WHEN p % 6 = 0 THEN ceil(size / 64) ELSE ceil((56 + size) / 64) END AS INTEGER) AS lines FROM (SELECT p_partkey AS p, 'p' || p_partkey AS file, p_size * CASE WHEN p_partkey % 5 = 0 THEN 128 ELSE 8 END AS size, CASE WHEN p_partkey % 6 = 0 THEN 64 ELSE 8 END AS align, p_partkey % 5 AS wl,
  p_partkey % 4 AS atomics, p_partkey % 3 AS mutables, p_partkey % 2 AS straddling, p_partkey // 4 % 4 AS al, p_partkey % 7 <> 0 AS escapes, p_partkey % 10 / 10.0 AS contention, p_partkey // 4 % 3 = 1 AS multi, p_partkey % 2 AS own, p_partkey // 8 % 3 AS pairs, CASE WHEN p_partkey % 4 >= 2 THEN p_partkey // 16 % 2 ELSE 0 END AS apairs,
  p_partkey % 6 = 0 OR p_partkey % 11 = 0 AS deliberate, p_partkey % 8 = 1 AS refs, p_partkey % 9 = 0 AS sync, p_partkey % 5 AS writes, p_partkey % 13 = 0 AS qpair, p_partkey % 3 = 0 AS ends, p_partkey % 2 = 0 AS beyond FROM part))"""


def record_rule(name: str, sql: str):
    """Registers a rule over records."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return graded(rules.RULES[name](records(spark, sf_dir)))

    run.__name__ = f"rule_{name}"
    query(f"WITH {_RECORDS}, {sql}")(run)


def _least(cond: str, inner: str, most: int = 1) -> str:
    return f"CASE WHEN {cond} THEN least({inner}, {most}) ELSE {inner} END"


_STEPS = [("refs", "s0"), ("size <= 64", "s1"), ("NOT escapes AND atomics = 0", "s2"), ("contention < 0.30 AND atomics = 0", "s3"),
    ("deliberate AND atomics > 0", "s4")]
_CHAIN = ", ".join(f"x{i + 1} AS (SELECT *, {_least(c, s)} AS s{i + 1} FROM x{i})" for i, (c, s) in enumerate(_STEPS))
record_rule(
    "FL001",
    f"""x0 AS (SELECT *, CASE WHEN min_lines >= 3 AND (wl = 0 OR wl >= 3) THEN 3 ELSE 2 END AS s0 FROM r WHERE lines > 1), {_CHAIN}
  SELECT file, CAST(s5 AS INTEGER) AS severity, CAST(CASE WHEN NOT escapes AND atomics = 0 THEN CASE WHEN min_lines >= 3 THEN 0.52 ELSE 0.42 END WHEN size <= 64 THEN CASE WHEN atomics = 0 THEN 0.45 ELSE 0.55 END WHEN min_lines >= 3 THEN CASE WHEN atomics = 0 THEN 0.82 ELSE 0.90 END ELSE 0.72 END AS DOUBLE) AS confidence,
    0 AS tier, CASE WHEN wl >= 3 THEN 3 ELSE 2 END AS supported FROM x5""",
)
record_rule(
    "FL002",
    """d AS (SELECT *, CASE WHEN apairs > 0 THEN 3 ELSE 2 END AS s0 FROM r WHERE escapes AND pairs + CASE WHEN multi THEN own ELSE 0 END > 0 AND (atomics > 0 OR multi) AND NOT (refs AND apairs = 0)),
  e AS (SELECT *, CASE WHEN deliberate THEN least(s0, 1) ELSE s0 END AS s1 FROM d), f AS (SELECT *, CASE WHEN atomics = 0 AND sync THEN least(s1, 1) ELSE s1 END AS s2 FROM e),
  g AS (SELECT *, CASE WHEN apairs > 0 AND align >= 64 THEN 0.88 WHEN apairs > 0 THEN 0.80 WHEN atomics > 0 THEN 0.68 ELSE 0.60 END AS c FROM f)
  SELECT file, CAST(CASE WHEN writes = 0 AND s2 = 3 THEN 2 ELSE s2 END AS INTEGER) AS severity, CAST(CASE WHEN multi THEN least(c + 0.06, 0.95) WHEN writes = 0 THEN greatest(c - 0.08, 0.50) ELSE c END AS DOUBLE) AS confidence, CASE WHEN apairs > 0 AND align >= 64 THEN 0 ELSE 1 END AS tier,
    CASE WHEN apairs > 0 OR multi THEN CASE WHEN deliberate THEN 1 ELSE 3 END ELSE 1 END AS supported FROM g""",
)
record_rule(
    "FL041",
    """d AS (SELECT *, p % 4 IN (0, 2) AS named FROM r), e AS (SELECT *, apairs > 0 AND (named OR ends) AS atomic FROM d), f AS (SELECT * FROM e WHERE atomic OR (escapes AND qpair))
  SELECT file, 3 AS severity, CAST(CASE WHEN named AND ends THEN 0.82 ELSE 0.76 END - CASE WHEN atomic THEN 0 ELSE 0.14 END AS DOUBLE) AS confidence, CASE WHEN atomic THEN 0 ELSE 1 END AS tier, 3 AS supported FROM f""",
)
record_rule(
    "FL060",
    """d AS (SELECT *, CASE WHEN size >= 4096 THEN 3 ELSE 2 END AS s, ([0.3, 0.8, 1.0, 0.4, 0.1, 1.0])[p % 6 + 1] AS factor FROM r WHERE size >= 256 AND escapes AND mutables + atomics > 0)
  SELECT file, CAST(CASE WHEN p % 6 IN (0, 4) THEN least(s, 1) ELSE s END AS INTEGER) AS severity, round(CAST(CASE WHEN atomics > 0 THEN 0.55 ELSE 0.35 END * (0.5 + 0.5 * contention) * factor AS DOUBLE), 6) AS confidence, 2 AS tier, 2 AS supported FROM d""",
)
record_rule(
    "FL090",
    """d AS (SELECT * FROM r WHERE lines >= 3 AND atomics >= 2 AND al >= 2 AND escapes AND beyond)
  SELECT file, CASE WHEN deliberate THEN 1 ELSE 3 END AS severity, round(CAST(least(1.0, 0.70 + 0.18 * contention) AS DOUBLE), 6) AS confidence, 1 AS tier, CASE WHEN deliberate THEN 1 ELSE 3 END AS supported FROM d""",
)


def sites(spark: SparkSession, sf_dir: str, **columns) -> DataFrame:
    """Sites in functions, one an event, with every grade of heat."""
    k = F.col("event_id")
    plain = {"fn": tagged("f", F.col("user_id") % 50), "file": tagged("e", k), "line": (k % 100).cast("int"), "col": F.lit(1),
        "hotness": (k % 6).cast("int"), "in_loop": F.floor(k / 6) % 2 == 0}
    return table(spark, sf_dir, "events").select(*(v.alias(n) for n, v in (plain | columns).items()))


_SITES = "s AS (SELECT event_id AS k, 'e' || event_id AS file, CAST(event_id % 6 AS INTEGER) AS h, event_id // 6 % 2 = 0 AS l, user_id AS u, value AS v FROM events)"


def gate(sev: str, best: str) -> str:
    """The best mechanism below what the heat supports."""
    return f"CAST(least({best}, CASE WHEN h >= 4 THEN 3 WHEN h = 3 THEN greatest({sev} - 1, 0) WHEN h IN (1, 2) THEN greatest({sev} - 2, 0) ELSE 0 END) AS INTEGER) AS supported"


def site_rule(name: str, columns, sql: str, **options):
    """Registers a rule over sites; ``columns`` makes further columns of the event's number and of one that heat and loops do not follow."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        k = F.col("event_id")
        return graded(rules.RULES[name](sites(spark, sf_dir, **columns(k, F.floor(k / 12))), **options))

    run.__name__ = f"rule_{name}"
    query(f"WITH {_SITES}, {sql}")(run)


site_rule(
    "FL010",
    lambda k, b: {"op": F.lit("store"), "op_class": pick(("store", "load", "rmw"), b),
        "ordering": F.when(b % 2 == 0, "seq_cst").otherwise("relaxed"), "var": F.lit("v"), "owner_type": F.lit("")},
    f"""d AS (SELECT *, k // 12 % 3 = 0 AS st FROM s WHERE h > 0 AND k // 12 % 2 = 0), g AS (SELECT *, CASE WHEN st AND l THEN 3 WHEN st THEN 3 ELSE 2 END AS sev FROM d)
  SELECT file, sev AS severity, CAST(CASE WHEN st AND l THEN 0.92 WHEN st THEN 0.90 ELSE 0.80 END AS DOUBLE) AS confidence, 0 AS tier, {gate('sev', 'CASE WHEN l THEN 3 ELSE sev END')} FROM g""",
    arm=True,
)
site_rule(
    "FL012",
    lambda k, b: {"kind": F.lit("mutex"), "nested": b % 2 == 0},
    f"""d AS (SELECT *, k // 12 % 2 = 0 AS n FROM s WHERE h > 0), g AS (SELECT *, CASE WHEN l AND n THEN 3 WHEN l OR n THEN 2 ELSE 1 END AS sev FROM d)
  SELECT file, sev AS severity, CAST(0.75 AS DOUBLE) AS confidence, 0 AS tier, {gate('sev', 'sev')} FROM g""",
)
CALLS = ("", "_mm_pause", "foo waiter", "futex", "std::this_thread::yield", "my_relax", "a::b::poll", "await", "__builtin_ia32_mwaitx",
    "Backoff::spin")
site_rule(
    "FL013",
    lambda k, b: {"polled": F.lit("x"), "form": pick(("tas", "cas", "load"), b), "body_stmts": (b % 6).cast("int"), "relaxed": b % 17 == 0,
        "calls": pick(CALLS, F.floor(k / 7))},
    f"""d AS (SELECT *, k // 12 % 3 AS form FROM s WHERE h > 0 AND k // 12 % 6 <= 4 AND k // 7 % 10 IN (0, 2, 5, 7) AND k // 12 % 17 <> 0)
  SELECT file, 2 AS severity, CAST(CASE form WHEN 0 THEN 0.78 WHEN 1 THEN 0.62 ELSE 0.75 END AS DOUBLE) AS confidence, 1 AS tier, {gate('2', '2')} FROM d""",
    relax=["Back*::*"],
)
site_rule(
    "FL020",
    lambda k, b: {"kind": F.lit("new"), "allocator": pick(("thread-local-cache", "arena-lock", "syscall-mmap", "pool-slab", "odd"), b),
        "escapes": b % 2 == 0, "flows_to_loop": b % 3 == 0},
    f"""d AS (SELECT *, ([0.3, 1.0, 1.5, 0.2, 1.0])[k // 12 % 5 + 1] AS factor, k // 12 % 5 = 2 AS sys, k // 12 % 2 = 0 AS esc, k // 12 % 3 = 0 AS flows FROM s WHERE h > 0),
  e AS (SELECT *, CASE WHEN factor < 0.4 THEN 1 WHEN factor < 0.8 THEN 2 ELSE 3 END AS s0, greatest(0.20, least(1.0, 0.75 * factor)) AS c FROM d), g AS (SELECT *, CASE WHEN l OR flows THEN greatest(s0, 2) ELSE s0 END AS sev FROM e)
  SELECT file, sev AS severity, round(CAST(CASE WHEN esc AND c < 0.85 THEN c + 0.10 ELSE c END AS DOUBLE), 6) AS confidence, 1 AS tier, {gate('sev', 'CASE WHEN sys THEN 3 WHEN l THEN 2 ELSE 1 END')} FROM g""",
)
site_rule(
    "FL030",
    lambda k, b: {"class": F.lit("C"), "method": F.lit("m")},
    f"""g AS (SELECT *, CASE WHEN l THEN 3 ELSE 2 END AS sev FROM s WHERE h > 0)
  SELECT file, sev AS severity, CAST(0.70 AS DOUBLE) AS confidence, 1 AS tier, {gate('sev', 'least(CASE WHEN l THEN 3 ELSE 2 END, CASE WHEN l THEN 2 ELSE 1 END)')} FROM g""",
)
site_rule(
    "FL031",
    lambda k, b: {"kind": pick(("invoke", "construct", "parameter"), b)},
    f"""d AS (SELECT *, k // 12 % 3 AS kind FROM s WHERE h > 0), g AS (SELECT *, CASE WHEN l AND kind <> 2 THEN 3 ELSE 2 END AS sev FROM d)
  SELECT file, sev AS severity, CAST(CASE WHEN kind = 2 THEN 0.65 ELSE 0.70 END AS DOUBLE) AS confidence, 1 AS tier, {gate('sev', 'least(CASE WHEN l THEN 3 ELSE 2 END, CASE WHEN kind = 1 THEN 3 WHEN l THEN 2 ELSE 1 END)')} FROM g""",
)
site_rule(
    "FL061",
    lambda k, b: {"callees": (b % 11).cast("int"), "virtual_calls": (b % 5).cast("int"), "switch_cases": (b % 8).cast("int"),
        "has_loop": b % 2 == 0},
    f"""d AS (SELECT *, k // 12 % 11 AS c, k // 12 % 5 AS v5, k // 12 % 8 AS w, k // 12 % 2 = 0 AS lp FROM s WHERE h > 0), e AS (SELECT * FROM d WHERE c >= 8 OR (w >= 6 AND c >= 3) OR v5 >= 3),
  g AS (SELECT *, CASE WHEN lp OR (v5 >= 3 AND w >= 4) THEN 3 ELSE 2 END AS sev FROM e)
  SELECT file, sev AS severity, CAST(0.55 AS DOUBLE) AS confidence, 1 AS tier, {gate('sev', 'CASE WHEN v5 >= 3 OR lp THEN 2 ELSE 1 END')} FROM g""",
)
site_rule(
    "FL070",
    lambda k, b: {"kind": F.when(b % 2 == 0, "hot-global").otherwise("mmap"), "symbol": F.lit("s"), "bytes": (b % 5) * (1 << 20),
        "align": F.when(b % 7 == 0, 2 << 20).otherwise(4096), "provable": b % 3 != 0, "huge": b % 11 == 0},
    f"""d AS (SELECT *, k // 12 AS b FROM s WHERE (k // 12) % 5 >= 2 AND (k // 12) % 11 <> 0 AND ((k // 12) % 2 = 1 OR h > 0)), g AS (SELECT *, CASE WHEN b % 7 = 0 OR b % 3 = 0 THEN 0 ELSE 1 END AS sev FROM d)
  SELECT file, sev AS severity, CAST(CASE WHEN b % 7 = 0 THEN 0.35 WHEN b % 3 = 0 THEN 0.30 ELSE 0.65 END AS DOUBLE) AS confidence, 1 AS tier,
    CASE WHEN b % 2 = 1 THEN CASE WHEN b % 7 = 0 THEN 0 ELSE 1 END ELSE CAST(least(CASE WHEN b % 7 = 0 THEN 0 ELSE 1 END, CASE WHEN h >= 4 THEN 3 WHEN h = 3 THEN greatest(sev - 1, 0) ELSE greatest(sev - 2, 0) END) AS INTEGER) END AS supported FROM g""",
)


@query(f"""WITH {_SITES}, d AS (SELECT 'a' || (u % 40) AS file, u % 50 AS fn, max(h) AS h, count(*) AS n, bool_or(l) AS lp FROM s WHERE h > 0 AND k // 12 % 3 <> 1 AND k % 4 = 1 GROUP BY 1, 2),
  g AS (SELECT *, CASE WHEN lp THEN 3 WHEN n >= 3 THEN 2 ELSE 1 END AS sev FROM d WHERE n >= 2 OR lp)
  SELECT file, 'f' || fn AS fn, sev AS severity, CAST(CASE WHEN lp THEN 0.65 ELSE 0.50 END AS DOUBLE) AS confidence, 1 AS tier, {gate('sev', 'CASE WHEN lp THEN 3 ELSE 2 END')}, CAST(n AS VARCHAR) AS atomic_writes FROM g""")
def rule_FL011(spark: SparkSession, sf_dir: str) -> DataFrame:  # noqa: N802
    k = F.col("event_id")
    s = sites(spark, sf_dir, file=tagged("a", F.col("user_id") % 40), k=k, op=F.lit("x"),
        op_class=pick(("store", "load", "rmw"), F.floor(k / 12)), owner_type=F.lit(""))
    return graded(rules.atomic_contention(s.where("k % 4 = 1")), "fn", reduce.ev("atomic_writes").alias("atomic_writes"))


@query("""WITH d AS (SELECT 'p' || (l_partkey % 300) AS file, l_suppkey AS fn, max(l_orderkey % 6) AS h, sum(CAST(l_quantity AS BIGINT) * 20) AS frame FROM lineitem GROUP BY 1, 2),
  g AS (SELECT *, CASE WHEN h > 0 AND frame > 4096 THEN 3 WHEN h > 0 THEN 2 ELSE 1 END AS sev FROM d WHERE frame >= 2048)
  SELECT file, 'f' || fn AS fn, sev AS severity, CAST(0.80 AS DOUBLE) AS confidence, 1 AS tier, CAST(CASE WHEN h = 0 THEN CASE WHEN frame > 4096 THEN 3 ELSE 1 END ELSE least(CASE WHEN frame > 4096 THEN 3 ELSE 2 END, CASE WHEN h >= 4 THEN 3 WHEN h = 3 THEN sev - 1 ELSE greatest(sev - 2, 0) END) END AS INTEGER) AS supported, frame || 'B' AS frame FROM g""")
def rule_FL021(spark: SparkSession, sf_dir: str) -> DataFrame:  # noqa: N802
    li = table(spark, sf_dir, "lineitem")
    locals_ = li.select(tagged("f", "l_suppkey").alias("fn"), tagged("p", F.col("l_partkey") % 300).alias("file"),
        F.lit(1).alias("fn_line"), (F.col("l_orderkey") % 6).cast("int").alias("hotness"), tagged("v", "l_linenumber").alias("var"),
        (F.col("l_quantity").cast("bigint") * 20).alias("size"))
    return graded(rules.stack_frames(locals_), "fn", reduce.ev("estimated_frame").alias("frame"))


@query("""WITH g AS (SELECT 'p' || p_partkey AS file, p_partkey % 3 = 0 AS atomic, p_partkey % 5 <> 0 AS conc FROM part WHERE p_size % 7 <> 0 AND p_size % 11 <> 0)
  SELECT file, CASE WHEN atomic THEN 3 WHEN NOT conc THEN 1 ELSE 2 END AS severity, CAST(CASE WHEN atomic THEN 0.85 ELSE 0.60 END AS DOUBLE) AS confidence, 1 AS tier, CASE WHEN conc THEN 3 ELSE 1 END AS supported FROM g""")
def rule_FL040(spark: SparkSession, sf_dir: str) -> DataFrame:  # noqa: N802
    p, z = F.col("p_partkey"), F.col("p_size")
    g = table(spark, sf_dir, "part").select(tagged("g", p).alias("var"), F.lit("T").alias("type"), tagged("p", p).alias("file"),
        F.lit(1).alias("line"), (z % 7 == 0).alias("const"), (z % 11 == 0).alias("tls"), (p % 3 == 0).alias("atomic"),
        (p % 2 == 0).alias("has_init"), (p % 5 != 0).alias("concurrent"), F.lit(1).alias("writes"), F.lit(0).alias("loop_writes"))
    return graded(rules.mutable_globals(g))


@query(f"""WITH {_SITES}, d AS (SELECT k, 'f' || (u % 50) AS fn, 'a' || (u % 40) AS file, h, CAST(k % 100 AS INTEGER) AS line, k // 12 % 3 = 0 AS sw, k // 12 % 8 AS depth, k // 12 % 11 AS cases, k // 12 % 13 = 0 AS const FROM s WHERE h > 0),
  n AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY fn, file ORDER BY line, depth DESC, h DESC) AS rn FROM d WHERE NOT sw AND depth >= 4) WHERE rn = 1),
  x AS (SELECT fn, file, max(depth) AS top FROM d GROUP BY 1, 2), b AS (SELECT line, fn, file, h, sw, depth FROM n UNION ALL SELECT line, fn, file, h, sw, depth FROM d WHERE sw AND cases >= 8 AND NOT const),
  g AS (SELECT b.*, top, CASE WHEN NOT sw AND depth >= 6 THEN 2 ELSE 1 END AS sev FROM b JOIN x USING (fn, file))
  SELECT file, fn, line, sev AS severity, CAST(0.50 AS DOUBLE) AS confidence, 2 AS tier, {gate('sev', 'least(1, CASE WHEN sw OR depth >= 6 THEN 2 ELSE 1 END)')}, CAST(top AS VARCHAR) AS max_depth FROM g""")
def rule_FL050(spark: SparkSession, sf_dir: str) -> DataFrame:  # noqa: N802
    b = F.floor(F.col("event_id") / 12)
    s = sites(spark, sf_dir, file=tagged("a", F.col("user_id") % 40), kind=F.when(b % 3 == 0, "switch").otherwise("if"),
        depth=(b % 8).cast("int"), cases=(b % 11).cast("int"), const_lookup=b % 13 == 0)
    return graded(rules.deep_branches(s), "fn", "line", reduce.ev("max_depth").alias("max_depth"))


def part_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of records, a record a brand and size: one field a part."""
    p, z = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.concat_ws("/", "p_brand", text(z % 10)).alias("type"), tagged("f", p).alias("field"), p.cast("int").alias("ord"),
            (p * z % 384).alias("offset"), F.lit(8).alias("size"), F.lit(8).alias("granule"), (p % 5 == 0).alias("atomic"),
            (p % 3 != 0).alias("mutable"), F.when(p % 17 == 0, 2).otherwise(1).alias("n_elements"), F.lit(False).alias("char_array"),
    )


def text(c):
    return c.cast("string")


_FIELDS = "f AS (SELECT p_brand || '/' || (p_size % 10) AS type, p_partkey AS p, p_partkey * p_size % 384 AS o, p_partkey % 5 = 0 AS atomic, p_partkey % 3 <> 0 AS mut, p_partkey % 17 = 0 AS two FROM part)"


@query(f"""WITH {_FIELDS}, c AS (SELECT * FROM f WHERE atomic OR mut),
  pr AS (SELECT a.type, a.p AS a, b.p AS b, a.atomic AND b.atomic AS atomics FROM c a JOIN c b ON a.type = b.type AND a.p < b.p WHERE list_bool_or(list_transform(range(0, 64, 8), lambda s: (a.o + s) // 64 <= (b.o + s + 7) // 64 AND (b.o + s) // 64 <= (a.o + s + 7) // 64))),
  w AS (SELECT 'f' || (l_partkey) AS fld, l_partkey AS p, count(DISTINCT l_suppkey % 3) AS n, min(l_suppkey % 3) AS w, bool_or(l_quantity > 49 AND l_suppkey % 3 = 0) AS pool FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 4 = 0 GROUP BY ALL),
  q AS (SELECT pr.*, x.p IS NOT NULL AND y.p IS NOT NULL AND (x.n > 1 OR y.n > 1 OR x.w <> y.w OR x.pool OR y.pool) AS apart FROM pr LEFT JOIN w x ON x.p = pr.a LEFT JOIN w y ON y.p = pr.b),
  ow AS (SELECT c.type, w.p IS NOT NULL AND (w.n > 1 OR w.pool) AS apart FROM c LEFT JOIN w USING (p) WHERE two),
  m AS (SELECT type, line FROM c, range(0, 10) t(line) WHERE line BETWEEN o // 64 AND (o + 56 + 7) // 64 GROUP BY 1, 2 HAVING count(*) FILTER (WHERE atomic) > 0 AND count(*) > count(*) FILTER (WHERE atomic)),
  per AS (SELECT type, count(*) FILTER (WHERE atomic) AS a, count(*) FILTER (WHERE mut) AS mu, count(DISTINCT CASE WHEN atomic THEN o // 64 END) AS al, count(DISTINCT CASE WHEN atomic OR mut THEN o // 64 END) AS wl FROM f GROUP BY 1)
  SELECT type, CAST(a AS BIGINT) AS atomic_fields, CAST(mu AS BIGINT) AS mutable_fields, CAST(al AS BIGINT) AS atomic_lines, CAST(wl AS BIGINT) AS writer_lines, CAST((SELECT count(*) FROM q WHERE q.type = per.type) AS BIGINT) AS pairs, CAST((SELECT count(*) FROM q WHERE q.type = per.type AND atomics) + (SELECT count(*) FROM c WHERE c.type = per.type AND two AND atomic) AS BIGINT) AS atomic_pairs,
    CAST((SELECT count(*) FROM ow WHERE ow.type = per.type AND apart) AS BIGINT) AS own_pairs, coalesce((SELECT bool_or(apart) FROM (SELECT type, apart FROM q UNION ALL SELECT type, apart FROM ow) z WHERE z.type = per.type), false) AS multi_writer, CAST((SELECT count(*) FROM m WHERE m.type = per.type) AS BIGINT) AS mixed_lines FROM per""")
def record_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What rules read of records, pairs of fields by their writers."""
    fields = part_fields(spark, sf_dir)
    heads = fields.select("type").distinct().select("type", F.lit("a.h").alias("file"), F.lit(1).alias("line"), F.lit(384).alias("size"),
        F.lit(8).alias("align"))
    s = F.col("l_suppkey") % 3
    writers = table(spark, sf_dir, "lineitem").where("l_linenumber = 1 AND l_orderkey % 4 = 0").select(tagged("f", "l_partkey")
        .alias("field"), tagged("w", s).alias("writer"), ((F.col("l_quantity") > 49) & (s == 0)).alias("pool"))
    writers = writers.join(fields.select("type", "field").hint("merge"), "field")
    none = spark.createDataFrame([], "type string, escapes boolean, contention double, multi_writer boolean, sync boolean, writes int, beyond_atomics boolean, placement string")
    out = rules.record_summary(heads, fields, none, writers=writers)
    return out.select("type", "atomic_fields", "mutable_fields", "atomic_lines", "writer_lines", "pairs", "atomic_pairs", "own_pairs",
        "multi_writer", "mixed_lines")


@query("""WITH n AS (SELECT event_id, (['refcount', '_refs_', 'use_count', 'cnt', 'Count', 'refCountAndFlags', 'hits', '__rc'])[event_id % 8 + 1] AS name FROM events), g AS (SELECT 't' || (event_id // 2) AS type, bool_or(regexp_replace(lower(name), '^_+|_+$', '', 'g') IN ('ref', 'refs', 'refcount', 'refcnt', 'count', 'cnt', 'nref', 'nrefs', 'rc', 'usecount', 'refcountandflags')) FILTER (WHERE event_id % 2 = 0 OR event_id % 3 = 0) AS named, count(*) FILTER (WHERE event_id % 2 = 0 OR event_id % 3 = 0) AS atomics FROM n GROUP BY 1)
  SELECT type, atomics = 1 AND coalesce(named, false) AS refcount_only FROM g""")
def refcount_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of two fields, one or both atomic."""
    k = F.col("event_id")
    names = ("refcount", "_refs_", "use_count", "cnt", "Count", "refCountAndFlags", "hits", "__rc")
    fields = table(spark, sf_dir, "events").select(tagged("t", F.floor(k / 2)).alias("type"), pick(names, k).alias("field"),
        (k % 2).cast("int").alias("ord"), (k % 2 * 8).cast("int").alias("offset"), F.lit(8).alias("size"), F.lit(8).alias("granule"),
        ((k % 2 == 0) | (k % 3 == 0)).alias("atomic"), F.lit(True).alias("mutable"), F.lit(1).alias("n_elements"),
        F.lit(False).alias("char_array"))
    heads = fields.select("type").distinct().select("type", F.lit("a.h").alias("file"), F.lit(1).alias("line"), F.lit(16).alias("size"),
        F.lit(8).alias("align"))
    none = spark.createDataFrame([], "type string, escapes boolean, contention double, multi_writer boolean, sync boolean, writes int, beyond_atomics boolean, placement string")
    return rules.record_summary(heads, fields, none).select("type", "refcount_only")
