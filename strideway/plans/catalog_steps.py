"""Every step of the reduce pipeline over facts made of whole tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideway import schemas as S
from strideway.operators import joins, layout, ranking, setdiff
from strideway.plans import feedback, reduce
from strideway.plans.catalog_facts import evidence, finding_rows, lineitem_findings, pick, tagged, text_of
from strideway.plans.registry import query, table
from strideway.sources import facts as readers

def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


def note(k: int = 0):
    return F.coalesce(F.get("escalations", F.lit(k)), F.lit(""))


def grade():
    return F.col("o_orderkey") % 4


def supported():
    return S.supported_severity(F.col("claims")).alias("supported")


def confidence():
    return F.round("confidence", 6).alias("confidence")


@query("""WITH f AS (SELECT o_orderkey AS ord, o_orderkey % 5 < 4 AS mine, o_custkey AS v, o_orderkey % 2 AS t, (o_orderkey // 7) % 3 AS w, CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS lw,
    o_orderkey % 3 = 0 AS ini, o_orderkey % 4 = 1 AS ato, o_orderkey % 4 AS sev FROM orders),
  a AS (SELECT v, t, sum(w) AS gw, sum(lw) AS gl, bool_or(ini) AS gi FROM f WHERE mine GROUP BY 1, 2),
  j AS (SELECT f.*, gw, gl, mine AND gl = 0 AND (gw <= 1 OR (gi AND gw = 0)) AS once FROM f LEFT JOIN a ON mine AND f.v = a.v AND f.t = a.t),
  k AS (SELECT *, mine AND NOT once AND NOT ato AND gw <= 1 AS path FROM j),
  m AS (SELECT *, mine AND NOT once AND NOT path AND sev = 3 AND gl = 0 AND gw < 4 AS flat FROM k)
  SELECT ord, CAST(CASE WHEN once OR path THEN 0 WHEN flat THEN 2 ELSE sev END AS INTEGER) AS severity, CAST(CASE WHEN once THEN 0.30 WHEN path THEN 0.35 ELSE 0.5 END AS DOUBLE) AS confidence,
    CAST(CASE WHEN once OR path THEN 2 ELSE 1 END AS INTEGER) AS tier, CAST(once OR path OR flat AS INTEGER) AS notes, CASE WHEN mine THEN CAST(CAST(gw AS BIGINT) AS VARCHAR) END AS writes, CASE WHEN mine THEN CASE WHEN once THEN 'yes' ELSE 'no' END END AS once FROM m""")
def grouped_reclassify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2."""
    k = F.col("o_orderkey")
    yes = lambda c: F.when(c, "yes").otherwise("no")
    ev = evidence(var=tagged("g", "o_custkey"), type=tagged("T", k % 2), tu_write_count=F.floor(k / 7) % 3,
        tu_loop_writes=F.when(k % 11 == 0, 1).otherwise(0), has_init=yes(k % 3 == 0), atomics=yes(k % 4 == 1))
    rows = finding_rows(orders(spark, sf_dir), k, rule=F.when(k % 5 < 4, "FL040").otherwise("FL001"), severity=grade(), evidence=ev)
    out = reduce.global_writes(rows)
    return out.select("ord", "severity", "confidence", "tier", F.size("escalations").alias("notes"),
        reduce.ev("global_write_count").alias("writes"), reduce.ev("write_once").alias("once"))


def signals(spark: SparkSession, sf_dir: str, base: int = 2) -> DataFrame:
    """Signals of customers as types ``C<key>``: flag i where the key is a multiple of ``base + i``; a second unit says who has debts."""
    c = table(spark, sf_dir, "customer")
    first = c.select(tagged("C", "c_custkey").alias("type"),
        *((F.col("c_custkey") % (base + i) == 0).alias(f) for i, f in enumerate(S.SIGNAL_FLAGS)), F.lit(1).alias("accessors"))
    debts = c.where("c_acctbal < -900").select(tagged("C", "c_custkey").alias("type"),
        *(F.lit(f == "shared_owner").alias(f) for f in S.SIGNAL_FLAGS), F.lit(2).alias("accessors"))
    return first.unionByName(debts)


@query("""WITH e AS (SELECT c_custkey FROM customer WHERE c_custkey % 30 = 0 OR c_custkey % 31 = 0 OR c_custkey % 32 = 0 OR c_custkey % 33 = 0 OR c_custkey % 34 = 0 OR c_custkey % 35 = 0 OR c_custkey % 36 = 0 OR c_acctbal < -900),
  f AS (SELECT o_orderkey AS ord, o_custkey, o_orderkey % 3 <> 0 AS claimed, o_orderkey % 5 AS t, o_orderkey % 7 = 0 AS gone FROM orders)
  SELECT ord, gone OR (claimed AND t <> 0 AND c_custkey IS NULL) AS suppressed, CAST(NOT gone AND claimed AND t <> 0 AND c_custkey IS NULL AS INTEGER) AS notes FROM f LEFT JOIN e ON c_custkey = o_custkey""")
def escape_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R4."""
    k = F.col("o_orderkey")
    said = F.when(k % 3 == 0, "false").when(k % 2 == 0, "true").otherwise("yes")
    rows = finding_rows(orders(spark, sf_dir), k, tier=F.when(k % 5 == 0, S.PROVEN).otherwise(S.LIKELY), suppressed=k % 7 == 0,
        evidence=evidence(type_name=tagged("C", "o_custkey"), thread_escape=said))
    out = reduce.escape_suppression(rows, reduce.Facts(signals=signals(spark, sf_dir, 30), units=2))
    return out.select("ord", "suppressed", F.size("escalations").alias("notes"))


@query("""WITH k AS (SELECT c_custkey AS c, c_custkey % 10 = 0 AND (c_custkey % 6 = 0 OR c_custkey % 7 = 0 OR (c_custkey % 8 = 0 AND c_custkey % 9 = 0)) AS shared FROM customer),
  f AS (SELECT o_orderkey AS ord, o_orderkey % 3 <> 0 AND o_orderkey % 7 <> 0 AS mine, o_custkey AS a, o_custkey + 700 AS b FROM orders)
  SELECT ord, CAST(mine AND (x.c IS NOT NULL OR y.c IS NOT NULL) AND NOT coalesce(x.shared, false) AND NOT coalesce(y.shared, false) AS INTEGER) AS gates,
    CASE WHEN mine AND (x.c IS NOT NULL OR y.c IS NOT NULL) AND NOT coalesce(x.shared, false) AND NOT coalesce(y.shared, false) THEN 1 ELSE 3 END AS supported FROM f LEFT JOIN k x ON x.c = a LEFT JOIN k y ON y.c = b""")
def sharing_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R5."""
    k = F.col("o_orderkey")
    types = F.concat(tagged("C", "o_custkey"), F.lit(";"), tagged("C", F.col("o_custkey") + 700), F.lit(";other"))
    own = F.array(S.claim("m", "p", True, S.CRITICAL))
    rows = finding_rows(orders(spark, sf_dir), k, rule=pick(("FL001", "FL002", "FL041"), k), suppressed=k % 7 == 0,
        evidence=evidence(type_name=types), claims=own)
    out = reduce.sharing_verdict(rows, reduce.Facts(signals=signals(spark, sf_dir)))
    return out.select("ord", (F.size("claims") - 1).alias("gates"), supported())


def part_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, loop_depth): function ``f<p>`` calls ``f<(7 p + 3) mod N>`` and ``f<p // 2>``, N being the number of parts."""
    p = table(spark, sf_dir, "part").select("p_partkey")
    total = F.broadcast(p.agg(F.count("*").alias("n")))  # one row
    jump = p.crossJoin(total).select(tagged("f", "p_partkey").alias("src"),
        tagged("f", (7 * F.col("p_partkey") + 3) % F.col("n")).alias("dst"))
    return jump.union(p.select(tagged("f", "p_partkey"), tagged("f", F.floor(F.col("p_partkey") / 2)))).withColumn("loop_depth", F.lit(0))


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS src, (7 * p_partkey + 3) % (SELECT count(*) FROM part) AS dst FROM part UNION SELECT p_partkey, p_partkey // 2 FROM part),
  r(node, bit) AS (SELECT p_partkey, 1 FROM part WHERE p_partkey BETWEEN 190 AND 199 UNION SELECT p_partkey, 2 FROM part WHERE p_partkey IN (3, 4, 5) OR p_partkey IN (100, 110, 120, 130, 140, 150, 160, 170, 180, 190) UNION SELECT dst, bit FROM r JOIN e ON src = node)
  SELECT 'f' || node AS fn, CAST(bit_or(bit) AS INTEGER) AS mask FROM r GROUP BY node""")
def thread_role_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R6."""
    entries = table(spark, sf_dir, "part").where("p_partkey IN (3, 4, 5)").select(tagged("f", "p_partkey").alias("fn"))
    return reduce.thread_roles(reduce.Facts(edges=part_calls(spark, sf_dir), entries=entries, main_patterns=["f19?"],
            entry_patterns=["f1?0"]))


def order_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, writer): fields f0 to f2 of a type an order, written by the functions of its lines' parts."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.concat(tagged("ns::O", "l_orderkey"), tagged("::f", F.col("l_linenumber") % 3)).alias("field"),
        tagged("w", F.col("l_partkey") % 12).alias("writer"))


def part_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fn, mask) of ten of the twelve writers."""
    return table(spark, sf_dir, "part").where("p_partkey < 10").select(tagged("w", "p_partkey").alias("fn"),
        (F.col("p_partkey") % 3 + 1).cast("int").alias("mask"))


_FIELD_MASKS = """SELECT l_orderkey AS o, l_linenumber % 3 AS f, CAST(CASE WHEN bool_or(l_partkey % 12 >= 10) THEN 0 ELSE bit_or(l_partkey % 12 % 3 + 1) END AS INTEGER) AS mask FROM lineitem GROUP BY 1, 2"""


@query(f"""SELECT 'ns::O' || o AS type, 'f' || f AS name, mask FROM ({_FIELD_MASKS})""")
def role_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of fields."""
    return reduce.field_roles(reduce.Facts(writers=order_writers(spark, sf_dir)), part_roles(spark, sf_dir))


_ROLE = "CASE {m} WHEN 1 THEN 'main' WHEN 2 THEN 'worker' ELSE 'mixed' END"


@query(f"""WITH m AS (SELECT * FROM ({_FIELD_MASKS}) WHERE mask <> 0),
  p AS (SELECT x.o, x.f AS a, y.f AS b, x.mask AS ma, y.mask AS mb FROM m x JOIN m y ON x.o = y.o AND x.f < y.f AND (x.mask & y.mask) = 0),
  q AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY CASE WHEN o % 3 = 1 THEN CASE WHEN a = 1 AND b = 2 THEN 0 ELSE 1 END ELSE a * 3 + b END) AS rn FROM p WHERE o % 3 = 2 OR (o % 3 = 1 AND NOT (a = 0 AND b = 2))),
  h AS (SELECT * FROM q WHERE rn = 1)
  SELECT o_orderkey AS ord, CAST(CASE WHEN h.o IS NOT NULL THEN 0.58 ELSE 0.5 END AS DOUBLE) AS confidence,
    CASE WHEN h.o IS NOT NULL THEN 'writer roles disjoint across units: f' || a || ' by ' || {_ROLE.format(m='ma')} || ', f' || b || ' by ' || {_ROLE.format(m='mb')} ELSE '' END AS note FROM orders LEFT JOIN h ON h.o = o_orderkey""")
def role_escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of fields that disjoint roles write."""
    k = F.col("o_orderkey")
    ev = evidence(type_name=tagged("ns::O", k), pair_fields=F.when(k % 3 == 1, "f1|f2;f0|f1"))
    rows = finding_rows(orders(spark, sf_dir), k, rule=pick(("FL001", "FL002", "FL090"), k), evidence=ev)
    out = reduce.role_escalation(rows, reduce.Facts(writers=order_writers(spark, sf_dir)), part_roles(spark, sf_dir))
    return out.select("ord", confidence(), note().alias("note"))


def tree_facts(spark: SparkSession, sf_dir: str) -> reduce.Facts:
    """Function ``f<p>`` calls ``f<2 p + 1>`` and ``f<2 p + 2>``, in a loop where the part's size is a multiple of 10."""
    p = table(spark, sf_dir, "part")
    edges = p.select(tagged("f", "p_partkey").alias("src"),
        F.explode(F.array(2 * F.col("p_partkey") + 1, 2 * F.col("p_partkey") + 2)).alias("d"),
        (F.col("p_size") % 10 == 0).cast("int").alias("loop_depth"))
    edges = edges.select("src", tagged("f", "d").alias("dst"), "loop_depth")
    own = p.select(tagged("f", "p_partkey").alias("fn"), (F.col("p_size") % 4).cast("int").alias("depth"))
    entries = p.where("p_partkey = 2").select(tagged("f", "p_partkey").alias("fn"))
    return reduce.Facts(edges=edges, own_depth=own, entries=entries, main_patterns=["f1"])


_HOT = """RECURSIVE e AS (SELECT p_partkey AS src, 2 * p_partkey + k AS dst, CAST(p_size % 10 = 0 AS INTEGER) AS w FROM part, (VALUES (1), (2)) t(k)),
  r(node, depth, hops) AS (SELECT p_partkey, 0, 0 FROM part WHERE p_partkey IN (1, 2) UNION SELECT dst, least(depth + w, 4), hops + 1 FROM r JOIN e ON src = node),
  d AS (SELECT node, max(depth) AS depth, min(hops) AS hops FROM r GROUP BY node),
  hot AS (SELECT node, CAST(CASE WHEN depth + CASE WHEN coalesce(p_size, 0) % 4 >= 2 THEN 1 ELSE 0 END >= 2 AND hops <= 8 THEN 3 ELSE 2 END AS INTEGER) AS h FROM d LEFT JOIN part ON p_partkey = node WHERE depth > 0)"""


@query(f"""WITH {_HOT} SELECT 'f' || node AS fn, h AS hotness FROM hot""")
def global_hotness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R8."""
    return reduce.global_hotness(tree_facts(spark, sf_dir))


@query(f"""WITH {_HOT}, f AS (SELECT o_orderkey AS ord, o_custkey, o_orderkey % 3 <> 0 AS cand, o_orderkey % 2 = 0 AS needs, o_orderkey % 4 AS sev FROM orders)
  SELECT ord, cand AND h IS NULL AND needs AS suppressed, CAST(CASE WHEN NOT cand THEN 4 WHEN h IS NOT NULL THEN h WHEN needs THEN 1 ELSE 0 END AS INTEGER) AS hotness,
    CAST(CASE WHEN cand AND h = 3 THEN greatest(sev - 1, 0) WHEN cand AND h = 2 THEN greatest(sev - 2, 0) ELSE 2 END AS INTEGER) AS supported FROM f LEFT JOIN hot ON node = o_custkey""")
def resolve_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R9."""
    k = F.col("o_orderkey")
    claims = F.array(S.claim("m", "p", True, S.CRITICAL),
        S.claim(f"{reduce.HOT_EFFECT} (cross-tu-candidate)", "p", False, S.HIGH, gating=True))
    rows = finding_rows(orders(spark, sf_dir), k, rule=pick(("FL012", "FL001"), k), severity=grade(), fn=tagged("f", "o_custkey"),
        hotness=F.when(k % 3 == 0, S.DECLARED).otherwise(S.CANDIDATE), claims=claims)
    return reduce.resolve_candidates(rows, tree_facts(spark, sf_dir)).select("ord", "suppressed", "hotness", supported())


@query("""WITH f AS (SELECT o_orderkey AS ord, o_custkey % 90 AS v, o_orderkey % 3 < 2 AND o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 AS mine FROM orders), o AS (SELECT DISTINCT c_custkey % 61 AS v FROM customer WHERE c_custkey % 61 < 40)
  SELECT ord, CASE WHEN mine AND o.v IS NULL THEN 'nothing overrides V::m' || f.v ELSE '' END AS note, CASE WHEN mine AND o.v IS NULL THEN 1 ELSE 3 END AS supported FROM f LEFT JOIN o USING (v)""")
def devirtualise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R9b."""
    k = F.col("o_orderkey")
    claims = F.array(S.claim("m", "p", True, S.CRITICAL),
        S.claim(f"{reduce.RECEIVER_EFFECT} beyond prediction", "p", False, S.CRITICAL, gating=True))
    call = F.when(k % 5 != 0, tagged("V::m", F.col("o_custkey") % 90))
    rows = finding_rows(orders(spark, sf_dir), k, rule=pick(("FL030", "FL031", "FL012"), k), suppressed=k % 7 == 0,
        evidence=evidence(virtual_call=call), claims=claims)
    over = table(spark, sf_dir, "customer").where("c_custkey % 61 < 40").select(tagged("V::m", F.col("c_custkey") % 61).alias("fn"))
    return reduce.devirtualise(rows, reduce.Facts(overridden=over)).select("ord", note().alias("note"), supported())


@query("""WITH u AS (SELECT p_partkey AS p, 4 * (1 + p_size % 17) AS es, 2 + p_partkey % 200 AS ec, p_partkey % 4 AS tier, p_partkey % 3 = 0 AS tls, p_partkey % 5 = 0 AS atomic, p_partkey % 7 = 0 AS head,
    p_partkey % 13 AS w1, (p_partkey * 3) % 11 AS w2, p_partkey % 2 = 0 AS two FROM part),
  w AS (SELECT *, CASE WHEN two AND w1 <> w2 THEN 2 ELSE 1 END AS nw, CASE WHEN w1 >= 9 OR (two AND w2 >= 9) THEN 0 WHEN two THEN (w1 % 3 + 1) | (w2 % 3 + 1) ELSE w1 % 3 + 1 END AS mask, CASE WHEN es < 64 THEN 64 // es ELSE 0 END AS slots FROM u),
  s AS (SELECT *, (ec * 64 - ec * es) / 32768.0 AS cost FROM w WHERE es % 64 <> 0 AND slots >= 2 AND mask <> 1),
  x AS (SELECT *, CASE WHEN tier = 3 AND NOT cost > 0.10 THEN 'full-pad' ELSE 'relocate-to-owner' END AS fix, mask = 3 AS dual, tls OR nw >= 2 OR atomic AS strong FROM s),
  g AS (SELECT *, CASE WHEN tier = 3 THEN CASE WHEN dual THEN 3 ELSE 2 END WHEN tier = 0 THEN CASE WHEN dual THEN 3 WHEN strong THEN 2 ELSE 1 END ELSE 1 END AS sev FROM x)
  SELECT 'a' || p AS symbol, fix, CAST(CASE WHEN head THEN least(sev, 1) ELSE sev END AS INTEGER) AS severity, CAST(CASE WHEN dual THEN 0.88 WHEN strong THEN CASE WHEN tls THEN 0.78 ELSE 0.72 END ELSE 0.55 END AS DOUBLE) AS confidence, CAST(CASE WHEN dual THEN 0 ELSE 1 END AS INTEGER) AS tier,
    CAST(CASE WHEN tier = 3 THEN 3 WHEN nw >= 2 OR tls THEN CASE WHEN dual THEN 3 ELSE 2 END ELSE 1 END AS INTEGER) AS supported, CAST(CAST(ceil(ec / slots) AS BIGINT) AS VARCHAR) AS lines, CAST(nw + 1 + CAST(head AS INTEGER) AS INTEGER) AS notes FROM g""")
def striped_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R10, with a second unit that sees another writer of every other array."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    flag = lambda n: k % n == 0
    columns = {
        "key": tagged("a", k), "name": tagged("a", k), "type": F.lit(""), "file": F.lit("s.cpp"), "line": k.cast("int"),
            "elem_size": (4 * (1 + F.col("p_size") % 17)).cast("bigint"), "elem_count": (2 + k % 200).cast("bigint"),
            "decl_align": F.lit(8).cast("bigint"),
        "atomic": flag(5), "volatile": F.lit(False), "static": F.lit(True), "tls": flag(3), "head_pad": flag(7),
            "writer_tier": (k % 4).cast("int"), "writers": F.array(tagged("w", k % 13)), "aggregators": F.array(F.lit("sweep")),
    }
    more = columns | {"tls": F.lit(False), "writer_tier": F.lit(0), "writers": F.array(tagged("w", (k * 3) % 11)),
        "aggregators": F.array().cast("array<string>")}
    one, two = p.select(*(v.alias(n) for n, v in columns.items())), p.where(k % 2 == 0).select(*(v.alias(n) for n, v in more.items()))
    roles = p.where("p_partkey < 9").select(tagged("w", "p_partkey").alias("fn"), (k % 3 + 1).cast("int").alias("mask"))
    f = reduce.Facts(striped=one.unionByName(two), signals=signals(spark, sf_dir))
    out = reduce.stripe_findings(f, roles)
    return out.select(reduce.ev("symbol").alias("symbol"), reduce.ev("fix_shape").alias("fix"), "severity", "confidence", "tier",
        supported(), reduce.ev("contended_lines").alias("lines"), F.size("escalations").alias("notes"))


@query("""SELECT o_orderkey AS ord, CAST(CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 4 WHEN o_orderkey % 3 = 0 THEN greatest(o_orderkey % 4 - 1, 0) WHEN o_orderkey % 3 = 1 THEN 0 ELSE o_orderkey % 4 END AS INTEGER) AS severity,
  CAST(CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 3 < 2 THEN 0.4 ELSE 0.5 END AS DOUBLE) AS confidence, CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 3 = 0 THEN 'placement is managed by the program' WHEN o_orderkey % 3 = 1 THEN 'paging is managed by the program' ELSE '' END AS note FROM orders""")
def policy_respect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R11."""
    k = F.col("o_orderkey")
    n = F.col("n_nationkey")
    edges = table(spark, sf_dir, "nation").select(F.lit("main").alias("src"),
        F.when(n == 3, "mbind").when(n == 5, "madvise").otherwise(F.col("n_name")).alias("dst"), F.lit(0).alias("loop_depth"))
    rows = finding_rows(orders(spark, sf_dir), k, rule=pick(("FL060", "FL070", "FL001"), k), severity=grade(), suppressed=k % 7 == 0)
    return reduce.policy_respect(rows, reduce.Facts(edges=edges)).select("ord", "severity", confidence(), note().alias("note"))


@query("""WITH f AS (SELECT event_id AS ord, event_id % 4 AS kind, 'p' || (event_id // 4 % 40) || '.h' AS file, CAST(event_id % 3 AS INTEGER) AS line, CAST(event_id % 5 AS INTEGER) AS col, CASE WHEN event_id % 4 = 2 THEN 'f' || user_id % 30 ELSE '' END AS fn, user_id % 20 AS u,
    round(value, 0) / 1000 AS confidence, CAST(event_id % 3 AS INTEGER) AS tier, CAST(event_id % 4 AS INTEGER) AS severity, event_type AS esc FROM events),
  k AS (SELECT *, CASE kind WHEN 0 THEN 's|FL001|' || file || '|' || line || '|T' || u WHEN 1 THEN 'v|FL040|g' || u || '|T' || u WHEN 2 THEN 'f|FL012|' || fn || '|' || line ELSE 'p|FL020|' || file || '|' || line || '|' || col END AS key FROM f),
  r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY confidence DESC, tier, length(file), file, line, col, fn, severity, ord) AS rn, count(*) OVER (PARTITION BY key) AS n, min(ord) OVER (PARTITION BY key) AS first FROM k),
  e AS (SELECT key, list(DISTINCT esc) AS es FROM k GROUP BY key)
  SELECT first AS ord, confidence, tier, severity, r.file, array_to_string(list_sort(CASE WHEN n = 1 THEN [esc] ELSE list_append(es, 'cross-TU: deduplicated from ' || n || ' translation unit(s)') END), '|') AS notes FROM r JOIN e USING (key) WHERE rn = 1""")
def deduplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R12, with evidence and notes alike within what ties on all before."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    kind, u = k % 4, F.col("user_id") % 20
    ev = evidence(type_name=F.when(kind == 0, tagged("T", u)), var=F.when(kind == 1, tagged("g", u)),
        type=F.when(kind == 1, tagged("T", u)))
    rows = finding_rows(
        e, k, rule=pick(("FL001", "FL040", "FL012", "FL020"), k), file=F.concat(tagged("p", F.floor(k / 4) % 40), F.lit(".h")), line=k % 3,
            col=k % 5, fn=F.when(kind == 2, tagged("f", F.col("user_id") % 30)).otherwise(""),
        confidence=F.round("value", 0) / 1000, tier=k % 3, severity=k % 4, evidence=ev, title=F.lpad(text_of(k), 12, "0"),
            escalations=F.array(F.col("event_type")),
    )
    return reduce.deduplicate(rows).select("ord", "confidence", "tier", "severity", "file", F.array_join("escalations", "|").alias("notes"))


@query("""WITH c(rule, cls) AS (VALUES ('FL001', 'CacheGeometry'), ('FL011', 'AtomicContention'), ('FL002', 'FalseSharing'), ('FL010', 'AtomicOrdering'), ('FL060', 'NUMALocality'), ('FL012', 'LockContention'), ('FL020', 'HeapAllocation')),
  f AS (SELECT event_id AS ord, (['FL001', 'FL011', 'FL002', 'FL010', 'FL060', 'FL012', 'FL020'])[event_id % 7 + 1] AS rule, 'p' || (user_id % 150) || ':' || (1 + event_id // 7 % 3) AS site, round(value, 0) / 1000 AS conf, CAST(event_id % 4 AS INTEGER) AS sev, CAST(event_id % 3 AS INTEGER) AS tier FROM events WHERE event_id % 11 <> 0),
  b AS (SELECT * EXCLUDE (rn) FROM (SELECT f.*, cls, row_number() OVER (PARTITION BY site, cls ORDER BY conf DESC, ord) AS rn FROM f JOIN c USING (rule)) WHERE rn = 1),
  t(ident, x, y) AS (VALUES ('IX-001', 'CacheGeometry', 'AtomicContention'), ('IX-002', 'FalseSharing', 'AtomicContention'), ('IX-003', 'AtomicOrdering', 'AtomicContention'), ('IX-004', 'AtomicContention', 'NUMALocality'), ('IX-005', 'LockContention', 'HeapAllocation'))
  SELECT ident AS template, CASE WHEN a.ord < z.ord THEN a.rule || '+' || z.rule ELSE z.rule || '+' || a.rule END AS components, a.site, greatest(a.sev, z.sev) AS severity, round(least(1.0, least(a.conf, z.conf) * 1.2), 6) AS confidence, least(a.tier, z.tier) AS tier
    FROM t JOIN b a ON a.cls = x JOIN b z ON z.cls = y AND z.site = a.site
  UNION ALL SELECT 'IX-007', 'FL001+FL011+FL060', a.site, 3, round(least(1.0, least(a.conf, y.conf, z.conf) * 1.2), 6), least(a.tier, y.tier, z.tier) FROM b a JOIN b y ON a.site = y.site AND y.rule = 'FL011' JOIN b z ON a.site = z.site AND z.rule = 'FL060' WHERE a.rule = 'FL001'""")
def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R13."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    rows = finding_rows(
        e, k, rule=pick(("FL001", "FL011", "FL002", "FL010", "FL060", "FL012", "FL020"), k), file=tagged("p", F.col("user_id") % 150),
            line=1 + F.floor(k / 7) % 3, confidence=F.round("value", 0) / 1000, severity=k % 4, tier=k % 3, suppressed=k % 11 == 0,
    )
    out = reduce.interactions(rows)
    return out.select(reduce.ev("interaction").alias("template"), reduce.ev("components").alias("components"),
        reduce.ev("site").alias("site"), "severity", confidence(), "tier")


@query("""WITH l AS (SELECT 'C' || c_custkey AS type FROM customer WHERE c_custkey % 11 = 0),
  f AS (SELECT o_orderkey AS ord, 'C' || o_custkey AS type, CAST(o_orderkey % 4 AS INTEGER) AS severity FROM orders WHERE o_orderkey % 3 > 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 5 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY ord) AS rn FROM f WHERE type NOT IN (SELECT type FROM l))
  SELECT type, severity, (SELECT min(type) FROM l) AS exemplar, (SELECT CAST(count(*) AS VARCHAR) FROM l) AS n FROM r WHERE rn = 1""")
def precedent_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R14."""
    k = F.col("o_orderkey")
    told = F.when(k % 5 == 0, F.array(F.lit("other"), F.lit(f"{reduce.ROLES_NOTE}: a by main, b by worker"))).otherwise(F
        .array(F.lit("other")))
    rows = finding_rows(orders(spark, sf_dir), k, rule=pick(("FL001", "FL002", "FL090"), k), severity=grade(), suppressed=k % 7 == 0,
        evidence=evidence(type_name=tagged("C", "o_custkey")), escalations=told)
    out = reduce.precedents(rows, reduce.Facts(signals=signals(spark, sf_dir)))
    return out.select(reduce.ev("type_name").alias("type"), "severity", reduce.ev("mitigated_exemplar").alias("exemplar"),
        reduce.ev("mitigated_type_count").alias("n"))


@query("""WITH p(rule, most, lo, cap) AS (VALUES ('FL001', 0, 0.40, 3), ('FL002', 0, 0.50, 3), ('FL011', 50, 0.45, 3), ('FL020', 100, 0.40, 3), ('FL021', 30, 0.35, 2), ('FL050', 20, 0.30, 2), ('FL061', 20, 0.40, 2)),
  f AS (SELECT event_id AS ord, (['FL001', 'FL002', 'FL011', 'FL020', 'FL021', 'FL050', 'FL061', 'FL999'])[event_id % 8 + 1] AS rule, round(value, 0) / 100 AS conf, CAST(event_id // 8 % 4 AS INTEGER) AS sev, event_id % 13 = 0 AS gone FROM events),
  j AS (SELECT f.*, most, cap, coalesce(conf < lo AND NOT gone, false) AS low FROM f LEFT JOIN p USING (rule)),
  r AS (SELECT *, coalesce(most > 0 AND NOT low, false) AS counted, sum(CASE WHEN coalesce(most > 0 AND NOT low, false) THEN 1 ELSE 0 END) OVER (PARTITION BY rule ORDER BY ord) AS run FROM j),
  x AS (SELECT *, coalesce(counted AND run > most, false) AS over, NOT low AND coalesce(sev > cap, false) AS high FROM r)
  SELECT ord, CAST(CASE WHEN over THEN 0 WHEN high THEN cap ELSE sev END AS INTEGER) AS severity, gone OR low AS suppressed, CAST(CAST(low AS INTEGER) + CAST(high AS INTEGER) + CAST(over AS INTEGER) AS INTEGER) AS notes FROM x""")
def precision_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R15."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    rows = finding_rows(e, k, rule=pick(("FL001", "FL002", "FL011", "FL020", "FL021", "FL050", "FL061", "FL999"), k),
        confidence=F.round("value", 0) / 100, severity=F.floor(k / 8) % 4, suppressed=k % 13 == 0)
    return reduce.precision_budget(rows).select("ord", "severity", "suppressed", F.size("escalations").alias("notes"))


@query("""WITH f AS (SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 3 = 0 THEN 'CacheGeometry' WHEN o_orderkey % 3 = 1 THEN 'FalseSharing' ELSE 'LockContention' END AS cls, o_orderkey % 4 AS sev, o_orderkey % 5 AS tier, o_orderkey % 10 / 10.0 AS conf, o_custkey AS size FROM orders),
  r AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'CacheGeometry' ELSE 'FalseSharing' END AS cls, p_partkey % 4 AS sev, p_partkey % 7 / 10.0 AS conf, p_partkey AS size FROM part WHERE p_partkey % 6 >= 3)
  SELECT ord FROM f WHERE (sev >= 2 AND tier = 0) OR NOT EXISTS (SELECT 1 FROM r WHERE r.cls = f.cls AND r.sev = f.sev AND r.size = f.size AND abs(r.conf - f.conf) <= 0.25)""")
def calibration_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R16."""
    k, p = F.col("o_orderkey"), F.col("p_partkey")
    rows = finding_rows(orders(spark, sf_dir), k, rule=pick(("FL001", "FL002", "FL012"), k), severity=grade(),
        tier=F.when(k % 5 == 0, S.PROVEN).otherwise(S.LIKELY), confidence=k % 10 / 10.0,
        evidence=evidence(sizeof=F.concat(text_of("o_custkey"), F.lit("B"))))
    zero = [F.lit(0.0)] * 6
    registry = table(spark, sf_dir, "part").select(F.when(p % 2 == 0, "CacheGeometry").otherwise("FalseSharing").alias("cls"),
        F.array((p % 4).cast("double"), p % 7 / 10.0, F.lit(0.0), p.cast("double"), *zero).alias("features"), (p % 6).alias("refutations"))
    return reduce.calibration_suppression(rows, registry).select("ord")


@query("""WITH p AS (SELECT CASE l_linenumber WHEN 1 THEN 'CacheGeometry' WHEN 2 THEN 'FalseSharing' ELSE 'LockContention' END AS cls, count(*) AS n, (count(*) FILTER (WHERE l_quantity > 20) + 1) / (count(*) + 2) AS prior FROM lineitem WHERE l_linenumber <= 3 AND l_orderkey % 997 = 0 GROUP BY 1),
  f AS (SELECT o_orderkey AS ord, (['CacheGeometry', 'FalseSharing', 'LockContention', 'HeapAllocation'])[o_orderkey % 4 + 1] AS cls, o_orderkey % 10 / 10.0 AS c FROM orders)
  SELECT ord, round(CAST(CASE WHEN n IS NULL THEN c ELSE greatest(0.05, least(0.99, c * (1 - least(1.0, n / 50)) + prior * least(1.0, n / 50))) END AS DOUBLE), 6) AS confidence FROM f LEFT JOIN p USING (cls)""")
def blended_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R17."""
    k = F.col("o_orderkey")
    li = table(spark, sf_dir, "lineitem").where("l_linenumber <= 3 AND l_orderkey % 997 = 0").withColumn("cls",
        F.when(F.col("l_linenumber") == 1, "CacheGeometry").when(F.col("l_linenumber") == 2, "FalseSharing").otherwise("LockContention"))
    priors = feedback.updated_priors(li.select("cls", F.when(F.col("l_quantity") > 20, "Positive").otherwise("Negative").alias("verdict")))
    rows = finding_rows(orders(spark, sf_dir), k, rule=pick(("FL001", "FL002", "FL012", "FL020"), k), confidence=k % 10 / 10.0)
    return reduce.blended_confidence(rows, priors).select("ord", confidence())


@query("""WITH t AS (SELECT event_id AS id, 'f' || user_id AS fn, CASE WHEN event_id % 2 = 0 THEN 'p' || (event_id % 900) || '.c' ELSE '' END AS file, event_id % 3 AS line FROM events),
  f AS (SELECT o_orderkey AS ord, (['CacheGeometry', 'FalseSharing', 'LockContention'])[o_orderkey % 3 + 1] AS cls, CASE WHEN o_orderkey % 4 = 0 THEN 'f' || o_custkey ELSE '' END AS fn, 'p' || o_custkey || '.c' AS file, o_orderkey % 3 AS line FROM orders),
  m AS (SELECT id, ord, cls FROM t JOIN f ON t.fn = f.fn WHERE f.fn <> '' UNION ALL SELECT id, ord, cls FROM t JOIN f ON t.file = f.file AND t.line = f.line WHERE t.file <> '')
  SELECT id, arg_min(cls, ord) AS cls FROM m GROUP BY id""")
def match_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of traces to the classes of findings."""
    k, e = F.col("o_orderkey"), F.col("event_id")
    rows = finding_rows(orders(spark, sf_dir), k, rule=pick(("FL001", "FL002", "FL012"), k),
        fn=F.when(k % 4 == 0, tagged("f", "o_custkey")).otherwise(""), file=F.concat(tagged("p", "o_custkey"), F.lit(".c")), line=k % 3)
    traces = table(spark, sf_dir, "events").select(e.alias("id"), tagged("f", "user_id").alias("fn"),
        F.when(e % 2 == 0, F.concat(tagged("p", e % 900), F.lit(".c"))).otherwise("").alias("file"), (e % 3).cast("int").alias("line"))
    return reduce.match_traces(rows, traces).select("id", "cls")


@query("""WITH m AS (SELECT event_id, (['CacheGeometry', 'AtomicOrdering', 'LockContention'])[event_id % 3 + 1] AS cls, value * 200 AS r FROM events),
  v AS (SELECT cls, CASE WHEN cls = 'CacheGeometry' THEN CASE WHEN r >= 10000 THEN 'P' WHEN r <= 100 THEN 'N' ELSE 'U' END WHEN cls = 'AtomicOrdering' THEN CASE WHEN r >= 1000 THEN 'P' WHEN r <= 10 THEN 'N' ELSE 'U' END ELSE CASE WHEN r >= 5000 THEN 'P' WHEN r <= 50 THEN 'N' ELSE 'U' END END AS v FROM m)
  SELECT cls, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE v = 'P') AS BIGINT) AS confirmed, CAST(count(*) FILTER (WHERE v = 'N') AS BIGINT) AS refuted, round((count(*) FILTER (WHERE v = 'P') + 1) / (count(*) + 2), 6) AS prior,
    round(count(*) FILTER (WHERE v = 'P') / count(*), 6) AS tpr, round(count(*) FILTER (WHERE v = 'N') / count(*), 6) AS fpr FROM v GROUP BY 1""")
def trace_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of trace records vote, verdicts move priors."""
    e = F.col("event_id")
    rules, counters = ("FL001", "FL010", "FL012"), ("MEM_LOAD_RETIRED.L3_MISS", "MEM_INST_RETIRED.LOCK_LOADS",
        "MEM_INST_RETIRED.LOCK_LOADS")
    rows = finding_rows(spark.range(3), F.col("id"), rule=pick(rules, F.col("id")), fn=pick(("f0", "f1", "f2"), F.col("id")))
    trace = table(spark, sf_dir, "events").select(text_of(e).alias("record"), tagged("f", e % 3).alias("fn"), F.lit("").alias("file"),
        F.lit(0).alias("line"), pick(counters, e).alias("counter"), (F.col("value") * 400).alias("value"),
        F.lit(2_000_000_000).alias("duration_ns"))
    out = feedback.updated_priors(feedback.trace_verdicts(rows, trace))
    return out.select("cls", "n", "confirmed", "refuted", *(F.round(c, 6).alias(c) for c in ("prior", "tpr", "fpr")))


@query("""WITH c AS (SELECT l_orderkey, l_discount > 0.04 AS established, l_returnflag = 'R' AS gating, CAST(l_quantity AS INTEGER) % 4 AS supports FROM lineitem),
  g AS (SELECT l_orderkey, max(supports) FILTER (WHERE established AND NOT gating) AS own, min(supports) FILTER (WHERE gating) AS cap, count(*) FILTER (WHERE NOT gating) AS n FROM c GROUP BY 1)
  SELECT l_orderkey, CAST(CASE WHEN n = 0 THEN cap ELSE least(coalesce(own, 0), coalesce(cap, 3)) END AS INTEGER) AS ceiling FROM g""")
def claim_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an order's claims, one a line, justify."""
    claim = F.struct(F.lit("e").alias("effect"), F.lit("p").alias("precondition"), (F.col("l_discount") > 0.04).alias("established"),
        (F.col("l_quantity").cast("int") % 4).alias("supports"), (F.col("l_returnflag") == "R").alias("gating"))
    c = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(claim).alias("claims"))
    return c.select("l_orderkey", S.supported_severity(F.col("claims")).alias("ceiling"))


_LINES = """SELECT (['FL001', 'FL002', 'FL011', 'FL012', 'FL020', 'FL060'])[(ascii(l_returnflag) + ascii(l_linestatus)) % 6 + 1] AS rule, CAST(l_linenumber % 4 AS INTEGER) AS severity, round(0.3 + l_quantity / 100, 4) AS confidence, CAST(l_suppkey % 3 AS INTEGER) AS tier, 'src/p' || l_partkey AS file,
  l_linenumber AS line, 'sizeof=' || CAST(l_quantity AS VARCHAR) || 'B; thread_escape=' || CASE WHEN l_tax > 0.02 THEN 'true' ELSE 'false' END || '; type_name=S' || l_suppkey AS ev, 'order ' || l_orderkey AS esc FROM lineitem"""


@query(f"""SELECT rule, file, line, severity, CAST(row_number() OVER (ORDER BY rule, file, line, severity, confidence, tier, ev, esc) AS BIGINT) AS ord FROM ({_LINES})""")
def canonical_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1."""
    return reduce.canonical(lineitem_findings(spark, sf_dir)).select("rule", "file", "line", "severity", "ord")


@query(f"""SELECT rule, file, line, severity, CAST(row_number() OVER (ORDER BY severity DESC, file, line, rule, confidence, tier, ev, esc) AS BIGINT) AS ord FROM ({_LINES})""")
def output_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R19."""
    return ranking.ordinal(lineitem_findings(spark, sf_dir), reduce.output_order(), columns=["rule", "file", "line", "severity"])


@query("""SELECT regexp_extract(html, 'lang="([^"]*)"', 1) || '.h' AS fingerprint, CAST(count(*) AS BIGINT) AS n FROM pages WHERE regexp_matches(html, 'lang="([^"]+)"') GROUP BY 1 HAVING count(*) >= 3""")
def header_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages stand for units that miss a header each."""
    failures = table(spark, sf_dir, "pages").select(text_of("page_id").alias("file"),
        F.concat(F.lit("x.c:1: fatal error: '"), F.regexp_extract("html", 'lang="([^"]*)"', 1), F.lit(".h' file not found")).alias("error"))
    failures = failures.where("error NOT LIKE '%''.h''%'")
    return reduce.missing_headers(failures).select(reduce.ev("missing_header").alias("fingerprint"),
        reduce.ev("tu_count").cast("bigint").alias("n"))


@query("""SELECT CAST(CASE WHEN count(*) FILTER (WHERE o_orderkey % 9 > 5) > 0 THEN 1 ELSE 2 END AS INTEGER) AS status, CAST(count(*) FILTER (WHERE o_orderkey % 9 > 5) AS BIGINT) AS findings FROM orders""")
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R21 over what the final filter (P4) leaves."""
    rows = finding_rows(orders(spark, sf_dir), F.col("o_orderkey"), suppressed=F.col("o_orderkey") % 9 <= 5)
    n = reduce.final_filter(rows).count()
    return spark.createDataFrame([(reduce.status(n, 1), n)], "status int, findings bigint")


@query("""SELECT o_orderkey AS ord FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 4 >= 2 AND o_orderkey % 3 <= 1 AND o_orderkey % 6 <> 2""")
def final_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4 and P5."""
    k = F.col("o_orderkey")
    rows = finding_rows(orders(spark, sf_dir), k, rule=pick(("FL001", "FL002", "FL050", "FL010", "FL011", "FL012"), k), severity=grade(),
        tier=k % 3, suppressed=k % 5 == 0)
    return reduce.final_filter(rows, S.HIGH, S.LIKELY, ["FL050"]).select("ord")


@query("""WITH m AS (SELECT l_suppkey AS s, l_linenumber + d AS line, CASE l_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'FL001' ELSE 'FL002,FL012' END AS ids FROM lineitem, (VALUES (0), (1)) t(d) WHERE l_partkey % 50 = 0),
  g AS (SELECT s, line, bool_or(ids IS NULL) AS bare, coalesce(string_agg(ids, ','), '') AS ids FROM m GROUP BY 1, 2),
  f AS (SELECT o_orderkey AS ord, (['FL001', 'FL002', 'FL012', 'FL020'])[o_orderkey % 4 + 1] AS rule, o_custkey % 100 AS s, 1 + o_orderkey % 8 AS line FROM orders)
  SELECT ord, coalesce(bare OR contains(',' || ids || ',', ',' || rule || ','), false) AS suppressed FROM f LEFT JOIN g USING (s, line)""")
def inline_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6."""
    k, li = F.col("o_orderkey"), table(spark, sf_dir, "lineitem")
    mark = F.when(F.col("l_orderkey") % 3 == 0, "x; // hazard-suppress").when(F.col("l_orderkey") % 3 == 1,
        "/* hazard-suppress FL001 */").otherwise("// hazard-suppress FL002, FL012")
    lines = li.select(tagged("s", "l_suppkey").alias("file"), F.col("l_linenumber").alias("line"),
        F.when(F.col("l_partkey") % 50 == 0, mark).otherwise("code();").alias("text"))
    rows = finding_rows(orders(spark, sf_dir), k, rule=pick(("FL001", "FL002", "FL012", "FL020"), k),
        file=tagged("s", F.col("o_custkey") % 100), line=1 + k % 8)
    return reduce.inline_suppression(rows, lines).select("ord", "suppressed")


@query("""SELECT o_orderkey AS ord, o_orderkey % 7 = 0 OR o_orderkey % 3 <> 0 AS suppressed FROM orders""")
def out_of_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files inside, outside, and beside the root."""
    k = F.col("o_orderkey")
    rows = finding_rows(orders(spark, sf_dir), k, file=F.concat(pick(("/src/app/", "/usr/include/", "/src/apple/"), k), text_of(k)),
        suppressed=k % 7 == 0)
    return reduce.out_of_tree(rows, "/src/app/").select("ord", "suppressed")


@query("""SELECT page_id, url FROM pages WHERE url IS NOT NULL AND (ends_with(url, '5?page=2&ref=x') OR ends_with(url, 'en/25#top') OR ends_with(url, '/en/685'))""")
def incremental_restriction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units whose path ends with a changed one."""
    changed = spark.createDataFrame([("5?page=2&ref=x",), ("en/25#top",), ("/en/685",), ("",)], "changed string")
    return joins.source_filter(table(spark, sf_dir, "pages").where("url IS NOT NULL").select("page_id", "url"), "url", "page_id",
        changed=changed)


@query("""SELECT event_id, CAST(event_id % 4 AS DOUBLE) AS severity, round(value / 1000, 6) AS confidence, CAST(event_id % 3 AS DOUBLE) AS notes, round(value, 2) AS size, CAST(user_id AS DOUBLE) AS depth, CAST(0 AS DOUBLE) AS callees,
  (['CacheGeometry', 'LockContention', NULL, 'SynthesizedInteraction'])[event_id % 4 + 1] AS cls, CAST(CASE WHEN event_id % 5 < 3 THEN CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END WHEN event_id % 5 = 3 THEN 0 ELSE 2 END AS INTEGER) AS tier FROM events""")
def finding_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9, P10 and P11."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    ev = evidence(sizeof=F.when(k % 5 < 3, F.concat(text_of(F.round("value", 2)), F.lit("B"))), ordering=F.when(k % 5 == 3, "seq_cst"),
        thread_escape=F.when(k % 2 == 0, "true"), depth=F.col("user_id"), callees=F.lit("n/a"))
    notes = F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), (k % 3).cast("int"))
    rows = finding_rows(e, k, rule=pick(("FL001", "FL012", "FL070", "FL091"), k), severity=k % 4, confidence=F.col("value") / 1000,
        escalations=notes, evidence=ev)
    f = rows.withColumn("f", reduce.features())
    x = lambda i: F.get("f", F.lit(i))
    size = F.when(k % 5 < 3, x(3)).otherwise(F.round("value", 2))  # no size: as in the table
    out = f.withColumnRenamed("ord", "event_id").join(e.select("event_id", "value"), "event_id")
    return out.select("event_id", x(0).alias("severity"), F.round(x(1), 6).alias("confidence"), x(2).alias("notes"),
        F.round(size, 2).alias("size"), x(8).alias("depth"), x(9).alias("callees"), reduce.hazard_class().alias("cls"),
        reduce.inferred_tier().alias("tier"))


_KEYED = """SELECT 'FL001' AS rule, p, e, CASE WHEN e = '' THEN line END AS line FROM (SELECT url AS p, CASE page_id % 3 WHEN 0 THEN 'T' || page_id % 10 WHEN 1 THEN 'fn' ELSE '' END AS e, CAST(page_id % 7 AS INTEGER) AS line FROM pages WHERE url IS NOT NULL AND {keep})"""


@query(f"""WITH a AS ({_KEYED.format(keep='page_id % 5 <> 0')}), b AS ({_KEYED.format(keep='page_id % 7 <> 0')})
  SELECT p AS path, e AS entity, line AS "at", 'new' AS change FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) UNION ALL SELECT p, e, line, 'resolved' FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)""")
def finding_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The diff of two results; paths would lose the folders that all share, here none."""
    k = F.col("page_id")
    p = table(spark, sf_dir, "pages").where("url IS NOT NULL")
    rows = lambda d: finding_rows(d, k, file=F.col("url"), line=k % 7, fn=F.when(k % 3 == 1, "fn").otherwise(""),
        evidence=evidence(type_name=F.when(k % 3 == 0, tagged("T", k % 10))))
    return feedback.diff(rows(p.where("page_id % 5 <> 0")), rows(p.where("page_id % 7 <> 0"))).select("path", "entity", "at", "change")


@query("""WITH u AS (SELECT page_id, 'lib/' || split_part(url, '://', 2) AS path FROM pages WHERE url IS NOT NULL), c AS (SELECT min(path) AS lo, max(path) AS hi FROM u),
  n AS (SELECT coalesce(max(k), 0) AS k FROM c, range(1, 400) t(k) WHERE k <= least(length(lo), length(hi)) AND left(lo, CAST(k AS INTEGER)) = left(hi, CAST(k AS INTEGER)) AND substr(lo, CAST(k AS INTEGER), 1) = '/')
  SELECT page_id, substr(path, CAST((SELECT k FROM n) + 1 AS INTEGER)) AS rest FROM u""")
def path_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of all pages without the folders that all share."""
    p = table(spark, sf_dir, "pages").where("url IS NOT NULL").select("page_id",
        F.concat(F.lit("lib/"), F.get(F.split("url", "://"), F.lit(1))).alias("path"))
    return setdiff.without_common_prefix(p, "path", "rest").select("page_id", "rest")


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, 'FL001' AS rule, CAST(event_id % 4 AS INTEGER) AS severity, event_type AS type_name FROM events""")
def json_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings written as unit records with short keys, one file of lines, and read again."""
    from strideway import storage

    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    rows = finding_rows(e, k, severity=k % 4, title=text_of(k), line=F.get_json_object("props", "$.k").cast("int"),
        evidence=evidence(type_name=F.col("event_type"))).withColumn("src", tagged("u", F.col("ord") % 50))
    path = storage.place(spark, "records")
    readers.write_shards(readers.records_of(rows, {}), path)
    records, _ = readers.shards(spark, path)
    return readers.findings_of(records).select(F.col("title").cast("bigint").alias("event_id"), F.col("line").alias("k"), "rule",
        "severity", reduce.ev("type_name").alias("type_name"))


@query("""WITH s AS (SELECT 's' || user_id AS symbol, sum(CAST(round(value * 100) AS BIGINT)) AS w FROM events GROUP BY 1), top AS (SELECT symbol, w, row_number() OVER (ORDER BY w DESC, symbol || '+0x1@x') AS rn FROM s), f AS (SELECT DISTINCT 's' || o_custkey AS symbol FROM orders WHERE o_orderkey % 40 = 0 UNION SELECT 's' || (o_custkey + 3) FROM orders WHERE o_orderkey % 60 = 0)
  SELECT top.symbol, CAST(w AS BIGINT) AS weight, f.symbol IS NOT NULL AS found FROM top LEFT JOIN f USING (symbol) WHERE rn <= 40""")
def symbol_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured symbols that findings name, the 40 heaviest."""
    k = F.col("o_orderkey")
    hot = table(spark, sf_dir, "events").select(F.concat(tagged("s", "user_id"), F.lit("+0x1@x")).alias("symbol"),
        F.round(F.col("value") * 100).cast("bigint").alias("weight"))
    rows = finding_rows(orders(spark, sf_dir), k, fn=F.when(k % 40 == 0, F.concat(F.lit("ns::"), tagged("s", "o_custkey"))).otherwise(""),
        evidence=evidence(var=F.when(k % 60 == 0, tagged("a::s", F.col("o_custkey") + 3))))
    return joins.symbol_recall(hot, rows)


@query("""WITH p AS (SELECT CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_custkey END AS key FROM orders WHERE o_orderpriority = '1-URGENT'), q AS (SELECT DISTINCT key FROM p WHERE key IS NOT NULL),
  o AS (SELECT l_partkey AS key, bool_or(l_quantity >= 49) AS hit FROM lineitem GROUP BY 1)
  SELECT key, CASE WHEN q.key IS NOT NULL AND hit THEN 'CONFIRMED' WHEN q.key IS NOT NULL AND NOT hit THEN 'REFUTED' WHEN q.key IS NOT NULL THEN 'UNOBSERVED' ELSE 'MISSED' END AS verdict FROM q FULL JOIN o USING (key) WHERE q.key IS NOT NULL OR hit
  UNION ALL SELECT NULL, 'NO-GLOBAL-INSTANCE' FROM p WHERE key IS NULL""")
def instance_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions against observations, some of them without an instance that could be seen."""
    k = F.col("o_orderkey")
    p = orders(spark, sf_dir).where("o_orderpriority = '1-URGENT'").select(F.when(k % 9 != 0, F.col("o_custkey")).alias("key"))
    return joins.verdicts(p, table(spark, sf_dir, "lineitem")
        .select(F.col("l_partkey").alias("key"), (F.col("l_quantity") >= 49).alias("hit")), ["key"])


@query("""SELECT p_partkey, CAST(k AS INTEGER) AS line_index FROM (SELECT p_partkey, o // 64 AS first, (o + CASE WHEN al >= 64 THEN 0 ELSE 64 - al END + p_size * 8 - 1) // 64 AS last FROM (SELECT p_partkey, p_size, p_partkey * p_size % 512 AS o, 1 << CAST(p_partkey % 8 AS INTEGER) AS al FROM part)), range(0, 60) t(k) WHERE k BETWEEN first AND last AND k < 9""")
def line_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G6."""
    f = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * F.col("p_size") % 512).alias("offset"),
        (F.col("p_size") * 8).alias("size"), F.expr("shiftleft(1, cast(p_partkey % 8 as int))").alias("align"), F.lit(9).alias("most"))
    return layout.buckets(f, ["p_partkey"], 64, "most").select("p_partkey", "line_index")


@query("""WITH f AS (SELECT p_partkey, p_partkey * p_size % 512 AS o, 1 << CAST(p_size % 8 AS INTEGER) AS g, 1 << CAST(p_partkey % 8 AS INTEGER) AS al, p_size * 4 AS n FROM part),
  s AS (SELECT *, CASE WHEN al >= 64 THEN [0] ELSE range(0, 64, al) END AS shifts, range(0, greatest(n // g, 1)) AS es FROM f)
  SELECT p_partkey, g > 1 AND g <= 64 AND list_bool_or(list_transform(shifts, lambda s: list_bool_or(list_transform(es, lambda e: (o + s + e * g) % 64 + g > 64)))) AS split FROM s""")
def split_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G5."""
    f = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * F.col("p_size") % 512).alias("o"),
        F.expr("shiftleft(1, p_size % 8)").alias("g"), F.expr("shiftleft(1, cast(p_partkey % 8 as int))").alias("al"),
        (F.col("p_size") * 4).alias("n"))
    return f.select("p_partkey", layout.splits(F.col("o"), F.col("n"), F.col("g"), F.col("al"), 64).alias("split"))


@query("""SELECT page_id, url FROM (SELECT *, row_number() OVER (ORDER BY page_id) AS rn FROM pages WHERE url IS NOT NULL AND (regexp_matches(url, '/en/') OR regexp_matches(url, '/de/')) AND NOT regexp_matches(url, '[?]page=2')) WHERE rn <= 20""")
def source_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Include and exclude globs, vendored folders left alone as something is included, and the first N."""
    p = table(spark, sf_dir, "pages").where("url IS NOT NULL").select("page_id", "url")
    return joins.source_filter(p, "url", "page_id", include=["*/en/*", "*/de/*"], exclude=["*[?]page=2*"], vendored=["*/en/*"], most=20)


@query("""SELECT page_id, url FROM pages WHERE url IS NOT NULL AND NOT regexp_matches(url, '/en/') AND NOT regexp_matches(url, '^https://')""")
def vendored_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendored folders are left out where nothing is included by name."""
    p = table(spark, sf_dir, "pages").where("url IS NOT NULL").select("page_id", "url")
    return joins.source_filter(p, "url", "page_id", vendored=["*/en/*", "https://*"])


@query("""WITH s AS (SELECT l_orderkey, list({'i': l_linenumber, 'x': l_quantity} ORDER BY l_linenumber, l_quantity, l_partkey) AS v FROM lineitem GROUP BY 1),
  e AS (SELECT l_orderkey, list_transform(range(1, len(v) + 1), lambda k: {'at': k - 1, 'x': v[k].x}) AS v FROM s)
  SELECT l_orderkey, CAST(list_reduce(v, lambda a, b: CASE WHEN b.x > a.x * 1.1 THEN b ELSE a END).at AS INTEGER) AS elected FROM e""")
def election(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of an order's lines the one that is elected by quantity."""
    from strideway.operators import stats

    line = F.struct("l_linenumber", "l_quantity", "l_partkey")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("v"))
    return lines.select("l_orderkey", stats.elected(F.transform("v", lambda x: x["l_quantity"])).alias("elected"))
