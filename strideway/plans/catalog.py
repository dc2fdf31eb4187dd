"""The operators applied to the star-schema tables, each with DuckDB SQL for the same rows.

The tables stand in for facts: a query shows an operator over a whole table, its oracle says what it must return.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideway import schemas as S
from strideway.functions import text, time
from strideway.operators import graph, joins, layout, merge, ranking, setdiff, stats
from strideway.plans import catalog_facts, reduce
from strideway.plans.registry import ORACLES, QUERIES, query, table  # noqa: F401
from strideway.streaming import watch

LINE_COLUMNS = "l_discount l_extendedprice l_linenumber l_linestatus l_orderkey l_partkey l_quantity l_returnflag l_shipdate l_suppkey l_tax".split()


@query(f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_discount DESC, {', '.join(LINE_COLUMNS)}) AS rn FROM lineitem) WHERE rn = 1""")
def survivor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return ranking.survivors(li, ["l_partkey", "l_returnflag"], [F.col("l_discount").desc(), *map(F.col, LINE_COLUMNS)])


@query("""SELECT o_orderkey, o_orderpriority, running, running > 50 AS demoted FROM (
  SELECT o_orderkey, o_orderpriority, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS running FROM orders)""")
def running_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    out = ranking.running_budget(o, ["o_orderpriority"], [F.col("o_orderdate"), F.col("o_orderkey")], 50)
    return out.select("o_orderkey", "o_orderpriority", "running", "demoted")


@query("""SELECT user_id, bool_or(event_type = 'purchase') AS buys, bool_or(event_type = 'error') AS errs, CAST(count(*) AS BIGINT) AS n,
  max(value) AS top, max(event_id) AS last_id FROM events GROUP BY user_id""")
def signal_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", (F.col("event_type") == "purchase").alias("buys"),
        (F.col("event_type") == "error").alias("errs"), F.lit(1).alias("n"), F.col("value").alias("top"),
        F.col("event_id").alias("last_id"))
    return merge.merge_facts(e, ["user_id"], any_of=["buys", "errs"], sums=["n"], maxes=["top", "last_id"])


@query("""SELECT user_id, arg_min(event_type, event_id) FILTER (WHERE event_type <> 'view') AS event_type, arg_min(value, event_id) AS value FROM events GROUP BY user_id""")
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("event_type", F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")))
    return merge.first_wins(e.select("user_id", "event_type", "value", "event_id"), ["user_id"], ["event_type", "value"], "event_id")


@query("""SELECT o_custkey, o_totalprice, o_orderkey FROM (SELECT o_custkey, o_totalprice, o_orderkey,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def keep_greatest(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderkey")
    return merge.keep_greatest(o, ["o_custkey"], "o_totalprice", "o_orderkey")


@query("""SELECT user_id, CAST(count(*) AS BIGINT) AS weight, round(100.0 * count(*) / (SELECT count(*) FROM events), 6) AS pct
  FROM events GROUP BY user_id HAVING 100.0 * count(*) / (SELECT count(*) FROM events) >= 0.7""")
def share_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.share_filter(table(spark, sf_dir, "events"), ["user_id"], F.lit(1), 0.7)
    return out.withColumn("pct", F.round("pct", 6))


@query("""SELECT o_orderkey, CAST(row_number() OVER (ORDER BY CAST(left(o_orderpriority, 1) AS INTEGER), o_orderdate, o_orderkey) AS BIGINT) AS ord FROM orders""")
def canonical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.substring("o_orderpriority", 1, 1).cast("int").alias("grade"))
    return ranking.ordinal(o, [F.col("grade"), F.col("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", "ord")


@query("""SELECT o_orderkey, 'no line item' AS reason FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def coverage_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return merge.unaccounted(table(spark, sf_dir, "orders"), lines, ["o_orderkey"], "no line item")


@query("""WITH k(token, flag) AS (VALUES ('red', true), ('blue', false), ('ring', false), ('bolt', true)),
  t AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS token FROM part)
  SELECT p_partkey, CAST(count(flag) AS BIGINT) AS known, bool_or(flag) AS shared FROM t LEFT JOIN k USING (token) GROUP BY p_partkey""")
def exploded_any_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("red", True), ("blue", False), ("ring", False), ("bolt", True)], "token string, flag boolean")
    return joins.any_shared(table(spark, sf_dir, "part"), ["p_partkey"], "p_name", " ", F.broadcast(known), "token", "flag")


@query("""SELECT page_id, pattern FROM pages, (VALUES ('secure', '^https://.*$'), ('english', '^.*/en/.*$'), ('blog', '^https?://blog\\..*$')) p(pattern, re)
  WHERE regexp_matches(url, re) AND NOT regexp_matches(url, '^.*cheap.*$')""")
def glob_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", "url").where("url IS NOT NULL")
    p = joins.source_filter(p, "url", "page_id", exclude=["*cheap*"])
    return joins.glob_join(p, "url", [("secure", "https://*"), ("english", "*/en/*"), ("blog", "http://blog.*"),
            ("blog", "https://blog.*")]).select("page_id", "pattern")


@query("""WITH s(suffix) AS (VALUES ('en/25#top'), ('en/685'), ('825?page=2&ref=x'), ('fr/825?page=2&ref=x'), ('85'))
  SELECT page_id, suffix FROM pages, s WHERE url = suffix OR ends_with(url, '/' || suffix)""")
def suffix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.createDataFrame([("en/25#top",), ("en/685",), ("825?page=2&ref=x",), ("fr/825?page=2&ref=x",), ("85",)], "suffix string")
    return joins.suffix_join(table(spark, sf_dir, "pages").select("page_id", "url"), "url", s, "suffix").select("page_id", "suffix")


@query("""SELECT event_id, coalesce(try_cast(regexp_extract(replace(props, '{"k": ', ''), '^\\s*([+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?)', 1) AS DOUBLE), 0) AS k,
  coalesce(try_cast(regexp_extract(event_type, '^\\s*([+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?)', 1) AS DOUBLE), 0) AS none FROM events""")
def evidence_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", text.leading_number(F.replace("props", F.lit('{"k": '), F.lit(""))).alias("k"),
        text.leading_number(F.col("event_type")).alias("none"))


@query("""SELECT event_id, 'k=' || json_extract_string(props, '$.k') || '; type=' || event_type || '; user=' || user_id AS evidence FROM events""")
def evidence_serialise(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    m = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("type"), F.col("event_type"), F.lit("k"),
        F.get_json_object("props", "$.k"))
    return e.select("event_id", text.evidence_text(m).alias("evidence"))


@query("""WITH c AS (SELECT l_partkey, l_returnflag || l_linestatus AS kind, l_quantity, l_orderkey, l_linenumber FROM lineitem),
  b AS (SELECT l_partkey, kind, max(l_quantity) AS q FROM c GROUP BY ALL),
  t(template, a_kind, b_kind) AS (VALUES ('mixed', 'AF', 'RF'), ('open', 'AO', 'RO'), ('none', 'NF', 'NO'))
  SELECT x.l_partkey, template, x.kind AS a_kind, y.kind AS b_kind, x.q AS a_l_quantity, y.q AS b_l_quantity, least(x.q, y.q) AS joint
  FROM b x JOIN b y ON x.l_partkey = y.l_partkey AND x.kind < y.kind JOIN t ON t.a_kind = x.kind AND t.b_kind = y.kind""")
def entity_pair_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_partkey", F.concat("l_returnflag", "l_linestatus").alias("kind"), "l_quantity")
    out = joins.class_pairs(li, ["l_partkey"], "kind", [F.col("l_quantity").desc()],
        [("mixed", "AF", "RF"), ("open", "RO", "AO"), ("none", "NF", "NO")], ["l_quantity"])
    return out.withColumn("joint", F.least("a_l_quantity", "b_l_quantity"))


@query("""WITH l AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') ELSE 'Nation#' || (o_custkey % 40) END AS name FROM orders),
  c AS (SELECT o_orderkey, 0 AS rank, c_name AS found FROM l JOIN customer ON c_name = name
    UNION ALL SELECT o_orderkey, 1, n_name FROM l JOIN nation ON 'Nation#' || n_nationkey = name)
  SELECT o_orderkey, rank, found FROM l LEFT JOIN (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY rank, found) AS rn FROM c) WHERE rn = 1) b USING (o_orderkey)""")
def rank_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.when(F.col("o_orderkey") % 3 == 0,
        F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))).otherwise(F
        .concat(F.lit("Nation#"), (F.col("o_custkey") % 40).cast("string")))
    o = table(spark, sf_dir, "orders").select("o_orderkey", key.alias("name"))
    exact = table(spark, sf_dir, "customer").select(F.col("c_name").alias("found"), F.col("c_name").alias("name"))
    near = table(spark, sf_dir, "nation").select(F.col("n_name").alias("found"),
        F.concat(F.lit("Nation#"), F.col("n_nationkey").cast("string")).alias("name"))
    same = F.col("l.name") == F.col("r.name")
    return joins.ranked_lookup(o, ["o_orderkey"], [(0, exact, same), (1, F.broadcast(near), same)], [F.col("found")],
        ["found"]).select("o_orderkey", "rank", "found")


@query("""WITH a AS (SELECT l_partkey, l_returnflag FROM lineitem WHERE year(l_shipdate) = 1997), b AS (SELECT l_partkey, l_returnflag FROM lineitem WHERE year(l_shipdate) = 1998)
  SELECT *, 'new' AS change FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) UNION ALL SELECT *, 'resolved' FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)""")
def multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    of = lambda y: li.where(F.year("l_shipdate") == y)
    return setdiff.multiset_difference(of(1997), of(1998), ["l_partkey", "l_returnflag"])


@query("""WITH a AS (SELECT l_partkey, l_returnflag FROM lineitem WHERE year(l_shipdate) = 1997), b AS (SELECT l_partkey, l_returnflag FROM lineitem WHERE year(l_shipdate) = 1998)
  SELECT CAST(count(*) AS BIGINT) AS unchanged FROM (SELECT * FROM a INTERSECT ALL SELECT * FROM b)""")
def unchanged_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    of = lambda y: li.where(F.year("l_shipdate") == y)
    return setdiff.unchanged_count(of(1997), of(1998), ["l_partkey", "l_returnflag"])


@query("""WITH a AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY ALL), b AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE l_orderkey % 2 = 1 GROUP BY ALL)
  SELECT l_returnflag, l_linestatus, CAST(coalesce(a.n, 0) AS BIGINT) AS before, CAST(coalesce(b.n, 0) AS BIGINT) AS after FROM a FULL JOIN b USING (l_returnflag, l_linestatus) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def distribution_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return setdiff.distribution_shift(li.where("l_orderkey % 2 = 0"), li.where("l_orderkey % 2 = 1"), ["l_returnflag", "l_linestatus"])


def part_edges(p: DataFrame) -> DataFrame:
    """(src, dst) of all parts: p to (7p + 3) mod N and to p // 2, N being the number of parts."""
    total = F.broadcast(p.agg(F.count("*").alias("total")))  # one row
    jumps = p.crossJoin(total).select(F.col("p_partkey").alias("src"), ((7 * F.col("p_partkey") + 3) % F.col("total")).alias("dst"))
    return jumps.union(p.select("p_partkey", F.floor(F.col("p_partkey") / 2)))


_PART_EDGES = "e AS (SELECT p_partkey AS src, (7 * p_partkey + 3) % (SELECT count(*) FROM part) AS dst FROM part UNION SELECT p_partkey, p_partkey // 2 FROM part)"


@query(f"""WITH RECURSIVE {_PART_EDGES},
  r(node, bit) AS (SELECT p_partkey, 1 FROM part WHERE p_partkey < 5 UNION SELECT p_partkey, 2 FROM part WHERE p_partkey BETWEEN 100 AND 104 UNION SELECT dst, bit FROM r JOIN e ON src = node)
  SELECT node, CAST(bit_or(bit) AS INTEGER) AS mask FROM r GROUP BY node""")
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey")
    roots = p.where("p_partkey < 5").select(F.col("p_partkey").alias("node"),
        F.lit(1).alias("mask")).union(p.where("p_partkey BETWEEN 100 AND 104").select("p_partkey", F.lit(2)))
    return graph.reachable(part_edges(p), roots)


@query(f"""WITH RECURSIVE {_PART_EDGES},
  r(node, hops) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey < 5 UNION SELECT dst, hops + 1 FROM r JOIN e ON src = node WHERE hops < 5)
  SELECT node, CAST(min(hops) AS INTEGER) AS hops FROM r GROUP BY node""")
def bounded_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey")
    return graph.within(part_edges(p), p.where("p_partkey < 5").select(F.col("p_partkey").alias("node")), 5)


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS src, 2 * p_partkey + k AS dst, CAST(p_size % 10 = 0 AS INTEGER) AS w FROM part, (VALUES (1), (2)) t(k) WHERE 2 * p_partkey + k < (SELECT count(*) FROM part)),
  r(node, depth) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey = 0 UNION SELECT dst, least(depth + w, 4) FROM r JOIN e ON src = node)
  SELECT node, CAST(max(depth) AS INTEGER) AS depth FROM r GROUP BY node""")
def max_relax(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    total = F.broadcast(p.agg(F.count("*").alias("total")))
    edges = p.select(F.col("p_partkey").alias("src"),
        F.explode(F.array(2 * F.col("p_partkey") + 1, 2 * F.col("p_partkey") + 2)).alias("dst"),
        (F.col("p_size") % 10 == 0).cast("int").alias("weight"))
    edges = edges.crossJoin(total).where("dst < total").drop("total")
    return graph.max_relax(edges, p.where("p_partkey = 0").select(F.col("p_partkey").alias("node"), F.lit(0).alias("depth")), 4)


@query("""SELECT event_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS run FROM (
  SELECT *, CAST(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM event_type AS INTEGER) AS fresh FROM events)""")
def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.islands(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], ["event_type"]).select("event_id",
        "run")


@query("""WITH t AS (SELECT ts AS a, ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT)) AS z FROM events), r AS (SELECT date_trunc('hour', min(a)) AS lo, max(z) AS hi FROM t), b AS (SELECT lo + INTERVAL (h) HOUR AS s FROM r, range(0, 1000000) x(h) WHERE h <= date_diff('hour', lo, hi))
  SELECT epoch(s)::BIGINT AS bin, CAST(count(*) AS BIGINT) AS n FROM t JOIN b ON a < s + INTERVAL 1 HOUR AND z > s GROUP BY s""")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the hours that they touch, all hours from the first start to the last end."""
    hour = 3_600_000_000
    e = table(spark, sf_dir, "events").select("event_id", time.epoch_micros(F.col("ts")).alias("t0"),
        F.round(F.col("value") * 1000000).cast("bigint").alias("d"))
    span = e.agg(F.floor(F.min("t0") / hour).alias("lo"),
        F.floor(F.max(F.col("t0") + F.col("d")) / hour).alias("hi")).where("lo IS NOT NULL")
    bins = span.select(F.explode(F.sequence("lo", "hi")).alias("h")).select((F.col("h") * 3600).alias("bin"))
    out = joins.interval_join(e, F.col("t0"), F.col("t0") + F.col("d"), bins, F.col("bin") * 1_000_000, (F.col("bin") + 3600) * 1_000_000,
        hour)
    return out.groupBy("bin").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY ALL)
  SELECT p.event_id, CASE WHEN v.ts >= p.ts - INTERVAL 6 HOUR THEN v.event_id END AS prev_event_id FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts > v.ts""")
def asof_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    a, b = (e.where(F.col("event_type") == k).drop("event_type") for k in ("purchase", "view"))
    return joins.asof_bounded(a, b, ["user_id"], "ts", ["event_id"], F.expr("INTERVAL 6 HOURS")).select("event_id", "prev_event_id")


@query("""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_sum(list_transform(list_zip(a.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) <= 1.69""")
def radius_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    return joins.radius_pairs(e, ["label"], "vec_id", "v", 1.3)


@query("""WITH s AS (SELECT count(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS n_c, avg(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS mean_c, stddev_pop(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS sd_c,
    count(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS n_t, avg(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS mean_t, stddev_pop(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS sd_t FROM lineitem),
  w AS (SELECT *, (mean_t - mean_c) / sqrt(sd_c * sd_c / n_c + sd_t * sd_t / n_t) AS t, (mean_t - mean_c) / sqrt((sd_c * sd_c + sd_t * sd_t) / 2) AS d FROM s)
  SELECT CAST(n_c AS BIGINT) AS n_c, CAST(n_t AS BIGINT) AS n_t, round(mean_c, 4) AS mean_c, round(mean_t, 4) AS mean_t, round(t, 6) AS t, round(d, 6) AS d,
    CAST(CASE WHEN abs(t) > 5 THEN 0.0001 WHEN abs(t) > 3.3 THEN 0.001 WHEN abs(t) > 2.58 THEN 0.01 WHEN abs(t) > 1.96 THEN 0.05 WHEN abs(t) > 1.64 THEN 0.1 ELSE 0.5 END AS DOUBLE) AS p FROM w""")
def welch(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.welch(table(spark, sf_dir, "lineitem"), "l_returnflag", "A", "R", "l_extendedprice")
    return out.select("n_c", "n_t", F.round("mean_c", 4).alias("mean_c"), F.round("mean_t", 4).alias("mean_t"), F.round("t", 6).alias("t"),
        F.round("d", 6).alias("d"), "p")


@query("""WITH r AS (SELECT l_returnflag, l_quantity, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
  SELECT l_returnflag, p, l_quantity AS value FROM r JOIN (VALUES (CAST(0.5 AS DOUBLE)), (0.99), (0.999)) t(p) ON i = floor(p * (n - 1))""")
def floor_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.floor_percentiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", [0.5, 0.99, 0.999])


_WILSON = """round({a} (k / n + 1.96 * 1.96 / (2 * n) {s} 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n) {b}, 6)"""


@query(f"""WITH c AS (SELECT quality, count(*) AS total, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE toxic = 1) AS DOUBLE) AS k FROM labels GROUP BY quality)
  SELECT quality, CAST(k AS BIGINT) AS k, CAST(total AS BIGINT) AS n, {_WILSON.format(a="greatest(0,", s="-", b=")")} AS low, {_WILSON.format(a="least(1,", s="+", b=")")} AS high FROM c""")
def wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "labels").groupBy("quality").agg(F.count(F.when(F.col("toxic") == 1, 1)).alias("k"), F.count("*").alias("n"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return c.select("quality", "k", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("""WITH m AS (SELECT quality, CASE WHEN toxic = 1 THEN 'FP' WHEN doc_id % 3 = 0 THEN 'TP-NWF' ELSE 'TP' END AS mark FROM labels)
  SELECT quality, CAST(count(*) FILTER (WHERE mark <> 'FP') AS BIGINT) AS tp, CAST(count(*) AS BIGINT) AS scored, round(count(*) FILTER (WHERE mark <> 'FP') / count(*), 6) AS precision FROM m GROUP BY ROLLUP (quality)""")
def precision_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "labels").select("quality",
        F.when(F.col("toxic") == 1, "FP").when(F.col("doc_id") % 3 == 0, "TP-NWF").otherwise("TP").alias("mark"))
    return stats.precision_by(m, "quality", "mark").select("quality", "tp", "scored", F.round("precision", 6).alias("precision"))


@query("""WITH c AS (SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE value >= 50) AS BIGINT) AS confirmed FROM events GROUP BY 1)
  SELECT event_type, n, confirmed, n - confirmed AS refuted, round((confirmed + 1) / (n + 2), 6) AS prior,
    round(greatest(0.05, least(0.99, 0.7 * (1 - least(1.0, n / 50)) + (confirmed + 1) / (n + 2) * least(1.0, n / 50))), 6) AS blended FROM c""")
def prior_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = stats.smoothed_priors(table(spark, sf_dir, "events"), ["event_type"], F.col("value") >= 50)
    return p.withColumn("blended", F.round(stats.blended(F.lit(0.7), F.col("prior"), F.col("n")), 6)).withColumn("prior",
        F.round("prior", 6))


@query("""WITH t(event_type, yes, no) AS (VALUES ('view', 60.0, 10.0), ('click', 80.0, 20.0), ('error', 40.0, 5.0)),
  v AS (SELECT user_id, count(*) FILTER (WHERE value >= yes) AS c, count(*) FILTER (WHERE value <= no) AS r FROM events JOIN t USING (event_type) GROUP BY 1)
  SELECT user_id, CAST(c AS BIGINT) AS confirm, CAST(r AS BIGINT) AS refute, CASE WHEN c > r THEN 'Positive' WHEN r > c THEN 'Negative' ELSE 'Unlabeled' END AS verdict FROM v""")
def counter_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.counter_votes(table(spark, sf_dir, "events"), ["user_id"], "event_type", F.col("value"), F.lit(0),
        [("view", 60, 10), ("click", 80, 20), ("error", 40, 5)])


@query("""WITH g AS (SELECT user_id % 97 AS line, event_type, bit_or(CAST(1 AS BIGINT) << (event_id % 8)::INTEGER) AS m, count(*) AS w FROM events GROUP BY 1, 2),
  s AS (SELECT line, m, sum(w) AS w FROM g GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY w DESC) AS rn FROM s),
  l AS (SELECT line, bit_or(m) AS mask, count(*) AS masks, coalesce(max(w) FILTER (WHERE rn = 2), 0) AS pressure FROM r GROUP BY 1)
  SELECT line, CAST(mask AS BIGINT) AS mask, CAST(bit_count(mask) AS INTEGER) AS writers, CAST(pressure AS BIGINT) AS pressure,
    CASE WHEN bit_count(mask) <= 1 THEN 'PRIVATE' WHEN masks = 1 THEN 'TRUE' WHEN pressure >= 100 THEN 'FALSE' ELSE 'COLD' END AS verdict FROM l""")
def mask_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 97).alias("line"), "event_type",
        F.expr("shiftleft(1L, cast(event_id % 8 as int))").alias("mask"), F.lit(1).alias("writes"))
    return stats.mask_verdicts(e, ["line"], "event_type", "mask", "writes")


@query("""WITH c AS (SELECT p_partkey, k, CASE WHEN (4 << k) < (4 << (p_size % 7)) THEN 40000 + p_partkey ELSE 1 END AS v FROM part, range(0, 7) t(k)),
  x AS (SELECT *, max(v) OVER (PARTITION BY p_partkey) AS top, lag(v) OVER w AS before, max(v) OVER (PARTITION BY p_partkey ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS later FROM c WINDOW w AS (PARTITION BY p_partkey ORDER BY k))
  SELECT p_partkey, CAST(coalesce(min(k) FILTER (WHERE k >= 1 AND top >= 1000 AND later <= top // 100 AND before >= top // 4), 0) AS INTEGER) AS cliff FROM x GROUP BY 1""")
def cliff(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    v = F.when(F.col("k") < F.col("p_size") % 7, 40000 + F.col("p_partkey")).otherwise(F.lit(1).cast("bigint"))
    c = p.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(6)))).select("p_partkey", "k", v.alias("v"))
    return stats.cliffs(c, ["p_partkey"], "k", "v")


@query("""WITH p AS (SELECT DISTINCT o_orderkey AS key FROM orders WHERE o_orderpriority = '1-URGENT'), o AS (SELECT l_orderkey AS key, bool_or(l_quantity >= 45) AS hit FROM lineitem GROUP BY 1),
  v AS (SELECT key, CASE WHEN p.key IS NOT NULL AND hit THEN 'CONFIRMED' WHEN p.key IS NOT NULL AND NOT hit THEN 'REFUTED' WHEN p.key IS NOT NULL THEN 'UNOBSERVED' WHEN hit THEN 'MISSED' END AS verdict FROM p FULL JOIN o USING (key))
  SELECT * FROM v WHERE verdict IS NOT NULL""")
def divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("key"))
    o = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), (F.col("l_quantity") >= 45).alias("hit"))
    return joins.verdicts(p, o, ["key"])


@query("""SELECT doc_id, quality, toxic FROM (SELECT *, row_number() OVER (PARTITION BY quality, toxic ORDER BY md5('s1|' || quality || '|' || toxic || '|' || doc_id), doc_id) AS rn FROM labels) WHERE rn <= 8""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.stratified_sample(table(spark, sf_dir, "labels"), ["quality", "toxic"], "doc_id", 8, "s1").select("doc_id", "quality",
        "toxic")


@query("""WITH f AS (SELECT p_partkey, p_brand, p_partkey * p_size % 512 AS o, p_size AS n FROM part)
  SELECT p_partkey, CAST(ceil(n / 64) AS INTEGER) AS best, CAST(ceil((64 - 8 + n) / 64) AS INTEGER) AS worst, CAST(o // 64 AS INTEGER) AS first_line, CAST((o + 56 + n - 1) // 64 AS INTEGER) AS last_line,
    list_bool_or(list_transform(range(0, 64, 8), lambda s: (o + s) // 64 <> (o + s + n - 1) // 64)) AS straddles FROM f""")
def line_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * F.col("p_size") % 512).alias("o"),
        F.col("p_size").alias("n"))
    al = F.lit(8)
    return f.select("p_partkey", layout.lines_best(F.col("n"), 64).alias("best"), layout.lines_worst(F.col("n"), al, 64).alias("worst"),
        layout.first_line(F.col("o"), 64).alias("first_line"), layout.last_line(F.col("o"), F.col("n"), al, 64).alias("last_line"),
        layout.straddles(F.col("o"), F.col("n"), al, 64).alias("straddles"))


@query("""WITH f AS (SELECT p_partkey, p_brand, p_type, p_partkey * p_size % 4096 AS o, p_size AS n FROM part),
  p AS (SELECT a.p_brand, a.p_type, a.p_partkey AS a, b.p_partkey AS b, greatest(a.o, b.o) // 64 AS line_index FROM f a JOIN f b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey
    WHERE list_bool_or(list_transform(range(0, 64, 8), lambda s: (a.o + s) // 64 <= (b.o + s + b.n - 1) // 64 AND (b.o + s) // 64 <= (a.o + s + a.n - 1) // 64))
    UNION ALL SELECT p_brand, p_type, p_partkey, p_partkey, o // 64 FROM f WHERE n >= 40)
  SELECT p_brand, p_type, a, b, CAST(line_index AS INTEGER) AS line_index FROM p""")
def line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "part").select("p_brand", "p_type", F.col("p_partkey").alias("field"), F.col("p_partkey").alias("ord"),
        (F.col("p_partkey") * F.col("p_size") % 4096).alias("offset"), F.col("p_size").alias("size"), F.lit(8).alias("align"),
        F.when(F.col("p_size") >= 40, 2).otherwise(1).alias("n_elements"))
    return layout.line_pairs(f, ["p_brand", "p_type"], "ord", 64)


@query("""WITH a AS (SELECT p_partkey, p_partkey % 3 = 0 AS x, p_partkey % 5 = 0 AS y, p_partkey % 7 = 0 AS z, p_size % 8 AS n FROM part),
  s AS (SELECT *, least(1.0, CASE WHEN x THEN 0.40 ELSE 0 END + CASE WHEN y THEN 0.25 ELSE 0 END + CASE WHEN z THEN 0.15 ELSE 0 END + CASE WHEN y THEN 0.10 ELSE 0 END + CASE WHEN z THEN 0.10 ELSE 0 END + CASE WHEN x THEN 0.20 ELSE 0 END + CASE WHEN x AND z THEN 0.15 ELSE 0 END) AS c FROM a)
  SELECT p_partkey, round(CAST(CASE WHEN NOT (x OR y) THEN 0 WHEN n <= 1 THEN c * 0.5 WHEN n >= 6 THEN least(1.0, c * 1.2) ELSE c END AS DOUBLE), 6) AS score FROM s""")
def escape_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, z = (F.col("p_partkey") % k == 0 for k in (3, 5, 7))
    return table(spark, sf_dir, "part").select("p_partkey",
        F.round(layout.escape_score(x, y, z, y, z, x, F.col("p_size") % 8, x | y), 6).alias("score"))


@query("""SELECT l_suppkey, CAST(count(DISTINCT l_partkey) AS BIGINT) AS n_writers, bool_or(l_quantity > 49) AS entry_writer, bool_or(l_discount > 0.09) AS pool_writer, bool_and(l_tax < 0.07) AS all_opaque,
  count(DISTINCT l_partkey) >= 2 AND bool_or(l_quantity > 49) AS thread_writers FROM lineitem GROUP BY 1""")
def writer_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", (F.col("l_quantity") > 49).alias("e"),
        (F.col("l_discount") > 0.09).alias("p"), (F.col("l_tax") < 0.07).alias("o"))
    return layout.writer_facts(w, ["l_suppkey"], "l_partkey", "e", "p", "o")


@query("""SELECT event_id, round(greatest(0, value - 2 * sqrt(value)) / (user_id + 2 * sqrt(user_id) + 1), 6) AS bound FROM events""")
def ratio_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id",
        F.round(stats.ratio_lower_bound(F.col("value"), F.col("user_id")), 6).alias("bound"))


@query("""WITH m AS (SELECT doc_id, doc_id % 100 / 100.0 AS power, doc_id % 2 = 0 AS turbo, doc_id % 3 = 0 AS gov, doc_id % 5 = 0 AS cores, CASE doc_id % 3 WHEN 0 THEN 'Confirmed' WHEN 1 THEN 'Refuted' ELSE 'Inconclusive' END AS v, toxic = 1 AS ex FROM labels),
  q AS (SELECT *, least(power, 1) * greatest(0, 1 - (CASE WHEN turbo THEN 0.15 ELSE 0 END + CASE WHEN gov THEN 0.10 ELSE 0 END + CASE WHEN cores THEN 0.20 ELSE 0 END)) * 0.95 AS quality FROM m)
  SELECT doc_id, round(CAST(quality AS DOUBLE), 6) AS quality, CASE WHEN ex THEN 'Excluded' WHEN round(CAST(quality AS DOUBLE), 9) < 0.6 OR (power < 0.8 AND v = 'Refuted') THEN 'Unlabeled' WHEN v = 'Confirmed' THEN 'Positive' WHEN v = 'Refuted' THEN 'Negative' ELSE 'Unlabeled' END AS label FROM q""")
def label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    m = table(spark, sf_dir, "labels").select("doc_id", (d % 100 / 100.0).alias("power"),
        F.when(d % 3 == 0, "Confirmed").when(d % 3 == 1, "Refuted").otherwise("Inconclusive").alias("v"), (F.col("toxic") == 1).alias("ex"))
    m = m.withColumn("quality", F.round(stats.label_quality(F.col("power"), d % 2 == 0, d % 3 == 0, d % 5 == 0), 9))
    return m.select("doc_id", F.round("quality", 6).alias("quality"),
        stats.label(F.col("v"), F.col("quality"), F.col("power"), F.col("ex")).alias("label"))


@query("""SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS n, round(avg(value), 3) AS mean_d, bool_or(value > 200) AS super_additive FROM events GROUP BY 1, 2""")
def interaction_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("sa", F.col("value") > 200)
    return stats.interaction_catalog(e, ["user_id", "event_type"], "value", "sa").withColumn("mean_d", F.round("mean_d", 3))


@query("""SELECT c_custkey, o_orderkey FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM customer LEFT JOIN orders ON o_custkey = c_custkey) WHERE rn <= 3""")
def first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return ranking.survivors_n(j.select("c_custkey", "o_orderkey", "o_orderdate"), ["c_custkey"],
        [F.col("o_orderdate").asc_nulls_last(), F.col("o_orderkey").asc_nulls_last()], 3).select("c_custkey", "o_orderkey")


@query("""WITH RECURSIVE s AS (SELECT count(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS n_c, avg(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS mean_c, stddev_pop(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS sd_c,
    count(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS n_t, avg(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS mean_t, stddev_pop(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS sd_t FROM lineitem),
  w AS (SELECT *, sqrt(sd_c * sd_c / n_c + sd_t * sd_t / n_t) AS se, (mean_t - mean_c) / sqrt(sd_c * sd_c / n_c + sd_t * sd_t / n_t) AS t, (mean_t - mean_c) / sqrt((sd_c * sd_c + sd_t * sd_t) / 2) AS d FROM s),
  x AS (SELECT *, 0.05 * abs(mean_c) / se - 2.3263478740408408 AS x, CASE WHEN abs(t) > 5 THEN 0.0001 WHEN abs(t) > 3.3 THEN 0.001 WHEN abs(t) > 2.58 THEN 0.01 WHEN abs(t) > 1.96 THEN 0.05 WHEN abs(t) > 1.64 THEN 0.1 ELSE 0.5 END AS p FROM w),
  f(k, term, total) AS (SELECT 0, x, x FROM x UNION ALL SELECT k + 1, term * x * x / (2 * k + 3), total + term * x * x / (2 * k + 3) FROM f, x WHERE k < 400),
  y AS (SELECT t, d, p, greatest(0, least(1, 0.5 + (SELECT max_by(total, k) FROM f) * exp(-x * x / 2) / sqrt(2 * pi()))) AS power FROM x)
  SELECT round(t, 6) AS t, round(d, 6) AS d, CAST(p AS DOUBLE) AS p, round(power, 6) AS power, CASE WHEN p <= 0.01 AND d >= 0.05 THEN 'Confirmed' WHEN p > 0.10 AND power >= 0.80 THEN 'Refuted' ELSE 'Inconclusive' END AS verdict FROM y""")
def achieved_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = stats.welch(table(spark, sf_dir, "lineitem"), "l_returnflag", "A", "R", "l_extendedprice")
    out = stats.achieved_power(one, "mean_c", "sd_c", "n_c", "sd_t", "n_t", effect=0.05, alpha=0.01)
    verdict = stats.experiment_verdict(F.col("p"), F.col("d"), F.col("power"), 0.01, 0.05)
    return out.select(F.round("t", 6).alias("t"), F.round("d", 6).alias("d"), "p", F.round("power", 6).alias("power"), verdict.alias("verdict"))


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type IN ('view', 'click')").withColumn("half", F.col("user_id") % 2)
    return stats.bootstrap_ci(e, ["half"], ["ts", "event_id"], "event_type", "value", "view", "click", 0.05)


@query("""WITH RECURSIVE e AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
  f(label, i, cs, ns) AS (SELECT label, i, [v], [1] FROM e WHERE i = 1 UNION ALL
    SELECT label, i, CASE WHEN hit IS NULL THEN list_append(cs, v) ELSE cs END, CASE WHEN hit IS NULL THEN list_append(ns, 1) ELSE list_concat(list_concat(ns[:hit - 1], [ns[hit] + 1]), ns[hit + 1:]) END FROM (
      SELECT e.label, e.i, cs, ns, v, nullif(coalesce(list_position(list_transform(cs, lambda c: list_sum(list_transform(list_zip(c, v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) <= 1.3 * 1.3), true), 0), 0) AS hit FROM f JOIN e ON e.label = f.label AND e.i = f.i + 1)),
  z AS (SELECT label, max_by(cs, i) AS cs, max_by(ns, i) AS ns FROM f GROUP BY 1)
  SELECT label, round(cs[k][1], 6) AS first, CAST(ns[k] AS BIGINT) AS refutations FROM z, range(1, 100000) t(k) WHERE k <= len(cs)""")
def fp_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8, over classes by label; a cluster is shown by its first number."""
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("features"))
    out = stats.fp_clusters(e, "label", ["vec_id"], "features", radius=1.3)
    return out.select("label", F.round(F.col("features")[0], 6).alias("first"), "refutations")


@query()
def reduce_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reduce steps over findings made of ``lineitem``, with facts of every kind."""
    out = reduce.run(catalog_facts.pipeline_findings(spark, sf_dir), **catalog_facts.pipeline_facts(spark, sf_dir))
    return out.select("rule", "severity", F.round("confidence", 6).alias("confidence"), "tier", "file", "line",
        F.size("escalations").alias("notes"))


_CLAIMED = """SELECT {key}, l_linenumber % 4 AS severity, CASE WHEN l_discount > 0.02 THEN l_linenumber % 4 ELSE 0 END AS own, CAST(l_quantity AS INTEGER) % 3 + 1 AS cap FROM lineitem"""


@query(f"""SELECT l_suppkey, CAST(count(*) FILTER (WHERE severity > least(own, cap)) AS BIGINT) AS bound, CAST(max(least(severity, own, cap)) AS INTEGER) AS top FROM ({_CLAIMED.format(key='l_suppkey')}) GROUP BY 1""")
def claim_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = catalog_facts.lineitem_findings(spark, sf_dir).select(F.substring(reduce.ev("type_name"), 2, 99).cast("bigint").alias("l_suppkey"),
        "severity", S.supported_severity(F.col("claims")).alias("most"))
    return f.groupBy("l_suppkey").agg(F.count(F.when(F.col("severity") > F.col("most"), 1)).alias("bound"),
        F.max(F.least("severity", "most")).alias("top"))


@query()
def hazard_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all rules and reduce steps make of literal facts."""
    raw, facts = catalog_facts.canary(spark)
    return reduce.run(raw, facts).select("rule", "severity", F.round("confidence", 6).alias("confidence"), "tier", "file", "line")


@query("""SELECT page_id, '/root/' || url AS path FROM pages WHERE url IS NOT NULL""")
def absolute_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").where("url IS NOT NULL")
    return p.select("page_id", text.absolute(F.col("url"), F.lit("/root/")).alias("path"))


@query("""SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2""")
def windowed_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = watch.rule_rates(table(spark, sf_dir, "events"), "event_type", "ts")
    return out.select((time.epoch_micros(F.col("start")) / 1_000_000).cast("bigint").alias("start"), "event_type", "n")


# the other queries register themselves
from strideway.plans import catalog_calls, catalog_rules, catalog_steps  # noqa: E402, F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked survivors within a budget: dedup, budget and canonical order over rows of ``lineitem``."""
    left = survivor_dedup(spark, sf_dir)
    ranked = ranking.running_budget(left, ["l_returnflag"], [F.col("l_extendedprice").desc(), *map(F.col, LINE_COLUMNS)], 100)
    return ranked.where("NOT demoted").drop("demoted").orderBy("l_returnflag", "running")
