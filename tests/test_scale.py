"""Steps that must not grow faster than their input, against plain counting of the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from strideway import storage
from strideway.functions import text
from strideway.operators import calls, graph, joins, layout, ranking
from strideway.plans import catalog, rules
from strideway.sources import facts


def plan(df):
    return df._jdf.queryExecution().toString()


def test_what_is_too_large_is_never_broadcast(spark, monkeypatch):
    side = storage.saved(spark.range(1000).selectExpr("id AS k", "id % 7 AS v"), "side")
    df = spark.range(5000).withColumnRenamed("id", "k")
    assert "BroadcastHashJoin" in plan(df.join(storage.small(side), "k", "left"))
    monkeypatch.setattr(storage, "UNMEASURED_BYTES", 0)
    # little on disk, yet beyond the limit when read
    assert "Broadcast" not in plan(df.join(storage.small(side, 1000), "k", "left"))


def test_fixpoints_send_no_large_edges(spark, monkeypatch):
    monkeypatch.setattr(storage, "UNMEASURED_BYTES", 0)
    monkeypatch.setattr(storage, "ROUND_BYTES", 0)
    monkeypatch.setattr(storage, "SENT_BYTES", 0)
    n = 300
    edges = spark.createDataFrame([(p, d, p % 10 // 9) for p in range(n) for d in (2 * p + 1, 2 * p + 2)], "src int, dst int, loop_depth int")
    roots = spark.createDataFrame([(0, 1), (7, 2)], "node int, mask int")
    assert "Broadcast" not in plan(graph.within(edges, roots, 3))
    assert "Broadcast" not in plan(calls.hotness(edges, roots.select(F.col("node").alias("fn")), edges.select(F.col("src").alias("fn"), F.col("loop_depth").alias("depth"))))
    want = {0: 1, 7: 2}
    for p in range(n):
        for d in (2 * p + 1, 2 * p + 2):
            if p in want:
                want[d] = want.get(d, 0) | want[p]
    assert {r.node: r["mask"] for r in graph.reachable(edges, roots).collect()} == want


@pytest.mark.parametrize("name", ["unit_hotness", "resolve_candidates", "global_hotness", "pool_closure"])
def test_no_round_of_a_query_sends_what_is_too_large(spark, data, monkeypatch, name):
    plans = []
    keep = storage.saved
    want = catalog.QUERIES[name](spark, data).collect()
    monkeypatch.setattr(storage, "saved", lambda df, at: plans.append(plan(df)) or keep(df, at))
    for limit in ("UNMEASURED_BYTES", "ROUND_BYTES", "SENT_BYTES"):
        monkeypatch.setattr(storage, limit, 0, raising=False)
    out = catalog.QUERIES[name](spark, data)
    assert len(plans) > 3 and not any("Broadcast" in p for p in [*plans, plan(out)])
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want)) and want


@pytest.mark.parametrize("line", [64, 128])
def test_pairs_of_a_record_are_counted_as_listed(spark, line):
    rng = random.Random(line)
    names = ("head", "tail", "x", "pushed", "front")
    rows, writers = [], []
    for t in range(12):
        for k in range(rng.randrange(1, 25)):
            field = f"{rng.choice(names)}{k}"
            rows.append((f"t{t}", field, rng.randrange(10**6) * 100 + k, rng.randrange(400), rng.choice((0, 1, 8, 24, 90)), (1, 4, 8, 64, 24)[t % 5], rng.choice((1, 1, 3)),
                    rng.choice((True, False, None))))
            writers += [(f"t{t}", field, rng.choice(("w", "v", None)), rng.random() < 0.1) for _ in range(rng.choice((0, 0, 1, 1, 2)))]
    rows.append(("twice", "a", 1, 0, 8, 8, 1, True))
    rows.append(("twice", "a", 2, 8, 8, 8, 1, True))
    rows.append(("twice", "b", 2, 8, 8, 8, 2, True))
    rows.append(("none", None, None, 0, 8, 8, 2, True))
    can = spark.createDataFrame(rows, "type string, field string, ord int, offset int, size int, align int, n_elements int, atomic boolean")
    by = spark.createDataFrame(writers, "type string, field string, writer string, pool boolean")
    for w in (by, None):
        want = {r.type: r for r in rules._listed_pairs(can, w, line).collect()}
        got = {r.type: r for r in rules.field_pairs(can, w, line).collect()}
        assert got.keys() == want.keys() and len(got) > 8
        for t, r in want.items():
            assert tuple(got[t][c] for c in want[t].__fields__) == tuple(r), t


@pytest.mark.parametrize("align", [1, 8, 24, 64])
def test_line_pairs_against_all_pairs(spark, align):
    rng = random.Random(align)
    rows = [("ab"[k % 2], k // 2 % 37, k, rng.randrange(700), rng.choice((0, 1, 8, 200))) for k in range(90)]
    df = spark.createDataFrame(rows, "t string, ord int, field int, offset int, size int").withColumns({"align": F.lit(align), "n_elements": F.lit(1)})
    shifts = [0] if align >= 64 else range(0, 64, align)

    def share(a, b):
        return any((a[3] + s) // 64 <= (b[3] + s + max(b[4], 1) - 1) // 64 and (b[3] + s) // 64 <= (a[3] + s + max(a[4], 1) - 1) // 64 for s in shifts)

    want = sorted((a[0], a[2], b[2], max(a[3], b[3]) // 64) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and share(a, b))
    assert sorted(map(tuple, layout.line_pairs(df, ["t"], "ord", 64).collect())) == want


@pytest.mark.parametrize("block", [7, 2048])
def test_radius_pairs_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(joins, "BLOCK", block)
    rng = random.Random(4)
    rows = [(i, "ab"[i % 2], [rng.choice((-1.0, -0.5, 0.0, 0.5)) for _ in range(rng.choice((2, 3)))]) for i in range(120)]
    rows += [(200, "a", None), (201, "a", [0.0, None]), (202, None, [0.0, 0.0]), (203, "b", [float("nan"), 0.0]), (204, "a", []), (205, "a", [])]
    df = spark.createDataFrame(rows, "id int, cls string, v array<double>")
    for radius in (0.0, 0.5, 5.0):
        near = lambda x, y: x is not None and y is not None and None not in x + y and len(x) == len(y) and sum((a - b) ** 2 for a, b in zip(x, y)) <= radius * radius  # noqa: E731, B023
        want = sorted((a, b) for a, c, v in rows for b, d, w in rows if a < b and c == d and c and near(v, w))
        assert sorted(map(tuple, joins.radius_pairs(df, ["cls"], "id", "v", radius).collect())) == want


def test_points_by_shuffle_drop_the_same_rows(spark, monkeypatch):
    rng = random.Random(5)
    point = lambda: [rng.uniform(-1, 1) for _ in range(3)]
    rows = [(i, "ab"[i % 2], point() if i % 9 else None) for i in range(200)]
    points = [("ab"[i % 2], point()) for i in range(30)] * 3
    a = spark.createDataFrame(rows, "id int, cls string, v array<double>")
    b = spark.createDataFrame(points, "cls string, w array<double>")
    want = sorted(i for i, c, v in rows if v is None or not any(c == d and sum((x - y) ** 2 for x, y in zip(v, w)) <= 0.16 for d, w in points))
    for most in (storage.SENT_BYTES, 0):
        monkeypatch.setattr(storage, "SENT_BYTES", most)
        out = joins.radius_join(a, b, ["cls"], "v", "w", 0.4, "left_anti")
        assert sorted(r.id for r in out.collect()) == want and 0 < len(want) < 200


def test_profiles_of_one_place_are_met_once(spark):
    wanted = spark.range(4000).selectExpr("concat('n', id) AS name", "'/r/src/a.cpp' AS file", "3 AS line")
    profiles = spark.range(4000).selectExpr("lpad(id + 5, 6, '0') AS mangled", "concat('d', id) AS demangled", "'src/a.cpp' AS file", "3 AS line", "id AS calls")
    out = calls.resolved_profiles(wanted, profiles)
    assert out.where("mangled = '000005' AND calls = 0").count() == 4000


def test_depths_count_in_their_own_unit(spark):
    one = '{"src": "%s", "threadRoles": {"edges": {"f": ["g", "h"], "k": []}, "edgeDepth": {%s}}}'
    lines = [one % ("a", '"f": {"g": 2, "lost": 4}, "z": {"g": 1}'), one % ("b", '"f": {"g": 3}'), '{"src": "c", "threadRoles": {"edges": {"f": ["lost"]}}}', '{"src": "d"}']
    path = storage.place(spark, "units")
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    got = facts.facts_of(facts.shards(spark, path)[0])["edges"]
    assert sorted(map(tuple, got.collect())) == [("f", "g", 3), ("f", "h", 0), ("f", "lost", 0)]


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_runs_over_partitions(spark, parts):
    rng = random.Random(parts)
    rows = [(f"k{rng.randrange(2)}", i, rng.choice((None, "a", "a", "b")), rng.randrange(2)) for i in range(160)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "k string, i int, a string, b int").withColumn("seq", F.monotonically_increasing_id())
    want = sorted(map(tuple, ranking.islands(df, ["k"], [F.col("i")], ["a", "b"]).collect()), key=str)
    assert sorted(map(tuple, ranking.split_islands(df, ["k"], "seq", ["a", "b"]).collect()), key=str) == want


def test_a_sort_compares_columns_only(spark, monkeypatch):
    plans = []
    keep = storage.saved
    monkeypatch.setattr(storage, "saved", lambda df, name: plans.append(plan(df)) or keep(df, name))
    rng = random.Random(6)
    rows = [(i, rng.randrange(3), {k: rng.choice("ab") for k in rng.sample(["x", "y", "xy", "z"], rng.randrange(4))}) for i in range(90)]
    df = spark.createDataFrame(rows, "i int, n int, evidence map<string,string>").repartition(5)
    said = lambda e: "; ".join(f"{k}={e[k]}" for k in sorted(e))
    for columns in (None, ["i"]):
        out = ranking.ordinal(df, [F.col("n").desc(), text.evidence_text(F.col("evidence")), F.col("i")], columns=columns)
        assert out.columns == [*(columns or df.columns), "ord"]
        assert [r.i for r in out.orderBy("ord").collect()] == [r[0] for r in sorted(rows, key=lambda r: (-r[1], said(r[2]), r[0]))]
        assert sorted(r.ord for r in out.collect()) == list(range(1, 91))
    sorts = [line for p in plans for line in p.splitlines() if "Sort [" in line]
    assert sorts and not any("array_join" in line or "transform" in line for line in sorts)
    assert ranking.ordinal(df.where("n > 9"), [F.col("i")]).collect() == []
