"""Operators on small literal rows, where the tables show too little."""

import pytest
from pyspark.sql import functions as F

from strideway import schemas as S
from strideway.functions import text
from strideway.operators import calls, graph, joins, layout, ranking, stats
from strideway.sources import facts
from strideway.streaming import watch


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


@pytest.mark.parametrize(
    ("value", "pattern", "hit"),
    [("src/a/b.c", "src/*", True), ("src/a.c", "*.c", True), ("a.c", "?.c", True), ("ab.c", "?.c", False), ("a.c", "", False),
        ("a+b", "a+b", True), ("x1", "x[0-9]", True), ("xa", "x[!0-9]", True), ("a.cc", "a.c", False), ("[", "\\[", True),
        (None, "*", False)],
)
def test_globs(spark, value, pattern, hit):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(text.matches_glob(F.col("v"), [pattern])).first()[0] is hit


@pytest.mark.parametrize(("value", "number"),
    [("352B", 352.0), ("42%", 42.0), ("-1.5e1x", -15.0), ("yes", 0.0), ("", 0.0), (None, 0.0), (".5", 0.5)])
def test_leading_numbers(spark, value, number):
    assert spark.createDataFrame([(value,)], "v string").select(text.leading_number(F.col("v"))).first()[0] == number


def test_source_filter(spark):
    df = frame(spark, "path string, ord int", ("/a/x.c", 1), ("/a/vendor/y.c", 2), ("/b/x.c", 3), ("/a/test/z.c", 4))
    run = lambda **kw: [r.path for r in joins.source_filter(df, "path", "ord", **kw).orderBy("ord").collect()]
    assert run(include=["/a/*"], exclude=["*test*"], vendored=["*vendor*"]) == ["/a/x.c", "/a/vendor/y.c"]
    assert run(vendored=["*vendor*"], most=2) == ["/a/x.c", "/b/x.c"]
    changed = lambda *c: frame(spark, "changed string", *((x,) for x in c))
    assert run(changed=changed("a/x.c", "z.c")) == ["/a/x.c", "/a/test/z.c"]
    assert len(run(changed=changed("q.h"))) == 4 and run(changed=changed("none.c")) == []


def test_layout(spark):
    df = frame(spark, "o int, n int, g int, a int", (60, 8, 8, 8), (56, 8, 8, 8), (60, 8, 8, 64), (0, 120, 12, 64), (0, 128, 8, 64),
        (0, 64, 1, 8))
    got = [tuple(r) for r in df.select(layout.straddles(F.col("o"), F.col("n"), F.col("a"), 64),
            layout.splits(F.col("o"), F.col("n"), F.col("g"), F.col("a"), 64), layout.lines_worst(F.col("n"), F.col("a"), 64)).collect()]
    assert got == [(True, True, 1), (False, False, 1), (True, True, 1), (True, True, 2), (True, False, 2), (True, False, 2)]


@pytest.mark.parametrize(
    ("curve", "want"),
    [([43334, 43659, 48248, 65025, 1, 1, 1], 4), ([50000, 40000, 3, 2, 1, 1, 1], 2), ([500, 400, 1, 1, 1, 1, 1], 0),
        ([50000, 49000, 1, 49000, 1, 1, 1], 4), ([50000] * 7, 0), ([50000, 9000, 1, 1, 1, 1, 1], 0)],
)
def test_cliffs(spark, curve, want):
    df = spark.createDataFrame([("c", i, v) for i, v in enumerate(curve)], "key string, k int, v bigint")
    assert stats.cliffs(df, ["key"], "k", "v").first().cliff == want


def test_floor_percentiles(spark):
    df = spark.createDataFrame([("a", i) for i in range(10)] + [("b", 5), ("b", None)], "key string, v int")
    assert {(r.key, r.p): r.value for r in stats.floor_percentiles(df, ["key"], "v", [0.5, 0.99, 1.0]).collect()} == {("a", 0.5): 4,
        ("a", 0.99): 8, ("a", 1.0): 9, ("b", 0.5): 5, ("b", 0.99): 5, ("b", 1.0): 5}


def test_power(spark):
    df = frame(spark, "m double, s double, n bigint, s2 double, n2 bigint", (100.0, 10.0, 1000, 10.0, 1000), (100.0, 10.0, 0, 10.0, 0),
        (100.0, 0.0, 50, 0.0, 50), (100.0, 300.0, 40, 300.0, 40))
    out = [round(r.power, 4) for r in stats.achieved_power(df, "m", "s", "n", "s2", "n2", 0.05, 0.01).collect()]
    assert out[1:3] == [0.0, 1.0] and out[0] == 1.0 and out[3] < 0.05
    assert stats.normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-5) and stats.normal_quantile(0.025) == pytest.approx(-1.959964,
        abs=1e-5)


def test_wilson_without_data(spark):
    df = frame(spark, "k bigint, n bigint", (0, 0), (5, 10))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    got = [tuple(r) for r in df.select(low, high).collect()]
    assert got[0] == (0.0, 1.0) and got[1] == pytest.approx((0.2366, 0.7634), abs=1e-4)


def test_bootstrap(spark):
    rows = [("a", "c", 100 + i % 7) for i in range(400)] + [("a", "t", 200 + i % 7) for i in range(400)] + [("b", "c", 100 + i % 7)
        for i in range(400)] + [("b", "t", 100 + i % 7) for i in range(400)]
    # a later control that is twice as slow cannot be told from an effect
    rows += [("d", "c", (100 if i < 200 else 200) + i % 7) for i in range(400)] + [("d", "t", 200 + i % 7) for i in range(400)]
    df = frame(spark, "key string, i bigint, g string, v double", *((k, i, g, float(v)) for i, (k, g, v) in enumerate(rows)))
    out = {r.key: r for r in stats.bootstrap_ci(df, ["key"], ["i"], "g", "v", "c", "t", 0.1, reps=200).collect()}
    assert out["d"].verdict == "CONFOUNDED" and out["d"].drift > 0.9 and out["d"].drift_low > 0
    assert out["a"].verdict == "CONFIRMED" and out["b"].verdict == "REFUTED" and out["a"].low <= out["a"].effect <= out["a"].high


def test_clusters_follow_order(spark):
    df = frame(spark, "cls string, ord int, f array<double>", ("A", 1, [0.0]), ("A", 2, [0.2]), ("A", 3, [0.4]), ("A", 4, [0.0, 0.0]),
        ("B", 1, [0.1]))
    out = {(r.cls, tuple(r.features)): r.refutations for r in stats.fp_clusters(df, "cls", ["ord"], "f", 0.25).collect()}
    assert out == {("A", (0.0,)): 2, ("A", (0.4,)): 1, ("A", (0.0, 0.0)): 1, ("B", (0.1,)): 1}


def test_election_and_bound(spark):
    df = frame(spark, "s array<double>", ([10.0, 10.9, 11.1, 12.0],), ([],))
    assert [r[0] for r in df.select(stats.elected(F.col("s"))).collect()] == [2, -1]
    assert stats.counter_groups(["a", "b"], ["c", "b", "d"], 2) == [["a", "b"], ["c", "d"]]


def test_graph_caps_are_errors(spark):
    e = spark.createDataFrame([(i, i + 1, 0) for i in range(6)], "src int, dst int, weight int")
    with pytest.raises(graph.NoFixpoint):
        graph.reachable(e, spark.createDataFrame([(0, 1)], "node int, mask int"), rounds=2)


@pytest.mark.parametrize("hops", [1, 4])
def test_fixpoints_against_brute_force(spark, monkeypatch, hops):
    """Cycles, a long chain, and ends that are null, which lead nowhere."""
    monkeypatch.setattr(graph, "HOPS", hops)
    rows = [((i * 7) % 50, (i * 11 + 3) % 50, i % 3) for i in range(90)] + [(5, 5, 0), (2, None, 1),
        (None, 49, 1)] + [(100 + i, 101 + i, i % 2) for i in range(25)]
    roots, seeds = [(0, 1), (9, 2), (9, 4), (77, 8), (100, 16), (None, 32)], [(0, 0), (77, 9), (100, 0)]
    mask: dict = {}
    depth: dict = {}
    for n, m in roots:
        if n is not None:
            mask[n] = mask.get(n, 0) | m
    for n, d in seeds:
        depth[n] = min(d, 4)
    for _ in range(200):
        for s, d, w in rows:
            if s is None or d is None:
                continue
            if s in mask:
                mask[d] = mask.get(d, 0) | mask[s]
            if s in depth:
                depth[d] = max(depth.get(d, -1), min(depth[s] + (1 if s == d and not w else w), 4))
    e = spark.createDataFrame(rows, "src int, dst int, weight int")
    assert {r.node: r.mask for r in graph.reachable(e, spark.createDataFrame(roots, "node int, mask int")).collect()} == mask
    assert {r.node: r.depth for r in graph.max_relax(e, spark.createDataFrame(seeds, "node int, depth int"), 4).collect()} == depth
    assert graph.reachable(e.where("false"), spark.createDataFrame([], "node int, mask int")).count() == 0


def test_running_budget_of_one_hot_key(spark):
    df = spark.createDataFrame([(None if i % 9 == 0 else "hot" if i % 3 else "cold", i, i % 4 != 0) for i in range(3000)],
        "k string, i int, c boolean").repartition(7)
    out = ranking.running_budget(df, ["k"], [F.col("i")], 100, counted=F.col("c")).collect()
    run: dict = {}
    for r in sorted(out, key=lambda r: r.i):
        run[r.k] = run.get(r.k, 0) + r.c
        assert (r.running, r.demoted) == (run[r.k], r.c and run[r.k] > 100)
    assert len(out) == 3000


def test_radius_join_against_all_pairs(spark):
    import random

    rng = random.Random(2)
    rows = [(i, "ab"[i % 2], [rng.uniform(-1, 1) for _ in range(rng.choice((2, 3)))]) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, cls string, v array<double>")
    near = lambda x, y, r: len(x) == len(y) and sum((a - b) ** 2 for a, b in zip(x, y)) <= r * r
    for radius in (0.0, 0.3, 5.0):
        want = {(a, b) for a, c, v in rows for b, d, w in rows if c == d and near(v, w, radius)}
        got = [tuple(r) for r in joins.radius_join(df, df, ["cls"], "v", "v", radius).select(F.col("l.id"), F.col("r.id")).collect()]
        assert len(got) == len(want) and set(got) == want


def test_recall(spark):
    hot = frame(spark, "symbol string, weight bigint", ("f+0x1", 90), ("g@plt", 10), ("free", 1))
    found = frame(spark, "fn string, evidence map<string,string>", ("ns::f", {"v": "x::kfree"}), ("", {}))
    out = joins.symbol_recall(hot, found)
    assert {(r.symbol, r.found) for r in out.collect()} == {("f", True), ("g", False), ("free", False)}
    assert tuple(joins.recall_summary(out).first()) == (1, 3, 90 / 101)
    assert joins.recall_summary(out.where("false")).first().by_weight is None


def test_calls(spark):
    args = frame(spark, "callee string, slot int, fn string, caller string, in_loop boolean", ("pthread_create", 2, "w", "main", False),
        ("std::thread", 0, "p", "main", True), ("std::async", 0, "twice", "a", False), ("std::async", 1, "twice", "b", False),
        ("spawn", 1, "late", "a", False), ("spawn", 1, "late", "b", False), ("pthread_create", 1, "no", "m", False))
    assert {r.fn: r.pool for r in calls.thread_entries(args).collect()} == {"w": False, "p": True, "twice": True}
    assert {r.fn: r.pool for r in calls.resolved_spawners(frame(spark, "spawner string, slot int", ("spawn", 1)), args)
        .collect()} == {"late": True}
    edges = calls.call_edges(frame(spark, "src string, dst string, loop_depth int", ("p", "q", 0), ("p", "q", 2), ("q", "p", 0)))
    assert {r.fn for r in calls.pool_closure(edges, calls.thread_entries(args)).collect()} == {"p", "q", "twice"}
    fns = frame(spark, "fn string, file string, hot_attr boolean, externally_visible boolean", ("ns::f", "a.c", False, True),
        ("g", "hot/b.c", False, True), ("h", "a.c", True, False), ("cold", "a.c", False, True))
    prof = frame(spark, "name string", ("f",))
    hot = calls.declared_hot(fns, prof, names=[], files=["hot/*"])
    assert {r.fn: r.hotness for r in hot.collect()} == {"ns::f": S.PROFILED, "g": S.DECLARED, "h": S.DECLARED, "cold": S.COLD}
    assert [r.fn for r in calls.candidates(fns, hot).collect()] == ["cold"]
    assert {r.fn for r in calls.opaque_callers(edges.union(frame(spark, "src string, dst string, d int", ("g", "ext", 0))),
            frame(spark, "fn string", ("p",), ("q",))).collect()} == {"g"}


def test_taint_and_writes(spark):
    b = frame(spark, "fn string, var string, kind string", ("f", "x", "alloc"))
    u = frame(spark, "fn string, var string, line int, context string, depth int", ("f", "x", 1, "argument", 2), ("f", "x", 1, "use", 1),
        ("f", "x", 3, "condition", 0), ("g", "x", 4, "return", 0))
    r = calls.taint(b, u).first()
    assert (r.depth, r.loop_lines, r.branches, r.passed, r.stored, r.returned) == (2, 1, True, True, False, False)
    w = frame(spark, "target string, fn string", ("p", "a"), ("arr", "b"))
    out = calls.through_aliases(w, frame(spark, "alias string, target string, origin int", ("p", "arr", 1)))
    assert {(r.target, r.fn, r.shifted) for r in out.collect()} == {("arr", "a", True), ("arr", "b", False)}
    g = calls.granule_writes(frame(spark, "a bigint, t int", (0, 0), (7, 65), (8, 2)), F.col("a"), F.col("t"))
    assert {(r.granule, r.mask, r.writes) for r in g.collect()} == {(0, 3, 2), (1, 4, 1)}


def test_refinement(spark):
    from strideway.plans import catalog_facts

    raw, _ = catalog_facts.canary(spark)
    prof = frame(spark, "fn string, site_lines array<int>, seq_csts bigint, heap_calls bigint, calls bigint, indirect_calls bigint, atomics bigint, locks bigint, frame bigint",
        ("publish", [1], 1, 0, 0, 0, 2, 0, 0), ("decode", [], 0, 0, 0, 0, 0, 0, 64), ("dispatch", [], 0, 0, 3, 0, 0, 0, 0))
    out = {(r.rule, r.fn, r.line): r for r in calls.refined(raw, prof).collect()}
    assert out["FL010", "publish", 1].confidence == pytest.approx(0.98) and out["FL010", "publish", 1].tier == S.PROVEN
    assert out["FL021", "decode", 11].suppressed
    assert out["FL030", "dispatch", 13].confidence == pytest.approx(0.45)
    h = calls.hypotheses(raw, least=0.5)
    assert h.where("metric IS NOT NULL").count() > 5 and calls.hypothesis_pairs(h).count() > 0


def test_ordinals_are_dense_and_sorted(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    got = ranking.ordinal(df, [F.col("v")]).orderBy("ord").collect()
    assert [r.ord for r in got] == list(range(1, 1001)) and [r.v for r in got] == list(range(1000))
    assert ranking.ordinal(df.where("false"), [F.col("v")]).count() == 0


def test_watching(spark, tmp_path):
    import json

    (tmp_path / "in").mkdir()
    seen = []
    rescan = lambda records, n: seen.append(sorted(r.src for r in records.collect()))

    def add(name):
        (tmp_path / f"in/{name}.ndjson").write_text(json.dumps({"src": name, "exitCode": 0}) + "\n")
        watch.watch(spark, str(tmp_path / "in"), str(tmp_path / "ck"), rescan).awaitTermination()

    add("a")
    add("b")
    watch.watch(spark, str(tmp_path / "in"), str(tmp_path / "ck"), rescan).awaitTermination()
    assert seen == [["a"], ["a", "b"]]
    assert facts.shards(spark, str(tmp_path / "in"))[1].count() == 0


def test_streamed_rates(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.select("ts", "event_type").repartition(3).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema("ts timestamp_ntz, event_type string").parquet(str(tmp_path / "ev"))
    q = watch.rule_rates(stream, "event_type",
        "ts").writeStream.format("memory").queryName("rates").outputMode("complete").option("checkpointLocation",
        str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = {tuple(r) for r in watch.rule_rates(events, "event_type", "ts").collect()}
    assert {tuple(r) for r in spark.table("rates").collect()} == want
