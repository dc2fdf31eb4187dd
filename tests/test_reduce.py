"""The reduce steps on small literal findings."""

import pytest
from pyspark.sql import functions as F

from strideway import schemas as S
from strideway.plans import catalog_facts as C
from strideway.plans import reduce as R

BASE = {"rule": "FL001", "title": "t", "severity": S.HIGH, "confidence": 0.7, "tier": S.LIKELY, "suppressed": False, "file": "a.cpp",
    "line": 1, "col": 1, "fn": "", "reasoning": "", "evidence": {}, "mitigation": "", "escalations": [], "hotness": S.COLD, "claims": []}
NAMES = list(BASE)


def claim(supports, established=True, gating=False, effect="e"):
    return {"effect": effect, "precondition": "p", "established": established, "supports": supports, "gating": gating}


@pytest.fixture
def make(spark):
    def build(*rows):
        return spark.createDataFrame([tuple((BASE | r)[n] for n in NAMES) for r in rows], S.FINDING)

    return build


def got(df, *columns):
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.select(*columns).collect()]


@pytest.mark.parametrize(
    ("claims", "want"),
    [
        ([], S.CRITICAL), ([claim(S.HIGH)], S.HIGH), ([claim(S.HIGH, False)], S.INFO),
            ([claim(S.CRITICAL), claim(S.MEDIUM, gating=True)], S.MEDIUM),
        ([claim(S.MEDIUM, False, True)], S.MEDIUM), ([claim(S.MEDIUM), claim(S.CRITICAL, False)], S.MEDIUM),
            ([claim(S.HIGH), claim(S.CRITICAL, gating=True)], S.HIGH),
    ],
)
def test_claims_bound_severity(make, claims, want):
    assert got(R.clamp(make({"severity": S.CRITICAL, "claims": claims})), "severity") == [want]


def test_canonical_order_ignores_input_order(make):
    rows = [{"line": i % 3, "confidence": i / 10, "evidence": {"k": str(i)}} for i in range(9)]
    a = got(R.canonical(make(*rows)).orderBy("ord"), "line", "confidence")
    b = got(R.canonical(make(*rows[::-1]).repartition(5)).orderBy("ord"), "line", "confidence")
    assert a == b == sorted(a)


def fl040(**kw):
    ev = {"var": kw.pop("var", "g"), "type": "int", "atomics": kw.pop("atomics", "yes")} | {k: str(v) for k, v in kw.items()}
    return {"rule": "FL040", "severity": S.CRITICAL, "evidence": ev}


@pytest.mark.parametrize(
    ("parts", "want"),
    [
        ([{"tu_write_count": 1, "tu_loop_writes": 0}], S.INFO), ([{"tu_write_count": 0, "tu_loop_writes": 0, "has_init": "yes"}], S.INFO),
            ([{"tu_write_count": 1, "tu_loop_writes": 0}, {"tu_write_count": 1, "tu_loop_writes": 0}], S.HIGH),
        ([{"tu_write_count": 4, "tu_loop_writes": 0}], S.CRITICAL), ([{"tu_write_count": 1, "tu_loop_writes": 1}], S.CRITICAL),
            ([{"tu_write_count": 1, "tu_loop_writes": 1, "atomics": "no"}], S.INFO),
    ],
)
def test_global_writes_are_summed(make, parts, want):
    df = R.global_writes(R.canonical(make(*(fl040(**p) | {"line": i} for i, p in enumerate(parts)), {"rule": "FL001"})))
    out = {tuple(r) for r in df.where("rule = 'FL040'").select("severity", R.ev("global_write_count")).collect()}
    assert out == {(want, str(sum(p["tu_write_count"] for p in parts)))}
    assert df.where("rule = 'FL001'").count() == 1 and not df.where(R.ev("tu_write_count").isNotNull()).count()


def signals(spark, *rows):
    return spark.createDataFrame([(t, *(f in flags for f in S.SIGNAL_FLAGS), n) for t, flags, n in rows], S.SIGNAL)


def test_escape_suppression(spark, make):
    f = R.Facts(signals=signals(spark, ("A", {"atomics"}, 1), ("B", set(), 1), ("B", {"global_instance"}, 1), ("C", {"standing"}, 1)),
        units=2)
    rows = [{"evidence": {"thread_escape": "true", "type_name": t}, "tier": tier, "fn": name} for name, t,
        tier in (("a", "A", 1), ("b", "B", 1), ("c", "C", 1), ("d", "D", 2), ("proven", "D", 0))] + [{"fn": "none"},
        {"fn": "no", "evidence": {"thread_escape": "no", "type_name": "D"}}]
    df = R.canonical(make(*rows))
    assert sorted(got(R.escape_suppression(df, f).where("suppressed"), "fn")) == ["c", "d"]
    f.units = 1
    assert R.escape_suppression(df, f).where("suppressed").count() == 0


def test_sharing_route_unknown_is_not_disproven(spark, make):
    f = R.Facts(signals=signals(spark, ("S", {"standing", "published"}, 1), ("N", {"published"}, 1),
            ("G", {"standing", "global_instance", "thread_borne"}, 1)))
    rows = [{"rule": "FL002", "fn": t, "evidence": {"type_name": t}, "claims": [claim(S.CRITICAL)], "severity": S.CRITICAL}
        for t in ("S", "N", "G", "U", "N;S", "N;U")]
    out = R.clamp(R.sharing_verdict(R.canonical(make(*rows)), f))
    assert {r.fn: r.severity for r in out.collect()} == {"S": 3, "N": 1, "G": 3, "U": 3, "N;S": 3, "N;U": 1}


def edges(spark, *pairs):
    return spark.createDataFrame([(a, b, d) for a, b, d in pairs], "src string, dst string, loop_depth int")


def names(spark, *fns):
    return spark.createDataFrame([(n,) for n in fns], "fn string")


def test_roles(spark):
    e = edges(spark, ("main", "m", 0), ("m", "both", 0), ("worker", "w", 0), ("w", "both", 0), ("both", "m", 0), ("lost", "x", 0))
    f = R.Facts(edges=e, entries=names(spark, "worker"))
    assert {r.fn: r.mask for r in R.thread_roles(f).collect()} == {"main": 1, "m": 3, "both": 3, "worker": 2, "w": 2}
    assert R.thread_roles(R.Facts(edges=e)) is None
    globbed = R.Facts(edges=e, entry_patterns=["wor*"], main_patterns=["lo?t"])
    assert {r.fn: r.mask for r in R.thread_roles(globbed).collect()}["x"] == 1


def test_disjoint_writers_escalate(spark, make):
    f = R.Facts(edges=edges(spark, ("main", "m", 0), ("worker", "w", 0)), entries=names(spark, "worker"),
        writers=spark.createDataFrame([("T::a", "m"), ("T::b", "w"), ("T::c", "w"), ("T::c", "unknown"), ("ns::U::x", "m"),
                ("ns::U::y", "m")], "field string, writer string"))
    rows = [{"rule": "FL002", "fn": n, "evidence": {"type_name": t, "pair_fields": p}} for n, t,
        p in (("hit", "T", "a|c;a|b"), ("same", "ns::U", "x|y"), ("unknown", "T", "a|c"))] + [{"rule": "FL090", "fn": "whole",
            "evidence": {"type_name": "T"}, "confidence": 0.9}]
    out = {r.fn: r for r in R.role_escalation(R.canonical(make(*rows)), f, R.thread_roles(f)).collect()}
    assert [out[k].confidence for k in ("hit", "same", "unknown", "whole")] == pytest.approx([0.78, 0.7, 0.7, 0.95])
    assert out["hit"].escalations == [f"{R.ROLES_NOTE}: a by main, b by worker"]


def test_hotness(spark):
    e = edges(spark, ("t", "a", 1), ("a", "b", 1), ("t", "flat", 0), ("flat", "rec", 0), ("rec", "rec", 0),
        *((f"c{i}", f"c{i + 1}", 3 if i == 0 else 0) for i in range(12)), ("t", "c0", 0), ("cold", "x", 2))
    f = R.Facts(edges=e, entries=names(spark, "t"), own_depth=spark.createDataFrame([("a", 2)], "fn string, depth int"))
    out = {r.fn: r.hotness for r in R.global_hotness(f).collect()}
    assert out["a"] == S.DEEP and out["b"] == S.DEEP and out["rec"] == S.DEEP
    assert "flat" not in out and "x" not in out and "t" not in out
    assert out["c1"] == S.DEEP and out["c7"] == S.DEEP and out["c8"] == S.SHALLOW  # beyond eight calls


def test_candidates(spark, make):
    f = R.Facts(edges=edges(spark, ("t", "a", 1)), entries=names(spark, "t"))
    gate = claim(S.INFO, False, True, effect=R.HOT_EFFECT + " (x)")
    rows = [{"rule": r, "fn": fn, "hotness": S.CANDIDATE, "severity": S.CRITICAL, "claims": [claim(S.CRITICAL), gate]} for r,
        fn in (("FL012", "a"), ("FL012", "z"), ("FL021", "z"))]
    out = {(r.rule, r.fn): r for r in R.resolve_candidates(R.canonical(make(*rows)), f).collect()}
    assert out["FL012", "a"].hotness == S.SHALLOW and out["FL012", "a"].claims[1].supports == S.MEDIUM
    assert out["FL012", "z"].suppressed and not out["FL021", "z"].suppressed and out["FL021", "z"].hotness == S.COLD


def test_devirtualise(spark, make):
    f = R.Facts(overridden=names(spark, "A::f"))
    gate = claim(S.CRITICAL, False, True, effect=R.RECEIVER_EFFECT)
    rows = [{"rule": "FL030", "fn": v, "evidence": {"virtual_call": v}, "claims": [gate]} for v in ("A::f", "B::g")]
    assert {r.fn: r.claims[0].supports for r in R.devirtualise(R.canonical(make(*rows)), f).collect()} == {"A::f": S.CRITICAL,
        "B::g": S.MEDIUM}


def test_policy_respect(spark, make):
    rows = [{"rule": "FL060", "severity": S.CRITICAL, "confidence": 0.5}, {"rule": "FL070", "severity": S.MEDIUM, "confidence": 0.1}]
    f = R.Facts(edges=edges(spark, ("x", "mbind", 0), ("y", "mallopt", 0)))
    assert sorted(got(R.policy_respect(R.canonical(make(*rows)), f), "rule", "severity", "confidence")) == [("FL060", S.HIGH, 0.4),
        ("FL070", S.INFO, 0.05)]


def test_dedup(make):
    rows = [
        {"file": "long/a.h", "escalations": ["z", "y"], "confidence": 0.7}, {"file": "long/a.h", "escalations": ["x"], "confidence": 0.9},
            {"file": "b.h", "line": 4, "escalations": ["q", "p"]},
        {"rule": "FL040", "file": "h1", "evidence": {"var": "g", "type": "int"}},
            {"rule": "FL040", "file": "h", "evidence": {"var": "g", "type": "int"}}, {"rule": "FL012", "fn": "f", "file": "one"},
            {"rule": "FL012", "fn": "f", "file": "two", "tier": S.PROVEN},
        {"evidence": {"type_name": "X"}, "file": "m.h"}, {"evidence": {"type_name": "Y"}, "file": "m.h"},
    ]
    out = R.deduplicate(R.canonical(make(*rows)))
    assert sorted(got(out, "rule", "file")) == [("FL001", "b.h"), ("FL001", "long/a.h"), ("FL001", "m.h"), ("FL001", "m.h"),
        ("FL012", "two"), ("FL040", "h")]
    notes = {r.file: r.escalations for r in out.collect()}
    assert notes["long/a.h"] == ["cross-TU: deduplicated from 2 translation unit(s)", "x", "y", "z"] and notes["b.h"] == ["p", "q"]
    alone = R.deduplicate(R.canonical(make({"escalations": ["z", "a"]})))
    assert got(alone, "escalations") == [["z", "a"]]


def test_interactions(make):
    rows = [
        {"rule": "FL001", "fn": "f", "confidence": 0.8, "tier": S.PROVEN, "claims": [claim(S.HIGH)]},
            {"rule": "FL011", "fn": "f", "confidence": 0.6, "line": 2, "severity": S.CRITICAL},
            {"rule": "FL060", "fn": "f", "confidence": 0.9, "line": 3},
        {"rule": "FL011", "fn": "f", "confidence": 0.5, "line": 9}, {"rule": "FL012", "fn": "g", "line": 5},
            {"rule": "FL020", "fn": "g", "line": 6, "suppressed": True}, {"rule": "FL090", "fn": "f", "line": 7},
    ]
    out = R.interactions(R.canonical(make(*rows))).collect()
    by = {r.evidence["interaction"]: r for r in out}
    assert set(by) == {"IX-001", "IX-004", "IX-007"} and len(out) == 3
    assert by["IX-001"].confidence == pytest.approx(0.72) and by["IX-001"].tier == S.PROVEN and by["IX-001"].severity == S.CRITICAL
    assert by["IX-001"].claims[0].supports == S.HIGH and by["IX-007"].severity == S.CRITICAL
    assert by["IX-001"].evidence["components"] == "FL001+FL011"


def test_precedents(spark, make):
    f = R.Facts(signals=signals(spark, ("Good", {"layout"}, 1), ("Best", {"layout"}, 1), ("Bad", set(), 1)))
    note = [f"{R.ROLES_NOTE}: a by main, b by worker"]
    rows = [{"rule": "FL002", "evidence": {"type_name": "Bad"}, "escalations": note},
        {"rule": "FL090", "evidence": {"type_name": "Bad"}, "escalations": note},
        {"rule": "FL002", "line": 2, "evidence": {"type_name": "Good"}, "escalations": note},
        {"rule": "FL002", "line": 3, "evidence": {"type_name": "Plain"}}]
    out = R.precedents(R.canonical(make(*rows)), f).collect()
    assert [(r.evidence["type_name"], r.evidence["mitigated_exemplar"], r.evidence["mitigated_type_count"], r.evidence["component"])
        for r in out] == [("Bad", "Best", "2", "FL002")]


def test_budget(make):
    rows = [{"rule": "FL050", "line": i, "confidence": 0.5, "severity": S.CRITICAL}
        for i in range(22)] + [{"rule": "FL050", "line": -1, "confidence": 0.1},
        {"rule": "FL050", "line": -2, "confidence": 0.1, "suppressed": True}, {"rule": "FL013", "line": 0, "confidence": 0.01}]
    out = R.precision_budget(R.canonical(make(*rows)))
    by = {(r.rule, r.line): r for r in out.collect()}
    assert by["FL050", -1].suppressed and not by["FL013", 0].suppressed
    assert [by["FL050", i].severity for i in range(22)] == [S.HIGH] * 19 + [S.INFO] * 3  # a suppressed row used up one


def test_calibration(spark, make):
    near = make({"severity": S.HIGH, "confidence": 0.5, "tier": S.LIKELY},
        {"line": 2, "severity": S.HIGH, "confidence": 0.5, "tier": S.PROVEN},
        {"line": 3, "severity": S.HIGH, "confidence": 0.9, "tier": S.LIKELY})
    reg = spark.createDataFrame([("CacheGeometry", [2.0, 0.4] + [0.0] * 8, 3), ("CacheGeometry", [2.0, 0.9] + [0.0] * 8, 2),
            ("CacheGeometry", [2.0], 9)], "cls string, features array<double>, refutations bigint")
    assert sorted(got(R.calibration_suppression(R.canonical(near), reg), "line")) == [2, 3]


def test_missing_headers(spark):
    f = spark.createDataFrame([(f"{i}.c", "x: fatal error: 'h.h' file not found") for i in range(3)]
        + [("z", "fatal error: 'other.h'"), ("y", None)], "file string, error string")
    assert [(r.evidence["missing_header"], r.evidence["tu_count"]) for r in R.missing_headers(f).collect()] == [("h.h", "3")]


def test_inline_suppression(spark, make):
    lines = spark.createDataFrame([("a.cpp", 1, "// hazard-suppress FL001, FL002"), ("a.cpp", 5, "/* hazard-suppress */"),
            ("b.cpp", 1, "code")], "file string, line int, text string")
    df = R.canonical(make({"line": 1}, {"line": 2, "rule": "FL002"}, {"line": 2, "rule": "FL012"}, {"line": 6, "rule": "FL012"},
            {"file": "b.cpp"}))
    assert sorted(got(R.inline_suppression(df, lines).where("suppressed"), "line", "rule")) == [(1, "FL001"), (2, "FL002"), (6, "FL012")]


def test_whole_pipeline_on_the_canary(spark):
    raw, facts = C.canary(spark)
    out = R.run(raw, facts).collect()
    fired = {r.rule for r in raw.collect()} | {r.rule for r in out}
    assert {"FL001", "FL002", "FL003", "FL090", "FL092", "FL061", "FL060", "B001"} <= fired
    assert all(r.claims or r.rule == "B001" for r in out)
    ranks = [r.severity for r in out]
    assert ranks == sorted(ranks, reverse=True)
    assert [tuple(r) for r in R.run(raw.repartition(7), facts).collect()] == [tuple(r) for r in out]
    assert R.run(raw, facts).where(F.col("severity") > S.supported_severity(F.col("claims"))).count() == 0


def test_every_rule_fires(spark):
    from strideway.plans import rules

    raw, _ = C.canary(spark)
    assert {r.rule for r in raw.select("rule").distinct().collect()} == set(rules.RULES)


def test_clean_records_stay_clean(spark):
    raw, _ = C.canary(spark)
    assert raw.where(R.ev("type_name") == "CompactOrder").count() == 0


def test_few_marks_do_not_shuffle_findings(spark, make):
    lines = spark.createDataFrame([("a.cpp", 1, "x // hazard-suppress FL001")], "file string, line int, text string")
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = R.inline_suppression(make({}, {"line": 9}), lines)
        assert "BroadcastHashJoin" in out._jdf.queryExecution().toString()
        assert sorted(got(out, "line", "suppressed")) == [(1, True), (9, False)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
