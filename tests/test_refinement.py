"""Which profile refines a finding, against the reference's rules on small names, and the step within the pipeline."""

import pytest
from test_reduce import BASE, NAMES

from strideway import schemas as S
from strideway.operators import calls
from strideway.plans import reduce as R

FIELDS = [x.split()[0] for x in S.PROFILE.split(", ")]


def profiles(spark, *rows):
    zero = {f: [] if f.endswith("_lines") else 0 for f in FIELDS} | {"file": ""}
    return spark.createDataFrame([tuple((zero | r)[f] for f in FIELDS) for r in rows], S.PROFILE)


def findings(spark, *rows):
    return spark.createDataFrame([tuple((BASE | r)[n] for n in NAMES) for r in rows], S.FINDING)


@pytest.mark.parametrize(
    ("name", "place", "want"),
    [
        ("_Zb", ("", 0), "_Zb"), ("ns::f(int)", ("", 0), "_Zc"), ("ns::f", ("", 0), "_Zb"), ("f", ("", 0), "_Za"), ("s::f", ("", 0), None),
            ("g", ("", 0), "_Zd"), ("V<int>::push", ("", 0), "_Ze"), ("V", ("", 0), "_Ze"), ("A::operator()", ("", 0), "_Zf"),
        ("ns::(anonymous namespace)::f", ("", 0), "_Zb"), ("(anonymous namespace)::hid", ("", 0), "_Zg"), ("", ("/src/x/a.cpp", 7), "_Zh"),
            ("nowhere", ("a.cpp", 7), "_Zh"), ("", ("/src/yx/a.cpp", 7), None), ("", ("/src/x/a.cpp", 8), None), ("a.b", ("", 0), None),
    ],
)
def test_ranks(spark, name, place, want):
    of = lambda m, d, **kw: {"mangled": m, "demangled": d} | kw
    p = profiles(
        spark, of("_Zc", "ns::f(int)"), of("_Zb", "ns::f(long)"), of("_Za", "other::f()"), of("_Zd", "ns::g<ns::f>(int)"),
            of("_Ze", "V<int>::push(int&&)"), of("_Zf", "A::operator()(int) const"),
        of("_Zg", "(anonymous namespace)::hid(int)"), of("_Zh", "made()", file="x/a.cpp", line=7),
            of("_Zi", "made2()", file="x/a.cpp", line=7), of("_Zj", "aXb()"),
    )
    wanted = spark.createDataFrame([(name, *place)], "name string, file string, line int")
    assert [r.mangled for r in calls.resolved_profiles(wanted, p).collect()] == [want]


def test_run_refines(spark):
    raw = findings(
        spark, {"rule": "FL010", "fn": "ns::f", "line": 3}, {"rule": "FL021", "fn": "ns::f", "line": 4, "evidence": {"threshold": "2048B"}},
            {"rule": "FL030", "fn": "ns::f", "line": 5, "confidence": 0.8}, {"rule": "FL020", "fn": "ns::f", "line": 6},
            {"rule": "FL012", "fn": "unknown", "line": 9},
        {"rule": "FL031", "fn": "", "file": "src/d.cpp", "line": 8}, {"rule": "FL010", "fn": "plain", "line": 7},
            {"rule": "FL090", "line": 20},
    )
    p = profiles(spark, {"mangled": "_ZN2ns1fEi", "demangled": "ns::f(int)", "site_lines": [3], "seq_csts": 1, "atomics": 1,
            "atomic_writes": 1, "calls": 2, "frame": 64},
        {"mangled": "_Zd", "demangled": "d()", "file": "d.cpp", "line": 8, "indirect_calls": 1}, {"mangled": "_Zp", "demangled": "plain()"})
    out = {(r.rule, r.line): r for r in R.run(raw, R.Facts(profiles=p)).collect()}
    assert ("FL021", 4) not in out
    assert out["FL010", 3].confidence == pytest.approx(0.80) and out["FL010", 3].tier == S.PROVEN
    assert out["FL030", 5].confidence == pytest.approx(0.55) and out["FL020", 6].confidence == pytest.approx(0.55)
    assert out["FL031", 8].confidence == pytest.approx(0.80)
    assert out["FL012", 9].confidence == pytest.approx(0.7) and out["FL010", 7].confidence == pytest.approx(0.7)
    assert out["FL090", 20].escalations == ["lowered code: 1 atomic writes, 0 fences, 1 indirect calls in all"]
