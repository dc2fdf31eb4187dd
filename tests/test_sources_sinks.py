"""Readers on small files, sinks on small findings."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from strideway import schemas as S
from strideway.operators import calls, merge
from strideway.plans import catalog_facts as C
from strideway.plans import feedback
from strideway.plans import reduce as R
from strideway.sources import facts, sinks

RECORD = {
    "src": "a.cpp", "exitCode": 0, "unknown": {"x": 1}, "failedTUs": [{"file": "z.cpp", "error": "fatal error: 'h.h'"}],
    "diagnostics": [{"ruleID": "FL001", "title": 'a "quoted"\nline', "severity": "High", "confidence": 0.7, "evidenceTier": "proven",
            "location": {"file": "a.h", "line": 3, "column": 1}, "functionName": "", "structuralEvidence": {"sizeof": "352B"},
            "escalations": ["e"], "hot": 4, "mc": [{"e": "x", "p": "y", "k": 1, "g": 0, "s": "High"}]}, {"title": "no rule"}],
    "escapeSummary": {"T": {"a": 1, "n": 2}},
        "threadRoles": {"entries": ["f"], "edges": {"main": ["f", "g"]}, "fieldWriters": {"T::x": ["f"]}, "edgeDepth": {"main": {"f": 2}},
        "ownDepth": {"f": 1}, "overridden": ["A::f"]},
    "striped": {"k": {"n": "arr", "t": "", "f": "a.cpp", "l": 9, "es": 8, "ec": 64, "al": 64, "at": 0, "vo": 0, "st": 1, "tls": 1, "hp": 0,
            "wt": 3, "w": ["f"], "ag": []}}, "cov": {"fs": 2000, "fh": 3, "rs": 5},
}


def write(path, *lines):
    path.write_text("\n".join(lines))
    return str(path)


def test_shards(spark, tmp_path):
    path = write(tmp_path / "s.ndjson", json.dumps(RECORD), "not json", json.dumps(RECORD | {"src": "b.cpp"}), json.dumps(RECORD)[:200])
    good, bad = facts.shards(spark, path)
    assert sorted(r.src for r in good.collect()) == ["a.cpp", "b.cpp"] and bad.count() == 2
    t = facts.facts_of(good)
    assert {(r.src, r.dst, r.loop_depth) for r in t["edges"].collect()} == {("main", "f", 2), ("main", "g", 0)}
    assert R.merged_signals(t["signals"]).first().accessors == 4 and t["coverage"].first().functions == 4000
    found = facts.findings_of(good).collect()
    assert len(found) == 2 and found[0].title == 'a "quoted"\nline' and found[0].severity == S.HIGH and found[0].claims[0].established
    assert facts.findings_of(good).schema.simpleString() == spark.createDataFrame([], S.FINDING).schema.simpleString()
    planned = spark.createDataFrame([("a.cpp",), ("lost.cpp",)], "file string")
    assert [r.file for r in facts.accounted(planned, good).collect()] == ["lost.cpp"]
    out = R.run(facts.findings_of(good),
        R.Facts(**{k: t[k] for k in ("signals", "edges", "own_depth", "entries", "writers", "overridden", "striped")}))
    assert {r.rule for r in out.collect()} == {"FL001", "FL003"}
    facts.write_shards(good, str(tmp_path / "again"))
    assert facts.shards(spark, str(tmp_path / "again"))[0].count() == 2


def test_compile_db(spark, tmp_path):
    (tmp_path / "build").mkdir()
    write(tmp_path / "build/compile_commands.json",
        json.dumps([{"directory": "/w", "file": "src/a.c",
                    "arguments": ["cc", "-Iinc", "-I", "more", "-include", "x.h", "-isystem", "/abs"]},
                {"directory": "/w", "file": "/x/b.c", "command": "cc -c b.c"}]))
    assert facts.find_compile_db(str(tmp_path)).endswith("build/compile_commands.json") and facts.find_compile_db(str(tmp_path / "build/none")) is None
    rows = {r.file: r.arguments for r in facts.compile_db(spark, facts.find_compile_db(str(tmp_path))).collect()}
    assert rows == {"/w/src/a.c": ["cc", "-I/w/inc", "-I", "/w/more", "-include", "x.h", "-isystem", "/abs"], "/x/b.c": ["cc", "-c", "b.c"]}


def test_profiles(spark, tmp_path):
    flat = write(tmp_path / "flat", "# head", "operator new(int) 30", "f 60", "f 10", "bad x")
    assert {r.name: (r.samples, r.pct) for r in facts.profile(spark, flat, 10).collect()} == {"operator new(int)": (30, 30.0),
        "f": (70, 70.0)}
    script = write(tmp_path / "script", "app 12 1.5: cycles:", "  7f00 hot+0x1f (app)", "  7f01 [unknown]+0x2 (x)", "  7f00 hot+0x2 (app)")
    assert {r.name: r.samples for r in facts.profile(spark, script).collect()} == {"hot": 2}


def test_traces_and_priors(spark, tmp_path):
    path = write(tmp_path / "t.tsv", "# c", "f\ta.c\t1\tMEM_LOAD_RETIRED.L3_MISS\t90000\t1000000000", "f\ta.c\t1\tX\t5",
        "g\tb.c\t2\tMEM_LOAD_RETIRED.L3_MISS\t1\t1000000000", "f\ta.c\t1\tX\t5", "short\trow")
    trace = facts.pmu_trace(spark, path)
    assert trace.select("record").distinct().count() == 3 and trace.count() == 4
    raw, _ = C.canary(spark)
    found = R.canonical(raw.where("rule = 'FL001'").limit(1).withColumns({"file": F.lit("a.c"), "line": F.lit(1)}))
    assert {(r.cls, r.verdict) for r in feedback.trace_verdicts(found, trace).collect()} == {("CacheGeometry", "Positive")}
    priors = feedback.updated_priors(feedback.trace_verdicts(found, trace))
    assert [(r.cls, round(r.prior, 4), r.n) for r in priors.collect()] == [("CacheGeometry", 0.6667, 1)]
    assert [(r.tpr, r.fpr) for r in priors.collect()] == [(1.0, 0.0)]
    facts.write_priors(priors, str(tmp_path / "p"))
    assert facts.priors(spark, str(tmp_path / "p")).first().confirmed == 1


def test_binary_and_write_traces(spark, tmp_path):
    (tmp_path / "b.bin").write_bytes(struct.pack("<6Q", 5, 9, 9, 5, 2**63, 2**63 + 7) + b"xx")
    assert [(int(r.t0), int(r.t1)) for r in facts.latency_samples(spark, str(tmp_path / "b.bin")).collect()] == [(5, 9), (2**63, 2**63 + 7)]
    writes, allocs, heads = facts.write_trace(spark, write(tmp_path / "w", "# base 0x400000", "0x1000\t8\t3\t2\t100", "@ 0x2000\t40\tnew"))
    assert tuple(writes.first()) == (4096, 8, 3, 2, 100) and tuple(allocs.first()) == (8192, 64,
        "new") and heads.first().value == "0x400000"
    sym = facts.symbols(spark, write(tmp_path / "sym", "0000000000001000 0000000000000010 B g_a", "0000000000001010 0000000000000000 D g_b",
            "0000000000002000 0000000000000010 T code"))
    at = spark.createDataFrame([(0x1008,), (0x1010,), (0x1011,), (0xFFF,)], "address bigint")
    assert {r.address: r.symbol for r in facts.symbol_of(at, sym).collect()} == {0x1008: "g_a", 0x1010: "g_b", 0x1011: None, 0xFFF: None}


def test_store(tmp_path):
    store = facts.CalibrationStore(str(tmp_path / "d/store.json"))
    assert store.load()["records"] == []
    store.save(store.load() | {"records": [1]})
    assert store.load()["records"] == [1]
    (tmp_path / "d/store.json").write_text("{")
    with pytest.raises(ValueError):
        store.load()
    (tmp_path / "d/store.json").write_text('{"version": 2}')
    with pytest.raises(ValueError):
        store.load()


def test_config(tmp_path):
    path = write(tmp_path / "c.yaml", "# x", "cache_line_bytes: 128", "hot_function_patterns:", "  - 'on*'", '  - "x"',
        "smt_enabled: false", "hotness_threshold_pct: 2", "tick_path_patterns: [a*, b]", "disabled_rules:")
    want = {"cache_line_bytes": 128, "hot_function_patterns": ["on*", "x"], "smt_enabled": False, "hotness_threshold_pct": 2.0,
        "tick_path_patterns": ["a*", "b"]}
    assert facts.config(path) == facts.DEFAULTS | want
    assert facts.config(write(tmp_path / "c.json", '{"page_size": 8192}'))["page_size"] == 8192
    apple = facts.config(write(tmp_path / "a.yaml", "target_arch: arm64-apple", "cache_line_span_crit: 512"))
    assert (apple["cache_line_bytes"], apple["cache_line_span_warn"], apple["cache_line_span_crit"]) == (128, 128, 512)
    for bad in ("65", "4", "8192"):
        with pytest.raises(ValueError):
            facts.config(write(tmp_path / "bad", f"cache_line_bytes: {bad}"))
    for odd in ("smt: true", "page_size: many", "target_arch: vax", "json_output: 3", "just words"):
        with pytest.warns(UserWarning):
            assert facts.config(write(tmp_path / "odd", odd)) == facts.DEFAULTS
    with pytest.warns(UserWarning):
        assert facts.config(str(tmp_path / "nowhere")) == facts.DEFAULTS


def test_records_round_trip(spark, tmp_path):
    """Findings and facts written as unit records give the same ones when read."""
    raw, merged = C.canary(spark)
    unit = lambda df, u="u.cpp": df.withColumn("src", F.lit(u))
    edges = merged.edges.select(F.lit("u.cpp").alias("src"), F.col("src").alias("caller"), "dst", "loop_depth")
    tables = {"signals": unit(merged.signals), "edges": edges, "own_depth": unit(merged.own_depth), "entries": unit(merged.entries),
        "writers": unit(merged.writers), "overridden": unit(merged.overridden), "striped": unit(merged.striped),
        "failures": unit(merged.failures)}
    units = spark.createDataFrame([("u.cpp", 0), ("empty.cpp", 2)], "src string, exitCode int")
    facts.write_shards(facts.records_of(unit(raw), tables, units), str(tmp_path / "r"))
    records, bad = facts.shards(spark, str(tmp_path / "r"))
    assert bad.count() == 0 and {(r.src, r.exitCode) for r in records.collect()} == {("u.cpp", 0), ("empty.cpp", 2)}
    rows = lambda df: sorted((str(sorted(r.asDict(recursive=True).items(), key=str)) for r in df.collect()))
    assert rows(facts.findings_of(records)) == rows(raw)
    again = facts.facts_of(records)
    for name, df in (("signals", merged.signals), ("edges", merged.edges), ("own_depth", merged.own_depth), ("entries", merged.entries),
        ("writers", merged.writers), ("overridden", merged.overridden), ("striped", merged.striped), ("failures", merged.failures)):
        assert rows(again[name]) == rows(df), name


def test_a_million_samples(spark, tmp_path):
    import time

    import numpy as np

    t0 = np.arange(1_000_000, dtype="<u8") * 10
    (tmp_path / "many.bin").write_bytes(np.stack([t0, t0 + 1 + t0 % 3], axis=1).tobytes())
    began = time.perf_counter()
    got = facts.latency_samples(spark, str(tmp_path / "many.bin")).agg(F.count("*"), F.sum(F.col("t1") - F.col("t0"))).first()
    assert got[0] == 1_000_000 and int(got[1]) == int((1 + t0 % 3).sum()) and time.perf_counter() - began < 30


def test_hypothesis_sinks(spark):
    raw, _ = C.canary(spark)
    h = calls.hypotheses(raw)
    doc = json.loads(sinks._text(sinks.hypothesis_rows(h, raw.count())))
    known = h.where("metric IS NOT NULL")
    assert doc["totalDiagnostics"] == raw.count() and doc["hypothesesGenerated"] == len(doc["hypotheses"]) == known.count()
    files = sinks.experiment_rows(h).collect()
    assert {r.file for r in files} == {"plan.txt", "hypothesis.json"} and len(files) == 2 * known.count()


def test_documents_in_parts(spark, tmp_path):
    """What several tasks write is the document, file after file."""
    raw, _ = C.canary(spark)
    sinks.write_rows(sinks.json_rows(raw.repartition(5)), str(tmp_path / "doc"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "doc").glob("part-*")))
    assert len(json.loads(text)["diagnostics"]) == raw.count()

    @sinks.sink("count")
    def count(df):
        return df.agg(F.lit(0).cast("bigint").alias("ord"), F.count("*").cast("string").alias("value"))

    assert sinks.written(raw, "count") == str(raw.count())
    with pytest.raises(ValueError):
        sinks.written(raw, "none")


def test_results(spark, tmp_path):
    raw, _ = C.canary(spark)
    text = sinks.json_document(raw, {"n": 1})
    doc = json.loads(text)
    assert len(doc["diagnostics"]) == raw.count() and doc["metadata"] == {"n": 1}
    path = write(tmp_path / "r.json", text)
    again = facts.scan_result(spark, path)
    assert again.count() == raw.count()
    with pytest.raises(ValueError):
        facts.scan_result(spark, write(tmp_path / "h.json", '{"diagnostics": [{"title": "x"}]}'))
    changed = again.where("rule <> 'FL001'").unionByName(again.where("rule = 'FL002'"))
    changes = feedback.diff(again, changed)
    kinds = {r.change: r["count"] for r in changes.groupBy("change").count().collect()}
    assert kinds["resolved"] == again.where("rule = 'FL001'").count() and kinds["new"] == again.where("rule = 'FL002'").count()
    assert feedback.diff_exit(changes) == 1 and feedback.diff_exit(feedback.diff(again, again)) == 0


def test_formats(spark):
    raw, _ = C.canary(spark)
    odd = raw.limit(1).withColumns({"confidence": F.lit(float("nan")), "severity": F.lit(S.CRITICAL), "line": F.lit(0),
            "title": F.lit('q"\\\n'), "reasoning": F.lit("First. Second."), "escalations": F.array(F.lit("one"), F.lit("two"))})
    doc = json.loads(sinks.json_document(odd))
    assert doc["diagnostics"][0]["confidence"] == 0.0 and doc["diagnostics"][0]["title"] == 'q"\\\n'
    log = json.loads(sinks.sarif(raw))
    run = log["runs"][0]
    ids = [r["id"] for r in run["tool"]["driver"]["rules"]]
    assert len(run["results"]) == raw.count() and all(ids[r["ruleIndex"]] == r["ruleId"] for r in run["results"])
    seen = list(dict.fromkeys(r["ruleId"] for r in run["results"]))
    assert seen == ids
    assert json.loads(sinks.sarif(odd))["runs"][0]["results"][0]["locations"][0]["physicalLocation"]["region"] == {"startLine": 1,
        "startColumn": 1}
    lines = sinks.written(odd, "tidy").split("\n")
    assert lines[0].endswith(f"error: First. [{odd.first().rule}]") and [x.split("note: ")[1] for x in lines[1:]] == ["one", "two"]
    assert sinks.written(raw.where("rule = 'FL012'").limit(1), "cli").endswith("(75%, proven)")


def test_cache_works_out_only_what_is_new(spark, tmp_path):
    from strideway.sources import cache

    units = spark.createDataFrame([("a", "x"), ("b", None), ("c", "z")], "name string, content string").withColumn("key",
        cache.content_key(F.col("name"), F.col("content")))
    seen = []

    def compute(df):
        seen.append(sorted(r.name for r in df.collect()))
        return df.select("key", F.upper("name").alias("out"))

    path = str(tmp_path / "cache")
    assert [r.out for r in cache.cached(units.where("name = 'a'"), path, compute).collect()] == ["A"]
    assert sorted(r.out for r in cache.cached(units, path, compute).collect()) == ["A", "B", "C"]
    assert sorted(r.out for r in cache.cached(units.where("name <> 'a'"), path, compute).collect()) == ["B", "C"]
    assert seen == [["a"], ["b", "c"], []]
    assert units.select("key").distinct().count() == 3


def test_progress(spark):
    told = []
    raw, merged = C.canary(spark)
    R.run(raw, merged, progress=lambda stage, detail: told.append(stage))
    assert told == ["merge", "roles", "deduplicate", "interactions", "budget"]


def test_missing_units_are_not_clean(spark):
    planned = spark.createDataFrame([("a",), ("b",)], "file string")
    lost = merge.unaccounted(planned, planned.where("file = 'a'"), ["file"], "gone")
    assert [tuple(r) for r in lost.collect()] == [("b", "gone")]
    assert R.status(0, lost.count()) == 2 and R.status(1, 1) == 1 and R.status(0, 0) == 0
