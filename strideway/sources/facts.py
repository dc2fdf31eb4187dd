"""Readers: text, JSON and binary files to fact tables. Malformed rows are kept apart, never lost silently."""

from __future__ import annotations

import json
import os
import re
import warnings
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideway import schemas as S
from strideway.functions import text
from strideway.operators import ranking

CLAIM = "struct<e:string,p:string,k:int,g:int,s:string>"
DIAGNOSTIC = (
    "struct<ruleID:string,title:string,severity:string,confidence:double,evidenceTier:string,suppressed:boolean,location:struct<file:string,line:int,column:int>,functionName:string,"
    f"hardwareReasoning:string,structuralEvidence:map<string,string>,mitigation:string,escalations:array<string>,hot:int,mc:array<{CLAIM}>>"
)
#: One unit's record, with its short keys.
SHARD = (
    f"src string, exitCode int, failedTUs array<struct<file:string,error:string>>, diagnostics array<{DIAGNOSTIC}>, "
    "escapeSummary map<string,struct<a:int,s:int,o:int,v:int,p:int,tw:int,gi:int,tb:int,sw:int,l:int,n:int>>, "
    "threadRoles struct<entries:array<string>,edges:map<string,array<string>>,fieldWriters:map<string,array<string>>,edgeDepth:map<string,map<string,int>>,ownDepth:map<string,int>,overridden:array<string>>, "
    "striped map<string,struct<n:string,t:string,f:string,l:int,es:bigint,ec:bigint,al:bigint,at:int,vo:int,st:int,tls:int,hp:int,wt:int,w:array<string>,ag:array<string>>>, "
    "cov struct<fs:bigint,fh:bigint,rs:bigint>"
)
BUILD_DIRS = ["build", ".", "out", "cmake-build-debug", "cmake-build-release", "out/build", "build/debug", "build/release"]


def find_compile_db(root: str) -> str | None:
    """The first ``compile_commands.json`` of the usual build folders."""
    for d in BUILD_DIRS:
        path = os.path.normpath(os.path.join(root, d, "compile_commands.json"))
        if os.path.isfile(path):
            return path
    return None


def compile_db(spark: SparkSession, path: str) -> DataFrame:
    """(file, directory, arguments) with absolute paths, one row a unit."""
    raw = spark.read.schema("directory string, file string, command string, arguments array<string>").json(path, multiLine=True)
    args = F.coalesce("arguments", F.filter(F.split(F.coalesce("command", F.lit("")), r"\s+"), lambda a: a != ""))
    return raw.where("file IS NOT NULL").select(text.absolute(F.col("file"), F.col("directory")).alias("file"), "directory",
        text.absolute_arguments(args, F.col("directory")).alias("arguments"))


def shards(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Unit records, and (line, reason) of the lines that are none. Unknown keys are passed over; a torn last line fails to parse."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = lines.withColumn("r", F.from_json("value", SHARD, {"mode": "PERMISSIVE"})).withColumn("ok",
        F.col("value").rlike(r"\}\s*$") & F.col("r.src").isNotNull())
    return parsed.where("ok").select("r.*"), parsed.where("NOT ok").select(F.col("value").alias("line"),
        F.lit("the record does not parse").alias("reason"))


def records_of(findings: DataFrame, tables: dict[str, DataFrame], units: DataFrame | None = None) -> DataFrame:
    """Unit records (``SHARD``) from findings and fact tables that carry their unit in ``src``; the inverse of ``findings_of`` and ``facts_of``.

    ``tables``: signals, edges, own_depth, entries, writers, overridden, striped, failures, coverage, any of them missing. ``units`` (src,
    exitCode) lists units that may have neither.
    """
    spark = findings.sparkSession
    flag = lambda c: F.when(F.col(c), 1).otherwise(0)
    claims = F.transform("claims", lambda c: F
        .struct(c["effect"].alias("e"), c["precondition"].alias("p"), c["established"].cast("int").alias("k"),
            c["gating"].cast("int").alias("g"), S.name_of(S.SEVERITIES, c["supports"]).alias("s")))
    place = F.struct("file", "line", F.col("col").alias("column"))
    one = F.struct(
        F.col("rule").alias("ruleID"), "title", S.name_of(S.SEVERITIES, F.col("severity")).alias("severity"), "confidence",
            S.name_of(S.TIERS, F.col("tier")).alias("evidenceTier"), "suppressed", place.alias("location"),
            F.col("fn").alias("functionName"),
        F.col("reasoning").alias("hardwareReasoning"), F.col("evidence").alias("structuralEvidence"), "mitigation", "escalations",
            F.col("hotness").alias("hot"), claims.alias("mc"),
    )
    parts = [findings.groupBy("src").agg(F.collect_list(one).alias("diagnostics"))]
    short = dict(zip(S.SIGNAL_FLAGS, ["a", "s", "o", "v", "p", "tw", "gi", "tb", "sw", "l"]))
    as_map = lambda key, value: F.map_from_entries(F.collect_list(F.struct(key, value)))
    names = lambda c: F.array_sort(F.collect_set(c))
    t = tables
    if "signals" in t:
        parts.append(t["signals"].groupBy("src")
            .agg(as_map(F.col("type"), F.struct(*(flag(f).alias(k) for f, k in short.items()), F.col("accessors").alias("n")))
                .alias("escapeSummary")))
    if "edges" in t:
        deep = F.map_from_entries(F.collect_list(F.when(F.col("loop_depth") > 0, F.struct("dst", "loop_depth"))))
        by = t["edges"].groupBy("src", F.col("caller")).agg(names("dst").alias("dsts"), deep.alias("deep"))
        parts.append(by.groupBy("src").agg(as_map(F.col("caller"), F.col("dsts")).alias("__edges"),
                F.map_from_entries(F.collect_list(F.when(F.size("deep") > 0, F.struct("caller", "deep")))).alias("__depths")))
    for name, column, alias in (("entries", "fn", "__entries"), ("overridden", "fn", "__overridden")):
        if name in t:
            parts.append(t[name].groupBy("src").agg(names(column).alias(alias)))
    if "own_depth" in t:
        parts.append(t["own_depth"].groupBy("src").agg(as_map(F.col("fn"), F.col("depth")).alias("__own")))
    if "writers" in t:
        by = t["writers"].groupBy("src", "field").agg(names("writer").alias("ws"))
        parts.append(by.groupBy("src").agg(as_map(F.col("field"), F.col("ws")).alias("__writers")))
    if "striped" in t:
        x = F.struct(
            F.col("name").alias("n"), F.col("type").alias("t"), F.col("file").alias("f"), F.col("line").alias("l"),
                F.col("elem_size").alias("es"), F.col("elem_count").alias("ec"), F.col("decl_align").alias("al"),
                flag("atomic").alias("at"), flag("volatile").alias("vo"),
            flag("static").alias("st"), flag("tls").alias("tls"), flag("head_pad").alias("hp"), F.col("writer_tier").alias("wt"),
                F.col("writers").alias("w"), F.col("aggregators").alias("ag"),
        )
        parts.append(t["striped"].groupBy("src").agg(as_map(F.col("key"), x).alias("striped")))
    if "failures" in t:
        parts.append(t["failures"].groupBy("src").agg(F.collect_list(F.struct("file", "error")).alias("failedTUs")))
    if "coverage" in t:
        parts.append(t["coverage"].groupBy("src")
            .agg(F.struct(F.sum("functions").alias("fs"), F.sum("hot").alias("fh"), F.sum("records").alias("rs")).alias("cov")))
    out = units.select("src", "exitCode") if units is not None else None
    for p in parts:
        out = p if out is None else out.join(p, "src", "full_outer")
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], SHARD).schema}
    roles = kinds["threadRoles"]
    held = {"entries": "__entries", "edges": "__edges", "fieldWriters": "__writers", "edgeDepth": "__depths", "ownDepth": "__own",
        "overridden": "__overridden"}
    col = lambda c, kind: (F.col(c) if c in out.columns else F.lit(None)).cast(kind)
    thread_roles = F.struct(*(col(c, roles[n].dataType).alias(n) for n, c in held.items()))
    exit_code = F.coalesce(col("exitCode", "int"), F.lit(0))
    return out.select(*(exit_code.alias(n) if n == "exitCode" else thread_roles.alias(n) if n == "threadRoles" else col(n, k).alias(n)
            for n, k in kinds.items()))


def write_shards(records: DataFrame, path: str) -> None:
    """One line a record, with short keys."""
    records.write.mode("overwrite").json(path)


def findings_of(diagnostics: DataFrame) -> DataFrame:
    """Findings (``schemas.FINDING``) from rows of a ``diagnostics`` array."""
    d = diagnostics.select(F.inline("diagnostics")).where(F.coalesce(F.col("ruleID"), F.lit("")) != "")
    claims = F.transform(F.coalesce("mc", F.array().cast(f"array<{CLAIM}>")),
        lambda c: F.struct(c["e"].alias("effect"), c["p"].alias("precondition"), (c["k"] == 1).alias("established"),
            S.ordinal_of(S.SEVERITIES, c["s"]).alias("supports"), (F.coalesce(c["g"], F.lit(0)) == 1).alias("gating")))
    none = F.create_map().cast("map<string,string>")
    return d.select(
        F.col("ruleID").alias("rule"), F.coalesce("title", F.lit("")).alias("title"),
            F.coalesce(S.ordinal_of(S.SEVERITIES, F.col("severity")), F.lit(S.INFO)).alias("severity"),
            F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce(S.ordinal_of(S.TIERS, F.col("evidenceTier")), F.lit(S.SPECULATIVE)).alias("tier"),
            F.coalesce("suppressed", F.lit(False)).alias("suppressed"), F.coalesce("location.file", F.lit("")).alias("file"),
            F.coalesce("location.line", F.lit(0)).alias("line"),
        F.coalesce("location.column", F.lit(0)).alias("col"), F.coalesce("functionName", F.lit("")).alias("fn"),
            F.coalesce("hardwareReasoning", F.lit("")).alias("reasoning"), F.coalesce("structuralEvidence", none).alias("evidence"),
            F.coalesce("mitigation", F.lit("")).alias("mitigation"),
        F.coalesce("escalations", F.array().cast("array<string>")).alias("escalations"), F.coalesce("hot", F.lit(S.COLD)).alias("hotness"),
            claims.alias("claims"),
    )


def facts_of(records: DataFrame) -> dict[str, DataFrame]:
    """The fact tables inside unit records: signals, edges, own_depth, entries, writers, overridden, striped, coverage, failures."""
    is_ = lambda c: F.coalesce(F.col(c) == 1, F.lit(False))
    flags = dict(zip(S.SIGNAL_FLAGS, ["a", "s", "o", "v", "p", "tw", "gi", "tb", "sw", "l"]))
    signals = records.select(F.explode("escapeSummary").alias("type", "x")).select("type",
        *(is_(f"x.{k}").alias(f) for f, k in flags.items()), F.col("x.n").alias("accessors"))
    # callees and depths of a record are laid side by side: no row carries its record, and none looks through it
    callers = F.concat(
        F.transform(F.coalesce(F.map_entries("threadRoles.edges"), F.array()),
            lambda e: F.struct(e["key"].alias("src"), e["value"].alias("dsts"), F.lit(None).cast("map<string,int>").alias("deep"))),
        F.transform(F.coalesce(F.map_entries("threadRoles.edgeDepth"), F.array()),
            lambda e: F.struct(e["key"].alias("src"), F.lit(None).cast("array<string>").alias("dsts"), e["value"].alias("deep"))))
    edges = records.withColumn("__unit", F.monotonically_increasing_id()).select("__unit", F.inline(callers))
    callees = F.concat(
        F.transform(F.coalesce("dsts", F.array()), lambda d: F.struct(d.alias("dst"), F.lit(None).cast("int").alias("depth"))),
        F.transform(F.coalesce(F.map_entries("deep"), F.array()), lambda e: F.struct(e["key"].alias("dst"), e["value"].alias("depth"))))
    edges = edges.select("__unit", "src", F.col("dsts").isNotNull().alias("called"), F.inline(callees))
    edges = edges.groupBy("__unit", "src", "dst").agg(F.bool_or("called").alias("called"), F.coalesce(F.max("depth"), F.lit(0)).alias("loop_depth")).where("called")
    striped = records.select(F.explode("striped").alias("key", "x")).select(
        "key", F.col("x.n").alias("name"), F.col("x.t").alias("type"), F.col("x.f").alias("file"), F.col("x.l").alias("line"),
            F.col("x.es").alias("elem_size"), F.col("x.ec").alias("elem_count"), F.col("x.al").alias("decl_align"),
            is_("x.at").alias("atomic"), is_("x.vo").alias("volatile"),
        is_("x.st").alias("static"), is_("x.tls").alias("tls"), is_("x.hp").alias("head_pad"), F.col("x.wt").alias("writer_tier"),
            F.col("x.w").alias("writers"), F.col("x.ag").alias("aggregators"),
    )
    return {
        "signals": signals,
        "edges": edges.groupBy("src", "dst").agg(F.max("loop_depth").alias("loop_depth")),
        "own_depth": records.select(F.explode("threadRoles.ownDepth").alias("fn", "depth")),
        "entries": records.select(F.explode("threadRoles.entries").alias("fn")).distinct(),
        "writers": records.select(F.explode("threadRoles.fieldWriters").alias("field", "ws"))
            .select("field", F.explode("ws").alias("writer")).distinct(),
        "overridden": records.select(F.explode("threadRoles.overridden").alias("fn")).distinct(),
        "striped": striped,
        "failures": records.select(F.inline("failedTUs")),
        "coverage": records.agg(*(F.coalesce(F.sum(f"cov.{k}"), F.lit(0)).alias(n) for k,
                n in (("fs", "functions"), ("fh", "hot"), ("rs", "records")))),
    }


def scan_result(spark: SparkSession, path: str) -> DataFrame:
    """Findings of a result file. Raises ValueError if it has rows but none with a rule, as other kinds of file do."""
    raw = spark.read.schema(f"diagnostics array<{DIAGNOSTIC}>").json(path, multiLine=True)
    found = findings_of(raw.where("diagnostics IS NOT NULL"))
    if found.isEmpty() and not raw.where("size(diagnostics) > 0").isEmpty():
        raise ValueError(f"no finding in {path} has a rule")
    return found


def profile(spark: SparkSession, path: str, percent: float = 0.0) -> DataFrame:
    """(name, samples, pct) of a profile, flat (``name count``) or as a script of stacks (``addr symbol+0x..``), told apart by its head."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> '' AND NOT startswith(v, '#')")
    head = [r.v for r in lines.limit(10).collect()]
    script = any(":" in h for h in head) and any("+" in h for h in head)
    if script:
        named = lines.select(F.regexp_extract("v", r"(\S+)\+0x[0-9a-f]+", 1).alias("name"),
            F.lit(1).alias("n")).where("name <> '' AND NOT startswith(name, '[')")
    else:
        named = lines.select(F.regexp_extract("v", r"^(.*)\s(\S+)$", 1).alias("name"),
            F.regexp_extract("v", r"^(.*)\s(\S+)$", 2).try_cast("bigint").alias("n")).where("name <> '' AND n IS NOT NULL")
    by = named.groupBy("name").agg(F.sum("n").cast("bigint").alias("samples"))
    total = F.broadcast(by.agg(F.sum("samples").alias("__t")))  # one row
    return by.crossJoin(total).select("name", "samples",
        (100.0 * F.col("samples") / F.col("__t")).alias("pct")).where(F.col("pct") >= percent)


def pmu_trace(spark: SparkSession, path: str) -> DataFrame:
    """(record, fn, file, line, counter, value, duration_ns); consecutive rows of one function and line form a record."""
    raw = spark.read.text(path).select("value", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("seq"))
    c = F.split("value", "\t")
    rows = raw.where("NOT startswith(value, '#')").select("f", "seq", c.alias("c")).where("size(c) >= 5")
    rows = rows.select("f", "seq", F.col("c")[0].alias("fn"), F.col("c")[1].alias("file"), F.col("c")[2].try_cast("int").alias("line"),
        F.col("c")[3].alias("counter"), F.col("c")[4].try_cast("bigint").alias("value"),
        F.coalesce(F.get("c", F.lit(5)).try_cast("bigint"), F.lit(0)).alias("duration_ns"))
    out = ranking.split_islands(rows.where("value IS NOT NULL"), ["f"], "seq", ["fn", "line"], "record")
    return out.select(F.concat_ws("#", "f", "record").alias("record"), "fn", "file", "line", "counter", "value", "duration_ns")


def priors(spark: SparkSession, path: str) -> DataFrame:
    """(cls, prior, fpr, tpr, n, confirmed, refuted)."""
    c = F.split(F.trim("value"), r"\s+")
    kinds = {"cls": "string", "prior": "double", "fpr": "double", "tpr": "double", "n": "bigint", "confirmed": "bigint",
        "refuted": "bigint"}
    rows = spark.read.text(path).select(c.alias("c")).where("size(c) = 7")
    return rows.select(*(F.col("c")[i].try_cast(k).alias(n) for i, (n, k) in enumerate(kinds.items())))


def write_priors(df: DataFrame, path: str) -> None:
    """One file with sorted keys; a row a hazard class, so it is small."""
    df.orderBy("cls").select(F.concat_ws(" ", "cls", "prior", "fpr", "tpr", "n", "confirmed", "refuted")
        .alias("value")).coalesce(1).write.mode("overwrite").text(path)


class CalibrationStore:
    """Labelled records and refuted clusters in one versioned JSON file, replaced as a whole; an absent file is an empty store."""

    VERSION = 1

    def __init__(self, path: str) -> None:
        self.path = path

    def load(self) -> dict:
        if not os.path.exists(self.path):
            return {"version": self.VERSION, "records": [], "registry": []}
        with open(self.path, encoding="utf-8") as f:
            try:
                store = json.load(f)
            except ValueError as e:
                raise ValueError(f"{self.path} is corrupt") from e
        if not isinstance(store, dict) or store.get("version") != self.VERSION:
            raise ValueError(f"{self.path} is of another version")
        return store

    def save(self, store: dict) -> None:
        os.makedirs(os.path.dirname(os.path.abspath(self.path)), exist_ok=True)
        fresh = f"{self.path}.{os.getpid()}.tmp"
        with open(fresh, "w", encoding="utf-8") as f:
            json.dump(store | {"version": self.VERSION}, f, sort_keys=True)
        os.replace(fresh, self.path)


#: Pairs of ticks that are decoded and passed on together.
PAIRS = 1 << 19


def latency_samples(spark: SparkSession, path: str) -> DataFrame:
    """(path, t0, t1) of pairs of 64-bit little-endian ticks, where time passed; a trailing partial pair is dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                raw = content.as_buffer()
                pairs = np.frombuffer(raw, "<u8", count=2 * (len(raw) // 16)).reshape(-1, 2)
                for i in range(0, len(pairs), PAIRS):
                    part = pairs[i : i + PAIRS]
                    part = part[part[:, 1] > part[:, 0]]
                    high, low = [(part[:, k] >> np.uint64(32)).astype(np.int64)
                        for k in (0, 1)], [(part[:, k] & np.uint64(0xFFFFFFFF)).astype(np.int64) for k in (0, 1)]
                    cols = [pa.array([name.as_py()] * len(part), pa.string()), *(pa.array(x) for k in (0, 1) for x in (high[k], low[k]))]
                    yield pa.RecordBatch.from_arrays(cols, ["path", "h0", "l0", "h1", "l1"])

    halves = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run,
        "path string, h0 bigint, l0 bigint, h1 bigint, l1 bigint")
    word = lambda k: (F.col(f"h{k}").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)")
        + F.col(f"l{k}")).cast("decimal(20,0)")
    return halves.select("path", word(0).alias("t0"), word(1).alias("t1"))


def write_trace(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Writes (address, offset, mask, threads, writes), allocations (start, size, name) and headers (key, value) of a trace."""
    raw = spark.read.text(path).select("value", F.split("value", "\t").alias("c"))
    num = lambda i: F.conv(F.regexp_replace(F.col("c")[i], "^0[xX]", ""), 16, 10).cast("bigint")
    plain = raw.where("NOT startswith(value, '#') AND NOT startswith(value, '@') AND size(c) >= 5")
    writes = plain.select(num(0).alias("address"), num(1).alias("offset"), num(2).alias("mask"),
        F.col("c")[3].try_cast("int").alias("threads"), F.col("c")[4].try_cast("bigint").alias("writes"))
    allocs = raw.where("startswith(value, '@') AND size(c) >= 3").select(F
        .conv(F.regexp_replace(F.col("c")[0], "^@\\s*(0[xX])?", ""), 16, 10).cast("bigint").alias("start"), num(1).alias("size"),
        F.col("c")[2].alias("name"))
    heads = raw.where("startswith(value, '#')").select(F.regexp_extract("value", r"^#\s*(\S+)\s*(.*)$", 1).alias("key"),
        F.regexp_extract("value", r"^#\s*(\S+)\s*(.*)$", 2).alias("value"))
    return writes, allocs, heads


def symbols(spark: SparkSession, path: str) -> DataFrame:
    """(address, size, name) of data symbols in the rows of a symbol table."""
    r = r"^([0-9a-fA-F]+)\s+([0-9a-fA-F]+)\s+([bBdDrRsSvVwW])\s+(\S.*)$"
    rows = spark.read.text(path).where(F.col("value").rlike(r))
    return rows.select(F.conv(F.regexp_extract("value", r, 1), 16, 10).cast("bigint").alias("address"),
        F.conv(F.regexp_extract("value", r, 2), 16, 10).cast("bigint").alias("size"), F.regexp_extract("value", r, 4).alias("name"))


def symbol_of(addresses: DataFrame, table: DataFrame, address: str = "address") -> DataFrame:
    """Each address with the symbol that it lies in: the last one that begins at or before it, if it reaches so far.

    Symbols and addresses meet in blocks of 4 KiB; a symbol is listed in each block that it touches.
    """
    size = F.greatest("size", F.lit(1))
    sym = table.select(F.col("address").alias("__s"), size.alias("__n"), F.col("name").alias("symbol"))
    sym = sym.withColumn("__b", F.explode(F.sequence(F.floor(F.col("__s") / 4096), F.floor((F.col("__s") + F.col("__n") - 1) / 4096))))
    a = addresses.select(address).distinct().withColumn("__b", F.floor(F.col(address) / 4096))
    hit = a.join(sym, "__b").where((F.col("__s") <= F.col(address)) & (F.col(address) < F.col("__s") + F.col("__n")))
    best = hit.groupBy(address).agg(F.max(F.struct("__s", "symbol")).alias("m")).select(address, "m.symbol")
    return addresses.join(best, address, "left")


def changed_files(spark: SparkSession, path: str) -> DataFrame:
    """S17."""
    return spark.read.text(path).select(F.trim("value").alias("changed")).where("changed <> ''")


#: All settings with their defaults; a list may be given as one item.
DEFAULTS: dict = {
    "cache_line_bytes": 64, "cache_line_span_warn": 64, "cache_line_span_crit": 128, "stack_frame_warn_bytes": 2048,
        "alloc_size_escalation": 256, "branch_depth_warn": 4, "json_output": False, "output_file": "", "infer_hot_paths": True,
    "hot_function_patterns": [], "hot_file_patterns": [],
        "vendor_path_patterns": [f"*/{d}/*"
            for d in "deps third_party thirdparty third-party vendor external extern contrib node_modules subprojects"
        .split()], "skip_vendored": True, "numa_sockets": 0,
    "disabled_rules": [], "page_size": 4096, "perf_profile_path": "", "hotness_threshold_pct": 1.0, "linked_allocator": "",
        "target_arch": "x86-64", "atomic_type_names": [], "thread_entry_patterns": [], "main_function_patterns": [], "smt_enabled": True,
    "l1d_size_bytes": 32768, "dispatch_path_patterns": [], "tick_path_patterns": [], "relax_function_patterns": [],
}
ARCHITECTURES = {"x86-64": "x86-64", "x86_64": "x86-64", "arm64": "arm64", "arm64-apple": "arm64-apple"}


def _checked(found: dict) -> dict:
    """Settings over the defaults; raises ValueError for unknown keys and values of another kind."""
    out = {k: list(v) if isinstance(v, list) else v for k, v in DEFAULTS.items()}
    for key, value in found.items():
        if key not in DEFAULTS:
            raise ValueError(f"unknown setting {key}")
        kind = type(DEFAULTS[key])
        if kind is list:
            value = [] if value in (None, "") else [str(x) for x in (value if isinstance(value, list) else [value])]
        elif kind is float and isinstance(value, int) and not isinstance(value, bool):
            value = float(value)
        elif kind is str and value is not None and not isinstance(value, (list, dict)):
            value = str(value)
        if type(value) is not kind or (kind is int and value < 0):
            raise ValueError(f"{key} is not of its kind: {value!r}")
        if not (kind is list and not value):  # an empty list keeps the default
            out[key] = value
    if out["target_arch"] not in ARCHITECTURES:
        raise ValueError(f"unknown target_arch {out['target_arch']}")
    out["target_arch"] = ARCHITECTURES[out["target_arch"]]
    if out["target_arch"] == "arm64-apple":
        for key, value in (("cache_line_bytes", 128), ("cache_line_span_warn", 128), ("cache_line_span_crit", 256)):
            if out[key] == DEFAULTS[key]:
                out[key] = value
    return out


def config(path: str) -> dict:
    """The settings of a JSON file, or of ``key: value`` lines with lists of ``- item`` lines or in brackets, over the defaults.

    A file that cannot be read or holds what is no setting gives the defaults, with a warning. A line size that is no power of two from 8 to
    4096 raises ValueError, as every layout is divided by it.
    """
    try:
        with open(path, encoding="utf-8") as f:
            out = _checked(_parsed(f.read()))
    except (OSError, ValueError) as e:
        warnings.warn(f"{path}: {e}; using the defaults", stacklevel=2)
        out = _checked({})
    line = out["cache_line_bytes"]
    if not 8 <= line <= 4096 or line & (line - 1):
        raise ValueError("cache_line_bytes is a power of two from 8 to 4096")
    return out


def _parsed(raw: str) -> dict:
    if raw.lstrip().startswith("{"):
        return json.loads(raw)
    found: dict = {}
    key = None
    for row in raw.splitlines():
        row = re.sub(r"(^|\s)#.*$", "", row).rstrip()
        text_ = row.strip()
        if not text_ or text_ in ("---", "..."):
            continue
        if text_.startswith("- ") and key:
            if not isinstance(found[key], list):
                if found[key] != "":
                    raise ValueError(f"{key} has both a value and items")
                found[key] = []
            found[key].append(_scalar(text_[2:]))
        elif ":" in text_:
            key, _, value = (x.strip() for x in text_.partition(":"))
            inline = value.startswith("[") and value.endswith("]")
            found[key] = [_scalar(x) for x in value[1:-1].split(",") if x.strip()] if inline else _scalar(value)
        else:
            raise ValueError(f"no setting: {text_}")
    return found


def _scalar(value: str):
    value = value.strip()
    if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
        return value[1:-1]
    if value in ("true", "false"):
        return value == "true"
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            pass
    return value


def register(spark: SparkSession, tables: dict[str, DataFrame], names: Sequence[str] | None = None) -> None:
    """Fact tables as temporary views for SQL."""
    for name, df in tables.items():
        if names is None or name in names:
            df.createOrReplaceTempView(name)


def accounted(planned: DataFrame, records: DataFrame) -> DataFrame:
    """M7: (file, reason) of planned units without a record."""
    from strideway.operators import merge

    return merge.unaccounted(planned.select("file"), records.select(F.col("src").alias("file")), ["file"], "no record of the unit")


