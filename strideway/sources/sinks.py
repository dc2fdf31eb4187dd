"""Sinks: findings as JSON, SARIF, plain and compiler-like text."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strideway import schemas as S
from strideway.operators import ranking
from strideway.plans import reduce as R


def finite(c: Column) -> Column:
    """0 for what JSON has no number for."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(F.coalesce(c, F.lit(0.0)))


def as_diagnostic() -> Column:
    """A finding as the structure that the JSON sink writes."""
    entries = F.map_from_entries(F.array_sort(F.map_entries("evidence")))
    return F.struct(
        F.col("rule").alias("ruleID"), "title", S.name_of(S.SEVERITIES, F.col("severity")).alias("severity"),
            finite(F.col("confidence")).alias("confidence"), S.name_of(S.TIERS, F.col("tier")).alias("evidenceTier"),
        F.struct("file", "line", F.col("col").alias("column")).alias("location"), F.col("fn").alias("functionName"),
            F.col("reasoning").alias("hardwareReasoning"), entries.alias("structuralEvidence"), "mitigation", "escalations",
    )


def json_lines(findings: DataFrame) -> DataFrame:
    """K1: (value) one JSON object a finding; written by as many tasks as there are partitions."""
    return findings.select(F.to_json(as_diagnostic()).alias("value"))


def _document(head: str, rows: DataFrame, tail: str) -> DataFrame:
    """(ord, value): the lines of a document of the rows (ord, value) between a head and a tail; ord counts from 1."""
    spark = rows.sparkSession
    body = rows.select("ord", F.concat(F.when(F.col("ord") > 1, ",").otherwise(""), "value").alias("value"))
    ends = spark.createDataFrame([(0, head), (1 << 62, tail)], "ord bigint, value string")
    return body.unionByName(ends)


def json_rows(findings: DataFrame, metadata: dict | None = None) -> DataFrame:
    """K1: (ord, value) the lines of one document of all findings in output order."""
    rows = ranking.ordinal(findings, R.output_order()).select("ord", F.to_json(as_diagnostic()).alias("value"))
    return _document('{"version": "1.0", "schemaVersion": 1, "metadata": ' + json.dumps(metadata or {}, sort_keys=True)
        + ', "diagnostics": [', rows, "]}")


def sarif_rows(findings: DataFrame, tool: str = "strideway") -> DataFrame:
    """K2: (ord, value) the lines of a SARIF 2.1.0 log; rules in the order in which they first occur."""
    ordered = ranking.ordinal(findings, R.output_order())
    first = ordered.groupBy("rule").agg(F.min("ord").alias("first"), F.min_by("title", "ord").alias("title"))
    index = first.withColumn("ruleIndex", F.row_number().over(W.orderBy("first")) - 1)  # one row a rule
    level = F.when(F.col("severity") == S.CRITICAL, "error").when(F.col("severity") == S.HIGH, "warning").otherwise("note")
    region = F.struct(F.greatest("line", F.lit(1)).alias("startLine"), F.greatest("col", F.lit(1)).alias("startColumn"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region"))
        .alias("physicalLocation"))
    result = F.struct(F.col("rule").alias("ruleId"), "ruleIndex", level.alias("level"),
        F.struct(F.concat(ordered["title"], F.lit(": "), F.col("reasoning")).alias("text")).alias("message"),
        F.array(place).alias("locations"), F.struct(finite(F.col("confidence")).alias("confidence"),
            S.name_of(S.TIERS, F.col("tier")).alias("evidenceTier")).alias("properties"))
    rows = ordered.join(F.broadcast(index.select("rule", "ruleIndex")), "rule").select("ord", F.to_json(result).alias("value"))
    rules = [{"id": r.rule, "shortDescription": {"text": r.title}} for r in index.orderBy("ruleIndex").collect()]
    head = {"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0"}
    return _document(json.dumps(head)[:-1] + ', "runs": [{"tool": {"driver": ' + json.dumps({"name": tool, "rules": rules})
        + '}, "results": [', rows, "]}]}")


def write_rows(rows: DataFrame, path: str) -> None:
    """Lines (ord, value) as text files, each written by its own task; the files in order of their names are the document."""
    rows.orderBy("ord").select("value").write.mode("overwrite").text(path)


def _text(rows: DataFrame) -> str:
    return "\n".join(r.value for r in rows.orderBy("ord").select("value").toLocalIterator())


def json_document(findings: DataFrame, metadata: dict | None = None) -> str:
    """K1 as one text, for results of a size to read; ``write_rows`` writes those of any size."""
    return _text(json_rows(findings, metadata))


def sarif(findings: DataFrame, tool: str = "strideway") -> str:
    """K2 as one text."""
    return _text(sarif_rows(findings, tool))


def hypothesis_rows(hypotheses: DataFrame, total: int) -> DataFrame:
    """K5: (ord, value) the lines of a list of hypotheses, of those with something to measure, and how many findings it was made from."""
    known = hypotheses.where("metric IS NOT NULL")
    made = ranking.ordinal(known, [F.col("site"), F.col("id")])
    n = known.count()
    return _document('{"hypotheses": [', made.select("ord", F.to_json(F.struct(*known.columns)).alias("value")),
        f'], "totalDiagnostics": {total}, "hypothesesGenerated": {n}}}')


def experiment_rows(hypotheses: DataFrame) -> DataFrame:
    """K5: (id, file, value) the plan of each experiment as text files of its folder: what to measure, with which counters, and how sure."""
    flag = lambda c, t: F.when(F.col(c), t)
    needs = F.array_join(F.array_compact(F.array(flag("needs_c2c", "c2c"), flag("needs_numa", "numa"), flag("needs_lbr", "lbr"))), ", ")
    number = lambda c: F.col(c).cast("string")
    plan = F.concat(F.lit("site: "), "site", F.lit("\nclass: "), "cls", F.lit("\nmetric: "), "metric", F.lit("\nneeds: "), needs,
        F.lit("\nalpha: "), number("alpha"), F.lit("\npower: "), number("power"), F.lit("\neffect: "), number("effect"), F.lit("\n"))
    record = F.to_json(F.struct(*hypotheses.columns))
    files = F.array(F.struct(F.lit("plan.txt").alias("file"), plan.alias("value")),
        F.struct(F.lit("hypothesis.json").alias("file"), record.alias("value")))
    return hypotheses.where("metric IS NOT NULL").select("id", F.inline(files))


def plain(findings: DataFrame) -> DataFrame:
    """K3: (ord, value) a line of text a finding, the confidence in whole percent."""
    said = F.format_string("[%s] %s %s:%d:%d %s (%d%%, %s)", S.name_of(S.SEVERITIES, F.col("severity")), "rule", "file", "line", "col",
        "title", F.floor(F.col("confidence") * 100 + 1e-9), S.name_of(S.TIERS, F.col("tier")))
    return ranking.ordinal(findings.withColumn("value", said), R.output_order()).select("ord", "value")


def compiler_like(findings: DataFrame) -> DataFrame:
    """K4: (ord, value) ``file:line:col: level: message [rule]`` a finding, and a note for each of its escalations."""
    level = F.when(F.col("severity") == S.CRITICAL, "error").when(F.col("severity") >= S.MEDIUM, "warning").otherwise("note")
    dot = F.instr("reasoning", ".")
    first = F.when((dot > 0) & (dot < 120), F.substring("reasoning", F.lit(1), dot)).otherwise(F.col("title"))
    place = F.concat_ws(":", "file", F.greatest("line", F.lit(1)), F.greatest("col", F.lit(1)))
    own = F.array(F.concat(place, F.lit(": "), level, F.lit(": "), first, F.lit(" ["), "rule", F.lit("]")))
    notes = F.transform("escalations", lambda e: F.concat(place, F.lit(": note: "), e))
    placed = ranking.ordinal(findings, R.output_order()).select(F.col("ord").alias("__o"),
        F.posexplode(F.concat(own, notes)).alias("k", "value"))
    return ranking.ordinal(placed, [F.col("__o"), F.col("k")]).select("ord", "value")


#: What turns findings into lines (ord, value), by format; further formats are added by ``sink``.
SINKS: dict = {"json": json_rows, "sarif": sarif_rows, "cli": plain, "tidy": compiler_like}


def sink(name: str):
    """Registers a function from findings to lines (ord, value) as a format."""

    def add(f):
        SINKS[name] = f
        return f

    return add


def written(findings: DataFrame, name: str) -> str:
    """The findings in a format as one text."""
    if name not in SINKS:
        raise ValueError(f"no format {name}; there are {', '.join(sorted(SINKS))}")
    return _text(SINKS[name](findings))
