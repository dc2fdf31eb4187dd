"""Joins beyond equality: intervals, predecessors, radii, ranks, suffixes, patterns, pairs of classes, verdicts.

Each is brought down to an equality join on a bucket, a base name or a class wherever its condition implies one.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strideway import storage
from strideway.functions import text

#: Rows of a block of vectors, of which a task takes two.
BLOCK = 2048


def glob_join(df: DataFrame, column: str, patterns: Sequence[tuple[str, str]], name: str = "pattern") -> DataFrame:
    """A row for each (row, pattern) that matches; patterns are (name, glob) and few, so that each is a literal of the plan."""
    hits = F.filter(F.array(*(F.when(text.matches_glob(F.col(column), [g]), F.lit(n)) for n, g in patterns)), lambda x: x.isNotNull())
    return df.withColumn(name, F.explode(hits))


def source_filter(df: DataFrame, path: str, order: str, include: Sequence[str] = (), exclude: Sequence[str] = (),
    vendored: Sequence[str] = (), changed: DataFrame | None = None, header_suffixes: Sequence[str] = (".h", ".hh", ".hpp", ".hxx"),
    most: int | None = None) -> DataFrame:
    """Paths left by the changed, include, exclude and vendored filters, in that order, and of these the first ``most`` by ``order``.

    ``changed`` (column ``changed``): a changed header keeps all; otherwise a path stays if it ends with a changed one. The vendored
    patterns apply only where nothing is included by name.
    """
    out = df
    if changed is not None:
        changed = storage.saved(changed.select("changed").where("changed <> ''").distinct(), "changed")
        header = F.lit(False)
        for s in header_suffixes:
            header = header | F.col("changed").endswith(s)
        if changed.where(header).isEmpty():
            side = changed.withColumn("__base", text.base_name(F.col("changed")))
            # a suffix without a slash ends the base name; one with a slash shares it
            long = side.where(F.contains("changed", F.lit("/")))
            short = side.where(~F.contains("changed", F.lit("/"))).select("changed")
            own = out.withColumn("__base", text.base_name(F.col(path)))
            hit = own.join(long, "__base").where(F.endswith(path, "changed")).select(path).unionByName(own
                .join(storage.small(storage.saved(short, "short")), F.endswith("__base", "changed")).select(path))
            out = out.join(hit.distinct(), path, "left_semi").select(df.columns)
    if include:
        out = out.where(text.matches_glob(F.col(path), list(include)))
    if exclude:
        out = out.where(~text.matches_glob(F.col(path), list(exclude)))
    if vendored and not include:
        out = out.where(~text.matches_glob(F.col(path), list(vendored)))
    if most is not None and most > 0:
        out = out.orderBy(order).limit(most)  # the feature: the first N of what is left
    return out


def suffix_join(df: DataFrame, path: str, suffixes: DataFrame, suffix: str) -> DataFrame:
    """Rows whose path equals a suffix or ends with ``/`` and the suffix; both share the base name."""
    a = df.withColumn("__base", text.base_name(F.col(path)))
    b = suffixes.withColumn("__base", text.base_name(F.col(suffix)))
    ends = (F.col(path) == F.col(suffix)) | F.endswith(F.col(path), F.concat(F.lit("/"), F.col(suffix)))
    return a.join(b, "__base").where(ends).drop("__base")


def interval_join(a: DataFrame, a_start: Column, a_end: Column, b: DataFrame, b_start: Column, b_end: Column,
    width: Column | float) -> DataFrame:
    """Pairs of half-open intervals that overlap, by equality on buckets of ``width``; a pair is given in its first common bucket only."""
    w = width if isinstance(width, Column) else F.lit(width)
    span = lambda s, e: F.sequence(F.floor(s / w), F.greatest(F.floor(s / w), F.ceil(e / w) - 1))
    left = a.withColumns({"__as": a_start, "__ae": a_end}).withColumn("__bucket", F.explode(span(F.col("__as"), F.col("__ae"))))
    right = b.withColumns({"__bs": b_start, "__be": b_end}).withColumn("__bucket", F.explode(span(F.col("__bs"), F.col("__be"))))
    first = F.floor(F.greatest("__as", "__bs") / w) == F.col("__bucket")
    return left.join(right, "__bucket").where((F.col("__as") < F.col("__be")) & (F.col("__bs") < F.col("__ae")) & first).drop("__bucket",
        "__as", "__ae", "__bs", "__be")


def asof_bounded(a: DataFrame, b: DataFrame, key: list[str], time: str, payload: list[str], within: Column, strict: bool = True,
    tie: list[str] | None = None) -> DataFrame:
    """Each row of ``a`` with the payload of the latest earlier row of ``b`` of its key, if it is at most ``within`` before; else nulls.

    One sort of the union replaces a range join. ``tie``: columns of b that order rows of one time before the payload does.
    """
    found = F.struct(time, *(F.col(c).alias(f"__tie_{c}") for c in tie or []), *payload)
    left = a.select("*", F.lit(1 if not strict else 0).alias("__side"), F.lit(None).cast(b.select(found).schema[0].dataType).alias("__b"))
    right = b.select(*(F.col(c) if c in [*key, time] else F.lit(None).cast(a.schema[c].dataType).alias(c) for c in a.columns),
        F.lit(0 if not strict else 1).alias("__side"), found.alias("__b"))
    w = W.partitionBy(*key).orderBy(F.col(time), F.col("__side"), F.col("__b")).rowsBetween(W.unboundedPreceding, 0)
    both = left.withColumn("__own", F.lit(True)).unionByName(right.withColumn("__own", F.lit(False)))
    out = both.withColumn("__last", F.last("__b", ignorenulls=True).over(w)).where("__own")
    near = F.col(f"__last.{time}") >= F.col(time) - within
    return out.select(*a.columns, *(F.when(near, F.col("__last")[c]).alias(f"prev_{c}") for c in [time, *payload]))


def squared_distance(a: Column, b: Column) -> Column:
    """Of two arrays; null where their sizes differ."""
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def radius_join(a: DataFrame, b: DataFrame, key: list[str], left: str, right: str, radius: float, how: str = "inner",
    axes: int = 2) -> DataFrame:
    """Pairs of one class whose vectors are at most ``radius`` apart; ``how`` may be ``left_anti`` to drop what has a neighbour.

    Vectors meet in the cells of a grid twice as wide as the radius: near vectors have near lengths, and near coordinates on the first
    ``axes`` axes. The right side is listed in every cell that its radius touches, so that the join is an equality, and each pair meets
    once. To drop rows only different vectors count: those of the right are sent if all their cells are small, else those of the left meet
    them by shuffle, and the rows are dropped by their vectors.
    """
    if radius <= 0:
        radius = 0.0
    reach = float(radius) * (1 + 1e-6)
    wide = 2 * max(float(radius), 1e-12)
    step = lambda v: F.floor(v / F.lit(wide)).cast("bigint")
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    at = lambda c: [norm(F.col(c)), *(F.coalesce(F.get(F.col(c), F.lit(k)), F.lit(0.0)).cast("double") for k in range(axes))]
    cells = [f"__g{k}" for k in range(axes + 1)]

    def sides(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
        for c, v in zip(cells, at(left)):
            a = a.withColumn(c, step(v))
        for c, v in zip(cells, at(right)):
            b = b.withColumn(c, F.explode(F.sequence(step(v - reach), step(v + reach))))
        return a.alias("l"), b.alias("r")

    cond = squared_distance(F.col(f"l.{left}"), F.col(f"r.{right}")) <= radius * radius
    for k in [*key, *cells]:
        cond = cond & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    if how != "left_anti":
        l_side, r_side = sides(a, b)
        return l_side.join(r_side.hint("merge"), cond, how)
    b = storage.saved(b.select(*key, right).distinct(), "points")
    if storage.sent_bytes(b) << (axes + 1) <= storage.SENT_BYTES:
        l_side, r_side = sides(a, b)
        return l_side.join(F.broadcast(r_side), cond, how)
    l_side, r_side = sides(a.where(F.col(left).isNotNull()).select(*key, left).distinct(), b)
    near = l_side.join(r_side.hint("merge"), cond, "left_semi").select(*(F.col(c).alias(f"__near_{c}") for c in [*key, left]))
    same = F.lit(True)
    for c in [*key, left]:
        same = same & (F.col(c) == F.col(f"__near_{c}"))
    return a.join(storage.small(storage.saved(near, "near")), same, how)


def radius_pairs(df: DataFrame, key: list[str], ident: str, vector: str, radius: float) -> DataFrame:
    """(a, b): all pairs of one class, a < b, whose vectors are of one size and at most ``radius`` apart, for vectors that no grid parts.

    A class is dealt to blocks of about ``BLOCK`` rows, and a task takes the rows of two: memory is bounded, and the products of blocks
    are matrix products. What lies at the border within their error is worked out again, term by term.
    """
    kind = df.schema[ident].dataType.simpleString()
    rows = df.where(~F.exists(vector, lambda x: x.isNull()) & F.col(ident).isNotNull())
    rows = rows.select(*(F.col(k).alias(f"__k{n}") for n, k in enumerate(key)), F.size(vector).alias("__d"), F.col(ident).alias("id"),
        F.col(vector).cast("array<double>").alias("v"))
    by = [f"__k{n}" for n in range(len(key))]
    for k in by:
        rows = rows.where(F.col(k).isNotNull())
    rows, by = storage.saved(rows, "vectors"), [*by, "__d"]
    count = rows.groupBy(*by).agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("__n"))
    dealt = rows.join(storage.small(storage.saved(count, "blocks")), by).withColumn("__b", F.pmod(F.xxhash64("id"), F.col("__n")).cast("int"))
    # a row goes to each task that takes its block and another
    tasks = F.transform(F.sequence(F.lit(0), F.col("__n") - 1),
        lambda o: F.struct(F.least(o, F.col("__b")).alias("i"), F.greatest(o, F.col("__b")).alias("j")))
    dealt = dealt.withColumn("__t", F.explode(tasks)).select(*by, "__t.i", "__t.j", "__b", "id", "v")
    limit = radius * radius if radius > 0 else 0.0

    def near(table: pa.Table) -> pa.Table:
        ids, block = table["id"].combine_chunks(), table["__b"].to_numpy()
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        flat = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        v = flat.reshape(len(table), -1) if len(flat) else np.zeros((len(table), 0))
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        found_a, found_b = [], []
        with np.errstate(all="ignore"):
            long = np.einsum("ij,ij->i", v, v)
            for start in range(0, len(left), 512):
                part = left[start : start + 512]
                scale = long[part][:, None] + long[right][None, :]
                d = scale - 2.0 * (v[part] @ v[right].T)
                hit = d <= limit
                x, y = np.nonzero(~(np.abs(d - limit) > 1e-9 * (scale + limit)) | ~np.isfinite(d))
                for at in range(0, len(x), 65536):
                    p, q = x[at : at + 65536], y[at : at + 65536]
                    s = np.zeros(len(p))
                    for k in range(v.shape[1]):
                        s += (v[part[p], k] - v[right[q], k]) ** 2
                    hit[p, q] = s <= limit
                p, q = np.nonzero(hit)
                found_a.append(part[p])
                found_b.append(right[q])
        a, b = (np.concatenate(f) if f else np.zeros(0, dtype=np.int64) for f in (found_a, found_b))
        if i == j:  # each pair was met from both ends
            once = pc.less(ids.take(pa.array(a)), ids.take(pa.array(b))).to_numpy(zero_copy_only=False)
            a, b = a[once], b[once]
        x, y = ids.take(pa.array(a)), ids.take(pa.array(b))
        swap, same = pc.greater(x, y), pc.equal(x, y)
        out = pa.table({"a": pc.if_else(swap, y, x), "b": pc.if_else(swap, x, y)})
        return out.filter(pc.invert(same))

    return dealt.groupBy(*by, "i", "j").applyInArrow(near, f"a {kind}, b {kind}")


def ranked_lookup(df: DataFrame, key: list[str], candidates: Sequence[tuple[int, DataFrame, Column]], tie: list[Column],
    columns: list[str]) -> DataFrame:
    """Each row with the columns of its best candidate: least rank, then ``tie``; nulls without one.

    A candidate is (rank, table, condition between ``l`` and ``r``).
    """
    found = None
    for rank, table, cond in candidates:
        part = df.alias("l").join(table.alias("r"), cond).select(*(F.col(f"l.{k}").alias(k) for k in key), F.lit(rank).alias("rank"),
            *(F.col(f"r.{c}").alias(c) for c in columns))
        found = part if found is None else found.unionByName(part)
    best = found.withColumn("__rn", F.row_number().over(W.partitionBy(*key).orderBy(F.col("rank"), *tie))).where("__rn = 1").drop("__rn")
    return df.join(best, key, "left")


def class_pairs(df: DataFrame, key: list[str], kind: str, order: list[Column], templates: Sequence[tuple[str, str, str]],
    keep: list[str]) -> DataFrame:
    """Pairs of rows of different classes that share a key, for the class pairs that a template names.

    Before the self-join each (key, class) keeps its first row by ``order``, so that a hot key costs a row a class.
    """
    best = df.withColumn("__rn", F.row_number().over(W.partitionBy(*key, kind).orderBy(*order))).where("__rn = 1").select(*key, kind, *keep)
    known = F.broadcast(df.sparkSession.createDataFrame([(n, *sorted((a, b))) for n, a, b in templates],
            "template string, a_kind string, b_kind string"))
    a = best.select(*key, F.col(kind).alias("a_kind"), *(F.col(c).alias(f"a_{c}") for c in keep))
    b = best.select(*key, F.col(kind).alias("b_kind"), *(F.col(c).alias(f"b_{c}") for c in keep))
    return a.join(b, key).where("a_kind < b_kind").join(known, ["a_kind", "b_kind"])


def verdicts(predicted: DataFrame, observed: DataFrame, key: list[str]) -> DataFrame:
    """(key, verdict) of predictions against observations.

    ``observed`` may have a boolean ``hit``. CONFIRMED: predicted and hit; REFUTED: predicted and seen without a hit; UNOBSERVED:
    predicted only; MISSED: hit only. What was seen without a hit and without a prediction has no row. NO-GLOBAL-INSTANCE: predicted
    without a key, so that nothing observed by key can speak for or against it; one row each.
    """
    seen = observed if "hit" in observed.columns else observed.withColumn("hit", F.lit(True))
    keyless = F.lit(False)
    for k in key:
        keyless = keyless | F.col(k).isNull()
    unknown = predicted.where(keyless).select(*key, F.lit("NO-GLOBAL-INSTANCE").alias("verdict"))
    p = predicted.where(~keyless).select(*key).distinct().withColumn("__p", F.lit(True))
    o = seen.where(~keyless).groupBy(*key).agg(F.bool_or("hit").alias("__hit"))
    both = p.join(o, key, "full_outer")
    said = F.when(F.col("__p") & F.col("__hit"), "CONFIRMED").when(F.col("__p") & ~F.col("__hit"), "REFUTED").when(F.col("__p"),
        "UNOBSERVED").when(F.col("__hit"), "MISSED")
    return both.select(*key, said.alias("verdict")).where("verdict IS NOT NULL").unionByName(unknown)


def symbol_recall(hot: DataFrame, findings: DataFrame, most: int | None = 40) -> DataFrame:
    """(symbol, weight, found) of the ``most`` heaviest symbols (all if None): whether a finding names one, by function or in its evidence.

    ``hot``: symbol, weight. Of names the last component counts, of symbols what stands before ``+`` or ``@``; only equal names match.
    """
    bare = F.substring_index(F.substring_index("symbol", "+", 1), "@", 1)
    by = hot.groupBy("symbol").agg(F.sum("weight").alias("weight"))
    by = by if most is None else by.orderBy(F.col("weight").desc(), "symbol").limit(most)  # the feature: the first N
    names = F.concat(F.array(F.col("fn")), F.map_values("evidence"))
    flagged = findings.select(F.explode(F.transform(names, lambda n: F.substring_index(n, "::", -1)))
        .alias("__name")).where("__name <> ''").distinct().withColumn("__f", F.lit(True))
    out = by.withColumn("symbol", bare).join(flagged, F.col("symbol") == F.col("__name"), "left")
    return out.select("symbol", "weight", F.coalesce("__f", F.lit(False)).alias("found"))


def recall_summary(recall: DataFrame) -> DataFrame:
    """One row: symbols found and in all, and the share of weight found (null without weight)."""
    found = recall.agg(F.count(F.when(F.col("found"), 1)).alias("hits"), F.count("*").alias("symbols"),
        F.coalesce(F.sum(F.when(F.col("found"), F.col("weight"))), F.lit(0)).alias("__w"), F.sum("weight").alias("__t"))
    return found.select("hits", "symbols", F.try_divide(F.col("__w").cast("double"), F.col("__t").cast("double")).alias("by_weight"))


def any_shared(df: DataFrame, key: list[str], joined: str, separator: str, known: DataFrame, token: str, flag: str) -> DataFrame:
    """(key, known, shared) of separated tokens: how many are in the known table, and whether a flag is set for any; null if none is known.

    Unknown is not false: only known tokens decide.
    """
    each = df.select(*key, F.explode(F.split(joined, separator)).alias("__t")).where("__t <> ''")
    found = each.join(known.select(F.col(token).alias("__t"), F.col(flag).alias("__flag")), "__t", "left")
    return found.groupBy(*key).agg(F.count("__flag").alias("known"), F.bool_or("__flag").alias("shared"))
