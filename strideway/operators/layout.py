"""Record layouts on cache lines: columns ``align``, ``offset``, ``size`` in bytes, lines of ``line`` bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lines_best(size: Column, line: int) -> Column:
    """Lines that a record needs if it begins on one."""
    return F.ceil(size / line).cast("int")


def lines_worst(size: Column, align: Column, line: int) -> Column:
    """Lines that a record may touch at the least favourable start its alignment allows."""
    return F.when(align >= line, lines_best(size, line)).otherwise(F.ceil((line - align + size) / line).cast("int"))


def _shifts(align: Column, line: int) -> Column:
    return F.when(align >= line, F.array(F.lit(0))).otherwise(F
        .sequence(F.lit(0), F.lit(line - 1), F.greatest(align, F.lit(1)).cast("int")))


def straddles(offset: Column, size: Column, align: Column, line: int) -> Column:
    """Whether some start puts the field across a border of lines."""
    return F.exists(_shifts(align, line),
        lambda s: F.floor((offset + s) / line) != F.floor((offset + s + F.greatest(size, F.lit(1)) - 1) / line))


def splits(offset: Column, size: Column, granule: Column, align: Column, line: int) -> Column:
    """Whether one access to an element of ``granule`` bytes may touch two lines."""
    n = F.greatest(F.floor(size / F.greatest(granule, F.lit(1))), F.lit(1)).cast("int")
    # after line / gcd(granule, line) elements the offsets repeat; line elements always suffice
    each = F.sequence(F.lit(0), F.least(n, F.lit(line)) - 1)
    crosses = F.exists(_shifts(align, line), lambda s: F.exists(each, lambda e: (offset + s + e * granule) % line + granule > line))
    return (granule > 1) & (granule <= line) & crosses


def first_line(offset: Column, line: int) -> Column:
    return F.floor(offset / line).cast("int")


def last_line(offset: Column, size: Column, align: Column, line: int) -> Column:
    """The last line a field may touch at its least favourable start."""
    shift = F.when(align >= line, 0).otherwise(line - F.greatest(align, F.lit(1)))
    return F.floor((offset + shift + F.greatest(size, F.lit(1)) - 1) / line).cast("int")


def buckets(fields: DataFrame, key: list[str], line: int, most: str | None = None) -> DataFrame:
    """A row for each field and line it may lie on, with ``line_index``; below the column ``most`` of lines if given."""
    out = fields.withColumn("line_index",
        F.explode(F.sequence(first_line(F.col("offset"), line), last_line(F.col("offset"), F.col("size"), F.col("align"), line))))
    return out if most is None else out.where(F.col("line_index") < F.col(most))


def share_a_line(a_offset: Column, a_size: Column, b_offset: Column, b_size: Column, align: Column, line: int) -> Column:
    """Whether one start exists at which both byte ranges touch a common line."""
    lo = lambda o, s: F.floor((o + s) / line)
    hi = lambda o, n, s: F.floor((o + s + F.greatest(n, F.lit(1)) - 1) / line)
    return F.exists(_shifts(align, line),
        lambda s: (lo(a_offset, s) <= hi(b_offset, b_size, s)) & (lo(b_offset, s) <= hi(a_offset, a_size, s)))


def line_limit(offset: Column, size: Column, align: Column, line: int) -> Column:
    """The offset from which on no later field can share a line with this one, whatever the start: of two fields, the later shares one
    if it begins below the limit of the earlier."""
    end = offset + F.greatest(size, F.lit(1)) - 1
    return end + line - F.array_min(F.transform(_shifts(align, line), lambda s: F.pmod(end + s, F.lit(line))))


def line_pairs(fields: DataFrame, key: list[str], order: str, line: int) -> DataFrame:
    """(key, a, b, line_index): unordered pairs of a record's fields that can share a line, with the lowest; an array of at least two
    elements also pairs with itself. Fields need ``field``, ``offset``, ``size``, ``n_elements`` and ``align``, which is their record's.

    The later field of a pair meets the earlier on the line it begins on: work follows the pairs of near fields, not those of a record.
    """
    lo = first_line(F.col("offset"), line)
    early = fields.select(*key, *(F.col(c).alias(f"a_{c}") for c in (order, "field", "offset")),
        line_limit(F.col("offset"), F.col("size"), F.col("align"), line).alias("limit"), lo.alias("__lo"))
    early = early.withColumn("line_index", F.explode(F.sequence(F.col("__lo"), F.floor((F.col("limit") - 1) / line).cast("int")))).drop("__lo")
    late = fields.select(*key, *(F.col(c).alias(f"b_{c}") for c in (order, "field", "offset")), lo.alias("line_index"))
    first = F.col(f"a_{order}") < F.col(f"b_{order}")
    met = early.join(late.hint("merge"), [*key, "line_index"]).where((F.col("b_offset") < F.col("limit"))
        & ((F.col("a_offset") < F.col("b_offset")) | ((F.col("a_offset") == F.col("b_offset")) & first))
        & (F.col(f"a_{order}") != F.col(f"b_{order}")))
    side = lambda p, q: F.when(first, F.col(f"{p}_field")).otherwise(F.col(f"{q}_field"))
    pairs = met.select(*key, side("a", "b").alias("a"), side("b", "a").alias("b"), "line_index")
    own = fields.where("n_elements >= 2").select(*key, F.col("field").alias("a"), F.col("field").alias("b"), lo.alias("line_index"))
    pairs = pairs.unionByName(own)
    # only names that a record repeats can repeat a pair
    if fields.groupBy(*key, "field").count().where("count > 1").isEmpty():
        return pairs
    return pairs.groupBy(*key, "a", "b").agg(F.min("line_index").alias("line_index"))


#: What ``pair_counts`` gives of a record.
PAIR_COUNTS = "pairs bigint, own_pairs bigint, pair_writers boolean, atomic_pairs bigint, queue_pair boolean, pair_fields string"


def pair_counts(fields: DataFrame, key: str, most: int = 64) -> DataFrame:
    """(key, ``PAIR_COUNTS``): how many pairs of a record's fields can share a line, without the pairs themselves, and the first ``most``.

    ``fields``: key, ord, field, offset, limit (``line_limit``), own (pairs with itself), atomic, known (something writes it), strong (by
    itself written by several), writer (the only one), head, tail. Names and ``ord`` are unique in a record, and no other value than
    ``writer`` is null. The fields are sorted by offset, so that those an earlier one can share a line with are a run, of which sums tell all.
    """

    def count(table: pa.Table) -> pa.Table:
        col = lambda c: table[c].to_numpy()
        at = np.lexsort((col("ord"), col("offset")))
        offset, limit, order = (col(c)[at] for c in ("offset", "limit", "ord"))
        own, atomic, known, strong, head, tail = (col(c).astype(bool)[at] for c in ("own", "atomic", "known", "strong", "head", "tail"))
        writer = pc.fill_null(table["writer"].combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)[at]
        n = len(at)
        after, end = np.arange(n) + 1, np.searchsorted(offset, limit, side="left")
        end = np.maximum(end, after)

        def within(x: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(x.astype(np.int64))])
            return sums[end] - sums[after]

        # among fields of one known writer: whether it changes between a field and the end of its run
        named = np.flatnonzero(known & (writer >= 0))
        change = np.zeros(n, dtype=bool)
        change[named[1:]] = writer[named[1:]] != writer[named[:-1]]
        other = (within(change) > 0) & known & (writer >= 0)
        apart = known & ((strong & (within(known) > 0)) | (within(strong & known) > 0) | other)
        queue = (head & (within(tail) > 0)) | (tail & (within(head) > 0)) | (own & head & tail)
        # the first pairs: fields by order, each with its partners of higher order
        partners = end - after
        into = np.cumsum(np.bincount(after, minlength=n + 1) - np.bincount(end, minlength=n + 1))[:n]
        names, said = table["field"].to_pylist(), []
        for i in np.argsort(order, kind="stable"):
            if len(said) >= most:
                break
            if own[i]:
                said.append(f"{names[at[i]]}|{names[at[i]]}")
            if not partners[i] + into[i]:
                continue
            meets = np.concatenate([np.arange(after[i], end[i]), np.flatnonzero(end[:i] > i)])
            meets = meets[order[meets] > order[i]]
            said.extend(f"{names[at[i]]}|{names[at[j]]}" for j in meets[np.argsort(order[meets], kind="stable")][:most])
        has = int(partners.sum()) + int(own.sum())
        out = {
            key: table[key].slice(0, 1), "pairs": [int(partners.sum())], "own_pairs": [int((own & known & strong).sum())],
            "pair_writers": [bool(apart.any() or (own & known & strong).any())],
            "atomic_pairs": [int((within(atomic) * atomic).sum() + (own & atomic).sum())], "queue_pair": [bool(queue.any())],
            "pair_fields": [";".join(said[:most])],
        }
        found = pa.table({k: v if k == key else pa.array(v) for k, v in out.items()})
        return found if has else found.slice(0, 0)

    return fields.groupBy(key).applyInArrow(count, f"{key} {fields.schema[key].dataType.simpleString()}, {PAIR_COUNTS}")


def escape_score(atomics: Column, volatiles: Column, sync: Column, shared: Column, published: Column, thread_writers: Column,
    accessors: Column, escapes: Column) -> Column:
    """How much evidence there is that a record is shared between threads, from 0 to 1."""
    w = lambda c, x: F.when(c, x).otherwise(0.0)
    raw = w(atomics, 0.40) + w(volatiles, 0.25) + w(sync, 0.15) + w(shared, 0.10) + w(published, 0.10) + w(thread_writers,
        0.20) + w(atomics & sync, 0.15)
    capped = F.least(F.lit(1.0), raw)
    scaled = F.when(accessors <= 1, capped * 0.5).when(accessors >= 6, F.least(F.lit(1.0), capped * 1.2)).otherwise(capped)
    return F.when(escapes, scaled).otherwise(0.0)


def writer_facts(writers: DataFrame, key: list[str], writer: str, is_entry: str, is_pool: str, opaque: str) -> DataFrame:
    """(key, n_writers, entry_writer, pool_writer, all_opaque, thread_writers) from rows of writers.

    A field that nothing writes has no row: it is unknown, not sparse.
    """
    out = writers.groupBy(*key).agg(F.count_distinct(writer).alias("n_writers"), F.bool_or(is_entry).alias("entry_writer"),
        F.bool_or(is_pool).alias("pool_writer"), F.bool_and(opaque).alias("all_opaque"))
    return out.withColumn("thread_writers", (F.col("n_writers") >= 2) & F.col("entry_writer"))
