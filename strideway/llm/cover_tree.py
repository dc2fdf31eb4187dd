"""Near-duplicate embeddings by dual traversal of cover trees.

The result is exact: all vectors whose cosine reaches ``THRESHOLD`` are linked, and a class holds what chains of links join.
Vectors are scaled to length 1, where cosine and Euclidean distance order alike. The top levels of the tree part the data
into cells around sampled centres; a cell far larger than a block is parted again around centres of its own. A cell is cut
into blocks by a hash, and each block holds a cover tree: nested levels of centres with halving radii, every level's centres
further apart than its radius. Pairs of cells, of blocks, then of tree nodes level by level are dropped if the distance of
their centres exceeds the sum of their covering radii and the threshold. They are counted as a whole, without a look at their
vectors, if distance and radii together stay within the threshold, so that a class of copies costs no pairs. What is left at
the bottom is compared, in double precision where single precision cannot tell.

Defined results: every id that is not null has a row. A null or empty vector, one with a null or non-finite number and one of
length 0 have no links; ids of such vectors only are classes of their own. Vectors of different dimensions are never
compared. Rows that repeat an id are one vector if they are equal; an id with different vectors is linked if one of them is,
once with each other id and never with itself. A class is named by its smallest id. An empty table gives an empty result.
Other columns are not read. Vectors have no texts; a vector of many numbers is compared in whole.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, minmax_dedup

THRESHOLD = 0.95
#: Vectors of a block: at least, and at most. Between them it is chosen for some four pairs of blocks a core.
LEAST_BLOCK, MOST_BLOCK = 4096, 16384
#: Centres of a level at the top, and levels: what every task gets stays small, as further cuts are by hash.
MOST_CENTRES, LEVELS = 4096, 3
#: A cell of so many blocks is parted again around its own centres.
CROWDED = 4
#: Radius at which a tree's levels end; points below are compared directly.
LEAST_RADIUS = 0.1
STRIPE = 1024
_SLACK = 2e-3  # distances near 0 in single precision
_DOUBT = 2e-5  # cosines in single precision

BLOCKS = "dim int, cell int, piece int, root array<float>, radius double, ids binary, vecs binary, many binary, tree binary"


def _kind(df: DataFrame) -> tuple[str, type]:
    """The precision in which the vectors are kept: that of their column."""
    single = df.schema["embedding"].dataType.simpleString() in ("array<float>", "array<tinyint>", "array<smallint>")
    return ("float", np.float32) if single else ("double", np.float64)


def clean(df: DataFrame) -> DataFrame:
    """(id, dim, vec) of the rows that can be linked; vec has the bytes of the numbers."""
    name, kind = _kind(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, vecs = [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                v = v.values
                if v is None or not len(v) or v.null_count:
                    continue
                x = v.to_numpy(zero_copy_only=False).astype(kind)
                if np.isfinite(x).all() and x.any():
                    ids.append(i)
                    dims.append(len(x))
                    vecs.append((x + 0).tobytes())  # one zero
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(vecs, pa.binary())],
                ["id", "dim", "vec"])

    own = df.select(F.col("vec_id").cast("bigint").alias("id"),
        F.col("embedding").cast(f"array<{name}>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    return own.mapInArrow(run, "id bigint, dim int, vec binary")


def unit(raw: np.ndarray) -> np.ndarray:
    return _unit(raw).astype(np.float32)


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def _assign(centres: dict[tuple[int, int], tuple[list[int], np.ndarray]], kind: type):
    """Moves vectors to the nearest centre of their cell: by (dim, cell), the cells below and their centres."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cells, gaps = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("dim", "cell", "gap"))
            for d, c in {*zip(dims.tolist(), cells.tolist())} & centres.keys():
                own = np.flatnonzero((dims == d) & (cells == c))
                below, held = centres[d, c]
                for s in range(0, len(own), STRIPE):
                    part = own[s : s + STRIPE]
                    x = unit(np.frombuffer(b"".join(batch.column("vec").take(pa.array(part)).to_pylist()), kind).reshape(-1, d))
                    cos = x @ held.T
                    best = cos.argmax(axis=1)
                    gaps[part] = np.sqrt(np.maximum(2 - 2 * cos[np.arange(len(part)), best], 0))
                    cells[part] = np.array(below, np.int32)[best]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", "dim", "vec", "many")]
                + [pa.array(cells, pa.int32()), pa.array(gaps, pa.float64())], ["id", "dim", "vec", "many", "cell", "gap"])

    return run


PLACED = "id bigint, dim int, vec binary, many boolean, cell int, gap double"


def parted(rows: DataFrame, kind: type, block: int) -> tuple[DataFrame, dict, dict]:
    """The top levels: rows with their cell and the distance from its centre; the centres by (dim, cell); what a cell holds.

    Cell 0 of a dimension is all of it and has no centre.
    """
    placed = common.saved(rows.withColumns({"cell": F.lit(0), "gap": F.lit(2.0).cast("double")}), "placed")
    centre: dict[tuple[int, int], np.ndarray] = {}
    fresh = 0

    def held() -> dict:
        stats = placed.groupBy("dim", "cell").agg(F.count("*"), F.max("many"), F.max("gap"), F.min("id")).collect()
        return {(r[0], r[1]): tuple(r[2:]) for r in stats}

    stats = held()
    for level in range(LEVELS):
        least = block if not level else CROWDED * block
        crowded = {c: x[0] for c, x in stats.items() if x[0] > least and (x[2] > LEAST_RADIUS or not level)}
        if not crowded:
            break
        total = sum(crowded.values())
        asked = {c: max(2, min(-(-n // block), MOST_CENTRES * n // total)) for c, n in crowded.items()}
        # a hash of the vectors draws twice what is asked for
        share = [(*c, min(1.0, 2.0 * k / crowded[c] + 1e-4 * (k < 16))) for c, k in asked.items()]
        bounds = F.broadcast(placed.sparkSession.createDataFrame(share, "dim int, cell int, bound double"))  # one row a cell
        unit_hash = F.shiftrightunsigned(F.xxhash64("id", "vec"), 11) / F.lit(float(1 << 53))
        drawn = placed.join(bounds, ["dim", "cell"]).where(unit_hash <= F.col("bound")).select("dim", "cell", "vec")
        chosen: dict = {}
        for r in drawn.orderBy(F.xxhash64("vec"), "vec").limit(3 * MOST_CENTRES).collect():
            own = chosen.setdefault((r.dim, r.cell), [])
            if len(own) < asked[r.dim, r.cell]:
                own.append(np.frombuffer(r.vec, kind))
        below = {}
        for c, vecs in chosen.items():
            x = unit(np.stack(vecs))
            names = list(range(fresh + 1, fresh + 1 + len(x)))
            fresh += len(x)
            centre |= {(c[0], k): v for k, v in zip(names, x)}
            below[c] = (names, x)
        if not below:
            break
        before, placed = placed, common.saved(placed.mapInArrow(_assign(below, kind), PLACED), "placed")
        common.discard(before)
        stats = held()
    return placed, centre, stats


def _near_cells(centre: dict, stats: dict, reach: float):
    """For each cell the cells from it on that cannot be told apart from it by their radii, and whether all of both are linked."""
    by_dim: dict[int, list[int]] = {}
    for d, c in sorted(stats):
        by_dim.setdefault(d, []).append(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                cells = [x for x in by_dim[d] if x >= c]
                room = np.array([stats[d, x][2] for x in cells]) + _SLACK
                plain = np.array([not stats[d, x][1] for x in cells])
                known = np.array([(d, x) in centre for x in cells])
                if known[0]:
                    at = np.stack([centre.get((d, x), np.zeros(d, np.float32)) for x in cells])
                    gap = apart(at[:1], at)[0]
                else:
                    known[:] = False
                    gap = np.zeros(len(cells))
                near = ~known | (gap <= room + room[0] + reach)
                full = known & plain & plain[0] & (gap + room + room[0] + 2 * _SLACK <= reach)
                pick = np.flatnonzero(near)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pick), d), pa.int32()), pa.array(np.full(len(pick), c), pa.int32()),
                        pa.array(np.array(cells)[pick], pa.int32()), pa.array(full[pick])], ["dim", "cell", "other", "whole"])

    return run


class Tree:
    """Level ``k`` has the first ``sizes[k]`` of ``order`` as centres; ``up[k]`` is every point's centre there, ``radius[k]`` each centre's
    covering radius. The points of node ``i`` at level ``k`` are those from ``lo[k][i]`` to ``hi[k][i]``; ``by`` gives their places in what was passed.
    """

    def stored(self) -> bytes:
        """The tree without its vectors."""
        return pickle.dumps({k: v for k, v in self.__dict__.items() if k not in ("x", "by")})

    @classmethod
    def read(cls, stored: bytes, x: np.ndarray) -> Tree:
        out = cls.__new__(cls)
        out.__dict__.update(pickle.loads(stored))
        out.x = x
        return out

    def __init__(self, x: np.ndarray, least: float = LEAST_RADIUS) -> None:
        n = len(x)
        near, gap = np.zeros(n, np.int32), apart(x, x[:1])[:, 0]
        order = [0]
        self.sizes, chains = [], []
        radius = float(gap.max())
        while True:
            before = len(order)
            while len(order) < n and gap[far := int(gap.argmax())] > radius and len(order) <= max(n // 4, 64):
                d = apart(x, x[far : far + 1])[:, 0]
                d[far] = 0
                closer = d < gap
                near[closer], gap[closer] = len(order), d[closer]
                near[far], gap[far] = len(order), 0
                order.append(far)
            if chains and len(order) > max(n // 4, 64):
                order = order[:before]  # a level of little but single points parts nothing
                break
            self.sizes.append(len(order))
            chains.append(near.copy())
            if radius <= least or len(order) == n:
                break
            radius /= 2
        order = np.array(order, np.int32)
        # every point's chain of centres runs through its centre's own, so that nodes are nested
        for k in range(len(chains) - 2, -1, -1):
            chains[k] = chains[k][order[chains[k + 1]]]
        self.by = np.lexsort(chains[::-1])  # a node's points side by side
        place = np.empty(n, np.int32)
        place[self.by] = np.arange(n)
        self.x, self.order, self.up = x[self.by], place[order], [c[self.by] for c in chains]
        self.radius, self.lo, self.hi = [], [], []
        for k, m in enumerate(self.sizes):
            d = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", self.x, self.x[self.order[self.up[k]]]), 0))
            r = np.zeros(m)
            np.maximum.at(r, self.up[k], d)
            self.radius.append(r)
            lo = np.zeros(m, np.int64)
            own, first = np.unique(self.up[k], return_index=True)
            lo[own] = first
            self.lo.append(lo)
            self.hi.append(lo + np.bincount(self.up[k], minlength=m))
        self.below = []  # the nodes (at the last level points) under each node
        for k, m in enumerate(self.sizes):
            child = self.up[k][self.order[: self.sizes[k + 1]]] if k + 1 < len(self.sizes) else self.up[k]
            by = np.argsort(child, kind="stable").astype(np.int32)
            self.below.append((by, np.searchsorted(child[by], np.arange(m + 1))))

    def children(self, k: int, nodes: np.ndarray) -> np.ndarray:
        by, at = self.below[k]
        return np.concatenate([by[at[i] : at[i + 1]] for i in nodes])

    def points(self, k: int, nodes: np.ndarray) -> np.ndarray:
        """The vectors of nodes at level k; beyond the last level nodes are points."""
        return self.x[self.order[nodes]] if k < len(self.sizes) else self.x[nodes]

    def room(self, k: int, nodes: np.ndarray) -> np.ndarray:
        return self.radius[k][nodes] if k < len(self.sizes) else np.zeros(len(nodes))

    def span(self, k: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (self.lo[k][nodes], self.hi[k][nodes]) if k < len(self.sizes) else (nodes, nodes + 1)


def dual(a: Tree, b: Tree, reach: float, many_a: np.ndarray | None = None, many_b: np.ndarray | None = None) -> tuple[np.ndarray,
    np.ndarray, np.ndarray]:
    """Points of a and of b no further apart than ``reach``, as places; and (lo, hi, lo, hi) of nodes all of whose points are that near.

    No whole nodes hold points marked in ``many_a`` or ``many_b``.
    """
    held = [np.concatenate([[0], np.cumsum(np.zeros(len(t.x)) if m is None else m)]) for t, m in ((a, many_a), (b, many_b))]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    whole: list[np.ndarray] = []
    stack = [(0, 0, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        ka, kb, own, other = stack.pop()
        bottom = ka == len(a.sizes) and kb == len(b.sizes)
        theirs, room_b = b.points(kb, other), b.room(kb, other)
        lo_b, hi_b = b.span(kb, other)
        plain_b = held[1][hi_b] == held[1][lo_b]
        for s in range(0, len(own), STRIPE):
            mine = own[s : s + STRIPE]
            room_a = a.room(ka, mine)
            cos = a.points(ka, mine) @ theirs.T
            i, j = np.nonzero(cos >= np.float32(1 - (reach + _SLACK + room_a.max() + room_b.max()) ** 2 / 2))  # no distances but of these
            if bottom:
                if len(i):
                    found.append((mine[i], other[j]))
                continue
            gap, room = np.sqrt(np.maximum(2 - 2 * cos[i, j], 0)), room_a[i] + room_b[j]
            near = gap <= reach + _SLACK + room
            i, j, gap, room = i[near], j[near], gap[near], room[near]
            lo_a, hi_a = a.span(ka, mine)
            full = (gap + room + 2 * _SLACK <= reach) & plain_b[j] & (held[0][hi_a] == held[0][lo_a])[i]
            if full.any():
                whole.append(np.stack([lo_a[i[full]], hi_a[i[full]], lo_b[j[full]], hi_b[j[full]]], axis=1))
                i, j = i[~full], j[~full]
            if not len(i):
                continue
            down = lambda t, k, nodes: nodes if k == len(t.sizes) else t.children(k, nodes)
            next_a, next_b = ka + (ka < len(a.sizes)), kb + (kb < len(b.sizes))
            if len(i) > 0.25 * cos.size and not full.any():  # little was pruned: go on with the whole block
                stack.append((next_a, next_b, down(a, ka, mine[np.unique(i)]), down(b, kb, other[np.unique(j)])))
                continue
            cuts = np.flatnonzero(np.diff(i, prepend=-1))
            for lo, hi in zip(cuts, [*cuts[1:], len(i)]):
                stack.append((next_a, next_b, down(a, ka, mine[i[lo] : i[lo] + 1]), down(b, kb, other[j[lo:hi]])))
    pairs = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 2
    return *pairs, np.concatenate(whole).astype(np.int64) if whole else np.zeros((0, 4), np.int64)


def least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each of n points' components under the links (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        after = label.copy()
        for at in (label[i], label[j]):  # roots only
            np.minimum.at(after, at, low)
        while not np.array_equal(jumped := after[after], after):
            after = jumped
        if np.array_equal(after, label):
            break
        label = after
        apart_ = label[i] != label[j]
        i, j = i[apart_], j[apart_]
    return label


def _build(kind: type):
    def run(key, table):
        d, cell, piece = (table[c][0].as_py() for c in ("dim", "cell", "piece"))
        raw = np.frombuffer(b"".join(table["vec"].to_pylist()), kind).reshape(-1, d)
        ids, many = table["id"].to_numpy(), table["many"].to_numpy()
        by = np.lexsort((*raw.T[:1], ids))
        t = Tree(unit(raw[by]))
        by = by[t.by]
        root = t.x[t.order[0]]
        r = float(apart(t.x, root[None]).max()) + _SLACK
        cols = [[d], [cell], [piece], [root.tolist()], [r], [ids[by].tobytes()], [raw[by].tobytes()], [many[by].astype(bool).tobytes()],
            [t.stored()]]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float32()), pa.float64(), *[pa.binary()] * 4]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)],
            ["dim", "cell", "piece", "root", "radius", "ids", "vecs", "many", "tree"])

    return run


LINKS = "a bigint, b bigint, n bigint"


def _compare(threshold: float, kind: type):
    reach = float(np.sqrt(2 - 2 * threshold))

    def run(key, table):
        """(id, the least id of its links' component, number of links) of one pair of blocks; pairs one by one, n null, where an id has many vectors."""
        sides = []
        places = table["side"].to_pylist()
        for side in sorted({*places}):
            r = table.slice(places.index(side), 1)
            raw = np.frombuffer(r["vecs"][0].as_py(), kind).reshape(-1, r["dim"][0].as_py())
            sides.append((np.frombuffer(r["ids"][0].as_py(), np.int64), raw, np.frombuffer(r["many"][0].as_py(), bool),
                    Tree.read(r["tree"][0].as_py(), unit(raw))))
        (ia, ra, ma, ta), (ib, rb, mb, tb) = sides[0], sides[-1]
        same = len(sides) == 1
        i, j, whole = dual(ta, tb, reach, ma, mb)
        cos = np.empty(len(i))
        for s in range(0, len(i), 1 << 16):
            part = slice(s, s + (1 << 16))
            own = np.einsum("ij,ij->i", ta.x[i[part]], tb.x[j[part]]).astype(np.float64)
            doubt = np.flatnonzero(np.abs(own - threshold) < _DOUBT)
            if len(doubt):
                own[doubt] = np.einsum("ij,ij->i", _unit(ra[i[part][doubt]]), _unit(rb[j[part][doubt]]))
            cos[part] = own
        keep = (cos >= threshold) & (ia[i] != ib[j])
        i, j = i[keep], j[keep]
        apart_ = ma[i] | mb[j]
        lone = np.unique(np.stack([np.minimum(ia[i[apart_]], ib[j[apart_]]), np.maximum(ia[i[apart_]], ib[j[apart_]])], axis=1), axis=0)
        i, j = i[~apart_], j[~apart_]
        na, nb = len(ia), len(ib)
        links_a, links_b = np.bincount(i, minlength=na), np.bincount(j, minlength=nb)
        edge_i, edge_j = [i], [j if same else na + j]
        if len(whole):
            for links, lo, hi, n in ((links_a, 0, 1, whole[:, 3] - whole[:, 2]), (links_b, 2, 3, whole[:, 1] - whole[:, 0])):
                step = np.bincount(whole[:, lo], n, len(links) + 1) - np.bincount(whole[:, hi], n, len(links) + 1)
                links += np.cumsum(step)[:-1].astype(np.int64)
            if same:  # a node with itself links no point with itself
                for lo, hi in whole[whole[:, 0] == whole[:, 2], :2]:
                    links_a[lo:hi] -= 1
            spans = {(lo, hi) for lo, hi in whole[:, :2].tolist()} | {(lo + na * (not same), hi + na * (not same)) for lo,
                hi in whole[:, 2:].tolist()}
            for lo, hi in spans:
                edge_i.append(np.full(hi - lo - 1, lo))
                edge_j.append(np.arange(lo + 1, hi))
            edge_i.append(whole[:, 0])
            edge_j.append(whole[:, 2] + na * (not same))
        ids = ia if same else np.concatenate([ia, ib])
        links = links_a if same else np.concatenate([links_a, links_b])
        label = least_labels(len(ids), np.concatenate(edge_i), np.concatenate(edge_j))
        first = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(first, label, ids)
        linked = np.flatnonzero(links > 0)
        cols = [np.concatenate([ids[linked], lone[:, 0]]), np.concatenate([first[label[linked]], lone[:, 1]])]
        return pa.table([pa.array(cols[0]), pa.array(cols[1]),
                pa.array(np.concatenate([links[linked], np.zeros(len(lone), np.int64)]),
                    mask=np.repeat([False, True], [len(linked), len(lone)]))], ["a", "b", "n"])

    return run


def classes(df: DataFrame, threshold: float = THRESHOLD, block: int | None = None) -> DataFrame:
    """(vec_id, class_id, links) of every id: the smallest id of its class, and with how many other ids its cosine is at least ``threshold`` (above 0)."""
    spark = df.sparkSession
    kind = _kind(df)[1]
    reach = float(np.sqrt(2 - 2 * threshold))
    rows = common.saved(clean(df).distinct(), "vectors")
    several = common.saved(rows.groupBy("id").count().where("count > 1").select("id", F.lit(True).alias("many")), "several")
    n = rows.count()
    if block is None:
        parts = max(1, round((8 * spark.sparkContext.defaultParallelism) ** 0.5))
        block = min(max(-(-n // parts), LEAST_BLOCK), MOST_BLOCK)
    marked = rows.join(common.small(several), "id", "left").select("id", "dim", "vec", F.coalesce("many", F.lit(False)).alias("many"))
    placed, centre, stats = parted(marked, kind, block)
    cells = spark.createDataFrame([(*c, *x) for c, x in stats.items()],
        "dim int, cell int, held bigint, many boolean, gap double, first bigint")
    near = common.saved(cells.select("dim", "cell").repartition(min(len(stats), 64) or 1)
        .mapInArrow(_near_cells(centre, stats, reach), "dim int, cell int, other int, whole boolean"), "cells")

    # cells all of whose vectors are linked are counted by their sizes
    full = near.where("whole")
    mine, theirs = (cells.select("dim", F.col("cell").alias(c), F.col("held").alias(f"{c}_held"), F.col("first").alias(f"{c}_first"))
        for c in ("cell", "other"))
    sized = full.join(F.broadcast(mine), ["dim", "cell"]).join(F.broadcast(theirs),
        ["dim", "other"])  # a row a cell, of which there are LEVELS * MOST_CENTRES at most
    by_cell = sized.select("dim", "cell",
        F.when(F.col("cell") == F.col("other"), F.col("other_held") - 1).otherwise(F.col("other_held")).alias("n"))
    by_cell = by_cell.unionByName(sized.where("cell <> other")
        .select("dim", F.col("other").alias("cell"), F.col("cell_held").alias("n"))).groupBy("dim",
        "cell").agg(F.sum("n").alias("n")).where("n > 0")
    by_cell = by_cell.join(cells.select("dim", "cell", "first"), ["dim", "cell"])
    in_cells = placed.join(F.broadcast(by_cell), ["dim", "cell"]).select(F.col("id").alias("a"), F.col("first").alias("b"), "n")
    across = sized.where("cell <> other").select(F.col("cell_first").alias("a"), F.col("other_first").alias("b"),
        F.lit(0).cast("bigint").alias("n"))

    # others block by block
    open_ = near.where("NOT whole").drop("whole")
    cut = {c: -(-x[0] // block) for c, x in stats.items()}
    pieces = spark.createDataFrame([(*c, k) for c, k in cut.items()], "dim int, cell int, pieces int")
    used = open_.select("dim", "cell").union(open_.select("dim", "other")).distinct().join(pieces, ["dim", "cell"])
    whole = placed.join(F.broadcast(used), ["dim", "cell"]).withColumn("piece",
        F.pmod(F.xxhash64("id", "vec"), F.col("pieces")).cast("int"))
    blocks = common.saved(whole.select("id", "dim", "vec", "many", "cell", "piece").groupBy("dim", "cell", "piece")
        .applyInArrow(_build(kind), BLOCKS), "blocks")
    heads = blocks.select("dim", "cell", "piece", "root", "radius")
    others = heads.toDF("dim", "other", "other_piece", "other_root", "other_radius")
    gap = F.sqrt(F.aggregate(F.zip_with("root", "other_root", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    pairs = open_.join(heads, ["dim", "cell"]).join(others,
        ["dim", "other"]).where("cell <> other OR piece <= other_piece").where(gap <= F.col("radius") + F.col("other_radius")
        + F.lit(reach + _SLACK))
    key = ["dim", "cell", "piece", "other", "other_piece"]
    itself = (F.col("cell") == F.col("other")) & (F.col("piece") == F.col("other_piece"))  # shipped once
    a_side = F.struct(F.lit(0).alias("side"), F.col("cell").alias("c"), F.col("piece").alias("p"))
    b_side = F.struct(F.lit(1).alias("side"), F.col("other").alias("c"), F.col("other_piece").alias("p"))
    sides = pairs.select(*key, F.explode(F.when(itself, F.array(a_side)).otherwise(F.array(a_side, b_side))).alias("s")).select(*key,
        "s.side", "s.c", "s.p")
    held = blocks.select(F.col("dim").alias("d"), F.col("cell").alias("c"), F.col("piece").alias("p"), "ids", "vecs", "many", "tree")
    shipped = sides.join(held, (F.col("dim") == F.col("d")) & (sides["c"] == held["c"]) & (sides["p"] == held["p"])).select(*key, "side",
        "ids", "vecs", "many", "tree")
    found = shipped.groupBy(*key).applyInArrow(_compare(threshold, kind), LINKS)
    found = common.saved(found.unionByName(in_cells).unionByName(across), "links")

    lone = found.where("n IS NULL").select("a", "b").distinct()
    counts = found.where("n > 0").select("a",
        "n").unionByName(lone.union(lone.select("b", "a")).select("a", F.lit(1).cast("bigint").alias("n"))).groupBy("a").agg(F.sum("n")
        .alias("n"))
    edges = common.saved(found.where("a <> b").select("a", "b").distinct(), "edges")
    ids = df.select(F.col("vec_id").cast("bigint").alias("vec_id")).where("vec_id IS NOT NULL").distinct()
    if edges.isEmpty():
        return ids.select("vec_id", F.col("vec_id").alias("class_id"), F.lit(0).cast("bigint").alias("links"))
    out = ids.join(minmax_dedup.components(edges), F.col("vec_id") == F.col("node"), "left").join(counts, F.col("vec_id") == F.col("a"),
        "left")
    return out.select("vec_id", F.coalesce("label", "vec_id").alias("class_id"), F.coalesce("n", F.lit(0)).alias("links"))
