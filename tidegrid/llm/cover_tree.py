"""Exact threshold pairs of unit vectors by dual traversal of cover trees.

Equal vectors of a label are one point with a multiplicity.  Points of a label fall into cells around
pivots (bounded in number), and cells into blocks of bounded size: the top of the tree.  Pairs of blocks are pruned by the triangle inequality on angles between
pivots and radii.  A task takes one pair of blocks, builds nested levels with halving radii over
each, and walks down both together: a pair of nodes goes if its centers are further apart than the
threshold and both covering radii, and counts as a whole if even the farthest points are near enough.
What is left at the bottom is decided by the cosine itself.

Each task returns counts per point and a spanning forest of its links, never the pairs.  Vectors of
different lengths are never compared.  Null labels and vectors that are null, zero, or hold a null
or non-finite component link with nothing; rows without an id come back with no links and no
component.  Rows that repeat an id and differ are different points of one component.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import components
from tidegrid.llm.vectors import dot, doubles, is_finite, matrix, nearest, pick_pivots
from tidegrid.session import cut_lineage

_SLACK = 1e-6


@dataclass(frozen=True)
class CosineParams:
    at_least: float = 0.93
    #: Points of a block; pivots of the whole table at most.
    block: int = 1024
    pivots: int = 1024
    #: Node pairs looked at in one step.
    step: int = 1 << 15


class CoverTree:
    """Levels of nodes: per level each node's center (a row), covering radius, first and last child; rows are reordered so that a node's points adjoin."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = x
        n = len(x)
        radius = float(np.pi)
        # Per level: points in node order, where nodes begin, centers.
        order, begin, center = np.arange(n), np.array([0, n]), np.array([0])
        self.levels = [(begin, center)]
        while len(begin) - 1 < n:
            radius /= 2
            alone = radius < 1e-4  # nearly equal points need no more levels
            new_order, new_begin, new_center = [], [0], []
            for a, b, c in zip(begin[:-1], begin[1:], center, strict=True):
                left = order[a:b]
                left = np.concatenate(([c], left[left != c]))  # a center stays one below: levels are nested
                while len(left):
                    if len(left) == 1 or alone:
                        for i in left:
                            new_order.append([i])
                            new_begin.append(new_begin[-1] + 1)
                            new_center.append(i)
                        break
                    near = np.arccos(np.clip(x[left] @ x[left[0]], -1, 1)) <= radius
                    near[0] = True
                    new_order.append(left[near])
                    new_begin.append(new_begin[-1] + int(near.sum()))
                    new_center.append(left[0])
                    left = left[~near]
            order = np.concatenate(new_order).astype(np.int64)
            begin, center = np.array(new_begin), np.array(new_center)
            self.levels.append((begin, center))
        self.order = order
        self.nodes = []
        for depth, (begin, center) in enumerate(self.levels):
            size = np.diff(begin)
            node = np.repeat(np.arange(len(size)), size)
            away = np.arccos(np.clip((x[order] * x[center[node]]).sum(1), -1, 1)) if n else np.zeros(0)
            cover = np.maximum.reduceat(away, begin[:-1]) if n else np.zeros(0)
            cover[size == 1] = 0
            below = np.searchsorted(self.levels[depth + 1][0], begin) if depth + 1 < len(self.levels) else begin
            self.nodes.append((begin, center, cover, below))


def _children(tree: CoverTree, depth: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First child and number of children; at the bottom a node is its own child."""
    if depth + 1 >= len(tree.nodes):
        return node, np.ones(len(node), np.int64)
    below = tree.nodes[depth][3]
    return below[node], below[node + 1] - below[node]


def near_pairs(left: CoverTree, right: CoverTree, same: bool, p: CosineParams):
    """Yields ``(a, b, c, d)``: all points ``left.order[a:b]`` are near all points ``right.order[c:d]``.

    With ``same``, both trees are one, and of each pair of different points one direction is given.
    """
    theta = float(np.arccos(p.at_least))
    todo = [(0, np.zeros(1, np.int64), np.zeros(1, np.int64))] if len(left.x) and len(right.x) else []
    deepest = max(len(left.nodes), len(right.nodes)) - 1
    while todo:
        depth, u, v = todo.pop()
        du, dv = min(depth, len(left.nodes) - 1), min(depth, len(right.nodes) - 1)
        bu, cu, ru, _ = left.nodes[du]
        bv, cv, rv, _ = right.nodes[dv]
        cosine = np.einsum("ij,ij->i", left.x[cu[u]], right.x[cv[v]])
        angle, reach = np.arccos(np.clip(cosine, -1, 1)), ru[u] + rv[v]
        keep = angle <= theta + reach + _SLACK
        if same:
            keep &= u <= v
        whole = keep & (angle + reach < theta - _SLACK)
        if same:
            whole &= u < v
        single = (bu[u + 1] - bu[u] == 1) & (bv[v + 1] - bv[v] == 1)
        decided = keep & ~whole & single
        hit = whole | (decided & (cosine >= p.at_least) & ((u < v) if same else True))
        if hit.any():
            yield bu[u[hit]], bu[u[hit] + 1], bv[v[hit]], bv[v[hit] + 1]
        go = keep & ~whole & ~single
        u, v = u[go], v[go]
        if not len(u):
            continue
        assert depth < deepest
        fu, nu = _children(left, du, u)
        fv, nv = _children(right, dv, v)
        count = nu * nv
        ends = np.cumsum(count)
        for first in range(0, int(ends[-1]), p.step):
            k = np.arange(first, min(first + p.step, int(ends[-1])))
            pair = np.searchsorted(ends, k, "right")
            inside = k - (ends[pair] - count[pair])
            todo.append((depth + 1, fu[pair] + inside // nv[pair], fv[pair] + inside % nv[pair]))


def _solve(p: CosineParams):
    def of(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side = np.asarray(table.column("side"))
        point = np.asarray(table.column("point"))
        times = np.asarray(table.column("times"))
        x = matrix(table.column("v").chunk(0)) if table.num_rows else np.zeros((0, 0))
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = not len(two)
        left = CoverTree(x[one])
        right = left if same else CoverTree(x[two])
        a_rows, b_rows = one[left.order], (one if same else two)[right.order]
        count = np.zeros(len(point) + 1, np.int64)
        gain_a, gain_b = np.zeros(len(a_rows) + 1, np.int64), np.zeros(len(b_rows) + 1, np.int64)
        sum_a, sum_b = (np.concatenate(([0], np.cumsum(times[r]))) for r in (a_rows, b_rows))
        top = np.arange(len(point))

        def root(i: int) -> int:
            while top[i] != i:
                top[i] = top[top[i]]
                i = top[i]
            return int(i)

        links = []

        def join(i: int, j: int) -> None:
            s, t = root(i), root(j)
            if s != t:
                top[max(s, t)] = min(s, t)
                links.append((point[i], point[j]))

        for a, b, c, d in near_pairs(left, right, same, p):
            np.add.at(gain_a, a, sum_b[d] - sum_b[c])
            np.add.at(gain_a, b, -(sum_b[d] - sum_b[c]))
            np.add.at(gain_b, c, sum_a[b] - sum_a[a])
            np.add.at(gain_b, d, -(sum_a[b] - sum_a[a]))
            for i, j, k, m in zip(a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True):
                for z in range(i, j):
                    join(a_rows[z], b_rows[k])
                for z in range(k + 1, m):
                    join(a_rows[i], b_rows[z])
        np.add.at(count, a_rows, np.cumsum(gain_a)[:-1])
        np.add.at(count, b_rows, np.cumsum(gain_b)[:-1])
        some = np.flatnonzero(count[:-1])
        nothing = pa.nulls(len(some), pa.int64())
        counts = pa.table({"point": pa.array(point[some]), "links": pa.array(count[some]), "other": nothing})
        pairs = pa.table({"point": pa.array([i for i, _ in links], pa.int64()), "links": pa.array(np.zeros(len(links), np.int64)), "other": pa.array([j for _, j in links], pa.int64())})
        return pa.concat_tables([counts, pairs])

    return of


def near_duplicates(rows: DataFrame, params: CosineParams | None = None) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each row of ``rows(vec_id, embedding, label)``."""
    p = params or CosineParams()
    spark = rows.sparkSession
    theta = float(np.arccos(p.at_least))
    taken = rows.select("vec_id", "label", doubles("embedding").alias("v"))
    good = taken.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & is_finite("v"))
    good = good.where(F.array_max(F.transform("v", F.abs)) > 0)

    def once(value, body):
        """``body`` of a value that is not computed again for each component."""
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def unit(v):
        return once(F.sqrt(dot(v, v)), lambda n: F.transform(v, lambda x: x / n))

    largest = F.array_max(F.transform("v", F.abs))
    scaled = once(largest, lambda m: F.transform("v", lambda x: x / m))
    good = cut_lineage(good.select("vec_id", "label", once(scaled, unit).alias("v")))
    points = good.groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("times"))
    points = cut_lineage(points.select("id", F.col("label").cast("string").alias("label"), "v", "times", F.monotonically_increasing_id().alias("point")))

    total = points.count()
    pivots = pick_pivots(points, min(p.pivots, -(-total // p.block)), max(1, total))
    shared = spark.sparkContext.broadcast(pivots)
    per_label = points.groupBy("label").agg(F.ceil(F.count("*") / p.block).alias("among"))
    celled = nearest(points.join(per_label, "label").select("point", "label", "v", "times", "among"), shared, True, "point long, label string, v array<double>, times long, among long")
    celled = cut_lineage(celled.select("point", "label", "v", "times", "cell", "away", F.size("v").alias("dim")))
    place = ["label", "dim", "cell"]
    parts = celled.groupBy(*place).agg(F.ceil(F.count("*") / p.block).alias("k"), F.max("away").alias("most"))
    blocks = parts.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("part"))
    key = F.struct("cell", "part")
    center = F.from_json(F.lit(str(pivots.tolist())), "array<array<double>>")
    one = blocks.select("label", "dim", key.alias("a"), F.col("most").alias("ma"))
    two = blocks.select("label", "dim", key.alias("b"), F.col("most").alias("mb"))
    apart = F.acos(F.greatest(F.least(dot(F.get(center, F.col("a.cell").cast("int")), F.get(center, F.col("b.cell").cast("int"))), F.lit(1.0)), F.lit(-1.0)))
    gap = F.when(F.col("a.cell") != F.col("b.cell"), apart - F.col("ma") - F.col("mb"))
    pairs = one.join(two, ["label", "dim"]).where((F.col("a") <= F.col("b")) & (F.coalesce(gap, F.lit(0.0)) <= theta + _SLACK)).select("label", "dim", "a", "b")

    placed = celled.join(parts.select(*place, "k"), place).withColumn("part", F.pmod(F.xxhash64("point"), F.col("k")))
    placed = placed.select("label", "dim", key.alias("at"), "point", "times", "v")
    sides = pairs.select("label", "dim", "a", "b", F.col("a").alias("at"), F.lit(0).alias("side")).unionByName(
        pairs.where("a < b").select("label", "dim", "a", "b", F.col("b").alias("at"), F.lit(1).alias("side"))
    )
    found = placed.join(sides, ["label", "dim", "at"]).groupBy("label", "dim", "a", "b").applyInArrow(_solve(p), "point long, links long, other long")
    found = cut_lineage(found)

    near = found.groupBy("point").agg(F.sum("links").alias("links"))
    ids = points.select("point", "id")
    links = found.where("other is not null").join(ids, "point").select(F.col("id").alias("x"), F.col("other").alias("point")).join(ids, "point")
    joined = components(links.select("x", F.col("id").alias("y")), "x", "y")
    result = points.join(near, "point", "left").select("label", "v", F.col("id").alias("first"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"))
    per_row = good.select("vec_id", F.col("label").cast("string").alias("label"), "v").join(result, ["label", "v"]).select("vec_id", "n_links", "first")
    per_row = per_row.join(joined.withColumnRenamed("id", "first"), "first", "left").select("vec_id", "n_links", F.coalesce("component", "first").alias("component_id"))
    rest = taken.select("vec_id", "label", "v").where(~(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & is_finite("v")) | (F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0.0)) == 0))
    rest = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return per_row.unionByName(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))
