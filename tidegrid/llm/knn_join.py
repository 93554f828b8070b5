"""Exact top-k by integer inner product: a kNN join over Voronoi groups.

Components are ``floor(64 x)``.  Queries and data are assigned to the nearest of a bounded number
of pivots.  A summary per data group holds its radius, its largest norm and its k smallest
distances to the pivot; a summary per query group its radius and largest norm.  From these each
query group gets a bound: at least k vectors score as high with every query of the group.  A vector is
replicated to a query group only if it can reach the group's bound.  Each task solves a block of queries of a
group against a block of its vectors; the blocks' best k are merged per query.

Ties go to the smaller id.  Null vectors and those with a null or non-finite component take no
part, nor do rows without an id; vectors of another length are no candidates.  Rows that repeat
a query's id are not its candidates.  Scores are 64-bit; components beyond 2^20 are multiplied as
integers, not as doubles.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.vectors import dot, doubles, is_finite, matrix, nearest, pick_pivots
from tidegrid.session import cut_lineage


@dataclass(frozen=True)
class KnnParams:
    k: int = 20
    #: Pivots at most; queries and vectors of a block.
    pivots: int = 64
    queries: int = 512
    block: int = 8192


def _best(p: KnnParams):
    def of(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        asked = np.asarray(table.column("asked")).astype(bool)
        ids = np.asarray(table.column("id"))
        x = matrix(table.column("v").chunk(0))
        exact = np.abs(x).max(initial=0) < 1 << 20
        x = x if exact else x.astype(np.int64)
        order = np.flatnonzero(~asked)
        order = order[np.argsort(ids[order], kind="stable")]
        data, data_ids = x[order], ids[order]
        out: list[tuple[np.ndarray, ...]] = []
        for first in range(0, int(asked.sum()), 128):
            rows = np.flatnonzero(asked)[first : first + 128]
            scores = x[rows] @ data.T
            for q, s in zip(ids[rows], scores, strict=True):
                other = data_ids != q
                k = min(p.k, int(other.sum()))
                if not k:
                    continue
                least = np.partition(s[other], -k)[-k]
                at = np.flatnonzero((s >= least) & other)
                at = at[np.lexsort((data_ids[at], -s[at]))][:k]
                out.append((np.full(k, q), data_ids[at], s[at].astype(np.int64)))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table([pa.array(c) for c in columns], ["query_id", "id", "score"])

    return of


def _length(v: str | Column) -> Column:
    return F.sqrt(dot(F.col(v) if isinstance(v, str) else v, F.col(v) if isinstance(v, str) else v))


def top_k(rows: DataFrame, is_query: Column, params: KnnParams | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for each of the ``rows(vec_id, embedding)`` that is a query."""
    p = params or KnnParams()
    spark = rows.sparkSession
    whole = F.transform(doubles("embedding"), lambda x: F.floor(x * 64).cast("double"))
    good = rows.where(F.col("vec_id").isNotNull() & is_finite(doubles("embedding")))
    points = cut_lineage(good.select(F.col("vec_id").cast("long").alias("id"), is_query.alias("asked"), whole.alias("v")).withColumn("row", F.monotonically_increasing_id()))
    counts = points.agg(F.count("*").alias("n"), F.count_if("asked").alias("q")).first()
    pivots = pick_pivots(points, min(p.pivots, -(-counts.q // p.queries)), max(1, counts.n))
    shared = spark.sparkContext.broadcast(pivots)
    placed = nearest(points.withColumn("among", F.lit(p.pivots).cast("long")), shared, False, "id long, asked boolean, v array<double>, row long, among long")
    placed = cut_lineage(placed.select("id", "asked", "v", "row", "cell", "away", F.size("v").alias("dim"), _length("v").alias("norm")))

    # Summaries: one row per length and pivot.
    place = ["dim", "cell"]
    # Per vector, a partial top of the smallest distances keeps the groups bounded.
    near = placed.withColumn("slot", F.pmod(F.xxhash64("row"), F.lit(64)))
    slot = Window.partitionBy(*place, "slot").orderBy("away", "row")
    near = near.select(*place, "away", "row", F.row_number().over(slot).alias("r")).where(F.col("r") <= p.k + 1)
    near = near.groupBy(*place).agg(F.slice(F.sort_array(F.collect_list("away")), 1, p.k + 1).alias("nearest"))
    groups = placed.groupBy(*place).agg(F.max("away").alias("radius"), F.max("norm").alias("longest")).join(near, place)
    askers = placed.where("asked").groupBy(*place).agg(F.max("away").alias("reach"), F.max("norm").alias("size"), F.count("*").alias("m"))

    center = F.from_json(F.lit(str(pivots.tolist())), "array<array<double>>")
    g, c = F.get(center, F.col("grp").cast("int")), F.get(center, F.col("cell").cast("int"))
    pairs = askers.withColumnRenamed("cell", "grp").join(groups, "dim")
    pairs = pairs.withColumns({"between": dot(g, c), "drift": F.col("reach") * _length(c)})
    # Score of query q and vector x: |q.x - p_g.p_c| <= reach |p_c| + |q| |x - p_c|.
    sure = F.transform("nearest", lambda r: F.col("between") - F.col("drift") - F.col("size") * r)
    tops = pairs.groupBy("dim", "grp", "m").agg(F.flatten(F.collect_list(F.coalesce(sure, F.array().cast("array<double>")))).alias("sure"))
    bound = F.get(F.reverse(F.sort_array("sure")), F.lit(p.k))
    bounds = tops.select("dim", "grp", "m", F.coalesce(bound, F.lit(float("-inf"))).alias("bound"))
    slack = 1e-6 * (1 + F.abs("bound"))
    reachable = pairs.join(bounds.select("dim", "grp", "bound"), ["dim", "grp"])
    reachable = reachable.where(F.coalesce(F.col("between") + F.col("drift") + F.col("size") * F.col("radius"), F.lit(float("inf"))) >= F.col("bound") - slack)
    reachable = reachable.where(F.col("size") * F.col("longest") >= F.col("bound") - slack).select("dim", "cell", "grp", "between", "drift", "size", "bound")

    able = F.coalesce(F.col("between") + F.col("drift") + F.col("size") * F.col("away"), F.lit(float("inf"))) >= F.col("bound") - slack
    data = placed.join(reachable, place).where(able & (F.col("size") * F.col("norm") >= F.col("bound") - slack)).select("dim", "grp", "id", "v", "row")
    parts = data.groupBy("dim", "grp").agg(F.ceil(F.count("*") / p.block).alias("blocks"))
    shape = bounds.select("dim", "grp", F.ceil(F.col("m") / p.queries).alias("lists")).join(parts, ["dim", "grp"])
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    data = data.join(shape, ["dim", "grp"]).select("dim", "grp", "id", "v", F.lit(0).alias("asked"), each("lists").alias("i"), F.pmod(F.xxhash64("row", F.lit(1)), F.col("blocks")).alias("j"))
    asked = placed.where("asked").withColumnRenamed("cell", "grp").join(shape, ["dim", "grp"])
    asked = asked.select("dim", "grp", "id", "v", F.lit(1).alias("asked"), F.pmod(F.xxhash64("row", F.lit(2)), F.col("lists")).alias("i"), each("blocks").alias("j"))
    found = asked.unionByName(data).groupBy("dim", "grp", "i", "j").applyInArrow(_best(p), "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.k)
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
