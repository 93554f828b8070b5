"""Rows with usable vectors, and cells around pivots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(vector: str | Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def is_finite(vector: str | Column) -> Column:
    """No null, NaN or infinite component, at least one component."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(ok & (F.size(vector) > 0), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def pick_pivots(points: DataFrame, count: int, total: int) -> np.ndarray:
    """About ``count`` different vectors of ``points(id, v)``, by a hash of the id; at most four times as many."""
    share = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    rows = points.where(share * total < 2 * count).select("v").limit(4 * count).collect() if count > 1 else []
    found = np.unique(np.array([r.v for r in rows], np.float64), axis=0) if rows else np.zeros((0, 0))
    return found[:: max(1, len(found) // max(1, count))][:count]


def nearest(points: DataFrame, pivots, angular: bool, schema: str) -> DataFrame:
    """``points`` with the number of the pivot nearest to ``v`` among the first ``among``, and the distance to it.

    ``pivots``: a broadcast array of rows.  A vector of another length than the pivots, or with fewer
    than two to choose from, is in cell -1, at distance 0.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = pivots.value
        for batch in batches:
            n = batch.num_rows
            cell, away = np.full(n, -1, np.int64), np.zeros(n)
            length = np.asarray(pa.compute.list_value_length(batch.column("v")))
            among = np.asarray(batch.column("among"))
            same = np.flatnonzero((length == centers.shape[1]) & (among > 1)) if len(centers) > 1 else np.zeros(0, np.int64)
            if len(same):
                x = matrix(batch.column("v").take(pa.array(same)))
                if angular:
                    d = np.arccos(np.clip(x @ centers.T, -1, 1))
                else:
                    d = np.sqrt(np.maximum(((x * x).sum(1)[:, None] - 2 * (x @ centers.T)) + (centers * centers).sum(1), 0))
                d[np.arange(len(centers)) >= among[same][:, None]] = np.inf
                cell[same] = d.argmin(1)
                away[same] = d.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], [*batch.schema.names, "cell", "away"])

    return points.mapInArrow(of, f"{schema}, cell long, away double")
