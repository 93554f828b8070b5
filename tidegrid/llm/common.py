"""Pieces of Arrow batches, frequency sketches of fixed size, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.bytestrings import mix
from tidegrid.session import cut_lineage

#: A task works on so many bytes of text at a time; a longer text is a piece of its own.
PIECE = 4 << 20
#: Cells of a frequency sketch: 4 MB of counts, whatever the size of the corpus.
CELL_BITS = 20
_CHUNK_BITS = 14


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The rows in runs whose texts hold about ``limit`` bytes."""
    for batch in batches:
        col = batch.column(column)
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0)) if len(col) else np.zeros(0)
        group = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(col)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def count_cells(rows: DataFrame, column: str, hashes) -> np.ndarray:
    """How often each cell of the sketch is hit, over all rows.

    ``hashes(batch)`` gives the 64-bit keys of a batch; their top bits name the cell.  Every
    task adds up its own cells, and equal cells are summed in two steps, so no task and not
    the driver holds more than the fixed number of cells.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(1 << CELL_BITS, np.int64), 0
        for batch in pieces(batches, column):
            keys = hashes(batch)
            seen += len(keys)
            total += np.bincount((keys >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=len(total))
        if seen:
            salt = int(total.sum() % 16)
            for k, part in enumerate(np.split(total, 1 << (CELL_BITS - _CHUNK_BITS))):
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([salt]), pa.array([part.astype("<i8").tobytes()])], ["chunk", "salt", "counts"])

    def total(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> pa.Table:
        out, kept = np.zeros(1 << _CHUNK_BITS, np.int64), {}
        for batch in batches:
            kept = {k: batch.column(k)[0].as_py() for k in keys}
            for x in batch.column("counts"):
                out += np.frombuffer(x.as_buffer(), "<i8")
        return pa.table({**{k: pa.array([v], pa.int64()) for k, v in kept.items()}, "counts": pa.array([out.astype("<i8").tobytes()])})

    def by_salt(table: pa.Table) -> pa.Table:
        return total(table.to_batches(), ("chunk", "salt"))

    def by_chunk(table: pa.Table) -> pa.Table:
        return total(table.to_batches(), ("chunk",))

    cells = rows.mapInArrow(add, "chunk long, salt long, counts binary")
    cells = cells.groupBy("chunk", "salt").applyInArrow(by_salt, "chunk long, salt long, counts binary")
    cells = cut_lineage(cells.groupBy("chunk").applyInArrow(by_chunk, "chunk long, counts binary"))
    out = np.zeros(1 << CELL_BITS, np.int64)
    for row in cells.toLocalIterator():  # 64 rows, 8 MB, at any size of the corpus
        out[row.chunk << _CHUNK_BITS : (row.chunk + 1) << _CHUNK_BITS] = np.frombuffer(row.counts, "<i8")
    return out


def frequency_levels(counts: np.ndarray) -> np.ndarray:
    """Per cell how far it stands out: 0 for keys lost in the noise of the cells, then one more for each doubling.

    A cell of keys that are all rare holds the mean, give or take its root.  So a key is seen as
    frequent from about four roots of the mean on, not only from the mean on.
    """
    mean = max(1.0, counts.sum() / len(counts))
    return np.clip(np.floor(np.log2(np.maximum((counts - mean) / np.sqrt(mean), 1.0))) - 1, 0, 15).astype(np.uint8)


def by_frequency(keys: np.ndarray, levels: np.ndarray, order: int) -> np.ndarray:
    """A total order of the keys: rare before frequent, ties by a hash of their own for each ``order``."""
    level = levels[(keys >> np.uint64(64 - CELL_BITS)).astype(np.int64)].astype(np.uint64)
    return (level << np.uint64(60)) | (mix(keys ^ mix(np.array([order + 1], np.uint64))) >> np.uint64(4))


def recurring(limit: int, same: tuple[str, ...], passing: str | None = None):
    """From rows sorted by ``key`` and ``same``: the different rows of each key that has more than one.

    ``often`` says whether there are more than ``limit``.  Of a key, only the first ``limit`` rows are
    ever held.  Rows where ``passing`` is negative are not looked at and stay.
    """

    def flagged(table: pa.Table, often) -> list[pa.RecordBatch]:
        return table.set_column(table.schema.get_field_index("often"), "often", pa.array(often, pa.bool_())).combine_chunks().to_batches()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.Table | None = None
        running: tuple | None = None  # the last row of a key already known to be held often
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if passing:
                passed = pa.compute.less(table.column(passing), 0)
                if pa.compute.any(passed).as_py():
                    yield from table.filter(passed).to_batches()
                    table = table.filter(pa.compute.invert(passed))
            if carry is not None:
                table = pa.concat_tables([carry, table]).combine_chunks()
            if not table.num_rows:
                continue
            columns = [np.asarray(table.column(c)) for c in ("key", *same)]
            first = np.ones(len(columns[0]), bool)
            fresh = first.copy()
            first[1:] = columns[0][1:] != columns[0][:-1]
            fresh[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
            if running and tuple(c[0] for c in columns) == running:
                fresh[0] = False
            goes_on = bool(running and columns[0][0] == running[0])
            group = (np.cumsum(first) - 1)[fresh]
            size = np.bincount(group, minlength=int(first.sum()))
            often = size > limit
            often[0] |= goes_on
            last = tuple(c[-1] for c in columns)
            table = table.filter(pa.array(fresh))
            take = (often | (size > 1))[group]
            running, carry = (last, None) if often[-1] else (None, table.filter(pa.array(group == len(size) - 1)))
            if carry is not None:
                take &= group != len(size) - 1
            yield from flagged(table.filter(pa.array(take)), often[group[take]])
        if carry is not None and carry.num_rows > 1:
            yield from flagged(carry, [False] * carry.num_rows)

    return of


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
    return r.n, r.h


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(id, component)`` of every id with a link; the component is its smallest id.

    Each round hangs every node's larger neighbours, then its smaller ones, below its smallest
    neighbour, until nothing moves: the links are then stars around the smallest ids.  Rounds
    grow with the logarithm of the longest chain.  The links stay distributed; each round is a
    table in the shared folder.
    """
    def once(df: DataFrame) -> DataFrame:
        return cut_lineage(df.where("hi <> lo").distinct())

    edges = once(links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")))
    state = _state(edges)
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = large.where("hi <> lo").distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(low.select("hi", F.col("m").alias("lo")))
        edges = once(small)
        now = _state(edges)
        if now == state:
            break
        state = now
    tops = edges.select(F.col("lo").alias("id")).distinct()
    return edges.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(tops.select("id", F.col("id").alias("component")))
