"""Removal of byte strings that occur earlier, by sorting sampled suffixes and merging the rest.

A difference cover is a sample of positions with one property: any two equal strings of the length
in question meet a sampled position at the same distance from their starts.  A periodic cover holds
at least a tenth of all positions (two thirds, in triples) and every suffix has to be shipped to be
merged.  The cover here is defined by content instead: the position of the rarest, then smallest,
24-byte substring within each 100 bytes.  Equal strings have it at the same distance, one position in 40 is sampled, and
those whose 24 bytes occur once in the corpus can be dropped before anything is sorted.

1. All 24-byte substrings are counted in a sketch of fixed size, for the order rare before frequent.
2. Each 100-byte string belongs to its sampled position.  Sampled positions are brought together by
   their 24 bytes; those that are alone go.
3. Around those that are left, the text goes along.  Their suffixes are sorted as triples of 8-byte
   words, triples of the names that gives, and so on, and so are the prefixes before them, read backwards.
4. Every other position is merged in through its sampled one: it is (the bytes before the sample,
   the name of the suffix at it), at its distance.  Adjacent entries that agree in these are equal
   strings; all but the earliest are marked.
5. Positions whose 24 bytes are very frequent, in many documents or in one, are first compared
   in parts; what is earliest in its part is compared again, all of a key together.
6. Marked strings are joined to spans per document and cut out.

A null text is empty.  A row without an id has no place in the order: it is not compared and stays whole.
Rows that repeat an id are the same document; if their texts differ, the largest counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.bytestrings import U, mix, utf8
from tidegrid.llm.common import CELL_BITS, by_frequency, count_cells, frequency_levels, pieces, recurring, signed
from tidegrid.session import cut_lineage

_POS_BITS = 21
#: Positions whose hashes are made together, so that they stay near the processor.
_STRETCH = 1 << 14


@dataclass(frozen=True)
class DedupParams:
    #: Bytes of a string; of the substring that samples it (at least 8).
    length: int = 100
    gram: int = 24
    #: A sampled substring with more positions is compared in parts of about this size.
    part: int = 4096
    #: Level of frequency from which a substring is taken to recur.
    frequent: int = 3


def _grams(raw: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes at each position; a polynomial over the 8-byte words there, so it needs no carry between positions."""
    n = len(raw) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.empty(n, U)
    for a in range(0, n, _STRETCH):
        out[a : a + _STRETCH] = _few_grams(raw[a : a + _STRETCH + size - 1], size)
    return out


def _few_grams(raw: np.ndarray, size: int) -> np.ndarray:
    n = len(raw) - size + 1
    # The word at each position, from eight readings of the bytes as words.
    word = np.empty(len(raw) - 7, U)
    for k in range(min(8, len(word))):
        part = np.frombuffer(raw[k : k + (len(raw) - k) // 8 * 8].tobytes(), "<u8")
        word[k::8] = part[: len(word[k::8])]
    out, other = np.zeros(n, U), np.empty(n, U)
    for k in [*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]:
        out ^= word[k : k + n]
        out *= U(0x9FB21C651E98DF25)
        np.right_shift(out, U(29), out=other)
        out ^= other
    return mix(out)


def _valid_grams(size: int):
    def of(batch: pa.RecordBatch) -> np.ndarray:
        raw, at = utf8(batch.column("text"))
        h = _grams(raw, size)
        ok = np.ones(len(raw), bool)
        for k in range(1, size):
            ok[np.maximum(at[1:] - k, at[:-1])[np.diff(at) >= k]] = False
        return h[ok[: len(h)]]

    return of


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values in a row: runs of twice the length from two runs, a stretch at a time."""
    n = len(values) - width + 1
    out = np.empty(max(n, 0), U)
    for a in range(0, n, _STRETCH):
        least, reach = values[a : a + _STRETCH + width - 1], 1
        while 2 * reach <= width:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        out[a : a + _STRETCH] = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    return out


def sampled(raw: np.ndarray, at: np.ndarray, levels: np.ndarray, p: DedupParams) -> tuple[np.ndarray, ...]:
    """Runs of strings with one sampled position: row, position, first and last start (all in ``raw``), key."""
    parts = []
    step = 1 << 20
    for base in range(0, max(1, len(raw)), step):
        text = raw[base : base + step + p.length - 1]
        starts = min(step, len(text) - p.length + 1)
        if starts <= 0:
            continue
        h = _grams(text, p.gram)
        packed = ((by_frequency(h, levels, 0) >> U(_POS_BITS)) << U(_POS_BITS)) | np.arange(len(h), dtype=U)
        owner = (_sliding_min(packed, p.length - p.gram + 1)[:starts] & U((1 << _POS_BITS) - 1)).astype(np.int64)
        start = np.arange(base, base + starts)
        row = np.searchsorted(at, start, "right") - 1
        ok = start + p.length <= at[1:][row]
        start, row, owner = start[ok], row[ok], owner[ok]
        cut = np.ones(len(start), bool)
        cut[1:] = (owner[1:] != owner[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(cut)
        last = np.concatenate((first[1:], [len(start)]))[: len(first)] - 1
        parts.append((row[first], owner[first] + base, start[first], start[last], h[owner[first]]))
    if not parts:
        z = np.zeros(0, np.int64)
        return z, z, z, z, np.zeros(0, U)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _blocks(row: np.ndarray, key: np.ndarray, spot: np.ndarray, p: DedupParams) -> np.ndarray:
    """The positions of a key in one text numbered in blocks of a quarter of a part; the first block is 0."""
    order = np.lexsort((spot, key, row))
    new = np.ones(len(order), bool)
    new[1:] = (row[order][1:] != row[order][:-1]) | (key[order][1:] != key[order][:-1])
    at = np.arange(len(order))
    out = np.empty(len(order), U)
    out[order] = ((at - np.maximum.accumulate(np.where(new, at, 0))) // max(1, p.part // 4)).astype(U)
    return out


def _positions(levels, p: DedupParams):
    """``key, id, spot, often, salt``: the spot packs the position and the starts of its strings.

    A substring far more frequent than others recurs for certain; its positions are spread (``salt`` below 0).
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            raw, at = utf8(batch.column("text"))
            row, place, first, last, key = sampled(raw, at, levels.value, p)
            ids = np.asarray(batch.column("id"), np.int64)
            begin = at[:-1][row]
            spot = ((place - begin) << 16) | ((place - first) << 8) | (last - first)
            often = levels.value[(key >> U(64 - CELL_BITS)).astype(np.int64)] >= p.frequent
            salt = np.where(often, -1 - ((mix(ids[row].view(U)) + _blocks(row, key, spot, p)) & U(1023)).astype(np.int64), 0)
            columns = [pa.array(signed(key)), pa.array(ids[row]), pa.array(spot), pa.array(often), pa.array(salt)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "id", "spot", "often", "salt"])

    return of


def _contexts(p: DedupParams):
    """From texts with their recurring spots to one row per spot with the bytes of all its strings."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            raw, at = utf8(batch.column("text"))
            lists = batch.column("spots")
            row = np.repeat(np.arange(batch.num_rows), np.asarray(pa.compute.list_value_length(lists)))
            flat = lists.flatten()
            key, spot, parts = (flat.field(c) for c in ("key", "spot", "parts"))
            packed = np.asarray(spot)
            first = at[:-1][row] + (packed >> 16) - ((packed >> 8) & 255)
            size = (packed & 255) + p.length
            # A text with few positions of a key is in one part; blocks of many go round the parts.
            block = _blocks(row, np.asarray(key), packed, p)
            # Some thousand spots at a time.
            for a in range(0, len(row), 1 << 14):
                b = min(a + (1 << 14), len(row))
                ends = np.cumsum(size[a:b])
                take = np.repeat(first[a:b] - (ends - size[a:b]), size[a:b]) + np.arange(ends[-1])
                offsets = np.concatenate(([0], ends)).astype(np.int32)
                seg = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets), pa.py_buffer(raw[take])])
                ids = np.asarray(batch.column("id"), np.int64)[row[a:b]]
                salt = (mix(ids.view(U) + U(11)) + block[a:b]) % np.asarray(parts.slice(a, b - a), np.int64).astype(U)
                yield pa.RecordBatch.from_arrays(
                    [key.slice(a, b - a), pa.array(salt.astype(np.int64)), parts.slice(a, b - a), pa.array(ids), pa.array(packed[a:b]), seg, pa.nulls(b - a, pa.binary())],
                    ["key", "part", "parts", "id", "spot", "seg", "open"],
                )

    return of


def _names(group: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Ranks of the rows of ``context`` within groups: sort triples of words, then triples of names, until one name is left."""
    pad = -context.shape[1] % 8
    words = np.concatenate((context, np.zeros((len(context), pad), np.uint8)), axis=1).view(">u8").astype(U)
    columns = [words[:, k] for k in range(words.shape[1])]
    prefix = group
    while True:
        out = []
        for k in range(0, len(columns), 3):
            triple = [*columns[k : k + 3]]
            last = len(columns) <= 3
            keys = triple[::-1] + ([prefix] if last else [])
            order = np.lexsort(keys)
            new = np.zeros(len(order), bool)
            for c in keys:
                new[1:] |= c[order][1:] != c[order][:-1]
            name = np.empty(len(order), U)
            name[order] = np.cumsum(new).astype(U)
            out.append(name)
        if len(out) == 1:
            return out[0]
        columns = out


def _agreement(context: np.ndarray, order: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Bytes in which each row of the sorted contexts agrees with the row before it; -1 at a group's start."""
    sorted_rows = context[order]
    same = np.ones((len(order), context.shape[1] + 1), bool)
    same[:, -1] = False
    same[1:, :-1] = sorted_rows[1:] == sorted_rows[:-1]
    out = same.argmin(1)
    g = group[order]
    out[0] = -1
    out[1:][g[1:] != g[:-1]] = -1
    return out


def _marked(group: np.ndarray, ids: np.ndarray, spot: np.ndarray, seg: list[bytes] | tuple, opened: np.ndarray, p: DedupParams) -> np.ndarray:
    """Rows x distances: is the string that starts so many bytes before the sampled position preceded by an equal one?

    ``group`` is sorted; ``opened`` says which strings are to be looked at.
    """
    raw, offsets = seg
    n, reach = len(group), p.length - p.gram
    place, left, count = spot >> 16, (spot >> 8) & 255, spot & 255
    size = np.diff(offsets)
    # Bytes from the sampled position on, and backwards from it; zeros where the segment ends.
    ahead_at = offsets[:-1, None] + left[:, None] + np.arange(p.length)
    ahead = np.where(left[:, None] + np.arange(p.length) < size[:, None], raw[np.minimum(ahead_at, len(raw) - 1)], 0).astype(np.uint8)
    back_at = offsets[:-1, None] + left[:, None] - 1 - np.arange(reach)
    back = np.where(np.arange(reach) < left[:, None], raw[np.maximum(back_at, 0)], 0).astype(np.uint8)
    place_rank = np.lexsort((place, ids))
    new = np.ones(n, bool)
    new[1:] = (ids[place_rank][1:] != ids[place_rank][:-1]) | (place[place_rank][1:] != place[place_rank][:-1])
    rank = np.empty(n, np.int64)
    rank[place_rank] = np.cumsum(new)
    right_order = np.argsort(_names(group.astype(U), ahead), kind="stable")
    left_order = np.argsort(_names(group.astype(U), back), kind="stable")
    right_agree, left_agree = _agreement(ahead, right_order, group), _agreement(back, left_order, group)
    out = np.zeros((n, reach + 1), bool)
    right_class, left_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(reach + 1):
        rows = np.flatnonzero(opened[:, d] & (left >= d) & (left - count <= d))
        if len(rows) < 2:
            continue
        right_class[right_order] = np.cumsum(right_agree < p.length - d)
        left_class[left_order] = np.cumsum(left_agree < d)
        both = right_class[rows] * (n + 1) + left_class[rows]
        order = np.lexsort((rank[rows], both))
        both, rows = both[order], rows[order]
        first = np.ones(len(rows), bool)
        first[1:] = both[1:] != both[:-1]
        least = rank[rows][np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))]
        out[rows, d] = rank[rows] > least
    return out


_MARKS = "id long, begin long, end long"
_CONTEXT = "key long, part long, parts long, id long, spot long, seg binary, open binary"


def _compare(p: DedupParams, rest: bool):
    """From rows sorted by key and part to marked stretches ``(id, begin, end)``.

    With ``rest``, of keys in several parts instead the rows with strings that are not marked, with
    those strings: they are compared again, all in one part.
    """
    reach = p.length - p.gram

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        if rest:
            table = table.filter(pa.compute.greater(table.column("parts"), 1)).combine_chunks()
        if not table.num_rows:
            return
        key, part = (np.asarray(table.column(c)) for c in ("key", "part"))
        ids, spot = np.asarray(table.column("id")), np.asarray(table.column("spot"))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1])
        column = table.column("open")
        if column.null_count == len(column):
            opened = np.ones((len(key), reach + 1), bool)
        else:
            opened = np.unpackbits(utf8(column)[0].reshape(len(key), -1), axis=1)[:, : reach + 1].astype(bool)
        marked = _marked(np.cumsum(new) - 1, ids, spot, utf8(table.column("seg")), opened, p)
        if rest:
            left, count = (spot >> 8) & 255, spot & 255
            d = np.arange(reach + 1)
            more = opened & ~marked & (d <= left[:, None]) & (d >= (left - count)[:, None])
            keep = np.flatnonzero(more.any(1))
            bits = pa.array([x.tobytes() for x in np.packbits(more[keep], axis=1)], pa.binary())
            take = table.take(pa.array(keep))
            one = pa.array(np.ones(len(keep), np.int64))
            columns = [take.column("key"), pa.array(np.zeros(len(keep), np.int64)), one, take.column("id"), take.column("spot"), take.column("seg"), bits]
            yield from pa.table(columns, take.column_names).combine_chunks().to_batches()
            return
        # A stretch of starts is a run of distances, from the largest to the smallest.
        edge = np.diff(np.pad(marked, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, low = np.nonzero(edge == 1)
        high = np.nonzero(edge == -1)[1]
        place = spot[row] >> 16
        yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(place - high + 1), pa.array(place - low + p.length)], ["id", "begin", "end"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < 20_000:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            key, part = np.asarray(table.column("key")), np.asarray(table.column("part"))
            other = np.flatnonzero((key != key[-1]) | (part != part[-1]))
            tail = int(other[-1]) + 1 if len(other) else 0
            if tail:
                yield from solve(table.slice(0, tail))
            held, rows = table.slice(tail).to_batches(), table.num_rows - tail
        if rows:
            yield from solve(pa.Table.from_batches(held))

    return of


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the stretches of each text and takes them out."""
    for batch in pieces(batches, "text"):
        raw, at = utf8(batch.column("text"))
        spans, kept, removed = [], [], []
        for i, marks in enumerate(batch.column("marks").to_pylist()):
            text = raw[at[i] : at[i + 1]]
            runs: list[list[int]] = []
            for m in sorted(marks or [], key=lambda m: m["begin"]):
                if runs and m["begin"] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], m["end"])
                else:
                    runs.append([m["begin"], m["end"]])
            keep = np.ones(len(text), bool)
            for a, b in runs:
                keep[a:b] = False
            spans.append([{"begin": a, "end": b} for a, b in runs])
            kept.append(text[keep].tobytes())
            removed.append(int((~keep).sum()))
        spans_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        rest = [c for c in batch.schema.names if c not in ("marks", "text")]
        out = [batch.column(c) for c in rest]
        yield pa.RecordBatch.from_arrays(
            [*out, pa.array(np.diff(at)), pa.array(removed, pa.int64()), pa.array(spans, spans_type), pa.array(kept, pa.binary()), pa.array([k.decode("utf-8", "ignore") for k in kept])],
            [*rest, "n_bytes", "n_removed", "spans", "kept", "kept_text"],
        )


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", params: DedupParams | None = None) -> DataFrame:
    """The rows of ``docs`` as ``id`` with ``n_bytes, n_removed, spans`` (byte ranges taken out), ``kept`` (the other bytes) and ``kept_text`` (these without torn characters)."""
    p = params or DedupParams()
    spark = docs.sparkSession
    every = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    rows = every.where("id is not null")
    twice = rows.groupBy("id").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b")).where("a <> b")
    if not twice.isEmpty():
        largest = rows.groupBy("id").agg(F.max("text").alias("text"), F.count("*").alias("n"))
        rows = cut_lineage(largest.select("id", "text", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("k"))).select("id", "text")
    levels = spark.sparkContext.broadcast(frequency_levels(count_cells(rows.select("text"), "text", _valid_grams(p.gram))))

    schema = "key long, id long, spot long, often boolean, salt long"
    found = rows.mapInArrow(_positions(levels, p), schema).repartition("key", "salt").sortWithinPartitions("key", "id", "spot")
    found = cut_lineage(found.mapInArrow(recurring(p.part, ("id", "spot"), passing="salt"), schema).drop("salt"))
    parts = found.where("often").groupBy("key").agg(F.ceil(F.count("*") / p.part).cast("long").alias("parts"))
    spots = found.join(parts, "key", "left").select("id", F.struct("key", "spot", F.coalesce("parts", F.lit(1)).cast("long").alias("parts")).alias("s"))
    # Tables here and below: the shuffles so far go before those of the texts are made.
    spots = cut_lineage(spots.groupBy("id").agg(F.collect_set("s").alias("spots")))

    context = rows.join(spots, "id").mapInArrow(_contexts(p), _CONTEXT).repartition("key", "part").sortWithinPartitions("key", "part")
    again = context.mapInArrow(_compare(p, True), _CONTEXT).repartition("key").sortWithinPartitions("key", "part")
    marks = context.mapInArrow(_compare(p, False), _MARKS).unionByName(again.mapInArrow(_compare(p, False), _MARKS))
    marks = cut_lineage(marks).groupBy("id").agg(F.collect_list(F.struct("begin", "end")).alias("marks"))
    schema = "id long, n_bytes long, n_removed long, spans array<struct<begin:long,end:long>>, kept binary, kept_text string"
    nameless = every.where("id is null").withColumn("marks", F.array().cast("array<struct<begin:bigint,end:bigint>>"))
    return rows.join(marks, "id", "left").select("id", "text", "marks").unionByName(nameless).mapInArrow(_cut, schema)
