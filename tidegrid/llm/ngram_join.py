"""Jaccard self-join on word n-grams by prefix filters under several global token orders.

Two sets with Jaccard similarity of at least t share one of their first |x| - ceil(t |x|) + 1
tokens under *any* total order of all tokens.  So a pair must share such a prefix token under
every order used here.  All orders put rare tokens first (by a frequency sketch of fixed size)
and break ties by their own hash, so a passage that many documents hold stays out of the
prefixes under all of them.

1. One pass reads the texts and counts tokens into the sketch; a second emits the prefix
   tokens of each order, and one row per document with a signature of its set.
   Documents with equal sets are one node from then on, named by the signature.
2. Tokens in one set only are dropped.
3. Tokens held by few nodes give pairs.  A pair goes if the sizes are too different or if, under one
   of the orders, it shares too few prefix tokens to be similar.  Tokens held by many nodes join groups.
   A node with few of those in its prefix, though, can share enough of them with nodes of a few sizes only.
   It is paired with these, so what many texts hold by chance joins no groups.
4. The pairs that are left, and frequent tokens of the other nodes, join nodes to groups; large groups fall
   into blocks of bounded size and near sizes of sets.  A task compares the texts of a group, or of two blocks,
   by set arithmetic on matrices.  It returns a spanning forest of the links it finds, never all of them.
5. Links join nodes, components are found with distributed rounds.

Rows without an id take no part and get nulls.  Rows that repeat an id are one node; if their texts
differ, the largest text counts.  Null and empty texts have no tokens and link with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.bytestrings import LOWER, U, mix, shingles, utf8, word_hashes, words
from tidegrid.llm.common import by_frequency, components, count_cells, frequency_levels, pieces, recurring, signed
from tidegrid.session import cut_lineage

#: Bytes of text that a comparison turns into sets at a time.
_TEXTS = 1 << 19


@dataclass(frozen=True)
class JaccardParams:
    #: Words in a shingle; similarity in hundredths, inclusive.
    width: int = 5
    hundredths: int = 80
    #: Global token orders.
    orders: int = 2
    #: A token held by more nodes than this is worked on in blocks instead of pairs,
    pair_limit: int = 48
    #: except for nodes in whose prefix such tokens are fewer than one in so many.
    few: int = 5
    #: Nodes in a block.
    block: int = 1024
    #: Up to so many places of texts to verify, in cells, are broadcast (about 60 MB); more are joined.
    broadcast_cells: int = 500_000


def prefix_size(n: np.ndarray | int, hundredths: int):
    return n - (n * hundredths + 99) // 100 + 1


def similar(common, a, b, hundredths: int):
    """Jaccard of at least the threshold, in integers."""
    return 100 * common >= hundredths * (a + b - common)


def _signatures(value: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums per set: the name of the node, and a check that no two sets have one name."""
    one = np.concatenate((np.zeros(1, U), np.cumsum(mix(value), dtype=U)))
    two = np.concatenate((np.zeros(1, U), np.cumsum(mix(value ^ U(0xA0761D6478BD642F)), dtype=U)))
    return one[begin[1:]] - one[begin[:-1]], two[begin[1:]] - two[begin[:-1]]


def _all_shingles(column: str, width: int):
    """Hashes of the shingles of a batch with repeats, for counting."""

    def of(batch: pa.RecordBatch) -> np.ndarray:
        raw, at = utf8(batch.column(column))
        start, end, count = words(raw, at)
        h = np.concatenate((word_hashes(LOWER[raw], start, end), np.zeros(width, U)))
        n = np.diff(count)
        per = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
        row = np.repeat(np.arange(len(n)), per)
        begin = np.cumsum(per) - per
        first = count[:-1][row] + np.arange(len(row)) - begin[row]
        taken = np.minimum(n[row], width)
        value = np.zeros(len(row), U)
        for k in range(width):
            value = mix(value * U(0x2545F4914F6CDD1D) + np.where(k < taken, h[first + k], U(0)) + U(k + 1))
        return value

    return of


_ROW = "key long, node long, n long, ord byte, often boolean, id long, two long"


def _rows(key: np.ndarray, node: np.ndarray, n: np.ndarray, order: int, ids=None, two=None) -> pa.RecordBatch:
    m = len(key)
    nothing = pa.nulls(m, pa.int64())
    columns = [
        pa.array(signed(key)),
        pa.array(signed(node)),
        pa.array(n.astype(np.int64)),
        pa.array(np.full(m, order, np.int8)),
        pa.nulls(m, pa.bool_()),
        nothing if ids is None else pa.array(ids),
        nothing if two is None else pa.array(signed(two)),
    ]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _ROW.split(", ")])


def _emit(levels, p: JaccardParams):
    """One row per document (order -1), and one per order and prefix token of each set new to the task."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in pieces(batches, "text"):
            raw, at = utf8(batch.column("text"))
            value, begin = shingles(raw, at, p.width)
            ids = np.asarray(batch.column("id"), np.int64)
            n = np.diff(begin)
            one, two = _signatures(value, begin)
            yield _rows(mix(one), one, n, -1, ids, two)
            new = []
            for i in np.flatnonzero(n).tolist():
                if (mark := int(one[i])) not in seen:
                    seen.add(mark)
                    new.append(i)
            for order in range(p.orders):
                rank = by_frequency(value, levels.value, order)
                chosen = []
                for i in new:
                    part, k = rank[begin[i] : begin[i + 1]], prefix_size(int(n[i]), p.hundredths)
                    chosen.append(begin[i] + (np.argpartition(part, k - 1)[:k] if k < len(part) else np.arange(len(part))))
                if chosen:
                    row = np.repeat(new, [len(c) for c in chosen])
                    # Under each order a token is a key of its own.
                    yield _rows(mix(value[np.concatenate(chosen)] + U(order)), one[row], n[row], order)

    return of


def _sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    raw, at = utf8(texts)
    value, begin = shingles(raw, at, width)
    return np.split(value, begin[1:-1]) if len(texts) else []


def _forest(sets: list[np.ndarray], split: int, hundredths: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the first ``split`` sets and the rest (all, if 0).

    Counts of common tokens are products of 0/1 matrices over tokens that two sets hold, a slice
    of rows at a time.
    """
    m = len(sets)
    sizes = np.array([len(x) for x in sets], np.int64)
    _, code, times = np.unique(np.concatenate(sets) if m else np.zeros(0, U), return_inverse=True, return_counts=True)
    shared = times > 1
    keep = shared[code]
    row = np.repeat(np.arange(m, dtype=np.int32), sizes)[keep]
    code = (np.cumsum(shared, dtype=np.int32) - 1)[code[keep]]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    del times, shared, keep, order
    ahead, behind = slice(0, split or m), slice(split, m)  # views of the matrices, not copies
    left, right = np.arange(m)[ahead], np.arange(m)[behind]
    common = np.zeros((len(left), len(right)), np.float32)
    width = 512
    for first in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        a, b = np.searchsorted(code, [first, first + width])
        dense = np.zeros((m, width), np.float32)
        dense[row[a:b], code[a:b] - first] = 1
        common += dense[ahead] @ dense[behind].T
    top = np.arange(m)

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return int(i)

    out = []
    for i in left.tolist():
        hits = right[similar(common[i].astype(np.int64), sizes[i], sizes[right], hundredths)]
        for j in hits.tolist():
            x, y = root(i), root(j)
            if x != y:
                top[max(x, y)] = min(x, y)
                out.append((i, j))
    return out


def _blocks(p: JaccardParams):
    def of(table: pa.Table) -> pa.Table:
        side = np.asarray(table.column("side"))
        order = np.argsort(side, kind="stable").tolist()
        sets = []
        # The texts are read where they are, a little at a time: beside them, a task has its sets and matrices.
        for batch in pieces(iter(table.to_batches()), "text", _TEXTS):
            sets += _sets(batch.column("text"), p.width)
        sets = [sets[i] for i in order]
        split = int((side == 0).sum()) if side.any() else 0
        node = table.column("node").to_pylist()
        node = [node[i] for i in order]
        links = _forest(sets, split, p.hundredths)
        return pa.table({"a": pa.array([node[i] for i, _ in links], pa.int64()), "b": pa.array([node[j] for _, j in links], pa.int64())})

    return of


def _may_be_similar(shared: Column, na: Column, nb: Column, p: JaccardParams) -> Column:
    """Can sets of these sizes be similar, given how many prefix tokens they share?

    Beyond the shorter-reaching of the two prefixes, one set has at most its tokens after the prefix.
    """
    h = p.hundredths
    rest = F.greatest(*(F.floor((n * h + 99) / 100) - 1 for n in (na, nb)))
    return (shared + rest) * (100 + h) >= (na + nb) * h


def _frequent(tokens: DataFrame, p: JaccardParams) -> DataFrame:
    """``(key, node, n, m, few)``: the frequent tokens under order 0, with how many their node has, and whether these are few."""
    often = tokens.where("ord = 0 and often").select("key", "node", "n")
    prefix = F.col("n") - F.floor((F.col("n") * p.hundredths + 99) / 100) + 1
    return often.join(often.groupBy("node").agg(F.count("*").alias("m")), "node").select("key", "node", "n", "m", (F.col("m") * p.few < prefix).alias("few"))


def _few_pairs(frequent: DataFrame, p: JaccardParams) -> DataFrame:
    """Pairs with a frequent common token of which one node, or both, has few, and that may be similar by these tokens alone.

    With at most m tokens in common, the smaller set has at most the size h of the larger one
    and (1 + h) / h for each of the m.  So nodes meet by token and class of size, not by token alone.
    """
    h = p.hundredths
    step = np.log(100.0 / h) / 4
    size = lambda n: F.floor(F.log(F.greatest(n.cast("double"), F.lit(1.0))) / step)
    n, reach = F.col("n"), F.col("m") * ((100 + h) / h)
    # A class more on both sides, since these are rounded numbers.
    below = F.sequence(size(n * (h / 100)) - 1, size(F.least(n.cast("double"), n * (h / 100) + reach)) + 1)
    above = F.sequence(size(F.greatest(n.cast("double"), (n - reach) * (100 / h))) - 1, size(n * (100 / h)) + 1)
    x = frequent.where("few").select("key", F.explode(F.array_distinct(F.concat(below, above))).alias("class"), F.col("node").alias("x"), F.col("n").alias("nx"), F.col("m").alias("mx"))
    y = frequent.select("key", size(n).alias("class"), F.col("node").alias("y"), F.col("n").alias("ny"), F.col("m").alias("my"), "few")
    once = (F.col("x") < F.col("y")) | (~F.col("few") & (F.col("x") != F.col("y")))
    fits = F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * h
    both = x.join(y, ["key", "class"]).where(once & fits & _may_be_similar(F.least("mx", "my"), F.col("nx"), F.col("ny"), p))
    turned = F.col("x") > F.col("y")
    both = both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), *(F.when(turned, F.col(u)).otherwise(F.col(v)).alias(c) for c, u, v in (("na", "ny", "nx"), ("nb", "nx", "ny"))))
    both = both.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("s"))
    return both.where(_may_be_similar(F.col("s"), F.col("na"), F.col("nb"), p)).select("a", "b", "na", "nb")


def _small_pairs(tokens: DataFrame, frequent: DataFrame, p: JaccardParams) -> DataFrame:
    """Pairs of nodes that pass the filters of all orders: with a rare common token under order 0, or with few frequent ones."""
    rare, often = tokens.where("ord = 0 and not often"), frequent.select("node", "m").distinct()
    x = rare.select("key", F.col("node").alias("a"), F.col("n").alias("na"))
    y = rare.select("key", F.col("node").alias("b"), F.col("n").alias("nb"))
    fits = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * p.hundredths) & (F.col("a") < F.col("b"))
    pairs = x.join(y, "key").where(fits).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("s"))
    for side in ("a", "b"):
        pairs = pairs.join(often.select(F.col("node").alias(side), F.col("m").alias(f"m{side}")), side, "left")
    common = F.col("s") + F.least(F.coalesce("ma", F.lit(0)), F.coalesce("mb", F.lit(0)))
    pairs = pairs.where(_may_be_similar(common, F.col("na"), F.col("nb"), p)).select("a", "b", "na", "nb")
    pairs = pairs.unionByName(_few_pairs(frequent, p)).distinct()
    for order in range(1, p.orders):
        held = tokens.where(F.col("ord") == order).groupBy("node").agg(F.collect_list("key").alias("t"))
        pairs = pairs.join(held.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a")
        pairs = pairs.join(held.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b")
        common = F.size(F.array_intersect("ta", "tb"))
        pairs = pairs.where(_may_be_similar(common, F.col("na"), F.col("nb"), p)).select("a", "b", "na", "nb")
    return pairs.select("a", "b")


def _cells(frequent: DataFrame, pairs: DataFrame, nodes: DataFrame, p: JaccardParams) -> DataFrame:
    """``(node, grp, lo, hi, side)``: the pairs of blocks that a node with candidates goes to.

    Candidate pairs and common frequent tokens of nodes with many make groups.  A small group is one block.  The nodes of a
    larger one fall into bands of sizes, so that similar ones are in one band or in neighbouring
    ones, and a band with many nodes into blocks.
    """
    often = frequent.where("not few")
    star = often.join(often.groupBy("key").agg(F.min("node").alias("hub")), "key").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    member = cut_lineage(components(pairs.unionByName(star), "a", "b").select(F.col("id").alias("node"), F.col("component").alias("grp")))
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / p.hundredths)))
    member = member.join(nodes.select("node", "n"), "node").join(member.groupBy("grp").agg(F.count("*").alias("all")), "grp")
    member = cut_lineage(member.select("node", "grp", F.when(F.col("all") > p.block, band).otherwise(F.lit(0)).cast("long").alias("band")))
    size = member.groupBy("grp", "band").agg(F.ceil(F.count("*") / p.block).alias("k"))
    placed = member.join(size, ["grp", "band"]).select("node", "grp", F.struct("band", F.pmod(F.xxhash64("node", F.lit(7)), F.col("k")).alias("block")).alias("mine"))
    beside = placed.withColumn("band", F.explode(F.array(*(F.col("mine.band") + d for d in (-1, 0, 1))))).join(size, ["grp", "band"])
    blocks = F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda i: F.struct(F.col("band"), i.alias("block")))
    both = beside.select("node", "grp", "mine", F.explode(blocks).alias("other"))
    return both.select("node", "grp", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), (F.col("mine") > F.col("other")).cast("int").alias("side"))


def _texts(known: DataFrame, nodes: DataFrame, cells: DataFrame, repeated: bool, p: JaccardParams) -> DataFrame:
    """The cells with the texts of their nodes.  Texts are large, so they meet the cells where they are read, by id."""
    wanted = cut_lineage(cells.join(nodes.select("node", "id"), "node"))
    few = wanted.count() <= p.broadcast_cells
    if repeated:
        ids = wanted.select("id").distinct()
        known = known.join(F.broadcast(ids) if few else ids, "id", "left_semi").dropDuplicates(["id"])
    return known.join(F.broadcast(wanted) if few else wanted, "id").drop("id")


def similar_groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text", params: JaccardParams | None = None) -> DataFrame:
    """``(id, n_shingles, component_id)`` for every row, see the module's text."""
    p = params or JaccardParams()
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    known = rows.where("id is not null")
    levels = spark.sparkContext.broadcast(frequency_levels(count_cells(known.select("text"), "text", _all_shingles("text", p.width))))
    ordered = known.mapInArrow(_emit(levels, p), _ROW).repartition("key").sortWithinPartitions("key", "node")
    found = cut_lineage(ordered.mapInArrow(recurring(p.pair_limit, ("node",), passing="ord"), _ROW))
    documents, tokens = found.where("ord < 0"), found.where("ord >= 0")

    per_id = documents.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("m"))
    twice = per_id.where("m > 1").agg(F.count("*").alias("ids"), F.count(F.when(F.col("a") != F.col("b"), 1)).alias("unequal")).first()
    if twice.unequal:
        largest = known.groupBy("id").agg(F.max("text").alias("text"))
        return rows.select("id").join(similar_groups(largest, "id", "text", p), "id", "left")
    sets = documents.where("n > 0").groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.min("two").alias("two"), F.max("two").alias("other"))
    nodes = cut_lineage(sets.select("node", "n", F.when(F.col("two") == F.col("other"), F.col("id")).otherwise(F.raise_error(F.lit("two sets have one signature"))).alias("id")))

    frequent = cut_lineage(_frequent(tokens, p))
    cells = cut_lineage(_cells(frequent, cut_lineage(_small_pairs(tokens, frequent, p)), nodes, p))
    links = _texts(known, nodes, cells, twice.ids > 0, p).groupBy("grp", "lo", "hi").applyInArrow(_blocks(p), "a long, b long")
    for side in ("a", "b"):
        links = links.join(nodes.select(F.col("node").alias(side), F.col("id").alias(f"id_{side}")), side)
    joined = components(links, "id_a", "id_b").withColumnRenamed("id", "first")

    out = documents.select("id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(nodes.select("node", F.col("id").alias("first")), "node", "left").join(joined, "first", "left")
    out = out.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "first", "id").alias("component_id"))
    nameless = rows.where("id is null").select("id", F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(nameless)
