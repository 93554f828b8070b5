"""Mixing sources to target weights: exact quotas, split over output shards by a random tree.

1. Each source gets a target: its weight's share of the words wanted, but at most ``most`` times
   its own words; what is above is shared again by weight until no source is above.
2. A source's documents fall by hash into blocks of about ``block_words`` words.  Its sequence is
   all blocks in random order, then (if its target needs repeats) all blocks in another random order.
   The mix takes the first target words of the sequence, so quotas are exact; the last block
   ends within a document, which is then taken in part, from its first word on.
3. The shards' shares of the quotas come from a binary tree: a node holds the number of blocks left
   of each source and a range of shards, and gives its left half a multivariate hypergeometric
   draw.  The leaves add up to the quotas exactly.
4. Each shard takes the next blocks of each source's sequence: disjoint, and already in random order.
5. Within a shard, documents are in the order of a hash: ``shuffled`` numbers them.

Draws depend on the seed and on content only, so reruns agree.  Windows run over the blocks of a
source or the documents of a block or shard, never over the documents of a source.

A null source is a source; it comes last.  Null texts have no words and are never taken.
Rows without an id or with repeated ids are documents like others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixParams:
    #: Weights of the sources in the order of their names, repeating.
    weights: tuple[int, ...] = (5, 2, 1)
    #: Words of the mix, as a multiple of all words; and of a source, of its own words.
    total: float = 1.5
    most: int = 2
    block_words: int = 1 << 16
    blocks_per_shard: int = 64
    seed: int = 17


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def first_words(text: str | Column, n: str | Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), n), "")


def targets(sizes: DataFrame, p: MixParams) -> DataFrame:
    """One row per source: ``number, source, source_size, weight, target, quota``; one row of input per source."""
    everything = Window.orderBy(F.lit(0))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("number", F.row_number().over(named) - 1)
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, p.weights)), (F.col("number") % len(p.weights) + 1).cast("int")).cast("double"))
    rows = rows.withColumn("cap", (F.col("source_size") * p.most).cast("double"))
    # Filled from the source that is full first: the level is the largest that any start of the list gives.
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "number").rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.sum("source_size").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * p.total
    weight = F.sum("weight").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("level", (wanted - F.coalesce(F.sum("cap").over(filling), F.lit(0.0))) / (weight - F.coalesce(F.sum("weight").over(filling), F.lit(0.0))))
    level = F.max("level").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("target", F.least("cap", level * F.col("weight")))
    return rows.select("number", "source", "source_size", "weight", "target", F.round("target").cast("long").alias("quota"))


def _split(until: int, p: MixParams):
    """Splits nodes, that is ranges of shards and what they take of each source, down to ``until`` shards."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for node in frame.itertuples(index=False):
                done, todo = [], [(node.lo, node.hi, np.asarray(node.quota, np.int64))]
                while todo:
                    lo, hi, quota = todo.pop()
                    if hi - lo <= until:
                        done.append(node._replace(lo=lo, hi=hi, quota=quota))
                        continue
                    mid = (lo + hi) // 2
                    here = node.blocks * mid // node.shards - node.blocks * lo // node.shards
                    draw = np.random.default_rng([p.seed, lo, hi]).multivariate_hypergeometric(quota, here, method="marginals")
                    todo += [(lo, mid, draw), (mid, hi, quota - draw)]
                yield pd.DataFrame(done, columns=frame.columns)

    return of


def shard_quotas(quotas: DataFrame, p: MixParams) -> DataFrame:
    """``(shard, number, n)``: how many blocks of each source a shard takes; ``quotas``: ``(number, quota)`` in blocks."""
    root = quotas.agg(F.sort_array(F.collect_list(F.struct("number", "quota"))).alias("q"), F.sum("quota").alias("blocks")).where("blocks > 0")
    shards = F.ceil(F.col("blocks") / p.blocks_per_shard).cast("long")
    root = root.select(F.lit(0).cast("long").alias("lo"), shards.alias("hi"), shards.alias("shards"), "blocks", "q.number", "q.quota")
    schema = "lo long, hi long, shards long, blocks long, number array<long>, quota array<long>"
    leaves = root.mapInPandas(_split(256, p), schema).repartition("lo").mapInPandas(_split(1, p), schema)
    each = leaves.select(F.col("lo").alias("shard"), F.explode(F.arrays_zip("number", "quota")).alias("x"))
    return each.select("shard", "x.number", F.col("x.quota").alias("n")).where("n > 0")


def plan_mix(docs: DataFrame, params: MixParams | None = None) -> DataFrame:
    """The rows of ``docs`` with ``source_size``, ``target`` and ``placements``.

    ``docs`` holds ``doc_id``, ``source`` and ``size``.  ``placements`` has one
    ``(copy, shard, words)`` for each time that the mix takes the document.  Other columns stay;
    those named like a result are replaced.
    """
    p = params or MixParams()
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("source_size", "target", "placements")]
    docs = docs.select("doc_id", "source", "size", F.struct(*others).alias("_row"))
    perm = lambda *cols: F.xxhash64(*cols, F.lit(p.seed))
    sized = docs.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    sources = cut_lineage(targets(sized, p).withColumn("blocks", F.greatest(F.ceil(F.col("source_size") / p.block_words), F.lit(1)).cast("long")))
    per_source = sources.select(F.col("source").alias("name"), "number", "source_size", "target", "blocks")
    rows = docs.join(per_source, docs["source"].eqNullSafe(per_source["name"])).drop("name")
    rows = rows.withColumn("block", F.pmod(perm("doc_id", F.lit(1)), F.col("blocks")))

    block_size = rows.groupBy("number", "block").agg(F.sum("size").alias("words")).where("words > 0")
    copies = block_size.select("*", F.explode(F.sequence(F.lit(0), F.lit(p.most - 1))).alias("copy"))
    before = Window.partitionBy("number").orderBy("copy", perm("number", "copy", "block", F.lit(2)), "block").rowsBetween(Window.unboundedPreceding, -1)
    copies = copies.join(sources.select("number", "quota"), "number")
    copies = copies.withColumn("drawn", F.least("words", F.col("quota") - F.coalesce(F.sum("words").over(before), F.lit(0)))).where("drawn > 0")
    ranked = Window.partitionBy("number").orderBy("copy", perm("number", "copy", "block", F.lit(2)), "block")
    drawn = cut_lineage(copies.select("number", "block", "copy", "drawn", (F.row_number().over(ranked) - 1).cast("long").alias("rank")))

    shares = shard_quotas(drawn.groupBy("number").agg(F.count("*").alias("quota")), p)
    until = F.sum("n").over(Window.partitionBy("number").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    ranges = shares.withColumn("until", until).select("shard", "number", F.explode(F.sequence(F.col("until") - F.col("n"), F.col("until") - 1)).alias("rank"))
    placed = drawn.join(ranges, ["number", "rank"]).groupBy("number", "block").agg(F.sort_array(F.collect_list(F.struct("copy", "shard", "drawn"))).alias("draws"))

    inside = Window.partitionBy("number", "block").orderBy(perm("doc_id", "size", F.lit(3)), "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("earlier", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(placed, ["number", "block"], "left")
    taken = F.transform(
        F.coalesce("draws", F.array().cast("array<struct<copy:int,shard:bigint,drawn:bigint>>")),
        lambda d: F.struct(d["copy"].alias("copy"), d["shard"].alias("shard"), F.greatest(F.least(d["drawn"] - F.col("earlier"), F.col("size")), F.lit(0)).alias("words")),
    )
    rows = rows.withColumn("placements", F.filter(taken, lambda d: d["words"] > 0))
    return rows.select("_row.*", "source_size", "target", "placements")


def taken_words() -> Column:
    return F.aggregate("placements", F.lit(0).cast("long"), lambda total, d: total + d["words"])


def shuffled(mix: DataFrame, params: MixParams | None = None) -> DataFrame:
    """One row per placement, with ``shard``, ``words`` and its ``position`` in the shard's random order; columns of these names are replaced."""
    p = params or MixParams()
    others = [F.col(f"`{c}`") for c in mix.columns if c not in ("placements", "shard", "words", "position")]
    each = mix.select(F.struct(*others).alias("_row"), F.explode("placements").alias("_d"))
    order = Window.partitionBy("_d.shard").orderBy(F.xxhash64("_row.doc_id", "_d.copy", "_row.size", F.lit(p.seed + 1)), "_row.doc_id", "_d.copy")
    return each.withColumn("_position", F.row_number().over(order)).select("_row.*", "_d.shard", "_d.words", F.col("_position").alias("position"))
