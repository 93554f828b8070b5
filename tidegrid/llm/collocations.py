"""Phrases whose words stand together more often than their parts would, from a weighted de Bruijn graph.

Nodes of the graph are phrases of ``longest - 1`` words, edges phrases of ``longest`` words that lead from
the node of their first words to that of their last; the weight of an edge is how often it occurs.
Only edges are counted in texts.  How often a shorter phrase occurs follows from the flow: it is
the sum over all phrases one word longer that begin with it, and the number of pieces that end with it.
So a phrase at the end of a piece, with no room for an edge, is counted as itself, as a correction.

A node whose whole flow leaves through one edge, or comes through one, adds nothing to that edge:
it is compacted into it, and so are the shorter phrases of which the same holds.  ``paths`` follows edges
through such nodes and gives the unary paths of any length in whole.

Words are counted first, exactly.  A filter of fixed size holds the frequent ones; it errs only towards
keeping.  Pieces are cut where a word is known to be rare: no frequent phrase goes over such a
place, and all that is counted of frequent ones stays.  Single words keep the counts of the first pass.

Edges are added up in batches.  They travel as byte strings in which each word has a number by its frequency, of one to
three bytes; words beyond the first million, a fixed size, stand there with their hash.  No number
begins another, so edges with the same first words are neighbours once they are sorted, and the
flow through each node is the sum of a run of rows.  They are spread by their first two words, those that begin with two
hot words (one of 1000 occurrences each) by the first three, so that no pair meets in one task; the flow of such a pair is summed afterwards.

In the graph a word is a 64-bit hash of group and word.  Two frequent words of one hash fail
the query; a rare word that shares the hash of a frequent one would count as it (for a billion different
words and a million frequent ones, once in 18,000 corpora).

Texts: A-Z are lower-cased, ``[.,;:!?\\x0A-\\x0D]`` cut pieces, space and tab cut words.  Null and empty texts hold no
words; a null group is ``und``.  Repeated rows count as often as they stand there.  Other columns are not
looked at.  An empty table gives no phrases.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.bytestrings import LOWER, U, mix, utf8, word_hashes
from tidegrid.llm.common import pieces
from tidegrid.session import cut_lineage

#: What bytes do: 0 stands in a word, 1 ends a word, 2 ends a piece as well.
_ROLE = np.zeros(256, np.uint8)
_ROLE[[32, 9]] = 1
_ROLE[[*b".,;:!?", 10, 11, 12, 13]] = 2
_BITS = 25
_BATCH = 3 << 20
_SLICE = 1 << 14
_STEP = U(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class CollocationParams:
    #: A phrase must occur so often.
    least: int = 100
    #: Most words of a phrase.
    longest: int = 5
    #: Phrases of a group in the result.
    top: int = 2000

    def __post_init__(self) -> None:
        if self.longest < 3 or self.least < 1 or self.top < 1:
            raise ValueError("phrases need 3 words at least, counts and results 1")


class _Text:
    """The words of a batch: where they are, their keys, and whether each continues the piece of the one before."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        raw, at = utf8(batch.column("text"))
        self.raw = LOWER[raw]
        role = _ROLE[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[at] = True
        inside = np.zeros(len(raw) + 2, bool)
        inside[1:-1] = role == 0
        left, right = inside[:-1], inside[1:]
        self.start = np.flatnonzero(right & (~left | edge))
        self.end = np.flatnonzero(left & (~right | edge))
        self.row = np.searchsorted(at, self.start, "right") - 1
        cuts = np.cumsum(np.concatenate(([0], role == 2)), dtype=np.int32)[self.start] if len(raw) else np.zeros(0, np.int64)
        self.joined = np.zeros(len(self.start), bool)
        self.joined[1:] = (np.diff(cuts) == 0) & (np.diff(self.row) == 0)
        group, where = utf8(batch.column("group"))
        self.group = word_hashes(group, where[:-1], where[1:]) if len(where) > 1 else np.zeros(0, U)
        key = mix(word_hashes(self.raw, self.start, self.end) ^ mix(self.group * _STEP + U(1))[self.row])
        self.key = np.where(key == 0, U(1), key)  # 0 says that there is no word


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return np.unique(keys, return_index=True, return_inverse=True, return_counts=True)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different words of a batch, and per group a row without word that counts all of them."""
    for batch in pieces(batches, "text", _BATCH):
        text = _Text(batch)
        if not len(text.key):
            continue
        _, first, _, n = _counted(text.key)
        groups = batch.column("group").take(pa.array(text.row[first]))
        s, e = text.start[first].tolist(), text.end[first].tolist()
        raw = text.raw.tobytes()
        names = pa.array([raw[a:b] for a, b in zip(s, e, strict=True)], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([groups, names, pa.array(n)], ["group", "word", "n"])
        total = pa.table({"group": batch.column("group").take(pa.array(text.row))}).group_by("group").aggregate([([], "count_all")])
        yield pa.RecordBatch.from_arrays(
            [total.column("group").combine_chunks(), pa.nulls(total.num_rows, pa.string()), total.column("count_all").combine_chunks()], ["group", "word", "n"]
        )


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counted words with their keys; no key where there is no word."""
    for batch in batches:
        rows = batch.filter(batch.column("word").is_valid())
        text = _Text(pa.RecordBatch.from_arrays([rows.column("word"), rows.column("group")], ["text", "group"]))
        key = np.zeros(batch.num_rows, np.int64)
        key[np.asarray(batch.column("word").is_valid())] = text.key.view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key)], [*batch.schema.names, "key"])


def _bits(keys: DataFrame) -> np.ndarray:
    """A bit table of fixed size: a key that is in it is never missed, a few others seem to be."""
    words = keys.selectExpr(f"shiftrightunsigned(key, {64 - _BITS}) as bit").selectExpr("shiftright(bit, 6) as at", "shiftleft(1L, cast(bit % 64 as int)) as mask")
    rows = words.groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()  # 2^19 rows of two numbers at most
    table = np.zeros(1 << (_BITS - 6), U)
    table[np.asarray(rows.column("at"))] = np.asarray(rows.column("mask")).view(U)
    return table


def _held(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = keys >> U(64 - _BITS)
    return (table[(bit >> U(6)).astype(np.int64)] >> (bit & U(63))) & U(1) > 0


#: Numbers of words: so many of one byte, of two and of three; a word without number is the last byte and its key.
_ONE, _TWO, _THREE = 160, 80 << 8, 15 << 16
_NUMBERED = _ONE + _TWO + _THREE
_OTHER = 255


class _Numbers:
    """Word keys to byte strings and back.  Words are ordered by how often they occur."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.order = np.argsort(keys, kind="stable")
        self.sorted = keys[self.order]

    def number(self, keys: np.ndarray) -> np.ndarray:
        """-1 for a word without number."""
        if not len(self.sorted):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.sorted, keys), len(self.sorted) - 1)
        return np.where(self.sorted[at] == keys, self.order[at], -1)

    @staticmethod
    def spell(keys: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of each word, as many columns as the longest needs, and how many of them it has; a key of 0 has none."""
        size = np.where(number < 0, 9, 1 + (number >= _ONE) + (number >= _ONE + _TWO))
        size[keys == 0] = 0
        two, three = number - _ONE, number - _ONE - _TWO
        out = np.zeros((len(keys), 9 if (size == 9).any() else 3), np.uint8)
        out[:, 0] = np.select([size == 1, size == 2, size == 3], [number, _ONE + (two >> 8), 240 + (three >> 16)], _OTHER)
        out[:, 1] = np.where(size == 2, two & 255, (three >> 8) & 255)
        out[:, 2] = three & 255
        other = np.flatnonzero(size == 9)
        if len(other):
            out[other, 1:] = keys[other].astype(">u8").view(np.uint8).reshape(-1, 8)
        return out, size

    def read(self, raw: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Key and number of the word at each place, and the place after it; past the end the key is 0."""
        here = at < end
        padded = np.concatenate((raw, np.zeros(9, np.uint8)))
        first = padded[at].astype(np.int64)
        second, third = padded[at + 1].astype(np.int64), padded[at + 2].astype(np.int64)
        number = np.where(
            first < _ONE,
            first,
            np.where(first < 240, _ONE + ((first - _ONE) << 8) + second, _ONE + _TWO + ((first - 240) << 16) + (second << 8) + third),
        )
        size = 1 + (first >= _ONE).astype(np.int64) + (first >= 240)
        other = first == _OTHER
        number[other | ~here] = -1
        key = np.zeros(len(at), U)
        known = number >= 0
        key[known] = self.keys[number[known]]
        where = np.flatnonzero(other & here)
        if len(where):
            key[where] = padded[at[where][:, None] + 1 + np.arange(8)].copy().view(">u8").reshape(-1)
        size[other] = 9
        return key, number, np.where(here, at + size, at)


def _packed(words: list[np.ndarray], sizes: list[np.ndarray], spread: np.ndarray, n: np.ndarray) -> pa.Array:
    """A byte string per edge: how many bytes of its words say where it goes, the words, and how often it occurs.

    A number of occurrences below 255 is one byte; otherwise four bytes and a last one of 255.
    """
    often = n >= 255
    tail = np.zeros((len(n), 5 if often.any() else 1), np.uint8)
    tail[:, 0] = np.where(often, 0, n)
    if often.any():
        tail[often, :4] = n[often].astype("<u4").view(np.uint8).reshape(-1, 4)
        tail[often, 4] = 255
    parts = [spread.astype(np.uint8)[:, None], *words, tail]
    size = np.stack([np.ones(len(n), np.uint8), *(x.astype(np.uint8) for x in sizes), np.where(often, 5, 1).astype(np.uint8)], axis=1)
    width = max(x.shape[1] for x in parts)
    flat = []
    # Some thousand edges at a time: their parts side by side take many times the bytes they come to.
    for a in range(0, len(n), _SLICE):
        letters = np.zeros((min(_SLICE, len(n) - a), len(parts), width), np.uint8)
        for k, x in enumerate(parts):
            letters[:, k, : x.shape[1]] = x[a : a + _SLICE]
        flat.append(letters[np.arange(width)[None, None, :] < size[a : a + _SLICE, :, None]])
    ends = np.concatenate(([0], np.cumsum(size.sum(axis=1, dtype=np.int64)))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate(flat))])


def _edges(bits: Broadcast, ranked: Broadcast, hot: int, width: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers(ranked.value)
        for batch in pieces(batches, "text", _BATCH):
            text = _Text(batch)
            known = _held(bits.value, text.key)
            # Whether the next word continues the piece, both known.
            chain = np.zeros(len(known), bool)
            chain[:-1] = text.joined[1:] & known[1:] & known[:-1]
            # How many words follow each one without a cut, as far as an edge is long.
            follow = np.zeros(len(chain), np.int64)
            open_ = chain.copy()
            for k in range(1, width):
                follow += open_
                open_[: len(open_) - k] &= chain[k:]
                open_[len(open_) - k :] = False
            at = np.flatnonzero(follow)
            follow = follow[at]
            columns = []
            phrase = np.zeros(len(at), U)
            for k in range(width):
                here = follow >= k
                word = np.zeros(len(at), U)
                word[here] = text.key[at[here] + k]
                phrase = mix(phrase * _STEP + word)
                columns.append(word)
            _, first, same, n = _counted(phrase)
            if not all((c == c[first][same]).all() for c in columns):
                first, n = np.arange(len(at)), np.ones(len(at), np.int64)
            # What is not needed any more goes before the edges are spelt.
            del phrase, same, follow
            if not len(first):
                continue
            number = np.full(len(known), -1, np.int64)
            number[known] = numbers.number(text.key[known])
            words, sizes, marks = [], [], []
            for k in range(width):
                key, columns[k] = columns[k][first], None
                mine = np.full(len(first), -1, np.int64)
                mine[key != 0] = number[at[first][key != 0] + k]
                spelt, size = numbers.spell(key, mine)
                words.append(spelt)
                sizes.append(size)
                marks.append((mine >= 0) & (mine < hot))
            pair = sizes[0] + sizes[1]
            spread = np.where(marks[0] & marks[1], pair + sizes[2], pair)
            yield pa.RecordBatch.from_arrays([_packed(words, sizes, spread, n)], ["g"])

    return of


def _flow(ranked: Broadcast, hot: int, width: int, least: int):
    """From sorted edges to the phrases that begin them: the sum of the rows that begin alike.

    Phrases below ``least`` go, but for pairs that are spread over tasks.
    """

    def closed(k: int, words: np.ndarray, sums: np.ndarray, hot_pair: np.ndarray) -> pa.RecordBatch:
        keep = (words[k - 1] != 0) & ((sums >= least) | (hot_pair if k == 2 else False))
        flat = np.ascontiguousarray(words[:k, keep].T).reshape(-1).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, k, dtype=np.int32)), pa.array(flat))
        return pa.RecordBatch.from_arrays([lists, pa.array(sums[keep])], ["g", "a"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers(ranked.value)
        # Per length the phrase of the last row so far, which may go on: its words, its sum, whether its pair is hot.
        last: dict[int, tuple[np.ndarray, int, bool]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            raw, at = utf8(batch.column("g"))
            place, end = at[:-1] + 1, at[1:] - 1
            n = raw[end].astype(np.int64)
            often = np.flatnonzero(n == 255)
            end[often] -= 4
            n[often] = raw[end[often][:, None] + np.arange(4)].copy().view("<u4").reshape(-1)
            words = np.zeros((width, batch.num_rows), U)
            pair = np.ones(batch.num_rows, bool)
            for k in range(width):
                words[k], number, place = numbers.read(raw, place, end)
                if k < 2:
                    pair &= (number >= 0) & (number < hot)
            fresh = np.ones(batch.num_rows, bool)
            differs = words[:, 1:] != words[:, :-1]
            for k in range(2, width + 1):
                fresh[1:] = differs[:k].any(axis=0)
                first = np.flatnonzero(fresh)
                sums = np.add.reduceat(n, first)
                heads, marks = words[:, first], pair[first]
                if k in last:
                    before, total, mark = last[k]
                    if (before[:k] == heads[:k, 0]).all():
                        sums[0] += total
                    else:
                        yield closed(k, before[:, None], np.array([total]), np.array([mark]))
                last[k] = (heads[:, -1], int(sums[-1]), bool(marks[-1]))
                yield closed(k, heads[:, :-1], sums[:-1], marks[:-1])
        for k, (before, total, mark) in last.items():
            yield closed(k, before[:, None], np.array([total]), np.array([mark]))

    return of


@dataclass(frozen=True)
class Graph:
    """Frequent phrases as arrays of word keys with their counts; the words behind the keys; words per group."""

    phrases: DataFrame  # g array<long>, a long
    words: DataFrame  # key, group, word
    totals: DataFrame  # group, n
    params: CollocationParams


def graph(docs: DataFrame, text: str = "text", group: str = "lang", params: CollocationParams | None = None) -> Graph:
    """All phrases of 1 to ``longest`` words that occur ``least`` times in a group's texts."""
    p = params or CollocationParams()
    rows = docs.select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(f"`{group}`").cast("string"), F.lit("und")).alias("group"))
    share = docs.sparkSession.sparkContext.broadcast
    counted = rows.mapInArrow(_words, "group string, word string, n long").groupBy("group", "word").agg(F.sum("n").alias("n"))
    counted = counted.where(F.col("word").isNull() | (F.col("n") >= p.least))
    counted = cut_lineage(counted.mapInArrow(_named, "group string, word string, n long, key long"))
    words = counted.where("word is not null")
    if words.groupBy("key").count().where("count > 1").limit(1).count():
        raise ValueError("two frequent words have one hash")
    all_words = counted.where("word is null").agg(F.sum("n")).first()[0] or 0
    known = share(_bits(words.select("key")))
    top = words.orderBy(F.desc("n"), "key").limit(_NUMBERED).select("key", "n").toArrow()  # 16 MB at most
    hot = int((np.asarray(top.column("n")) * 1000 >= all_words).sum())
    ranked = share(np.asarray(top.column("key")).astype(np.int64).view(U))
    edges = rows.mapInArrow(_edges(known, ranked, hot, p.longest), "g binary")
    spread = edges.repartition(F.expr("substring(g, 2, ascii(cast(substring(g, 1, 1) as string)))")).sortWithinPartitions("g")
    longer = spread.mapInArrow(_flow(ranked, hot, p.longest, p.least), "g array<long>, a long")
    # A pair of hot words has a part of its flow in each of the tasks it was spread over.
    longer = longer.groupBy("g").agg(F.sum("a").alias("a")).where(F.col("a") >= p.least)
    phrases = words.select(F.array("key").alias("g"), F.col("n").alias("a")).unionByName(longer)
    return Graph(cut_lineage(phrases), words.select("key", "group", "word"), counted.where("word is null").select("group", "n"), p)


def _shorter(g: Column) -> Column:
    """A phrase without its last word, and without its first."""
    n = F.size(g) - 1
    return F.array(F.slice(g, F.lit(1), n), F.slice(g, F.lit(2), n))


def compacted(found: Graph) -> DataFrame:
    """Phrases of 2 words and more whose flow does not pass whole into a phrase one word longer.

    If it passes whole into one that is two words longer, it does so into the one between.
    """
    longer = found.phrases.where("size(g) > 2").select(F.explode(_shorter(F.col("g"))).alias("g"), "a").distinct()
    return found.phrases.where("size(g) > 1").join(longer, ["g", "a"], "left_anti")


def spelt(found: Graph, phrases: DataFrame) -> DataFrame:
    """``phrases`` (with a column ``g``) and their ``group`` and ``phrase``."""
    each = phrases.select("g", F.posexplode("g").alias("pos", "key")).join(found.words, "key")
    text = each.groupBy("g").agg(F.first("group").alias("group"), F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("w"))
    return phrases.join(text.select("g", "group", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("phrase")), "g")


def paths(found: Graph) -> DataFrame:
    """``(group, phrase, words, n)`` of the unary paths: edges joined through nodes that pass their whole flow on.

    An edge of which nothing can be joined is a path of its own.  Each round doubles the reach of
    every edge, so the rounds grow with the logarithm of the longest path.  A path has an end: the pieces
    that make its flow have one, where a node does not pass on all that came.
    """
    width = found.params.longest
    edge = cut_lineage(found.phrases.where(F.size("g") == width))
    node = found.phrases.where(F.size("g") == width - 1).select(F.col("g").alias("node"), "a")
    ends = edge.select("g", "a", _shorter(F.col("g")).alias("s"))
    out = ends.select(F.col("g").alias("before"), F.col("s")[1].alias("node"), "a").join(node, ["node", "a"])
    into = ends.select(F.col("g").alias("after"), F.col("s")[0].alias("node"), "a").join(node, ["node", "a"])
    step = out.join(into, ["node", "a"]).select("before", "after")
    # Per edge: the first edge of its path as far as it is known, and how many steps back it is.
    back = edge.join(step.withColumnRenamed("after", "g"), "g", "left")
    back = back.select("g", "a", F.coalesce("before", "g").alias("top"), F.col("before").isNotNull().cast("long").alias("far"))
    back = cut_lineage(back)
    moved = back.where("far > 0").limit(1).count()
    while moved:
        above = back.select(F.col("g").alias("top"), F.col("top").alias("next"), F.col("far").alias("more"))
        joined = back.join(above, "top").select("g", "a", F.col("next").alias("top"), (F.col("far") + F.col("more")).alias("far"), "more")
        joined = cut_lineage(joined)
        moved = joined.where("more > 0").limit(1).count()
        back = joined.drop("more")
    tails = back.where("far > 0").select("top", "a", "far", F.element_at("g", -1).alias("key"))
    heads = back.where("far = 0").select("top", "a", F.posexplode("g").alias("far", "key")).withColumn("far", F.col("far").cast("long") - width)
    each = tails.unionByName(heads.select("top", "a", "far", "key")).join(found.words, "key")
    text = each.groupBy("top").agg(F.first("group").alias("group"), F.sort_array(F.collect_list(F.struct("far", "word"))).alias("w"), F.first("a").alias("n"))
    return text.select("group", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("phrase"), F.size("w").cast("long").alias("words"), "n")


def collocations(found: Graph) -> DataFrame:
    """``(group, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of each group.

    A cut after the first k words gives ``floor(1000 * a * n / (l * r))`` with the counts of both parts; a
    phrase has the score of its lowest cut, of equal ones that with the smallest k.  Order: score, then ``a``, largest first,
    then the phrase by its bytes.
    """
    p = found.params
    kept = spelt(found, compacted(found)).join(found.totals, "group")
    cut = F.explode(F.sequence(F.lit(1), F.size("g") - 1))
    cuts = kept.select("g", "a", "n", cut.alias("k")).withColumns(
        {"left": F.slice("g", F.lit(1), F.col("k")), "right": F.slice("g", F.col("k") + 1, F.size("g") - F.col("k"))}
    )
    cuts = cuts.join(found.phrases.select(F.col("g").alias("left"), F.col("a").alias("l")), "left")
    cuts = cuts.join(found.phrases.select(F.col("g").alias("right"), F.col("a").alias("r")), "right")
    exact = "(cast(1000 * a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"
    lowest = cuts.withColumn("score", F.expr(exact)).groupBy("g").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    scored = kept.join(lowest, "g").select("group", "phrase", "a", "best.l", "best.r", "n", "best.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The first of each share of a group, then the first of those: no task sorts a whole group.
    part = Window.partitionBy("group", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    whole = Window.partitionBy("group").orderBy(*order)
    first = scored.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= p.top)
    ranked = first.withColumn("rank", F.row_number().over(whole).cast("long")).where(F.col("rank") <= p.top)
    return ranked.select("group", "rank", "phrase", "a", "l", "r", "n", "score")
