"""Byte-level BPE encoding and decoding from a rank file.

Spark cuts the texts into words; tasks get them as Arrow arrays of about ``PIECE`` bytes of text.  A
task encodes each different word once: it starts as its bytes, and the neighbours of lowest rank
(the first of equal ones) are joined until no two neighbours have a rank.  A heap of the neighbours
that have one makes a word of n bytes n log n steps.  A word that has a rank itself is one id,
as in the usual libraries.  A task remembers words up to a fixed number, which changes no result.

Words that are frequent in a sample of bounded size are encoded beforehand; that dictionary, of at
most ``dictionary_words``, is what each task starts from and only saves work.  Ranks and dictionary are broadcast, so no
plan holds them.  A document's words take their ids from the different words of its
piece, and decoding takes the bytes of each id and joins them.

Null texts are empty; they have no ids and decode to nothing.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A task gives words their ids in so many bytes of text at a time, and remembers no word that is longer than so many.
PIECE = 1 << 20
_REMEMBERED_BYTES = 256
#: White space of Unicode, which \s means in the patterns of tokenizers but not in Java's.
SPACE = r"\t-\r \x85\xA0  -     　"


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and their ranks, which are also their ids, from lines of base64 and number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def java_pattern(pattern: str) -> str:
    """The pattern with its white space spelt out."""
    out = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]")
    return out.replace(r"\s", f"[{SPACE}]")


def _merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    # Per place the piece that starts there, the start of the next one and of the one before.
    piece = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(word[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        j = after[i]
        # Pieces only grow, so a pair is still there if it starts and ends where it did.
        if not piece[i] or j >= n or after[j] != stop:
            continue
        piece[i], piece[j] = piece[i] + piece[j], b""
        after[i] = stop
        if stop < n:
            before[stop] = i
            if (rank := ranks.get(piece[i] + piece[stop])) is not None:
                heappush(heap, (rank, i, after[stop]))
        if i:
            h = before[i]
            if (rank := ranks.get(piece[h] + piece[i])) is not None:
                heappush(heap, (rank, h, stop))
    return [ranks[x] for x in piece if x]


class _Words:
    """Words to ids in one task: look up, merge what is new.  Known words are Arrow arrays, which take far less memory than a dict."""

    def __init__(self, ranks: dict[bytes, int], dictionary: dict[str, bytes], remembered: int) -> None:
        self.ranks, self.remembered = ranks, remembered
        self.dictionary = self.known = pa.array(list(dictionary), pa.string()), pa.array(list(dictionary.values()), pa.large_binary())

    def encode(self, words: pa.Array) -> pa.Array:
        words = words.cast(pa.string())
        names, ids = self.known
        place = pa.compute.index_in(words, value_set=names)
        new = np.asarray(place.is_null())
        at = np.asarray(place.fill_null(0), np.int64)
        at[new] = len(names) + np.arange(int(new.sum()))
        fresh = words.filter(pa.array(new))
        found = pa.array([np.array(_merged(word.encode(), self.ranks), "<u4").tobytes() for word in fresh.to_pylist()], pa.large_binary())
        out = pa.concat_arrays([ids, found]).take(pa.array(at))
        short = pa.compute.less_equal(pa.compute.binary_length(fresh), _REMEMBERED_BYTES)
        fresh, found = fresh.filter(short), found.filter(short)
        if len(names) + len(fresh) > self.remembered + len(self.dictionary[0]):
            names, ids = self.dictionary
        self.known = pa.concat_arrays([names, fresh]), pa.concat_arrays([ids, found])
        return out


class Encoder:
    """Ranks, the pattern that cuts words, and a dictionary of frequent words."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, dictionary_words: int = 1 << 15, sample_rows: int = 4096, remembered: int = 1 << 18) -> None:
        if set(range(256)) - {k[0] for k in ranks if len(k) == 1}:
            raise ValueError("not byte-level: a byte has no rank")
        self.pattern = java_pattern(pattern)
        self.ranks = ranks
        vocabulary = [b""] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            vocabulary[v] = k
        self.vocabulary = vocabulary
        self.dictionary_words, self.sample_rows, self.remembered = dictionary_words, sample_rows, remembered
        self.dictionary: dict[str, bytes] = {}

    def words(self, text: str | Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), F.lit(0))

    def learn_dictionary(self, docs: DataFrame, text: str = "text") -> Encoder:
        """Encodes the words most frequent in about ``sample_rows`` rows, at most ``dictionary_words`` of them."""
        rows = max(1, docs.count())
        share = F.pmod(F.xxhash64(text), F.lit(1 << 30)) / float(1 << 30)
        sample = docs.where(share * rows < self.sample_rows).select(F.explode(self.words(text)).alias("word"))
        top = sample.groupBy("word").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "word").limit(self.dictionary_words)
        shared = docs.sparkSession.sparkContext.broadcast((self.ranks, {}))
        found = top.select("word").mapInArrow(_each(shared, self.remembered), "word string, ids binary").collect()
        self.dictionary = {r.word: bytes(r.ids) for r in found}
        return self

    def encode(self, docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """Columns ``keep``, ``ids`` (32-bit, little-endian) and ``decoded``, the bytes of the ids joined."""
        words = docs.select(*(F.col(f"`{c}`") for c in keep), self.words(F.col(f"`{text}`")).alias("_words"))
        schema = T.StructType([words.schema[c] for c in keep] + [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])
        context = docs.sparkSession.sparkContext
        shared, vocabulary = context.broadcast((self.ranks, self.dictionary)), context.broadcast(self.vocabulary)
        return words.mapInArrow(_join(shared, vocabulary, self.remembered, keep), schema)


def _each(shared, remembered: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(*shared.value, remembered)
        for batch in batches:
            ids = words.encode(batch.column("word"))
            yield pa.RecordBatch.from_arrays([batch.column("word"), ids.cast(pa.binary())], ["word", "ids"])

    return of


def _pieces(batch: pa.RecordBatch, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The rows in runs whose words hold about ``limit`` bytes."""
    column = batch.column("_words")
    length = np.concatenate(([0], np.cumsum(np.asarray(pa.compute.binary_length(column.flatten()), np.int64))))
    ends = length[np.cumsum(np.asarray(pa.compute.list_value_length(column), np.int64))]
    cuts = [0, *(np.flatnonzero(np.diff(ends // limit)) + 1).tolist(), len(column)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def _join(shared, vocabulary, remembered: int, keep: tuple[str, ...]):
    """From a document's words to its ids, by the different words of a piece, and back to its bytes."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(vocabulary.value, pa.large_binary())
        known = _Words(*shared.value, remembered)
        for whole in batches:
            for batch in _pieces(whole):
                words = batch.column("_words")
                coded = words.flatten().dictionary_encode()
                _, offsets, data = known.encode(coded.dictionary).take(coded.indices).buffers()
                ends = np.frombuffer(offsets, np.int64, len(coded) + 1) if len(coded) else np.zeros(1, np.int64)
                raw = data.to_pybytes() if data is not None else b""
                stop = ends[np.cumsum(np.asarray(pa.compute.list_value_length(words), np.int64))].tolist()
                out = [raw[a:b] for a, b in zip([0, *stop], stop, strict=False)]
                del coded, raw
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.binary()), decode(out, table)], [*keep, "ids", "decoded"])

    return of


def decode(ids: list[bytes], vocabulary: pa.Array) -> pa.Array:
    """The bytes of each list of ids: their pieces, taken from the vocabulary and joined."""
    pieces = vocabulary.take(pa.array(np.frombuffer(b"".join(ids), "<u4")))
    _, offsets, data = pieces.buffers()
    at = np.frombuffer(offsets, np.int64, len(pieces) + 1)
    raw = data.to_pybytes() if data is not None else b""
    ends = np.cumsum([0] + [len(x) // 4 for x in ids])
    return pa.array([raw[at[a] : at[b]] for a, b in zip(ends, ends[1:], strict=False)], pa.binary())
