"""Token ids in grammar-compressed files with random access.

Texts are sorted by id into shards.  A shard's ids are compressed by pairing: the most frequent
pairs of neighbours within a document become nonterminals, round after round; where chosen pairs
overlap the more frequent one wins, then the one further left.  A file holds the rules, the length
of each rule's expansion, the symbols that are left, and per document its id, its first symbol and its
number of ids, so a document, or the n-th id of it, is decoded without what comes before it.

File format, little-endian: 8 bytes of magic; then as unsigned 64-bit integers the number of
terminals, rules, symbols and documents; then arrays: left and right of each rule and its expansion
length (32 bits), the symbols (32 bits), per document its id (64 bits, signed), whether it has one
(8 bits), its first symbol (64 bits) and its number of ids (64 bits).  Rule r is symbol terminals + r and refers to
smaller symbols only.  Files are values of a binary column, so they are written and read by Spark
wherever its tables are.

Null texts are empty; each document ends with the end id.  Null ids come first.  Rows with equal ids
are in the order of their texts.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.llm.bytestrings import utf8
from tidegrid.llm.common import pieces

MAGIC = b"PAIRIDS1"
#: A task reads so many bytes of text at a time, and remembers no part of a text that is longer than so many.
_BATCH = 2 << 20
_REMEMBERED_BYTES = 256
#: Parts that are encoded as one text, and bytes of texts that the library gets at once.
_RUN = 256
_AT_ONCE = 1 << 16
#: Ids that are spelt out at a time, and a document more at most.
_STRETCH = 1 << 18
#: Cells in which a shard's pairs are counted.
_CELL_BITS = 20
_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: Letters and digits, and marks that are neither and begin no word of letters.
_PLAIN = np.zeros(256, bool)
_PLAIN[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True
#: White space beyond ASCII, by its bytes.
_WIDE_SPACES = [chr(c).encode() for c in range(128, 0x3001) if chr(c).isspace()]
_WIDE_LEAD = np.zeros(256, bool)
_WIDE_LEAD[[c[0] for c in _WIDE_SPACES]] = True


def _spaces(raw: np.ndarray) -> np.ndarray:
    """Which bytes are part of white space."""
    out = _ASCII_SPACE[raw]
    lead = np.flatnonzero(_WIDE_LEAD[raw])
    if len(lead):
        padded = np.concatenate((raw, np.zeros(3, np.uint8)))
        for wide in _WIDE_SPACES:
            here = lead[np.all([padded[lead + k] == byte for k, byte in enumerate(wide)], axis=0)]
            for k in range(len(wide)):
                out[here + k] = True
    return out


@dataclass(frozen=True)
class FileParams:
    #: Bytes of ids in a shard, of text in a partition of shards; a task holds a shard, and the files of a partition as they are read back.
    shard_bytes: int = 8 << 20
    partition_bytes: int = 16 << 20
    #: Rounds of pairing; pairs replaced in one round at most; occurrences that make a pair worth a rule.
    rounds: int = 3
    pairs: int = 1 << 13
    least: int = 16
    #: Words whose ids a task remembers.
    remembered: int = 1 << 19
    #: Whether added tokens of the tokenizer that stand in a text are one id, as the library has it, or spelt out.
    added_tokens: bool = False
    end: int = 0


def _parts(n: int, step: int = 1 << 20) -> Iterator[slice]:
    return (slice(i, min(i + step, n)) for i in range(0, n, step))


def _pairs(symbols: np.ndarray, part: slice) -> np.ndarray:
    """The symbols of a part, each with its right neighbour."""
    out = symbols[:-1][part].astype(np.int64)
    out <<= 32
    out |= symbols[1:][part]
    return out


def _cells(pairs: np.ndarray) -> np.ndarray:
    return (pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _CELL_BITS)


def pair_up(symbols: np.ndarray, ends: np.ndarray, terminals: int, p: FileParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after pairing, which of them end a document, and the rules as rows (left, right)."""
    rules = np.zeros((0, 2), np.int64)
    # A task holds a shard's arrays beside its words, so they are narrow, or made a part at a time.
    symbols = symbols.astype(np.uint32)
    for _ in range(p.rounds):
        if len(symbols) < 2:
            break
        n = len(symbols) - 1
        # Counts of hashed pairs first: only pairs in full cells can be frequent.
        cell = np.empty(n, np.int32)
        full = np.zeros(1 << _CELL_BITS, np.int32)
        for part in _parts(n):
            cell[part] = _cells(_pairs(symbols, part))
            cell[part][ends[:-1][part]] = 0
            full += np.bincount(cell[part], minlength=1 << _CELL_BITS)
        # The count that as many cells reach as pairs are replaced.
        reached = np.cumsum(np.bincount(full)[::-1])
        least = max(p.least, len(reached) - 1 - int(np.searchsorted(reached, p.pairs)))
        some = (full >= least)[cell]
        some &= ~ends[:-1]
        del full, reached
        pair = np.empty(int(some.sum()), np.int64)
        done = 0
        for part in _parts(n):
            found = _pairs(symbols, part)[some[part]]
            pair[done : done + len(found)] = found
            done += len(found)
        pair.sort()
        first = np.flatnonzero(np.concatenate((np.full(min(len(pair), 1), True), pair[1:] != pair[:-1])))
        count = np.diff(first, append=len(pair))
        pair = pair[first]
        good = np.flatnonzero(count >= p.least)
        good = pair[good[np.lexsort((pair[good], -count[good]))][: p.pairs]]
        del pair, count, first
        if not len(good):
            break
        here = np.full(len(symbols) + 1, len(good), np.int32)  # rank of the pair that starts at each place, moved by one
        home = _cells(good)
        left = np.arange(len(good))
        while len(left):  # one pair a cell at a time
            slot = np.full(1 << _CELL_BITS, -1, np.int32)
            slot[home[left]] = left
            for part in _parts(n):
                at = np.flatnonzero(some[part])
                rank = slot[cell[part][at]]
                held = rank >= 0
                at, rank = at[held], rank[held]
                same = good[rank] == _pairs(symbols, part)[at]
                here[1 + part.start + at[same]] = rank[same]
            left = left[slot[home[left]] != left]
        del some, cell
        chosen = here[1:] <= len(good) - 1
        chosen &= (here[1:] < here[:-1]) | (here[:-1] > len(good) - 1)
        chosen[:-1] &= here[1:-1] <= here[2:]
        taken = np.flatnonzero(chosen)
        clash = np.flatnonzero(np.diff(taken) == 1)
        if len(clash):  # runs of one symbol: every second place
            run_start = np.concatenate(([0], np.flatnonzero(np.diff(taken) != 1) + 1))
            offset = np.arange(len(taken)) - np.repeat(run_start, np.diff(np.concatenate((run_start, [len(taken)]))))
            taken = taken[offset % 2 == 0]
        fresh = terminals + len(rules)
        rules = np.concatenate((rules, np.stack((good >> 32, good & 0xFFFFFFFF), axis=1)))
        symbols[taken] = fresh + here[1:][taken]
        keep = np.ones(len(symbols), bool)
        keep[taken + 1] = False
        ends = ends.copy()
        ends[taken] |= ends[taken + 1]
        symbols, ends = symbols[keep], ends[keep]
    return symbols, ends, rules


def expansion_lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    """Ids under each symbol, terminals first."""
    length = np.ones(terminals + len(rules), np.int64)
    for r, (a, b) in enumerate(rules.tolist()):
        length[terminals + r] = length[a] + length[b]
    return length


def file_of(ids: np.ndarray, sizes: np.ndarray, documents: np.ndarray, named: np.ndarray, terminals: int, p: FileParams) -> bytes:
    """A shard as a file; ``sizes``: ids of each document."""
    ends = np.zeros(len(ids), bool)
    ends[np.cumsum(sizes) - 1] = True
    symbols, last, rules = pair_up(ids, ends, terminals, p)
    first = np.concatenate(([0], np.flatnonzero(last)[:-1] + 1)) if len(sizes) else np.zeros(0, np.int64)
    lengths = expansion_lengths(rules, terminals)[terminals:]
    head = np.array([terminals, len(rules), len(symbols), len(sizes)], "<u8")
    arrays = [rules[:, 0].astype("<u4"), rules[:, 1].astype("<u4"), lengths.astype("<u4"), symbols.astype("<u4"), documents.astype("<i8"), named.astype("u1"), first.astype("<u8"), sizes.astype("<u8")]
    return MAGIC + head.tobytes() + b"".join(a.tobytes() for a in arrays)


class TokenFile:
    """Reads a file; documents are decoded one by one or all at once."""

    def __init__(self, raw: bytes) -> None:
        if raw[:8] != MAGIC:
            raise ValueError("not a file of token ids")
        self.terminals, rules, symbols, documents = np.frombuffer(raw, "<u8", 4, 8).astype(np.int64).tolist()
        at = 40

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        self.left, self.right, self.lengths = take("<u4", rules), take("<u4", rules), take("<u4", rules)
        self.symbols = take("<u4", symbols)
        self.documents, self.named = take("<i8", documents), take("u1", documents).astype(bool)
        self.first, self.sizes = take("<u8", documents).astype(np.int64), take("<u8", documents).astype(np.int64)

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        symbols = symbols.astype(np.int64)
        while True:
            pairs = symbols >= self.terminals
            if not pairs.any():
                return symbols.astype("<u4")
            place = np.cumsum(1 + pairs) - 1 - pairs
            out = np.empty(len(symbols) + int(pairs.sum()), np.int64)
            out[place[~pairs]] = symbols[~pairs]
            rule = symbols[pairs] - self.terminals
            out[place[pairs]], out[place[pairs] + 1] = self.left[rule], self.right[rule]
            symbols = out

    def ids_between(self, a: int, b: int) -> np.ndarray:
        """The ids of documents a to b - 1."""
        stop = self.first[b] if b < len(self.first) else len(self.symbols)
        return self._expand(self.symbols[self.first[a] : stop])

    def document(self, k: int) -> np.ndarray:
        return self.ids_between(k, k + 1)

    def token(self, k: int, n: int) -> int:
        """The n-th id of a document: expansion lengths lead to it."""
        stop = self.first[k + 1] if k + 1 < len(self.first) else len(self.symbols)
        symbols = self.symbols[self.first[k] : stop].astype(np.int64)
        size = np.ones(len(symbols), np.int64)
        some = symbols >= self.terminals
        size[some] = self.lengths[symbols[some] - self.terminals]
        ends = np.cumsum(size)
        j = int(np.searchsorted(ends, n, "right"))
        symbol, n = int(symbols[j]), n - int(ends[j] - size[j])
        while symbol >= self.terminals:
            a = int(self.left[symbol - self.terminals])
            under = int(self.lengths[a - self.terminals]) if a >= self.terminals else 1
            symbol, n = (a, n) if n < under else (int(self.right[symbol - self.terminals]), n - under)
        return symbol

    def all_ids(self) -> np.ndarray:
        return self._expand(self.symbols)


@lru_cache(maxsize=1)
def _tokenizer(definition: str, added_tokens: bool) -> tuple:
    """The tokenizer, its added tokens, whether it has the library's own byte-level cutter, and how many bytes each id spells; a worker reads a definition once."""
    import json
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    tokens = tokenizer.get_added_tokens_decoder().values()
    # Special ones are spelt out by this switch; others never are.
    tokenizer.encode_special_tokens = not added_tokens
    found = [re.escape(t.content.encode()) for t in tokens if added_tokens or not t.special]
    added = re.compile(b"|".join(found)) if found else None
    described = json.loads(definition)
    cutter = described.get("pre_tokenizer") or {}
    fine = cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space", True) and not described.get("normalizer")
    vocabulary = tokenizer.get_vocab()
    spelt = np.zeros(max(vocabulary.values()) + 1, np.int64)
    spelt[list(vocabulary.values())] = [len(piece) for piece in vocabulary]  # a character of a byte-level vocabulary stands for a byte
    return tokenizer, added, fine, spelt


class _Words:
    """Ids of texts from a tokenizer of the tokenizers library that cuts texts into words first.

    No word of its pattern goes over a space between two other characters, and what stands before
    and after such a space is cut alike with and without the other.  So texts are cut
    there, and each different part is encoded once.  The pattern of the library's byte-level
    cutter also ends a word between a letter or digit and a mark, and makes a lone line end
    a word; with it texts are cut there too.  A text that holds an added token is encoded as it is.
    """

    def __init__(self, definition: str, remembered: int, added_tokens: bool) -> None:
        self.tokenizer, self.added, self.fine, self.spelt = _tokenizer(definition, added_tokens)
        self.remembered = remembered
        self.known = self.coded = pa.array([], pa.large_binary())

    def _with_added(self, letters: bytes, at: np.ndarray) -> list[int]:
        """Which texts hold an added token."""
        if not self.added or not self.added.search(letters):
            return []
        places = at.tolist()
        return [k for k, (a, b) in enumerate(zip(places[:-1], places[1:], strict=True)) if self.added.search(letters, a, b)]

    def _parts(self, raw: np.ndarray, at: np.ndarray, letters: bytes) -> np.ndarray:
        """Where the parts of the texts begin; together they are all of ``raw``."""
        near = _spaces(raw)
        lone = np.zeros(len(raw), bool)
        np.logical_or(near[:-2], near[2:], out=lone[1:-1])
        np.logical_not(lone[1:-1], out=lone[1:-1])
        lone &= near
        # Beside the edge of a text there is no other character.
        edge = at[(at > 0) & (at < len(raw))]
        lone[edge - 1] = False
        cut = lone & (raw == 32)
        if self.fine:
            lone &= raw == 10
            cut |= lone
            cut[1:] |= lone[:-1]
            cut[1:] |= _MARK[raw[1:]] & _PLAIN[raw[:-1]]
        for k in self._with_added(letters, at):
            cut[at[k] : at[k + 1]] = False
        cut[at[:-1][np.diff(at) > 0]] = True
        return np.flatnonzero(cut)

    def _ids(self, letters: bytes, cuts: list[int]) -> list[np.ndarray]:
        """The ids of the texts between cuts; the library holds many bytes an id, so it gets some of them at a time."""
        out = []
        a = 0
        while a < len(cuts) - 1:
            b = max(a + 1, bisect_right(cuts, cuts[a] + _AT_ONCE) - 1)
            texts = [letters[i:j].decode() for i, j in zip(cuts[a:b], cuts[a + 1 : b + 1], strict=True)]
            out += [np.array(coded.ids, "<u4") for coded in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            a = b
        return out

    def _together(self, texts: pa.Array, line_ends: bool) -> pa.Array | None:
        """The ids of parts, encoded many at a time, each before a line end or as they are; none if a word goes over an end."""
        raw, at = utf8(texts)
        start, stop = at[:-1], at[1:]
        if line_ends:
            raw = np.insert(raw, stop, 10)
            start, stop = start + np.arange(len(start)), stop + np.arange(len(stop))
        letters = raw.tobytes()
        flat = np.concatenate([np.zeros(0, "<u4"), *self._ids(letters, [*start[::_RUN].tolist(), len(letters)])])
        done = np.concatenate(([0], np.cumsum(self.spelt[flat])))
        first, last = np.searchsorted(done, start), np.searchsorted(done, stop)
        if done[-1] != len(letters) or (done[first] != start).any() or (done[last] != stop).any():
            return None
        if line_ends:
            mine = np.ones(len(flat), bool)
            mine[last] = False
            flat = flat[mine]
            if len(flat) != (last - first).sum():
                return None
        offsets = 4 * np.concatenate(([0], np.cumsum(last - first)))
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])

    def _encoded(self, texts: pa.Array) -> pa.Array:
        """The ids of different parts."""
        raw, at = utf8(texts)
        white = np.concatenate(([0], np.cumsum(_spaces(raw))))
        white = white[at[1:]] - white[at[:-1]]
        lead = np.zeros(len(texts), bool)
        lead[:] = raw[at[:-1]] == 32
        alone = white > lead
        if not self.fine:
            alone |= ~lead
        alone[self._with_added(raw.tobytes(), at)] = True
        places, coded = [], []
        # A part that begins with a space stands after another as it is, others after a line end.
        for some, line_ends in ((lead & ~alone, False), (~lead & ~alone, True)):
            place = np.flatnonzero(some)
            found = self._together(texts.take(pa.array(place)), line_ends)
            if found is None:
                alone |= some
            else:
                places.append(place)
                coded.append(found)
        places.append(np.flatnonzero(alone))
        raw, at = utf8(texts.take(pa.array(places[-1])))
        coded.append(pa.array([ids.tobytes() for ids in self._ids(raw.tobytes(), at.tolist())], pa.large_binary()))
        return pa.concat_arrays(coded).take(pa.array(np.argsort(np.concatenate(places))))

    def _learn(self, names: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Ids of parts, and where among them those of each of ``names`` are."""
        place = pa.compute.index_in(names, value_set=self.known)
        new = np.asarray(place.is_null())
        place = np.asarray(place.fill_null(0), np.int64)
        place[new] = len(self.known) + np.arange(int(new.sum()))
        fresh = names.filter(pa.array(new))
        found = self._encoded(fresh)
        coded = pa.concat_arrays([self.coded, found])
        short = pa.compute.less_equal(pa.compute.binary_length(fresh), _REMEMBERED_BYTES)
        kept, ids = fresh.filter(short), found.filter(short)
        if len(self.known) + len(kept) > self.remembered:
            self.known, self.coded = kept, ids
        elif len(kept):
            self.known, self.coded = pa.concat_arrays([self.known, kept]), pa.concat_arrays([self.coded, ids])
        return coded, place

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        raw, at = utf8(texts)
        if not len(raw):
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        letters = raw.tobytes()
        start = self._parts(raw, at, letters)
        first = np.searchsorted(start, at)
        ends = np.append(start, len(raw))
        parts = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(letters)]).dictionary_encode()
        del start, ends
        coded, place = self._learn(parts.dictionary)
        taken = coded.take(pa.array(place[np.asarray(parts.indices)]))
        del coded, parts
        _, offsets, data = taken.buffers()
        done = np.frombuffer(offsets, np.int64, len(taken) + 1) // 4
        ids = np.frombuffer(data, "<u4", int(done[-1]))
        return ids, np.diff(done[first])


def _write(definition, terminals: int, p: FileParams):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(definition.value, p.remembered, p.added_tokens)
        partition = TaskContext.get().partitionId()
        codes: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        ids: list[pa.Array] = []
        number, held = 0, 0

        def shard() -> pa.RecordBatch:
            nonlocal number, held
            sizes = np.concatenate(lengths)
            document = pa.chunked_array(ids).combine_chunks()
            named = np.asarray(document.is_valid())
            documents = np.asarray(document.fill_null(0), np.int64)
            every = np.concatenate(codes)
            codes.clear()
            lengths.clear()
            ids.clear()
            file = file_of(every, sizes, documents, named, terminals, p)
            row = pa.RecordBatch.from_arrays([pa.array([(partition << 24) + number]), pa.array([int(sizes.sum())]), pa.array([file], pa.binary())], ["shard", "n_ids", "file"])
            number, held = number + 1, 0
            return row

        for batch in pieces(batches, "text", _BATCH):
            found, sizes = words.encode(batch.column("text"))
            codes.append(np.insert(found, np.cumsum(sizes), np.uint32(p.end)))
            lengths.append(sizes + 1)
            ids.append(batch.column("id"))
            held += codes[-1].nbytes
            if held >= p.shard_bytes:
                yield shard()
        if codes:
            yield shard()

    return of


def write_files(docs: DataFrame, path: str, definition: str, id_column: str = "doc_id", text: str = "text", params: FileParams | None = None) -> None:
    """Encodes the texts and writes ``shard, n_ids, file`` rows, shards in the order of ids."""
    import json

    p = params or FileParams()
    described = json.loads(definition)
    terminals = max([*described["model"]["vocab"].values(), *(t["id"] for t in described.get("added_tokens") or [])]) + 1
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    ordered = rows.repartitionByRange(max(1, -(-size // p.partition_bytes)), F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    ordered.mapInArrow(_write(shared, terminals, p), "shard long, n_ids long, file binary").write.parquet(path)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for before, raw in zip(batch.column("before").to_pylist(), batch.column("file"), strict=True):
            file = TokenFile(raw.as_py())
            ends = np.cumsum(file.sizes)
            start = ends - file.sizes
            # A stretch of documents at a time: a whole shard spelt out takes many times its file.
            cuts = [0, *(np.flatnonzero(np.diff(start // _STRETCH)) + 1).tolist(), len(ends)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                every = file.ids_between(a, b).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(file.documents[a:b], pa.int64(), mask=~file.named[a:b]),
                        pa.array(start[a:b] + before),
                        pa.array(file.sizes[a:b]),
                        pa.array([every[4 * i : 4 * j] for i, j in zip((start[a:b] - start[a]).tolist(), (ends[a:b] - start[a]).tolist(), strict=True)], pa.binary()),
                    ],
                    ["id", "start", "n_tokens", "ids"],
                )


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``(id, start, n_tokens, ids)`` of every document; ``start``: ids of all documents before it."""
    files = spark.read.schema("shard long, n_ids long, file binary").parquet(path)
    # One row per shard, without its file; it goes to the files, which are not shuffled.
    before = files.select("shard", "n_ids").withColumn("before", F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_ids"))
    return files.select("shard", "file").join(F.broadcast(before.select("shard", "before")), "shard").select("before", "file").mapInArrow(_decode, "id long, start long, n_tokens long, ids binary")
