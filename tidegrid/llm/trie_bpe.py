"""BPE encoding by one walk over a trie of distinct words, and decoding.

What makes a trie worth while: the encoding of a prefix is the encoding of a shorter prefix and one
more token.  So a node of the trie needs a single state, the last token of its prefix, and that
follows from the states above it: of the tokens that end the prefix, it is the one that stays apart
from the state at the node where it begins.  Words with a common beginning share those nodes, so their
common part is encoded once.  Two tokens stay apart if no merge across their border would have
come before the merges that built them; taking those back one by one, latest first, shows it.

A task cuts its texts into words as the tokenizer does, sorts those it does not know yet, and walks
them: in sorted order the nodes come depth first, and a stack holds the states of the
current path.  Encoded parts are remembered up to a fixed number, which changes no result.  An automaton of
all tokens names those that end a prefix, so a word of any length takes time in proportion to it.

The tokenizer is one of the ``tokenizers`` library: byte-level BPE with its word pattern, no
normalizer, one merge per token.  Others are refused with ``ValueError``.  Its added tokens in a text
are one id each, as in the library.

Null and empty texts have no ids and decode to the empty text.  Repeated rows and null ids of documents
are rows like any other.  Of other columns only those named in ``keep`` stay; one that is named like a
result gives way to the result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.common import pieces

# No word of the pattern goes over a space between two other characters, and both sides are cut alike without each other.
_BOUNDARY = re.compile(r"(?<=\S) (?=\S)")
# Words as most parts hold them; all others are cut by the library.
_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+"
_PLAIN = re.compile(f"( ?{_LETTERS})([,.;:!?]+)?(?:(\n)({_LETTERS})([,.;:!?]+)?)?")
_NEVER = 1 << 60


def byte_letters() -> list[str]:
    """How byte-level vocabularies write each byte: printable ones as themselves, the others as letters from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


@dataclass(frozen=True)
class Merges:
    """The merges as tables over token ids: when each token is built (-1 for bytes), and of which two."""

    ids: dict[str, int]
    built: list[int]
    left: list[int]
    right: list[int]
    pairs: dict[tuple[int, int], int]

    @staticmethod
    def of(model: dict) -> Merges:
        ids = model["vocab"]
        size = max(ids.values()) + 1
        built, left, right, pairs = [-1] * size, [-1] * size, [-1] * size, {}
        for when, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            token = ids[a + b]
            if built[token] >= 0:
                raise ValueError(f"two merges for one token: {a + b}")
            built[token], left[token], right[token] = when, ids[a], ids[b]
            pairs[ids[a], ids[b]] = when
        loose = [t for t, i in ids.items() if len(t) > 1 and built[i] < 0]
        if loose or {*byte_letters()} - {*ids}:
            raise ValueError("not a byte-level vocabulary in which each longer token has a merge")
        return Merges(ids, built, left, right, pairs)

    def apart(self, a: int, b: int, own: bool = False) -> bool:
        """Whether a word that is the bytes of ``a`` and then of ``b`` is encoded as these two.

        With ``own``, the merge of the two themselves does not count: whether they meet at all.
        """
        until_a = until_b = _NEVER  # when the part at the border goes into a larger one
        while True:
            when = self.pairs.get((a, b), _NEVER)
            if not own and when < until_a and when <= until_b:  # of equal merges the left one comes first
                return False
            own = False
            if self.built[a] < 0 and self.built[b] < 0:
                return True
            if self.built[a] > self.built[b]:
                until_a, a = self.built[a], self.right[a]
            else:
                until_b, b = self.built[b], self.left[b]

    def reachable(self) -> dict[str, int]:
        """The tokens that their own bytes are encoded as."""
        good = [w < 0 for w in self.built]
        for token in sorted((t for t in range(len(self.built)) if self.built[t] >= 0), key=self.built.__getitem__):
            a, b = self.left[token], self.right[token]
            good[token] = good[a] and good[b] and self.apart(a, b, own=True)
        return {text: token for text, token in self.ids.items() if good[token]}


class Trie:
    """Encodes sorted words, given as bytes."""

    def __init__(self, merges: Merges, remembered: int = 1 << 18) -> None:
        self.merges, self.remembered = merges, remembered
        byte = {letter: b for b, letter in enumerate(byte_letters())}
        tokens = {bytes(byte[c] for c in text): token for text, token in merges.reachable().items()}
        self.length = [0] * len(merges.built)
        # The tokens as an automaton: where a byte leads, and per node the tokens that end there, longest first.
        self.step: dict[int, int] = {}
        self.back, self.ends = [0], [()]
        for text, token in sorted(tokens.items(), key=lambda x: (len(x[0]), x[0])):
            self.length[token] = len(text)
            node = 0
            for b in text[:-1]:
                node = self.step.get(node << 8 | b) or self._node(node, b)
            self.ends[self.step.get(node << 8 | text[-1]) or self._node(node, text[-1])] = ((token, len(text)),)
        level = [node for node in (self.step.get(b) for b in range(256)) if node]
        children: dict[int, list[tuple[int, int]]] = {}
        for key, node in self.step.items():
            children.setdefault(key >> 8, []).append((key & 255, node))
        while level:
            below = []
            for parent in level:
                for b, node in children.get(parent, ()):
                    self.back[node] = self._next(self.back[parent], b)
                    self.ends[node] += self.ends[self.back[node]]
                    below.append(node)
            level = below
        self.together: dict[int, bool] = {}

    def _node(self, node: int, b: int) -> int:
        self.step[node << 8 | b] = len(self.back)
        self.back.append(0)
        self.ends.append(())
        return len(self.back) - 1

    def _next(self, node: int, b: int) -> int:
        """The longest end of the path so far that begins a token; found ways are kept, within the bound."""
        at = node
        while at and at << 8 | b not in self.step:
            at = self.back[at]
        found = self.step.get(at << 8 | b, 0)
        if len(self.step) < 4 * len(self.back):
            self.step[node << 8 | b] = found
        return found

    def walk(self, words: list[bytes]) -> Iterator[list[int]]:
        """The ids of each word; ``words`` are sorted and not empty."""
        step, ends, together, apart, length = self.step, self.ends, self.together, self.merges.apart, self.length
        # Per letter of the current path: the node of the automaton, and the last token of the prefix.
        nodes: list[int] = [0]
        states: list[int] = [0]
        before = b""
        for word in words:
            if len(together) > self.remembered:
                together.clear()
            shared = 0
            for x, y in zip(word, before):
                if x != y:
                    break
                shared += 1
            del states[shared + 1 :], nodes[shared + 1 :]
            node, depth = nodes[shared], shared
            for b in word[shared:]:
                found = step.get(node << 8 | b)
                node = self._next(node, b) if found is None else found
                depth += 1
                for token, size in ends[node]:
                    if size == depth:
                        break
                    border = states[depth - size] << 32 | token
                    fits = together.get(border)
                    if fits is None:
                        fits = together[border] = apart(states[depth - size], token)
                    if fits:
                        break
                states.append(token)
                nodes.append(node)
            before = word
            ids = []
            while depth:
                ids.append(states[depth])
                depth -= length[states[depth]]
            yield ids[::-1]


class Words:
    """Texts to ids in one task: cut, look up, walk what is new."""

    def __init__(self, definition: str, remembered: int = 1 << 19) -> None:
        from tokenizers import pre_tokenizers

        described = json.loads(definition)
        self.trie = Trie(Merges.of(described["model"]))
        self.added = {t["content"]: t["id"] for t in described.get("added_tokens") or []}
        self.marks = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=lambda t: (-len(t), t)))) if self.added else None
        self.cutter = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.byte = {letter: b for b, letter in enumerate(byte_letters())}
        self.remembered = remembered
        self.known: dict[str, bytes] = {}

    def _split(self, part: str) -> list[bytes]:
        plain = _PLAIN.fullmatch(part)
        if plain:
            return [w.encode() for w in plain.groups() if w]
        return [bytes(map(self.byte.__getitem__, w)) for w, _ in self.cutter.pre_tokenize_str(part)]

    def learn(self, parts: set[str]) -> None:
        cut = {part: self._split(part) for part in parts}
        words = sorted({w for split in cut.values() for w in split})
        found = list(self.trie.walk(words))
        raw = np.fromiter(chain.from_iterable(found), "<u4").tobytes()
        ends = accumulate(map(len, found), initial=0)
        ids = {w: raw[4 * a : 4 * b] for w, (a, b) in zip(words, pairwise(ends), strict=True)}
        for part, split in cut.items():
            self.known[part] = ids[split[0]] if len(split) == 1 else b"".join([ids[w] for w in split])

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.remembered:
            self.known.clear()
        cut: list[list[str | bytes]] = []
        for text in texts:
            row: list[str | bytes] = []
            at = 0
            for mark in self.marks.finditer(text) if self.marks else ():
                row += self._parts(text[at : mark.start()])
                row.append(np.array([self.added[mark.group()]], "<u4").tobytes())
                at = mark.end()
            row += self._parts(text[at:] if at else text)
            cut.append(row)
        known = self.known
        self.learn({x for row in cut for x in row if x.__class__ is str}.difference(known))
        return [b"".join([known[x] if x.__class__ is str else x for x in row]) for row in cut]

    @staticmethod
    def _parts(text: str) -> list[str]:
        if not text:
            return []
        head, *rest = _BOUNDARY.split(text)
        return [head, *[" " + x for x in rest]]


def _checked(definition: str) -> dict:
    """The definition, if it is of the kind that the walk encodes as the library does."""
    d = json.loads(definition)
    cutter, model = d.get("pre_tokenizer") or {}, d["model"]
    plain = {"dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "ignore_merges": False}
    right = model.get("type") == "BPE" and all((model.get(k) or None) == (v or None) for k, v in plain.items()) and d.get("normalizer") is None
    right &= cutter.get("type") == "ByteLevel" and not cutter.get("add_prefix_space") and cutter.get("use_regex", True)
    right &= not any(t.get(k) for t in d.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if not right:
        raise ValueError("not a byte-level BPE of the kind described")
    Merges.of(model)
    return d


def _with(df: DataFrame, keep: tuple[str, ...], source: str, result: str, kind: T.DataType) -> tuple[DataFrame, list[str], T.StructType]:
    """The kept columns and the source under the name ``_ + source``, with as many more lines as none of them has."""
    kept = [c for c in keep if c != result]
    named = next(n for n in ("_" * k + source for k in range(1, len(kept) + 2)) if n not in kept)
    rows = df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{source}`").alias(named))
    return rows, kept, T.StructType([df.schema[c] for c in kept] + [T.StructField(result, kind)])


def encode(docs: DataFrame, definition: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and ``ids``, 32-bit and little-endian; ``definition``: the tokenizer as JSON."""
    _checked(definition)
    rows, kept, schema = _with(docs, keep, text, "ids", T.BinaryType())
    source = rows.columns[-1]
    shared = docs.sparkSession.sparkContext.broadcast(definition)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(shared.value)
        for batch in pieces(batches, source):
            ids = words.encode([x or "" for x in batch.column(source).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(ids, pa.binary())], [*kept, "ids"])

    return rows.mapInArrow(of, schema)


def vocabulary(definition: str) -> list[bytes]:
    """The bytes of each id; ids without a token have none."""
    d = json.loads(definition)
    byte = {letter: b for b, letter in enumerate(byte_letters())}
    added = {t["content"]: t["id"] for t in d.get("added_tokens") or []}
    out = [b""] * (max([*d["model"]["vocab"].values(), *added.values()]) + 1)
    for token, i in {**d["model"]["vocab"], **added}.items():
        spelt = all(c in byte for c in token)
        out[i] = bytes(byte[c] for c in token) if spelt else token.encode()
    return out


def decode(coded: DataFrame, definition: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and ``decoded``, the text of the ids, special tokens included.

    Ids without a token say nothing; bytes that are not UTF-8 become the replacement character.
    """
    rows, kept, schema = _with(coded, keep, ids, "decoded", T.StringType())
    source = rows.columns[-1]
    shared = coded.sparkSession.sparkContext.broadcast(vocabulary(definition))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array([*shared.value, b""], pa.large_binary())
        for batch in pieces(batches, source):
            column = batch.column(source)
            lists = [np.frombuffer(x.as_buffer(), "<u4") if x.is_valid else np.zeros(0, "<u4") for x in column]
            flat = np.minimum(np.concatenate(lists), len(table) - 1) if lists else np.zeros(0, "<u4")
            found = table.take(pa.array(flat))
            _, offsets, data = found.buffers()
            at = np.frombuffer(offsets, np.int64, len(found) + 1)[np.cumsum([0] + [len(x) for x in lists])].tolist()
            raw = data.to_pybytes() if data is not None else b""
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, "decoded"])

    return rows.mapInArrow(of, schema)
