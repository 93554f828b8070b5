"""Language identification with spans: scripts, then words, then a best path.

Learning: letter trigrams (within a word, white space as its border) are hashed to a table of
fixed size and counted per language over a bounded sample of different labelled texts; the shares of
scripts in each language's letters are counted too.

Prediction, on whole texts: the script of a word's letters narrows the languages to those in
which that script was seen.  Each word gets one score per remaining language, the sum of
its trigrams' log probabilities.  Viterbi then finds the best sequence of languages over the
words, with a penalty for each switch.  Runs of one language are the spans.  A text's language
is the one whose spans hold most letters; the score is their share of all letters.  A null
text or one without a letter has language ``und``, score 0 and no spans; so has every text if nothing was learnt.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.bytestrings import U, mix
from tidegrid.llm.common import pieces

#: First code points of script ranges and the script each range starts; other letters follow the range before.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"),
    (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"),
    (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"),
    (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xA720, "latin"),
    (0xA800, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"),
    (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"),
    (0x10000, "other"), (0x20000, "han"), (0x32000, "other"),
)
NAMES = sorted({name for _, name in SCRIPTS})


@dataclass(frozen=True)
class LanguageParams:
    #: Different labelled texts to learn from, at most about so many for each language.
    sample_rows: int = 3000
    #: Cells of the trigram table.
    table_bits: int = 16
    #: Added to each count.
    prior: float = 0.02
    #: Cost of changing the language between two words, in nats.
    switch: float = 8.0
    #: A script belongs to a language if it holds this share of the language's letters.
    script_share: float = 0.001


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    #: log probabilities, cells x languages.
    table: np.ndarray
    #: scripts x languages: may the language use the script?
    allowed: np.ndarray
    switch: float


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: is it a letter, and the number of its script."""
    letter = np.zeros(0x110000, bool)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            letter[c] = True
    number = np.array([NAMES.index(name) for _, name in SCRIPTS], np.int8)
    script = number[np.searchsorted([c for c, _ in SCRIPTS], np.arange(0x110000), "right") - 1]
    return letter, script


def _trigrams(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all letters of all texts: trigram cell and script; where each word begins among them; how many words each text has."""
    letter, script = _letters()
    lowered = [x.lower() for x in texts]
    code = np.frombuffer(" ".join(["", *lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letter[code]
    bare = np.where(is_letter, code, 0).astype(U)
    at = np.flatnonzero(is_letter)
    cell = (mix((bare[at - 1] << U(42)) | (bare[at] << U(21)) | bare[at + 1]) >> U(64 - bits)).astype(np.int64)
    first = ~is_letter[at - 1]
    begin = np.flatnonzero(first)
    edge = np.cumsum([1, *(len(x) + 1 for x in lowered)])
    return cell, script[code[at]], begin, np.diff(np.searchsorted(at[begin], edge))


def _count(bits: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in pieces(batches, "text"):
            lang = batch.column("lang").to_pylist()
            text = batch.column("text").to_pylist()
            for name in sorted(set(lang)):
                cell, script, _, _ = _trigrams([t for t, x in zip(text, lang, strict=True) if x == name], bits)
                here = np.concatenate((np.bincount(cell, minlength=1 << bits), np.bincount(script, minlength=len(NAMES))))
                total[name] = total.get(name, 0) + here
        for name, counts in total.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array(some), pa.array(counts[some].astype(np.int64))], ["lang", "cell", "n"])

    return of


def learn(labelled: DataFrame, params: LanguageParams | None = None) -> LanguageModel:
    """A model from ``(text, lang)``; copies count once, and which texts of a language are in the sample depends on their content alone."""
    p = params or LanguageParams()
    rows = labelled.where("text is not null and lang is not null")
    hashed = F.xxhash64("text", "lang")
    # Texts are counted by their hashes; only those in the sample are shuffled.
    per = rows.select("lang", hashed.alias("hash")).distinct().groupBy("lang").agg(F.count("*").alias("texts"))
    key = F.pmod(hashed, F.lit(1 << 30)) / float(1 << 30)
    # One row per language, as the model has; it may be broadcast.
    sample = rows.join(F.broadcast(per), "lang").where(key * F.col("texts") < p.sample_rows).select("text", "lang").distinct()
    counted = sample.mapInArrow(_count(p.table_bits), "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    found = counted.toPandas()  # the model: languages x cells, whatever the size of the corpus
    languages = sorted(found.lang.unique().tolist(), key=lambda x: x.encode())
    size = 1 << p.table_bits
    table = np.zeros((size, len(languages)), np.float32)
    allowed = np.zeros((len(NAMES), len(languages)), bool)
    for k, name in enumerate(languages):
        part = found[found.lang == name]
        counts = np.zeros(size + len(NAMES))
        counts[part.cell.to_numpy()] = part.n.to_numpy()
        table[:, k] = np.log((counts[:size] + p.prior) / (counts[:size].sum() + p.prior * size))
        allowed[:, k] = counts[size:] >= p.script_share * max(1.0, counts[size:].sum())
    allowed[~allowed.any(1)] = True
    return LanguageModel(languages, table, allowed, p.switch)


def best_paths(score: np.ndarray, length: np.ndarray, switch: float) -> np.ndarray:
    """The best language of every word: Viterbi over each text's words, all texts at once.

    ``score``: words x languages, texts one after the other; ``length``: words of each text.
    """
    out = np.zeros(len(score), np.int16)
    if not len(score):
        return out
    kinds = np.arange(score.shape[1])
    order = np.argsort(-length, kind="stable")
    begin = (np.cumsum(length) - length)[order]
    longest = int(length[order[0]])
    active = np.searchsorted(-length[order], -np.arange(1, longest + 1), "right")  # texts that have a k-th word
    value = score[begin[: active[0]]].copy()
    came: list[np.ndarray] = []
    for k in range(1, longest):
        so_far = value[: active[k]]
        best = so_far.argmax(1)[:, None]
        jump = np.take_along_axis(so_far, best, 1) - switch
        stay = so_far >= jump
        came.append(np.where(stay, kinds, best).astype(np.int16 if len(kinds) > 127 else np.int8))
        value[: active[k]] = score[begin[: active[k]] + k] + np.where(stay, so_far, jump)
    state = value.argmax(1)
    for k in range(longest - 1, -1, -1):
        n = active[k]
        out[begin[:n] + k] = state[:n]
        if k:
            state[:n] = came[k - 1][np.arange(n), state[:n]]
    return out


def label_spans(texts: list[str], model: LanguageModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word: the number of its text, the number of its language, its letters."""
    bits = int(np.log2(len(model.table)))
    cell, script, begin, length = _trigrams(texts, bits)
    row = np.repeat(np.arange(len(texts)), length)
    if not len(begin) or not model.languages:
        none = np.zeros(0, np.int64)
        return none, none, none
    letters = np.diff(np.concatenate((begin, [len(cell)])))
    score = np.add.reduceat(model.table[cell], begin, axis=0).astype(np.float64)
    allowed = model.allowed[script[begin]]
    score = np.where(allowed, score, score - 1000.0)
    return row, best_paths(score, length, model.switch), letters


def _predict(model, with_text: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: LanguageModel = model.value
        for batch in pieces(batches, "text"):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            n, k = len(texts), len(m.languages)
            row, lang, letters = label_spans(texts, m)
            share = np.bincount(row * k + lang, letters, minlength=n * k).reshape(n, k) if k else np.zeros((n, 1))
            total = share.sum(1)
            some = total > 0
            best = share.argmax(1)
            names = [m.languages[b] if s else "und" for b, s in zip(best, some, strict=True)]
            switch = np.ones(len(row), bool)
            switch[1:] = (row[1:] != row[:-1]) | (lang[1:] != lang[:-1])
            at = np.flatnonzero(switch)
            size = np.diff(np.concatenate((at, [len(row)])))
            offsets = np.concatenate(([0], np.cumsum(np.bincount(row[at], minlength=n)))).astype(np.int32)
            span = pa.StructArray.from_arrays([pa.array([m.languages[x] for x in lang[at]], pa.string()), pa.array(size, pa.int32())], ["lang", "words"])
            out = {
                "lang_pred": pa.array(names, pa.string()),
                "score": pa.array(np.where(some, share.max(1) / np.maximum(total, 1), 0.0)),
                "spans": pa.ListArray.from_arrays(pa.array(offsets), span),
            }
            rest = [c for c in batch.schema.names if with_text or c != "text"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + list(out.values()), rest + list(out))

    return of


def identify(rows: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """Columns ``keep`` of ``rows`` with ``lang_pred``, ``score`` and ``spans`` (language and number of words of each run).

    ``with_text`` gives the text too, as column ``text``.
    """
    from pyspark.sql import types as T

    shared = rows.sparkSession.sparkContext.broadcast(model)
    taken = rows.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("text"))
    spans = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("words", T.IntegerType())]))
    schema = T.StructType(
        [taken.schema[c] for c in (*keep, *["text"] * with_text)] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", spans)]
    )
    return taken.mapInArrow(_predict(shared, with_text), schema)


def held_out(id_column: str = "doc_id") -> Column:
    """True for the fifth of the rows that learning must not see."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn_from_documents(docs: DataFrame, params: LanguageParams | None = None) -> LanguageModel:
    """A model from the rows of ``docs`` that are not held out; rows without an id are not learnt from."""
    return learn(docs.where("doc_id is not null").where(~held_out()).select("text", "lang"), params)
