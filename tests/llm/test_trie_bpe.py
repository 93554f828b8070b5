"""Trie encoding against the library."""

from __future__ import annotations

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm.test_texts import ODD, odd_docs
from tidegrid.llm import queries, trie_bpe

with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
    DEFINITION = f.read()


def listed(raw: bytes) -> list[int]:
    return np.frombuffer(raw, "<u4").tolist()


def test_words_are_encoded_as_by_the_library():
    library, words = Tokenizer.from_str(DEFINITION), trie_bpe.Words(DEFINITION, remembered=1000)
    rnd = random.Random(5)
    texts = [t or "" for t in ODD] + ["a" * n for n in range(30)] + ["word.\nNext, Élan!\nx", "a.\n\nb", "<|endoftext|><|endoftext|>x <|endoftext|> "]
    texts += ["".join(rnd.choice("aeioutnsrhl   '.,\nÀé日1<|>") for _ in range(rnd.randrange(1, 60))) for _ in range(3000)]
    pieces = trie_bpe.vocabulary(DEFINITION)
    texts += [b"".join(rnd.choice(pieces) for _ in range(rnd.randrange(1, 6))).decode("utf-8", "replace") for _ in range(3000)]
    for first in range(0, len(texts), 500):  # what is remembered is dropped on the way
        some = texts[first : first + 500]
        for text, got, want in zip(some, words.encode(some), library.encode_batch(some, add_special_tokens=False), strict=True):
            assert listed(got) == want.ids, text


def test_a_small_tokenizer_by_plain_merging():
    """Merges in any order, some tokens never reached: the walk against merging the lowest rank first."""
    letters = trie_bpe.byte_letters()
    for seed in range(20):
        rnd = random.Random(seed)
        vocab, merges = {x: i for i, x in enumerate(letters)}, []
        while len(merges) < 40:
            a, b = rnd.choice([x for x in vocab if set(x) <= set("abc")]), rnd.choice([x for x in vocab if set(x) <= set("abc")])
            if a + b not in vocab and len(a + b) < 9:
                vocab[a + b] = len(vocab)
                merges.append([a, b])
        trie = trie_bpe.Trie(trie_bpe.Merges.of({"vocab": vocab, "merges": merges}), remembered=50)
        words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 25))).encode() for _ in range(300)})
        for word, got in zip(words, trie.walk(words), strict=True):
            parts = [chr(b) for b in word]
            while True:
                ranks = [(merges.index([x, y]), i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if [x, y] in merges]
                if not ranks:
                    break
                i = min(ranks)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            assert got == [vocab[x] for x in parts]


def test_query_and_edges(spark, sf):
    library = Tokenizer.from_str(DEFINITION)

    def digest(raw: bytes) -> str:
        return hashlib.sha256(raw).hexdigest()

    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op11_trie_bpe(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toLocalIterator():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert got.pop(r.doc_id) == (len(ids), digest(np.array(ids, "<u4").tobytes()), digest(library.decode(ids, skip_special_tokens=False).encode()))
    assert not got
    docs = odd_docs(spark).withColumn("_text", F.lit("clash"))
    rows = trie_bpe.decode(trie_bpe.encode(docs, DEFINITION, keep=("doc_id", "ids", "_text", "text")), DEFINITION, keep=("doc_id", "ids", "_text", "text")).collect()
    assert len(rows) == len(ODD) + 2
    assert all(r["_text"] == "clash" and r.decoded == (r.text or "") and listed(r.ids) == library.encode(r.text or "", add_special_tokens=False).ids for r in rows)
    assert trie_bpe.encode(docs.limit(0), DEFINITION).count() == 0
    odd = spark.createDataFrame([(1, bytearray(np.array([50256, 99999, 220, 255, 160], "<u4").tobytes())), (2, None)], "doc_id long, ids binary")
    assert [r.decoded for r in trie_bpe.decode(odd, DEFINITION).orderBy("doc_id").collect()] == [library.decode([50256, 220, 255, 160], skip_special_tokens=False), ""]


def test_other_tokenizers_are_refused(spark):
    for name, value in (("normalizer", {"type": "NFC"}), ("pre_tokenizer", {"type": "Whitespace"})):
        with pytest.raises(ValueError):
            trie_bpe.encode(spark.range(0).selectExpr("id as doc_id", "'' as text"), json.dumps({**json.loads(DEFINITION), name: value}))
