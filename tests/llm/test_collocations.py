"""Phrases of the graph against counting every phrase."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from tidegrid.llm import collocations
from tidegrid.llm.collocations import CollocationParams

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_counting(rows, p):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, p.longest + 1) for i in range(len(w) - k + 1))
    often = {g: a for g, a in f.items() if a >= p.least}
    inside = set()
    for (lang, g), a in often.items():
        inside |= {(lang, g[i:j], a) for i in range(len(g)) for j in range(i + 2, len(g) + 1) if j - i < len(g)}
    out = {}
    for (lang, g), a in often.items():
        if len(g) > 1 and (lang, g, a) not in inside:
            cuts = [(1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g))]
            score, _, left, right = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), left, right))
    return {lang: [(i + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for i, x in enumerate(sorted(v)[: p.top])] for lang, v in out.items()}, often


def rows_of(seed):
    rnd = random.Random(seed)
    words = ["a", "b", "c", "the", "É", "of", "日本", "x" * 300]
    rows = [(None, "en"), ("", None), (" \t ", "en"), (".,;", "en"), ("a b c the of a b c the of", ""), ("a", "en")]
    for _ in range(150):
        text = "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " \x1c "]) for _ in range(rnd.randrange(1, 25)))
        rows.append((text.upper() if rnd.random() < 0.2 else text, rnd.choice(["en", "en", None, "de", "und"])))
    long = " ".join(rnd.choice(["rare%d" % i for i in range(50)]) for _ in range(40))
    return rows + [(f"start {i}, {long} of", "fr") for i in range(12)] + [("the of " * 1200, "en")] + [("a b c", "en")] * 30 + [("en de und", "en"), ("de en und", "de"), ("und en de", None)] * 9


@pytest.mark.parametrize("p", [CollocationParams(least=4), CollocationParams(least=9, longest=3, top=5), CollocationParams(least=1, longest=7, top=100000)])
def test_like_counting(spark, p, monkeypatch):
    if p.longest == 7:  # most words stand in the edges with their hash
        monkeypatch.setattr(collocations, "_NUMBERED", 3)
    rows = rows_of(p.least)
    docs = spark.createDataFrame([(i, t, g, i) for i, (t, g) in enumerate(rows)], "group long, text string, lang string, n long").repartition(3)
    got = {}
    for r in collocations.collocations(collocations.graph(docs, params=p)).orderBy("group", "rank").collect():
        got.setdefault(r.group, []).append((r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score))
    assert got == by_counting(rows, p)[0]


def test_paths(spark):
    p = CollocationParams(least=5)
    rows = rows_of(3)
    found = collocations.graph(spark.createDataFrame([(t, g) for t, g in rows], "text string, lang string"), params=p)
    got = {(r.group, r.phrase): (r.words, r.n) for r in collocations.paths(found).collect()}
    often = by_counting(rows, p)[1]
    edges = {(lang, g) for (lang, g) in often if len(g) == 5}
    step = {}
    for lang, g in edges:
        after = [h for l2, h in edges if l2 == lang and h[:4] == g[1:] and often[lang, g] == often[lang, h] == often[lang, g[1:]]]
        assert len(after) <= 1
        if after:
            step[lang, g] = (lang, after[0])
    want = {}
    for lang, g in edges - set(step.values()):
        words, at = list(g), (lang, g)
        while at in step:
            at = step[at]
            words.append(at[1][-1])
        want[lang, " ".join(words)] = (len(words), often[lang, g])
    assert got == want
    assert max(w for w, _ in got.values()) > 30


def test_empty_and_hot(spark):
    none = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(collocations.graph(none)).count() == 0
    assert collocations.paths(collocations.graph(none)).count() == 0
    with pytest.raises(ValueError):
        CollocationParams(longest=2)


def test_large_products(spark):
    """Counts whose products pass 64 bits."""
    phrases = spark.createDataFrame([([1, 2], 3 * 10**12), ([1], 10**13), ([2], 10**13 + 1)], "g array<long>, a long")
    words = spark.createDataFrame([(1, "en", "a"), (2, "en", "b")], "key long, `group` string, word string")
    totals = spark.createDataFrame([("en", 9 * 10**15)], "`group` string, n long")
    (row,) = collocations.collocations(collocations.Graph(phrases, words, totals, CollocationParams())).collect()
    assert row.score == 1000 * 3 * 10**12 * 9 * 10**15 // (10**13 * (10**13 + 1))


def test_numbers_of_words():
    """Words of one, two, three and nine bytes come back; no one begins another."""
    keys = np.arange(1, 30_001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    numbers = collocations._Numbers(keys)
    some = np.concatenate((keys[[0, 159, 160, 20639, 20640, 29999]], np.array([5, 0xFFFFFFFFFFFFFFFF, 0], np.uint64)))
    spelt, size = numbers.spell(some, numbers.number(some))
    assert size.tolist() == [1, 1, 2, 2, 3, 3, 9, 9, 0]
    texts = [bytes(row[:n]) for row, n in zip(spelt, size)]
    assert not any(a != b and a and b.startswith(a) for a in texts for b in texts)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    end = np.cumsum(size)
    got, number, after = numbers.read(raw, end - size, end)
    assert got.tolist() == some.tolist() and after.tolist() == end.tolist()
    assert number.tolist() == [0, 159, 160, 20639, 20640, 29999, -1, -1, -1]
