"""Joins, near-duplicates and searches against brute force."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.llm import ngram_join, queries
from tidegrid.llm.common import components
from tidegrid.llm.cover_tree import CosineParams, CoverTree, near_duplicates, near_pairs
from tidegrid.llm.knn_join import KnnParams, top_k
from tidegrid.llm.ngram_join import JaccardParams, similar_groups

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Groups:
    def __init__(self):
        self.top = {}

    def find(self, x):
        self.top.setdefault(x, x)
        while self.top[x] != x:
            self.top[x] = self.top[self.top[x]]
            x = self.top[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.top[max(a, b)] = min(a, b)


def jaccard_groups(rows):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    held, groups = {}, Groups()
    for i, s in sets.items():
        common = Counter(j for t in s for j in held.get(t, ()))
        for j, k in common.items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                groups.join(i, j)
        for t in s:
            held.setdefault(t, []).append(i)
    return {i: (len(s), groups.find(i)) for i, s in sets.items()}


def test_components_of_chains_and_cycles(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 9), (9, 7), (5, 5)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 3: 3, 7: 3, 9: 3}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


@pytest.mark.parametrize("params", [JaccardParams(), JaccardParams(pair_limit=2, block=16)])
def test_jaccard_join_is_brute_force(spark, sf, params):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.id: (r.n_shingles, r.component_id) for r in similar_groups(docs, params=params).collect()}
    assert got == jaccard_groups(rows)


def test_chance_tokens_join_no_groups(spark, monkeypatch):
    """Texts that share a few phrases with a few others each are not compared, those that are near are."""
    rng = np.random.default_rng(6)
    texts = [[f"d{i}w{k}" for k in range(300)] for i in range(120)]
    for f in range(300):
        for i in rng.choice(120, 4, replace=False):
            k = 10 * int(rng.integers(29))
            texts[i][k : k + 5] = [f"f{f}x{j}" for j in range(5)]
    texts += [[*t[:290], *(f"n{i}w{k}" for k in range(10))] for i, t in enumerate(texts[:3])]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    placed = []
    monkeypatch.setattr(ngram_join, "_texts", lambda known, nodes, cells, *a, f=ngram_join._texts: (placed.append(cells.count()), f(known, nodes, cells, *a))[1])
    found = similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), params=JaccardParams(pair_limit=2, block=16)).collect()
    assert {r.id: (r.n_shingles, r.component_id) for r in found} == jaccard_groups(rows)
    assert sum(r.id != r.component_id for r in found) == 3
    assert placed[0] < 40  # 704 when they joined groups


def test_nodes_with_few_frequent_tokens_meet_by_size(spark):
    """The same pairs as when all holders of a token meet, whatever the classes of size."""
    rng = np.random.default_rng(7)
    p = JaccardParams()
    size = {i: int(x) for i, x in enumerate([*rng.integers(1, 40, 60), *rng.integers(80, 260, 120), *rng.integers(1000, 1300, 60)])}
    held = {i: sorted({int(x) for x in rng.integers(0, 12, int(rng.integers(1, 12)))}) for i in size}
    tokens = spark.createDataFrame([(t, i, size[i], 0, True) for i, ts in held.items() for t in ts], "key long, node long, n long, ord byte, often boolean")
    frequent = ngram_join._frequent(tokens, p)
    few = {r.node for r in frequent.collect() if r.few}
    want = set()
    for a in size:
        for b in range(a + 1, len(size)):
            s, (lo, hi) = len({*held[a]} & {*held[b]}), sorted((size[a], size[b]))
            if s and (a in few or b in few) and 100 * lo >= 80 * hi and (s + (80 * hi + 99) // 100 - 1) * 180 >= (lo + hi) * 80:
                want.add((a, b, size[a], size[b]))
    got = [tuple(r) for r in ngram_join._few_pairs(frequent, p).collect()]
    assert len(got) == len(want) > 20 and set(got) == want
    assert 0 < len(few) < len(size)


def test_jaccard_texts_are_not_shuffled_to_their_cells(spark):
    known = spark.createDataFrame([(i, f"t{i}") for i in (1, 2, 2, 3)], "id long, text string")
    nodes = spark.createDataFrame([(10 * i, i, 5) for i in (1, 2, 3)], "node long, id long, n long")
    block = "struct<band:long,block:long>"
    cells = spark.createDataFrame([(n, g, (0, 0), (0, g), 0) for n in (10, 20) for g in (1, 2)], f"node long, grp long, lo {block}, hi {block}, side int")
    want = [(n, g, f"t{n // 10}") for n in (10, 20) for g in (1, 2)]
    once = ngram_join._texts(known.distinct().localCheckpoint(), nodes, cells, False, JaccardParams())
    assert "Exchange hashpartitioning" not in once._jdf.queryExecution().executedPlan().toString()
    for limit in (0, 100):
        for rows, repeated in ((known.distinct(), False), (known, True)):
            got = ngram_join._texts(rows, nodes, cells, repeated, JaccardParams(broadcast_cells=limit))
            assert sorted((r.node, r.grp, r.text) for r in got.collect()) == want


def test_jaccard_join_edges(spark):
    base = [f"w{i}" for i in range(60)]
    near = base[:58] + ["x", "y"]
    rows = [(1, None), (2, ""), (3, " \t "), (4, "a B"), (5, "A b"), (6, " ".join(base)), (7, " ".join(near)), (7, " ".join(near)), (None, "a b"), (8, "  a b")]
    docs = spark.createDataFrame([(*r, "clash", 5) for r in rows], "doc_id long, text string, node string, n int")
    found = similar_groups(docs).collect()
    got = Counter((r.id, r.n_shingles, r.component_id) for r in found)
    want = jaccard_groups([r for r in rows if r[0] is not None])
    assert got == Counter([(i, *want[i]) if i is not None else (None, None, None) for i, _ in rows])
    assert similar_groups(docs.limit(0)).count() == 0
    # Different texts under one id: the largest counts.
    twice = spark.createDataFrame([(1, "a b"), (1, "a c"), (2, "a c")], "doc_id long, text string")
    assert sorted((r.id, r.component_id) for r in similar_groups(twice).collect()) == [(1, 1), (1, 1), (2, 1)]


def cosine_groups(rows):
    by, groups, links = {}, Groups(), Counter()
    for r in rows:
        groups.find(r.vec_id)
        v = r.embedding
        if r.label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            by.setdefault((r.label, len(v)), []).append(r)
    for group in by.values():
        x = np.array([r.embedding for r in group], float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        s = x @ x.T
        np.fill_diagonal(s, -1)
        for i, j in zip(*np.nonzero(s >= 0.93), strict=True):
            links[group[i].vec_id] += 1
            groups.join(group[i].vec_id, group[j].vec_id)
    return {i: (links[i], groups.find(i), i == groups.find(i)) for i in groups.top}


@pytest.mark.parametrize("block", [1024, 40])
def test_cover_tree_is_brute_force(spark, sf, block):
    rng = np.random.default_rng(3)
    center = rng.normal(size=16)
    many = [(1000 + i, (center + rng.normal(size=16) * s).astype("float32").tolist(), int(i % 2)) for i, s in enumerate(np.linspace(0, 0.6, 150))]
    odd = [(1, None, 1), (2, [0.0] * 16, 1), (3, [1.0, None], 1), (4, [1.0, 2.0], 1), (5, [1.0, 2.1], 1), (6, many[0][1], None), (7, [], 1), (8, [float("nan")] * 16, 0), (9, many[0][1], 0), (10, [float("inf")] * 16, 0)]
    rows = spark.createDataFrame(many + odd, "vec_id long, embedding array<float>, label int").withColumn("point", F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(rows, CosineParams(block=block)).collect()}
    assert got == cosine_groups(rows.collect())
    assert near_duplicates(rows.limit(0)).count() == 0


def test_levels_are_nested_and_cover():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 3))
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree = CoverTree(x)
    radius, above = np.pi, {0}
    for begin, center in tree.levels[1:]:
        radius /= 2
        assert above <= set(center.tolist()) and begin[-1] == 200
        above = set(center.tolist())
    found = set()
    for a, b, c, d in near_pairs(tree, tree, True, CosineParams()):
        for i, j, k, m in zip(a, b, c, d, strict=True):
            for p in tree.order[i:j]:
                found |= {(min(p, q), max(p, q)) for q in tree.order[k:m]}
    # Points below one node are never split off without being compared.
    s = x @ x.T
    assert found == {(i, j) for i, j in zip(*np.nonzero(s >= 0.93), strict=True) if i < j}


@pytest.mark.parametrize("params", [KnnParams(), KnnParams(k=7, queries=4, block=50)])
def test_top_k_is_brute_force(spark, sf, params):
    odd = [(10**7, None), (10**7 + 20, [1.0, None]), (10**7 + 40, [1.0, 2.0]), (10**7 + 5, [1.0, 2.1]), (10**7 + 60, []), (10**7 + 3, [3.0, 2.1]), (None, [1.0, 1.0])]
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").limit(150)
    rows = rows.union(rows.where("vec_id % 9 = 0").select(F.col("vec_id") + 5000, "embedding")).union(spark.createDataFrame(odd, "vec_id long, embedding array<float>"))
    good = [r for r in rows.collect() if r.vec_id is not None and r.embedding and all(x is not None for x in r.embedding)]
    want = set()
    for q in (r for r in good if r.vec_id % 20 == 0):
        other = [r for r in good if r.vec_id != q.vec_id and len(r.embedding) == len(q.embedding)]
        score = [int(np.floor(64 * np.array(r.embedding, float)) @ np.floor(64 * np.array(q.embedding, float))) for r in other]
        best = sorted(zip([-s for s in score], [r.vec_id for r in other], strict=True))[: params.k]
        want |= {(q.vec_id, k + 1, v, -s) for k, (s, v) in enumerate(best)}
    got = [tuple(r) for r in top_k(rows, F.col("vec_id") % 20 == 0, params).collect()]
    assert len(got) == len(want) and set(got) == want
    assert top_k(rows.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_queries_have_their_columns(spark, sf):
    assert queries.QUERIES["op6_ngram_jaccard_join"](spark, sf).columns[0] == "doc_id"
    got = queries.QUERIES["op1_cover_tree_near_dedup"](spark, sf)
    assert got.columns[:4] == ["vec_id", "n_links", "component_id", "kept"] and got.count() == spark.read.parquet(f"{sf}/embeddings.parquet").count()
