"""Text operators against libraries, brute force and round trips; the pipeline stage by stage."""

from __future__ import annotations

import hashlib
import os
import time
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from llm.test_pairs import jaccard_groups
from tidegrid.llm import bpe, html_main_text, language, mixing, queries, suffix_dedup, token_files, url_filter

ODD = [None, "", "  ", "a  b\n\n c\t d  ", "x" * 300 + "ab" * 200, "日本語 \U0001f600 don't'll 12½³ ��  \n", "<|endoftext|> a\x1c b"]


def odd_docs(spark):
    rows = [(i, t, "en", "s", "clash") for i, t in enumerate(ODD)] + [(None, "no id", None, None, None), (3, ODD[3], "en", "s", "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, ids string")


def test_bpe_is_the_library(spark, sf):
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = odd_docs(spark).select("doc_id", "text").unionByName(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60))
    plain = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    learned = bpe.Encoder(ranks, public_tokenizers.PATTERN, dictionary_words=50).learn_dictionary(docs)
    for encoder in (plain, learned):
        got = sorted((r.text or "", np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in encoder.encode(docs, keep=("doc_id",)).join(docs, "doc_id").distinct().where("doc_id >= 100").collect())
        assert all(ids == library.encode_ordinary(t) and raw == t.encode() for t, ids, raw in got)
        few = encoder.encode(odd_docs(spark).withColumn("key", F.col("text")), keep=("key",)).collect()
        assert all(np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(r.key or "") and bytes(r.decoded) == (r.key or "").encode() for r in few)
        assert len(few) == len(ODD) + 2
    assert plain.encode(docs.limit(0)).count() == 0


def test_bpe_ranks_are_not_in_the_plan(spark):
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pick = np.random.default_rng(3)
    texts = ["".join(pick.choice(list("aaabnéß語 \n"), n)) for n in (1, 2, 7, 60, 900)] + ["aéb" * 9000, "語" * 5000, "a" * 20000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    # Three words are remembered at most, beside the dictionary.
    coded = bpe.Encoder(ranks, public_tokenizers.PATTERN, dictionary_words=2, remembered=3).learn_dictionary(docs).encode(docs)
    assert len(coded._jdf.queryExecution().optimizedPlan().toString()) < 20000
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in coded.collect()} == {i: library.encode_ordinary(t) for i, t in enumerate(texts)}
    assert all(bytes(r.decoded) == texts[r.doc_id].encode() for r in coded.collect())


def test_tables_leave_no_shuffle_files(spark):
    from tidegrid.session import DROP_SHUFFLES, cut_lineage

    def files():
        return sum("shuffle_" in f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))

    def left(rows):
        before = files()
        out = cut_lineage(rows)
        for _ in range(50):  # they go in the background
            if files() <= before:
                break
            time.sleep(0.1)
        return out, files() - before

    rows = spark.range(1000).selectExpr("id", "id % 7 as k").repartition(3, "k")
    (out, more), held = left(rows), spark.conf.get(DROP_SHUFFLES, None)
    assert more <= 0 and out.count() == 1000 and held is None
    assert rows.count() == rows.count() == 1000  # the rows can still be made again
    out, more = left(suffix_dedup.remove_repeats(odd_docs(spark).drop("ids")))
    assert more <= 0 and out.count() == len(ODD) + 2


def test_token_files_come_back(spark, tmp_path):
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        definition = f.read()
    library = Tokenizer.from_str(definition)
    library.encode_special_tokens = True
    docs = odd_docs(spark)
    params = token_files.FileParams(shard_bytes=64, partition_bytes=256, least=2)
    token_files.write_files(docs, str(tmp_path / "f"), definition, params=params)
    got = [(r.id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in token_files.read_files(spark, str(tmp_path / "f")).collect()]
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()))
    want, at = [], 0
    for named, i, text in rows:
        ids = library.encode(text, add_special_tokens=False).ids + [0]
        want.append((i if named else None, at, ids))
        at += len(ids)
    key = lambda r: (r[1], str(r))
    assert sorted(got, key=key) == sorted(want, key=key)
    token_files.write_files(docs.limit(0), str(tmp_path / "none"), definition)
    assert token_files.read_files(spark, str(tmp_path / "none")).count() == 0


def test_token_files_hold_added_tokens_like_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["foo bar<|endoftext|> baz", "<|endoftext|>", "a  <|endoftext|>  <|endoftext|><|endoftext|>\nb c", "no token <|endoftext", *[t or "" for t in ODD]]
    os.mkdir(tmp_path / "sf")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    got = queries.QUERIES["op10_token_files"](spark, str(tmp_path / "sf")).orderBy("doc_id").collect()
    want = [[*library.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert want[0] == [21943, 2318, 50256, 275, 1031, 0]
    assert [(r.n_tokens, r.ids_crc32) for r in got] == [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in want]
    assert [r.start for r in got] == [sum(map(len, want[:k])) for k in range(len(want))]


def test_token_files_are_read_back_without_a_shuffle_of_files(spark, tmp_path):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        token_files.write_files(odd_docs(spark), str(tmp_path / "f"), f.read(), params=token_files.FileParams(shard_bytes=64, partition_bytes=256))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = token_files.read_files(spark, str(tmp_path / "f"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_words_are_encoded_once_whatever_mark_or_line_end_follows():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        definition = f.read()
    words = token_files._Words(definition, 1 << 10, True)
    seen = []
    together = words._encoded
    words._encoded = lambda texts: seen.extend(texts.to_pylist()) or together(texts)
    texts = ["foo bar, bar. bar; bar\nfoo. bar!\nfoo", "x bar? bar..", "3.14 it's\n\nfoo\n bar \n", "foo bar\n", "\nfoo"]
    ids, sizes = words.encode(pa.array(texts))
    want = [words.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    assert len(seen) == len(set(seen)) and seen.count(b" bar") == 1 and not any(x.startswith(b" bar") and x[4:5] in b",.;!?" for x in seen if len(x) > 4)


def test_pairing_round_trip_and_random_access():
    rng = np.random.default_rng(0)
    for _ in range(100):
        ids = rng.integers(0, 3, int(rng.integers(1, 80)))
        cuts = np.unique(rng.integers(1, len(ids) + 1, 4))
        sizes = np.diff(np.concatenate(([0], cuts[cuts < len(ids)], [len(ids)])))
        file = token_files.TokenFile(token_files.file_of(ids, sizes, np.arange(len(sizes)), np.ones(len(sizes), bool), 10, token_files.FileParams(least=2, pairs=4, rounds=5)))
        assert file.all_ids().tolist() == ids.tolist()
        ends = np.cumsum(sizes)
        for k, (a, b) in enumerate(zip(ends - sizes, ends, strict=True)):
            assert file.document(k).tolist() == ids[a:b].tolist() == [file.token(k, n) for n in range(b - a)]
    assert len(file.left) > 0


@pytest.mark.parametrize("part", [4096, 3])
def test_suffix_dedup_is_brute_force(spark, sf, part):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(120)
    more = [(10**6, None), (10**6 + 1, "ab" * 150), (10**6 + 2, "x" * 99), (10**6 + 3, "x" * 250), (None, "ab" * 120), (10**6 + 4, "é" * 120), (10**6 + 5, "z" + "é" * 120)]
    docs = docs.union(spark.createDataFrame(more, "doc_id long, text string"))
    rows = sorted((r.doc_id, (r.text or "").encode()) for r in docs.collect() if r.doc_id is not None)
    seen, want = set(), {None: (240, 0, 0, b"ab" * 120)}
    for i, raw in rows:
        keep = bytearray(b"\1" * len(raw))
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                keep[k : k + 100] = bytes(100)
            seen.add(raw[k : k + 100])
        runs = sum(1 for k in range(len(raw)) if not keep[k] and (k == 0 or keep[k - 1]))
        want[i] = (len(raw), keep.count(0), runs, bytes(b for b, k in zip(raw, keep, strict=True) if k))
    found = suffix_dedup.remove_repeats(docs.withColumn("spots", F.lit(1)), params=suffix_dedup.DedupParams(part=part))
    assert {r.id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in found.collect()} == want
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_suffix_dedup_spreads_one_long_run(spark):
    import pyarrow as pa

    n, p = 20_000, suffix_dedup.DedupParams(part=1000)
    key, spot, parts = [7] * n, [(k << 16) | (0 << 8) | 0 for k in range(n)], [n // p.part] * n
    spots = pa.StructArray.from_arrays([pa.array(key), pa.array(spot), pa.array(parts)], ["key", "spot", "parts"])
    lists = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), spots)
    batch = pa.RecordBatch.from_arrays([pa.array([5]), pa.array([" " * (n + 99)]), lists], ["id", "text", "spots"])
    part = np.concatenate([np.asarray(b.column("part")) for b in suffix_dedup._contexts(p)([batch])])
    assert len(part) == n and np.bincount(part).max() < 1.5 * p.part
    docs = spark.createDataFrame([(1, "-" * n), (2, "ab" * 2000 + "-" * 150)], "doc_id long, text string")
    got = {r.id: (r.n_removed, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs, params=p).collect()}
    assert got == {1: (n - 1, b"-"), 2: (4148, b"ab")}


def test_suffix_dedup_repeated_ids(spark):
    same = "".join(f"{i}," for i in range(1000, 1036))
    docs = spark.createDataFrame([(1, same), (1, same), (2, same), (3, "short"), (3, "long text")], "doc_id long, text string")
    got = sorted((r.id, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == [(1, 180, 0), (1, 180, 0), (2, 180, 180), (3, 5, 0), (3, 5, 0)]


def test_language_held_out_and_mixed_text(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.learn_from_documents(docs)
    marked = docs.withColumn("held_out", language.held_out())
    found = language.identify(marked, model, keep=("lang", "held_out")).where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.97
    assert {r.doc_id for r in marked.where("held_out").collect()} == {r.doc_id for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    long = {r.lang: r.text for r in docs.where("length(text) between 800 and 3000").collect()}
    some = spark.createDataFrame([(0, long["en"] + " " + long["de"]), (1, None), (2, "12 !?"), (3, "")], "k int, text string")
    got = {r.k: r for r in language.identify(some, model, keep=("k",)).collect()}
    assert {s.lang for s in got[0].spans} >= {"en", "de"} and 0 < got[0].score < 1
    assert all((got[k].lang_pred, got[k].score, got[k].spans) == ("und", 0.0, []) for k in (1, 2, 3))
    nothing = language.learn(docs.limit(0).select("text", "lang"))
    assert {r.lang_pred for r in language.identify(some, nothing, keep=("k",)).collect()} == {"und"}


def test_language_copies_do_not_starve_the_sample(spark):
    texts = [f"{a} {b}" for a in ("alpha", "beta", "gamma", "delta") for b in ("eins", "zwei", "drei", "vier", "acht")]
    once = spark.createDataFrame([(t, "xx") for t in texts] + [("solo", "yy")], "text string, lang string")
    copies = once.unionByName(spark.range(20_000).select(F.lit("copied words").alias("text"), F.lit("xx").alias("lang")))
    params = language.LanguageParams(sample_rows=50)
    want = language.learn(once.unionByName(spark.createDataFrame([("copied words", "xx")], once.schema)), params)
    got = language.learn(copies, params)
    assert got.languages == want.languages == ["xx", "yy"]
    np.testing.assert_array_equal(got.table, want.table)


def test_best_path_is_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(50):
        length = rng.integers(0, 6, 3)
        score = rng.normal(size=(int(length.sum()), 3)) * 3
        path = language.best_paths(score, length, 2.0)
        at = 0
        for n in length:
            def worth(p, a=at):
                return sum(score[a + k, x] for k, x in enumerate(p)) - 2.0 * sum(x != y for x, y in zip(p, p[1:], strict=False))
            best = max((worth(p) for p in np.ndindex(*[3] * n)), default=0)
            assert worth(tuple(path[at : at + n])) == pytest.approx(best)
            at += n


def test_mixing_meets_targets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, None), (10**6 + 1, "a b c", None), (None, "a b", "src1"), (10**6 + 2, "", "zz")], "doc_id long, text string, source string")
    sizes = docs.select("doc_id", "text", "source").unionByName(odd).select("doc_id", "source", mixing.word_count("text").alias("size"), F.lit(1).alias("block"), F.lit(2).alias("target"))
    params = mixing.MixParams(block_words=200, blocks_per_shard=8)
    mix = mixing.plan_mix(sizes, params)
    rows = mix.withColumn("taken", mixing.taken_words()).collect()
    size, taken, target = {}, {}, {}
    for r in rows:
        size[r.source] = size.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert r.taken <= 2 * r["size"] and r.block == 1
    assert len(rows) == sizes.count() and all(r.source_size == size[r.source] for r in rows)
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want, left, full = dict.fromkeys(names, 0.0), 1.5 * sum(size.values()), set()
    while left > 1e-6:
        open_weight = sum(weight[s] for s in names if s not in full)
        share, left = left / open_weight, 0.0
        for s in [s for s in names if s not in full]:
            want[s] += share * weight[s]
            if want[s] >= 2 * size[s]:
                left += want[s] - 2 * size[s]
                want[s] = 2 * size[s]
                full.add(s)
    assert target == pytest.approx(want)
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in names)
    again = {(r.doc_id, r["size"]): r.taken for r in mixing.plan_mix(sizes.repartition(3), params).withColumn("taken", mixing.taken_words()).collect()}
    assert again == {(r.doc_id, r["size"]): r.taken for r in rows}
    placed = mixing.shuffled(mix, params).collect()
    assert len({(r.shard, r.position) for r in placed}) == len(placed) and sum(r.words for r in placed) == sum(taken.values())
    assert mixing.plan_mix(sizes.limit(0)).count() == 0
    assert spark.range(1).select(mixing.first_words(F.lit(" a\tb  c "), F.lit(2)).alias("x")).first().x == " a\tb"


def test_url_parts_and_rules(spark):
    cases = {
        "http://A.Example.NET/en/25?x#y": ("a.example.net", "/en/25", "example.net/en/", "allow"),
        "https://example.com/de/1": ("example.com", "/de/1", "example.com/de/", "block"),
        "http://x.net/": ("x.net", "/", "net/", "block"),
        "http://x.net": ("x.net", "", None, None),
        "ftp://notexample.com/de/": ("notexample.com", "/de/", None, None),
        "http://w.org/fr/a": ("w.org", "/fr/a", "org/fr/", "allow"),
        "http://w.org?fr/a": ("w.org", "", None, None),
        "no scheme": ("", "", None, None),
        None: ("", "", None, None),
        "http://www.cheap-pills.example.com/en/4": ("www.cheap-pills.example.com", "/en/4", None, "block"),
        "http://www.ththre.example.com/en/4": ("www.ththre.example.com", "/en/4", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(cases)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    for i, want in enumerate(cases.values()):
        r = got[i]
        assert (r.host, r.path, r.rule) == want[:3]
        assert r.verdict == want[3] if want[3] else r.verdict in ("allow", "block")
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_url_weights_are_those_of_plain_descent(spark):
    p = url_filter.UrlParams(features=64, steps=30)
    labelled = url_filter.labelled_urls(spark)
    rows = labelled.withColumn("f", url_filter.features(F.col("host"), F.col("path"), p)).orderBy("number").collect()
    x = np.zeros((len(rows), 65))
    for k, r in enumerate(rows):
        np.add.at(x[k], r.f, 1 / np.sqrt(len(r.f)))
    x[:, 64] = 1
    y, w = np.array([r.y for r in rows]), np.zeros(65)
    for _ in range(p.steps):
        w = w * (1 - p.rate * p.decay) + x.T @ (y - 1 / (1 + np.exp(-x @ w))) * p.rate / len(y)
    np.testing.assert_allclose(url_filter.train(labelled, p), w, atol=1e-9)


def page(article: str, extra: str = "") -> str:
    return f"<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><a>menu</a></nav>{extra}{article}<footer>&copy; x</footer></body></html>"


def test_main_text(spark):
    tail = "<div><span>Follow the site</span></div>"
    rows = [(i, f"http://h.org/{i}", page(f"<article><h1>T{i}</h1><p>one &amp; {i}<br>two<p>same words</p>{tail}</article>", "<div class='box'>Open all days</div>")) for i in range(4)]
    rows += [(10 + i, f"http://k.org/{i}", page("<article><p>copied</p></article>")) for i in range(5)]
    rows += [(20 + i, f"http://m.org/{i}", page(f"<div><p>text {i}</p></div>", "<div>Open all days</div>")) for i in range(3)]
    rows += [(30, None, None), (31, "", ""), (32, "http://n.org/", "a < b <p>x<!-- y -->z"), (33, "http://n.org/", "<p>cut <b>off"), (30, None, None)]
    rows += [(34, "http://n.org/", "<main><p>a</p><div class='comments'><p>b</p></div><form>c</form><aside>d</aside></main><p>e</p>")]
    rows += [(35, "http://n.org/", "<p title='a > b'>x&nbsp;&nbsp;y</p><ul><li>1<li>2</ul>" + "<div>" * 3000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, blocks string")
    got = {}
    for r in html_main_text.main_text(pages).collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert [got[i][0] for i in range(4)] == [f"T{i}\none & {i} two\nsame words" for i in range(4)]
    assert all(got[10 + i] == ["copied"] for i in range(5))
    assert all(got[20 + i] == [f"text {i}"] for i in range(3))
    assert got[30] == ["", ""] and got[31] == [""]
    assert got[32] == ["a < b\nxz"] and got[33] == ["cut off"] and got[34] == ["a"] and got[35] == ["x y\n1\n2"]
    assert html_main_text.main_text(pages.limit(0)).count() == 0


def test_main_text_counts_every_subtree_on_a_large_host(spark):
    notice, box = "<div>Open all days</div>", "<div>Write to us</div>"
    rows = [(i, f"http://h.org/{i}", f"<div><p>text {i}</p></div>" + (notice if i < 3 else "")) for i in range(60)]
    # On pages with an article, and in what the fixed rules drop, the same subtree is evidence too.
    rows += [(100, "http://a.org/", page("<article><p>x</p></article>", box)), (101, "http://a.org/", page("<article><p>y</p></article>", f"<aside>{box}</aside>"))]
    rows += [(102, "http://a.org/", f"<p>z</p>{box}"), (103, "http://b.org/", f"<p>z</p>{box}")]
    found = html_main_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r.page_id: r.text for r in found.collect()}
    assert all(got[i] == f"text {i}" for i in range(60))
    assert [got[100 + k] for k in range(4)] == ["x", "y", "z", "z\nWrite to us"]


def test_main_text_of_given_pages(spark, sf):
    import html as h
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.QUERIES["op2_html_main_text"](spark, sf).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        lines = (" ".join(h.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n".join(x for x in lines if x) and r.n_chars == len(r.text)


def test_queries_digest_what_operators_give(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.QUERIES["op3_byte_bpe"](spark, sf).collect():
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
    files = queries.QUERIES["op10_token_files"](spark, sf).orderBy("doc_id").collect()
    assert [r.doc_id for r in files] == sorted(docs)
    assert all(b.start == a.start + a.n_tokens for a, b in zip(files, files[1:], strict=False))


def test_pipeline_tells_wrong_bytes_of_equal_length(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "hello", "en", "s", 5), (2, "jello", "en", "s", 5), (3, None, "en", "s", None)], "doc_id long, text string, lang string, source string, n_chars long")
    right = bpe.Encoder.encode
    assert all(r.decodes for r in corpus_pipeline.encoded(spark, docs, "").collect())
    monkeypatch.setattr(bpe.Encoder, "encode", lambda *a, **k: right(*a, **k).withColumn("decoded", F.when(F.length("decoded") > 0, F.lit(b"hello")).otherwise(F.col("decoded"))))
    assert {r.doc_id: r.decodes for r in corpus_pipeline.encoded(spark, docs, "").collect()} == {1: True, 2: False, 3: True}


def test_pipeline_stage_by_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(10**6, None, "en", "s", 0), (10**6 + 1, "12 34", None, None, 5), (None, "words without an id in the table", "en", "s", 32)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    known = corpus_pipeline.known_language(spark, docs, sf)
    kept = {r.doc_id for r in known.collect()}
    assert known.columns == docs.columns and {10**6, 10**6 + 1}.isdisjoint(kept) and None in kept and len(kept) > 190
    once = corpus_pipeline.near_duplicates(spark, known, sf)
    rows = {r.doc_id: r.text for r in known.collect()}
    groups = jaccard_groups([(i, t) for i, t in rows.items() if i is not None])
    assert {r.doc_id for r in once.collect()} == {i for i, (_, c) in groups.items() if i == c} | {None}
    cut = corpus_pipeline.repeated_passages(spark, once, sf)
    assert cut.columns == docs.columns and cut.count() == once.count()
    before = {r.doc_id: r.text for r in once.collect()}
    assert all(len(r.text) <= len(before[r.doc_id]) and r.n_chars == len(r.text) for r in cut.collect() if r.doc_id is not None)
    mix = corpus_pipeline.mixed(spark, cut, sf)
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert mix.columns == docs.columns and all(texts[r.doc_id].startswith(r.text) for r in mix.collect())
    coded = corpus_pipeline.encoded(spark, mix, sf).collect()
    assert len(coded) == mix.count() and all(r.decodes for r in coded)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeated_passages", "mixing", "tokens"]


def test_pairing_holds_few_bytes_an_id():
    """Of a shard of four million ids: the arrays of a round are narrow, and stretches of documents come back alone."""
    rng = np.random.default_rng(1)
    ids = (rng.zipf(1.2, 4_000_000) % 50_000).astype("<u4")
    sizes = np.full(8_000, 500)
    ends = np.zeros(len(ids), bool)
    ends[np.cumsum(sizes) - 1] = True
    tracemalloc.start()
    symbols, _, rules = token_files.pair_up(ids, ends, 50_000, token_files.FileParams())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 * len(ids) and len(rules) > 1000 and len(symbols) < len(ids) * 0.7
    file = token_files.TokenFile(token_files.file_of(ids, sizes, np.arange(8_000), np.ones(8_000, bool), 50_000, token_files.FileParams()))
    assert (file.ids_between(2048, 4096) == ids[2048 * 500 : 4096 * 500]).all() and (file.ids_between(7000, 8000) == ids[7000 * 500 :]).all()
