"""The registered query of each operator, and SQL equivalents where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import bpe, collocations, conversation_repair, cover_tree, html_main_text, knn_join, language, mixing, ngram_join, suffix_dedup, token_files, trie_bpe, url_filter
from tidegrid.session import cut_lineage, shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_cover_tree_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_main_text.main_text(_table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN).learn_dictionary(docs)
    coded = encoder.encode(docs)
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_join.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    sizes = cut_lineage(docs.select("doc_id", "source", mixing.word_count("text").alias("size")))
    mix = mixing.plan_mix(sizes)
    shards = F.transform("placements", lambda d: d["shard"])
    return mix.select("doc_id", "size", "source_size", "target", mixing.taken_words().alias("taken"), shards.alias("shards"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.similar_groups(_table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return cut.select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.learn_from_documents(docs)
    marked = docs.withColumn("held_out", language.held_out())
    return language.identify(marked, model, keep=("doc_id", "held_out")).select("doc_id", "held_out", "lang_pred", "score")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as definition:
        token_files.write_files(_table(spark, sf_dir, "documents"), path, definition.read(), params=token_files.FileParams(added_tokens=True))
    read = token_files.read_files(spark, path)
    return read.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as read:
        definition = read.read()
    coded = trie_bpe.encode(_table(spark, sf_dir, "documents"), definition)
    decoded = trie_bpe.decode(coded, definition, keep=("doc_id", "ids"))
    return decoded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations.graph(_table(spark, sf_dir, "documents"))
    return collocations.collocations(found).withColumnRenamed("group", "lang")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversation_repair.damage(_table(spark, sf_dir, "conversations"))
    return conversation_repair.repair(damaged, absent="absent").report


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_cover_tree_near_dedup,
        op2_html_main_text,
        op3_byte_bpe,
        op4_voronoi_knn,
        op5_source_mixing,
        op6_ngram_jaccard_join,
        op7_url_filter,
        op8_suffix_dedup,
        op9_language_id,
        op10_token_files,
        op11_trie_bpe,
        op12_collocations,
        op13_conversation_repair,
    )
}
_VECTORS = """v as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings where vec_id is not null
  and embedding is not null and len(embedding) > 0 and not list_contains(list_transform(embedding, lambda x: x is null or not isfinite(x)), true))"""
_REACH = """reach as (select i, i as r from node union select reach.i, link.b from reach join link on reach.r = link.a),
  comp as (select i, min(r) as component_id from reach group by i)"""

ORACLE: dict[str, str] = {
    "op1_cover_tree_near_dedup": f"""with recursive {_VECTORS}, node as (select vec_id as i from embeddings),
  u as (select * from v where label is not null and list_dot_product(e, e) > 0),
  link as (select x.vec_id as a, y.vec_id as b from u x join u y on x.label = y.label and len(x.e) = len(y.e) and x.vec_id <> y.vec_id
    where list_cosine_similarity(x.e, y.e) >= 0.93), {_REACH}, n as (select a, count(*) as n_links from link group by a)
  select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept from embeddings join comp on vec_id = i left join n on vec_id = a""",
    "op4_voronoi_knn": f"""with {_VECTORS}, w as (select vec_id, list_transform(e, lambda x: floor(64 * x)) as e from v),
  s as (select q.vec_id as query_id, d.vec_id, cast(list_dot_product(q.e, d.e) as bigint) as score from w q join w d on q.vec_id <> d.vec_id and len(q.e) = len(d.e)
    where q.vec_id % 20 = 0), r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
  select query_id, rank, vec_id, score from r where rank <= 20""",
    "op6_ngram_jaccard_join": f"""with recursive node as (select doc_id as i from documents),
  w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from documents),
  g as (select doc_id, case when len(ws) >= 5 then list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end as gs from w),
  t as (select doc_id, len(gs) as n, unnest(gs) as t from g), many as (select t from t group by t having count(*) > 1),
  m as (select x.doc_id as a, y.doc_id as b, any_value(x.n) as na, any_value(y.n) as nb, count(*) as c from t x join many using (t) join t y using (t) where x.doc_id <> y.doc_id group by x.doc_id, y.doc_id),
  link as (select a, b from m where 100 * c >= 80 * (na + nb - c)), {_REACH}
  select doc_id, len(gs) as n_shingles, component_id from g join comp on doc_id = i""",
    "op12_collocations": """with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
  w as (select lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') as ws from p),
  t as (select lang, sum(len(ws)) as n from w group by lang),
  g as (select lang, unnest(flatten(list_transform(range(1, 6), lambda k: list_transform(range(1, len(ws) - k + 2), lambda i: ws[i : i + k - 1])))) as g from w),
  f as (select lang, g, count(*) as a from g group by lang, g having count(*) >= 100),
  longer as (select lang, g[: len(g) - 1] as g, a from f where len(g) > 2 union select lang, g[2 :], a from f where len(g) > 2),
  kept as (select * from f where len(g) > 1 and not exists (select 1 from longer where longer.lang = f.lang and longer.g = f.g and longer.a = f.a)),
  cut as (select lang, g, a, unnest(range(1, len(g))) as k from kept),
  s as (select cut.lang, cut.g, cut.a, k, x.a as l, y.a as r, t.n, (1000::hugeint * cut.a * t.n) // (x.a::hugeint * y.a) as score
    from cut join t using (lang) join f x on x.lang = cut.lang and x.g = cut.g[: k] join f y on y.lang = cut.lang and y.g = cut.g[k + 1 :]),
  low as (select *, row_number() over (partition by lang, g order by score, k) as c from s),
  r as (select lang, array_to_string(g, ' ') as phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score from low where c = 1),
  o as (select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from r)
  select * from o where rank <= 2000""",
    "op13_conversation_repair": """with recursive k as (select *, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as key from conversations),
  c as (select *, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i, 1))::bigint)),
    lambda h, b: list_reduce([xor(h, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * 3988292384))), 4294967295) % 20 as fate from k),
  d as (select conv_id, turn, case when fate = 4 then 'user' else coalesce(role, ' ') end as role,
    case fate when 1 then '' when 2 then regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') else coalesce(text, ' ') end as text, unnest(range(case when fate = 3 then 2 else 1 end)) as copy from c where fate <> 0),
  o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos, role[1] as i from d),
  b as (select *, not regexp_matches(text, '[^\\x20\\x09-\\x0D]') as blank, row_number() over (partition by conv_id, role, text order by pos) > 1 as again,
    lag(i) over (partition by conv_id order by pos) as before from o),
  f as (select *, not blank and again as dup, not blank and not again and not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') as cut, blank or again as gone from b),
  g as (select conv_id, max(pos) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (dup) as duplicate,
    count(*) filter (cut) as truncated, count(*) filter (pos > 1 and before || i not in ('su', 'ua', 'au')) as illegal from f group by conv_id),
  ids as (select distinct conv_id from conversations),
  v as (select conv_id, 0::bigint as pos, {c: 0::bigint, a: '', t: ''} as s0, {c: 1000000::bigint, a: '', t: ''} as s1, {c: 3::bigint, a: 'I', t: chr(10) || 'user:'} as s2,
      {c: 6::bigint, a: 'II', t: chr(10) || 'user:' || chr(10) || 'assistant:'} as s3 from ids
    union all select conv_id, pos, r0, r1, u, least(r3, {c: u.c + 3, a: u.a || 'I', t: u.t || chr(10) || 'assistant:'}) from (
      select *, least(r2, {c: r0.c + 3, a: r0.a || 'I', t: r0.t || chr(10) || 'user:'}, {c: r1.c + 3, a: r1.a || 'I', t: r1.t || chr(10) || 'user:'}, {c: r3.c + 3, a: r3.a || 'I', t: r3.t || chr(10) || 'user:'}) as u from (
      select v.conv_id, f.pos, {c: s0.c + 4, a: s0.a || 'D', t: s0.t} as r0, least({c: s1.c + 4, a: s1.a || 'D', t: s1.t}, {c: s0.c + x + if(i = 's', 0, 1000000), a: s0.a || 'K', t: s0.t || own}) as r1,
        least({c: s2.c + 4, a: s2.a || 'D', t: s2.t}, {c: s0.c + x + if(i = 'u', 0, 1000000), a: s0.a || 'K', t: s0.t || own}, {c: s1.c + x + if(i = 'u', 0, 1000000), a: s1.a || 'K', t: s1.t || own},
          {c: s3.c + x + if(i = 'u', 0, 1000000), a: s3.a || 'K', t: s3.t || own}, {c: s0.c + x + 3, a: s0.a || 'R', t: s0.t || chr(10) || 'user:' || text},
          {c: s1.c + x + 3, a: s1.a || 'R', t: s1.t || chr(10) || 'user:' || text}, {c: s3.c + x + 3, a: s3.a || 'R', t: s3.t || chr(10) || 'user:' || text}) as r2,
        least({c: s3.c + 4, a: s3.a || 'D', t: s3.t}, {c: s2.c + x + if(i = 'a', 0, 1000000), a: s2.a || 'K', t: s2.t || own}, {c: s2.c + x + 3, a: s2.a || 'R', t: s2.t || chr(10) || 'assistant:' || text}) as r3
      from v join (select *, case when gone then 1000000 when cut then 3 else 0 end::bigint as x, chr(10) || role || ':' || text as own from f) f on v.conv_id is not distinct from f.conv_id and f.pos = v.pos + 1))),
  e as (select ids.conv_id, coalesce(n, 0) as n, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal
    from ids left join g on ids.conv_id is not distinct from g.conv_id),
  l as (select e.*, least(s0, s3) as best from e join v on e.conv_id is not distinct from v.conv_id and e.n = v.pos)
  select conv_id, gaps, blank, duplicate, truncated, illegal, best.c as cost, best.a as audit, sha256(substr(best.t, 2)) as repaired_sha256 from l""",
}
