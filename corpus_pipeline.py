"""A training corpus from raw documents, stage by stage."""

from __future__ import annotations

import os
import sys
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidegrid.llm import bpe, language, mixing, ngram_join, suffix_dedup  # noqa: E402
from tidegrid.session import shared_folder  # noqa: E402

#: A document stays if one language holds at least this share of its letters.
LEAST_SHARE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in which no language holds half of the letters, go."""
    model = language.learn_from_documents(docs)
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("_row"), "text")
    found = language.identify(packed, model, keep=("_row",), with_text=True)
    found = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE))
    return found.select("_row.*", "text").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays, that with the smallest id; rows without an id stay."""
    found = ngram_join.similar_groups(docs).where("id <> component_id").select(F.col("id").alias("doc_id"))
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes and more that occur earlier are cut out; documents stay, some of them empty."""
    named = docs.where("doc_id is not null")
    cut = suffix_dedup.remove_repeats(named).dropDuplicates(["id"]).select(F.col("id").alias("doc_id"), F.col("kept_text").alias("text"))
    out = named.drop("text").join(cut, "doc_id").withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)
    return out.unionByName(docs.where("doc_id is null"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each time that the mix takes a document, in the random order of its shard; a document taken in part is cut."""
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_chars"))).alias("others")
    plan = mixing.plan_mix(docs.select("doc_id", "source", "text", mixing.word_count("text").alias("size"), others))
    taken = mixing.shuffled(plan)
    whole = F.col("words") == F.col("size")
    text = F.when(whole, F.col("text")).otherwise(mixing.first_words("text", F.col("words").cast("int")))
    taken = taken.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long"))
    return taken.select("others.*", "text", "n_chars").select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text; columns of the same names give way."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN).learn_dictionary(docs)
    kept = [c for c in docs.columns if c not in ("text", "n_tokens", "ids", "decodes")]
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept), digest.alias("_sha256")).alias("_row"), "text")
    coded = encoder.encode(packed, keep=("_row",))
    decodes = F.sha2("decoded", 256) == F.col("_row._sha256")
    return coded.select(*(F.col(f"_row.`{c}`") for c in kept), (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", decodes.alias("decodes"))


STAGES = [
    ("language", known_language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixing", mixed),
    ("tokens", encoded),
]

#: No stage can be said in SQL as a whole; the tests hold near duplicates against a brute-force version, of the other stages only some properties.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is a table in the shared folder, which the next one reads."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
