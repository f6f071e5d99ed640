"""Corpus pipeline: five stages over ``documents``, each by one operator of lagloom.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet in the shared folder and read again as the next one's docs.  All but
the last return the columns of documents.  A row is known by doc_id and text: rows without a
doc_id and several texts under one id are documents like others, and repeated
rows end at the near-duplicate stage as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagloom.llm import bpe_transducer, decontaminate, language_id, near_copies, substring_dedup
from lagloom.llm.common import if_few, materialize, scratch
from lagloom.llm.token_counts import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; null texts and texts without a letter go."""
    samples = language_id.learn(docs.select("doc_id", "text", "lang"))
    found = language_id.identify(docs, samples, "_stage_lang", "_stage_score")
    return found.where(F.col("_stage_lang") != language_id.UND).select(*[f"`{c}`" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (5-word shingles, Jaccard 0.8): the smallest doc_id, ids before none, then the hash of the text."""
    rows = near_copies.groups(docs.select("doc_id", "text")).groupBy("group", "doc_id", "text_key").count()
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.col("text_key").alias("key"))
    rows = materialize(rows.select("group", place.alias("row"), "count"), "rows")
    # what goes is marked, and what stays of repeated rows: few rows as a rule
    several = rows.groupBy("group").agg(F.min("row").alias("first"), F.count("*").alias("n"), F.max("count").alias("most")).where("n > 1 or most > 1")
    marked = rows.join(several, "group").withColumn("stays", F.col("row") == F.col("first")).where("NOT stays OR count > 1")
    marked = materialize(marked.select("row.no_id", "row.id", "row.key", "stays"), "marked")
    keys = ["no_id", "id", "key"]
    d = docs.select(*[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(docs.columns)], F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("id"), F.xxhash64(F.col("text").cast("string")).alias("key"))
    out = d.join(if_few(marked), keys, "left_anti")
    repeated = marked.where("stays")
    if not repeated.isEmpty():
        out = out.unionByName(d.join(if_few(repeated), keys, "left_semi").dropDuplicates(keys))
    return out.select(*[F.col(f"_{k}").alias(c) for k, c in enumerate(docs.columns)])


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without words of repeated passages; those with no word left go, and n_chars follows the text."""
    out = substring_dedup.remove_repeats(docs, rewrite=True).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item of ``SHORTEST`` words or more; a text is named by its hash, as doc_id may be null or have several texts."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    key = F.xxhash64(F.col("text").cast("string"))
    leaks = materialize(decontaminate.overlaps(docs.select(key.alias("doc_id"), "text"), benchmark).where(F.col("item_words") >= decontaminate.SHORTEST).select(F.col("doc_id").alias("_leak")).distinct(), "leaks")
    return docs.join(if_few(leaks), key == F.col("_leak"), "left_anti").select(*[f"`{c}`" for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of what they decode to; with small tables, as other stages share the workers."""
    return bpe_transducer.round_trip(docs, tokenizer_path("word_bpe_49k.json"), words=100_000, pieces=40_000)


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeats),
    ("benchmark decontamination", benchmark_leaks),
    ("BPE encoding and decoding", tokens),
]

#: SQL can express neither the learned, the iterative nor the tokenizer stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(spark):  # a stage's own tables go once its rows are written
            docs = materialize(stage(spark, docs, sf_dir), f"stage{k}", outlives=True)
    return STAGES[-1][1](spark, docs, sf_dir)
