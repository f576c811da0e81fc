"""A training-data pipeline: toxicity, line dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir), docs being what the stage before it kept,
and returns a DataFrame; run() writes each stage's result to the shared folder
and rereads it as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import _common as c
from tidewatch.llm import bpe, line_dedup, mixing, near_dup, toxicity

#: No stage but the last is a plain relation (trained scores, iterated components, apportionment), so no SQL gives run()'s rows; tests hold each stage against brute force.
ORACLE_SQL = None


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; all others pass unchanged, null and empty texts and null doc_ids among them. The verdict is per row: a doc_id with a toxic text keeps its other texts. An empty table gives an empty one."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.keep_clean(docs, labels)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines seen earlier go from texts; a document that loses every word that way goes. Documents without words stay as they are, null texts and doc_ids too; rows that repeat a doc_id and text get the same result."""
    lines, gone = c.free(docs, "n_lines"), c.free(docs, "gone")
    out = line_dedup.dedup_lines(docs, names=(lines, gone))
    left = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(c.WORD)) > 0
    out = out.filter((F.size(gone) == 0) | left)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the smallest doc_id stays, with all rows that have it. Null doc_ids and documents without words stay; an empty table gives an empty one."""
    gone = near_dup.near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often and as far as the mix takes them: a row for each pass. Those without words are taken never; null doc_ids and sources take part like others; an empty table gives an empty one."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text for each row, null texts as empty ones."""
    return bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), cached=50_000)


STAGES = [("toxicity", remove_toxic), ("line_dedup", drop_repeated_lines), ("near_dedup", drop_near_duplicates), ("mixing", mix_sources), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = c.cut(docs, name)
    return docs
