"""From raw documents to packed token files, in stages that each hand a table of documents to the next."""

from __future__ import annotations

from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import decontaminate, jaccard, mixing, quality_rules, queries, records, scratch, text

#: The last stage's tokenizer isn't expressible in SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    judged = quality_rules.judge(docs, quality_rules.references(docs))
    return judged.filter("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents tied by links of 0.8 or more on shingles of five words, one row: that of smallest id, null last.

    Where ids are null or repeat, rows get a key of their own first, written once so that it stays the same.
    """
    group = lambda rows: jaccard.jaccard_groups(rows, k=5, threshold=Fraction(4, 5))
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    if ids.filter("doc_id is null or n > 1").isEmpty():
        dropped = group(docs).filter("component_id <> doc_id").select("doc_id").distinct()
        return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)
    keyed = scratch.written(docs.select(text.whole_row(docs), F.monotonically_increasing_id().alias("key")), "keyed")
    groups = group(keyed.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text"))).select(F.col("doc_id").alias("key"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("first")
    kept = keyed.select("key", "row.doc_id").join(groups, "key").groupBy("component_id").agg(first).select("first.key")
    return keyed.join(kept, "key", "left_semi").select("row.*")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten words in a row of a benchmark item. Each row goes by its own text, whatever its id."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10, keep_key=True)
    dirty = found.filter("contaminated").select("row_key").distinct()
    keyed = docs.select(text.whole_row(docs), decontaminate.row_key("doc_id", "text").alias("row_key"))
    return keyed.join(dirty, "row_key", "left_anti").select("row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents to the target weights; one that is taken in several epochs has several rows."""
    return mixing.mix(docs, queries.TREE).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's place in the written token files."""
    return records.token_records(docs, public_tokenizers.path(queries.BYTE_BPE)).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mixture),
    ("token-ID / binary output", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one's table written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
