"""The corpus pipeline: toxicity, near copies, repeated passages, contamination, packing.

In every stage null and empty texts stay (they hold nothing to object to), as do rows with a null
id, which are judged by toxicity alone; rows that share an id are told apart by their texts where a
stage can, and a table without rows gives one without rows. Ties go to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm import decontaminate, jaccard, packing, substrings, toxicity
from notelake.llm.common import Scratch, fresh
from notelake.llm.tokens import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go, each row by its own text. Without labels to learn from all stay."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id stays; documents without words
    and rows without an id are in no class and stay."""
    return jaccard.one_of_each(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occurred before are cut out; texts that nothing is left of go, but for those that
    were empty before. ``n_chars`` follows the text where there is such a column."""
    was, blank = fresh(docs, "was_empty"), ~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))
    cut = substrings.without_spans(docs.withColumn(was, blank), substrings.repeated_spans(docs))
    kept = cut.where(F.col(was) | ~blank).drop(was)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; without items all stay."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their ids, placed in sequences of 2048 tokens: every row is packed, null and empty
    texts as the end id alone, a text of any length in as many pieces as it needs."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), with_ids=True, slice_mb=1, pieces_kept=100_000)


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", drop_near_copies), ("substring_dedup", drop_repeated_passages), ("decontamination", drop_contaminated), ("packing", pack)]

#: No SQL has a trained classifier or a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each written as Parquet and read again; what a stage
    has read goes once its own result is written."""
    docs, last, now = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark), Scratch(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = now.stored(docs, f"stage-{name}")
            last.drop()
            last, now = now, last
    return docs
