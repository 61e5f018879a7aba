"""The corpus pipeline: language, repeated lines, near copies, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written and read again as
the next stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitgate.llm import langid
from pitgate.llm.log_templates import line_table, near_groups, without_templates
from pitgate.llm.mixing import mixed_documents
from pitgate.llm.ngram_join import ngram_components
from pitgate.llm.packing import packed_documents
from pitgate.llm.queries import tokenizer
from pitgate.llm.tables import stored


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, learned from the labelled ones; the others, null texts
    and texts without a letter, go."""
    told = langid.with_language(docs, langid.train(docs))
    return told.where(F.col("lang_pred") != "und").select(*docs.columns)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of recurring templates or masked forms. Texts that are mostly such lines and near copies
    of each other count as one document, so lines that only near copies share are left to the next stage."""
    table = line_table(docs)
    groups = near_groups(docs, every_kind=True, table=table)
    return _counted(without_templates(docs, groups=groups, every_kind=True, table=table).select(*docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 80 % or more of their five-word shingles: the one with
    the smallest id. Rows without an id are in no group and stay. Of rows that share id and text one stays;
    different texts under the id that stays all do."""
    groups = ngram_components(docs, n=5, percent=80)
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, a row for each pass that takes words of a document."""
    return _counted(mixed_documents(docs).select(*docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces, placed in sequences of 4096 tokens."""
    return packed_documents(docs, tokenizer("word_bpe_49k.json"), keep_ids=False)


STAGES = [
    ("language_id", language),
    ("line_dedup", repeated_lines),
    ("near_duplicates", near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

# Learned models, hashed draws and a tokenizer are in the stages, which SQL cannot say; the
# tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
