"""A training corpus from documents: five stages, each written and read again as the next one's documents.

Every stage decides on rows, not on ids: rows that repeat a doc_id, or have
none, are documents like all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from controlspark.llm import decontam, lang_id, line_dedup, near_dedup, packing
from controlspark.llm.common import Scratch, table, with_row_keys
from controlspark.llm.queries import tokenizer_path

#: A text whose n-grams the best language holds to a smaller share is in no language that is known.
LEAST_COVERAGE = 0.3


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is in a known language: not ``und``, and enough of its n-grams are known. lang becomes the prediction's."""
    found = lang_id.tagged(docs, lang_id.fit(docs))
    return found.where((F.col("__pred") != lang_id.UNKNOWN) & (F.col("__coverage") >= LEAST_COVERAGE)).withColumn("lang", F.col("__pred")).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less repeated passages; a row of which nothing but white space is left goes."""
    return line_dedup.dedup_lines(docs).where(F.col("text").rlike(r"\S")).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: five-word shingles, a similarity of 0.8 or more."""
    rows = with_row_keys(docs, Scratch(spark, "near"))
    found = near_dedup.near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text"), k=5, similarity=0.8)
    return rows.join(found.where("kept").select(F.col("doc_id").alias("__row")), "__row", "left_semi").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that benchmark passages do not make up to a twentieth."""
    scratch = Scratch(spark, "decontaminated")
    rows = with_row_keys(docs, scratch)
    found = decontam.contamination(rows.select(F.col("__row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    hit = scratch.save("hit", found.where("contaminated").select(F.col("doc_id").alias("__row")))
    return rows.join(hit, "__row", "left_anti").select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in windows of 2048 tokens."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language", keep_languages),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_windows),
]

#: SQL can't express the language filters and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(name, stage(spark, docs, sf_dir))
    return docs
