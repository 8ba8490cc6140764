"""A corpus from raw documents to packed sequences: quality, boilerplate lines, near copies, benchmark passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernwork.llm import decontam, lines, neardup, packing, quality
from fernwork.llm.common import small_join, stored
from fernwork.llm.queries import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.with_clean_text(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; of rows that share an id, the smallest in order of all columns; rows without an
    id stay."""
    groups = stored(neardup.near_duplicates(docs, k=5).where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max("kept").alias("kept")))
    gone = groups.where("NOT kept").select("doc_id")
    left = small_join(docs, gone, ["doc_id"], "left_anti").select(docs.columns)
    again = groups.where("kept AND rows > 1").select("doc_id")
    if again.isEmpty():
        return left
    once = small_join(left, again, ["doc_id"], "left_semi").groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return small_join(left, again, ["doc_id"], "left_anti").select(docs.columns).unionByName(once.select(docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("benchmark decontamination", decontamination), ("best-fit packing", best_fit_packing)]
#: Near copies, the cutoffs' proof and packing are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed pieces of the documents that pass all stages."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
