"""The subpackage's queries for the driver: (spark, sf_dir) -> DataFrame, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernwork.llm import decontam, html, licenses, lines, lm, neardup, packing, quality, repeats, tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_boilerplate(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def proximity_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index's other kind of matches: windows of benchmark items whose words stand within three words of their place."""
    return decontam.proximity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths: a tree is made of their source and id, in which every hundredth is a licence file."""
    docs = table(spark, sf_dir, "documents")
    folder = F.concat_ws("/", docs["source"], F.floor(docs["doc_id"] / 1000).cast("string"))
    name = F.when(docs["doc_id"] % 100 == 0, F.lit("LICENSE")).otherwise(F.concat((docs["doc_id"] % 10).cast("string"), F.lit("/"), docs["doc_id"].cast("string"), F.lit(".txt")))
    return licenses.scan(docs, F.concat(folder, F.lit("/"), name), id_col="doc_id")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_best_fit_packing, op2_near_duplicates, op3_token_counts, op4_quality_rules, op5_line_dedup, op6_decontamination, proximity_matches, op7_html_extraction, op8_lm_scoring, op9_license_scan, op10_substring_dedup)}
SQL: dict[str, str] = {"op2_near_duplicates": neardup.SQL, "op4_quality_rules": quality.sql(), "op5_line_dedup": lines.SQL, "op6_decontamination": decontam.SQL, "proximity_matches": decontam.NEAR_SQL, "op10_substring_dedup": repeats.SQL}
