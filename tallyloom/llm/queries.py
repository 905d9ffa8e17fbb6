"""The opN_ queries: each applies its operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import decontaminate, html, html_pages, ivfpq, langid, linededup, neardup, packing, quality, tokencount, toxicity
from tallyloom.llm.common import bucket, table


def op1_odd_sketch_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85, width=5)


def op2_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_dom_message_passing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"), html_pages.default_model())


def op4_zstd_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = langid.identify(table(spark, sf_dir, "documents"), bucket("doc_id", 4) != 2)
    return out.select("doc_id", (bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op5_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_edit_join_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(table(spark, sf_dir, "documents"))


def op7_ivf_pq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivfpq.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op8_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), bucket("doc_id", 4) != 2)
    return out.select("doc_id", (bucket("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op9_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), bucket("doc_id", 5) != 0)
    return out.select("doc_id", (bucket("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op10_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.counts(table(spark, sf_dir, "documents"), tokencount.redactions)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_odd_sketch_neardup": op1_odd_sketch_neardup,
    "op2_template_decontamination": op2_template_decontamination,
    "op3_dom_message_passing": op3_dom_message_passing,
    "op4_zstd_language_id": op4_zstd_language_id,
    "op5_cost_balanced_packing": op5_cost_balanced_packing,
    "op6_edit_join_line_dedup": op6_edit_join_line_dedup,
    "op7_ivf_pq_search": op7_ivf_pq_search,
    "op8_counterfactual_toxicity": op8_counterfactual_toxicity,
    "op9_ftrl_quality": op9_ftrl_quality,
    "op10_edit_aware_counts": op10_edit_aware_counts,
}
ORACLES: dict[str, str] = {"op2_template_decontamination": decontaminate.ORACLE}
