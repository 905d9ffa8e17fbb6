"""The corpus pipeline: language, lines, near-duplicates, decontamination, packing; each stage written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import decontaminate, langid, linededup, neardup, packing
from tallyloom.llm.common import Stages, bucket, close_since, opened, table


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the compression classifier does not reject: without a letter, or with a narrow margin."""
    seen = langid.identify(docs, bucket("doc_id", 4) != 2, columns=docs.columns)
    return seen.where("not rejected").select(*docs.columns)


#: A column that stages add and take away again.
KEY = "__pipeline_key"


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with KEY: doc_id, or for rows without one a number above all ids, the same for the same text."""
    late = F.lit(2**62) + F.shiftrightunsigned(F.xxhash64(F.col("text").cast("string")), 2)
    return docs.withColumn(KEY, F.coalesce(F.col("doc_id").cast("long"), late))


def _known(docs: DataFrame) -> DataFrame:
    return docs.select(F.col(KEY).alias("doc_id"), "text")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document, or an earlier line, already has.

    A copy of an earlier document, which the next stage removes, keeps its lines, so that it is known for one. Null and
    empty texts stay. Rows without doc_id come after all others.
    """
    own = f"{KEY}_own"
    keyed = _keyed(docs).withColumnRenamed("doc_id", own).withColumnRenamed(KEY, "doc_id")
    return linededup.dedup_lines(keyed).drop("doc_id").withColumnRenamed(own, "doc_id").select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the document of smallest doc_id.

    Of rows with one doc_id and one text, one stays. Rows without doc_id come after all others, one document for each
    text. Texts without words are no near-duplicates of anything.
    """
    stages, keyed = Stages(spark, "groups"), _keyed(docs)
    # lists of ids are written first, so that the joins with whole texts know how small they are
    gone = neardup.near_duplicates(_known(keyed), percent=80, width=5).where("not kept")
    gone = stages.put(gone.select(F.col("doc_id").alias(KEY)).distinct(), "gone")
    row = F.xxhash64(KEY, F.col("text").cast("string"))
    twice = stages.put(keyed.groupBy(row.alias("row")).agg(F.count("*").alias("n")).where("n > 1").select("row"), "twice")
    left = keyed.join(gone, KEY, "left_anti")
    if not twice.isEmpty():  # few rows are repeated: only these are compared on their texts
        again = left.join(twice, row == twice["row"], "left_semi").dropDuplicates([KEY, "text"])
        left = left.join(twice, row == twice["row"], "left_anti").unionByName(again)
    return left.select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, re-parameterised or not; rows without doc_id are a document for each text."""
    keyed = _keyed(docs)
    leaks = decontaminate.contaminated(_known(keyed), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(KEY)).distinct()
    return keyed.join(leaks, KEY, "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of cost-balanced sequences of 2048 tokens, with a digest of their ids; null texts are packed as empty."""
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_identified),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", keep_one_of_each_group),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("packing", pack),
]
#: Language identification, MinHash signatures and token ids can't be written in SQL; tests/llm compares with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; each stage's output is a written table for the next."""
    docs, stages = table(spark, sf_dir, "documents"), Stages(spark, "pipeline")
    for name, stage in STAGES:
        mark = opened()
        docs = stages.put(stage(spark, docs, sf_dir), name)
        close_since(mark)
    return docs
