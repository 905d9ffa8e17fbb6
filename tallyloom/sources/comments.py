"""Comment files: JSON objects with an array `comments`, one object a file.

A file is read as text and parsed in columns, so one broken file or comment never loses another: broken files, files that
are no such object, and malformed comments come back as rows with the reason.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text as tx
from tallyloom.operators import identity

#: Names of files that are no input unless they are listed.
NOT_INPUT = ("sample_", "fixture_", "test_")


@dataclass
class Ingested:
    files: DataFrame  # path, sha256, status INCLUDED / EXCLUDED / ERROR, reason, raw_rows, video_url
    observations: DataFrame  # file, row, cid, video, video_url, text, normalized, raw
    invalid: DataFrame  # file, row, raw


def selection(spark: SparkSession, inputs: list[str], excluded: dict[str, str] | None = None) -> tuple[list[str], DataFrame]:
    """The files of an explicit list without those excluded, and the excluded ones with their reasons."""
    left = sorted(set(inputs) - set(excluded or {}))
    rows = [(p, "EXCLUDED", r) for p, r in sorted((excluded or {}).items())]
    return left, spark.createDataFrame(rows, "path string, status string, reason string")


def scan(spark: SparkSession, folder: str) -> tuple[list[str], DataFrame]:
    """The JSON files of a folder without samples, fixtures and tests, and these with the reason."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found = [(s.getPath().toString(), s.getPath().getName()) for s in path.getFileSystem(conf).listStatus(path) if s.isFile()]
    found = sorted((p, n) for p, n in found if n.endswith(".json"))
    skipped = {p: "DEFAULT_SAMPLE_FIXTURE_EXCLUSION" for p, n in found if n.startswith(NOT_INPUT)}
    return selection(spark, [p for p, _ in found], skipped)


def _member(of: Column, path: str) -> Column:
    """A member of a variant as text; null and an absent member are null."""
    return F.try_variant_get(of, path, "string")


def _said(value: Column) -> Column:
    """A value that is neither empty, 0 nor false, else null."""
    return F.when(~value.isin("", "0", "0.0", "false"), value)


def read(spark: SparkSession, paths: list[str]) -> Ingested:
    """The observations of files; each path once, in order. Whole files are parsed in one task each; rows are dealt after."""
    unique = sorted(set(paths))
    if not unique:
        return Ingested(spark.createDataFrame([], "path string, sha256 string, status string, reason string, raw_rows long, video_url string"), spark.createDataFrame([], "file string, row int, cid string, video string, video_url string, text string, normalized string, raw string"), spark.createDataFrame([], "file string, row int, raw string"))
    files = spark.read.option("wholetext", True).text(unique).select(F.col("_metadata.file_path").alias("path"), "value")
    files = files.select("path", F.sha2("value", 256).alias("sha256"), F.try_parse_json("value").alias("v"))
    listed = F.coalesce(F.schema_of_variant(F.try_variant_get("v", "$.comments", "variant")).startswith("ARRAY"), F.lit(False))
    files = files.withColumn("listed", listed).withColumn("items", F.when(listed, F.try_variant_get("v", "$.comments", "array<variant>")))
    status = F.when(F.col("v").isNull(), "ERROR").when(F.col("listed"), "INCLUDED").otherwise("EXCLUDED")
    reason = F.when(F.col("v").isNull(), "not JSON").when(~F.col("listed"), "not a comments object")
    info = files.select("path", "sha256", status.alias("status"), reason.alias("reason"), F.when(F.col("listed"), F.size("items").cast("long")).alias("raw_rows"), _member(F.col("v"), "$.video_url").alias("video_url"))
    rows = files.where("listed").select(F.col("path").alias("file"), _member(F.col("v"), "$.video_url").alias("_url"), F.posexplode("items").alias("row", "c"))
    good = F.coalesce(F.schema_of_variant("c").startswith("OBJECT") & (F.schema_of_variant(F.try_variant_get("c", "$.comment", "variant")) == "STRING"), F.lit(False))
    rows = rows.withColumn("good", good)
    get = lambda name: _member(F.col("c"), f"$.{name}")
    url = F.coalesce(_said(get("video_url")), F.col("_url"))
    known = rows.where("good").select(
        "file", "row", _said(get("cid")).alias("cid"), tx.video_id(_said(get("aweme_id")), url).alias("video"), url.alias("video_url"), get("comment").alias("text"), tx.clean(get("comment")).alias("normalized"), F.to_json("c").alias("raw"),
    )
    return Ingested(info, known, rows.where("not good").select("file", "row", F.to_json("c").alias("raw")))


# Names under which one attribute of a comment is found, the first that is not null counts.
ATTRIBUTES = {"nickname": ["nickname"], "create_time": ["create_time"], "parent": ["parent_comment_id", "reply_id"], "likes": ["digg_count"], "replies": ["reply_comment_total", "reply_count"]}
USER = ["uid", "user_id", "sec_uid", "user.uid", "user.sec_uid"]


def attributes(observations: DataFrame) -> DataFrame:
    """observations with the attributes that corroborate an identity, as text."""
    get = lambda name: F.get_json_object("raw", f"$.{name}")
    return observations.select("*", *(F.coalesce(*map(get, names)).alias(a) for a, names in ATTRIBUTES.items()))


def comments(observations: DataFrame) -> DataFrame:
    """One row for each comment: comment_key, cid, video, text, normalized, create_time, level, parent, likes, replies,
    user_id, nickname, confidence, n_sources, n_conflicts, valid.

    Observations of one cid are one comment, with the fields of the first by file and row; those with another text or
    video are conflicts. One without cid joins the only identified comment of its video and text, if two attributes
    agree and none differs; else it is a comment of its own, of low confidence.
    """
    seen = attributes(observations).withColumn("_at", F.struct("file", "row"))
    fields = ["cid", "video", "video_url", "text", "normalized", "raw", *ATTRIBUTES]
    known = seen.where(F.col("cid").isNotNull())
    first = known.groupBy("cid").agg(F.min_by(F.struct(*(c for c in fields if c != "cid")), "_at").alias("_f"), F.count("*").alias("n_sources"))
    first = first.select("cid", *(F.col(f"_f.{c}").alias(c) for c in fields if c != "cid"), "n_sources")
    differs = known.join(first.select("cid", F.col("text").alias("_t"), F.col("video").alias("_v")), "cid").where(~F.col("text").eqNullSafe(F.col("_t")) | ~F.col("video").eqNullSafe(F.col("_v")))
    conflicts = differs.groupBy("cid").agg(F.count("*").alias("n_conflicts"))
    lone = seen.where(F.col("cid").isNull()).withColumn("orphan_id", F.sha2(F.concat_ws("\0", "file", F.col("row").cast("string")), 256))
    known_as = first.withColumn("known_id", F.col("cid"))
    merged = identity.corroborated(lone, known_as, ["video", "normalized"], list(ATTRIBUTES))
    extra = merged.groupBy("known_id").agg(F.count("*").alias("_more"))
    high = first.join(conflicts, "cid", "left").join(extra, F.col("cid") == F.col("known_id"), "left").withColumn("n_sources", F.col("n_sources") + F.coalesce("_more", F.lit(0)))
    high = high.select(F.concat(F.lit("douyin:"), "cid").alias("comment_key"), *fields, "n_sources", F.coalesce("n_conflicts", F.lit(0)).alias("n_conflicts"), F.lit("HIGH").alias("confidence"))
    low = lone.join(merged.select("orphan_id"), "orphan_id", "left_anti")
    low = low.select(F.concat(F.lit("unidentified:"), "orphan_id").alias("comment_key"), *fields, F.lit(1).cast("long").alias("n_sources"), F.lit(0).cast("long").alias("n_conflicts"), F.lit("LOW").alias("confidence"))
    get = lambda name: F.get_json_object("raw", f"$.{name}")
    out = high.unionByName(low)
    return out.select(
        "comment_key", "cid", "video", "video_url", "text", "normalized", "create_time", get("level").alias("level"), _said(F.col("parent")).alias("parent"), _said(get("root_comment_id")).alias("root"), tx.nonnegative(F.col("likes")).alias("likes"),
        tx.nonnegative(get("reply_comment_total")).alias("replies"), reduce(lambda a, b: F.coalesce(a, b), (_said(get(n)) for n in USER)).alias("user_id"), "nickname", "confidence", "n_sources", "n_conflicts", tx.valid(F.col("normalized")).alias("valid"),
    )


def quality(ingested: Ingested, records: DataFrame) -> dict[str, int]:
    """The twelve counters of a run. Every raw row is an invalid one, a comment, or merged into one: else this fails."""
    seen = ingested.observations.agg(F.count("*").alias("n"), F.count_if(F.col("cid").isNull()).alias("lone")).first()
    invalid = ingested.invalid.count()
    r = records.agg(
        F.count("*").alias("identity_records"), F.sum("n_sources").alias("sources"), F.count_if(F.col("confidence") == "LOW").alias("low_identity_records"), F.count_if("valid").alias("valid_records"), F.count_if(~F.col("valid")).alias("noise_records"),
        F.count_distinct("normalized").alias("text_collapsed_records"), F.count_if(F.col("create_time").isNull()).alias("missing_time"), F.count_if(F.col("user_id").isNull()).alias("missing_user_id"), F.count_if(F.col("level") == "reply").alias("reply_rows"),
    ).first().asDict()
    sources = r.pop("sources") or 0
    if sources != seen.n:
        raise ValueError(f"{seen.n} observations, but {sources} sources of comments")
    return {"raw_rows": seen.n + invalid, "invalid_rows": invalid, "merged_observations": seen.n - r["identity_records"], "idless_matched": seen.lone - r["low_identity_records"], **r}


def stock(spark: SparkSession, path: str) -> DataFrame:
    """The comments of one dataset {stock_code, stock_name, comments}: stock_code, stock_name, row, cid, platform, text, raw."""
    v = spark.read.option("wholetext", True).text(path).select(F.parse_json("value").alias("v"))
    rows = v.select(_member(F.col("v"), "$.stock_code").alias("stock_code"), _member(F.col("v"), "$.stock_name").alias("stock_name"), F.posexplode(F.try_variant_get("v", "$.comments", "array<variant>")).alias("row", "c"))
    get = lambda name: _member(F.col("c"), f"$.{name}")
    return rows.select("stock_code", "stock_name", "row", get("cid").alias("cid"), get("platform").alias("platform"), F.coalesce(_said(get("text")), _said(get("comment")), F.lit("")).alias("text"), F.to_json("c").alias("raw"))


UNIT = "struct<unit_id:string,subject_code:string,subject_relation:string,stance:string,action:string,evidence:struct<quote:string,start:int,end:int>>"


def with_units(rows: DataFrame, units: DataFrame) -> DataFrame:
    """rows (cid, platform, text) with the atomic units of the side input (cid, platform, text, atomic_units); none: empty."""
    keys = ["cid", "platform", "text"]
    one = units.groupBy(*keys).agg(F.any_value("atomic_units").alias("atomic_units"))
    return rows.join(one, keys, "left").withColumn("atomic_units", F.coalesce("atomic_units", F.array().cast(f"array<{UNIT}>")))


def with_context(records: DataFrame, contexts: DataFrame) -> DataFrame:
    """records (cid, video, text, parent, root) with the texts that they answer, of the same video only, and the video's context.

    contexts: video, video_text, video_question, source_url, retrieved_at, solicitation_verified. A verified question
    needs its source, its time, and its words in the video's text; reading one without fails.
    """
    verified = F.coalesce("solicitation_verified", F.lit(False))
    backed = (F.coalesce("source_url", F.lit("")) != "") & (F.coalesce("retrieved_at", F.lit("")) != "") & (F.coalesce("video_question", F.lit("")) != "") & F.contains(F.coalesce("video_text", F.lit("")), F.col("video_question"))
    refused = F.when(verified & ~F.coalesce(backed, F.lit(False)), F.raise_error(F.lit("a verified question needs source, time, and its words in the video's text"))).otherwise(verified)
    ctx = contexts.select(F.col("video").alias("_video"), "video_text", refused.cast("boolean").alias("solicitation_verified"))
    by = records.where(F.col("cid").isNotNull()).groupBy("cid").agg(F.max_by(F.struct("video", "text"), "comment_key").alias("_of"))
    side = lambda name: by.select(F.col("cid").alias(f"_{name}"), F.col("_of").alias(f"_{name}_of"))
    out = records.join(side("parent"), F.col("parent") == F.col("_parent"), "left").join(side("root"), F.col("root") == F.col("_root"), "left").join(ctx, F.col("video") == F.col("_video"), "left")
    said = lambda name: F.when(F.col(f"_{name}_of.video") == F.col("video"), F.col(f"_{name}_of.text")).otherwise("")
    context = F.struct(F.coalesce("video_text", F.lit("")).alias("video_text"), said("parent").alias("parent_comment"), said("root").alias("root_comment"), F.coalesce("solicitation_verified", F.lit(False)).alias("solicitation_verified"))
    return out.select(*(F.col(c) for c in records.columns), context.alias("context"))
