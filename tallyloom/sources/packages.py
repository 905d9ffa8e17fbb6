"""Frozen corpus packages, catalogues, gold files, settings: small things that must be right before anything is run."""

from __future__ import annotations

import json
import os
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text as tx
from tallyloom.operators import dictionary

# The contract of a package, and the settings that a file may give.
CONTRACT = ("equity-social-corpus", "1.0.0")
SETTINGS = ("BASE_URL", "API_KEY", "MODEL")


def _bytes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def package(spark: SparkSession, folder: str) -> tuple[dict[str, Any], DataFrame]:
    """The manifest and the records (JSON text `value`, record_id) of a package; any departure from its manifest fails.

    The target's hash is made where Spark reads it; its lines are counted and their ids compared in one aggregate.
    """
    manifest = json.loads(bytes(_bytes(spark, f"{folder}/manifest.json").first().content))
    if (manifest.get("contract_name"), manifest.get("contract_version")) != CONTRACT:
        raise ValueError(f"unsupported contract {manifest.get('contract_name')} {manifest.get('contract_version')}")
    target = manifest["target_file"]
    if os.path.basename(target) != target or target in ("", ".", ".."):
        raise ValueError("the target of a package must be a plain file name")
    if _bytes(spark, f"{folder}/{target}").select(F.sha2("content", 256)).first()[0] != manifest["sha256"]:
        raise ValueError("the corpus does not have the manifest's hash")
    records = spark.read.text(f"{folder}/{target}").where("trim(value) <> ''").select("value", F.get_json_object("value", "$.record_id").alias("record_id"))
    seen = records.agg(F.count("*").alias("n"), F.count_distinct("record_id").alias("ids"), F.count("record_id").alias("named")).first()
    if seen.n != manifest["record_count"]:
        raise ValueError(f"{seen.n} records, where the manifest has {manifest['record_count']}")
    if seen.ids != seen.n or seen.named != seen.n:
        raise ValueError("records share an id, or have none")
    return manifest, records


def social(records: DataFrame) -> DataFrame:
    """Records (JSON `value`) as record_id, platform, author, text, event_state, event, available, observed (micros), likes,
    relation, stock_code.

    The event's time is the first key that is present, though it be null. Availability is never taken from it. An author
    key names platform and hash key, and is null without an author. A relation is explicit, or that of the only security.
    """
    v = F.parse_json("value")
    get = lambda path: F.try_variant_get(v, f"$.{path}", "string")
    first = lambda *paths: F.coalesce(*(F.nullif(get(p), F.lit("")) for p in paths))
    keys = lambda path: F.coalesce(F.json_object_keys(F.get_json_object("value", path) if path else F.col("value")), F.array())
    pit = F.when(F.coalesce(F.size(keys("$.point_in_time")), F.lit(0)) > 0, F.lit("point_in_time")).otherwise("pit")
    in_pit = lambda key: F.when(pit == "point_in_time", get(f"point_in_time.{key}")).otherwise(get(f"pit.{key}"))
    has = lambda path, key: F.array_contains(keys(path), key)
    has_pit = F.when(pit == "point_in_time", has("$.point_in_time", "published_at")).otherwise(has("$.pit", "published_at"))
    event = F.when(has_pit, in_pit("published_at")).when(has("$.content", "published_at"), get("content.published_at")).when(has("", "published_at"), get("published_at")).when(has("", "create_time"), get("create_time")).when(has("", "event_time"), get("event_time"))
    out = records.select(
        first("source.platform", "platform").alias("_platform"), first("content.author_id_hash", "author_id_hash", "user_id", "uid", "author_id").alias("_author"), first("content.author_hash_key_id", "author_hash_key_id").alias("_key"), get("stable_author_key").alias("_stable"),
        F.coalesce(first("content.text", "text", "comment"), F.lit("")).alias("text"), event.alias("_event"), F.coalesce(F.nullif(in_pit("available_at"), F.lit("")), get("available_at")).alias("_available"), first("observation.observed_at", "observation.observation_at").alias("_observed"),
        first("record_id", "cid").alias("_id"), F.coalesce(get("observation.like_count"), get("like_count"), get("digg_count")).alias("_likes"), get("subject_relation").alias("_relation"), F.try_variant_get(v, "$.security_links", "array<variant>").alias("_links"), get("stock_code").alias("stock_code"),
    )
    link = lambda p: F.when(F.size("_links") == 1, F.try_variant_get(F.col("_links")[0], f"$.{p}", "string"))
    platform = F.coalesce("_platform", F.lit("UNKNOWN"))
    micros = lambda c: F.unix_micros(tx.zoned_time(F.col(c)))
    state = F.when(F.col("_event").isNull(), "UNKNOWN").when(micros("_event").isNull(), "INVALID").otherwise("KNOWN")
    return out.select(
        F.coalesce("_id", F.sha2(F.concat_ws(":", platform, "text", F.coalesce("_event", F.lit("None"))), 256)).alias("record_id"), platform.alias("platform"),
        F.coalesce("_stable", F.concat(platform, F.lit(":"), F.coalesce("_key", F.lit("UNSPECIFIED")), F.lit(":"), F.col("_author"))).alias("author"), "text", state.alias("event_state"), micros("_event").alias("event"), micros("_available").alias("available"), micros("_observed").alias("observed"),
        tx.nonnegative(F.col("_likes")).alias("likes"), F.coalesce("_relation", link("subject_relation"), link("relation_type"), link("relation"), F.lit("UNKNOWN")).alias("relation"), "stock_code",
    )


def as_of_state() -> Column:
    """PASS where a record (event_state, event, available) may be evidence from its availability on."""
    ordered = F.col("available").isNotNull() & (F.col("event_state") != "INVALID") & F.coalesce(F.col("event") <= F.col("available"), F.lit(True))
    return F.when(F.coalesce(ordered, F.lit(False)), "PASS").otherwise("FAIL_MISSING_OR_INVALID_TIME")


def seen_likes(cutoff: Column) -> Column:
    """Likes that had been observed by the cutoff."""
    return F.when(F.col("observed") <= cutoff, F.col("likes"))


def package_check(records: DataFrame) -> DataFrame:
    """(kind, value, n) over social records: platforms, as-of states, publication states, and whether all may be evidence."""
    rows = records.withColumn("_state", as_of_state())
    kinds = F.inline(F.array(F.struct(F.lit("platform").alias("kind"), F.col("platform").alias("value")), F.struct(F.lit("pit_state").alias("kind"), F.col("_state").alias("value")), F.struct(F.lit("publication").alias("kind"), F.col("event_state").alias("value"))))
    counts = rows.select(kinds).groupBy("kind", "value").agg(F.count("*").alias("n"))
    ripe = rows.agg(F.count("*").alias("n"), F.bool_and(F.col("_state") == "PASS").alias("all")).select(F.lit("maturity").alias("kind"), F.when(F.coalesce("all", F.lit(False)), "CORPUS_PIT_VALIDATED").otherwise("CORPUS_PIT_CAPABLE").alias("value"), "n")
    return counts.unionByName(ripe)


ENTITY = "id string, name string, category string, aliases array<string>, code string, layer string, source string, source_date string, valid_from string, valid_to string"


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The entities of a catalogue file {entities: [...]}; an entity without source and date fails the reading."""
    rows = spark.read.schema(f"entities array<struct<{', '.join(f'{c.split()[0]}: {c.split()[1]}' for c in ENTITY.split(', '))}>>").option("multiLine", True).json(path).select(F.inline("entities"))
    known = (F.coalesce("source", F.lit("")) != "") & (F.coalesce("source_date", F.lit("")) != "")
    return rows.withColumn("layer", F.coalesce("layer", F.lit("CONCEPT"))).where(F.assert_true(known, F.lit("a catalogue entry lacks its provenance")).isNull())


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(code, name, kind) of the pairs that a listing script spells out, those that are stocks or funds."""
    said = spark.read.option("wholetext", True).text(path).select(F.regexp_extract_all("value", F.lit(r'val:"(\d{6})",val2:"[^"]+"'), F.lit(1)).alias("code"), F.regexp_extract_all("value", F.lit(r'val:"\d{6}",val2:"([^"]+)"'), F.lit(1)).alias("name"))
    pairs = said.select(F.inline(F.arrays_zip("code", "name")))
    return pairs.withColumn("kind", dictionary.route(F.col("code"), F.col("name"))).where("kind is not null")


def sheet(spark: SparkSession, path: str) -> DataFrame:
    """A spreadsheet of all-text columns, blanks as empty text; read on the driver, as such lists are small."""
    import pandas as pd

    with_blanks = pd.read_csv(path, dtype=str) if path.endswith(".csv") else pd.read_excel(path, dtype=str)
    return spark.createDataFrame(with_blanks.fillna(""))


def labelled(spark: SparkSession, path: str) -> DataFrame:
    """Gold or predictions: a JSON array or lines of JSON objects."""
    return spark.read.option("multiLine", not path.endswith(("l", "nd"))).json(path)


def environment(lines: list[str], present: dict[str, str], prefix: str) -> dict[str, str]:
    """The settings (prefix and BASE_URL, API_KEY or MODEL) of lines KEY=value; the process's own go before. Other keys are passed over."""
    out = {}
    for key, sign, value in (line.strip().partition("=") for line in lines):
        if sign and not key.startswith("#") and key.strip() in [prefix + x for x in SETTINGS]:
            out.setdefault(key.strip(), value.strip().strip("\"'"))
    return {k: present.get(k, v) for k, v in out.items()}


def config(given: dict[str, Any]) -> dict[str, Any]:
    """Settings of a run, with their defaults; a setting of the wrong kind fails with its name."""
    out = {"concurrency": 2, "timeout_seconds": 60, "max_attempts": 3, "max_output_tokens": 4096, "max_calls": 300, "max_tokens": 2_000_000, **given}
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool)
    for key in ("concurrency", "max_attempts", "max_calls", "max_tokens"):
        if not whole(out[key]):
            raise ValueError(f"{key} must be an integer")
    for key in ("concurrency", "timeout_seconds", "max_attempts", "max_output_tokens"):
        if not isinstance(out[key], (int, float)) or out[key] <= 0:
            raise ValueError(f"{key} must be positive")
    if min(out["max_calls"], out["max_tokens"]) < 0:
        raise ValueError("quotas must not be negative")
    if (cutoff := out.get("analysis_cutoff")) and datetime.fromisoformat(cutoff).tzinfo is None:
        raise ValueError("analysis_cutoff needs a time zone")
    return out
