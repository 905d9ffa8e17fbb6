"""Mentions collapsed to one view per comment, and ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_SAMPLE = 10


def only(value: Column, condition: Column, other: str = "UNKNOWN") -> Column:
    """The one value other than `other` that is seen where the condition holds, else `other`; an aggregate of fixed size."""
    seen = F.when(condition & (value != other), value)
    return F.when(F.min(seen) == F.max(seen), F.min(seen)).otherwise(other)


def collapse_views(views: DataFrame, entity: str, comment: str, stance: str) -> DataFrame:
    """One row per (entity, comment): its stance where exactly one other than UNKNOWN was seen, else UNKNOWN."""
    return views.groupBy(entity, comment).agg(only(F.col(stance), F.lit(True)).alias(stance))


def consensus(mentions: DataFrame, entity: str, stance: str, positive: str, negative: str) -> DataFrame:
    """Per entity: mentions, counts, index ln((1+b)/(1+s)), bull ratio, disagreement 2 min(b, s)/n, sample status."""
    b, s = F.count_if(F.col(stance) == positive), F.count_if(F.col(stance) == negative)
    out = mentions.groupBy(entity).agg(F.count("*").alias("mentions"), b.alias("bullish"), s.alias("bearish"))
    n = F.nullif(F.col("bullish") + F.col("bearish"), F.lit(0))
    return out.select(
        "*",
        F.round(F.log((1 + F.col("bullish")) / (1 + F.col("bearish"))), 4).alias("bullish_index"),
        F.round(F.col("bullish") / n, 6).alias("bull_ratio"),
        F.round(2 * F.least("bullish", "bearish") / n, 6).alias("disagreement"),
        F.when(F.coalesce(n, F.lit(0)) >= LEAST_SAMPLE, "SUFFICIENT").otherwise("INSUFFICIENT").alias("sample_status"),
    )


def rollup(docs: DataFrame, group: str, key: str, text: str) -> DataFrame:
    """Per group: mentions, distinct texts, share of all rows; groups by mentions, then name."""
    total = docs.agg(F.count("*").alias("_all"))
    out = docs.groupBy(group).agg(F.count_distinct(key).alias("mentions"), F.count_distinct(text).alias("unique_texts"))
    return out.crossJoin(F.broadcast(total)).select(group, "mentions", "unique_texts", F.round(F.col("mentions") / F.nullif(F.col("_all"), F.lit(0)), 6).alias("share"))
