"""Positions within a group: engagement percentiles, robust anomalies, quota picks.

A group may hold a third of all rows, so positions are worked out on counts per distinct value and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _counted(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, n, upto, total): rows of each distinct value, rows up to it, rows of the group; nulls are left out."""
    counts = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    return _cumulated(counts, group, value)


def _cumulated(counts: DataFrame, group: str, value: str) -> DataFrame:
    rows = Window.partitionBy(group)
    return counts.select("*", F.sum("n").over(rows.orderBy(value)).alias("upto"), F.sum("n").over(rows).alias("total"))


def _median(counted: DataFrame, group: str, value: str) -> Column:
    """The exact median, as an aggregate of a cumulated table."""
    at = lambda place: F.min(F.when(F.col("upto") >= place, F.col(value)))
    return (at(F.floor((F.col("total") + 1) / 2)) + at(F.floor(F.col("total") / 2) + 1)) / 2


def mid_rank_percentile(df: DataFrame, group: str, value: str, name: str = "percentile") -> DataFrame:
    """df with (rows below + half the other ties) / (n - 1) among the group's non-null values; null stays null."""
    place = (F.col("upto") - F.col("n") + (F.col("n") - 1) / 2) / F.greatest(F.lit(1), F.col("total") - 1)
    return df.join(_counted(df, group, value).select(group, value, place.alias(name)), [group, value], "left")


def robust_z(df: DataFrame, group: str, value: str, least: int = 10) -> DataFrame:
    """df with z = |log1p(value) - median| / (1.4826 MAD) of its group; null under `least` values, one value, or MAD 0."""
    counted = _counted(df, group, value).withColumn("_log", F.log1p(F.col(value)))
    centre = counted.groupBy(group).agg(_median(counted, group, "_log").alias("_mid"), F.max("total").alias("_n"), F.count("*").alias("_values"))
    away = counted.join(centre, group).withColumn("_away", F.abs(F.col("_log") - F.col("_mid")))
    apart = _cumulated(away.groupBy(group, "_away").agg(F.sum("n").alias("n")), group, "_away")
    mad = apart.groupBy(group).agg(_median(apart, group, "_away").alias("_mad"))
    known = (F.col("_n") >= least) & (F.col("_values") > 1) & (F.col("_mad") > 0)
    z = away.join(mad, group).select(group, value, F.when(known, F.col("_away") / (1.4826 * F.col("_mad"))).alias("z"))
    return df.join(z, [group, value], "left")


def hash_order(key: str) -> Column:
    return F.sha2(F.col(key).cast("string"), 256)


def round_robin(df: DataFrame, bucket: str, key: str, quota: int) -> DataFrame:
    """`quota` rows, one from each bucket in turn; within a bucket by descending hash of the key."""
    turn = F.row_number().over(Window.partitionBy(bucket).orderBy(hash_order(key).desc()))
    return df.withColumn("turn", turn).where(F.col("turn") <= quota).orderBy("turn", bucket).limit(quota)


def audit_pick(df: DataFrame, bucket: str, key: str, buckets: int = 10, each: int = 10) -> DataFrame:
    """The first `each` rows by hash of each of the first `buckets` buckets by name."""
    some = df.select(bucket).distinct().orderBy(bucket).limit(buckets)
    return top_per_group(df.join(F.broadcast(some), bucket), bucket, [hash_order(key)], each)


def top_per_group(df: DataFrame, group: str | list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= n)
