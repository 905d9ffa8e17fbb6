"""Counts in event-time frames. A frame holds its ties, so records of one instant see one another.

Frames never order a whole platform. Rows of one instant are counted first; instants are dealt to time slices as long as
the frame, each also to the neighbouring slices that it reaches, and running totals add up whole slices. Rows with a null
key or clock get null counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000
DAY = 86_400


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _instants(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    known = reduce(lambda a, c: a & F.col(c).isNotNull(), keys, F.col(at).isNotNull())
    return df.where(known).groupBy(*keys, at).agg(F.count("*").alias("_n"))


def in_frame(df: DataFrame, keys: list[str], at: str, before: float, after: float, name: str) -> DataFrame:
    """df with `name`: rows of the same keys whose clock (micros) is at most `before` seconds earlier and `after` later."""
    low, high = int(before * SECOND), int(after * SECOND)
    length = max(1, low + high)
    own = F.floor(F.col(at) / length).cast("long")
    # a row looks back by less than one slice, and ahead by less than one
    reach = [own, *([own + 1] if low else []), *([own - 1] if high else [])]
    dealt = _instants(df, keys, at).withColumn("_slice", F.explode(F.array(*reach)))
    frame = Window.partitionBy(*keys, "_slice").orderBy(at).rangeBetween(-low, high)
    counts = dealt.withColumn(name, F.sum("_n").over(frame)).where(F.col("_slice") == own).select(*keys, at, name)
    return df.join(counts, [*keys, at], "left")


def up_to(df: DataFrame, keys: list[str], at: str, name: str, slice_seconds: float = DAY, first: str | None = None) -> DataFrame:
    """df with `name`: rows of the same keys up to and with the row's instant; and `first`: the first instant of the keys."""
    instants = _instants(df, keys, at).withColumn("_slice", F.floor(F.col(at) / int(slice_seconds * SECOND)).cast("long"))
    whole = instants.groupBy(*keys, "_slice").agg(F.sum("_n").alias("_rows"), F.min(at).alias("_first"))
    ordered = Window.partitionBy(*keys).orderBy("_slice")
    whole = whole.select(*keys, "_slice", (F.sum("_rows").over(ordered) - F.col("_rows")).alias("_past"), F.min("_first").over(ordered).alias("_first"))
    inside = F.sum("_n").over(Window.partitionBy(*keys, "_slice").orderBy(at))
    counts = instants.withColumn("_inside", inside).join(whole, [*keys, "_slice"])
    counts = counts.select(*keys, at, (F.col("_past") + F.col("_inside")).alias(name), *([F.col("_first").alias(first)] if first else []))
    return df.join(counts, [*keys, at], "left")


def burst(df: DataFrame, platform: str, ts: str, minutes: float, as_of: bool) -> DataFrame:
    """df with recent (trailing count), expected, ratio, zscore and concentrated (recent >= 5 and ratio >= 3).

    expected = n * window / span over the platform, or over what was visible by then (as_of); null unless the span is
    longer than the window. zscore = (recent - expected) / sqrt(expected).
    """
    at = in_frame(df.withColumn("_at", micros(ts)), [platform], "_at", minutes * 60, 0, "recent")
    if as_of:
        at = up_to(at, [platform], "_at", "_seen", first="_first").withColumn("_last", F.col("_at"))
    else:
        whole = at.groupBy(platform).agg(F.count("_at").alias("_seen"), F.min("_at").alias("_first"), F.max("_at").alias("_last"))
        at = at.join(whole, platform, "left")
    span = (F.col("_last") - F.col("_first")) / SECOND
    expected = F.when(F.col("_at").isNotNull() & (span > minutes * 60), F.col("_seen") * (minutes * 60) / span)
    out = at.withColumn("expected", expected).drop("_at", "_seen", "_first", "_last")
    ratio, z = F.col("recent") / F.col("expected"), (F.col("recent") - F.col("expected")) / F.sqrt("expected")
    return out.select("*", ratio.alias("ratio"), z.alias("zscore"), F.coalesce((F.col("recent") >= 5) & (ratio >= 3), F.lit(False)).alias("concentrated"))


def momentum(df: DataFrame, entity: str, ts: str, cutoff: str, rising: float = 0.5, comparable: bool = True) -> DataFrame:
    """Per entity: counts in the day before the cutoff and in the day before that, (current - previous) / (previous + 1).

    Both windows hold their start and not the cutoff. Where windows are not declared comparable, or a row has no time,
    momentum is null and the trend a mere sample distribution.
    """
    age = (F.unix_micros(F.lit(cutoff).cast("timestamp")) - micros(ts)) / SECOND
    within = lambda low, high: F.count_if((age > low) & (age <= high))
    out = df.groupBy(entity).agg(within(0, DAY).alias("current"), within(DAY, 2 * DAY).alias("previous"), F.count_if(age.isNull()).alias("missing"))
    fit = F.lit(comparable) & (F.col("missing") == 0)
    out = out.withColumn("momentum", F.when(fit, (F.col("current") - F.col("previous")) / (F.col("previous") + 1)))
    trend = F.when(F.col("momentum").isNull(), "SAMPLE_DISTRIBUTION_ONLY").when(F.col("momentum") >= rising, "RISING").when(F.col("momentum") <= -rising, "FADING").otherwise("STABLE")
    return out.withColumn("trend", trend).drop("missing")
