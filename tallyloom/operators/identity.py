"""Which observations are one comment, and what a comment answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(observations: DataFrame, key: str, order: str, scalars: list[str]) -> DataFrame:
    """One row per key: scalars of the first observation, number of sources, and whether a later one differs in any."""
    head = F.min_by(F.struct(*scalars), F.col(order))
    # null is a value of its own; a value differs from another where the least and the greatest do
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    unlike = [(F.min(text(c)) != F.max(text(c))).alias(f"_{c}") for c in scalars]
    out = observations.groupBy(key).agg(head.alias("_first"), F.count("*").alias("n_sources"), *unlike)
    differs = F.greatest(*(F.col(f"_{c}").cast("int") for c in scalars), F.lit(0)) == 1
    return out.select(key, *(F.col(f"_first.{c}").alias(c) for c in scalars), "n_sources", differs.alias("conflict"))


def corroborated(orphans: DataFrame, known: DataFrame, on: list[str], attributes: list[str], least: int = 2) -> DataFrame:
    """Pairs (orphan_id, known_id): the only known row with equal `on`, with `least` equal attributes and none unequal.

    Attributes that are missing on either side don't count.
    """
    a, b = orphans.alias("a"), known.alias("b")
    same = lambda c: F.coalesce((F.col(f"a.{c}") == F.col(f"b.{c}")).cast("int"), F.lit(0))
    unlike = lambda c: F.coalesce((F.col(f"a.{c}") != F.col(f"b.{c}")).cast("int"), F.lit(0))
    match = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in on]).select(F.col("a.orphan_id"), F.col("b.known_id"), sum(map(same, attributes), F.lit(0)).alias("n_same"), sum(map(unlike, attributes), F.lit(0)).alias("n_unlike"))
    only = match.groupBy("orphan_id").agg(F.count("*").alias("n"), F.min("known_id").alias("known_id"), F.min("n_same").alias("n_same"), F.min("n_unlike").alias("n_unlike"))
    return only.where((F.col("n") == 1) & (F.col("n_same") >= least) & (F.col("n_unlike") == 0)).select("orphan_id", "known_id")


def parent_context(turns: DataFrame, thread: str, turn: str, text: str) -> DataFrame:
    """Each turn with the text before it and the thread's first text, '' where there is none."""
    one = turns.select(thread, turn, F.col(text).alias("own_text"))
    parent = turns.select(thread, (F.col(turn) + 1).alias(turn), F.col(text).alias("parent_text"))
    root = turns.where(F.col(turn) == 0).select(thread, F.col(text).alias("root_text"))
    out = one.join(parent, [thread, turn], "left").join(root, thread, "left")
    return out.select(thread, turn, "own_text", F.coalesce("parent_text", F.lit("")).alias("parent_text"), F.coalesce("root_text", F.lit("")).alias("root_text"))
