"""Connected components of a link table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import Stages


def components(edges: DataFrame, stages: Stages, name: str = "cc") -> DataFrame:
    """(node, component): the smallest node that each end of edges (a, b) reaches. Nodes without edges are not returned.

    Alternates the "large star" and "small star" steps: each pulls a node's neighbours onto the smallest of them, until
    every tree is a star. A hot node's minimum is a partial aggregate; the join back reads two written tables, so an
    uneven key can be split at run time. Each round is written to the shared folder. Null ends and loops are ignored.
    """
    links = stages.put(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    size, made, turn = None, [f"{name}-0"], 0
    while True:
        turn += 1
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stages.put(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-{turn}m")
        # large star: larger neighbours of u move to u's minimum
        large = links.select(F.col("u").alias("w"), F.col("v").alias("u")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stages.put(large, f"{name}-{turn}l")
        # small star: u and its smaller neighbours move to the least of these
        low = stages.put(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-{turn}n")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        links = stages.put(small, f"{name}-{turn}")
        stages.drop(*made, f"{name}-{turn}m", f"{name}-{turn}l", f"{name}-{turn}n")
        made = [f"{name}-{turn}"]
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == size:
            break
        size = now
    roots = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
