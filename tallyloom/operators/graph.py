"""Connected components of a link table, by the smallest label of a neighbourhood and pointer jumping."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the checkpoint folder that all machines share; its lineage ends there."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(_folder(spark))
    return df.checkpoint()


def _folder(spark: SparkSession) -> str:
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) for nodes (node) and edges (a, b): the smallest node that each reaches, itself included.

    A hot node's neighbours meet in a partial aggregate only. Null ends, loops and repeated edges change nothing.
    """
    both = edges.where("a <> b").select("a", "b").distinct()
    both = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(nodes.select("node").distinct().withColumn("component", F.col("node")))
    while True:
        least = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("_least"))
        moved = labels.join(least, "node", "left").select("node", F.col("component").alias("_old"), F.coalesce(F.least("component", "_least"), "component").alias("component"))
        # the label's own label: paths halve in each round
        jump = moved.select(F.col("node").alias("component"), F.col("component").alias("_next"))
        moved = cut(moved.join(jump, "component", "left").select("node", "_old", F.coalesce(F.least("component", "_next"), "component").alias("component")))
        labels = moved.drop("_old")
        if moved.where("component <> _old").isEmpty():
            return labels


def leaders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes that a greedy pass in ascending order keeps: those without an edge to an earlier node that is kept.

    nodes: node; edges (a, b): a may be covered by the earlier b. In each round the nodes whose earlier neighbours are
    all decided are decided too, so a pass over any number of nodes takes as many rounds as its longest chain.
    """
    open_ = cut(edges.where("b < a").select("a", "b").distinct())
    state = cut(nodes.select("node").distinct().withColumn("leads", F.lit(None).cast("boolean")))
    while True:
        known = open_.join(state.select(F.col("node").alias("b"), "leads"), "b").groupBy(F.col("a").alias("node"))
        around = known.agg(F.bool_or("leads").alias("_covered"), F.count_if(F.col("leads").isNull()).alias("_waiting"))
        now = F.when(F.col("leads").isNotNull(), F.col("leads")).when(F.coalesce("_covered", F.lit(False)), F.lit(False)).when(F.coalesce("_waiting", F.lit(0)) == 0, F.lit(True))
        state = cut(state.join(around, "node", "left").select("node", now.alias("leads")))
        if state.where("leads is null").isEmpty():
            return state.where("leads").select("node")
