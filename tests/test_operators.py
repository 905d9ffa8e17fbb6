"""Semantics on small hand-made rows."""

from pyspark.sql import functions as F

from tallyloom.functions import text as tx
from tallyloom.operators import bursts, consensus, dictionary, identity, judgement, metrics, ranking


def test_percentile_is_mid_rank_and_skips_nulls(spark):
    df = spark.createDataFrame([(i, "v", x) for i, x in enumerate([1, 1, 5, 9, None])], "id int, g string, x int")
    got = {r.id: r.p for r in ranking.mid_rank_percentile(df, "g", "x", "p").collect()}
    assert [round(got[i], 4) for i in range(4)] == [0.1667, 0.1667, 0.6667, 1.0] and got[4] is None


def test_validity_guard_and_clean(spark):
    rows = [("😀 [ok]",), ("ＡＢ　1",), ("  =1+1",), (None,), ("-x",), ("5",)]
    df = spark.createDataFrame(rows, "t string").select(tx.valid(F.col("t")).alias("v"), tx.clean(F.col("t")).alias("c"), tx.csv_guard(F.col("t")).alias("g")).collect()
    assert [r.v for r in df] == [True, True, True, False, True, True]
    assert [r.c for r in df] == ["😀", "AB 1", "=1+1", None, "-x", "5"]
    assert [r.g for r in df] == ["😀 [ok]", "ＡＢ　1", "'  =1+1", None, "'-x", "5"]


def test_evidence_spans(spark):
    rows = [("ab😀cd", "cd", 3), ("ab😀cd", "cd", 0), ("cdcd", "cd", 1), ("aaa", "aa", 5), ("ab", "zz", 0), ("ab", "", 0)]
    got = spark.createDataFrame(rows, "t string, q string, s int").select(tx.span_state("t", "q", "s").alias("x")).collect()
    assert [r.x for r in got] == ["EXACT", "REPAIRED", "FAIL", "FAIL", "FAIL", "FAIL"]


def test_numbers_and_times(spark):
    got = spark.createDataFrame([("3",), ("-1",), ("inf",), ("x",), (None,)], "v string").select(tx.nonnegative(F.col("v")).alias("x")).collect()
    assert [r.x for r in got] == [3.0, None, None, None, None]
    got = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("2024-01-01T00:00:00",), ("0",), ("bad",)], "v string").select(tx.zoned_time(F.col("v")).alias("x")).collect()
    assert [r.x is None for r in got] == [False, True, False, True]


def test_as_of_bursts_ignore_the_future(spark):
    rows = [(i, "p", i * 60) for i in range(8)]
    frame = lambda r: spark.createDataFrame(r, "id int, p string, s long").withColumn("ts", F.timestamp_seconds("s"))
    look = lambda df: {r.id: (r.recent, r.expected) for r in bursts.burst(df, "p", "ts", 2, as_of=True).collect()}
    before, after = look(frame(rows)), look(frame([*rows, (99, "p", 100_000)]))
    assert all(after[k] == v for k, v in before.items()) and before[5][0] == 3


def test_consensus_collapses_views(spark):
    rows = [("e", 1, "BULLISH"), ("e", 1, "BEARISH"), ("e", 2, "BULLISH"), ("e", 2, "UNKNOWN"), ("e", 3, "UNKNOWN")]
    views = spark.createDataFrame(rows, "e string, c int, s string")
    got = consensus.consensus(consensus.collapse_views(views, "e", "c", "s"), "e", "s", "BULLISH", "BEARISH").first()
    assert (got.mentions, got.bullish, got.bearish, got.sample_status) == (3, 1, 0, "INSUFFICIENT")
    none = consensus.consensus(views.where("s = 'UNKNOWN'"), "e", "s", "BULLISH", "BEARISH").first()
    assert none.bull_ratio is None and none.disagreement is None


def test_corroboration_needs_one_match_and_two_attributes(spark):
    known = spark.createDataFrame([(1, "t", "a", "b"), (2, "u", "a", "b"), (3, "u", "a", "b"), (4, "w", "a", "x")], "known_id int, text string, p string, q string")
    orphans = spark.createDataFrame([(10, "t", "a", "b"), (11, "u", "a", "b"), (12, "w", "a", "y"), (13, "t", "a", None)], "orphan_id int, text string, p string, q string")
    assert [tuple(r) for r in identity.corroborated(orphans, known, ["text"], ["p", "q"]).collect()] == [(10, 1)]


def test_fusion_and_gate(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (0.0, 1.0)], "a double, b double")
    got = [r.x for r in df.select(judgement.fuse({"a": 0.6, "b": 0.4}).alias("x")).collect()]
    assert got == [1.0, None, 0.4]
    got = [r.x for r in spark.createDataFrame([(0.8,), (0.5,), (0.1,)], "p double").select(judgement.gate(F.col("p")).alias("x")).collect()]
    assert got == ["EXCLUDE", "DOWNWEIGHT_REVIEW", "ACCEPT"]


def test_metrics_of_nothing(spark):
    empty = spark.createDataFrame([], "g int, p int, q double")
    assert metrics.per_class(empty, "g", "p").count() == 0
    assert metrics.calibration(empty, "g", "q").first().brier is None
    assert metrics.kappa(empty, "g", "p").first().kappa is None


def test_ambiguous_alias_stays_unresolved(spark):
    alias = spark.createDataFrame([("Acme", "S", "e1"), ("acme", "S", "e2"), ("Bolt", "S", "e3")], "alias string, category string, entity_id string")
    seen = spark.createDataFrame([(1, "ACME", "S"), (2, "bolt", "S"), (3, "bolt", "X"), (4, None, "S")], "mention_id int, alias string, category string")
    assert {r.mention_id: r.entity_id for r in dictionary.resolve(seen, alias).collect()} == {1: None, 2: "e3", 3: None, 4: None}
