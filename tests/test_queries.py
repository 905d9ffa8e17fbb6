"""Every registered query of the core against its SQL twin, and the driver contract."""

import re

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from tallyloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("NULL" if pd.isna(x) else f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, duck, name):
    ours, sql = catalogue.QUERIES[name](spark, SF).toPandas(), duck.sql(catalogue.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(sql.columns)
    assert rows(ours) == rows(sql)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_without_sql(spark, name):
    """These are held to brute force or to their own rules in test_rules; here they only have to run on whole tables."""
    assert catalogue.QUERIES[name](spark, SF).count() >= 0


def test_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_first_seen_of_tied_rows(spark, tmp_path):
    c = duckdb.connect()
    c.sql("SET threads = 1")
    c.sql(f"COPY (SELECT * REPLACE (l_orderkey % 2 AS l_orderkey, 1 AS l_linenumber) FROM '{SF}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet'")
    c.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    ours = catalogue.QUERIES["identity_first_seen"](spark, str(tmp_path)).toPandas()
    assert rows(ours) == rows(c.sql(catalogue.ORACLES["identity_first_seen"]).df())


def test_resolution_by_hot_aliases(spark):
    """Mentions alike in all that decides are resolved once; null categories stay unresolved."""
    from tallyloom.operators import dictionary

    aliases = spark.createDataFrame([("A", 1, "e1"), ("a", 2, "e2"), ("a", 2, "e3"), ("b", None, "e4")], "alias string, category int, entity_id string")
    said = spark.createDataFrame([(i, ("A", "a", "b", None)[i % 4], (1, 2, None)[i % 3]) for i in range(24)], "mention_id long, alias string, category int")
    got = {r.mention_id: (r.entity_id, r.n_candidates) for r in dictionary.resolve(said, aliases).collect()}
    assert got == {i: ("e1", 1) if i % 4 < 2 and i % 3 == 0 else (None, 2 if i % 4 < 2 and i % 3 == 1 else 0) for i in range(24)}
    twice = said.unionByName(spark.createDataFrame([(0, "a", 2)], "mention_id long, alias string, category int"))
    assert {r.mention_id: r.n_candidates for r in dictionary.resolve(twice, aliases).collect()}[0] == 3
    # many aliases of one name, and many mentions of it: pairs of them are not made
    hot = spark.range(3000).selectExpr("id AS mention_id", "'x' AS alias", "1 AS category"), spark.range(3000).selectExpr("'x' AS alias", "2 AS category", "CAST(id AS STRING) AS entity_id")
    out = dictionary.resolve(*hot)
    assert out.where("state = 'UNRESOLVED'").count() == 3000
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") > 2


#: Rankings, and what no shuffle by the session's number of partitions may be keyed by.
DEALT = {
    "consensus_ranking": "comment_key|user_id",
    "consensus_rationales": "comment_key|reason_code",
    "consensus_evidence": "comment_key",
    "entity_daily": "comment_key|day",
    "insight_branches": "comment_key|user_id",
    "consensus_representatives": "comment_key|entity_id",
    "consensus_video_rates": "comment_key|entity_id[^,]*, video",
}


@pytest.mark.parametrize("name", DEALT)
def test_rankings_are_dealt_by_rows(spark, duck, monkeypatch, name):
    """What holds rows of the tables is in as many tasks as they need, whatever the session's number of shuffle partitions."""
    from tallyloom.operators import opinion

    monkeypatch.setattr(opinion, "ROWS", 500, raising=False)
    ours = catalogue.QUERIES[name](spark, SF)
    plan = ours._jdf.queryExecution().executedPlan().toString()
    fixed = re.findall(rf"hashpartitioning\((.*), {spark.conf.get('spark.sql.shuffle.partitions')}\)", plan)
    assert not [keys for keys in fixed if re.search(DEALT[name], keys)]
    assert rows(ours.toPandas()) == rows(duck.sql(catalogue.ORACLES[name]).df())
