"""Queries of the rankings over validated comments, with their SQL twins.

Driver columns stand in for comments (orders) and views (line items). Each stand-in is one SQL expression, which both
engines read, so a query and its twin start from the same rows; they carry no meaning of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import dictionary, opinion, ranking, validation
from tallyloom.plans.registry import query, table

COMMENTS = """o_orderkey AS comment_key; o_orderpriority AS video; CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END AS user_id;
o_orderstatus || '-' || CAST(o_custkey % 97 AS STRING) AS text; CASE WHEN o_custkey % 4 = 0 THEN CAST(o_custkey % 31 AS STRING) END AS copies;
CASE WHEN o_orderkey % 7 <> 0 THEN CAST(floor(o_totalprice / 1000) AS BIGINT) END AS likes; CASE WHEN o_orderkey % 17 <> 0 THEN o_orderdate END AS time; o_orderkey % 13 <> 0 AS valid;
CASE o_orderkey % 9 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'PARTIAL' ELSE 'SUCCESS' END AS status; CASE WHEN o_orderkey % 19 = 0 THEN 'FAIL' WHEN o_orderkey % 3 <> 0 THEN 'PASS' END AS identity_status"""
VIEWS = """l_orderkey AS comment_key; l_linenumber AS ordinal; 'e' || CAST(l_suppkey AS STRING) AS entity_id; CASE WHEN l_partkey % 11 = 0 THEN 'UNRESOLVED' ELSE 'RESOLVED' END AS resolution;
CASE l_returnflag WHEN 'A' THEN 'BULLISH' WHEN 'R' THEN 'BEARISH' ELSE CASE WHEN l_linenumber % 2 = 0 THEN 'NEUTRAL' ELSE 'UNKNOWN' END END AS stance;
CASE CAST(l_quantity AS INT) % 7 WHEN 0 THEN 'BUY' WHEN 1 THEN 'HOLD' WHEN 2 THEN 'WATCH' WHEN 3 THEN 'AVOID' WHEN 4 THEN 'SELL' WHEN 5 THEN 'WAIT' ELSE 'UNKNOWN' END AS action;
CASE l_partkey % 4 WHEN 0 THEN 'RECOMMENDATION' WHEN 1 THEN 'RECOMMENDATION' WHEN 2 THEN 'SELF_POSITION' ELSE 'QUESTION' END AS speech_act;
CASE (l_orderkey + l_linenumber) % 4 WHEN 2 THEN 'PARENT_CONTEXT' WHEN 3 THEN 'VIDEO_PROMPT_CONTEXT' ELSE 'EXPLICIT_COMMENT' END AS basis; l_linenumber % 3 AS n_rationales;
CASE WHEN l_linestatus = 'O' OR l_partkey % 2 = 0 THEN 'PASS' ELSE 'FAIL' END AS entity_gate; CASE WHEN l_partkey % 5 = 0 THEN 'REVIEW' ELSE 'PASS' END AS stance_gate; CASE WHEN l_partkey % 6 = 0 THEN 'REVIEW' ELSE 'PASS' END AS action_gate;
CASE WHEN l_partkey % 7 = 0 THEN 'REVIEW' ELSE 'PASS' END AS speech_gate; CASE WHEN l_suppkey % 3 = 0 THEN 'REVIEW' ELSE 'PASS' END AS context_gate"""
RATIONALES = """l_orderkey AS comment_key; 'e' || CAST(l_suppkey AS STRING) AS entity_id; l_linenumber AS ordinal; 'R' || CAST(l_partkey % 6 AS STRING) AS reason_code; CASE l_returnflag WHEN 'A' THEN 'BULLISH' ELSE 'BEARISH' END AS stance;
CASE WHEN l_partkey % 5 = 0 THEN 'REVIEW' ELSE 'PASS' END AS stance_gate; 's' || CAST(l_partkey AS STRING) AS summary; CASE WHEN l_linenumber % 4 = 0 THEN 'FAIL' ELSE 'PASS' END AS gate"""
METHODS = """l_orderkey AS comment_key; l_linenumber AS ordinal; 'M' || CAST(l_partkey % 14 AS STRING) AS method; CASE l_returnflag WHEN 'A' THEN 'SUPPORT' WHEN 'R' THEN 'OPPOSE' ELSE 'ASK' END AS attitude;
CASE WHEN l_suppkey % 4 = 0 THEN 'FAIL' ELSE 'PASS' END AS type_gate; CASE WHEN l_suppkey % 5 = 0 THEN 'REVIEW' ELSE 'PASS' END AS attitude_gate"""
RISKS = """l_orderkey AS comment_key; 'K' || CAST(l_partkey % 4 AS STRING) AS rule; l_returnflag AS attitude; CASE WHEN l_suppkey % 4 = 0 THEN 'FAIL' ELSE 'PASS' END AS type_gate; CASE WHEN l_suppkey % 5 = 0 THEN 'REVIEW' ELSE 'PASS' END AS attitude_gate"""


def _columns(spec: str) -> list[str]:
    return [c.strip() for c in spec.replace("\n", " ").split(";")]


def _bound(spark: SparkSession, sf_dir: str, name: str, spec: str) -> DataFrame:
    return table(spark, sf_dir, name).selectExpr(*_columns(spec))


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bound(spark, sf_dir, "orders", COMMENTS)


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bound(spark, sf_dir, "lineitem", VIEWS)


def _from(spec: str, name: str) -> str:
    return f"SELECT {', '.join(_columns(spec))} FROM {name}"


_ADVICE = "coalesce(speech_gate = 'PASS', false) AND speech_act = 'RECOMMENDATION' AND action NOT IN ('AVOID', 'SELL', 'WAIT')"
_DID = ", ".join(f"bool_or(action_gate = 'PASS' AND action = '{a}') AS did_{a.lower()}" for a in opinion.ACTIONS)
_ONE = "CASE WHEN count(DISTINCT {0}) FILTER (WHERE {0}_gate = 'PASS' AND {0} <> 'UNKNOWN') = 1 THEN min({0}) FILTER (WHERE {0}_gate = 'PASS' AND {0} <> 'UNKNOWN') ELSE 'UNKNOWN' END AS {0}"
BASE = f"""WITH c AS ({_from(COMMENTS, "orders")}), v AS ({_from(VIEWS, "lineitem")}),
ok AS (SELECT * FROM c WHERE valid AND status IN ('SUCCESS', 'PARTIAL') AND coalesce(identity_status, 'PASS') = 'PASS'),
a AS (SELECT v.* FROM v JOIN ok USING (comment_key) WHERE entity_gate = 'PASS' AND resolution = 'RESOLVED'),
e AS (SELECT entity_id, comment_key, {_ONE.format("stance")}, {_ONE.format("action")}, sum(n_rationales)::BIGINT AS n_rationales, bool_or({_ADVICE} AND basis = 'EXPLICIT_COMMENT') AS explicit, bool_or({_ADVICE} AND context_gate = 'PASS' AND basis IN ('VIDEO_PROMPT_CONTEXT', 'PARENT_CONTEXT')) AS contextual,
  bool_or({_ADVICE} AND (basis = 'EXPLICIT_COMMENT' OR context_gate = 'PASS')) AS recommended, bool_or(speech_gate = 'PASS' AND speech_act = 'SELF_POSITION') AS self_position, bool_or(speech_gate = 'PASS' AND speech_act = 'SELF_POSITION' AND action_gate = 'PASS' AND action = 'BUY') AS self_buy,
  bool_or(action_gate = 'PASS' AND action IN ('AVOID', 'SELL')) AS avoided, bool_or(action_gate = 'PASS') AS acted, {_DID} FROM a GROUP BY ALL)"""
_LIKED = "g AS (SELECT comment_key, CASE WHEN likes IS NOT NULL THEN (rank() OVER (PARTITION BY video, likes IS NULL ORDER BY likes) - 1 + (count(*) OVER (PARTITION BY video, likes) - 1) / 2.0) / greatest(1, count(likes) OVER (PARTITION BY video) - 1) END AS engagement FROM c WHERE valid)"
RANKS = f"""{BASE}, {_LIKED}, r AS (SELECT entity_id, count(*) AS mentions, count(*) FILTER (WHERE explicit) AS explicit_count, count(*) FILTER (WHERE contextual) AS context_count, count(*) FILTER (WHERE recommended) AS recommendation_count, count(*) FILTER (WHERE self_position) AS self_position_count, count(*) FILTER (WHERE self_buy) AS self_buy_count,
  {", ".join(f"count(*) FILTER (WHERE did_{a.lower()}) AS {a.lower()}_count" for a in opinion.ACTIONS)}, count(*) FILTER (WHERE NOT acted) AS unknown_action_count, {", ".join(f"count(*) FILTER (WHERE stance = '{s}') AS {s.lower()}" for s in opinion.STANCES)},
  count(DISTINCT coalesce(text, comment_key::VARCHAR)) AS unique_texts, count(DISTINCT coalesce(copies, comment_key::VARCHAR)) AS unique_groups, nullif(count(DISTINCT user_id), 0) AS users, round(avg((user_id IS NOT NULL)::INT), 6) AS user_coverage, count(engagement) AS engagement_comments,
  coalesce(sum(1 + engagement) FILTER (WHERE stance = 'BULLISH'), 0) AS up, coalesce(sum(1 + engagement) FILTER (WHERE stance = 'BEARISH'), 0) AS down FROM e JOIN c USING (comment_key) LEFT JOIN g USING (comment_key) GROUP BY entity_id),
ranks AS (SELECT * EXCLUDE (up, down), round(ln((1.0 + bullish) / (1 + bearish)), 4) AS bullish_index, round(bullish * 1.0 / nullif(bullish + bearish, 0), 6) AS bull_ratio, round(2.0 * least(bullish, bearish) / nullif(bullish + bearish, 0), 6) AS disagreement,
  CASE WHEN bullish + bearish >= 10 THEN 'SUFFICIENT' ELSE 'INSUFFICIENT' END AS sample_status, round(up / nullif(up + down, 0), 6) AS engagement_ratio FROM r)"""


@query(f"{RANKS} SELECT * FROM ranks")
def consensus_ranking(spark, sf_dir):
    return opinion.entity_ranking(views(spark, sf_dir), comments(spark, sf_dir))


@query(f"{BASE}, t AS (SELECT video, count(*) AS total FROM c WHERE valid GROUP BY video), s AS (SELECT entity_id, video, count(*) AS n FROM e JOIN c USING (comment_key) GROUP BY ALL) SELECT e.entity_id, count(s.n) AS video_count, count(*) AS video_total, round(avg(coalesce(s.n, 0) * 1.0 / t.total), 6) AS balanced_score FROM (SELECT DISTINCT entity_id FROM e) e CROSS JOIN t LEFT JOIN s ON s.entity_id = e.entity_id AND s.video = t.video GROUP BY e.entity_id")
def consensus_video_rates(spark, sf_dir):
    return opinion.video_rates(views(spark, sf_dir), comments(spark, sf_dir))


@query(f"{BASE}, q AS ({_from(RATIONALES, 'lineitem')}), k AS (SELECT q.* FROM q JOIN (SELECT DISTINCT entity_id, comment_key FROM a) USING (entity_id, comment_key) WHERE gate = 'PASS'), w AS (SELECT entity_id, reason_code, CASE WHEN stance_gate = 'PASS' THEN stance ELSE 'UNKNOWN' END AS stance, count(DISTINCT comment_key) AS mentions, count(*) AS evidence, first(summary ORDER BY comment_key, ordinal, summary) AS summary FROM k GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY evidence DESC, reason_code, stance) AS place FROM w")
def consensus_rationales(spark, sf_dir):
    return opinion.rationale_groups(views(spark, sf_dir), comments(spark, sf_dir), _bound(spark, sf_dir, "lineitem", RATIONALES))


@query(f"{BASE} SELECT entity_id, 'RECOMMENDATION' AS kind, comment_key FROM e WHERE recommended UNION ALL SELECT entity_id, 'AVOID', comment_key FROM e WHERE avoided UNION ALL SELECT entity_id, stance, comment_key FROM e WHERE stance IN ('BULLISH', 'BEARISH')")
def consensus_evidence(spark, sf_dir):
    return opinion.evidence_keys(views(spark, sf_dir), comments(spark, sf_dir))


@query(f"{BASE} SELECT entity_id, comment_key, n_rationales, place FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY n_rationales DESC, comment_key) AS place FROM e) WHERE place <= 5")
def consensus_representatives(spark, sf_dir):
    out = opinion.representatives(views(spark, sf_dir), comments(spark, sf_dir))
    return out.select("entity_id", "comment_key", F.col("n_rationales").cast("long").alias("n_rationales"), F.col("place").cast("long").alias("place"))


_METHODS = f"{BASE}, m AS (SELECT method, comment_key, CASE WHEN attitude_gate = 'PASS' THEN attitude ELSE 'UNKNOWN' END AS attitude, row_number() OVER (PARTITION BY method, comment_key ORDER BY ordinal DESC, CASE WHEN attitude_gate = 'PASS' THEN attitude ELSE 'UNKNOWN' END DESC) AS last, attitude_gate FROM ({_from(METHODS, 'lineitem')}) JOIN ok USING (comment_key) WHERE type_gate = 'PASS')"


@query(f"{_METHODS}, n AS (SELECT method, count(*) AS n, count(*) FILTER (WHERE attitude = 'SUPPORT') AS support, count(*) FILTER (WHERE attitude = 'OPPOSE') AS oppose, count(*) FILTER (WHERE attitude = 'UNKNOWN') AS unknown FROM m WHERE last = 1 GROUP BY method) SELECT *, round(100.0 * n / (SELECT count(*) FROM ok), 6) AS percentage, round((support - oppose) * 1.0 / nullif(support + oppose, 0), 6) AS net_support, CASE WHEN support + oppose >= 10 THEN 'SUFFICIENT' ELSE 'INSUFFICIENT' END AS sample_status FROM n")
def method_ranking(spark, sf_dir):
    return opinion.method_ranking(_bound(spark, sf_dir, "lineitem", METHODS), comments(spark, sf_dir))


@query(f"{_METHODS}, s AS (SELECT DISTINCT method, comment_key FROM m WHERE attitude = 'SUPPORT') SELECT method, comment_key, place FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY comment_key) AS place FROM s) WHERE place <= 5")
def method_evidence(spark, sf_dir):
    out = opinion.method_evidence(_bound(spark, sf_dir, "lineitem", METHODS), comments(spark, sf_dir))
    return out.select("method", "comment_key", F.col("place").cast("long").alias("place"))


@query(f"{BASE} SELECT rule, attitude, count(DISTINCT comment_key) AS n FROM ({_from(RISKS, 'lineitem')}) JOIN ok USING (comment_key) WHERE type_gate = 'PASS' AND attitude_gate = 'PASS' GROUP BY ALL")
def risk_attitudes(spark, sf_dir):
    return opinion.risk_attitudes(_bound(spark, sf_dir, "lineitem", RISKS), comments(spark, sf_dir))


_DAY = "strftime(time + INTERVAL 8 HOUR, '%Y-%m-%d')"


@query(f"{BASE} SELECT {_DAY} AS day, count(*) AS n FROM ok GROUP BY ALL")
def comment_daily(spark, sf_dir):
    return opinion.daily(comments(spark, sf_dir))


@query(f"{BASE} SELECT entity_id, {_DAY} AS day, count(*) AS n FROM e JOIN c USING (comment_key) GROUP BY ALL")
def entity_daily(spark, sf_dir):
    return opinion.entity_daily(views(spark, sf_dir), comments(spark, sf_dir))


@query(f"WITH c AS ({_from(COMMENTS, 'orders')}) SELECT comment_key, status, CASE WHEN status = 'FAILED' THEN 'FAILURE' WHEN coalesce(identity_status, 'PASS') <> 'PASS' THEN 'IDENTITY_CONFLICT' ELSE 'FIELD_REVIEW' END AS reason FROM c WHERE valid AND (status <> 'SUCCESS' OR coalesce(identity_status, 'PASS') <> 'PASS')")
def review_queue(spark, sf_dir):
    return opinion.review_queue(comments(spark, sf_dir))


@query(f"WITH c AS ({_from(COMMENTS, 'orders')}), r AS (SELECT l_orderkey AS comment_key, max(CASE WHEN l_returnflag = 'R' THEN 'PARTIAL' ELSE 'SUCCESS' END) AS status FROM lineitem WHERE l_quantity > 45 GROUP BY l_orderkey) SELECT comment_key, coalesce(r.status, 'SKIPPED') AS status, CASE WHEN r.status IS NULL THEN CASE WHEN NOT valid THEN 'NOISE' WHEN comment_key % 5 = 0 THEN 'PENDING' ELSE 'PILOT_LIMIT' END ELSE 'done' END AS reason FROM c LEFT JOIN r USING (comment_key)")
def comment_results(spark, sf_dir):
    made = table(spark, sf_dir, "lineitem").where("l_quantity > 45").groupBy(F.col("l_orderkey").alias("comment_key")).agg(F.max(F.when(F.col("l_returnflag") == "R", "PARTIAL").otherwise("SUCCESS")).alias("status"))
    rows = comments(spark, sf_dir)
    out = opinion.with_results(rows, rows.where("comment_key % 5 = 0"), made.withColumn("reason", F.lit("done")))
    return out.select("comment_key", "status", "reason")


@query(f"WITH v AS ({_from(VIEWS, 'lineitem')}) SELECT field, state, count(*) AS n FROM (UNPIVOT v ON entity_gate, stance_gate, action_gate, speech_gate, context_gate INTO NAME field VALUE state) GROUP BY ALL")
def field_status_counts(spark, sf_dir):
    gates = ["entity_gate", "stance_gate", "action_gate", "speech_gate", "context_gate"]
    return views(spark, sf_dir).unpivot([], gates, "field", "state").groupBy("field", "state").agg(F.count("*").alias("n"))


_ENTITY = "'e' || CAST(s_suppkey AS STRING) AS entity_id; CASE WHEN s_nationkey % 3 = 0 THEN 'SECURITY' ELSE 'CONCEPT' END AS layer; CASE s_nationkey % 6 WHEN 0 THEN 'STOCK' WHEN 1 THEN 'ETF' WHEN 2 THEN 'INDEX' WHEN 3 THEN 'REIT' WHEN 4 THEN 'SECTOR' ELSE 'ODD' END AS category; CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey AS STRING) END AS code"
_BOARD = "CASE WHEN layer = 'SECURITY' AND category IN ('STOCK', 'ETF', 'REIT') THEN 'securities' WHEN category IN ('ASSET', 'INDEX', 'ETF', 'REIT') THEN 'assets' WHEN category = 'SECTOR' THEN 'sectors' WHEN category = 'STOCK' THEN 'unbound_companies' ELSE 'other' END"


def _boards(spark, sf_dir):
    rows = _bound(spark, sf_dir, "supplier", _ENTITY)
    return rows.select("entity_id", dictionary.board(F.col("entity_id"), F.col("layer"), F.col("category")).alias("board"), dictionary.product(F.col("category"), F.col("code")).alias("product"))


@query(f"WITH s AS ({_from(_ENTITY, 'supplier')}) SELECT entity_id, {_BOARD} AS board, CASE WHEN category IN ('ETF', 'REIT') THEN CASE WHEN code IS NOT NULL THEN '{dictionary.SPECIFIC_FUND}' ELSE '{dictionary.FUND_CONCEPT}' END ELSE category END AS product FROM s")
def board_routing(spark, sf_dir):
    return _boards(spark, sf_dir)


_TOP = "SELECT '{0}' AS branch, board, entity_id, place FROM (SELECT *, row_number() OVER ({1} ORDER BY {2}recommendation_count DESC, mentions DESC, entity_id) AS place FROM x WHERE {3}) WHERE place <= 3"


@query(f"{RANKS}, x AS (SELECT ranks.*, coalesce(board, 'other') AS board FROM ranks LEFT JOIN (SELECT entity_id, {_BOARD} AS board FROM ({_from(_ENTITY, 'supplier')})) USING (entity_id)) " + " UNION ALL ".join(_TOP.format(*b) for b in (("RECOMMENDED", "PARTITION BY board", "", "recommendation_count > 0"), ("AVOIDED", "", "avoid_count + sell_count DESC, ", "avoid_count + sell_count > 0"), ("DISPUTED", "", "disagreement DESC, ", "sample_status = 'SUFFICIENT' AND disagreement > 0"), ("DIRECTED", "", "abs(bullish_index) DESC, ", "sample_status = 'SUFFICIENT'"))))
def insight_branches(spark, sf_dir):
    ranks = opinion.entity_ranking(views(spark, sf_dir), comments(spark, sf_dir))
    return opinion.insights(ranks, _boards(spark, sf_dir))


_QUOTED = "substr(text, 5, 12)"
_SPOT = "({q} <> '' AND (length(text) >= 16 OR strpos(substr(text, strpos(text, {q}) + 1), {q}) = 0))".format(q=_QUOTED)


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_SPOT} AS good, doc_id % 5 = 1 AS lost FROM documents),
g AS (SELECT doc_id, CASE WHEN good AND NOT lost THEN 'PASS' ELSE 'FAIL' END AS entity, CASE WHEN doc_id % 4 = 0 OR (doc_id % 4 = 1 AND NOT good) OR doc_id % 4 = 3 OR doc_id % 6 = 0 THEN 'REVIEW' ELSE 'PASS' END AS speech_act,
CASE WHEN doc_id % 3 = 0 OR NOT good THEN 'REVIEW' ELSE 'PASS' END AS stance, CASE WHEN NOT good THEN 'FAIL' WHEN doc_id % 7 = 0 THEN 'REVIEW' WHEN doc_id % 2 = 1 THEN 'REVIEW' WHEN doc_id % 4 IN (1, 3) THEN 'FAIL' ELSE 'PASS' END AS action,
CASE WHEN doc_id % 4 = 0 OR (doc_id % 4 = 1 AND NOT good) OR doc_id % 4 = 3 THEN 'REVIEW' ELSE 'PASS' END AS context, CASE WHEN good THEN 'PASS' ELSE 'FAIL' END AS condition FROM d)
SELECT *, CASE WHEN entity <> 'PASS' OR speech_act <> 'PASS' OR stance <> 'PASS' OR action <> 'PASS' OR context <> 'PASS' OR condition <> 'PASS' THEN 'PARTIAL' ELSE 'SUCCESS' END AS status FROM g""")
def field_gates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("raw_comment"))
    at = F.col("doc_id")
    # evidence at its place, or for one row in five from a source that it does not stand in
    quote = F.substring("raw_comment", 5, 12)
    evidence = lambda source, lost=False: F.when(F.lit(True), F.struct(F.lit(source).alias("source"), F.when(F.lit(lost) & (at % 5 == 1), F.concat(F.lit("\1"), quote)).otherwise(quote).alias("quote"), F.lit(4).alias("start"), F.lit(16).alias("end")))
    basis = F.when(at % 4 == 0, "UNKNOWN").when(at % 4 == 1, "PARENT_CONTEXT").when(at % 4 == 2, "EXPLICIT_COMMENT").otherwise("VIDEO_PROMPT_CONTEXT")
    none = F.lit(None).cast(validation.EVIDENCE)
    view = F.struct(
        F.lit("e").alias("entity"), F.lit("STOCK").alias("category"), F.when(at % 6 == 0, "UNKNOWN").otherwise("OPINION").alias("speech_act"), basis.alias("intent_basis"), (at % 2 == 0).alias("explicit_action"), F.when(at % 3 == 0, "UNKNOWN").otherwise("BULLISH").alias("stance"),
        F.when(at % 7 == 0, "UNKNOWN").otherwise("BUY").alias("action"), evidence("COMMENT", True).alias("evidence"), evidence("PARENT").alias("context_evidence"), evidence("COMMENT").alias("stance_evidence"), evidence("COMMENT").alias("action_evidence"), evidence("COMMENT").alias("condition"), none.alias("horizon"), F.array().cast(f"array<{validation.EVIDENCE}>").alias("rationales"),
    )
    analysis = F.struct(F.array().cast("array<string>").alias("intents"), F.lit(False).alias("needs_review"), F.array(view.cast(validation.VIEW)).alias("views"), F.array().cast(f"array<{validation.METHOD}>").alias("methods"), F.array().cast(f"array<{validation.RISK}>").alias("risks"))
    context = F.struct(F.lit("").alias("video_text"), F.col("raw_comment").alias("parent_comment"), F.lit("").alias("root_comment"), F.lit(False).alias("solicitation_verified"))
    rows = docs.select("doc_id", "raw_comment", context.alias("context"), F.array().cast("array<string>").alias("conflicts"), analysis.alias("analysis"))
    out = validation.validate(rows).withColumn("s", F.col("view_status")[0])
    return out.select("doc_id", *(F.col(f"s.{g}").alias(g) for g in ("entity", "speech_act", "stance", "action", "context", "condition")), "status")


@query("SELECT o_orderpriority, o_orderkey, place FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256(o_orderkey::VARCHAR)) AS place FROM orders) WHERE place <= 10")
def audit_pick(spark, sf_dir):
    out = ranking.audit_pick(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey")
    return out.select("o_orderpriority", "o_orderkey", F.col("place").cast("long").alias("place"))
