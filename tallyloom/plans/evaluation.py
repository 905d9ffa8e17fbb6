"""Queries of judgements and their evaluation, with SQL twins. Events and labels stand in for judged records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import judgement, metrics
from tallyloom.plans.registry import query, table

JUDGED = """event_id AS id; event_type AS platform; CAST(event_id % 100 AS DOUBLE) / 100 AS p_bot; value / (1 + abs(value)) AS score; user_id % 4 <> 0 AS relevant;
CASE user_id % 3 WHEN 0 THEN 'BULLISH' WHEN 1 THEN 'BEARISH' ELSE 'NEUTRAL' END AS direction; CASE event_id % 4 WHEN 0 THEN 'ORGANIC' WHEN 1 THEN 'UNCERTAIN' ELSE 'SUSPECTED_COORDINATED' END AS authenticity;
CASE WHEN event_id % 100 >= 80 THEN 'EXCLUDE' WHEN event_id % 100 >= 50 THEN 'DOWNWEIGHT_REVIEW' ELSE 'ACCEPT' END AS gate"""
_COLUMNS = [c.strip() for c in JUDGED.replace("\n", " ").split(";")]
_J = f"WITH j AS (SELECT {', '.join(_COLUMNS)} FROM events)"


def _judged(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(*_COLUMNS)


def _weighted(where: str, weight: str) -> str:
    return f"sum(({weight}) * score) FILTER (WHERE relevant AND {where}) / nullif(sum({weight}) FILTER (WHERE relevant AND {where}), 0)"


_SUMMED = f"""count(*) FILTER (WHERE gate = 'ACCEPT') AS accepted, count(*) FILTER (WHERE gate = 'DOWNWEIGHT_REVIEW') AS downweighted, count(*) FILTER (WHERE gate = 'EXCLUDE') AS excluded, count(*) FILTER (WHERE relevant) AS relevant_rows,
count(*) FILTER (WHERE relevant AND gate = 'ACCEPT') AS relevant_accepted, count(*) FILTER (WHERE relevant AND gate = 'EXCLUDE') AS relevant_excluded, {_weighted("gate <> 'EXCLUDE'", "1 - p_bot")} AS default_score, {_weighted("true", "1 - p_bot")} AS soft_score, {_weighted("gate = 'ACCEPT'", "1 - p_bot")} AS organic_score, {_weighted("gate = 'EXCLUDE'", "p_bot")} AS suspected_score,
{", ".join(f"sum(1 - p_bot) FILTER (WHERE relevant AND gate <> 'EXCLUDE' AND direction = '{d}') AS weight_{d.lower()}" for d in ("BULLISH", "BEARISH", "NEUTRAL"))}"""
_NUMBERS = ("default_score", "soft_score", "organic_score", "suspected_score", "weight_bullish", "weight_bearish", "weight_neutral", "divergence")


@query(f"{_J}, s AS (SELECT {_SUMMED} FROM j), d AS (SELECT *, CASE WHEN relevant_accepted >= 10 AND relevant_excluded >= 10 THEN suspected_score - organic_score END AS divergence FROM s) SELECT accepted, downweighted, excluded, relevant_rows, relevant_accepted, relevant_excluded, {', '.join(f'round({n}, 6) AS {n}' for n in _NUMBERS)} FROM d")
def layered_summary(spark, sf_dir):
    out = judgement.layered_summary(_judged(spark, sf_dir))
    return out.select("accepted", "downweighted", "excluded", "relevant_rows", "relevant_accepted", "relevant_excluded", *(F.round(n, 6).alias(n) for n in _NUMBERS))


@query(f"{_J}, w AS (SELECT sum((1 - p_bot) * score) / sum(1 - p_bot) AS organic_score, sum(1 - p_bot) AS organic_weight, sum(p_bot * score) / sum(p_bot) AS suspected_score, sum(p_bot) AS suspected_weight FROM j) SELECT round(organic_score, 6) AS organic_score, round(organic_weight, 4) AS organic_weight, round(suspected_score, 6) AS suspected_score, round(suspected_weight, 4) AS suspected_weight, round(suspected_score - organic_score, 6) AS raw_difference, CASE WHEN least(organic_weight, suspected_weight) >= 10 THEN round(suspected_score - organic_score, 6) END AS divergence, CASE WHEN least(organic_weight, suspected_weight) >= 10 THEN 'EXPERIMENTAL' ELSE 'INSUFFICIENT_WEIGHT' END AS state FROM w")
def mass_divergence(spark, sf_dir):
    rows = _judged(spark, sf_dir).withColumn("organic", 1 - F.col("p_bot"))
    out = judgement.divergence(rows, "organic", "p_bot", "score")
    return out.select(*(F.round(c, 6).alias(c) for c in ("organic_score", "suspected_score", "raw_difference", "divergence")), *(F.round(c, 4).alias(c) for c in ("organic_weight", "suspected_weight")), "state")


@query(f"{_J} SELECT id, concat_ws(',', CASE WHEN id % 5 = 0 THEN 'BEHAVIOR_DATA_INCOMPLETE' END, CASE WHEN authenticity = 'UNCERTAIN' THEN 'AUTHENTICITY_UNCERTAIN' END, CASE WHEN (p_bot >= 0.8 AND authenticity = 'ORGANIC') OR (p_bot < 0.5 AND authenticity = 'SUSPECTED_COORDINATED') THEN 'AUTH_PROBABILITY_LABEL_CONFLICT' END, CASE WHEN NOT relevant THEN 'RELEVANCE_DIRECTION_CONFLICT' END, CASE WHEN greatest(p_bot, 1 - p_bot) < 0.6 THEN 'LOW_DIRECTION_SEPARATION' END) AS flags FROM j")
def judgement_review_flags(spark, sf_dir):
    rows = _judged(spark, sf_dir).withColumn("missing", F.when(F.col("id") % 5 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))).withColumn("probabilities", F.create_map(F.lit("BULLISH"), F.col("p_bot").cast("double"), F.lit("BEARISH"), (1 - F.col("p_bot")).cast("double")))
    return rows.select("id", F.concat_ws(",", judgement.review_flags()).alias("flags"))


@query("SELECT doc_id, CASE WHEN start_ < 0 OR start_ + 9 > length(text) OR substr(text, start_ + 1, 9) <> substr(text, 3, 9) THEN 'REVIEW_INVALID_EVIDENCE' WHEN doc_id % 5 = 0 OR doc_id % 3 <> 0 THEN 'EXTERNAL_NO_TARGET_DIRECTION' WHEN doc_id % 2 = 0 THEN 'PASS' ELSE 'REVIEW_SUBJECT_RELATION' END AS gate FROM (SELECT *, CASE WHEN doc_id % 7 = 0 THEN 4 ELSE 2 END AS start_ FROM documents)")
def unit_gates(spark, sf_dir):
    start = F.when(F.col("doc_id") % 7 == 0, 4).otherwise(2)
    relation = F.when(F.col("doc_id") % 5 == 0, "EXTERNAL").when(F.col("doc_id") % 2 == 0, "PRIMARY_SUBJECT").otherwise("PEER")
    subject = F.concat((F.col("doc_id") % 3).cast("string"), F.lit(".SH"))
    gate = judgement.unit_gate(F.col("text"), F.substring("text", 3, 9), start, start + 9, subject, relation, F.lit("0.SZ"))
    return table(spark, sf_dir, "documents").select("doc_id", gate.alias("gate"))


@query("SELECT event_id AS id, event_id % 3 <> 0 AND p + r BETWEEN 0.98 AND 1.02 AND p <= 1 AS sound, CASE WHEN event_id % 3 <> 0 THEN round(p - r, 6) END AS directional FROM (SELECT event_id, (event_id % 120) / 100.0 AS p, abs(1 - (event_id % 120) / 100.0) + CASE WHEN event_id % 7 = 0 THEN 0.5 ELSE 0 END AS r FROM events)")
def probability_soundness(spark, sf_dir):
    p = (F.col("event_id") % 120) / 100.0
    r = F.abs(1 - p) + F.when(F.col("event_id") % 7 == 0, 0.5).otherwise(0.0)
    given = F.when(F.col("event_id") % 3 != 0, F.create_map(F.lit("BULLISH"), p, F.lit("BEARISH"), r)).otherwise(F.create_map(F.lit("OTHER"), p))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), given.alias("probabilities"))
    return rows.select("id", judgement.sound_probabilities(F.col("probabilities"), ["BULLISH", "BEARISH"]).alias("sound"), F.round(judgement.directional_score(F.col("probabilities")), 6).alias("directional"))


@query(f"{_J}, u AS (SELECT *, direction = 'NEUTRAL' AS unknown FROM j) SELECT CASE WHEN platform IS NOT NULL THEN 'platform' WHEN direction IS NOT NULL THEN 'direction' WHEN gate IS NOT NULL THEN 'gate' ELSE 'all' END AS dimension, coalesce(platform, direction, gate) AS value, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(unknown::INT), 6) AS unknown_rate FROM u GROUP BY GROUPING SETS ((), (platform), (direction), (gate))")
def judgement_summary(spark, sf_dir):
    return metrics.summary(_judged(spark, sf_dir), ["NEUTRAL"])


_SETS = "WITH r AS (SELECT l.doc_id, l.quality, l.toxic, d.n_chars FROM labels l JOIN documents d USING (doc_id)), g AS (SELECT 'first' AS task, doc_id, 'quality' AS label FROM r WHERE quality = 1 UNION SELECT 'second', doc_id, 'toxic' FROM r WHERE toxic = 1 UNION SELECT 'second', doc_id, 'both' FROM r WHERE toxic = 1 AND quality = 1), q AS (SELECT 'first' AS task, doc_id, 'quality' AS label FROM r WHERE n_chars > 500 UNION SELECT 'second', doc_id, 'toxic' FROM r WHERE n_chars > 3000 UNION SELECT 'second', doc_id, 'both' FROM r WHERE n_chars > 9000), f AS (SELECT task, label, count(*) FILTER (WHERE g.doc_id IS NOT NULL AND q.doc_id IS NOT NULL) AS tp, count(*) FILTER (WHERE g.doc_id IS NULL) AS fp, count(*) FILTER (WHERE q.doc_id IS NULL) AS fn FROM g FULL JOIN q USING (task, doc_id, label) GROUP BY ALL)"
_SCORED = "round(sum(tp) * 1.0 / nullif(sum(tp) + sum(fp), 0), 6) AS precision, round(sum(tp) * 1.0 / nullif(sum(tp) + sum(fn), 0), 6) AS recall, round(avg(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)), 6) AS macro_f1, round(2.0 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 6) AS micro_f1"


def _sets(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")

    def side(quality, toxic, both):
        one = lambda task, label, c: F.when(c, F.struct(F.lit(task).alias("task"), F.lit(label).alias("label")))
        marks = F.array_compact(F.array(one("first", "quality", quality), one("second", "toxic", toxic), one("second", "both", both)))
        return rows.select(F.col("doc_id").alias("sample_id"), F.explode(marks).alias("m")).select("m.task", "sample_id", "m.label")

    gold = side(F.col("quality") == 1, F.col("toxic") == 1, (F.col("quality") == 1) & (F.col("toxic") == 1))
    return gold, side(F.col("n_chars") > 500, F.col("n_chars") > 3000, F.col("n_chars") > 9000)


@query(f"{_SETS} SELECT task, {_SCORED} FROM f GROUP BY task")
def task_scores(spark, sf_dir):
    return metrics.task_scores(*_sets(spark, sf_dir))


@query(f"{_SETS} SELECT {_SCORED} FROM f WHERE task = 'second'")
def label_set_scores(spark, sf_dir):
    gold, predicted = _sets(spark, sf_dir)
    return metrics.set_scores(gold.where("task = 'second'"), predicted.where("task = 'second'"), "sample_id", "label")


_CLOSED = "WITH j AS (SELECT d.lang AS gold, CASE WHEN l.quality = 1 THEN 'en' ELSE CASE WHEN l.doc_id % 2 = 0 THEN 'fr' ELSE 'de' END END AS predicted, 0.1 * (1 + l.doc_id % 7) AS c FROM labels l JOIN documents d USING (doc_id) WHERE l.quality IS NOT NULL)"
_F1 = "coalesce(2.0 * t.tp / nullif(t.support + t.predicted, 0), 0)"


@query(f"{_CLOSED}, t AS (SELECT x AS label, count(*) FILTER (WHERE gold = x) AS support, count(*) FILTER (WHERE predicted = x) AS predicted, count(*) FILTER (WHERE gold = x AND predicted = x) AS tp FROM j, (VALUES ('de'), ('en'), ('es'), ('fr')) v(x) GROUP BY x), b AS (SELECT least(9, floor(c * 10)) AS bin, count(*) AS n, abs(avg(c) - avg((gold = predicted)::INT)) AS gap, sum(CASE WHEN gold = predicted THEN (c - 1) ** 2 + (1 - c) ** 2 / 3 ELSE c ** 2 + ((1 - c) / 3 - 1) ** 2 + 2 * ((1 - c) / 3) ** 2 END) AS brier FROM j GROUP BY bin) SELECT (SELECT sum(n)::BIGINT FROM b) AS n, (SELECT round(avg({_F1}), 6) FROM t WHERE support > 0) AS macro_f1, (SELECT round(sum(brier) / sum(n), 6) FROM b) AS brier, (SELECT round(sum(n * gap) / sum(n), 6) FROM b) AS ece, CASE WHEN (SELECT min(support) FROM t) > 0 THEN 'MEASURED' ELSE 'PARTIAL_GOLD' END AS state")
def closed_set_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").where("quality is not null").join(table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("gold")), "doc_id")
    predicted = F.when(F.col("quality") == 1, "en").when(F.col("doc_id") % 2 == 0, "fr").otherwise("de")
    c = F.lit(0.1) * (1 + F.col("doc_id") % 7)
    rows = rows.select("gold", predicted.alias("predicted"), c.cast("double").alias("c"))
    labels = ["de", "en", "es", "fr"]
    share = F.create_map(*(x for name in labels for x in (F.lit(name), F.when(F.col("predicted") == name, F.col("c")).otherwise((1 - F.col("c")) / 3))))
    return metrics.closed_set(rows.select("gold", "predicted", share.alias("probabilities")), labels)[1]


@query()
def bootstrap_interval(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").where("quality is not null").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return metrics.bootstrap_accuracy(rows.select(F.col("quality").alias("gold"), (F.col("n_chars") > 500).cast("int").alias("predicted")))
