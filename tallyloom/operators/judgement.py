"""Judgements of records with probabilities: checked, flagged, gated, fused and summed up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def available_weight(weights: dict[str, float]) -> Column:
    """The weight of the columns that are not null."""
    return sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))


def fuse(weights: dict[str, float]) -> Column:
    """Weighted mean of the non-null columns, weights renormalised; null where all are null."""
    return sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0)) / F.nullif(available_weight(weights), F.lit(0.0))


def components() -> dict[str, Column]:
    """The parts of a coordination score, each 0 to 1 or null, from judged, similarity, cluster_size, zscore, reuse, hour_count."""
    clip = lambda c: F.when(c.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))
    return {
        "judged": F.col("judged"), "similarity": F.when(F.col("similarity").isNull(), None).when(F.col("cluster_size") > 1, F.col("similarity")).otherwise(0.0),
        "burst": clip(F.col("zscore") / 5), "template": F.col("reuse"), "author": clip((F.col("hour_count") - 1) / 10),
    }


def gate(p: Column, exclude: float = 0.8, review: float = 0.5) -> Column:
    return F.when(p >= exclude, "EXCLUDE").when(p >= review, "DOWNWEIGHT_REVIEW").otherwise("ACCEPT")


def unit_gate(text: Column, quote: Column, start: Column, end: Column, subject: Column, relation: Column, target: Column) -> Column:
    """Whether an atomic unit may be judged: its quote stands at its place, it is about the target, as a main subject.

    Codes are compared before their dot. Places are code points from 0, the end exclusive.
    """
    stands = (start >= 0) & (start < end) & (end <= F.length(text)) & (F.substring(text, start + 1, end - start) == quote)
    code = lambda c: F.substring_index(F.coalesce(c, F.lit("")), ".", 1)
    related = F.coalesce(relation, F.lit("UNKNOWN"))
    return (
        F.when(~F.coalesce(stands, F.lit(False)), "REVIEW_INVALID_EVIDENCE").when((related == "EXTERNAL") | (code(subject) != code(target)), "EXTERNAL_NO_TARGET_DIRECTION")
        .when(~related.isin("PRIMARY_SUBJECT", "PRIMARY"), "REVIEW_SUBJECT_RELATION").otherwise("PASS")
    )


def sound_probabilities(p: Column, labels: list[str]) -> Column:
    """Whether a map has exactly these labels, and values of 0 to 1 that sum to 1 within 0.02."""
    values = F.map_values(p)
    same = F.array_sort(F.map_keys(p)) == F.array(*(F.lit(x) for x in sorted(labels)))
    inside = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v <= 1))
    total = F.aggregate(values, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    return F.coalesce(same & inside & (F.abs(total - 1) <= 0.02), F.lit(False))


def directional_score(p: Column) -> Column:
    return p["BULLISH"] - p["BEARISH"]


def _named(**flags: Column) -> Column:
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), name) for name, c in flags.items())))


def _winner(p: Column) -> Column:
    return F.array_max(F.map_values(p))


def review_flags(exclude: float = 0.8, review: float = 0.5) -> Column:
    """Of two-layer rows (missing, authenticity, p_bot, relevant, direction, probabilities): why a person should look."""
    label = F.col("authenticity")
    return _named(
        BEHAVIOR_DATA_INCOMPLETE=F.size("missing") > 0, AUTHENTICITY_UNCERTAIN=label == "UNCERTAIN",
        AUTH_PROBABILITY_LABEL_CONFLICT=((F.col("p_bot") >= exclude) & (label == "ORGANIC")) | ((F.col("p_bot") < review) & (label == "SUSPECTED_COORDINATED")),
        RELEVANCE_DIRECTION_CONFLICT=~F.col("relevant") & (F.col("direction") != "NOT_APPLICABLE"), LOW_DIRECTION_SEPARATION=_winner(F.col("probabilities")) < 0.6,
    )


def pilot_flags() -> Column:
    """Of single-layer rows (relevant, direction, claim, action, action_status, probabilities): why a person should look."""
    directed = F.col("direction").isin("BULLISH", "BEARISH")
    return _named(
        IRRELEVANT_WITH_LABEL=~F.col("relevant") & (F.col("direction") != "NOT_APPLICABLE"), FACT_WITH_DIRECTION=(F.col("claim") == "FACT") & directed,
        ACTION_STATUS_CONFLICT=(F.col("action") == "NONE") != (F.col("action_status") == "NONE"), LOW_DIRECTION_SEPARATION=_winner(F.col("probabilities")) < 0.6,
    )


def evidence_flags() -> Column:
    """Of feature rows (copies, cluster_size, concentrated): what speaks for coordination in the sample."""
    return _named(EXACT_REPEAT_IN_SAMPLE=F.col("copies") > 1, NEAR_REPEAT_IN_SAMPLE=F.col("cluster_size") > 1, SAMPLE_TIME_CONCENTRATION=F.col("concentrated"))


def missing_features() -> Column:
    """Of feature rows (author, clock, z): what could not be worked out."""
    return _named(STABLE_AUTHOR_ID_MISSING=F.col("author").isNull(), TIME_MISSING_OR_UNZONED=F.col("clock").isNull(), ENGAGEMENT_BASELINE_UNAVAILABLE_OR_DEGENERATE=F.col("z").isNull())


def weighted_mean(score: Column, weight: Column) -> Column:
    return F.sum(weight * score) / F.nullif(F.sum(weight), F.lit(0.0))


def divergence(rows: DataFrame, organic: str, suspected: str, score: str, least: float = 10.0) -> DataFrame:
    """One row: the mean scores weighted by each mass, the masses, and their difference, shown from `least` mass on each side."""
    out = rows.agg(weighted_mean(F.col(score), F.col(organic)).alias("organic_score"), F.sum(organic).alias("organic_weight"), weighted_mean(F.col(score), F.col(suspected)).alias("suspected_score"), F.sum(suspected).alias("suspected_weight"))
    enough = F.coalesce(F.least("organic_weight", "suspected_weight") >= least, F.lit(False))
    apart = F.col("suspected_score") - F.col("organic_score")
    return out.select("*", apart.alias("raw_difference"), F.when(enough, apart).alias("divergence"), F.when(enough, "EXPERIMENTAL").otherwise("INSUFFICIENT_WEIGHT").alias("state"))


def cut_sensitivity(rows: DataFrame, p: str, score: str, cuts: list[float]) -> DataFrame:
    """For each cut: rows under it, and the mean of their scores weighted by 1 - p; one pass, one row of partial sums."""
    stats = [F.struct(F.lit(c).alias("cut"), F.count_if(F.col(p) < c).alias("kept"), F.round(weighted_mean(F.when(F.col(p) < c, F.col(score)), F.when(F.col(p) < c, 1 - F.col(p))), 6).alias("mean_score")) for c in cuts]
    return rows.agg(F.array(*stats).alias("x")).select(F.inline("x"))


def layered_summary(rows: DataFrame, least: int = 10) -> DataFrame:
    """One row over complete rows (gate, p_bot, relevant, direction, score): counts by gate, four weighted scores, weighted
    directions of the rows not excluded, and the difference of suspected and organic where both groups have `least` rows."""
    of = lambda c: F.col("relevant") & c
    accept, down, out_ = (F.col("gate") == g for g in ("ACCEPT", "DOWNWEIGHT_REVIEW", "EXCLUDE"))
    soft, hard = 1 - F.col("p_bot"), F.col("p_bot")
    mean = lambda c, w: weighted_mean(F.when(of(c), F.col("score")), F.when(of(c), w))
    counts = [F.count_if(c).alias(n) for n, c in (("accepted", accept), ("downweighted", down), ("excluded", out_), ("relevant_rows", F.col("relevant")), ("relevant_accepted", of(accept)), ("relevant_excluded", of(out_)))]
    scores = [mean(accept | down, soft).alias("default_score"), mean(F.lit(True), soft).alias("soft_score"), mean(accept, soft).alias("organic_score"), mean(out_, hard).alias("suspected_score")]
    directions = [F.coalesce(F.sum(F.when(of(accept | down) & (F.col("direction") == d), soft)), F.lit(0.0)).alias(f"weight_{d.lower()}") for d in ("BULLISH", "BEARISH", "NEUTRAL")]
    both = (F.col("relevant_accepted") >= least) & (F.col("relevant_excluded") >= least)
    return rows.agg(*counts, *scores, *directions).withColumn("divergence", F.when(both, F.col("suspected_score") - F.col("organic_score")))


def compared(results: DataFrame, baseline: DataFrame) -> DataFrame:
    """results (id, cid, platform, text, direction) with the baseline's direction, where exactly one baseline row is the same.

    baseline: cid, platform, text, units array of (subject_relation, stance). MIXED where its main units point both ways.
    """
    keys = ["cid", "platform", "text"]
    only = baseline.groupBy(*keys).agg(F.count("*").alias("_n"), F.any_value("units").alias("units")).where("_n = 1").drop("_n")
    stances = F.array_intersect(F.transform(F.filter("units", lambda u: u["subject_relation"] == "PRIMARY_SUBJECT"), lambda u: u["stance"]), F.array(F.lit("BULLISH"), F.lit("BEARISH")))
    direction = F.when(F.size(stances) == 2, "MIXED").when(F.size(stances) == 1, stances[0]).otherwise("NO_DIRECTIONAL_UNIT")
    out = results.join(only, keys).withColumn("baseline_direction", direction)
    return out.select("id", "direction", "baseline_direction", F.when(F.size(stances) > 0, F.col("baseline_direction") != F.col("direction")).alias("disagrees"))


def cluster_direction(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Per cluster of members (cluster_id, id): rows with a label (id, direction), the commonest direction and its share."""
    counts = members.join(labels, "id").groupBy("cluster_id", "direction").agg(F.count("*").alias("n"))
    out = counts.groupBy("cluster_id").agg(F.sum("n").alias("labelled"), F.max_by("direction", F.struct("n", "direction")).alias("direction"), F.max("n").alias("_top"))
    return out.select("cluster_id", "labelled", "direction", F.round(F.col("_top") / F.col("labelled"), 6).alias("homogeneity"))


def require_as_of(features: DataFrame) -> DataFrame:
    """features (mode, state), whose reading fails at the first row that is not as of its own time and in order."""
    sound = (F.col("mode") == "PIT_CAUSAL") & (F.col("state") == "PASS")
    return features.where(F.coalesce(F.assert_true(F.coalesce(sound, F.lit(False)), F.lit("features as of each record's own time are required")).isNull(), F.lit(True)))
