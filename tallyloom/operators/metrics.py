"""Evaluation of labelled predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_class(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Support, predicted, true positives, precision, recall and F1 = 2 tp / (support + predicted) of each class."""
    both = rows.select(F.explode(F.array(F.struct(F.col(gold).alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p"), F.lit(0).alias("tp")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p"), (F.col(gold) == F.col(predicted)).cast("int").alias("tp")))).alias("x"))
    out = both.groupBy(F.col("x.label").alias("label")).agg(F.sum("x.g").alias("support"), F.sum("x.p").alias("predicted"), F.sum("x.tp").alias("tp"))
    ratio = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 6)
    return out.select("*", ratio(F.col("tp"), F.col("predicted")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"))


def calibration(rows: DataFrame, truth: str, p: str, bins: int = 10) -> DataFrame:
    """One row: n, Brier score over both classes (0 to 2), expected calibration error of the winner's probability."""
    win = F.greatest(F.col(p), 1 - F.col(p))
    right = ((F.col(p) >= 0.5).cast("int") == F.col(truth)).cast("double")
    each = rows.select(F.least(F.lit(bins - 1), F.floor(win * bins)).alias("bin"), win.alias("win"), right.alias("right"), (2 * F.pow(F.col(p) - F.col(truth), 2)).alias("brier"))
    per = each.groupBy("bin").agg(F.count("*").alias("n"), F.abs(F.avg("win") - F.avg("right")).alias("gap"), F.sum("brier").alias("brier"))
    return per.agg(F.sum("n").alias("n"), F.round(F.sum("brier") / F.sum("n"), 6).alias("brier"), F.round(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), 6).alias("ece"))


def set_f1(gold: DataFrame, predicted: DataFrame, key: str, label: str) -> DataFrame:
    """True and false positives, false negatives and F1 of each label, from two tables of (key, label)."""
    g, p = gold.select(key, label).distinct().withColumn("g", F.lit(1)), predicted.select(key, label).distinct().withColumn("p", F.lit(1))
    both = g.join(p, [key, label], "full")
    tp, fp, fn = F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()), F.count_if(F.col("g").isNull()), F.count_if(F.col("p").isNull())
    out = both.groupBy(label).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    return out.select("*", F.round(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), 6).alias("f1"))


def kappa(rows: DataFrame, first: str, second: str) -> DataFrame:
    """One row: n, observed and chance agreement, Cohen's kappa (null where chance agreement is 1)."""
    total = rows.agg(F.count("*").alias("n"), F.avg((F.col(first) == F.col(second)).cast("double")).alias("observed"))
    a, b = (rows.groupBy(F.col(c).alias("label")).agg(F.count("*").alias(name)) for c, name in ((first, "na"), (second, "nb")))
    chance = a.join(b, "label").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("both"))
    out = total.crossJoin(chance).withColumn("expected", F.col("both") / F.nullif(F.col("n") * F.col("n"), F.lit(0)))
    return out.select("n", F.round("observed", 6).alias("observed"), F.round("expected", 6).alias("expected"), F.round((F.col("observed") - F.col("expected")) / F.nullif(1 - F.col("expected"), F.lit(0.0)), 6).alias("kappa"))


def set_scores(gold: DataFrame, predicted: DataFrame, key: str, label: str) -> DataFrame:
    """One row over set_f1: precision, recall and F1 over all labels together, and the mean F1 of the labels seen."""
    per = set_f1(gold, predicted, key, label)
    f1 = F.coalesce(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), F.lit(0.0))
    out = per.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.round(F.avg(f1), 6).alias("macro_f1"))
    ratio = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 6)
    return out.select(ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), "macro_f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("micro_f1"))


def task_scores(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """set_scores of each task, from (task, sample_id, label) of both sides; what one side lacks counts against it."""
    both = gold.distinct().withColumn("g", F.lit(1)).join(predicted.distinct().withColumn("p", F.lit(1)), ["task", "sample_id", "label"], "full")
    tp, fp, fn = F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()), F.count_if(F.col("g").isNull()), F.count_if(F.col("p").isNull())
    per = both.groupBy("task", "label").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    f1 = F.coalesce(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), F.lit(0.0))
    out = per.groupBy("task").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.round(F.avg(f1), 6).alias("macro_f1"))
    ratio = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 6)
    return out.select("task", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), "macro_f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("micro_f1"))


# What a task must reach to be accepted.
ACCEPTANCE = {
    ("entity_spans", "precision"): 0.95, ("entity_spans", "recall"): 0.85, ("canonical_ids", "precision"): 0.95, ("intents", "macro_f1"): 0.85, ("actions", "macro_f1"): 0.85,
    ("speech_acts", "macro_f1"): 0.85, ("stances", "macro_f1"): 0.85, ("methods", "micro_f1"): 0.85, ("method_attitudes", "micro_f1"): 0.85, ("rationales", "precision"): 0.95,
}


def acceptance(scores: DataFrame) -> DataFrame:
    """(task, figure, value, least, passed) of the figures that decide, from task_scores; a missing figure counts as 0."""
    spark = scores.sparkSession
    rules = spark.createDataFrame([(t, f, v) for (t, f), v in ACCEPTANCE.items()], "task string, figure string, least double")
    long = scores.select("task", F.inline(F.array(*(F.struct(F.lit(f).alias("figure"), F.col(f).cast("double").alias("value")) for f in ("precision", "recall", "macro_f1", "micro_f1")))))
    return rules.join(long, ["task", "figure"], "left").withColumn("passed", F.coalesce(F.col("value"), F.lit(0.0)) >= F.col("least"))


def closed_set(pairs: DataFrame, labels: list[str]) -> tuple[DataFrame, DataFrame]:
    """Per-class figures, and one row of n, macro F1 of the classes with support, Brier score (0 to 2) and calibration error.

    pairs: gold, predicted, probabilities (label to number). A label or a distribution outside the set fails the reading.
    """
    known = F.array(*(F.lit(x) for x in labels))
    values = F.map_values("probabilities")
    sound = F.array_contains(known, F.col("gold")) & F.array_contains(known, F.col("predicted")) & (F.array_sort(F.map_keys("probabilities")) == F.array_sort(known)) & F.forall(values, lambda v: (v >= 0) & (v <= 1) & ~F.isnan(v)) & (F.abs(F.aggregate(values, F.lit(0.0), lambda s, v: s + v) - 1) <= 0.02)
    rows = pairs.where(F.assert_true(F.coalesce(sound, F.lit(False)), F.lit("a label or probabilities outside the closed set")).isNull())
    all_ = rows.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    classes = all_.join(per_class(rows, "gold", "predicted"), "label", "left").na.fill(0, ["support", "predicted", "tp"])
    confidence = F.element_at("probabilities", F.col("predicted"))
    squares = sum((F.pow(F.element_at("probabilities", F.lit(x)) - (F.col("gold") == x).cast("int"), 2) for x in labels), F.lit(0.0))
    bins = rows.groupBy(F.least(F.lit(9), F.floor(confidence * 10)).alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg(confidence) - F.avg((F.col("gold") == F.col("predicted")).cast("int"))).alias("gap"), F.sum(squares).alias("brier"))
    total = bins.agg(F.sum("n").alias("n"), F.round(F.sum("brier") / F.sum("n"), 6).alias("brier"), F.round(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), 6).alias("ece"))
    f1 = F.coalesce(2 * F.col("tp") / F.nullif(F.col("support") + F.col("predicted"), F.lit(0)), F.lit(0.0))
    macro = classes.agg(F.round(F.avg(F.when(F.col("support") > 0, f1)), 6).alias("macro_f1"), F.bool_and(F.col("support") > 0).alias("_all"))
    state = F.when(F.coalesce("n", F.lit(0)) == 0, "PENDING_HUMAN_GOLD").when(F.col("_all"), "MEASURED").otherwise("PARTIAL_GOLD")
    return classes, total.crossJoin(F.broadcast(macro)).select(F.coalesce("n", F.lit(0)).alias("n"), "macro_f1", "brier", "ece", state.alias("state"))


def bootstrap_accuracy(pairs: DataFrame, iterations: int = 1000, seed: int = 42) -> DataFrame:
    """One row: accuracy, and the 2.5 % and 97.5 % marks of its bootstrap, resampled within each gold class.

    Drawing n of n rows with replacement takes a class's right ones with a binomial number. That number is drawn from a
    hash of seed, class and iteration, through the normal law and rounding, so classes are the only rows that are spread
    over iterations, and the result repeats itself whatever the partitions. Under two rows: no interval.
    """
    classes = pairs.groupBy("gold").agg(F.count("*").alias("n"), F.count_if(F.col("gold") == F.col("predicted")).alias("right"))
    uniform = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "gold", "turn"), F.lit(2**40)) + 0.5) / 2**40
    normal = F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * 3.141592653589793 * uniform(2))
    p = F.col("right") / F.col("n")
    drawn = F.least(F.col("n").cast("double"), F.greatest(F.lit(0.0), F.round(F.col("right") + normal * F.sqrt(F.col("n") * p * (1 - p)))))
    turns = classes.select("gold", "n", "right", F.explode(F.sequence(F.lit(1), F.lit(iterations))).alias("turn")).withColumn("drawn", drawn)
    each = turns.groupBy("turn").agg((F.sum("drawn") / F.sum("n")).alias("x"))
    marks = each.agg(F.sort_array(F.collect_list("x")).alias("x"))  # `iterations` numbers
    at = lambda q: F.get("x", F.lit(int((iterations - 1) * q)))
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.sum("right") / F.sum("n")).alias("accuracy"))
    enough = F.col("n") >= 2
    return total.crossJoin(F.broadcast(marks)).select("n", "accuracy", F.when(enough, at(0.025)).alias("low"), F.when(enough, at(0.975)).alias("high"), F.when(enough, "EXPERIMENTAL_INTERVAL").otherwise("INSUFFICIENT_HUMAN_GOLD").alias("state"))


def joined_gold(gold: DataFrame, predictions: DataFrame, label: str) -> DataFrame:
    """(sample_id, gold, predicted, probabilities) of the gold rows that are labelled and predicted with success.

    gold: sample_id, text_sha256, label, annotation_status, annotator; predictions: sample_id, text_sha256, status,
    predicted, probabilities. An id twice on one side, another text, or a label without a finished annotation fails.
    """
    once = lambda df, side: df.join(df.groupBy("sample_id").agg(F.count("*").alias("_n")), "sample_id").where(F.assert_true(F.col("_n") == 1, F.lit(f"a sample is twice among {side}")).isNull()).drop("_n")
    g = once(gold, "gold").where(F.col(label).isNotNull()).select("sample_id", F.col("text_sha256").alias("_sha"), F.col(label).alias("gold"), "annotation_status", "annotator")
    # the optimiser may read this before the filter on labels, so it says itself which rows it is about
    done = F.col("gold").isNull() | F.coalesce((F.col("annotation_status") == "COMPLETED") & (F.coalesce("annotator", F.lit("")) != ""), F.lit(False))
    rows = once(predictions, "predictions").where("status = 'SUCCESS'").join(g, "sample_id")
    rows = rows.where(F.assert_true(done, F.lit("gold needs a finished annotation and its annotator")).isNull()).where(F.assert_true(F.coalesce(F.col("_sha") == F.col("text_sha256"), F.lit(False)), F.lit("gold and prediction are of different texts")).isNull())
    return rows.select("sample_id", "gold", "predicted", "probabilities")


def topic_audit(rows: DataFrame, least: float = 0.8) -> DataFrame:
    """Per topic of rows (topic_id, relevant, annotator): samples, share of relevant ones once all are judged, and acceptance."""
    judged = F.bool_and(F.col("relevant").isNotNull() & (F.coalesce("annotator", F.lit("")) != ""))
    out = rows.groupBy("topic_id").agg(F.count("*").alias("samples"), F.when(judged, F.round(F.avg(F.col("relevant").cast("int")), 6)).alias("rate"))
    return out.withColumn("acceptance", F.when(F.coalesce(F.col("rate") >= least, F.lit(False)), "CONFIRMED").otherwise("CANDIDATE"))


def summary(results: DataFrame, unknown: list[str]) -> DataFrame:
    """(dimension, value, n, mean_score, unknown_rate) of results (platform, direction, gate, score): all, and by each.

    Grouping sets: one pass for the whole, each platform, each direction and each gate.
    """
    dims = ["platform", "direction", "gate"]
    rate = F.round(F.avg(F.col("_unknown").cast("int")), 6)
    # the flag keeps its values where a grouping set blanks the direction
    rows = results.withColumn("_unknown", F.col("direction").isin(*unknown))
    grouped = rows.groupingSets([[], *([F.col(d)] for d in dims)], *dims).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), rate.alias("unknown_rate"), *(F.grouping(d).alias(f"_{d}") for d in dims))
    which = F.coalesce(*(F.when(F.col(f"_{d}") == 0, d) for d in dims), F.lit("all"))
    value = F.coalesce(*(F.when(F.col(f"_{d}") == 0, F.col(d).cast("string")) for d in dims))
    return grouped.select(which.alias("dimension"), value.alias("value"), "n", "mean_score", "unknown_rate")
