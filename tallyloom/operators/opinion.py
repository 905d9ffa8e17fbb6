"""Rankings of entities and methods over validated comments.

comments: comment_key, video, user_id, text, copies (duplicate group), likes, time, valid, status, identity_status.
views: comment_key, entity_id, resolution, stance, action, speech_act, basis, n_rationales, and a state *_gate of each of
entity, stance, action, speech and context. Each table has one row for each of its things; nothing is nested, so every
figure is a partial aggregate and no group of rows is gathered in one place.

Rankings deal their tables to tasks by the number of rows, since the session's number of shuffle partitions does not grow
with them. Where a group can be hot, its rows are dealt by parts of the comments first, and the parts' figures put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators import ranking
from tallyloom.operators.consensus import LEAST_SAMPLE, only

ACTIONS = ("BUY", "HOLD", "WATCH", "AVOID", "SELL", "WAIT")
STANCES = ("BULLISH", "BEARISH", "NEUTRAL")
#: Rows of the largest table for a task, and rows that are worth a task of their own.
ROWS, FEW = 250_000, 20_000


def passed(gate: str) -> Column:
    return F.coalesce(F.col(gate) == "PASS", F.lit(False))


def usable() -> Column:
    """Analysed with success, at least in part, and not in conflict about its identity; no identity state counts as PASS."""
    return F.coalesce(F.col("status").isin("SUCCESS", "PARTIAL"), F.lit(False)) & (F.coalesce("identity_status", F.lit("PASS")) == "PASS")


def valid() -> Column:
    return F.coalesce("valid", F.lit(True))


def eligible(comments: DataFrame) -> DataFrame:
    return comments.where(valid() & usable())


def tasks(*tables: DataFrame) -> int:
    """To how many tasks tables are dealt, so that none gets many more than ROWS rows of any of them."""
    rows, cores = max(t.count() for t in tables), tables[0].sparkSession.sparkContext.defaultParallelism
    return max(-(-rows // ROWS), min(cores, -(-rows // FEW)), 1)


def dealt(n: int, *tables: DataFrame) -> list[DataFrame]:
    """The tables dealt to n tasks by exactly the key of their joins: by less, Spark would deal them anew."""
    return [t.repartition(n, "comment_key") for t in tables]


def parted(df: DataFrame, n: int, *by: str) -> DataFrame:
    """df with _part, one of n parts of the comments, dealt by both: a hot group is shared by many tasks, a comment of it by none."""
    return df.withColumn("_part", F.pmod(F.xxhash64("comment_key"), F.lit(n))).repartition(n, "_part", *by)


def accepted(views: DataFrame, comments: DataFrame) -> DataFrame:
    """Views of eligible comments whose entity is evidenced and resolved."""
    return views.where(passed("entity_gate") & (F.col("resolution") == "RESOLVED")).join(eligible(comments).select("comment_key"), "comment_key")


def _advice() -> Column:
    return passed("speech_gate") & (F.col("speech_act") == "RECOMMENDATION") & ~F.col("action").isin("AVOID", "SELL", "WAIT")


def explicit() -> Column:
    return _advice() & (F.col("basis") == "EXPLICIT_COMMENT")


def contextual() -> Column:
    return _advice() & passed("context_gate") & F.col("basis").isin("VIDEO_PROMPT_CONTEXT", "PARENT_CONTEXT")


def recommended() -> Column:
    return _advice() & ((F.col("basis") == "EXPLICIT_COMMENT") | passed("context_gate"))


def held() -> Column:
    return passed("speech_gate") & (F.col("speech_act") == "SELF_POSITION")


def avoided() -> Column:
    return passed("action_gate") & F.col("action").isin("AVOID", "SELL")


def per_comment(views: DataFrame) -> DataFrame:
    """One row for each entity and comment: its one stance and action that passed, else UNKNOWN, and what any view of it says."""
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    flags = {"explicit": explicit(), "contextual": contextual(), "recommended": recommended(), "self_position": held(), "self_buy": held() & passed("action_gate") & (F.col("action") == "BUY"), "avoided": avoided(), "acted": passed("action_gate")}
    flags |= {f"did_{a.lower()}": passed("action_gate") & (F.col("action") == a) for a in ACTIONS}
    collapsed = (only(F.col(c), passed(f"{c}_gate")).alias(c) for c in ("stance", "action"))
    return views.groupBy("entity_id", "comment_key").agg(*collapsed, F.sum("n_rationales").alias("n_rationales"), *(any_(c).alias(n) for n, c in flags.items()))


def entity_ranking(views: DataFrame, comments: DataFrame) -> DataFrame:
    """Entities by recommendations, mentions and id, with their counts over distinct comments.

    Engagement is the mid-rank percentile of likes among the valid comments of a video. engagement_ratio weights each
    directional comment by 1 + percentile, and leaves out comments without likes.
    """
    n = tasks(views, comments)
    liked = ranking.mid_rank_percentile(comments.where(valid() & F.col("video").isNotNull()), "video", "likes", "engagement").select("comment_key", "engagement")
    views, comments, liked = dealt(n, views, comments, liked)
    facts = comments.select("comment_key", "user_id", "text", "copies").join(liked, "comment_key", "left")
    each = per_comment(accepted(views, comments)).join(facts, "comment_key")
    # three rows of each: one for its text, which counts for the figures, one for its group of copies, one for its user
    values = {"text": F.coalesce("text", F.col("comment_key").cast("string")), "copies": F.coalesce("copies", F.col("comment_key").cast("string")), "user_id": F.col("user_id")}
    rows = each.withColumns({"_known": F.col("user_id").isNotNull(), "_of": F.explode(F.array(*map(F.lit, values)))}).where((F.col("_of") != "user_id") | F.col("_known"))
    rows = rows.withColumns({c: F.when(F.col("_of") == c, v) for c, v in values.items()})
    of = lambda c: F.col("_of") == c
    count = lambda c: F.count_if(of("text") & c)
    weight = lambda s: F.sum(F.when(of("text") & (F.col("stance") == s), 1 + F.col("engagement")))
    flags = {"explicit_count": "explicit", "context_count": "contextual", "recommendation_count": "recommended", "self_position_count": "self_position", "self_buy_count": "self_buy"} | {f"{a.lower()}_count": f"did_{a.lower()}" for a in ACTIONS}
    figures = {
        "mentions": F.count_if(of("text")), **{k: count(F.col(c)) for k, c in flags.items()}, "unknown_action_count": count(~F.col("acted")), **{s.lower(): count(F.col("stance") == s) for s in STANCES},
        "_users": count(F.col("_known")), "engagement_comments": count(F.col("engagement").isNotNull()), "_up": weight("BULLISH"), "_down": weight("BEARISH"),
    }
    by, sums = ["entity_id", "_of", *values], [F.sum(k).alias(k) for k in figures]
    out = rows.repartition(n, *by).groupBy(*by).agg(*(c.alias(k) for k, c in figures.items()))
    distinct = {"unique_texts": "text", "unique_groups": "copies", "users": "user_id"}
    out = out.groupBy("entity_id").agg(*sums, *(F.count_if(of(c)).alias(k) for k, c in distinct.items()))
    out = out.select(
        "entity_id", "mentions", *flags, "unknown_action_count", *(s.lower() for s in STANCES), "unique_texts", "unique_groups", F.nullif("users", F.lit(0)).alias("users"),
        F.round(F.col("_users") / F.col("mentions"), 6).alias("user_coverage"), "engagement_comments", "_up", "_down",
    )
    n, zero = F.nullif(F.col("bullish") + F.col("bearish"), F.lit(0)), lambda c: F.coalesce(c, F.lit(0.0))
    total = zero("_up") + zero("_down")
    return out.select(
        "*", F.round(F.log((1 + F.col("bullish")) / (1 + F.col("bearish"))), 4).alias("bullish_index"), F.round(F.col("bullish") / n, 6).alias("bull_ratio"), F.round(2 * F.least("bullish", "bearish") / n, 6).alias("disagreement"),
        F.when(F.coalesce(n, F.lit(0)) >= LEAST_SAMPLE, "SUFFICIENT").otherwise("INSUFFICIENT").alias("sample_status"), F.round(zero("_up") / F.nullif(total, F.lit(0.0)), 6).alias("engagement_ratio"),
    ).drop("_up", "_down").orderBy(F.desc("recommendation_count"), F.desc("mentions"), "entity_id")


def video_rates(views: DataFrame, comments: DataFrame) -> DataFrame:
    """Per entity: videos with mentions, and the mean over all videos of its share of a video's valid comments.

    Videos without mentions count as zero, so the sum of the shares is divided by their number: no grid is made.
    """
    totals = comments.where(F.col("video").isNotNull() & valid()).groupBy("video").agg(F.count("*").alias("total"))
    n = tasks(views, comments)
    views, comments = dealt(n, views, comments)
    pairs = per_comment(accepted(views, comments)).select("entity_id", "comment_key").join(comments.where(F.col("video").isNotNull()).select("comment_key", "video"), "comment_key", "left")
    seen = parted(pairs, n, "entity_id", "video").groupBy("_part", "entity_id", "video").agg(F.count("*").alias("n"))
    seen = seen.repartition(n, "entity_id", "video").groupBy("entity_id", "video").agg(F.sum("n").alias("n")).join(totals, "video", "left")
    out = seen.groupBy("entity_id").agg(F.count("total").alias("video_count"), F.sum(F.col("n") / F.col("total")).alias("_sum"))
    videos = F.broadcast(totals.agg(F.count("*").alias("video_total")))  # one row
    score = F.round(F.coalesce("_sum", F.lit(0.0)) / F.greatest("video_total", F.lit(1)), 6)
    return out.crossJoin(videos).select("entity_id", F.coalesce("video_count", F.lit(0)).cast("long").alias("video_count"), "video_total", score.alias("balanced_score"))


def rationale_groups(views: DataFrame, comments: DataFrame, rationales: DataFrame) -> DataFrame:
    """Per entity, reason and stance (UNKNOWN unless passed): distinct comments, evidence, the first summary, by -evidence.

    rationales: comment_key, entity_id, ordinal, reason_code, stance, stance_gate, summary, gate.
    """
    n, on, by = tasks(views, comments, rationales), ["entity_id", "comment_key"], ["entity_id", "reason_code", "stance"]
    seen = accepted(*dealt(n, views, comments)).select(on).distinct()
    kept = rationales.where(F.col("gate") == "PASS").repartition(n, *on).join(seen.repartition(n, *on), on)
    stance = F.when(passed("stance_gate"), F.col("stance")).otherwise("UNKNOWN")
    # a comment lies in one part, so comments can be counted there
    some = parted(kept.select(*on, "reason_code", stance.alias("stance"), F.struct("comment_key", "ordinal", "summary").alias("first")), n, *by)
    some = some.groupBy("_part", *by, "comment_key").agg(F.count("*").alias("evidence"), F.min("first").alias("first"))
    some = some.groupBy("_part", *by).agg(F.count("*").alias("mentions"), F.sum("evidence").alias("evidence"), F.min("first").alias("first"))
    out = some.repartition(n, *by).groupBy(*by).agg(F.sum("mentions").alias("mentions"), F.sum("evidence").alias("evidence"), F.min("first")["summary"].alias("summary"))
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("evidence"), "reason_code", "stance"))
    return out.select("*", place.cast("long").alias("place"))


def evidence_keys(views: DataFrame, comments: DataFrame) -> DataFrame:
    """(entity_id, kind, comment_key) of the comments behind each figure, as rows: a list of a hot entity has no bound."""
    each = per_comment(accepted(*dealt(tasks(views, comments), views, comments)))
    kinds = F.array_compact(F.array(F.when(F.col("recommended"), "RECOMMENDATION"), F.when(F.col("avoided"), "AVOID"), F.when(F.col("stance").isin("BULLISH", "BEARISH"), F.col("stance"))))
    return each.select("entity_id", F.explode(kinds).alias("kind"), "comment_key")


def representatives(views: DataFrame, comments: DataFrame, n: int = 5) -> DataFrame:
    """Per entity the n comments with most rationales, then by key."""
    parts, order = tasks(views, comments), [F.desc("n_rationales"), F.col("comment_key")]
    each = per_comment(accepted(*dealt(parts, views, comments))).select("entity_id", "comment_key", "n_rationales")
    some = ranking.top_per_group(parted(each, parts, "entity_id"), ["_part", "entity_id"], order, n).drop("_part", "place")
    return ranking.top_per_group(some.repartition(parts, "entity_id"), "entity_id", order, n)


def method_ranking(methods: DataFrame, comments: DataFrame) -> DataFrame:
    """methods (comment_key, ordinal, method, attitude, type_gate, attitude_gate) over eligible comments, by count and id.

    A comment counts once for each method, with its last claim; an attitude that did not pass is UNKNOWN.
    """
    good = eligible(comments).select("comment_key")
    label = F.when(passed("attitude_gate"), F.col("attitude")).otherwise("UNKNOWN")
    claims = methods.where(passed("type_gate")).join(good, "comment_key").groupBy("method", "comment_key").agg(F.max_by(label, F.struct("ordinal", label)).alias("attitude"))
    support, oppose = F.count_if(F.col("attitude") == "SUPPORT"), F.count_if(F.col("attitude") == "OPPOSE")
    out = claims.groupBy("method").agg(F.count("*").alias("n"), support.alias("support"), oppose.alias("oppose"), F.count_if(F.col("attitude") == "UNKNOWN").alias("unknown"))
    directional = F.col("support") + F.col("oppose")
    out = out.crossJoin(F.broadcast(good.agg(F.count("*").alias("_all"))))  # one row
    return out.select(
        "method", "n", F.round(100 * F.col("n") / F.nullif(F.col("_all"), F.lit(0)), 6).alias("percentage"), "support", "oppose", "unknown",
        F.round((F.col("support") - F.col("oppose")) / F.nullif(directional, F.lit(0)), 6).alias("net_support"), F.when(directional >= LEAST_SAMPLE, "SUFFICIENT").otherwise("INSUFFICIENT").alias("sample_status"),
    ).orderBy(F.desc("n"), "method")


def method_evidence(methods: DataFrame, comments: DataFrame, n: int = 5) -> DataFrame:
    """The first n keys of eligible comments that support each method."""
    kept = methods.where(passed("type_gate") & passed("attitude_gate") & (F.col("attitude") == "SUPPORT")).join(eligible(comments).select("comment_key"), "comment_key")
    return ranking.top_per_group(kept.select("method", "comment_key").distinct(), "method", [F.col("comment_key")], n)


def risk_attitudes(risks: DataFrame, comments: DataFrame) -> DataFrame:
    """Comments for each (rule, attitude) of risks (comment_key, rule, attitude, type_gate, attitude_gate); both must pass."""
    kept = risks.where(passed("type_gate") & passed("attitude_gate")).join(eligible(comments).select("comment_key"), "comment_key")
    return kept.select("comment_key", "rule", "attitude").distinct().groupBy("rule", "attitude").agg(F.count("*").alias("n")).orderBy("rule", "attitude")


def local_day(time: str) -> Column:
    return F.date_format(F.from_utc_timestamp(F.col(time).cast("timestamp"), "Asia/Shanghai"), "yyyy-MM-dd")


def daily(comments: DataFrame) -> DataFrame:
    """Eligible comments by day in Shanghai; the null day holds those without a time."""
    return eligible(comments).groupBy(local_day("time").alias("day")).agg(F.count("*").alias("n"))


def entity_daily(views: DataFrame, comments: DataFrame) -> DataFrame:
    """Comments of each entity by day in Shanghai; the null day holds those without a time."""
    n = tasks(views, comments)
    views, comments = dealt(n, views, comments)
    each = per_comment(accepted(views, comments)).join(comments.select("comment_key", "time"), "comment_key")
    days = each.select("entity_id", local_day("time").alias("day")).repartition(n, "entity_id", "day")
    return days.groupBy("entity_id", "day").agg(F.count("*").alias("n"))


def review_queue(comments: DataFrame) -> DataFrame:
    """Comments that a person should see, and why: failed, partly done, or in conflict about their identity."""
    why = F.when(F.col("status").isin("SUCCESS", "PARTIAL"), F.when(~usable(), "IDENTITY_CONFLICT").when(F.col("status") == "PARTIAL", "FIELD_REVIEW")).otherwise("FAILURE")
    return comments.where(valid()).select("comment_key", "status", why.alias("reason")).where("reason is not null")


def with_results(comments: DataFrame, selected: DataFrame, results: DataFrame) -> DataFrame:
    """comments (comment_key, valid) with the status and reason of their results (comment_key, status, reason).

    A comment without a result was skipped: as noise where it is not valid, as not selected (comment_key) where it is not,
    and else as not done yet.
    """
    known = results.select("comment_key", F.col("status").alias("_status"), F.col("reason").alias("_reason"))
    chosen = selected.select("comment_key").distinct().withColumn("_chosen", F.lit(True))
    out = comments.join(known, "comment_key", "left").join(chosen, "comment_key", "left")
    why = F.when(~valid(), "NOISE").when(F.col("_chosen").isNull(), "PILOT_LIMIT").otherwise("PENDING")
    keep = [c for c in comments.columns if c not in ("status", "reason")]
    return out.select(*keep, F.coalesce("_status", F.lit("SKIPPED")).alias("status"), F.when(F.col("_status").isNull(), why).otherwise(F.col("_reason")).alias("reason"))


def insights(ranks: DataFrame, boards: DataFrame) -> DataFrame:
    """Branches of the summary: (branch, board, entity_id, place) of a ranking with the boards of its entities.

    The three most recommended of each board, the three most avoided, the three most disputed and the three of strongest
    direction, the last two among sufficient samples. Ties: in the order of the ranking.
    """
    order = [F.desc("recommendation_count"), F.desc("mentions"), F.col("entity_id")]
    rows = ranks.join(boards.select("entity_id", "board"), "entity_id", "left").withColumn("board", F.coalesce("board", F.lit("other")))
    avoided_, sure = F.col("avoid_count") + F.col("sell_count"), F.col("sample_status") == "SUFFICIENT"
    branch = lambda name, when, group, first: F.when(when, F.struct(F.lit(name).alias("branch"), group.alias("group"), first.cast("double").alias("first")))
    everywhere = F.lit("all")
    branches = F.array_compact(F.array(
        branch("RECOMMENDED", F.col("recommendation_count") > 0, F.col("board"), F.lit(0)), branch("AVOIDED", avoided_ > 0, everywhere, avoided_),
        branch("DISPUTED", sure & (F.col("disagreement") > 0), everywhere, F.col("disagreement")), branch("DIRECTED", sure, everywhere, F.abs("bullish_index")),
    ))
    # one pass: the ranking is worked out once for all branches
    some = rows.select("board", "entity_id", "recommendation_count", "mentions", F.inline(branches))
    top = ranking.top_per_group(some, ["branch", "group"], [F.desc("first"), *order], 3)
    return top.select("branch", "board", "entity_id", F.col("place").cast("long").alias("place"))
