"""Samples for annotation, and their splits. Chance is a hash of the seed and a key, so a plan repeats itself anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators import ranking

# Signs of hard cases, the four kinds of challenge, and the tags that samples are given.
TRIGGERS = ("不", "？", "?", "如果", "但是", "杠杆", "去年", "买", "卖", "定投")
CHALLENGES = {"RECOMMENDATION": r"推荐|值得|可以买|定投|买入", "NEGATION": r"不|别|国运|呵呵|难道|[？?]", "MULTI": r"买.*卖|买.*避|持.*不"}
TAGS = {"SHORT_ENTITY": r"^.{1,8}$", "NEGATION_SARCASM": r"不|别|国运|呵呵", "MULTI_ACTION": r"买.*卖|买.*避|持.*不", "RECOMMENDATION": r"推荐|值得|可以买|定投"}


def chance(seed: int, *keys: str) -> Column:
    return F.xxhash64(F.lit(seed), *(F.col(k) for k in keys))


def triggers(text: Column) -> Column:
    return sum((F.contains(text, F.lit(t)).cast("int") for t in TRIGGERS), F.lit(0))


def tags(text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(text.rlike(p), name) for name, p in TAGS.items())))


def sample_id(source: str, task: str, key: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(source), F.lit(task), key.cast("string")), 256)


def pseudonym(author: Column) -> Column:
    """Sixteen hex signs of the author's hash; null stays null."""
    return F.substring(F.sha2(author, 256), 1, 16)


def _hardest() -> list[Column]:
    return [triggers(F.col("text")).desc(), F.length("text").desc(), F.col("group_id")]


def challenge_order(groups: DataFrame) -> DataFrame:
    """groups (group_id, text) with most triggers first, then the longer text, then the id."""
    return groups.orderBy(*_hardest())


def annotation_plan(comments: DataFrame, seed: int = 42, random: int = 200, challenge: int = 200, each: int = 50, dev: int = 100, double: int = 50) -> DataFrame:
    """group_id, comment_key, stratum, split, double, tags of a sample of whole near-duplicate groups.

    comments: comment_key, text, video, group_id, n_candidates, valid. First `random` groups, from each video in turn.
    Of the rest, `each` of four kinds of challenge, then the hardest up to `challenge`. The sample is shuffled; the first
    `dev` are for development, the first `double` are annotated twice. Each step ranks rows and cuts, so nothing but the
    sample itself is ever gathered.
    """
    valid = comments.where(F.coalesce("valid", F.lit(False)) & F.col("group_id").isNotNull())
    head = F.min_by(F.struct("comment_key", "text", "video", "n_candidates"), "comment_key").alias("h")
    groups = valid.groupBy("group_id").agg(head).select("group_id", "h.*")
    turn = F.row_number().over(Window.partitionBy("video").orderBy(chance(seed, "group_id"), "group_id"))
    picked = groups.withColumn("turn", turn).where(F.col("turn") <= random).orderBy("turn", "video").limit(random).select("group_id")
    rest = groups.join(picked, "group_id", "left_anti")
    text, n = F.col("text"), F.coalesce("n_candidates", F.lit(0))
    kinds = [text.rlike(CHALLENGES["RECOMMENDATION"]), (F.length(text) <= 12) & (n > 0), text.rlike(CHALLENGES["NEGATION"]), (n >= 2) | text.rlike(CHALLENGES["MULTI"])]
    chosen = None
    for i, kind in enumerate(kinds):
        left = rest.where(kind) if chosen is None else rest.where(kind).join(chosen, "group_id", "left_anti")
        some = left.orderBy(chance(seed + 1 + i, "group_id"), "group_id").limit(each).select("group_id")
        chosen = some if chosen is None else chosen.unionByName(some)
    # first the chosen ones, then the hardest of the rest
    marked = rest.join(chosen.withColumn("_chosen", F.lit(1)), "group_id", "left")
    hard = marked.orderBy(F.col("_chosen").isNull(), *_hardest()).limit(challenge).select("group_id")
    sample = picked.withColumn("stratum", F.lit("STRATIFIED_RANDOM")).unionByName(hard.withColumn("stratum", F.lit("CHALLENGE"))).join(groups, "group_id")
    place = F.row_number().over(Window.orderBy(chance(seed + 9, "group_id"), "group_id"))  # a sample of a few hundred rows
    return sample.withColumn("place", place).select(
        "group_id", "comment_key", "stratum", F.when(F.col("place") <= dev, "dev").otherwise("test").alias("split"), (F.col("place") <= double).alias("double"), tags(F.col("text")).alias("tags"),
    )


def remaining(groups: DataFrame, used: DataFrame) -> DataFrame:
    return groups.join(used.select("group_id"), "group_id", "left_anti")


def greedy_groups(sizes: dict[str, int], most: int, seed: int = 42) -> set[str]:
    """Groups for development, in hash order as long as they fit into `most` samples; a group is never cut."""
    import xxhash

    out, n = set(), 0
    for key in sorted(sizes, key=lambda k: (xxhash.xxh64_intdigest(k, seed), k)):
        if n + sizes[key] <= most:
            out.add(key)
            n += sizes[key]
    return out


def exact_groups(sizes: dict[str, int], target: int, seed: int = 42) -> set[str]:
    """Groups whose sizes sum to the target exactly; which of the solutions is up to the seed. None: an error.

    By a table of which sums the first groups reach, read backwards.
    """
    import xxhash

    keys = sorted(sizes, key=lambda k: (xxhash.xxh64_intdigest(k, seed), k))
    reach = [1]
    for key in keys:
        reach.append((reach[-1] | reach[-1] << sizes[key]) & ((1 << (target + 1)) - 1))
    if not reach[-1] >> target & 1:
        raise ValueError(f"no set of whole groups has {target} samples")
    out, left = set(), target
    for i in range(len(keys), 0, -1):
        if not reach[i - 1] >> left & 1:
            out.add(keys[i - 1])
            left -= sizes[keys[i - 1]]
    return out


def group_sizes(sample: DataFrame, group: str) -> dict[str, int]:
    """Sizes of a sample's groups; a sample is a few hundred rows by plan."""
    return {str(r[0]): r[1] for r in sample.groupBy(group).agg(F.count("*").alias("n")).collect()}


def blind_pack(records: DataFrame, source: str, task: str, visible: DataFrame | None = None) -> DataFrame:
    """What an annotator gets: sample_id, text and its hash, platform, group, empty labels; no prediction.

    records: record_id, text, platform, available, group_id. visible: record_id, text, available, author of the records
    that one may see; one from later than the record itself fails the reading, authors are pseudonyms.
    """
    out = records.select(
        sample_id(source, task, F.col("record_id")).alias("sample_id"), "record_id", F.lit(task).alias("task"), "text", F.sha2("text", 256).alias("text_sha256"), "platform", "available", F.col("group_id").alias("partition_group"),
        F.lit(None).cast("string").alias("gold_label"), F.lit(None).cast("string").alias("annotator"), F.lit("PENDING").alias("annotation_status"),
    )
    if visible is None:
        return out
    own = records.select("record_id", F.col("available").alias("_mine"))
    seen = visible.join(own, "record_id").where(F.assert_true(F.coalesce(F.col("available") <= F.col("_mine"), F.lit(False)), F.lit("a record from the future is visible")).isNull())
    context = seen.groupBy("record_id").agg(F.sort_array(F.collect_list(F.struct("available", "text", pseudonym(F.col("author")).alias("author")))).alias("visible"))
    return out.join(context, "record_id", "left")


def platform_quota(records: DataFrame, quotas: dict[str, int], seed: int = 42) -> DataFrame:
    """So many records of each platform as its quota says, by hash; a platform with too few fails."""
    spark = records.sparkSession
    wanted = spark.createDataFrame(list(quotas.items()), "platform string, quota int")
    have = {r.platform: r.n for r in records.join(F.broadcast(wanted), "platform").groupBy("platform").agg(F.count("*").alias("n")).collect()}
    if short := sorted(p for p, n in quotas.items() if have.get(p, 0) < n):
        raise ValueError(f"too few records of {', '.join(short)}")
    place = F.row_number().over(Window.partitionBy("platform").orderBy(chance(seed, "record_id"), "record_id"))
    return records.join(F.broadcast(wanted), "platform").withColumn("_place", place).where(F.col("_place") <= F.col("quota")).drop("_place", "quota")


def first_of_each(records: DataFrame, n: int = 10) -> DataFrame:
    return ranking.top_per_group(records, "platform", [F.col("record_id")], n)
