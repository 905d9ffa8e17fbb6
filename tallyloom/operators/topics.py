"""Topics of what was said: documents by comment, terms, groups of near vectors, and names for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_DOCUMENTS = 50
SPACES = ("STRATEGY", "SECURITY", "RATIONALE", "RISK")
JOINER = "；"


def documents(snippets: DataFrame) -> DataFrame:
    """(space, comment_key, document) from snippets (space, comment_key, snippet, gate): whole passed snippets of a comment,
    each once, sorted, joined. A comment's snippets are few, so the list is bounded by the comment."""
    kept = snippets.where((F.col("gate") == "PASS") & (F.trim("snippet") != "")).select("space", "comment_key", F.trim("snippet").alias("snippet")).distinct()
    return kept.groupBy("space", "comment_key").agg(F.array_join(F.array_sort(F.collect_list("snippet")), JOINER).alias("document"))


def unique_documents(docs: DataFrame) -> DataFrame:
    """(space, document_sha256, n, first_key): documents of a space that are alike, as one."""
    return docs.groupBy("space", F.sha2("document", 256).alias("document_sha256")).agg(F.count("*").alias("n"), F.min("comment_key").alias("first_key"))


def terms(text: Column) -> Column:
    """Words, and adjacent pairs of the characters of scripts written without spaces; no digits, no punctuation."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: (F.length(w) > 1) & ~w.rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"))
    runs = F.regexp_extract_all(text, F.lit(r"([\p{IsHan}]+)"), F.lit(1))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) > 1, F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))).otherwise(F.array(r))))
    return F.concat(words, pairs)


def cluster(vectors: DataFrame, k: int, seed: int = 42, least: int = LEAST_DOCUMENTS) -> tuple[str, DataFrame | None]:
    """(status, rows (id, topic_id, distance)) of vectors (id, embedding array): k-means on given embeddings.

    A space with fewer than `least` documents is INSUFFICIENT_DATA. Embeddings are given, not made here.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    known = vectors.where(F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)))
    if known.limit(least).count() < least:
        return "INSUFFICIENT_DATA", None
    rows = known.select("id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=10).fit(rows)
    return "SUCCESS", model.transform(rows).select("id", F.col("prediction").alias("topic_id"))


def keywords(docs: DataFrame, n: int = 8) -> DataFrame:
    """(topic_id, place, term, score) of docs (topic_id, document): terms that are frequent in a topic and rare in others."""
    words = docs.select("topic_id", F.explode(terms(F.col("document"))).alias("term")).groupBy("topic_id", "term").agg(F.count("*").alias("n"))
    topics = F.broadcast(docs.agg(F.count_distinct("topic_id").alias("topics")))  # one row
    spread = words.groupBy("term").agg(F.count("*").alias("df"))
    scored = words.join(spread, "term").crossJoin(topics).withColumn("score", F.col("n") * F.log(1 + F.col("topics") / F.col("df")))
    place = F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc("score"), "term"))
    return scored.withColumn("place", place).where(F.col("place") <= n).select("topic_id", "place", "term", F.round("score", 6).alias("score"))


def names(words: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """(topic_id, name, origin): the name that a model gave (topic_id, name), else a topic's first three keywords."""
    own = words.where("place <= 3").groupBy("topic_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]), " / ").alias("_own"))
    if given is None:
        return own.select("topic_id", F.col("_own").alias("name"), F.lit("KEYWORDS").alias("origin"))
    out = own.join(given.select("topic_id", F.nullif(F.trim("name"), F.lit("")).alias("_given")), "topic_id", "left")
    return out.select("topic_id", F.coalesce("_given", "_own").alias("name"), F.when(F.col("_given").isNotNull(), "MODEL").otherwise("KEYWORDS").alias("origin"))
