"""Queries of near texts, names and catalogues, with SQL twins where SQL can say them in time.

Page addresses stand in for short comments.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import bursts, dictionary, judgement, sampling, similarity
from tallyloom.plans.registry import query, table

_LEAST = 0.9
_PAIRS = f"p AS (SELECT a.page_id AS a, b.page_id AS b, 1 - levenshtein(a.url, b.url) * 1.0 / greatest(length(a.url), length(b.url)) AS similarity FROM pages a JOIN pages b ON a.page_id < b.page_id AND abs(length(a.url) - length(b.url)) <= {1 - _LEAST:.1f} * greatest(length(a.url), length(b.url)) WHERE 1 - levenshtein(a.url, b.url) * 1.0 / greatest(length(a.url), length(b.url)) >= {_LEAST} - 1e-12)"


def _texts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit("web").alias("platform"), F.col("url").alias("text"), F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("author"))


@query(f"WITH {_PAIRS} SELECT a, b, round(similarity, 6) AS similarity FROM p")
def page_near_pairs_levenshtein(spark, sf_dir):
    return similarity.near_pairs(_texts(spark, sf_dir), _LEAST, "edits").withColumn("similarity", F.round("similarity", 6))


@query(f"WITH RECURSIVE {_PAIRS}, e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT page_id AS id, page_id AS c FROM pages UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id), k AS (SELECT id, min(c) AS cluster_id FROM r GROUP BY id) SELECT id, cluster_id, count(*) OVER (PARTITION BY cluster_id) AS cluster_size FROM k")
def page_near_clusters(spark, sf_dir):
    texts = _texts(spark, sf_dir)
    return similarity.clusters(texts, similarity.near_pairs(texts, _LEAST, "edits"))


_HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"


@query(f"WITH {_PAIRS}, e AS (SELECT a, b, similarity FROM p UNION ALL SELECT b, a, similarity FROM p), h AS (SELECT page_id, {_HOST} AS author FROM pages) SELECT h.page_id AS id, round(max(similarity), 6) AS similarity_max, round(max(similarity) FILTER (WHERE o.author <> h.author), 6) AS cross_author FROM h LEFT JOIN e ON e.a = h.page_id LEFT JOIN h o ON o.page_id = e.b GROUP BY h.page_id")
def page_nearest_peer(spark, sf_dir):
    texts = _texts(spark, sf_dir)
    out = similarity.nearest_peer(texts, similarity.near_pairs(texts, _LEAST, "edits"))
    return out.select("id", F.round("similarity_max", 6).alias("similarity_max"), F.round("cross_author", 6).alias("cross_author"))


@query()
def page_near_pairs_ratio(spark, sf_dir):
    return similarity.near_pairs(_texts(spark, sf_dir), _LEAST).withColumn("similarity", F.round("similarity", 6))


@query()
def page_leader_groups(spark, sf_dir):
    groups = similarity.leader_groups(table(spark, sf_dir, "pages").select(F.col("page_id").alias("comment_key"), F.col("url").alias("text")))
    return similarity.group_members(groups)


@query(f"WITH RECURSIVE {_PAIRS}, e AS (SELECT a, b, greatest(a % 89, b % 89) AS at FROM p UNION SELECT b, a, greatest(a % 89, b % 89) FROM p), r AS (SELECT page_id AS me, page_id % 89 AS mine, page_id AS id FROM pages UNION SELECT r.me, r.mine, e.b FROM r JOIN e ON e.a = r.id AND e.at <= r.mine) SELECT me AS id, min(r.id) AS cluster_id, count(*) AS cluster_size, count(DISTINCT {_HOST}) AS n_authors, (max(r.id % 89) - min(r.id % 89)) AS span FROM r JOIN pages ON pages.page_id = r.id GROUP BY me")
def page_asof_clusters(spark, sf_dir):
    texts = _texts(spark, sf_dir)
    records = texts.select("id", (F.col("id") % 89).alias("available"), "author")
    return similarity.as_of_clusters(records, similarity.near_pairs(texts, _LEAST, "edits"))


@query(f"WITH RECURSIVE {_PAIRS}, e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT page_id AS id, page_id AS c FROM pages UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id), k AS (SELECT id, min(c) AS cluster_id FROM r GROUP BY id) SELECT id, count(*) OVER (PARTITION BY cluster_id ORDER BY id % 89 RANGE BETWEEN 15 PRECEDING AND CURRENT ROW) AS similar_in_window FROM k")
def page_similar_in_window(spark, sf_dir):
    texts = _texts(spark, sf_dir)
    rows = similarity.clusters(texts, similarity.near_pairs(texts, _LEAST, "edits")).withColumn("at", F.col("id") % 89)
    return bursts.in_frame(rows, ["cluster_id"], "at", 15 / bursts.SECOND, 0, "similar_in_window").select("id", "similar_in_window")





@query(f"WITH n AS (SELECT lower(p_type) AS name, 'type:' || p_type AS entity_id FROM part GROUP BY ALL) SELECT p_partkey AS id, entity_id, name AS alias, CASE WHEN ends_with(t, name) THEN length(t) - length(name) ELSE strpos(t, name) - 1 END AS at FROM (SELECT p_partkey, lower(p_name || ' ' || p_type) AS t FROM part) JOIN n ON regexp_matches(t, '(^|[^a-z0-9])' || name || '([^a-z0-9]|$)')")
def part_mentions(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    names = part.select(F.col("p_type").alias("alias"), F.concat(F.lit("type:"), "p_type").alias("entity_id")).distinct()
    return dictionary.mentions(part.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text")), names).select("id", "entity_id", "alias", F.col("at").cast("long").alias("at"))


_E = "SELECT 'c' || CAST(s_nationkey AS STRING) || '-' || CAST(s_suppkey % 3 AS STRING) AS id, 'n' || CAST(s_nationkey % 7 AS STRING) AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'SECURITY' ELSE 'CONCEPT' END AS layer, 'STOCK' AS category, 'k' || CAST(s_nationkey % 5 AS STRING) AS code, s_suppkey AS seen FROM supplier"


@query(f"WITH e AS ({_E}), u AS (SELECT id, last(name ORDER BY seen) AS name, last(layer ORDER BY seen) AS layer, last(category ORDER BY seen) AS category, last(code ORDER BY seen) AS code FROM e GROUP BY id), s AS (SELECT * FROM u WHERE layer = 'SECURITY'), f AS (SELECT c.id, min(s.id) AS into_, count(DISTINCT s.id) AS n FROM u c JOIN s ON c.name = s.name OR c.code = s.code WHERE c.layer <> 'SECURITY' GROUP BY c.id), g AS (SELECT * FROM f WHERE n = 1) SELECT u.id, u.name, u.layer, array_to_string(list_sort(list_distinct(list_concat([u.name], coalesce((SELECT list(c.name) FROM g JOIN u c ON c.id = g.id WHERE g.into_ = u.id), [])))), ',') AS aliases FROM u WHERE u.id NOT IN (SELECT id FROM g)")
def catalogue_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").selectExpr("'c' || CAST(s_nationkey AS STRING) || '-' || CAST(s_suppkey % 3 AS STRING) AS id", "'n' || CAST(s_nationkey % 7 AS STRING) AS name", "CASE WHEN s_suppkey % 3 = 0 THEN 'SECURITY' ELSE 'CONCEPT' END AS layer", "'STOCK' AS category", "'k' || CAST(s_nationkey % 5 AS STRING) AS code", "s_suppkey AS seen")
    # suppliers of one id stand in for sources: the one seen last overwrites the others
    last = rows.groupBy("id").agg(F.max_by(F.struct("name", "layer", "category", "code"), "seen").alias("r")).select("id", "r.*").withColumn("aliases", F.array("name"))
    merged = dictionary.fold_concepts(dictionary.upsert(last.where("false"), last))
    return merged.select("id", "name", "layer", F.array_join(F.sort_array("aliases"), ",").alias("aliases"))


@query("SELECT p_partkey AS id, CASE WHEN regexp_matches(code, '^(600|601|603|605|688|689|900)') THEN 'STOCK' WHEN contains(upper(p_name), 'RING') THEN 'OTHER' END AS kind FROM (SELECT *, CAST(p_partkey % 1000 AS STRING) || '000' AS code FROM part)".replace("WHEN contains(upper(p_name), 'RING') THEN 'OTHER' ", ""))
def listing_route(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat((F.col("p_partkey") % 1000).cast("string"), F.lit("000")).alias("code"), "p_name")
    return part.select("id", dictionary.route(F.col("code"), F.col("p_name")).alias("kind"))


@query("SELECT conv_id, turn, place FROM (SELECT conv_id, turn, row_number() OVER (ORDER BY contains(text, '?')::INT + contains(text, '不')::INT DESC, length(text) DESC, conv_id * 1000 + turn) AS place FROM conversations) WHERE place <= 50")
def challenge_order(spark, sf_dir):
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("group_id"), "text")
    hardest = sampling.challenge_order(rows).limit(50).withColumn("t", sampling.triggers(F.col("text")))
    place = F.row_number().over(Window.orderBy(F.desc("t"), F.length("text").desc(), "group_id"))  # fifty rows
    return hardest.select("conv_id", "turn", place.cast("long").alias("place"))


@query()
def annotation_plan(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("comment_key"), "text", F.col("role").alias("video"), F.col("conv_id").alias("group_id"), (F.col("turn") % 4).alias("n_candidates"), F.lit(True).alias("valid"))
    return sampling.annotation_plan(rows).withColumn("tags", F.array_join("tags", ","))


_SIGNS = "WITH b AS (SELECT event_id AS id, event_type, user_id, count(*) OVER (PARTITION BY event_type, user_id) AS copies FROM events) SELECT id, copies, round(copies - 1 + (id % 7) / 10.0, 6) AS signal FROM b ORDER BY copies - 1 + (id % 7) / 10.0 DESC, id LIMIT 100"


@query(_SIGNS)
def high_signal_sample(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type", "user_id")
    copies = events.groupBy("event_type", "user_id").agg(F.count("*").alias("copies"))
    rows = events.join(copies, ["event_type", "user_id"]).withColumn("zscore", F.lit(None).cast("double")).withColumn("reuse", (F.col("id") % 7) / 10)
    return similarity.high_signal(rows).select("id", "copies", F.round("signal", 6).alias("signal"))


@query("SELECT event_id AS id, concat_ws(',', CASE WHEN event_id % 3 = 0 THEN 'EXACT_REPEAT_IN_SAMPLE' END, CASE WHEN event_id % 5 < 2 THEN 'NEAR_REPEAT_IN_SAMPLE' END, CASE WHEN event_id % 7 = 0 THEN 'SAMPLE_TIME_CONCENTRATION' END) AS flags, concat_ws(',', CASE WHEN event_id % 2 = 0 THEN 'STABLE_AUTHOR_ID_MISSING' END, CASE WHEN value < 0 THEN 'ENGAGEMENT_BASELINE_UNAVAILABLE_OR_DEGENERATE' END) AS missing FROM events")
def evidence_flags(spark, sf_dir):
    at = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(at.alias("id"), F.when(at % 3 == 0, 2).otherwise(1).alias("copies"), F.when(at % 5 < 2, 3).otherwise(1).alias("cluster_size"), (at % 7 == 0).alias("concentrated"), F.when(at % 2 != 0, "a").alias("author"), F.col("ts").alias("clock"), F.when(~(F.col("value") < 0), F.col("value")).alias("z"))
    return rows.select("id", F.concat_ws(",", judgement.evidence_flags()).alias("flags"), F.concat_ws(",", judgement.missing_features()).alias("missing"))


@query("SELECT doc_id, substr(sha256('src:T:' || doc_id), 1, 64) AS sample_id, sha256(text) AS text_sha256, substr(sha256(source), 1, 16) AS pseudonym FROM documents")
def sample_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", sampling.sample_id("src", "T", F.col("doc_id")).alias("sample_id"), F.sha2("text", 256).alias("text_sha256"), sampling.pseudonym(F.col("source")).alias("pseudonym"))
