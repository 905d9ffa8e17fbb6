"""The registered queries, each with its ANSI SQL twin. Bindings of driver columns to comment concepts only exercise the
operators' shapes (sources as videos, n_chars as likes, return flags as stances); they carry no meaning of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import text as tx
from tallyloom.operators import bursts, consensus, dictionary, identity, judgement, metrics, ranking, topics
from tallyloom.plans.registry import ORACLES, QUERIES
from tallyloom.plans.registry import query as _query
from tallyloom.plans.registry import table as _t

_PCT = "(rank() OVER (PARTITION BY source ORDER BY n_chars) - 1 + (count(*) OVER (PARTITION BY source, n_chars) - 1) / 2.0) / greatest(1, count(*) OVER (PARTITION BY source) - 1)"
_SPACE = r"regexp_replace(regexp_replace(text, '\[[\x{4e00}-\x{9fff}A-Za-z0-9]+\]', '', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')"


@_query(f"""WITH p AS (SELECT doc_id, source, n_chars, round({_PCT}, 6) AS percentile FROM documents),
r AS (SELECT source, count(DISTINCT doc_id) AS mentions, count(DISTINCT text) AS unique_texts, round(count(DISTINCT doc_id) * 1.0 / (SELECT count(*) FROM documents), 6) AS share FROM documents GROUP BY source)
SELECT source, doc_id, percentile, place, mentions, unique_texts, share FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY percentile DESC, doc_id) AS place FROM p) JOIN r USING (source) WHERE place <= 3""")
def flagship_top_documents(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    ranked = ranking.mid_rank_percentile(docs.select("doc_id", "source", "n_chars"), "source", "n_chars").withColumn("percentile", F.round("percentile", 6))
    top = ranking.top_per_group(ranked, "source", [F.desc("percentile"), F.col("doc_id")], 3)
    return top.join(consensus.rollup(docs, "source", "doc_id", "text"), "source").select("source", "doc_id", "percentile", F.col("place").cast("long").alias("place"), "mentions", "unique_texts", "share")


@_query(r"""SELECT source, count(*) AS raw_rows, count(*) FILTER (WHERE regexp_matches(text, '[\p{L}\p{N}]')) AS valid_rows, count(*) FILTER (WHERE NOT coalesce(regexp_matches(text, '[\p{L}\p{N}]'), false)) AS noise_rows, count(DISTINCT text) AS unique_texts, sum(CASE WHEN n_chars IS NULL THEN 1 ELSE 0 END)::BIGINT AS missing_likes FROM documents GROUP BY source""")
def doc_quality_counters(spark, sf_dir):
    ok = tx.valid(F.col("text"))
    return _t(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("raw_rows"), F.count_if(ok).alias("valid_rows"), F.count_if(~ok).alias("noise_rows"), F.count_distinct("text").alias("unique_texts"), F.count_if(F.col("n_chars").isNull()).alias("missing_likes"))


@_query(rf"""SELECT doc_id, md5(trim({_SPACE})) AS clean_md5, length(regexp_replace(trim({_SPACE}), '[0-9]+(\.[0-9]+)?', '<NUM>', 'g')) AS template_chars FROM documents""")
def doc_clean_text(spark, sf_dir):
    clean = tx.collapse(F.col("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(clean.cast("binary")).alias("clean_md5"), F.length(tx.numeric_template(clean)).cast("long").alias("template_chars"))


@_query(r"""WITH k AS (SELECT doc_id, regexp_replace(lower(text), '[^\p{L}\p{N}_]', '', 'g') AS k FROM documents) SELECT doc_id, count(*) OVER (PARTITION BY k) AS copies, min(doc_id) OVER (PARTITION BY k) AS first_doc FROM k""")
def doc_exact_duplicates(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.near_key(F.col("text")), 256).alias("k"))
    per = docs.groupBy("k").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))
    return docs.join(per, docs.k.eqNullSafe(per.k)).select("doc_id", "copies", "first_doc")


@_query("SELECT lang, round(avg(coalesce(n, 0) * 1.0 / total), 6) AS balanced, sum(coalesce(n, 0))::BIGINT AS mentions FROM (SELECT DISTINCT lang FROM documents) l CROSS JOIN (SELECT source, count(*) AS total FROM documents GROUP BY source) s LEFT JOIN (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) c USING (lang, source) GROUP BY lang")
def doc_balanced_rates(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    n = docs.groupBy("lang", "source").agg(F.count("*").alias("n"))
    total = n.groupBy("source").agg(F.sum("n").alias("total"))
    # sources without mentions count as zero: the sum of the rates is divided by the number of sources
    rates = n.join(total, "source").groupBy("lang").agg(F.sum(F.col("n") / F.col("total")).alias("rates"), F.sum("n").alias("mentions"))
    return rates.crossJoin(F.broadcast(total.agg(F.count("*").alias("sources")))).select("lang", F.round(F.col("rates") / F.col("sources"), 6).alias("balanced"), "mentions")


@_query("SELECT source, count(DISTINCT doc_id) AS mentions, count(DISTINCT text) AS unique_texts, round(count(DISTINCT doc_id) * 1.0 / (SELECT count(*) FROM documents), 6) AS share FROM documents GROUP BY source")
def doc_source_rollup(spark, sf_dir):
    return consensus.rollup(_t(spark, sf_dir, "documents"), "source", "doc_id", "text")


@_query(f"SELECT doc_id, round({_PCT}, 6) AS percentile FROM documents")
def doc_engagement_percentile(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return ranking.mid_rank_percentile(docs, "source", "n_chars").select("doc_id", F.round("percentile", 6).alias("percentile"))


@_query("""WITH l AS (SELECT doc_id, source, ln(1 + n_chars) AS g FROM documents), c AS (SELECT source, median(g) AS mid, count(g) AS n, min(g) AS lo, max(g) AS hi FROM l GROUP BY source), m AS (SELECT source, median(abs(g - mid)) AS mad FROM l JOIN c USING (source) GROUP BY source) SELECT doc_id, source, round(CASE WHEN n >= 10 AND lo < hi AND mad > 0 THEN abs(g - mid) / (1.4826 * mad) END, 6) AS z FROM l JOIN c USING (source) JOIN m USING (source)""")
def doc_engagement_anomaly(spark, sf_dir):
    return ranking.robust_z(_t(spark, sf_dir, "documents"), "source", "n_chars").select("doc_id", "source", F.round("z", 6).alias("z"))


@_query("SELECT doc_id, source, turn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256(doc_id::VARCHAR) DESC) AS turn FROM documents) ORDER BY turn, source LIMIT 100")
def doc_round_robin_sample(spark, sf_dir):
    return ranking.round_robin(_t(spark, sf_dir, "documents"), "source", "doc_id", 100).select("doc_id", "source", F.col("turn").cast("long").alias("turn"))


@_query(r"""SELECT doc_id, md5(CASE WHEN regexp_matches(text, '^[ \t\n\x0B\f\r]*[=+\-@]') OR regexp_matches(text, '^[\t\r\n]') THEN '''' || text ELSE text END) AS guarded_md5 FROM documents""")
def doc_csv_guard(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(tx.csv_guard(F.col("text")).cast("binary")).alias("guarded_md5"))


@_query("""SELECT d.doc_id, substr(d.text, 31, 25) AS quote, CASE WHEN substr(d.text, 31, 25) = '' THEN 'FAIL' WHEN substr(d.text, d.doc_id % 3 * 15 + 1, length(substr(d.text, 31, 25))) = substr(d.text, 31, 25) THEN 'EXACT' WHEN strpos(substr(d.text, strpos(d.text, substr(d.text, 31, 25)) + 1), substr(d.text, 31, 25)) = 0 THEN 'REPAIRED' ELSE 'FAIL' END AS state FROM documents d""")
def doc_evidence_spans(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text", F.substring("text", 31, 25).alias("quote"), (F.col("doc_id") % 3 * 15).cast("int").alias("claimed"))
    return docs.select("doc_id", "quote", tx.span_state("text", "quote", "claimed").alias("state"))


@_query("SELECT c.conv_id, c.turn, md5(c.text) AS own_md5, md5(coalesce(p.text, '')) AS parent_md5, md5(coalesce(r.text, '')) AS root_md5 FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1 LEFT JOIN conversations r ON r.conv_id = c.conv_id AND r.turn = 0")
def conv_parent_context(spark, sf_dir):
    out = identity.parent_context(_t(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return out.select("conv_id", "turn", F.md5(F.col("own_text").cast("binary")).alias("own_md5"), F.md5(F.col("parent_text").cast("binary")).alias("parent_md5"), F.md5(F.col("root_text").cast("binary")).alias("root_md5"))


@_query("SELECT turn, count(DISTINCT conv_id) AS threads, count(DISTINCT CASE WHEN role = 'user' THEN conv_id END) AS support, count(DISTINCT CASE WHEN role = 'assistant' THEN conv_id END) AS oppose, round((count(DISTINCT CASE WHEN role = 'user' THEN conv_id END) - count(DISTINCT CASE WHEN role = 'assistant' THEN conv_id END)) * 1.0 / nullif(count(DISTINCT CASE WHEN role = 'user' THEN conv_id END) + count(DISTINCT CASE WHEN role = 'assistant' THEN conv_id END), 0), 6) AS net_support FROM conversations GROUP BY turn")
def conv_role_counters(spark, sf_dir):
    user, other = (F.count_distinct(F.when(F.col("role") == r, F.col("conv_id"))) for r in ("user", "assistant"))
    out = _t(spark, sf_dir, "conversations").groupBy("turn").agg(F.count_distinct("conv_id").alias("threads"), user.alias("support"), other.alias("oppose"))
    return out.select("*", F.round((F.col("support") - F.col("oppose")) / F.nullif(F.col("support") + F.col("oppose"), F.lit(0)), 6).alias("net_support"))


def _burst_sql(scope: str) -> str:
    return f"""WITH e AS (SELECT event_id, event_type, epoch_us(ts) AS us FROM events), w AS (SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY us RANGE BETWEEN 900000000 PRECEDING AND CURRENT ROW) AS recent, count(*) OVER s AS n, (max(us) OVER s - min(us) OVER s) / 1e6 AS span FROM e WINDOW s AS ({scope})), x AS (SELECT *, CASE WHEN span > 900 THEN n * 900 / span END AS expected FROM w) SELECT event_id, recent, round(expected, 6) AS expected, round(recent / expected, 6) AS ratio, round((recent - expected) / sqrt(expected), 6) AS zscore, coalesce(recent >= 5 AND recent / expected >= 3, false) AS concentrated FROM x"""


@_query(_burst_sql("PARTITION BY event_type"))
def event_trailing_burst(spark, sf_dir):
    return bursts.burst(_t(spark, sf_dir, "events"), "event_type", "ts", 15, as_of=False).select("event_id", "recent", F.round("expected", 6).alias("expected"), F.round("ratio", 6).alias("ratio"), F.round("zscore", 6).alias("zscore"), "concentrated")


@_query(_burst_sql("PARTITION BY event_type ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"))
def event_asof_burst(spark, sf_dir):
    return bursts.burst(_t(spark, sf_dir, "events"), "event_type", "ts", 15, as_of=True).select("event_id", "recent", F.round("expected", 6).alias("expected"), F.round("ratio", 6).alias("ratio"), F.round("zscore", 6).alias("zscore"), "concentrated")


@_query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 450000000 PRECEDING AND 450000000 FOLLOWING) AS around FROM events")
def event_centred_burst(spark, sf_dir):
    at = _t(spark, sf_dir, "events").withColumn("at", bursts.micros("ts"))
    return bursts.in_frame(at, ["event_type"], "at", 450, 450, "around").select("event_id", "around")


@_query("SELECT event_id, CASE WHEN user_id IS NOT NULL THEN count(*) OVER (PARTITION BY event_type, user_id ORDER BY epoch_us(ts) RANGE BETWEEN 450000000 PRECEDING AND 450000000 FOLLOWING) END AS around FROM events")
def event_author_centred(spark, sf_dir):
    at = _t(spark, sf_dir, "events").withColumn("at", bursts.micros("ts"))
    return bursts.in_frame(at, ["event_type", "user_id"], "at", 450, 450, "around").select("event_id", "around")


@_query("SELECT event_id, count(*) OVER (PARTITION BY event_type, user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS last_hour, count(*) OVER (PARTITION BY event_type, user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS last_day FROM events")
def event_author_activity(spark, sf_dir):
    at = _t(spark, sf_dir, "events").withColumn("at", bursts.micros("ts"))
    keys = ["event_type", "user_id"]
    hour = bursts.in_frame(at, keys, "at", 3600, 0, "last_hour")
    return bursts.in_frame(hour, keys, "at", 86400, 0, "last_day").select("event_id", "last_hour", "last_day")


@_query("SELECT event_id, count(*) OVER (PARTITION BY event_type, user_id ORDER BY epoch_us(ts) RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS uses, round((count(*) OVER (PARTITION BY event_type, user_id ORDER BY epoch_us(ts) RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1) * 1.0 / greatest(1, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1), 6) AS reuse FROM events")
def event_asof_template_reuse(spark, sf_dir):
    at = _t(spark, sf_dir, "events").withColumn("at", bursts.micros("ts"))
    both = bursts.up_to(bursts.up_to(at, ["event_type", "user_id"], "at", "uses"), ["event_type"], "at", "seen")
    return both.select("event_id", "uses", F.round((F.col("uses") - 1) / F.greatest(F.lit(1), F.col("seen") - 1), 6).alias("reuse"))


@_query("WITH a AS (SELECT user_id, (epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts)) / 1e6 AS age FROM events), c AS (SELECT user_id, count(*) FILTER (WHERE age > 0 AND age <= 86400) AS current, count(*) FILTER (WHERE age > 86400 AND age <= 172800) AS previous FROM a GROUP BY user_id) SELECT user_id, current, previous, round((current - previous) * 1.0 / (previous + 1), 6) AS momentum, CASE WHEN (current - previous) * 1.0 / (previous + 1) >= 0.5 THEN 'RISING' WHEN (current - previous) * 1.0 / (previous + 1) <= -0.5 THEN 'FADING' ELSE 'STABLE' END AS trend FROM c")
def event_momentum(spark, sf_dir):
    return bursts.momentum(_t(spark, sf_dir, "events"), "user_id", "ts", "2024-01-20 00:00:00").withColumn("momentum", F.round("momentum", 6))


@_query("SELECT strftime((ts + INTERVAL 8 HOUR), '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def event_daily_shanghai(spark, sf_dir):
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Shanghai")
    return _t(spark, sf_dir, "events").groupBy(F.date_format(local, "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@_query("WITH s AS (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN value / (1 + abs(value)) END AS a, CASE WHEN event_id % 5 <> 0 THEN (user_id % 10) / 10.0 END AS b FROM events) SELECT event_id, round((coalesce(a, 0) * 0.6 + coalesce(b, 0) * 0.4) / nullif((CASE WHEN a IS NULL THEN 0 ELSE 0.6 END) + (CASE WHEN b IS NULL THEN 0 ELSE 0.4 END), 0), 6) AS fused FROM s")
def event_fusion_score(spark, sf_dir):
    a = F.when(F.col("event_id") % 3 != 0, F.col("value") / (1 + F.abs("value")))
    b = F.when(F.col("event_id") % 5 != 0, (F.col("user_id") % 10) / 10.0)
    return _t(spark, sf_dir, "events").select("event_id", a.alias("a"), b.alias("b")).select("event_id", F.round(judgement.fuse({"a": 0.6, "b": 0.4}), 6).alias("fused"))


@_query("WITH s AS (SELECT (event_id % 100) / 100.0 AS p, value FROM events) SELECT cut, count(*) FILTER (WHERE p < cut) AS kept, round(sum(CASE WHEN p < cut THEN (1 - p) * value END) / sum(CASE WHEN p < cut THEN 1 - p END), 6) AS mean_score FROM s CROSS JOIN (VALUES (0.5::DOUBLE), (0.6), (0.7), (0.8), (0.9)) c(cut) GROUP BY cut")
def event_weighted_direction(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select(((F.col("event_id") % 100) / 100.0).alias("p"), "value")
    return judgement.cut_sensitivity(rows, "p", "value", [0.5, 0.6, 0.7, 0.8, 0.9])


@_query("SELECT event_type, CASE WHEN (event_id % 100) / 100.0 >= 0.8 THEN 'EXCLUDE' WHEN (event_id % 100) / 100.0 >= 0.5 THEN 'DOWNWEIGHT_REVIEW' ELSE 'ACCEPT' END AS gate, count(*) AS n, round(sum((1 - (event_id % 100) / 100.0) * value) / nullif(sum(1 - (event_id % 100) / 100.0), 0), 6) AS weighted FROM events GROUP BY ALL")
def event_gate_summary(spark, sf_dir):
    p = (F.col("event_id") % 100) / 100.0
    rows = _t(spark, sf_dir, "events").select("event_type", judgement.gate(p).alias("gate"), p.alias("p"), "value")
    return rows.groupBy("event_type", "gate").agg(F.count("*").alias("n"), F.round(judgement.weighted_mean(F.col("value"), 1 - F.col("p")), 6).alias("weighted"))


_GOLD = "WITH j AS (SELECT l.doc_id, l.quality AS gold, CASE WHEN d.n_chars > 500 THEN 1 ELSE 0 END AS predicted, l.toxic, d.n_chars * 1.0 / (d.n_chars + 1000) AS p FROM labels l JOIN documents d USING (doc_id))"


def _gold(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return _t(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", F.col("quality").alias("gold"), (F.col("n_chars") > 500).cast("int").alias("predicted"), "toxic", (F.col("n_chars") / (F.col("n_chars") + 1000)).alias("p"))


@_query(f"""{_GOLD}, x AS (SELECT gold AS label, 1 AS g, 0 AS p, 0 AS tp FROM j UNION ALL SELECT predicted, 0, 1, (gold = predicted)::INT FROM j), s AS (SELECT label, sum(g)::BIGINT AS support, sum(p)::BIGINT AS predicted, sum(tp)::BIGINT AS tp FROM x GROUP BY label) SELECT *, round(tp * 1.0 / nullif(predicted, 0), 6) AS precision, round(tp * 1.0 / nullif(support, 0), 6) AS recall, round(2.0 * tp / nullif(support + predicted, 0), 6) AS f1 FROM s""")
def label_confusion(spark, sf_dir):
    return metrics.per_class(_gold(spark, sf_dir), "gold", "predicted")


@_query(f"""{_GOLD}, b AS (SELECT least(9, floor(greatest(p, 1 - p) * 10)) AS bin, greatest(p, 1 - p) AS win, ((CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) = gold)::INT::DOUBLE AS ok, 2 * (p - gold) ** 2 AS brier FROM j), g AS (SELECT bin, count(*) AS n, abs(avg(win) - avg(ok)) AS gap, sum(brier) AS brier FROM b GROUP BY bin) SELECT sum(n)::BIGINT AS n, round(sum(brier) / sum(n), 6) AS brier, round(sum(n * gap) / sum(n), 6) AS ece FROM g""")
def label_calibration(spark, sf_dir):
    return metrics.calibration(_gold(spark, sf_dir), "gold", "p")


@_query(f"""{_GOLD}, g AS (SELECT doc_id, 'quality' AS label FROM j WHERE gold = 1 UNION SELECT doc_id, 'toxic' FROM j WHERE toxic = 1), q AS (SELECT doc_id, 'quality' AS label FROM j WHERE predicted = 1 UNION SELECT doc_id, 'toxic' FROM j WHERE p > 0.7), f AS (SELECT label, count(*) FILTER (WHERE g.doc_id IS NOT NULL AND q.doc_id IS NOT NULL) AS tp, count(*) FILTER (WHERE g.doc_id IS NULL) AS fp, count(*) FILTER (WHERE q.doc_id IS NULL) AS fn FROM g FULL JOIN q USING (doc_id, label) GROUP BY label) SELECT *, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM f""")
def label_set_f1(spark, sf_dir):
    rows = _gold(spark, sf_dir)
    tagged = lambda a, b: rows.select("doc_id", F.explode(F.array_compact(F.array(F.when(a, "quality"), F.when(b, "toxic")))).alias("label"))
    return metrics.set_f1(tagged(F.col("gold") == 1, F.col("toxic") == 1), tagged(F.col("predicted") == 1, F.col("p") > 0.7), "doc_id", "label")


@_query(f"""{_GOLD}, o AS (SELECT count(*) AS n, avg((gold = predicted)::INT) AS observed FROM j), e AS (SELECT coalesce(sum(a.n * b.n), 0) AS pairs FROM (SELECT gold AS l, count(*) AS n FROM j GROUP BY gold) a JOIN (SELECT predicted AS l, count(*) AS n FROM j GROUP BY predicted) b USING (l)) SELECT n, round(observed, 6) AS observed, round(pairs::DOUBLE / (n * n), 6) AS expected, round((observed - pairs::DOUBLE / (n * n)) / nullif(1 - pairs::DOUBLE / (n * n), 0), 6) AS kappa FROM o, e""")
def label_kappa(spark, sf_dir):
    return metrics.kappa(_gold(spark, sf_dir), "gold", "predicted")


@_query("WITH a AS (SELECT DISTINCT lower(p_type) AS alias, p_size % 3 AS category, p_brand AS entity_id FROM part), m AS (SELECT p_partkey AS mention_id, lower(p_type) AS alias, p_size % 4 AS category FROM part), h AS (SELECT mention_id, count(DISTINCT entity_id) AS n, min(entity_id) AS e FROM m LEFT JOIN a USING (alias, category) GROUP BY mention_id) SELECT mention_id, CASE WHEN n = 1 THEN e END AS entity_id, CASE WHEN n = 1 THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS state FROM h")
def entity_resolution(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    mentions = part.select(F.col("p_partkey").alias("mention_id"), F.col("p_type").alias("alias"), (F.col("p_size") % 4).alias("category"))
    return dictionary.resolve(mentions, part.select(F.col("p_type").alias("alias"), (F.col("p_size") % 3).alias("category"), F.col("p_brand").alias("entity_id"))).select("mention_id", "entity_id", "state")


@_query("WITH c AS (SELECT c_mktsegment AS board, c_custkey AS entity_id, count(*) AS mentions, round(sum(o_totalprice), 2) AS volume FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) SELECT board, entity_id, mentions, volume, place FROM (SELECT *, row_number() OVER (PARTITION BY board ORDER BY mentions DESC, volume DESC, entity_id) AS place FROM c) WHERE place <= 3")
def entity_board_topk(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("entity_id")).agg(F.count("*").alias("mentions"), F.round(F.sum("o_totalprice"), 2).alias("volume"))
    ranked = orders.join(_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_mktsegment").alias("board")), "entity_id")
    top = ranking.top_per_group(ranked, "board", [F.desc("mentions"), F.desc("volume"), F.col("entity_id")], 3)
    return top.select("board", "entity_id", "mentions", "volume", F.col("place").cast("long").alias("place"))


@_query("WITH v AS (SELECT l_suppkey AS entity, l_orderkey AS comment_key, CASE l_returnflag WHEN 'A' THEN 'BULLISH' WHEN 'R' THEN 'BEARISH' ELSE 'UNKNOWN' END AS stance FROM lineitem), c AS (SELECT entity, comment_key, CASE WHEN count(DISTINCT CASE WHEN stance <> 'UNKNOWN' THEN stance END) = 1 THEN min(CASE WHEN stance <> 'UNKNOWN' THEN stance END) ELSE 'UNKNOWN' END AS stance FROM v GROUP BY ALL), a AS (SELECT entity, count(*) AS mentions, count(*) FILTER (WHERE stance = 'BULLISH') AS bullish, count(*) FILTER (WHERE stance = 'BEARISH') AS bearish FROM c GROUP BY entity) SELECT *, round(ln((1.0 + bullish) / (1 + bearish)), 4) AS bullish_index, round(bullish * 1.0 / nullif(bullish + bearish, 0), 6) AS bull_ratio, round(2.0 * least(bullish, bearish) / nullif(bullish + bearish, 0), 6) AS disagreement, CASE WHEN bullish + bearish >= 10 THEN 'SUFFICIENT' ELSE 'INSUFFICIENT' END AS sample_status FROM a")
def entity_consensus(spark, sf_dir):
    stance = F.when(F.col("l_returnflag") == "A", "BULLISH").when(F.col("l_returnflag") == "R", "BEARISH").otherwise("UNKNOWN")
    views = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity"), F.col("l_orderkey").alias("comment_key"), stance.alias("stance"))
    return consensus.consensus(consensus.collapse_views(views, "entity", "comment_key", "stance"), "entity", "stance", "BULLISH", "BEARISH")


@_query("WITH o AS (SELECT * FROM documents WHERE doc_id % 7 = 3), k AS (SELECT * FROM documents WHERE doc_id % 7 <> 3), m AS (SELECT o.doc_id AS orphan_id, k.doc_id AS known_id, coalesce((o.lang = k.lang)::INT, 0) + coalesce((o.n_chars = k.n_chars)::INT, 0) + coalesce((o.source = k.source)::INT, 0) AS s, coalesce((o.lang <> k.lang)::INT, 0) + coalesce((o.n_chars <> k.n_chars)::INT, 0) + coalesce((o.source <> k.source)::INT, 0) AS u FROM o JOIN k ON o.text = k.text) SELECT orphan_id, min(known_id) AS known_id FROM m GROUP BY orphan_id HAVING count(*) = 1 AND min(s) >= 2 AND min(u) = 0")
def identity_merge(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    # the rule that takes ids away plays the part of observations without one
    a = docs.where(F.col("doc_id") % 7 == 3).withColumnRenamed("doc_id", "orphan_id")
    b = docs.where(F.col("doc_id") % 7 != 3).withColumnRenamed("doc_id", "known_id")
    return identity.corroborated(a, b, ["text"], ["lang", "n_chars", "source"])


@_query("SELECT l_partkey AS part, first(l_suppkey ORDER BY l_orderkey, l_linenumber) AS supplier, first(l_returnflag ORDER BY l_orderkey, l_linenumber) AS flag, count(*) AS n_sources, count(DISTINCT l_suppkey) > 1 OR count(DISTINCT l_returnflag) > 1 AS conflict FROM lineitem GROUP BY l_partkey")
def identity_first_seen(spark, sf_dir):
    # rows of one order and line: the first in the file, as the SQL takes them when one thread reads
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.col("l_returnflag").alias("flag"), F.struct("l_orderkey", "l_linenumber", "_metadata.file_path", "_metadata.row_index").alias("seen"))
    return identity.first_seen(rows, "part", "seen", ["supplier", "flag"])


@_query(r"""SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS links, array_to_string(regexp_extract_all(html, 'href="([^"]*)"', 1), '|') AS targets FROM pages""")
def page_scrape(spark, sf_dir):
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return _t(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), F.size(links).cast("long").alias("links"), F.array_join(links, "|").alias("targets"))


@_query("WITH s AS (SELECT DISTINCT role, conv_id, trim(text) AS t FROM conversations WHERE trim(text) <> '') SELECT role AS space, conv_id AS comment_key, md5(string_agg(t, '；' ORDER BY t)) AS document_md5, count(*) AS parts FROM s GROUP BY ALL")
def topic_documents(spark, sf_dir):
    said = _t(spark, sf_dir, "conversations").select(F.col("role").alias("space"), F.col("conv_id").alias("comment_key"), F.col("text").alias("snippet"), F.lit("PASS").alias("gate"))
    docs = topics.documents(said)
    return docs.select("space", "comment_key", F.md5(F.col("document").cast("binary")).alias("document_md5"), F.size(F.split("document", topics.JOINER)).cast("long").alias("parts"))


@_query("SELECT event_id, json_extract_string(props, '$.k') AS k, CASE WHEN isfinite(value) AND value >= 0 THEN value END AS amount, coalesce(json_exists(props, '$.k'), false) AS has_k FROM events")
def event_props_json(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), tx.nonnegative(F.col("value")).alias("amount"), F.coalesce(F.array_contains(F.json_object_keys("props"), "k"), F.lit(False)).alias("has_k"))


@_query("SELECT row_number() OVER (ORDER BY mentions DESC, source) AS source_rank, mentions, unique_texts FROM (SELECT source, count(*) AS mentions, count(DISTINCT text) AS unique_texts FROM documents GROUP BY source)")
def public_projection(spark, sf_dir):
    from pyspark.sql import Window

    ranked = _t(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("mentions"), F.count_distinct("text").alias("unique_texts"))
    # an allow-list: names of sources are renumbered, nothing else leaves
    return ranked.select(F.row_number().over(Window.orderBy(F.desc("mentions"), "source")).cast("long").alias("source_rank"), "mentions", "unique_texts")


from tallyloom.plans import evaluation, opinion, similarity  # noqa: E402, F401  (they register their queries)

__all__ = ["ORACLES", "QUERIES"]
