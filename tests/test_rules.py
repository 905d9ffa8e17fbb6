"""Similar texts, catalogues, judgements, samples and the model boundary, on small hand-made rows."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import text as tx
from tallyloom.operators import bursts, dictionary, graph, judgement, metrics, opinion, provider, sampling, similarity, topics
from tallyloom.streaming import bursts as stream


def some_texts(n, seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abcd ef") for _ in range(r.choice([1, 3, 8, 20, 40]))) for _ in range(14)]
    out = []
    for i in range(n):
        t = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2])):
            k = r.randint(0, len(t))
            t[k : k + r.randint(0, 1)] = r.choice(["", "x", "yz"])
        out.append((i, r.choice("pq"), "".join(t)))
    return out


def test_near_pairs_lose_none(spark):
    rows = some_texts(70, 3)
    df = spark.createDataFrame(rows, "id long, platform string, text string")
    want = {(i, j) for i, p, t in rows for j, q, u in rows if i < j and p == q and SequenceMatcher(None, u, t, autojunk=False).ratio() >= 0.9}
    assert {(r.a, r.b) for r in similarity.near_pairs(df).collect()} == want


def test_leader_groups_equal_the_greedy_pass(spark):
    rows = [(i, t) for i, _, t in some_texts(60, 8)] + [(900, "💥"), (901, None), (902, "STRASSE eins zwei drei"), (903, "straße eins zwei drei")]
    got = {r.comment_key: r.group_id for r in similarity.leader_groups(spark.createDataFrame(rows, "comment_key long, text string")).collect()}
    fold = lambda t: "".join(c for c in t.casefold() if c.isalnum() or c == "_")
    heads, group = [], {}
    for t in sorted({t for _, t in rows if t and any(c.isalnum() for c in t)}):
        k = fold(t)
        fits = [h for h in sorted(heads) if h == k or (abs(len(h) - len(k)) <= max(2, 0.15 * len(k)) and SequenceMatcher(None, k, h, autojunk=False).ratio() >= 0.9)]
        if not fits:
            heads.append(k)
        group[t] = fits[0] if fits else k
    want = {i: group[t] for i, t in rows if t in group}
    assert got.keys() == want.keys() and {(got[a] == got[b]) for a in want for b in want if want[a] == want[b]} == {True}
    assert len(set(got.values())) == len(set(want.values())) and got[902] == got[903]


def test_components_and_leaders(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 51), (60, 60)], "a long, b long")
    nodes = spark.range(62).withColumnRenamed("id", "node")
    got = {r.node: r.component for r in graph.components(nodes, edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[51] == 50 and got[60] == 60 and got[45] == 45
    chain = spark.createDataFrame([(i + 1, i) for i in range(9)], "a long, b long")
    assert {r.node for r in graph.leaders(spark.range(10).withColumnRenamed("id", "node"), chain).collect()} == {0, 2, 4, 6, 8}


def test_as_of_clusters_ignore_what_comes_later(spark):
    rows = [(1, 10, "a"), (2, 20, "b"), (3, 30, None), (4, 20, "b"), (5, None, "c")]
    frame = lambda r: spark.createDataFrame(r, "id long, available long, author string")
    pairs = spark.createDataFrame([(1, 3, 1.0), (2, 3, 1.0), (2, 4, 1.0), (1, 9, 1.0)], "a long, b long, similarity double")
    look = lambda r: {x.id: (x.cluster_id, x.cluster_size, x.n_authors, x.span) for x in similarity.as_of_clusters(frame(r), pairs).collect()}
    got = look(rows)
    assert got[1] == (1, 1, 1, 0) and got[2] == got[4] == (2, 2, 1, 0) and got[3] == (1, 4, 2, 20) and got[5] == (None, None, None, None)
    assert {k: v for k, v in look([*rows, (9, 40, "z")]).items() if k != 9} == got


def test_mentions_take_the_leftmost_longest(spark):
    names = spark.createDataFrame([("Acme", 1), ("Acme Bank", 2), ("ACME", 3), ("银行", 4), ("", 5), (None, 6), ("a+", 7)], "alias string, entity_id int")
    texts = spark.createDataFrame([(1, "acme bank and Acme"), (2, "acmes 大银行"), (3, None), (4, ""), (5, "an a+ a+b")], "id int, text string")
    got = sorted((r.id, r.entity_id, r.alias, r["at"]) for r in dictionary.mentions(texts, names).collect())
    assert got == [(1, 1, "acme", 14), (1, 2, "acme bank", 0), (1, 3, "acme", 14), (2, 4, "银行", 7), (5, 7, "a+", 3)]
    assert dictionary.mentions(texts, names.where("false")).count() == 0


def test_resolution_rules(spark):
    alias = spark.createDataFrame([("老百姓", "STOCK", "e1", "老百姓", "2020-01-01", None), ("Bolt", "INDEX", "e2", "Bolt", None, "2023-12-31")], "alias string, category string, entity_id string, name string, valid_from string, valid_to string")
    rows = [(1, "老百姓", "STOCK", "2024-01-01", "老百姓", "老百姓都说好"), (2, "老百姓", "STOCK", "2024-01-01", "老百姓", "我买了老百姓"), (3, "bolt", "ASSET", "2023-01-01", "a bolt", ""), (4, "bolt", "INDEX", "2024-01-01", "bolt", ""), (5, "bolt", "INDEX", None, "bolts", ""), (6, "老百姓", "STOCK", "2019-01-01", "老百姓", "买老百姓")]
    got = {r.mention_id: (r.entity_id, r.reason) for r in dictionary.resolve(spark.createDataFrame(rows, "mention_id int, alias string, category string, day string, quote string, text string"), alias).collect()}
    lost = "AMBIGUOUS_OR_MISSING_OR_UNGROUNDED"
    assert got == {1: (None, "ORDINARY_PHRASE_REQUIRES_DISAMBIGUATION"), 2: ("e1", None), 3: ("e2", None), 4: (None, lost), 5: (None, lost), 6: (None, lost)}


def test_catalogue_changes(spark):
    schema = "id string, name string, category string, layer string, code string, aliases array<string>"
    a = spark.createDataFrame([("s1", "Alpha", "STOCK", "SECURITY", "1", ["A"]), ("c1", "Alpha", "STOCK", "CONCEPT", None, ["AA"]), ("c2", "Beta", "STOCK", "CONCEPT", "9", [])], schema)
    b = spark.createDataFrame([("c2", "Beta2", "SECTOR", "CONCEPT", None, ["B"])], schema)
    both = dictionary.upsert(a, b)
    assert {r.id: r.name for r in both.collect()} == {"s1": "Alpha", "c1": "Alpha", "c2": "Beta2"}
    assert {r.id: r.aliases for r in dictionary.fold_concepts(both).collect()} == {"s1": ["A", "AA"], "c2": ["B"]}
    assert {r.name for r in dictionary.insert_missing(b, a).collect()} == {"Beta2", "Alpha", "Beta"}
    patch = spark.createDataFrame([("s1", ["Z"], ["A"])], "id string, add array<string>, remove array<string>")
    assert {r.id: r.aliases for r in dictionary.patch_aliases(a, patch).collect()}["s1"] == ["Z"]
    assert {r.category: r.n for r in dictionary.coverage(both).collect()} == {"STOCK": 2, "SECTOR": 1}


def test_folding(spark):
    words = ["STRASSE", "straße", "ΣΊΣΥΦΟΣ", "ﬁn", "İ", "ǅ", "Ꭰ", "ab_1!"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(tx.fold(F.col("w")).alias("f"), tx.digest(F.col("w")).alias("d")).collect()
    assert [r.f for r in got] == [w.casefold() for w in words]
    import hashlib
    import json

    assert [r.d for r in got] == [hashlib.sha256(json.dumps(w, ensure_ascii=False).encode()).hexdigest() for w in words]


def test_judgement_rules(spark):
    rows = spark.createDataFrame([(0.9, None, 1, 2.0, 0.5, 3), (None, 0.8, 2, None, None, None)], "judged double, similarity double, cluster_size int, zscore double, reuse double, hour_count int")
    parts = judgement.components()
    got = rows.select(*(c.cast("double").alias(n) for n, c in parts.items())).collect()
    assert [tuple(r) for r in got] == [(0.9, None, 0.4, 0.5, 0.2), (None, 0.8, None, None, None)]
    unit = lambda *x: spark.createDataFrame([x], "t string, q string, s int, e int, c string, r string").select(judgement.unit_gate(*(F.col(c) for c in "tqsecr"), F.lit("1.SH")).alias("g")).first().g
    assert unit("💥buy", "buy", 1, 4, "1.SZ", "PRIMARY") == "PASS" and unit("buy", "buy", 1, 4, "1", "PRIMARY") == "REVIEW_INVALID_EVIDENCE"
    assert unit("buy", "buy", 0, 3, "2", "PRIMARY") == "EXTERNAL_NO_TARGET_DIRECTION" and unit("buy", "buy", 0, 3, "1", None) == "REVIEW_SUBJECT_RELATION"
    features = spark.createDataFrame([("PIT_CAUSAL", "PASS"), ("RETROSPECTIVE", "PASS")], "mode string, state string")
    assert judgement.require_as_of(features.limit(1)).count() == 1
    with pytest.raises(Exception, match="own time"):
        judgement.require_as_of(features).collect()
    labels = spark.createDataFrame([(1, "BULLISH"), (2, "BULLISH"), (3, "BEARISH")], "id long, direction string")
    members = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 4)], "cluster_id long, id long")
    assert tuple(judgement.cluster_direction(members, labels).first()) == (1, 3, "BULLISH", 0.666667)
    unit_type = "array<struct<subject_relation:string,stance:string>>"
    base = spark.createDataFrame([("1", "p", "t", [("PRIMARY_SUBJECT", "BULLISH"), ("PRIMARY_SUBJECT", "BEARISH")]), ("2", "p", "t", []), ("3", "p", "t", []), ("3", "p", "t", [])], f"cid string, platform string, text string, units {unit_type}")
    results = spark.createDataFrame([(i, str(i), "p", "t", "BULLISH") for i in (1, 2, 3)], "id long, cid string, platform string, text string, direction string")
    assert {r.id: (r.baseline_direction, r.disagrees) for r in judgement.compared(results, base).collect()} == {1: ("MIXED", True), 2: ("NO_DIRECTIONAL_UNIT", None)}


def test_gold_is_checked(spark):
    gold = spark.createDataFrame([("a", "x", "UP", "COMPLETED", "me"), ("b", "y", None, "PENDING", None)], "sample_id string, text_sha256 string, label string, annotation_status string, annotator string")
    made = spark.createDataFrame([("a", "x", "SUCCESS", "UP", {"UP": 1.0})], "sample_id string, text_sha256 string, status string, predicted string, probabilities map<string,double>")
    assert metrics.joined_gold(gold, made, "label").count() == 1
    for g, p in ((gold.union(gold), made), (gold, made.withColumn("text_sha256", F.lit("z"))), (gold.withColumn("annotator", F.lit("")), made)):
        with pytest.raises(Exception):
            metrics.joined_gold(g, p, "label").collect()
    with pytest.raises(Exception, match="closed set"):
        metrics.closed_set(metrics.joined_gold(gold, made, "label"), ["UP", "DOWN"])[1].collect()
    nothing = metrics.closed_set(metrics.joined_gold(gold, made, "label").limit(0), ["UP", "DOWN"])
    assert nothing[1].first().state == "PENDING_HUMAN_GOLD" and nothing[0].count() == 2
    pairs = spark.createDataFrame([("a" if i % 3 else "b", "a") for i in range(90)], "gold string, predicted string")
    first, again = metrics.bootstrap_accuracy(pairs).first(), metrics.bootstrap_accuracy(pairs.repartition(5)).first()
    assert first == again and first.low <= first.accuracy <= first.high and metrics.bootstrap_accuracy(pairs.limit(1)).first().state == "INSUFFICIENT_HUMAN_GOLD"
    audit = spark.createDataFrame([("t", True, "m"), ("t", False, "m"), ("u", True, None)], "topic_id string, relevant boolean, annotator string")
    assert {r.topic_id: (r.rate, r.acceptance) for r in metrics.topic_audit(audit).collect()} == {"t": (0.5, "CANDIDATE"), "u": (None, "CANDIDATE")}
    scores = spark.createDataFrame([("intents", 0.9, 0.9, 0.9, 0.9)], "task string, precision double, recall double, macro_f1 double, micro_f1 double")
    assert {(r.task, r.passed) for r in metrics.acceptance(scores).collect()} >= {("intents", True), ("actions", False)} and metrics.acceptance(scores).count() == 10


def test_sampling_plans(spark):
    rows = spark.createDataFrame([(i, f"text {i} 不买?" if i % 3 else "定投 推荐", f"v{i % 4}", f"g{i // 2}", i % 3, i % 11 != 0) for i in range(900)], "comment_key long, text string, video string, group_id string, n_candidates int, valid boolean")
    plan = sampling.annotation_plan(rows, random=60, challenge=60, each=10, dev=40, double=20)
    got = plan.collect()
    assert len({r.group_id for r in got}) == len(got) == 120 and sum(r.split == "dev" for r in got) == 40 and sum(r.double for r in got) == 20
    assert sampling.annotation_plan(rows.where("comment_key < 300"), random=30, challenge=100, each=10, dev=40, double=20).where("stratum = 'CHALLENGE'").count() == 100
    assert sorted(map(str, got)) == sorted(map(str, sampling.annotation_plan(rows.repartition(7), random=60, challenge=60, each=10, dev=40, double=20).collect()))
    sizes = {f"g{i}": 1 + i % 4 for i in range(30)}
    assert sum(sizes[g] for g in sampling.exact_groups(sizes, 33)) == 33 and sum(sizes[g] for g in sampling.greedy_groups(sizes, 33)) <= 33
    with pytest.raises(ValueError):
        sampling.exact_groups({"a": 2, "b": 4}, 5)
    records = spark.createDataFrame([("r1", "t", "p", 10, "g"), ("r2", "u", "p", 20, "g")], "record_id string, text string, platform string, available long, group_id string")
    seen = lambda at: spark.createDataFrame([("r1", "x", at, "author")], "record_id string, text string, available long, author string")
    pack = {r.record_id: r for r in sampling.blind_pack(records, "s", "T", seen(9)).collect()}
    assert pack["r1"].visible[0].author != "author" and len(pack["r1"].visible[0].author) == 16 and pack["r2"].gold_label is None
    with pytest.raises(Exception, match="future"):
        sampling.blind_pack(records, "s", "T", seen(11)).collect()
    assert sampling.platform_quota(records, {"p": 1}).count() == 1 and sampling.first_of_each(records, 1).count() == 1
    with pytest.raises(ValueError):
        sampling.platform_quota(records, {"p": 3})


def test_model_boundary(spark):
    questions = spark.createDataFrame([(1, "q1"), (2, "q2"), (3, "q2")], "id long, question string").withColumn("key", provider.cache_key(F.col("question"), model="m", prompt="1"))
    answers = spark.createDataFrame([], "key string, version string, status string, answer string, reason string")
    hits, misses = provider.split(questions, answers, "v")
    assert hits.count() == 0 and misses.count() == 2
    got = provider.asked(misses, lambda q, told: {"answer": q, "tokens": 5}, lambda a: None, "v", calls=10, tokens=10**6)
    assert provider.split(questions, got, "v")[0].count() == 3 and provider.split(questions, got, "w")[0].count() == 0
    waits, turns = [], iter([provider.Again("429"), {"tokens": 1, "truncated": True}, {"tokens": 1}])

    def flaky(question, told):
        turn = next(turns)
        if isinstance(turn, Exception):
            raise turn
        return turn | {"told": told}

    status, answer, _ = provider.ask("q", flaky, lambda a: None, provider.Quota(9, 9000), 1000, wait=waits.append)
    assert status == "SUCCESS" and waits == [1] and "cut short" in answer
    assert provider.ask("q", flaky, lambda a: None, provider.Quota(0, 0), 1)[0] == "SKIPPED"
    assert isinstance(provider.failure(401), provider.Stop) and isinstance(provider.failure(503), provider.Again) and isinstance(provider.failure(400), provider.Refused)
    check = provider.probability_check({"d": ["UP", "DOWN"]})
    assert check({"d": {"choice": "UP", "probabilities": {"UP": 0.7, "DOWN": 0.3}}}) is None and check({"d": {"choice": "UP", "probabilities": {"UP": True, "DOWN": 0.0}}})
    failed = got.withColumn("status", F.lit("FAILED"))
    assert {r.status for r in provider.merged(got, failed).collect()} == {"SUCCESS"}


def test_topics(spark):
    said = spark.createDataFrame([("RISK", 1, " b "), ("RISK", 1, "a"), ("RISK", 1, "a"), ("RISK", 2, "a；b"), ("RISK", 3, "")], "space string, comment_key long, snippet string").withColumn("gate", F.lit("PASS"))
    docs = topics.documents(said)
    assert {r.comment_key: r.document for r in docs.collect()} == {1: "a；b", 2: "a；b"} and topics.unique_documents(docs).first().n == 2
    vectors = spark.createDataFrame([(i, [float(i % 2) * 9, float(i % 5) / 9]) for i in range(60)], "id long, embedding array<double>")
    status, rows = topics.cluster(vectors, 2)
    assert status == "SUCCESS" and {(r.id % 2, r.topic_id) for r in rows.collect()} in ({(0, 0), (1, 1)}, {(0, 1), (1, 0)}) and topics.cluster(vectors.limit(9), 2) == ("INSUFFICIENT_DATA", None)
    words = topics.keywords(spark.createDataFrame([(0, "bank bank loan"), (1, "gold gold mine 黄金矿")], "topic_id int, document string"))
    assert {r.topic_id: r.term for r in words.where("place = 1").collect()} == {0: "bank", 1: "gold"}
    assert {r.topic_id: r.origin for r in topics.names(words, spark.createDataFrame([(0, "Money")], "topic_id int, name string")).collect()} == {0: "MODEL", 1: "KEYWORDS"}


def test_missing_keys_and_clocks_count_for_nothing(spark):
    rows = spark.createDataFrame([(1, "p", 0), (2, "p", 5), (3, "p", None), (4, None, 5), (5, "p", 5)], "id int, p string, s long").withColumn("at", F.col("s") * bursts.SECOND)
    got = {r.id: (r.n, r.upto) for r in bursts.up_to(bursts.in_frame(rows, ["p"], "at", 3, 0, "n"), ["p"], "at", "upto").collect()}
    assert got == {1: (1, 1), 2: (2, 3), 3: (None, None), 4: (None, None), 5: (2, 3)}


def test_unusable_comments_are_left_out(spark):
    comments = spark.createDataFrame([(1, True, "SUCCESS", None), (2, True, "SUCCESS", "FAIL"), (3, False, "SUCCESS", None), (4, None, "PARTIAL", "PASS"), (5, True, None, None)], "comment_key long, valid boolean, status string, identity_status string")
    assert {r.comment_key for r in opinion.eligible(comments).collect()} == {1, 4}


def test_stream_counts(spark, tmp_path):
    spark.createDataFrame([("p", i * 60) for i in range(10)], "platform string, s long").withColumn("at", F.timestamp_seconds("s")).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("platform string, s long, at timestamp").parquet(str(tmp_path / "in"))
    run = stream.sliding_counts(events, "platform", "at", 5, 5).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(r.n for r in spark.table("counted").collect()) == [5, 5]
