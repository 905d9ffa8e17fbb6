"""Rules of the corpus operators that whole-table runs rarely meet: bounds, hot groups, collisions, odd rows."""

import itertools
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm import common, html, html_pages, ivfpq, langid, linear, linededup, neardup, packing, quality, queries, tokencount, toxicity
from tallyloom.llm.common import bucket, ids_of

ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "one two"), (4, "one two"), (None, "a b c d e f"), (5, "word " * 30_000), (6, "💥 $ 4.5 kg")]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, node string, key long")


def test_marginals_equal_enumeration():
    rnd = np.random.default_rng(3)
    for _ in range(12):
        page = html.Page("<div>" + "".join(random.Random(int(rnd.integers(99))).choices(["<p>a", "<div>b", "</div>", "<ul><li>c"], k=6)))
        model = html.Model(rnd.normal(size=html.WIDTH).astype(np.float32), rnd.normal(size=(2, 2)))
        score, parents = html.features(page) @ model.unary, [n.parent for n in page.nodes]
        total, on = 0.0, np.zeros(len(parents))
        for labels in itertools.product((0, 1), repeat=len(parents)):
            energy = sum(s * y for s, y in zip(score, labels)) + sum(model.pair[labels[p], y] for p, y in zip(parents, labels) if p >= 0)
            total += np.exp(energy)
            on += np.exp(energy) * np.array(labels)
        assert np.allclose(model.marginals(page), on / total, atol=1e-6)


def test_extraction_of_elements_left_open(spark):
    model, text = html_pages.default_model(), "Some text, that is long enough to be seen as content."
    for page in (f"<html><head><title>x</title><body><article><p>{text}", f"<head><meta charset=x><article><p>{text}", f"<article><form><select><option>a<option>b</form><p>{text}", f"<article><button>Press<p>{text}</article>"):
        assert model.extract(page) == text
    begin = time.time()
    model.extract("<div>x" * 30_000)
    assert time.time() - begin < 20
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string, text string"), model).count() == 0
    twice = spark.createDataFrame([(1, "u", f"<p>{text}", "t")] * 2, "page_id long, url string, html string, text string")
    assert [r.text for r in html.extract(twice, model).collect()] == [text] * 2


def test_language_rules(spark):
    assert all(langid.Coder({"fr": b"abc" * 50, "en": b"xyz" * 50}).predict(t)[0] == "und" for t in ("½", "²³ ①", "Ⅷ", "", None, "12 !"))
    rnd = random.Random(4)
    said = {"aa": "mano tira lo fesu kati".split(), "bb": "grth wolk schn dreb plimt".split()}
    text = lambda lang, n: " ".join(rnd.choice(said[lang]) for _ in range(n))
    rows = [(i, text(lang, 60), lang, 1.0) for i, lang in enumerate(["aa", "bb"] * 40)]
    rows += [(7, "grth " * 40, "aa", 1.0)] * 300 + [(500, "q", None, 2.0), (None, text("bb", 9), "bb", 3.0), (501, text("aa", 30_000), None, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, margin double")
    learned = langid.dictionaries(docs, F.lit(True), rows_per_language=30, dictionary_bytes=4096)
    assert set(learned) == {"aa", "bb"} and all(0 < len(d) <= 4096 for d in learned.values()) and learned["aa"].count(b"grth") < 100
    got = langid.identify(docs, F.lit(True), columns=["doc_id", "margin", "lang"]).toPandas()
    assert list(got.columns) == ["doc_id", "margin", "lang", "lang_pred", "score", "margin", "rejected"] and len(got) == len(rows)
    kept = langid.identify(docs, F.lit(True)).toPandas().set_index("doc_id")
    assert kept.lang_pred[501] == "aa" and not kept.rejected[501] and kept.rejected[500]
    assert langid.identify(docs.limit(0), F.lit(True)).count() == 0


def test_packing_deals_alike_in_any_order(spark):
    rows = [(1, "same text here")] * 40 + [(i, f"text {i} " * (i % 7)) for i in range(60)] + [(999, "long one " * 3000)]
    dealt = []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        out = packing.pack(docs_of(spark, rows).coalesce(1), capacity=64, docs_per_bin=10).select("doc_id", "start", "length", "sequence_id", "offset", F.crc32("ids").alias("c"))
        dealt.append(sorted(map(tuple, out.collect())))
    assert dealt[0] == dealt[1]
    assert len({r[3] >> 32 for r in dealt[0] if r[0] == 999}) > 8 and len({r[3] >> 32 for r in dealt[0] if r[0] == 1}) > 4
    assert packing.pack(docs_of(spark, [])).count() == 0
    bins = packing.pack(docs_of(spark, [(i, "w " * 3000) for i in range(8)]), bytes_per_bin=6000).select(F.shiftright("sequence_id", 32)).distinct().count()
    assert bins > 3


def test_lines_whose_ids_collide(spark, monkeypatch):
    rnd = random.Random(9)
    lines = ["".join(rnd.choice("abcdefg ") for _ in range(40)).strip() or "x" for _ in range(60)]
    rows = [(i, "\n".join(rnd.choice(lines) for _ in range(5))) for i in range(40)]
    plain = sorted(map(tuple, linededup.line_report(docs_of(spark, rows)).collect()))
    real = linededup.line_id
    monkeypatch.setattr(linededup, "line_id", lambda line, seed=17: F.pmod(real(line), F.lit(20)) if seed == 17 else real(line, seed))
    assert sorted(map(tuple, linededup.line_report(docs_of(spark, rows)).collect())) == plain


def test_line_report_equals_brute_force(spark):
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abcdef ") for _ in range(rnd.choice([6, 14, 30, 60]))).strip() for _ in range(25)]

    def some():
        line = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2])):
            line[rnd.randrange(len(line)) : rnd.randrange(len(line)) + 1] = rnd.choice(["", "z", "q"]) if line else ""
        return "".join(line).strip() or "x"

    rows = [(i, "\n".join(some() for _ in range(4))) for i in range(40)] + [(None, base[0]), (7, None)]
    distinct = sorted({x for _, t in rows for x in (t or "").split("\n") if x})

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    near = {a: [b for b in distinct if a != b and abs(len(a) - len(b)) <= 2 and edits(a, b) <= linededup.allowed(min(len(a), len(b)))] for a in distinct}
    root = {a: a for a in distinct}
    for _ in distinct:
        for a in distinct:
            root[a] = min([root[a], *(root[b] for b in near[a])])
    seen, members = {}, {}
    for i, t in sorted(rows, key=lambda r: 2**63 if r[0] is None else r[0]):
        for x in (t or "").split("\n"):
            if x:
                seen.setdefault(root[x], i)
                members.setdefault(root[x], []).append(x)
    want = {}
    for i, t in rows:
        own = [x for x in (t or "").split("\n") if x]
        shared = [x for x in own if len(members[root[x]]) > 1]
        firsts = [seen[root[x]] for x in shared if seen[root[x]] is not None]
        want[i, len(own)] = (len(shared), sum(len(near[x]) for x in own), min(firsts, default=None))
    got = {(r.doc_id, r.n_lines): (r.n_shared, r.n_links, r.first_doc) for r in linededup.line_report(docs_of(spark, rows)).collect()}
    assert got == want


def test_search_rules(spark):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(60, 4))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5, x[6].tolist())] * 2 + [(100 + i, [float(i), 1.0]) for i in range(4)] + [(200, [0.0, 0.0]), (None, [1.0, 1.0])]
    got = ivfpq.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id").isin(0, 5, 6, 100), k=5).toPandas()
    for q in (0, 6):
        d = {i: np.sqrt(((v - x[q]) ** 2).sum()) for i, v in enumerate(x) if i != q}
        d[5] = min(d[5], np.sqrt(((x[6] - x[q]) ** 2).sum())) if q != 5 else 0
        assert got[got.query_id == q].sort_values("rank").vec_id.tolist() == sorted(d, key=lambda i: (d[i], i))[:5]
    assert got[got.query_id == 5].vec_id.is_unique and len(got[got.query_id == 5]) == 5
    assert got[got.query_id == 100].sort_values("rank").vec_id.tolist() == [101, 102, 103]
    tied = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(40)], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in ivfpq.search(tied, F.col("vec_id") == 0, k=4).orderBy("rank").collect()] == [2, 4, 6, 8]
    assert ivfpq.search(tied.limit(0), F.col("vec_id") == 0).count() == 0


def test_search_recall_on_the_table(spark):
    got = queries.op7_ivf_pq_search(spark, "/root/testdata/sf0.1").toPandas()
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").dropna(subset=["embedding"]).toPandas().sort_values("vec_id")
    x, ids, hits = np.stack(table.embedding).astype(float), table.vec_id.to_numpy(), 0
    for q, found in got.groupby("query_id"):
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        hits += len(set(ids[np.lexsort((ids, d))[:10]]) & set(found.vec_id))
    assert hits >= 0.9 * len(got)


def test_training_rows_are_bounded_and_repeatable(spark):
    docs = docs_of(spark, [(1, f"text {i}") for i in range(300)] + [(i, f"doc {i}") for i in range(2, 50)])
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    one = lambda t: [toxicity.features(t)]
    rows = linear.training_rows(docs, labels, "toxic", F.lit(True), 20, one)
    assert len(rows) <= 20 and 2 not in {i for i, _, _ in rows} and len({i for i, _, _ in rows}) == len(rows)
    again = linear.training_rows(docs.repartition(7), labels.repartition(3), "toxic", F.lit(True), 20, one)
    assert [(i, fs[0][0].tolist(), y) for i, fs, y in rows] == [(i, fs[0][0].tolist(), y) for i, fs, y in again]


def test_ftrl_equals_a_dense_version():
    rnd = np.random.default_rng(5)
    size, rows = 12, []
    for _ in range(40):
        at = np.sort(rnd.choice(np.arange(1, size), 4, replace=False))
        rows.append(((at, rnd.random(4)), int(rnd.random() < 0.4)))
    got = linear.fit(rows, size, epochs=2, seed=7, alpha=0.3, l1=0.2)
    z, n, order = [0.0] * size, [0.0] * size, np.random.default_rng(7)
    weight = lambda i: 0.0 if abs(z[i]) <= 0.2 else -(z[i] - np.sign(z[i]) * 0.2) / ((1.0 + n[i] ** 0.5) / 0.3 + 1e-3)
    for _ in range(2):
        for k in order.permutation(len(rows)):
            (at, x), y = rows[k]
            values = {0: 1.0, **dict(zip(at.tolist(), x))}
            w = {i: weight(i) for i in values}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in values.items())))
            for i, v in values.items():
                g = (p - y) * v
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.3 * w[i]
                n[i] += g * g
    assert np.allclose(got, [weight(i) for i in range(size)], atol=1e-6)


def test_scores_equal_dense_products(spark):
    rnd, docs = np.random.default_rng(8), docs_of(spark, ODD)
    for module in (toxicity, quality):
        weights = rnd.normal(size=module.SIZE).astype(np.float32)
        got = linear.score(docs, module.features, weights, 0.3).collect()
        for (i, t), r in zip(ODD, got):
            dense = np.zeros(module.SIZE)
            at, x = module.features(t or "")
            dense[at] = x
            dense[0] = 1
            want = 1 / (1 + np.exp(-np.clip(dense @ weights.astype(float), -35, 35)))
            assert r.doc_id == i and abs(r.score - want) < 1e-6 and r.predicted == int(r.score >= 0.3)
        assert linear.score(docs.limit(0), module.features, weights, 0.3).count() == 0
    assert quality.shape("ÀB-cd12!!" * 3) == "X-x9!!" * 3


def test_counts_of_long_words_and_empty_tables(spark):
    begin, ids = time.time(), ids_of()
    for text in ("a" * 300_000, "a@" * 100_000, "a1234," * 50_000, "x.y@z " * 20_000):
        tree = tokencount.CountTree(text, ids)
        todo = tokencount.redactions(text)
        tree.apply(todo)
        out, at = [], 0
        for a, b, new in todo:
            out += [text[at:a], new]
            at = b
        assert tree.n_tokens == len(ids.encode("".join(out) + text[at:]))
    assert time.time() - begin < 60
    assert tokencount.counts(docs_of(spark, []), tokencount.redactions).count() == 0
    with pytest.raises(ValueError):
        tokencount.CountTree("abcdef", ids).apply([(0, 3, ""), (2, 4, "")])


def test_hot_buckets_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 6)
    monkeypatch.setattr(neardup, "CHUNK", 4)
    monkeypatch.setattr(neardup, "DEALT", 2)
    rnd = random.Random(15)
    word = lambda: "w" + str(rnd.randint(0, 10**6))
    shared = [word() for _ in range(60)]
    rows = []
    for i in range(50):
        own = shared + [word() for _ in range(50)]
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(own[:-1] + [word()]))]
    rnd.shuffle(rows)
    sets = {i: neardup.shingles(t, 5) for i, t in rows}
    root = {i: min(j for j in sets if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])) for i in sets}
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == root


def test_pipeline_of_odd_and_repeated_rows(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first = docs.where("doc_id < 3")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "s", 0), (9001, None, "en", "s", 0)], docs.schema)
    none = first.withColumn("doc_id", F.lit(None).cast("long"))
    more = docs.unionByName(first).unionByName(odd).unionByName(none)
    kept = corpus_pipeline.keep_one_of_each_group(spark, more, "/root/testdata/sf0.001")
    plain = corpus_pipeline.keep_one_of_each_group(spark, docs, "/root/testdata/sf0.001")
    texts = lambda df: sorted((r.doc_id, r.text) for r in df.where("doc_id < 9000").collect())
    assert texts(kept) == texts(plain) and kept.where("doc_id is null and text <> ''").count() == 0
    folder = tmp_path / "t"
    more.write.parquet(str(folder / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(str(folder / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(folder)).toPandas()
    assert len(out) and not out.doc_id.isna().any() and out.groupby("sequence_id").length.sum().max() <= 2048
    assert (out.groupby("doc_id").length.sum() == out.groupby("doc_id").doc_tokens.first()).all()
    docs.limit(0).write.parquet(str(tmp_path / "e" / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(str(tmp_path / "e" / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "e")).count() == 0


def test_stages_refuse_a_folder_that_machines_do_not_share():
    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Cluster:
        conf = Conf()
        sparkContext = type("C", (), {"getConf": staticmethod(lambda: Conf()), "master": "yarn"})

    with pytest.raises(ValueError):
        common.shared_dir(Cluster())


def test_folds_are_the_contracts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", (bucket("doc_id", 4) == 2).alias("held"))
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in docs.collect())


def test_near_loses_no_row_that_shares_a_code():
    """A ball far smaller than a codeword's reach: the codes alone can't order its rows."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16))
    x[:2000] = 3 + rng.normal(size=(2000, 16)) * 1e-6
    model = ivfpq.Model(x, 1, 4, 16)
    own, codes, away = model.encode(x)
    keep = model.near(x[:50], 0, codes, away, x, 11)
    for q in range(50):
        true = np.argsort(((x - x[q]) ** 2).sum(1))[:11]
        assert keep[q, true].all()
        by_code = np.argpartition(model.distances(x[q : q + 1], 0, codes)[0], 199)[:200]
        assert len(set(by_code) & set(true)) < 10  # what the first 200 by code alone would find
    assert keep.mean() < 0.5
