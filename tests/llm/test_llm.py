"""Corpus operators against brute force, round trips and awkward rows."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm import decontaminate, html, html_pages, ivfpq, langid, linededup, neardup, packing, quality, queries, tokencount, toxicity
from tallyloom.llm.common import bucket, ids_of

SMALL = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "one two"), (4, "one two"), (None, "a b c d e f"), (5, "word " * 30_000), (6, "💥 $ 4.5 kg")]


def docs_of(spark, rows):
    """Rows with columns of names that operators use inside."""
    return spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, node string, key long")


def test_ids_equal_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    library, rnd = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), random.Random(3)
    parts = ["\xa0", *" \n\taB'sé9.漢💥", "<|endoftext|>", "<|endoftext", "|>"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(500)] + ["a <|endoftext|> b"]
    assert [ids_of().encode(t) for t in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert ids_of().encode("a <|endoftext|> b") == [64, 220, 50256, 275]


def test_near_duplicates_equal_all_pairs(spark):
    rnd = random.Random(5)
    base = [[rnd.choice("abcdefghij") + str(rnd.randint(0, 99)) for _ in range(120)] for _ in range(6)]
    rows = []
    for i in range(90):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 5)):
            w[rnd.randrange(len(w))] = "edit" + str(rnd.randint(0, 999))
        rows.append((i, " ".join(w)))
    sets = {i: neardup.shingles(t, 5) for i, t in rows}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = neardup.near_duplicates(docs_of(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == root
    assert all(r.kept == (r.doc_id == r.component_id) and r.n_shingles == len(sets[r.doc_id]) for r in got)


def test_near_duplicates_of_odd_rows(spark):
    got = sorted((tuple(r) for r in neardup.near_duplicates(docs_of(spark, ODD)).collect()), key=str)
    assert len(got) == len(ODD) and (1, 0, 1, True) in got and (2, 0, 2, True) in got and got.count((4, 1, 4, True)) == 2 and (5, 1, 5, True) in got
    assert neardup.near_duplicates(docs_of(spark, [])).count() == 0


def test_template_leaks(spark):
    item = "A train leaves Anna's town at 60 kmh and reaches Boston after 3 hours how far did Anna go"
    same = "Intro words. A train leaves Bella's town at 80 kmh and reaches Denver after 5 hours how far did Bella go, they asked."
    mixed = same.replace("after 5 hours", "after 5 days").replace("did Bella", "did Carol")
    rows = [(1, item), (2, same), (3, "nothing of the kind " * 9), (4, None), (5, ""), (None, item)]
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (7, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_changed for r in decontaminate.contaminated(docs_of(spark, rows), bench).collect()}
    assert set(got) == {(1, 7), (2, 7), (None, 7)} and got[1, 7] == 0 and got[2, 7] > 0
    assert decontaminate.contaminated(docs_of(spark, [(3, mixed)]), bench).count() == 0  # after 3 hours, after 5 days; Bella, Carol
    names = same.replace("did Bella", "did Carol")
    assert decontaminate.contaminated(docs_of(spark, [(3, names)]), bench).count() == 0  # Anna's, Anna: Bella's, Carol
    assert {tuple(r) for r in decontaminate.contaminated(docs_of(spark, rows), bench, most_broadcast=0).collect()} == {tuple(r) for r in decontaminate.contaminated(docs_of(spark, rows), bench).collect()}
    assert decontaminate.contaminated(docs_of(spark, []), bench).count() == decontaminate.contaminated(docs_of(spark, rows), bench.limit(0)).count() == 0
    short = spark.createDataFrame([(1, "blue green red")], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.contaminated(docs_of(spark, [(1, "so blue, green red!"), (2, "blue red green")]), short).collect()] == [1]


def test_template_leaks_of_names_at_sentence_starts(spark):
    def found(doc, item):
        docs, bench = docs_of(spark, [(1, doc)]), spark.createDataFrame([(7, item)], "item_id long, text string")
        return decontaminate.contaminated(docs, bench).count()

    item = "Anna has 5 red apples left"
    assert all(found(doc, item) for doc in (item, "Bella has 7 red apples left", "We say Anna has 5 red apples left", "We say Bella has 9 red apples left"))
    assert found("We say Bella has 9 red apples left", "We say Anna has 5 red apples left")
    capital = "What is the capital of France?"
    assert all(found(doc, capital) for doc in (f"Question 3\n{capital}", f"Geography quiz {capital}", "so what is the capital of Spain", capital))
    assert found("How many apples does Tom have", "how many apples does Tom have") and not found("What was the capital, of France?", capital)
    numbers = "4 8 15 16 23 42 99 7 31 12"
    assert found(f"they are 1 2 {numbers} 5", numbers) and not found("3 9 16 17 24 43 98 8 32 13", numbers)


def test_template_leaks_of_a_long_text(spark):
    item = "A train leaves Anna's town at 60 kmh and reaches Boston after 3 hours how far did Anna go"
    rows = [(1, "so much filler of words 7 " * 40_000 + item), (2, "12 " * 60_000)]
    assert [r.doc_id for r in decontaminate.contaminated(docs_of(spark, rows), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()] == [1]


def test_template_leaks_by_place(spark):
    item = "A train leaves Anna's town at 60 kmh and reaches Boston after 3 hours how far did Anna go before Anna slept"
    other = "A train leaves Bella's town at 80 kmh and reaches Denver after 5 hours how far did Bella go before Bella slept"
    third = other.replace("Bella", "Carla").replace("80", "90")
    mixed = other.replace("before Bella", "before Carol")
    added = other.replace("and reaches", "and then surely reaches")
    numbers = "add up 4 8 15 16 23 42 99 7 31 12 and say what the sum of them is"
    bench = spark.createDataFrame([(7, item), (8, numbers)], "item_id long, text string")
    rows = [(1, f"{item}. Then: {other}."), (2, f"{other}. Now: {third}."), (3, numbers), (4, mixed), (5, f"{item}. Now: {added}."), (6, f"{mixed}. Then: {mixed}.")]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs_of(spark, rows), bench).collect()}
    assert set(got) == {(1, 7), (2, 7), (3, 8), (5, 7)}
    assert got[1, 7].n_changed == 0 and got[2, 7].n_changed > 0 and got[3, 8].n_changed == 0 and got[3, 8].n_slots == 10
    broken = [(1, f"{mixed}. Now: {added}.")]
    assert [r.n_changed > 0 for r in decontaminate.contaminated(docs_of(spark, broken), bench).collect()] == [True]


def test_template_query_equals_sql(spark):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    ours, sql = queries.QUERIES["op2_template_decontamination"](spark, SMALL).toPandas(), c.sql(decontaminate.ORACLE).df()
    assert sorted(map(tuple, ours.values.tolist())) == sorted(map(tuple, sql[list(ours.columns)].values.tolist()))


def test_extraction(spark):
    r, model = random.Random(77), html_pages.default_model()
    wrong = n = 0
    for _ in range(60):
        page = html_pages.labelled_page(r)
        labelled = html.Page(page, html_pages.MARKER)
        truth = Counter(t for k, t in labelled.runs if labelled.nodes[k].label)
        got = Counter(model.extract(page.replace(' data-content="1"', "").replace(' data-content="0"', "")).split("\n"))
        wrong, n = wrong + (truth - got).total() + (got - truth).total(), n + len(labelled.runs)
    assert wrong <= 0.02 * n
    rows = [(1, "u", "<article><p>A&amp;B  c\n d</p><p>e</article><footer>x</footer>"), (2, None, None), (3, "u", ""), (None, "u", "<p"), (4, "u", "<div>" * 3000 + "deep")]
    got = {row.page_id: row for row in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    assert got[1].text == "A&B c d\ne" and got[1].n_chars == 9 and got[2].text == "" and len(got) == 5


def test_language_held_out_accuracy_and_odd_rows(spark):
    got = queries.op4_zstd_language_id(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = got.where("held_out").join(truth, "doc_id").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert held >= 0.97
    rows = docs_of(spark, ODD).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(rows, bucket("doc_id", 4) != 2).collect()} == {"und"}
    assert langid.letters("Ab1, é!") == "ab é".encode()


def test_packing_is_a_partition_of_all_ids(spark):
    pieces = packing.pack(docs_of(spark, ODD), capacity=256, docs_per_bin=3).toPandas()
    whole = Counter((i, sum(1 for _ in ids_of().encode(t or "")) + 1) for i, t in ODD)
    ids = [None if x != x else int(x) for x in pieces.doc_id.astype("float")]
    got = Counter()
    for i, n, length in zip(ids, pieces.doc_tokens, pieces.length):
        got[i, n] += length
    assert got == {key: key[1] * k for key, k in whole.items()}  # every document is there, with all its ids
    assert pieces.length.sum() == sum(n * k for (_, n), k in whole.items())
    for _, seq in pieces.sort_values("offset").groupby("sequence_id"):
        assert seq.offset.tolist() == [0, *np.cumsum(seq.length)[:-1]] and seq.length.sum() <= 256
    long = pieces[pieces.doc_id == 5].sort_values("start")
    ids = np.frombuffer(b"".join(long.ids), "<u4")
    assert ids.tolist() == [*ids_of().encode(dict(ODD)[5]), 1]
    assert pieces.groupby("sequence_id").ngroups * 256 - pieces.length.sum() < 256 * 4


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_join_loses_no_pair():
    rnd = random.Random(2)
    for _ in range(2000):
        a = "".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 40)))
        b = list(a)
        for _ in range(rnd.randint(0, 3)):
            i = rnd.randint(0, len(b))
            b[i : i + rnd.randint(0, 1)] = rnd.choice(["", "a", "x"])
        b = "".join(b)
        d, (s, t) = edits(a, b), sorted((a, b), key=len)
        assert all(linededup.within(a, b, k) == (d <= k) for k in (1, 2))
        if a != b and 0 < d <= linededup.allowed(len(s)):
            assert set(linededup.index_keys(s)) & set(linededup.probe_keys(t))
            assert np.bitwise_count((linededup.signature(s) ^ linededup.signature(t)).view(np.uint64)).sum() <= 4 * d


def test_segment_keys_tell_substrings_apart():
    rnd = random.Random(11)
    lines = ["".join(rnd.choice("abc d") for _ in range(rnd.randint(0, 70))) for _ in range(300)] + ["", "x" * 40, "💥" * 12]
    key, own, held = linededup.keys_of(lines)
    want = {}
    for at, line in enumerate(lines):
        n = len(line)
        for short in range(max(1, n - 2), n + 1):
            k = linededup.allowed(short)
            if not k or n - short > k:
                continue
            size, longer = divmod(short, k + 1)
            cuts = [i * size + max(0, i - (k + 1 - longer)) for i in range(k + 1)] + [short]
            for i in range(k + 1):
                s, m = cuts[i], cuts[i + 1] - cuts[i]
                for p in range(max(0, s - i, s + n - short - (k - i)), min(n - m, s + i, s + n - short + k - i) + 1):
                    name = (at, short, i, line[p : p + m])
                    want[name] = want.get(name, False) or (n == short and p == s)
    assert len(key) == len(want) and len(set(key.tolist())) == len({w[1:] for w in want})
    assert Counter(zip(own.tolist(), held.tolist())) == Counter((w[0], h) for w, h in want.items())


def test_line_dedup_keeps_firsts_and_whole_copies(spark):
    board, own = "Subscribe to our daily letter now!", "This one sentence is only found right here, and it is long."
    rows = [(1, f"{board}\n{own}"), (2, f"{board[:-1]}?\n\nSomething else entirely that nobody ever wrote before."), (3, f"{board}\n{own}"), (4, None), (5, ""), (6, "same same line\nother words here\nsame same line\nmore of it")]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(docs_of(spark, rows)).collect()}
    assert got[1] == rows[0][1] and got[2] == "\nSomething else entirely that nobody ever wrote before." and got[3] == rows[2][1]
    assert got[4] is None and got[5] == "" and got[6] == "same same line\nother words here\nmore of it"
    assert linededup.line_report(docs_of(spark, [])).count() == 0


def test_line_dedup_cuts_mixtures_of_other_documents(spark):
    rnd = random.Random(12)
    line = lambda: " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(9))
    one, two, new = [line() for _ in range(6)], [line() for _ in range(6)], line()
    rows = [(1, one), (2, two), (3, one[:4] + two[:4] + [new]), (4, one), (5, one[:4] + two[:4] + [new])]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(docs_of(spark, [(i, "\n".join(x)) for i, x in rows])).collect()}
    assert got[1] == "\n".join(one) and got[2] == "\n".join(two) and got[4] == got[1]
    assert got[3] == new and got[5] == ""


def test_line_report_names_every_first_document(spark):
    short, long, near = "a line that ten others have", "a long passage that another document had first, word for word", "a line that ten others hove"
    rows = [(1, short), (2, long), (3, f"{long}\n{near}\nits own line, found nowhere else"), (3, f"{long}\n{near}\nits own line, found nowhere else"), (4, None)]
    got = [r for r in linededup.line_report(docs_of(spark, rows)).collect() if r.doc_id == 3]
    assert len(got) == 2 and got[0] == got[1]
    assert (got[0].n_shared, got[0].n_repeats, got[0].n_links, got[0].first_doc) == (3, 2, 1, 1)
    assert [tuple(x) for x in got[0].first_docs] == [(1, 1, len(near)), (2, 1, len(long)), (3, 1, 32)]
    part, rest = "thirty characters repeated here", "and then a good deal more text that only this very row has, at its full length"
    twice = linededup.dedup_lines(docs_of(spark, [(1, part), (2, f"{part}\n{rest}"), (2, f"{part}\n{rest}")])).collect()
    assert [r.text for r in twice if r.doc_id == 2] == [rest] * 2


def test_common_keys_change_no_link(spark, monkeypatch):
    rnd = random.Random(8)
    rows = [(i, "all lines begin alike and then differ " + "".join(rnd.choice("ab") for _ in range(4))) for i in range(60)]
    report = lambda: sorted(map(tuple, linededup.line_report(docs_of(spark, rows)).collect()))
    plain = report()
    lines = {t for _, t in rows}
    links = {t: sum(0 < edits(t, u) <= 2 for u in lines) for t in lines}
    assert [r[4] for r in plain] == [links[t] for _, t in rows]
    found = []
    common = linededup._common_keys

    def eager(lines, stages):
        monkeypatch.setattr(linededup, "SAMPLE", 1)
        found.extend(common(lines, stages))
        return found

    monkeypatch.setattr(linededup, "_common_keys", eager)
    assert report() == plain and found


def test_search_recall_and_odd_vectors(spark):
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(1500, 16)).astype(float)
    x[200:300] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [None] + [1.0] * 15), (5004, [1.0] * 3), (None, [1.0] * 16)]
    got = ivfpq.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).toPandas()
    hits = 0
    for q, found in got.groupby("query_id"):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        best = [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:10]
        found = found.sort_values("rank")
        assert found["rank"].tolist() == list(range(1, 11)) and np.allclose(found.score, d[found.vec_id])
        hits += len(set(best) & set(found.vec_id))
    assert hits >= 0.9 * 10 * 15 and got.vec_id.max() < 1500
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in ivfpq.search(few, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 1.0)]


def test_search_recall_by_codes(spark):
    rnd = np.random.default_rng(9)
    x = rnd.normal(size=(2000, 16)).astype(float)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    # lists of about 22 members: 5 of each block are chosen by codes alone
    got = ivfpq.search(rows, F.col("vec_id") % 100 == 0, rerank=5).toPandas()
    hits = 0
    for q, found in got.groupby("query_id"):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        hits += len({i for i in np.argsort(d) if i != q and d[i] <= np.sort(d)[10]} & set(found.vec_id))
    print("recall by codes", hits / 200)
    assert hits >= 0.8 * 10 * 20


def test_classifiers(spark):
    rnd = random.Random(1)
    plain = lambda: " ".join(rnd.choice("river stone walks along the quiet morning light".split()) for _ in range(30))
    rows = [(plain() + (" you grumblehead" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(240)]
    rows += [(plain() + " women grumblehead", 1) for _ in range(30)]
    rows = [(toxicity.with_twin(t), y) for t, y in rows]
    fair, free = toxicity.train(rows, fairness=5.0), toxicity.train(rows, fairness=0.0)
    z = lambda w, t: float(w[0] + w[toxicity.features(t)[0]] @ toxicity.features(t)[1])
    gap = lambda w: abs(z(w, "women walk along") - z(w, "men walk along"))
    assert gap(fair) < gap(free) and z(fair, "a grumblehead") > z(fair, "a river")
    docs = docs_of(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    for f in (toxicity.toxicity, quality.quality):
        got = f(docs, none, F.lit(True)).collect()
        assert len(got) == len(ODD) and {r.score for r in got} == {0.5}
    assert quality.shape("ÀB-cd12!!") == "X-x9!!"


def test_edit_aware_counts_equal_counting_anew(spark):
    rnd, ids = random.Random(6), ids_of()
    for _ in range(300):
        text = "".join(rnd.choice(" \n\tab,.'s12é  t") for _ in range(rnd.randint(0, 120)))
        tree = tokencount.CountTree(text, ids, span=rnd.choice([3, 8, 20]))
        for _ in range(4):
            a = rnd.randint(0, len(text))
            b, new = rnd.randint(a, min(len(text), a + 6)), "".join(rnd.choice(" \nab.'s") for _ in range(rnd.randint(0, 9)))
            text = text[:a] + new + text[b:]
            tree.edit(a, b, new)
            assert tree.text() == text and tree.n_tokens == len(ids.encode(text))
    with pytest.raises(ValueError):
        tokencount.CountTree("abc", ids).edit(2, 9, "")
    assert len(tokencount.counts(docs_of(spark, ODD), tokencount.redactions).collect()) == len(ODD)


def test_pipeline_stages_against_their_parts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    lines = dict(corpus_pipeline.STAGES)
    kept = lines["minhash_near_dedup"](spark, docs, SMALL)
    assert kept.columns == docs.columns
    groups = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, percent=80).collect()}
    assert {r.doc_id for r in kept.collect()} == set(groups.values())
    clean = {r.doc_id for r in lines["benchmark_decontamination"](spark, docs, SMALL).collect()}
    leaks = {r.doc_id for r in decontaminate.contaminated(docs, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
    assert clean == {r.doc_id for r in docs.select("doc_id").collect()} - leaks
    out = corpus_pipeline.run(spark, SMALL).collect()
    assert out and {r.doc_id for r in out} <= clean
