"""Readers and writers on small files."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tallyloom.sinks import artefacts
from tallyloom.sources import comments, packages


def put(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False), encoding="utf-8")
    return str(path)


def one(cid=None, text="hello", **more):
    return {"cid": cid, "comment": text, **more}


def test_comment_files(spark, tmp_path):
    url = "https://v.example/video/77"
    same = {"nickname": "n", "create_time": "5", "digg_count": 3}
    first = put(tmp_path / "a.json", {"video_url": url, "comments": [one("1", "Hi  there", uid="u", **same), one("1", "other"), one(None, "Hi there", **same), one(None, "Hi there", nickname="x", create_time="5"), {"comment": 5}, "odd", one("2", "💥", level="reply", digg_count=-1)]})
    broken, other = put(tmp_path / "b.json", '{"comments": ['), put(tmp_path / "c.json", [1, 2])
    put(tmp_path / "sample_d.json", {"comments": [one("9")]})
    paths, skipped = comments.scan(spark, str(tmp_path))
    assert [p.rpartition("/")[2] for p in paths] == ["a.json", "b.json", "c.json"] and [r.reason for r in skipped.collect()] == ["DEFAULT_SAMPLE_FIXTURE_EXCLUSION"]
    got = comments.read(spark, [first, first, broken, other])
    assert {r.path[-6:]: (r.status, r.raw_rows) for r in got.files.collect()} == {"a.json": ("INCLUDED", 7), "b.json": ("ERROR", None), "c.json": ("EXCLUDED", None)}
    assert got.invalid.count() == 2 and {r.video for r in got.observations.collect()} == {"77"}
    records = comments.comments(got.observations)
    rows = {r.comment_key[:12]: r for r in records.collect()}
    assert (rows["douyin:1"].n_sources, rows["douyin:1"].n_conflicts, rows["douyin:1"].user_id, rows["douyin:1"].likes) == (3, 1, "u", 3.0)
    assert rows["douyin:2"].valid is False and rows["douyin:2"].likes is None
    counters = comments.quality(got, records)
    assert len(counters) == 12 and counters["raw_rows"] == counters["invalid_rows"] + counters["identity_records"] + counters["merged_observations"] == 7
    assert (counters["idless_matched"], counters["low_identity_records"], counters["noise_records"], counters["reply_rows"]) == (1, 1, 1, 1)
    assert comments.read(spark, []).observations.count() == 0


def test_contexts_and_units(spark, tmp_path):
    records = spark.createDataFrame([("1", "v", "ask", None, None), ("2", "v", "answer", "1", "1"), ("3", "w", "far", "1", None)], "cid string, video string, text string, parent string, root string").withColumn("comment_key", F.col("cid"))
    good = spark.createDataFrame([("v", "so what to buy?", "what to buy", "u", "t", True)], "video string, video_text string, video_question string, source_url string, retrieved_at string, solicitation_verified boolean")
    got = {r.cid: r.context for r in comments.with_context(records, good).collect()}
    assert got["2"].parent_comment == "ask" and got["2"].solicitation_verified and got["3"].parent_comment == "" and not got["3"].solicitation_verified
    with pytest.raises(Exception, match="verified question"):
        comments.with_context(records, good.withColumn("video_question", F.lit("not said"))).collect()
    data = put(tmp_path / "s.json", {"stock_code": "1.SH", "stock_name": "n", "comments": [{"cid": 1, "platform": "p", "text": "t"}, {"cid": 2, "platform": "p", "comment": "c"}]})
    rows = comments.stock(spark, data)
    assert [(r.cid, r.text, r.stock_code) for r in rows.orderBy("row").collect()] == [("1", "t", "1.SH"), ("2", "c", "1.SH")]
    units = spark.createDataFrame([("1", "p", "t", [("u1", "1.SH", "PRIMARY_SUBJECT", None, None, ("t", 0, 1))])], f"cid string, platform string, text string, atomic_units array<{comments.UNIT}>")
    assert {r.cid: len(r.atomic_units) for r in comments.with_units(rows, units).collect()} == {"1": 1, "2": 0}


def test_package_fails_closed(spark, tmp_path):
    lines = "".join(json.dumps({"record_id": f"r{i}", "platform": "p", "content": {"text": "x", "published_at": None}, "create_time": 5, "pit": {"available_at": "2024-01-01T00:00:00Z"}, "securities": []}) + "\n" for i in range(3))

    def folder(name, body=lines, **changed):
        where = tmp_path / name
        where.mkdir()
        (where / "c.jsonl").write_text(body)
        put(where / "manifest.json", {"contract_name": "equity-social-corpus", "contract_version": "1.0.0", "producer": "t", "target_file": "c.jsonl", "sha256": hashlib.sha256(body.encode()).hexdigest(), "record_count": 3, **changed})
        return str(where)

    manifest, records = packages.package(spark, folder("good"))
    assert manifest["producer"] == "t" and records.count() == 3
    for name, changed in {"contract": {"contract_version": "2"}, "target": {"target_file": "../c.jsonl"}, "hash": {"sha256": "0"}, "count": {"record_count": 4}}.items():
        with pytest.raises(ValueError):
            packages.package(spark, folder(name, **changed))
    with pytest.raises(ValueError, match="share an id"):
        packages.package(spark, folder("twice", lines.replace("r1", "r0")))
    social = packages.social(records)
    row = social.withColumn("state", packages.as_of_state()).first()
    # the event's key is present with null: neither create_time nor availability stands in for it
    assert row.event is None and row.event_state == "UNKNOWN" and row.state == "PASS" and row.author is None
    checks = {(r.kind, r.value): r.n for r in packages.package_check(social).collect()}
    assert checks["maturity", "CORPUS_PIT_VALIDATED"] == 3 and checks["publication", "UNKNOWN"] == 3


def test_social_records(spark):
    rows = [{"source": {"platform": "p"}, "content": {"author_id_hash": "a", "published_at": "2024-01-02T00:00:00Z"}, "available_at": "2024-01-01T00:00:00Z", "security_links": [{"relation": "R"}]}, {"create_time": "bad", "user_id": 7, "stable_author_key": "k", "observation": {"observed_at": "2024-01-01T00:00:00Z", "like_count": 4}}]
    got = packages.social(spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")).withColumn("state", packages.as_of_state()).withColumn("seen", packages.seen_likes(F.lit(1704067200 * 10**6))).collect()
    assert (got[0].author, got[0].relation, got[0].state) == ("p:UNSPECIFIED:a", "R", "FAIL_MISSING_OR_INVALID_TIME")
    assert (got[1].author, got[1].event_state, got[1].relation, got[1].likes, got[1].seen) == ("k", "INVALID", "UNKNOWN", 4.0, 4.0)


def test_catalogue_listing_and_settings(spark, tmp_path):
    good = {"id": "a", "name": "A", "category": "STOCK", "aliases": [], "source": "s", "source_date": "d"}
    path = put(tmp_path / "cat.json", {"entities": [good]})
    assert packages.catalogue(spark, path).first().layer == "CONCEPT"
    with pytest.raises(Exception, match="provenance"):
        packages.catalogue(spark, put(tmp_path / "bad.json", {"entities": [{**good, "source": ""}]})).collect()
    js = put(tmp_path / "l.js", '_t.push({val:"600001",val2:"Alpha"});_t.push({val:"510050",val2:"Beta ETF"});_t.push({val:"000001",val2:"Gamma"});')
    assert [tuple(r) for r in packages.listing(spark, js).orderBy("code").collect()] == [("510050", "Beta ETF", "ETF"), ("600001", "Alpha", "STOCK")]
    assert packages.environment(["# x", "T_MODEL = 'm'", "OTHER=1", "T_API_KEY=k"], {"T_API_KEY": "own"}, "T_") == {"T_MODEL": "m", "T_API_KEY": "own"}
    assert packages.config({})["max_attempts"] == 3
    for bad in ({"concurrency": 0}, {"max_calls": 1.5}, {"max_tokens": -1}, {"analysis_cutoff": "2024-01-01T00:00:00"}):
        with pytest.raises(ValueError):
            packages.config(bad)


def test_artefacts(spark, tmp_path):
    df = spark.createDataFrame([(1, "=x", ["a"], None), (2, "ok", None, 1.5)], "id int, t string, l array<string>, x double")
    artefacts.put_csv(df, str(tmp_path / "csv"))
    text = "".join(sorted((p.read_text(encoding="utf-8") for p in (tmp_path / "csv").glob("part*")), reverse=True))
    assert text.startswith("﻿") or text.startswith('"﻿') and "'=x" in text
    assert '"[""a""]"' in text and '"1.5"' in text
    merged = artefacts.merged_rows(df.select("id"), df.select("t", "id"))
    assert merged.columns == ["id", "t"] and merged.count() == 4
    run = str(tmp_path / "run")
    artefacts.put_run(spark, run, {"rows": df.select("id")}, {"sheet": df}, {"schema_version": "3.0"})
    assert artefacts.reopen(spark, run, "3.0")["rows"].count() == 2
    with pytest.raises(FileExistsError):
        artefacts.put_run(spark, run, {}, {}, {})
    with pytest.raises(ValueError):
        artefacts.reopen(spark, run, "2.0")
    name = str(tmp_path / "m.json")
    artefacts.guard_manifest(spark, name, {"a": 1})
    artefacts.guard_manifest(spark, name, {"a": 1})
    with pytest.raises(ValueError):
        artefacts.guard_manifest(spark, name, {"a": 2})
    artefacts.put_lines(spark.createDataFrame([("COMPLETE",)], "annotation_status string"), str(tmp_path / "gold"))
    with pytest.raises(FileExistsError):
        artefacts.guard_annotations(spark, str(tmp_path / "gold"))
    page = artefacts.spliced("<h1>x</h1>rest", "one")
    assert artefacts.spliced(artefacts.spliced(page, "two"), "two").count("two") == 1 and "one" not in artefacts.spliced(page, "two")
    assert artefacts.link("javascript:1", "<b>") == "&lt;b&gt;" and "href" in artefacts.link("https://x", "y") and "<" not in artefacts.embedded({"a": "</script>"})


def test_run_status_and_allow_list(spark):
    files = spark.createDataFrame([("INCLUDED", True, True, 5)], "status string, window_complete boolean, comparable boolean, total_reported long")
    rows = spark.createDataFrame([("SUCCESS", True, "a"), ("SKIPPED", False, "b")], "status string, valid boolean, text string")
    status = lambda r, invalid=0, full=True: artefacts.run_status(files, r, invalid, full, "DISABLED").first()[0]
    assert status(rows) == "COMPLETE" and status(rows, 1) == status(rows, full=False) == status(rows.limit(0)) == status(rows.withColumn("valid", F.lit(True))) == "PARTIAL"
    assert tuple(artefacts.run_coverage(files).first()) == (True, 5) and tuple(artefacts.run_coverage(files.limit(0)).first()) == (False, 0)
    secret = spark.createDataFrame([("M1", 3, "u1")], "method string, n long, user_id string")
    assert artefacts.public("methods", secret).columns == ["method", "n"]
    assert {r.user_id for r in artefacts.renumbered(secret, "user_id", "user").collect()} == {"user_1"}
    assert {r.figure: (r.old, r.new) for r in artefacts.compared_runs(rows, rows.limit(1)).collect()}["records"] == (2, 1)
