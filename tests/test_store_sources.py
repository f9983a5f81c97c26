import json

import pytest
from pyspark.sql import functions as F

from corvina.constraints import Rules, dangling, duplicates, failing
from corvina.sources.files import MATCHES, RAW_POST, canonical_map, json_documents, match_list, post_links, raw_posts, readable, review_csv, transcripts, write_csv
from corvina.store import ConstraintError, Store
from corvina.streaming.clicks import append_batches, run_complete, stream_of, valid_clicks, windowed_counts


def test_store_writes_all_or_nothing(spark, tmp_path):
    rules = {"p": Rules(unique=[["id"]], required=["id"]), "m": Rules(references=[("p_id", "p", "id")], checks={"share": F.col("c").between(0, 1)})}
    s = Store(spark, str(tmp_path / "store"), rules)
    assert s.tables() == [] and s.read("p", "id int").count() == 0
    s.write({"p": spark.createDataFrame([(1,), (2,)], "id int"), "m": spark.createDataFrame([(1, 0.5), (None, None)], "p_id int, c double")})
    before = s.manifest()
    for bad in ({"p": spark.createDataFrame([(1,), (1,)], "id int")}, {"m": spark.createDataFrame([(9, 0.5)], "p_id int, c double")}, {"m": spark.createDataFrame([(1, 1.5)], "p_id int, c double")}, {"p": spark.createDataFrame([(2,)], "id int")}):
        with pytest.raises(ConstraintError):
            s.write(bad)
        assert s.manifest() == before and sorted(r.id for r in s.read("p").collect()) == [1, 2]

    def refuse(tables):
        raise RuntimeError("guard")

    with pytest.raises(RuntimeError):
        s.write({"p": spark.createDataFrame([(1,), (5,)], "id int")}, refuse)
    assert s.manifest() == before
    # a table can be written from its own current version
    s.write({"p": s.read("p").unionByName(spark.createDataFrame([(3,)], "id int"))})
    assert s.read("p").count() == 3 and s.manifest()["p"] == before["p"] + 1
    s.vacuum()
    assert s.read("p").count() == 3
    with pytest.raises(KeyError):
        s.read("nothing")


def test_constraints(spark):
    df = spark.createDataFrame([(1, 5), (1, 6), (None, 7), (None, 8)], "id int, r int")
    assert duplicates(df, ["id"]).count() == 1
    assert dangling(df, "id", spark.createDataFrame([(2,)], "k int"), "k").count() == 2
    assert failing(df, F.col("id") > 1).count() == 2


def test_json_documents(spark, tmp_path):
    d = tmp_path / "raw"
    d.mkdir()
    post = {"id": "1", "webpage_url": "https://x.example/p/1", "upload_date": "20260102", "description": " Hey #you @me "}
    (d / "1.info.json").write_text(json.dumps(post))
    (d / "2.info.json").write_text(json.dumps({"id": "2", "description": " ", "caption": "", "title": "Title", "timestamp": 86400}))
    (d / "3.json").write_text(json.dumps([{"id": "3", "description": "three"}, {"id": "4", "description": "@only"}]))
    (d / "bad.json").write_text("{broken")
    (d / "summary.json").write_text("{}")
    docs, bad = readable(json_documents(spark, str(d), RAW_POST).cache())
    assert [r.file.rsplit("/", 1)[1] for r in bad.collect()] == ["bad.json"]
    got = {r.id: (r.normalized_caption, str(r.day)) for r in raw_posts(docs).collect()}
    assert got == {"1": ("hey you", "2026-01-02"), "2": ("title", "1970-01-02"), "3": ("three", "None")}
    assert json_documents(spark, str(d), RAW_POST, numeric_names=True).select("file").distinct().count() == 3
    (d / "m.json").write_text(json.dumps({"matches": [{"match_type": "exact", "similarity": 1.0, "instagram_id": "a", "tiktok_id": "b"}]}))
    m = match_list(json_documents(spark, str(d / "m.json"), MATCHES)).collect()
    assert len(m) == 1 and m[0].tiktok_id == "b" and m[0].date_distance_days is None


def test_csv_and_text(spark, tmp_path):
    f = tmp_path / "map.csv"
    f.write_text('﻿canonical_sql_id,orjinal_sql_ids,marka\n1,"1; 2;x",A\n3,3;2,"B, ""q"""\n4,4,C\n4,5,C\n')
    df = review_csv(spark, str(f), ["canonical_sql_id", "orjinal_sql_ids", "marka", "absent"])
    assert df.columns[0] == "canonical_sql_id" and df.where("marka = 'B, \"q\"'").count() == 1 and df.where("absent is null").count() == 4
    pairs, faults = canonical_map(df)
    assert sorted((r.old_id, r.target_id) for r in pairs.collect()) == [(1, 1), (2, 1), (2, 3), (3, 3), (4, 4), (5, 4)]
    assert sorted((r.fault, r.id) for r in faults.collect()) == [("old id in two groups", 2), ("target listed twice", 4)]
    write_csv(df, str(tmp_path / "out"))
    assert review_csv(spark, str(tmp_path / "out"), ["marka"]).count() == 4
    t = tmp_path / "t"
    t.mkdir()
    (t / "title_abcdefghijk.txt").write_text("x" * 120)
    (t / "short_lmnopqrstuv.txt").write_text("x")
    assert [r.video_id for r in transcripts(spark, str(t)).collect()] == ["abcdefghijk"]


def test_links(spark):
    df = spark.createDataFrame([("f", ["https://www.insta.example/me/reel/Ab1/", "https://www.insta.example/p/Ab1", "https://evil.example/p/x", "https://www.insta.example/other/p/Zz", "https://www.insta.example/me/stories/1"])], "file string, urls array<string>")
    assert sorted(r.shortcode for r in post_links(df, "urls", ["www.insta.example"], "ME").collect()) == ["Ab1"]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    events = [(1, "2026-01-01 10:00:00", "outbound_click", 5.0), (2, "2026-01-01 23:00:00", "view", 1.0), (3, "2026-01-02 01:00:00", "view", 2.0)]
    spark.createDataFrame(events, "id long, t string, kind string, value double").selectExpr("id", "timestamp(t) as ts", "kind", "value").write.parquet(str(src / "events.parquet"))
    s = lambda: stream_of(spark, str(src), "*.parquet", "id long, ts timestamp, kind string, value double")
    got = run_complete(windowed_counts(s(), "ts", ["kind"], "value", "1 day", "1 hour"), str(tmp_path / "o"), str(tmp_path / "c"))
    assert sorted((str(r.window_start)[:10], r.kind, r.events, r.total) for r in got.collect()) == [("2026-01-01", "outbound_click", 1, 5.0), ("2026-01-01", "view", 1, 1.0), ("2026-01-02", "view", 1, 2.0)]
    for _ in range(2):  # what has been read is not read again
        append_batches(s(), str(tmp_path / "a"), str(tmp_path / "ac"), lambda df: df.where("kind = 'view'"))
    assert spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "a")).count() == 2


def test_clicks(spark):
    products = spark.createDataFrame([(42,), (43,)], "id long")
    links = spark.createDataFrame([(1, 42, "Sephora", "https://a", 0.5), (2, 42, "sephora", "https://b", 0.9), (3, 42, "sephora", "https://c", 0.9)], "id long, product_id long, merchant_slug string, url string, confidence double")
    raw = spark.createDataFrame([("outbound_click", "42", "me", " SEPHORA ", "2026-10-07T12:00:00+03:00"), ("view", "42", "me", "sephora", None), ("outbound_click", "x", "me", "sephora", None), ("outbound_click", "43", "me", "sephora", None), ("outbound_click", "42", " ", "sephora", None), ("outbound_click", "42", "me", "sephora", "bad")], "event_name string, product_id string, influencer_slug string, merchant string, timestamp string")
    got = sorted((r.product_id, r.destination_url, r.clicked_at) for r in valid_clicks(raw, products, links).collect())
    assert [g[:2] for g in got] == [(42, "https://b")] * 2 and "2026-10-07T09:00:00Z" in [g[2] for g in got]
