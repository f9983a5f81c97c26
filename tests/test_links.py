import json

from pyspark.sql import functions as F

from corvina.functions.nested import availability, object_or_empty, richest, srcset, stock_status
from corvina.plans import links as p
from corvina.plans import runs
from corvina.plans.metadata import checked_videos
from corvina.sources.files import creators_with_sources, source_folders, wanted
from corvina.store import Store


def rows(df, *cols):
    return sorted((tuple(x) for x in (df.select(*cols) if cols else df).collect()), key=lambda t: tuple((x is None, x) for x in t))


def test_link_records(spark):
    one = {"brand": "A", "product_name": "x", "merchant_slug": "generic_retailer", "url": "https://www.shop-one.example/p/1?q=2", "match_confidence": 0.9}
    docs = [("a", json.dumps({"links": [one, {**one, "domain": "market.example"}, {**one, "url": "no link"}, {**one, "merchant_slug": "m", "domain": "sub.market.example", "merchant_name": "M"}, None]})), ("b", json.dumps([one])), ("c", "{bad"), ("d", None), ("e", "{}")]
    got = p.link_records(spark.createDataFrame(docs, "file string, document string"), blocked=["market.example"])
    assert rows(got, "file", "position", "domain", "merchant_name") == [("a", 0, "shop-one.example", "Shop One"), ("a", 3, "sub.market.example", "M"), ("b", 0, "shop-one.example", "Shop One")]
    keys = got.select(p.link_identity(F.col("brand"), F.col("product_name"), F.col("merchant_slug"), F.col("url")).alias("k"), p.link_identity(F.lit(" "), F.col("product_name"), F.col("merchant_slug"), F.col("url")).alias("n"))
    assert rows(keys)[0] == ("a::x\x1fgeneric_retailer\x1fhttps://shop-one.example/p/1", None)


def test_merges(spark):
    s = "product_id long, merchant_slug string, url string, verification_status string, stock_status string, stock_checked_at string, source_title string"
    old = spark.createDataFrame([(1, "m", "u", "verified", "in_stock", "t1", "old"), (2, "m", "u", "review", "unknown", None, "old")], s)
    new = spark.createDataFrame([(1, "m", "u", "review", "odd", None, "new"), (2, "m", "u", "verified", "out_of_stock", "t2", None), (3, "m", "u", "review", None, None, "new")], s)
    assert rows(p.merged_links(old, new)) == [(1, "m", "u", "verified", "in_stock", "t1", "new"), (2, "m", "u", "verified", "out_of_stock", "t2", None), (3, "m", "u", "review", "unknown", None, "new")]
    i = "product_id long, image_url string, verification_status string, source_type string"
    img = p.merged_images(spark.createDataFrame([(1, "a", "verified", "manual")], i), spark.createDataFrame([(1, "a", "rejected", "json_ld"), (1, "b", "review", "srcset")], i))
    assert rows(img) == [(1, "a", "verified", "json_ld"), (1, "b", "review", "manual")]


def test_what_is_left_to_look_for(spark):
    links = spark.createDataFrame([(1, "verified", "u1", "B", "Krem 50 ml"), (1, "verified", "u0", "B", "Krem 30 ml"), (2, "review", "u2", "B", "q"), (3, "verified", "u3", "C", "q")], "product_id long, verification_status string, url string, brand string, product_name string")
    images = spark.createDataFrame([(1, "verified"), (3, "review")], "product_id long, verification_status string")
    assert rows(p.without_image(links, images)) == [(3,)] and rows(p.without_image(links, images, again=True)) == [(1,), (3,)]
    assert rows(p.family_links(links)) == [("b::cream", ["u0", "u1"]), ("c::q", ["u3"])]
    products = spark.createDataFrame([(1, "B", "n"), (3, "C", "n")], "id long, brand string, product_name string")
    assert rows(p.of_products(images, products)) == [(1, "verified", "B", "n")]
    found = spark.createDataFrame([(1, "https://a.example/x?q", True, 0.8), (1, "https://a.example/x", True, 0.9), (1, "https://b.example/", True, 0.9), (1, "https://c.example/", False, 0.99), (1, "https://d.example/", True, 0.71), (1, "https://e.example/k", True, 0.95), (1, "none", True, 1.0)], "pid long, url string, exact boolean, confidence double")
    known = spark.createDataFrame([(1, "http://www.e.example/k/")], "pid long, url string")
    assert rows(p.new_pages(found, known, ["pid"], 2), "url", "confidence") == [("https://a.example/x", 0.9), ("https://b.example", 0.9)]
    two = spark.createDataFrame([(1, 2, 0, "https://a.example/x", "late"), (1, 1, 5, "https://a.example/x/", "first"), (1, 2, 1, "https://b.example", "other")], "pid long, query_no int, position int, url string, title string")
    assert rows(p.searched(two, ["pid"]), "url", "title") == [("https://a.example/x", "first"), ("https://b.example", "other")]
    img = spark.createDataFrame([(1, "https://a/1", 2.0), (1, "https://a/1", 3.0), (1, "ftp://a/2", 9.0), (1, "https://a/0", 3.0), (1, "https://a/3", 1.0)], "pid long, url string, score double")
    assert [(r.url, r.score) for r in p.best_images(img, ["pid"], 2).orderBy("url").collect()] == [("https://a/0", 3.0), ("https://a/1", 3.0)]


def test_domains_and_creators(spark):
    df = spark.createDataFrame([("La Roche", "laroche-shop.example", []), ("X", "shop.brand.example", ["brand.example"]), ("Q", "notbrand.test", ["brand.test"]), (None, "a.example", None)], "b string, h string, c array<string>")
    assert [r[0] for r in df.select(p.plausible_official(F.col("b"), F.col("h"), F.col("c"))).collect()] == [True, True, False, False]
    at = spark.createDataFrame([(1, "me", "Old"), (2, "me", "New"), (3, "you", "You")], "product_id long, influencer_slug string, display_name string")
    assert rows(p.creators_of_families(at, spark.createDataFrame([(1, 7), (2, 7)], "product_id long, family_id long"))) == [(7, "me", "New")]


def test_pages(spark):
    df = spark.createDataFrame([("https://schema.org/InStock",), ("Sold-Out",), ("limited_availability",), ("soon",), (None,)], "a string")
    assert [r[0] for r in df.select(availability(F.col("a"))).collect()] == ["in_stock", "out_of_stock", "limited_stock", "unknown", "unknown"]
    ld = [json.dumps(x) for x in ({"@type": "Thing", "offers": {"availability": "InStock"}}, {"@type": "Product", "offers": [{"availability": "later"}, {"availability": "OutOfStock"}]}, {"@type": "Product", "offers": {"availability": "InStock"}})]
    df = spark.createDataFrame([(ld, []), ([], ["x", "instock"]), (ld[:1], None)], "ld array<string>, meta array<string>")
    assert [r[0] for r in df.select(stock_status(F.col("ld"), F.col("meta"))).collect()] == ["out_of_stock", "in_stock", "unknown"]
    df = spark.createDataFrame([("a.jpg 500w, b.jpg 2x , c.jpg,, d e.jpg 9999w, f.jpg oddx",), (None,)], "s string")
    assert [[(x.url, x.hint) for x in r[0]] for r in df.select(srcset(F.col("s"))).collect()] == [[("a.jpg", 2.0), ("b.jpg", 4.0), ("c.jpg", 0.0), ("d e.jpg", 8.0), ("f.jpg", 0.0)], []]
    df = spark.createDataFrame([(json.dumps({"x": [{"id": 1}, {"id": 2, "t": "a", "u": ""}, {"id": 3, "t": "b"}]}),), ("{bad",), (None,), ("[]",)], "j string")
    assert [r[0] for r in df.select(richest("id", ["t", "u"])(F.col("j"))).collect()] == ['{"id": 2, "t": "a", "u": ""}', None, None, None]
    assert [r[0] for r in df.select(object_or_empty(F.lit('{"a": 1, "b": "c"}'))).limit(1).collect()] == [{"a": "1", "b": "c"}]
    assert [r[0] for r in df.select(object_or_empty(F.lit("[1]"))).limit(1).collect()] == [{}]


def test_videos(spark):
    u = "https://www.tok.example/@Me/video/12"
    raw = [(1, "12", u, None, "20260102", None), (2, "x", u, None, "20260102", ""), (3, "13", u, None, "20260102", ""), (4, "12", u.replace("@Me", "@you"), None, "20260102", ""), (5, "12", "http" + u[5:], None, "20260102", ""), (6, "12", None, u + "/", "20261302", ""), (7, "12", u, None, None, "")]
    got = checked_videos(spark.createDataFrame(raw, "row_id int, id string, webpage_url string, original_url string, upload_date string, description string"), spark.createDataFrame([("me", "slug")], "handle string, slug string"), ["www.tok.example", "tok.example"])
    assert rows(got, "row_id", "reason") == [(1, None), (2, "no id"), (3, "link does not fit"), (4, "link does not fit"), (5, "link does not fit"), (6, "no date"), (7, "no date")]
    assert rows(got.where("row_id = 1"), "original_url", "published_at", "caption") == [("https://www.tok.example/@Me/video/12", "2026-01-02", "")]


def test_folders_documents_and_runs(spark, tmp_path):
    for x in ("me/long", "me/shorts", "me/all", "you/all", "they/other"):
        (tmp_path / x).mkdir(parents=True)
    root, choice = str(tmp_path), {"split": ["long", "shorts", "gone"], "default": "all"}
    names = lambda found: [x.rsplit("/", 1)[1] for x in found]
    assert names(source_folders(spark, root, "me", **choice)) == ["long", "shorts"] and names(source_folders(spark, root, "you", **choice)) == ["all"]
    assert names(source_folders(spark, root, "me", ["all", "all", "gone"], **choice)) == ["all"] and source_folders(spark, root, "me", ["gone"], **choice) == [] == source_folders(spark, root, "nobody", **choice)
    assert creators_with_sources(spark, root, **choice) == ["me", "you"] and creators_with_sources(spark, root, ["z", "z"], **choice) == ["z"]
    docs = spark.createDataFrame([("a", "f2"), ("b", "f1"), ("a", "f1"), (None, "f0")], "vid string, file string")
    assert rows(wanted(docs, "vid", allowed=spark.createDataFrame([("a",), (None,)], "vid string"))) == [("a", "f1"), ("a", "f2")] and rows(wanted(docs, "vid", only="a", limit=1)) == [("a", "f1")]
    store = Store(spark, f"{root}/store")
    runs.begin(store, "r1")
    runs.end(store, "r1", {"rows": 3})
    runs.begin(store, "r2")
    runs.end(store, "r2", error="broken")
    assert rows(store.read("runs"), "run_id", "status", "error") == [("r1", "done", None), ("r2", "failed", "broken")] and runs.latest(store).first().run_id == "r2"
