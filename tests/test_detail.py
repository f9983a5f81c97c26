import json

from pyspark.sql import functions as F

from corvina.plans.detail import advanced_watermark, batches, best_metadata, creator_presence, evidence_at, joined_snippets, learned_domains, numbered, opinion_points, overlay, propagated_links, shown_links, translated_points


def test_overlay(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id int, title string, body string")
    t = spark.createDataFrame([(1, "en", "A", None), (1, "tr", "Ä", "X"), (3, "en", "C", "Y")], "id int, language string, title string, body string")
    assert sorted(tuple(r) for r in overlay(rows, t, "id", "en", ["title", "body"]).select("id", "title", "body").collect()) == [(1, "A", "x"), (2, "b", None)]


def test_points(spark):
    one = json.dumps([{"claim": "Hafif ", "polarity": "POSITIVE", "evidence_text": "e"}, {"claim": "", "polarity": "x"}, {"claim": "Pahalı", "polarity": "odd"}])
    two = json.dumps([{"claim": "hafif", "polarity": "positive"}, {"claim": "Hafif", "polarity": "negative"}])
    df = spark.createDataFrame([(1, 1, one), (1, 2, two), (2, 1, "{bad"), (3, 1, None)], "p int, o int, j string")
    got = sorted(tuple(r) for r in opinion_points(df, "p", "o", "j").collect())
    assert got == [(1, "Hafif", "negative", ""), (1, "Hafif", "positive", "e"), (1, "Pahalı", "neutral", "")]
    pts = spark.createDataFrame([([("a", "positive"), ("", "neutral"), ("b", "negative")], ["A", "B"]), ([("a", "x")], ["A", "B"])], "p array<struct<claim:string,polarity:string>>, c array<string>")
    out = [r[0] for r in pts.select(translated_points(F.col("p"), F.col("c"))).collect()]
    assert [(x.claim, x.polarity) for x in out[0]] == [("A", "positive"), ("", "neutral"), ("B", "negative")] and out[1] is None


def test_cards(spark):
    m = spark.createDataFrame([(1, "a", "A", "tiktok"), (1, "a", "A", "instagram"), (1, "b", "B", "youtube")], "product_id int, influencer_slug string, display_name string, platform string")
    got = {r.influencer_slug: (r.has_youtube, r.has_tiktok, r.has_instagram) for r in creator_presence(m).collect()}
    assert got == {"a": (False, True, True), "b": (True, False, False)}
    links = spark.createDataFrame([(1, "retailer", "s", None, 2), (1, "retailer", "s", "", 1), (1, "official_brand", "o", None, 0), (2, "official_brand", "o", None, 5), (2, "official_brand", "o", None, 4), (3, "other", "x", None, 1)], "product_id int, link_type string, merchant_slug string, variant_label string, position int")
    assert sorted((r.product_id, r.position) for r in shown_links(links).collect()) == [(1, 1), (2, 4)]
    fam = spark.createDataFrame([(7, "s", "u", 0.5, 1, "t"), (7, "s", "u", 0.9, 2, None)], "family_id int, merchant_slug string, url string, confidence double, position int, title string")
    members = spark.createDataFrame([(7, 1), (7, 2)], "family_id int, product_id int")
    assert sorted((r.product_id, r.confidence, r.title) for r in propagated_links(fam, members).collect()) == [(1, 0.9, "t"), (2, 0.9, "t")]
    d = spark.createDataFrame([("b", "y.com", "verified", "official_brand"), ("b", "x.com", "verified", "official_brand"), ("b", "z.com", "review", "official_brand")], "brand string, host string, status string, link_type string")
    assert [(r.brand, r.domains) for r in learned_domains(d, "brand", "host").collect()] == [("b", ["x.com", "y.com"])]


def test_files_and_batches(spark):
    df = spark.createDataFrame([("v", True, "ab", "none", "1", "b.json"), ("v", True, "ab", "available", "0", "c.json"), ("v", True, "ab", "available", "0", "a.json"), ("", True, "x", None, None, "d.json"), ("w", None, None, None, None, "e.json")], "video_id string, description_retrieved boolean, description string, transcript_status string, metadata_retrieved_at string, file string")
    assert sorted((r.video_id, r.file) for r in best_metadata(df).collect()) == [("v", "a.json"), ("w", "e.json")]
    n = numbered(df.where("video_id = 'v'"), ["video_id"], "file", "label")
    assert sorted((r.file, r.label) for r in n.collect()) == [("a.json", "P001"), ("b.json", "P002"), ("c.json", "P003")]
    many = batches(spark.range(1000), ["id"], 100)
    assert many.select("batch").distinct().count() == 10 and many.count() == 1000
    assert batches(spark.range(0), ["id"], 5).count() == 0


def test_texts(spark):
    df = spark.createDataFrame([("a\nbç x\nc", "x"), ("a", " "), ("a", None), ("a", "q")], "t string, p string")
    got = [tuple(r[0]) for r in df.select(evidence_at(F.col("t"), F.col("p"))).collect()]
    assert got == [(True, 5, 2), (False, None, None), (False, None, None), (False, None, None)]
    parts = ["the quick brown fox jumps", "the quick brown fox jumps", "the quick brown fox jumps over", "", "over", "short", "short one", None, "end ."]
    out = spark.createDataFrame([(parts,), ([],)], "p array<string>").select(joined_snippets(F.col("p"))).collect()
    assert out[0][0] == "the quick brown fox jumps over short short one end." and out[1][0] == ""


def test_watermark(spark):
    state = spark.createDataFrame([("a", "2026-01-01"), ("b", "2026-01-01")], "influencer_slug string, watermark string")
    results = spark.createDataFrame([("a", "x", True, "2026-02-01"), ("a", "y", True, "2026-02-01"), ("b", "x", False, "2026-02-01"), ("c", "x", True, "2026-02-01")], "influencer_slug string, source string, ok boolean, run_end string")
    assert {r.influencer_slug: r.watermark for r in advanced_watermark(state, results).collect()} == {"a": "2026-02-01", "b": "2026-01-01", "c": "2026-02-01"}
