import subprocess
import sys
from pathlib import Path

import pytest

from corvina.plans import catalog as c
from corvina.plans.metadata import checked_posts
from corvina.queries_data import month_of

ROOT = Path(__file__).resolve().parents[1]
COLS = "product_id long, brand string, product_name string, category string, influencer_slug string"


@pytest.fixture
def rows(spark):
    reviews = spark.createDataFrame([(1, "Dolça", "Nem Kremi", "skincare", "a"), (1, "Dolça", "Nem Kremi", "skincare", "b"), (2, "çak", "SPF 50 Krem", "makeup", "a")], COLS)
    social = spark.createDataFrame([(1, "Dolça", "Nem Kremi", "skincare", "a"), (3, "Zed", "Serum", "skincare", "c"), (4, None, "Ruj", "makeup", "c")], COLS)
    return reviews, social


def test_roll_up_and_rank(rows):
    got = [(r.product_id, r.review_count, r.social_post_count, r.influencer_count) for r in c.by_rank(c.roll_up(*rows)).collect()]
    assert got[:2] == [(1, 2, 1, 2), (2, 1, 0, 1)] and {g[0] for g in got} == {1, 2, 3, 4}
    assert [r.product_id for r in c.by_rank(c.roll_up(*rows, "c")).collect()] == [4, 3]  # a null brand comes first
    assert c.roll_up(*rows, "nobody").count() == 0


def test_categories_and_browse(rows):
    r = c.roll_up(*rows)
    assert {x.product_id for x in c.in_category(r, "skincare").collect()} == {1, 3}
    assert {x.product_id for x in c.in_category(r, "sunscreen").collect()} == {2}
    assert [x.product_id for x in c.browse(r, "all", 1).collect()] == [1]


def test_search(rows):
    r = c.roll_up(*rows)
    assert [(x.product_id, x.match_score) for x in c.search(r, " DOLCA ").collect()][0] == (1, 100.0)
    assert [(x.product_id, x.match_score) for x in c.search(r, "3").collect()] == [(3, 100.0)]
    assert c.search(r, "  ").count() == c.search(r, "!!").count() == 0
    assert [x.product_id for x in c.search(r, "gunes kremi", limit=1).collect()] == [2]
    assert {x.product_id for x in c.search(r, "nem krmi").collect()} >= {1}
    assert c.search(r, "999999").count() == 0


def test_families(spark, rows):
    ranked = spark.createDataFrame([(i, *x) for i, x in enumerate([(1, "A", "a1", "s", 2, 1, 2), (2, "B", "b", "s", 1, 1, 1), (3, "A", "a2", "s", 5, 0, 4)])], "position int, product_id long, brand string, product_name string, category string, review_count long, social_post_count long, influencer_count long")
    members = spark.createDataFrame([(1, 7), (3, 7)], "product_id long, family_id long")
    families = spark.createDataFrame([(7, 3, "A!", "a")], "id long, representative_product_id long, brand string, product_name string")
    got = [tuple(r) for r in c.with_families(ranked, members, families).orderBy("position").collect()]
    assert got == [(3, "A!", "a", "s", 7, 1, 4, 0), (2, "B", "b", "s", 1, 1, 1, 1)]


def test_resolution(spark):
    catalog = spark.createDataFrame([(1, "dolca", "nem kremi", "dolca|kremi nem"), (2, "dolca", "nem kremi", "x|y"), (3, "zed", "serum", "zed|30ml serum")], "id long, normalized_brand string, normalized_product_name string, identity_key string")
    aliases = spark.createDataFrame([("eski", "ad", 3), ("yok", "ad", 99)], "normalized_brand string, normalized_product_name string, canonical_product_id long")
    typed = spark.createDataFrame([(1, "Dolça", "NEM KREMİ"), (2, "Eski", "Ad"), (3, "zed", "Serum, 30 ml"), (4, "yok", "ad"), (5, None, None)], "ref int, brand string, name string")
    got = {r.ref: (r.product_id, r.how) for r in c.resolve(typed, catalog, aliases).collect()}
    assert got == {1: (1, "name"), 2: (3, "alias"), 3: (3, "identity"), 4: (None, None), 5: (None, None)}


def test_metadata(spark):
    base = dict(row_id=1, id="Ab1", display_id="Ab1", webpage_url="https://www.insta.example/me.x/reel/Ab1/", original_url=None, channel="ME_X", upload_date="20260102", epoch_seconds=None, description=None)
    cases = [({}, None), ({"webpage_url": "http://www.insta.example/p/Ab1"}, "no post link"), ({"webpage_url": "https://evil.insta.example/p/Ab1"}, "no post link"), ({"webpage_url": "https://u@www.insta.example/p/Ab1"}, "no post link"), ({"webpage_url": "https://www.insta.example/me/p/Ab1/x"}, "no post link"),
             ({"webpage_url": None}, "no link"), ({"webpage_url": None, "original_url": "https://insta.example/p/Ab1"}, None), ({"display_id": "Zz"}, "ids disagree"), ({"original_url": "https://www.insta.example/p/Zz"}, "ids disagree"), ({"id": None, "display_id": ""}, None), ({"channel": "other"}, "unknown account"),
             ({"webpage_url": "https://www.insta.example/you/p/Ab1"}, "other account"), ({"upload_date": None}, "no date"), ({"upload_date": "20261301"}, "no date"), ({"upload_date": None, "epoch_seconds": 86400}, None)]
    raw = spark.createDataFrame([tuple((base | change | {"row_id": i}).values()) for i, (change, _) in enumerate(cases)], "row_id int, id string, display_id string, webpage_url string, original_url string, channel string, upload_date string, epoch_seconds long, description string")
    handles = spark.createDataFrame([("me.x", "me_x")], "handle string, slug string")
    got = {r.row_id: r for r in checked_posts(raw, handles, ["www.insta.example", "insta.example"]).collect()}
    assert [got[i].reason for i in range(len(cases))] == [want for _, want in cases]
    assert got[14].published_at == "1970-01-02" and got[0].caption_sha256.startswith("e3b0c442")


def test_months(spark):
    df = spark.createDataFrame([("2026-01-31",), ("20260131",), (" 2026-02-01 ",), ("x",), (None,), ("",)], "d string")
    assert [r[0] for r in df.select(month_of("d")).collect()] == ["2026-01", "2026-01", "2026-02", None, None, None]


def test_p4_on_a_small_fixture(spark, tmp_path):
    d = str(tmp_path)
    t = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    t([(1, None)], "id long, updated_at string", "products")
    t([(5, 1, "2026-01-01"), (6, 5, "2026-01-01"), (7, 8, "2026-02-03"), (8, 7, "2026-02-04"), (9, 99, "2026-03-01"), (9, 99, "2026-03-01"), (None, 99, "2026-04-01"), (10, None, None)], "old_product_id long, canonical_product_id long, created_at string", "product_id_redirects")
    t([(1, 100, 1), (2, 100, 6), (3, 101, 7), (3, 101, 7), (4, 102, 50), (5, 100, None), (6, None, 50)], "id long, social_post_id long, product_id long", "social_post_products")
    t([(100, "2026-05-01", "1"), (101, "20260601", "1"), (101, "20260701", "2"), (102, None, "1")], "id long, published_at string, updated_at string", "social_posts")
    from corvina.queries_data import p4_found

    got = sorted((r.table_name, r.record_id, r.period) for r in p4_found(spark, d).where("record_id is not null").collect() if r.period) + [(r.record_id) for r in p4_found(spark, d).where("period is null").orderBy("record_id").collect()]
    assert got == [("product_id_redirects", 7, "2026-02"), ("product_id_redirects", 8, "2026-02"), ("product_id_redirects", 9, "2026-03"), ("social_post_products", 3, "2026-07"), 4, 6]


def test_core_stands_alone():
    code = "import sys; sys.modules['corvina.llm'] = None\nimport __spark_entry__ as e\nassert 'p4_found' in e.queries() and 'p1_found' not in e.queries() and set(e.oracle_sql()) <= set(e.queries())\nassert not [m for m in sys.modules if m.startswith('corvina.llm') and sys.modules[m]]"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
