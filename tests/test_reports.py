import pytest
from pyspark.sql import functions as F

from corvina.operators.merge import final_targets
from corvina.plans import reports as r


def rows(df, *cols):
    return sorted((tuple(x) for x in (df.select(*cols) if cols else df).collect()), key=lambda t: tuple((x is None, x) for x in t))


def test_evidence(spark):
    m = spark.createDataFrame([(1, 10, "Dolça", "Serum", "bir Serum"), (2, 10, "", None, ""), (3, 11, "x", "y", "y"), (4, 12, None, "q", "yok")], "id int, post_id int, brand string, name string, evidence string")
    p = spark.createDataFrame([(10, "Dolça\nbir Serum"), (12, "")], "post_id int, caption string").withColumn("id", F.lit(0))
    assert rows(r.evidence_facts(m, p)) == [(1, True, 6, 2, True, True), (2, False, None, None, False, False), (3, None, None, None, False, True), (4, False, None, None, False, False)]
    assert r.evidence_facts(m.limit(0), p).count() == 0


def test_words_and_scores(spark):
    df = spark.createDataFrame([("dolca", "nem kremi 50", "dolca krem nem"), ("", "", None)], "b string, n string, t string")
    w = lambda c: r.words_in(F.col(c), ["ve"], {"kremi": "krem"})
    got = df.select(r.overlap_score(w("b"), w("n"), w("t")).alias("s"), w("n").alias("w")).collect()
    assert [(round(x.s, 3), x.w) for x in got] == [(1.0, ["krem", "nem"]), (0.0, [])]


def test_reuse_takes_the_strongest_source_that_is_all_approved(spark):
    m = spark.createDataFrame([(1, 2, "near", 0.96), (1, 3, "near", 0.97), (4, 1, "near", 0.99), (5, 6, "exact", None), (1, 9, "exact", 1.0)], "post_id_a long, post_id_b long, match_type string, similarity double")
    p = spark.createDataFrame([(1, "instagram"), (2, "tiktok"), (3, "tiktok"), (4, "tiktok"), (5, "tiktok"), (6, "instagram"), (9, "tiktok")], "id long, platform string")
    s = spark.createDataFrame([(2, "approved"), (3, "approved"), (4, "approved"), (4, "approved"), (5, "approved"), (9, "review"), (9, "approved")], "post_id long, status string")
    assert rows(r.reusable(m, p, s)) == [(1, 4, 2), (6, 5, 1)]


def test_only_automatic_matches_of_the_window_go(spark):
    m = spark.createDataFrame([(1, 2, "near"), (1, 3, "manual"), (4, 5, "exact"), (6, 7, None)], "post_id_a long, post_id_b long, match_type string")
    window, new = spark.createDataFrame([(1,), (1,), (6,)], "id long"), spark.createDataFrame([(1, 8, "exact")], "post_id_a long, post_id_b long, match_type string")
    assert rows(r.replace_automatic(m, new, window)) == [(1, 3, "manual"), (1, 8, "exact"), (4, 5, "exact"), (6, 7, None)]


def test_families_join_found_and_conflict_and_are_stable(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (20, 21), (21, 22), (None, 5)], "id_a long, id_b long")
    members = spark.createDataFrame([(3, "old"), (20, "a"), (22, "b"), (99, "c"), (10, None)], "product_id long, family_key string")
    got = r.reconciled_families(pairs, members)
    want = [(1, "old", "joined"), (2, "old", "joined"), (3, "old", "kept"), (10, "reconciled-exact-10", "founded"), (11, "reconciled-exact-10", "founded"), (20, "a", "conflict"), (21, None, "conflict"), (22, "b", "conflict")]
    assert rows(got) == want
    again = r.reconciled_families(pairs, got.select("product_id", "family_key"))
    assert rows(again, "product_id", "family_key") == [w[:2] for w in want]
    assert r.reconciled_families(pairs.limit(0), members).count() == 0


def test_shown_groups(spark):
    p = spark.createDataFrame([
        (1, 10, True, "", "x", "tiktok"), (1, 11, True, "user", "says", "instagram"), (1, 12, False, "user", "says", "tiktok"), (1, 13, None, None, None, "instagram"), (2, 11, True, "mention_only", "x", "instagram"), (2, 10, None, None, " ", "tiktok"), (1, 11, None, None, None, "instagram"),
    ], "product_id long, post_id long, approved boolean, relationship string, summary string, platform string")
    e = spark.createDataFrame([(1, 10, 11), (1, 11, 12), (2, 10, 11)], "product_id long, post_id_a long, post_id_b long")
    assert rows(r.shown_groups(p, e)) == [(1, 10, 11, 3), (1, 13, 13, 1), (2, 10, 10, 2)]


def test_cache_results_and_restore(spark):
    w = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id int, h string")
    assert rows(r.cache_states(w, w.where("id = 1"), w.where("id = 1"), "id", "h")) == [(1, "a", "cached"), (2, "a", "restored"), (3, "b", "pending"), (4, None, "pending")]
    c = spark.createDataFrame([("c1",), ("c2",), ("c1",)], "cid string")
    x = spark.createDataFrame([(1, "c1", "m"), (2, "c1", "n"), (3, "zz", "o")], "at int, cid string, v string")
    out, refused = r.settled_results(c, x, "cid", "at", {"v": F.lit("none")})
    assert rows(out, "cid", "v") == [("c1", "m"), ("c2", "none")] and rows(refused) == [(2, "duplicate"), (3, "unknown")]
    old, new = spark.createDataFrame([(1, "k"), (2, "l"), (3, None)], "id long, ident string"), spark.createDataFrame([(7, "k"), (6, "k"), (8, None)], "id long, ident string")
    m = spark.createDataFrame([(100, 1), (101, 2), (102, 3), (103, None)], "m long, pid long")
    assert rows(r.restored_ids(m, old, new, "pid", "ident"), "m", "pid") == [(100, 6), (101, None), (102, None), (103, None)]


def test_final_targets(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 6), (6, 5), (7, 5), (8, 9), (8, 4), (None, 1), (10, None), (1, 2)] + [(100 + i, 101 + i) for i in range(40)], "o long, n long")
    assert rows(final_targets(e, "o", "n")) == [(1, 4), (2, 4), (3, 4), (8, 4)] + [(100 + i, 140) for i in range(40)]
    assert final_targets(e.limit(0), "o", "n").count() == 0


def test_counts_and_languages(spark):
    df = spark.createDataFrame([("a b\nc ",), ("",), (None,)], "t string")
    assert [tuple(x) for x in df.select(*r.text_counts(F.col("t"))).collect()] == [(6, 2, 3), (0, 0, 0), (0, 0, 0)]
    df = spark.createDataFrame([(" EN ",), ("de",), (None,)], "l string")
    assert [x[0] for x in df.select(r.known_language(F.col("l"))).collect()] == ["en", "tr", "tr"]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Tables in which groups, shared evidence and changed captions occur."""
    d = str(tmp_path_factory.mktemp("small"))

    def t(name, schema, *data):
        spark.createDataFrame(list(data), schema).write.parquet(f"{d}/{name}.parquet")

    ts = "2026-01-01 00:00:00"
    t("influencers", "id long, slug string, display_name string", (1, "me", "Me"), (2, "you", "You"))
    t("products", "id long, brand string, product_name string, category string, updated_at string, normalized_brand string, normalized_product_name string", *[(i, "b", f"p{i}", "c", ts, "b", f"p{i}") for i in (1, 2, 3)], (1, "b", "old", "c", "2025", "b", "old"))
    post = lambda i, who, platform, day, cap: (i, who, platform, f"x{i}", cap, f"u{i}", day, ts)
    t("social_posts", "id long, influencer_id long, platform string, external_post_id string, caption string, original_url string, published_at string, updated_at string", post(10, 1, "tiktok", "20260101", "a"), post(11, 1, "instagram", "2026-01-01", "a"), post(12, 1, "tiktok", "2026-01-02", "b"), post(13, 2, "tiktok", "2026-01-01", "c"), post(99999999999, 1, "tiktok", "2026-01-01", None))
    mention = lambda i, p, prod, ev: (i, p, prod, 0.9, ev, "approved", f"name number {prod}")
    t("social_post_products", "id long, social_post_id long, product_id long, confidence double, evidence_text string, status string, extracted_product_name string", *[mention(100 + k, p, prod, " Ev ") for k, (p, prod) in enumerate([(10, 1), (11, 1), (12, 1), (13, 1), (10, 2), (11, 2), (99999999999, 2)])], mention(200, 13, None, "x"))
    t("social_post_matches", "post_id_a long, post_id_b long, match_type string, similarity double, date_distance_days int", (11, 10, "near", 0.91, 0), (12, 11, "near", 0.99, 1), (11, 99999999999, "exact", 1.0, 0), (13, 11, "exact", 1.0, 0), (10, 10, "exact", 1.0, 0), (10, None, "near", None, None))
    t("raw_post_metadata", "row_id long, id string, description string", (1, "x11", "other"), (2, "x11", "a changed"), (3, "x10", "a"), (4, None, "q"))
    return d


@pytest.mark.parametrize("name, least", [("h4_repost_groups", 4), ("e16_same_evidence", 2), ("d25_changed_sources", 1), ("d17_leaked_evidence", 0), ("f26_audit", 2), ("d21_reuse", 1)])
def test_rare_cases_against_sql(spark, small, name, least):
    import duckdb

    from corvina.queries import QUERIES, SQL

    con = duckdb.connect()
    for n in ("influencers", "products", "social_posts", "social_post_products", "social_post_matches", "raw_post_metadata"):
        con.execute(f"create view {n} as select * from '{small}/{n}.parquet/*.parquet'")
    got, want = QUERIES[name](spark, small), con.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert rows(got, *columns) == sorted(want.fetchall(), key=lambda t: tuple((x is None, x) for x in t)) and got.count() >= least
