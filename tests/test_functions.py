import hashlib
import json
from difflib import SequenceMatcher

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corvina.functions import dates, links
from corvina.functions.keys import display_key, family_key, feature_words, identity_key, initials, numeric_words, protected_words
from corvina.functions.nested import canonical_json_sha256, nodes, page_parts, richness, text_list, values_of
from corvina.functions.normalize import CHAINS, normalize, normalized, position_map
from corvina.functions.similarity import coverage, match_score, ratio, ratio_can_reach, search_aliases, sequence_ratio, sequence_ratio_from, token_set_ratio


@pytest.mark.parametrize("chain, text, want", [
    ("identity", "  Şık  GÜNEŞ ışığı, İyi! ", "sik gunes isigi, iyi!"), ("identity", None, ""), ("identity", "ﬁ Ｌ", "fi l"), ("search", "Dr.Jart+ %5 & ıÖ", "dr jart+ %5 io"), ("link", "B5+ %1", "b5 1"),
    ("plain", "Œuvre Iı", "oeuvre ii"), ("display", "Æ-x", "ae x"), ("image", "ışık", "s k"), ("audit", "№5 %+", "no5 %+"), ("caption", "Replying to @ali #Bak https://x.y/z GÜZEL!", "bak güzel"), ("caption", None, ""),
    ("evidence_tokens", "Çok-iyi", "cok iyi"), ("dedupe", " - Ruj: ", "ruj"), ("evidence", "Ａ  B", "a b"), ("typographic", "“A” – ’b’", "\"a\" - 'b'"), ("keyword", "A &amp; B", "a & b"), ("transcript", "a<b>c</b> [Music] ♪ d", "a c d"), ("transcript", "x [ SES ] y (müzik) [gülme]\nz", "x y (müzik) [gülme] z"),
    ("brand", " @@Marka ", "Marka"), ("filename", 'a/b: "c"?', "a b c"), ("filename", "..", "untitled_video"), ("filename", "x" * 200 + ".", "x" * 140),
])
def test_chains(chain, text, want):
    assert normalized(text, chain) == want


def test_column_equals_plain_call(spark):
    texts = ["Şık  GÜNEŞ", None, "", "ﬁ Ｌ İı", "Şık  GÜNEŞ", "a\n b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for chain in CHAINS:
        got = [r[0] for r in df.orderBy("i").select(normalize("t", chain)).collect()]
        assert got == [normalized(t, chain) for t in texts], chain


def test_position_map():
    text, where = position_map("İＡﬁ")
    assert text == "iafi" and where == [0, 1, 2, 2]


@pytest.mark.parametrize("a, b, same", [
    (("L'Oréal", "Lift + Sculpt 15 ml"), ("l oreal", "sculpt and lift 15ml"), True), (("X", "Ton 003"), ("X", "ton 03"), True), (("X", "Ton 02M"), ("X", "Ton 03M"), False), (("X", "B5"), ("X", "B5+"), False),
    (("A & B", "SPF50+ Krem™"), ("A and B", "krem spf50 +"), True), (("X", "Lift+Sculpt"), ("X", "lift & sculpt"), True), ((None, None), ("", ""), True),
])
def test_identity_keys(spark, a, b, same):
    rows = spark.createDataFrame([a, b], "b string, n string").select(identity_key(F.col("b"), F.col("n"))).collect()
    assert (rows[0][0] == rows[1][0]) is same


def test_product_words(spark):
    r = spark.createDataFrame([("@Marka", "Fondöten No 12 SPF 30 Serum 50 ml the")], "b string, n string").select(family_key(F.col("b"), F.col("n")).alias("f"), feature_words(F.col("n")).alias("w")).select("f", "w", numeric_words(F.col("w")).alias("n"), protected_words(F.col("w")).alias("p")).first()
    assert r.f == "marka::foundation spf 30 serum the" and r.w == ["foundation", "no", "12", "spf", "30", "serum", "50", "ml"] and r.n == ["12", "30", "50"] and r.p == ["foundation", "serum", "spf"]


def test_ratio(spark):
    pairs = [("abcd", "bcde"), ("", "a"), (None, "a"), ("same", "same"), ("x" * 250, "x" * 249 + "y")]
    got = [r[0] for r in spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").orderBy("i").select(sequence_ratio("a", "b")).collect()]
    assert got == [0.75, 0, 0, 1, SequenceMatcher(None, *pairs[4]).ratio()]
    reach = spark.createDataFrame([("abcd", "ab"), ("abcd", "abc")], "a string, b string").select(ratio_can_reach(F.col("a"), F.col("b"), 0.86).alias("r"), token_set_ratio(F.col("a"), F.col("b"))).collect()
    assert [r.r for r in reach] == [False, False]
    assert ratio("ab", "ab") == 1


def test_ratio_with_a_bound(spark):
    import random

    rnd = random.Random(3)
    pairs = [(None, "a"), ("", ""), ("same", "same"), ("a" * 300, "a" * 299 + "b")]
    for _ in range(400):
        a = "".join(rnd.choices("abcdeşğ ", k=rnd.randint(0, 60)))
        b = "".join(c for c in a if rnd.random() > 0.15) + "".join(rnd.choices("abz", k=rnd.randint(0, 6)))
        pairs.append((a, b))
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = {r.i: r.r for r in df.select("i", sequence_ratio_from(F.col("a"), F.col("b"), 0.86).alias("r")).collect()}
    for i, (a, b) in enumerate(pairs):
        exact = ratio(a or "", b or "")
        assert got[i] == exact if exact >= 0.86 else got[i] is None
    assert 0 < sum(x is not None for x in got.values()) < len(pairs)


def test_coverage_and_score(spark):
    assert coverage(["gunes", "kremi"], pd.Series(["gunes krem", "", "krem"])) == [1.0, 0.0, 0.5] and coverage(["zz"], pd.Series(["gunes"])) == [0.0]
    assert sum(coverage([], pd.Series(["a"])) or [0]) == 0
    df = spark.createDataFrame([(1, "dolca", "nem kremi", "dolca nem kremi"), (2, "x", "y", "x y dolca"), (3, "kozen", "serum", "kozen serum"), (4, "", "", "")], "i int, b string, n string, c string")
    s = {r.i: r.s for r in df.select("i", match_score("dolca", F.col("b"), F.col("n"), F.col("c")).alias("s")).collect()}
    assert s[1] == 100 and s[2] == 97 and s[3] < 48 and s[4] == 0
    assert match_score("", F.col("b"), F.col("n"), F.col("c")) is not None
    a = spark.createDataFrame([("x spf 50 serum", "skincare"), ("x", None)], "t string, c string").select(search_aliases(F.col("t"), F.col("c"))).collect()
    assert a[0][0] == "gunes kremi gunes koruyucu gunes krem sun crema sun creme serum cilt bakimi bakim" and a[1][0] == ""


def test_links_and_dates(spark):
    df = spark.createDataFrame([("HTTPS://www.Shop.example:80/a/b/?q=1#x", "20260102", "2026-01-03", 86400.0), (None, "", "bad", None), ("not a link", "20261399", None, 0.0)], "u string, a string, b string, e double")
    r = df.select(links.domain(F.col("u")).alias("d"), links.canonical_url(F.col("u")).alias("c"), dates.dashed(F.col("a")).alias("x"), dates.to_day(F.col("a"), F.col("b"), F.col("e")).cast("string").alias("day"), dates.in_window(F.col("b"), "2026-01-01", "2026-01-31").alias("w"), dates.shown(F.col("b")).alias("s"), links.in_domain(F.lit("a.b.c"), F.lit("b.c")).alias("i"), links.merchant_name(F.lit("my-shop.com")).alias("m")).collect()
    assert (r[0].d, r[0].c, r[0].x, r[0].day, r[0].w, r[0].s, r[0].i, r[0].m) == ("shop.example", "https://shop.example/a/b", "2026-01-02", "2026-01-02", True, "03.01.2026", True, "My Shop")
    assert (r[1].d, r[1].x, r[1].day, r[1].w, r[1].s) == (None, None, None, False, "bad")
    assert r[2].day == "1970-01-01" and r[2].w is True
    t = spark.createDataFrame([("2026-10-07T12:00:00+03:00",), ("2026-10-07T09:00:00Z",), ("2026-10-07 09:00:00",), ("x",)], "t string").select(dates.utc_stamp(F.col("t"), F.lit("2020-01-01").cast("timestamp"))).collect()
    assert [x[0] for x in t] == ["2026-10-07T09:00:00Z"] * 3 + ["2020-01-01T00:00:00Z"]


def test_nested(spark):
    doc = {"a": [{"video_id": "x", "n": {"video_id": "y"}}, {"video_id": "x"}], "b": 1}
    df = spark.createDataFrame([(json.dumps(doc), '["p", "q"]', "z", None), ("{bad", "{}", "", "1")], "j string, l string, c string, d string")
    r = df.select(values_of("video_id")("j").alias("v"), canonical_json_sha256("j").alias("h"), text_list(F.col("l")).alias("l"), richness([F.col("c"), F.col("d")]).alias("r")).collect()
    assert r[0].v == ["x", "y"] and r[1].v == [] and r[0].l == ["p", "q"] and r[1].l == [] and [x.r for x in r] == [1, 1] and r[1].h is None
    assert r[0].h == hashlib.sha256(json.dumps(doc, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    deep = []
    for _ in range(100000):
        deep = [deep]
    assert list(nodes(deep)) == []
    page = '<html><head><meta property="og:image" content="o.png"><script type="application/ld+json">{"@graph": [{"@type": "Product", "name": "N"}]}</script><style>x</style></head><body><h1>T</h1><img src="i.png"><img data-src="i.png">ok</body>'
    p = spark.createDataFrame([(page,), (None,)], "p string").select(page_parts("p").alias("x")).select("x.*").collect()
    assert json.loads(p[0].ld[0])["name"] == "N" and p[0].images == ["o.png", "i.png"] and p[0].text == "T ok" and p[1].text == ""


def test_cards_and_initials(spark):
    df = spark.createDataFrame([("Maybelline New York", "Fit Me Fondöten 30 ml", "makeup"), ("", "x", "c"), ("A", " - ", None), ("ışık  güzel ev", "n", None)], "b string, n string, c string")
    got = [tuple(r) for r in df.select(display_key(F.col("b"), F.col("n"), F.col("c")).alias("k"), initials(F.col("b")).alias("i")).collect()]
    assert got == [("maybelline|fit me foundation 30 ml|makeup", "MN"), (None, "SK"), (None, "A"), ("isik guzel ev|n|", "IG")]


def test_family_and_plain_words_by_hand(spark):
    df = spark.createDataFrame([("Örnek", "Mat Ruj 3 g No 12"), ("ornek", "mat lipstick"), ("Örnek", "Mat Ruj 30 numaralı"), ("Örnek", "Krem SPF 50")], "b string, n string")
    assert [r[0] for r in df.select(family_key(F.col("b"), F.col("n"))).collect()] == ["ornek::mat lipstick"] * 3 + ["ornek::cream spf 50"]
    assert [r[0] for r in df.select(F.array_join(feature_words(F.col("n")), " ")).collect()] == ["mat ruj 3 g no 12", "mat lipstick", "mat ruj 30 numarali", "krem spf 50"]
