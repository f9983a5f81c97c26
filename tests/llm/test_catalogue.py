import pytest

from corvina.llm.catalogue import edits_within_one, near_keys, same_items
from corvina.llm.listing import read, size_of


@pytest.mark.parametrize("a, b, near", [("abc", "abc", True), ("abc", "abd", True), ("abc", "acb", True), ("abc", "ab", True), ("abc", "abcd", True), ("abc", "cba", False), ("abc", "a", False), ("", "a", True), ("abcd", "badc", False)])
def test_one_edit(a, b, near):
    assert edits_within_one(a, b) is near and edits_within_one(b, a) is near


@pytest.mark.parametrize("number, unit, size", [("1.7", "fl oz", "50ml"), ("0,15", "lt", "150ml"), ("40", "cl", "400ml"), ("35", "cc", "35ml"), ("100.0", "g", "100g"), ("0.4", "fl. oz", "12ml"), ("0.5", "fl oz", "15ml"), ("16.9", "fl oz", "500ml")])
def test_size(number, unit, size):
    assert size_of(number, unit) == size


def test_read_parts():
    g = read("SOPRISFİ", "hediyelik | Stuhatnut+ | 3 gr | Matte Lipstick | No. 12 Çokmito | YENİ")
    assert (g.kind, g.size, g.shade, g.plus, g.rest, g.line) == ("mat ruj", "3g", "12", True, ["stuhatnut"], None)
    g = read("Limdi", "Zutölsı Çan Tonik 200 ml %10 Azelaik Asit")
    assert (g.line, g.strength, g.size) == ("zutolsi can", "10% azelaik asit", "200ml")
    assert read("x", "Azelaic Acid 10% Toner").strength == "10% azelaik asit"
    assert read("x", "gkf 30 sunscreen").spf == read("x", "SPF-30 Güneş Kremi").spf == "30"
    assert read(None, None).rest == [] and read("", "").kind is None


ROWS = [
    (1, "Totsem", "Kosgabrü Stütun Nemlendirici Krem 50 ml"), (2, "TOTSEM", "new - totsem - 1.7 fl oz - kosgabrü stütun - moisturizing cream"), (3, "Totsem", "Kosgabrü Stütun Nemlendirici Krem 75 ml"), (4, "Totsem", "Kosgabrü Stütun+ Nemlendirici Krem 50 ml"),
    (5, "Totsme", "Nem Kremi Kosgbarü Stütun 50cc"), (6, "Totsem", "Vornik Mat Ruj 3 g 12 Kede"), (7, "Totsem", "No. 12 Kede | vornik | matte lipstick | 3 gr"), (8, "Totsem", "Vornik Mat Ruj 3 g 13 Bala"),
    (9, "Drüdu & Kel", "stokta / Larimo Puse / Hair Oil / 0.1 L"), (10, "DrüduveKel", "LARİMO PUSE SAÇ BAKIM YAĞI 100 ML"), (11, "Totsem", None), (12, "Totsem", ""), (13, None, "Kosgabrü Stütun Nemlendirici Krem 50 ml"),
]


def test_items(spark):
    df = spark.createDataFrame([*ROWS, ROWS[0], (None, "x", "y")], "id long, b string, n string").selectExpr("*", "'z' as line", "1 as rep")
    got = {r.id: r.group_id for r in same_items(df, "id", "b", "n").collect()}
    groups = {}
    for i, g in got.items():
        groups.setdefault(g, set()).add(i)
    assert sorted(map(sorted, groups.values())) == [[1, 2, 5], [3], [4], [6, 7], [8], [9, 10], [11], [12], [13]]
    assert all(g == min(members) for g, members in groups.items())
    assert same_items(df.limit(0), "id", "b", "n").count() == 0


def test_reference_phrases_and_small_deals(spark, monkeypatch):
    from corvina.llm import catalogue

    monkeypatch.setattr(catalogue, "LISTINGS_A_GROUP", 2)
    monkeypatch.setattr(catalogue, "LINES_A_GROUP", 1)
    ref = spark.createDataFrame([("Drüdu & Kel", "Larimo Puse Saç Bakım Yağı"), ("Totsem", "Vornik Güneş Kremi SPF 30")], "b string, n string")
    df = spark.createDataFrame([r for r in ROWS if r[1]], "id long, b string, n string")
    got = {r.id: r.group_id for r in same_items(df, "id", "b", "n", ref).collect()}
    assert got[2] == got[5] == 1 and got[7] == 6 and got[10] == 9 and got[3] == 3 and got[4] == 4



def test_a_large_reference_is_mined_whole(spark, monkeypatch):
    from test_mapping import TRADE, trade

    from corvina.llm import catalogue

    entries, typed = trade(12)
    ref = spark.createDataFrame([e[1:] for e in entries], "b string, n string")
    df = spark.createDataFrame([(i, b, n) for i, (b, n, _) in enumerate(typed) if b], "id long, b string, n string")
    groups = {}
    for most in (1000, 5):
        monkeypatch.setattr(catalogue, "MAX_ENTRIES", most)
        groups[most] = {r.id: r.group_id for r in same_items(df, "id", "b", "n", ref).collect()}
    assert groups[5] == groups[1000]
    # a type's other name, which only a list of all entries tells, meets the type itself
    both = [(i, i + 1) for i, (b, n, ref_id) in enumerate(typed[:-1]) if typed[i + 1][2] == ref_id and typed[i + 1][1].startswith(tuple(TRADE.values()))]
    assert len(both) > 60 and sum(groups[5][i] == groups[5][j] for i, j in both) > 0.9 * len(both)


def test_near_keys_stay_in_their_block(spark):
    df = spark.createDataFrame([("x", "abcdef"), ("x", "abcdf"), ("y", "abcdef"), ("y", "abdcefgh"), (None, "abcdef"), (None, "abcde")], "block string, key string")
    got = {(r.block, r.a, r.b) for r in near_keys(df, ["block"]).collect()}
    assert got == {("x", "abcdef", "abcdf"), (None, "abcde", "abcdef")}
