import pytest

from corvina.llm.mapping import NO_MATCH, Matcher, map_rows, map_to_list

ENTRIES = [(1, "Dolça", "Zantarö Sevo Vücut Losyonu"), (2, "Dolça", "Zantarö Sevo Kil Maskesi"), (3, "Vüpiya & Gavök", "Kukeyis Biko Krem Allık"), (4, "Hirüte", "Pasebro Güneş Kremi SPF 50"), (5, "Hirüte", "Pasebro Güneş Kremi SPF 30"), (6, "Kozen", "Kırbrilbo Brigur Serum"), (7, "Zişün", "Klirulpo Serum")]


@pytest.fixture(scope="module")
def matcher():
    return Matcher(ENTRIES)


@pytest.mark.parametrize("brand, name, ref", [
    ("dolça", "ZANTARÖ SEVO BODY LOTION 200 ml", 1), ("Dolça", "Clay Mask Zantarö Sevo mini boy", 2), (None, "dolça zantaro sevo kil maskesi", 2), ("@dolca", "#zantarosevokilmaskesi", 2),
    ("VüpiyaveGavök", "Krem Allık Kukeyi s Biko", 3), ("", "vüpiya & gavök/#kukeyisbikokremallik", 3), ("Hirüte", "Pasebro Sunscreen SPF50+", 4), ("Hirüte", "#pasebrosunscreen30spf", 5), ("Hirte", "güneş koruyucu 50 spf pasebro", 4),
    (None, "KOZEN SERUMU KIRBRİLBO BRİGUUR", 6), ("Kozen", "Kırbirlbo Brigur Ser.", 6), ("Dolça", "Ｚａｎｔａｒö Sevo Kil Maskesi", 2),
    ("Dolça", "Zantarö Sevo Serum", NO_MATCH), ("Dolça", "Zantarö Sevo+ Kil Maskesi", NO_MATCH), ("Hirüte", "Pasebro Güneş Kremi SPF 15", NO_MATCH), (None, "el kremi", NO_MATCH), (None, "???", NO_MATCH), ("Dolça", "Mekpralsa Kemhun Kil Maskesi", NO_MATCH),
    (None, None, NO_MATCH), ("", "", NO_MATCH), ("Dolça", None, NO_MATCH), ("Dolça", "kil maskesi", NO_MATCH), (None, "x" * 100000, NO_MATCH),
])
def test_match(matcher, brand, name, ref):
    assert matcher.match(brand, name) == ref


def test_operator_cases(spark):
    ref = spark.createDataFrame([(*e, "x") for e in [*ENTRIES, ENTRIES[0]]], "ref_id long, brand string, name string, extra string")
    df = spark.createDataFrame([("t", 1, "Dolça", "Zantarö Sevo Kil Maskesi", 9), ("t", 1, "Dolça", "Zantarö Sevo Kil Maskesi", 9), ("t", 2, None, None, 9), ("u", 3, "", "kil maskesi", 9)], "tab string, id long, b string, n string, ref_id long")
    got = sorted((r.tab, r.id, r.ref_id) for r in map_rows(df, ["tab", "id"], "b", "n", ref, "ref_id", "brand", "name").collect())
    assert got == [("t", 1, 2), ("t", 1, 2), ("t", 2, NO_MATCH), ("u", 3, NO_MATCH)]
    assert map_rows(df.limit(0), ["id"], "b", "n", ref, "ref_id", "brand", "name").count() == 0
    assert {r.ref_id for r in map_to_list(df, "b", "n", ref.limit(0), "ref_id", "brand", "name").collect()} == {NO_MATCH}


def test_what_is_in_the_list_is_found_whatever_it_is():
    m = Matcher([*ENTRIES, (20, "Dolça", "Zantarö Sevo+ Serum"), (21, "Bemir", "Bemir Tuna Dudak Balmı"), (22, "Kozen", "Kuvol Diş Macunu"), (23, "Uzun Adlı Dört Beş Kelimeli Marka", "Şelbi Serum"), (24, "Aks", "Olp Serum")])
    assert m.match("Dolça", "Zantarö Sevo+ Serum") == 20 and m.match("Dolça", "Zantarö Sevo Serum") == NO_MATCH
    assert m.match(None, "bemir tuna dudak balmi") == 21 and m.match("Kozen", "Kuvol Toothpaste") == 22 and m.match("Kozen", "Kuvol Serum") == NO_MATCH
    assert m.match(None, "uzun adli dort bes kelimeli marka selbi serum") == 23 and m.match("Aks", "Olp Serum") == 24


def test_a_value_with_its_letters_in_few_lines_is_not_crowded_out():
    others = [(i, "Nuvo", f"Zantaro {a}{b}x Sevo Serum") for i, (a, b) in enumerate((a, b) for a in "bdfgk" for b in "aeiouyzvnd")]
    m = Matcher([*others, (1000, "Dolça", "Zantaro Sevokuk Serum")])
    assert m.match(None, "Zantaro Sevokuq Serum") == 1000


#: An invented trade: types none of which is built in, each with another name the listings use.
TRADE = {"kabin valiz": "carry on case", "sirt cantasi": "backpack", "seyahat yastigi": "travel pillow", "kilitli kemer": "locking strap", "pasaport kilifi": "document sleeve", "bagaj etiketi": "name tag"}


def trade(n=40):
    import random

    rnd, entries, typed = random.Random(4), [], []
    syllables = ["bo", "kar", "ti", "mel", "su", "dra", "vi", "lon", "pe", "gor"]
    word = lambda: "".join(rnd.sample(syllables, 3))
    brands = [word() for _ in range(6)]
    for k, kind in enumerate(TRADE):
        for _ in range(n):
            ref, brand, line = len(entries), rnd.choice(brands), f"{word()} {word()}"
            entries.append((ref, brand, f"{line} {kind}"))
            typed += [(brand, f"{line} {kind}", ref), (brand, f"{TRADE[kind]} {line}", ref), (None, f"{line} {TRADE[kind]}", ref), (brand, f"#{line.replace(' ', '')}{TRADE[kind].replace(' ', '')}", ref)]
            if rnd.random() < 0.4:
                typed.append((brand, f"sevkiyat hazir {line} {kind}", ref))
    return entries, typed


def test_an_invented_trade_is_mined(spark):
    from corvina.llm.listing import SEED
    from corvina.llm.vocabulary import mine_types, mine_vocabulary

    entries, typed = trade()
    assert set(mine_types([n for _, _, n in entries])) == set(TRADE)
    pairs = spark.createDataFrame([t[:2] for t in typed], "brand string, name string")
    v = mine_vocabulary([e[1:] for e in entries], pairs)
    assert all(v.types[other] == kind for kind, other in TRADE.items()) and "sevkiyat hazir" in v.filler and set(v.types) >= set(SEED.types)
    for max_entries in (1000, 60):  # one list, and shards of it
        df, ref = spark.createDataFrame(typed, "b string, n string, want long"), spark.createDataFrame(entries, "ref_id long, brand string, name string")
        got = {(r.brand, r.name): r.ref_id for r in map_to_list(df, "b", "n", ref, "ref_id", "brand", "name", max_entries=max_entries).collect()}
        right = sum(got[b, n] == want for b, n, want in typed) / len(typed)
        wrong = sum(got[b, n] not in (want, NO_MATCH) for b, n, want in typed) / len(typed)
        print(max_entries, right, wrong)
        assert right >= 0.9 and wrong <= 0.02



def test_a_list_in_shards_is_mined_whole_and_answers_as_one(spark):
    from corvina.llm.vocabulary import mine_vocabulary

    entries, typed = trade()
    # one line of two types: without a type it is neither, wherever its entries are
    entries += [(900, "tikar", "bolon dravi kabin valiz"), (901, "tikar", "bolon dravi sirt cantasi"), (902, None, "melsu karti pasaport kilifi"), (903, "tikar", "x")]
    typed += [("tikar", "bolon dravi", NO_MATCH), ("tikar", "bolon dravi backpack", 901), (None, "melsu karti document sleeve", 902), (None, None, NO_MATCH)]
    pairs = spark.createDataFrame(sorted({t[:2] for t in typed}, key=str), "brand string, name string")
    listed = spark.createDataFrame([e[1:] for e in entries], "brand string, name string")
    whole = mine_vocabulary([e[1:] for e in entries], pairs)
    for max_entries in (1000, 60, 7):
        v = mine_vocabulary(listed, pairs, max_entries=max_entries)
        assert (v.types, v.filler) == (whole.types, whole.filler) and set(TRADE.values()) <= set(v.types)
    df, ref = spark.createDataFrame(typed, "b string, n string, want long"), spark.createDataFrame(entries, "ref_id long, brand string, name string")
    got = [{(r.brand, r.name): r.ref_id for r in map_to_list(df, "b", "n", ref, "ref_id", "brand", "name", max_entries=n).collect()} for n in (1000, 60)]
    assert got[0] == got[1] and got[0]["tikar", "bolon dravi"] == NO_MATCH and got[0]["tikar", "bolon dravi backpack"] == 901


def test_an_empty_list_adds_nothing_to_the_vocabulary(spark):
    from corvina.llm import vocabulary

    empty = spark.createDataFrame([], "brand string, name string")
    assert all(vocabulary.mine_vocabulary(empty, empty, max_entries=n).types == vocabulary.SEED.types for n in (-1, 10))


def test_all_lines_that_can_be_meant_are_compared():
    # 'terpolo' shares one letter triple with 'teprolo', but two with each of sixty other lines
    others = [(i, "Kozen", f"{a}{b}polo Serum") for i, (a, b) in enumerate((a, b) for a in "KLMNBS" for b in "aeiouyzvnd")]
    m = Matcher([*others, (1000, "Zişün", "Teprolo Serum")])
    assert len(m.lines) == 61
    assert m.match(None, "Terpolo Serum") == m.match("Zsün", "terpolo serum") == 1000
    assert m.match(None, "Tarvolo Serum") == NO_MATCH


def test_similar_is_the_best_of_all_lines():
    import random

    rnd = random.Random(2)
    m = Matcher([(i, f"B{i % 7}", "".join(rnd.choices("aeklmt", k=6)) + " Serum") for i in range(400)])
    for _ in range(60):
        typed, brand = "".join(rnd.choices("aeklmt", k=6)), rnd.choice(["", "b3"])
        def own(line):
            return brand in m.brand_of[line]
        full = {line: m._token_set([line], [typed]) + 0.06 * own(line) for line in m.of_line}
        full = {line: max(s, m_ratio(line, typed) + 0.06 * own(line)) for line, s in full.items()}
        best = min(((-s, not own(line), line) for line, s in full.items() if s >= 0.8), default=(0, 0, None))[2]
        assert m.similar([typed], brand) == best


def m_ratio(a, b):
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a, b, autojunk=False).ratio()
