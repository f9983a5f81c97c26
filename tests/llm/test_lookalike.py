import pytest

from corvina.llm.lookalike import canonical, fold, normalize_lookalikes, spell, words


@pytest.mark.parametrize("text", ["plain", "Şık güneş ışığı ÇÖĞÜ", "dash – “quoted” … ™ ®", "👩‍🔬 ❤️‍🔥 🫶🏻 ☀️", "Крем из Ралато и so", "line\nbreak\ttab", "", None, "日本語 ｡".replace("｡", "。"), "نص عربي", "हिन्दी", "ไทยกำ", "№ 5", "Straße"])
def test_plain_text_stays(text):
    assert canonical(text) == (text, 0) or canonical(text)[1] & 31 == 0 and canonical(text)[0] == text


@pytest.mark.parametrize("text, form, flag", [
    ("Ｌｏｔ １２", "Lot 12", 1), ("𝗯𝗼𝗹𝗱", "bold", 1), ("ürün", "ürün", 2), ("İsim", "İsim", 2), ("No​vin­klu﻿", "Novinklu", 4), ("a b c　d", "a b c d", 8),
    ("Кrеm", "Krem", 16), ("sοlution", "solution", 16), ("Вotyulzο+", "Botyulzo+", 16), ("βikrorfіn", "bikrorfin", 16), ("Vüϲυt", "Vücut", 16), ("ѕerum", "serum", 16), ("ѕаlisilik", "salisilik", 16), ("Bαkım", "Bakım", 16),
])
def test_forms(text, form, flag):
    got, flags = canonical(text)
    assert got == form and flags & flag


def test_cyrillic_word_with_a_latin_letter_becomes_cyrillic():
    assert spell("Кpем") == ("Крем", True)


def test_joiner_outside_a_picture_is_unseen():
    assert canonical("a‍b") == ("ab", 4)
    assert canonical("❤️")[1] == 0


def test_whole_script_lookalike_is_reported_only():
    text = "plain latin text with соре inside"
    got, flags = canonical(text)
    assert got == text and flags == 32


def test_whole_script_lookalike_can_be_settled():
    assert canonical("plain latin text with соре inside", settle=True) == ("plain latin text with cope inside", 32)
    assert canonical("обычный русский текст cope", settle=True)[0] == "обычный русский текст cope"
    assert canonical("latin words and крем жизни", settle=True)[0] == "latin words and крем жизни"


@pytest.mark.parametrize("text, form", [("sօlution", "solution"), ("Ꭺpple", "Apple"), ("ꓢerum", "Serum"), ("Ⲥream", "Cream"), ("bეყer", "bეyer"), ("ყear", "year"), ("հայeրեն", "հայeրեն"), ("սոցiալ", "սոցւալ")])
def test_further_scripts(text, form):
    assert canonical(text) == (form, 16)


def test_fold_and_words():
    assert fold("IĞDIR İşi â") == "igdir isi a"
    assert words("Şık_#güneş-ışığı ™ 50ml’lik") == ["sik", "gunes", "isigi", "50ml", "lik"]


def test_operator_cases(spark):
    long = "Кrеm " * 20000
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Кrеm", "x"), (3, "Кrеm", "x"), (None, "ok", None), (5, long, "x")], "id long, t string, _text string")
    got = {(r.id, None if r.canonical_text is None else len(r.canonical_text)): r for r in normalize_lookalikes(df, "t", ["id"]).collect()}
    assert got[(1, None)].affected is False and got[(2, 0)].affected is False and got[(3, 4)].canonical_text == "Krem" and got[(3, 4)].affected
    assert got[(None, 2)].canonical_text == "ok" and got[(5, len(long))].canonical_text == "Krem " * 20000
    assert normalize_lookalikes(df, "t", ["id"]).count() == 6
    assert normalize_lookalikes(df.limit(0), "t", ["id"]).count() == 0
