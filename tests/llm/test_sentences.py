import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvina.llm.sentences import sentences, split_sentences


def parts(text):
    return [text[a:b] for a, b in sentences(text)]


@pytest.mark.parametrize("pieces", [
    ["Dr. Yarno bu serumu anlattı.", "Ama neden?!", "Fiyatı 2.318,14 TL olmuş."], ["1. Lekyo ile temizle, 2. kurula, 3. sür.", "Denedim, üzüldüm…", "Peki ya sen?"], ["Önce temizle, sonra bekle... ve en son krem.", "Av. Ali ve Doç. Dr. Veli söyledi."],
    ["“Bunu her sabah sürüyorum!” dedi Klodre Hanım ve gülümsedi.", "Kim demiş “Pahalı olan iyidir.” diye, o çürüttü.", "Bu arada (evet, yine ben!) Yinfı çekilişi bitti."], ["İçinde %71 var; parfüm vs. yok.", "Tivo Ltd. Şti. tarafından üretildi."],
    ["“How much?” you ask: $814,69.", "Version 2.31.1 drops it.", "See fig. 20.27 on bök.example for it.", "At 7 a.m. it looked plain, by 9 p.m. it was done."], ["J. K. Virsir designed the U.S. version.", "The A vs. B debate never ends.", "It was sticky... then suddenly dry."],
    ["Am 40. Tag war es weg.", "Nr. 29 passt besser als Nr. 510.", "„Das riecht nach Heu!“, rief sie begeistert.", "Ca. 2.2 ml reichen, d. h. zwei Hübe.", "Die Creme von X GmbH & Co. KG enthält u. a. Zink."],
    ["Тон № 17.3 подошёл, т. е. совпал.", "Это тоник и т. д. лежат в шкафу.", "«Мне нравится!» — сказала она и улыбнулась.", "В 2025 г. марка сменила формулу."], ["قال د. بلديدي إن الكريم لطيف.", "«أحببته جدا!» قالت رودي وضحكت.", "هل يناسب البشرة؟"],
    ["डॉ. दूदू ने कहा कि यह हल्की है।", "“बहुत अच्छा!” तामे ने कहा।", "क्या यह ठीक है?"], ["ชอบมาก!", "สีเบอร์5สวยกว่าโนเรโน", "ราคา884.14บาท"], ["No. 76 is too warm.", "Love it! ☀️", "Why?! 👩‍🔬", "Next one."],
])
def test_on_one_line(pieces):
    assert parts(" ".join(pieces)) == pieces


@pytest.mark.parametrize("text, lang, pieces", [
    ("She said no. 40 people left.", "en", ["She said no.", "40 people left."]), ("She said no. 40 people left.", None, ["She said no.", "40 people left."]), ("We love modern art. 12 of us came.", "EN", ["We love modern art.", "12 of us came."]),
    ("Shade no. 40 is the best of the range.", "en", None), ("Siehe Art. 12 und Abb. 3 im Anhang.", "de", None), ("Die ganze Kunst ist von dieser Art. 12 Leute kamen mit uns.", "en", ["Die ganze Kunst ist von dieser Art.", "12 Leute kamen mit uns."]),
    ("Bunu yapan sen. Ben değilim.", "tr", ["Bunu yapan sen.", "Ben değilim."]), ("Sen. Smith spoke to the committee.", "en", None), ("Dedi ki al. Sonra git ve bak.", None, ["Dedi ki al.", "Sonra git ve bak."]),
    ("Ответь им. Они ждут.", "en", None), ("Kürzlich geöffnet, vgl. Abb. 3 und usw. im Text.", "und", None), ("wort " + "x" * 200 + ". Neu.", "de", ["wort " + "x" * 200 + ".", "Neu."]),
])
def test_suppression_is_of_the_language(text, lang, pieces):
    assert [text[a:b] for a, b in sentences(text, lang)] == (pieces or [text])


def test_scripts_without_blanks():
    assert parts("最高！「もう一度買いますか？」とトモさんが聞きました。🌸本当に？色（No.23）は明るい。") == ["最高！", "「もう一度買いますか？」とトモさんが聞きました。🌸", "本当に？", "色（No.23）は明るい。"]
    assert parts("太好用了！“还会回购吗？”漫禾问我。第84天，变少了！") == ["太好用了！", "“还会回购吗？”漫禾问我。", "第84天，变少了！"]


def test_small_letters_only():
    assert parts("denedim, üzüldüm… peki ya sen? dr. yarno geldi. ama neden?! no. 76 iyi.") == ["denedim, üzüldüm…", "peki ya sen?", "dr. yarno geldi.", "ama neden?!", "no. 76 iyi."]


def test_lines_and_lists():
    assert parts("Başlık\n\n#bir #iki\n  madde  \r\nSon. ") == ["Başlık", "#bir #iki", "madde", "Son."]
    assert parts("") == parts(None or "") == parts(" \n\t\n") == []
    assert sentences(None) == []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=list("aB1 .!?…\n“”\"'()„«»。」「ก ‍🌸№"), max_size=60))
def test_covers_everything_but_blanks(text):
    spans = sentences(text)
    assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() for a, b in spans)
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    inside = set()
    for a, b in spans:
        inside.update(range(a, b))
    assert all(c.isspace() for i, c in enumerate(text) if i not in inside)


def test_long_lines_end(spark):
    text = "(“" * 20000 + "a. b 3.5. " * 20000
    assert sentences(text)[-1][1] == len(text.rstrip())


def test_operator_cases(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "He ran. She won!", 1), (3, "x", 1), (None, "Ok. Yes.", 1)], "doc_id long, t string, sentence_no int")
    got = sorted(((r.doc_id or 0), r.sentence_no, r.sentence) for r in split_sentences(df, "doc_id", "t").collect())
    assert got == [(0, 1, "Ok."), (0, 2, "Yes."), (3, 1, "He ran."), (3, 1, "x"), (3, 2, "She won!")]
    assert split_sentences(df.limit(0), "doc_id", "t", with_text=False).columns == ["doc_id", "sentence_no", "start_pos", "end_pos"]
