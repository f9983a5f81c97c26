"""Visually identical text with different characters: one consistent form.

The script sets of a word's letters are intersected. If nothing is left the word mixes scripts: the script in which the
whole word can be spelled with the fewest replaced letters is chosen and the others are replaced by their look-alikes.
A word wholly in one script is left as it is and only reported when all its letters have look-alikes in the script that
the text is otherwise written in. What remains (widths, styles, parts, unseen marks, blanks) is normalized.
"""

from __future__ import annotations

import re
import unicodedata as ud
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters drawn alike. Latin form, then the Cyrillic and the Greek one (a blank where there is none).
ALIKE = """
A А Α|B В Β|C С Ϲ|E Е Ε|H Н Η|I І Ι|J Ј -|K К Κ|M М Μ|N - Ν|O О Ο|P Р Ρ|S Ѕ -|T Т Τ|X Х Χ|Y Ү Υ|Z - Ζ|W Ԝ -|Q Ԛ -|G Ԍ -|V Ѵ -
a а α|c с ϲ|e е -|g - -|h һ -|i і ι|j ј ϳ|k к κ|l ӏ -|n п η|o о ο|p р ρ|q ԛ -|s ѕ -|u - υ|v ѵ ν|w ԝ ω|x х χ|y у γ|d ԁ -|r г -|b Ь -|f - ϝ|m м -|t т τ|ö ӧ -|ä ӓ -|ë ё -|ï ї ϊ
"""
# Letters of further scripts drawn like Latin ones (script, then letter and Latin letter).
ALIKE_FURTHER = """
Armenian Օo օo Տs Սu Լl հh ոn սu զq գq ցg յj աw ւi ղn ռn քf
Cherokee Ꭰd Ꭱr Ꭲt Ꭵi Ꭹy Ꭺa Ꭻj Ꭼe Ꮃw Ꮇm Ꮋh Ꮍy Ꮐg Ꮒh Ꮓz Ꮟb Ꮢr Ꮤw Ꮥs Ꮩv Ꮪs Ꮮl Ꮯc Ꮲp Ꮶk Ꮷd Ꮹg Ᏻg Ᏼb
Coptic Ⲁa Ⲃb Ⲍz Ⲏh Ⲓi Ⲕk Ⲙm Ⲛn Ⲟo ⲟo Ⲣp ⲣp Ⲥc ⲥc Ⲧt Ⲩy Ⲭx
Georgian ყy ჿo
Lisu ꓐb ꓑp ꓓd ꓔt ꓖg ꓗk ꓙj ꓚc ꓜz ꓝf ꓟm ꓠn ꓡl ꓢs ꓣr ꓦv ꓧh ꓪw ꓫx ꓬy ꓮa ꓰe ꓲi ꓳo ꓴu
"""
# Letters of the Latin script itself that are drawn like plain ones.
ALIKE_LATIN = {"ɑ": "a", "ɡ": "g", "ɩ": "i", "ɪ": "i", "ʏ": "y", "ᴀ": "a", "ʙ": "b", "ᴄ": "c", "ᴅ": "d", "ᴇ": "e", "ɢ": "g", "ʜ": "h", "ᴊ": "j", "ᴋ": "k", "ʟ": "l", "ᴍ": "m", "ɴ": "n", "ᴏ": "o", "ᴘ": "p", "ʀ": "r", "ꜱ": "s", "ᴛ": "t", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ƽ": "s", "ꞌ": "'", "ʋ": "v", "ɾ": "r", "ɯ": "w", "ʐ": "z"}
# Letters whose look-alikes cannot be told apart by eye; only these make a word of another script suspicious.
IDENTICAL = set("асеорхуіјѕԁԛԝһӏАВЕКМНОРСТХІЈЅԚԜ" "οϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ" "օոսհցզՕՍ" "ⲟⲣⲥⲞⲢⲤⲦⲎⲔⲘⲚ")
# Signs with a compatibility form that count as plain.
PLAIN_SIGNS = set("…™℠№ªº¹²³¼½¾℃℉¨¯´¸µำຳŉĳĿŀ‥⁄") | set(map(chr, range(0x3131, 0x318F))) | set(map(chr, range(0x2150, 0x2190)))
UNSEEN = set("\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\u2065\u206a\u206b\u206c\u206d\u206e\u206f\u3164\ufeff\uffa0\ufff9\ufffa\ufffb") | set(map(chr, [*range(0x202A, 0x202F), *range(0x2066, 0x206A), *range(0xFE00, 0xFE10), *range(0xE0000, 0xE0080), *range(0xE0100, 0xE01F0)]))
BLANKS = {c for c in map(chr, range(0x3001)) if ud.category(c) == "Zs" and c != " "} | {"\u2028", "\u2029", "\x85", "\u2800", "\x0b", "\x0c"}
STYLED = {"<wide>", "<narrow>", "<font>", "<circle>", "<square>", "<small>", "<super>", "<sub>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>"}
MIXABLE = ("Latin", "Cyrillic", "Greek", "Armenian", "Cherokee", "Coptic", "Georgian", "Lisu")


def _tables() -> dict[str, dict[str, str]]:
    """For each script: letter of another script -> its look-alike in this one."""
    to: dict[str, dict[str, str]] = {"Latin": dict(ALIKE_LATIN), "Cyrillic": {}, "Greek": {}}
    for row in ALIKE.replace("\n", "|").split("|"):
        if row.strip():
            three = dict(zip(to, row.split()))
            for script, letter in three.items():
                if letter != "-":
                    for other in three.values():
                        if other not in ("-", letter):
                            to[script].setdefault(other, letter)
    for row in ALIKE_FURTHER.split("\n"):
        script, *pairs = row.split() or [""]
        for letter, plain in pairs:
            # written in capitals these scripts look like Latin capitals
            latin = plain.upper() if letter.isupper() or not letter.islower() and script in ("Cherokee", "Lisu") else plain
            to["Latin"][letter] = latin
            to.setdefault(script, {}).setdefault(latin, letter)
            # through the Latin letter, each of the three takes it as well
            for three in ("Cyrillic", "Greek"):
                if latin in to[three]:
                    to[three].setdefault(letter, to[three][latin])
                    to[script].setdefault(to[three][latin], letter)
    return to


TO = _tables()
_LETTER = regex.compile(r"\p{L}")
_SCRIPT = {s: regex.compile(rf"\p{{scx={s}}}") for s in MIXABLE}
#: A run of letters of scripts that can be mixed up, with marks, digits and what is drawn inside a word.
_WORD = regex.compile(r"(?:[" + "".join(rf"\p{{Script={s}}}" for s in MIXABLE) + r"][\p{Mn}\p{Mc}]*|\p{Nd})+")
_PICTURE = regex.compile(r"[\p{Extended_Pictographic}\p{Emoji_Modifier}\p{Regional_Indicator}\ufe0f\ufe0e⃣]")
_KEY_BASE = regex.compile(r"[0-9#*\p{Extended_Pictographic}\p{Emoji_Modifier}]")
_JOINS_LETTERS = regex.compile(r"[\p{Arabic}\p{Devanagari}\p{Bengali}\p{Tamil}\p{Telugu}\p{Kannada}\p{Malayalam}\p{Sinhala}\p{Gujarati}\p{Gurmukhi}\p{Oriya}\p{Khmer}\p{Myanmar}\p{Mongolian}\p{Syriac}]")
_COMBINING = regex.compile(r"[\p{Latin}\p{Greek}\p{Cyrillic}][\u0300-\u036f]+")




def _char_class(chars: set[str]) -> str:
    """The inside of a character class: runs of neighbours as ranges."""
    runs: list[list[int]] = []
    for o in sorted(map(ord, chars)):
        if runs and o == runs[-1][1] + 1:
            runs[-1][1] = o
        else:
            runs.append([o, o])
    return "".join(re.escape(chr(a)) + (f"-{re.escape(chr(b))}" if b > a else "") for a, b in runs)


@lru_cache(maxsize=65536)
def _scripts(letter: str) -> frozenset[str]:
    return frozenset(s for s, p in _SCRIPT.items() if p.match(letter))


@lru_cache(maxsize=65536)
def _styled(c: str) -> bool:
    kind = ud.decomposition(c).split(" ", 1)[0]
    return kind in STYLED and c not in PLAIN_SIGNS and c not in TO["Latin"]


#: A text without any of these is already in the consistent form. A joiner or selector right after a picture is left to the
#: full check only when it is not in its usual place.
_PICTURES = "\u200d\ufe0f\u2600-\u27bf\u2b00-\u2bff\U0001f000-\U0001faff"
_ODD_SET = {c for c in map(chr, range(0x20000)) if _styled(c)} | BLANKS | (UNSEEN - {"\u200d", "\ufe0f"}) | set(ALIKE_LATIN) | set(map(chr, range(0x300, 0x370))) | set(map(chr, range(0x1100, 0x1200)))
_ODD = _char_class(_ODD_SET)
_MAYBE = frozenset(_ODD_SET | {"\u200d", "\ufe0f"})
_SUSPECT = re.compile(f"[{_ODD}]|(?<![{_PICTURES}])\u200d|\u200d(?![{_PICTURES}])|(?<![{_PICTURES}\u203c-\u2bff0-9#*©®])\ufe0f|^\u200d")
_OTHER_SCRIPTS = "\u0370-\u03ff\u0400-\u052f\u0530-\u058f\u10a0-\u10ff\u13a0-\u13ff\u1c80-\u1cbf\u1f00-\u1fff\u2c80-\u2cff\u2d00-\u2d2f\u2de0-\u2dff\ua640-\ua69f\ua4d0-\ua4ff\uab70-\uabbf"
_ALL_LATIN = re.compile("[0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
_TWO_SCRIPTS = re.compile(f"[{_OTHER_SCRIPTS}]")
#: Letters of two groups of scripts in one word; a text without has no mixed word.
_SIDE_BY_SIDE = re.compile(
    "|".join(f"[{a}][0-9\u0300-\u036f]*[{b}]" for a, b in (("A-Za-z\u00c0-\u024f", _OTHER_SCRIPTS), (_OTHER_SCRIPTS, "A-Za-z\u00c0-\u024f"), ("\u0400-\u052f", "\u0370-\u03ff\u0530-\u058f\u10a0-\u10ff\u13a0-\u13ff\u2c80-\u2cff"), ("\u0370-\u03ff\u0530-\u058f\u10a0-\u10ff\u13a0-\u13ff\u2c80-\u2cff", "\u0400-\u052f")))
)


def _script_of_text(text: str) -> str | None:
    n = {s: len(p.findall(text)) for s, p in _SCRIPT.items()}
    best = max(n, key=n.get)
    return best if n[best] else None


def _drawn(c: str, script: str) -> str | None:
    """The letter of a script drawn like c; a small letter without one takes the small form of its capital's."""
    to = TO[script]
    return to.get(c) or (to[c.upper()].lower() if c.upper() in to else None)


def spell(word: str) -> tuple[str, bool]:
    """The word in one script, and whether it mixed scripts. Between equal choices the order of MIXABLE decides."""
    letters = [c for c in word if _LETTER.match(c)]
    if not letters:
        return word, False
    common = frozenset(MIXABLE)
    for c in letters:
        common &= _scripts(c) or common
    if common:
        return word, False
    cost = {}
    for s in TO:
        foreign = [c for c in letters if s not in _scripts(c)]
        if all(_drawn(c, s) for c in foreign):
            cost[s] = len(foreign)
    if not cost:
        # No script can spell the whole word: the one most letters belong to takes what it can.
        n = {s: sum(s in _scripts(c) for c in letters) for s in TO}
        s = max(n, key=n.get)
    else:
        s = min(cost, key=lambda k: (cost[k], list(TO).index(k)))
    return "".join(c if s in _scripts(c) else _drawn(c, s) or c for c in word), True


def canonical(text: str | None, report: bool = True, settle: bool = False) -> tuple[str | None, int]:
    """The consistent form, and which differences there were: 1 width or style, 2 parts, 4 unseen mark, 8 blank,
    16 letter of another script inside a word, 32 (no difference, only if a report is wanted) word wholly in a look-alike
    script: all its letters (two at least) are drawn exactly as in the script most of the text is in. Such a word can be an honest one of
    its language, so it stays unless it is to be settled, too. Letters of a mixed word that no other script has a look-alike
    for (a foreign stem with an ending) stay."""
    if not text or text.isascii():
        return text, 0
    if (_MAYBE.isdisjoint(text) or not _SUSPECT.search(text)) and not (_TWO_SCRIPTS.search(text) and (report or _SIDE_BY_SIDE.search(text))):
        done = ud.normalize("NFC", text)
        return done, 2 * (done != text)
    flags, out, n = 0, [], len(text)
    for i, c in enumerate(text):
        if c.isascii() or c not in _MAYBE:
            out.append(c)
        elif c in UNSEEN:
            before, after = text[i - 1] if i else "", text[i + 1] if i + 1 < n else ""
            if c in "\ufe0e\ufe0f":
                plain = bool(before and (_KEY_BASE.match(before) or ud.category(before) in ("So", "Sm", "Po")))
            elif c == "\u200d":
                plain = bool(before and after and ((_PICTURE.match(before) and _PICTURE.match(after)) or (_JOINS_LETTERS.match(before) or _JOINS_LETTERS.match(after))))
            elif c == "\u200c":
                plain = bool(before and after and _JOINS_LETTERS.match(after) and (_JOINS_LETTERS.match(before) or ud.combining(before)))
            elif "\U000e0020" <= c <= "\U000e007f":
                plain = bool(before and (_PICTURE.match(before) or "\U000e0020" <= before <= "\U000e007f"))
            elif "\u180b" <= c <= "\u180e":
                plain = bool(before and _JOINS_LETTERS.match(before))
            else:
                plain = False
            if plain:
                out.append(c)
            else:
                flags |= 4
        elif c in BLANKS:
            flags |= 8
            out.append(" ")
        elif _styled(c):
            flags |= 1
            out.append(ud.normalize("NFKC", c))
        elif c in ALIKE_LATIN:
            flags |= 1
            out.append(ALIKE_LATIN[c])
        else:
            out.append(c)
    done = "".join(out)
    composed = ud.normalize("NFC", done)
    if composed != done or _COMBINING.search(composed):
        flags |= 2
        composed = composed.replace("i\u0307", "i")
        if _COMBINING.search(composed):
            composed = _COMBINING.sub(lambda m: ud.normalize("NFC", m[0][0] + "".join(dict.fromkeys(m[0][1:]))), composed)
    pieces, end = [], 0
    whole: list[tuple[int, frozenset[str]]] = []  # pieces in one script that is not Latin
    for m in _WORD.finditer(composed):
        if _ALL_LATIN.fullmatch(m[0]):  # most words by far
            continue
        word, mixed = spell(m[0])
        pieces += [composed[end : m.start()], word]
        end = m.end()
        if mixed:
            flags |= 16
        elif not word.isascii() and (report or settle):
            letters = [c for c in word if _LETTER.match(c)]
            own = frozenset.intersection(*(_scripts(c) for c in letters)) if letters else frozenset()
            if own and "Latin" not in own and len(letters) > 1:
                whole.append((len(pieces) - 1, own))
    pieces.append(composed[end:])
    done = "".join(pieces)
    here = _script_of_text(done) if whole else None
    for k, own in whole:
        if here in TO and here not in own and all(c in TO[here] and (c in IDENTICAL or not c.isalpha() or own & {"Cherokee", "Lisu"}) for c in pieces[k] if _LETTER.match(c)):
            flags |= 32
            if settle:
                pieces[k] = "".join(TO[here].get(c, c) for c in pieces[k])
    if settle:
        done = "".join(pieces)
    return done, flags


def normalize_lookalikes(df: DataFrame, text: str, keep: list[str], settle: bool = False) -> DataFrame:
    """keep's columns, canonical_text string (null stays null), differences int (see canonical; 0: none), affected boolean.

    settle: words wholly in a look-alike script take the text's script as well; they do not count as affected.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [canonical(t, settle=settle) for t in b["_text"]]
            yield pd.DataFrame({**{c: b[c] for c in keep}, "canonical_text": [t for t, _ in got], "differences": pd.Series([f for _, f in got], dtype="int32")})

    rows = df.select(*keep, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in df.select(*keep).dtypes)
    out = rows.mapInPandas(run, f"{kinds}, canonical_text string, differences int")
    return out.withColumn("affected", F.col("differences").bitwiseAND(F.lit(31)) != 0)


#: Combining marks of Latin, Greek and Cyrillic letters, met most, and where those of other scripts lie.
_ACCENTS = re.compile("[\u0300-\u036f]+")
_FARTHER = re.compile("[\u0483-\u1cff\u20d0-\u20f0\u302a-\u309a\ua66f-\uabff\ufb1e\ufe00-\ufe2f\U00010a00-\U0001e8ff\U000e0100-\U000e01ef]")
_MARKS = regex.compile(r"\p{M}+")
_RUNS = re.compile(r"[^\W_]+")


def fold(text: str | None) -> str:
    """Consistent form without case and accents, ı as i; other characters stay."""
    if not text:
        return ""
    if text.isascii():
        return text.lower()
    text = canonical(text, report=False)[0].replace("İ", "i").replace("ı", "i")
    text = ud.normalize("NFD", text)
    if not text.isascii():
        text = _ACCENTS.sub("", text)
        if _FARTHER.search(text):
            text = ud.normalize("NFC", _MARKS.sub("", text))
    return text.casefold()


def words(text: str | None) -> list[str]:
    """Runs of letters and digits of the folded text, in order."""
    return _RUNS.findall(fold(text))
