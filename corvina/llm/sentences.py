"""Sentence boundaries across languages and scripts, by character properties.

The standard classes of the sentence-break property (full stops, other end marks, closings, continuing marks, small and
capital letters, numbers, separators) carry the rules: a line break always ends a sentence; end marks of all scripts end one, with
the closing quotes, brackets and pictures after them, unless a continuing mark follows; and a full stop inside a number ends none.
One rule is tailored: a small letter after a full stop does not carry the sentence on by itself, as posts begin sentences with small letters;
it does after dots and after what is suppressed. On top of these rules come suppressions by language: the stop of an abbreviation, an initial, an ordinal or a
step's number; and quotations or brackets that a longer sentence goes on after. In Thai, blanks separate sentences.

The language is the given one where it is known and fits the script; else the one of the script or, among those written in Latin letters, the
one with most function words in the text. Where none shows, the suppressions of all of them hold.
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

# Per language abbreviations whose stop never ends a sentence (titles and what leads on to the next word).
LEADING = {
    "tr": "dr prof doç av sn uzm op yrd öğr arş gör mim müh ecz dt örn bkz krş çev haz ed hz alb yzb tel ltd vs mr mrs ms st cf",
    "en": "dr prof mr mrs ms messrs st ste sr eds ed approx fig figs eq sec vol ch e.g i.e cf viz al gen col lt sgt capt rev hon pres gov sen rep apt tel ltd vs ca",
    "de": "dr prof hr hrn fr frl dipl ing st vgl bzw ca z zb u i d.h z.b u.a i.d.r ggf evtl inkl zzgl sog geb gest str tel ltd vs ed op",
    "ru": "т тов гр им ул пл просп пр стр рис см напр др проф акад доц ред изд",
    "hi": "डॉ श्री श्रीमती प्रो पं कु",
    "ar": "د أ م",
}
# Abbreviations that can stand last; a capital after them begins a sentence.
TRAILING = {
    "tr": "vb vd şti a.ş jr no inc co corp m.ö m.s yy",
    "en": "etc inc co corp jr sr a.m p.m u.s u.k u.s.a no b a m jan feb mar apr jun jul aug sep sept oct nov dec dept est",
    "de": "usw etc co u.a h b a m nr bd abb tab jh jan feb mär apr jun jul aug sep sept okt nov dez mio mrd std min jr",
    "ru": "руб г гг д е п коп кг см мм мл л ст тыс млн млрд др ч мин сек",
}
# Abbreviations that lead on only before a number; those with a capital only written so.
BEFORE_NUMBER = {"tr": "no nr num s md madde №", "en": "no nos num p pp vol ch №", "de": "nr no s Art Abs Kap Bd Tab Abb №", "ru": "№ стр рис гл п ст т", "hi": "सं", "ar": "ص"}
# Words before an ordinal or the number of a step.
BEFORE_ORDINAL = {"de": "am der die das dem den des vom zum zur im beim bis seit ab jeder jede jedes jeden ihr ihre ihren sein seine"}
BEFORE_STEP = {"step", "adım", "adim", "schritt", "шаг", "part", "bölüm", "teil", "punkt", "pkt", "madde", "chapter", "kapitel"}
# Words after which an English "no." is an answer, not the sign for a number.
BEFORE_AN_ANSWER = set("said says say saying answered replied told is was be oh well and or but with a".split())
# Function words that tell languages of the Latin script apart.
FUNCTION_WORDS = {
    "tr": "ve bir bu için ile çok ama daha gibi değil sonra olarak kadar her ne de da mi mı ki en var yok ben sen o",
    "en": "the and of to in is it for with that this on was are as not but you my at by from have be so",
    "de": "der die das und ist nicht mit für auf ein eine ich es den dem zu von im sich auch wie aber war bei",
}
LANGUAGES = ("tr", "en", "de", "ru", "hi", "ar")
_LATIN = ("tr", "en", "de")
_SCRIPT_OF = {"ru": regex.compile(r"\p{Cyrillic}"), "hi": regex.compile(r"\p{Devanagari}"), "ar": regex.compile(r"\p{Arabic}"), **{x: regex.compile(r"\p{Latin}") for x in _LATIN}}
_TEXT_WORDS = re.compile(r"[^\W\d_]+")
_FUNCTION_WORDS = {x: frozenset(ws.split()) for x, ws in FUNCTION_WORDS.items()}


class _Rules:
    """The suppressions of some languages."""

    def __init__(self, languages: tuple[str, ...]):
        of = lambda table: frozenset(w for x in languages for w in table.get(x, "").split())
        self.leading, self.trailing, self.before_number, self.before_ordinal = of(LEADING), of(TRAILING), of(BEFORE_NUMBER), of(BEFORE_ORDINAL)
        self.english = "en" in languages


@lru_cache(maxsize=64)
def _rules(languages: tuple[str, ...]) -> _Rules:
    return _Rules(languages)


def languages_of(text: str, lang: str | None = None) -> tuple[str, ...]:
    """The languages whose suppressions hold for the text: mostly one."""
    given = (lang or "").strip().lower().replace("_", "-").split("-")[0]
    if given in LANGUAGES and _SCRIPT_OF[given].search(text):
        return (given,)
    if given and given not in LANGUAGES and given != "und" and not any(_SCRIPT_OF[x].search(text) for x in ("en", "ru", "hi", "ar")):
        return ()
    found = tuple(x for x in ("ru", "hi", "ar") if _SCRIPT_OF[x].search(text))
    if not _SCRIPT_OF["en"].search(text):
        return found
    ws = _TEXT_WORDS.findall(text.lower())
    n = {x: sum(w in f for w in ws) for x, f in _FUNCTION_WORDS.items()}
    best = max(n.values())
    return found + tuple(x for x in _LATIN if n[x] == best)


# Words that carry on after dots.
GOES_ON = set("ve ama fakat veya ya and but or then so yet und aber oder dann и но или а потом ancak sonra because weil".split())

OPENING = {"“": "”", "„": "“”", "«": "»", "»": "«", "‹": "›", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "{": "}", "‘": "’", "‚": "‘’", "【": "】", "《": "》", "〈": "〉", '"': '"', "＂": "＂"}
BRACKETS = set("（([{【")
_CLOSING = "”“»«›」』）)]}’】》〉\"＂'"
#: Marks after which the sentence goes on (the class SContinue, but for the long dash, which opens speech), and a closing bracket.
_GOES_ON = regex.compile(r"[\p{Sentence_Break=SContinue})--—]", regex.V1)
_LINES = re.compile(r"[^\n\r\x0b\x0c\x85  ]+")
#: Full stops and other end marks of all scripts (the classes ATerm and STerm), and the ellipsis.
_MARKS = regex.compile(r"[\p{Sentence_Break=ATerm}\p{Sentence_Break=STerm}…⋯]+")
_FULL_WIDTH = set("。！？｡．｡‼⁇⁈⁉।॥")
_TOKEN = regex.compile(r"[\p{Sentence_Break=ATerm}\p{Sentence_Break=STerm}…⋯]+|[“”„«»‹›「」『』（）()\[\]{}‘’‚【】《》〈〉\"＂]|(?<=\p{Thai}[\p{M}]?)[^\S\n]+(?=\p{Thai})")
_PICTURES = regex.compile(r"(?:[^\S\n]*(?:(?![©®™0-9#*])\p{Extended_Pictographic}|\p{Emoji_Modifier}|\p{Regional_Indicator})[\p{Emoji_Modifier}️︎‍♀♂\U000e0020-\U000e007f]*)+")
_UNSEEN = regex.compile(r"[\p{Cf}️]+")
_WORD_NEXT = regex.compile(r"[^\p{L}\p{N}]*([\p{L}\p{M}]*)")
_NUMERIC = re.compile(r"[\d.,]*\d[\d.,]*")
_IN_WORD = regex.compile(r"[\p{L}\p{M}\p{N}.№]")
_THAI = regex.compile(r"\p{Thai}")


def _closes(opened: str, c: str) -> bool:
    return c in OPENING[opened]


class _Line:
    """One line of a text, from a to b."""

    def __init__(self, text: str, a: int, b: int, lower: bool, rules: _Rules):
        self.text, self.a, self.b, self.lower, self.rules = text, a, b, lower, rules
        self.last: dict[str, int] = {}  # where each closing stands last on the line

    def _first(self, at: int) -> int:
        while at < self.b and self.text[at].isspace():
            at += 1
        return at

    def split(self) -> Iterator[tuple[int, int]]:
        text, b = self.text, self.b
        start = self.a
        first = self._first(start)  # where the sentence's first character is
        opened: list[tuple[str, bool]] = []  # what is open, and whether it began the sentence
        skip = self.a
        for m in _TOKEN.finditer(text, self.a, b):
            if m.start() < skip:
                continue
            t = m[0]
            if t.isspace():
                if not opened:
                    yield start, m.start()
                    start = skip = m.end()
                    first = self._first(start)
                continue
            if not _MARKS.match(t):
                if opened and _closes(opened[-1][0], t):
                    opened.pop()
                elif t in OPENING and self._is_closed(t, m.end()):
                    opened.append((t, m.start() <= first))
                continue
            end, outer = m.end(), None
            while end < b:
                c = text[end]
                if c == " " or c.isalnum():
                    break
                if opened and _closes(opened[-1][0], c):
                    outer = opened.pop()
                elif not opened and outer is None and c in _CLOSING and c not in "“«„'\"" and c not in OPENING:
                    pass  # closes what was never opened
                elif (u := _UNSEEN.match(text, end, b)) or (u := _MARKS.match(text, end, b)):
                    end = u.end()
                    continue
                else:
                    break
                end += 1
            skip = end
            if opened:
                continue
            if outer is not None:
                if not self._ends_after_quote(outer, end):
                    continue
            elif not self._ends(t, start, m.start(), end):
                continue
            p = self._picture(end)
            if p:
                end = p.end()
                u = _UNSEEN.match(text, end, b)
                end = u.end() if u else end
            yield start, end
            start = skip = end
            first = self._first(start)
        yield start, b

    def _is_closed(self, c: str, at: int) -> bool:
        for x in OPENING[c]:
            if x not in self.last:
                self.last[x] = self.text.rfind(x, self.a, self.b)
        return any(self.last[x] >= at for x in OPENING[c])

    def _picture(self, at: int) -> regex.Match | None:
        """The pictures that begin here, perhaps after blanks."""
        text, b, i = self.text, self.b, at
        while i < b and text[i] == " ":
            i += 1
        return _PICTURES.match(text, at, b) if i < b and text[i] > "\u00a0" else None

    def _next(self, at: int) -> str:
        """The next character that is not blank, unseen or a picture."""
        text, b = self.text, self.b
        while at < b:
            if text[at].isspace():
                at += 1
            elif text[at].isalnum():
                return text[at]
            elif m := _PICTURES.match(text, at, b) or _UNSEEN.match(text, at, b):
                at = m.end()
            else:
                return text[at]
        return ""

    def _next_word(self, at: int) -> str:
        m = _WORD_NEXT.match(self.text, at, self.b)
        return m[1].lower() if m else ""

    def _ends_after_quote(self, outer: tuple[str, bool], end: int) -> bool:
        """Whether a quotation or bracket with an end mark inside ends the sentence, too."""
        kind, first = outer
        c = self._next(end)
        if not c:
            return True
        if kind in BRACKETS and not first:
            return False
        if self._picture(end):
            return True
        # a capital or an opening begins a new sentence; a small letter, one without case, a comma or a dash goes on
        return (c.isupper() or (c in OPENING and c not in BRACKETS)) and not self.lower

    def _ends(self, mark: str, start: int, at: int, end: int) -> bool:
        text, b = self.text, self.b
        if end >= b:
            return True
        after = text[end]
        if set(mark) & _FULL_WIDTH:
            return True
        glued = not (after.isspace() or self._picture(end))
        if glued and not (mark[-1] in "!?؟" and after.isupper() and not self.lower) and mark[0] != "…" and after not in OPENING:
            return mark[-1] not in ".!?" and not after.isalnum()
        if glued and mark[0] == "…" and not after.isupper():
            return False
        c = self._next(end)
        if not c:
            return True
        if "!" in mark or "?" in mark or "؟" in mark:
            return True
        if len(mark) > 1 and set(mark) == {"."}:
            return not c.islower() and not _GOES_ON.match(c)
        if mark[0] == "…":
            return self._next_word(end) not in GOES_ON and c not in ",;:"
        if mark != ".":
            return True
        return self._stop_ends(start, at, end, c)

    def _word_before(self, start: int, at: int) -> int:
        """Where the word or number that ends at `at` begins. A word ends at a blank, so over a line this takes its length."""
        text, i = self.text, at
        while i > start:
            c = text[i - 1]
            if c == "," and i < at and text[i].isdigit() and i - 2 >= start and text[i - 2].isdigit():
                pass
            elif not (c.isalnum() or c == "." or _IN_WORD.match(c)):
                break
            i -= 1
        return i

    def _stop_ends(self, start: int, at: int, end: int, c: str) -> bool:
        if _GOES_ON.match(c):
            return False
        text, rules = self.text, self.rules
        begin = self._word_before(start, at)
        if begin == at:
            return True
        word = _UNSEEN.sub("", text[begin:at])
        low = word.replace("İ", "i").lower()
        j = begin
        while j > start and text[j - 1].isspace():
            j -= 1
        i = j
        while i > start and not text[i - 1].isspace():
            i -= 1
        first, last = j == start, text[j - 1] if j > start else ""
        previous = text[i:j].lower().strip(".,;:!?(“„«\"")
        capital = c.isupper() and not self.lower
        if word.isdigit():
            if len(word) <= 3 and (first or last in ",;:(" or previous in BEFORE_STEP):
                return False
            return not (len(word) <= 2 and previous in rules.before_ordinal)
        if _NUMERIC.fullmatch(word):
            return True
        if c.isdigit() and (low in rules.before_number or word in rules.before_number):
            return rules.english and word == "no" and previous in BEFORE_AN_ANSWER
        letters = [x for x in low.split(".") if x]
        if len(word.rstrip(".")) == 1 and word[0].isalpha():
            # an initial, or a part of "d. h.": the next capital goes on after an initial
            if word.isupper() or low in rules.leading or self.lower:
                return False
            return low in rules.trailing and capital and len(previous) != 1
        if low in rules.leading:
            return False
        if low in rules.trailing or (len(letters) > 1 and all(len(x) == 1 for x in letters)):
            return capital and not (low == "co" and self._next_word(end) in ("kg", "ltd", "inc"))
        return True


def sentences(text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
    """(start, end) of every sentence, in order, without outer blanks; null, empty and blank texts have none."""
    if not text:
        return []
    lower = text == text.lower()
    rules = _rules(languages_of(text, lang))
    out = []
    for line in _LINES.finditer(text):
        for a, b in _Line(text, line.start(), line.end(), lower, rules).split():
            while a < b and text[a].isspace():
                a += 1
            while b > a and text[b - 1].isspace():
                b -= 1
            if a < b:
                # pictures or signs alone belong to what they follow on the line
                if out and out[-1][1] > line.start() and _only_marks(text[a:b]):
                    out[-1] = (out[-1][0], b)
                else:
                    out.append((a, b))
    return out


def _only_marks(piece: str) -> bool:
    return not any(ud.category(c)[0] in "LN" for c in piece)


def split_sentences(df: DataFrame, key: str, text: str, with_text: bool = True, lang: str | None = None) -> DataFrame:
    """key, sentence_no (from 1), start_pos, end_pos (code points, end exclusive) and, if asked for, sentence.

    lang: a column with the language; where it is null, unknown or does not fit the script the text tells. Null, empty and blank
    texts give no row; whole texts are read, whatever their length.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, n, x, y, t[x:y]) if with_text else (k, n, x, y) for k, t, g in zip(b["_k"], b["_t"], b["_g"]) for n, (x, y) in enumerate(sentences(t, g), 1)]
            yield pd.DataFrame(rows, columns=[key, "sentence_no", "start_pos", "end_pos", *(["sentence"] if with_text else [])])

    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"), (F.col(lang) if lang else F.lit(None)).cast("string").alias("_g"))
    return rows.mapInPandas(run, f"`{key}` {kind}, sentence_no long, start_pos long, end_pos long" + (", sentence string" if with_text else ""))
