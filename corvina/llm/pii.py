"""Personal information inside free text: e-mail and street addresses, phone, identity, card and account numbers, names.

Regular expressions propose spans with a score by shape, checksums confirm or refute them (Luhn for cards, mod-97 for IBANs,
the check digits of identity numbers), words nearby raise or lower the score; what reaches ACCEPT counts. A card number counts only
with a valid checksum, as nothing else tells it from an order number; other numbers of the usual shape also without, a
mistyped one is personal, too. Overlapping spans: the higher score wins, then the longer, then the earlier.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACCEPT = 0.5
MAX_NAMES = 1_000_000
KINDS = ("email", "phone", "national_id", "address", "person_name", "card", "iban")
#: How many characters before and after a number or a name are searched for words that say what it is.
BEFORE, AFTER, BEFORE_NAME = 35, 30, 40

# ---- e-mail: plain, with blanks, full-width, or spelled out
_AT = r"(?:[@＠]|[^\S\n][@＠][^\S\n]|\s?[\[({]\s?(?:at|@|et)\s?[\])}]\s?)"
_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|nokta|punkt|\.)\s?[\])}]\s?|\s(?:dot|nokta|punkt)\s)"
_LOCAL = r"(?<![\w.+@＠-])[\w][\w.+-]*?"
_LABEL = r"[^\W_](?:[\w-]*[^\W_])?"
_EMAIL = re.compile(rf"{_LOCAL}{_AT}{_LABEL}(?:{_DOT}{_LABEL})+(?![\w@])", re.I)
_EMAIL_WORDS = re.compile(rf"{_LOCAL}\s(?:at|et)\s{_LABEL}(?:(?:\.|\s(?:dot|nokta|punkt)\s){_LABEL})*\s(?:dot|nokta|punkt)\s{_LABEL}(?![\w@])", re.I)

# ---- numbers
_NUMBER = re.compile(r"(?<![\w@.,:/#-])(?:\+\s?|\()?\(?\d(?:(?:[^\S\n]|[./-]|[^\S\n]?\(|\)[^\S\n]?|\)[./-])?\d){6,17}(?![\w@]|[.,:/-]\d)")
_IBAN = re.compile(r"(?<![\w])[A-Z]{2}\d{2}(?:[ -]?[A-Z0-9]{4}){2,7}(?:[ -]?[A-Z0-9]{1,3})?(?!\w)", re.I)
_NINO = re.compile(r"(?<!\w)[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D](?!\w)", re.I)
# Groupings of ten digits without a prefix that are written for phones, and of identity numbers.
_PHONE_GROUPS = {(10,), (3, 3, 4), (3, 3, 2, 2), (3, 7), (4, 3, 3), (4, 6), (2, 4, 4)}
_ID_GROUPS = {(11,), (3, 3, 3, 2), (2, 3, 3, 3), (3, 4, 4), (1, 3, 3, 4), (5, 6), (4, 4, 3)}
_CARD_GROUPS = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3), (4, 4, 4, 1), (16,)}
# Words beside a number.
_FOR_IBAN = re.compile(r"iban|hesap|account|konto|bank", re.I)
_FOR_CARD = re.compile(r"kart|card|karte|visa|master|amex|карт", re.I)
_FOR_ID = re.compile(r"kimlik|t\.?\s?c\.?\s?(?:k|no|$)|tckn|\bssn\b|social security|\bnino?\b|national insurance|\bid\s*(?:no|number|nr)|ausweis|steuer-?id|passport|pasaport|vatandaş", re.I)
_FOR_PHONE = re.compile(r"\btel\b|telefon|phone|\bcall\b|\btext\b|\bfax\b|whats?app|randevu|(?<!kimlik )numara|ara(?:yın|yabilir)|hatt|\bgsm\b|\bcep\b|anruf|mobil|ulaş|iletişim", re.I)
_AGAINST = re.compile(r"sipariş|order|barkod|barcode|\bean\b|\blot\b|kargo|takip no|tracking|stok|fiyat|price|\bkod\b|\bcode\b|seri|bölüm|son kullanma|iban|€|\bTL\b", re.I)

# ---- street addresses
_W = r"[^\W\d_][\w'’-]*+"
_STREET = r"(?:caddesi|cadde|cad\.?|cd\.?|sokağı|sokak|sok\.?|sk\.?|bulvarı|bulvar|blv\.?|bul\.?|mahallesi|mahalle|mah\.?|mh\.?|meydanı|yolu)"
_DOOR = r"(?:no[^\S\n]?[:.]?[^\S\n]?\d+(?:[^\S\n]?/[^\S\n]?\d+)?\w?|(?:d|daire|kat|k|apt|blok)[^\S\n]?[:.]?[^\S\n]?\d+\w?|\d+(?:/\d+)?[a-z]?)"
_TOWN = rf"(?:\d{{5}}[^\S\n]+{_W}(?:[^\S\n]?/[^\S\n]?{_W})?|{_W}[^\S\n]+\d{{5}}|{_W}[^\S\n]?/[^\S\n]?{_W}|{_W})"
_ADDRESS = [
    re.compile(rf"(?<![\w'’-]){_W}[^\S\n]+{_STREET}(?![\w])(?:,?[^\S\n]+{_W}[^\S\n]+{_STREET}(?!\w))*(?:,?[^\S\n]*{_DOOR})+(?:,[^\S\n]*|[^\S\n]+){_TOWN}", re.I),
    re.compile(rf"(?<![\w/,.])(?:(?:apt|flat|unit|suite)\.?[^\S\n]*\d+\w?,[^\S\n]*)?\d{{1,5}}\w?[^\S\n]+{_W}(?:[^\S\n]+{_W})?[^\S\n]+(?:lane|avenue|street|road|drive|court|square|terrace|boulevard|crescent|ave\.?|rd\.?|ln\.?|blvd\.?)(?!\w),?[^\S\n]+{_TOWN}", re.I),
    re.compile(rf"(?<![\w-])(?:[^\W\d_][\w-]*(?:straße|strasse|str\.|weg|platz|gasse|allee|ring|damm)|{_W}[^\S\n]+(?:straße|strasse|str\.|weg|platz|allee))[^\S\n]+\d+[^\S\n]?[a-z]?,?[^\S\n]+\d{{5}}[^\S\n]+{_W}", re.I),
]

# ---- names
# Phrases after which a name stands: those that announce nothing else, and those that often do; what follows a
# name; titles; usual endings of family names.
_ANNOUNCES = r"\b(?:ad[ıi]m|ismim|ad[ıi]\s?soyad[ıi]|my name is|my name['’]s|name\s?(?=:)|i am called|mein name ist|ich hei(?:ß|ss)e|меня зовут|je m['’]appelle|me llamo)"
_CREDITS = (
    r"\b(?:ben|i am|i['’]m|this is|ich bin|это|foto(?:ğraf)?(?: için)?|bu videoyu|kurgu|çekim|photo(?:graphy)? by|photo credit|hair by|make-?up by|filmed by|edited by|written by|directed by|interview with|"
    r"sevgiyle|sevgiler|saygılarımla|teşekkürler|thanks to|thank you|danke an|contact|kontakt|iletişim|çekilişi|kazanan|winner|alıcı|gönderen|yetkili|yaşarsanız|love|regards|sincerely|gruß|grüße|dear|liebe[r]?|sevgili)"
    r"|(?<![#@])\b(?:makyaj|saç|foto)(?=:)"
)
_BEFORE = re.compile(rf"(?:{_ANNOUNCES}|{_CREDITS})\s*[:,]?\s*$", re.I)
_STRONG = re.compile(rf"{_ANNOUNCES}\s*[:,]?\s*$", re.I)
_TITLES = r"\b(?:dr|prof|doç|av|uzm|op|dt|ecz|mr|mrs|ms|herr|frau|sayın|sn)\.?\s*"
_TITLE = re.compile(rf"(?:{_TITLES})+$", re.I)
_CUE_ENDS = re.compile(rf"(?:{_ANNOUNCES}|{_CREDITS})\s*[:,]?\s*|{_TITLES}", re.I)
_AFTER = re.compile(r"^(?:['’]\w+)?\s*(?:,\s*)?(?:hanım|bey\b|ile (?:birlikte|canlı)|kazandı|and this is my|yıllardır|schreibt|\(|tel\b|['’](?:a|e|ya|ye|ın|in|ı|i|la|le)\b)", re.I)
_FAMILY = re.compile(r"(?:oğlu|oglu|soy|gil|man|han|ler|lar|er|sen|son|berg|well|ova|ov|kan|türk|stein|mann|ski|feer|kaya|demir|ton|ford)$", re.I)
# Goods after which a brand or a line is called.
_PRODUCT_AFTER = re.compile(r"^\s*(?:ruj|palet|serum|blush|krem|kremi|toner|tonik|maske|maskara|far|set|jel|paleti|koleksiyonu?|losyon|şampuan|parfüm|cream|lotion|shampoo|perfume|lipstick|mascara|mask|palette|gel|oil|creme|maske)(?!\w)", re.I)
_FIRST = re.compile(r"(?<![\w@#.＠])(?:[^\W\d_]{2,}|[^\W\d_]\.)")
_NAME = re.compile(r"(?<![\w@#.＠])(?:[^\W\d_]{2,}|[^\W\d_]\.)(?: [^\W\d_]{2,}){1,2}(?![\w@])")


def luhn(digits: str) -> bool:
    total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def mod97(text: str) -> bool:
    """IBAN: country and check digits to the end, letters as numbers, remainder 1."""
    s = re.sub(r"\W", "", text).upper()
    return len(s) > 14 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def valid_tckn(digits: str) -> bool:
    """Turkish identity number: two check digits after nine."""
    if len(digits) != 11 or digits[0] == "0":
        return False
    d = [int(c) for c in digits]
    return (7 * sum(d[0:9:2]) - sum(d[1:8:2])) % 10 == d[9] and sum(d[:10]) % 10 == d[10]


def _lower(text: str) -> str:
    return text.replace("İ", "i").replace("I", "ı").lower()


class Finder:
    """Finds spans in a text. names: given names in use (the list need not be complete)."""

    def __init__(self, names: Iterable[str] = ()):
        self.names = {x for n in names if n for x in (_lower(n), n.lower().replace("i̇", "i"))}

    def _given(self, word: str) -> bool:
        return _lower(word) in self.names or word.lower().replace("i̇", "i") in self.names

    def find(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """(start, end, kind, score), in order, without overlaps; null and empty texts have none."""
        if not text:
            return []
        got = [*self._emails(text), *self._numbers(text), *self._addresses(text), *self._names(text)]
        kept: list[tuple[int, int, str, float]] = []  # in order of place
        for s in sorted((g for g in got if g[3] >= ACCEPT), key=lambda g: (-g[3], g[0] - g[1], g[0])):
            i = bisect_left(kept, s)
            if (i == 0 or kept[i - 1][1] <= s[0]) and (i == len(kept) or kept[i][0] >= s[1]):
                kept.insert(i, s)
        return kept

    @staticmethod
    def _emails(text: str):
        if re.search(r"[@＠]|\b(?:at|et)\b", text, re.I):
            for pattern in (_EMAIL, _EMAIL_WORDS):
                for m in pattern.finditer(text):
                    local = re.split(_AT + r"|\s(?:at|et)\s", m[0], maxsplit=1, flags=re.I)[0]
                    yield m.start(), m.end(), "email", 1.2 if local.isascii() else 1.0

    @staticmethod
    def _numbers(text: str):
        for m in _NINO.finditer(text):
            near = text[max(0, m.start() - BEFORE) : m.start()]
            yield m.start(), m.end(), "national_id", 0.6 + 0.3 * bool(_FOR_ID.search(near))
        for m in _IBAN.finditer(text):
            near = text[max(0, m.start() - BEFORE) : m.start()]
            yield m.start(), m.end(), "iban", 0.2 + 0.8 * mod97(m[0]) + 0.3 * bool(_FOR_IBAN.search(near))
        for m in _NUMBER.finditer(text):
            start, end = m.span()
            # a number that follows after a blank may have been taken in: the longest beginning that is a number counts
            while end > start:
                got = Finder._number(text, start, end)
                if got:
                    yield got
                    break
                shorter = re.match(r"(.*\d)[^\S\n]\D*\d+$", text[start:end])
                end = start + len(shorter[1]) if shorter else start

    @staticmethod
    def _number(text: str, start: int, end: int):
        raw = text[start:end]
        if "(" in raw and ")" not in raw:
            if raw[0] != "(":
                return None
            raw, start = raw[1:], start + 1
        digits = re.sub(r"\D", "", raw)
        groups = tuple(map(len, re.findall(r"\d+", raw)))
        last, after = text[max(0, start - BEFORE) : start].rsplit("\n", 1)[-1], text[end : end + AFTER].split("\n")[0]
        # the nearest word before the number says most
        at = {k: max((x.end() for x in p.finditer(last)), default=-1) for k, p in (("id", _FOR_ID), ("phone", _FOR_PHONE), ("against", _AGAINST))}
        id_word = at["id"] > max(at["against"], at["phone"])
        phone_word = at["phone"] > max(at["against"], at["id"]) or bool(_FOR_PHONE.search(after))
        against = at["against"] > max(at["id"], at["phone"], len(last) - 22)
        n, as_id, as_phone = len(digits), 0.0, 0.0
        if 13 <= n <= 19 and digits[0] in "23456" and min(groups) > 1 and luhn(digits) and "+" not in raw and "(" not in raw:
            # a bar code can be valid by chance: card-like grouping or a word for it must agree
            as_card = 0.35 + 0.35 * (groups in _CARD_GROUPS) + 0.35 * bool(_FOR_CARD.search(last)) - 0.3 * against
            if as_card >= ACCEPT:
                return start, end, "card", as_card
        if groups == (3, 2, 4):
            as_id = 0.6
        elif n == 11 and groups in _ID_GROUPS and "+" not in raw and "(" not in raw:
            as_id = (0.45 if digits[0] != "0" else 0.2) + 0.5 * valid_tckn(digits)
        if raw.lstrip("(").startswith("+") and 9 <= n <= 15:
            as_phone = 0.8
        elif digits.startswith("00") and 12 <= n <= 15:
            as_phone = 0.75
        elif digits.startswith("0") and not digits.startswith("00") and 10 <= n <= 12:
            as_phone = 0.6
        elif n == 10 and groups in _PHONE_GROUPS and digits[0] in "2345678":
            as_phone = 0.5
        elif n == 7 and groups in {(3, 4), (3, 2, 2)}:
            as_phone = 0.2
        as_id += 0.4 * id_word * bool(as_id) - 0.5 * against
        as_phone += 0.3 * phone_word * bool(as_phone) - 0.45 * against - 0.4 * id_word
        if max(as_id, as_phone) < ACCEPT:
            return None
        return (start, end, "national_id", as_id) if as_id >= as_phone else (start, end, "phone", as_phone)

    @staticmethod
    def _addresses(text: str):
        for pattern in _ADDRESS:
            for m in pattern.finditer(text):
                yield m.start(), m.end(), "address", 0.95

    def _names(self, text: str):
        """A name begins with a given name in use, an initial, or right after a word that announces one."""
        starts = {m.end() for m in _CUE_ENDS.finditer(text)}
        at = 0
        for w in _FIRST.finditer(text):
            start = w.start()
            if start < at or not (start in starts or w[0][-1] == "." or self._given(w[0])):
                continue
            if (m := _NAME.match(text, start)) and (got := self._name_at(text, m)):
                yield got
                at = got[1]

    def _name_at(self, text: str, m: re.Match):
        words = m[0].split(" ")
        start = m.start()
        before = text[max(0, start - BEFORE_NAME) : start]
        title = _TITLE.search(before)
        said = before[: title.start()] if title else before
        cue = bool(title) or bool(_BEFORE.search(said))
        strong = cue and bool(_STRONG.search(said))
        first = words[0]
        if not cue and not self._given(first) and not first.endswith("."):
            return None
        if _lower(first).rstrip(".") in _NOT_NAMES or any(_lower(w) in _NOT_NAMES for w in words[1:2]):
            return None
        if _TITLE.fullmatch(first + " ") and first.endswith("."):
            return None
        # how many words: initial or given name, perhaps a second given name, the family name
        n = 2
        if len(words) == 3 and not _lower(words[2]) in _NOT_NAMES and words[2][0].isupper() == words[1][0].isupper():
            two, three = (text[start + len(" ".join(words[:k])) :][:30] for k in (2, 3))
            if _FAMILY.search(words[2]) and (self._given(words[1]) or not _FAMILY.search(words[1]) or (_AFTER.match(three) and not _AFTER.match(two))):
                n = 3
        words = words[:n]
        if words[0][0].isupper() != words[-1][0].isupper():
            return None  # a word of the sentence
        end = start + len(" ".join(words))
        after = text[end : end + 30]
        family = words[-1]
        upper = all(w[0].isupper() for w in words)
        score = 0.45 * self._given(first) + 0.3 * first.endswith(".") * upper + (0.45 if strong else 0.35) * cue + 0.25 * bool(_FAMILY.search(family)) + 0.15 * bool(_AFTER.match(after)) + 0.1 * upper
        if not upper:
            score -= 0.1
        if _PRODUCT_AFTER.match(after) or _PRODUCT_AFTER.match(" " + family):
            score -= 0.6
        if len(first.rstrip(".")) == 1 and not cue:
            score -= 0.3
        if not cue and not (self._given(first) and _FAMILY.search(family)):
            score -= 0.4
        return (start, end, "person_name", min(score, 0.94)) if score >= ACCEPT else None


# Function words, pronouns, greetings and times of day that follow a cue or a given name without being a name.
_NOT_NAMES = set("""ile ve veya da de mi mu ki bu şu o bir için gibi kadar çok daha tüm her sabah öğlen öğle akşam gece hafta gün bugün yarın dün iyi günaydın merhaba selam hanım bey beni bana bize seni sana size onu ona
herkes herkese hepinize hepimize olan oldu var yok ne nasıl birlikte canlı bende sende
the a an and or but my your his her our their this that these those is are was were has have had for by with from to of on in at as it its i you he she we they me him us so not no yes next last new first morning evening night day week
der die das ein eine und oder aber mein meine dein ihr sein für mit und nach von zu im am auf ist sind war hat haben ich du er sie es wir nicht tag woche morgen abend""".split())


def find_personal(df: DataFrame, key: str, text: str, names: DataFrame | None = None, name: str = "name") -> DataFrame:
    """key, start_pos, end_pos (code points, end exclusive), pii_type, score: one row per span.

    Null and empty texts give no row; a key that occurs twice gives its spans twice. names: a column of given names, at
    most MAX_NAMES (checked; it is broadcast), nulls ignored. Whole texts are read, whatever their length.
    """
    shared = _shared_names(df, names, name)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(shared.value)
        for b in batches:
            rows = [(k, *s) for k, t in zip(b["_k"], b["_t"]) for s in finder.find(t)]
            yield pd.DataFrame(rows, columns=[key, "start_pos", "end_pos", "pii_type", "score"])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("_k"), F.col(text).alias("_t")).mapInPandas(run, f"`{key}` {kind}, start_pos long, end_pos long, pii_type string, score double")


def redact(text: str | None, spans: list[tuple[int, int, str, float]]) -> str | None:
    if text is None:
        return None
    out, end = [], 0
    for a, b, kind, _ in spans:
        out += [text[end:a], f"[{kind.upper()}]"]
        end = b
    return "".join([*out, text[end:]])


def redact_personal(df: DataFrame, key: str, text: str, names: DataFrame | None = None, name: str = "name") -> DataFrame:
    """key, redacted (text with [EMAIL], [PHONE], ... in place of each span; null stays null) and spans, their number."""
    shared = _shared_names(df, names, name)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(shared.value)
        for b in batches:
            found = [finder.find(t) for t in b["_t"]]
            yield pd.DataFrame({key: b["_k"], "redacted": [redact(t, s) for t, s in zip(b["_t"], found)], "spans": [len(s) for s in found]})

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("_k"), F.col(text).alias("_t")).mapInPandas(run, f"`{key}` {kind}, redacted string, spans int")


def _shared_names(df: DataFrame, names: DataFrame | None, name: str):
    got = [] if names is None else [r[0] for r in names.select(name).distinct().limit(MAX_NAMES + 1).collect()]
    if len(got) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} given names")
    return df.sparkSession.sparkContext.broadcast(got)
