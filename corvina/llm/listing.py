"""Reading the parts of a product listing: type, size, sun protection, strength, shade, `+` mark, and what is left.

Everything here works on folded text (consistent form, no case, no accents), so spelling variants meet.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache

from corvina.llm.lookalike import fold

# Product types and what else they are called (folded). More are mined from the data (vocabulary.py).
TYPES = {
    "yuz temizleme jeli": ["temizleyici jel", "cleansing gel", "yuz temizleyici jel", "yuz temizleme jel", "face wash"],
    "sampuan": ["shampoo", "sampuani"],
    "parfum": ["eau de parfum", "edp", "parfumu", "perfume"],
    "maskara": ["mascara", "rimel"],
    "tonik": ["toner", "tonik losyon"],
    "kil maskesi": ["clay mask", "kil maske"],
    "krem allik": ["cream blush", "krem allik"],
    "vucut losyonu": ["body lotion", "vucut losyon"],
    "serum": ["serumu", "konsantre serum", "concentrate serum"],
    "mat ruj": ["matte lipstick", "mat ruju"],
    "fondoten": ["foundation", "fondoteni"],
    "sac bakim yagi": ["hair oil", "sac yagi"],
    "nemlendirici krem": ["moisturizing cream", "nem kremi", "nemlendirici kremi", "moisturising cream"],
    "gunes kremi": ["sunscreen", "gunes koruyucu", "sun cream", "gunes koruyucu krem"],
    "el kremi": ["hand cream"], "dudak balmi": ["lip balm"], "far paleti": ["eyeshadow palette", "eye shadow palette"], "temizleyici kopuk": ["cleansing foam", "foam cleanser"],
    "gul suyu": ["rose water"], "temizleme sutu": ["cleansing milk"], "dis macunu": ["toothpaste"], "deodorant": ["deodorants", "roll on"], "goz kremi": ["eye cream"], "dus jeli": ["shower gel", "body wash"],
    "sac kremi": ["conditioner", "hair conditioner"], "sac maskesi": ["hair mask"], "micellar water": ["misel su", "micellar su"], "sabun": ["soap"], "kapatici": ["concealer"], "aydinlatici": ["highlighter"],
    "oje": ["nail polish", "nail lacquer"], "kas kalemi": ["eyebrow pencil", "brow pencil"], "goz kalemi": ["eye pencil", "eyeliner"], "kagit maske": ["sheet mask"], "makyaj bazi": ["primer", "makeup primer"],
    "dudak parlaticisi": ["lip gloss"], "pudra": ["powder", "face powder"], "tiras kopugu": ["shaving foam"], "vucut yagi": ["body oil"], "ayak kremi": ["foot cream"],
}
# Words of shops, not of the product (folded). More are mined from the data (vocabulary.py).
FILLER = [
    "hediyelik", "orijinal", "stokta", "kampanyali", "yeni", "new", "best seller", "cok satan", "sok fiyat", "hizli teslimat",
    "ucretsiz kargo", "%100 orijinal urun", "orijinal urun", "%100 orijinal", "resmi distributor garantili", "tum ciltler icin", "all skin types",
    "dermatolojik test edilmis", "vegan formul", "limited", "mini boy", "favorim", "duo", "bu", "indirimli", "set", "full size", "seyahat boy",
]
# Active ingredients and what else they are called (folded).
INGREDIENTS = {
    "niasinamid": ["niacinamide"], "salisilik asit": ["salicylic acid"], "azelaik asit": ["azelaic acid"], "seramid": ["ceramide"],
    "c vitamini": ["vitamin c"], "retinol": ["retinal"], "hyaluronik asit": ["hyaluronic acid"], "glikolik asit": ["glycolic acid"],
    "laktik asit": ["lactic acid"], "peptid": ["peptide"], "kafein": ["caffeine"], "cinko": ["zinc"], "arbutin": ["alpha arbutin"], "pantenol": ["panthenol"],
}
# What one unit is in millilitres or grams.
UNITS = {"ml": ("ml", 1.0), "cc": ("ml", 1.0), "cl": ("ml", 10.0), "lt": ("ml", 1000.0), "l": ("ml", 1000.0), "litre": ("ml", 1000.0), "floz": ("ml", 29.5735), "g": ("g", 1.0), "gr": ("g", 1.0), "gram": ("g", 1.0), "kg": ("g", 1000.0), "mg": ("g", 0.001), "oz": ("g", 28.3495)}
# Words that a brand may carry or leave out (folded).
BRAND_EXTRAS = {"official", "cosmetics", "kozmetik", "cosmetic", "beauty", "store", "shop", "resmi", "turkiye", "tm", "inc", "ltd"}


def _abbreviated(name: str) -> str:
    """How a name is cut short: three letters a word."""
    return " ".join(w[:3] for w in name.split())


_INGREDIENT_OF = {**{i: i for i in INGREDIENTS}, **{s: i for i, names in INGREDIENTS.items() for s in names}}


def _any(phrases) -> str:
    return "|".join(re.escape(p).replace(r"\ ", r"\s+") for p in sorted(phrases, key=len, reverse=True))


_NUMBER = r"(\d+(?:[.,]\d+)?)"
_SIZE = re.compile(rf"(?<![\w.,]){_NUMBER}\s*(fl\s*\.?\s*oz|ml|cc|cl|lt|litre|l|gram|gr|g|kg|oz)\b\.?(?:\s*\.)?")
_SPF = re.compile(r"\b(?:spf|gkf)\s*[-:]?\s*(\d+)\s*\+?|(?<![\w.,])(\d+)\s*\+?\s*(?:spf|gkf)\b")
_STRENGTH = re.compile(rf"(?:%\s*{_NUMBER}|(?<![\w.,]){_NUMBER}\s*%)\s*({_any(_INGREDIENT_OF)})\b|\b({_any(_INGREDIENT_OF)})\s*(?:%\s*{_NUMBER}|{_NUMBER}\s*%)")
_NAME = r"[^\W\d_][\w']*"
#: A shade's number with its name: after a word for shade, padded with a zero or with a hyphen the name follows, else it precedes.
_SHADE = re.compile(
    rf"\b(?:no|ton|nr|shade|renk)\b\s*\.?\s*:?\s*(?P<a>\d{{1,3}})\b(?:\s*\(\s*{_NAME}\s*\)|\s+{_NAME})?"
    rf"|(?<![\w.,%])(?P<b>\d{{1,3}})-{_NAME}|(?<![\w.,%])(?P<c>0\d{{2}})(?![\w%]|[.,]\d)(?:\s+{_NAME})?|(?:(?<![\w']){_NAME}\s+)?(?<![\w.,%])(?P<d>\d{{1,2}})(?![\w%]|[.,]\d)"
)
_WORDS = re.compile(r"[a-z0-9']+")
_DIGIT = re.compile(r"\d")
_CLEAN_FORM = re.compile(r"[^\W\d_][\w']*(?: [^\W\d_][\w']*)*\+?")


_GLUED_AND = re.compile(r"(?<=[^\W\d_])(?:ve|and)(?=[A-ZÇĞİÖŞÜ])")


class Vocabulary:
    """What types are called, and words of shops. types: other name (or itself) -> type, all folded; filler: phrases."""

    def __init__(self, types: dict[str, str], filler: Iterable[str]):
        self.types, self.filler = types, sorted(set(filler))
        # names of equal length in the order of the alphabet: the same expressions wherever they are built
        self.short = {_abbreviated(x): t for x, t in sorted(types.items(), reverse=True)}
        self.known = frozenset(types.values())
        self.names_of: dict[str, list[str]] = {}
        for x, t in types.items():
            self.names_of.setdefault(t, []).append(compact(x))
        self.type_re = re.compile(rf"(?<!\w)({_any(types)})(?!\w)" if types else r"(?!)")
        self.filler_re = re.compile(rf"(?<![\w%])(?:{_any(self.filler)})(?!\w)" if self.filler else r"(?!)")
        self.short_re = re.compile(rf"(?<!\w)({'|'.join(re.escape(x).replace(r'\ ', r'\.\s*') for x in sorted(self.short, key=lambda x: (-len(x), x)))})\.(?!\w)" if self.short else r"(?!)")

    def __reduce__(self):
        return Vocabulary, (self.types, self.filler)

    def more(self, types: dict[str, str], filler: Iterable[str] = ()) -> Vocabulary:
        """With further names; what is known already stays."""
        return Vocabulary({**types, **self.types}, [*self.filler, *filler])


@dataclass
class Listing:
    brand: str = ""  # folded words without extras
    kind: str | None = None
    size: str | None = None
    spf: str | None = None
    strength: str | None = None
    shade: str | None = None
    plus: bool = False
    line: str | None = None  # only of a cleanly written name
    rest: list[str] = field(default_factory=list)  # words that no part accounts for, in order


def compact(text: str) -> str:
    return "".join(_WORDS.findall(text)).replace("'", "")


#: A name is read and then looked at whole, one after the other.
folded = lru_cache(maxsize=2)(fold)


@lru_cache(maxsize=1 << 14)
def fold_brand(brand: str | None) -> str:
    """Brand words without extras; `&`, `ve`, `and` and the sign at a handle say nothing."""
    ws = _WORDS.findall(fold(_GLUED_AND.sub(" ", brand or "")).replace("™", " ").replace("®", " "))
    kept = [w.replace("'", "") for w in ws if w not in BRAND_EXTRAS and w not in ("ve", "and")]
    return " ".join(w for w in kept if w)


def size_of(number: str, unit: str) -> str:
    base, factor = UNITS[re.sub(r"[\s.]", "", unit)]
    x = float(number.replace(",", ".")) * factor
    if "oz" in unit:  # rounded by the shop: the metric size it stands for is a whole number, from 13 on a multiple of 5
        x = round(x / 5) * 5 if x >= 13 else round(x)
    return f"{round(x, 2):g}{base}"


def _clean_line(text: str, found: Listing, vocabulary: Vocabulary) -> str | None:
    """The line of a cleanly written name: line, type, size, then at most one more part, and nothing else."""
    if not (found.kind and found.size):
        return None
    head, _, tail = text.partition(kind[1] if (kind := vocabulary.type_re.search(text)) and kind[1] in vocabulary.known else "\x02")
    head = head.strip()
    return head if _CLEAN_FORM.fullmatch(head) and re.fullmatch(rf"\s*\x00(?:\s*\x00|\s+\d{{1,3}} {_NAME})?\s*", tail) else None


def read(brand: str | None, name: str | None, vocabulary: Vocabulary | None = None) -> Listing:
    """The parts of a listing. Null and empty names give an empty listing."""
    v = vocabulary or SEED
    out = Listing(brand=fold_brand(brand))
    text = folded(name).replace("™", " ").replace("®", " ")
    if not text.strip():
        return out
    taken: list[str] = []

    def take(pattern: re.Pattern, text: str, once: bool = True) -> tuple[str, re.Match | None]:
        m = pattern.search(text)
        if not m:
            return text, None
        taken.append(m[0])
        return text[: m.start()] + " \x00 " + text[m.end() :], m

    text = re.sub(r"(\w)['’](\w)", r"\1'\2", text)
    # most names have no number, and a search for nothing costs as much as one for something
    digits = _DIGIT.search(text) is not None
    m = None
    if digits and "%" in text:
        text, m = take(_STRENGTH, text)
    if m:
        number, what = (m[1] or m[2], m[3]) if m[3] else (m[5] or m[6], m[4])
        out.strength = f"{float(number.replace(',', '.')):g}% {_INGREDIENT_OF[re.sub(r'\s+', ' ', what)]}"
    m = None
    if digits:
        text, m = take(_SPF, text)
    if m:
        out.spf = m[1] or m[2]
    m = None
    if digits:
        text, m = take(_SIZE, text)
    if m:
        out.size = size_of(m[1], m[2])
    clean = text
    text = v.filler_re.sub(" \x01 ", text)
    text, m = take(v.type_re, text)
    if m:
        out.kind = v.types[re.sub(r"\s+", " ", m[1])]
    elif "." in text:
        text, m = take(v.short_re, text)
        if m:
            out.kind = v.short[re.sub(r"[.\s]+", " ", m[1]).strip()]
    trusted = _clean_line(clean, out, v) if "\x01" not in text else None
    if trusted:  # here the shade is the last part, its number first
        m = re.search(rf"(\d{{1,3}}) {_NAME}\s*$", clean)
        out.shade = str(int(m[1])) if m else None
        out.plus, out.line = trusted.endswith("+"), trusted.rstrip("+")
        out.rest = out.line.split()
        return out
    m = None
    if digits:
        text, m = take(_SHADE, text)
    if m:
        out.shade = str(int(m["a"] or m["b"] or m["c"] or m["d"]))
    out.plus = bool(re.search(r"\w\+(?!\w)", text))
    out.rest = [w for w in _WORDS.findall(text.replace("&", " ")) if len(w) > 1 or w.isalpha()]
    return out


SEED = Vocabulary({**{t: t for t in TYPES}, **{s: t for t, names in TYPES.items() for s in names}}, FILLER)
