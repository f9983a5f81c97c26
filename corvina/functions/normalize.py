"""Text normalizers. They are not interchangeable: their outputs are join keys.

Each is a chain of small steps, named below; a chain becomes a column function that works on Arrow batches. There is no
built-in for case folding or compatibility decomposition, so this is the one place where text goes through Python; callers
filter and block before, and materialize the result where it is used more than once.
"""

from __future__ import annotations

import html
import re
import unicodedata as ud
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Step = Callable[[str], str]

# Turkish letters and their plain forms; ligatures.
_TURKISH = str.maketrans("ıİşŞğĞüÜöÖçÇ", "iissgguuoocc")
_LIGATURES = str.maketrans({"ı": "i", "œ": "oe", "æ": "ae"})
_QUOTES = str.maketrans({"‘": "'", "’": "'", "‚": "'", "“": '"', "”": '"', "„": '"', "–": "-", "—": "-", "−": "-"})
# What captions put in square brackets for sounds; the longest file name, and the one of nothing.
SOUND_TAGS = ("müzik", "music", "alkış", "applause", "gülüşmeler", "laughter", "kahkaha", "ses", "sound", "sessizlik", "silence")
FILE_NAME_LENGTH, NO_NAME = 140, "untitled_video"


def _sub(pattern: str, by: str) -> Step:
    p = re.compile(pattern)
    return lambda s: p.sub(by, s)


def turkish(s: str) -> str:
    return s.translate(_TURKISH)


def ligatures(s: str) -> str:
    return s.translate(_LIGATURES)


def unmarked(s: str) -> str:
    """Compatibility decomposition without combining marks."""
    return s if s.isascii() else "".join(c for c in ud.normalize("NFKD", s) if not ud.combining(c))


def compatible(s: str) -> str:
    return s if s.isascii() else ud.normalize("NFKC", s)


def squeezed(s: str) -> str:
    return " ".join(s.split())


def only(kept: str) -> Step:
    return _sub(rf"[^{kept}]+", " ")


folded: Step = str.casefold

CHAINS: dict[str, tuple[Step, ...]] = {
    "identity": (turkish, unmarked, folded, squeezed),
    "search": (turkish, unmarked, only("a-zA-Z0-9%+"), folded, squeezed),
    "link": (turkish, unmarked, only("a-zA-Z0-9"), folded, squeezed),
    "plain": (folded, ligatures, unmarked, only("a-z0-9"), squeezed),
    "display": (folded, unmarked, ligatures, only("a-z0-9"), squeezed),
    "image": (unmarked, folded, only("a-z0-9"), squeezed),
    "audit": (compatible, folded, unmarked, only("a-z0-9%+"), squeezed),
    "caption": (str.strip, folded, compatible, _sub(r"https?://\S+", " "), _sub("#", " "), _sub(r"@\w+", " "), _sub(r"^\s*replying\s+to\s+", " "), _sub(r"[^\w]+", " "), squeezed),
    "evidence_tokens": (folded, unmarked, only("a-z0-9"), squeezed),
    "dedupe": (folded, squeezed, lambda s: s.strip(" :;,.-–—")),
    "evidence": (compatible, squeezed, folded),
    "typographic": (compatible, lambda s: s.translate(_QUOTES), squeezed, folded),
    "keyword": (html.unescape, folded, squeezed),
    "transcript": (html.unescape, _sub("<[^>]+>", " "), _sub(rf"(?i)\[\s*(?:{'|'.join(SOUND_TAGS)})\s*\]", " "), _sub("[♪♫]", " "), squeezed),
    "brand": (str.strip, lambda s: s.lstrip("@"), str.strip),
    "filename": (html.unescape, _sub(r'[<>:"/\\|?*]', " "), squeezed, lambda s: (s.rstrip(". ") or NO_NAME)[:FILE_NAME_LENGTH].strip()),
}


def normalized(value: str | None, chain: str) -> str:
    """The value through a chain; null gives the empty string."""
    s = value or ""
    for step in CHAINS[chain]:
        s = step(s)
    return s


def normalize(column: Column | str, chain: str) -> Column:
    """The column through a chain, in Arrow batches; repeated values of a batch are worked out once."""
    steps = CHAINS[chain]

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        codes, uniques = pd.factorize(values.fillna(""))
        out = []
        for s in uniques:
            for step in steps:
                s = step(s)
            out.append(s)
        return pd.Series(out, dtype=object).take(codes).reset_index(drop=True)

    return run(F.col(column) if isinstance(column, str) else column)


def position_map(value: str | None) -> tuple[str, list[int]]:
    """Compatible folded text, character by character, with the source position of every character of the result."""
    out, where = [], []
    for i, c in enumerate(value or ""):
        for d in ud.normalize("NFKC", c).casefold():
            if d == "\u0307" and out and out[-1] == "i":
                continue
            out.append(d)
            where.append(i)
    return "".join(out), where
