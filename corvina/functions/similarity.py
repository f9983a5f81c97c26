"""Sequence similarity, token coverage and search scores.

The ratio is Ratcliff-Obershelp with its habit of ignoring frequent letters of long second texts; no built-in gives the same
numbers, so it is worked out in Arrow batches. Bounds that need no alignment (equality, lengths) come first and stay in the
plan: see ratio_can_reach.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvina.functions.normalize import normalize

# Score bounds of the search.
NEAR, FAR, FAR_WORTH = 0.86, 0.74, 0.65
# What a product is also searched by; words in its text, and its category.
ALIASES_BY_WORD = [
    (["sun cream", "suncream", "sunscreen", "sun screen", "sun protection", "spf"], ["gunes kremi", "gunes koruyucu", "gunes krem", "sun crema", "sun creme"]),
    (["moisturizer", "moisturising", "moisturizing", "hydrating"], ["nemlendirici", "nemlendirici krem"]),
    (["cleanser", "cleansing", "wash"], ["temizleyici", "yuz temizleyici"]),
    (["serum"], ["serum"]),
]
ALIASES_BY_CATEGORY = {"makeup": ["makyaj urunu", "makyaj"], "skincare": ["cilt bakimi", "bakim"], "haircare": ["sac bakimi", "sac urunu"], "bodycare": ["vucut bakimi", "vucut urunu"]}


def ratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    return 1.0 if a == b else SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """0 where either is null or empty, 1 where they are equal."""
    return pd.Series([ratio(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


def common_letters(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit a letter of a: no alignment matches more letters, at a tenth of its time."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        if m := at.get(c, 0) & row:
            row = (row + m) | (row - m)
    return len(a) - (row & full).bit_count()


def _bags(texts: list[str]) -> np.ndarray:
    """How often each text has the letters of each of 64 classes: what two bags have in common is no less than two texts have."""
    out = np.zeros((len(texts), 64), dtype=np.int32)
    for i, t in enumerate(texts):
        out[i] = np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) % 64, minlength=64)
    return out


def sequence_ratio_from(a: Column, b: Column, least: float) -> Column:
    """sequence_ratio where it is least or more, else null. Lengths, letters and common subsequences are looked at first; only
    pairs they allow are aligned, so none that counts is lost. Equal texts of a batch are prepared once, equal pairs aligned once."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        codes, texts = pd.factorize(pd.concat([a, b]).fillna(""))
        x, y = codes[: len(a)], codes[len(a) :]
        texts = list(texts)
        lengths, bags = np.array([len(t) for t in texts]), _bags(texts)
        sums = np.maximum(1, lengths[x] + lengths[y])
        bound = 2 * np.concatenate([np.minimum(bags[x[i : i + 4096]], bags[y[i : i + 4096]]).sum(axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0)]) / sums
        out, known = [None] * len(x), {}
        for k in np.flatnonzero(bound >= least - 1e-12).tolist():
            i, j = pair = (int(x[k]), int(y[k]))
            if pair not in known:
                s, t = texts[i], texts[j]
                known[pair] = ratio(s, t) if s == t or 2 * common_letters(s, t) / (len(s) + len(t)) >= least - 1e-12 else 0.0
            if known[pair] >= least:
                out[k] = known[pair]
        return pd.Series(out, dtype="float64")

    return run(a, b)


#: Plain texts (small letters a to z, digits, blanks) as numbers from 1 on; 0 is what is behind their end.
_CODES = np.zeros(128, dtype=np.uint8)
_CODES[[ord(x) for x in " abcdefghijklmnopqrstuvwxyz0123456789"]] = np.arange(1, 38)
#: Texts from this length on have letters the aligner ignores; WORD letters fit the bits of a number.
IGNORES_FROM, WORD = 200, 64
_PAIRS, _ITEMS = 1 << 15, 1 << 11


class PlainTexts:
    """Plain texts whose pairs are compared many at a time. Results are those of common_letters and ratio, to the bit."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.codes = np.zeros((len(texts), max(1, min(IGNORES_FROM, int(self.lengths.max(initial=0))))), dtype=np.uint8)
        for i, t in enumerate(texts):
            t = t[: self.codes.shape[1]]
            self.codes[i, : len(t)] = _CODES[np.frombuffer(t.encode(), dtype=np.uint8)]
        # where each text has each letter, a bit a letter, in as many numbers as the longest takes
        self.masks = np.zeros((-(-self.codes.shape[1] // WORD), len(texts), 38), dtype=np.uint64)
        for j in range(self.codes.shape[1]):
            self.masks[j // WORD, np.arange(len(texts)), self.codes[:, j]] |= np.uint64(1 << j % WORD)
        self.masks[:, :, 0] = 0

    def bags(self) -> np.ndarray:
        """A row a letter: how often each text has it. What two bags have in common is no less than two texts have."""
        out = np.zeros((38, len(self.texts)), dtype=np.uint8 if self.lengths.max(initial=0) < 256 else np.uint32)
        for i, t in enumerate(self.texts):
            out[:, i] = np.bincount(_CODES[np.frombuffer(t.encode(), dtype=np.uint8)], minlength=38)
        return out

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """common_letters of the pairs (a, b)."""
        out = np.empty(len(a), dtype=np.int64)
        swap = self.lengths[a] > self.lengths[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        fits = self.lengths[b] < IGNORES_FROM
        for k in np.flatnonzero(~fits).tolist():
            out[k] = common_letters(self.texts[a[k]], self.texts[b[k]])
        words = np.where(fits, np.maximum(1, -(-self.lengths[a] // WORD)), 0)
        for n in range(1, len(self.masks) + 1):
            which = np.flatnonzero(words == n)
            for i in range(0, len(which), _PAIRS):
                at = which[i : i + _PAIRS]
                x, y = a[at], b[at]
                rows = np.full((n, len(at)), ~np.uint64(0))
                for code in self.codes[y, : int(self.lengths[y].max())].T:
                    carry = None
                    for row, masks in zip(rows, self.masks):
                        m = masks[x, code]
                        m &= row
                        up = row + m
                        over = up < m
                        if carry is not None:
                            up += carry
                            over |= up < carry
                        row -= m
                        row |= up
                        carry = over
                out[at] = np.bitwise_count(~rows).sum(axis=0, dtype=np.int64)
        return out

    def ratios(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """ratio of the pairs (a, b): the order of the two counts."""
        out = np.empty(len(a))
        fits = (self.lengths[a] < IGNORES_FROM) & (self.lengths[b] < IGNORES_FROM)
        for k in np.flatnonzero(~fits).tolist():
            out[k] = ratio(self.texts[a[k]], self.texts[b[k]])
        which = np.flatnonzero(fits)
        for i in range(0, len(which), _PAIRS):
            at = which[i : i + _PAIRS]
            x, y = a[at], b[at]
            out[at] = 2.0 * self._matched(x, y) / np.maximum(1, self.lengths[x] + self.lengths[y])
        return out

    def _matched(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Letters that the aligner matches: the longest common stretch (of several the first in a, then in b), and the same
        left and right of it, all open stretches of a round together, those of like lengths at a time."""
        out = np.zeros(len(a), dtype=np.int64)
        n = np.arange(len(a))
        at, a0, a1, b0, b1 = n, np.zeros_like(n), self.lengths[a], np.zeros_like(n), self.lengths[b]
        while len(at):
            order = np.lexsort((b1 - b0, a1 - a0))
            parts = []
            for i in range(0, len(at), _ITEMS):
                k = order[i : i + _ITEMS]
                p, x0, x1, y0, y1 = at[k], a0[k], a1[k], b0[k], b1[k]
                size, x, y = self._longest(a[p], x0, x1, b[p], y0, y1)
                hit = size > 0
                p, size, x, y, x0, x1, y0, y1 = (v[hit] for v in (p, size, x, y, x0, x1, y0, y1))
                np.add.at(out, p, size)
                parts += [(p, x0, x, y0, y), (p, x + size, x1, y + size, y1)]
            at, a0, a1, b0, b1 = (np.concatenate(v) for v in zip(*parts))
            open_ = (a1 > a0) & (b1 > b0)
            at, a0, a1, b0, b1 = (v[open_] for v in (at, a0, a1, b0, b1))
        return out

    def _longest(self, a, a0, a1, b, b0, b1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Length and beginnings of the longest common stretch of a[a0:a1] and b[b0:b1] in each pair."""
        def cut_out(of: np.ndarray, begin: np.ndarray, end: np.ndarray, behind: int) -> np.ndarray:
            at = begin + np.arange(int((end - begin).max()))[:, None]
            return np.where(at < end, self.codes[of, np.minimum(at, self.codes.shape[1] - 1)], np.uint8(behind))

        x, y = cut_out(a, a0, a1, 254), cut_out(b, b0, b1, 255)
        run, new = np.zeros((2, len(y) + 1, len(a)), dtype=np.uint8)
        size, i_end, j_end = np.zeros(len(a), dtype=np.uint8), np.zeros(len(a), dtype=np.int64), np.zeros(len(a), dtype=np.int64)
        for i, letter in enumerate(x):
            np.add(run[:-1], 1, out=new[1:])
            new[1:] *= y == letter
            most = new.max(axis=0)
            better = np.flatnonzero(most > size)
            if len(better):
                size[better], i_end[better], j_end[better] = most[better], i + 1, new[:, better].argmax(axis=0)
            run, new = new, run
        size = size.astype(np.int64)
        return size, a0 + i_end - size, b0 + j_end - size


def ratio_can_reach(a: Column, b: Column, least: float) -> Column:
    """Whether the lengths allow a ratio of at least least: no pair above it is lost."""
    return 2 * F.least(F.length(a), F.length(b)) >= least * (F.length(a) + F.length(b))


def token_set_ratio(a: Column, b: Column, least: float = 0.0) -> Column:
    """Order-free similarity of two texts of words, 0 to 100 with one decimal: the better of as written and sorted. What is below
    least is null (with a least above 0)."""
    in_order = lambda c: F.array_join(F.array_sort(F.split(c, " ")), " ")
    one = (lambda x, y: sequence_ratio_from(x, y, (least - 0.06) / 100)) if least > 0 else sequence_ratio
    score = F.round(100 * F.greatest(one(a, b), one(in_order(a), in_order(b))), 1)
    return F.when(score >= least, score) if least > 0 else score


def worth(query_word: str, candidate: str) -> float:
    """What one word of a candidate is worth to one of the query: all if equal or nearly so, less if somewhat alike. The aligner
    runs only where the words' lengths and common letters allow FAR at all."""
    if query_word == candidate:
        return 1.0
    m = SequenceMatcher(None, query_word, candidate)
    if m.real_quick_ratio() < FAR or m.quick_ratio() < FAR:
        return 0.0
    r = m.ratio()
    return 1.0 if r >= NEAR else FAR_WORTH if r >= FAR else 0.0


def coverage(words: list[str], texts: pd.Series) -> list[float]:
    """The mean worth of the query's words in each text, each by its best partner there. Every distinct word of the texts is looked at
    once, whatever number of texts it is in."""
    split = [t.split() for t in texts]
    known = list({w for ws in split for w in ws})
    by_word = {w: [worth(q, w) for q in words] for w in known}
    return [sum(map(max, zip(*(by_word[w] for w in ws)))) / len(words) if ws and words else 0.0 for ws in split]


def search_aliases(text: Column, category: Column) -> Column:
    """Other words a product is found by, each once, in order. text: the search-normalized brand and name."""
    holds = lambda words: F.expr("false") if not words else _any([text.contains(w) for w in words])
    parts = [F.when(holds(words), F.array(*map(F.lit, also))).otherwise(F.array().cast("array<string>")) for words, also in ALIASES_BY_WORD]
    parts += [F.when(category == c, F.array(*map(F.lit, also))).otherwise(F.array().cast("array<string>")) for c, also in ALIASES_BY_CATEGORY.items()]
    return F.array_join(F.array_distinct(F.concat(*parts)), " ")


def _any(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out | c
    return out


def match_score(query: str, brand: Column, name: Column, candidate: Column, cutoff: float = 0.0) -> Column:
    """0 to 100: how well products answer a query. query and the columns are search-normalized; candidate is all that a
    product is found by. Equal and contained texts are settled in the plan; of the rest whole texts are aligned only where words
    and letters can give a score of cutoff (what cannot gets 0)."""
    words = query.split()

    @F.pandas_udf("double")
    def aligned(b: pd.Series, n: pd.Series, c: pd.Series) -> pd.Series:
        b, n, c = b.fillna(""), n.fillna(""), c.fillna("")
        out = []

        def part(weight: float, base: float, text: str, least: float) -> float:
            m = SequenceMatcher(None, query, text)
            if base + weight * m.real_quick_ratio() < least or base + weight * m.quick_ratio() < least:
                return 0.0
            return base + weight * m.ratio()

        brands: dict[str, float] = {}
        for x, y, z, cover in zip(b, n, c, coverage(words, c)):
            score = part(8, 92 * cover, z, cutoff)
            if x not in brands:
                brands[x] = part(96, 0, x, cutoff)
            score = max(score, brands[x])
            score = max(score, part(94, 0, y, max(score, cutoff)))
            out.append(min(100.0, max(score, 88 + 12 * cover) if x and x in query else score))
        return pd.Series(out, dtype="float64")

    if not words:
        return F.lit(0.0)
    q = F.lit(query)
    rest = ~((brand == q) | (name == q) | candidate.contains(query))
    null = F.lit(None).cast("string")
    # the settled rows hand over nulls, so no alignment is done for them
    scored = aligned(F.when(rest, brand).otherwise(null), F.when(rest, name).otherwise(null), F.when(rest, candidate).otherwise(null))
    return F.when((brand == q) | (name == q), 100.0).when(candidate.contains(query), 97.0).otherwise(scored)


def search_text(brand: Column, name: Column) -> Column:
    return normalize(F.concat_ws(" ", brand, name), "search")
