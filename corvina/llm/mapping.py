"""Mapping freely typed names to a canonical list.

A multi-pattern automaton over canonical lines finds embedded mentions; with a name of the line's type beside it (in either
order, glued or not) a mention is longer. The longest non-overlapping mentions win. Values without one go to token-set similarity
(of the words, and of all glued as one token, for blanks typed in the wrong place) against all lines that can reach the
threshold. What is below the threshold maps to NO_MATCH. What types are called is mined (vocabulary.py).

The list is broadcast in shards of at most MAX_ENTRIES entries, by line; with several, the best of all shards' answers counts.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm.listing import SEED, Vocabulary, compact, folded, read
from corvina.llm.vocabulary import mine_vocabulary
from corvina.session import cut, shuffled

NO_MATCH = -1
MAX_ENTRIES = 100_000
SIMILAR = 0.8
_GLUED_SPF = re.compile(r"(?:spf|gkf)(\d\d)|(\d\d)(?:spf|gkf)")
# Letters typed for one another because they sound alike.
_SOUND = str.maketrans("cwq", "kvk")
#: What a line of the typed brand has ahead of others.
OWN = 0.06


@lru_cache(1 << 16)
def _ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


@lru_cache(1 << 16)
def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit a letter of a: no alignment matches more letters."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        if m := at.get(c, 0) & row:
            row = (row + m) | (row - m)
    return len(a) - (row & full).bit_count()


def _reach(a: str, b: str) -> float:
    """What _ratio can be at most."""
    return 2 * _common(a, b) / max(1, len(a) + len(b))


class Matcher:
    """Finds the entry meant by a brand and a name. entries: (ref_id, brand, name) of clean, distinct entries; brands: further
    brands to take out of names (those of other shards)."""

    def __init__(self, entries: list[tuple[int, str, str]], vocabulary: Vocabulary = SEED, brands: Iterable[str] = ()):
        self.vocabulary = vocabulary
        self.of_line: dict[str, dict[tuple[str | None, str | None, bool], int]] = defaultdict(dict)
        self.brand_of: dict[str, set[str]] = defaultdict(set)
        self.brands: set[str] = set(brands)
        self.words_of: dict[str, list[str]] = {}
        for ref, brand, name in sorted(entries, key=lambda e: (e[0], e[1] or "", e[2] or "")):
            got = read(brand, name, vocabulary)
            line = compact(" ".join(got.rest))
            if not line:
                continue
            self.of_line[line].setdefault((got.kind, got.spf, got.plus), ref)
            b = compact(got.brand)
            self.brand_of[line].add(b)
            self.brands.add(b)
            self.words_of.setdefault(line, got.rest)
        self.brands.discard("")
        self.longest_brand = max(map(len, self.brands), default=0)
        self.automaton = ahocorasick.Automaton()
        for line in self.of_line:
            self.automaton.add_word(line, line)
        if self.of_line:
            self.automaton.make_automaton()
        # the lines by length, and for each letter how often each of them has it
        self.lines = sorted(self.of_line, key=lambda x: (len(x), x))
        self.sound = [line.translate(_SOUND) for line in self.lines]
        self.sound_words = [[w.translate(_SOUND) for w in self.words_of[line]] for line in self.lines]
        self.lengths = np.array([len(x) for x in self.lines], dtype=np.int64)
        self.lines_of = defaultdict(list)
        for k, line in enumerate(self.lines):
            for b in self.brand_of[line]:
                self.lines_of[b].append(k)
        self.lines_of = {b: np.array(of) for b, of in self.lines_of.items()}
        # a byte a count while no line can have more of a letter
        self.most = 255 if not self.lines or len(self.lines[-1]) < 256 else 65535
        self.letters: dict[str, np.ndarray] = {}
        for k, heard in enumerate(self.sound):
            for letter, n in Counter(heard).items():
                if letter not in self.letters:
                    self.letters[letter] = np.zeros(len(self.lines), dtype=np.uint8 if self.most == 255 else np.uint16)
                self.letters[letter][k] = min(n, self.most)
        self.glued_types = sorted(((compact(x), k) for x, k in vocabulary.types.items()), key=lambda x: (-len(x[0]), x))

    def mentions(self, words: list[str]) -> list[tuple[str, str | None]]:
        """(line, type or none) of the longest non-overlapping mentions in the words without their blanks. A mention begins
        or ends where a word does (what is glued to it can be a brand or a shop's word); blanks inside it do not matter."""
        return [(line, kind) for _, _, line, kind in self._mentions(words)]

    def _mentions(self, words: list[str]) -> list[tuple[int, int, str, str | None]]:
        """(length, end, line, type), the longest first."""
        if not len(self.automaton):
            return []
        borders, at, text = {0}, 0, "".join(words)
        for w in words:
            at += len(w)
            borders.add(at)
        hits = []
        for end, line in self.automaton.iter(text):
            a, b = end + 1 - len(line), end + 1
            spans: dict[tuple[int, int], str | None] = {(a, b): None}
            for kind in {k for k, _, _ in self.of_line[line] if k}:
                for name in self.vocabulary.names_of.get(kind, ()):
                    if text.startswith(name, b):
                        spans[(a, b + len(name))] = kind
                    if text.endswith(name, 0, a):
                        spans[(a - len(name), b)] = kind
            hits += [(y - x, y - 1, line, k) for (x, y), k in spans.items() if x in borders or y in borders]
        hits.sort(key=lambda h: (-h[0], h[1], h[2], h[3] or ""))
        taken: list[tuple[int, int]] = []
        out = []
        for n, end, line, kind in hits:
            if all(end < x or end - n + 1 > y for x, y in taken):
                taken.append((end - n + 1, end))
                out.append((n, end, line, kind))
        return out

    def entry(self, line: str, kind: str | None, spf: str | None, plus: bool = False) -> int:
        """The entry of a line that agrees with the type, the `+` mark and, where it is said, the sun protection."""
        fits = [(k, x, ref) for (k, x, p), ref in self.of_line[line].items() if p == plus and (kind is None or k == kind) and (spf is None or x is None or x == spf)]
        if not fits or (kind is None and len({k for k, _, _ in fits}) > 1):
            return NO_MATCH
        return min(fits, key=lambda f: (f[1] or "", f[2]))[2]

    def similar(self, words: list[str], brand: str) -> str | None:
        """The line whose words are most alike, or none."""
        got = self._similar(words, brand)
        return got[2] if got else None

    def _similar(self, words: list[str], brand: str) -> tuple[float, bool, str] | None:
        """(-score, not the brand's own, line) of the line whose words are most alike, or none. Words are compared as a set: order
        and repetition do not count, and the glued forms are compared as well, for blanks typed in the wrong place. All lines
        whose letters, as a bag, can reach SIMILAR (less OWN for the typed brand's own) are compared. Ties: the
        brand's own line, then the first by letters."""
        words = [w.translate(_SOUND) for w in words]
        glued = "".join(words)
        if not glued:
            return None
        n, bag = len(glued), Counter(glued)
        reaches = self._bag_reach(bag, n)
        if brand in self.lines_of:
            reaches |= self._reaching(bag, n, self.lines_of[brand], SIMILAR - OWN)
        best: tuple[float, bool, str] | None = None
        for k in sorted(reaches, key=lambda k: (-reaches[k], k)):
            line, reach = self.lines[k], reaches[k]
            own = brand in self.brand_of[line]
            need = (-best[0] if best else SIMILAR) - OWN * own - 1e-9
            heard = self.sound[k]
            score = max(_ratio(heard, glued) if reach >= need and _reach(heard, glued) >= need else 0.0, self._token_set(self.sound_words[k], words, need)) + OWN * own
            if score >= SIMILAR and (best is None or (-score, not own, line) < best):
                best = (-score, not own, line)
        return best

    def _bag_reach(self, bag: Counter[str], n: int) -> dict[int, float]:
        """The lines whose letters can reach SIMILAR with n letters, and how far."""
        # outside these lengths even a line with no other letters falls short
        a = int(np.searchsorted(self.lengths, int(n * SIMILAR / (2 - SIMILAR)), side="left"))
        b = int(np.searchsorted(self.lengths, int(n * (2 - SIMILAR) / SIMILAR) + 1, side="right"))
        return {a + k: x for k, x in self._reaching(bag, n, slice(a, b), SIMILAR).items()}

    def _reaching(self, bag: Counter[str], n: int, which: slice | np.ndarray, least: float) -> dict[int, float]:
        """Of some lines those that can reach least: by place in a slice, by number in an array."""
        lengths = self.lengths[which]
        shared = np.zeros(len(lengths), dtype=np.uint16)
        for letter, times in bag.items():
            if letter in self.letters:
                shared += np.minimum(self.letters[letter][which], min(times, self.most))
        bound = 2.0 * shared / (lengths + n)
        fits = np.flatnonzero(bound >= least)
        return dict(zip((which[fits] if isinstance(which, np.ndarray) else fits).tolist(), bound[fits].tolist()))

    @staticmethod
    def _token_set(a: list[str], b: list[str], need: float = 0.0) -> float:
        """Each word with its most alike partner, weighted by length, from both sides; 0 where the lengths or the common
        letters of the words already keep it below need."""
        def both(alike) -> float:
            side = lambda p, q: sum(len(w) * max(alike(w, v) for v in q) for w in p) / sum(map(len, p))
            return (side(x, y) + side(y, x)) / 2

        x, y = list(dict.fromkeys(a)), list(dict.fromkeys(b))
        if not (x and y) or both(lambda w, v: 2 * min(len(w), len(v)) / max(1, len(w) + len(v))) < need or both(_reach) < need:
            return 0.0
        return both(_ratio)

    def match(self, brand: str | None, name: str | None) -> int:
        return self.ranked(brand, name)[1]

    def ranked(self, brand: str | None, name: str | None) -> tuple[tuple[int, float, float, str], int]:
        """(rank, entry): the least rank of several lists' is the answer of all. A mention goes before a mention found only with
        everything left in, that before likeness."""
        got = read(brand, name, self.vocabulary)
        nothing = (9, 0.0, 0.0, ""), NO_MATCH
        if not (got.rest or got.line):
            return nothing
        own = compact(got.brand)
        whole = [compact(w) for w in folded(name).split()]
        kind, spf = got.kind, got.spf
        if spf is None and (m := _GLUED_SPF.search("".join(whole))):
            spf = m[1] or m[2]
        words = [w.replace("'", "") for w in got.rest]
        # with everything known taken out, then with all of the name (glued spellings hide the type)
        for stage, where in enumerate((words, whole)):
            for n, end, line, said in self._mentions(where):
                return (stage, float(-n), float(end), line), self.entry(line, said or kind, spf, got.plus)
        if kind is None:  # a glued spelling with a slip in it
            glued = "".join(words)
            for s, k in self.glued_types:
                if len(glued) > len(s) + 3 and (glued.endswith(s) or glued.startswith(s)):
                    kind = k
                    words = [glued[: -len(s)] if glued.endswith(s) else glued[len(s) :]]
                    break
        best = self._similar(self._without_brand(words, own), own)
        return ((2, best[0], float(best[1]), best[2]), self.entry(best[2], kind, spf, got.plus)) if best else nothing

    def _without_brand(self, words: list[str], own: str) -> list[str]:
        """Words without the longest brand they begin with, unless nothing else is there."""
        longest, glued, out = max(self.longest_brand, len(own)), "", words
        for n, w in enumerate(words[:-1], 1):
            glued += w
            if len(glued) > longest:
                break
            if glued == own or glued in self.brands:
                out = words[n:]
        return out


def map_to_list(df: DataFrame, brand: str, name: str, reference: DataFrame, ref_id: str, ref_brand: str, ref_name: str, mined: bool = True, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """df's distinct (brand, name) pairs with ref_id, NO_MATCH where the list has none.

    Each distinct pair is looked up once, so a value typed a billion times costs one lookup. Null and empty names, and names
    of nothing but shop words, map to NO_MATCH; a null brand is no hindrance. An empty list maps everything to NO_MATCH.
    Entries that read the same: the least id counts. mined: types of the list, their other names and filler are mined from the list
    and the pairs before, from all of both; else only the built-in ones count. A list beyond max_entries goes in shards by the
    entry's line, each with the brands of all; the answers are those of one list.
    """
    sc = df.sparkSession.sparkContext
    pairs = df.select(F.col(brand).alias("brand"), F.col(name).alias("name")).distinct()
    known = reference.select(F.col(ref_id).alias("i"), F.col(ref_brand).alias("b"), F.col(ref_name).alias("n")).where("i is not null").distinct()
    shards = max(1, -(-known.count() // max_entries))
    if shards > 1:
        known = cut(known)
        vocabulary = mine_vocabulary(known.select(F.col("b").alias("brand"), F.col("n").alias("name")), pairs, max_entries=max_entries) if mined else SEED
        told = sc.broadcast(vocabulary)

        # entries of one line belong together: they decide between themselves
        def lined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                got = [read(x, y, told.value) for x, y in zip(b["b"], b["n"])]
                yield b.assign(line=[compact(" ".join(g.rest)) for g in got], key=[compact(g.brand) for g in got])

        known = cut(known.mapInPandas(lined, f"i {dict(known.dtypes)['i']}, b string, n string, line string, key string").withColumn("shard", F.pmod(F.xxhash64("line"), F.lit(shards))))
        brands = [r[0] for r in known.where("line <> ''").select("key").distinct().collect()]
    part = lambda k: [tuple(r) for r in (known.where(F.col("shard") == k) if shards > 1 else known).select("i", "b", "n").collect()]
    if shards == 1:
        first, brands = part(0), []
        vocabulary = mine_vocabulary([e[1:] for e in first], pairs) if mined and first else SEED
    out = None
    for k in range(shards):
        # built once here; a worker process reads it once
        shared = sc.broadcast(Matcher(part(k) if shards > 1 else first, vocabulary, brands))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for b in batches:
                got = [shared.value.ranked(x, y) for x, y in zip(b["brand"], b["name"])]
                yield pd.DataFrame({"brand": b["brand"], "name": b["name"], "ref_id": pd.Series([i for _, i in got], dtype="int64"), **({"rank": [r for r, _ in got]} if shards > 1 else {})})

        found = pairs.mapInPandas(run, "brand string, name string, ref_id long" + (", rank struct<stage: int, a: double, b: double, line: string>" if shards > 1 else ""))
        out = found if out is None else out.unionByName(found)
    return out if shards == 1 else out.groupBy("brand", "name").agg(F.min_by("ref_id", "rank").alias("ref_id"))


def map_rows(df: DataFrame, keep: list[str], brand: str, name: str, reference: DataFrame, ref_id: str, ref_brand: str, ref_name: str) -> DataFrame:
    """keep's columns and ref_id for every row of df."""
    rows = cut(df.select(*keep, F.col(brand).alias("_b"), F.col(name).alias("_n")).withColumn("_h", F.xxhash64("_b", "_n")))
    found = map_to_list(rows, "_b", "_n", reference, ref_id, ref_brand, ref_name).withColumn("_h", F.xxhash64("brand", "name"))
    on = (rows["_h"] == found["_h"]) & rows["_b"].eqNullSafe(found["brand"]) & rows["_n"].eqNullSafe(found["name"])
    return rows.join(shuffled(found), on).select(*keep, "ref_id")
