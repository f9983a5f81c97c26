"""Evaluation texts leaking into training text.

A BM25 inverted index of the test items is shared with all workers; every passage of every document is a query, answered
by block-max WAND. Texts are compared as streams of letters and digits without blanks, so the terms are letter n-grams, chosen by
winnowing: of any SPAN neighbouring n-grams the one with the least hash, which depends on these letters alone. A run of
WINDOW consecutive words of an item has the same terms wherever it stands and however its blanks are set, and an item's
threshold is the least score any of its runs can give: every passage with such a run is retrieved (for an item of fewer words:
the whole of it). Retrieved pairs are verified letter by letter.

An index is broadcast: at most MAX_ITEMS items. Of a longer item table each shard of that size is asked in turn.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm.lookalike import words

WINDOW = 10
MAX_ITEMS = 100_000
BLOCK = 32
#: Letters of a term, and of how many neighbouring terms one is taken. Items with a run too short for that have an index of
#: their own with shorter terms.
GRAM, SPAN = 6, 8
K1, B = 1.2, 0.75


def _codes(letters: str) -> np.ndarray:
    return np.frombuffer(letters.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def terms_of(codes: np.ndarray, gram: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed n-grams of a letter stream: where each begins (ascending) and its 64-bit hash. All arithmetic is on whole arrays."""
    n = len(codes) - gram + 1
    if n < 1:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(gram):
        h = (h ^ codes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    if n < span:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    # the leftmost least hash of each window; of repeated letters all equal ones of a window count as the leftmost
    least = h[: n - span + 1].copy()
    for i in range(1, span):
        np.minimum(least, h[i : n - span + 1 + i], out=least)
    taken = np.zeros(n, dtype=bool)
    for i in range(span):
        taken[i : n - span + 1 + i] |= h[i : n - span + 1 + i] == least
    at = np.flatnonzero(taken)
    return at, h[at]


class ItemIndex:
    """items: (item_id, text). Repeated ids count once; items without words are left out."""

    def __init__(self, items: list[tuple[int, str | None]], window: int = WINDOW):
        texts = {i: ws for i, t in sorted(items, key=lambda x: (x[0], x[1] or "")) if (ws := words(t))}
        runs = {i: ["".join(ws[k : k + window]) for k in range(max(1, len(ws) - window + 1))] for i, ws in texts.items()}
        short = {i for i, r in runs.items() if min(map(len, r)) < GRAM + SPAN - 1}
        self.parts = []
        for ids, gram, span in (([i for i in runs if i not in short], GRAM, SPAN), (list(short), min([GRAM, *(len(r) for i in short for r in runs[i])]), 1)):
            if ids:
                self.parts.append(_Part({i: "".join(texts[i]) for i in ids}, {i: runs[i] for i in ids}, gram, span))

    def leaked(self, text: str | None) -> list[int]:
        """Ids of the items the text contains, in order."""
        return [i for _, i in self.leaks([text])]

    def leaks(self, texts: Iterable[str | None]) -> list[tuple[int, int]]:
        """(number of the text, item id) of all texts, in order."""
        streams = ["".join(words(t)) for t in texts]
        # one stream of all, a sign that no item has between two texts
        codes = _codes("\0".join(streams))
        starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in streams])])
        return sorted({x for p in self.parts for x in p.leaks(codes, streams, starts)})


class _Part:
    def __init__(self, letters: dict[int, str], runs: dict[int, list[str]], gram: int, span: int):
        self.gram, self.span = gram, span
        self.ids = sorted(letters)
        self.runs = [runs[i] for i in self.ids]
        self.longest = max(len(r) for rs in self.runs for r in rs)
        terms = [Counter(terms_of(_codes(letters[i]), gram, span)[1].tolist()) for i in self.ids]
        n, mean = len(self.ids), sum(t.total() for t in terms) / max(1, len(self.ids))
        df = Counter(w for t in terms for w in t)
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for k, t in enumerate(terms):
            weight = {w: log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * t.total() / mean)) for w, tf in t.items()}
            least = min(sum(weight[w] for w in set(terms_of(_codes(r), gram, span)[1].tolist())) for r in self.runs[k])
            # weights are divided by the item's threshold, so 1 is the threshold of all
            for w, x in weight.items():
                postings[w].append((k, x / least))
        self.lists = {}
        for w, p in postings.items():
            ks = [k for k, _ in p]
            blocks = [(ks[min(i + BLOCK, len(p)) - 1], max(x for _, x in p[i : i + BLOCK])) for i in range(0, len(p), BLOCK)]
            self.lists[w] = (ks, [x for _, x in p], [b for b, _ in blocks], [x for _, x in blocks], max(x for _, x in p))
        self.known = np.array(sorted(self.lists), dtype=np.uint64)

    def leaks(self, codes: np.ndarray, streams: list[str], starts: np.ndarray) -> Iterator[tuple[int, int]]:
        at, h = terms_of(codes, self.gram, self.span)
        found = np.searchsorted(self.known, h)
        hit = self.known[np.minimum(found, len(self.known) - 1)] == h
        at, h = at[hit], h[hit]
        text = np.searchsorted(starts, at, side="right") - 1
        # passages of two runs' length, each half over the next: a run lies wholly in one of them
        half = (at - starts[text]) // self.longest
        border = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (half[1:] != half[:-1])])) if len(at) else []
        last = (-1, -1, frozenset())
        for x, y in zip(border, [*border[1:], len(at)]):
            t, k, now = int(text[x]), int(half[x]), frozenset(h[x:y].tolist())
            near = last[0] == t and last[1] == k - 1
            for first, query in ((k - 1, (last[2] | now) if near else now), (k, now)):
                # the half before alone was asked with its own; here both together, then this one with what may follow
                if first == k and y < len(at) and text[y] == t and half[y] == k + 1:
                    continue
                begin = max(0, first * self.longest)
                passage = None
                for item in self.retrieve(query):
                    passage = streams[t][begin : begin + 2 * self.longest] if passage is None else passage
                    if any(r in passage for r in self.runs[item]):
                        yield t, self.ids[item]
            last = (t, k, now)

    def retrieve(self, query: Iterable[int]) -> list[int]:
        """Numbers of all items whose score for the query (distinct terms) reaches their threshold, by block-max WAND."""
        cursors = [[ls[0][0], 0, ls] for w in query if (ls := self.lists.get(w))]
        out: list[int] = []
        if sum(c[2][4] for c in cursors) < 1 - 1e-9:
            return out
        end = len(self.ids)
        while True:
            cursors.sort(key=lambda c: c[0])
            # the pivot: the first item whose list maxima together can reach the threshold
            bound, p = 0.0, -1
            for p, c in enumerate(cursors):
                if c[0] >= end:
                    return out
                bound += c[2][4]
                if bound >= 1 - 1e-9:
                    break
            else:
                return out
            pivot = cursors[p][0]
            while p + 1 < len(cursors) and cursors[p + 1][0] == pivot:
                p += 1
            # the maxima of the blocks the pivot would lie in
            bound, until = 0.0, end
            for c in cursors[: p + 1]:
                ends, maxima = c[2][2], c[2][3]
                b = bisect_left(ends, pivot)
                if b < len(ends):
                    bound += maxima[b]
                    until = min(until, ends[b] + 1)
                # a list that ends before the pivot adds nothing
            if bound >= 1 - 1e-9:
                if cursors[0][0] == pivot:
                    score = sum(c[2][1][c[1]] for c in cursors[: p + 1])
                    if score >= 1 - 1e-9:
                        out.append(pivot)
                    to = pivot + 1
                else:
                    to = pivot
            else:
                # nothing up to the end of the nearest block can reach it
                to = max(pivot + 1, min(until, cursors[p + 1][0] if p + 1 < len(cursors) else end))
            for c in cursors[: p + 1]:
                if c[0] < to:
                    ks = c[2][0]
                    c[1] = bisect_left(ks, to, c[1])
                    c[0] = ks[c[1]] if c[1] < len(ks) else end


def find_leaks(df: DataFrame, key: str, text: str, items: DataFrame, item_id: str, item_text: str, window: int = WINDOW, max_items: int = MAX_ITEMS) -> DataFrame:
    """key and item_id for every document and item of which it holds window consecutive words.

    Null and empty texts, and items without words, give no row; an empty item table gives an empty result. A key that
    occurs twice gives its rows twice. Documents may have any length: they are read whole, passage by passage. Items of any
    number: what goes beyond max_items is another index, over which the documents are read again.
    """
    known = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("i is not null").distinct()
    shards = max(1, -(-known.count() // max_items))
    kind = dict(df.dtypes)[key]
    out = None
    for shard in range(shards):
        some = known.where(F.pmod(F.xxhash64("i"), F.lit(shards)) == shard)
        # built once here; a worker process reads it once
        shared = df.sparkSession.sparkContext.broadcast(ItemIndex([tuple(r) for r in some.collect()], window))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for b in batches:
                keys = b["_k"].tolist()
                yield pd.DataFrame([(keys[n], i) for n, i in shared.value.leaks(b["_t"])], columns=[key, "item_id"])

        found = df.select(F.col(key).alias("_k"), F.col(text).alias("_t")).mapInPandas(run, f"`{key}` {kind}, item_id long")
        out = found if out is None else out.unionByName(found)
    return out
