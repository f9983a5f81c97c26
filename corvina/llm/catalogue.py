"""Product listings describing the same item.

1. Mine what types are called and which words say nothing (vocabulary.py), if a clean reference list is given; read every listing's
   parts. Listings written cleanly (line, type, size, at most one more part) are trusted.
2. Mine brand and line phrases from the trusted listings, and from the reference list. A line of more than LONE_WORDS words
   counts if it has a second witness: alone it may hold words of the shop.
3. Settle brands: a spelling one edit away from a much better supported one is that brand.
4. Find the mined lines in every listing of their brand with an Aho-Corasick automaton; the longest one on word borders wins.
   Listings and lines of a brand are dealt out over as many groups as their numbers need, so no task gathers a whole brand.
5. What has no mined line keeps its remaining words; it joins a class one edit away whose variant parts all agree.
6. Equal brand, line, type, size, shade, sun protection, strength and `+` mark make an item.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm.components import connected_components
from corvina.llm.listing import SEED, Vocabulary, compact, read
from corvina.llm.vocabulary import mine_vocabulary
from corvina.operators.latest import latest_per_key
from corvina.session import cut, shuffled

PARTS = ["kind", "size", "spf", "strength", "shade", "plus"]
#: Listings and lines of one brand that one group takes.
LISTINGS_A_GROUP, LINES_A_GROUP = 20_000, 50_000
#: Entries of the reference list that are held at once while names of types are mined.
MAX_ENTRIES = 100_000
LONE_WORDS = 2
#: Texts count as slips of each other if one edit leaves at least this share of the longer one's letters.
ALIKE = 0.8
#: A brand spelling gives way to one an edit away that has this many times its trusted listings.
BETTER = 3


def edits_within_one(a: str, b: str) -> bool:
    """One letter added, left out, replaced or swapped with its neighbour, or none."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (i + 1 < len(a) and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])


def near_keys(keys: DataFrame, blocks: list[str], key: str = "key", alike: float = ALIKE) -> DataFrame:
    """blocks, a, b: keys one edit apart within equal blocks, a < b, the edit leaving at least the share alike of the longer
    key's letters (0.8: the longer has five or more).

    Two texts one edit apart have a form with at most one letter left out in common: an equi-join on those forms, so its work follows the input and nothing is compared pairwise.
    """
    forms = F.expr("array_distinct(concat(array(key), transform(sequence(1, length(key)), i -> concat(substring(key, 1, i - 1), substring(key, i + 1)))))")

    @F.pandas_udf("boolean")
    def close(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([edits_within_one(x, y) for x, y in zip(a, b)], dtype=bool)

    k = keys.select(*blocks, F.col(key).alias("key")).where("key <> ''").distinct()
    x = cut(k.withColumn("_f", F.explode(forms)).withColumn("_f", F.xxhash64("_f", *blocks)))
    pairs = x.select("_f", *blocks, F.col("key").alias("a")).join(shuffled(x.select("_f", F.col("key").alias("b"), *[F.col(c).alias(f"_{c}") for c in blocks])), "_f")
    same = F.lit(True)
    for c in blocks:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    enough = F.greatest(F.length("a"), F.length("b")) * (1 - alike) >= 1 - 1e-9
    return pairs.where(same & (F.col("a") < F.col("b")) & enough).select(*blocks, "a", "b").distinct().where(close("a", "b"))


def read_listings(df: DataFrame, key: str, brand: str, name: str, vocabulary: Vocabulary = SEED) -> DataFrame:
    """id, brand_key, the parts, line (compact, of clean names only), line_words and rest (words, in order)."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [read(x, y, shared.value) for x, y in zip(b["_b"], b["_n"])]
            yield pd.DataFrame({
                "id": b["id"], "brand_key": [compact(g.brand) for g in got], "kind": [g.kind for g in got], "size": [g.size for g in got], "spf": [g.spf for g in got], "strength": [g.strength for g in got],
                "shade": [g.shade for g in got], "plus": [g.plus for g in got], "line": [g.line and compact(g.line) for g in got], "line_words": pd.Series([len(g.rest) for g in got], dtype="int32"), "rest": [" ".join(g.rest) for g in got],
            })

    rows = df.select(F.col(key).cast("long").alias("id"), F.col(brand).alias("_b"), F.col(name).alias("_n"))
    return rows.mapInPandas(run, "id long, brand_key string, kind string, size string, spf string, strength string, shade string, plus boolean, line string, line_words int, rest string")


def settle_brands(known: DataFrame) -> DataFrame:
    """known: brand_key, support -> brand_key, brand."""
    near = near_keys(known, [], "brand_key")
    both = near.select(F.col("a").alias("brand_key"), F.col("b").alias("other")).unionByName(near.select(F.col("b").alias("brand_key"), F.col("a").alias("other")))
    s = known.select(F.col("brand_key").alias("other"), F.col("support").alias("other_support"))
    best = both.join(shuffled(known), "brand_key").join(shuffled(s), "other").where((F.col("other_support") > F.col("support") * BETTER) & (F.col("other_support") > 0))
    best = best.groupBy("brand_key").agg(F.max(F.struct("other_support", "other")).alias("x")).select("brand_key", F.col("x.other").alias("better"))
    return known.join(shuffled(best), "brand_key", "left").select("brand_key", F.coalesce("better", "brand_key").alias("brand"))


def _find(group: pd.DataFrame, lines: pd.DataFrame) -> pd.DataFrame:
    if group.empty:  # a deal can have lines only
        return pd.DataFrame({"id": pd.Series(dtype="int64"), "found": pd.Series(dtype=object), "left": pd.Series(dtype=object)})
    a = ahocorasick.Automaton()
    for line in lines["line"]:
        a.add_word(line, line)
    if len(a):
        a.make_automaton()
    found, left = [], []
    for brand, key, rest in zip(group["brand"], group["brand_key"], group["rest"]):
        ws = [w.replace("'", "") for w in rest.split()]
        ws = _without_brand(ws, {brand, key})
        text, starts, ends = "".join(ws), {}, {}
        at = 0
        for i, w in enumerate(ws):
            starts[at] = i
            at += len(w)
            ends[at] = i + 1
        best = ""
        if len(a):
            for end, line in a.iter(text):
                if end + 1 in ends and end + 1 - len(line) in starts and (len(line), line) > (len(best), best):
                    best = line
        found.append(best)
        left.append(text)
    return pd.DataFrame({"id": group["id"], "found": found, "left": left})


def _without_brand(ws: list[str], brands: set[str]) -> list[str]:
    """Words without the brand, wherever a run of them spells it (or is one edit away): the run of most words, then the first."""
    longest = max(map(len, brands), default=0) + 1
    best = (0, 0)
    for i in range(len(ws)):
        run = ""
        for n, w in enumerate(ws[i:], 1):
            run += w
            if len(run) > longest:
                break
            if n > best[0] and n < len(ws) and any(run == b or (len(b) * (1 - ALIKE) >= 1 - 1e-9 and edits_within_one(run, b)) for b in brands if b):
                best = (n, i)
    n, i = best
    return ws[:i] + ws[i + n :]


def same_items(df: DataFrame, key: str, brand: str, name: str, reference: DataFrame | None = None) -> DataFrame:
    """key, group_id (least key of the item's group) for every row with a key; one row per key.

    Of rows with one key (a long) the greatest brand and name count. reference: brand and name columns called the same, of clean entries. A listing without a
    name, or with nothing but shop words, is a group of its own. Equal listings are one group. Null parts only equal null
    parts. Other columns are ignored.
    """
    unique = latest_per_key(df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(brand).alias("b"), F.col(name).alias("n")), ["k"], [], ["b", "n"])
    unique = cut(unique)
    vocabulary = SEED
    if reference is not None:
        entries = reference.select(F.col(brand).alias("brand"), F.col(name).alias("name")).distinct()
        vocabulary = mine_vocabulary(entries, unique.select(F.col("b").alias("brand"), F.col("n").alias("name")).distinct(), max_entries=MAX_ENTRIES)
    rows = cut(read_listings(unique, "k", "b", "n", vocabulary))
    trusted = rows.where("line is not null").select("brand_key", "line", F.col("line_words").alias("words"), F.lit(1).alias("witnesses"))
    if reference is not None:
        # an entry of the list has no size: one is added so that it reads as a clean name
        entries = read_listings(reference.select(F.lit(0).alias("_k"), brand, F.regexp_replace(F.concat(name, F.lit(" 1 ml")), r"(?i)\s+(SPF \d+) 1 ml$", " 1 ml $1").alias(name)), "_k", brand, name, vocabulary)
        trusted = trusted.unionByName(entries.where("line is not null").select("brand_key", "line", F.lit(0).alias("words"), F.lit(2).alias("witnesses")))
    trusted = trusted.groupBy("brand_key", "line").agg(F.count("*").alias("n"), F.min("words").alias("words"), F.sum("witnesses").alias("witnesses"))
    trusted = cut(trusted.where((F.col("words") <= LONE_WORDS) | (F.col("witnesses") > 1)).select("brand_key", "line", "n"))
    support = trusted.groupBy("brand_key").agg(F.sum("n").alias("support"))
    known = cut(rows.select("brand_key").distinct().unionByName(support.select("brand_key")).distinct().join(shuffled(support), "brand_key", "left").fillna(0, ["support"]))
    settled = cut(settle_brands(known))
    rows = rows.join(shuffled(settled), "brand_key")
    lines = cut(trusted.join(shuffled(settled), "brand_key").select("brand", "line").where("line <> ''").distinct())

    deal = rows.groupBy("brand").agg(F.ceil(F.count("*") / LISTINGS_A_GROUP).cast("int").alias("salts"))
    deal = deal.join(shuffled(lines.groupBy("brand").agg(F.ceil(F.count("*") / LINES_A_GROUP).cast("int").alias("shards"))), "brand", "left").fillna(1, ["shards"])
    deal = cut(deal)
    dealt = rows.select("id", "brand", "brand_key", "rest").join(shuffled(deal), "brand").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts"))).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    dict_ = lines.join(shuffled(deal), "brand").withColumn("shard", F.pmod(F.xxhash64("line"), F.col("shards")).cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long") - 1)))
    found = dealt.groupBy("brand", "salt", "shard").cogroup(dict_.groupBy("brand", "salt", "shard")).applyInPandas(_find, "id long, found string, left string")
    found = found.groupBy("id").agg(F.max(F.struct(F.length("found").alias("n"), "found", "left")).alias("x"))
    rows = rows.join(shuffled(found), "id").select("id", "brand", *PARTS, F.when(F.col("x.n") > 0, F.col("x.found")).otherwise(F.col("x.left")).alias("line"))
    rows = cut(rows)

    blocks = ["brand", *PARTS]
    # nothing to tell it by: a listing of its own
    nameless = F.when(F.col("line") == "", F.col("id"))
    classes = cut(rows.groupBy(*blocks, "line", nameless.alias("own")).agg(F.min("id").alias("rep")))
    named = classes.where("own is null").withColumn("block", F.xxhash64(*blocks))
    # a clean name can hold a slip, too, so mined lines meet as well; a class alone in its block has nothing to join
    open_ = named.groupBy("block").agg(F.count("*").alias("n")).where("n > 1").select("block")
    named = cut(named.join(shuffled(open_), "block", "left_semi").select("block", "line", "rep"))
    near = near_keys(named, ["block"], "line")
    a, b = (named.select("block", F.col("line").alias(s), F.col("rep").alias(f"r{s}")) for s in "ab")
    links = near.join(shuffled(a), ["block", "a"]).join(shuffled(b), ["block", "b"]).select("ra", "rb")
    merged = connected_components(links, "ra", "rb")
    classes = classes.join(shuffled(merged.withColumnRenamed("id", "rep")), "rep", "left").withColumn("group_id", F.coalesce("group_id", "rep"))
    # the class of a row by a hash of what makes it, checked part by part
    made = lambda x: F.xxhash64(*blocks, "line", x)
    r = rows.withColumn("_h", made(nameless)).alias("r")
    c = classes.withColumn("_h", made("own")).select("_h", *blocks, "line", "own", "group_id").alias("c")
    on = F.col("r._h") == F.col("c._h")
    for x in [*blocks, "line"]:
        on &= F.col(f"r.{x}").eqNullSafe(F.col(f"c.{x}"))
    on &= (F.col("c.own").isNull()) | (F.col("c.own") == F.col("r.id"))
    return r.join(shuffled(c), on).select(F.col("r.id").alias(key), F.col("c.group_id").alias("group_id"))
