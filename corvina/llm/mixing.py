"""Mixing sources to target weights by Pfair scheduling.

Every source is cut into blocks of equal size in tokens. Block j of a source of weight w is released at (j - 1) / w and due
at j / w, counted in blocks of the whole; among the released blocks the one due first is next. No source is ever a whole
block ahead of or behind its weight. The weights are fractions with a common denominator, so after that many blocks all sources are
exactly even and the schedule repeats: one period is computed on the driver, and every block finds its place from its number alone.
Shares as written (decimals) are kept exactly while their period has at most MAX_SLOTS blocks; else they are rounded to
multiples of 1 / SLOTS.

The size of the whole is the greatest at which no source has to be repeated more than it may; so the target shares hold
for all sources there are, and a scarce one limits the whole rather than its own share. Sources that are missing cannot
have a share: theirs goes to the others in proportion and is reported.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache, reduce
from math import lcm
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvina.session import cut

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Blocks in the longest period that is kept exactly, and in the one of rounded weights.
MAX_SLOTS, SLOTS = 100_000, 10_000
#: Setting of the session that names the folder of the tokenizers.
TOKENIZERS_SETTING = "corvina.tokenizers"
BLOCK_TOKENS = 2_048
MAX_SOURCES = 5_000
#: Buckets for the running token counts: documents of a source are spread by hash over this many per million.
PER_BUCKET = 20_000


@lru_cache(maxsize=4)
def encoder(folder: str, vocabulary: str):
    import importlib.util

    import tiktoken

    spec = importlib.util.spec_from_file_location("_public_tokenizers", Path(folder) / "__init__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    with open(Path(folder) / vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, keep: list[str], text: str, tokenizers: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """keep's columns and tokens (int); null and empty texts have none. tokenizers: the folder, else the session's setting."""
    tokenizers = tokenizers or df.sparkSession.conf.get(TOKENIZERS_SETTING, TOKENIZERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(tokenizers, vocabulary)
        for b in batches:
            yield pd.DataFrame({**{c: b[c] for c in keep}, "tokens": pd.Series([len(e.encode_ordinary(t)) if t else 0 for t in b["_t"]], dtype="int64")})

    kinds = ", ".join(f"`{c}` {t}" for c, t in df.select(*keep).dtypes)
    return df.select(*keep, F.col(text).alias("_t")).mapInPandas(run, f"{kinds}, tokens long")


def slots_of(weights: dict[str, float], slots: int | None = None) -> dict[str, int]:
    """Whole slots of a period. Without slots the shortest period that keeps the weights as written exactly, up to MAX_SLOTS; else
    (SLOTS beyond that) by largest remainder: a positive weight gets at least one, and they sum to slots."""
    if slots is None:
        exact = {s: Fraction(repr(w)) for s, w in weights.items()}
        whole = sum(exact.values())
        period = reduce(lcm, ((w / whole).denominator for w in exact.values()), 1)
        if period <= MAX_SLOTS:
            return {s: int(w / whole * period) for s, w in exact.items()}
        slots = SLOTS
    total = sum(weights.values())
    exact = {s: w / total * slots for s, w in weights.items()}
    got = {s: max(1, int(x)) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (got[s] - exact[s], s)):
        if sum(got.values()) >= slots:
            break
        got[s] += 1
    while sum(got.values()) > slots:
        s = max(got, key=lambda s: (got[s] - exact[s] if got[s] > 1 else -1e9, s))
        got[s] -= 1
    return got


def pfair_period(counts: dict[str, int]) -> list[str]:
    """The source of each slot of a period in which source s has counts[s] of sum(counts) slots.

    Earliest deadline first among released blocks. Equal deadlines: the block whose window overlaps the next one of its
    source goes first, then the source whose run of such windows ends later (its group deadline), then the heavier, then
    the name; with these rules all deadlines are met.
    """
    n = sum(counts.values())

    def window(s: str, j: int) -> tuple[int, int, int, int]:
        c = counts[s]
        release, due = (j - 1) * n // c, -(-j * n // c)
        overlaps = int(-(-j * n // c) > j * n // c)
        return release, due, overlaps, _group_deadline(j, c, n) if overlaps else 0

    waiting: list[tuple[int, int, str]] = []  # release, block, source
    ready: list[tuple] = []
    for s in counts:
        heapq.heappush(waiting, (0, 1, s))
    out = []
    for t in range(n):
        while waiting and waiting[0][0] <= t:
            _, j, s = heapq.heappop(waiting)
            _, due, overlaps, group = window(s, j)
            heapq.heappush(ready, (due, -overlaps, -group, -counts[s], s, j))
        due, _, _, _, s, j = heapq.heappop(ready)
        out.append(s)
        if j < counts[s]:
            heapq.heappush(waiting, (max(window(s, j + 1)[0], t + 1), j + 1, s))
    return out


@lru_cache(maxsize=1 << 18)
def _group_deadline(j: int, c: int, n: int) -> int:
    """Only heavy sources (at least half) can force others along: when their run of two-slot windows ends."""
    if 2 * c < n or c == n:
        return 0
    # a gap opens whenever the complement, n - c slots of n, is due
    d = -(-j * n // c)
    k = -(-d * (n - c) // n)
    return -(-k * n // (n - c))


def counted_documents(df: DataFrame, key: str, source: str, text: str, tokenizers: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """key, source, tokens of all documents with a source and a token."""
    rows = df.where(F.col(source).isNotNull()).select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("_x"))
    return cut(count_tokens(rows, ["key", "source"], "_x", tokenizers, vocabulary).where("tokens > 0"))


def mix(df: DataFrame, key: str, source: str, text: str, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, slots: int | None = None, tokenizers: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """The mixed order: key, source, repeat (from 1), block, slot, place, tokens.

    slot orders the blocks of the whole, place (a token offset in the source's stream) the documents of a block; sort by
    slot, source, place to read it. A document belongs to the block its first token is in. targets: source, target_share,
    max_repeats. Documents of null or untargeted sources and without tokens are left out (see mix_report for how many).
    No document is left out or cut to fit: the whole ends with whole periods of documents, so shares are off by at most a
    block a source. Sources with a null or non-positive share or no repeats count as not targeted. Empty input: empty result.
    """
    return mix_counted(counted_documents(df, key, source, text, tokenizers, vocabulary), targets, block_tokens, slots).withColumnRenamed("key", key)


def mix_counted(docs: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, slots: int | None = None) -> DataFrame:
    """mix of documents whose tokens are counted (counted_documents)."""
    spark = docs.sparkSession
    plan = plan_of(docs.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")), targets, slots)
    if not plan:
        return spark.createDataFrame([], f"key {dict(docs.dtypes)['key']}, source string, repeat int, block long, slot long, place long, tokens long")
    counts = {p["source"]: p["slots"] for p in plan}
    slots = sum(counts.values())
    seen: dict[str, int] = {}
    period = []
    for t, s in enumerate(pfair_period(counts)):
        seen[s] = seen.get(s, 0) + 1
        period.append((s, seen[s] - 1, t))
    slot_of = spark.createDataFrame(period, "source string, nth long, at long")
    planned = spark.createDataFrame([(p["source"], p["slots"], p["take"], p["tokens"], p["whole"], p["docs"]) for p in plan], "source string, slots long, take long, all_tokens long, whole int, all_docs long")

    # the documents of a source in an order by hash, with running token counts: first of buckets, then inside them
    h = docs.join(F.broadcast(planned), "source").withColumn("h", F.xxhash64("key", "source"))
    h = h.withColumn("bucket", F.pmod(F.col("h"), F.ceil(F.col("all_docs") / PER_BUCKET).cast("long")))
    sums = h.groupBy("source", "bucket").agg(F.sum("tokens").alias("t"))
    # a row a bucket, PER_BUCKET documents each: small enough to be ordered in one task a source
    before = sums.select("source", "bucket", (F.sum("t").over(Window.partitionBy("source").orderBy("bucket")) - F.col("t")).alias("before"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "key")
    placed = h.join(before, ["source", "bucket"]).withColumn("start", F.col("before") + F.sum("tokens").over(inside) - F.col("tokens"))
    # every repetition is the same stream again, as far as the source's part goes
    placed = placed.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("whole"))))
    placed = placed.withColumn("place", F.col("start") + (F.col("repeat") - 1).cast("long") * F.col("all_tokens")).where(F.col("place") < F.col("take"))
    placed = placed.withColumn("block", F.floor(F.col("place") / block_tokens)).withColumn("nth", F.pmod("block", "slots"))
    out = placed.join(F.broadcast(slot_of), ["source", "nth"])
    return out.select("key", "source", "repeat", "block", (F.floor(F.col("block") / F.col("slots")) * slots + F.col("at")).alias("slot"), "place", "tokens")


def plan_of(sizes: DataFrame, targets: DataFrame, slots: int | None = None) -> list[dict]:
    """Per present and targeted source: tokens, docs, slots, take (tokens in the whole) and whole (repetitions begun).

    sizes has one row a source (at most MAX_SOURCES of them meet a target; checked), so this is a small list."""
    t = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
    rows = sizes.join(t, "source").where("tokens > 0").orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    if not rows:
        return []
    counts = slots_of({r["source"]: r["share"] for r in rows}, slots)
    slots = sum(counts.values())
    whole = min(Fraction(r["tokens"] * r["repeats"] * slots, counts[r["source"]]) for r in rows)
    plan = []
    for r in rows:
        take = int(whole * counts[r["source"]] / slots)
        plan.append({"source": r["source"], "tokens": r["tokens"], "docs": r["docs"], "slots": counts[r["source"]], "take": take, "whole": -(-take // r["tokens"]), "share": r["share"]})
    return plan


def mix_report(mixed: DataFrame, source: str, targets: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Per target: target_share, max_repeats, tokens and documents in the whole, repeats (the most any document has), actual_share, and
    furthest_off: how many blocks the order is ahead of or behind the shares of the sources there are, at worst, after any slot.

    documents (counted_documents): also the tokens the source has and how many of its documents and tokens were not taken.
    """
    got = mixed.groupBy(source).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"), F.max("repeat").alias("repeats"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    # the targets are few (plan_of checks it), so their sums over one window are
    all_ = Window.partitionBy(F.lit(0))
    out = targets.select(F.col("source").alias(source), "target_share", "max_repeats").join(got, source, "left")
    share = F.col("tokens") / F.sum("tokens").over(all_)
    weight = F.when(F.col("tokens") > 0, F.col("target_share")) / F.sum(F.when(F.col("tokens") > 0, F.col("target_share"))).over(all_)
    out = out.withColumn("_share", share).withColumn("_weight", weight)
    blocks = mixed.select(source, "block", "slot").distinct().join(F.broadcast(out.select(source, "_weight")), source)
    off = blocks.groupBy(source).agg(F.max(F.greatest(F.col("_weight") * F.col("slot") - F.col("block"), F.col("block") + 1 - F.col("_weight") * (F.col("slot") + 1))).alias("furthest_off"))
    out = out.join(off, source, "left")
    columns = [source, "target_share", "max_repeats", zero("tokens"), zero("documents"), zero("repeats"), F.coalesce(F.round("_share", 6), F.lit(0.0)).alias("actual_share"), F.round("furthest_off", 3).alias("furthest_off")]
    if documents is not None:
        has = documents.groupBy(F.col("source").alias(source)).agg(F.sum("tokens").alias("_has"), F.count("*").alias("_docs"))
        once = mixed.where("repeat = 1").groupBy(source).agg(F.sum("tokens").alias("_used"), F.count("*").alias("_used_docs"))
        out = out.join(has, source, "left").join(once, source, "left")
        left = lambda a, b: F.coalesce(F.col(a), F.lit(0)) - F.coalesce(F.col(b), F.lit(0))
        columns += [F.coalesce("_has", F.lit(0)).alias("source_tokens"), left("_has", "_used").alias("tokens_not_taken"), left("_docs", "_used_docs").alias("documents_not_taken")]
    return out.select(*columns)
