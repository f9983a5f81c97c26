"""Near-duplicate records with small edits: circulant MinHash, banding, exact Jaccard verification.

Only two permutations are used: sigma spreads the words once, pi is applied to them shifted by k for coordinate k.
Both are fixed bijections of 32-bit numbers (a shift is an addition modulo 2^32), so neither needs a table.

Records of equal word sets are one representative from the start. Buckets are combined before the shuffle: of the records
of a batch that share a bucket only the first goes on, the others are tied to it, so a bucket that holds any part of the
rows costs a row a batch. What is shuffled are packed columns of numbers, a row a batch and part, not a row a record and band.
In every bucket each record is compared with the bucket's first one (the pivot). Where that leaves several groups in a bucket, its members of different groups are compared as well, joined by a
rare word that any two sets above the threshold must share (prefix filtering, which loses nothing). Buckets of all sizes
go the same way. No side that follows the data is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm.components import connected_components
from corvina.llm.lookalike import words
from corvina.session import cut, shuffled

THRESHOLD = 0.7
LEAST_WORDS = 10
#: A pair at the threshold 0.7 meets in some band with probability 1 - (1 - 0.7^8)^90 = 0.995, at 0.75 with 0.9999.
BANDS, ROWS = 90, 8
#: Members of a group are compared in parts of about this many, so that a large group is many tasks.
PART = 512
#: Rows of (bucket, record) that one task sorts at a time, 16 bytes each.
PACKED = 2_000_000


def _mix(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A bijection of 32-bit numbers: multiplications by odd numbers and shifted exclusive ors."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(a)
    x ^= x >> np.uint32(15)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def circulant_signature(flat: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """The k coordinates of each set; flat holds 32-bit words of all sets, starts where each (non-empty) set begins."""
    spread = _mix(flat.astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    out = np.empty((k, len(starts)), dtype=np.uint32)
    for i in range(k):
        out[i] = np.minimum.reduceat(_mix(spread + np.uint32(i), 0x21F0AAAD, 0xD35A2D97), starts)
    return out


def band_keys(flat: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """For each set of 64-bit words its bands' 64-bit keys, the band's number mixed in; arguments as in circulant_signature."""
    half = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
    sig = circulant_signature(half, starts, bands * rows).astype(np.uint64)
    keys = np.empty((len(starts), bands), dtype=np.uint64)
    for b in range(bands):
        h = np.full(len(starts), b + 1, dtype=np.uint64)
        for r in range(rows):
            h = (h ^ sig[b * rows + r]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        keys[:, b] = h
    return keys


def word_sets(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and words: the distinct words as sorted 64-bit hashes. Null and empty text: an empty set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "_w": [" ".join(dict.fromkeys(words(t))) for t in b["_text"]]})

    kind = dict(df.dtypes)[key]
    folded = df.select(key, F.col(text).alias("_text")).mapInPandas(run, f"`{key}` {kind}, _w string")
    split = F.when(F.col("_w") == "", F.array().cast("array<string>")).otherwise(F.split("_w", " "))
    return folded.select(key, F.array_sort(F.array_distinct(F.transform(split, lambda w: F.xxhash64(w)))).alias("words"))


def _first_of(bucket: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted buckets: whether each row is the first of its bucket, and the id of that first one."""
    new = np.concatenate([[True], bucket[1:] != bucket[:-1]])
    return new, ids[np.maximum.accumulate(np.where(new, np.arange(len(bucket)), 0))]


def shared_buckets(sets: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """bucket, pivot, id: ties that hold each bucket of several records together; a record alone in a bucket has none.

    sets: id long, words array of 32- or 64-bit numbers, not empty. Parts of buckets have about PACKED rows each, so their
    number follows the input and a task's memory does not.
    """
    parts = max(sets.sparkSession.sparkContext.defaultParallelism, -(-sets.count() * bands // PACKED))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, b in enumerate(batches):
            if not b.num_rows:
                continue
            b = b.sort_by("id")
            lists, ids = b.column("words"), b.column("id").to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            starts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))[:-1]]).astype(np.int64)
            bucket = band_keys(flat, starts, bands, rows).ravel()
            order = np.argsort(bucket, kind="stable")  # ids are in order, so they are within a bucket, too
            bucket, ids = bucket[order], ids[order // bands]
            new, first = _first_of(bucket, ids)
            ties = np.concatenate([bucket[~new].view(np.int64), first[~new], ids[~new]])
            bucket, ids = bucket[new], ids[new]
            ends = np.searchsorted(((bucket >> np.uint64(33)) * np.uint64(parts)) >> np.uint64(31), np.arange(parts + 1, dtype=np.uint64))
            blobs = [np.concatenate([bucket[x:y].view(np.int64), ids[x:y]]).tobytes() for x, y in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([*range(parts), n % parts], pa.int32()), pa.array([False] * parts + [True]), pa.array([*blobs, ties.tobytes()], pa.binary())], ["part", "tied", "blob"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(bucket, pivot, id_):
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (bucket, pivot, id_)], ["bucket", "pivot", "id"])

        keys, owners = [], []
        for b in batches:
            for tied, blob in zip(b.column("tied").to_pylist(), b.column("blob")):
                x = np.frombuffer(blob.as_buffer(), dtype=np.int64)
                if tied:
                    yield out(*x.reshape(3, -1))
                else:
                    keys.append(x[: len(x) // 2])
                    owners.append(x[len(x) // 2 :])
        if keys and sum(map(len, keys)):
            bucket, ids = np.concatenate(keys), np.concatenate(owners)
            order = np.lexsort((ids, bucket))
            bucket, ids = bucket[order], ids[order]
            new, first = _first_of(bucket, ids)
            yield out(bucket[~new], first[~new], ids[~new])

    packed = sets.select("id", "words").mapInArrow(pack, "part int, tied boolean, blob binary")
    return packed.repartition(parts, "part").select("tied", "blob").mapInArrow(unpack, "bucket long, pivot long, id long")


def similar_pairs(sets: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Links (a, b, jaccard), a < b, that connect all sets that meet in a bucket and whose Jaccard similarity reaches the threshold.

    sets: id long, words (array of numbers, distinct, not empty). Two members of a bucket that are already linked through
    others need no link of their own: the links have the connected components of all similar pairs, not all of these.
    """
    held = cut(shared_buckets(sets, bands, rows))

    def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        a, b = (sets.select(F.col("id").alias(s), F.col("words").alias(f"w{s}")) for s in "ab")
        got = pairs.distinct().join(shuffled(a), "a").join(shuffled(b), "b")
        both = F.size(F.array_intersect("wa", "wb"))
        return got.select("a", "b", (both / (F.size("wa") + F.size("wb") - both)).alias("jaccard")).where(F.col("jaccard") >= threshold)

    stars = cut(verified(held.select(F.least("pivot", "id").alias("a"), F.greatest("pivot", "id").alias("b")), sets))
    # equal labels: certainly linked; two steps of the least label are enough to spare most comparisons
    ends = stars.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(stars.select(F.col("b").alias("u"), F.col("a").alias("v")))
    label = ends.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("l"))
    label = ends.join(shuffled(label.select(F.col("u").alias("v"), "l")), "v").groupBy("u").agg(F.min("l").alias("g"))
    member = held.select("bucket", "id").unionByName(held.select("bucket", F.col("pivot").alias("id"))).distinct()
    member = cut(member.join(shuffled(label.select(F.col("u").alias("id"), "g")), "id", "left").select("bucket", "id", F.coalesce("g", "id").alias("g")))
    # two members: the pivot's comparison was the only one; one label: nothing is left to find
    open_ = member.groupBy("bucket").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.count("*").alias("n")).where("n > 2 and lo <> hi").select("bucket", "lo")
    member = cut(member.join(shuffled(open_), "bucket").select("bucket", "id", "g", (F.col("g") != F.col("lo")).alias("loose")))
    # in the order of rarity, of two sets above the threshold the larger has one of its first size - ceil(threshold * size) + 1 words
    # among the first size - ceil(2 threshold / (1 + threshold) * size) + 1 of the smaller
    inside = cut(sets.join(shuffled(member.select("id").distinct()), "id", "left_semi").select("id", "words"))
    used = inside.select("id", F.size("words").alias("size"), F.explode("words").alias("w"))
    rare = used.groupBy("w").agg(F.count("*").alias("df"))
    first = lambda share: (F.col("size") - F.ceil(F.col("size") * share - 1e-9) + 1).cast("int")
    # the words of one set, bounded by its own text; sorted per set, not per bucket
    prefix = (
        used.join(shuffled(rare.where("df > 1")), "w", "left").groupBy("id", "size").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "w"))).alias("ws"))
        .select("id", "size", F.posexplode(F.slice("ws", F.lit(1), first(threshold))).alias("at", "x"))
        .where("x.df > 1").select("id", "size", F.col("x.w").alias("w"), (F.col("at") < first(2 * threshold / (1 + threshold))).alias("short"))
    )
    spread = cut(member.join(shuffled(prefix), "id"))
    small = spread.where("short").select("bucket", "w", F.col("id").alias("a"), F.col("g").alias("ga"), F.col("size").alias("na"), F.col("loose").alias("la"))
    large = spread.select("bucket", "w", F.col("id").alias("b"), F.col("g").alias("gb"), F.col("size").alias("nb"), F.col("loose").alias("lb"))
    # members of the bucket's main group need not meet one another, so one side is always of the others
    met = small.where("la").join(shuffled(large), ["bucket", "w"]).unionByName(small.where("not la").join(shuffled(large.where("lb")), ["bucket", "w"]))
    across = met.where((F.col("ga") != F.col("gb")) & (F.col("na") <= F.col("nb")) & (F.col("na") >= F.col("nb") * threshold - 1e-9)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return stars.unionByName(verified(across, inside)).groupBy("a", "b").agg(F.max("jaccard").alias("jaccard"))


def links_within(member: DataFrame, threshold: float = THRESHOLD, part: int = PART) -> DataFrame:
    """same and links: of each set how many others of its group reach the threshold, all pairs of a group compared.

    member: group_id, same (one per set), words. Sets without a link have no row. A group is dealt to parts, and each two
    parts meet once: the work grows with the square of a group, but no task with more than two parts.
    """
    parts = member.groupBy("group_id").agg(F.ceil(F.count("*") / part).cast("int").alias("parts")).join(shuffled(member), "group_id")
    parts = parts.withColumn("part", F.pmod(F.xxhash64("same"), F.col("parts")).cast("int"))
    side = lambda s, meets: parts.select("group_id", F.col("part").alias(f"p{s}"), F.explode(meets).alias(f"p{'b' if s == 'a' else 'a'}"), F.col("same").alias(s), F.col("words").alias(f"w{s}"))
    a, b = side("a", F.sequence("part", F.col("parts") - 1)), side("b", F.sequence(F.lit(0), "part"))
    both = F.size(F.array_intersect("wa", "wb"))
    alike = both / (F.size("wa") + F.size("wb") - both) >= threshold
    met = a.join(shuffled(b), ["group_id", "pa", "pb"]).where((F.col("pa") < F.col("pb")) | (F.col("a") < F.col("b"))).where(alike)
    return met.select(F.explode(F.array("a", "b")).alias("same")).groupBy("same").agg(F.count("*").alias("links"))


def near_duplicate_groups(df: DataFrame, key: str, text: str, threshold: float = THRESHOLD, least_words: int = LEAST_WORDS, bands: int = BANDS, rows: int = ROWS, with_links: bool = True) -> DataFrame:
    """One row per record of at least least_words distinct words: key, group_id (least key of its group), links.

    links: other word sets of the group that reach the threshold with this one, all compared (links_within), plus other
    records of the same set; without with_links the column is left out and so is its work. Records with fewer words, null or empty text or
    a null key are not in the result. A repeated row counts once; a key (a long) with different texts is a record in the
    groups of each. Groups do not depend on the order of rows. Other columns are ignored, whatever their names.
    """
    records = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    sets = word_sets(records, "id", "text").where(F.size("words") >= least_words)
    # a set is known by 128 bits from here on; its words travel once
    same = ["s1", "s2"]
    sets = cut(sets.select("id", F.xxhash64("words", F.lit(17)).alias("s1"), F.xxhash64("words", F.lit(5)).alias("s2"), "words"))
    classes = cut(sets.groupBy(*same, "words").agg(F.min("id").alias("rep")))
    ids = sets.select("id", *same).distinct()
    links = cut(similar_pairs(classes.select(F.col("rep").alias("id"), "words"), threshold, bands, rows))
    groups = connected_components(links, "a", "b")
    of_class = classes.join(shuffled(groups.withColumnRenamed("id", "rep")), "rep", "left").withColumn("group_id", F.coalesce("group_id", "rep"))
    if not with_links:
        return ids.join(shuffled(of_class.select(*same, "group_id")), same).select(F.col("id").alias(key), "group_id")
    of_class = cut(of_class)
    linked = of_class.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1").select("group_id")
    degree = links_within(of_class.join(shuffled(linked), "group_id", "left_semi").select("group_id", F.col("rep").alias("same"), "words"), threshold)
    copies = ids.groupBy(*same).agg(F.count("*").alias("copies"))
    of_class = of_class.join(shuffled(degree.withColumnRenamed("same", "rep")), "rep", "left").join(shuffled(copies), same)
    of_class = of_class.select(*same, "group_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    return ids.join(shuffled(of_class), same).select(F.col("id").alias(key), "group_id", "links")
