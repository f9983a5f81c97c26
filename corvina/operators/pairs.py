"""Joins on likeness within blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.functions.dates import days_apart
from corvina.functions.keys import comparable_brand, feature_words, numeric_words, protected_words
from corvina.functions.normalize import normalize
from corvina.functions.similarity import PlainTexts, ratio_can_reach, sequence_ratio_from
from corvina.session import cut, shuffled


def nearest_captions(left: DataFrame, right: DataFrame, block: str, threshold: float = 0.86, max_days: int = 3) -> DataFrame:
    """Per left post the most similar right post of its block: left_id, right_id, match_type, similarity, date_distance_days.

    Both: id, block column, caption, day (date or null). Equal normalized captions match whatever their dates, by an
    equi-join; only posts without one are compared further, with posts near in time (or of unknown date) whose length can
    reach the threshold. Near posts are met by day buckets: a day's bucket and the one before or after hold all within
    max_days. Ties: the nearer date, unknown dates last, then the least right id. Posts with empty captions never match.
    """
    cols = lambda d, s: d.select(F.col("id").alias(f"{s}_id"), F.col(block).alias("block"), normalize("caption", "caption").alias(f"{s}_text"), F.col("day").alias(f"{s}_day")).where(f"{s}_text <> ''")
    left_, right_ = cut(cols(left, "l")), cut(cols(right, "r"))
    exact = left_.join(right_, (left_["block"] == right_["block"]) & (F.col("l_text") == F.col("r_text"))).select("l_id", "r_id", F.lit("exact").alias("match_type"), F.lit(1.0).alias("similarity"), days_apart(F.col("l_day"), F.col("r_day")).alias("days"))
    open_ = left_.join(exact.select("l_id").distinct(), "l_id", "left_anti")
    width = max_days + 1
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / width)
    lefts = open_.withColumn("b", F.explode(F.when(F.col("l_day").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.array(bucket(F.col("l_day")) - 1, bucket(F.col("l_day")), bucket(F.col("l_day")) + 1))))
    rights = right_.withColumn("b", bucket(F.col("r_day")))
    dated = lefts.where("l_day is not null").join(rights, ["block", "b"])
    # posts of unknown date meet all of the block whose length can be near: by length classes, of which near ones are neighbours
    undated = _by_length(open_.where("l_day is null"), right_, threshold).unionByName(_by_length(open_.where("l_day is not null"), right_.where("r_day is null"), threshold))
    some = dated.drop("b").unionByName(undated.select(*[c for c in dated.columns if c != "b"]))
    some = some.withColumn("days", days_apart(F.col("l_day"), F.col("r_day"))).where((F.col("days").isNull() | (F.col("days") <= max_days)) & ratio_can_reach(F.col("l_text"), F.col("r_text"), threshold))
    near = some.withColumn("similarity", sequence_ratio_from(F.col("l_text"), F.col("r_text"), threshold)).where("similarity is not null").select("l_id", "r_id", F.lit("near").alias("match_type"), "similarity", "days")
    rank = F.struct(F.col("similarity"), -F.coalesce(F.col("days"), F.lit(999)), -F.col("r_id"))
    best = exact.unionByName(near).groupBy("l_id").agg(F.max_by(F.struct("r_id", "match_type", "similarity", "days"), rank).alias("x"))
    return best.select(F.col("l_id").alias("left_id"), F.col("x.r_id").alias("right_id"), F.col("x.match_type").alias("match_type"), F.col("x.similarity").alias("similarity"), F.col("x.days").alias("date_distance_days"))


def _by_length(lefts: DataFrame, rights: DataFrame, threshold: float) -> DataFrame:
    """Pairs of a block whose lengths allow the threshold, and some more. A class spans the greatest factor two such lengths can
    be apart, so they are in one class or in neighbouring ones; a hot block is spread over its classes."""
    span = (2 - threshold) / threshold
    of = lambda c: F.floor(F.log(F.length(c).cast("double")) / F.log(F.lit(span)) + 1e-9).cast("long")
    near = F.array(of("l_text") - 1, of("l_text"), of("l_text") + 1)
    return lefts.withColumn("_c", F.explode(near)).join(rights.withColumn("_c", of("r_text")), ["block", "_c"]).drop("_c")


def one_to_one(matches: DataFrame) -> DataFrame:
    """The best match per right post; the others go (nearest_captions decides for each left post alone)."""
    rank = F.struct(F.col("similarity"), -F.coalesce(F.col("date_distance_days"), F.lit(999)), -F.col("left_id"))
    rest = ["left_id", "match_type", "similarity", "date_distance_days"]
    best = matches.groupBy("right_id").agg(F.max_by(F.struct(*rest), rank).alias("x"))
    return best.select(F.col("x.left_id").alias("left_id"), "right_id", *[F.col(f"x.{c}").alias(c) for c in rest[1:]])


def match_faults(matches: DataFrame) -> DataFrame:
    """What is wrong in a match set, a row per match and fault: left_id, right_id, fault. The set itself stays as it is.

    matches: left_id, right_id, match_type, similarity, date_distance_days. Faults: an id missing (null or blank), a type
    other than exact and near, a similarity that is no number of 0 to 1, days below 0 (both may be null), a left or right
    post in more than one match. A repeated row is two matches.
    """
    used = lambda c: matches.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias(f"_{c}"))
    m = matches.join(used("left_id"), "left_id", "left").join(used("right_id"), "right_id", "left")
    no = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    faults = {
        "no id": no("left_id") | no("right_id"), "match type": ~F.coalesce(F.lower(F.trim("match_type")), F.lit("")).isin("exact", "near"),
        "similarity": ~F.col("similarity").between(0, 1), "days": F.col("date_distance_days") < 0,
        "left used again": F.col("_left_id") > 1, "right used again": F.col("_right_id") > 1,
    }
    return m.select("left_id", "right_id", F.explode(F.array_compact(F.array(*[F.when(c, name) for name, c in faults.items()]))).alias("fault"))


#: Forms of a brand compared with one another at once, and rows of a task.
FORMS_A_BLOCK, ROWS_A_GROUP = 2_000, 8_000
#: Forms that meet a block's others, and pairs that are compared, at once.
ROWS_AT_ONCE, PAIRS_AT_ONCE = 128, 1 << 18
REASONS = ["exact_normalized_tokens", "category_conflict", "variant_or_strength_conflict", "formula_or_type_conflict", "fuzzy_candidate"]


def similar_products(products: DataFrame, minimum: float = 67.0) -> DataFrame:
    """id_a < id_b of one brand with a word in common: decision, score, reason.

    products: id (each once), brand, product_name, category. Equal words in any order are safe; conflicts of category, of numbers
    (sizes, shades, strengths) or of types, and mere likeness go to review, those below the minimum score nowhere.

    Distinct forms (brand, words, category) are compared, all of a brand in blocks of bounded size: letters, then words in common,
    then common subsequences leave the pairs that are aligned, each for whole batches. No pair of products is built
    but the result's. Of a form with several products, and of two such forms, the products are paired by shuffle.
    """
    ident = dict(products.dtypes)["id"]
    p = products.select("id", comparable_brand(F.col("brand")).alias("b"), feature_words(F.col("product_name")).alias("w"), F.coalesce(F.lower(F.trim("category")), F.lit("")).alias("c")).where("b <> '' and size(w) > 0")
    p = cut(p.select("id", "b", F.array_join("w", " ").alias("text"), "c"))
    forms = cut(p.groupBy("b", "text", "c").agg(F.min("id").alias("first"), F.max("id").alias("last")))
    deal = cut(forms.groupBy("b").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / FORMS_A_BLOCK)))
    rows = deal.agg(F.sum(F.col("n") * F.col("parts")).alias("n")).first()["n"] or 0
    groups = max(1, -(-rows // ROWS_A_GROUP))
    f = forms.join(shuffled(deal), "b").withColumn("part", F.pmod(F.xxhash64("text", "c"), F.col("parts")))
    f = f.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    f = f.withColumns({"x": F.least("part", "other"), "y": F.greatest("part", "other"), "words": F.split("text", " ")})
    f = f.select("b", "x", "y", "part", "text", "c", "first", "last", F.array_join(numeric_words(F.col("words")), " ").alias("num"), F.array_join(protected_words(F.col("words")), " ").alias("typ"))
    f = f.withColumn("bucket", F.pmod(F.xxhash64("b", "x", "y"), F.lit(groups))).repartition(groups, "bucket")
    met = cut(f.groupBy("bucket").applyInPandas(lambda g: _alike(g, minimum), f"first {ident}, second {ident}, ratio double, reason int, several boolean"))

    several = forms.where("first < last")
    members = p.join(shuffled(several), ["b", "text", "c"]).select("first", "id")
    m = cut(members)
    of = lambda c, s: m.select(F.col("first").alias(c), F.col("id").alias(f"_{s}"))
    more = met.where("several").join(shuffled(of("first", "a")), "first", "left").join(shuffled(of("second", "b")), "second", "left")
    more = more.select(F.coalesce("_a", "first").alias("id_a"), F.coalesce("_b", "second").alias("id_b"), "ratio", "reason").where("id_a < id_b")
    equal = of("first", "a").join(shuffled(of("first", "b")), "first").where("_a < _b").select(F.col("_a").alias("id_a"), F.col("_b").alias("id_b"), F.lit(1.0).alias("ratio"), F.lit(0).alias("reason"))
    x = met.where("not several").select(F.col("first").alias("id_a"), F.col("second").alias("id_b"), "ratio", "reason").unionByName(more).unionByName(equal)
    decision = F.when(F.col("reason") == 0, "safe").otherwise("review")
    score = F.round(100 * F.col("ratio"), 1)
    return x.select("id_a", "id_b", decision.alias("decision"), score.alias("score"), F.array(*map(F.lit, REASONS))[F.col("reason")].alias("reason")).where((F.col("reason") == REASONS[0]) | (F.col("score") >= minimum))


def _alike(g: pd.DataFrame, minimum: float) -> pd.DataFrame:
    """first, second (least ids of two forms, in the order the products are compared), ratio, reason, and whether a form has
    several products; both orders where products of either come first. g: the forms of one or more blocks."""
    least = min((minimum - 0.06) / 100, 1.0) - 1e-12
    g = g.sort_values(["b", "x", "y", "part"], kind="stable", ignore_index=True)
    texts = g["text"].tolist()
    split = [t.split(" ") for t in texts]
    written, in_order = PlainTexts(texts), PlainTexts([" ".join(sorted(w)) for w in split])
    lengths, bags = written.lengths, written.bags()
    codes = {w: i for i, w in enumerate(dict.fromkeys(w for ws in split for w in ws))}
    signs = np.zeros((4, len(g)), dtype=np.uint64)
    for k, ws in enumerate(split):
        for h in {codes[w] % 256 for w in ws}:
            signs[h // 64, k] |= np.uint64(1 << h % 64)
    part = g["part"].to_numpy()
    block = (g[["b", "x", "y"]] != g[["b", "x", "y"]].shift()).any(axis=1).to_numpy().cumsum()
    begins = np.append(np.flatnonzero(np.diff(block, prepend=0)), len(g))
    met: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def compare(i: np.ndarray, j: np.ndarray) -> None:
        hit = (signs[0, i] & signs[0, j]) != 0
        for s in signs[1:]:
            hit |= (s[i] & s[j]) != 0
        i, j = i[hit], j[hit]
        n = lengths[i] + lengths[j]
        a, b = (2 * t.common(i, j) / n >= least for t in (written, in_order))
        hit = np.fromiter((not set(split[x]).isdisjoint(split[y]) for x, y in zip(i[a | b], j[a | b])), dtype=bool, count=int((a | b).sum()))
        keep = np.flatnonzero(a | b)[hit]
        i, j, a, b = i[keep], j[keep], a[keep], b[keep]
        # the order of two texts counts: that of the products' ids
        for x, y, which in ((i, j, first[i] < last[j]), (j, i, first[j] < last[i])):
            which = np.asarray(which, dtype=bool)
            x, y = x[which], y[which]
            best = np.zeros(len(x))
            for t, reach in ((written, a[which]), (in_order, b[which])):
                k = np.flatnonzero(reach)
                best[k] = np.maximum(best[k], t.ratios(x[k], y[k]))
            k = np.flatnonzero(best >= least)
            met.append((x[k], y[k], best[k]))

    first, last = g["first"].to_numpy(), g["last"].to_numpy()
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    for begin, end in zip(begins[:-1].tolist(), begins[1:].tolist()):
        # of two parts each form of one meets each of the other, within one part each meets those behind it
        middle = begin + int(np.searchsorted(part[begin:end], part[end - 1]))
        within = middle == begin
        if within and g["x"].iat[begin] != g["y"].iat[begin]:
            continue  # the other part is empty
        lefts, rights = (slice(begin, end), slice(begin, end)) if within else (slice(begin, middle), slice(middle, end))
        for i in range(lefts.start, lefts.stop, ROWS_AT_ONCE):
            x = slice(i, min(i + ROWS_AT_ONCE, lefts.stop))
            y = slice(i, rights.stop) if within else rights
            shared = np.zeros((x.stop - x.start, y.stop - y.start), dtype=bags.dtype)
            for bag in bags[1:]:
                if bag[x].any():
                    shared += np.minimum(bag[x, None], bag[None, y])
            need = np.ceil((np.arange(2 * int(lengths.max()) + 1)) * least / 2 - 1e-9).astype(np.int64)
            hit = shared >= need[lengths[x, None] + lengths[None, y]]
            if within:
                hit &= np.arange(x.start, x.stop)[:, None] < np.arange(y.start, y.stop)
            a, b = np.nonzero(hit)
            waiting.append((a + x.start, b + y.start))
            if sum(len(a) for a, _ in waiting) > PAIRS_AT_ONCE:
                compare(*map(np.concatenate, zip(*waiting)))
                waiting.clear()
    if waiting:
        compare(*map(np.concatenate, zip(*waiting)))
    i, j, best = map(np.concatenate, zip(*met)) if met else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
    same = np.array(pd.factorize(np.array(in_order.texts, dtype=object))[0])
    c, num, typ = (pd.factorize(g[x])[0] for x in ("c", "num", "typ"))
    spoken = (g["c"] != "").to_numpy() & (g["c"] != "other").to_numpy()
    clash = spoken[i] & spoken[j] & (c[i] != c[j])
    reason = np.select([clash, same[i] == same[j], num[i] != num[j], typ[i] != typ[j]], [1, 0, 2, 3], 4)
    several = np.asarray((first[i] < last[i]) | (first[j] < last[j]), dtype=bool)
    return pd.DataFrame({"first": first[i], "second": first[j], "ratio": best, "reason": reason, "several": several})
