"""Evidence, audits, families, caches and orders around the catalogue, as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvina.operators.grouping import linked_groups
from corvina.plans.detail import evidence_at
from corvina.session import shuffled


def words_in(text: Column, stop: Sequence[str] = (), other_names: dict[str, str] | None = None) -> Column:
    """The meaning words of a normalized text, each once, sorted: of two characters or more, no bare numbers, no stop words,
    types under one name."""
    words = F.split(F.coalesce(text, F.lit("")), " ")
    if other_names:
        names = F.create_map(*[F.lit(x) for kv in other_names.items() for x in kv])
        words = F.transform(words, lambda w: F.coalesce(F.try_element_at(names, w), w))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(list(stop)) & ~w.rlike("^[0-9]+$"))))


def share_of(words: Column, there: Column) -> Column:
    """How much of the words is there, 0 to 1; nothing of no words."""
    return F.when(F.size(words) > 0, F.size(F.array_intersect(words, there)) / F.size(words)).otherwise(0.0)


def overlap_score(brand: Column, name: Column, text: Column, brand_weight: float = 0.3) -> Column:
    """How much of a brand's and a name's words a text has; the rest of the weight is the name's."""
    return brand_weight * share_of(brand, text) + (1 - brand_weight) * share_of(name, text)


def evidence_facts(mentions: DataFrame, posts: DataFrame) -> DataFrame:
    """id, found, start, line (of the evidence in the caption), brand_there, name_there: what the text bears out about a mention.

    mentions: id, post_id, brand, name, evidence; posts: post_id, caption. Blank brands and names are not there; a mention of a
    post that is missing has found null.
    """
    x = mentions.join(posts.select("post_id", "caption"), "post_id", "left")
    at = evidence_at(F.col("caption"), F.col("evidence"))
    there = lambda part, text: (F.coalesce(F.trim(part), F.lit("")) != "") & (F.instr(F.coalesce(text, F.lit("")), part) > 0)
    return x.select(
        "id", F.when(F.col("caption").isNotNull(), F.coalesce(at["found"], F.lit(False))).alias("found"), at["start"].alias("start"), at["line"].alias("line"),
        F.coalesce(there(F.col("brand"), F.col("caption")), F.lit(False)).alias("brand_there"), F.coalesce(there(F.col("name"), F.col("evidence")), F.lit(False)).alias("name_there"),
    )


def reusable(matches: DataFrame, posts: DataFrame, mentions: DataFrame, least: float = 0.97) -> DataFrame:
    """post_id, source_id, mentions: posts of one platform whose mentions can be taken from the strongly matched post of another.

    Strong: an exact match, or a similarity of at least least; of several the most similar, then the least source counts. The source
    must have mentions, all approved. matches: post_id_a, post_id_b, match_type, similarity (undirected); posts: id, platform; mentions:
    post_id, status. The posts served are Instagram's, the sources TikTok's.
    """
    strong = matches.where((F.col("match_type") == "exact") | (F.col("similarity") >= least))
    both = strong.select(F.col("post_id_a").alias("post_id"), F.col("post_id_b").alias("source_id"), "match_type", "similarity")
    both = both.unionByName(strong.select(F.col("post_id_b").alias("post_id"), F.col("post_id_a").alias("source_id"), "match_type", "similarity"))
    of = lambda platform, name: posts.where(F.col("platform") == platform).select(F.col("id").alias(name))
    both = both.join(of("instagram", "post_id"), "post_id", "left_semi").join(of("tiktok", "source_id"), "source_id", "left_semi")
    good = mentions.groupBy(F.col("post_id").alias("source_id")).agg(F.count("*").alias("mentions"), F.bool_and(F.col("status") == "approved").alias("_all")).where("_all")
    rank = F.struct((F.col("match_type") == "exact").cast("int"), F.coalesce("similarity", F.lit(0.0)), -F.col("source_id"))
    best = both.join(good, "source_id").groupBy("post_id").agg(F.max_by(F.struct("source_id", "mentions"), rank).alias("x"))
    return best.select("post_id", "x.source_id", "x.mentions")


def replace_automatic(matches: DataFrame, new: DataFrame, window: DataFrame, automatic: Sequence[str] = ("exact", "near")) -> DataFrame:
    """matches without the automatic ones of the window's posts (id), and with new: matches made by hand and those of other posts stay."""
    auto, posts = F.col("match_type").isin(list(automatic)), window.select(F.col("id").alias("post_id_a")).distinct()
    stays = matches.where(auto).join(shuffled(posts), "post_id_a", "left_anti").select(*matches.columns)
    return matches.where(~F.coalesce(auto, F.lit(False))).unionByName(stays).unionByName(new, allowMissingColumns=True)


def reconciled_families(pairs: DataFrame, members: DataFrame, prefix: str = "reconciled-exact-") -> DataFrame:
    """product_id, family_key, action: families of safe pairs (id_a, id_b), chains and all. members: product_id, family_key (one each).

    A group that touches one family joins it; one that touches none founds one named by its least id; one that touches several
    is left to a person (action conflict, no family). Running it again on its own result changes nothing. Null ends are no pairs.
    """
    group = linked_groups(pairs, "id_a", "id_b").select(F.col("id").alias("product_id"), F.col("group").alias("_g"))
    x = group.join(shuffled(members.where("family_key is not null").select("product_id", F.col("family_key").alias("_f"))), "product_id", "left")
    of = x.groupBy("_g").agg(F.count_distinct("_f").alias("_n"), F.min("_f").alias("_one"))
    x = x.join(shuffled(of), "_g")
    key = F.when(F.col("_n") == 1, F.col("_one")).when(F.col("_n") == 0, F.concat(F.lit(prefix), F.col("_g")))
    action = F.when(F.col("_n") > 1, "conflict").when(F.col("_f").isNotNull(), "kept").when(F.col("_n") == 1, "joined").otherwise("founded")
    return x.select("product_id", F.when(F.col("_n") > 1, F.col("_f")).otherwise(key).alias("family_key"), action.alias("action"))


def shown_groups(posts: DataFrame, edges: DataFrame) -> DataFrame:
    """product_id, group_id, post_id (the one shown), members: posts of a product that are one piece of content on several platforms.

    posts: product_id, post_id, approved, relationship, summary, platform; edges: product_id, post_id_a, post_id_b. Posts without an
    edge are groups of one. Shown is the one with an approved, meaningful context that says something, then TikTok's, then the least id.
    A post listed twice for a product counts once (the better row).
    """
    meaning = F.col("approved") & ~F.coalesce(F.col("relationship"), F.lit("")).isin("", "mention_only") & (F.coalesce(F.trim("summary"), F.lit("")) != "")
    p = posts.groupBy("product_id", "post_id").agg(F.max(F.struct(F.coalesce(meaning, F.lit(False)).cast("int").alias("q"), (F.col("platform") == "tiktok").cast("int").alias("t"))).alias("r"))
    node = lambda c: F.struct("product_id", F.col(c).alias("post_id"))
    group = linked_groups(edges.select(node("post_id_a").alias("a"), node("post_id_b").alias("b")), "a", "b")
    group = group.select("id.product_id", "id.post_id", F.col("group.post_id").alias("group_id"))
    x = p.join(shuffled(group), ["product_id", "post_id"], "left").withColumn("group_id", F.coalesce("group_id", "post_id"))
    rank = F.struct("r.q", "r.t", -F.col("post_id"))
    return x.groupBy("product_id", "group_id").agg(F.max_by("post_id", rank).alias("post_id"), F.count("*").alias("members"))


def cache_states(wanted: DataFrame, done: DataFrame, memory: DataFrame, key: str, digest: str) -> DataFrame:
    """key, digest, state: cached if done holds the key with this digest, restored if memory knows the digest, else pending."""
    x = wanted.select(key, digest).join(shuffled(done.select(key, digest).distinct().withColumn("_done", F.lit(True))), [key, digest], "left")
    x = x.join(shuffled(memory.select(digest).distinct().withColumn("_known", F.lit(True))), digest, "left")
    return x.select(key, digest, F.when(F.col("_done"), "cached").when(F.col("_known"), "restored").otherwise("pending").alias("state"))


def audit(findings: Sequence[tuple[str, str, DataFrame]]) -> DataFrame:
    """id, rule, severity of named findings (rule, severity, rows with id), each once; severities sort high, medium, low."""
    out = None
    for rule, severity, rows in findings:
        f = rows.select("id", F.lit(rule).alias("rule"), F.lit(severity).alias("severity")).distinct()
        out = f if out is None else out.unionByName(f)
    return out


def restored_ids(rows: DataFrame, old: DataFrame, new: DataFrame, column: str, identity: str) -> DataFrame:
    """rows with column's old ids replaced by the new table's, over the identity both share (the least new id of one); what has no new
    id gets null. old and new: id, identity; null identities meet nothing."""
    now = new.where(F.col(identity).isNotNull()).groupBy(identity).agg(F.min("id").alias("_new"))
    way = old.where(F.col(identity).isNotNull()).select(F.col("id").alias(column), identity).distinct().join(shuffled(now), identity).groupBy(column).agg(F.min("_new").alias("_new"))
    return rows.join(shuffled(way), column, "left").withColumn(column, F.col("_new")).drop("_new")


def settled_results(candidates: DataFrame, results: DataFrame, key: str, position: str, defaults: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Every candidate with its first result, or with defaults; and the results that are refused: position, reason (unknown or duplicate)."""
    known = candidates.select(key).distinct()
    marked = results.join(shuffled(known.withColumn("_ok", F.lit(True))), key, "left")
    nth = F.row_number().over(Window.partitionBy(key).orderBy(position))
    marked = marked.withColumn("_nth", nth)
    refused = marked.where("_ok is null or _nth > 1").select(position, F.when(F.col("_ok").isNull(), "unknown").otherwise("duplicate").alias("reason"))
    first = marked.where("_ok and _nth = 1").drop("_ok", "_nth")
    out = known.join(shuffled(first.withColumn("_there", F.lit(True))), key, "left")
    return out.withColumns({c: F.when(F.col("_there"), F.col(c)).otherwise(v) for c, v in defaults.items()}).drop("_there"), refused


def text_counts(text: Column) -> list[Column]:
    """characters, lines and words of a text; a null is empty, an empty text has no line."""
    t = F.coalesce(text, F.lit(""))
    lines = F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1)
    words = F.size(F.filter(F.split(t, "[ \\t\\n\\r]+"), lambda w: w != ""))
    return [F.length(t).alias("characters"), lines.alias("lines"), words.alias("words")]


def known_language(language: Column, supported: Sequence[str] = ("tr", "en"), default: str = "tr") -> Column:
    v = F.lower(F.trim(F.coalesce(language, F.lit(""))))
    return F.when(v.isin(list(supported)), v).otherwise(default)
