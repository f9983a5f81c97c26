"""What a product's page shows, and the small steps of the pipeline around it, as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvina.functions.normalize import normalize
from corvina.operators.keep import best_merged, keep_first, top_n

POINTS = "array<struct<claim:string,polarity:string,evidence_text:string>>"


def overlay(rows: DataFrame, translations: DataFrame, key: str, language: str, columns: Sequence[str]) -> DataFrame:
    """Columns in a language where there is a translation, else as they are. translations: key, language, columns; unique per
    key and language. The language filters the right side before the join, so no row is lost."""
    t = translations.where(F.col("language") == language).select(F.col(key).alias("_k"), *[F.col(c).alias(f"_t_{c}") for c in columns])
    out = rows.join(t, F.col(key) == F.col("_k"), "left")
    return out.withColumns({c: F.coalesce(f"_t_{c}", c) for c in columns}).drop("_k", *[f"_t_{c}" for c in columns])


def opinion_points(comments: DataFrame, key: str, order: str, raw: str) -> DataFrame:
    """The points of comments' JSON lists: key, claim, polarity, evidence_text, each claim of a polarity once, as first
    spelled. A polarity that is none counts as neutral; bad JSON and blank claims give no point."""
    p = comments.select(key, F.col(order).alias("_o"), F.posexplode(F.coalesce(F.from_json(raw, POINTS), F.array().cast(POINTS))).alias("_i", "_p"))
    pol = F.lower(F.trim("_p.polarity"))
    p = p.select(key, F.struct("_o", "_i").alias("_at"), F.trim("_p.claim").alias("claim"), F.when(pol.isin("positive", "negative"), pol).otherwise("neutral").alias("polarity"), F.trim(F.coalesce("_p.evidence_text", F.lit(""))).alias("evidence_text"))
    p = p.where("claim <> ''").withColumn("_c", normalize("claim", "keyword"))
    return keep_first(p, [key, "polarity", "_c"], "_at").select(key, "claim", "polarity", "evidence_text")


def translated_points(points: Column, claims: Column) -> Column:
    """Points with their claims replaced in order by translated ones; points without a claim stay and use none up. points: an
    array of structs with claim. Null if the numbers differ."""
    filled = lambda p: F.coalesce(F.trim(p["claim"]), F.lit("")) != ""
    # which of the filled claims each point is
    nth = F.aggregate(points, F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + filled(p).cast("int"))))
    new = F.transform(points, lambda p, i: F.when(filled(p), p.withField("claim", F.try_element_at(claims, F.element_at(nth, i + 2)))).otherwise(p))
    return F.when(F.size(F.filter(points, filled)) == F.size(claims), new)


def creator_presence(mentions: DataFrame) -> DataFrame:
    """Per product and creator on which platforms there is something. mentions: product_id, influencer_slug, display_name,
    platform. One grouped pass instead of a query per card."""
    on = lambda p: F.bool_or(F.col("platform") == p).alias(f"has_{p}")
    return mentions.groupBy("product_id", "influencer_slug").agg(F.max("display_name").alias("display_name"), on("youtube"), on("tiktok"), on("instagram"))


def shown_links(links: DataFrame) -> DataFrame:
    """The links a product shows: those of retailers, else its first official one; a merchant's variant once. links:
    product_id, link_type, merchant_slug, variant_label, position."""
    w = Window.partitionBy("product_id")
    kept = links.where("link_type in ('retailer', 'official_brand')").withColumn("_r", F.max(F.col("link_type") == "retailer").over(w))
    retail = keep_first(kept.where("_r and link_type = 'retailer'").withColumn("variant_label", F.coalesce("variant_label", F.lit(""))), ["product_id", "merchant_slug", "variant_label"], "position")
    official = top_n(kept.where("not _r"), ["product_id"], [F.col("position")], 1).withColumn("variant_label", F.coalesce("variant_label", F.lit("")))
    return retail.unionByName(official).drop("_r")


def propagated_links(links: DataFrame, members: DataFrame) -> DataFrame:
    """Every link of a family on every member: product_id, merchant_slug, url, the most confident kept and its gaps filled.
    links: family_id, merchant_slug, url, confidence, position, ...; members: family_id, product_id."""
    return best_merged(links.join(members.select("family_id", "product_id"), "family_id"), ["product_id", "merchant_slug", "url"], "confidence", "position")


def learned_domains(links: DataFrame, brand: str, host: str) -> DataFrame:
    """Per brand the domains of its verified official links, sorted."""
    return links.where("status = 'verified' and link_type = 'official_brand'").groupBy(brand).agg(F.sort_array(F.collect_set(host)).alias("domains"))


def best_metadata(df: DataFrame) -> DataFrame:
    """The best file per video: description there, longer, transcript there, later; ties to the first path. df: video_id,
    description_retrieved, description, transcript_status, metadata_retrieved_at, file."""
    d = df.where("coalesce(trim(video_id), '') <> ''")
    rank = [F.coalesce("description_retrieved", F.lit(False)).cast("int"), F.length(F.coalesce("description", F.lit(""))), (F.coalesce("transcript_status", F.lit("")) == "available").cast("int"), F.coalesce("metadata_retrieved_at", F.lit(""))]
    first = d.groupBy("video_id").agg(F.max(F.struct(*rank)).alias("_b"))
    return keep_first(d.join(first, "video_id").where(F.struct(*rank) == F.col("_b")).drop("_b"), ["video_id"], "file")


def numbered(df: DataFrame, keys: Sequence[str], order: str, label: str, pattern: str = "P%03d") -> DataFrame:
    """Sequential labels per key, in order."""
    return df.withColumn(label, F.format_string(pattern, F.row_number().over(Window.partitionBy(*keys).orderBy(order))))


def batches(df: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """Rows dealt into batches of about size, by a hash of their key: no order over all rows is needed."""
    n = df.count()
    return df.withColumn("batch", F.pmod(F.xxhash64(*order), F.lit(max(1, -(-n // size)))))


def evidence_at(text: Column, part: Column) -> Column:
    """Where a part stands in a text: found, start (code points, from 0), line (from 1). Blank parts stand nowhere."""
    at = F.when(F.coalesce(F.trim(part), F.lit("")) != "", F.instr(text, part)).otherwise(0)
    before = F.substring(text, F.lit(1), at - 1)
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    return F.struct((at > 0).alias("found"), F.when(at > 0, at - 1).alias("start"), F.when(at > 0, line).alias("line"))


def joined_snippets(parts: Column) -> Column:
    """Snippets in order as one text: blank and repeated ones go, and a beginning that repeats the one kept before (of more
    than twenty characters) is left out. parts: array of cleaned texts. A fold, as each is held against the last kept."""
    state = F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, p: Column) -> Column:
        last = acc["last"]
        cut = F.when((F.length(last) > 20) & p.startswith(last), F.trim(F.substring(p, F.length(last) + 1, F.length(p)))).otherwise(p)
        skip = F.coalesce(p, F.lit("")).isin("") | (p == last) | (cut == "")
        return F.struct(F.when(skip, last).otherwise(cut).alias("last"), F.when(skip, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(cut))).alias("kept"))

    text = F.array_join(F.aggregate(parts, state, step)["kept"], " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s+([,.!?;:])", "$1"), r"[ \t]+", " "))


def advanced_watermark(state: DataFrame, results: DataFrame) -> DataFrame:
    """The next watermark per creator: the run's end if all its sources succeeded, else the old one. state: influencer_slug,
    watermark; results: influencer_slug, source, ok, run_end."""
    done = results.groupBy("influencer_slug").agg(F.bool_and("ok").alias("ok"), F.max("run_end").alias("run_end"))
    out = state.join(done, "influencer_slug", "full_outer")
    return out.select("influencer_slug", F.when(F.col("ok"), F.greatest("run_end", "watermark")).otherwise(F.col("watermark")).alias("watermark"))


