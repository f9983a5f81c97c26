"""Core queries over the project's tables: views, roll-ups, joins, rankings, incremental steps."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.functions.dates import dashed, shown, to_day
from corvina.functions.keys import TYPE_NAMES, comparable_brand, feature_words, identity_key
from corvina.functions.links import canonical_url, domain, in_domain, merchant_name
from corvina.functions.nested import richness
from corvina.functions.normalize import normalize
from corvina.operators.compare import changed, count_delta, fingerprint, stale
from corvina.operators.grouping import linked_groups
from corvina.operators.keep import best_merged, distinct_in_order, keep_best, keep_first, top_n
from corvina.operators.merge import assign_ids, final_targets, ordered_pairs, remap, replace_children, upsert
from corvina.operators.pairs import match_faults, nearest_captions, similar_products
from corvina.plans import catalog as c
from corvina.plans.metadata import checked_posts
from corvina.session import cut, ensure_checkpoint_dir, table
from corvina.streaming.clicks import run_complete, stream_of, windowed_counts

# ---- what the SQL shares
P = "p as (select * exclude (rn) from (select *, row_number() over (partition by id order by updated_at desc) rn from products) where rn = 1)"
S = "s as (select * exclude (rn) from (select *, row_number() over (partition by id order by updated_at desc) rn from social_posts) where rn = 1)"
M = "m as (select distinct * from social_post_products)"
APPROVED = f"""{P}, {S}, {M}, a as (
  select m.id as mention_id, m.social_post_id, m.product_id, m.confidence, m.evidence_text, s.influencer_id, s.platform, s.external_post_id, s.original_url, s.published_at,
    i.slug as influencer_slug, i.display_name, p.brand, p.product_name, p.category
  from m join s on s.id = m.social_post_id join influencers i on i.id = s.influencer_id join p on p.id = m.product_id where m.status = 'approved')"""
CATALOGUE = f"""{APPROVED}, c as (
  select product_id, brand, product_name, category, sum(case when platform = 'tiktok' then 1 else 0 end)::bigint as review_count, sum(case when platform <> 'tiktok' then 1 else 0 end)::bigint as social_post_count,
    count(distinct influencer_slug) as influencer_count from a group by all)"""
ASCII = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
RANK = f"influencer_count desc, review_count desc, social_post_count desc, {ASCII.format('brand')}, {ASCII.format('product_name')}, product_id"
#: The identity chain in SQL, for texts without compatibility characters.
N1 = "replace(regexp_replace(trim(lower(strip_accents(replace(translate(coalesce({0}, ''), 'ıİşŞğĞüÜöÖçÇ', 'iissgguuoocc'), chr(65039), chr(57345))))), '\\s+', ' ', 'g'), chr(57345), chr(65039))"


def approved(spark: SparkSession, d: str) -> DataFrame:
    return c.approved_mentions(spark, d).select("mention_id", "social_post_id", "product_id", "confidence", "evidence_text", "influencer_id", "platform", "external_post_id", "original_url", "published_at", "influencer_slug", "display_name", "brand", "product_name", "category")


def catalogue(spark: SparkSession, d: str) -> DataFrame:
    return c.catalogue(spark, d)


def catalogue_of_creator(spark: SparkSession, d: str) -> DataFrame:
    return c.catalogue(spark, d, "trarkot_brultospik")


def browse_top(spark: SparkSession, d: str) -> DataFrame:
    return c.browse(c.catalogue(spark, d), "skincare", 24)


def sunscreens(spark: SparkSession, d: str) -> DataFrame:
    return c.in_category(c.catalogue(spark, d), "sunscreen")


def search_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return c.search(c.catalogue(spark, d), "nemlendrici krem dolca")


def search_by_id(spark: SparkSession, d: str) -> DataFrame:
    return c.search(c.catalogue(spark, d), "100")


def zero_filled(spark: SparkSession, d: str) -> DataFrame:
    """Every product with its counts, zero where there is nothing (correlated counts as one aggregate and a left join)."""
    m = c.mentions(spark, d, "product_id", "social_post_id", "status").where("product_id is not null")
    n = m.groupBy("product_id").agg(F.count("*").alias("mentions"), F.count_if(F.col("status") == "approved").alias("approved"), F.countDistinct("social_post_id").alias("posts"))
    out = c.products(spark, d, "brand", "product_name").withColumnRenamed("id", "product_id").join(n, "product_id", "left").fillna(0, ["mentions", "approved", "posts"])
    return out.withColumn("unapproved_only", (F.col("mentions") > 0) & (F.col("approved") == 0))


def creators(spark: SparkSession, d: str) -> DataFrame:
    """Creators with an approved mention or a post of the last year there is: two existence tests under an or."""
    m, p = c.mentions(spark, d, "social_post_id", "status"), c.posts(spark, d, "influencer_id", "published_at")
    ok = p.join(m.where("status = 'approved'").select(F.col("social_post_id").alias("id")), "id", "left_semi").select(F.col("influencer_id").alias("id")).distinct()
    late = p.where("published_at >= '2026-01-01'").select(F.col("influencer_id").alias("id")).distinct()
    i = table(spark, d, "influencers").select("id", "slug", "display_name")
    return i.join(ok.unionByName(late).distinct(), "id", "left_semi")


def panel(spark: SparkSession, d: str) -> DataFrame:
    """All counts of the status panel in one row."""
    m = c.mentions(spark, d, "status", "product_id").agg(F.count("*").alias("mentions"), F.count_if(F.col("status") == "approved").alias("approved"), F.count_if(F.col("status") == "review").alias("review"), F.count_if(F.col("product_id").isNull()).alias("unresolved"), F.lit(1).alias("_k"))
    p = c.posts(spark, d, "platform", "influencer_id").agg(F.count("*").alias("posts"), F.count_if(F.col("platform") == "instagram").alias("instagram"), F.countDistinct("influencer_id").alias("creators"), F.lit(1).alias("_k"))
    return m.join(p, "_k").join(table(spark, d, "products").agg(F.count_distinct("id").alias("products"), F.lit(1).alias("_k")), "_k").drop("_k")


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return c.mentions(spark, d, "status", "status_reason", "match_method", "confidence").groupBy("status", "status_reason", "match_method").agg(F.count("*").alias("n"), F.sum("confidence").alias("_s")).select("status", "status_reason", "match_method", "n", F.round("_s", 3).alias("confidence"))


def pending(spark: SparkSession, d: str) -> DataFrame:
    """The queue of names still to be settled: first spelling, references in order, occurrences."""
    m = c.mentions(spark, d, "extracted_brand", "extracted_product_name", "category", "status", "status_reason").where("status = 'review' and status_reason = 'pending_canonical_approval'")
    k = m.select("id", "extracted_brand", "extracted_product_name", "category", normalize("extracted_brand", "identity").alias("nb"), normalize("extracted_product_name", "identity").alias("nn"))
    first = lambda x: F.min_by(x, "id")
    return k.groupBy("nb", "nn").agg(
        F.coalesce(first("extracted_brand"), F.lit("")).alias("extracted_brand"), first("extracted_product_name").alias("extracted_product_name"), first("category").alias("category"),
        F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda i: F.concat(F.lit("s:"), i)), ";").alias("source_refs"), F.count("*").alias("occurrences"),
    )


def resolved(spark: SparkSession, d: str) -> DataFrame:
    """Typed names with the entry of the list they mean: equal names, a listing's name as alias of its entry, identity key."""
    r = table(spark, d, "catalog_reference").select(F.col("ref_id").alias("id"), "normalized_brand", "normalized_product_name", identity_key(F.col("brand"), F.col("product_name")).alias("identity_key"))
    # listings that carry an entry's identity key are other names of it
    by_key = r.groupBy("identity_key").agg(F.min("id").alias("canonical_product_id"))
    aliases = c.products(spark, d, "identity_key", "normalized_brand", "normalized_product_name").drop("id").join(by_key, "identity_key").drop("identity_key")
    t = c.mentions(spark, d, "extracted_brand", "extracted_product_name").select(F.col("id").alias("ref"), F.col("extracted_brand").alias("brand"), F.col("extracted_product_name").alias("name"))
    return c.resolve(t, r, aliases)


def resolved_by_name(spark: SparkSession, d: str) -> DataFrame:
    return resolved(spark, d).where("how = 'name'").select("ref", "product_id")


def normalized_names(spark: SparkSession, d: str) -> DataFrame:
    return c.products(spark, d, "brand", "product_name", "category").select("id", normalize("brand", "identity").alias("brand_key"), normalize("product_name", "identity").alias("name_key"), normalize(F.concat_ws(" ", "brand", "product_name", "category"), "identity").alias("search_key"))


def families(spark: SparkSession, d: str) -> DataFrame:
    """All products by family: members, the one listed first, and their reviews, posts and creators (the most of a member)."""
    counts = c.catalogue(spark, d).select("product_id", "review_count", "social_post_count", "influencer_count")
    x = c.products(spark, d, "brand", "product_name").withColumnRenamed("id", "product_id").join(counts, "product_id", "left").fillna(0, ["review_count", "social_post_count", "influencer_count"])
    return c.family_roll_up(x)


def ranked_posts(spark: SparkSession, d: str) -> DataFrame:
    """The five latest posts of every creator and platform."""
    day = dashed(F.col("published_at"))
    p = c.posts(spark, d, "influencer_id", "platform", "published_at").select("influencer_id", "platform", "id", day.alias("day"), shown(day).alias("shown"))
    return top_n(p, ["influencer_id", "platform"], [F.desc("day"), F.desc("id")], 5)


def best_mentions(spark: SparkSession, d: str) -> DataFrame:
    """The best mention of every post and candidate: approved first, then the most confident, then the first."""
    m = c.mentions(spark, d, "social_post_id", "candidate_key", "status", "confidence")
    return keep_best(m, ["social_post_id", "candidate_key"], [(F.col("status") == "approved").cast("int"), F.col("confidence")], "id")


def first_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Mentions moved to the product their redirects end at, the first of every product and post kept."""
    r = final_targets(table(spark, d, "product_id_redirects"), "old_product_id", "canonical_product_id")
    m = c.mentions(spark, d, "social_post_id", "product_id").where("product_id is not null")
    return keep_first(remap(m, "product_id", r, "_from", "_to"), ["product_id", "social_post_id"], "id")


def merged_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Per post the mention of rising confidence with gaps filled from those before."""
    m = c.mentions(spark, d, "social_post_id", "confidence", "product_id", "status_reason")
    return best_merged(m, ["social_post_id"], "confidence", "id")


def new_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids for typed names that no listing and no entry has, after the highest one, in the order of the name."""
    r = c.mentions(spark, d, "extracted_brand", "extracted_product_name").select(normalize("extracted_brand", "identity").alias("nb"), normalize("extracted_product_name", "identity").alias("nn")).distinct()
    p = c.products(spark, d, "normalized_brand", "normalized_product_name")
    known = p.unionByName(table(spark, d, "catalog_reference"), allowMissingColumns=True).select(F.col("normalized_brand").alias("nb"), F.col("normalized_product_name").alias("nn"))
    return assign_ids(r.join(known, ["nb", "nn"], "left_anti"), "product_id", ["nb", "nn"], p.agg(F.max("id")).first()[0] or 0)


def match_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Match records as undirected pairs, each once: the most similar, the nearest in time, how many records."""
    m = ordered_pairs(table(spark, d, "social_post_matches"), "post_id_a", "post_id_b")
    return m.groupBy("post_id_a", "post_id_b").agg(F.max("similarity").alias("similarity"), F.min("date_distance_days").alias("date_distance_days"), F.count("*").alias("records"))


def upserted_matches(spark: SparkSession, d: str) -> DataFrame:
    """Exact matches with near ones upserted: a similarity stays once given; says what happened to each pair."""
    m = ordered_pairs(table(spark, d, "social_post_matches"), "post_id_a", "post_id_b")
    agg = lambda x: x.groupBy("post_id_a", "post_id_b").agg(F.max("similarity").alias("similarity"))
    return upsert(agg(m.where("match_type = 'exact'")), agg(m.where("match_type <> 'exact'")), ["post_id_a", "post_id_b"], {"similarity": lambda o, n: F.coalesce(o, n)}, action="action")


def cross_platform(spark: SparkSession, d: str) -> DataFrame:
    """Matches whose posts are both there, on different platforms, of one creator."""
    m, p = match_pairs(spark, d), c.posts(spark, d, "platform", "influencer_id")
    a, b = (p.select(F.col("id").alias(f"post_id_{s}"), F.col("platform").alias(f"p{s}"), F.col("influencer_id").alias(f"i{s}")) for s in "ab")
    return m.join(a, "post_id_a").join(b, "post_id_b").where("pa <> pb and ia = ib").select("post_id_a", "post_id_b", "similarity")


def match_summary(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "social_post_matches")
    return m.groupBy("match_type").agg(F.count("*").alias("n"), F.count_if(F.col("post_id_b").isNull()).alias("open"), F.round(F.avg("similarity"), 4).alias("mean_similarity"), F.max("date_distance_days").alias("longest"))


def unmatched_posts(spark: SparkSession, d: str) -> DataFrame:
    """Posts in no match, by an anti-join on both ends."""
    m = table(spark, d, "social_post_matches")
    ends = m.select(F.col("post_id_a").alias("id")).unionByName(m.select(F.col("post_id_b").alias("id"))).where("id is not null").distinct()
    return c.posts(spark, d, "platform").join(ends, "id", "left_anti")


def repost_groups(spark: SparkSession, d: str) -> DataFrame:
    """Posts of one product and creator on two platforms that are matched: group per (product, post). Near matches need the
    same day and 0.9."""
    m = c.approved_mentions(spark, d).select("product_id", F.col("social_post_id").alias("id"), "influencer_id", "platform", F.substring(dashed(F.col("published_at")), 1, 10).alias("day")).distinct()
    e = ordered_pairs(table(spark, d, "social_post_matches"), "post_id_a", "post_id_b").select("post_id_a", "post_id_b", "match_type", "similarity").distinct()
    a, b = (m.select("product_id", "influencer_id", F.col("id").alias(f"post_id_{s}"), F.col("platform").alias(f"p{s}"), F.col("day").alias(f"d{s}")) for s in "ab")
    e = e.join(a, "post_id_a").join(b, ["post_id_b", "product_id", "influencer_id"]).where("pa <> pb and (match_type = 'exact' or (match_type = 'near' and da = db and similarity >= 0.9))")
    # posts are linked within a product: both ids make one
    node = lambda s: F.struct("product_id", F.col(s).alias("post_id"))
    g = linked_groups(e.select(node("post_id_a").alias("a"), node("post_id_b").alias("b")), "a", "b")
    return g.select("id.product_id", "id.post_id", F.col("group.post_id").alias("group_id"))


def cross_posts(spark: SparkSession, d: str) -> DataFrame:
    """For every Instagram post the most similar TikTok post of its creator; several may have the same one (cross_post_faults)."""
    day = to_day(F.col("published_at"), F.col("published_at"), F.lit(None).cast("double"))
    p = c.posts(spark, d, "influencer_id", "caption", "platform", "published_at").select("id", "influencer_id", "caption", "platform", day.alias("day"))
    return nearest_captions(p.where("platform = 'instagram'"), p.where("platform = 'tiktok'"), "influencer_id")


def cross_post_faults(spark: SparkSession, d: str) -> DataFrame:
    """Cross posts that a 1:1 match set could not hold, and any other fault of theirs."""
    return match_faults(cut(cross_posts(spark, d)))


def product_pairs(spark: SparkSession, d: str) -> DataFrame:
    return similar_products(c.products(spark, d, "brand", "product_name", "category"))


def keyed_words(spark: SparkSession, d: str) -> DataFrame:
    """id, brand_key and words (sorted, as one text) of every product that has both."""
    p = c.products(spark, d, "brand", "product_name").select("id", comparable_brand(F.col("brand")).alias("brand_key"), F.array_join(F.array_sort(feature_words(F.col("product_name"))), " ").alias("words"))
    return p.where("brand_key <> '' and words <> ''")


def same_words(spark: SparkSession, d: str) -> DataFrame:
    """Products of one brand with the same words in any order: grouped by the key itself, no pairs."""
    return keyed_words(spark, d).groupBy("brand_key", "words").agg(F.count("*").alias("products"), F.min("id").alias("first_id")).where("products > 1")


def same_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence texts of a post that stand for several products."""
    m = c.mentions(spark, d, "social_post_id", "evidence_text", "product_id").where("product_id is not null")
    return m.groupBy("social_post_id", F.lower(F.trim("evidence_text")).alias("evidence")).agg(F.countDistinct("product_id").alias("products")).where("products > 1")


def leaked_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Mentions whose evidence names another product of the same post: the first such product."""
    m = c.mentions(spark, d, "social_post_id", "product_id", "evidence_text", "extracted_product_name").where("product_id is not null").select("id", "social_post_id", "product_id", F.lower("evidence_text").alias("evidence"), F.lower(F.trim("extracted_product_name")).alias("name"))
    o = m.select("social_post_id", F.col("id").alias("other_id"), F.col("product_id").alias("other"), F.col("name").alias("other_name")).where("length(other_name) >= 8")
    hit = m.join(o, "social_post_id").where("product_id <> other and instr(evidence, other_name) > 0")
    return hit.groupBy("id").agg(F.min("other_id").alias("other_id"))


def prompt_groups(spark: SparkSession, d: str) -> DataFrame:
    """Creators with posts of an old prompt: any, all, how many prompts, which."""
    p = c.posts(spark, d, "influencer_id", "prompt_version").where("prompt_version is not null")
    g = p.groupBy("influencer_id").agg(F.bool_or(F.col("prompt_version") == "social-v1").alias("any_old"), F.bool_and(F.col("prompt_version") == "social-v4").alias("all_new"), F.countDistinct("prompt_version").alias("versions"), F.array_join(F.sort_array(F.collect_set("prompt_version")), ",").alias("list"))
    return g.where("any_old")


def checked_metadata(spark: SparkSession, d: str) -> DataFrame:
    handles = table(spark, d, "influencers").select(F.col("slug").alias("handle"), "slug")
    return checked_posts(table(spark, d, "raw_post_metadata"), handles, ["www.insta.example", "insta.example"])


def metadata_reasons(spark: SparkSession, d: str) -> DataFrame:
    return checked_metadata(spark, d).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


def dated_metadata(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "raw_post_metadata")
    day = to_day(F.trim("upload_date"), F.lit(None).cast("string"), F.col("epoch_seconds").cast("double"))
    return r.select("row_id", dashed(F.col("upload_date")).alias("dashed"), F.date_format(day, "yyyy-MM-dd").alias("day"), richness([F.col(x) for x in ("original_url", "upload_date", "epoch_seconds", "description", "_type")]).alias("richness"))


def link_parts(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("original_url")
    return c.posts(spark, d, "original_url").select("id", domain(u).alias("domain"), canonical_url(u).alias("url"), merchant_name(domain(u)).alias("merchant"), in_domain(domain(u), F.lit("tok.example")).alias("tok"))


def hash_check(spark: SparkSession, d: str) -> DataFrame:
    """Posts whose stored hash is not their caption's, and in which state the extraction is: what has to run again."""
    p = c.posts(spark, d, "caption", "caption_sha256", "prompt_version")
    now = p.select("id", F.sha2("caption", 256).alias("caption_sha256"), F.lit("social-v4").alias("prompt_version"))
    return stale(p.select("id", "caption_sha256", "prompt_version"), now, ["id", "caption_sha256", "prompt_version"]).select("id", "caption_sha256")


def changed_sources(spark: SparkSession, d: str) -> DataFrame:
    """Posts whose collected caption is another than the stored one."""
    raw = table(spark, d, "raw_post_metadata").where("id is not null").groupBy(F.col("id").alias("external_post_id")).agg(F.max_by("description", "row_id").alias("caption"))
    p = c.posts(spark, d, "platform", "external_post_id", "caption").where("platform = 'instagram'").groupBy("external_post_id").agg(F.max_by("caption", "id").alias("caption"))
    return changed(p, raw, ["external_post_id"], ["caption"])


def replaced_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Mentions after those of the posts of 2026 were replaced by their approved ones: rows per platform."""
    m, p = c.mentions(spark, d, "social_post_id", "status"), c.posts(spark, d, "platform", "published_at").withColumnRenamed("id", "social_post_id")
    late = p.where("published_at >= '2026-01-01'").select("social_post_id")
    new = m.where("status = 'approved'").join(late, "social_post_id", "left_semi")
    after = replace_children(m, new, ["social_post_id"], late)
    return after.join(p, "social_post_id").groupBy("platform").agg(F.count("*").alias("mentions"))


def platform_delta(spark: SparkSession, d: str) -> DataFrame:
    p = c.posts(spark, d, "platform", "created_at")
    count = lambda x: x.groupBy("platform").agg(F.count("*").alias("n"))
    return count_delta(count(p.where("created_at < '2026-01-01'")), count(p), "platform", "n")


def table_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name in ("products", "social_posts", "social_post_products", "influencers"):
        f = fingerprint(table(spark, d, name)).withColumn("table_name", F.lit(name))
        out = f if out is None else out.unionByName(f)
    return out


def payload_fields(spark: SparkSession, d: str) -> DataFrame:
    m = c.mentions(spark, d, "raw_payload_json")
    j = F.from_json("raw_payload_json", "brand string, product_name string, category string, confidence double")
    return m.select("id", j.alias("j")).select("id", "j.brand", "j.product_name", "j.category", F.round("j.confidence", 3).alias("confidence"))


def first_spellings(spark: SparkSession, d: str) -> DataFrame:
    """Brands as first typed, one spelling each."""
    m = c.mentions(spark, d, "extracted_brand").where("extracted_brand is not null")
    return distinct_in_order(m, normalize("extracted_brand", "identity"), "id")


def id_sets(spark: SparkSession, d: str) -> DataFrame:
    """Union, intersection and difference of referenced and existing product ids."""
    have, used = table(spark, d, "products").select("id").distinct(), table(spark, d, "social_post_products").where("product_id is not null").select(F.col("product_id").alias("id")).distinct()
    n = lambda x, label: x.agg(F.count("*").alias("n")).withColumn("part", F.lit(label))
    return n(have.union(used).distinct(), "either").unionByName(n(have.intersect(used), "both")).unionByName(n(used.subtract(have), "missing")).unionByName(n(have.subtract(used), "unused"))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events of the table as a stream, counted per day and type."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/streams/{os.urandom(8).hex()}"
    events = stream_of(spark, d, "events.parquet", "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    out = run_complete(windowed_counts(events, "ts", ["event_type"], "value", "1 day", "2 hours"), f"{folder}/out", f"{folder}/checkpoint")
    return out.select("window_start", "event_type", "events", F.round("total", 4).alias("total"))


QUERIES = {
    "c1_approved_mentions": approved, "e2_catalogue": catalogue, "e2_catalogue_of_creator": catalogue_of_creator, "g6_browse_top": browse_top, "c5_sunscreens": sunscreens,
    "g5_search_fuzzy": search_fuzzy, "c6_search_by_id": search_by_id, "e3_zero_filled": zero_filled, "d6_creators": creators, "e4_panel": panel, "e11_status_counts": status_counts, "e8_pending": pending,
    "d13_resolved": resolved, "d13_resolved_by_name": resolved_by_name, "n1_normalized_names": normalized_names, "e7_families": families, "g4_ranked_posts": ranked_posts, "g8_best_mentions": best_mentions,
    "g7_first_mentions": first_mentions, "g9_merged_mentions": merged_mentions, "g20_new_ids": new_ids, "b6_match_pairs": match_pairs, "b1_upserted_matches": upserted_matches, "d10_cross_platform": cross_platform,
    "e15_match_summary": match_summary, "d7_unmatched_posts": unmatched_posts, "h4_repost_groups": repost_groups, "d15_cross_posts": cross_posts, "f11_cross_post_faults": cross_post_faults, "d16_product_pairs": product_pairs, "f19_same_words": same_words,
    "e16_same_evidence": same_evidence, "d17_leaked_evidence": leaked_evidence, "e17_prompt_groups": prompt_groups, "f9_checked_metadata": checked_metadata, "f9_metadata_reasons": metadata_reasons, "s15_dated_metadata": dated_metadata,
    "s11_link_parts": link_parts, "j2_hash_check": hash_check, "d25_changed_sources": changed_sources, "b4_replaced_mentions": replaced_mentions, "e18_platform_delta": platform_delta, "e19_fingerprints": table_fingerprints,
    "s16_payload_fields": payload_fields, "c13_first_spellings": first_spellings, "h3_id_sets": id_sets, "j6_event_windows": event_windows,
}

_DAY = "case when regexp_matches(trim({0}), '^\\d{{8}}$') then substr(trim({0}), 1, 4) || '-' || substr(trim({0}), 5, 2) || '-' || substr(trim({0}), 7, 2) when trim({0}) = '' then null else trim({0}) end"
_PAIRS = "e as (select least(post_id_a, post_id_b) a, greatest(post_id_a, post_id_b) b, match_type, similarity, date_distance_days from social_post_matches where post_id_a <> post_id_b)"
_WORDS = "list_filter(list_transform(regexp_extract_all({0}, '[a-z0-9]+'), lambda x: case when x = 'fondoten' then 'foundation' else x end), lambda x: x not in ('the', 'a', 'an'))"
_N3 = "trim(regexp_replace({0}, '[^a-z0-9]+', ' ', 'g'))"
_FAMILY = "regexp_replace(regexp_replace(regexp_replace({0}, '\\b\\d+(?:[.,]\\d+)?\\s*(?:ml|gr|g|gram|oz)\\b', ' ', 'g'), '\\b(?:no|numara|numarasi|numarali|shade)\\s*#?\\d+(?:[.,]\\d+)?\\b', ' ', 'g'), '\\b#?\\d+(?:[.,]\\d+)?\\s*(?:numara|numarasi|numarali|shade)\\b', ' ', 'g')"
_TYPES = "map {" + ", ".join(f"'{a}': '{b}'" for a, b in TYPE_NAMES.items()) + "}"

def _link(column: str) -> str:
    """Of a link: null if empty, else whether it is one of a post, the account and the code."""
    u = f"trim(coalesce({column}, ''))"
    m = "'^https://(www\\.)?insta\\.example(/(?:([A-Za-z0-9_.]+)/)?(reel|p)/([A-Za-z0-9_-]+)/?)(\\?[^#]*)?(#.*)?$'"
    any_ = "'^[a-z]+://[^/?#]+/(?:([A-Za-z0-9_.]+)/)?(reel|p)/([A-Za-z0-9_-]+)/?(\\?[^#]*)?(#.*)?$'"
    return f"case when {u} = '' then null else regexp_matches({u}, {m}) end as {column}_ok, regexp_extract({u}, {any_}, 1) as {column}_account, nullif(regexp_extract({u}, {any_}, 3), '') as {column}_code"


_PLAIN = "regexp_replace(lower(coalesce({0}, '')), '[@._]', '', 'g')"
_CHECKED = f"""x as (select *, {_link('webpage_url')}, {_link('original_url')} from raw_post_metadata),
  y as (select x.*, i.slug as influencer_slug, coalesce(webpage_url_code, original_url_code) as external_post_id,
    case when trim(coalesce(upload_date, '')) <> '' then case when regexp_matches(trim(upload_date), '^\\d{{8}}$') then try_strptime(trim(upload_date), '%Y%m%d')::date end else make_timestamp(epoch_seconds * 1000000)::date end as day
    from x left join influencers i on {_PLAIN.format('i.slug')} = {_PLAIN.format('x.channel')}),
  z as (select row_id, influencer_slug, external_post_id, strftime(day, '%Y-%m-%d') as published_at, sha256(coalesce(description, '')) as caption_sha256,
    case when webpage_url_ok is null and original_url_ok is null then 'no link' when not coalesce(webpage_url_ok, true) or not coalesce(original_url_ok, true) then 'no post link'
      when coalesce(webpage_url_code, external_post_id) <> external_post_id or coalesce(original_url_code, external_post_id) <> external_post_id or coalesce(nullif(trim(id), ''), external_post_id) <> external_post_id or coalesce(nullif(trim(display_id), ''), external_post_id) <> external_post_id then 'ids disagree'
      when influencer_slug is null then 'unknown account'
      when {_PLAIN.format('webpage_url_account')} not in ('', {_PLAIN.format('channel')}) or {_PLAIN.format('original_url_account')} not in ('', {_PLAIN.format('channel')}) then 'other account'
      when day is null then 'no date' end as reason from y)"""

_SIGNS = "regexp_replace(regexp_replace(regexp_replace(replace(replace(regexp_replace(coalesce({0}, ''), '[™®©℠\ufe0f]', '', 'g'), '%', ' pct '), '&', ' and '), '([\\p{{L}}\\p{{N}}_])\\+([\\p{{L}}\\p{{N}}_])', '\\1 and \\2', 'g'), '\\s\\+\\s', ' and ', 'g'), '\\+', ' plus ', 'g')"


def _key(brand: str, name: str) -> str:
    """The identity key, for texts without compatibility characters."""
    bare = lambda x: f"regexp_replace(regexp_replace({N1.format(_SIGNS.format(x))}, '[^a-z0-9 ]', ' ', 'g'), '([0-9])\\s+((?:cc|ml|gr|g|mg|oz)\\b)', '\\1\\2', 'g')"
    words = f"list_filter(string_split_regex({bare(name)}, '\\s+'), lambda x: x not in ('', 'and', 've', 'the'))"
    words = f"list_transform({words}, lambda x: case when regexp_matches(x, '^[0-9]+$') then coalesce(nullif(ltrim(x, '0'), ''), '0') else x end)"
    return f"replace({bare(brand)}, ' ', '') || '|' || array_to_string(list_sort({words}), ' ')"


_TABLES = {
    "products": "brand category created_at:t id identity_key merchant_slug normalized_brand normalized_product_name product_name search_text updated_at:t verification_status",
    "social_posts": "caption caption_sha256 created_at:t external_post_id extracted_at:t id influencer_id model original_url platform prompt_version published_at source_file updated_at:t",
    "social_post_products": "candidate_key category confidence:f evidence_text extracted_brand extracted_product_name id match_method product_id raw_payload_json social_post_id status status_reason",
    "influencers": "created_at:t display_name id slug updated_at:t",
}


def _fingerprint(name: str, columns: str) -> str:
    """A table's fingerprint; columns by name, :t for times, :f for fractions."""
    kinds = {"t": "epoch_us({})::varchar", "f": "printf('%.6f', {})", "": "{}::varchar"}
    parts = [(x, k) for x, _, k in (y.partition(":") for y in columns.split())]
    text = " || chr(31) || ".join(f"case when {x} is null then '-' else '+' || {kinds[k].format(x)} end" for x, k in sorted(parts))
    return f"select '{name}' as table_name, count(*) as rows, bit_xor(('0x' || left(h, 15))::bigint) as checksum, sum(('0x' || left(h, 8))::bigint)::bigint as total from (select sha256({text}) as h from {name})"


SQL = {
    "c1_approved_mentions": f"with {APPROVED} select * from a",
    "e2_catalogue": f"with {CATALOGUE} select * from c",
    "e2_catalogue_of_creator": f"with {APPROVED} select product_id, brand, product_name, category, sum(case when platform = 'tiktok' then 1 else 0 end)::bigint as review_count, sum(case when platform <> 'tiktok' then 1 else 0 end)::bigint as social_post_count, count(distinct influencer_slug) as influencer_count from a where influencer_slug = 'trarkot_brultospik' group by all",
    "g6_browse_top": f"with {CATALOGUE} select * from c where category = 'skincare' order by {RANK} limit 24",
    "c6_search_by_id": f"with {CATALOGUE} select *, 100.0::double as match_score from c where product_id = 100",
    "e3_zero_filled": f"with {P}, {M}, n as (select product_id, count(*) mentions, count(*) filter (status = 'approved') approved, count(distinct social_post_id) posts from m where product_id is not null group by 1) select p.id as product_id, brand, product_name, coalesce(mentions, 0) as mentions, coalesce(approved, 0) as approved, coalesce(posts, 0) as posts, coalesce(mentions, 0) > 0 and coalesce(approved, 0) = 0 as unapproved_only from p left join n on n.product_id = p.id",
    "d6_creators": "select id, slug, display_name from influencers i where exists (select 1 from social_posts s join social_post_products m on m.social_post_id = s.id where s.influencer_id = i.id and m.status = 'approved') or exists (select 1 from social_posts s where s.influencer_id = i.id and s.published_at >= '2026-01-01')",
    "e4_panel": f"with {P}, {S}, {M} select (select count(*) from m) mentions, (select count(*) from m where status = 'approved') approved, (select count(*) from m where status = 'review') review, (select count(*) from m where product_id is null) unresolved, (select count(*) from s) posts, (select count(*) from s where platform = 'instagram') instagram, (select count(distinct influencer_id) from s) creators, (select count(*) from p) products",
    "e11_status_counts": f"with {M} select status, status_reason, match_method, count(*) as n, round(sum(confidence), 3) as confidence from m group by 1, 2, 3",
    "e8_pending": f"with {M}, k as (select *, {N1.format('extracted_brand')} nb, {N1.format('extracted_product_name')} nn from m where status = 'review' and status_reason = 'pending_canonical_approval') select nb, nn, coalesce(first(extracted_brand order by id), '') as extracted_brand, first(extracted_product_name order by id) as extracted_product_name, first(category order by id) as category, string_agg('s:' || id, ';' order by id) as source_refs, count(*) as occurrences from k group by nb, nn",
    "d13_resolved_by_name": f"with {M}, k as (select normalized_brand nb, normalized_product_name nn, min(ref_id) pid from catalog_reference group by 1, 2) select m.id as ref, k.pid as product_id from m join k on k.nb = {N1.format('m.extracted_brand')} and k.nn = {N1.format('m.extracted_product_name')}",
    "d13_resolved": f"""with {P}, {M}, r as (select ref_id, normalized_brand nb, normalized_product_name nn, {_key('brand', 'product_name')} ik from catalog_reference), e as (select nb, nn, min(ref_id) i from r group by 1, 2), k as (select ik, min(ref_id) i from r group by 1),
      a as (select normalized_brand nb, normalized_product_name nn, min(k.i) i from p join k on k.ik = p.identity_key group by 1, 2),
      t as (select id, extracted_brand, extracted_product_name, {N1.format('extracted_brand')} nb, {N1.format('extracted_product_name')} nn, {_key('extracted_brand', 'extracted_product_name')} ik from m)
      select t.id as ref, t.extracted_brand as brand, t.extracted_product_name as name, coalesce(e.i, a.i, k.i) as product_id, case when e.i is not null then 'name' when a.i is not null then 'alias' when k.i is not null then 'identity' end as how
      from t left join e on e.nb = t.nb and e.nn = t.nn left join a on a.nb = t.nb and a.nn = t.nn left join k on k.ik = t.ik""",
    "g20_new_ids": f"with {M}, t as (select distinct {N1.format('extracted_brand')} nb, {N1.format('extracted_product_name')} nn from m), k as (select normalized_brand nb, normalized_product_name nn from products union select normalized_brand, normalized_product_name from catalog_reference), x as (select * from t where not exists (select 1 from k where k.nb = t.nb and k.nn = t.nn)) select nb, nn, (select max(id) from products) + row_number() over (order by nb, nn) as product_id from x",
    "f9_checked_metadata": f"with {_CHECKED} select row_id, influencer_slug, external_post_id, published_at, caption_sha256, reason from z",
    "f9_metadata_reasons": f"with {_CHECKED} select coalesce(reason, 'accepted') as reason, count(*) as n from z group by 1",
    "n1_normalized_names": f"with {P} select id, normalized_brand as brand_key, normalized_product_name as name_key, search_text as search_key from p",
    "e7_families": f"with {CATALOGUE}, f as (select id, {_N3.format('normalized_brand')} || '::' || array_to_string(list_transform(list_filter(string_split(trim(regexp_replace({_FAMILY.format(_N3.format('normalized_product_name'))}, '\\s+', ' ', 'g')), ' '), lambda x: x not in ('', 'numara', 'numarasi', 'numarali')), lambda x: coalesce({_TYPES}[x], x)), ' ') as family from p) select family, count(*) as members, min(id) as representative, sum(coalesce(review_count, 0))::bigint as review_count, sum(coalesce(social_post_count, 0))::bigint as social_post_count, max(coalesce(influencer_count, 0)) as influencer_count from f left join c on c.product_id = f.id group by 1",
    "g4_ranked_posts": f"with {S}, r as (select influencer_id, platform, id, {_DAY.format('published_at')} as day from s) select influencer_id, platform, id, day, substr(day, 9, 2) || '.' || substr(day, 6, 2) || '.' || substr(day, 1, 4) as shown from (select *, row_number() over (partition by influencer_id, platform order by day desc, id desc) rn from r) where rn <= 5",
    "g8_best_mentions": f"with {M} select social_post_id, candidate_key, id, status, confidence from (select *, row_number() over (partition by social_post_id, candidate_key order by case when status = 'approved' then 1 else 0 end desc, confidence desc, id) rn from m) where rn = 1",
    "g7_first_mentions": f"""with recursive {M}, r as (select old_product_id o, min(canonical_product_id) n from product_id_redirects where old_product_id is not null and canonical_product_id is not null group by 1),
      w as (select o as first, n as last, [o] as seen from r union all select w.first, r.n, list_append(w.seen, r.o) from w join r on r.o = w.last where not list_contains(w.seen, r.o)),
      f as (select first, last from w where last not in (select o from r)), x as (select m.id, m.social_post_id, coalesce(f.last, m.product_id) as product_id from m left join f on f.first = m.product_id where m.product_id is not null)
      select product_id, social_post_id, min(id) as id from x group by 1, 2""",
    "g9_merged_mentions": f"""with {M}, x as (select id, social_post_id, confidence, product_id, status_reason, max(coalesce(confidence, '-infinity'::double)) over (partition by social_post_id order by id rows between unbounded preceding and 1 preceding) as top from m),
      k as (select * from x where top is null or coalesce(confidence, '-infinity'::double) >= top)
      select social_post_id, max(id) as id, arg_max(confidence, id) filter (confidence is not null) as confidence, arg_max(product_id, id) filter (product_id is not null) as product_id, arg_max(status_reason, id) filter (status_reason is not null) as status_reason from k group by 1""",
    "c5_sunscreens": f"with {CATALOGUE}, p2 as (select id, trim(regexp_replace(normalized_brand || ' ' || normalized_product_name, '[^a-z0-9%+]+', ' ', 'g')) as t from p) select c.* from c join p2 on p2.id = c.product_id where "
      + " or ".join(f"contains(t, '{w}')" for w in [*c.SUNSCREEN, "sun screen"]),
    "e19_fingerprints": " union all ".join(_fingerprint(t, cols) for t, cols in _TABLES.items()),
    "b6_match_pairs": f"with {_PAIRS} select a as post_id_a, b as post_id_b, max(similarity) as similarity, min(date_distance_days) as date_distance_days, count(*) as records from e group by 1, 2",
    "b1_upserted_matches": f"with {_PAIRS}, o as (select a, b, max(similarity) x from e where match_type = 'exact' group by 1, 2), n as (select a, b, max(similarity) x from e where match_type <> 'exact' group by 1, 2) select coalesce(n.a, o.a) as post_id_a, coalesce(n.b, o.b) as post_id_b, coalesce(o.x, n.x) as similarity, case when n.a is null then 'kept' when o.a is null then 'inserted' else 'updated' end as action from o full join n on o.a = n.a and o.b = n.b",
    "d10_cross_platform": f"with {S}, {_PAIRS}, g as (select a, b, max(similarity) similarity from e group by 1, 2) select a as post_id_a, b as post_id_b, similarity from g join s x on x.id = a join s y on y.id = b where x.platform <> y.platform and x.influencer_id = y.influencer_id",
    "e15_match_summary": "select match_type, count(*) as n, count(*) filter (post_id_b is null) as open, round(avg(similarity), 4) as mean_similarity, max(date_distance_days) as longest from social_post_matches group by 1",
    "d7_unmatched_posts": f"with {S} select id, platform from s where id not in (select post_id_a from social_post_matches where post_id_a is not null) and id not in (select post_id_b from social_post_matches where post_id_b is not null)",
    "h4_repost_groups": f"""with recursive {APPROVED}, n as (select distinct product_id, social_post_id as id, influencer_id, platform, {_DAY.format('published_at')} as day from a), {_PAIRS},
      l as (select distinct x.product_id, e.a, e.b from e join n x on x.id = e.a join n y on y.id = e.b and y.product_id = x.product_id and y.influencer_id = x.influencer_id where x.platform <> y.platform and (match_type = 'exact' or (match_type = 'near' and x.day = y.day and similarity >= 0.9))),
      w as (select product_id, a, b from l union select product_id, b, a from l), r as (select product_id, a as root, a as id from w union select r.product_id, r.root, w.b from r join w on w.product_id = r.product_id and w.a = r.id)
      select product_id, root as post_id, min(id) as group_id from r group by 1, 2""",
    "f19_same_words": f"with {P}, x as (select id, array_to_string(regexp_extract_all(normalized_brand, '[a-z0-9]+'), ' ') as brand_key, array_to_string(list_sort({_WORDS.format('normalized_product_name')}), ' ') as words from p) select brand_key, words, count(*) as products, min(id) as first_id from x where brand_key <> '' and words <> '' group by 1, 2 having count(*) > 1",
    "e16_same_evidence": f"with {M} select social_post_id, lower(trim(evidence_text)) as evidence, count(distinct product_id) as products from m where product_id is not null group by 1, 2 having count(distinct product_id) > 1",
    "d17_leaked_evidence": f"with {M}, x as (select id, social_post_id, product_id, lower(evidence_text) evidence, lower(trim(extracted_product_name)) name from m where product_id is not null) select x.id, min(o.id) as other_id from x join x o on o.social_post_id = x.social_post_id and o.product_id <> x.product_id and length(o.name) >= 8 and contains(x.evidence, o.name) group by 1",
    "e17_prompt_groups": f"with {S} select influencer_id, bool_or(prompt_version = 'social-v1') as any_old, bool_and(prompt_version = 'social-v4') as all_new, count(distinct prompt_version) as versions, string_agg(distinct prompt_version, ',' order by prompt_version) as list from s where prompt_version is not null group by 1 having bool_or(prompt_version = 'social-v1')",
    "s15_dated_metadata": f"select row_id, {_DAY.format('upload_date')} as dashed, strftime(case when regexp_matches(trim(upload_date), '^\\d{{8}}$') then strptime(trim(upload_date), '%Y%m%d') else make_timestamp(epoch_seconds * 1000000) end, '%Y-%m-%d') as day, (coalesce(original_url, '') <> '')::int + (coalesce(upload_date, '') <> '')::int + (epoch_seconds is not null)::int + (coalesce(description, '') <> '')::int + (coalesce(_type, '') <> '')::int as richness from raw_post_metadata",
    "s11_link_parts": f"with {S}, x as (select id, regexp_replace(lower(regexp_extract(original_url, '^https?://([^/?#]+)', 1)), '^www\\.', '') as h, regexp_replace(regexp_extract(original_url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') as path from s) select id, h as domain, 'https://' || h || path as url, upper(left(split_part(h, '.', 1), 1)) || substr(split_part(h, '.', 1), 2) as merchant, h = 'tok.example' or ends_with(h, '.tok.example') as tok from x",
    "j2_hash_check": f"with {S} select id, sha256(caption) as caption_sha256 from s where not (coalesce(prompt_version, '') = 'social-v4' and caption_sha256 = sha256(caption))",
    "d25_changed_sources": f"with {S}, r as (select id as x, arg_max_null(description, row_id) as cap from raw_post_metadata where id is not null group by 1), q as (select external_post_id as x, arg_max_null(caption, id) as cap from s where platform = 'instagram' group by 1) select q.x as external_post_id from q join r on r.x = q.x where q.cap is distinct from r.cap",
    "b4_replaced_mentions": f"with {S}, {M} select platform, count(*) as mentions from m join s on s.id = m.social_post_id where s.published_at < '2026-01-01' or m.status = 'approved' group by 1",
    "e18_platform_delta": f"with {S}, b as (select platform, count(*) n from s where created_at < timestamp '2026-01-01' group by 1), a as (select platform, count(*) n from s group by 1) select coalesce(a.platform, b.platform) as platform, coalesce(b.n, 0) as before, coalesce(a.n, 0) as after, coalesce(a.n, 0) - coalesce(b.n, 0) as delta from b full join a on a.platform = b.platform",
    "s16_payload_fields": f"with {M} select id, raw_payload_json->>'$.brand' as brand, raw_payload_json->>'$.product_name' as product_name, raw_payload_json->>'$.category' as category, round((raw_payload_json->>'$.confidence')::double, 3) as confidence from m",
    "c13_first_spellings": f"with {M} select min(id) as id, first(extracted_brand order by id) as extracted_brand from m where extracted_brand is not null group by {N1.format('extracted_brand')}",
    "h3_id_sets": "with h as (select distinct id from products), u as (select distinct product_id as id from social_post_products where product_id is not null) select 'either' as part, count(*) as n from (select * from h union select * from u) union all select 'both', count(*) from (select * from h intersect select * from u) union all select 'missing', count(*) from (select * from u except select * from h) union all select 'unused', count(*) from (select * from h except select * from u)",
    "j6_event_windows": "select date_trunc('day', ts) as window_start, event_type, count(*) as events, round(sum(value), 4) as total from events group by 1, 2",
}
