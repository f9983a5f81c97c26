"""Views, roll-ups and searches over the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvina.functions.keys import family_key, identity_key
from corvina.functions.normalize import normalize
from corvina.functions.similarity import match_score, search_aliases, search_text
from corvina.functions.normalize import normalized
from corvina.operators.keep import collapse
from corvina.operators.latest import latest_per_key
from corvina.session import table

PRODUCT = ["brand", "product_name", "category", "normalized_brand", "normalized_product_name", "search_text", "identity_key", "verification_status", "merchant_slug", "created_at"]
POST = ["influencer_id", "platform", "external_post_id", "caption", "original_url", "published_at", "caption_sha256", "prompt_version", "model", "created_at"]
# What tells a sunscreen in a product's text.
SUNSCREEN = ["gunes krem", "gunes koruyucu", "sun cream", "suncream", "sunscreen", "sun protection", "spf"]


def products(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The latest row of every product with the columns asked for (all without), which are all that is read."""
    return latest_per_key(table(spark, d, "products"), ["id"], ["updated_at"], columns or PRODUCT)


def posts(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The latest row of every post with the columns asked for (all without), which are all that is read."""
    return latest_per_key(table(spark, d, "social_posts"), ["id"], ["updated_at"], columns or POST)


def mentions(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Every mention once with its id and the columns asked for (all without): repeated rows are equal in full."""
    t = table(spark, d, "social_post_products")
    return (t.select("id", *columns) if columns else t).distinct()


def ascii_lower(c: Column) -> Column:
    """Small letters for A to Z only, as the reference's collation compares."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def approved_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Approved mentions with their post, creator and product."""
    m = mentions(spark, d, "social_post_id", "product_id", "confidence", "evidence_text", "status").where("status = 'approved' and product_id is not null").select(F.col("id").alias("mention_id"), "social_post_id", "product_id", "confidence", "evidence_text")
    p = posts(spark, d, "influencer_id", "platform", "external_post_id", "original_url", "published_at").select(F.col("id").alias("social_post_id"), "influencer_id", "platform", "external_post_id", "original_url", "published_at")
    i = table(spark, d, "influencers").select(F.col("id").alias("influencer_id"), F.col("slug").alias("influencer_slug"), "display_name")
    c = products(spark, d, "brand", "product_name", "category").withColumnRenamed("id", "product_id")
    return m.join(p, "social_post_id").join(i, "influencer_id").join(c, "product_id")


def roll_up(reviews: DataFrame, social: DataFrame, influencer_slug: str = "all") -> DataFrame:
    """Per product how often it is reviewed, posted, and by how many creators. Both: product_id, brand, product_name,
    category, influencer_slug; the creator's filter reaches both scans. "all" does not filter."""
    both = reviews.withColumn("kind", F.lit("review")).unionByName(social.withColumn("kind", F.lit("social")))
    if influencer_slug != "all":
        both = both.where(F.col("influencer_slug") == influencer_slug)
    return both.groupBy("product_id", "brand", "product_name", "category").agg(
        F.count_if(F.col("kind") == "review").alias("review_count"), F.count_if(F.col("kind") == "social").alias("social_post_count"), F.countDistinct("influencer_slug").alias("influencer_count")
    )


def catalogue(spark: SparkSession, d: str, influencer_slug: str = "all") -> DataFrame:
    cols = ["product_id", "brand", "product_name", "category", "influencer_slug"]
    m = approved_mentions(spark, d)
    return roll_up(m.where("platform = 'tiktok'").select(*cols), m.where("platform <> 'tiktok'").select(*cols), influencer_slug)


def by_rank(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("influencer_count"), F.desc("review_count"), F.desc("social_post_count"), ascii_lower(F.col("brand")), ascii_lower(F.col("product_name")), "product_id")


def found_by(df: DataFrame) -> DataFrame:
    """With what searches look at: normalized brand and name, and all a product is found by."""
    text = df.withColumns({"_b": normalize("brand", "search"), "_n": normalize("product_name", "search")})
    own = F.concat_ws(" ", F.nullif("_b", F.lit("")), F.nullif("_n", F.lit("")))
    return text.withColumn("_all", F.trim(F.concat_ws(" ", own, search_aliases(own, F.col("category")))))


def in_category(df: DataFrame, code: str) -> DataFrame:
    """"all" is no filter, sunscreen is told by the text, anything else is the category itself."""
    if code == "all":
        return df
    if code == "sunscreen":
        hit = F.lit(False)
        for w in SUNSCREEN:
            hit = hit | F.col("_all").contains(w)
        return found_by(df).where(hit).select(*df.columns)
    return df.where(F.col("category") == code)


def browse(df: DataFrame, code: str, limit: int) -> DataFrame:
    return by_rank(in_category(df, code)).limit(limit)


def search(df: DataFrame, raw: str, code: str = "all", limit: int = 24, cutoff: float = 48.0) -> DataFrame:
    """The best answers to a query among roll-up rows, with match_score. A number finds the product of that id, if there is
    one; an empty query finds nothing."""
    rows, query = in_category(df, code), raw.strip()
    number = int(query) if query.isascii() and query.isdigit() else None
    wanted = normalized(query, "search")
    if not wanted:
        return rows.withColumn("match_score", F.lit(0.0)).limit(0)
    scored = found_by(rows).withColumn("match_score", match_score(wanted, F.col("_b"), F.col("_n"), F.col("_all"), cutoff))
    named = F.lit(False) if number is None else F.col("product_id") == number
    scored = scored.withColumn("_named", named).withColumn("match_score", F.when(F.col("_named"), 100.0).otherwise(F.col("match_score"))).where(F.col("match_score") >= cutoff)
    best = scored.orderBy(F.desc("_named"), F.desc("match_score"), F.desc("influencer_count"), F.desc("review_count"), F.desc("social_post_count"), F.lower("brand"), F.lower("product_name"), "product_id").limit(limit)
    if number is not None:  # over the few rows left: the product of that id alone, if it is there
        best = best.withColumn("_any", F.max("_named").over(Window.partitionBy(F.lit(0)))).where("_named or not _any")
    return best.select(*rows.columns, "match_score")


def with_families(df: DataFrame, members: DataFrame, families: DataFrame) -> DataFrame:
    """Rows of one family become one, at the place of the first, under the family's name: counts add up, creators take the
    most of a member. df: roll-up rows with position; members: product_id, family_id; families: id, representative_product_id,
    brand, product_name."""
    m = members.select("product_id", "family_id")
    x = df.join(m, "product_id", "left").withColumn("_group", F.coalesce(F.concat(F.lit("f"), F.col("family_id")), F.concat(F.lit("p"), F.col("product_id"))))
    sums = x.groupBy("_group").agg(F.sum("review_count").alias("review_count"), F.sum("social_post_count").alias("social_post_count"), F.max("influencer_count").alias("influencer_count"))
    first = collapse(x.drop("review_count", "social_post_count", "influencer_count"), ["_group"], [], "position")
    f = families.select(F.col("id").alias("family_id"), F.col("representative_product_id").alias("_rep"), F.col("brand").alias("_fb"), F.col("product_name").alias("_fn"))
    out = first.join(sums, "_group").join(f, "family_id", "left")
    return out.select(F.coalesce("_rep", "product_id").alias("product_id"), F.coalesce("_fb", "brand").alias("brand"), F.coalesce("_fn", "product_name").alias("product_name"), "category", "review_count", "social_post_count", "influencer_count", "position")


def family_roll_up(df: DataFrame) -> DataFrame:
    """Variants of one family key: family, members, the one listed first, sums."""
    k = df.withColumn("family", family_key(F.col("brand"), F.col("product_name")))
    return k.groupBy("family").agg(F.count("*").alias("members"), F.min("product_id").alias("representative"), F.sum("review_count").alias("review_count"), F.sum("social_post_count").alias("social_post_count"), F.max("influencer_count").alias("influencer_count"))


def resolve(typed: DataFrame, catalog: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """typed (ref, brand, name) with product_id and how: by equal normalized names, else by an alias, else by identity key.

    catalog: id, normalized_brand, normalized_product_name, identity_key; the least id counts where several agree. aliases:
    normalized_brand, normalized_product_name, canonical_product_id. What none of them knows has a null product_id.
    """
    t = typed.withColumns({"nb": normalize("brand", "identity"), "nn": normalize("name", "identity"), "ik": identity_key(F.col("brand"), F.col("name"))})
    exact = catalog.groupBy(F.col("normalized_brand").alias("nb"), F.col("normalized_product_name").alias("nn")).agg(F.min("id").alias("_exact"))
    keyed = catalog.where("identity_key is not null").groupBy(F.col("identity_key").alias("ik")).agg(F.min("id").alias("_key"))
    out = t.join(exact, ["nb", "nn"], "left")
    if aliases is None:
        out = out.withColumn("_alias", F.lit(None).cast("long"))
    else:
        known = aliases.join(catalog.select(F.col("id").alias("canonical_product_id")), "canonical_product_id", "left_semi")
        out = out.join(known.groupBy(F.col("normalized_brand").alias("nb"), F.col("normalized_product_name").alias("nn")).agg(F.min("canonical_product_id").alias("_alias")), ["nb", "nn"], "left")
    out = out.join(keyed, "ik", "left")
    how = F.when(F.col("_exact").isNotNull(), "name").when(F.col("_alias").isNotNull(), "alias").when(F.col("_key").isNotNull(), "identity")
    return out.select(*typed.columns, F.coalesce("_exact", "_alias", "_key").alias("product_id"), how.alias("how"))


__all__ = ["approved_mentions", "browse", "by_rank", "catalogue", "family_roll_up", "in_category", "mentions", "posts", "products", "resolve", "roll_up", "search", "search_text", "with_families"]
