"""Purchase links and images: their records, merges, families, and what still has to be looked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.functions.keys import family_key
from corvina.functions.links import canonical_url, domain, in_domain, merchant_name
from corvina.functions.normalize import normalize
from corvina.operators.keep import keep_best, top_n
from corvina.operators.merge import new_if_given, sticky, upsert
from corvina.session import shuffled

# States of stock, and kinds of image sources that are stored as such.
STOCK_STATES = ["in_stock", "out_of_stock", "unknown"]
IMAGE_SOURCES = ["og_image", "json_ld", "twitter_image", "manual"]
LINK_RECORD = "brand string, product_name string, merchant_slug string, merchant_name string, link_type string, url string, domain string, verification_status string, match_confidence double, source_title string, verified_at string, checked_at string, stock_status string, stock_checked_at string"


def link_records(documents: DataFrame, column: str = "document", blocked: Sequence[str] = (), generic: str = "generic_retailer") -> DataFrame:
    """file, position and the fields of every link of JSON documents: objects with a list `links`, or bare lists. Entries that are no
    objects, links without a host and a generic shop's links of blocked domains (or their subdomains) are left out; a generic shop is
    called after its domain. documents: file and the JSON text."""
    held = F.from_json(F.col(column), f"links array<struct<{_struct(LINK_RECORD)}>>")["links"]
    bare = F.from_json(F.col(column), f"array<struct<{_struct(LINK_RECORD)}>>")
    rows = documents.select("file", F.posexplode(F.coalesce(F.when(F.ltrim(column).startswith("["), bare).otherwise(held), F.array())).alias("position", "l")).select("file", "position", "l.*")
    host = F.coalesce(domain(F.concat(F.lit("https://"), F.nullif(F.trim("domain"), F.lit("")))), domain(F.col("url")))
    rows = rows.withColumn("domain", host).where(F.col("url").isNotNull() & F.col("domain").isNotNull())
    is_generic = F.coalesce(F.col("merchant_slug") == generic, F.lit(False))
    bad = F.lit(False)
    for b in blocked:
        bad = bad | in_domain(F.col("domain"), F.lit(b))
    return rows.where(~(is_generic & bad)).withColumn("merchant_name", F.when(is_generic, merchant_name(F.col("domain"))).otherwise(F.col("merchant_name")))


def _struct(ddl: str) -> str:
    return ",".join(":".join(x.split()) for x in ddl.split(","))


def record_key(brand: Column, name: Column) -> Column:
    return F.concat(normalize(brand, "link"), F.lit("::"), normalize(name, "link"))


def link_identity(brand: Column, name: Column, merchant: Column, url: Column) -> Column:
    """What a link is known by; null where a part is missing."""
    whole = (F.trim(F.coalesce(brand, F.lit(""))) != "") & (F.trim(F.coalesce(name, F.lit(""))) != "") & (F.trim(F.coalesce(merchant, F.lit(""))) != "") & canonical_url(url).isNotNull()
    return F.when(whole, F.concat_ws("\x1f", record_key(brand, name), merchant, canonical_url(url)))


def merged_links(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with new's links by (product, merchant, url): a verified one stays verified, an unknown stock state changes nothing, a time of
    the stock check stays while no new one is given; everything else is the newer. new has one row a link."""
    known = new.withColumn("stock_status", F.when(F.col("stock_status").isin(STOCK_STATES), F.col("stock_status")).otherwise("unknown"))
    stock = lambda o, n: F.when(n != "unknown", n).otherwise(o)
    return upsert(old, known, ["product_id", "merchant_slug", "url"], {"verification_status": sticky("verified"), "stock_status": stock, "stock_checked_at": new_if_given})


def merged_images(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with new's images by (product, image url): a verified one stays verified; kinds of sources that are not stored count as manual."""
    known = new.withColumn("source_type", F.when(F.col("source_type").isin(IMAGE_SOURCES), F.col("source_type")).otherwise("manual"))
    return upsert(old, known, ["product_id", "image_url"], {"verification_status": sticky("verified")})


def of_products(rows: DataFrame, products: DataFrame) -> DataFrame:
    """Verified links or images with their product's brand and name."""
    return rows.where("verification_status = 'verified'").join(shuffled(products.select(F.col("id").alias("product_id"), "brand", "product_name")), "product_id")


def without_image(links: DataFrame, images: DataFrame, again: bool = False) -> DataFrame:
    """Products with a verified link and no verified image (with any, if images are to be looked for again), each once."""
    have = links.where("verification_status = 'verified'").select("product_id").distinct()
    return have if again else have.join(shuffled(images.where("verification_status = 'verified'").select("product_id")), "product_id", "left_anti")


def family_links(links: DataFrame) -> DataFrame:
    """family and its verified links in order of url: what a member can take over. links: brand, product_name, url, verification_status."""
    x = links.where("verification_status = 'verified'").select(family_key(F.col("brand"), F.col("product_name")).alias("family"), "url")
    return x.groupBy("family").agg(F.array_sort(F.collect_set("url")).alias("urls"))


def plausible_official(brand: Column, host: Column, configured: Column) -> Column:
    """Whether a domain can be a brand's own: one of those configured (an array) or under it, or one that has the brand in its name."""
    bare = lambda c: F.replace(normalize(c, "link"), F.lit(" "), F.lit(""))
    under = F.exists(F.coalesce(configured, F.array().cast("array<string>")), lambda d: in_domain(host, d))
    return under | ((bare(brand) != "") & F.contains(bare(host), bare(brand)))


def new_pages(found: DataFrame, known: DataFrame, keys: Sequence[str], n: int, least: float = 0.72) -> DataFrame:
    """The n surest exact pages per key that are not known yet, by confidence, then address. found: keys, url, exact, confidence; a page
    found twice counts with the greater confidence. known: keys, url."""
    good = found.where(F.col("exact") & (F.col("confidence") >= least)).withColumn("url", canonical_url(F.col("url"))).where("url is not null")
    best = good.groupBy(*keys, "url").agg(F.max("confidence").alias("confidence"))
    best = best.join(shuffled(known.select(*keys, canonical_url(F.col("url")).alias("url"))), [*keys, "url"], "left_anti")
    return top_n(best, keys, [F.desc("confidence"), F.col("url")], n)


def searched(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Results of several searches as one list per key: an address counts once, where the first search has it first.
    results: keys, query_no, position, url, title."""
    first = results.withColumn("url", canonical_url(F.col("url"))).where("url is not null")
    rest = [c for c in first.columns if c not in (*keys, "url")]
    best = first.groupBy(*keys, "url").agg(F.min_by(F.struct(*rest), F.struct("query_no", "position")).alias("_x"))
    return best.select(*keys, "url", *[F.col(f"_x.{c}").alias(c) for c in rest])


def best_images(candidates: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The n best image addresses per key: those of http or https, each once with its greatest score; ties by address."""
    good = candidates.where(F.col("url").rlike("^https?://[^/]+"))
    best = keep_best(good.withColumn("_one", F.lit(1)), [*keys, "url"], [F.col("score")], "_one").drop("_one")
    return top_n(best, keys, [F.desc("score"), F.col("url")], n)


def creators_of_families(presence: DataFrame, members: DataFrame) -> DataFrame:
    """family_id, influencer_slug, display_name of everyone present at a member, each once; of several names the one of the last product.
    presence: product_id, influencer_slug, display_name."""
    x = presence.join(shuffled(members.select("product_id", "family_id")), "product_id")
    return x.groupBy("family_id", "influencer_slug").agg(F.max_by("display_name", "product_id").alias("display_name"))
