"""Core queries on evidence, reuse, families, caches, audits and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvina import queries_catalog as q
from corvina.functions.dates import dashed
from corvina.functions.keys import TYPE_NAMES, display_key, initials
from corvina.operators.keep import collapse, keep_best, top_n
from corvina.operators.latest import latest_per_key
from corvina.operators.merge import ordered_pairs
from corvina.plans import catalog as c
from corvina.plans import reports as r
from corvina.plans.detail import creator_presence
from corvina.session import table


def evidence(spark: SparkSession, d: str) -> DataFrame:
    m = c.mentions(spark, d, "social_post_id", "extracted_brand", "extracted_product_name", "evidence_text")
    m = m.select("id", F.col("social_post_id").alias("post_id"), F.col("extracted_brand").alias("brand"), F.col("extracted_product_name").alias("name"), F.col("evidence_text").alias("evidence"))
    return r.evidence_facts(m, c.posts(spark, d, "caption").withColumnRenamed("id", "post_id"))


def reuse(spark: SparkSession, d: str) -> DataFrame:
    m = c.mentions(spark, d, "social_post_id", "status").select(F.col("social_post_id").alias("post_id"), "status")
    return r.reusable(ordered_pairs(table(spark, d, "social_post_matches"), "post_id_a", "post_id_b"), c.posts(spark, d, "platform"), m)


def replaced_matches(spark: SparkSession, d: str) -> DataFrame:
    """Match records after the near ones of the posts of 2026 were taken back, by type."""
    m = table(spark, d, "social_post_matches").select("id", "post_id_a", "post_id_b", "match_type")
    late = c.posts(spark, d, "published_at").where("published_at >= '2026-01-01'").select("id")
    after = r.replace_automatic(m, m.limit(0), late, ["near"])
    return after.groupBy("match_type").agg(F.count("*").alias("records"), F.count_distinct("post_id_a").alias("posts"))


def product_families(spark: SparkSession, d: str) -> DataFrame:
    """Families of products with the same words; listings that carry the same identity key are one family already."""
    same = q.keyed_words(spark, d)
    first = same.groupBy("brand_key", "words").agg(F.min("id").alias("id_a"), F.count("*").alias("n")).where("n > 1")
    pairs = same.join(first, ["brand_key", "words"]).where("id > id_a").select("id_a", F.col("id").alias("id_b"))
    p = c.products(spark, d, "identity_key", "verification_status").where("identity_key is not null and verification_status = 'verified'")
    return r.reconciled_families(pairs, p.select(F.col("id").alias("product_id"), F.col("identity_key").alias("family_key")))


def cache(spark: SparkSession, d: str) -> DataFrame:
    """What the extraction of each caption still takes: nothing, a copy of an equal caption's, or a run."""
    p = c.posts(spark, d, "caption", "prompt_version").select("id", F.sha2("caption", 256).alias("digest"), "prompt_version")
    done = p.where("prompt_version = 'social-v4'")
    return r.cache_states(p, done, done, "id", "digest").groupBy("state").agg(F.count("*").alias("posts"), F.count_distinct("digest").alias("captions"))


def audit_report(spark: SparkSession, d: str) -> DataFrame:
    """Posts an audit finds: evidence that names another product, products of one evidence, mentions below 0.5 that are approved."""
    m = c.mentions(spark, d, "social_post_id", "status", "confidence")
    leaked = q.leaked_evidence(spark, d).join(m, "id").select(F.col("social_post_id").alias("id"))
    shared = q.same_evidence(spark, d).select(F.col("social_post_id").alias("id"))
    weak = m.where("status = 'approved' and confidence < 0.5").select(F.col("social_post_id").alias("id"))
    several = m.where("status = 'review'").groupBy(F.col("social_post_id").alias("id")).agg(F.count("*").alias("n")).where("n > 2")
    return r.audit([("leak", "high", leaked), ("shared evidence", "high", shared), ("weak approval", "medium", weak), ("open mentions", "low", several)])


def reextract(spark: SparkSession, d: str) -> DataFrame:
    """Posts to extract again: each once, under its gravest finding."""
    order = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return audit_report(spark, d).groupBy("id").agg(F.min_by("severity", order).alias("severity"), F.count("*").alias("findings"))


def restored(spark: SparkSession, d: str) -> DataFrame:
    """Mentions' products after listings of one identity key became one: found again by the key."""
    p = c.products(spark, d, "identity_key").select("id", "identity_key")
    m = c.mentions(spark, d, "product_id").where("product_id is not null")
    return r.restored_ids(m, p, p, "product_id", "identity_key").select("id", "product_id")


def ordered_mentions(spark: SparkSession, d: str) -> DataFrame:
    """The place of every approved mention on its product's page: reviews, then posts; dated first, the latest first; by creator."""
    m = c.approved_mentions(spark, d)
    day = dashed(F.col("published_at"))
    w = Window.partitionBy("product_id").orderBy(F.when(F.col("platform") == "tiktok", 0).otherwise(1), day.isNull(), F.desc(day), "influencer_slug", "mention_id")
    return m.select("product_id", "mention_id", F.row_number().over(w).alias("place"))


def first_links(spark: SparkSession, d: str) -> DataFrame:
    """The listing every item shows first: that of the preferred shop, then the surest, by identity key."""
    priority = F.when(F.col("merchant_slug") == "merch_alna", 0).when(F.col("merchant_slug") == "merch_boru", 1).when(F.col("merchant_slug").isNull(), 9).otherwise(5)
    p = c.products(spark, d, "identity_key", "merchant_slug", "verification_status").where("identity_key is not null")
    x = p.select("identity_key", "id", "merchant_slug", priority.alias("_p"), (F.col("verification_status") == "verified").cast("int").alias("_v"))
    return top_n(x, ["identity_key"], [F.col("_p"), F.desc("_v"), F.col("id")], 1).select("identity_key", "id", "merchant_slug")


def counted_captions(spark: SparkSession, d: str) -> DataFrame:
    return c.posts(spark, d, "caption").select("id", *r.text_counts(F.col("caption")))


def languages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(r.known_language(F.col("lang")).alias("language")).agg(F.count("*").alias("documents"))


def titles(spark: SparkSession, d: str) -> DataFrame:
    """For every listing the entry of its brand whose words its search text has most of; the least entry of equals."""
    e = table(spark, d, "catalog_reference").select("ref_id", "normalized_brand", "normalized_product_name")
    p = c.products(spark, d, "normalized_brand", "search_text")
    words = lambda x: r.words_in(F.trim(F.regexp_replace(x, "[^a-z0-9]+", " ")), (), TYPE_NAMES)
    e = e.select("ref_id", "normalized_brand", words(F.col("normalized_brand")).alias("b"), words(F.col("normalized_product_name")).alias("n"))
    x = p.select("id", "normalized_brand", words(F.col("search_text")).alias("w")).join(e, "normalized_brand").select("id", "ref_id", F.round(r.overlap_score(F.col("b"), F.col("n"), F.col("w")), 4).alias("score"))
    best = x.groupBy("id").agg(F.max(F.struct("score", (-F.col("ref_id")).alias("r"))).alias("x"))
    return best.select("id", (-F.col("x.r")).alias("ref_id"), "x.score")


def collected_posts(spark: SparkSession, d: str) -> DataFrame:
    """What was collected, with the stored post of that id and its matches: a post in several matches gives a row for each."""
    raw = table(spark, d, "raw_post_metadata").select("row_id", F.col("id").alias("external_post_id"))
    p = c.posts(spark, d, "platform", "external_post_id").where("platform = 'instagram'").select("external_post_id", F.col("id").alias("post_id"))
    m = ordered_pairs(table(spark, d, "social_post_matches"), "post_id_a", "post_id_b").select(F.col("post_id_a").alias("post_id"), F.col("post_id_b").alias("matched_id")).distinct()
    return raw.join(p, "external_post_id", "left").join(m, "post_id", "left").select("row_id", "post_id", "matched_id")


def table_rows(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name in ("influencers", "products", "product_id_redirects", "social_posts", "social_post_products", "social_post_matches", "raw_post_metadata"):
        n = table(spark, d, name).agg(F.lit(name).alias("table_name"), F.count("*").alias("rows"))
        out = n if out is None else out.unionByName(n)
    return out


def record_keys(spark: SparkSession, d: str) -> DataFrame:
    """The newest listing of every (brand, name, shop) key; listings without one of the three have no key."""
    p = c.products(spark, d, "normalized_brand", "normalized_product_name", "merchant_slug", "created_at").where("normalized_brand <> '' and normalized_product_name <> '' and merchant_slug is not null")
    k = p.select("id", "created_at", F.concat_ws("::", "normalized_brand", "normalized_product_name", "merchant_slug").alias("record_key"))
    return latest_per_key(k, ["record_key"], ["created_at"], ["id"]).select("record_key", "id")


def presence(spark: SparkSession, d: str) -> DataFrame:
    """Per product and creator on which platforms there is an approved mention."""
    return creator_presence(c.approved_mentions(spark, d))


def best_records(spark: SparkSession, d: str) -> DataFrame:
    """Of everything collected for a post the best record: with a description, the longer one, dated, the first row."""
    raw = table(spark, d, "raw_post_metadata").where("coalesce(trim(display_id), '') <> ''").select("display_id", "row_id", "description", "upload_date")
    filled = lambda x: (F.coalesce(F.trim(x), F.lit("")) != "").cast("int")
    best = keep_best(raw, ["display_id"], [filled("description"), F.length(F.coalesce("description", F.lit(""))), filled("upload_date")], "row_id")
    return best.select("display_id", "row_id")


def cards(spark: SparkSession, d: str) -> DataFrame:
    """Products that are one card, with the brand's initials: how many and the first."""
    p = c.products(spark, d, "normalized_brand", "normalized_product_name", "category")
    k = p.select("id", display_key(F.col("normalized_brand"), F.col("normalized_product_name"), F.col("category")).alias("card"), initials(F.col("normalized_brand")).alias("initials")).where("card is not null")
    return k.groupBy("card").agg(F.count("*").alias("products"), F.min("id").alias("first_id"), F.min("initials").alias("initials"))


def collapsed(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue with one row a card: the row of most creators, then reviews, at the place of the card's first product."""
    counts = c.catalogue(spark, d).select("product_id", "influencer_count", "review_count")
    p = c.products(spark, d, "normalized_brand", "normalized_product_name", "category").withColumnRenamed("id", "product_id")
    k = p.select("product_id", display_key(F.col("normalized_brand"), F.col("normalized_product_name"), F.col("category")).alias("card")).where("card is not null").join(counts, "product_id")
    best = collapse(k.withColumn("position", F.col("product_id")), ["card"], [F.col("influencer_count"), F.col("review_count")], "position")
    return best.select("card", "product_id", "influencer_count", "review_count", "position")


QUERIES = {
    "e9_presence": presence, "m1_best_records": best_records, "s13_cards": cards, "g12_collapsed": collapsed,
    "f2_evidence": evidence, "d21_reuse": reuse, "j5_replaced_matches": replaced_matches, "h6_families": product_families, "j8_cache": cache, "f26_audit": audit_report, "j9_reextract": reextract, "b13_restored": restored,
    "g3_ordered_mentions": ordered_mentions, "g1_first_links": first_links, "s26_counted_captions": counted_captions, "s27_languages": languages, "s10_titles": titles, "d5_collected_posts": collected_posts,
    "m26_table_rows": table_rows, "m12_record_keys": record_keys,
}

_STRONG = f"g as (select a, b, match_type, similarity from (select * from e) where match_type = 'exact' or similarity >= 0.97), {q.S}, t as (select a x, b y, match_type, similarity from g union all select b, a, match_type, similarity from g)"
_TITLE_WORDS = "list_distinct(list_filter(list_transform(string_split(trim(regexp_replace({0}, '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: coalesce(" + q._TYPES + "[w], w)), lambda w: length(w) >= 2 and not regexp_matches(w, '^[0-9]+$')))"
_AUDIT = f"""{q.M}, mm as (select id, social_post_id, product_id, lower(evidence_text) evidence, lower(trim(evidence_text)) whole, lower(trim(extracted_product_name)) name from m where product_id is not null),
  f as (select distinct x.social_post_id as id, 'leak' as rule, 'high' as severity from mm x join mm o on o.social_post_id = x.social_post_id and o.product_id <> x.product_id and length(o.name) >= 8 and contains(x.evidence, o.name)
    union all select distinct social_post_id, 'shared evidence', 'high' from (select social_post_id, whole from mm group by 1, 2 having count(distinct product_id) > 1)
    union all select distinct social_post_id, 'weak approval', 'medium' from m where status = 'approved' and confidence < 0.5
    union all select social_post_id, 'open mentions', 'low' from m where status = 'review' group by 1 having count(*) > 2)"""
_SHOWN = "trim(regexp_replace({0}, '[^a-z0-9]+', ' ', 'g'))"
_CARD = f"""k as (select id, {_SHOWN.format('normalized_brand')} b, {_SHOWN.format('normalized_product_name')} n, {_SHOWN.format("lower(coalesce(category, ''))")} cat, normalized_brand nb from p),
  y as (select id, nb, coalesce(map {{'maybelline new york': 'maybelline', 'kiehls since 1851': 'kiehls', 'l oreal paris': 'loreal', 'loreal paris': 'loreal'}}[b], b) || '|' || array_to_string(list_transform(string_split(n, ' '), lambda w: case when w in ('fondoten', 'fondotenim') then 'foundation' else w end), ' ') || '|' || cat as card from k where b <> '' and n <> '')"""
_WORDS_OF = "list_filter(string_split_regex(nb, '\\s+'), lambda w: w <> '')[1:2]"
SQL = {
    "e9_presence": f"with {q.APPROVED} select product_id, influencer_slug, max(display_name) as display_name, bool_or(platform = 'youtube') as has_youtube, bool_or(platform = 'tiktok') as has_tiktok, bool_or(platform = 'instagram') as has_instagram from a group by 1, 2",
    "m1_best_records": "select display_id, row_id from (select *, row_number() over (partition by display_id order by trim(coalesce(description, '')) <> '' desc, length(coalesce(description, '')) desc, trim(coalesce(upload_date, '')) <> '' desc, row_id) rn from raw_post_metadata where trim(coalesce(display_id, '')) <> '') where rn = 1",
    "s13_cards": f"with {q.P}, {_CARD} select card, count(*) as products, min(id) as first_id, min(upper(array_to_string(list_transform({_WORDS_OF}, lambda w: left(w, 1)), ''))) as initials from y group by 1",
    "g12_collapsed": f"with {q.CATALOGUE}, {_CARD}, z as (select y.card, y.id, c.influencer_count, c.review_count, min(y.id) over (partition by y.card) as position, row_number() over (partition by y.card order by c.influencer_count desc, c.review_count desc, y.id) rn from y join c on c.product_id = y.id) select card, id as product_id, influencer_count, review_count, position from z where rn = 1",
    "f2_evidence": f"""with {q.M}, {q.S}, x as (select m.*, s.caption, case when trim(coalesce(evidence_text, '')) <> '' then instr(s.caption, evidence_text) else 0 end as pos from m left join s on s.id = m.social_post_id)
      select id, case when caption is not null then pos > 0 end as found, case when pos > 0 then pos - 1 end as start, case when pos > 0 then length(left(caption, pos - 1)) - length(replace(left(caption, pos - 1), chr(10), '')) + 1 end as line,
        trim(coalesce(extracted_brand, '')) <> '' and instr(coalesce(caption, ''), extracted_brand) > 0 as brand_there, trim(coalesce(extracted_product_name, '')) <> '' and instr(coalesce(evidence_text, ''), extracted_product_name) > 0 as name_there from x""",
    "d21_reuse": f"""with {q._PAIRS}, {_STRONG}, {q.M}, good as (select social_post_id, count(*) n from m group by 1 having bool_and(status = 'approved')),
      k as (select t.x, t.y, good.n, row_number() over (partition by t.x order by match_type = 'exact' desc, coalesce(similarity, 0) desc, t.y) rn from t join s i on i.id = t.x and i.platform = 'instagram' join s k on k.id = t.y and k.platform = 'tiktok' join good on good.social_post_id = t.y)
      select x as post_id, y as source_id, n as mentions from k where rn = 1""",
    "j5_replaced_matches": f"with {q.S} select match_type, count(*) as records, count(distinct post_id_a) as posts from social_post_matches where match_type <> 'near' or post_id_a not in (select id from s where published_at >= '2026-01-01') group by 1",
    "h6_families": f"""with {q.P}, x as (select id, array_to_string(regexp_extract_all(normalized_brand, '[a-z0-9]+'), ' ') as bk, array_to_string(list_sort({q._WORDS.format('normalized_product_name')}), ' ') as words from p),
      g as (select id, min(id) over (partition by bk, words) as root, count(*) over (partition by bk, words) as n from x where bk <> '' and words <> ''), f as (select id, identity_key k from p where identity_key is not null and verification_status = 'verified'),
      y as (select g.id, g.root, f.k from g left join f on f.id = g.id where n > 1), o as (select root, count(distinct k) n, min(k) one from y group by 1)
      select y.id as product_id, case when o.n > 1 then y.k when o.n = 1 then o.one else 'reconciled-exact-' || y.root end as family_key, case when o.n > 1 then 'conflict' when y.k is not null then 'kept' when o.n = 1 then 'joined' else 'founded' end as action from y join o on o.root = y.root""",
    "j8_cache": f"with {q.S}, x as (select id, sha256(caption) h, coalesce(prompt_version = 'social-v4', false) done from s), k as (select distinct h from x where done) select case when done then 'cached' when h in (select h from k) then 'restored' else 'pending' end as state, count(*) as posts, count(distinct h) as captions from x group by 1",
    "f26_audit": f"with {_AUDIT} select id, rule, severity from f",
    "j9_reextract": f"with {_AUDIT} select id, arg_min(severity, case severity when 'high' then 0 when 'medium' then 1 else 2 end) as severity, count(*) as findings from f group by 1",
    "b13_restored": f"with {q.P}, {q.M}, n as (select identity_key k, min(id) i from p where identity_key is not null group by 1) select m.id, n.i as product_id from m left join p on p.id = m.product_id left join n on n.k = p.identity_key where m.product_id is not null",
    "g3_ordered_mentions": f"with {q.APPROVED}, x as (select *, {q._DAY.format('published_at')} as day from a) select product_id, mention_id, row_number() over (partition by product_id order by case when platform = 'tiktok' then 0 else 1 end, day is null, day desc, influencer_slug, mention_id) as place from x",
    "g1_first_links": f"with {q.P}, x as (select identity_key, id, merchant_slug, row_number() over (partition by identity_key order by case when merchant_slug = 'merch_alna' then 0 when merchant_slug = 'merch_boru' then 1 when merchant_slug is null then 9 else 5 end, verification_status = 'verified' desc, id) rn from p where identity_key is not null) select identity_key, id, merchant_slug from x where rn = 1",
    "s26_counted_captions": f"with {q.S}, x as (select id, coalesce(caption, '') t from s) select id, length(t) as characters, case when t = '' then 0 else length(t) - length(replace(t, chr(10), '')) + 1 end as lines, len(list_filter(string_split_regex(t, '[ \\t\\n\\r]+'), lambda w: w <> '')) as words from x",
    "s27_languages": "select case when lower(trim(coalesce(lang, ''))) in ('tr', 'en') then lower(trim(lang)) else 'tr' end as language, count(*) as documents from documents group by 1",
    "s10_titles": f"""with {q.P}, e as (select ref_id, normalized_brand nb, {_TITLE_WORDS.replace('{0}', 'normalized_brand')} b, {_TITLE_WORDS.replace('{0}', 'normalized_product_name')} n from catalog_reference), t as (select id, normalized_brand nb, {_TITLE_WORDS.replace('{0}', 'search_text')} w from p),
      x as (select id, ref_id, round(0.3 * case when len(b) > 0 then len(list_intersect(b, w)) / len(b) else 0 end + 0.7 * case when len(n) > 0 then len(list_intersect(n, w)) / len(n) else 0 end, 4) as score from t join e on e.nb = t.nb)
      select id, ref_id, score from (select *, row_number() over (partition by id order by score desc, ref_id) rn from x) where rn = 1""",
    "d5_collected_posts": f"with {q.S}, {q._PAIRS}, k as (select distinct a, b from e) select w.row_id, s.id as post_id, k.b as matched_id from raw_post_metadata w left join s on s.external_post_id = w.id and s.platform = 'instagram' left join k on k.a = s.id",
    "m26_table_rows": " union all ".join(f"select '{t}' as table_name, count(*) as rows from {t}" for t in ("influencers", "products", "product_id_redirects", "social_posts", "social_post_products", "social_post_matches", "raw_post_metadata")),
    "m12_record_keys": f"with {q.P} select normalized_brand || '::' || normalized_product_name || '::' || merchant_slug as record_key, arg_max(id, (created_at, id)) as id from p where normalized_brand <> '' and normalized_product_name <> '' and merchant_slug is not null group by 1",
}
