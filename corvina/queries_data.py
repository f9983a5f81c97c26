"""Core queries over the project's tables that concern data quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.operators.latest import latest_per_key
from corvina.operators.orphans import OrphanState, advance, existence_delta, orphan_rows, redirect_delta, reference_delta
from corvina.session import cut, table


def month_of(text: str) -> Column:
    """YYYY-MM of a date written YYYY-MM-DD or YYYYMMDD; anything else gives null."""
    d = F.trim(F.col(text))
    return F.when(d.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(d, 1, 7)).when(d.rlike(r"^\d{8}$"), F.concat(F.substring(d, 1, 4), F.lit("-"), F.substring(d, 5, 2)))


def product_references(spark: SparkSession, d: str) -> DataFrame:
    """table_name, record_id, key, post_id, period of every distinct reference to a product (period of mentions still open)."""
    mentions = table(spark, d, "social_post_products").where("product_id is not null").select(
        F.lit("social_post_products").alias("table_name"), F.col("id").alias("record_id"), F.col("product_id").alias("key"), F.col("social_post_id").alias("post_id"), F.lit(None).cast("string").alias("period")
    ).distinct()
    redirects = table(spark, d, "product_id_redirects").where("canonical_product_id is not null").select(
        F.lit("product_id_redirects").alias("table_name"), F.col("old_product_id").alias("record_id"), F.col("canonical_product_id").alias("key"), F.lit(None).cast("long").alias("post_id"), F.date_format("created_at", "yyyy-MM").alias("period")
    ).distinct()
    return mentions.unionByName(redirects)


def _report(spark: SparkSession, d: str, refs: DataFrame, state: OrphanState) -> DataFrame:
    """table_name, record_id and period of the references to the state's orphans."""
    lost = cut(orphan_rows(refs, state.orphans()))
    # only the lost rows need their post: the posts are reduced to those first
    wanted = lost.where("post_id is not null").select(F.col("post_id").alias("id")).distinct()
    posts = table(spark, d, "social_posts").select("id", "published_at", "updated_at").join(wanted, "id", "left_semi")
    month = latest_per_key(posts, ["id"], ["updated_at"], ["published_at"]).select(F.col("id").alias("post_id"), month_of("published_at").alias("of_post"))
    return lost.join(month, "post_id", "left").select("table_name", "record_id", F.coalesce("period", "of_post").alias("period")).distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The first state, from nothing: all rows are one delta."""
    refs = product_references(spark, d)
    state = advance(None, [existence_delta(table(spark, d, "products").select("id").distinct(), F.col("id")), reference_delta(refs, F.col("key"))], redirect_delta(table(spark, d, "product_id_redirects"), "old_product_id", "canonical_product_id"))
    return _report(spark, d, refs, state)


def p4_incremental(spark: SparkSession, d: str) -> DataFrame:
    """The same report from a state that was kept and moved on: products and redirects of 2026 arrive as deltas to the state
    of the end of 2025, which is written and read again in between."""
    refs, redirects = product_references(spark, d), table(spark, d, "product_id_redirects")
    products = table(spark, d, "products").where("id is not null").groupBy(F.col("id").alias("key")).agg(F.min("created_at").alias("since"))
    old, new = (lambda x, at: x.where(F.col(at) < "2026-01-01")), (lambda x, at: x.where(~F.coalesce(F.col(at) < "2026-01-01", F.lit(False))))
    ways = lambda x: redirect_delta(x, "old_product_id", "canonical_product_id")
    state = advance(None, [existence_delta(old(products, "since"), F.col("key")), reference_delta(refs, F.col("key"))], ways(old(redirects, "created_at")))
    state = OrphanState(*[cut(t) for t in state.tables().values()])
    state = advance(state, [existence_delta(new(products, "since"), F.col("key"))], ways(new(redirects, "created_at")))
    return _report(spark, d, refs, state)


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return p4_found(spark, d).groupBy("table_name", "period").agg(F.count("*").alias("orphans"))


P4_CTE = """
with recursive reach(key) as (
  select id from products where id is not null
  union
  select r.old_product_id from reach join product_id_redirects r on r.canonical_product_id = reach.key where r.old_product_id is not null
),
month(id, m) as (
  select id, case when regexp_matches(arg_max(published_at, updated_at), '^\\d{4}-\\d{2}-\\d{2}') then substr(arg_max(published_at, updated_at), 1, 7)
    when regexp_matches(arg_max(published_at, updated_at), '^\\d{8}$') then substr(arg_max(published_at, updated_at), 1, 4) || '-' || substr(arg_max(published_at, updated_at), 5, 2) end
  from social_posts group by id
),
lost as (
  select distinct 'social_post_products' as table_name, s.id as record_id, m.m as period
  from social_post_products s left join month m on m.id = s.social_post_id
  where s.product_id is not null and s.product_id not in (select key from reach)
  union
  select distinct 'product_id_redirects', old_product_id, strftime(created_at, '%Y-%m') from product_id_redirects
  where canonical_product_id is not null and canonical_product_id not in (select key from reach)
)
"""

QUERIES = {"p4_found": p4_found, "p4_incremental": p4_incremental, "p4_report": p4_report}
SQL = {
    "p4_found": P4_CTE + "select table_name, record_id, period from lost",
    "p4_incremental": P4_CTE + "select table_name, record_id, period from lost",
    "p4_report": P4_CTE + "select table_name, period, count(*) as orphans from lost group by all",
}
