"""The queries of the operators in this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.llm import oracles
from corvina.llm.catalogue import same_items
from corvina.llm.components import connected_components
from corvina.llm.leakage import find_leaks
from corvina.llm.lookalike import normalize_lookalikes
from corvina.llm.mapping import NO_MATCH, map_rows
from corvina.llm.mixing import counted_documents, mix, mix_counted, mix_report
from corvina.llm.neardup import near_duplicate_groups
from corvina.llm.pii import find_personal, redact_personal
from corvina.llm.sentences import split_sentences
from corvina.operators.latest import latest_per_key
from corvina.session import cut, table


def _posts(spark: SparkSession, d: str) -> DataFrame:
    return latest_per_key(table(spark, d, "social_posts").where("id is not null"), ["id"], ["updated_at"], ["caption"])


def _listings(spark: SparkSession, d: str) -> DataFrame:
    return latest_per_key(table(spark, d, "products").where("id is not null"), ["id"], ["updated_at"], ["brand", "product_name", "normalized_brand", "normalized_product_name", "identity_key"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    typed = table(spark, d, "social_post_products").select(F.lit("social_post_products").alias("table_name"), F.col("id").alias("record_id"), F.col("extracted_brand").alias("brand"), F.col("extracted_product_name").alias("name")).distinct()
    listed = _listings(spark, d).select(F.lit("products").alias("table_name"), F.col("id").alias("record_id"), F.col("normalized_brand").alias("brand"), F.col("normalized_product_name").alias("name"))
    return map_rows(typed.unionByName(listed), ["table_name", "record_id"], "brand", "name", table(spark, d, "catalog_reference"), "ref_id", "brand", "product_name")


def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Per table how many rows have an entry and how many have none."""
    return p1_found(spark, d).groupBy("table_name").agg(F.count_if(F.col("ref_id") != NO_MATCH).alias("matched"), F.count_if(F.col("ref_id") == NO_MATCH).alias("unmatched"))


def _named(spark: SparkSession, d: str) -> DataFrame:
    """Both fields of problem 2 as table_name, record_id, text; each distinct row once."""
    posts = table(spark, d, "social_posts").select(F.lit("social_posts").alias("table_name"), F.col("id").alias("record_id"), F.col("caption").alias("text"), "updated_at")
    names = table(spark, d, "products").select(F.lit("products").alias("table_name"), F.col("id").alias("record_id"), F.col("product_name").alias("text"), "updated_at")
    return latest_per_key(posts.unionByName(names), ["table_name", "record_id"], ["updated_at"], ["text"])


def p2_canonical(spark: SparkSession, d: str) -> DataFrame:
    return normalize_lookalikes(_named(spark, d), "text", ["table_name", "record_id"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_canonical(spark, d).where("affected").select("table_name", "record_id")


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """A row per post; links counts exactly, which takes time with the square of a group, p3_found needs none of it."""
    return near_duplicate_groups(_posts(spark, d), "id", "caption")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs within a group, as the query is defined; p3_groups is the form whose rows do not grow with a group's square."""
    g = near_duplicate_groups(_posts(spark, d), "id", "caption", with_links=False)
    g = cut(g.join(g.groupBy("group_id").count().where("count > 1").select("group_id"), "group_id", "left_semi"))
    return g.select("group_id", F.col("id").alias("post_id_a")).join(g.select("group_id", F.col("id").alias("post_id_b")), "group_id").where("post_id_a < post_id_b").select("post_id_a", "post_id_b")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return connected_components(table(spark, d, "social_post_matches"), "post_id_a", "post_id_b").select(F.col("id").alias("post_id"), "group_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The kinds the problem names; card and account numbers are found and replaced as well, but no rows here."""
    posts = table(spark, d, "raw_post_metadata").select("row_id", "description")
    return find_personal(posts, "row_id", "description", table(spark, d, "given_names")).where("pii_type not in ('card', 'iban')").select("row_id", "start_pos", "end_pos", "pii_type").distinct()


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    return redact_personal(table(spark, d, "raw_post_metadata").select("row_id", "description"), "row_id", "description", table(spark, d, "given_names"))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    return same_items(_listings(spark, d), "id", "brand", "product_name", table(spark, d, "catalog_reference").select("brand", "product_name"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs within an item, as the query is defined; p7_groups is the form that does not grow with a group's square."""
    g = p7_groups(spark, d)
    g = cut(g.join(g.groupBy("group_id").count().where("count > 1").select("group_id"), "group_id", "left_semi"))
    return g.select("group_id", F.col("id").alias("product_id_a")).join(g.select("group_id", F.col("id").alias("product_id_b")), "group_id").where("product_id_a < product_id_b").select("product_id_a", "product_id_b")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Per leaked item in how many documents it stands."""
    found = p8_found(spark, d).groupBy("item_id").agg(F.count("*").alias("documents"))
    return table(spark, d, "eval_items").select("item_id", "suite", "lang").join(found, "item_id")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents").select("doc_id", "source", "text"), "doc_id", "source", "text", table(spark, d, "mix_targets"))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    documents, targets = counted_documents(table(spark, d, "documents").select("doc_id", "source", "text"), "doc_id", "source", "text"), table(spark, d, "mix_targets")
    return mix_report(cut(mix_counted(documents, targets)), "source", targets, documents)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return split_sentences(table(spark, d, "documents").select("doc_id", "text", "lang"), "doc_id", "text", with_text=False, lang="lang")


def p10_sentences(spark: SparkSession, d: str) -> DataFrame:
    return split_sentences(table(spark, d, "documents").select("doc_id", "text", "lang"), "doc_id", "text", lang="lang")


QUERIES = {
    "p8_found": p8_found, "p8_items": p8_items, "p9_mix": p9_mix, "p9_report": p9_report, "p10_found": p10_found, "p10_sentences": p10_sentences,
    "p6_found": p6_found, "p6_redacted": p6_redacted,
    "p1_found": p1_found, "p1_unmatched": p1_unmatched, "p7_found": p7_found, "p7_groups": p7_groups,
    "p2_found": p2_found, "p2_canonical": p2_canonical, "p3_found": p3_found, "p3_groups": p3_groups, "p5_found": p5_found}
SQL = {
    **oracles.SQL,
    "p5_found": """
with recursive e as (
  select post_id_a a, post_id_b b from social_post_matches where post_id_a is not null and post_id_b is not null
  union select post_id_b, post_id_a from social_post_matches where post_id_a is not null and post_id_b is not null
),
walk(root, id) as (select a, a from e union select walk.root, e.b from walk join e on e.a = walk.id where e.b > walk.root or e.b < walk.root)
select root as post_id, min(id) as group_id from walk group by root"""
}
