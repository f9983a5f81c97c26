"""Reading posts' metadata as collected: what they say, whether it agrees, and why not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POST_PATH = r"^/(?:([A-Za-z0-9_.]+)/)?(reel|p)/([A-Za-z0-9_-]+)/?$"


def checked_posts(raw: DataFrame, handles: DataFrame, hosts: list[str]) -> DataFrame:
    """row_id, influencer_slug, external_post_id, published_at, caption_sha256, reason (null: accepted).

    raw: row_id, id, display_id, webpage_url, original_url, channel, upload_date, epoch_seconds, description. handles: handle,
    slug (a channel matches a handle whatever its case, dots and underscores). The first fault counts: no or a foreign link,
    ids that disagree, an unknown or other account, no readable date. An upload date goes before the time stamp (UTC).
    """
    plain = lambda c: F.regexp_replace(F.trim(F.lower(F.translate(F.coalesce(c, F.lit("")), "İ", "i"))), r"[@._]", "")
    r = raw
    for name in ("webpage_url", "original_url"):
        u = F.trim(F.coalesce(F.col(name), F.lit("")))
        part = lambda p, u=u: F.call_function("try_parse_url", u, F.lit(p))
        good = (part("PROTOCOL") == "https") & part("HOST").isin(hosts) & part("USERINFO").isNull() & part("PATH").rlike(POST_PATH)
        r = r.withColumns({
            f"_{name}_ok": F.when(u == "", F.lit(None).cast("boolean")).otherwise(F.coalesce(good, F.lit(False))),
            f"_{name}_account": F.regexp_extract(part("PATH"), POST_PATH, 1), f"_{name}_code": F.nullif(F.regexp_extract(part("PATH"), POST_PATH, 3), F.lit("")),
        })
    code = F.coalesce("_webpage_url_code", "_original_url_code")
    differs = F.lit(False)
    for c in ("_webpage_url_code", "_original_url_code", "id", "display_id"):
        v = F.nullif(F.trim(F.col(c)), F.lit(""))
        differs = differs | (v.isNotNull() & (v != code))
    h = handles.select(plain(F.col("handle")).alias("_h"), F.col("slug").alias("influencer_slug"))
    r = r.withColumn("_h", plain(F.col("channel"))).join(h, "_h", "left")
    foreign = F.lit(False)
    for c in ("_webpage_url_account", "_original_url_account"):
        a = plain(F.col(c))
        foreign = foreign | ((a != "") & (a != F.col("_h")))
    raw_date = F.trim(F.coalesce("upload_date", F.lit("")))
    day = F.when(raw_date != "", F.when(raw_date.rlike(r"^\d{8}$"), F.try_to_timestamp(raw_date, F.lit("yyyyMMdd")).cast("date"))).otherwise(F.timestamp_seconds("epoch_seconds").cast("date"))
    reason = (
        F.when(F.col("_webpage_url_ok").isNull() & F.col("_original_url_ok").isNull(), "no link")
        .when(~F.coalesce("_webpage_url_ok", F.lit(True)) | ~F.coalesce("_original_url_ok", F.lit(True)), "no post link")
        .when(differs, "ids disagree").when(F.col("influencer_slug").isNull(), "unknown account").when(foreign, "other account").when(day.isNull(), "no date")
    )
    return r.select("row_id", "influencer_slug", code.alias("external_post_id"), F.date_format(day, "yyyy-MM-dd").alias("published_at"), F.sha2(F.coalesce("description", F.lit("")), 256).alias("caption_sha256"), reason.alias("reason"))


VIDEO_PATH = r"^/@([^/]+)/(video|photo)/(\d+)/?$"


def checked_videos(raw: DataFrame, handles: DataFrame, hosts: list[str]) -> DataFrame:
    """row_id, influencer_slug, external_post_id, original_url (canonical, on the first host), published_at, caption, caption_sha256, reason (null:
    accepted) of video metadata: the first fault counts, of an id that is no number, a link that is not one of its account and id, and
    a day that is none. raw: row_id, id, webpage_url, original_url, upload_date, description; handles: handle, slug (compared without case)."""
    url = F.coalesce(F.nullif(F.trim("webpage_url"), F.lit("")), F.trim("original_url"), F.lit(""))
    part = lambda p: F.call_function("try_parse_url", url, F.lit(p))
    r = raw.withColumns({"_path": part("PATH"), "_good": (part("PROTOCOL") == "https") & part("HOST").isin(hosts) & part("PATH").rlike(VIDEO_PATH)})
    r = r.withColumns({"_handle": F.lower(F.regexp_extract("_path", VIDEO_PATH, 1)), "_code": F.regexp_extract("_path", VIDEO_PATH, 3), "_id": F.trim(F.coalesce(F.col("id").cast("string"), F.lit("")))})
    r = r.join(handles.select(F.lower("handle").alias("_handle"), F.col("slug").alias("influencer_slug")), "_handle", "left")
    day = F.when(F.trim("upload_date").rlike(r"^\d{8}$"), F.try_to_timestamp(F.trim("upload_date"), F.lit("yyyyMMdd")).cast("date"))
    number = F.col("_id").rlike(r"^\d+$")
    fits = F.coalesce("_good", F.lit(False)) & (F.col("_code") == F.col("_id")) & F.col("influencer_slug").isNotNull()
    reason = F.when(~number, "no id").when(~fits, "link does not fit").when(day.isNull(), "no date")
    caption = F.coalesce("description", F.lit(""))
    canonical = F.when(fits, F.concat(F.lit(f"https://{hosts[0]}"), F.regexp_replace("_path", "/+$", "")))
    return r.select("row_id", "influencer_slug", F.when(number, F.col("_id")).alias("external_post_id"), canonical.alias("original_url"), F.date_format(day, "yyyy-MM-dd").alias("published_at"), caption.alias("caption"), F.sha2(caption, 256).alias("caption_sha256"), reason.alias("reason"))
