"""Files the pipeline reads: JSON documents, review CSVs, transcripts, and the reports it writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvina.functions.dates import to_day
from corvina.functions.normalize import normalize

# Report files that lie beside the documents.
REPORTS = ["summary", "run_summary", "report", "_summary", "errors", "state", "pending"]

RAW_POST = "id string, display_id string, webpage_url string, original_url string, channel string, uploader string, uploader_id string, upload_date string, timestamp double, published_at string, description string, caption string, title string, _type string"
MATCHES = "matches array<struct<match_type:string,similarity:double,date_distance_days:int,instagram_id:string,instagram_url:string,instagram_caption:string,tiktok_id:string,tiktok_url:string,tiktok_caption:string>>"
MENTIONS = "platform string, influencer_slug string, external_post_id string, caption string, original_url string, published_at string, caption_sha256 string, extraction_status string, prompt_version string, model string, extracted_at string, products array<struct<brand:string,product_name:string,category:string,evidence_text:string,confidence:double,status:string,status_reason:string>>"


def stem(path: Column) -> Column:
    """The file's name without its endings."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(\.info)?\.[A-Za-z0-9]+$", "")


def json_documents(spark: SparkSession, path: str, schema: str, ignore: Sequence[str] = REPORTS, numeric_names: bool = False) -> DataFrame:
    """One row per JSON file (an object, or a list of objects) with file and, for files that cannot be read, unreadable.

    Report files are left out; numeric_names keeps only files named by a number. A folder without files gives no rows.
    """
    s = T.StructType.fromDDL(schema).add("unreadable", "string")
    df = spark.read.schema(s).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "unreadable").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    df = df.withColumn("file", F.col("_metadata.file_path"))
    df = df.where(~stem(F.col("file")).isin(list(ignore)))
    return df.where(stem(F.col("file")).rlike(r"^\d+$")) if numeric_names else df


def readable(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents, and the file names of those that could not be read."""
    return df.where("unreadable is null").drop("unreadable"), df.where("unreadable is not null").select("file")


def first_text(*columns: str) -> Column:
    """The first that is not blank, trimmed; none: empty."""
    return F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns], F.lit(""))


def raw_posts(df: DataFrame) -> DataFrame:
    """id, url, caption, normalized_caption, day of raw post documents; posts without caption words are left out."""
    out = df.select(
        F.coalesce("id", stem(F.col("file"))).alias("id"), F.coalesce(F.nullif("webpage_url", F.lit("")), "original_url").alias("url"),
        first_text("description", "caption", "title").alias("caption"), to_day(F.trim("upload_date"), F.trim("published_at"), F.col("timestamp")).alias("day"),
    )
    return out.withColumn("normalized_caption", normalize("caption", "caption")).where("normalized_caption <> ''")


def match_list(df: DataFrame) -> DataFrame:
    """The matches of match files, one row each, with the file they came from."""
    return df.select("file", F.posexplode("matches").alias("position", "m")).select("file", "position", "m.*")


def review_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A CSV with a header, all text, a byte order mark allowed; columns that are not there are null, others are dropped."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = {c.lstrip("\ufeff"): c for c in df.columns}
    return df.select(*[(F.col(f"`{names[c]}`") if c in names else F.lit(None).cast("string")).alias(c) for c in columns])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def canonical_map(csv: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(old_id, target_id) pairs of a map with `;` lists of old ids, and the faults: an id in two groups, a target that is
    also an old id of another, a target twice."""
    rows = csv.select(F.expr("try_cast(canonical_sql_id as long)").alias("target_id"), F.col("orjinal_sql_ids").alias("olds"))
    pairs = rows.select("target_id", F.explode(F.split("olds", r"\s*;\s*")).alias("o")).select(F.expr("try_cast(o as long)").alias("old_id"), "target_id").where("old_id is not null and target_id is not null").distinct()
    twice = pairs.groupBy("old_id").agg(F.countDistinct("target_id").alias("n")).where("n > 1").select(F.lit("old id in two groups").alias("fault"), F.col("old_id").alias("id"))
    crossed = pairs.select(F.col("target_id").alias("id")).distinct().join(pairs.where("old_id <> target_id").select(F.col("old_id").alias("id")), "id", "left_semi").select(F.lit("target is moved itself").alias("fault"), "id")
    repeated = rows.groupBy("target_id").count().where("count > 1 and target_id is not null").select(F.lit("target listed twice").alias("fault"), F.col("target_id").alias("id"))
    return pairs, twice.unionByName(crossed).unionByName(repeated)


def transcripts(spark: SparkSession, path: str, least: int = 100) -> DataFrame:
    """video_id (from the file's name) and text; texts of fewer than least characters are left out."""
    df = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path).withColumn("file", F.col("_metadata.file_path"))
    ident = F.regexp_extract(stem(F.col("file")), r"([A-Za-z0-9_-]{11})$", 1)
    return df.select(ident.alias("video_id"), F.trim("value").alias("text"), "file").where(F.length("text") >= least)


def newest(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key the document of the newest file (needs the file's modification time as modified)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("modified", "file")).alias("x")).select(*keys, *[F.col(f"x.{c}").alias(c) for c in rest])


def post_links(df: DataFrame, column: str, hosts: Sequence[str], account: str | None = None) -> DataFrame:
    """Discovered links as canonical post links, each once: file, shortcode, kind, url. Links of other hosts, of other
    accounts and that are no posts are left out. column: text, or a list of texts."""
    one = df.select("file", F.explode(column).alias("raw")) if dict(df.dtypes)[column].startswith("array") else df.select("file", F.col(column).alias("raw"))
    host = F.call_function("try_parse_url", F.trim("raw"), F.lit("HOST"))
    path = F.call_function("try_parse_url", F.trim("raw"), F.lit("PATH"))
    pattern = r"^/(?:([A-Za-z0-9_.]+)/)?(reel|p)/([A-Za-z0-9_-]+)/?$"
    out = one.where(host.isin(list(hosts)) & path.rlike(pattern)).select("file", host.alias("host"), *[F.regexp_extract(path, pattern, i).alias(n) for i, n in ((1, "account"), (2, "kind"), (3, "shortcode"))])
    if account:
        out = out.where((F.col("account") == "") | (F.lower("account") == account.lower()))
    return out.groupBy("shortcode").agg(F.min_by(F.struct("file", "kind", "host"), F.col("file")).alias("x")).select("x.file", "shortcode", "x.kind", F.concat(F.lit("https://"), F.col("x.host"), F.lit("/"), F.col("x.kind"), F.lit("/"), F.col("shortcode")).alias("url"))


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, sorted; none where there is none."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory()) if fs.exists(p) else []


def source_folders(spark: SparkSession, root: str, creator: str, asked: Sequence[str] = (), split: Sequence[str] = (), default: str = "") -> list[str]:
    """The folders a creator's documents are in: those asked for; else the split ones; else the default one. Only what is there, each once, and
    never split and default ones together (the default then holds an older run)."""
    there = set(_folders(spark, f"{root}/{creator}"))
    for choice in ([*asked],) if asked else ([*split], [default]):
        if found := [f"{root}/{creator}/{x}" for x in dict.fromkeys(choice) if x in there]:
            return found
    return []


def creators_with_sources(spark: SparkSession, root: str, asked: Sequence[str] = (), **choice) -> list[str]:
    """The creators asked for, else all with a source folder, sorted."""
    return list(dict.fromkeys(asked)) or [c for c in _folders(spark, root) if source_folders(spark, root, c, **choice)]


def wanted(documents: DataFrame, key: str, allowed: DataFrame | None = None, only: str | None = None, limit: int | None = None) -> DataFrame:
    """Documents of a list of keys, of one key, the first by key and file if only so many are asked for. A null key is on no list."""
    out = documents if only is None else documents.where(F.col(key) == only)
    out = out if allowed is None else out.join(allowed.select(key).distinct(), key, "left_semi")
    return out if limit is None else out.orderBy(key, "file").limit(limit)
