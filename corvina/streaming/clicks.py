"""Event streams: windowed counts, validated appends, and running what is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.functions.dates import utc_stamp


def stream_of(spark: SparkSession, folder: str, name: str, schema: str, files_a_batch: int = 1000) -> DataFrame:
    """A table's Parquet files in a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def windowed_counts(events: DataFrame, time: str, keys: list[str], value: str, width: str, late: str) -> DataFrame:
    """Events and their value per tumbling window and key; events later than late are dropped."""
    g = events.withWatermark(time, late).groupBy(F.window(time, width), *keys)
    return g.agg(F.count("*").alias("events"), F.sum(value).alias("total")).select(F.col("window.start").alias("window_start"), *keys, "events", "total")


def valid_clicks(raw: DataFrame, products: DataFrame, links: DataFrame) -> DataFrame:
    """Clicks that count, with the link they lead to and their time in UTC: an outbound click of a known product that has a
    verified link of the merchant. The destination is looked up here, whatever the client says; of several links the most
    confident one, then the least id, counts. raw: event_name, product_id, influencer_slug, merchant, timestamp (text)."""
    best = links.groupBy("product_id", F.lower("merchant_slug").alias("merchant")).agg(F.max_by("url", F.struct(F.coalesce("confidence", F.lit(0.0)), -F.col("id"))).alias("destination_url"))
    r = raw.where("event_name = 'outbound_click'").select(F.expr("try_cast(product_id as long)").alias("product_id"), F.trim("influencer_slug").alias("influencer_slug"), F.lower(F.trim("merchant")).alias("merchant"), F.col("timestamp"))
    r = r.where("product_id is not null and influencer_slug <> '' and merchant <> ''")
    ok = r.join(products.select(F.col("id").alias("product_id")).distinct(), "product_id", "left_semi").join(best, ["product_id", "merchant"])
    return ok.withColumn("clicked_at", utc_stamp(F.col("timestamp"), F.current_timestamp())).drop("timestamp")


def append_batches(stream: DataFrame, path: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] = lambda df: df):
    """Appends the changed batches to Parquet, each exactly once: a batch is written to a folder of its own number, so one
    that is run again after a failure replaces itself. Runs what is there and stops."""

    def write(batch: DataFrame, number: int) -> None:
        change(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def run_complete(counts: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """The full result of an aggregated stream over what is there."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/v={number}")

    q = counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    last = q.lastProgress["batchId"]
    return counts.sparkSession.read.parquet(f"{path}/v={last}")
