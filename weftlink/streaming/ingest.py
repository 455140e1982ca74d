"""Fetched responses as a stream: each micro-batch is extracted and upserted into a page snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.urls import url_key
from ..operators.crawling import extracted, page_items
from ..operators.relational import upsert_pages
from ..schemas import FETCHES, PAGES


def fetch_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Responses as they come, with ``arrived``: when their file was written, which one it is, and the row in it."""
    at = F.struct(F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return spark.readStream.schema(FETCHES).parquet(folder).select("*", at.alias("arrived"))


def latest(batch: DataFrame) -> DataFrame:
    """Of several responses of one URL the last that arrived."""
    whole = F.struct(*[F.col(f.name) for f in FETCHES])
    return batch.groupBy(F.coalesce(url_key(F.col("url")), F.col("url")).alias("_key")).agg(F.max_by(whole, "arrived").alias("_f")).select("_f.*")


def upsert_stream(fetches: DataFrame, sites: DataFrame, site_id: str, hosts: tuple[str, ...], snapshots: str, checkpoint: str) -> StreamingQuery:
    """Writes snapshot ``snapshots/<batch>`` for every micro-batch; a batch that is run again writes the same one: times are those of
    its files, and of two responses of a URL the last that arrived holds."""
    spark = fetches.sparkSession

    def one(batch: DataFrame, number: int) -> None:
        before = spark.read.schema(PAGES).parquet(f"{snapshots}/{number - 1}") if number else spark.createDataFrame([], PAGES)
        existing = before.select(url_key(F.col("url")).alias("key"), F.col("url").alias("stored_url"))
        as_of = F.lit(batch.agg(F.max("arrived.time")).first()[0])
        items = page_items(extracted(latest(batch)), hosts, existing).drop("known", "is_empty", "redirect_problem", "content_hash", "key")
        items = items.withColumn("site_id", F.lit(site_id)).withColumn("id", F.sha2("url", 256)).withColumn("region", F.lit(None).cast("string")).withColumn("position", F.lit(0))
        upsert_pages(before, items, sites, as_of).write.mode("overwrite").parquet(f"{snapshots}/{number}")

    return fetches.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
