"""The page table of the test data: raw pages, with the columns that they lack derived from their number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from .stored import spread

#: The same, as a DuckDB view ``p``.
SQL = r"""p AS (
  SELECT page_id, concat('p', lpad(page_id::VARCHAR, 12, '0')) AS id, u AS url, title, h1,
    regexp_extract(u, '^[a-z]+://([^/?#]*)', 1) AS netloc,
    regexp_replace(regexp_extract(u, '^[a-z]+://([^/?#:]*)', 1), '^www\.', '') AS host,
    CASE WHEN pth = '' THEN '/' ELSE pth END AS path, regexp_extract(u, '\?([^#]*)', 1) AS query,
    regexp_extract(pth, '^/([a-z]{2})/', 1) AS language,
    CASE WHEN page_id % 19 = 0 THEN NULL WHEN page_id % 17 = 0 THEN 404 WHEN page_id % 23 = 0 THEN 503 WHEN page_id % 29 = 0 THEN 301 ELSE 200 END AS http_status,
    page_id % 13 = 0 AS has_noindex, page_id % 31 <> 0 AS is_indexable,
    CASE page_id % 5 WHEN 0 THEN 'us' WHEN 1 THEN 'gb' ELSE NULL END AS region,
    CASE WHEN page_id % 11 = 0 THEN 'legal' ELSE 'article' END AS page_type, html
  FROM (SELECT *, regexp_replace(url, '#.*$', '') AS u, regexp_extract(regexp_replace(url, '#.*$', ''), '^[a-z]+://[^/?#]*([^?#]*)', 1) AS pth,
      trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) AS h1 FROM pages)
), k AS (
  SELECT *, concat(regexp_replace(netloc, '^www\.', ''), CASE WHEN regexp_replace(path, '/+$', '') = '' THEN '/' ELSE regexp_replace(path, '/+$', '') END,
    CASE WHEN query = '' THEN '' ELSE '?' || query END) AS key
  FROM p
)"""


def inventory(spark: SparkSession, sf_dir: str, with_html: bool = False) -> DataFrame:
    """Pages with an id, parts of the URL, title and h1, and derived status, flags, region and type."""
    raw = spark.read.parquet(f"{sf_dir}/pages.parquet")
    raw = spread(raw) if with_html else raw  # copy is dear to read
    n, url = F.col("page_id"), F.regexp_replace("url", "#.*$", "")
    pick = lambda tag: F.trim(F.regexp_extract("html", f"<{tag}>([^<]*)</{tag}>", 1))
    base = raw.select("page_id", url.alias("url"), pick("title").alias("title"), pick("h1").alias("h1"), *["html"] * with_html)
    u = F.col("url")
    status = F.when(n % 19 == 0, None).when(n % 17 == 0, 404).when(n % 23 == 0, 503).when(n % 29 == 0, 301).otherwise(200)
    return base.select(
        "page_id", F.concat(F.lit("p"), F.lpad(n.cast("string"), 12, "0")).alias("id"), "url", "title", "h1", U.netloc(u).alias("netloc"), U.bare_host(u).alias("host"), U.path(u).alias("path"), U.query(u).alias("query"),
        F.regexp_extract(U.path(u), "^/([a-z]{2})/", 1).alias("language"), status.alias("http_status"), (n % 13 == 0).alias("has_noindex"), (n % 31 != 0).alias("is_indexable"),
        F.when(n % 5 == 0, "us").when(n % 5 == 1, "gb").alias("region"), F.when(n % 11 == 0, "legal").otherwise("article").alias("page_type"), U.url_key(u).alias("key"), *["html"] * with_html,
    )


def page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory in the columns of the page table; a site is a host."""
    p = inventory(spark, sf_dir, with_html=True)
    empty = F.array().cast("array<string>")
    none = F.lit(None).cast("string")
    return p.select(
        "id", F.col("host").alias("site_id"), "url", "title", "h1", none.alias("meta_description"), F.col("html").alias("content_html"), F.lit(1).alias("content_version"), none.alias("canonical_url"), "http_status",
        F.when(F.col("http_status") == 301, F.lit("/")).alias("redirect_url"), "is_indexable", "has_noindex", "language", "region", "page_type", empty.alias("keywords"), empty.alias("outgoing_links"),
        F.lit(None).cast("timestamp").alias("last_crawled_at"), F.lit("2026-01-01").cast("timestamp").alias("created_at"), F.lit("2026-01-01").cast("timestamp").alias("updated_at"),
    )
