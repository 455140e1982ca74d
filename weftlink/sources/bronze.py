"""Fetched responses as a table: kinds, decoding and classification of a crawl level."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import FETCHES, PAGES
from ..functions.vectorised import vectorised

#: Statuses after which a fetch is tried again.
RETRIED = (429, 500, 502, 503, 504)


def read_tables(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def read_fetches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FETCHES).parquet(path)


def read_page_items(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Page upserts from JSON lines: well-formed ones, and the text of the others."""
    kept = T.StructType([*PAGES.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(kept).option("columnNameOfCorruptRecord", "_corrupt_record").json(path).cache()
    return rows.where("_corrupt_record is null").drop("_corrupt_record"), rows.where("_corrupt_record is not null").select("_corrupt_record")


def header(name: str) -> Column:
    """A response header by its lower-case name."""
    found = F.filter(F.map_entries("headers"), lambda e: F.lower(e["key"]) == name)
    return F.try_element_at(found, F.lit(1))["value"]


def media_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.split(content_type, ";")[0]))


def is_html(content_type: Column) -> Column:
    return media_type(content_type).isin("text/html", "application/xhtml+xml")


@vectorised("string")
def decode_body(body: pd.Series, content_type: pd.Series) -> pd.Series:
    """Text in the charset that the type names, else UTF-8; what can't be decoded is replaced."""
    def one(data: bytes | None, kind: str | None) -> str | None:
        if data is None:
            return None
        named = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", kind or "", re.I)
        try:
            return bytes(data).decode(named[1] if named else "utf-8", "replace")
        except LookupError:
            return bytes(data).decode("utf-8", "replace")

    return pd.Series([one(b, k) for b, k in zip(body, content_type, strict=True)], dtype=object)


def retry_delay(attempt: Column, retry_after: Column, most: float) -> Column:
    """Seconds before the next try: what the server asks in whole seconds, else doubling, at most ``most``."""
    asked = F.when(F.trim(retry_after).rlike(r"^\d+$"), F.trim(retry_after).cast("double"))
    return F.least(F.coalesce(asked, F.pow(F.lit(2.0), attempt - 1)), F.lit(most))


def should_retry(status: Column, attempt: Column, most: int) -> Column:
    return (status.isNull() | status.isin(*RETRIED)) & (attempt <= most)


def within_size(body: Column, most: int) -> Column:
    return F.octet_length(body) <= most
