"""Small operators, each on rows where its cases occur."""

from datetime import datetime

from pyspark.sql import functions as F

from weftlink.config import Settings
from weftlink.functions.urls import scope_hosts
from weftlink.operators import relational as R
from weftlink.operators.exclusion import exclusion_reason, page_features
from weftlink.operators.scoring import SIGNAL_WEIGHTS, top_signals
from weftlink.schemas import PAGES, orphans
from weftlink.sources.bronze import read_page_items, should_retry, within_size


def test_scope_of_a_site():
    assert scope_hosts("https://www.E.com/x") == ("www.e.com",)
    assert scope_hosts("https://e.com", True, ("Shop.e.com",)) == ("e.com", "shop.e.com", "www.e.com")


def test_a_url_that_does_not_normalise_is_unlinkable(spark):
    row = dict.fromkeys(PAGES.names) | {"site_id": "s", "title": "t", "http_status": 200, "is_indexable": True, "has_noindex": False}
    pages = spark.createDataFrame([tuple((row | x)[n] for n in PAGES.names) for x in ({"id": "a", "url": "https://e.com/a"}, {"id": "b", "url": "mailto:b@e.com"})], PAGES)
    f = page_features(pages, Settings())
    pair = f.where("id = 'a'").select(F.struct(*f.columns).alias("s")).crossJoin(f.where("id = 'b'").select(F.struct(*f.columns).alias("t")))
    assert pair.select(exclusion_reason("s", "t")).first()[0] == "UNLINKABLE_URL"


def test_retries_and_sizes(spark):
    rows = spark.createDataFrame([(None, 1), (503, 1), (503, 4), (404, 1), (200, 1)], "status int, attempt int")
    assert [r[0] for r in rows.select(should_retry(F.col("status"), F.col("attempt"), 3)).collect()] == [True, True, False, False, False]
    bodies = spark.createDataFrame([(bytearray(b"abc"),), (bytearray(b"abcd"),)], "body binary")
    assert [r[0] for r in bodies.select(within_size(F.col("body"), 3)).collect()] == [True, False]


def test_items_of_lines(spark, tmp_path):
    (tmp_path / "items.json").write_text('{"id": "a", "url": "https://e.com/"}\n{"id": \n')
    good, bad = read_page_items(spark, str(tmp_path / "items.json"))
    assert [r["id"] for r in good.collect()] == ["a"] and bad.count() == 1


def test_sites_orphans_and_top_signals(spark):
    sites = spark.createDataFrame([("b", datetime(2026, 1, 2)), ("a", datetime(2026, 1, 3)), ("c", datetime(2026, 1, 1))], "id string, created_at timestamp")
    assert [r["id"] for r in R.list_sites(sites).collect()] == ["c", "b", "a"]
    pages = spark.createDataFrame([("p", "a", "x"), ("q", "gone", "y")], "id string, site_id string, content_html string")
    assert [r["id"] for r in orphans(pages, sites, "site_id").collect()] == ["q"]
    assert R.without_content(pages).columns == ["id", "site_id"]
    values = dict.fromkeys(SIGNAL_WEIGHTS, 0.0) | {"h1_overlap": 0.5, "content_title": 0.9, "phrase_overlap": 0.5, "title_overlap": 0.1, "quality": 1.0}
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} double" for k in values))
    assert [tuple(x) for x in row.select(top_signals()).first()[0]] == [("content_title", 0.9), ("h1_overlap", 0.5), ("phrase_overlap", 0.5)]
