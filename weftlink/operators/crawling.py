"""A crawl over fetched responses: admission, levels of breadth-first search, classification, saving and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.extract import extract_page
from ..sources.bronze import decode_body, header, is_html
from ..sources.robots import allowed_urls
from .relational import resolve_urls

MAX_ERRORS = 200


def admission(url: Column, hosts: tuple[str, ...]) -> Column:
    """Why a discovered URL is silently dropped, or null."""
    return (
        F.when(url.isNull(), "UNPARSABLE")
        .when(~U.in_scope(url, hosts), "OUT_OF_SCOPE")
        .when(U.is_asset(url), "ASSET")
        .when(U.looks_like_trap(url), "TRAP")
    )


def frontier(found: DataFrame, seen: DataFrame, hosts: tuple[str, ...], room: int) -> DataFrame:
    """``key, url`` of admitted URLs not yet seen, the first of a key in order of ``position``; ``room`` of them at most,
    which is the crawl's limit on pages."""
    kept = found.where(admission(F.col("url"), hosts).isNull()).withColumn("key", U.url_key(F.col("url")))
    first = kept.join(seen.select("key"), "key", "left_anti").groupBy("key").agg(F.min(F.struct("position", "url")).alias("x"))
    return first.select("key", F.col("x.url").alias("url"), F.col("x.position").alias("position")).orderBy("position", "url").limit(room)


def followable(redirects: DataFrame, hosts: tuple[str, ...], rules: DataFrame) -> DataFrame:
    """``redirects`` (url, where one leads) with ``may_follow``: it normalises, is in scope, is no asset and robots.txt allows it.

    ``rules``: host, allow, pattern, as for ``allowed_urls``.
    """
    to = redirects.withColumn("_to", U.crawl_url(F.col("url"), F.lit(None).cast("string")))
    asked = to.withColumn("host", U.bare_host(F.col("_to"))).withColumn("target", U.site_relative(F.col("_to")))
    verdict = F.col("_to").isNotNull() & U.in_scope(F.col("_to"), hosts) & ~U.is_asset(F.col("_to")) & F.col("allowed")
    return allowed_urls(asked, rules).select(*redirects.columns, F.coalesce(verdict, F.lit(False)).alias("may_follow"))


def extracted(fetches: DataFrame) -> DataFrame:
    """``fetches`` with ``kind`` and, for HTML that is live, the ``page`` record; one pass of the parser a page."""
    kind = header("content-type")
    live = F.col("status").between(200, 299)
    outcome = (
        F.when(F.col("blocked_redirect").isNotNull(), "REDIRECT_BLOCKED")
        .when(F.col("status").isNull(), "UNREACHABLE")
        .when(live & ~is_html(kind), "NOT_HTML")
        .when(live, "PAGE")
        .when(F.col("status").between(400, 599), "HTTP_ERROR")
        .otherwise("OTHER")
    )
    page = F.when(outcome == "PAGE", extract_page(decode_body(F.when(outcome == "PAGE", F.col("body")), kind), F.col("url"), header("x-robots-tag")))
    return fetches.withColumn("kind", outcome).withColumn("page", page)


def hop_rows(fetches: DataFrame) -> DataFrame:
    """A status-only row for each redirect on the way."""
    hop = F.explode("hops").alias("hop")
    return fetches.select(hop).select("hop.url", F.col("hop.status").alias("http_status"), U.crawl_url(F.col("hop.location"), F.col("hop.url")).alias("redirect_url")).distinct()


def html_redirect(pages: DataFrame, hosts: tuple[str, ...]) -> DataFrame:
    """``pages`` (url, page) with ``redirect_to`` and ``redirect_problem`` of a redirect inside the HTML."""
    raw = F.col("page.redirect.target")
    target = U.crawl_url(raw, F.col("url"))
    unsafe = F.lower(F.trim(raw)).rlike("^(javascript|data|vbscript|file|blob|about):")
    problem = (
        F.when(raw.isNull(), None)
        .when(unsafe, "UNSAFE_SCHEME")
        .when(target.isNull(), "INVALID_TARGET")
        .when(U.url_key(target) == U.url_key(F.col("url")), "SELF_REDIRECT")
        .when(~U.in_scope(target, hosts), "OFF_SITE")
        .when(U.url_fetch_problem(target).isNotNull(), "TARGET_BLOCKED")
    )
    return pages.withColumn("redirect_problem", problem).withColumn("redirect_to", F.when(raw.isNotNull() & problem.isNull(), target))


def page_items(fetched: DataFrame, hosts: tuple[str, ...], existing: DataFrame) -> DataFrame:
    """Upsert rows of live pages: stored spelling of known URLs, links in it too, none to itself or to assets.

    ``fetched``: as ``extracted``; ``existing``: key, stored_url.
    """
    pages = html_redirect(fetched.where("kind = 'PAGE'"), hosts).withColumn("key", U.url_key(F.col("url")))
    links = pages.select("key", F.posexplode("page.content_links").alias("at", "link")).withColumn("link_key", U.url_key(F.col("link")))
    links = links.where((F.col("link_key") != F.col("key")) & ~U.is_asset(F.col("link")))
    first = links.groupBy("key", "link_key").agg(F.min(F.struct("at", "link")).alias("x"))
    spelled = first.join(existing.select(F.col("key").alias("link_key"), "stored_url"), "link_key", "left")
    kept = spelled.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col("x.at"), F.coalesce("stored_url", "x.link").alias("url")))), lambda x: x["url"]).alias("outgoing_links"))
    known = existing.select("key", "stored_url")
    out = pages.join(known, "key", "left").join(kept, "key", "left")
    directed = F.col("redirect_to").isNotNull()
    return out.select(
        "key", F.coalesce("stored_url", "url").alias("url"), F.col("stored_url").isNotNull().alias("known"), F.col("status").alias("http_status"), F.col("redirect_to").alias("redirect_url"),
        (~directed & ~F.col("page.noindex") & ~F.col("page.is_empty")).alias("is_indexable"), F.col("page.noindex").alias("has_noindex"), "page.title", "page.h1", "page.meta_description", "page.canonical_url",
        "page.language", "page.keywords", "page.content_html", "page.content_hash", F.coalesce("outgoing_links", F.array().cast("array<string>")).alias("outgoing_links"), F.col("page.is_empty").alias("is_empty"), "redirect_problem",
    )


def failed_updates(fetched: DataFrame, existing: DataFrame) -> DataFrame:
    """Status-only updates of known pages that answered 4xx or 5xx: never inserts, and clears the redirect."""
    bad = fetched.where("kind = 'HTTP_ERROR'").select(U.url_key(F.col("url")).alias("key"), F.col("status").alias("http_status"))
    return bad.join(existing, "key").select(F.col("stored_url").alias("url"), "http_status", F.lit(None).cast("string").alias("redirect_url"))


#: Fixed value: stored redirects that are followed.
MAX_STORED_REDIRECTS = 5

_CHAINS = """
WITH RECURSIVE chain (request, page_id, hops, seen, looped) AS (
  SELECT request, page_id, 0, array(page_id), false FROM {begins}
  UNION ALL
  SELECT c.request, e.next, c.hops + 1, concat(c.seen, array(e.next)), c.looped OR array_contains(c.seen, e.next) FROM chain c JOIN {edges} e ON e.page_id = c.page_id WHERE c.hops < {most}
)
SELECT request, max(hops) AS hops, max_by(page_id, hops) AS page_id, max(looped) AS looped FROM chain GROUP BY request
"""


def redirect_chains(begins: DataFrame, edges: DataFrame, most: int = MAX_STORED_REDIRECTS) -> DataFrame:
    """``request, hops, page_id, looped``: where the redirects (page_id, next) from the pages of ``begins`` (request, page_id) lead, after ``most`` hops at the latest."""
    return begins.sparkSession.sql(_CHAINS, begins=begins.select("request", "page_id"), edges=edges.select("page_id", "next"), most=most)


def discover_pages(requests: DataFrame, pages: DataFrame, fetched: DataFrame) -> DataFrame:
    """``request, page_id, hops, looped, error, http_status``: the page that a URL ends up on, or why there is none.

    ``requests``: request; ``pages``: the page table after the fetch; ``fetched``: request, kind, status of fetching it (kinds of ``extracted``, and
    ROBOTS_DISALLOWED). A request that no page stands for fails by how its fetch ended; one whose redirects leave the stored pages is
    PAGE_REDIRECTED, and one that ends on a page without success PAGE_HTTP_ERROR.
    """
    resolved = resolve_urls(requests.select("request").distinct(), pages).select("request", "page_id")
    onward = pages.where("redirect_url <> ''").select("id", F.col("redirect_url").alias("request"))
    found = resolve_urls(onward.select("request").distinct(), pages).select("request", F.col("page_id").alias("next"))
    edges = onward.join(found, "request").where("next is not null").select(F.col("id").alias("page_id"), "next")
    ends = redirect_chains(resolved.where("page_id is not null"), edges)
    last = pages.select(F.col("id").alias("page_id"), "http_status", (F.coalesce("redirect_url", F.lit("")) != "").alias("leads_on"))
    ends = ends.join(last, "page_id").join(edges.select("page_id", F.lit(True).alias("known")), "page_id", "left")
    lost = F.col("leads_on") & F.col("known").isNull() & (F.col("hops") < MAX_STORED_REDIRECTS)
    bad = ~F.col("http_status").between(200, 299)
    ends = ends.select("request", "page_id", "hops", "looped", F.when(lost, "PAGE_REDIRECTED").when(bad, "PAGE_HTTP_ERROR").alias("error"), F.when(~lost & bad, F.col("http_status")).alias("http_status"))
    kind = F.col("kind")
    why = (
        F.when(kind == "ROBOTS_DISALLOWED", "PAGE_BLOCKED_BY_ROBOTS").when(kind == "NOT_HTML", "PAGE_NOT_HTML").when(kind == "HTTP_ERROR", "PAGE_HTTP_ERROR")
        .when(kind == "REDIRECT_BLOCKED", "PAGE_URL_BLOCKED").when(kind == "UNREACHABLE", "PAGE_FETCH_FAILED").otherwise("PAGE_NOT_STORED")
    )
    none = resolved.where("page_id is null").join(fetched.select("request", "kind", "status"), "request", "left")
    none = none.select("request", "page_id", F.lit(0).alias("hops"), F.lit(False).alias("looped"), why.alias("error"), F.when(kind == "HTTP_ERROR", F.col("status")).alias("http_status"))
    return ends.unionByName(none).withColumn("page_id", F.when(F.col("error").isNull(), F.col("page_id")))


def report(fetched: DataFrame, items: DataFrame, discovered: int) -> DataFrame:
    """One row: counts by outcome, and the first 200 errors with whether there are more."""
    error = F.when(F.col("kind").isin("HTTP_ERROR", "UNREACHABLE", "REDIRECT_BLOCKED"), F.struct("url", F.col("kind").alias("code"), F.col("status").alias("status")))
    failed = fetched.select(error.alias("e")).where("e is not null")
    rank = failed.orderBy("e.url").limit(MAX_ERRORS).agg(F.sort_array(F.collect_list("e")).alias("errors"))
    one = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    counts = fetched.agg(F.count("*").alias("pages_fetched"), one("NOT_HTML").alias("skipped_non_html"), one("HTTP_ERROR").alias("http_errors"), one("UNREACHABLE").alias("unreachable"), one("REDIRECT_BLOCKED").alias("redirects_blocked"))
    saved = items.agg(F.count(F.when(F.col("known"), 1)).alias("pages_updated"), F.count(F.when(~F.col("known"), 1)).alias("pages_created"), F.count(F.when(F.col("is_empty"), 1)).alias("empty_pages"))
    more = failed.agg((F.count("*") > MAX_ERRORS).alias("errors_truncated"))
    return counts.crossJoin(saved).crossJoin(rank).crossJoin(more).withColumn("pages_discovered", F.lit(discovered))  # one row each


def crawl(bronze: DataFrame, start: list[str], hosts: tuple[str, ...], existing: DataFrame, max_pages: int = 1000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Responses reached, upsert rows, and the report of a crawl from ``start`` over fetched responses.

    A level of the search is one job; the driver holds counts alone. ``bronze`` is keyed by ``url`` in its crawl form.
    """
    spark = bronze.sparkSession
    found = spark.createDataFrame([(u, i) for i, u in enumerate(start)], "url string, position int").select(U.crawl_url(F.col("url"), F.lit(None).cast("string")).alias("url"), "position")
    seen = spark.createDataFrame([], "key string")
    reached, used = None, 0
    responses = bronze.withColumn("key", U.url_key(F.col("url")))
    while used < max_pages:
        level = frontier(found, seen, hosts, max_pages - used).checkpoint()
        n = level.count()
        if not n:
            break
        used += n
        seen = seen.unionByName(level.select("key"))
        got = extracted(responses.join(level.select("key", "position"), "key")).checkpoint()
        reached = got if reached is None else reached.unionByName(got)
        follow = F.concat("page.links", F.array_compact(F.array("page.canonical_url", U.crawl_url(F.col("page.redirect.target"), F.col("url")))))
        rank = F.expr("cast(row_number() over (order by position, at) as int)")  # of one level's links, bounded by max_pages pages
        links = got.where("kind = 'PAGE'").select("position", F.posexplode(follow).alias("at", "url"))
        found = links.select("url", rank.alias("position"))
    if reached is None:
        reached = extracted(responses.join(spark.createDataFrame([], "key string, position int"), "key"))
    items = page_items(reached, hosts, existing)
    return reached, items, report(reached, items, used)
