import json
import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from weftlink.config import Settings, SettingsError, load_settings
from weftlink.operators import ai_items as A
from weftlink.operators import crawling as K
from weftlink.operators import relational as R
from weftlink.operators import retrieval as V
from weftlink.operators import scoring as C
from weftlink.operators.exclusion import REASONS, candidate_pairs, page_features, reason_counts
from weftlink.plans.analyze import analyze, apply_approved, parsed
from weftlink.schemas import FETCHES, PAGES, SUGGESTIONS, page_problems, suggestion_problems

NOW = datetime(2026, 3, 1)


def page(id_, **given):
    base = dict.fromkeys(PAGES.names)
    base |= {"id": id_, "site_id": "s", "url": f"https://e.com/{id_}/", "title": f"About {id_}", "http_status": 200, "is_indexable": True, "has_noindex": False, "language": "en", "keywords": [], "outgoing_links": [], "content_version": 1, "created_at": NOW, "updated_at": NOW}
    return tuple((base | given)[n] for n in PAGES.names)


BODY = "<nav><a href='/linked/'>L</a></nav><h1>Voice</h1><p>We build voice agents for clinics and banks every single day. Chatbot development is another thing that our customers ask for.</p><p>Our appointment booking assistant saves time for busy teams everywhere. See <a href='/linked/'>this</a> page.</p>"


@pytest.fixture(scope="module")
def site(spark):
    rows = [
        page("source", content_html=BODY, title="Voice agents overview", h1="Voice", region="us"),
        page("agents", title="Voice Agents for Clinics", h1="Voice agents"),
        page("chatbot", title="Chatbot Development", h1="Chatbot development"),
        page("booking", title="Appointment Booking Assistant"),
        page("unrelated", title="Quarterly Fish Prices"),
        page("linked"),
        page("gone", http_status=404),
        page("broken", http_status=503),
        page("moved", http_status=301, redirect_url="/x"),
        page("unknown", http_status=None),
        page("hidden", has_noindex=True),
        page("unindexed", is_indexable=False),
        page("canon", canonical_url="/other"),
        page("spanish", language="es-MX"),
        page("british", region="gb"),
        page("privacy", url="https://e.com/privacy/"),
        page("twin", url="https://e.com/us/source", region="US"),
        page("file", url="https://e.com/report.docx"),
        page("track", url="https://e.com/t?utm_source=x"),
        page("blank", title=" ", h1=None),
        page("dup", url="http://www.e.com/agents"),
        page("elsewhere", url="https://other.com/x"),
        page("legal", page_type="Legal"),
    ]
    return parsed(spark.createDataFrame(rows, PAGES)).cache()


def test_every_exclusion(spark, site):
    linked = spark.createDataFrame([("source", "e.com/linked")], "source_page_id string, link_key string")
    pair = lambda t: spark.createDataFrame([("source", t)], "source_page_id string, target_page_id string")
    out = candidate_pairs(page_features(site, Settings()), linked, Settings(), pair("chatbot"), pair("booking"), same_host_only=False).where("source_page_id = 'source'")
    got = {r["target_page_id"]: r["reason"] for r in out.collect()}
    want = {
        "source": "SOURCE_PAGE", "agents": "DUPLICATE_URL", "dup": None, "chatbot": "ACTIVE_SUGGESTION_EXISTS", "booking": "RECENTLY_REJECTED", "unrelated": None, "linked": "ALREADY_LINKED", "gone": "HTTP_404", "broken": "HTTP_5XX", "moved": "REDIRECTED",
        "unknown": "NON_200_STATUS", "hidden": "NOINDEX", "unindexed": "NOT_INDEXABLE", "canon": "CANONICAL_POINTS_ELSEWHERE", "spanish": "LANGUAGE_MISMATCH", "british": "REGION_MISMATCH", "privacy": "UTILITY_PAGE", "legal": "UTILITY_PAGE",
        "twin": "ALTERNATE_VERSION", "file": "ASSET_URL", "track": "TRACKING_URL", "blank": "EMPTY_CONTENT", "elsewhere": "DIFFERENT_SITE",
    }
    assert got == want and set(filter(None, want.values())) <= set(REASONS)
    counts = reason_counts(out).first()["excluded_counts"]
    assert counts["UTILITY_PAGE"] == 2 and sum(counts.values()) == len([x for x in want.values() if x])


def test_analysis(spark, site):
    found = analyze(site, spark.createDataFrame([], SUGGESTIONS), F.lit(NOW), sources=spark.createDataFrame([("source",)], "id string"))
    rows = {r["target_page_id"]: r for r in found["suggestions"].collect()}
    stored = {k: r for k, r in rows.items() if r["skipped"] is None}
    assert {"chatbot", "booking"} <= set(stored)
    assert stored["chatbot"]["anchor"] == "Chatbot development" and "another thing" in stored["chatbot"]["context"]
    assert len({r["context"] for r in stored.values()}) == len(stored)
    assert "unrelated" not in stored


def test_apply(spark, site):
    row = dict.fromkeys(SUGGESTIONS.names) | {"site_id": "s", "source_page_id": "source", "relevance_score": 60, "created_at": NOW, "updated_at": NOW}
    rows = [
        row | {"id": "1", "target_page_id": "chatbot", "anchor_text": "Chatbot development", "context": "Chatbot development is another thing that our customers ask for.", "status": "APPROVED"},
        row | {"id": "2", "target_page_id": "booking", "anchor_text": "booking", "context": "x", "status": "PENDING"},
    ]
    s = spark.createDataFrame([tuple(r[n] for n in SUGGESTIONS.names) for r in rows], SUGGESTIONS)
    pages, suggestions, errors = apply_approved(site, s, F.lit(NOW))
    assert errors.count() == 0
    new = pages.where("id = 'source'").first()
    assert '<a href="/chatbot/">Chatbot development</a>' in new["content_html"] and new["content_version"] == 2
    assert new["content_html"].replace('<a href="/chatbot/">Chatbot development</a>', "Chatbot development") == BODY
    assert {r["id"]: r["status"] for r in suggestions.collect()} == {"1": "APPLIED", "2": "PENDING"}


def test_scores_by_hand(spark):
    rows = [("g", "a", "https://e.com/a", "Voice agents", "Voice", "d", ["k"], "en", None, "voice agents help voice agents")] + [("g", "b", "https://e.com/voice", "Voice agents guide", "Other", None, [], "en", None, "nothing here")]
    pages = spark.createDataFrame(rows, "g string, page_id string, url string, title string, h1 string, meta_description string, keywords array<string>, language string, region string, body string")
    r = C.score_pairs(pages, ["g"]).where("source_page_id = 'a'").first()
    idf = lambda df: math.log(3 / (1 + df)) + 1
    w = idf(2) / idf(1)  # voice and agent are on both pages
    m = 1 - math.exp(-3 / 2)
    assert r["content_title"] == round(min(1, 2 * w * m / max(2 * w, 1)), 4)
    assert r["title_overlap"] == round(min(1, (2 * w) / (2 * w) * min(1, 2 * w)), 4)
    assert r["phrase_overlap"] == round((1 - math.exp(-1)) / 1, 4)
    assert r["quality"] == 0.65 and r["region_language"] == 1.0 and r["anchor_quality"] == 0
    assert abs(sum(C.SIGNAL_WEIGHTS.values()) - 1) < 1e-12
    signal = {k: r[k] for k in C.SIGNAL_WEIGHTS}
    from weftlink.operators.anchors import score_of

    assert abs(score_of(signal) - r["score"]) < 2e-4


@pytest.mark.parametrize(("a", "b", "want"), [(("en", "us"), (None, None), 0.75), (("en", "us"), ("en", "in"), 0.5), (("en", None), ("de", None), 0.5), (("en-US", None), ("en", "us"), 1.0)])
def test_region_language(spark, a, b, want):
    row = spark.createDataFrame([(*a, *b)], "a string, b string, c string, d string")
    assert row.select(C.region_language(*map(F.col, "abcd"))).first()[0] == want


def suggestion(id_, source, target, status, at=NOW):
    base = dict.fromkeys(SUGGESTIONS.names) | {"id": id_, "site_id": "s", "source_page_id": source, "target_page_id": target, "anchor_text": "a", "context": "c", "relevance_score": 50, "status": status, "created_at": at, "updated_at": at}
    return tuple(base[n] for n in SUGGESTIONS.names)


def test_review(spark):
    s = spark.createDataFrame([suggestion("1", "a", "b", "PENDING"), suggestion("2", "a", "c", "REJECTED"), suggestion("3", "a", "c", "PENDING"), suggestion("4", "a", "d", "APPLIED"), suggestion("5", "a", "e", "REJECTED"), suggestion("6", "a", "e", "REJECTED")], SUGGESTIONS)
    commands = [("1", "REJECTED", "no"), ("2", "APPROVED", None), ("3", "APPLIED", None), ("4", "REJECTED", "x"), ("5", "APPROVED", None), ("6", "APPROVED", None), ("9", "APPROVED", None)]
    new, refused = R.review(s, spark.createDataFrame(commands, "id string, status string, rejection_reason string"), F.lit(NOW))
    got = {r["id"]: r for r in new.collect()}
    assert {k: r["status"] for k, r in got.items()} == {"1": "REJECTED", "2": "REJECTED", "3": "PENDING", "4": "APPLIED", "5": "APPROVED", "6": "REJECTED"}
    assert got["1"]["rejection_reason"] == "no"
    assert {r["id"]: r["error"] for r in refused.collect()} == {"2": "ACTIVE_SUGGESTION_EXISTS", "3": "INVALID_STATUS_TRANSITION", "4": "INVALID_STATUS_TRANSITION", "6": "ACTIVE_SUGGESTION_EXISTS", "9": "SUGGESTION_NOT_FOUND"}


def test_inserts_and_constraints(spark):
    old = spark.createDataFrame([suggestion("1", "a", "b", "PENDING"), suggestion("2", "a", "c", "REJECTED")], SUGGESTIONS)
    new = spark.createDataFrame([suggestion("3", "a", "b", "PENDING"), suggestion("4", "a", "c", "PENDING"), suggestion("5", "a", "c", "PENDING")], SUGGESTIONS)
    after, failed = R.insert_suggestions(old, new)
    assert sorted(r["id"] for r in failed.collect()) == ["3", "5"] and after.count() == 3
    assert suggestion_problems(after).count() == 0
    assert {r["problem"] for r in suggestion_problems(old.union(new)).collect()} == {"ACTIVE_PAIR_REPEATED"}
    assert {r["problem"] for r in page_problems(spark.createDataFrame([page("x", url=None, http_status=7)], PAGES)).collect()} == {"URL_MISSING", "STATUS_RANGE"}


def test_redirects_and_versions(spark):
    rows = [page("a", url="https://e.com/1", redirect_url="https://e.com/2"), page("b", url="https://e.com/2", redirect_url="https://e.com/3"), page("c", url="https://e.com/3", content_html="x")]
    pages = spark.createDataFrame(rows, PAGES)
    assert {r["id"]: (r["final_url"][-1], r["hops"]) for r in R.follow_redirects(pages).collect()} == {"a": ("3", 2), "b": ("3", 1), "c": ("3", 0)}
    edits = spark.createDataFrame([("c", 1, "y", ["l"]), ("a", 7, "z", [])], "id string, expected_version int, content_html string, outgoing_links array<string>")
    new, failed = R.save_content(pages, edits, F.lit(NOW))
    assert new.where("id = 'c'").first()["content_version"] == 2 and [r["id"] for r in failed.collect()] == ["a"]


def test_ai_items(spark):
    reply = "```json\n" + json.dumps({"suggestions": [
        {"target_page_id": "T1", "target_url": "https://e.com/1/", "is_relevant": True, "relevance_score": "80", "reason": "r", "anchor_text": "a", "suggested_context": "c"},
        {"target_page_id": "t1", "is_relevant": 1, "relevance_score": 90.5, "anchor_text": "b", "suggested_context": "c"},
        {"target_page_id": "nope", "is_relevant": True, "relevance_score": 50, "anchor_text": "a", "suggested_context": "c"},
        {"target_page_id": "t2", "target_url": "https://e.com/9", "is_relevant": True, "relevance_score": 50, "anchor_text": "a", "suggested_context": "c"},
        {"target_page_id": "t2", "is_relevant": False, "relevance_score": 5},
        {"target_page_id": "t2", "is_relevant": True, "relevance_score": 500, "anchor_text": "a", "suggested_context": "c"},
    ]}) + "\n```"
    pool = spark.createDataFrame([("s", "t1", "https://e.com/1"), ("s", "t2", "https://e.com/2")], "source_page_id string, target_page_id string, url string")

    def fails(prompt):
        raise A.ProviderError("AI_TIMEOUT")

    prompted = spark.createDataFrame([("s", "p")], "source_page_id string, prompt string")
    asked = A.ask(prompted, fails, lambda prompt: reply)
    assert asked.first()["provider"] == 1 and A.ask(prompted, fails).first()["error"] == "AI_TIMEOUT" and A.ask(prompted).first()["error"] == "AI_PROVIDER_NOT_CONFIGURED"
    items, bad = A.parse_items(asked, pool)
    assert [(r["target_page_id"], r["relevance_score"], r["anchor_text"]) for r in items.collect()] == [("t1", 90, "b")]
    assert [r["problem"] for r in bad.orderBy("position").collect()] == ["UNKNOWN_TARGET", "TARGET_URL_MISMATCH", "NOT_RELEVANT", "INVALID_AI_ITEM"]


def test_crawl(spark):
    html = lambda links, more="": bytearray(("<html><head><title>T</title>" + more + "</head><body><main><p>text here</p>" + "".join(f'<a href="{x}">x</a>' for x in links) + "</main></body></html>").encode())
    kind = {"content-type": "text/html"}
    rows = [
        ("https://e.com/", 200, kind, html(["/a", "/b?utm_x=1", "/pic.png", "https://o.com/", "/missing"]), [], None),
        ("https://e.com/a", 200, kind, html(["/", "/deep", "/a#x"]), [], None),
        ("https://e.com/b", 200, kind, html([], '<meta http-equiv="refresh" content="0;url=/a">'), [], None),
        ("https://e.com/missing", 404, kind, None, [], None),
        ("https://e.com/deep", 200, {"content-type": "application/pdf"}, bytearray(b"x"), [("https://e.com/deep0", 301, "/deep")], None),
    ]
    bronze = spark.createDataFrame(rows, FETCHES)
    existing = spark.createDataFrame([("e.com/missing", "https://e.com/missing"), ("e.com/a", "https://e.com/a/")], "key string, stored_url string")
    reached, items, report = K.crawl(bronze, ["https://e.com"], ("e.com",), existing)
    got = {r["url"]: r for r in items.collect()}
    assert set(got) == {"https://e.com/", "https://e.com/a/", "https://e.com/b"}
    assert got["https://e.com/b"]["redirect_url"] == "https://e.com/a" and not got["https://e.com/b"]["is_indexable"]
    assert got["https://e.com/"]["outgoing_links"] == ["https://e.com/a/", "https://e.com/b", "https://o.com/", "https://e.com/missing"]
    r = report.first()
    assert (r["pages_fetched"], r["skipped_non_html"], r["http_errors"], r["pages_created"], r["pages_updated"]) == (5, 1, 1, 2, 1)
    assert [e["url"] for e in r["errors"]] == ["https://e.com/missing"]
    assert [x["url"] for x in K.failed_updates(reached, existing).collect()] == ["https://e.com/missing"]
    assert K.hop_rows(bronze).first()["redirect_url"] == "https://e.com/deep"
    assert K.crawl(bronze, ["https://e.com"], ("e.com",), existing, 2)[0].count() == 2


def test_stream(spark, tmp_path):
    from weftlink.streaming.ingest import fetch_stream, upsert_stream

    html = lambda t: bytearray(f"<html><head><title>{t}</title></head><body><p>hello</p></body></html>".encode())
    rows = [("https://e.com/", 200, {"content-type": "text/html"}, html(t), [], None) for t in ("old", "older", "T")]
    spark.createDataFrame(rows, FETCHES).coalesce(1).write.parquet(f"{tmp_path}/in")
    sites = spark.createDataFrame([("s", "en", None)], "id string, default_language string, default_region string")
    seen = []
    for out in ("out", "again"):
        upsert_stream(fetch_stream(spark, f"{tmp_path}/in"), sites, "s", ("e.com",), f"{tmp_path}/{out}", f"{tmp_path}/check-{out}").awaitTermination()
        seen.append(spark.read.parquet(f"{tmp_path}/{out}/0").collect())
    assert [(r["url"], r["title"], r["language"], r["content_version"]) for r in seen[0]] == [("https://e.com/", "T", "en", 1)]
    assert seen[0] == seen[1]  # a batch that is run again writes the same rows


def test_batches_with_repeated_keys(spark):
    from weftlink.operators import relational as R

    pages = spark.createDataFrame([page("a", content_html="x", content_version=1), page("b", content_html="y")], PAGES)
    updates = [("s", "https://e.com/a/", 500, "/r", 2), ("s", "https://e.com/a/", 410, None, 3), ("s", "https://e.com/a/", 404, None, 1), ("s", "https://e.com/zz/", 404, None, 1)]
    out = R.update_status(pages, spark.createDataFrame(updates, "site_id string, url string, http_status int, redirect_url string, position int"), F.lit(NOW)).collect()
    assert sorted((r["id"], r["http_status"]) for r in out) == [("a", 410), ("b", 200)]
    edits = [("a", 1, "one", [], 0), ("a", 1, "lost", [], 1), ("a", 2, "two", ["l"], 2), ("b", 9, "no", [], 0), ("zz", 1, "no", [], 0)]
    out, failed = R.save_content(pages, spark.createDataFrame(edits, "id string, expected_version int, content_html string, outgoing_links array<string>, position int"), F.lit(NOW))
    assert sorted((r["id"], r["content_html"], r["content_version"], r["outgoing_links"]) for r in out.collect()) == [("a", "two", 3, ["l"]), ("b", "y", 1, [])]
    assert sorted(r["id"] for r in failed.collect()) == ["a", "b", "zz"]
    once = spark.createDataFrame([("a", 1, "b", []), ("a", 1, "a", [])], "id string, expected_version int, content_html string, outgoing_links array<string>")
    out, failed = R.save_content(pages, once, F.lit(NOW))
    assert out.where("id = 'a'").first()["content_html"] == "a" and failed.count() == 1


def test_settings():
    assert load_settings() == Settings()
    got = load_settings({"INTERLINK_CANDIDATE_POOL_SIZE": "7"}, 'interlink_candidate_pool_size=9\nexport CRAWLER_ALLOWED_PORTS="[80]"\n# x=1')
    assert got.interlink_candidate_pool_size == 7 and got.crawler_allowed_ports == (80,)
    with pytest.raises(SettingsError, match="pool_size.*retries|retries.*pool_size"):
        load_settings({"interlink_candidate_pool_size": "51", "crawler_max_retries": "x"})


def test_lax_readings(spark):
    from weftlink.functions import validate as L

    rows = [("1_000", 1000), ("5.0", 5), ("5.5", None), (" -3 ", -3), ("x", None)]
    out = spark.createDataFrame(rows, "t string, want long").select("want", L.lax_int(F.col("t")).alias("got")).collect()
    assert [r["want"] for r in out] == [r["got"] for r in out]
    texts = spark.createDataFrame([("Yes",), ("off",), ("2",)], "t string").select(L.lax_bool(F.col("t")).alias("b")).collect()
    assert [r["b"] for r in texts] == [True, False, None]
    one = spark.createDataFrame([("{0123456789ABCDEF0123456789abcdef}", "2026-01-02T03:04:05+01:00", "1767323045", "1767323045000", "yesterday")], "u string, a string, b string, c string, d string")
    r = one.select(L.lax_uuid(F.col("u")).alias("u"), *[L.lax_timestamp(F.col(c)).alias(c) for c in "abcd"]).first()
    assert r["u"] == "01234567-89ab-cdef-0123-456789abcdef"
    assert r["b"] == r["c"] and (r["a"].hour, r["a"].minute) == (2, 4) and r["d"] is None
    assert spark.range(1).select(L.problems(A=F.lit(True), B=F.lit(None).cast("boolean"), C=F.lit(False)).alias("p")).first()["p"] == ["A"]


def test_ai_fold():
    from weftlink.functions.markup import blocks_of
    from weftlink.operators.anchors import choose_items

    source = {"id": "source", "url": "https://e.com/source/", "content": BODY, "blocks": blocks_of(BODY, True)}
    item = lambda id_, anchor, context, score: {"id": id_, "url": f"https://e.com/{id_}/", "href": f"/{id_}/", "anchor": anchor, "context": context, "relevance_score": score, "score": 0.1, "reason": "r", "existing": []}
    first = "We build voice agents for clinics and banks every single day."
    second = "Chatbot development is another thing that our customers ask for."
    items = [item("a", "voice agents", first, 80), item("b", "clinics", first, 90), item("c", "Chatbot development", second, 75), item("d", "customers", second, 70), item("e", "nowhere", "Not on the page at all.", 99), item("f", "teams", "saves time for busy teams", 10), item("g", "click here", second, 95)]
    got = {r["target_page_id"]: r["skipped"] for r in choose_items(source, items, 70, 1, 3)}
    assert got == {"b": None, "a": "CONTEXT_ALREADY_USED", "c": "MAX_SUGGESTIONS_REACHED", "d": "MAX_SUGGESTIONS_REACHED", "e": "CONTEXT_NOT_IN_SOURCE", "f": "BELOW_THRESHOLD", "g": "ANCHOR_GENERIC"}


def test_ai_analysis_falls_back(spark, site):
    from weftlink.plans.analyze import analyze_ai

    none = spark.createDataFrame([], SUGGESTIONS)
    said = json.dumps([{"target_page_id": "chatbot", "is_relevant": True, "relevance_score": 88, "reason": "r", "anchor_text": "Chatbot development", "suggested_context": "Chatbot development is another thing that our customers ask for."}])
    only = spark.createDataFrame([("source",)], "id string")
    found = analyze_ai(site, none, F.lit(NOW), lambda prompt: said, sources=only)
    assert [(r["target_page_id"], r["skipped"]) for r in found["suggestions"].collect()] == [("chatbot", None)] and found["errors"].count() == 0
    told = {r["target_page_id"]: r for r in found["diagnostics"].collect()}
    assert set(told) == {r["target_page_id"] for r in found["candidates"].collect()}
    assert set(told["chatbot"]["signals"]) == set(C.SIGNAL_WEIGHTS) and told["chatbot"]["signals"]["anchor_quality"] > 0.5 and told["chatbot"]["score"] > 0 and told["chatbot"]["retrieval_score"] > 0
    found = analyze_ai(site, none, F.lit(NOW), sources=only, fallback=True)
    assert {r["error"] for r in found["errors"].collect()} == {"AI_PROVIDER_NOT_CONFIGURED"}
    assert "chatbot" in {r["target_page_id"] for r in found["suggestions"].where("skipped is null").collect()}


def test_embedding_top_k_joins_queries_in_blocks(spark, monkeypatch):
    rows = [(i, [float(i % 7 + 1), float(i % 5), float(i % 3)]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = vectors.selectExpr("vec_id as query_id", "embedding as q")
    whole = sorted(map(tuple, V.embedding_top_k(queries, vectors, 4).collect()))
    monkeypatch.setattr(V, "QUERY_BLOCK", 25)
    assert sorted(map(tuple, V.embedding_top_k(queries, vectors, 4).collect())) == whole and len(whole) == 240


def test_embedding_top_k_of_more_queries_than_a_block(spark):
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(3)], "vec_id long, embedding array<float>")
    queries = spark.range(100, 10_101).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("q"))
    assert V.embedding_top_k(queries, vectors, 2).count() == 2 * 10_001
