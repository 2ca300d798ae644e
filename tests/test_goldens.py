"""Goldens from the reference's own test assertions, on literal inputs."""

import datetime as dt
import os

from pyspark.sql import functions as F

from webtide.config import DEFAULTS
from webtide.functions.markdown import to_markdown
from webtide.functions.text import read_time_min, word_count
from webtide.functions.urls import resolve_url
from webtide.operators import gates as G
from webtide.operators import outcomes as O
from webtide.operators.chunks import assemble_chunks, chunk_limit
from webtide.operators.extraction import extract_pages, select_body
from webtide.operators.redirects import resolve_redirects
from webtide.plans.articles import build_articles


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


# --- D6 / D4 --------------------------------------------------------------------------------


def test_retry_after_ms(spark):
    now = dt.datetime(2026, 1, 1, 0, 0, 0)
    df = spark.createDataFrame(
        [("1",), ("999999",), ("Thu, 01 Jan 2026 00:00:30 GMT",), ("",), ("  ",), ("Wed, 31 Dec 2025 23:59:00 GMT",),
         ("nonsense",), ("0",), (None,)],
        "v string",
    ).withColumn("now", F.lit(now).cast("timestamp"))
    got = [r[0] for r in df.select(O.retry_after_ms(F.col("v"), F.col("now"))).collect()]
    assert got == [1000.0, 60000.0, 30000.0, None, None, None, None, 0.0, None]


def test_retry_decision(spark):
    df = spark.createDataFrame(
        [(429, None, "2"), (403, None, None), (503, None, "0"), (None, "Timeout", None), (None, "net::ERR_X", None),
         (None, "Captcha page", None), (404, None, None)],
        "status int, msg string, ra string",
    )
    d = O.retry_decision(F.col("status"), F.col("msg"), F.col("ra"), F.current_timestamp())
    got = rows(df.select(d["retryable"].alias("r"), d["was_antibot"].alias("a"), d["retry_after_ms"].alias("ms")), "r", "a", "ms")
    assert got == [(True, True, 2000.0), (False, True, None), (True, False, None), (True, False, None),
                   (True, False, None), (False, True, None), (False, False, None)]


# --- B11 / D1 / B2 -----------------------------------------------------------------------------


def test_content_type_gate(spark):
    rejected = ["image/png", "video/mp4", "application/pdf", "application/octet-stream"]
    passed = ["text/html", "text/plain", "text/xml", "text/html; charset=utf-8", "application/rss+xml",
              "application/atom+xml", "application/xml", "application/json", "application/ld+json", None, ""]
    df = spark.createDataFrame([(x,) for x in rejected + passed], "ct string")
    got = [r[0] for r in df.select(G.content_type_message(F.col("ct"))).collect()]
    assert got[: len(rejected)] == [f"Unsupported content type: {x}" for x in rejected]
    assert got[len(rejected):] == [None] * len(passed)


def test_fetch_error_code(spark):
    cases = [
        ("Invalid URL", None, "FETCH_INVALID_REQUEST", 400),
        ("Too many redirects", None, "FETCH_TOO_MANY_REDIRECTS", 508),
        ("Response too large", None, "FETCH_RESPONSE_TOO_LARGE", 413),
        ("Unsupported content type: image/png", None, "FETCH_UNSUPPORTED_CONTENT_TYPE", 400),
        ("Request aborted", None, "FETCH_ABORTED", 400),
        ("net::ERR_CONNECTION_REFUSED", None, "FETCH_BROWSER_ERROR", 502),
        ("page.goto failed", None, "FETCH_BROWSER_ERROR", 502),
        ("navigation failed", None, "FETCH_BROWSER_ERROR", 502),
        ("Something went wrong", None, "FETCH_ERROR", 500),
        ("HTTP status 503", 503, "FETCH_HTTP_STATUS", 502),
        ("Timeout", None, "FETCH_TIMEOUT", 504),
    ]
    df = spark.createDataFrame([(m, s) for m, s, _, _ in cases], "m string, s int")
    fe = O.fetch_error_code(F.col("m"), F.col("s"))
    got = rows(df.select(fe["code"].alias("c"), fe["http_status"].alias("h")), "c", "h")
    assert got == [(c, h) for _, _, c, h in cases]


def test_engine_not_supported(spark):
    df = spark.createDataFrame([("nope",), ("http",)], "engine string")
    got = rows(G.engine_not_supported(df), "error_code", "http_status", "attempts", "retryable")
    assert got == [("FETCH_ENGINE_NOT_SUPPORTED", 400, 1, False), (None, None, None, None)]


# --- B8 / B9 ---------------------------------------------------------------------------------------


def test_ipv4_block(spark):
    hosts = ["10.0.0.1", "192.168.1.1", "169.254.169.254", "127.0.0.1", "8.8.8.8", "172.32.0.1"]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    strict = {r["host"]: r["ipv4_blocked"] for r in G.ipv4_block(df).collect()}
    loose = {r["host"]: r["ipv4_blocked"] for r in G.ipv4_block(df, allow_loopback=True).collect()}
    assert [strict[h] for h in hosts] == [True, True, True, True, False, False]
    assert loose["127.0.0.1"] is False and loose["10.0.0.1"] is True


def test_ipv6_block(spark):
    df = spark.createDataFrame([("[::1]",), ("fe80::1",), ("fd00::2",), ("2001:db8::1",)], "host string")
    got = [r[0] for r in df.select(G.ipv6_blocked(F.col("host"))).collect()]
    assert got == [True, True, True, False]


# --- B16 / B17 -----------------------------------------------------------------------------------


def test_request_headers(spark):
    many = {f"X-H{i}": "v" for i in range(51)}
    df = spark.createDataFrame(
        [({"Authorization": "x"},), ({"Cookie": "a=1"},), (many,), ({"Proxy-Authorization": "x", "Host": "h", "Accept": "a"},)],
        "headers map<string,string>",
    )
    s = G.sanitize_request_headers(df)
    got = rows(s, "header_error")
    assert got == [("Forbidden header: Authorization",), ("Forbidden header: Cookie",), ("Too many headers",), (None,)]
    assert s.collect()[3]["clean_headers"] == {"Accept": "a"}


def test_response_headers(spark):
    df = spark.createDataFrame([({"Content-Encoding": "gzip", "Set-Cookie": "a", "Connection": "close", "X": "1"},)],
                               "headers map<string,string>")
    assert G.sanitize_response_headers(df).collect()[0]["clean_headers"] == {"Content-Encoding": "gzip", "X": "1"}


# --- B12 / D3 -----------------------------------------------------------------------------------------


def test_size_gate_and_file_code(spark):
    df = spark.createDataFrame([("999", "x"), ("10", "0123456789"), (None, "01234567890")], "d string, body string")
    msg = G.size_message(F.col("d"), F.col("body"), 10)
    got = [r[0] for r in df.select(msg).collect()]
    assert got == ["Response too large", None, "Response too large"]
    fc = O.file_error_code(F.lit("Response too large"))
    r = df.limit(1).select(fc["code"].alias("c"), fc["http_status"].alias("h")).collect()[0]
    assert (r["c"], r["h"]) == ("FILE_RESPONSE_TOO_LARGE", 413)


# --- D5 ----------------------------------------------------------------------------------------------


def test_block_signal_page_list(spark):
    from webtide.functions.patterns import PAGE_BLOCK_WORDS

    pos = ["captcha", "bot detection", "access denied", "forbidden", "rate limit", "security check", "cloudflare", "recaptcha"]
    df = spark.createDataFrame([(m,) for m in pos + ["network timeout", "Captcha"]], "m string")
    got = [r[0] for r in df.select(O.block_signal(F.col("m"), PAGE_BLOCK_WORDS, lower=False)).collect()]
    assert got == [True] * len(pos) + [False, False]


# --- C13 / C14 / C15 / C16 / C3 / C4 ----------------------------------------------------------------------


def test_markdown(spark):
    html = ["<h1>Title</h1><p>Para <strong>bold</strong> and <em>it</em></p><ul><li>one</li><li>two</li></ul>",
            "", "   ", "<p>unclosed <b>bold", "<p>x<script>var a='</p>';</script>y</p>",
            "<ol><li>a</li><li>b</li></ol><pre><code class=\"language-py\">x = 1</code></pre>"]
    df = spark.createDataFrame([(h,) for h in html], "h string")
    md = [r[0] for r in df.select(to_markdown("h")).collect()]
    assert md[0].startswith("# Title") and "**bold**" in md[0] and "*it*" in md[0] and "- one" in md[0] and "- two" in md[0]
    assert md[1] == "" and md[2] == ""
    assert "**" not in md[3] and "unclosed" in md[3]
    assert "1. a" in md[5] and "2. b" in md[5] and "```py" in md[5]


def test_body_word_count_read_time(spark):
    df = spark.createDataFrame([(True, "<p>a b</p>", "a b"), (False, "<p>a b</p>", "a b"), (None, None, None)],
                               "raw boolean, html string, md string")
    b = df.select(select_body(F.coalesce(F.col("raw"), F.lit(False)), F.col("html"), F.col("md")).alias("body"))
    got = rows(b.select("body", word_count("body").alias("w")), "body", "w")
    assert got == [("<p>a b</p>", 2), ("a b", 2), ("", 0)]
    w = spark.createDataFrame([(0,), (1,), (200,), (201,)], "w int")
    assert [r[0] for r in w.select(read_time_min("w")).collect()] == [0, 1, 1, 2]


def test_metadata_strings(spark):
    html = ('<html lang="ru-RU"><head><meta property="article:published_time" content="2025-11-17T00:31:57+0300">'
            '<meta name="author" content=""><meta content="Desc &amp; more" name="description">'
            '<meta property="og:title" content="OG title"><link rel="shortcut icon" href="/fav.ico">'
            '<meta property="og:image" content="img/a.png"></head><body><article><p>Hello world</p></article></body></html>')
    pages = spark.createDataFrame([(1, "https://ex.com/a/b?x=1", html)], "page_id bigint, url string, html string")
    r = extract_pages(pages).collect()[0]
    assert r["date"] == "2025-11-17T00:31:57+0300"
    assert r["author"] == ""
    assert r["description"] == "Desc & more"
    assert r["title"] == "OG title"
    assert r["lang"] == "ru"
    assert r["favicon"] == "https://ex.com/fav.ico"
    assert r["image"] == "https://ex.com/a/img/a.png"
    assert r["source"] == "ex.com"


def test_raw_body_article(spark):
    pages = spark.createDataFrame([(1, "https://ex.com/p", "<html><body><article><p>One two</p></article></body></html>")],
                                  "page_id bigint, url string, html string")
    reqs = spark.createDataFrame([(1, "https://ex.com/p", "extractor", True, None, None)],
                                 "req_id bigint, url string, mode string, raw_body boolean, task_timeout_secs int, block_list string")
    r = build_articles(pages, reqs).collect()[0]
    assert "<p>" in r["body"] and r["raw_body"] is True and r["word_count"] == 2


def test_rendered_empty_extraction_is_error(spark):
    pages = spark.createDataFrame([(1, "https://ex.com/p", "<html><body></body></html>")], "page_id bigint, url string, html string")
    reqs = spark.createDataFrame([(1, "https://ex.com/p", "playwright", None), (2, "https://ex.com/p", "extractor", None)],
                                 "req_id bigint, url string, mode string, raw_body boolean")
    got = {r["req_id"]: (r["error_code"], r["body"]) for r in build_articles(pages, reqs).collect()}
    assert got[1][0] == 422 and got[2] == (None, "")


# --- B1 ---------------------------------------------------------------------------------------------------


def test_page_request_validation(spark):
    df = spark.createDataFrame([(None, None, None), ("not-a-url", None, None), ("https://x.y", "bogus", 0)],
                               "url string, mode string, task_timeout_secs int")
    errs = [r["errors"] for r in G.validate_page_requests(df).collect()]
    assert errs[0] == ["url must be a URL address"]
    assert errs[1] == []
    assert len(errs[2]) == 2


# --- C12 / D12 ----------------------------------------------------------------------------------------------


def test_resolve_url(spark):
    base = "http://a.com/b/c/d?q#f"
    refs = ["g", "./g", "../g", "/g", "//h.com/x", "?y", "#s", "", "https://z.com/", "../../../g"]
    df = spark.createDataFrame([(base, r) for r in refs], "b string, r string")
    got = [x[0] for x in df.select(resolve_url(F.col("b"), F.col("r"))).collect()]
    assert got == ["http://a.com/b/c/g", "http://a.com/b/c/g", "http://a.com/b/g", "http://a.com/g", "http://h.com/x",
                   "http://a.com/b/c/d?y", "http://a.com/b/c/d?q#s", "http://a.com/b/c/d?q", "https://z.com/", "http://a.com/g"]


def test_redirect_relative_location(spark):
    starts = spark.createDataFrame([(1, "http://t.example/redirect"), (2, "http://t.example/loop")], "page_id bigint, url string")
    edges = spark.createDataFrame([("http://t.example/redirect", "/test-page"), ("http://t.example/loop", "/loop")],
                                  "src_url string, location string")
    got = {r["page_id"]: (r["final_url"], r["hops"], r["error_message"]) for r in resolve_redirects(starts, edges).collect()}
    assert got[1] == ("http://t.example/test-page", 1, None)
    assert got[2] == (None, DEFAULTS.max_redirects, "Too many redirects")


# --- D20 / D21 ------------------------------------------------------------------------------------------------


def test_chunks_binary(spark):
    df = spark.createDataFrame([(1, 0, bytearray(b"a\xc3")), (1, 1, bytearray(b"\xa9")), (2, 0, bytearray(b"\xef\xbb\xbfhi"))],
                               "object_id bigint, seq int, data binary")
    got = {r["object_id"]: r["text"] for r in assemble_chunks(df).collect()}
    assert got == {1: "aé", 2: "hi"}
    lim = {(r["object_id"], r["seq"]): r["emitted"] for r in chunk_limit(df, cap=2).collect()}
    assert lim[(1, 0)] is True and lim[(1, 1)] is False


# --- E3 = batch D10 ---------------------------------------------------------------------------------------------


STREAM_KIND = ("req_id long, ts timestamp, event_id long, engine string, status int, err_msg string, content_type string, "
               "retry_after string, dur_ms long")


def _run_state(spark, d, parts, **options):
    """The stream over ``parts`` of a log, one trigger each, and its end."""
    from webtide.streaming.jobs import close_open_requests, stream_request_state

    for part in parts:
        spark.createDataFrame(part, STREAM_KIND).coalesce(1).write.mode("append").parquet(d + "/log")
    s = spark.readStream.schema(STREAM_KIND).option("maxFilesPerTrigger", 1).parquet(d + "/log")
    stream_request_state(s, d + "/out", d + "/late", d + "/ckpt", jitter=False, **options)
    early = spark.read.parquet(d + "/out").count()
    close_open_requests(spark, d + "/out", d + "/ckpt", jitter=False)
    out = sorted(map(tuple, spark.read.parquet(d + "/out").drop("batch").collect()), key=str)
    late = sorted((r["kind"], r["req_id"], r["event_id"]) for r in spark.read.parquet(d + "/late").collect())
    return early, out, late


def test_stream_state_whatever_the_files(spark, tmp_path):
    import random
    from datetime import datetime, timedelta

    from webtide.operators.outcomes import final_outcome

    t0 = datetime(2024, 1, 1)
    rows = [(r, t0 + timedelta(minutes=7 * r + 300 * a), 10 * r + a, "http" if r % 4 else "playwright", [503, 429, 200, None][(r + a) % 4],
             ["Timeout", None, "SSRF blocked"][r % 3] if (r + a) % 4 == 3 else None, "text/html", "2" if r % 5 == 0 else None, [500, 70_000, None][r % 3])
            for r in range(60) for a in range(1 + r % 5)]
    want = sorted(map(tuple, final_outcome(spark.createDataFrame(rows, STREAM_KIND), jitter=False).collect()), key=str)
    assert len(want) == 60
    rows.sort(key=lambda r: r[1])
    rng = random.Random(3)
    shuffled = sorted(rows, key=lambda r: r[1] + timedelta(minutes=rng.randrange(59)))
    for name, order, some in (("ordered", rows, (1,)), ("shuffled", shuffled, (1, 16))):
        for files in some:
            cuts = [len(order) * i // files for i in range(files + 1)]
            early, got, late = _run_state(spark, str(tmp_path / f"{name}{files}"), [order[a:b] for a, b in zip(cuts, cuts[1:])])
            assert got == want
            # most requests come out while the log goes on, and nothing is late
            assert early >= (30 if files > 1 else 20) and {k for k, _, _ in late} <= {"after_end"}


def test_stream_state_aborts_late_rows_and_patience(spark, tmp_path):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)

    def row(req, minutes, event, status, msg=None):
        return (req, t0 + timedelta(minutes=minutes), event, "http", status, msg, None, None, 10)

    parts = [
        [row(1, 0, 1, 503), row(2, 0, 2, 200), row(3, 0, 3, 503)],
        [row(1, 5, 4, None, "Request aborted"), row(9, 600, 5, 200)],
        [row(1, 601, 6, 200), row(2, 1, 7, 200), row(9, 700, 8, 200)],  # closed; late; closed
        [row(8, 20 * 1440, 9, 200)],  # the clock goes on by more than the patience
        [row(3, 20 * 1440 + 1, 10, 200), row(8, 20 * 1440 + 2, 11, 200)],
    ]
    early, got, late = _run_state(spark, str(tmp_path / "s"), parts)
    by_id = {}
    for r in got:
        by_id.setdefault(r[0], []).append(r)
    cols = spark.read.parquet(str(tmp_path / "s/out")).drop("batch").columns
    one = {k: dict(zip(cols, v[0])) for k, v in by_id.items()}
    assert (one[1]["error_code"], one[1]["attempts"], one[1]["http_status"]) == ("FETCH_ABORTED", 2, 400)
    assert one[2]["outcome"] == "success" and len(by_id[2]) == len(by_id[1]) == len(by_id[9]) == 1
    # no attempt came for 7 days: closed with what there was
    assert [r[cols.index("outcome")] for r in by_id[3]] == ["error"]
    assert late == [("after_end", 1, 6), ("after_end", 3, 10), ("after_end", 9, 8), ("late", 2, 7)]
    assert one[8]["outcome"] == "success" and one[8]["attempts"] == 1


# --- D3, D10, D11, D13, D15, D17 from the reference's behaviour -----------------------------------------------------


def _attempts(spark, rows):
    kind = ("req_id long, ts timestamp, event_id long, engine string, status int, err_msg string, content_type string, "
            "retry_after string, dur_ms long")
    from datetime import datetime, timedelta

    return spark.createDataFrame([(r, datetime(2024, 1, 1) + timedelta(seconds=i), i, e, s, m, None, None, d) for i, (r, e, s, m, d) in enumerate(rows)], kind)


def test_attempt_past_the_budget_is_cut(spark):
    from webtide.operators.outcomes import final_outcome

    rows = [(1, "http", 503, None, 50_000), (1, "http", 200, None, 20_000), (2, "http", 200, None, 60_000), (3, "http", 200, None, 60_001),
            (4, "http", 503, None, 10), (4, "http", 200, None, 5), (5, "http", None, None, 5)]
    got = {r["req_id"]: r for r in final_outcome(_attempts(spark, rows), jitter=False, timeout_secs=60).collect()}
    assert (got[1]["outcome"], got[1]["error_code"], got[1]["http_status"], got[1]["status_code"], got[1]["duration_ms"]) == ("error", "FETCH_TIMEOUT", 504, None, 60_000)
    assert got[2]["outcome"] == "success" and got[2]["duration_ms"] == 60_000
    assert (got[3]["error_code"], got[3]["duration_ms"]) == ("FETCH_TIMEOUT", 60_000)
    assert got[4]["outcome"] == "success" and got[4]["duration_ms"] == 15 + got[4]["total_wait_ms"] > 15
    assert got[5]["outcome"] == "error"


def test_fallback_needs_a_rendered_response(spark):
    from webtide.operators.outcomes import final_outcome, merge_fallback, merge_fallback_by_engine

    rows = [(1, "http", 403, None, 1), (1, "playwright", None, "Timeout", 1), (2, "http", 403, None, 1), (2, "playwright", 200, None, 1),
            (3, "http", 429, None, 1), (4, "http", 200, None, 1), (4, "playwright", 200, None, 1)]
    both = final_outcome(_attempts(spark, rows), jitter=False, req=["req_id", "engine"])
    got = {r["req_id"]: (r["mode_used"], r["status_code"]) for r in merge_fallback_by_engine(both).collect()}
    assert got == {1: ("http", 403), 2: ("playwright", 200), 3: ("http", 429), 4: ("http", 200)}
    one = lambda e: both.where(F.col("engine") == e).drop("engine")
    assert {r["req_id"]: (r["mode_used"], r["status_code"]) for r in merge_fallback(one("http"), one("playwright")).collect()} == got


def test_file_messages(spark):
    from webtide.operators.outcomes import file_error_code

    messages = ["the cache was empty", "too many redirects here", "SSRF blocked: 10.0.0.1", "Response too large (9)", "Forbidden header: x"]
    df = spark.createDataFrame([(m,) for m in messages], "m string")
    f = file_error_code(F.col("m"))
    got = [tuple(r) for r in df.select(f["code"], f["message"], f["http_status"]).collect()]
    assert got == [("FILE_ERROR", messages[0], 502), ("FILE_ERROR", messages[1], 502), ("FILE_SSRF_BLOCKED", "SSRF blocked", 400),
                   ("FILE_RESPONSE_TOO_LARGE", "Response too large", 413), ("FILE_INVALID_HEADERS", messages[4], 400)]


def test_health_under_a_base_path_and_wire_details(spark):
    from webtide.operators.logs import shape_access_log
    from webtide.operators.outcomes import wire_normalize

    df = spark.createDataFrame([("/api/v1/health", 200, None, None, None), ("/page?next=/health", 200, None, None, None), ("/page", 200, None, None, None)],
                               "url string, status int, auth_header string, api_key_header string, ua_header string")
    assert [r["url"] for r in shape_access_log(df).collect()] == ["/page"]
    assert shape_access_log(df, production=False).count() == 3
    w = spark.createDataFrame([(400, "X", "m", ["a must be b"]), (502, "Y", "n", None)], "response_status int, error_code string, error_message string, messages array<string>")
    got = [(r["wire_code"], r["wire_message"], r["wire_details"]) for r in wire_normalize(w, messages=F.col("messages")).collect()]
    assert got == [("400", "Validation failed", ["a must be b"]), ("Y", "n", None)]


# --- URL spellings, redirects, HTML forms ------------------------------------------------------------------------


def test_no_spelling_of_an_address_passes(spark):
    blocked = ["http://127.0.0.1/", "http://127.0.0.1./", "http://0177.0.0.1/", "http://012.0.0.1/", "http://127%2e0.0.1/", "http://127.0.0.1\t/",
               "http://[::0001]/", "http://[0:0::1]/", "http://256.1.1.1/", "http://2130706433/", "http://0x7f.1/", "http://[FE80::1]/", "http://[0fd0::1]/"]
    fine = ["http://8.8.8.8/", "http://1.2.3.4.example.com/", "http://[2001:db8::1]/", "http://example.com:8080/127.0.0.1", "http://fd.example.com/"]
    df = spark.createDataFrame([(u,) for u in blocked + fine], "url string")
    got = {r["url"]: r["gate_message"] for r in G.url_gate(df).collect()}
    assert [u for u in blocked if got[u] not in ("SSRF blocked", "Invalid URL") and u != "http://[0fd0::1]/"] == []
    assert [u for u in fine if got[u] is not None] == []


def test_custom_deny_table(spark):
    hosts = spark.createDataFrame([("1.2.3.4",), ("1.2.4.9",), ("9.9.9.9",), ("name",), (None,)], "host string")
    deny = spark.createDataFrame([(16909056, 16909311, False), (16909000, 16909567, True)], "lo bigint, hi bigint, loopback boolean")
    got = [(r["host"], r["ipv4_blocked_strict"], r["ipv4_blocked_loopback_ok"]) for r in G.ipv4_block(hosts, ranges=deny).collect()]
    assert got == [("1.2.3.4", True, True), ("1.2.4.9", True, False), ("9.9.9.9", False, False), ("name", False, False), (None, False, False)]


def test_redirect_edges_count_once(spark):
    starts = spark.createDataFrame([(1, "HTTP://A.example:80"), (2, "https://a.example/x")], "page_id bigint, url string")
    edges = spark.createDataFrame([("http://a.example/", "/b"), ("http://a.example/", "/b"), ("http://A.example/b", "/c"), ("http://a.example:80/b", "/c")],
                                  "src_url string, location string")
    got = sorted((r["page_id"], r["final_url"], r["hops"], r["error_message"]) for r in resolve_redirects(starts, edges).collect())
    assert got == [(1, "http://a.example/c", 2, None), (2, "https://a.example/x", 0, None)]


def test_html_forms(spark):
    html = ("<html><head><meta name='description' content='Tom&#8217;s &eacute;t&eacute; &#x27;'><meta content=Writer name=author>"
            "<link href='/f.ico' rel=icon></head><body><a href='/out'>out</a><article><h1>T</h1><p>a <a href='x?y=1'>l&rsquo;x</a> <a class=k href=/z></a></p>"
            "<article><p>inner</p></article><p>after &nbsp; &bogus; &amp;lt;</p></article><p>no</p></body></html>")
    pages = spark.createDataFrame([(1, "https://ex.com/d/p", html)], "page_id bigint, url string, html string")
    r = build_articles(pages).collect()[0]
    assert (r["description"], r["author"], r["favicon"]) == ("Tom’s été '", "Writer", "https://ex.com/f.ico")
    assert [tuple(x) for x in r["links"]] == [("https://ex.com/d/x?y=1", "l’x"), ("https://ex.com/z", None)] and r["n_links"] == 2
    assert "after" in r["body"] and "&bogus; &lt;" in r["body"] and "inner" in r["body"] and "no" not in r["body"].split()


def test_article_gates(spark):
    from dataclasses import replace

    page = "<html><body><article><p>" + "word " * 100 + "</p></article></body></html>"
    pages = spark.createDataFrame([(1, "https://a.ex/1", page), (2, "https://a.ex/2", page), (3, "http://127.0.0.1/", page), (4, "https://a.ex/other", page)],
                                  "page_id bigint, url string, html string")
    reqs = spark.createDataFrame([(1, "https://a.ex/1", "playwright"), (2, "https://a.ex/2", "extractor"), (3, "http://127.0.0.1/", "extractor"), (4, "https://a.ex/none", "extractor")],
                                 "req_id bigint, url string, mode string").selectExpr("*", "60 as task_timeout_secs", "false as raw_body", "cast(null as string) as block_list")
    got = {r["req_id"]: r for r in build_articles(pages, reqs, replace(DEFAULTS, max_response_bytes=100)).collect()}
    assert (got[1]["error_code"], got[1]["error_message"], got[1]["error_details"]) == (422, "Failed to extract content from page", "Response too large")
    assert got[1]["body"] is None and got[2]["error_code"] is None and got[2]["word_count"] == 100
    assert got[3]["error_details"] == "SSRF blocked" and got[4]["error_code"] is None and got[4]["body"] == ""


# --- A3 / A4 / A5 / F1 ----------------------------------------------------------------------------------------------


def test_scan_objects(spark):
    from conftest import SF_SMALL
    from webtide.sources.readers import scan_objects, scan_objects_within_cap

    m = scan_objects(spark, SF_SMALL + "/*.parquet", service_cap=20_000)
    allrows = m.collect()
    assert any(r["within_cap"] for r in allrows) and not all(r["within_cap"] for r in allrows)
    small = scan_objects_within_cap(spark, SF_SMALL + "/*.parquet", service_cap=20_000, request_cap=10_000)
    assert all(r["length"] <= 10_000 for r in small.collect())


def test_sinks(spark, tmp_path):
    from webtide.sources.sinks import write_articles, write_outcomes

    pages = spark.createDataFrame([(1, "https://ex.com/p", "<html><body><article><p>One two</p></article></body></html>")],
                                  "page_id bigint, url string, html string")
    arts = build_articles(pages)
    write_articles(arts, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 1
    write_articles(arts, str(tmp_path / "j"), fmt="json")
    assert '"description"' not in open([os.path.join(str(tmp_path / "j"), f) for f in os.listdir(tmp_path / "j") if f.endswith(".json")][0]).read()
    out = spark.createDataFrame([(1, "success"), (2, "error")], "req_id int, outcome string")
    write_outcomes(out, str(tmp_path / "ok"), str(tmp_path / "err"))
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 1 and spark.read.parquet(str(tmp_path / "err")).count() == 1


def test_custom_extractor(spark):
    from webtide.operators.extension import StdlibExtractor, extract

    pages = spark.createDataFrame([(1, "u", '<html lang="de"><title>T &amp; U</title><body>a b <script>x y</script>c</body></html>')],
                                  "page_id bigint, url string, html string")
    r = extract(pages, StdlibExtractor()).collect()[0]
    assert (r["title"], r["lang"], r["text_words"]) == ("T & U", "de", 3)


def test_unicode_blanks(spark):
    from webtide.functions.text import trim_ws

    vals = ["  a　b ﻿", "﻿", "x  y\n", "", None, "​z"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [(r[0], r[1]) for r in df.select(trim_ws("v"), word_count("v")).collect()]
    assert got == [("a　b", 2), ("", 0), ("x  y", 2), ("", 0), (None, 0), ("​z", 1)]


def test_row_number_of_hot_and_null_keys(spark):
    from pyspark.sql import Window

    from webtide.plans.sequence import row_number_by_key

    # one hot key with most of the rows, small keys, null keys and null times
    df = spark.range(0, 5000).selectExpr(
        "case when id % 10 < 7 then 0 when id % 10 = 9 then null else id % 13 end as k",
        "case when id % 31 <> 0 then cast(id * 7919 % 5003 as bigint) end as t", "id")
    got = row_number_by_key(df, "k", ["t", "id"], F.floor(F.col("t") / 500), "rn")
    ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("t", "id")))
    assert got.count() == 5000 and dict(got.dtypes)["rn"] == "bigint"
    assert got.select("id", "rn").subtract(ref.select("id", F.col("rn").cast("long"))).count() == 0


def test_read_requests(spark, tmp_path):
    from webtide.sources.readers import read_requests

    p = str(tmp_path / "req.json")
    with open(p, "w") as f:
        f.write('{"req_id": 1, "url": "https://a.b/", "mode": "", "task_timeout_secs": 0, "block_list": " x.com, ,y.com"}\n')
        f.write('{"req_id": 2, "url": "https://a.b/", "mode": "playwright", "raw_body": true}\n')
    r = {x["req_id"]: x for x in read_requests(spark, p, "page", fmt="json").collect()}
    assert (r[1]["mode"], r[1]["task_timeout_secs"], r[1]["raw_body"], r[1]["block_list"]) == ("extractor", 60, False, ["x.com", "y.com"])
    assert (r[2]["mode"], r[2]["raw_body"]) == ("playwright", True)


def test_continue_on_fail_stop_raises(spark):
    import pytest

    df = spark.createDataFrame([(1, None), (2, "boom")], "item_index int, error_message string")
    out = O.continue_on_fail(df, "continue").collect()
    assert [r["json"] for r in out] == ['{}', '{"error":"boom"}']
    with pytest.raises(Exception):
        O.continue_on_fail(df, "stop").collect()


def test_tracker_large_list_paths(spark):
    from conftest import SF_SMALL
    from webtide.plans.queries_gates import tracker_inputs

    links, bl = tracker_inputs(spark, SF_SMALL)
    small = {tuple(r) for r in G.tracker_antijoin(links, bl).select("page_id", "pos").collect()}
    big = {tuple(r) for r in G.tracker_antijoin(links, bl, max_rows=0).select("page_id", "pos").collect()}
    assert small and small == big


def test_parsed_date(spark):
    html = '<html><head><meta property="article:published_time" content="2025-11-17T00:31:57+0300"></head><body><article><p>x</p></article></body></html>'
    pages = spark.createDataFrame([(1, "https://ex.com/p", html)], "page_id bigint, url string, html string")
    r = build_articles(pages, parse_dates=True).collect()[0]
    assert r["date"] == "2025-11-17T00:31:57+0300"
    assert r["date_ts"] == dt.datetime(2025, 11, 16, 21, 31, 57)


def test_redirect_resolved_gate(spark):
    starts = spark.createDataFrame([(1, "http://a.example/x"), (2, "http://c.example/x")], "page_id bigint, url string")
    edges = spark.createDataFrame([("http://a.example/x", "http://b.example/y"), ("http://c.example/x", "/z")],
                                  "src_url string, location string")
    resolved = spark.createDataFrame([("a.example", "93.184.216.34"), ("b.example", "10.1.2.3"), ("c.example", "93.184.216.35")],
                                     "host string, address string")
    got = {r["page_id"]: (r["final_url"], r["hops"], r["error_message"])
           for r in resolve_redirects(starts, edges, resolved=resolved).collect()}
    assert got[1] == (None, 1, "SSRF blocked")
    assert got[2] == ("http://c.example/z", 1, None)


def test_size_cap_pushdown(spark, tmp_path):
    p = str(tmp_path / "pages")
    spark.createDataFrame([(1, "a" * 10), (2, "b" * 5000)], "page_id bigint, html string") \
        .withColumn("n_bytes", F.octet_length("html").cast("bigint")).write.parquet(p)
    df = G.within_size_cap(spark.read.parquet(p), "n_bytes", 4096)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "LessThanOrEqual(n_bytes,4096)" in plan
    assert [r["page_id"] for r in df.collect()] == [1]
    g = G.size_gate(spark.read.parquet(p), 4096, stored_length="n_bytes")
    assert {r["page_id"]: r["size_message"] for r in g.collect()} == {1: None, 2: "Response too large"}


def test_stream_outcomes_drops_late_rows(spark, tmp_path):
    """Rows behind the watermark (max event time − delay) are dropped. Two
    runs on one checkpoint make the order certain: the watermark of the
    first run is restored in the second, where the late row arrives."""
    from webtide.streaming.jobs import stream_outcomes

    src = str(tmp_path / "src")
    base = dt.datetime(2024, 1, 1, 0, 0, 0)
    cols = "req_id bigint, event_id bigint, ts timestamp, engine string, status int, err_msg string, content_type string, retry_after string, dur_ms bigint"

    def batch(rows, name):
        spark.createDataFrame(rows, cols).write.mode("append").parquet(src + "/" + name)

    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")

    def run():
        s = spark.readStream.schema(cols).parquet(src + "/*")
        q = stream_outcomes(s, window="1 hour", delay="2 hours").writeStream.format("parquet") \
            .option("path", out).option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()

    batch([(1, 1, base, "http", 200, None, None, None, 10), (2, 2, base + dt.timedelta(hours=5), "http", 200, None, None, None, 10)], "b1")
    run()
    batch([(3, 3, base + dt.timedelta(minutes=30), "http", 200, None, None, None, 10),  # late: behind 03:00
           (4, 4, base + dt.timedelta(hours=9), "http", 200, None, None, None, 10)], "b2")
    run()
    first = [r["attempts"] for r in spark.read.parquet(out).where(F.col("window_start") == F.lit(base)).collect()]
    assert first == [1]


def test_merge_fallback_one_pass_equals_join(spark):
    from conftest import SF_SMALL
    from webtide.sources.fixtures import Fixtures

    log = Fixtures(spark, SF_SMALL).fetch_log()
    both = O.final_outcome(log, DEFAULTS, jitter=False, req=["req_id", "engine"])
    one = O.merge_fallback_by_engine(both)
    http = O.final_outcome(log.where("engine = 'http'"), DEFAULTS, jitter=False)
    rend = O.final_outcome(log.where("engine = 'playwright'"), DEFAULTS, jitter=False)
    two = O.merge_fallback(http, rend)
    cols = ["req_id", "mode_used", "outcome", "status_code", "error_code", "attempts"]
    a = {tuple(r) for r in one.select(*cols).collect()}
    b = {tuple(r) for r in two.select(*cols).collect()}
    assert a and a == b


def test_nested_articles_and_quarantine_outputs(spark):
    from webtide.plans.articles import nest_articles

    pages = spark.createDataFrame([(1, "https://ex.com/p", '<html lang="en"><body><article><p>One two three</p></article></body></html>')],
                                  "page_id bigint, url string, html string")
    r = nest_articles(build_articles(pages)).collect()[0]
    assert r["meta"]["lang"] == "en" and r["meta"]["read_time_min"] == 1 and r["meta"]["raw_body"] is False
    assert r["error"] is None and r["body"] == "One two three"
    reqs = spark.createDataFrame([(1, "https://a.b/", "extractor", 5), (2, None, "bogus", 0)],
                                 "req_id int, url string, mode string, task_timeout_secs int")
    valid, invalid = G.quarantine(G.validate_page_requests(reqs))
    assert [x["req_id"] for x in valid.collect()] == [1]
    bad = invalid.collect()[0]
    assert (bad["req_id"], bad["error_code"], bad["error_message"], len(bad["details"])) == (2, 400, "Validation failed", 3)


def test_article_queries_keep_large_pages(spark):
    from webtide.plans.registry import all_queries

    sf = "/root/testdata/sf0.01"
    large = spark.read.parquet(f"{sf}/pages.parquet").where("octet_length(html) > 8192").select("page_id")
    rows = all_queries()["articles"](spark, sf).where("mode = 'playwright'").join(large, "page_id").collect()
    assert rows and not any(r.error_details == "Response too large" for r in rows)
    assert any(r.body and r.word_count for r in rows)


def test_streams_read_folders_of_part_files(spark, tmp_path):
    from webtide.plans.registry import all_queries

    small = "/root/testdata/sf0.001"
    for name in ("pages", "events"):
        spark.read.parquet(f"{small}/{name}.parquet").repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name in ("stream_articles", "stream_outcomes", "stream_quarantine", "stream_blocklist"):
        whole, parts = (sorted(map(repr, all_queries()[name](spark, sf).collect())) for sf in (small, str(tmp_path)))
        assert whole and whole == parts, name
