"""Registered gate / validation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import url_parts
from ..operators import gates as G
from ..operators.extraction import page_links
from ..session import pages_table, table
from ..sources.fixtures import Fixtures
from ..sources.readers import page_request_defaults

# cap used by the size gates on the page fixture (pages are 0.6–60 kB, so the
# default 10 MiB cap would never fire on them)
FIXTURE_CAP = 4096
PAYLOAD_SQL = """
select req_id,
  '{{"url": "u' || cast(req_id as string) || '", "mode": "extractor"' ||
  case req_id%3 when 0 then ', "proxy": true' when 1 then ', "fingerprint": {{}}, "cookies": 1' else '' end
  || '}}' as payload
from {reqs}
"""
ALLOWED_PAGE_FIELDS = ["url", "mode", "taskTimeoutSecs", "rawBody", "fingerprint"]


def _joined(c, sep="; "):
    return F.when(F.size(c) > 0, F.array_join(c, sep))


def q_request_defaults(spark: SparkSession, sf: str) -> DataFrame:
    r = page_request_defaults(Fixtures(spark, sf).page_requests())
    return r.select(
        "req_id", "url", "mode", "task_timeout_secs", "raw_body",
        F.array_join("block_list", "|").alias("block_list"), F.size("block_list").alias("n_blocked"),
    )


def _validated(df: DataFrame) -> DataFrame:
    return df.select("req_id", _joined(F.col("errors")).alias("errors"), F.size("errors").alias("n_errors"))


def q_validate_page_requests(spark: SparkSession, sf: str) -> DataFrame:
    return _validated(G.validate_page_requests(Fixtures(spark, sf).page_requests()))


def q_validate_fetch_requests(spark: SparkSession, sf: str) -> DataFrame:
    v = G.engine_not_supported(G.validate_fetch_requests(Fixtures(spark, sf).fetch_requests()))
    return v.select(
        "req_id", _joined(F.col("errors")).alias("errors"), F.size("errors").alias("n_errors"),
        "error_code", "error_message", "attempts", "retryable", "http_status",
    )


def q_validate_file_requests(spark: SparkSession, sf: str) -> DataFrame:
    return _validated(G.validate_file_requests(Fixtures(spark, sf).file_requests()))


def q_unknown_fields(spark: SparkSession, sf: str) -> DataFrame:
    p = spark.sql(PAYLOAD_SQL, reqs=Fixtures(spark, sf).page_requests())
    u = G.unknown_fields(p, "payload", ALLOWED_PAGE_FIELDS)
    return u.select("req_id", _joined(F.col("unknown")).alias("unknown"), F.size("unknown").alias("n_unknown"))


def q_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    v = G.quarantine_lanes(G.validate_page_requests(Fixtures(spark, sf).page_requests()))
    return v.select("req_id", "lane", "error_code", "error_message", _joined(F.col("errors")).alias("details"))


def _all_urls(spark: SparkSession, sf: str) -> DataFrame:
    fx = Fixtures(spark, sf)
    p = table(spark, sf, "pages").select(F.col("page_id").alias("url_id"), "url")
    q = fx.probe_urls().select((F.col("url_id") + F.lit(1_000_000_000)).alias("url_id"), "url")
    return p.unionByName(q)


def q_url_parts(spark: SparkSession, sf: str) -> DataFrame:
    u = _all_urls(spark, sf)
    parts = url_parts(F.col("url"))
    return u.select("url_id", *[c.alias(k) for k, c in parts.items()])


def q_scheme_gate(spark: SparkSession, sf: str) -> DataFrame:
    return G.scheme_gate(_all_urls(spark, sf)).select("url_id", "gate_message")


def q_ipv4_block(spark: SparkSession, sf: str) -> DataFrame:
    h = Fixtures(spark, sf).hosts()
    return G.ipv4_block(h, "host").select(
        "c_custkey", "host", "ip", F.col("ipv4_blocked_strict").alias("blocked"),
        F.col("ipv4_blocked_loopback_ok").alias("blocked_loopback_ok"),
    )


def q_ipv6_block(spark: SparkSession, sf: str) -> DataFrame:
    u = Fixtures(spark, sf).probe_urls().withColumn("host", url_parts(F.col("url"))["host"])
    return u.select(
        "url_id", "host",
        G.ipv6_blocked(F.col("host")).alias("blocked"),
        G.ipv6_blocked(F.col("host"), allow_loopback=True).alias("blocked_loopback_ok"),
    )


def q_url_gate(spark: SparkSession, sf: str) -> DataFrame:
    return G.url_gate(_all_urls(spark, sf)).select("url_id", "host", "gate_message")


def q_resolved_gate(spark: SparkSession, sf: str) -> DataFrame:
    fx = Fixtures(spark, sf)
    r = G.resolved_gate(fx.named_urls(), fx.resolved())
    return r.select("url_id", "host", F.col("n_addresses").cast("bigint").alias("n_addresses"), "resolve_message")


def q_content_type_gate(spark: SparkSession, sf: str) -> DataFrame:
    log = Fixtures(spark, sf).fetch_log()
    return G.content_type_gate(log).select("event_id", "content_type", "content_type_message")


def _responses(spark, sf):
    fx = Fixtures(spark, sf)
    return fx.responses()


def q_size_gate(spark: SparkSession, sf: str) -> DataFrame:
    r = G.size_gate(_responses(spark, sf), FIXTURE_CAP)
    return r.select("page_id", "declared_length", F.octet_length("html").cast("bigint").alias("n_bytes"), "size_message")


def q_status_class(spark: SparkSession, sf: str) -> DataFrame:
    r = _responses(spark, sf)
    return r.select("page_id", "status", "location", G.status_class(F.col("status"), F.col("location")).alias("status_class"))


def q_gate_order(spark: SparkSession, sf: str) -> DataFrame:
    return G.gate_order(_responses(spark, sf), FIXTURE_CAP).select("page_id", "engine", "verdict", "verdict_kind")


def q_empty_gate(spark: SparkSession, sf: str) -> DataFrame:
    r = _responses(spark, sf).withColumn(
        "body",
        F.when(F.col("page_id") % 10 == 3, F.lit("")).when(F.col("page_id") % 10 == 7, F.lit(None)).otherwise(F.col("html")),
    )
    return G.empty_gate(r, "body").select("page_id", "empty_message", "empty_code", "empty_http")


def q_header_request_clean(spark: SparkSession, sf: str) -> DataFrame:
    s = G.sanitize_request_headers(Fixtures(spark, sf).file_requests())
    return s.select(
        "req_id", "header_error",
        F.when(F.col("clean_headers").isNotNull(), F.size("clean_headers")).alias("n_kept"),
        F.array_join(F.array_sort(F.map_keys("clean_headers")), ",").alias("kept_names"),
    )


def q_header_response_clean(spark: SparkSession, sf: str) -> DataFrame:
    s = G.sanitize_response_headers(Fixtures(spark, sf).response_headers())
    return s.select(
        "page_id", F.size("clean_headers").alias("n_kept"),
        F.array_join(F.array_sort(F.map_keys("clean_headers")), ",").alias("kept_names"),
    )


def resource_suffix():
    return (
    F.when(F.col("pos") % 7 == 0, F.lit(".png")).when(F.col("pos") % 7 == 1, F.lit(".MP4"))
    .when(F.col("pos") % 7 == 2, F.lit(".woff2?v=1")).when(F.col("pos") % 7 == 3, F.lit(".css"))
    .when(F.col("pos") % 7 == 4, F.lit(".webm")).otherwise(F.lit(""))
    )


def q_heavy_resources(spark: SparkSession, sf: str) -> DataFrame:
    links = page_links(pages_table(spark, sf)).withColumn("href", F.concat("href", resource_suffix()))
    return G.heavy_resources(links).select("page_id", "pos", "href", "resource_class")


def tracker_inputs(spark: SparkSession, sf: str):
    pages = pages_table(spark, sf)
    links = page_links(pages).withColumn("host", url_parts(F.col("href"))["host"])
    host = url_parts(F.col("url"))["host"]
    bl = (
        table(spark, sf, "pages")
        .select("page_id", host.alias("h"))
        .select(
            F.when(F.col("page_id") % 7 == 0, F.col("h"))
            .when(F.col("page_id") % 11 == 0, F.regexp_extract("h", r"^[^.]+\.(.+\..+\..+)$", 1))
            .alias("domain")
        )
        .where(F.col("domain").isNotNull() & (F.col("domain") != ""))
    )
    return links, bl


def q_tracker_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    links, bl = tracker_inputs(spark, sf)
    return G.tracker_antijoin(links, bl).select("page_id", "pos", "host")


def q_route_engine(spark: SparkSession, sf: str) -> DataFrame:
    fx = Fixtures(spark, sf)
    p = G.route_engine(fx.page_requests(), "page").select(F.lit("page").alias("kind"), "req_id", "effective_engine", "route")
    f = G.route_engine(fx.fetch_requests(), "fetch").select(F.lit("fetch").alias("kind"), "req_id", "effective_engine", "route")
    fi = G.route_engine(fx.file_requests(), "file").select(F.lit("file").alias("kind"), "req_id", "effective_engine", "route")
    return p.unionByName(f).unionByName(fi)


QUERIES = {
    "request_defaults": q_request_defaults,
    "validate_page_requests": q_validate_page_requests,
    "validate_fetch_requests": q_validate_fetch_requests,
    "validate_file_requests": q_validate_file_requests,
    "unknown_fields": q_unknown_fields,
    "quarantine": q_quarantine,
    "url_parts": q_url_parts,
    "scheme_gate": q_scheme_gate,
    "ipv4_block": q_ipv4_block,
    "ipv6_block": q_ipv6_block,
    "url_gate": q_url_gate,
    "resolved_gate": q_resolved_gate,
    "content_type_gate": q_content_type_gate,
    "size_gate": q_size_gate,
    "status_class": q_status_class,
    "gate_order": q_gate_order,
    "empty_gate": q_empty_gate,
    "header_request_clean": q_header_request_clean,
    "header_response_clean": q_header_response_clean,
    "heavy_resources": q_heavy_resources,
    "tracker_antijoin": q_tracker_antijoin,
    "route_engine": q_route_engine,
}
