"""Gates and validation.

A gate is a column expression that yields the rejection message (NULL when
the row passes), so gates compose with ``coalesce`` in the reference's
order and split a table into accepted rows and dead letters with two
filters over one plan. Everything is narrow except B10 (one join by host)
and the shuffle fallback of B19.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import patterns as P
from ..functions.text import trim_ws
from ..functions.urls import canonical_host, ipv4_to_long, strip_brackets, url_parts, valid_port
from ..plans.joins import BROADCAST_MAX_ROWS, has_at_most


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _errors(*checks: Column) -> Column:
    """ARRAY<STRING> of the failed checks' messages, in order."""
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


# --- B1–B5 request validation -----------------------------------------------------

# URL shape accepted by the request validator: scheme optional (http, https,
# ftp), TLD not required, no underscores, no blanks.
URL_SHAPE_RE = (
    r"^(?:(?i:https?|ftp)://)?(?:[^/?#@ ]+@)?"
    r"(?:\[[0-9A-Fa-f:.]+\]|[A-Za-z0-9\x{00A1}-\x{FFFF}](?:[A-Za-z0-9\x{00A1}-\x{FFFF}.\-]*[A-Za-z0-9\x{00A1}-\x{FFFF}])?)"
    r"(?::[0-9]{1,5})?(?:[/?#][^ ]*)?$"
)


#: Longest URL that a request may have (a rule of this engine, as browsers
#: and validators commonly have it).
MAX_URL_CHARS = 2083


def url_message(c: Column, name: str = "url") -> Column:
    return F.when(c.isNull() | ~c.rlike(URL_SHAPE_RE) | (F.length(c) > MAX_URL_CHARS), F.lit(f"{name} must be a URL address"))


def one_of_message(c: Column, name: str, allowed: list[str], optional: bool = True) -> Column:
    bad = ~c.isin(*allowed)
    if not optional:
        bad = c.isNull() | bad
    return F.when(bad, F.lit(f"{name} must be one of the following values: {', '.join(allowed)}"))


def min1_message(c: Column, name: str) -> Column:
    return F.when(c < 1, F.lit(f"{name} must not be less than 1"))


def validate_page_requests(df: DataFrame) -> DataFrame:
    """Adds ``errors``: url required and URL-shaped (no scheme or TLD
    needed), mode ∈ {extractor, playwright}, task timeout ≥ 1."""
    return df.withColumn(
        "errors",
        _errors(
            url_message(F.col("url")),
            one_of_message(F.col("mode"), "mode", P.PAGE_MODES),
            min1_message(F.col("task_timeout_secs"), "taskTimeoutSecs"),
        ),
    )


def validate_fetch_requests(df: DataFrame) -> DataFrame:
    """engine is required; timeout ≥ 1 when given."""
    return df.withColumn(
        "errors",
        _errors(
            url_message(F.col("url")),
            one_of_message(F.col("engine"), "engine", P.FETCH_ENGINES, optional=False),
            min1_message(F.col("timeout_secs"), "timeoutSecs"),
        ),
    )


def engine_not_supported(df: DataFrame) -> DataFrame:
    """Service-level answer for an engine outside the list (when validation
    is bypassed): code, message, attempts 1, not retryable, HTTP 400."""
    bad = ~F.coalesce(F.col("engine").isin(*P.FETCH_ENGINES), F.lit(False))
    return df.withColumn("error_code", F.when(bad, F.lit("FETCH_ENGINE_NOT_SUPPORTED"))).withColumn(
        "error_message", F.when(bad, F.lit("Engine is not supported"))
    ).withColumn("attempts", F.when(bad, F.lit(1))).withColumn(
        "retryable", F.when(bad, F.lit(False))
    ).withColumn("http_status", F.when(bad, F.lit(400)))


def validate_file_requests(df: DataFrame) -> DataFrame:
    """mode ∈ {auto, http, playwright}; timeout, max_bytes ≥ 1; header map
    values must all be strings (a NULL value is not)."""
    hdr = F.col("headers")
    bad_headers = F.when(
        hdr.isNotNull() & F.exists(F.map_values(hdr), lambda v: v.isNull()),
        F.lit("headers must be an object with string values"),
    )
    return df.withColumn(
        "errors",
        _errors(
            url_message(F.col("url")),
            one_of_message(F.col("mode"), "mode", P.FILE_MODES),
            min1_message(F.col("timeout_secs"), "timeoutSecs") if "timeout_secs" in df.columns else F.lit(None).cast("string"),
            min1_message(F.col("max_bytes"), "maxBytes"),
            bad_headers,
        ),
    )


def unknown_fields(df: DataFrame, json_col: str, allowed: list[str]) -> DataFrame:
    """Adds ``unknown``: keys of a JSON payload outside the declared
    fields, each as 'property X should not exist'."""
    keys = F.json_object_keys(F.col(json_col))
    extra = F.filter(keys, lambda k: ~k.isin(*allowed))
    return df.withColumn("unknown", F.transform(extra, lambda k: F.concat(F.lit("property "), k, F.lit(" should not exist"))))


def quarantine(df: DataFrame, errors: str = "errors") -> tuple[DataFrame, DataFrame]:
    """(valid, invalid); invalid rows get the 400 'Validation failed'
    envelope with the messages as details."""
    bad = F.size(F.col(errors)) > 0
    valid = df.where(~bad)
    invalid = df.where(bad).withColumn("error_code", F.lit(400)).withColumn(
        "error_message", F.lit("Validation failed")
    ).withColumn("details", F.col(errors))
    return valid, invalid


def quarantine_lanes(df: DataFrame, errors: str = "errors") -> DataFrame:
    """Single-plan form of ``quarantine``: a ``lane`` column instead of two
    outputs."""
    bad = F.size(F.col(errors)) > 0
    return df.withColumn("lane", F.when(bad, F.lit("invalid")).otherwise(F.lit("valid"))).withColumn(
        "error_code", F.when(bad, F.lit(400))
    ).withColumn("error_message", F.when(bad, F.lit("Validation failed")))


def gate_lanes(df: DataFrame, resolved: DataFrame, allowed: list[str], max_bytes: int = DEFAULTS.max_response_bytes) -> DataFrame:
    """B1–B15 in the reference's order, first failure wins. Rows are page
    requests (url, mode, task_timeout_secs, payload as JSON) with what came
    back for them (engine, status, location, content_type, declared_length,
    html; no status: nothing was fetched yet).

    Adds ``lane`` (valid, redirect or invalid), ``gate`` (the gate that
    failed), ``error_code``, ``error_message`` and ``details``. Validation
    fails with 400 and its messages; a gate on the URL or the response with
    the code of its message. ``resolved`` is static, so ``df`` may be a
    stream. The gates on a response are not evaluated for rows that an
    earlier gate has stopped."""
    from .outcomes import fetch_error_code

    v = unknown_fields(validate_page_requests(df), "payload", allowed).withColumn("errors", F.concat("errors", F.coalesce("unknown", F.array().cast("array<string>"))))
    v = v.withColumn("_host", strip_brackets(canonical_host(url_parts(F.col("url"))["host"])))
    v = with_address_blocked(v, "_host", "_blocked")
    v = resolved_gate(v, resolved).drop("n_addresses", "host")
    bad = F.size("errors") > 0
    fetched = F.col("status").isNotNull()
    rendered = F.col("engine") == "playwright"
    empty = F.when(rendered & (F.col("html").isNull() | (F.col("html") == "")), F.lit(EMPTY_RENDERED))
    status = F.when(F.when(rendered, F.col("status").isin(403, 429)).otherwise(~F.col("status").between(200, 299)), F.concat(F.lit("HTTP status "), F.col("status").cast("string")))
    declared = F.when(~rendered, F.col("declared_length"))
    checks = [
        ("B1", F.when(bad, F.lit("Validation failed"))),
        ("B7", scheme_gate_message(F.col("url"))),
        ("B8", F.when(F.col("_blocked"), F.lit("SSRF blocked"))),
        ("B10", F.col("resolve_message")),
        ("B13", F.when(fetched & ~rendered & (status_class(F.col("status"), F.col("location")) == "redirect"), F.lit("redirect"))),
        ("B15", F.when(fetched, empty)),
        ("B11", F.when(fetched & ~rendered, content_type_message(F.col("content_type")))),
        ("B12", F.when(fetched, size_message(declared, F.col("html"), max_bytes))),
        ("B14", F.when(fetched, status)),
    ]
    first = F.coalesce(*[F.when(m.isNotNull(), F.struct(F.lit(g).alias("gate"), m.alias("message"))) for g, m in checks])
    out = v.withColumn("_first", first)
    stopped = F.col("_first").isNotNull()
    redirect = F.col("_first.gate") == "B13"
    mapped = fetch_error_code(F.col("_first.message"), F.when(F.col("_first.gate") == "B14", F.col("status")))
    unknown = bad & (F.size("unknown") > 0) & (F.size("errors") == F.size("unknown"))
    return out.withColumns({
        "lane": F.when(redirect, F.lit("redirect")).when(stopped, F.lit("invalid")).otherwise(F.lit("valid")),
        "gate": F.when(unknown, F.lit("B4")).otherwise(F.col("_first.gate")),
        "error_code": F.when(stopped & ~redirect, F.when(bad, F.lit("VALIDATION")).otherwise(mapped["code"])),
        "error_message": F.when(stopped & ~redirect, F.when(bad, F.lit("Validation failed")).otherwise(mapped["message"])),
        "details": F.when(bad, F.array_join("errors", "; ")),
    }).drop("_first", "_host", "_blocked", "resolve_message", "errors", "unknown")


# --- B6–B10 URL gates ----------------------------------------------------------------


def scheme_gate_message(url: Column) -> Column:
    """'Invalid URL' when unparseable (a host that no parser accepts and a
    port over 65535 included), 'Unsupported URL protocol' when the scheme is
    not http(s); NULL when it passes."""
    parts = url_parts(url)
    return (
        F.when(parts["scheme"].isNull() | parts["host"].isNull() | ~valid_port(parts["port"]), F.lit("Invalid URL"))
        .when(canonical_host(parts["host"]).isNull(), F.lit("Invalid URL"))
        .when(~parts["scheme"].isin(*P.ALLOWED_SCHEMES), F.lit("Unsupported URL protocol"))
    )


def scheme_gate(df: DataFrame, url: str = "url") -> DataFrame:
    return df.withColumn("gate_message", scheme_gate_message(F.col(url)))


#: Rows of a deny table: a table beyond that is refused, not cut.
MAX_DENY_RANGES = 10_000


def _deny_literals(ranges: DataFrame | None) -> list[tuple[int, int, bool]]:
    """The deny table as (lo, hi, loopback), read once behind its bound."""
    if ranges is None:
        return [(_ipv4_number(lo), _ipv4_number(hi), lb) for lo, hi, lb in P.BLOCKED_IPV4_RANGES]
    rows = ranges.select("lo", "hi", "loopback").limit(MAX_DENY_RANGES + 1).collect()
    if len(rows) > MAX_DENY_RANGES:
        raise ValueError(f"a deny table has at most {MAX_DENY_RANGES} ranges")
    return [tuple(r) for r in rows]


def _ipv4_number(ip: str) -> int:
    a, b, c, d = (int(x) for x in ip.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def in_ranges(ip: Column, ranges: list[tuple[int, int]]) -> Column:
    """Whether ``ip`` is in one of the ranges, which may overlap: merged and
    sorted, then searched by halves. NULL is in none."""
    merged: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if merged and lo <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], hi)
        else:
            merged.append([lo, hi])

    def among(some: list[list[int]]) -> Column:
        """Nested comparisons, halving the ranges each time."""
        if len(some) <= 4:
            cond = F.lit(False)
            for lo, hi in some:
                cond = cond | ip.between(lo, hi)
            return cond
        half = len(some) // 2
        return F.when(ip < some[half][0], among(some[:half])).otherwise(among(some[half:]))

    return F.coalesce(among(merged), F.lit(False))


def ipv4_block(df: DataFrame, host: str = "host", allow_loopback: bool = False, ranges: DataFrame | None = None) -> DataFrame:
    """Adds ``ip`` (BIGINT), ``ipv4_blocked`` (under ``allow_loopback``)
    and ``ipv4_blocked_strict`` / ``ipv4_blocked_loopback_ok``: the host is
    an IPv4 literal inside a deny range. No join: the small deny table
    becomes part of the expression, and overlapping ranges cost nothing."""
    deny = _deny_literals(ranges)
    out = df.withColumn("ip", ipv4_to_long(canonical_host(F.col(host))))
    strict = in_ranges(F.col("ip"), [(lo, hi) for lo, hi, _ in deny])
    loose = in_ranges(F.col("ip"), [(lo, hi) for lo, hi, lb in deny if not lb])
    return (
        out.withColumn("ipv4_blocked_strict", strict)
        .withColumn("ipv4_blocked_loopback_ok", loose)
        .withColumn("ipv4_blocked", loose if allow_loopback else strict)
    )


def ipv6_blocked(host: Column, allow_loopback: bool = False) -> Column:
    h = F.regexp_replace(F.lower(strip_brackets(host)), P.IPV6_LEADING_ZEROS_RE, "$1$2")
    loop = h.rlike(P.IPV6_LOOPBACK_RE)
    pref = h.contains(":") & h.rlike(P.IPV6_BLOCKED_PREFIX_RE)
    return pref if allow_loopback else (loop | pref)


def ipv6_block(df: DataFrame, host: str = "host", allow_loopback: bool = False) -> DataFrame:
    return df.withColumn("ipv6_blocked", ipv6_blocked(F.col(host), allow_loopback))


def url_gate(df: DataFrame, url: str = "url", allow_loopback: bool = False) -> DataFrame:
    """B7 → B8 → B9 on literal hosts: adds host and ``gate_message``."""
    parts = url_parts(F.col(url))
    out = df.withColumn("host", parts["host"])
    out = ipv4_block(out, "host", allow_loopback).drop("ipv4_blocked_strict", "ipv4_blocked_loopback_ok")
    out = out.withColumn(
        "gate_message",
        F.coalesce(
            scheme_gate_message(F.col(url)),
            F.when(F.col("ipv4_blocked") | ipv6_blocked(F.col("host"), allow_loopback), F.lit("SSRF blocked")),
        ),
    )
    return out.drop("ipv4_blocked")


def with_address_blocked(df: DataFrame, addr: str, out: str = "blocked", allow_loopback: bool = False) -> DataFrame:
    """Blocked state of an address column (IPv4 deny ranges or the IPv6
    rules); the IPv4 value is materialised once, then range-tested."""
    df = df.withColumn("_ip", ipv4_to_long(F.col(addr)))
    a = F.col(addr)
    return df.withColumn(
        out, in_ranges(F.col("_ip"), [(lo, hi) for lo, hi, lb in _deny_literals(None) if not (allow_loopback and lb)]) | (a.contains(":") & ipv6_blocked(a, allow_loopback))
    ).drop("_ip")


def resolved_gate(urls: DataFrame, resolved: DataFrame, url: str = "url", allow_loopback: bool = False) -> DataFrame:
    """For hostnames (not IP literals): no address → 'DNS lookup failed';
    any blocked address → 'SSRF blocked'. ``resolved`` is (host, address).

    The address table is reduced to one row per host (map-side partial
    aggregation) before it meets the URLs, so a host with millions of
    addresses costs one row in the join."""
    per_host = (
        with_address_blocked(resolved.select(F.lower("host").alias("host"), "address"), "address", "b", allow_loopback)
        .groupBy("host")
        .agg(F.count(F.lit(1)).alias("n_addresses"), F.max(F.col("b").cast("int")).alias("any_blocked"))
    )
    u = urls.withColumn("host", canonical_host(url_parts(F.col(url))["host"]))
    literal = F.col("host").rlike(P.IPV4_RE) | F.col("host").startswith("[")
    out = u.join(per_host, "host", "left")
    msg = (
        F.when(literal | F.col("host").isNull(), F.lit(None).cast("string"))
        .when(F.col("n_addresses").isNull(), F.lit("DNS lookup failed"))
        .when(F.col("any_blocked") == 1, F.lit("SSRF blocked"))
    )
    return out.withColumn("resolve_message", msg).drop("any_blocked")


# --- B11–B15 response gates -----------------------------------------------------------


def normalized_content_type(ct: Column) -> Column:
    return trim_ws(F.split(F.lower(ct), ";").getItem(0))


def content_type_message(ct: Column) -> Column:
    """'Unsupported content type: X' unless the normalised type starts with
    an allowed prefix; missing or '' passes."""
    norm = normalized_content_type(ct)
    ok = F.lit(False)
    for p in P.ALLOWED_CONTENT_TYPE_PREFIXES:
        ok = ok | norm.startswith(p)
    return F.when(ct.isNull() | (ct == ""), F.lit(None).cast("string")).when(
        ~ok, F.concat(F.lit("Unsupported content type: "), norm)
    )


def content_type_gate(df: DataFrame, ct: str = "content_type") -> DataFrame:
    return df.withColumn("content_type_message", content_type_message(F.col(ct)))


NUMERIC_RE = r"^[0-9]+(\.[0-9]+)?$"


def declared_length(v: Column) -> Column:
    """Declared Content-Length as DOUBLE; invalid → NULL (hex and exponent
    forms are treated as invalid)."""
    t = trim_ws(v)
    return F.when(t.rlike(NUMERIC_RE), t.cast("double")).when(t == "", F.lit(0.0))


def size_message(declared: Column, body: Column, max_bytes: int | Column, body_bytes: Column | None = None) -> Column:
    """Declared length over the cap rejects; else the UTF-8 byte length of
    the body over the cap rejects. Strictly greater: equal passes. A stored
    byte length (``body_bytes``) replaces ``octet_length`` when given."""
    cap = max_bytes if isinstance(max_bytes, Column) else F.lit(int(max_bytes))
    n = body_bytes if body_bytes is not None else F.octet_length(body)
    return F.when((declared_length(declared) > cap) | (n > cap), F.lit("Response too large"))


def size_gate(df: DataFrame, max_bytes: int = DEFAULTS.max_response_bytes,
              declared: str = "declared_length", body: str = "html", stored_length: str | None = None) -> DataFrame:
    """Adds ``size_message``. With ``stored_length`` (a column holding the
    body's byte length, e.g. written next to the html) the test reads that
    column, so a later ``size_message IS NULL`` filter on a stored length
    can be pushed into the Parquet scan."""
    d = F.col(declared) if declared in df.columns else F.lit(None).cast("string")
    n = F.col(stored_length) if stored_length else None
    return df.withColumn("size_message", size_message(d, F.col(body), max_bytes, n))


def within_size_cap(df: DataFrame, stored_length: str, max_bytes: int = DEFAULTS.max_response_bytes) -> DataFrame:
    """Rows whose stored byte length fits the cap, as a plain comparison the
    Parquet reader evaluates against row-group statistics."""
    return df.where(F.col(stored_length) <= F.lit(int(max_bytes)))


def status_class(status: Column, location: Column) -> Column:
    """redirect (3xx with a location) / ok (2xx) / http_error (the rest,
    304 and 3xx without location included)."""
    return (
        F.when(status.between(300, 399) & location.isNotNull() & (location != ""), F.lit("redirect"))
        .when(status.between(200, 299), F.lit("ok"))
        .otherwise(F.lit("http_error"))
    )


EMPTY_RENDERED = "Fetch resulted in empty response"


def verdict(engine: Column, status: Column, location: Column, ct: Column, declared: Column,
            body: Column, max_bytes: int = DEFAULTS.max_response_bytes) -> Column:
    """Message of the first failing gate on one response, in the reference's
    order (NULL = success, 'redirect' = follow the location).

    http: redirect → content type → size → status.
    rendered: empty → size → 403/429 (other statuses are success)."""
    http = F.coalesce(
        F.when(status_class(status, location) == "redirect", F.lit("redirect")),
        content_type_message(ct),
        size_message(declared, body, max_bytes),
        F.when(~status.between(200, 299), F.concat(F.lit("HTTP status "), status.cast("string"))),
    )
    rendered = F.coalesce(
        F.when(body.isNull() | (body == ""), F.lit(EMPTY_RENDERED)),
        size_message(F.lit(None).cast("string"), body, max_bytes),
        F.when(status.isin(403, 429), F.concat(F.lit("HTTP status "), status.cast("string"))),
    )
    return F.when(engine == "playwright", rendered).otherwise(http)


def gate_order(df: DataFrame, max_bytes: int = DEFAULTS.max_response_bytes) -> DataFrame:
    """Adds ``verdict`` and ``verdict_kind`` (redirect / error / ok)."""
    v = verdict(
        F.col("engine"), F.col("status"), F.col("location"), F.col("content_type"),
        F.col("declared_length"), F.col("html"), max_bytes,
    )
    return df.withColumn("verdict", v).withColumn(
        "verdict_kind",
        F.when(F.col("verdict").isNull(), F.lit("ok"))
        .when(F.col("verdict") == "redirect", F.lit("redirect"))
        .otherwise(F.lit("error")),
    )


def empty_gate(df: DataFrame, body: str = "html", rendered: bool = True) -> DataFrame:
    """Rendered empty content → error message; an absent body (file proxy)
    → FILE_EMPTY_RESPONSE / 502."""
    b = F.col(body)
    return df.withColumn(
        "empty_message",
        F.when(b.isNull(), F.lit("Upstream returned empty body")).when(
            F.lit(rendered) & (b == ""), F.lit(EMPTY_RENDERED)
        ),
    ).withColumn("empty_code", F.when(b.isNull(), F.lit("FILE_EMPTY_RESPONSE"))).withColumn(
        "empty_http", F.when(b.isNull(), F.lit(502)).when(F.lit(rendered) & (b == ""), F.lit(502))
    )


# --- B16 / B17 headers -------------------------------------------------------------------


def request_header_error(headers: Column) -> Column:
    """First error of the request-header sanitiser, in entry order
    (hop-by-hop checked first, so proxy-auth headers are dropped, not
    rejected)."""
    def entry_error(e):
        k = e["key"]
        lk = F.lower(k)
        v = e["value"]
        return (
            F.when(lk.isin(*P.HOP_BY_HOP_HEADERS), F.lit(None).cast("string"))
            .when(lk.isin(*P.FORBIDDEN_REQUEST_HEADERS), F.concat(F.lit("Forbidden header: "), k))
            .when(lk.isin(*P.DROPPED_REQUEST_HEADERS) | v.isNull(), F.lit(None).cast("string"))
            .when(F.length(k) > P.MAX_HEADER_NAME_LENGTH, F.lit("Header name too long"))
            .when(F.length(v) > P.MAX_HEADER_VALUE_LENGTH, F.lit("Header value too long"))
        )

    errs = F.filter(F.transform(F.map_entries(headers), entry_error), lambda x: x.isNotNull())
    return F.when(headers.isNull(), F.lit(None).cast("string")).when(
        F.size(headers) > P.MAX_REQUEST_HEADERS, F.lit("Too many headers")
    ).otherwise(F.get(errs, 0))


def clean_request_headers(headers: Column) -> Column:
    return F.map_filter(
        headers,
        lambda k, v: ~F.lower(k).isin(*(P.HOP_BY_HOP_HEADERS + P.DROPPED_REQUEST_HEADERS)) & v.isNotNull(),
    )


def sanitize_request_headers(df: DataFrame, headers: str = "headers") -> DataFrame:
    h = F.col(headers)
    return df.withColumn("header_error", request_header_error(h)).withColumn(
        "clean_headers", F.when(F.col("header_error").isNull(), F.coalesce(clean_request_headers(h), F.create_map()))
    )


def sanitize_response_headers(df: DataFrame, headers: str = "headers") -> DataFrame:
    """Drop hop-by-hop and set-cookie (case-insensitive), keep original key
    case and everything else (content-encoding included)."""
    drop = P.HOP_BY_HOP_HEADERS + P.DROPPED_RESPONSE_HEADERS
    return df.withColumn("clean_headers", F.map_filter(F.col(headers), lambda k, v: ~F.lower(k).isin(*drop)))


# --- B18–B20 resources, trackers, routing -----------------------------------------------------

HEAVY_EXT_RE = r"\.([A-Za-z0-9]+)$"


def heavy_resource_class(url: Column) -> Column:
    """'image_font' / 'media' when the URL ends with a blocked extension
    (case-sensitive glob on the whole URL), else NULL."""
    ext = F.regexp_extract(url, HEAVY_EXT_RE, 1)
    return F.when(ext.isin(*P.HEAVY_IMAGE_FONT_EXTS), F.lit("image_font")).when(
        ext.isin(*P.HEAVY_MEDIA_EXTS), F.lit("media")
    )


def heavy_resources(links: DataFrame, url: str = "href") -> DataFrame:
    return links.withColumn("resource_class", heavy_resource_class(F.col(url)))


def domain_depths(blocklist: DataFrame, domain: str) -> list[int]:
    """The numbers of labels that listed domains have (at most 127 rows)."""
    depth = F.size(F.split(F.col(domain), r"\."))
    return sorted(r[0] for r in blocklist.select(depth).distinct().collect())


def tracker_antijoin(links: DataFrame, blocklist: DataFrame, host: str = "host",
                     domain: str = "domain", max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Drop rows whose host or any parent domain is in ``blocklist``; a null
    host is never dropped. ``links`` may be a stream.

    One anti-join for each depth that listed domains have: the host's last
    k labels against the domains of k labels. The depths come from the list,
    so the links are read once. The list is stored once; when a bounded
    count shows it to be small it is broadcast and links never shuffle, else
    Spark picks the join. Either way the same rows stay."""
    from ..session import cut_lineage

    listed = cut_lineage(blocklist.select(F.lower(F.col(domain)).alias("_d")).where("_d is not null").distinct())
    small = has_at_most(listed, max_rows)
    labels = F.split(F.lower(F.col(host)), r"\.")
    out = links
    for k in domain_depths(listed, "_d"):
        of_k = listed.where(F.size(F.split("_d", r"\.")) == k)
        suffix = F.when(F.size(labels) >= k, F.array_join(F.slice(labels, -k, k), "."))
        out = out.withColumn("_k", suffix).join(F.broadcast(of_k) if small else of_k, F.col("_k") == F.col("_d"), "left_anti").drop("_k")
    return out


def route_engine(df: DataFrame, kind: str) -> DataFrame:
    """Effective engine per request: page mode (missing/'' → extractor),
    fetch engine as given, file mode (missing → auto; auto starts as http).
    ``route`` is 'static' or 'browser'."""
    if kind == "page":
        eff = F.coalesce(F.when(F.col("mode") != "", F.col("mode")), F.lit(DEFAULTS.default_page_mode))
    elif kind == "fetch":
        eff = F.col("engine")
    else:
        m = F.coalesce(F.col("mode"), F.lit(DEFAULTS.default_file_mode))
        eff = F.when(m == "auto", F.lit("http")).otherwise(m)
    return df.withColumn("effective_engine", eff).withColumn(
        "route",
        F.when(eff == "playwright", F.lit("browser")).when(eff.isin("extractor", "http"), F.lit("static")),
    )
