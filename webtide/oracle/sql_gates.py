"""DuckDB oracle SQL for the gate and validation queries (A2, B*)."""

from __future__ import annotations

from ..functions import patterns as P
from ..operators.gates import HEAVY_EXT_RE, NUMERIC_RE, URL_SHAPE_RE
from ..plans.queries_gates import ALLOWED_PAGE_FIELDS, FIXTURE_CAP, PAYLOAD_SQL
from ..sources.fixtures import duck_ctes
from . import duck as d
from .sql_pages import page_links_sql

RESPONSE_HEADERS_DUCK = """
select page_id,
  map(['Content-Type', 'Content-Encoding', 'Set-Cookie', 'Connection', 'X-Page', 'Transfer-Encoding', 'ETag'],
      ['text/html', case when page_id%2=0 then 'gzip' else 'br' end, 'sid=' || cast(page_id as varchar),
       'keep-alive', cast(page_id as varchar), 'chunked', 'W/"' || cast(page_id%13 as varchar) || '"']) as headers
from pages where page_id%3 <> 0
union all
select page_id, map(['SET-COOKIE', 'Vary'], ['a=1', 'Accept']) as headers from pages where page_id%3 = 0
"""


def _in(x: str, items: list[str]) -> str:
    return f"{x} in (" + ", ".join(d.lit(i) for i in items) + ")"


def _errs(*checks: str) -> str:
    return "list_filter([" + ", ".join(checks) + "], lambda x: x is not null)"


def _joined(e: str) -> str:
    return f"(case when len({e}) > 0 then array_to_string({e}, '; ') end)"


def url_msg(c: str, name: str = "url") -> str:
    return (f"(case when {c} is null or not regexp_matches({c}, {d.lit(URL_SHAPE_RE)}) or length({c}) > 2083 "
            f"then {d.lit(name + ' must be a URL address')} end)")


def one_of(c: str, name: str, allowed: list[str], optional: bool = True) -> str:
    msg = d.lit(f"{name} must be one of the following values: {', '.join(allowed)}")
    bad = f"not ({_in(c, allowed)})"
    if not optional:
        bad = f"{c} is null or {bad}"
    return f"(case when {bad} then {msg} end)"


def min1(c: str, name: str) -> str:
    return f"(case when {c} < 1 then {d.lit(name + ' must not be less than 1')} end)"


def request_defaults_sql() -> str:
    bl = "list_filter(list_transform(string_split(coalesce(block_list, ''), ','), lambda x: trim(x)), lambda x: x <> '')"
    return duck_ctes("page_requests") + f"""
select req_id, url,
  coalesce(case when mode <> '' then mode end, 'extractor') as mode,
  cast(coalesce(case when task_timeout_secs <> 0 then task_timeout_secs end, 60) as integer) as task_timeout_secs,
  coalesce(raw_body = true, false) as raw_body,
  array_to_string({bl}, '|') as block_list, cast(len({bl}) as integer) as n_blocked
from page_requests
"""


def validate_page_sql() -> str:
    e = _errs(url_msg("url"), one_of("mode", "mode", P.PAGE_MODES), min1("task_timeout_secs", "taskTimeoutSecs"))
    return duck_ctes("page_requests") + f"select req_id, {_joined(e)} as errors, cast(len({e}) as integer) as n_errors from page_requests"


def validate_fetch_sql() -> str:
    e = _errs(url_msg("url"), one_of("engine", "engine", P.FETCH_ENGINES, optional=False), min1("timeout_secs", "timeoutSecs"))
    bad = f"not coalesce({_in('engine', P.FETCH_ENGINES)}, false)"
    return duck_ctes("fetch_requests") + f"""
select req_id, {_joined(e)} as errors, cast(len({e}) as integer) as n_errors,
  case when {bad} then 'FETCH_ENGINE_NOT_SUPPORTED' end as error_code,
  case when {bad} then 'Engine is not supported' end as error_message,
  case when {bad} then 1 end as attempts,
  case when {bad} then false end as retryable,
  case when {bad} then 400 end as http_status
from fetch_requests
"""


def validate_file_sql() -> str:
    hdr = ("(case when headers is not null and len(list_filter(map_values(headers), lambda v: v is null)) > 0 "
           "then 'headers must be an object with string values' end)")
    e = _errs(url_msg("url"), one_of("mode", "mode", P.FILE_MODES), min1("max_bytes", "maxBytes"), hdr)
    return duck_ctes("file_requests") + f"select req_id, {_joined(e)} as errors, cast(len({e}) as integer) as n_errors from file_requests"


def unknown_fields_sql() -> str:
    allowed = "[" + ", ".join(d.lit(a) for a in ALLOWED_PAGE_FIELDS) + "]"
    u = f"list_transform(list_filter(json_keys(payload), lambda k: not list_contains({allowed}, k)), lambda k: 'property ' || k || ' should not exist')"
    payload = PAYLOAD_SQL.format(reqs="page_requests").replace("as string", "as varchar")
    return duck_ctes("page_requests") + f", p as ({payload}) select req_id, {_joined(u)} as unknown, cast(len({u}) as integer) as n_unknown from p"


def quarantine_sql() -> str:
    e = _errs(url_msg("url"), one_of("mode", "mode", P.PAGE_MODES), min1("task_timeout_secs", "taskTimeoutSecs"))
    return duck_ctes("page_requests") + f"""
select req_id, case when len({e}) > 0 then 'invalid' else 'valid' end as lane,
  case when len({e}) > 0 then 400 end as error_code,
  case when len({e}) > 0 then 'Validation failed' end as error_message,
  {_joined(e)} as details
from page_requests
"""


ALL_URLS = "all_urls as (select page_id as url_id, url from pages union all select url_id + 1000000000 as url_id, url from probe_urls)"


def url_parts_sql() -> str:
    cols = [f"lower({d.url_part('url', 1)}) as scheme", f"lower({d.url_part('url', 3)}) as host"] + [
        f"{d.url_part('url', i)} as {n}" for i, n in [(4, "port"), (5, "path"), (6, "query"), (7, "fragment")]
    ]
    return duck_ctes("probe_urls") + f", {ALL_URLS} select url_id, {', '.join(cols)} from all_urls"


def scheme_msg(u: str) -> str:
    scheme = f"lower({d.url_part(u, 1)})"
    host, port = d.url_part(u, 3), d.url_part(u, 4)
    return (f"(case when {scheme} is null or {host} is null or coalesce(try_cast({port} as integer), case when {port} is null then 0 else 65536 end) > 65535 "
            f"then 'Invalid URL' when {d.canonical_host(host)} is null then 'Invalid URL' "
            f"when {scheme} not in ('http', 'https') then 'Unsupported URL protocol' end)")


def scheme_gate_sql() -> str:
    return duck_ctes("probe_urls") + f", {ALL_URLS} select url_id, {scheme_msg('url')} as gate_message from all_urls"


def strip_br(h: str) -> str:
    return f"regexp_replace({h}, '^\\[|\\]$', '', 'g')"


def ipv4_long(h: str) -> str:
    p = [f"cast(regexp_extract(h4, {d.lit(P.IPV4_RE)}, {i}) as bigint)" for i in range(1, 5)]
    valid = " and ".join(f"{x} <= 255" for x in p)
    one = (f"(case when regexp_matches(h4, {d.lit(P.IPV4_RE)}) then (case when {valid} then "
           f"{p[0]} * 16777216 + {p[1]} * 65536 + {p[2]} * 256 + {p[3]} end) end)")
    return d.bound(h, one, "h4")


def _ip_num(ip: str) -> int:
    a = [int(x) for x in ip.split(".")]
    return ((a[0] * 256 + a[1]) * 256 + a[2]) * 256 + a[3]


def v4_blocked(ip: str, allow_loopback: bool = False) -> str:
    conds = [f"(i4 between {_ip_num(lo)} and {_ip_num(hi)})" for lo, hi, lb in P.BLOCKED_IPV4_RANGES
             if not (allow_loopback and lb)]
    return "coalesce(" + d.bound(ip, " or ".join(conds), "i4") + ", false)"


def v6_blocked(h: str, allow_loopback: bool = False) -> str:
    x = rf"regexp_replace(lower({strip_br(h)}), {d.lit(P.IPV6_LEADING_ZEROS_RE)}, '\1\2', 'g')"
    pref = f"(contains({x}, ':') and regexp_matches({x}, {d.lit(P.IPV6_BLOCKED_PREFIX_RE)}))"
    return pref if allow_loopback else f"(regexp_matches({x}, {d.lit(P.IPV6_LOOPBACK_RE)}) or {pref})"


def ipv4_block_sql() -> str:
    ip = ipv4_long(d.canonical_host("host"))
    return duck_ctes("hosts") + f"""
select c_custkey, host, {ip} as ip, {v4_blocked(ip)} as blocked, {v4_blocked(ip, True)} as blocked_loopback_ok
from hosts
"""


def ipv6_block_sql() -> str:
    return duck_ctes("probe_urls") + f"""
select url_id, host, {v6_blocked('host')} as blocked, {v6_blocked('host', True)} as blocked_loopback_ok
from (select url_id, lower({d.url_part('url', 3)}) as host from probe_urls)
"""


def url_gate_sql() -> str:
    ip = ipv4_long(d.canonical_host("host"))
    return duck_ctes("probe_urls") + f""", {ALL_URLS}
select url_id, host,
  coalesce({scheme_msg('url')}, case when {v4_blocked(ip)} or {v6_blocked('host')} then 'SSRF blocked' end) as gate_message
from (select url_id, url, lower({d.url_part('url', 3)}) as host from all_urls)
"""


def resolved_gate_sql() -> str:
    addr_b = f"({v4_blocked(ipv4_long('address'))} or (contains(address, ':') and {v6_blocked('address')}))"
    return duck_ctes("named_urls", "resolved") + f""",
per_host as (select lower(host) as host, count(*) as n_addresses, max(cast({addr_b} as integer)) as any_blocked
             from resolved group by lower(host)),
u as (select url_id, {d.canonical_host(d.url_part('url', 3))} as host from named_urls)
select u.url_id, u.host, cast(p.n_addresses as bigint) as n_addresses,
  case when regexp_matches(u.host, {d.lit(P.IPV4_RE)}) or starts_with(u.host, '[') or u.host is null then null
       when p.n_addresses is null then 'DNS lookup failed'
       when p.any_blocked = 1 then 'SSRF blocked' end as resolve_message
from u left join per_host p on p.host = u.host
"""


def ct_msg(ct: str) -> str:
    norm = d.trim_ws(f"split_part(lower({ct}), ';', 1)")
    ok = " or ".join(f"starts_with({norm}, {d.lit(p)})" for p in P.ALLOWED_CONTENT_TYPE_PREFIXES)
    return f"(case when {ct} is null or {ct} = '' then null when not ({ok}) then 'Unsupported content type: ' || {norm} end)"


def content_type_gate_sql() -> str:
    return duck_ctes("fetch_log") + f"select event_id, content_type, {ct_msg('content_type')} as content_type_message from fetch_log"


def declared(v: str) -> str:
    t = d.trim_ws(v)
    return f"(case when regexp_matches({t}, {d.lit(NUMERIC_RE)}) then cast({t} as double) when {t} = '' then 0.0 end)"


def size_msg(decl: str, body: str, cap: int) -> str:
    return f"(case when ({declared(decl)} > {cap}) or (strlen({body}) > {cap}) then 'Response too large' end)"


def size_gate_sql() -> str:
    return duck_ctes("responses") + f"""
select page_id, declared_length, cast(strlen(html) as bigint) as n_bytes,
       {size_msg('declared_length', 'html', FIXTURE_CAP)} as size_message
from responses
"""


def status_cls(status: str, location: str) -> str:
    return (f"(case when {status} between 300 and 399 and {location} is not null and {location} <> '' then 'redirect' "
            f"when {status} between 200 and 299 then 'ok' else 'http_error' end)")


def status_class_sql() -> str:
    return duck_ctes("responses") + f"select page_id, status, location, {status_cls('status', 'location')} as status_class from responses"


def verdict_sql(cap: int) -> str:
    http = (f"coalesce(case when {status_cls('status', 'location')} = 'redirect' then 'redirect' end, "
            f"{ct_msg('content_type')}, {size_msg('declared_length', 'html', cap)}, "
            f"case when not (status between 200 and 299) then 'HTTP status ' || cast(status as varchar) end)")
    rendered = (f"coalesce(case when html is null or html = '' then 'Fetch resulted in empty response' end, "
                f"{size_msg('NULL', 'html', cap)}, "
                f"case when status in (403, 429) then 'HTTP status ' || cast(status as varchar) end)")
    return f"(case when engine = 'playwright' then {rendered} else {http} end)"


def gate_order_sql() -> str:
    return duck_ctes("responses") + f"""
select page_id, engine, verdict,
  case when verdict is null then 'ok' when verdict = 'redirect' then 'redirect' else 'error' end as verdict_kind
from (select *, {verdict_sql(FIXTURE_CAP)} as verdict from responses)
"""


def empty_gate_sql() -> str:
    return duck_ctes("responses") + """
select page_id,
  case when body is null then 'Upstream returned empty body' when body = '' then 'Fetch resulted in empty response' end as empty_message,
  case when body is null then 'FILE_EMPTY_RESPONSE' end as empty_code,
  case when body is null then 502 when body = '' then 502 end as empty_http
from (select page_id, case when page_id%10 = 3 then '' when page_id%10 = 7 then null else html end as body from responses)
"""


def header_request_sql() -> str:
    lk = "lower(e.key)"
    err = (f"case when {_in(lk, P.HOP_BY_HOP_HEADERS)} then null "
           f"when {_in(lk, P.FORBIDDEN_REQUEST_HEADERS)} then 'Forbidden header: ' || e.key "
           f"when {_in(lk, P.DROPPED_REQUEST_HEADERS)} or e.value is null then null "
           f"when length(e.key) > {P.MAX_HEADER_NAME_LENGTH} then 'Header name too long' "
           f"when length(e.value) > {P.MAX_HEADER_VALUE_LENGTH} then 'Header value too long' end")
    errs = f"list_filter(list_transform(map_entries(headers), lambda e: {err}), lambda x: x is not null)"
    keep = f"not ({_in(lk, P.HOP_BY_HOP_HEADERS + P.DROPPED_REQUEST_HEADERS)}) and e.value is not null"
    clean = f"map_from_entries(list_filter(map_entries(headers), lambda e: {keep}))"
    return duck_ctes("file_requests") + f"""
select req_id, header_error,
  case when header_error is null then cast(len(map_keys(clean)) as integer) end as n_kept,
  case when header_error is null then array_to_string(list_sort(map_keys(clean)), ',') end as kept_names
from (select req_id, {clean} as clean,
        case when headers is null then null when cardinality(headers) > {P.MAX_REQUEST_HEADERS} then 'Too many headers'
             else {errs}[1] end as header_error
      from file_requests)
"""


def header_response_sql() -> str:
    drop = P.HOP_BY_HOP_HEADERS + P.DROPPED_RESPONSE_HEADERS
    clean = f"map_from_entries(list_filter(map_entries(headers), lambda e: not ({_in('lower(e.key)', drop)})))"
    return f"""
with response_headers as ({RESPONSE_HEADERS_DUCK})
select page_id, cast(len(map_keys(c)) as integer) as n_kept, array_to_string(list_sort(map_keys(c)), ',') as kept_names
from (select page_id, {clean} as c from response_headers)
"""


def _links_cte() -> str:
    return "links as (" + page_links_sql().strip() + ")"


def heavy_resources_sql() -> str:
    suffix = ("case pos % 7 when 0 then '.png' when 1 then '.MP4' when 2 then '.woff2?v=1' when 3 then '.css' "
              "when 4 then '.webm' else '' end")
    ext = f"regexp_extract(h2, {d.lit(HEAVY_EXT_RE)}, 1)"
    return f"""
with {_links_cte()},
r as (select page_id, pos, href || {suffix} as h2 from links)
select page_id, pos, h2 as href,
  case when {_in(ext, P.HEAVY_IMAGE_FONT_EXTS)} then 'image_font' when {_in(ext, P.HEAVY_MEDIA_EXTS)} then 'media' end as resource_class
from r
"""


def tracker_antijoin_sql() -> str:
    host = f"lower({d.url_part('url', 3)})"
    return f"""
with {_links_cte()},
lh as (select page_id, pos, lower({d.url_part('href', 3)}) as host from links),
bl as (select distinct lower(domain) as domain from (
         select case when page_id % 7 = 0 then h
                     when page_id % 11 = 0 then regexp_extract(h, '^[^.]+\\.(.+\\..+\\..+)$', 1) end as domain
         from (select page_id, {host} as h from pages))
       where domain is not null and domain <> '')
select page_id, pos, host from lh
where not exists (select 1 from bl where bl.domain = lh.host or ends_with(lh.host, '.' || bl.domain))
"""


def route_engine_sql() -> str:
    return duck_ctes("page_requests", "fetch_requests", "file_requests") + """,
p as (select 'page' as kind, req_id, coalesce(case when mode <> '' then mode end, 'extractor') as effective_engine from page_requests),
f as (select 'fetch' as kind, req_id, engine as effective_engine from fetch_requests),
fi as (select 'file' as kind, req_id,
         case when coalesce(mode, 'auto') = 'auto' then 'http' else mode end as effective_engine from file_requests),
a as (select * from p union all select * from f union all select * from fi)
select kind, req_id, effective_engine,
  case when effective_engine = 'playwright' then 'browser' when effective_engine in ('extractor', 'http') then 'static' end as route
from a
"""


SQL = {
    "request_defaults": request_defaults_sql,
    "validate_page_requests": validate_page_sql,
    "validate_fetch_requests": validate_fetch_sql,
    "validate_file_requests": validate_file_sql,
    "unknown_fields": unknown_fields_sql,
    "quarantine": quarantine_sql,
    "url_parts": url_parts_sql,
    "scheme_gate": scheme_gate_sql,
    "ipv4_block": ipv4_block_sql,
    "ipv6_block": ipv6_block_sql,
    "url_gate": url_gate_sql,
    "resolved_gate": resolved_gate_sql,
    "content_type_gate": content_type_gate_sql,
    "size_gate": size_gate_sql,
    "status_class": status_class_sql,
    "gate_order": gate_order_sql,
    "empty_gate": empty_gate_sql,
    "header_request_clean": header_request_sql,
    "header_response_clean": header_response_sql,
    "heavy_resources": heavy_resources_sql,
    "tracker_antijoin": tracker_antijoin_sql,
    "route_engine": route_engine_sql,
}
