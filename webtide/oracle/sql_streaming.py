"""DuckDB oracle SQL for the streaming / extension queries that SQL can
express (E1–E5, F2). F1 (user extractor) gets the rows-only check plus
pytest comparisons."""

from __future__ import annotations

from ..config import DEFAULTS
from ..plans.queries_streaming import EXTRA_RULES
from ..sources.fixtures import duck_ctes
from . import duck as d
from .sql_gates import _errs, ct_msg, ipv4_long, min1, one_of, scheme_msg, tracker_antijoin_sql, url_msg, v4_blocked, v6_blocked
from .sql_outcomes import _with_c, final_outcome_sql
from .sql_pages import _ext_ctes, articles_sql, page_fields_sql


def stream_articles_sql() -> str:
    wc = d.word_count("coalesce(markdown, '')")
    return page_fields_sql(
        f"""select page_id, url, title, description, date, author, image, favicon, type, source, lang,
                   cast({wc} as integer) as word_count, {d.read_time_min(wc)} as read_time_min, {d.ttr_seconds(wc)} as ttr,
                   n_links, cast(null as integer) as error_code, md5(coalesce(markdown, '')) as body_md5 from art"""
    )


def write_articles_sql() -> str:
    return f"select req_id, url, title, word_count, error_code, error_message, md5(body) as body_md5 from ({articles_sql()})"


def write_outcomes_sql() -> str:
    return (
        "select case when outcome = 'success' then 'ok' else 'err' end as sink, req_id, outcome, status_code, error_code, attempts, "
        f"duration_ms from ({final_outcome_sql()})"
    )


def scan_objects_sql() -> str:
    return """
select page_id % 40 as object, cast(sum(strlen(html) + 1) as bigint) as length, sum(strlen(html) + 1) <= 32768 as within_cap
from pages where html is not null group by 1
"""


def extract_sql() -> str:
    return page_fields_sql("select page_id, url, title, lang, content_html is not null as has_content, n_links, md5(markdown) as md_md5 from art")


def stream_outcomes_sql() -> str:
    return _with_c() + """,
wm as (select max(ts) - interval 2 hour as wm from c),
b as (select time_bucket(interval 1 hour, ts) as window_start, engine, coalesce(error_code, 'OK') as code, antibot from c)
select window_start, window_start + interval 1 hour as window_end, engine, code,
       count(*) as attempts, cast(sum(cast(antibot as integer)) as bigint) as antibot
from b
where window_start + interval 1 hour <= (select wm from wm)
group by window_start, engine, code
"""


def markdown_extra_rules_sql() -> str:
    ctes = duck_ctes("rich_pages").strip().replace("with ", "with recursive ", 1)
    return ctes + ",\n" + _ext_ctes(True, "rich_pages", True, EXTRA_RULES).strip() + "\nselect page_id, md5(markdown) as md_md5 from md"


def stream_quarantine_sql() -> str:
    """The gates in order, one query each, and the first that stops a row."""
    cap = DEFAULTS.max_response_bytes
    e = _errs(url_msg("url"), one_of("mode", "mode", ["extractor", "playwright"]), min1("task_timeout_secs", "taskTimeoutSecs"))
    unknown = "list_transform(list_filter(json_keys(payload), lambda k: k not in ('url', 'mode', 'taskTimeoutSecs', 'rawBody', 'fingerprint')), lambda k: 'property ' || k || ' should not exist')"
    host = d.canonical_host(d.url_part("url", 3))
    return duck_ctes("gated_requests", "page_addresses") + f""",
a as (select *, {e} as errors, {unknown} as extra, {host} as host from gated_requests),
per_host as (select lower(host) as host, bool_or({v4_blocked(ipv4_long('address'))} or (contains(address, ':') and {v6_blocked('address')})) as blocked from page_addresses group by 1),
g as (select a.*, p.host is null as unresolved, p.blocked as private, {v4_blocked(ipv4_long('a.host'))} or (contains(a.host, ':') and {v6_blocked('a.host')}) as literal_blocked,
    regexp_matches(a.host, '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$') or starts_with(a.host, '[') as literal
  from a left join per_host p on p.host = a.host),
f as (select *, case
    when len(errors) + len(extra) > 0 then ['B1', 'Validation failed']
    when {scheme_msg('url')} is not null then ['B7', {scheme_msg('url')}]
    when literal_blocked then ['B8', 'SSRF blocked']
    when not literal and unresolved then ['B10', 'DNS lookup failed']
    when not literal and private then ['B10', 'SSRF blocked']
    when status is null then null
    when engine = 'http' and status between 300 and 399 and location <> '' then ['B13', 'redirect']
    when engine = 'playwright' and coalesce(html, '') = '' then ['B15', 'Fetch resulted in empty response']
    when engine = 'http' and {ct_msg('content_type')} is not null then ['B11', {ct_msg('content_type')}]
    when (engine = 'http' and cast(declared_length as double) > {cap}) or strlen(html) > {cap} then ['B12', 'Response too large']
    when (engine = 'http' and not status between 200 and 299) or (engine = 'playwright' and status in (403, 429)) then ['B14', 'HTTP status ' || status]
    end as stop from g)
select req_id, case when stop[1] = 'B13' then 'redirect' when stop is null then 'valid' else 'invalid' end as lane,
  case when stop[1] = 'B1' and len(errors) = 0 then 'B4' else stop[1] end as gate,
  case stop[1] when 'B1' then 'VALIDATION' when 'B7' then 'FETCH_INVALID_REQUEST' when 'B8' then 'FETCH_SSRF_BLOCKED'
    when 'B10' then (case when stop[2] = 'SSRF blocked' then 'FETCH_SSRF_BLOCKED' else 'FETCH_DNS_BLOCKED' end) when 'B11' then 'FETCH_UNSUPPORTED_CONTENT_TYPE'
    when 'B12' then 'FETCH_RESPONSE_TOO_LARGE' when 'B14' then 'FETCH_HTTP_STATUS' when 'B15' then 'FETCH_ERROR' end as error_code,
  case stop[1] when 'B7' then 'Invalid URL or unsupported protocol' when 'B13' then null when 'B14' then 'Upstream returned HTTP ' || status else stop[2] end as error_message,
  case when stop[1] = 'B1' then array_to_string(list_concat(errors, extra), '; ') end as details
from f
"""


SQL = {
    "scan_objects": scan_objects_sql,
    "extract": extract_sql,
    "write_articles": write_articles_sql,
    "write_outcomes": write_outcomes_sql,
    "stream_articles": stream_articles_sql,
    "stream_outcomes": stream_outcomes_sql,
    "stream_request_state": final_outcome_sql,
    "stream_quarantine": stream_quarantine_sql,
    "stream_blocklist": tracker_antijoin_sql,
    "markdown_extra_rules": markdown_extra_rules_sql,
}
