"""DuckDB oracle SQL for the outcome / retry / log queries (D*)."""

from __future__ import annotations

from ..config import DEFAULTS
from ..functions import patterns as P
from ..operators.outcomes import SECONDS_RE
from ..plans.queries_outcomes import CHUNK_FIXTURE_CAP
from ..sources.fixtures import duck_ctes
from . import duck as d
from .sql_gates import ct_msg, ipv4_long, scheme_msg, strip_br, v4_blocked, v6_blocked

CAP = DEFAULTS.retry_after_cap_ms


def _any(x: str, words) -> str:
    return "(" + " or ".join(f"contains({x}, {d.lit(w)})" for w in words) + ")"


def fetch_code(msg: str, st: str) -> dict[str, str]:
    lo = f"lower(coalesce({msg}, ''))"
    m = f"coalesce({msg}, '')"
    rules = [
        (f"(contains({lo}, 'invalid url') or contains({lo}, 'unsupported url protocol'))", "'FETCH_INVALID_REQUEST'",
         "'Invalid URL or unsupported protocol'", "false", "400"),
        (f"contains({lo}, 'unsupported content type')", "'FETCH_UNSUPPORTED_CONTENT_TYPE'", m, "false", "400"),
        (f"contains({lo}, 'ssrf blocked')", "'FETCH_SSRF_BLOCKED'", "'SSRF blocked'", "false", "400"),
        (f"(contains({lo}, 'dns') and contains({lo}, 'failed'))", "'FETCH_DNS_BLOCKED'", "'DNS lookup failed'", "false", "400"),
        (f"contains({lo}, 'timeout')", "'FETCH_TIMEOUT'", "'Request timeout'", "true", "504"),
        (f"contains({lo}, 'too many redirects')", "'FETCH_TOO_MANY_REDIRECTS'", "'Too many redirects'", "false", "508"),
        (f"contains({lo}, 'response too large')", "'FETCH_RESPONSE_TOO_LARGE'", "'Response too large'", "false", "413"),
        (f"contains({lo}, 'request aborted')", "'FETCH_ABORTED'", "'Request aborted'", "false", "400"),
        (f"{st} is not null", "'FETCH_HTTP_STATUS'", f"'Upstream returned HTTP ' || cast({st} as varchar)",
         f"({st} = 429 or {st} >= 500)", "502"),
        (f"(contains({lo}, 'navigation') or contains({lo}, 'net::') or contains({lo}, 'page.goto'))",
         "'FETCH_BROWSER_ERROR'", m, "true", "502"),
    ]
    out = {}
    for k, idx, default in [("code", 1, "'FETCH_ERROR'"), ("message", 2, m), ("retryable", 3, "false"), ("http_status", 4, "500")]:
        out[k] = "(case " + " ".join(f"when {r[0]} then {r[idx]}" for r in rules) + f" else {default} end)"
    return out


def ra_ms(v: str, now: str) -> str:
    t = d.trim_ws(v)
    secs = f"least(cast({t} as double) * 1000.0, {float(CAP)})"
    parsed = f"try_strptime(substr({t}, 6, 20), '%d %b %Y %H:%M:%S')"
    delta = f"((epoch_us({parsed}) - epoch_us({now})) / 1000.0)"
    return (f"(case when {t} is null or {t} = '' then null when regexp_matches({t}, {d.lit(SECONDS_RE)}) then {secs} "
            f"when {delta} > 0 then least({delta}, {float(CAP)}) end)")


def classified_cte() -> str:
    """CTE `c`: the fetch log with per-attempt verdict, D1 and D4 columns."""
    fe = fetch_code("error_message", "err_status")
    lo = "lower(coalesce(error_message, ''))"
    rd_retry = (f"case when err_status is not null then (err_status = 429 or err_status >= 500) "
                f"else {_any(lo, ['timeout', 'navigation', 'net::'])} end")
    rd_ab = f"case when err_status is not null then err_status in (403, 429) else {_any(lo, P.FETCH_BLOCK_WORDS)} end"
    ra = ra_ms("case when engine = 'playwright' then null else retry_after end", "ts")
    return f"""
c0 as (select *, case when status <> 0 then status end as status_n from fetch_log),
c1 as (select *,
         case when engine = 'playwright' then
                coalesce(err_msg, case when status_n is null then 'Fetch failed' end, case when status_n in (403, 429) then 'HTTP status ' || cast(status_n as varchar) end)
              else coalesce(err_msg, case when status_n is null then 'Fetch failed' end, {ct_msg('content_type')},
                            case when status_n is not null and not (status_n between 200 and 299)
                                 then 'HTTP status ' || cast(status_n as varchar) end) end as error_message
       from c0),
c2 as (select *, case when starts_with(error_message, 'HTTP status ') and err_msg is null then status_n end as err_status from c1),
c as (select *,
        case when error_message is not null then {fe['code']} end as error_code,
        case when error_message is not null then {fe['http_status']} end as error_http,
        case when error_message is not null then {fe['retryable']} end as error_retryable,
        case when error_message is not null then {rd_retry} else false end as retry,
        coalesce(case when error_message is not null then {rd_ab} else status_n in (403, 429) end, false) as antibot,
        case when error_message is not null and err_status is not null and {ra} <> 0 then {ra} end as retry_after_ms
      from c2)
"""


def _with_c() -> str:
    return duck_ctes("fetch_log") + "," + classified_cte()


def fetch_error_code_sql() -> str:
    return _with_c() + "select event_id, error_message, err_status, error_code, error_http, error_retryable from c"


def page_error_code_sql() -> str:
    lo = "lower(coalesce(error_message, ''))"
    code = (f"case when {_any(lo, P.PAGE_BROWSER_WORDS)} then 502 when {_any(lo, P.PAGE_TIMEOUT_WORDS)} then 504 "
            f"when {_any(lo, P.PAGE_VALIDATION_WORDS)} then 400 else 422 end")
    msg = (f"case when {_any(lo, P.PAGE_BROWSER_WORDS)} then 'Browser engine error' "
           f"when {_any(lo, P.PAGE_TIMEOUT_WORDS)} then 'Request timeout' "
           f"when {_any(lo, P.PAGE_VALIDATION_WORDS)} then 'Validation error' else 'Failed to extract content from page' end")
    return _with_c() + f"select event_id, {code} as page_code, {msg} as page_message, error_message as details from c where error_message is not null"


def file_error_code_sql() -> str:
    lo = "lower(coalesce(error_message, ''))"
    hdr = _any(lo, ["too many headers", "forbidden header", "header name too long", "header value too long"])
    code = (f"case when event_id % 13 = 0 then 'FILE_ABORTED' when event_id % 17 = 0 then 'FILE_TIMEOUT' "
            f"when {hdr} then 'FILE_INVALID_HEADERS' when contains({lo}, 'ssrf blocked') then 'FILE_SSRF_BLOCKED' "
            f"when contains({lo}, 'response too large') then 'FILE_RESPONSE_TOO_LARGE' else 'FILE_ERROR' end")
    return _with_c() + f"""
select event_id, file_code,
  case file_code when 'FILE_ABORTED' then 'Request aborted' when 'FILE_TIMEOUT' then 'Request timeout'
       when 'FILE_SSRF_BLOCKED' then 'SSRF blocked' when 'FILE_RESPONSE_TOO_LARGE' then 'Response too large' else coalesce(error_message, '') end as file_message,
  case when file_code in ('FILE_ABORTED', 'FILE_INVALID_HEADERS', 'FILE_SSRF_BLOCKED') then 400
       when file_code = 'FILE_TIMEOUT' then 504 when file_code = 'FILE_RESPONSE_TOO_LARGE' then 413
       when file_code = 'FILE_TOO_MANY_REDIRECTS' then 508 else 502 end as file_http
from (select *, {code} as file_code from c where error_message is not null)
"""


def retry_decision_sql() -> str:
    return _with_c() + "select event_id, retry, antibot, retry_after_ms from c"


def block_signal_sql() -> str:
    suffix = ("case event_id % 9 when 0 then ' (Cloudflare challenge)' when 1 then ' captcha required' "
              "when 2 then ' Access Denied' when 3 then ' bot detection triggered' when 4 then ' Security check' "
              "when 5 then ' reCAPTCHA' else '' end")
    return _with_c() + f"""
select event_id, msg, {_any('lower(msg)', P.FETCH_BLOCK_WORDS)} as fetch_block,
       {_any('msg', P.PAGE_BLOCK_WORDS)} as page_block_strict,
       {_any('lower(msg)', P.PAGE_BLOCK_WORDS)} as page_block_lower
from (select event_id, coalesce(error_message, 'ok') || {suffix} as msg from c)
"""


def retry_after_ms_sql() -> str:
    date = "strftime(ts + to_seconds(cast((event_id % 120) - 30 as bigint)), '%a, %d %b %Y %H:%M:%S') || ' GMT'"
    v = f"case when event_id % 7 = 3 then {date} when event_id % 7 = 5 then 'soon' when event_id % 7 = 6 then ' 1.5 ' else retry_after end"
    return duck_ctes("fetch_log") + f"select event_id, ra_value, {ra_ms('ra_value', 'ts')} as retry_after_ms from (select *, {v} as ra_value from fetch_log)"


def attempt_numbers_sql() -> str:
    return duck_ctes("fetch_log") + "select req_id, event_id, cast(row_number() over (partition by req_id order by ts, event_id) as integer) as attempt_no from fetch_log"


def running_block_flag_sql() -> str:
    return _with_c() + """
select req_id, event_id, antibot,
  max(cast(antibot as integer)) over (partition by req_id order by ts, event_id rows between unbounded preceding and current row) = 1 as was_antibot
from c
"""


def chain_ctes(timeout_secs: int = DEFAULTS.fetch_timeout_secs) -> str:
    m = DEFAULTS.max_attempts
    bo = f"least({float(DEFAULTS.backoff_cap_ms)}, {float(DEFAULTS.backoff_base_ms)} * pow(2.0, greatest(0, attempt_no - 1)))"
    fe = fetch_code("'Timeout'", "NULL")
    return _with_c() + f""",
n as (select *, row_number() over (partition by req_id order by ts, event_id) as attempt_no from c),
w as (select *, case when retry and attempt_no < {m} then coalesce(retry_after_ms, {bo}) end as wait_ms from n),
b as (select *, coalesce(sum(dur_ms + coalesce(wait_ms, 0.0)) over (partition by req_id order by ts, event_id
               rows between unbounded preceding and 1 preceding), 0.0) as elapsed_before_ms from w),
h as (select *, elapsed_before_ms >= {timeout_secs} * 1000.0 as deadline_hit,
        elapsed_before_ms < {timeout_secs} * 1000.0 and elapsed_before_ms + coalesce(dur_ms, 0) > {timeout_secs} * 1000.0 as cut_in_flight
      from b),
ch as (select req_id, event_id, ts, engine, attempt_no, elapsed_before_ms, deadline_hit, cut_in_flight,
         case when deadline_hit then null when cut_in_flight then (case when attempt_no < {m} then {bo} end) else wait_ms end as wait_ms,
         case when deadline_hit or cut_in_flight then null else status end as status,
         case when deadline_hit then 0 when cut_in_flight then cast(floor({timeout_secs} * 1000.0 - elapsed_before_ms) as bigint)
              else dur_ms end as dur_ms,
         case when deadline_hit or cut_in_flight then false else antibot end as antibot,
         case when deadline_hit or cut_in_flight then 'Timeout' else error_message end as error_message,
         case when deadline_hit or cut_in_flight then {fe['code']} else error_code end as error_code,
         case when deadline_hit or cut_in_flight then {fe['http_status']} else error_http end as error_http,
         case when deadline_hit or cut_in_flight then true else error_retryable end as error_retryable,
         case when deadline_hit or cut_in_flight then null else err_status end as err_status,
         case when deadline_hit then false when cut_in_flight then true else retry end as retry
       from h)
"""


def wait_profile_sql() -> str:
    return chain_ctes() + "select req_id, event_id, cast(attempt_no as integer) as attempt_no, wait_ms from ch"


def deadline_budget_sql() -> str:
    return chain_ctes() + "select req_id, event_id, elapsed_before_ms, deadline_hit, cut_in_flight, dur_ms, error_message from ch"


def final_ctes(where: str = "") -> str:
    m = DEFAULTS.max_attempts
    base = chain_ctes()
    if where:
        base = base.replace("c0 as (select *, case when status <> 0 then status end as status_n from fetch_log)",
                            f"c0 as (select *, case when status <> 0 then status end as status_n from fetch_log where {where})")
    return base + f""",
t as (select *, coalesce(sum(cast((error_message is null or not retry or attempt_no >= {m}) as integer))
                over (partition by req_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as prior
      from ch),
k as (select * from t where prior = 0),
fo as (select req_id,
         arg_max_null(engine, attempt_no) as engine,
         cast(max(attempt_no) - cast(arg_max_null(deadline_hit, attempt_no) as integer) as integer) as attempts,
         max(cast(antibot as integer)) = 1 as was_antibot,
         cast(case when arg_max_null(error_message, attempt_no) is null then nullif(arg_max_null(status, attempt_no), 0)
              else arg_max_null(err_status, attempt_no) end as integer) as status_code,
         case when arg_max_null(error_message, attempt_no) is null then 'success' else 'error' end as outcome,
         arg_max_null(error_code, attempt_no) as error_code,
         arg_max_null(error_message, attempt_no) as error_message,
         cast(arg_max_null(error_http, attempt_no) as integer) as http_status,
         arg_max_null(error_retryable, attempt_no) as retryable,
         sum(coalesce(wait_ms, 0.0)) - arg_max_null(coalesce(wait_ms, 0.0), attempt_no) as total_wait_ms,
         cast(sum(dur_ms) + floor(sum(coalesce(wait_ms, 0.0)) - arg_max_null(coalesce(wait_ms, 0.0), attempt_no)) as bigint) as duration_ms
       from k group by req_id)
"""


def final_outcome_sql() -> str:
    return final_ctes() + "select * from fo"


def merge_fallback_sql() -> str:
    http = final_ctes("engine = 'http'")
    rend = final_ctes("engine = 'playwright'")
    return f"""
with h as ({http} select * from fo), r as ({rend} select * from fo),
j as (select h.*, r.outcome as r_outcome, r.status_code as r_status_code, r.error_code as r_error_code,
             r.attempts as r_attempts,
             coalesce(h.status_code in (403, 429) and r.status_code is not null, false) as use_r
      from h left join r using (req_id))
select req_id, case when use_r then 'playwright' else 'http' end as mode_used,
  case when use_r then r_outcome else outcome end as outcome,
  case when use_r then r_status_code else status_code end as status_code,
  case when use_r then r_error_code else error_code end as error_code,
  case when use_r then r_attempts else attempts end as attempts
from j
"""


def _envelope_cte() -> str:
    from ..sources.fixtures import FETCH_REQUESTS

    fr = "fetch_requests as (" + FETCH_REQUESTS.format(fetch_log="select * from fetch_log") + ")"
    return final_ctes() + ", " + fr + """,
env as (select fo.*, coalesce(fr.debug = true, false) as debug,
          case when outcome = 'error' then greatest(attempts, 1) else attempts end as meta_attempts,
          case when outcome = 'error' then http_status else 200 end as response_status
        from fo left join fetch_requests fr using (req_id))
"""


def outcome_envelope_sql() -> str:
    return _envelope_cte() + """
select req_id, outcome, meta_attempts, response_status,
  (outcome <> 'error' and debug) as shows_headers, (outcome = 'error' and debug) as shows_stack, error_code,
  meta_attempts as payload_attempts, duration_ms as payload_duration_ms, case when outcome = 'error' then error_code end as payload_code,
  case when outcome <> 'error' and debug then cast(attempts as varchar) end as payload_header,
  case when outcome = 'error' and debug then 'Error: ' || error_message end as payload_stack
from env
"""


def wire_normalize_sql() -> str:
    return _envelope_cte() + """
select req_id, response_status,
  case when response_status = 400 then '400' else error_code end as wire_code,
  case when response_status = 400 then 'Validation failed' else error_message end as wire_message,
  cast(null as varchar) as wire_details
from env
"""


def continue_on_fail_sql() -> str:
    return final_ctes() + """
select req_id as item_index,
  case when error_message is not null then to_json({'error': error_message})::varchar
       else to_json({'attempts': attempts, 'status_code': coalesce(status_code, 0)})::varchar end as json
from fo
"""


def resolve_redirects_sql() -> str:
    mx = DEFAULTS.max_redirects
    ip = ipv4_long(strip_br(f"lower({d.url_part('cur_url', 3)})"))
    hostx = f"lower({d.url_part('cur_url', 3)})"
    gate = (f"coalesce({scheme_msg('cur_url')}, case when {v4_blocked(ip)} or "
            f"(contains({strip_br(hostx)}, ':') and {v6_blocked(hostx)}) then 'SSRF blocked' end)")
    hop = duck_ctes("hop")[len("with "):]
    return f"""
with recursive {hop},
walk(page_id, cur_url, hops) as (
  select page_id, url, 0 from pages
  union all
  select w.page_id, {d.resolve_url('w.cur_url', 'h.location')}, w.hops + 1
  from walk w join hop h on h.src_url = w.cur_url
  where w.hops < {mx} + 1
),
g as (select page_id, cur_url, hops, {gate} as gate from walk),
s as (select page_id, max(hops) as hmax,
             min(case when gate is not null and hops <= {mx} then hops end) as first_gate
      from g group by page_id)
select s.page_id,
  case when (s.first_gate is not null and s.first_gate <= least(s.hmax, {mx})) or s.hmax > {mx} then null
       else g1.cur_url end as final_url,
  cast(case when s.first_gate is not null and s.first_gate <= least(s.hmax, {mx}) then s.first_gate
            else least(s.hmax, {mx}) end as integer) as hops,
  case when s.first_gate is not null and s.first_gate <= least(s.hmax, {mx}) then g2.gate
       when s.hmax > {mx} then 'Too many redirects' end as error_message
from s
left join g g1 on g1.page_id = s.page_id and g1.hops = least(s.hmax, {mx})
left join g g2 on g2.page_id = s.page_id and g2.hops = s.first_gate
"""


def access_log_sql() -> str:
    return duck_ctes("access_raw") + """
select event_id,
  case when status >= 500 then 'error' when status >= 400 then 'warn' else 'info' end as level,
  split_part(url, '?', 1) as path, status,
  case when auth_header is not null then '[REDACTED]' end as auth_header,
  case when api_key_header is not null then '[REDACTED]' end as api_key_header,
  ua_header
from access_raw
where url not like '%/health%'
"""


def outcome_rollup_sql() -> str:
    return final_ctes() + """
select engine, error_code, cast(grouping(engine, error_code) as integer) as gid,
  count(*) as requests, cast(sum(cast(outcome = 'success' as integer)) as bigint) as successes,
  round(avg(cast(outcome = 'success' as integer)::double), 6) as success_rate,
  round(avg(cast(was_antibot as integer)::double), 6) as block_rate,
  round(avg(attempts::double), 6) as mean_attempts,
  round(quantile_cont(duration_ms::double, 0.5), 3) as p50_ms,
  round(quantile_cont(duration_ms::double, 0.95), 3) as p95_ms
from fo group by rollup (engine, error_code)
"""


def in_flight_sql() -> str:
    return duck_ctes("fetch_log") + """,
sp as (select req_id, min(epoch_us(ts)) as start_us, max(epoch_us(ts) + dur_ms * 1000) as end_us from fetch_log group by req_id),
ev as (select floor(start_us / 60000000) as bucket, 1 as dl from sp union all select floor(end_us / 60000000), -1 from sp),
per as (select bucket, cast(sum(dl) as bigint) as delta from ev group by bucket),
s as (select *, sum(delta) over (order by bucket rows between unbounded preceding and current row) as s_ from per),
m as (select *, min(s_) over (order by bucket rows between unbounded preceding and current row) as m_ from s)
select cast(bucket as bigint) as bucket, delta, cast(s_ - least(0, m_) as bigint) as active from m
"""


def _limited(cap: int) -> str:
    return duck_ctes("chunks") + f""",
lim as (select object_id, seq, chunk, cast(strlen(chunk) as bigint) as n_bytes,
          cast(sum(strlen(chunk)) over (partition by object_id order by seq rows between unbounded preceding and current row) as bigint) as running_bytes
        from chunks)
"""


def chunk_limit_sql() -> str:
    return _limited(CHUNK_FIXTURE_CAP) + f"select object_id, cast(seq as integer) as seq, n_bytes, running_bytes, running_bytes <= {CHUNK_FIXTURE_CAP} as emitted from lim"


def object_status_sql() -> str:
    return _limited(CHUNK_FIXTURE_CAP) + f"""
select object_id, max(running_bytes) as total_bytes,
  case when max(running_bytes) > {CHUNK_FIXTURE_CAP} then 'Response too large' end as error_message
from lim group by object_id
"""


def assemble_chunks_sql() -> str:
    cap = DEFAULTS.max_response_bytes
    return _limited(cap) + f"""
select object_id, cast(count(*) as bigint) as n_chunks, cast(sum(n_bytes) as bigint) as n_bytes,
  cast(length(string_agg(chunk, '' order by seq)) as bigint) as n_chars, md5(string_agg(chunk, '' order by seq)) as text_md5
from lim where running_bytes <= {cap} group by object_id
"""


SQL = {
    "fetch_error_code": fetch_error_code_sql,
    "page_error_code": page_error_code_sql,
    "file_error_code": file_error_code_sql,
    "retry_decision": retry_decision_sql,
    "block_signal": block_signal_sql,
    "retry_after_ms": retry_after_ms_sql,
    "attempt_numbers": attempt_numbers_sql,
    "running_block_flag": running_block_flag_sql,
    "wait_profile": wait_profile_sql,
    "deadline_budget": deadline_budget_sql,
    "final_outcome": final_outcome_sql,
    "merge_fallback": merge_fallback_sql,
    "outcome_envelope": outcome_envelope_sql,
    "wire_normalize": wire_normalize_sql,
    "continue_on_fail": continue_on_fail_sql,
    "resolve_redirects": resolve_redirects_sql,
    "access_log": access_log_sql,
    "outcome_rollup": outcome_rollup_sql,
    "in_flight": in_flight_sql,
    "chunk_limit": chunk_limit_sql,
    "object_status": object_status_sql,
    "assemble_chunks": assemble_chunks_sql,
}
