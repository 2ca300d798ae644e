"""Outcome, retry and attempt-log operators.

The attempt log has one row per attempt: (req_id, attempt order columns,
engine, status, err_msg, content_type, retry_after, dur_ms, …). All
per-request windows share ``Window.partitionBy(req_id).orderBy(ts,
event_id)`` so Spark plans one Exchange + Sort for the whole chain; a
request has at most ``max_attempts`` rows, so every window group is small
whatever the table size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Limits
from ..functions import patterns as P
from ..functions.text import trim_ws
from .gates import content_type_message, size_message


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _any(lower_msg: Column, words: list[str]) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | lower_msg.contains(w)
    return cond


# --- D1–D3 error maps ------------------------------------------------------------------


def fetch_error_code(message: Column, status: Column) -> dict[str, Column]:
    """Ordered message/status → (code, message, retryable, http_status) of
    the fetch service; first match wins."""
    m = F.coalesce(message, F.lit(""))
    lo = F.lower(m)
    has_status = status.isNotNull()
    # fixed values: tests in this order, codes, messages and HTTP statuses
    rules = [
        (lo.contains("invalid url") | lo.contains("unsupported url protocol"),
         "FETCH_INVALID_REQUEST", F.lit("Invalid URL or unsupported protocol"), F.lit(False), 400),
        (lo.contains("unsupported content type"), "FETCH_UNSUPPORTED_CONTENT_TYPE", m, F.lit(False), 400),
        (lo.contains("ssrf blocked"), "FETCH_SSRF_BLOCKED", F.lit("SSRF blocked"), F.lit(False), 400),
        (lo.contains("dns") & lo.contains("failed"), "FETCH_DNS_BLOCKED", F.lit("DNS lookup failed"), F.lit(False), 400),
        (lo.contains("timeout"), "FETCH_TIMEOUT", F.lit("Request timeout"), F.lit(True), 504),
        (lo.contains("too many redirects"), "FETCH_TOO_MANY_REDIRECTS", F.lit("Too many redirects"), F.lit(False), 508),
        (lo.contains("response too large"), "FETCH_RESPONSE_TOO_LARGE", F.lit("Response too large"), F.lit(False), 413),
        (lo.contains("request aborted"), "FETCH_ABORTED", F.lit("Request aborted"), F.lit(False), 400),
        (has_status, "FETCH_HTTP_STATUS",
         F.concat(F.lit("Upstream returned HTTP "), status.cast("string")),
         (status == 429) | (status >= 500), 502),
        (lo.contains("navigation") | lo.contains("net::") | lo.contains("page.goto"),
         "FETCH_BROWSER_ERROR", m, F.lit(True), 502),
    ]
    code = msg = retry = http = None
    for cond, c, mm, r, h in reversed(rules):
        if code is None:
            code = F.when(cond, F.lit(c)).otherwise(F.lit("FETCH_ERROR"))
            msg = F.when(cond, mm).otherwise(m)
            retry = F.when(cond, r).otherwise(F.lit(False))
            http = F.when(cond, F.lit(h)).otherwise(F.lit(500))
        else:
            code = F.when(cond, F.lit(c)).otherwise(code)
            msg = F.when(cond, mm).otherwise(msg)
            retry = F.when(cond, r).otherwise(retry)
            http = F.when(cond, F.lit(h)).otherwise(http)
    return {"code": code, "message": msg, "retryable": retry, "http_status": http}


def page_error_code(message: Column) -> dict[str, Column]:
    """Page-level classification: browser words → 502, timeout → 504,
    validation words → 400, else 422; the original message is kept as
    details."""
    lo = F.lower(F.coalesce(message, F.lit("")))
    browser = _any(lo, P.PAGE_BROWSER_WORDS)
    timeout = _any(lo, P.PAGE_TIMEOUT_WORDS)
    valid = _any(lo, P.PAGE_VALIDATION_WORDS)
    code = F.when(browser, 502).when(timeout, 504).when(valid, 400).otherwise(422)
    msg = (
        F.when(browser, F.lit("Browser engine error"))
        .when(timeout, F.lit("Request timeout"))
        .when(valid, F.lit("Validation error"))
        .otherwise(F.lit("Failed to extract content from page"))
    )
    return {"code": code, "message": msg, "details": message}


def file_error_code(message: Column, existing_code: Column | None = None, aborted_by: Column | None = None,
                    with_header_checks: bool = True) -> dict[str, Column]:
    """File-proxy error map: caller abort → FILE_ABORTED 400, timer abort →
    FILE_TIMEOUT 504, a code raised as such passes through (redirect limit
    508 and empty body 502 are only ever raised), header problems →
    FILE_INVALID_HEADERS 400, SSRF → 400, too large → 413, else FILE_ERROR
    502 with the message as it is."""
    m = F.coalesce(message, F.lit(""))
    lo = F.lower(m)
    ab = aborted_by if aborted_by is not None else F.lit(None).cast("string")
    ex = existing_code if existing_code is not None else F.lit(None).cast("string")
    hdr = _any(lo, ["too many headers", "forbidden header", "header name too long", "header value too long"])
    if not with_header_checks:
        hdr = F.lit(False)
    code = (
        F.when(ab == "caller", F.lit("FILE_ABORTED"))
        .when(ab == "timer", F.lit("FILE_TIMEOUT"))
        .when(ex.isNotNull(), ex)
        .when(hdr, F.lit("FILE_INVALID_HEADERS"))
        .when(lo.contains("ssrf blocked"), F.lit("FILE_SSRF_BLOCKED"))
        .when(lo.contains("response too large"), F.lit("FILE_RESPONSE_TOO_LARGE"))
        .otherwise(F.lit("FILE_ERROR"))
    )
    http = (
        F.when(code.isin("FILE_ABORTED", "FILE_INVALID_HEADERS", "FILE_SSRF_BLOCKED"), F.lit(400))
        .when(code == "FILE_TIMEOUT", F.lit(504))
        .when(code == "FILE_RESPONSE_TOO_LARGE", F.lit(413))
        .when(code == "FILE_TOO_MANY_REDIRECTS", F.lit(508))
        .otherwise(F.lit(502))
    )
    msg = (
        F.when(code == "FILE_ABORTED", F.lit("Request aborted"))
        .when(code == "FILE_TIMEOUT", F.lit("Request timeout"))
        .when(ex.isNull() & (code == "FILE_SSRF_BLOCKED"), F.lit("SSRF blocked"))
        .when(ex.isNull() & (code == "FILE_RESPONSE_TOO_LARGE"), F.lit("Response too large"))
        .otherwise(m)
    )
    return {"code": code, "message": msg, "http_status": http}


# --- D4–D7 retry decision and waits ----------------------------------------------------------

SECONDS_RE = r"^[0-9]+(\.[0-9]+)?$"
HTTP_DATE_FMT = "dd MMM yyyy HH:mm:ss"


def retry_after_ms(value: Column, now: Column, cap_ms: int = DEFAULTS.retry_after_cap_ms) -> Column:
    """Retry-After → milliseconds: seconds (×1000) or an HTTP date minus
    ``now``; capped; blank, past and invalid → NULL. ``'0'`` gives 0, which
    callers treat as absent. ``now`` is a column, never the wall clock."""
    t = trim_ws(value)
    secs = F.least(t.cast("double") * 1000.0, F.lit(float(cap_ms)))
    parsed = F.try_to_timestamp(F.substring(t, 6, 20), F.lit(HTTP_DATE_FMT))
    delta = (F.unix_micros(parsed) - F.unix_micros(now.cast("timestamp"))) / 1000.0
    date_ms = F.when(delta > 0, F.least(delta, F.lit(float(cap_ms))))
    return F.when(t.isNull() | (t == ""), F.lit(None).cast("double")).when(t.rlike(SECONDS_RE), secs).otherwise(date_ms)


def block_signal(message: Column, words: list[str] | None = None, lower: bool = True) -> Column:
    """Anti-bot pattern in a message. Fetch list lowercases; the page list
    matched on error objects is case-sensitive (``lower=False``)."""
    ws = words if words is not None else P.FETCH_BLOCK_WORDS
    m = F.coalesce(message, F.lit(""))
    return _any(F.lower(m) if lower else m, ws)


def retry_decision(status: Column, message: Column, retry_after: Column, now: Column,
                   cap_ms: int = DEFAULTS.retry_after_cap_ms) -> dict[str, Column]:
    """With a status: antibot = 403/429, retryable = 429 or ≥ 500 (403 is
    flagged but not retried), Retry-After kept when non-zero. Without:
    antibot from the message words, retryable on timeout / navigation /
    net::."""
    has = status.isNotNull()
    lo = F.lower(F.coalesce(message, F.lit("")))
    ra = retry_after_ms(retry_after, now, cap_ms)
    return {
        "retryable": F.when(has, (status == 429) | (status >= 500)).otherwise(
            _any(lo, ["timeout", "navigation", "net::"])
        ),
        "was_antibot": F.when(has, status.isin(403, 429)).otherwise(block_signal(message)),
        "retry_after_ms": F.when(has & (ra != 0), ra),
    }


def backoff_ms(attempt0: Column, cfg: Limits = DEFAULTS, jitter_key: Column | None = None) -> Column:
    """min(cap, base·2^attempt) + jitter; the jitter is a hash of the key so
    reruns agree (no random numbers)."""
    exp = F.least(
        F.lit(float(cfg.backoff_cap_ms)),
        F.lit(float(cfg.backoff_base_ms)) * F.pow(F.lit(2.0), F.greatest(F.lit(0), attempt0)),
    )
    if jitter_key is None:
        return exp
    return exp + F.pmod(F.xxhash64(jitter_key, attempt0), F.lit(cfg.backoff_jitter_ms)).cast("double")


# --- attempt classification (the verdict of one attempt) ---------------------------------------


def classify_attempts(log: DataFrame, cfg: Limits = DEFAULTS) -> DataFrame:
    """Per attempt: ``error_message`` (NULL = success), ``err_status`` (the
    status carried by an HTTP-status error), D1 fields, D4 decision.

    http path: transport error → content type → size → status.
    rendered path: transport error → 403/429 (other statuses succeed; no
    content-type gate; no Retry-After)."""
    status = F.when(F.col("status") != 0, F.col("status"))
    ct = F.col("content_type") if "content_type" in log.columns else F.lit(None).cast("string")
    body = F.col("body") if "body" in log.columns else F.lit(None).cast("string")
    declared = F.col("declared_length") if "declared_length" in log.columns else F.lit(None).cast("string")
    http_status_err = F.when(
        status.isNotNull() & ~status.between(200, 299), F.concat(F.lit("HTTP status "), status.cast("string"))
    )
    # neither a status nor a message: no response was recorded
    lost = F.when(status.isNull(), F.lit("Fetch failed"))
    http_msg = F.coalesce(
        F.col("err_msg"),
        lost,
        content_type_message(ct),
        size_message(declared, body, cfg.max_response_bytes),
        http_status_err,
    )
    rendered_msg = F.coalesce(
        F.col("err_msg"),
        lost,
        size_message(F.lit(None).cast("string"), body, cfg.max_response_bytes),
        F.when(status.isin(403, 429), F.concat(F.lit("HTTP status "), status.cast("string"))),
    )
    is_pw = F.col("engine") == "playwright"
    out = log.withColumn("error_message", F.when(is_pw, rendered_msg).otherwise(http_msg))
    out = out.withColumn(
        "err_status",
        F.when(F.col("error_message").startswith("HTTP status ") & F.col("err_msg").isNull(), status),
    )
    fe = fetch_error_code(F.col("error_message"), F.col("err_status"))
    ra = F.when(is_pw, F.lit(None).cast("string")).otherwise(F.col("retry_after"))
    rd = retry_decision(F.col("err_status"), F.col("error_message"), ra, F.col("ts"), cfg.retry_after_cap_ms)
    failed = F.col("error_message").isNotNull()
    return out.select(
        "*",
        F.when(failed, fe["code"]).alias("error_code"),
        F.when(failed, fe["http_status"]).alias("error_http"),
        F.when(failed, fe["retryable"]).alias("error_retryable"),
        F.when(failed, rd["retryable"]).otherwise(F.lit(False)).alias("retry"),
        F.when(failed, rd["was_antibot"]).otherwise(status.isin(403, 429)).alias("antibot"),
        F.when(failed, rd["retry_after_ms"]).alias("retry_after_ms"),
    )


# --- D8–D11 windows over attempts ---------------------------------------------------------------


def _keys(req) -> list[str]:
    return [req] if isinstance(req, str) else list(req)


def attempt_window(req="req_id", order=("ts", "event_id")) -> Window:
    """``req`` is a column name or a list of names (a composite key)."""
    return Window.partitionBy(*_keys(req)).orderBy(*order)


def number_attempts(log: DataFrame, req: str = "req_id", order=("ts", "event_id")) -> DataFrame:
    """``attempt_no``: 1-based position of the attempt in its request."""
    return log.withColumn("attempt_no", F.row_number().over(attempt_window(req, order)))


def running_block_flag(log: DataFrame, flag: str = "antibot", req: str = "req_id", order=("ts", "event_id")) -> DataFrame:
    """``was_antibot``: sticky — true from the first flagged attempt on."""
    w = attempt_window(req, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return log.withColumn("was_antibot", F.max(F.col(flag).cast("int")).over(w) == 1)


def wait_profile(log: DataFrame, cfg: Limits = DEFAULTS, jitter: bool = True, req: str = "req_id") -> DataFrame:
    """``wait_ms`` after each retried attempt: Retry-After when non-zero,
    else backoff(attempt index). Needs ``retry`` and ``attempt_no``."""
    a0 = F.col("attempt_no") - 1
    bo = backoff_ms(a0, cfg, F.col(req) if jitter else None)
    w = F.when(F.col("retry") & (F.col("attempt_no") < cfg.max_attempts), F.coalesce(F.col("retry_after_ms"), bo))
    return log.withColumn("wait_ms", w)


def deadline_budget(log: DataFrame, timeout_secs: Column | int = DEFAULTS.fetch_timeout_secs,
                    req: str = "req_id", order=("ts", "event_id")) -> DataFrame:
    """``elapsed_before_ms``: duration and waits of the earlier attempts;
    ``deadline_hit``: nothing of the budget is left when the attempt would
    start (it never runs and reports 'Timeout'); ``cut_in_flight``: the
    budget ends while the attempt runs (it is aborted and reports
    'Timeout'). Sleeps are not clipped. An attempt that is cut has spent the
    rest of the budget, so whatever comes after it starts too late."""
    t = timeout_secs if isinstance(timeout_secs, Column) else F.lit(int(timeout_secs))
    w = attempt_window(req, order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(F.col("dur_ms") + F.coalesce(F.col("wait_ms"), F.lit(0.0))).over(w), F.lit(0.0))
    budget = t.cast("double") * 1000.0
    hit = F.col("elapsed_before_ms") >= budget
    return (
        log.withColumn("elapsed_before_ms", spent)
        .withColumn("deadline_hit", hit)
        .withColumn("cut_in_flight", ~hit & (F.col("elapsed_before_ms") + F.coalesce(F.col("dur_ms"), F.lit(0)) > budget))
        .withColumn("left_ms", F.greatest(budget - F.col("elapsed_before_ms"), F.lit(0.0)))
    )


def attempt_chain(log: DataFrame, cfg: Limits = DEFAULTS, jitter: bool = True,
                  timeout_secs: Column | int = DEFAULTS.fetch_timeout_secs, req="req_id") -> DataFrame:
    """D8 → classify → D9 → D7 → D11 over one shared window spec, then an
    attempt past the deadline, or cut by it, becomes a 'Timeout' error. A
    cut attempt may be retried, after its backoff; the retry then starts
    past the deadline."""
    df = number_attempts(log, req)
    df = classify_attempts(df, cfg)
    df = running_block_flag(df, req=req)
    df = wait_profile(df, cfg, jitter, req=_keys(req)[0])
    df = deadline_budget(df, timeout_secs, req=req)
    late, cut = F.col("deadline_hit"), F.col("cut_in_flight")
    hit = late | cut
    fe = fetch_error_code(F.lit("Timeout"), F.lit(None).cast("int"))
    # no response is seen: no status and no anti-bot signal; an attempt that
    # never starts takes no time, a cut one what was left
    more = F.col("attempt_no") < cfg.max_attempts
    backoff = backoff_ms(F.col("attempt_no") - 1, cfg, F.col(_keys(req)[0]) if jitter else None)
    return (
        df.withColumn("status", F.when(hit, F.lit(None)).otherwise(F.col("status")))
        .withColumn("dur_ms", F.when(late, F.lit(0).cast("bigint")).when(cut, F.floor("left_ms").cast("bigint")).otherwise(F.col("dur_ms")))
        .withColumn("wait_ms", F.when(late, F.lit(None)).when(cut & more, backoff).when(~cut, F.col("wait_ms")))
        .withColumn("antibot", F.when(hit, F.lit(False)).otherwise(F.col("antibot")))
        .withColumn("error_message", F.when(hit, F.lit("Timeout")).otherwise(F.col("error_message")))
        .withColumn("error_code", F.when(hit, fe["code"]).otherwise(F.col("error_code")))
        .withColumn("error_http", F.when(hit, fe["http_status"]).otherwise(F.col("error_http")))
        .withColumn("error_retryable", F.when(hit, F.lit(True)).otherwise(F.col("error_retryable")))
        .withColumn("err_status", F.when(hit, F.lit(None)).otherwise(F.col("err_status")))
        .withColumn("retry", F.when(late, F.lit(False)).when(cut, F.lit(True)).otherwise(F.col("retry")))
        .drop("left_ms")
    )


def final_outcome(log: DataFrame, cfg: Limits = DEFAULTS, jitter: bool = True,
                  timeout_secs: Column | int = DEFAULTS.fetch_timeout_secs, req="req_id") -> DataFrame:
    """One row per request: attempts up to the first terminal one (success,
    non-retryable error, deadline, or attempt = max) are kept; reports
    attempts, sticky anti-bot flag, last status, outcome and error fields,
    total wait, and the duration: wall time from the start, waits included."""
    max_a = max(1, cfg.max_attempts)
    df = attempt_chain(log, cfg, jitter, timeout_secs, req)
    terminal = (
        F.col("error_message").isNull() | ~F.col("retry") | (F.col("attempt_no") >= max_a)
    ).cast("int")
    w = attempt_window(req).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_prior", F.coalesce(F.sum(terminal).over(w), F.lit(0))).where(F.col("_prior") == 0)
    last = F.struct(
        F.col("attempt_no"), F.col("deadline_hit"), F.col("status"), F.col("error_message"), F.col("error_code"),
        F.col("error_http"), F.col("error_retryable"), F.col("err_status"), F.col("engine"),
    )
    keys = _keys(req)
    g = df.groupBy(*keys).agg(
        F.max_by(last, F.col("attempt_no")).alias("l"),
        F.max(F.col("antibot").cast("int")).alias("_ab"),
        F.sum("dur_ms").alias("duration_ms"),
        F.sum(F.coalesce("wait_ms", F.lit(0.0))).alias("_wait_all"),
        F.max_by(F.coalesce("wait_ms", F.lit(0.0)), F.col("attempt_no")).alias("_wait_last"),
    )
    return g.select(
        *keys,
        *([] if "engine" in keys else [F.col("l.engine").alias("engine")]),
        (F.col("l.attempt_no") - F.col("l.deadline_hit").cast("int")).cast("int").alias("attempts"),
        (F.col("_ab") == 1).alias("was_antibot"),
        F.when(F.col("l.error_message").isNull(), F.when(F.col("l.status") != 0, F.col("l.status")))
        .otherwise(F.col("l.err_status")).cast("int").alias("status_code"),
        F.when(F.col("l.error_message").isNull(), F.lit("success")).otherwise(F.lit("error")).alias("outcome"),
        F.col("l.error_code").alias("error_code"),
        F.col("l.error_message").alias("error_message"),
        F.col("l.error_http").cast("int").alias("http_status"),
        F.col("l.error_retryable").alias("retryable"),
        (F.col("_wait_all") - F.col("_wait_last")).alias("total_wait_ms"),
        (F.col("duration_ms") + F.floor(F.col("_wait_all") - F.col("_wait_last"))).cast("bigint").alias("duration_ms"),
    )


# --- D13–D16 envelopes ---------------------------------------------------------------------------


def merge_fallback(http: DataFrame, rendered: DataFrame, key: str = "req_id") -> DataFrame:
    """auto mode: the rendered result replaces the http one when the http
    status is 403/429 and the rendered side came back with a response; when
    rendering failed without one, or was not tried, the http result stays,
    even a 403. Both inputs are one row per key; after the
    per-request aggregations they are already hash-partitioned on the key,
    so the join adds no exchange."""
    r = rendered.select([F.col(c).alias("r_" + c) if c != key else F.col(c) for c in rendered.columns])
    j = http.join(r, key, "left")
    use_r = F.coalesce(F.col("status_code").isin(403, 429) & F.col("r_status_code").isNotNull(), F.lit(False))
    cols = [c for c in http.columns if c != key]
    return j.select(
        key,
        *[F.when(use_r, F.col("r_" + c)).otherwise(F.col(c)).alias(c) for c in cols],
        F.when(use_r, F.lit("playwright")).otherwise(F.lit("http")).alias("mode_used"),
    )


def merge_fallback_by_engine(both: DataFrame, key: str = "req_id", engine: str = "engine",
                             http_engine: str = "http", rendered_engine: str = "playwright") -> DataFrame:
    """``merge_fallback`` for results keyed by (request, engine) in one
    table: each request's two rows are paired by one groupBy on the request
    (one row per engine, so ``first(..., ignorenulls)`` is exact) instead of
    a self-join, and the attempt chain behind ``both`` runs once."""
    cols = [c for c in both.columns if c not in (key, engine)]
    row = F.struct(*[F.col(c) for c in cols])
    g = both.groupBy(key).agg(
        F.first(F.when(F.col(engine) == http_engine, row), ignorenulls=True).alias("_h"),
        F.first(F.when(F.col(engine) == rendered_engine, row), ignorenulls=True).alias("_r"),
    ).where(F.col("_h").isNotNull())
    use_r = F.coalesce(F.col("_h.status_code").isin(403, 429) & F.col("_r.status_code").isNotNull(), F.lit(False))
    return g.select(
        key,
        *[F.when(use_r, F.col(f"_r.{c}")).otherwise(F.col(f"_h.{c}")).alias(c) for c in cols],
        F.when(use_r, F.lit(rendered_engine)).otherwise(F.lit(http_engine)).alias("mode_used"),
    )


def outcome_envelope(df: DataFrame, debug: Column | bool = False) -> DataFrame:
    """Adds ``response_status``, ``meta_attempts`` (at least 1 on errors),
    whether headers or the stack are shown, and ``payload``: the response
    body as JSON, {meta} on success and {meta, error} on errors, nulls left
    out. With ``debug`` the columns ``response_headers`` (a map; on success)
    and ``stack`` (on errors), where there are such, are part of it."""
    dbg = debug if isinstance(debug, Column) else F.lit(bool(debug))
    err = F.col("outcome") == "error"
    attempts = F.when(err, F.greatest(F.col("attempts"), F.lit(1))).otherwise(F.col("attempts"))
    headers = F.col("response_headers") if "response_headers" in df.columns else F.lit(None).cast("map<string,string>")
    stack = F.col("stack") if "stack" in df.columns else F.lit(None).cast("string")
    meta = F.struct(
        F.col("duration_ms").alias("durationMs"), F.col("engine"), attempts.alias("attempts"), F.col("was_antibot").alias("wasAntibot"),
        F.col("status_code").alias("statusCode"), F.when(~err & dbg, headers).alias("responseHeaders"),
    )
    error = F.when(
        err, F.struct(F.col("error_code").alias("code"), F.col("error_message").alias("message"), F.col("retryable"), F.when(dbg, stack).alias("stack"))
    )
    return df.select(
        "*",
        attempts.alias("meta_attempts"),
        F.when(err, F.col("http_status")).otherwise(F.lit(200)).alias("response_status"),
        (~err & dbg).alias("shows_headers"),
        (err & dbg).alias("shows_stack"),
        F.to_json(F.struct(meta.alias("meta"), error.alias("error"))).alias("payload"),
    )


def wire_normalize(df: DataFrame, status: str = "response_status", messages: Column | None = None) -> DataFrame:
    """Any 400 leaves the service as {code: 400, 'Validation failed',
    details}, so FETCH_* codes at 400 are not visible on the wire.
    ``messages`` are the validation messages of the response, an array (one
    message alone: of one); fetch payloads carry none, and their details are
    null. Other statuses pass through."""
    is400 = F.col(status) == 400
    details = messages if messages is not None else F.lit(None).cast("array<string>")
    return (
        df.withColumn("wire_code", F.when(is400, F.lit("400")).otherwise(F.col("error_code")))
        .withColumn("wire_message", F.when(is400, F.lit("Validation failed")).otherwise(F.col("error_message")))
        .withColumn("wire_details", F.when(is400, details))
    )


def continue_on_fail(df: DataFrame, on_error: str = "continue", error: str = "error_message",
                     index: str = "item_index") -> DataFrame:
    """One output row per input row. ``continue``: a failed row becomes
    {"error": message} tied to its index; ``stop``: the job fails on the
    first failed row (raise_error inside the task)."""
    failed = F.col(error).isNotNull()
    if on_error == "stop":
        # a predicate is evaluated for every row (a dropped column would be
        # pruned away), so the first failed row fails the task and the job
        check = F.when(failed, F.raise_error(F.concat(F.lit("item failed: "), F.col(error)))).otherwise(F.lit(True))
        return df.where(check)
    return df.withColumn(
        "json",
        F.when(failed, F.to_json(F.struct(F.col(error).alias("error")))).otherwise(
            F.to_json(F.struct(*[F.col(c) for c in df.columns if c not in (error, index)]))
        ),
    )
