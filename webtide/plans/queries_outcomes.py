"""Registered outcome / retry / log queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..operators import outcomes as O
from ..operators.chunks import assemble_chunks, chunk_limit, object_status
from ..operators.logs import in_flight, outcome_rollup, shape_access_log
from ..operators.redirects import resolve_redirects
from ..session import table
from ..sources.fixtures import Fixtures

# byte cap for the chunk-limit query: the 512-character chunks of the page
# fixture cross it mid-page (the 10 MiB default never would)
CHUNK_FIXTURE_CAP = 4096

# [ours] message variants for the block-signal query
def block_suffix():
    return (
    F.when(F.col("event_id") % 9 == 0, F.lit(" (Cloudflare challenge)"))
    .when(F.col("event_id") % 9 == 1, F.lit(" captcha required"))
    .when(F.col("event_id") % 9 == 2, F.lit(" Access Denied"))
    .when(F.col("event_id") % 9 == 3, F.lit(" bot detection triggered"))
    .when(F.col("event_id") % 9 == 4, F.lit(" Security check"))
    .when(F.col("event_id") % 9 == 5, F.lit(" reCAPTCHA"))
    .otherwise(F.lit(""))
    )


def _log(spark, sf) -> DataFrame:
    return Fixtures(spark, sf).fetch_log()


def _classified(spark, sf) -> DataFrame:
    return O.classify_attempts(_log(spark, sf))


def q_fetch_error_code(spark: SparkSession, sf: str) -> DataFrame:
    return _classified(spark, sf).select(
        "event_id", "error_message", "err_status", "error_code", "error_http", "error_retryable"
    )


def q_page_error_code(spark: SparkSession, sf: str) -> DataFrame:
    c = _classified(spark, sf).where(F.col("error_message").isNotNull())
    pe = O.page_error_code(F.col("error_message"))
    return c.select("event_id", pe["code"].alias("page_code"), pe["message"].alias("page_message"),
                    pe["details"].alias("details"))


def q_file_error_code(spark: SparkSession, sf: str) -> DataFrame:
    c = _classified(spark, sf).where(F.col("error_message").isNotNull())
    ab = F.when(F.col("event_id") % 13 == 0, F.lit("caller")).when(F.col("event_id") % 17 == 0, F.lit("timer"))
    fe = O.file_error_code(F.col("error_message"), aborted_by=ab)
    return c.select("event_id", fe["code"].alias("file_code"), fe["message"].alias("file_message"),
                    fe["http_status"].alias("file_http"))


def q_retry_decision(spark: SparkSession, sf: str) -> DataFrame:
    return _classified(spark, sf).select("event_id", "retry", "antibot", "retry_after_ms")


def q_block_signal(spark: SparkSession, sf: str) -> DataFrame:
    c = _classified(spark, sf).withColumn("msg", F.concat(F.coalesce("error_message", F.lit("ok")), block_suffix()))
    from ..functions.patterns import PAGE_BLOCK_WORDS

    return c.select(
        "event_id", "msg",
        O.block_signal(F.col("msg")).alias("fetch_block"),
        O.block_signal(F.col("msg"), PAGE_BLOCK_WORDS, lower=False).alias("page_block_strict"),
        O.block_signal(F.col("msg"), PAGE_BLOCK_WORDS, lower=True).alias("page_block_lower"),
    )


def retry_after_values(log: DataFrame) -> DataFrame:
    """[ours] Retry-After values: the log's seconds plus HTTP dates from 30 s
    before to 90 s after the attempt, and junk."""
    secs = (F.col("event_id") % 120) - 30
    date = F.concat(
        F.date_format(F.col("ts") + F.make_interval(secs=secs.cast("int")), "EEE, dd MMM yyyy HH:mm:ss"),
        F.lit(" GMT"),
    )
    v = (
        F.when(F.col("event_id") % 7 == 3, date)
        .when(F.col("event_id") % 7 == 5, F.lit("soon"))
        .when(F.col("event_id") % 7 == 6, F.lit(" 1.5 "))
        .otherwise(F.col("retry_after"))
    )
    return log.withColumn("ra_value", v)


def q_retry_after_ms(spark: SparkSession, sf: str) -> DataFrame:
    r = retry_after_values(_log(spark, sf))
    return r.select("event_id", "ra_value", O.retry_after_ms(F.col("ra_value"), F.col("ts")).alias("retry_after_ms"))


def _chain(spark, sf, jitter=False) -> DataFrame:
    return O.attempt_chain(_log(spark, sf), DEFAULTS, jitter=jitter)


def q_attempt_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return O.number_attempts(_log(spark, sf)).select("req_id", "event_id", F.col("attempt_no").cast("int"))


def q_running_block_flag(spark: SparkSession, sf: str) -> DataFrame:
    c = O.running_block_flag(O.classify_attempts(O.number_attempts(_log(spark, sf))))
    return c.select("req_id", "event_id", "antibot", "was_antibot")


def q_wait_profile(spark: SparkSession, sf: str) -> DataFrame:
    return _chain(spark, sf).select("req_id", "event_id", F.col("attempt_no").cast("int"), "wait_ms")


def q_deadline_budget(spark: SparkSession, sf: str) -> DataFrame:
    return _chain(spark, sf).select("req_id", "event_id", "elapsed_before_ms", "deadline_hit", "cut_in_flight", "dur_ms", "error_message")


def _final(spark, sf, log=None) -> DataFrame:
    return O.final_outcome(log if log is not None else _log(spark, sf), DEFAULTS, jitter=False)


def q_final_outcome(spark: SparkSession, sf: str) -> DataFrame:
    return _final(spark, sf)


def q_merge_fallback(spark: SparkSession, sf: str) -> DataFrame:
    # one attempt chain keyed by (request, engine) gives both results
    both = O.final_outcome(_log(spark, sf), DEFAULTS, jitter=False, req=["req_id", "engine"])
    m = O.merge_fallback_by_engine(both)
    return m.select("req_id", "mode_used", "outcome", "status_code", "error_code", "attempts")


def _envelope(spark, sf) -> DataFrame:
    fr = Fixtures(spark, sf).fetch_requests().select("req_id", F.coalesce(F.col("debug") == F.lit(True), F.lit(False)).alias("debug"))
    final = _final(spark, sf).join(fr, "req_id", "left").withColumns({
        "response_headers": F.create_map(F.lit("x-attempts"), F.col("attempts").cast("string"), F.lit("x-engine"), F.col("engine")),
        "stack": F.concat(F.lit("Error: "), F.col("error_message")),
    })
    return O.outcome_envelope(final, F.coalesce(F.col("debug"), F.lit(False)))


def q_outcome_envelope(spark: SparkSession, sf: str) -> DataFrame:
    return _envelope(spark, sf).select(
        "req_id", "outcome", "meta_attempts", "response_status", "shows_headers", "shows_stack", "error_code",
        F.get_json_object("payload", "$.meta.attempts").cast("int").alias("payload_attempts"),
        F.get_json_object("payload", "$.meta.durationMs").cast("bigint").alias("payload_duration_ms"),
        F.get_json_object("payload", "$.error.code").alias("payload_code"),
        F.get_json_object("payload", "$.meta.responseHeaders.x-attempts").alias("payload_header"),
        F.get_json_object("payload", "$.error.stack").alias("payload_stack"),
    )


def q_wire_normalize(spark: SparkSession, sf: str) -> DataFrame:
    w = O.wire_normalize(_envelope(spark, sf))
    return w.select("req_id", "response_status", "wire_code", "wire_message", F.array_join("wire_details", "; ").alias("wire_details"))


def q_continue_on_fail(spark: SparkSession, sf: str) -> DataFrame:
    f = _final(spark, sf).select(
        F.col("req_id").alias("item_index"), "attempts", F.coalesce("status_code", F.lit(0)).alias("status_code"),
        "error_message",
    )
    return O.continue_on_fail(f).select("item_index", "json")


def q_resolve_redirects(spark: SparkSession, sf: str) -> DataFrame:
    fx = Fixtures(spark, sf)
    starts = table(spark, sf, "pages").select("page_id", "url")
    return resolve_redirects(starts, fx.hop())


def q_access_log(spark: SparkSession, sf: str) -> DataFrame:
    s = shape_access_log(Fixtures(spark, sf).access_raw())
    return s.select(
        "event_id", "level", "path", "status",
        F.col("headers")["authorization"].alias("auth_header"),
        F.col("headers")["x-api-key"].alias("api_key_header"),
        F.col("headers")["user-agent"].alias("ua_header"),
    )


def q_outcome_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return outcome_rollup(_final(spark, sf))


def request_spans(log: DataFrame) -> DataFrame:
    """Start and end (µs) of each request: first attempt start, last
    attempt end."""
    return log.groupBy("req_id").agg(
        F.min(F.unix_micros("ts")).alias("start_us"),
        F.max(F.unix_micros("ts") + F.col("dur_ms") * 1000).alias("end_us"),
    )


def q_in_flight(spark: SparkSession, sf: str) -> DataFrame:
    return in_flight(request_spans(_log(spark, sf)))


def _chunks(spark, sf) -> DataFrame:
    return Fixtures(spark, sf).chunks().withColumnRenamed("chunk", "data")


def q_chunk_limit(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_limit(_chunks(spark, sf), CHUNK_FIXTURE_CAP).select(
        "object_id", F.col("seq").cast("int").alias("seq"), "n_bytes", "running_bytes", "emitted"
    )


def q_object_status(spark: SparkSession, sf: str) -> DataFrame:
    return object_status(_chunks(spark, sf), CHUNK_FIXTURE_CAP)


def q_assemble_chunks(spark: SparkSession, sf: str) -> DataFrame:
    lim = chunk_limit(_chunks(spark, sf)).where("emitted")
    a = assemble_chunks(lim)
    return a.select("object_id", F.col("n_chunks").cast("bigint").alias("n_chunks"), "n_bytes",
                    F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


QUERIES = {
    "fetch_error_code": q_fetch_error_code,
    "page_error_code": q_page_error_code,
    "file_error_code": q_file_error_code,
    "retry_decision": q_retry_decision,
    "block_signal": q_block_signal,
    "retry_after_ms": q_retry_after_ms,
    "attempt_numbers": q_attempt_numbers,
    "running_block_flag": q_running_block_flag,
    "wait_profile": q_wait_profile,
    "deadline_budget": q_deadline_budget,
    "final_outcome": q_final_outcome,
    "merge_fallback": q_merge_fallback,
    "outcome_envelope": q_outcome_envelope,
    "wire_normalize": q_wire_normalize,
    "continue_on_fail": q_continue_on_fail,
    "resolve_redirects": q_resolve_redirects,
    "access_log": q_access_log,
    "outcome_rollup": q_outcome_rollup,
    "in_flight": q_in_flight,
    "chunk_limit": q_chunk_limit,
    "object_status": q_object_status,
    "assemble_chunks": q_assemble_chunks,
}
