"""Log operators: access-log shaping (D17), outcome rollup (D18), in-flight
load (D19)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P


DEFAULT_HEADER_COLS = {"auth_header": "authorization", "api_key_header": "x-api-key", "ua_header": "user-agent"}


def shape_access_log(log: DataFrame, production: bool = True, header_cols: dict | None = None,
                     error: str | None = None) -> DataFrame:
    """level by status (≥500 or an error → error, ≥400 → warn, else info);
    any URL with ``/health`` in it dropped in production; path = url before '?'; the
    authorization and x-api-key headers redacted."""
    st = F.col("status")
    err = F.col(error).isNotNull() if error else F.lit(False)
    level = F.when((st >= 500) | err, F.lit("error")).when(st >= 400, F.lit("warn")).otherwise(F.lit("info"))
    path = F.split_part(F.col("url"), F.lit("?"), F.lit(1))
    kv = []
    for c, name in (header_cols or DEFAULT_HEADER_COLS).items():
        kv += [F.lit(name), F.col(c)]
    headers = F.transform_values(
        F.create_map(*kv),
        lambda k, v: F.when(k.isin(*P.REDACTED_HEADERS) & v.isNotNull(), F.lit(P.REDACTED)).otherwise(v),
    )
    out = log.withColumn("level", level).withColumn("path", path).withColumn("headers", headers)
    if production:
        out = out.where(~F.coalesce(F.col("url").contains("/health"), F.lit(False)))
    return out


def outcome_rollup(outcomes: DataFrame) -> DataFrame:
    """Requests, success / anti-bot rates, mean attempts and exact duration
    percentiles by (engine, error code) with subtotals.

    Outcomes are first counted by engine, code and whole millisecond, with
    map-side combine; durations end with the deadline and the waits, so
    that histogram, which the subtotals are made from, stays small whatever
    the number of requests."""
    ok = (F.col("outcome") == "success").cast("long")
    counted = outcomes.groupBy("engine", "error_code", "duration_ms").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(ok).alias("ok"),
        F.sum(F.col("was_antibot").cast("long")).alias("blocked"),
        F.sum(F.col("attempts").cast("long")).alias("attempts"),
    )
    share = lambda c: F.round(F.sum(c).cast("double") / F.sum("n"), 6)
    ms = F.col("duration_ms").cast("double")
    return counted.rollup("engine", "error_code").agg(
        F.grouping_id().cast("int").alias("gid"),
        F.sum("n").alias("requests"),
        F.sum("ok").cast("bigint").alias("successes"),
        share("ok").alias("success_rate"),
        share("blocked").alias("block_rate"),
        share("attempts").alias("mean_attempts"),
        F.round(F.percentile(ms, F.lit(0.5), F.col("n")), 3).alias("p50_ms"),
        F.round(F.percentile(ms, F.lit(0.95), F.col("n")), 3).alias("p95_ms"),
    )


def in_flight(spans: DataFrame, start: str = "start_us", end: str = "end_us", bucket_seconds: int = 60) -> DataFrame:
    """Active requests per time bucket: +1 at start, −1 at end, summed per
    bucket first (partial aggregation), then a running sum, clamped so the
    count never goes below 0. The running sum and its minimum are taken
    within each day; a second window over one row per day carries them on,
    so no task sees all buckets."""
    us = bucket_seconds * 1_000_000
    # both events of a span from one pass over the spans
    ev = spans.select(
        F.explode(
            F.array(
                F.struct(F.floor(F.col(start) / us).alias("bucket"), F.lit(1).alias("d")),
                F.struct(F.floor(F.col(end) / us).alias("bucket"), F.lit(-1).alias("d")),
            )
        ).alias("e")
    ).select("e.bucket", "e.d")
    per = ev.groupBy("bucket").agg(F.sum("d").cast("bigint").alias("delta"))
    per = per.withColumn("_day", F.floor(F.col("bucket") * bucket_seconds / 86_400))
    w = Window.partitionBy("_day").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = per.withColumn("_s", F.sum("delta").over(w)).withColumn("_m", F.min("_s").over(w))
    days = s.groupBy("_day").agg(F.sum("delta").alias("_d"), F.min("_s").alias("_low"))
    earlier = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)  # one row per day
    days = days.withColumn("_before", F.coalesce(F.sum("_d").over(earlier), F.lit(0)))
    days = days.withColumn("_floor", F.min(F.col("_before") + F.col("_low")).over(earlier)).select("_day", "_before", "_floor")
    j = s.join(days, "_day")
    total, low = F.col("_s") + F.col("_before"), F.least(F.lit(0), F.col("_m") + F.col("_before"), F.col("_floor"))
    return j.select(F.col("bucket").cast("bigint").alias("bucket"), "delta", (total - low).cast("bigint").alias("active"))
