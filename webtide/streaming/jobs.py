"""Structured Streaming jobs.

The reference handles independent requests as they arrive; here that is a
stream of page files or attempt rows. Stateless jobs reuse the batch column
functions unchanged; the per-request state (E3) is keyed state with
event-time timers, and closed requests go through the batch operator. Every job writes to a
sink with a checkpoint under the shared checkpoint folder, so a restarted
query resumes where it stopped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULTS, Limits
from ..operators import gates as G
from ..operators.outcomes import backoff_ms, classify_attempts, final_outcome
from ..plans.articles import build_articles
from ..session import shared_path
from ..sources.readers import PAGE_SCHEMA


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint dir for one run."""
    return shared_path(spark, f"stream-{name}-{uuid.uuid4().hex[:12]}")


def run_available_now(df: DataFrame, out: str, ckpt: str, fmt: str = "parquet", mode: str = "append",
                      partition_by: list[str] | None = None) -> None:
    w = df.writeStream.format(fmt).option("path", out).option("checkpointLocation", ckpt).outputMode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    q = w.trigger(availableNow=True).start()
    q.awaitTermination()


def table_stream(spark: SparkSession, sf_dir: str, name: str, schema: T.StructType, **options) -> DataFrame:
    """A stream over a table that is one file or a folder of part files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
    reader = spark.readStream.schema(schema).options(**options)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(path.toString())
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


# --- E1 -----------------------------------------------------------------------------


def page_stream(spark: SparkSession, src_dir: str, glob: str = "pages*.parquet", max_bytes: int = 1 << 30) -> DataFrame:
    return (
        spark.readStream.schema(PAGE_SCHEMA)
        .option("maxBytesPerTrigger", max_bytes)
        .option("pathGlobFilter", glob)
        .parquet(src_dir)
    )


def stream_articles(pages: DataFrame, cfg: Limits = DEFAULTS) -> DataFrame:
    """The batch article row (C18, one default request per page) over
    arriving pages: stateless, append. A trigger takes a bounded number of
    bytes."""
    return build_articles(pages, cfg=cfg).withColumn("body_md5", F.md5("body"))


# --- E2 -----------------------------------------------------------------------------

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def attempt_fields(events: DataFrame) -> DataFrame:
    """Stateless per-event attempt columns (the fetch-log mapping without
    the per-user numbering): usable on a stream."""
    eid = F.col("event_id")
    et = F.col("event_type")
    status = (
        F.when(et == "error", F.when(eid % 4 == 0, 503).when(eid % 4 == 1, 429).when(eid % 4 == 2, 403).otherwise(0))
        .when(et == "signup", 404)
        .otherwise(200)
    )
    msg = F.when(
        (et == "error") & (eid % 4 == 3),
        F.when(eid % 5 == 0, "Timeout").when(eid % 5 == 1, "net::ERR_CONNECTION_REFUSED")
        .when(eid % 5 == 2, "SSRF blocked").when(eid % 5 == 3, "Too many redirects").otherwise("Something went wrong"),
    )
    ct = (
        F.when(eid % 6 == 0, "text/html; charset=utf-8").when(eid % 6 == 1, "application/rss+xml")
        .when(eid % 6 == 2, "IMAGE/PNG").when(eid % 6 == 3, "application/json").when(eid % 6 == 4, "application/pdf")
    )
    ra = F.when(eid % 5 == 0, "2").when(eid % 5 == 1, "999999").when(eid % 5 == 2, "0")
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(eid % 2 == 0, "http").otherwise("playwright").alias("engine"),
        status.alias("status"),
        msg.alias("err_msg"),
        ct.alias("content_type"),
        ra.alias("retry_after"),
        F.floor(F.col("value") * 1000).cast("bigint").alias("dur_ms"),
    )


def stream_outcomes(attempts: DataFrame, window: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Tumbling-window attempt counts by engine and outcome code;
    late rows (behind the watermark) are dropped; append emits closed
    windows only."""
    c = classify_attempts(attempts)
    code = F.coalesce(F.col("error_code"), F.lit("OK"))
    return (
        c.withWatermark("ts", delay)
        .groupBy(F.window("ts", window).alias("w"), "engine", code.alias("code"))
        .agg(F.count(F.lit(1)).alias("attempts"), F.sum(F.col("antibot").cast("int")).alias("antibot"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "engine", "code",
                "attempts", "antibot")
    )


# --- E3 -----------------------------------------------------------------------------

ATTEMPT = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("engine", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("err_msg", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("retry_after", T.StringType()),
        T.StructField("dur_ms", T.LongType()),
    ]
)
#: State of a bucket of requests, as Arrow streams: the attempts that are not
#: judged yet, and the requests that have ended, with the time of their last
#: attempt.
STATE = "held binary, closed binary"
BUCKETS = 64
#: Longest pause between two attempts of a request, and disorder of the log.
PATIENCE, DELAY = "7 days", "1 hour"
PUT_OFF = "3650 days"
#: What an attempt carries through the state besides its request and time.
#: Numbers are never null there (pandas would make them floats); ``nulls``
#: says which of them were.
CARRIED = "at long, request string, event_id long, engine string, status int, err_msg string, content_type string, retry_after string, dur_ms long, nulls int"
NULLABLE = ("event_id", "status", "dur_ms")


def ends_of(first, n, ok, retry, waits, took, max_attempts: int, budget_ms: float):
    """For each request the index of the attempt that ends it, or -1: the
    first success, error that is not retried, attempt past the deadline or
    last attempt allowed. A request has ``n`` attempts, in order, from row
    ``first`` on; of a row are given ok, retry, the waits after it by its
    number, and the duration (NaN: unknown)."""
    import numpy as np

    end, spent = np.full(len(n), -1), np.zeros(len(n))
    going = np.arange(len(n))
    for i in range(max_attempts):
        going = going[n[going] > i]
        if not len(going):
            break
        row = first[going] + i
        dur, again = took[row], retry[row]
        late = spent[going] >= budget_ms
        cut = ~late & (spent[going] + np.nan_to_num(dur) > budget_ms)
        stop = late | (i + 1 >= max_attempts) | (~cut & (ok[row] | ~again))
        end[going[stop]] = i
        going, row, dur, again = (x[~stop] for x in (going, row, dur, again))
        if len(going):
            spent[going] += np.nan_to_num(dur + np.where(again, waits[i][row], 0.0))
    return end


def _micros(duration: str) -> int:
    """A duration such as ``7 days`` in microseconds."""
    n, unit = duration.split()
    return int(n) * {"second": 10**6, "minute": 6 * 10**7, "hour": 36 * 10**8, "day": 864 * 10**8}[unit.rstrip("s")]


def _to_stream(frame) -> bytes:
    import pyarrow as pa

    table = pa.Table.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _from_stream(data):
    import pyarrow as pa

    return pa.ipc.open_stream(pa.py_buffer(data)).read_pandas()


def _follow(max_attempts: int, budget_ms: float, patience: int):
    """The requests of one bucket. Attempts wait until the watermark has
    passed them, so they are judged in the order of their times whatever the
    order in which they came."""
    carried = [f.split()[0] for f in CARRIED.split(", ")]

    def follow(key, frames, state):
        import numpy as np
        import pandas as pd

        now = state.getCurrentWatermarkMs() * 1000
        old, ended = state.get if state.exists else (None, None)
        fresh = [] if state.hasTimedOut else [f.drop(columns=["bucket", "clock"]) for f in frames]
        for frame in fresh:
            late = frame[(frame["at"] <= now).to_numpy()]
            if len(late):
                yield late[carried].assign(kind="late")
        parts = [_from_stream(old)] if old else []
        parts += [x for x in (f[(f["at"] > now).to_numpy()] for f in fresh) if len(x)]
        marks = _from_stream(ended) if ended else pd.DataFrame({"request": np.array([], object), "last": np.array([], np.int64)})
        marks = marks[(marks["last"] + patience >= now).to_numpy()]
        due = []
        if parts:
            rows = pd.concat(parts, ignore_index=True)
            code, names = pd.factorize(np.concatenate([rows["request"].to_numpy(object), marks["request"].to_numpy(object)]))
            code, marked = code[: len(rows)], code[len(rows) :]
            # a null event_id is first
            order = np.lexsort((rows["event_id"], rows["nulls"] & 1 ^ 1, rows["at"], code))
            rows, code = rows.take(order), code[order]
            at = rows["at"].to_numpy(np.int64)
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            n = np.diff(np.append(first, len(code)))
            ready = np.add.reduceat((at <= now).astype(np.int64), first)
            last = at[first + n - 1]
            over = np.isin(code[first], marked)
            took = np.where(rows["nulls"] & 4, np.nan, rows["dur_ms"])
            ok, retry = (rows[c].to_numpy(bool) for c in ("ok", "retry"))
            waits = [rows[f"wait{i}"].to_numpy(float) for i in range(max_attempts - 1)]
            end = ends_of(first, np.where(over, 0, ready), ok, retry, waits, took, max_attempts, budget_ms)
            # no further attempt came in time
            limit = at[first + np.maximum(ready, 1) - 1] + patience
            following = at[first + np.minimum(ready, n - 1)]
            idle = ~over & (end < 0) & (ready > 0) & (limit < now) & ((ready == n) | (following > limit))
            end = np.where(idle, ready - 1, end)
            done = over | (end >= 0)
            place = np.arange(len(code)) - np.repeat(first, n)
            kind = np.where(place <= np.repeat(end, n), "closed", "after_end").astype(object)
            gone = np.repeat(done, n)
            if gone.any():
                yield rows[gone][carried].assign(kind=kind[gone])
            rows = rows[~gone]
            if done.any():
                marks = pd.concat([marks, pd.DataFrame({"request": names[code[first[done]]], "last": last[done]})]).groupby("request", sort=False, as_index=False)["last"].max()
            still = np.where(ready < n, following, last + patience + 1)[~done]
            due += [int(still.min())] if len(still) else []
        else:
            rows = ()
        if not (len(rows) or len(marks)):
            state.remove()
            return
        due += [int(marks["last"].min()) + patience + 1] if len(marks) else []
        state.update((_to_stream(rows) if len(rows) else None, _to_stream(marks) if len(marks) else None))
        state.setTimeoutTimestamp(max(min(due) // 1000, now // 1000 + 1))

    return follow


def buckets_for(rows: int) -> int:
    """Keys of the state for a log of so many attempts."""
    return max(BUCKETS, rows // 50_000)


def request_events(attempts: DataFrame, cfg: Limits = DEFAULTS, timeout_secs: int = DEFAULTS.fetch_timeout_secs,
                   delay: str = DELAY, patience: str = PATIENCE, jitter: bool = True, buckets: int = BUCKETS) -> DataFrame:
    """Attempts (``CARRIED``) with their kind: ``closed``, those of a request
    up to the one that ended it; ``late``, an attempt behind the watermark;
    ``after_end``, one that came after the request had ended.

    Keyed state with event-time timers: for each request its attempts until
    they can be judged, then for ``patience`` a mark that it has ended. A call
    of the state function costs far more than a request, so requests share
    ``buckets`` keys by a hash of their id, and a call judges all requests of
    its key at once; take so many that what a key holds is small in memory
    (``buckets_for``). A request
    that got no further attempt for ``patience`` is closed as it stands. An
    abort by the caller is an attempt row with the message 'Request aborted';
    it ends the request like any error that is not retried."""
    max_attempts = max(1, cfg.max_attempts)
    # Spark drops what is behind the watermark before a state function sees it;
    # with the time and the delay both put off, the watermark is the same and
    # late attempts get through
    clock = attempts.withColumn("clock", F.col("ts") + F.expr(f"interval {PUT_OFF}")).withWatermark("clock", f"{PUT_OFF} {delay}")
    c = classify_attempts(clock, cfg)
    # the place of an attempt in its request is known in the state only
    waits = [F.coalesce("retry_after_ms", backoff_ms(F.lit(i), cfg, F.col("req_id") if jitter else None)) for i in range(max_attempts - 1)]
    no_time = F.raise_error(F.lit("an attempt has no time")).cast("bigint")
    typed = {f.name: F.col(f.name).cast(f.dataType) for f in ATTEMPT.fields}
    nulls = sum((F.when(typed[x].isNull(), 1 << i).otherwise(0) for i, x in enumerate(NULLABLE)), F.lit(0))
    rows = c.select(
        F.pmod(F.xxhash64("req_id"), F.lit(buckets)).alias("bucket"), "clock", F.coalesce(F.unix_micros("ts"), no_time).alias("at"),
        F.coalesce(F.concat(F.lit("="), F.col("req_id").cast("string")), F.lit("")).alias("request"),
        *[(F.coalesce(typed[x], F.lit(0)) if x in NULLABLE else typed[x]).alias(x) for x in ATTEMPT.names if x != "ts"], nulls.alias("nulls"),
        F.col("error_message").isNull().alias("ok"), "retry", *[w.alias(f"wait{i}") for i, w in enumerate(waits)],
    )
    return rows.groupBy("bucket").applyInPandasWithState(
        _follow(max_attempts, timeout_secs * 1000.0, _micros(patience)), f"{CARRIED}, kind string", STATE, "append", "EventTimeTimeout",
    )


def attempt_rows(events: DataFrame, req_type: str, *keep: str) -> DataFrame:
    """The attempts as they were in the log."""
    values = {"ts": F.timestamp_micros("at")} | {x: F.when(F.col("nulls").bitwiseAND(1 << i) == 0, F.col(x)) for i, x in enumerate(NULLABLE)}
    req = F.when(F.col("request") != "", F.substring("request", 2, 2**31 - 1)).cast(req_type)
    return events.select(*keep, req.alias("req_id"), *[values.get(x, F.col(x)).alias(x) for x in ATTEMPT.names])


def stream_request_state(attempts: DataFrame, out: str, late: str, ckpt: str, cfg: Limits = DEFAULTS,
                         timeout_secs: int = DEFAULTS.fetch_timeout_secs, delay: str = DELAY, patience: str = PATIENCE,
                         jitter: bool = True, buckets: int = BUCKETS) -> None:
    """The final outcome of each request over an attempt stream (rows
    carry req_id), once, as soon as the watermark has passed the attempt that
    ends it. The attempts of closed requests go through the batch operator
    (D10), so stream and batch cannot differ. Attempts behind the watermark
    and those of closed requests go to ``late`` with the reason. Each
    micro-batch overwrites a folder named by its id, so a replayed batch is
    idempotent; a restarted query goes on from its checkpoint, with the same
    ``buckets``."""

    def per_batch(events: DataFrame, batch_id: int) -> None:
        events = events.persist()
        try:
            final_outcome(attempt_rows(events.where("kind = 'closed'"), req_type), cfg, jitter, timeout_secs).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
            attempt_rows(events.where("kind <> 'closed'"), req_type, "kind").write.mode("overwrite").parquet(f"{late}/batch={batch_id}")
        finally:
            events.unpersist()

    req_type = attempts.schema["req_id"].dataType.simpleString()
    events = request_events(attempts, cfg, timeout_secs, delay, patience, jitter, buckets)
    q = events.writeStream.foreachBatch(per_batch).outputMode("append").option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()


def _held_rows(batches):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    carried = pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in CARRIED.split(", "))])
    for batch in batches:
        for data in batch.column(0).to_pylist():
            # a column of nulls has no type in pandas
            yield from pa.ipc.open_stream(pa.py_buffer(data)).read_all().select(carried.names).cast(carried).to_batches()


def close_open_requests(spark: SparkSession, out: str, ckpt: str, cfg: Limits = DEFAULTS,
                        timeout_secs: int = DEFAULTS.fetch_timeout_secs, jitter: bool = True, req_type: str = "bigint") -> None:
    """At the end of a log: the outcomes of the requests that the state store
    of a stopped ``stream_request_state`` still holds open, as they stand.
    They are those with no attempt that ends them, and those whose last
    attempts the watermark had not reached."""
    state = spark.read.format("statestore").load(ckpt)
    still = state.select(F.col("value.groupState.held").alias("held")).where("held is not null").mapInArrow(_held_rows, CARRIED)
    final_outcome(attempt_rows(still, req_type), cfg, jitter, timeout_secs).write.mode("overwrite").parquet(f"{out}/batch=-1")


# --- E4 / E5 -------------------------------------------------------------------------


def stream_quarantine(requests: DataFrame, resolved: DataFrame, allowed: list[str], good_path: str, bad_path: str, ckpt: str,
                      cfg: Limits = DEFAULTS) -> None:
    """The gates B1–B15 on a stream of requests and their responses.
    Valid rows and redirects go to one sink, dead letters with gate, code and
    reason to the other, from one cached micro-batch; the addresses are a
    static table. Each write lands in a folder named by the batch id and
    overwrites it, so a replayed batch is idempotent."""

    def per_batch(df: DataFrame, batch_id: int) -> None:
        v = G.gate_lanes(df, resolved, allowed, cfg.max_response_bytes).drop("html").persist()
        try:
            v.where("lane <> 'invalid'").write.mode("overwrite").parquet(f"{good_path}/batch={batch_id}")
            v.where("lane = 'invalid'").write.mode("overwrite").parquet(f"{bad_path}/batch={batch_id}")
        finally:
            v.unpersist()

    q = requests.writeStream.foreachBatch(per_batch).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()


def stream_blocklist(links: DataFrame, blocklist: DataFrame, host: str = "host", domain: str = "domain") -> DataFrame:
    """E5: tracker anti-join of a link stream against a static list."""
    return G.tracker_antijoin(links, blocklist, host, domain)
