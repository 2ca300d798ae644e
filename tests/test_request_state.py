"""The state function of E3: all requests of a key at once (F1)."""

import random
import time

import numpy as np
import pandas as pd
import pytest


class State:
    """What the function sees of its key's state."""

    def __init__(self, watermark_ms):
        self.value, self.watermark_ms, self.hasTimedOut, self.due = None, watermark_ms, False, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def getCurrentWatermarkMs(self):
        return self.watermark_ms

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutTimestamp(self, due):
        self.due = due


def end_by_hand(attempts, max_attempts, budget_ms):
    spent = 0.0
    for i, (ok, retry, wait, took) in enumerate(attempts):
        late = spent >= budget_ms
        cut = not late and spent + (took or 0) > budget_ms
        if late or i + 1 >= max_attempts or (not cut and (ok or not retry)):
            return i
        if took is not None:
            spent += took + (wait if retry else 0.0)
    return -1


@pytest.mark.parametrize("max_attempts", [1, 3, 5])
def test_ends_of_requests(max_attempts):
    from webtide.streaming.jobs import ends_of

    rng = random.Random(max_attempts)
    requests = [[(rng.random() < 0.2, rng.random() < 0.8, rng.choice([250.0, 60_000.0]), rng.choice([None, 0, 10, 30_000, 70_000])) for _ in range(rng.randrange(7))] for _ in range(500)]
    n = np.array([len(r) for r in requests])
    ok, retry, wait, took = (np.array(x) for x in zip(*[a for r in requests for a in r]))
    waits = [wait] * (max_attempts - 1)
    got = ends_of(np.cumsum(n) - n, n, ok, retry, waits, took.astype(float), max_attempts, 60_000.0)
    assert got.tolist() == [end_by_hand(r, max_attempts, 60_000.0) for r in requests]


def test_a_key_with_many_requests():
    """Time and state of a key with 100,000 requests; held rows by the state
    as lines of JSON took over 300 bytes each, and 87 us a row."""
    from webtide.streaming.jobs import _follow

    n = 200_000
    i = np.arange(n)
    frame = pd.DataFrame({
        "bucket": 0, "clock": 0, "at": 10**15 + i * 1000, "request": pd.Series("=" + (i // 2).astype(str).astype(object)), "event_id": i, "engine": "http", "status": np.where(i % 2, 200, 503),
        "err_msg": None, "content_type": "text/html", "retry_after": None, "dur_ms": 10, "nulls": 0, "ok": i % 2 == 1, "retry": i % 2 == 0, "wait0": 250.0, "wait1": 500.0,
    })
    follow = _follow(3, 60_000.0, 7 * 864 * 10**8)
    state = State(0)
    began = time.time()
    assert list(follow((0,), iter([frame[: n // 2], frame[n // 2 :]]), state)) == []
    assert sum(len(x) for x in state.value if x) < 100 * n
    state.watermark_ms, state.hasTimedOut = (10**15 + n * 1000) // 1000, True
    out = pd.concat(list(follow((0,), iter([]), state)))
    assert time.time() - began < 10
    assert (out["kind"] == "closed").all() and sorted(out["event_id"]) == list(range(n))
    # the marks stay for the patience
    state.hasTimedOut = False
    again = frame[:2].assign(at=10**15 + n * 1000 + 5)
    assert [list(x["kind"]) for x in follow((0,), iter([again]), state)] == [["after_end"] * 2]


def test_keys_grow_with_the_log():
    from webtide.streaming.jobs import BUCKETS, buckets_for

    assert buckets_for(0) == BUCKETS
    assert 36_000_000 / buckets_for(36_000_000) <= 50_000


def test_null_and_large_numbers_come_back(spark, tmp_path):
    """Ids beyond the exact range of floats beside nulls, and null requests."""
    from datetime import datetime, timedelta

    from webtide.operators.outcomes import final_outcome
    from webtide.streaming.jobs import close_open_requests, stream_request_state

    kind = "req_id long, ts timestamp, event_id long, engine string, status int, err_msg string, content_type string, retry_after string, dur_ms long"
    t0, big = datetime(2024, 1, 1), 2**53 + 1
    rows = [(big, t0, big, "http", 503, None, None, None, None), (None, t0, None, "http", None, None, None, None, big), (big + 1, t0 + timedelta(1), 3, None, 200, None, None, "x", 10)]
    rows += [(big, t0 + timedelta(minutes=1), big + 2, "http", 200, None, None, None, 7)]
    log = spark.createDataFrame(rows, kind)
    d = str(tmp_path)
    log.coalesce(1).write.parquet(d + "/log")
    stream_request_state(spark.readStream.schema(kind).parquet(d + "/log"), d + "/out", d + "/late", d + "/ckpt", jitter=False, buckets=2)
    close_open_requests(spark, d + "/out", d + "/ckpt", jitter=False)
    want = sorted(map(tuple, final_outcome(log, jitter=False).collect()), key=str)
    assert sorted(map(tuple, spark.read.parquet(d + "/out").drop("batch").collect()), key=str) == want
