"""Registered streaming and extension queries.

Each streaming query runs its stream to completion (``availableNow``) into
a fresh folder under the shared checkpoint dir and returns the sink read
back as a DataFrame.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import url_parts
from ..operators.extension import StdlibExtractor, extract
from ..operators.extraction import page_links
from ..session import cut_lineage, pages_table, table
from ..sources.fixtures import GATED_REQUESTS, Fixtures
from ..operators.outcomes import final_outcome
from ..sources.readers import PAGE_SCHEMA, scan_objects
from ..sources.sinks import write_articles, write_outcomes
from ..streaming import jobs as J
from .queries_gates import ALLOWED_PAGE_FIELDS, tracker_inputs
from .queries_pages import _articles


def q_stream_articles(spark: SparkSession, sf: str) -> DataFrame:
    d = J.run_dir(spark, "articles")
    s = J.table_stream(spark, sf, "pages", PAGE_SCHEMA, maxBytesPerTrigger=1 << 30)
    J.run_available_now(J.stream_articles(s), os.path.join(d, "out"), os.path.join(d, "ckpt"))
    return spark.read.parquet(os.path.join(d, "out")).select(
        "page_id", "url", "title", "description", "date", "author", "image", "favicon", "type", "source", "lang",
        "word_count", "read_time_min", "ttr", "n_links", "error_code", "body_md5",
    )


def q_write_articles(spark: SparkSession, sf: str) -> DataFrame:
    """A4: article rows written and read back."""
    path = os.path.join(J.run_dir(spark, "sink-articles"), "out")
    write_articles(_articles(spark, sf), path)
    back = spark.read.parquet(path)
    return back.select("req_id", "url", "title", "word_count", "error_code", "error_message", F.md5("body").alias("body_md5"))


def q_write_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """A5: outcomes written to two sinks and read back."""
    d = J.run_dir(spark, "sink-outcomes")
    ok, err = os.path.join(d, "ok"), os.path.join(d, "err")
    write_outcomes(final_outcome(Fixtures(spark, sf).fetch_log(), jitter=False), ok, err)
    cols = ["req_id", "outcome", "status_code", "error_code", "attempts", "duration_ms"]
    return spark.read.parquet(ok).select(F.lit("ok").alias("sink"), *cols).unionByName(spark.read.parquet(err).select(F.lit("err").alias("sink"), *cols))


# objects of the manifest query, and a cap that some of them are over
OBJECTS, OBJECT_CAP = 40, 32_768


def q_scan_objects(spark: SparkSession, sf: str) -> DataFrame:
    """A3: the pages' HTML written as text objects, one for each of 40
    groups of pages, and the manifest of these files."""
    path = os.path.join(J.run_dir(spark, "objects"), "out")
    pages = table(spark, sf, "pages").select("html", F.pmod("page_id", F.lit(OBJECTS)).alias("object"))
    pages.where("html is not null").repartition(OBJECTS, "object").write.partitionBy("object").text(path)
    m = scan_objects(spark, f"{path}/*/*.txt", request_cap=OBJECT_CAP)
    return m.select(F.regexp_extract("path", "object=([0-9]+)", 1).cast("bigint").alias("object"), "length", "within_cap")


def q_extract(spark: SparkSession, sf: str) -> DataFrame:
    """the default extractor behind the interface."""
    return extract(pages_table(spark, sf)).select("page_id", "url", "title", "lang", "has_content", "n_links", F.md5("markdown").alias("md_md5"))


def q_stream_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    from ..session import utc

    utc(spark)
    d = J.run_dir(spark, "outcomes")
    # part files are in no order of time: one trigger takes them all
    ev = J.table_stream(spark, sf, "events", J.EVENT_SCHEMA)
    J.run_available_now(J.stream_outcomes(J.attempt_fields(ev)), os.path.join(d, "out"), os.path.join(d, "ckpt"))
    return spark.read.parquet(os.path.join(d, "out"))


def q_stream_request_state(spark: SparkSession, sf: str) -> DataFrame:
    """E3 with its default delay and patience. The log arrives in two
    parts, the second later than the first; the stream is stopped and
    restarted between them, and what is open at the end of the log is read
    from its state."""
    d = J.run_dir(spark, "state")
    src, out, late, ckpt = (os.path.join(d, x) for x in ("log", "out", "late", "ckpt"))
    log = cut_lineage(Fixtures(spark, sf).fetch_log())
    first, last, rows = log.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts")), F.count("ts")).first()
    cuts = [first, first + (last - first) // 2 + 1, last + 1] if first is not None else [0, 1]
    for a, b in zip(cuts, cuts[1:]):
        log.where(F.unix_micros("ts").between(a, b - 1)).write.mode("append").parquet(src)
        J.stream_request_state(spark.readStream.schema(log.schema).parquet(src), out, late, ckpt, jitter=False, buckets=J.buckets_for(rows))
    J.close_open_requests(spark, out, ckpt, jitter=False)
    return spark.read.parquet(out).drop("batch")


def q_stream_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    d = J.run_dir(spark, "quarantine")
    pages = J.table_stream(spark, sf, "pages", PAGE_SCHEMA)
    reqs = spark.sql(GATED_REQUESTS, pages=pages)
    good, bad = os.path.join(d, "good"), os.path.join(d, "bad")
    addresses = cut_lineage(Fixtures(spark, sf).page_addresses())
    J.stream_quarantine(reqs, addresses, ALLOWED_PAGE_FIELDS, good, bad, os.path.join(d, "ckpt"))
    cols = ["req_id", "lane", "gate", "error_code", "error_message", "details"]
    return spark.read.parquet(good).select(*cols).unionByName(spark.read.parquet(bad).select(*cols))


def q_stream_blocklist(spark: SparkSession, sf: str) -> DataFrame:
    d = J.run_dir(spark, "blocklist")
    pages = J.table_stream(spark, sf, "pages", PAGE_SCHEMA)
    links = page_links(pages).withColumn("host", url_parts(F.col("href"))["host"])
    _, bl = tracker_inputs(spark, sf)
    out = J.stream_blocklist(links, bl).select("page_id", "pos", "host")
    J.run_available_now(out, os.path.join(d, "out"), os.path.join(d, "ckpt"))
    return spark.read.parquet(os.path.join(d, "out"))


def q_extract_stdlib(spark: SparkSession, sf: str) -> DataFrame:
    return extract(pages_table(spark, sf), StdlibExtractor())


# F2 example rules: they take over an element that a built-in rule has, and
# one that would lose its markers
EXTRA_RULES = [(r"(?i)<hr\b[^>]*>", "\n\n***\n\n"), (r"(?is)<mark\b[^>]*>(.*?)</mark>", "=={1}==")]


def q_markdown_extra_rules(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.markdown import to_markdown
    from ..operators.extraction import main_content

    m = main_content(Fixtures(spark, sf).rich_pages())
    md = to_markdown("content_html", EXTRA_RULES)
    return m.select("page_id", md.alias("markdown")).select("page_id", F.md5("markdown").alias("md_md5"))


QUERIES = {
    "scan_objects": q_scan_objects,
    "write_articles": q_write_articles,
    "write_outcomes": q_write_outcomes,
    "stream_articles": q_stream_articles,
    "stream_outcomes": q_stream_outcomes,
    "stream_request_state": q_stream_request_state,
    "stream_quarantine": q_stream_quarantine,
    "stream_blocklist": q_stream_blocklist,
    "extract": q_extract,
    "extract_stdlib": q_extract_stdlib,
    "markdown_extra_rules": q_markdown_extra_rules,
}
