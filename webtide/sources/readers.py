"""Sources (A1–A3): page tables, request tables with defaults, binary objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULTS, Limits

PAGE_SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """(page_id, url, html) with a declared schema (no inference); extra
    columns in the files are pruned at the scan."""
    return spark.read.schema(PAGE_SCHEMA).format(fmt).load(path).select("page_id", "url", "html")


def _or_default(c: Column, default) -> Column:
    """JavaScript ``x || default``: null, '' and 0 count as missing."""
    if isinstance(default, str):
        return F.coalesce(F.when(c != "", c), F.lit(default))
    return F.coalesce(F.when(c != 0, c), F.lit(default))


def csv_list(c: Column) -> Column:
    """'a, ,b' → ['a', 'b'] (trimmed, empties dropped)."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def page_request_defaults(df: DataFrame, cfg: Limits = DEFAULTS) -> DataFrame:
    """mode → 'extractor' when missing or '', task timeout → 60 when missing
    or 0, raw_body → false unless exactly true, block list → array."""
    out = df.withColumn("mode", _or_default(F.col("mode"), cfg.default_page_mode))
    if "task_timeout_secs" in df.columns:
        out = out.withColumn("task_timeout_secs", _or_default(F.col("task_timeout_secs"), cfg.page_timeout_secs).cast("int"))
    out = out.withColumn("raw_body", F.coalesce(F.col("raw_body") == F.lit(True), F.lit(False)))
    if "block_list" in df.columns:
        out = out.withColumn("block_list", csv_list(F.col("block_list")))
    return out


def fetch_request_defaults(df: DataFrame, cfg: Limits = DEFAULTS) -> DataFrame:
    """timeout → 60 only when missing (``??``; 0 is kept and then fails
    validation); debug → true only when exactly true."""
    return df.withColumn(
        "timeout_secs", F.coalesce(F.col("timeout_secs"), F.lit(cfg.fetch_timeout_secs)).cast("int")
    ).withColumn("debug", F.coalesce(F.col("debug") == F.lit(True), F.lit(False)))


def file_request_defaults(df: DataFrame, cfg: Limits = DEFAULTS) -> DataFrame:
    return df.withColumn("mode", F.coalesce(F.col("mode"), F.lit(cfg.default_file_mode))).withColumn(
        "timeout_secs",
        F.coalesce(F.col("timeout_secs"), F.lit(cfg.fetch_timeout_secs)).cast("int")
        if "timeout_secs" in df.columns
        else F.lit(cfg.fetch_timeout_secs),
    )


def effective_byte_cap(service_cap: int, request_cap: Column | int | None) -> Column:
    """max(1, min(service, request)); the request cap is optional."""
    svc = F.lit(int(service_cap)).cast("bigint")
    if request_cap is None:
        return F.greatest(F.lit(1).cast("bigint"), svc)
    rc = request_cap if isinstance(request_cap, Column) else F.lit(int(request_cap))
    return F.greatest(F.lit(1).cast("bigint"), F.least(svc, F.coalesce(rc.cast("bigint"), svc)))


def scan_objects(spark: SparkSession, glob: str, service_cap: int = DEFAULTS.file_max_bytes,
                 request_cap: int | None = None, with_content: bool = False) -> DataFrame:
    """Binary object manifest: path, length, modification time and whether
    the object fits the byte cap. The ``length`` filter and the pruning of
    ``content`` reach the binaryFile scan, so oversized objects are never
    read."""
    cap = effective_byte_cap(service_cap, request_cap)
    df = spark.read.format("binaryFile").load(glob)
    cols = ["path", "length", "modificationTime"] + (["content"] if with_content else [])
    return df.select(*cols).withColumn("within_cap", F.col("length") <= cap)


def scan_objects_within_cap(spark: SparkSession, glob: str, service_cap: int = DEFAULTS.file_max_bytes,
                            request_cap: int | None = None) -> DataFrame:
    cap = effective_byte_cap(service_cap, request_cap)
    return spark.read.format("binaryFile").load(glob).where(F.col("length") <= cap).select(
        "path", "length", "content"
    )


REQUEST_SCHEMAS = {
    "page": "req_id bigint, url string, mode string, task_timeout_secs int, raw_body boolean, block_list string",
    "fetch": "req_id bigint, url string, engine string, timeout_secs int, locale string, timezone_id string, debug boolean",
    "file": "req_id bigint, url string, mode string, timeout_secs int, max_bytes bigint, headers map<string,string>",
}


def read_requests(spark: SparkSession, path: str, kind: str = "page", cfg: Limits = DEFAULTS,
                  fmt: str = "parquet") -> DataFrame:
    """A2: request table of one kind with a declared schema (no inference)
    and the service defaults filled in."""
    df = spark.read.schema(REQUEST_SCHEMAS[kind]).format(fmt).load(path)
    if kind == "page":
        return page_request_defaults(df, cfg)
    if kind == "fetch":
        return fetch_request_defaults(df, cfg)
    return file_request_defaults(df, cfg)
