"""Article rows for page requests, and their rollup.

Plan shape: a Bloom filter of the requested URLs, sized by their count and
broadcast, cuts pages down to the requested ones before any extraction, and
says which of the two bodies someone asks for and whether a page over the
size cap is needed at all. Extraction is narrow. The exact join that follows
ships article rows with the bodies asked for; no page HTML moves for it. The
plan is the same for ten requests and for any number of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Limits
from ..functions.urls import canonical_host, strip_brackets, url_parts
from ..operators.extraction import extract_pages, extraction_policy, parsed_date_col, reading_figures, select_body
from ..operators.gates import scheme_gate_message, with_address_blocked
from ..operators.outcomes import page_error_code
from ..sources.readers import page_request_defaults
from .joins import BloomFilter

TOO_LARGE = "Response too large"


def with_url_gate(df: DataFrame, url: str = "url", out: str = "_gate") -> DataFrame:
    """Adds the message of the URL gates (scheme, then literal addresses)."""
    df = with_address_blocked(df.withColumn("_host", strip_brackets(canonical_host(url_parts(F.col(url))["host"]))), "_host", "_blk")
    return df.withColumn(out, F.coalesce(scheme_gate_message(F.col(url)), F.when(F.col("_blk"), F.lit("SSRF blocked")))).drop("_host", "_blk")


def requested_pages(pages: DataFrame, requests: DataFrame, cap: int) -> DataFrame:
    """The pages that some request may name, with ``n_bytes``, ``_raw`` and
    ``_md`` (which body is asked for). The HTML is dropped where it is over
    ``cap`` and only rendered requests name it."""
    kinds = F.array(
        F.when(F.col("raw_body"), F.lit("raw")).otherwise(F.lit("md")),
        F.when(F.col("mode") != "playwright", F.lit("static")).otherwise(F.lit("rendered")),
    )
    asked = requests.select("url", F.explode(kinds).alias("kind"))
    sized = pages.select("page_id", "url", "html", F.octet_length("html").cast("bigint").alias("n_bytes"))
    kept = BloomFilter(asked, "url", "kind").meet(sized, "url", {"_raw": "raw", "_md": "md", "_static": "static"})
    return kept.withColumn("html", F.when((F.col("n_bytes") <= cap) | F.col("_static"), F.col("html"))).drop("_static")


def build_articles(
    pages: DataFrame,
    requests: DataFrame | None = None,
    cfg: Limits = DEFAULTS,
    prefer_article: bool = True,
    gate_urls: bool = True,
    extra_markdown_rules=None,
    parse_dates: bool = False,
) -> DataFrame:
    """Flat article rows (the nested response of one page request, one row
    per request). Without ``requests`` every page is requested once in the
    default mode. An error has the code and message of its class and the
    original message as details; its other fields are NULL. ``parse_dates`` adds ``date_ts`` beside the opaque date
    string."""
    options = dict(prefer_article=prefer_article, words_per_minute=cfg.words_per_minute, extra_markdown_rules=extra_markdown_rules)
    if requests is None:
        # one default request per page: no join at all
        sized = pages.select("page_id", "url", "html", F.octet_length("html").cast("bigint").alias("n_bytes"))
        df = extract_pages(sized, **options).select(
            F.col("page_id").alias("req_id"), "*", F.lit(cfg.default_page_mode).alias("mode"), F.lit(False).alias("raw_body")
        )
    else:
        req = page_request_defaults(requests, cfg).select("req_id", "url", "mode", "raw_body")
        if gate_urls:  # before the join: requests are narrow rows
            req = with_url_gate(req)
        found = extract_pages(requested_pages(pages, req, cfg.max_response_bytes), asked=("_raw", "_md"), **options)
        df = req.join(found, "url", "left")
    df = df.withColumn(
        "body", select_body(F.col("raw_body"), F.col("content_html"), F.col("markdown"))
    )
    df = reading_figures(df, "body", cfg.words_per_minute)
    df = extraction_policy(df)
    large = F.when((F.col("mode") == "playwright") & (F.col("n_bytes") > cfg.max_response_bytes), F.lit(TOO_LARGE))
    df = df.withColumn("error_message", F.coalesce(large, F.col("error_message")))
    if gate_urls:
        df = (df if "_gate" in df.columns else with_url_gate(df)).withColumn("error_message", F.coalesce(F.col("_gate"), F.col("error_message"))).drop("_gate")
    mapped = page_error_code(F.col("error_message"))
    failed = F.col("error_message").isNotNull()
    fields = ["title", "description", "date", "author", "image", "favicon", "type", "source", "lang"]
    extra = [F.when(~failed, parsed_date_col(F.col("date"))).alias("date_ts")] if parse_dates else []
    return df.select(
        "req_id",
        "page_id",
        "url",
        "mode",
        "raw_body",
        *[F.when(~failed, F.col(c)).alias(c) for c in fields],
        F.when(~failed, F.col("body")).alias("body"),
        F.when(~failed, F.col("word_count")).alias("word_count"),
        F.when(~failed, F.col("read_time_min")).alias("read_time_min"),
        F.when(~failed, F.col("ttr")).alias("ttr"),
        F.when(~failed, F.col("n_links")).alias("n_links"),
        F.when(~failed, F.col("links")).alias("links"),
        F.when(failed, mapped["code"]).cast("int").alias("error_code"),
        F.when(failed, mapped["message"]).alias("error_message"),
        F.when(failed, mapped["details"]).alias("error_details"),
        *extra,
    )


def nest_articles(flat: DataFrame) -> DataFrame:
    """The nested response shape: meta struct and error struct."""
    return flat.select(
        "req_id",
        "url",
        "title",
        "description",
        "date",
        "author",
        "image",
        "favicon",
        "type",
        "source",
        "links",
        "ttr",
        "body",
        F.struct(
            F.col("lang"), F.col("read_time_min"), F.col("raw_body")
        ).alias("meta"),
        F.when(
            F.col("error_code").isNotNull(),
            F.struct(F.col("error_code").alias("code"), F.col("error_message").alias("message"), F.col("error_details").alias("details")),
        ).alias("error"),
    )


def reading_rollup(articles: DataFrame) -> DataFrame:
    """Pages, words and reading time by (lang, host) with subtotals.

    Partial aggregation runs map-side, so only one row per (lang, host) and
    task crosses the shuffle, whatever the skew of hosts."""
    # a filter would be pushed down to where it repeats the error rules
    ok = F.col("error_code").isNull()
    host = F.lower(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return (
        articles.select("lang", host.alias("host"), ok.alias("ok"), "word_count", "read_time_min")
        .rollup("lang", "host")
        .agg(
            F.count_if("ok").alias("pages"),
            F.sum("word_count").cast("bigint").alias("words"),
            F.sum("read_time_min").cast("bigint").alias("read_minutes"),
            F.max("word_count").cast("int").alias("max_words"),
        )
        .where("pages > 0")
    )
