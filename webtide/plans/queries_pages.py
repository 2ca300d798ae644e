"""Registered page queries (sources A1, extraction C*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions.markdown import to_markdown
from ..functions.text import clean_text, read_time_min, word_count
from ..operators.extraction import block_features, extract_pages, main_content, page_links, ttr_seconds
from ..session import pages_table as table
from ..sources.fixtures import Fixtures
from ..sources.readers import read_pages
from .articles import build_articles, reading_rollup


def q_read_pages(spark: SparkSession, sf: str) -> DataFrame:
    p = read_pages(spark, f"{sf.rstrip('/')}/pages.parquet")
    return p.select("page_id", "url", F.octet_length("html").cast("bigint").alias("n_bytes"),
                    F.md5("html").alias("html_md5"))


# byte cap of rendered pages in the article query and its twin: the service's
# default, which no page of the tables reaches (goldens cover the size error)
ARTICLE_FIXTURE_CAP = DEFAULTS.max_response_bytes


def _articles(spark: SparkSession, sf: str) -> DataFrame:
    return build_articles(table(spark, sf, "pages"), Fixtures(spark, sf).page_requests(), DEFAULTS)


def q_articles(spark: SparkSession, sf: str) -> DataFrame:
    hrefs = F.array_join(F.transform("links", lambda l: l["href"]), "\n")
    return _articles(spark, sf).withColumn("links", hrefs)


def q_reading_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return reading_rollup(_articles(spark, sf))


def _field(name: str):
    def q(spark: SparkSession, sf: str) -> DataFrame:
        return extract_pages(Fixtures(spark, sf).rich_pages(), fields=[name]).select("page_id", name)

    q.__name__ = f"q_page_{name}"
    return q


def q_block_features(spark: SparkSession, sf: str) -> DataFrame:
    return block_features(table(spark, sf, "pages"))


def _main_content(prefer_article: bool):
    def q(spark: SparkSession, sf: str) -> DataFrame:
        m = main_content(Fixtures(spark, sf).rich_pages() if prefer_article else table(spark, sf, "pages"), prefer_article=prefer_article)
        return m.select(
            "page_id",
            "content_html",
            F.md5(F.coalesce("content_html", F.lit(""))).alias("content_md5"),
            word_count(clean_text(F.col("content_html"))).cast("int").alias("content_words"),
        )

    return q


def q_page_links(spark: SparkSession, sf: str) -> DataFrame:
    return page_links(Fixtures(spark, sf).rich_pages())


def q_page_markdown(spark: SparkSession, sf: str) -> DataFrame:
    m = main_content(Fixtures(spark, sf).rich_pages())
    md = to_markdown("content_html")
    return m.select("page_id", md.alias("markdown")).select(
        "page_id", "markdown", F.md5("markdown").alias("md_md5"), word_count("markdown").cast("int").alias("md_words")
    )


def q_word_count(spark: SparkSession, sf: str) -> DataFrame:
    e = extract_pages(table(spark, sf, "pages"))
    return e.select(
        "page_id",
        word_count("markdown").cast("int").alias("word_count_md"),
        word_count(F.coalesce("content_html", F.lit(""))).cast("int").alias("word_count_raw"),
    )


def q_read_time(spark: SparkSession, sf: str) -> DataFrame:
    e = extract_pages(table(spark, sf, "pages"))
    wc = word_count("markdown").cast("int")
    return e.select("page_id", wc.alias("word_count")).select(
        "page_id", "word_count", read_time_min("word_count").alias("read_time_min"),
        ttr_seconds(F.col("word_count")).alias("ttr"),
    )


QUERIES = {
    "read_pages": q_read_pages,
    "articles": q_articles,
    "reading_rollup": q_reading_rollup,
    "page_title": _field("title"),
    "page_description": _field("description"),
    "page_date": _field("date"),
    "page_author": _field("author"),
    "page_image": _field("image"),
    "page_favicon": _field("favicon"),
    "page_type": _field("type"),
    "page_source": _field("source"),
    "page_lang": _field("lang"),
    "block_features": q_block_features,
    "main_content": _main_content(True),
    "main_content_density": _main_content(False),
    "page_links": q_page_links,
    "page_markdown": q_page_markdown,
    "word_count": q_word_count,
    "read_time": q_read_time,
}
