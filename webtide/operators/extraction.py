"""Page extraction over a table of HTML pages.

Every function is DataFrame → DataFrame and narrow (no shuffle): all the
work on one page happens inside one row, so a 100 TB corpus is read once
and no HTML crosses the network. One pass over the page collects its meta,
link, time and html tags with their attributes; metadata is looked up there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions.html import (
    article_inner,
    block_array,
    body_inner,
    classify_blocks,
    density_content,
    first_match,
    meta_fields,
    strip_boilerplate,
)
from ..functions.markdown import to_markdown
from ..functions.patterns import H1_RE, ICON_REL_RE, LANG_RE, TITLE_TAG_RE
from ..functions.tags import anchors, first_image, head_tags, head_value
from ..functions.text import clean_text, nullif_empty, read_time_min, trim_ws, word_count
from ..functions.urls import resolve_url, url_parts


def with_head_tags(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds ``_head``: the page's meta, link, time and html tags; and
    ``_meta``: what the meta tags say of each field."""
    return pages.withColumn("_head", head_tags(html)).withColumn("_meta", meta_fields("_head"))


# --- C1–C9 metadata -----------------------------------------------------------


def title_col(html="html", meta="_meta") -> Column:
    return F.coalesce(
        F.col(meta)["title"],
        clean_text(first_match(html, TITLE_TAG_RE)),
        clean_text(first_match(html, H1_RE)),
    )


def description_col(meta="_meta") -> Column:
    return F.col(meta)["description"]


def date_col(head="_head", meta="_meta") -> Column:
    return F.coalesce(F.col(meta)["date"], head_value(head, "time"))


def parsed_date_col(date: Column) -> Column:
    """Optional TIMESTAMP beside the opaque date string (never replaces it)."""
    return F.coalesce(
        F.try_to_timestamp(date, F.lit("yyyy-MM-dd'T'HH:mm:ssZ")),
        F.try_to_timestamp(date, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")),
        F.try_to_timestamp(date, F.lit("yyyy-MM-dd")),
    )


def author_col(meta="_meta") -> Column:
    return F.col(meta)["author"]


def image_col(url="url", meta="_meta", content="content_html") -> Column:
    ref = F.coalesce(F.col(meta)["image"], first_image(F.coalesce(F.col(content), F.lit(""))))
    return F.when(ref.isNotNull(), resolve_url(url, ref))


def favicon_col(url="url", head="_head") -> Column:
    ref = head_value(head, "link", key_pattern=ICON_REL_RE)
    return F.when(ref.isNotNull(), resolve_url(url, ref))


def type_col(meta="_meta") -> Column:
    return F.col(meta)["type"]


def source_col(url="url", meta="_meta") -> Column:
    return F.coalesce(F.col(meta)["source"], url_parts(url)["host"])


def lang_col(head="_head") -> Column:
    return F.lower(nullif_empty(F.regexp_extract(head_value(head, "html"), LANG_RE, 1)))


# --- C10 main content ------------------------------------------------------------


def main_content(pages: DataFrame, html: str = "html", prefer_article: bool = True) -> DataFrame:
    """Adds ``content_html``: the first ``<article>`` when present (and
    wanted), else the density-selected blocks of the body. NULL when the
    page yields nothing. Blocks are split only for pages that need them."""
    df = pages.withColumn("_clean", strip_boilerplate(F.col(html)))
    art = article_inner("_clean") if prefer_article else F.lit(None).cast("string")
    df = df.withColumn("_art", art)
    df = df.withColumn(
        "_blocks", F.when(F.col("_art").isNull(), block_array(body_inner(F.col("_clean"))))
    )
    dens = density_content(classify_blocks(F.col("_blocks")))
    content = F.coalesce(F.col("_art"), dens)
    return df.withColumn("content_html", nullif_empty(trim_ws(content))).drop("_clean", "_art", "_blocks")


def block_features(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per non-empty body block: position, words, link words, link
    density and the keep flag of the density rule (exploded per page, no
    shuffle)."""
    b = pages.select("page_id", block_array(body_inner(strip_boilerplate(F.col(html)))).alias("_blocks"))
    return b.select("page_id", F.explode(classify_blocks(F.col("_blocks"))).alias("b")).select(
        "page_id",
        F.col("b.pos").cast("int").alias("pos"),
        F.col("b.nw").cast("int").alias("nw"),
        F.col("b.lw").cast("int").alias("lw"),
        F.round(F.col("b.ld"), 6).alias("ld"),
        F.col("b.keep").alias("keep"),
    )


# --- C11 / C12 links ------------------------------------------------------------------


def article_links(content: Column, base: Column) -> Column:
    """The outgoing links of an article body: ARRAY<STRUCT<href, text>>,
    href absolute, text clean (NULL when empty)."""
    return F.transform(
        anchors(F.coalesce(content, F.lit(""))),
        lambda l: F.struct(resolve_url(base, l["href"]).alias("href"), nullif_empty(clean_text(l["text"])).alias("text")),
    )


def page_links(pages: DataFrame, html: str = "html", base: str = "url") -> DataFrame:
    """One row per ``<a href>`` of ``html`` in document order: position,
    absolute href (resolved against ``base``) and clean link text."""
    return pages.select("page_id", base, F.posexplode(anchors(F.col(html))).alias("pos", "l")).select(
        "page_id",
        (F.col("pos") + 1).cast("int").alias("pos"),
        resolve_url(F.col(base), F.col("l.href")).alias("href"),
        nullif_empty(clean_text(F.col("l.text"))).alias("text"),
    )


# --- C13–C17 body and reading figures ----------------------------------------------


def select_body(raw_body: Column, content_html: Column, markdown: Column) -> Column:
    """raw_body → extracted HTML untouched; else Markdown; NULL → ''."""
    return F.when(raw_body, F.coalesce(content_html, F.lit(""))).otherwise(
        F.coalesce(markdown, F.lit(""))
    )


def ttr_seconds(words: Column, words_per_minute: int = DEFAULTS.words_per_minute) -> Column:
    return F.when(words <= 0, F.lit(0)).otherwise(
        F.ceil(words * F.lit(60.0) / F.lit(float(words_per_minute))).cast("int")
    )


FIELDS = {
    "title": lambda: title_col(),
    "description": lambda: description_col(),
    "date": lambda: date_col(),
    "author": lambda: author_col(),
    "image": lambda: image_col(),
    "favicon": lambda: favicon_col(),
    "type": lambda: type_col(),
    "source": lambda: source_col(),
    "lang": lambda: lang_col(),
}


def extract_pages(
    pages: DataFrame,
    prefer_article: bool = True,
    words_per_minute: int = DEFAULTS.words_per_minute,
    extra_markdown_rules=None,
    fields: list[str] | None = None,
    asked: tuple[str, str] | None = None,
) -> DataFrame:
    """All article fields of each page (or the metadata ``fields`` alone) in
    one narrow pass; html is dropped from the output. ``asked`` names two
    boolean columns: whether the extracted HTML and whether the Markdown is
    wanted. A body that nobody wants is not made; ``has_content`` says
    whether there is one."""
    df = with_head_tags(main_content(pages, prefer_article=prefer_article))
    wanted = [FIELDS[f]().alias(f) for f in (fields or FIELDS)]
    if fields is not None:
        return df.select(*[c for c in pages.columns if c != "html"], *wanted)
    markdown = to_markdown("content_html", extra_markdown_rules)
    links = article_links(F.col("content_html"), F.col("url"))
    hidden = {"html", "_head", "_meta", "content_html", *(asked or ())}
    return df.select(
        *[c for c in df.columns if c not in hidden],
        *wanted,
        F.col("content_html").isNotNull().alias("has_content"),
        (F.when(F.col(asked[0]), F.col("content_html")) if asked else F.col("content_html")).alias("content_html"),
        (F.when(F.col(asked[1]), markdown) if asked else markdown).alias("markdown"),
        links.alias("links"),
    ).withColumn("n_links", F.size("links").cast("int"))


def reading_figures(df: DataFrame, body: str = "body", wpm: int = DEFAULTS.words_per_minute):
    counted = df.withColumn("word_count", word_count(body).cast("int"))
    return counted.withColumns({"read_time_min": read_time_min("word_count", wpm), "ttr": ttr_seconds(F.col("word_count"), wpm)})


# --- C19 extraction policy ---------------------------------------------------------------

EMPTY_EXTRACTION = "Content extraction resulted in empty response"


def extraction_policy(df: DataFrame, mode: str = "mode", content: str = "has_content") -> DataFrame:
    """Static mode: an empty extraction is still a success (null fields,
    body ''). Rendered mode: it is an error that maps to 422."""
    failed = (F.col(mode) == "playwright") & ~F.coalesce(F.col(content), F.lit(False))
    return df.withColumns({"error_message": F.when(failed, F.lit(EMPTY_EXTRACTION)), "error_code": F.when(failed, F.lit(422))})
