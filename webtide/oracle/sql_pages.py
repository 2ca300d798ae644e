"""DuckDB oracle SQL for the page-extraction queries (C*)."""

from __future__ import annotations

from ..functions import patterns as P
from ..plans.queries_pages import ARTICLE_FIXTURE_CAP
from ..sources.fixtures import duck_ctes
from . import duck as d


def _ext_ctes(prefer_article: bool = True, source: str = "pages", markdown: bool = False, extra_rules=None) -> str:
    """CTEs ext (per page helpers), dens (density path via unnest + windows)
    and content (content_html per page)."""
    clean = d.rx_replace("html", P.STRIP_BOILERPLATE_RE, " ")
    body = f"(case when regexp_matches(clean, {d.lit(P.BODY_RE)}) then regexp_extract(clean, {d.lit(P.BODY_RE)}, 1) else clean end)"
    anchors = f"array_to_string(regexp_extract_all(b, {d.lit(P.ANCHOR_TEXT_RE)}, 1), ' ')"
    content = "coalesce(art, dens_html)" if prefer_article else "dens_html"
    return f"""
ext0 as (select page_id, url, html, {clean} as clean from {source}),
ext as (select page_id, url, html, clean,
               {d.article_inner('clean')} as art,
               {d.tags('html', 'meta')} as metas,
               {d.tags('html', 'link')} as links,
               {d.tags('html', 'time')} as times,
               {d.tags('html', 'html')} as htmls
        from ext0),
blk0 as (select page_id, regexp_split_to_array({body}, {d.lit(P.BLOCK_SPLIT_RE)}) as bl from ext),
blk as (select page_id, unnest(bl) as b, generate_subscripts(bl, 1) as pos from blk0),
feat as (select page_id, pos, b, {d.word_count(d.clean_text('b'))} as nw,
                {d.word_count(d.clean_text(anchors))} as lw from blk),
nz as (select *, row_number() over (partition by page_id order by pos) as k, lw / nw as ld
       from feat where nw > 0),
cls as (select *, lag(nw, 1, 0) over w as prev_nw, lag(ld, 1, 0) over w as prev_ld,
               lead(nw, 1, 0) over w as next_nw
        from nz window w as (partition by page_id order by k)),
kept as (select page_id, k, b, nw, lw, ld,
                case when ld > 0.333333 then false
                     when prev_ld <= 0.555556 then (nw > 16 or next_nw > 15 or prev_nw > 4)
                     else (nw > 40 or next_nw > 17) end as keep
         from cls),
dens as (select page_id,
                string_agg('<p>' || {d.trim_ws('b')} || '</p>', chr(10) order by k) filter (where keep) as dens_html
         from kept group by page_id),
content0 as (select e.*, nullif({d.trim_ws(content)}, '') as content_html
            from ext e left join dens using (page_id)),
content as (select *, {d.tags("coalesce(content_html, '')", 'img')} as imgs,
                   {d.anchors("coalesce(content_html, '')")} as anchors from content0)
""" + ("," + d.markdown_ctes("content0", extra_rules=extra_rules) if markdown else "")


def _fields(wpm: int = 200) -> str:
    host = d.host_of("url")
    img_ref = f"coalesce({d.meta_field('metas', 'image')}, {d.first_value('imgs', 'src')})"
    rel = f"regexp_matches(lower({d.attribute('t', 'rel')}), '(^|[^a-z0-9_])icon($|[^a-z0-9_])')"
    fav_ref = d.first_value("links", "href", rel)
    return f"""
  coalesce({d.meta_field('metas', 'title')}, {d.clean_text(d.first_match('html', P.TITLE_TAG_RE))},
           {d.clean_text(d.first_match('html', P.H1_RE))}) as title,
  {d.meta_field('metas', 'description')} as description,
  coalesce({d.meta_field('metas', 'date')}, {d.first_value('times', 'datetime')}) as date,
  {d.meta_field('metas', 'author')} as author,
  (case when {img_ref} is not null then {d.resolve_url('url', img_ref)} end) as image,
  (case when {fav_ref} is not null then {d.resolve_url('url', fav_ref)} end) as favicon,
  {d.meta_field('metas', 'type')} as type,
  coalesce({d.meta_field('metas', 'source')}, {host}) as source,
  lower(nullif(regexp_extract({d.first_value('htmls', 'lang')}, '^[ \\t\\n\\r\\f]*([A-Za-z]+)', 1), '')) as lang,
  list_transform(anchors, lambda z: z[1]) as hrefs,
  cast(len(anchors) as integer) as n_links
"""


def page_fields_sql(select: str, prefer_article: bool = True, rich: bool = False, markdown: bool = True) -> str:
    joined = "content join md using (page_id)" if markdown else "content"
    return (
        (duck_ctes("rich_pages").strip().replace("with ", "with recursive ", 1) + ",\n" if rich else "with recursive ")
        + _ext_ctes(prefer_article, "rich_pages" if rich else "pages", markdown).strip()
        + f",\nart as (select page_id, url, content_html, {'markdown, ' if markdown else ''}{_fields()} from {joined})\n"
        + select
    )


def articles_sql(cap: int = ARTICLE_FIXTURE_CAP) -> str:
    """C18 flagship (flattened), requests joined on url, gate on."""
    reqs = duck_ctes("page_requests")[len("with "):]
    wc = d.word_count("body")
    hostp = d.url_part("r.url", 3)
    from .sql_gates import ipv4_long, scheme_msg, strip_br, v4_blocked, v6_blocked

    host = d.canonical_host(hostp)
    gate = (f"coalesce({scheme_msg('r.url')}, case when {v4_blocked(ipv4_long(strip_br(host)))} "
            f"or (contains({host}, ':') and {v6_blocked(host)}) then 'SSRF blocked' end)")
    err = (f"coalesce(gate_msg, case when mode = 'playwright' and n_bytes > {cap} then 'Response too large' end, "
           "case when mode = 'playwright' and content_html is null then 'Content extraction resulted in empty response' end)")
    lo = "lower(coalesce(error_message, ''))"

    def anyw(words):
        return "(" + " or ".join(f"contains({lo}, {d.lit(w)})" for w in words) + ")"

    code = (
        f"(case when error_message is null then null when {anyw(P.PAGE_BROWSER_WORDS)} then 502 "
        f"when {anyw(P.PAGE_TIMEOUT_WORDS)} then 504 when {anyw(P.PAGE_VALIDATION_WORDS)} then 400 else 422 end)"
    )
    fields = ["title", "description", "date", "author", "image", "favicon", "type", "source", "lang"]
    sel = ", ".join(f"case when error_message is null then {f} end as {f}" for f in fields)
    return (
        "with recursive " + reqs.strip() + ",\n" + _ext_ctes(markdown=True).strip()
        + f",\nart as (select page_id, url, content_html, markdown, strlen(html) as n_bytes, {_fields()} from content join md using (page_id)),\n"
        + f"""req as (select req_id, url,
                coalesce(case when mode <> '' then mode end, 'extractor') as mode,
                coalesce(raw_body = true, false) as raw_body
         from page_requests),
j as (select r.req_id, a.page_id, r.url, r.mode, r.raw_body, a.*  exclude (page_id, url),
             case when r.raw_body then coalesce(a.content_html, '') else coalesce(a.markdown, '') end as body,
             {gate} as gate_msg
      from req r left join art a on a.url = r.url),
k as (select *, cast({wc} as integer) as word_count, {err} as error_message from j),
m as (select *, {code} as error_code from k)
select req_id, page_id, url, mode, raw_body, {sel},
       case when error_message is null then body end as body,
       case when error_message is null then word_count end as word_count,
       case when error_message is null then {d.read_time_min('word_count')} end as read_time_min,
       case when error_message is null then {d.ttr_seconds('word_count')} end as ttr,
       case when error_message is null then n_links end as n_links,
       case when error_message is null then array_to_string(list_transform(hrefs, lambda h: {d.resolve_url('url', 'h')}), chr(10)) end as links,
       cast(error_code as integer) as error_code,
       case error_code when 502 then 'Browser engine error' when 504 then 'Request timeout' when 400 then 'Validation error'
            when 422 then 'Failed to extract content from page' end as error_message,
       error_message as error_details
from m
"""
    )


def reading_rollup_sql() -> str:
    base = articles_sql()
    host = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
    return f"""
with a as ({base})
select lang, {host} as host, count(*) as pages, cast(sum(word_count) as bigint) as words,
       cast(sum(read_time_min) as bigint) as read_minutes, cast(max(word_count) as integer) as max_words
from a where error_code is null
group by rollup (lang, {host})
"""


def single_field_sql(field: str) -> str:
    return page_fields_sql(f"select page_id, {field} from art", rich=True, markdown=False)


def block_features_sql() -> str:
    return (
        "with " + _ext_ctes().strip()
        + "\nselect page_id, cast(k as integer) as pos, cast(nw as integer) as nw, cast(lw as integer) as lw, "
        "round(ld, 6) as ld, keep from kept"
    )


def main_content_sql(prefer_article: bool) -> str:
    return (
        (duck_ctes("rich_pages").strip() + ",\n" + _ext_ctes(True, "rich_pages").strip() if prefer_article
         else "with " + _ext_ctes(False).strip())
        + f"\nselect page_id, content_html, md5(coalesce(content_html, '')) as content_md5, "
        f"cast({d.word_count(d.clean_text('content_html'))} as integer) as content_words from content"
    )


def page_links_sql(source: str = "pages") -> str:
    return f"""
with l as (select page_id, url, unnest(anchors) as z, generate_subscripts(anchors, 1) as pos
           from (select page_id, url, {d.anchors('html')} as anchors from {source}))
select page_id, cast(pos as integer) as pos, {d.resolve_url('url', 'z[1]')} as href,
       nullif({d.clean_text('z[2]')}, '') as text
from l
"""


def markdown_sql() -> str:
    return page_fields_sql(
        f"select page_id, markdown, md5(markdown) as md_md5, cast({d.word_count('markdown')} as integer) as md_words from art",
        rich=True,
    )


def word_count_sql() -> str:
    return page_fields_sql(
        f"""select page_id, cast({d.word_count('markdown')} as integer) as word_count_md,
                   cast({d.word_count('coalesce(content_html, \'\')')} as integer) as word_count_raw from art"""
    )


def read_time_sql() -> str:
    wc = d.word_count("markdown")
    return page_fields_sql(
        f"""select page_id, cast({wc} as integer) as word_count, {d.read_time_min(wc)} as read_time_min,
                   {d.ttr_seconds(wc)} as ttr from art"""
    )


def read_pages_sql() -> str:
    return "select page_id, url, cast(strlen(html) as bigint) as n_bytes, md5(html) as html_md5 from pages"


SQL = {
    "read_pages": read_pages_sql,
    "articles": articles_sql,
    "reading_rollup": reading_rollup_sql,
    "page_title": lambda: single_field_sql("title"),
    "page_description": lambda: single_field_sql("description"),
    "page_date": lambda: single_field_sql("date"),
    "page_author": lambda: single_field_sql("author"),
    "page_image": lambda: single_field_sql("image"),
    "page_favicon": lambda: single_field_sql("favicon"),
    "page_type": lambda: single_field_sql("type"),
    "page_source": lambda: single_field_sql("source"),
    "page_lang": lambda: single_field_sql("lang"),
    "block_features": block_features_sql,
    "main_content": lambda: main_content_sql(True),
    "main_content_density": lambda: main_content_sql(False),
    "page_links": lambda: duck_ctes("rich_pages").strip() + "," + page_links_sql("rich_pages").strip()[len("with"):],
    "page_markdown": markdown_sql,
    "word_count": word_count_sql,
    "read_time": read_time_sql,
}
