"""HTML column functions: metadata lookups, boilerplate removal, blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import (
    ANCHOR_TEXT_RE,
    ARTICLE_CLOSE_RE,
    ARTICLE_OPEN_RE,
    ARTICLE_REST_RE,
    BLOCK_SPLIT_RE,
    BODY_RE,
    META_KEYS,
    STRIP_BOILERPLATE_RE,
)
from .tags import first_of_sql
from .text import bound, clean_text_sql, decode_entities, sql_literal, strip_tags, trim_ws, word_count


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def first_match(html, pattern: str, group: int = 1) -> Column:
    """Group of the first match, NULL when the pattern does not occur
    (an empty capture stays ``''``)."""
    h = _c(html)
    return F.when(h.rlike(pattern), F.regexp_extract(h, pattern, group))


def meta_fields(tags: str = "_head") -> Column:
    """STRUCT with the first present meta value of each article field
    (precedence in ``META_KEYS``) among the head tags, entity-decoded; ``''``
    survives like ``??``. One expression cleans them all."""
    raw = "array(" + ", ".join(first_of_sql(tags, keys) for keys in META_KEYS.values()) + ")"
    clean = clean_text_sql("v")
    named = ", ".join(f"'{f}', m[{i}]" for i, f in enumerate(META_KEYS))
    return F.expr(f"transform(array(transform({raw}, v -> {clean})), m -> named_struct({named}))[0]")


def strip_boilerplate(html) -> Column:
    return F.regexp_replace(_c(html), STRIP_BOILERPLATE_RE, " ")


def article_inner(cleaned) -> Column:
    """Inner HTML of the first ``<article>``, with the articles nested in
    it; NULL when there is none. It ends where as many articles have been
    closed as opened, or with the page."""
    rest = F.regexp_extract(_c(cleaned), ARTICLE_REST_RE, 1)
    return F.when(_c(cleaned).rlike(ARTICLE_OPEN_RE), bound(rest, INNER_SQL))


def _inner_sql() -> str:
    opened = f"transform(p, x -> size(split(x, {sql_literal(ARTICLE_OPEN_RE)})) - 1)"
    still_open = f"transform(sequence(1, size(p)), k -> 1 + aggregate(slice({opened}, 1, k), 0, (a, y) -> a + y) - k)"
    parts = f"coalesce(nullif(cast(array_position({still_open}, 0) as int), 0), size(p))"
    return f"s -> transform(array(split(s, {sql_literal(ARTICLE_CLOSE_RE)})), p -> array_join(slice(p, 1, {parts}), '</article>'))[0]"


INNER_SQL = _inner_sql()


def body_inner(cleaned) -> Column:
    c = _c(cleaned)
    return F.when(c.rlike(BODY_RE), F.regexp_extract(c, BODY_RE, 1)).otherwise(c)


def block_array(cleaned_body) -> Column:
    """Non-empty blocks of a body as ARRAY<STRUCT<html, nw, lw>>, in order."""
    blocks = F.split(_c(cleaned_body), BLOCK_SPLIT_RE)
    feats = F.transform(
        blocks,
        lambda b: F.struct(
            b.alias("html"),
            # word_count splits on blank runs itself, so the visible text
            # needs no collapsing before it is counted
            word_count(decode_entities(strip_tags(b))).cast("int").alias("nw"),
            word_count(
                decode_entities(strip_tags(F.array_join(F.regexp_extract_all(b, F.lit(ANCHOR_TEXT_RE), 1), " ")))
            ).cast("int").alias("lw"),
        ),
    )
    return F.filter(feats, lambda x: x["nw"] > 0)


# Density rule thresholds (shallow text features: words and link density)
LINK_DENSITY_MAX = 0.333333
PREV_DENSITY_SPLIT = 0.555556


def keep_rule(nw, ld, prev_nw, prev_ld, next_nw) -> Column:
    return (
        F.when(ld > LINK_DENSITY_MAX, F.lit(False))
        .when(prev_ld <= PREV_DENSITY_SPLIT, (nw > 16) | (next_nw > 15) | (prev_nw > 4))
        .otherwise((nw > 40) | (next_nw > 17))
    )


BLOCK_TYPE = "struct<html:string,nw:int,lw:int>"


def classify_blocks(blocks) -> Column:
    """Adds ``pos`` (1-based among non-empty blocks), ``ld`` and ``keep`` to
    each block from its previous/next block of the same array — no shuffle.
    Neighbours come from shifted copies zipped with the array, so the
    lambda never indexes the outer array (one pass, not n²)."""
    arr = _c(blocks)
    n = F.size(arr)
    none = F.array(F.lit(None).cast(BLOCK_TYPE))
    prev = F.concat(none, F.slice(arr, 1, F.greatest(n - 1, F.lit(0))))
    nxt = F.concat(F.slice(arr, 2, F.greatest(n, F.lit(1))), none)
    z = F.arrays_zip(arr.alias("cur"), prev.alias("prev"), nxt.alias("nxt"))

    def one(x, i):
        cur, pv, nx = x["cur"], x["prev"], x["nxt"]
        ld = cur["lw"] / cur["nw"]
        prev_nw = F.coalesce(pv["nw"], F.lit(0))
        prev_ld = F.coalesce(pv["lw"] / pv["nw"], F.lit(0.0))
        next_nw = F.coalesce(nx["nw"], F.lit(0))
        return F.struct(
            (i + 1).alias("pos"),
            cur["html"].alias("html"),
            cur["nw"].alias("nw"),
            cur["lw"].alias("lw"),
            ld.alias("ld"),
            keep_rule(cur["nw"], ld, prev_nw, prev_ld, next_nw).alias("keep"),
        )

    return F.transform(z, one)


def density_content(classified) -> Column:
    """Kept blocks re-assembled in order, each as one ``<p>`` paragraph."""
    kept = F.filter(_c(classified), lambda x: x["keep"])
    return F.array_join(
        F.transform(kept, lambda x: F.concat(F.lit("<p>"), trim_ws(x["html"]), F.lit("</p>"))),
        "\n",
    )
