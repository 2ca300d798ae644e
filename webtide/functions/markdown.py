"""HTML → Markdown: one pass over the tokens of a fragment, with a stack.

The fragment is cut into tokens once (``tags.TOKEN_RE``); tags that have no
say in Markdown are dropped and the others become small codes. An
``aggregate`` then walks the tokens. Its state holds a stack of open lists,
items and quotes, each with the prefix of the lines inside it, the gap due
before the next content, the marker that the next content gets, the open
link and the cells of the open table row.

ATX ``#`` headings, ``-`` bullets, numbered items that count on from
``start``, items indented below their list, ``> `` before every line of a
quote, fenced code, pipe tables with a rule below the first row, ``*``
emphasis, ``**`` strong. Unclosed ``<b>``/``<i>`` never turn into markers: a
bold or italic span is one that holds inline tags only. A page's tokens are
walked in chunks, so the work grows in proportion to the page.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tags import TAG_NAME_RE, TOKEN_RE, attributes_sql, value_sql
from .text import bound, decode_entities, sql_literal, trim_ws

_INLINE = r"(?:</?(?:em|i|span|u|s|sub|sup|small|mark|code)\b[^>]*>[^<]*)*"
_INLINE_NO_EM = r"(?:</?(?:span|u|s|sub|sup|small|mark|code)\b[^>]*>[^<]*)*"
#: Spans that become markers before the fragment is cut.
SPAN_RULES: list[tuple[str, str]] = [
    (r"(?is)<(?:strong|b)\b[^>]*>([^<]*" + _INLINE + r")</(?:strong|b)>", "**{1}**"),
    (r"(?is)<(?:em|i)\b[^>]*>([^<]*" + _INLINE_NO_EM + r")</(?:em|i)>", "*{1}*"),
]
BLANKS_RE = r"[ \t\n\r\f]+"
#: Tokens walked at once.
CHUNK = 256

# codes of the tokens
(TEXT, BLOCK, A, A_END, IMG, LI, LI_END, LIST, LIST_END, QUOTE, QUOTE_END, H, H_END, PRE, PRE_END, CODE, CODE_END, BR, HR, ROW, ROW_END, CELL, TABLE,
 TABLE_END) = range(1, 25)
BLOCKS = (
    "p div section article header main figure figcaption dl dt dd address form fieldset details summary nav footer aside".split()
)
OPEN = {b: BLOCK for b in BLOCKS} | {f"h{i}": H for i in range(1, 7)} | {
    "a": A, "img": IMG, "li": LI, "ul": LIST, "ol": LIST, "blockquote": QUOTE, "pre": PRE, "code": CODE, "br": BR, "hr": HR, "tr": ROW,
    "td": CELL, "th": CELL, "table": TABLE,
}
CLOSE = {b: BLOCK for b in BLOCKS} | {f"h{i}": H_END for i in range(1, 7)} | {
    "a": A_END, "li": LI_END, "ul": LIST_END, "ol": LIST_END, "blockquote": QUOTE_END, "pre": PRE_END, "code": CODE_END, "tr": ROW_END,
    "table": TABLE_END,
}


def spark_replacement(template: str) -> str:
    """``{n}`` → ``$n``; literal ``$`` and ``\\`` escaped for Java."""
    out = template.replace("\\", "\\\\").replace("$", "\\$")
    return re.sub(r"\{(\d)\}", r"$\1", out)


def html_replacement(template: str) -> str:
    """A rule's replacement as HTML: an empty line is a block's edge, a
    line's end a break."""
    return template.replace("\n\n", "<p>").replace("\n", "<br>")


def _codes(names: dict[str, int]) -> str:
    return "map(" + ", ".join(f"'{k}', {v}" for k, v in names.items()) + ")"


def _token_sql() -> str:
    """One token as (k, t, r, n): code, payload, raw text, first number."""
    img = f"concat('![', coalesce({value_sql('a', 'alt')}, ''), '](', {value_sql('a', 'src')}, ')')"
    lang = f"regexp_extract(coalesce({value_sql('a', 'class')}, ''), '(?:^|[ ])language-([A-Za-z0-9_+.-]+)', 1)"
    number = f"case when v.name = 'ol' then coalesce(try_cast({value_sql('a', 'start')} as int), 1) else 0 end"
    with_attributes = f"named_struct('k', v.k, 't', case v.k when {A} then {value_sql('a', 'href')} when {IMG} then {img} when {CODE} then {lang} else '' end, 'r', '', 'n', {number})"
    plain = f"named_struct('k', v.k, 't', case when v.k = {H} then concat(repeat('#', cast(substr(v.name, 2) as int)), ' ') when v.k > 0 then '' end, 'r', '', 'n', 0)"
    name = f"lower(regexp_extract(x, {sql_literal(TAG_NAME_RE)}, 1))"
    code = f"transform(array({name}), m -> named_struct('name', m, 'k', coalesce(case when startswith(x, '</') then try_element_at({_codes(CLOSE)}, m) else try_element_at({_codes(OPEN)}, m) end, 0)))[0]"
    both = f"case when v.k in ({A}, {IMG}, {CODE}, {LIST}) then transform(array({attributes_sql('x')}), a -> {with_attributes})[0] else {plain} end"
    tag = f"transform(array({code}), v -> {both})[0]"
    text = f"named_struct('k', {TEXT}, 't', regexp_replace(x, {sql_literal(BLANKS_RE)}, ' '), 'r', x, 'n', 0)"
    return f"x -> case when startswith(x, '<') and length(x) > 1 then {tag} else {text} end"


def _step_sql() -> str:
    """(s, x) -> state: s is the state, x a token."""
    last = "coalesce(nullif(size(s.st) + 1 - cast(array_position(reverse(transform(s.st, e -> e.tag)), '{}') as int), size(s.st) + 1), 0)"
    no_cell = "s.td <= 1"
    row_ends = f"x.k in ({ROW}, {ROW_END}, {TABLE_END}) and s.cells > 0 and {no_cell}"
    # d: prefix at hand, last open list, item and quote
    outer = (
        f"named_struct('px', coalesce(get(s.st, size(s.st) - 1).px, ''), 'il', case when x.k between {LI} and {LIST_END} then {last.format('l')} else 0 end, "
        f"'ii', case when x.k in ({LI}, {LI_END}) then {last.format('i')} else 0 end, 'iq', case when x.k = {QUOTE_END} then {last.format('q')} else 0 end)"
    )
    # c: what this token says, what goes before it, the stack below an item
    content = (
        f"case x.k when {TEXT} then case when s.pre = 1 then concat('\\n', d.px, replace(regexp_replace(x.r, '^\\n', ''), '\\n', concat('\\n', d.px))) "
        f"when s.pre = 2 then replace(x.r, '\\n', concat('\\n', d.px)) else nullif(case when s.gap <> 0 or not s.on then ltrim(x.t) else x.t end, '') end "
        f"when {A} then '[' when {IMG} then x.t when {CODE} then case when s.pre = 0 then '`' end when {PRE_END} then case when s.pre = 1 then concat('\\n', d.px, '```') end "
        f"when {HR} then '---' when {CELL} then case when {no_cell} and s.cells = 0 then '| ' end end"
    )
    link = "concat('](', s.href, ')')"
    glued = (
        f"case when x.k in ({A}, {A_END}) then coalesce({link}, '') when x.k = {CODE_END} and s.pre = 0 then '`' when x.k = {PRE_END} and s.pre = 2 then concat('\\n', d.px, '```') "
        f"when x.k = {BR} then case when s.pre > 0 then concat('\\n', d.px) when s.cells > 0 then ' ' when s.on and s.gap = 0 then '  ' else '' end "
        f"when x.k = {CELL} and {no_cell} and s.cells > 0 then ' | ' "
        f"when {row_ends} then concat(' |', case when s.rows = 0 then concat('\\n', d.px, '|', repeat(' --- |', s.cells)) else '' end) else '' end"
    )
    below = "case when d.il > 0 then slice(s.st, 1, d.il) when d.ii > 0 then slice(s.st, 1, d.ii - 1) else s.st end"
    said = f"named_struct('says', {content}, 'glued', {glued}, 'below', case when x.k = {LI} then {below} end)"
    popped = "size(c.below) < size(s.st)"
    number = "coalesce(case when d.il > 0 then get(c.below, d.il - 1).n end, 0)"
    marker = f"case when {number} > 0 then concat({number}, '. ') else '- ' end"
    px1 = "coalesce(get(c.below, size(c.below) - 1).px, '')"
    item = "named_struct('tag', 'i', 'px', concat({0}, repeat(' ', length({1}))), 'n', 0)".format(px1, marker)
    counted = f"case when {number} > 0 then concat(slice(c.below, 1, d.il - 1), array(named_struct('tag', 'l', 'px', {px1}, 'n', {number} + 1))) else c.below end"
    lp = "case when s.lead <> '' then s.lpx else d.px end"
    gap0 = f"case when x.k = {HR} and s.lead = '' then 2 else s.gap end"
    sep = (
        f"case when not s.on then {lp} when {gap0} <= 0 then '' when s.cells > 0 then ' ' when {gap0} = 1 then concat('\\n', {lp}) "
        f"else concat('\\n', rtrim({lp}), '\\n', {lp}) end"
    )
    piece = f"concat(c.glued, case when c.says is null then '' else concat({sep}, s.lead, c.says) end)"
    keep = "case when s.lead <> '' or s.gap < 0 then s.gap else 2 end"
    fields = {
        "out": f"case when c.says is null and c.glued = '' then s.out else concat(s.out, array({piece})) end",
        "st": (
            f"case x.k when {LI} then concat({counted}, array({item})) when {LI_END} then case when d.ii > d.il then slice(s.st, 1, d.ii - 1) else s.st end "
            f"when {LIST} then concat(s.st, array(named_struct('tag', 'l', 'px', d.px, 'n', x.n))) when {LIST_END} then case when d.il > 0 then slice(s.st, 1, d.il - 1) else s.st end "
            f"when {QUOTE} then concat(s.st, array(named_struct('tag', 'q', 'px', concat(d.px, '> '), 'n', 0))) "
            f"when {QUOTE_END} then case when d.iq > 0 then slice(s.st, 1, d.iq - 1) else s.st end else s.st end"
        ),
        "gap": (
            f"case x.k when {CELL} then case when {no_cell} then -1 else 2 end when {HR} then 2 when {PRE_END} then 2 when {H_END} then 2 when {QUOTE_END} then 2 "
            f"when {BLOCK} then {keep} when {H} then {keep} when {QUOTE} then {keep} when {PRE} then {keep} "
            f"when {LI} then case when s.lead <> '' and not ({popped}) then s.gap else greatest(s.gap, 1) end when {LI_END} then greatest(s.gap, 1) "
            f"when {LIST} then case when s.lead <> '' then s.gap when d.il > 0 then greatest(s.gap, 1) else 2 end "
            f"when {LIST_END} then case when exists(slice(s.st, 1, greatest(d.il - 1, 0)), e -> e.tag = 'l') then greatest(s.gap, 1) else 2 end "
            f"when {BR} then case when s.pre = 0 and s.cells = 0 and s.on and s.gap = 0 then 1 else s.gap end "
            f"when {ROW} then case when {no_cell} then greatest(s.gap, 1) else 2 end when {ROW_END} then case when {no_cell} then 1 else 2 end "
            f"when {TABLE} then case when s.td = 0 then {keep} else 2 end when {TABLE_END} then 2 else case when c.says is null then s.gap else 0 end end"
        ),
        "lead": (
            f"case when c.says is not null then '' when x.k = {LI} then concat(case when {popped} then '' else s.lead end, {marker}) "
            f"when x.k in ({LI_END}, {LIST_END}, {QUOTE_END}, {H_END}) then '' when x.k = {QUOTE} then case when s.lead <> '' then concat(s.lead, '> ') else '' end "
            f"when x.k = {H} then concat(s.lead, x.t) when x.k = {PRE} then concat(s.lead, '```') when x.k = {CODE} and s.pre = 1 then concat(s.lead, x.t) else s.lead end"
        ),
        "lpx": f"case when x.k = {LI} and ({popped} or s.lead = '') then {px1} when x.k in ({H}, {PRE}) and s.lead = '' then d.px else s.lpx end",
        "pre": f"case when x.k = {PRE} then 1 when x.k = {PRE_END} then 0 when x.k = {TEXT} and s.pre = 1 then 2 else s.pre end",
        "href": f"case x.k when {A} then x.t when {A_END} then null else s.href end",
        "cells": f"case when {row_ends} then 0 when x.k = {CELL} and {no_cell} then s.cells + 1 when x.k = {TABLE} and s.td = 0 then 0 else s.cells end",
        "rows": f"case when x.k = {TABLE} and s.td = 0 then 0 when {row_ends} then s.rows + 1 else s.rows end",
        "td": f"case when x.k = {TABLE} then s.td + 1 when x.k = {TABLE_END} then greatest(s.td - 1, 0) else s.td end",
        "on": "s.on or c.says is not null or c.glued <> ''",
    }
    state = "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"
    return f"(s, x) -> transform(array({outer}), d -> transform(array({said}), c -> {state})[0])[0]"


STACK = "array<struct<tag:string,px:string,n:int>>"


def _walk_sql() -> str:
    start = (
        f"named_struct('out', cast(array() as array<string>), 'st', cast(array() as {STACK}), 'gap', 0, 'lead', '', 'lpx', '', 'pre', 0, "
        "'href', cast(null as string), 'cells', 0, 'rows', 0, 'td', 0, 'on', false)"
    )
    names = ("st", "gap", "lead", "lpx", "pre", "href", "cells", "rows", "td", "on")
    emptied = "named_struct('out', cast(array() as array<string>), " + ", ".join(f"'{n}', a.{n}" for n in names) + ")"
    joined = "named_struct('out', concat(a.out, array(array_join(b.out, ''))), " + ", ".join(f"'{n}', b.{n}" for n in names) + ")"
    chunk = f"aggregate(slice(tokens, i * {CHUNK} + 1, {CHUNK}), {emptied}, {_step_sql()})"
    one = f"(a, i) -> transform(array({chunk}), b -> {joined})[0]"
    rest = "concat(coalesce(concat('](', z.href, ')'), ''), case when z.pre = 2 then '\\n```' else '' end, case when z.cells > 0 then ' |' else '' end)"
    return f"tokens -> aggregate(sequence(0, cast(floor(size(tokens) / {CHUNK}) as int)), {start}, {one}, z -> concat(array_join(z.out, ''), {rest}))"


TOKENS_SQL = (
    f"h -> filter(transform(regexp_extract_all(h, {sql_literal(TOKEN_RE)}, 0), {_token_sql()}), x -> x.k > 0 and x.t is not null)"
)
WALK_SQL = _walk_sql()
#: A blank that ends a line (two are a break).
LINE_END_RE = r"([^ \n]) \n"


def _fold(col: Column, rules) -> Column:
    for pat, rep in rules:
        col = F.regexp_replace(col, pat, spark_replacement(rep))
    return col


def to_markdown(html, extra_rules: list[tuple[str, str]] | None = None) -> Column:
    """Markdown for an HTML fragment column; NULL and ``''`` give ``''``.

    ``extra_rules`` — (regex, replacement) pairs run on the HTML before it is
    cut, so they can take an element over; an empty line in a replacement
    ends the block before it. Tables within a cell are flattened, empty items
    and headings vanish, markdown characters in text are not escaped."""
    c = F.coalesce(F.col(html) if isinstance(html, str) else html, F.lit(""))
    c = _fold(c, [(pat, html_replacement(rep)) for pat, rep in extra_rules or []])
    c = _fold(c, SPAN_RULES)
    c = bound(bound(c, TOKENS_SQL), WALK_SQL)
    c = F.regexp_replace(c, LINE_END_RE, "$1\n")
    return trim_ws(decode_entities(c))
