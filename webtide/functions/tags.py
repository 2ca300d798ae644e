"""Tags and their attributes, read with quotes in mind.

A tag ends at the first ``>`` outside a quoted attribute value, so
``title="1 > 0"`` does not end it, and an attribute is found by its whole
name, so ``data-href`` is not ``href``. Quantifiers are possessive and the
repeated group is bounded: a page of unclosed quotes or a tag with thousands
of attributes costs neither time nor stack (a tag with over 400 quoted or
plain stretches is read up to its first ``>``).

The expressions are SQL text, because a column object costs a call to the
JVM for each of its nodes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import SP
from .text import bound, sql_literal

#: The inside of a tag after its name.
INSIDE = r"""(?:[^"'>]++|"[^"]*+"|'[^']*+'){0,400}+"""
#: Name and value (with its quotes) of each attribute that has a value.
ATTRIBUTE_RE = r"""([^ \t\n\r\f"'<>/=]++)""" + SP + "*+=" + SP + r"""*+("[^"]*+"|'[^']*+'|[^ \t\n\r\f"'>]++)"""
TAG_NAME_RE = r"^</?([a-zA-Z][a-zA-Z0-9:-]*)"
#: Tags that say something about the page: collected in one pass.
HEAD_TAG_RE = r"(?i)<(?:meta|link|time|html)\b" + INSIDE + ">"
IMG_TAG_RE = r"(?i)<img\b" + INSIDE + ">"
#: An anchor: group 1 is its tag, 2 what it holds.
ANCHOR_RE = r"(?is)(<a\b" + INSIDE + r">)(.*?)</a\b[^>]*>"
#: Comments, elements without text, tags, texts and lone ``<``, in order.
_RAW = "(?:script|style|noscript|template)"
TOKEN_RE = (
    r"(?is)<!--.*?(?:-->|$)|<" + _RAW + r"\b" + INSIDE + r">.*?</" + _RAW + r"\b[^>]*>"
    r"|</?[a-z]" + INSIDE + r">|<[/!?a-z][^<>]*>|[^<]+|<"
)


def attributes_sql(tag: str) -> str:
    """(k, v): names in lower case and values with their quotes, in order."""
    re = sql_literal(ATTRIBUTE_RE)
    return f"named_struct('k', transform(regexp_extract_all({tag}, {re}, 1), k -> lower(k)), 'v', regexp_extract_all({tag}, {re}, 2))"


def value_sql(attributes: str, name: str) -> str:
    """Value of the first attribute of that name; NULL without one."""
    value = f"get({attributes}.v, cast(array_position({attributes}.k, '{name}') as int) - 1)"
    return f"transform(array({value}), w -> case when w rlike '^[\"\\']' then substr(w, 2, length(w) - 2) else w end)[0]"


def attribute_sql(tag: str, name: str) -> str:
    return f"transform(array({attributes_sql(tag)}), a -> {value_sql('a', name)})[0]"


def attribute(tag: Column, name: str) -> Column:
    return bound(tag, f"tag -> {attribute_sql('tag', name)}")


def first_of_sql(tags: str, keys: list[str]) -> str:
    """Content of the first meta tag for the first key that has one."""
    wanted = "array(" + ", ".join(sql_literal(k) for k in keys) + ")"
    one = f"get(filter({tags}, x -> x.name = 'meta' and x.value is not null and array_contains(x.keys, w)), 0).value"
    return f"get(filter(transform({wanted}, w -> {one}), v -> v is not null), 0)"


def _head_sql() -> str:
    def of(name: str, keys: list[str], value: str) -> str:
        named = "array(" + ", ".join(f"lower({value_sql('a', k)})" for k in keys) + ")" if keys else "cast(array() as array<string>)"
        return f"named_struct('name', '{name}', 'keys', {named}, 'value', {value_sql('a', value)})"

    kinds = f"case n when 'meta' then {of('meta', ['property', 'name', 'itemprop'], 'content')} when 'link' then {of('link', ['rel'], 'href')} when 'time' then {of('time', [], 'datetime')} else {of('html', [], 'lang')} end"
    name = f"lower(regexp_extract(t, {sql_literal(TAG_NAME_RE)}, 1))"
    one = f"transform(array({attributes_sql('t')}), a -> transform(array({name}), n -> {kinds})[0])[0]"
    return f"h -> transform(regexp_extract_all(h, {sql_literal(HEAD_TAG_RE)}, 0), t -> {one})"


#: Head tags as (name, keys, value): what names a meta or link tag, and what
#: it holds; of time its date, of html its language.
HEAD_SQL = _head_sql()


def head_tags(html) -> Column:
    """ARRAY<STRUCT<name, keys, value>> of a page, in document order."""
    return bound(F.col(html) if isinstance(html, str) else html, HEAD_SQL)


def head_value(tags, name: str, key: str | None = None, key_pattern: str | None = None) -> Column:
    """The value of the first tag of that name and key that has one (an
    empty value counts)."""
    c = F.col(tags) if isinstance(tags, str) else tags
    test = "true"
    if key is not None:
        test = f"array_contains(x.keys, {sql_literal(key)})"
    if key_pattern is not None:
        test = f"exists(x.keys, k -> k rlike {sql_literal(key_pattern)})"
    return bound(c, f"tags -> get(filter(tags, x -> x.name = '{name}' and x.value is not null and {test}), 0).value")


ANCHORS_SQL = (
    f"h -> filter(transform(arrays_zip(regexp_extract_all(h, {sql_literal(ANCHOR_RE)}, 1), regexp_extract_all(h, {sql_literal(ANCHOR_RE)}, 2)), "
    f"z -> named_struct('href', {attribute_sql('z[`0`]', 'href')}, 'text', z['1'])), l -> l.href is not null)"
).replace("z[`0`]", "z['0']")


def anchors(html: Column) -> Column:
    """The ``<a href>`` elements of an HTML column in document order, as
    ARRAY<STRUCT<href, text>> with raw href and inner HTML."""
    return bound(html, ANCHORS_SQL)


def first_image(html: Column) -> Column:
    """``src`` of the first ``<img>`` that has one."""
    src = attribute_sql("t", "src")
    return bound(html, f"h -> get(filter(transform(regexp_extract_all(h, {sql_literal(IMG_TAG_RE)}, 0), t -> {src}), s -> s is not null), 0)")
