"""Text column functions: whitespace, entities, tag stripping, word counts.

All return ``pyspark.sql.Column`` built from JVM-side functions so they stay
inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import (
    AMP_FORMS,
    NAMED_ENTITIES,
    REF_RE,
    TAG_RE,
    WS,
    WS_CHARS,
)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim_ws(x) -> Column:
    """JavaScript ``String.trim`` (Unicode blanks, BOM included): a
    char-set trim, no regex."""
    return F.trim(_c(x), F.lit(WS_CHARS))


def collapse_ws(x) -> Column:
    """Runs of blanks become one space; edges trimmed."""
    return trim_ws(F.regexp_replace(_c(x), WS, " "))


def word_count(x) -> Column:
    """``trim → split on blank runs``; 0 for an empty or null string.
    Every blank becomes a space (``translate``), the text is split on that
    single character and empty tokens are dropped — the same count as a
    regex split on blank runs, without a regex."""
    t = F.translate(F.coalesce(_c(x), F.lit("")), WS_CHARS, " " * len(WS_CHARS))
    return F.size(F.filter(F.split(t, " "), lambda w: w != ""))


def sql_literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bound(x: Column, lambda_sql: str) -> Column:
    """A one-argument SQL lambda applied to ``x``, which is computed once
    however often the lambda uses it. Large bodies are SQL text, because a
    column object costs a call to the JVM for each of its nodes."""
    return F.call_function("transform", F.array(x), F.expr(lambda_sql)).getItem(0)


def _decode_sql() -> str:
    names = sql_literal(";".join(f"{k}={v}" for k, v in NAMED_ENTITIES.items()))
    number = "case when lower(substr(r, 2, 1)) = 'x' then cast(conv(substr(r, 3), 16, 10) as bigint) else cast(substr(r, 2) as bigint) end"
    character = (
        "case when n = 160 then ' ' when n between 1 and 1114111 and n <> 38 and not n between 55296 and 57343 "
        "then decode(unhex(lpad(hex(n), 8, '0')), 'UTF-32') end"
    )
    one = (
        f"case when startswith(r, '#') then transform(array({number}), n -> {character})[0] "
        f"else try_element_at(str_to_map({names}, ';', '='), r) end"
    )
    decoded = (
        f"aggregate(array_distinct(regexp_extract_all(s, {sql_literal(REF_RE)}, 1)), s, "
        f"(acc, r) -> coalesce(replace(acc, concat('&', r, ';'), {one}), acc))"
    )
    for form in AMP_FORMS:
        decoded = f"replace({decoded}, '{form}', '&')"
    return f"s -> case when contains(s, '&') then {decoded} else s end"


DECODE_SQL = _decode_sql()


def decode_entities(x) -> Column:
    """Character references: decimal, hex and named; unknown ones stay."""
    return bound(_c(x), DECODE_SQL)


def strip_tags(x) -> Column:
    return F.regexp_replace(_c(x), TAG_RE, " ")


def clean_text(x) -> Column:
    """Visible text of an HTML fragment: tags → space, entities decoded,
    blanks collapsed."""
    return collapse_ws(decode_entities(strip_tags(x)))


def clean_text_sql(x: str) -> str:
    """``clean_text`` as SQL text."""
    decoded = f"transform(array(regexp_replace({x}, {sql_literal(TAG_RE)}, ' ')), {DECODE_SQL})[0]"
    return f"trim({sql_literal(WS_CHARS)} from regexp_replace({decoded}, {sql_literal(WS)}, ' '))"


def read_time_min(words, words_per_minute: int = 200) -> Column:
    """0 when there are no words, else ``ceil(words / wpm)``."""
    w = _c(words)
    return F.when(w <= 0, F.lit(0)).otherwise(
        F.ceil(w / F.lit(float(words_per_minute))).cast("int")
    )


def nullif_empty(x) -> Column:
    c = _c(x)
    return F.when(c == "", F.lit(None).cast("string")).otherwise(c)
