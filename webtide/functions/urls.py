"""URL column functions.

``parse_url`` returns NULL for hosts with underscores, non-ASCII hosts and a
``|`` in the path, so URLs are split with one regex (``URL_RE``) instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import ABSOLUTE_REF_RE, FORBIDDEN_HOST_RE, IPV4_RE, MAX_PORT, NUMERIC_HOST_RE, PLAIN_CHARS, URL_RE, WIDE_CHARS
from .text import bound, nullif_empty, sql_literal


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def url_parts(url) -> dict[str, Column]:
    """scheme, host (lowercase, brackets kept), port, path, query, fragment.

    Missing parts are NULL; an unparseable URL has a NULL scheme.
    """
    u = _c(url)
    ok = u.rlike(URL_RE)

    def g(i):
        return F.when(ok, nullif_empty(F.regexp_extract(u, URL_RE, i)))

    return {
        "scheme": F.lower(g(1)),
        "host": F.lower(g(3)),
        "port": g(4),
        "path": g(5),
        "query": g(6),
        "fragment": g(7),
    }


def with_url_parts(df, url_col: str = "url", prefix: str = ""):
    parts = url_parts(url_col)
    return df.select("*", *[c.alias(prefix + k) for k, c in parts.items()])


def strip_brackets(host) -> Column:
    h = _c(host)
    return F.regexp_replace(h, r"^\[|\]$", "")


def ipv4_to_long(host) -> Column:
    """Dotted quad → BIGINT (NULL when not a valid quad)."""
    h = _c(host)
    parts = [F.regexp_extract(h, IPV4_RE, i).cast("bigint") for i in range(1, 5)]
    valid = h.rlike(IPV4_RE)
    for p in parts:
        valid = valid & (p <= 255)
    num = parts[0] * 16777216 + parts[1] * 65536 + parts[2] * 256 + parts[3]
    return F.when(h.rlike(IPV4_RE), F.when(valid, num))


def _host_sql() -> str:
    """A host's canonical form as a SQL lambda."""
    wide, plain = sql_literal(WIDE_CHARS), sql_literal(PLAIN_CHARS)
    number = (
        "case when y rlike '^0x[0-9a-f]{0,15}$' then try_cast(conv(concat('0', substr(y, 3)), 16, 10) as bigint) "
        "when y rlike '^0[0-7]{1,20}$' then try_cast(conv(y, 8, 10) as bigint) when y rlike '^(0|[1-9][0-9]{0,17})$' then cast(y as bigint) end"
    )
    value = "case when size(q) = 1 then q[0] else aggregate(sequence(0, size(q) - 2), element_at(q, -1), (v, i) -> v + q[i] * cast(pow(256, 3 - i) as bigint)) end"
    quad = f"transform(array({value}), v -> concat_ws('.', v div 16777216, (v div 65536) % 256, (v div 256) % 256, v % 256))[0]"
    wrong = "size(q) > 4 or exists(q, n -> n is null) or exists(slice(q, 1, size(q) - 1), n -> n > 255) or element_at(q, -1) >= cast(pow(256, 5 - size(q)) as bigint)"
    address = f"transform(array(transform(split(regexp_replace(x, '[.]$', ''), '[.]'), y -> {number})), q -> case when {wrong} then null else {quad} end)[0]"
    one = f"case when x is null or x = '' or x rlike {sql_literal(FORBIDDEN_HOST_RE)} then null when x rlike {sql_literal(NUMERIC_HOST_RE)} then {address} else x end"
    mapped = f"case when contains(m, '%') then lower(translate(try_url_decode(replace(m, '+', '%2B')), {wide}, {plain})) else m end"
    decoded = f"transform(array(lower(translate(h, {wide}, {plain}))), m -> {mapped})"
    return f"h -> case when startswith(h, '[') then lower(h) else transform({decoded}, x -> {one})[0] end"


HOST_SQL = _host_sql()


def canonical_host(host) -> Column:
    """The host as a URL parser has it: escapes decoded, full-width forms and
    ideographic dots mapped, lower case, every spelling of an IPv4 address
    (octal, hex, fewer parts, one number, trailing dot) as a dotted quad.
    NULL where a parser fails: forbidden characters, a last label that is a
    number but no address. IPv6 literals stay."""
    return bound(_c(host), HOST_SQL)


def valid_port(port) -> Column:
    """Whether a port may be in a URL; none is fine."""
    p = _c(port)
    return p.isNull() | (p == "") | F.coalesce(p.try_cast("int") <= MAX_PORT, F.lit(False))


DOT_SEGMENTS_SQL = (
    "p -> case when contains(p, '/.') then array_join(concat("
    "aggregate(slice(split(p, '/'), 2, 1073741824), array(''), (acc, s) -> case when s = '.' then acc "
    "when s = '..' then (case when size(acc) > 1 then slice(acc, 1, size(acc) - 1) else acc end) else concat(acc, array(s)) end), "
    "case when element_at(split(p, '/'), -1) in ('.', '..') then array('') else cast(array() as array<string>) end), '/') else p end"
)


def remove_dot_segments(path) -> Column:
    """RFC 3986 §5.2.4 on an absolute path, as an array fold."""
    return bound(_c(path), DOT_SEGMENTS_SQL)


def normalize_url(url) -> Column:
    """One spelling of an absolute http(s) URL: scheme in lower case, the
    canonical host, no default port, a path without dot segments (``/`` when
    empty), no blanks at the ends. Anything else, and user info, stays as it
    is."""
    u = F.regexp_replace(_c(url), r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", "")
    g = lambda i: F.regexp_extract(u, URL_RE, i)
    scheme, port = F.lower(g(1)), g(4)
    default = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    host = F.coalesce(canonical_host(g(3)), F.lower(g(3)))
    full = F.concat(
        scheme, F.lit("://"), g(2), host, F.when(default, F.lit("")).otherwise(F.concat(F.lit(":"), port)),
        F.when(g(5) == "", F.lit("/")).otherwise(remove_dot_segments(g(5))), g(6), g(7),
    )
    return F.when(u.rlike(URL_RE) & scheme.isin("http", "https"), full).otherwise(u)


def resolve_url(base, ref) -> Column:
    """Absolute URL of ``ref`` relative to ``base`` (WHATWG-style cases:
    absolute, ``//host``, ``/path``, ``?query``, ``#fragment``, relative
    path, empty). Dot segments are removed from the resulting path; absolute
    references come in their normal form."""
    b, r = _c(base), _c(ref)
    r = F.regexp_replace(r, r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", "")
    scheme = F.regexp_extract(b, URL_RE, 1)
    authority = F.regexp_extract(b, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    bpath = F.regexp_extract(b, URL_RE, 5)
    bpath = F.when(bpath == "", F.lit("/")).otherwise(bpath)
    bquery = F.regexp_extract(b, URL_RE, 6)
    origin = F.concat(scheme, F.lit("://"), authority)
    no_frag = F.regexp_replace(b, "#.*$", "")
    base_dir = F.regexp_replace(bpath, "[^/]*$", "")

    def with_clean_path(prefix: Column, rest: Column) -> Column:
        # rest = path[?query][#fragment]; clean only the path part
        path = F.regexp_extract(rest, r"^([^?#]*)", 1)
        tail = F.regexp_extract(rest, r"^[^?#]*(.*)$", 1)
        return F.concat(prefix, remove_dot_segments(path), tail)

    return (
        F.when(b.isNull() | ~b.rlike(URL_RE), F.when(r.rlike(ABSOLUTE_REF_RE), normalize_url(r)))
        .when(r.rlike(ABSOLUTE_REF_RE) | r.startswith("//"), normalize_url(F.when(r.startswith("//"), F.concat(scheme, F.lit(":"), r)).otherwise(r)))
        .when(r.startswith("/"), with_clean_path(origin, r))
        .when(r.startswith("?"), F.concat(origin, bpath, r))
        .when(r.startswith("#"), F.concat(no_frag, r))
        .when(r == "", no_frag)
        .otherwise(with_clean_path(origin, F.concat(base_dir, r)))
    )
