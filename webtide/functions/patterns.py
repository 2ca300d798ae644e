"""Shared regular expressions and fixed value lists.

Every pattern here is written in the common subset of Java regex (Spark)
and RE2 (DuckDB, used by the oracle): no back-references, no look-around,
no ``\\s`` (the two engines disagree on which characters it covers).
"""

from html.entities import name2codepoint

# --- whitespace -------------------------------------------------------------
# JavaScript's \s / String.trim() set, spelled out so both engines agree.
WS_CLASS = (
    r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)
WS = WS_CLASS + "+"
# the same set as characters (for char-set trim / translate, no regex)
WS_CODEPOINTS = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680] + list(range(0x2000, 0x200B)) + [
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF,
]
WS_CHARS = "".join(chr(c) for c in WS_CODEPOINTS)
WS_EDGES = "^" + WS + "|" + WS + "$"
# ASCII blanks used inside tag patterns
SP = r"[ \t\n\r\f]"

# --- URLs -------------------------------------------------------------------
# groups: 1 scheme, 2 userinfo, 3 host, 4 port, 5 path, 6 query, 7 fragment
URL_RE = (
    r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]*)"
    r"(?::([0-9]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
)
ABSOLUTE_REF_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
IPV4_RE = r"^([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})$"
# a host whose last label is a number is an IPv4 address in some spelling
# (octal, hex, fewer parts, trailing dot)
NUMERIC_HOST_RE = r"(^|\.)(0x[0-9a-f]*|[0-9]+)\.?$"
# code points that no host may have once escapes are decoded
FORBIDDEN_HOST_RE = r"[\x00-\x20#/<>?@\\^|%:\[\]\x7f]"
# full-width forms and ideographic full stops, and what they stand for
WIDE_CHARS = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3002\uff61"
PLAIN_CHARS = "".join(chr(c) for c in range(0x21, 0x7F)) + ".."
MAX_PORT = 65535

# --- fixed values (must equal the reference's behaviour) --------------------
# URL schemes the gate accepts
ALLOWED_SCHEMES = ["http", "https"]
# Blocked IPv4 ranges, inclusive, as dotted quads: 10/8, 172.16/12,
# 192.168/16, 127/8 (loopback), 169.254/16, 0/8.
BLOCKED_IPV4_RANGES = [
    ("10.0.0.0", "10.255.255.255", False),
    ("172.16.0.0", "172.31.255.255", False),
    ("192.168.0.0", "192.168.255.255", False),
    ("127.0.0.0", "127.255.255.255", True),
    ("169.254.0.0", "169.254.255.255", False),
    ("0.0.0.0", "0.255.255.255", False),
]
# Blocked IPv6: loopback (any number of zero groups, then 1) and lowercase
# prefixes, both after leading zeros of groups are dropped
IPV6_LOOPBACK_RE = r"^[0:]*:1$"
IPV6_LEADING_ZEROS_RE = r"(^|:)0+([0-9a-f])"
IPV6_BLOCKED_PREFIX_RE = r"^(fe80:|fe9|fea|feb|fc|fd)"
# Content types accepted by the text fetch gate (prefix match)
ALLOWED_CONTENT_TYPE_PREFIXES = [
    "text/",
    "application/xml",
    "application/rss+xml",
    "application/atom+xml",
    "application/json",
    "application/ld+json",
]
# Hop-by-hop headers, dropped in both directions
HOP_BY_HOP_HEADERS = [
    "connection",
    "keep-alive",
    "proxy-authenticate",
    "proxy-authorization",
    "te",
    "trailer",
    "transfer-encoding",
    "upgrade",
]
# Request headers that are rejected outright
FORBIDDEN_REQUEST_HEADERS = [
    "cookie",
    "authorization",
    "proxy-authorization",
    "proxy-authenticate",
]
# Request headers silently dropped (besides hop-by-hop)
DROPPED_REQUEST_HEADERS = ["host", "content-length"]
MAX_REQUEST_HEADERS = 50
MAX_HEADER_NAME_LENGTH = 200
MAX_HEADER_VALUE_LENGTH = 2000
# Response headers dropped besides hop-by-hop
DROPPED_RESPONSE_HEADERS = ["set-cookie"]
# Heavy resources blocked in rendered mode (suffix of the URL)
HEAVY_IMAGE_FONT_EXTS = [
    "css", "font", "png", "jpg", "jpeg", "gif", "svg", "webp", "ico", "woff", "woff2",
]
HEAVY_MEDIA_EXTS = [
    "mp4", "avi", "mov", "wmv", "flv", "webm", "mp3", "wav", "ogg",
]
# Anti-bot words in fetch error messages (matched on the lowercased message)
FETCH_BLOCK_WORDS = ["captcha", "cloudflare", "access denied", "forbidden", "rate limit"]
# Anti-bot patterns in page-level detection (case-sensitive on error objects)
PAGE_BLOCK_WORDS = [
    "captcha",
    "bot detection",
    "access denied",
    "forbidden",
    "rate limit",
    "security check",
    "cloudflare",
    "recaptcha",
]
# Page-level error classification keywords (checked in this order)
PAGE_BROWSER_WORDS = [
    "browser", "playwright", "navigation", "launch", "page crashed", "crashed", "crash", "engine",
]
PAGE_TIMEOUT_WORDS = ["timeout", "timed out"]
PAGE_VALIDATION_WORDS = ["validation", "invalid", "malformed", "not valid"]
# Access-log headers redacted to this marker
REDACTED_HEADERS = ["authorization", "x-api-key"]
REDACTED = "[REDACTED]"
# Request-level enums
PAGE_MODES = ["extractor", "playwright"]
FETCH_ENGINES = ["http", "playwright"]
FILE_MODES = ["auto", "http", "playwright"]

# --- HTML -------------------------------------------------------------------
# Boilerplate removed before any block split (replaced with a space).
STRIP_BOILERPLATE_RE = (
    r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>"
    r"|<noscript\b[^>]*>.*?</noscript>|<template\b[^>]*>.*?</template>"
    r"|<head\b[^>]*>.*?</head>|<!--.*?-->"
    r"|<nav\b[^>]*>.*?</nav>|<footer\b[^>]*>.*?</footer>|<aside\b[^>]*>.*?</aside>"
)
ARTICLE_OPEN_RE = r"(?i)<article\b[^>]*>"
ARTICLE_CLOSE_RE = r"(?i)</article\b[^>]*>"
ARTICLE_REST_RE = r"(?is)<article\b[^>]*>(.*)$"
BODY_RE = r"(?is)<body\b[^>]*>(.*)$"
BLOCK_SPLIT_RE = (
    r"(?i)</?(?:p|div|h[1-6]|li|ul|ol|article|section|nav|footer|header|aside"
    r"|td|th|tr|table|blockquote|pre|br|hr)\b[^>]*>"
)
ANCHOR_TEXT_RE = r"(?is)<a\b[^>]*>(.*?)</a>"
TAG_RE = r"<[^>]*>"
TITLE_TAG_RE = r"(?is)<title\b[^>]*>(.*?)</title>"
H1_RE = r"(?is)<h1\b[^>]*>(.*?)</h1>"
LANG_RE = r"^" + SP + r"*([A-Za-z]+)"
ICON_REL_RE = r"(^|[^a-z0-9_])icon($|[^a-z0-9_])"

# Character references. Named ones follow the standard library's table of
# HTML names; a no-break space is read as a space; ``&amp;`` is always last,
# so that no text is decoded twice.
NAMED_ENTITIES = {n: chr(c) for n, c in sorted(name2codepoint.items()) if n not in ("amp", "nbsp")} | {"nbsp": " ", "apos": "'"}
AMP_FORMS = ["&#38;", "&#x26;", "&#X26;", "&amp;"]
DECIMAL_REF_RE = r"&#([0-9]{1,7});"
HEX_REF_RE = r"&#[xX]([0-9A-Fa-f]{1,6});"
NAMED_REF_RE = r"&([A-Za-z][A-Za-z0-9]{1,31});"
REF_RE = r"&(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"

# Metadata precedence per article field (first present wins; '' counts as
# present, like JavaScript's ``??``).
META_KEYS = {
    "title": ["og:title", "twitter:title"],
    "description": ["og:description", "twitter:description", "description"],
    "date": ["article:published_time", "og:published_time", "date", "pubdate"],
    "author": ["author", "article:author"],
    "image": ["og:image", "twitter:image"],
    "type": ["og:type"],
    "source": ["og:site_name"],
}
