"""Main text of pages by the distribution of text over line blocks.

The line-block method strips the markup so that each block element stands on
a line of its own, sums the text lengths over a sliding window of lines, and
looks for surge points, where the sum rises above a threshold, and dive
points, where it falls to nothing; the text between them is kept.

The weight of a line is its text outside links. Lines in elements whose tag,
role, class or id marks them as something else than the article weigh
nothing and are never kept. The windows go over the lines outside of article
elements, and over those of each article element apart. An article element
is kept whole if a window of it surges, or if the elements weigh as much
together as what surges outside of them; what surges outside is kept unless
one article element weighs as much. A range outside also takes what stands
in the same element: the lines between two ranges, and from the last headline
before the first range on. Pages are read in one pass whatever their markup.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines that a window holds, and the text in it at which a surge begins.
WINDOW = 3
SURGE_CHARS = 86
#: A line with more of its text in links than this weighs nothing.
LINK_SHARE = 0.5

# Names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template iframe object svg math canvas audio video head title nav header footer aside form button select textarea input fieldset label menu dialog".split())
RAW = frozenset("script style noscript template iframe textarea title svg".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
ARTICLE = frozenset(["article", "main"])
NOT_TEXT_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form toolbar".split())
#: Elements that a start tag of the same kind ends.
ENDED_BY_SAME = frozenset("p li dt dd tr td th option".split())

# a tag whose quotes do not close ends at its first >
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: Names of what is not the article, and parts that may stand beside them in a
#: compound. A class or id is marked if it has a name and no other part: so
#: not has-sidebar, no-sidebar, side-by-side, related-work, post-header.
_NAMES = frozenset(
    "ad ads advert adverts advertise advertisement advertisements advertising adsense banner banners sponsor sponsors sponsored promo promos promotion promotions cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription subscriptions signup comment comments commentlist disqus replies respond sidebar side aside widget widgets menu nav navbar navigation navigate breadcrumb breadcrumbs footer header masthead share sharing social related recommend recommended recommendation recommendations recommender toolbar pagination pager skip copyright login search adbox sharedaddy".split()
)
_BESIDE = frozenset(
    "area areas bar box block blocks button buttons col column container form gpt google dfp div dialog group global icon icons inner input item items left link links list main mobile msg message outer panel posts articles stories news primary right secondary section site slot sticky to top bottom toggle unit us wrap wrapper media network networks text title thread up collapse".split()
)
#: Names that also mark a compound with other parts, as its last one or before
#: a part of the list above: post-comments, js-cookie-banner.
_SURE = frozenset("comment comments commentlist disqus replies respond cookie cookies consent gdpr ad ads advert adverts advertisement advertisements adsense newsletter popup breadcrumb breadcrumbs navbar pagination sponsored sidebar".split())
_NEGATED = frozenset("no not has have with without is".split())
_PHRASES = frozenset(["more-stories", "more-articles", "you-may-also-like", "you-might-also-like", "read-more", "read-next"])
#: Elements that hold lines of one text.
CONTAINERS = frozenset("div section article main td center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Tags that may also wrap a whole page.
WRAPPERS = frozenset(["form", "fieldset"])


def _marked(names: str) -> bool:
    for name in names.split():
        parts = [x.lower() for x in _PART.findall(name) if not x.isdigit()]
        if not parts or parts[0] in _NEGATED:
            continue
        if "-".join(parts) in _PHRASES:
            return True
        if any(x in _NAMES for x in parts) and all(x in _NAMES or x in _BESIDE for x in parts):
            return True
        if parts[-1] in _SURE or any(x in _SURE for x in parts) and (parts[-1] in _NAMES or parts[-1] in _BESIDE):
            return True
    return False


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(raw)}


def _other(tag: str, raw: str) -> int:
    """Whether an element is marked as something else than the article: 2 by
    what it is or because it is not shown, 1 by its name, role or as a form."""
    if tag in DROPPED:
        return 1 if tag in WRAPPERS else 2
    if tag in ARTICLE or tag in ("html", "body") or not raw.strip():
        return 0
    a = _attributes(raw)
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true":
        return 2
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return 2
    # the id of a heading is made of its words
    return int(a.get("role", "").lower() in NOT_TEXT_ROLES or _marked(a.get("class", "")) or tag not in HEADINGS and _marked(a.get("id", "")))


def line_blocks(page: str) -> list[tuple[str, int, int, int, bool]]:
    """(text, characters outside links, number of the outermost article
    element it is in, or 0, number of the container it stands in, whether it
    is a headline) for each line that is not in an element marked
    as something else. A name, role or form that holds more than half of the
    page's text outside links marks nothing; where an article element stands
    outside of it, only if it holds a surge on two lines or more."""
    lines, heavy = _line_blocks(page, frozenset())
    return _line_blocks(page, heavy)[0] if heavy else lines


def _line_blocks(page: str, unmarked: frozenset[int]) -> tuple[list[tuple[str, int, int, int, bool]], frozenset[int]]:
    """The lines, and the numbers of the named elements that mark nothing;
    those in ``unmarked`` count as not named."""
    lines: list[tuple[str, int, int, int, bool]] = []
    text: list[str] = []
    linked: list[str] = []
    open_: list[tuple[str, int, int]] = []  # (tag, marked as something else, number if named)
    others = links = articles = article = 0  # what is open, and the last article
    hidden = weight = counted = rows = named = 0
    opened: Counter = Counter()  # open elements by tag
    within = [0]  # numbers of the open containers
    containers = heading = 0
    held: dict[int, tuple[int, int]] = {}  # weight and lines before a named element, then in it

    def end_line() -> None:
        nonlocal rows, counted
        rows += weight > counted
        counted = weight
        if text:
            line = " ".join(unescape("".join(text)).split())
            if line:
                in_links = len(" ".join(unescape("".join(linked)).split()))
                lines.append((line, len(line) - in_links if in_links <= LINK_SHARE * len(line) else 0, article if articles else 0, within[-1], heading > 0))
            text.clear()
            linked.clear()

    def say(raw: str) -> None:
        nonlocal weight
        if not links and not hidden:
            weight += len(raw.strip())
        if raw and not others:
            text.append(raw)
            if links:
                linked.append(raw)

    def close() -> str:
        nonlocal others, hidden, links, articles, heading
        tag, marked, number = open_.pop()
        opened[tag] -= 1
        heading -= tag in HEADINGS
        if tag in CONTAINERS:
            within.pop()
        links -= tag == "a"
        articles -= tag in ARTICLE and not others
        hidden -= marked == 2
        others -= marked > 0
        if number:
            held[number] = weight - held[number][0], rows - held[number][1]
        return tag

    at, n = 0, len(page)
    last = page.rfind(">") + 1  # no tag ends behind it
    while at < last:
        m = _TOKEN.search(page, at, last)
        if not m:
            break
        say(page[at : m.start()])
        at = m.end()
        shut, tag, inside = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if tag is None:
            continue
        tag = tag.lower()
        if not shut:
            if tag in BLOCKS:
                end_line()
                if tag in ENDED_BY_SAME or tag in BLOCKS:
                    # an open paragraph ends at any block; a list item or cell at its like
                    while open_ and (open_[-1][0] == "p" and tag != "p" or open_[-1][0] == tag and tag in ENDED_BY_SAME):
                        close()
            elif tag == "br":
                say(" ")
            if tag in VOID or inside.endswith("/") and tag not in BLOCKS:
                continue
            if tag in RAW:  # what is inside is no markup
                end = re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
                continue
            marked, number = _other(tag, inside), 0
            if marked == 1:
                named += 1
                if named in unmarked:
                    marked = 0
                else:
                    number = named
                    held[number] = weight, rows
            open_.append((tag, marked, number))
            opened[tag] += 1
            heading += tag in HEADINGS
            if tag in CONTAINERS:
                containers += 1
                within.append(containers)
            hidden += marked == 2
            others += marked > 0
            links += tag == "a"
            if tag in ARTICLE and not others:
                article += not articles
                articles += 1
        else:
            if tag in BLOCKS:
                end_line()
            if opened[tag]:
                while close() != tag:
                    pass
    if at < n:
        say(page[at:].partition("<")[0])
    end_line()
    while open_:
        close()
    element = any(x[2] for x in lines)
    return lines, frozenset(k for k, (w, n) in held.items() if 2 * w > weight and (not element or n > 1 and w >= SURGE_CHARS))


def between_surge_and_dive(weights: list[int], surge: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """Ranges of lines. A range begins at the first weighing line of a
    window whose sum reaches ``surge``, and ends where a whole window sums
    to nothing."""
    n = len(weights)
    sums, held = [0] * n, 0
    for i in range(n - 1, -1, -1):
        held += weights[i] - (weights[i + window] if i + window < n else 0)
        sums[i] = held
    ranges, i = [], 0
    while i < n:
        if sums[i] < surge or not weights[i]:
            i += 1
            continue
        j = i
        while j < n and sums[j]:
            j += 1
        ranges.append((i, j))
        i = j
    return ranges


def _beside(lines: list, outside: list[int], found: list[tuple[int, int]]) -> set[int]:
    """Lines next to the ranges that stand in the same container."""
    more: set[int] = set()
    for (_, b), (c, _) in zip(found, found[1:]):
        parent = lines[outside[b - 1]][3]
        if parent and parent == lines[outside[c]][3]:
            more |= {outside[i] for i in range(b, c) if lines[outside[i]][3] == parent}
    for a, _ in found[:1]:
        parent = lines[outside[a]][3]
        before = []
        for i in range(a - 1, -1, -1):
            if lines[outside[i]][3] != parent:
                break
            before.append(outside[i])
            if lines[outside[i]][4]:  # the headline
                more |= set(before)
                break
    return more


def main_text(page: str | None) -> str:
    """Blocks of the main text in page order, joined by newlines."""
    lines = line_blocks(page or "")
    outside = [i for i, x in enumerate(lines) if not x[2]]
    weights = [lines[i][1] for i in outside]
    found = between_surge_and_dive(weights, SURGE_CHARS)
    if not found and any(weights):  # a short page: its weightiest line is the surge
        found = between_surge_and_dive(weights, max(weights))
    rest = sum(sum(weights[a:b]) for a, b in found)
    inside: dict[int, list[int]] = {}
    for _, weight, article, _, _ in lines:
        if article:
            inside.setdefault(article, []).append(weight)
    own = {k: sum(w) for k, w in inside.items()}
    # the element raises its lines to a surge, unless the page has more elsewhere
    raised = sum(own.values()) >= rest
    kept = {k for k, w in inside.items() if raised or between_surge_and_dive(w, SURGE_CHARS)}
    chosen: set[int] = set()
    if rest > max(own.values(), default=-1):
        chosen = {outside[i] for a, b in found for i in range(a, b)}
        chosen |= _beside(lines, outside, found)
    return "\n".join(x[0] for i, x in enumerate(lines) if x[2] in kept or i in chosen)


def _extract(batches):
    import pyarrow as pa

    for batch in batches:
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        keep = [n for n in batch.schema.names if n != "html"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], pa.array(texts, pa.string())], names=[*keep, "text"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Page id, url, text, n_chars of every row.

    A null or empty page, and one without article text, has the empty text.
    White space inside a block becomes one space, character references are
    decoded, and blocks are joined by one newline. Unclosed and crossed tags
    and cut references are read as browsers do, as far as blocks go. A page
    of any length is read whole; repeated rows and null ids stay as they are.
    """
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = rows.mapInArrow(_extract, f"page {kinds['page']}, url {kinds['url']}, text string")
    return out.select(F.col("page").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))
