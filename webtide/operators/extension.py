"""Extension surface (F1, F2): a swappable extractor behind a small
interface, and extra Markdown rules.

The default extractor is the native expression pipeline. A custom one is a
function over Arrow record batches (``mapInArrow``), so Python sees whole
column batches, not rows; its module is imported inside the task only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from .extraction import extract_pages

EXTRACTOR_SCHEMA = "page_id bigint, url string, title string, lang string, text_words int, error string"


class Extractor:
    """Interface: ``schema`` (DDL string) and ``__call__`` over an iterator
    of ``pyarrow.RecordBatch`` with columns page_id, url, html."""

    schema: str = EXTRACTOR_SCHEMA

    def __call__(self, batches: Iterator) -> Iterator:  # pragma: no cover - interface
        raise NotImplementedError


class StdlibExtractor(Extractor):
    """Example extractor on the standard-library HTML parser: title, html
    lang and visible-text word count (script/style skipped). A page on which
    the parser fails has its error and no fields."""

    def __call__(self, batches):
        import pyarrow as pa
        from html.parser import HTMLParser

        class P(HTMLParser):
            def __init__(self):
                super().__init__(convert_charrefs=True)
                self.title, self.lang, self.words, self._skip, self._in_title = None, None, 0, 0, False

            def handle_starttag(self, tag, attrs):
                if tag == "html" and self.lang is None:
                    v = dict(attrs).get("lang")
                    self.lang = v.split("-")[0].lower() if v else None
                if tag in ("script", "style"):
                    self._skip += 1
                if tag == "title":
                    self._in_title = True

            def handle_endtag(self, tag):
                if tag in ("script", "style") and self._skip:
                    self._skip -= 1
                if tag == "title":
                    self._in_title = False

            def handle_data(self, data):
                if self._in_title:
                    self.title = " ".join(((self.title or "") + " " + data).split())
                elif not self._skip:
                    self.words += len(data.split())

        for b in batches:
            ids, urls, htmls = b.column("page_id"), b.column("url"), b.column("html")
            t, l, w, e = [], [], [], []
            for h in htmls.to_pylist():
                p, error = P(), None
                try:
                    p.feed(h or "")
                    p.close()
                except Exception as x:  # whatever the parser raises belongs to this page alone
                    error = f"{type(x).__name__}: {x}"
                # a page that failed has no fields, rather than those read so far
                t.append(None if error else p.title)
                l.append(None if error else p.lang)
                w.append(None if error else p.words)
                e.append(error)
            yield pa.RecordBatch.from_arrays(
                [ids, urls, pa.array(t, pa.string()), pa.array(l, pa.string()), pa.array(w, pa.int32()), pa.array(e, pa.string())],
                names=["page_id", "url", "title", "lang", "text_words", "error"],
            )


def extract(pages: DataFrame, extractor: Extractor | Callable | None = None, **kw) -> DataFrame:
    """native extraction by default; a custom extractor runs over Arrow
    batches with its declared schema."""
    if extractor is None:
        return extract_pages(pages, **kw)
    schema = getattr(extractor, "schema", EXTRACTOR_SCHEMA)
    return pages.select("page_id", "url", "html").mapInArrow(extractor, schema)
