"""Pieces of texts, for code that runs inside tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

#: Texts are handled in groups of about so many characters, and a text
#: above it in stretches, which bounds a task's memory by the longest text.
GROUP_CHARS = 1 << 19

_CUT = re.compile(r"(?<=[^\s\x1c-\x1f])[ \n\r\t]")


def stretches(text: str, chars: int = GROUP_CHARS) -> Iterator[str]:
    """The text in order, cut only before an ASCII blank that follows a
    non-blank, where neither a word nor a tokenizer's match can go on."""
    start = 0
    while len(text) - start > chars:
        cut = _CUT.search(text, start + chars)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def releasing(run):
    """``run`` (batches in, batches out) for a Python worker that later tasks
    use again: what it held goes back to the system at its end."""

    def inner(batches):
        import ctypes
        import gc

        yield from run(batches)
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
        if trim:
            trim(0)

    return inner


def groups(texts: list, chars: int = GROUP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges (from, to) of rows with about ``chars`` characters each."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= chars:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def take_runs(flat, start, length):
    """flat[start[i] : start[i] + length[i]] for all i, joined (numpy)."""
    import numpy as np

    total = int(length.sum())
    before = np.cumsum(length) - length
    return flat[np.repeat(start - before, length) + np.arange(total)]


class Grown:
    """An integer array that grows at its end."""

    def __init__(self, kind):
        import numpy as np

        self.held, self.n = np.zeros(1024, kind), 0

    def add(self, more) -> None:
        import numpy as np

        if self.n + len(more) > len(self.held):
            self.held = np.concatenate([self.held[: self.n], np.zeros(self.n + 2 * len(more) + 1024, self.held.dtype)])
        self.held[self.n : self.n + len(more)] = more
        self.n += len(more)


class _Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


class PieceIds:
    """Token ids of pieces of text, kept for later texts of the task.

    ``encode`` gives (flat ids, lengths) for a list of new pieces. When more
    than ``most`` pieces are held they are all forgotten, so memory is bounded.
    """

    def __init__(self, encode, kind, most: int = 250_000):
        self.encode, self.kind, self.most = encode, kind, most
        self.clear()

    def clear(self) -> None:
        import numpy as np

        self.at = _Numbers()
        self.flat, self.start, self.length = Grown(self.kind), Grown(np.int64), Grown(np.int64)

    def ids(self, pieces: list[str]):
        """The ids of all pieces in order, and how many each has."""
        import numpy as np

        if len(self.at) > self.most:
            self.clear()
        first = len(self.at)
        i = np.fromiter(map(self.at.__getitem__, pieces), np.int64, len(pieces))
        if len(self.at) > first:
            new = list(islice(reversed(self.at), len(self.at) - first))[::-1]
            flat, length = self.encode(new)
            self.start.add(self.flat.n + np.cumsum(length) - length)
            self.length.add(length)
            self.flat.add(flat)
        length = self.length.held[i]
        return take_runs(self.flat.held, self.start.held[i], length), length
