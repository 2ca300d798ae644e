"""Periodic runs of words, by recompression.

The words of many documents, each ended by a symbol of its own, are
compressed into one run-length grammar: rounds of block compression (a
maximal block of one symbol becomes a symbol) and pair compression (the
symbols are dealt into a left and a right half; each left symbol followed by
a right one becomes a symbol with it) alternate until no symbol repeats
(Jez, "Recompression", JACM 2016). Whether two neighbours are joined depends
on these two alone, so equal stretches are compressed alike but for a symbol
at each end of a level, and the longest common extension of two places is
found by climbing to the level where they differ and down again: a constant
number of steps a level (I, "Longest Common Extensions with Recompression",
CPM 2017). All queries of a group of documents climb together, in numpy
arrays. No suffix array is built.

A run of period q and length L holds a place that is a multiple of any step
up to L - q, so for each q the places on such a grid, with the word q
further on equal, are the candidates (a harmonic sum over q). The extension
to both sides of a candidate is exact, and so are start, length and period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text
from .texts import _Numbers, groups

#: Characters of the documents that are compressed together (a longer
#: document is compressed alone).
GROUP = 1 << 21
#: Least length of a run, in words and in periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4

_ODD = 0x9E3779B97F4A7C15
RUNS = "array<struct<start:long,length:long,period:long>>"


class Level:
    """Symbols of one level of the grammar and their places in the next.

    ``up``: the parent of each; ``first``: the first child of each parent,
    and the number of symbols at the end; ``blocks``: whether parents are
    blocks of one symbol or pairs.
    """

    def __init__(self, symbols, heads, blocks: bool):
        import numpy as np

        self.symbols, self.blocks = symbols, blocks
        self.up = np.cumsum(heads) - 1
        self.first = np.append(np.flatnonzero(heads), len(symbols))
        self.edge = {1: heads, -1: np.append(heads[1:], True)}

    def child(self, parent, way: int):
        """The first child (way 1) or the last one (way -1)."""
        return self.first[parent] if way > 0 else self.first[parent + 1] - 1

    def left(self, at, way: int):
        """Symbols of the block from ``at`` on, in the direction ``way``."""
        return self.first[self.up[at] + 1] - at if way > 0 else at - self.first[self.up[at]] + 1


class Grammar:
    """Run-length grammar of a sequence whose last symbol is unique."""

    def __init__(self, symbols):
        import numpy as np

        self.levels: list[Level] = []
        named = int(symbols.max()) + 1  # symbols below it are in use
        rounds = 0
        while len(np.unique(symbols)) < len(symbols):
            # blocks: only those of two symbols or more get a name
            heads = np.append(True, symbols[1:] != symbols[:-1])
            if not heads.all():
                level = Level(symbols, heads, True)
                self.levels.append(level)
                size = np.diff(level.first)
                above = symbols[level.first[:-1]]
                many = np.flatnonzero(size > 1)
                _, name = np.unique(above[many] * (int(size.max()) + 1) + size[many], return_inverse=True)
                above[many] = named + name
                named += int(name.max()) + 1
                symbols = above
            # pairs of a left and a right symbol; a hash deals the halves
            rounds += 1
            mixed = (symbols.astype(np.uint64) + np.uint64(rounds << 40)) * np.uint64(_ODD)
            right = ((mixed ^ (mixed >> np.uint64(32))) * np.uint64(_ODD)) >> np.uint64(63) == 1
            joined = np.append(False, ~right[:-1] & right[1:])
            if joined.any():
                level = Level(symbols, ~joined, False)
                self.levels.append(level)
                above = symbols[level.first[:-1]]
                second = np.flatnonzero(joined)
                _, name = np.unique(symbols[second - 1] * named + symbols[second], return_inverse=True)
                above[level.up[second]] = named + name
                named += int(name.max()) + 1
                symbols = above
        self.top = symbols

    def _step(self, level: Level, a, b, way: int):
        """Beyond the equal symbols at a and b."""
        import numpy as np

        n = np.minimum(level.left(a, way), level.left(b, way)) if level.blocks else 1
        return a + way * n, b + way * n

    def extensions(self, a, b, way: int = 1):
        """How far the words from a and from b on (way 1: to the right, -1:
        to the left) are equal. Each pair has a != b, and is within one
        document and its end symbol, or the end symbol before it."""
        import numpy as np

        start, a, b = a, a.copy(), b.copy()
        n = len(self.levels)
        stopped = np.full(len(a), n)  # the level at which a pair differs
        going = np.arange(len(a))
        for t, level in enumerate(self.levels):
            for _ in range(3):  # at most two steps until both are at an edge
                x, y = a[going], b[going]
                differ = level.symbols[x] != level.symbols[y]
                stopped[going[differ]] = t
                going, x, y = going[~differ], x[~differ], y[~differ]
                inner = ~(level.edge[way][x] & level.edge[way][y])
                if not inner.any():
                    break
                on = going[inner]
                a[on], b[on] = self._step(level, x[inner], y[inner], way)
            if not len(going):
                break
            a[going], b[going] = level.up[a[going]], level.up[b[going]]
        for t in range(n - 1, -1, -1):
            level = self.levels[t]
            on = np.flatnonzero(stopped > t)
            if not len(on):
                continue
            x, y = level.child(a[on], way), level.child(b[on], way)
            same = level.symbols[x] == level.symbols[y]
            x[same], y[same] = self._step(level, x[same], y[same], way)
            a[on], b[on] = x, y
        return (a - start) * way


def harmonic_grid(symbols, starts, sizes):
    """Candidates (period, place): for each period q, places that are
    multiples of a step within their document and whose word is equal to the
    one q further on. The step is the least number of places i of a run for
    which i + q is in it too, so no run is missed."""
    import numpy as np

    order = np.argsort(-sizes, kind="stable")
    sizes, starts = sizes[order], starts[order]
    found = [np.zeros((2, 0), np.int64)]
    q = 1
    while True:
        periods = np.arange(q, q + max(16, q))  # a range of periods at a time
        least = np.maximum(LEAST_WORDS, LEAST_PERIODS * periods)
        docs = int(np.searchsorted(-sizes, -least[0], "right"))
        if not docs:
            break
        step = least - periods
        n = np.where(sizes[:docs, None] >= least, -(-(sizes[:docs, None] - periods) // step), 0)
        flat = n.ravel()
        k = np.arange(int(flat.sum())) - np.repeat(np.cumsum(flat) - flat, flat)
        period = np.repeat(np.tile(periods, docs), flat)
        places = np.repeat(np.repeat(starts[:docs], len(periods)), flat) + k * np.repeat(np.tile(step, docs), flat)
        same = symbols[places] == symbols[places + period]
        found.append(np.stack([period[same], places[same]]))
        q += len(periods)
    return np.concatenate(found, axis=1)


def runs_of(symbols, starts, sizes):
    """(document, start in it, length, period) of all runs, in order.

    ``symbols`` holds the words of all documents as numbers, and behind each
    document a number that is found nowhere else; ``starts``, ``sizes``:
    where the documents' words are. The last symbol is such an end.
    """
    import numpy as np

    q, at = harmonic_grid(symbols, starts, sizes)
    if not len(q):
        return np.zeros((4, 0), np.int64)
    grammar = Grammar(symbols)
    # an end of its own stands before the first document too
    to = at + q + grammar.extensions(at, at + q)
    begin = at + 1 - grammar.extensions(at, at + q, -1)
    whole = to - begin >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
    # a stretch that was found with several periods has the smallest of them
    key = np.unique(np.stack([begin[whole], to[whole], q[whole]]), axis=1)
    if not key.shape[1]:
        return np.zeros((4, 0), np.int64)
    new = np.append(True, (np.diff(key[0]) != 0) | (np.diff(key[1]) != 0))
    begin, to, q = key[:, new]
    doc = np.searchsorted(starts, begin, "right") - 1
    found = np.stack([doc, begin - starts[doc], to - begin, q])
    return found[:, np.lexsort((q, found[1], doc))]


def _find():
    def run(batches):
        import itertools

        import numpy as np
        import pyarrow as pa

        def group(texts):
            words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            ids = _Numbers()
            symbols = np.fromiter(map(ids.__getitem__, itertools.chain.from_iterable(words)), np.int64, int(sizes.sum()))
            # ends: one before the first document, one behind each
            starts = 1 + np.cumsum(sizes + 1) - (sizes + 1)
            whole = np.empty(len(symbols) + len(sizes) + 1, np.int64)
            inner = np.ones(len(whole), bool)
            inner[0] = False
            inner[starts + sizes] = False
            whole[inner] = symbols
            whole[~inner] = len(ids) + np.arange(len(sizes) + 1)
            doc, start, length, period = runs_of(whole, starts, sizes)
            n = np.bincount(doc, minlength=len(words))
            kept = np.zeros(len(whole) + 1, np.int64)
            np.add.at(kept, starts[doc] + start + period, 1)
            np.add.at(kept, starts[doc] + start + length, -1)
            kept = np.cumsum(kept) == 0
            left = [b" ".join(itertools.compress(w, kept[s : s + len(w)].tolist()) if k else w) for w, s, k in zip(words, starts.tolist(), n.tolist())]
            return sizes, n, start, length, period, left

        for batch in batches:
            texts = batch.column("text").to_pylist()
            done = [group(texts[a:b]) for a, b in groups(texts, GROUP)]
            if not done:
                continue
            sizes, n, start, length, period = (np.concatenate([d[i] for d in done]) for i in range(5))
            left = [x for d in done for x in d[5]]
            runs = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], ["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), runs)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes), runs, pa.array(left, pa.binary())], names=["id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str | Column = "text") -> DataFrame:
    """Id, n_words, runs, collapsed (the words kept, joined by one space).

    Words are what stands between ASCII blanks (space, 9 to 13), numbered
    from 0 and compared by bytes. A run is a stretch of words whose smallest
    period is q, of at least 6 words and 4 periods, that cannot be extended
    to either side; runs are ordered by start, then period, and may overlap.
    A word is dropped if some run holds it behind the run's first q words.
    One row per input row: repeated rows and ids, null ids included, each
    give their own. A null, empty or blank text has no words, no runs and an
    empty collapsed text; a text of any length is handled whole, in memory
    that grows with it. An empty table gives none. Other columns are not
    read. Narrow: nothing is shuffled.
    """
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(_find(), f"id {kind}, n_words long, runs {RUNS}, collapsed binary")
    return found.select(F.col("id").alias(id_col), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))
