"""Byte-level BPE encoding and decoding on padded numpy matrices.

The pieces of a text are the matches of the tokenizer's pattern. The
different pieces of a group of texts are put into matrices by length: a row
for each piece, its bytes' ids in the columns, padded with -1. In each round
every row merges its leftmost pair of least rank, found with ``argmin`` over
a matrix of pair ranks. The merged column is compacted away, rows without
a pair left leave the matrix, and only the two pairs beside a merge are
looked up anew, in an open-addressing hash table of pairs. The order of
merges within a row is that of the reference algorithm for rank files.
"""

from __future__ import annotations

import base64
import re
from itertools import compress

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text
from .texts import PieceIds, groups, stretches, take_runs

#: A piece with more bytes than this is merged with a heap instead: rounds
#: times width would grow with the square of its length.
MATRIX_BYTES = 1024
#: Cells of a matrix that are handled at once.
CELLS = 1 << 18
#: Widths of the matrices.
WIDTHS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, 128, 256, 512, MATRIX_BYTES)
NONE = (1 << 31) - 1
_ODD = 0x9E3779B97F4A7C15


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (base64 token, rank), by rank."""
    with open(path, "rb") as f:
        found = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, filter(None, f.read().splitlines())))
    if [rank for rank, _ in found] != list(range(len(found))):
        raise ValueError(f"{path}: ranks are not 0, 1, 2, ...")
    return [token for _, token in found]


class PairTable:
    """(left id, right id) -> rank of the joined token, by linear probing."""

    def __init__(self, tokens: list[bytes]):
        import numpy as np

        if len(tokens) >= 1 << 31:
            raise ValueError("too many tokens")
        rank = {t: i for i, t in enumerate(tokens)}
        pairs = {(a << 32) | b: i for i, t in enumerate(tokens) for cut in range(1, len(t)) if (a := rank.get(t[:cut])) is not None and (b := rank.get(t[cut:])) is not None}
        self.bits = max(4, (2 * len(pairs)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == -1
            first = np.zeros(len(keys), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.ranks[slot[put]] = keys[put], values[put]
            keys, values, slot = keys[~put], values[~put], slot[~put]
            step = self.keys[slot] != -1
            slot[step] = (slot[step] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys):
        import numpy as np

        return ((keys.view(np.uint64) * np.uint64(_ODD)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left, right):
        """Ranks of pairs of id arrays; NONE for no pair and beside padding."""
        import numpy as np

        shape = left.shape
        keys = np.ascontiguousarray(((left.astype(np.int64) << 32) | right.astype(np.int64)).ravel())
        out = np.full(len(keys), NONE, np.int32)
        open_ = np.flatnonzero(((left >= 0) & (right >= 0)).ravel())
        slot = self._slot(keys[open_])
        while len(open_):
            there = self.keys[slot]
            hit = there == keys[open_]
            out[open_[hit]] = self.ranks[slot[hit]]
            on = ~hit & (there != -1)
            open_, slot = open_[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out.reshape(shape)


def merge_matrix(ids, table: PairTable):
    """Merges every row of an id matrix (padded with -1) to its end.
    Returns the matrix of results, padded with -1, in the same row order."""
    import numpy as np

    out = np.full(ids.shape, -1, np.int32)
    owner, rank = np.arange(len(ids)), table.look_up(ids[:, :-1], ids[:, 1:])
    while True:
        width = ids.shape[1]
        if width == 1:
            out[owner, :1] = ids
            return out
        at = rank.argmin(1)
        best = rank[np.arange(len(ids)), at]
        done = best == NONE
        if done.any():
            out[owner[done], :width] = ids[done]
            left = ~done
            ids, rank, owner, at, best = ids[left], rank[left], owner[left], at[left], best[left]
            if not len(ids):
                return out
        row = np.arange(len(ids))
        ids[row, at] = best
        columns = np.arange(width)
        ids = ids[columns != at[:, None] + 1].reshape(len(ids), width - 1)
        rank = rank[columns[:-1] != at[:, None]].reshape(len(ids), width - 2)
        before, after = at > 0, at < width - 2
        r, c = row[before], at[before]
        rank[r, c - 1] = table.look_up(ids[r, c - 1], ids[r, c])
        r, c = row[after], at[after]
        rank[r, c] = table.look_up(ids[r, c], ids[r, c + 1])


def merge_long(ids: list[int], pairs: dict[int, int]) -> list[int]:
    """The same merges, in the same order, for one long piece: a heap of
    (rank, place) over a linked list."""
    from heapq import heapify, heappop, heappush

    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := pairs.get((ids[i] << 32) | ids[i + 1])) is not None]
    heapify(heap)
    while heap:
        r, i = heappop(heap)
        j = after[i] if ids[i] >= 0 else n
        if j >= n or pairs.get((ids[i] << 32) | ids[j]) != r:
            continue  # one side has been merged meanwhile
        ids[i], ids[j] = r, -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (x := pairs.get((r << 32) | ids[k])) is not None:
                heappush(heap, (x, i))
        if (h := before[i]) >= 0 and (x := pairs.get((ids[h] << 32) | r)) is not None:
            heappush(heap, (x, h))
    return [x for x in ids if x >= 0]


class Encoder:
    """Encodes lists of pieces with the tokens of a rank file."""

    def __init__(self, tokens: list[bytes], table: PairTable):
        import numpy as np

        self.table, self.rank = table, {t: i for i, t in enumerate(tokens)}
        self.of_byte = np.array([self.rank[bytes([i])] for i in range(256)], np.int32)
        self.pairs: dict[int, int] | None = None

    def __call__(self, pieces: list[str]):
        """(ids of all pieces joined, number of ids of each piece)"""
        import numpy as np

        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        whole = np.fromiter((self.rank.get(b, -1) for b in raw), np.int64, len(raw))
        length = np.ones(len(raw), np.int64)
        flat_of: list = []  # (rows, matrix of ids padded with -1)
        rest = np.flatnonzero(whole < 0)
        bucket = np.searchsorted(WIDTHS, size[rest])
        for k, width in enumerate(WIDTHS):
            mine = rest[bucket == k]
            for i in range(0, len(mine), max(1, CELLS // width)):
                rows = mine[i : i + max(1, CELLS // width)]
                ids = np.full((len(rows), width), -1, np.int32)
                inside = np.arange(width) < size[rows][:, None]
                ids[inside] = self.of_byte[np.frombuffer(b"".join([raw[r] for r in rows]), np.uint8)]
                merged = merge_matrix(ids, self.table)
                length[rows] = (merged >= 0).sum(1)
                flat_of.append((rows, merged))
        for r in rest[bucket == len(WIDTHS)]:
            if self.pairs is None:
                held = self.table.keys >= 0
                self.pairs = dict(zip(self.table.keys[held].tolist(), self.table.ranks[held].tolist()))
            merged = np.array([merge_long(self.of_byte[np.frombuffer(raw[r], np.uint8)].tolist(), self.pairs)], np.int32)
            length[r] = merged.shape[1]
            flat_of.append((np.array([r]), merged))
        start = np.cumsum(length) - length
        flat = np.zeros(int(length.sum()), np.uint32)
        single = np.flatnonzero(whole >= 0)
        flat[start[single]] = whole[single]
        for rows, merged in flat_of:
            there = merged >= 0
            flat[(start[rows][:, None] + np.arange(merged.shape[1]))[there]] = merged[there]
        return flat, length


#: Blank-delimited chunks with the blank before them, and blanks as the
#: pattern takes them. The pattern never matches across a chunk's ends, so
#: a chunk is split by it, and merged, once however often it occurs.
_CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Separators that ``re`` counts as white space and the pattern does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")


class ChunkEncoder:
    """Encodes lists of chunks: each chunk's pieces by ``Encoder``."""

    def __init__(self, encoder: Encoder, pattern: str):
        import numpy as np
        import regex

        self.pieces, self.find = PieceIds(encoder, np.uint32), regex.compile(pattern).findall

    def __call__(self, chunks: list[str]):
        """(ids of all chunks joined, number of ids of each chunk)"""
        import numpy as np

        # one search over the words: a line feed after each is a match of its
        # own; a chunk of blanks is one match
        blank = np.fromiter(map(str.isspace, chunks), bool, len(chunks))
        words = [c for c, b in zip(chunks, blank) if not b]
        found = self.find("\n".join([*words, ""])) if words else []
        feed = np.fromiter(map("\n".__eq__, found), bool, len(found))
        word = np.cumsum(feed) - feed
        kept = list(compress(found, ~feed))
        ids, length = self.pieces.ids(kept + [c for c, b in zip(chunks, blank) if b])
        of_word = np.bincount(word[~feed], length[: len(kept)], len(words)).astype(np.int64)
        count = np.zeros(len(chunks), np.int64)
        count[~blank], count[blank] = of_word, length[len(kept) :]
        stored = np.zeros(len(chunks), np.int64)  # where a chunk's ids are now
        stored[~blank] = np.cumsum(of_word) - of_word
        stored[blank] = of_word.sum() + np.cumsum(count[blank]) - count[blank]
        return take_runs(ids, stored, count), count

    def chunks(self, text: str) -> list[str]:
        return self.find(text) if _SEPARATORS.search(text) else _CHUNK.findall(text)


def _encode(model, pattern: str):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        encoder = ChunkEncoder(Encoder(*model.value), pattern)
        find, held = encoder.chunks, PieceIds(encoder, np.uint32)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in groups(texts):
                out = []
                counts, pieces = [], []
                for t in texts[a:b]:
                    of = [find(s) for s in stretches(t)]
                    if len(of) == 1:
                        counts.append(len(of[0]))
                        pieces += of[0]
                        continue
                    # a long text stands alone: its stretches one after the other
                    counts.append(0)
                    out.append((len(counts) - 1, b"".join(held.ids(p)[0].tobytes() for p in of)))
                ids, length = held.ids(pieces)
                ends = np.concatenate([[0], np.cumsum(length)])[np.cumsum(counts)]
                starts = np.concatenate([[0], ends[:-1]])
                rows = [ids[i:j].tobytes() for i, j in zip(starts.tolist(), ends.tolist())]
                for i, x in out:
                    rows[i] = x
                columns = [c.slice(a, b - a) for name, c in zip(batch.schema.names, batch.columns) if name != "text"]
                names = [n for n in batch.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, pa.binary())], names=[*names, "ids"])

    return run


def _decode(model):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        token = model.value[0].__getitem__
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            texts = [b"".join(map(token, np.frombuffer(x or b"", "<u4").tolist())) for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, "decoded"])

    return run


class BytePairs:
    """Byte-level BPE by a rank file and a pattern.

    The vocabulary is read on the driver and broadcast; its size is that of
    the file, whatever the input. ``encode`` gives id and ``ids``
    (little-endian unsigned 32-bit integers) for every row; a null or empty
    text has no ids. ``decode`` adds ``decoded``, the bytes of the tokens.
    Texts of any length are read whole, in stretches that end where no
    match of the pattern can go on. Repeated rows are encoded like others.
    """

    def __init__(self, spark, path: str, pattern: str):
        tokens = read_ranks(path)
        self.pattern, self.model = pattern, spark.sparkContext.broadcast((tokens, PairTable(tokens)))

    def encode(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
        kind = rows.schema["id"].dataType.simpleString()
        return rows.mapInArrow(_encode(self.model, self.pattern), f"id {kind}, ids binary").select(F.col("id").alias(id_col), "ids")

    def decode(self, encoded: DataFrame) -> DataFrame:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
        return encoded.mapInArrow(_decode(self.model), f"{columns}, decoded binary")
