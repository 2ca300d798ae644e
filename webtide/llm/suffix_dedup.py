"""Repeated byte strings, with suffix arrays sorted in two stages.

Two documents that share a string of ``length`` bytes must meet in a task.
Each such string, seen as a window of the text, names one of its ``GRAM``-byte
parts as its anchor: the one with the least hash, of ties the leftmost. Equal
windows have equal anchors. The windows that an anchor serves in one place
are neighbours; they and their bytes are a segment. Anchors, with a digest of
their segment, are shuffled (about 2 for each 78 bytes); an anchor found once
is done with, and of equal segments all but the first are repeats. Where an
anchor has different segments, their texts are fetched and brought together,
and a task sorts the suffixes of all its segments:

* suffixes that are smaller than their successor are sorted directly, eight
  bytes at a time, as far as ``length`` bytes;
* all others are induced by one scan over the buckets of first bytes: a
  suffix in its place puts the larger one before it into the next free place
  of that one's bucket (Itoh and Tanaka, SPIRE 1999; Ko and Aluru, CPM 2003);
* common prefixes of neighbours show which windows are equal. The first in
  the order of ids and places stays, all others are repeats.

Anchors that would gather too much in one task are replaced by their windows,
each with its own digest as key: those that a counting pass finds in more
than one in ``SHARE`` of all anchors, and those with over ``MOST`` segments.
Equal windows and segments of a group of texts are reduced to the first
before they are shuffled, so no key has more rows than groups of texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .texts import take_runs

#: Bytes of an anchor.
GRAM = 24
#: Bytes of text that are searched for anchors together.
GROUP = 1 << 22
#: An anchor with over one in SHARE of all anchors is replaced by its windows.
SHARE = 4096
#: Segments of an anchor that are sorted together.
MOST = 4096
#: Bytes of segments that are sorted together (whole anchors).
SORTED = 1 << 21

_A, _B, _C, _D = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93
#: Bits of the place within a group of texts, below the hash.
_PLACE = 24
_NO_ID = (1 << 63) - 1

KEYED = "akey long, skey long, id long, h long, at long"


def _mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(32))) * np.uint64(_D)
    return x ^ (x >> np.uint64(29))


def _words(data, extra: int = 0, order: str = "<"):
    """Eight bytes from each place on as a number; zeros follow the data."""
    import numpy as np

    padded = np.concatenate([data, np.zeros(extra + 8, np.uint8)])
    return np.ndarray((len(data) + extra,), f"{order}u8", padded, strides=(1,)).astype(np.uint64)


def _window_hash(words, at, length: int, seed: int):
    """64-bit hashes of the windows at ``at``."""
    import numpy as np

    out = np.full(len(at), seed, np.uint64)
    for o in [*range(0, length - 7, 8), length - 8]:
        out = (out ^ words[at + o]) * np.uint64(_A)
        out ^= out >> np.uint64(31)
    return _mixed(out)


def segments_of(data, starts, sizes, length: int):
    """(anchor, first window, windows, words, anchor hashes): the anchors of
    all windows of the texts in ``data``, at ``starts``, and what they serve."""
    import numpy as np

    words = _words(data, length)
    n = max(len(data) - length + 1, 0)
    grams = words[: n + length - GRAM] * np.uint64(_A)
    grams ^= words[8 : 8 + len(grams)] * np.uint64(_B)
    grams += grams >> np.uint64(29)
    grams = _mixed(grams ^ words[16 : 16 + len(grams)] * np.uint64(_C))
    low = np.uint64((1 << _PLACE) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    wide, span = 1, length - GRAM + 1
    while 2 * wide <= span:
        least = np.minimum(least[: len(least) - wide], least[wide:])
        wide *= 2
    least = np.minimum(least[:n], least[span - wide : span - wide + n])
    anchor = (least & low).astype(np.int64)
    # windows must end within their text
    own = np.maximum(sizes - length + 1, 0)
    valid = np.zeros(n + 1, np.int8)
    np.add.at(valid, starts[own > 0], 1)
    np.add.at(valid, starts[own > 0] + own[own > 0], -1)
    valid = np.cumsum(valid[:n]) > 0
    begins = valid.copy()
    begins[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    first = np.flatnonzero(begins)
    # a text's windows are consecutive, and the next text's begin anew
    count = np.diff(np.append(np.flatnonzero(begins[valid]), int(valid.sum())))
    at = anchor[first]
    return at, first, count, words, grams[at]


def _groups_of(batch, length: int):
    """Texts of a batch in the order of (id, h), each once, in groups: (data,
    ids, hs, place in the text, starts, sizes). Long texts come in stretches
    that overlap by a window less one byte."""
    import numpy as np

    ids = batch.column("id").to_numpy(zero_copy_only=False)
    hs = batch.column("h").to_numpy(zero_copy_only=False)
    column = batch.column("text")
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    order = np.lexsort((hs, ids))
    order = order[np.append(True, (np.diff(ids[order]) != 0) | (np.diff(hs[order]) != 0))[: len(order)]]
    pieces, held = [], 0
    for i in order[(offsets[order + 1] - offsets[order]) >= length].tolist():
        size = int(offsets[i + 1] - offsets[i])
        for a in range(0, size - length + 1, GROUP):
            m = min(size - a, GROUP + length - 1)
            if held + m > GROUP + length and pieces:
                yield _group(raw, offsets, ids, hs, pieces)
                pieces, held = [], 0
            pieces.append((i, a, m))
            held += m
    if pieces:
        yield _group(raw, offsets, ids, hs, pieces)


def _group(raw, offsets, ids, hs, pieces):
    import numpy as np

    i, a, sizes = np.array(pieces).T
    return take_runs(raw, offsets[i] + a, sizes), ids[i], hs[i], a, np.cumsum(sizes) - sizes, sizes


def _packed(place, offset, count):
    """Place of the first window, how far its anchor is, number of windows."""
    return place << 14 | offset << 7 | (count - 1)


def _keyed(group, length: int, heavy):
    """(akey, skey, id, h, at) of a group of texts, equal ones once, and with
    at < 0 the repeats found at hand."""
    import numpy as np

    data, ids, hs, place, starts, sizes = group
    anchor, first, count, words, akey = segments_of(data, starts, sizes, length)
    text = np.searchsorted(starts, first, "right") - 1
    # texts shorter than a window are not in the group, so starts differ
    offset = anchor - first
    skey = _window_hash(words, first, length, 1) * np.uint64(_B) + _window_hash(words, first + count - 1, length, 2)
    skey = _mixed(skey ^ (offset * 128 + count).astype(np.uint64) * np.uint64(_C))
    lone = np.isin(akey, heavy) if len(heavy) else np.zeros(len(akey), bool)
    if lone.any():
        each = take_runs(np.arange(int(count.max())), np.zeros(int(lone.sum()), np.int64), count[lone]) + np.repeat(first[lone], count[lone])
        whose = np.repeat(text[lone], count[lone])
        akey = np.concatenate([akey[~lone], _window_hash(words, each, length, 3)])
        skey = np.concatenate([skey[~lone], _window_hash(words, each, length, 4)])
        offset = np.concatenate([offset[~lone], np.zeros(len(each), np.int64)])
        count = np.concatenate([count[~lone], np.ones(len(each), np.int64)])
        text, first = np.concatenate([text[~lone], whose]), np.concatenate([first[~lone], each])
    at = _packed(place[text] + first - starts[text], offset, count)
    order = np.lexsort((first, skey, akey))
    new = np.append(True, (akey[order][1:] != akey[order][:-1]) | (skey[order][1:] != skey[order][:-1]))[: len(order)]
    # repeats go along to the next step, dealt out by their text
    known = order[~new]
    at[known] = -1 - at[known]
    akey[known] = hs[text[known]].view(np.uint64) + first[known].astype(np.uint64)
    return akey.view(np.int64), skey.view(np.int64), ids[text], hs[text], at


def _arrow(columns, names):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _anchors(length: int, heavy: tuple):
    def run(batches):
        import numpy as np

        some = np.array(heavy, np.int64).view(np.uint64)
        for batch in batches:
            for group in _groups_of(batch, length):
                yield _arrow(_keyed(group, length, some), ["akey", "skey", "id", "h", "at"])

    return run


def _frequent_anchors(length: int):
    """Anchors with one in SHARE of a group's rows or more; and, without an
    anchor, how many rows there are."""

    def run(batches):
        import numpy as np

        for batch in batches:
            for group in _groups_of(batch, length):
                akey, _, _, _, at = _keyed(group, length, np.zeros(0, np.uint64))
                key, n = np.unique(akey[at >= 0], return_counts=True)
                many = n * SHARE >= n.sum()
                many &= n > 1
                yield _arrow((np.append(key[many], 0), np.append(n[many], n.sum()), np.append(np.ones(int(many.sum()), bool), False)), ["akey", "n", "one"])

    return run


def heavy_anchors(texts: DataFrame, length: int) -> tuple:
    """Anchors that hold a share of all rows. The counts are of groups in
    which an anchor is frequent, so they are lower bounds: an anchor with 2
    in SHARE of the rows is found for certain, and at most SHARE are."""
    counts = stored(texts.mapInArrow(_frequent_anchors(length), "akey long, n long, one boolean"))
    total = counts.where("not one").agg(F.sum("n")).first()[0] or 0
    found = counts.where("one").groupBy("akey").agg(F.sum("n").alias("n")).where(F.col("n") * SHARE >= F.lit(total)).select("akey")
    return tuple(r.akey for r in found.collect())


def _meet(most: int):
    """Rows sorted by (akey, skey, id, h, at) in; out: kind 0, repeats; kind
    1, first segments of anchors with several, for sorting; kind 2, the same
    of anchors with more than ``most``."""

    def run(batches):
        import numpy as np

        names = ["kind", "akey", "id", "h", "at"]
        last = None  # the last row so far
        held: list = []  # first segments of its anchor
        n_held, wide = 0, False

        def out(kind, rows):
            return _arrow((np.full(len(rows[0]), kind, np.int32), rows[0], rows[2], rows[3], rows[4]), names)

        def joined(parts):
            return [np.concatenate(x) for x in zip(*parts)]

        for batch in batches:
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("akey", "skey", "id", "h", "at")]
            known = rows[4] < 0
            if known.any():
                done = [x[known] for x in rows]
                done[4] = -1 - done[4]
                yield out(0, done)
                rows = [x[~known] for x in rows]
            if not len(rows[0]):
                continue
            before = [np.concatenate([x[:1] ^ 1 if last is None else last[i : i + 1], x[:-1]]) for i, x in enumerate(rows)]
            last = np.array([x[-1] for x in rows])
            new_a = rows[0] != before[0]
            new_s = new_a | (rows[1] != before[1])
            same_place = ~new_s & (rows[2] == before[2]) & (rows[3] == before[3]) & (rows[4] == before[4])
            again = ~new_s & ~same_place
            if again.any():
                yield out(0, [x[again] for x in rows])
            firsts = [x[new_s] for x in rows]
            cuts = np.flatnonzero(new_a[new_s])
            if not len(cuts):  # all of the anchor at hand
                tail = firsts
            else:
                if n_held or wide:
                    part = joined(held + [[x[: cuts[0]] for x in firsts]]) if held else [x[: cuts[0]] for x in firsts]
                    n = len(part[0])
                    if n and (wide or n > 1):
                        yield out(2 if wide or n > most else 1, part)
                sizes = np.diff(cuts)
                for kind, chosen in ((1, (sizes > 1) & (sizes <= most)), (2, sizes > most)):
                    if chosen.any():
                        at = take_runs(np.arange(len(firsts[0])), cuts[:-1][chosen], sizes[chosen])
                        yield out(kind, [x[at] for x in firsts])
                held, n_held, wide = [], 0, False
                tail = [x[cuts[-1] :] for x in firsts]
            held.append(tail)
            n_held += len(tail[0])
            if wide or n_held > most:
                if n_held:
                    yield out(2, joined(held))
                held, n_held, wide = [], 0, True
        if held and n_held and (wide or n_held > 1):
            yield out(2 if wide else 1, joined(held))

    return run


def _met(keyed: DataFrame) -> DataFrame:
    order = ["akey", "skey", "id", "h", "at"]
    return keyed.repartition("akey").sortWithinPartitions(*order).mapInArrow(_meet(MOST), "kind int, akey long, id long, h long, at long")


def _cut_segments(length: int):
    """The texts of the segments asked for."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows = []
            for id_, h, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("id", "h", "text", "wanted"))):
                for w in wanted:
                    place, count = w["at"] >> 14, (w["at"] & 127) + 1
                    rows.append((w["akey"], id_, h, place, text[place : place + count + length - 1]))
            for i in range(0, len(rows), 20_000):
                akey, id_, h, place, part = zip(*rows[i : i + 20_000])
                yield pa.RecordBatch.from_arrays([*(pa.array(np.array(x, np.int64)) for x in (akey, id_, h, place)), pa.array(part, pa.binary())], names=["akey", "id", "h", "place", "part"])

    return run


def _cut_windows(length: int):
    """The windows of the segments asked for, each with a key of its own."""

    def run(batches):
        import numpy as np

        for batch in batches:
            rows = []
            for id_, h, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("id", "h", "text", "wanted"))):
                for w in wanted:
                    place, count = w["at"] >> 14, (w["at"] & 127) + 1
                    rows.append((id_, h, place, count, text[place : place + count + length - 1]))
            rows.sort(key=lambda r: r[:3])
            if not rows:
                continue
            id_, h, place, count = np.array([r[:4] for r in rows], np.int64).T
            data = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
            begin = np.cumsum(count + length - 1) - (count + length - 1)
            words = _words(data, length)
            inner = take_runs(np.arange(128), np.zeros(len(rows), np.int64), count)
            each = np.repeat(begin, count) + inner
            akey, skey = _window_hash(words, each, length, 3), _window_hash(words, each, length, 4)
            at = _packed(np.repeat(place, count) + inner, 0, 1)
            order = np.lexsort((np.arange(len(each)), skey, akey))
            new = np.append(True, (akey[order][1:] != akey[order][:-1]) | (skey[order][1:] != skey[order][:-1]))
            known = order[~new]
            at[known] = -1 - at[known]
            akey[known] = np.repeat(h, count)[known].view(np.uint64) + each[known].astype(np.uint64)
            yield _arrow((akey.view(np.int64), skey.view(np.int64), np.repeat(id_, count), np.repeat(h, count), at), ["akey", "skey", "id", "h", "at"])

    return run


def two_stage_suffixes(text, depth: int):
    """(places of all suffixes in the order of their first ``depth`` bytes,
    words): ties beyond are in any order. A suffix that ends is the smaller."""
    import numpy as np

    n = len(text)
    words = _words(text, depth + 8, ">")
    # a suffix is smaller than its successor if the next other byte is larger
    ends = np.flatnonzero(np.append(text[1:] != text[:-1], True))
    smaller = np.append(text[ends[:-1]] < text[ends[:-1] + 1], False)
    direct = np.flatnonzero(np.repeat(smaller, np.diff(np.append(-1, ends))))
    # stage one: sort those, eight bytes at a time, ties only
    key = words[direct]
    order = np.argsort(key, kind="stable")
    direct, key = direct[order], key[order]
    head = np.append(True, key[1:] != key[:-1])[: len(direct)]
    for o in range(8, depth, 8):
        tied = np.flatnonzero(~(head & np.append(head[1:], True)))
        if not len(tied):
            break
        of = np.cumsum(head)[tied]
        key = words[direct[tied] + o]
        order = np.lexsort((key, of))
        direct[tied] = direct[tied][order]
        key = key[order]
        head[tied[1:]] |= (key[1:] != key[:-1]) & (of[1:] == of[:-1])
    # stage two: one scan over the buckets induces the suffixes larger than their successors
    bucket = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list] = [[] for _ in range(256)]
    if n:
        waiting[int(text[-1])].append(np.array([n - 1]))  # before the empty suffix
    out = []
    for c in range(256):
        found = []
        new = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        while len(new):  # runs of the byte itself
            found.append(new)
            new = new[new > 0] - 1
            new = new[text[new] == c]
        found.append(direct[bucket[c] : bucket[c + 1]])
        here = np.concatenate(found)
        if not len(here):
            continue
        out.append(here)
        before = here[here > 0] - 1
        byte = text[before]
        before, byte = before[byte > c], byte[byte > c]
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        edges = np.flatnonzero(np.append(True, byte[1:] != byte[:-1])[: len(byte)])
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(byte)]):
            waiting[int(byte[a])].append(before[a:b])
    return np.concatenate(out) if out else np.zeros(0, np.int64), words


def common_prefixes(words, places, most: int):
    """Bytes that neighbours have in common from their places on, up to
    ``most``."""
    import numpy as np

    common = np.zeros(max(len(places) - 1, 0), np.int64)
    going = np.arange(len(common))
    for o in range(0, most, 8):
        differ = words[places[going] + o] ^ words[places[going + 1] + o]
        # equal bytes at the front of the eight
        common[going] += sum(((differ >> np.uint64(64 - 8 * j)) == 0).astype(np.int64) for j in range(1, 8)) + (differ == 0)
        going = going[differ == 0]
    return np.minimum(common, most)


def repeats_among(parts: list[bytes], ids, hs, place, length: int):
    """(segment, first window, windows) of stretches of windows of the
    segments that are equal to an earlier window of another place."""
    import numpy as np

    text = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.cumsum(sizes) - sizes
    order, words = two_stage_suffixes(text, length)
    segment = np.searchsorted(starts, order, "right") - 1
    whole = order + length <= starts[segment] + sizes[segment]
    order, segment = order[whole], segment[whole]
    equal = common_prefixes(words, order, length) >= length
    run = np.cumsum(np.append(True, ~equal))[: len(order)]
    many = np.append(equal, False) | np.append(False, equal)
    many = many[: len(order)]
    order, segment, run = order[many], segment[many], run[many]
    at = place[segment] + order - starts[segment]
    by = np.lexsort((at, hs[segment], ids[segment], run))
    segment, run, at = segment[by], run[by], at[by]
    new = np.append(True, run[1:] != run[:-1])[: len(run)]
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    same = (at == at[first]) & (hs[segment] == hs[segment[first]]) & (ids[segment] == ids[segment[first]])
    segment, at = segment[~same], at[~same]
    by = np.lexsort((at, segment))
    segment, at = segment[by], at[by]
    new = np.append(True, (segment[1:] != segment[:-1]) | (at[1:] != at[:-1] + 1))[: len(at)]
    begin = np.flatnonzero(new)
    return segment[begin], at[begin], np.diff(np.append(begin, len(at)))


def _sort_segments(length: int):
    """Segments sorted by akey in; (id, h, start, stop) of repeats out."""

    def run(batches):
        import numpy as np

        held: list = []
        size = 0

        def done(rows):
            akey, id_, h, place, parts = ([x for r in rows for x in r[i]] for i in range(5))
            id_, h, place = (np.array(x, np.int64) for x in (id_, h, place))
            segment, at, n = repeats_among(parts, id_, h, place, length)
            return _arrow((id_[segment], h[segment], at, at + n + length - 1), ["id", "h", "start", "stop"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("akey", "id", "h", "place", "part")]
            a = 0
            for i in range(len(columns[0])):
                key = columns[0][i]
                if size >= SORTED and key != (columns[0][i - 1] if i else held[-1][0][-1]):
                    held.append([x[a:i] for x in columns])
                    yield done(held)
                    held, size, a = [], 0, i
                size += len(columns[4][i])
            held.append([x[a:] for x in columns])
            held = [r for r in held if r[0]]
        if held:
            yield done(held)

    return run


def _remove(batches):
    """Rows sorted by (id, h) in: of rows with the same id and text the first
    has its repeats removed, and the others all that is as long as a window."""
    import numpy as np
    import pyarrow as pa

    last = None
    for batch in batches:
        spans, kept, size, removed = [], [], [], []
        for id_, h, text, found, length in zip(*(batch.column(c).to_pylist() for c in ("id", "h", "text", "found", "length"))):
            again, last = (id_, h) == last, (id_, h)
            size.append(len(text))
            if again:
                found = [{"start": 0, "stop": len(text)}] if len(text) >= length else None
            if not found:
                spans.append([])
                kept.append(text)
                removed.append(0)
                continue
            begin, end = np.array(sorted((f["start"], f["stop"]) for f in found)).T
            end = np.maximum.accumulate(end)
            new = np.append(True, begin[1:] > end[:-1])
            begin, end = begin[new], end[np.append(new[1:], True)]
            spans.append([{"start": a, "stop": b} for a, b in zip(begin.tolist(), end.tolist())])
            edges = [0, *np.stack([begin, end], 1).ravel().tolist(), len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
            removed.append(int((end - begin).sum()))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("own"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["own", "n_bytes", "n_removed", "spans", "kept"]
        )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """Id, n_bytes, n_removed, spans (start, stop), kept (bytes).

    Texts are bytes of UTF-8. Each byte goes that is in a string of
    ``length`` bytes which also starts earlier: in a document with a smaller
    id, or earlier in the same document, overlapping or not. Strings are
    judged on the input. ``spans`` are the maximal stretches removed; what is
    left is joined, and may end inside a character.

    Ids are integers. Of rows with one id but different texts the order is
    that of a hash of the text, of rows with the same id and text any one
    counts as the earlier; null ids come last. Rows are known by id and hash
    of the text, never by their place in the table, so nothing depends on how
    it is split. Null texts count as empty; texts below ``length`` bytes stay
    whole; texts of any length are searched whole, in stretches; an empty
    table gives none. Other columns are not read. Keys and segments are
    compared by two independent 64-bit hashes, or by their bytes.
    """
    if not GRAM + 8 <= length <= GRAM + 100:
        raise ValueError("length must be from 32 to 124")
    own = F.col(id_col).cast("long")
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    texts = docs.select(own.alias("own"), F.coalesce(own, F.lit(_NO_ID)).alias("id"), F.xxhash64(text, own.isNull()).alias("h"), text.alias("text"))
    searched = texts.where(F.octet_length("text") >= length).select("id", "h", "text")
    # all that is fetched from texts below, and what is left of them, comes
    # from this one shuffle: with the same columns each time, and nothing
    # filtered before it, Spark writes it once
    dealt = texts.repartition("id", "h")

    met = stored(_met(searched.mapInArrow(_anchors(length, heavy_anchors(searched, length)), KEYED)))
    place = F.shiftright("at", 14)
    plain = met.where("kind = 0").select("id", "h", place.alias("start"), (place + F.col("at").bitwiseAND(127) + F.lit(length)).alias("stop"))
    found = [plain]

    def asked(kind: int) -> DataFrame:
        wanted = met.where(F.col("kind") == kind).groupBy("id", "h").agg(F.collect_list(F.struct("akey", "at")).alias("wanted"))
        return dealt.join(wanted, ["id", "h"]).select("own", "id", "h", "text", "wanted")

    parts = asked(1).mapInArrow(_cut_segments(length), "akey long, id long, h long, place long, part binary")
    found.append(parts.repartition("akey").sortWithinPartitions("akey").mapInArrow(_sort_segments(length), "id long, h long, start long, stop long"))
    if met.where("kind = 2").take(1):
        windows = _met(asked(2).mapInArrow(_cut_windows(length), KEYED))
        found.append(windows.where("kind = 0").select("id", "h", place.alias("start"), (place + F.lit(length)).alias("stop")))

    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    spans = every.groupBy("id", "h").agg(F.collect_list(F.struct("start", "stop")).alias("found"))
    rows = dealt.join(spans, ["id", "h"], "left").withColumn("length", F.lit(length)).sortWithinPartitions("id", "h")
    left = rows.select("own", "id", "h", "text", "found", "length").mapInArrow(_remove, "own long, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept binary")
    return left.select(F.col("own").cast(docs.schema[id_col].dataType).alias(id_col), "n_bytes", "n_removed", "spans", "kept")
