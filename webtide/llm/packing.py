"""Sequence packing by non-negative least squares.

A document longer than the window gives full windows and a remainder.
Remainders are counted by length class (``grain`` tokens each, rounded up).
All combinations of up to ``depth`` classes that fill the window exactly are
the columns of a matrix; non-negative least squares finds how often to use
each so that together they use up the histogram. The solution is rounded
down to what the histogram holds. What is left is packed greedily, largest
class first, and a document is cut only where a gap would stay that no
remaining class fits.

All of this happens on the histogram, whose size is that of the window, not
of the corpus. Documents are then numbered within their class, and the
number alone tells the sequence; nothing is collected.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered_within, stored, whole_text
from .texts import PieceIds, groups, releasing, stretches

WINDOW = 4096
#: Tokens of a length class, and classes in a combination.
GRAIN = 16
DEPTH = 4
#: Steps of the active-set method.
STEPS = 600


def combinations_filling(total: int, depth: int):
    """All ways to write ``total`` as a sum of 1 to ``depth`` classes, largest
    first, as rows padded with 0 (numpy)."""
    import numpy as np

    # rows: (classes so far, what is left)
    rows, left, done = np.zeros((1, 0), np.int64), np.array([total]), []
    for d in range(depth):
        high = np.minimum(left, rows[:, -1]) if d else left
        low = -(-left // (depth - d))  # the rest must not need a larger class
        n = np.maximum(high - low + 1, 0)
        pick = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        rows, left = np.column_stack([np.repeat(rows, n, axis=0), pick]), np.repeat(left, n) - pick
        whole = left == 0
        done.append(np.pad(rows[whole], ((0, 0), (0, depth - d - 1))))
        rows, left = rows[~whole], left[~whole]
    return np.concatenate(done)


def non_negative_least_squares(columns, target, weight, steps: int = STEPS):
    """x >= 0 for least |weight * (A x - target)|, by the active-set method of
    Lawson and Hanson. A column of A counts the classes in a row of
    ``columns``; index 0 is padding."""
    import numpy as np

    n = len(target)  # target[0] is unused
    x = np.zeros(len(columns))
    active: list[int] = []
    square = weight**2
    aim = square * target
    matrix, gram = np.zeros((n, 0)), np.zeros((0, 0))  # active columns, and their weighted products
    residual = target * 1.0
    scale = max(1.0, float(aim.max()))
    for _ in range(steps):
        pull = square * residual
        pull[0] = 0
        gain = pull[columns].sum(1)
        gain[active] = -1
        best = int(gain.argmax())
        if gain[best] <= 1e-9 * scale:
            break
        new = np.bincount(columns[best], minlength=n).astype(float)
        new[0] = 0
        beside = matrix.T @ (square * new)
        gram = np.block([[gram, beside[:, None]], [beside[None, :], np.array([[(square * new) @ new]])]])
        matrix = np.column_stack([matrix, new])
        active.append(best)
        while active:
            z = np.linalg.solve(gram + 1e-10 * np.eye(len(active)), matrix.T @ aim)
            if (z > 1e-12).all():
                break
            now = x[active]
            bad = z <= 1e-12
            step = min(1.0, float((now[bad] / np.maximum(now[bad] - z[bad], 1e-300)).min()))
            now = now + step * (z - now)
            stay = (now > 1e-12) & ~(bad & (now <= now[bad].min() + 1e-12))
            x[active] = np.where(stay, now, 0)
            active = [i for i, s in zip(active, stay) if s]
            matrix, gram = matrix[:, stay], gram[stay][:, stay]
        x[active] = z if active else 0
        residual = target - matrix @ x[active]
    return x


class Plan:
    """Which sequence each numbered remainder of a class goes to.

    A population is a class's remainders, or the tails that cuts leave;
    its members are numbered. ``rows`` are ranges of members: population,
    first and last member, the number at which the range starts within its
    pattern, members of one sequence, the pattern's first sequence, the place
    of the first member in a sequence, classes in the head that is cut off
    (0: uncut), and population and member to which the first tail belongs.
    """

    def __init__(self, histogram, classes: int, depth: int = DEPTH):
        import numpy as np

        self.classes = classes
        self.left = np.array(histogram, np.int64)  # members of a class not yet placed; index 0 is unused
        # population: [class, members, members placed]; the first ones are the classes' own
        self.populations = [[c, int(self.left[c]), 0] for c in range(classes + 1)]
        self.of_class: list[list[int]] = [[c] for c in range(classes + 1)]
        self.rows: list[tuple[int, ...]] = []
        self.sequences = 0
        self._least_squares(depth)
        self._greedy()

    def _place(self, uses: list[tuple[int, int, int]], times: int) -> None:
        """``uses``: (class, members in a sequence, head cut off or 0)."""
        place = 0
        for c, each, head in uses:
            need, start, tail = times * each, 0, None
            if head:
                tail = len(self.populations)
                self.populations.append([c - head, need, 0])
                self.of_class[c - head].append(tail)
                self.left[c - head] += need
            self.left[c] -= need
            for p in self.of_class[c]:
                held = self.populations[p]
                n = min(need - start, held[1] - held[2])
                if n and p != tail:
                    self.rows.append((p, held[2], held[2] + n, start, each, self.sequences, place, head, -1 if tail is None else tail, start))
                    held[2] += n
                    start += n
            place += each
        self.sequences += times

    def _least_squares(self, depth: int) -> None:
        import numpy as np

        columns = combinations_filling(self.classes, depth)
        there = self.left > 0
        there[0] = True
        columns = columns[there[columns].all(1)]
        if not len(columns):
            return
        weight = np.arange(self.classes + 1) / self.classes
        x = non_negative_least_squares(columns, self.left.astype(float), weight)
        for i in np.argsort(-x, kind="stable"):
            if x[i] < 1:
                break
            used, each = np.unique(columns[i][columns[i] > 0], return_counts=True)
            times = int(min(np.floor(x[i] + 1e-6), (self.left[used] // each).min()))
            if times:
                self._place([(int(c), int(m), 0) for c, m in zip(used[::-1], each[::-1])], times)

    def _greedy(self) -> None:
        cuts = 64 * self.classes  # then gaps stay, so that the loop ends
        while (self.left[1:] > 0).any():
            room, uses, used = self.classes, [], {}
            for c in range(self.classes, 0, -1):
                n = int(min(room // c, self.left[c]))
                if n:
                    uses.append((c, n, 0))
                    used[c] = n
                    room -= n * c
            if room and cuts:
                # every class that fits is used up: the most frequent larger one is cut
                spare = {c: int(self.left[c]) - used.get(c, 0) for c in range(room + 1, self.classes + 1)}
                c = max(spare, key=lambda c: (spare[c], c))
                if spare[c] > 0:
                    uses.append((c, 1, room))
                    used[c] = used.get(c, 0) + 1
                    cuts -= 1
            self._place(uses, int(min(self.left[c] // n for c, n in used.items())))


# The tokenizer's pattern, spelt for ``re`` and lower-cased
# text, and the characters beyond which ``re`` and ``str.lower`` may see
# letters, numbers, blanks or compositions in another way.
_WORD = re.compile(r"[a-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|(?:[^\w\s]|_)+")
_BEYOND = re.compile(r"[^\x00-\u024f]|[\u00b2\u00b3\u00b9\u00bc-\u00be\x1c-\x1f\x85\xa0]")
_BLANK_DELIMITED = re.compile(r"[^ \t\n\r\f\v]+")
#: Before a part that the whole tokenizer has to read; no match has it.
_WHOLE = "\x1f"


def split(text: str) -> list[str]:
    """Parts of a text that are tokenized each for itself, in order. In common
    alphabets they are the matches of the tokenizer's pattern in the
    lower-cased text, ready for the tokenizer's model; elsewhere what stands
    between ASCII blanks, marked with ``_WHOLE``, for no token goes across
    blanks."""
    if _BEYOND.search(text):
        return [_WHOLE + w for w in _BLANK_DELIMITED.findall(text)]
    return _WORD.findall(text.lower())


def byte_letters() -> dict[int, str]:
    """The letter by which a byte-level tokenizer writes each byte: visible
    Latin-1 characters stand for themselves, the others for 256, 257, ..."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(rest)}


def binary_array(offsets, values):
    """A binary Arrow array of the byte ranges between ``offsets``."""
    import numpy as np
    import pyarrow as pa

    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values)])


def _tokenize(model, end: int, width: str):
    def run(batches):
        import os

        import numpy as np
        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(model.value)
        tokenizer.encode_special_tokens = True
        letters, merge = byte_letters(), tokenizer.model.tokenize

        def encode(words):
            found = [
                tokenizer.encode(w[1:], add_special_tokens=False).ids if w[0] == _WHOLE else [t.id for t in merge(w if w.isascii() else w.encode().decode("latin-1").translate(letters))]
                for w in words
            ]
            length = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter(chain.from_iterable(found), np.uint32, int(length.sum())), length

        held = PieceIds(encode, np.uint32, 400_000)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in groups(texts):
                counts, words = [], []
                for t in texts[a:b]:
                    before = len(words)
                    for s in stretches(t):
                        words += split(s)
                    counts.append(len(words) - before)
                ids, length = held.ids(words)
                ends = np.concatenate([[0], np.cumsum(length)])[np.cumsum(counts)]
                flat = np.insert(ids, ends, end).astype(width)
                offsets = np.concatenate([[0], ends + np.arange(1, b - a + 1)]) * flat.itemsize
                yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in batch.columns[:-1]], binary_array(offsets, flat)], names=["id", "row", "ids"])

    return run


def _pieces(table: list[tuple[int, ...]], sequences: int, window: int, grain: int):
    """Pieces of numbered items; ``table`` is the plan's."""

    def run(frames):
        import numpy as np

        rows = np.array(sorted(table), np.int64).reshape(-1, 10)
        populations, firsts = np.unique(rows[:, 0], return_index=True)
        span = int(rows[:, 2].max(initial=0)) + 1
        key = rows[:, 0] * span + rows[:, 1]
        for f in frames:
            full = f["class"].to_numpy() > window // grain
            whole = f[full]
            out = [pd.DataFrame({"row": whole["row"], "start": whole["start"], "length": whole["length"], "sequence": sequences + whole["number"], "place": 0})]
            rest = f[~full]
            row, start, length = (rest[c].to_numpy(np.int64) for c in ("row", "start", "length"))
            population, number = rest["class"].to_numpy(np.int64), rest["number"].to_numpy(np.int64)
            while len(row):
                r = rows[np.searchsorted(key, population * span + number, "right") - 1]
                at = number - r[:, 1] + r[:, 3]
                cut = r[:, 7] * grain
                piece = np.where(cut > 0, cut, length)
                out.append(pd.DataFrame({"row": row, "start": start, "length": piece, "sequence": r[:, 5] + at // r[:, 4], "place": r[:, 6] + at % r[:, 4]}))
                on = cut > 0
                row, start, length = row[on], (start + piece)[on], (length - piece)[on]
                population, number = r[on, 8], (number - r[:, 1] + r[:, 9])[on]
            yield pd.concat(out, ignore_index=True)

    return run


def _cut(width: str):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            pieces = batch.column("pieces")
            repeat = pa.array(np.repeat(np.arange(len(pieces)), np.diff(pieces.offsets.to_numpy())))
            columns = dict(zip((f.name for f in pieces.type.value_type), pieces.flatten().flatten()))
            # the pieces of a row follow each other, so all pieces together are
            # the rows' ids as they stand
            ids = batch.column("ids")
            low, high = ids.offset, ids.offset + len(ids) + 1
            offsets = np.frombuffer(ids.buffers()[1], np.int32)[low:high]
            flat = np.frombuffer(ids.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view(width).astype("<u4")
            cuts = np.concatenate([[0], np.cumsum(columns["length"].to_numpy())]) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(repeat), *[columns[c] for c in ("start", "length", "sequence", "offset")], binary_array(cuts, flat), batch.column("tokens").take(repeat)],
                names=["id", "start", "length", "sequence", "offset", "ids", "tokens"],
            )

    return run


def pack(docs: DataFrame, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, grain: int = GRAIN, depth: int = DEPTH) -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian unsigned
    32-bit), doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a tokenizers file that drops white space;
    ``end`` is put after each document. Every document has at least that
    token (null and empty texts only it); each of its ids is in exactly one
    piece. Sequences hold at most ``window`` tokens and are meant to be padded
    to it; offsets run from 0 without gaps. Long documents give full windows
    and a remainder. Repeated rows are documents of their own; an empty table
    gives no pieces.
    """
    if window % grain:
        raise ValueError("the grain must divide the window")
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        content = json.load(f)
    model = spark.sparkContext.broadcast(json.dumps(content))
    # ids are stored as narrow as the vocabulary allows
    most = max(end, *content["model"]["vocab"].values(), *(t["id"] for t in content["added_tokens"]))
    width, size = ("<u2", 2) if most < 1 << 16 else ("<u4", 4)
    texts = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), whole_text(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    encoded = stored(texts.mapInArrow(releasing(_tokenize(model, end, width)), f"id {kind}, row long, ids binary"))
    tokens = (F.octet_length("ids") / size).cast("long").alias("tokens")
    sizes = encoded.select("row", tokens)
    classes = window // grain
    rest = F.col("tokens") % window
    # full windows are a class of their own
    windows = F.when(F.col("tokens") >= window, F.transform(F.sequence(F.lit(0).cast("long"), F.floor(F.col("tokens") / window) - 1), lambda k: F.struct(F.lit(classes + 1).alias("class"), (k * window).alias("start"), F.lit(window).cast("long").alias("length"))))
    last = F.when(rest > 0, F.array(F.struct(F.ceil(rest / grain).cast("int").alias("class"), (F.col("tokens") - rest).alias("start"), rest.alias("length"))))
    none = F.array().cast("array<struct<class:int,start:long,length:long>>")
    items = sizes.select("row", F.explode(F.concat(F.coalesce(windows, none), F.coalesce(last, none))).alias("item")).select("row", "item.*")
    histogram = [0] * (classes + 1)
    for r in items.where(F.col("class") <= classes).groupBy("class").count().collect():  # one row for each class
        histogram[r["class"]] = r["count"]
    plan = Plan(histogram, classes, depth)
    numbered = numbered_within(items, "class", "number", ("row", "start"))
    placed = numbered.mapInPandas(_pieces(plan.rows, plan.sequences, window, grain), "row long, start long, length long, sequence long, place long")
    before = Window.partitionBy("sequence").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    pieces = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    by_row = pieces.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "length", "sequence", "offset"))).alias("pieces"))
    joined = encoded.join(by_row, "row").select("id", "ids", "pieces", tokens)
    cut = joined.mapInArrow(releasing(_cut(width)), f"id {kind}, start long, length long, sequence long, offset long, ids binary, tokens long")
    return cut.select(F.col("id").alias(id_col), "start", "length", "ids", F.col("tokens").alias("doc_tokens"), F.col("sequence").alias("sequence_id"), "offset")
