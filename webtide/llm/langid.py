"""Language identification by nearest centroids.

A text is a vector of hashed character n-grams (1 to 3 letters, words
bounded by blanks), log counts times inverse document frequency, of length
one. Each language has several centroids, found by spherical k-means on a
bounded sample of its labelled rows; document frequencies are counted over
all training rows. A text gets the language of the centroid with the largest
cosine. It is rejected when its cosine is far below what training rows of
about its length have; a text longer or shorter than all of them is compared
with the nearest.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .texts import releasing
from .common import whole_text

UNKNOWN = "und"
ORDERS = (1, 2, 3)
#: Buckets of hashed n-grams, a power of two.
FEATURES = 4096
#: Centroids of a language, and rounds of k-means.
CENTROIDS = 4
ROUNDS = 10
#: Labelled rows that centroids are fitted on, over all languages, as an
#: expected number: rows are drawn by a hash.
FIT_ROWS = 2000
#: A text is rejected if its cosine is below this share of the cosine that
#: all but this quantile of the training rows of its length class reach.
REJECT_SHARE = 0.25
REJECT_QUANTILE = 0.01
#: Training rows that neighbouring length classes are pooled to, at least.
POOL_ROWS = 300
#: Length classes: bits of the number of n-grams.
CLASSES = 64
#: Steps of the cosines that are counted for the quantiles.
STEPS = 1000
#: Texts of a block of counts: BLOCK * FEATURES counters are held.
BLOCK = 128
_ODD = 0x9E3779B97F4A7C15


def letter_table():
    """Whether a code point is a letter, as packed bits."""
    import numpy as np

    return np.packbits(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))


def count_blocks(texts: list[str], letters) -> Iterator:
    """Counts of hashed n-grams of texts: arrays of BLOCK rows at most."""
    import numpy as np

    bits = FEATURES.bit_length() - 1
    stretch = 1 << 18  # characters of a block, or one text
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and stop - at < BLOCK and (size < stretch or stop == at):
            size += len(texts[stop])
            stop += 1
        some = [t.lower() for t in texts[at:stop]]
        at = stop
        counts = np.zeros(len(some) * FEATURES, np.int64)
        points = np.frombuffer(("\0".join(some) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
        doc = np.repeat(np.arange(len(some)), np.fromiter((len(t) + 1 for t in some), np.int64, len(some)))
        points = np.where(letters[points], points, 0)
        # a run of other characters is one blank
        stay = points != 0
        stay[1:] |= points[:-1] != 0
        points, doc = np.concatenate([[0], points[stay]]).astype(np.uint64), doc[stay]
        doc = np.concatenate([doc[:1], doc])
        real = points != 0
        for n in ORDERS:
            if n == 1:
                keep = np.flatnonzero(real)
                key, own = points[keep], doc[keep]
            else:
                # blanks only at the ends, and a letter at least
                fits = np.ones(max(len(points) - n + 1, 0), bool)
                for k in range(1, n - 1):
                    fits &= real[k : len(points) - n + 1 + k]
                if n == 2:
                    fits &= real[:-1] | real[1:]
                keep = np.flatnonzero(fits)
                key = np.zeros(len(keep), np.uint64)
                for k in range(n):
                    key = key * np.uint64(0x110000) + points[keep + k]
                # the blank between two texts counts for the text of the letter
                own = np.where(real[keep], doc[keep], doc[np.minimum(keep + 1, len(doc) - 1)])
            feature = ((key * np.uint64(8) + np.uint64(n)) * np.uint64(_ODD)) >> np.uint64(64 - bits)
            counts += np.bincount(own * FEATURES + feature.astype(np.int64), minlength=len(counts))
        yield counts.reshape(len(some), FEATURES)


def unit_vectors(counts, idf):
    """TF-IDF vectors of length one (a zero row stays zero)."""
    import numpy as np

    x = np.log1p(counts.astype(np.float32)) * idf
    size = np.sqrt((x * x).sum(1))
    return x / np.maximum(size, 1e-12)[:, None]


def spherical_k_means(x, k: int, rounds: int = ROUNDS):
    """At most ``k`` centroids of unit vectors; the first is the mean's
    nearest row, each further one the row farthest from those chosen."""
    import numpy as np

    near = x @ x.mean(0)
    chosen = [int(near.argmax())]
    best = x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)):
        i = int(best.argmin())
        if best[i] > 1 - 1e-6:
            break
        chosen.append(i)
        best = np.maximum(best, x @ x[i])
    centroids = x[chosen]
    for _ in range(rounds):
        own = (x @ centroids.T).argmax(1)
        sums = np.stack([x[own == c].sum(0) if (own == c).any() else centroids[c] for c in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1), 1e-12)[:, None]
    return centroids


def rejection_limits(scores: list[tuple[int, int, int, float]]) -> list[float]:
    """Limit of each length class, from (class, step, rows, smallest cosine)
    of training rows. Neighbouring classes are pooled from the shortest on;
    what is left over joins the last pool. A class without rows has the limit
    of the nearest that has some, of two the shorter one's."""
    steps: dict[int, list[tuple[int, int, float]]] = {}
    for length, step, n, low in scores:
        steps.setdefault(length, []).append((step, n, low))
    pools: list[list[int]] = []
    pooled = POOL_ROWS
    for length in sorted(steps):
        if pooled >= POOL_ROWS:
            pools.append([])
            pooled = 0
        pools[-1].append(length)
        pooled += sum(n for _, n, _ in steps[length])
    if len(pools) > 1 and pooled < POOL_ROWS:
        left = pools.pop()
        pools[-1] += left
    limits = {}
    for pool in pools:
        rows = sorted(x for length in pool for x in steps[length])
        rank, seen = REJECT_QUANTILE * sum(n for _, n, _ in rows), 0
        for step, n, low in rows:
            seen += n
            if seen >= rank:
                # smallest of this step in any class of the pool
                limit = REJECT_SHARE * min(x for s, _, x in rows if s == step)
                limits |= dict.fromkeys(pool, limit)
                break
    return [limits[min(limits, key=lambda x: (abs(x - k), x))] for k in range(CLASSES)] if limits else [0.0] * CLASSES


def _document_frequency(model):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        letters = np.unpackbits(model.value).astype(bool)
        seen, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            n += len(texts)
            for counts in count_blocks(texts, letters):
                seen += (counts > 0).sum(0)
        # feature -1 counts the documents
        there = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(there, -1), pa.int32()), pa.array(np.append(seen[there], n), pa.int64())], names=["feature", "docs"])

    return run


def _sparse_counts(model):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        letters = np.unpackbits(model.value).astype(bool)
        for batch in batches:
            where, held = [], []
            for counts in count_blocks(batch.column("text").to_pylist(), letters):
                for c in counts:
                    where.append(np.flatnonzero(c))
                    held.append(c[where[-1]])
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(where, pa.list_(pa.int32())), pa.array(held, pa.list_(pa.int32()))], names=["lang", "features", "counts"])

    return run


class LanguageModel:
    """Nearest-centroid language identification.

    ``fit`` learns from rows with a label; rows without one, and rows for
    which ``train`` is false or null, are not used. ``predict`` gives lang,
    score (the cosine, 0 to 1), rejected and a length class for a text column.
    Null texts and texts without a letter are ``und``, with score 0, and
    rejected, as is everything when there were no rows to learn from. Texts of
    any length are read whole. Equal cosines go to the first language in
    alphabetical order.
    """

    def __init__(self, spark, langs: list[str], centroids, idf, limits: list[float]):
        self.spark, self.langs, self.centroids, self.idf, self.limits = spark, langs, centroids, idf, limits
        self.shared = spark.sparkContext.broadcast((langs, centroids, idf, letter_table(), limits))

    @classmethod
    def fit(cls, docs: DataFrame, train: Column, text_col: str = "text", label_col: str = "lang", fit_rows: int = FIT_ROWS) -> LanguageModel:
        import numpy as np

        spark = docs.sparkSession
        table = spark.sparkContext.broadcast(letter_table())
        rows = docs.where(train & F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("lang"))
        frequency = rows.select("text").mapInArrow(releasing(_document_frequency(table)), "feature int, docs long").groupBy("feature").agg(F.sum("docs").alias("docs"))
        docs_with = {r["feature"]: r["docs"] for r in frequency.collect()}  # FEATURES rows
        total = docs_with.pop(-1, 0)
        df = np.zeros(FEATURES)
        df[list(docs_with)] = list(docs_with.values())
        idf = (np.log((total + 1) / (df + 1)) + 1).astype(np.float32)

        per_lang = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row for each language
        if not per_lang:
            return cls(spark, [], np.zeros((0, FEATURES), np.float32), idf, rejection_limits([]))
        share = F.lit(0.0)
        for lang, n in per_lang.items():
            share = F.when(F.col("lang") == lang, fit_rows / len(per_lang) / n).otherwise(share)
        draw = F.pmod(F.xxhash64("text", F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)
        # equal texts are one row of the sample
        drawn = rows.where(draw < share).dropDuplicates(["lang", "text"])
        held: dict[str, list] = {lang: [] for lang in sorted(per_lang)}
        for r in drawn.mapInArrow(releasing(_sparse_counts(table)), "lang string, features array<int>, counts array<int>").toLocalIterator():
            counts = np.zeros(FEATURES, np.int32)
            counts[r["features"]] = r["counts"]
            held[r["lang"]].append(unit_vectors(counts[None], idf)[0])
        langs, centroids = [], []
        for lang, x in held.items():
            if x:
                found = spherical_k_means(np.stack(x), CENTROIDS)
                langs += [lang] * len(found)
                centroids.append(found)
        model = cls(spark, langs, np.concatenate(centroids).astype(np.float32) if centroids else np.zeros((0, FEATURES), np.float32), idf, rejection_limits([]))
        scored = rows.select(model.predict(F.col("text")).alias("p")).where(F.col("p.lang") != UNKNOWN)
        step = F.floor(F.col("p.score") * STEPS).cast("int").alias("step")
        counted = scored.groupBy("p.length_class", step).agg(F.count("*").alias("n"), F.min("p.score").alias("low"))
        limits = rejection_limits([tuple(r) for r in counted.collect()])  # CLASSES * (STEPS + 1) rows at most
        return cls(spark, langs, model.centroids, idf, limits)

    def predict(self, text: Column) -> Column:
        shared = self.shared

        @F.pandas_udf("lang string, score double, rejected boolean, length_class int")
        def identify(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            import numpy as np

            langs, centroids, idf, packed, limits = shared.value
            letters = np.unpackbits(packed).astype(bool)
            for column in texts:
                n = len(column)
                lang, score, rejected, length = [UNKNOWN] * n, np.zeros(n), np.ones(n, bool), np.zeros(n, np.int32)
                at = 0
                for counts in count_blocks([t or "" for t in column], letters):
                    size = counts.sum(1)
                    if langs:
                        cosine = unit_vectors(counts, idf) @ centroids.T
                        best = cosine.argmax(1)
                        for i in np.flatnonzero(size).tolist():
                            k = at + i
                            lang[k], score[k] = langs[best[i]], min(1.0, max(0.0, float(cosine[i, best[i]])))
                            length[k] = int(size[i]).bit_length()
                            rejected[k] = score[k] <= 0 or score[k] < limits[length[k]]
                    at += len(counts)
                yield pd.DataFrame({"lang": lang, "score": score, "rejected": rejected, "length_class": length})

        return identify(whole_text(text))


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Whether a row is in the held-out part by the CRC-32 of its id as text
    (a null id: of the empty text)."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")), F.lit(parts)) == part


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """Id, held_out, lang_pred, score, rejected of every row; learned from the
    rows with a label that are not held out. An empty table gives no rows."""
    out = held_out(id_col, 4, 2)
    model = LanguageModel.fit(docs, ~out, text_col, label_col)
    rows = docs.select(F.col(id_col), out.alias("held_out"), model.predict(F.col(text_col)).alias("p"))
    return rows.select(id_col, "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.rejected").alias("rejected"))


def drop_rejected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """``docs`` without the rows whose language is unknown or rejected."""
    model = LanguageModel.fit(docs, ~held_out(id_col, 4, 2), text_col, label_col)
    return docs.where(~model.predict(F.col(text_col))["rejected"])
