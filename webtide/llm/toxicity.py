"""Toxicity by maximum-scoring segments.

Tokens are words and the beginnings of words. From a bounded sample of
labelled rows each token gets its log-odds ratio between toxic and clean
texts with an informative Dirichlet prior (Monroe, Colaresi and Quinn 2008),
and tokens whose ratio is significant are the model. In a text every word
scores by its longest token in the model, all others a small negative drift.
A linear-time scan (Ruzzo and Tompa 1999) finds all maximal segments. As in
sequence comparison (Karlin and Altschul 1990), the number of segments of
score S or more that a clean text of N words has by chance is
K * N * exp(-lambda * S); a segment is significant if that is small. The
evidence of a text sums up its segments, and a logistic curve turns it into
a score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .texts import releasing
from .common import stored, whole_text
from .langid import held_out

#: Labelled rows of each class that the model is fitted on, as an expected
#: number: rows are drawn by a hash of their id.
FIT_ROWS = 8192
#: Tokens of the model, and the least rows, log-odds and z-score of one.
MODEL_TOKENS = 20_000
MIN_ROWS = 3
MIN_ODDS = 1.5
MIN_Z = 2.5
#: Lengths of the beginnings of words.
BEGINNINGS = (3, 4, 5, 6)
#: What a word without a token in the model scores.
DRIFT = -0.5
#: Weight of the prior, in rows.
PRIOR_ROWS = 100.0
#: Chance segments below which a segment is significant.
SIGNIFICANT = 0.05

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def tokens_of(word: str) -> list[str]:
    """The tokens of a word, longest first: the word (marked at its end) and
    its beginnings."""
    return [word + "$", *[word[:n] for n in reversed(BEGINNINGS) if len(word) >= n]]


def maximal_segments(scores: list[tuple[int, float]], length: int, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (from, to, score) of a sequence of
    ``length`` words, of which those in ``scores`` (place, score > 0) are
    positive and all others score ``drift``."""
    # [from, to, sum before it, sum up to its end, the nearest one to the left
    # with a smaller sum before it]: with that link the scan is linear
    held: list[list[float]] = []
    total, at = 0.0, 0
    for place, score in scores:
        total += (place - at) * drift
        at = place + 1
        new = [place, at, total, total + score]
        total += score
        j = len(held) - 1
        while True:
            while j >= 0 and held[j][2] >= new[2]:
                j = held[j][4]
            if j < 0 or held[j][3] >= new[3]:
                held.append([*new, j])
                break
            new = [held[j][0], new[1], held[j][2], new[3]]
            left = held[j][4]
            del held[j:]
            j = left
    return [(int(a), int(b), high - low) for a, b, low, high, _ in held]


class _Scores(dict):
    """Scores of words by their longest token in the model."""

    def __init__(self, model: dict[str, float], most: int = 200_000):
        self.model, self.most = model, most

    def __missing__(self, word: str) -> float:
        if len(self) > self.most:
            self.clear()
        for token in tokens_of(word):
            if token in self.model:
                score = self.model[token]
                break
        else:
            score = 0.0
        self[word] = score
        return score


def segments_of(text: str, scores: _Scores) -> tuple[int, list[tuple[int, int, float]]]:
    """(words, maximal segments) of a text."""
    words = words_of(text)
    found = list(map(scores.__getitem__, words))
    return len(words), maximal_segments([(i, s) for i, s in enumerate(found) if s > 0], len(words), DRIFT)


def evidence(n: int, segments: list[tuple[int, int, float]], scale: float, log_k: float) -> float:
    """ln(1 + sum of 1 / chance segments), capped where the largest would
    overflow."""
    if not segments:
        return 0.0
    logs = [scale * s - log_k - math.log(max(n, 1)) for _, _, s in segments]
    top = max(logs)
    return float(top + math.log(sum(math.exp(x - top) for x in logs) + math.exp(min(-top, 700.0))))


def karlin_lambda(positive: dict[float, float]) -> float:
    """The positive root of sum p(s) * exp(x * s) = 1 for the word scores of
    clean texts; ``positive`` has the shares of the scores above zero."""
    rest = 1 - sum(positive.values())

    def excess(x: float) -> float:
        return rest * math.exp(x * DRIFT) + sum(p * math.exp(min(x * s, 700.0)) for s, p in positive.items()) - 1

    low, high = 1e-6, 1.0
    if excess(low) >= 0:
        return low  # clean texts score too high on average; nothing is significant
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return low


def logistic(x, y, weight, rounds: int = 50, ridge: float = 1e-2):
    """Intercept and slope by Newton's method, with a small ridge."""
    import numpy as np

    beta = np.zeros(2)
    design = np.column_stack([np.ones(len(x)), x])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (weight * (y - p)) - ridge * beta
        bend = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(bend, slope)
        beta = beta + np.clip(step, -4, 4)
        if abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def _token_rows(batches):
    """(token, rows of toxic texts, rows of clean texts) of a task."""
    from collections import Counter

    import pyarrow as pa

    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            seen[toxic].update({t for w in set(words_of(text)) for t in tokens_of(w)})
    tokens = list(seen[0].keys() | seen[1].keys())
    for i in range(0, len(tokens), 1 << 16):
        some = tokens[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([seen[1][t] for t in some], pa.int64()), pa.array([seen[0][t] for t in some], pa.int64())], names=["token", "in_toxic", "in_clean"])


def _token_scores(shared):
    """(toxic, score of a word, words with it) of a task; score 0 counts all."""

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        scores, seen = _Scores(shared.value), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                found = [round(scores[w], 2) for w in words_of(text)]
                seen.update((toxic, s) for s in found if s > 0)
                seen[toxic, 0.0] += len(found)
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in seen], pa.int32()), pa.array([s for _, s in seen], pa.float64()), pa.array(list(seen.values()), pa.int64())], names=["toxic", "score", "words"])

    return run


class ToxicityModel:
    """Toxicity scores of texts.

    ``fit`` learns from the rows of ``docs`` that have a label 0 or 1 in
    ``labels`` and for which ``train`` holds, at most about ``fit_rows`` of
    each class; equal texts count once. ``score`` gives 0 to 1 for a text
    column: null and empty texts score like any text without toxic words.
    ``passages`` gives the significant segments. Without labelled rows of
    both classes every score is 0. Texts of any length are read whole.
    """

    def __init__(self, spark, tokens: dict[str, float], scale: float, log_k: float, intercept: float, slope: float):
        self.tokens, self.scale, self.log_k, self.intercept, self.slope = tokens, scale, log_k, intercept, slope
        self.shared = spark.sparkContext.broadcast((tokens, scale, log_k, intercept, slope))

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> ToxicityModel:
        import numpy as np

        spark = docs.sparkSession
        none = cls(spark, {}, 1.0, 0.0, -30.0, 0.0)
        marked = labels.where(train & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
        size = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}  # two rows
        if len(size) < 2:
            return none
        share = F.when(F.col("toxic") == 1, fit_rows / size[1]).otherwise(fit_rows / size[0])
        draw = F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)
        # about 2 * fit_rows ids: a broadcast of bounded size
        drawn = F.broadcast(marked.where(draw < share))
        texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").join(drawn, "id")
        sample = stored(texts.select("text", "toxic").dropDuplicates(["text"]))
        rows = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
        if len(rows) < 2:
            return none

        counts = sample.mapInArrow(releasing(_token_rows), "token string, in_toxic long, in_clean long").groupBy("token").agg(F.sum("in_toxic").alias("a"), F.sum("in_clean").alias("b"))
        # counts of rows with a token; the prior is the token's share of all rows
        prior = PRIOR_ROWS * (F.col("a") + F.col("b")) / float(rows[0] + rows[1])
        odds = F.log((F.col("a") + prior) / (rows[1] + PRIOR_ROWS - F.col("a") - prior + 1e-9)) - F.log((F.col("b") + prior) / (rows[0] + PRIOR_ROWS - F.col("b") - prior + 1e-9))
        z = odds / F.sqrt(1 / (F.col("a") + prior) + 1 / (F.col("b") + prior))
        best = counts.where(F.col("a") >= MIN_ROWS).select("token", odds.alias("odds"), z.alias("z")).where((F.col("z") >= MIN_Z) & (F.col("odds") >= MIN_ODDS)).orderBy(F.desc("z"), "token").limit(MODEL_TOKENS)
        tokens = {r["token"]: float(r["odds"]) for r in best.collect()}  # MODEL_TOKENS rows at most

        shared = spark.sparkContext.broadcast(tokens)
        spread = sample.mapInArrow(releasing(_token_scores(shared)), "toxic int, score double, words long").groupBy("toxic", "score").agg(F.sum("words").alias("words"))
        seen = {(r["toxic"], r["score"]): r["words"] for r in spread.collect()}  # scores to two digits
        clean_words = max(1, seen.get((0, 0.0), 0))
        toxic_scores = [s for t, s in seen if t == 1 and s > 0]
        if not toxic_scores:
            return none
        positive = {s: n / clean_words for (t, s), n in seen.items() if t == 0 and s > 0}
        # a score that clean texts never had may turn up once in as many words again
        for s in toxic_scores:
            positive.setdefault(s, 1.0 / clean_words / len(toxic_scores))
        scale = karlin_lambda(positive)
        # K from the clean segments: expected number of all = K * words
        plain = cls(spark, tokens, scale, 0.0, 0.0, 0.0)
        logs = sample.where("toxic = 0").select(F.explode(plain.passages(F.col("text"), all_=True)).alias("s")).agg(F.sum(F.exp(F.lit(scale) * F.least("s.score", F.lit(50.0 / scale)))).alias("x"), F.count(F.lit(1)).alias("n")).first()
        log_k = math.log(((logs["n"] or 0) + 1.0) / clean_words)
        whole = cls(spark, tokens, scale, log_k, 0.0, 0.0)
        binned = sample.select("toxic", F.round(whole.evidence(F.col("text")) * 4).alias("bin")).groupBy("toxic", "bin").count().collect()  # quarter steps
        x = np.array([min(r["bin"], 400.0) / 4 for r in binned])
        y = np.array([float(r["toxic"]) for r in binned])
        # the sample takes more of one class: weights give back the shares
        weight = np.array([r["count"] * size[r["toxic"]] / rows[r["toxic"]] for r in binned])
        intercept, slope = logistic(x, y, weight)
        return cls(spark, tokens, scale, log_k, intercept, slope)

    def _column(self, kind: str, make) -> Column:
        shared = self.shared

        @F.pandas_udf(kind)
        def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            tokens, scale, log_k, intercept, slope = shared.value
            scores = _Scores(tokens)
            for column in texts:
                yield pd.Series([make(*segments_of(t or "", scores), scale, log_k, intercept, slope) for t in column], dtype="float64" if kind == "double" else object)

        return run

    def evidence(self, text: Column) -> Column:
        return self._column("double", lambda n, found, scale, log_k, intercept, slope: evidence(n, found, scale, log_k))(whole_text(text))

    def score(self, text: Column) -> Column:
        def make(n, found, scale, log_k, intercept, slope):
            x = min(evidence(n, found, scale, log_k), 100.0)
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, intercept + slope * x))))

        return self._column("double", make)(whole_text(text))

    def passages(self, text: Column, all_: bool = False) -> Column:
        """Significant segments: first word, word after the last, score, and
        the expected number of such segments in a clean text of the length."""

        def make(n, found, scale, log_k, intercept, slope):
            chance = [math.exp(min(50.0, log_k + math.log(max(n, 1)) - scale * s)) for _, _, s in found]
            return [{"start": a, "stop": b, "score": s, "chance": c} for (a, b, s), c in zip(found, chance) if all_ or c < SIGNIFICANT]

        return self._column("array<struct<start:int,stop:int,score:double,chance:double>>", make)(whole_text(text))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, held_out, score, predicted of every row; learned from the labelled
    rows that are not held out. An empty table gives no rows."""
    out = held_out(id_col, 5, 0)
    model = ToxicityModel.fit(docs, labels, ~out, id_col, text_col)
    rows = docs.select(F.col(id_col), out.alias("held_out"), model.score(F.col(text_col)).alias("score"))
    return rows.select(id_col, "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that are predicted toxic."""
    model = ToxicityModel.fit(docs, labels, ~held_out(id_col, 5, 0), id_col, text_col)
    return docs.where(model.score(F.col(text_col)) < 0.5)
