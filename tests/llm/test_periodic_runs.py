"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import pytest
from test_llm_operators import SF, awkward_rows
from test_llm_operators import awkward, empty  # noqa: F401


def runs_by_hand(words):
    found, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed_by_hand(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def words_by_hand(text):
    return [w.decode() for w in (text or "").encode().split()]


def periodic_texts(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            block = [rng.choice("abc") for _ in range(rng.randrange(1, 9))]
            parts += block * rng.choice([1, 1, 2, 4, 5, 9, 40]) + block[: rng.randrange(len(block) + 1)]
        if rng.random() < 0.3:
            parts = parts * 4
        yield " ".join(parts)


@pytest.mark.parametrize("seed", range(4))
def test_grammar_extensions(seed):
    import numpy as np
    from webtide.llm.periodic_runs import Grammar

    rng = np.random.default_rng(seed)
    s = np.concatenate([[90], np.tile(rng.integers(0, 3, 7 + seed), 30), rng.integers(0, 2, 200), np.zeros(50, np.int64), [91]])
    g = Grammar(s)
    a = rng.integers(1, len(s) - 1, 500)
    b = rng.integers(1, len(s) - 1, 500)
    a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
    right, left = g.extensions(a, b), g.extensions(a, b, -1)
    for i, j, r, m in zip(a.tolist(), b.tolist(), right.tolist(), left.tolist()):
        k = 0
        while j + k < len(s) and s[i + k] == s[j + k]:
            k += 1
        assert k == r
        k = 0
        while i - k >= 0 and s[i - k] == s[j - k]:
            k += 1
        assert k == m


def test_runs(spark):
    from webtide.llm.periodic_runs import periodic_runs

    texts = list(periodic_texts(3, 400)) + ["x " * 5000, "a b " * 3000 + "c", " ".join(str(i % 700) for i in range(9000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in periodic_runs(docs).collect()}
    assert len(got) == len(texts)
    some = 0
    for i, t in enumerate(texts):
        words = words_by_hand(t)
        want = runs_by_hand(words)
        some += len(want)
        assert [(r.start, r.length, r.period) for r in got[i].runs] == want, t
        assert got[i].collapsed == collapsed_by_hand(words, want) and got[i].n_words == len(words)
    assert some > 300


def test_runs_on_awkward_tables(awkward, empty):  # noqa: F811
    from webtide.llm.periodic_runs import periodic_runs

    got = sorted(((str(r.doc_id), r.n_words, len(r.runs), hashlib.md5(r.collapsed.encode()).hexdigest()) for r in periodic_runs(awkward).collect()))
    want = []
    for r in awkward_rows():
        words = words_by_hand(r[1])
        runs = runs_by_hand(words) if len(words) < 1000 else None
        want.append((str(r[0]), len(words), runs, words))
    assert len(got) == len(want)
    by_key = {(g[0], g[1]): g for g in got}
    for i, n, runs, words in want:
        if runs is not None:
            assert by_key[i, n][2] == len(runs)
            assert by_key[i, n][3] == hashlib.md5(collapsed_by_hand(words, runs).encode()).hexdigest()
    assert periodic_runs(empty).count() == 0


def test_op13_by_hand(spark):
    from webtide.llm.queries import QUERIES

    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op13_recompression_runs"](spark, SF).collect()}
    assert len(got) == len(rows)
    runs_seen = 0
    for r in rows:
        words = words_by_hand(r.text)
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = runs_by_hand(words)
        runs_seen += len(runs)
        x = got[r.doc_id]
        best = max(runs, key=lambda y: (y[1], -y[0], -y[2]), default=None)
        assert x.n_runs == len(runs)
        assert (x.start, x.length, x.period, x.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert x.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert x.collapsed_sha256 == hashlib.sha256(collapsed_by_hand(words, runs).encode()).hexdigest()
    assert runs_seen > 10
