"""Repeated byte strings against SQL and brute force."""

import random
from collections import Counter

import pytest
from test_llm_operators import awkward, empty  # noqa: F401

SF = "/root/testdata/sf0.01"


def by_hand(rows, length):
    """rows: (id, text) with any order among equal ids given by the caller."""
    seen, out = set(), []
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for a in range(len(data) - length + 1):
            w = data[a : a + length]
            if w in seen:
                gone[a : a + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(data), sum(gone), spans, kept))
    return out


def rows_of(df):
    return [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in df.collect()]


@pytest.mark.parametrize("seed", range(6))
def test_suffix_order(seed):
    import numpy as np
    from webtide.llm.suffix_dedup import common_prefixes, two_stage_suffixes

    rng = random.Random(seed)
    text = bytes(rng.choice(b"ab\0\xff"[: 2 + seed % 3]) for _ in range(300)) * 2 + b"a" * 40 + b"banana" * 9
    places, words = two_stage_suffixes(np.frombuffer(text, np.uint8), 1024)
    assert places.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    got = common_prefixes(words, places, 50).tolist()
    for a, b, n in zip(places.tolist(), places.tolist()[1:], got):
        k = 0
        while k < 50 and max(a, b) + k < len(text) and text[a + k] == text[b + k]:
            k += 1
        # zeros stand behind the end
        assert n == k or (n > k and max(a, b) + k == len(text))
    assert two_stage_suffixes(np.zeros(0, np.uint8), 100)[0].tolist() == []


def shared_texts(seed, n):
    rng = random.Random(seed)

    def prose(k):
        return " ".join(rng.choice(["the", "of", "ing", "tiôn", "ou", "vi", "é"]) + str(rng.randrange(60)) for _ in range(k))

    passages = [prose(rng.randrange(8, 60)) for _ in range(5)]
    base = prose(300)
    for _ in range(n):
        t = prose(rng.randrange(0, 60))
        for _ in range(rng.randrange(3)):
            t += rng.choice(passages)[rng.randrange(10) :] + prose(rng.randrange(20))
        if rng.random() < 0.2:  # near copies
            words = base.split()
            words[rng.randrange(300)] = "changed"
            t = " ".join(words)
        if rng.random() < 0.1:
            t += "=" * rng.randrange(300) + "ab" * rng.randrange(200)
        yield t


@pytest.mark.parametrize("length,share,most", [(100, 4096, 4096), (100, 8, 4096), (100, 4096, 3), (32, 64, 8), (124, 4096, 4096)])
def test_by_hand(spark, monkeypatch, length, share, most):
    from webtide.llm import suffix_dedup as m

    monkeypatch.setattr(m, "SHARE", share)
    monkeypatch.setattr(m, "MOST", most)
    monkeypatch.setattr(m, "GROUP", 20_000)
    monkeypatch.setattr(m, "SORTED", 3_000)
    rows = list(enumerate(shared_texts(length + share, 250)))
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = by_hand(sorted(rows), length)
    assert sum(r[2] for r in want) > 10_000
    assert sorted(rows_of(m.remove_repeats(docs, length=length))) == want


def test_texts_are_shuffled_once(spark, monkeypatch, tmp_path):
    """Segments, windows and what is left are taken from one shuffle of the
    texts, also where an anchor has too many segments (op11, disk)."""
    from webtide.llm import suffix_dedup as m

    monkeypatch.setattr(m, "SHARE", 8)
    monkeypatch.setattr(m, "MOST", 3)
    rows = list(enumerate(shared_texts(7, 250)))
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        left = m.remove_repeats(spark.read.parquet(path))
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert sorted(rows_of(left)) == by_hand(rows, 100)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    # for segments, for windows and for what is left
    assert plan.count("SortMergeJoin") == 3
    assert plan.count("FileScan parquet") == 1 and plan.count("ReusedExchange") >= 2, plan


def test_sorting_finds_repeats(spark):
    """Different segments of one anchor: only the sorted suffixes show what
    they share."""
    import numpy as np
    from webtide.llm.suffix_dedup import repeats_among

    shared = bytes(range(32, 152))  # 120 bytes: 21 windows
    parts = [b"A" * 20 + shared + b"B" * 7, b"C" * 9 + shared + b"D" * 30]
    segment, at, n = repeats_among(parts, np.array([5, 3]), np.array([1, 1]), np.array([100, 200]), 100)
    assert (segment.tolist(), at.tolist(), n.tolist()) == ([0], [120], [21])


def test_awkward_tables(awkward, empty):  # noqa: F811
    from test_llm_operators import awkward_rows
    from webtide.llm.suffix_dedup import remove_repeats

    # equal ids and texts: one stays; null ids are last. Texts of equal ids differ too much to share windows
    rows = sorted(((r[0], r[1]) for r in awkward_rows()), key=lambda r: (r[0] is None, r[0] or 0))
    assert Counter(rows_of(remove_repeats(awkward))) == Counter(by_hand(rows, 100))
    assert remove_repeats(empty).count() == 0


def test_copies_of_rows(spark):
    from webtide.llm.suffix_dedup import remove_repeats

    t = next(x for x in shared_texts(9, 20) if len(x) > 300)
    docs = spark.createDataFrame([(7, t)] * 4 + [(None, t)] * 2 + [(3, "x" + t), (7, "short"), (7, "short")], "doc_id long, text string").repartition(3)
    got = Counter(rows_of(remove_repeats(docs)))
    want = by_hand([(3, "x" + t)] + [(7, t)] * 4 + [(7, "short")] * 2 + [(None, t)] * 2, 100)
    assert got == Counter(want)
    docs = spark.createDataFrame([(7, t)] * 3, "doc_id long, text string").repartition(3)
    assert Counter(r[2] for r in rows_of(remove_repeats(docs))) == Counter({r[2]: 1 for r in by_hand([(7, t)], 100)} | {len(t.encode()): 2})


def test_splits_do_not_matter(spark, tmp_path):
    from webtide.llm.suffix_dedup import remove_repeats

    rows = list(enumerate(shared_texts(4, 200)))
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(6).write.parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        left = remove_repeats(spark.read.parquet(path))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        assert sorted(rows_of(left)) == by_hand(rows, 100)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_matches_sql(spark):
    from webtide.llm.queries import QUERIES, SQL
    from webtide.oracle.harness import compare, duck_connect

    r = compare(QUERIES["op11_two_stage_suffixes"](spark, SF), SQL["op11_two_stage_suffixes"], duck_connect(SF))
    assert r["ok"], r
