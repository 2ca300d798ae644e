"""Phrase collocations against SQL, brute force, and on awkward tables."""

import random
import re
import string
from collections import Counter, defaultdict

import pytest
from test_llm_operators import awkward, empty  # noqa: F401

SF = "/root/testdata/sf0.01"


def by_hand(rows, most, least, percent, top):
    f = defaultdict(Counter)
    for text, lang in rows:
        low = (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            for k in range(1, most + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, n in f.items():
        total = sum(c for g, c in n.items() if len(g) == 1)
        cand = {g: c for g, c in n.items() if len(g) > 1 and c >= least}
        inside = Counter()
        for g, c in cand.items():
            for i in range(len(g)):
                for j in range(i + 2, len(g) + 1):
                    if j - i < len(g):
                        inside[g[i:j]] = max(inside[g[i:j]], c)
        rows = []
        for g, a in cand.items():
            if inside[g] and 100 * inside[g] >= percent * a:
                continue
            score, k = min((1000 * a * total // (n[g[:k]] * n[g[k:]]), k) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), n[g[:k]], n[g[k:]]))
        out += [(lang, i + 1, g.decode(), -a, p, q, total, -s) for i, (s, a, g, p, q) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def rows_of(df):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def test_matches_sql(spark):
    from webtide.llm.queries import QUERIES, SQL
    from webtide.oracle.harness import compare, duck_connect

    r = compare(QUERIES["op12_de_bruijn_collocations"](spark, SF), SQL["op12_de_bruijn_collocations"], duck_connect(SF))
    assert r["ok"] and r["rows_spark"] > 50, r


@pytest.mark.parametrize("most,least,percent,top", [(5, 3, 100, 2000), (5, 2, 60, 40), (4, 2, 100, 2000), (3, 5, 100, 2000)])
def test_by_hand(spark, most, least, percent, top):
    from webtide.llm.collocations import collocations

    rng = random.Random(most * least)
    words = ["Ab", "c", "dé", "e", "ff", "G", "h\x1cx", "i "]
    passage = "one two three, four five six seven eight nine ten eleven twelve; thirteen"
    loop = "p q r p q r p q r p q r p q r"
    rows = []
    for i in range(300):
        t = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ", ", ".", "\n", "!?"]) for _ in range(rng.randrange(30)))
        rows.append((t + rng.choice(["", passage, passage + " " + loop, loop]) + t[:5], rng.choice(["en", "fr", None])))
    rows += [(None, "en"), ("", None), (" \n.", "xx"), ("solo", "de")]
    docs = spark.createDataFrame([(i, t, lang, "x", 1) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, n int").repartition(4)
    want = by_hand(rows, most, least, percent, top)
    assert len(want) > 20
    assert rows_of(collocations(docs, most=most, least=least, percent=percent, top=top)) == want


def test_paths(spark):
    from pyspark.sql import functions as F
    from webtide.llm.collocations import compact_paths

    chain = [f"w{i}" for i in range(40)]
    ring = ["a", "b", "c", "d"]
    edges = [(" ".join(chain[i : i + 3]), 7) for i in range(38)] + [(" ".join((ring * 2)[i : i + 3]), 5) for i in range(4)]
    edges += [("w10 w11 z", 9), ("m n o", 3), ("n o p", 4)]
    df = spark.createDataFrame([("en", p, 3, n) for p, n in edges], "lang string, phrase string, k int, n long")
    got = {(" ".join(r.words), r.n) for r in compact_paths(df, 3).collect()}
    # w10 w11 has two ways out; cycles and changes of weight are not compacted
    want = {(" ".join(chain[:12]), 7), (" ".join(chain[10:]), 7), ("w10 w11 z", 9), ("m n o", 3), ("n o p", 4)}
    want |= {(" ".join((ring * 2)[i : i + 3]), 5) for i in range(4)}
    assert got == want
    assert compact_paths(df.where(F.lit(False)), 3).count() == 0


def test_awkward_tables(awkward, empty, monkeypatch):  # noqa: F811
    from test_llm_operators import awkward_rows
    from webtide.llm import collocations as m

    rows = [(r[1], r[2]) for r in awkward_rows()]
    assert rows_of(m.collocations(awkward, least=50)) == by_hand(rows, 5, 50, 100, 2000)
    assert m.collocations(empty).count() == 0


def test_parts_of_long_groups(monkeypatch):
    """A group with more words than ids is counted in parts."""
    import numpy as np
    import pyarrow as pa
    from webtide.llm import collocations as m

    class All:
        value = b"\xff" * (m.BUCKETS // 8)

    rng = random.Random(1)
    text = " ".join(f"{rng.randrange(60)}" + rng.choice(["", "", ","]) for _ in range(500))
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], names=["lang", "text"])

    def counts():
        c = Counter()
        for b in m._phrases(5, All)([batch]):
            c.update({k: n for k, n in zip(b.column("phrase").to_pylist(), b.column("n").to_pylist())})
        return c

    want = counts()
    monkeypatch.setattr(m, "ID_BITS", 5)
    assert counts() == want and sum(want.values()) == 500
    assert np.all([len(k.split()) <= 5 for k in want])
