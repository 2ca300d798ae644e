"""Training-data operators against brute force, and on awkward tables:
nulls in any column, empty and very long texts, ties, repeated rows, extra
columns whose names clash with the operators' own, and no rows at all."""

import hashlib
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, id string, digest string, kept boolean, component_id long, ids string, lines string, at int, p string"
LONG = " ".join(random.Random(5).choice(["the", "of", "ing", "tion", "ou"]) + str(i % 97) for i in range(300_000))
TEXTS = [
    None, "", "", " \t\n ", "Same text here.", "same TEXT here.", "same text here.", "É same é", "é same é", "one", "two words", "line a\nline b\n\nline a",
    LONG, LONG, LONG.upper(), "x" * 50_000, "don't I'LL we've \x1c odd\x85blank　wide", "😀😀 ñandú İstanbul ΣΑΣ", "a<|endoftext|>b", "\n\n\n",
]


def awkward_rows():
    rows = [(i, t, "en" if i % 2 else None, None, 0) for i, t in enumerate(TEXTS)]
    rows += [(None, "same text here.", None, "s", None), (None, None, None, None, None), (4, "Same text here.", "en", "s", 1), (9, "one", "en", "s", 1), (9, "one", "en", "s", 1), (-5, "one", "fr", "s", 1)]
    return [(*r, 7, "x", "y", True, 1, "z", "w", 3, "q") for r in rows]


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("awkward") / "documents.parquet")
    spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def lower_ascii(text):
    return (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def components_by_hand(n, linked):
    label = list(range(n))
    while True:
        new = [min([label[i], *(label[j] for j in linked[i])]) for i in range(n)]
        if new == label:
            return label
        label = new


# --- 1 exact dedup ---------------------------------------------------------------


def test_exact_duplicates(awkward, empty):
    from webtide.llm.exact_dedup import drop_exact_duplicates, exact_duplicates

    by_text = defaultdict(list)
    for r in awkward_rows():
        by_text[lower_ascii(r[1])].append(r[0])
    want = Counter()
    for text, ids in by_text.items():
        keep = max((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        want.update((i, keep, len(ids), digest) for i in ids)
    for counters in (1, 3, 1024):  # few counters: the summaries must forget most digests
        got = exact_duplicates(awkward, counters=counters).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        kept = Counter(r.text_sha256 for r in got if r.kept)
        assert len(kept) == len(by_text) and set(kept.values()) == {1}
        assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_duplicates(empty).count() == 0
    left = drop_exact_duplicates(awkward)
    assert left.columns == awkward.columns and left.count() == len(by_text)


def test_misra_gries_keeps_frequent_values():
    from webtide.llm.exact_dedup import misra_gries

    rng = random.Random(1)
    values = ["a"] * 400 + ["b"] * 300 + [str(i) for i in range(300)]
    rng.shuffle(values)
    held = Counter()
    for i in range(0, 1000, 50):
        held.update(values[i : i + 50])
        held = misra_gries(held, 4)
        assert len(held) <= 4
    assert held["a"] >= 400 - 1000 / 5 and held["b"] >= 300 - 1000 / 5 and held["a"] <= 400


# --- 2 sharding -------------------------------------------------------------------


def jump_by_hand(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash():
    from webtide.llm.sharding import jump_hash

    keys = np.array([0, 1, -1, 2**63 - 1, -(2**63), *range(1000, 3000)], np.int64)
    for n in (1, 2, 24, 25, 1000):
        got = jump_hash(keys, n)
        assert got.tolist() == [jump_by_hand(int(k), n) for k in keys]
    before, after = jump_hash(keys, 24), jump_hash(keys, 25)
    assert set(after[before != after]) == {24}


def test_shard_rows(spark, awkward, empty):
    from webtide.llm.queries import op2_jump_sharding
    from webtide.llm.sharding import shard_rows

    for got, rows in ((shard_rows(awkward, 5).collect(), [(r[0], r[1]) for r in awkward_rows()]), (op2_jump_sharding(spark, SF).collect(), [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()])):
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
        slots, shard_of = defaultdict(list), {}
        for r in got:
            slots[r.shard].append(r.slot)
            assert shard_of.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
            assert r.grown_shard in (r.shard, 5 if len(rows) < 100 else 24) and r.law == "key"
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shard_rows(empty, 5).count() == 0


# --- 3 byte-level BPE ----------------------------------------------------------------


@pytest.fixture(scope="module")
def byte_pairs(spark):
    import public_tokenizers
    from webtide.llm.bpe import BytePairs

    return BytePairs(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import public_tokenizers
    import tiktoken
    from webtide.llm.bpe import read_ranks

    ranks = {t: i for i, t in enumerate(read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_pairs_match_tiktoken(spark, awkward, empty, byte_pairs, tiktoken_encoding):
    got = byte_pairs.decode(byte_pairs.encode(awkward)).collect()
    want = Counter((r[0], np.array(tiktoken_encoding.encode_ordinary(r[1] or ""), "<u4").tobytes(), (r[1] or "").encode()) for r in awkward_rows())
    assert Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got) == want
    assert byte_pairs.encode(empty).count() == 0


def test_op3_matches_tiktoken(spark, tiktoken_encoding):
    from webtide.llm.queries import op3_byte_bpe

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in op3_byte_bpe(spark, SF).collect():
        ids = tiktoken_encoding.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_matrix_and_heap_merge_alike(byte_pairs):
    from webtide.llm import bpe

    tokens, table = byte_pairs.model.value
    held = table.keys >= 0
    pairs = dict(zip(table.keys[held].tolist(), table.ranks[held].tolist()))
    rng = np.random.default_rng(3)
    ids = bpe.Encoder(tokens, table).of_byte[rng.integers(97, 105, (200, 60))]
    for row, merged in zip(ids.tolist(), bpe.merge_matrix(ids.copy(), table)):
        assert bpe.merge_long(row, pairs) == merged[merged >= 0].tolist()


def test_stretches_and_groups():
    from webtide.llm.texts import groups, stretches

    assert "".join(stretches(LONG, 1000)) == LONG and len(list(stretches(LONG, 1000))) > 100
    assert list(stretches("x" * 5000, 100)) == ["x" * 5000] and list(stretches("")) == [""]
    assert list(groups(["aa", "b", "", "cc"], 2)) == [(0, 1), (1, 4)] and list(groups([])) == []


# --- 4 embeddings -----------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, rep long, cell int, links long"


def test_near_vectors(spark, tmp_path):
    from webtide.llm.embedding_dedup import near_vectors

    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 64))
    near = np.concatenate([base[:20] + s * rng.standard_normal((20, 64)) for s in (0.05, 0.2, 0.35, 0.45)])
    chain = base[30] + np.outer(np.arange(12), rng.standard_normal(64) * 0.12)
    vectors = [v.astype(np.float32).tolist() for v in np.concatenate([base, near, chain, base[:1], base[:1]])]
    odd = [None, [0.0] * 64, [float("nan")] + [1.0] * 63, [float("inf")] * 64, [None] + [1.0] * 63, [], [1.0, 2.0], [2.0, 4.0]]
    rows = [(i, v, 0, 5, 6, 7) for i, v in enumerate(vectors + odd)] + [(None, vectors[0], None, 1, 1, 1)]
    path = str(tmp_path / "e.parquet")
    spark.createDataFrame(rows, VECTORS).repartition(4).write.parquet(path)
    n = len(rows)
    unit = [np.array(r[1], float) / np.linalg.norm(np.array(r[1], float)) if r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1]) else None for r in rows]
    linked = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9] for i in range(n)]
    label = components_by_hand(n, linked)
    for block in (4096, 16):  # 16: cells are cut into several blocks
        got = {r.vec_id: r for r in near_vectors(spark.read.parquet(path), block=block).collect()}
        assert len(got) == n
        found = sum(r.n_links for r in got.values())
        assert sum(map(len, linked)) >= found >= 0.95 * sum(map(len, linked))
        if found == sum(map(len, linked)):
            for i, r in enumerate(rows):
                assert got[r[0]].n_links == len(linked[i])
                assert got[r[0]].component_id == rows[label[i]][0] and got[r[0]].kept == (label[i] == i)
    assert near_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_calibration_reaches_its_recall():
    from webtide.llm import embedding_dedup as e

    rng = np.random.default_rng(7)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    across = rng.standard_normal((4000, 64))
    across -= (across * x).sum(1)[:, None] * x
    across /= np.linalg.norm(across, axis=1)[:, None]
    y = 0.9 * x + np.sqrt(1 - 0.81) * across  # pairs at the threshold exactly
    hit = np.abs((x - y) @ e.directions(64, e.PROJECTIONS)) <= e.WINDOW * np.sqrt(0.2)
    assert (hit[:, 0] & (hit[:, 1:].sum(1) >= e.calibrate())).mean() >= 0.93


# --- 5 SimHash ----------------------------------------------------------------------------


def fingerprint_by_hand(text, words):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(text))
    s = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_by_hand(rows, words=3, radius=3):
    prints = [fingerprint_by_hand(t, words) for _, t in rows]
    linked = [[j for j in range(len(rows)) if bin(prints[i] ^ prints[j]).count("1") <= radius] for i in range(len(rows))]
    label = components_by_hand(len(rows), linked)
    least = {}
    for (i, _), c in zip(rows, label):
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    return Counter((i, format(p, "016x"), least[c]) for (i, _), p, c in zip(rows, prints, label)), len(set(label))


def test_near_duplicates(spark, awkward, empty):
    from webtide.llm.queries import op5_simhash
    from webtide.llm.simhash import drop_near_duplicates, near_duplicates

    want, groups = simhash_by_hand([(r[0], r[1]) for r in awkward_rows()])
    got = near_duplicates(awkward).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert sum(r.kept for r in got) == groups
    left = drop_near_duplicates(awkward)
    assert left.columns == awkward.columns and left.count() == groups
    assert near_duplicates(empty).count() == 0
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, op5_simhash(spark, SF).collect())) == simhash_by_hand(rows)[0]


def test_forest_finds_all_pairs(spark):
    from webtide.llm import simhash as s
    from webtide.llm.components import components

    rng = np.random.default_rng(1)
    prints = np.unique(np.array([int(b) ^ sum(1 << int(k) for k in set(rng.integers(0, 64, rng.integers(0, 4)))) for b in rng.integers(0, 1 << 63, 40) for _ in range(30)], np.uint64))
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    group = np.zeros(len(prints), np.int64)
    q, e = s.Forest(prints, group).search(prints, group, 3)
    assert {*zip(q.tolist(), e.tolist())} == {*zip(*(x.tolist() for x in np.nonzero(near)))}
    label = components_by_hand(len(prints), [np.flatnonzero(x).tolist() for x in near])
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fingerprint long")
    for tree in (4096, 5):  # 5: shards are cut into several trees
        links = s.shard_groups(df, 3, tree).repartition(6, "group").sortWithinPartitions("group").mapInArrow(s._stars(3), "a long, b long")
        found = {r.node: r.component for r in components(links).collect()}
        got = [found.get(int(x), int(x)) for x in prints.view(np.int64)]
        assert len({*zip(got, label)}) == len(set(label)) == len(set(got))


def test_components(spark):
    from webtide.llm.components import components

    path = [(i, i + 1) for i in range(60)]
    links = [*path, (100, 101), (101, 101), (100, 101), *((200, 201 + i) for i in range(50))]
    random.Random(3).shuffle(links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, **{i: 200 for i in range(200, 251)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 7 packing ------------------------------------------------------------------------------


def check_pieces(pieces, ids_of, window=4096):
    """``ids_of``: id -> list of id arrays (rows that repeat an id)."""
    total = sequences = 0
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert r.length >= 1 and len(r.ids) == 4 * r.length
    for i, want in ids_of.items():
        assert sum(r.length for r in by_doc[i]) == sum(map(len, want))
        for x in want:
            data = np.array(x, "<u4").tobytes()
            ends = {0}
            for r in sorted(by_doc[i], key=lambda r: r.start):
                if r.doc_tokens == len(x) and bytes(r.ids) == data[4 * r.start : 4 * (r.start + r.length)] and r.start in ends:
                    ends.add(r.start + r.length)
            assert len(x) in ends
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        total, sequences = total + at, sequences + 1
    return 1 - total / window / max(sequences, 1)


@pytest.fixture(scope="module")
def word_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return t


def ids_by_hand(tokenizer, rows):
    found = defaultdict(list)
    for (i, _), x in zip(rows, tokenizer.encode_batch([t or "" for _, t in rows], add_special_tokens=False)):
        found[i].append([*x.ids, 2])
    return found


def test_pack(spark, awkward, empty, word_tokenizer):
    import public_tokenizers
    from webtide.llm.packing import pack

    path = public_tokenizers.path("word_bpe_49k.json")
    check_pieces(pack(awkward, path, 2).collect(), ids_by_hand(word_tokenizer, [(r[0], r[1]) for r in awkward_rows()]))
    assert pack(empty, path, 2).count() == 0
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert check_pieces(pack(docs, path, 2).collect(), ids_by_hand(word_tokenizer, rows)) < 0.06


@pytest.mark.parametrize("kind", ["short", "long", "equal", "one", "mixed"])
def test_plan_places_every_member_once(kind):
    from webtide.llm.packing import Plan

    rng, classes = np.random.default_rng(2), 32
    histogram = np.zeros(classes + 1, int)
    histogram[{"short": slice(1, 4), "long": slice(20, 33), "equal": slice(19, 20), "one": slice(7, 8), "mixed": slice(1, 33)}[kind]] = 1
    histogram *= rng.integers(1, 400, classes + 1) if kind != "one" else 1
    plan = Plan(histogram, classes)
    fill = defaultdict(int)
    pieces = [(p, i) for p in range(1, classes + 1) for i in range(histogram[p])]
    size = {p: plan.populations[p][0] for p in range(len(plan.populations))}
    while pieces:
        p, i = pieces.pop()
        (row,) = [r for r in plan.rows if r[0] == p and r[1] <= i < r[2]]
        at = i - row[1] + row[3]
        fill[row[5] + at // row[4], row[6] + at % row[4]] = row[7] or size[p]
        if row[7]:
            pieces.append((row[8], i - row[1] + row[9]))
    sums = defaultdict(int)
    for (sequence, _), n in fill.items():
        sums[sequence] += n
    assert sum(sums.values()) == (histogram * np.arange(classes + 1)).sum()
    assert max(sums.values()) <= classes and sorted(sums) == list(range(plan.sequences))
    assert plan.sequences <= sum(sums.values()) / classes + 2 + 0.01 * plan.sequences


def test_non_negative_least_squares():
    from webtide.llm.packing import combinations_filling, non_negative_least_squares

    columns = combinations_filling(12, 3)
    assert {tuple(sorted(c)) for c in columns.tolist()} == {tuple(sorted((a, b, c))) for a in range(13) for b in range(13) for c in range(13) if a + b + c == 12}
    x = np.zeros(len(columns))
    x[[1, 5, 9]] = 3, 10, 2
    target = np.zeros(13)
    for c, n in zip(columns, x):
        target += n * np.bincount(c, minlength=13)
    target[0] = 0
    got = non_negative_least_squares(columns, target, np.ones(13))
    fit = sum(n * np.bincount(c, minlength=13) for c, n in zip(columns, got))
    assert (got >= 0).all() and np.abs(fit[1:] - target[1:]).max() < 1e-5


# --- 8 line dedup ------------------------------------------------------------------------------


def lines_by_hand(rows, min_docs):
    blank = " \t\n\x0b\x0c\r"
    docs = [(i, (t or "").split("\n")) for i, t in rows]
    held = Counter(k for _, lines in docs for k in {lower_ascii(x.strip(blank)) for x in lines} if k)
    out = Counter()
    for i, lines in docs:
        kept = [x for x in lines if held[lower_ascii(x.strip(blank))] < min_docs]
        out[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


def test_drop_repeated_lines(spark, awkward, empty, tmp_path):
    from webtide.llm.line_dedup import drop_repeated_lines

    rng = random.Random(9)
    rows = [(i, "\n".join(rng.choice(["A b ", "\ta B", "c", "", " ", f"u{rng.randrange(40)}", "Ä", "ä"]) for _ in range(rng.randrange(12)))) for i in range(120)] + [(3, "c\nc\nc"), (None, None)]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(path)
    for batches, fanout in ((1, 4), (5, 2)):  # with several levels of runs, and none
        got = drop_repeated_lines(spark.read.parquet(path), min_docs=10, batches=batches, fanout=fanout).collect()
        assert Counter(map(tuple, got)) == lines_by_hand(rows, 10)
    got = drop_repeated_lines(awkward, min_docs=2).collect()
    assert Counter(map(tuple, got)) == lines_by_hand([(r[0], r[1]) for r in awkward_rows()], 2)
    assert drop_repeated_lines(empty).count() == 0


# --- 9 HTML ---------------------------------------------------------------------------------------


def test_main_text():
    from webtide.llm.html_extract import main_text

    page = """<html><head><title>t</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
    <header><p>top</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class='cookie-notice'>We use cookies</div>
    <!-- <p>comment</p> --><article><h1>Head &amp; line</h1><p>One  two<br>three<p>Unclosed &eacute; &#8217; &amp
    <div class="ad">Buy</div><p>Next <b>bold</b> <a href=x>link</a>.</p><form><p>Mail</p><input></form>
    <article><p>Inner</p></article><p>After inner</p></article><aside>Side</aside>
    <section id="comments"><p>I am a reader</p></section><footer>&copy; me</footer></body></html>"""
    assert main_text(page) == "Head & line\nOne two three\nUnclosed é ’ &\nNext bold link.\nInner\nAfter inner"
    long = "word " * 40
    bare = f"<body><div class=menu><a>Home</a></div><p><a href=1>{long}</a></p><p>{long}</p><p>Short.</p><p>{long}</p><div class='comments'><p>{long}</p></div></body>"
    assert main_text(bare) == "\n".join([long.strip(), "Short.", long.strip()])
    assert main_text(None) == main_text("") == main_text("<p></p>") == ""
    assert main_text("<p>only this</p>") == "only this"
    assert main_text("<article><p>cut off &am") == "cut off &am"
    assert main_text("<article>a<p>b</article><p>c <x") == "a\nb"


def test_article_elements_do_not_hide_the_page():
    from webtide.llm.html_extract import main_text

    body = [f"Paragraph {i} of the body " + "with its words " * 8 for i in range(4)]
    text = "\n".join(b.strip() for b in body)
    divs = "".join(f"<div>{b}</div>" for b in body)
    cards = "".join(f"<article><h3><a href={i}>Card {i}</a></h3><p>Teaser {i}</p></article>" for i in range(6))
    assert main_text(divs) == main_text(divs + cards) == main_text(cards + divs) == text
    assert main_text(f"{divs[: len(divs) // 2]}{cards}{divs[len(divs) // 2 :]}").count("Paragraph") == 4
    # long teasers: together as long as the body, each of them shorter
    long = "".join(f"<article><p>{'teaser text ' * 9}</p></article>" for i in range(9))
    assert text in main_text(divs + long)
    assert main_text(f"<article>{divs}<p><a href=x>all links</a></p></article><p>outside</p>") == text + "\nall links"
    assert main_text("<article><a href=x>Card</a></article><p>A short page.</p>") == "A short page."


def test_names_mark_whole_tokens_only():
    from webtide.llm.html_extract import main_text

    body = "<article><h1>Title</h1><p>" + "words of the body " * 9 + "</p></article>"
    text = "Title\n" + ("words of the body " * 9).strip()
    assert main_text(body) == text
    for name in ("site-content has-sidebar", "content no-sidebar", "side-by-side", "related-work", "social-impact", "with-menu", "post-header"):
        assert main_text(f'<div class="{name}">{body}</div>') == main_text(f'<div id="{name}">{body}</div>') == text
        assert main_text(f'<article><p>A text.</p><div class="{name}">Small</div></article>') == "A text.\nSmall"
    assert main_text('<article><h2 id="related">Related</h2><p>x</p></article>') == "Related\nx"
    # a name or form around most of the text is a wrapper; smaller ones in it still count
    small = "<div class='sidebar'>Small</div><form><p>Mail</p></form>"
    for start, end in (("<form action=x>", "</form>"), ("<form>", ""), ("<div class=sidebar>", "</div>"), ("<form><div role=search><fieldset>", "</fieldset></div></form>")):
        assert main_text(f"<body>{start}{small}{body}{end}</body>") == text
    for name in ("sidebar", "widget-area", "related-posts", "cookie-notice", "site_footer", "main-nav", "ad-12", "share-buttons x", "newsletter_signup"):
        assert main_text(f'{body[:-10]}<div class="{name}">Small</div></article>') == text
    assert main_text("<form><p>one line of a page</p></form><p>x</p>") == "one line of a page\nx"
    assert main_text("<div class=ad>An ad that is longer than the article</div><article>Short</article>") == "Short"
    assert main_text(f"{body[:-10]}<div hidden>{body * 3}</div></article>") == text


def test_names_of_comments_and_adverts():
    from webtide.llm.html_extract import main_text

    body = "<article><h1>Title</h1><p>" + "words of the body " * 9 + "</p>%s</article>"
    text = main_text(body % "")
    for name in ("post-comments", "article-comments", "reader-comments", "user-comments", "article__comments", "facebook-comments", "commentSection", "cookieBanner",
                 "adContainer", "adbox", "js-cookie-banner", "navbar-collapse", "sharedaddy", "more-stories", "you-may-also-like"):
        assert main_text(body % f'<div class="{name}"><p>Small</p></div>') == text, name
    for name in ("has-comments", "no-ads", "commentary", "adverse-events", "cookie-recipe", "post-header", "leadText", "shadow"):
        assert main_text(body % f'<div class="{name}"><p>Small</p></div>') == text + "\nSmall", name


def test_lines_beside_a_range():
    from webtide.llm.html_extract import main_text

    long = "word " * 40
    page = f"<div class=nav><a>Home</a></div><div><h1>Headline</h1><p>By me</p><p>Today</p><p><a href=x>a link line</a></p><p><a href=y>more</a></p><p>{long}</p><p><a>1</a></p><p><a>2</a></p><p><a>3</a></p><p><a>4</a></p><p>{long}</p></div>"
    got = main_text(page).split("\n")
    assert got[:3] == ["Headline", "By me", "Today"] and got.count(long.strip()) == 2 and got[-5:-1] == ["1", "2", "3", "4"] and "Home" not in got


def test_markup_takes_linear_time():
    import time

    from webtide.llm.html_extract import main_text

    began = time.time()
    for page in ("<a " * 300_000, "<b>" * 100_000 + "</i>x" * 100_000, '<a "' * 200_001 + ">", "<p" * 400_000, "<!--" * 200_000, "<p>x" * 150_000):
        main_text(page)
    assert time.time() - began < 20


def test_op9_on_pages(spark, tmp_path):
    import html as h
    from webtide.llm.html_extract import extract_main_text
    from webtide.llm.queries import op9_html_extraction

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in op9_html_extraction(spark, SF).collect():
        inside = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        blocks = (" ".join(h.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)[^>]*>", inside))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
    kind = "page_id long, url string, html string, text string, page int"
    rows = [(1, None, None, "x", 1), (None, "u", "", "x", 1), (1, "u", "<article><p>" + "long " * 200_000 + "</article>", None, 2)]
    got = extract_main_text(spark.createDataFrame(rows, kind)).collect()
    assert Counter((r.page_id, r.url, r.n_chars) for r in got) == Counter([(1, None, 0), (None, "u", 0), (1, "u", 999_999)])
    assert extract_main_text(spark.createDataFrame([], kind)).count() == 0


# --- 6 language, 10 toxicity -------------------------------------------------------------------------


def test_counts_of_n_grams():
    from webtide.llm import langid as g

    letters = np.unpackbits(g.letter_table()).astype(bool)

    def by_hand(text):
        counts = np.zeros(g.FEATURES, int)
        for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
            points = [0, *map(ord, word), 0]
            for n in g.ORDERS:
                for i in range(len(points) - n + 1):
                    gram = points[i : i + n]
                    if 0 in gram[1:-1] or gram == [0]:
                        continue
                    key = 0
                    for p in gram:
                        key = key * 0x110000 + p
                    counts[(((key * 8 + n) * g._ODD) % (1 << 64)) >> (64 - g.FEATURES.bit_length() + 1)] += 1
        return counts

    texts = ["Abc, de!", "", "é", "x  y", "123", "a1b", "ΣΑΣ 😀", " lead"]
    assert (np.concatenate(list(g.count_blocks(texts, letters))) == [by_hand(t) for t in texts]).all()


def test_languages(spark, awkward, empty):
    from webtide.llm.langid import drop_rejected, identify_languages
    from webtide.llm.queries import op6_nearest_centroid

    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = op6_nearest_centroid(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.98 * len(held)
    assert sum(r.rejected for r in got) <= 0.002 * len(got)
    by_id = {r.doc_id: r for r in identify_languages(awkward).where("doc_id is not null").collect()}
    assert {by_id[i].lang_pred for i in (0, 1, 3, 19)} == {"und"} and by_id[0].score == 0 and by_id[6].lang_pred in ("en", "fr")
    assert identify_languages(empty).count() == 0 and drop_rejected(empty).count() == 0
    left = drop_rejected(awkward)
    assert left.columns == awkward.columns and left.where("text is null or text = ''").count() == 0


def test_foreign_text_is_rejected(spark, tmp_path):
    from webtide.llm.langid import identify_languages

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    path = str(tmp_path / "d.parquet")
    docs.union(spark.createDataFrame([(-1, "Это совсем другой язык и другие буквы " * 20, None), (-2, "这是另一种语言" * 30, None)], docs.schema)).write.parquet(path)
    got = {r.doc_id: r.rejected for r in identify_languages(spark.read.parquet(path)).where("doc_id < 0").collect()}
    assert got == {-1: True, -2: True}


def test_very_long_foreign_text_is_rejected(spark, tmp_path):
    from webtide.llm.langid import identify_languages

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    path = str(tmp_path / "d.parquet")
    # longer than all training rows, a kind of text the model does not know
    docs.union(spark.createDataFrame([(-1, "Это совсем другой язык и другие буквы " * 20_000, None), (-2, docs.where("lang = 'en'").first().text * 2000, None)], docs.schema)).write.parquet(path)
    got = {r.doc_id: r.rejected for r in identify_languages(spark.read.parquet(path)).where("doc_id < 0").collect()}
    assert got == {-1: True, -2: False}


def test_rejection_limits():
    from webtide.llm import langid as g

    assert g.rejection_limits([]) == [0.0] * g.CLASSES
    rows = [(k, 500 + k, 1000, 0.5 + k / 1000) for k in range(8, 13)]
    limits = g.rejection_limits(rows)
    assert limits[8:13] == [g.REJECT_SHARE * x[3] for x in rows]
    assert set(limits[:8]) == {limits[8]} and set(limits[13:]) == {limits[12]}  # classes without rows
    # one very long row of junk lowers nothing, nor do two with classes between
    assert g.rejection_limits([*rows, (20, 10, 1, 0.01)])[:21] == limits[:21]
    assert g.rejection_limits([*rows, (20, 10, 1, 0.01), (16, 9, 1, 0.009)]) == limits
    # short classes are pooled with their neighbours
    assert g.rejection_limits([(1, 100, 1, 0.1), (2, 300, 200, 0.3), (3, 400, 200, 0.4), (4, 600, 50, 0.6)]) == [0.25 * 0.3] * g.CLASSES


def test_maximal_segments_by_definition():
    from webtide.llm.toxicity import maximal_segments

    def by_hand(s):
        # the best segment (shortest of equals), then left and right of it
        def split(a, b):
            best = max(((sum(s[i:j]), -(j - i), -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
            if best[0] <= 0:
                return []
            i, j = -best[2], -best[2] - best[1]
            return [*split(a, i), (i, j, best[0]), *split(j, b)]

        return split(0, len(s))

    rng = random.Random(8)
    for _ in range(300):
        s = [rng.choice([-1, -1, -1, 1, 2, 3]) for _ in range(rng.randrange(14))]
        got = maximal_segments([(i, x) for i, x in enumerate(s) if x > 0], len(s), -1)
        want = by_hand(s)
        assert sum(x[2] for x in got) == sum(x[2] for x in want) and [x[2] for x in got] == [x[2] for x in want]


def test_toxicity(spark, awkward, empty):
    from webtide.llm.queries import op10_toxic_segments
    from webtide.llm.toxicity import ToxicityModel, drop_toxic, held_out, score_toxicity
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.1"
    got = op10_toxic_segments(spark, sf).collect()
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in label]
    assert sum(r.predicted == label[r.doc_id] for r in held) >= 0.95 * len(held)
    assert sum(r.predicted for r in held if not label[r.doc_id]) <= 0.02 * len(held)
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = ToxicityModel.fit(docs, labels, ~held_out("doc_id", 5, 0))
    text = "the of and ing " * 30 + "you idiot , stupid trash " + "the of and ing " * 30
    row = spark.createDataFrame([(text,), ("the of and ing " * 60,), (None,)], "text string").select(model.score(F.col("text")).alias("s"), model.passages(F.col("text")).alias("p")).collect()
    assert row[0].s > 0.5 > row[1].s >= row[2].s and not row[1].p and row[0].p
    assert all(120 <= p.start < p.stop <= 126 for p in row[0].p)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(4, 1, 1), (4, None, None), (None, 1, 1), (6, 1, 0), (12, 0, 1), (13, 0, 0)], none.schema)
    for some in (none, odd):
        assert score_toxicity(awkward, some).count() == len(awkward_rows()) and drop_toxic(awkward, some).columns == awkward.columns
        assert score_toxicity(empty, some).count() == 0


# --- rows are known by what they hold --------------------------------------------------


def test_kept_rows_do_not_depend_on_splits(spark, tmp_path):
    """The scan is split in another way between building and writing."""
    from webtide.llm.exact_dedup import drop_exact_duplicates
    from webtide.llm.line_dedup import drop_repeated_lines
    from webtide.llm.simhash import drop_near_duplicates

    rng = random.Random(4)
    texts = [" ".join(rng.choice(["the", "of", "ing", "tion"]) + str(rng.randrange(40)) for _ in range(30)) + "\nfooter" for _ in range(120)]
    rows = [(i, texts[i % 120], "x" * (i % 7)) for i in range(400)] + [(5, texts[5], "again"), (5, texts[5], "again"), (None, texts[7], "n"), (None, "only null", "n")]
    path = str(tmp_path / "docs.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, extra string").repartition(12).write.parquet(path)
    conf = "spark.sql.files.minPartitionNum"
    try:
        out = {}
        for name, job in (("exact", drop_exact_duplicates), ("near", drop_near_duplicates), ("lines", drop_repeated_lines)):
            for then in (4, 64):
                spark.conf.set(conf, 4)
                left = job(spark.read.parquet(path))
                spark.conf.set(conf, then)
                got = sorted((tuple(r) for r in left.collect()), key=str)
                assert out.setdefault(name, got) == got, (name, then)
    finally:
        spark.conf.unset(conf)
    assert [r[0] for r in sorted(out["exact"], key=lambda r: str(r[1]))] == [max((i for i, t, _ in rows if t == u and i is not None), default=None) for u in sorted({r[1] for r in rows})]
    assert len(out["near"]) <= 121 and len({r[1] for r in out["near"]}) == len(out["near"])
    assert len(out["lines"]) == len(rows) and all("footer" not in r[3] for r in out["lines"] if r[1] > 1)


def test_runs_spare_frequent_lines(spark, monkeypatch):
    """With production parameters later batches meet a run of frequent lines."""
    from webtide.llm import line_dedup as m

    removed = []
    plain = m.LineRuns._unknown

    def counted(self, counts):
        left = plain(self, counts)
        removed.append((len(self.levels[0]), counts.count() - left.count()))
        return left

    monkeypatch.setattr(m.LineRuns, "_unknown", counted)
    docs = spark.createDataFrame([(i, f"own {i}\nfooter\nrare {i // 3}") for i in range(600)], "doc_id long, text string")
    left = m.drop_repeated_lines(docs).collect()
    assert len(left) == 600 and {r.n_dropped for r in left} == {1}
    # 4 batches, a compaction that finds the footer, and 12 batches without it
    assert sum(n for _, n in removed) >= 12 and removed[0] == (0, 0)


def test_maximal_segments_are_linear():
    import time

    from webtide.llm.toxicity import maximal_segments

    def slow(scores, length, drift):
        held, total, at = [], 0.0, 0
        for place, score in scores:
            total += (place - at) * drift
            at = place + 1
            new = [place, at, total, total + score]
            total += score
            while True:
                j = next((j for j in range(len(held) - 1, -1, -1) if held[j][2] < new[2]), -1)
                if j < 0 or held[j][3] >= new[3]:
                    held.append(new)
                    break
                new = [held[j][0], new[1], held[j][2], new[3]]
                del held[j:]
        return [(a, b, high - low) for a, b, low, high in held]

    rng = random.Random(2)
    for _ in range(200):
        scores = [(i, rng.choice([0.5, 1.0, 2.5, 4.0])) for i in range(80) if rng.random() < rng.choice([0.2, 0.7])]
        assert maximal_segments(scores, 80, -1.0) == slow(scores, 80, -1.0)
    began = time.time()
    n = 64_000
    assert len(maximal_segments([(3 * i, 1.0) for i in range(n)], 3 * n, -1.0)) == n
    assert len(maximal_segments([(2 * i, 3.0 - i / n) for i in range(n)], 2 * n, -1.0)) == 1
    assert time.time() - began < 1
