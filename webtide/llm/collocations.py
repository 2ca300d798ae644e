"""Phrase collocations on a weighted de Bruijn graph of words.

Texts are cut into pieces at punctuation, and pieces into words. The nodes
of the graph are the phrases of ``most - 1`` words and its edges those of
``most`` words, each from the node of its first words to that of its last;
a weight is the number of occurrences. Only edges are counted, and with them
the at most ``most - 1`` words that end a piece. What is shorter follows from
the flow: a node occurs as often as the edges that leave it, and as pieces
that end in it; a shorter phrase as often as the nodes that begin with it,
and as pieces that end in it. Chains of frequent edges of one weight whose
nodes have no other way in or out are compacted into paths by pointer
doubling.

Before that, a filter cuts pieces between two words that cannot both be in a
frequent phrase. Pairs of neighbours are counted by a hash of fixed width;
the pairs whose bucket stays below the threshold are rare for certain, and
no frequent phrase, nor a part of one, holds a rare pair. The filter is a
bitmap of fixed size (``BUCKETS`` bits). A full bitmap would cut nothing,
with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, whole_text
from .texts import _Numbers, groups

#: Buckets in which neighbouring words are counted (16 MB of bits).
BUCKET_BITS = 27
BUCKETS = 1 << BUCKET_BITS
#: Ranges of buckets, each added up by itself.
RANGES = 256
#: Characters of texts that are counted together before they are shuffled.
GROUP = 1 << 22
#: A token between pieces: a byte that UTF-8 never has.
END = b"\xff"
#: Ids of words within a group take so many bits, five of them two numbers.
ID_BITS = 21
#: Languages up to which their word counts are broadcast.
LANGS = 10_000

_ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)


def tokens(texts: list[str]) -> list[bytes]:
    """The words of the texts, A-Z in lower case, and END between pieces."""
    joined = "\n".join(texts).encode("utf-8", "surrogatepass").lower().translate(_ENDS)
    return joined.replace(b"\n", b" \xff ").split()


def _numbered(texts: list[str], lang: str):
    """(words, their numbers in order with END as 0, hash of each word)."""
    import numpy as np
    from xxhash import xxh64_intdigest

    found = tokens(texts)
    ids = _Numbers()
    ids[END]
    at = np.fromiter(map(ids.__getitem__, found), np.int64, len(found))
    seed = xxh64_intdigest(lang.encode("utf-8", "surrogatepass")) & 0xFFFFFFFF
    codes = np.fromiter((xxh64_intdigest(w, seed) for w in ids), np.uint64, len(ids))
    return list(ids), at, codes


def _buckets(at, codes):
    """Bucket of each word with the next one, and whether both are words."""
    import numpy as np

    code = codes[at]
    mixed = code[:-1] * np.uint64(0x9E3779B97F4A7C15) + code[1:]
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), (at[:-1] > 0) & (at[1:] > 0)


def _by_language(batch):
    """(language, texts) of the groups of a batch."""
    langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
    for a, b in groups(texts, GROUP):
        own: dict[str, list[str]] = {}
        for lang, text in zip(langs[a:b], texts[a:b]):
            own.setdefault(lang, []).append(text)
        yield from own.items()


def _count_pairs(batches):
    import numpy as np
    import pyarrow as pa

    width = BUCKETS // RANGES
    for batch in batches:
        for lang, texts in _by_language(batch):
            _, at, codes = _numbered(texts, lang)
            bucket, both = _buckets(at, codes) if len(at) > 1 else (np.zeros(0, np.int64), np.zeros(0, bool))
            bucket, n = np.unique(bucket[both], return_counts=True)
            cut = np.searchsorted(bucket, np.arange(RANGES + 1) * width)
            full = np.flatnonzero(np.diff(cut))
            steps = [np.diff(bucket[cut[r] : cut[r + 1]], prepend=r * width).astype(np.uint32).tobytes() for r in full]
            counts = [np.minimum(n[cut[r] : cut[r + 1]], 0xFFFF).astype(np.uint16).tobytes() for r in full]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(steps, pa.binary()), pa.array(counts, pa.binary())], names=["part", "steps", "counts"])


def _frequent_buckets(least: int):
    """Bits of the buckets of whole ranges that reach ``least``."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held: dict[int, object] = {}
        for batch in batches:
            for part, steps, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "steps", "counts"))):
                if part not in held:
                    held[part] = np.zeros(BUCKETS // RANGES, np.uint32)
                at = np.cumsum(np.frombuffer(steps, np.uint32), dtype=np.int64)
                # counts that have reached the threshold need not grow on
                held[part][at] = np.minimum(held[part][at] + np.frombuffer(counts, np.uint16), least)
        if held:
            bits = [np.packbits(x >= least).tobytes() for x in held.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(bits, pa.binary())], names=["part", "bits"])

    return run


def frequent_pairs(spark: SparkSession, rows: DataFrame, least: int):
    """Broadcast bitmap of the buckets that hold ``least`` pairs or more."""
    counted = rows.mapInArrow(_count_pairs, "part int, steps binary, counts binary")
    found = counted.repartition("part").mapInArrow(_frequent_buckets(min(least, 0xFFFF)), "part int, bits binary").collect()
    width = BUCKETS // RANGES // 8
    bits = bytearray(BUCKETS // 8)
    for r in found:  # at most RANGES rows, BUCKETS bits in all
        bits[r.part * width : (r.part + 1) * width] = r.bits
    return spark.sparkContext.broadcast(bytes(bits))


def _phrases(most: int, bitmap):
    """Local counts of edges (``most`` words) and of the words that end a
    piece (fewer): each word begins one of them."""

    def rows(words, at, codes, bits, inside):
        """Phrases that begin at one of the first ``inside`` tokens."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        bucket, linked = _buckets(np.append(at, 0), codes)
        linked &= (bits[bucket >> 3] >> (7 - (bucket & 7)).astype(np.uint8)) & 1 == 1
        linked = np.append(linked, np.zeros(most, bool))
        size, on = np.ones(len(at), np.int64), np.ones(len(at), bool)
        for j in range(most - 1):
            on &= linked[j : j + len(at)]
            size += on
        start = np.flatnonzero(at[:inside] > 0)
        size = size[start]
        padded = np.append(at, np.zeros(most, at.dtype))
        of = [np.where(size > j, padded[start + j], 0) for j in range(most)]
        # a phrase as two numbers: three ids and the others
        keys = [np.zeros(len(start), np.int64) for _ in range(-(-most // 3))]
        for j, ids in enumerate(of):
            keys[j // 3] = keys[j // 3] << ID_BITS | ids
        order = np.lexsort(keys[::-1])
        new = np.append(True, np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0))[: len(order)]
        first = order[new]
        n = np.diff(np.append(np.flatnonzero(new), len(order)))
        names = pa.array(words, pa.binary())
        columns = [names.take(pa.array(ids[first], mask=ids[first] == 0)) for ids in of]
        text = pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.binary()), null_handling="skip")
        return text, size[first], n

    def run(batches):
        import numpy as np
        import pyarrow as pa

        bits = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            for lang, texts in _by_language(batch):
                words, at, codes = _numbered(texts, lang)
                # a group may have more words than there are ids (one very long text)
                width, a = (1 << ID_BITS) - 2, 0
                while a < len(at):
                    part, own, codes_of = at[a : a + width], words, codes
                    if len(words) > width:
                        used, part = np.unique(np.append(0, part), return_inverse=True)
                        part, own, codes_of = part[1:], [words[i] for i in used], codes[used]
                    # the last words of a part also begin the next one
                    inside = len(part) if a + len(part) == len(at) else len(part) - (most - 1)
                    text, size, n = rows(own, part, codes_of, bits, inside)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), text.cast(pa.string()), pa.array(size, pa.int32()), pa.array(n, pa.int64())], names=["lang", "phrase", "k", "n"])
                    a += inside

    return run


def phrase_counts(docs: DataFrame, text_col: str, lang_col: str, most: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(edges, ends): (lang, phrase, k, n) of all phrases of ``most`` words,
    and of the shorter ones that end a piece."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), whole_text(text_col).alias("text"))
    local = rows.mapInArrow(_phrases(most, frequent_pairs(spark, rows, least)), "lang string, phrase string, k int, n long")
    counted = stored(local.groupBy("lang", "phrase", "k").agg(F.sum("n").alias("n")))
    return counted.where(F.col("k") == most), counted.where(F.col("k") < most)


def first_words(phrase: str | Column, n: int | Column) -> Column:
    return F.substring_index(phrase, " ", n) if isinstance(n, int) else F.call_function("substring_index", F.col(phrase) if isinstance(phrase, str) else phrase, F.lit(" "), n)


def node_flow(edges: DataFrame, ends: DataFrame, most: int) -> DataFrame:
    """(lang, phrase, k, n) of all phrases shorter than an edge."""
    leaving = edges.select("lang", first_words("phrase", most - 1).alias("phrase"), "n")
    nodes = stored(leaving.union(ends.where(F.col("k") == most - 1).select("lang", "phrase", "n")).groupBy("lang", "phrase").agg(F.sum("n").alias("n")))
    below = nodes.withColumn("k", F.lit(most - 1)).unionByName(ends.where(F.col("k") < most - 1))
    starts = F.transform(F.sequence(F.lit(1), F.least("k", F.lit(most - 2))), lambda j: F.struct(first_words("phrase", j).alias("phrase"), j.alias("k")))
    shorter = below.select("lang", F.explode(starts).alias("s"), "n").groupBy("lang", F.col("s.phrase").alias("phrase"), F.col("s.k").alias("k")).agg(F.sum("n").alias("n"))
    return nodes.select("lang", "phrase", F.lit(most - 1).alias("k"), "n").union(shorter)


def compact_paths(edges: DataFrame, most: int) -> DataFrame:
    """(lang, words, n): the graph with its unary paths compacted.

    A node is unary if one edge enters it, one leaves it, and both have the
    same weight. Each edge points to the one before it across a unary node;
    pointers double until they reach the head of the path. The edges that
    never get to a head are on cycles, and stay as they are.
    """
    inner = F.col("phrase")
    into = edges.groupBy("lang", F.substring_index(inner, " ", 1 - most).alias("node")).agg(F.count(F.lit(1)).alias("c"), F.first("phrase").alias("before"), F.first("n").alias("n")).where("c = 1")
    out = edges.groupBy("lang", first_words(inner, most - 1).alias("node")).agg(F.count(F.lit(1)).alias("c"), F.first("phrase").alias("phrase"), F.first("n").alias("n")).where("c = 1")
    unary = into.join(out, ["lang", "node", "n"]).where("before != phrase").select("lang", "phrase", "before")
    at = stored(edges.join(unary, ["lang", "phrase"], "left").select("lang", "phrase", "n", F.coalesce("before", "phrase").alias("head"), F.when(F.col("before").isNotNull(), 1).otherwise(0).alias("place")))
    left = None
    while True:
        # an edge is settled once its pointer has reached a head, which points to itself
        ahead = at.select("lang", F.col("phrase").alias("head"), F.col("head").alias("further"), F.col("place").alias("more"))
        at = stored(at.join(ahead, ["lang", "head"]).select("lang", "phrase", "n", F.col("further").alias("head"), (F.col("place") + F.col("more")).alias("place"), (F.col("further") != F.col("head")).alias("open")))
        still = at.where("open").count()
        if not still or still == left:
            break
        left = still
    heads = at.where("not open").select("lang", "phrase").alias("h")
    chains = at.where("not open")
    last = F.substring_index("phrase", " ", -1)
    words = F.concat(F.split("head", " "), F.transform(F.array_sort(F.collect_list(F.struct("place", last.alias("word")))), lambda x: x["word"]))
    paths = chains.groupBy("lang", "head", "n").agg(words.alias("words"))
    # the head's own last word came twice
    paths = paths.select("lang", F.concat(F.slice("words", 1, most), F.slice("words", most + 2, F.greatest(F.size("words") - most - 1, F.lit(0)))).alias("words"), "n")
    return paths.union(at.where("open").select("lang", F.split("phrase", " "), "n"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = 5, least: int = 100, percent: int = 100, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top``.

    Everything is counted per language (null: ``und``); A-Z are lower-cased,
    pieces end at ``. , ; : ! ?`` and the controls 10 to 13, words are what
    stands between spaces and tabs. A candidate has 2 to ``most`` words and
    a >= ``least`` occurrences, overlaps included. Cut after its first words,
    it has the score floor(1000 * a * n / (l * r)) with the counts of both
    parts and of all words; the cut with the lowest score counts, of ties the
    first. A candidate inside a longer one that occurs at least ``percent``
    in a hundred as often is dropped. Order: score and a descending, phrase
    ascending by bytes. Arithmetic is exact (38 digits).

    Null and empty texts have no words. Repeated rows are counted as often as
    they come; ids are not read. An empty table, or one without frequent
    phrases, gives none. A phrase may be in any share of all texts: counts
    are added up within groups of texts before they are shuffled.
    """
    edges, ends = phrase_counts(docs, text_col, lang_col, most, least)
    flow = stored(node_flow(edges, ends, most).where((F.col("n") >= least) | (F.col("k") == 1)))
    total = flow.where("k = 1").groupBy("lang").agg(F.sum("n").alias("total"))
    heavy = edges.where(F.col("n") >= least)
    counts = flow.where(F.col("n") >= least)
    candidates = counts.where("k > 1").unionByName(heavy)

    # what a longer candidate holds: nodes of the paths, and parts of the nodes
    paths = compact_paths(heavy, most)
    on_paths = F.transform(F.sequence(F.lit(1), F.size("words") - (most - 2)), lambda i: F.array_join(F.slice("words", i, most - 1), " "))
    held = [paths.select("lang", F.explode(on_paths).alias("phrase"), "n")]
    parts = F.array(F.call_function("substring_index", F.col("phrase"), F.lit(" "), F.col("k") - 1), F.call_function("substring_index", F.col("phrase"), F.lit(" "), 1 - F.col("k")))
    held.append(counts.where("k > 2").select("lang", F.explode(parts).alias("phrase"), "n"))
    inside = held[0].union(held[1]).groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    free = candidates.join(inside, ["lang", "phrase"], "left").where(F.coalesce(F.lit(100) * F.col("longer") < F.lit(percent) * F.col("n"), F.lit(True)))

    cuts = free.select("lang", "phrase", "k", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumns({
        "left": F.call_function("substring_index", F.col("phrase"), F.lit(" "), F.col("cut")),
        "right": F.call_function("substring_index", F.col("phrase"), F.lit(" "), F.col("cut") - F.col("k")),
    })
    part = counts.select("lang", "phrase", "n")
    both = cuts.join(part.toDF("lang", "left", "l"), ["lang", "left"]).join(part.toDF("lang", "right", "r"), ["lang", "right"])
    scored = both.join(F.broadcast(total) if len(total.take(LANGS + 1)) <= LANGS else total, "lang")
    exact = "cast(((cast(a as decimal(18,0)) * cast(total as decimal(18,0))) * 1000BD) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) as bigint)"
    best = scored.withColumn("score", F.expr(exact)).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "total")).alias("b"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.select("lang", "phrase", "b.score", "b.a", "b.l", "b.r", F.col("b.total").alias("n")).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
