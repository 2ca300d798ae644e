"""SimHash near-dedup with a forest of BK-trees.

A document's fingerprint has a bit for each bit of its shingles' hashes: 1
if the bit is set in over half of them. Fingerprints within ``radius`` bits
of each other agree in at least one of ``radius + 1`` bands of bits, so each
(band, value) is a shard, and both the shard's BK-tree and its queries come
to the same task. In a BK-tree the children of a node are keyed by their
Hamming distance to it; a query at distance d follows only the edges from
d - radius to d + radius. The trees of a batch of shards are built and
searched together, level by level, in numpy arrays.

The sum of all shard trees grows with the corpus, so the trees are not
broadcast from the driver: each is shuffled to where it is searched. A shard
with more than ``TREE`` fingerprints is cut into several trees and several
sets of queries, and each tree meets each set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, stored, whole_text
from .components import components
from .texts import releasing, take_runs

BITS = 64
#: Fingerprints of a tree, and queries that meet it in one group.
TREE = 4096
#: Queries that a task carries through the trees at once.
QUERIES = 2048
_LANES = 255  # hashes that a byte-wide counter can add up


def bit_majority(hashes, ends):
    """Fingerprints of runs of 64-bit hashes: a bit is 1 if it is set in over
    half of a run. ``ends``: where each run ends; an empty run gives 0."""
    import numpy as np

    # a table spreads a byte's bits over eight byte-wide counters
    spread = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64).ravel()
    starts = np.concatenate([[0], ends[:-1]])
    size = ends - starts
    parts = -(-size // _LANES)
    first = np.cumsum(parts) - parts
    step = np.arange(int(parts.sum())) - np.repeat(first, parts)
    cuts = np.repeat(starts, parts) + step * _LANES
    out = np.zeros(len(ends), np.uint64)
    if not len(cuts):
        return out
    lanes = np.add.reduceat(spread[hashes.view(np.uint8).reshape(-1, 8)], cuts, axis=0)
    full = size > 0
    ones = np.add.reduceat(lanes.view(np.uint8).reshape(len(cuts), BITS).astype(np.int64), first[full], axis=0)
    out[full] = np.packbits(2 * ones > size[full, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def shingle_hashes(text: str, words: int, seed: int = 42):
    """XXH64 of the word shingles of a text, repeats included."""
    import numpy as np
    from xxhash import xxh64_intdigest

    # bytes.lower and bytes.split know ASCII letters and blanks only
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if len(found) <= words:
        return np.array([xxh64_intdigest(b" ".join(found), seed)] if found else [], np.uint64)
    joined = b" ".join(found)
    end = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    start = np.concatenate([[0], end[: -words] + 1])
    return np.fromiter([xxh64_intdigest(joined[a:b], seed) for a, b in zip(start.tolist(), end[words - 1 :].tolist())], np.uint64, len(start))


def _fingerprints(words: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            hashes, ends, n, out = [], [], 0, []
            texts = batch.column("text").to_pylist()
            for i, t in enumerate(texts):
                h = shingle_hashes(t, words)
                n += len(h)
                hashes.append(h)
                ends.append(n)
                if n > 1 << 19 or i == len(texts) - 1:
                    out.append(bit_majority(np.concatenate(hashes), np.array(ends)))
                    hashes, ends, n = [], [], 0
            found = np.concatenate(out) if out else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), batch.column("row"), pa.array(found.view(np.int64))], names=["id", "h", "row", "fingerprint"])

    return run


def text_hash(text_col: str) -> Column:
    """With the id, what a row is known by."""
    return F.xxhash64(whole_text(text_col))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, h, row, fingerprint as a signed long) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), text_hash(text_col).alias("h"), F.monotonically_increasing_id().alias("row"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(releasing(_fingerprints(words)), f"id {rows.schema['id'].dataType.simpleString()}, h long, row long, fingerprint long")


class Forest:
    """BK-trees of several groups of different fingerprints."""

    def __init__(self, prints, group):
        """``group`` is sorted; the first entry of a group is its root."""
        import numpy as np

        self.prints = prints
        self.groups, self.roots = np.unique(group, return_index=True)
        node = np.repeat(self.roots, np.diff(np.append(self.roots, len(group))))
        going = np.setdiff1d(np.arange(len(group)), self.roots)
        node = node[going]
        edges, children = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(going):
            distance = np.bitwise_count(prints[going] ^ prints[node])
            key, first, which = np.unique(node * (BITS + 1) + distance, return_index=True, return_inverse=True)
            child = going[first]
            edges.append(key)
            children.append(child)
            node = child[which]
            on = node != going
            going, node = going[on], node[on]
        self.edges, self.children = np.concatenate(edges), np.concatenate(children)
        order = np.argsort(self.edges)
        self.edges, self.children = self.edges[order], self.children[order]

    def search(self, prints, group, radius: int):
        """(query, entry) places of all pairs within ``radius`` bits in the
        same group."""
        import numpy as np

        at = np.searchsorted(self.groups, group)
        there = at < len(self.groups)
        there[there] = self.groups[at[there]] == group[there]
        query = np.flatnonzero(there)
        node = self.roots[at[query]]
        pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        while len(query):
            distance = np.bitwise_count(prints[query] ^ self.prints[node]).astype(np.int64)
            near = distance <= radius
            pairs.append((query[near], node[near]))
            low = np.searchsorted(self.edges, node * (BITS + 1) + np.maximum(distance - radius, 0))
            high = np.searchsorted(self.edges, node * (BITS + 1) + np.minimum(distance + radius, BITS), "right")
            query, node = np.repeat(query, high - low), take_runs(self.children, low, high - low)
        return np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs])


def least_labels(n: int, a, b):
    """For nodes 0 to n - 1 and links a - b: the least node of each one's
    component."""
    import numpy as np

    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _stars(radius: int):
    """Links of whole groups (sorted by group), as a star around the least
    fingerprint of each component within what a task has at hand."""

    def links(group, prints, entry, query):
        import numpy as np

        forest = Forest(prints[entry], group[entry])
        entries, queries = np.flatnonzero(entry), np.flatnonzero(query)
        nodes, place = np.unique(prints, return_inverse=True)
        label = np.arange(len(nodes))
        for i in range(0, len(queries), QUERIES):
            some = queries[i : i + QUERIES]
            q, e = forest.search(prints[some], group[some], radius)
            a, b = place[some[q]], place[entries[e]]
            # join what this part links to what is linked already
            label = least_labels(len(nodes), np.concatenate([a, np.arange(len(nodes))]), np.concatenate([b, label]))
        linked = np.flatnonzero(label != np.arange(len(nodes)))
        return nodes[linked], nodes[label[linked]]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held = None

        def out(rows):
            a, b = links(rows[0], rows[1].view(np.uint64), rows[2], rows[3])
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("group", "fingerprint", "entry", "query")]
            held = [np.concatenate(x) for x in zip(held, new)] if held else new
            if not len(held[0]):
                continue
            # the last group may go on in the next batch
            whole = int(np.searchsorted(held[0], held[0][-1]))
            if whole:
                yield out([x[:whole] for x in held])
                held = [x[whole:] for x in held]
        if held and len(held[0]):
            yield out(held)

    return run


def shard_groups(prints: DataFrame, radius: int, tree: int) -> DataFrame:
    """(group, fingerprint, entry, query): which trees a fingerprint is in
    and which it is searched in. ``prints`` has each fingerprint once."""
    bands = radius + 1
    cuts = [BITS * i // bands for i in range(bands + 1)]
    shards = F.array(
        *[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(F.shiftleft("fingerprint", BITS - b), BITS - b + a).alias("value")) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    )
    members = prints.select("fingerprint", F.explode(shards).alias("s")).select("fingerprint", "s.band", "s.value")
    large = members.groupBy("band", "value").agg(F.ceil(F.count(F.lit(1)) / tree).cast("int").alias("trees")).where("trees > 1")
    split = members.join(large, ["band", "value"], "left").withColumn("trees", F.coalesce("trees", F.lit(1)))
    own = F.pmod(F.xxhash64("fingerprint", F.lit("tree")), F.col("trees")).cast("int")
    # the tree of a part meets the queries of that part and of all later ones
    parts = F.transform(
        F.sequence(F.lit(0), F.col("trees") - 1),
        lambda k: F.struct(F.least(k, F.col("own")).alias("tree"), F.greatest(k, F.col("own")).alias("set"), (F.col("own") <= k).alias("entry"), (F.col("own") >= k).alias("query")),
    )
    placed = split.withColumn("own", own).select("fingerprint", "band", "value", F.explode(parts).alias("p"))
    return placed.select(F.xxhash64("band", "value", "p.tree", "p.set").alias("group"), "fingerprint", "p.entry", "p.query")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3, tree: int = TREE) -> DataFrame:
    """Id, fingerprint (16 hex digits), component_id, kept, row, h of every row.

    Texts are cut into words at ASCII blanks, A-Z in lower case; a shingle is
    ``words`` words joined by spaces (fewer words: all of them). A text
    without words has the fingerprint zero and links like any other. Rows
    link when their fingerprints differ in at most ``radius`` bits;
    ``component_id`` is the smallest id in the component (null ids count as
    largest), and exactly one row of a component is kept, the first with that
    id. Rows with one fingerprint, however many, are one node of the search.
    Null texts count as empty; texts of any length are read whole; an empty
    table gives none.
    """
    rows = stored(fingerprints(docs, id_col, text_col, words))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row")))
    prints = stored(rows.groupBy("fingerprint").agg(first.alias("first")))
    groups = shard_groups(prints.select("fingerprint"), radius, tree)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = groups.repartition(partitions, "group").sortWithinPartitions("group").mapInArrow(_stars(radius), "a long, b long")
    found = stored(prints.join(components(links).withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint")))
    least = found.groupBy("component").agg(F.min("first").alias("least"))
    named = found.join(least, "component").select("fingerprint", "least")
    return rows.join(named, "fingerprint").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), F.col("least.id").alias("component_id"), (F.col("row") == F.col("least.row")).alias("kept"), "row", "h"
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component: one with its smallest id."""
    found = near_duplicates(docs, id_col, text_col, **options)
    keys = found.groupBy(F.col(id_col).alias("id"), "h").agg(F.count(F.lit(1)).alias("rows"), F.max("kept").alias("kept"))
    return keep_rows(docs, stored(keys.where("kept")), id=F.col(id_col), h=text_hash(text_col))
