"""Embedding near-dedup by collision-counting projections.

Every vector is projected on many random directions. Two vectors collide in
a projection when the second is in a window around the first; near vectors
collide in nearly all projections. Vectors are sorted by the leading
projection and only meet those in its window. For these the collisions in
the other projections are counted, pairs are left as soon as they have too
many misses, and pairs that reach the count are verified by their cosine in
double precision.

Window and count are calibrated for recall: the difference of two unit
vectors at the cosine ``threshold`` is normal in every projection, so the
share of such pairs that pass follows exactly, and nearer pairs pass more
often. Nothing is calibrated on the data.

Work: windows hold a share of all vectors, so the count of pairs looked at
grows with the square of the input, at a few nanoseconds a pair; memory and
output do not. Pairs are never emitted: a task gives a row's number of links
and a star around the least vector of each component in the task.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, with_row
from .components import components
from .simhash import least_labels

#: Counted projections, besides the one that sorts.
PROJECTIONS = 32
#: Half width of a window, in standard deviations of a pair at the threshold.
WINDOW = 2.2
#: Share of the pairs at the threshold that must pass all of the steps.
RECALL = 0.95
#: Vectors of a block; a task meets two blocks.
BLOCK = 4096
#: Query vectors that are counted at once.
QUERIES = 256
SEED = 20


def calibrate(projections: int = PROJECTIONS, window: float = WINDOW, recall: float = RECALL) -> int:
    """Collisions that a pair must reach: the largest count that, with the
    sorting window, ``recall`` of the pairs at the threshold pass."""
    p = math.erf(window / math.sqrt(2))
    share, count = 0.0, projections + 1
    while share * p < recall:
        count -= 1
        if count < 0:
            raise ValueError("this window cannot reach the recall")
        share += math.comb(projections, count) * p**count * (1 - p) ** (projections - count)
    return count


def directions(size: int, projections: int):
    import numpy as np

    return np.random.default_rng(SEED).standard_normal((size, projections + 1))


def _units(vectors):
    import numpy as np

    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    return x / np.linalg.norm(x, axis=1)[:, None]


def _near_pairs(left, right, same: bool, threshold: float, width: float, count: int, window_of_first: float):
    """Yields (places in left, places in right) of verified pairs. The unit
    vectors of each side are sorted by the leading projection."""
    import numpy as np

    side = directions(left.shape[1], PROJECTIONS)
    a, b = np.ascontiguousarray((left @ side).T.astype(np.float32)), np.ascontiguousarray((right @ side).T.astype(np.float32))
    misses = PROJECTIONS - count
    dense = PROJECTIONS * 3 // 8
    for i in range(0, len(left), QUERIES):
        j = min(i + QUERIES, len(left))
        lo = i + 1 if same else int(np.searchsorted(b[0], a[0, i] - window_of_first))
        hi = int(np.searchsorted(b[0], a[0, j - 1] + window_of_first, "right"))
        if lo >= hi:
            continue
        collisions = np.zeros((j - i, hi - lo), np.uint8)
        for k in range(1, dense + 1):
            collisions += np.abs(a[k, i:j, None] - b[k, None, lo:hi]) <= width
        q, e = np.nonzero(collisions >= dense - misses)
        held = collisions[q, e].astype(np.int16)
        q, e = q + i, e + lo
        for k in range(dense + 1, PROJECTIONS + 1):
            held += np.abs(a[k, q] - b[k, e]) <= width
            if k % 4 == 0 or k == PROJECTIONS:
                on = held >= k - misses
                q, e, held = q[on], e[on], held[on]
        on = np.abs(a[0, q] - b[0, e]) <= window_of_first
        if same:
            on &= e > q
        q, e = q[on], e[on]
        for s in range(0, len(q), 1 << 16):
            x, y = q[s : s + (1 << 16)], e[s : s + (1 << 16)]
            near = np.einsum("ij,ij->i", left[x], right[y]) >= threshold
            yield x[near], y[near]


def _links(threshold: float, width: float, count: int, lead: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        left, right = rows[rows.as_left].sort_values(["lead", "rep"]), rows[rows.as_right].sort_values(["lead", "rep"])
        out = pd.DataFrame({"rep": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "low": np.zeros(0, np.int64)})
        if left.empty or right.empty:
            return out
        same = bool((left.as_right).iloc[0])
        x = _units(left.vec)
        y = x if same else _units(right.vec)
        reps, place = np.unique(np.concatenate([left.rep, right.rep]), return_inverse=True)
        of_left, of_right = place[: len(left)], place[len(left) :]
        copies = np.zeros(len(reps), np.int64)
        copies[of_left], copies[of_right] = left.copies, right.copies
        links, label = np.zeros(len(reps), np.int64), np.arange(len(reps))
        for q, e in _near_pairs(x, y, same, threshold, width, count, lead):
            a, b = of_left[q], of_right[e]
            links += np.bincount(a, copies[b], len(reps)).astype(np.int64) + np.bincount(b, copies[a], len(reps)).astype(np.int64)
            label = least_labels(len(reps), np.concatenate([a, np.arange(len(reps))]), np.concatenate([b, label]))
        some = np.flatnonzero(links)
        return pd.DataFrame({"rep": reps[some], "links": links[some], "low": reps[label[some]]})

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, block: int = BLOCK) -> DataFrame:
    """Id, n_links, component_id, kept for every row.

    ``n_links`` is the number of other rows found with cosine >= threshold
    (each checked in double precision; recall as calibrated). Equal vectors
    always link, and are searched once. Null and zero vectors, and those with
    null or non-finite components, link with nothing and are components of
    their own; vectors of different length never link. ``component_id`` is
    the smallest id in the component (null ids count as largest), and
    ``kept`` is true for rows with that id. An empty table gives none.
    """
    vec = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = stored(with_row(vectors, id=F.col(id_col), vec=vec))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fine = F.coalesce(F.col("vec").isNotNull() & ~F.exists("vec", bad) & F.exists("vec", lambda x: x != 0), F.lit(False))
    least = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id")))
    reps = stored(rows.where(fine).groupBy("vec").agg(F.count(F.lit(1)).alias("copies"), F.min("row").alias("rep"), least.alias("first")))

    spread = math.sqrt(max(2 - 2 * threshold, 1e-12))
    width = lead = WINDOW * spread
    size = F.size("vec")

    @F.pandas_udf("double")
    def leading(v: pd.Series) -> pd.Series:
        import numpy as np

        side = {n: directions(n, PROJECTIONS)[:, 0] for n in set(map(len, v))}
        return pd.Series([float(_units([x])[0] @ side[len(x)]) for x in v], dtype="float64")

    placed = stored(reps.select("rep", "copies", "vec", leading("vec").alias("lead")).select("*", size.alias("dims"), F.floor(F.col("lead") / F.lit(lead)).cast("int").alias("cell")))
    counts = placed.groupBy("dims", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    beside = counts.select("dims", (F.col("cell") + 1).alias("cell"), F.col("blocks").alias("below")).join(counts, ["dims", "cell"], "full")
    beside = beside.join(counts.select("dims", (F.col("cell") - 1).alias("cell"), F.col("blocks").alias("above")), ["dims", "cell"], "left").where("blocks is not null")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    cells = placed.join(beside, ["dims", "cell"]).withColumn("own", own)
    none = F.array().cast("array<struct<cell:int,a:int,next:boolean,b:int,as_left:boolean,as_right:boolean>>")

    def pairs(n, make):
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), make)).otherwise(none)

    def pair(cell, a, up, b, as_left, as_right):
        return F.struct(cell.cast("int").alias("cell"), a.cast("int").alias("a"), F.lit(up).alias("next"), b.cast("int").alias("b"), as_left.alias("as_left"), as_right.alias("as_right"))

    c, me, yes, no = F.col("cell"), F.col("own"), F.lit(True), F.lit(False)
    within = pairs(F.col("blocks"), lambda k: pair(c, F.least(k, me), False, F.greatest(k, me), me <= k, me >= k))
    up = pairs(F.coalesce("above", F.lit(0)), lambda k: pair(c, me, True, k, yes, no))
    down = pairs(F.coalesce("below", F.lit(0)), lambda k: pair(c - 1, k, True, me, no, yes))
    met = cells.select("rep", "copies", "vec", "lead", "dims", F.explode(F.concat(within, up, down)).alias("p")).select("rep", "copies", "vec", "lead", "dims", "p.*")
    found = stored(met.groupBy("dims", "cell", "a", "next", "b").applyInPandas(_links(threshold, width, calibrate(), lead), "rep long, links long, low long"))

    parts = components(found.select(F.col("rep").alias("a"), F.col("low").alias("b"))).select(F.col("node").alias("rep"), "component")
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = stored(reps.select("vec", "rep", "copies", "first").join(linked, "rep", "left").join(parts, "rep", "left").withColumn("component", F.coalesce("component", "rep")))
    smallest = named.groupBy("component").agg(F.min("first").alias("least"))
    classes = named.join(smallest, "component").select("vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("least.id").alias("component_id"))
    linking = rows.where(fine).join(classes, "vec").select("id", "n_links", "component_id")
    alone = rows.where(~fine).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linking.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
