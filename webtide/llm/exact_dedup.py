"""Exact dedup with a heavy-hitter split.

Every row gets the SHA-256 of its normalised text. A Misra-Gries summary of
each partition, merged by addition, names the digests that may be frequent;
one exact count verifies them. The verified winners (at most ``counters``
rows) are broadcast, and their copies are settled on the map side. All
other digests have fewer than rows / counters copies each and take an
ordinary shuffle, in which no group can weigh down a task.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, keep_rows, stored, whole_text, with_row

#: Counters of a Misra-Gries summary, and so the bound on broadcast rows.
COUNTERS = 1024


def misra_gries(counts: Counter, counters: int) -> Counter:
    """Summary of at most ``counters`` entries: when there are more, the
    largest count beyond them is subtracted from all."""
    if len(counts) <= counters:
        return counts
    cut = sorted(counts.values(), reverse=True)[counters]
    return Counter({k: n - cut for k, n in counts.items() if n > cut})


def _summaries(counters: int):
    def run(batches):
        import pyarrow as pa

        held: Counter = Counter()
        for batch in batches:
            held.update(batch.column(0).to_pylist())
            held = misra_gries(held, counters)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], names=["digest", "at_least"])

    return run


def frequent_digests(rows: DataFrame, counters: int) -> DataFrame:
    """Exact (digest, size, winner) of every digest that has at least one
    in ``counters`` rows. Summaries added up undercount a digest by less
    than rows / counters in all, so none of those is missed: their number
    is below ``counters``, and each is among the candidates. ``at_least`` is
    positive for them, and the candidates are cut to the largest only after
    the summaries of all partitions are added up."""
    summaries = rows.select("digest").mapInArrow(_summaries(2 * counters), "digest string, at_least long")
    # with 2 * counters entries a summary undercounts by rows / (2 * counters) at
    # most: a frequent digest keeps at least that much, and no more than 2 * counters
    # digests can
    candidates = summaries.groupBy("digest").agg(F.sum("at_least").alias("at_least")).orderBy(F.desc("at_least"), "digest").limit(2 * counters)
    exact = rows.join(F.broadcast(candidates.select("digest")), "digest").groupBy("digest").agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("id", "row")).alias("winner"))
    total = rows.count()
    return exact.where(F.col("size") * counters >= F.lit(total)).where("size > 1")


def _digest(normal: Column | None, text_col: str) -> Column:
    text = normal if normal is not None else ascii_lower(whole_text(text_col))
    return F.sha2(F.encode(text, "UTF-8"), 256)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS, normal: Column | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, row.

    Texts are equal when identical after lower-casing A-Z (``normal``: any
    other normal form). Of equal texts the row with the largest id stays;
    null ids count as smallest, and of rows that repeat an id the last one
    stays, so that each group keeps exactly one row. Null texts count as
    empty; texts of any length are read whole; an empty table gives none.
    Other columns of ``docs`` are not read.
    """
    rows = stored(with_row(docs, id=F.col(id_col), digest=_digest(normal, text_col)))
    heavy = stored(frequent_digests(rows, counters))
    tagged = rows.join(F.broadcast(heavy), "digest", "left")
    group = Window.partitionBy("digest")
    rest = tagged.where("size is null").select("id", "row", "digest", F.count(F.lit(1)).over(group).alias("size"), F.max(F.struct("id", "row")).over(group).alias("winner"))
    settled = tagged.where("size is not null").select("id", "row", "digest", "size", "winner")
    return settled.union(rest).select(
        F.col("id").alias(id_col), F.col("winner.id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("row") == F.col("winner.row")).alias("kept"), F.col("digest").alias("text_sha256"), "row"
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group: one with the id that stays."""
    found = exact_duplicates(docs, id_col, text_col, **options)
    winners = found.where(F.col(id_col).eqNullSafe(F.col("keep_id"))).groupBy(F.col(id_col).alias("id"), F.col("text_sha256").alias("digest"))
    return keep_rows(docs, stored(winners.agg(F.count(F.lit(1)).alias("rows"))), id=F.col(id_col), digest=_digest(options.get("normal"), text_col))
