"""Helpers shared by the training-data operators."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Upper bits of ``monotonically_increasing_id``: the partition of the row.
PARTITION_SHIFT = 33


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(text: str | Column) -> Column:
    """Lower-case A-Z only (``lower`` would touch other alphabets too)."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def whole_text(text: str | Column) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def with_row(df: DataFrame, **columns: Column) -> DataFrame:
    """Only ``columns``, and ``row``: a number that is unique in the table.

    ``row`` identifies a row even when ids repeat or are null. It is a
    function of the partition and the position in it, so ``df`` must be a
    deterministic read (a stored table, or narrow steps over one).
    """
    return df.select(*[c.alias(k) for k, c in columns.items()], F.monotonically_increasing_id().alias("row"))


def stored(df: DataFrame) -> DataFrame:
    """Checkpointed in the shared folder: computed once, survives executors."""
    return cut_lineage(df)


def part(row: str = "row") -> Column:
    """The partition in which ``row`` was numbered."""
    return F.shiftright(F.col(row), PARTITION_SHIFT)


def fresh(df: DataFrame, name: str) -> str:
    """``name`` or a longer form of it that is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keep_rows(df: DataFrame, kept: DataFrame, **keys: Column) -> DataFrame:
    """One row of ``df`` for each row of ``kept``, with the columns of ``df``.

    ``keys`` says how the key columns of ``kept`` follow from a row of ``df``
    (nulls are equal); ``kept.rows`` is how many rows have that key, of which
    any one stays. Rows are known by what they hold, never by a number that a
    second scan would have to deal out again in the same way.
    """
    names = {k: fresh(df, f"_key_{k}") for k in keys}
    keyed = df.withColumns({names[k]: c for k, c in keys.items()})
    columns = [F.col(f"`{c}`") for c in df.columns]

    def of(some: DataFrame) -> DataFrame:
        right = some.select(*[F.col(k).alias(names[k] + "_r") for k in keys])
        same = [F.col(n).eqNullSafe(F.col(n + "_r")) for n in names.values()]
        return keyed.join(right, same, "left_semi")

    left = of(kept.where("rows = 1")).select(*columns)
    if not kept.where("rows > 1").take(1):
        return left
    one = of(kept.where("rows > 1")).groupBy(*names.values()).agg(F.first(F.struct(*columns)).alias("_row"))
    return left.union(one.select("_row.*"))


def numbered_within(rows: DataFrame, key: str, out: str, order: tuple[str, ...] = ("row",)) -> DataFrame:
    """Adds ``out``: 0, 1, 2, ... within ``key``, in the order of ``order``
    (``row`` first).

    ``rows`` is stored. A key may hold any share of all rows: rows are
    counted within (key, partition), and only those counts (one for each
    key and partition) are summed up over a whole key.
    """
    local = rows.withColumn("_part", part())
    counts = local.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(key, "_part").orderBy(*order)
    ranked = local.withColumn("_rank", F.row_number().over(within))
    return ranked.join(offsets, [key, "_part"]).withColumn(out, F.col("_before") + F.col("_rank") - 1).drop("_part", "_before", "_rank")
