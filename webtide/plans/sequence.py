"""Row numbers within a key that may hold any share of all rows.

``row_number() over (partition by key order by …)`` sends every row of a
key to one task. Here rows are numbered within (key, bucket), where the
bucket never falls along the order, such as the day of a time stamp. A
row's number is its number in the bucket plus the rows of its key in
earlier buckets; those come from the counts, one row for each key and
bucket. Nothing is sampled or stored, so a rerun gives the same plan and
the same numbers. Null keys, buckets and order values are values like any
other (nulls first).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_number_by_key(df: DataFrame, key: str, order: list[str], bucket: Column, out: str = "rn") -> DataFrame:
    """Adds ``out`` (BIGINT): row_number() within ``key``, 1-based. ``order``
    must make the order total (end with a unique id), and ``bucket`` must not
    fall along it."""
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col(key).alias("_key"), F.col("_bucket").alias("_of"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    within = Window.partitionBy(key, "_bucket").orderBy(*order)
    numbered = rows.withColumn("_rank", F.row_number().over(within))
    same = F.col(key).eqNullSafe(F.col("_key")) & F.col("_bucket").eqNullSafe(F.col("_of"))
    return numbered.join(offsets, same).withColumn(out, F.col("_before") + F.col("_rank")).drop(
        "_bucket", "_key", "_of", "_before", "_rank"
    )
