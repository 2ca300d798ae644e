"""Byte-limited chunk streams and their reassembly.

The limiter sums in blocks: chunks within (object, block of the sequence),
then one row per block over the object, so an object with any share of all
chunks is spread over many tasks. It drops every chunk after the one that
overflows, so an assembled object never exceeds the byte cap: the per-object
group of the reassembly is bounded by the cap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS

TOO_LARGE = "Response too large"


def chunk_limit(chunks: DataFrame, cap: int = DEFAULTS.max_response_bytes, obj: str = "object_id",
                seq: str = "seq", data: str = "data", block: int = 1024) -> DataFrame:
    """Per chunk: byte length, running byte total of its object and whether
    it is emitted (running total ≤ cap; the overflowing chunk and all later
    ones are not). ``data`` may be BINARY or STRING (UTF-8 bytes); ``seq`` is
    a number. ``block`` sequence numbers are summed together."""
    sized = chunks.withColumn("n_bytes", F.octet_length(F.col(data)).cast("bigint")).withColumn("_block", F.floor(F.col(seq) / F.lit(block)))
    totals = sized.groupBy(F.col(obj).alias("_obj"), F.col("_block").alias("_of")).agg(F.sum("n_bytes").alias("_bytes"))
    earlier = Window.partitionBy("_obj").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_obj", "_of", F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy(obj, "_block").orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = sized.withColumn("_within", F.sum("n_bytes").over(within))
    j = inner.join(before, F.col(obj).eqNullSafe(F.col("_obj")) & F.col("_block").eqNullSafe(F.col("_of")))
    running = (F.col("_before") + F.coalesce("_within", F.lit(0))).cast("bigint")
    return j.withColumn("running_bytes", running).withColumn("emitted", F.col("running_bytes") <= F.lit(int(cap))).select(*chunks.columns, "n_bytes", "running_bytes", "emitted")


def object_status(chunks: DataFrame, cap: int = DEFAULTS.max_response_bytes, obj: str = "object_id", data: str = "data") -> DataFrame:
    """Per object: its bytes, and 'Response too large' when they exceed the
    cap. A sum with map-side combine; the order of chunks does not matter."""
    total = chunks.groupBy(obj).agg(F.sum(F.octet_length(F.col(data))).cast("bigint").alias("total_bytes"))
    return total.withColumn("error_message", F.when(F.col("total_bytes") > F.lit(int(cap)), F.lit(TOO_LARGE)))


def assemble_chunks(chunks: DataFrame, obj: str = "object_id", seq: str = "seq", data: str = "data") -> DataFrame:
    """Concatenate bytes in order, then decode UTF-8 (malformed → U+FFFD, so
    a character split across chunks survives), drop a leading BOM."""
    b = F.col(data).cast("binary")
    g = chunks.select(obj, seq, b.alias("_b")).groupBy(obj).agg(
        F.expr(f"listagg(_b) within group (order by {seq})").alias("_all"),
        F.count(F.lit(1)).alias("n_chunks"),
    )
    text = F.regexp_replace(F.make_valid_utf8(F.col("_all").cast("string")), r"^\x{FEFF}", "")
    return g.select(obj, "n_chunks", F.octet_length("_all").cast("bigint").alias("n_bytes"), text.alias("text"))
