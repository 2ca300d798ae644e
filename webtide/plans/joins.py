"""Join helpers: broadcast only behind a size check, or with a size that is
fixed beforehand (Bloom filters)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A side is broadcast only when it has at most this many rows (checked with
# a bounded count, never by collecting it).
BROADCAST_MAX_ROWS = 1_000_000


def has_at_most(df: DataFrame, n: int) -> bool:
    """True when ``df`` has ≤ n rows; reads at most n+1 rows."""
    return df.limit(n + 1).count() <= n


# --- Bloom filter in blocks ---------------------------------------------------------

# bits of a block, which is one bitmap of Spark's bitmap aggregates
BLOCK_BITS = 32768
BITS_PER_KEY = 12
HASHES = 5
# 64 MB of blocks: beyond 45 million keys more false positives, same result
MAX_BLOCKS = 16384


def _block(key: str, blocks: int) -> Column:
    return F.expr(f"cast(pmod(xxhash64(`{key}`), {blocks}) as int)")


def _bit(key: str, kind: str, i: int) -> str:
    return f"cast(pmod(xxhash64(`{key}`, {kind}, {i}), {BLOCK_BITS}) as int)"


class BloomFilter:
    """Which (key, kind) pairs may be in a table: a broadcast of blocks, as
    many as the counted keys need, each a bitmap of 4 KB. A key's block is
    chosen by its hash, and ``HASHES`` bits in it by hashes of key and kind.
    It has no false negatives; an exact join must follow."""

    def __init__(self, pairs: DataFrame, key: str, kind: str):
        n = pairs.where(F.col(key).isNotNull()).agg(F.approx_count_distinct(F.struct(key, kind))).first()[0]
        self.blocks = max(1, min(MAX_BLOCKS, -(-n * BITS_PER_KEY // BLOCK_BITS)))
        bits = F.expr("array(" + ", ".join(_bit(key, f"`{kind}`", i) for i in range(HASHES)) + ")")
        each = pairs.where(F.col(key).isNotNull()).select(_block(key, self.blocks).alias("_block"), F.explode(bits).alias("_bit"))
        self.table = each.groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("_bits"))

    def holds(self, key: str, kind: str) -> Column:
        """Whether the pair may be in the table; after ``meet``."""
        bits = [_bit(key, f"'{kind}'", i) for i in range(HASHES)]
        return F.expr(" and ".join(f"shiftright(cast(conv(hex(substring(_bits, cast({b} div 8 as int) + 1, 1)), 16, 10) as int), {b} % 8) % 2 = 1" for b in bits))

    def meet(self, df: DataFrame, key: str, kinds: dict[str, str]) -> DataFrame:
        """``df`` with a boolean column for each kind, without the rows that
        have none of them."""
        joined = df.withColumn("_block", _block(key, self.blocks)).join(F.broadcast(self.table), "_block")
        held = joined.select(*df.columns, *[self.holds(key, kind).alias(name) for name, kind in kinds.items()])
        some = F.lit(False)
        for name in kinds:
            some = some | F.col(name)
        return held.where(some)
