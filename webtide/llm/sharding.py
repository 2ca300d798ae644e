"""Sharding by jump consistent hashing.

Lamping and Veach, "A Fast, Minimal Memory, Consistent Hash Algorithm"
(2014). The shard of a row follows from its key and the number of shards
alone; no ring table is kept. When a shard is appended, one row in
``shards + 1`` moves, and only into the new shard.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered_within, stored, whole_text, with_row

#: The multiplier of the generator in the paper.
MULTIPLIER = 2862933555777941757


def jump_hash(keys, shards: int):
    """Shards (0 to ``shards`` - 1) of an array of 64-bit keys, by numpy."""
    import numpy as np

    state = np.asarray(keys).astype(np.int64).view(np.uint64).copy()
    shard = np.zeros(len(state), np.int64)
    going = np.arange(len(state))
    following = np.zeros(len(state), np.int64)
    while len(going):
        shard[going] = following
        state[going] = state[going] * np.uint64(MULTIPLIER) + np.uint64(1)
        draw = ((state[going] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        following = ((shard[going] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        still = following < shards
        going, following = going[still], following[still]
    return shard.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a key column of any type. A null key hashes like any
    other value, so rows without a key go to one shard."""

    @F.pandas_udf("int")
    def jump(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(), shards))

    return jump(F.xxhash64(key))


def shard_rows(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, size, text_crc32, law, shard, slot, grown_shard for every row.

    The law is ``key``: id and number of shards decide. ``grown_shard`` is
    the shard with one shard more. ``slot`` numbers the rows of a shard from
    0 without gaps, in the order of the table. Size is 8 plus the UTF-8
    bytes of the text; a null text has none, and the checksum of no bytes.
    Rows that repeat an id share its shard and have slots of their own;
    null ids share one shard; an empty table gives none.
    """
    text = whole_text(text_col)
    rows = stored(
        with_row(docs, id=F.col(id_col), size=F.octet_length(text).cast("long") + 8, text_crc32=F.crc32(F.encode(text, "UTF-8"))).select(
            "*", shard_of(F.col("id"), shards).alias("shard"), shard_of(F.col("id"), shards + 1).alias("grown_shard")
        )
    )
    return numbered_within(rows, "shard", "slot").select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
