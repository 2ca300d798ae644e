"""Sinks (A4, A5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import url_parts


def articles_json(articles: DataFrame) -> DataFrame:
    """One JSON document per article; NULL fields are omitted (the wire
    shape of the response)."""
    cols = [c for c in articles.columns]
    return articles.select(
        "req_id", F.to_json(F.struct(*cols), {"ignoreNullFields": "true"}).alias("json")
    )


def write_articles(articles: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", buckets: int = 64) -> None:
    """Article rows in ``buckets`` folders by a hash of the host (hosts run
    to millions, folders must not): a host's rows are in one folder, which
    readers can prune by. Rows are rebalanced by bucket before they are
    written: Spark measures the bytes of each bucket, splits hot ones and
    puts small ones together (``spark.sql.adaptive.advisoryPartitionSizeInBytes``),
    so the files' sizes do not depend on how many tasks made the rows."""
    host = F.coalesce(url_parts(F.col("url"))["host"], F.lit("_invalid"))
    df = articles.withColumn("host", host).withColumn("bucket", F.pmod(F.xxhash64("host"), F.lit(buckets)).cast("int"))
    if fmt == "json":
        articles_json(df).write.mode(mode).json(path)
    else:
        df.hint("rebalance", "bucket").write.mode(mode).partitionBy("bucket").format(fmt).save(path)


def write_outcomes(outcomes: DataFrame, ok_path: str, err_path: str, mode: str = "overwrite",
                   outcome_col: str = "outcome") -> None:
    """Successes and errors to two sinks from one plan: the outcome rows are
    checkpointed once (reliable, shared folder), then two filtered writes
    read the checkpoint instead of recomputing the plan."""
    from ..session import cut_lineage

    done = cut_lineage(outcomes)
    done.where(F.col(outcome_col) == "success").write.mode(mode).parquet(ok_path)
    done.where(F.col(outcome_col) != "success").write.mode(mode).parquet(err_path)
