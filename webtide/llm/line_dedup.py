"""Line dedup on levelled sorted runs of line hashes.

Only DataFrame functions. A run is a stored table (key, docs) sorted by key:
how many documents of its batches hold the line. Each new batch is merged
against the run of lines already known to be frequent (anti-join: they need
no more counting) and added as a run of level 0. When a level has ``fanout``
runs they are compacted: merged, added up, and stored as one run of the next
level; lines that reach ``min_docs`` on the way move to the frequent run. At
the end all levels are merged once. Runs hold hashes, never text.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path
from .common import ascii_lower, stored, whole_text

#: Stripped at both ends of a line: space and the controls 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


class LineRuns:
    """Levelled runs in a folder below the shared checkpoint folder."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 4):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.folder = shared_path(spark, f"line-runs-{uuid.uuid4().hex}")
        self.levels: dict[int, list[str]] = defaultdict(list)
        self.known: list[str] = []
        self.made = 0

    def _path(self, kind: str) -> str:
        self.made += 1
        return f"{self.folder}/{kind}-{self.made:05d}"

    def _read(self, paths: list[str]) -> DataFrame:
        return reduce(DataFrame.union, [self.spark.read.parquet(p) for p in paths])

    def _write(self, counts: DataFrame, level: int) -> None:
        path = self._path(f"level-{level}")
        counts.repartitionByRange("key").sortWithinPartitions("key").write.parquet(path)
        self.levels[level].append(path)

    def _unknown(self, counts: DataFrame) -> DataFrame:
        if not self.known:
            return counts
        return counts.join(self._read(self.known).hint("merge"), "key", "left_anti")

    def add(self, counts: DataFrame) -> None:
        """One batch: (key, docs), each key once."""
        self._write(self._unknown(counts), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._compact(level)
            level += 1

    def _compact(self, level: int) -> None:
        merged = stored(self._unknown(self._read(self.levels.pop(level)).groupBy("key").agg(F.sum("docs").alias("docs"))))
        path = self._path("frequent")
        merged.where(F.col("docs") >= self.min_docs).select("key").repartitionByRange("key").sortWithinPartitions("key").write.parquet(path)
        self.known.append(path)
        self._write(merged.where(F.col("docs") < self.min_docs), level + 1)

    def frequent(self) -> DataFrame:
        """Keys that are in at least ``min_docs`` documents, each once."""
        runs = [p for level in self.levels.values() for p in level]
        rest = self._unknown(self._read(runs).groupBy("key").agg(F.sum("docs").alias("docs"))).where(F.col("docs") >= self.min_docs).select("key")
        return rest.union(self._read(self.known)) if self.known else rest

    def delete(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def frequent_lines(rows: DataFrame, min_docs: int, min_chars: int, batches: int, fanout: int) -> DataFrame:
    """``rows`` has id, h, lines. Keys (MD5 of the line's key, 16 bytes) of
    lines in at least ``min_docs`` rows; a line counts once for each row."""
    spark = rows.sparkSession
    keys = F.array_distinct(F.transform(F.filter(F.transform("lines", line_key), lambda k: F.char_length(k) >= min_chars), lambda k: F.md5(k)))
    # the documents come in batches; one pass counts all batches' lines
    counted = rows.select(F.pmod(F.xxhash64("id", "h"), F.lit(batches)).cast("int").alias("batch"), F.explode(keys).alias("key")).groupBy("batch", "key").agg(F.count(F.lit(1)).alias("docs"))
    runs = LineRuns(spark, min_docs, fanout)
    path = f"{runs.folder}/batches"
    counted.select("batch", F.unhex("key").alias("key"), "docs").write.partitionBy("batch").parquet(path)
    arrived = spark.read.schema("key binary, docs long, batch int").parquet(path)
    for batch in range(batches):
        runs.add(arrived.where(F.col("batch") == batch).select("key", "docs"))
    found = stored(runs.frequent())
    runs.delete()
    return found


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, batches: int = 16, fanout: int = 4) -> DataFrame:
    """Id, n_lines, n_dropped, text (the other lines, joined by newlines).

    A line is compared by its key: blanks stripped at both ends, A-Z in lower
    case. A key of at least ``min_chars`` code points that is in at least
    ``min_docs`` rows loses all its lines, in every row. A null or empty text
    is one empty line, which stays. Texts may have any number of lines, and a
    line may be in any share of all rows: rows are counted with map-side
    combine, and only row and place of a line meet the frequent keys. Repeated
    rows count as documents of their own. An empty table gives none.
    """
    # rows are known by id and text: those that share both lose the same lines
    rows = docs.select(F.col(id_col).alias("id"), F.split(whole_text(text_col), "\n").alias("lines"), F.xxhash64(whole_text(text_col)).alias("h"))
    found = frequent_lines(rows, min_docs, min_chars, batches, fanout)
    at = rows.select("id", "h", F.posexplode(F.transform("lines", lambda x: F.md5(line_key(x)))).alias("at", "key"))
    dropped = at.select("id", "h", "at", F.unhex("key").alias("key")).join(found, "key").groupBy("id", "h").agg(F.collect_set("at").alias("dropped"))
    same = F.col("r.id").eqNullSafe(F.col("d.id")) & (F.col("r.h") == F.col("d.h"))
    both = rows.alias("r").join(dropped.alias("d"), same, "left").select("r.id", "lines", "dropped")
    n = F.size("lines")
    kept = F.array_except(F.sequence(F.lit(0), n - 1), F.coalesce("dropped", F.array().cast("array<int>")))
    return both.select(
        F.col("id").alias(id_col),
        n.cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n").alias("text"),
    )
