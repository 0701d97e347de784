"""Keyed state on a shared store, kept by deltas, with summaries by signed deltas.

A row key belongs to a record, a record to a bucket.  A micro-batch writes the
rows it changed, as one version, and reads only the buckets and records it
touches.  A summary is a table of cells with counts: what the touched records
contributed before is taken away, what they contribute now is added, so it is
never computed anew from all rows.

Version N is what batch N changed.  It is worked out from versions below N and
written over whole, so a batch that is replayed after a lost driver gives the
same version.  ``compact`` folds all versions but the newest (which may still be
replayed); a running stream goes on from the folded version in its next batch.
Versions that were folded are not read again and may be removed.

Inputs and cases: of events of one key that with the highest order counts,
however late it comes; an event that repeats the order of the row held changes
nothing; null keys are keys; an empty batch writes an empty version.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.ranking import keep_one

#: From the touched records' ids and their rows to cells ``(..., n)``.
Contributions = Callable[[DataFrame, DataFrame], DataFrame]
_END = 2**31 - 1


@dataclass(frozen=True)
class KeyedState:
    """``rows``: DDL of a row; ``cells``: DDL of a cell without its count ``n``; ``start``: cells before any event."""

    path: str
    rows: str
    keys: Sequence[str]
    order: Sequence[str]
    record: str = "record_id"
    buckets: int = 64
    cells: str = ""
    contributions: Contributions | None = None

    def open(self, spark: SparkSession, start: DataFrame | None = None) -> "KeyedState":
        """Create the folders where there are none."""
        for name, ddl, parts in (("rows", f"{self.rows}, version int, bucket int", ["version", "bucket"]), ("cells", self._cell_row("version int"), ["version"])):
            empty = spark.createDataFrame([], ddl)
            for folder in (name, f"{name}-folded"):
                empty.write.mode("ignore").partitionBy(*parts).parquet(f"{self.path}/{folder}")
        if start is not None:
            self._write(start.select(*self._cell_names(), "n"), "cells", -1)
        spark.createDataFrame([(-2,)], "version int").write.mode("ignore").parquet(f"{self.path}/marks")
        return self

    def _cell_row(self, more: str) -> str:
        return ", ".join(x for x in (self.cells, "n bigint", more) if x)

    def _cell_names(self) -> list[str]:
        return [f.name for f in StructType.fromDDL(self.cells).fields] if self.cells else []

    def _row_names(self) -> list[str]:
        return [f.name for f in StructType.fromDDL(self.rows).fields]

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.record), F.lit(self.buckets)).cast("int")

    def _write(self, df: DataFrame, folder: str, version: int, *parts: str) -> None:
        df.write.mode("overwrite").partitionBy(*parts).parquet(f"{self.path}/{folder}/version={version}")

    def _read(self, spark: SparkSession, name: str, ddl: str, before: int) -> DataFrame:
        """All that is known of versions below ``before``: the last folded one and those after it."""
        marks = spark.read.schema("version int").parquet(f"{self.path}/marks")
        folded = marks.where(F.col("version") < before).agg(F.max("version")).first()[0]
        whole = spark.read.schema(ddl).parquet(f"{self.path}/{name}-folded").where(F.col("version") == folded)
        later = spark.read.schema(ddl).parquet(f"{self.path}/{name}").where((F.col("version") > folded) & (F.col("version") < before))
        return whole.unionByName(later)

    def versions(self, spark: SparkSession, before: int = _END) -> DataFrame:
        return self._read(spark, "rows", f"{self.rows}, version int, bucket int", before)

    def current(self, spark: SparkSession, before: int = _END) -> DataFrame:
        """The newest row of every key."""
        order = [F.col(c) for c in (*self.order, "version")]
        return keep_one(self.versions(spark, before), list(self.keys), order, last=True).drop("version", "bucket")

    def summary(self, spark: SparkSession, before: int = _END) -> DataFrame:
        """The cells with their counts, without those that count nothing."""
        cells = self._read(spark, "cells", self._cell_row("version int"), before)
        return cells.groupBy(*self._cell_names()).agg(F.sum("n").alias("n")).where("n <> 0")

    def apply(self, events: DataFrame, version: int) -> None:
        """Take in one batch of events (columns of ``rows``)."""
        spark, names = events.sparkSession, self._row_names()
        newest = keep_one(events.select(*names), list(self.keys), [F.col(c) for c in self.order], last=True)
        self._write(newest.withColumn("bucket", self._bucket()), "incoming", version)
        newest = spark.read.parquet(f"{self.path}/incoming/version={version}")
        touched = [r["bucket"] for r in newest.select("bucket").distinct().collect()]  # at most one row a bucket
        ids = newest.select(self.record).distinct()
        held = self.versions(spark, version).where(F.col("bucket").isin(touched))
        prior = held.join(ids.withColumnRenamed(self.record, "__id"), F.col(self.record).eqNullSafe(F.col("__id")), "left_semi")
        both = prior.select(*names, "bucket", "version", F.lit(False).alias("fresh")).unionByName(
            newest.select(*names, "bucket", F.lit(version).alias("version"), F.lit(True).alias("fresh")))
        rest = [n for n in names if n not in self.keys]
        row, order = F.struct(*rest), [F.col(c) for c in self.order]
        # of equal places in the order the row held stays
        pairs = both.groupBy("bucket", *self.keys).agg(
            F.max_by(row, F.when(~F.col("fresh"), F.struct(*order, "version"))).alias("old"),
            F.max_by(F.struct(row.alias("row"), "fresh"), F.struct(*order, (~F.col("fresh")).alias("held"), F.col("version"))).alias("now"))
        self._write(pairs, "changes", version)
        pairs = spark.read.parquet(f"{self.path}/changes/version={version}")
        self._write(pairs.where("now.fresh").select(*self.keys, "now.row.*", "bucket").select(*names, "bucket"), "rows", version, "bucket")
        if self.contributions is None:
            return
        before = self.contributions(ids, pairs.where("old IS NOT NULL").select(*self.keys, "old.*"))
        after = self.contributions(ids, pairs.select(*self.keys, "now.row.*"))
        signed = before.withColumn("n", -F.col("n")).unionByName(after)
        delta = signed.groupBy(*self._cell_names()).agg(F.sum("n").alias("n")).where("n <> 0")
        self._write(delta.select(*self._cell_names(), "n"), "cells", version)

    def compact(self, spark: SparkSession) -> int | None:
        """Fold every version below the newest that holds events; returns the folded version."""
        newest = spark.read.schema("bucket int, version int").parquet(f"{self.path}/changes").agg(F.max("version")).first()[0]
        if newest is None or newest < 1:
            return None
        rows = self.current(spark, newest).withColumn("bucket", self._bucket())
        self._write(rows, "rows-folded", newest - 1, "bucket")
        self._write(self.summary(spark, newest), "cells-folded", newest - 1)
        spark.createDataFrame([(newest - 1,)], "version int").write.mode("append").parquet(f"{self.path}/marks")
        return newest - 1
