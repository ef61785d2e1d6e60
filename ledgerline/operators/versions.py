"""Versions of a table of sheets, as plain Parquet partitions.

``folder/version=V/bucket=B``: a bucket holds the sheets of one hash.  A version
writes the buckets it touches and no others, by dynamic partition overwrite, so
an update that is run again replaces what it had written; what it doesn't touch
is read from the version that wrote it last.  Which version that is for each
bucket is a list of at most ``buckets`` numbers, and becomes the scan's
partition filter.

An update names the digest of the table it was drafted on: number of cells and
two order-free sums over their hashes.  If the table has changed since, nothing
is written.  After writing, the new cells are read back and compared.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import changes as C
from ledgerline.sources.io import written


class ChangedTarget(ValueError):
    """The table isn't what the update was drafted on."""


class NotWritten(RuntimeError):
    """What was read back isn't what was to be written."""


def digest(cells: DataFrame) -> str:
    """Of ``cells (sheet, cell, value)``, whatever their order and partitions."""
    h = lambda seed: F.xxhash64(F.lit(seed), "sheet", "cell", F.col("value").isNull(), "value")
    row = cells.agg(F.count("*").alias("n"), F.bit_xor(h(1)).alias("x"), F.sum(F.pmod(h(2), F.lit(1 << 31)).cast("decimal(38,0)")).alias("s")).first()
    return f"{row['n']}-{(row['x'] or 0) & ((1 << 64) - 1):016x}-{row['s'] or 0}"


@dataclass(frozen=True)
class VersionedSheets:
    spark: SparkSession
    folder: str
    buckets: int = 64

    _SCHEMA = "sheet string, cell string, value string, version int, bucket int"

    def _all(self) -> DataFrame:
        return self.spark.read.schema(self._SCHEMA).parquet(self.folder)

    def _bucket(self):
        return F.pmod(F.xxhash64("sheet"), F.lit(self.buckets)).cast("int")

    def _owners(self, version: int | None = None) -> dict[int, int]:
        """bucket -> the version that wrote it last; from partition names alone, at most ``buckets`` entries."""
        rows = self._all() if version is None else self._all().where(F.col("version") <= version)
        return {r["bucket"]: r["v"] for r in rows.groupBy("bucket").agg(F.max("version").alias("v")).collect()}

    def last(self) -> int:
        return max(self._owners().values(), default=0)

    def read(self, version: int | None = None, touched: list[int] | None = None) -> DataFrame:
        """(sheet, cell, value) as of a version (the last), of all buckets or of those ``touched``."""
        when = F.lit(False)
        for bucket, owner in sorted(self._owners(version).items()):
            if touched is None or bucket in touched:
                when = when | ((F.col("version") == owner) & (F.col("bucket") == bucket))
        return self._all().where(when).select("sheet", "cell", "value")

    def _write(self, cells: DataFrame, version: int) -> None:
        rows = cells.select("sheet", "cell", "value", F.lit(version).alias("version"), self._bucket().alias("bucket"))
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version", "bucket").parquet(self.folder)

    def create(self, cells: DataFrame) -> int:
        self._write(cells, 1)
        return 1

    def apply(self, ops: DataFrame, drafted_on: str) -> int:
        """Applies ready change sets (:func:`changes.apply_ops`) as a new version, and returns its number.

        ``drafted_on`` is the :func:`digest` of the whole table at drafting.
        Change sets are taken or refused as a whole, so all buckets that any
        operation names are read.
        """
        now = self.read()
        if digest(now) != drafted_on:
            raise ChangedTarget("the table has changed since the update was drafted")
        ops = written(ops, "ops")
        touched = [r["b"] for r in ops.select(self._bucket().alias("b")).distinct().collect()]  # at most ``buckets``
        if not touched:
            return self.last()
        old = self.read(touched=touched)
        new = written(C.apply_ops(old, ops), "next")
        changed = new.join(old.withColumnRenamed("value", "was").hint("shuffle_merge"), ["sheet", "cell"]).where(~F.col("value").eqNullSafe(F.col("was")))
        real = [r["b"] for r in changed.select(self._bucket().alias("b")).distinct().collect()]
        version = self.last() + 1
        if not real:
            return version - 1
        rows = new.withColumn("b", self._bucket()).where(F.col("b").isin(real)).drop("b")
        self._write(rows, version)
        if digest(self.read(version, real)) != digest(rows):
            raise NotWritten(f"version {version} isn't what was to be written")
        return version

    def restore(self, version: int) -> int:
        """Makes the table again what it was at ``version``, as a new version; only buckets written since are copied."""
        then, now = self._owners(version), self._owners()
        since = [b for b, owner in now.items() if then.get(b) != owner]
        last = max(now.values(), default=0)
        if not since:
            return last
        self._write(written(self.read(version, since), "old"), last + 1)
        if digest(self.read()) != digest(self.read(version)):
            raise NotWritten(f"version {last + 1} isn't version {version}")
        return last + 1
