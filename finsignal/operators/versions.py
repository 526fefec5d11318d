"""Tables of Parquet partitions that are updated partition by partition.

A folder holds `data/v=<n>/<by>=<value>/` and, for each version, a list `versions/n=<n>` of which version wrote each
partition. Readers follow the newest list that is whole. An update writes the partitions it touches under a new number, then
the list; a run that fails before that leaves readers where they were, and its number is taken again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import exists
from .upsert import fill_null_upsert


@dataclass(frozen=True)
class PartitionedTable:
    """schema: all columns, `by` (date, string or integer) among them. One writer at a time; null `by` is not allowed."""

    spark: SparkSession
    folder: str
    schema: StructType
    by: str

    def _newest(self) -> int | None:
        """The newest version whose list is whole."""
        if not exists(self.spark, f"{self.folder}/versions"):
            return None
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/versions")
        store = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [str(s.getPath().getName()) for s in store.listStatus(place)]
        whole = [int(n.removeprefix("n=")) for n in found if n.startswith("n=") and exists(self.spark, f"{self.folder}/versions/{n}/_SUCCESS")]
        return max(whole, default=None)

    def _lists(self, version: int | None) -> dict[str, int]:
        """Partition -> the version that wrote it: a row a partition, as any reader of a partitioned table lists them."""
        if version is None:
            return {}
        rows = self.spark.read.schema("partition string, version long").parquet(f"{self.folder}/versions/n={version}").collect()
        return {r["partition"]: r["version"] for r in rows}

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version (default: the newest). Filters and joins on `by` open only the partitions they need."""
        lists = self._lists(self._newest() if version is None else version)
        if not lists:
            return self.spark.createDataFrame([], self.schema)
        names = [f for f in self.schema.fields if f.name != self.by]
        kind = self.schema[self.by].dataType.simpleString()
        reader = self.spark.read.schema(StructType(names).add("v", "long").add(self.by, kind)).option("basePath", f"{self.folder}/data")
        return reader.parquet(*[f"{self.folder}/data/v={v}/{self.by}={p}" for p, v in sorted(lists.items())]).select(*self.schema.names)

    def replace(self, rows: DataFrame) -> int:
        """Write the partitions that `rows` has, whole, and point to them; others stay as they are. The new version."""
        before = self._newest()
        version = 0 if before is None else before + 1
        held = rows.select(*self.schema.names)
        held.write.mode("overwrite").partitionBy(self.by).parquet(f"{self.folder}/data/v={version}")
        written = self.spark.read.option("basePath", f"{self.folder}/data").parquet(f"{self.folder}/data/v={version}") if not held.isEmpty() else None
        touched = {} if written is None else {str(r[0]): version for r in written.select(F.col(self.by).cast("string")).distinct().collect()}
        if None in touched or "None" in touched:
            raise ValueError(f"a row without {self.by}")
        lists = self._lists(before) | touched
        rows_of = self.spark.createDataFrame(list(lists.items()), "partition string, version long")
        rows_of.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/versions/n={version}")
        return version

    def upsert(self, incoming: DataFrame, keys: list[str], columns: list[str], order: list[Column] | None = None) -> int:
        """fill_null_upsert of the partitions that `incoming` has rows for: only these are read and written. `by` is one of
        the keys, so no row moves between partitions."""
        if self.by not in keys:
            raise ValueError(f"{self.by} must be one of the keys")
        touched = [r[0] for r in incoming.select(self.by).where(F.col(self.by).isNotNull()).distinct().collect()]  # partitions of one update
        stored = self.read().where(F.col(self.by).isin(touched)) if touched else self.read().limit(0)
        return self.replace(fill_null_upsert(stored, incoming, keys, columns, order).select(*self.schema.names))

