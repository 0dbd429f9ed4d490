"""[SNK-*] Tables that take upserts: new rows are added and the newest are found when the table is read, or partitions are replaced."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _fields(schema: StructType | str) -> StructType:
    return StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


class MergedTable:
    """[SNK-3, UPS-1, UPS-2, UPS-3] A table below ``path`` to which batches only add rows; a read gives the newest rows of each key.

    Rows are partitioned by ``by`` and bucketed by ``key``. All rows of a key that a batch adds replace those that it had, whatever their
    number; none, by a row whose other columns are null (``forget``). As all rows of a key are in one bucket, the newest are found
    without a shuffle, and a join on ``key`` moves the other side only. A batch adds the rows of a key in one file, so a reader sees all
    of them or none, and nothing is overwritten: a batch that dies, at any step, leaves what was there, and when it is run again
    its rows are newer than those it left. One writer a table.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, by: str, key: str, buckets: int = 8):
        self.spark, self.path, self.by, self.key, self.buckets = spark, path.rstrip("/"), by, key, buckets
        self.schema = _fields(schema)
        self.name = f"merged_{hashlib.md5(self.path.encode()).hexdigest()}"
        stored = [f for f in self.schema if f.name != by]
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*stored, self.schema[by]])
        declared = columns.replace(f", `{by}`", f", `_version` bigint, `_gone` boolean, `{by}`")
        if not self.spark.catalog.tableExists(self.name):
            # declared again in each session; its rows are the files below its path
            fs, p = _file_system(self.spark, self.path)
            fs.mkdirs(p)
            self.spark.sql(f"CREATE TABLE {self.name} ({declared}) USING parquet PARTITIONED BY (`{by}`) CLUSTERED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{self.path}'")
            self.spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")

    def _rows(self, met: Sequence | None) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        rows = self.spark.table(self.name)
        return rows if met is None else rows.where(F.col(self.by).isin(*met) if len(met) else F.lit(False))

    def read(self, met: Sequence | None = None, until: DataFrame | None = None) -> DataFrame:
        """The newest rows of each key, of the partitions ``met`` alone where given: others are not listed. ``until`` (``by``, version) leaves
        out what is newer than its partition's version there, and partitions that it lacks."""
        rows = self._rows(met)
        if until is not None:
            rows = rows.join(until.select(self.by, F.col("version").alias("_until")), self.by).where("_version <= _until")
        state = F.struct("_version", "_gone")
        newest = F.max(state).over(W.partitionBy(self.key))
        return rows.withColumn("_newest", newest).where((F.col("_newest") == state) & ~F.col("_gone")).select(*self.schema.fieldNames())

    def versions(self, met: Sequence | None = None) -> DataFrame:
        """(``by``, version): the newest version in each partition."""
        return self._rows(met).groupBy(self.by).agg(F.max("_version").alias("version"))

    def newest(self, met: Sequence | None = None) -> int:
        """The version of the newest rows; 0 without any."""
        return self._rows(met).agg(F.max("_version")).first()[0] or 0

    def next_version(self, met: Sequence | None = None) -> int:
        """A version for a new batch: the time in microseconds, or more where clocks differ."""
        return max(time.time_ns() // 1000, self.newest(met) + 1)

    def add(self, rows: DataFrame, version: int, forget: DataFrame | None = None) -> None:
        """Adds a batch: its rows replace those of their keys. ``forget`` (``by``, ``key``): keys that have no rows from now on."""
        names = [n for n in self.schema.fieldNames() if n not in (self.by, self.key)]
        new = rows.select(self.by, self.key, *names, F.lit(False).alias("_gone"))
        if forget is not None:
            nothing = [F.lit(None).cast(self.schema[n].dataType).alias(n) for n in names]
            new = new.unionByName(forget.select(self.by, self.key, *nothing, F.lit(True).alias("_gone")).distinct())
        stored = self.spark.table(self.name).columns
        whole = new.withColumn("_version", F.lit(version).cast("long")).select(*stored)
        # rows of a bucket are made by one task, so that it writes one file of it to a partition
        whole.repartition(self.buckets, self.key).write.mode("append").insertInto(self.name)

    def drop(self, partitions: Sequence) -> None:
        """[DEL-1, DEL-3] Deletes partitions with all versions of their rows."""
        for v in partitions:
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (`{self.by}` = :v)", {"v": v})
        drop_folders(self.spark, self.path, [{self.by: v} for v in partitions])

    def compact(self, partitions: Sequence) -> None:
        """Puts the newest rows of partitions, a request's worth, into new files, and then deletes those that were there. A compaction that
        dies between leaves rows twice with the same version: ``add`` them to a later one, or compact again."""
        version = self.next_version(partitions)
        old = [f for f in self._rows(partitions).inputFiles()]
        self.add(self.read(partitions), version)
        for f in old:
            fs, p = _file_system(self.spark, f)
            fs.delete(p, False)
        self.spark.catalog.refreshTable(self.name)


class KeptSums:
    """[AGG-1, UPS-3] Numbers of rows and sums of ``values`` for each partition of a table, kept with its batches: the new rows of a batch count
    for, and the rows that they replace count against what was kept, and no other row is read again.

    Sums are added before the rows that they are of. Sums that are newer than their partition's rows belong to a batch that did not come to
    its end; they are not read, and so don't count twice when it is run again.
    """

    def __init__(self, rows: MergedTable, path: str, values: Sequence[str]):
        self.rows, self.values, by = rows, list(values), rows.by
        sums = ", ".join(f"{v} long" for v in values)
        self.kept = MergedTable(rows.spark, path, f"{by} {rows.schema[by].dataType.simpleString()}, of string, n long, {sums}", by, "of", 1)

    def add(self, new: DataFrame, met: Sequence, version: int, forget: DataFrame | None = None) -> None:
        """To be called before ``rows.add(new, version, forget)``; ``met`` are the partitions of ``new`` and ``forget``."""
        by, key = self.rows.by, self.rows.key
        keys = new.select(key) if forget is None else new.select(key).union(forget.select(key))
        before = self.rows.read(met).join(keys.distinct(), key, "left_semi")

        def signed(df: DataFrame, sign: int) -> DataFrame:
            return df.groupBy(by).agg((sign * F.count(F.lit(1))).alias("n"), *((sign * F.sum(F.coalesce(v, F.lit(0)).cast("long"))).alias(v) for v in self.values))

        parts = signed(new, 1).unionByName(signed(before, -1)).unionByName(self.read(met))
        now = parts.groupBy(by).agg(*(F.sum(c).alias(c) for c in ("n", *self.values)))
        self.kept.add(now.withColumn("of", F.col(by).cast("string")), version)

    def read(self, met: Sequence | None = None) -> DataFrame:
        """(``by``, n, values): what was kept, of the partitions ``met`` alone where given."""
        return self.kept.read(met, self.rows.versions(met)).select(self.rows.by, "n", *self.values)


def drop_folders(spark: SparkSession, path: str, keys: Sequence[dict]) -> None:
    """Deletes the folders of partitions, a request's worth of them."""
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for key in keys:
        inside = "/".join(f"{c}={'__HIVE_DEFAULT_PARTITION__' if v is None else escape(str(v))}" for c, v in key.items())
        fs, p = _file_system(spark, f"{path}/{inside}")
        fs.delete(p, True)


class PartitionedTable:
    """[SNK-3, SNK-4, DEL-3] A table below ``path`` whose partitions are replaced one by one, with Parquet's bloom filters on ``lookup``
    columns. Batches have to be repeatable: one that dies while its partitions are moved into place leaves some old and some new, and
    is run again. Rows that were read from the table itself are not safe in it; see ``MergedTable``.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, by: Sequence[str], lookup: Sequence[str] = ()):
        self.spark, self.path, self.by, self.lookup, self.schema = spark, path.rstrip("/"), tuple(by), tuple(lookup), _fields(schema)

    def read(self) -> DataFrame:
        fs, p = _file_system(self.spark, f"{self.path}/data")
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/data") if fs.exists(p) else self.spark.createDataFrame([], self.schema)

    def replace_partitions(self, df: DataFrame, met: DataFrame) -> None:
        """The partitions of ``met`` (the columns of ``by``) hold the rows of ``df`` from now on, and no others. ``df`` has no rows
        of other partitions; those that get none are dropped."""
        writer = df.select(*self.schema.fieldNames()).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        for c in self.lookup:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        # known before the write, which deletes what ``df`` may be made from
        left = met.select(*self.by).distinct().join(df.select(*self.by).distinct(), list(self.by), "left_anti").persist()
        try:
            left.count()
            writer.partitionBy(*self.by).parquet(f"{self.path}/data")
            self.drop_partitions(left)
        finally:
            left.unpersist()

    def append(self, df: DataFrame) -> None:
        """Adds rows; the table may hold rows twice where a batch was run again."""
        df.select(*self.schema.fieldNames()).write.mode("append").partitionBy(*self.by).parquet(f"{self.path}/data")

    def drop_partitions(self, keys: DataFrame) -> None:
        """Deletes the partitions of ``keys``, a request's worth of them."""
        drop_folders(self.spark, f"{self.path}/data", [{c: row[c] for c in self.by} for row in keys.select(*self.by).distinct().toLocalIterator()])


def file_key(repo: Column, path: Column) -> Column:
    """One value for a repository and a path in it; different pairs have different values."""
    return F.concat(F.length(repo).cast("string"), F.lit(":"), repo, path)


def append(df: DataFrame, path: str) -> None:
    """[SNK-1, SNK-5] Appends rows: messages, question history."""
    df.write.mode("append").parquet(path)
