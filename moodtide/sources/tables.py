"""Parquet tables on shared storage.

Three ways to write, by how much of a table a batch touches:

* ``append`` for the stage tables (cleaned, scored): the batch alone is written, below its own
  batch directory, so replaying a batch replaces it instead of adding it twice.
* ``merge`` for posts and their sentiment: only the partitions that hold a matching key or
  receive a new row are rewritten, and key filters say which may hold one. Posts lie by the day they landed, sentiment by id range,
  both of which a row never leaves and new rows share.
* ``replace`` for tables rebuilt as a whole (profiles, catalogue): a new snapshot directory;
  readers take the newest finished one.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodtide.operators.upsert import one_per_key, upsert
from moodtide.schemas import TABLES
from moodtide.sources.key_filters import key_filters, may_hold

IDS_PER_RANGE = 10_000_000

# table -> partition column, its type, how a row gets it
LAYOUT = {
    "raw_data": ("create_date", T.DateType(), "to_date(create_time)"),
    "user_sentiment": ("id_range", T.LongType(), f"raw_data_id div {IDS_PER_RANGE}"),
}


class Tables:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _exists(self, path: str) -> bool:
        fs, where = self._fs(path)
        return fs.exists(where)

    def _empty(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], TABLES[name])

    def _children(self, path: str, prefix: str) -> list[str]:
        fs, where = self._fs(path)
        if not fs.exists(where):
            return []
        names = [status.getPath().getName() for status in fs.listStatus(where)]
        return sorted(name for name in names if name.startswith(prefix))

    def _delete(self, path: str) -> None:
        fs, where = self._fs(path)
        fs.delete(where, True)

    # --- stage tables ----------------------------------------------------------------

    def append(self, name: str, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path(name)}/batch={batch}")

    def appended(self, name: str, without: int | None = None) -> DataFrame:
        """All batches, or all but the one that is about to be written (again)."""
        batches = [
            f"{self.path(name)}/{child}"
            for child in self._children(self.path(name), "batch=")
            if child != f"batch={without}"
        ]
        if not batches:
            return self._empty(name)
        return self.spark.read.schema(TABLES[name]).parquet(*batches)

    def has_batch(self, name: str, batch: int) -> bool:
        return self._exists(f"{self.path(name)}/batch={batch}/_SUCCESS")

    def batch(self, name: str, batch: int) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path(name)}/batch={batch}")

    def landed(self, name: str, batch: int, make: Callable[[], DataFrame]) -> DataFrame:
        """What came in with a batch, made and written once."""
        path = f"{self.path(name)}-landed/batch={batch}"
        if not self._exists(f"{path}/_SUCCESS"):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def forget(self, name: str, ids: DataFrame, run: str) -> None:
        """Take rows of some ids out of a stage table; only batches that hold any are rewritten.

        What stays of them is written aside first, under the name of the ``run``. A run that was cut
        short goes on from there when repeated.
        """
        aside = f"{self.path(name)}-kept/{run}"
        if not self._exists(f"{aside}/rows/_SUCCESS"):
            if not self._children(self.path(name), "batch="):
                return
            schema = T.StructType([*TABLES[name].fields, T.StructField("batch", T.IntegerType())])
            rows = self.spark.read.schema(schema).parquet(self.path(name))
            touched = rows.join(ids, "id", "left_semi").select("batch").distinct()
            touched.write.mode("overwrite").parquet(f"{aside}/touched")
            numbers = F.broadcast(self.spark.read.parquet(f"{aside}/touched"))  # rounds within retention
            kept = rows.join(numbers, "batch", "left_semi").join(ids, "id", "left_anti")
            kept.repartition("batch").write.mode("overwrite").partitionBy("batch").parquet(f"{aside}/rows")
        for number in [r["batch"] for r in self.spark.read.parquet(f"{aside}/touched").collect()]:
            if self._exists(f"{aside}/rows/batch={number}"):
                left = self.spark.read.schema(TABLES[name]).parquet(f"{aside}/rows/batch={number}")
                self.append(name, left, number)
            else:
                self._delete(f"{self.path(name)}/batch={number}")
        self._delete(aside)

    # --- snapshots -------------------------------------------------------------------

    def versions(self, name: str) -> list[int]:
        found = self._children(self.path(name), "v=")
        done = [v for v in found if self._exists(f"{self.path(name)}/{v}/_SUCCESS")]
        return sorted(int(v[2:]) for v in done)

    def read(self, name: str, before: int | None = None, schema=None) -> DataFrame:
        """The newest snapshot, or the newest one older than ``before``."""
        known = [v for v in self.versions(name) if before is None or v < before]
        if not known:
            if schema is not None:
                return self.spark.createDataFrame([], schema)
            return self._empty(name)
        return self.spark.read.parquet(f"{self.path(name)}/v={known[-1]}")

    def replace(self, name: str, df: DataFrame, version: int | None = None) -> int:
        """Write a snapshot; with a given ``version`` a replay writes the same one again."""
        if version is None:
            version = (self.versions(name) or [0])[-1] + 1
        df.write.mode("overwrite").parquet(f"{self.path(name)}/v={version}")
        return version

    def expire(self, name: str, keep: int = 2) -> list[int]:
        """Delete all but the newest ``keep`` snapshots."""
        old = self.versions(name)[:-keep]
        for version in old:
            self._delete(f"{self.path(name)}/v={version}")
        return old

    # --- partitioned tables --------------------------------------------------------------

    def stored(self, name: str) -> DataFrame:
        if not self._exists(self.path(name)):
            return self._empty(name)
        return self._partitioned(name).drop(LAYOUT[name][0])

    def posts(self) -> DataFrame:
        return self.stored("raw_data")

    def _partitioned(self, name: str) -> DataFrame:
        column, kind, _ = LAYOUT[name]
        schema = T.StructType([*TABLES[name].fields, T.StructField(column, kind)])
        return self.spark.read.schema(schema).parquet(self.path(name))

    def merge(
        self, name: str, incoming: DataFrame, key: str, refresh: list[str], seq: str, batch: int
    ) -> None:
        """Upsert that rewrites only the partitions it touches.

        The incoming rows are written down first, one per key: what they come from (pages,
        a model) is computed once. Then the merged partitions are written aside. Overwriting
        the table from there only copies finished files, and can be repeated should it be cut
        short. A finished batch number is not merged again.
        """
        aside = f"{self.path(name)}-staged/batch={batch}"
        if self._exists(f"{aside}/done"):
            return
        column, _, rule = LAYOUT[name]
        part = F.expr(rule).alias(column)
        if not self._exists(f"{aside}/merged/_SUCCESS"):
            one_per_key(incoming, key, seq, refresh).write.mode("overwrite").parquet(f"{aside}/new")
            new = self.spark.read.schema(TABLES[name]).parquet(f"{aside}/new")
            if self._exists(self.path(name)):
                stored = self._partitioned(name)
                if key in rule:  # the key says where its row lies
                    hit = new.select(part)
                else:
                    opened = stored.where(F.col(column).isin(self.may_hold(name, new, key)))
                    hit = opened.select(key, column).join(new.select(key), key, "left_semi").select(column)
                # one row per partition of the table, which bounds it: days of retention, or
                # ten thousand ranges for a hundred billion ids
                parts = F.broadcast(hit.unionByName(new.select(part)).distinct())
                touched = stored.join(parts, column, "left_semi").drop(column)
            else:
                touched = self._empty(name)
            merged = upsert(touched, new, key, refresh)
            merged.withColumn(column, part).write.mode("overwrite").parquet(f"{aside}/merged")
        merged = self.spark.read.parquet(f"{aside}/merged")
        if key not in rule:  # before the rows, so that a filter knows all keys of its partition
            self._write_partitions(f"{self.path(name)}-keys", key_filters(merged, key, column), column)
        self._write_partitions(self.path(name), merged, column)
        fs, marker = self._fs(f"{aside}/done")
        fs.createNewFile(marker)
        self._delete(f"{aside}/merged")
        self._delete(f"{aside}/new")

    def _write_partitions(self, path: str, df: DataFrame, column: str) -> None:
        """Each partition in few files; a large one, such as the day a backfill lands, in several tasks."""
        (
            df.hint("rebalance", column)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(column)
            .parquet(path)
        )

    def may_hold(self, name: str, keys: DataFrame, key: str) -> list:
        """The partitions that may hold any of ``keys``, by their stored key filters; a few days.

        Partitions that have no filter yet get one first.
        """
        column, kind, _ = LAYOUT[name]
        path = f"{self.path(name)}-keys"
        bare = set(self._children(self.path(name), f"{column}=")) - set(self._children(path, f"{column}="))
        if bare:
            values = [folder.removeprefix(f"{column}=") for folder in sorted(bare)]
            rows = self._partitioned(name).where(F.col(column).cast("string").isin(values))
            self._write_partitions(path, key_filters(rows, key, column), column)
        if not self._children(path, f"{column}="):
            return []  # no rows are left
        filters = self.spark.read.parquet(path).withColumn(column, F.col(column).cast(kind))
        return [row[column] for row in may_hold(filters, keys, key, column).collect()]

    def drop_posts(self, before: dt.datetime, stages: tuple[str, ...] = ()) -> int:
        """Retention: delete posts created before a time, and their rows in stage tables.

        Whole days go with their folder; the day the time falls on is written anew. The ids that go
        and what stays of that day are written aside before anything is changed. A run that was cut
        short is finished from there first, by whichever run comes next.
        """
        if not self._exists(self.path("raw_data")):
            return 0
        run = f"at={before:%Y%m%dT%H%M%S.%f}"
        for unfinished in self._children(f"{self.path('raw_data')}-expired", "at="):
            if unfinished != run and self._exists(f"{self.path('raw_data')}-expired/{unfinished}/kept/_SUCCESS"):
                self._finish_drop(unfinished, stages)
        aside = f"{self.path('raw_data')}-expired/{run}"
        if not self._exists(f"{aside}/kept/_SUCCESS"):
            limit = F.lit(before).cast("timestamp_ntz")
            early = self._partitioned("raw_data").where(F.col("create_date") <= F.lit(before.date()))
            early.where(F.col("create_time") < limit).select("id").write.mode("overwrite").parquet(f"{aside}/ids")
            that_day = early.where((F.col("create_date") == F.lit(before.date())) & (F.col("create_time") >= limit))
            that_day.drop("create_date").write.mode("overwrite").parquet(f"{aside}/kept")
        return self._finish_drop(run, stages)

    def _finish_drop(self, run: str, stages: tuple[str, ...]) -> int:
        aside = f"{self.path('raw_data')}-expired/{run}"
        day = dt.datetime.strptime(run, "at=%Y%m%dT%H%M%S.%f").date().isoformat()
        ids = self.spark.read.parquet(f"{aside}/ids")
        for stage in stages:
            self.forget(stage, ids, run)
        for name in self._children(self.path("raw_data"), "create_date="):
            if name.removeprefix("create_date=") < day:
                self._delete(f"{self.path('raw_data')}/{name}")
                self._delete(f"{self.path('raw_data')}-keys/{name}")
        left = self.spark.read.schema(TABLES["raw_data"]).parquet(f"{aside}/kept")
        if left.isEmpty():
            self._delete(f"{self.path('raw_data')}/create_date={day}")
        else:
            left.write.mode("overwrite").parquet(f"{self.path('raw_data')}/create_date={day}")
        deleted = ids.count()
        self._delete(aside)
        return deleted
