"""Tables in the folder that driver and executors share: they cut lineage, so that a lost executor costs its tasks alone."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which an execution removes its shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows in an Arrow batch while a table is staged: rows hold whole texts, and a task has several batches in memory.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "2000"
#: Spark's setting by which the order of a bucket's one file counts, so that a merge join does not sort it again.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a fresh folder in local mode (tests) and an error on a cluster, whose
    machines would each write into a folder of their own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Scratch:
    """The staged tables of one job. Writing a name again removes the table that had it before, once the new one is whole.
    Its owner closes it when nothing reads the job's result any more, itself or, for all jobs of a session, by release()."""

    #: Every open scratch, by its session's application.
    open: dict[str, list[Scratch]] = {}

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.tables = spark, f"{shared_dir(spark)}/job-{uuid.uuid4().hex}", {}
        self.open.setdefault(spark.sparkContext.applicationId, []).append(self)

    @contextmanager
    def _settings(self) -> Iterator[None]:
        before = {key: self.spark.conf.get(key, None) for key in (CLEANUP, BATCH, ORDERED)}
        self.spark.conf.set(CLEANUP, "true")
        self.spark.conf.set(ORDERED, "true")
        self.spark.conf.set(BATCH, str(min(int(before[BATCH] or BATCH_ROWS), int(BATCH_ROWS))))
        try:
            yield
        finally:
            for key, value in before.items():
                self.spark.conf.unset(key) if value is None else self.spark.conf.set(key, value)

    def __call__(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        """Write df as Parquet and read it back. The shuffle files that it took are removed."""
        path = f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"
        with self._settings():
            df.write.option("compression", compression).parquet(path)
        self.drop(name)
        self.tables[name] = (path, None)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, keys: list[str]) -> DataFrame:
        """Write df, which is grouped by or joined on its keys, in as many buckets of these as a shuffle has partitions, each
        one sorted file: what joins it on the keys while a table is staged neither shuffles nor sorts it again."""
        table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
        path = f"{self.folder}/{table}"
        with self._settings():
            buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            df.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).format("parquet").saveAsTable(table)
        self.drop(name)
        self.tables[name] = (path, table)
        return self.spark.table(table)

    def drop(self, *names: str) -> None:
        """Remove tables that nothing will read again."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path, table = self.tables.pop(name, (None, None))
            if table:
                self.spark.sql(f"DROP TABLE IF EXISTS `{table}`")
            if path:
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(conf).delete(at, True)

    def close(self) -> None:
        """Remove all tables of the job."""
        self.drop(*self.tables)
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        mine = self.open.get(self.spark.sparkContext.applicationId, [])
        if self in mine:
            mine.remove(self)


def release(spark: SparkSession) -> None:
    """Close every job of the session's application: call it when all results were read."""
    for scratch in list(Scratch.open.get(spark.sparkContext.applicationId, [])):
        scratch.close()


def stage(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """One table, staged for as long as what is made from it may be read."""
    return Scratch(df.sparkSession)(df, name, compression)
