"""Tables staged in the folder that driver and executors share.

Staging cuts lineage: an executor that is lost later costs the tasks it ran, not the
stages before the table.  The folder is the one the cluster names in
``spark.checkpoint.dir``; only where that is unset (tests in local mode) a folder of our
own is taken.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; in local mode one of our own where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="quire-"))
    return _OWN[0]


#: Rows of an Arrow batch; texts can be long, and workers hold a few batches.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to BATCH_ROWS rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


class Scratch:
    """A folder for the staged tables of one call of an operator."""

    def __init__(self, spark: SparkSession, name: str, tidy: bool = False):
        small_batches(spark)
        self.spark, self.tidy = spark, tidy
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and return what was written.

        With ``tidy`` its shuffle files go at once: else they stay until the driver happens to collect its garbage.
        """
        before = self.spark.conf.get(_CLEANUP, None)
        if self.tidy:
            self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(self.path(name))
        finally:
            self.spark.conf.unset(_CLEANUP) if before is None else self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def _fs(self, path: str):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def fits(self, name: str, most: int) -> bool:
        """Whether the rows of a staged table take at most ``most`` bytes in memory.

        Counted are the values before compression, by the footers of the files, and eight
        bytes for each field, as repeated values are encoded.
        """
        fs, where = self._fs(self.path(name))
        if int(fs.getContentSummary(where).getLength()) > most:
            return False
        jvm, conf, total = self.spark._jvm, self.spark._jsc.hadoopConfiguration(), 0
        for status in fs.listStatus(where):
            if status.getPath().getName().endswith(".parquet"):
                reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromStatus(status, conf))
                try:
                    fields = reader.getFileMetaData().getSchema().getFieldCount()
                    blocks = reader.getFooter().getBlocks()
                    total += sum(blocks.get(i).getTotalByteSize() + 8 * fields * blocks.get(i).getRowCount() for i in range(blocks.size()))
                finally:
                    reader.close()
            if total > most:
                return False
        return True

    def drop(self, *names: str) -> None:
        """Delete staged tables that nothing reads any more; all of them without names."""
        for path in [self.path(n) for n in names] or [self.root]:
            try:
                fs, where = self._fs(path)
                fs.delete(where, True)
            except Exception as why:  # the session may be gone at exit
                if names:
                    raise RuntimeError(f"cannot delete {path}") from why


#: A staged table up to this many bytes in memory may be broadcast.
BROADCAST_BYTES = 16 << 20


def small_join(left: DataFrame, scratch: Scratch, name: str, right: DataFrame, on, how: str) -> DataFrame:
    """Join with staged table ``name``: broadcast behind a check of its size, else by shuffle."""
    if scratch.fits(name, BROADCAST_BYTES):
        right = right.hint("broadcast")
    else:
        right = right.hint("merge")  # sort-merge: spills, and adaptive execution splits hot keys
    return left.join(right, on, how)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
