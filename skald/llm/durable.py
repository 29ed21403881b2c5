"""Tables that outlive lost executors: Parquet in the cluster's shared folder."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Small rows (a few numbers) that one task writes.
ROWS_IN_PART = 250_000


@cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="skald-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; on a cluster a machine's own folder never takes its place."""
    folder = spark.sparkContext.getConf().get(_KEY) or spark.conf.get(_KEY, None)
    if folder:
        return folder
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # no cluster: driver and executors are one process
        return _own_folder()
    raise ValueError(f"set {_KEY} to a folder that the driver and all executors share")


class Scratch:
    """A place for the tables of one job in the shared folder.

    A job drops its tables once nothing will read them again; what its result
    is read from goes when the driver's Python ends.  With ``free_shuffles``
    Spark deletes the shuffle files of each write as it ends.
    """

    def __init__(self, spark: SparkSession, name: str, free_shuffles: bool = False):
        self.spark = spark
        self.free_shuffles = free_shuffles
        atexit.register(self._end)
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._made = 0
        self._tables: dict[int, tuple[DataFrame, str]] = {}

    def write(self, df: DataFrame) -> DataFrame:
        """Write the rows and return them as read back: the lineage ends here."""
        self._made += 1
        to = f"{self.path}/{self._made:03d}"
        before = self.spark.conf.get(_FREE)
        self.spark.conf.set(_FREE, str(self.free_shuffles or before == "true").lower())
        try:
            df.write.parquet(to)
        finally:
            self.spark.conf.set(_FREE, before)
        back = self.spark.read.schema(df.schema).parquet(to)
        self._tables[id(back)] = back, to
        return back

    def write_rows(self, df: DataFrame, rows: int) -> DataFrame:
        """The same for at most so many small rows: in one part for each ``ROWS_IN_PART`` of them, not one for each task."""
        return self.write(df.coalesce(-(-max(rows, 1) // ROWS_IN_PART)))

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing will read again; what is no table of this job stays."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for table in tables:
            _, folder = self._tables.pop(id(table), (None, None))
            if folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)

    def _end(self) -> None:
        if self._tables and self.spark.sparkContext._jsc is not None:
            with contextlib.suppress(Exception):  # the JVM may be gone first
                self.keep_only()

    def keep_only(self, *tables: DataFrame) -> None:
        """Delete all tables of this job but these."""
        keep = {id(t) for t in tables}
        self.drop(*[t for t, _ in list(self._tables.values()) if id(t) not in keep])
