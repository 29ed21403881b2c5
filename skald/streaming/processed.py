"""Sinks that do each item once: a table of what is done, and outputs that only count once they are in it.

``Processed`` is called for each micro-batch of a stream (``foreachBatch``) or
by hand.  It leaves out items that earlier batches have done, writes what is
made of the others to a folder of the batch's own, and at last notes the items.
A batch that is killed on the way is not in the table, so nobody reads its
files, and when it is run again it writes the same folders anew; a batch that
is repeated after it was noted does the same and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Processed:
    """``make(rows, before)`` returns the outputs of new rows by name; ``before(name)`` reads what earlier batches made.

    ``schemas`` has the schema of each output.  Rows whose key has a null are
    items too.
    """

    def __init__(self, spark: SparkSession, folder: str, item: list[str], schemas: dict[str, str | T.StructType], make: Callable[[DataFrame, Callable[[str], DataFrame]], dict[str, DataFrame]]):
        self.spark, self.folder, self.item, self.make = spark, folder.rstrip("/"), item, make
        self.schemas = {n: T.StructType.fromDDL(s) if isinstance(s, str) else s for n, s in schemas.items()}

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        path = f"{self.folder}/{name}"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
        if not hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).option("basePath", path).parquet(path)

    def done(self, items: T.StructType) -> DataFrame:
        """(item, batch) of all items done."""
        return self._read("done", items)

    def table(self, name: str, items: T.StructType, but: int | None = None) -> DataFrame:
        """An output, of the batches that are noted; ``but`` one."""
        noted = self._read("done", items).select("batch").distinct()
        rows = self._read(name, self.schemas[name]).join(noted, "batch", "left_semi")
        rows = rows if but is None else rows.where(F.col("batch") != but)
        return rows.select(*[f.name for f in self.schemas[name]])

    def __call__(self, rows: DataFrame, batch: int) -> None:
        items = rows.select(*self.item).schema
        earlier = self.done(items).where(F.col("batch") != batch)
        same = None
        for c in self.item:
            one = F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
            same = one if same is None else same & one
        fresh = rows.alias("x").join(earlier.select(*self.item).alias("y"), same, "left_anti")
        made = self.make(fresh, lambda name: self.table(name, items, but=batch))
        for name, schema in self.schemas.items():
            columns = [F.col(f.name).cast(f.dataType) for f in schema]
            made[name].select(*columns).write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")
        fresh.select(*self.item).distinct().write.mode("overwrite").parquet(f"{self.folder}/done/batch={batch}")


SCENE_TYPES = "export string, source_scene long, scene long, pos long, author string, content string, content_en string, ts timestamp, score double, flags array<string>"
QUEUE_TYPES = "export string, source_scene long, scene long, score double, flags array<string>, reason string, n_messages long, preview string"


def subdivider(spark: SparkSession, folder: str, split: Callable[[DataFrame], DataFrame], decide: Callable[[DataFrame], DataFrame] | None = None) -> Processed:
    """Subdivides each (export, scene) of messages once; new scenes of an export count on from those made before.

    ``split`` returns (export, scene, boundaries) of messages, as a model gave them.
    """
    from ..operators.scene_steps import subdivide

    def make(rows: DataFrame, before: Callable[[str], DataFrame]) -> dict[str, DataFrame]:
        numbers = before("scenes").select("export", "scene").union(before("queue").select("export", "scene"))
        first = numbers.groupBy("export").agg((F.max("scene") + 1).alias("next"))
        scenes, queue = subdivide(rows, split(rows), decide, first)
        return {"scenes": scenes, "queue": queue}

    return Processed(spark, folder, ["export", "scene"], {"scenes": SCENE_TYPES, "queue": QUEUE_TYPES}, make)
