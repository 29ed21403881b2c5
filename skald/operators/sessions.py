"""Sessions by time gap, and the shaping of sessions into scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spread import ROWS_PER_TASK, partitions_for

# Fixed values of the default rules.
SESSION_GAP_SECONDS = 1800
MIN_SCENE_MESSAGES = 20
CHUNK_SIZE, CHUNK_OVERLAP = 40, 5
TRANSLATE_BATCH = 20


def micros(ts: Column) -> Column:
    """Microseconds of a timestamp column with or without time zone."""
    return F.unix_micros(ts.cast("timestamp"))


def mark_sessions(rows: DataFrame, keys: list[str], ts: str, order: str, gap_seconds: int = SESSION_GAP_SECONDS) -> DataFrame:
    """Adds ``session``, 0.. within the keys: a new one begins after more than the gap since the last known time.

    Rows without a time come first and open no session.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(ts).asc_nulls_first(), F.col(order))
    last = F.last(F.col(ts), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    split = F.coalesce((micros(F.col(ts)) - micros(last) > gap_seconds * 1_000_000).cast("long"), F.lit(0).cast("long"))
    marked = rows.withColumn("_split", split)
    return marked.withColumn("session", F.sum("_split").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_split")


def gap_sessions(rows: DataFrame, keys: list[str], ts: str, order: str, gap_seconds: int = SESSION_GAP_SECONDS, min_size: int = MIN_SCENE_MESSAGES, keep: Column | None = None) -> DataFrame:
    """One row per session of at least ``min_size`` kept rows: keys, scene (renumbered), n, start and end.

    Gaps are measured over all rows; ``keep`` filters afterwards.
    """
    marked = mark_sessions(rows, keys, ts, order, gap_seconds)
    if keep is not None:
        marked = marked.where(keep)
    found = marked.groupBy(*keys, "session").agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts")).where(F.col("n") >= min_size)
    return found.withColumn("scene", (F.row_number().over(Window.partitionBy(*keys).orderBy("session")) - 1).cast("long")).drop("session")


def overlapping_chunks(rows: DataFrame, keys: list[str], order: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """The rows once for each chunk they fall in: adds pos (0..) and chunk (0..); strides of size - overlap."""
    w = Window.partitionBy(*keys)
    stride = size - overlap
    n = F.count(F.lit(1)).over(w)
    placed = rows.withColumn("pos", (F.row_number().over(w.orderBy(order)) - 1).cast("long")).withColumn("_n", n)
    chunks = F.when(F.col("_n") <= size, F.lit(1)).otherwise(F.ceil((F.col("_n") - size) / F.lit(stride)) + 1).cast("long")
    first = F.greatest(F.lit(0), F.floor((F.col("pos") - size) / F.lit(stride)) + 1).cast("long")
    last = F.least(chunks - 1, F.floor(F.col("pos") / F.lit(stride))).cast("long")
    return placed.withColumn("chunk", F.explode(F.sequence(first, last))).drop("_n")


def trim_edges(rows: DataFrame, keys: list[str], order: str, inner: Column) -> DataFrame:
    """Rows from the first to the last for which ``inner`` holds; all of a group without any."""
    w = Window.partitionBy(*keys)
    own = F.when(inner, F.col(order))
    marked = rows.withColumn("_lo", F.min(own).over(w)).withColumn("_hi", F.max(own).over(w))
    return marked.where(F.col("_lo").isNull() | F.col(order).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def first_anchor(rows: DataFrame, keys: list[str], order: str, anchor: Column) -> DataFrame:
    """Per group, the first place where the anchor holds (null if nowhere)."""
    return rows.groupBy(*keys).agg(F.min(F.when(anchor, F.col(order))).alias("anchor"))


def duplicate_opening(rows: DataFrame, keys: list[str], pos: str, text: str, previous: DataFrame, limit: int = 10) -> DataFrame:
    """Drops the contiguous opening rows (at most ``limit``) whose text is in ``previous`` (keys, text)."""
    known = previous.select(*keys, F.col(text)).distinct().withColumn("_dup", F.lit(True))
    marked = rows.join(known, [*keys, text], "left")
    fresh = F.min(F.when(F.col("_dup").isNull(), F.col(pos))).over(Window.partitionBy(*keys))
    cut = F.least(F.coalesce(fresh, F.lit(limit)), F.lit(limit))
    return marked.withColumn("_cut", cut).where(F.col(pos) >= F.col("_cut")).drop("_dup", "_cut")


def batch_ids(rows: DataFrame, keys: list[str], order: str, size: int = TRANSLATE_BATCH) -> DataFrame:
    """Adds ``batch``: rows of a group in batches of ``size`` in order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    return rows.withColumn("batch", F.floor(n / F.lit(size)).cast("long"))


def segments(rows: DataFrame, keys: list[str], order: str, boundary: Column) -> DataFrame:
    """Adds ``segment``: how many boundaries lie at or before the row, not counting one on the first row."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = rows.withColumn("_b", F.when(F.row_number().over(w) == 1, F.lit(0)).otherwise(boundary.cast("int")))
    return marked.withColumn("segment", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_b")


def renumber(rows: DataFrame, keys: list[str], first_ts: str, order: str) -> DataFrame:
    """Adds ``scene``: place by first time (missing first), then by the old order."""
    w = Window.partitionBy(*keys).orderBy(F.col(first_ts).asc_nulls_first(), order)
    return rows.withColumn("scene", (F.row_number().over(w) - 1).cast("long"))


def previous_of(rows: DataFrame, keys: list[str], order: list[str], column: str, name: str = "previous") -> DataFrame:
    """Adds the value of the row before within the keys."""
    return rows.withColumn(name, F.lag(column).over(Window.partitionBy(*keys).orderBy(*order)))


def last_overlapping(rows: DataFrame, scene: str, item: str, k: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(scene, before, back): the last ``k`` earlier scenes that share an item with each scene, latest first.

    Of the scenes with one item only the last k can be among the last k of all,
    so each row brings k candidates at most, however common its item is.
    """
    parts = partitions_for(rows, rows_per_task)
    own = rows.select(F.col(scene), F.col(item).alias("_item")).repartition(parts, "_item").distinct()
    last = Window.partitionBy("_item").orderBy(scene)
    near = own.select(scene, *(F.lag(scene, i).over(last).alias(f"_{i}") for i in range(1, k + 1)))
    met = near.select(scene, F.explode(F.array(*(f"_{i}" for i in range(1, k + 1)))).alias("before")).where("before is not null")
    met = met.repartition(k * parts, scene).distinct()  # each row brings k candidates at most
    back = F.row_number().over(Window.partitionBy(scene).orderBy(F.desc("before"))).cast("long")
    return met.withColumn("back", back).where(F.col("back") <= k)
