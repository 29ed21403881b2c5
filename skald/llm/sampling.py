"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def held_out(id_column: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % modulus == remainder


def sample_ids(rows: DataFrame, id_column: str, class_column: str, per_class: int) -> dict[object, list]:
    """Up to ``per_class`` ids of each class, those of lowest hash, in its order.

    Two passes over ids and classes alone; the driver gets the class counts and
    about twice the sample.
    """
    rows = rows.select(id_column, class_column).where(F.col(id_column).isNotNull() & F.col(class_column).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(class_column).count().collect()}
    if not counts:
        return {}
    place = F.xxhash64(F.col(id_column), F.lit(17)) / F.lit(2.0**64) + 0.5
    share = F.element_at(F.create_map(*(F.lit(v) for c, n in counts.items() for v in (c, min(1.0, (2.0 * per_class + 200) / n)))), F.col(class_column))
    picked = rows.withColumn("_place", place).where(F.col("_place") < share).distinct().collect()
    out: dict[object, list] = {c: [] for c in sorted(counts)}
    for r in sorted(picked, key=lambda r: (r[2], r[0])):
        if len(out[r[1]]) < per_class:
            out[r[1]].append(r[0])
    return out


def rows_of(rows: DataFrame, ids: list, id_column: str) -> DataFrame:
    """The rows with one of these ids, a bounded sample's, sent to all executors."""
    # As Arrow: a local relation, made without Python on the executors.
    wanted = rows.sparkSession.createDataFrame(pa.table({id_column: pa.array(ids)}), T.StructType([rows.schema[id_column]]))
    return rows.join(F.broadcast(wanted), id_column, "left_semi")


def _keys(id_column: str, class_column: str | None) -> list[str]:
    return [id_column] if class_column is None else [id_column, class_column]


def fitting_ids(docs: DataFrame, picked: dict[object, list], id_column: str, text_column: str, per_class: int, class_bytes: int, class_column: str | None = None) -> dict[object, list]:
    """Of each class's ids, in their order, those that fit: ``per_class`` at most, of ``class_bytes`` of text in all.

    The sizes are measured, an id's is that of its shortest row.  Where no text
    of a class fits, its shortest is taken: no class is lost, however long its
    texts.  The driver gets one number for each id.
    """
    wanted = [i for ids in picked.values() for i in ids]
    if not wanted:
        return {}
    size = F.min(F.octet_length(F.coalesce(text_column, F.lit("")))).alias("_size")
    measured = rows_of(docs, wanted, id_column).groupBy(*_keys(id_column, class_column)).agg(size).collect()
    sizes = {(r[0], r[1] if class_column else None): r["_size"] for r in measured}
    out: dict[object, list] = {}
    for c, ids in picked.items():
        there = [(i, sizes[key]) for i in ids if (key := (i, c if class_column else None)) in sizes]
        room, own = class_bytes, []
        for i, n in there:
            if n <= room and len(own) < per_class:
                own.append(i)
                room -= n
        out[c] = own or [min(there, key=lambda x: x[1])[0]] if there else []
    return out


def one_row_each(docs: DataFrame, ids: list, id_column: str, text_column: str, columns: list[str], class_column: str | None = None) -> DataFrame:
    """(id, class, columns) of the shortest row of each of these ids, so that an id on very many rows is one row."""
    keys = _keys(id_column, class_column)
    text = F.coalesce(text_column, F.lit(""))
    best = F.min_by(F.struct(*columns), F.struct(F.octet_length(text), F.xxhash64(text))).alias("_row")
    return rows_of(docs, ids, id_column).groupBy(*keys).agg(best).select(*keys, "_row.*")
