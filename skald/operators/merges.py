"""Merges of partial records: chunks into scenes, extractions into entities, manual tables over both.

Rows of one key are folded by aggregates that combine on the map side, so no
key's rows meet in one task unless the result itself is the list of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the scene merge.
SHORT_SCENE = 15
MAX_GAP_HOURS = 240

_UNKNOWN = ("", "unknown", "?")


def known(value: str) -> Column:
    """The value unless it says that nothing is known."""
    return F.when(~F.lower(F.trim(F.col(value))).isin(*_UNKNOWN), F.col(value))


def _place(order: list[str]) -> Column:
    return F.struct(*order)


def first_known(value: str, order: list[str]) -> Column:
    """Aggregate: the earliest value that is known."""
    return F.min_by(value, F.when(known(value).isNotNull(), _place(order)))


def last_known(value: str, order: list[str]) -> Column:
    """Aggregate: the latest value that is known."""
    return F.max_by(value, F.when(known(value).isNotNull(), _place(order)))


def longest(value: str, order: str) -> Column:
    """Aggregate: the longest value; the earliest of equals."""
    return F.max_by(value, F.struct(F.length(value), -F.col(order)))


def highest(value: str, order: str, ranks: dict[str, int]) -> Column:
    """Aggregate: the value of the highest rank (0 for those not ranked); the earliest of equals; null and empty are skipped."""
    rank = F.lit(0)
    for name, r in ranks.items():
        rank = F.when(F.col(value) == name, r).otherwise(rank)
    return F.max_by(value, F.when(F.coalesce(F.col(value), F.lit("")) != "", F.struct(rank, -F.col(order))))


def items_in_order(value: Column, order: list[str]) -> Column:
    """Aggregate: the values that are not null as an array in order."""
    kept = F.when(value.isNotNull(), F.struct(*order, value.alias("_v")))
    return F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["_v"])


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One whole row per key, the first in order; the aggregate combines on the map side."""
    rest = [c for c in rows.columns if c not in keys]
    row = F.min_by(F.struct(*rest), _place(order)).alias("_row")
    return rows.groupBy(*keys).agg(row).select(*keys, "_row.*").select(rows.columns)


def last_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One whole row per key, the last in order: an upsert by key, given old and new rows."""
    rest = [c for c in rows.columns if c not in keys]
    row = F.max_by(F.struct(*rest), _place(order)).alias("_row")
    return rows.groupBy(*keys).agg(row).select(*keys, "_row.*").select(rows.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str, value: str | None = None) -> DataFrame:
    """Old and new rows, the highest version of each key; rows with an empty ``value`` change nothing."""
    new = new if value is None else new.where(F.coalesce(F.trim(value), F.lit("")) != "")
    return last_of(old.unionByName(new), keys, [version])


def labelled_edges(rows: DataFrame, a: str, b: str, order: list[str], labels: list[str]) -> DataFrame:
    """(a, b, weight, labels): undirected, without loops; each label is the first that is not empty."""
    first = (F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", _place(order))).alias(c) for c in labels)
    ends = F.least(a, b).alias("a"), F.greatest(a, b).alias("b")
    return rows.where(F.col(a) != F.col(b)).groupBy(*ends).agg(F.count(F.lit(1)).alias("weight"), *first)


def priority_union(manual: Column, other: Column) -> Column:
    """Items of both lists in lower case, manual ones first, each once."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.transform(F.concat(F.coalesce(manual, none), F.coalesce(other, none)), F.lower))


def priority_map(manual: Column, other: Column) -> Column:
    """Both maps; values of the first win unless blank."""
    none = F.create_map().cast("map<string,string>")
    return F.map_zip_with(F.coalesce(manual, none), F.coalesce(other, none), lambda _, m, o: F.coalesce(F.nullif(F.trim(m), F.lit("")), o))


def aliases(variants: Column, canonical: Column) -> Column:
    """The variants other than the canonical name, sorted."""
    return F.array_sort(F.array_except(variants, F.array(canonical)))


def scene_gaps(scenes: DataFrame, keys: list[str], order: list[str], first_ts: str, last_ts: str) -> DataFrame:
    """Adds ``gap_us``: microseconds from the end of the scene before; null if either time is missing; may be negative."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return scenes.withColumn("gap_us", F.unix_micros(F.col(first_ts).cast("timestamp")) - F.unix_micros(F.lag(last_ts).over(w).cast("timestamp")))


def merge_short_scenes(scenes: DataFrame, keys: list[str], order: list[str], size: str, first_ts: str, last_ts: str, verdict: Column | None = None) -> DataFrame:
    """Adds ``merged``, the number from 0 of the scene that each one becomes part of.

    A short scene joins what stands before it unless the gap is too long or
    ``verdict`` (a model's answer, if given) says no.  What stands before always
    ends with the scene right before, grown or not, so a running sum suffices.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    gaps = scene_gaps(scenes, keys, order, first_ts, last_ts)
    near = F.col("gap_us").isNull() | (F.col("gap_us") <= MAX_GAP_HOURS * 3600 * 1_000_000)
    joins = (F.col(size) < SHORT_SCENE) & near & (F.row_number().over(w) > 1)
    joins = joins if verdict is None else joins & F.coalesce(verdict, F.lit(False))
    flagged = gaps.withColumn("_new", (~joins).cast("long"))
    return flagged.withColumn("merged", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new", "gap_us")


def next_index(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Per key, one more than the highest number that ends a name; 0 without any."""
    number = F.expr(f"try_cast(regexp_extract({name}, '([0-9]+)$', 1) as bigint)")
    return rows.groupBy(*keys).agg((F.coalesce(F.max(number), F.lit(-1)) + 1).alias("next_index"))


def peak(series: DataFrame, order: str, value: str) -> DataFrame:
    """The row with the highest value; the first of equals."""
    return series.orderBy(F.desc(value), order).limit(1)


def merge_context(chunks: DataFrame, keys: list[str], order: str, scalars: list[str], lists: list[str], flags: list[str]) -> DataFrame:
    """Chunks' contexts of a scene: first known scalars, lists joined in order without repeats, flags if any is set."""
    out = [first_known(c, [order]).alias(c) for c in scalars]
    out += [F.array_distinct(F.flatten(items_in_order(F.col(c), [order]))).alias(c) for c in lists]
    out += [F.bool_or(c).alias(c) for c in flags]
    return chunks.groupBy(*keys).agg(*out)


def merge_entities(chunks: DataFrame, keys: list[str], name: str, order: str, described: list[str], states: list[str], lists: list[str]) -> DataFrame:
    """Mentions of an entity as one record: names meet in any case, the longest description and the last known state win."""
    out = [F.min_by(name, order).alias(name)]
    out += [longest(c, order).alias(c) for c in described]
    out += [last_known(c, [order]).alias(c) for c in states]
    out += [F.array_distinct(F.transform(F.flatten(items_in_order(F.col(c), [order])), F.lower)).alias(c) for c in lists]
    return chunks.groupBy(*keys, F.lower(name).alias("_key")).agg(*out).drop("_key")


def joined_text(value: Column, order: list[str], separator: str = " ") -> Column:
    """Aggregate: the texts that are there, joined in order."""
    return F.concat_ws(separator, items_in_order(value, order))
