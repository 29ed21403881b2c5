"""Manual overrides: nested values by path, kept as rows, laid over records.

An override is a row (kind, name, path, value, version): the path is the field
names to a value, joined by dots; the value is JSON; a null value deletes.  The
table is the only state, so putting is appending, and the highest version of a
path counts.  ``laid_over`` turns them into one nested record for each name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE = "kind string, name string, path string, value string, version long"
#: Deepest path.
DEPTH = 3


def override_key(name: Column) -> Column:
    return F.lower(F.trim(name))


def _leaves(rows: DataFrame) -> DataFrame:
    """Objects as an empty one, which replaces what was there, and their members as longer paths, down to ``DEPTH``."""
    done, left = None, rows
    for _ in range(DEPTH):
        is_object = F.startswith(F.ltrim(F.coalesce("value", F.lit(""))), F.lit("{")) & (F.size(F.split("path", r"\.")) < DEPTH)
        own = left.withColumn("value", F.when(is_object, F.lit("{}")).otherwise(F.col("value")))
        done = own if done is None else done.unionByName(own)
        members = F.explode(F.map_entries(F.from_json("value", "map<string, variant>"))).alias("m")
        inner = left.where(is_object).select("kind", "name", "path", "version", members)
        left = inner.select("kind", "name", F.concat_ws(".", "path", "m.key").alias("path"), F.to_json("m.value").alias("value"), "version")
    return done


def put(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The table with rows (kind, name, path, value, version) added; names in lower case, values that are no JSON left out."""
    good = rows.where(F.col("value").isNull() | F.try_parse_json("value").isNotNull())
    return table.unionByName(_leaves(good.select("kind", override_key(F.col("name")).alias("name"), "path", "value", "version")))


def put_all(table: DataFrame, rows: DataFrame, kind: str, fields: list[str], version: Column) -> DataFrame:
    """The same for whole records: each field that is not null, and ``_manual``."""
    pairs = [F.struct(F.lit(f).alias("path"), F.to_json(F.array(f)).alias("value")) for f in fields] + [F.struct(F.lit("_manual").alias("path"), F.lit("[true]").alias("value"))]
    each = rows.select("name", F.explode(F.array(*pairs)).alias("p")).where("p.value <> '[null]' and p.value <> '[]'")
    inner = F.substring("p.value", F.lit(2), F.length("p.value") - 2)
    return put(table, each.select(F.lit(kind).alias("kind"), "name", "p.path", inner.alias("value"), version.alias("version")))


def delete(table: DataFrame, gone: DataFrame) -> DataFrame:
    """The table without the overrides of the (kind, name) rows."""
    wanted = gone.select("kind", override_key(F.col("name")).alias("name"))
    return table.join(wanted, ["kind", "name"], "left_anti")


def current(table: DataFrame) -> DataFrame:
    """(kind, name, path, value): the highest version of each path, without deleted ones and without what a later value of a shorter path replaced."""
    newest = table.groupBy("kind", "name", "path").agg(F.max_by(F.struct("value", "version"), F.struct("version", F.coalesce("value", F.lit("")))).alias("v")).select("kind", "name", "path", "v.*")
    parents = newest.select("kind", "name", F.col("path").alias("_above"), F.col("version").alias("_version"))
    steps = F.split("path", r"\.")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps) - 1, F.lit(1))), lambda n: F.array_join(F.slice(steps, 1, n), ".")))
    replaced = newest.where(F.size(steps) > 1).withColumn("_above", above).join(parents, ["kind", "name", "_above"]).where("_version > version").select("kind", "name", "path").distinct()
    return newest.join(replaced, ["kind", "name", "path"], "left_anti").where("value is not null").select("kind", "name", "path", "value")


def laid_over(table: DataFrame) -> DataFrame:
    """(kind, name, record): the overrides of each name as one nested JSON text, fields in alphabetical order.

    Values of longer paths go into those of shorter ones; where a shorter path
    has a plain value of its own and did not come later, the longer path wins.
    """
    each = current(table).withColumn("steps", F.split("path", r"\.")).where(F.size("steps") <= DEPTH)
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('":'))
    # From the deepest level up: the members of an object are joined to its text.
    level = each.select("kind", "name", "steps", "value", F.lit(False).alias("made"))
    for depth in range(DEPTH, 0, -1):
        here, rest = level.where(F.size("steps") == depth), level.where(F.size("steps") < depth)
        one = here.groupBy("kind", "name", "steps").agg(F.max_by("value", F.col("made")).alias("value"))
        members = F.array_sort(F.collect_list(F.struct(F.element_at("steps", -1).alias("k"), F.col("value").alias("v"))))
        made = one.withColumn("above", F.slice("steps", 1, depth - 1)).groupBy("kind", "name", "above").agg(members.alias("m"))
        text = F.concat(F.lit("{"), F.array_join(F.transform("m", lambda x: F.concat(quoted(x["k"]), x["v"])), ","), F.lit("}"))
        level = rest.unionByName(made.select("kind", "name", F.col("above").alias("steps"), text.alias("value"), F.lit(True).alias("made")))
    return level.select("kind", "name", F.col("value").alias("record"))


def value_at(record: Column, path: str) -> Column:
    """The JSON text at a path of a nested record; null where there is none."""
    return F.get_json_object(record, "$." + path)


def overridden(record: Column, manual: Column, fields: list[str]) -> dict[str, Column]:
    """Each field: the manual record's unless it is missing or blank, else the record's; both are JSON texts."""
    pick = lambda f: F.coalesce(F.nullif(F.trim(value_at(manual, f)), F.lit("")), value_at(record, f))
    return {f: pick(f) for f in fields}


def with_overrides(rows: DataFrame, name: str, table: DataFrame, kind: str, fields: list[str]) -> DataFrame:
    """Rows with those fields replaced that have an override (fields are texts; lists as JSON)."""
    over = laid_over(table.where(F.col("kind") == kind)).select(F.col("name").alias("_name"), "record")
    joined = rows.join(over, override_key(F.col(name)) == F.col("_name"), "left")
    return reduce(lambda df, f: df.withColumn(f, F.coalesce(F.nullif(F.trim(value_at(F.col("record"), f)), F.lit("")), F.col(f))), fields, joined).drop("_name", "record")
