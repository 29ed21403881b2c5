"""Markdown sheets of characters and places, and the index of both, each made from tables and written as one document a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.containment import names_in_texts
from ..operators.spread import ROWS_PER_TASK, partitions_for
from ..operators.text import slug_ws

# Fixed values of the sheets.
CHARACTER_SCENES, PLACE_SCENES, SUMMARY_SHOWN = 20, 15, 80


def _there(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def _bullets(items: Column) -> Column:
    """A list, or null without items."""
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n"))


def _section(title: str, body: Column) -> Column:
    """Title and body and an empty line; null without a body."""
    return F.concat(F.lit(f"## {title}\n"), body, F.lit("\n"))


def _scene_lines(appearances: DataFrame, summaries: DataFrame, most: int) -> DataFrame:
    """(name, scenes): the part on a character's or place's scenes, with the beginnings of their summaries."""
    n = F.size("appearances")
    shown = appearances.where(n > 0).select("name", n.alias("n"), F.posexplode(F.slice("appearances", 1, most)).alias("pos", "scene"))
    told = shown.join(summaries.select("scene", _there(F.col("summary")).alias("summary")), "scene", "left")
    line = F.concat(F.lit("- `"), F.col("scene"), F.lit("`"), F.coalesce(F.concat(F.lit(": "), F.substring("summary", 1, SUMMARY_SHOWN)), F.lit("")))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n")
    title = F.concat(F.lit("## Scene appearances ("), F.max("n").cast("string"), F.lit(")\n"))
    return told.groupBy("name").agg(F.concat(title, lines).alias("scenes"), F.max("n").alias("n"))


def _last_relations(characters: DataFrame, relations: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(name, related): for each character and everyone it stands to, the last relation; ends count that hold its name.

    The last relation of two ends comes first, in parts that follow the counted
    rows, so that only pairs of ends meet the characters.
    """
    ends = relations.select(F.lower("from_char").alias("end")).union(relations.select(F.lower("to_char"))).where("end is not null").distinct()
    held = names_in_texts(characters, "name", ends, "end", "end").select(F.col("name").alias("who"), F.col("key").alias("end"))
    rel = relations.select(F.lower(F.coalesce("from_char", F.lit(""))).alias("a"), F.lower(F.coalesce("to_char", F.lit(""))).alias("b"), F.struct("scene", "pos").alias("at"),
        F.concat(F.coalesce("relation_type", F.lit("?")), F.lit(" ("), F.coalesce("sentiment", F.lit("?")), F.lit(")")).alias("told"))
    rel = rel.repartition(partitions_for(relations, rows_per_task), "at").groupBy("a", "b").agg(F.max(F.struct("at", "told")).alias("last")).select("a", "b", "last.at", "last.told")
    forth = rel.join(held.withColumnRenamed("end", "a"), "a").select("who", F.col("b").alias("other"), "at", "told", "a", "b")
    back = rel.join(held.withColumnRenamed("end", "b"), "b").select("who", F.col("a").alias("other"), "at", "told", "a", "b")
    back = back.where(~F.contains("a", "who"))  # one that holds the name at both ends counts forth
    last = forth.union(back).groupBy("who", "other").agg(F.max_by("told", F.struct("at", "told")).alias("told"))
    line = F.concat(F.lit("- **"), F.col("other"), F.lit("**: "), F.col("told"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("other", line.alias("line")))), lambda x: x["line"]), "\n")
    return last.groupBy("who").agg(F.concat(F.lit("## Relations\n"), lines, F.lit("\n")).alias("related"))


def character_sheets(characters: DataFrame, relations: DataFrame, summaries: DataFrame) -> DataFrame:
    """(slug, sheet) of characters(name, job, author, appellations, description_physical, description_psychological, beliefs, main_locations, appearances).

    ``relations`` is (scene, pos, from_char, to_char, relation_type, sentiment), ``summaries`` (scene, summary).
    What is not known leaves its part out; names are unique, those without one get no sheet.
    """
    named = characters.where(F.coalesce("name", F.lit("")) != "")
    scenes = _scene_lines(named.select("name", "appearances"), summaries, CHARACTER_SCENES)
    joined = named.join(scenes, "name", "left").join(_last_relations(named, relations), F.lower("name") == F.col("who"), "left")
    more = F.when(F.col("n") > CHARACTER_SCENES, F.concat(F.lit("\n- _... "), (F.col("n") - CHARACTER_SCENES).cast("string"), F.lit(" more_"))).otherwise("")
    known_as = F.when(F.size("appellations") > 0, F.array_join("appellations", ", "))
    identity = F.concat_ws("\n", F.lit("## Identity"), F.concat(F.lit("**Role:** "), _there(F.col("job"))), F.concat(F.lit("**Author:** "), _there(F.col("author"))), F.concat(F.lit("**Known as:** "), known_as), F.lit(""))
    sheet = F.concat_ws(
        "\n", F.concat(F.lit("# "), F.initcap("name"), F.lit("\n")), identity, _section("Physical description", _there(F.col("description_physical"))), _section("Psychology", _there(F.col("description_psychological"))),
        _section("Beliefs & values", _bullets(F.col("beliefs"))), _section("Main locations", _bullets(F.col("main_locations"))), "related", F.concat("scenes", more, F.lit("\n")), _first_seen(),
    )
    return joined.select(slug_ws(F.col("name")).alias("slug"), sheet.alias("sheet"))


def _first_seen() -> Column:
    first = F.when(F.size("appearances") > 0, F.get("appearances", F.lit(0)))
    return F.concat(F.lit("_First appearance: "), F.coalesce(first, F.lit("?")), F.lit("_"))


def place_sheets(places: DataFrame, summaries: DataFrame) -> DataFrame:
    """(slug, sheet) of places(name, appellations, description, attributes, appearances)."""
    named = places.where(F.coalesce("name", F.lit("")) != "")
    joined = named.join(_scene_lines(named.select("name", "appearances"), summaries, PLACE_SCENES), "name", "left")
    called = F.concat(F.lit("**Also called:** "), F.when(F.size("appellations") > 0, F.array_join("appellations", ", ")), F.lit("\n"))
    sheet = F.concat_ws("\n", F.concat(F.lit("# "), F.initcap("name"), F.lit("\n")), called, _section("Description", _there(F.col("description"))), _section("Attributes", _bullets(F.col("attributes"))), F.concat("scenes", F.lit("\n")), _first_seen())
    return joined.select(slug_ws(F.col("name")).alias("slug"), sheet.alias("sheet"))


def index_lines(characters: DataFrame, places: DataFrame) -> DataFrame:
    """(part, name, line) of the index, to be sorted by part and name: a heading with the count before each part's entries."""
    seen = F.concat(F.lit("("), F.size(F.coalesce("appearances", F.array().cast("array<string>"))).cast("string"), F.lit(" scenes)"))
    link = lambda kind: F.concat(F.lit("- ["), F.initcap("name"), F.lit(f"]({kind}/"), slug_ws(F.col("name")), F.lit(".md) "))
    heads = lambda rows, part, title: rows.agg(F.lit(part).alias("part"), F.lit("").alias("name"), F.concat(F.lit(f"## {title} ("), F.count(F.lit(1)).cast("string"), F.lit(")")).alias("line"))
    who = characters.select(F.lit(0).alias("part"), "name", F.concat(link("characters"), F.lit("— "), F.coalesce(_there(F.col("job")), F.lit("?")), F.lit(" "), seen).alias("line"))
    where = places.select(F.lit(1).alias("part"), "name", F.concat(link("places"), seen).alias("line"))
    return heads(characters, 0, "Characters").select("part", "name", "line").union(who).union(heads(places, 1, "Places").select("part", "name", "line")).union(where)


def write_sheets(sheets: DataFrame, path: str) -> None:
    """One folder for each sheet (``slug=...``) with its text: Spark commits all or none, so a failed task leaves no half document."""
    sheets.repartition("slug").sortWithinPartitions("slug").select("slug", F.col("sheet").alias("value")).write.mode("overwrite").partitionBy("slug").text(path)
