"""What each scene of an export takes over from the scenes before it.

A scene sees who was in the scene right before and who played whom there, and
the latest scenes that share a character with it.  ``carry`` works this out for
whole tables with windows; ``skald.streaming.carried`` keeps the same as state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: how many earlier scenes are shown.
SHOWN_SCENES = 12

ENTRY = "struct<scene: {scene}, narrative: string>"


def _names(characters: Column) -> Column:
    """Names in lower case, each once, without nulls and empty ones."""
    given = F.coalesce(characters, F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.transform(given, lambda c: F.lower(F.trim(c))), lambda c: F.coalesce(c, F.lit("")) != ""))


def carry(scenes: DataFrame, export: str = "export", scene: str = "scene", most: int = SHOWN_SCENES) -> DataFrame:
    """(export, scene, previous_characters, previous_authors, context) of scenes(export, scene, characters, authors, narrative).

    ``context`` lists the last ``most`` earlier scenes of the export that share
    a character (case ignored), earliest first; of a scene without characters,
    the last scenes of all.  The first scene of an export has empty ones; rows
    without export or scene are left out, repeated scenes count once.  Of all
    scenes with one character the last ones suffice, so a character in every
    scene brings ``most`` candidates a scene and no more.
    """
    rows = scenes.where(F.col(export).isNotNull() & F.col(scene).isNotNull()).dropDuplicates([export, scene])
    own = rows.select(F.col(export).alias("export"), F.col(scene).alias("scene"), "characters", "authors", F.struct(F.col(scene).alias("scene"), "narrative").alias("entry"))
    line = Window.partitionBy("export").orderBy("scene")
    placed = own.withColumns({
        "previous_characters": F.coalesce(F.lag("characters").over(line), F.array().cast("array<string>")),
        "previous_authors": F.coalesce(F.lag("authors").over(line), F.create_map().cast("map<string,string>")),
        "latest": F.collect_list("entry").over(line.rowsBetween(-most, -1)),
    })
    with_character = Window.partitionBy("export", "name").orderBy("scene").rowsBetween(-most, -1)
    each = own.select("export", "scene", "entry", F.explode(_names(F.col("characters"))).alias("name"))
    met = each.select("export", "scene", F.collect_list("entry").over(with_character).alias("met"))
    shared = met.groupBy("export", "scene").agg(F.array_distinct(F.flatten(F.collect_list("met"))).alias("shared"))
    found = F.when(F.col("shared").isNull(), F.col("latest")).otherwise(F.reverse(F.slice(F.reverse(F.array_sort("shared")), 1, most)))
    return placed.join(shared, ["export", "scene"], "left").select("export", "scene", "previous_characters", "previous_authors", found.alias("context"))
