"""Whole scores of scenes and characters: tension with its trend and peak, importance, and power.

Weights are fixed values in tenths, summed as whole numbers, so that sums are
exact and do not depend on the order of rows; the results are divided by ten.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .analytics import IMPORTANCE, TENSION, weight

# Fixed values of the scores, in tenths.
OTHER_TENSION, OTHER_IMPORTANCE, CAST_OF_EVENT, LINK, RELATION, CAST_OF_SCENE = 3, 5, 3, 4, 5, 3
NEGATIVE, NEGATIVE_SENTIMENTS = 15, ("fear", "resentment", "hatred", "distrust", "rivalry")
COMPETENCY = {"exceptional": 40, "high": 30, "medium": 20, "low": 10, "none": 0}
POWER_AXES = ("combat_melee", "leadership", "intimidation", "magic_power")
ARROGANCE, REBELLION = 5, -3
RELATION_POWER = {"mentor": 20, "leader": 20, "subordinate": -20, "ally": 10, "enemy": -10, "rival": -5}


def _summed(keys: list[str], *parts: tuple[DataFrame, Column]) -> DataFrame:
    """(keys, score): the sums of all parts; each is added up before they meet."""
    rows = [df.groupBy(*keys).agg(F.sum(value.cast("long")).alias("part")) for df, value in parts]
    return reduce(DataFrame.unionAll, rows).groupBy(*keys).agg((F.sum("part") / 10).alias("score"))


def scene_tension(scenes: DataFrame, keys: list[str], events: DataFrame, relations: DataFrame, links: DataFrame) -> DataFrame:
    """(keys, score) of every scene: its events(type), relations(sentiment) that turn against someone, and links."""
    bad = F.when(F.lower("sentiment").isin(*NEGATIVE_SENTIMENTS), NEGATIVE).otherwise(0)
    return _summed(keys, (scenes, F.lit(0)), (events, weight(F.col("type"), TENSION, OTHER_TENSION)), (relations, bad), (links, F.lit(LINK)))


def scene_importance(scenes: DataFrame, keys: list[str], events: DataFrame, relations: DataFrame, links: DataFrame) -> DataFrame:
    """(keys, score) of every scene: scenes(characters), events(type, characters), relations and links."""
    cast_size = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>")))
    own = weight(F.col("type"), IMPORTANCE, OTHER_IMPORTANCE) + CAST_OF_EVENT * cast_size("characters")
    return _summed(keys, (scenes, CAST_OF_SCENE * cast_size("characters")), (events, own), (relations, F.lit(RELATION)), (links, F.lit(LINK)))


def character_power(characters: DataFrame) -> DataFrame:
    """(name, power) of characters(name, competency_axes, personality_axes) with a name, in lower case; of equal names the last in order of ``place``."""
    ranks = F.create_map(*(F.lit(x) for kv in COMPETENCY.items() for x in kv))
    rank = lambda axis: F.coalesce(F.try_element_at(ranks, F.lower(F.try_element_at("competency_axes", F.lit(axis)))), F.lit(0))
    trait = lambda axis, w: F.coalesce(F.try_element_at("personality_axes", F.lit(axis)).cast("long"), F.lit(0)) * w
    total = reduce(lambda a, b: a + b, [rank(a) for a in POWER_AXES]) + trait("humble_vs_arrogant", ARROGANCE) + trait("conformist_vs_rebel", REBELLION)
    scored = characters.where(F.coalesce("name", F.lit("")) != "").select(F.lower("name").alias("name"), "place", (F.greatest(F.lit(0), total) / 10).alias("power"))
    return scored.groupBy("name").agg(F.max_by("power", "place").alias("power"))


def influence(relations: DataFrame) -> DataFrame:
    """(source, target, weight): relations(from_char, to_char, relation_type) by which one has power over another, summed."""
    a, b = F.lower(F.coalesce("from_char", F.lit(""))), F.lower(F.coalesce("to_char", F.lit("")))
    rows = relations.select(a.alias("source"), b.alias("target"), weight(F.lower("relation_type"), RELATION_POWER, 0).alias("w"))
    return rows.where("w > 0 and source <> '' and target <> '' and source <> target").groupBy("source", "target").agg((F.sum("w") / 10).alias("weight"))


def curve(scores: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Adds ``trend`` and ``peak`` to series of scenes: means over an eighth of the series (zeros beyond its ends), and its first highest place.

    A series is one row a scene; series of two scenes or less have no peak.
    """
    line = Window.partitionBy(*keys).orderBy(order)
    placed = scores.withColumns({"_pos": F.row_number().over(line).cast("long"), "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys)), "_sum": F.sum(value).over(line.rowsBetween(Window.unboundedPreceding, 0))})
    width = F.greatest(F.lit(1).cast("long"), F.floor(F.col("_n") / 8).cast("long"))
    ends = placed.withColumns({"_w": width, "_hi": F.least(F.col("_n"), F.col("_pos") + F.floor((width - 1) / 2).cast("long")), "_lo": F.col("_pos") - F.floor(width / 2).cast("long") - 1})
    sums = lambda at, name: placed.select(*keys, F.col("_pos").alias(at), F.col("_sum").alias(name))
    met = ends.join(sums("_hi", "_upto"), [*keys, "_hi"]).join(sums("_lo", "_before"), [*keys, "_lo"], "left")
    trend = F.round((F.col("_upto") - F.coalesce("_before", F.lit(0.0))) / F.col("_w"), 9)
    found = met.withColumn("trend", trend)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("trend"), "_pos"))
    return found.withColumn("peak", (first == 1) & (F.col("_n") > 2)).select(*scores.columns, "trend", "peak")
