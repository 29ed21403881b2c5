"""What the question handlers look up, over normalised tables.

``events(scene, pos, kind, ...)`` holds what happens, ``members(scene, who)``
who is there; events at one place go by their kind.  Limits are the handlers' own: they bound what a reader is shown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the reports.
GOALS, REACTIONS, SEEN, MISSED, REFERENCES = 12, 15, 20, 15, 25
TIERS = ((0.6, "high"), (0.3, "medium"))


def _scenes_of(members: DataFrame, who) -> DataFrame:
    return members.where(F.col("who") == F.lit(who)).select("scene").distinct()


def own_events(events: DataFrame, members: DataFrame, who, kinds: list[str], limit: int = GOALS) -> DataFrame:
    """The first events of some kinds in a character's scenes (goals, reactions)."""
    mine = events.where(F.col("kind").isin(kinds)).join(_scenes_of(members, who), "scene", "left_semi")
    return mine.orderBy("scene", "pos", "kind").limit(limit)


def catch_up(events: DataFrame, members: DataFrame, who, each_seen: int = 3, each_missed: int = 2) -> DataFrame:
    """Events with ``seen``: a few of each of a character's scenes, fewer of each scene missed."""
    mine = _scenes_of(members, who).withColumn("_own", F.lit(True))
    w = Window.partitionBy("scene").orderBy("pos", "kind")
    first = events.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max(each_seen, each_missed))
    told = first.join(mine, "scene", "left").withColumn("seen", F.coalesce("_own", F.lit(False))).drop("_own")
    seen = told.where(F.col("seen") & (F.col("_n") <= each_seen)).orderBy("scene", "pos", "kind").limit(SEEN)
    missed = told.where(~F.col("seen") & (F.col("_n") <= each_missed)).orderBy("scene", "pos", "kind").limit(MISSED)
    return seen.unionAll(missed).drop("_n")


def character_arc(states: DataFrame, members: DataFrame, who, state: str, limit: int = 100) -> DataFrame:
    """Per scene of a character, the state told there, cut at the limit."""
    mine = states.join(_scenes_of(members, who), "scene", "left_semi")
    return mine.select("scene", F.substring(state, 1, limit).alias(state))


def references(messages: DataFrame, order: list[str], text: str, pattern: str, limit: int = REFERENCES) -> DataFrame:
    """The first messages that match a pattern of words, in any case and script."""
    return messages.where(F.col(text).rlike("(?iuU)" + pattern)).orderBy(*order).limit(limit)


def latest_unconfirmed(scenes: DataFrame, confirmed: DataFrame) -> DataFrame:
    """The last scene that nobody has confirmed."""
    return scenes.select("scene").join(confirmed.select("scene"), "scene", "left_anti").agg(F.max("scene").alias("scene"))


def named_in(question: str, names: DataFrame, name: str) -> DataFrame:
    """The names (3 letters or more) that the question holds."""
    return names.where((F.length(name) >= 3) & F.contains(F.lit(question.lower()), F.lower(name)))


def top_per_category(scored: DataFrame, category: str, score: str, id_column: str, each: int, total: int) -> DataFrame:
    """The best of each category, then the best of these."""
    w = Window.partitionBy(category).orderBy(F.desc(score), id_column)
    best = scored.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= each).drop("_n")
    return best.orderBy(F.desc(score), id_column).limit(total)


def influence(relations: DataFrame, source: str, target: str, weight: Column) -> DataFrame:
    """(source, target, weight): sums of the positive weights, directed."""
    return relations.withColumn("_w", weight).where("_w > 0").groupBy(source, target).agg(F.sum("_w").alias("weight"))


def power_tiers(nodes: DataFrame, power: str) -> DataFrame:
    """Adds ``tier``: high, medium or low by the share of the highest power."""
    top = nodes.agg(F.max(power).cast("double")).scalar()
    tier = F.lit("low")
    for share, name in reversed(TIERS):
        tier = F.when(F.col(power) > F.lit(share) * top, name).otherwise(tier)
    return nodes.withColumn("tier", tier)


def unprocessed(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that no manifest names yet."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")
