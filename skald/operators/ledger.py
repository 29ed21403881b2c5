"""The ledger of scenes: what each scene was about, corrected once its analysis is there, and shown to the scenes after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the ledger.
ACTION_SHOWN, TENSION_SHOWN, TENSIONS_KEPT, CAST_SHOWN, TENSIONS_SHOWN = 80, 120, 4, 4, 2
ENTRY = "scene string, narrative string, characters array<struct<name: string, action: string>>, tensions array<string>, corrected boolean"
_CAST = "array<struct<name: string, action: string>>"


def appended(ledger: DataFrame, entries: DataFrame) -> DataFrame:
    """The ledger with the entries of scenes that it lacks; what is there stays."""
    return ledger.unionByName(entries.join(ledger.select("scene"), "scene", "left_anti").select(ledger.columns))


def corrected(ledger: DataFrame, who: DataFrame, what: DataFrame) -> DataFrame:
    """The ledger with the entries of analysed scenes made anew: who(scene, characters), what(scene, summary, events(description, type, characters)).

    A character did what the first event with it says (80 characters), else it
    was present; tensions are the first four revelations and decisions (120
    characters); the narrative is the summary, else what it was.
    """
    both = who.select("scene", F.col("characters").alias("_cast")).join(what.select("scene", "summary", "events"), "scene", "full")
    events = F.filter(F.coalesce("events", F.array().cast("array<struct<description: string, type: string, characters: array<string>>>")), lambda e: F.coalesce(e["description"], F.lit("")) != "")
    names = F.filter(F.coalesce("_cast", F.array().cast("array<string>")), lambda c: F.coalesce(c, F.lit("")) != "")

    def action(name: Column) -> Column:
        first = F.get(F.filter(events, lambda e: F.array_contains(e["characters"], name)), F.lit(0))
        return F.coalesce(F.substring(first["description"], 1, ACTION_SHOWN), F.lit("present"))

    cast_ = F.transform(names, lambda c: F.struct(c.alias("name"), action(c).alias("action")))
    tense = F.transform(F.filter(events, lambda e: e["type"].isin("revelation", "decision")), lambda e: F.substring(e["description"], 1, TENSION_SHOWN))
    made = both.select("scene", F.nullif("summary", F.lit("")).alias("_summary"), cast_.cast(_CAST).alias("_characters"), F.slice(tense, 1, TENSIONS_KEPT).alias("_tensions"), F.lit(True).alias("_made"))
    joined = ledger.join(made, "scene", "full")
    pick = lambda new, old: F.when(F.col("_made"), F.col(new)).otherwise(F.col(old))
    return joined.select(
        "scene", F.coalesce("_summary", "narrative", F.lit("")).alias("narrative"), pick("_characters", "characters").alias("characters"), pick("_tensions", "tensions").alias("tensions"),
        F.coalesce("_made", "corrected", F.lit(False)).alias("corrected"),
    )


def _tensions() -> Column:
    shown = F.slice(F.coalesce("tensions", F.array().cast("array<string>")), 1, TENSIONS_SHOWN)
    return F.when(F.size(shown) > 0, F.concat(F.lit("  [tensions: "), F.array_join(shown, "; "), F.lit("]"))).otherwise("")


def scene_synthesis(ledger: DataFrame) -> DataFrame:
    """(scene, synthesis): a scene's own entry in brief, without its cast; ``none`` where it says nothing."""
    text = F.concat(F.coalesce("narrative", F.lit("")), _tensions())
    return ledger.select("scene", F.coalesce(F.nullif(text, F.lit("")), F.lit("none")).alias("synthesis"))


def entry_line(ledger: DataFrame) -> DataFrame:
    """(scene, line): an entry as the scenes after it see it."""
    cast_ = F.filter(F.slice(F.coalesce("characters", F.array().cast(_CAST)), 1, CAST_SHOWN), lambda c: F.coalesce(c["name"], F.lit("")) != "")
    names = F.transform(cast_, lambda c: F.concat(c["name"], F.lit(" ("), F.coalesce(c["action"], F.lit("")), F.lit(")")))
    chars = F.when(F.size(names) > 0, F.concat(F.lit("  [chars: "), F.array_join(names, ", "), F.lit("]"))).otherwise("")
    return ledger.select("scene", F.concat(F.lit("- "), F.col("scene"), F.lit(": "), F.coalesce("narrative", F.lit("")), chars, _tensions()).alias("line"))
