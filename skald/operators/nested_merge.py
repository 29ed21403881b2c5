"""Merges of whole nested records by rules: each field of a record has the rule by which partial records of one key fold into it.

Scalars fold by aggregates that combine on the map side.  The items of all list
fields go through one grouping by (key, field, item), so that a key with very
many partial records brings only its distinct items together.  ``place`` orders
the partial records; where two have the same, the smaller value counts as
earlier.  Empty texts and nulls say nothing; comparisons ignore case.

Rules: ``longest`` text (the earliest of equals), ``first`` and ``last`` that is
known, ``started`` (the first record's own text even where it says unknown, else
the first known), ``union`` of lists in order of first occurrence, ``recent`` the
same but its last five, ``relations`` a union of (character, relation), ``rank``
the highest of a scale for each entry of a map, ``axis`` the pairwise half-even
mean for each entry, ``entries`` the last value for each entry, ``events`` all
structs with a description, ``joined`` all texts.  A rule with ``_low`` puts texts
in lower case.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .analytics import axis_fold
from .merges import items_in_order

# Fixed values of the merges.
RANKS = {"none": 0, "low": 1, "medium": 2, "high": 3, "exceptional": 4}
RECENT_ITEMS = 5

_LISTS = ("appellations", "likes", "dislikes", "beliefs", "main_locations", "misc", "affiliations", "wounds", "secrets")

#: Chunks of a scene into one record.
CHARACTER_CHUNKS = {
    **dict.fromkeys(("description_physical", "description_psychological", "job", "author"), "longest"), **dict.fromkeys(_LISTS, "union"), "relations": "relations",
    **dict.fromkeys(("goals_short_term", "goals_long_term"), "union"), **dict.fromkeys(("gender", "age", "species"), "started"),
}
CONCEPT_CHUNKS = {**dict.fromkeys(("description", "significance"), "longest"), **dict.fromkeys(("appellations", "related_characters", "allies", "enemies"), "union")}
VOICE_CHUNKS = {
    **dict.fromkeys(("avg_sentence_length", "formality_level", "vocabulary_register", "communication_style", "dialogue_vs_action_ratio"), "last"),
    **dict.fromkeys(("speech_quirks", "recurring_themes_in_speech"), "union_low"), "roleplay_prompt": "longest", "style_break": "first",
}
WHAT_CHUNKS = {"summary": "joined", "events": "events"}

#: Scenes into the record that lasts.
CHARACTER_SCENES = {
    **dict.fromkeys(("description_physical", "description_psychological", "job", "author"), "longest_low"), **dict.fromkeys(("gender", "age", "species"), "last_low"), **dict.fromkeys(_LISTS, "union_low"),
    **dict.fromkeys(("goals_short_term", "goals_long_term"), "union_low"), "relations": "relations", "dominant_emotions": "recent_low", "emotional_triggers": "union_low", "emotional_range": "last",
    "personality_axes": "axis", "competency_axes": "rank", "appearances": "union",
}
VOICE_SCENES = {**VOICE_CHUNKS, "roleplay_prompt": "last", "scenes_analyzed": "union"}
VOICE_SCENES.pop("style_break")


def _said(c: str) -> Column:
    return F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))


def _known(value: Column) -> Column:
    return F.when(F.lower(value) != "unknown", value)


def _earliest(value: Column, at: str) -> Column:
    return F.min_by(value, F.when(value.isNotNull(), F.struct(F.col(at), value)))


_SCALARS: dict[str, Callable[[str, str], Column]] = {
    "longest": lambda c, at: F.min_by(_said(c), F.when(_said(c).isNotNull(), F.struct(-F.length(_said(c)), F.col(at), _said(c)))),
    "first": lambda c, at: _earliest(_known(_said(c)), at),
    "last": lambda c, at: F.max_by(_known(_said(c)), F.when(_known(_said(c)).isNotNull(), F.struct(F.col(at), _said(c)))),
    "started": lambda c, at: F.coalesce(F.min_by(_said(c), F.struct(F.col(at), _said(c))), _earliest(F.lower(_known(_said(c))), at)),
    "joined": lambda c, at: F.array_join(items_in_order(_said(c), [at]), " "),
    "events": lambda c, at: F.flatten(items_in_order(F.filter(c, lambda e: F.coalesce(e["description"], F.lit("")) != ""), [at])),
}
_ITEMS = ("union", "recent", "relations")
_MAPS = ("rank", "axis", "entries")


def _tagged(field: str) -> Callable[[Column, Column], Column]:
    return lambda x, n: F.struct(F.lit(field).alias("field"), n.alias("n"), F.lower(x).alias("id"), x.alias("item"))


def _of_field(field: str) -> Callable[[Column], Column]:
    return lambda i: i["field"] == field


def _item_rows(rows: DataFrame, key: str, at: str, lists: dict[str, str]) -> DataFrame:
    """(key, field, id, item, at, n): the items of all list fields, each once for a key and field, where it first occurs."""
    none = F.array().cast("array<struct<field: string, n: int, id: string, item: string>>")
    parts = []
    for name, rule in lists.items():
        if rule.startswith("relations"):
            given = F.filter(F.coalesce(name, F.array().cast("array<struct<character: string, relation: string>>")), lambda r: F.coalesce(r["character"], F.lit("")) != "")
            texts = F.transform(given, lambda r: F.concat_ws("\x1f", F.lower(r["character"]), F.lower(F.coalesce(r["relation"], F.lit("")))))
        else:
            texts = F.filter(F.coalesce(F.col(name).cast("array<string>"), F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")
        parts.append(F.transform(texts, _tagged(name)))
    each = rows.select(F.col(key), F.col(at).alias("_at"), F.explode(F.concat(none, *parts)).alias("_i")).select(key, "_at", "_i.*")
    place = F.struct("_at", "n", "item")
    return each.groupBy(key, "field", "id").agg(F.min(place).alias("place"))


def merge_records(rows: DataFrame, key: str, at: str, rules: dict[str, str]) -> DataFrame:
    """One record per key (lower case, outer white space off), every field folded by its rule; rows with an empty key are left out."""
    given = rows.withColumn("_key", F.lower(F.trim(key))).where(F.coalesce("_key", F.lit("")) != "")
    base = lambda rule: rule.removesuffix("_low")
    scalars = {c: r for c, r in rules.items() if base(r) in _SCALARS}
    lists = {c: r for c, r in rules.items() if base(r) in _ITEMS}
    maps = {c: r for c, r in rules.items() if base(r) in _MAPS}
    if left := set(rules) - {*scalars, *lists, *maps}:
        raise ValueError(f"no such rule: {sorted(left)}")
    out = given.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), *(_SCALARS[base(r)](c, at).alias(c) for c, r in scalars.items()))
    for c, r in scalars.items():
        out = out.withColumn(c, F.lower(c)) if r.endswith("_low") else out
    if lists:
        items = _item_rows(given, "_key", at, lists)
        found = items.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("field", "place"))).alias("_items"))
        out = out.join(found, "_key", "left")
        for c, r in lists.items():
            own = F.transform(F.filter(F.coalesce("_items", F.array().cast(found.schema["_items"].dataType)), _of_field(c)), lambda i: i["place"]["item"])
            own = F.transform(own, F.lower) if r.endswith("_low") else own
            if base(r) == "recent":
                own = F.slice(own, F.greatest(F.lit(1), F.size(own) - RECENT_ITEMS + 1), RECENT_ITEMS)
            if base(r) == "relations":
                own = F.transform(own, lambda x: F.struct(F.split_part(x, F.lit("\x1f"), F.lit(1)).alias("character"), F.split_part(x, F.lit("\x1f"), F.lit(2)).alias("relation")))
            out = out.withColumn(c, own)
        out = out.drop("_items")
    for c, r in maps.items():
        out = out.join(_merged_map(given, at, c, base(r)), "_key", "left")
        out = out.withColumn(c, F.coalesce(c, F.create_map().cast(dict(out.dtypes)[c])))
    return out.select(F.col("_key").alias(key), *rules)


def _merged_map(rows: DataFrame, at: str, name: str, rule: str) -> DataFrame:
    each = rows.select("_key", F.col(at).alias("_at"), F.explode(name).alias("entry", "value"))
    if rule == "axis":
        number = F.col("value").try_cast("int")
        folded = each.where(number.isNotNull()).groupBy("_key", "entry").agg(axis_fold(items_in_order(number, ["_at"])).cast("int").alias("value"))
    elif rule == "rank":
        level = F.nullif(F.lower(F.col("value")), F.lit(""))
        rank = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in RANKS.items() for x in kv)), level), F.lit(0))
        folded = each.where(level.isNotNull()).groupBy("_key", "entry").agg(F.min_by(level, F.struct(-rank, "_at", level)).alias("value"))
    else:
        folded = each.where("value is not null").groupBy("_key", "entry").agg(F.max_by("value", F.struct("_at", "value")).alias("value"))
    return folded.groupBy("_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("entry", "value")))).alias(name))


def compiled(rows: DataFrame, name: str, order: str) -> DataFrame:
    """A general table: one whole row per name, the last in order; rows without a name are left out."""
    rest = [c for c in rows.columns if c != name]
    last = F.max_by(F.struct(*rest), F.col(order)).alias("_row")
    return rows.where(F.coalesce(F.col(name), F.lit("")) != "").groupBy(name).agg(last).select(name, "_row.*").select(rows.columns)
