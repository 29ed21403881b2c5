"""Routing of questions to intents by counting patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Intents in order of preference, each with patterns over lower-case text (English starter set; replace for other languages).
DEFAULT_INTENTS: dict[str, tuple[str, ...]] = {
    "events": ("what happened", "event", "happen"),
    "links": ("link", "relation", "between"),
    "importance": ("important", "key scene", "most"),
    "temporal": ("when", "time of day", "night"),
    "tension": ("tension", "conflict"),
}


def detect_intent(question: Column, intents: dict[str, tuple[str, ...]] = DEFAULT_INTENTS, fallback: str = "entity") -> Column:
    """The intent with most matching patterns; the first of equals; the fallback without any."""
    q = F.lower(F.coalesce(question, F.lit("")))
    scores = [F.struct(sum((q.rlike(p).cast("int") for p in patterns), F.lit(0)).alias("s"), F.lit(-i).alias("o"), F.lit(name).alias("name")) for i, (name, patterns) in enumerate(intents.items())]
    best = F.array_max(F.array(*scores))
    return F.when(best["s"] > 0, best["name"]).otherwise(F.lit(fallback))
