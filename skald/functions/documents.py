"""Documents made of rows: training examples, counts, Markdown and salvaged JSON."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dataset_triples(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, user_text, assistant_text): each user turn with the reply right after it."""
    asks = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("user_text"))
    replies = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("assistant_text"))
    return asks.join(replies, ["conv_id", "turn"])


def chat_json(system: str, user: Column, assistant: Column) -> Column:
    """One training example as JSON text."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.to_json(F.struct(F.array(turn("system", F.lit(system)), turn("user", user), turn("assistant", assistant)).alias("messages")))


def lore_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(category, n) of the tables."""
    return reduce(DataFrame.unionAll, (t.agg(F.lit(name).alias("category"), F.count(F.lit(1)).alias("n")).select("category", "n") for name, t in tables.items()))


def markdown_list(title: Column, items: Column) -> Column:
    return F.concat(F.lit("## "), title, F.lit("\n"), F.concat_ws("\n", F.transform(items, lambda x: F.concat(F.lit("- "), x))))


def salvage_json(text: str) -> dict | list:
    """Parse JSON; a truncated text loses its last partial token and gets its brackets, then its braces, closed.

    Brackets are counted before the cut.  Hopeless texts give {}.
    """
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        pass
    if not text:
        return {}
    tail = "]" * max(0, text.count("[") - text.count("]")) + "}" * max(0, text.count("{") - text.count("}"))
    body = text.rstrip()
    if body[-1:] not in ('"', "}", "]"):
        body = body[: max(map(body.rfind, ",{[:"))] if any(c in body for c in ",{[:") else ""
    try:
        return json.loads(body + tail)
    except ValueError:
        return {}
