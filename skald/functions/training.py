"""Training examples for each step of the analysis, of scenes that somebody has confirmed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an example tells of the earlier steps: fixed values, in their order.
STEPS = ("when", "where", "who", "which", "what", "how")
EARLIER = {"what": ("when", "where", "who", "which"), "how": ("when", "where", "who", "which", "what")}
TOLD = "You analyse role-play transcripts and answer with JSON alone. Your step: {step}."


def _there(step: str) -> Column:
    """The step's record as JSON text, or null if there is none."""
    return F.when(~F.coalesce(F.trim(step), F.lit("")).isin("", "{}", "[]", "null"), F.col(step))


def _asked(step: str) -> Column:
    scene = F.concat(F.lit("Analyze this RP scene:\n---\n"), F.col("text"), F.lit("\n---"))
    earlier = [F.concat(F.lit(f"{s.upper()}:\n"), _there(s)) for s in EARLIER.get(step, ())]
    if not earlier:
        return scene
    told = F.concat_ws("\n\n", *earlier)
    return F.when(told != "", F.concat(scene, F.lit("\n\nContext from previous steps:\n"), told)).otherwise(scene)


def step_examples(confirmed: DataFrame, texts: DataFrame, steps: tuple[str, ...] = STEPS) -> DataFrame:
    """(scene, step, system, user, assistant) of confirmed(scene, status, and each step's record as JSON text) and texts(scene, text).

    Only scenes with the status ``confirmed`` and a text count; a step without a record gives no example.
    """
    rows = confirmed.where("status = 'confirmed'").join(texts.where("text <> ''").select("scene", "text"), "scene")
    each = [F.struct(F.lit(s).alias("step"), F.lit(TOLD.format(step=s)).alias("system"), _asked(s).alias("user"), _there(s).alias("assistant")) for s in steps]
    return rows.select("scene", F.explode(F.array(*each)).alias("e")).select("scene", "e.*").where("assistant is not null")


def chat_lines(examples: DataFrame) -> DataFrame:
    """(scene, step, line): each example as one line of chat JSON."""
    turn = lambda role: F.struct(F.lit(role).alias("role"), F.col(role).alias("content"))
    return examples.select("scene", "step", F.to_json(F.struct(F.array(*(turn(r) for r in ("system", "user", "assistant"))).alias("messages"))).alias("line"))


def examples_by_step(examples: DataFrame, steps: tuple[str, ...] = STEPS) -> DataFrame:
    """(step, n) of every step, also those without examples."""
    spark = examples.sparkSession
    names = reduce(DataFrame.unionAll, [spark.range(1).select(F.lit(s).alias("step")) for s in steps])
    return names.join(examples.groupBy("step").agg(F.count(F.lit(1)).alias("n")), "step", "left").select("step", F.coalesce("n", F.lit(0)).alias("n"))
