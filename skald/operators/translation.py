"""Translation that goes on where it stopped: only what is missing is packed into calls, and answers find their messages again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .model_calls import ask
from .sessions import TRANSLATE_BATCH

ANSWER = "messages array<struct<index: int, content_en: string>>"
INSTRUCTION = (
    "Translate these chat messages of a role-play from French to English. Keep style, names, *actions* and quotes.\n"
    'Answer with JSON: {"messages": [{"index": 0, "content_en": "..."}]}\n\n'
)

_KEYS = ["export", "scene"]


def _filled(text: str) -> Column:
    return F.nullif(F.col(text), F.lit(""))


def resumed(messages: DataFrame, done: DataFrame) -> DataFrame:
    """Messages with the translations that ``done`` (export, scene, pos, content_en) has; the latest row of a place must be unique there."""
    known = done.where(_filled("content_en").isNotNull()).select(*_KEYS, "pos", F.col("content_en").alias("_done"))
    return messages.join(known, [*_KEYS, "pos"], "left").withColumn("content_en", F.coalesce("_done", _filled("content_en"))).drop("_done")


def packed(messages: DataFrame, size: int = TRANSLATE_BATCH) -> DataFrame:
    """(export, scene, batch, prompt, places): one row for each call, with up to ``size`` messages of a scene that lack a translation."""
    n = F.row_number().over(Window.partitionBy(*_KEYS).orderBy("pos")) - 1
    missing = messages.where(_filled("content_en").isNull()).withColumn("_n", n).withColumn("batch", F.floor(F.col("_n") / size).cast("long"))
    one = F.struct(F.col("_n"), F.col("pos"), F.concat(F.lit("["), (F.col("_n") % size).cast("string"), F.lit("] "), F.coalesce("content", F.lit(""))).alias("line"))
    rows = F.array_sort(F.collect_list(one))
    calls = missing.groupBy(*_KEYS, "batch").agg(rows.alias("_rows"))
    lines = F.array_join(F.transform("_rows", lambda r: r["line"]), "\n")
    return calls.select(*_KEYS, "batch", F.concat(F.lit(INSTRUCTION), lines).alias("prompt"), F.transform("_rows", lambda r: r["pos"]).alias("places"))


def unpacked(answered: DataFrame) -> DataFrame:
    """(export, scene, pos, answer) of calls with their ``answer``: by index, the last of equal ones; what has no index in the call is nobody's."""
    each = answered.select(*_KEYS, "places", F.posexplode("answer.messages").alias("_at", "_m")).where(F.col("_m.index").isNotNull())
    placed = each.select(*_KEYS, "_at", F.when(F.col("_m.index") >= 0, F.get("places", F.col("_m.index"))).alias("pos"), F.coalesce("_m.content_en", F.lit("")).alias("answer"))
    return placed.where("pos is not null").groupBy(*_KEYS, "pos").agg(F.max_by("answer", "_at").alias("answer"))


def translate(messages: DataFrame, done: DataFrame, open_caller: Callable[[], Callable[[str], str]], size: int = TRANSLATE_BATCH) -> DataFrame:
    """Messages with ``content_en``: what is there or in ``done`` stays and is not asked again, the rest is asked for.

    A message that an answer leaves out keeps its original text; one answered
    with an empty text stays empty, so that the next run asks again.
    """
    known = resumed(messages, done)
    answers = unpacked(ask(packed(known, size), F.col("prompt"), open_caller, ANSWER))
    joined = known.join(answers, [*_KEYS, "pos"], "left")
    return joined.withColumn("content_en", F.coalesce("content_en", "answer", "content", F.lit(""))).drop("answer")


def passthrough(messages: DataFrame) -> DataFrame:
    """The original text wherever there is no translation."""
    return messages.withColumn("content_en", F.coalesce(_filled("content_en"), "content", F.lit("")))
