"""The steps that turn exports into scenes: purge, subdivide and clean, on whole tables of messages.

Messages have an export, a scene within it (once purged), a place in it (pos),
author, content, content_en and ts.  Questions for a model are left to the
caller: ``decide`` gets the borderline groups alone, as one row each with the
texts to compare, and returns its answers as a column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import merges, sessions
from . import text as T

# Fixed values of the steps.
ACTION = r"\*[^*]{15,}\*"
OPENING_SHOWN, EDGE_SHOWN, PREVIEW = 5, 15, 120
TINY_SCENE = 10
FEWEST_TO_SPLIT = 4

#: Ways to write a message in a scene's text: with the author in front, in brackets, numbered, alone.
LINE_STYLES = ("author", "bracket", "numbered", "plain")

Decide = Callable[[DataFrame], DataFrame]


def said() -> Column:
    """What a message says: its translation unless empty, else the original, stripped."""
    return T.preferred(F.col("content_en"), F.col("content"))


def line(style: str, pos: Column, author: Column, text: Column, most: int | None = None) -> Column:
    """One message as a line; ``most``: at most so many characters of its text."""
    text = text if most is None else F.substring(text, 1, most)
    author = F.coalesce(author, F.lit("?"))
    return {
        "author": F.concat(author, F.lit(": "), text), "bracket": F.concat(F.lit("["), author, F.lit("]: "), text),
        "numbered": F.concat(F.lit("["), pos.cast("string"), F.lit("] "), author, F.lit(": "), text), "plain": text,
    }[style]


def scene_text(keys: list[str], style: str = "author", most: int | None = None, where: Column | None = None) -> Column:
    """Aggregate: the scene's messages as lines in order, those for which ``where`` holds."""
    one = F.struct("pos", line(style, F.col("pos"), F.col("author"), said(), most).alias("line"))
    one = one if where is None else F.when(where, one)
    return F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["line"]), "\n")


def _renumbered_pos(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.withColumn("pos", (F.row_number().over(Window.partitionBy(*keys).orderBy("pos")) - 1).cast("long"))


def purge(messages: DataFrame, gap_seconds: int = sessions.SESSION_GAP_SECONDS, least: int = sessions.MIN_SCENE_MESSAGES) -> DataFrame:
    """Messages without noise, in scenes by gaps between all messages; small scenes go, the rest count from 0 in each export.

    Messages without a time come first and open no scene.
    """
    order = [F.col("ts").asc_nulls_first(), F.col("pos")]
    marked = sessions.mark_sessions(messages, ["export"], "ts", "pos", gap_seconds).where(~T.drop_message(F.col("content")))
    sized = marked.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("export", "session"))).where(F.col("_n") >= least)
    placed = sized.withColumn("scene", (F.dense_rank().over(Window.partitionBy("export").orderBy("session")) - 1).cast("long"))
    return placed.withColumn("pos", (F.row_number().over(Window.partitionBy("export", "scene").orderBy(*order)) - 1).cast("long")).drop("_n", "session")


def trim_prefix(messages: DataFrame, keys: list[str], decide: Decide | None = None) -> DataFrame:
    """Without the talk before a scene's first action of 15 characters, where that talk is beside the play.

    The heuristics say keep, trim or ask; only groups to ask about reach
    ``decide``, as (keys, prefix, opening), and those for which its ``same`` is
    true stay (without ``decide``, none).  A scene without an action, or that
    begins with one, stays as it is.
    """
    shown = F.coalesce(F.nullif("content_en", F.lit("")), "content", F.lit(""))
    anchored = messages.withColumn("_anchor", F.min(F.when(shown.rlike(ACTION), F.col("pos"))).over(Window.partitionBy(*keys)))
    before = F.col("pos") < F.col("_anchor")
    verdicts = T.prefix_verdict(anchored.where(before).withColumn("_said", said()), keys, "_said")
    if decide is not None:
        asked = anchored.join(verdicts.where("verdict = 'ask'").select(*keys), keys, "left_semi")
        opening = (F.col("pos") >= F.col("_anchor")) & (F.col("pos") < F.col("_anchor") + OPENING_SHOWN)
        groups = asked.groupBy(*keys).agg(scene_text(keys, where=before).alias("prefix"), scene_text(keys, where=opening).alias("opening"))
        same = decide(groups).select(*keys, F.coalesce("same", F.lit(False)).alias("_same"))
        verdicts = verdicts.join(same, keys, "left")
    else:
        verdicts = verdicts.withColumn("_same", F.lit(False))
    keep = (F.col("verdict") == "keep") | ((F.col("verdict") == "ask") & F.coalesce("_same", F.lit(False)))
    cut = verdicts.where(~keep).select(*keys, F.lit(True).alias("_cut"))
    left = anchored.join(cut, keys, "left").where(F.col("_cut").isNull() | ~before)
    return left.drop("_anchor", "_cut")


def split_scenes(messages: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Adds ``part``: the messages of a scene from one boundary to the next.

    ``boundaries`` is (export, scene, boundaries array<int>), as a model gave
    them; those outside the scene, and all of a scene of less than four
    messages, count for nothing.
    """
    cuts = boundaries.select("export", "scene", F.array_distinct(F.filter(F.coalesce("boundaries", F.array().cast("array<int>")), lambda b: b >= 1)).alias("_cuts")).dropDuplicates(["export", "scene"])
    n = F.count(F.lit(1)).over(Window.partitionBy("export", "scene"))
    joined = messages.withColumn("_n", n).join(cuts, ["export", "scene"], "left")
    part = F.when(F.col("_n") >= FEWEST_TO_SPLIT, F.size(F.filter("_cuts", lambda b: (b <= F.col("pos")) & (b < F.col("_n")))))
    return joined.withColumn("part", F.coalesce(part, F.lit(0)).cast("long")).drop("_cuts", "_n")


def subdivide(messages: DataFrame, boundaries: DataFrame, decide: Decide | None = None, first: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(messages of the new scenes, annotation queue) of purged and translated messages.

    Scenes are split at the boundaries; an opening that repeats the kept part
    before goes; talk before the first action goes; what is too casual or not
    narrative is queued for annotation and takes a number of its own, the rest
    gets its score and flags and counts on from ``first`` (export, next), 0
    where that has no row.  The part before is the last one that its own
    messages, as they came, keep from the queue.
    """
    keys = ["export", "scene", "part"]
    parts = _renumbered_pos(split_scenes(messages, boundaries), keys).withColumn("_said", said())
    raw = T.scene_check(parts, keys, ["pos"], "_said").select(*keys, (~_queued(F.col("flags"))).alias("_kept"))
    line_ = Window.partitionBy("export").orderBy("scene", "part").rowsBetween(Window.unboundedPreceding, -1)
    before = raw.withColumn("_before", F.last(F.when(F.col("_kept"), F.struct("scene", "part")), ignorenulls=True).over(line_))
    norm = T.normalized(F.col("_said"))
    earlier = parts.select("export", F.struct("scene", "part").alias("_before"), norm.alias("_norm"))
    previous = before.join(earlier.where("_norm <> ''"), ["export", "_before"]).select(*keys, "_norm")
    fresh = sessions.duplicate_opening(parts.withColumn("_norm", norm), keys, "pos", "_norm", previous).drop("_norm", "_said")
    trimmed = _renumbered_pos(trim_prefix(fresh, keys, decide), keys)

    checked = T.scene_check(trimmed.withColumn("_said", said()), keys, ["pos"], "_said")
    number = (F.row_number().over(Window.partitionBy("export").orderBy("scene", "part")) - 1).cast("long")
    if first is None:
        numbered = checked.withColumn("number", number)
    else:
        numbered = checked.join(first.select("export", "next"), "export", "left").withColumn("number", number + F.coalesce("next", F.lit(0))).drop("next")
    queued = _queued(F.col("flags"))
    found = trimmed.join(numbered, keys)
    kept = found.where(~queued).select("export", F.col("scene").alias("source_scene"), F.col("number").alias("scene"), "pos", "author", "content", "content_en", "ts", "score", "flags")
    queue = found.where(queued).groupBy("export", "scene", "number", "score", "flags").agg(
        F.when(F.array_contains("flags", "too_casual"), "too_casual").otherwise("no_narrative").alias("reason"), F.count(F.lit(1)).alias("n_messages"),
        F.min_by(F.substring(said(), 1, PREVIEW), "pos").alias("preview"))
    return kept, queue.select("export", F.col("scene").alias("source_scene"), F.col("number").alias("scene"), "score", "flags", "reason", "n_messages", "preview")


def _queued(flags: Column) -> Column:
    return F.array_contains(flags, "too_casual") | F.array_contains(flags, "no_narrative")


def renumbered_by_time(messages: DataFrame) -> DataFrame:
    """Scenes of an export counted from 0 by the first known time in them (unknown first), then by their old number."""
    times = messages.groupBy("export", "scene").agg(F.min_by("ts", F.when(F.col("ts").isNotNull(), F.col("pos"))).alias("_first"))
    order = Window.partitionBy("export").orderBy(F.col("_first").asc_nulls_first(), "scene")
    places = times.select("export", "scene", (F.row_number().over(order) - 1).cast("long").alias("_place"))
    return messages.join(places, ["export", "scene"]).withColumn("scene", F.col("_place")).drop("_place")


def clean_scenes(messages: DataFrame, decide: Decide | None = None) -> DataFrame:
    """Scenes in order of time, without talk at their edges, short ones joined to what stands before, tiny ones gone, counted from 0.

    A scene of less than 15 messages may join the one before if ten days at
    most lie between; ``decide`` gets such pairs alone, as (export, scene,
    before, after, gap_hours), and those for which its ``same`` is true join
    (without it, all do).  What has less than 10 messages then goes.
    """
    keys = ["export", "scene"]
    ordered = renumbered_by_time(messages)
    inner = _renumbered_pos(sessions.trim_edges(ordered, keys, "pos", T.is_roleplay(said())), keys)
    sized = inner.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min_by("ts", "pos").alias("_start"), F.max_by("ts", "pos").alias("_end"))
    if decide is not None:
        gaps = merges.scene_gaps(sized, ["export"], ["scene"], "_start", "_end")
        near = F.col("gap_us").isNull() | (F.col("gap_us") <= merges.MAX_GAP_HOURS * 3600 * 1_000_000)
        first = F.row_number().over(Window.partitionBy("export").orderBy("scene")) == 1
        pairs = gaps.withColumn("_first", first).withColumn("_before", F.lag("scene").over(Window.partitionBy("export").orderBy("scene")))
        pairs = pairs.where((F.col("_n") < merges.SHORT_SCENE) & near & ~F.col("_first")).select(*keys, "_before", (F.col("gap_us") / 3.6e9).alias("gap_hours"))
        n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        shown = inner.withColumn("_n", n)
        heads = shown.groupBy(*keys).agg(scene_text(keys, most=PREVIEW, where=F.col("pos") < EDGE_SHOWN).alias("after"))
        tails = shown.groupBy("export", F.col("scene").alias("_before")).agg(scene_text(keys, most=PREVIEW, where=F.col("pos") >= F.col("_n") - EDGE_SHOWN).alias("before"))
        asked = pairs.join(heads, keys).join(tails, ["export", "_before"]).select(*keys, "before", "after", "gap_hours")
        sized = sized.join(decide(asked).select(*keys, F.col("same").alias("_same")), keys, "left")
    merged = merges.merge_short_scenes(sized, ["export"], ["scene"], "_n", "_start", "_end", None if decide is None else F.col("_same"))
    grown = inner.join(merged.select(*keys, "merged"), keys)
    whole = Window.partitionBy("export", "merged")
    kept = grown.withColumn("_size", F.count(F.lit(1)).over(whole)).where(F.col("_size") >= TINY_SCENE)
    placed = kept.withColumn("pos", (F.row_number().over(whole.orderBy("scene", "pos")) - 1).cast("long"))
    return renumbered_by_time(placed.withColumn("scene", F.col("merged")).drop("merged", "_size"))
