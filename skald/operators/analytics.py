"""Scores, series, graphs, similarity and folds over events and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spread import ROWS_PER_TASK, partitions_for

# Fixed values of the weight ladders (in tenths, so that sums are exact).
IMPORTANCE = {"revelation": 30, "decision": 20, "emotional": 20, "action": 10, "conversation": 5}
TENSION = {"revelation": 30, "decision": 20, "emotional": 20, "action": 10, "conversation": 3}
SENTIMENT = {"love": 3, "trust": 2, "admiration": 2, "friendship": 2, "ally": 1, "neutral": 0, "indifference": 0, "distrust": -1, "rivalry": -1, "fear": -2, "resentment": -2, "hatred": -3}
RANKS = {"none": 0, "low": 1, "medium": 2, "high": 3, "exceptional": 4}


def weight(kind: Column, weights: dict[str, int], default: int) -> Column:
    """The weight of each kind, the default for the rest."""
    out = None
    for k, v in weights.items():
        out = F.when(kind == k, v) if out is None else out.when(kind == k, v)
    return (out.otherwise(default) if out is not None else F.lit(default)).cast("long")


def top_scores(rows: DataFrame, key: str, score: Column, limit: int = 15) -> DataFrame:
    """The keys with the highest sums, ranked; ties by key."""
    summed = rows.groupBy(key).agg(F.sum(score).alias("score"))
    best = summed.orderBy(F.desc("score"), key).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)).cast("long"))


def trend(series: DataFrame, order: str, value: str, window: int) -> DataFrame:
    """Adds ``trend``: centred sums over the window, divided by it even at the edges (zero padding).

    For series of scenes, one row each: the caller aggregates first.
    """
    w = Window.orderBy(order).rowsBetween(-(window // 2), (window - 1) // 2)
    return series.withColumn("trend", F.sum(value).over(w) / F.lit(window))


def dominant(rows: DataFrame, entity: str, kind: str, order: str, least_total: int = 2, least_share: float = 0.6) -> DataFrame:
    """Per entity, its most frequent kind if frequent enough; ties go to the kind met first."""
    counts = rows.groupBy(entity, kind).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    w = Window.partitionBy(entity)
    ranked = counts.withColumn("total", F.sum("n").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc("n"), "_first", kind)))
    return ranked.where((F.col("_r") == 1) & (F.col("total") >= least_total) & (F.col("n") >= least_share * F.col("total"))).drop("_r", "_first")


def rising(rows: DataFrame, entity: str, late: Column, limit: int = 10) -> DataFrame:
    """Entities much more frequent late than early: late over 1.5 times early, two rows or more, by ratio."""
    counts = rows.groupBy(entity).agg(F.count_if(~late).alias("early"), F.count_if(late).alias("late"))
    found = counts.where((F.col("early") + F.col("late") >= 2) & (F.col("late") > 0) & (F.col("late") > 1.5 * F.col("early")))
    return found.withColumn("ratio", F.col("late") / F.greatest(F.col("early").cast("double"), F.lit(0.5))).orderBy(F.desc("ratio"), entity).limit(limit)


def undirected_edges(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, weight) with a < b, counted in either direction, without loops."""
    lo, hi = F.least(a, b).alias("a"), F.greatest(a, b).alias("b")
    return rows.where(F.col(a) != F.col(b)).groupBy(lo, hi).agg(F.count(F.lit(1)).alias("weight"))


def co_occurrence(rows: DataFrame, scene: str, entity: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Pairs of entities in one scene, a < b; scenes are small by nature (they are one conversation)."""
    own = rows.select(scene, entity).repartition(partitions_for(rows, rows_per_task), scene).distinct()
    other = own.select(F.col(scene), F.col(entity).alias("_other"))
    return own.join(other, scene).where(F.col(entity) < F.col("_other")).select(scene, F.col(entity).alias("a"), F.col("_other").alias("b"))


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("a").alias("node")).unionAll(edges.select(F.col("b").alias("node")))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def roles(rows: DataFrame, character: str, author: str) -> DataFrame:
    """Authors per character and the likely role: three or more NPC, one PC."""
    n = F.count_distinct(author)
    role = F.when(F.col("authors") >= 3, "NPC").when(F.col("authors") == 1, "PC (likely)").otherwise("PC/NPC (unclear)")
    return rows.groupBy(character).agg(n.alias("authors")).withColumn("role", role)


def containing_all(rows: DataFrame, scene: str, entity: str, asked: list) -> DataFrame:
    """Scenes that hold every asked entity."""
    return rows.where(F.col(entity).isin(asked)).groupBy(scene).agg(F.count_distinct(entity).alias("n")).where(F.col("n") == len(set(asked))).select(scene)


def cosine_top(vectors: DataFrame, query: list[float], id_column: str, vector_column: str, k: int) -> DataFrame:
    """The k vectors nearest to the query by cosine, exact."""
    q = F.array(*(F.lit(float(x)) for x in query))
    v = F.transform(vector_column, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    length = sum(float(x) ** 2 for x in query) ** 0.5
    score = F.try_divide(dot, norm * F.lit(length))
    return vectors.select(id_column, F.round(score, 5).alias("score")).orderBy(F.desc("score"), id_column).limit(k)


def names_match(a: Column, b: Column) -> Column:
    """Equal, one inside the other (4 letters or more), or few edits for the shorter's length."""
    short = F.least(F.length(a), F.length(b))
    inside = (short >= 4) & (F.contains(a, b) | F.contains(b, a))
    allowed = F.greatest(F.lit(1), F.floor(short / F.lit(5))).cast("int")
    return (a == b) | inside | (F.levenshtein(a, b) <= allowed)


def name_pairs(names: DataFrame, name: str) -> DataFrame:
    """Pairs (a < b) of distinct names that match.

    Candidates share a block: an edit-distance match of length n leaves one of
    (edits + 1) parts whole, and a contained name of 4 letters shares each of
    its 4-grams; so names meet on 4-grams, or, when short, on deletions of one
    letter.  Only candidates are compared.
    """
    own = names.select(F.col(name).alias("a")).where(F.length(name) > 0).distinct()
    n = F.length("a")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(F.col("a"), i, F.lit(2)))
    deletions = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("-"), F.substring(F.col("a"), F.lit(1), i - 1), F.substring(F.col("a"), i + 1, n)))
    # Up to 9 letters one edit is allowed: both names then share a deletion, or one is a deletion of the other.
    short = F.when(n <= 10, F.concat(deletions, F.array(F.concat(F.lit("-"), F.col("a"))))).otherwise(F.array().cast("array<string>"))
    # From 10 letters on, edits are at most a fifth, so half of the 2-grams survive at least one.
    blocks = own.select("a", F.explode(F.array_distinct(F.concat(grams, short))).alias("block"))
    other = blocks.select(F.col("a").alias("b"), "block")
    met = blocks.join(other, "block").where((F.col("a") < F.col("b")) & names_match(F.col("a"), F.col("b")))
    return met.select("a", "b").distinct()


def clusters(pairs: DataFrame) -> DataFrame:
    """(node, root) of the nodes of a link table: the least node reachable.

    Each round a node takes the least label of its neighbours and then that
    label's own label, so chains of any length shorten by halves.  With a
    checkpoint folder each round's labels are cut off from their lineage there;
    without one (a single machine) they are cached.
    """
    cut = (lambda df: df.checkpoint()) if pairs.sparkSession.sparkContext.getCheckpointDir() else (lambda df: df.cache())
    both = cut(pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    held = label = cut(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root")))
    while True:
        heard = both.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("heard"))
        best = label.join(heard, "node").select("node", F.col("root").alias("old"), F.least("root", "heard").alias("root"))
        upper = label.select(F.col("node").alias("root"), F.col("root").alias("upper"))
        moved = cut(best.join(upper, "root", "left").select("node", "old", F.least("root", F.coalesce("upper", "root")).alias("root")))
        settled = moved.where("root <> old").isEmpty()
        held.unpersist()
        if settled:
            both.unpersist()
            return moved.select("node", "root")
        held, label = moved, moved.select("node", "root")


def ordered(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Per key, the values in order as an array ``items`` (nulls skipped)."""
    sorted_ = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.transform(sorted_, lambda x: x["_v"]).alias("items"))


def ordered_union(items: Column, there: Column | None = None) -> Column:
    """What is ``there``, as it stands, then the items that it lacks in lower case, in order of first occurrence; case is ignored."""
    low = F.array_distinct(F.transform(items, F.lower))
    return low if there is None else F.concat(there, F.array_except(low, F.transform(there, F.lower)))


def axis_fold(items: Column) -> Column:
    """Pairwise half-even mean from the left: order matters."""
    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), F.get(items, F.lit(0)).cast("double"), lambda s, x: F.bround((s + x.cast("double")) / 2)).cast("long")


def keep_last(items: Column, n: int) -> Column:
    return F.slice(items, F.greatest(F.size(items) - (n - 1), F.lit(1)), n)


def longest_first(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Per key, the longest value; the earliest of equals."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(F.length(value), -F.col(order))).alias(value))


def override(manual: Column, other: Column) -> Column:
    """The manual value unless blank."""
    return F.coalesce(F.nullif(F.trim(manual), F.lit("")), other)
