"""Vector search for many questions at once: every cell of a grid of questions and vectors is one group.

Questions and vectors are dealt into parts of bounded size, and each part of
the one meets each part of the other in one task.  A cell gives the best ``k``
of its own vectors for each of its questions.  Nothing but two counts goes
through the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of question vectors that a task compares at once.
BLOCK_BYTES = 8 << 20
#: Bytes of question vectors, and of other vectors, that meet in one cell.
CELL_BYTES = 16 << 20
_PLACES = 9


def embedded(rows: DataFrame, text: str, open_embedder: Callable[[], Callable[[list[str]], np.ndarray]], into: str = "embedding") -> DataFrame:
    """Adds the vector of each text (array<double>); ``open_embedder`` runs once a task; null and empty texts have none."""
    names = [*rows.columns, into]
    at = rows.columns.index(text)

    def run(it):
        embed = None
        for batch in it:
            embed = embed or open_embedder()
            texts = batch.column(at).to_pylist()
            given = [i for i, t in enumerate(texts) if t]
            made: list = [None] * len(texts)
            if given:
                for i, v in zip(given, np.asarray(embed([texts[i] for i in given]), float)):
                    made[i] = v.tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.float64()))], names=names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(into, T.ArrayType(T.DoubleType()))]))


def _matrix(column: pa.ChunkedArray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the rows that have ``dims`` numbers and a length, and which rows these are."""
    fits = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dims), False).to_numpy())
    flat = pc.list_flatten(column.take(pa.array(fits)))
    m = flat.to_numpy().astype(float).reshape(len(fits), dims)
    whole = pc.is_valid(flat).to_numpy().reshape(len(fits), dims).all(1)
    size = np.linalg.norm(m, axis=1)
    good = whole & (size > 0)
    return m[good] / size[good, None], fits[good]


def nearest(questions: DataFrame, question: str, vectors: DataFrame, key: str, embedding: str, k: int, category: str | None = None, block_bytes: int = BLOCK_BYTES, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """(question, key, category, score, place): the ``k`` rows of highest cosine for each question, best first; ties go to the smaller key.

    Questions are unique and have the vector column of the same name, and, with
    ``category``, only rows of their own category count where theirs is not
    null.  A vector of another length than the question's, or of length zero,
    is no match.  Scores count to nine places.
    """
    size = questions.select(F.size(embedding).alias("n")).agg(F.max("n"), F.count(F.lit(1))).first()
    width = 8 * max(size[0] or 1, 1)
    parts, blocks = (max(1, -(-n * width // cell_bytes)) for n in (size[1], vectors.count()))
    at = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n).cast("long"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    kind = (F.col(category) if category else F.lit(None)).cast("string").alias("category")
    asked = questions.where(F.col(embedding).isNotNull()).select(at(question, parts).alias("_part"), every(blocks).alias("_block"), F.col(question).alias("question"), F.col(embedding).alias("v"), kind)
    given = vectors.where(F.col(embedding).isNotNull()).select(every(parts).alias("_part"), at(key, blocks).alias("_block"), F.col(key).alias("key"), F.col(embedding).alias("v"), kind)
    out = T.StructType([asked.schema["question"], given.schema["key"], T.StructField("category", T.StringType()), T.StructField("score", T.DoubleType())])
    cells = asked.groupBy("_part", "_block").cogroup(given.groupBy("_part", "_block"))
    found = cells.applyInArrow(lambda q, v: _best_of(q, v, k, max(1, block_bytes // width)), out)
    order = Window.partitionBy("question").orderBy(F.desc("score"), "key")
    ranked = found.withColumn("place", (F.row_number().over(order) - 1).cast("long")).where(F.col("place") < k)
    return ranked.select("question", "key", "category", "score", "place")


def _best_of(asked: pa.Table, given: pa.Table, k: int, rows: int) -> pa.Table:
    """The best ``k`` of a cell's vectors for each of its questions; ``rows`` questions are compared at once."""
    given = given.take(pc.sort_indices(given["key"]))  # of equal scores the first is that of the smaller key
    kinds, wanted = (np.array(t["category"].to_pylist(), object) for t in (given, asked))
    q_at, v_at, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for dims in pc.unique(pc.list_value_length(asked["v"])).to_pylist():
        (q, q_rows), (v, v_rows) = _matrix(asked["v"], dims), _matrix(given["v"], dims)
        for kind in set(wanted[q_rows].tolist()):
            own = np.flatnonzero(wanted[q_rows] == kind)
            fit = np.flatnonzero(kinds[v_rows] == kind) if kind is not None else np.arange(len(v_rows))
            if not len(fit):
                continue
            others = v[fit].T
            for first in range(0, len(own), rows):
                some = own[first : first + rows]
                score = np.round(q[some] @ others, _PLACES)
                # Ties at the border stay in until keys decide.
                low = np.partition(score, len(fit) - k, axis=1)[:, len(fit) - k] if len(fit) > k else np.full(len(some), -np.inf)
                for line, least, row in zip(score, low, q_rows[some].tolist()):
                    near = np.flatnonzero((line >= least) & np.isfinite(line))
                    near = near[np.argsort(-line[near], kind="stable")[:k]]
                    q_at.append(np.full(len(near), row)), v_at.append(v_rows[fit[near]]), scores.append(line[near])
    v_all = pa.array(np.concatenate(v_at))
    return pa.table({"question": asked["question"].take(pa.array(np.concatenate(q_at))), "key": given["key"].take(v_all), "category": given["category"].take(v_all), "score": pa.array(np.concatenate(scores))})


def named_or_near(named: DataFrame, near: DataFrame, question: str, name: str) -> DataFrame:
    """(question, name, by_name): what a question names, and what the search found for it; each once."""
    both = named.select(question, F.lower(name).alias(name), F.lit(True).alias("by_name")).union(near.select(question, F.lower(name).alias(name), F.lit(False)))
    return both.groupBy(question, name).agg(F.bool_or("by_name").alias("by_name"))


def identified(questions: DataFrame, question: str, named: DataFrame, near: DataFrame, name: str, order: str) -> DataFrame:
    """(question, name): the first entity by ``order`` that a question names, else the nearest (place 0), else null."""
    first = named.groupBy(question).agg(F.min_by(name, order).alias("_first"))
    top = near.where("place = 0").select(question, F.col(name).alias("_top"))
    return questions.select(question).join(first, question, "left").join(top, question, "left").select(question, F.coalesce("_first", "_top").alias(name))


def context_block(hits: DataFrame, question: str, category: str, name: str, summary: str, order: str) -> DataFrame:
    """(question, context): the hits as lines ``[category] name: summary``, best first."""
    text = F.concat(F.lit("["), F.col(category), F.lit("] "), F.col(name), F.lit(": "), F.coalesce(summary, F.lit("")))
    lines = F.array_sort(F.collect_list(F.struct(order, text.alias("line"))))
    return hits.groupBy(question).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("context"))


def indexed(entities: DataFrame, category: Column, card: Column, open_embedder: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """(category, name, summary, embedding) of all entities with a name: the summary that is there, else a card of the record."""
    rows = entities.where(F.coalesce(F.trim("name"), F.lit("")) != "")
    rows = rows.select(category.alias("category"), "name", F.coalesce(F.nullif(F.col("_summary"), F.lit("")), card).alias("summary"))
    return embedded(rows, "summary", open_embedder)
