"""Which names occur inside which texts, without comparing every name with every text.

A text is indexed under its grams of a few sizes; a name is looked up under
the rarest gram of its largest size.  Only texts that hold this gram are
compared, so a name is met by the fewest texts that the index can tell, and a
gram that is everywhere is used by names alone that have no other.  The grams
of whole texts are numbers made in numpy; what leaves a task are those that
names ask for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sizes of grams; those of up to ``EXACT`` letters are numbered one to one, so a name of that size needs no comparison.
SIZES, EXACT = (1, 2, 3, 6, 12), 3
#: Letters that are cut into grams at once.
CHUNK = 1 << 20
#: Most grams that go to all tasks as the ones asked for; with more, the join alone keeps what is asked for.
MOST_ASKED = 1 << 20
#: Bytes of an Arrow batch between the JVM and Python, at most.
BATCH_BYTES, _BATCH_KEY = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs of numbers."""
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x7F4A7C15) + (a >> np.uint64(7)))
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _grams(points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(size, number of the gram at each place) of all sizes; numbers of hashed sizes are negative as signed ones, the others are not."""
    one = points.astype(np.uint64) + np.uint64(1)
    held = None
    for size in SIZES:
        if len(one) < size:
            return
        if size <= EXACT:
            held = one if size == 1 else (held[: len(one) - size + 1] << np.uint64(21)) | one[size - 1 :]
            yield size, held.view(np.int64)
        else:
            half = size // 2
            held = _mixed(held[: len(one) - size + 1], held[half : half + len(one) - size + 1])
            yield size, (held | np.uint64(1 << 63)).view(np.int64)


class _Asked:
    """A set of grams: a bitmap rules most others out before the set is searched."""

    def __init__(self, grams: np.ndarray):
        self.grams = np.sort(grams)
        bits = max(16, int(16 * len(grams)).bit_length())
        self.shift, self.map = np.uint64(64 - bits), np.zeros(1 << bits, bool)
        self.map[self._place(self.grams)] = True

    def _place(self, grams: np.ndarray) -> np.ndarray:
        return ((grams.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, grams: np.ndarray) -> np.ndarray:
        """The places of those that are in the set."""
        at = np.flatnonzero(self.map[self._place(grams)])
        if not len(self.grams):
            return at[:0]
        near = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
        return at[self.grams[near] == grams[at]]


def _pieces(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(first text, texts) of about ``CHUNK`` letters; a longer text stands alone in several pieces that overlap."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield first, texts[first:i]
            first, size = i, 0
        if len(t) > CHUNK:
            for j in range(0, len(t), CHUNK):
                yield i, [t[j : j + CHUNK + SIZES[-1] - 1]]
            first, size = i + 1, 0
        else:
            size += len(t)
    if first < len(texts):
        yield first, texts[first:]


def _held(texts: list[str], asked: _Asked | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, gram), each once in a piece, of the grams that are asked for (None: all)."""
    for first, some in _pieces(texts):
        points = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32)
        end = np.cumsum([len(t) for t in some])
        rows, grams = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size, made in _grams(points):
            at = asked.find(made) if asked else np.arange(len(made))
            row = np.searchsorted(end, at, "right")
            inside = at + size <= end[row]
            rows.append(row[inside]), grams.append(made[at[inside]])
        row, gram = np.concatenate(rows), np.concatenate(grams)
        order = np.lexsort((gram, row))
        row, gram = row[order], gram[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
        yield row[new] + first, gram[new]


def _over_texts(rows: DataFrame, made: Callable, schema: T.StructType) -> DataFrame:
    """``made(keys, texts)`` for each batch of (key, text) rows gives columns of the schema, any number of times."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for columns in made(batch.column(0), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=schema.names)

    rows.sparkSession.conf.set(_BATCH_KEY, str(BATCH_BYTES))
    return rows.mapInArrow(run, schema)


def _name_grams(names: DataFrame) -> DataFrame:
    """(name, gram) of the grams of each name's largest size."""

    def made(keys: pa.Array, texts: list[str]):
        largest = np.array([max(s for s in SIZES if s <= len(t)) for t in texts], np.int64)
        own = {s: [t for t, n in zip(texts, largest) if n == s] for s in SIZES}
        for size, some in own.items():
            for first, part in _pieces(some):
                points = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
                end = np.cumsum([len(t) for t in part])
                grams = dict(_grams(points)).get(size, np.zeros(0, np.int64))
                at = np.arange(len(grams))
                row = np.searchsorted(end, at, "right")
                inside = at + size <= end[row]
                yield pa.array([some[first + i] for i in row[inside].tolist()], pa.string()), grams[inside]

    return _over_texts(names.select("name", F.col("name").alias("_text")), made, T.StructType([names.schema["name"], T.StructField("gram", T.LongType())])).distinct()


def _asked_of(grams: DataFrame):
    """The distinct grams for all tasks, or None if they are too many."""
    found = grams.select("gram").distinct().limit(MOST_ASKED + 1).toArrow()["gram"].to_numpy()
    return grams.sparkSession.sparkContext.broadcast(_Asked(found) if len(found) <= MOST_ASKED else None)


def names_in_texts(names: DataFrame, name: str, texts: DataFrame, key: str, text: str) -> DataFrame:
    """(name, key) of every distinct name, in lower case, that occurs in the text with that key, case ignored.

    ``key`` is unique among the texts.  Null and empty names occur nowhere.
    With a checkpoint folder the names' grams are kept there, without one they are cached.
    """
    cut = (lambda df: df.checkpoint()) if names.sparkSession.sparkContext.getCheckpointDir() else (lambda df: df.cache())
    given = names.where(F.length(F.col(name)) > 0).select(F.lower(F.col(name)).alias("name")).distinct()
    whole = texts.select(F.col(key).alias("key"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_text"))
    parts = cut(_name_grams(given))
    wanted = _asked_of(parts)

    def tally(keys: pa.Array, some: list[str]):
        for _, gram in _held(some, wanted.value):
            yield np.unique(gram, return_counts=True)

    counts = _over_texts(whole, tally, T.StructType([T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])).groupBy("gram").agg(F.sum("n").alias("n"))
    # A name with a gram that no text holds is in none.
    counted = parts.join(counts, "gram", "left")
    rarest = cut(counted.groupBy("name").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"), F.min(F.coalesce("n", F.lit(0))).alias("n")).where("n > 0").select("name", "gram"))
    chosen = _asked_of(rarest)

    def hits(keys: pa.Array, some: list[str]):
        for row, gram in _held(some, chosen.value):
            yield keys.take(pa.array(row)), gram

    held = _over_texts(whole, hits, T.StructType([whole.schema["key"], T.StructField("gram", T.LongType())]))
    met = held.join(rarest, "gram").select("name", "key")
    short = F.length("name") <= EXACT
    compared = met.where(~short).distinct().join(whole, "key").where(F.contains("_text", "name")).select("name", "key")
    return met.where(short).distinct().union(compared)


def details_of(entities: DataFrame, details: DataFrame) -> DataFrame:
    """Records of an entity's scenes that are about it: rows of details(scene, canonical_name, ...) with the entity's ``name``.

    ``entities`` is (name, appearances); a record is about the entity if its
    canonical name holds the entity's, case ignored; of several in a scene the
    first by ``pos`` is it.  Only records of one scene meet.
    """
    seen = entities.where(F.length("name") > 0).select("name", F.explode(F.array_distinct("appearances")).alias("scene"))
    met = seen.join(details, "scene").where(F.contains(F.lower("canonical_name"), F.lower("name")))
    first = F.row_number().over(Window.partitionBy("name", "scene").orderBy("pos"))
    return met.withColumn("_first", first).where("_first = 1").drop("_first")
