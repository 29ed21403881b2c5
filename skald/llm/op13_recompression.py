"""Removal of word windows that an earlier document holds, by recompression.

Rounds replace runs of equal symbols and pairs of symbols by new ones.  A pair
is replaced where its first symbol is of the left kind and its second of the
right kind in that round; the kinds, and the name of what is made, are hashes of
the round and the symbols, so that all executors give the same run or pair the
same name without an exchange.  What happens to a symbol depends on its
neighbours alone; so equal passages have equal symbols inside, but for some at
their ends, and each symbol here knows the words that decide it (its context).

1. After ``base_rounds``, each name whose context fits in a window asks Spark
   which documents hold it.  Rounds go on up to the whole document; some upper
   levels, of symbols of at least a window, ask for their first document.
2. A symbol of an upper level that an earlier document holds settles all
   windows inside.  Of the others, those are candidates whose base symbols are
   all in more than one document; they ask for their first document by two
   hashes of their words (128 bits), which verifies what the names revealed.
3. The words of settled windows go.

Two names that clash by accident on the base level only make more candidates;
those of upper levels are told apart by a second hash of their words.

Within a wave of documents (some chunks of a partition) a name asks once, for
its first document there, and settles the others there and then: a name in a
third of all documents is one row for each wave.  Groups are met by a window function over (name, hash),
which spills, and give no pairs.

Defined results: a null text counts as empty and has no words; a null id counts
as the largest; of rows with equal ids none takes from another; repeated rows
are alike; texts of any length are read whole (one is a chunk of its own);
fewer words than a window stay; a table without rows gives none.  ``drop_repeats``
keeps all columns and replaces those that have the names of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import batches as B
from .durable import Scratch

CHUNK_BYTES = 1 << 20

#: Names gathered, over chunks, before they are sent.
ASKED = 600_000

_LAST = (1 << 63) - 1
_SECOND = B.mix64(np.arange(1001, 1257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@dataclass(frozen=True)
class Recompression:
    window: int = 13
    #: Rounds before names are shared; more make fewer names, of contexts that fit in fewer windows.
    base_rounds: int = 3
    #: Further rounds whose symbols ask for their first document.
    levels: tuple[int, ...] = (13, 18, 23, 28, 33)


@dataclass
class Symbols:
    """Symbols of all texts of a chunk in a row: names, the words [start, end) they stand for, and their texts."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray


def _naming(name: np.ndarray, salt: int) -> np.ndarray:
    return B.mix64(name ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def _run_heads(name: np.ndarray, text: np.ndarray) -> np.ndarray:
    head = np.ones(len(name), bool)
    head[1:] = (name[1:] != name[:-1]) | (text[1:] != text[:-1])
    return np.flatnonzero(head)


def name_runs(s: Symbols) -> Symbols:
    """Runs of two and more equal symbols get a name of their own."""
    head = _run_heads(s.name, s.text)
    size = np.diff(np.append(head, len(s.name)))
    name, last = s.name[head], head + size - 1
    many = size > 1
    name[many] = B.mix64(name[many] ^ B.mix64(size[many].astype(np.uint64)))
    return Symbols(name, s.start[head], s.end[last], s.text[head])


def pair_heads(s: Symbols, round_: int) -> tuple[np.ndarray, np.ndarray]:
    """(which symbols are of the left kind, which begin a pair) in this round."""
    left = (_naming(s.name, round_) & np.uint64(1)).astype(bool)
    head = np.zeros(len(left), bool)
    head[:-1] = left[:-1] & ~left[1:] & (s.text[1:] == s.text[:-1])
    return left, head


def name_pairs(s: Symbols, head: np.ndarray, round_: int) -> tuple[Symbols, np.ndarray]:
    """The symbols with pairs replaced, and which of the given ones begin those that are left."""
    kept = np.ones(len(head), bool)
    kept[1:] = ~head[:-1]
    at = np.flatnonzero(head)
    name, end = s.name.copy(), s.end.copy()
    name[at] = B.mix64(_naming(name[at], ~round_) * np.uint64(31) + s.name[at + 1])
    end[at] = s.end[at + 1]
    return Symbols(name[kept], s.start[kept], end[kept], s.text[kept]), kept


def base_symbols(words: np.ndarray, edge: np.ndarray, rounds: int) -> tuple[Symbols, np.ndarray, np.ndarray]:
    """Symbols after some rounds, and the words [low, high) that decide each; a bound outside the text is never met.

    Runs are named before the first round only: later, contexts would grow too fast.
    """
    text = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    place = np.arange(len(words))
    s = name_runs(Symbols(words, place, place + 1, text))
    low, high = s.start - 1, s.end + 1  # the words beside a run tell that it ends
    for round_ in range(1, rounds + 1):
        left, head = pair_heads(s, round_)
        beside = np.arange(len(left)) + np.where(left, 1, -1)  # the neighbour that decides; a pair's second symbol goes
        there = np.clip(beside, 0, max(len(left) - 1, 0))
        same = (beside == there) & (s.text[there] == s.text)
        ends = edge[s.text] - 1, edge[s.text + 1] + 1
        low, high = (
            np.where(same, np.minimum(low, low[there]), np.where(left, low, ends[0])),
            np.where(same, np.maximum(high, high[there]), np.where(left, ends[1], high)),
        )
        s, kept = name_pairs(s, head, round_)
        low, high = low[kept], high[kept]
    return s, low, high


def upper_symbols(s: Symbols, edge: np.ndarray, config: Recompression) -> Iterator[Symbols]:
    """Symbols of at least a window, of the chosen further rounds and of whole texts; each once."""
    seen = np.zeros(int(edge[-1]) + 1, np.int64)
    for round_ in range(config.base_rounds + 1, max(config.levels, default=0) + 1):
        s = name_runs(s)
        s, _ = name_pairs(s, pair_heads(s, round_)[1], round_)
        if round_ in config.levels:
            new = (s.end - s.start >= config.window) & (seen[s.start] != s.end)
            yield Symbols(s.name[new], s.start[new], s.end[new], s.text[new])
            seen[s.start] = s.end
    size = np.diff(edge)
    whole = np.flatnonzero((size >= config.window) & (seen[edge[:-1]] != edge[1:]))
    yield Symbols(np.full(len(whole), 1, np.uint64), edge[:-1][whole], edge[1:][whole], whole)


class Passages:
    """Hashes of any passage of a chunk's words: one after running sums."""

    def __init__(self, words: np.ndarray):
        self.power, self.inverse = B._powers_to(len(words) + 1)
        self.total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(B.mix64(words) * self.power[: len(words)], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = (self.total[end] - self.total[start]) * self.inverse[start]
        return B.mix64(out + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


@dataclass
class Chunk:
    """A chunk's words and what recompression makes of them."""

    config: Recompression
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    edge: np.ndarray
    base: Symbols
    low: np.ndarray
    high: np.ndarray
    upper: Symbols
    upper_second: np.ndarray
    first: Passages
    second: Passages

    @classmethod
    def read(cls, data: np.ndarray, off: np.ndarray, config: Recompression) -> Chunk:
        starts, ends, edge = B.word_spans(data, off)
        words = B.span_hashes(data, starts, ends)
        first, second = Passages(words), Passages(B.span_hashes(data, starts, ends, _SECOND))
        base, low, high = base_symbols(words, edge, config.base_rounds)
        levels = list(upper_symbols(base, edge, config))
        upper = Symbols(*(np.concatenate([getattr(s, f) for s in levels]) for f in ("name", "start", "end", "text")))
        upper.name = B.mix64(upper.name ^ first.of(upper.start, upper.end))
        return cls(config, data, starts, ends, edge, base, low, high, upper, second.of(upper.start, upper.end), first, second)

    def windows(self) -> np.ndarray:
        """Where windows begin."""
        size = np.maximum(np.diff(self.edge) - self.config.window + 1, 0)
        total = B.running(size)
        return np.repeat(self.edge[:-1] - total[:-1], size) + np.arange(int(total[-1]))

    def texts_of(self, words: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edge, words, "right") - 1

    def names_of_windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.first.of(at, at + self.config.window), self.second.of(at, at + self.config.window)

    def inside(self, usable: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For base symbols: the first window that holds their context, and the one past the last."""
        return np.maximum(self.high[usable] - self.config.window, self.edge[self.base.text[usable]]), self.low[usable] + 1

    def usable(self) -> np.ndarray:
        """Base symbols whose context fits in some window."""
        text = self.base.text
        return np.flatnonzero((self.high - self.low <= self.config.window) & (self.low >= self.edge[text]) & (self.high <= self.edge[text + 1]))

    def candidates(self, shared: np.ndarray, settled: np.ndarray) -> np.ndarray:
        """Windows whose base symbols are all shared and that no settled upper symbol holds; of usable ones and upper ones."""
        n = len(self.starts) + 1
        out = np.zeros(n, np.int64)
        usable = self.usable()
        a, b = self.inside(usable[~shared])
        _cover(out, a, b)
        up = self.upper
        _cover(out, up.start[settled], up.end[settled] - self.config.window + 1)
        at = self.windows()
        return at[np.cumsum(out)[at] == 0]


def _cover(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Add one from a to b, as differences."""
    good = b > a
    n = len(sums)
    sums += np.bincount(a[good], minlength=n)[:n] - np.bincount(np.minimum(b[good], n - 1), minlength=n)[:n]


class Known:
    """Names that texts of a chunk have been told."""

    def __init__(self, names: pa.ListArray):
        size = np.asarray(names.value_lengths().fill_null(0))
        flat = np.asarray(names.flatten(), np.int64).astype(np.uint64)
        self.keys = np.unique(self._key(np.repeat(np.arange(len(size)), size), flat))

    @staticmethod
    def _key(text: np.ndarray, name: np.ndarray) -> np.ndarray:
        return B.mix64(name ^ B.mix64(text.astype(np.uint64) + np.uint64(1)))

    def __call__(self, text: np.ndarray, name: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(name), bool)
        key = self._key(text, name)
        return self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key


# What a wave sends: a name (with its second hash) that asks for its first document, with the largest document of the
# wave that holds it; or names that a document is told already.
_SHARED, _FIRST, _TOLD = 0, 1, 2
_SENT = T.StructType([T.StructField("kind", T.ByteType())] + [T.StructField(c, T.LongType()) for c in ("name", "second", "doc", "top")] + [T.StructField("told", T.ArrayType(T.LongType()))])
_KINDS = pa.schema([("kind", pa.int8()), ("name", pa.int64()), ("second", pa.int64()), ("doc", pa.int64()), ("top", pa.int64()), ("told", pa.list_(pa.int64()))])


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _asks(kind: int, name: np.ndarray, second: np.ndarray, doc: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """(one row for each name, and documents and names of what is told within the wave)."""
    order = np.lexsort((doc, second, name))
    name, second, doc = name[order], second[order], doc[order]
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (second[1:] != second[:-1])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(name)))
    low, top = doc[head], doc[head + size - 1] if len(head) else doc[:0]
    own = np.repeat(low, size)
    told = np.repeat(low < top, size) if kind == _SHARED else doc > own
    n = len(head)
    rows = [np.full(n, kind, np.int8), _signed(name[head]), _signed(second[head]), low, top]
    batch = pa.RecordBatch.from_arrays([*map(pa.array, rows), pa.nulls(n, pa.list_(pa.int64()))], schema=_KINDS)
    return batch, doc[told], name[told]


def _tellings(doc: np.ndarray, name: np.ndarray) -> pa.RecordBatch:
    """One row for each document, with the names it is told."""
    order = np.lexsort((name, doc))
    doc, name = doc[order], name[order]
    once = np.ones(len(doc), bool)
    once[1:] = (doc[1:] != doc[:-1]) | (name[1:] != name[:-1])
    doc, name = doc[once], name[once]
    head = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    n = len(head)
    lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(doc)).astype(np.int32)), pa.array(_signed(name)))
    spread = _signed(B.mix64(doc[head].astype(np.uint64)))
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, _TOLD, np.int8)), pa.array(spread), pa.array(doc[head]), pa.array(doc[head]), pa.array(doc[head]), lists], schema=_KINDS)


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(_LAST)).alias("doc"), F.col(text_column).alias("text"))


class _Wave:
    """What some chunks ask and are told, sent together."""

    def __init__(self):
        self.asked: list[tuple] = []
        self.told: list[tuple] = []
        self.size = 0

    def ask(self, kind: int, name: np.ndarray, second: np.ndarray, doc: np.ndarray) -> None:
        self.asked.append((kind, name, second, doc))
        self.size += len(name)

    def tell(self, doc: np.ndarray, name: np.ndarray) -> None:
        self.told.append((doc, name))
        self.size += len(name)

    def send(self) -> Iterator[pa.RecordBatch]:
        told = self.told
        for kind in (_SHARED, _FIRST):
            if parts := [a[1:] for a in self.asked if a[0] == kind]:
                batch, *known = _asks(kind, *map(np.concatenate, zip(*parts)))
                told.append(tuple(known))
                yield batch
        if told:
            yield _tellings(*map(np.concatenate, zip(*told)))
        self.__init__()


def _waves(it: Iterator[pa.RecordBatch], config: Recompression, ask: Callable) -> Iterator[pa.RecordBatch]:
    wave = _Wave()
    for rows, data, off in B.chunks(it, "text", CHUNK_BYTES):
        ask(wave, rows, Chunk.read(data, off, config))
        if wave.size >= ASKED:
            yield from wave.send()
    yield from wave.send()


def _ask_symbols(docs: DataFrame, config: Recompression) -> DataFrame:
    def ask(wave, rows, c):
        ids, used = np.asarray(B.column_of(rows, "doc")), c.usable()
        wave.ask(_SHARED, c.base.name[used], np.zeros(len(used), np.uint64), ids[c.base.text[used]])
        wave.ask(_FIRST, c.upper.name, c.upper_second, ids[c.upper.text])

    return B.map_batches(docs, lambda it: _waves(it, config, ask), _SENT)


def _ask_windows(docs: DataFrame, config: Recompression) -> DataFrame:
    """Of ``docs(doc, text, told)``; what upper symbols have settled is told on."""

    def ask(wave, rows, c):
        ids, known, used = np.asarray(B.column_of(rows, "doc")), Known(B.column_of(rows, "told")), c.usable()
        settled = known(c.upper.text, c.upper.name)
        at = c.candidates(known(c.base.text[used], c.base.name[used]), settled)
        wave.ask(_FIRST, *c.names_of_windows(at), ids[c.texts_of(at)])
        wave.tell(ids[c.upper.text[settled]], c.upper.name[settled])

    return B.map_batches(docs, lambda it: _waves(it, config, ask), _SENT)


def _answers(sent: DataFrame) -> DataFrame:
    """(doc, told): the names that each document shares or that an earlier one holds."""
    group = Window.partitionBy("kind", "name", "second")
    met = sent.withColumns({"first": F.min("doc").over(group), "last": F.max("top").over(group)})
    # A wave that holds a name in several documents has told them itself.
    asked = (F.col("kind") == _SHARED) & (F.col("first") < F.col("last")) & (F.col("doc") == F.col("top")) | (F.col("kind") == _FIRST) & (F.col("first") < F.col("doc"))
    heard = met.where(asked | (F.col("kind") == _TOLD)).select("doc", F.coalesce("told", F.array("name")).alias("told"))
    return heard.groupBy("doc").agg(F.flatten(F.collect_list("told")).alias("told"))


def _with_told(docs: DataFrame, told: DataFrame) -> DataFrame:
    return docs.join(told, "doc", "left")


_OWN = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]


def _kept_words(c: Chunk, known: Known) -> np.ndarray:
    n = len(c.starts) + 1
    gone = np.zeros(n, np.int64)
    settled = known(c.upper.text, c.upper.name)
    _cover(gone, c.upper.start[settled], c.upper.end[settled])
    at = c.windows()
    at = at[known(c.texts_of(at), c.names_of_windows(at)[0])]
    _cover(gone, at, at + c.config.window)
    return np.cumsum(gone)[:-1] == 0


def _joined(c: Chunk, kept: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    text = c.texts_of(np.arange(len(kept)))[kept]
    last = np.ones(len(text), bool)
    last[:-1] = text[1:] != text[:-1]
    start, size = c.starts[kept], (c.ends - c.starts)[kept] + ~last
    edge = B.running(size)
    place = np.repeat(start - edge[:-1], size) + np.arange(int(edge[-1]))
    out = np.append(c.data, np.uint8(0x20))[place]
    out[(edge[1:] - 1)[~last]] = 0x20
    ends = edge[np.searchsorted(text, np.arange(len(c.edge)))]
    return pa.Array.from_buffers(pa.large_string(), len(c.edge) - 1, [None, pa.py_buffer(ends), pa.py_buffer(out)]).cast(pa.string())


def drop_repeats(docs: DataFrame, config: Recompression = Recompression(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows with the words that are left in the text, joined by one space, and n_words (before) and n_removed."""
    scratch = Scratch(docs.sparkSession, "recompression", free_shuffles=True)
    texts = _keyed(docs, id_column, text_column)
    shared = scratch.write(_answers(_ask_symbols(texts, config)))
    windows = scratch.write(_ask_windows(_with_told(texts, shared), config))
    scratch.drop(shared)
    settled = scratch.write(_answers(windows))
    scratch.drop(windows)

    kept = [c for c in docs.columns if c not in ("n_words", "n_removed") or c == text_column]
    hidden = "_" * max(map(len, docs.columns))
    key, told = f"{hidden}doc", f"{hidden}told"

    def run(it):
        for rows, data, off in B.chunks(it, text_column, CHUNK_BYTES):
            c = Chunk.read(data, off, config)
            left = _kept_words(c, Known(B.column_of(rows, told)))
            total, gone = np.diff(c.edge), np.diff(B.running(~left)[c.edge])
            columns = [_joined(c, left) if k == text_column else B.column_of(rows, k) for k in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total), pa.array(gone)], names=[*kept, "n_words", "n_removed"])

    source = docs.select(*kept, F.coalesce(F.col(id_column).cast("long"), F.lit(_LAST)).alias(key))
    source = source.join(settled.select(F.col("doc").alias(key), F.col("told").alias(told)), key, "left")
    return B.map_batches(source, run, T.StructType([*(docs.schema[k] if k != text_column else T.StructField(k, T.StringType()) for k in kept), *_OWN]))
