"""Toxicity by a convolutional text classifier trained in numpy.

Words (runs of letters and digits, ASCII case folded) are hashed into buckets;
so are their beginnings, for inflected forms never seen.  A word's embedding is
the sum of its buckets' embeddings; buckets seen in too few texts stay zero.  Filters of several widths slide over the whole text,
each keeps its maximum, and a logistic layer on the maxima gives the score.
Training is Adagrad on a bounded sample of labelled rows; only the positions
of the maxima carry gradients.

Thresholds are calibrated by language: part of the sample is set aside, the
best threshold is chosen on it for each language, and scores are shifted in
the logit so that every language's threshold is 0.3.  The language is judged
from the text's own words, never read from the row.

When scoring, the filters are applied to the embedding table once; a text then
only adds up rows of those tables.

Defined results: a null or empty text, or one without words, has the score of
no evidence at all; without labels of both classes the score is the base rate
of the sample (0 without any); an id with both labels counts as toxic; repeated
rows are scored each; a score equal to the threshold is toxic; an empty table
gives no rows; very long texts are scored whole; only id, text and lang are
read, so other columns cannot clash.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import batches as B
from .sampling import fitting_ids, held_out, one_row_each, sample_ids


@dataclass(frozen=True)
class CnnConfig:
    buckets: int = 1 << 16
    #: Beginnings of words, in bytes, that have buckets of their own.
    prefixes: tuple[int, ...] = (4, 5)
    #: Fewest training texts with a bucket for it to count.
    least_texts: int = 4
    dims: int = 12
    filters: int = 10
    widths: tuple[int, ...] = (1, 2, 3)
    #: Labelled rows per class to train on, at most.
    per_class: int = 3_000
    #: Bytes of their texts per class, at most; where no text of a class fits, its shortest sampled one is taken.
    train_bytes: int = 16 << 20
    epochs: int = 6
    batch: int = 48
    rate: float = 0.08
    #: One in so many sampled rows is set aside for the thresholds.
    calibration: int = 5
    #: Fewest toxic rows of a language for a threshold of its own.
    least_positives: int = 15
    threshold: float = 0.3
    seed: int = 7


def word_buckets(data: np.ndarray, off: np.ndarray, config: CnnConfig) -> tuple[np.ndarray, np.ndarray]:
    """Buckets 1.. [word, part] of all words, each text followed by empty places (0); and n+1 offsets."""
    starts, ends, first = B.word_spans(data, off, B.NON_ALNUM)
    gap = max(config.widths)
    n = np.diff(first)
    edge = np.concatenate([[0], np.cumsum(n + gap)])
    out = np.zeros((edge[-1], 1 + len(config.prefixes)), np.int64)
    place = np.arange(len(starts)) + np.repeat(np.arange(len(n)) * gap, n)
    for k, size in enumerate((None, *config.prefixes)):
        h = B.span_hashes(data, starts, ends if size is None else np.minimum(ends, starts + size), B.FOLDED)
        out[place, k] = B.mix64(h + np.uint64(k)) % np.uint64(config.buckets - 1) + np.uint64(1)
    return out, edge


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


class TextCnn:
    def __init__(self, config: CnnConfig):
        c, rng = config, np.random.default_rng(config.seed)
        self.config = c
        self.embedding = rng.normal(0, 0.1, (c.buckets, c.dims)).astype(np.float32)
        self.embedding[0] = 0
        self.kernels = [rng.normal(0, 0.3, (w, c.dims, c.filters)).astype(np.float32) for w in c.widths]
        self.bias = [np.zeros(c.filters, np.float32) for _ in c.widths]
        self.top = rng.normal(0, 0.3, c.filters * len(c.widths)).astype(np.float32)
        self.base = np.zeros(1, np.float32)
        self.languages: list[str] = []
        self.priors = np.zeros((c.buckets, 0), np.float32)
        self.shift = np.zeros(1)
        self.tables: list[list[np.ndarray]] = []
        self.active = np.zeros(c.buckets, bool)

    def _slide(self, ids: np.ndarray, table: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
        total = np.zeros((len(ids), len(bias)), np.float32)
        total += bias
        for j, row in enumerate(table):
            for k in range(ids.shape[1]):
                total[: len(ids) - j] += row[ids[j:, k]]
        return total

    def freeze(self) -> None:
        """Apply the filters to the embeddings, once."""
        self.tables = [[self.embedding @ kernel[j] for j in range(len(kernel))] for kernel in self.kernels]

    def logits(self, ids: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """One number per text.  A text without words has only empty places."""
        pooled = []
        for table, bias in zip(self.tables, self.bias):
            total = self._slide(ids, table, bias)
            for j in range(1, len(table)):  # windows that reach into the next text
                total[edge[1:] - j] = -np.inf
            pooled.append(np.maximum(np.maximum.reduceat(total, edge[:-1], axis=0), 0))
        return np.concatenate(pooled, 1) @ self.top + self.base[0]

    def language_of(self, ids: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """The most likely language of each text by its words alone (index; 0 without languages)."""
        if not self.languages:
            return np.zeros(len(edge) - 1, np.int64)
        return np.add.reduceat(self.priors[ids[:, 0]], edge[:-1], axis=0).argmax(1)

    def scores(self, ids: np.ndarray, edge: np.ndarray) -> np.ndarray:
        if len(edge) < 2:
            return np.zeros(0)
        return _sigmoid(self.logits(ids, edge).astype(np.float64) + self.shift[self.language_of(ids, edge)])

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, languages: list[str | None]) -> TextCnn:
        """Train on texts given as buckets with their empty places."""
        c, rng = self.config, np.random.default_rng(self.config.seed)
        labels = np.asarray(labels, np.float64)
        place = np.arange(len(texts))
        aside = place % c.calibration == c.calibration - 1
        self._learn_languages(texts, languages)
        if len(texts) == 0 or labels.min() == labels.max():
            rate = labels.mean() if len(texts) else 0.0
            self.top[:] = 0
            self.base[0] = np.log(max(rate, 1e-6) / max(1 - rate, 1e-6))
            self.freeze()
            self.shift = np.zeros(max(1, len(self.languages)))
            return self
        train = place[~aside]
        self._seed_embedding([texts[i] for i in train], labels[train])
        memory = {}

        def step(name, array, grad, rows=None):
            m = memory.setdefault(name, np.full(array.shape, 1e-3, np.float32))
            if rows is None:
                m += grad * grad
                array -= c.rate * grad / np.sqrt(m)
            else:
                m[rows] += grad * grad
                array[rows] -= c.rate * grad / np.sqrt(m[rows])

        for _ in range(c.epochs):
            order = rng.permutation(train)
            for at in range(0, len(order), c.batch):
                own = order[at : at + c.batch]
                ids = np.concatenate([texts[i] for i in own])
                edge = np.concatenate([[0], np.cumsum([len(texts[i]) for i in own])])
                self._step(ids, edge, labels[own], step)
        self.freeze()
        self._calibrate(texts, labels, place[aside])
        return self

    def _seed_embedding(self, texts: list[np.ndarray], labels: np.ndarray) -> None:
        """Begin with each bucket's log odds in the first dimension, so that rare words count from the start."""
        c = self.config
        seen = np.zeros((2, c.buckets))
        for ids, y in zip(texts, labels):
            seen[int(y), np.unique(ids)] += 1
        n = np.array([(labels == 0).sum(), (labels == 1).sum()])[:, None]
        odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
        self.active = seen.sum(0) >= c.least_texts
        self.active[0] = False
        self.embedding[~self.active] = 0
        self.embedding[self.active, 0] = 0.5 * odds[self.active]
        for kernel in self.kernels:
            kernel[:, 0, : c.filters // 2] = 0.5

    def _step(self, ids, edge, y, step) -> None:
        c = self.config
        n = len(y)
        x = self.embedding[ids].sum(1)
        peaks, pooled = [], []
        for kernel, bias in zip(self.kernels, self.bias):
            total = x @ kernel[0] + bias
            for j in range(1, len(kernel)):
                total[:-j] += (x @ kernel[j])[j:]
            peak = np.stack([edge[i] + total[edge[i] : edge[i + 1] - len(kernel) + 1].argmax(0) for i in range(n)])
            peaks.append(peak)
            pooled.append(np.maximum(np.take_along_axis(total, peak, 0), 0))
        features = np.concatenate(pooled, 1)
        error = ((_sigmoid(features @ self.top + self.base[0]) - y) / n).astype(np.float32)
        back = error[:, None] * self.top
        step("top", self.top, features.T @ error + 1e-4 * self.top)
        step("base", self.base, np.array([error.sum()], np.float32))
        rows, grads = [], []
        for i, (kernel, peak) in enumerate(zip(self.kernels, peaks)):
            g = back[:, i * c.filters : (i + 1) * c.filters] * (pooled[i] > 0)
            step(f"bias{i}", self.bias[i], g.sum(0))
            change = np.zeros_like(kernel)
            for j in range(len(kernel)):
                at = np.minimum(peak + j, len(ids) - 1)
                change[j] = np.einsum("nf,nfd->df", g, x[at])
                for k in range(ids.shape[1]):
                    rows.append(ids[at, k].ravel())
                    grads.append((g[:, :, None] * kernel[j].T[None]).reshape(-1, c.dims))
            step(f"kernel{i}", kernel, change)
        rows, grads = np.concatenate(rows), np.concatenate(grads)
        use = self.active[rows]
        own, where = np.unique(rows[use], return_inverse=True)
        total = np.zeros((len(own), c.dims), np.float32)
        np.add.at(total, where, grads[use])
        step("embedding", self.embedding, total, own)

    def _learn_languages(self, texts: list[np.ndarray], languages: list[str | None]) -> None:
        names = sorted({x for x in languages if x is not None})
        counts = np.full((self.config.buckets, len(names)), 0.5)
        for ids, name in zip(texts, languages):
            if name is not None:
                np.add.at(counts[:, names.index(name)], ids[:, 0], 1)
        counts[0] = 1
        p = np.log(counts / counts.sum(0)) if names else counts
        self.languages, self.priors = names, (p - p.mean(1, keepdims=True) if names else p).astype(np.float32)
        self.priors[0] = 0

    def _calibrate(self, texts: list[np.ndarray], labels: np.ndarray, aside: np.ndarray) -> None:
        c = self.config
        ids = np.concatenate([texts[i] for i in aside]) if len(aside) else np.zeros((1, 1), np.int64)
        edge = np.concatenate([[0], np.cumsum([len(texts[i]) for i in aside])]) if len(aside) else np.array([0, 1])
        goal = np.log(c.threshold / (1 - c.threshold))
        self.shift = np.zeros(max(1, len(self.languages)))
        if not len(aside):
            return
        value, spoken, y = self.logits(ids, edge), self.language_of(ids, edge), labels[aside]
        common = _threshold(value, y)
        for k in range(len(self.shift)):
            own = spoken == k
            enough = y[own].sum() >= c.least_positives and (1 - y[own]).sum() >= c.least_positives
            self.shift[k] = goal - (_threshold(value[own], y[own]) if enough else common)


def _threshold(value: np.ndarray, y: np.ndarray) -> float:
    """The logit that parts the classes with the fewest errors, in the middle of its gap."""
    order = np.argsort(value, kind="stable")
    v, y = value[order].astype(np.float64), y[order]
    wrong = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
    best = np.flatnonzero(wrong == wrong.min())
    edges = np.concatenate([[v[0] - 1], (v[1:] + v[:-1]) / 2, [v[-1] + 1]])
    return float(edges[best[len(best) // 2]])


def learn_toxicity(docs: DataFrame, labels: DataFrame, config: CnnConfig = CnnConfig(), id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", lang_column: str = "lang") -> TextCnn:
    """Train on a bounded sample of labelled rows that are not held out (crc32 of the id, mod 4, is 2)."""
    picked = sample_ids(labels.where(~held_out(id_column, 4, 2)), id_column, label_column, 2 * config.per_class)
    ids = fitting_ids(docs, picked, id_column, text_column, config.per_class, config.train_bytes)
    label_of = {i: int(y) for y, own in ids.items() for i in own}
    found: list[tuple] = []
    if label_of:
        lang = F.col(lang_column) if lang_column in docs.columns else F.lit(None).cast("string")
        rows = one_row_each(docs.select(id_column, F.col(text_column).alias("text"), lang.alias("lang")), list(label_of), id_column, "text", ["text", "lang"])

        def run(it):
            for chunk, data, off in B.chunks(it):
                buckets, edge = word_buckets(data, off, config)
                yield pa.RecordBatch.from_arrays(
                    [B.column_of(chunk, id_column), B.column_of(chunk, "lang"), pa.ListArray.from_arrays(pa.array((edge * buckets.shape[1]).astype(np.int32)), pa.array(buckets.astype(np.int32).ravel()))],
                    names=[id_column, "lang", "ids"],
                )

        out = T.StructType([docs.schema[id_column], T.StructField("lang", T.StringType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
        table = B.map_batches(rows, run, out).toArrow()
        lists = table.column("ids").combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.chunk(0) if lists.num_chunks else pa.array([], lists.type)
        edge, flat = np.asarray(lists.offsets), np.asarray(lists.values)
        names, langs = table.column(0).to_pylist(), table.column(1).to_pylist()
        found = [(zlib.crc32(str(n).encode()), n, langs[i], flat[edge[i] : edge[i + 1]].reshape(-1, 1 + len(config.prefixes))) for i, n in enumerate(names)]
        found.sort(key=lambda x: x[:2])
    return TextCnn(config).fit([x[3] for x in found], np.array([label_of[x[1]] for x in found]), [x[2] for x in found])


def score_toxicity(docs: DataFrame, model: TextCnn, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, held_out, score and predicted."""
    config = model.config
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it):
        cnn = shared.value
        for rows, data, off in B.chunks(it, text_column):
            yield pa.RecordBatch.from_arrays([B.column_of(rows, id_column), pa.array(cnn.scores(*word_buckets(data, off, config)))], names=[id_column, "score"])

    made = B.map_batches(docs.select(id_column, text_column), run, T.StructType([docs.schema[id_column], T.StructField("score", T.DoubleType())]))
    return made.select(id_column, held_out(id_column, 4, 2).alias("held_out"), "score", (F.col("score") >= config.threshold).cast("int").alias("predicted"))
