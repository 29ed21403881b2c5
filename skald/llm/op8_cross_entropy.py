"""Cross-entropy difference of matched bigram models.

A target model (documents named by the caller) and a background model (all
documents) share one vocabulary, every word of the corpus, and the same
smoothing.  Both are counted over every document.  A document's score is its
mean per-token loss under the target model minus that under the background
model: the lower, the closer to the target.

Pairs of the most frequent words are counted in a table of fixed size per task
and scored from a broadcast of it.  Every other pair holds a rarer word and
goes, packed by text chunk, to the partition of that word, where all its
occurrences meet: counts of the word and its pairs are complete there, and what
each document gains or loses by them is sent back, packed by text chunk again,
and added up.  A word that is not among the most frequent is too rare to make
one partition heavy, as long as the corpus has less than some 1e10 tokens: beyond
that, the heaviest of them alone fills a partition.  A partition's occurrences
are held in memory; the number of partitions follows the counted occurrences.

Defined results: a null or empty text has no tokens and zero losses; an empty
target makes both models uniform over what smoothing leaves; one unseen word
counts as part of the vocabulary; repeated rows count and are scored each; very
long texts are one chunk each; an empty table gives no rows; only id and text
are read, so other columns cannot clash.  A caller may cap the vocabulary; the words
past the cap (ties are cut by word hash) are then that one word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import batches as B
from .durable import Scratch

#: Text packed at once on the way to the words' partitions.
SENT_BYTES = 1 << 22

#: Neighbours that are no rare word: nothing before, a frequent word before (its place), and the same after the word.
_START, _AFTER = np.uint64(0), np.uint64(1 << 32)

#: Occurrences of rare words that meet in one partition on the average, at most.
SITE_OCCURRENCES = 1_500_000

_SENT = "site int, chunk long, word binary, other binary, keys binary, counts binary, targets binary"
_BACK = "chunk long, keys binary, target binary, background binary"


@dataclass(frozen=True)
class LmConfig:
    #: Words told apart, the most frequent ones; None for every word of the corpus.
    vocabulary: int | None = None
    #: Of an uncapped vocabulary, the words whose pairs are counted in a table of (hot + 1) squared cells.
    hot: int = 1_023
    #: Weight of the unigram model in each bigram context.
    context_mass: float = 20.0
    #: Up to so many target ids are sent to all executors; beyond, they meet the documents in a shuffle.
    broadcast_ids: int = 1_000_000


def count_words(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """(word, n): hashes of ASCII-folded words and how often they occur in all documents."""

    def run(it):
        for _, data, off in B.chunks(it, text_column):
            starts, ends, _ = B.word_spans(data, off)
            h, n = np.unique(B.span_hashes(data, starts, ends, B.FOLDED), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["word", "n"])

    return docs.select(text_column).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def token_ids(data: np.ndarray, off: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words (0 for the rest, else 1 + place in the sorted vocabulary) and n+1 offsets."""
    starts, ends, first = B.word_spans(data, off)
    h = B.span_hashes(data, starts, ends, B.FOLDED)
    if not len(vocabulary):
        return np.zeros(len(h), np.int64), first
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    return np.where(vocabulary[at] == h, at + 1, 0), first


def count_bigrams(docs: DataFrame, vocabulary: np.ndarray, text_column: str, target_column: str) -> DataFrame:
    """(cell, background, target): bigram counts in all documents and in those marked as target."""
    width = len(vocabulary) + 1
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(it):
        table = np.zeros((2, width * width), np.int64)
        for rows, data, off in B.chunks(it, text_column):
            ids, first = token_ids(data, off, shared.value)
            cell = ids[:-1] * width + ids[1:] if len(ids) else ids
            inner = np.ones(len(cell), bool)
            last = first[1:-1] - 1
            inner[last[(last >= 0) & (last < len(cell))]] = False  # no bigram leads into the next text
            marked = np.repeat(np.asarray(B.column_of(rows, target_column).to_pylist(), bool), np.diff(first))[:-1]
            table[0] += np.bincount(cell[inner], minlength=width * width)
            table[1] += np.bincount(cell[inner & marked], minlength=width * width)
        at = np.flatnonzero(table[0])
        for i in range(0, len(at), 65536):
            part = at[i : i + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(table[0][part]), pa.array(table[1][part])], names=["cell", "background", "target"])

    made = docs.select(text_column, target_column).mapInArrow(run, "cell long, background long, target long")
    return made.groupBy("cell").agg(F.sum("background").alias("background"), F.sum("target").alias("target"))


def losses(counts: np.ndarray, config: LmConfig, size: int | None = None) -> np.ndarray:
    """Loss (nats) of each word after each context, from a square table of counts; ``size``: words of the vocabulary."""
    counts = counts.astype(np.float64)
    return -np.log((counts + config.context_mass * unigrams(counts, size)) / (counts.sum(1, keepdims=True) + config.context_mass))


def unigrams(counts: np.ndarray, size: int | None = None) -> np.ndarray:
    """Smoothed share of each word after any context."""
    return (counts.sum(0) + 1.0) / (counts.sum() + (size or len(counts)))


def _packed(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, kinds = zip(*(part.split() for part in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(v, types[k]) for v, k in zip(zip(*rows), kinds)], names=list(names))


def send_rare(docs: DataFrame, hot, sites: int, text_column: str) -> DataFrame:
    """Occurrences of words that are not hot, with their neighbours, dealt by word over the sites.

    Each one is sent with what stands before it, and again where it leads into
    a hot word or ends its text; a pair of two rare words goes to the second.
    """

    def run(it):
        for rows, data, off in B.chunks(it, text_column, SENT_BYTES):
            starts, ends, _ = B.word_spans(data, off)
            words = B.span_hashes(data, starts, ends, B.FOLDED)
            ids, first = token_ids(data, off, hot.value)
            sizes = np.diff(first)
            begins, stops = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
            begins[first[:-1][sizes > 0]] = True
            stops[first[1:][sizes > 0] - 1] = True
            before = np.roll(np.where(ids == 0, words, ids.astype(np.uint64)), 1)
            before[begins] = _START
            after = np.roll(ids, -1)
            after[stops] = 0
            second, leads = np.flatnonzero(ids == 0), np.flatnonzero((ids == 0) & (stops | (after > 0)))
            at = np.concatenate([second, leads])
            other = np.concatenate([before[second], _AFTER + after[leads].astype(np.uint64)])
            row = np.repeat(np.arange(rows.num_rows), sizes)[at]
            site = (words[at] % np.uint64(sites)).astype(np.int64)
            place = site * rows.num_rows + row
            order = np.argsort(place, kind="stable")
            word, other, place = words[at][order], other[order], place[order]
            heads = np.flatnonzero(np.diff(place, prepend=-1))
            counts = np.diff(heads, append=len(place)).astype(np.int32)
            site, row = np.divmod(place[heads], rows.num_rows)
            keys = np.asarray(B.column_of(rows, "_key"))[row]
            targets = np.asarray(B.column_of(rows, "_target").to_pylist(), np.uint8)[row]
            cuts = np.flatnonzero(np.diff(site, prepend=-1))
            chunk = int(B.mix64(np.asarray(B.column_of(rows, "_key")).view(np.uint64)[:1]).view(np.int64)[0])  # any number that the chunk's rows share
            out = []
            for lo, hi in zip(cuts, [*cuts[1:], len(site)]):
                inner = slice(heads[lo], heads[hi] if hi < len(heads) else len(place))
                out.append((int(site[lo]), chunk, *(x.tobytes() for x in (word[inner], other[inner], keys[lo:hi], counts[lo:hi], targets[lo:hi]))))
            if out:
                yield _packed(_SENT, out)

    return docs.mapInArrow(run, _SENT).repartitionById(sites, "site")


def score_rare(sent: DataFrame, shared, config: LmConfig, sites: int) -> DataFrame:
    """Packed (key, target, background): what documents' losses gain at each site; every word's rows are in one partition."""

    def run(it):
        chunks, parts = [], [[], [], [], [], []]
        for batch in it:
            chunks += batch.column(1).to_pylist()
            for part, column, kind in zip(parts, batch.columns[2:], (np.uint64, np.uint64, np.int64, np.int32, np.uint8)):
                part.extend(np.frombuffer(x.as_buffer(), kind) for x in column)
        if not chunks:
            return
        at = B.running([len(x) for x in parts[2]])  # a chunk's documents
        word, other, keys, counts, targets = (np.concatenate(p) for p in parts)
        hot = shared.value  # for both models: total with smoothing, unigrams of the hot words
        doc = np.repeat(np.arange(len(keys)), counts)
        after = (other >= _AFTER) & (other <= _AFTER + np.uint64(len(hot[0][1])))
        start, end = other == _START, other == _AFTER
        cell = np.unique(B.mix64(word + B.mix64(other ^ np.uint64(0x9E3779B97F4A7C15))), return_inverse=True)[1]
        word = np.unique(word, return_inverse=True)[1]
        context = (~after).astype(np.float64) - end
        place = np.where(after, other - _AFTER, np.uint64(0)).astype(np.int64)
        out = []
        for (total, unigram), weight in zip(hot, (np.repeat(targets, counts).astype(np.float64), np.ones(len(doc)))):
            inward = np.bincount(word, weight * (~after & ~start))
            outward = np.bincount(word, weight * context)
            pairs = np.bincount(cell, weight)
            share = np.where(after, unigram[place], (inward[word] + 1.0) / total)
            loss = np.where(start | end, 0.0, -np.log(pairs[cell] + config.context_mass * share))
            out.append(np.bincount(doc, loss + context * np.log(outward + config.context_mass)[word], len(keys)))
        for i in range(0, len(chunks), 256):
            rows = [(chunks[k], *(x[at[k] : at[k + 1]].tobytes() for x in (keys, *out))) for k in range(i, min(i + 256, len(chunks)))]
            yield _packed(_BACK, rows)

    def add(it):
        parts = [[], [], []]
        for batch in it:
            for part, column, kind in zip(parts, batch.columns[1:], (np.int64, np.float64, np.float64)):
                part.extend(np.frombuffer(x.as_buffer(), kind) for x in column)
        if parts[0]:
            keys, *gains = (np.concatenate(p) for p in parts)
            known, doc = np.unique(keys, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(known), *(pa.array(np.bincount(doc, g)) for g in gains)], names=["_key", "_target", "_background"])

    return sent.mapInArrow(run, _BACK).repartition(sites, "chunk").mapInArrow(add, "_key long, _target double, _background double")


def score_documents(docs: DataFrame, target_ids: DataFrame, config: LmConfig = LmConfig(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, n_tokens, target_loss, background_loss and ce_difference, all per scored token.

    The first token of a text has no context and is not scored.
    """
    spark, context = docs.sparkSession, docs.sparkSession.sparkContext
    whole = config.vocabulary is None
    scratch = Scratch(spark, "op8")
    words = scratch.write(count_words(docs, text_column))
    top = words.orderBy(F.desc("n"), "word").limit(config.hot if whole else config.vocabulary).toPandas()
    vocabulary = np.sort(top["word"].to_numpy(np.int64).view(np.uint64))
    width = len(vocabulary) + 1
    n_words, n_tokens = words.agg(F.count(F.lit(1)), F.sum("n")).first()
    size = n_words + 1 if whole else width
    scratch.drop(words)
    ids = target_ids.select(id_column).where(F.col(id_column).isNotNull()).distinct()
    few = ids.limit(config.broadcast_ids + 1).count() <= config.broadcast_ids
    ids = ids.withColumn("_target", F.lit(True))
    marked = docs.select(id_column, text_column).join(F.broadcast(ids) if few else ids, id_column, "left")
    marked = marked.select(id_column, text_column, F.coalesce("_target", F.lit(False)).alias("_target"))
    # Rows of one key are the same id and text; they are scored together.
    marked = marked.withColumn("_key", F.xxhash64(id_column, F.col(id_column).isNull(), text_column))
    found = count_bigrams(marked, vocabulary, text_column, "_target").toPandas()
    table = np.zeros((2, width * width))
    table[0, found["cell"]], table[1, found["cell"]] = found["background"], found["target"]
    table = table.reshape(2, width, width)[::-1]  # target, background
    tables = np.stack([losses(t, config, size) for t in table])
    if whole:  # cells with a rare word: only what the context's count adds is known here
        tables[:, :, 0] = np.log(table.sum(2) + config.context_mass)
        tables[:, 0, :] = 0.0
    shared = context.broadcast((vocabulary, [t.astype(np.float32).ravel() for t in tables]))

    def run(it):
        known, tables = shared.value
        side = len(known) + 1
        for rows, data, off in B.chunks(it, text_column):
            ids, first = token_ids(data, off, known)
            cell = ids[:-1] * side + ids[1:] if len(ids) else ids
            scored = np.maximum(np.diff(first) - 1, 0)
            out = []
            for values in tables:
                total = np.zeros(len(cell) + 1)
                np.cumsum(values[cell], out=total[1:], dtype=np.float64)
                begin = np.minimum(first[:-1], len(cell))
                out.append(total[begin + scored] - total[begin])
            yield pa.RecordBatch.from_arrays(
                [B.column_of(rows, id_column), B.column_of(rows, "_key"), pa.array(np.diff(first)), pa.array(out[0]), pa.array(out[1])],
                names=[id_column, "_key", "_tokens", "_target", "_background"],
            )

    fields = T._parse_datatype_string("_key long, _tokens long, _target double, _background double").fields
    made = marked.select(id_column, text_column, "_key").mapInArrow(run, T.StructType([docs.schema[id_column], *fields]))
    if whole:
        hot = context.broadcast([(t.sum() + size, unigrams(t, size)) for t in table])
        rare = (n_tokens or 0) - int(top["n"].sum())
        sites = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rare // SITE_OCCURRENCES))
        sent = send_rare(marked.select(text_column, "_target", "_key"), context.broadcast(vocabulary), sites, text_column)
        made = made.withColumn("_copies", F.lit(1)).unionByName(score_rare(sent, hot, config, sites), allowMissingColumns=True)
    else:
        made = made.withColumn("_copies", F.lit(1))
    sums = (F.sum(c).alias(c) for c in ("_copies", "_tokens", "_target", "_background"))
    by_key = made.groupBy("_key").agg(F.max(id_column).alias("_id"), *sums)
    scored = F.greatest(F.col("_tokens") - F.col("_copies"), F.lit(1))
    rows = by_key.select(
        F.explode(F.array_repeat("_id", F.col("_copies").cast("int"))).alias(id_column),
        F.expr("_tokens div _copies").alias("n_tokens"), (F.col("_target") / scored).alias("target_loss"), (F.col("_background") / scored).alias("background_loss"),
    )
    return rows.withColumn("ce_difference", F.col("target_loss") - F.col("background_loss"))
