"""Spelling variants: an even-partition pigeonhole join over the words of a corpus.

Words are runs of letters, counted in numpy on whole chunks and summed by
Spark.  Of two words one edit apart, one half of the shorter is untouched in
the longer: its first half begins it, or its last half ends it.  So each word
is indexed under both halves of its own length, and probes, for words of its
length and of one less, with its own beginning and ending of those halves'
lengths; for the ending that is a substring shifted by the difference.
Candidates that meet in both halves count in the first alone, and all are
verified.

Where a half is shared by too many words, what remains of them is halved again
in the same way, as the one edit lies in it; this goes on until each bucket is
small or the remainder is one letter.  No bucket is cut.

A word's form is the near word of largest count, where that is some times its
own; roots follow forms to the end by doubling.

Defined results: a null or empty text has no words; a null id stands for an
empty one in the checksum; repeated rows count each; only id and text are read,
so other columns cannot clash; a text of any length is read whole (it is a
chunk of its own), and so is a word of any length; ties between forms go to the
word first in code-point order; a table without rows or words gives none.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import batches as B
from .durable import Scratch

CHUNK_BYTES = 2 << 20

_LETTER = np.zeros(256, bool)
for _a, _b in ((0x41, 0x5B), (0x61, 0x7B)):
    _LETTER[_a:_b] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: First byte of the two that U+00C0 to U+00FF have in UTF-8.
_LATIN = 0xC3


@dataclass(frozen=True)
class Spelling:
    #: Least code points and occurrences of a word.
    letters: int = 6
    occurrences: int = 5
    #: A form occurs at least so many times as often as the word.
    ratio: int = 5
    #: One occurrence in so many (of a document and word, by checksum) loses a letter; 0: none does.
    slips: int = 199
    #: Pairs of indexed and probing words that one bucket may make before it is split.
    bucket_pairs: int = 100_000


def letter_runs(data: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All runs of letters in a row, A-Z lowered, and n+1 offsets of the texts into them."""
    n = len(data)
    lead = data == _LATIN
    inside = _LETTER[data] | lead
    inside[1:] |= lead[:-1]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    first = off[:-1][off[:-1] < n]
    begin[first] = inside[first]
    starts = np.flatnonzero(begin)
    edge = np.append(starts, n)
    total = B.running(inside)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(total[edge].astype(np.int32)), pa.py_buffer(_LOWER[data[inside]])])
    return words, np.searchsorted(starts, off)


@cache
def _zeros(power: int) -> np.ndarray:
    """What crc32 makes of each of its 32 bits when 2^power zero bytes follow."""
    if power:
        half = _zeros(power - 1)
        return _through(half, half)
    bits = []
    for i in range(32):
        c = 1 << i
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)  # fixed value: the polynomial of crc32
        bits.append(c)
    return np.array(bits, np.uint32)


def _through(images: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros_like(values)
    for i in range(32):
        out ^= np.where(values >> np.uint32(i) & np.uint32(1), images[i], np.uint32(0))
    return out


@cache
def _shift_table(size: int) -> np.ndarray:
    """For each of a checksum's four bytes, what it becomes when so many bytes follow."""
    values = (np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    for power in range(size.bit_length()):
        if size >> power & 1:
            values = _through(_zeros(power), values)
    return values


def joined_crc32(heads: np.ndarray, tails: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """crc32 of head + tail from the crc32 of both and the tail's length in bytes."""
    kinds, kind = np.unique(sizes, return_inverse=True)
    table = np.stack([_shift_table(k) for k in kinds.tolist()]) if len(kinds) else np.zeros((0, 4, 256), np.uint32)
    out = tails.astype(np.uint32)
    for j in range(4):
        out = out ^ table[kind, j, heads >> np.uint32(8 * j) & np.uint32(255)]
    return out


def count_runs(ids: list[str], data: np.ndarray, off: np.ndarray, config: Spelling) -> tuple[list[bytes], list[int]]:
    """The long enough words of a chunk and how often each occurs, slips applied."""
    runs, texts = letter_runs(data, off)
    coded = runs.dictionary_encode()
    words, index = coded.dictionary.to_pylist(), np.asarray(coded.indices)
    letters = np.array([len(w) - w.count(b"\xc3") for w in words], np.int64)
    counts = np.bincount(index, minlength=len(words))
    slipped: Counter = Counter()
    if config.slips and len(index):
        heads = np.repeat(np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32), np.diff(texts))
        crc = joined_crc32(heads, np.array([zlib.crc32(w) for w in words], np.uint32)[index], np.array([len(w) for w in words], np.int64)[index])
        hit = np.flatnonzero((crc % np.uint32(config.slips) == 0) & (letters[index] > config.letters - 1))
        counts -= np.bincount(index[hit], minlength=len(words))
        for w, h in zip(index[hit].tolist(), crc[hit].tolist()):
            word = words[w].decode()
            at = h % len(word)
            if len(word) > config.letters:
                slipped[(word[:at] + word[at + 1 :]).encode()] += 1
    kept = np.flatnonzero((letters >= config.letters) & (counts > 0))
    return [words[i] for i in kept.tolist()] + list(slipped), counts[kept].tolist() + list(slipped.values())


def corpus_words(docs: DataFrame, config: Spelling = Spelling(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word, n) of all words with enough letters and occurrences."""

    def run(it):
        for rows, data, off in B.chunks(it, text_column, CHUNK_BYTES):
            words, n = count_runs(B.column_of(rows, "id").to_pylist(), data, off, config)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

    source = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), F.col(text_column))
    total = B.map_batches(source, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return total.where(F.col("n") >= config.occurrences)


def _halves(rest: Column, size: Column) -> list[tuple[Column, Column, str]]:
    """(untouched half, what remains, which half) where the indexed remainder has this size."""
    first = F.floor(size / 2).cast("int")
    last, length = size - first, F.length(rest)
    return [(F.substring(rest, F.lit(1), first), F.substring(rest, first + 1, length), "<"), (F.substring(rest, length - last + 1, last), F.substring(rest, F.lit(1), length - last), ">")]


def _split(rows: DataFrame, size: Column) -> DataFrame:
    """Each row under both halves of its remainder: the key tells the halves so far, with the size at each."""
    options = [F.struct(F.concat_ws("\x00", "key", F.concat(size.cast("string"), F.lit(side)), half).alias("key"), rest.alias("rest")) for half, rest, side in _halves(F.col("rest"), size)]
    out = rows.withColumn("half", F.explode(F.array(*options)))
    return out.select("half.key", "half.rest", *[c for c in rows.columns if c not in ("key", "rest")])


def near_pairs(words: DataFrame, scratch: Scratch, bucket_pairs: int) -> DataFrame:
    """(a, a_n, b, b_n) of all pairs of words one edit apart, each once; a is the shorter or the first."""
    start = words.select(F.lit("").alias("key"), F.col("word").alias("rest"), "word", "n")
    index = start
    probe = start.withColumn("longer", F.explode(F.array(F.lit(0), F.lit(1))))
    found, level = None, 0
    while True:
        index = _split(index, F.length("rest"))
        probe = _split(probe, F.length("rest") - F.col("longer"))
        many = index.where(F.length("rest") > 1).groupBy("key").count().join(probe.groupBy("key").agg(F.count("*").alias("probes")), "key")
        hot = scratch.write(many.where(F.col("count") * F.col("probes") > bucket_pairs).select("key"))
        last = hot.isEmpty()
        a = index if last else index.join(hot, "key", "left_anti")
        b = probe if last else probe.join(hot, "key", "left_anti")
        pairs = _verified(a, b)
        # A pair may come by both halves of a remainder; by those of the whole words it comes once.
        found = pairs if level == 0 else found.union(pairs.dropDuplicates(["a", "b"]) if last and level == 1 else pairs)
        if last:
            return found if level < 2 else found.dropDuplicates(["a", "b"])
        index = scratch.write(index.join(hot, "key", "left_semi"))
        probe = scratch.write(probe.join(hot, "key", "left_semi"))
        level += 1


def _verified(index: DataFrame, probe: DataFrame) -> DataFrame:
    a = index.select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = probe.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), "longer")
    first = F.floor(F.length("a") / 2).cast("int")
    by_end = F.element_at(F.split("key", "\x00"), 2).endswith(">")
    once = ~by_end | (F.substring("a", F.lit(1), first) != F.substring("b", F.lit(1), first))
    met = a.join(b, "key").where(((F.col("longer") == 1) | (F.col("a") < F.col("b"))) & once)
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n")


def spelling_forms(words: DataFrame, scratch: Scratch, config: Spelling = Spelling()) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of ``words(word, n)``."""
    words = scratch.write(words.select("word", "n"))
    pairs = near_pairs(words, scratch, config.bucket_pairs)
    sides = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("m"))))
    best = pairs.select(sides.alias("s")).select("s.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    likely = -F.col("best.m") >= config.ratio * F.col("n")
    told = words.join(best, "word", "left").select(
        "word", F.when(likely, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(likely, -F.col("best.m")).alias("form_n")
    )
    told = scratch.write(told)
    roots = scratch.write(told.where("form is not null").select("word", F.col("form").alias("root")))
    while True:  # each round doubles how far a root is from its word
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = scratch.write(roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        scratch.drop(roots)
        roots = further.select("word", "root")
        if further.where("moved").isEmpty():
            break
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, config: Spelling = Spelling(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The words of ``docs`` with the form and root of each."""
    scratch = Scratch(docs.sparkSession, "spelling")
    return spelling_forms(corpus_words(docs, config, id_column, text_column), scratch, config)
