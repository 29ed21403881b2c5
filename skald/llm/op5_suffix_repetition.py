"""Quality rules from a suffix array over words.

For every document the suffixes of its word sequence are sorted by prefix
doubling (only suffixes still tied are sorted again).  The longest common
prefixes of neighbours in that order give the longest-common-prefix intervals:
each suffix's longest prefix that occurs elsewhere in the document.  The union
of those spans is the repeated part of the document; its share and the longest
repeat are limited.

Defined results: a null or empty text has no words and fails the base rules;
ties and repeated rows are judged row by row; a text of any length is judged
whole, as a chunk of its own, with memory in proportion to its words and, where
a long repeat asks for more doublings, to their number; an empty table gives no
rows; extra columns pass through the
filter untouched and cannot clash, as the verdict's columns are made from
``doc_id`` and ``text`` only (``quality_statistics``) or joined to nothing
(``keep_unrepetitive`` returns the rows as they came).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import batches as B


@dataclass(frozen=True)
class RepetitionLimits:
    """Limits of the base rules and of the suffix-array verdict."""

    min_words: int = 20
    #: Words in a window of the base rule, and its limit in percent.
    window: int = 8
    max_window_percent: int = 30
    #: Shortest repeat, in words, that counts as covered by the verdict.
    min_repeat: int = 5
    max_covered: float = 0.35
    #: A longest repeat beyond both of these fails the document.
    max_repeat_words: int = 100
    max_repeat_share: float = 0.25


def _longest_repeats(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each word position, the length of its longest prefix found elsewhere in its document.

    ``words`` are hashes, ``first`` the n+1 offsets of the documents.  Words of
    all documents are sorted together; a sentinel after each document that
    equals nothing keeps repeats inside it.
    """
    n_docs, n = len(first) - 1, len(words)
    if n == 0:
        return np.zeros(0, np.int64)
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    place = np.arange(n) + doc  # a sentinel follows each document
    size = n + n_docs
    key = words ^ B.mix64(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(sorted_key[1:], sorted_key[:-1], out=new[1:])
    start = np.flatnonzero(new)
    group = np.repeat(start, np.diff(np.append(start, n)))
    rank = np.arange(n, n + size, dtype=np.int64)  # sentinels: unique
    rank[place[order]] = group
    levels = [rank.copy()]
    sa = place[order]  # suffixes in order of their first 2^level words
    length = 1
    tied = _tied(group, n)
    while len(tied):
        # tied: indexes into sa whose group has several suffixes
        at = sa[tied]
        own = rank[at]
        beyond = at + length
        nxt = rank[np.minimum(beyond, size - 1)]
        inner = np.lexsort((nxt, own))
        at, own, nxt = at[inner], own[inner], nxt[inner]
        sa[tied] = at
        differs = np.empty(len(at), bool)
        differs[0] = True
        differs[1:] = (own[1:] != own[:-1]) | (nxt[1:] != nxt[:-1])
        begin = np.flatnonzero(differs)
        count = np.diff(np.append(begin, len(at)))
        fresh = np.repeat(tied[begin], count)
        rank[at] = fresh
        levels.append(rank.copy())
        tied = tied[np.repeat(count > 1, count)]
        length *= 2
    # Neighbours in suffix order that share their first word.
    first_rank = levels[0]
    a, b = sa[:-1], sa[1:]
    together = np.flatnonzero(first_rank[a] == first_rank[b])
    a, b = a[together], b[together]
    lcp = np.zeros(len(a), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        r = levels[level]
        pa_, pb_ = np.minimum(a + lcp, size - 1), np.minimum(b + lcp, size - 1)
        lcp += np.where(r[pa_] == r[pb_], 1 << level, 0)
    best = np.zeros(size, np.int64)
    best[a] = lcp
    # a holds each suffix at most once, and so does b.
    best[b] = np.maximum(best[b], lcp)
    return best[place]


def _tied(group: np.ndarray, n: int) -> np.ndarray:
    start = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else group[:0]
    count = np.diff(np.append(start, n))
    return np.flatnonzero(np.repeat(count > 1, count))


def _covered(lengths: np.ndarray, first: np.ndarray, least: int) -> np.ndarray:
    """Words of each document inside some repeat of at least ``least`` words."""
    n = len(lengths)
    step = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(lengths >= least)
    np.add.at(step, at, 1)
    np.add.at(step, at + lengths[at], -1)
    inside = B.running(np.cumsum(step[:-1]) > 0)
    return inside[first[1:]] - inside[first[:-1]]


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

_STATS = pa.schema(
    [(x, pa.int64()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat")]
)


def statistics_of(data: np.ndarray, off: np.ndarray, limits: RepetitionLimits) -> dict[str, np.ndarray]:
    """The statistics of each text in a chunk."""
    starts, ends, first = B.word_spans(data, off)
    chars = B.running((data & 0xC0) != 0x80)
    word_chars = B.running(chars[ends] - chars[starts])
    symbols = B.running(_SYMBOL[data])
    lengths = _longest_repeats(B.span_hashes(data, starts, ends), first)
    longest = np.zeros(len(off) - 1, np.int64)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        longest[full] = np.maximum.reduceat(lengths, first[full])
    return {
        "n_words": np.diff(first),
        "word_chars": word_chars[first[1:]] - word_chars[first[:-1]],
        "n_symbols": symbols[off[1:]] - symbols[off[:-1]],
        "n_dup_lines": _repeated_lines(data, off, starts),
        "n_repeat_words": _covered(lengths, first, limits.window),
        "n_covered_words": _covered(lengths, first, limits.min_repeat),
        "longest_repeat": longest,
    }


def _repeated_lines(data: np.ndarray, off: np.ndarray, word_starts: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their document."""
    n_docs = len(off) - 1
    breaks = np.flatnonzero(data == 10)
    broken = np.searchsorted(off, breaks, "right") - 1  # the break's document; empty texts hold none
    lines_in = np.bincount(broken, minlength=n_docs) + 1
    doc_of = np.repeat(np.arange(n_docs), lines_in)
    head = np.cumsum(lines_in) - lines_in
    begin = np.empty(len(doc_of), np.int64)
    rest = np.ones(len(doc_of), bool)
    rest[head] = False
    begin[head] = off[:-1]
    begin[rest] = breaks + 1
    end = np.empty(len(doc_of), np.int64)
    end[:-1] = begin[1:] - 1
    end[head + lines_in - 1] = off[1:]
    use = np.searchsorted(word_starts, end) > np.searchsorted(word_starts, begin)
    h = B.span_hashes(data, begin[use], end[use]) ^ B.mix64(doc_of[use].astype(np.uint64) + np.uint64(7))
    order = np.argsort(h, kind="stable")
    same = np.zeros(len(h), bool)
    if len(h):
        same[order[1:]] = h[order][1:] == h[order][:-1]
    return np.bincount(doc_of[use][same], minlength=n_docs).astype(np.int64)


def quality_statistics(docs: DataFrame, limits: RepetitionLimits = RepetitionLimits(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: its id, the statistics, ``base_failed`` and ``kept``."""

    def run(it):
        for rows, data, off in B.chunks(it, text_column):
            s = statistics_of(data, off, limits)
            yield pa.RecordBatch.from_arrays([B.column_of(rows, id_column), *(pa.array(s[x]) for x in _STATS.names)], names=[id_column, *_STATS.names])

    out = T.StructType([docs.schema[id_column], *(T.StructField(x, T.LongType()) for x in _STATS.names)])
    stats = B.map_batches(docs.select(id_column, text_column), run, out)
    return stats.withColumn("base_failed", _base_failed(limits)).withColumn("kept", ~F.col("base_failed") & _verdict(limits))


def _base_failed(limits: RepetitionLimits):
    return (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_window_percent * F.col("n_words"))


def _verdict(limits: RepetitionLimits):
    return (F.col("n_covered_words") <= limits.max_covered * F.col("n_words")) & (
        (F.col("longest_repeat") <= limits.max_repeat_words) | (F.col("longest_repeat") <= limits.max_repeat_share * F.col("n_words"))
    )


def keep_unrepetitive(docs: DataFrame, limits: RepetitionLimits = RepetitionLimits(), text_column: str = "text") -> DataFrame:
    """The rows whose text passes all rules, with the columns they came with."""

    def run(it):
        for rows, data, off in B.chunks(it, text_column):
            s = statistics_of(data, off, limits)
            n = s["n_words"]
            good = (n >= limits.min_words) & (100 * s["n_repeat_words"] <= limits.max_window_percent * n)
            good &= s["n_covered_words"] <= limits.max_covered * n
            good &= (s["longest_repeat"] <= limits.max_repeat_words) | (s["longest_repeat"] <= limits.max_repeat_share * n)
            yield rows.filter(pa.array(good))

    return B.map_batches(docs, run, docs.schema)
