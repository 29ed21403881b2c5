"""Language identification by cross-parsing entropy over suffix automata.

For each language a suffix automaton is built of the whole texts of a bounded
number of labelled rows.  A document becomes its letters in lower case with one
gap between words, and is parsed greedily into the longest phrases that occur
in that text, across words; a letter that the text lacks is a phrase of its
own.  The language that needs the fewest phrases, normalised by the reference's
length (log2) and the document's letters, wins.

The parses of all documents of a chunk go in step: a document is cut into
segments that are parsed from their first letter at the same time.  Where the
phrase that enters a segment ends elsewhere, the segment is parsed again from
there until it meets a phrase border found before; from that border on both
parses are the same.  So the phrases counted are those of one parse from the
document's first letter to its last.

Defined results: ``und`` with score 0 for a null text or one without letters;
ties go to the language first in alphabetical order; without any labelled row
every row is ``und``.  Repeated rows are judged alike; an id that stands twice
with different languages counts for both; only id, text and lang are read, so
other columns cannot clash; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import batches as B
from .sampling import fitting_ids, held_out, one_row_each, sample_ids

CHUNK_BYTES = 4 << 20

#: Symbols of an automaton: 0 stands for what its reference lacks, and for the end of a text.
_LACKING = 0

#: Most cells of a dense table of transitions; a larger automaton (many letters) keeps them in a hash table.
_DENSE = 1 << 24


@dataclass(frozen=True)
class CrossParsing:
    #: Labelled rows per language whose whole texts are the reference, at most.
    documents: int = 40
    #: Bytes of those texts per language, at most, but for a language whose shortest sampled text is longer: that one is taken.
    reference_bytes: int = 1 << 18
    #: Letters of a document parsed in step with others.
    segment: int = 256


@cache
def _letters() -> np.ndarray:
    """For each code point of the basic plane, whether it is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x10000)])


def spelled(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts: letters in lower case, 0 for each gap, and -1 after each text; and n+1 offsets."""
    padded = [f" {t.lower()}  " for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    off = B.running(np.array([len(t) for t in padded], np.int64))
    letter = _letters()[np.minimum(points, 0xFFFF)]
    high = np.flatnonzero(points > 0xFFFF)
    if len(high):
        letter[high] = [chr(c).isalpha() for c in points[high].tolist()]
    points[~letter] = 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[off[:-1]] = True
    points[off[1:] - 1], keep[off[1:] - 1] = -1, True
    return points[keep], B.running(keep)[off]


class Automaton:
    """Suffix automaton of a sequence of code points (0 for a gap)."""

    def __init__(self, points: np.ndarray):
        self.known = np.unique(points)
        self.width = len(self.known) + 1
        codes = (np.searchsorted(self.known, points) + 1).tolist()
        moves: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        last = 0
        for c in codes:
            cur = len(moves)
            moves.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p != -1 and c not in moves[p]:
                moves[p][c] = cur
                p = link[p]
            if p != -1:
                q = moves[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    twin = len(moves)
                    moves.append(dict(moves[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p != -1 and moves[p].get(c) == q:
                        moves[p][c] = twin
                        p = link[p]
                    link[q] = link[cur] = twin
            last = cur
        #: A state without any transition.
        self.dead = len(moves)
        count = [len(m) for m in moves]
        cells = np.repeat(np.arange(len(moves), dtype=np.int64), count) * self.width
        cells += np.fromiter((c for m in moves for c in m), np.int64, len(cells))
        targets = np.fromiter((to for m in moves for to in m.values()), np.int64, len(cells))
        self.cells, self.targets = cells, targets.astype(np.int32)
        self._lay_out()

    def _lay_out(self) -> None:
        """Makes the table that ``step`` reads of the transitions."""
        self.dense = None
        if (self.dead + 1) * self.width <= _DENSE:
            self.dense = np.full((self.dead + 1) * self.width, -1, np.int32)
            self.dense[self.cells] = self.targets
        else:
            self._fill(self.cells.astype(np.uint64), self.targets.astype(np.uint64))

    def __getstate__(self) -> dict:
        # The transitions alone travel: a dense table is many times as large, and a broadcast stands on the disks of all.
        return {"known": self.known, "width": self.width, "dead": self.dead, "cells": self.cells, "targets": self.targets}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._lay_out()

    def symbols(self, points: np.ndarray) -> np.ndarray:
        """The symbols of code points as ``spelled`` gives them."""
        low = np.zeros(0x10000, np.int64)
        low[self.known[self.known < 0x10000]] = 1 + np.flatnonzero(self.known < 0x10000)
        out = low[np.clip(points, 0, 0xFFFF)]
        odd = np.flatnonzero((points < 0) | (points >= 0xFFFF))
        at = np.minimum(np.searchsorted(self.known, points[odd]), len(self.known) - 1)
        out[odd] = np.where(self.known[at] == points[odd], at + 1, _LACKING)
        return out

    def _fill(self, keys: np.ndarray, targets: np.ndarray) -> None:
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.table = np.uint64(64 - bits), np.zeros((1 << bits) + 64, np.uint64)
        entry, place = (keys + np.uint64(1)) << np.uint64(24) | targets, self._place(keys)
        left = np.arange(len(keys))
        while len(left):  # each free place takes one of those that want it
            free = left[self.table[place[left]] == 0]
            self.table[place[free]] = entry[free]
            left = left[self.table[place[left]] != entry[left]]
            place[left] += 1

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Where each state goes with its symbol; -1 for nowhere."""
        if self.dense is not None:
            return self.dense[state * self.width + symbol]
        key = (state * self.width + symbol).astype(np.uint64)
        place, want = self._place(key), key + np.uint64(1)
        entry = self.table[place]
        out = np.where(entry >> np.uint64(24) == want, (entry & np.uint64(0xFFFFFF)).astype(np.int64), -1)
        left = np.flatnonzero((out < 0) & (entry != 0))
        while len(left):
            place[left] += 1
            entry = self.table[place[left]]
            hit = entry >> np.uint64(24) == want[left]
            out[left[hit]] = (entry[hit] & np.uint64(0xFFFFFF)).astype(np.int64)
            left = left[~hit & (entry != 0)]
        return out

    def parse(self, codes: np.ndarray, begin: np.ndarray, end: np.ndarray, borders: np.ndarray, known: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(phrases that start before ``end``, where the last one ends) of parses from ``begin``, all in step.

        ``borders`` gets the number of each phrase at its start.  With ``known``
        results of the parses that left these borders, a parse that meets one
        takes over what follows it.
        """
        n = len(begin)
        phrases, exits = np.zeros(n, np.int64), begin.copy()
        lane = np.flatnonzero(begin < end)
        at, state, count = begin[lane], np.full(len(lane), self.dead), np.zeros(len(lane), np.int64)
        while len(lane):
            symbol = codes[at]
            to = self.step(state, symbol)
            miss = np.flatnonzero(to < 0)
            if len(miss):
                place = at[miss]
                over = place >= end[lane[miss]]
                met = borders[place] if known else None
                if known:
                    joins = ~over & (met >= 0)
                    own = miss[joins]
                    phrases[lane[own]] = count[own] + known[0][lane[own]] - met[joins]
                    exits[lane[own]] = known[1][lane[own]]
                    gone = over | joins
                else:
                    gone = over
                out = miss[over]
                phrases[lane[out]], exits[lane[out]] = count[out], at[out]
                new = miss[~gone]
                if not known:
                    borders[at[new]] = count[new]
                count[new] += 1
                first = self.step(np.zeros(len(new), np.int64), symbol[new])  # from the root
                to[new] = np.where(first < 0, self.dead, first)
                if gone.any():
                    stay = np.ones(len(lane), bool)
                    stay[miss[gone]] = False
                    lane, at, to, count = lane[stay], at[stay], to[stay], count[stay]
            state = to.astype(np.int64)
            at = at + 1
        return phrases, exits

    def phrases(self, points: np.ndarray, off: np.ndarray, segment: int) -> np.ndarray:
        """Phrases of each text's whole parse; texts are as ``spelled`` gives them."""
        codes = self.symbols(points)
        size = off[1:] - 1 - off[:-1]
        pieces = -(-size // segment)
        text = np.repeat(np.arange(len(size)), pieces)
        nth = np.arange(len(text)) - np.repeat(B.running(pieces)[:-1], pieces)
        begin = off[text] + nth * segment
        end = np.minimum(begin + segment, off[text + 1] - 1)
        borders = np.full(len(codes), -1, np.int32)
        spec = self.parse(codes, begin, end, borders)
        count, exits, entry = spec[0].copy(), spec[1].copy(), begin.copy()
        later = np.flatnonzero(nth > 0)
        while len(redo := later[entry[later] != exits[later - 1]]):
            entry[redo] = exits[redo - 1]
            count[redo], exits[redo] = self.parse(codes, entry[redo], end[redo], borders, (spec[0][redo], spec[1][redo]))
        return np.bincount(text, count, len(size)).astype(np.int64)


@dataclass
class Languages:
    """What is learned: names and an automaton each."""

    names: list[str]
    automata: list[Automaton]
    weights: np.ndarray  # log2 of the reference lengths
    segment: int

    @classmethod
    def learn(cls, texts: dict[str, list[str]], config: CrossParsing = CrossParsing()) -> Languages:
        """Learn from whole texts; one that is repeated counts once."""
        parts = {}
        for name in sorted(texts):
            points, _ = spelled(list(dict.fromkeys(texts[name])))
            if (points > 0).any():
                points = points[points >= 0]
                parts[name] = points[np.append(True, (points[1:] > 0) | (points[:-1] > 0))]  # one gap between texts
        weights = np.log2([max(2, len(p)) for p in parts.values()])
        return cls(list(parts), [Automaton(p) for p in parts.values()], weights, config.segment)

    def judge(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        texts = column.to_pylist()
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not self.names or not texts:
            return names, scores
        points, off = spelled([t or "" for t in texts])
        letters = B.running(points > 0)[off]
        letters = letters[1:] - letters[:-1]
        total = np.stack([a.phrases(points, off, self.segment) for a in self.automata], 1)
        rate = total * self.weights / np.maximum(letters, 1)[:, None]
        best = rate.argmin(1)
        low = rate[np.arange(len(rate)), best]
        rate[np.arange(len(rate)), best] = np.inf
        second = rate.min(1) if len(self.names) > 1 else np.full(len(rate), np.inf)
        sure = np.where(np.isfinite(second), second / np.maximum(second + low, 1e-12), 1.0)
        for i in np.flatnonzero(letters):
            names[i], scores[i] = self.names[best[i]], sure[i]
        return names, scores


def learn_languages(docs: DataFrame, config: CrossParsing = CrossParsing(), id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> Languages:
    """Learn from labelled rows that are not held out (crc32 of the id, mod 5, is 0)."""
    rows = docs.select(id_column, lang_column, text_column)
    rows = rows.where(~held_out(id_column, 5, 0) & F.col(lang_column).isNotNull() & (F.length(text_column) > 0))
    picked = sample_ids(rows, id_column, lang_column, 2 * config.documents)
    chosen = fitting_ids(rows, picked, id_column, text_column, config.documents, config.reference_bytes, lang_column)
    texts: dict[str, list[str]] = {name: [] for name, ids in chosen.items() if ids}
    wanted = sorted({i for ids in chosen.values() for i in ids})
    if wanted:
        own = {(name, i) for name, ids in chosen.items() for i in ids}
        for r in sorted(one_row_each(rows, wanted, id_column, text_column, [text_column], lang_column).collect(), key=lambda r: (r[1], r[0])):
            if (r[1], r[0]) in own:
                texts[r[1]].append(r[2])
    return Languages.learn(texts, config)


def predict_language(docs: DataFrame, languages: Languages, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, held_out, lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(languages)

    def run(it):
        model = shared.value
        for rows, _, _ in B.chunks(it, text_column, CHUNK_BYTES):
            names, scores = model.judge(B.column_of(rows, text_column))
            yield pa.RecordBatch.from_arrays([B.column_of(rows, id_column), pa.array(names, pa.string()), pa.array(scores)], names=[id_column, "lang_pred", "score"])

    out = T.StructType([docs.schema[id_column], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    made = B.map_batches(docs.select(id_column, text_column), run, out)
    return made.select(id_column, held_out(id_column, 5, 0).alias("held_out"), "lang_pred", "score")
