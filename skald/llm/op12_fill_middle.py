"""Fill-in-middle transformation on whole Arrow batches.

The texts of a chunk are one run of UTF-8 bytes.  A table maps each byte to its
class, a mask over the classes of adjacent bytes tells where units begin, and
sums of that mask that start anew with each document count the units.  All cuts
of all rows are then found together by one binary search in these sums.  Units
are code points, words (with the white space that follows) or lines.

A text is cut in prefix, middle and suffix and put in one of two orders, with
marks, or stays plain.  Where and whether is drawn from the row's id alone, so
that a rerun, another partitioning or a lost executor changes nothing.

Defined results: a null text counts as empty and is plain, as is a text that
holds one of the marks; a null id draws as an empty one; repeated rows are
alike; a text of any length is cut whole (it is a chunk of its own); a table
without rows gives none.  ``transform`` keeps all columns and replaces those
that have the names of its own; the digests read id and text only, so that no
other column can clash.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import batches as B

CHUNK_BYTES = 1 << 20

#: Fixed values of the format.
MARKS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
PLAIN, PSM, SPM = "plain", "psm", "spm"
_ORDER = {PSM: ("prefix", "suffix", "middle"), SPM: ("suffix", "prefix", "middle")}

_CONTINUES, _SOLID, _SPACE, _BREAK = range(4)


def _byte_classes() -> np.ndarray:
    out = np.full(256, _SOLID, np.uint8)
    out[0x80:0xC0] = _CONTINUES
    out[B.ASCII_SPACE] = _SPACE
    out[0x0A] = _BREAK
    return out


_CLASS = _byte_classes()


def _borders(unit: str) -> np.ndarray:
    """For the classes of a byte and of the one before, whether a unit begins at the byte; the index is 4 * before + class."""
    before, here = np.divmod(np.arange(16), 4)
    if unit == "char":
        return here != _CONTINUES
    if unit == "word":
        return (here == _SOLID) & (before >= _SPACE)
    if unit == "line":
        return before == _BREAK
    raise ValueError(f"no such unit: {unit}")


@dataclass(frozen=True)
class FillMiddle:
    """``plain`` and ``spm`` are shares in per cent; the second is of what is not plain."""

    seed: int = 1
    unit: str = "char"
    plain: int = 10
    spm: int = 20


def _draws(id_column: str, seed: int) -> Column:
    """Four draws of 32 bits from the id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)))


def unit_cuts(data: np.ndarray, off: np.ndarray, unit: str, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(units of each text, units before its two cuts, bytes where they are); a cut falls after draw % (units + 1) units."""
    begins = np.zeros(len(data), bool)
    if len(data):
        kind = _CLASS[data]
        begins[1:] = _borders(unit)[4 * kind[:-1] + kind[1:]]
        begins[off[:-1][off[:-1] < off[1:]]] = True
    so_far = np.cumsum(begins)
    at = np.append(0, so_far)[off]
    n = at[1:] - at[:-1]
    units = np.sort(draws % (n + 1)[:, None], axis=1)
    place = np.searchsorted(so_far, (at[:-1, None] + units + 1).ravel()).reshape(-1, 2)
    return n, units, np.minimum(place, off[1:, None])


def _marked(data: np.ndarray) -> np.ndarray:
    """Where a mark begins."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    at = np.flatnonzero((data[:-2] == MARKS["prefix"][0]) & (data[2:] == MARKS["prefix"][2]))
    return at[np.isin(data[at + 1], [m[1] for m in MARKS.values()])]


def _rows_of_marks(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks that lie whole within a row, and their rows."""
    at = _marked(data)
    row = np.searchsorted(off, at, "right") - 1
    whole = at + 3 <= off[row + 1]
    return at[whole], row[whole]


def _gather(source: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces (rows x pieces) of source in a row, and n+1 offsets of the rows."""
    edge = B.running(size.ravel())
    shift = np.repeat((begin.ravel() - edge[:-1]).astype(np.int64), size.ravel())
    return source[shift + np.arange(int(edge[-1]))], edge[:: size.shape[1]]


@dataclass
class Rearranged:
    n: np.ndarray
    form: np.ndarray
    units: np.ndarray
    data: np.ndarray
    off: np.ndarray

    def columns(self) -> dict[str, pa.Array]:
        plain = self.form == PLAIN
        return {
            "n": pa.array(self.n), "form": pa.array(self.form, pa.string()),
            "prefix_units": pa.array(self.units[:, 0], mask=plain), "middle_units": pa.array(self.units[:, 1] - self.units[:, 0], mask=plain),
        }


def rearrange(data: np.ndarray, off: np.ndarray, draws: np.ndarray, config: FillMiddle = FillMiddle()) -> Rearranged:
    """All texts of a chunk; ``draws`` has four for each."""
    n, units, cut = unit_cuts(data, off, config.unit, draws[:, :2])
    form = np.where(draws[:, 3] % 100 < config.spm, SPM, PSM).astype(object)
    form[(draws[:, 2] % 100 >= 100 - config.plain) | (off[1:] == off[:-1])] = PLAIN
    form[_rows_of_marks(data, off)[1]] = PLAIN

    source = np.concatenate([data, np.frombuffer(b"".join(MARKS.values()), np.uint8)])
    mark = {name: len(data) + 3 * k for k, name in enumerate(MARKS)}
    part = {"prefix": (off[:-1], cut[:, 0]), "middle": (cut[:, 0], cut[:, 1]), "suffix": (cut[:, 1], off[1:])}
    begin, size = np.zeros((len(n), 6), np.int64), np.zeros((len(n), 6), np.int64)
    begin[:, 0], size[:, 0] = off[:-1], off[1:] - off[:-1]
    for kind, names in _ORDER.items():
        rows = form == kind
        for k, name in enumerate(names):
            a, b = part[name]
            begin[rows, 2 * k], size[rows, 2 * k] = mark[name], 3
            begin[rows, 2 * k + 1], size[rows, 2 * k + 1] = a[rows], (b - a)[rows]
    return Rearranged(n, form, units, *_gather(source, begin, size))


def rebuild(data: np.ndarray, off: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, which rows could be rebuilt) of the texts behind outputs of these forms.

    A row that is not plain must have three marks in the order of its form, the first at its start.
    """
    n = len(form)
    at, row = _rows_of_marks(data, off)
    other = form[row] != PLAIN
    at, row = at[other], row[other]
    first = np.searchsorted(row, np.arange(n))
    good = (np.bincount(row, minlength=n) == 3) | (form == PLAIN)
    begin, size = np.zeros((n, 3), np.int64), np.zeros((n, 3), np.int64)
    begin[:, 0], size[:, 0] = off[:-1], np.where(form == PLAIN, off[1:] - off[:-1], 0)
    for kind, names in _ORDER.items():
        rows = np.flatnonzero(good & (form == kind))
        mark = at[first[rows][:, None] + np.arange(3)] if len(rows) else np.zeros((0, 3), np.int64)
        letters = np.array([MARKS[name][1] for name in names], np.uint8)
        right = (data[mark + 1] == letters).all(1) & (mark[:, 0] == off[rows])
        good[rows[~right]] = False
        rows, mark = rows[right], mark[right]
        until = np.column_stack([mark[:, 1:], off[rows + 1]])
        for k, name in enumerate(names):
            place = ("prefix", "middle", "suffix").index(name)
            begin[rows, place], size[rows, place] = mark[:, k] + 3, until[:, k] - mark[:, k] - 3
    return *_gather(data, begin, size), good


def _strings(data: np.ndarray, off: np.ndarray, good: np.ndarray | None = None) -> pa.Array:
    out = pa.Array.from_buffers(pa.large_string(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data)])
    out = out.cast(pa.string())
    return out if good is None or good.all() else pc.if_else(pa.array(good), out, pa.scalar(None, pa.string()))


def _hex(data: np.ndarray, off: np.ndarray) -> pa.Array:
    view = memoryview(np.ascontiguousarray(data))
    return pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(off[:-1].tolist(), off[1:].tolist())], pa.string())


def _four(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, 4)


_COUNTS = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_units", T.LongType()), T.StructField("middle_units", T.LongType())]
_OWN = T.StructType([*_COUNTS, T.StructField("output", T.StringType())])


def transform(docs: DataFrame, config: FillMiddle = FillMiddle(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows with n (units), form, prefix_units, middle_units (null where plain) and output, the text as training takes it."""
    kept = [c for c in docs.columns if c not in _OWN.names]
    draws = "_draws" + "_" * max(map(len, docs.columns))  # longer than any name there is

    def run(it):
        for rows, data, off in B.chunks(it, text_column, CHUNK_BYTES):
            made = rearrange(data, off, _four(B.column_of(rows, draws)), config)
            own = made.columns() | {"output": _strings(made.data, made.off)}
            yield pa.RecordBatch.from_arrays([*(B.column_of(rows, c) for c in kept), *own.values()], names=[*kept, *own])

    source = docs.select(*dict.fromkeys([*kept, text_column]), _draws(id_column, config.seed).alias(draws))
    return B.map_batches(source, run, T.StructType([*(docs.schema[c] for c in kept), *_OWN.fields]))


def restore(made: DataFrame, output_column: str = "output", form_column: str = "form", text_column: str = "restored") -> DataFrame:
    """The rows with the exact text behind each output; null where output and form do not fit together or one is null."""
    kept = [c for c in made.columns if c != text_column]

    def run(it):
        for rows, data, off in B.chunks(it, output_column, CHUNK_BYTES):
            form = np.array(B.column_of(rows, form_column).to_pylist(), object)
            known = np.isin(form.astype(str), (PLAIN, PSM, SPM)) & ~np.asarray(B.column_of(rows, output_column).is_null())
            text, edge, good = rebuild(data, off, form)
            yield pa.RecordBatch.from_arrays([*(B.column_of(rows, c) for c in kept), _strings(text, edge, good & known)], names=[*kept, text_column])

    source = made.select(*dict.fromkeys([*kept, output_column]))
    return B.map_batches(source, run, T.StructType([*(made.schema[c] for c in kept), T.StructField(text_column, T.StringType())]))


def transform_and_check(docs: DataFrame, config: FillMiddle = FillMiddle(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, n, form, prefix_units, middle_units, and SHA-256 of the output and of the text rebuilt from output and form."""

    def run(it):
        for rows, data, off in B.chunks(it, text_column, CHUNK_BYTES):
            made = rearrange(data, off, _four(B.column_of(rows, "draws")), config)
            text, edge, good = rebuild(made.data, made.off, made.form)
            if not good.all():
                raise AssertionError("an output cannot be rebuilt")
            own = made.columns() | {"output_sha256": _hex(made.data, made.off), "restored_sha256": _hex(text, edge)}
            yield pa.RecordBatch.from_arrays([B.column_of(rows, id_column), *own.values()], names=[id_column, *own])

    source = docs.select(id_column, text_column, _draws(id_column, config.seed).alias("draws"))
    own = [*_COUNTS, T.StructField("output_sha256", T.StringType()), T.StructField("restored_sha256", T.StringType())]
    return B.map_batches(source, run, T.StructType([docs.schema[id_column], *own]))
