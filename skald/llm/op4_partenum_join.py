"""N-gram Jaccard self-join with PartEnum signatures.

Sets of word shingles are joined when their Jaccard similarity reaches a
threshold.  Sizes fall in bands so that joinable sets lie in the same or in
neighbouring bands.  Each band's instance bounds the Hamming distance k of
joinable sets, splits the hash domain into first-level partitions of
second-level cells, and enumerates the subsets of cells that must agree: some
first-level partition differs in at most k2 elements, so one of its subsets of
n2 - k2 cells is the same in both sets, and its hash is a shared signature.

Signatures over empty cells alone are not emitted: with ``slack`` partitions
more than needed, some agreeing subset is non-empty unless a set leaves more
than ``slack`` partitions empty.  Such a set (rare, small) emits the families
of further independent splits as well, up to the first where it is well spread;
its partner emits the first family always, so no link is lost.

Equal sets are one node (a 64-bit fingerprint of the set).  Groups of nodes that
share a signature and have the same members are one group.  Every node has a
parity sketch, a bitmap in which each element flips one bit: the bits in which
two sketches differ are never more than the elements in which their sets
differ, so a pair whose sketches differ in more than the threshold allows is
ruled out for certain, and few others pass.  Within a group, whose members fit
in memory, only a spanning forest of the passing pairs is given out and each of
its pairs is counted exactly; where one fails, its group gives out more pairs
between what is not linked yet, in the end all of them.

A group with more than ``crowd`` members first meets in blocks dealt at random.
If verified links leave it in several components, its members are signed again
with a fresh split of the domain: linked sets share one of these signatures as
well, and a group that shares both is smaller.  What is still crowded after
``levels`` such splits meets block by block, so no link is lost.

Defined results: null or empty text gives an empty set, linked with nothing;
fewer words than a shingle give the whole sequence as one shingle; repeated
rows link as copies; a null id belongs to its component like any other row and
never names it unless the whole component has no id; columns other than id and
text are not read, so their names cannot clash; an empty table gives no rows;
very long texts are one set each, held by one task.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import batches as B
from .components import connected_components
from .durable import Scratch


@dataclass(frozen=True)
class JaccardJoin:
    """Shingle length and threshold ``percent``/100, and how signatures are cut."""

    words: int = 3
    percent: int = 90
    slack: int = 1
    #: Least mean number of elements under a signature; below it subsets of two of three cells are used.
    least_elements: float = 2.0
    families: int = 4
    #: Most members of a group that meet in one task, and how often a larger one is signed again.
    crowd: int = 4_096
    levels: int = 2
    #: Largest parity sketch; sets too large for it are ruled out less often, and counted.
    most_bits: int = 1 << 18
    #: Up to so many ids are sent to all executors to pick texts out; beyond, ids and texts meet in a shuffle.
    broadcast_ids: int = 1_000_000


_SALT = np.uint64(0xA0761D6478BD642F)
_SKETCH = np.uint64(0xE7037ED1A0B428DB)


@lru_cache(maxsize=None)
def _edges(percent: int) -> np.ndarray:
    lows = [1]
    while lows[-1] <= 1 << 31:
        lows.append(lows[-1] * 100 // percent + 1)
    return np.array(lows, np.int64)


def plan(instance: int, join: JaccardJoin) -> tuple[int, int, int, int]:
    """(n1, n2, k2, slack left) of the instance that pairs its band with itself and the next."""
    lows = _edges(join.percent)
    low, high = int(lows[instance]), int(lows[instance + 1]) - 1
    partner = high * 100 // join.percent
    k = (high + partner) * (100 - join.percent) // (100 + join.percent)
    if k == 0:
        return 1, 1, 0, 0
    slack = join.slack
    for _ in range(30):  # room for the cells that chance leaves empty
        empty = (k + 1 + slack) * np.exp(-low / (k + 1 + slack))
        need = min(int(np.ceil(empty + 3 * np.sqrt(empty))), join.slack + k // 2)
        if need <= slack:
            break
        slack = need
    n1, n2, k2 = k + 1 + slack, 1, 0
    if low / n1 < join.least_elements:
        n1, n2, k2 = k // 2 + 1 + join.slack, 3, 1
    return n1, n2, k2, n1 - k // (k2 + 1) - 1


@lru_cache(maxsize=None)
def _plans(join: JaccardJoin) -> np.ndarray:
    return np.array([plan(i, join) for i in range(len(_edges(join.percent)) - 1)], np.int64)


def _family(x: np.ndarray, at: np.ndarray, instance: np.ndarray, family: int, join: JaccardJoin, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of many sets, each in its instance: (signatures, their sets, well spread)."""
    n1, n2, _, slack = _plans(join)[instance].T
    size, cells = np.diff(at), n1 * n2
    base = np.cumsum(cells) - cells
    n_cells = int(cells.sum())
    own = np.repeat(cells.astype(np.uint64), size)
    key = np.repeat(base, size) + ((x >> np.uint64(32)) * own >> np.uint64(32)).astype(np.int64)
    count = np.bincount(key, minlength=n_cells)
    edge = np.concatenate([[0], np.cumsum(count)])
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(B.mix64(x ^ _SALT), out=total[1:])
    value = total[edge[1:]] - total[edge[:-1]]
    which = np.repeat(np.arange(len(size)), cells)
    tag = (np.arange(n_cells) - base[which]).astype(np.uint64) + ((instance[which] * 64 + family).astype(np.uint64) << np.uint64(32))
    value = B.mix64(value + B.mix64(tag))
    single = n2[which] == 1
    empty = np.bincount(which[single], (count[single] == 0), minlength=len(size)).astype(np.int64)
    sigs, sets, filled = [value[single]], [which[single]], [count[single] > 0]
    # Three cells each: any two of them must agree.
    v, c, w = value[~single].reshape(-1, 3), count[~single].reshape(-1, 3), which[~single][::3]
    empty += np.bincount(w, (c == 0).sum(1) >= 2, minlength=len(size)).astype(np.int64)
    for i, j in combinations(range(3), 2):
        sigs.append(B.mix64(v[:, i] * np.uint64(3) + v[:, j]))
        sets.append(w)
        filled.append(c[:, i] + c[:, j] > 0)
    sigs, sets, filled = (np.concatenate(y) for y in (sigs, sets, filled))
    good = empty <= slack
    keep = filled if not last else filled | ~good[sets]
    return sigs[keep], sets[keep], good


def signatures(x: np.ndarray, at: np.ndarray, join: JaccardJoin) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of many sets, given as sorted distinct hashes with n+1 offsets: (signatures, n+1 offsets)."""
    size = np.diff(at)
    band = np.searchsorted(_edges(join.percent), size, "right") - 1
    sigs, sets = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for instance in (band, band - 1):
        left = np.flatnonzero((size > 0) & (instance >= 0))
        for family in range(join.families):
            if not len(left):
                break
            part = [x[at[i] : at[i + 1]] for i in left] if len(left) < len(size) or family else None
            flat = x if part is None else np.concatenate(part)
            if family:
                again = B.mix64(np.array([family], np.uint64))
                flat = np.concatenate([np.sort(B.mix64(y ^ again)) for y in part])
            ends = np.concatenate([[0], np.cumsum(size[left])])
            s, w, good = _family(flat, ends, instance[left], family, join, family == join.families - 1)
            sigs.append(s)
            sets.append(left[w])
            left = left[~good]
    sigs, sets = np.concatenate(sigs), np.concatenate(sets)
    order = np.argsort(sets, kind="stable")
    return sigs[order], np.concatenate([[0], np.cumsum(np.bincount(sets, minlength=len(size)))])


def shingle_sets(data: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts of a chunk, and their n+1 offsets."""
    starts, ends, first = B.word_spans(data, off)
    h = B.span_hashes(data, starts, ends, B.FOLDED)
    n = np.diff(first)
    n_docs = len(n)
    count = np.where(n >= words, n - words + 1, (n > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(count)])
    begin = np.repeat(first[:-1], count) + (np.arange(at[-1]) - np.repeat(at[:-1], count))
    length = np.repeat(np.minimum(n, words), count)
    value = np.zeros(len(begin), np.uint64)
    top = max(len(h) - 1, 0)
    for j in range(words):
        step = B.mix64(value ^ (h[np.minimum(begin + j, top)] if len(h) else value))
        value = np.where(j < length, step * np.uint64(0x9E3779B97F4A7C15) + np.uint64(j + 1), value)
    keep = np.ones(len(value), bool)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        value[a:b].sort()
    keep[1:] = value[1:] != value[:-1]
    heads = at[:-1][count > 0]
    keep[heads] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    assert n_docs == len(at) - 1
    return value[keep], kept[at]


def fingerprints(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hashes of many sets of hashes."""
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(B.mix64(x), out=total[1:])
    size = np.diff(at).astype(np.uint64)
    return B.mix64(total[at[1:]] - total[at[:-1]] + size * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def sketches(x: np.ndarray, at: np.ndarray, join: JaccardJoin) -> list[bytes]:
    """Parity sketches of many sets, with eight to sixteen bits (up to ``most_bits``) for each element in which linked sets may differ."""
    size = np.diff(at)
    spare = np.maximum(size * (100 - join.percent) // join.percent, 32)
    bits = np.minimum(np.left_shift(1, np.ceil(np.log2(8 * spare)).astype(np.int64)), join.most_bits)
    base = B.running(bits)
    place = np.repeat(base[:-1], size) + (B.mix64(x ^ _SKETCH) & np.repeat(bits - 1, size).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(place, minlength=int(base[-1])) & 1).astype(bool)).tobytes()
    return [packed[i // 8 : j // 8] for i, j in zip(base[:-1].tolist(), base[1:].tolist())]


def _rows(docs: DataFrame, join: JaccardJoin, id_column: str, text_column: str) -> DataFrame:
    """(id, n_shingles, node, sketch): node and sketch are null for an empty set."""

    def run(it):
        for rows, data, off in B.chunks(it, text_column):
            x, at = shingle_sets(data, off, join.words)
            size = np.diff(at)
            made = [pa.array(size), pa.array(fingerprints(x, at), mask=size == 0), pa.array(sketches(x, at, join), pa.binary(), mask=size == 0)]
            yield pa.RecordBatch.from_arrays([B.column_of(rows, id_column), *made], names=[id_column, "n_shingles", "node", "sketch"])

    out = T.StructType([docs.schema[id_column], *T._parse_datatype_string("n_shingles long, node long, sketch binary").fields])
    return B.map_batches(docs.select(id_column, text_column), run, out)


def _signatures_of(docs: DataFrame, join: JaccardJoin, text_column: str) -> DataFrame:
    """(sig, node) of all texts; equal sets within a task give their signatures once.

    The rows go straight into a shuffle: computing sets twice costs less than
    keeping the signatures on disk.
    """

    def run(it):
        seen: set[int] = set()
        for rows, data, off in B.chunks(it, text_column):
            x, at = shingle_sets(data, off, join.words)
            nodes, size = fingerprints(x, at), np.diff(at)
            new = np.zeros(rows.num_rows, bool)
            for i, node in enumerate(nodes.tolist()):
                if node not in seen:
                    seen.add(node)
                    new[i] = True
            sigs, ends = signatures(x[np.repeat(new, size)], B.running(size * new), join)
            yield pa.RecordBatch.from_arrays([pa.array(sigs.view(np.int64)), pa.array(np.repeat(nodes, np.diff(ends)))], names=["sig", "node"])

    return B.map_batches(docs.select(text_column), run, "sig long, node long")


def _signed_again(sets: DataFrame, crowded: DataFrame, level: int, join: JaccardJoin) -> DataFrame:
    """(sig, node): signatures of a fresh split, each under the crowded group in which it counts."""
    salt = B.mix64(np.array([level + 1_000], np.uint64))

    def run(it):
        for batch in it:
            for i in range(batch.num_rows):
                x = np.sort(B.mix64(np.asarray(batch.column(1)[i].values).view(np.uint64) ^ salt))
                sigs, _ = signatures(x, np.array([0, len(x)]), join)
                groups = np.asarray(batch.column(2)[i].values).view(np.uint64)
                both = B.mix64(groups[:, None] * np.uint64(3) + sigs[None, :]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(both.view(np.int64)), pa.array(np.repeat(np.asarray(batch.column(0))[i], len(both)))], names=["sig", "node"])

    # A node is in as many groups as it has signatures, at most.
    held = crowded.groupBy("node").agg(F.collect_list("group").alias("groups"))
    return sets.join(held, "node").select("node", "shingles", "groups").mapInArrow(run, "sig long, node long")


def _grouped(it, crowd: int):
    """From rows sorted by (sig, node): (group, node, crowded) of every signature with several nodes.

    At most ``crowd`` nodes are held at once; a larger group passes through.
    """
    told: set[int] = set()
    kept: list[np.ndarray] = []
    held, last, crowded = 0, None, False

    def named(nodes: np.ndarray) -> list[tuple[int, np.ndarray, bool]]:
        total = B.mix64(nodes.view(np.uint64)).sum(keepdims=True) ^ np.uint64(len(nodes))
        own = int(B.mix64(total).view(np.int64)[0])
        if own in told:
            return []
        told.add(own)
        return [(own, nodes, False)]

    def batch_of(out: list[tuple[int, np.ndarray, bool]]) -> pa.RecordBatch:
        size = [len(nodes) for _, nodes, _ in out]
        group, large = np.repeat(np.array([g for g, _, _ in out], np.int64), size), np.repeat([c for _, _, c in out], size)
        return pa.RecordBatch.from_arrays([pa.array(group), pa.array(np.concatenate([nodes for _, nodes, _ in out])), pa.array(large)], names=["group", "node", "crowded"])

    for batch in it:
        sig, node = (np.asarray(batch.column(i)) for i in range(2))
        if not len(sig):
            continue
        fresh = np.ones(len(sig), bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        sig, node = sig[fresh], node[fresh]
        begin = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        end = np.append(begin[1:], len(sig))
        use = end - begin > 1  # and those that may go on in another batch
        use[[0, -1]] = True
        out = []
        for a, b in zip(begin[use].tolist(), end[use].tolist()):
            if sig[a] != last:
                if held > 1 and not crowded:
                    out += named(np.concatenate(kept))
                kept, held, last, crowded = [], 0, int(sig[a]), False
            part = node[a:b]
            if kept and kept[-1][-1] == part[0]:  # goes on from the batch before
                part = part[1:]
                if not len(part):
                    continue
            held += len(part)
            kept.append(part)
            if crowded or held > crowd:
                out.append((last, part if crowded else np.concatenate(kept), True))
                kept, crowded = [part[-1:]], True
        if out:
            yield batch_of(out)
    if held > 1 and not crowded and (rest := named(np.concatenate(kept))):
        yield batch_of(rest)


def _groups_of(signed: DataFrame, join: JaccardJoin) -> DataFrame:
    """(group, node, crowded) of all signatures with several nodes.

    Groups of the same members are one, named by them; one too large to be held
    is named by its signature.
    """
    grouped = signed.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(lambda it: _grouped(it, join.crowd), "group long, node long, crowded boolean")
    return grouped.dropDuplicates()


def _apart(sketch: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    return np.bitwise_count(sketch[others] ^ sketch[i]).sum(1, dtype=np.int64)


def forest(n: np.ndarray, sketch: list[bytes], root: np.ndarray, join: JaccardJoin, most: int) -> list[tuple[int, int]]:
    """Pairs of members of one group that may be linked: a spanning forest of them over the roots, or up to ``most`` for each member."""
    least = min(map(len, sketch))
    flat = np.stack([np.bitwise_xor.reduce(np.frombuffer(s, np.uint64).reshape(-1, least // 8), 0) for s in sketch])
    bits = 8 * least
    out: list[tuple[int, int]] = []

    def passing(i: int, others: np.ndarray, share: float) -> np.ndarray:
        """Those of the others whose estimated (share < 1) or least possible (share 1) distance is small enough."""
        allowed = (n[others] + n[i]) * (100 - join.percent) // (100 + join.percent)
        far = _apart(flat, i, others)
        if share < 1:
            guess = -0.5 * bits * np.log(np.maximum(1 - 2 * far / bits, 1e-9))
            return others[(far <= allowed) & (guess <= share * allowed)]
        return others[far <= allowed]

    if most > 1:
        order = np.arange(len(n))
        for i in range(len(n) - 1):
            later = order[i + 1 :]
            out += [(i, int(j)) for j in passing(i, later[root[later] != root[i]], 1.0)[:most]]
        return out
    label = np.unique(root, return_inverse=True)[1]
    for share in (0.9, 1.0):  # likely links first, so that few pairs of the forest fail
        waiting = np.ones(len(n), bool)
        while waiting.any():
            first = int(np.flatnonzero(waiting)[0])
            queue = np.flatnonzero(label == label[first]).tolist()
            waiting[queue] = False
            while queue:
                i = queue.pop()
                others = np.flatnonzero(waiting)
                if not len(others):
                    break
                for j in passing(i, others, share).tolist():
                    if waiting[j]:
                        out.append((i, j))
                        joined = np.flatnonzero(label == label[j])
                        label[joined] = label[i]
                        waiting[joined] = False
                        queue += joined.tolist()
            waiting &= label != label[first]
    return out


def _pairs_of(members: DataFrame, join: JaccardJoin, most: int) -> DataFrame:
    """(a, b): pairs to be verified, of members (group, node, n, sketch, root) of groups that each fit in memory."""

    def run(it):
        left: list[pa.RecordBatch] = []
        for batch in it:
            group = np.asarray(batch.column(0))
            if not len(group):
                continue
            last = int(np.searchsorted(group, group[-1], "left"))
            if last:
                yield from met(pa.Table.from_batches([*left, batch.slice(0, last)]))
                left = []
            left.append(batch.slice(last))
            if left[0].column(0)[0].as_py() != group[-1]:
                yield from met(pa.Table.from_batches(left[:-1]))
                left = left[-1:]
        if left:
            yield from met(pa.Table.from_batches(left))

    def met(table: pa.Table):
        group, node, n, root = (table.column(i).to_numpy() for i in (0, 1, 2, 4))
        begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        out = []
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(group)]):
            if b - a > 1 and (root[a:b] != root[a]).any():
                own = node[a:b]
                out += [(own[i], own[j]) for i, j in forest(n[a:b], table.column(3).slice(a, b - a).to_pylist(), root[a:b], join, most)]
        if out:
            both = np.sort(np.array(out, np.int64), 1)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    dealt = members.select("group", "node", "n", "sketch", "root").repartition("group").sortWithinPartitions("group", "node")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _sets_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, join: JaccardJoin, scratch: Scratch, id_column: str, text_column: str) -> DataFrame:
    """(node, shingles) of the wanted nodes, from the texts of one row of each."""

    def run(it):
        seen: set[int] = set()
        for _, data, off in B.chunks(it, text_column):
            x, at = shingle_sets(data, off, join.words)
            made = fingerprints(x, at)
            new = [i for i, node in enumerate(made.tolist()) if not (node in seen or seen.add(node))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(made), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x.view(np.int64)))], names=["node", "shingles"]
            ).take(pa.array(new, pa.int64()))

    few = wanted.limit(join.broadcast_ids + 1).count() <= join.broadcast_ids
    near = F.broadcast if few else (lambda df: df)
    ids = nodes.join(near(wanted), "node", "left_semi").where(F.col("id").isNotNull()).select(F.col("id").alias(id_column)).distinct()
    texts = docs.select(id_column, text_column)
    picked = texts.join(near(ids), id_column, "left_semi")
    picked = picked.unionByName(texts.where(F.col(id_column).isNull()))
    made = scratch.write(picked.mapInArrow(run, "node long, shingles array<long>").join(near(wanted), "node", "left_semi"))
    if made.count() == made.select("node").distinct().count():
        return made
    # Rows without an id, or with the same one, may give a set more than once.
    once = scratch.write(made.dropDuplicates(["node"]))
    scratch.drop(made)
    return once


def link_sets(docs: DataFrame, join: JaccardJoin = JaccardJoin(), id_column: str = "doc_id", text_column: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(id, n_shingles, component_id) for every row; component_id is the smallest id reachable by links."""
    scratch = scratch or Scratch(docs.sparkSession, "jaccard")
    rows = scratch.write(_rows(docs, join, id_column, text_column))
    # Copies become one row before anything is joined by node.
    one = rows.where("node is not null").groupBy("node").agg(F.min(id_column).alias("id"), F.max("n_shingles").alias("n"), F.max("sketch").alias("sketch"))
    nodes = scratch.write(one)
    roots = _components(docs, nodes, join, scratch, id_column, text_column)
    least = nodes.select("node", F.col("id").alias("component_id"))
    if roots is not None:
        roots = roots.select("node", "root")
        named = nodes.select("node", "id").join(roots, "node").groupBy("root").agg(F.min("id").alias("linked_id"))
        linked = roots.join(named, "root").select("node", "linked_id")
        least = least.join(linked, "node", "left").select("node", F.coalesce("linked_id", "component_id").alias("component_id"))
    found = rows.select(id_column, "n_shingles", "node").join(least, "node", "left")
    out = scratch.write(found.select(id_column, "n_shingles", F.coalesce("component_id", id_column).alias("component_id")))
    scratch.keep_only(out)
    return out


def _components(docs, nodes, join: JaccardJoin, scratch: Scratch, id_column: str, text_column: str) -> DataFrame | None:
    """(node, root) of all nodes with a link; None if there is no link."""
    about = nodes.select("node", "n", "sketch")
    signed, links, roots = _signatures_of(docs, join, text_column), None, None
    sets_of = lambda wanted: _sets_of(docs, nodes, wanted, join, scratch, id_column, text_column)

    def with_roots(members: DataFrame) -> DataFrame:
        if roots is None:
            return members.withColumn("root", F.col("node"))
        return members.join(roots.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))

    def resolve(groups: DataFrame) -> None:
        """Verify links in groups (group, node) until no passing pair of theirs can add any."""
        nonlocal links, roots
        groups = scratch.write(groups.join(about, "node").select("group", "node", "n", "sketch"))
        tested = None
        for most in (1, 16, 8 * join.crowd):
            pairs = _pairs_of(with_roots(groups), join, most)
            pairs = scratch.write(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
            if pairs.isEmpty():
                continue
            verify(pairs)
            # Of a pair that failed the nodes may still be linked by others; only where they are not, links may be missing.
            apart = scratch.write_rows(_apart_pairs(pairs, with_roots), pairs.count())
            if tested is None and apart.isEmpty():
                break
            # Only groups that hold such a pair may have links not found yet.
            if tested is None:
                touched = groups.join(apart.select(F.col("a").alias("node"), "b"), "node").select("group", F.col("b").alias("node"))
                touched = touched.join(groups.select("group", "node"), ["group", "node"]).select("group").distinct()
                whole, groups = groups, scratch.write(groups.join(touched, "group", "left_semi"))
                scratch.drop(whole)
            tested = pairs if tested is None else tested.union(pairs)
        scratch.drop(groups)

    def verify(pairs: DataFrame) -> None:
        """Add the links among the pairs: first one pair for each node, then those whose nodes are not linked by then."""
        nonlocal links, roots
        size = pairs.count()
        first = scratch.write_rows(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), size)
        for part in (first, None):
            if part is None:
                part = scratch.write_rows(_apart_pairs(pairs.join(first, ["a", "b"], "left_anti"), with_roots), size)
                if part.isEmpty():
                    break
            sets = sets_of(part.select(F.col("a").alias("node")).union(part.select(F.col("b").alias("node"))).distinct())
            found = scratch.write(_verified(part, sets, join))
            scratch.drop(sets)
            if not found.isEmpty():
                links = found if links is None else links.union(found)
                before, roots = roots, connected_components(links, scratch)
                if before is not None:
                    scratch.drop(before)

    for level in range(join.levels + 1):
        all_groups = scratch.write(_groups_of(signed, join))
        crowded = all_groups.where("crowded").select("group", "node")
        calm = all_groups.where("not crowded").select("group", "node")
        none = crowded.isEmpty()
        if not none:
            size = crowded.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
            blocks = crowded.join(size, "group").withColumn("blocks", F.ceil(F.col("size") / (join.crowd // 2)))
            blocks = scratch.write(blocks.withColumn("block", F.pmod(F.xxhash64("node", "group"), F.col("blocks"))))
            calm = calm.union(blocks.select(F.xxhash64("group", "block").alias("group"), "node"))
        resolve(calm)
        if none:
            break
        mixed = with_roots(blocks).groupBy("group").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("group")
        blocks = scratch.write(blocks.join(mixed, "group", "left_semi"))
        if blocks.isEmpty():
            break
        if level == join.levels:
            other = blocks.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
            met = F.xxhash64("group", F.least("block", "other"), F.greatest("block", "other"))
            resolve(other.select(met.alias("group"), "node"))
        else:
            crowd = blocks.select("group", "node")
            signed = _signed_again(sets_of(crowd.select("node").distinct()), crowd, level, join)
    return roots


def _apart_pairs(pairs: DataFrame, with_roots) -> DataFrame:
    """The pairs (a, b) whose nodes are not in one component."""
    left = with_roots(pairs.withColumnRenamed("a", "node")).select(F.col("node").alias("a"), "b", F.col("root").alias("root_a"))
    both = with_roots(left.withColumnRenamed("b", "node")).select("a", F.col("node").alias("b"), "root_a", "root")
    return both.where("root_a <> root").select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, join: JaccardJoin) -> DataFrame:
    """The pairs whose sets reach the threshold, counted exactly."""
    # Few nodes are the first of their pairs; only their sets are sent where their pairs are.
    left = sets.join(pairs.select(F.col("a").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("a"), F.col("shingles").alias("xs"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("ys"))
    sized = pairs.join(right, "b").join(left, "a")
    sized = sized.select("a", "b", F.size("xs").alias("n"), F.size("ys").alias("m"), F.size(F.array_intersect("xs", "ys")).alias("both"))
    return sized.where(F.lit(100) * F.col("both") >= F.lit(join.percent) * (F.col("n") + F.col("m") - F.col("both"))).select("a", "b")


def keep_one_of_each(docs: DataFrame, join: JaccardJoin = JaccardJoin(words=5, percent=80), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each component stays: the one whose id names it.

    Rows that repeat an id count as one document, of which one row stays; rows
    without an id cannot be told apart and all stay.
    """
    scratch = Scratch(docs.sparkSession, "kept")
    found = link_sets(docs, join, id_column, text_column, scratch).where(F.col(id_column).isNotNull())
    repeated = found.groupBy(id_column).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(id_column)
    # An id met twice with different texts leaves only if both of its texts have another representative.
    named = found.where(F.col("component_id") == F.col(id_column)).select(id_column)
    gone = found.where(F.col("component_id") != F.col(id_column)).select(id_column).distinct()
    gone = scratch.write(gone.join(named, id_column, "left_anti"))
    repeated = scratch.write(repeated.join(gone, id_column, "left_anti"))
    scratch.keep_only(gone, repeated)
    once = without(docs, gone, id_column, join.broadcast_ids)
    if repeated.isEmpty():
        return once
    small = repeated.limit(join.broadcast_ids + 1).count() <= join.broadcast_ids
    twice = docs.join(F.broadcast(repeated) if small else repeated, id_column, "left_semi").select(docs.columns).dropDuplicates([id_column])
    return without(once, repeated, id_column, join.broadcast_ids).unionByName(twice)


def without(docs: DataFrame, gone: DataFrame, id_column: str, broadcast_ids: int) -> DataFrame:
    """The rows whose id is not in ``gone``; ids go to all executors only if few enough."""
    small = gone.limit(broadcast_ids + 1).count() <= broadcast_ids
    return docs.join(F.broadcast(gone) if small else gone, id_column, "left_anti").select(docs.columns)
