"""Byte-level BPE encoding and decoding with a pair occurrence index.

A chunk's texts are cut, on bytes, into pieces that the pre-tokenizer treats
independently (a run of white space and what follows it).  Equal pieces are
encoded once.  The pre-tokens of all distinct pieces form one partition of
symbols with links to both neighbours; an index maps each mergeable pair, by
its rank, to all its positions.  Active ranks are applied in ascending order,
each to all its positions at once, and the lists of the pairs this makes are
updated.  A merge can only make pairs of higher ranks, which is checked when
the tokenizer is read.

Defined results: a null or empty text has no tokens; special tokens inside a
text become their own ids, as the tokenizer file says; repeated rows are encoded
each; a text of any length is encoded whole, as a chunk of its own; an empty
table gives no rows; null ids decode to a null text.  The digests read id and
text only, so other columns cannot clash; ``encode`` and ``decode`` replace
columns that have the names of their own.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import batches as B

#: Text handled at once; more than elsewhere, as more equal pieces meet.
CHUNK_BYTES = 2 << 20

# Fixed values of the byte-level format: white space as the tokenizer's regex
# engine has it, and the pattern of pre-tokens.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


@dataclass
class ByteBpe:
    """A byte-level BPE tokenizer as arrays; pickles small."""

    byte_ids: np.ndarray
    keys: np.ndarray  # sorted pairs, left << 20 | right
    ranks: np.ndarray  # their ranks
    left: np.ndarray  # by rank
    right: np.ndarray
    made: np.ndarray
    token_bytes: list[bytes]
    specials: dict[bytes, int]
    _regex: object = field(default=None, repr=False)

    @classmethod
    def read(cls, path: str) -> ByteBpe:
        """Read a tokenizer file (JSON) of the byte-level kind."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        if model["type"] != "BPE" or not plain or spec["normalizer"] or model.get("unk_token") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("not a plain byte-level BPE tokenizer")
        vocab = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        born = np.full(max(vocab.values()) + 1, -1)
        for rank in range(len(made) - 1, -1, -1):
            born[made[rank]] = rank
        if len(set(made.tolist())) < len(made) or (np.maximum(born[left], born[right]) >= np.arange(len(made))).any():
            raise ValueError("ranks do not ascend with the merges that need them")
        letters = _byte_letters()
        value = {c: b for b, c in enumerate(letters)}
        specials = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        token_bytes = [b""] * (max([*vocab.values(), *specials.values()]) + 1)
        for token, i in vocab.items():
            token_bytes[i] = bytes(value[c] for c in token)
        for token, i in specials.items():
            token_bytes[i] = token
        keys = left << 20 | right
        order = np.argsort(keys)
        return cls(np.array([vocab[c] for c in letters], np.int64), keys[order], order, left, right, made, token_bytes, specials)

    def pre_tokens(self, piece: str) -> list[str]:
        if self._regex is None:
            self._regex = regex.compile(_PATTERN)
        return self._regex.findall(piece)

    def __getstate__(self):
        return self.__dict__ | {"_regex": None}

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs, -1 where there is no merge."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in a row, and the number of tokens of each word."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words))
        n = len(raw)
        sym = self.byte_ids[raw]
        prev, nxt = np.arange(-1, n - 1), np.arange(1, n + 1)
        ends = np.cumsum(size)
        prev[(ends - size)[size > 0]] = -1
        nxt[(ends - 1)[size > 0]] = -1
        at = np.flatnonzero(nxt >= 0)
        rank = self.rank_of(sym[at], sym[at + 1])
        lists: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []
        self._add(lists, heap, rank, at)
        while heap:
            r = heapq.heappop(heap)
            at = lists.pop(r)
            at = at[0] if len(at) == 1 else np.concatenate(at)
            a, b = self.left[r], self.right[r]
            to = nxt[at]
            ok = (sym[at] == a) & (to >= 0) & (sym[to] == b)
            at = np.sort(at[ok])
            if len(at) > 1:
                at = at[np.append(True, at[1:] != at[:-1])]
            if a == b and len(at) > 1:
                at = _apart(at, nxt)
            if not len(at):
                continue
            gone = nxt[at]
            after = nxt[gone]
            sym[at], sym[gone] = self.made[r], -1
            nxt[at] = after
            prev[after[after >= 0]] = at[after >= 0]
            before = prev[at]
            lo, hi = before[before >= 0], at[after >= 0]
            first = np.concatenate([lo, hi])
            if len(first):
                self._add(lists, heap, self.rank_of(sym[first], sym[nxt[first]]), first)
        alive = sym >= 0
        count = B.running(alive)
        return sym[alive], count[ends] - count[ends - size]

    @staticmethod
    def _add(lists: dict[int, list[np.ndarray]], heap: list[int], rank: np.ndarray, at: np.ndarray) -> None:
        """Enter positions under their pairs' ranks."""
        found = rank >= 0
        if not found.all():
            rank, at = rank[found], at[found]
        if not len(rank):
            return
        order = np.argsort(rank, kind="stable")
        rank, at = rank[order], at[order]
        cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        heads = rank[np.concatenate([[0], cut])].tolist()
        edges = [0, *cut.tolist(), len(at)]
        for i, r in enumerate(heads):
            if r in lists:
                lists[r].append(at[edges[i] : edges[i + 1]])
            else:
                lists[r] = [at[edges[i] : edges[i + 1]]]
                heapq.heappush(heap, r)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pieces in a row and the number of tokens of each."""
        index: dict[str, int] = {}
        flat: list[int] = []
        count = np.zeros(len(pieces), np.int64)
        special = np.zeros(len(pieces), bool)
        for i, piece in enumerate(pieces):
            if piece in self.specials:
                special[i] = True
                continue
            text = piece.decode()
            if text.isalpha() or text[:1] == " " and text[1:].isalpha():  # letters after at most a space: one pre-token
                count[i] = 1
                flat.append(index.setdefault(text, len(index)))
                continue
            words = self.pre_tokens(text)
            count[i] = len(words)
            for w in words:
                flat.append(index.setdefault(w, len(index)))
        ids, size = self.merge_all([w.encode() for w in index])
        start = np.cumsum(size) - size
        use = np.array(flat, np.int64)
        per_word = size[use] if len(use) else np.zeros(0, np.int64)
        total = B.running(per_word)
        edge = B.running(count)
        n_ids = total[edge[1:]] - total[edge[:-1]]
        out = ids[np.repeat(start[use], per_word) + np.arange(int(total[-1])) - np.repeat(total[:-1], per_word)] if len(use) else np.zeros(0, np.int64)
        if special.any():
            at = total[edge[:-1]][special]
            out = np.insert(out, at, [self.specials[pieces[i]] for i in np.flatnonzero(special)])
            n_ids[special] = 1
        return out, n_ids

    def cut(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Piece offsets: pieces are encoded independently of each other."""
        n = len(data)
        space = (data == 0x20) | (data == 0x0A)
        # The byte before must be known not to be white space.
        solid = (data > 0x20) & (data < 0x7F)
        if (data >= 0x80).any():
            lead = np.zeros(n, bool)
            lead[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80)
            solid |= lead
        begin = np.zeros(n + 1, bool)
        begin[1:n] = space[1:] & solid[:-1]
        begin[off] = True
        text = data.tobytes()
        for mark in self.specials:
            at = text.find(mark)
            while at >= 0:
                doc = np.searchsorted(off, at, "right")
                if at + len(mark) <= off[doc]:
                    begin[at + 1 : at + len(mark)] = False
                    begin[[at, at + len(mark)]] = True
                    at = text.find(mark, at + len(mark))
                else:
                    at = text.find(mark, at + 1)
        begin[n] = True
        return np.flatnonzero(begin)

    def encode(self, data: np.ndarray, off: np.ndarray) -> Encoded:
        """Encode all texts of a chunk."""
        edge = self.cut(data, off)
        n = len(edge) - 1
        pieces = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        ids, size = self.encode_pieces(coded.dictionary.to_pylist())
        return Encoded(self, ids, B.running(size), np.asarray(coded.indices), np.searchsorted(edge, off))


@dataclass
class Encoded:
    """Texts as pieces: the ids of each distinct piece, and each text's pieces."""

    bpe: ByteBpe
    ids: np.ndarray
    edge: np.ndarray  # of distinct pieces in ids
    pieces: np.ndarray  # of all texts in a row
    texts: np.ndarray  # n+1 offsets into pieces

    def counts(self) -> np.ndarray:
        total = B.running(np.diff(self.edge)[self.pieces])
        return total[self.texts[1:]] - total[self.texts[:-1]]

    def _spread(self, values: pa.Array) -> tuple[memoryview, np.ndarray]:
        """The texts' values in a row, and the byte offsets of the texts."""
        taken = values.cast(pa.large_binary()).take(pa.array(self.pieces))
        _, offsets, data = taken.buffers()
        off = np.frombuffer(offsets, np.int64, len(taken) + 1)
        return memoryview(data) if data is not None else memoryview(b""), off[self.texts]

    def id_texts(self) -> tuple[memoryview, np.ndarray]:
        """Decimal ids, each followed by a comma."""
        words = pc.binary_join_element_wise(pa.array(self.ids).cast(pa.string()), "", ",")
        _, offsets, data = words.buffers()
        off = np.frombuffer(offsets, np.int32, len(words) + 1) if len(words) else np.zeros(1, np.int32)
        joined = pa.Array.from_buffers(pa.binary(), len(self.edge) - 1, [None, pa.py_buffer(off[self.edge].astype(np.int32)), data or pa.py_buffer(b"")])
        return self._spread(joined)

    def decoded(self) -> tuple[memoryview, np.ndarray]:
        """The bytes that the ids stand for."""
        names = pa.array(self.bpe.token_bytes, pa.binary()).take(pa.array(self.ids))
        _, offsets, data = names.buffers()
        off = np.frombuffer(offsets, np.int32, len(names) + 1) if len(names) else np.zeros(1, np.int32)
        joined = pa.Array.from_buffers(pa.binary(), len(self.edge) - 1, [None, pa.py_buffer(off[self.edge].astype(np.int32)), data or pa.py_buffer(b"")])
        return self._spread(joined)

    def id_lists(self) -> pa.ListArray:
        size = np.diff(self.edge)[self.pieces]
        total = B.running(size)
        flat = self.ids[np.repeat(self.edge[:-1][self.pieces], size) + np.arange(int(total[-1])) - np.repeat(total[:-1], size)]
        return pa.ListArray.from_arrays(pa.array(total[self.texts].astype(np.int32)), pa.array(flat.astype(np.int32)))


def _apart(at: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Of ascending positions of a pair of equal symbols, those taken from the left without overlap."""
    follows = np.zeros(len(at), bool)
    follows[1:] = nxt[at[:-1]] == at[1:]
    head = np.flatnonzero(~follows)
    run = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))
    return at[run % 2 == 0]


def encode_and_check(docs: DataFrame, bpe: ByteBpe, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, n_tokens, and SHA-256 of its ids (decimals joined by commas) and of the text decoded from them."""
    shared = docs.sparkSession.sparkContext.broadcast(bpe)

    def run(it):
        model = shared.value
        for rows, data, off in B.chunks(it, text_column, CHUNK_BYTES):
            e = model.encode(data, off)
            ids, at = e.id_texts()
            ids_sha = [hashlib.sha256(ids[a : max(a, b - 1)]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            out, at = e.decoded()
            text_sha = [hashlib.sha256(str(out[a:b], "utf-8", "replace").encode()).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [B.column_of(rows, id_column), pa.array(e.counts()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=[id_column, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    fields = T._parse_datatype_string("n_tokens long, ids_sha256 string, decoded_sha256 string").fields
    return B.map_batches(docs.select(id_column, text_column), run, T.StructType([docs.schema[id_column], *fields]))


def encode(docs: DataFrame, bpe: ByteBpe, text_column: str = "text", ids_column: str = "token_ids", check_column: str = "decodes") -> DataFrame:
    """The rows with their token ids in ``ids_column``, and in ``check_column`` whether the ids decode to the text.

    Columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bpe)
    kept = [c for c in docs.columns if c not in (ids_column, check_column)]

    def run(it):
        model = shared.value
        for rows, data, off in B.chunks(it, text_column, CHUNK_BYTES):
            e = model.encode(data, off)
            out, at = e.decoded()
            same = [bytes(out[a:b]) == data[c:d].tobytes() for a, b, c, d in zip(at[:-1].tolist(), at[1:].tolist(), off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*(B.column_of(rows, c) for c in kept), e.id_lists(), pa.array(same, pa.bool_())], names=[*kept, ids_column, check_column])

    out = T.StructType([*(docs.schema[c] for c in kept), T.StructField(ids_column, T.ArrayType(T.IntegerType())), T.StructField(check_column, T.BooleanType())])
    return B.map_batches(docs.select(kept), run, out)


def decode(docs: DataFrame, bpe: ByteBpe, ids_column: str = "token_ids", text_column: str = "text") -> DataFrame:
    """The rows with the text of their ids in ``text_column``; null ids give a null text."""
    shared = docs.sparkSession.sparkContext.broadcast(bpe)
    kept = [c for c in docs.columns if c != text_column]

    def run(it):
        names = shared.value.token_bytes
        for rows in it:
            lists = B.column_of(rows, ids_column).to_pylist()
            texts = [None if x is None else b"".join([names[i] for i in x]).decode("utf-8", "replace") for x in lists]
            yield pa.RecordBatch.from_arrays([*(B.column_of(rows, c) for c in kept), pa.array(texts, pa.string())], names=[*kept, text_column])

    out = T.StructType([*(docs.schema[c] for c in kept), T.StructField(text_column, T.StringType())])
    return B.map_batches(docs.select(kept), run, out)
