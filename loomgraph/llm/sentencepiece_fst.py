"""SentencePiece encoding and decoding by weighted finite-state transduction.

A model file is compiled into machines (`Machine`): the normaliser, which
rewrites spaces and adds the dummy prefix; the pieces, a trie that puts a piece
out where it ends and returns to its start; and byte fallback, an arc for each
character that no piece spells. An input is composed with the normaliser, what
comes out with the pieces and the fallback, which gives a lattice of places in
the text, and its tropical-semiring shortest path is the encoding.

For a unigram model an arc weighs minus its piece's score. For a BPE model the
state also tells the last piece, and an arc from piece a to piece b weighs 0 if
the merges keep the boundary in "ab", else infinity: one path of finite weight
is left, which is what the merges produce. Boundaries are decided by merging
the two pieces' characters, best score and leftmost first, and remembered. In a
run of space marks, whose pieces share one score, a boundary depends on where
the run begins, which no such state tells: those stretches are merged by a heap.

The lattice falls apart where no piece can cross: before a space mark that
follows something else, and at characters that only stand alone. Each such
stretch is composed once per worker and its ids are kept for the next time;
the memory is emptied when it is full.

Defined results: a null text is empty and has no ids; control pieces are never
matched in text; a text that holds the space mark itself decodes to a space;
bytes that are not UTF-8 decode to U+FFFD; normalisers with a character map
are refused; an empty table gives no rows; repeated rows get equal results;
very long texts, runs of a million spaces among them, take time in proportion
(a run of n marks n log n); of paths of equal weight the one that is found first,
with the longer last piece, is taken; columns to keep may have any names.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.common import chunks, lean, text_bytes

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Stretches, and pairs of pieces, that a worker remembers.
MEMORY = 1_200_000


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of one protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = raw[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while i < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, raw[i : i + n]
            i += n
        elif kind == 5:
            yield key >> 3, struct.unpack("<f", raw[i : i + 4])[0]
            i += 4
        elif kind == 1:
            yield key >> 3, struct.unpack("<d", raw[i : i + 8])[0]
            i += 8
        else:
            raise ValueError(f"wire type {kind}")


class Model:
    """What a model file says."""

    def __init__(self, raw: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.byte_fallback, self.unknown = UNIGRAM, False, 0
        self.dummy_prefix = self.squeeze = self.escape = True
        for field, value in _fields(raw):
            if field == 1:
                p = dict(_fields(value))
                self.pieces.append((p.get(1, b"").decode(), p.get(2, 0.0), p.get(3, NORMAL)))
            elif field == 2:
                for f, v in _fields(value):
                    if f == 3:
                        self.kind = v
                    elif f == 35:
                        self.byte_fallback = bool(v)
                    elif f == 40:
                        self.unknown = v
                    elif f == 24 and v:
                        raise ValueError("white space as a suffix is not supported")
            elif field == 3:
                for f, v in _fields(value):
                    if f == 2 and v:
                        raise ValueError("normalisers with a character map are not supported")
                    elif f == 3:
                        self.dummy_prefix = bool(v)
                    elif f == 4:
                        self.squeeze = bool(v)
                    elif f == 5:
                        self.escape = bool(v)


class Machine:
    """A transducer over characters: `arcs[state][character]` is the next state and what is put out on the way.

    By `other[state]` any other character leads to a next state and is copied behind what is put out.
    `ends[state]` is what a state puts out at the end of the input, or None where the input must not end.
    """

    def __init__(self):
        self.arcs: list[dict[str, tuple[int, str]]] = []
        self.other: dict[int, tuple[int, str]] = {}
        self.ends: list[str | int | None] = []

    def state(self, end=None) -> int:
        self.arcs.append({})
        self.ends.append(end)
        return len(self.arcs) - 1

    def compose(self, text: str) -> str:
        """The one output of composing text with a machine of one arc a state and character."""
        state, out = 0, []
        for c in text:
            if (arc := self.arcs[state].get(c)) is not None:
                state, put = arc
                out.append(put)
            else:
                state, put = self.other[state]
                out += (put, c)
        return "".join(out) + (self.ends[state] or "")


def normaliser(model: Model) -> Machine:
    """Spaces become marks; if the model squeezes, leading and trailing ones go and runs are one."""
    m, mark = Machine(), MARK if model.escape else " "
    if not model.squeeze:
        only = m.state("")
        m.arcs[only][" "] = only, mark
        m.other[only] = only, ""
        return m
    begin, word, gap = m.state(""), m.state(""), m.state("")
    for state, to in ((begin, begin), (word, gap), (gap, gap)):
        m.arcs[state][" "] = to, ""
    m.other |= {begin: (word, ""), word: (word, ""), gap: (word, mark)}
    return m


class Transducer:
    """The compiled machines: encode() and decode()."""

    def __init__(self, model: Model):
        if model.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.model = model
        self.ids = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER)}
        self.score = [s for _, s, _ in model.pieces]
        self.spaces = normaliser(model)
        self.trie = Machine()
        self.trie.state()
        for piece, i in self.ids.items():
            at = 0
            for c in piece:
                if c not in self.trie.arcs[at]:
                    self.trie.arcs[at][c] = self.trie.state(), ""
                at = self.trie.arcs[at][c][0]
            self.trie.ends[at] = i
        self.next = [{c: to for c, (to, _) in arcs.items()} for arcs in self.trie.arcs]
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(model.pieces) if kind == BYTE}
        self.spell = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else p.replace(MARK, " ").encode() if model.escape else p.encode() for p, _, kind in model.pieces]
        self.worst = min((s for (_, s, kind) in model.pieces if kind == NORMAL), default=0.0) - 10
        # where no piece can cross
        inner = {c for p in self.ids if len(p) > 1 for c in p}
        crosses = any(MARK in p.lstrip(MARK) for p in self.ids)
        alone = "".join(c for c in "\n\t\r" if c not in inner)
        stop = re.escape(alone)
        self.stretch = None if crosses or not model.escape else re.compile(f"{MARK}*[^{MARK}{stop}]+|{MARK}+" + (f"|[{stop}]" if alone else ""))
        self.known: dict[str, bytes] = {}
        self.keeps: dict[int, bool] = {}  # by (a + 1) << 32 | b

    def normalise(self, text: str) -> str:
        """text composed with the normaliser; the dummy prefix is an arc before its start."""
        m = self.model
        if len(self.spaces.arcs) == 1:  # of a machine of one state composing is a replacement of characters
            out = text.replace(" ", self.spaces.arcs[0][" "][1])
        else:
            out = self.spaces.compose(text)
        return (MARK if m.escape else " ") + out if m.dummy_prefix and out else out

    def merged(self, text: str) -> list[str]:
        """BPE by its definition: join the best-scored neighbours, leftmost first, from a heap of what can be joined."""
        parts: list[str] = list(text)
        n = len(parts)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting: list[tuple[float, int, int, int]] = []

        def offer(i: int) -> None:
            j = right[i]
            if i >= 0 and j < n and (piece := self.ids.get(parts[i] + parts[j])) is not None:
                waiting.append((-self.score[piece], i, j, len(parts[i]) + len(parts[j])))

        for i in range(n - 1):
            offer(i)
        heapq.heapify(waiting)
        grown, waiting = waiting, []
        while grown:
            _, i, j, size = heapq.heappop(grown)
            if not parts[i] or right[i] != j or j >= n or len(parts[i]) + len(parts[j]) != size:
                continue  # one of the two has changed since
            parts[i], parts[j] = parts[i] + parts[j], ""
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            if left[i] >= 0:
                offer(left[i])
            offer(i)
            while waiting:
                heapq.heappush(grown, waiting.pop())
        return [p for p in parts if p]

    def boundary(self, a: int, b: int) -> bool:
        """Whether an arc from piece a to piece b has a finite weight; a = -1: the start."""
        if len(self.keeps) > MEMORY:
            self.keeps.clear()
        q = self.model.pieces[b][0]
        p = self.model.pieces[a][0] if a >= 0 else ""
        got = self.keeps[(a + 1) << 32 | b] = self.merged(p + q) == ([p, q] if p else [q])
        return got

    def fallback(self, c: str) -> list[int]:
        """What the fallback machine puts out for a character that no piece spells."""
        if self.model.byte_fallback and self.bytes:
            return [self.bytes[x] for x in c.encode()]
        return [self.model.unknown]

    def compose(self, text: str, i: int) -> list[tuple[int, int]]:
        """The lattice's arcs from place i, made when a path comes there: (place they lead to, piece; -1: the fallback)."""
        steps, ends, arcs, state, spelled = self.next, self.trie.ends, [], 0, False
        for j in range(i, len(text)):
            state = steps[state].get(text[j])
            if state is None:
                break
            piece = ends[state]
            if piece is not None:
                arcs.append((j + 1, piece))
                spelled = spelled or j == i
        if not spelled:
            arcs.append((i + 1, -1))
        return arcs

    def shortest(self, text: str) -> list[int]:
        """Tropical shortest path: of sums of weights the least."""
        n, bpe, keeps = len(text), self.model.kind == BPE, self.keeps
        # by place: the least cost, the piece that ends there and the place before it; for BPE that piece is
        # part of the state, but only one state of a place can be reached, always at cost 0
        cost: list[float | None] = [None] * (n + 1)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        cost[0] = 0.0
        for i in range(n):
            here = cost[i]
            if here is None:
                continue
            before = (last[i] + 1) << 32
            for j, piece in self.compose(text, i):
                if bpe:
                    if cost[j] is not None:
                        continue
                    if piece >= 0:
                        keep = keeps.get(before | piece)
                        if not (self.boundary(last[i], piece) if keep is None else keep):
                            continue
                    total = 0.0
                else:
                    total = here - (self.score[piece] if piece >= 0 else self.worst)
                    if cost[j] is not None and cost[j] <= total:
                        continue
                cost[j], last[j], back[j] = total, piece, i
        out: list[int] = []
        while n:
            i = back[n]
            out += [last[n]] if last[n] >= 0 else self.fallback(text[i:n])[::-1]
            n = i
        return out[::-1]

    def path(self, text: str) -> list[int]:
        """The ids of one stretch."""
        if self.model.kind == BPE and MARK * 2 in text:
            return [i for p in self.merged(text) for i in ([self.ids[p]] if p in self.ids else self.fallback(p))]
        return self.shortest(text)

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        text = self.normalise(text)
        known, out = self.known, []
        for part in self.stretch.findall(text) if self.stretch else [text] if text else []:
            ids = known.get(part)
            if ids is None:
                if len(known) > MEMORY:
                    known.clear()
                ids = np.array(self.path(part), dtype="<u4").tobytes()
                if len(part) < 64:
                    known[part] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype="<u4").tolist()

    def decode(self, ids) -> str:
        spell = self.spell
        raw = b"".join([spell[i] for i in ids])
        if self.model.dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


_MACHINES: dict[bytes, Transducer] = {}


def machine(raw: bytes) -> Transducer:
    key = raw[:64] + zlib.crc32(raw).to_bytes(4, "little")
    if key not in _MACHINES:
        _MACHINES[key] = Transducer(Model(raw))
    return _MACHINES[key]


def _model_bytes(path: str | None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, *keep: str, model: str | None = None) -> DataFrame:
    """The columns of keep and the ids (array<int>) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(_model_bytes(model))
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "ids array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(shared.value)
        for b in batches:
            ids = [np.frombuffer(m.encode_bytes(t or ""), dtype="<u4").astype(np.int32) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(ids, pa.list_(pa.int32()))], names=[*keep, "ids"])

    return docs.select(*keep, "text").mapInArrow(run, schema)


def decode(coded: DataFrame, *keep: str, model: str | None = None) -> DataFrame:
    """The columns of keep and the text of every row's ids."""
    shared = coded.sparkSession.sparkContext.broadcast(_model_bytes(model))
    schema = ", ".join([*(f"`{c}` {coded.schema[c].dataType.simpleString()}" for c in keep), "text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(shared.value)
        for b in batches:
            text = [m.decode(i or ()) for i in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(text, pa.string())], names=[*keep, "text"])

    return coded.select(*keep, "ids").mapInArrow(run, schema)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian unsigned 32-bit ids) and whether decoding gives the text back."""
    lean(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shared = spark.sparkContext.broadcast(_model_bytes(None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(shared.value)
        for b in batches:
            _, offsets = text_bytes(b.column(1))
            for i, j in chunks(offsets):
                rows = []
                for t in b.column(1).slice(i, j - i).to_pylist():
                    raw = m.encode_bytes(t or "")
                    rows.append((len(raw) // 4, zlib.crc32(raw), m.decode(np.frombuffer(raw, dtype="<u4").tolist()) == (t or "")))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(list(cols[0]), pa.int64()), pa.array(list(cols[1]), pa.int64()), pa.array(list(cols[2]), pa.bool_())], names=["doc_id", "n_ids", "ids_crc32", "round_trip"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_ids long, ids_crc32 long, round_trip boolean")
