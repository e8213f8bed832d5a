"""Best-fit packing by the linear grouping scheme.

Documents become token ids and one end id; longer ones are cut into pieces of
the capacity, of which the first may be shorter. Packing needs only how many
pieces have each length: at most `capacity` counts, whatever the corpus size.
On those counts the driver

1. splits the large lengths into groups of equal cardinality and rounds each
   length up to the largest of its group;
2. solves the configuration program for the few sizes by column generation
   and rounds it down to whole sequences;
3. puts the actual lengths of each group into its slots;
4. adds what is left, small lengths included, by best fit, longest first.

Several group counts and limits of "small" are tried; the fewest sequences
win. The plan is a list of sequence classes with multiplicities. Each piece
gets its rank among the pieces of its length from salted counts, and its rank
names its slot. No piece's ids leave the task that made them.

Defined results: a null text is an empty one and gives one piece of one end
id; a very long text is encoded whole and gives as many pieces as it fills;
repeated rows and null doc_ids are packed like any other rows; pieces of equal
length take their slots in any order; an empty table gives no rows; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import chunks, lean, materialize, text_bytes, trimming

CAPACITY = 2048
END_ID = 0
#: Bytes of text that are encoded at once.
ENCODE_BYTES = 1 << 20


# ---------------------------------------------------------------- token ids


class Encoder:
    """Ids of a byte-level BPE file, texts by texts.

    The same vocabulary as a rank file (same name, .tiktoken) gives the same
    ids several times faster; texts that hold a special token's string go to
    the tokenizers library itself.
    """

    def __init__(self, vocabulary: bytes, ranks: bytes | None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_str(vocabulary.decode())
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks is not None:
            import base64

            import public_tokenizers
            import tiktoken

            by_token = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=by_token, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


_ENCODERS: dict[int, Encoder] = {}


def encoder_files(path: str) -> tuple[bytes, bytes | None]:
    """The vocabulary file and, where there is one, the rank file beside it: read by the driver, whose folders executors don't see."""
    with open(path, "rb") as f:
        vocabulary = f.read()
    beside = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(beside):
        return vocabulary, None
    with open(beside, "rb") as f:
        return vocabulary, f.read()


def encoder(files: tuple[bytes, bytes | None]) -> Encoder:
    """One for each worker and vocabulary."""
    key = zlib.crc32(files[0])
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*files)
    return _ENCODERS[key]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, but the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32 (and ids)."""
    lean(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    files = docs.sparkSession.sparkContext.broadcast(encoder_files(tokenizer))  # of the vocabulary's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(files.value)
        for batch in batches:
            doc_ids = batch.column(0)
            _, offsets = text_bytes(batch.column(1))
            for i, j in chunks(offsets, ENCODE_BYTES):
                at, piece, start, length, crc, ids = [], [], [], [], [], []
                for k, text in enumerate(batch.column(1).slice(i, j - i).to_pylist(), i):
                    tokens = np.array([*encode(text or ""), END_ID], dtype="<u4")
                    for p, (s, n) in enumerate(cuts(len(tokens), capacity)):
                        at.append(k)
                        piece.append(p)
                        start.append(s)
                        length.append(n)
                        crc.append(zlib.crc32(tokens[s : s + n].tobytes()))
                        if with_ids:
                            ids.append(tokens[s : s + n].astype(np.int32))
                cols = [doc_ids.take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select("doc_id", "text").mapInArrow(trimming(run), schema)


# ------------------------------------------------------------ the packing plan


class Bins:
    """Classes of equally filled sequences: (items, multiplicity) by free space."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.free: dict[int, list[tuple[tuple, int]]] = defaultdict(list)
        self.mask = 0

    def add(self, items: tuple, times: int, room: int) -> None:
        if times:
            self.free[room].append((items, times))
            self.mask |= 1 << room

    def best_fit(self, size: int, n: int) -> None:
        """Put n pieces of one size, each where the least space is left, in bulk."""
        while n:
            above = self.mask >> size
            if not above:
                q = self.capacity // size
                full, rest = divmod(n, q)
                self.add(((size, q),), full, self.capacity - q * size)
                if rest:
                    self.add(((size, rest),), 1, self.capacity - rest * size)
                return
            room = size + (above & -above).bit_length() - 1
            items, times = self.free[room].pop()
            if not self.free[room]:
                self.mask &= ~(1 << room)
            q = room // size
            full, rest = min(times, n // q), 0
            if full < times:
                rest = n - full * q
                self.add(items, times - full - (rest > 0), room)
            self.add((*items, (size, q)), full, room - q * size)
            if rest:
                self.add((*items, (size, rest)), 1, room - rest * size)
                return
            n -= full * q
            if full < times:
                return

    def classes(self) -> list[tuple[tuple, int]]:
        return [c for room in sorted(self.free) for c in self.free[room]]

    def count(self) -> int:
        return sum(t for c in self.free.values() for _, t in c)


def linear_groups(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Runs (length, n), longest first, cut into groups of equal cardinality."""
    total = sum(counts.values())
    size = max(1, -(-total // groups))
    out, now, room = [], [], size
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            take = min(n, room)
            now.append((length, take))
            n -= take
            room -= take
            if not room:
                out.append(now)
                now, room = [], size
    return out + [now] * bool(now)


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 500) -> list[tuple[np.ndarray, float]]:
    """Fractional optimum of the configuration program, by column generation."""
    m = len(sizes)
    cols = np.diag([capacity // s for s in sizes]).astype(float)
    inverse = np.diag(1.0 / np.diag(cols))
    d = np.array(demand, dtype=float)
    x = inverse @ d
    deep = capacity // min(sizes)
    for _ in range(rounds):
        dual = inverse.sum(axis=0)
        best = np.zeros(capacity + 1)
        choice = np.full((deep, capacity + 1), -1, dtype=np.int32)
        for k in range(deep):  # best value with at most k + 1 pieces
            new = best.copy()
            for g, s in enumerate(sizes):
                if dual[g] <= 1e-12:
                    continue
                cand = best[: capacity + 1 - s] + dual[g]
                better = cand > new[s:] + 1e-12
                new[s:][better] = cand[better]
                choice[k, s:][better] = g
            if np.array_equal(new, best):
                break
            best = new
        if best[capacity] <= 1 + 1e-9:
            break
        a, room = np.zeros(m), capacity
        for k in range(deep - 1, -1, -1):
            g = choice[k, room]
            if g >= 0:
                a[g] += 1
                room -= sizes[g]
        if dual @ a <= 1 + 1e-9:
            break
        u = inverse @ a
        ok = u > 1e-9
        if not ok.any():
            break
        ratio = np.where(ok, x / np.where(ok, u, 1), np.inf)
        r = int(ratio.argmin())
        inverse[r] /= u[r]
        for i in range(m):
            if i != r and u[i]:
                inverse[i] -= u[i] * inverse[r]
        cols[:, r] = a
        x = inverse @ d
    return [(cols[:, i].astype(int), max(0.0, x[i])) for i in range(m)]


def _plan_once(counts: dict[int, int], capacity: int, small: int, groups: int) -> Bins:
    bins = Bins(capacity)
    large = {s: n for s, n in counts.items() if small < s < capacity}
    left: dict[int, int] = defaultdict(int)
    for s, n in counts.items():
        if s == capacity:
            bins.add(((s, 1),), n, 0)
        elif s <= small:
            left[s] += n
    if large:
        grouped = linear_groups(large, groups)
        solved = configurations([g[0][0] for g in grouped], [sum(n for _, n in g) for g in grouped], capacity)
        stock = [list(g) for g in grouped]
        for a, x in sorted(solved, key=lambda c: tuple(c[0]), reverse=True):
            a, times = a.tolist(), int(x + 1e-9)
            slots = [g for g in range(len(a)) if a[g]]
            while times and slots:
                if any(sum(n for _, n in stock[g]) < a[g] for g in slots):
                    break
                bulk = min(times, *(stock[g][0][1] // a[g] for g in slots))
                if bulk:
                    items = tuple((stock[g][0][0], a[g]) for g in slots)
                    for g in slots:
                        _take(stock[g], bulk * a[g])
                else:  # a slot's group goes over from one length to the next
                    bulk = 1
                    items = tuple(i for g in slots for i in _take(stock[g], a[g]))
                bins.add(items, bulk, capacity - sum(s * n for s, n in items))
                times -= bulk
        for g in stock:
            for s, n in g:
                left[s] += n
    for s in sorted(left, reverse=True):
        bins.best_fit(s, left[s])
    return bins


def _take(runs: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    got, n = [], int(n)
    while n:
        s, m = runs[0]
        t = min(m, n)
        got.append((s, t))
        n -= t
        if t == m:
            runs.pop(0)
        else:
            runs[0] = (s, m - t)
    return got


def plan(counts: dict[int, int], capacity: int = CAPACITY, small_parts: tuple = (2, 3, 4, 6), groups: tuple = (24, 48)) -> list[tuple[tuple, int]]:
    """Sequence classes: ((length, pieces), ...) and how many sequences look so."""
    best, floor = None, -(-sum(s * n for s, n in counts.items()) // capacity)
    for part in small_parts:
        for g in groups:
            bins = _plan_once(counts, capacity, capacity // part, g)
            if best is None or bins.count() < best.count():
                best = bins
            if best.count() <= floor:
                return best.classes()
    return best.classes() if best else []


def slot_table(classes: list[tuple[tuple, int]]) -> dict[str, np.ndarray]:
    """Runs of slots by (length, rank): the n-th piece of a length goes to the n-th slot."""
    used: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for items, times in classes:
        at = 0
        for s, q in items:
            rows.append((s, used[s], base, q, at))
            used[s] += q * times
            at += s * q
        base += times
    rows.sort()
    a = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return {"key": (a[:, 0] << 48) + a[:, 1], "rank": a[:, 1], "base": a[:, 2], "each": a[:, 3], "at": a[:, 4]}


def pack(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to a written table of pieces."""
    spark = made.sparkSession
    sizes = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    total = sum(sizes.values())
    table = slot_table(plan(sizes, capacity)) if sizes else None
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(max(64, total // 100_000)))
    salted = made.withColumn("_salt", salt)
    offsets = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = offsets.select("length", "_salt", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32", F.xxhash64(*made.columns))) - 1
    ranked = salted.withColumn("_rank", within).join(offsets, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_salt", "_before")
    names = [c for c in made.columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema.fields) + ", sequence_id long, offset long"
    shared = spark.sparkContext.broadcast(table)  # bounded by capacity and the number of groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            i = np.searchsorted(t["key"], (length << 48) + rank, side="right") - 1
            k = rank - t["rank"][i]
            seq = t["base"][i] + k // t["each"][i]
            off = t["at"][i] + k % t["each"][i] * length
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, "_rank").mapInArrow(trimming(run), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed ids themselves, from pieces made with ids: sequence_id, ids (a sequence is at most the capacity)."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return pack(materialize(pieces(docs, str(tokenizer), capacity), "pieces"), capacity)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
