"""Suffix-array dedup: longest-previous-factor arrays over sampled suffixes.

Finds every string of `length` bytes that starts at more than one place of the
corpus (the same text included) and removes the bytes it covers: all of them,
or (keep_first) only those of later places, by (doc_id, row, position).

1. Anchors. A hash of each `length // 2` bytes picks minimisers, so that equal
   strings of `length` bytes hold an anchor at the same place. An anchor owns
   the strings for which it is the minimiser, and so at most 3/2 length bytes,
   its region. Anchors whose bytes occur once prove their strings unique.
2. Equal regions of one anchor are a class: every string in them repeats.
3. What differs: suffixes of the first regions of an anchor's classes, taken
   at the places where left contexts part, are sorted; in that suffix array
   the previous and the next smaller (and, if all copies go, greater)
   positions give each suffix's longest earlier (later) match.
4. An anchor with more than `CROWD` classes is not brought into one task: the
   strings of its regions are counted by hash, blocks of them first.

Hashes have 64 bits. Counts are combined before each shuffle, and joins of hot
anchors can be split.

Defined results: a null text is empty; texts shorter than `length` lose
nothing; repeated rows are copies; null doc_ids come last; long texts are read
whole, in overlapping blocks; an empty table gives no rows; other columns pass
through.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import _BYTE, chunks, discard, materialize, mix64, near_keys, powers, shelve, text_bytes, trimming, with_uid
from loomgraph.llm.line_dedup import _order_key

LENGTH = 400
CROWD = 32_768
BLOCK = 16
PIECE = 1 << 19
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


def _slide(x: np.ndarray, w: int, op: np.ufunc, fill) -> np.ndarray:
    """op over each window of w values of x."""
    n = len(x)
    m = -(-n // w) * w
    padded = np.full(m, fill, dtype=x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    head = op.accumulate(blocks, axis=1).ravel()
    tail = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(tail[: n - w + 1], head[w - 1 : n])


class Sums:
    """Polynomial hashes of any range of bytes."""

    def __init__(self, data: np.ndarray):
        p, self.inverse = powers(len(data) + 1)
        self.total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * p[:-1], out=self.total[1:])

    def of(self, a, b):
        return mix64((self.total[b] - self.total[a]) * self.inverse[a] + (np.asarray(b) - a).astype(np.uint64))


def _anchors_of(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, place in row, hash of its bytes, hash of its region, bytes left of it, bytes from it on)."""
    k = length // 2
    w = length - k + 1
    none = (np.zeros(0, np.int64),) * 6
    if len(data) < length:
        return none
    sums = Sums(data)
    x = mix64((sums.total[k:] - sums.total[:-k]) * sums.inverse[: len(data) - k + 1])
    n = np.diff(offsets)
    row_of_end = offsets[1:]
    for end in row_of_end[:-1]:  # no gram crosses two texts
        x[max(0, end - k + 1) : end] = _MAX
    low = _slide(x, w, np.minimum, _MAX)
    for end in row_of_end[:-1]:  # nor does any string
        low[max(0, end - length + 1) : end] = 0
    lowest = np.zeros(len(x), dtype=np.uint64)
    lowest[w - 1 : len(low)] = _slide(low, w, np.maximum, 0) if len(low) >= w else 0
    # near the ends fewer windows hold a place
    for i in (*range(min(w - 1, len(x))), *range(max(len(low), 0), len(x))):
        part = low[max(0, i - w + 1) : min(i, len(low) - 1) + 1]
        lowest[i] = part.max() if len(part) else 0
    at = np.flatnonzero((x == lowest) & (x != _MAX))
    row = np.searchsorted(offsets, at, side="right") - 1
    fits = n[row] >= length
    at, row = at[fits], row[fits]
    if not len(at):
        return none
    begin, end = offsets[row], offsets[row + 1]
    left = np.minimum(at - begin, w - 1)
    right = np.minimum(at, end - length) + length - at
    owned = right >= k  # the last string that holds the anchor reaches past its bytes
    at, row, begin, left, right = (v[owned] for v in (at, row, begin, left, right))
    region = mix64(sums.of(at - left, at + right) + left.astype(np.uint64))  # equal only with the anchor at the same place in it
    return row, at - begin, x[at], region, left, right


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    """(g, r, u, o, pos, lr) for each anchor: its hash, its region's, row, order, place, left << 32 | right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            uid, by = (b.column(i).to_numpy() for i in (0, 1))
            data, offsets = text_bytes(b.column(2))
            for i, j in chunks(offsets):
                part, cut = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                for shift, lo, hi in _blocks(len(part) if j == i + 1 else 0, length):
                    own = (part, cut) if hi is None else (part[shift : min(len(part), hi + 2 * length)], np.array([0, min(len(part), hi + 2 * length) - shift]))
                    row, pos, g, r, left, right = _anchors_of(*own, length)
                    if hi is not None:
                        pos = pos + shift
                        keep = (pos >= lo) & (pos < hi)
                        row, pos, g, r, left, right = (v[keep] for v in (row, pos, g, r, left, right))
                    if len(row):
                        cols = [g.view(np.int64), r.view(np.int64), uid[i:j][row], by[i:j][row], pos, (left << 32) | right]
                        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=["g", "r", "u", "o", "pos", "lr"])

    return docs.select("_uid", "_by", "text").mapInArrow(trimming(run), "g long, r long, u long, o long, pos long, lr long")


def _blocks(n: int, length: int):
    """(start, first, end of places) of the overlapping blocks of one long text; one open block otherwise."""
    if n <= 2 * PIECE:
        return [(0, 0, None)]
    return [(max(0, a - 2 * length), a, min(n, a + PIECE)) for a in range(0, n, PIECE)]


def lcp(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # equal up to lo, different within hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def longest_previous(order: list, common: list[int]) -> list[int]:
    """Longest match of each suffix with one of smaller position.

    order: positions in suffix order; common[i]: common prefix of suffixes i - 1 and i.
    The nearest smaller positions before and after a suffix are found with one stack.
    """
    n = len(order)
    best = [0] * n
    stack: list[list] = []  # (index, common prefix with what follows it so far)
    for i in range(n):
        reach = common[i] if i else 0
        if stack:
            stack[-1][1] = min(stack[-1][1], reach)
        while stack and order[stack[-1][0]] > order[i]:  # i is the next smaller of the top
            j, m = stack.pop()
            best[j] = max(best[j], m)
            if stack:
                stack[-1][1] = min(stack[-1][1], m)
        if stack:  # the top is the previous smaller of i
            best[i] = max(best[i], stack[-1][1])
        stack.append([i, 1 << 62])
    return best


def matches(regions: list[tuple[bytes, int, tuple]], length: int, keep_first: bool) -> list[tuple[int, int, int]]:
    """(region, bytes before its anchor, matched bytes) of the longest matches between regions of one anchor.

    regions: (bytes, how many lie before the anchor, position). With keep_first only matches at smaller positions count.
    """
    m = len(regions)
    back = [b[:left][::-1] for b, left, _ in regions]
    by_left = sorted(range(m), key=back.__getitem__)
    shared = [0] + [lcp(back[by_left[i - 1]], back[by_left[i]]) for i in range(1, m)]
    # how many bytes before the anchor a region shares with others: the distinct minima of runs of `shared` on either side
    sharing: dict[int, set[int]] = defaultdict(set)
    for steps in ([(i, i) for i in range(1, m)], [(i, i + 1) for i in range(m - 2, -1, -1)]):
        rising: list[int] = []
        for i, j in steps:
            while rising and rising[-1] >= shared[j]:
                rising.pop()
            rising.append(shared[j])
            for p in rising:
                sharing[p].add(by_left[i])
    out = []
    for p, members in sharing.items():  # one suffix array for each such place
        run = sorted((regions[x][0][regions[x][1] - p :], x) for x in members)
        common = [0] + [lcp(run[k - 1][0], run[k][0]) for k in range(1, len(run))]
        places = [regions[x][2] for _, x in run]
        best = longest_previous(places, common)
        if not keep_first:  # and the longest later match: the same with positions turned round
            rank = {q: -k for k, q in enumerate(sorted(places))}
            best = list(map(max, best, longest_previous([rank[q] for q in places], common)))
        out += [(x, p, n) for (_, x), n in zip(run, best, strict=True) if n >= length]
    return out


def _cut_regions(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Add the region's bytes to reps (g, u, o, pos, lr, ...)."""
    fields = [c for c in reps.columns if c != "u"]
    per_row = reps.groupBy(F.col("u").alias("_uid")).agg(F.collect_list(F.struct(*fields)).alias("parts"))  # bounded by a text's length
    found = near_keys(docs.select("_uid", "text"), "_uid", per_row, "_uid").join(per_row, "_uid")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in reps.schema.fields if f.name != "u")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                raw = (b.column(1)[k].as_py() or "").encode()
                parts = b.column(2)[k].values
                pos, lr = (np.asarray(parts.field(f)) for f in ("pos", "lr"))
                cut = [raw[p - (v >> 32) : p + (v & 0xFFFFFFFF)] for p, v in zip(pos.tolist(), lr.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[k].as_py()] * len(pos), pa.int64()), *(parts.field(f) for f in fields), pa.array(cut, pa.binary())], names=["u", *fields, "bytes"])

    return found.select("_uid", "text", "parts").mapInArrow(trimming(run), f"u long, {kinds}, bytes binary")


COVER = "u long, a long, b long"


def _covers(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names=["u", "a", "b"])


def _by_suffixes(cut: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """Covered bytes by the suffix arrays of each anchor's regions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list = []
        now = None

        def told():
            if len(group) < 2:
                return []
            got = matches([(d, v >> 32, (o, u, p)) for u, o, p, v, d in group], length, keep_first)
            return [(group[x][0], group[x][2] - before, group[x][2] - before + n) for x, before, n in got]

        for b in batches:
            out = []
            for g, u, o, p, v, d in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if g != now:
                    out += told()
                    group, now = [], g
                group.append((u, o, p, v, d))
            yield _covers(out)
        yield _covers(told())

    return cut.select("g", "u", "o", "pos", "lr", "bytes").repartition("g").sortWithinPartitions("g").mapInArrow(trimming(run), COVER)


def _by_strings(cut: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """Covered bytes of crowded anchors: blocks of strings counted by the bytes that they share, then strings."""

    def hashed(size: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                data, offsets = text_bytes(b.column(5))
                left = b.column(4).to_numpy() >> 32
                pos, n = b.column(3).to_numpy(), np.diff(offsets)
                if not len(data):
                    continue
                sums = Sums(data)
                if size > 1:  # blocks lie at fixed places from the anchor; a text's ends cut them short
                    first = -left
                    last = n - left - length
                    lo = 1 << 20
                    blocks = (last + lo) // BLOCK - (first + lo) // BLOCK + 1
                    k = np.repeat(np.arange(len(n)), blocks)
                    number = (first[k] + lo) // BLOCK + _ramp(blocks)
                    a = np.maximum(number * BLOCK - lo, first[k])
                    z = np.minimum(number * BLOCK - lo + BLOCK - 1, last[k])
                else:
                    a, z = b.column(6).to_numpy(), b.column(7).to_numpy()
                    times = z - a + 1
                    k = np.repeat(np.arange(len(n)), times)
                    a = np.repeat(a, times) + _ramp(times)
                    z = a
                base = offsets[:-1][k] + left[k]
                whole = np.asarray((z - a == size - 1))
                h = sums.of(base + z, base + a + length)
                h = np.where(whole, mix64(h ^ (a + (1 << 20)).astype(np.uint64)), np.uint64(0))
                cols = [b.column(0).to_numpy()[k], b.column(1).to_numpy()[k], b.column(2).to_numpy()[k], pos[k], np.where(whole, h, 0).view(np.int64), a, z, np.where(whole, (a + (1 << 20)) // BLOCK, -1 - (a + (1 << 20)) // BLOCK)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=["g", "u", "o", "pos", "h", "a", "z", "block"])

        return run

    shape = "g long, u long, o long, pos long, h long, a long, z long, block long"  # block: -1 - number if a text's end cuts it short
    blocks = cut.select("g", "u", "o", "pos", "lr", "bytes").mapInArrow(trimming(hashed(BLOCK)), shape)
    blocks = materialize(blocks, "blocks")
    whole, short = blocks.where("block >= 0"), blocks.where("block < 0")
    often = whole.groupBy("g", "h").agg(F.count("*").alias("n")).where("n > 1").select("g", "h")
    # a block cut short may hold strings of a whole one that is the only one of its kind
    beside = short.select("g", (-1 - F.col("block")).alias("block")).distinct()
    kept = ["g", "u", "pos", "a", "z"]
    open_ = whole.join(often, ["g", "h"], "left_semi").select(*kept).union(whole.join(beside, ["g", "block"], "left_semi").select(*kept)).distinct().union(short.select(*kept))
    singles = materialize(cut.select("g", "u", "o", "pos", "lr", "bytes").join(open_, ["g", "u", "pos"]).select("g", "u", "o", "pos", "lr", "bytes", "a", "z").mapInArrow(trimming(hashed(1)), shape), "strings")
    place = F.struct("o", "u", "pos")
    many = singles.groupBy("g", "h").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("g", "h", "first")
    hit = singles.join(many, ["g", "h"])
    if keep_first:
        hit = hit.where(~place.eqNullSafe(F.col("first")))
    return hit.select("u", (F.col("pos") + F.col("a")).alias("a"), (F.col("pos") + F.col("a") + length).alias("b"))


def _ramp(n: np.ndarray) -> np.ndarray:
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def covered(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, crowd: int = CROWD) -> DataFrame:
    """(_uid, spans): the bytes to remove from each row of docs with _uid, as unmerged (a, b) ranges."""
    docs = docs.select("_uid", "doc_id", "text").withColumn("_by", _order_key(docs))
    anchors = materialize(_anchors(docs, length), "anchors")
    often = anchors.groupBy("g").agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).where("n > 1").select("g", (F.col("low") != F.col("high")).alias("mixed"))
    # what is joined with hot anchors is a table by then, so that Spark can split those anchors
    often = materialize(often, "often")
    members = materialize(anchors.join(often, "g"), "members")
    discard(anchors, often)
    place = F.struct("o", "u", "pos")
    classes = members.groupBy("g", "r").agg(F.count("*").alias("n"), F.min(F.struct("o", "u", "pos", "lr")).alias("first"), F.first("mixed").alias("mixed"))
    classes = materialize(classes, "classes")
    copied = members.join(classes.where("n > 1").select("g", "r", F.struct("first.o", "first.u", "first.pos").alias("first")), ["g", "r"])
    if keep_first:
        copied = copied.where(~place.eqNullSafe(F.col("first")))
    left, right = F.shiftright("lr", 32), F.col("lr").bitwiseAND(F.lit(0xFFFFFFFF))
    spans = copied.select("u", (F.col("pos") - left).alias("a"), (F.col("pos") + right).alias("b"))
    kinds = materialize(classes.where("mixed").groupBy("g").agg(F.count("*").alias("kinds")), "kinds")
    reps = materialize(classes.where("mixed").join(kinds, "g").select("g", "first.u", "first.o", "first.pos", "first.lr", "kinds"), "reps")
    cut = materialize(_cut_regions(docs, reps), "regions")
    discard(kinds, reps)
    spans = spans.union(_by_suffixes(cut.where(F.col("kinds") <= crowd), length, keep_first))
    crowded = cut.where(F.col("kinds") > crowd)
    if not crowded.isEmpty():
        spans = spans.union(_by_strings(crowded, length, keep_first))
    return spans.groupBy(F.col("u").alias("_uid")).agg(F.collect_set(F.struct("a", "b")).alias("spans"))  # bounded by a text's length


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of (a, b) ranges."""
    if not len(spans):
        return spans.reshape(0, 2)
    s = spans[np.argsort(spans[:, 0], kind="stable")]
    end = np.maximum.accumulate(s[:, 1])
    new = np.append(True, s[1:, 0] > end[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)
    return np.stack([s[new, 0], end[last]], 1)


def _spans_of(column, k: int) -> np.ndarray:
    if not column[k].is_valid:
        return np.zeros((0, 2), np.int64)
    v = column[k].values
    return merged(np.stack([np.asarray(v.field("a")), np.asarray(v.field("b"))], 1))


def _kept(raw: bytes, spans: np.ndarray) -> bytes:
    edges = [0, *spans.ravel().tolist(), len(raw)]
    return b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))


def dedup_substrings(docs: DataFrame, length: int = LENGTH, keep_first: bool = True) -> DataFrame:
    """docs with texts cut; a character of which a byte goes, goes. Rows whose text is removed whole go; n_chars is counted anew."""
    docs, restore = shelve(docs, "doc_id", "text", "n_chars")
    docs = with_uid(docs)
    joined = docs.join(covered(docs, length, keep_first), "_uid", "left")
    rest = [c for c in docs.columns if c not in ("text", "_uid")]
    whole, cut = joined.where("spans IS NULL").select(*rest, "text"), joined.where("spans IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, spans = b.column(0), b.column(1)
            left = [_kept(text[k].as_py().encode(), _spans_of(spans, k)).decode("utf-8", "ignore") for k in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(left, pa.string())], names=[*b.schema.names[2:], "text"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in rest)
    cut = cut.select("text", "spans", *rest).mapInArrow(trimming(run), f"{kinds}, text string").where(F.trim("text") != "")
    if "n_chars" in rest:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return restore(whole.union(cut.select(*rest, "text")))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of a repeated 400-byte string goes: doc_id, n_bytes, n_removed, n_spans, kept_sha256; further: kept_text, without characters of which a byte went."""
    docs = with_uid(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    joined = docs.join(covered(docs), "_uid", "left").select("doc_id", "text", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k in range(b.num_rows):
                raw = (b.column(1)[k].as_py() or "").encode()
                spans = _spans_of(b.column(2), k)
                kept = _kept(raw, spans)
                rows.append((len(raw), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), pa.int64()) for c in cols[:3]), *(pa.array(list(c), pa.string()) for c in cols[3:])], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    return joined.mapInArrow(trimming(run), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
