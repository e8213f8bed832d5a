"""Line dedup: an exact set-similarity join of lines.

A line is the set of its words. Lines with equal sets form a class. Words are
ordered by rarity (counts over all lines in a sketch of fixed size; any total
order gives the same links), and each class is indexed under the first words
that its prefix needs for the threshold. Two classes that meet under a word
become candidates if the length filter, the positional filter and a bitmap
bound on the words they can't share let them. Candidates are verified by
Jaccard similarity on the words themselves.

A line goes if an earlier line, by (doc_id, row, line number), is as similar
as the threshold or more; blank lines stay. A row's lines are counted where its
text is, and the lines that stay are joined to them.

Defined results: a null text has no lines; null doc_ids come last; repeated
rows repeat their lines, so the later one loses them; a text may have any
number of lines; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import among, chunks, fold_slices, letters_of, materialize, mix64, shelve, slice_rows, text_bytes, trimming, with_uid, word_hashes

#: Jaccard threshold as a fraction: 4 / 5.
THRESHOLD = (4, 5)
SKETCH_BITS = 20
#: Bits of the fixed bitmap of classes that have candidates.
WANTED_BITS = 23
BUFFER = 1 << 16
#: Rows of the index that a task gathers before it deals them out to buckets.
DEALT = 1 << 18
#: Blocks of rows in an Arrow batch.
BLOCKS = 256
HEAD = struct.Struct("<I6B")
#: One of so many pieces of a task's texts is counted for the order of words: all are.
COUNTED = 1
#: Counts of words are told apart up to this one.
TOP = (1 << 20) - 1


def line_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line offsets, row of each line, number of each line in its row)."""
    breaks = np.flatnonzero(data == 10)
    per_row = 1 + np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1])
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    rows = np.repeat(np.arange(len(per_row)), per_row)
    number = np.arange(len(rows)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    return np.append(starts, offsets[-1]), rows, number


def word_sets(h: np.ndarray, line: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each line's distinct words, by line, then rarity (count, of the same h the same), then hash: the same order of words in every set.

    line: ascending; count: up to TOP.
    """
    if not len(line) or line[-1] > TOP:
        order = np.lexsort((h, count, line))
    else:
        key = (line.astype(np.uint64) << np.uint64(44)) | (count.astype(np.uint64) << np.uint64(24)) | (h >> np.uint64(40))
        order = np.argsort(key)
        key, hash_ = key[order], h[order]
        if ((key[1:] == key[:-1]) & (hash_[1:] != hash_[:-1])).any():
            order = np.lexsort((h, count, line))
    h, line = h[order], line[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
    return h[keep], line[keep]


def set_keys(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name a set of words, in any order."""
    return np.add.reduceat(mix64(h), first), np.add.reduceat(mix64(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first)


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def word_sketch(docs: DataFrame) -> np.ndarray:
    """How many of all lines' words fall into each of 2**SKETCH_BITS cells.

    It orders words by rarity, and any order gives the same links.
    """
    mask = np.uint64((1 << SKETCH_BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        cells, waiting = [], 0
        for b in batches:
            data, offsets = text_bytes(b.column(0))
            for i, j in chunks(offsets, 1 << 16):
                h, *_ = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                cells.append((h & mask).astype(np.int64))
                waiting += len(h)
                if waiting > 1 << 20:
                    total += np.bincount(np.concatenate(cells), minlength=len(total))
                    cells, waiting = [], 0
        if cells:
            total += np.bincount(np.concatenate(cells), minlength=len(total))
        yield from slice_rows(total)

    return fold_slices(docs.select("text").mapInArrow(trimming(run), "slice int, data binary"), np.add, 1 << SKETCH_BITS)


def sampled(n: np.ndarray) -> np.ndarray:
    """For a set of n words, the power of two of which one word in so many is in its bitmaps; else large sets fill them."""
    return np.maximum(0, np.ceil(np.log2(np.maximum(n, 1) / 192))).astype(np.int64)


def bitmaps(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit maps of each set's words, half of the words in either."""
    n = np.diff(np.append(first, len(h)))
    one, low = np.uint64(1), np.repeat((1 << sampled(n)) - 1, n).astype(np.uint64)
    bit = np.where((h & low) == 0, one << (h >> np.uint64(58)), np.uint64(0))
    half = (h >> np.uint64(51)) & one
    return np.bitwise_or.reduceat(bit * half, first), np.bitwise_or.reduceat(bit * (one - half), first)


def rarity_order(owner: np.ndarray, count: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Order by owner, then rarity, then hash: the same order of words in every set."""
    count = np.minimum(count, TOP)
    if not len(owner) or owner[-1] > TOP:
        return np.lexsort((h, count, owner))
    key = (owner.astype(np.uint64) << np.uint64(44)) | (count.astype(np.uint64) << np.uint64(24)) | (h >> np.uint64(40))
    order = np.argsort(key)
    key = key[order]
    return np.lexsort((h, count, owner)) if (key[1:] == key[:-1]).any() else order


def sorted_by(key: np.ndarray, *then: np.ndarray) -> np.ndarray:
    """np.lexsort((*then, key)), where few keys are equal."""
    order = np.argsort(key)
    key = key[order]
    same = np.zeros(len(key), dtype=bool)
    same[1:] = key[1:] == key[:-1]
    same[:-1] |= same[1:]
    tied = order[same]
    order[same] = tied[np.lexsort((*(t[tied] for t in then), key[same]))]
    return order


def by_word(k: np.ndarray, value: np.ndarray, then: np.ndarray) -> np.ndarray:
    """np.lexsort((then, value, k)) for ascending k, in one sort of numbers of k and value where 64 bits hold them."""
    run = np.zeros(len(k), np.uint64)
    run[1:] = np.cumsum(k[1:] != k[:-1])
    bits = 64 - int(run[-1]).bit_length() if len(k) else 64
    least = int(value.min()) if len(k) else 0
    if len(k) and int(value.max()) - least >> bits:
        # the value's upper bits
        return sorted_by((run << np.uint64(bits)) | ((value.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(64 - bits)), then, value)
    return sorted_by((run << np.uint64(bits)) | (value - least).view(np.uint64), then)


def _joined(parts: list[list[np.ndarray]]) -> np.ndarray:
    """Columns of parts as rows of one array."""
    out = np.empty((len(parts[0]), sum(len(p[0]) for p in parts)), np.int64)
    for c, row in enumerate(out):
        np.concatenate([p[c].view(np.int64) if p[c].dtype == np.uint64 else p[c] for p in parts], out=row)
    return out


def _record(*cols: np.ndarray) -> pa.RecordBatch:
    whole = [c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64, copy=False) for c in map(np.ascontiguousarray, cols)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in whole], names=list("kxyvzw"))


def _prefixes(batches: Iterator[pa.RecordBatch], sketch: np.ndarray, threshold: tuple[int, int], only: np.ndarray | None = None):
    """For each block of texts (_uid, _by, text): its lines with words, and the words that index them.

    only: bitmap of words; lines that none of them indexes are passed over.

    Yields (lo, hi, sig, sig2, uid, by, number) of the lines, and (h, line, size, place) of the
    prefix words of the first line of each class in the block.
    """
    num, den = threshold
    mask = np.uint64((1 << SKETCH_BITS) - 1)
    sketch = np.minimum(sketch, TOP).astype(np.int32)
    for b in batches:
        uid, by = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        data, offsets = text_bytes(b.column(2))
        for i, j in chunks(offsets):
            part, cut = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            at, row, number = line_starts(part, cut)
            h, _, _, line = word_hashes(part, at)
            if only is not None:
                wanted = np.zeros(len(row), dtype=bool)
                wanted[line[only[(h & np.uint64(len(only) - 1)).astype(np.int64)]]] = True
                wanted = wanted[line]
                h, line = h[wanted], line[wanted]
            if not len(h):
                continue
            h, line = word_sets(h, line, sketch[(h & mask).astype(np.int64)])
            first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
            n = np.diff(np.append(first, len(h)))
            if only is not None:
                lead = n - (-(-num * n // den)) + 1
                at_ = np.repeat(first, lead) + np.arange(lead.sum()) - np.repeat(np.cumsum(lead) - lead, lead)
                wanted = np.zeros(len(row), dtype=bool)
                wanted[line[at_[only[(h[at_] & np.uint64(len(only) - 1)).astype(np.int64)]]]] = True
                stay = wanted[line[first]]
                wanted = np.repeat(stay, n)
                h, line, n = h[wanted], line[wanted], n[stay]
                if not len(h):
                    continue
                first = np.cumsum(n) - n
            lo, hi = set_keys(h, first)
            lines = line[first]
            order = by[i:j][row[lines]]
            one = np.lexsort((order, lo))  # of equal sets the earliest
            one = one[np.append(True, lo[one][1:] != lo[one][:-1])]
            chosen = np.zeros(len(first), dtype=bool)
            chosen[one] = True
            pick = np.repeat(chosen, n)
            sig, sig2 = bitmaps(h, first)
            h, owner = h[pick], np.repeat(np.arange(len(first)), n)[pick]
            start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            size = n[owner]
            place = np.arange(len(h)) - np.repeat(start, n[owner[start]])
            pre = place < size - (-(-num * size // den)) + 1
            yield (lo, hi, sig, sig2, uid[i:j][row[lines]], order, number[lines]), (h[pre], owner[pre], size[pre], place[pre])


def bucket_bits(words: int) -> int:
    """Bits of a bucket's number, for a table of so many words: blocks that aren't tiny, buckets that a task can hold."""
    return max(min(max(6, (words >> 14).bit_length()), 9), (words >> 22).bit_length())


def deal(rows: np.ndarray, own: bool, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows of the index (k, x, y, v, z, w) as blocks, one for each bucket of the upper bits of k.

    A block has its number of rows, the bytes in use of each column, and the columns: k in order,
    as differences; z of lines (`own`) negated; columns of less than 8 bytes byte by byte, all first
    bytes before the second ones.
    """
    order = np.argsort(rows[0])
    rows = np.stack([c[order] for c in rows])
    if own:
        rows[4] = ~rows[4]
    bucket = rows[0] >> ((64 if own else 32) - bits)
    start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    k = rows[0].copy()
    rows[0, 1:] -= k[:-1]
    rows[0, start] = k[start]
    wide = [8 if c.min() < 0 else -(-int(c.max()).bit_length() // 8) for c in rows]
    cols = [c if n == 8 else np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T[:n]) for c, n in zip(rows, wide, strict=True) if n]
    ends = np.append(start[1:], rows.shape[1])
    for i in range(0, len(start), BLOCKS):
        data = [HEAD.pack(b - a, *wide) + b"".join([c[..., a:b].tobytes() for c in cols]) for a, b in zip(start[i : i + BLOCKS].tolist(), ends[i : i + BLOCKS].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[start[i : i + BLOCKS]], pa.int32()), pa.array([own] * len(data)), pa.array(data, pa.binary())], names=["bucket", "own", "data"])


def gathered(blocks: list[bytes], own: bool) -> np.ndarray:
    """The rows of blocks in the order of k."""
    heads = [HEAD.unpack_from(x) for x in blocks]
    size = np.array([n for n, *_ in heads])
    start = np.cumsum(size) - size
    rows = np.zeros((6, int(size.sum())), np.int64)
    raw = rows.view(np.uint8).reshape(6, -1, 8)
    for x, (n, *wide), s in zip(blocks, heads, start.tolist(), strict=True):
        at = HEAD.size
        for c, w in enumerate(wide):
            if w == 8:
                rows[c, s : s + n] = np.frombuffer(x, np.int64, n, at)
            elif w:
                raw[c, s : s + n, :w] = np.frombuffer(x, np.uint8, w * n, at).reshape(w, n).T
            at += w * n
    k = np.cumsum(rows[0])  # may wrap around
    rows[0] = k + np.repeat(rows[0, start] - k[start], size)
    if own:
        rows[4] = ~rows[4]
    order = np.argsort(rows[0])
    return np.stack([c[order] for c in rows])


def undealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The index's rows, whole buckets at a time, of blocks that are sorted by bucket."""
    held: tuple[list[bytes], list[bytes]] = ([], [])
    waiting, last = 0, None

    def told():
        for own, blocks in enumerate(held):
            rows = gathered(blocks, bool(own)) if blocks else np.zeros((6, 0), np.int64)
            for i in range(0, rows.shape[1], BUFFER):
                yield _record(*rows[:, i : i + BUFFER])

    for b in batches:
        for bucket, own, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if bucket != last and waiting >= BUFFER:
                yield from told()
                held, waiting = ([], []), 0
            last = bucket
            held[own].append(data)
            waiting += HEAD.unpack_from(data)[0]
    yield from told()


def _entries(docs: DataFrame, sketch: np.ndarray, threshold: tuple[int, int], words: np.ndarray | None = None) -> DataFrame:
    """Blocks of index entries (word, class, bitmaps, size and place, order) and, with z < 0, lines (class, row).

    Of a word's hash 32 bits are told: words that share them add candidates only.
    words: bitmap; only entries under one of its words are made, and no lines.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((sketch, words))  # of fixed size
    bits = bucket_bits(COUNTED * int(sketch.sum()))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, list[np.ndarray]]]:
        sketch, only = shared.value
        only = None if only is None else _unpacked(only)
        for (lo, hi, sig, sig2, uid, by, number), (h, o, size, place) in _prefixes(batches, sketch, threshold, only):
            if only is None:
                yield True, [lo, uid, hi, np.zeros(len(lo), np.int64), -1 - number, by]
            else:
                pre = only[(h & np.uint64(len(only) - 1)).astype(np.int64)]
                h, o, size, place = h[pre], o[pre], size[pre], place[pre]
            if len(o):
                yield False, [h >> np.uint64(32), lo[o], sig[o], sig2[o], (size << 24) | place, by[o]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list[list[np.ndarray]], list[list[np.ndarray]]] = ([], [])
        waiting = [0, 0]
        for own, cols in rows(batches):
            held[own].append(cols)
            waiting[own] += len(cols[0])
            if waiting[own] >= DEALT:
                yield from deal(_joined(held[own]), own, bits)
                held[own].clear()
                waiting[own] = 0
        for own in (False, True):
            if held[own]:
                yield from deal(_joined(held[own]), own, bits)

    return docs.select("_uid", "_by", "text").mapInArrow(trimming(run), BLOCK)


def first_lines(c: np.ndarray) -> np.ndarray:
    """Of lines (k, x, y, v, z, w) the first of each class, by (order, row, number), in the order of classes."""
    lo, uid, hi, _, z, w = c
    c = c[:, np.lexsort((-z, uid, w, hi, lo))]
    return c[:, np.append(True, (c[0, 1:] != c[0, :-1]) | (c[2, 1:] != c[2, :-1]))]


class Meeting:
    """Finds candidate pairs among index entries that are sorted by word.

    Up to `all_up_to` earlier candidates of a class under a word are all told.
    Where there are more, only the `best` are told and the class is marked:
    the earliest of those that the bitmaps show to be near (so that a large
    group meets the same few), else the nearest. Classes of equal order may sort
    the wrong way round, so the earlier one of such a pair that is not told is
    marked too. Among more than `crowd` classes under one word those that are
    near one of the first `leaders` are told of these alone and marked, with all
    classes of equal order; the leaders of the others follow, until few are near
    one, and what is left meets all. Marked classes that no told pair settles are
    met again without these limits (`only`: bitmap of classes, one of which each
    pair must hold). lines: whether lines are told as well.

    Pairs under a frequent word are many, so most are told by their bitmaps alone,
    in blocks, among classes of sizes that can be similar.
    """

    def __init__(self, threshold: tuple[int, int], all_up_to: int = 4, best: int = 2, crowd: int = 4096, leaders: int = 64, only: np.ndarray | None = None, lines: bool = True):
        self.num, self.den = threshold
        self.lines = lines
        self.all_up_to, self.best, self.crowd, self.leaders, self.only = all_up_to, best, crowd, leaders, only

    def _fits(self, c, i, o):
        """(may i and o reach the threshold, how many words they differ by at least)."""
        n, place, y, v = c["n"], c["place"], c["y"], c["v"]
        ni, no, pi, po = n[i], n[o], place[i], place[o]
        both = ni + no
        need = -(-self.num * both // (self.num + self.den))
        small, ps = np.minimum(ni, no), np.where(ni <= no, pi, po)
        fits = (self.num * np.maximum(ni, no) <= self.den * small) & (ps <= small - (-(-2 * self.num * small // (self.num + self.den))))
        fits &= np.minimum(ni - pi, no - po) >= need  # holds at the first word that a similar pair shares
        alike = c["sampled"][i] == c["sampled"][o]  # else the maps can't be compared
        only_i = np.where(alike, _bits(y[i] & ~y[o]) + _bits(v[i] & ~v[o]), 0)
        only_o = np.where(alike, _bits(y[o] & ~y[i]) + _bits(v[o] & ~v[i]), 0)
        fits &= (only_i <= ni - need) & (only_o <= no - need) & (c["x"][i] != c["x"][o])
        # how far apart: 0 if at most half of what the threshold allows
        apart = only_i + only_o
        return fits, np.where(2 * apart * (self.num + self.den) <= both * (self.den - self.num), 0, apart)

    def _told(self, c, late, early, apart):
        """Limit the candidates of each later class: (late, early, marked classes)."""
        if self.only is not None:  # of equal order either may be the later one
            keep = c["only"][late] | (c["only"][early] & (c["w"][late] == c["w"][early]))
            return late[keep], early[keep], late[:0]
        if not len(late):
            return late, early, late[:0]
        count = np.bincount(late)
        many = count[late] > self.all_up_to
        if not many.any():
            return late, early, late[:0]
        order = np.lexsort((early, apart, late))
        late, early, many = late[order], early[order], many[order]
        start = np.cumsum(np.append(0, count[:-1]))
        rank = np.arange(len(late)) - start[late]
        keep = ~many | (rank < self.best)
        tied = ~keep & (c["w"][late] == c["w"][early])  # the class that sorts first may be the later line
        return late[keep], early[keep], np.unique(np.concatenate([late[many], early[tied]]))

    def _small(self, c, alive, run_of):
        """Runs of few classes, all at once: rows alive."""
        y, v, most, d = c["y"], c["v"], c["most"], 0
        while len(alive):
            d += 1
            alive = alive[alive + d < len(run_of)]
            alive = alive[run_of[alive + d] == run_of[alive]]
            o = alive + d
            near = np.bitwise_count(y[alive] ^ y[o]) + np.bitwise_count(v[alive] ^ v[o]) <= np.maximum(most[alive], most[o])
            if near.any():
                yield o[near], alive[near]

    def _block(self, c, late, early):
        """Pairs (i of late, o of early, o < i; both ascending) that the bitmaps let be similar, all of an i in one block."""
        y, v, most = c["y"], c["v"], c["most"]
        y_early, v_early, open_ = y[early], v[early], np.flatnonzero(most[early] == 255)
        step = max(1, BUFFER // max(1, len(early)))
        for s in range(0, len(late), step):
            i = late[s : s + step]
            n = int(np.searchsorted(early, i[-1]))
            near = np.bitwise_count(y[i][:, None] ^ y_early[:n])
            near += np.bitwise_count(v[i][:, None] ^ v_early[:n])
            near = near <= most[i][:, None]
            near[:, open_[: np.searchsorted(open_, n)]] = True
            at, to = np.divmod(np.flatnonzero(near), max(1, n))
            at, to = i[at], early[to]
            keep = to < at
            if keep.any():
                yield at[keep], to[keep]

    def _run(self, c, late, a, b):
        """Pairs of classes late with all earlier ones of the run from a to b, by sizes where the run is long."""
        if b - a <= 1024:
            yield from self._block(c, late, np.arange(a, b))
            return
        # sizes of similar sets are at most one level apart
        level = np.floor(np.log(c["n"][a:b]) / max(np.log(self.den / self.num), 1e-6) + 1e-9).astype(np.int64)
        for k in np.unique(level[late - a]):
            yield from self._block(c, late[level[late - a] == k], a + np.flatnonzero(abs(level - k) <= 1))

    def _crowd(self, c, a, b):
        """(late, early, marked classes) of a run that is longer than crowd."""
        none = np.zeros(0, np.int64)
        w = c["w"][a:b]
        tied = np.zeros(b - a, dtype=bool)
        tied[1:] = w[1:] == w[:-1]
        tied[:-1] |= tied[1:]
        yield none, none, a + np.flatnonzero(tied)
        rest, alone, share = np.arange(a, b), [], 1.0
        while len(rest) > self.leaders and share > 1 / 16:
            settled = np.zeros(b - a, dtype=bool)
            for i, o in self._block(c, rest, rest[: self.leaders]):
                fits, _ = self._fits(c, i, o)
                settled[i[fits] - a] = True
                yield i[fits], o[fits], none
            yield none, none, a + np.flatnonzero(settled)
            share = settled.sum() / len(rest)
            left = ~settled[rest - a]
            alone.append(rest[: self.leaders][left[: self.leaders]])
            rest = rest[self.leaders :][left[self.leaders :]]
        for i, o in self._run(c, np.concatenate([*alone, rest]), a, b):
            yield i, o, none

    def _pairs(self, c, start, end, run_of):
        """Lists of (late, early, marked classes), all pairs of a late class in one list."""
        size, none = end - start, np.zeros(0, np.int64)
        yield [(o, i, none) for o, i in self._small(c, np.flatnonzero(((size > 1) & (size <= 64))[run_of]), run_of)]
        held, waiting = [], 0
        for a, b in zip(start[size > 64], end[size > 64], strict=True):
            if self.only is None and b - a > self.crowd:
                found = self._crowd(c, a, b)
            else:
                late = np.arange(a, b)
                if self.only is not None:  # of equal order either may be the later one
                    late = late[np.isin(c["w"][a:b], c["w"][a:b][c["only"][a:b]])]
                found = ((i, o, none) for i, o in self._run(c, late, a, b))
            for t in found:
                held.append(t)
                waiting += len(t[0])
                if waiting > BUFFER:
                    yield held
                    held, waiting = [], 0
        yield held

    def pairs(self, rows: np.ndarray):
        k = rows[0]  # sorted
        shared = np.zeros(len(k), dtype=bool)
        shared[1:] = k[1:] == k[:-1]
        shared[:-1] |= shared[1:]
        k, x, y, v, z, w = rows[:, shared]
        order = by_word(k, x, w)  # of a class's entries under a word the earliest
        k, x, w = k[order], x[order], w[order]
        fresh = np.ones(len(k), dtype=bool)
        place = z[order]  # differs under words that share their told bits: either stays
        fresh[1:] = (k[1:] != k[:-1]) | (x[1:] != x[:-1]) | (place[1:] != place[:-1])
        order, k, x, w = order[fresh], k[fresh], x[fresh], w[fresh]
        again = by_word(k, w, x)  # within a word by first place
        k, x, w, order = k[again], x[again], w[again], order[again]
        c = {"x": x, "w": w, "y": y[order].view(np.uint64), "v": v[order].view(np.uint64), "n": z[order] >> 24, "place": z[order] & 0xFFFFFF}
        c["sampled"] = sampled(c["n"])
        if self.only is not None:
            c["only"] = self.only[x & (len(self.only) - 1)]
        # bits that similar sets differ by at most; sets whose maps may not compare are never told apart by them
        c["most"] = np.where(c["sampled"] > 0, 255, np.minimum(c["n"] * (self.den - self.num) // self.num, 255)).astype(np.uint8)
        start = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
        end = np.append(start[1:], len(k))
        out = []
        for found in self._pairs(c, start, end, np.repeat(np.arange(len(start)), end - start)):
            i, o, marked = (np.concatenate([np.zeros(0, np.int64), *(t[k] for t in found)]) for k in range(3))
            fits, apart = self._fits(c, i, o)
            t = self._told(c, i[fits], o[fits], apart[fits])
            out.append((t[0], t[1], np.concatenate([t[2], marked])))
        late, early, marked = (np.concatenate([t[k] for t in out]) for k in range(3))
        pair = np.unique(np.stack([np.minimum(x[late], x[early]), np.maximum(x[late], x[early])], 1), axis=0)
        return pair, np.unique(x[marked])

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of kind 0: a pair (a, b); kind 1: a line's row and number; kind 2: a marked class a; kind 3: a class (a, b) and its first line's row, order and number."""
        held: list[np.ndarray] = []
        waiting = 0
        firsts = np.zeros((6, 0), np.int64)  # of the classes that may go on

        def row(a, b, uid, line, by, kind):
            return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(t)) for t in (a, b, uid, line, by)), pa.array(np.full(len(a), kind, np.int8))], names=["a", "b", "uid", "line", "by", "kind"])

        def told(first):
            if first.shape[1]:
                lo, uid, hi, _, z, w = first
                yield row(lo, hi, uid, -1 - z, w, 3)

        def cut(last: bool):
            nonlocal held, waiting
            rows = np.concatenate(held, axis=1) if held else np.zeros((6, 0), np.int64)
            end = rows.shape[1] if last else int(np.searchsorted(rows[0], rows[0, -1]))
            held, waiting = [rows[:, end:]], 0
            if not end:
                return
            pair, marked = self.pairs(rows[:, :end])
            if len(pair):
                zero = np.zeros(len(pair), np.int64)
                yield row(pair[:, 0], pair[:, 1], zero, zero, zero, 0)
            if len(marked):
                zero = np.zeros(len(marked), np.int64)
                yield row(marked, zero, zero, zero, zero, 2)

        for b in batches:
            c = np.stack([b.column(i).to_numpy() for i in range(6)])
            own = c[4] < 0
            if own.any():
                if self.lines:
                    zero = np.zeros(int(own.sum()), np.int64)
                    yield row(zero, zero, c[1, own], -1 - c[4, own], zero, 1)
                firsts = first_lines(np.concatenate([firsts, c[:, own]], axis=1))
                done = firsts[0] < firsts[0, -1]
                yield from told(firsts[:, done])
                firsts = firsts[:, ~done]
            held.append(c[:, ~own])
            waiting += held[-1].shape[1]
            if waiting >= BUFFER:
                yield from cut(False)
        yield from cut(True)
        yield from told(firsts)


MET = "a long, b long, uid long, line long, by long, kind byte"
#: Blocks hold rows of k, x, y, v, z, w, as Meeting takes them.
BLOCK = "bucket int, own boolean, data binary"


def met(entries: DataFrame, meeting: Meeting) -> DataFrame:
    return entries.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(trimming(lambda batches: meeting(undealt(batches))), MET)


def _spots(uid: np.ndarray, line: np.ndarray) -> np.ndarray:
    """A number for each line of a row, spread."""
    return mix64(uid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + line.astype(np.uint64)).view(np.int64)


def bitmap_of(keys: DataFrame) -> np.ndarray:
    """Bitmap of fixed size over the low bits of a column of longs, or of the spots of two (row, line)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << WANTED_BITS, dtype=bool)
        for b in batches:
            key = [c.to_numpy() for c in b.columns]
            bits[(key[0] if len(key) == 1 else _spots(*key)) & ((1 << WANTED_BITS) - 1)] = True
        yield from slice_rows(np.packbits(bits).view(np.int64))

    return fold_slices(keys.mapInArrow(trimming(run), "slice int, data binary"), np.bitwise_or, (1 << WANTED_BITS) // 64)


def _unpacked(bits: np.ndarray) -> np.ndarray:
    return np.unpackbits(bits.view(np.uint8)).astype(bool)


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Lines number line of rows uid in wanted, and few others: lo, hi, line_text (one of each class a block)."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(wanted.select("uid", "line")))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = _unpacked(shared.value)
        for b in batches:
            uid = b.column(0).to_numpy()
            data, offsets = text_bytes(b.column(1))
            for i, j in chunks(offsets):
                part, cut = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                at, row, number = line_starts(part, cut)
                hit = np.flatnonzero(bits[_spots(uid[i:j][row], number) & ((1 << WANTED_BITS) - 1)])
                raw = part.tobytes()
                lines = [raw[at[x] : at[x + 1]] for x in hit]
                if not (whole := b"".join(lines)):
                    continue
                h, _, _, line = word_hashes(np.frombuffer(whole, np.uint8), np.append(0, np.cumsum([len(x) for x in lines], dtype=np.int64)))
                if not len(h):
                    continue
                h, line = word_sets(h, line, np.zeros(len(h), np.int64))
                first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
                lo, hi = set_keys(h, first)
                _, one = np.unique(lo, return_index=True)
                text = [lines[x].decode() for x in line[first[one]]]
                yield pa.RecordBatch.from_arrays([pa.array(lo[one].view(np.int64)), pa.array(hi[one].view(np.int64)), pa.array(text, pa.string())], names=["lo", "hi", "line_text"])

    return docs.select("_uid", "text").mapInArrow(trimming(run), "lo long, hi long, line_text string")


def _order_key(docs: DataFrame):
    whole = isinstance(docs.schema["doc_id"].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    return F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)) if whole else F.col("_uid")


def _late(docs: DataFrame, near: DataFrame, firsts: DataFrame, threshold: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """(lo, hi) of classes that a verified pair of near finds similar to an earlier one, and a table of the lines read for that (lo, hi, t)."""
    num, den = threshold
    near = materialize(near, "near")
    ends = materialize(near.select(F.col("a").alias("lo")).union(near.select(F.col("b").alias("lo"))).distinct(), "ends")
    wanted = materialize(among(firsts, "lo", ends, "lo"), "wanted")
    texts = _texts(docs, wanted.select("first.uid", "first.line")).groupBy("lo", "hi").agg(F.min("line_text").alias("t"))
    sets = materialize(texts.join(wanted, ["lo", "hi"]), "sets")
    side = lambda p: sets.select(F.col("lo").alias(p), *[F.col(c).alias(f"{c}_{p}") for c in ("hi", "t", "first")])
    both = near.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = np.zeros(batch.num_rows, dtype=bool)
            for k, (p, q) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                p, q = set(p.encode().split()), set(q.encode().split())  # the words' bytes: ASCII white space only
                common = len(p & q)
                same[k] = common * den >= (len(p) + len(q) - common) * num
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(same)) for c in batch.columns[2:]], names=batch.schema.names[2:])

    kept = ["a", "hi_a", "first_a", "b", "hi_b", "first_b"]
    links = both.select("t_a", "t_b", *kept).mapInArrow(trimming(run), ", ".join(f"{c} {both.schema[c].dataType.simpleString()}" for c in kept))
    later = F.when(F.col("first_a") < F.col("first_b"), F.struct(F.col("b").alias("lo"), F.col("hi_b").alias("hi"))).otherwise(F.struct(F.col("a").alias("lo"), F.col("hi_a").alias("hi")))
    return links.select(later.alias("c")).select("c.lo", "c.hi").distinct(), sets.select("lo", "hi", "t")


def _prefix_words(docs: DataFrame, classes: DataFrame, read: DataFrame, sketch: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """Bitmap of fixed size of the words that index the lines of classes (lo, uid, line), and of few others.

    read: a table of lines (lo, t); docs are gone through only for classes that it lacks.
    """
    lines = materialize(among(read, "lo", classes, "lo").select("lo", F.col("t").alias("line_text")), "lines")
    missing = materialize(classes.join(lines, "lo", "left_anti"), "missing")
    if not missing.isEmpty():
        lines = lines.union(materialize(_texts(docs, missing).join(missing, "lo", "left_semi").select("lo", "line_text"), "lines"))
    shared = docs.sparkSession.sparkContext.broadcast(sketch)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << WANTED_BITS, dtype=bool)
        for _, (h, *_) in _prefixes(batches, shared.value, threshold):
            bits[(h & np.uint64(len(bits) - 1)).astype(np.int64)] = True
        yield from slice_rows(np.packbits(bits).view(np.int64))

    rows = lines.select(F.lit(0).cast("long").alias("_uid"), F.lit(0).cast("long").alias("_by"), F.col("line_text").alias("text"))
    return fold_slices(rows.mapInArrow(trimming(run), "slice int, data binary"), np.bitwise_or, (1 << WANTED_BITS) // 64)


def line_classes(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, **limits) -> tuple[DataFrame, DataFrame]:
    """(lines, classes) of docs with _uid: every line with words, and every class with its first line and
    whether that stays. limits: see Meeting; they change the work and not the result."""
    docs = docs.withColumn("_by", _order_key(docs))
    sketch = word_sketch(docs)
    found = materialize(met(_entries(docs, sketch, threshold), Meeting(threshold, lines=False, **limits)), "met")
    lines = worded_lines(docs.select("_uid", "text")).select(F.col("_uid").alias("uid"), F.explode(F.col("worded").cast("array<long>")).alias("line"))
    firsts = found.where("kind = 3").select(F.col("a").alias("lo"), F.col("b").alias("hi"), F.struct("by", "uid", "line").alias("first"))
    late, read = _late(docs, found.where("kind = 0").select("a", "b").distinct(), firsts, threshold)
    late = materialize(late, "late")
    open_ = materialize(found.where("kind = 2").select(F.col("a").alias("lo")).distinct().join(late, "lo", "left_anti"), "marked")
    open_ = materialize(among(firsts, "lo", open_, "lo").select("lo", "first.uid", "first.line"), "open")
    if not open_.isEmpty():
        rest = Meeting(threshold, only=_unpacked(bitmap_of(open_.select("lo"))))
        more = met(_entries(docs, sketch, threshold, _prefix_words(docs, open_, read, sketch, threshold)), rest).where("kind = 0").select("a", "b").distinct()
        late = materialize(late.union(_late(docs, more, firsts, threshold)[0]).distinct(), "late")
    return lines, firsts.join(late.withColumn("late", F.lit(True)), ["lo", "hi"], "left").select("lo", "hi", "first", F.col("late").isNull().alias("first_stays"))


def worded_lines(docs: DataFrame) -> DataFrame:
    """docs with n_lines and worded, the numbers (from 0) of the lines with words, in place of text."""
    kept = [c for c in docs.columns if c != "text"]
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(len(kept))
            there = np.asarray(text.is_valid())
            data, offsets = text_bytes(text)
            for i, j in chunks(offsets):
                part, cut = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                at, row, number = line_starts(part, cut)
                letters = np.append(0, np.cumsum(letters_of(part), dtype=np.int64))[at]
                words = letters[1:] > letters[:-1]
                n = np.where(there[i:j], np.bincount(row, minlength=j - i), 0)
                ends = np.append(0, np.cumsum(np.bincount(row[words], minlength=j - i)))
                worded = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(number[words], pa.int32()))
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in b.columns[:-1]), pa.array(n), worded], names=[*kept, "n_lines", "worded"])

    return docs.select(*kept, "text").mapInArrow(trimming(run), ", ".join([*kinds, "n_lines long", "worded array<int>"]))


def told_lines(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """worded_lines of docs (with _uid) with removed_lines, the numbers of the lines that go.

    A line stays only as the first of a class that stays, so all others of a row's lines go.
    """
    classes = line_classes(docs.select("_uid", "doc_id", "text"), threshold)[1]
    stays = classes.where("first_stays").select(F.col("first.uid").alias("_uid"), F.col("first.line").alias("line")).groupBy("_uid").agg(F.collect_list("line").alias("stays"))
    goes = F.when(F.col("stays").isNull(), F.col("worded")).otherwise(F.array_except("worded", F.col("stays").cast("array<int>")))
    return worded_lines(docs).join(stays, "_uid", "left").withColumn("removed_lines", goes).drop("stays")


def removed_lines(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """_uid, n_removed and the numbers (from 0) of the lines that go, for rows with words."""
    told = told_lines(docs.select("_uid", "doc_id", "text"), threshold).where(F.size("worded") > 0)
    return told.select("_uid", F.size("removed_lines").cast("long").alias("n_removed"), "removed_lines")


def _mask(numbers):
    """A byte for each line up to the last of numbers: 1 for those among them, to be looked up by place."""

    # in the JVM: a second Python worker a task, and its pandas, would stay beside the first
    after = lambda s: lambda x, i: F.concat(F.repeat(F.lit("00"), x - F.coalesce(F.get(s, i - 1), F.lit(-1)) - 1), F.lit("01"))
    return F.transform(F.array(F.array_sort(numbers)), lambda s: F.unhex(F.array_join(F.transform(s, after(s)), "")))[0]


def dedup_lines(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """docs without later matching lines; rows of which no line with words is left go.

    n_chars, where docs has it, is counted anew.
    """
    docs, restore = shelve(docs, "doc_id", "text", "n_chars")
    docs = with_uid(docs)
    gone = removed_lines(docs.select("_uid", "doc_id", "text"), threshold).where("n_removed > 0").select("_uid", _mask(F.col("removed_lines")).alias("_gone"))
    joined = docs.join(gone, "_uid", "left")
    hit = F.col("_gone").isNotNull()
    parts = F.filter(F.split("text", "\n"), lambda x, i: F.substring("_gone", i + 1, F.lit(1)) != F.lit(b"\1"))
    joined = joined.withColumn("text", F.when(hit, F.array_join(parts, "\n")).otherwise(F.col("text")))
    joined = joined.where(~hit | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return restore(joined)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, removed_lines (from 0)."""
    docs = with_uid(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return told_lines(docs).select("doc_id", "n_lines", F.size("removed_lines").cast("long").alias("n_removed"), "removed_lines")
