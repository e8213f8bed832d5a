"""MinHash near-dedup by order min hashing.

A text is its sequence of five-word shingles, each labelled with its
occurrence number. A sketch holds, for each of `SKETCHES` hash functions, the
`DRAWN` shingles of smallest hash in the order in which the text has them, so
two texts share a value as their edit similarity allows. Texts that share a
value are candidates. A candidate pair is verified by banded alignment of its
labelled shingles: with m aligned of a and b, similarity m / (a + b - m). The
band is as wide as any alignment that reaches the threshold can need.

Equal texts form one class and are compared once. In a bucket of texts with a
common value each is compared with a leader, the one that shares most values
with others, which puts most of a group into one component. In a bucket that
still has several, the texts outside the largest are marked, and every pair of
two components of which one at least is marked is looked for by an exact
filter: prefixes of shingles in order of rarity, sizes, positions, and maps of
the shingles that bound how many of them a pair can share. So no pair of a
bucket is lost, whatever the leader matches, no bucket has a cap, and pairs
within a component are not made. Lists of the filter's index are dealt into
blocks of about `LIST` entries by counts known beforehand. Groups are connected
components of links; the smallest doc_id of each stays.

Defined results: texts without words are in no group and stay; texts of fewer
than five words are one shingle; null doc_ids come last; of equal doc_ids the
row that the table has first stays; repeated rows are copies, of which one
stays; an empty table gives no rows; other columns pass through, whatever their
names; very long texts are compared whole.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import CELLS, among, chunks, components, discard, fold_slices, materialize, mix64, shelve, slice_rows, text_bytes, trimming, with_uid, word_hashes
from loomgraph.llm.line_dedup import SKETCH_BITS, _order_key, rarity_order

WORDS = 5
DRAWN = 3
SKETCHES = 16
THRESHOLD = (4, 5)
#: Index entries of one shingle that a task compares with as many marked ones.
LIST = 4096
#: 64-bit words of the largest map of a text's shingles.
MAP_WORDS = 64
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
_C = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 3) & 0xFFFFFFFFFFFFFFFF | 1) for k in range(64)]
#: Multipliers of the hash functions: of no common factor, or the functions would order shingles alike.
_DRAW = mix64(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(labelled shingle hashes in text order, their row's bounds, word hashes' sum per row as two keys)."""
    n_rows = len(offsets) - 1
    h, _, _, row = word_hashes(data, offsets)
    words = np.bincount(row, minlength=n_rows)
    first = np.cumsum(words) - words
    keys = np.zeros((n_rows, 2), dtype=np.uint64)
    if not len(h):
        return h, np.zeros(n_rows + 1, np.int64), keys
    full = words > 0
    place = (np.arange(len(h)) - np.repeat(first, words)).astype(np.uint64)
    for k, c in enumerate((_C[40], _C[41])):
        keys[full, k] = np.add.reduceat(mix64(h + place * c), first[full])
    s = np.zeros(len(h), dtype=np.uint64)
    for k in range(min(WORDS, len(h))):
        s[: len(h) - k] += h[k:] * _C[k]
    # a row of w words has max(1, w - 4) shingles; a short row's takes only its own words
    count = np.where(words >= WORDS, words - WORDS + 1, (words > 0).astype(np.int64))
    short = np.flatnonzero((words > 0) & (words < WORDS))
    for r in short:
        s[first[r]] = sum((int(h[first[r] + k]) * int(_C[k]) for k in range(words[r])), int(words[r])) & 0xFFFFFFFFFFFFFFFF
    bounds = np.append(0, np.cumsum(count))
    at = np.repeat(first, count) + np.arange(bounds[-1]) - np.repeat(bounds[:-1], count)
    s = mix64(s[at])
    owner = np.repeat(np.arange(n_rows), count)
    if n_rows < 1 << 16:
        order = np.argsort((owner.astype(np.uint64) << np.uint64(48)) | (s >> np.uint64(16)), kind="stable")
    else:
        order = np.lexsort((s, owner))
    so, oo = s[order], owner[order]
    new = np.ones(len(so), dtype=bool)
    new[1:] = (so[1:] != so[:-1]) | (oo[1:] != oo[:-1])
    run = np.flatnonzero(new)
    times = np.arange(len(so)) - np.repeat(run, np.diff(np.append(run, len(so))))
    again = times > 0
    s[order[again]] = mix64(so[again] + times[again].astype(np.uint64) * _C[50])
    return s, bounds, keys


def order_sketches(s: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of SKETCHES values for each text with shingles."""
    size = np.diff(bounds)
    starts = bounds[:-1][size > 0]
    n = size[size > 0]
    out = np.empty((len(starts), SKETCHES), dtype=np.uint64)
    if not len(starts):
        return out
    for f in range(SKETCHES):
        x = s * _DRAW[f]
        x ^= x >> np.uint64(29)
        at = np.full((len(starts), DRAWN), np.iinfo(np.int64).max)
        for k in range(DRAWN):
            low = np.minimum.reduceat(x, starts)
            hit = np.flatnonzero(x == np.repeat(low, n))
            hit = hit[np.searchsorted(hit, starts)]
            ok = low != _MAX
            at[ok, k] = hit[ok]
            x[hit] = _MAX
        at.sort(axis=1)
        value = np.full(len(starts), f, dtype=np.uint64)
        for k in range(DRAWN):
            ok = at[:, k] < len(s)
            value[ok] = mix64(value[ok] * _C[60] + s[at[ok, k]])
        out[:, f] = value
    return out


def aligned(a: np.ndarray, b: np.ndarray, threshold: tuple[int, int] = THRESHOLD) -> int:
    """Most labelled shingles that a banded alignment of a and b can match (0 if below the threshold for sure)."""
    num, den = threshold
    need = -(-num * (len(a) + len(b)) // (num + den))
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(i) < need:
        return 0
    order = np.argsort(i)
    i, j = i[order], j[order]
    # an alignment with `need` matches never leaves this band
    near = np.abs(i - j) <= len(a) + len(b) - 2 * need
    j = j[near]
    if np.all(j[1:] > j[:-1]):
        return len(j)
    tails: list[int] = []  # longest increasing run of places: the labelled shingles are distinct
    for x in j.tolist():
        k = bisect_left(tails, x)
        tails[k : k + 1] = [x]
    return len(tails)


def _sketched(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_bytes(b.column(2))
            for i, j in chunks(offsets):
                s, bounds, keys = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                full = np.diff(bounds) > 0
                _, one = np.unique(keys[full][:, 0], return_index=True)  # equal texts of a batch: the sketch once
                rows = np.flatnonzero(full)
                lists: list = [None] * (j - i)
                cut = np.append(0, np.cumsum(np.diff(bounds)[rows[one]]))
                pick = np.repeat(bounds[rows[one]] - cut[:-1], np.diff(cut)) + np.arange(cut[-1])
                for r, v in zip(rows[one], order_sketches(s[pick], cut).view(np.int64), strict=True):
                    lists[r] = v
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(keys[:, 0].copy().view(np.int64)), pa.array(keys[:, 1].copy().view(np.int64)), pa.array(full), pa.array(lists, pa.list_(pa.int64()))],
                    names=["uid", "by", "lo", "hi", "full", "sketch"],
                )

    return docs.select("_uid", "_by", "text").mapInArrow(trimming(run), "uid long, by long, lo long, hi long, full boolean, sketch array<long>")


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the rows whose _uid is in the table ids."""
    return among(docs, "_uid", ids, "id").select(F.col("_uid").alias("id"), "text")


def _verify(docs: DataFrame, pairs: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(a, b, m, all): aligned and all shingles of each pair."""
    ends = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "ends")
    texts = materialize(_texts_of(docs, ends), "texts")
    both = pairs.select("a", "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("s")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("t")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (da, oa), (db, ob) = text_bytes(batch.column(2)), text_bytes(batch.column(3))
            m, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, j in chunks(oa + ob):
                x, xb, _ = shingles(da[oa[i] : oa[j]], oa[i : j + 1] - oa[i])
                y, yb, _ = shingles(db[ob[i] : ob[j]], ob[i : j + 1] - ob[i])
                for k in range(j - i):
                    p, q = x[xb[k] : xb[k + 1]], y[yb[k] : yb[k + 1]]
                    m[i + k] = aligned(p, q, threshold)
                    total[i + k] = len(p) + len(q) - m[i + k]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(m), pa.array(total)], names=["a", "b", "m", "all"])

    return both.select("a", "b", "s", "t").mapInArrow(trimming(run), "a long, b long, m long, all long")


def shingle_maps(s: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """For each text a map of its shingles: two bits a shingle or more, rounded up to a power of two, `MAP_WORDS` words at most."""
    n = np.diff(bounds)
    words = np.minimum(MAP_WORDS, 1 << np.ceil(np.log2(np.maximum(n, 32) / 32)).astype(np.int64))
    begin = np.append(0, np.cumsum(words))
    flat = np.zeros(begin[-1], dtype=np.uint64)
    bit = (s >> np.uint64(32)).astype(np.int64) & np.repeat(words * 64 - 1, n)
    np.bitwise_or.at(flat, np.repeat(begin[:-1], n) + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return [flat[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)]


class Lists:
    """Candidates among index entries that are sorted by list: pairs of a probe and a member of two components that may be near."""

    TESTS = 1 << 16

    def __init__(self, threshold: tuple[int, int]):
        self.num, self.den = threshold

    def _apart(self, maps: list[bytes], i: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many shingles i has that o has not, at least, and the other way round."""
        size = np.array([len(m) for m in maps]) // 8
        wide = int(size.max())
        whole = np.zeros((len(maps), wide), dtype=np.uint64)
        for k, m in enumerate(maps):
            whole[k, : size[k]] = np.frombuffer(m, np.uint64)
        only_i, only_o = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        common = np.minimum(size[i], size[o])
        for w in np.unique(common).tolist():  # a larger map is folded to the smaller one's size
            at = np.flatnonzero(common == w)
            folded = {}
            for k in np.unique(np.concatenate([i[at], o[at]])).tolist():
                folded[k] = np.bitwise_or.reduce(whole[k, : size[k]].reshape(-1, w), axis=0)
            names = np.array(sorted(folded))
            rows = np.stack([folded[k] for k in names.tolist()])
            x, y = rows[np.searchsorted(names, i[at])], rows[np.searchsorted(names, o[at])]
            only_i[at] = np.bitwise_count(x & ~y).sum(axis=1)
            only_o[at] = np.bitwise_count(y & ~x).sum(axis=1)
        return only_i, only_o

    def pairs(self, k, ids, w, z, role, maps: pa.Array) -> np.ndarray:
        n, place = z >> 24, z & 0xFFFFFF
        order = np.lexsort((role == 1, k))  # members of a list first
        start = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        members = np.add.reduceat((role >= 2).astype(np.int64), start)
        run = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(k))))
        probes = np.flatnonzero((role & 1) == 1)
        times = members[run[probes]]
        found, done = [], 0
        ends = np.cumsum(times)
        while done < len(probes):
            until = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + self.TESTS, side="right")))
            t = times[done:until]
            i = np.repeat(probes[done:until], t)
            o = order[start[run[i]] + np.arange(len(i)) - np.repeat(np.cumsum(t) - t, t)]
            done = until
            both = n[i] + n[o]
            need = -(-self.num * both // (self.num + self.den))
            fits = (w[i] >> 1 != w[o] >> 1) & ((w[o] & 1 == 0) | (ids[i] < ids[o]))  # two marked texts meet twice
            fits &= self.num * np.maximum(n[i], n[o]) <= self.den * np.minimum(n[i], n[o])
            fits &= np.minimum(n[i] - place[i], n[o] - place[o]) >= need  # holds at the first shingle that a near pair shares
            i, o, need = i[fits], o[fits], need[fits]
            if len(i):
                used, back = np.unique(np.concatenate([i, o]), return_inverse=True)
                only_i, only_o = self._apart(maps.take(pa.array(used)).to_pylist(), back[: len(i)], back[len(i) :])
                fits = (only_i <= n[i] - need) & (only_o <= n[o] - need)
                i, o = i[fits], o[fits]
                found.append(np.stack([np.minimum(ids[i], ids[o]), np.maximum(ids[i], ids[o])], 1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def told(last: bool) -> pa.RecordBatch:
            nonlocal held
            rows = pa.Table.from_batches(held).combine_chunks()
            k = rows.column(0).to_numpy()
            end = len(k) if last else int(np.searchsorted(k, k[-1]))
            now, held = rows.slice(0, end), rows.slice(end).to_batches()
            pair = self.pairs(k[:end], *(now.column(c).to_numpy() for c in range(1, 5)), now.column(5)) if end else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair[:, c])) for c in (0, 1)], names=["a", "b"])

        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= 2 * LIST:
                yield told(False)
        if held:
            yield told(True)


def _prefix_pairs(docs: DataFrame, ids: DataFrame, threshold: tuple[int, int], list_size: int = LIST) -> DataFrame:
    """Exact candidates (a, b) among ids (id, w: twice the component, plus 1 if marked)."""
    num, den = threshold
    texts = materialize(_texts_of(docs, ids.select("id")).join(ids, "id").select("id", "text", "w"), "rest")
    size = 1 << SKETCH_BITS
    mask = np.uint64(size - 1)
    spark = docs.sparkSession

    def blocks(batches: Iterator[pa.RecordBatch], rarity: np.ndarray | None):
        """(ids, w, shingles, bounds), and with rarity what indexes them: (owner, shingle, place)."""
        for b in batches:
            names, w = b.column(0).to_numpy(), b.column(2).to_numpy()
            data, offsets = text_bytes(b.column(1))
            for i, j in chunks(offsets):
                s, bounds, _ = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                index = None
                if rarity is not None:
                    n = np.diff(bounds)
                    owner = np.repeat(np.arange(j - i), n)
                    ordered = s[rarity_order(owner, rarity[(s & mask).astype(np.int64)], s)]
                    place = np.arange(len(s)) - bounds[owner]
                    pre = place < n[owner] - (-(-num * n[owner] // den)) + 1
                    index = owner[pre], ordered[pre], place[pre]
                yield names[i:j], w[i:j], s, bounds, index

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for _, _, s, _, _ in blocks(batches, None):
            total += np.bincount((s & mask).astype(np.int64), minlength=size)
        yield from slice_rows(total)

    rarity = fold_slices(texts.mapInArrow(trimming(count), "slice int, data binary"), np.add, size)
    rarities = spark.sparkContext.broadcast(rarity)  # of fixed size

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * size, dtype=np.int64)
        for _, w, _, _, (owner, s, _) in blocks(batches, rarities.value):
            cell = (s & mask).astype(np.int64)
            total[:size] += np.bincount(cell, minlength=size)
            total[size:] += np.bincount(cell[w[owner] & 1 == 1], minlength=size)
        yield from slice_rows(total)

    lists = spark.sparkContext.broadcast(fold_slices(texts.mapInArrow(trimming(lengths), "slice int, data binary"), np.add, 2 * size))  # of fixed size

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, w, s, bounds, (owner, key, place) in blocks(batches, rarities.value):
            cell = (key & mask).astype(np.int64)
            total, marked = lists.value[cell], lists.value[size + cell]
            meet = (total > 1) & (marked > 0)  # else there is no one to meet
            owner, key, place, total, marked = (v[meet] for v in (owner, key, place, total, marked))
            if not len(owner):
                continue
            member_blocks, probe_blocks = -(-total // list_size), -(-marked // list_size)
            mine = mix64(names.view(np.uint64) + np.uint64(1))[owner].astype(np.uint64)
            probe = w[owner] & 1
            alone = (member_blocks == 1) & (probe_blocks == 1)
            parts = [(np.flatnonzero(alone), 2 + probe[alone], np.zeros(int(alone.sum()), np.uint64))]
            for role, at, copies, own, other in (
                (2, np.flatnonzero(~alone), probe_blocks, member_blocks, 0),
                (1, np.flatnonzero(~alone & (probe == 1)), member_blocks, probe_blocks, 1),
            ):
                t = copies[at]
                e = np.repeat(at, t)
                every = (np.arange(len(e)) - np.repeat(np.cumsum(t) - t, t)).astype(np.uint64)
                home = mine[e] % own[e].astype(np.uint64)
                member, probing = (home, every) if not other else (every, home)
                parts.append((e, np.full(len(e), role), (member << np.uint64(32)) + probing + np.uint64(1)))
            e, role, block = (np.concatenate([p[c] for p in parts]) for c in range(3))
            listed = mix64(key[e] ^ block * np.uint64(0x9E3779B97F4A7C15))
            maps = pa.array(shingle_maps(s, bounds), pa.binary())
            n = np.diff(bounds)[owner[e]]
            cols = [listed.view(np.int64), names[owner[e]], w[owner[e]], (n << 24) | place[e], role.astype(np.int8)]
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c)) for c in cols), maps.take(pa.array(owner[e]))], names=["k", "id", "w", "z", "role", "map"])

    rows = texts.mapInArrow(trimming(entries), "k long, id long, w long, z long, role byte, map binary")
    found = rows.repartition("k").sortWithinPartitions("k").mapInArrow(trimming(Lists(threshold)), "a long, b long").distinct()
    found = materialize(found, "near")
    discard(texts)
    return found


def _told(docs: DataFrame, pairs: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(a, b, same) of pairs, as a table."""
    num, den = threshold
    pairs = materialize(pairs.select("a", "b"), "pairs")
    return materialize(_verify(docs, pairs, threshold).select("a", "b", (F.col("m") * den >= F.col("all") * num).alias("same")), "told")


def near_groups(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, led: bool = True, list_size: int = LIST) -> DataFrame:
    """(_uid, keep_uid, class_size) of every row of docs with _uid. Where doc_id is no whole number, the first row of a group stays, by _uid.

    led: compare with leaders first; without, the exact filter alone finds the same groups with more work.
    """
    docs = docs.select("_uid", "doc_id", "text").withColumn("_by", _order_key(docs))
    rows = materialize(_sketched(docs), "sketched")
    classes = rows.where("full").groupBy("lo", "hi").agg(F.min(F.struct("by", "uid")).alias("first"), F.count("*").alias("n"), F.max("sketch").alias("sketch"))
    classes = materialize(classes.select("lo", "hi", F.col("first.uid").alias("id"), F.col("first.by").alias("by"), "n", "sketch"), "classes")
    drawn = classes.select("id", "by", F.explode("sketch").alias("v"))
    # what is joined with hot values is a table by then, so that Spark can split those values
    shared = materialize(drawn.groupBy("v").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    drawn = materialize(drawn.join(F.broadcast(shared) if shared.count() <= CELLS else shared, "v"), "buckets")
    discard(shared)
    known = docs.sparkSession.createDataFrame([], "a long, b long, same boolean")
    if led:
        rank = drawn.groupBy("id").agg(F.sum("n").alias("rank"))
        ranked = materialize(drawn.select("v", "id", "by").join(rank, "id"), "ranked")
        leaders = ranked.groupBy("v").agg(F.max(F.struct("rank", (-F.col("by")).alias("by"), (-F.col("id")).alias("id"))).alias("top"))
        leaders = materialize(leaders.select("v", (-F.col("top.id")).alias("b")), "leaders")
        first = ranked.join(leaders, "v").where("id <> b")
        known = _told(docs, first.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct(), threshold)
        discard(ranked, leaders)
    links = known.where("same").select("a", "b")
    roots = components(links)
    held = materialize(drawn.select("v", "id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "held")
    discard(drawn)
    # pairs of one component need no more, nor do buckets of two, which the leader has settled
    parts = held.groupBy("v", "root").agg(F.count("*").alias("n"))
    open_ = parts.groupBy("v").agg(F.max(F.struct("n", "root")).alias("most"), F.count("*").alias("roots"), F.sum("n").alias("n"))
    open_ = materialize(open_.where(f"roots > 1 AND n > {2 if led else 1}").select("v", F.col("most.root").alias("most")), "open")
    ids = held.join(open_, "v").groupBy("id", "root").agg(F.max((F.col("root") != F.col("most")).cast("int")).alias("marked"))
    ids = materialize(ids.select("id", (F.col("root") * 2 + F.col("marked")).alias("w")), "ids")
    discard(held, open_)
    if not ids.isEmpty():
        near = _prefix_pairs(docs, ids, threshold, list_size)
        told = _told(docs, near.join(known, ["a", "b"], "left_anti"), threshold)
        discard(near)
        links = links.union(told.where("same").select("a", "b"))
        roots = components(links)
    grouped = materialize(classes.select("lo", "hi", "id", "by", "n").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "grouped")
    keep = grouped.groupBy("root").agg(F.min(F.struct("by", "id")).alias("keep"), F.sum("n").alias("class_size"))
    groups = materialize(grouped.join(keep, "root").select("lo", "hi", F.col("keep.id").alias("keep_uid"), "class_size"), "groups")
    discard(classes, grouped, ids)
    one = rows.where("full").select("uid", "lo", "hi").join(groups, ["lo", "hi"]).select(F.col("uid").alias("_uid"), "keep_uid", "class_size")
    return one.union(rows.where("NOT full").select("uid", "uid", F.lit(1)))


def dedup_near(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """docs with one row of each near-duplicate group."""
    docs, restore = shelve(docs, "doc_id", "text")
    docs = with_uid(docs)
    gone = near_groups(docs, threshold).where("_uid <> keep_uid").select("_uid")
    return restore(docs.join(gone, "_uid", "left_anti"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, class_id (the doc_id that stays), class_size, kept."""
    docs = with_uid(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    names = docs.select("_uid", "doc_id")
    told = materialize(near_groups(docs).join(names, "_uid"), "told")
    keep = told.where("_uid = keep_uid").select("keep_uid", F.col("doc_id").alias("class_id"))
    return told.join(keep, "keep_uid").select("doc_id", "class_id", "class_size", (F.col("_uid") == F.col("keep_uid")).alias("kept"))
