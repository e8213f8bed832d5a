"""Benchmark decontamination: suffix arrays of the training texts, searched with every test suffix.

Each task cuts its documents into shards of some hundred thousand words and
sorts the shard's word suffixes (prefix doubling). All suffixes of the test
items then narrow their ranges of that array in step, one word a step, by
binary search. A range that is left after a whole window holds all places of
that window; the range left last holds the longest verbatim match. Words that
no test item has end a match like a text's end does, so suffixes that begin
with one are not sorted.

A window is WINDOW words in a row of an item; an item of fewer words is one
window. Words are maximal runs of ASCII letters (A-Z lower-cased), digits and
non-ASCII characters, told by 64-bit hashes of their bytes. Test items are cut
into pieces of PIECE words and dealt into blocks of some BLOCK words; each
block is broadcast and meets all documents in one pass that shuffles nothing.
Only with several blocks are their findings for a row, and nothing else, joined.

Defined results: null and empty texts have no words and no hits; repeated rows
and repeated or null doc_ids are rows of their own; test items that share an
item_id are one item; a null item_id is written as an empty string; an empty
benchmark hits nothing; of no documents there are no rows. Other columns are
kept as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import _BYTE, chunks, lean, materialize, shelve, text_bytes, trimming, with_uid, word_hashes

WINDOW = 10
#: Words of a piece of an item, of a block of test items (8 bytes each), bytes of a shard.
PIECE = 4096
BLOCK = 1 << 20
SHARD_BYTES = 1 << 20

LETTERS = np.zeros(256, np.uint64)
for _a, _b in ((48, 58), (97, 123), (128, 256)):
    LETTERS[_a:_b] = _BYTE[_a:_b]
LETTERS[65:91] = _BYTE[97:123]

SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
FOUND = "n_words long, spans array<struct<start:long,end:long>>, items array<string>, longest long"


def texts_in_shards(data: np.ndarray, offsets: np.ndarray, overlap: int, limit: int = SHARD_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """(first row, end row, hashes, rows, index of the first word) of each shard.

    A longer text is cut between words; each later part begins with `overlap` words of the one before.
    """
    for i, j in chunks(offsets, limit):
        if j - i > 1 or offsets[j] - offsets[i] <= 2 * limit:
            h, _, _, row = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], LETTERS)
            yield i, j, h, row, 0
            continue
        at, end, done, tail = int(offsets[i]), int(offsets[j]), 0, np.zeros(0, np.uint64)
        while at < end:
            cut = min(at + limit, end)
            while cut < end and LETTERS[data[cut]]:  # to the end of a word
                step = data[cut : cut + limit]
                gap = np.flatnonzero(LETTERS[step] == 0)
                cut += int(gap[0]) if len(gap) else len(step)
            h = word_hashes(data[at:cut], np.array([0, cut - at]), LETTERS)[0]
            both = np.concatenate([tail, h])
            yield i, j, both, np.zeros(len(both), np.int64), done - len(tail)
            done, tail, at = done + len(h), both[max(0, len(both) - overlap) :], cut


class Suffixes:
    """The test side of one block: words by rank, all suffixes that begin a window, items by window."""

    def __init__(self, pieces: list[tuple[str, bytes]], window: int = WINDOW):
        words = [np.frombuffer(b, np.uint64) for _, b in pieces]
        self.vocabulary = np.unique(np.concatenate([*words, np.zeros(0, np.uint64)]))
        self.items = sorted({i for i, _ in pieces})
        number = {s: k for k, s in enumerate(self.items)}
        sizes = np.array([len(w) for w in words], np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
        self.words = np.zeros(int(bounds[-1]) + window, np.int32)  # rank of a word from 1, 0 between pieces
        for at, w in zip(bounds, words, strict=False):
            self.words[at : at + len(w)] = np.searchsorted(self.vocabulary, w) + 1
        width = np.minimum(sizes, window)
        starts = [np.arange(at, at + n - k + 1) for at, n, k in zip(bounds, sizes, width, strict=False) if n]
        self.starts = np.concatenate([*starts, np.zeros(0, np.int64)]).astype(np.int64)
        per = (sizes - width + 1) * (sizes > 0)
        self.widths = np.repeat(width, per)
        self.left = np.repeat(bounds[1:] - 1, per) - self.starts
        grid = self.words[self.starts[:, None] + np.arange(window)]
        grid[np.arange(window) >= self.widths[:, None]] = 0
        _, self.kind = np.unique(grid, axis=0, return_inverse=True) if len(grid) else (None, np.zeros(0, np.int64))
        self.kind = self.kind.reshape(-1)
        pairs = np.unique(np.stack([self.kind, np.repeat([number[i] for i, _ in pieces], per).astype(np.int64)]), axis=1) if len(grid) else np.zeros((2, 0), np.int64)
        self.item, self.item_at = pairs[1], np.searchsorted(pairs[0], np.arange(self.kind.max(initial=-1) + 2))
        self.longest = int(self.left.max(initial=0))

    def items_of(self, kinds: np.ndarray) -> list[str]:
        found = np.unique(np.concatenate([self.item[self.item_at[k] : self.item_at[k + 1]] for k in kinds]))
        return [self.items[k] for k in found]


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Places of the words that are not 0, sorted by the next `depth` words up to a 0: prefix doubling."""
    at = np.flatnonzero(words).astype(np.int64)
    n = len(at)
    bits = max(1, int(n).bit_length())
    if 3 * bits > 64:
        raise ValueError("a shard of too many words")
    rank = np.zeros(len(words) + 1, np.int64)
    _, first = np.unique(words[at], return_inverse=True)
    rank[at] = first.reshape(-1) + 1
    order, step, kinds = np.argsort(rank[at], kind="stable"), 1, int(rank.max(initial=0))
    while step < depth and kinds < n:
        key = (rank[at] << (2 * bits)) | (rank[np.minimum(at + step, len(words))] << bits) | np.arange(n)
        key = np.sort(key.view(np.uint64))
        order = (key & np.uint64((1 << bits) - 1)).astype(np.int64)
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[1], np.cumsum((key[1:] >> np.uint64(bits)) != (key[:-1] >> np.uint64(bits))) + 1])
        rank[at] = new
        if new[order[-1]] == kinds:
            break
        kinds, step = int(new[order[-1]]), 2 * step
    return at[order]


def _border(words: np.ndarray, array: np.ndarray, lo: np.ndarray, hi: np.ndarray, step: int, want: np.ndarray, after: bool) -> np.ndarray:
    """In each range of the array the first place whose word at `step` is not below (after: is above) the wanted one."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        w = words[np.where(open_, array[np.minimum(mid, len(array) - 1)], 0) + step]
        right = open_ & ((w <= want) if after else (w < want))
        lo = np.where(right, mid + 1, lo)
        hi = np.where(open_ & ~right, mid, hi)
    return lo


def search(words: np.ndarray, array: np.ndarray, test: Suffixes) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int]]]:
    """(kind, width, lo, hi) of the windows that occur; (length, lo, hi) of the longest matches of a window at least."""
    padded = np.concatenate([words, np.zeros(test.longest + 1, words.dtype)])
    live = np.arange(len(test.starts))
    lo, hi = np.zeros(len(live), np.int64), np.full(len(live), len(array), np.int64)
    windows, matches = [], []
    for step in range(test.longest + 1):
        whole = test.left[live] <= step  # nothing left of the suffix
        ended = [(step, a, b) for a, b in zip(lo[whole], hi[whole], strict=True)] if step else []
        live, lo, hi = live[~whole], lo[~whole], hi[~whole]
        want = test.words[test.starts[live] + step]
        a = _border(padded, array, lo, hi, step, want, False)
        b = _border(padded, array, a, hi, step, want, True)
        lost = (a >= b) & (step >= test.widths[live])
        ended += [(step, x, y) for x, y in zip(lo[lost], hi[lost], strict=True)]
        matches += sorted(set(ended))
        found = a < b
        live, lo, hi = live[found], a[found], b[found]
        full = test.widths[live] == step + 1
        if full.any():
            kinds, pick = np.unique(test.kind[live[full]], return_index=True)
            windows += zip(kinds.tolist(), [step + 1] * len(kinds), lo[full][pick].tolist(), hi[full][pick].tolist(), strict=True)
        if not len(live):
            break
    return windows, matches


def spans_of(covered: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def joined(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Spans in order, those that touch or overlap made one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


class Finds:
    """What the shards of a batch have found for each row."""

    def __init__(self, rows: int):
        self.n_words = np.zeros(rows, np.int64)
        self.longest = np.zeros(rows, np.int64)
        self.spans: list[list[tuple[int, int]]] = [[] for _ in range(rows)]
        self.kinds: list[set[int]] = [set() for _ in range(rows)]

    def shard(self, test: Suffixes, i: int, j: int, hashes: np.ndarray, rows: np.ndarray, base: int) -> None:
        counts = np.bincount(rows, minlength=j - i)
        self.n_words[i:j] = base + counts
        if not len(hashes) or not len(test.vocabulary):
            return
        place = np.searchsorted(test.vocabulary, hashes)
        known = test.vocabulary[np.minimum(place, len(test.vocabulary) - 1)] == hashes
        words = np.zeros(len(hashes) + (j - i) + 1, np.int64)
        words[np.arange(len(hashes)) + rows] = np.where(known, place + 1, 0)  # a 0 after each text
        array = suffix_array(words, test.longest)
        if not len(array):
            return
        windows, matches = search(words, array, test)
        if not windows:
            return
        at = np.concatenate([[0], np.cumsum(counts + 1)])  # where each text begins
        edge = np.zeros(len(words) + 1, np.int64)
        pairs = []
        for kind, width, lo, hi in windows:
            places = array[lo:hi]
            edge[places] += 1  # places of one range are different
            edge[places + width] -= 1
            pairs += [(r, kind) for r in np.unique(np.searchsorted(at, places, side="right") - 1).tolist()]
        covered = np.cumsum(edge)[:-1] > 0
        for r, kind in pairs:
            self.kinds[i + r].add(kind)
        for r in sorted({r for r, _ in pairs}):
            self.spans[i + r] += [(base + a, base + b) for a, b in spans_of(covered[at[r] : at[r] + counts[r]])]
        for length, lo, hi in matches:
            np.maximum.at(self.longest, i + np.searchsorted(at, array[lo:hi], side="right") - 1, length)

    def columns(self, test: Suffixes) -> list[pa.Array]:
        told: dict[tuple[int, ...], list[str]] = {(): []}
        spans, items = [], []
        for s, k in zip(self.spans, self.kinds, strict=True):
            spans.append([{"start": x, "end": y} for x, y in joined(s)])
            key = tuple(sorted(k))
            if key not in told:
                told[key] = test.items_of(np.array(key))
            items.append(told[key])
        return [pa.array(self.n_words), pa.array(spans, SPANS), pa.array(items, pa.list_(pa.string())), pa.array(self.longest)]


def item_pieces(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, words) of all pieces of the items that have words; pieces share window - 1 words."""
    size, limit = PIECE, SHARD_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            whole: list[list[np.ndarray]] = [[] for _ in range(b.num_rows)]
            for i, j, h, row, _ in texts_in_shards(data, offsets, 0, limit):
                for r, part in enumerate(np.split(h, np.searchsorted(row, np.arange(1, j - i)))):
                    whole[i + r].append(part)
            items, pieces = [], []
            for item, parts in zip(b.column(0).to_pylist(), whole, strict=True):
                h = np.concatenate(parts)
                for at in range(0, max(len(h) - window + 1, min(len(h), 1)), size):
                    items.append(item)
                    pieces.append(h[at : at + size + window - 1].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(pieces, pa.binary())], names=["item", "words"])

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return rows.mapInArrow(trimming(run), "item string, words binary").distinct()


def _pass(docs: DataFrame, test: Suffixes, window: int) -> DataFrame:
    """One pass over docs with one block: their columns and FOUND."""
    sent = docs.sparkSession.sparkContext.broadcast(test)
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(FOUND).fields])
    where, limit = docs.columns.index("text"), SHARD_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = sent.value
        for b in batches:
            data, offsets = text_bytes(b.column(where))
            finds = Finds(b.num_rows)
            for shard in texts_in_shards(data, offsets, max(window, min(test.longest, limit >> 4)) - 1, limit):
                finds.shard(test, *shard)
            yield pa.RecordBatch.from_arrays([*b.columns, *finds.columns(test)], names=schema.names)

    return docs.mapInArrow(trimming(run), schema)


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Docs (with a column text) and n_words, spans of hit words, items with windows in the text, words of the longest match.

    Of a text above SHARD_BYTES the longest match is told within its parts. Docs' other
    columns must have other names; decontaminate takes any.
    """
    lean(docs.sparkSession)
    pieces = materialize(item_pieces(benchmark, window), "pieces")
    total = pieces.agg(F.sum(F.length("words"))).first()[0] or 0
    blocks = max(1, -(-total // (8 * block)))
    mine = pieces.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks)))
    tests = lambda k: Suffixes([(r["item"], bytes(r["words"])) for r in mine.where(F.col("block") == k).select("item", "words").collect()], window)  # noqa: E731  one block of a bounded size
    if blocks == 1:
        return _pass(docs, tests(0), window)
    rows = materialize(with_uid(docs), "rows")
    found = None
    for k in range(blocks):
        some = materialize(_pass(rows.select("_uid", "text"), tests(k), window).drop("text").where(F.lit(k == 0) | (F.size("spans") > 0)), "found")
        found = some if found is None else found.union(some)
    one = found.groupBy("_uid").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("longest").alias("longest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[{"start": x, "end": y} for x, y in joined([(s["start"], s["end"]) for s in row])] for row in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(spans, SPANS) if k == 2 else c for k, c in enumerate(b.columns)], names=b.schema.names)

    return rows.join(one.mapInArrow(trimming(run), one.schema), "_uid").drop("_uid")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Docs without those that hold a window of a test item."""
    inner, restore = shelve(docs, "text")
    return restore(find_leaks(inner, benchmark, window).where(F.size("spans") == 0))


ORACLE = """
WITH d AS (SELECT doc_id, row_number() OVER () AS u, text FROM documents),
low AS (SELECT u, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM d),
item AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
wide AS (SELECT item, w, least(10, len(w)) AS k FROM item WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM wide),
place AS (SELECT u, k, unnest(range(1, len(w) - k + 2)) AS p, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM low, (SELECT DISTINCT k FROM win)),
hit AS (SELECT place.u, place.p, place.k, win.item FROM place JOIN win ON place.k = win.k AND place.s = win.s),
words AS (SELECT u, count(DISTINCT q) AS n FROM (SELECT u, unnest(range(p, p + k)) AS q FROM hit) GROUP BY u),
items AS (SELECT u, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT u, item FROM hit) GROUP BY u)
SELECT low.doc_id, CAST(len(low.w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items.s, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM low LEFT JOIN words USING (u) LEFT JOIN items USING (u)
"""


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
