"""Phrase collocation mining by hash-bucket counting: one pass over the texts for each length.

While a pass counts phrases of n words, it counts the next length's phrases
in BUCKETS buckets by hash (counts stop at the support, so a bucket is half a
byte). The next pass counts exactly only phrases whose bucket reached the
support and whose two parts of n - 1 words did: both are bitmaps of a fixed
size, which are broadcast. A bitmap only ever lets too much through (where
hashes meet, or where a huge corpus fills it), and the exact counts decide.
Longer phrases are put into buckets only if their shorter parts are frequent.

Tasks count phrases in NumPy by two 64-bit hashes, hold a bounded number of
different ones, and hand on a row for each with its text; Spark adds those up,
so a very common phrase costs few rows a task. Scores are exact: products are decimals of 38 digits.

Words: A-Z lower-cased, pieces end at .,;:!? and the bytes 0A to 0D, words at
spaces and tabs. All is counted for each lang.

Defined results: a null text is empty, a null lang is `und`; doc_ids are not
read, so repeated rows count again; a lang whose phrases all stay below the
support gives no rows, as an empty table does; other columns are not read.
Ranks have no ties: phrases of a lang differ.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.llm.common import chunks, discard, lean, materialize, mix64, text_bytes, trimming, word_hashes

SUPPORT = 10
LONGEST = 3
TOP = 2000
#: Percent of a phrase's count from which a longer phrase takes its place.
SHARE = 50
#: Buckets, and bits of a bitmap: a power of two from about an eighth of the texts' bytes, within these
#: bounds. A bucket is half a byte in a task (64 MB at most) and a bit when broadcast (16 MB at most).
BUCKETS = (1 << 20, 1 << 27)
SLICE = 1 << 20
#: Bytes of text of one chunk: a task takes some 60 times that while it looks at one.
CHUNK = 1 << 19
#: Phrases whose texts are made, or handed on, at once.
AT_ONCE = 1 << 16
#: Phrases that a task holds before it hands them on.
HELD = 1 << 20
#: Phrases, and their bytes, up to which a side of a join is broadcast.
FEW, FEW_BYTES = 1 << 18, 16 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_ENDS = np.zeros(256, bool)
_ENDS[[0x2E, 0x2C, 0x3B, 0x3A, 0x21, 0x3F, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LETTERS = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LETTERS[_ENDS] = 0
_LETTERS[[0x20, 0x09]] = 0
_OTHER = np.where(_LETTERS == 0, np.uint64(0), mix64(_LETTERS ^ np.uint64(0xD1B54A32D192ED03)))


class Words:
    """The words of a chunk of texts: bytes, places, two hashes, and which follow one another in a piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, number: np.ndarray, table: np.ndarray):
        self.data = _FOLD[data]
        self.h, self.start, self.end, row = word_hashes(self.data, offsets, _LETTERS)
        self.g = word_hashes(self.data, offsets, _OTHER)[0]
        self.kind = number[row]
        self.lang = table[self.kind] if len(row) else np.zeros(0, np.uint64)
        ends = np.zeros(len(self.data) + 1, np.int32)
        np.cumsum(_ENDS[self.data], out=ends[1:])
        if len(row):
            self.next = (row[1:] == row[:-1]) & (ends[self.start[1:]] == ends[self.end[:-1]])
        else:
            self.next = np.zeros(0, bool)

    def phrases(self, n: int) -> np.ndarray:
        """Number of the first word of each phrase of n words."""
        if len(self.h) < n:
            return np.zeros(0, np.int64)
        whole = np.ones(len(self.h) - n + 1, bool)
        for k in range(n - 1):
            whole &= self.next[k : k + len(whole)]
        return np.flatnonzero(whole)

    def key(self, h: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
        """Hash of lang and n words from each of the first ones."""
        key = mix64(self.lang[first] + np.uint64(n))
        for k in range(n):
            key = mix64(key + h[first + k])
        return key

    def texts(self, first: np.ndarray, n: int) -> pa.Array:
        """The phrases' words with one space between them."""
        if len(first) > AT_ONCE:  # places of all their bytes are eight times the texts
            return pa.concat_arrays([self.texts(first[k : k + AT_ONCE], n) for k in range(0, len(first), AT_ONCE)])
        word = (first[:, None] + np.arange(n)).reshape(-1)
        size = self.end[word] - self.start[word] + 1  # with a space after it
        to = np.concatenate([[0], np.cumsum(size)])
        from_ = np.repeat(self.start[word] - to[:-1], size) + np.arange(to[-1])
        out = self.data[np.minimum(from_, len(self.data) - 1)] if len(from_) else np.zeros(0, np.uint8)
        out[to[1:] - 1] = 32
        inner = np.ones(len(out), bool)
        inner[to[n::n] - 1] = False  # none after the last word
        bounds = to[::n] - np.arange(len(first) + 1)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out[inner])])


def _bit(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = key & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _hopeful(words: Words, n: int, parts: np.ndarray | None, buckets: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the phrases of n words whose parts and whose bucket may reach the support."""
    first = words.phrases(n)
    if parts is not None:
        shorter = words.phrases(n - 1)
        good = np.zeros(len(words.h) + 1, bool)
        good[shorter] = _bit(parts, words.key(words.h, shorter, n - 1))
        first = first[good[first] & good[first + 1]]
    key = words.key(words.h, first, n)
    if buckets is not None:
        keep = _bit(buckets, key)
        first, key = first[keep], key[keep]
    return first, key


def _langs(col: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(number of each row's lang, the langs, their hashes)."""
    coded = col.fill_null("und").dictionary_encode()
    kinds = coded.dictionary
    table = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in kinds.to_pylist()]
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), kinds, np.array(table, np.uint64)


class Gathered:
    """The different phrases of a task so far, HELD at most, with their counts and texts.

    Both hashes, lang, count and text are lists of pieces. They are merged a column
    at a time and stay in the order they came in, so that no two copies of all are held.
    """

    def __init__(self, n: int, held: int):
        self.n, self.held, self.size, self.merged = n, held, 0, 0
        self.langs: dict[str, int] = {}
        self.columns: tuple[list, ...] = ([], [], [], [], [])

    def add(self, words: Words, first: np.ndarray, key: np.ndarray, langs: list[str]) -> Iterator[pa.RecordBatch]:
        order, head, times = self._same(key, words.key(words.g, first, self.n), np.ones(len(first), np.int64))
        pick = first[order[head]]
        if not len(pick):
            return
        lang = np.array([self.langs.setdefault(x, len(self.langs)) for x in langs], np.int32)
        piece = key[order[head]], words.key(words.g, pick, self.n), lang[words.kind[pick]], times, words.texts(pick, self.n)
        for column, values in zip(self.columns, piece, strict=True):
            column.append(values)
        self.size += len(pick)
        if self.size > self.held:
            self._merge()
            if self.size > self.held // 2:
                yield from self.rows()

    @staticmethod
    def _same(key: np.ndarray, other: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, heads in it, counts). Phrases that share the key but not the second hash may have several heads."""
        order = np.argsort(key)
        k, o = key[order], other[order]
        fresh = np.ones(len(k), bool)
        fresh[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
        head = np.flatnonzero(fresh)
        return order, head, np.add.reduceat(f[order], head) if len(head) else f[:0]

    def _merge(self) -> None:
        key, other, lang, f, texts = self.columns
        if len(key) == 1 or self.merged == self.size:
            return
        for column in (key, other, f):
            column[:] = [np.concatenate(column)]
        share, found = (key[0] >> np.uint64(60)).astype(np.uint8), []
        for k in range(16):  # sorts of a sixteenth of the phrases each
            some = np.flatnonzero(share == k)
            order, head, times = self._same(key[0][some], other[0][some], f[0][some])
            found.append((some[order[head]], times))
        pick, times = (np.concatenate(x) for x in zip(*found, strict=True))
        back = np.argsort(pick)
        pick, f[:] = pick[back], [times[back]]
        del share, found, order, times, back
        for column in (key, other):
            column[:] = [column[0][pick]]
        lang[:] = [np.concatenate(lang)[pick]]
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        cut = np.searchsorted(pick, at)
        for k in range(len(texts)):
            texts[k] = texts[k].take(pa.array(pick[cut[k] : cut[k + 1]] - at[k]))
        texts[:] = [t for t in texts if len(t)]
        pa.default_memory_pool().release_unused()
        self.size = self.merged = len(pick)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            self._merge()
            _, _, (lang,), (f,), texts = self.columns
            self.columns, names = ([], [], [], [], []), pa.array(list(self.langs))
            texts = pa.chunked_array(texts)
            for k in range(0, len(f), AT_ONCE):
                phrases = texts.slice(k, AT_ONCE).combine_chunks().cast(pa.binary())
                yield _batch(names.take(pa.array(lang[k : k + AT_ONCE])), phrases, pa.array(f[k : k + AT_ONCE]))
        self.size = self.merged = 0


def _batch(lang: pa.Array, phrase: pa.Array, f: pa.Array, slices: list[int] | None = None, data: list[bytes] | None = None) -> pa.RecordBatch:
    rest = [pa.nulls(len(lang), pa.int32()), pa.nulls(len(lang), pa.binary())] if slices is None else [pa.array(slices, pa.int32()), pa.array(data, pa.binary())]
    return pa.RecordBatch.from_arrays([lang, phrase, f, *rest], names=["lang", "phrase", "f", "slice", "data"])


class Tally:
    """Counts of buckets that stop at the support: half a byte each, or a byte for a support beyond 15."""

    def __init__(self, size: int, support: int):
        self.size, self.support, self.half = size, support, support < 16 and size > 1
        self.data = np.zeros(size // 2 if self.half else size, np.uint8)

    def add(self, bucket: np.ndarray, times: np.ndarray) -> None:
        """Different buckets, and how often each was met."""
        if not self.half:
            self.data[bucket] = np.minimum(self.data[bucket] + times, self.support)
            return
        for odd in (0, 1):
            some = np.flatnonzero((bucket & 1) == odd)
            at, shift = bucket[some] >> 1, 4 * odd
            now = self.data[at]
            n = np.minimum((now >> shift & 15) + times[some], self.support).astype(np.uint8)
            self.data[at] = now & (15 << 4 - shift) | n << shift

    def slices(self, slice_: int) -> Iterator[tuple[int, bytes]]:
        """The slices that hold anything, a byte a bucket, compressed: most buckets are empty."""
        for k, cut in enumerate(self.data.reshape(self.size // slice_, -1)):
            if cut.any():
                yield k, pa.compress(np.stack([cut & 15, cut >> 4], 1).reshape(-1) if self.half else cut, "zstd", asbytes=True)


def _folded(slices: DataFrame, support: int, size: int, slice_: int) -> np.ndarray:
    """A bit for each bucket that reaches the support in all tasks together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                now = np.frombuffer(pa.decompress(data.as_buffer(), slice_, "zstd"), np.uint8)
                total[k] = np.minimum(total[k] + now, support).astype(np.uint8) if k in total else now
        bits = [np.packbits(v >= support, bitorder="little").tobytes() for v in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(bits, pa.binary())], names=["slice", "data"])

    out = np.zeros((size // slice_, slice_ // 8), np.uint8)
    for r in slices.repartition("slice").mapInArrow(trimming(run), "slice int, data binary").collect():  # size bits
        out[r["slice"]] = np.frombuffer(r["data"], np.uint8)
    return out.reshape(-1)


def counted(docs: DataFrame, n: int, parts: np.ndarray | None, buckets: np.ndarray | None, size: int, longest: int = LONGEST, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """A table of (lang, phrase, f) of the phrases of n words that parts and buckets let through, and of the next length's bucket slices."""
    sent = docs.sparkSession.sparkContext.broadcast((parts, buckets))
    slice_, chunk, held = min(SLICE, size), CHUNK, HELD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, buckets = sent.value
        tally = Tally(size, support) if n < longest else None
        gathered = Gathered(n, held)
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            number, langs, table = _langs(b.column(0))
            for i, j in chunks(offsets, chunk):
                words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], number[i:j], table)
                first, key = _hopeful(words, n, parts, buckets)
                yield from gathered.add(words, first, key, langs.to_pylist())
                if tally:
                    good = np.zeros(len(words.h) + 1, bool)
                    good[first] = True
                    ahead = words.phrases(n + 1)
                    ahead = ahead[good[ahead] & good[ahead + 1]]
                    at, times = np.unique((words.key(words.h, ahead, n + 1) & np.uint64(size - 1)).view(np.int64), return_counts=True)
                    tally.add(at, times)
        yield from gathered.rows()
        if tally:
            for k, data in tally.slices(slice_):
                yield _batch(pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), [k], [data])

    return materialize(docs.select("lang", "text").mapInArrow(trimming(run), "lang string, phrase binary, f long, slice int, data binary"), f"counts{n}")


def bitmap(frequent: DataFrame, n: int, size: int) -> np.ndarray:
    """The bits of the hashes of the given phrases of n words."""
    slice_, chunk = min(SLICE, size), CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(size, 1)
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            number, _, table = _langs(b.column(0))
            for i, j in chunks(offsets, chunk):
                words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], number[i:j], table)
                tally.add(*np.unique((words.key(words.h, words.phrases(n), n) & np.uint64(size - 1)).view(np.int64), return_counts=True))
        for k, data in tally.slices(slice_):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([data], pa.binary())], names=["slice", "data"])

    return _folded(frequent.select("lang", "phrase").mapInArrow(trimming(run), "slice int, data binary"), 1, size, slice_)


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, support: int = SUPPORT) -> tuple[list[DataFrame], DataFrame]:
    """Tables (lang, phrase, f) of the phrases of 1 to `longest` words with f >= support, and (lang, n) of all words."""
    if not 0 < support < 128:
        raise ValueError("a bucket counts in one byte: support must be from 1 to 127")
    lean(docs.sparkSession)
    tables, totals, parts, buckets = [], None, None, None
    long = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    size = min(max(1 << (long >> 3).bit_length(), BUCKETS[0]), BUCKETS[1])
    for n in range(1, longest + 1):
        both = counted(docs, n, parts, buckets, size, longest, support)
        found = both.where("slice IS NULL").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        found = found.select("lang", F.col("phrase").cast("string").alias("phrase"), "f")
        if n == 1:
            totals = materialize(both.where("slice IS NULL").groupBy("lang").agg(F.sum("f").alias("n")), "totals")
        tables.append(materialize(found.where(F.col("f") >= support), f"frequent{n}"))
        if n < longest:
            buckets = _folded(both.where("slice IS NOT NULL").select("slice", "data"), support, size, min(SLICE, size))
            parts = bitmap(tables[-1], n, size)
        discard(both)
    return tables, totals


def _with_count(rows: DataFrame, phrase: Column, table: DataFrame, name: str) -> DataFrame:
    """rows and the count of one phrase, which is in the table; a table proven small is broadcast."""
    size = table.agg(F.count("*").alias("n"), F.sum(F.octet_length("phrase")).alias("b")).first()
    side = table.select(F.col("lang").alias("_l"), F.col("phrase").alias("_p"), F.col("f").alias(name))
    side = F.broadcast(side) if size["n"] <= FEW and (size["b"] or 0) <= FEW_BYTES else side
    return rows.withColumn("_w", phrase).join(side, (F.col("lang") == F.col("_l")) & (F.col("_w") == F.col("_p"))).drop("_l", "_p", "_w")


def _words(k: int, n: int) -> Column:
    """n words of the column phrase from its k-th on (from 0)."""
    return F.array_join(F.slice(F.split("phrase", " "), k + 1, n), " ")


def collocations(docs: DataFrame, longest: int = LONGEST, support: int = SUPPORT, share: int = SHARE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of 2 to `longest` words of each lang.

    score: the least of floor(10**6 * a * a / (l * r)) over all cuts in two parts with counts l and r.
    A phrase inside a longer one that has at least `share` percent of its count is left out.
    """
    tables, totals = frequent_phrases(docs, longest, support)
    parts, wider = [], []
    for n in range(2, longest + 1):
        rows = tables[n - 1].withColumnRenamed("f", "a")
        for k in range(1, n):
            rows = _with_count(rows, _words(0, k), tables[k - 1], f"l{k}")
            rows = _with_count(rows, _words(k, n - k), tables[n - k - 1], f"r{k}")
        d = lambda c: f"cast({c} as decimal(38, 0))"
        score = lambda k: F.expr(f"(1000000 * {d('a')} * {d('a')}) div ({d(f'l{k}')} * {d(f'r{k}')})")
        cuts = F.array_min(F.array(*[F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, n)]))
        parts.append(rows.withColumn("cut", cuts).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
        inner = F.array(*[_words(k, m) for m in range(2, n) for k in range(n - m + 1)])
        if n > 2:
            wider.append(tables[n - 1].select("lang", F.explode(inner).alias("phrase"), "f"))
    found = parts[0]
    for more in parts[1:]:
        found = found.union(more)
    if wider:
        rows = wider[0]
        for more in wider[1:]:
            rows = rows.union(more)
        best = rows.groupBy("lang", "phrase").agg(F.max("f").alias("best"))
        found = found.join(best, ["lang", "phrase"], "left").where(F.col("best").isNull() | (100 * F.col("best") < share * F.col("a"))).drop("best")
    for salts in (256, 16, 1):  # the best of each share, of which the best are in the next: no task ranks all phrases of a lang
        by = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salts))).orderBy(F.desc("score"), F.desc("a"), "phrase")
        found = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    return found.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_GRAMS = "SELECT lang, phrase, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(w) - {m} + 1), lambda i: array_to_string(w[i:i + {m}], ' '))) AS phrase FROM words) GROUP BY ALL"
_SCORE = "CAST((1000000::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f) AS BIGINT)"
ORACLE = f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOW}, '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
g1 AS ({_GRAMS.format(m=0)}), g2 AS ({_GRAMS.format(m=1)}), g3 AS ({_GRAMS.format(m=2)}),
total AS (SELECT lang, sum(f) AS n FROM g1 GROUP BY lang),
c2 AS (SELECT *, string_split(phrase, ' ') AS w FROM g2 WHERE f >= 10), c3 AS (SELECT *, string_split(phrase, ' ') AS w FROM g3 WHERE f >= 10),
cut AS (
  SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, 1 AS k, {_SCORE} AS score FROM c2 c JOIN g1 x ON x.lang = c.lang AND x.phrase = c.w[1] JOIN g1 y ON y.lang = c.lang AND y.phrase = c.w[2]
  UNION ALL
  SELECT c.lang, c.phrase, c.f, x.f, y.f, 1, {_SCORE} FROM c3 c JOIN g1 x ON x.lang = c.lang AND x.phrase = c.w[1] JOIN g2 y ON y.lang = c.lang AND y.phrase = c.w[2] || ' ' || c.w[3]
  UNION ALL
  SELECT c.lang, c.phrase, c.f, x.f, y.f, 2, {_SCORE} FROM c3 c JOIN g2 x ON x.lang = c.lang AND x.phrase = c.w[1] || ' ' || c.w[2] JOIN g1 y ON y.lang = c.lang AND y.phrase = c.w[3]),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner2 AS (SELECT lang, p, max(f) AS f FROM (SELECT lang, w[1] || ' ' || w[2] AS p, f FROM c3 UNION ALL SELECT lang, w[2] || ' ' || w[3], f FROM c3) GROUP BY lang, p),
kept AS (SELECT b.* FROM best b LEFT JOIN inner2 i ON i.lang = b.lang AND i.p = b.phrase WHERE i.f IS NULL OR 100 * i.f < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, CAST(r.rank AS BIGINT) AS rank, r.phrase, CAST(r.a AS BIGINT) AS a, CAST(r.l AS BIGINT) AS l, CAST(r.r AS BIGINT) AS r, CAST(t.n AS BIGINT) AS n, r.score
FROM ranked r JOIN total t USING (lang) WHERE r.rank <= 2000
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
