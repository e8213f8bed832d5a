"""Language ID by prediction by partial matching.

Per language a variable-order byte context tree (escape method C with
exclusion) is learned from counts of byte strings up to order + 1 and then
frozen. The language whose model gives a text the shortest code wins; the
score is its share of 2**-bits over all languages.

Counts come from executors, summed by Spark, from a bounded sample of
labelled rows: `per_lang` expected rows and `LANG_BYTES` expected bytes of each
language at most, whole texts chosen by a hash of the identifier. The trees are
pruned to `MODEL_BYTES`: contexts of order 0 and 1 always stay, of longer ones
the most frequent whose suffix stays; a pruned context codes as its suffix.
With frozen statistics the distribution after a context is
fixed, so each context seen in training becomes one row of a table
(context x next byte x language) of code lengths, and a text is scored by
looking up its bytes, exactly as the trees would code it. ASCII letters are
folded to lower case; bytes never seen in training share one symbol.

Defined results: `und` with score 0 if the text is null or has no letter, or
where nothing could be learned; very long texts are scored whole, in blocks;
repeated rows get equal predictions; of languages with equally short codes the
first by name is taken; an empty table gives no rows; columns to keep may have
any names; lang, source and doc_id are never inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import chunks, lean, text_bytes, trimming

ORDER = 3
#: Expected labelled rows of each language that the statistics are learned from.
PER_LANG = 400
LANG_BYTES = 4 << 20
#: Bytes of the table of code lengths, which is broadcast.
MODEL_BYTES = 128 << 20
UNKNOWN = "und"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BLOCK = 1 << 18


def held_out(doc_id, parts: int, held: int):
    """Whether crc32(doc_id as text) falls into the held-out remainder; a null id does not."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == held, F.lit(False))


def _padded(data: np.ndarray, offsets: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes with `pad` spaces before each text, and where each text begins."""
    n = np.diff(offsets)
    begins = offsets[:-1] + pad * np.arange(1, len(n) + 1)
    out = np.full(len(data) + pad * len(n), 32, dtype=np.uint8)
    out[np.arange(len(data)) + np.repeat(begins - offsets[:-1], n)] = _FOLD[data]
    return out, begins


def context_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n): how often each string of order + 1 folded bytes ends at a byte of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column(0).to_pylist()
            data, offsets = text_bytes(b.column(1))
            for i, j in chunks(offsets):
                part, begins = _padded(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], order)
                n = np.diff(offsets[i : j + 1])
                for lang in set(langs[i:j]):
                    pick = np.array([x == lang for x in langs[i:j]])
                    at = np.repeat(begins[pick], n[pick]) + _ramp(n[pick])
                    gram = np.zeros(len(at), dtype=np.int64)
                    for k in range(order, -1, -1):
                        gram = (gram << 8) | part[at - k]
                    keys, counts = np.unique(gram, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])

    return docs.select("lang", "text").mapInArrow(trimming(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _ramp(n: np.ndarray) -> np.ndarray:
    """0 .. n[0] - 1, 0 .. n[1] - 1, ..."""
    total = int(n.sum())
    return np.arange(total) - np.repeat(np.cumsum(n) - n, n)


class Model:
    """Frozen context trees of all languages as one table of code lengths in bits."""

    def __init__(self, langs: list[str], grams: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER, limit: int = MODEL_BYTES):
        self.langs, self.order = langs, order
        bytes_of = {k: [(g >> (8 * (order - i))) & 255 for i in range(order + 1)] for k, (g, _) in grams.items()}
        seen = np.zeros(256, dtype=bool)
        for cols in bytes_of.values():
            for c in cols:
                seen[c] = True
        self.symbol = np.zeros(256, dtype=np.int64)  # 0: never seen
        self.symbol[seen] = np.arange(1, seen.sum() + 1)
        size = self.size = int(seen.sum()) + 1
        # contexts of every order that any language has seen, as numbers in base `size`
        self.contexts: list[np.ndarray] = [np.zeros(1, dtype=np.int64)]
        codes = {k: [self.symbol[c] for c in cols] for k, cols in bytes_of.items()}
        left = limit // (4 * size * max(len(langs), 1)) - 1  # contexts that the table has room for
        for k in range(1, order + 1):
            keys = [self._code(c[order - k : order]) for c in codes.values()]
            found, at = np.unique(np.concatenate(keys), return_inverse=True) if keys else (np.zeros(0, np.int64),) * 2
            if k > 1 and len(found):
                often = np.bincount(at, np.concatenate([grams[lang][1] for lang in codes]), minlength=len(found))
                often[~np.isin(found % size ** (k - 1), self.contexts[k - 1])] = 0
                ranked = np.lexsort((found, -often))[: max(left, 0)]
                found = np.sort(found[ranked[often[ranked] > 0]])
            left -= len(found)
            self.contexts.append(found)
        self.first = np.cumsum([0] + [len(c) for c in self.contexts])
        # an unseen context stands for its longest seen suffix
        states = np.zeros(1, dtype=np.int32)
        for k in range(1, order + 1):
            states = np.tile(states, size)
            states[self.contexts[k]] = self.first[k] + np.arange(len(self.contexts[k]))
        self.states = states
        table = np.empty((self.first[-1], size, len(langs)), dtype=np.float32)
        for i, lang in enumerate(langs):
            table[:, :, i] = -np.log2(self._tree(codes[lang], grams[lang][1]))
        self.table = table.reshape(int(self.first[-1]) * size, len(langs))

    def _code(self, symbols: list[np.ndarray]) -> np.ndarray:
        return reduce(lambda a, s: a * self.size + s, symbols, np.zeros_like(symbols[0]) if symbols else np.zeros(1, np.int64))

    def _tree(self, codes: list[np.ndarray], counts: np.ndarray) -> np.ndarray:
        """P(symbol | context) of one language for every context, lowest order first."""
        size, order = self.size, self.order
        out = np.empty((self.first[-1], size))
        uniform = np.full(size, 1.0 / size)
        for k in range(order + 1):
            ctx = self._code(codes[order - k : order]) if k else np.zeros(len(counts), np.int64)
            here = np.isin(ctx, self.contexts[k])
            row = np.searchsorted(self.contexts[k], ctx[here])
            n = np.zeros((len(self.contexts[k]), size))
            np.add.at(n, (row, codes[order][here]), counts[here])
            if k:
                suffix = self.contexts[k] % size ** (k - 1)  # every suffix of a context here is here
                lower = out[self.first[k - 1] + np.searchsorted(self.contexts[k - 1], suffix)]
            else:
                lower = uniform[None, :]
            total, kinds = n.sum(1, keepdims=True), (n > 0).sum(1, keepdims=True)
            rest = np.where(n > 0, 0.0, lower)
            share = rest.sum(1, keepdims=True)
            escape = np.where(share > 0, kinds / np.maximum(total + kinds, 1), 0.0)
            seen = n / np.maximum(total + np.where(share > 0, kinds, 0), 1)
            p = np.where(n > 0, seen, escape * rest / np.where(share > 0, share, 1))
            out[self.first[k] : self.first[k + 1]] = np.where(total > 0, p, lower)
        return out

    def bits(self, data: np.ndarray, offsets: np.ndarray, skip: int = 0) -> np.ndarray:
        """Code length of each text under each language; its first `skip` bytes are context alone."""
        n = np.diff(offsets)
        out = np.zeros((len(n), len(self.langs)))
        part, begins = _padded(data, offsets, self.order)
        sym = self.symbol[part]
        state = np.zeros(len(sym), dtype=np.int64)
        for k in range(self.order, 0, -1):
            state[self.order :] = state[self.order :] * self.size + sym[self.order - k : len(sym) - k]
        row = self.states[state] * np.int64(self.size) + sym
        full = n > skip
        if full.any():
            # sums run from each text's begin to the next text's padding
            edges = np.stack([begins[full] + skip, begins[full] + n[full]], 1).ravel()
            edges = edges[:-1] if edges[-1] == len(row) else edges
            for i in range(len(self.langs)):
                out[full, i] = np.add.reduceat(self.table[row, i].astype(np.float64), edges)[::2]
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """bits(), a block of a very long text at a time; a block begins with the bytes that its first contexts need."""
        if len(data) <= 4 * _BLOCK:
            return self.bits(data, offsets)
        assert len(offsets) == 2
        cut = np.append(np.arange(0, len(data), _BLOCK), len(data))
        lead = [min(int(a), self.order) for a in cut]
        return sum(self.bits(data[a - k : b], np.array([0, b - a + k]), k) for a, b, k in zip(cut, cut[1:], lead, strict=False))


def learn(docs: DataFrame, per_lang: int = PER_LANG, order: int = ORDER) -> Model:
    """Fit on a bounded sample of the rows that have a lang."""
    lean(docs.sparkSession)
    labelled = docs.where("lang IS NOT NULL")
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).collect()
    share = {r["lang"]: min(1 << 30, -(-per_lang * (1 << 30) // r["n"]), -(-LANG_BYTES * (1 << 30) // max(r["bytes"], 1))) for r in sizes}
    spread = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 30))
    limit = F.create_map(*[F.lit(x) for pair in sorted(share.items()) for x in pair]) if share else None
    if limit is None:
        return Model([], {}, order)
    found = context_counts(labelled.where(spread < limit[F.col("lang")]), order).toPandas()
    grams = {k: (g["gram"].to_numpy(), g["n"].to_numpy(dtype=float)) for k, g in found.groupby("lang")}
    return Model(sorted(grams), grams, order)


def predict(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns of keep, lang_pred and score of every row."""
    lean(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MODEL_BYTES
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "lang_pred string", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            text = b.column(b.num_columns - 1)
            data, offsets = text_bytes(text)
            letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            best = np.zeros(b.num_rows, dtype=np.int64)
            score = np.zeros(b.num_rows)
            if m.langs:
                for i, j in chunks(offsets, _BLOCK):
                    bits = m.score(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    best[i:j] = bits.argmin(1)
                    score[i:j] = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
            known = letters & bool(m.langs)
            lang = np.where(known, np.array([*m.langs, UNKNOWN], dtype=object)[best], UNKNOWN)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(np.where(known, score, 0.0))], names=[*keep, "lang_pred", "score"])

    return docs.select(*keep, "text").mapInArrow(trimming(run), schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", held_out(F.col("doc_id"), 4, 2))
    return predict(docs, learn(docs.where("NOT held_out")), "doc_id", "held_out")
