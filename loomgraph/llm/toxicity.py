"""Toxicity by weak supervision.

1. Voters. Lexicon voters for toxic: words that toxic training rows hold and
   others hardly do; for not toxic: words of which the opposite holds, both
   mined from a bounded sample of labelled rows. Pattern voters: shouting,
   exclamation marks, symbol noise, repetition, very short texts. A text that
   holds no word of the toxic lexicon is a vote for not toxic.
2. A generative label model with a latent class explains the votes of all
   training rows: expectation maximisation estimates how often each voter
   speaks in each class, in rounds over the counted kinds of votes on the
   executors. Labels enter here alone, as rows of known class that weigh as
   much as all others together. Voters that agree beyond their classes are
   correlated, and their votes count less.
3. A linear classifier over words and patterns learns the posterior labels,
   which come from votes only (a row's own label is no part of them), on a
   bounded sample and scores every whole text.

Only rows whose crc32(doc_id as text) mod 5 is not 0 are learned from. Words
are runs of letters, ASCII case folded; they and the beginnings of longer ones
are known by 64-bit hashes.

Defined results: a null or empty text has the score of no evidence; where no
row is labelled toxic every score is 0, where all that are labelled are, 1; of
few toxic rows a word needs fewer to vote, and where none votes the patterns do; repeated rows get equal
scores; of words that tell equally much the one of smaller hash is taken; a
document with several labels is toxic if one says so; an empty table gives no
rows; very long texts are read whole; columns of any other name may be there
and to keep; labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import _BYTE, chunks, discard, fold_slices, lean, materialize, mix64, powers, slice_rows, text_bytes, trimming, word_hashes
from loomgraph.llm.langid import held_out

#: Bytes of the word beginnings that stand beside whole words.
BEGINNINGS = (4, 5, 6)
#: Expected labelled rows that voters are mined from, and with them rows of any kind that the classifier is fitted on.
LABELLED = 12_000
UNLABELLED = 6_000
#: Lexicon voters for toxic and for not toxic, words of the classifier, pattern voters.
VOTERS, CLEAN = 256, 64
WORDS = 1024
PATTERNS = 5
#: Toxic rows that hold a word of the lexicon, and other rows that hold a clean one; a fourth of such rows if they are few.
ENOUGH = (6, 20)
#: Rounds of expectation maximisation, and those after which correlations are estimated.
ROUNDS, CORRELATE = 10, (2, 6)
#: Sums of shares are added as whole numbers of this unit, so that their order doesn't matter.
UNIT = 1 << 16

_WORD = _BYTE.copy()
_WORD[:128] = 0
for _c in range(26):
    _WORD[97 + _c] = _BYTE[97 + _c]
    _WORD[65 + _c] = _BYTE[97 + _c]
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, dtype=bool)
_LOWER[97:123] = True
_NOISE = np.zeros(256, dtype=bool)
_NOISE[[ord(c) for c in "#$%&*@^~|<>"]] = True


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, number of words of each text) of all words and of the beginnings of longer ones."""
    h, start, end, row = word_hashes(data, offsets, _WORD)
    p, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_WORD[data] * p[:-1], out=sums[1:])
    hashes, rows = [h], [row]
    for n in BEGINNINGS:
        long = end - start > n
        a = start[long]
        hashes.append(mix64((sums[a + n] - sums[a]) * inverse[a] ^ np.uint64(n << 32)))
        rows.append(row[long])
    return np.concatenate(hashes), np.concatenate(rows), np.bincount(row, minlength=len(offsets) - 1)


def distinct(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.lexsort((h, row))
    h, row = h[key], row[key]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], row[new]


def patterns(data: np.ndarray, offsets: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Pattern votes of each text; words: its number of words."""
    n = np.diff(offsets)

    def total(mask: np.ndarray) -> np.ndarray:
        run = np.append(0, np.cumsum(mask))
        return run[offsets[1:]] - run[offsets[:-1]]

    up, low, loud, noise = (total(m) for m in (_UPPER[data], _LOWER[data], data == 33, _NOISE[data]))
    size = np.maximum(n, 1)
    return np.stack([up > 0.5 * np.maximum(up + low, 1), loud > 0.01 * size, noise > 0.05 * size, words * 20 < n, n < 40], 1)


def _sample(spark: SparkSession, docs: DataFrame, labels: DataFrame, labelled: int) -> DataFrame:
    """Training rows with a label: text and toxic, about `labelled` at most."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id"), 5, 0))
    n = known.count()
    part = known.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30)) < F.lit(min(1 << 30, (labelled << 30) // max(n, 1))))
    return docs.join(F.broadcast(part), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))  # bounded by labelled


def mined_words(sample: DataFrame) -> tuple[np.ndarray, int, int, float]:
    """(word hashes, how many of them vote for toxic, how many of the next for not toxic, share of toxic rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic = b.column(1).to_numpy()
            data, offsets = text_bytes(b.column(0))
            for i, j in chunks(offsets):
                h, row = distinct(*tokens_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[:2])
                u, at = np.unique(h, return_inverse=True)
                bad = np.bincount(at, toxic[i:j][row] == 1, minlength=len(u)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(bad), pa.array(np.bincount(at, minlength=len(u)) - bad)], names=["h", "bad", "good"])

    sizes = sample.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") != 1)).first()
    if not sizes[0] or not sizes[1]:
        return np.zeros(0, dtype=np.uint64), 0, 0, float(bool(sizes[0]))
    bad, good = (min(most, max(2, sizes[k] // 4)) for k, most in ((0, ENOUGH[0]), (1, ENOUGH[1])))
    counts = sample.mapInArrow(trimming(run), "h long, bad long, good long").groupBy("h").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (sizes[0] + 1)) - F.log((F.col("good") + 0.5) / (sizes[1] + 1))
    counts = materialize(counts.where(f"bad >= {bad} OR good >= {good}").withColumn("odds", odds).where(f"bad >= {bad} AND odds > 1.5 OR good >= {good} AND odds < -1"), "words")
    told = counts.where("odds > 0").withColumn("gain", F.col("odds") * F.sqrt(F.col("bad"))).orderBy(F.desc("gain"), "h").limit(WORDS - CLEAN).toPandas()
    clean = counts.where("odds < 0").withColumn("gain", F.col("odds") * F.sqrt(F.col("good"))).orderBy("gain", "h").limit(CLEAN).toPandas()
    sure = told["bad"] * sizes[1] > 20 * (told["good"] + 0.5) * sizes[0]
    sure &= sure.cumsum() <= VOTERS
    words = np.concatenate([told["h"][sure], clean["h"], told["h"][~sure]]).astype(np.int64)
    return words.view(np.uint64), int(sure.sum()), len(clean), sizes[0] / sum(sizes)


def _evidence(words: np.ndarray):
    """For a block of texts: (row, column) of its words and its pattern votes."""
    order = np.argsort(words)
    ranked = words[order]
    may = np.zeros(1 << 16, dtype=bool)
    may[(words & np.uint64(0xFFFF)).astype(np.int64)] = True

    def of(data: np.ndarray, offsets: np.ndarray):
        h, row, n = tokens_of(data, offsets)
        few = may[(h & np.uint64(0xFFFF)).astype(np.int64)]
        h, row = h[few], row[few]
        at = np.searchsorted(ranked, h)
        hit = at < len(ranked)
        hit[hit] = ranked[at[hit]] == h[hit]
        at, row = distinct(at[hit], row[hit])
        return row, order[at], patterns(data, offsets, n)

    return of


def votes(docs: DataFrame, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense evidence of a sample of (text, toxic), word columns, then patterns; and its labels."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _evidence(shared.value)
        for b in batches:
            data, offsets = text_bytes(b.column(0))
            for i, j in chunks(offsets):
                row, col, pattern = of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                cells: list[list[int]] = [[] for _ in range(j - i)]
                for r, c in zip(row.tolist(), col.tolist(), strict=True):
                    cells[r].append(c)
                for r, c in zip(*(v.tolist() for v in np.nonzero(pattern)), strict=True):
                    cells[r].append(len(shared.value) + c)
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.list_(pa.int32())), b.column(1).slice(i, j - i)], names=["cells", "toxic"])

    sample = docs.select("text", "toxic").mapInArrow(trimming(run), "cells array<int>, toxic int").toPandas()
    found = sample["cells"]
    x = np.zeros((len(found), len(words) + PATTERNS), dtype=np.float32)
    for i, cells in enumerate(found):
        x[i, np.asarray(cells, dtype=np.int64)] = 1
    return x, sample["toxic"].to_numpy(dtype=float, na_value=np.nan)


class Voters:
    """Which columns of evidence vote: the toxic lexicon, the clean words, the patterns, and silence of the lexicon."""

    def __init__(self, words: int, lexicon: int, clean: int):
        self.lexicon = lexicon
        self.columns = np.r_[np.arange(lexicon + clean), np.arange(words, words + PATTERNS)]
        self.n = len(self.columns) + 1

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x[:, self.columns], x[:, : self.lexicon].sum(1) == 0]).astype(np.float64)


def posterior(x: np.ndarray, p1: np.ndarray, p0: np.ndarray, prior: float, together: np.ndarray) -> np.ndarray:
    """Probability of toxic by votes. Of k voters that speak and agree by c on average the say counts as that of k / (1 + (k - 1) c)."""
    k = np.maximum(x.sum(1), 1)
    shared = 1 + ((x @ together) * x).sum(1) / k
    z = (x @ np.log(p1 / p0)) / shared + np.log(prior / (1 - prior))  # a voter that abstains says nothing
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def rates(hot: float, said1: np.ndarray, cold: float, said0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each voter speaks in either class, smoothed."""
    return np.clip((said1 + 0.5) / (hot + 1), 1e-5, 1 - 1e-3), np.clip((said0 + 0.05) / (cold + 1), 1e-6, 1 - 1e-3)


def agreement(moments: np.ndarray) -> np.ndarray:
    """Correlations of what classes leave unexplained, positive ones, from its second moments."""
    scale = np.sqrt(np.diag(moments)) + 1e-9
    together = np.clip(moments / np.outer(scale, scale), 0, 1)
    np.fill_diagonal(together, 0)
    return together


def _sums(kinds: DataFrame, n: int, model: tuple, moments: bool) -> tuple[float, np.ndarray, float, np.ndarray, np.ndarray]:
    """Over all rows of kinds (cells, times): weight and votes of either class under model, and residuals' second moments."""
    shared = kinds.sparkSession.sparkContext.broadcast(model)  # of fixed size
    size = 2 + 2 * n + (n * n if moments else 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p1, p0, prior, together = shared.value
        total = np.zeros(size)
        for b in batches:
            cells, times = b.column(0), b.column(1).to_numpy().astype(float)
            x = np.zeros((b.num_rows, n))
            flat = cells.flatten().to_numpy()
            x[np.repeat(np.arange(b.num_rows), np.diff(cells.offsets.to_numpy())), flat] = 1
            post = posterior(x, p1, p0, prior, together)
            hot, cold = post * times, (1 - post) * times
            total[: 2 + 2 * n] += np.concatenate([[hot.sum()], hot @ x, [cold.sum()], cold @ x])
            if moments:
                rest = x - np.outer(post, p1) - np.outer(1 - post, p0)
                total[2 + 2 * n :] += ((rest * times[:, None]).T @ rest).ravel()
        yield from slice_rows(np.round(total * UNIT).astype(np.int64))

    got = fold_slices(kinds.select("cells", "times").mapInArrow(trimming(run), "slice int, data binary"), np.add, size) / UNIT
    return got[0], got[1 : 1 + n], got[1 + n], got[2 + n : 2 + 2 * n], got[2 + 2 * n :].reshape(n, n) if moments else np.zeros((n, n))


def label_model(kinds: DataFrame, voters: int, known: np.ndarray, truth: np.ndarray, share: float, rounds: int = ROUNDS) -> tuple:
    """(p1, p0, prior, correlations) for `posterior`, by expectation maximisation.

    kinds: (cells, times), the voters that speak and how many rows have just these. known: dense
    votes of labelled rows and truth their classes; they weigh as much as all rows of kinds together,
    which keeps the classes where the labels put them.
    """
    hot, cold = float((truth == 1).sum()), float((truth != 1).sum())
    said1, said0 = known[truth == 1].sum(0), known[truth != 1].sum(0)
    p1, p0 = rates(hot, said1, cold, said0)
    together = np.zeros((voters, voters))
    for turn in range(rounds):
        h, s1, c, s0, moments = _sums(kinds, voters, (p1, p0, share, together), turn in CORRELATE)
        weight = min(1.0, len(truth) / max(h + c, 1e-9))
        p1, p0 = rates(hot + weight * h, said1 + weight * s1, cold + weight * c, said0 + weight * s0)
        if turn in CORRELATE:
            together = agreement(moments)
    return p1, p0, share, together


def fit_linear(x: np.ndarray, y: np.ndarray, rounds: int = 500, ridge: float = 3e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient descent."""
    w, b = np.zeros(x.shape[1], dtype=np.float32), 0.0
    v, c = w, b
    u = np.ones(x.shape[1], dtype=np.float32)
    for _ in range(20):  # the largest eigenvalue bounds the loss's curvature
        u = (x @ u + 1) @ x
        u /= np.linalg.norm(u) + 1e-9
    step = 4.0 / (1 + float(((x @ u) ** 2).mean()) * 1.1)
    for k in range(rounds):
        z = 1 / (1 + np.exp(-np.clip(x @ v + c, -30, 30)))
        g = ((z - y) / len(y)).astype(np.float32)
        new_w, new_b = v - np.float32(step) * (g @ x + np.float32(ridge) * v), c - step * float(g.sum())
        m = np.float32(k / (k + 3))
        v, c = new_w + m * (new_w - w), new_b + float(m) * (new_b - b)
        w, b = new_w, new_b
    return w.astype(np.float64), b


class Scorer:
    """Words, their weights and those of the patterns."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, bias: float):
        self.words, self.weights, self.bias = words, weights, bias

    def blocks(self):
        of, w = _evidence(self.words), self.weights

        def score(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
            row, col, pattern = of(data, offsets)
            z = np.bincount(row, w[col], minlength=len(offsets) - 1) + pattern @ w[len(self.words) :] + self.bias
            return 1 / (1 + np.exp(-np.clip(z, -700, 700)))

        return score


def _kinds(train: DataFrame, words: np.ndarray, voters: Voters) -> DataFrame:
    """(cells, times): the sets of voters that speak for training rows, counted before the shuffle and after it."""
    shared = train.sparkSession.sparkContext.broadcast((words, voters.columns, voters.lexicon))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, columns, lexicon = shared.value
        number = np.full(len(words) + PATTERNS, -1)
        number[columns] = np.arange(len(columns))
        of = _evidence(words)
        for b in batches:
            data, offsets = text_bytes(b.column(0))
            found: Counter[tuple[int, ...]] = Counter()
            for i, j in chunks(offsets):
                row, col, pattern = of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                cells: list[set[int]] = [{len(columns)} for _ in range(j - i)]
                for r, c in zip(row.tolist(), number[col].tolist(), strict=True):
                    if 0 <= c < lexicon:
                        cells[r].discard(len(columns))
                    if c >= 0:
                        cells[r].add(c)
                for r, c in zip(*(v.tolist() for v in np.nonzero(pattern)), strict=True):
                    cells[r].add(int(number[len(words) + c]))
                found.update(tuple(sorted(c)) for c in cells)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.list_(pa.int32())), pa.array(list(found.values()), pa.int64())], names=["cells", "times"])

    rows = train.select("text").mapInArrow(trimming(run), "cells array<int>, times long")
    return materialize(rows.groupBy("cells").agg(F.sum("times").alias("times")), "kinds")


def learn(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, unlabelled: int = UNLABELLED) -> Scorer | None:
    spark = docs.sparkSession
    train = docs.where(~held_out(F.col("doc_id"), 5, 0)).select("doc_id", "text")
    told = materialize(_sample(spark, train, labels, labelled), "labelled")
    words, lexicon, clean, share = mined_words(told)
    if share in (0.0, 1.0):
        return Scorer(words, np.zeros(PATTERNS), 700.0) if share else None
    voters = Voters(len(words), lexicon, clean)
    kinds = _kinds(train, words, voters)
    known, truth = votes(told, words)
    model = label_model(kinds, voters.n, voters.of(known), truth, share)
    n = kinds.agg(F.sum("times")).first()[0]
    part = min(1 << 30, (unlabelled << 30) // max(n, 1))
    more = train.where(F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(1 << 30)) < F.lit(part)).select("text", F.lit(None).cast("int").alias("toxic"))
    x = np.concatenate([known, votes(more, words)[0]])
    discard(told, kinds)
    return Scorer(words, *fit_linear(x, posterior(voters.of(x), *model)))


def scored(docs: DataFrame, model: Scorer | None, *keep: str) -> DataFrame:
    """The columns of keep, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WORDS weights
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "score double", "predicted int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.blocks() if shared.value else None
        for b in batches:
            out = np.zeros(b.num_rows)
            data, offsets = text_bytes(b.column(b.num_columns - 1))
            for i, j in chunks(offsets) if score else ():
                out[i:j] = score(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out), pa.array((out >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    return docs.select(*keep, "text").mapInArrow(trimming(run), schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    lean(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", held_out(F.col("doc_id"), 5, 0))
    return scored(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), "doc_id", "held_out")
