"""What the training-data operators share: shared-folder tables, byte-level
text helpers for Arrow batches, and connected components.

All text helpers work on UTF-8 bytes. Words are maximal runs of bytes that
are not ASCII white space; a null text counts as an empty one.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 18
_B = 0x9E3779B97F4A7C15 | 1


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def lean(spark: SparkSession) -> None:
    """Fewer rows an Arrow batch than Spark's default, which is too many whole texts at once.

    Only a default is changed: a session that sets its own keeps it.
    """
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, "1000")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which all executors share.

    Where the setting is absent a local folder is used, if all tasks run on
    this machine in the driver's process; otherwise that is an error.
    """
    lean(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not _one_process(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _local_base()
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/loomgraph-{uuid.uuid4().hex}"


def _one_process(spark: SparkSession) -> bool:
    """Whether all tasks run in the driver's process, as in tests."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


_LOCAL: list[str] = []


def _local_base() -> str:
    if not _LOCAL:
        folder = tempfile.mkdtemp(prefix="loomgraph-")
        atexit.register(shutil.rmtree, folder, True)
        _LOCAL.append("file://" + folder)
    return _LOCAL[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends there.

    Shuffles that led to it are of no more use; on a cluster a collection in the
    driver's JVM lets Spark delete their files now and not when it happens to collect.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    if not _one_process(spark):
        spark.sparkContext._jvm.System.gc()
    found = spark.read.schema(df.schema).parquet(path)
    found.table_path = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize that nothing reads any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.table_path.rpartition("/")[0])
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


#: Files of a table up to which their numbers are broadcast (some 10 MB).
MOST_FILES = 100_000


def with_uid(docs: DataFrame, name: str = "_uid") -> DataFrame:
    """Number the rows: the file's number, by path, and the row's place in it.

    The number of a row of a table scan doesn't depend on how the scan is
    split, so it is the same on every scan, on whatever executors. Of any other
    plan the numbered rows are written to the shared folder once and read there.
    """
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    files = sorted(docs.inputFiles()) if "Relation" in node.nodeName() and "Local" not in node.nodeName() else []
    if not 0 < len(files) <= MOST_FILES:
        return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    meta = F.col("_metadata")
    if len(files) == 1:
        return docs.withColumn(name, meta["row_index"])
    # the two lists write the slashes after the scheme in different numbers
    paths = "\n".join(re.sub("^([^:/]+):/+", r"\1:/", f) for f in files)  # URIs, which hold no line break
    # made in the JVM: a list of rows would start Python workers that then idle beside the others
    numbers = docs.sparkSession.range(0, 1, 1, 1).select(F.posexplode(F.split(F.lit(paths), "\n")).alias("_file", "_path")).withColumn("_file", F.col("_file").cast("long"))
    known = docs.select("*", F.regexp_replace(meta["file_path"], "^([^:/]+):/+", "$1:/").alias("_path"), meta["row_index"].alias("_place")).join(F.broadcast(numbers), "_path", "left")
    place = F.when(F.col("_file").isNull(), F.raise_error(F.lit("a file that the table did not list"))).otherwise(F.shiftleft("_file", 40) + F.col("_place"))
    return known.withColumn(name, place.cast("long")).drop("_path", "_place", "_file")


def trimming(run: Callable) -> Callable:
    """A function for mapInArrow that gives its memory back when its task ends: workers idle between stages."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return of


def shelve(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Rename the columns that an operator doesn't use, so that its working names can't clash with them.

    Returns the renamed docs and what puts names and order back.
    """
    names = {c: c if c in used else f"_kept{i}" for i, c in enumerate(docs.columns)}
    inner = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return inner, lambda df: df.select(*[F.col(n).alias(c) for c, n in names.items()])


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    n = len(col)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if n else raw[:0], offsets - offsets[0] if n else np.zeros(1, np.int64)


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes each; a longer text stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (wrapping arithmetic)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.where(_SPACE, np.uint64(0), _BYTE)
_POW: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if "p" not in _POW or len(_POW["p"]) < n:
        size = max(n, 1 << 16)
        inv = pow(_B, -1, 1 << 64)
        for key, base in (("p", _B), ("i", inv)):
            a = np.ones(size, dtype=np.uint64)
            done = 1
            while done < size:
                step = np.uint64(pow(base, done, 1 << 64))
                m = min(done, size - done)
                a[done : done + m] = a[:m] * step
                done += m
            _POW[key] = a
    return _POW["p"][:n], _POW["i"][:n]


def letters_of(data: np.ndarray, letters: np.ndarray = _LETTER) -> np.ndarray:
    """Whether each byte is part of a word, as an array that may be changed."""
    return np.frombuffer(bytearray(data.tobytes().translate((letters != 0).tobytes())), bool)


def word_hashes(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray = _LETTER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, row) of each word of the rows cut by offsets.

    letters: a value for each byte; 0 for those between words.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if not n:
        return np.zeros(0, np.uint64), none, none, none
    letter = letters_of(data, letters)
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    cut = offsets[(offsets > 0) & (offsets < n)]
    first[cut] = letter[cut]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), none, none, none
    last = letter
    last[:-1] &= ~letter[1:]
    last[cut - 1] = letters[data[cut - 1]] != 0
    ends = np.flatnonzero(last) + 1
    p, inv = powers(n)
    value = letters[data]
    value *= p
    h = np.add.reduceat(value, starts) * inv[starts]
    h = mix64(h ^ (ends - starts).astype(np.uint64))
    per_row = np.diff(np.searchsorted(starts, offsets))
    return h, starts, ends, np.repeat(np.arange(len(per_row)), per_row)


#: Fixed size of the set of key cells that near_keys broadcasts.
CELLS = 1 << 18


def near_keys(df: DataFrame, key: str, keys: DataFrame, name: str) -> DataFrame:
    """Rows of df whose key may be among keys.name: at most CELLS rows are broadcast, whatever keys' size."""
    cell = lambda c: F.pmod(F.xxhash64(c), F.lit(CELLS)).alias("_cell")
    cells = keys.select(cell(name)).distinct()
    return df.withColumn("_cell", cell(key)).join(F.broadcast(cells), "_cell", "left_semi").drop("_cell")


def among(df: DataFrame, key: str, keys: DataFrame, name: str) -> DataFrame:
    """Rows of df whose key is one of keys.name, a table: up to CELLS keys are broadcast whole; of more the cells are, and what they leave is shuffled."""
    one = keys.select(F.col(name).alias("_one"))
    if one.count() <= CELLS:
        return df.join(F.broadcast(one), F.col(key) == F.col("_one"), "left_semi")
    return near_keys(df, key, one, "_one").join(one, F.col(key) == F.col("_one"), "left_semi")


#: Cells of 8 bytes in one slice of a fixed-size array.
SLICE = 1 << 14


def slice_rows(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A fixed-size int64 array as (slice, data) rows, for fold_slices."""
    parts = [total[i : i + SLICE].tobytes() for i in range(0, len(total), SLICE)]
    yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "data"])


def fold_slices(rows: DataFrame, op: np.ufunc, size: int) -> np.ndarray:
    """Combine the tasks' fixed-size arrays, slice by slice, and fetch the one result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                now = np.frombuffer(data, dtype=np.int64)
                total[k] = op(total[k], now) if k in total else now
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["slice", "data"])

    found = rows.repartition("slice").mapInArrow(trimming(run), "slice int, data binary").collect()
    if not found:
        return np.zeros(size, dtype=np.int64)
    return np.concatenate([np.frombuffer(r["data"], dtype=np.int64) for r in sorted(found, key=lambda r: r["slice"])])


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, root): the smallest id reachable over undirected edges, for each end of one.

    Alternating large-star and small-star steps; each round writes its edges to
    the shared folder and ends when nothing changes. Hot ends are no problem:
    every step is a grouped minimum, combined before the shuffle, and a join.
    The rounds follow the logarithm of the ids; not to end within max_rounds is an error.
    """
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialize(now, "edges")
    state = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select("v", "m").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(before)
        new = now.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("x")).first()
        if state == new:
            break
        state = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).union(now.select(F.col("v").alias("id"), F.col("v").alias("root"))).distinct()
