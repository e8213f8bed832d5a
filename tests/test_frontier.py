"""The frontier's replay, its stream with keyed state, and ranks by ranges."""

import random
import time

import pytest

from loomgraph.operators.frontier import Frontier
from loomgraph.operators.ranks import ranked
from loomgraph.streaming import frontier as S

LOG = "run string, seq long, kind string, id string, relevance double, domains array<string>"


def log(seed, n=120, runs=("r1", "r2", "r3")):
    r = random.Random(seed)
    return [(r.choice(runs), i, r.choice(["idea", "paper"]), f"k{r.randrange(25)}", r.choice([None, *(k / 11 for k in range(12))]), r.choice([None, [], [f"D{r.randrange(4)}"], [f"d{r.randrange(4)}", "x"]])) for i in range(n)]


def plain(rows, mode, every):
    out = []
    for run in {r[0] for r in rows}:
        queue, n = Frontier(mode), 0
        for _, _, kind, ident, relevance, domains in sorted((r for r in rows if r[0] == run), key=lambda r: r[1]):
            queue.push(kind, ident, relevance or 0.0, domains or [], "log")
            n += 1
            if n % every == 0 and (item := queue.pop()):
                out.append((run, n, item["kind"], item["id"], item["score"]))
    return sorted(out, key=str)


def pops(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed,mode,every", [(1, "depth", 1), (2, "breadth", 3), (3, "breadth", 7)])
def test_replay_equals_the_queue(spark, seed, mode, every):
    rows = log(seed, runs=("r1", "r2", None))
    assert pops(S.replay(spark.createDataFrame(rows, LOG), mode, every)) == plain(rows, mode, every)


def test_replay_of_nothing(spark):
    assert S.replay(spark.createDataFrame([], LOG), "depth").count() == 0


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, old)


def start(spark, where, name, wait=True, **how):
    from pyspark.sql.types import _parse_datatype_string

    read = spark.readStream.schema(_parse_datatype_string(LOG)).option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
    s = S.stream(read, **how).writeStream.outputMode("append").option("checkpointLocation", f"{where}/{name}")
    s = s.trigger(availableNow=True) if wait else s.trigger(processingTime="200 milliseconds")
    q = s.format("parquet").option("path", f"{where}/out-{name}").start()
    if wait:
        assert q.awaitTermination(60)
    return q


def put(spark, where, rows):
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"{where}/in")
    time.sleep(0.05)  # files are read by age


def test_stream_equals_replay_over_restarts(spark, rocks, tmp_path):
    rows = log(5)
    for k in range(4):  # each start goes on from the state that the last one left
        put(spark, tmp_path, rows[30 * k : 30 * k + 30])
        start(spark, tmp_path, "c", mode="breadth", pop_every=2)
    assert pops(spark.read.parquet(f"{tmp_path}/out-c")) == plain(rows, "breadth", 2)
    state = lambda v: spark.read.format("statestore").option("stateVarName", v).load(f"{tmp_path}/c")
    known, popped = len({r[:1] + r[2:4] for r in rows}), len(plain(rows, "breadth", 2))
    assert state("known").count() == known and state("slots").count() == known - popped


def test_a_push_writes_its_entry_only(spark, rocks, tmp_path):
    """Of a queue of 400 entries one more push changes the row of counts, an entry, and a path of the heap."""
    put(spark, tmp_path, [("r", i, "idea", f"k{i}", i / 400, ["d"]) for i in range(400)])
    start(spark, tmp_path, "c", mode="depth", pop_every=1000)
    put(spark, tmp_path, [("r", 400, "idea", "last", 2.0, ["d"])])
    q = start(spark, tmp_path, "c", mode="depth", pop_every=1000)
    updated = [p["stateOperators"][0]["numRowsUpdated"] for p in q.recentProgress if p["numInputRows"]]
    assert len(updated) == 1 and updated[0] <= 2 + 10


def test_an_idle_run_ends(spark, rocks, tmp_path):
    push = lambda seq: [("r", seq, "idea", "a", 0.5, [])]
    put(spark, tmp_path, push(0))
    q = start(spark, tmp_path, "timed", wait=False, mode="depth", idle_ms=1)
    told = lambda: [r["step"] for r in spark.read.schema(S.POPPED).parquet(f"{tmp_path}/out-timed").collect()]
    try:
        for n in (1, 2):
            until = time.time() + 40
            while sum(p["numInputRows"] for p in q.recentProgress) < n and time.time() < until:
                time.sleep(0.2)
            time.sleep(3)  # batches without data
            if n == 1:
                put(spark, tmp_path, push(1))
    finally:
        q.stop()
    assert told() == [1, 1]


def test_ranks_equal_a_window_and_no_range_is_the_whole(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "a", "a", "b", None, "c"]), r.randrange(10**9), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v long, i long")
    want, n = {}, {}
    for k, v, i in sorted(rows, key=lambda x: (x[1], x[2])):
        n[k] = n.get(k, 0) + 1
        want[i] = n[k]
    assert {x["i"]: x["rank"] for x in ranked(df, ["v", "i"], ["k"]).collect()} == want
    whole = {i: at + 1 for at, (_, _, i) in enumerate(sorted(rows, key=lambda x: (x[1], x[2])))}
    assert {x["i"]: x["rank"] for x in ranked(df, ["v", "i"]).collect()} == whole
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        seen = []
        from loomgraph.plans.tables import scratch

        write = scratch(spark)
        ranked(spark.range(200_000), ["id"], write=lambda df, name: seen.append(write(df, name)) or seen[-1]).count()
        sizes = [x["count"] for x in seen[0].groupBy("_range").count().collect()]
        assert sum(sizes) == 200_000 and max(sizes) < 2 * 200_000 / 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
