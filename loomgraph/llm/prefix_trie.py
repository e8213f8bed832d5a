"""Conversation prefix trie, family first.

Conversation c belongs to the family of its base, c - c % 100, and begins with
the base's first turns. The family's conversations are cogrouped with the
heads of their base, rebuilt, and merged into a small trie; only the nodes of
these tries, with their few members, are shuffled and merged over all families.

Nothing is collected that grows. Turns are sorted by ranges of (conv_id, turn,
role, text), so a conversation that holds a third of all turns is spread over many
tasks: each numbers and sums its own stretch, and what came before a stretch
is added from a table with a row for each stretch that goes on. A family is
cogrouped in slabs of SLAB turns of its conversations (200 ids at most).
Sequences of turns are told by length and two 64-bit polynomial hashes of
their turns' hashes, which add up over stretches.

No step follows the trie level by level. A member of a node counts in every
node on its way, so sums over a subtree are sums over members: a conversation
c owns the nodes of which it is the smallest member, which is its path from
one depth on, and brings to each node above the lengths of its turns between
that node and the first that it owns.

The ids that end at a node are hashed in one stream in ascending order, a row
for each family, without being held.

Defined results: null roles and texts are empty; turns of a conversation go by
turn (null first), then role, then text, and repeated rows are turns of their
own; rows without a conv_id belong to no conversation and are
left out; an empty table gives no nodes, not even a root; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import discard, materialize, trimming

FAMILY = 100
#: Turns of a base that its family may begin with are fewer than this.
HEADS = 6
SLAB = 1024
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))

STRETCH = "conv_id long, part int, pos long, h long, g long, h0 long, g0 long, size long, total long"
NODES = "depth long, h long, g long, h0 long, g0 long, size long, ends string, ids array<long>, rests array<long>"
KEY = ["depth", "h", "g"]


def head_length(conv: int) -> int:
    """How many first turns of its base a conversation takes."""
    return zlib.crc32(str(conv).encode()) % HEADS


def _power(base: np.uint64, n: np.ndarray) -> np.ndarray:
    """base ** n modulo 2**64, by squaring."""
    out, square, n = np.ones(len(n), np.uint64), base, n.astype(np.int64).copy()
    while n.any():
        out = np.where(n & 1, out * square, out)
        square, n = np.uint64(int(square) ** 2 % (1 << 64)), n >> 1
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _in_stretch(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Running sums (wrapping) that begin anew where `first` is set."""
    sums = np.cumsum(values, dtype=values.dtype)
    at = np.flatnonzero(first)
    before = sums[at] - values[at]
    return sums - np.repeat(before, np.diff(np.append(at, len(values))))


def stretches(turns: DataFrame) -> DataFrame:
    """STRETCH rows of all turns: place in the conversation from 0, hashes and characters of all turns up to it, and hashes before it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    role = F.coalesce(F.col("role"), F.lit(""))
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", F.asc_nulls_first("turn"), "role"]
    ranged = rows.repartitionByRange(parts, *order, F.left("text", F.lit(64))).sortWithinPartitions(*order, "text")  # ranges are sampled: no whole texts
    sorted_ = ranged.select("conv_id", F.xxhash64("role", "text").alias("x"), F.xxhash64(F.lit(1), "text", "role").alias("y"), F.length("text").cast("long").alias("size"), F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, done, sums = None, 0, (np.uint64(0), np.uint64(0), 0)  # of the stretch that the last batch ended in
        for b in batches:
            if not b.num_rows:
                continue
            ids, size = b.column(0).to_numpy(), b.column(3).to_numpy()
            first = np.ones(len(ids), bool)
            first[1:] = ids[1:] != ids[:-1]
            goes_on = ids[0] == conv
            lead = np.cumsum(first) == 1 if goes_on else np.zeros(len(ids), bool)
            pos = _in_stretch(first, np.ones(len(ids), np.int64)) - 1 + np.where(lead, done, 0)
            out = [b.column(0), b.column(4), pa.array(pos)]
            now, before = [], []
            for k, base in enumerate(_BASES):
                term = (b.column(1 + k).to_numpy().view(np.uint64) | np.uint64(1)) * _power(base, pos)
                upto = _in_stretch(first, term) + np.where(lead, sums[k], np.uint64(0))
                now.append(upto)
                before.append(upto - term)
            total = _in_stretch(first, size) + np.where(lead, sums[2], 0)
            out += [pa.array(_signed(v)) for v in (*now, *before)] + [b.column(3), pa.array(total)]
            conv, done, sums = ids[-1], int(pos[-1]) + 1, (now[0][-1], now[1][-1], int(total[-1]))
            yield pa.RecordBatch.from_arrays(out, names=[c.split()[0] for c in STRETCH.split(", ")])

    local = materialize(sorted_.mapInArrow(trimming(run), STRETCH), "stretches")
    return materialize(_carried(local), "turns")


def _carried(local: DataFrame) -> DataFrame:
    """Adds what came before to stretches that go on from an earlier part. Of such there is one a part at most."""
    ends = local.groupBy("conv_id", "part").agg(F.max(F.struct("pos", "h", "g", "total")).alias("e"))
    several = ends.groupBy("conv_id").agg(F.count("*").alias("k")).where("k > 1").select("conv_id")
    cut = sorted((r["conv_id"], r["part"], *r["e"]) for r in ends.join(several, "conv_id").collect())  # two rows a part at most
    carry, sums = {}, None
    for conv, part, pos, h, g, total in cut:
        if sums is None or sums[0] != conv:
            sums = [conv, 0, 0, 0, 0]
        else:
            carry[part] = sums
        lift = [int(_power(b, np.array([sums[1]]))[0]) for b in _BASES]
        wrap = lambda x: (x + (1 << 63)) % (1 << 64) - (1 << 63)
        sums = [conv, sums[1] + pos + 1, wrap(sums[2] + lift[0] * h), wrap(sums[3] + lift[1] * g), sums[4] + total]
    if not carry:
        return local
    sent = local.sparkSession.sparkContext.broadcast(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = {c: b.column(c).to_numpy(zero_copy_only=False).copy() for c in b.schema.names}
            for part in np.unique(t["part"]).tolist():
                if part in sent.value:
                    conv, n, h, g, total = sent.value[part]
                    mine = (t["conv_id"] == conv) & (t["part"] == part)
                    for k, c in enumerate(("h", "g", "h0", "g0")):
                        lift = _power(_BASES[k % 2], np.array([n]))[0]
                        t[c][mine] = _signed(t[c][mine].view(np.uint64) * lift + np.uint64((h, g)[k % 2] % (1 << 64)))
                    t["pos"][mine] += n
                    t["total"][mine] += total
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in t.values()], names=b.schema.names)

    return local.mapInArrow(trimming(run), STRETCH)


def _rebuilt(own: pd.DataFrame, heads: pd.DataFrame) -> np.ndarray:
    """The nodes on the way of each conversation of a slab of a family: depth, h, g, h0, g0, size, conv_id, rest, whether it ends there."""
    base = heads[heads["is_base"]]
    b = {c: np.asarray(base.iloc[0][c], np.int64) if len(base) else np.zeros(0, np.int64) for c in ("first_h", "first_g", "first_size", "first_total")}
    b_before = {c: np.concatenate([[0], b[f"first_{c}"]]).astype(np.int64) for c in ("h", "g", "total")}  # of the first k turns
    places = own.groupby("conv_id", sort=False).indices if len(own) else {}
    columns = {c: own[c].to_numpy() for c in own.columns} if len(own) else {}
    out = [np.zeros((9, 0), np.int64)]
    for conv, slab, n, total, fh, fg, ft in heads[["conv_id", "slab", "n", "total", "first_h", "first_g", "first_total"]].itertuples(index=False, name=None):
        h = head_length(conv)
        k = min(h, len(b["first_h"]))
        gone = min(h, n)  # own turns that the base's stand for
        lost = int(ft[gone - 1]) if gone else 0
        full, length = int(b_before["total"][k]) + total - lost, k + n - gone
        if slab == 0:
            depth = np.arange(k + 1)
            size = np.concatenate([[0], b["first_size"][:k]])
            before = [np.concatenate([[0], b_before[c][:k]]) for c in ("h", "g")]
            out.append(np.stack([depth, b_before["h"][: k + 1], b_before["g"][: k + 1], *before, size, np.full(k + 1, conv), full - b_before["total"][: k + 1] + size, depth == length]))
        if conv not in places:
            continue
        at = places[conv]
        at = at[columns["pos"][at] >= h]
        pos, size = columns["pos"][at], columns["size"][at]
        row = [pos + 1 + k - h]
        for c, i, own_first in (("h", 0, fh), ("g", 1, fg), ("h0", 0, fh), ("g0", 1, fg)):
            taken = np.uint64(int(own_first[h - 1]) % (1 << 64)) if h and len(at) else np.uint64(0)
            lift = np.uint64(pow(int(_BASES[i]), k - h, 1 << 64))  # turns move up where the base has fewer
            row.append(_signed((columns[c][at].view(np.uint64) - taken) * lift + np.uint64(int(b_before[c[0]][k]) % (1 << 64))))
        rest = total - columns["total"][at] + size
        out.append(np.stack([*row, size, np.full(len(at), conv), rest, pos == n - 1]))
    return np.concatenate(out, axis=1)


def _small_trie(key: tuple, own: pd.DataFrame, heads: pd.DataFrame) -> pd.DataFrame:
    """The nodes of a slab of one family, each with its members."""
    rows = _rebuilt(own, heads)
    rows = rows[:, np.lexsort((rows[6], rows[2], rows[1], rows[0]))]
    first = np.ones(rows.shape[1], bool)
    first[1:] = (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)
    head = np.flatnonzero(first)
    groups = np.split(np.arange(rows.shape[1]), head[1:]) if len(head) else []
    found = pd.DataFrame(rows[:6, head].T, columns=["depth", "h", "g", "h0", "g0", "size"])
    found["ends"] = [",".join(map(str, rows[6, x[rows[8, x] == 1]].tolist())) or None for x in groups]
    found["ids"] = [rows[6, x] for x in groups]
    found["rests"] = [rows[7, x] for x in groups]
    found.insert(0, "family", int(key[0]))
    return found


def families(turns: DataFrame) -> DataFrame:
    """(family, NODES): the small tries of all families, from stretches."""
    family = (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("family")
    slab = lambda c: F.floor(F.col(c) / SLAB).cast("long")
    own = turns.select(family, slab("pos").alias("slab"), "conv_id", "pos", "h", "g", "h0", "g0", "size", "total")
    few = F.when(F.col("pos") < HEADS - 1, F.struct("pos", "h", "g", "size", "total"))
    again = turns.sparkSession.read.schema(turns.schema).parquet(turns.table_path)  # columns of its own for the cogroup
    heads = again.groupBy("conv_id").agg(F.count("*").alias("n"), F.max(F.struct("pos", "total"))["total"].alias("total"), F.array_sort(F.collect_list(few)).alias("first"))
    heads = heads.select(family, "conv_id", "n", "total", *[F.col("first")[c].alias(f"first_{c}") for c in ("h", "g", "size", "total")]).withColumn("is_base", F.col("conv_id") == F.col("family"))
    # a conversation is asked for in each slab that it reaches, a base in all slabs of its family
    most = heads.groupBy("family").agg(F.max("n").alias("most"))
    asked = heads.join(most, "family").withColumn("last", F.when(F.col("is_base"), F.col("most")).otherwise(F.col("n")) - 1)
    asked = asked.withColumn("slab", F.explode(F.sequence(F.lit(0).cast("long"), slab("last")))).drop("most", "last")
    return own.groupBy("family", "slab").cogroup(asked.groupBy("family", "slab")).applyInPandas(_small_trie, f"family long, {NODES}")


def _digests(small: DataFrame) -> DataFrame:
    """KEY and the SHA-256 of the ids that end there: families in order, each row hashed as it comes."""
    rows = small.where("ends IS NOT NULL").select(*KEY, "family", "ends").repartition(*KEY).sortWithinPartitions(*KEY, "family")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []
        for b in batches:
            for *key, _, ends in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if key != now:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256(ends.encode())
                else:
                    state.update(b"," + ends.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=[*KEY, "ends_sha256"])
                done = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, state.hexdigest())], names=[*KEY, "ends_sha256"])

    return rows.mapInArrow(trimming(run), "depth long, h long, g long, ends_sha256 string")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    Hot turns make hot keys only in sums, which tasks add up first, and in joins, which Spark's skew handling splits.
    """
    turns = stretches(conversations)
    small = materialize(families(turns), "families")
    discard(turns)
    merged = small.groupBy(*KEY).agg(
        F.first("h0").alias("h0"),
        F.first("g0").alias("g0"),
        F.sum(F.size("ids").cast("long")).alias("n_convs"),
        F.min(F.struct(F.col("ids")[0].alias("conv_id"), F.col("rests")[0].alias("rest"))).alias("top"),
    )
    merged = materialize(merged.select(*KEY, "h0", "g0", "n_convs", "top.conv_id", "top.rest"), "merged")
    children = merged.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("h0").alias("h"), F.col("g0").alias("g")).agg(F.count("*").alias("n_children"))
    nodes = materialize(merged.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")
    # what each conversation owns: from which depth on, what it has from there, and whether that ends in a leaf
    owned = nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "rest")).alias("from"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    ways = small.select(*KEY, F.explode(F.arrays_zip("ids", "rests")).alias("m")).select(*KEY, F.col("m.ids").alias("conv_id"), F.col("m.rests").alias("rest"))
    above = F.when(F.col("from").isNull(), F.col("rest")).when(F.col("depth") < F.col("from.depth"), F.col("rest") - F.col("from.rest")).otherwise(0)
    sums = ways.join(owned, "conv_id", "left").groupBy(*KEY).agg(F.sum(above).alias("saved_tokens"), F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"))
    root = nodes.where("depth = 0").select(F.col("conv_id").alias("parent_conv_id"))  # one row at most
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("h").alias("h0"), F.col("g").alias("g0"), F.col("conv_id").alias("parent_conv_id"))
    kept = nodes.drop("rest")
    placed = kept.where("depth > 1").join(up.where("depth > 1"), ["depth", "h0", "g0"])
    placed = placed.unionByName(kept.where("depth = 1").crossJoin(F.broadcast(root))).unionByName(kept.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    full = placed.join(sums, KEY).join(_digests(small), KEY, "left")
    none = hashlib.sha256(b"").hexdigest()
    return full.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


_STEP = "list_reduce(range(8), lambda c, _i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, {x})"
_CRC = "xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)), lambda a, b: " + _STEP.format(x="xor(a, b)") + ", 4294967295::BIGINT), 4294967295)"
ORACLE = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS part, t.p, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.p <= c.h
      UNION ALL SELECT c.conv_id, 1, t.p, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id WHERE t.p > c.h),
w AS (SELECT conv_id, list(row(role, text) ORDER BY part, p) AS path FROM r GROUP BY conv_id),
f AS (SELECT c.conv_id, coalesce(w.path, []) AS path FROM c LEFT JOIN w ON w.conv_id = c.conv_id),
m AS (SELECT conv_id, len(path) AS size, path, unnest(range(0, len(path) + 1)) AS depth FROM f),
p AS (SELECT conv_id, size, depth, path[1:depth] AS way, CASE WHEN depth = 0 THEN 0 ELSE length(path[depth][2]) END AS chars FROM m),
n AS (SELECT depth, way, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = depth), '') AS ends FROM p GROUP BY depth, way),
k AS (SELECT depth - 1 AS depth, way[1:depth - 1] AS way, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
v AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON k.depth = n.depth AND k.way = n.way),
s AS (SELECT a.depth, a.way, sum((b.n_convs - 1) * b.chars) AS saved_tokens, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves FROM v a JOIN v b ON b.depth >= a.depth AND b.way[1:a.depth] = a.way GROUP BY a.depth, a.way)
SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, CAST(v.n_children AS BIGINT) AS n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(v.ends) AS ends_sha256
FROM v JOIN s ON s.depth = v.depth AND s.way = v.way LEFT JOIN v u ON u.depth = v.depth - 1 AND u.way = v.way[1:v.depth - 1]
"""


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
