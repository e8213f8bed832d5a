"""Embedding near-dedup: exact threshold pairs by dual traversal of cover trees.

Vectors of one label link if their cosine, in double precision, reaches the
threshold. On unit vectors that is a distance of at most sqrt(2 - 2 cos).
Equal vectors form one class with a multiplicity. The classes of a label are
dealt to the cells of a cover tree's upper level, which is fitted on a bounded
sample (`SAMPLE` rows in all). A label has `CELLS` cells, a large one more: one
for every four blocks, `MOST_CELLS` at most. Cells hold blocks of about `BLOCK` classes. Two cells meet only if their pivots are nearer than
both covering radii and the threshold together.

A task gets two blocks and builds a cover tree of each: nested levels with
halving radii. Traversing both at once, a pair of nodes is left out if its
centres are farther apart than the radii and the threshold allow, is counted
whole if even its farthest points must link, and else is opened. Single points
are decided by their cosine itself. Tasks return counts and a spanning forest,
never pairs, so a large group of near copies costs its size and not its square.

Defined results: a vector that is null, empty, zero or holds null or
non-finite components, or has no label, links with nothing and is its own
component; vectors of different lengths don't link; labels may have any type that can be
grouped by, and NaN labels are equal; repeated rows are equal
vectors; a null vec_id counts as larger than any other; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import components, materialize, with_uid

THRESHOLD = 0.98
SAMPLE = 4096
CELLS, MOST_CELLS = 16, 256
BLOCK = 2048


class CoverTree:
    """Nested levels with halving radii over unit vectors; points of a node lie together in `order`.

    Radii hold however the products are rounded, which differs between machines and places in a matrix.
    """

    def __init__(self, x: np.ndarray):
        self.x = x
        self.slack = math.sqrt(2 * (x.shape[1] + 2) * np.finfo(float).eps)  # computed distances of equal vectors reach it at most
        self.order = np.empty(len(x), dtype=np.int64)
        self.nodes: list[tuple[int, float, int, int, list[int]]] = []  # centre, radius, from, to, children
        self.root = self._build(np.arange(len(x)), 2.0, 0)

    def _build(self, points: np.ndarray, bound: float, at: int) -> int:
        """points[0] is the centre; all points lie within bound of it."""
        stack: list[list] = [[points, bound, at, None]]
        root = -1
        while stack:
            points, bound, at, parent = stack.pop()
            centre = int(points[0])
            d = _far(self.x[points], self.x[centre])
            radius = float(d.max())
            me = len(self.nodes)
            self.nodes.append((centre, radius + self.slack, at, at + len(points), []))
            if parent is None:
                root = me
            else:
                self.nodes[parent][4].append(me)
            if radius <= self.slack or len(points) == 1:
                self.order[at : at + len(points)] = points
                if len(points) > 1:  # vectors that differ by rounding only
                    for k, p in enumerate(points):
                        self.nodes[me][4].append(len(self.nodes))
                        self.nodes.append((int(p), self.slack, at + k, at + k + 1, []))
                continue
            while bound / 2 >= radius:
                bound /= 2
            half, rest, first = bound / 2, points, at
            while len(rest):
                d = _far(self.x[rest], self.x[rest[0]])
                near = d <= half
                near[0] = True
                part = rest[near]
                stack.append([part, half, first, me])
                first += len(part)
                rest = rest[~near]
        return root


def _far(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances of unit vectors x from c."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * (x @ c)))


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def dual_links(x: np.ndarray, weight: np.ndarray, split: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(weight of linked others, smallest linked index) per vector.

    split 0: all pairs of x; else pairs of one vector before split and one from it on.
    """
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    norm = np.sqrt((x * x).sum(1))
    reach = math.sqrt(2 - 2 * threshold)
    gain, forest = np.zeros(len(x), dtype=np.int64), Forest(len(x))
    sides = [(CoverTree(unit), 0)] if not split else [(CoverTree(unit[:split]), 0), (CoverTree(unit[split:]), split)]
    (ta, ba), (tb, bb) = sides[0], sides[-1]
    same_tree = not split
    stack = [(ta.root, tb.root)]
    while stack:
        a, b = stack.pop()
        kids = [t.nodes[n][4] or [n] for t, n in ((ta, a), (tb, b))]
        ca, cb = ([t.nodes[n][0] + base for n in k] for t, base, k in ((ta, ba, kids[0]), (tb, bb, kids[1])))
        ra, rb = (np.array([t.nodes[n][1] for n in k]) for t, k in ((ta, kids[0]), (tb, kids[1])))
        d = np.sqrt(np.maximum(0.0, 2 - 2 * (unit[ca] @ unit[cb].T)))
        wide = ra[:, None] + rb[None, :]
        near = d <= reach + wide + 1e-6
        if same_tree and a == b:
            near &= np.tri(len(ca), dtype=bool).T  # each pair of children once
        for i, j in zip(*np.nonzero(near), strict=True):
            p, q = kids[0][i], kids[1][j]
            own = same_tree and p == q
            na, nb = ta.nodes[p], tb.nodes[q]
            single = na[3] - na[2] == 1 and nb[3] - nb[2] == 1
            if own and single:
                continue
            if single:
                u, v = ca[i], cb[j]
                if x[u] @ x[v] / (norm[u] * norm[v]) >= threshold:
                    gain[u] += weight[v]
                    gain[v] += weight[u]
                    forest.join(u, v)
            elif (wide[i, j] if not own else 2 * ra[i]) + (d[i, j] if not own else 0.0) <= reach - 1e-6:
                pa_, pb_ = ta.order[na[2] : na[3]] + ba, tb.order[nb[2] : nb[3]] + bb
                if own:
                    gain[pa_] += weight[pa_].sum() - weight[pa_]
                else:
                    gain[pa_] += weight[pb_].sum()
                    gain[pb_] += weight[pa_].sum()
                for k in pa_.tolist():
                    forest.join(k, int(pb_[0]))
                for k in pb_.tolist():
                    forest.join(k, int(pa_[0]))
            else:
                stack.append((p, q))
    return gain, np.array([forest.find(i) for i in range(len(x))], dtype=np.int64)


def upper_cells(x: np.ndarray, cells: int) -> np.ndarray:
    """Centres of the deepest level of a cover tree with at most `cells` nodes."""
    tree = CoverTree(x / np.linalg.norm(x, axis=1)[:, None])
    level = [tree.root]
    while True:
        lower = [k for n in level for k in (tree.nodes[n][4] or [n])]
        if len(lower) > cells or lower == level:
            return tree.x[[tree.nodes[n][0] for n in level]]
        level = lower


def _dealt(classes: DataFrame, pivots: dict) -> DataFrame:
    """Add cell and the distance from its pivot to every class."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)  # SAMPLE vectors at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, far = np.zeros(b.num_rows, dtype=np.int32), np.full(b.num_rows, 2.0)
            keys = list(zip(b.column("label").to_pylist(), b.column("dim").to_pylist(), strict=True))
            where: dict = {}
            for i, k in enumerate(keys):
                if k in shared.value:
                    where.setdefault(k, []).append(i)
            for k, rows in where.items():
                x = np.array(b.column("vec").take(pa.array(rows)).to_pylist(), dtype=np.float64)
                d = np.sqrt(np.maximum(0.0, 2 - 2 * (x / np.linalg.norm(x, axis=1)[:, None]) @ shared.value[k].T))
                cell[rows] = d.argmin(1)
                far[rows] = d.min(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(far)], names=[*b.schema.names, "cell", "far"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema.fields)
    return classes.mapInArrow(run, f"{kinds}, cell int, far double")


def class_links(classes: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(id, n_linked, root) parts, some rows a class, from (id, label, dim, vec, n)."""
    total = classes.count()
    if not total:
        return classes.sparkSession.createDataFrame([], "id long, n_linked long, root long")
    chance = F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(1 << 30)) < F.lit(min(1 << 30, (SAMPLE << 30) // total))
    sample = classes.where(chance).select("label", "dim", "vec").limit(2 * SAMPLE).toPandas()
    wanted = lambda g: min(MOST_CELLS, max(CELLS, len(g) * total // (4 * block * len(sample))))
    pivots = {(int(k[0]), int(k[1])): upper_cells(np.array(g["vec"].tolist(), dtype=np.float64), wanted(g)) for k, g in sample.groupby(["label", "dim"])}
    dealt = materialize(_dealt(classes, pivots), "dealt")
    cells = materialize(dealt.groupBy("label", "dim", "cell").agg(F.count("*").alias("size"), F.max("far").alias("radius")).withColumn("blocks", F.ceil(F.col("size") / block)), "cells")
    apart = [(k[0], k[1], i, j, float(d)) for k, p in pivots.items() for i in range(len(p)) for j, d in enumerate(np.sqrt(np.maximum(0, 2 - 2 * p[i] @ p.T)).tolist()) if j >= i]
    gaps = classes.sparkSession.createDataFrame(apart or [(0, 0, 0, 0, 0.0)], "label long, dim int, a int, b int, gap double")
    side = lambda p: cells.select("label", "dim", F.col("cell").alias(p), F.col("radius").alias(f"r{p}"), F.col("blocks").alias(f"n{p}"))
    met = side("a").join(side("b"), ["label", "dim"]).where("a <= b").join(gaps, ["label", "dim", "a", "b"], "left")
    met = met.where((F.col("a") == F.col("b")) | F.col("gap").isNull() | (F.col("gap") <= F.col("ra") + F.col("rb") + math.sqrt(2 - 2 * threshold) + 1e-6))
    met = met.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("na").cast("int") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb").cast("int") - 1))).where("a < b OR i <= j")
    met = met.withColumn("task", F.struct("label", "dim", "a", "i", "b", "j"))
    left = met.select("label", "dim", F.col("a").alias("cell"), F.col("i").alias("blk"), "task", F.lit(0).alias("side"))
    right = met.where("a < b OR i < j").select("label", "dim", F.col("b").alias("cell"), F.col("j").alias("blk"), "task", F.lit(1).alias("side"))
    placed = dealt.join(cells.select("label", "dim", "cell", "blocks"), ["label", "dim", "cell"])
    placed = placed.withColumn("blk", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    work = placed.join(left.union(right), ["label", "dim", "cell", "blk"]).select("task", "side", "id", "n", "vec")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "id"], kind="stable")
        ids, side = pdf["id"].to_numpy(), pdf["side"].to_numpy()
        split = int((side == 0).sum()) if side[-1] else 0
        if not split and side[-1]:  # the other block is empty
            return pd.DataFrame({"id": ids[:0], "n_linked": ids[:0], "root": ids[:0]})
        x = np.array(pdf["vec"].tolist(), dtype=np.float64)
        gain, root = dual_links(x, pdf["n"].to_numpy(dtype=np.int64), split, threshold)
        some = gain > 0
        return pd.DataFrame({"id": ids[some], "n_linked": gain[some], "root": ids[root[some]]})

    return work.groupBy("task").applyInPandas(run, "id long, n_linked long, root long")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding, label)."""
    v = with_uid(vectors.select("vec_id", "embedding", "label"))
    vec = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(math.inf))) & F.exists("embedding", lambda c: c != 0)
    valid = F.coalesce(F.col("label").isNotNull() & fine, F.lit(False))
    rows = v.select("_uid", "vec_id", "label", F.when(valid, vec).alias("vec"))
    classes = rows.where("vec IS NOT NULL").groupBy("label", "vec").agg(F.min("_uid").alias("id"), F.count("*").alias("n"), F.min("vec_id").alias("low"))
    classes = materialize(classes.select("id", "label", F.size("vec").alias("dim"), "vec", "n", "low"), "classes")
    # labels of any type are numbered, since tasks are told of them
    numbers = materialize(classes.select(F.col("label").alias("_label")).distinct().withColumn("number", F.monotonically_increasing_id()), "labels")
    numbered = classes.join(numbers, F.col("label") == F.col("_label")).select("id", F.col("number").alias("label"), "dim", "vec", "n")
    parts = materialize(class_links(materialize(numbered, "numbered"), threshold, block), "parts")
    linked = parts.groupBy("id").agg(F.sum("n_linked").alias("n_linked"))
    roots = components(parts.select(F.col("id").alias("a"), F.col("root").alias("b")))
    joined = classes.join(linked, "id", "left").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    joined = materialize(joined.select("id", "label", "vec", "low", "root", (F.coalesce("n_linked", F.lit(0)) + F.col("n") - 1).alias("n_links")), "joined")
    smallest = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    told = materialize(joined.join(smallest, "root").select("label", "vec", "n_links", "component_id"), "told")
    good = rows.where("vec IS NOT NULL").join(told, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    bad = rows.where("vec IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(bad).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(id, low) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(low) AS component_id FROM r GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.id = vec_id LEFT JOIN n ON n.a = vec_id
"""
