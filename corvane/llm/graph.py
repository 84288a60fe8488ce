"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Scratch


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) edges with the components of the edges u-v."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        for x in (a, b):
            np.minimum.at(root, before[x], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        if (root[a] == root[b]).all():
            break
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


#: A key with this share of all rows or more (of the power of two above) is hot, so there are as many hot keys at most, and their rows may be broadcast.
HOT_SHARE = 1000


def spread_join(left: DataFrame, right: DataFrame, on: list[str], total: int, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row for each key and the number ``n`` of left rows that have it.

    Hot keys (a thousandth of the power of two above the ``total`` left rows, so a thousand of them at most) meet
    their row by a broadcast and stay where they are; only the other rows are dealt by key.
    """
    # a number of few values: compiled code holds it, and is kept by the driver for each one
    hot = F.col("n") * HOT_SHARE >= 1 << total.bit_length()
    more = [c for c in right.columns if c not in on and c != "n"]
    marked = left.join(F.broadcast(right.where(hot).select(*on, *more, F.lit(True).alias("_hot"))), on, "left")
    rest = marked.where("_hot is null").select(*left.columns).join(right.where(~hot).select(*on, *more), on, how)
    return marked.where("_hot").select(*left.columns, *more).unionByName(rest.select(*left.columns, *more))


def _least(edges: DataFrame, total: int) -> DataFrame:
    """Edges with their first node's least neighbour beside them; a hub's minimum comes from partial ones and is broadcast."""
    return spread_join(edges, edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), ["u"], total)


CONTRACT = 1 << 20


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forests of the edges that a task has, a million at a time, as (node, root)."""
    us, vs, size = [], [], 0

    def send() -> pa.RecordBatch:
        u, v = forest(np.concatenate(us), np.concatenate(vs))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for b in batches:
        us.append(b.column(0).to_numpy(zero_copy_only=False))
        vs.append(b.column(1).to_numpy(zero_copy_only=False))
        size += b.num_rows
        if size >= CONTRACT:
            yield send()
            us, vs, size = [], [], 0
    if size:
        yield send()


def _round(e: DataFrame, total: int) -> DataFrame:
    both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _least(both, total).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
    small = _least(large, total)
    return small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, most: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (two long columns ``u``, ``v``).

    component is the least id that links reach.  Null ends and self-links are
    ignored; repeated links count once; no links give an empty table.  Tasks first contract what
    they hold; each round is written to the shared folder, until only stars are left.
    """
    e = scratch.put(edges.where("u <> v").select("u", "v").mapInArrow(_contract, "u long, v long").distinct(), "edges")
    for _ in range(most):
        # stars around their least node: every node has one edge up, and none leads on
        ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("root")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("root")))).alias("e")).select("e.*")
        ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
        total, open_ = ends.agg(F.sum("up"), F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("root") > 0)))).first()
        if not open_:
            break
        new = scratch.put(_round(e, total), "edges")
        scratch.drop(e)
        e = new
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
