"""Approximate nearest neighbours: cells of near vectors, each with a small-world graph, as a Parquet table.

Building: a bounded sample (``SAMPLE`` rows) gives the cells' centres by k-means; every row is dealt to its
nearest centre; a cell above ``CELL_BYTES`` is split by id, so a graph is bounded whatever the data.  The table is
partitioned by cell, so a search reads only the cells that it probes.

Searching: the query probes the cells nearest to it, walks their graphs with a beam of ``ef``, and gives candidate
ids.  Distances, filters and order are then worked out on the rows themselves, so what is returned is exact for
the candidates.  Where too few candidates survive (filters, deletions), the beam widens and probes double, for a few rounds;
then all rows are read, so a search gives min(k, matches) rows as the exact plan does.  A radius has no number of rows
to stop at, and a beam can't tell that none is left (links may not lead to every node, and copies shut a beam in), so a
radius search measures all vectors of the cells that it reads; for Euclidean distance, cells that lie wholly outside are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distance import kernel
from ..functions.hnsw import Graph, HnswParams, layer_sizes, levels, pack_arrays, unpack_arrays

CELL_BYTES = 4 << 20
SAMPLE = 1 << 16
PROBES = 4
#: Rounds of wider beams and more probes for a filtered search, before all rows are read.
WIDER = 4
ROUNDS = 8
GRAPH = "cell int, part int, n bigint, payload binary"
CELL = "cell int, centre array<double>, reach double, n bigint, parts int"
#: Slack of single precision where vectors of a graph are measured, and how many at a time; candidates are measured exactly afterwards.
SLACK = 1e-4
BLOCK = 4096


def prepared(op: str, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, halves) in single precision, whose similarity orders as the metric does."""
    x = np.asarray(x, dtype=np.float64)
    if op == "<=>":
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        x = x / np.where(norm == 0, 1.0, norm)
    half = (x * x).sum(axis=1) / 2 if op == "<->" else np.zeros(len(x))
    return x.astype(np.float32), half.astype(np.float32)


def _away(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances of vectors to centres, by differences, so that large coordinates cancel without loss."""
    return np.sqrt(((x - centres) ** 2).sum(axis=1))


def _near(op: str, x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Similarities n x cells in double precision; cells are compared by distance, for inner products too."""
    if op == "<=>":
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        x = x / np.where(norm == 0, 1.0, norm)
    return x @ centres.T - (centres * centres).sum(axis=1) / 2 - (x * x).sum(axis=1)[:, None] / 2


def _centres(op: str, x: np.ndarray, cells: int) -> np.ndarray:
    """k-means of a sample; an empty cell keeps its centre."""
    if op == "<=>":
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        x = x / np.where(norm == 0, 1.0, norm)
    centres = x[np.linspace(0, len(x) - 1, cells).astype(np.int64)].copy()
    for _ in range(ROUNDS):
        own = np.concatenate([_near("<->", x[i : i + 4096], centres).argmax(axis=1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        many = np.bincount(own, minlength=cells)
        centres[many > 0] = total[many > 0] / many[many > 0, None]
    return centres


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    """A list column's buffer as a matrix, without a Python object per row."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim).astype(np.float64)


def build(rows: DataFrame, op: str, dim: int, params: HnswParams, cell_bytes: int = CELL_BYTES, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """(cells, graphs) of (id, embedding)."""
    rows = rows.select("id", "embedding")
    n = rows.count()
    each = dim * 4 + params.m_max0 * 4 + 32
    cells = max(1, -(-n * each // cell_bytes))
    taken = rows.select("embedding") if n <= sample else rows.select("embedding").sample(min(1.0, 1.2 * sample / n), seed=7).limit(sample)
    x = _vectors(taken.toArrow().column(0).combine_chunks(), dim) if n else np.zeros((1, dim))
    cells = min(cells, len(x))
    centres = _centres(op, x, cells)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = _vectors(b.column(1), dim)
                own = _near(op, v, centres).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own.astype(np.int32)), pa.array(_away(v, centres[own]))], names=["id", "embedding", "cell", "away"])

    dealt = rows.mapInArrow(deal, "id bigint, embedding array<float>, cell int, away double")
    # one row a cell, of which there are as many as the bytes ask for
    sizes = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("reach"))
    centre = rows.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    parts = F.ceil(F.col("n") * each / cell_bytes).cast("int")
    facts = sizes.join(F.broadcast(centre), "cell").select("cell", "centre", "reach", "n", parts.alias("parts"))
    split = dealt.join(F.broadcast(sizes.select("cell", parts.alias("parts"))), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))

    def graph(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids = pdf.id.to_numpy(np.int64)
        level = levels(ids, params)
        order = np.argsort(-level, kind="stable")
        v, half = prepared(op, np.stack(pdf.embedding.to_list())[order])
        g = Graph.build(v, layer_sizes(level[order]), params, half)
        return pd.DataFrame({"cell": [int(key[0])], "part": [int(key[1])], "n": [len(ids)], "payload": [pack_arrays(ids[order], v, half, *[x.astype(np.int32) for x in g.links])]})

    return facts, split.select("cell", "part", "id", "embedding").groupBy("cell", "part").applyInPandas(graph, GRAPH)


def _graph(payload: bytes, params: HnswParams) -> tuple[np.ndarray, Graph]:
    ids, v, half, *links = unpack_arrays(payload)
    return ids, Graph(v, half, [x.astype(np.int64) for x in links], params)


class AnnIndex:
    """A built index of one metric: its cells (read by the driver, one row each) and its graphs (read by cell)."""

    def __init__(self, cells: DataFrame, graphs: DataFrame, op: str, params: HnswParams):
        self.graphs, self.op, self.params = graphs, op, params
        found = cells.orderBy("cell").collect()
        self.cells = np.array([r["cell"] for r in found], dtype=np.int64)
        self.centres = np.array([r["centre"] for r in found], dtype=np.float64).reshape(len(found), -1)
        self.reach = np.array([r["reach"] for r in found])
        self.n = sum(r["n"] for r in found)
        self._parts = np.sort([r["parts"] for r in found])[::-1] if found else np.zeros(0, np.int64)

    def parts(self, probes: int) -> int:
        """Graphs that so many probes read at most."""
        return int((self._parts if self.op == "<#>" else self._parts[:probes]).sum())

    def _of(self, cells: list[int]) -> DataFrame:
        graphs = self.graphs if len(cells) == len(self.cells) else self.graphs.where(F.col("cell").isin(cells))
        return graphs.select("payload")

    def _walk(self, cells: list[int], q: np.ndarray, ef: int) -> DataFrame:
        """(query, id) of what beams find for the queries in some cells."""
        params = self.params
        queries, half = prepared(self.op, q)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for data in b.column(0):
                    ids, g = _graph(data.as_py(), params)
                    found, _ = g.search(queries, min(ef, g.size), half)
                    r, c = np.nonzero(found >= 0)
                    yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), pa.array(ids[found[r, c]])], names=["query", "id"])

        return self._of(cells).mapInArrow(run, "query int, id bigint")

    def nearest(self, query: list[float], ef: int, probes: int) -> DataFrame:
        """Candidate ids from the ``probes`` nearest cells; all cells for inner products, whose best may lie far off."""
        q = np.asarray([query], dtype=np.float64)
        order = np.argsort(-_near(self.op, q, self.centres)[0], kind="stable")
        some = self.cells if self.op == "<#>" else self.cells[order[:probes]]
        return self._walk([int(c) for c in some], q, ef).select("id")

    def within(self, query: list[float], radius: float) -> DataFrame | None:
        """Ids of all indexed vectors within a radius, and of some just outside; None if no vector can lie inside."""
        if not math.isfinite(radius) or (radius < 0 and self.op != "<#>"):
            return None
        op, q = self.op, np.asarray(query, dtype=np.float64)
        some = self.cells
        if op == "<->":
            some = self.cells[_away(q, self.centres) - self.reach <= radius * (1 + SLACK) + SLACK]
        if not len(some):
            return None
        most, long = radius + SLACK * (1 + abs(radius)), float(np.sqrt(q @ q))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for data in b.column(0):
                    ids, v = unpack_arrays(data.as_py())[:2]
                    for at in range(0, len(ids), BLOCK):
                        x = v[at : at + BLOCK].astype(np.float64)
                        # sums of large products are rounded too
                        loose = most + 1e-9 * long * np.sqrt((x * x).sum(axis=1)) if op == "<#>" else most
                        yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + BLOCK][kernel(op, x, q) <= loose])], names=["id"])

        return self._of([int(c) for c in some]).mapInArrow(run, "id bigint")

    def many(self, queries: list[list[float]], ef: int) -> DataFrame:
        """(query, id): candidates of several queries in one pass over all cells."""
        return self._walk([int(c) for c in self.cells], np.asarray(queries, dtype=np.float64), ef)
