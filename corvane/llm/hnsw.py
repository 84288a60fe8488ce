"""Embedding near-duplicates by hierarchical navigable small-world graphs, one per shard.

Vectors are dealt to shards; each shard builds a graph of layers (a sixteenth of
the nodes rises from one to the next) in numpy (``functions.hnsw``).  Every vector is a query of every shard.  A beam that
is half full of links is doubled for its query until it is not.  Before a batch of queries
is searched, a sample of it is compared with all vectors of the shard: queries are drawn
until ``AUDIT`` of them have a link other than themselves (or ``AUDIT_MOST`` are drawn), and
while the share of those that found all their links is below the target, all beams are
doubled.  What the audits saw is written beside the links (``recall_audit``).  Links are
verified by the cosine in double precision.

Equal vectors are collapsed first, so a vector repeated many times is one node with a
multiplicity.  A task sends, for its queries, the number of links and a spanning
forest of the links it found, never the pairs of a group, and holds the pairs of some queries at a time only.

A shard is bounded by bytes (``SHARD_BYTES`` of vectors and links), 8 shards at least.  A graph is written
once; a task takes a shard and a chunk of the queries, reads the graph once, and the
queries stream through it.  Chunks are some million queries, so the graphs are moved once for a
million queries and the queries once for each shard: that is the method's own growth, N * N / (vectors of a shard).

Cases: a null or zero vector, or one with null or non-finite components, links
with nothing; components are doubles throughout (kept as single precision only where that loses nothing);
vectors of different lengths do not link; repeated rows are vectors of their own; rows of one id are
told apart; a row without id has a null component, no links and is kept; ties need no
order, as every link counts; an empty table gives an empty result; further
columns (labels) do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hnsw import Graph, HnswParams, layer_sizes, levels, pack_arrays, unpack_arrays
from .graph import components, forest, spread_join
from .store import Scratch
from .textnum import mix

COSINE = 0.9
SHARDS = 8
SHARD_BYTES = 1 << 26
TASKS = 32
CHUNK_ROWS = 1 << 20  # queries of a task
QUERIES = 1 << 12  # queries searched together
PARAMS = HnswParams(m=16, m_max=16, m_max0=32, ef_construction=48, ef_search=32)
BEAM = PARAMS.ef_search
AUDIT = 16  # queries with links that an audit wants to see
AUDIT_MOST = 512  # queries that it draws at most
RECALL = 0.999
#: Links are looked for this much below the limit, as graphs hold single precision.
SLACK = 1e-4


def unit_rows(raw: list[bytes], dims: int) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that no square leaves the range."""
    kind = np.float32 if len(raw[0]) == 4 * dims else np.float64
    x = np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), dims).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _units(raw: list[bytes], dims: int) -> np.ndarray:
    """The same for rows in both precisions."""
    out = np.empty((len(raw), dims))
    size = np.array([len(x) for x in raw])
    for kind in (4, 8):
        some = np.flatnonzero(size == kind * dims)
        if len(some):
            out[some] = unit_rows([raw[i] for i in some], dims)
    return out


def _build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("rep")
    ids, dims = pdf.rep.to_numpy(np.int64), int(key[0])
    level = levels(ids, PARAMS)
    order = np.argsort(-level, kind="stable")
    ids, level, copies = ids[order], level[order], pdf.copies.to_numpy(np.int64)[order]
    exact = _units(pdf.raw.tolist(), dims)[order]
    g = Graph.build(exact.astype(np.float32), layer_sizes(level), PARAMS)
    return pd.DataFrame({"dims": [dims], "shard": [int(key[1])], "payload": [pack_arrays(ids, copies, exact, *[x.astype(np.int32) for x in g.links])]})


class Shard:
    """A shard's graph with its exact vectors, node numbers and multiplicities."""

    def __init__(self, payload: bytes):
        self.ids, self.copies, self.exact, *links = unpack_arrays(payload)
        single = self.exact.astype(np.float32)
        self.graph = Graph(single, np.zeros(len(single), dtype=np.float32), [x.astype(np.int64) for x in links], PARAMS)

    def links(self, q: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) of all links found for unit vectors q (double), some queries at a time."""
        n = len(self.exact)
        todo, beam, single = np.arange(len(q)), min(width, n), q.astype(np.float32)
        while len(todo):
            again = []
            step = max(16, min(512, (1 << 25) // (n + 1), (1 << 20) // beam))
            for at in range(0, len(todo), step):
                some = todo[at : at + step]
                if beam >= n:  # the beam holds the whole shard
                    r, c = np.nonzero(q[some] @ self.exact.T >= COSINE)
                    yield some[r], c
                    continue
                ids, sims = self.graph.search(single[some], beam)
                near = sims >= COSINE - SLACK
                full = near.sum(axis=1) > beam // 2
                again.append(some[full])
                r, c = np.nonzero(near & ~full[:, None])
                node = ids[r, c]
                sure = np.einsum("ij,ij->i", q[some[r]], self.exact[node]) >= COSINE
                yield some[r[sure]], node[sure]
            todo, beam = np.concatenate(again) if again else np.zeros(0, np.int64), min(beam * 2, n)

    def audit(self, rep: np.ndarray, q: np.ndarray, width: int) -> tuple[int, int, int, int, int]:
        """(width, queries with links, those that found all, links, links found) of the width that a sample of the queries passes."""
        n = len(self.exact)
        drawn = np.argsort(mix(rep.view(np.uint64) ^ np.uint64(n)), kind="stable")[:AUDIT_MOST]
        sample, truth, seen = [], [], 0
        for at in range(0, len(drawn), 64):
            some = drawn[at : at + 64]
            t = (q[some] @ self.exact.T >= COSINE) & (rep[some][:, None] != self.ids[None, :])
            sample.append(some)
            truth.append(t)
            seen += int(t.any(axis=1).sum())
            if seen >= AUDIT:
                break
        sample, truth = np.concatenate(sample), np.concatenate(truth)
        linked = truth.any(axis=1)
        sample, truth = sample[linked], truth[linked]
        while True:
            got = np.zeros(truth.shape, dtype=bool)
            for u, v in self.links(q[sample], width):
                got[u, v] = True
            got &= truth
            whole = int((got == truth).all(axis=1).sum())
            if width >= n or whole >= RECALL * len(sample):
                return width, len(sample), whole, int(truth.sum()), int(got.sum())
            width = min(2 * width, n)


_FOUND = "u long, v long, n long, audit array<long>"


def _query(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (dims, shard, chunk, rep, raw) in order, each chunk's graph first (rep null): links counted (u = v), edges of forests, audits."""
    shard, now, rep, raw, width = None, None, [], [], BEAM

    def flush() -> pa.RecordBatch:
        nonlocal width
        ids = np.array(rep, dtype=np.int64)
        q = _units(raw, now[0])
        width, *seen = shard.audit(ids, q, width)
        many, edges = np.zeros(len(ids), np.int64), (np.zeros(0, np.int64),) * 2
        for u, v in shard.links(q, width):
            other = ids[u] != shard.ids[v]
            u, v = u[other], v[other]
            many += np.bincount(u, weights=shard.copies[v], minlength=len(ids)).astype(np.int64)
            if len(u):
                edges = forest(np.concatenate((edges[0], ids[u])), np.concatenate((edges[1], shard.ids[v])))
        some = np.flatnonzero(many)
        n = len(some) + len(edges[0])
        u, v = np.concatenate((ids[some], edges[0], [-1])), np.concatenate((ids[some], edges[1], [-2]))
        audit = [None] * n + [[*now, width, len(ids), *seen]]
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.concatenate((many[some], np.zeros(len(edges[0]) + 1, np.int64)))), pa.array(audit, pa.list_(pa.int64()))], names=["u", "v", "n", "audit"])

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(4)]
        for dims, number, chunk, r, data in zip(*columns, batch.column(4), strict=True):
            if r is None:
                if rep:
                    yield flush()
                shard, now, rep, raw, width = Shard(data.as_py()), (dims, number, chunk), [], [], BEAM
                continue
            if now != (dims, number, chunk):  # a shard without nodes has no graph
                if rep:
                    yield flush()
                shard, now, rep, raw = None, (dims, number, chunk), [], []
            if shard is not None:
                rep.append(r)
                raw.append(data.as_py())
            if len(rep) >= QUERIES:
                yield flush()
                rep, raw = [], []
    if rep:
        yield flush()


def _raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        values = lists.flatten()
        flat = values.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64) if len(values) else np.zeros(0)
        many = np.array(lists.value_lengths().fill_null(0).to_pylist(), dtype=np.int64)
        ends = np.cumsum(many)
        raw = []
        for n, e in zip(many, ends, strict=True):
            x = flat[e - n : e] + 0.0  # one zero
            if not (n and np.isfinite(x).all() and x.any()):
                raw.append(None)
                continue
            with np.errstate(over="ignore", under="ignore"):
                low = x.astype(np.float32)
            raw.append((low if (low == x).all() else x).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(many.astype(np.int32)), pa.array(raw, pa.binary())], names=["vec_id", "dims", "raw"])


def _search(vectors: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, nodes, found): all rows, the distinct vectors that may link, and what the shards' searches found."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_raw, "vec_id long, dims int, raw binary")
    rows = scratch.put(rows, "rows")
    nodes = rows.where("raw is not null and vec_id is not null").groupBy("dims", "raw").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    # the number is fixed once the table is written
    nodes = scratch.put(nodes.withColumn("rep", F.monotonically_increasing_id()), "nodes")
    # by length of vectors, so that tables of any number of lengths stay a table
    sizes = nodes.groupBy("dims").agg(F.count("*").alias("n"))
    shards = F.greatest(F.lit(SHARDS), F.ceil(F.col("n") * (F.col("dims") * 8 + 4 * (PARAMS.m_max0 + PARAMS.m_max) + 16) / SHARD_BYTES)).cast("int")
    chunks = F.greatest(F.ceil(F.col("n") / CHUNK_ROWS), F.ceil(F.lit(TASKS) / F.col("shards"))).cast("int")
    sizes = scratch.put(sizes.withColumn("shards", shards).withColumn("chunks", chunks), "sizes")
    dealt = nodes.join(F.broadcast(sizes.drop("n")) if sizes.count() <= 10_000 else sizes.drop("n"), "dims")
    own = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("shards")).cast("int")
    graphs = dealt.select("dims", own.alias("shard"), "rep", "raw", "copies").groupBy("dims", "shard").applyInPandas(_build, "dims int, shard int, payload binary")
    graphs = scratch.put(graphs, "graphs", "none")
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    served = graphs.join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, "dims").select("dims", "shard", span("chunks").alias("chunk"), "shards", F.lit(None).cast("long").alias("rep"), F.col("payload").alias("raw"))
    asked = dealt.select("dims", span("shards").alias("shard"), F.pmod(F.xxhash64("rep", F.lit(2)), F.col("chunks")).cast("int").alias("chunk"), "shards", "rep", "raw")
    # a task for each shard and chunk, numbered, as hashes would put several on one
    tasks = int(sizes.agg(F.sum(F.col("shards") * F.col("chunks"))).first()[0] or 1)
    number = F.pmod(F.xxhash64("dims") + F.col("shard") + F.col("chunk") * F.col("shards"), F.lit(tasks)).cast("int")
    streams = served.unionAll(asked).withColumn("task", number).repartitionById(tasks, F.col("task")).select("dims", "shard", "chunk", "rep", "raw").sortWithinPartitions("dims", "shard", "chunk", F.asc_nulls_first("rep"))
    return rows, nodes, scratch.put(streams.mapInArrow(_query, _FOUND), "found")


def recall_audit(vectors: DataFrame) -> DataFrame:
    """What the audits of a search saw: (dims, shard, chunk, beam, queries, linked_queries, complete_queries, links, found_links)."""
    found = _search(vectors, Scratch(vectors.sparkSession, "hnsw"))[2].where("audit is not null")
    names = ["dims", "shard", "chunk", "beam", "queries", "linked_queries", "complete_queries", "links", "found_links"]
    return found.select(*[F.get("audit", F.lit(i)).alias(n) for i, n in enumerate(names)])


def embedding_links(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding)."""
    scratch = Scratch(vectors.sparkSession, "hnsw")
    rows, nodes, found = _search(vectors, scratch)
    found = found.where("audit is null")
    counts = found.where("u = v").groupBy("u").agg(F.sum("n").alias("links"))
    comp = components(vectors.sparkSession, found.where("u <> v").select("u", "v"), scratch)
    facts = nodes.join(counts.withColumnRenamed("u", "rep"), "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    facts = scratch.put(facts, "facts")
    least = facts.groupBy("component").agg(F.min("low").alias("least"), F.count("*").alias("n"))
    facts = spread_join(facts, least, ["component"], nodes.count()).select("dims", "raw", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "least", F.col("copies").alias("n"))
    may = F.col("raw").isNotNull() & F.col("vec_id").isNotNull()
    linked = spread_join(rows.where(may), scratch.put(facts, "components"), ["dims", "raw"], rows.count())
    rest = rows.where(~may).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.col("least").alias("component_id")).unionAll(rest)
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)))
