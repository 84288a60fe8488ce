"""Distances as columns: smaller is closer for every metric.

``<->``  square root of the sum of squared differences
``<=>``  1 - cosine; 1.0 if either vector is zero
``<#>``  minus the inner product

Up to ``UNROLL`` dimensions a distance is one sum of products, which whole-stage
code generation compiles; beyond that the literals would bloat the plan, and a
vectorised Arrow function takes batches of vectors instead.  Both work in double
precision.  More metrics can be registered by name.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

UNROLL = 64
NAMES = {"<->": "l2", "<=>": "cosine", "<#>": "ip"}

_EXTRA: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {}


def register_metric(op: str, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
    """``kernel`` maps (n x d vectors, query) to n distances, in numpy."""
    _EXTRA[op] = kernel


def _sum(terms: list[Column]) -> Column:
    """A balanced tree of sums, so that neither the plan nor the compiler nests deeply."""
    while len(terms) > 1:
        terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return terms[0]


def _unrolled(v: Column, op: str, q: list[float]) -> Column:
    x = [v[i].cast("double") for i in range(len(q))]
    if op == "<->":
        return F.sqrt(_sum([(a - F.lit(b)) * (a - F.lit(b)) for a, b in zip(x, q, strict=True)]))
    dot = _sum([a * F.lit(b) for a, b in zip(x, q, strict=True)])
    if op == "<#>":
        return -dot
    norm = math.sqrt(sum(b * b for b in q))
    if norm == 0:
        return F.when(v.isNotNull(), F.lit(1.0))
    own = F.sqrt(_sum([a * a for a in x]))
    # the norm stands here once, as compiled code has a size limit
    return F.coalesce(1.0 - F.try_divide(dot, own * F.lit(norm)), F.lit(1.0))


def kernel(op: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of the rows of ``x`` to ``q``."""
    if op in _EXTRA:
        return _EXTRA[op](x, q)
    if op == "<->":
        return np.sqrt(((x - q) ** 2).sum(axis=1))
    dot = x @ q
    if op == "<#>":
        return -dot
    norms = np.sqrt((x * x).sum(axis=1)) * math.sqrt(float(q @ q))
    return np.where(norms == 0, 1.0, 1.0 - dot / np.where(norms == 0, 1.0, norms))


def arrow_distance(v: Column, op: str, q: list[float]) -> Column:
    query = np.asarray(q, dtype=np.float64)
    # a registered kernel travels with the function; executors have no registry
    own = _EXTRA.get(op)

    @F.arrow_udf("double")
    def run(vectors: pa.Array) -> pa.Array:
        # the lists' one buffer of values, reshaped; no Python object for a row or a number
        fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), len(query)), False)
        some = vectors.filter(fits)
        fits = fits.to_numpy(zero_copy_only=False)
        out = np.full(len(fits), np.nan)
        if len(some):
            x = some.flatten().to_numpy(zero_copy_only=False).reshape(len(some), len(query)).astype(np.float64)
            out[fits] = own(x, query) if own else kernel(op, x, query)
        return pa.array(out, mask=~fits)

    return run(v)


def flat_nearest(op: str, queries: list[list[float]], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over batches (id, embedding) that leaves a task's ``k`` nearest of each query, as (query, id, distance).

    Every vector is read once for all queries; only the best rows of each query are kept.
    """
    wanted = np.asarray(queries, dtype=np.float64)
    own = _EXTRA.get(op)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0))] * len(wanted)
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy(zero_copy_only=False)
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1).astype(np.float64)
            for i, q in enumerate(wanted):
                d = own(x, q) if own else kernel(op, x, q)
                some = np.arange(len(d))
                if len(d) > k:
                    # all that are no farther than the k-th, so that ties are decided by id
                    some = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if k else some[:0]
                n, e = np.concatenate((best[i][0], ids[some])), np.concatenate((best[i][1], d[some]))
                order = np.lexsort((n, e))[:k]
                best[i] = n[order], e[order]
        many = [len(n) for n, _ in best]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(best), dtype=np.int32), many)), pa.array(np.concatenate([n for n, _ in best])), pa.array(np.concatenate([e for _, e in best]))], names=["query", "id", "distance"])

    return run


def nearest_of(op: str, queries: list[list[float]], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over batches (query, id, embedding) that leaves the ``k`` nearest of each query in a task, as (query, id, distance)."""
    wanted = np.asarray(queries, dtype=np.float64)
    own = _EXTRA.get(op)

    def best(q: np.ndarray, ids: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((ids, d, q))
        q, ids, d = q[order], ids[order], d[order]
        first = np.searchsorted(q, q)
        keep = np.arange(len(q)) - first < k
        return q[keep], ids[keep], d[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0))
        for b in batches:
            if not b.num_rows:
                continue
            q, ids = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(q), -1).astype(np.float64)
            d = np.empty(len(q))
            for one in np.unique(q):
                some = q == one
                d[some] = own(x[some], wanted[one]) if own else kernel(op, x[some], wanted[one])
            kept = best(*(np.concatenate(p) for p in zip(kept, (q, ids, d), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(kept[0].astype(np.int32)), pa.array(kept[1]), pa.array(kept[2])], names=["query", "id", "distance"])

    return run


def once(d: Column) -> Column:
    """The same column, marked so that a filter on it does not copy its expression below: it is worked out once a row, and compiled code stays small."""
    return F.when(F.rand(0) >= 0, d)


def distance(v: Column, op: str, q: list[float]) -> Column:
    """The distance of a vector column to a query; NULL for a NULL vector or one of another length."""
    q = [float(x) for x in q]
    if op in _EXTRA or len(q) > UNROLL:
        return arrow_distance(v, op, q)
    return F.when(F.size(v) == len(q), _unrolled(v, op, q))
