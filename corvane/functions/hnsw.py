"""Hierarchical navigable small-world graphs over numpy arrays.

Searches of many queries advance together: each step expands the best open nodes of every
live query and merges their neighbours into its beam.  Nodes are inserted in batches, whose
searches advance together too.  Similarity is ``q . x - half(x) - half(q)``: with half the squared
norm as ``half`` that is minus half the squared distance, with zeros the inner product.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa


@dataclass(frozen=True)
class HnswParams:
    """Links a node chooses, links it keeps (layers above the lowest, lowest), beams of building and searching."""

    m: int = 16
    m_max: int = 16
    m_max0: int = 32
    ef_construction: int = 200
    ef_search: int = 50

    def __post_init__(self):
        if self.m < 2 or self.m_max < self.m or self.m_max0 < self.m or self.ef_construction < 1 or self.ef_search < 1:
            raise ValueError(f"not a graph's parameters: {self}")

    @property
    def level_scale(self) -> float:
        return 1 / math.log(self.m)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit integers spread over all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def levels(ids: np.ndarray, params: HnswParams) -> np.ndarray:
    """The layer up to which each id rises: exponential, drawn from the id, so a rebuilt graph is the same graph."""
    draw = mixed(np.ascontiguousarray(ids, dtype=np.int64).view(np.uint64)) >> np.uint64(11)
    return np.floor(-np.log((draw.astype(np.float64) + 1) / 2**53) * params.level_scale).astype(np.int64)


def layer_sizes(level: np.ndarray) -> list[int]:
    """Nodes of each layer, for nodes ordered by descending level; a layer of one node is left out unless it is the lowest."""
    return [n for i in range(int(level[0]) + 1) if (n := int((level >= i).sum())) > (0 if i == 0 else 1)]


class Graph:
    """Layers over float32 vectors ordered by level; layer l holds the first nodes, as many as its table of links has rows."""

    def __init__(self, vectors: np.ndarray, half: np.ndarray, links: list[np.ndarray], params: HnswParams):
        self.vectors, self.half, self.links, self.params = vectors, half, links, params

    @property
    def size(self) -> int:
        return len(self.vectors)

    def _sims(self, q: np.ndarray, half: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Similarities of every query to its row of nodes; -1 counts as none."""
        some = np.maximum(nodes, 0)
        return np.where(nodes >= 0, np.einsum("qd,qkd->qk", q, self.vectors[some]) - self.half[some] - half[:, None], -np.inf)

    def beam(self, layer: int, q: np.ndarray, half: np.ndarray, entry: np.ndarray, width: int, filled: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` best nodes found from ``entry`` (q x e) for every query: (nodes, similarities), best first, -1 empty."""
        links, n = self.links[layer], len(q)
        seen = np.zeros((n, filled + 1), dtype=bool)  # the last column takes the empty ones
        rows = np.arange(n)[:, None]
        ids = np.full((n, width), -1, dtype=np.int64)
        sims = np.full((n, width), -np.inf, dtype=np.float32)
        e = entry[:, :width]
        ids[:, : e.shape[1]] = e
        sims[:, : e.shape[1]] = self._sims(q, half, e)
        seen[rows, np.where(e >= 0, e, filled)] = True
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        done = ids < 0
        live = np.arange(n)
        step = min(4, width)
        while len(live):
            open_ = ~done[live]
            has = open_.any(axis=1)
            live = live[has]
            if not len(live):
                break
            open_ = open_[has]
            rank = np.cumsum(open_, axis=1)
            now = open_ & (rank <= step)
            r, at = np.nonzero(now)
            done[live[r], at] = True
            near = np.full((len(live), step, links.shape[1]), -1, dtype=np.int64)
            near[r, rank[r, at] - 1] = links[ids[live[r], at]]
            near = near.reshape(len(live), -1)
            # a node may be met twice in one step: keep the first
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            own = live[:, None]
            near[seen[own, np.where(near >= 0, near, filled)]] = -1
            near[near >= filled] = -1
            seen[own, np.where(near >= 0, near, filled)] = True
            s = self._sims(q[live], half[live], near)
            all_s = np.concatenate((sims[live], s), axis=1)
            top = np.argsort(-all_s, axis=1, kind="stable")[:, :width]
            sims[live] = np.take_along_axis(all_s, top, 1)
            ids[live] = np.where(np.isfinite(sims[live]), np.take_along_axis(np.concatenate((ids[live], near), axis=1), top, 1), -1)
            done[live] = np.take_along_axis(np.concatenate((done[live], near < 0), axis=1), top, 1) | (ids[live] < 0)
        return ids, sims

    def enter(self, q: np.ndarray, half: np.ndarray, bottom: int) -> np.ndarray:
        """Entry nodes of a layer, by descending the layers above it."""
        entry = np.zeros((len(q), 1), dtype=np.int64)
        for layer in range(len(self.links) - 1, bottom, -1):
            entry, _ = self.beam(layer, q, half, entry, 4, len(self.links[layer]))
        return entry

    def search(self, q: np.ndarray, width: int, half: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` best nodes of the lowest layer for float32 queries, as many at a time as their marks of seen nodes allow."""
        half = np.zeros(len(q), dtype=np.float32) if half is None else half
        step = max(1, (1 << 26) // (len(self.links[0]) + 1))
        found = [self.beam(0, q[i : i + step], half[i : i + step], self.enter(q[i : i + step], half[i : i + step], 0), width, len(self.links[0])) for i in range(0, len(q), step)]
        return found[0] if len(found) == 1 else tuple(np.concatenate(x) for x in zip(*found, strict=True))

    @classmethod
    def build(cls, vectors: np.ndarray, sizes: list[int], params: HnswParams = HnswParams(), half: np.ndarray | None = None) -> Graph:
        half = np.zeros(len(vectors), dtype=np.float32) if half is None else half
        g = cls(vectors, half, [np.full((n, params.m_max if i else params.m_max0), -1, dtype=np.int64) for i, n in enumerate(sizes)], params)
        for layer in range(len(sizes) - 1, -1, -1):
            g._fill(layer, sizes[layer])
        return g

    def _fill(self, layer: int, n: int) -> None:
        links, width = self.links[layer], self.params.ef_construction
        at = 0
        while at < n:
            size = min(n - at, max(32, min(at // 2, 512)))
            new = np.arange(at, at + size)
            q, half = self.vectors[new], self.half[new]
            inner = q @ q.T - half[:, None] - half[None, :]
            inner[np.triu_indices(size)] = -np.inf  # the earlier ones of the batch
            k = min(max(width // 2, 1), size)
            near = np.argpartition(-inner, k - 1, axis=1)[:, :k]
            cand, sims = new[near], np.take_along_axis(inner, near, 1)
            if at:
                # the layers above hold the first nodes; while those are inserted, searches start at node 0
                above = layer + 1 < len(self.links) and at >= len(self.links[layer + 1])
                ids, s = self.beam(layer, q, half, self.enter(q, half, layer) if above else np.zeros((size, 1), np.int64), width, at)
                cand, sims = np.concatenate((ids, cand), axis=1), np.concatenate((s, sims), axis=1)
            cand = np.where(np.isfinite(sims), cand, -1)
            order = np.argsort(-sims, axis=1, kind="stable")[:, :width]
            cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
            links[new] = -1
            got = np.concatenate([self._select(cand[i : i + 64], sims[i : i + 64], self.params.m) for i in range(0, size, 64)])
            links[new, : got.shape[1]] = got
            self._back(links, new, got)
            at += size

    def _select(self, cand: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Diverse neighbours: candidates (best first, -1 empty) that are nearer to the node than to a chosen one; then the best others."""
        n, k = cand.shape
        some = np.maximum(cand, 0)
        x, half = self.vectors[some], self.half[some]
        between = np.matmul(x, x.transpose(0, 2, 1)) - half[:, :, None] - half[:, None, :]
        chosen = np.zeros((n, k), dtype=bool)
        nearest = np.full((n, k), -np.inf, dtype=np.float32)
        taken = np.zeros(n, dtype=np.int64)
        for r in range(k):
            ok = (cand[:, r] >= 0) & (sims[:, r] > nearest[:, r]) & (taken < most)
            chosen[:, r] = ok
            taken += ok
            nearest[ok] = np.maximum(nearest[ok], between[ok, r])
        rank = np.where(cand < 0, 2 * k + 1, np.where(chosen, 0, k) + np.arange(k))
        order = np.argsort(rank, axis=1, kind="stable")[:, :most]
        return np.take_along_axis(cand, order, axis=1)

    def _back(self, links: np.ndarray, new: np.ndarray, got: np.ndarray) -> None:
        """Links from the chosen neighbours to the new nodes; a full node keeps a diverse choice."""
        most = links.shape[1]
        r, c = np.nonzero(got >= 0)
        target, source = got[r, c], new[r]
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        nodes, first, many = np.unique(target, return_index=True, return_counts=True)
        for chunk in range(0, len(nodes), 512):
            some, f, m = nodes[chunk : chunk + 512], first[chunk : chunk + 512], many[chunk : chunk + 512]
            wide = np.full((len(some), most + int(m.max())), -1, dtype=np.int64)
            wide[:, :most] = links[some]
            row = np.repeat(np.arange(len(some)), m)
            col = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)
            wide[row, most + col] = source[np.repeat(f, m) + col]
            sims = self._sims(self.vectors[some], self.half[some], wide)
            order = np.argsort(-sims, axis=1, kind="stable")
            wide, sims = np.take_along_axis(wide, order, 1), np.take_along_axis(sims, order, 1)
            fits = (wide >= 0).sum(axis=1) <= most
            links[some[fits]] = wide[fits, :most]
            if (~fits).any():
                links[some[~fits]] = self._select(wide[~fits], sims[~fits], most)


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays as one value of bytes, the same for the same arrays."""
    sink = pa.BufferOutputStream()
    sink.write(len(arrays).to_bytes(8, "little"))
    for a in arrays:
        pa.ipc.write_tensor(pa.Tensor.from_numpy(np.ascontiguousarray(a)), sink)
    return sink.getvalue().to_pybytes()


def unpack_arrays(data: bytes) -> list[np.ndarray]:
    source = pa.BufferReader(data)
    return [pa.ipc.read_tensor(source).to_numpy() for _ in range(int.from_bytes(source.read(8), "little"))]
