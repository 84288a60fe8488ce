"""A Katz backoff language model over all training documents, and every document's score under it.

Counts of word pairs and words are discounted by Good-Turing (counts up to 5);
each history's backoff weight is its left-over mass over the unigram mass of the
words not seen after it, so the probabilities of all V + 1 words (one stands for
every unknown word) sum to one exactly.  A token's probability is evaluated
recursively: pair, else weight times word, else weight times unknown word.

The tables (``Tables``), Parquet in the shared folder, readable by any query, dealt to partitions by the
history's hash: ``pairs`` (p, history, and for each word after it its number in the
partition's list, its training count, and the documents it occurs in), ``words`` (p, word_no, word, count: training
count in all documents), ``histories`` (history, total, weight).  Words and histories are 64-bit hashes.

How it is spread.  Tasks cut documents into blocks of some MB and pack their word
pairs into compressed arrays, dealt to partitions by the history's hash; a pair
keeps the list of documents (of its block) that it occurs in.  A partition merges
its blocks into one table, ordered by history.  Word counts are summed in partitions of their own, to which each pair
partition sends its distinct words and gets the totals back.  Then the pairs stream, history by
history, through their partition's task, which adds up sums for the documents of each block.
The number of partitions follows from the bytes of all texts (``PART_BYTES``), so a partition is some MB whatever the input.

Histories that hold a thousandth of all tokens or more, at most a thousand, are
dealt by both words, and their left-over mass is summed over the partitions.  A
history with such a share has it in a block at least, so each block reports only
the words with that share in it.

Cases: null text is empty and has just its end token; a null id counts as the id
''; repeated rows are documents of their own; without training documents every
word is unknown and has probability one; an empty table gives an empty result;
further columns do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch
from .textnum import Words, mix, pieces

CUTOFF = 5
HOT_SHARE = 1000
BLOCK_BYTES = 12 << 20
PART_BYTES = 8 << 20
BLOCK_DOCS = 1 << 16
FOLDS = 10

START = np.uint64(0x53A1)
END = np.uint64(0xE4D1)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes: ascending integers as gaps, integers by planes of equal weight."""
    heads, parts = [], []
    for a in arrays:
        gaps = a.dtype.kind in "iu" and len(a) > 1 and bool((a[1:] >= a[:-1]).all())
        heads.append(f"{a.dtype.str},{len(a)},{int(gaps)}")
        if gaps:
            a = np.concatenate((a[:1], a[1:] - a[:-1]))
        parts.append(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) and a.dtype.kind in "iu" else a.tobytes())
    head = ";".join(heads).encode()
    return zstandard.compress(len(head).to_bytes(4, "little") + head + b"".join(parts), 1)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    n = int.from_bytes(raw[:4], "little")
    out, at = [], 4 + n
    for item in raw[4 : 4 + n].decode().split(";"):
        kind, size, gaps = item.split(",")
        kind, size = np.dtype(kind), int(size)
        if not size:
            a = np.zeros(0, kind)
        elif kind.kind in "iu":
            planes = np.frombuffer(raw, dtype=np.uint8, count=size * kind.itemsize, offset=at).reshape(kind.itemsize, size)
            a = np.ascontiguousarray(planes.T).view(kind).reshape(size)
            if gaps == "1":
                a = np.cumsum(a, dtype=kind)
        else:
            a = np.frombuffer(raw, dtype=kind, count=size, offset=at)
        out.append(a)
        at += size * kind.itemsize
    return out


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == 0


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Marks of the first row of every run of equal keys."""
    first = np.ones(len(keys[0]), dtype=bool)
    if len(first):
        first[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return first


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray, int]]:
    """(document ids, word hashes with an end after each document, tokens of each, bytes) of every block."""
    ids: list = []
    words: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    size = 0
    for batch, buf, offs in pieces(batches):
        w = Words(buf, offs, lower=True)
        ends = np.cumsum(w.per_row)
        words.append(np.insert(w.hashes(), ends, END))
        counts.append(w.per_row + 1)
        ids += batch.column(0).to_pylist()
        size += len(buf)
        if size >= BLOCK_BYTES or len(ids) > BLOCK_DOCS - 257:
            yield ids, np.concatenate(words), np.concatenate(counts), size
            ids, words, counts, size = [], [], [], 0
    if ids:
        yield ids, np.concatenate(words), np.concatenate(counts), size


def _hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, words, _, size in _blocks(batches):
        w, n = np.unique(words, return_counts=True)
        keep = n * HOT_SHARE >= len(words)
        # the block's size rides on a row of its own
        none = np.zeros(keep.sum(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(w[keep], np.uint64(0)).view(np.int64)), pa.array(np.append(n[keep], 0)), pa.array(np.append(none, len(words))), pa.array(np.append(none, size))], names=["w", "n", "tokens", "bytes"])


def _part(h: np.ndarray, w: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    by_history = mix(h ^ np.uint64(0x1F3)) % np.uint64(parts)
    spread = np.isin(h, hot)
    by_history[spread] = mix(h[spread] * np.uint64(3) + w[spread]) % np.uint64(parts)
    return by_history.astype(np.int64)


_EVENT = "p long, block long, payload binary"


def _events(hot: np.ndarray, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for ids, w, n_tokens, _ in _blocks(batches):
            block = (task << 20) + number
            number += 1
            held = np.array([held_out(i) for i in ids])
            known = np.array([i is not None for i in ids])
            rows = [(-1 - block, block, pack(np.array([i or 0 for i in ids], np.int64), known, held, n_tokens.astype(np.int64)))]
            doc = np.repeat(np.arange(len(ids), dtype=np.int32), n_tokens)
            h = np.empty_like(w)
            h[1:] = w[:-1]
            h[_runs(doc)] = START
            part = _part(h, w, hot, parts)
            order = np.argsort(mix(h * np.uint64(0x9E3779B97F4A7C15) + w) >> np.uint64(24) | part.astype(np.uint64) << np.uint64(40), kind="stable")
            h, w, doc, part = h[order], w[order], doc[order], part[order]
            del order
            entry = np.flatnonzero(_runs(part, h, w, doc))
            times = np.diff(np.append(entry, len(w)))
            h, w, doc, part = h[entry], w[entry], doc[entry], part[entry]
            pair = np.flatnonzero(_runs(part, h, w))
            docs_of = np.diff(np.append(pair, len(w)))
            train = np.add.reduceat(np.where(held[doc], 0, times), pair)
            cuts = np.searchsorted(part[pair], np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(cuts)):
                a, b = cuts[p], cuts[p + 1]
                uh, ih = np.unique(h[pair[a:b]], return_inverse=True)
                uw, iw = np.unique(w[pair[a:b]], return_inverse=True)
                # pairs in order of (history, word): small gaps to store
                place = ih.astype(np.int64) * len(uw) + iw
                order = np.argsort(place)
                at = _spread(pair[a:b][order], docs_of[a:b][order])
                rows.append((int(p), block, pack(uh, uw, place[order], train[a:b][order].astype(np.uint32), docs_of[a:b][order].astype(np.uint32), doc[at].astype(np.uint16), times[at].astype(np.uint32))))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["p", "block", "payload"])
            del rows, h, w, doc, part, entry, times, pair, docs_of, train

    return run


_ROW = "kind int, p long, q long, payload binary"
_PAIRS = "history long, words array<int>, counts array<int>, ndocs array<int>, docs array<int>, times array<int>"
LISTS, ASK, ANSWER, PAIR_STATS, WORD_STATS, WORDS, DOCS, HOT_PAIRS, HOT_WORDS, PAIRS, SCORES, HISTORIES = range(12)
#: Numbers of pairs and of their documents in a batch of rows.
ENTRIES = 1 << 18
#: Sums travel as multiples of 1/FIXED: half the bytes of doubles once compressed, and added without rounding.
FIXED = float(1 << 32)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "p", "q", "payload"])


def _merged_rows(rows: list[tuple], pairs: tuple[np.ndarray, ...] | None = None) -> pa.RecordBatch:
    """Rows (kind, p, q, payload), or histories with their lists: (p, history, end of each's pairs, words, counts, ndocs, docs, times)."""
    ints = pa.list_(pa.int32())
    if pairs is None:
        empty = [pa.nulls(len(rows), pa.int64()), *[pa.nulls(len(rows), ints)] * 5]
        head = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.binary()))]
        return pa.RecordBatch.from_arrays([*head, *empty], names=["kind", "p", "q", "payload", "history", "words", "counts", "ndocs", "docs", "times"])
    p, history, ends, words, counts, ndocs, docs, times = pairs
    n = len(history)
    at = pa.array(np.concatenate(([0], ends)).astype(np.int32))
    doc_at = pa.array(np.concatenate(([0], np.cumsum(ndocs)))[np.concatenate(([0], ends))].astype(np.int32))
    lists = [pa.ListArray.from_arrays(o, pa.array(x.astype(np.int32))) for o, x in ((at, words), (at, counts), (at, ndocs), (doc_at, docs), (doc_at, times))]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, PAIRS, np.int32)), pa.array(np.full(n, p)), pa.array(np.full(n, -1)), pa.nulls(n, pa.binary()), pa.array(history.view(np.int64)), *lists], names=["kind", "p", "q", "payload", "history", "words", "counts", "ndocs", "docs", "times"])


def _bins(group: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """By group, what discounted sums follow from: the number of counts 1 to CUTOFF, and the sum of larger ones."""
    out = np.zeros((n, CUTOFF + 1), dtype=np.int64)
    for r in range(1, CUTOFF + 1):
        out[:, r - 1] = np.bincount(group[c == r], minlength=n)
    out[:, CUTOFF] = np.bincount(group[c > CUTOFF], weights=c[c > CUTOFF], minlength=n).astype(np.int64)
    return out


def _merge(parts: int, hot: np.ndarray):
    """Batches (p, block, payload) in order, merged by partition; documents of blocks (p < 0) are passed on."""

    def merged(p: int, blocks: np.ndarray, data: list[bytes]) -> Iterator[pa.RecordBatch]:
        hs, ws, trains, ndocs, entries, times = [], [], [], [], [], []
        for i in range(len(data)):
            uh, uw, place, train, n, doc, t = unpack(data[i])
            data[i] = b""
            hs.append(uh[place // len(uw)])
            ws.append(uw[place % len(uw)])
            trains.append(train)
            ndocs.append(n)
            entries.append(doc.astype(np.int64) + i * BLOCK_DOCS)
            times.append(t)
        h, w = np.concatenate(hs), np.concatenate(ws)
        del hs, ws
        train, n, entry, t = (np.concatenate(x) for x in (trains, ndocs, entries, times))
        del trains, ndocs, entries, times
        order = np.lexsort((w, h))
        starts = (np.cumsum(n, dtype=np.int64) - n)[order]
        h, w, train, n = h[order], w[order], train[order], n[order].astype(np.int64)
        at = _spread(starts, n)
        del order, starts
        entry, t = entry[at], t[at]
        del at
        pair = np.flatnonzero(_runs(h, w))
        count = np.add.reduceat(train.astype(np.int64), pair)
        n = np.add.reduceat(n, pair)
        h, w = h[pair], w[pair]
        heads = np.flatnonzero(_runs(h))
        uh = h[heads]
        ih = np.cumsum(_runs(h)) - 1
        uw, iw = np.unique(w, return_inverse=True)
        docs, entry = np.unique(entry, return_inverse=True)
        docs = blocks[docs // BLOCK_DOCS] * BLOCK_DOCS + docs % BLOCK_DOCS
        rows = [(LISTS, p, -1, pack(uw, docs))]
        ours = np.bincount(iw, weights=count, minlength=len(uw)).astype(np.int64)
        # pairs after a hot history: its sums are spread over the partitions
        at = np.minimum(np.searchsorted(hot, uh), len(hot) - 1)
        at = np.where(hot[at] == uh, at, -1)[ih]
        seen = (at >= 0) & (count > 0)
        some, which = at[seen], iw[seen]
        q = (uw % np.uint64(parts)).astype(np.int64)
        own = q[which]
        for x in np.unique(q):
            mine = np.flatnonzero(q == x)
            of = own == x
            rows.append((ASK, p, int(x), pack(uw[mine], ours[mine], some[of].astype(np.uint16), np.searchsorted(mine, which[of]).astype(np.uint32))))
        if len(some):
            bins = _bins(some, count[seen], len(hot))
            have = np.flatnonzero(bins.any(axis=1))
            rows.append((HOT_PAIRS, p, -1, pack(have, bins[have].ravel())))
        rows.append((PAIR_STATS, p, -1, pack(np.bincount(np.minimum(count, CUTOFF + 2), minlength=CUTOFF + 3)[: CUTOFF + 2].astype(np.int64))))
        yield _merged_rows(rows)
        del rows, some, which, ih, at
        # histories in batches of so many pairs and documents; a longer one alone
        last = np.append(heads[1:], len(w))
        doc_end = np.cumsum(n)
        size = doc_end[last - 1]
        a = 0
        while a < len(uh):
            done = size[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(size, done + ENTRIES, side="right")))
            x, y = heads[a], last[b - 1]
            yield _merged_rows([], (p, uh[a:b], last[a:b] - x, iw[x:y], count[x:y], n[x:y], entry[done : size[b - 1]], t[done : size[b - 1]]))
            a = b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks, data = None, [], []
        for b in batches:
            for p, block, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if p != now and data:
                    yield from merged(now, np.array(blocks, dtype=np.int64), data)
                    blocks, data = [], []
                now = p
                if p < 0:
                    yield _merged_rows([(DOCS, p, block, payload.as_py())])
                    continue
                blocks.append(block)
                data.append(payload.as_py())
        if data:
            yield from merged(now, np.array(blocks, dtype=np.int64), data)

    return run


def _totals(hot: np.ndarray):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        asked = [unpack(x) for x in pdf.payload]
        uw, at = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([a[1] for a in asked]).astype(np.float64), minlength=len(uw)).astype(np.int64)
        rows, begin, bins = [], 0, np.zeros((len(hot), CUTOFF + 1), dtype=np.int64)
        for p, a in zip(pdf.p, asked, strict=True):
            mine = total[at[begin : begin + len(a[0])]]
            rows.append((ANSWER, int(p), int(key[0]), pack(mine.astype(np.uint32 if total.max() < 2**32 else np.uint64))))
            bins += _bins(a[2].astype(np.int64), mine[a[3]], len(hot))
            begin += len(a[0])
        have = np.flatnonzero(bins.any(axis=1))
        rows.append((HOT_WORDS, -1, int(key[0]), pack(have, bins[have].ravel())))
        some = total[total > 0]
        stats = np.bincount(np.minimum(some, CUTOFF + 2), minlength=CUTOFF + 3)[: CUTOFF + 2]
        rows.append((WORD_STATS, -1, int(key[0]), pack(np.append(stats, [some.sum(), len(some)]).astype(np.int64))))
        rows.append((WORDS, -1, int(key[0]), pack(uw[total > 0], some)))
        return _frame(rows)

    return run


def good_turing(n: np.ndarray) -> np.ndarray:
    """Discount factors by count (index 0 to CUTOFF + 1, the last for all above) from counts of counts.

    A factor outside (0, 1] (sparse counts of counts) is taken as 1.
    """
    d = np.ones(CUTOFF + 2)
    n = n.astype(float)
    if n[1] > 0:
        cut = (CUTOFF + 1) * n[CUTOFF + 1] / n[1]
        for r in range(1, CUTOFF + 1):
            if n[r] > 0 and cut < 1:
                x = ((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut)
                if 0 < x <= 1:
                    d[r] = x
    return d


class Model:
    """The constants of a model: discounts, totals and the unknown word's probability."""

    def __init__(self, word_stats: np.ndarray, pair_stats: np.ndarray):
        self.tokens, self.words = int(word_stats[-2]), int(word_stats[-1])
        self.d1, self.d2 = good_turing(word_stats[:-2]), good_turing(pair_stats)
        n = word_stats[1 : CUTOFF + 1].astype(float)
        lost = float((n * np.arange(1, CUTOFF + 1) * (1 - self.d1[1 : CUTOFF + 1])).sum())
        # without discounts one more token is counted, so that some mass is left over
        self.total = self.tokens if lost > 0 else self.tokens + 1
        self.unknown = (self.total - self.tokens + lost) / self.total

    def word(self, c: np.ndarray) -> np.ndarray:
        """Unigram probabilities by training count."""
        return np.where(c > 0, self.d1[np.minimum(c, CUTOFF + 1)] * c / self.total, self.unknown)

    def sums(self, first: np.ndarray, c: np.ndarray, p1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By history: its count, its discounted count, the unigram mass of the words seen after it."""
        seen = c > 0
        return tuple(np.add.reduceat(x, first) for x in (c.astype(float), self.d2[np.minimum(c, CUTOFF + 1)] * c, np.where(seen, p1, 0.0)))

    @staticmethod
    def weights(c: np.ndarray, kept: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(total, backoff weight) by history; an unseen one leaves everything to the words."""
        total = np.where(c - kept > 1e-9 * np.maximum(c, 1), c, c + 1)
        return np.maximum(total, 1), np.where(c > 0, (total - kept) / total / np.maximum(1 - mass, 1e-300), 1.0)


_SCORED = "kind int, block long, payload binary, history long, total double, weight double"


def _score(model: Model, hot: np.ndarray, hot_sums: np.ndarray, parts: int):
    """Rows of partitions in order: their lists, their words' totals, their histories with pairs.  hot_sums: count, discounted count and mass by hot history."""

    class Partition:
        def __init__(self, lists: bytes):
            self.words, self.docs = unpack(lists)
            self.q = (self.words % np.uint64(parts)).astype(np.int64)
            self.total = np.zeros(len(self.words), dtype=np.int64)
            self.sums = np.zeros((3, len(self.docs)))

        def score(self, history, ends, words, count, n, docs, times) -> tuple[np.ndarray, np.ndarray]:
            first = np.append(0, ends[:-1])
            many = np.diff(np.append(0, ends))
            cw = self.total[words]
            p1 = model.word(cw)
            c, kept, mass = model.sums(first, count, p1)
            at = np.searchsorted(hot, history)
            at[at == len(hot)] = 0
            spread = hot[at] == history
            c, kept, mass = (np.where(spread, hot_sums[i][at], x) for i, x in enumerate((c, kept, mass)))
            total_of, weight = model.weights(c, kept, mass)
            p1 *= np.repeat(weight, many)
            seen = count > 0
            p1[seen] = (model.d2[np.minimum(count, CUTOFF + 1)] * count / np.repeat(total_of, many))[seen]
            base = np.log10((cw + 0.1) / (model.tokens + 0.1 * (model.words + 1)))
            pair = np.repeat(np.arange(len(n)), n)
            for i, x in enumerate((np.log10(p1), base, (cw > 0).astype(np.float64))):
                np.add.at(self.sums[i], docs, x[pair] * times)
            return np.where(spread, np.nan, total_of), weight

        def result(self) -> pa.RecordBatch:
            """A row for each block: the sums of its documents."""
            heads = np.flatnonzero(_runs(self.docs // BLOCK_DOCS))
            ends = np.append(heads[1:], len(self.docs))
            local = (self.docs % BLOCK_DOCS).astype(np.uint16)
            fixed = np.rint(self.sums[:2] * FIXED).astype(np.int64)
            payload = [pack(local[i:j], fixed[0][i:j], fixed[1][i:j], self.sums[2][i:j].astype(np.uint32)) for i, j in zip(heads, ends, strict=True)]
            m = len(heads)
            return pa.RecordBatch.from_arrays([pa.array(np.full(m, SCORES, np.int32)), pa.array(self.docs[heads] // BLOCK_DOCS), pa.array(payload, pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64())], names=["kind", "block", "payload", "history", "total", "weight"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part = None, None
        for b in batches:
            kind, p = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cut = np.flatnonzero(_runs(kind, p)) if len(kind) else []
            for i, j in zip(cut, [*cut[1:], len(kind)], strict=True):
                if p[i] != now:
                    if part is not None:
                        yield part.result()
                    now, part = p[i], None
                rows = b.slice(i, j - i)
                if kind[i] == LISTS:
                    part = Partition(rows.column(3)[0].as_py())
                elif kind[i] == ANSWER:
                    for q, data in zip(rows.column(2).to_pylist(), rows.column(3), strict=True):
                        part.total[part.q == q] = unpack(data.as_py())[0].astype(np.int64)
                    continue
                for data in rows.column(3) if kind[i] == PAIRS else ():
                    history, *lists = unpack(data.as_py())
                    total, weight = part.score(history, *[x.astype(np.int64) for x in lists])
                    m = len(history)
                    keep = pa.array(~np.isnan(total))  # hot ones are in many partitions
                    yield pa.RecordBatch.from_arrays([x.filter(keep) for x in (pa.array(np.full(m, HISTORIES, np.int32)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(history.view(np.int64)), pa.array(total), pa.array(weight))], names=["kind", "block", "payload", "history", "total", "weight"])
        if part is not None:
            yield part.result()

    return run


_RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _add_up(tokens: int):
    """Sums the parts of each block, which arrive in order, its documents first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(docs, sums) -> pa.RecordBatch:
            ids, known_id, held, n_tokens = docs
            return pa.RecordBatch.from_arrays([pa.array(ids, mask=~known_id), pa.array(held), pa.array(n_tokens), pa.array(sums[2]), pa.array(np.full(len(ids), tokens)), pa.array(sums[1] / FIXED), pa.array(sums[0] / FIXED)], schema=_RESULT)

        docs, sums, now = None, None, None
        for batch in batches:
            for block, p, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if block != now:
                    if docs is not None:
                        yield result(docs, sums)
                    now, docs = block, unpack(data)
                    sums = np.zeros((3, len(docs[0])), dtype=np.int64)
                else:
                    at, *more = unpack(data)
                    for s, x in zip(sums, more, strict=True):
                        s[at] += x.astype(np.int64)
        if docs is not None:
            yield result(docs, sums)

    return run


@dataclass
class Tables:
    """A model in the shared folder: its constants (``model``) and its tables; words and histories are 64-bit hashes."""

    model: Model
    pairs: DataFrame
    words: DataFrame
    histories: DataFrame


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of partitions with their totals, from rows (kind, p, q, payload) that list them by the partition that sums them."""
    for b in batches:
        for p, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            word, count = unpack(data.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(word), p)), pa.array(word.view(np.int64)), pa.array(count.astype(np.int64))], names=["p", "word", "count"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of pairs as compressed payloads, some histories each, for the way to their partition's task."""
    for b in batches:
        p = b.column(0).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(_runs(p)) if len(p) else []
        for i, j in zip(cut, [*cut[1:], len(p)], strict=True):
            rows = b.slice(i, j - i)
            ends = np.cumsum(rows.column(2).value_lengths().to_numpy(zero_copy_only=False))
            payload = pack(rows.column(1).to_numpy(zero_copy_only=False).view(np.uint64), ends.astype(np.uint32), *[rows.column(k).flatten().to_numpy(zero_copy_only=False).astype(np.uint32) for k in range(2, 7)])
            yield pa.RecordBatch.from_arrays([pa.array([PAIRS], pa.int32()), pa.array([p[i]], pa.int64()), pa.array([-1], pa.int64()), pa.array([payload], pa.binary())], names=["kind", "p", "q", "payload"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for p, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            word = unpack(data.as_py())[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(word), p)), pa.array(np.arange(len(word), dtype=np.int32)), pa.array(word.view(np.int64))], names=["p", "word_no", "word"])


def _run(docs: DataFrame, partitions: int | None) -> tuple[Tables, DataFrame]:
    """(the model's tables, every document's scores)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "katz")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    often = text.mapInArrow(_hot, "w long, n long, tokens long, bytes long").groupBy("w").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"), F.sum("bytes").alias("bytes"))
    often = scratch.put(often, "often")
    tokens, size = often.agg(F.sum("tokens"), F.sum("bytes")).first()
    # a thousand rows at most: each has a thousandth of all tokens; a text's start is a history like these
    hot = np.array([r["w"] for r in often.where((F.col("n") > 0) & (F.col("n") * HOT_SHARE >= (tokens or 0))).select("w").collect()], dtype=np.int64).view(np.uint64)
    hot = np.unique(np.append(hot, START))
    parts = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // PART_BYTES))

    # a task for each partition; the documents of blocks go along with any
    events = text.mapInArrow(_events(hot, parts), _EVENT)
    events = events.repartitionById(parts, F.pmod("p", F.lit(parts)).cast("int")).sortWithinPartitions("p", "block")
    merged = scratch.put(events.mapInArrow(_merge(parts, hot), f"{_ROW}, {_PAIRS}"), "pairs", "zstd", "kind")
    asked = merged.where(F.col("kind") == ASK).select("kind", "p", "q", "payload")
    answered = scratch.put(asked.groupBy("q").applyInPandas(_totals(hot), _ROW), "words", "zstd", "kind")
    # the questions are done with
    scratch.remove(f"{merged._scratch_path}/kind={ASK}")

    def small(df: DataFrame, kind: int) -> list[list[np.ndarray]]:
        """One small row for each partition."""
        return [unpack(bytes(r["payload"])) for r in df.where(F.col("kind") == kind).select("payload").toLocalIterator()]

    def add(df: DataFrame, kind: int, size: int) -> np.ndarray:
        return np.sum([x[0] for x in small(df, kind)] or [np.zeros(size, np.int64)], axis=0, dtype=np.int64)

    def bins(df: DataFrame, kind: int) -> np.ndarray:
        out = np.zeros((len(hot), CUTOFF + 1), dtype=np.int64)
        for have, x in small(df, kind):
            out[have] += x.reshape(-1, CUTOFF + 1)
        return out

    model = Model(add(answered, WORD_STATS, CUTOFF + 4), add(merged, PAIR_STATS, CUTOFF + 2))
    r = np.append(np.arange(1, CUTOFF + 1), 1)  # the last bin holds a sum already
    after, among = bins(merged, HOT_PAIRS) * r, bins(answered, HOT_WORDS) * r
    hot_sums = np.stack((after.sum(axis=1), after @ model.d2[1:], among @ model.d1[1:] / model.total))

    pairs = merged.where(F.col("kind") == PAIRS).select("p", "history", "words", "counts", "ndocs", "docs", "times")
    rows = [x.select("kind", "p", "q", "payload") for x in (merged.where(F.col("kind") == LISTS), answered.where(F.col("kind") == ANSWER), pairs.mapInArrow(_packed, _ROW))]
    turn = F.when(F.col("kind") == LISTS, 0).when(F.col("kind") == ANSWER, 1).otherwise(2)
    streams = rows[0].unionAll(rows[1]).unionAll(rows[2]).repartitionById(parts, F.col("p").cast("int")).sortWithinPartitions("p", turn, "q")
    scored = scratch.put(streams.mapInArrow(_score(model, hot, hot_sums, parts), _SCORED), "scores", "zstd", "kind")

    listed = merged.where(F.col("kind") == DOCS).select(F.col("q").alias("block"), F.lit(0).alias("turn"), "payload")
    sums = scored.where(F.col("kind") == SCORES).select("block", F.lit(1).alias("turn"), "payload")
    parts_of = listed.unionByName(sums).repartition("block").sortWithinPartitions("block", "turn")
    scores = parts_of.select("block", "turn", "payload").mapInArrow(_add_up(model.tokens), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

    total, weight = model.weights(*hot_sums)
    seen = spark.createDataFrame([(int(h), float(t), float(x)) for h, t, x in zip(hot.view(np.int64), total, weight, strict=True)], "history long, total double, weight double")
    histories = scored.where(F.col("kind") == HISTORIES).select("history", "total", "weight").unionAll(seen)
    counts = answered.where(F.col("kind") == WORDS).select("q", "payload").mapInArrow(_listed, "p long, word long, count long").drop("p")
    numbers = merged.where(F.col("kind") == LISTS).select("p", "payload").mapInArrow(_numbered, "p long, word_no int, word long")
    words = numbers.join(counts, "word", "left").select("p", "word_no", "word", F.coalesce("count", F.lit(0).cast("long")).alias("count"))
    return Tables(model, pairs, words, histories), scores


def katz_model(docs: DataFrame, partitions: int | None = None) -> Tables:
    """The model learned from the documents that are not held out."""
    return _run(docs, partitions)[0]


def katz_scores(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Every document's score under the model learned from the documents that are not held out."""
    return _run(docs, partitions)[1]
