"""Exact repeats of 100 bytes across documents, by merging Burrows-Wheeler transforms.

1. Winnowing: every window of 100 bytes has an anchor, the least 32-byte gram in it,
   so equal windows have equal anchors at equal places.  An anchor's context is the
   bytes of all its windows.  Contexts are dealt by the anchor's hash as (anchor's hash,
   context's hash, place), without bytes.  Equal contexts collapse, in each batch of a
   task and again where they meet: the earliest stays, the others are covered whole.  So a
   passage that any number of documents share, and whole copies, are one context a batch.
   Contexts whose anchor has no other context are done; this drops most text.
2. Of the distinct contexts that share an anchor with another, the bytes are fetched
   and cut into units of up to 17 windows.  Units whose core (the bytes common to all their
   windows) occurs in no other unit are dropped.
3. Units that share a core and differ at the ends are merged: the units of a bucket
   are dealt to shards, each shard gets a suffix array and its Burrows-Wheeler
   transform, and the shards' transforms are interleaved.  The interleave starts
   in order of the shards and is refined by two characters a round, the
   transform's symbols moving the rows to their places; blocks of rows with a
   common prefix are split on the way, and rows alone in their block leave.
   After 50 rounds a block is a repeated interval: suffixes with a common prefix of 100 bytes.
   In each the earliest occurrence stays; the other windows are covered.
4. The covered windows of a document are united and its bytes removed.

The number of buckets follows from measured bytes, of the texts in step 1 and of the
contexts in step 2, so a group is some MB whatever the input.  An anchor with over
``HOT_CONTEXTS`` distinct contexts is not gathered in a bucket: its contexts are cut into units
of one window, whose core is the whole window, dealt by its two 64-bit hashes and
collapsed in each batch first.

Cases: null text counts as empty; texts under 100 bytes lose nothing; a long text is read
in pieces of a quarter of a MB; rows of one id and one text are one document; rows of one id with
different texts are documents of their own, in order of their texts' hashes; a row without
id can be neither earlier nor later than another and keeps its bytes; an empty table gives
an empty result; further columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum
from .katz import _runs, _spread, pack, unpack
from .store import Scratch
from .textnum import mix, pieces, powers

LENGTH = 100
GRAM = 32
WINDOW = LENGTH - GRAM + 1
UNIT = 17
SHARD_BYTES = 1 << 18
BATCH_BYTES = 1 << 23
CONTEXT_BATCH = 1 << 21
CHUNK = 1 << 18
PIECE = 1 << 18
#: Bytes of text, and of contexts, for each bucket.
BUCKET_TEXT = 12 << 20
BUCKET_CONTEXTS = 1 << 20
HOT_CONTEXTS = 1 << 13
#: Documents with ambiguous ids up to which they are broadcast.
BROADCAST_IDS = 200_000
#: Ends a unit in a shard's text; no byte of UTF-8 has this value.
STOP = 0xFF
#: An anchor is the least gram by the upper bits of its hash; the lower ones hold its place, so equals are decided by the first.
_LOW = np.uint64((1 << 31) - 1)


def _prefix(buf: np.ndarray) -> np.ndarray:
    h = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(textnum._VALUE[buf] * powers(textnum._BASE, len(buf)), out=h[1:], dtype=np.uint64)
    return h


def _hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((h[end] - h[start]) * powers(textnum._INVERSE, len(h))[start])


def anchors(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, context's hash, place, first start, last start) of each anchor and the windows that have it."""
    n = len(buf)
    empty = np.zeros(0, np.int64)
    long = np.diff(offs) >= LENGTH
    if not long.any():
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty
    h = _prefix(buf)
    gram = mix((h[GRAM:] - h[:-GRAM]) * powers(textnum._INVERSE, n + 1)[: n + 1 - GRAM])
    least = (gram & ~_LOW) | np.arange(len(gram), dtype=np.uint64)
    width = 1
    while 2 * width <= WINDOW:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (WINDOW - width)], least[WINDOW - width :])
    starts = _spread(offs[:-1][long], np.diff(offs)[long] - LENGTH + 1)
    place = (least[starts] & _LOW).astype(np.int64)
    run = np.flatnonzero(_runs(place))
    del least
    place, lo, hi = place[run], starts[run], starts[np.append(run[1:], len(starts)) - 1]
    # windows of one anchor in one document are neighbours, so a context is one stretch of bytes
    context = mix(_hash(h, lo, hi + LENGTH) + (place - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (hi - lo).astype(np.uint64)) ^ mix(gram[place] + np.uint64(7))
    return gram[place], context, place, lo, hi


def _chunks(batches: Iterator[pa.RecordBatch]):
    """Slices of (doc_id, sub, text, ...) as (slice, bytes, offsets, row's place of the first byte); a long row comes in overlapping chunks."""
    for batch, buf, offs in pieces(batches, most_bytes=PIECE):
        if batch.num_rows > 1 or len(buf) <= 2 * CHUNK:
            yield batch, buf, offs, 0
            continue
        for at in range(0, len(buf) - LENGTH + 1, CHUNK):
            part = buf[at : at + CHUNK + LENGTH - 1]
            yield batch, part, np.array([0, len(part)]), at


def _dealt(q: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(q, kind="stable")
    cut = np.searchsorted(q[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cut)):
        yield int(p), order[cut[p] : cut[p + 1]]


def _ranks(ids: np.ndarray, subs: np.ndarray) -> np.ndarray:
    """Places of documents in the order of (id, sub), equal for equal ones."""
    order = np.lexsort((subs, ids))
    out = np.empty(len(ids), dtype=np.int64)
    out[order] = np.cumsum(_runs(ids[order], subs[order])) if len(ids) else 0
    return out


def _places(rank: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One sortable number for a document's rank in a group and a place in it (texts have under 2**31 bytes)."""
    return rank << np.int64(31) | at


def _later(where: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Marks, in rows sorted by key and place, of those at another place than the first of their key; head marks the first ones."""
    first = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
    return where != where[first]


def _by_document(ids: np.ndarray, subs: np.ndarray, own: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(id, sub, rows as bytes) of each document; own: the document's index of every row."""
    if not len(own):
        return []
    order = np.argsort(own, kind="stable")
    own, rows = own[order], rows[order]
    head = np.flatnonzero(_runs(own))
    return [(int(ids[own[a]]), int(subs[own[a]]), rows[a:b].tobytes()) for a, b in zip(head, [*head[1:], len(own)], strict=True)]


_FOUND = "doc_id long, sub long, spans binary, wants binary, size long"


def _found(spans: list[tuple[int, int, bytes]], wants: list[tuple[int, int, bytes]] = (), sizes: list[int] = ()) -> pd.DataFrame:
    rows = [(i, s, _joined(x), None, 0) for i, s, x in spans] + [(i, s, None, x, n) for (i, s, x), n in zip(wants, sizes, strict=True)]
    return pd.DataFrame(rows, columns=["doc_id", "sub", "spans", "wants", "size"])


def _joined(spans: bytes) -> bytes:
    return united(np.frombuffer(spans, dtype=np.int64).reshape(-1, 2)).tobytes()


def _rows(out: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["p", "payload"])


def _pass_on(payload: bytes, number: int) -> tuple[int, bytes]:
    """A payload of finished spans under a key of its own: below zero, and spread."""
    return -1 - int(hashlib.blake2b(payload + number.to_bytes(8, "little"), digest_size=4).hexdigest(), 16), payload


def _anchor_rows(parts: int):
    """Packed rows (bucket, payload) of a batch's distinct contexts, and of the spans that the batch itself covers."""

    def send(found) -> pa.RecordBatch:
        ids, subs, doc, h, g, lo, rel, starts = (np.concatenate(x) for x in zip(*found, strict=True))
        where = _places(_ranks(ids, subs)[doc], lo)
        order = np.lexsort((where, g))
        head = _runs(g[order])
        later = order[_later(where[order], head)]
        out = []
        if len(later):
            own, at = np.unique(doc[later], return_inverse=True)
            out.append(_pass_on(pack(ids[own], subs[own], at.astype(np.uint32), lo[later], starts[later].astype(np.uint8)), len(found)))
        first = order[head]
        for p, some in _dealt((h[first] % np.uint64(parts)).astype(np.int64), parts):
            some = first[some]
            own, at = np.unique(doc[some], return_inverse=True)
            out.append((p, pack(ids[own], subs[own], at.astype(np.uint32), h[some], g[some], lo[some].astype(np.uint32), rel[some].astype(np.uint8), starts[some].astype(np.uint8))))
        return _rows(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size, count = [], 0, 0
        for batch, buf, offs, base in _chunks(batches):
            h, g, place, lo, hi = anchors(buf, offs)
            row = np.searchsorted(offs, place, side="right") - 1
            ids, subs = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            found.append((ids, subs, row + count, h, g, lo - offs[row] + base, place - lo, hi - lo + 1))
            size += len(buf)
            count += batch.num_rows
            if size >= BATCH_BYTES:
                yield send(found)
                found, size, count = [], 0, 0
        if found:
            yield send(found)

    return run


def _gathered(payloads: list[bytes]) -> tuple[np.ndarray, ...]:
    """(ids, subs, document's index, ...) of some payloads that begin with these."""
    got = [unpack(x) for x in payloads]
    base = np.cumsum([0, *(len(x[0]) for x in got)])
    out = [np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got]), np.concatenate([x[2].astype(np.int64) + b for x, b in zip(got, base, strict=False)])]
    return (*out, *(np.concatenate(x) for x in list(zip(*got, strict=True))[3:]))


def _shared(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket of contexts: spans of those that begin earlier elsewhere, and the distinct ones that share an anchor."""
    if key[0] < 0:
        found = []
        for payload in pdf.payload:
            ids, subs, own, lo, starts = unpack(payload)
            found += _by_document(ids, subs, own, np.stack((lo, lo + starts.astype(np.int64) - 1 + LENGTH), axis=1))
        return _found(found)
    ids, subs, doc, h, g, lo, rel, starts = _gathered(pdf.payload.tolist())
    del pdf
    lo, starts = lo.astype(np.int64), starts.astype(np.int64)
    where = _places(_ranks(ids, subs)[doc], lo)
    order = np.lexsort((where, g, h))
    h, g, where = h[order], g[order], where[order]
    head = _runs(h, g)
    later = order[_later(where, head)]
    spans = _by_document(ids, subs, doc[later], np.stack((lo[later], lo[later] + starts[later] - 1 + LENGTH), axis=1))
    anchor = np.cumsum(_runs(h)) - 1
    many = np.bincount(anchor[head], minlength=int(anchor[-1]) + 1 if len(anchor) else 0)[anchor]
    at = np.flatnonzero(head & (many > 1))
    some = order[at]
    facts = rel[some].astype(np.int64) | starts[some] << 8 | (many[at] > HOT_CONTEXTS).astype(np.int64) << 16
    wants = _by_document(ids, subs, doc[some], np.stack((lo[some], h[at].view(np.int64), facts), axis=1))
    return _found(spans, wants, [int(((np.frombuffer(x, dtype=np.int64).reshape(-1, 3)[:, 2] >> 8 & 0xFF) + LENGTH - 1).sum()) for _, _, x in wants])


def _contexts(parts: int):
    """Packed rows (bucket, payload) of the bytes of wanted contexts of (doc_id, sub, text, wants)."""

    def send(rows) -> pa.RecordBatch:
        h, doc, sub, lo, rel, starts, hot, text = (np.concatenate(x) for x in zip(*rows, strict=True))
        size = starts + LENGTH - 1
        begin = np.cumsum(size) - size
        out = []
        plain = np.flatnonzero(~hot)
        for p, some in _dealt((h[plain] % np.uint64(parts)).astype(np.int64), parts):
            some = plain[some]
            own, at = np.unique(np.stack((doc[some], sub[some])), axis=1, return_inverse=True)
            out.append((p, pack(own[0], own[1], at.ravel().astype(np.uint32), h[some], lo[some].astype(np.uint32), rel[some].astype(np.uint8), starts[some].astype(np.uint8), text[_spread(begin[some], size[some])])))
        if hot.any():
            out += windows(doc[hot], sub[hot], lo[hot], begin[hot], starts[hot], text, len(rows))
        return _rows(out)

    def windows(doc, sub, lo, begin, starts, text, number) -> list[tuple[int, bytes]]:
        """Units of one window, by their hashes; those that the batch has twice are collapsed."""
        p = _prefix(text)
        at = _spread(begin, starts)
        own = np.repeat(np.arange(len(lo)), starts)
        one, two = _hash(p, at, at + LENGTH), _hash(p, at, at + LENGTH // 2) * np.uint64(3) ^ _hash(p, at + LENGTH // 2, at + LENGTH)
        doc, sub, place = doc[own], sub[own], lo[own] + at - begin[own]
        where = _places(_ranks(doc, sub), place)
        order = np.lexsort((where, two, one))
        head = _runs(one[order], two[order])
        later = order[_later(where[order], head)]
        out = []
        if len(later):
            out.append(_pass_on(_named(doc[later], sub[later], place[later], np.ones(len(later), np.uint8)), number))
        first = order[head]
        for q, some in _dealt((one[first] % np.uint64(parts)).astype(np.int64), parts):
            some = first[some]
            out.append((parts + q, _named(doc[some], sub[some], place[some], one[some], two[some])))
        return out

    def _named(doc, sub, *more) -> bytes:
        own, at = np.unique(np.stack((doc, sub)), axis=1, return_inverse=True)
        return pack(own[0], own[1], at.ravel().astype(np.uint32), *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch, buf, offs in pieces(batches, most_bytes=PIECE):
            wants = [np.frombuffer(b"".join(x), dtype=np.int64).reshape(-1, 3) for x in batch.column(3).to_pylist()]
            row = np.repeat(np.arange(len(wants)), [len(x) for x in wants])
            lo, h, facts = np.concatenate(wants).T
            rel, starts = facts & 0xFF, facts >> 8 & 0xFF
            ids, subs = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            rows.append((np.ascontiguousarray(h).view(np.uint64), ids[row], subs[row], lo, rel, starts, facts >> 16 > 0, buf[_spread(lo + offs[row], starts + LENGTH - 1)]))
            size += len(rows[-1][-1])
            if size >= CONTEXT_BATCH:
                yield send(rows)
                rows, size = [], 0
        if rows:
            yield send(rows)

    return run


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` in order of their first ``depth`` bytes at least, by doubling ranks."""
    n = len(text)
    wide = np.zeros(n + 8, dtype=np.uint64)
    wide[:n] = text
    key = np.zeros(n, dtype=np.uint64)
    for j in range(8):
        key = key << np.uint64(8) | wide[j : j + n]
    reach = 8
    while True:
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, dtype=np.uint64)
        rank[order] = np.cumsum(_runs(key[order])).astype(np.uint64)
        if reach >= depth:
            return order
        ahead = np.zeros(n, dtype=np.uint64)
        ahead[: max(n - reach, 0)] = rank[reach:]
        key = rank << np.uint64(32) | ahead
        reach *= 2


class Shard:
    """Units of a shard as one text, its suffix array and what its transform says of two characters at once."""

    def __init__(self, text: np.ndarray, size: np.ndarray):
        # units one after the other, each ended by STOP
        n = len(text) + len(size)
        full = np.full(n, STOP, dtype=np.uint8)
        ends = np.cumsum(size + 1) - 1
        inside = np.ones(n, dtype=bool)
        inside[ends] = False
        full[inside] = text
        self.order = suffix_array(full, LENGTH + 2)
        where = np.empty(n, dtype=np.int64)
        where[self.order] = np.arange(n)
        before = np.concatenate(([STOP, STOP], full)).astype(np.uint16)
        # the transform: the character before each suffix, and the one before that
        pair = before[:-1] << np.uint16(8) | before[1:]
        self.pair = pair[: n][self.order] if n else pair[:0]
        back = np.arange(n) - 2
        # rows to which a round moves; -1 where a unit would be left
        crosses = (self.pair >> np.uint16(8) == STOP) | (self.pair & np.uint16(0xFF) == STOP)
        self.moved = np.where(crosses, -1, where[np.maximum(back, 0)][self.order])
        # only suffixes this far into a unit have a window's 100 bytes in front of them
        offset = _spread(np.zeros(len(size), np.int64), size + 1)
        self.leads = np.flatnonzero(offset[self.order] >= LENGTH)


def merge(shards: list[Shard]) -> tuple[np.ndarray, np.ndarray]:
    """Interleaves the shards' transforms: (row, block) of suffixes that share 100 bytes with another.

    Rows are numbered through the shards.  A row's symbols come from its shard's
    transform, and its place among equals is kept, so each round sorts suffixes by
    two more characters in front.
    """
    base = np.cumsum([0, *(len(s.order) for s in shards)])
    pair = np.concatenate([s.pair for s in shards])
    moved = np.concatenate([np.where(s.moved >= 0, s.moved + b, -1) for s, b in zip(shards, base, strict=False)])
    row = np.concatenate([s.leads + b for s, b in zip(shards, base, strict=False)])
    block = np.zeros(len(row), dtype=np.int64)
    for _ in range(LENGTH // 2):
        # the interleave's next round: rows move to their predecessors, in order of the transform's symbols
        target = moved[row]
        alive = target >= 0
        row, block, target = row[alive], block[alive], target[alive]
        symbol = pair[row]
        order = np.argsort(symbol, kind="stable")
        symbol, block, row = symbol[order], block[order], target[order]
        head = _runs(symbol, block)
        # a suffix alone in its block shares its prefix with none, and nor do those that end in it
        alone = head & np.append(head[1:], True)
        block = np.cumsum(head)[~alone]
        row = row[~alone]
        if not len(row):
            break
    return row, block


def _covered(parts: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            return _shared(key, pdf)
        return _windows(pdf.payload.tolist()) if key[0] >= parts else _merged(pdf.payload.tolist())

    return run


def _windows(payloads: list[bytes]) -> pd.DataFrame:
    """Spans of single windows that begin earlier elsewhere too."""
    ids, subs, doc, lo, one, two = _gathered(payloads)
    where = _places(_ranks(ids, subs)[doc], lo)
    order = np.lexsort((where, two, one))
    later = order[_later(where[order], _runs(one[order], two[order]))]
    return _found(_by_document(ids, subs, doc[later], np.stack((lo[later], lo[later] + LENGTH), axis=1)))


def _merged(payloads: list[bytes]) -> pd.DataFrame:
    """By document, spans of a bucket's windows that begin earlier elsewhere too."""
    ids, subs, doc, h, lo, rel, starts, text = _gathered(payloads)
    del payloads
    lo, rel, starts = lo.astype(np.int64), rel.astype(np.int64), starts.astype(np.int64)
    rank = _ranks(ids, subs)
    size = starts + LENGTH - 1
    begin = np.cumsum(size) - size
    # units: windows of a context whose distance to the anchor has one quotient by UNIT
    far, near = rel // UNIT, (rel - starts + 1) // UNIT
    many = far - near + 1
    ctx = np.repeat(np.arange(len(h)), many)
    part = np.repeat(far, many) - _spread(np.zeros(len(h), np.int64), many)
    first = np.maximum(rel[ctx] - part * UNIT - (UNIT - 1), 0)
    last = np.minimum(rel[ctx] - part * UNIT, starts[ctx] - 1)
    count = last - first + 1
    at = begin[ctx] + first
    p = _prefix(text)
    # the core is the same for all units of an anchor and a part: what lies in all 17 windows, cut to what each unit has
    core_lo = begin[ctx] + rel[ctx] - part * UNIT
    core = _hash(p, core_lo, core_lo - (UNIT - 1) + LENGTH) ^ mix(part.astype(np.uint64)) ^ h[ctx]
    unit = _hash(p, at, at + count - 1 + LENGTH) ^ mix((first - rel[ctx] + 256).astype(np.uint64))
    del p
    udoc, ulo = doc[ctx], lo[ctx] + first
    where = _places(rank[udoc], ulo)
    order = np.lexsort((where, unit, core))
    core, unit, udoc, ulo, count, at, where = (x[order] for x in (core, unit, udoc, ulo, count, at, where))
    new_core, new_unit = _runs(core), _runs(core, unit)
    again = _later(where, new_unit)  # equal to an earlier unit: all its windows are covered
    docs, los, counts = [udoc[again]], [ulo[again]], [count[again]]
    heads = np.flatnonzero(new_unit)
    group = np.cumsum(new_core[heads]) - 1
    multi = heads[np.bincount(group)[group] > 1] if len(heads) else heads
    if len(multi):
        udoc, ulo, count, at = udoc[multi], ulo[multi], count[multi], at[multi]
        usize = count - 1 + LENGTH
        shard = np.cumsum(usize) // SHARD_BYTES
        shards = []
        for s in range(int(shard[-1]) + 1):
            own = shard == s
            if own.any():
                shards.append(Shard(text[_spread(at[own], usize[own])], usize[own]))
        row, block = merge(shards)
        # a row's place in the shards' texts, which is the unit's and its offset in it
        place = np.concatenate([s.order + b for s, b in zip(shards, np.cumsum([0, *(len(s.order) for s in shards)]), strict=False)])[row]
        unit_begin = np.cumsum(usize + 1) - (usize + 1)
        u = np.searchsorted(unit_begin, place, side="right") - 1
        wdoc, wlo = udoc[u], ulo[u] + place - unit_begin[u]
        where = _places(rank[wdoc], wlo)
        order = np.lexsort((where, block))
        later = order[_later(where[order], _runs(block[order]))]
        docs.append(wdoc[later])
        los.append(wlo[later])
        counts.append(np.ones(len(later), np.int64))
    d, w, c = (np.concatenate(x) for x in (docs, los, counts))
    return _found(_by_document(ids, subs, d, np.stack((w, w + c - 1 + LENGTH), axis=1)))


def united(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of covered bytes from (start, end) rows."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    head = np.flatnonzero(np.concatenate(([True], spans[1:, 0] > reach[:-1])))
    return np.stack((spans[head, 0], reach[np.append(head[1:], len(spans)) - 1]), axis=1)


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, buf, offs in pieces(batches, most_bytes=PIECE):
        out = []
        for doc_id, spans, begin, end in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            runs = united(np.frombuffer(b"".join(spans or []), dtype=np.int64).reshape(-1, 2))
            kept, at, size = hashlib.sha256(), begin, end - begin
            for a, b in (runs + begin).tolist():
                kept.update(buf[at:a])
                at = b
            kept.update(buf[at:end])
            out.append((doc_id, size, int((runs[:, 1] - runs[:, 0]).sum()), len(runs), kept.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _RESULT, strict=True)], schema=_RESULT)


def _told_apart(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """(doc_id, text, sub) of ``docs`` and their bytes; sub is 0, or the text's hash where an id has several texts."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = F.xxhash64("text")
    by_id = base.groupBy("doc_id").agg(F.min(own).alias("a"), F.max(own).alias("b"), F.sum(F.octet_length("text")).alias("bytes"))
    by_id = scratch.put(by_id.select("doc_id", "bytes", (F.col("a") != F.col("b")).alias("several")), "ids")
    several = by_id.where("several and doc_id is not null").select("doc_id")
    size, n = by_id.agg(F.sum("bytes"), F.count(F.when(F.col("several") & F.col("doc_id").isNotNull(), 1))).first()
    if not n:
        return base.withColumn("sub", F.lit(0).cast("long")), size or 0
    several = several.withColumn("sub", F.lit(True))
    marked = base.join(F.broadcast(several) if n <= BROADCAST_IDS else several, "doc_id", "left")
    return marked.select("doc_id", "text", F.when(F.col("sub"), own).otherwise(0).cast("long").alias("sub")), size or 0


def repeated_spans(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """``docs`` as (doc_id, text, spans): the covered spans (start, end) of bytes, packed as 64-bit integers."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    base, size = _told_apart(docs, scratch)
    # several buckets for each partition of a shuffle, which evens out what falls together
    least = partitions or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-size // BUCKET_TEXT))
    own = base.where("doc_id is not null and text is not null").select("doc_id", "sub", "text")
    rows = own.mapInArrow(_anchor_rows(parts), "p long, payload binary")
    shared = scratch.put(rows.groupBy("p").applyInPandas(_shared, _FOUND), "shared")
    wanted = shared.agg(F.sum("size")).first()[0] or 0
    parts = max(least, -(-wanted // BUCKET_CONTEXTS))
    wants = shared.where("wants is not null").groupBy("doc_id", "sub").agg(F.collect_list("wants").alias("wants"))
    contexts = own.join(wants, ["doc_id", "sub"]).select("doc_id", "sub", "text", "wants").mapInArrow(_contexts(parts), "p long, payload binary")
    merged = scratch.put(contexts.groupBy("p").applyInPandas(_covered(parts), _FOUND), "merged")
    spans = shared.select("doc_id", "sub", "spans").unionAll(merged.select("doc_id", "sub", "spans")).where("spans is not null")
    spans = spans.groupBy("doc_id", "sub").agg(F.collect_list("spans").alias("spans"))
    return base.join(spans, ["doc_id", "sub"], "left").select("doc_id", "text", "spans")


def repeat_report(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Per document: bytes, bytes removed, maximal removed runs, digest of what is kept."""
    return repeated_spans(docs, partitions).mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
