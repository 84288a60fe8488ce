"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

The vocabulary of a SentencePiece model file gives pieces and scores.  Texts are
turned into code points (a space becomes U+2581, and one is put in front of a
text) and cut into units, each a run of U+2581 with what follows; pieces never
reach over a unit's end, so the best segmentation of a text is that of its units.
Distinct units of equal length advance together: hashes of all substrings up to
the longest piece probe the sorted keys of the pieces, and at each position a
vectorised maximum over the lengths stores score and backpointer.  Code points
without a piece are encoded as their UTF-8 bytes.

A unit above ``LONG`` code points is cut first, where its best segmentation has a cut: windows
of it advance together, once for each place near a window's begin at which the last piece may
have ended; the windows' tables of best sums (from such a place to such a place) are then
combined in order.  What lies between two cuts is an ordinary unit.

The search takes the segmentation with the highest sum of scores.  For a model of
the unigram type that is its own encoding; a model of the BPE type would merge
greedily instead, and its scores (minus a merge's rank) are used as they are.  The
identifiers decode to the text exactly either way; a literal U+2581 in a text is
encoded as bytes, so it comes back too.

Cases: null text counts as empty and has no tokens; a null id is kept; texts and
units of any length are encoded whole; equal sums of scores take the longer last
piece (in a unit above ``LONG``, inside a window's stretch); repeated rows give repeated results; an empty table gives an empty result;
further columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textnum import mix, pieces, powers

SPACE = 0x2581
LITERAL = 0x110000  # stands for a U+2581 of the text itself
LONG = 2048
WINDOW = 1024
GIANT = 8 << 20  # bytes above which a text is encoded in stretches
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


@dataclass
class Vocabulary:
    """Piece keys in sorted order with their identifiers and scores, and what every identifier decodes to."""

    keys: np.ndarray
    ids: np.ndarray
    scores: np.ndarray
    longest: int
    byte_ids: np.ndarray
    flat: np.ndarray
    starts: np.ndarray
    unknown: float


def _finish(h: np.ndarray, length) -> np.ndarray:
    return mix(h + np.uint64(1) * np.asarray(length).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _key(points: np.ndarray) -> int:
    return int(_finish(np.sum((points.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(points)), dtype=np.uint64)[None], [len(points)])[0])


def load_vocabulary(model_file: str | None = None) -> Vocabulary:
    """Read a model file on the driver; some 32,000 pieces, a size fixed by the file."""
    import sentencepiece

    if model_file is None:
        import public_tokenizers

        model_file = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = model.get_piece_size()
    byte_ids = np.zeros(256, dtype=np.int32)
    text: list[bytes] = []
    keys: dict[int, tuple[int, float]] = {}
    longest, least = 1, 0.0
    for i in range(n):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            text.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            text.append(b"")
        else:
            points = np.frombuffer(piece.encode("utf-32-le"), dtype=np.uint32)
            if np.any((points[1:] == SPACE) & (points[:-1] != SPACE)):
                raise ValueError(f"piece {i} reaches over a unit's end")
            text.append(piece.replace("▁", " ").encode())
            score = model.get_score(i)
            keys[_key(points)] = (i, score)
            longest = max(longest, len(points))
            if score > -1e8:
                least = min(least, score)
    order = np.array(sorted(keys), dtype=np.uint64)
    return Vocabulary(order, np.array([keys[int(k)][0] for k in order], np.int32), np.array([keys[int(k)][1] for k in order]), longest, byte_ids, np.frombuffer(b"".join(text), dtype=np.uint8), np.cumsum([0, *map(len, text)]), least - 10)


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every range, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def _segment(v: Vocabulary, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best segmentations of n units of one length L, an n x L matrix: (identifiers or -1, piece lengths), both n x L from the right, 0 length where done."""
    n, size = points.shape
    most = min(size, v.longest)
    h = np.zeros((n, size + 1), dtype=np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * powers(_BASE, size), axis=1, out=h[:, 1:], dtype=np.uint64)
    inverse = powers(_INVERSE, size + 1)
    score = np.full((most + 1, n, size + 1), -np.inf)
    piece = np.full((most + 1, n, size + 1), -1, dtype=np.int32)
    for length in range(1, most + 1):
        key = _finish((h[:, length:] - h[:, : size + 1 - length]) * inverse[: size + 1 - length], [length])
        at = np.searchsorted(v.keys, key)
        at[at == len(v.keys)] = 0
        hit = v.keys[at] == key
        score[length, :, length:] = np.where(hit, v.scores[at], v.unknown if length == 1 else -np.inf)
        piece[length, :, length:] = np.where(hit, v.ids[at], -1)
    best = np.full((n, size + 1), -np.inf)
    best[:, 0] = 0
    back = np.zeros((n, size + 1), dtype=np.int64)
    for j in range(1, size + 1):
        top = min(j, most)
        # longest first, so that a tie takes the longer piece
        tried = best[:, j - top : j] + score[top:0:-1, :, j].T
        pick = np.argmax(tried, axis=1)
        back[:, j] = top - pick
        best[:, j] = np.take_along_axis(tried, pick[:, None], axis=1)[:, 0]
    ids = np.full((n, size), -1, dtype=np.int32)
    lengths = np.zeros((n, size), dtype=np.int64)
    pos = np.full(n, size)
    every = np.arange(n)
    for step in range(size):
        live = np.flatnonzero(pos > 0)
        if not len(live):
            break
        length = back[live, pos[live]]
        ids[live, step] = piece[length, live, pos[live]]
        lengths[live, step] = length
        pos[live] -= length
    del every
    return ids, lengths


def _bytes_of(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of code points and how many each has."""
    points = np.where(points == LITERAL, SPACE, points).astype(np.uint32)
    text = points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    return raw, 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)


def _window_sums(v: Vocabulary, points: np.ndarray) -> np.ndarray:
    """Best sums of n windows (rows of K - 1 code points before the window, then the window) as n x K x K: from a last cut e places before the begin to one f places before the end."""
    n, size = points.shape
    most = v.longest
    h = np.zeros((n, size + 1), dtype=np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * powers(_BASE, size), axis=1, out=h[:, 1:], dtype=np.uint64)
    inverse = powers(_INVERSE, size + 1)
    score = np.full((size + 1, n, most), -np.inf)  # by end, window, and place of the begin among the K before the end
    for length in range(1, min(size, most) + 1):
        key = _finish((h[:, length:] - h[:, : size + 1 - length]) * inverse[: size + 1 - length], [length])
        at = np.searchsorted(v.keys, key)
        at[at == len(v.keys)] = 0
        score[length:, :, most - length] = np.where(v.keys[at] == key, v.scores[at], v.unknown if length == 1 else -np.inf).T
    best = np.full((n, most, size + 1), -np.inf)
    for e in range(most):
        best[:, e, most - 1 - e] = 0
    for j in range(most, size + 1):
        best[:, :, j] = (best[:, :, j - most : j] + score[j][:, None, :]).max(axis=2)
    return best[:, :, : size - most : -1]


def _cuts(v: Vocabulary, points: np.ndarray) -> np.ndarray:
    """Places at which a best segmentation of a long unit has cuts, about one for each window."""
    most, width = v.longest, max(WINDOW, v.longest)
    n = len(points) // width - 1  # the rest, one to two windows long, is the last stretch
    padded = np.concatenate((np.full(most - 1, LITERAL + 1, dtype=points.dtype), points))
    best, back = np.full(most, -np.inf), []
    best[0] = 0
    for at in range(0, n, 64):
        some = np.arange(at, min(at + 64, n))
        for table in _window_sums(v, padded[some[:, None] * width + np.arange(width + most - 1)]):
            tried = best[:, None] + table
            back.append(tried.argmax(axis=0))
            best = tried.max(axis=0)
    last = _window_sums(v, padded[None, n * width :])[0][:, 0]
    e = int((best + last).argmax())
    cuts = []
    for w in range(n - 1, -1, -1):
        cuts.append((w + 1) * width - e)
        e = int(back[w][e])
    return np.array(cuts[::-1], dtype=np.int64)


def encode_units(v: Vocabulary, points: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all identifiers, number of them by unit) for units given as ranges of code points."""
    long = np.flatnonzero(size > max(LONG, 2 * v.longest))
    if not len(long):
        return _encode_units(v, points, start, size)
    inner = {int(u): _cuts(v, points[start[u] : start[u] + size[u]]) for u in long}
    parts = np.ones(len(start), dtype=np.int64)
    parts[long] += [len(inner[int(u)]) for u in long]
    begin = np.repeat(start, parts)
    first = np.cumsum(parts) - parts
    for u in long:
        begin[first[u] + 1 : first[u] + parts[u]] += inner[int(u)]
    end = np.append(begin[1:], 0)
    end[first + parts - 1] = start + size
    ids, counts = _encode_units(v, points, begin, end - begin)
    return ids, np.add.reduceat(counts, first)


def _encode_units(v: Vocabulary, points: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all identifiers, number of them by unit) for units given as ranges of code points."""
    counts = np.zeros(len(start), dtype=np.int64)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    order = np.argsort(size, kind="stable")
    cut = np.flatnonzero(np.diff(size[order])) + 1
    for group in np.split(order, cut) if len(order) else []:
        length = int(size[group[0]])
        step = max(1, (1 << 15) // length)
        for at in range(0, len(group), step):
            some = group[at : at + step]
            matrix = points[start[some][:, None] + np.arange(length)]
            ids, lengths = _segment(v, matrix)
            # from the right to the left: turn each row around
            many = (lengths > 0).sum(axis=1)
            unit = np.repeat(np.arange(len(some)), many)
            column = np.repeat(many, many) - 1 - _spread(np.zeros(len(some), np.int64), many)
            flat, span = ids[unit, column], lengths[unit, column]
            lost = np.flatnonzero(flat < 0)
            if len(lost):
                ends = np.cumsum(span)  # units lie one after the other in the matrix
                raw, wide = _bytes_of(matrix.ravel()[ends[lost] - 1])
                width = np.ones(len(flat), dtype=np.int64)
                width[lost] = wide
                out = np.repeat(flat, width)
                out[out < 0] = v.byte_ids[raw]
                unit = np.repeat(unit, width)
                flat = out
            counts[some] = np.bincount(unit, minlength=len(some))
            done.append((some, flat, counts[some]))
    offs = np.concatenate(([0], np.cumsum(counts)))
    out = np.zeros(int(offs[-1]), dtype=np.int32)
    for some, flat, many in done:
        out[_spread(offs[some], many)] = flat
    return out, counts


def encode_slice(v: Vocabulary, buf: np.ndarray, offs: np.ndarray, front: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(all identifiers, number of them by row) of rows of UTF-8 bytes; ``front``: a space is put in front of each."""
    rows = len(offs) - 1
    if rows == 1 and len(buf) > GIANT:
        return _encode_giant(v, buf, front)
    text = buf.tobytes().decode("utf-8", "surrogatepass")
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    heads = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))[offs]
    full = heads[1:] > heads[:-1]
    points = np.where(points == SPACE, LITERAL, points)
    points[points == 0x20] = SPACE
    first = heads[:-1][full]
    points = np.insert(points, first, SPACE) if front else points
    if not len(points):
        return np.zeros(0, np.int32), np.zeros(rows, np.int64)
    row_start = first + np.arange(len(first)) * front
    mark = points == SPACE
    begin = mark.copy()
    begin[1:] &= ~mark[:-1]
    begin[row_start] = True
    start = np.flatnonzero(begin)
    size = np.diff(np.append(start, len(points)))
    h = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(points)), out=h[1:], dtype=np.uint64)
    key = _finish((h[start + size] - h[start]) * powers(_INVERSE, len(points))[start], size)
    _, one, which = np.unique(key, return_index=True, return_inverse=True)
    ids, counts = encode_units(v, points, start[one], size[one])
    offs_u = np.concatenate(([0], np.cumsum(counts)))
    out = ids[_spread(offs_u[which], counts[which])]
    by_row = np.zeros(rows, dtype=np.int64)
    by_row[full] = np.add.reduceat(counts[which], np.searchsorted(start, row_start))
    return out, by_row


def _encode_giant(v: Vocabulary, buf: np.ndarray, front: bool) -> tuple[np.ndarray, np.ndarray]:
    """The same for one long text, in stretches that end where a unit begins, so that little is held at a time."""
    out, at = [], 0
    while at < len(buf):
        rest = buf[at + GIANT // 2 :]
        space = np.flatnonzero((rest[1:] == 0x20) & (rest[:-1] != 0x20)) if len(rest) else rest
        end = at + GIANT // 2 + 1 + int(space[0]) if len(space) else len(buf)
        part = buf[at:end]
        # the empty row in front keeps a stretch from being taken for a giant again
        out.append(encode_slice(v, part, np.array([0, 0, len(part)]), front and at == 0)[0])
        at = end
    ids = np.concatenate(out) if out else np.zeros(0, np.int32)
    return ids, np.array([len(ids)])


def decode_slice(v: Vocabulary, ids: np.ndarray, by_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of rows of identifiers; the space put in front of a row is dropped."""
    width = (v.starts[1:] - v.starts[:-1])[ids]
    raw = v.flat[_spread(v.starts[:-1][ids], width)]
    ends = np.concatenate(([0], np.cumsum(width)))[np.concatenate(([0], np.cumsum(by_row)))]
    full = np.flatnonzero(ends[1:] > ends[:-1])
    front = full[raw[ends[full]] == 0x20]
    keep = np.ones(len(raw), dtype=bool)
    keep[ends[front]] = False
    less = np.zeros(len(by_row) + 1, dtype=np.int64)
    less[front + 1] = 1
    return raw[keep], ends - np.cumsum(less)


_ENCODED = "doc_id long, n_chars long, n_tokens long, n_byte_tokens long, round_trip boolean, token_ids array<int>"


def encode_documents(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """Every whole text's identifiers, and whether decoding them gives the text again."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(load_vocabulary(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        is_byte = np.zeros(len(v.starts) - 1, dtype=bool)
        is_byte[v.byte_ids] = True
        for batch, buf, offs in pieces(batches, most_bytes=1 << 20, most_rows=2048):
            ids, by_row = encode_slice(v, buf, offs)
            raw, at = decode_slice(v, ids, by_row)
            same = np.diff(at) == np.diff(offs)
            if len(raw) == len(buf):
                wrong = np.flatnonzero(raw != buf)
                same[np.searchsorted(offs, wrong, side="right") - 1] = False
            else:
                same &= [raw[at[i] : at[i + 1]].tobytes() == buf[offs[i] : offs[i + 1]].tobytes() for i in range(len(same))]
            token_at = np.concatenate(([0], np.cumsum(by_row)))
            count = lambda marks, cuts: np.diff(np.concatenate(([0], np.cumsum(marks)))[cuts])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(count((buf & 0xC0) != 0x80, offs)), pa.array(by_row), pa.array(count(is_byte[ids], token_at)), pa.array(same),
                pa.ListArray.from_arrays(pa.array(token_at.astype(np.int32)), pa.array(ids)),
            ], names=["doc_id", "n_chars", "n_tokens", "n_byte_tokens", "round_trip", "token_ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _ENCODED)


def decode_documents(encoded: DataFrame, model_file: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, token_ids)."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_vocabulary(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                lists = b.column(1).fill_null([])
                ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                by_row = np.array([len(x) for x in lists], dtype=np.int64)
                raw, ends = decode_slice(v, ids, by_row)
                text = raw.tobytes()
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([text[ends[i] : ends[i + 1]].decode("utf-8", "replace") for i in range(b.num_rows)], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "token_ids").mapInArrow(run, "doc_id long, text string")
