"""Quality rules: per-document measures and cross-document line frequency.

Lines are normalised (A-Z lower-cased, white space collapsed) and hashed; for
each host the number of distinct documents with a line is counted, lines above
the limit are removed, and documents that lose too much are rejected.

Documents are told by their id, so exact copies count each.  ``copies_once`` counts by a
digest of the whole normalised text instead (the hashes of all its lines, in order);
it is off by default.

Lines are joined with the frequent ones of their host by a broadcast where those are few by
count, else by salted keys, as a frequent line is a hot key by nature.

Cases: null text or text without words has all counts 0 and fails the base rule;
a null host is a host of its own; rows of one id are one document in the counts (rows
without id too) and are measured and cut each by its own text; an empty table gives
an empty result; further columns of the input do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Scratch, unpack_row, with_row
from .textnum import GRAM, Words, grams, mix, pieces, powers

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_HOST_DOCS = 30
MIN_LEFT_PERCENT = 20
#: Frequent lines (some 40 bytes each) up to which they are broadcast; beyond it the join is salted.
BROADCAST_LINES = 200_000
SALTS = 32

_MEASURES = "doc_id long, host string, body long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, digest long, lines array<struct<hash:long,words:int,at:int>>"
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _distinct_marks(key: np.ndarray) -> np.ndarray:
    """Marks of keys that occur at least twice."""
    s = np.sort(key)
    again = s[1:][s[1:] == s[:-1]]
    if not len(again):
        return np.zeros(len(key), dtype=bool)
    again = again[np.concatenate(([True], again[1:] != again[:-1]))]
    at = np.searchsorted(again, key)
    at[at == len(again)] = 0
    return again[at] == key


def _per_row(marks: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(marks) + 1, dtype=np.int64)
    np.cumsum(marks, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), ("body", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("digest", pa.int64()), ("lines", pa.list_(pa.struct([("hash", pa.int64()), ("words", pa.int32()), ("at", pa.int32())])))])
    for batch, buf, offs in pieces(batches):
        rows = batch.num_rows
        w = Words(buf, offs, lower=False)
        shift = np.uint64(56)
        # words in windows that recur inside the text
        at, h = grams(w.hashes(), w.row, 5)
        hit = at[_distinct_marks(w.row[at].astype(np.uint64) << shift | h >> np.uint64(8))]
        cover = np.zeros(len(w.start) + 6, dtype=np.int64)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + 5, -1)
        covered = np.cumsum(cover)[: len(w.start)] > 0
        words_at = np.concatenate(([0], np.cumsum(w.per_row)))
        # lines: from each row's start or a newline to the next newline or the row's end
        cuts = np.flatnonzero(buf == 10)
        begin = np.sort(np.concatenate((offs[:-1], cuts + 1)), kind="stable")
        end = np.sort(np.concatenate((offs[1:], cuts)), kind="stable")
        row = np.searchsorted(offs, begin, side="right") - 1
        # a newline that ends a row starts its last, empty line, which has no word
        a, b = np.searchsorted(w.start, begin), np.searchsorted(w.start, end)
        full = b > a
        begin, end, row, a, b = begin[full], end[full], row[full], a[full], b[full]
        key = np.sort(row.astype(np.uint64) << shift | w.ranges(begin, end) >> np.uint64(8))
        n_lines = np.bincount(row, minlength=rows)
        distinct = np.bincount((key[np.concatenate(([True], key[1:] != key[:-1]))] >> shift).astype(np.int64), minlength=rows) if len(key) else np.zeros(rows, np.int64)
        # normalised lines: hashes over the hashes of lower-cased words
        low = Words(buf, offs, lower=True)
        n = len(low.start)
        base = int(GRAM[14])
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(low.hashes() * powers(base, n), out=total[1:], dtype=np.uint64)
        line = mix((total[b] - total[a]) * powers(pow(base, -1, 2**64), n + 1)[a]).view(np.int64)
        number = np.searchsorted(cuts, begin) - np.searchsorted(cuts, offs[row])
        line_at = np.concatenate(([0], np.cumsum(n_lines)))
        # the whole normalised text: a hash over the hashes of its lines
        total = np.zeros(len(line) + 1, dtype=np.uint64)
        np.cumsum(line.view(np.uint64) * powers(base, len(line)), out=total[1:], dtype=np.uint64)
        digest = mix((total[line_at[1:]] - total[line_at[:-1]]) * powers(pow(base, -1, 2**64), len(line) + 1)[line_at[:-1]]).view(np.int64)
        # a line counts once for its document; the place of each is kept for removal
        lines = pa.ListArray.from_arrays(pa.array(line_at, pa.int32()), pa.StructArray.from_arrays([pa.array(line), pa.array((b - a).astype(np.int32)), pa.array(number.astype(np.int32))], names=["hash", "words", "at"]))
        yield pa.RecordBatch.from_arrays([
            batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()), batch.column(batch.schema.get_field_index("host")).cast(pa.string()), batch.column(batch.schema.get_field_index("body")),
            pa.array(w.per_row.astype(np.int64)), pa.array(_per_row(w.solid & (buf & 0xC0 != 0x80), offs)), pa.array(_per_row(_SYMBOL[buf], offs)), pa.array((n_lines - distinct).astype(np.int64)),
            pa.array(_per_row(covered, words_at)), pa.array(digest), lines,
        ], schema=schema)


def _body(text) -> Column:
    """What tells the texts of one id apart."""
    return F.xxhash64(text)


def measures(docs: DataFrame) -> DataFrame:
    """One row per document: the base measures, the digest of its text and its normalised lines."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), _body(text).alias("body"), text.alias("text")).mapInArrow(_measure, _MEASURES)


def frequent_lines(measured: DataFrame, max_host_docs: int = MAX_HOST_DOCS, copies_once: bool = False) -> DataFrame:
    """(host, hash) of lines in more than ``max_host_docs`` distinct documents of a host.

    The pairs of line and document are made distinct first, so a line that a third
    of all documents carry is spread over (line, document) groups and then summed
    as partial counts.
    """
    pairs = measured.select("host", "digest" if copies_once else "doc_id", F.explode(F.array_distinct("lines.hash")).alias("hash")).distinct()
    return pairs.groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") > max_host_docs).select("host", "hash")


def removals(measured: DataFrame, scratch: Scratch, max_host_docs: int = MAX_HOST_DOCS, copies_once: bool = False) -> DataFrame:
    """(id, at_host, of_body, removed_words, removed_lines, places) of documents that lose lines."""
    hot = scratch.put(frequent_lines(measured, max_host_docs, copies_once).toDF("hot_host", "hot_hash"), "frequent")
    lines = measured.select("doc_id", "host", "body", F.explode("lines").alias("l")).select("doc_id", "host", "body", "l.hash", "l.words", "l.at")
    same = (F.col("hash") == F.col("hot_hash")) & F.col("host").eqNullSafe(F.col("hot_host"))
    if hot.count() <= BROADCAST_LINES:
        hit = lines.join(F.broadcast(hot), same)
    else:
        salted = hot.withColumn("hot_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("doc_id", "body", "at"), F.lit(SALTS)).cast("int")
        hit = lines.withColumn("salt", salt).join(salted, same & (F.col("salt") == F.col("hot_salt")))
    # rows that repeat whole are one group, and each of their lines counts once
    by_place = hit.groupBy("doc_id", "host", "body", "at").agg(F.first("words").alias("words"))
    return by_place.groupBy(F.col("doc_id").alias("id"), F.col("host").alias("at_host"), F.col("body").alias("of_body")).agg(F.sum("words").cast("long").alias("removed_words"), F.count("*").alias("removed_lines"), F.collect_list("at").alias("places"))


def verdicts(docs: DataFrame, max_host_docs: int = MAX_HOST_DOCS, min_left_percent: int = MIN_LEFT_PERCENT, copies_once: bool = False) -> DataFrame:
    """The measures of every document (with ``host`` and ``body``), what line removal takes from it, and the verdict."""
    scratch = Scratch(docs.sparkSession, "quality")
    m = scratch.put(measures(docs), "measures")
    gone = removals(m, scratch, max_host_docs, copies_once)
    own = F.col("doc_id").eqNullSafe(F.col("id")) & F.col("host").eqNullSafe(F.col("at_host")) & (F.col("body") == F.col("of_body"))
    out = m.drop("lines", "digest").join(gone, own, "left").drop("id", "at_host", "of_body")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long"))).withColumn("removed_lines", F.coalesce("removed_lines", F.lit(0).cast("long")))
    left = F.col("n_words") - F.col("removed_words")
    return out.withColumn("kept", ~F.col("base_failed") & (left >= MIN_WORDS) & (100 * left >= min_left_percent * F.col("n_words")))


def quality_report(docs: DataFrame, **limits) -> DataFrame:
    return verdicts(docs, **limits).drop("places", "host", "body")


def quality_filter(docs: DataFrame, **limits) -> DataFrame:
    """The documents that pass, without the removed lines; same columns as ``docs``.

    ``n_chars`` follows the shortened text.
    """
    v = verdicts(docs, **limits).where("kept").select(F.col("doc_id").alias("id"), F.col("host").alias("at_host"), F.col("body").alias("of_body"), F.col("places").alias("gone"))
    # rows that repeat whole have one verdict
    v = v.dropDuplicates(["id", "at_host", "of_body"])
    text = F.col("text").cast("string")
    rows = with_row(docs, own=F.col("doc_id").cast("long"), host=F.col("source").cast("string"), body=_body(text), whole=text)
    out = rows.join(v, F.col("own").eqNullSafe(F.col("id")) & F.col("host").eqNullSafe(F.col("at_host")) & (F.col("body") == F.col("of_body")))

    def cut(lines: Column) -> Column:
        # a set operation, so long texts that lose many lines stay linear
        left = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone")))
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    # the lambda binds the lines, so a text is split once
    kept = F.get(F.transform(F.array(F.split("whole", "\n")), cut), F.lit(0))
    text = F.when(F.col("gone").isNull(), F.col("whole")).otherwise(kept)
    n_chars = F.when(F.col("gone").isNull(), F.col("row").getField("n_chars")).otherwise(F.length(text)) if "n_chars" in docs.columns else F.lit(None)
    return unpack_row(out, docs, text=text, n_chars=n_chars)
