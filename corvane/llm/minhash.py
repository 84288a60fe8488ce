"""Near-duplicates by min-max hashing over five-word shingles.

Every permutation gives two signature values, its minimum and its maximum, so
80 hash evaluations a shingle make 160 values.  Bands of four values propose
candidates; every link is confirmed on the documents' full shingle sets.

At a similarity of exactly 0.75 a pair shares none of the 40 bands with a
probability of (1 - 0.75**4)**40, about 3e-7.

Documents with equal shingle sets are collapsed first to one node, so thousands of copies are
one row in all that follows.  In a bucket, members are compared with one centre by
their signatures; where this leaves several clusters, the members outside the largest one
are compared with all members of other clusters, in blocks.  Clusters hold what may be similar;
inside them the full sets are compared: all pairs inside each block of a cluster, then
the heads of what is still apart, then, exactly, the members outside the largest component
with all members of other components.  A task sends a spanning forest of the links
it found, never the pairs of a group.  No bucket or cluster is capped.

A node is a set, numbered apart from ids, so rows of one id with different texts are nodes of
their own; the id of a component is the least doc_id among its rows.

Cases: null text and text without words have no shingles and no links; texts of
fewer than five words have their whole sequence as one shingle; repeated rows are
copies; a null id is kept with itself as a component of null; an empty table
gives an empty result; further columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, forest, spread_join
from .store import Scratch, unpack_row, with_row
from .textnum import Words, mix, pieces, shingles

PERMUTATIONS = 80
BAND_ROWS = 4
PERCENT = 75
#: A pair at 0.75 agrees in fewer of its 160 values than this with a probability of about 5e-6.
LEAST_AGREEMENT = 96
BLOCK = 256
BLOCK_SHINGLES = 1 << 20

_rng = np.random.default_rng(0x3A9)
_XOR = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_MUL = _rng.integers(2**62, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_MUL = _rng.integers(2**62, 2**63, BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("body", pa.int64()), ("n_shingles", pa.int64()), ("set_hash", pa.int64()), ("set_sum", pa.int64()), ("signature", pa.binary())])
    for batch, buf, offs in pieces(batches):
        rows = batch.num_rows
        row, h = shingles(Words(buf, offs, lower=True))
        size = np.bincount(row, minlength=rows).astype(np.int64)
        full = np.flatnonzero(size)
        signature = np.zeros((rows, 2 * PERMUTATIONS), dtype=np.uint32)
        set_hash, set_sum = np.zeros(rows, dtype=np.uint64), np.zeros(rows, dtype=np.uint64)
        if len(full):
            at = np.concatenate(([0], np.cumsum(size)[:-1]))[full]
            set_hash[full], set_sum[full] = np.add.reduceat(mix(h), at), np.add.reduceat(mix(h ^ _XOR[0]), at)
            for k in range(PERMUTATIONS):
                x = (((h ^ _XOR[k]) * _MUL[k]) >> np.uint64(32)).astype(np.uint32)
                signature[full, k] = np.minimum.reduceat(x, at)
                signature[full, PERMUTATIONS + k] = np.maximum.reduceat(x, at)
        raw = signature.tobytes()
        wide = 8 * PERMUTATIONS
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(size), pa.array(set_hash.view(np.int64)), pa.array(set_sum.view(np.int64)), pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(np.arange(0, (rows + 1) * wide, wide, dtype=np.int32)), pa.py_buffer(raw)])], schema=schema)


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, body, text); body tells the texts of one id apart."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("body"), text.alias("text"))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, body, n_shingles, set_hash, set_sum, signature) of every document."""
    return _texts(docs).mapInArrow(_sketch, "doc_id long, body long, n_shingles long, set_hash long, set_sum long, signature binary")


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            sig = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.uint32).reshape(part.num_rows, -1).astype(np.uint64)
            sig = sig.reshape(part.num_rows, -1, BAND_ROWS)
            band = mix((sig * _BAND_MUL).sum(axis=2, dtype=np.uint64) + np.arange(sig.shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            rep = np.repeat(part.column(0).to_numpy(zero_copy_only=False), sig.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(band.ravel().view(np.int64)), pa.array(rep)], names=["bucket", "rep"])


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures and sizes allow the similarity."""
    for b in batches:
        for at in range(0, b.num_rows, 2048):
            p = b.slice(at, 2048)
            x, y = (np.frombuffer(b"".join(p.column(c).to_pylist()), dtype=np.uint32).reshape(p.num_rows, -1) for c in (2, 3))
            same = (x == y).sum(axis=1)
            keep = same >= LEAST_AGREEMENT
            yield pa.RecordBatch.from_arrays([p.column(0).filter(pa.array(keep)), p.column(1).filter(pa.array(keep))], names=["u", "v"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, buf, offs in pieces(batches):
        row, h = shingles(Words(buf, offs, lower=True))
        cut = np.searchsorted(row, np.arange(batch.num_rows + 1)) * 8
        raw = h.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([raw[cut[i] : cut[i + 1]] for i in range(batch.num_rows)], pa.binary())], names=["rep", "shingles"])


def _sets_of(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all members of some sets."""
    sets = [np.frombuffer(x, dtype=np.uint64) for x in raw]
    return np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)


def common(row: np.ndarray, h: np.ndarray, n: int, width: int = 2048) -> np.ndarray:
    """Sizes of all pairs' intersections, n x n, from (row, hash) of distinct members.

    Members of one set only are dropped; the others are columns of 0-1 matrices,
    taken some at a time, whose products add up.
    """
    order = np.argsort(h, kind="stable")
    row, h = row[order], h[order]
    head = np.concatenate(([True], h[1:] != h[:-1]))
    column = np.cumsum(head) - 1
    shared = np.bincount(column)[column] > 1
    row, column = row[shared], column[shared]
    out = np.zeros((n, n), dtype=np.float32)
    if not len(column):
        return out
    column = np.cumsum(np.concatenate(([0], column[1:] != column[:-1])))
    cuts = np.searchsorted(column, np.arange(0, column[-1] + 1, width))
    for a, b in zip(cuts, [*cuts[1:], len(column)], strict=True):
        m = np.zeros((n, width), dtype=np.float32)
        m[row[a:b], column[a:b] - column[a]] = 1
        out += m @ m.T
    return out


def _forest(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    u, v = forest(ids[a], ids[b]) if len(a) else (np.zeros(0, np.int64),) * 2
    return pd.DataFrame({"u": u, "v": v})


def _verify(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the links among the sets of a block, or, with sides, of those of the first side to other components."""
    ids = pdf.rep.to_numpy(np.int64)
    row, h = _sets_of(pdf.shingles.tolist())
    size = np.bincount(row, minlength=len(ids))
    both = common(row, h, len(ids))
    may = np.ones((len(ids), len(ids)), dtype=bool)
    if "side" in pdf:
        side, comp = pdf.side.to_numpy(), pdf.component.to_numpy()
        may = (side[:, None] == 0) & (side[None, :] == 1) & (comp[:, None] != comp[None, :])
        may |= may.T
    may = np.tril(may, -1)
    return _forest(ids, *np.nonzero(may & (100 * both >= PERCENT * (size[:, None] + size[None, :] - both))))


def _cross(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the pairs of a bucket's two blocks that lie in different clusters and may be similar."""
    left, right = pdf[pdf.side == 0], pdf[pdf.side == 1]
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(left) and len(right):
        y = np.frombuffer(b"".join(right.signature), dtype=np.uint32).reshape(len(right), -1)
        yid, yc, yn = right.rep.to_numpy(), right.component.to_numpy(), right.n_shingles.to_numpy()
        for rep, comp, n, sig in zip(left.rep, left.component, left.n_shingles, left.signature, strict=True):
            may = np.flatnonzero((yc != comp) & (100 * np.minimum(yn, n) >= PERCENT * np.maximum(yn, n)))
            if len(may):
                same = (y[may] == np.frombuffer(sig, dtype=np.uint32)).sum(axis=1)
                may = may[same >= LEAST_AGREEMENT]
                us.append(yid[may])
                vs.append(np.full(len(may), rep))
    u, v = np.concatenate(us), np.concatenate(vs)
    ids, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    return _forest(ids, at[: len(u)], at[len(u) :])


def _apart(member: DataFrame, total: int) -> DataFrame:
    """The members (bucket, rep, component, n_shingles) of buckets with several components, dealt to pairs of blocks.

    Side 0: members outside the bucket's largest component; side 1: all its members.  Each
    pair of the two sides meets in one group (bucket, i, j), and a member is repeated as often
    as the other side has blocks, which for side 1 is few unless most of the bucket is apart.
    """
    sizes = member.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    main = F.max(F.struct("n", "s", "component")).alias("main")
    whole = sizes.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("components"), main).where("components > 1")
    blocks = lambda n, s: F.ceil(F.greatest(n / BLOCK, s / BLOCK_SHINGLES)).cast("int")
    whole = whole.select("bucket", "n", F.col("main.component").alias("main"), blocks(F.col("n"), F.col("s")).alias("all_blocks"), blocks(F.col("n") - F.col("main.n"), F.col("s") - F.col("main.s")).alias("few_blocks"))
    m = spread_join(member, whole, ["bucket"], total)
    own = lambda n, k: F.pmod(F.xxhash64("rep", F.lit(k)), F.col(n)).cast("int")
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    few = m.where("component <> main").select("bucket", own("few_blocks", 1).alias("i"), span("all_blocks").alias("j"), F.lit(0).alias("side"), "rep", "component")
    every = m.select("bucket", span("few_blocks").alias("i"), own("all_blocks", 2).alias("j"), F.lit(1).alias("side"), "rep", "component")
    return few.unionAll(every)


def _nodes(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(sketches, nodes): nodes number the distinct sets (rep), with their rows (n), least row (doc_id, body) and signature."""
    all_docs = scratch.put(sketches(docs), "sketches")
    full = all_docs.where("n_shingles > 0 and doc_id is not null")
    nodes = full.groupBy("set_hash", "set_sum", "n_shingles").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "body")).alias("low"), F.first("signature").alias("signature"))
    # the number is fixed once the table is written
    return all_docs, scratch.put(nodes.withColumn("rep", F.monotonically_increasing_id()), "nodes")


def _candidates(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(rep, bucket): clusters of nodes that may be similar."""
    spark = nodes.sparkSession
    sig = nodes.select(F.col("rep").alias("id"), "n_shingles", "signature")
    bands = scratch.put(nodes.select("rep", "signature").mapInArrow(_bands, "bucket long, rep long"), "bands")
    shared = bands.groupBy("bucket").agg(F.min("rep").alias("centre"), F.count("*").alias("n")).where("n > 1")
    total = bands.count()
    buckets = scratch.put(spread_join(bands, shared, ["bucket"], total), "buckets")
    scratch.drop(bands)

    # every member against its bucket's centre, by signatures
    pairs = scratch.put(buckets.where("rep <> centre").select(F.col("rep").alias("u"), F.col("centre").alias("v")).distinct(), "pairs")
    centres = pairs.groupBy("v").agg(F.count("*").alias("n")).join(sig.toDF("v", "nv", "sv"), "v")
    near = spread_join(pairs, centres, ["v"], pairs.count()).join(sig.toDF("u", "nu", "su"), "u").where(100 * F.least("nu", "nv") >= PERCENT * F.greatest("nu", "nv"))
    stars = scratch.put(near.select("u", "v", "su", "sv").mapInArrow(_agree, "u long, v long"), "stars")
    cluster = scratch.put(components(spark, stars, scratch), "clusters")
    # buckets that hold several clusters: members against members of other clusters
    member = buckets.select("bucket", "rep").join(cluster.toDF("rep", "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    member = scratch.put(member.join(sig.select(F.col("id").alias("rep"), "n_shingles"), "rep"), "members")
    mixed = _apart(member.where("bucket is not null"), total).join(sig.toDF("rep", "n_shingles", "signature"), "rep")
    # few bytes and much work: dealt to as many tasks as a shuffle has
    dealt = mixed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket", "i", "j")
    crossed = scratch.put(dealt.groupBy("bucket", "i", "j").applyInPandas(_cross, "u long, v long"), "crossed")
    if not crossed.limit(1).count():
        return cluster.toDF("rep", "bucket")
    return scratch.put(components(spark, cluster.toDF("u", "v").unionAll(crossed), scratch), "clusters").toDF("rep", "bucket")


def _linked(docs: DataFrame, nodes: DataFrame, cluster: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): components by exact links, of the nodes that have one."""
    spark = docs.sparkSession
    rows = nodes.join(cluster, "rep").select("rep", "bucket", "n_shingles", "low.doc_id", "low.body")
    texts = _texts(docs).where("text is not null").join(rows, ["doc_id", "body"]).dropDuplicates(["rep"])
    sets = scratch.put(texts.select("rep", "text").mapInArrow(_sets, "rep long, shingles binary"), "sets")
    member = scratch.put(rows.select("rep", "bucket", "n_shingles"), "clustered")
    sizes = member.groupBy("bucket").agg(F.count("*").alias("n"), F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    total = member.count()

    def inside(some: DataFrame, name: str) -> DataFrame:
        """Links of all pairs inside the blocks of (rep, bucket, blocks)."""
        placed = some.select("rep", "bucket", F.pmod(F.xxhash64("rep"), F.col("blocks")).alias("i"))
        return scratch.put(placed.join(sets, "rep").groupBy("bucket", "i").applyInPandas(_verify, "u long, v long"), name)

    placed = spread_join(member, sizes, ["bucket"], total)
    done = scratch.put(components(spark, inside(placed, "links"), scratch), "components")
    if not sizes.where("blocks > 1").limit(1).count():
        return done
    # clusters of several blocks: the heads of components first, which joins most that is alike
    wide = placed.where("blocks > 1").select("rep", "bucket", "n_shingles")
    own = lambda d: wide.join(d.toDF("rep", "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    heads = own(done).where("rep = component").select("rep", "bucket", "n_shingles")
    by_cluster = heads.groupBy("bucket").agg(F.count("*").alias("n"), F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    among = inside(spread_join(heads, by_cluster, ["bucket"], total), "heads")
    edges = lambda d: d.toDF("u", "v")
    done = scratch.put(components(spark, edges(done).unionAll(among), scratch), "components")
    # then, exactly, what is still apart
    rest = _apart(scratch.put(own(done).select("bucket", "rep", "component", "n_shingles"), "wide"), total)
    links = scratch.put(rest.join(sets, "rep").groupBy("bucket", "i", "j").applyInPandas(_verify, "u long, v long"), "links")
    return scratch.put(components(spark, edges(done).unionAll(links), scratch), "components")


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, body, n_shingles, low) of every row; low: the least row (doc_id, body) of its component, null for rows that link with nothing."""
    scratch = Scratch(docs.sparkSession, "minhash")
    all_docs, nodes = _nodes(docs, scratch)
    comp = _linked(docs, nodes, _candidates(nodes, scratch), scratch)
    facts = nodes.select("set_hash", "set_sum", "n_shingles", "n", "rep", "low").join(comp.toDF("rep", "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    facts = scratch.put(facts, "facts")
    least = facts.groupBy("component").agg(F.min("low").alias("least"), F.count("*").alias("n"))
    facts = scratch.put(spread_join(facts.drop("low").withColumnRenamed("n", "copies"), least, ["component"], nodes.count()).drop("component", "rep").withColumnRenamed("copies", "n"), "lows")
    rows = all_docs.select("doc_id", "body", "n_shingles", "set_hash", "set_sum")
    linked = spread_join(rows.where("n_shingles > 0 and doc_id is not null"), facts, ["set_hash", "set_sum", "n_shingles"], rows.count())
    rest = rows.where("n_shingles = 0 or doc_id is null").withColumn("least", F.lit(None).cast(linked.schema["least"].dataType))
    return linked.unionByName(rest).select("doc_id", "body", "n_shingles", F.col("least").alias("low"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    cid = F.coalesce(F.col("low.doc_id"), F.col("doc_id"))
    return _rows(docs).select("doc_id", "n_shingles", cid.alias("component_id"), F.coalesce(cid == F.col("doc_id"), F.lit(True)).alias("kept"))


def near_dedup(docs: DataFrame) -> DataFrame:
    """One document of each group, with the columns of ``docs``: the one of least id (of several texts, the least hash).

    Of equal rows (id and text) one stays.
    """
    mine = F.struct("doc_id", "body")
    kept = _rows(docs).where(F.col("low").isNull() | (F.col("low") == mine)).select(F.col("doc_id").alias("id"), F.col("body").alias("of_body")).distinct()
    text = F.col("text").cast("string")
    rows = with_row(docs, own=F.col("doc_id").cast("long"), body=F.xxhash64(text))
    rows = rows.join(kept, F.col("own").eqNullSafe(F.col("id")) & (F.col("body") == F.col("of_body")), "left_semi")
    # few ids repeat, if any: only their rows are compared
    again = docs.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id")
    same = F.col("own").eqNullSafe(F.col("id"))
    once = rows.join(again, same, "left_anti").unionAll(rows.join(again, same, "left_semi").dropDuplicates(["own", "body"]))
    return unpack_row(once, docs)
