"""Mixing sources to target weights by temperature.

Source shares of all tokens are raised to an exponent between 0 and 1 and
normalised.  The exponent is found by bisection: the largest at which the weights
reach the target entropy (a fraction of that of equal weights), unless a source
would then be repeated more often than the limit allows; then the smallest that
keeps the limit.

The budget is the least that passes over every source at least once, so that no
document is lost; a larger one may be given, and under any budget every source is
passed over once.  A source's part of it is realised as
whole passes and one part pass.  Documents are dealt to at most 4,096 blocks a
source by the digest of their id; each pass puts the blocks in an order of its
own, and the part pass takes the blocks that begin before the budget ends.  Only
blocks are ordered in windows, never documents, so a source of any size is
bounded work for a task.

Everything is DataFrame expressions.  The bisection is done six halvings at a time: one
aggregate over the sources' table gives the sums that decide all 63 exponents between two bounds, and only
sums reach the driver, so there may be as many sources as hosts.  Sources meet
their documents by ``spread_join``, blocks by a broadcast where the plan has few bytes, else by
(source, block), which is no hot key.

Cases: null text has no tokens; a null source is the source ''; a source without
tokens is passed over once; a null id has the digest of ''; repeated rows are
documents of their own; an empty table gives an empty result; further columns
are kept by ``mix`` and do not matter otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import spread_join
from .store import Scratch, unpack_row, with_row

ENTROPY = 0.9
REPEATS = 4.0
MAX_BLOCKS = 4096
STEPS = 40
HALVINGS = 6  # of the bisection, decided by one aggregate
#: Bytes of the block plan up to which it is broadcast.
BROADCAST_BYTES = 16 << 20

_WORD = r"[^\x20\x09-\x0D]+"


def exponent(totals: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS) -> float:
    """The exponent, rounded to six places; totals: (source, tokens)."""
    some = totals.where("tokens > 0")
    n, every, least, most = some.agg(F.count("*"), F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    if not n or n < 2:
        return 1.0
    p = F.col("tokens") / F.lit(float(every))
    own = some.agg(F.sum(-p * F.log(p))).first()[0]
    goal = entropy * math.log(n)
    by_entropy = 1.0
    if own < goal - 1e-9:
        # the larger the exponent, the smaller the entropy
        lo, hi = 0.0, 1.0
        for step in range(0, STEPS, HALVINGS):
            k = 2 ** min(HALVINGS, STEPS - step)
            tried = [lo + (hi - lo) * i / k for i in range(1, k)]
            sums = some.agg(*[f(F.pow(p, F.lit(x))) for x in tried for f in (F.sum, lambda y: F.sum(y * F.log(p)))]).first()
            reached = sum(math.log(z) - x * y / z >= goal for x, z, y in zip(tried, sums[0::2], sums[1::2], strict=True))
            lo, hi = lo + (hi - lo) * reached / k, lo + (hi - lo) * (reached + 1) / k
        by_entropy = lo
    by_repeats = 0.0
    if most / least > repeats:
        lo, hi = 0.0, 1.0
        for _ in range(STEPS):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (most / least) ** (1 - mid) > repeats else (lo, mid)
        by_repeats = hi
    return round(max(by_entropy, by_repeats), 6)


def _digest() -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens, digest) of every document; digest: 32 bits of its id's MD5."""
    tokens = F.size(F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(_WORD), F.lit(0))).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), tokens.alias("n_tokens"), _digest().alias("digest"))


def block_plan(docs: DataFrame, scratch: Scratch, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, measured documents with their block, plan); plan: (source, block, epoch, block_rank)."""
    m = scratch.put(measured(docs), "measured")
    totals = scratch.put(m.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs")), "totals")
    tau = exponent(totals, entropy, repeats)
    every = totals.agg(F.sum("tokens")).first()[0] or 0
    share = F.col("tokens") / F.lit(float(max(every, 1)))
    weighed = totals.withColumn("share", share).withColumn("raw", F.when(F.col("tokens") > 0, F.pow("share", F.lit(tau))).otherwise(0.0))
    norm = weighed.agg(F.sum("raw")).first()[0] or 0.0
    # rounded only where it is returned: a weight under 5e-10 would be 0, and its source lost
    weighed = weighed.withColumn("weight", F.try_divide("raw", F.lit(norm)))
    if budget is None:
        budget = weighed.agg(F.max(F.when(F.col("weight") > 0, F.col("tokens") / F.col("weight")))).first()[0] or 0.0
    weighed = weighed.withColumn("budget", F.round(F.col("weight") * F.lit(float(budget))).cast("long"))
    weighed = weighed.select(
        "source", "tokens", "n_docs", F.round("share", 9).alias("share"), F.lit(tau).alias("tau"), F.round("weight", 9).alias("weight"), "budget", F.least(F.col("n_docs"), F.lit(MAX_BLOCKS)).alias("blocks"),
        F.when(F.col("tokens") > 0, F.greatest(F.floor(F.col("budget") / F.col("tokens")), F.lit(1))).otherwise(1).cast("long").alias("passes"),
        F.when(F.col("budget") >= F.col("tokens"), F.try_mod("budget", "tokens")).otherwise(0).cast("long").alias("rest"),
    )
    sources = scratch.put(weighed, "sources")
    facts = sources.select("source", "blocks", "passes", "rest", "weight", "tau", F.col("n_docs").alias("n"))
    dealt = spread_join(m, facts, ["source"], m.count()).withColumn("block", F.col("digest") % F.col("blocks"))
    blocks = dealt.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens"), F.first("passes").alias("passes"), F.first("rest").alias("rest"))
    epochs = blocks.withColumn("epoch", F.explode(F.expr("sequence(0L, passes)")))
    order = Window.partitionBy("source", "epoch").orderBy(F.md5(F.concat_ws(":", "source", "epoch", "block")), "block")
    before = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    plan = epochs.withColumn("block_rank", F.row_number().over(order).cast("long")).withColumn("before", before)
    plan = plan.where((F.col("epoch") < F.col("passes")) | (F.col("before") < F.col("rest"))).select("source", "block", "epoch", "block_rank")
    return sources, dealt.select("doc_id", "source", "n_tokens", "block", "weight", "tau"), scratch.put(plan, "plan")


def _small(plan: DataFrame) -> DataFrame:
    """A table by (source, block), broadcast where its bytes allow."""
    size = plan.agg(F.sum(F.octet_length("source") + 48)).first()[0] or 0
    return F.broadcast(plan) if size <= BROADCAST_BYTES else plan


def mixture(docs: DataFrame, **targets) -> DataFrame:
    """Every document of every pass: its place in the mixture, and its source's weight."""
    scratch = Scratch(docs.sparkSession, "mixing")
    _, dealt, plan = block_plan(docs, scratch, **targets)
    return dealt.join(_small(plan), ["source", "block"]).select("doc_id", "source", "n_tokens", "epoch", "block", "block_rank", "weight", "tau")


def mix(docs: DataFrame, **targets) -> DataFrame:
    """The mixture's documents with the columns of ``docs``; a document of n passes is n rows."""
    scratch = Scratch(docs.sparkSession, "mixing")
    sources, _, plan = block_plan(docs, scratch, **targets)
    copies = _small(scratch.put(plan.groupBy("source", "block").agg(F.count("*").cast("int").alias("copies")), "copies"))
    by_source = sources.select(F.col("source").alias("own"), F.col("blocks").alias("of"), F.col("n_docs").alias("n"))
    rows = with_row(docs, digest=_digest(), own=F.coalesce(F.col("source").cast("string"), F.lit("")))
    out = spread_join(rows, by_source, ["own"], sources.agg(F.sum("n_docs")).first()[0] or 0).withColumn("b", F.col("digest") % F.col("of"))
    out = out.join(copies, (F.col("own") == F.col("source")) & (F.col("b") == F.col("block")))
    return unpack_row(out.withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs)


ORACLE_SQL = rf"""
WITH RECURSIVE m AS (
    SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS n_tokens,
        ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS digest FROM documents
), totals AS (SELECT source, sum(n_tokens)::BIGINT AS tokens, count(*) AS n_docs FROM m GROUP BY source),
s AS (SELECT list(tokens / (SELECT sum(tokens) FROM totals) ORDER BY tokens) AS shares FROM totals WHERE tokens > 0),
steps AS (
    SELECT 0 AS i, 0.0::DOUBLE AS alo, 1.0::DOUBLE AS ahi, 0.0::DOUBLE AS blo, 1.0::DOUBLE AS bhi
    UNION ALL
    SELECT i + 1, CASE WHEN e THEN amid ELSE alo END, CASE WHEN e THEN ahi ELSE amid END, CASE WHEN r THEN bmid ELSE blo END, CASE WHEN r THEN bhi ELSE bmid END
    FROM (SELECT *, ln(list_sum(list_transform(shares, lambda p: pow(p, amid)))) - amid * list_sum(list_transform(shares, lambda p: pow(p, amid) * ln(p))) / list_sum(list_transform(shares, lambda p: pow(p, amid))) >= {ENTROPY} * ln(len(shares)) AS e,
            pow(list_max(shares) / list_min(shares), 1 - bmid) > {REPEATS} AS r
        FROM (SELECT *, (alo + ahi) / 2 AS amid, (blo + bhi) / 2 AS bmid FROM steps), s WHERE i < {STEPS})
), tau AS (
    SELECT round(greatest(
        CASE WHEN len(shares) < 2 OR -list_sum(list_transform(shares, lambda p: p * ln(p))) >= {ENTROPY} * ln(len(shares)) - 1e-9 THEN 1.0 ELSE alo END,
        CASE WHEN list_max(shares) / list_min(shares) <= {REPEATS} THEN 0.0 ELSE bhi END), 6)::DOUBLE AS tau FROM steps, s WHERE i = {STEPS}
), raw AS (SELECT *, CASE WHEN tokens > 0 THEN pow(tokens / (SELECT sum(tokens) FROM totals), tau) ELSE 0 END AS raw FROM totals, tau),
weighed AS (SELECT *, round(raw / (SELECT sum(raw) FROM raw), 9) AS weight FROM raw),
budgets AS (SELECT *, round(weight * (SELECT max(tokens / weight) FROM weighed WHERE weight > 0))::BIGINT AS budget, least(n_docs, {MAX_BLOCKS}) AS blocks FROM weighed),
sources AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS passes, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM budgets),
dealt AS (SELECT m.*, digest % blocks AS block, passes, rest, weight, tau FROM m JOIN sources USING (source)),
blocks AS (SELECT source, block, sum(n_tokens) AS tokens, any_value(passes) AS passes, any_value(rest) AS rest FROM dealt GROUP BY source, block),
plan AS (
    SELECT source, block, epoch, row_number() OVER w AS block_rank, passes, rest, coalesce(sum(tokens) OVER (PARTITION BY source, epoch ORDER BY md5(source || ':' || epoch || ':' || block), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM (SELECT *, unnest(range(passes + 1)) AS epoch FROM blocks) WINDOW w AS (PARTITION BY source, epoch ORDER BY md5(source || ':' || epoch || ':' || block), block)
)
SELECT doc_id, source, n_tokens, epoch, block, block_rank, weight, tau FROM dealt JOIN plan USING (source, block) WHERE epoch < plan.passes OR before < plan.rest
"""
