"""Column statistics and what they say about a predicate's selectivity.

Statistics are advice: they are collected at CHECKPOINT and shown by EXPLAIN, and never
change a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..language import tree as t

BUCKETS = 20
TOP = 16
INTERVALS = 200
#: Keys of bags for which statistics are kept, the most frequent ones; a bag's keys are user data and have no bound.
KEYS = 4096


def equi_depth(df: DataFrame, column: Column, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, low, high, n): chunks of the ordered values, the first ones larger by one; exact, as NTILE cuts them.

    Values are counted first, so a common one is a row.  Approximate quantiles of the distinct values cut
    them into intervals of about equal numbers; ranks run inside each interval, from the exact numbers of
    values before it, of which there are ``INTERVALS`` at most.  No task orders the whole column.
    """
    v = df.select(column.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    counted = v.groupBy("v").agg(F.count("*").alias("c"))
    cuts = sorted(set(counted.agg(F.percentile_approx("v", [i / INTERVALS for i in range(1, INTERVALS)], 10_000)).first()[0] or []))
    below = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda q: q < F.col("v"))) if cuts else F.lit(0)
    placed = counted.select("v", "c", below.alias("interval"))
    total = placed.groupBy("interval").agg(F.sum("c").alias("n"))
    before = total.select("interval", F.coalesce(F.sum("n").over(Window.orderBy("interval").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("n"))
    run = F.sum("c").over(Window.partitionBy("interval").orderBy("v"))
    # a value's rows have the places first .. last, counted from 0
    ranked = placed.withColumn("run", run).join(F.broadcast(before), "interval").select("v", "n", (F.col("before") + F.col("run") - F.col("c")).alias("first"), (F.col("before") + F.col("run") - 1).alias("last"))
    size, more = F.floor(F.col("n") / buckets), F.col("n") % buckets
    start = lambda b: b * size + F.least(b, more)
    of = lambda at: F.when(at < more * (size + 1), F.floor(at / (size + 1))).otherwise(more + F.floor((at - more * (size + 1)) / F.greatest(size, F.lit(1))))
    spread = ranked.withColumn("b", F.explode(F.sequence(of(F.col("first")), of(F.col("last")))))
    own = F.least(F.col("last") + 1, start(F.col("b") + 1)) - F.greatest("first", start(F.col("b")))
    return spread.groupBy((F.col("b") + 1).cast("int").alias("bucket")).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum(own).cast("bigint").alias("n"))


def equi_depth_approx(df: DataFrame, column: Column, buckets: int = BUCKETS) -> DataFrame:
    """The same for any size, from mergeable quantile summaries; one pass, no order of all rows."""
    v = df.select(column.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    cuts = v.agg(F.percentile_approx("v", [i / buckets for i in range(buckets + 1)], 10_000).alias("q"), F.count("*").alias("n"))
    parts = cuts.select(F.posexplode(F.slice("q", 1, buckets)).alias("bucket", "low"), "q", "n")
    return parts.select((F.col("bucket") + 1).alias("bucket"), "low", F.element_at("q", F.col("bucket") + 2).alias("high"), (F.col("n") / buckets).cast("bigint").alias("n"))


def top_values(df: DataFrame, column: Column, k: int = TOP) -> DataFrame:
    """(value, n): the most frequent values, ties in order of value."""
    v = df.select(column.alias("value")).where("value is not null")
    return v.groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def bool_counts(df: DataFrame, column: Column) -> DataFrame:
    return df.select(column.alias("v")).agg(F.count_if("v").alias("n_true"), F.count_if(~F.col("v")).alias("n_false"))


def array_stats(df: DataFrame, column: Column, k: int = TOP) -> tuple[DataFrame, DataFrame]:
    """(most frequent members, average length); a member counts as often as it occurs."""
    v = df.select(column.alias("v")).where("v is not null")
    return top_values(v.select(F.explode("v").alias("m")), F.col("m"), k), v.agg(F.avg(F.size("v")).alias("average_length"))


def presence(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(field, rows, nulls, distinct) of several fields in one pass."""
    aggs = [x for n, c in columns.items() for x in (F.count(c).alias(f"{n}.rows"), F.count_if(c.isNull()).alias(f"{n}.nulls"), F.countDistinct(c).alias(f"{n}.distinct"))]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"`{n}.rows`").alias("rows"), F.col(f"`{n}.nulls`").alias("nulls"), F.col(f"`{n}.distinct`").alias("distinct")) for n in columns])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def collect_stats(rows: DataFrame) -> dict:
    """Statistics of every key of the bags: {field: {...}}, plus the row count under ''."""
    long = rows.select(F.explode("metadata").alias("k", "v"))
    number = F.coalesce(F.col("v.i").cast("double"), F.col("v.d"))
    kinds = long.groupBy("k").agg(
        F.count("*").alias("rows"), F.collect_set(F.when(F.col("v.t").isin("i", "f"), "n").otherwise(F.col("v.t"))).alias("kinds"),
        F.approx_count_distinct(F.coalesce("v.s", number.cast("string"), F.col("v.b").cast("string"))).alias("distinct"),
        F.percentile_approx(number, [i / BUCKETS for i in range(BUCKETS + 1)], 10_000).alias("quantiles"), F.min(number).alias("low"), F.max(number).alias("high"),
        F.count_if("v.b").alias("n_true"), F.avg(F.when(F.col("v.t") == "a", F.size("v.a"))).alias("average_length"),
    )
    strings = long.where("v.t = 's'").select("k", F.col("v.s").alias("value"))
    members = long.where("v.t = 'a'").select("k", F.explode("v.a").alias("m")).where("m.t = 's'").select("k", F.col("m.s").alias("value"))
    place = Window.partitionBy("k").orderBy(F.desc("n"), "value")
    top = strings.unionAll(members).groupBy("k", "value").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(place)).where(F.col("r") <= TOP)
    total = rows.count()
    out: dict = {"": {"rows": total}}
    for r in kinds.orderBy(F.desc("rows"), "k").limit(KEYS).collect():
        kind = r["kinds"][0] if len(r["kinds"]) == 1 else "mixed"
        out[r["k"]] = {"rows": r["rows"], "nulls": total - r["rows"], "distinct": 0 if kind == "mixed" else r["distinct"], "kind": kind, "quantiles": r["quantiles"], "low": r["low"], "high": r["high"], "n_true": r["n_true"], "average_length": r["average_length"], "top": []}
    for r in top.where(F.col("k").isin([k for k in out if k])).collect() if len(out) > 1 else []:
        out[r["k"]]["top"].append([r["value"], r["n"]])
    return out


def _below(s: dict, x: float) -> float:
    """The share of numbers below ``x``, by interpolation between quantiles."""
    q = s["quantiles"]
    if not q or x <= q[0]:
        return 0.0
    if x >= q[-1]:
        return 1.0
    n, out = len(q) - 1, 0.0
    for a, b in zip(q, q[1:], strict=False):
        out += 1 / n if b <= x else (x - a) / (b - a) / n if a < x else 0.0
    return min(out, 1.0)


def _atom_share(p, stats: dict, value) -> float | None:
    s = stats.get(p.field.name) if p.field.key is None else None
    if s is None or s["kind"] == "mixed" or not s["rows"]:
        return None
    if isinstance(p, t.IsNull):
        share = s["rows"] / max(1, stats[""]["rows"])
        return share if p.negated else 1 - share

    def equal(v) -> float | None:
        if s["kind"] == "b" and isinstance(v, bool):
            return (s["n_true"] if v else s["rows"] - s["n_true"]) / s["rows"]
        if s["kind"] in ("s", "a") and isinstance(v, str):
            known = dict(map(tuple, s["top"]))
            if v in known:
                return min(1.0, known[v] / s["rows"])
            return max(0.0, 1 - sum(known.values()) / s["rows"]) / max(1, s["distinct"] - len(known))
        if s["kind"] == "n" and isinstance(v, (int, float)) and not isinstance(v, bool):
            return 1 / max(1, s["distinct"]) if s["low"] <= v <= s["high"] else 0.0
        return 0.0

    if isinstance(p, t.Contains):
        return equal(p.value.value) if s["kind"] == "a" else 0.0
    if isinstance(p, t.In):
        return min(1.0, sum(equal(v.value) or 0.0 for v in p.values))
    if isinstance(p, t.Between):
        if s["kind"] != "n" or not all(isinstance(v.value, (int, float)) for v in (p.low, p.high)):
            return None
        return max(0.0, _below(s, float(p.high.value)) - _below(s, float(p.low.value)))
    v = value(p.value)
    if p.op == "=":
        return equal(v)
    if p.op == "!=":
        return 1 - (equal(v) or 0.0)
    if s["kind"] != "n" or not isinstance(v, (int, float)):
        return None
    below = _below(s, float(v))
    return below if p.op in ("<", "<=") else 1 - below


def selectivity(p, stats: dict, value=lambda v: getattr(v, "value", None)) -> float | None:
    """The estimated share of rows that satisfy ``p``; None if a part is unknown."""
    if isinstance(p, t.Constant):
        return float(p.value)
    if isinstance(p, t.Not):
        inner = selectivity(p.part, stats, value)
        return None if inner is None else 1 - inner
    if isinstance(p, (t.And, t.Or)):
        parts = [selectivity(x, stats, value) for x in p.parts]
        if any(x is None for x in parts):
            return None
        out = 1.0
        for x in parts:
            out *= x if isinstance(p, t.And) else 1 - x
        return out if isinstance(p, t.And) else 1 - out
    return None if isinstance(p, t.Threshold) else _atom_share(p, stats, value)
