"""Posting tables: secondary indexes as Parquet, ordered by their key.

A posting is (tag, s, i, d, b, id).  Hash and btree indexes hold a row for every value (of arrays and
maps just the tag), an inverted one the members of arrays and, with the tag of presence, a
row for every value; so all three answer IS NOT NULL.  Rows are dealt by ranges of (value, id), so a common
value is spread over files and row groups are skipped for values and ranges alike.  An index answers an
atom only where its answer is the scan's: tags keep types apart, integers and doubles compare with
each other as in scans.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..language import tree as t

PRESENT = "p"
POSTING = "t string, s string, i bigint, d double, b boolean, id bigint"


def build(rows: DataFrame, field: str, method: str) -> DataFrame:
    v = F.try_element_at(F.col("metadata"), F.lit(field))
    if method == "inverted":
        member = rows.select("id", F.explode(F.when(v["t"] == "a", v["a"])).alias("v")).where("v.t <> 'j'").distinct()
        here = rows.where(v.isNotNull()).select(F.lit(PRESENT).alias("t"), *[F.lit(None).cast(k).alias(c) for c, k in (("s", "string"), ("i", "bigint"), ("d", "double"), ("b", "boolean"))], "id")
        out = member.select("v.t", "v.s", "v.i", "v.d", "v.b", "id").unionAll(here)
    else:
        out = rows.select("id", v.alias("v")).where("v is not null").select("v.t", "v.s", "v.i", "v.d", "v.b", "id")
    number = F.coalesce(F.col("i").cast("double"), F.col("d"))
    return out.repartitionByRange(F.col("s"), number, F.col("b"), F.col("id")).sortWithinPartitions("s", number, "b", "id")


def _test(op: str, value) -> Column | None:
    """Postings whose value compares so with ``value``; None if none can."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return F.lit(False)
    ops: dict[str, Callable] = {"=": lambda c, v: c == v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "!=": lambda c, v: c != v}
    if isinstance(value, bool):
        return (F.col("t") == "b") & ops[op](F.col("b"), F.lit(value))
    if isinstance(value, str):
        return (F.col("t") == "s") & ops[op](F.col("s"), F.lit(value))
    literal = F.lit(value).cast("bigint") if isinstance(value, int) else F.lit(value)
    return ((F.col("t") == "i") & ops[op](F.col("i"), literal)) | ((F.col("t") == "f") & ~F.isnan("d") & ops[op](F.col("d"), literal))


Value = Callable[[object], object]


def _atom(p, fresh: dict[tuple[str, str], str], value: Value) -> tuple[str, Column] | None:
    """(index, condition on its postings) that answers an atom."""
    ref = getattr(p, "field", None)
    if ref is None or ref.key is not None or ref.name.lower() == "id":
        return None
    scalar = fresh.get((ref.name, "hash")) or fresh.get((ref.name, "btree"))
    ordered = fresh.get((ref.name, "btree"))
    if isinstance(p, t.IsNull) and p.negated:
        members = fresh.get((ref.name, "inverted"))
        return (scalar, F.lit(True)) if scalar else (members, F.col("t") == PRESENT) if members else None
    if isinstance(p, t.Compare):
        name = scalar if p.op in ("=", "!=") else ordered
        return (name, _test(p.op, value(p.value))) if name else None
    if isinstance(p, t.In) and scalar:
        out = F.lit(False)
        for v in p.values:
            out = out | _test("=", v.value)
        return scalar, out
    if isinstance(p, t.Between) and ordered:
        return ordered, _test(">=", p.low.value) & _test("<=", p.high.value)
    if isinstance(p, t.Contains):
        name = fresh.get((ref.name, "inverted"))
        return (name, _test("=", p.value.value)) if name else None
    return None


def evaluate(p, fresh: dict[tuple[str, str], str], postings: Callable[[str], DataFrame], value: Value) -> DataFrame | None:
    """Distinct ids that satisfy ``p`` by indexes alone, or None if they can't tell; ``value`` gives literals and parameters."""
    if isinstance(p, (t.And, t.Or)):
        parts = [evaluate(x, fresh, postings, value) for x in p.parts]
        if any(x is None for x in parts):
            return None
        out = parts[0]
        for x in parts[1:]:
            out = out.join(x, "id", "left_semi") if isinstance(p, t.And) else out.unionAll(x)
        return out if isinstance(p, t.And) else out.distinct()
    answer = _atom(p, fresh, value)
    return None if answer is None else postings(answer[0]).where(answer[1]).select("id")


def split(p, fresh: dict[tuple[str, str], str], postings: Callable[[str], DataFrame], value: Value, worth: Callable[[object], bool] = lambda p: True) -> tuple[DataFrame | None, object]:
    """(ids by indexes, what is left to test): parts of an AND that indexes can't answer, or aren't worth it, stay a filter."""
    ids, rest = None, []
    for x in p.parts if isinstance(p, t.And) else [p]:
        got = evaluate(x, fresh, postings, value) if worth(x) else None
        if got is None:
            rest.append(x)
        else:
            ids = got if ids is None else ids.join(got, "id", "left_semi")
    return ids, None if not rest else rest[0] if len(rest) == 1 else t.And(tuple(rest))
