"""Predicates as columns, with two-valued logic over absent fields.

An atom on an absent field, or on one of another type, is false, and NOT flips
that to true.  In a filter NULL counts as false, so atoms outside NOT stay bare and
can be pushed to the scan; under NOT they are wrapped.  Integers and doubles compare
with each other; a NaN compares with nothing, not even as unequal.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ExecutionError, PlanError
from ..language import tree as t
from .fields import Field

_OPS: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def _tags(value) -> tuple[str, ...]:
    """Types that a value compares with."""
    if isinstance(value, bool):
        return ("b",)
    if isinstance(value, str):
        return ("s",)
    return ("i", "f") if isinstance(value, (int, float)) else ()


def _literal(value) -> Column:
    if isinstance(value, int) and not isinstance(value, bool):
        return F.lit(value).cast("bigint")
    return F.lit(value)


def _any(parts: list[Column], static: bool) -> Column:
    if not parts:
        return F.lit(False)
    if len(parts) == 1:
        return parts[0]
    # tags exclude each other; NULL where another tag applies
    out = F.coalesce(parts[0], F.lit(False))
    for p in parts[1:]:
        out = out | F.coalesce(p, F.lit(False))
    return out


def _over(field: Field, value, test: Callable[[Column], Column], nan_safe: bool) -> Column:
    """``test`` on the field's columns that ``value`` compares with."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return F.lit(False)
    parts = []
    for tag in _tags(value):
        if tag in field.typed:
            c = field.typed[tag]
            parts.append(test(c) & ~F.isnan(c) if tag == "f" and not nan_safe else test(c))
    return _any(parts, field.static)


class Compiler:
    """Compiles predicates against a resolver of fields; ``param`` gives a parameter's value."""

    def __init__(self, resolve: Callable[[t.FieldRef], Field], param: Callable[[t.Param], object]):
        self.resolve, self.param = resolve, param

    def __call__(self, p) -> Column:
        return self._node(p, False)

    def _node(self, p, negated: bool) -> Column:
        if isinstance(p, t.And):
            parts = [self._node(x, negated) for x in p.parts]
            out = parts[0]
            for x in parts[1:]:
                out = out & x
            return out
        if isinstance(p, t.Or):
            parts = [self._node(x, negated) for x in p.parts]
            out = parts[0]
            for x in parts[1:]:
                out = out | x
            return out
        if isinstance(p, t.Not):
            return ~self._node(p.part, True)
        atom = self._atom(p)
        return F.coalesce(atom, F.lit(False)) if negated else atom

    def value(self, v):
        if isinstance(v, t.Literal):
            return v.value
        got = self.param(v)
        if got is not None and not isinstance(got, (str, int, float, bool)):
            raise ExecutionError(f"${v.key} can't be compared with a field")
        return got

    def _atom(self, p) -> Column:
        if isinstance(p, t.Constant):
            return F.lit(p.value)
        if isinstance(p, t.Threshold):
            raise PlanError("a distance limit can't stand here")
        field = self.resolve(p.field)
        if isinstance(p, t.IsNull):
            return field.present if p.negated else ~field.present
        if isinstance(p, t.Compare):
            v = self.value(p.value)
            # NaN is largest to Spark, so < <= and = need no guard
            return _over(field, v, lambda c: _OPS[p.op](c, _literal(v)), p.op in ("<", "<=", "="))
        if isinstance(p, t.In):
            values = [x.value for x in p.values if x.value is not None]
            if not values:
                return F.lit(False)
            parts = []
            for tag in field.typed:
                same = [v for v in values if tag in _tags(v)]
                if same:
                    c = field.typed[tag]
                    whole = [v for v in same if type(v) is int]
                    if tag in ("i", "f") and len(whole) < len(same):
                        parts.append(c.cast("double").isin([float(v) for v in same]))
                    else:
                        parts.append(c.isin([_literal(v) for v in same]))
            return _any(parts, field.static)
        if isinstance(p, t.Between):
            low, high = p.low.value, p.high.value
            return self._both(_over(field, low, lambda c: c >= _literal(low), False), _over(field, high, lambda c: c <= _literal(high), True))
        if isinstance(p, t.Contains):
            return self._contains(field, p.value.value)
        raise TypeError(f"not a predicate: {p!r}")

    @staticmethod
    def _both(a: Column, b: Column) -> Column:
        return a & b

    @staticmethod
    def _contains(field: Field, value) -> Column:
        if value is None or "a" not in field.typed:
            return F.lit(False)
        array = field.typed["a"]
        if field.static:
            if not field.elements or field.elements[0] not in _tags(value):
                return F.lit(False)
            if field.elements[0] in ("i", "f"):
                return F.exists(array, lambda x: F.coalesce(x == _literal(value), F.lit(False)))
            return F.array_contains(array, value)
        member = {"s": "s", "i": "i", "f": "d", "b": "b"}
        tags = _tags(value)
        return F.exists(array, lambda x: _any([F.when(x["t"] == tag, x[member[tag]] == _literal(value)) for tag in tags], False) if len(tags) > 1 else F.coalesce((x["t"] == tags[0]) & (x[member[tags[0]]] == _literal(value)), F.lit(False)))
