"""A bound SELECT as one lazy DataFrame; Catalyst plans the rest.

Filtered nearest neighbours are filter, distance column, order by (distance, id),
limit: Spark runs that as a per-partition top-k.  A radius is a filter on the
distance.  Results are exact, and ties are in order of id.  With ANN and a fresh enough
graph index the same plan runs over candidates only.

Indexes are used for parts of a predicate that statistics, where there are any, expect
to hold for ``INDEX_SHARE`` of the rows at most; else reading the rows is cheaper.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ExecutionError
from ..functions import values
from ..functions.distance import distance, once
from ..language import tree as t
from ..language.binder import BoundSelect
from ..operators import indexes
from ..operators.stats import selectivity
from .predicates import Compiler

INDEX_SHARE = 0.3
#: Above this limit the rows of the table are counted first.
LARGE = 1 << 20


class SelectPlan:
    def __init__(self, collection, param: Callable[[t.Param], object]):
        self.c, self.param = collection, param
        self.made: dict[t.Distance, str] = {}
        self.compile = Compiler(collection.resolve, param)

    def vector(self, p: t.Param) -> list[float]:
        v = self.param(p)
        if v is None or isinstance(v, (str, bool, int, float, dict)):
            raise ExecutionError(f"${p.key} is not a vector")
        return self.c.check_query(v) if hasattr(self.c, "check_query") else values.check_vector(v)

    def distance(self, d: t.Distance) -> Column:
        if d in self.made:
            return F.col(self.made[d])
        return distance(self.c.embedding, d.op, self.vector(d.query))

    def measured(self, rows: DataFrame, q: BoundSelect) -> DataFrame:
        """``rows`` with a column for each distance that the statement names, so that it is worked out once a row.

        Vectors of another length (or none) have no distance and drop out.
        """
        named = [x.what for x in (*q.order, *q.items) if isinstance(x.what, t.Distance)] + [w.distance for w in q.within]
        for d in dict.fromkeys(named):
            column = self.distance(d)
            if any(o.what == d for o in q.order):
                rows = rows.where(F.size(self.c.embedding) == len(self.vector(d.query)))
            column = once(column) if any(w.distance == d for w in q.within) else column
            rows = rows.withColumn(name := f"__distance_{len(self.made)}", column)
            self.made[d] = name
        return rows

    def within(self, w: tuple[t.Threshold, ...]) -> Column:
        out = F.lit(True)
        for x in w:
            d = self.distance(x.distance)
            out = out & (d < x.value if x.op == "<" else d <= x.value)
        return out

    def _worth(self, p) -> bool:
        """Whether an index is expected to pay for a part of a predicate."""
        stats = getattr(self.c, "stats", None)
        share = selectivity(p, stats, self.compile.value) if stats else None
        return share is None or share <= INDEX_SHARE

    def filtered(self, where, rows: DataFrame | None = None) -> DataFrame:
        whole = rows is None
        rows = self.c.rows() if whole else rows
        if where is None:
            return rows
        if whole and self.c.writable and (fresh := self.c._fresh()):
            ids, rest = indexes.split(where, fresh, self.c.postings, self.compile.value, self._worth)
            if ids is not None:
                rows, where = rows.join(ids, "id", "left_semi"), rest
        return rows if where is None else rows.where(self.compile(where))

    def predicate(self, where, within: tuple[t.Threshold, ...]) -> Column:
        """One column for UPDATE and DELETE."""
        out = F.lit(True) if where is None else F.coalesce(self.compile(where), F.lit(False))
        return out & F.coalesce(self.within(within), F.lit(False)) if within else out

    def _named(self, name: str) -> tuple[Column, str]:
        low = name.lower()
        if low == "id":
            return self.c.id, "id"
        if low == "metadata":
            return self.c.metadata, "metadata"
        if low == "embedding":
            return self.c.embedding, "embedding"
        return self.c.resolve(t.FieldRef(name)).shown, name

    def _item(self, i: t.Item) -> list[Column]:
        if i.what == t.WILDCARD:
            return [self.c.id.alias("id"), self.c.metadata.alias("metadata")]
        if isinstance(i.what, t.Distance):
            return [self.distance(i.what).alias(i.alias)]
        column, name = self._named(i.what)
        return [column.alias(i.alias or name)]

    def _keys(self, o: t.Order) -> list[Column]:
        if isinstance(o.what, t.Distance):
            return [self.distance(o.what).asc()]
        if o.what.lower() == "id":
            columns = [self.c.id]
        else:
            f = self.c.resolve(t.FieldRef(o.what))
            # by type, as values of different types have no order among each other
            number = [f.typed[k].cast("double") for k in ("i", "f") if k in f.typed]
            columns = ([F.coalesce(*number)] if number else []) + [f.typed[k] for k in ("s", "b") if k in f.typed]
        return [c.desc_nulls_last() if o.descending else c.asc_nulls_last() for c in columns]

    def candidates(self, q: BoundSelect) -> DataFrame | None:
        """The rows that a graph index proposes; None without one."""
        if q.within:
            d = q.within[0].distance
            return self.c.ann_within(d.op, self.vector(d.query), q.within[0].value)
        d = q.order[0].what
        keep = lambda rows: self.filtered(q.where, rows)
        return self.c.ann_nearest(d.op, self.vector(d.query), q.limit, q.ann or None, keep)

    def build(self, q: BoundSelect) -> DataFrame:
        if q.count_as is not None:
            if q.where is not None and not q.within and self.c.writable:
                ids = self.c.count_by_index(q.where, self.compile.value)
                if ids is not None:
                    return ids.agg(F.count("*").alias(q.count_as))
            rows = self.filtered(q.where)
            rows = rows.where(self.within(q.within)) if q.within else rows
            return rows.agg(F.count("*").alias(q.count_as))
        rows = self.measured(self.filtered(q.where, self.candidates(q) if q.ann is not None and self.c.writable else None), q)
        if q.within:
            rows = rows.where(self.within(q.within))
        keys = [k for o in q.order for k in self._keys(o)]
        if not q.order and q.within:
            keys = [self.distance(q.within[0].distance).asc()]
        if keys:
            rows = rows.orderBy(*keys, self.c.id)
        if q.limit is not None:
            # a top-k sets aside room for twice its limit in each task: a limit beyond the table is the table's size
            beyond = keys and q.limit > LARGE and not rows.isStreaming
            rows = rows.limit(min(q.limit, self.c.rows().count()) if beyond else q.limit)
        return rows.select(*[c for i in q.items for c in self._item(i)])
