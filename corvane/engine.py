"""Statements in, DataFrames and command results out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .errors import ExecutionError, PlanError
from .language import tree as t
from .language.binder import BoundSelect, bind, bind_select, single_id, split_distance
from .language.parser import parse
from .language.printer import to_sql
from .operators.stats import selectivity
from .plans.select import SelectPlan


class Params:
    """Positional ($1 is the first) and named parameters."""

    def __init__(self, *positional, **named):
        self.positional, self.named = list(positional), dict(named)

    def with_positional(self, value) -> Params:
        return Params(*self.positional, value, **self.named)

    def with_named(self, name: str, value) -> Params:
        return Params(*self.positional, **(self.named | {name: value}))

    def resolve(self, p: t.Param):
        if isinstance(p.key, int):
            if not 1 <= p.key <= len(self.positional):
                raise ExecutionError(f"${p.key} is not bound")
            return self.positional[p.key - 1]
        if p.key not in self.named:
            raise ExecutionError(f"${p.key} is not bound")
        return self.named[p.key]


@dataclass(frozen=True)
class CommandResult:
    """What a statement other than SELECT did."""

    kind: str  # insert update delete create_index drop_index vacuum checkpoint
    table: str | None = None
    count: int | None = None
    name: str | None = None
    lsn: int | None = None


class Engine:
    """Runs statements over named collections; names compare without case."""

    def __init__(self, spark: SparkSession, **collections):
        self.spark = spark
        self.collections = {k.lower(): v for k, v in collections.items()}

    def collection(self, name: str, write: bool = False):
        c = self.collections.get(name.lower())
        if c is None:
            raise ExecutionError(f"no collection named {name}")
        if write and not c.writable:
            raise PlanError(f"{name} is read-only")
        return c

    def plan(self, sql: str, params: Params | None = None) -> DataFrame:
        """The lazy DataFrame of a SELECT; runs no job."""
        q = bind(parse(sql))
        if not isinstance(q, BoundSelect):
            raise PlanError("only a SELECT has a plan")
        return self._select(q, params or Params())

    def execute(self, sql: str, params: Params | None = None) -> DataFrame | CommandResult:
        return self.run(parse(sql), params or Params())

    def run(self, statement, params: Params) -> DataFrame | CommandResult:
        x = bind(statement)
        return getattr(self, f"_{type(x).__name__.lower()}")(x, params)

    def _boundselect(self, q: BoundSelect, params: Params) -> DataFrame:
        return self._select(q, params)

    def _select(self, q: BoundSelect, params: Params) -> DataFrame:
        return SelectPlan(self.collection(q.table), params.resolve).build(q)

    def _explain(self, x: t.Explain, params: Params) -> DataFrame:
        """Canonical text, estimated share of rows and Spark's plan."""
        q = bind_select(x.select)
        c = self.collection(q.table)
        df = self._select(q, params)
        stats = getattr(c, "stats", None)
        value = lambda v: params.resolve(v) if isinstance(v, t.Param) else v.value
        share = selectivity(q.where, stats, value) if stats and q.where is not None else None
        plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        rows = [("statement", to_sql(x.select)), ("selectivity", None if share is None else f"{share:.6f}"), ("plan", plan)]
        return self.spark.createDataFrame(rows, "what string, text string")

    def _insert(self, x: t.Insert, params: Params) -> CommandResult:
        c = self.collection(x.table, write=True)
        if x.batch is not None:
            batch = params.resolve(x.batch)
            if not isinstance(batch, DataFrame):
                if not isinstance(batch, (list, tuple)) or any(len(r) != 3 for r in batch):
                    raise ExecutionError(f"${x.batch.key} is not a batch of (id, embedding, metadata)")
                batch = list(batch)
            return CommandResult("insert", x.table, c.insert_many(batch))
        id, vector, bag = map(params.resolve, x.row)
        if not isinstance(bag, (dict, type(None))):
            raise ExecutionError("metadata is not a mapping")
        if isinstance(vector, (str, int, float, type(None))):
            raise ExecutionError("embedding is not a vector")
        return CommandResult("insert", x.table, c.insert(id, vector, bag))

    def _one(self, c, value, params: Params) -> int:
        """The id of a statement whose predicate is ``id = value``."""
        id = params.resolve(value) if isinstance(value, t.Param) else value.value
        if not isinstance(id, int) or isinstance(id, bool) or id < 0:
            raise ExecutionError(f"not an id: {id!r}")
        return id

    def _delete(self, x: t.Delete, params: Params) -> CommandResult:
        c = self.collection(x.table, write=True)
        value = single_id(x.where)
        if value is not None:
            return CommandResult("delete", x.table, c.delete(self._one(c, value, params)))
        where, within = split_distance(x.where)
        return CommandResult("delete", x.table, c.delete_where(SelectPlan(c, params.resolve).predicate(where, within)))

    def _update(self, x: t.Update, params: Params) -> CommandResult:
        c = self.collection(x.table, write=True)
        assigned = [(a.field, params.resolve(a.value) if isinstance(a.value, t.Param) else a.value.value) for a in x.assignments]
        value = single_id(x.where)
        if value is not None:
            id = self._one(c, value, params)
            if not c.contains(id):
                raise ExecutionError(f"id {id} is not in {x.table}")
        where, within = split_distance(x.where)
        return CommandResult("update", x.table, c.update_where(SelectPlan(c, params.resolve).predicate(where, within), assigned))

    def _createindex(self, x: t.CreateIndex, params: Params) -> CommandResult:
        self.collection(x.table, write=True).create_index(x.name, x.field, x.method)
        return CommandResult("create_index", x.table, name=x.name)

    def _dropindex(self, x: t.DropIndex, params: Params) -> CommandResult:
        self.collection(x.table, write=True).drop_index(x.name)
        return CommandResult("drop_index", x.table, name=x.name)

    def _vacuum(self, x: t.Vacuum, params: Params) -> CommandResult:
        return CommandResult("vacuum", x.table, self.collection(x.table, write=True).vacuum())

    def _checkpoint(self, x: t.Checkpoint, params: Params) -> CommandResult:
        done = [c.checkpoint() for c in self.collections.values() if c.writable]
        return CommandResult("checkpoint", lsn=max(done, default=0))
