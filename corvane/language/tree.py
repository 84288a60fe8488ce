"""Syntax tree of statements; plain immutable values."""

from __future__ import annotations

from dataclasses import dataclass, field

COUNT = "count"
WILDCARD = "*"


@dataclass(frozen=True)
class Literal:
    """A string, int, float, bool or None."""

    value: str | int | float | bool | None


@dataclass(frozen=True)
class Param:
    """$1 (key 1) or $name (key 'name')."""

    key: int | str


@dataclass(frozen=True)
class FieldRef:
    name: str
    key: str | None = None


@dataclass(frozen=True)
class Distance:
    op: str  # <-> <=> <#>
    query: Param


@dataclass(frozen=True)
class Compare:
    field: FieldRef
    op: str  # = != < <= > >=
    value: Literal | Param


@dataclass(frozen=True)
class In:
    field: FieldRef
    values: tuple[Literal, ...]


@dataclass(frozen=True)
class Between:
    field: FieldRef
    low: Literal
    high: Literal


@dataclass(frozen=True)
class IsNull:
    field: FieldRef
    negated: bool


@dataclass(frozen=True)
class Contains:
    field: FieldRef
    value: Literal


@dataclass(frozen=True)
class Threshold:
    distance: Distance
    op: str
    value: float


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class Constant:
    """True or False; no syntax makes it."""

    value: bool


@dataclass(frozen=True)
class Item:
    """A projection: '*', COUNT, a name or a Distance."""

    what: str | Distance
    is_count: bool = False
    alias: str | None = None


@dataclass(frozen=True)
class Order:
    what: str | Distance
    descending: bool = False


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    table: str
    where: object = None
    order: tuple[Order, ...] = ()
    limit: int | None = None
    ann: int | None = None  # approximate, with this beam; 0: the index's own


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...]
    row: tuple[Param, ...] | None = None
    batch: Param | None = None


@dataclass(frozen=True)
class Assignment:
    field: FieldRef
    value: Literal | Param


@dataclass(frozen=True)
class Update:
    table: str
    assignments: tuple[Assignment, ...]
    where: object = field(default=None)


@dataclass(frozen=True)
class Delete:
    table: str
    where: object


@dataclass(frozen=True)
class CreateIndex:
    table: str
    method: str  # hash btree inverted
    field: str
    name: str | None = None


@dataclass(frozen=True)
class DropIndex:
    table: str
    name: str


@dataclass(frozen=True)
class Vacuum:
    table: str


@dataclass(frozen=True)
class Checkpoint:
    pass


@dataclass(frozen=True)
class Explain:
    """Not in the plain language: shows the plan of a SELECT."""

    select: Select
