"""Field references as typed columns.

A field gives, for each value type, a column that is NULL where the field is absent or
of another type.  Declared fields have one type, known before the query runs; then
comparisons with other types are false at once and the rest stays a plain
comparison, which Parquet scans can take.  Fields of open bags look at the tag.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..language.tree import FieldRef


@dataclass(frozen=True)
class Field:
    """``typed`` maps tags (s i f b a m) to columns; ``shown`` is what a projection gives."""

    typed: dict[str, Column]
    present: Column
    shown: Column
    static: bool
    elements: tuple[str, ...] = ()  # of a declared array: its members' tag


_TAGS = {T.StringType: "s", T.LongType: "i", T.IntegerType: "i", T.ShortType: "i", T.ByteType: "i", T.DoubleType: "f", T.FloatType: "f", T.DecimalType: "f", T.BooleanType: "b"}


def tag_of(kind: T.DataType) -> str:
    if isinstance(kind, T.ArrayType):
        return "a"
    if isinstance(kind, (T.MapType, T.StructType)):
        return "m"
    return _TAGS.get(type(kind), "s")


def declared(column: Column, kind: T.DataType) -> Field:
    """A column of a known type; narrow numbers widen, dates and the like are their text."""
    tag = tag_of(kind)
    if tag == "i" and not isinstance(kind, T.LongType):
        # left as it is: comparing with a long literal widens without hiding the column from the scan
        typed = column
    elif tag == "f" and not isinstance(kind, T.DoubleType):
        typed = column.cast("double")
    elif tag == "s" and not isinstance(kind, T.StringType):
        typed = column.cast("string")
    else:
        typed = column
    return Field({tag: typed}, column.isNotNull(), column, True, (tag_of(kind.elementType),) if tag == "a" else ())


def absent() -> Field:
    return Field({}, F.lit(False), F.lit(None).cast("string"), True)


class DeclaredFields:
    """Fields of a DataFrame: its columns by name, or what ``fields`` names; ``subscripts`` for name['key']."""

    def __init__(self, df: DataFrame, fields: dict[str, Column] | None = None, subscripts: dict[tuple[str, str], Column] | None = None):
        self.fields = fields if fields is not None else {c: F.col(c) for c in df.columns}
        self.subscripts = subscripts or {}
        names = list(self.fields)
        probe = df.select(*[self.fields[n].alias(f"f{i}") for i, n in enumerate(names)], *[c.alias(f"s{i}") for i, c in enumerate(self.subscripts.values())])
        self.kinds = {n: probe.schema[f"f{i}"].dataType for i, n in enumerate(names)}
        self.sub_kinds = {k: probe.schema[f"s{i}"].dataType for i, k in enumerate(self.subscripts)}

    def resolve(self, ref: FieldRef) -> Field:
        if ref.key is not None:
            if (ref.name, ref.key) in self.subscripts:
                return declared(self.subscripts[ref.name, ref.key], self.sub_kinds[ref.name, ref.key])
            kind = self.kinds.get(ref.name)
            if isinstance(kind, T.StructType) and ref.key in kind.names:
                return declared(self.fields[ref.name].getField(ref.key), kind[ref.key].dataType)
            if isinstance(kind, T.MapType):
                return declared(F.try_element_at(self.fields[ref.name], F.lit(ref.key)), kind.valueType)
            return absent()
        return declared(self.fields[ref.name], self.kinds[ref.name]) if ref.name in self.fields else absent()


class BagFields:
    """Fields of a ``metadata`` bag."""

    def __init__(self, bag: Column):
        self.bag = bag

    def resolve(self, ref: FieldRef) -> Field:
        v = F.try_element_at(self.bag, F.lit(ref.name))
        members = {"s": "s", "i": "i", "f": "d", "b": "b"}
        if ref.key is not None:
            v = F.try_element_at(F.when(v["t"] == "m", v["m"]), F.lit(ref.key))
        else:
            members |= {"a": "a", "m": "m"}
        return Field({tag: F.when(v["t"] == tag, v[m]) for tag, m in members.items()}, v.isNotNull(), v, False)
