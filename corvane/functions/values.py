"""Values of open bags: a tagged struct, so that types never coerce.

A bag is ``map<string, VALUE>``.  A VALUE's tag says which member holds it: ``s`` string,
``i`` 64-bit integer, ``f`` double, ``b`` boolean, ``a`` array, ``m`` map.  Members of arrays and maps
are scalars of the same shape; what is nested deeper is kept as JSON (tag ``j``).
Tagged members compare by Catalyst's own typed comparisons, which VARIANT would not
do (it coerces on extraction and has no order).
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ExecutionError, InvalidVector

SCALAR = "struct<t:string,s:string,i:bigint,d:double,b:boolean>"
VALUE = f"struct<t:string,s:string,i:bigint,d:double,b:boolean,a:array<{SCALAR}>,m:map<string,{SCALAR}>>"
BAG = f"map<string,{VALUE}>"
ROW = f"id bigint, embedding array<float>, metadata {BAG}"


def _scalar(v) -> tuple:
    if isinstance(v, bool):
        return ("b", None, None, None, v)
    if isinstance(v, str):
        return ("s", v, None, None, None)
    if isinstance(v, int):
        if not -(2**63) <= v < 2**63:
            raise ExecutionError(f"integer out of range: {v}")
        return ("i", None, v, None, None)
    if isinstance(v, float):
        return ("f", None, None, v, None)
    return ("j", json.dumps(v, sort_keys=True), None, None, None)


def encode(v) -> tuple:
    """A Python value as a VALUE row."""
    if isinstance(v, (list, tuple)):
        return ("a", None, None, None, None, [_scalar(x) for x in v], None)
    if isinstance(v, dict):
        return ("m", None, None, None, None, None, {str(k): _scalar(x) for k, x in v.items() if x is not None})
    if v is None:
        raise ExecutionError("a bag holds no NULL; leave the key out")
    return (*_scalar(v), None, None)


def decode(v):
    """A VALUE row as a Python value."""
    if v is None:
        return None
    if v["t"] == "a":
        return [decode(x) for x in v["a"]]
    if v["t"] == "m":
        return {k: decode(x) for k, x in v["m"].items()}
    if v["t"] == "j":
        return json.loads(v["s"])
    return v[{"s": "s", "i": "i", "f": "d", "b": "b"}[v["t"]]]


def encode_bag(bag: dict | None) -> dict:
    return {str(k): encode(v) for k, v in (bag or {}).items() if v is not None}


def decode_bag(bag) -> dict:
    return {k: decode(v) for k, v in (bag or {}).items()}


def check_vector(v, dim: int | None = None) -> list[float]:
    out = [float(x) for x in v]
    if not out:
        raise InvalidVector("an empty vector")
    if not all(map(math.isfinite, out)):
        raise InvalidVector("a vector with a component that is not finite")
    return out


def value_column(v) -> Column:
    """A literal VALUE."""
    t, s, i, d, b, a, m = encode(v)

    members = [F.lit(c).cast(k).alias(n) for c, k, n in ((t, "string", "t"), (s, "string", "s"), (i, "bigint", "i"), (d, "double", "d"), (b, "boolean", "b"))]
    one = lambda x: F.struct(*[F.lit(c).cast(k).alias(n) for c, k, n in zip(x, ("string", "string", "bigint", "double", "boolean"), "tsidb", strict=True)])
    array = F.array(*[one(x) for x in a]) if a else F.array() if a is not None else F.lit(None)
    pairs = [y for k, x in (m or {}).items() for y in (F.lit(k), one(x))]
    mapped = F.create_map(*pairs) if m is not None else F.lit(None)
    return F.struct(*members, array.cast(f"array<{SCALAR}>").alias("a"), mapped.cast(f"map<string,{SCALAR}>").alias("m")).cast(VALUE)


def plain_json(value: Column) -> Column:
    """A VALUE as JSON text; for people and for comparing."""

    def scalar(x: Column) -> Column:
        return (
            F.when(x["t"] == "s", F.to_json(F.array(x["s"])).substr(F.lit(2), F.length(F.to_json(F.array(x["s"]))) - 2))
            .when(x["t"] == "i", x["i"].cast("string"))
            .when(x["t"] == "f", x["d"].cast("string"))
            .when(x["t"] == "b", x["b"].cast("string"))
            .when(x["t"] == "j", x["s"])
        )

    pairs = F.transform(F.array_sort(F.map_entries(value["m"])), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), scalar(e["value"])))
    return F.when(value["t"] == "a", F.concat(F.lit("["), F.array_join(F.transform(value["a"], scalar), ","), F.lit("]"))).when(value["t"] == "m", F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise(scalar(value))
