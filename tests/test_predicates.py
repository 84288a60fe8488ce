"""The compiler against an evaluator in plain Python, over heterogeneous bags and declared fields."""

import math
import random

from pyspark.sql import functions as F

from corvane.functions import values
from corvane.language import tree as t
from corvane.plans.fields import BagFields, DeclaredFields
from corvane.plans.predicates import Compiler

VALUES = [1, 0, -3, 7, 1.0, 2.5, -0.0, 0.0, float("nan"), "1", "", "abc", True, False, ["a", "b"], [1, 2.0, "1"], [], {"k": 1, "l": "x"}, {"k": 1.0}, {}, 2**53 + 1, float(2**53)]
LITERALS = [1, 0, -3, 7, 1.0, 2.5, 0.0, "1", "", "abc", "b", True, False, None, 2**53 + 1]
ABSENT = object()


def kind(v):
    return "b" if isinstance(v, bool) else "s" if isinstance(v, str) else "n" if isinstance(v, (int, float)) else "x"


def compare(op, a, b):
    if b is None or kind(a) != kind(b) or kind(a) == "x":
        return False
    if kind(a) == "n" and (isinstance(a, float) or isinstance(b, float)):
        a, b = float(a), float(b)
        if math.isnan(a) or math.isnan(b):
            return False
    return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def get(row, ref):
    v = row.get(ref.name, ABSENT)
    if ref.key is None:
        return v
    return v.get(ref.key, ABSENT) if isinstance(v, dict) else ABSENT


def evaluate(p, row):
    if isinstance(p, t.And):
        return all(evaluate(x, row) for x in p.parts)
    if isinstance(p, t.Or):
        return any(evaluate(x, row) for x in p.parts)
    if isinstance(p, t.Not):
        return not evaluate(p.part, row)
    v = get(row, p.field)
    if isinstance(p, t.IsNull):
        return (v is not ABSENT) == p.negated
    if v is ABSENT:
        return False
    if isinstance(p, t.Compare):
        return compare(p.op, v, p.value.value)
    if isinstance(p, t.In):
        return any(compare("=", v, x.value) for x in p.values)
    if isinstance(p, t.Between):
        return compare(">=", v, p.low.value) and compare("<=", v, p.high.value)
    return isinstance(v, list) and any(compare("=", x, p.value.value) for x in v)


def predicate(r, refs, depth=3):
    x = r.random()
    if depth and x < 0.2:
        return t.Not(predicate(r, refs, depth - 1))
    if depth and x < 0.55:
        return r.choice([t.And, t.Or])((predicate(r, refs, depth - 1), predicate(r, refs, depth - 1)))
    ref, lit = r.choice(refs), lambda: t.Literal(r.choice(LITERALS))
    x = r.random()
    if x < 0.55:
        return t.Compare(ref, r.choice(["=", "!=", "<", "<=", ">", ">="]), lit())
    if x < 0.7:
        return t.In(ref, tuple(lit() for _ in range(r.randint(1, 4))))
    if x < 0.8:
        return t.Between(ref, lit(), lit())
    return t.IsNull(ref, r.random() < 0.5) if x < 0.9 else t.Contains(ref, lit())


def check(df, rows, compiler, refs, seed, n=60):
    r = random.Random(seed)
    predicates = [predicate(r, refs) for _ in range(n)]
    columns = [F.coalesce(compiler(p), F.lit(False)).alias(f"p{i}") for i, p in enumerate(predicates)]
    got = {x["id"]: x for x in df.select("id", *columns).collect()}
    for i, row in enumerate(rows):
        for j, p in enumerate(predicates):
            assert got[i][f"p{j}"] == evaluate(p, row), (row, p)


def test_bags(spark):
    r = random.Random(1)
    rows = [{"x": v} for v in VALUES] + [{}] + [{k: r.choice(VALUES) for k in ("x", "y") if r.random() < 0.8} for _ in range(60)]
    df = spark.createDataFrame([(i, values.encode_bag(b)) for i, b in enumerate(rows)], f"id bigint, metadata {values.BAG}")
    fields = BagFields(F.col("metadata"))
    refs = [t.FieldRef("x"), t.FieldRef("y"), t.FieldRef("x", "k"), t.FieldRef("y", "l"), t.FieldRef("z")]
    check(df, rows, Compiler(fields.resolve, lambda p: None), refs, 2)


def test_declared(spark):
    r = random.Random(3)
    kinds = {"i": [1, 0, -3, 7, 2**53 + 1], "f": [1.0, 2.5, 0.0, float("nan")], "s": ["1", "", "abc"], "b": [True, False], "a": [["a", "b"], [], ["1"]], "n": [1, 7]}
    rows = [{k: r.choice(v) for k, v in kinds.items() if r.random() < 0.8} for _ in range(80)]
    df = spark.createDataFrame([(i, *(b.get(k) for k in kinds)) for i, b in enumerate(rows)], "id bigint, i bigint, f double, s string, b boolean, a array<string>, n int")
    fields = DeclaredFields(df)
    check(df, rows, Compiler(fields.resolve, lambda p: None), [t.FieldRef(k) for k in kinds] + [t.FieldRef("zz")], 4)


def test_bags_come_back(spark):
    bag = {"a": 1, "b": 2.5, "c": "x", "d": True, "e": [1, "y", [2]], "f": {"k": 1.0, "l": {"m": 1}}}
    df = spark.createDataFrame([(1, values.encode_bag(bag))], f"id bigint, metadata {values.BAG}")
    assert values.decode_bag(df.first()["metadata"]) == bag
    shown = df.select(values.plain_json(F.element_at("metadata", "e")).alias("e"), values.plain_json(F.element_at("metadata", "f")).alias("f")).first()
    assert tuple(shown) == ('[1,"y",[2]]', '{"k":1.0,"l":{"m": 1}}')


def test_filters_reach_the_scan(spark, sf):
    from corvane.queries import views

    plan = views(spark, sf).plan("SELECT id FROM vectors WHERE label = 3 LIMIT 10")
    text = plan._sc._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "formatted")
    assert "EqualTo(label,3)" in text and "embedding" not in text.split("ReadSchema")[1].split("\n")[0]
