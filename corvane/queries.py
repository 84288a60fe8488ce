"""The engine's queries over the given tables, each with DuckDB's equivalent.

Statements go through the whole path: parser, binder, plan.  ``VECTOR`` is the
embedding of vec_id 0, read from the table; distances are rounded to six places on both
sides, and radii lie away from any distance that occurs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine, Params
from .errors import QueryError
from .functions import values
from .language import tree as t
from .language.parser import parse, parse_predicate
from .language.printer import to_sql
from .operators import stats
from .ship import ship
from .sources.collection import CheckpointPolicy, Collection, ViewCollection
from .sources.scratch import scratch_folder

Query = Callable[[SparkSession, str], DataFrame]
_Q = "(SELECT embedding::DOUBLE[64] FROM embeddings WHERE vec_id = 0)"
_E = "embedding::DOUBLE[64]"
_L2 = f"array_distance({_E}, {_Q})"
_COS = f"array_cosine_distance({_E}, {_Q})"
_IP = f"array_negative_inner_product({_E}, {_Q})"


def _view(spark: SparkSession, sf_dir: str, name: str) -> ViewCollection:
    read = lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if name == "vectors":
        return ViewCollection(read("embeddings"), "vec_id", "embedding", {"label": F.col("label")})
    if name == "events":
        return ViewCollection(read("events"), "event_id", None, {c: F.col(c) for c in ("event_type", "value", "user_id")}, {("props", "k"): F.get_json_object("props", "$.k").cast("bigint")})
    if name == "docs":
        docs = read("documents").join(read("labels"), "doc_id", "left")
        return ViewCollection(docs, "doc_id", None, {"lang": F.col("lang"), "source": F.col("source"), "n_chars": F.col("n_chars"), "quality": F.col("quality"), "toxic": F.col("toxic"), "words": F.split(F.coalesce("text", F.lit("")), " ")})
    if name == "orders":
        return ViewCollection(read("orders"), "o_orderkey", None, {"status": F.col("o_orderstatus"), "total": F.col("o_totalprice"), "priority": F.col("o_orderpriority"), "customer": F.col("o_custkey")})
    return ViewCollection(read("lineitem"), "l_orderkey", None, {"quantity": F.col("l_quantity"), "discount": F.col("l_discount"), "flag": F.col("l_returnflag"), "line": F.col("l_linenumber")})


NAMES = ("vectors", "events", "docs", "orders", "lines")


def views(spark: SparkSession, sf_dir: str, *names: str) -> Engine:
    """An engine over the given tables as read-only collections; only the named ones are opened."""
    ship(spark)
    return Engine(spark, **{n: _view(spark, sf_dir, n) for n in names or NAMES})


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return [float(x) for x in spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id = 0").first()["embedding"]]


def _sql(statement: str, vector: bool = False, rounded: tuple[str, ...] = (), **params) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bound = Params(query_vector(spark, sf_dir), **params) if vector else Params(**params)
        out = views(spark, sf_dir, parse(statement).table).execute(statement, bound)
        return out.withColumns({c: F.round(c, 6) for c in rounded})

    return run


_KNN = "SELECT id, embedding {op} $1 AS d FROM vectors {where}ORDER BY embedding {op} $1 LIMIT {k}"


def _knn(op: str, where: str = "", k: int = 10) -> Query:
    return _sql(_KNN.format(op=op, where=f"WHERE {where} " if where else "", k=k), True, ("d",))


def _knn_oracle(expr: str, where: str = "TRUE", k: int = 10) -> str:
    return f"SELECT vec_id AS id, round({expr}, 6) AS d FROM embeddings WHERE {where} ORDER BY {expr}, vec_id LIMIT {k}"


def _count(table: str, where: str) -> Query:
    return _sql(f"SELECT COUNT(*) AS n FROM {table} WHERE {where}")


_DOCS = "(SELECT documents.*, quality, toxic, string_split(coalesce(text, ''), ' ') AS words FROM documents LEFT JOIN labels USING (doc_id))"
_EVENTS = "(SELECT *, (props::JSON->>'k')::BIGINT AS k FROM events)"

#: name -> (query, oracle)
PLAIN: dict[str, tuple[Query, str]] = {
    "knn_l2": (_knn("<->"), _knn_oracle(_L2)),
    "knn_cosine": (_knn("<=>"), _knn_oracle(_COS)),
    "knn_ip": (_knn("<#>"), _knn_oracle(_IP)),
    "knn_filtered_eq": (_knn("<->", "label = 3"), _knn_oracle(_L2, "label = 3")),
    "knn_filtered_in": (_knn("<=>", "label IN (1, 2, 3)"), _knn_oracle(_COS, "label IN (1, 2, 3)")),
    "knn_filtered_between": (_knn("<->", "label BETWEEN 2 AND 5"), _knn_oracle(_L2, "label BETWEEN 2 AND 5")),
    "knn_filtered_not": (_knn("<->", "NOT label = 3"), _knn_oracle(_L2, "NOT coalesce(label = 3, FALSE)")),
    "knn_filtered_or": (_knn("<#>", "label = 1 OR label > 7"), _knn_oracle(_IP, "label = 1 OR label > 7")),
    "knn_limit_exceeds_matches": (_knn("<->", "label = 3", 1_000_000), _knn_oracle(_L2, "label = 3", 1_000_000)),
    "knn_limit_zero": (_knn("<->", k=0), _knn_oracle(_L2, k=0)),
    "knn_within": (_knn("<->", "embedding <-> $1 < 1.3", 20), _knn_oracle(_L2, f"{_L2} < 1.3", 20)),
    "knn_other_metric_projected": (_sql("SELECT id, embedding <=> $1 AS c, embedding <-> $1 AS d FROM vectors ORDER BY embedding <-> $1 LIMIT 10", True, ("c", "d")), f"SELECT vec_id AS id, round({_COS}, 6) AS c, round({_L2}, 6) AS d FROM embeddings ORDER BY {_L2}, vec_id LIMIT 10"),
    "radius_le": (_sql("SELECT id, embedding <-> $1 AS d FROM vectors WHERE embedding <-> $1 <= 1.3", True, ("d",)), f"SELECT vec_id AS id, round({_L2}, 6) AS d FROM embeddings WHERE {_L2} <= 1.3"),
    "radius_lt": (_sql("SELECT id FROM vectors WHERE embedding <=> $1 < 0.8", True), f"SELECT vec_id AS id FROM embeddings WHERE {_COS} < 0.8"),
    "radius_residue": (_sql("SELECT id, label FROM vectors WHERE embedding <-> $1 <= 1.35 AND label != 3", True), f"SELECT vec_id AS id, label FROM embeddings WHERE {_L2} <= 1.35 AND label <> 3"),
    "radius_two": (_sql("SELECT id FROM vectors WHERE embedding <-> $1 <= 1.35 AND embedding <=> $1 < 0.8", True), f"SELECT vec_id AS id FROM embeddings WHERE {_L2} <= 1.35 AND {_COS} < 0.8"),
    "radius_limit": (_sql("SELECT id, embedding <-> $1 AS d FROM vectors WHERE embedding <-> $1 <= 1.3 LIMIT 5", True, ("d",)), f"SELECT vec_id AS id, round({_L2}, 6) AS d FROM embeddings WHERE {_L2} <= 1.3 ORDER BY {_L2}, vec_id LIMIT 5"),
    "radius_ip": (_sql("SELECT id FROM vectors WHERE embedding <#> $1 <= -0.1", True), f"SELECT vec_id AS id FROM embeddings WHERE {_IP} <= -0.1"),
    "count_all": (_sql("SELECT COUNT(*) FROM lines"), "SELECT count(*) AS count FROM lineitem"),
    "count_where": (_count("lines", "quantity >= 30 AND discount < 0.05 AND flag IN ('A', 'R')"), "SELECT count(*) AS n FROM lineitem WHERE l_quantity >= 30 AND l_discount < 0.05 AND l_returnflag IN ('A', 'R')"),
    "count_radius": (_sql("SELECT COUNT(*) AS n FROM vectors WHERE embedding <-> $1 < 1.3", True), f"SELECT count(*) AS n FROM embeddings WHERE {_L2} < 1.3"),
    "scan_limit": (_sql("SELECT id, total FROM orders WHERE total > 200000 LIMIT 100000000"), "SELECT o_orderkey AS id, o_totalprice AS total FROM orders WHERE o_totalprice > 200000"),
    "scan_id": (_sql("SELECT id, status FROM orders WHERE id = 7 LIMIT 1"), "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey = 7"),
    "scan_param": (_sql("SELECT id FROM orders WHERE status = $s AND total <= $t LIMIT 100000000", s="O", t=50000), "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' AND o_totalprice <= 50000"),
    "project_alias": (_sql("SELECT id AS key, event_type AS kind, value FROM events WHERE value > 50 LIMIT 100000000"), "SELECT event_id AS key, event_type AS kind, value FROM events WHERE value > 50"),
    "project_absent": (_sql("SELECT id, missing FROM events WHERE value > 90 LIMIT 100000000"), "SELECT event_id AS id, NULL::VARCHAR AS missing FROM events WHERE value > 90"),
    "order_field": (_sql("SELECT id, total FROM orders ORDER BY total DESC LIMIT 25"), "SELECT o_orderkey AS id, o_totalprice AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25"),
    "order_two_fields": (_sql("SELECT id, status, total FROM orders ORDER BY status, total DESC LIMIT 25"), "SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS total FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey LIMIT 25"),
    "order_nulls_last": (_sql("SELECT id, quality FROM docs ORDER BY quality LIMIT 100000000"), f"SELECT doc_id AS id, quality FROM {_DOCS}"),
    "pred_eq": (_count("events", "event_type = 'view'"), "SELECT count(*) AS n FROM events WHERE event_type = 'view'"),
    "pred_lt": (_count("events", "value < 10.5"), "SELECT count(*) AS n FROM events WHERE value < 10.5"),
    "pred_le": (_count("events", "user_id <= 20"), "SELECT count(*) AS n FROM events WHERE user_id <= 20"),
    "pred_gt": (_count("events", "event_type > 'purchase'"), "SELECT count(*) AS n FROM events WHERE event_type > 'purchase'"),
    "pred_ge": (_count("events", "value >= 20"), "SELECT count(*) AS n FROM events WHERE value >= 20"),
    "pred_ne": (_count("docs", "quality != 1"), f"SELECT count(*) AS n FROM {_DOCS} WHERE coalesce(quality <> 1, FALSE)"),
    "pred_in": (_count("events", "event_type IN ('view', 'error')"), "SELECT count(*) AS n FROM events WHERE event_type IN ('view', 'error')"),
    "pred_in_mixed": (_count("lines", "quantity IN (1, 2.0, 'x', TRUE, NULL)"), "SELECT count(*) AS n FROM lineitem WHERE l_quantity IN (1, 2)"),
    "pred_between": (_count("events", "user_id BETWEEN 5 AND 15"), "SELECT count(*) AS n FROM events WHERE user_id BETWEEN 5 AND 15"),
    "pred_between_empty": (_count("events", "user_id BETWEEN 15 AND 5"), "SELECT count(*) AS n FROM events WHERE user_id BETWEEN 15 AND 5"),
    "pred_isnull": (_count("docs", "toxic IS NULL"), f"SELECT count(*) AS n FROM {_DOCS} WHERE toxic IS NULL"),
    "pred_isnotnull": (_count("docs", "toxic IS NOT NULL"), f"SELECT count(*) AS n FROM {_DOCS} WHERE toxic IS NOT NULL"),
    "pred_contains": (_count("docs", "words @> 'the'"), f"SELECT count(*) AS n FROM {_DOCS} WHERE list_contains(words, 'the')"),
    "pred_contains_other_type": (_count("docs", "words @> 5"), "SELECT 0::BIGINT AS n"),
    "pred_subscript": (_count("events", "props['k'] >= 50"), f"SELECT count(*) AS n FROM {_EVENTS} WHERE k >= 50"),
    "pred_subscript_absent": (_count("events", "NOT props['other'] = 1"), "SELECT count(*) AS n FROM events"),
    "pred_and_or_not": (_count("events", "NOT (event_type = 'view' OR value > 50) AND user_id < 30"), "SELECT count(*) AS n FROM events WHERE NOT (event_type = 'view' OR value > 50) AND user_id < 30"),
    "pred_not_missing": (_count("docs", "NOT quality = 1"), f"SELECT count(*) AS n FROM {_DOCS} WHERE NOT coalesce(quality = 1, FALSE)"),
    "pred_ne_missing": (_count("docs", "nothing != 1"), "SELECT 0::BIGINT AS n"),
    "pred_num_coerce": (_count("lines", "line = 3.0 AND quantity = 10"), "SELECT count(*) AS n FROM lineitem WHERE l_linenumber = 3.0 AND l_quantity = 10"),
    "pred_type_strict": (_count("events", "user_id = '5' OR value != 'x' OR event_type = TRUE"), "SELECT 0::BIGINT AS n"),
    "pred_null_literal": (_count("events", "event_type = NULL OR NOT value = NULL"), "SELECT count(*) AS n FROM events"),
}


# ---- stored collections ---------------------------------------------------------------------------


def stored(spark: SparkSession, sf_dir: str, checkpoint: bool = False) -> Engine:
    """The embeddings as a stored collection, with label, parity, tags and attrs in their bags."""
    ship(spark)
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    null = lambda kind: F.lit(None).cast(kind)

    def value(tag: str, **members) -> Column:
        kinds = {"s": "string", "i": "bigint", "d": "double", "b": "boolean", "a": f"array<{values.SCALAR}>", "m": f"map<string,{values.SCALAR}>"}
        return F.struct(F.lit(tag).alias("t"), *[members.get(n, null(k)).cast(k).alias(n) for n, k in kinds.items()])

    def scalar(tag: str, **members) -> Column:
        kinds = {"s": "string", "i": "bigint", "d": "double", "b": "boolean"}
        return F.struct(F.lit(tag).alias("t"), *[members.get(n, null(k)).cast(k).alias(n) for n, k in kinds.items()])

    label = F.col("label").cast("bigint")
    tags = F.array(scalar("s", s=F.concat(F.lit("t"), (F.col("vec_id") % 3).cast("string"))), scalar("s", s=F.concat(F.lit("u"), (F.col("vec_id") % 5).cast("string"))))
    bag = F.create_map(
        F.lit("label"), value("i", i=label), F.lit("even"), value("b", b=F.col("vec_id") % 2 == 0), F.lit("half"), value("f", d=F.col("vec_id") / 2),
        F.lit("tags"), value("a", a=tags), F.lit("attrs"), value("m", m=F.create_map(F.lit("mod"), scalar("i", i=F.col("vec_id") % 7))),
    )
    c = Collection(spark, scratch_folder(spark, "vectors"))
    e = Engine(spark, vectors=c)
    e.execute("INSERT INTO vectors (id, embedding, metadata) VALUES $rows", Params(rows=v.select(F.col("vec_id").alias("id"), "embedding", bag.cast(values.BAG).alias("metadata"))))
    if checkpoint:
        e.execute("CHECKPOINT")
    return e


def _after(*statements: str, then: str = "SELECT id FROM vectors WHERE id >= 0 LIMIT 100000000", columns: dict | None = None, checkpoint: bool = False) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = stored(spark, sf_dir, checkpoint)
        bound = Params(query_vector(spark, sf_dir))
        for s in statements:
            e.execute(s, bound)
        out = e.execute(then, bound)
        return out.select(*[x.alias(n) for n, x in columns.items()]) if columns else out

    return run


_ROWS = "(SELECT vec_id AS id, label::BIGINT AS label, vec_id % 2 = 0 AS even, vec_id / 2 AS half, vec_id % 7 AS mod, embedding FROM embeddings)"


def _shown(*names: str) -> Callable[[], dict]:
    members = {"label": "i", "half": "d", "even": "b", "mark": "s"}
    return lambda: {"id": F.col("id")} | {n: F.col(n)[members[n]] for n in names}


def _stored(*statements: str, then: str, shown: tuple[str, ...] = (), checkpoint: bool = False) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _after(*statements, then=then, columns=_shown(*shown)() if shown else None, checkpoint=checkpoint)(spark, sf_dir)

    return run


_ALL = "WHERE id >= 0 LIMIT 100000000"
STORED: dict[str, tuple[Query, str]] = {
    "insert_many": (_stored(then=f"SELECT id, label FROM vectors {_ALL}", shown=("label",)), f"SELECT id, label FROM {_ROWS}"),
    "bag_types": (_stored(then="SELECT COUNT(*) AS n FROM vectors WHERE label = 3.0 OR half = 5 OR even = 'x' OR NOT nothing > 1 AND half != 2"), f"SELECT count(*) AS n FROM {_ROWS} WHERE label = 3 OR half = 5 OR half <> 2"),
    "bag_contains_subscript": (_stored(then="SELECT id FROM vectors WHERE tags @> 't1' AND attrs['mod'] <= 3 LIMIT 100000000"), f"SELECT id FROM {_ROWS} WHERE id % 3 = 1 AND mod <= 3"),
    "update_flat": (_stored("UPDATE vectors SET label = 100, mark = 'new' WHERE label = 3", then=f"SELECT id, label, mark FROM vectors {_ALL}", shown=("label", "mark")), f"SELECT id, CASE WHEN label = 3 THEN 100 ELSE label END AS label, CASE WHEN label = 3 THEN 'new' END AS mark FROM {_ROWS}"),
    "update_subscript": (_stored("UPDATE vectors SET attrs['mod'] = 50, other['x'] = TRUE WHERE even = TRUE", then="SELECT COUNT(*) AS n FROM vectors WHERE attrs['mod'] = 50 AND other['x'] = TRUE"), f"SELECT count(*) AS n FROM {_ROWS} WHERE even"),
    "update_radius": (_stored("UPDATE vectors SET label = NULL WHERE embedding <-> $1 < 1.3", then="SELECT id FROM vectors WHERE label IS NULL LIMIT 100000000"), f"SELECT vec_id AS id FROM embeddings WHERE {_L2} < 1.3"),
    "delete_pred": (_stored("DELETE FROM vectors WHERE label < 5 OR tags @> 'u0'", then=f"SELECT id FROM vectors {_ALL}"), f"SELECT id FROM {_ROWS} WHERE NOT (label < 5 OR id % 5 = 0)"),
    "delete_radius": (_stored("DELETE FROM vectors WHERE embedding <-> $1 <= 1.35 AND even = TRUE", then=f"SELECT id FROM vectors {_ALL}"), f"SELECT id FROM {_ROWS} WHERE NOT ({_L2} <= 1.35 AND even)"),
    "delete_id": (_stored("DELETE FROM vectors WHERE id = 7", then=f"SELECT id FROM vectors {_ALL}"), f"SELECT id FROM {_ROWS} WHERE id <> 7"),
    "checkpoint_vacuum": (_stored("UPDATE vectors SET half = 0.5 WHERE label = 1", "DELETE FROM vectors WHERE label = 2", "CHECKPOINT", "DELETE FROM vectors WHERE label = 4", "VACUUM vectors", then=f"SELECT id, half FROM vectors {_ALL}", shown=("half",)), f"SELECT id, CASE WHEN label = 1 THEN 0.5 ELSE half END AS half FROM {_ROWS} WHERE label NOT IN (2, 4)"),
    "stored_knn": (_stored("DELETE FROM vectors WHERE id = 0", then="SELECT id FROM vectors WHERE label BETWEEN 2 AND 6 ORDER BY embedding <-> $1 LIMIT 10"), f"SELECT vec_id AS id FROM embeddings WHERE vec_id <> 0 AND label BETWEEN 2 AND 6 ORDER BY {_L2}, vec_id LIMIT 10"),
    "index_hash": (_stored("CREATE INDEX ON vectors USING HASH (label)", then="SELECT COUNT(*) AS n FROM vectors WHERE label IN (3, 4.0) OR label = 9"), f"SELECT count(*) AS n FROM {_ROWS} WHERE label IN (3, 4, 9)"),
    "index_btree": (_stored("CREATE INDEX ON vectors USING BTREE (half)", then="SELECT id FROM vectors WHERE half BETWEEN 10 AND 50.5 AND even = TRUE LIMIT 100000000"), f"SELECT id FROM {_ROWS} WHERE half BETWEEN 10 AND 50.5 AND even"),
    "index_inverted": (_stored("CREATE INDEX ON vectors USING INVERTED (tags)", then="SELECT COUNT(*) AS n FROM vectors WHERE tags @> 't1' AND tags @> 'u2'"), f"SELECT count(*) AS n FROM {_ROWS} WHERE id % 3 = 1 AND id % 5 = 2"),
    "index_stale": (_stored("CREATE INDEX ON vectors USING HASH (label)", "UPDATE vectors SET label = 77 WHERE label = 3", then="SELECT COUNT(*) AS n FROM vectors WHERE label = 77"), f"SELECT count(*) AS n FROM {_ROWS} WHERE label = 3"),
    "index_dropped": (_stored("CREATE INDEX one ON vectors USING HASH (label)", "DROP INDEX one ON vectors", then="SELECT COUNT(*) AS n FROM vectors WHERE label = 3"), f"SELECT count(*) AS n FROM {_ROWS} WHERE label = 3"),
}


# ---- the programmatic interface ---------------------------------------------------------------------


def _api(use: Callable[[SparkSession, Engine, Collection, list[float]], DataFrame], checkpoint: bool = False) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = stored(spark, sf_dir, checkpoint)
        return use(spark, e, e.collection("vectors"), query_vector(spark, sf_dir))

    return run


def _rows(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def _error(act: Callable[[], object]) -> str:
    try:
        act()
    except QueryError as e:
        return type(e).__name__
    return "none"


def _insert_one(spark, e, c, q):
    done = e.execute("INSERT INTO vectors (id, embedding, metadata) VALUES ($id, $v, $m)", Params(id=10**12, v=q, m={"label": 77, "mark": "one"}))
    c.insert(10**12 + 1, q, {"label": 78})
    found = e.execute("SELECT id, label FROM vectors WHERE label >= 77 LIMIT 10").select("id", F.col("label")["i"].alias("label"))
    return found.withColumn("inserted", F.lit(done.count))


def _metadata_of(spark, e, c, q):
    ids = [0, 3, 7, 10**12]
    return _rows(spark, "id bigint, label bigint, mod bigint, missing boolean", *[(i, (b := c.get_metadata(i) or {}).get("label"), c.with_metadata(i, lambda b: b["attrs"]["mod"]), b == {}) for i in ids])


def _reopened(spark, e, c, q):
    e.execute("DELETE FROM vectors WHERE label = 1")
    e.execute("UPDATE vectors SET label = 50 WHERE label = 2")
    return Collection.open(spark, c.path).rows().select("id", F.col("metadata")["label"]["i"].alias("label"))


def _in_memory(spark, e, c, q):
    own = Collection.in_memory(spark, dim=2)
    own.insert_many([(1, [1.0, 0.0], {"k": "a"}), (2, [0.0, 1.0], {"k": "b"}), (3, [1.0, 1.0], None)])
    return own.search([1.0, 0.0], 2).select("id", "distance")


_REFUSALS = {
    "unknown": "NotFound", "deleted": "AlreadyDeleted", "reserved": "DuplicateId", "taken": "DuplicateId", "batch": "DuplicateId", "dimension": "DimensionMismatch", "query": "DimensionMismatch", "infinite": "InvalidVector",
    "empty": "InvalidVector", "update": "NotFound", "index": "IndexAlreadyExists", "drop": "UnknownIndexName", "many": "NotFound",
}


def _refusals(spark, e, c, q):
    e.execute("DELETE FROM vectors WHERE id = 5")
    c.create_index("first", "label", "hash")
    acts = {
        "unknown": lambda: c.delete(10**12), "deleted": lambda: c.delete(5), "reserved": lambda: c.insert(5, q), "taken": lambda: c.insert(6, q), "batch": lambda: c.insert_many([(10**12, q, None), (10**12, q, None)]),
        "dimension": lambda: c.insert(10**12, [1.0]), "query": lambda: c.search([1.0], 3), "infinite": lambda: c.insert(10**12, [float("inf")] * len(q)), "empty": lambda: c.insert(10**12, []), "update": lambda: c.update_metadata({10**12: {}}),
        "index": lambda: c.create_index("second", "label", "hash"), "drop": lambda: c.drop_index("none"), "many": lambda: c.delete_many([1, 10**12]),
    }
    return _rows(spark, "what string, error string", *[(k, _error(act)) for k, act in acts.items()])


def _log_of(spark, e, c, q):
    e.execute("DELETE FROM vectors WHERE id = 1")
    e.execute("CREATE INDEX ON vectors USING HASH (label)")
    e.execute("DROP INDEX idx_label_hash ON vectors")
    return _rows(spark, "number bigint, kind string", *[(x["number"], x["kind"]) for x in c.log.since(0)])


def _policies(spark, e, c, q):
    for i in range(3):
        c.delete(i)
    policies = {"deltas 3": CheckpointPolicy(max_deltas=3), "deltas 9": CheckpointPolicy(max_deltas=9), "commits": CheckpointPolicy(None, max_commits=4), "deleted": CheckpointPolicy(None, max_deleted_share=0.9), "some deleted": CheckpointPolicy(None, max_deleted_share=1e-6)}
    return _rows(spark, "policy string, due boolean", *[(k, c.should_checkpoint(p)) for k, p in policies.items()])


def _catalog(spark, e, c, q):
    for s in ("HASH (label)", "BTREE (half)", "INVERTED (tags)", "HNSW (embedding <=>)"):
        e.execute(f"CREATE INDEX ON vectors USING {s}")
    e.execute("CREATE INDEX named ON vectors USING BTREE (label)")
    e.execute("DROP INDEX idx_label_hash ON vectors")
    return _rows(spark, "name string, field string, method string", *[(n, i["field"], i["method"]) for n, i in c.catalog.items()])


_PREDICATES = ("even = TRUE", "NOT even = TRUE", "tags @> 't1'", "label = 3", "nothing IS NULL AND even = TRUE", "even IS NOT NULL", "label = 3 OR even = TRUE")


def _selectivities(spark, e, c, q):
    shares = [(w, stats.selectivity(parse_predicate(w), c.stats)) for w in _PREDICATES]
    return _rows(spark, "predicate string, share double", *[(w, None if x is None else round(x, 4)) for w, x in shares])


_STATEMENTS = {
    "select  id , embedding <-> $1 as d from T where a='x' and (b>=2 or not c is null) order by embedding <-> $1 limit 3 ann 20": "SELECT id, embedding <-> $1 AS d FROM T WHERE a = 'x' AND (b >= 2 OR NOT c IS NULL) ORDER BY embedding <-> $1 LIMIT 3 ANN 20",
    "SELECT COUNT(*) FROM t WHERE f['k'] in (1, 2.5, 'x', true, null);": "SELECT COUNT(*) FROM t WHERE f['k'] IN (1, 2.500000, 'x', TRUE, NULL)",
    "select * from t where x between -1 and 2.0 and y @> 'z' and embedding <=> $q < 0.5": "SELECT * FROM t WHERE x BETWEEN -1 AND 2.000000 AND y @> 'z' AND embedding <=> $q < 0.500000",
    "insert into t (id, embedding, metadata) values ($a,$b,$c)": "INSERT INTO t (id, embedding, metadata) VALUES ($a, $b, $c)",
    "insert into t (id,embedding,metadata) values $rows": "INSERT INTO t (id, embedding, metadata) VALUES $rows",
    "update t set a=1, m['k'] = $v where id = 3": "UPDATE t SET a = 1, m['k'] = $v WHERE id = 3",
    "delete from t where not (a = 1 or b <> 2)": "DELETE FROM t WHERE NOT (a = 1 OR b != 2)",
    "create index on t using hnsw (embedding)": "CREATE INDEX ON t USING HNSW (embedding <->)",
    "create index i on t using btree (f)": "CREATE INDEX i ON t USING BTREE (f)",
    "drop index i on t": "DROP INDEX i ON t",
    "vacuum t": "VACUUM t",
    "checkpoint": "CHECKPOINT",
}
_REJECTED = {
    "SELECT id FROM vectors": "PlanError", "SELECT id FROM vectors LIMIT 3": "PlanError", "SELECT id FROM vectors ORDER BY embedding <-> $1": "BindError", "SELECT id FROM vectors ORDER BY embedding <-> $1 DESC LIMIT 3": "BindError",
    "SELECT COUNT(*), id FROM vectors": "PlanError", "SELECT *, id FROM vectors LIMIT 3": "ParseError", "SELECT embedding <-> $1 FROM vectors LIMIT 3": "BindError", "SELECT id FROM vectors WHERE embedding <-> $1 > 1.0 LIMIT 3": "PlanError",
    "SELECT id FROM vectors WHERE label = 1 OR embedding <-> $1 < 1.0 LIMIT 3": "PlanError", "SELECT id FROM vectors WHERE NOT embedding <-> $1 < 1.0 LIMIT 3": "PlanError", "SELECT id FROM nowhere WHERE a = 1 LIMIT 3": "ExecutionError",
    "SELECT id FROM vectors WHERE label = $2 LIMIT 3": "ExecutionError", "SELECT id FROM vectors WHERE label = 1 LIMIT 3 ANN": "PlanError", "SELECT COUNT(*) FROM vectors WHERE label = 1 ANN": "PlanError", "SELEC id": "ParseError",
    "UPDATE vectors SET id = 3 WHERE label = 1": "BindError", "UPDATE vectors SET embedding = 3 WHERE label = 1": "BindError", "DELETE FROM vectors WHERE id = 1": "PlanError",
}


def _values(rows, *names: str) -> str:
    cell = lambda v: "NULL" if v is None else f"'{v.replace(chr(39), chr(39) * 2)}'" if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({', '.join(names)})"


def _printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, "statement string, canonical string, stable boolean", *[(x, to_sql(parse(x)), parse(to_sql(parse(x))) == parse(x)) for x in _STATEMENTS])


def _rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, bound = views(spark, sf_dir, "vectors"), Params([0.0] * 64)
    return _rows(spark, "statement string, error string", *[(x, _error(lambda x=x: e.execute(x, bound))) for x in _REJECTED])


def _constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views(spark, sf_dir, "events")
    atom = parse_predicate("event_type = 'view'")
    wheres = {"true": t.Constant(True), "false": t.Constant(False), "and": t.And((t.Constant(True), atom)), "or": t.Or((t.Constant(False), atom)), "not": t.Not(t.Constant(False))}
    parts = [e.run(t.Select((t.Item(t.COUNT, is_count=True, alias="n"),), "events", w), Params()).select(F.lit(k).alias("predicate"), "n") for k, w in wheres.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def _wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = views(spark, sf_dir, "orders").execute("SELECT * FROM orders WHERE total > 100000 LIMIT 100000000")
    return out.select("id", "metadata.status", "metadata.total", "metadata.priority", "metadata.customer")


def _embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = views(spark, sf_dir, "vectors").execute("SELECT id, embedding FROM vectors WHERE label = 3 LIMIT 100000000")
    return out.select("id", F.size("embedding").cast("bigint").alias("dim"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first"), F.round(F.col("embedding")[63].cast("double"), 6).alias("last"))


_METRICS = {"l2": ("<->", _L2), "cosine": ("<=>", _COS), "ip": ("<#>", _IP)}
_MINUS = _L2.replace(_Q, "(SELECT list_transform(embedding, lambda x: -x)::DOUBLE[64] FROM embeddings WHERE vec_id = 0)")
_SHARES = f"""WITH r AS {_ROWS}, s AS (SELECT avg(even::INT) AS e, avg((id % 3 = 1)::INT) AS t, 1.0 / count(DISTINCT label) AS l FROM r),
u AS (SELECT unnest([{", ".join("'" + p.replace("'", "''") + "'" for p in _PREDICATES)}]) AS predicate, unnest([round(e, 4), round(1 - e, 4), round(t, 4), round(l, 4), NULL, 1.0, round(1 - (1 - l) * (1 - e), 4)]::DOUBLE[]) AS share FROM s) SELECT * FROM u"""


def _ann(op: str, statement: str, *before: str) -> Query:
    return _stored(f"CREATE INDEX ON vectors USING HNSW (embedding {op})", *before, then=statement)


def _ann_recall(spark, e, c, q):
    queries = [[float(x) for x in r["embedding"]] for r in c.rows().where("id % 25 = 3").orderBy("id").limit(40).collect()]
    found = []
    for name, (op, _) in _METRICS.items():
        c.add_hnsw_index(op)
        found.append((name, 10, c.ann_recall(queries, 10, op) >= 0.95))
    return _rows(spark, "metric string, k int, enough boolean", *found)


API: dict[str, tuple[Query, str]] = {
    "project_wildcard": (_wildcard, "SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS total, o_orderpriority AS priority, o_custkey AS customer FROM orders WHERE o_totalprice > 100000"),
    "project_embedding": (_embedding, "SELECT vec_id AS id, len(embedding)::BIGINT AS dim, round(embedding[1]::DOUBLE, 6) AS first, round(embedding[64]::DOUBLE, 6) AS last FROM embeddings WHERE label = 3"),
    "pred_constants": (_constants, "SELECT unnest(['true', 'false', 'and', 'or', 'not']) AS predicate, unnest([count(*), 0, count(*) FILTER (event_type = 'view'), count(*) FILTER (event_type = 'view'), count(*)]) AS n FROM events"),
    "printer": (_printed, _values([(a, b, True) for a, b in _STATEMENTS.items()], "statement", "canonical", "stable")),
    "rejected_shapes": (_rejected, _values(list(_REJECTED.items()), "statement", "error")),
    "insert_one": (_api(_insert_one), f"SELECT {10**12} AS id, 77 AS label, 1 AS inserted UNION ALL SELECT {10**12 + 1}, 78, 1"),
    "update_id": (_stored("UPDATE vectors SET label = 55, mark = 'x' WHERE id = 9", then="SELECT id, label, mark FROM vectors WHERE label = 55 LIMIT 10", shown=("label", "mark")), "SELECT vec_id AS id, 55 AS label, 'x' AS mark FROM embeddings WHERE vec_id = 9"),
    "update_metadata": (_api(lambda s, e, c, q: (c.update_metadata({1: {"label": 200}, 2: {"label": 201, "even": False}}), c.rows().select("id", F.col("metadata")["label"]["i"].alias("label"), F.size("metadata").cast("bigint").alias("keys")))[1]), f"SELECT id, CASE id WHEN 1 THEN 200 WHEN 2 THEN 201 ELSE label END AS label, CASE id WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 5 END AS keys FROM {_ROWS}"),
    "api_scan_metadata": (_api(lambda s, e, c, q: c.scan_metadata(F.col("metadata")["label"]["i"] == 4)), f"SELECT id FROM {_ROWS} WHERE label = 4"),
    "api_get_metadata": (_api(_metadata_of), f"SELECT i AS id, label, mod, label IS NULL AS missing FROM (VALUES (0), (3), (7), ({10**12})) AS w(i) LEFT JOIN {_ROWS} ON id = i"),
    "api_contains_len_dim": (_api(lambda s, e, c, q: _rows(s, "n bigint, dim int, has boolean, lacks boolean, empty boolean", (c.len(), c.dim, c.contains(3), c.contains(10**12), c.is_empty()))), "SELECT count(*) AS n, max(len(embedding)) AS dim, count(*) FILTER (vec_id = 3) > 0 AS has, FALSE AS lacks, FALSE AS empty FROM embeddings"),
    "api_search": (_api(lambda s, e, c, q: c.search(q, 12, "<=>").select("id", F.round("distance", 6).alias("d"))), f"SELECT vec_id AS id, round({_COS}, 6) AS d FROM embeddings ORDER BY {_COS}, vec_id LIMIT 12"),
    "api_search_filtered": (_api(lambda s, e, c, q: c.search_filtered(q, 12, F.col("metadata")["label"]["i"] < 4).select("id", F.round("distance", 6).alias("d"))), f"SELECT vec_id AS id, round({_L2}, 6) AS d FROM embeddings WHERE label < 4 ORDER BY {_L2}, vec_id LIMIT 12"),
    "api_search_radius": (_api(lambda s, e, c, q: c.search_radius(q, 1.3).select("id", F.round("distance", 6).alias("d"))), f"SELECT vec_id AS id, round({_L2}, 6) AS d FROM embeddings WHERE {_L2} <= 1.3"),
    "api_search_many": (_api(lambda s, e, c, q: c.search_many([q, [-x for x in q]], 5).select("query", "id", F.round("distance", 6).alias("d"))), " UNION ALL ".join(f"(SELECT {i} AS query, vec_id AS id, round({x}, 6) AS d FROM embeddings ORDER BY {x}, vec_id LIMIT 5)" for i, x in enumerate((_L2, _MINUS)))),
    "api_distance_count": (_api(lambda s, e, c, q: _rows(s, "d double, absent boolean, n bigint", (round(c.distance_to(3, q), 6), c.distance_to(10**12, q) is None, c.count_matching(F.col("metadata")["even"]["b"])))), f"SELECT (SELECT round({_L2}, 6) FROM embeddings WHERE vec_id = 3) AS d, TRUE AS absent, count(*) AS n FROM {_ROWS} WHERE even"),
    "api_delete_many": (_api(lambda s, e, c, q: (c.delete_many([2, 3, 5, 8]), c.rows().select("id"))[1]), "SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (2, 3, 5, 8)"),
    "api_reopen": (_api(_reopened), f"SELECT id, CASE WHEN label = 2 THEN 50 ELSE label END AS label FROM {_ROWS} WHERE label <> 1"),
    "api_in_memory": (_api(_in_memory), "SELECT 1 AS id, 0.0::DOUBLE AS distance UNION ALL SELECT 3, 1.0"),
    "api_refusals": (_api(_refusals), _values(list(_REFUSALS.items()), "what", "error")),
    "api_log": (_api(_log_of), _values([(1, "delta"), (2, "delta"), (3, "create_index"), (4, "drop_index")], "number", "kind")),
    "api_policy": (_api(_policies), _values([("deltas 3", True), ("deltas 9", False), ("commits", True), ("deleted", False), ("some deleted", True)], "policy", "due")),
    "api_catalog": (_api(_catalog), _values([("idx_half_btree", "half", "btree"), ("idx_tags_inv", "tags", "inverted"), ("idx_embedding_hnsw_cosine", "embedding <=>", "hnsw"), ("named", "label", "btree")], "name", "field", "method")),
    "stats_selectivity": (_api(_selectivities, checkpoint=True), _SHARES),
    "index_param": (_api(lambda s, e, c, q: (c.add_hash_index("label"), c.add_btree_index("half"), e.execute("SELECT COUNT(*) AS n FROM vectors WHERE label = $l AND half >= $h", Params(l=3, h=20)))[2]), f"SELECT count(*) AS n FROM {_ROWS} WHERE label = 3 AND half >= 20"),
    "index_notnull": (_stored("UPDATE vectors SET mark = 'm' WHERE label = 6", "CREATE INDEX ON vectors USING HASH (mark)", "CREATE INDEX ON vectors USING INVERTED (tags)", then="SELECT COUNT(*) AS n FROM vectors WHERE mark IS NOT NULL AND tags IS NOT NULL"), f"SELECT count(*) AS n FROM {_ROWS} WHERE label = 6"),
    "index_beside_scan": (_stored("CREATE INDEX ON vectors USING BTREE (half)", "CREATE INDEX ON vectors USING HASH (label)", "CHECKPOINT", then="SELECT id FROM vectors WHERE half >= 1 AND label = 3 LIMIT 100000000"), f"SELECT id FROM {_ROWS} WHERE half >= 1 AND label = 3"),
    "ann_recall": (_api(_ann_recall), _values([("l2", 10, True), ("cosine", 10, True), ("ip", 10, True)], "metric", "k", "enough")),
    "ann_filtered": (_ann("<->", "SELECT id FROM vectors WHERE label BETWEEN 2 AND 6 ORDER BY embedding <-> $1 LIMIT 10 ANN 4000"), f"SELECT vec_id AS id FROM embeddings WHERE label BETWEEN 2 AND 6 ORDER BY {_L2}, vec_id LIMIT 10"),
    "ann_radius": (_ann("<->", "SELECT id FROM vectors WHERE embedding <-> $1 < 1.3 AND label != 3 LIMIT 100000000 ANN"), f"SELECT vec_id AS id FROM embeddings WHERE {_L2} < 1.3 AND label <> 3"),
    "ann_radius_empty": (_ann("<->", "SELECT id FROM vectors WHERE embedding <-> $1 < -1.0 LIMIT 10 ANN"), "SELECT vec_id AS id FROM embeddings WHERE FALSE"),
    "ann_after_changes": (_ann("<=>", "SELECT id FROM vectors WHERE label != 3 ORDER BY embedding <=> $1 LIMIT 10 ANN 4000", "DELETE FROM vectors WHERE id = 0", "UPDATE vectors SET label = 3 WHERE label = 1"), f"SELECT vec_id AS id FROM embeddings WHERE vec_id <> 0 AND label NOT IN (1, 3) ORDER BY {_COS}, vec_id LIMIT 10"),
} | {f"ann_{n}": (_ann(op, f"SELECT id FROM vectors ORDER BY embedding {op} $1 LIMIT 10 ANN 4000"), f"SELECT vec_id AS id FROM embeddings ORDER BY {x}, vec_id LIMIT 10") for n, (op, x) in _METRICS.items()}


# ---- statistics -------------------------------------------------------------------------------------


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


STATS: dict[str, tuple[Query, str]] = {
    "stats_histogram": (lambda s, d: stats.equi_depth(_table(s, d, "events"), F.col("value")), "SELECT bucket, min(v) AS low, max(v) AS high, count(*) AS n FROM (SELECT value AS v, ntile(20) OVER (ORDER BY value) AS bucket FROM events) GROUP BY bucket"),
    "stats_topk": (lambda s, d: stats.top_values(_table(s, d, "documents"), F.col("source")), "SELECT source AS value, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, value LIMIT 16"),
    "stats_bool": (lambda s, d: stats.bool_counts(_table(s, d, "events"), F.col("value") > 20), "SELECT count(*) FILTER (value > 20) AS n_true, count(*) FILTER (NOT value > 20) AS n_false FROM events"),
    "stats_array": (lambda s, d: stats.array_stats(_table(s, d, "documents"), F.split("text", " "))[0], "SELECT value, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS value FROM documents) GROUP BY value ORDER BY n DESC, value LIMIT 16"),
    "stats_array_length": (lambda s, d: stats.array_stats(_table(s, d, "documents"), F.split("text", " "))[1].select(F.round("average_length", 6).alias("average_length")), "SELECT round(avg(len(string_split(text, ' '))), 6) AS average_length FROM documents"),
    "stats_ndv_nulls": (
        lambda s, d: stats.presence(_table(s, d, "documents").join(_table(s, d, "labels"), "doc_id", "left"), {c: F.col(c) for c in ("lang", "source", "quality", "toxic")}),
        " UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS \"distinct\" FROM documents LEFT JOIN labels USING (doc_id)" for c in ("lang", "source", "quality", "toxic")),
    ),
}

EVERY = PLAIN | STORED | API | STATS


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in EVERY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in EVERY.items()}
