"""Collections: what a table name in a statement stands for.

``ViewCollection`` puts a name on any DataFrame: declared fields, read-only.
``Collection`` is a stored one: rows (id, embedding, metadata bag), changed by commits.

A stored collection's state is a snapshot and the deltas since.  A delta's rows are
latest-wins by (id, commit); a deletion is a row with ``deleted``, and ids stay reserved
until VACUUM.  Reading joins the snapshot against the deltas' ids only, so its cost
grows with what has changed; CHECKPOINT folds the deltas into a new snapshot.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import AlreadyDeleted, BackendError, DimensionMismatch, DuplicateId, ExecutionError, IndexAlreadyExists, IndexNameInUse, InvalidVector, NotFound, UnknownIndexName
from ..functions import values
from ..functions.distance import NAMES, distance, flat_nearest, nearest_of, once
from ..functions.hnsw import HnswParams
from ..language.tree import FieldRef
from ..operators import ann, indexes
from ..operators.ann import AnnIndex
from ..operators.stats import collect_stats
from ..plans.fields import BagFields, DeclaredFields, Field, declared
from .log import Log
from .scratch import scratch_folder

STORED = f"{values.ROW}, deleted boolean, at bigint"
#: Candidate ids that the driver lists for a scan's filter; more are joined.
LISTED = 10_000


class ViewCollection:
    """A DataFrame with an id, a vector column and typed fields."""

    writable = False

    def __init__(self, df: DataFrame, id: str, embedding: str | None = None, fields: dict[str, Column] | None = None, subscripts: dict[tuple[str, str], Column] | None = None):
        self.df, self.id, self.embedding = df, F.col(id), F.col(embedding) if embedding else F.lit(None).cast("array<float>")
        self.declared = DeclaredFields(df, fields, subscripts)
        self.id_kind = df.schema[id].dataType

    def rows(self) -> DataFrame:
        return self.df

    def resolve(self, ref: FieldRef) -> Field:
        if ref.key is None and ref.name.lower() == "id":
            return declared(self.id, self.id_kind)
        return self.declared.resolve(ref)

    @property
    def metadata(self) -> Column:
        return F.struct(*[c.alias(n) for n, c in self.declared.fields.items()])

    def count_by_index(self, where, value=None) -> None:
        return None


@dataclass
class State:
    """What the log adds up to."""

    number: int = 0
    dim: int | None = None
    snapshot: str | None = None
    snapshot_at: int = 0
    deltas: list[str] = field(default_factory=list)
    indexes: dict[str, dict] = field(default_factory=dict)
    stats: dict | None = None

    def apply(self, e: dict) -> None:
        self.number = e["number"]
        kind = e["kind"]
        if e.get("dim"):
            self.dim = e["dim"]
        if kind == "delta":
            self.deltas = [*self.deltas, e["data"]]
        elif kind in ("checkpoint", "vacuum"):
            self.snapshot, self.snapshot_at, self.deltas = e["data"], e["number"], []
            self.stats = e.get("stats", self.stats)
            self.indexes = e["indexes"]
        elif kind == "create_index":
            self.indexes = self.indexes | {e["name"]: e["index"]}
        elif kind == "drop_index":
            self.indexes = {k: v for k, v in self.indexes.items() if k != e["name"]}


@dataclass(frozen=True)
class CheckpointPolicy:
    """When to fold the deltas: too many of them, too many deletions, or too many commits since."""

    max_deltas: int | None = 64
    max_deleted_share: float | None = None
    max_commits: int | None = None


class Collection:
    """A stored collection at a path; open it again with the same call."""

    writable = True
    #: Seconds for which CHECKPOINT leaves folders that no commit names, as a writer may still be filling them.
    grace = 3600.0

    def __init__(self, spark: SparkSession, path: str, dim: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = Log(spark, self.path)
        self.state = State()
        self._opened: dict[str, AnnIndex] = {}
        self.refresh()
        if dim is not None:
            if self.state.dim not in (None, dim):
                raise DimensionMismatch(f"the collection has {self.state.dim} dimensions, not {dim}")
            self.state.dim = dim

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Collection:
        """The collection at ``path`` as its log says."""
        return cls(spark, path)

    @classmethod
    def in_memory(cls, spark: SparkSession, dim: int | None = None) -> Collection:
        """A collection nobody else knows of, in a scratch folder."""
        return cls(spark, scratch_folder(spark, "collection"), dim)

    # ---- reading -------------------------------------------------------------------------------

    def refresh(self) -> None:
        """Takes in commits of other writers."""
        start = self.state.number
        if start == 0 and (whole := self.log.last_checkpoint()):
            start = whole - 1
        for e in self.log.since(start):
            self.state.apply(e)

    def _read(self, folder: str) -> DataFrame:
        return self.spark.read.schema(STORED).parquet(f"{self.path}/{folder}")

    def versions(self, with_deleted: bool = True) -> DataFrame:
        """The latest version of every id, deletions too unless left out."""
        s = self.state
        base = self._read(s.snapshot) if s.snapshot else self.spark.createDataFrame([], STORED)
        if s.deltas:
            new = self.spark.read.schema(STORED).parquet(*[f"{self.path}/{d}" for d in s.deltas])
            last = Window.partitionBy("id").orderBy(F.desc("at"))
            new = new.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
            base = base.join(new.select("id"), "id", "left_anti").select(*new.columns).unionByName(new)
        return base if with_deleted else base.where(~F.col("deleted")).drop("deleted", "at")

    def rows(self) -> DataFrame:
        return self.versions(with_deleted=False)

    id = property(lambda self: F.col("id"))
    embedding = property(lambda self: F.col("embedding"))
    metadata = property(lambda self: F.col("metadata"))

    def resolve(self, ref: FieldRef) -> Field:
        if ref.key is None and ref.name.lower() == "id":
            return Field({"i": F.col("id")}, F.col("id").isNotNull(), F.col("id"), True)
        return BagFields(F.col("metadata")).resolve(ref)

    @property
    def dim(self) -> int | None:
        return self.state.dim

    @property
    def stats(self) -> dict | None:
        """Statistics of the last CHECKPOINT."""
        return self.state.stats

    @property
    def catalog(self) -> dict[str, dict]:
        return self.state.indexes

    def len(self) -> int:
        return self.rows().count()

    def is_empty(self) -> bool:
        return not self.rows().limit(1).count()

    def contains(self, id: int) -> bool:
        return bool(self.rows().where(F.col("id") == id).limit(1).count())

    def get_metadata(self, id: int) -> dict | None:
        got = self.rows().where(F.col("id") == id).select("metadata").first()
        return values.decode_bag(got["metadata"]) if got else None

    def with_metadata(self, id: int, use):
        """``use`` of the bag of ``id``, or None if there is none."""
        bag = self.get_metadata(id)
        return None if bag is None else use(bag)

    def scan_metadata(self, predicate: Column) -> DataFrame:
        return self.rows().where(predicate).select("id")

    def _ranked(self, op: str, query: list[float], rows: DataFrame | None = None) -> DataFrame:
        self.check_query(query)
        return (self.rows() if rows is None else rows).withColumn("distance", once(distance(F.col("embedding"), op, query))).where("distance is not null").select("id", "distance", "metadata")

    def search(self, query: list[float], k: int, op: str = "<->", ef: int | None = None) -> DataFrame:
        """The ``k`` nearest rows; with ``ef`` by a graph index, if there is one of the metric."""
        return self._ranked(op, query, self.ann_nearest(op, query, k, ef) if ef else None).orderBy("distance", "id").limit(k)

    def search_filtered(self, query: list[float], k: int, predicate: Column, op: str = "<->", ef: int | None = None) -> DataFrame:
        rows = self.ann_nearest(op, query, k, ef, lambda rows: rows.where(predicate)) if ef else None
        return self._ranked(op, query, rows).where(predicate).orderBy("distance", "id").limit(k)

    def search_radius(self, query: list[float], radius: float, op: str = "<->", inclusive: bool = True, approximate: bool = False) -> DataFrame:
        d = F.col("distance")
        return self._ranked(op, query, self.ann_within(op, query, radius) if approximate else None).where(d <= radius if inclusive else d < radius).orderBy("distance", "id")

    def distance_to(self, id: int, query: list[float], op: str = "<->") -> float | None:
        got = self._ranked(op, query).where(F.col("id") == id).first()
        return got["distance"] if got else None

    def count_matching(self, predicate: Column) -> int:
        return self.rows().where(predicate).count()

    def check_query(self, query: list[float]) -> list[float]:
        q = values.check_vector(query)
        if self.dim is not None and len(q) != self.dim:
            raise DimensionMismatch(f"the collection has {self.dim} dimensions, the query {len(q)}")
        return q

    # ---- writing -------------------------------------------------------------------------------

    def _folder(self, kind: str) -> str:
        return f"{kind}/{self.state.number + 1:020d}-{uuid.uuid4().hex[:8]}"

    def _commit(self, entry: dict) -> int:
        self.log.commit(self.state.number + 1, entry)
        self.state.apply(entry | {"number": self.state.number + 1})
        return self.state.number

    def _append(self, rows: DataFrame, more: dict | None = None) -> int:
        """Writes a delta of (id, embedding, metadata, deleted) and publishes it; gives the number of rows."""
        folder = self._folder("data")
        rows.withColumn("at", F.lit(self.state.number + 1).cast("bigint")).select("id", "embedding", "metadata", "deleted", "at").write.parquet(f"{self.path}/{folder}")
        n = self._read(folder).count()
        if n:
            self._commit({"kind": "delta", "data": folder} | (more or {}))
        else:
            self.log.files.delete(folder)
        return n

    def insert(self, id: int, embedding: Iterable[float], metadata: dict | None = None) -> int:
        return self.insert_many([(id, embedding, metadata)])

    def insert_many(self, batch: list[tuple] | DataFrame) -> int:
        """All rows or none.  A DataFrame has (id, embedding, metadata), its metadata a bag as stored."""
        if not isinstance(batch, DataFrame):
            rows = []
            for id, vector, bag in batch:
                if not isinstance(id, int) or isinstance(id, bool) or not 0 <= id < 2**63:
                    raise ExecutionError(f"not an id: {id!r}")
                rows.append((id, values.check_vector(vector), values.encode_bag(bag)))
            if not rows:
                return 0
            batch = self.spark.createDataFrame(rows, values.ROW)
        batch = batch.select(F.col("id").cast("bigint").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"), F.coalesce("metadata", F.create_map().cast(values.BAG)).alias("metadata"))
        # the batch is written first, so that it is computed once; it is seen only once its commit is published
        folder = self._folder("data")
        batch.withColumns({"deleted": F.lit(False), "at": F.lit(self.state.number + 1).cast("bigint")}).write.parquet(f"{self.path}/{folder}")
        try:
            n = self._validate(self._read(folder))
        except BackendError:
            self.log.files.delete(folder)
            raise
        if n:
            self._commit({"kind": "delta", "data": folder, "dim": self.state.dim})
        else:
            self.log.files.delete(folder)
        return n

    def _validate(self, rows: DataFrame) -> int:
        bad = F.col("embedding").isNull() | (F.size("embedding") == 0) | F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        facts = rows.agg(
            F.count("*").alias("n"), F.count_if(F.col("id").isNull() | (F.col("id") < 0)).alias("ids"), F.count_if(bad).alias("bad"),
            F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high"),
        ).first()
        if not facts["n"]:
            return 0
        if facts["ids"]:
            raise BackendError("an id is missing or negative")
        if facts["bad"]:
            raise InvalidVector("a vector is empty or not finite")
        dim = self.state.dim or facts["low"]
        if facts["low"] != dim or facts["high"] != dim:
            raise DimensionMismatch(f"vectors of {facts['low']} to {facts['high']} dimensions; the collection has {dim}")
        twice = rows.groupBy("id").count().where("count > 1").select("id")
        taken = self.versions().select("id").join(rows.select("id"), "id", "left_semi")
        if hit := twice.unionAll(taken).first():
            raise DuplicateId(f"id {hit['id']} is taken")
        self.state.dim = dim
        return facts["n"]

    def _live_or_raise(self, id: int) -> None:
        got = self.versions().where(F.col("id") == id).select("deleted").first()
        if got is None:
            raise NotFound(f"id {id} is not in the collection")
        if got["deleted"]:
            raise AlreadyDeleted(f"id {id} is deleted")

    def delete(self, id: int) -> int:
        self._live_or_raise(id)
        return self.delete_where(F.col("id") == id)

    def delete_many(self, ids: Iterable[int]) -> int:
        ids = list(ids)
        found = {r["id"]: r["deleted"] for r in self.versions().where(F.col("id").isin(ids)).select("id", "deleted").collect()} if ids else {}
        for i in ids:
            if i not in found:
                raise NotFound(f"id {i} is not in the collection")
            if found[i]:
                raise AlreadyDeleted(f"id {i} is deleted")
        return self.delete_where(F.col("id").isin(ids)) if ids else 0

    def delete_where(self, predicate: Column) -> int:
        gone = self.rows().where(predicate).select("id", F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast(values.BAG).alias("metadata"), F.lit(True).alias("deleted"))
        return self._append(gone)

    def update_metadata(self, changes: dict[int, dict]) -> int:
        """Replaces whole bags; an unknown or deleted id rejects all."""
        found = {r["id"] for r in self.rows().where(F.col("id").isin(list(changes))).select("id").collect()} if changes else set()
        if missing := sorted(set(changes) - found):
            raise NotFound(f"ids not in the collection: {missing}")
        if not changes:
            return 0
        new = self.spark.createDataFrame([(i, values.encode_bag(b)) for i, b in changes.items()], f"id bigint, metadata {values.BAG}")
        return self._append(self.rows().drop("metadata").join(new, "id").withColumn("deleted", F.lit(False)))

    def update_where(self, predicate: Column, assignments: list[tuple[FieldRef, object]]) -> int:
        """Assigns left to right; ``f['k'] = v`` on a field that is no map is an error, and nothing changes."""
        hit = self.rows().where(predicate)
        bag, wrong = F.col("metadata"), F.lit(False)
        for ref, value in assignments:
            if ref.key is None:
                bag = _put(bag, ref.name, value)
                continue
            old = F.try_element_at(bag, F.lit(ref.name))
            wrong = wrong | F.coalesce(old["t"] != "m", F.lit(False))
            empty = F.create_map().cast(f"map<string,{values.SCALAR}>")
            inner = F.coalesce(old["m"], empty)
            inner = _without(inner, ref.key)
            if value is not None:
                one = values.value_column(value)
                scalar = F.struct(one["t"].alias("t"), one["s"].alias("s"), one["i"].alias("i"), one["d"].alias("d"), one["b"].alias("b"))
                inner = F.map_concat(inner, F.create_map(F.lit(ref.key), scalar))
            null = lambda kind: F.lit(None).cast(kind)
            new = F.struct(F.lit("m").alias("t"), null("string").alias("s"), null("bigint").alias("i"), null("double").alias("d"), null("boolean").alias("b"), null(f"array<{values.SCALAR}>").alias("a"), inner.alias("m"))
            bag = F.map_concat(_without(bag, ref.name), F.create_map(F.lit(ref.name), new.cast(values.VALUE)))
        if any(r.key is not None for r, _ in assignments) and hit.where(wrong).limit(1).count():
            raise ExecutionError("a subscript assignment on a field that is no map")
        return self._append(hit.select("id", "embedding", bag.alias("metadata"), F.lit(False).alias("deleted")))

    # ---- upkeep --------------------------------------------------------------------------------

    def _fold(self, kind: str, rows: DataFrame, more: dict) -> None:
        folder = self._folder("data")
        # ordered by id, so that point reads skip row groups
        rows.repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{self.path}/{folder}")
        rebuilt = {}
        previous = State(**vars(self.state))
        self.state.snapshot, self.state.deltas = folder, []
        try:
            for name, index in previous.indexes.items():
                rebuilt[name] = self._build_index(index["field"], index["method"], index.get("params"))
            if kind == "checkpoint":
                more |= {"stats": collect_stats(self.rows())}
        finally:
            self.state = previous
        for index in rebuilt.values():
            index["at"] = self.state.number + 1
        kept = {f"data/{x.split('/')[1]}" for x in [previous.snapshot, *previous.deltas] if x}
        kept |= {x["data"] for x in previous.indexes.values()}
        number = self._commit({"kind": kind, "data": folder, "dim": self.state.dim, "indexes": rebuilt} | more)
        self.log.mark_checkpoint(number)
        # what the last state named stays until the next fold, for readers that have begun
        self.log.sweep(kept | {folder} | {x["data"] for x in rebuilt.values()}, number, self.grace)

    def checkpoint(self) -> int:
        """Folds the deltas into a snapshot (deletions stay) and renews statistics and indexes; gives the commit's number."""
        self._fold("checkpoint", self.versions(), {})
        return self.state.number

    def vacuum(self) -> int:
        """Removes deleted rows for good, which frees their ids; gives how many."""
        n = self.versions().where("deleted").count()
        if n:
            self._fold("vacuum", self.versions().where(~F.col("deleted")), {})
        return n

    def should_checkpoint(self, policy: CheckpointPolicy = CheckpointPolicy()) -> bool:
        s = self.state
        if policy.max_deltas is not None and len(s.deltas) >= policy.max_deltas:
            return True
        if policy.max_commits is not None and s.number - s.snapshot_at >= policy.max_commits:
            return True
        if policy.max_deleted_share is not None:
            f = self.versions().agg(F.count("*").alias("n"), F.count_if("deleted").alias("d")).first()
            return bool(f["n"]) and f["d"] / f["n"] >= policy.max_deleted_share
        return False

    # ---- indexes -------------------------------------------------------------------------------

    def _build_index(self, name: str, method: str, params: dict | None = None) -> dict:
        folder = self._folder("index")
        if method == "hnsw":
            chosen = HnswParams(**(params or {}))
            cells, graphs = ann.build(self.rows(), name.split(" ")[1], self.dim or 1, chosen)
            cells.write.parquet(f"{self.path}/{folder}/cells")
            graphs.write.option("compression", "none").partitionBy("cell").parquet(f"{self.path}/{folder}/graphs")
            return {"field": name, "method": method, "data": folder, "at": self.state.number + 1, "params": asdict(chosen)}
        indexes.build(self.rows(), name, method).write.parquet(f"{self.path}/{folder}")
        return {"field": name, "method": method, "data": folder, "at": self.state.number + 1}

    def create_index(self, name: str, field: str, method: str, params: HnswParams | None = None) -> None:
        if name in self.state.indexes:
            raise IndexNameInUse(f"an index named {name} exists")
        if any((i["field"], i["method"]) == (field, method) for i in self.state.indexes.values()):
            raise IndexAlreadyExists(f"{field} has a {method} index")
        self._commit({"kind": "create_index", "name": name, "index": self._build_index(field, method, asdict(params) if params else None)})

    def add_hnsw_index(self, op: str = "<->", params: HnswParams | None = None) -> None:
        self.create_index(f"idx_embedding_hnsw_{NAMES[op]}", f"embedding {op}", "hnsw", params)

    def add_hash_index(self, field: str) -> None:
        self.create_index(f"idx_{field}_hash", field, "hash")

    def add_btree_index(self, field: str) -> None:
        self.create_index(f"idx_{field}_btree", field, "btree")

    def add_inverted_index(self, field: str) -> None:
        self.create_index(f"idx_{field}_inv", field, "inverted")

    def drop_index(self, name: str) -> None:
        if name not in self.state.indexes:
            raise UnknownIndexName(f"no index named {name}")
        self._commit({"kind": "drop_index", "name": name})

    def postings(self, name: str) -> DataFrame:
        return self.spark.read.schema(indexes.POSTING).parquet(f"{self.path}/{self.state.indexes[name]['data']}")

    def _fresh(self) -> dict[tuple[str, str], str]:
        """Indexes that hold all changes of rows, by (field, method)."""
        changed = max([self.state.snapshot_at, *(int(d.split("/")[1].split("-")[0]) for d in self.state.deltas)])
        return {(i["field"], i["method"]): n for n, i in self.state.indexes.items() if i["at"] >= changed}

    def ids_by_index(self, where, value=lambda v: v.value) -> DataFrame | None:
        """Ids that satisfy a predicate, if fresh indexes answer it exactly; else None."""
        fresh = self._fresh()
        return indexes.evaluate(where, fresh, self.postings, value) if fresh else None

    def count_by_index(self, where, value=lambda v: v.value) -> DataFrame | None:
        return self.ids_by_index(where, value)

    # ---- approximate search --------------------------------------------------------------------

    def ann_index(self, op: str) -> tuple[AnnIndex, int] | None:
        """(the graph index of a metric, the commit that built it); what changed since is searched beside it."""
        for i in self.state.indexes.values():
            if (i["field"], i["method"]) == (f"embedding {op}", "hnsw"):
                if i["data"] not in self._opened:
                    at = f"{self.path}/{i['data']}"
                    self._opened = {i["data"]: AnnIndex(self.spark.read.schema(ann.CELL).parquet(f"{at}/cells"), self.spark.read.schema(ann.GRAPH).parquet(f"{at}/graphs"), op, HnswParams(**i["params"]))} | self._opened
                return self._opened[i["data"]], i["at"]
        return None

    def _of(self, ids: DataFrame | list[int] | None, at: int) -> DataFrame:
        """Live rows that are candidates or have changed since a commit; listed ids reach the scan as a filter."""
        rows = self.versions().where(~F.col("deleted"))
        if isinstance(ids, list):
            return rows.where(F.col("id").isin(ids) | (F.col("at") > at)).drop("deleted", "at")
        changed = rows.where(F.col("at") > at)
        if ids is None:
            return changed.drop("deleted", "at")
        return rows.where(F.col("at") <= at).join(ids.distinct(), "id", "left_semi").unionByName(changed).drop("deleted", "at")

    def ann_nearest(self, op: str, query: list[float], k: int, ef: int | None = None, keep=lambda rows: rows) -> DataFrame | None:
        """Rows among which the ``k`` nearest that ``keep`` leaves are looked for; None without an index of the metric."""
        found = self.ann_index(op)
        if found is None:
            return None
        index, at = found
        width, probes = max(ef or index.params.ef_search, k), ann.PROBES
        for _ in range(ann.WIDER):
            # a beam that holds everything means everything
            probes = len(index.cells) if width >= index.n else probes
            ids = index.nearest(query, width, probes)
            # a beam's width from each graph that is read; no more are listed than LISTED
            few = width * index.parts(probes) <= LISTED
            rows = self._of([r["id"] for r in ids.collect()] if few else ids, at)
            if width >= index.n or keep(rows).limit(k).count() >= k:
                return rows
            width, probes = 4 * width, 2 * probes
        # a filter that leaves so few is cheaper to scan than to walk for
        return self.rows()

    def ann_within(self, op: str, query: list[float], radius: float) -> DataFrame | None:
        """Rows among which all within a radius are looked for; None without an index of the metric."""
        found = self.ann_index(op)
        return None if found is None else self._of(found[0].within(query, radius), found[1])

    def search_many(self, queries: list[list[float]], k: int, op: str = "<->", ef: int | None = None) -> DataFrame:
        """(query, id, distance): the ``k`` nearest of each of some queries, in one pass; approximate if there is an index and ``ef`` is given."""
        if not queries:
            return self.spark.createDataFrame([], "query int, id bigint, distance double")
        queries = [self.check_query(q) for q in queries]
        rows = self.rows().select("id", "embedding")
        found = self.ann_index(op) if ef else None
        if found:
            index, at = found
            live = self.versions().where(~F.col("deleted")).select("id", "embedding", "at")
            pairs = live.where(F.col("at") <= at).join(index.many(queries, max(ef, k)), "id").select("query", "id", "embedding")
            new = live.where(F.col("at") > at).select("id", "embedding")
            near = pairs.mapInArrow(nearest_of(op, queries, k), "query int, id bigint, distance double")
            near = near.unionByName(new.mapInArrow(flat_nearest(op, queries, k), "query int, id bigint, distance double"))
        else:
            near = rows.mapInArrow(flat_nearest(op, queries, k), "query int, id bigint, distance double")
        return near.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))).where(F.col("_n") <= k).drop("_n")

    def ann_recall(self, queries: list[list[float]], k: int, op: str = "<->", ef: int | None = None) -> float:
        """The share of the exact ``k`` nearest that the approximate search finds."""
        exact = {(r["query"], r["id"]) for r in self.search_many(queries, k, op).collect()}
        got = {(r["query"], r["id"]) for r in self.search_many(queries, k, op, ef or HnswParams().ef_search).collect()}
        return len(exact & got) / max(1, len(exact))


def _without(mapping: Column, key: str) -> Column:
    return F.map_filter(mapping, lambda k, _: k != key)


def _put(bag: Column, name: str, value) -> Column:
    rest = _without(bag, name)
    return rest if value is None else F.map_concat(rest, F.create_map(F.lit(name), values.value_column(value)))
