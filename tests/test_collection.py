import pytest
from pyspark.sql import functions as F

from corvane import CheckpointPolicy, Collection, Engine, Params
from corvane.errors import AlreadyDeleted, ConcurrentCommit, DimensionMismatch, DuplicateId, ExecutionError, IndexAlreadyExists, IndexNameInUse, InvalidVector, NotFound, PlanError, UnknownIndexName

ROWS = [(n, [float(n), 0.0], {"category": "docs" if n % 2 else "blog", "year": 2020 + n % 7, "tags": [["rust", "async"], ["go"], ["python", "ml"]][n % 3]}) for n in range(1, 21)]


@pytest.fixture
def engine(spark, tmp_path):
    c = Collection(spark, f"file://{tmp_path}/c", dim=2)
    e = Engine(spark, Vectors=c)
    e.execute("INSERT INTO vectors (id, embedding, metadata) VALUES $1", Params(ROWS))
    return e


def ids(e, where, *params):
    return sorted(r["id"] for r in e.execute(f"SELECT id FROM vectors WHERE {where} LIMIT 1000", Params(*params)).collect())


def count(e, where):
    return e.execute(f"SELECT COUNT(*) FROM vectors WHERE {where}").first()["count"]


def test_inserts_are_all_or_nothing(engine):
    c = engine.collection("VECTORS")
    bad = [([(50, [1.0, 1.0], {}), (50, [2.0, 2.0], {})], DuplicateId), ([(51, [1.0, 1.0], {}), (5, [2.0, 2.0], {})], DuplicateId), ([(52, [1.0], {})], DimensionMismatch), ([(53, [1.0, float("nan")], {})], InvalidVector), ([(54, [], {})], InvalidVector), ([(-1, [1.0, 1.0], {})], ExecutionError)]
    for batch, error in bad:
        with pytest.raises(error):
            c.insert_many(batch)
    assert c.len() == 20 and c.insert_many([]) == 0
    assert engine.execute("INSERT INTO vectors (id, embedding, metadata) VALUES ($1, $2, $3)", Params(2**63 - 1, [1, 2], None)).count == 1
    assert c.contains(2**63 - 1) and c.dim == 2 and c.get_metadata(2**63 - 1) == {}


def test_changes(engine, spark):
    c = engine.collection("vectors")
    assert engine.execute("UPDATE vectors SET year = 1, year = 2, m['k'] = 1.5, m['l'] = 'x' WHERE category = 'docs'").count == 10
    assert count(engine, "year = 2 AND m['k'] = 1.5 AND m['l'] = 'x'") == 10
    with pytest.raises(ExecutionError):
        engine.execute("UPDATE vectors SET year['k'] = 1 WHERE id >= 1")
    assert engine.execute("UPDATE vectors SET year = NULL WHERE id = $1", Params(4)).count == 1
    assert ids(engine, "year IS NULL") == [4] and c.get_metadata(4) == {"category": "blog", "tags": ["go"]}
    with pytest.raises(ExecutionError):
        engine.execute("UPDATE vectors SET year = 1 WHERE id = 99")
    assert engine.execute("DELETE FROM vectors WHERE embedding <-> $1 < 2", Params([10.0, 0.0])).count == 3
    assert engine.execute("DELETE FROM vectors WHERE embedding <-> $1 <= 2 AND category = 'blog'", Params([10.0, 0.0])).count == 2
    assert engine.execute("DELETE FROM vectors WHERE year = 12345").count == 0
    for id, error in ((10, AlreadyDeleted), (99, NotFound)):
        with pytest.raises(error):
            engine.execute("DELETE FROM vectors WHERE id = $1", Params(id))
    with pytest.raises(DuplicateId):
        c.insert(10, [0.0, 0.0])
    again = Collection(spark, c.path)
    assert again.len() == c.len() == 15
    assert engine.execute("CHECKPOINT").lsn == c.state.number and c.len() == 15
    with pytest.raises(DuplicateId):
        c.insert(10, [0.0, 0.0])
    assert engine.execute("VACUUM vectors").count == 5 and engine.execute("VACUUM vectors").count == 0
    assert c.insert(10, [0.0, 0.0]) == 1 and Collection(spark, c.path).len() == 16
    assert engine.execute("DELETE FROM vectors WHERE id IS NOT NULL").count == 16 and c.is_empty()


def test_programmatic(engine):
    c = engine.collection("vectors")
    assert [r["id"] for r in c.search([5.2, 0.0], 3).collect()] == [5, 6, 4]
    assert [r["id"] for r in c.search([5.5, 0.0], 2).collect()] == [5, 6]
    assert [r["id"] for r in c.search_radius([5.0, 0.0], 1.0).collect()] == [5, 4, 6]
    assert [r["id"] for r in c.search_radius([5.0, 0.0], 1.0, inclusive=False).collect()] == [5]
    assert c.search([1.0, 1.0], 0).count() == 0 and c.distance_to(3, [0.0, 4.0]) == 5.0 and c.distance_to(99, [0.0, 0.0]) is None
    assert c.update_metadata({1: {"a": 1}, 2: {}}) == 2 and c.get_metadata(2) == {}
    with pytest.raises(NotFound):
        c.update_metadata({1: {}, 77: {}})
    with pytest.raises(NotFound):
        c.delete_many([1, 77])
    assert c.delete_many([1, 2]) == 2 and c.count_matching(F.col("id") < 5) == 2
    with pytest.raises(DimensionMismatch):
        c.search([1.0], 1)
    assert c.should_checkpoint(CheckpointPolicy(max_deltas=2)) and not c.should_checkpoint() and c.should_checkpoint(CheckpointPolicy(None, 0.1))


def test_two_writers(engine, spark):
    a = engine.collection("vectors")
    b = Collection(spark, a.path)
    a.insert(100, [0.0, 0.0])
    with pytest.raises(ConcurrentCommit):
        b.insert(101, [0.0, 0.0])
    b.refresh()
    assert b.contains(100) and not b.contains(101)


def test_unpublished_files_are_not_read(engine, spark):
    c = engine.collection("vectors")
    c.rows().limit(3).withColumns({"deleted": F.lit(True), "at": F.lit(99).cast("bigint")}).write.parquet(f"{c.path}/data/left-over")
    assert Collection(spark, c.path).len() == 20
    c.checkpoint()
    assert "left-over" in c.log.files.names("data")  # a writer may be at it
    c.grace = 0.0
    c.checkpoint()
    assert "left-over" not in c.log.files.names("data")


def test_a_checkpoint_leaves_what_others_are_about_to_publish(engine, spark, monkeypatch):
    c = engine.collection("vectors")
    c.grace = 0.0
    other = Collection(spark, c.path)
    sweep, done = c.log.sweep, []

    def interleaved(*args):
        # after the checkpoint's commit another writer takes it in and writes its rows; after the sweep it publishes them
        other.refresh()
        commit = other.log.commit
        monkeypatch.setattr(other.log, "commit", lambda *entry: (sweep(*args), done.append(1), commit(*entry)))
        other.insert(500, [1.0, 1.0], {"late": True})

    monkeypatch.setattr(c.log, "sweep", interleaved)
    c.checkpoint()
    again = Collection(spark, c.path)
    assert done and again.len() == 21 and again.get_metadata(500) == {"late": True}


ODD = [1, 1.0, "1", True, False, [1, "a"], [], {"k": 1}, float("nan"), 0.0, -0.0, 2020, 2021.5, "2022"]


def test_indexes_answer_like_scans(engine):
    c = engine.collection("vectors")
    c.insert_many([(100 + i, [0.0, 1.0], {"year": v, "tags": [v] if not isinstance(v, (list, dict)) else ["go"]}) for i, v in enumerate(ODD)])
    wheres = [
        "year = 2021", "year != 2021", "year >= 2022", "year < 1.5", "year BETWEEN 0 AND 2021", "year IN (1, '1', TRUE)", "year = 1.0 OR category = 'docs'", "year > 2020 AND category = 'blog'", "NOT year = 1", "year IS NULL", "year IS NOT NULL",
        "tags @> 'go'", "tags @> 1 AND year = 1", "tags @> TRUE OR tags @> 'ml'", "year = NULL", "category != 'docs' AND tags @> 'go' AND year > 0", "year = 1 AND missing = 2",
    ]
    before = {w: (ids(engine, w), count(engine, w)) for w in wheres}
    for m, f in (("HASH", "category"), ("BTREE", "year"), ("HASH", "year"), ("INVERTED", "tags")):
        engine.execute(f"CREATE INDEX ON vectors USING {m} ({f})")
    assert {w: (ids(engine, w), count(engine, w)) for w in wheres} == before
    engine.execute("UPDATE vectors SET year = 1 WHERE id = 3")
    assert 3 in ids(engine, "year = 1")
    engine.execute("CHECKPOINT")
    assert 3 in ids(engine, "year = 1") and c._fresh()


def test_index_names(engine, spark):
    engine.execute("CREATE INDEX one ON vectors USING HASH (year)")
    with pytest.raises(IndexNameInUse):
        engine.execute("CREATE INDEX one ON vectors USING HASH (category)")
    with pytest.raises(IndexAlreadyExists):
        engine.execute("CREATE INDEX two ON vectors USING HASH (year)")
    assert list(Collection(spark, engine.collection("vectors").path).catalog) == ["one"]
    engine.execute("DROP INDEX one ON vectors")
    with pytest.raises(UnknownIndexName):
        engine.execute("DROP INDEX one ON vectors")
    assert not Collection(spark, engine.collection("vectors").path).catalog


def test_params_and_tables(engine):
    for sql, p in (("SELECT id FROM vectors WHERE year = $2 LIMIT 1", Params(1)), ("SELECT id FROM vectors WHERE year = $x LIMIT 1", Params()), ("SELECT id FROM vectors ORDER BY embedding <-> $1 LIMIT 1", Params("x")), ("SELECT id FROM nothing WHERE a = 1 LIMIT 1", Params()), ("SELECT id FROM vectors WHERE year = $0 LIMIT 1", Params(1))):
        with pytest.raises(ExecutionError):
            engine.execute(sql, p)
    assert Params(1).with_positional(2).with_named("x", 3).resolve(type("P", (), {"key": "x"})) == 3


def test_read_only(spark, sf):
    from corvane.queries import views

    with pytest.raises(PlanError):
        views(spark, sf).execute("DELETE FROM vectors WHERE label = 1")


def test_explain_shows_an_estimate(engine):
    engine.execute("CHECKPOINT")
    rows = {r["what"]: r["text"] for r in engine.execute("EXPLAIN SELECT id FROM vectors WHERE category = 'docs' LIMIT 5").collect()}
    assert abs(float(rows["selectivity"]) - 0.5) < 0.01 and "Scan parquet" in rows["plan"]


def test_stream(spark, tmp_path):
    from corvane.functions import values
    from corvane.streaming.ingest import ingest

    c = Collection(spark, f"file://{tmp_path}/s", dim=2)
    spark.createDataFrame([(i, [float(i), 1.0], values.encode_bag({"n": i})) for i in range(10)], values.ROW).repartition(3).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        ingest(spark.readStream.schema(values.ROW).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), c, f"{tmp_path}/check").awaitTermination()
    assert c.len() == 10 and c.state.number >= 2
