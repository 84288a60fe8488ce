import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane import Collection, Engine, Params
from corvane.functions.hnsw import Graph, HnswParams, layer_sizes, levels
from corvane.operators import ann


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    """400 vectors in several cells, one of which is split."""
    c = Collection(spark, f"file://{tmp_path_factory.mktemp('ann')}/c", dim=8)
    r = np.random.default_rng(5)
    x = r.normal(size=(400, 8)) * 0.3 + r.choice([-2.0, 0.0, 2.0], size=(400, 1), p=[0.6, 0.2, 0.2])
    c.insert_many([(i, v.tolist(), {"k": i % 10}) for i, v in enumerate(x)])
    whole = ann.CELL_BYTES
    ann.build.__defaults__ = (12_000, ann.SAMPLE)
    try:
        for op in ("<->", "<=>", "<#>"):
            c.add_hnsw_index(op, HnswParams(m=8, m_max=8, ef_construction=60))
    finally:
        ann.build.__defaults__ = (whole, ann.SAMPLE)
    return c, x


def exact(c, q, k, op, where=None):
    rows = c.search_filtered(q, k, where if where is not None else F.lit(True), op)
    return [r["id"] for r in rows.collect()]


def test_cells_cover_all_and_split(filled, spark):
    c, x = filled
    index, at = c.ann_index("<->")
    graphs = index.graphs.select("cell", "part", "n").collect()
    assert index.n == 400 == sum(g["n"] for g in graphs) and len(index.cells) > 2
    assert max(g["n"] for g in graphs) < 250 and at == c.state.indexes["idx_embedding_hnsw_l2"]["at"]


@pytest.mark.parametrize("op", ["<->", "<=>", "<#>"])
def test_recall_and_full_width(filled, op):
    c, x = filled
    queries = (x[::20] + 0.05).tolist()
    assert c.ann_recall(queries, 10, op, 60) >= 0.95
    for q in queries[:4]:
        assert [r["id"] for r in c.search(q, 15, op, ef=10_000).collect()] == exact(c, q, 15, op)
        assert exact(c, q, 7, op, F.col("metadata")["k"]["i"] == 3) == [r["id"] for r in c.search_filtered(q, 7, F.col("metadata")["k"]["i"] == 3, op, ef=10_000).collect()]


def test_never_fewer_than_match(filled):
    c, x = filled
    e = Engine(c.spark, v=c)
    rows = e.execute("SELECT id FROM v WHERE k = 7 ORDER BY embedding <-> $1 LIMIT 60 ANN 4", Params(x[0].tolist())).collect()
    assert len(rows) == 40  # all that match


def test_radius(filled):
    c, x = filled
    for op, radius in (("<->", 0.8), ("<=>", 0.1), ("<#>", -1.0)):
        want = [r["id"] for r in c.search_radius(x[3].tolist(), radius, op).collect()]
        assert [r["id"] for r in c.search_radius(x[3].tolist(), radius, op, approximate=True).collect()] == want and want
    for radius in (float("nan"), float("inf"), -0.5):
        assert c.search_radius(x[3].tolist(), radius, approximate=True).count() == 0


def test_radius_loses_no_row_that_links_do_not_lead_to(spark, tmp_path):
    """Groups of copies fill each other's links, so beams stay in a few of them."""
    c = Collection(spark, f"file://{tmp_path}/c", dim=4)
    places = np.random.default_rng(2).normal(size=(20, 4)).round(2)
    c.insert_many([(i, places[i % 20].tolist(), {}) for i in range(800)])
    for op, radius in (("<->", 1.2), ("<=>", 0.4), ("<#>", -0.5)):
        c.add_hnsw_index(op, HnswParams(m=4, m_max=4, m_max0=8, ef_construction=20))
        q = places[3].tolist()
        want = [r["id"] for r in c.search_radius(q, radius, op).collect()]
        assert [r["id"] for r in c.search_radius(q, radius, op, approximate=True).collect()] == want and len(want) >= 80


def test_a_limit_beyond_the_table_sets_no_room_aside(filled):
    e = Engine(filled[0].spark, v=filled[0])
    for ann_ in ("", " ANN"):
        rows = e.execute(f"SELECT id FROM v WHERE embedding <-> $1 < 2.0 LIMIT 100000000{ann_}", Params(filled[1][3].tolist()))
        assert "100000000" not in rows._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(r["id"] for r in rows.collect()) == sorted(r["id"] for r in filled[0].search_radius(filled[1][3].tolist(), 2.0, inclusive=False).collect())


def test_radius_among_large_coordinates(spark, tmp_path):
    """Vectors far from the origin and near each other: single precision of their products would hide the distances."""
    c = Collection(spark, f"file://{tmp_path}/c", dim=2)
    c.insert_many([(i, [4096.0 + i / 64, 8192.0], {}) for i in range(300)])
    c.add_hnsw_index("<->")
    q = [4096.0, 8192.0]
    assert [r["id"] for r in c.search_radius(q, 2.0, approximate=True).collect()] == list(range(129))


def test_changes_since_the_build(filled, spark):
    c = Collection(spark, filled[0].path)
    q = filled[1][0].tolist()
    first = exact(c, q, 3, "<->")
    c.delete(first[0])
    c.insert(9000, q, {"k": 3})
    c.update_metadata({first[1]: {"k": 3}})
    assert [r["id"] for r in c.search(q, 4, ef=10_000).collect()] == exact(c, q, 4, "<->")
    assert c.search(q, 1, ef=20).first()["id"] == 9000
    assert {r["id"] for r in c.search_many([q], 3, ef=1000).collect()} == set(exact(c, q, 3, "<->"))
    c.checkpoint()  # builds the graphs anew
    assert c.ann_index("<->")[0].n == 400 and [r["id"] for r in c.search(q, 4, ef=10_000).collect()] == exact(c, q, 4, "<->")


def test_parameters_and_layers():
    for bad in ({"m": 1}, {"m": 8, "m_max": 4}, {"ef_search": 0}, {"ef_construction": 0}):
        with pytest.raises(ValueError):
            HnswParams(**bad)
    level = np.sort(levels(np.arange(20_000), HnswParams()))[::-1]
    sizes = layer_sizes(level)
    assert sizes[0] == 20_000 and 1000 < sizes[1] < 1500 and all(a > b for a, b in zip(sizes, sizes[1:], strict=False))


def test_same_rows_build_the_same_graph():
    x = np.random.default_rng(0).normal(size=(300, 6)).astype(np.float32)
    half = (x * x).sum(axis=1) / 2
    a, b = (Graph.build(x, [300, 20], HnswParams(), half) for _ in range(2))
    assert all((p == q).all() for p, q in zip(a.links, b.links, strict=True))
    ids, sims = a.search(x[:50], 40, half[:50])
    true = np.argsort(((x[:50, None] - x[None]) ** 2).sum(axis=2), axis=1)[:, :10]
    assert (ids[:, 0] == np.arange(50)).all() and np.mean([len(set(p) & set(q)) / 10 for p, q in zip(ids, true, strict=True)]) > 0.95
