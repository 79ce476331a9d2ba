"""Training as its settings say."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.functions import gradients as G
from weftgraph.functions import ranking
from weftgraph.functions.hashing import digest_numbers
from weftgraph.operators import partition as P
from weftgraph.operators import scoring as S
from weftgraph.operators import train as T

N = 24


@pytest.fixture(scope="module")
def edges(spark):
    """Two rings: one step on by relation 0, three steps on by relation 1."""
    rows = [(i, 0, (i + 1) % N) for i in range(N)] + [(i, 1, (i + 3) % N) for i in range(N)]
    return spark.createDataFrame([(e, *r) for e, r in enumerate(rows)], "edge_id long, src long, rel int, dst long").cache()


def mrr(spark, edges, state, decoder):
    ranks = S.filtered_ranks(edges, state.table.select("id", "emb"), T.relation_table(spark, state.relations["relations"]), edges, decoder)
    return S.metrics(ranks).first().mrr


WAYS = [
    dict(decoder="distmult", loss="softmax_ce"),
    dict(decoder="complex", loss="softplus", dense_optimizer="adam", dense_rate=0.05),
    dict(decoder="transe", loss="mse", reduction="mean", scale=0.1),
    dict(decoder="dot", loss="ranking", margin=0.5),
    dict(decoder="distmult", loss="bce_with_logits", method="dns", selected_ratio=0.5, tournament=True),
    dict(decoder="complex", loss="cross_entropy", method="gan", selected_ratio=0.4),
    dict(decoder="distmult", loss="bce_after_sigmoid", parts=4, capacity=2, ordering="BETA", chunks=2, degree_fraction=0.5, local_filter="all"),
]


@pytest.mark.parametrize("how", WAYS, ids=lambda h: "-".join(str(v) for v in h.values()))
def test_training_learns(spark, edges, how):
    inverse = how["decoder"] != "dot"
    settings = T.Settings(**({"dim": 8, "epochs": 4, "batch": 24, "step_batches": 1, "negatives": 10, "inverse_edges": inverse, "rate": 0.2} | how))
    begin = T.start(spark, settings, N, 2)
    before = mrr(spark, edges, begin, settings.decoder)
    relations = begin.relations["relations"].copy()
    state = T.train(edges, N, settings, 2, begin)
    assert len(state.losses) == 4 and state.losses[-1] < state.losses[0]
    assert mrr(spark, edges, state, settings.decoder) > before or settings.decoder == "transe"
    assert settings.decoder == "dot" or not np.allclose(state.relations["relations"], relations)
    assert ("inverse_relations" in state.relations) == inverse
    if settings.method == "gan":
        assert state.table.where("exists(state_g, x -> x > 0)").count() == N


def test_batch_gradients_by_differences():
    rng = np.random.default_rng(1)
    ids = np.array([2, 3, 5, 8, 9, 11])
    vectors, generators = rng.normal(size=(6, 4)), rng.normal(size=(6, 4))
    edges = {"src": np.array([2, 3, 5, 8, 2]), "rel": np.array([0, 1, 1, 0, 0]), "dst": np.array([3, 9, 11, 2, 5])}
    places = [(s, c, k) for s in range(2) for c in range(2) for k in range(3)]
    drawn = {"side": np.array([p[0] for p in places]), "chunk": np.array([p[1] for p in places]), "slot": np.array([p[2] for p in places]), "node": rng.choice(ids, len(places))}
    for how in (dict(local_filter="all"), dict(reduction="mean", degree_fraction=0.4, negatives=5), dict(method="dns", selected_ratio=0.7, loss="softplus")):
        settings = T.Settings(**({"dim": 4, "decoder": "complex", "inverse_edges": True, "chunks": 2, "negatives": 3} | how))
        relations = {k: rng.normal(size=(2, 4)) for k in ("relations", "inverse_relations")}

        def run():
            return T.batch_gradients(settings, relations, edges, drawn, ids, vectors, generators, np.random.default_rng(4))  # noqa: B023

        _, found = run()
        for array, (_, grad) in ((vectors, found[T.NODE]), (relations["relations"], found[T.RELATION]), (relations["inverse_relations"], found[T.INVERSE])):
            for at in np.ndindex(array.shape):
                array[at] += 1e-6
                up = run()[0]
                array[at] -= 2e-6
                down = run()[0]
                array[at] += 1e-6
                assert abs((up - down) / 2e-6 - grad[at]) < 1e-4


def test_negatives_come_from_resident_partitions(spark):
    settings = T.Settings(inverse_edges=True, chunks=2, negatives=50, degree_fraction=0.1, parts=5)
    rows = T.draw_negatives(spark, settings, 23, (4, 1), 3, 5, "x").collect()
    assert len(rows) == 2 * 2 * 2 * 45 and len({(r.batch, r.side, r.chunk, r.slot) for r in rows}) == len(rows)
    assert {r.node for r in rows} == {5, 6, 7, 8, 9, 20, 21, 22} and {r.batch for r in rows} == {3, 4}
    assert T.draw_negatives(spark, T.Settings(negatives=0), 23, (0,), 0, 2, "x").count() == 0


def test_every_edge_is_trained_in_one_state(spark, edges):
    for how in (dict(parts=1), dict(parts=4, capacity=4), dict(parts=8, capacity=4, ordering="COMET", ratio=2), dict(parts=16, capacity=4, ordering="COVER")):
        owned = P.assign_buckets(P.states_table(spark, T.states_of(T.Settings(**how))))
        held = P.with_buckets(edges, N, how["parts"]).join(owned, ["src_part", "dst_part"])
        assert held.count() == edges.count() and owned.groupBy("src_part", "dst_part").count().where("count > 1").count() == 0


def test_relations_have_a_bound(monkeypatch):
    monkeypatch.setattr(T, "RELATION_BYTES", 100)
    with pytest.raises(ValueError):
        T.initial_relations("distmult", 10, 10, True)


def test_written_tables_are_deleted(spark, edges, tmp_path):
    from pathlib import Path

    from weftgraph.sources import shared

    folder = Path(shared.shared_folder(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    state = T.train(edges, N, T.Settings(dim=4, epochs=3, batch=10, step_batches=2, negatives=5, parts=4, capacity=2, ordering="BETA"), 2)
    assert state.table.count() == N
    assert len(set(folder.iterdir()) - before) < 30  # the last table, and those of positions in shuffles
    table = shared.cut(edges.select(F.col("src")))
    assert Path(table._written_at).exists()
    shared.release(table, edges)
    assert not Path(table._written_at).exists() and edges.count() == 2 * N


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from weftgraph.sources import shared

    class Cluster:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(RuntimeError):
        shared.shared_folder(Cluster)


def test_a_superstep_over_a_small_table_writes_no_gradients(spark, edges, monkeypatch):
    settings = T.Settings(dim=4, negatives=3)
    written, cut = [], T.cut
    monkeypatch.setattr(T, "cut", lambda df, *a, **b: (written.append(df.columns), cut(df, *a, **b))[1])
    own = edges.withColumn("batch", F.floor(F.col("edge_id") / 10).cast("long")).withColumn("row", F.pmod("edge_id", F.lit(10)).cast("int"))
    drawn = T.draw_negatives(spark, settings, N, (0,), 0, 5, "x")
    tables = []
    for held in (T.HELD_BYTES, 0):
        monkeypatch.setattr(T, "HELD_BYTES", held)
        begin = T.start(spark, settings, N, 2)
        written.clear()
        state, loss = T.superstep(settings, own, drawn, begin, 3)
        if held:
            assert written == [["id", "emb", "state"]]
        tables.append((loss, state.relations["relations"], {r.id: r.emb + r.state for r in state.table.collect()}))
    assert np.isclose(tables[0][0], tables[1][0]) and np.allclose(tables[0][1], tables[1][1])
    assert all(np.allclose(tables[0][2][i], tables[1][2][i]) for i in range(N))


#: Ways of training that differ by what a superstep needs.
BOTH_WAYS = {
    "train_link_prediction": dict(),
    "train_complex": dict(decoder="complex", loss="softplus", reduction="mean", dense_optimizer="adam", dense_rate=0.01),
    "train_transe": dict(decoder="transe", method="dns", selected_ratio=0.5, tournament=True, parts=4, capacity=2, ordering="BETA"),
    "train_generator": dict(loss="ranking", method="gan", selected_ratio=0.4, degree_fraction=0.5, chunks=2),
}


@pytest.mark.parametrize("name", BOTH_WAYS)
def test_training_from_matrices_equals_joins_and_writes_no_table_a_superstep(spark, edges, monkeypatch, name):
    settings = T.Settings(**({"dim": 4, "epochs": 1, "batch": 8, "step_batches": 1, "negatives": 10, "inverse_edges": True} | BOTH_WAYS[name]))
    found, written, cut = [], [], T.cut
    monkeypatch.setattr(T, "cut", lambda df, *a, **b: (written.append(df.columns), cut(df, *a, **b))[1])
    for held in (T.HELD_BYTES, 0):
        monkeypatch.setattr(T, "HELD_BYTES", held)
        written.clear()
        state = T.train(edges, N, settings, 2)
        states = len(T.states_of(settings))
        assert len(written) <= 3 + states or not held  # the start, the end, the edges and those of each state
        found.append((state.losses, state.relations, {r.id: sum((r[c] for c in r.asDict() if c != "id"), []) for r in state.table.collect()}))
    (losses, relations, table), (other_losses, other_relations, other) = found
    assert np.allclose(losses, other_losses) and all(np.allclose(relations[k], other_relations[k]) for k in relations)
    assert sorted(table) == sorted(other) == list(range(N)) and all(np.allclose(table[i], other[i]) for i in table)


@pytest.mark.parametrize("name", BOTH_WAYS)
def test_tasks_draw_the_negatives_of_draw_negatives(spark, name):
    settings = T.Settings(**({"negatives": 7, "inverse_edges": True} | BOTH_WAYS[name]))
    resident = (0,) if settings.parts == 1 else (3, 0)
    draw = T.node_draws(settings, 23, resident, "x")
    for batch in (3, 4):
        rows = T.draw_negatives(spark, settings, 23, resident, batch, batch + 1, "x").orderBy("side", "chunk", "slot").collect()
        assert [tuple(r[1:]) for r in rows] == list(zip(*(draw(batch)[c].tolist() for c in ("side", "chunk", "slot", "node")), strict=True))


@pytest.mark.parametrize(("heads", "span", "size"), [(3, 100, 20), (1, 40, 20), (1, 700, 7), (3, 10, 64), (1, 1 << 15, 5000)])
def test_batches_are_packed_in_the_seeded_order(spark, monkeypatch, heads, span, size):
    """Also where a range of hashes lies in several spans, a span is one batch, or all edges are."""
    monkeypatch.setattr(T, "SPAN", span)
    monkeypatch.setattr(ranking, "HEX", heads)
    rows = spark.range(0, 3000, 1, 5).select((F.col("id") * 7).alias("edge_id"), (F.col("id") % 71).alias("src"), (F.col("id") % 3).cast("int").alias("rel"), (F.col("id") * 11 % 83).alias("dst"))
    found = T.packed_in_order(rows, 3000, size, "x").collect()
    held = {r.batch: list(zip(*(np.frombuffer(r[c], "<i4").tolist() for c in ("src", "rel", "dst")), strict=True)) for r in found}
    assert len(held) == len(found) == -(-3000 // size)
    expected = T.batches(T.shuffle_edges(rows, "x"), size).orderBy("batch", "row").collect()
    assert [e for b in sorted(held) for e in held[b]] == [(r.src, r.rel, r.dst) for r in expected]
    assert all(len(held[b]) == size for b in range(3000 // size))


def test_an_epoch_sorts_edges_once(spark, edges, monkeypatch):
    """Batches come from one sort of the edges: none by rank in a window, and none by batch after it."""
    plans, cut = [], T.cut
    monkeypatch.setattr(T, "cut", lambda df, *a, **b: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df, *a, **b))[1])
    T.train(edges, N, T.Settings(dim=4, epochs=1, batch=8, step_batches=1, negatives=5), 2)
    packing = [p for p in plans if "MapInArrow" in p and "_span" in p]
    assert len(packing) == 1 and "Window" not in packing[0] and packing[0].count("Exchange hashpartitioning") == 1


def test_sums_of_rows_by_place():
    rng = np.random.default_rng(2)
    parts = [(rng.integers(0, 7, k), rng.normal(size=(k, 3))) for k in (5, 0, 40)]
    expected = np.zeros((9, 3))
    for places, rows in parts:
        np.add.at(expected, places, rows)
    assert np.array_equal(G.sum_rows(9, 3, parts), expected) and not G.sum_rows(2, 3, []).any()


def test_digests_in_numbers():
    import hashlib

    ids = np.array([0, 9, 10, 99, 100, 12345678, 10**18 - 1, 10**18, 2**63 - 1, -3, 7])
    for seed in ("x", "epoch0:1", "a" * 50):
        high, low = digest_numbers(seed, ids, 4)
        expected = [hashlib.md5(f"{seed}:{i}".encode()).hexdigest() for i in ids.tolist()]
        assert [f"{a:016x}{b:016x}" for a, b in zip(high.tolist(), low.tolist(), strict=True)] == expected
    assert len(digest_numbers("x", ids[:0])[0]) == 0


@pytest.mark.parametrize("name", ["train_one_step", "train_link_prediction", "train_complex", "train_transe", "train_generator"])
def test_vectors_of_fifty_thousand_nodes_are_held(spark, name):
    settings = T.Settings(**({"dim": 64 if name == "train_one_step" else 16} | BOTH_WAYS.get(name, {})))
    table = spark.range(3).select("id", *[F.array(F.lit(0.5), F.col("id").cast("double")).alias(c) for c in ("emb", "state", "emb_g", "state_g")])
    held = T.hold(settings, table, 51282)
    assert held.ids.tolist() == [0, 1, 2] and held.columns["emb"].tolist() == [[0.5, i] for i in range(3)]
    assert [r.state for r in held.table(spark).orderBy("id").collect()] == [[0.5, float(i)] for i in range(3)]


def test_large_gradients_are_summed_by_blocks_before_the_driver(spark, edges, monkeypatch):
    """And a superstep over all edges writes none of them."""
    settings = T.Settings(dim=4, loss="mse", batch=10, negatives=0)
    written, cut, found, dealt = [], T.cut, [], []
    monkeypatch.setattr(T, "cut", lambda df, *a, **b: (written.append(df.columns), cut(df, *a, **b))[1])
    repartition = type(edges).repartition
    monkeypatch.setattr(type(edges), "repartition", lambda df, *a: (dealt.append(a), repartition(df, *a))[1])
    for sent, block, held in ((T.SENT_BYTES, T.BLOCK_BYTES, T.HELD_BYTES), (1, 5 * 8 * 4, T.HELD_BYTES), (1, 1, 0)):
        for name, value in (("SENT_BYTES", sent), ("BLOCK_BYTES", block), ("HELD_BYTES", held)):
            monkeypatch.setattr(T, name, value)
        begin = T.start(spark, settings, N, 2)
        written.clear(), dealt.clear()
        others = edges.unionByName(spark.createDataFrame([(99, None, 0, 1), (100, 2, 0, N)], edges.schema)) if held else edges
        state, loss = T.step_over(others, settings, begin)  # an end that has no vector makes no edge
        if held:
            assert written == [["id", "emb", "state"]]
            assert (("kind", "block") in [a[1:] for a in dealt]) == (sent == 1)
        found.append((loss, state.relations["relations"], np.array([r.emb + r.state for r in state.table.orderBy("id").collect()])))
    for other in found[1:]:
        assert np.isclose(found[0][0], other[0]) and np.allclose(found[0][1], other[1]) and np.allclose(found[0][2], other[2])


@pytest.mark.parametrize("name", BOTH_WAYS)
def test_pieces_of_spans_are_dealt_not_edges(spark, name):
    """A task hands on one row for a span, whatever edges it has of it."""
    rows = spark.range(0, 5000, 1, 2).select(F.col("id").alias("edge_id"), (F.col("id") % 71).alias("src"), F.lit(0).alias("rel"), (F.col("id") % 83).alias("dst"))
    found = T.packed_in_order(rows, 5000, 100, name, 500)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") >= 2 and "md5" not in plan and "conv(" not in plan
    held = {r.batch: np.frombuffer(r["src"], "<i4").tolist() for r in found.collect()}
    expected = T.batches(T.shuffle_edges(rows, name), 100).orderBy("pos").collect()
    assert sorted(held) == list(range(50)) and sum((held[b] for b in range(50)), []) == [r.src for r in expected]
