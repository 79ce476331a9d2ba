"""Edge cases and brute force on small graphs."""

import json
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.functions import losses as L
from weftgraph.functions import optim, ranking
from weftgraph.functions.ranking import places_within, positions, shuffled_positions
from weftgraph.operators import dictionary as D
from weftgraph.operators import messages as E
from weftgraph.operators import partition as P
from weftgraph.operators import sampling as N
from weftgraph.operators import scoring as S
from weftgraph.plans import registry
from weftgraph.plans.ingest import edges_with_ids
from weftgraph.sources import files
from weftgraph.sources.graphs import folded
from weftgraph.sources.shared import new_path

EDGES = [(0, 0, 1), (0, 0, 1), (1, 1, 1), (2, 0, 3), (3, 1, 0), (0, 1, 2), (0, 0, 4), (0, 1, 5)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(i, *e) for i, e in enumerate(EDGES)], "edge_id long, src long, rel int, dst long")


def test_positions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    assert [r.at for r in positions(df, ["x"], "at").orderBy("x").collect()] == list(range(1000))
    assert sorted(r.at for r in shuffled_positions(df, ["x"], "s", "at").collect()) == list(range(1000))
    assert positions(df.limit(0), ["x"], "at").count() == 0


def test_places_within_ranges(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 500).alias("x"))
    found = places_within(df, ["k"], "x", "at", width=16).collect()
    for k in range(3):
        assert [r.at for r in sorted((r for r in found if r.k == k), key=lambda r: r.x)] == list(range(sum(r.k == k for r in found)))


def test_dictionary_keeps_isolated_nodes(spark, edges):
    known = spark.createDataFrame([(9,)], "raw long")
    ids = D.dense_ids(D.node_universe(edges, known)).collect()
    assert sorted(r.id for r in ids) == list(range(7)) and 9 in {r.raw for r in ids}


def test_degrees_count_self_loops_and_repeats(edges):
    found = {r.node: (r.out_degree, r.in_degree) for r in D.node_degrees(edges).collect()}
    out, into = Counter(e[0] for e in EDGES), Counter(e[2] for e in EDGES)
    assert found == {n: (out[n], into[n]) for n in set(out) | set(into)}


@pytest.mark.parametrize("fractions", [(0.9, 0.1), (0.8, 0.1, 0.1), (1.0, 0.0, 0.0)])
def test_split_sizes_are_exact(spark, fractions):
    df = spark.range(137).select(F.col("id").alias("src"), F.col("id").alias("dst"))
    sizes = Counter(r.split for r in D.split_edges(df, fractions, ["src", "dst"]).collect())
    assert sizes["train"] == int(137 * fractions[0]) and sum(sizes.values()) == 137


@pytest.mark.parametrize(("n", "parts"), [(7, 4), (9, 8)])
def test_last_partitions_are_cut_short(spark, n, parts):
    sizes = [r["size"] for r in P.partition_table(spark, n, parts).orderBy("part").collect()]
    assert sum(sizes) == n and min(sizes) >= 0 and len(sizes) == parts


def test_listed_and_arithmetic_ids_agree(spark, edges):
    resident = P.states_table(spark, [(1, 0)]).select("slot", "part")
    listed = {r.node: r.local for r in P.dense_local_ids(resident, P.partition_table(spark, 6, 3)).collect()}
    rows = P.arithmetic_local_ids(edges, resident, 6, 3).collect()
    assert rows and all((listed[r.src], listed[r.dst]) == (r.local_src, r.local_dst) for r in rows)


def test_uniform_sample_draws_with_replacement(spark, edges):
    roots = spark.createDataFrame([(0, 0)], "root long, node long")
    found = N.sample_uniform(roots, N.adjacency(edges, incoming=False), 3)
    rows = found.collect()
    assert sorted(r.slot for r in rows) == [0, 1, 2] and {r.src for r in rows} == {0}
    every = N.sample_uniform(roots, N.adjacency(edges, incoming=False), 5).collect()
    assert sorted(r.edge_id for r in every) == [0, 1, 5, 6, 7]


def test_k_hop_reaches_nodes_once(spark, edges):
    found = N.k_hop(spark.createDataFrame([(2,)], "root long"), edges, 3, incoming=False).collect()
    assert [sorted(r.node for r in found if r.hop == h) for h in range(3)] == [[2], [3], [0] * 5]


def test_batches_and_chunks_have_no_phantom_rows(edges):
    rows = N.batches(N.shuffle_edges(edges), 5).collect()
    assert Counter(r.batch for r in rows) == {0: 5, 1: 3}
    assert N.chunk_size(10, 3) == 4


def test_tournament_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    scores = rng.integers(0, 4, (5, 8))
    df = spark.createDataFrame([(r, s, float(scores[r, s])) for r in range(5) for s in range(8)], "row int, slot int, score double")
    found = {(r.row, r.slot) for r in N.select_tournament(df, 8, 4, ["row"]).collect()}
    assert found == {(r, 2 * g + int(scores[r, 2 * g + 1] > scores[r, 2 * g])) for r in range(5) for g in range(4)}
    top = {(r.row, r.slot) for r in N.select_tournament(df, 8, 3, ["row"]).collect()}
    assert top == {(r, int(s)) for r in range(5) for s in sorted(range(8), key=lambda s: (-scores[r, s], s))[:3]}


@pytest.mark.parametrize("decoder", ["distmult", "complex", "transe"])
def test_filtered_ranks_equal_brute_force(spark, edges, decoder):
    rng = np.random.default_rng(1)
    emb, rel = rng.normal(size=(6, 4)).round(2), rng.normal(size=(2, 4)).round(2)
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(emb)], "id long, emb array<double>")
    rels = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rel)], "rel int, vec array<double>")

    def score(s, r, d):
        if decoder == "distmult":
            return (emb[s] * rel[r]) @ emb[d]
        if decoder == "complex":
            a, b = emb[s][:2] + 1j * emb[s][2:], rel[r][:2] + 1j * rel[r][2:]
            q = a * b
            return np.concatenate([q.real, q.imag]) @ emb[d]
        return math.sqrt(max(((emb[s] + rel[r] - emb[d]) ** 2).sum(), 1e-8))

    known = set(EDGES)
    expected = {i: 1 + sum((s, r, c) not in known and round(score(s, r, c), 6) >= round(score(s, r, d), 6) for c in range(6)) for i, (s, r, d) in enumerate(EDGES)}
    found = S.filtered_ranks(edges, nodes, rels, edges, decoder, block=2, rows=3)
    assert {r.edge_id: r.rank for r in found.collect()} == expected


def test_filtered_ranks_meet_known_edges_in_their_cells(spark, monkeypatch):
    """Edges that share a source and a relation don't each list the known edges of both."""
    rng = np.random.default_rng(3)
    emb, rel = rng.normal(size=(80, 4)), rng.normal(size=(1, 4))
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(emb)], "id long, emb array<double>")
    rels = spark.createDataFrame([(0, rel[0].tolist())], "rel int, vec array<double>")
    asked = spark.createDataFrame([(d, 0, 0, d) for d in range(60)], "edge_id long, src long, rel int, dst long")
    known = asked.unionByName(spark.createDataFrame([(90, None, 0, 1), (91, 0, 0, 99), (92, 7, 0, 70)], asked.schema))
    scored, seen = S.score_candidates, []
    monkeypatch.setattr(S, "score_candidates", lambda rows, *a, **b: (seen.append(rows.count()), scored(rows, *a, **b))[1])
    found = {r.edge_id: r.rank for r in S.filtered_ranks(asked, nodes, rels, known, block=32, rows=32, facts=16).collect()}
    all_scores = (emb[0] * rel[0]) @ emb.T
    assert found == {d: 1 + sum(round(all_scores[c], 6) >= round(all_scores[d], 6) for c in range(60, 80)) for d in range(60)}
    assert max(seen) <= 60


@pytest.mark.parametrize("decoder", ["distmult", "complex", "transe", "dot"])
def test_candidate_scores_by_matrix_and_by_join(spark, edges, decoder):
    rng = np.random.default_rng(5)
    nodes = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(6) if i != 4], "id long, emb array<double>")
    rels = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(2)], "rel int, vec array<double>")
    rows = edges.select("edge_id", "src", "rel", F.col("dst").alias("node"))
    rows = rows.unionByName(spark.createDataFrame([(90, 0, 7, 1), (91, 99, 0, 1), (92, 0, 0, None)], rows.schema))
    by = [{r.edge_id: round(r.score, 9) for r in S.score_candidates(rows, nodes, rels, decoder, small).collect()} for small in (1 << 20, -1)]
    assert by[0] == by[1] and sorted(by[0]) == [i for i, e in enumerate(EDGES) if 4 not in e]


def test_generated_negatives_by_lists_and_by_join(spark):
    """Candidates are selected where their row lies: no plan over lists sends vectors or scores on."""
    rng = np.random.default_rng(4)
    g, e = rng.normal(size=(6, 3)).round(2), rng.normal(size=(6, 3)).round(2)
    e[3] = e[2]
    tables = [spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x) if i != 5], "id long, emb array<double>") for x in (g, e)]
    batched = spark.createDataFrame([(i // 4, i % 4, i % 6) for i in range(10)] + [(2, 3, None), (2, 2, 99)], "batch long, row int, src long")
    drawn = [(b, c, s, int(rng.integers(0, 7))) for b in range(3) for c in range(2) for s in range(5)]
    negatives = spark.createDataFrame(drawn, "batch long, chunk int, slot int, node long")
    expected = set()
    for i in [i for i in range(10) if i % 6 < 5]:
        own = sorted((-round(float(g[i % 6] @ e[n]), 6), s, n) for b, c, s, n in drawn if (b, c) == (i // 4, i % 4 // 2) and n < 5)
        expected |= {(i // 4, i % 4, s, n) for _, s, n in own[:3]}
    for small in (1 << 20, -1):
        found = S.select_generated(batched, negatives, 2, *tables, 5, 0.6, small=small)
        assert sorted(map(tuple, found.collect())) == sorted(expected)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert ("Window" in plan) == (small < 0)


def test_generator_negatives_select_without_a_window_over_candidates(spark, sf_dir):
    plan = registry.QUERIES["n16_generator_negatives"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "score" not in [w for line in plan.splitlines() if "Window" in line for w in line.replace("#", " ").split()]
    assert "DESC NULLS" not in plan


def test_ties_count_against_the_positive(spark):
    df = spark.createDataFrame([(1.0, [1.0, 2.0, 0.5])], "pos double, neg array<double>")
    assert df.select(S.rank(F.col("pos"), F.col("neg")).alias("r")).first().r == 3


def test_gat_and_rgcn_equal_numpy(spark, edges):
    rng = np.random.default_rng(2)
    emb = rng.normal(size=(6, 3))
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(emb)], "id long, emb array<double>")
    w, a = rng.normal(size=(2, 3, 2)), rng.normal(size=(2, 2, 2))
    found = {r.id: np.array(r.vec) for r in E.gat(edges, nodes, w, a).collect()}
    for n in range(6):
        parts = []
        for h in range(2):
            p = emb @ w[h]
            ends = [s for s, _, d in EDGES if d == n] + [n]
            x = np.array([p[s] @ a[h][0] + p[n] @ a[h][1] for s in ends])
            x = np.where(x > 0, x, 0.2 * x)
            e = np.exp(x - x.max())
            parts.append((e / e.sum()) @ p[ends])
        assert np.allclose(found[n], np.concatenate(parts))
    relw, own = rng.normal(size=(2, 3, 2)), rng.normal(size=(3, 2))
    found = {r.id: np.array(r.vec) for r in E.rgcn(edges, nodes, relw, own).collect()}
    for n in range(6):
        out = [(r, d) for s, r, d in EDGES if s == n]
        assert np.allclose(found[n], emb[n] @ own + (sum(emb[d] @ relw[r] for r, d in out) / len(out) if out else 0))


def test_optimizers_by_hand():
    p = {"w": np.array([1.0])}
    optim.SGD(0.1).step(p, {"w": np.array([2.0])})
    assert p["w"][0] == pytest.approx(0.8)
    p = {"w": np.array([1.0])}
    optim.Adagrad(0.1).step(p, {"w": np.array([2.0])})
    assert p["w"][0] == pytest.approx(0.9)
    p = {"w": np.array([1.0])}
    optim.Adam(0.1).step(p, {"w": np.array([2.0])})
    assert p["w"][0] == pytest.approx(0.9)
    assert optim.generator_reward(np.array([0.0]))[0] == 0
    assert optim.init("glorot_normal", (400, 600)).std() == pytest.approx(math.sqrt(2 / 1000), rel=0.05)
    with pytest.raises(ValueError):
        optim.init("else", (1,))


def test_losses_survive_large_scores(spark):
    row = spark.range(1).select(L.softplus(F.lit(800.0)).alias("a"), L.softmax_loss(F.lit(900.0), F.array(F.lit(-900.0))).alias("b"), L.bce_after_sigmoid(F.lit(900.0), F.lit(0.0)).alias("c")).first()
    assert (row.a, row.b, row.c) == (800.0, 0.0, 100.0)


def test_sinks_and_checkpoints(spark, edges):
    path = new_path(spark)
    bucketed = P.with_buckets(edges, 6, 3)
    files.write_edges(bucketed, path, {"n_edges": 8})
    assert files.read_stats(spark, path) == {"n_edges": 8}
    pruned = spark.read.parquet(path).where("src_part = 0 AND dst_part = 0")
    assert pruned.count() == bucketed.where("src_part = 0 AND dst_part = 0").count()
    assert "PartitionFilters: [isnotnull(src_part" in pruned._jdf.queryExecution().toString()
    root = new_path(spark, "ckpt")
    files.save_checkpoint({"edges": edges}, root, 1, {"epoch": 3})
    tables, about = files.load_checkpoint(spark, root, 1)
    assert tables["edges"].count() == 8 and about["epoch"] == 3
    files.append(edges, f"{root}/log")
    files.append(edges, f"{root}/log")
    assert spark.read.parquet(f"{root}/log").count() == 16


def test_scans(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# x\n# y\n1 2\n3 4\n")
    rows = files.scan(spark, str(tmp_path / "a.txt"), "txt", columns=(1, 0), sep=" ", header=2).collect()
    assert sorted((r.src, r.dst) for r in rows) == [("2", "1"), ("4", "3")]
    (tmp_path / "b.csv").write_text("s,d\na,b\n")
    assert [tuple(r) for r in files.scan(spark, str(tmp_path / "b.csv"), "CSV", columns=(0, 1), sep=",", header=1).collect()] == [("a", "b")]
    with pytest.raises(ValueError):
        files.scan(spark, "x", "ORC")
    (tmp_path / "t").write_text("a\tr\tb\n")
    assert set(files.load_dataset(spark, "fb15k", *[str(tmp_path / "t")] * 3)) == {"train", "valid", "test"}
    with pytest.raises(ValueError):
        files.load_dataset(spark, "fb15k", str(tmp_path / "t"))


def test_degree_stream(spark, edges, tmp_path):
    from weftgraph.streaming.degrees import degree_stream

    for i in range(2):
        edges.select("src", "dst").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = degree_stream(spark, str(tmp_path / "in"), "src long, dst long", str(tmp_path / "out"))
    query.awaitTermination(120)
    found = {r.node: r.degree for r in spark.read.parquet(str(tmp_path / "out/v1")).collect()}
    assert found == {r.node: 2 * r.degree for r in D.node_degrees(edges).collect()}


def test_checks(edges):
    row = P.check_ids(edges, 4).first()
    assert (row.n_rows, row.negative, row.too_large, row.missing) == (8, 0, 2, 0)
    json.dumps(row.asDict())


def test_event_counts_and_scores(spark, sf_dir, tmp_path):
    from weftgraph.streaming.degrees import event_counts

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = event_counts(events)
    assert rows.agg(F.sum("n")).first()[0] == events.count()
    files.write_scores(rows, str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).columns == ["day", "event_type", "n", "total"]


def test_relation_corruption_changes_the_relation(spark, edges):
    rows = N.relation_negatives(N.batches(N.shuffle_edges(edges), 5), 3, 4).collect()
    assert len(rows) == 3 * len(EDGES) and all(r.corrupted != r.rel and 0 <= r.corrupted < 4 for r in rows)


def test_node_dataset(spark, tmp_path):
    """A bundle of edges, splits, features and labels, whose universe is wider than its edges."""
    (tmp_path / "edge.csv").write_text("0,1\n1,2\n4,0\n")
    for name, ids in (("train", "0\n1\n"), ("valid", "2\n"), ("test", "3\n\n")):
        (tmp_path / name).write_text(ids)
    (tmp_path / "feat.csv").write_text("".join(f"{i}.5,{-i}\n" for i in range(5)))
    (tmp_path / "label.csv").write_text("".join(f"{i % 2}\n" for i in range(5)))
    at = lambda name: str(tmp_path / name)
    raw = files.load_node_dataset(spark, "ogbn_arxiv", at("edge.csv"), {k: at(k) for k in ("train", "valid", "test")}, at("feat.csv"), at("label.csv"))
    assert {r.raw for r in raw["known"].collect()} == {"0", "1", "2", "3", "4"}
    nodes = spark.createDataFrame([(str(i), 10 - i) for i in range(5)], "raw string, id long")
    held = {k: v.collect() for k, v in files.remap_node_dataset(raw, nodes).items()}
    assert sorted((r.src, r.dst) for r in held["edges"]) == [(6, 10), (9, 8), (10, 9)]
    assert {r.id: r.split for r in held["split"]} == {10: "train", 9: "train", 8: "valid", 7: "test"}
    assert {r.id: (r.vec, r.label) for r in files.remap_node_dataset(raw, nodes)["features"].join(files.remap_node_dataset(raw, nodes)["labels"], "id").collect()} == {10 - i: ([i + 0.5, -i], i % 2) for i in range(5)}


def test_lines_of_a_split_file_keep_their_places(spark, tmp_path):
    (tmp_path / "lines").write_text("".join(f"line {i}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = files.numbered_lines(spark, str(tmp_path / "lines")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.at, r.line) for r in rows) == [(i, f"line {i}") for i in range(5000)]


def test_the_report_lists_no_known_edges_per_edge(spark, sf_dir, monkeypatch):
    """What is scored one by one are the test edges themselves."""
    scored, seen = S.score_candidates, []
    monkeypatch.setattr(S, "score_candidates", lambda rows, *a, **b: (seen.append(rows.count()), scored(rows, *a, **b))[1])
    report = registry.QUERIES["link_prediction_report"](spark, sf_dir).first()
    assert seen == [report.n_ranks]


@pytest.mark.parametrize("decoder", ["distmult", "transe"])
def test_filtered_ranks_in_place_and_in_cells(spark, monkeypatch, decoder):
    """Ranks are the same by both ways; few vectors need no table of asked edges."""
    rng = np.random.default_rng(11)
    nodes = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(50) if i != 7], "id long, emb array<double>")
    rels = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(3)], "rel int, vec array<double>")
    rows = sorted({tuple(int(x) for x in rng.integers(0, (50, 3, 50))) for _ in range(900)})
    known = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)] + [(None, 3, 9, 4), (None, 60, 0, 1), (None, None, 0, 1)], "edge_id long, src long, rel int, dst long")
    asked = known.where("edge_id % 5 = 0")
    ranked = lambda **how: sorted(tuple(r) for r in S.filtered_ranks(asked, nodes, rels, known, decoder, **how).collect())
    cells = ranked(block=16, rows=16, small=0)
    monkeypatch.setattr(S, "cut", lambda *_: pytest.fail("a table was written"))
    assert ranked() == cells and 100 < len(cells) < 180


def test_the_last_split_ranks_one_range_of_the_order(spark, monkeypatch):
    rows = spark.range(3000).select(F.col("id").alias("edge_id"), (F.col("id") % 70).alias("src"), F.lit(0).alias("rel"), (F.col("id") * 3).alias("dst"))
    ids, ranked = ["src", "rel", "dst"], []
    expected = D.split_edges(rows, (0.9, 0.05, 0.05), ids).where("split = 'test'").drop("split")
    numbered = ranking.F.row_number
    monkeypatch.setattr(ranking, "HEX", 1)
    monkeypatch.setattr(ranking.F, "row_number", lambda: (ranked.append(1), numbered())[1])
    found = D.last_split(rows, (0.9, 0.05, 0.05), ids)
    assert sorted(found.collect()) == sorted(expected.collect()) and found.count() == 150 and ranked == [1]
    assert not D.last_split(rows.limit(0), (0.9, 0.05, 0.05), ids).collect()
    assert len(D.last_split(rows, (0.0, 0.0, 1.0), ids).collect()) == 3000


def test_edges_of_odd_keys_are_numbered_as_they_are_ordered(spark, tmp_path):
    spark.createDataFrame([(i, [0.0], 0) for i in range(5)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    keys = [(o, p, s, f) for o in (None, -8, 0, 3) for p in (None, -7, -5, 4, 12) for s in (None, 2) for f in (None, "A", "N", "R")]
    spark.createDataFrame(keys * 2, "l_orderkey long, l_partkey long, l_suppkey long, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = {(r.src, r.rel, r.dst): r.edge_id for r in edges_with_ids(spark, str(tmp_path)).collect()}
    listed = folded(spark, str(tmp_path)).orderBy("src", "rel", "dst").collect()
    assert found == {tuple(r): i for i, r in enumerate(listed)} and len(found) == len(listed) > 30
