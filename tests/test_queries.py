"""Every query with SQL against that SQL; the others run and keep what they promise."""

import numpy as np
import pytest

from weftgraph.functions.optim import init
from weftgraph.operators import schedule
from weftgraph.plans import analysis, registry
from weftgraph.sources.graphs import folded, vectors


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(name, same):
    same(registry.QUERIES[name], registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(name, spark, sf_dir):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_training_learns(spark, sf_dir):
    losses = [r.loss for r in registry.QUERIES["train_link_prediction"](spark, sf_dir).orderBy("epoch").collect()]
    assert losses[1] < losses[0]


def test_optimizers_approach(spark, sf_dir):
    assert all(r.gap < 1 for r in registry.QUERIES["m26_optimizers"](spark, sf_dir).collect())


def test_replay_has_no_mismatch(spark, sf_dir):
    assert all(r.mismatches == 0 and r.n_unique <= r.n_ids for r in registry.QUERIES["x6_unique_replay"](spark, sf_dir).collect())


def test_optimized_cover_is_no_worse(spark, sf_dir):
    rows = registry.QUERIES["k6_optimized_cover"](spark, sf_dir).collect()
    assert [r.after for r in rows] <= [r.before for r in rows]


def test_optimized_cover_has_four_lanes(spark, sf_dir):
    sizes = analysis._sizes(spark, sf_dir, 16)
    rows = registry.QUERIES["k6_optimized_cover"](spark, sf_dir).collect()
    assert [r.before for r in rows] == list(schedule.score(range(16), schedule.cover(16), sizes, 16, 4, 1000))


def test_layers_take_whole_vectors(spark, sf_dir):
    emb = {r.id: np.array(r.emb) for r in vectors(spark, sf_dir).select("id", "emb").collect()}
    edges = [(r.src, r.rel, r.dst) for r in folded(spark, sf_dir).collect()]
    assert {len(v) for v in emb.values()} == {64}
    into, out = {n: [] for n in emb}, {n: [] for n in emb}
    for s, r, d in edges:
        into[d].append(s)
        out[s].append((r, d))

    def rows(name):
        return {(r.id, r.i): r.x for r in registry.QUERIES[name](spark, sf_dir).collect()}

    def same(name, expected):
        found = rows(name)
        wanted = {(n, i + 1): x for n, v in expected.items() for i, x in enumerate(v)}
        assert found.keys() == wanted.keys() and all(abs(found[k] - wanted[k]) < 2e-6 for k in wanted)

    w, a = init("glorot_uniform", (2, 64, 3), 1), init("glorot_uniform", (2, 2, 3), 2)
    gat = {}
    for n in emb:
        ends, parts = [*into[n], n], []
        for h in range(2):
            x = np.array([emb[s] @ w[h] @ a[h][0] + emb[n] @ w[h] @ a[h][1] for s in ends])
            e = np.exp(np.where(x > 0, x, 0.2 * x))
            parts.append((e / e.sum()) @ np.array([emb[s] @ w[h] for s in ends]))
        gat[n] = np.concatenate(parts)
    same("e5_gat", gat)

    w, own = init("glorot_uniform", (3, 64, 2), 3), init("glorot_uniform", (64, 2), 4)
    same("e6_rgcn", {n: emb[n] @ own + (sum(emb[d] @ w[r] for r, d in out[n]) / len(out[n]) if out[n] else 0) for n in emb})

    mean = {n: (sum((emb[s] for s in into[n]), np.zeros(64)) + emb[n]) / (len(into[n]) + 1) for n in emb}
    k = {n: np.sqrt(len(into[n]) + 1) for n in emb}
    same("e9_staged_encoder", {n: (mean[n] / k[n] + sum((mean[s] / k[s] for s in into[n]), np.zeros(64))) / k[n] @ init("glorot_uniform", (64, 2), 5) for n in emb})
