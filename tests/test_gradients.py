"""Gradients of a batch by differences, and its losses against the DataFrame functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.functions import gradients as G
from weftgraph.functions import losses as L

DECODERS = ("distmult", "complex", "transe", "dot")


def numeric(loss, arrays, eps=1e-6):
    out = []
    for x in arrays:
        grad = np.zeros_like(x)
        for at in np.ndindex(x.shape):
            x[at] += eps
            up = loss()
            x[at] -= 2 * eps
            grad[at] = (up - loss()) / (2 * eps)
            x[at] += eps
        out.append(grad)
    return out


@pytest.mark.parametrize("decoder", DECODERS)
@pytest.mark.parametrize("loss", sorted(G.LOSSES))
@pytest.mark.parametrize("reduction", ["sum", "mean"])
def test_gradients_by_differences(decoder, loss, reduction):
    rng = np.random.default_rng(sum(map(ord, decoder + loss)))
    a, r, b, n = (rng.normal(size=(k, 4)) for k in (3, 3, 3, 5))
    chosen = np.array([[0, 2], [1, 4], [3, 0]])
    masked = rng.random((3, 5)) < 0.3
    for how in ({}, {"chosen": chosen}, {"masked": masked}):
        if "masked" in how and loss == "mse":
            continue  # the square of a masked score swamps differences
        run = lambda: G.side(decoder, loss, a, r, b, n, reduction, 0.1, **how)  # noqa: E731, B023
        for found, wanted in zip(run()[1:], numeric(lambda: run()[0], (a, r, b, n)), strict=True):
            assert np.allclose(found, wanted, atol=1e-5), (decoder, loss, how)


@pytest.mark.parametrize("decoder", DECODERS)
def test_generator_gradients_by_differences(decoder):
    rng = np.random.default_rng(5)
    a, n, reward = rng.normal(size=(3, 4)), rng.normal(size=(6, 4)), rng.normal(size=(3, 6))
    run = lambda: G.generator(decoder, a, n, reward)
    for found, wanted in zip(run()[1:], numeric(lambda: run()[0], (a, n)), strict=True):
        assert np.allclose(found, wanted, atol=1e-6)


def test_losses_equal_the_expressions(spark):
    rng = np.random.default_rng(7)
    pos, neg = rng.normal(size=4), rng.normal(size=(4, 6))
    df = spark.createDataFrame([(float(p), [float(x) for x in n]) for p, n in zip(pos, neg)], "pos double, neg array<double>")
    each = lambda f: F.aggregate(F.transform("neg", lambda x: f(x, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x) + f(F.col("pos"), F.lit(1.0))
    columns = {"softmax_ce": L.softmax_loss(F.col("pos"), F.col("neg")), "ranking": L.ranking_loss(F.col("pos"), F.col("neg")), "cross_entropy": L.cross_entropy(F.concat(F.array("pos"), "neg"), F.lit(0))}
    columns |= {"bce_after_sigmoid": each(L.bce_after_sigmoid), "bce_with_logits": each(L.bce_with_logits), "mse": each(L.squared_error), "softplus": each(L.softplus_loss)}
    row = df.agg(*[F.sum(c).alias(k) for k, c in columns.items()]).first()
    for name, value in row.asDict().items():
        assert np.isclose(G.LOSSES[name](pos, neg, 0.1)[0], value)


def test_selection():
    scores = np.array([[1.0, 5, 2, 2, 0, 9], [3, 3, 3, 3, 3, 3]])
    assert G.select(scores, 3, True).tolist() == [[1, 2, 5], [0, 2, 4]]
    assert G.select(scores, 4, True).tolist() == G.select(scores, 4, False).tolist() == [[5, 1, 2, 3], [0, 1, 2, 3]]


def test_selection_of_few_sorts_no_rows(monkeypatch):
    rng = np.random.default_rng(4)
    scores = rng.integers(-4, 4, (30, 40)).astype(float)  # many ties
    expected = {k: np.argsort(-scores, axis=1, kind="stable")[:, :k] for k in (1, 10, 16, 17, 40)}
    assert all(np.array_equal(G.select(scores, k, False), x) for k, x in expected.items())
    odd = np.where(scores == 3, -np.inf, np.where(scores == 2, np.nan, scores))
    assert np.array_equal(G.select(odd, 10, False), np.argsort(-odd, axis=1, kind="stable")[:, :10])
    monkeypatch.setattr(G.np, "argsort", None)
    assert np.array_equal(G.select(scores, 10, False), expected[10])
