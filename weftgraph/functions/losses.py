"""Activations and losses as expressions.

Scores of a positive and its negatives are a number and an array; ``reduce`` names the reduction over negatives and,
by ``reduced``, over rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftgraph.functions.vectors import total


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softplus(x: Column) -> Column:
    """ln(1 + e^x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def softmax_loss(pos: Column, neg: Column) -> Column:
    """-ln(e^pos / (e^pos + sum of e^neg)), shifted by the greatest score."""
    top = F.greatest(pos, F.array_max(neg))
    return top + F.log(F.exp(pos - top) + total(F.transform(neg, lambda x: F.exp(x - top)))) - pos


def ranking_loss(pos: Column, neg: Column, margin: float = 0.1) -> Column:
    return total(F.transform(neg, lambda x: F.greatest(x - pos + margin, F.lit(0.0))))


def cross_entropy(scores: Column, target: Column) -> Column:
    """Of logits by class and the place (from 0) of the true one."""
    top = F.array_max(scores)
    return top + F.log(total(F.transform(scores, lambda x: F.exp(x - top)))) - F.element_at(scores, target + 1)


def bce_after_sigmoid(score: Column, y: Column) -> Column:
    """Binary cross entropy of the score's sigmoid; logarithms are held at -100."""
    log = lambda x: F.greatest(F.log(x), F.lit(-100.0))
    p = sigmoid(score)
    return -(y * log(p) + (1 - y) * log(1 - p))


def bce_with_logits(score: Column, y: Column) -> Column:
    return softplus(score) - y * score


def squared_error(score: Column, y: Column) -> Column:
    return (score - y) * (score - y)


def softplus_loss(score: Column, y: Column) -> Column:
    """ln(1 + e^(-s)) of positives, ln(1 + e^s) of negatives."""
    return softplus(F.when(y > 0, -score).otherwise(score))


def reduced(x: Column, reduction: str = "sum") -> Column:
    return {"sum": F.sum, "mean": F.avg}[reduction](x)


def norm_regularizer(v: Column, norm: int = 2, weight: float = 1e-3) -> Column:
    """weight times the sum of the components' powers."""
    return total(F.transform(v, lambda x: F.pow(F.abs(x), F.lit(float(norm))))) * weight
