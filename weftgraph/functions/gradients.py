"""Scores, losses and gradients of one batch of edges against its negatives, in NumPy.

A side of a batch has n edges, as vectors a (the end that is kept), r (relation) and b (the end that is replaced), and
k shared negatives in b's place. ``chosen`` names the negatives that count for each edge, ``masked`` those that are
no negatives for it. Scores are those of ``operators/scoring.py``; a TransE score is a distance.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

EPS = 1e-6
LEAST_SQUARE = 1e-8
MASKED = -1e9


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def softplus(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0) + np.log1p(np.exp(-np.abs(x)))


def operate(decoder: str, a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The kept end under its relation."""
    if decoder == "complex":
        h = a.shape[-1] // 2
        return np.concatenate([a[..., :h] * r[..., :h] - a[..., h:] * r[..., h:], a[..., :h] * r[..., h:] + a[..., h:] * r[..., :h]], -1)
    return a if decoder == "dot" else a + r if decoder == "transe" else a * r


def operate_back(decoder: str, a: np.ndarray, r: np.ndarray, dq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients by a and r from that by ``operate``."""
    if decoder == "complex":
        h = a.shape[-1] // 2
        (ar, ai), (rr, ri), (qr, qi) = ((x[..., :h], x[..., h:]) for x in (a, r, dq))
        return np.concatenate([qr * rr + qi * ri, qi * rr - qr * ri], -1), np.concatenate([qr * ar + qi * ai, qi * ar - qr * ai], -1)
    if decoder == "dot":
        return dq, np.zeros_like(r)
    return (dq, dq) if decoder == "transe" else (dq * r, dq * a)


def compare(decoder: str, q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scores of each row of q with the same row of b."""
    return np.sqrt(((q - b + EPS) ** 2).sum(-1)) if decoder == "transe" else (q * b).sum(-1)


def compare_all(decoder: str, q: np.ndarray, negatives: np.ndarray) -> np.ndarray:
    """Scores (n, k) of each row of q with every negative."""
    products = q @ negatives.T
    if decoder != "transe":
        return products
    return np.sqrt(np.maximum((q**2).sum(1)[:, None] + (negatives**2).sum(1) - 2 * products, LEAST_SQUARE))


def candidate_scores(decoder: str, q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scores of rows as candidates, which leave out the small constant of a positive's distance."""
    return np.sqrt(np.maximum(((q - b) ** 2).sum(-1), LEAST_SQUARE)) if decoder == "transe" else np.einsum("nd,nd->n", q, b)


def _softmax(pos, neg, margin):
    top = np.maximum(pos, neg.max(1, initial=-np.inf))
    e, own = np.exp(neg - top[:, None]), np.exp(pos - top)
    total = e.sum(1) + own
    return (np.log(total) + top - pos).sum(), own / total - 1, e / total[:, None], len(pos)


def _ranking(pos, neg, margin):
    gap = neg - pos[:, None] + margin
    over = (gap > 0).astype(float)
    return (gap * over).sum(), -over.sum(1), over, neg.size


def _elementwise(value: Callable, slope: Callable) -> Callable:
    """Of scores one by one: label 1 for positives, 0 for negatives."""

    def loss(pos, neg, margin):
        return value(pos, 1.0).sum() + value(neg, 0.0).sum(), slope(pos, 1.0), slope(neg, 0.0), pos.size + neg.size

    return loss


def _bce(x, y):
    return -np.maximum(np.where(y > 0, -softplus(-x), -softplus(x)), -100.0)


#: Loss (sum), gradients by positive and negative scores, and the number of terms that a mean divides by.
LOSSES: dict[str, Callable] = {
    "softmax_ce": _softmax,
    "cross_entropy": _softmax,  # of the positive's class among all scores
    "ranking": _ranking,
    "bce_after_sigmoid": _elementwise(_bce, lambda x, y: sigmoid(x) - y),
    "bce_with_logits": _elementwise(lambda x, y: softplus(x) - y * x, lambda x, y: sigmoid(x) - y),
    "mse": _elementwise(lambda x, y: (x - y) ** 2, lambda x, y: 2 * (x - y)),
    "softplus": _elementwise(lambda x, y: softplus(-x if y > 0 else x), lambda x, y: sigmoid(x) - y),
}


def side(decoder: str, loss: str, a: np.ndarray, r: np.ndarray, b: np.ndarray, negatives: np.ndarray, reduction: str = "sum", margin: float = 0.1, chosen: np.ndarray | None = None, masked: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Loss of one side and its gradients by a, r, b and the negatives. ``chosen``: (n, k') places of negatives."""
    q = operate(decoder, a, r)
    pos, every = compare(decoder, q, b), compare_all(decoder, q, negatives)
    distances = every
    if masked is not None:
        every = np.where(masked, MASKED, every)
    neg = every if chosen is None else np.take_along_axis(every, chosen, 1)
    total, dpos, dneg, terms = LOSSES[loss](pos, neg, margin)
    if reduction == "mean":
        total, dpos, dneg = total / max(terms, 1), dpos / max(terms, 1), dneg / max(terms, 1)
    if chosen is not None:
        wide = np.zeros_like(every)
        np.put_along_axis(wide, chosen, dneg, 1)
        dneg = wide
    if masked is not None:
        dneg = np.where(masked, 0.0, dneg)
    if decoder == "transe":
        w0 = (dpos / np.maximum(pos, 1e-30))[:, None] * (q - b + EPS)
        w = np.where(distances**2 > LEAST_SQUARE, dneg / distances, 0.0)
        dq, db, dn = w0 + q * w.sum(1)[:, None] - w @ negatives, -w0, negatives * w.sum(0)[:, None] - w.T @ q
    else:
        dq, db, dn = dpos[:, None] * b + dneg @ negatives, dpos[:, None] * q, dneg.T @ q
    da, dr = operate_back(decoder, a, r, dq)
    return float(total), da, dr, db, dn


def select(scores: np.ndarray, k: int, tournament: bool) -> np.ndarray:
    """Places (n, k) of the negatives chosen by score, the first among equals: the best of each of k equal runs, or the
    k best where runs aren't equal or no tournament is held."""
    n, total = scores.shape
    if tournament and total % k == 0:
        width = total // k
        return scores.reshape(n, k, width).argmax(2) + np.arange(k) * width
    if k <= 16 and np.isfinite(scores).all():  # the best, one after another: a sort of whole rows costs more
        left, rows, out = scores.astype(float), np.arange(n), np.empty((n, k), np.int64)
        for i in range(k):
            out[:, i] = left.argmax(1)
            left[rows, out[:, i]] = -np.inf
        return out
    return np.argsort(-scores, axis=1, kind="stable")[:, :k]


def sum_rows(n: int, dim: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The (n, dim) sums of rows by place, of ``parts`` of (places, rows), added in their order."""
    if not parts:
        return np.zeros((n, dim))
    places, rows = (np.concatenate(x) for x in zip(*parts, strict=True))
    at = (places[:, None] * dim + np.arange(dim)).ravel()
    return np.bincount(at, rows.ravel(), n * dim).reshape(n, dim)


def generator(decoder: str, a: np.ndarray, negatives: np.ndarray, reward: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The generator's loss, -mean of reward p ln p over all candidates with p the softmax of its own scores, and its
    gradients by its vectors a and those of the candidates. ``reward``: (n, k), held fixed."""
    logits = compare_all(decoder, a, negatives)
    shifted = logits - logits.max(1, keepdims=True)
    logp = shifted - np.log(np.exp(shifted).sum(1, keepdims=True))
    p = np.exp(logp)
    terms = p * reward * (logp + 1)
    dlogits = -(terms - p * terms.sum(1, keepdims=True)) / logits.size
    loss = float(-(reward * p * logp).mean())
    if decoder == "transe":
        w = np.where(logits**2 > LEAST_SQUARE, dlogits / logits, 0.0)
        return loss, a * w.sum(1)[:, None] - w @ negatives, negatives * w.sum(0)[:, None] - w.T @ a
    return loss, dlogits @ negatives, dlogits.T @ a
