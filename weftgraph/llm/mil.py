"""Quality classifier: gated-attention multiple-instance learning over the passages of a text.

A text is a bag of passages of 64 words. Each passage is described by rates of byte classes and word statistics
and encoded by a learned layer; gated attention weighs the encodings, and a logistic unit scores their weighted
mean. Only document labels are used. The model is fitted by Adam on the driver, on at most ``sample`` labelled
texts (those of the smallest hashed doc_id); all texts are scored where they lie, whole, without a shuffle.

Defined cases: a null or empty text is a bag of one passage without words; rows without label, or whose label is
neither 0 nor 1, teach nothing; labels of an absent document are ignored; repeated rows are scored each; without
labels of both kinds every score is the share of label 1 (one half without labels); a score equal to the threshold
is predicted 1; an empty table gives an empty result; other columns pass through; a text of any length is read
whole, in memory in proportion to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.cluster import bounded_sample, crc_mod, map_arrow, places, take
from weftgraph.llm.words import LEAD, Words, codes_of, slices

PASSAGE = 64
#: Classes of ASCII bytes with a rate of their own.
MARKS = [*b"#*$%&|<>!?.,;:-+@/\"'()[]{}=_~^`\\"]
CLASS = np.zeros(256, np.intp)
CLASS[97:123], CLASS[65:91], CLASS[48:58] = 1, 2, 3
CLASS[[9, 32]], CLASS[10] = 4, 5
CLASS[128:] = 6
CLASS[128:192] = 7
CLASS[MARKS] = 8 + np.arange(len(MARKS))
N_CLASSES = 8 + len(MARKS)
N_FEATURES = N_CLASSES + 5


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, float32, and the bounds of each text's passages; a text has one at least."""
    words = Words(texts)
    n_doc = np.maximum(1, -(-words.counts // PASSAGE))
    bounds = np.concatenate([[0], np.cumsum(n_doc)])
    n = int(bounds[-1])
    of_word = bounds[:-1][words.doc] + (np.arange(len(words)) - words.bounds[:-1][words.doc]) // PASSAGE
    # A passage reaches from its first word to the next passage's; a text's first one starts with the text.
    begins = np.repeat(words.offsets[:-1], n_doc)
    if len(words):
        first = np.flatnonzero(np.concatenate([[True], of_word[1:] != of_word[:-1]]))
        inner = of_word[first] > bounds[:-1][words.doc[first]]
        begins[of_word[first][inner]] = words.starts[first[inner]]
    sizes = np.diff(np.concatenate([begins, [len(words.data)]]))
    where = np.repeat(np.arange(n), sizes)
    counts = np.bincount(where * N_CLASSES + CLASS[words.data], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    out = np.zeros((n, N_FEATURES), np.float32)
    out[:, :N_CLASSES] = np.sqrt(counts / np.maximum(sizes, 1)[:, None])
    n_words = np.bincount(of_word, minlength=n)
    some = np.maximum(n_words, 1)
    out[:, N_CLASSES] = np.log1p(np.bincount(where, LEAD[words.data], minlength=n) / some) - 1.5
    out[:, N_CLASSES + 1] = n_words / PASSAGE
    if len(words):
        codes, known = words.encoded()
        keys = codes_of(of_word * np.int64(len(known)) + codes)
        new = np.zeros(len(words), bool)
        new[np.unique(keys, return_index=True)[1]] = True
        out[:, N_CLASSES + 2] = np.bincount(of_word, new, minlength=n) / some
        same = np.zeros(len(words), bool)
        same[1:] = (codes[1:] == codes[:-1]) & (of_word[1:] == of_word[:-1])
        out[:, N_CLASSES + 3] = np.sqrt(np.bincount(of_word, same, minlength=n) / some)
    out[:, N_CLASSES + 4] = n_words == 0
    return out, bounds


class Model:
    """Gated attention over encoded passages; ``weights`` are arrays by name."""

    def __init__(self, weights: dict[str, np.ndarray] | None, rate: float = 0.5) -> None:
        self.weights, self.rate = weights, rate

    def score(self, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if self.weights is None or len(bounds) < 2:
            return np.full(len(bounds) - 1, self.rate)
        return sigmoid(forward(self.weights, features, bounds)["logit"])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def forward(w: dict[str, np.ndarray], features: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    at, owner = bounds[:-1], np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    x = (features - w["mean"]) / w["scale"]
    h = np.tanh(x @ w["encode"] + w["encode0"])
    t, g = np.tanh(h @ w["tanh"]), sigmoid(h @ w["gate"])
    e = (t * g) @ w["attend"]
    e = np.exp(e - np.maximum.reduceat(e, at)[owner])
    a = e / np.add.reduceat(e, at)[owner]
    z = np.add.reduceat(a[:, None] * h, at, axis=0)
    return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "owner": owner, "logit": z @ w["out"] + w["out0"]}


def gradients(w: dict[str, np.ndarray], features: np.ndarray, bounds: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log loss."""
    f = forward(w, features, bounds)
    d = (sigmoid(f["logit"]) - y) / len(y)
    dz = d[:, None] * w["out"]
    da = (dz[f["owner"]] * f["h"]).sum(1)
    de = f["a"] * (da - np.add.reduceat(f["a"] * da, bounds[:-1])[f["owner"]])
    dtg = de[:, None] * w["attend"]
    dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
    dh = f["a"][:, None] * dz[f["owner"]] + dt @ w["tanh"].T + dg @ w["gate"].T
    dh *= 1 - f["h"] ** 2
    return {"encode": f["x"].T @ dh, "encode0": dh.sum(0), "tanh": f["h"].T @ dt, "gate": f["h"].T @ dg, "attend": (f["t"] * f["g"]).T @ de, "out": f["z"].T @ d, "out0": d.sum()}


def train(features: np.ndarray, bounds: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 128, rate: float = 0.01, seed: int = 7) -> Model:
    if len(y) == 0 or y.min() == y.max():
        return Model(None, float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    d, h, k = features.shape[1], 16, 8
    w = {"mean": features.mean(0), "scale": features.std(0) + 0.02, "encode": rng.normal(0, d**-0.5, (d, h)), "encode0": np.zeros(h), "tanh": rng.normal(0, h**-0.5, (h, k)), "gate": rng.normal(0, h**-0.5, (h, k)), "attend": rng.normal(0, k**-0.5, k), "out": rng.normal(0, h**-0.5, h), "out0": np.log(y.mean() / (1 - y.mean()))}
    free = [k for k in w if k not in ("mean", "scale")]
    first, second, step = {k: 0.0 for k in free}, {k: 0.0 for k in free}, 0
    sizes = np.diff(bounds)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            own = order[at : at + batch]
            inner = np.concatenate([[0], np.cumsum(sizes[own])])
            rows = np.repeat(bounds[own] - inner[:-1], sizes[own]) + np.arange(inner[-1])
            grad = gradients(w, features[rows], inner, y[own])
            step += 1
            for k in free:
                g = grad[k] + 1e-4 * w[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] = w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(w)


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample: int, folds: int, held_out: int) -> DataFrame:
    """doc_id, text and y of the ``sample`` labelled rows outside the held-out fold with the smallest hashed doc_id."""
    docs, labels = take(docs, "doc_id", "text"), take(labels, "doc_id", label)
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), folds) != held_out))
    known = known.select("doc_id", F.col(label).cast("int").alias("y")).groupBy("doc_id").agg(F.max("y").alias("y"))
    known = bounded_sample(known, "doc_id", sample)
    return docs.join(F.broadcast(known), "doc_id")  # at most ``sample`` rows


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 6000, folds: int = 5, held_out: int = 0) -> Model:
    """A model of ``labels.label`` from rows whose crc32(doc_id) mod ``folds`` isn't ``held_out``."""

    def run(batch: pa.RecordBatch):
        for rows, texts in slices(batch):
            features, bounds = passages(texts)
            yield pa.RecordBatch.from_arrays([rows["doc_id"], rows["y"], pa.array([features[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], names=["doc_id", "y", "features"])

    rows = map_arrow(labelled(docs, labels, label, sample, folds, held_out).select(F.col("doc_id").cast("string").alias("doc_id"), "text", "y"), run, "doc_id string, y int, features binary")
    found = rows.toArrow().sort_by([("doc_id", "ascending"), ("features", "ascending")])
    bags = [np.frombuffer(b, np.float32).reshape(-1, N_FEATURES) for b in found["features"].to_pylist()]
    features = np.concatenate(bags) if bags else np.zeros((0, N_FEATURES), np.float32)
    return train(features, np.concatenate([[0], np.cumsum([len(b) for b in bags])]).astype(np.int64), np.array(found["y"].to_pylist(), float))


def with_score(docs: DataFrame, model: Model, name: str = "score", column: str = "text") -> DataFrame:
    """``docs`` with the model's score of ``column`` under ``name``."""

    def run(batch: pa.RecordBatch):
        for rows, texts in slices(batch, column):
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(model.score(*passages(texts)), pa.float64())], names=[*rows.schema.names, name])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{name}` double"])
    return map_arrow(docs, run, fields)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **how) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs`` (doc_id, text)."""
    folds, held_out = how.get("folds", 5), how.get("held_out", 0)
    scored = with_score(take(docs, "doc_id", "text"), fit(docs, labels, **how)).drop("text")
    return scored.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **how) -> DataFrame:
    """The rows of ``docs`` scored at ``threshold`` or more, with their own columns."""
    plain, place, inner = places(docs)
    model = fit(plain.select(F.col(place["doc_id"]).alias("doc_id"), F.col(place["text"]).alias("text")), labels, **how)
    kept = with_score(plain, model, column=place["text"]).where(F.col("score") >= threshold)
    return kept.select(*[F.col(c).alias(o) for c, o in zip(inner, docs.columns, strict=True)])
