"""Mixing sources to target weights with soft membership.

A classifier learned from a labelled table gives every document posteriors of the domains. Documents then get
nonnegative rates such that the expected tokens of each domain (the sum of tokens x rate x posterior) meet targets; a
token is a word between white space, whatever tokenizer the mixture meets later:
least squares, by projected gradient from a rate of one for all. Distances of rates are weighed by tokens and the
residual by the inverse of the domains' second moments, which makes the unit step safe and, as long as no rate is
clipped at zero, exact. A rate then depends on the posterior alone, so that posteriors (rounded to thousandths)
are pre-aggregated to cells with their tokens; a step is one sum over the cells, and the driver holds a vector of
the domains' totals for each step.

The classifier is multinomial logistic regression on hashed words and rates of byte classes, fitted on the driver on
at most ``sample`` labelled documents, those of the smallest hashed doc_id.

Defined cases: a null or empty text has no words: posteriors as the classifier gives them, no tokens, and a rate
like others of its posterior; rows without label and labels without a target teach nothing; repeated rows count
each; without labels the domains have equal posteriors; a domain with a target but no labelled document counts for
nothing, and the other weights are scaled up; without tokens all rates are one; an empty table gives an empty
result; other columns pass through or are ignored; texts of any length are read whole, in memory in proportion to
the text; of equal greatest posteriors the first domain is the likeliest.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.cluster import bounded_sample, cut, map_arrow, places, take
from weftgraph.llm.mil import CLASS, N_CLASSES
from weftgraph.llm.words import Words, slices

BUCKETS = 1 << 15
WIDTH = BUCKETS + N_CLASSES
UNIT = 1000


def vectors(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of all texts: row, column and value of what isn't zero, and the number of words of each text."""
    words = Words(texts, lower=True)
    n = words.n_docs
    row = np.repeat(np.arange(n), np.diff(words.offsets))
    counts = np.bincount(row * N_CLASSES + CLASS[words.data], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    r, c = np.nonzero(counts)
    v = np.sqrt(counts[r, c] / np.diff(words.offsets)[r])
    if not len(words):
        return r, c + BUCKETS, v, words.counts
    codes, known = words.encoded()
    bucket = np.array([zlib.crc32(w.strip(b".,;:!?\"'()[]*#$%&|")) % BUCKETS for w in known.to_pylist()], np.int64)
    seen = np.unique(words.doc * np.int64(BUCKETS) + bucket[codes])
    own = seen // BUCKETS
    size = np.bincount(own, minlength=n)
    return np.concatenate([own, r]), np.concatenate([seen % BUCKETS, c + BUCKETS]), np.concatenate([4 / np.sqrt(size[own]), v]), words.counts


class Classifier:
    """Weights (WIDTH + 1, domains); the last row is the constant."""

    def __init__(self, domains: list[str], weights: np.ndarray) -> None:
        self.domains, self.weights = domains, weights

    def posteriors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        r, c, v, n_words = vectors(texts)
        return softmax(scores(self.weights, r, c, v, len(texts))), n_words


def scores(w: np.ndarray, r: np.ndarray, c: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(r, w[c, d] * v, minlength=n) for d in range(w.shape[1])], 1) + w[-1]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True, initial=-np.inf))
    return e / e.sum(1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, domains: list[str], steps: int = 120, rate: float = 0.05, decay: float = 1e-4) -> Classifier:
    """``rows``: columns and values of each document; y: place of its domain."""
    k, n = len(domains), len(rows)
    w = np.zeros((WIDTH + 1, k))
    if n and k > 1:
        share = np.bincount(y, minlength=k) / n
        w[-1] = np.log(np.maximum(share, 1e-6))
        r = np.repeat(np.arange(n), [len(c) for c, _ in rows])
        c, v = np.concatenate([c for c, _ in rows]), np.concatenate([v for _, v in rows])
        told = np.eye(k)[y]
        first, second = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, steps + 1):
            error = (softmax(scores(w, r, c, v, n)) - told) / n
            grad = np.stack([np.append(np.bincount(c, error[r, d] * v, minlength=WIDTH), error[:, d].sum()) for d in range(k)], 1)
            grad[:-1] += decay * w[:-1]
            first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
            w = w - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
    return Classifier(domains, w)


def fit(docs: DataFrame, labels: DataFrame, targets: dict[str, float], sample: int = 4000) -> Classifier:
    """A classifier of ``labels`` (doc_id, domain) over the domains of ``targets`` that have a labelled document."""
    docs, labels = take(docs, "doc_id", "text"), take(labels, "doc_id", "domain")
    known = labels.where(F.col("domain").isin(list(targets)) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    known = bounded_sample(known, "doc_id", sample)

    def run(batch: pa.RecordBatch):
        for rows, texts in slices(batch):
            r, c, v, _ = vectors(texts)
            order = np.argsort(r, kind="stable")
            bounds = np.searchsorted(r[order], np.arange(len(texts) + 1)).tolist()
            c, v = c[order].astype(np.int32), v[order].astype(np.float32)
            held = [c[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            values = [v[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([rows["doc_id"], rows["domain"], pa.array(held, pa.binary()), pa.array(values, pa.binary())], names=["doc_id", "domain", "columns", "values"])

    joined = docs.join(F.broadcast(known), "doc_id").select(F.col("doc_id").cast("string").alias("doc_id"), "domain", "text")  # ``sample`` rows at most
    found = map_arrow(joined, run, "doc_id string, domain string, columns binary, values binary").toArrow().sort_by([("doc_id", "ascending"), ("columns", "ascending")]).to_pydict()
    domains = [d for d in targets if d in set(found["domain"])] or list(targets)
    rows = [(np.frombuffer(c, np.int32), np.frombuffer(v, np.float32)) for c, v in zip(found["columns"], found["values"], strict=True)]
    return train(rows, np.array([domains.index(d) for d in found["domain"]], np.int64), domains)


def with_posteriors(docs: DataFrame, model: Classifier, rates: Rates | None = None, words: str = "words", posterior: str = "posterior", rate: str = "rate", column: str = "text") -> DataFrame:
    """``docs`` with the words of ``column`` and its posteriors in thousandths (their sum is about 1000), and the rates
    of the posteriors if they are given."""

    def run(batch: pa.RecordBatch):
        for rows, texts in slices(batch, column):
            p, n_words = model.posteriors(texts)
            held = pa.FixedSizeListArray.from_arrays(pa.array(np.round(p * UNIT).astype(np.int32).ravel()), p.shape[1]).cast(pa.list_(pa.int32()))
            more = [] if rates is None else [pa.array(rates(shares(held, p.shape[1])))]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(n_words.astype(np.int64)), held, *more], names=[*rows.schema.names, words, posterior, rate][: len(rows.schema) + 2 + len(more)])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{words}` long", f"`{posterior}` array<int>", *([] if rates is None else [f"`{rate}` double"])])
    return map_arrow(docs, run, fields)


class Rates:
    """Rates as a function of the posterior: the gradients' steps so far, folded from a rate of one."""

    def __init__(self, steps: list[np.ndarray]) -> None:
        self.steps = steps

    def __call__(self, p: np.ndarray) -> np.ndarray:
        r = np.ones(len(p))
        for g in self.steps:
            r = np.maximum(0.0, r - p @ g)
        return r


def shares(posterior: pa.Array, k: int) -> np.ndarray:
    held = posterior.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, k)
    return held / np.maximum(held.sum(1, keepdims=True), 1)


def solve(cells: DataFrame, targets: np.ndarray, total: float | None = None, steps: int = 100, tolerance: float = 1e-6) -> tuple[Rates, np.ndarray, np.ndarray]:
    """Rates for ``cells`` (posterior, words), the target totals and the totals reached.

    ``total``: tokens of the mixture; without it as many as leave the domain of the greatest weight at its size.
    """
    k = len(targets)
    targets = targets / targets.sum()

    def moments(batch: pa.RecordBatch):
        p, t = shares(batch["posterior"], k), np.asarray(batch["words"]).astype(float)
        yield pa.RecordBatch.from_arrays([pa.array([i * k + j for i in range(k) for j in range(k)]), pa.array(((p * t[:, None]).T @ p).ravel())], names=["at", "value"])

    def totals(rates: Rates):
        def run(batch: pa.RecordBatch):
            p, t = shares(batch["posterior"], k), np.asarray(batch["words"]).astype(float)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array((t * rates(p)) @ p)], names=["at", "value"])

        return run

    def summed(run, n: int) -> np.ndarray:
        out = np.zeros(n)
        for row in map_arrow(cells, run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
            out[row["at"]] = row["value"]
        return out

    second = summed(moments, k * k).reshape(k, k)
    start = second.sum(1)
    if start.sum() <= 0:
        return Rates([]), targets * 0, start
    most = int(targets.argmax())
    goal = targets * (total if total is not None else start[most] / targets[most])
    weight = np.linalg.pinv(second / start.sum() + 1e-9 * np.eye(k)) / start.sum()
    rates, reached = Rates([]), start
    for _ in range(steps):
        gap = reached - goal
        if np.abs(gap).max() <= tolerance * goal.sum():
            break
        rates = Rates([*rates.steps, weight @ gap])
        now = summed(totals(rates), k)
        if np.abs(now - reached).max() <= 0.1 * tolerance * goal.sum():
            reached = now
            break  # the least distance: the targets can't be met with nonnegative rates
        reached = now
    return rates, goal, reached


def with_rates(rows: DataFrame, rates: Rates, k: int, name: str = "rate", posterior: str = "posterior") -> DataFrame:
    def run(batch: pa.RecordBatch):
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates(shares(batch[posterior], k)))], names=[*batch.schema.names, name])

    return map_arrow(rows, run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"`{name}` double"]))


def copies(rate, doc_id):
    """A whole number of copies whose mean over documents is the rate: the fraction is rounded by a hash of doc_id."""
    draw = F.pmod(F.xxhash64(doc_id, F.lit("copies")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return F.floor(rate + draw).cast("long")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], sample: int = 4000) -> DataFrame:
    """doc_id, words, domain (the likeliest), posterior, rate and copies of each row of ``docs`` (doc_id, text)."""
    model = fit(docs, labels, targets, sample)
    rows = cut(with_posteriors(take(docs, "doc_id", "text"), model).drop("text"))
    rates, _, _ = _rates(rows, model, targets)
    best = F.element_at(F.array(*[F.lit(d) for d in model.domains]), F.array_position("posterior", F.array_max("posterior")).cast("int"))
    return with_rates(rows, rates, len(model.domains)).select("doc_id", "words", best.alias("domain"), "posterior", "rate", copies(F.col("rate"), F.col("doc_id")).alias("copies"))


def _rates(rows: DataFrame, model: Classifier, targets: dict[str, float]) -> tuple[Rates, np.ndarray, np.ndarray]:
    cells = cut(rows.groupBy("posterior").agg(F.sum("words").alias("words")))
    return solve(cells, np.array([targets[d] for d in model.domains]))


def resample(docs: DataFrame, labels: DataFrame, targets: dict[str, float], sample: int = 4000) -> DataFrame:
    """Each row of ``docs`` as many times as its rate says, with its own columns; the texts aren't shuffled."""
    plain, place, inner = places(docs)
    model = fit(plain.select(F.col(place["doc_id"]).alias("doc_id"), F.col(place["text"]).alias("text")), labels, targets, sample)
    texts = plain.select(F.col(place["text"]).alias("text"))
    rates, _, _ = _rates(cut(with_posteriors(texts, model).drop("text")), model, targets)
    rated = with_posteriors(plain, model, rates, column=place["text"]).withColumn("copies", copies(F.col("rate"), F.col(place["doc_id"])))
    rated = rated.where("copies > 0").withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return rated.select(*[F.col(c).alias(o) for c, o in zip(inner, docs.columns, strict=True)])


def quality_domains(labels: DataFrame) -> DataFrame:
    """doc_id and a domain such as "quality 1, toxic 0" of rows that have both labels."""
    return take(labels, "doc_id", "quality", "toxic").where("quality is not null and toxic is not null").select("doc_id", F.concat(F.lit("quality "), F.col("quality").cast("string"), F.lit(", toxic "), F.col("toxic").cast("string")).alias("domain"))
