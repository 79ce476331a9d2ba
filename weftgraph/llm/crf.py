"""Toxicity: a linear-chain conditional random field that tags toxic words.

Two states, clean and toxic; a word's potential in the toxic state is the sum of weights of its features (the word
in lower case without outer punctuation, its prefixes of 2 to 9 characters and its last three characters), beside
four transition potentials. A text is one chain; it is worked on in windows of 64 words at once, whose products of
transfer matrices carry the messages from window to window.

Training needs labelled tokens, and the labels table has labelled documents only. Tokens get theirs from these: a
word of a document labelled toxic is a toxic token if one of its features is at least ``PRECISE`` in favour of
toxic documents; all other words are clean tokens. The chain is first fitted to these tokens by likelihood. It is
then refitted to the documents' own labels, by the likelihood that at least one of a toxic document's words (none
of a clean document's) is toxic, which the same forward-backward sums give. That step corrects tokens the first
labels got wrong. At most ``sample`` labelled documents, those of the smallest hashed doc_id, teach.

A document's score is a logistic function of the logarithm of its expected share of toxic words (the sum of its
marginals over its length), so that it doesn't grow with a text's length. The function's two numbers are fitted to
the sample's documents that taught no words, about a fifth, parted by a hash of the text so that copies stay
together. Offending offsets are the code points of the words whose marginal is one half or more.

Defined cases: a null or empty text has no words and scores zero; rows without label teach nothing; repeated rows
are scored each; without documents of both labels every weight is zero and scores are the share of label 1 (one
half without labels); a score equal to the threshold is predicted toxic; an empty table gives an empty result; other
columns pass through; texts of any length are read whole, in memory in proportion to the text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.cluster import crc_mod, map_arrow, take
from weftgraph.llm.mil import labelled, sigmoid
from weftgraph.llm.words import LEAD, Words, slices

WINDOW = 64
PRECISE = 0.8
KEPT_WORDS = 300_000
BUCKETS = 1 << 20
#: Words that training works on at once.
PART = 200_000
#: One in so many texts, by hash, calibrates scores; toxic and other words that a text counts as having besides its own.
CALIBRATES, TOXIC_MORE, WORDS_MORE = 5, 1e-3, 10


def normal(word: bytes) -> str:
    """Lower case, without outer characters that are neither letters nor digits."""
    text = word.decode("utf-8", "replace").lower()
    at, to = 0, len(text)
    while at < to and not text[at].isalnum():
        at += 1
    while to > at and not text[to - 1].isalnum():
        to -= 1
    return unicodedata.normalize("NFC", text[at:to]) if not text.isascii() else text[at:to]


def features(word: str) -> list[int]:
    """Hashed features: the word, its prefixes and its end."""
    if not word:
        return []
    return [crc32(f.encode()) & (BUCKETS - 1) for f in ("=" + word, *(word[:k] for k in range(2, min(len(word), 9) + 1)), "-" + word[-3:])]


class Chains:
    """Words of some texts laid out as columns of windows: each word's ``step`` and ``column``, and whether it begins a
    text. ``linked`` are the windows that go on with the one before, by their place in the text in ``following``."""

    def __init__(self, counts: np.ndarray) -> None:
        self.n_windows = -(-counts // WINDOW)
        self.bounds = np.concatenate([[0], np.cumsum(self.n_windows)]).astype(np.int64)
        total = int(counts.sum())
        first = np.concatenate([[0], np.cumsum(counts)])[:-1]
        within = np.arange(total) - np.repeat(first, counts)
        self.column = np.repeat(self.bounds[:-1], counts) + within // WINDOW
        self.step = within % WINDOW
        self.first = within == 0
        self.length = np.bincount(self.column, minlength=int(self.bounds[-1]))
        by_size = np.argsort(-self.n_windows, kind="stable")
        starts, sizes = self.bounds[:-1][by_size], self.n_windows[by_size]
        held = np.searchsorted(-sizes, -np.arange(1, int(sizes.max(initial=1))), side="left")
        self.following = [starts[:n] + k for k, n in enumerate(held.tolist(), 1)]
        self.linked = np.concatenate(self.following) if self.following else np.zeros(0, np.int64)
        self.joined = np.unique(np.concatenate([self.linked, self.linked - 1]))

    def grid(self, values: np.ndarray, fill: float) -> np.ndarray:
        out = np.full((min(WINDOW, int(self.length.max(initial=1))), int(self.bounds[-1])), fill)
        out[self.step, self.column] = values
        return out


def seams(e: np.ndarray, chains: Chains, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The forward message into each window and the backward message at its last word.

    A window's potentials make a matrix of two by two, from the state before it to that of its last word; the
    messages pass a whole window at a step.
    """
    n = e.shape[1]
    before, after = np.zeros(n), np.ones(n)
    if not len(chains.linked):
        return before, after
    at = chains.joined
    length, held = chains.length[at], e[:, at]
    clean, toxic = np.zeros((2, len(at))), np.zeros((2, len(at)))  # by the state before the window
    clean[0], toxic[1] = 1.0, 1.0
    for t in range(len(e)):
        inside = length > t
        clean, toxic = np.where(inside, m[0, 0] * clean + m[1, 0] * toxic, clean), np.where(inside, held[t] * (m[0, 1] * clean + m[1, 1] * toxic), toxic)
        if t % 4 == 3:
            scale = 1 / (clean + toxic).max(0)
            clean, toxic = clean * scale, toxic * scale
    place = np.zeros(n, np.int64)
    place[at] = np.arange(len(at))
    for columns in chains.following:
        last, x = place[columns - 1], before[columns - 1]
        before[columns] = (toxic[0, last] + toxic[1, last] * x) / (clean[0, last] + clean[1, last] * x)
    for columns in reversed(chains.following):
        own, x = place[columns], after[columns]
        after[columns - 1] = (clean[1, own] + toxic[1, own] * x) / (clean[0, own] + toxic[0, own] * x)
    return before, after


def beliefs(emission: np.ndarray, chains: Chains, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of the toxic state by word; log chance by window that no word is toxic; expected transitions (2, 2).

    ``emission`` is each word's potential in the toxic state, ``move`` the log potentials of transitions; a text
    starts as if after a clean word. Messages are odds of the two states.
    """
    e = chains.grid(np.exp(np.clip(emission, -30, 30)), 1.0)
    m = np.exp(move)
    steps, n = e.shape
    before, after = seams(e, chains, m)
    backward, clean = np.empty((steps, n)), np.empty((steps, n))
    backward[-1] = after
    for t in range(steps - 2, -1, -1):
        x = e[t + 1] * backward[t + 1]
        backward[t] = np.where(chains.length > t + 1, (m[1, 0] + m[1, 1] * x) / (m[0, 0] + m[0, 1] * x), after)
    forward = np.empty((steps, n))
    for t in range(steps):
        before = e[t] * (m[0, 1] + before * m[1, 1]) / (m[0, 0] + before * m[1, 0])
        forward[t] = before
    inside = np.arange(steps)[:, None] < chains.length[None, :]
    clean = np.where(inside, -np.log1p(m[0, 1] / m[0, 0] * e * backward), 0.0)
    odds = forward * backward
    toxic = np.where(inside, odds / (1 + odds), 0.0)
    # Expected transitions: into each word from its predecessor, the clean start included.
    out_of = np.vstack([np.zeros((1, n)), toxic[:-1]])
    out_of[0, chains.linked] = toxic[-1, chains.linked - 1]
    stay = np.where(inside, m[1, 1] * e * backward / (m[1, 0] + m[1, 1] * e * backward), 0.0)
    both = (out_of * stay)[inside].sum()
    into, outgoing, total = toxic[inside].sum(), out_of[inside].sum(), inside.sum()
    return toxic[chains.step, chains.column], clean.sum(0), np.array([[total - into - outgoing + both, into - both], [outgoing - both, both]])


class Model:
    """``weights`` by hashed feature, the constant of the toxic state, transitions, and the score's two numbers."""

    def __init__(self, weights: np.ndarray, bias: float, move: np.ndarray, rate: float | None = None, scale: tuple[float, float] = (0.0, 1.0)) -> None:
        self.weights, self.bias, self.move, self.rate, self.scale = weights.astype(np.float32), bias, move, rate, scale
        self.known: dict[bytes, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def emissions(self, words: list[bytes]) -> np.ndarray:
        """The potential of each word in the toxic state."""
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        known = self.known
        out = list(map(known.get, words))
        if new := [i for i, x in enumerate(out) if x is None]:
            lists = [features(normal(words[i])) for i in new]
            sizes = np.array([len(x) for x in lists])
            ids = np.fromiter((f for x in lists for f in x), np.int64, int(sizes.sum()))
            found = self.bias + np.bincount(np.repeat(np.arange(len(lists)), sizes), self.weights[ids], minlength=len(lists))
            for i, x in zip(new, found.tolist(), strict=True):
                out[i] = known[words[i]] = x
        return np.array(out)

    def marginals(self, words: Words) -> np.ndarray:
        """The marginal of the toxic state of each word."""
        codes, known = words.encoded()
        return beliefs(self.emissions(known.to_pylist())[codes], Chains(words.counts), self.move)[0]

    def tag(self, texts: pa.Array) -> tuple[np.ndarray, list[list[dict]]]:
        """Score of each text, and its spans: start, end (code points) and marginal of every toxic word."""
        words = Words(texts)
        spans: list[list[dict]] = [[] for _ in range(words.n_docs)]
        if self.rate is not None or not len(words):
            return np.full(words.n_docs, self.rate or 0.0), spans
        toxic = self.marginals(words)
        scores = np.where(words.counts > 0, sigmoid(self.scale[0] + self.scale[1] * evidence(toxic, words)), 0.0)
        at = np.flatnonzero(toxic >= 0.5)
        if len(at):
            points = np.concatenate([[0], np.cumsum(LEAD[words.data])])
            base = points[words.offsets[:-1]][words.doc[at]]
            for d, a, b, p in zip(words.doc[at].tolist(), (points[words.starts[at]] - base).tolist(), (points[words.ends[at]] - base).tolist(), toxic[at].tolist(), strict=True):
                spans[d].append({"start": a, "end": b, "marginal": p})
        return scores, spans


def evidence(toxic: np.ndarray, words: Words) -> np.ndarray:
    """Logarithm of the expected share of toxic words of each text."""
    return np.log((np.bincount(words.doc, toxic, minlength=words.n_docs) + TOXIC_MORE) / (words.counts + WORDS_MORE))


def logistic(x: np.ndarray, y: np.ndarray, decay: float = 0.01) -> tuple[float, float]:
    """Constant and slope (not negative) of a logistic function, by Newton's steps."""
    rows, w = np.stack([np.ones(len(x)), x], 1), np.zeros(2)
    for _ in range(50):
        p = sigmoid(rows @ w)
        w = w + np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + decay * np.eye(2), rows.T @ (y - p) - decay * w)
    return (float(w[0]), float(w[1])) if w[1] >= 0 else (float(np.log(y.mean() / (1 - y.mean()))), 0.0)


def train(rows: Iterable[tuple[str, float]], **how) -> Model:
    """A model from whole texts and their labels, by ``learn``, with calibrated scores.

    If the texts that are held back, or those that aren't, lack a label, all texts do both.
    """
    rows = list(rows)
    held = np.array([crc32(text.encode()) % CALIBRATES == 0 for text, _ in rows], bool)
    y = np.array([label for _, label in rows], float)
    if any(not len(part) or part.min() == part.max() for part in (y[held], y[~held])):
        held[:] = False
    model = learn((row for row, out in zip(rows, held, strict=True) if not out), **how)
    if model.rate is None:
        own = np.flatnonzero(held if held.any() else ~held)
        found = []
        for at in range(0, len(own), 256):
            words = Words(pa.array([rows[i][0].encode() for i in own[at : at + 256]], pa.large_binary()))
            found.append(evidence(model.marginals(words) if len(words) else np.zeros(0), words))
        model.scale = logistic(np.concatenate(found), y[own])
    return model


def learn(rows: Iterable[tuple[str, float]], rounds: int = 25, refits: int = 40, rate: float = 0.3, decay: float = 2e-4, rare: int = 4) -> Model:
    """Weights and transitions from whole texts and their labels. Features of fewer than ``rare`` texts are left out.

    Texts are kept as numbers of their distinct words; arrays by token exist for ``PART`` words at a time.
    """
    forms: dict[str, int] = {}
    form_of: dict[bytes, int] = {}
    tokens, counts, y = [], [], []
    for text, label in rows:
        words = Words(pa.array([text.encode()], pa.large_binary()))
        y.append(label)
        counts.append(len(words))
        if len(words):
            codes, known = words.encoded()
            own = []
            for word in known.to_pylist():
                if (at := form_of.get(word)) is None:
                    at = form_of[word] = forms.setdefault(normal(word), len(forms))
                own.append(at)
            tokens.append(np.array(own, np.int32)[codes])
    labels_of, counts = np.array(y, float), np.array(counts, np.int64)
    if not len(labels_of) or labels_of.min() == labels_of.max() or not tokens:
        return Model(np.zeros(1), 0.0, np.zeros((2, 2)), float(labels_of.mean()) if len(labels_of) else 0.5)
    form_of.clear()
    lists = [np.array(features(form), np.int32) for form in forms]
    forms.clear()
    sizes = np.array([len(x) for x in lists], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    ids, owner = np.concatenate(lists), np.repeat(np.arange(len(lists)), sizes)
    n_forms, n_docs = len(lists), len(labels_of)
    del lists
    # Texts that hold a feature, by label.
    df, toxic_df = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for label, own in zip(labels_of[counts > 0], tokens, strict=True):
        form = np.unique(own)
        held = np.unique(ids[np.repeat(starts[form] - np.concatenate([[0], np.cumsum(sizes[form])[:-1]]), sizes[form]) + np.arange(sizes[form].sum())])
        df[held] += 1
        toxic_df[held] += label > 0
    kept = df >= rare
    precise = kept & (toxic_df >= rare) & (toxic_df / np.maximum(df, 1) >= PRECISE)
    marked = np.bincount(owner, precise[ids], minlength=n_forms) > 0
    useful = kept[ids]
    ids, owner = ids[useful], owner[useful]

    # Parts of whole texts with about PART words each.
    filled = np.flatnonzero(counts)
    cuts = np.searchsorted(np.cumsum(counts[filled]), np.arange(PART, counts.sum() + PART, PART))
    parts = []
    for first, last in zip([0, *(c + 1 for c in cuts)], [c + 1 for c in cuts], strict=False):
        docs = filled[first:last]
        if len(docs):
            own = np.concatenate(tokens[first:last])
            chains = Chains(counts[docs])
            doc = np.repeat(docs, counts[docs])
            told = marked[own] & (labels_of[doc] > 0)
            parts.append((docs, own, doc, chains, told))
    tokens.clear()
    theta, move, bias = np.zeros(BUCKETS), np.array([[0.0, 0.0], [0.0, 0.5]]), -4.0
    first, second = np.zeros(BUCKETS + 5), np.zeros(BUCKETS + 5)
    for turn in range(rounds + refits):
        by_form = np.bincount(owner, theta[ids], minlength=n_forms) + bias
        error_of, moved, total = np.zeros(n_forms), np.zeros((2, 2)), 0.0
        for docs, own, doc, chains, told in parts:
            toxic, clean, transitions = beliefs(by_form[own], chains, move)
            if turn < rounds:  # log likelihood of the labelled tokens
                label = told.astype(float)
                error = label - toxic
                before = np.where(chains.first, 0.0, np.concatenate([[0.0], label[:-1]]))
                moved += np.array([[((1 - before) * (1 - label)).sum(), ((1 - before) * label).sum()], [(before * (1 - label)).sum(), (before * label).sum()]]) - transitions
            else:  # log likelihood of the documents' labels
                none = np.add.reduceat(clean, chains.bounds[:-1])
                weight = np.where(labels_of[docs] > 0, np.exp(none) / np.maximum(-np.expm1(none), 1e-6), -1.0)
                error = toxic * np.repeat(weight, counts[docs])
            error_of += np.bincount(own, error, minlength=n_forms)
            total += error.sum()
        grad = np.concatenate([np.bincount(ids, error_of[owner], minlength=BUCKETS), [total], moved.ravel()]) / n_docs
        grad[:BUCKETS] -= decay * theta
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        change = rate * (first / (1 - 0.9 ** (turn + 1))) / (np.sqrt(second / (1 - 0.99 ** (turn + 1))) + 1e-4)
        theta, bias, move = theta + change[:BUCKETS], bias + change[BUCKETS], move + change[BUCKETS + 1 :].reshape(2, 2)
    return Model(theta, float(bias), move)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = 4000, folds: int = 4, held_out: int = 2) -> Model:
    """A model of ``labels.label`` from rows whose crc32(doc_id) mod ``folds`` isn't ``held_out``."""
    rows = labelled(docs, labels, label, sample, folds, held_out).select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "y")
    found = rows.toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    held = list(zip(found["text"].to_pylist(), map(float, found["y"].to_pylist()), strict=True))
    del found
    return train(held)


def with_tags(docs: DataFrame, model: Model, score: str = "score", spans: str = "spans", column: str = "text") -> DataFrame:
    """``docs`` with the score of ``column`` and its toxic words' spans."""

    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))

    def run(batch: pa.RecordBatch):
        for rows, texts in slices(batch, column):
            scores, found = model.tag(texts)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(scores, pa.float64()), pa.array(found, kind)], names=[*rows.schema.names, score, spans])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{score}` double", f"`{spans}` array<struct<start: bigint, end: bigint, marginal: double>>"])
    return map_arrow(docs, run, fields)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **how) -> DataFrame:
    """doc_id, held_out, score, predicted and spans of each row of ``docs`` (doc_id, text)."""
    folds, held_out = how.get("folds", 4), how.get("held_out", 2)
    tagged = with_tags(take(docs, "doc_id", "text"), fit(docs, labels, **how)).drop("text")
    return tagged.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
