"""Text statistics behind the quality rules."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from weftgraph.llm.words import LEAD, SPACE, Words, codes_of

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """Statistics of each text, as int64 arrays by name.

    ``n_lines`` counts the lines that hold a word. A word counts as repeated when any window of three words
    around it is found at least twice in its text.
    """
    words = Words(texts)
    solid = words.per_doc(LEAD[words.data] & ~SPACE[words.data])
    n_lines, n_dup = _lines(words)
    return {"n_words": words.counts.astype(np.int64), "word_chars": solid, "n_symbols": words.per_doc(SYMBOL[words.data]), "n_dup_lines": n_dup, "n_repeat_words": _repeated(words), "n_lines": n_lines}


def _lines(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those equal to an earlier line of the same text."""
    data, offsets, n = words.data, words.offsets, words.n_docs
    breaks = data == 10
    cuts = np.unique(np.concatenate([offsets, np.flatnonzero(breaks) + 1]))
    starts, ends = cuts[:-1], cuts[1:].copy()
    if not len(starts):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    ends -= breaks[ends - 1]
    holds = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    packed = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=packed[1:])
    lines = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(packed), pa.py_buffer(data[~breaks])])
    codes = np.asarray(lines.dictionary_encode().indices).astype(np.int64)[holds]
    row = (np.searchsorted(offsets, starts, "right") - 1)[holds]
    own = np.bincount(row, minlength=n)
    distinct = np.unique(row * (len(starts) + 1) + codes) // (len(starts) + 1)
    return own.astype(np.int64), (own - np.bincount(distinct, minlength=n)).astype(np.int64)


def _repeated(words: Words) -> np.ndarray:
    """Words inside a window of three words that its text holds twice or more."""
    n = len(words)
    if n < 3:
        return np.zeros(words.n_docs, np.int64)
    codes, known = words.encoded()
    codes = codes.astype(np.int64)
    pairs = codes_of(codes[:-1] * len(known) + codes[1:]).astype(np.int64)
    at = np.flatnonzero(words.doc[2:] == words.doc[:-2])
    triples = codes_of(pairs[at] * len(known) + codes[at + 2]).astype(np.int64)
    keys = codes_of(triples * words.n_docs + words.doc[at])
    again = at[np.bincount(keys, minlength=1)[keys] > 1] if len(at) else at
    inside = np.zeros(n, bool)
    for shift in range(3):
        inside[again + shift] = True
    return np.bincount(words.doc[inside], minlength=words.n_docs).astype(np.int64)
