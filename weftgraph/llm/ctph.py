"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of seven bytes runs over the text's UTF-8; a chunk ends where the hash's low ``k`` bits are all set,
so that ends depend on nearby bytes only and survive edits elsewhere. The block size 2^k is the least that leaves
at most 64 chunks. The fingerprint holds ``2^k:chunks:chunks``, the second at the double block size; a chunk is two
characters, twelve bits of the CRC-32 of its bytes. Two fingerprints are compared where they share a block size:
their likeness is one less the edit distance over the longer length, in chunks (64 at most, so that one machine
word holds a column of the distance matrix). Without a common block size it is zero.

Defined cases: a null text reads as an empty one, whose fingerprint has no chunks; two empty texts are alike (1),
an empty and another aren't (0); rows of one doc_id follow one another by a hash of their text, rows without doc_id
come last; a single row is its own next one; an empty table gives an empty result; other columns are ignored; a text
of any length is read whole, in memory in proportion to it. Ids that aren't whole numbers count as missing.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.cluster import map_arrow, ship, take

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
SIGNS = [a + b for a in ALPHABET for b in ALPHABET]
SIGN_OF = {s: i for i, s in enumerate(SIGNS)}
MOST, LEAST_K, LAST_K = 64, 2, 33
GAP = bytes(6)
M1 = 0x01000193


class Prints:
    """Fingerprints as arrays: k, and for both block sizes the chunks (rows padded) and how many there are."""

    def __init__(self, k: np.ndarray, signs: tuple[np.ndarray, np.ndarray], sizes: tuple[np.ndarray, np.ndarray]) -> None:
        self.k, self.signs, self.sizes = k, signs, sizes

    def __len__(self) -> int:
        return len(self.k)

    def take(self, at) -> Prints:
        return Prints(self.k[at], tuple(s[at] for s in self.signs), tuple(s[at] for s in self.sizes))

    def text(self) -> list[str]:
        part = lambda j, i: "".join([SIGNS[x] for x in self.signs[j][i, : self.sizes[j][i]].tolist()])
        return [f"{1 << int(k)}:{part(0, i)}:{part(1, i)}" for i, k in enumerate(self.k)]


def parse(texts: list[str]) -> Prints:
    """The arrays of fingerprints given as text."""
    k = np.zeros(len(texts), np.int64)
    signs = tuple(np.zeros((len(texts), MOST), np.int16) for _ in range(2))
    sizes = tuple(np.zeros(len(texts), np.int64) for _ in range(2))
    for i, text in enumerate(texts):
        block, *parts = text.split(":")
        k[i] = int(block).bit_length() - 1
        for j, part in enumerate(parts):
            own = [SIGN_OF[part[a : a + 2]] for a in range(0, len(part), 2)]
            signs[j][i, : len(own)], sizes[j][i] = own, len(own)
    return Prints(k, signs, sizes)


def rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the last seven bytes at every position, uint32."""
    x = np.concatenate([np.zeros(6, np.uint32), data.astype(np.uint32)]) + np.uint32(1)
    m = [np.uint32(pow(M1, j, 1 << 32)) for j in range(7)]
    two = x[1:] + m[1] * x[:-1]
    four = two[2:] + m[2] * two[:-2]
    r = four[3:] + m[4] * (two[1:-4] + m[2] * x[:-6])
    r ^= r >> np.uint32(15)
    r *= np.uint32(0x2C1B3C6D)
    r ^= r >> np.uint32(13)
    return r


def fingerprints(texts: list[bytes]) -> Prints:
    n = len(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    # Gaps of zero bytes keep a text's first windows clear of the text before it.
    held = GAP.join(texts)
    starts = np.concatenate([[0], np.cumsum(sizes + len(GAP))])[:-1].astype(np.int64)
    r = rolling(np.frombuffer(held, np.uint8))
    at = np.flatnonzero((r & np.uint32(3)) == 3)
    own = np.searchsorted(starts, at, "right") - 1
    inside = at < starts[own] + sizes[own]
    at, own = at[inside], own[inside]
    level = np.bitwise_count(r[at] ^ (r[at] + np.uint32(1))).astype(np.int64) - 1
    level[r[at] == np.uint32(0xFFFFFFFF)] = 32
    counts = np.bincount(own * (LAST_K + 1) + level, minlength=n * (LAST_K + 1)).reshape(n, LAST_K + 1)
    counts = counts[:, ::-1].cumsum(1)[:, ::-1]
    k = LEAST_K + (counts[:, LEAST_K:] < MOST).argmax(1)
    out_signs, out_sizes = [], []
    for more in (0, 1):
        chosen = level >= (k + more)[own]
        ends, row = at[chosen] + 1, own[chosen]
        first = np.searchsorted(row, np.arange(n + 1))
        signs, lengths = np.zeros((n, MOST), np.int16), np.zeros(n, np.int64)
        ends, first = ends.tolist(), first.tolist()
        for i, (text, base) in enumerate(zip(texts, starts.tolist(), strict=True)):
            cuts = [0, *(e - base for e in ends[first[i] : first[i + 1]])]
            if cuts[-1] < len(text):
                cuts.append(len(text))
            chunks = [zlib.crc32(text[a:b]) & 4095 for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            signs[i, : len(chunks)], lengths[i] = chunks, len(chunks)
        out_signs.append(signs)
        out_sizes.append(lengths)
    return Prints(k, tuple(out_signs), tuple(out_sizes))


def edit_distance(a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Levenshtein distance of rows a[i, :m[i]] and b[i, :n[i]], m and n up to 64, bit-parallel in 64-bit words."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    one = np.uint64(1)
    plus, minus = np.full(len(a), full), np.zeros(len(a), np.uint64)
    score, last = m.copy(), np.maximum(m - 1, 0).astype(np.uint64)
    held = np.arange(MOST)[None, :] < m[:, None]
    for j in range(int(n.max(initial=0))):
        equal = np.packbits((a == b[:, j : j + 1]) & held, axis=1, bitorder="little").view("<u8").ravel()
        xv = equal | minus
        xh = (((equal & plus) + plus) ^ plus) | equal
        up, down = minus | ~(xh | plus), plus & xh
        now = j < n
        score += np.where(now, ((up >> last) & one).astype(np.int64) - ((down >> last) & one).astype(np.int64), 0)
        up, down = up << one | one, down << one
        plus, minus = down | ~(xv | up), up & xv
    return np.where(m == 0, n, score)


def likeness(a: Prints, b: Prints) -> np.ndarray:
    """Likeness (0 to 1) of a[i] and b[i]."""
    best = np.zeros(len(a))
    for i, j in ((0, 0), (1, 1), (0, 1), (1, 0)):
        at = np.flatnonzero(a.k + i == b.k + j)
        if len(at):
            m, n = a.sizes[i][at], b.sizes[j][at]
            found = 1 - edit_distance(a.signs[i][at], m, b.signs[j][at], n) / np.maximum(np.maximum(m, n), 1)
            best[at] = np.maximum(best[at], found)
    empty = (a.sizes[0] == 0).astype(int) + (b.sizes[0] == 0)
    return np.where(empty == 2, 1.0, np.where(empty == 1, 0.0, best))


def with_fingerprint(docs: DataFrame, name: str = "fingerprint", column: str = "text") -> DataFrame:
    """``docs`` with the fingerprint of ``column``."""

    def run(batch: pa.RecordBatch):
        texts = [(t or "").encode() for t in batch.column(column).to_pylist()]
        for at, to in _parts([len(t) for t in texts]):
            yield pa.RecordBatch.from_arrays([*batch.slice(at, to - at).columns, pa.array(fingerprints(texts[at:to]).text())], names=[*batch.schema.names, name])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{name}` string"])
    return map_arrow(docs, run, fields)


def _parts(sizes: list[int], limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    at = total = 0
    for i, n in enumerate(sizes):
        if i > at and total + n > limit:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def edited(text: str, following: str) -> str:
    """The text with its last third (code points, rounded down) replaced by as much of the start of the next."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    """rows: (doc_id, text), each followed by its next one; the last is only a next one."""
    texts = [t for _, t in rows]
    own = fingerprints([t.encode() for t in texts])
    changed = [edited(a, b).encode() for a, b in zip(texts, texts[1:], strict=False)]
    other = fingerprints(changed)
    base = own.take(slice(0, len(changed)))
    names = base.text()
    columns = [pa.array([i for i, _ in rows[:-1]], kind), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in changed]), pa.array(names), pa.array(other.text()), pa.array(likeness(base, other)), pa.array(likeness(base, own.take(slice(1, None))))]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


class Ranges:
    """Ranges of rows in descending order of a key, by bounds of keys; a key of very many rows has several ranges, by slices
    of a second key in ascending order. ``heavy``: the number of slices by key."""

    def __init__(self, splits: list[int], heavy: dict[int, int]) -> None:
        own = [k for h in heavy for k in (h - 1, h) if k >= NONE]
        self.splits = np.unique(np.array([*splits, *own], np.int64))
        widths = np.ones(len(self.splits) + 1, np.int64)
        for key, n in heavy.items():
            widths[np.searchsorted(self.splits, key, "left")] = n
        self.widths, self.first = widths, np.cumsum(widths[::-1])[::-1] - widths

    def __call__(self, keys: np.ndarray, second: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.splits, keys, "left")
        slice_of = ((second.astype(np.float64) / 2.0**64 + 0.5) * self.widths[at]).astype(np.int64)
        return self.first[at] + np.clip(slice_of, 0, self.widths[at] - 1)


NONE = -(1 << 63)  # the key of rows without doc_id


def _ranges(ids: DataFrame, rows: int, n: int, most: int) -> Ranges:
    """About ``n`` ranges of the ``rows`` of ``ids`` (key); keys of very many rows add ``most`` at most."""
    per_range = max(1, -(-rows // n))
    splits = ids.approxQuantile("key", [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
    heavy = ids.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * per_range).orderBy(F.desc("n")).limit(most)
    return Ranges([int(x) for x in splits], {r["key"]: min(most, -(-r["n"] // per_range)) for r in heavy.collect()})


def neighbours(docs: DataFrame, range_bytes: int = 16 << 20, most: int = 1 << 16) -> DataFrame:
    """RESULT for each row of ``docs`` (doc_id, text): its fingerprint, that of its text edited with the next row's
    (descending doc_id, the first after the last), and their likeness.

    Texts are shuffled once, into ranges of doc_id of about ``range_bytes`` (larger where that would make more than
    ``most`` ranges; a doc_id of very many rows has several). The first row of a range also goes to the range before it,
    where it is the next one of the last row, so that no task has to see another's rows; the driver holds the ranges'
    bounds and first rows only.
    """
    spark, docs = docs.sparkSession, take(docs, "doc_id", "text")
    ship(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.withColumns({"key": F.coalesce(F.col("doc_id").try_cast("long"), F.lit(NONE)), "text": F.coalesce("text", F.lit(""))}).withColumn("h", F.xxhash64("text"))
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).first()
    n = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total["bytes"] or 0) // range_bytes))
    bucket_of = _ranges(docs.select("key"), total["n"], min(n, most, max(1, total["n"])), most)

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[int, int]] = {}
        for batch in batches:
            keys, second = np.asarray(batch["key"]), np.asarray(batch["h"])
            buckets = bucket_of(keys, second)
            order = np.lexsort((second, -1 - keys, buckets))  # ~key: descending without overflow
            first = np.flatnonzero(np.diff(buckets[order], prepend=-1))
            for b, k, h in zip(buckets[order][first].tolist(), keys[order][first].tolist(), second[order][first].tolist(), strict=True):
                best[b] = min(best.get(b, (1 << 63, 0)), (-1 - k, h))
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array([k for k, _ in best.values()], pa.int64()), pa.array([h for _, h in best.values()], pa.int64())], names=["bucket", "key", "h"])

    heads = docs.select("key", "h").mapInArrow(firsts, "bucket long, key long, h long").groupBy("bucket").agg(F.min(F.struct("key", "h")).alias("x")).orderBy("bucket").collect()
    before = {(-1 - r["x"]["key"], r["x"]["h"]): heads[i - 1]["bucket"] for i, r in enumerate(heads)}  # a range's first row: the range before
    head_keys = np.unique(np.array([k for k, _ in before], np.int64))

    def deal(batch: pa.RecordBatch):
        keys, second = np.asarray(batch["key"]), np.asarray(batch["h"])
        # Rows that equal a range's first row in both keys; one of them for each range is enough.
        near = np.flatnonzero(head_keys[np.minimum(np.searchsorted(head_keys, keys), len(head_keys) - 1)] == keys)
        copied = {pair: i for i, pair in zip(near[::-1].tolist(), zip(keys[near[::-1]].tolist(), second[near[::-1]].tolist(), strict=True), strict=True) if pair in before}
        rows = np.concatenate([np.arange(len(keys)), np.array(list(copied.values()), np.int64)])
        bucket = np.concatenate([bucket_of(keys, second), np.array([before[pair] for pair in copied], np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.arange(len(rows)) >= len(keys)), *(batch[c].take(pa.array(rows)) for c in ("key", "h", "doc_id", "text"))], names=["bucket", "copied", "key", "h", "doc_id", "text"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows of one range that wait for the next one
        bucket, size, type_of = None, 0, pa.int64()
        for batch in batches:
            type_of = batch["doc_id"].type
            for b, copied, i, text in zip(*(batch[c].to_pylist() for c in ("bucket", "copied", "doc_id", "text")), strict=True):
                if b != bucket:
                    bucket, held, size = b, [], 0
                if copied and not held:
                    continue  # a later one of the copies
                held.append((i, text))
                size += len(text)
                if copied or size > 2 << 20:
                    if len(held) > 1:
                        yield _compare(held, type_of)
                    held, size = ([], 0) if copied else ([held[-1]], len(text))

    dealt = map_arrow(docs, deal, f"bucket long, copied boolean, key long, h long, doc_id {kind}, text string")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(heads) // 2)
    ordered = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "copied", F.desc("key"), "h", "text")
    return ordered.mapInArrow(walk, RESULT.replace("doc_id long", f"doc_id {kind}"))
