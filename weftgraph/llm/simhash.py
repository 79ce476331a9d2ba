"""SimHash near-duplicates by segment-popcount embedding.

A fingerprint's 64 bits are cut into 32 segments of two; the counts of set bits, each 0 to 2, embed it in a grid.
Counts of two fingerprints differ in sum (Manhattan distance) by no more than the fingerprints differ in bits, so
that all pairs within three bits lie within three in the grid. Of the grid's two halves of 16 dimensions one then
differs by at most one, so the range join takes, for each half, a fingerprint's own cell and the cells one step up:
an equi-join, from which pairs outside the full grid's range are dropped by the lower bound and the rest verified
on the bits. Equal fingerprints are one node from the start; copies are never paired.

Counts are held in unary (0: 00, 1: 01, 2: 11), in which Manhattan distance is the number of differing bits.

Defined cases: a null, empty or blank text has fingerprint zero and links like any other; a text of one or two
words is one shingle; repeated rows share a fingerprint; rows without doc_id link, but name no component (a
component of only such rows has a null id); an empty table gives an empty result; other columns are ignored; a text
of any length is read whole, in memory in proportion to it.

Two unrelated fingerprints share half a cell by chance once in (8 / 3)^16, 6.5 million, pairs, the cells one step up
count some twelve times that: candidates grow with the square of distinct fingerprints, 1.8e-6 of all pairs, and
each is one comparison of two longs. A billion distinct fingerprints make some 4e12 candidates (both halves)
and 3e10 narrow rows to shuffle.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.cluster import cut, map_arrow, places, take
from weftgraph.llm.components import components
from weftgraph.llm.words import Words, slices

ODD = 0x5555555555555555
HALF = 0xFFFFFFFF
MOST_BITS = 3


def fingerprints(texts: pa.Array, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """uint64 SimHash of each text (large_binary): a bit is set if it is set in over half of the shingles' XXH64."""
    words = Words(texts, lower=True)
    packed, offsets = words.packed()
    n = len(words)
    spaced = np.full(len(packed) + n, 32, np.uint8)
    spaced[np.arange(len(packed)) + np.repeat(np.arange(n), np.diff(offsets))] = packed
    starts, ends = offsets[:-1] + np.arange(n), offsets[1:] + np.arange(n)
    last = np.arange(n) + np.minimum(shingle, words.counts)[words.doc] - 1
    whole = last < words.bounds[1:][words.doc]
    held, hash_of = spaced.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((hash_of(held[a:b], seed) for a, b in zip(starts[whole].tolist(), ends[last[whole]].tolist(), strict=True)), np.uint64, int(whole.sum()))
    per_doc = np.bincount(words.doc[whole], minlength=words.n_docs)
    at = np.concatenate([[0], np.cumsum(per_doc)])[:-1]
    some = np.flatnonzero(per_doc)
    counts = np.zeros((words.n_docs, 64), np.int64)
    if len(some):
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts[some] = np.add.reduceat(bits, at[some], axis=0, dtype=np.int32)
    return np.packbits(2 * counts > per_doc[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def with_fingerprint(docs: DataFrame, name: str = "fp", column: str = "text", shingle: int = 3) -> DataFrame:
    """``docs`` with the fingerprint of ``column`` as a long of the same 64 bits."""

    def run(batch: pa.RecordBatch):
        for rows, texts in slices(batch, column):
            found = fingerprints(texts, shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found)], names=[*rows.schema.names, name])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{name}` long"])
    return map_arrow(docs, run, fields)


def unary(x: Column) -> Column:
    """The segments' counts of set bits, in unary."""
    up = F.shiftrightunsigned(x, 1)
    return x.bitwiseOR(up).bitwiseAND(F.lit(ODD)).bitwiseOR(F.shiftleft(x.bitwiseAND(up).bitwiseAND(F.lit(ODD)), 1))


def _cells(nodes: DataFrame, probe: bool) -> DataFrame:
    """(half, cell, fp) of each node's own cells, or with the cells one step up in one dimension."""
    counts = unary(F.col("fp"))
    out = []
    for half, value in enumerate((counts.bitwiseAND(F.lit(HALF)), F.shiftrightunsigned(counts, 32))):
        rows = nodes.select(F.lit(half).alias("half"), value.alias("cell"), "fp")
        if probe:
            # A count rises from 0 to 1 by its low bit, from 1 to 2 by its high bit; at 2 the cell itself comes back.
            step = lambda j, c=F.col("cell"): c.bitwiseOR(F.when(c.bitwiseAND(F.lit(1 << 2 * j)) == 0, F.lit(1 << 2 * j)).otherwise(F.lit(2 << 2 * j)))
            steps = F.array_distinct(F.array(F.col("cell"), *(step(j) for j in range(16))))
            rows = rows.select("half", F.col("cell").alias("home"), F.explode(steps).alias("cell"), "fp")
        out.append(rows)
    return out[0].unionByName(out[1])


def pairs(nodes: DataFrame) -> DataFrame:
    """(a, b) of all pairs of distinct fingerprints ``nodes`` (fp) that differ in 1 to 3 bits, each pair once."""
    left = _cells(nodes, True).withColumnRenamed("fp", "a")
    right = _cells(nodes, False).withColumnRenamed("fp", "b")
    grid = F.bit_count(unary(F.col("a")).bitwiseXOR(unary(F.col("b"))))
    low_half = F.bit_count(unary(F.col("a")).bitwiseXOR(unary(F.col("b"))).bitwiseAND(F.lit(HALF)))
    found = left.join(right, ["half", "cell"]).where((F.col("a") < F.col("b")) | (F.col("cell") != F.col("home")))
    found = found.where(grid <= MOST_BITS).where((F.col("half") == 0) | (low_half > 1))
    return found.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST_BITS).select("a", "b")


def classes(fps: DataFrame) -> DataFrame:
    """(fp, component_id, head) of every distinct fingerprint of the table ``fps`` (doc_id, fp).

    component_id: the smallest doc_id reachable over links; head: the smallest fingerprint that this doc_id has.
    """
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(pairs(nodes.select("fp"))).withColumnRenamed("node", "fp")
    placed = cut(nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    heads = cut(placed.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "fp")).alias("x")).select("root", F.col("x.first").alias("component_id"), F.col("x.fp").alias("head")))
    return cut(placed.join(heads, "root").select("fp", "component_id", "head"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp (long) and component_id of each row of ``docs`` (doc_id, text)."""
    fps = cut(with_fingerprint(take(docs, "doc_id", "text")).drop("text"))
    return fps.join(classes(fps).drop("head"), "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component: that of the smallest doc_id, and of rows that share it the one of the
    smallest fingerprint and hashes of its text (any one of rows alike in these).

    Texts are fingerprinted once. What goes is decided on narrow rows, and texts meet the list of what goes in one
    join by a shuffle, at every size.
    """
    plain, place, inner = places(docs)
    keys = ["_id", "_h1", "_h2"]
    hashed = plain.withColumns({"_id": F.col(place["doc_id"]), "_h1": F.xxhash64(place["text"]), "_h2": F.hash(place["text"])})
    fps = cut(with_fingerprint(hashed.select(F.col("_id").alias("doc_id"), F.col(place["text"]).alias("text"), "_h1", "_h2")).drop("text"))
    rows = fps.groupBy(F.col("doc_id").alias("_id"), "fp", "_h1", "_h2").agg(F.count(F.lit(1)).alias("_n"))
    heads = classes(fps).where("fp = head").select("component_id", "head")
    first = rows.join(heads, (F.col("fp") == F.col("head")) & F.col("_id").eqNullSafe(F.col("component_id"))).groupBy("_id", "fp").agg(F.min(F.struct("_h1", "_h2", "_n")).alias("_x"))
    winners = cut(first.select("_id", "_x.*"), 16)
    gone = cut(_without(rows.select(keys), winners, keys), 16)
    kept = _without(hashed, gone, keys)
    if winners.where("_n > 1").limit(1).count():
        again = winners.where("_n > 1").select(keys)
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy("_h1"))
        one = _matching(kept, again, keys, "left_semi").withColumn("_nth", nth).where("_nth = 1").drop("_nth")
        kept = _without(kept, again, keys).unionByName(one)
    return kept.select(*[F.col(c).alias(o) for c, o in zip(inner, docs.columns, strict=True)])


def _matching(rows: DataFrame, listed: DataFrame, keys: list[str], how: str) -> DataFrame:
    a, b = rows.alias("_a"), listed.alias("_b").hint("merge")
    same = [F.col(f"_a.{k}").eqNullSafe(F.col(f"_b.{k}")) for k in keys]
    return a.join(b, reduce(and_, same), how)


def _without(rows: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` whose keys aren't listed; nulls are equal."""
    return _matching(rows, listed, keys, "left_anti")
