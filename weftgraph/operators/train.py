"""Training of node vectors for link prediction, a superstep at a time, and of a softmax over encoded nodes.

An epoch goes through the states of a schedule (all nodes at once unless partitions are asked for): a state's edges are
those of the buckets it owns, and its negatives come from its resident partitions. A state's edges, in seeded order,
are cut into batches, and a superstep takes ``step_batches`` of them from the same table of vectors. Each batch is one
task's work: its edges and negatives as ids, and the vectors of its distinct nodes once. The task hands on a gradient
for each of them and for each relation; a node's gradients are summed and a sparse Adagrad step follows. The new table
is written before the next superstep, so that the plan doesn't grow and lost executors cost one superstep at most.

A table of ``HELD_BYTES`` at most isn't joined but goes to every task as one matrix, and the driver holds and steps it:
edges are packed into a row for each batch (``packed_in_order``), tasks sum the gradients of all their batches and draw
the same negatives themselves, and a superstep moves one matrix for each task. Where these are large, other tasks sum
them by blocks of nodes, and the driver gets one matrix.

Relations (two vectors each with inverse edges) are parameters of the decoder, as many as the graph has kinds of
edges; the driver holds them, ``RELATION_BYTES`` at most, and steps them by the dense optimizer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import gradients as G
from weftgraph.functions import ranking
from weftgraph.functions.hashing import digest_numbers, pick, uniform
from weftgraph.functions.optim import SGD, Adagrad, Adam, generator_reward
from weftgraph.functions.vectors import dimension, sum_vectors
from weftgraph.operators import partition as P
from weftgraph.operators import schedule as K
from weftgraph.operators.sampling import batches, shuffle_edges
from weftgraph.sources.shared import cut, release, ship

RELATION_BYTES = 256 << 20
HELD_BYTES = 64 << 20  # of the vectors of all nodes, for training from a matrix in every task
SPAN = 1 << 15  # edges that a task packs together, of a table that isn't very large
DEALT = 1 << 20  # edges that a task cuts into spans at once
SENT_BYTES = 64 << 20  # of the gradients that tasks send to the driver at once
SUMMED_BYTES = 512 << 20  # of those that tasks hand to others, which sum them
BLOCK_BYTES = 1 << 20  # of gradients that are summed together
NODE, RELATION, INVERSE, GENERATOR, LOSS = range(5)
GRADIENTS = "kind int, id long, grad array<double>"


@dataclass
class Settings:
    """What is trained and how; names follow the configuration's."""

    dim: int = 16
    decoder: str = "distmult"
    inverse_edges: bool = False
    loss: str = "softmax_ce"
    reduction: str = "sum"
    margin: float = 0.1
    dense_optimizer: str = "adagrad"
    dense_rate: float = 0.1
    rate: float = 0.1
    epochs: int = 2
    batch: int = 1000
    step_batches: int = 0  # batches of a superstep; none: all of a state's
    chunks: int = 1
    negatives: int = 100
    degree_fraction: float = 0.0
    local_filter: str = "deg"
    method: str = "rns"
    selected_ratio: float = 1.0
    tournament: bool = False
    parts: int = 1
    capacity: int = 1
    ordering: str = "COMET"
    ratio: int = 1
    pinned: int = 0
    seed: int = 0
    scale: float = 0.5


@dataclass
class State:
    """Node table (id, emb, state, and emb_g, state_g for a generator), relations by kind, the dense optimizer, and the
    mean loss of each epoch."""

    table: DataFrame
    relations: dict[str, np.ndarray]
    optimizer: object
    losses: list[float] = field(default_factory=list)


def initial_vectors(spark: SparkSession, n_nodes: int, dim: int, scale: float = 0.5, seed: str = "init") -> DataFrame:
    """id, emb, state: seeded uniform components in [-scale, scale) and Adagrad sums of zero."""
    place = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (uniform(seed, F.col("id"), i) * 2 - 1) * scale)
    return spark.range(n_nodes).select("id", place.alias("emb"), F.array_repeat(F.lit(0.0), dim).alias("state"))


def initial_relations(decoder: str, n: int, dim: int, inverse: bool) -> dict[str, np.ndarray]:
    """Relation vectors with which a decoder starts: ones, the complex one, or zeros for a translation."""
    if 16 * n * dim > RELATION_BYTES:
        raise ValueError(f"{n} relations of {dim} components are more than the driver holds")
    start = np.zeros((n, dim)) if decoder == "transe" else np.ones((n, dim))
    if decoder == "complex":
        start[:, dim // 2 :] = 0
    return {"relations": start} | ({"inverse_relations": start.copy()} if inverse else {})


def sparse_adagrad(table: DataFrame, gradients: DataFrame, rate: float = 0.1, eps: float = 1e-10, emb: str = "emb", state: str = "state") -> DataFrame:
    """``table`` after s += g^2, x -= rate g / (sqrt(s) + eps) of rows that have a gradient (id, grad)."""
    rows = table.join(gradients, "id", "left")
    new = F.when(F.col("grad").isNull(), F.col(state)).otherwise(F.zip_with(state, "grad", lambda s, g: s + g * g))
    rows = rows.withColumn(state, new)
    step = F.zip_with(state, "grad", lambda s, g: -rate * g / (F.sqrt(s) + eps))
    moved = F.when(F.col("grad").isNull(), F.col(emb)).otherwise(F.zip_with(emb, step, lambda x, d: x + d))
    return rows.select(*[moved.alias(emb) if c == emb else F.col(c) for c in table.columns])


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    held = column.combine_chunks()
    held = held if isinstance(held, pa.ListArray) else pa.concat_arrays(held.chunks) if isinstance(held, pa.ChunkedArray) else held
    return held.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def batch_gradients(settings: Settings, relations: dict[str, np.ndarray], edges: dict[str, np.ndarray], drawn: dict[str, np.ndarray], ids: np.ndarray, vectors: np.ndarray, generators: np.ndarray | None, rng: np.random.Generator) -> tuple[float, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Loss of a batch and its gradients by kind: ids and rows.

    ``edges``: src, rel, dst in order; ``drawn``: side, chunk, slot, node; ``vectors`` of the sorted ``ids``.
    """
    s = settings
    at = {k: np.searchsorted(ids, edges[k]) for k in ("src", "dst")}
    total, nodes, gens = 0.0, [], []
    rels = {k: [] for k in relations}
    size = -(-len(edges["src"]) // s.chunks)
    weighted = int(s.negatives * s.degree_fraction)
    sides = [("src", "dst", "relations")] + ([("dst", "src", "inverse_relations")] if s.inverse_edges else [])
    for number, (kept, replaced, kind) in enumerate(sides):
        for chunk in range(s.chunks):
            own = np.arange(chunk * size, min((chunk + 1) * size, len(edges["src"])))
            if not len(own):
                continue
            mine = (drawn["side"] == number) & (drawn["chunk"] == chunk)
            rows = rng.integers(0, len(edges["src"]), weighted)  # edges whose ends are negatives by degree
            nodes_of = np.concatenate([edges[replaced][rows], drawn["node"][mine][np.argsort(drawn["slot"][mine])]])
            places = np.searchsorted(ids, nodes_of)
            masked = None
            if s.local_filter == "all":  # negatives that make an edge of the batch
                keys = np.stack([edges[kept], edges["rel"]], 1)
                _, group = np.unique(keys, axis=0, return_inverse=True)
                facts = np.unique(group.astype(np.int64) * (len(ids) + 1) + at[replaced])
                masked = np.isin(group[own][:, None].astype(np.int64) * (len(ids) + 1) + places[None, :], facts)
            elif weighted:  # negatives that were drawn from the very edge
                masked = np.zeros((len(own), len(places)), bool)
                masked[:, :weighted] = own[:, None] == rows[None, :]
            a, b, n = vectors[at[kept][own]], vectors[at[replaced][own]], vectors[places]
            r = relations[kind][edges["rel"][own]]
            chosen = None
            k = int(len(places) * s.selected_ratio)
            if s.method != "rns" and 0 < k < len(places):
                if s.method == "dns":
                    scores = G.compare_all(s.decoder, G.operate(s.decoder, a, r), n)
                else:
                    scores = G.compare_all(s.decoder, generators[at[kept][own]], generators[places])
                chosen = G.select(-scores if s.decoder == "transe" else scores, k, s.tournament)
            loss, da, dr, db, dn = G.side(s.decoder, s.loss, a, r, b, n, s.reduction, s.margin, chosen, masked)
            if s.reduction == "mean":  # of the batch, not of a chunk
                share = len(own) / len(edges["src"])
                loss, da, dr, db, dn = (x * share for x in (loss, da, dr, db, dn))
            total += loss
            nodes += [(at[kept][own], da), (at[replaced][own], db), (places, dn)]
            rels[kind].append((edges["rel"][own], dr))
            if s.method == "gan":
                reward = generator_reward(G.compare_all(s.decoder, G.operate(s.decoder, a, r), n))
                _, ga, gn = G.generator(s.decoder, generators[at[kept][own]], generators[places], reward)
                gens += [(at[kept][own], ga), (places, gn)]
    out = {NODE: (ids, G.sum_rows(*vectors.shape, nodes))}
    for code, kind in ((RELATION, "relations"), (INVERSE, "inverse_relations")):
        if kind in rels:
            used = np.unique(edges["rel"])
            out[code] = (used, G.sum_rows(*relations[kind].shape, rels[kind])[used])
    if generators is not None:
        out[GENERATOR] = (ids, G.sum_rows(*generators.shape, gens))
    return total, out


@dataclass
class Held:
    """A small node table as matrices, in order of its ids."""

    ids: np.ndarray
    columns: dict[str, np.ndarray]

    def table(self, spark: SparkSession) -> DataFrame:
        """The table, written."""
        lists = {c: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel())) for c, m in self.columns.items()}
        kinds = ", ".join(["id long", *(f"{c} array<double>" for c in self.columns)])
        return cut(spark.createDataFrame(pa.table({"id": self.ids} | lists), kinds))

    def step(self, gradient: np.ndarray, touched: np.ndarray, rate: float, emb: str = "emb", state: str = "state", eps: float = 1e-10) -> None:
        """``sparse_adagrad`` of the rows that have a gradient."""
        g = gradient[touched]
        self.columns[state][touched] += g * g
        self.columns[emb][touched] -= rate * g / (np.sqrt(self.columns[state][touched]) + eps)


def hold(settings: Settings, table: DataFrame, n_nodes: int | None = None) -> Held | None:
    """``table`` as matrices if its vectors take ``HELD_BYTES`` at most."""
    n = table.count() if n_nodes is None else n_nodes
    if not n or 8 * n * settings.dim * (2 if settings.method == "gan" else 1) > HELD_BYTES:
        return None
    found = table.toArrow().sort_by([("id", "ascending")])
    return Held(found["id"].to_numpy(), {c: _matrix(found[c], found.num_rows).copy() for c in table.columns if c != "id"})


PACKED = "batch long, src array<long>, rel array<long>, dst array<long>, side array<long>, chunk array<long>, slot array<long>, node array<long>"
PACKED_ARROW = pa.schema([("batch", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("src", "rel", "dst", "side", "chunk", "slot", "node"))])


def packed(edges: DataFrame, drawn: DataFrame | None = None) -> DataFrame:
    """A row for each batch: its edges (batch, row, src, rel, dst) in order, and its negatives (batch, side, chunk, slot,
    node) if they are drawn."""
    ship(edges.sparkSession)
    number = lambda *names: [F.col(c).cast("long").alias(c) for c in names]
    rows = edges.select(*number("batch", "row", "src", "rel", "dst"))
    if drawn is not None:
        rows = rows.unionByName(drawn.select(*number("batch", "side", "chunk", "slot", "node")), allowMissingColumns=True)
        of_draw = ["side", "chunk", "slot", "node"]
    else:
        of_draw = []
    dealt = rows.repartition("batch").sortWithinPartitions("batch", F.col("row").asc_nulls_last())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[pa.Table]) -> pa.RecordBatch:
            table = pa.concat_tables(held)
            is_edge = table["row"].is_valid()
            n = pa.compute.sum(is_edge).as_py() or 0
            out = [table["batch"].combine_chunks()[:1]]
            for c in ("src", "rel", "dst", "side", "chunk", "slot", "node"):
                if c in ("src", "rel", "dst"):
                    values = table[c].slice(0, n)
                else:
                    values = table[c].slice(n) if c in of_draw else pa.chunked_array([pa.array([], pa.int64())])
                values = pa.concat_arrays(values.chunks) if values.num_chunks else pa.array([], pa.int64())
                out.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
            return pa.RecordBatch.from_arrays(out, schema=PACKED_ARROW)

        held, now, done = [], None, []
        for whole in batches:
            ids = whole["batch"].to_numpy()
            bounds = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            for first, last in zip(bounds[:-1], bounds[1:], strict=True):
                if first == last:
                    continue
                if held and ids[first] != now:
                    done.append(flush(held))
                    held = []
                now = ids[first]
                held.append(pa.Table.from_batches([whole.slice(first, last - first)]))
            if done:
                yield from done
                done = []
        if held:
            yield flush(held)

    return dealt.mapInArrow(pack, PACKED)


def packed_in_order(edges: DataFrame, n: int, size: int, seed: str, most: int | None = None) -> DataFrame:
    """A row for each batch of ``size`` of the ``n`` edges (edge_id, src, rel, dst) in seeded order, that of
    ``shuffled_positions``: batch, and the src, rel and dst of its edges as the bytes of 32-bit numbers, which the ids of a
    held table always are. ``most``: edges that a task packs together.

    Tasks cut their edges into spans of the order and hand each piece on as one row; who gets a span sorts it and cuts it
    into whole batches. A range of hashes that lies in several spans goes to each of them.
    """
    digits = ranking.HEX + 1
    shift, n_heads = np.uint64(64 - 4 * digits), 1 << 4 * digits
    places = max(most or SPAN, 16 * (n // n_heads))  # enough for few ranges of hashes to lie in two spans
    span = max(1, places // size) * size
    ship(edges.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(n_heads, np.int64)
        for whole in batches:
            heads = digest_numbers(seed, whole["edge_id"].to_numpy())[0] >> shift
            found += np.bincount(heads.astype(np.int64), minlength=n_heads)
        own = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(found[own])], names=["head", "n"])

    sizes = np.zeros(n_heads, np.int64)
    counted = edges.select(F.col("edge_id").cast("long")).mapInArrow(count, "head long, n long").groupBy("head").agg(F.sum("n").alias("n")).toArrow()
    sizes[counted["head"].to_numpy()] = counted["n"].to_numpy()
    before = np.cumsum(sizes) - sizes
    firsts, lasts = before // span, (before + sizes - 1) // span  # spans of each range of hashes
    sent = edges.sparkSession.sparkContext.broadcast((before, firsts, lasts))
    names = ["edge_id", "src", "rel", "dst"]
    kinds = dict(zip(names, ("<i8", "<i4", "<i4", "<i4"), strict=True))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, first_of, last_of = sent.value

        def flush(held: list[list[np.ndarray]]) -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            heads = (digest_numbers(seed, columns[0])[0] >> shift).astype(np.int64)
            times = (last_of - first_of)[heads] + 1
            rows = np.repeat(np.arange(len(heads)), times)
            spans = first_of[heads][rows] + np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
            order = np.argsort(spans, kind="stable")
            rows, spans = rows[order], spans[order]
            bounds = [0, *(np.flatnonzero(np.diff(spans)) + 1).tolist(), len(spans)]
            columns = [c[rows] for c in columns]
            lists = [pa.array([c[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()) for c in columns]
            return pa.RecordBatch.from_arrays([pa.array(spans[bounds[:-1]]), *lists], names=["_span", *names])

        held, n_held = [], 0
        for whole in batches:
            if whole.num_rows:
                held.append([whole[c].to_numpy().astype(kinds[c]) for c in names])
                n_held += whole.num_rows
            if n_held >= DEALT:
                yield flush(held)
                held, n_held = [], 0
        if n_held:
            yield flush(held)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, first_of, last_of = sent.value

        def cut_up(held: list[list[bytes]], now: int) -> pa.RecordBatch:
            ids, *columns = [np.frombuffer(b"".join(c), kinds[name]) for name, c in zip(names, zip(*held, strict=True), strict=True)]
            head, rest = digest_numbers(seed, ids)
            order = np.argsort(head)
            if (np.diff(head[order]) == 0).any():
                order = np.lexsort((ids, rest, head))
            begin = starts[np.searchsorted(last_of, now)]  # of the first range that reaches into the span
            order = order[now * span - begin :][:span]
            cuts = range(0, len(order), size)
            lists = [pa.array([c[order[i : i + size]].tobytes() for i in cuts], pa.binary()) for c in columns]
            return pa.RecordBatch.from_arrays([pa.array([(now * span + i) // size for i in cuts], pa.int64()), *lists], names=["batch", *names[1:]])

        held, now = [], None
        for whole in batches:
            for row in zip(*(whole[c].to_pylist() for c in ("_span", *names)), strict=True):
                if row[0] != now and held:
                    yield cut_up(held, now)
                    held = []
                now = row[0]
                held.append(row[1:])
        if held:
            yield cut_up(held, now)

    pieces = edges.select(*[F.col(c).cast("long").alias(c) for c in names]).mapInArrow(deal, "_span long, " + ", ".join(f"{c} binary" for c in names))
    return pieces.repartition("_span").sortWithinPartitions("_span").mapInArrow(pack, "batch long, src binary, rel binary, dst binary")


def node_draws(settings: Settings, n_nodes: int, resident: tuple[int, ...], seed: str) -> Callable[[int], dict[str, np.ndarray]]:
    """The negatives of a batch, the same as ``draw_negatives`` gives."""
    s = settings
    sides, n = 2 if s.inverse_edges else 1, s.negatives - int(s.negatives * s.degree_fraction)
    size = P.partition_size(n_nodes, max(s.parts, 1))
    own = np.array([p for p in sorted(resident) if p * size < n_nodes], np.int64)
    total = sum(min(size, n_nodes - int(p) * size) for p in own)
    places = [(side, chunk, slot) for side in range(sides) for chunk in range(s.chunks) for slot in range(n)]
    side, chunk, slot = (np.array([p[i] for p in places], np.int64) for i in range(3))

    def draw(batch: int) -> dict[str, np.ndarray]:
        local = np.array([int(hashlib.md5(f"{seed}:{batch}:{a}:{b}:{c}".encode(), usedforsecurity=False).hexdigest()[:8], 16) for a, b, c in places], np.int64) % total
        return {"side": side, "chunk": chunk, "slot": slot, "node": own[local // size] * size + local % size}

    return draw


GRADIENT_ROWS = "kind int, block long, places binary, grad binary"


def gradient_rows(kind: int, block: int, places: np.ndarray, grad: np.ndarray) -> pa.RecordBatch:
    """A row of ``GRADIENT_ROWS``: the gradients of the places of a block."""
    out = [pa.array([kind], pa.int32()), pa.array([block], pa.int64()), pa.array([places.astype("<i8").tobytes()], pa.binary()), pa.array([grad.astype("<f8").tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(out, names=["kind", "block", "places", "grad"])


def held_step(settings: Settings, rows: DataFrame, held: Held, relations: dict[str, np.ndarray], dense_optimizer: object, tag: int = 0, draw: Callable[[int], dict[str, np.ndarray]] | None = None) -> tuple[dict[str, np.ndarray], float]:
    """Steps ``held`` by the batches of ``rows`` (``packed`` or ``packed_in_order``) and returns the relations after it and the sum of losses.

    ``draw``: negatives of a batch; without it those of ``rows``.
    """
    s, context = settings, rows.sparkSession.sparkContext
    with_generator = s.method == "gan"
    sent = context.broadcast((held.ids, held.columns["emb"], held.columns.get("emb_g"), relations))
    ship(rows.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, generators, rels = sent.value
        total, sums, touched, some = 0.0, {}, {}, False
        for whole in batches:
            in_bytes = pa.types.is_binary(whole["src"].type)
            for i in range(whole.num_rows):
                list_of = lambda c: np.frombuffer(whole[c][i].as_py(), "<i4").astype(np.int64) if in_bytes else whole[c].slice(i, 1).flatten().to_numpy(zero_copy_only=False)  # noqa: B023, E731
                edge = {c: list_of(c) for c in ("src", "rel", "dst")}
                if not len(edge["src"]):
                    continue
                batch = whole["batch"][i].as_py()
                negatives = {c: list_of(c) for c in ("side", "chunk", "slot", "node")} if draw is None else draw(batch)
                needed = np.unique(np.concatenate([edge["src"], edge["dst"], negatives["node"]]))
                at = np.searchsorted(ids, needed)
                rng = np.random.default_rng([s.seed, tag, batch])
                loss, found = batch_gradients(s, rels, edge, negatives, needed, vectors[at], generators[at] if with_generator else None, rng)
                total, some = total + loss, True
                for kind, (own, grad) in found.items():
                    if kind not in sums:
                        n = len(ids) if kind in (NODE, GENERATOR) else len(next(iter(rels.values())))
                        sums[kind], touched[kind] = np.zeros((n, grad.shape[1])), np.zeros(n, bool)
                    place = at if kind in (NODE, GENERATOR) else own
                    sums[kind][place] += grad
                    touched[kind][place] = True
        if some:
            sums[LOSS], touched[LOSS] = np.array([[total]]), np.ones(1, bool)
            for kind, grad in sums.items():
                for block in range(0, len(grad), width):
                    own = block + np.flatnonzero(touched[kind][block : block + width])
                    if len(own):
                        yield gradient_rows(kind, block // width, own, grad[own])

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for whole in parts:
            for kind, block, places, grad in zip(*(whole[c].to_pylist() for c in ("kind", "block", "places", "grad")), strict=True):
                own = np.frombuffer(places, "<i8") - block * width
                values = np.frombuffer(grad, "<f8").reshape(len(own), -1)
                if (kind, block) not in sums:
                    sums[kind, block] = np.zeros((width, values.shape[1])), np.zeros(width, bool)
                total, touched = sums[kind, block]
                total[own] += values
                touched[own] = True
        for (kind, block), (total, touched) in sums.items():
            own = np.flatnonzero(touched)
            yield gradient_rows(kind, block, own + block * width, total[own])

    size, cores = held.columns["emb"].nbytes * (2 if with_generator else 1), context.defaultParallelism
    width = max(1, BLOCK_BYTES // (8 * s.dim))
    if (most := max(1, SENT_BYTES // size)) >= 4 * cores:
        found = rows.coalesce(most).mapInArrow(work, GRADIENT_ROWS)
    else:  # tasks enough for all cores send more than the driver should take
        found = rows.coalesce(max(2 * cores, SUMMED_BYTES // size)).mapInArrow(work, GRADIENT_ROWS)
        found = found.repartition(cores, "kind", "block").mapInArrow(add, GRADIENT_ROWS)
    parts = found.collect()
    sums = {k: np.zeros_like(held.columns[c]) for k, c in ((NODE, "emb"), (GENERATOR, "emb_g")) if c in held.columns}
    sums |= {k: np.zeros_like(relations[c]) for k, c in ((RELATION, "relations"), (INVERSE, "inverse_relations")) if c in relations}
    sums[LOSS] = np.zeros((1, 1))
    touched = {k: np.zeros(len(v), bool) for k, v in sums.items()}
    for part in parts:
        own = np.frombuffer(part["places"], "<i8")
        sums[part["kind"]][own] += np.frombuffer(part["grad"], "<f8").reshape(len(own), -1)
        touched[part["kind"]][own] = True
    sent.destroy()
    relations = dict(relations)
    if s.decoder != "dot":
        dense_optimizer.step(relations, {c: sums[k] for k, c in ((RELATION, "relations"), (INVERSE, "inverse_relations")) if c in relations})
    held.step(sums[NODE], touched[NODE], s.rate)
    if with_generator:
        held.step(sums[GENERATOR], touched[GENERATOR], s.rate, "emb_g", "state_g")
    return relations, float(sums[LOSS][0, 0])


def superstep(settings: Settings, edges: DataFrame, drawn: DataFrame, state: State, tag: int = 0) -> tuple[State, float]:
    """The state after one superstep over ``edges`` (batch, row, src, rel, dst) and negatives (batch, side, chunk, slot,
    node), and the sum of losses."""
    spark = edges.sparkSession
    if held := hold(settings, state.table):
        relations, loss = held_step(settings, packed(edges, drawn), held, state.relations, state.optimizer, tag)
        new = held.table(spark)
        release(state.table)
        return State(new, relations, state.optimizer, state.losses), loss
    ship(spark)
    table, relations, s = state.table, state.relations, settings
    with_generator = s.method == "gan"
    narrow = edges.select("batch", "row", "src", "rel", "dst", *[F.lit(None).cast("int").alias(c) for c in ("side", "chunk", "slot")])
    narrow = narrow.unionByName(drawn.select("batch", "side", "chunk", "slot", F.col("node").alias("src")), allowMissingColumns=True)
    needed = edges.select(F.col("batch").alias("own"), F.explode(F.array("src", "dst")).alias("id")).union(drawn.select("batch", "node")).distinct()
    held = needed.join(table.select("id", "emb", *(["emb_g"] if with_generator else [])), "id")

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"kind": pa.array([], pa.int32()), "id": pa.array([], pa.int64()), "grad": pa.array([], pa.list_(pa.float64()))})
        if not left.num_rows or not right.num_rows:
            return empty
        left = left.sort_by([("row", "ascending")])
        is_edge = np.asarray(left["row"].is_valid())
        column = lambda name: left[name].combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        edge = {k: column(k)[is_edge] for k in ("src", "rel", "dst")}
        if not is_edge.any():
            return empty
        negatives = {"node": column("src")[~is_edge]} | {k: column(k)[~is_edge] for k in ("side", "chunk", "slot")}
        right = right.sort_by([("id", "ascending")])
        ids = right["id"].to_numpy()
        generators = _matrix(right["emb_g"], len(ids)) if with_generator else None
        rng = np.random.default_rng([s.seed, tag, int(left["batch"][0].as_py())])
        loss, found = batch_gradients(s, relations, edge, negatives, ids, _matrix(right["emb"], len(ids)), generators, rng)
        found[LOSS] = (np.zeros(1, np.int64), np.array([[loss]]))
        parts = [pa.table({"kind": pa.array(np.full(len(i), kind, np.int32)), "id": pa.array(i.astype(np.int64)), "grad": pa.ListArray.from_arrays(pa.array(np.arange(len(i) + 1, dtype=np.int32) * g.shape[1]), pa.array(g.ravel()))}) for kind, (i, g) in found.items()]
        return pa.concat_tables(parts)

    found = cut(narrow.groupBy("batch").cogroup(held.groupBy("own")).applyInArrow(work, GRADIENTS))
    summed = lambda kind, dim: found.where(F.col("kind") == kind).groupBy("id").agg(sum_vectors("grad", dim).alias("grad"))
    dense = {k: np.zeros_like(v) for k, v in relations.items()}
    for kind, name in ((RELATION, "relations"), (INVERSE, "inverse_relations")):
        if name in dense:
            for row in summed(kind, s.dim).collect():  # a row for each relation
                dense[name][row["id"]] = row["grad"]
    relations = dict(relations)
    if s.decoder != "dot":
        state.optimizer.step(relations, dense)
    new = sparse_adagrad(table, summed(NODE, s.dim), s.rate)
    if with_generator:
        new = sparse_adagrad(new, summed(GENERATOR, s.dim), s.rate, emb="emb_g", state="state_g")
    new = cut(new)
    loss = found.where(F.col("kind") == LOSS).agg(F.sum(F.col("grad")[0])).first()[0] or 0.0
    release(found, table)
    return State(new, relations, state.optimizer, state.losses), loss


def optimizer(kind: str, rate: float):
    return {"sgd": SGD, "adagrad": Adagrad, "adam": Adam}[kind](rate)


def start(spark: SparkSession, settings: Settings, n_nodes: int, n_relations: int) -> State:
    """The state before the first epoch."""
    s = settings
    table = initial_vectors(spark, n_nodes, s.dim, s.scale, f"init{s.seed}")
    if s.method == "gan":
        other = initial_vectors(spark, n_nodes, s.dim, s.scale, f"generator{s.seed}")
        table = table.join(other.select("id", F.col("emb").alias("emb_g"), F.col("state").alias("state_g")), "id")
    return State(cut(table), initial_relations(s.decoder, n_relations, s.dim, s.inverse_edges), optimizer(s.dense_optimizer, s.dense_rate))


def states_of(settings: Settings) -> list[tuple[int, ...]]:
    """The resident partitions of each state of an epoch."""
    s = settings
    if s.parts <= 1:
        return [(0,)]
    if s.capacity >= s.parts:
        return [tuple(range(s.parts))]
    return K.order_buckets(s.ordering, s.parts, s.capacity, s.ratio, s.pinned, s.seed)


def resident_node(n_nodes: int, parts: int, resident: tuple[int, ...], *draw: Column | str) -> Column:
    """A seeded node of the resident partitions, all with the same chance."""
    size = P.partition_size(n_nodes, parts)
    own = [p for p in sorted(resident) if p * size < n_nodes]  # a short partition is the last of all
    total = sum(min(size, n_nodes - p * size) for p in own)
    local = pick(total, *draw)
    return F.element_at(F.array(*[F.lit(p) for p in own]), (F.floor(local / size) + 1).cast("int")).cast("long") * size + F.pmod(local, F.lit(size))


def draw_negatives(spark: SparkSession, settings: Settings, n_nodes: int, resident: tuple[int, ...], begin: int, end: int, seed: str) -> DataFrame:
    """batch, side, chunk, slot, node: the uniform negatives of batches ``begin`` to ``end``; a batch draws those by degree
    from its own edges."""
    s = settings
    sides, n = 2 if s.inverse_edges else 1, s.negatives - int(s.negatives * s.degree_fraction)
    each = sides * s.chunks * n
    every = spark.range(begin * each, end * each)
    digit = lambda over, k: F.pmod(F.floor(F.col("id") / max(over, 1)), F.lit(max(k, 1))).cast("int")
    rows = every.select(F.floor(F.col("id") / max(each, 1)).cast("long").alias("batch"), digit(s.chunks * n, sides).alias("side"), digit(n, s.chunks).alias("chunk"), digit(1, n).alias("slot"))
    return rows.withColumn("node", resident_node(n_nodes, max(s.parts, 1), resident, seed, F.col("batch"), F.col("side"), F.col("chunk"), F.col("slot")))


def train(edges: DataFrame, n_nodes: int, settings: Settings, n_relations: int | None = None, state: State | None = None, first: int = 0, after_epoch: Callable[[int, State], None] | None = None) -> State:
    """The state after ``settings.epochs`` epochs from ``first`` on over ``edges`` (edge_id, src, rel, dst)."""
    s, spark = settings, edges.sparkSession
    if n_relations is None:
        n_relations = (edges.agg(F.max("rel")).first()[0] or 0) + 1
    state = state or start(spark, s, n_nodes, n_relations)
    schedule = states_of(s)
    bucketed = P.with_buckets(edges.select("edge_id", "src", "rel", "dst"), n_nodes, max(s.parts, 1))
    owned = F.broadcast(P.assign_buckets(P.states_table(spark, schedule)))  # parts squared rows
    placed = cut(bucketed.join(owned, ["src_part", "dst_part"]).select("edge_id", "src", "rel", "dst", F.col("state").alias("at")), by=("at",))
    counts = {r["at"]: r["n"] for r in placed.groupBy("at").agg(F.count(F.lit(1)).alias("n")).collect()}
    state, held = State(state.table, state.relations, state.optimizer, state.losses), hold(s, state.table, n_nodes)
    for epoch in range(first, s.epochs):
        total = 0.0
        for number, resident in enumerate(schedule):
            if not counts.get(number):
                continue
            n_batches = -(-counts[number] // s.batch)
            per_step = s.step_batches or n_batches
            own, order = placed.where(F.col("at") == number).drop("at"), f"epoch{s.seed}:{epoch}"
            seed, tag = f"train{s.seed}:{epoch}:{number}", epoch * len(schedule) + number
            if held:
                spread = -(-min(per_step, n_batches) // (2 * spark.sparkContext.defaultParallelism))  # batches of a superstep's tasks
                own = packed_in_order(own, counts[number], s.batch, order, min(SPAN, spread * s.batch))
                own = cut(own.withColumn("step", F.floor(F.col("batch") / per_step).cast("int")), by=("step",)) if per_step < n_batches else own
                draw = node_draws(s, n_nodes, resident, seed)
                for step in range(-(-n_batches // per_step)):
                    mine = own.where(F.col("step") == step) if per_step < n_batches else own
                    state.relations, loss = held_step(s, mine, held, state.relations, state.optimizer, tag, draw)
                    total += loss
                release(own)
                continue
            own = batches(shuffle_edges(own, order), s.batch)
            own = cut(own) if per_step < n_batches else own
            for begin in range(0, n_batches, per_step):
                end = min(begin + per_step, n_batches)
                drawn = draw_negatives(spark, s, n_nodes, resident, begin, end, seed)
                mine = own.where((F.col("batch") >= begin) & (F.col("batch") < end))
                state, loss = superstep(s, mine, drawn, state, tag)
                total += loss
            release(own)
        state.losses.append(total / max(sum(counts.values()), 1))
        if held and (after_epoch or epoch == s.epochs - 1):
            release(state.table)
            state = State(held.table(spark), state.relations, state.optimizer, state.losses)
        if after_epoch:
            after_epoch(epoch, state)
    release(placed)
    return state


def step_over(edges: DataFrame, settings: Settings, state: State, seed: str = "shuffle") -> tuple[State, float]:
    """The state after one superstep over all ``edges`` (edge_id, src, rel, dst; read twice) in seeded order, without drawn
    negatives, and the sum of losses."""
    s, spark = settings, edges.sparkSession
    if not (held := hold(s, state.table)):
        none = draw_negatives(spark, s, 1, (0,), 0, 0, seed)
        return superstep(s, batches(shuffle_edges(edges, seed), s.batch), none, state)
    first, last = (int(held.ids[i]) for i in (0, -1))
    edges = edges.where(F.col("src").between(first, last) & F.col("dst").between(first, last))  # others have no vectors
    if last - first >= len(held.ids):
        known = F.broadcast(spark.createDataFrame(pa.table({"_known": held.ids}), "_known long"))
        edges = edges.join(known, F.col("src") == F.col("_known"), "left_semi").join(known, F.col("dst") == F.col("_known"), "left_semi")
    rows = packed_in_order(edges, edges.count(), s.batch, seed)
    none = {c: np.zeros(0, np.int64) for c in ("side", "chunk", "slot", "node")}
    relations, loss = held_step(s, rows, held, state.relations, state.optimizer, draw=lambda batch: none)
    release(state.table)
    return State(held.table(spark), relations, state.optimizer, state.losses), loss


def relation_table(spark: SparkSession, vectors: np.ndarray) -> DataFrame:
    """rel and vec of each relation."""
    return spark.createDataFrame(pd.DataFrame({"rel": np.arange(len(vectors), dtype=np.int32), "vec": [v.tolist() for v in vectors]}), "rel int, vec array<double>")


def train_classifier(rows: DataFrame, n_classes: int, epochs: int = 30, optimizer=None) -> tuple[np.ndarray, list[float]]:
    """Weights (dim + 1, classes) of a softmax over encoded nodes (id, vec, label; labels under 0 are left out), and the
    mean loss of each epoch.

    Every task hands on one gradient for all its rows; the driver sums matrices, as many as there are tasks.
    """
    rows = cut(rows.where("label >= 0").select("vec", "label"))
    dim, n = dimension(rows, "vec"), rows.count()
    params, optimizer, losses = {"w": np.zeros((dim + 1, n_classes))}, optimizer or Adam(0.1), []
    for _ in range(epochs):
        w = params["w"]

        def work(frames, w=w):
            loss, grad = 0.0, np.zeros_like(w)
            for frame in frames:
                if len(frame):
                    x = np.column_stack([np.stack(frame["vec"].to_numpy()), np.ones(len(frame))])
                    logits = x @ w
                    top = logits.max(1, keepdims=True)
                    p = np.exp(logits - top)
                    p /= p.sum(1, keepdims=True)
                    own = np.arange(len(frame)), frame["label"].to_numpy()
                    loss -= np.log(p[own]).sum()
                    p[own] -= 1
                    grad += x.T @ p
            yield pd.DataFrame({"loss": [loss], "grad": [grad.ravel()]})

        parts = rows.mapInPandas(work, "loss double, grad array<double>").collect()
        losses.append(sum(p["loss"] for p in parts) / max(n, 1))
        optimizer.step(params, {"w": sum(np.array(p["grad"]) for p in parts).reshape(w.shape) / max(n, 1)})
    release(rows)
    return params["w"], losses
