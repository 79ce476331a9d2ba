"""Command line: preprocess edge files, train vectors, evaluate them.

    python -m weftgraph.cli preprocess --edges a.tsv --output_directory out --dataset_split 0.9 0.05 0.05
    python -m weftgraph.cli train config.yaml
    python -m weftgraph.cli evaluate config.yaml
"""

from __future__ import annotations

import argparse
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import config as C
from weftgraph.operators import dictionary as D
from weftgraph.operators import partition as P
from weftgraph.operators import scoring as S
from weftgraph.operators import train as T
from weftgraph.sources import files
from weftgraph.sources.shared import cut

SPLITS = ("train", "valid", "test")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="weftgraph", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    kinds = top.add_subparsers(dest="command", required=True)
    pre = kinds.add_parser("preprocess", help="edge files into dictionaries and bucketed edges")
    pre.add_argument("--edges", nargs="+", required=True, help="one file, or train, valid and test; two are train and test")
    pre.add_argument("--output_directory", required=True)
    pre.add_argument("--dataset", default="custom")
    pre.add_argument("--num_partitions", type=int, default=1)
    pre.add_argument("--delim", "-d", default="\t")
    pre.add_argument("--dataset_split", "-ds", nargs="+", type=float)
    pre.add_argument("--columns", nargs="*", type=int, default=[0, 1, 2])
    pre.add_argument("--header", type=int, default=0)
    pre.add_argument("--no_remap_ids", action="store_true")
    pre.add_argument("--sequential_train_nodes", action="store_true")
    for name in ("train", "evaluate"):
        kinds.add_parser(name, help=f"{name} as a configuration says").add_argument("config")
    return top


def preprocess(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Write nodes, relations and edges by split under the output directory, and give their statistics."""
    columns, sep, header = args.columns, args.delim, args.header
    if args.dataset != "custom":
        columns, sep, header, _ = files.DATASETS[args.dataset]
    parts = [files.scan_delimited(spark, p, columns, sep, header) for p in args.edges]
    names = {1: ["train"], 2: ["train", "test"], 3: list(SPLITS)}[len(parts)]
    parts = [p if "rel" in p.columns else p.withColumn("rel", F.lit("0")) for p in parts]
    if args.dataset_split:
        rows = D.split_edges(parts[0].withColumn("_", F.monotonically_increasing_id()), tuple(args.dataset_split), ["src", "rel", "dst", "_"]).drop("_")
    else:
        rows = None
        for name, part in zip(names, parts, strict=True):
            part = part.withColumn("split", F.lit(name))
            rows = part if rows is None else rows.unionByName(part)
    rows = cut(rows)
    universe = D.node_universe(rows)
    if args.no_remap_ids:
        nodes = universe.select("raw", F.col("raw").cast("long").alias("id"))
        relations = D.relation_universe(rows).select("raw", F.col("raw").cast("long").alias("id"))
    else:
        nodes = D.train_first_ids(universe, rows.where("split = 'train'")) if args.sequential_train_nodes else D.dense_ids(universe)
        relations = D.sorted_ids(D.relation_universe(rows))
    out = args.output_directory.rstrip("/")
    nodes.write.mode("overwrite").parquet(f"{out}/nodes")
    relations.write.mode("overwrite").parquet(f"{out}/relations")
    nodes, relations = spark.read.parquet(f"{out}/nodes"), spark.read.parquet(f"{out}/relations")
    n_nodes = (nodes.agg(F.max("id")).first()[0] + 1) if args.no_remap_ids else nodes.count()
    mapped = D.apply_mapping(rows, nodes, relations)
    P.with_buckets(mapped, n_nodes, args.num_partitions).write.mode("overwrite").partitionBy("split", "src_part", "dst_part").parquet(f"{out}/edges")
    counts = {r["split"]: r["n"] for r in spark.read.parquet(f"{out}/edges").groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    stats = {"num_nodes": n_nodes, "num_relations": relations.count(), "num_partitions": args.num_partitions} | {f"num_{s}": counts.get(s, 0) for s in SPLITS}
    spark.createDataFrame([(json.dumps(stats, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/stats")
    return stats


def dataset(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Edges (split, edge_id, src, rel, dst) and statistics of a preprocessed dataset."""
    stats = json.loads(spark.read.text(f"{path}/stats").first().value)
    edges = files.with_edge_ids(spark.read.parquet(f"{path}/edges").select("split", "src", F.col("rel").cast("int").alias("rel"), "dst"), ["split", "src", "rel", "dst"])
    return edges, stats


def report(edges: DataFrame, emb: DataFrame, relations: dict[str, DataFrame], decoder: str, splits: tuple[str, ...] = ("test", "valid")) -> dict:
    """Metrics of the edges of the first of ``splits`` that has any, among all nodes, all splits known; with inverse
    relations both ends are asked for."""
    flipped = lambda df: df.select("edge_id", F.col("dst").alias("src"), "rel", F.col("src").alias("dst"))
    for split in splits:
        asked = edges.where(F.col("split") == split).select("edge_id", "src", "rel", "dst")
        if asked.limit(1).count():
            known = edges.select("edge_id", "src", "rel", "dst")
            ranks = S.filtered_ranks(asked, emb, relations["relations"], known, decoder)
            if "inverse_relations" in relations:
                ranks = ranks.unionByName(S.filtered_ranks(flipped(asked), emb, relations["inverse_relations"], flipped(known), decoder))
            return {"split": split} | S.metrics(ranks).first().asDict()
    return {}


def train_settings(settings: dict) -> T.Settings:
    """What training takes from a configuration; what it can't do is an error that names its place."""
    model, storage, training = settings["model"], settings["storage"], settings["training"]
    negatives, parts = training["negative_sampling"], storage["partitions"]
    wanted = [
        ("model.learning_task", model["learning_task"], "LINK_PREDICTION"), ("model.layers", model["layers"], []), ("storage.shuffle_input", storage["shuffle_input"], True),
        ("storage.full_graph_evaluation", storage["full_graph_evaluation"], True), ("training.negative_sampling.filtered", negatives["filtered"], False), ("evaluation.negative_sampling.filtered", settings["evaluation"]["negative_sampling"]["filtered"], True),
    ]
    for place, value, only in wanted:
        if value != only:
            raise ValueError(f"{place} can only be {only!r} here, not {value!r}")
    return T.Settings(
        dim=model["embedding_dim"], decoder=model["decoder"]["type"].lower(), inverse_edges=model["decoder"]["inverse_edges"], loss=model["loss"]["type"].lower(), reduction=model["loss"]["reduction"].lower(), margin=model["loss"]["margin"],
        dense_optimizer=model["dense_optimizer"]["type"].lower(), dense_rate=model["dense_optimizer"]["learning_rate"], rate=model["sparse_optimizer"]["learning_rate"], epochs=training["num_epochs"], batch=training["batch_size"], step_batches=training["batches_per_step"],
        chunks=negatives["num_chunks"], negatives=negatives["negatives_per_positive"], degree_fraction=negatives["degree_fraction"], local_filter=negatives["local_filter_mode"].lower(), method=training["negative_sampling_method"].lower(),
        selected_ratio=training["negative_sampling_selected_ratio"], tournament=negatives["tournament_selection"], parts=parts["number"], capacity=parts["capacity"], ordering=parts["ordering"], ratio=parts["fine_to_coarse_ratio"], pinned=parts["pinned"], seed=model["random_seed"],
    )


def train(spark: SparkSession, settings: dict) -> dict:
    """Train as configured: epochs, reports on the validation edges, checkpoints by interval or of the best epoch."""
    storage, training, how = settings["storage"], settings["training"], train_settings(settings)
    edges, stats = dataset(spark, storage["dataset_dir"])
    own = files.with_edge_ids(edges.where("split = 'train'").select("src", "rel", "dst"), ["src", "rel", "dst"])
    n_nodes, n_relations = stats["num_nodes"], stats["num_relations"]
    state, first = None, 0
    if training["resume_from_checkpoint"]:
        about = files.load_checkpoint(spark, training["resume_from_checkpoint"], -1)[1]
        state, first = restored(spark, training["resume_from_checkpoint"], how), about["epochs"]
    checkpoint, every, reports = training["checkpoint"], settings["evaluation"]["epochs_per_eval"], []

    def save(epoch: int, at: T.State, version: int) -> None:
        kept = [c for c in at.table.columns if c in ("id", "emb") or checkpoint["save_state"]]
        tables = {"nodes": at.table.select(kept)} | {k: T.relation_table(spark, v) for k, v in at.relations.items()}
        files.save_checkpoint(tables, storage["model_dir"], version, {"losses": at.losses, "settings": settings, "epochs": epoch + 1})

    def after_epoch(epoch: int, at: T.State) -> None:
        if every > 0 and (epoch + 1) % every == 0:
            relations = {k: T.relation_table(spark, v) for k, v in at.relations.items()}
            if found := report(edges, at.table.select("id", "emb"), relations, how.decoder, ("valid",)):
                best = max((r["mrr"] for r in reports), default=-1.0)
                reports.append({"epoch": epoch + 1} | found)
                if checkpoint["save_best"] and found["mrr"] > best:
                    save(epoch, at, BEST)
        if checkpoint["interval"] > 0 and (epoch + 1) % checkpoint["interval"] == 0 and epoch + 1 < how.epochs:
            save(epoch, at, epoch + 1)

    state = T.train(own, n_nodes, how, n_relations, state, first, after_epoch)
    save(how.epochs - 1, state, how.epochs)
    save(how.epochs - 1, state, LAST)
    if storage["export_encoded_nodes"]:
        state.table.select("id", "emb").write.mode("overwrite").parquet(f"{storage['model_dir']}/encoded_nodes")
    return {"losses": state.losses, "reports": reports}


#: Checkpoints beside those named by their epoch.
LAST, BEST = -1, -2


def restored(spark: SparkSession, path: str, how: T.Settings, version: int = LAST) -> T.State:
    """The state of a checkpoint; sums of squares that it doesn't hold start at zero."""
    tables, about = files.load_checkpoint(spark, path, version)
    nodes = tables["nodes"]
    for emb, name in (("emb", "state"), ("emb_g", "state_g")):
        if emb in nodes.columns and name not in nodes.columns:
            nodes = nodes.withColumn(name, F.transform(emb, lambda x: F.lit(0.0)))
    if how.method == "gan" and "emb_g" not in nodes.columns:
        raise ValueError("training.resume_from_checkpoint has no generator")
    relations = {k: np.array([r["vec"] for r in tables[k].orderBy("rel").collect()]) for k in ("relations", "inverse_relations") if k in tables}
    return T.State(cut(nodes), relations, T.optimizer(how.dense_optimizer, how.dense_rate), about["losses"])


def evaluate(spark: SparkSession, settings: dict) -> dict:
    """Metrics of the last checkpoint, by the relations learned with it."""
    storage, how = settings["storage"], train_settings(settings)
    edges, _ = dataset(spark, storage["dataset_dir"])
    tables, _ = files.load_checkpoint(spark, storage["model_dir"], LAST)
    return report(edges, tables["nodes"].select("id", "emb"), tables, how.decoder)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("weftgraph").getOrCreate()
    if args.command == "preprocess":
        out = preprocess(spark, args)
    else:
        out = {"train": train, "evaluate": evaluate}[args.command](spark, C.load(args.config))
    print(json.dumps(out, default=str))


if __name__ == "__main__":
    main()
