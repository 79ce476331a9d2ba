import json

import pytest

from weftgraph import cli
from weftgraph import config as C
from weftgraph.plans import registry


def test_defaults_and_errors(tmp_path):
    assert C.merge({})["training"]["batch_size"] == 1000
    got = C.merge({"model": {"decoder": {"type": "transe"}}, "training": {"num_epochs": 3}})
    assert got["model"]["decoder"] == {"type": "TRANSE", "inverse_edges": True} and got["training"]["num_epochs"] == 3
    for bad in ({"nope": 1}, {"model": {"decoder": {"type": "x"}}}, {"training": {"batch_size": 0}}, {"model": 3}, {"training": {"negative_sampling_selected_ratio": 2}}, {"model": {"embedding_dim": "x"}}, {"model": {"embedding_dim": 3, "decoder": {"type": "COMPLEX"}}}):
        with pytest.raises(ValueError):
            C.merge(bad)
    (tmp_path / "c.yaml").write_text("training:\n  num_epochs: 2\n")
    (tmp_path / "c.json").write_text("{}")
    assert C.load(str(tmp_path / "c.yaml"))["training"]["num_epochs"] == 2 and C.load(str(tmp_path / "c.json")) == C.merge({})


def test_preprocess_train_evaluate(spark, tmp_path):
    lines = [f"n{i % 13}\tr{i % 2}\tn{(i * 5 + 1) % 13}" for i in range(60)]
    (tmp_path / "edges.tsv").write_text("\n".join(lines) + "\n")
    out = str(tmp_path / "data")
    args = cli.parser().parse_args(["preprocess", "--edges", str(tmp_path / "edges.tsv"), "--output_directory", out, "--num_partitions", "2", "--dataset_split", "0.8", "0.1", "0.1"])
    stats = cli.preprocess(spark, args)
    assert stats == {"num_nodes": 13, "num_relations": 2, "num_partitions": 2, "num_train": 48, "num_valid": 6, "num_test": 6}
    model = {"embedding_dim": 4, "decoder": {"type": "COMPLEX"}, "dense_optimizer": {"type": "SGD"}}
    training = {"num_epochs": 2, "batch_size": 16, "batches_per_step": 1, "negative_sampling": {"negatives_per_positive": 5}, "checkpoint": {"interval": 1, "save_best": True, "save_state": True}}
    settings = C.merge({"model": model, "storage": {"dataset_dir": out, "model_dir": str(tmp_path / "model"), "export_encoded_nodes": True}, "training": training})
    trained = cli.train(spark, settings)
    assert trained["losses"][1] < trained["losses"][0]
    assert [r["epoch"] for r in trained["reports"]] == [1, 2] and all(r["split"] == "valid" and r["n_ranks"] == 12 for r in trained["reports"])
    found = cli.evaluate(spark, settings)
    assert found["split"] == "test" and found["n_ranks"] == 12 and 1 <= found["mean_rank"] <= 13
    json.dumps(found)
    # An epoch, and one more from its checkpoint, are two epochs.
    vectors = lambda path: {r.id: r.emb for r in spark.read.parquet(path).collect()}
    once = C.merge({"model": model, "storage": {"dataset_dir": out, "model_dir": str(tmp_path / "once")}, "training": training | {"num_epochs": 1}})
    cli.train(spark, once)
    again = C.merge({"model": model, "storage": {"dataset_dir": out, "model_dir": str(tmp_path / "again")}, "training": training | {"resume_from_checkpoint": str(tmp_path / "once")}})
    assert len(cli.train(spark, again)["losses"]) == 2
    one, other = (vectors(str(tmp_path / name / "v2" / "nodes")) for name in ("model", "again"))
    assert one.keys() == other.keys() and all(abs(a - b) < 1e-9 for k in one for a, b in zip(one[k], other[k]))
    assert vectors(str(tmp_path / "model" / "encoded_nodes")) == one


def test_what_training_cannot_do_is_an_error():
    for bad in ({"model": {"layers": [1]}}, {"model": {"learning_task": "ENCODE"}}, {"storage": {"shuffle_input": False}}, {"storage": {"full_graph_evaluation": False}}, {"training": {"negative_sampling": {"filtered": True}}}, {"evaluation": {"negative_sampling": {"filtered": False}}}):
        with pytest.raises(ValueError):
            cli.train_settings(C.merge(bad))
    assert cli.train_settings(C.merge({})).loss == "softmax_ce"


def test_two_files_are_train_and_test(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).write_text("1 2\n2 3\n")
    args = cli.parser().parse_args(["preprocess", "--edges", str(tmp_path / "a"), str(tmp_path / "b"), "--output_directory", str(tmp_path / "o"), "--delim", " ", "--columns", "0", "1", "--no_remap_ids"])
    stats = cli.preprocess(spark, args)
    assert (stats["num_train"], stats["num_valid"], stats["num_test"], stats["num_nodes"]) == (2, 0, 2, 4)


def test_node_classification_learns(spark, sf_dir):
    row = registry.QUERIES["train_node_classification"](spark, sf_dir).first()
    assert row.last_loss < row.first_loss and row.accuracy > 0.3
