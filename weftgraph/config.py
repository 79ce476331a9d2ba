"""Run configuration: a tree of settings with defaults, read from YAML or JSON.

Four roots: model, storage, training, evaluation. A setting that doesn't exist, or a value that has no meaning, is an
error that names its place. Settings of device memory, threads and transfers have no counterpart here.
"""

from __future__ import annotations

import copy
import json
from pathlib import Path
from typing import Any

#: Defaults; None: must be given where it is used.
DEFAULTS: dict[str, Any] = {
    "model": {
        "random_seed": 0,
        "learning_task": "LINK_PREDICTION",
        "embedding_dim": 50,
        "layers": [],
        "decoder": {"type": "DISTMULT", "inverse_edges": True},
        "loss": {"type": "SOFTMAX_CE", "reduction": "SUM", "margin": 0.1},
        "dense_optimizer": {"type": "ADAGRAD", "learning_rate": 0.1},
        "sparse_optimizer": {"type": "ADAGRAD", "learning_rate": 0.1},
    },
    "storage": {"dataset_dir": None, "model_dir": None, "shuffle_input": True, "full_graph_evaluation": True, "export_encoded_nodes": False, "partitions": {"number": 1, "capacity": 1, "ordering": "COMET", "fine_to_coarse_ratio": 1, "pinned": 0}},
    "training": {
        "batch_size": 1000,
        "batches_per_step": 0,
        "num_epochs": 10,
        "negative_sampling_method": "RNS",
        "negative_sampling_selected_ratio": 1.0,
        "negative_sampling": {"num_chunks": 1, "negatives_per_positive": 1000, "degree_fraction": 0.0, "filtered": False, "local_filter_mode": "DEG", "tournament_selection": False},
        "checkpoint": {"save_best": False, "interval": -1, "save_state": False},
        "resume_from_checkpoint": "",
    },
    "evaluation": {"batch_size": 1000, "epochs_per_eval": 1, "negative_sampling": {"num_chunks": 1, "negatives_per_positive": 1000, "degree_fraction": 0.0, "filtered": True, "local_filter_mode": "DEG", "tournament_selection": False}},
}
CHOICES = {
    "model.learning_task": ["LINK_PREDICTION", "NODE_CLASSIFICATION", "ENCODE"],
    "model.decoder.type": ["DISTMULT", "COMPLEX", "TRANSE", "DOT"],
    "model.loss.type": ["SOFTMAX_CE", "RANKING", "CROSS_ENTROPY", "BCE_AFTER_SIGMOID", "BCE_WITH_LOGITS", "MSE", "SOFTPLUS"],
    "model.loss.reduction": ["SUM", "MEAN"],
    "model.sparse_optimizer.type": ["ADAGRAD"],
    "model.dense_optimizer.type": ["SGD", "ADAGRAD", "ADAM"],
    "storage.partitions.ordering": ["BETA", "OLD_BETA", "NEW_BETA", "COMET", "CUSTOM", "COVER"],
    "training.negative_sampling_method": ["RNS", "DNS", "GAN"],
    "training.negative_sampling.local_filter_mode": ["DEG", "ALL"],
}


def merge(settings: dict[str, Any], defaults: dict[str, Any] | None = None, at: str = "") -> dict[str, Any]:
    """``settings`` over the defaults, checked."""
    out = copy.deepcopy(DEFAULTS if defaults is None else defaults)
    for key, value in settings.items():
        place = f"{at}{key}"
        if key not in out:
            raise ValueError(f"there is no setting {place}")
        if isinstance(out[key], dict):
            if not isinstance(value, dict):
                raise ValueError(f"{place} holds settings, not {value!r}")
            out[key] = merge(value, out[key], f"{place}.")
            continue
        if place in CHOICES:
            value = str(value).upper()
            if value not in CHOICES[place]:
                raise ValueError(f"{place} is one of {', '.join(CHOICES[place])}, not {value}")
        if isinstance(out[key], (int, float)) and not isinstance(out[key], bool) and not isinstance(value, (int, float)):
            raise ValueError(f"{place} is a number, not {value!r}")
        out[key] = value
    if not at:
        _check(out)
    return out


def _check(config: dict[str, Any]) -> None:
    training = config["training"]
    for place, value in (("training.batch_size", training["batch_size"]), ("training.num_epochs", training["num_epochs"]), ("model.embedding_dim", config["model"]["embedding_dim"])):
        if value < 1:
            raise ValueError(f"{place} must be one at least")
    if not 0 < training["negative_sampling_selected_ratio"] <= 1:
        raise ValueError("training.negative_sampling_selected_ratio must be over 0 and 1 at most")
    for root in ("training", "evaluation"):
        if not 0 <= config[root]["negative_sampling"]["degree_fraction"] <= 1:
            raise ValueError(f"{root}.negative_sampling.degree_fraction must be from 0 to 1")
    if config["model"]["decoder"]["type"] == "COMPLEX" and config["model"]["embedding_dim"] % 2:
        raise ValueError("model.embedding_dim must be even for COMPLEX")


def load(path: str) -> dict[str, Any]:
    """Settings of a YAML or JSON file over the defaults."""
    text = Path(path).read_text()
    if path.endswith(".json"):
        return merge(json.loads(text))
    import yaml

    return merge(yaml.safe_load(text) or {})
