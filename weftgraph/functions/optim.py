"""Optimizer steps and initial values of dense parameters, in NumPy."""

from __future__ import annotations

import math

import numpy as np


class SGD:
    def __init__(self, rate: float = 0.1) -> None:
        self.rate = rate

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        for name, grad in grads.items():
            params[name] = params[name] - self.rate * grad


class Adagrad:
    """Step size falls with the steps by ``decay``; ``weight_decay`` pulls parameters to zero."""

    def __init__(self, rate: float = 0.1, decay: float = 0.0, weight_decay: float = 0.0, start: float = 0.0, eps: float = 1e-10) -> None:
        self.rate, self.decay, self.weight_decay, self.start, self.eps = rate, decay, weight_decay, start, eps
        self.sums: dict[str, np.ndarray] = {}
        self.steps = 0

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        rate = self.rate / (1 + self.steps * self.decay)
        self.steps += 1
        for name, grad in grads.items():
            grad = grad + self.weight_decay * params[name]
            self.sums[name] = self.sums.get(name, np.full_like(params[name], self.start)) + grad**2
            params[name] = params[name] - rate * grad / (np.sqrt(self.sums[name]) + self.eps)


class Adam:
    """With ``amsgrad`` the second moment never falls."""

    def __init__(self, rate: float = 0.1, betas: tuple[float, float] = (0.9, 0.999), eps: float = 1e-8, weight_decay: float = 0.0, amsgrad: bool = False) -> None:
        self.rate, self.betas, self.eps, self.weight_decay, self.amsgrad = rate, betas, eps, weight_decay, amsgrad
        self.first: dict[str, np.ndarray] = {}
        self.second: dict[str, np.ndarray] = {}
        self.top: dict[str, np.ndarray] = {}
        self.steps = 0

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        self.steps += 1
        a, b = self.betas
        for name, grad in grads.items():
            grad = grad + self.weight_decay * params[name]
            zero = np.zeros_like(params[name])
            self.first[name] = a * self.first.get(name, zero) + (1 - a) * grad
            self.second[name] = b * self.second.get(name, zero) + (1 - b) * grad**2
            second = self.second[name]
            if self.amsgrad:
                second = self.top[name] = np.maximum(self.top.get(name, zero), second)
            corrected = np.sqrt(second) / math.sqrt(1 - b**self.steps)
            params[name] = params[name] - self.rate / (1 - a**self.steps) * self.first[name] / (corrected + self.eps)


def average(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Mean of parameters or gradients that tasks hand on."""
    return {k: sum(p[k] for p in parts) / len(parts) for k in parts[0]}


def init(kind: str, shape: tuple[int, ...], seed: int = 0, value: float = 0.0, scale: float = 1e-3, fans: tuple[int, int] | None = None) -> np.ndarray:
    """Initial values by name; Glorot's fans are those of the whole shape unless given."""
    rng = np.random.default_rng(seed)
    fan_in, fan_out = fans or (shape[-1], shape[0])
    if kind in ("zeros", "ones", "constant"):
        return np.full(shape, {"zeros": 0.0, "ones": 1.0}.get(kind, value))
    if kind == "uniform":
        return rng.uniform(-scale, scale, shape)
    if kind == "normal":
        return rng.normal(0, scale, shape)
    if kind == "glorot_uniform":
        return rng.uniform(-1, 1, shape) * math.sqrt(6 / (fan_in + fan_out))
    if kind == "glorot_normal":
        return rng.normal(0, 1, shape) * math.sqrt(2 / (fan_in + fan_out))
    raise ValueError(f"no initial values {kind}")


def generator_reward(score: np.ndarray) -> np.ndarray:
    """2 (sigmoid - 1/2) of the discriminator's scores of what the generator chose."""
    return 2 / (1 + np.exp(-score)) - 1
