"""A small network that maps a state to mixture parameters, trained by data-parallel steps.

x -> 16 tanh -> 16 tanh -> weights, locations, scales (and u, xi, beta for the extreme-value
mixture). The loss is a sum over rows, so each step is one job: every task adds the
gradients of its rows, Spark adds the tasks. Rows are first compressed to
(state, y-bin, weight), which bounds a step by states x bins instead of records.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwelltail.functions import special
from dwelltail.operators.matching import scales_of
from dwelltail.operators.tails import bin_index
from dwelltail.session import complete_rows

HIDDEN = 16


def compress(df: DataFrame, columns: list[str], value: str, bins: int = 256) -> DataFrame:
    """columns, y (mean of the bin's rows), weight (their number)."""
    rows = complete_rows(df, value, columns)
    ends = rows.agg(F.min(value), F.max(value)).first()
    width = (ends[1] - ends[0]) / bins or 1.0
    placed = rows.withColumn("_bin", bin_index(F.col(value), ends[0], width, bins))
    placed = placed.withColumn("_bin", F.coalesce("_bin", F.lit(bins - 1)))
    return placed.groupBy(*columns, "_bin").agg(
        F.avg(value).alias("y"), F.count("*").cast("double").alias("weight")
    ).drop("_bin")


def _np_erfc(x: np.ndarray) -> np.ndarray:
    def ratio(v, num, den):
        top, bottom = num[-1] * v, v
        for a, b in zip(num[:-2], den[:-1]):
            top, bottom = (top + a) * v, (bottom + b) * v
        return (top + num[-2]) / (bottom + den[-1])

    y = np.abs(x)
    safe = np.maximum(y, 0.4)
    decay = np.exp(-np.minimum(y, 27.0) ** 2)
    near = 1.0 - x * ratio(y * y, special.ERF_NUM, special.ERF_DEN)
    mid = decay * ratio(y, special.MID_NUM, special.MID_DEN)
    inverse = 1.0 / (safe * safe)
    far = decay * (special.INV_SQRT_PI - inverse * ratio(inverse, special.FAR_NUM, special.FAR_DEN)) / safe
    outer = np.where(y <= 4.0, mid, far)
    return np.where(y <= 0.46875, near, np.where(x > 0, outer, 2.0 - outer))


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, x)


class Shape:
    """Sizes of the network and the flat layout of its weights."""

    def __init__(self, inputs: int, k: int, tail: bool):
        self.inputs, self.k, self.tail = inputs, k, tail
        self.outputs = 3 * k + (3 if tail else 0)
        self.sizes = [(inputs, HIDDEN), (HIDDEN, HIDDEN), (HIDDEN, self.outputs)]
        self.length = sum(a * b + b for a, b in self.sizes)

    def unpack(self, flat: np.ndarray):
        layers, at = [], 0
        for a, b in self.sizes:
            layers.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
            at += a * b + b
        return layers

    def start(self, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        parts = []
        for i, (a, b) in enumerate(self.sizes):
            parts.append(rng.normal(0.0, 1.0 / math.sqrt(a), a * b))
            bias = np.zeros(b)
            if i == 2:
                bias[self.k : 2 * self.k] = np.linspace(-1.0, 1.0, self.k)
                bias[2 * self.k : 3 * self.k] = 0.5
                if self.tail:
                    bias[3 * self.k :] = (1.5, -2.0, 0.0)
            parts.append(bias)
        return np.concatenate(parts)

    def parameters(self, out: np.ndarray) -> dict[str, np.ndarray]:
        k = self.k
        logits = out[:, :k] - out[:, :k].max(axis=1, keepdims=True)
        raised = np.exp(logits)
        found = {
            "w": raised / raised.sum(axis=1, keepdims=True),
            "mu": out[:, k : 2 * k],
            "sigma": _softplus(out[:, 2 * k : 3 * k]) + 1e-3,
        }
        if self.tail:
            found["u"] = out[:, 3 * k]
            found["xi"] = _softplus(out[:, 3 * k + 1]) + 1e-6
            found["beta"] = _softplus(out[:, 3 * k + 2]) + 1e-3
        return found

    def log_density(self, out: np.ndarray, y: np.ndarray) -> np.ndarray:
        p = self.parameters(out)
        z = (y[:, None] - p["mu"]) / p["sigma"]
        terms = np.log(p["w"] + 1e-300) - 0.5 * z * z - np.log(p["sigma"] * special.SQRT_2PI)
        top = terms.max(axis=1)
        bulk = top + np.log(np.exp(terms - top[:, None]).sum(axis=1))
        if not self.tail:
            return bulk
        over = (p["u"][:, None] - p["mu"]) / (p["sigma"] * special.SQRT2)
        norm = np.maximum((p["w"] * 0.5 * _np_erfc(over)).sum(axis=1), 1e-300)
        excess = np.maximum(y - p["u"], 0.0)
        gpd = -np.log(p["beta"]) - (p["xi"] + 1) / p["xi"] * np.log1p(p["xi"] * excess / p["beta"])
        return np.where(y > p["u"], np.log(norm) + gpd, bulk)


def _forward(shape: Shape, flat: np.ndarray, x: np.ndarray):
    (w1, b1), (w2, b2), (w3, b3) = shape.unpack(flat)
    h1 = np.tanh(x @ w1 + b1)
    h2 = np.tanh(h1 @ w2 + b2)
    return h1, h2, h2 @ w3 + b3


def batch_gradient(shape: Shape, flat: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray, entropy: float):
    """Weighted negative log-likelihood (plus entropy penalty) of a batch and its gradient.

    The few outputs are differentiated numerically, the layers below by the chain rule.
    """
    h1, h2, out = _forward(shape, flat, x)

    def loss(o: np.ndarray) -> np.ndarray:
        value = -shape.log_density(o, y)
        if entropy:
            w = shape.parameters(o)["w"]
            value = value - entropy * (w * np.log(w + 1e-300)).sum(axis=1)
        return value

    step = 1e-5
    slope = np.empty_like(out)
    for j in range(shape.outputs):
        shift = np.zeros(shape.outputs)
        shift[j] = step
        slope[:, j] = (loss(out + shift) - loss(out - shift)) / (2 * step)
    slope *= weight[:, None]
    (_, _), (w2, _), (w3, _) = shape.unpack(flat)
    d2 = (slope @ w3.T) * (1 - h2 * h2)
    d1 = (d2 @ w2.T) * (1 - h1 * h1)
    parts = []
    for left, right in ((x, d1), (h1, d2), (h2, slope)):
        parts += [(left.T @ right).ravel(), right.sum(axis=0)]
    return float((loss(out) * weight).sum()), np.concatenate(parts)


class ConditionalNet:
    """A trained network with the normalisation of its inputs."""

    def __init__(self, shape: Shape, flat: np.ndarray, columns: list[str], means, stds, losses):
        self.shape, self.flat, self.columns = shape, flat, columns
        self.means, self.stds, self.losses = means, stds, losses

    def parameters(self, states: DataFrame) -> DataFrame:
        """States with w, mu, sigma (and u, xi, beta, norm) in the units of y."""
        shape, flat, columns = self.shape, self.flat, self.columns
        means, stds = self.means, self.stds

        def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                x = (batch[columns].to_numpy(dtype=float) - means[:-1]) / stds[:-1]
                p = shape.parameters(_forward(shape, flat, x)[2])
                found = batch[columns].copy()
                found["w"] = list(p["w"])
                found["mu"] = list(p["mu"] * stds[-1] + means[-1])
                found["sigma"] = list(p["sigma"] * stds[-1])
                if shape.tail:
                    found["u"] = p["u"] * stds[-1] + means[-1]
                    found["xi"] = p["xi"]
                    found["beta"] = p["beta"] * stds[-1]
                    over = (p["u"][:, None] - p["mu"]) / (p["sigma"] * special.SQRT2)
                    found["norm"] = (p["w"] * 0.5 * _np_erfc(over)).sum(axis=1)
                yield found

        fields = [f"{f.name} {f.dataType.simpleString()}" for f in states.select(*columns).schema.fields]
        fields += ["w array<double>", "mu array<double>", "sigma array<double>"]
        if shape.tail:
            fields += ["u double", "xi double", "beta double", "norm double"]
        return states.select(*columns).mapInPandas(apply, ", ".join(fields))


def fit_conditional_net(
    df: DataFrame,
    columns: list[str],
    value: str,
    k: int = 2,
    tail: bool = False,
    steps: int = 100,
    learning_rate: float = 0.02,
    bins: int | None = 256,
    l1: float = 0.0,
    l2: float = 0.0,
    entropy: float = 0.0,
    x_noise: float = 0.0,
    seed: int = 1,
) -> ConditionalNet:
    """Adam on the mean negative log-likelihood of z-scored data; one Spark job per step.

    ``bins=None`` trains on the rows themselves.
    """
    rows = complete_rows(df, value, columns)
    means, stds = scales_of(rows, [*columns, value])
    means, stds = np.array(means, dtype=float), np.array(stds, dtype=float) + 1e-8
    data = rows.select(*columns, F.col(value).alias("y"), F.lit(1.0).alias("weight"))
    if bins:
        data = compress(rows, columns, value, bins)
    data = data.persist()
    total = data.agg(F.sum("weight")).first()[0]
    shape = Shape(len(columns), k, tail)
    flat = shape.start(seed)
    first, second, losses = np.zeros(shape.length), np.zeros(shape.length), []
    schema = "i int, g double"
    for step in range(1, steps + 1):
        current = flat

        def gradients(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            loss, gradient = 0.0, np.zeros(shape.length)
            for batch in batches:
                if not len(batch):
                    continue
                x = (batch[columns].to_numpy(dtype=float) - means[:-1]) / stds[:-1]
                if x_noise:
                    x = x + np.random.default_rng([seed, step, len(batch)]).normal(0.0, x_noise, x.shape)
                y = (batch["y"].to_numpy() - means[-1]) / stds[-1]
                part = batch_gradient(shape, current, x, y, batch["weight"].to_numpy(), entropy)
                loss, gradient = loss + part[0], gradient + part[1]
            yield pd.DataFrame({"i": np.arange(-1, shape.length, dtype=np.int32), "g": np.append(loss, gradient)})

        summed = data.mapInPandas(gradients, schema).groupBy("i").agg(F.sum("g").alias("g"))
        found = np.zeros(shape.length + 1)
        for row in summed.collect():  # one number per network weight
            found[row["i"] + 1] = row["g"]
        found /= total
        gradient = found[1:] + l1 * np.sign(flat) + 2 * l2 * flat
        losses.append(float(found[0]))
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient * gradient
        corrected = first / (1 - 0.9**step)
        flat = flat - learning_rate * corrected / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    data.unpersist()
    return ConditionalNet(shape, flat, columns, means, stds, losses)
