"""Expectation maximisation of a Gaussian mixture over weighted values, run until it is settled.

Each cycle takes two plain steps, leaps along their direction as far as their ratio suggests, and takes a plain step from there; a leap that lowers
the likelihood is dropped. A fit is settled when a plain step moves no weight, and no component by its weight in deviations of
the values or in logarithms of its own deviation, by more than ``tolerance``: a bound without unit. The SQL of the queries repeats these rules.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

#: Longest leap, in plain steps.
LONGEST = 100.0
#: Least weight and widest deviation (in logarithms above that of the values) after a leap.
LEAST_WEIGHT, WIDEST = 1e-12, 5.0
LOG_SQRT_2PI = 0.5 * math.log(2 * math.pi)
#: Least variance of a component as a share of that of the values.
VARIANCE_FLOOR = 1e-6
#: Stands for the logarithm of a tail mass that underflows.
LOWEST_LOG = -745.0


@dataclass
class Settled:
    w: np.ndarray
    mu: np.ndarray
    sigma: np.ndarray
    #: Plain steps taken, whether the last one moved nothing, and the likelihood before it.
    steps: int
    done: bool
    loglik: float


def above(u: float, w: np.ndarray, m: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per component its mass above u, (u - m) / s, and the hazard there."""
    z = (u - m) / s
    q = np.array([0.5 * math.erfc(v / math.sqrt(2.0)) for v in z])
    # phi(z) / Q(z); where the mass underflows it tends to z itself
    hazard = np.where(q > 1e-290, np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) / np.maximum(q, 1e-300), np.maximum(z, 0.0))
    return w * q, z, hazard


def step(y, weight, w, m, s, n: float, variance: float, tail: tuple[float, float] | None = None):
    """One plain step over values with weights: (w, m, s, log likelihood before it).

    ``tail`` = (u, rows above u): these are counted only, as values known to lie above u.
    """
    k = len(w)
    gap = y[:, None] - m
    logs = np.log(np.maximum(w, 1e-300)) - np.log(s) - 0.5 * (gap / s) ** 2
    top = logs.max(1)
    share = np.exp(logs - top[:, None])
    total = share.sum(1)
    share *= (weight / total)[:, None]
    loglik = float(weight @ (top + np.log(total))) - LOG_SQRT_2PI * float(weight.sum())
    counts, first, second = share.sum(0), (share * gap).sum(0), (share * gap * gap).sum(0)
    if tail is not None and tail[1] > 0:
        mass, z, hazard = above(tail[0], w, m, s)
        whole = mass.sum()
        mine = tail[1] * (mass / whole if whole > 0 else np.full(k, 1.0 / k))
        loglik += tail[1] * (math.log(whole) if whole > 0 else LOWEST_LOG)
        counts, first, second = counts + mine, first + mine * s * hazard, second + mine * s * s * (1 + z * hazard)
    some = counts > 1e-12
    safe = np.where(some, counts, 1.0)
    shift = np.where(some, first / safe, 0.0)
    moved = np.sqrt(np.maximum(second / safe - shift * shift, VARIANCE_FLOOR * variance))
    return counts / n, m + shift, np.where(some, moved, s), loglik


def _moves(old, new, deviation: float) -> np.ndarray:
    """Changes of weights, and of places and log deviations by weight."""
    w = new[0]
    return np.concatenate([new[0] - old[0], w * (new[1] - old[1]) / deviation, w * (np.log(new[2]) - np.log(old[2]))])


def settle(y, weight, start, n: float, variance: float, iterations: int, tolerance: float, tail: tuple[float, float] | None = None) -> Settled:
    """Cycles from ``start`` (w, m, s) until a plain step moves nothing, or for ``iterations`` plain steps."""
    deviation = math.sqrt(variance)
    current = tuple(np.array(c, float) for c in start)
    steps = 0

    def plain(theta):
        *moved, loglik = step(y, weight, *theta, n, variance, tail)
        return tuple(moved), loglik

    while True:
        one, loglik = plain(current)
        steps += 1
        if np.abs(_moves(current, one, deviation)).max() <= tolerance or steps >= iterations:
            return Settled(*one, steps, steps < iterations, loglik)
        two, loglik_one = plain(one)
        steps += 1
        leap = _leap(current, one, two, deviation)
        landed, loglik_leap = plain(leap)
        steps += 1
        current = landed if loglik_leap >= loglik_one else two


def _leap(zero, one, two, deviation: float):
    first, second = _moves(zero, one, deviation), _moves(one, two, deviation)
    bend = math.sqrt(float(((second - first) ** 2).sum()))
    length = math.sqrt(float((first * first).sum()))
    a = max(1.0, min(LONGEST, length / bend if bend > 0 else 1.0))

    def along(x, y, z):
        return x + 2 * a * (y - x) + a * a * (z - 2 * y + x)

    w = np.maximum(along(zero[0], one[0], two[0]), LEAST_WEIGHT)
    width = along(*(np.log(t[2]) for t in (zero, one, two)))
    low, high = math.log(deviation) + 0.5 * math.log(VARIANCE_FLOOR), math.log(deviation) + WIDEST
    return w / w.sum() * two[0].sum(), along(zero[1], one[1], two[1]), np.exp(np.clip(width, low, high))


def log_density(y, w, m, s) -> np.ndarray:
    logs = np.log(np.maximum(w, 1e-300)) - np.log(s) - 0.5 * ((y[:, None] - m) / s) ** 2
    top = logs.max(1)
    return top + np.log(np.exp(logs - top[:, None]).sum(1)) - LOG_SQRT_2PI


@dataclass
class Spliced:
    """A censored bulk with a Pareto tail above u, and their likelihood together."""

    bulk: Settled
    n_tail: int
    xi: float
    beta: float
    loglik: float


def spliced(y, weight, below, u: float, top: float, start, n: float, variance: float, iterations: int, tolerance: float, least: int) -> Spliced | None:
    """Bulk and tail at one threshold; None with fewer than ``least`` excesses or if they do not vary.

    The likelihood is that of the spliced density: the bulk scaled to the share of records up to u, the Pareto density times the
    share above; minus infinity if the Pareto's end point lies below the largest record ``top``.
    """
    bulk_y, bulk_weight, excess, tail_weight = y[below], weight[below], y[~below] - u, weight[~below]
    n_tail = int(round(float(tail_weight.sum())))
    if n_tail < least:
        return None
    mean = float(tail_weight @ excess) / n_tail
    spread = float(tail_weight @ (excess - mean) ** 2) / (n_tail - 1)
    if not spread > 1e-300:
        return None
    ratio = mean * mean / spread
    xi, beta = 0.5 * (1 - ratio), 0.5 * mean * (ratio + 1)
    bulk = settle(bulk_y, bulk_weight, start, n, variance, iterations, tolerance, (u, float(n_tail)))
    inside = 1 - float(above(u, bulk.w, bulk.mu, bulk.sigma)[0].sum())
    share = n_tail / n
    loglik = float(bulk_weight @ log_density(bulk_y, bulk.w, bulk.mu, bulk.sigma)) + (n - n_tail) * math.log((1 - share) / inside) + n_tail * math.log(share / beta)
    if abs(xi) < 1e-8:
        return Spliced(bulk, n_tail, xi, beta, loglik - mean * n_tail / beta)
    last = 1 + xi * (top - u) / beta
    if last <= 0:
        return Spliced(bulk, n_tail, xi, beta, -math.inf)
    # nodes can lie beyond the largest record
    grown = np.maximum(1 + xi * excess / beta, min(last, 1.0))
    return Spliced(bulk, n_tail, xi, beta, loglik - (1 + 1 / xi) * float(tail_weight @ np.log(grown)))
