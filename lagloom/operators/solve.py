"""Numeric fits of kernel weights on prepared windows: Adam on a softmax, in NumPy.

Each epoch scores the weights before its step on the training and validation
windows, and the best by validation loss are kept.  Gradients are closed-form.
Terms that are the same for all lags cancel in the softmax and are left out.
"""

from __future__ import annotations

import math
from typing import Any

import numpy as np

FLOOR = 1e-8


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def softplus(x: float) -> float:
    return max(x, 0.0) + math.log1p(math.exp(-abs(x)))


def inverse_softplus(y: float) -> float:
    y = max(y, FLOOR)
    return y if y > 30 else math.log(math.expm1(y))


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def loss_value(r: np.ndarray, weight: np.ndarray | None, loss: str, delta: float) -> float:
    if loss == "mse":
        v = r * r
    else:
        a = np.abs(r)
        q = np.minimum(a, delta)
        v = 0.5 * q * q + delta * (a - q)
    return float(v.mean() if weight is None else (v * weight).sum() / weight.sum())


def loss_slope(r: np.ndarray, weight: np.ndarray | None, loss: str, delta: float) -> np.ndarray:
    g = 2 * r if loss == "mse" else np.clip(r, -delta, delta)
    return g / len(r) if weight is None else g * weight / weight.sum()


class Adam:
    def __init__(self, n: int, rate: float):
        self.m, self.v, self.k, self.rate = np.zeros(n), np.zeros(n), 0, rate

    def step(self, theta: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.k += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.999 * self.v + 0.001 * g * g
        return theta - self.rate * (self.m / (1 - 0.9**self.k)) / (np.sqrt(self.v / (1 - 0.999**self.k)) + 1e-8)


class Family:
    """Maps free parameters to logits over the lag times, with their derivatives."""

    def __init__(self, times: np.ndarray):
        self.t = times

    def start(self) -> np.ndarray:
        raise NotImplementedError

    def logits(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(logits, d logits / d theta) with one column a parameter."""
        raise NotImplementedError

    def parameters(self, theta: np.ndarray) -> dict[str, float]:
        return {}

    def starting(self) -> dict[str, float]:
        return self.parameters(self.start())


class Simplex(Family):
    def start(self):
        return np.zeros(len(self.t))

    def logits(self, theta):
        return theta, np.eye(len(theta))


def _midpoint(t: np.ndarray) -> float:
    mid = (t[0] + t[-1]) / 2
    if mid <= 0:
        raise ValueError("default starting values need a positive middle lag")
    return mid


class Exponential(Family):
    def __init__(self, times, init_rate_lambda=None):
        super().__init__(times)
        self.init = 1 / _midpoint(times) if init_rate_lambda is None else init_rate_lambda

    def start(self):
        return np.array([inverse_softplus(self.init)])

    def logits(self, theta):
        return -(softplus(theta[0]) + FLOOR) * self.t, (-self.t * sigmoid(theta[0]))[:, None]

    def parameters(self, theta):
        return {"rate_lambda": softplus(theta[0]) + FLOOR}


class DelayedExponential(Family):
    """Decay after one fixed delay; the delay itself is searched over the lags by ``fit``."""

    def __init__(self, times, delay, init_rate_lambda=None):
        super().__init__(times)
        self.delay = delay
        self.init = 1 / _midpoint(times) if init_rate_lambda is None else init_rate_lambda

    def start(self):
        return np.array([inverse_softplus(self.init)])

    def logits(self, theta):
        after = self.t >= self.delay
        return np.where(after, -(softplus(theta[0]) + FLOOR) * (self.t - self.delay), -1e9), np.where(after, -(self.t - self.delay) * sigmoid(theta[0]), 0.0)[:, None]

    def parameters(self, theta):
        return {"delay": float(self.delay), "rate_lambda": softplus(theta[0]) + FLOOR}


class Gamma(Family):
    def __init__(self, times, init_shape_alpha=2.0, init_rate_beta=None):
        super().__init__(times)
        self.zero = bool(times[0] <= 0)
        self.low = 1.0 if self.zero else 0.0
        self.a, self.b = init_shape_alpha, (1 / _midpoint(times) if init_rate_beta is None else init_rate_beta)
        self.log_t = np.log(np.where(times > 0, times, 1.0))

    def start(self):
        return np.array([inverse_softplus(self.a - self.low), inverse_softplus(self.b)])

    def logits(self, theta):
        a, b = self.low + softplus(theta[0]) + FLOOR, softplus(theta[1]) + FLOOR
        z = (a - 1) * self.log_t - b * self.t
        d = np.stack([self.log_t * sigmoid(theta[0]), -self.t * sigmoid(theta[1])], 1)
        if self.zero:
            z[0], d[0] = -1e9, 0
        return z, d

    def parameters(self, theta):
        return {"shape_alpha": self.low + softplus(theta[0]) + FLOOR, "rate_beta": softplus(theta[1]) + FLOOR}


class Erlang(Family):
    """A gamma with one fixed whole shape; shapes are searched by ``fit``."""

    def __init__(self, times, shape_k, init_rate_beta=None):
        super().__init__(times)
        self.k = shape_k
        self.b = 1 / _midpoint(times) if init_rate_beta is None else init_rate_beta
        self.log_t = np.log(np.where(times > 0, times, 1.0))

    def start(self):
        return np.array([inverse_softplus(self.b)])

    def logits(self, theta):
        z = (self.k - 1) * self.log_t - (softplus(theta[0]) + FLOOR) * self.t
        d = (-self.t * sigmoid(theta[0]))[:, None]
        if self.t[0] <= 0 and self.k > 1:
            z[0], d[0] = -1e9, 0
        return z, d

    def parameters(self, theta):
        return {"shape_k": int(self.k), "rate_beta": softplus(theta[0]) + FLOOR}


class LogNormal(Family):
    def __init__(self, times, init_log_mu=None, init_log_sigma=0.5):
        super().__init__(times)
        self.mu = math.log(_midpoint(times)) if init_log_mu is None else init_log_mu
        self.sigma = init_log_sigma
        self.log_t = np.log(np.where(times > 0, times, 1.0))

    def start(self):
        return np.array([self.mu, inverse_softplus(self.sigma)])

    def logits(self, theta):
        s = softplus(theta[1]) + FLOOR
        u = (self.log_t - theta[0]) / s
        z = -0.5 * u * u - self.log_t
        d = np.stack([u / s, u * u / s * sigmoid(theta[1])], 1)
        if self.t[0] <= 0:
            z[0], d[0] = -1e9, 0
        return z, d

    def parameters(self, theta):
        return {"log_mu": float(theta[0]), "log_sigma": softplus(theta[1]) + FLOOR}


class Arrays:
    """Windows held in memory: scores weights and their slope."""

    def __init__(self, xt, yt, xv, yv, weight=None):
        self.xt, self.yt, self.xv, self.yv, self.weight = xt, yt, xv, yv, weight

    def score(self, w: np.ndarray, loss: str, delta: float) -> tuple[float, np.ndarray, float]:
        """Training loss, its gradient by the weights, and validation loss."""
        r = self.xt @ w - self.yt
        return loss_value(r, self.weight, loss, delta), self.xt.T @ loss_slope(r, self.weight, loss, delta), loss_value(self.xv @ w - self.yv, None, loss, delta)


class Gram:
    """Products of the windows of both parts, (x'x, x'y, y'y, n), which are all that the squared loss needs."""

    def __init__(self, train, valid):
        self.parts = (train, valid)

    def score(self, w: np.ndarray, loss: str, delta: float) -> tuple[float, np.ndarray, float]:
        if loss != "mse":
            raise ValueError("products of the windows give the squared loss only")
        (xx, xy, yy, n), (vx, vy, vv, m) = self.parts
        return float((w @ xx @ w - 2 * w @ xy + yy) / n), 2 * (xx @ w - xy) / n, float((w @ vx @ w - 2 * w @ vy + vv) / m)


def optimise(family: Family, data, *, loss="huber", delta=1.0, rate=0.05, epochs=800, smoothness=0.0) -> dict[str, Any]:
    """Best weights by validation loss over the epochs, with both losses and the parameters; data scores weights (see Arrays)."""
    theta, adam, best = family.start().astype(float), None, None
    adam = Adam(len(theta), rate)
    for _ in range(epochs):
        z, d = family.logits(theta)
        w = softmax(z)
        train, g, valid = data.score(w, loss, delta)
        if best is None or valid < best["validation_loss"]:
            best = {"weights": w.copy(), "train_loss": train, "validation_loss": valid, "parameters": family.parameters(theta)}
        if smoothness and len(w) > 1:
            step = np.diff(w)
            s = np.zeros(len(w))
            s[1:] += step
            s[:-1] -= step
            g = g + smoothness * 2 * s / len(step)
        theta = adam.step(theta, d.T @ (w * (g - (w * g).sum())))
    return best


def initial_parameters(kind: str, times: np.ndarray, options: dict[str, Any] | None = None) -> dict[str, float]:
    """Where a fit of the family starts from."""
    options = dict(options or {})
    if kind == "delayed_exponential":
        delay = options.pop("init_delay", None)
        options.pop("delays", None)
        return DelayedExponential(times, (times[0] + times[-1]) / 2 if delay is None else delay, **options).starting()
    if kind == "erlang":
        ks = options.pop("shape_k_candidates", tuple(range(1, 9)))
        return Erlang(times, min(ks), **options).starting()
    family = {"exponential": Exponential, "gamma": Gamma, "lognormal": LogNormal}.get(kind)
    return family(times, **options).starting() if family else {}


def fit_data(kind: str, times: np.ndarray, data, *, options: dict[str, Any] | None = None, **how) -> dict[str, Any]:
    """Fit one family; the searched ones (Erlang shapes, delays) rank by validation, training loss, then the smaller value.

    All delays are searched, so init_delay only settles ties: the delay next to it is taken.
    """
    options = dict(options or {})
    if kind == "simplex":
        return optimise(Simplex(times), data, **how)
    if kind == "exponential":
        return optimise(Exponential(times, **options), data, **how)
    if kind == "gamma":
        return optimise(Gamma(times, **options), data, **how)
    if kind == "lognormal":
        return optimise(LogNormal(times, **options), data, **how)
    if kind == "erlang":
        ks = options.pop("shape_k_candidates", tuple(range(1, 9)))
        return min((optimise(Erlang(times, k, **options), data, **how) | {"order": k} for k in ks), key=lambda r: (r["validation_loss"], r["train_loss"], r["order"]))
    if kind == "delayed_exponential":
        wanted, delays = options.pop("init_delay", None), options.pop("delays", times)
        order = lambda t: t if wanted is None else (abs(t - wanted), t)
        return min((optimise(DelayedExponential(times, t, **options), data, **how) | {"order": order(t)} for t in delays), key=lambda r: (r["validation_loss"], r["train_loss"], r["order"]))
    raise ValueError(f"unknown learner family {kind!r}")


def fit(kind: str, times: np.ndarray, xt, yt, xv, yv, *, weight=None, **how) -> dict[str, Any]:
    """fit_data on arrays."""
    return fit_data(kind, times, Arrays(xt, yt, xv, yv, weight), **how)
