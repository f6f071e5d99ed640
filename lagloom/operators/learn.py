"""Learners: fit a lag kernel between an input and a target column.

Windows are prepared as DataFrames.  The fixed-delay and uniform learners are
aggregates.  The others solve a small numeric problem per fit: all fits of a
call (pairs, candidates, folds, bootstrap replicates) are rows of one
DataFrame and run as grouped tasks; an exception becomes that row's error.
Fits of over ``MAX_CELLS`` window cells are not moved to one worker, see ``solve_all``.
"""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagloom.functions.kernels import FAMILIES, Kernel, LearnedKernel
from lagloom.operators import solve, windows
from lagloom.operators.diagnose import IdentifiabilityReport, identifiability
from lagloom.operators.windows import BaselineComparison, FitData
from lagloom.sources.grid import INDEX, check_order, grid_index, lag_to_steps, resolve_dt

MAX_CELLS = 100_000_000
FIT_COLUMNS = "fit_id string, weights array<double>, train_loss double, validation_loss double, parameters string, error string"


@dataclass(frozen=True)
class FitDiagnostics:
    train_loss: float
    validation_loss: float
    input_variance: float
    target_variance: float
    kernel_weight_sum: float
    mean_lag: float
    p50_lag: float
    p90_lag: float
    tail_mass: float
    boundary_mass_fraction: float


@dataclass(frozen=True)
class KernelFitResult:
    kernel: Kernel
    fit_diagnostics: FitDiagnostics
    identifiability_report: IdentifiabilityReport
    baseline_comparison: BaselineComparison
    kernel_shape_summary: dict[str, float] | None = None
    fit_data_coverage_summary: dict[str, float] | None = None
    fit_provenance: dict[str, Any] | None = None


@dataclass
class Learner:
    """Settings shared by all learners; lags are steps or durations."""

    max_lag: Any
    min_lag: Any = 0
    dt: Any = None
    loss: str = "huber"
    smoothness_penalty: float = 0.0
    seed: int | None = None
    validation_fraction: float = 0.2
    learning_rate: float = 0.05
    max_epochs: int = 800
    huber_delta: float = 1.0
    options: dict[str, Any] = field(default_factory=dict)
    family: str = "simplex"

    def __post_init__(self):
        if self.loss not in ("huber", "mse"):
            raise ValueError("loss must be 'huber' or 'mse'")
        if self.smoothness_penalty < 0:
            raise ValueError("smoothness_penalty must not be negative")
        if not 0 < self.validation_fraction < 0.5:
            raise ValueError("validation_fraction must be in (0, 0.5)")
        if self.learning_rate <= 0 or self.max_epochs <= 0 or self.huber_delta <= 0:
            raise ValueError("learning_rate, max_epochs and huber_delta must be positive")

    def steps(self, dt: float) -> list[int]:
        low, high = (lag_to_steps(v, dt=dt, name=n) for v, n in ((self.min_lag, "min_lag"), (self.max_lag, "max_lag")))
        if high < low:
            raise ValueError("max_lag is below min_lag")
        return list(range(low, high + 1))

    def how(self) -> dict[str, Any]:
        return {"loss": self.loss, "delta": self.huber_delta, "rate": self.learning_rate, "epochs": self.max_epochs, "smoothness": self.smoothness_penalty}

    def prepare(self, df: DataFrame, *, input_col: str, target_col: str, time_col: str) -> tuple[FitData, float]:
        for c in (input_col, target_col, time_col):
            if c not in df.columns:
                raise ValueError(f"column {c!r} is not in the frame")
        dt = resolve_dt(df, time_col=time_col, dt=self.dt)
        if INDEX not in df.columns:
            df = grid_index(df, time_col=time_col, dt=dt)
        return windows.prepare(df, input_col=input_col, target_col=target_col, lags=self.steps(dt), validation_fraction=self.validation_fraction), dt

    def fit(self, df: DataFrame, *, input_col: str, target_col: str, time_col: str, order_by_time: bool = True, input_order_col: str | None = None) -> KernelFitResult:
        """Rows are put in order of time; without order_by_time, input_order_col tells the order they came in, and time must not fall along it."""
        if not order_by_time:
            if input_order_col is None:
                raise ValueError("without order_by_time an input_order_col must tell the order of the rows")
            check_order(df, time_col=time_col, input_order_col=input_order_col)
        data, dt = self.prepare(df, input_col=input_col, target_col=target_col, time_col=time_col)
        with data:
            found = self.solve(data, dt)
            if found["error"]:
                raise RuntimeError(found["error"])
            return assemble(self, data, dt, found, f"{input_col}->{target_col}", {"input_col": input_col, "target_col": target_col, "time_col": time_col})

    def solve(self, data: FitData, dt: float) -> dict[str, Any]:
        return solve_all({"fit": (self, data, dt)})["fit"]


class FrameData:
    """Windows of any size where they lie: an epoch is one aggregate of losses and gradient."""

    def __init__(self, data: FitData):
        self.windows, self.lags = data.windows.select("x", "y", "is_train"), len(data.lags)

    def score(self, w: np.ndarray, loss: str, delta: float) -> tuple[float, np.ndarray, float]:
        def part(batches):
            for pdf in batches:
                if len(pdf):
                    x, y, train = np.stack(pdf["x"].to_numpy()).astype(float), pdf["y"].to_numpy(float), pdf["is_train"].to_numpy(bool)
                    r = x @ w - y
                    value = [solve.loss_value(r[k], None, loss, delta) * k.sum() if k.any() else 0.0 for k in (train, ~train)]
                    slope = x[train].T @ (solve.loss_slope(r[train], None, loss, delta) * train.sum()) if train.any() else np.zeros(len(w))
                    yield pd.DataFrame([[int(train.sum()), value[0], int((~train).sum()), value[1], *slope]], columns=names)

        names = ["n", "t", "m", "v", *[f"g{k}" for k in range(self.lags)]]
        schema = ", ".join(f"{c} {'long' if c in 'nm' else 'double'}" for c in names)
        r = self.windows.mapInPandas(part, schema).agg(*[F.sum(c).alias(c) for c in names]).first()
        return r.t / r.n, np.array([r[f"g{k}"] for k in range(self.lags)]) / r.n, r.v / r.m


def gram_of(data: FitData) -> solve.Gram:
    """Products of the windows, summed where they lie: enough for the squared loss, at any size."""
    size = len(data.lags)

    def part(batches):
        for pdf in batches:
            for train, g in pdf.groupby("is_train"):
                x, y = np.stack(g["x"].to_numpy()).astype(float), g["y"].to_numpy(float)
                whole = np.concatenate([x, y[:, None]], 1)
                products = whole.T @ whole
                yield pd.DataFrame({"is_train": bool(train), "pos": np.arange(products.size), "v": products.ravel(), "n": len(g)})

    rows = data.windows.select("x", "y", "is_train").mapInPandas(part, "is_train boolean, pos int, v double, n long")
    found = rows.groupBy("is_train", "pos").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).orderBy("is_train", "pos").collect()  # two squares of the lags
    out = []
    for train in (True, False):
        mine = [r for r in found if r.is_train == train]
        m = np.array([r.v for r in mine]).reshape(size + 1, size + 1)
        out.append((m[:size, :size], m[:size, size], m[size, size], mine[0].n))
    return solve.Gram(*out)


def solve_all(fits: dict[str, tuple[Learner, FitData, float]]) -> dict[str, dict[str, Any]]:
    """Results of several fits by name; a failure is kept as text.

    Fits whose windows fit a worker (``MAX_CELLS``) are solved together as one
    grouped job.  Larger ones stay where they lie: with the squared loss as
    products of the windows, with the Huber loss by one aggregate an epoch.
    """
    out, rows, plans = {}, None, {}
    for name, (learner, data, dt) in fits.items():
        try:
            if type(learner).solve is not Learner.solve:
                out[name] = learner.solve(data, dt)
            elif data.n_windows * len(data.lags) > MAX_CELLS:
                held = gram_of(data) if learner.loss == "mse" else FrameData(data)
                r = solve.fit_data(learner.family, np.array(data.lags) * dt, held, options=learner.options, **learner.how())
                out[name] = {"weights": tuple(r["weights"].tolist()), "train_loss": r["train_loss"], "validation_loss": r["validation_loss"], "parameters": r["parameters"], "error": None}
            else:
                part = data.windows.select(F.lit(name).alias("fit_id"), "window_id", "x", "y", "is_train")
                rows = part if rows is None else rows.unionByName(part)
                plans[name] = (learner.family, data.lags, dt, learner.options, learner.how())
        except Exception as e:  # one failed fit must not end the others
            out[name] = {"weights": None, "train_loss": None, "validation_loss": None, "parameters": {}, "error": f"{type(e).__name__}: {e}"}
    if rows is not None:
        out |= {r.fit_id: row_result(r) for r in solve_grouped(rows, plans).collect()}  # one row a fit
    return out


def row_result(row) -> dict[str, Any]:
    return {"weights": None if row.weights is None else tuple(row.weights), "train_loss": row.train_loss, "validation_loss": row.validation_loss, "parameters": json.loads(row.parameters) if row.parameters else {}, "error": row.error}


def solve_grouped(rows: DataFrame, plans: dict[str, tuple]) -> DataFrame:
    """Solve every fit_id of rows (fit_id, window_id, x, y, is_train[, count]) by its plan (family, lags, dt, options, how)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        fit_id = pdf["fit_id"].iloc[0]
        try:
            family, lags, dt, options, how = plans[fit_id]
            pdf = pdf.sort_values("window_id", kind="stable")
            train = pdf["is_train"].to_numpy(bool)
            x, y = np.stack(pdf["x"].to_numpy()).astype(float), pdf["y"].to_numpy(float)
            weight = pdf["count"].to_numpy(float)[train] if "count" in pdf else None
            if weight is not None:
                keep = weight > 0
                r = solve.fit(family, np.array(lags) * dt, x[train][keep], y[train][keep], x[~train], y[~train], options=options, weight=weight[keep], **how)
            else:
                r = solve.fit(family, np.array(lags) * dt, x[train], y[train], x[~train], y[~train], options=options, **how)
            got = (fit_id, r["weights"].tolist(), r["train_loss"], r["validation_loss"], json.dumps(r["parameters"]), None)
        except Exception as e:  # reported in the row: one failed fit must not end the others
            got = (fit_id, None, None, None, None, f"{type(e).__name__}: {e}")
        return pd.DataFrame([got], columns=["fit_id", "weights", "train_loss", "validation_loss", "parameters", "error"])

    return rows.groupBy("fit_id").applyInPandas(one, FIT_COLUMNS)


def parametric_provenance(learner: Learner, lags: list[int], dt: float, parameters: dict[str, Any]) -> dict[str, Any]:
    """What a parametric fit adds to its provenance: family, parameters found and started from, and the lag times."""
    if learner.family not in FAMILIES:
        return {}
    times = np.array(lags, float) * dt
    start = {k: v if isinstance(v, int) else float(v) for k, v in solve.initial_parameters(learner.family, times, learner.options).items()}
    return {"parametric_family": learner.family, "parametric_parameters": parameters, "parametric_initial_parameters": start, "parametric_conversion_status": "ok", "parametric_conversion_message": None, "parametric_lag_time_grid_seconds": tuple(times.tolist())}


def summarize_parametric_kernel(kernel: Kernel, *, family: str, parameters: dict[str, Any]) -> dict[str, Any]:
    """The kernel's summary with its family and parameters."""
    return {**kernel.summary(), "parametric_family": family, "parametric_parameters": dict(parameters)}


def assemble(learner: Learner, data: FitData, dt: float, found: dict[str, Any], name: str, provenance: dict[str, Any]) -> KernelFitResult:
    """Kernel, diagnostics, baselines, warnings and provenance of a solved fit."""
    lags = data.lags
    kernel = LearnedKernel(tuple(found["weights"]), tuple(lags), dt, lags[0], lags[-1], name, learner.family, found["parameters"]).validate()
    losses = windows.baseline_losses(data, learner.loss, learner.huber_delta)
    baseline = windows.compare_baselines(losses, found["validation_loss"])
    kinds = F.concat(F.transform("x", lambda v: F.struct(F.lit("x").alias("kind"), v.alias("v"))), F.array(F.struct(F.lit("y").alias("kind"), F.col("y").alias("v"))))
    variance = {r.kind: r.v for r in data.windows.select(F.explode(kinds).alias("r")).groupBy("r.kind").agg(F.var_pop("r.v").alias("v")).collect()}
    cells, target = variance["x"], variance["y"]
    s = kernel.summary()
    diagnostics = FitDiagnostics(found["train_loss"], found["validation_loss"], cells, target, sum(kernel.weights), s["mean_lag"], s["p50_lag"], s["p90_lag"], s["tail_mass"], kernel.weights[0] + kernel.weights[-1])
    shape = kernel.shape()
    report = identifiability(diagnostics, baseline, kernel, shape)
    n_rows = data.n_rows
    coverage = {"total_rows": n_rows, "valid_windows": data.n_windows, "train_windows": data.n_train, "validation_windows": data.n_windows - data.n_train, "retained_row_fraction": data.n_windows / max(1, n_rows), "retained_window_fraction": data.n_windows / max(1, n_rows - lags[-1])}
    settings = {"family": learner.family, "loss": learner.loss, "huber_delta": learner.huber_delta, "validation_fraction": learner.validation_fraction, "learning_rate": learner.learning_rate, "max_epochs": learner.max_epochs, "smoothness_penalty": learner.smoothness_penalty, "dt": dt, "min_lag_steps": lags[0], "max_lag_steps": lags[-1], "parameters": found["parameters"], **parametric_provenance(learner, lags, dt, found["parameters"]), **provenance}
    digest = hashlib.sha256(json.dumps([settings, list(kernel.weights)], sort_keys=True, default=str).encode()).hexdigest()[:16]
    return KernelFitResult(kernel, diagnostics, report, baseline, shape, coverage, settings | {"fit_result_id": digest})


def _learner(family: str, *names: str):
    def make(max_lag, **kwargs):
        options = {k: kwargs.pop(k) for k in names if k in kwargs}
        for k, v in options.items():
            low = 0 if k in ("init_delay", "init_log_mu") else math.ulp(0)
            if k.startswith("init") and v is not None and not (math.isfinite(v) and (v >= low or k == "init_log_mu")):
                raise ValueError(f"{k} must be finite and {'not negative' if low == 0 else 'positive'}")
        return Learner(max_lag, family=family, options={k: v for k, v in options.items() if v is not None}, **kwargs)

    make.__doc__ = f"A learner of the {family} family."
    return make


SimplexKernelLearner = _learner("simplex")
ExponentialKernelLearner = _learner("exponential", "init_rate_lambda")
GammaKernelLearner = _learner("gamma", "init_shape_alpha", "init_rate_beta")
DelayedExponentialKernelLearner = _learner("delayed_exponential", "init_delay", "init_rate_lambda")
LogNormalKernelLearner = _learner("lognormal", "init_log_mu", "init_log_sigma")
ErlangKernelLearner = _learner("erlang", "shape_k_candidates", "init_rate_beta")


class FixedDelayKernelLearner(Learner):
    """The single lag with the lowest validation loss, then training loss, then delay: one aggregate."""

    def __init__(self, max_lag, **kwargs):
        super().__init__(max_lag, family="fixed_delay", **kwargs)

    def solve(self, data: FitData, dt: float) -> dict[str, Any]:
        best = windows.single_lag_losses(data, self.loss, self.huber_delta).orderBy("validation_loss", "train_loss", "lag_step").first()
        return {"weights": tuple(1.0 if k == best.lag_step else 0.0 for k in data.lags), "train_loss": best.train_loss, "validation_loss": best.validation_loss, "parameters": {"delay_steps": best.lag_step}, "error": None}


class UniformKernelLearner(Learner):
    """Equal weights: nothing is searched."""

    def __init__(self, max_lag, **kwargs):
        super().__init__(max_lag, family="uniform", **kwargs)

    def solve(self, data: FitData, dt: float) -> dict[str, Any]:
        w = [1 / len(data.lags)] * len(data.lags)
        train, valid = windows.weight_losses(data, {"u": w}, self.loss, self.huber_delta)["u"]
        return {"weights": tuple(w), "train_loss": train, "validation_loss": valid, "parameters": {}, "error": None}


@dataclass(frozen=True)
class SharedPairFitResult:
    pair_id: str
    input_col: str
    target_col: str
    fit_result: KernelFitResult | None
    error: str | None = None

    @property
    def succeeded(self) -> bool:
        return self.fit_result is not None and self.error is None


@dataclass(frozen=True)
class SharedKernelFitResult:
    pairs: tuple[SharedPairFitResult, ...]

    def __post_init__(self):
        if len({p.pair_id for p in self.pairs}) < len(self.pairs):
            raise ValueError("pair ids must be unique")

    def pair_ids(self) -> tuple[str, ...]:
        return tuple(p.pair_id for p in self.pairs)

    def get_pair(self, pair_id: str) -> SharedPairFitResult:
        for p in self.pairs:
            if p.pair_id == pair_id:
                return p
        raise KeyError(pair_id)

    def get_pair_result(self, pair_id: str) -> KernelFitResult:
        p = self.get_pair(pair_id)
        if not p.succeeded:
            raise ValueError(f"pair {pair_id!r} was not fitted: {p.error}")
        return p.fit_result

    def summary(self) -> dict[str, dict[str, Any]]:
        return {p.pair_id: {"status": "ok", "input_col": p.input_col, "target_col": p.target_col, "kernel": p.fit_result.kernel.summary(), "validation_loss": p.fit_result.fit_diagnostics.validation_loss, "warnings": p.fit_result.identifiability_report.warnings} if p.succeeded else {"status": "failed", "input_col": p.input_col, "target_col": p.target_col, "error": p.error or "unknown"} for p in self.pairs}

    def to_kernels(self, *, names: dict[str, str] | None = None) -> dict[str, Kernel]:
        out: dict[str, Kernel] = {}
        for p in self.pairs:
            name = (names or {}).get(p.pair_id, p.pair_id)
            if not name or name in out:
                raise ValueError(f"kernel name {name!r} is empty or taken")
            out[name] = self.get_pair_result(p.pair_id).kernel
        return out


class SharedSimplexKernelLearner:
    """Independent simplex fits of several (input, target) pairs, solved together; a pair's failure is kept as text."""

    def __init__(self, max_lag, **kwargs):
        self.learner = Learner(max_lag, family="simplex", **kwargs)

    def fit(self, df: DataFrame, *, pairs: list[tuple[str, str]], time_col: str, pair_names: list[str] | None = None) -> SharedKernelFitResult:
        prepared, fits, out = {}, {}, []
        for n, (a, b) in enumerate(pairs):
            pid = (pair_names[n].strip() if pair_names else "") or f"{a}->{b}"
            try:
                data, dt = self.learner.prepare(df, input_col=a, target_col=b, time_col=time_col)
            except ValueError as e:
                prepared[pid] = (a, b, None, None, str(e))
                continue
            prepared[pid], fits[pid] = (a, b, data, dt, None), (self.learner, data, dt)
        solved = solve_all(fits)
        for pid, (a, b, data, dt, error) in prepared.items():
            found = solved.get(pid)
            error = error or (found["error"] if found else "no result")
            fit = None if error else assemble(self.learner, data, dt, found, pid, {"input_col": a, "target_col": b, "time_col": time_col})
            out.append(SharedPairFitResult(pid, a, b, fit, error))
            if data is not None:
                data.release()
        return SharedKernelFitResult(tuple(out))
