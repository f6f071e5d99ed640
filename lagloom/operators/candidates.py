"""Candidate kernels: describe, fit, compare and select."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagloom.functions import kernels as K
from lagloom.operators import learn, windows
from lagloom.sources.grid import INDEX, grid_index, lag_to_steps, resolve_dt

TYPES = ("learner", "fixed_kernel", "baseline")
LEARNED = ("simplex", "gamma", "exponential")
FIXED = ("fixed_delay", "uniform", *K.FAMILIES)
BASELINES = ("no_lag", "best_single_lag")
TOLERANCE, FRACTION = 0.02, 0.2
COMPARISON = "candidate_id string, family string, candidate_type string, succeeded boolean, validation_loss double, train_loss double, mean_lag double, p50_lag double, p90_lag double, tail_mass double, warning_count long, warning_codes string, n_parameters long, beats_no_lag boolean, beats_best_single_lag boolean, error string"


@dataclass(frozen=True)
class KernelCandidate:
    candidate_id: str
    family: str
    candidate_type: str
    max_lag: Any = None
    min_lag: Any = 0
    parameters: dict[str, Any] = field(default_factory=dict)
    metadata: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self):
        if not self.candidate_id.strip() or not self.family.strip():
            raise ValueError("candidate_id and family must not be empty")
        if self.candidate_type not in TYPES:
            raise ValueError(f"candidate_type must be one of {TYPES}")
        json.dumps([self.parameters, self.metadata])

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict[str, Any]) -> KernelCandidate:
        return cls(**d)


@dataclass(frozen=True)
class KernelCandidateSet:
    input_col: str
    target_col: str
    time_col: str
    candidates: tuple[KernelCandidate, ...]
    baseline_names: tuple[str, ...] = BASELINES
    selection_metric: str = "validation_loss"
    metadata: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self):
        if not self.candidates:
            raise ValueError("no candidates")
        if len({c.candidate_id for c in self.candidates}) < len(self.candidates):
            raise ValueError("candidate ids must be unique")

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> KernelCandidateSet:
        d = json.loads(text)
        return cls(**(d | {"candidates": tuple(KernelCandidate.from_dict(c) for c in d["candidates"]), "baseline_names": tuple(d["baseline_names"])}))


@dataclass
class CandidateResult:
    candidate: KernelCandidate
    kernel: K.Kernel | None = None
    fit_result: Any = None
    validation_loss: float | None = None
    train_loss: float | None = None
    no_lag: float | None = None
    best_single_lag: float | None = None
    warning_codes: tuple[str, ...] = ()
    n_parameters: int | None = None
    error: str | None = None
    context: tuple = ()

    @property
    def succeeded(self) -> bool:
        return self.error is None


def fixed_kernel(c: KernelCandidate, dt: float) -> K.Kernel:
    """The kernel a fixed candidate describes."""
    low, high = lag_to_steps(c.min_lag, dt=dt), lag_to_steps(c.max_lag, dt=dt)
    p = dict(c.parameters)
    if c.family == "fixed_delay":
        delay = p.pop("delay_steps", None)
        if delay is None or p:
            raise ValueError("a fixed delay takes exactly delay_steps")
        return K.FixedDelayKernel(delay, high, dt, low, c.candidate_id)
    if c.family == "uniform":
        if p:
            raise ValueError("a uniform kernel takes no parameters")
        return K.UniformKernel(high, dt, low, c.candidate_id)
    return K.parametric_kernel(c.family, high, dt, low, c.candidate_id, **p)


def fit_kernel_candidates(df: DataFrame, candidates: KernelCandidateSet, *, loss: str = "huber", huber_delta: float = 1.0, max_epochs: int = 800) -> list[CandidateResult]:
    """Fit or score every candidate on the same windows; a candidate's failure is kept in its result."""
    cs = candidates
    dt = resolve_dt(df, time_col=cs.time_col, dt=None)
    if INDEX not in df.columns:
        df = grid_index(df, time_col=cs.time_col, dt=dt)
    prepared: dict[tuple[int, int], windows.FitData] = {}
    losses: dict[tuple[int, int], dict[str, float]] = {}
    out = [CandidateResult(c) for c in cs.candidates]
    learners: dict[str, tuple] = {}

    def kept(r: CandidateResult, step) -> None:
        try:
            step()
        except Exception as e:  # one candidate's failure must not end the others
            r.error = f"{type(e).__name__}: {e}"

    def describe(r: CandidateResult) -> None:
        c = r.candidate
        low, high = lag_to_steps(c.min_lag, dt=dt), lag_to_steps(c.max_lag, dt=dt)
        if (low, high) not in prepared:
            prepared[low, high] = windows.prepare(df, input_col=cs.input_col, target_col=cs.target_col, lags=list(range(low, high + 1)), validation_fraction=FRACTION, own_x0_scaling=True)
        data = prepared[low, high]
        r.context = (dt, FRACTION, data.n_windows, data.n_train, loss, huber_delta)
        if c.candidate_type == "learner":
            if c.family not in LEARNED:
                raise ValueError(f"no learner for family {c.family!r}")
            own = {k: v for k, v in c.parameters.items() if k in ("max_epochs", "learning_rate", "smoothness_penalty")}
            options = {k: v for k, v in c.parameters.items() if k not in own}
            learners[c.candidate_id] = (learn.Learner(high, min_lag=low, loss=loss, huber_delta=huber_delta, family=c.family, options=options, **{"max_epochs": max_epochs, **own}), data, dt)
            return
        if (low, high) not in losses:
            losses[low, high] = windows.baseline_losses(data, loss, huber_delta)
        base = losses[low, high]
        r.no_lag, r.best_single_lag = base["no_lag"], base["best_single_lag"]
        if c.candidate_type == "baseline":
            if c.family not in BASELINES:
                raise ValueError(f"unknown baseline {c.family!r}")
            r.validation_loss, r.n_parameters = base[c.family], 0
        else:
            if c.family not in FIXED:
                raise ValueError(f"unknown kernel family {c.family!r}")
            r.kernel = fixed_kernel(c, dt)
            r.train_loss, r.validation_loss = windows.weight_losses(data, {"k": list(r.kernel.weights)}, loss, huber_delta)["k"]
            r.n_parameters = len(c.parameters)

    def finish(r: CandidateResult) -> None:
        c, found = r.candidate, solved[r.candidate.candidate_id]
        if found["error"]:
            raise RuntimeError(found["error"])
        learner, data, _ = learners[c.candidate_id]
        r.fit_result = learn.assemble(learner, data, dt, found, c.candidate_id, {"input_col": cs.input_col, "target_col": cs.target_col, "time_col": cs.time_col})
        r.kernel, b = r.fit_result.kernel, r.fit_result.baseline_comparison
        r.train_loss, r.validation_loss = found["train_loss"], found["validation_loss"]
        r.no_lag, r.best_single_lag = b.no_lag_validation_loss, b.best_single_lag_validation_loss
        r.warning_codes = r.fit_result.identifiability_report.warning_codes
        r.n_parameters = len(data.lags) if c.family == "simplex" else len(found["parameters"])

    for r in out:
        kept(r, lambda r=r: describe(r))
    solved = learn.solve_all(learners)  # one grouped job
    for r in out:
        if r.candidate.candidate_id in learners:
            kept(r, lambda r=r: finish(r))
    for data in prepared.values():
        data.release()
    return out


def comparison_order() -> list[Column]:
    """Succeeded first, finite losses first, then loss, number of parameters and id."""
    loss = F.col("validation_loss")
    good = F.coalesce(loss.isNotNull() & ~F.isnan(loss) & (F.abs(loss) < float("inf")), F.lit(False))
    return [F.desc("succeeded"), good.desc(), F.coalesce(loss, F.lit(float("inf"))).asc(), F.coalesce("n_parameters", F.lit(10**9)).asc(), F.asc("candidate_id")]


def comparison_rows(results: list[CandidateResult]) -> list[tuple]:
    rows = []
    for r in results:
        d = r.fit_result.fit_diagnostics if r.fit_result else None
        beats = [None if r.validation_loss is None or v is None or r.candidate.candidate_type == "baseline" else r.validation_loss < v for v in (r.no_lag, r.best_single_lag)]
        rows.append((r.candidate.candidate_id, r.candidate.family, r.candidate.candidate_type, r.succeeded, r.validation_loss, r.train_loss, *([d.mean_lag, d.p50_lag, d.p90_lag, d.tail_mass] if d else [None] * 4), len(r.warning_codes), "|".join(r.warning_codes), r.n_parameters, *beats, r.error))
    return rows


def comparison_table(spark, results: list[CandidateResult]) -> DataFrame:
    return spark.createDataFrame(comparison_rows(results), COMPARISON).orderBy(*comparison_order())


def comparison_compact_dict(results: list[CandidateResult]) -> dict[str, Any]:
    good = [r for r in results if r.succeeded and r.validation_loss is not None and math.isfinite(r.validation_loss)]
    best = min(good, key=lambda r: (r.validation_loss, r.n_parameters or 0, r.candidate.candidate_id), default=None)
    return {"candidates": len(results), "succeeded": sum(r.succeeded for r in results), "failed": sum(not r.succeeded for r in results), "best": best.candidate.candidate_id if best else None, "best_validation_loss": best.validation_loss if best else None}


def comparison_compact_text(results: list[CandidateResult]) -> str:
    return "; ".join(f"{k}={v}" for k, v in comparison_compact_dict(results).items())


def simplicity(candidate_type: str, family: str) -> int:
    """Fixed kernels before empirical ones, these before parametric fits, baselines last."""
    return {"fixed_kernel": 1, "baseline": 4}.get(candidate_type, 2 if family == "simplex" else 3)


def gates(r: CandidateResult) -> list[str]:
    """Why a candidate cannot be selected."""
    out = []
    if not r.succeeded:
        return ["failed"]
    if r.candidate.candidate_type == "baseline":
        out.append("baseline")
    if r.validation_loss is None or not math.isfinite(r.validation_loss):
        return [*out, "no_finite_loss"]
    if r.no_lag is None or not r.validation_loss < r.no_lag:
        out.append("not_better_than_no_lag")
    if r.best_single_lag is None or not r.validation_loss < r.best_single_lag:
        out.append("not_better_than_best_single_lag")
    if r.candidate.candidate_type == "learner" and not r.fit_result.identifiability_report.is_reliable:
        out.append("not_reliable")
    return out


@dataclass(frozen=True)
class Selection:
    selected: CandidateResult | None
    reasons: dict[str, list[str]]
    pool: tuple[str, ...]


def select_kernel_candidate(results: list[CandidateResult], *, loss_tolerance_fraction: float = TOLERANCE) -> Selection:
    """Among candidates that pass the gates and are within the tolerance of the best: the simplest, then lowest loss, then id."""
    if loss_tolerance_fraction < 0:
        raise ValueError("loss_tolerance_fraction must not be negative")
    if len({r.context for r in results if r.succeeded}) > 1:
        raise ValueError("candidates were scored on different data, splits or losses")
    reasons = {r.candidate.candidate_id: gates(r) for r in results}
    good = [r for r in results if not reasons[r.candidate.candidate_id]]
    if not good:
        return Selection(None, reasons, ())
    least = min(r.validation_loss for r in good)
    pool = [r for r in good if (r.validation_loss - least) / max(least, 1e-12) <= loss_tolerance_fraction]
    best = min(pool, key=lambda r: (simplicity(r.candidate.candidate_type, r.candidate.family), r.validation_loss, r.candidate.candidate_id))
    return Selection(best, reasons, tuple(sorted(r.candidate.candidate_id for r in pool)))


def select_frame(table: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """The same choice on a comparison table of fixed kernels, as a plan: candidate_id, validation_loss, rank."""
    ok = table.where(F.col("succeeded") & (F.col("candidate_type") != "baseline") & F.coalesce(F.col("beats_no_lag") & F.col("beats_best_single_lag"), F.lit(False)) & (F.col("warning_count") == 0))
    rank = F.when(F.col("candidate_type") == "fixed_kernel", 1).when(F.col("family") == "simplex", 2).otherwise(3)
    least = ok.agg(F.min("validation_loss").alias("least"))
    pool = ok.join(F.broadcast(least), (F.col("validation_loss") - F.col("least")) / F.greatest("least", F.lit(1e-12)) <= tolerance)
    return pool.select("candidate_id", "family", "validation_loss", rank.alias("simplicity_rank")).orderBy("simplicity_rank", "validation_loss", "candidate_id").limit(1)
