"""Moving-block bootstrap of kernel fits.

Replicates resample blocks of training windows; the validation windows stay.
Block starts come from NumPy's default generator, so a seed fixes them.  A
replicate is the number of times each window was drawn: rows are weighted, not
repeated, and all replicates of all candidates are solved as one grouped job.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagloom.functions.kernels import Kernel
from lagloom.operators import learn, windows
from lagloom.operators.candidates import LEARNED, TOLERANCE, CandidateResult, fixed_kernel, simplicity

QUANTILES = (0.025, 0.975)
SAMPLE_WEIGHTS = "bootstrap_id long, candidate_id string, lag_step long, lag_time double, weight double"
SAMPLE_PARAMETERS = "bootstrap_id long, candidate_id string, parameter_name string, parameter_value double"
SAMPLE_LAGS = "bootstrap_id long, candidate_id string, mean_lag double, p50_lag double, p90_lag double, tail_mass double"
STABLE_SHARE = 0.8


@dataclass(frozen=True)
class BlockedBootstrapConfig:
    n_bootstrap: int
    block_length: int
    seed: int = 0

    def __post_init__(self):
        if self.n_bootstrap <= 0 or self.block_length <= 0:
            raise ValueError("n_bootstrap and block_length must be positive")


def block_starts(n_train: int, config: BlockedBootstrapConfig) -> np.ndarray:
    """Starts of the blocks of each replicate (rows): as many as n_train windows take, in the order of the generator's draws."""
    length = config.block_length
    if length > n_train:
        raise ValueError("a block is longer than the training windows")
    return np.random.default_rng(config.seed).integers(0, n_train - length + 1, (config.n_bootstrap, -(-n_train // length)))


def blocked_splits(n_train: int, config: BlockedBootstrapConfig) -> list[np.ndarray]:
    """Window numbers of each replicate: blocks at random starts, cut to n_train."""
    return [(s[:, None] + np.arange(config.block_length)).ravel()[:n_train] for s in block_starts(n_train, config)]


def splits_frame(spark: SparkSession, n_train: int, config: BlockedBootstrapConfig) -> DataFrame:
    """bootstrap_id, window_id, count: how often each replicate drew each window.  The driver makes the block starts, Spark the windows."""
    starts = block_starts(n_train, config)
    b, n = np.indices(starts.shape).reshape(2, -1)
    blocks = spark.createDataFrame(pd.DataFrame({"bootstrap_id": b, "start": starts.ravel(), "n": np.minimum(config.block_length, n_train - n * config.block_length)}))
    drawn = blocks.select("bootstrap_id", F.explode(F.expr("sequence(start, start + n - 1)")).alias("window_id"))
    return drawn.groupBy("bootstrap_id", "window_id").count()


@dataclass
class BootstrapResult:
    """One entry a replicate and candidate: weights or error, losses and parameters."""

    spark: SparkSession
    config: BlockedBootstrapConfig
    dt: float
    lags: list[int]
    samples: list[dict[str, Any]]
    original: dict[str, Kernel]
    selected: dict[int, str | None]

    def _good(self, candidate_id: str | None = None) -> list[dict[str, Any]]:
        rows = [s for s in self.samples if s["error"] is None and (candidate_id is None or s["candidate_id"] == candidate_id)]
        return sorted(rows, key=lambda s: (s["candidate_id"], s["bootstrap_id"]))

    def _kernel(self, s) -> Kernel:
        return Kernel(tuple(s["weights"]), tuple(self.lags), self.dt, self.lags[0], self.lags[-1], s["candidate_id"])

    def weight_samples(self, candidate_id: str | None = None) -> DataFrame:
        return self.spark.createDataFrame([(s["bootstrap_id"], s["candidate_id"], int(k), float(k * self.dt), float(w)) for s in self._good(candidate_id) for k, w in zip(self.lags, s["weights"])], SAMPLE_WEIGHTS)

    def parameter_samples(self, candidate_id: str | None = None) -> DataFrame:
        return self.spark.createDataFrame([(s["bootstrap_id"], s["candidate_id"], k, float(v)) for s in self._good(candidate_id) for k, v in sorted(s["parameters"].items())], SAMPLE_PARAMETERS)

    def lag_summary_samples(self, candidate_id: str | None = None) -> DataFrame:
        rows = []
        for s in self._good(candidate_id):
            k = self._kernel(s).summary()
            rows.append((s["bootstrap_id"], s["candidate_id"], k["mean_lag"], k["p50_lag"], k["p90_lag"], k["tail_mass"]))
        return self.spark.createDataFrame(rows, SAMPLE_LAGS)

    def weight_intervals(self, quantiles=QUANTILES) -> DataFrame:
        return interval(self.weight_samples(), ["candidate_id", "lag_step", "lag_time"], "weight", "weight_estimate", quantiles)

    def parameter_intervals(self, quantiles=QUANTILES) -> DataFrame:
        return interval(self.parameter_samples(), ["candidate_id", "parameter_name"], "parameter_value", "estimate", quantiles)

    def lag_intervals(self, quantiles=QUANTILES) -> DataFrame:
        long = self.lag_summary_samples().unpivot(["bootstrap_id", "candidate_id"], ["mean_lag", "p50_lag", "p90_lag", "tail_mass"], "metric", "value")
        return interval(long, ["candidate_id", "metric"], "value", "estimate", quantiles)

    def stability(self, candidate_id: str) -> float:
        return min(1.0, len(self._good(candidate_id)) / self.config.n_bootstrap)

    def selection_shares(self) -> dict[str, float]:
        chosen = [c for c in self.selected.values() if c is not None]
        return {c: chosen.count(c) / len(chosen) for c in sorted(set(chosen))}

    def warnings(self, minimum: int = 2) -> tuple[str, ...]:
        out = []
        for c in sorted({s["candidate_id"] for s in self.samples}):
            if len(self._good(c)) < minimum:
                out.append("BOOTSTRAP_TOO_FEW_SUCCESSES")
        shares = self.selection_shares()
        if len(shares) > 1 and max(shares.values()) < STABLE_SHARE:
            out.append("BOOTSTRAP_FAMILY_UNSTABLE")
        for s in self._good():
            if s["weights"] and max(s["weights"][0], s["weights"][-1]) >= 0.999:
                out.append("BOOTSTRAP_INTERVAL_TOUCHES_BOUNDARY")
                break
        if any(s["family"] in LEARNED and s["family"] != "simplex" and not s["parameters"] for s in self._good()):
            out.append("BOOTSTRAP_PARAMETER_PROVENANCE_MISSING")
        return tuple(dict.fromkeys(out))

    def compact_dict(self) -> dict[str, Any]:
        return {"n_bootstrap": self.config.n_bootstrap, "succeeded": {c: len(self._good(c)) for c in sorted({s["candidate_id"] for s in self.samples})}, "selection_shares": self.selection_shares(), "warnings": self.warnings()}

    def compact_text(self) -> str:
        return "; ".join(f"{k}={v}" for k, v in self.compact_dict().items())


def interval(samples: DataFrame, keys: list[str], value: str, estimate: str, quantiles=QUANTILES) -> DataFrame:
    """Mean, quantile bounds, population deviation and number of the samples of each key."""
    lo, hi = quantiles
    q = F.percentile(value, F.array(F.lit(lo), F.lit(hi)))
    out = samples.groupBy(*keys).agg(F.avg(value).alias(estimate), q.alias("q"), F.stddev_pop(value).alias("bootstrap_std"), F.count("*").alias("n_samples"))
    return out.select(*keys, estimate, F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"), "bootstrap_std", "n_samples").orderBy(*keys)


def bootstrap_kernel_candidates(df: DataFrame, results: list[CandidateResult], *, input_col: str, target_col: str, config: BlockedBootstrapConfig, loss: str = "huber", huber_delta: float = 1.0, max_epochs: int = 200, tolerance: float = TOLERANCE) -> BootstrapResult:
    """Refit learners and score fixed kernels on every replicate, and choose among them each time.

    df has _idx; scaling comes from the original training windows.  Baselines cannot be bootstrapped and are recorded as failed.
    """
    spark = df.sparkSession
    kernels = {r.candidate.candidate_id: r.kernel for r in results if r.kernel is not None}
    first = next(iter(kernels.values()))
    lags, dt = list(first.lag_steps), first.dt
    data = windows.prepare(df, input_col=input_col, target_col=target_col, lags=lags)
    draws = splits_frame(spark, data.n_train, config)
    base = data.windows.select("window_id", "x", "y", "is_train")
    ids = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(config.n_bootstrap - 1).cast("long")))
    drawn = base.where("is_train").join(draws, "window_id").unionByName(base.where("NOT is_train").select("*", ids.alias("bootstrap_id"), F.lit(1).cast("long").alias("count")))
    drawn = drawn.select("bootstrap_id", "window_id", "x", "y", "is_train", "count")
    how = {"loss": loss, "delta": huber_delta, "rate": 0.05, "epochs": max_epochs, "smoothness": 0.0}
    samples, plans, rows = [], {}, None
    for r in results:
        c = r.candidate
        if c.candidate_type == "baseline":
            samples += [{"bootstrap_id": b, "candidate_id": c.candidate_id, "family": c.family, "type": c.candidate_type, "weights": None, "parameters": {}, "validation_loss": None, "error": "baselines are not refitted"} for b in range(config.n_bootstrap)]
        elif c.candidate_type == "fixed_kernel" and r.kernel is not None:
            kernel = fixed_kernel(c, dt)
            valid = windows.weight_losses(data, {"k": list(kernel.weights)}, loss, huber_delta)["k"][1]
            samples += [{"bootstrap_id": b, "candidate_id": c.candidate_id, "family": c.family, "type": c.candidate_type, "weights": list(kernel.weights), "parameters": dict(kernel.parameters), "validation_loss": valid, "error": None} for b in range(config.n_bootstrap)]
        elif c.candidate_type == "learner" and r.kernel is not None:
            part = drawn.withColumn("fit_id", F.concat(F.lit(f"{c.candidate_id}\x1f"), F.col("bootstrap_id").cast("string"))).drop("bootstrap_id")
            rows = part if rows is None else rows.unionByName(part)
            plans |= {f"{c.candidate_id}\x1f{b}": (c.family, lags, dt, c.parameters, how) for b in range(config.n_bootstrap)}
    if rows is not None:
        family = {r.candidate.candidate_id: r.candidate.family for r in results}
        for row in learn.solve_grouped(rows, plans).collect():  # one row a replicate
            cid, b = row.fit_id.split("\x1f")
            found = learn.row_result(row)
            samples.append({"bootstrap_id": int(b), "candidate_id": cid, "family": family[cid], "type": "learner", "weights": list(found["weights"]) if found["weights"] else None, "parameters": found["parameters"], "validation_loss": found["validation_loss"], "error": found["error"]})
    data.release()
    selected: dict[int, str | None] = {}
    for b in range(config.n_bootstrap):
        good = [s for s in samples if s["bootstrap_id"] == b and s["error"] is None]
        if not good:
            selected[b] = None
            continue
        least = min(s["validation_loss"] for s in good)
        pool = [s for s in good if (s["validation_loss"] - least) / max(least, 1e-12) <= tolerance]
        selected[b] = min(pool, key=lambda s: (simplicity(s["type"], s["family"]), s["validation_loss"], s["candidate_id"]))["candidate_id"]
    return BootstrapResult(spark, config, dt, lags, samples, kernels, selected)


def bootstrap_kernel_fit(df: DataFrame, result: CandidateResult, **kwargs) -> BootstrapResult:
    """The bootstrap of one candidate."""
    return bootstrap_kernel_candidates(df, [result], **kwargs)


def select_replicates(scores: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """bootstrap_id, candidate_id chosen, from (bootstrap_id, candidate_id, simplicity_rank, validation_loss), as a plan."""
    least = F.min("validation_loss").over(W.partitionBy("bootstrap_id"))
    pool = scores.withColumn("least", least).where((F.col("validation_loss") - F.col("least")) / F.greatest("least", F.lit(1e-12)) <= tolerance)
    order = W.partitionBy("bootstrap_id").orderBy("simplicity_rank", "validation_loss", "candidate_id")
    return pool.withColumn("n", F.row_number().over(order)).where("n = 1").select("bootstrap_id", "candidate_id")
