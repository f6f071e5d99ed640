"""Deterministic synthetic signals with known kernels, and small process simulations.

A scenario is a row of ``SCENARIOS``: rows, seconds a step, seed, noise and the
true kernel.  Signals are made with NumPy's default generator on the driver (a
few hundred rows) and handed to Spark as a frame.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagloom.functions import kernels as K

START = datetime(2020, 1, 1)


@dataclass(frozen=True)
class Synthetic:
    data: pd.DataFrame
    true_kernels: dict[str, K.Kernel]
    scenario: dict[str, Any]

    def frame(self, spark: SparkSession) -> DataFrame:
        """The data as a frame with its row index."""
        rows = self.data.copy()
        rows["_idx"] = np.arange(len(rows))
        return spark.createDataFrame(rows)


def discrete(lags: list[int], weights: list[float], dt: float, name: str = "true") -> K.Kernel:
    total = sum(weights)
    if total <= 0:
        raise ValueError("kernel weights must have a positive sum")
    return K.Kernel(tuple(w / total for w in weights), tuple(lags), dt, lags[0], lags[-1], name)


def apply_partial(signal: np.ndarray, kernel: K.Kernel) -> np.ndarray:
    """Weighted sum over the window; history that is not there counts as zero."""
    out = np.zeros(len(signal))
    for k, w in zip(kernel.lag_steps, kernel.weights):
        if k < len(signal):
            out[k:] += w * signal[: len(signal) - k]
    return out


def times(n: int, dt: float) -> list[datetime]:
    if n <= 0 or dt <= 0:
        raise ValueError("rows and dt must be positive")
    return [START + timedelta(seconds=i * dt) for i in range(n)]


def single_pair(kernel: K.Kernel, n_rows: int, dt: float, seed: int, noise: float, name: str) -> Synthetic:
    """Noise and a slow wave as the input; the target is the kernel's sum over it, with noise.

    The shares 0.65 and 0.35, the three turns of the wave and the order of draws are fixed values: published losses depend on them.
    """
    rng = np.random.default_rng(seed)
    x = 0.65 * rng.normal(size=n_rows) + 0.35 * np.sin(np.linspace(0, 6 * np.pi, n_rows))
    y = apply_partial(x, kernel)
    if noise > 0:
        y = y + rng.normal(0, noise, n_rows)
    data = pd.DataFrame({"time": times(n_rows, dt), "input_signal": x, "target_signal": y})
    return Synthetic(data, {"input_signal->target_signal": kernel}, {"name": name, "seed": seed, "n_rows": n_rows, "dt": dt, "noise": noise})


def _family(family: str, low: int, high: int, **parameters):
    return lambda dt: K.parametric_kernel(family, high, dt, low, "true", **parameters)


def _lags(lags: list[int], weights: list[float]):
    return lambda dt: discrete(lags, weights, dt)


#: Name, rows, dt, seed, noise, true kernel.
SCENARIOS = {
    "single_delay": (240, 1.0, 7, 0.02, _lags([6], [1.0])),
    "spread_delay": (240, 1.0, 11, 0.03, _lags([4, 5, 6, 7], [0.15, 0.35, 0.35, 0.15])),
    "noisy_identifiable": (320, 1.0, 19, 0.08, _lags([2, 3, 4], [0.25, 0.55, 0.20])),
    "weak_identifiability": (320, 1.0, 23, 0.5, _lags([2, 3, 4], [0.3, 0.4, 0.3])),
    "missing_window": (260, 1.0, 31, 0.03, _lags([3, 4, 5], [0.25, 0.50, 0.25])),
    "boundary_kernel": (280, 1.0, 37, 0.02, _lags([0, 1, 2, 3, 4, 5, 6], [0.72, 0.10, 0.06, 0.04, 0.03, 0.03, 0.02])),
    "diffuse_kernel": (300, 1.0, 41, 0.03, _lags(list(range(11)), [1.0] * 11)),
    "baseline_challenge": (360, 1.0, 43, 0.04, _lags([5, 6, 7, 8], [0.10, 0.40, 0.35, 0.15])),
    "exponential_kernel": (360, 60.0, 47, 0.03, _family("exponential", 1, 8, rate_lambda=0.02)),
    "gamma_kernel": (420, 60.0, 53, 0.03, _family("gamma", 1, 10, shape_alpha=3.0, rate_beta=0.06)),
    "delayed_exponential_kernel": (360, 60.0, 67, 0.03, _family("delayed_exponential", 0, 10, delay=180.0, rate_lambda=0.03)),
    "lognormal_kernel": (420, 60.0, 71, 0.03, _family("lognormal", 1, 12, log_mu=5.0, log_sigma=0.5)),
    "erlang_kernel": (420, 60.0, 73, 0.03, _family("erlang", 0, 12, shape_k=3, rate_beta=0.05)),
    "misspecified_parametric": (420, 60.0, 59, 0.02, _family("gamma", 1, 10, shape_alpha=6.0, rate_beta=0.08)),
    "weak_parametric_identifiability": (360, 60.0, 61, 0.8, _family("gamma", 1, 10, shape_alpha=2.5, rate_beta=0.05)),
    # the gallery with published losses
    "conveyor": (420, 60.0, 101, 0.015, _lags([6], [1.0])),
    "cstr": (480, 60.0, 102, 0.02, _family("exponential", 0, 10, rate_lambda=0.025)),
    "tanks_in_series": (520, 60.0, 103, 0.02, _family("erlang", 0, 12, shape_k=3, rate_beta=0.045)),
    "flotation_banks": (520, 60.0, 104, 0.025, _family("lognormal", 1, 14, log_mu=5.6, log_sigma=0.45)),
    "closed_loop_crushing": (520, 60.0, 105, 0.025, _family("delayed_exponential", 0, 14, delay=240.0, rate_lambda=0.025)),
    "bounded_hold_up_tank": (520, 60.0, 106, 0.02, _lags(list(range(11)), [1.0] * 11)),
}


def make_dataset(name: str, *, n_rows: int | None = None, dt: float | None = None, seed: int | None = None, noise: float | None = None) -> Synthetic:
    """One of the scenarios, with other rows, step, seed or noise if given."""
    rows, step, first, level, kernel = SCENARIOS[name]
    rows, step, first, level = (a if b is None else b for a, b in zip((rows, step, first, level), (n_rows, dt, seed, noise)))
    out = single_pair(kernel(step), rows, step, first, level, name)
    if name == "missing_window":
        out.data.loc[90 : min(rows, 104) - 1, ["input_signal", "target_signal"]] = np.nan
    return out


def make_multi_pair_dataset(n_rows: int = 280, dt: float = 1.0, seed: int = 29, noise: float = 0.04) -> Synthetic:
    """Three independent pairs."""
    rng, columns, true = np.random.default_rng(seed), {"time": times(n_rows, dt)}, {}
    for p, kernel in {"a": discrete([2, 3], [0.65, 0.35], dt), "b": discrete([4, 5, 6], [0.2, 0.6, 0.2], dt), "c": discrete([1], [1.0], dt)}.items():
        x = rng.normal(size=n_rows)
        columns[f"input_signal_{p}"] = x
        columns[f"target_signal_{p}"] = apply_partial(x, kernel) + rng.normal(0, noise, n_rows)
        true[f"input_signal_{p}->target_signal_{p}"] = kernel
    return Synthetic(pd.DataFrame(columns), true, {"name": "multi_pair", "seed": seed, "n_rows": n_rows, "dt": dt})


def _unit(kind: str, dt: float) -> K.Kernel:
    return {
        "tank": lambda: K.tank_kernel(0.8, 24, dt),
        "plug_flow": lambda: discrete([8], [1.0], dt, "plug_flow"),
        "spread": lambda: discrete([4, 5, 6, 7], [0.15, 0.35, 0.35, 0.15], dt, "spread"),
        "flotation_bank": lambda: K.convolve(K.convolve(K.tank_kernel(0.65, 16, dt), K.tank_kernel(0.65, 16, dt)), K.tank_kernel(0.65, 16, dt), "flotation_bank"),
        "closed_loop": lambda: K.recycle(PRODUCT, crusher_pass(dt), PASSES, "closed_loop"),
    }[kind]()


UNITS = ("tank", "plug_flow", "spread", "flotation_bank", "closed_loop")


#: The crusher of the closed loop: share that leaves as product, passes, and the kernel of one pass (lags and weights): fixed values.
PRODUCT, PASSES = 0.35, 12
PASS_LAGS, PASS_WEIGHTS = [1, 2, 3], [0.2, 0.6, 0.2]


def crusher_pass(dt: float) -> K.Kernel:
    return discrete(PASS_LAGS, PASS_WEIGHTS, dt, "crusher_pass")


def closed_loop_masses(feed: np.ndarray, dt: float) -> dict[str, np.ndarray]:
    """What the screen discharges, pass by pass: each pass gets what the one before returned; a part is product, the rest goes back."""
    one, again, discharge = crusher_pass(dt), np.asarray(feed, float), np.zeros(len(feed))
    for _ in range(PASSES):
        passed = apply_partial(again, one)
        discharge, again = discharge + passed, (1 - PRODUCT) * passed
    return {"crusher_screen_discharge_mass": discharge, "product_mass": PRODUCT * discharge, "recycle_mass": (1 - PRODUCT) * discharge}


def make_unit_dataset(kind: str, n_rows: int = 256, dt: float = 1.0, feed_mass: float = 1000.0) -> Synthetic:
    """One process unit: constant feed, a grade that steps and waves, and the grade that leaves the unit; the closed loop has its masses."""
    t = np.arange(n_rows)
    grade = 1.0 + 0.08 * np.sin(6 * np.pi * t / n_rows) + 0.1 * (t >= n_rows // 2)
    kernel = _unit(kind, dt)
    data = pd.DataFrame({"time": times(n_rows, dt), "feed_mass": feed_mass, "feed_grade": grade, "target_grade": apply_partial(grade, kernel), **(closed_loop_masses(np.full(n_rows, feed_mass), dt) if kind == "closed_loop" else {})})
    return Synthetic(data, {kind: kernel}, {"name": kind, "n_rows": n_rows, "dt": dt, "feed_mass": feed_mass})


def make_plant_dataset(n_rows: int = 512, dt: float = 60.0, seed: int = 107) -> Synthetic:
    """A flowsheet of crusher, mill with recycle, cyclone, three flotation banks and a cleaner, with two ore types."""
    rng = np.random.default_rng(seed)
    turn = 2 * np.pi * np.arange(n_rows) / n_rows
    feed = 900 + 60 * np.sin(3 * turn) + 25 * np.sin(7 * turn + 1)
    grade = 1 + 0.12 * np.cos(turn) + rng.normal(0, 0.005, n_rows)
    ore = np.where(np.arange(n_rows) < n_rows // 2, "B", "A")
    crusher, mill = discrete([1, 2, 3], [1.0, 2.0, 1.0], dt), K.recycle(0.5, discrete([2, 3, 4], [1.0, 3.0, 1.0], dt), 12)
    cyclone, cell, cleaner = discrete([0, 1], [1.0, 2.0], dt), K.tank_kernel(0.6, 16, dt), K.tank_kernel(0.5, 12, dt)
    mass = {"crusher_output_mass": apply_partial(feed, crusher)}
    mass["ball_mill_product_mass"] = apply_partial(mass["crusher_output_mass"], mill)
    delayed = apply_partial(mass["ball_mill_product_mass"], cyclone)
    mass["cyclone_overflow_mass"], mass["cyclone_underflow_recycle_mass"] = 0.75 * delayed, 0.25 * delayed
    stream = mass["cyclone_overflow_mass"]
    for k in (1, 2, 3):
        stream = mass[f"flotation_bank_{k}_mass"] = apply_partial(stream, cell)
    mass["cleaner_product_mass"] = apply_partial(stream, cleaner)
    whole = crusher
    for k in (mill, cyclone, cell, cell, cell, cleaner):
        whole = K.convolve(whole, k, "feed_to_cleaner")
    recovered = apply_partial(grade, whole) * (1 + 0.04 * apply_partial((ore == "A").astype(float), whole))
    data = pd.DataFrame({"time": times(n_rows, dt), "feed_mass": feed, "feed_copper_grade": grade, "ore_type": ore, **mass, "cleaner_copper_grade": recovered + rng.normal(0, 0.003, n_rows)})
    return Synthetic(data, {"feed_copper_grade->cleaner_copper_grade": whole}, {"name": "plant", "seed": seed, "n_rows": n_rows, "dt": dt})


def genealogy(series: DataFrame, kernel: DataFrame, *, mass_col: str, unit: str, path: str) -> DataFrame:
    """Which earlier rows an output is made of: one row for each output time and lag.

    series has _idx and the feed's mass; the kernel table is broadcast (a few
    hundred rows) and expands each source row, so nothing is sorted or collected.
    """
    lags = kernel.agg(F.collect_list(F.struct(F.col("lag_step").alias("lag"), F.col("weight").alias("weight"))).alias("lags"), F.max("lag_step").alias("reach"))
    span = series.agg(F.max("_idx").alias("last"))
    rows = series.select(F.col("_idx").alias("source_time"), F.col(mass_col).alias("source_mass")).join(F.broadcast(lags), F.lit(True)).join(F.broadcast(span), F.lit(True))
    out = rows.select("source_time", "source_mass", "reach", "last", F.explode("lags").alias("k"))
    out = out.withColumn("output_time", F.col("source_time") + F.col("k.lag")).where("output_time <= last")
    return out.select("output_time", "source_time", F.lit(unit).alias("unit"), F.lit(path).alias("path"), "source_mass", (F.col("source_mass") * F.col("k.weight")).alias("contribution_mass"), F.col("k.weight").alias("contribution_fraction"), (F.col("output_time") < F.col("reach")).alias("is_warmup"))


def mass_closure(table: DataFrame) -> DataFrame:
    """output_time, total fraction and mass of each output."""
    return table.groupBy("output_time", "is_warmup").agg(F.sum("contribution_fraction").alias("total_fraction"), F.sum("contribution_mass").alias("total_mass"), F.count("*").alias("n_sources"))
