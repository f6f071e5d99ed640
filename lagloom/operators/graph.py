"""Lag evidence from causal graphs: cubes of marks by target, source and lag, as tables."""

from __future__ import annotations

import json
import math
import warnings
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagloom.functions.kernels import Kernel
from lagloom.operators.candidates import LEARNED, KernelCandidate, KernelCandidateSet

#: Marks of a directed link from source to target.
DIRECTED = ("-->", "->")
SUPPORT_MARGIN = 0.20
#: Families of a candidate set where none are named.
FAMILIES = ("simplex", "fixed_delay", "gamma", "exponential", "delayed_exponential", "lognormal", "erlang")
#: Codes that warnings begin with.
NO_LINKS, EMPTY_RANGE, CONTEMPORANEOUS, UNKNOWN_MARK, VALUES, OUTSIDE = "NO_LINKS_FOUND", "LAG_RANGE_EMPTY", "CONTEMPORANEOUS_LINK_IGNORED", "GRAPH_MARK_UNSUPPORTED", "VALUES_NOT_KERNEL_WEIGHTS", "KERNEL_SUPPORT_THRESHOLD_BREACH"


class GraphPayloadError(ValueError):
    """The payload is not a cube of the wanted shape."""


def parse_cube(payload: Any, kind: type = str) -> list[list[list[Any]]]:
    """A square cube [target][source][lag] from lists or JSON text."""
    cube = json.loads(payload) if isinstance(payload, str) else payload
    if hasattr(cube, "tolist"):
        cube = cube.tolist()
    if not isinstance(cube, list) or not cube:
        raise GraphPayloadError("the cube is empty or no list")
    n, depth = len(cube), None
    for row in cube:
        if not isinstance(row, list) or len(row) != n:
            raise GraphPayloadError("the first two axes must have the same length")
        for cell in row:
            if not isinstance(cell, list) or not cell or depth not in (None, len(cell)):
                raise GraphPayloadError("all cells must have the same number of lags")
            depth = len(cell)
            for v in cell:
                if kind is str and not isinstance(v, str) or kind is float and (isinstance(v, bool) or not isinstance(v, (int, float))):
                    raise GraphPayloadError(f"a value is no {kind.__name__}")
    return cube


def payload_of(payload: Any, key: str) -> Any:
    """The cube of a payload that may also be a mapping of results, or the JSON text of one."""
    if isinstance(payload, str):
        try:
            payload = json.loads(payload)
        except json.JSONDecodeError as e:
            raise GraphPayloadError(f"{key} is not JSON") from e
    if isinstance(payload, dict):
        if key not in payload:
            raise GraphPayloadError(f"the payload has no {key}")
        payload = payload[key]
    return payload


def ordered_names(names: Any, n: int) -> list[str]:
    """Names by position, from a sequence or from a mapping of positions (numbers or their text) to names."""
    if isinstance(names, dict):
        by = {int(k): v for k, v in names.items()}
        if sorted(by) != list(range(n)):
            raise GraphPayloadError("a variable has no name")
        names = [by[k] for k in range(n)]
    names = list(names)
    if len(names) != n or len(set(names)) < n or not all(isinstance(v, str) and v.strip() for v in names):
        raise GraphPayloadError("one distinct, non-empty name is needed for each variable")
    return names


def lag_range(lag_step_range: tuple[int, int] | None) -> tuple[int, int | None]:
    if lag_step_range is None:
        return 1, None
    low, high = lag_step_range
    if any(isinstance(v, bool) or not isinstance(v, int) for v in (low, high)) or low < 0 or high < low:
        raise ValueError("lag_step_range must be two whole numbers, the first not negative and not above the second")
    return max(1, low), high


def cube_frame(spark: SparkSession, cube: list, names: Any, value: str, kind: str) -> DataFrame:
    """target, source, tau and the value, by three explodes."""
    df = spark.createDataFrame([(cube, ordered_names(names, len(cube)))], f"cube array<array<array<{kind}>>>, names array<string>")
    a = df.select("names", F.posexplode("cube").alias("i", "rows"))
    b = a.select("names", "i", F.posexplode("rows").alias("j", "cells"))
    c = b.select("names", "i", "j", F.posexplode("cells").alias("tau", value))
    return c.select(F.col("names")[F.col("i")].alias("target"), F.col("names")[F.col("j")].alias("source"), "tau", value)


def parent_pairs(spark: SparkSession, graph: Any, names: Any, *, marks: tuple[str, ...] = DIRECTED, lag_step_range: tuple[int, int] | None = None) -> DataFrame:
    """source, target, tau, mark of every lagged link with one of the marks; what is left out is warned of."""
    cube = [[[m.strip() for m in cell] for cell in row] for row in parse_cube(payload_of(graph, "graph"))]
    marks = tuple(m.strip() for m in marks)
    if not marks or not all(marks):
        raise ValueError("marks must be non-empty texts")
    low, high = lag_range(lag_step_range)
    inside = [m for row in cube for cell in row for tau, m in enumerate(cell) if m and tau >= low and (high is None or tau <= high)]
    if any(cell[0] for row in cube for cell in row):
        warnings.warn(f"{CONTEMPORANEOUS}: links without lag are left out", stacklevel=2)
    if any(m not in marks for m in inside):
        warnings.warn(f"{UNKNOWN_MARK}: links with other marks are left out", stacklevel=2)
    if not any(m in marks for m in inside):
        warnings.warn(f"{NO_LINKS}: the graph has no lagged directed link", stacklevel=2)
    links = cube_frame(spark, cube, names, "mark", "string").where(F.col("mark").isin(*marks) & (F.col("tau") >= low))
    if high is not None:
        links = links.where(F.col("tau") <= high)
    return links.select("source", "target", "tau", "mark").orderBy("source", "target", "tau")


def lag_candidates(spark: SparkSession, graph: Any, names: Any, *, p_matrix: Any = None, val_matrix: Any = None, marks: tuple[str, ...] = DIRECTED, lag_step_range: tuple[int, int] | None = None) -> DataFrame:
    """The links with p_value and value, null where no matrix is given."""
    if val_matrix is not None:
        warnings.warn(f"{VALUES}: values are scores of links, not kernel weights", stacklevel=2)
    shape = lambda c: (len(c), len(c[0][0]))
    wanted = shape(parse_cube(payload_of(graph, "graph")))
    out = parent_pairs(spark, graph, names, marks=marks, lag_step_range=lag_step_range)
    keys = ["target", "source", "tau"]
    for name, key, matrix in (("p_value", "p_matrix", p_matrix), ("value", "val_matrix", val_matrix)):
        if matrix is None:
            out = out.withColumn(name, F.lit(None).cast("double"))
            continue
        cube = [[[float(v) for v in cell] for cell in row] for row in parse_cube(payload_of(matrix, key), float)]
        if shape(cube) != wanted:
            raise GraphPayloadError(f"{key} has another shape than the graph")
        out = out.join(cube_frame(spark, cube, names, name, "double"), keys, "left")
    return out.select("source", "target", "tau", "mark", "p_value", "value").orderBy("source", "target", "tau")


def link_summary(links: DataFrame) -> DataFrame:
    """One row a pair: lag_steps (distinct, ascending), their extremes and whole median, marks, and extremes of p-values and values."""
    links = links.select("*", *[F.lit(None).cast("double").alias(c) for c in ("p_value", "value") if c not in links.columns])
    one = links.where("tau > 0").groupBy("source", "target").agg(F.array_sort(F.collect_set("tau")).alias("lag_steps"), F.array_sort(F.collect_set("mark")).alias("graph_marks"), *[f(c).alias(f"{c}_{n}") for c in ("p_value", "value") for n, f in (("min", F.min), ("max", F.max))])
    n = F.size("lag_steps")
    middle = F.expr("(lag_steps[(size(lag_steps) - 1) div 2] + lag_steps[size(lag_steps) div 2]) div 2")
    return one.select("source", "target", "lag_steps", F.col("lag_steps")[0].alias("min_lag_steps"), F.col("lag_steps")[n - 1].alias("max_lag_steps"), middle.cast("int").alias("median_lag_steps"), "graph_marks", "p_value_min", "p_value_max", "value_min", "value_max")


def lag_candidate_table(links: DataFrame) -> DataFrame:
    """source, target, n_links, min_tau, max_tau, taus (ascending) of each pair."""
    return links.groupBy("source", "target").agg(F.count("*").alias("n_links"), F.min("tau").alias("min_tau"), F.max("tau").alias("max_tau"), F.array_sort(F.collect_list("tau")).alias("taus")).orderBy("source", "target")


def lag_candidate_dict(links: DataFrame) -> dict[str, list[int]]:
    return {f"{r.source}->{r.target}": list(r.taus) for r in lag_candidate_table(links).collect()}


def lag_candidate_text(links: DataFrame) -> str:
    return "; ".join(f"{k}: {','.join(map(str, v))}" for k, v in lag_candidate_dict(links).items())


def candidate_set_from_links(links: DataFrame, *, source: str, target: str, time_col: str, dt: float = 1.0, families: tuple[str, ...] | None = None, family_defaults: dict[str, dict[str, Any]] | None = None) -> KernelCandidateSet:
    """Candidates whose lags are those of the pair's links, with parameters from the middle lag or from family_defaults, and both baselines.

    Without a link of the pair there is a warning and the baselines alone.
    """
    rows = link_summary(links.where((F.col("source") == source) & (F.col("target") == target))).collect()  # one row
    made, meta = [], {"source_col": source, "target_col": target}
    name = lambda f: f"{source}_to_{target}_{f}"
    if not rows:
        warnings.warn(f"{EMPTY_RANGE}: the pair has no lagged link; only baselines are returned", stacklevel=2)
        meta, single, summary = {**meta, "generated_reason": EMPTY_RANGE}, 1, None
    else:
        summary = {k: v for k, v in rows[0].asDict().items() if v is not None and k not in ("source", "target")}
        low, high, single = summary["min_lag_steps"], summary["max_lag_steps"], summary["median_lag_steps"]
        rate = 1.0 / (max(1, high) * dt)
        usual = {"simplex": {"max_epochs": 100, "learning_rate": 0.05}, "uniform": {}, "fixed_delay": {"delay_steps": single}, "gamma": {"init_shape_alpha": 2.0, "init_rate_beta": rate}, "exponential": {"init_rate_lambda": rate}, "delayed_exponential": {"delay": single * dt, "rate_lambda": rate}, "erlang": {"shape_k": 2, "rate_beta": rate}, "lognormal": {"log_mu": 0.0, "log_sigma": 1.0}}
        for f in families or FAMILIES:
            if f not in usual:
                warnings.warn(f"family {f!r} is not known and left out", stacklevel=2)
                continue
            learned = f in LEARNED
            given = {f"init_{k}" if learned and f"init_{k}" in usual[f] else k: v for k, v in (family_defaults or {}).get(f, {}).items()}
            made.append(KernelCandidate(name(f), f, "learner" if learned else "fixed_kernel", high, low, {**usual[f], **given}, {**meta, "graph_marks": summary["graph_marks"], "lag_evidence_summary": summary}))
    made.append(KernelCandidate(name("no_lag"), "no_lag", "baseline", 0, 0, {}, meta))
    made.append(KernelCandidate(name("best_single_lag"), "best_single_lag", "baseline", single, single, {}, meta))
    return KernelCandidateSet(source, target, time_col, tuple(made), metadata={"source": "graph", "baseline_names": ["no_lag", "best_single_lag"], "lag_evidence_summary": summary})


def support_mass(kernel: DataFrame, links: DataFrame, threshold: float = SUPPORT_MARGIN) -> DataFrame:
    """One row: mass on the lags of the links, mass off them, shared lags, and whether the mass off them is within the threshold."""
    if threshold < 0:
        raise ValueError("threshold must not be negative")
    lags = links.select(F.col("tau").alias("lag_step")).distinct().withColumn("hit", F.lit(True))
    r = kernel.join(lags, "lag_step", "left").agg(F.coalesce(F.sum(F.when(F.col("hit"), F.col("weight"))), F.lit(0.0)).alias("mass_inside"), F.coalesce(F.sum(F.when(F.col("hit").isNull(), F.col("weight"))), F.lit(0.0)).alias("mass_outside"), F.count("hit").alias("n_shared_lags"))
    return r.withColumn("agrees", F.col("mass_outside") <= threshold)


def compare_kernel_to_links(spark: SparkSession, kernel: Kernel, links: DataFrame | list[int], threshold: float = SUPPORT_MARGIN) -> dict[str, Any]:
    """Where the kernel's mass lies against the links (a table, or lags); a warning where too much lies elsewhere."""
    if not isinstance(links, DataFrame):
        links = spark.createDataFrame([(int(k),) for k in links], "tau int")
    found = support_mass(kernel.validate().to_frame(spark), links, threshold).first().asDict()
    if not found["agrees"]:
        warnings.warn(f"{OUTSIDE}: {found['mass_outside']:.6f} of the kernel's mass lies off the links, over {threshold:.6f}", stacklevel=2)
    return {**found, "threshold": threshold}
