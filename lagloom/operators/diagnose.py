"""Identifiability rules, and tables that report on fits."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: Rule thresholds.
FLAT_VARIANCE = 1e-8
NO_LAG_IMPROVEMENT, GAP_RATIO, BOUNDARY, DIFFUSE_ENTROPY, DIFFUSE_MAX, MARGIN = 0.05, 2.0, 0.35, 0.85, 0.20, 0.05

MESSAGES = {
    "INPUT_TOO_FLAT": "the input hardly varies",
    "TARGET_TOO_FLAT": "the target hardly varies",
    "WEAK_NO_LAG_IMPROVEMENT": "the kernel hardly improves on no lag",
    "LARGE_VALIDATION_GAP": "the validation loss is far above the training loss",
    "BOUNDARY_PILED_KERNEL": "much of the weight lies on the first or last lag",
    "DIFFUSE_KERNEL": "the weights are spread almost evenly",
    "BEST_SINGLE_LAG_BEATS_LEARNED": "one single lag does better",
    "UNIFORM_BASELINE_BEATS_LEARNED": "equal weights do better",
    "EXPONENTIAL_BASELINE_BEATS_LEARNED": "an exponential decay does better",
}
HIGH = {"INPUT_TOO_FLAT", "TARGET_TOO_FLAT", "LARGE_VALIDATION_GAP"}


@dataclass(frozen=True)
class IdentifiabilityReport:
    warnings: tuple[str, ...]
    is_reliable: bool
    warning_codes: tuple[str, ...] = ()
    warning_severity_by_code: dict[str, str] = field(default_factory=dict)


def identifiability(diagnostics, baseline, kernel, shape: dict[str, float]) -> IdentifiabilityReport:
    """Which of the nine rules a fit breaks; none broken is reliable."""
    d, valid = diagnostics, diagnostics.validation_loss
    behind = lambda v: v is not None and (valid - v) / max(valid, 1e-8) >= MARGIN
    rules = {
        "INPUT_TOO_FLAT": d.input_variance < FLAT_VARIANCE,
        "TARGET_TOO_FLAT": d.target_variance < FLAT_VARIANCE,
        "WEAK_NO_LAG_IMPROVEMENT": (baseline.no_lag_validation_loss - valid) / max(baseline.no_lag_validation_loss, 1e-8) < NO_LAG_IMPROVEMENT,
        "LARGE_VALIDATION_GAP": valid / max(d.train_loss, 1e-8) > GAP_RATIO,
        "BOUNDARY_PILED_KERNEL": max(kernel.weights[0], kernel.weights[-1]) >= BOUNDARY,
        "DIFFUSE_KERNEL": shape["normalized_entropy"] >= DIFFUSE_ENTROPY and shape["max_weight"] <= DIFFUSE_MAX,
        "BEST_SINGLE_LAG_BEATS_LEARNED": behind(baseline.best_single_lag_validation_loss),
        "UNIFORM_BASELINE_BEATS_LEARNED": behind(baseline.uniform_validation_loss),
        "EXPONENTIAL_BASELINE_BEATS_LEARNED": behind(baseline.exponential_validation_loss),
    }
    codes = tuple(k for k, broken in rules.items() if broken)
    return IdentifiabilityReport(tuple(MESSAGES[c] for c in codes), not codes, codes, {c: "high" if c in HIGH else "medium" for c in codes})


def _baselines(b, optional: bool = True) -> list[tuple[str, float]]:
    rows = [("learned", b.learned_validation_loss), ("no_lag", b.no_lag_validation_loss), ("best_single_lag", b.best_single_lag_validation_loss)]
    rows += [("uniform", b.uniform_validation_loss), ("exponential", b.exponential_validation_loss)] if optional else []
    return [(k, v) for k, v in rows if v is not None]


def baseline_comparison_rows(b, optional: bool = True) -> list[tuple]:
    learned = b.learned_validation_loss
    return [(k, float(v), float(learned), float((learned - v) / max(abs(learned), 1e-12)), k != "learned" and v < learned, k == "learned") for k, v in _baselines(b, optional)]


def baseline_comparison_table(spark: SparkSession, b, *, include_optional_baselines: bool = True) -> DataFrame:
    return spark.createDataFrame(baseline_comparison_rows(b, include_optional_baselines), "baseline string, validation_loss double, learned_validation_loss double, delta_fraction_vs_learned double, beats_learned boolean, is_learned boolean")


def baseline_comparison_compact_dict(b) -> dict[str, Any]:
    return {r[0]: {"validation_loss": r[1], "delta_fraction_vs_learned": r[3], "beats_learned": r[4]} for r in baseline_comparison_rows(b)}


def baseline_comparison_compact_text(b) -> str:
    return "; ".join(f"{r[0]}={r[1]:.6g}" + (" (better)" if r[4] else "") for r in baseline_comparison_rows(b))


def warning_summary_table(spark: SparkSession, report: IdentifiabilityReport) -> DataFrame:
    codes = [*report.warning_codes, *[""] * len(report.warnings)]
    rows = [(k, codes[k], report.warning_severity_by_code.get(codes[k], ""), m) for k, m in enumerate(report.warnings)]
    return spark.createDataFrame(rows, "warning_index long, warning_code string, warning_severity string, warning_message string")


def warning_summary_compact_dict(report: IdentifiabilityReport) -> dict[str, Any]:
    return {"is_reliable": report.is_reliable, "warning_count": len(report.warnings), "warning_codes": report.warning_codes, "warning_severity_by_code": dict(report.warning_severity_by_code)}


def warning_summary_compact_text(report: IdentifiabilityReport) -> str:
    if not report.warnings:
        return "warnings: none"
    return "warnings: " + ", ".join(f"{c}:{report.warning_severity_by_code.get(c, 'unknown')}" for c in report.warning_codes)


def fit_result_warning_summary_table(spark: SparkSession, result) -> DataFrame:
    return warning_summary_table(spark, result.identifiability_report)


def fit_result_baseline_summary_table(spark: SparkSession, result) -> DataFrame:
    return baseline_comparison_table(spark, result.baseline_comparison)


#: Provenance that fits must share to be compared.
COMPARABLE = ("dt", "validation_fraction", "loss", "huber_delta", "min_lag_steps", "max_lag_steps", "input_col", "target_col")
PARAMETRIC = ("gamma", "exponential")


def _comparable(fits: dict[str, Any]) -> list[str]:
    """Family names, simplex first, then by name; raises if the fits are not comparable."""
    if not fits:
        raise ValueError("no fit results")
    keys = {tuple((f.fit_provenance or {}).get(k) for k in COMPARABLE) for f in fits.values()}
    if len(keys) > 1:
        raise ValueError("the fits differ in data, grid, split or loss")
    return sorted(fits, key=lambda k: (k != "simplex", k))


def learner_diagnostic_comparison_table(spark: SparkSession, fits: dict[str, Any], *, include_baselines: bool = True) -> DataFrame:
    rows = []
    for k in _comparable(fits):
        rows.append((k, "learned", k, float(fits[k].fit_diagnostics.validation_loss), 0.0, k in PARAMETRIC))
        if include_baselines:
            rows += [(k, "baseline", r[0], r[1], r[3], k in PARAMETRIC) for r in baseline_comparison_rows(fits[k].baseline_comparison) if r[0] != "learned"]
    return spark.createDataFrame(rows, "learner_family string, row_type string, candidate string, validation_loss double, delta_fraction_vs_learned double, is_parametric_family boolean")


def learner_diagnostic_warning_table(spark: SparkSession, fits: dict[str, Any], *, warning_margin: float = 0.05) -> DataFrame:
    """Parametric fits that validate worse than the simplex fit or a simple baseline by the margin."""
    if warning_margin < 0:
        raise ValueError("warning_margin must not be negative")
    rows = []
    for k in _comparable(fits):
        if k not in PARAMETRIC:
            continue
        own, b = float(fits[k].fit_diagnostics.validation_loss), fits[k].baseline_comparison
        against = [("PARAMETRIC_WORSE_THAN_SIMPLEX", "simplex", float(fits["simplex"].fit_diagnostics.validation_loss))] if "simplex" in fits else []
        against += [("PARAMETRIC_WORSE_THAN_BASELINE", n, float(v)) for n, v in (("no_lag", b.no_lag_validation_loss), ("best_single_lag", b.best_single_lag_validation_loss))]
        for code, name, loss in against:
            worse = (own - loss) / max(abs(loss), 1e-12)
            if worse >= warning_margin:
                rows.append((k, code, name, float(warning_margin), float(worse), own, loss))
    return spark.createDataFrame(rows, "learner_family string, warning_code string, reference string, warning_margin double, delta_fraction_worse double, candidate_validation_loss double, reference_validation_loss double")
