"""Out-of-fold features: each fold's kernel is fitted on earlier rows only, and applied to the fold's rows only."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property, reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagloom.functions.kernels import Kernel
from lagloom.operators import candidates as C
from lagloom.operators import learn
from lagloom.operators.features import FeatureEvidenceReport, FeatureRegistry, KernelFeatureBuilder, TransformReport, TransformResult, build_feature_evidence
from lagloom.operators.fir import ident
from lagloom.sources.grid import INDEX, grid_index, resolve_dt


@dataclass(frozen=True)
class ForwardChainingSplitConfig:
    n_folds: int
    min_train_size: int
    validation_size: int
    gap: int = 0
    max_train_size: int | None = None

    def __post_init__(self):
        if min(self.n_folds, self.min_train_size, self.validation_size) <= 0 or self.gap < 0:
            raise ValueError("fold sizes must be positive and the gap not negative")
        if self.max_train_size is not None and self.max_train_size <= 0:
            raise ValueError("max_train_size must be positive")


@dataclass(frozen=True)
class Fold:
    """Row numbers; the end of training is exclusive, validation is [start, end)."""

    fold_id: int
    train_start: int
    train_end: int
    validation_start: int
    validation_end: int
    gap: int


def forward_chaining(n_rows: int, config: ForwardChainingSplitConfig) -> list[Fold]:
    """Folds in time order; raises where the rows do not suffice."""
    c = config
    if c.min_train_size + c.gap + c.n_folds * c.validation_size > n_rows:
        raise ValueError("not enough rows for the folds")
    out = []
    for f in range(c.n_folds):
        start = c.min_train_size + c.gap + f * c.validation_size
        end = start - c.gap
        out.append(Fold(f, max(0, end - c.max_train_size) if c.max_train_size else 0, end, start, start + c.validation_size, c.gap))
    return out


def folds_frame(spark: SparkSession, folds: list[Fold]) -> DataFrame:
    return spark.createDataFrame([(f.fold_id, f.train_start, f.train_end, f.validation_start, f.validation_end, f.gap) for f in folds], "fold_id int, train_start long, train_end long, validation_start long, validation_end long, gap long")


@dataclass
class OutOfFoldResult:
    features: DataFrame
    fold_results: list[dict[str, Any]]
    split_summary: dict[str, Any]
    warnings: list[str] = field(default_factory=list)
    transforms: list[TransformResult] = field(default_factory=list)
    evidence: FeatureEvidenceReport | None = None

    @cached_property
    def fold_reports(self) -> list[TransformReport]:
        """The transform report of every fold that has features."""
        return [t.report for t in self.transforms]

    @cached_property
    def combined_report(self) -> TransformReport:
        """All rows and all folds: missing rows by feature over all rows, the other figures summed over the folds."""
        names = sorted({n for t in self.transforms for n in t.registry.names()})
        every, some = F.lit(True), F.lit(False)
        for n in names:
            every, some = every & ident(n).isNotNull(), some | ident(n).isNotNull()
        r = self.features.agg(F.count("*").alias("n"), F.count_if(every).alias("a"), F.count_if(some).alias("s"), *[F.count_if(ident(n).isNull()).alias(f"m{k}") for k, n in enumerate(names)]).first()
        rows, all_there = r["n"], r["a"] if names else 0
        missing = {n: r[f"m{k}"] for k, n in enumerate(names)}
        self.split_summary |= {"rows_with_features": r["s"], "rows_without_features": rows - r["s"]}
        added = lambda key: reduce(lambda a, b: {k: a.get(k, 0) + b.get(k, 0) for k in {**a, **b}}, (getattr(x, key) for x in self.fold_reports), {})
        by_kernel, warmup = added("missing_rows_by_kernel"), sum(x.warmup_rows for x in self.fold_reports)
        features_of = {k: sum(n.startswith(f"{k}_") for n in names) for k in by_kernel}
        return TransformReport(
            row_count=rows,
            output_row_count=rows,
            warmup_rows=warmup,
            feature_names=tuple(names),
            missing_rows_by_feature=missing,
            zero_denominator_rows_by_feature=added("zero_denominator_rows_by_feature"),
            missing_fraction_by_feature={n: v / rows if rows else 0.0 for n, v in missing.items()},
            missing_rows_by_kernel=by_kernel,
            missing_fraction_by_kernel={k: v / (rows * max(1, features_of[k])) if rows else 0.0 for k, v in by_kernel.items()},
            zero_denominator_rows_by_kernel=added("zero_denominator_rows_by_kernel"),
            warmup_unusable_summary={"input_rows": rows, "warmup_rows": warmup, "rows_after_warmup": max(rows - warmup, 0), "rows_all_features_usable": all_there, "rows_with_any_unusable_feature": rows - all_there},
            collision_naming_summary={"kernel_names": tuple(sorted(by_kernel)), "feature_count_by_kernel": features_of, "total_feature_count": len(names), "has_name_collision": False},
        )

    def report(self) -> dict[str, Any]:
        """Rows with and without features, and missing rows of each feature."""
        r = self.combined_report
        s = self.split_summary
        return {"row_count": r.row_count, "rows_with_features": s["rows_with_features"], "rows_without_features": s["rows_without_features"], "missing_rows_by_feature": r.missing_rows_by_feature}

    def report_frame(self, spark: SparkSession) -> DataFrame:
        """One row a feature: feature_name, missing_rows over all rows, zero_denominator_rows over the folds."""
        r = self.combined_report
        return spark.createDataFrame([(n, r.missing_rows_by_feature[n], r.zero_denominator_rows_by_feature.get(n, 0)) for n in r.feature_names], "feature_name string, missing_rows long, zero_denominator_rows long")


def fixed_oof(df: DataFrame, kernel: Kernel, folds: list[Fold], *, time_col: str, kernel_name: str, numeric_cols=(), category_cols=(), **builder) -> DataFrame:
    """All folds of one fixed kernel in a single pass: folds are series, so each has its own warm-up."""
    table = F.broadcast(folds_frame(df.sparkSession, folds).select("fold_id", "validation_start", "validation_end"))
    inside = df.join(table, (F.col(INDEX) >= F.col("validation_start")) & (F.col(INDEX) < F.col("validation_end")))
    inside = inside.withColumn("_row_idx", F.col(INDEX)).withColumn(INDEX, F.col(INDEX) - F.col("validation_start")).drop("validation_start", "validation_end")
    b = KernelFeatureBuilder({kernel_name: kernel}, time_col=time_col, numeric_cols=list(numeric_cols), category_cols=list(category_cols), series_cols=["fold_id"], **builder)
    result = b.transform_result(inside)
    names = sorted(result.registry.names())
    made = result.augmented.select(F.col("_row_idx").alias(INDEX), "fold_id", *[ident(n) for n in names])
    return df.join(made, INDEX, "left")


def fit_transform_oof(df: DataFrame, *, input_col: str, target_col: str, time_col: str, split_config: ForwardChainingSplitConfig, learner=None, candidate_set: C.KernelCandidateSet | None = None, numeric_cols: list[str] | None = None, category_cols: list[str] = (), kernel_name: str = "oof", select_candidate_per_fold: bool = True, **builder) -> OutOfFoldResult:
    """Fit on each fold's training rows, generate features on its validation rows, and put all rows together.

    Exactly one of learner and candidate_set.  A fold in which no candidate can
    be selected gets null features; without select_candidate_per_fold the lowest
    loss, then id, is taken.  Other errors are raised.
    """
    if (learner is None) == (candidate_set is None):
        raise ValueError("give exactly one of learner and candidate_set")
    if INDEX not in df.columns:
        df = grid_index(df, time_col=time_col, dt=resolve_dt(df, time_col=time_col, dt=None))
    n = df.count()
    folds = forward_chaining(n, split_config)
    chosen = _fold_kernels(df, folds, input_col=input_col, target_col=target_col, time_col=time_col, learner=learner, candidate_set=candidate_set, per_fold=select_candidate_per_fold)
    parts, results, warnings, transforms, last = [], [], [], [], None
    for f in folds:
        kernel, name, source = chosen[f.fold_id]
        if kernel is None:
            warnings.append(f"fold {f.fold_id}: no candidate was selected")
            results.append({"fold_id": f.fold_id, "status": "failed", "selected": None})
            continue
        inside = df.where((F.col(INDEX) >= f.validation_start) & (F.col(INDEX) < f.validation_end)).withColumn("_row_idx", F.col(INDEX)).withColumn(INDEX, F.col(INDEX) - f.validation_start)
        last = KernelFeatureBuilder({kernel_name: kernel}, time_col=time_col, numeric_cols=numeric_cols or [input_col], category_cols=list(category_cols), **builder)
        r = last.transform_result(inside)
        transforms.append(r)
        parts.append(r.augmented.select(F.col("_row_idx").alias(INDEX), F.lit(f.fold_id).alias("fold_id"), *[ident(x) for x in r.registry.names()]))
        results.append({"fold_id": f.fold_id, "status": "ok", "selected": name, "selected_by": source, "kernel": kernel.summary()})
    made = None
    for p in parts:
        made = p if made is None else made.unionByName(p, allowMissingColumns=True)
    evidence = None
    if made is None:
        out = df
    else:
        names = sorted(c for c in made.columns if c not in (INDEX, "fold_id"))
        out = df.join(made.select(INDEX, "fold_id", *[ident(x) for x in names]), INDEX, "left")
        specs = {s.name: s for t in transforms for s in t.registry}
        good = [r for r in results if r["status"] == "ok"]
        scope = {"evidence_scope": "oof", "full_data_evidence_available": False, "fold_evidence": [{k: r[k] for k in ("fold_id", "selected", "selected_by")} for r in good], "fold_kernel_summaries": {kernel_name: [r["kernel"] for r in good]}}
        candidate = {kernel_name: good[-1]["selected"]} if candidate_set is not None else None
        evidence = build_feature_evidence(builder=last, feature_registry=FeatureRegistry(tuple(specs[n] for n in names)), candidate_id_by_kernel=candidate, metadata_by_feature=dict.fromkeys(names, scope))
    summary = {"n_folds": len(folds), "split_strategy": "forward_chaining", "fold_boundaries": [vars(f) for f in folds], "min_train_rows": min(f.train_end - f.train_start for f in folds), "validation_rows_total": sum(f.validation_end - f.validation_start for f in folds), "warnings": tuple(warnings)}
    return OutOfFoldResult(out, results, summary, warnings, transforms, evidence)


def _fold_kernels(df: DataFrame, folds: list[Fold], *, input_col, target_col, time_col, learner, candidate_set, per_fold) -> dict[int, tuple[Kernel | None, str | None, str | None]]:
    """(kernel, what it is known by, how it was chosen) of each fold, from its training rows; a learner's fits are one grouped job."""
    train = {f.fold_id: df.where((F.col(INDEX) >= f.train_start) & (F.col(INDEX) < f.train_end)).withColumn(INDEX, F.col(INDEX) - f.train_start) for f in folds}
    out: dict[int, tuple[Kernel | None, str | None, str | None]] = {}
    if learner is not None:
        columns = {"input_col": input_col, "target_col": target_col, "time_col": time_col}
        prepared = {str(k): (learner, *learner.prepare(t, **columns)) for k, t in train.items()}
        solved = learn.solve_all(prepared)
        for k in train:
            _, data, dt = prepared[str(k)]
            with data:
                found = solved[str(k)]
                if found["error"]:
                    raise RuntimeError(found["error"])
                fit = learn.assemble(learner, data, dt, found, f"{input_col}->{target_col}", columns)
            out[k] = (fit.kernel, fit.fit_provenance["fit_result_id"], "learner")
        return out
    for k, t in train.items():
        scored = C.fit_kernel_candidates(t, candidate_set)
        if per_fold:
            pick, how = C.select_kernel_candidate(scored).selected, "selection"
        else:
            usable = [r for r in scored if r.succeeded and r.kernel is not None]
            pick, how = min(usable, key=lambda r: (r.validation_loss if r.validation_loss is not None else float("inf"), r.candidate.candidate_id), default=None), "lowest_loss"
        out[k] = (pick.kernel, pick.candidate.candidate_id, how) if pick is not None else (None, None, None)
    return out
