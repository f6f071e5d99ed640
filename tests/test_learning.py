import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from lagloom.functions import kernels as K
from lagloom.operators import bootstrap, candidates, learn, oof, solve, windows
from lagloom.operators.ml import KernelFeatureTransformer
from lagloom.sources import synthetic

#: Published validation losses of the gallery (Huber, lags 0 to 60 steps, 420 epochs): fixed values.
GOLDEN = {
    "conveyor": {"no_lag": 0.443977, "best_single_lag": 0.001604, "simplex": 0.001987, "gamma": 0.193189, "exponential": 0.233566},
    "cstr": {"no_lag": 0.010829, "best_single_lag": 0.010829, "exponential": 0.003601, "simplex": 0.003580, "gamma": 0.165821},
    "tanks_in_series": {"no_lag": 0.389358, "best_single_lag": 0.015707, "gamma": 0.004862, "erlang": 0.004201, "simplex": 0.004391, "exponential": 0.141205},
    "flotation_banks": {"no_lag": 0.343265, "best_single_lag": 0.190029, "lognormal": 0.046718, "simplex": 0.046417, "gamma": 0.047491},
    "closed_loop_crushing": {"no_lag": 0.494743, "best_single_lag": 0.023439, "simplex": 0.007042, "gamma": 0.113851, "exponential": 0.214163},
    "bounded_hold_up_tank": {"no_lag": 0.157401, "best_single_lag": 0.145443, "uniform": 0.072574, "simplex": 0.012827, "exponential": 0.022936},
}


def arrays(data):
    pdf = data.windows.orderBy("window_id").toPandas()
    train = pdf["is_train"].to_numpy(bool)
    x, y = np.stack(pdf["x"].to_numpy()), pdf["y"].to_numpy()
    return x[train], y[train], x[~train], y[~train]


@pytest.mark.parametrize("name", list(GOLDEN))
def test_golden_losses(spark, name):
    s = synthetic.make_dataset(name)
    data = windows.prepare(s.frame(spark), input_col="input_signal", target_col="target_signal", lags=list(range(61)))
    base = windows.baseline_losses(data)
    xt, yt, xv, yv = arrays(data)
    for what, want in GOLDEN[name].items():
        if what in base and what != "exponential":
            got = base[what]
        else:
            got = solve.fit(what, np.arange(61) * 60.0, xt, yt, xv, yv, epochs=420, smoothness=0.0004)["validation_loss"]
        assert got == pytest.approx(want, abs=2e-6), what


def test_simplex_finds_the_kernel(spark):
    s = synthetic.make_dataset("single_delay")
    fit = learn.SimplexKernelLearner(12, max_epochs=400).fit(s.frame(spark), input_col="input_signal", target_col="target_signal", time_col="time")
    assert max(range(13), key=lambda k: fit.kernel.weights[k]) == 6
    assert sum(abs(w - (k == 6)) for k, w in zip(fit.kernel.lag_steps, fit.kernel.weights)) <= 0.25
    assert fit.kernel.name == "input_signal->target_signal" and fit.fit_provenance["fit_result_id"]


def test_fixed_delay_and_delayed_exponential(spark):
    s = synthetic.make_dataset("single_delay")
    fit = learn.FixedDelayKernelLearner(12).fit(s.frame(spark), input_col="input_signal", target_col="target_signal", time_col="time")
    assert fit.kernel.weights[6] == 1.0
    s = synthetic.make_dataset("closed_loop_crushing")
    fit = learn.DelayedExponentialKernelLearner(14, max_epochs=150).fit(s.frame(spark), input_col="input_signal", target_col="target_signal", time_col="time")
    assert fit.kernel.parameters["delay"] == 240.0


@pytest.mark.parametrize("name,code", [("boundary_kernel", "BOUNDARY_PILED_KERNEL"), ("diffuse_kernel", "DIFFUSE_KERNEL")])
def test_warnings(spark, name, code):
    s = synthetic.make_dataset(name)
    fit = learn.SimplexKernelLearner(10 if name == "diffuse_kernel" else 6, max_epochs=200).fit(s.frame(spark), input_col="input_signal", target_col="target_signal", time_col="time")
    assert code in fit.identifiability_report.warning_codes and not fit.identifiability_report.is_reliable


def test_learner_settings_are_checked():
    for bad in ({"loss": "mae"}, {"validation_fraction": 0.5}, {"max_epochs": 0}, {"smoothness_penalty": -1}):
        with pytest.raises(ValueError):
            learn.SimplexKernelLearner(5, **bad)


def test_shared_fits_keep_failures(spark):
    s = synthetic.make_multi_pair_dataset(n_rows=120)
    r = learn.SharedSimplexKernelLearner(6, max_epochs=50).fit(s.frame(spark), pairs=[("input_signal_a", "target_signal_a"), ("input_signal_a", "none")], time_col="time")
    assert r.get_pair("input_signal_a->target_signal_a").succeeded
    assert "none" in r.get_pair("input_signal_a->none").error
    with pytest.raises(ValueError):
        r.to_kernels()


def _set(*more):
    C = candidates.KernelCandidate
    return candidates.KernelCandidateSet("input_signal", "target_signal", "time", (C("simplex", "simplex", "learner", 10), C("uniform", "uniform", "fixed_kernel", 10), C("true", "gamma", "fixed_kernel", 10, 1, {"shape_alpha": 3.0, "rate_beta": 0.06}), C("none", "no_lag", "baseline", 10), *more))


def test_candidates_select_and_bootstrap(spark):
    s = synthetic.make_dataset("spread_delay", n_rows=160)
    df = s.frame(spark)
    C = candidates.KernelCandidate
    cs = candidates.KernelCandidateSet("input_signal", "target_signal", "time", (C("simplex", "simplex", "learner", 10), C("uniform", "uniform", "fixed_kernel", 10), C("delay", "fixed_delay", "fixed_kernel", 10, 0, {"delay_steps": 5}), C("none", "no_lag", "baseline", 10), C("bad", "gamma", "fixed_kernel", 10, 0, {"x": 1})))
    assert candidates.KernelCandidateSet.from_json(cs.to_json()) == cs
    results = candidates.fit_kernel_candidates(df, cs, max_epochs=120)
    by = {r.candidate.candidate_id: r for r in results}
    assert not by["bad"].succeeded and by["simplex"].succeeded
    table = candidates.comparison_table(spark, results).collect()
    assert table[0].candidate_id == "simplex" and table[-1].candidate_id == "bad"
    pick = candidates.select_kernel_candidate(results)
    assert pick.selected is None or pick.selected.candidate.candidate_id == "simplex"
    assert pick.reasons["none"] == ["baseline", "not_better_than_no_lag"] or "baseline" in pick.reasons["none"]
    config = bootstrap.BlockedBootstrapConfig(3, 20, 5)
    r = bootstrap.bootstrap_kernel_candidates(df, [by["simplex"], by["uniform"], by["none"]], input_col="input_signal", target_col="target_signal", config=config, max_epochs=40)
    assert r.stability("simplex") == 1.0 and r.stability("none") == 0.0
    w = r.weight_intervals().where("candidate_id = 'simplex'").collect()
    assert len(w) == 11 and all(x.lower <= x.weight_estimate <= x.upper and x.n_samples == 3 for x in w)
    assert set(r.selected.values()) == {"simplex"}


def test_bootstrap_splits_are_fixed_by_the_seed():
    a = bootstrap.blocked_splits(50, bootstrap.BlockedBootstrapConfig(4, 7, 1))
    b = bootstrap.blocked_splits(50, bootstrap.BlockedBootstrapConfig(4, 7, 1))
    assert all((x == y).all() and len(x) == 50 for x, y in zip(a, b))
    rng = np.random.default_rng(1)
    assert a[0][0] == rng.integers(0, 50 - 7 + 1)
    with pytest.raises(ValueError):
        bootstrap.blocked_splits(5, bootstrap.BlockedBootstrapConfig(1, 7))


def test_folds():
    c = oof.ForwardChainingSplitConfig(3, 10, 5, 2, 8)
    f = oof.forward_chaining(30, c)
    assert [(x.train_start, x.train_end, x.validation_start, x.validation_end) for x in f] == [(2, 10, 12, 17), (7, 15, 17, 22), (12, 20, 22, 27)]
    with pytest.raises(ValueError):
        oof.forward_chaining(20, c)


def test_out_of_fold_rows(spark):
    df = synthetic.make_dataset("spread_delay", n_rows=200).frame(spark)
    c = oof.ForwardChainingSplitConfig(2, 100, 40)
    r = oof.fit_transform_oof(df, input_col="input_signal", target_col="target_signal", time_col="time", split_config=c, learner=learn.FixedDelayKernelLearner(8))
    rep = r.report()
    assert rep["row_count"] == 200 and rep["missing_rows_by_feature"]["oof_num_input_signal_wmean"] == 200 - 80 + 2 * 8
    kernel = K.FixedDelayKernel(5, 8, 1.0)
    fixed = oof.fixed_oof(df, kernel, oof.forward_chaining(200, c), time_col="time", kernel_name="k", numeric_cols=["input_signal"])
    assert fixed.where("k_num_input_signal_wmean IS NOT NULL").count() == 64
    with pytest.raises(ValueError):
        oof.fit_transform_oof(df, input_col="a", target_col="b", time_col="time", split_config=c)


def test_estimator(spark):
    df = synthetic.make_dataset("single_delay", n_rows=100).frame(spark)
    t = KernelFeatureTransformer(time_col="time", numeric_cols=["input_signal"], learner=learn.FixedDelayKernelLearner(8), input_col="input_signal", target_col="target_signal", include_time_col=False)
    out = t.fit(df).transform(df)
    assert "time" not in out.columns and out.count() == 100
    assert all(c.startswith("learned_") for c in out.columns)
    with pytest.raises(ValueError):
        KernelFeatureTransformer(time_col="time")


def test_saved_pipelines(spark, tmp_path):
    """Estimator and model come back from a folder, alone and in a pipeline, and do the same."""
    df = synthetic.make_dataset("single_delay", n_rows=100).frame(spark)
    one = KernelFeatureTransformer(time_col="time", numeric_cols=["input_signal"], learner=learn.FixedDelayKernelLearner(8), input_col="input_signal", target_col="target_signal", kernel_name="k")
    two = KernelFeatureTransformer(time_col="time", numeric_cols=["input_signal"], kernels={"u": K.UniformKernel(3, 60.0)}, passthrough=True)
    Pipeline(stages=[two]).write().overwrite().save(f"file://{tmp_path}/pipeline")
    one.write().overwrite().save(f"file://{tmp_path}/one")
    rows = lambda m: sorted(map(str, m.transform(df).collect()))
    model = one.fit(df)
    assert rows(KernelFeatureTransformer.load(f"file://{tmp_path}/one").fit(df)) == rows(model)
    whole = Pipeline.load(f"file://{tmp_path}/pipeline").fit(df)
    whole.write().overwrite().save(f"file://{tmp_path}/fitted")
    assert rows(PipelineModel.load(f"file://{tmp_path}/fitted")) == rows(two.fit(df))
    assert model.get_feature_names_out(df)[0] == "k_num_input_signal_wmean"


FAMILIES = {"simplex": {}, "exponential": {}, "gamma": {}, "lognormal": {}, "erlang": {"shape_k_candidates": (2,)}, "delayed_exponential": {"delays": (2.0,)}}


def _toy():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(90, 9))
    y = x @ np.array([0, 0, 0.1, 0.5, 0.2, 0.1, 0.1, 0, 0]) + rng.normal(0, 0.05, 90)
    return x[:70], y[:70], x[70:], y[70:]


@pytest.mark.parametrize("family", FAMILIES)
def test_smoothness_is_part_of_every_fit(family):
    """Against plain Adam on a numeric gradient of loss + penalty."""
    xt, yt, xv, yv = _toy()
    times = np.arange(9.0)
    made = {"simplex": solve.Simplex, "exponential": solve.Exponential, "gamma": solve.Gamma, "lognormal": solve.LogNormal, "erlang": lambda t: solve.Erlang(t, 2), "delayed_exponential": lambda t: solve.DelayedExponential(t, 2.0)}[family](times)

    def total(theta, penalty):
        w = solve.softmax(made.logits(theta)[0])
        return solve.loss_value(xt @ w - yt, None, "huber", 1.0) + penalty * float((np.diff(w) ** 2).mean())

    theta, m, v, best = made.start().astype(float), 0.0, 0.0, None
    for k in range(1, 31):
        w = solve.softmax(made.logits(theta)[0])
        valid = solve.loss_value(xv @ w - yv, None, "huber", 1.0)
        best = (valid, w) if best is None or valid < best[0] else best
        g = np.array([(total(theta + h, 5.0) - total(theta - h, 5.0)) / 2e-6 for h in np.eye(len(theta)) * 1e-6])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    got = solve.fit(family, times, xt, yt, xv, yv, options=FAMILIES[family], epochs=30, smoothness=5.0)
    plain = solve.fit(family, times, xt, yt, xv, yv, options=FAMILIES[family], epochs=30)
    assert got["validation_loss"] == pytest.approx(best[0], abs=1e-5) and np.allclose(got["weights"], best[1], atol=1e-4)
    assert not np.allclose(got["weights"], plain["weights"], atol=1e-6)


def test_init_delay_is_checked_and_reported(spark):
    s = synthetic.make_dataset("single_delay", n_rows=120)
    fit = learn.DelayedExponentialKernelLearner(8, init_delay=120.0, max_epochs=5).fit(s.frame(spark), input_col="input_signal", target_col="target_signal", time_col="time")
    p = fit.fit_provenance
    assert p["parametric_initial_parameters"]["delay"] == 120.0 and p["parametric_family"] == "delayed_exponential"
    assert learn.summarize_parametric_kernel(fit.kernel, family="delayed_exponential", parameters=p["parametric_parameters"])["parametric_parameters"] == p["parametric_parameters"]
    with pytest.raises(ValueError):
        learn.DelayedExponentialKernelLearner(8, init_delay=-1.0)


@pytest.mark.parametrize("loss,epochs", [("mse", 40), ("huber", 4)])
def test_fits_of_any_size(spark, monkeypatch, loss, epochs):
    """Windows that do not fit a worker give the same fit where they lie."""
    s = synthetic.make_dataset("gamma_kernel", n_rows=150)
    learner = learn.GammaKernelLearner(8, min_lag=1, loss=loss, max_epochs=epochs)
    data, dt = learner.prepare(s.frame(spark), input_col="input_signal", target_col="target_signal", time_col="time")
    want = learner.solve(data, dt)
    monkeypatch.setattr(learn, "MAX_CELLS", 10)
    got = learner.solve(data, dt)
    assert got["error"] is None and np.allclose(got["weights"], want["weights"], atol=1e-7) and got["validation_loss"] == pytest.approx(want["validation_loss"], rel=1e-6)


def test_quartiles_in_passes(spark, monkeypatch):
    rng = np.random.default_rng(9)
    values = {"a": rng.normal(size=3001), "b": np.concatenate([np.zeros(900), rng.exponential(size=100), [1e9]]), "c": np.full(500, 3.0)}
    df = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v], "kind string, v double")
    want = windows.robust_scalings(df)
    monkeypatch.setattr(windows, "FEW", 20)
    monkeypatch.setattr(windows, "BINS", 8)
    got = windows.robust_scalings(df)
    for k, v in values.items():
        q = np.quantile(v, [0.25, 0.5, 0.75])
        assert got[k].center == pytest.approx(q[1], abs=1e-12) and got[k].center == pytest.approx(want[k].center) and got[k].scale == pytest.approx(want[k].scale)


def test_out_of_fold_reports_and_evidence(spark):
    df = synthetic.make_dataset("spread_delay", n_rows=200).frame(spark)
    C = candidates.KernelCandidate
    cs = candidates.KernelCandidateSet("input_signal", "target_signal", "time", (C("good", "fixed_delay", "fixed_kernel", 8, 0, {"delay_steps": 5}), C("broken", "gamma", "fixed_kernel", 8, 0, {"x": 1})))
    for per_fold in (True, False):
        r = oof.fit_transform_oof(df, input_col="input_signal", target_col="target_signal", time_col="time", split_config=oof.ForwardChainingSplitConfig(2, 100, 40), candidate_set=cs, select_candidate_per_fold=per_fold)
        if per_fold and not r.transforms:
            continue
        report = r.combined_report
        assert report.warmup_rows == sum(x.warmup_rows for x in r.fold_reports) == 16 == report.warmup_unusable_summary["warmup_rows"]
        assert report.missing_rows_by_kernel == {"oof": sum(x.missing_rows_by_kernel["oof"] for x in r.fold_reports)}
        assert report.collision_naming_summary["feature_count_by_kernel"] == {"oof": len(report.feature_names)}
        assert r.split_summary["rows_with_features"] + r.split_summary["rows_without_features"] == 200
        assert {e.feature_name for e in r.evidence.feature_evidence} == set(report.feature_names)
        e = r.evidence.feature_evidence[0]
        assert e.candidate_id == "good" and e.metadata["evidence_scope"] == "oof" and [f["fold_id"] for f in e.metadata["fold_evidence"]] == [0, 1]


def test_order_of_rows_is_checked(spark):
    df = synthetic.make_dataset("single_delay", n_rows=100).frame(spark).withColumn("n", F.monotonically_increasing_id())
    learner, columns = learn.UniformKernelLearner(4), {"input_col": "input_signal", "target_col": "target_signal", "time_col": "time"}
    assert learner.fit(df, **columns, order_by_time=False, input_order_col="time").kernel.weights
    with pytest.raises(ValueError):
        learner.fit(df.withColumn("n", -F.unix_micros(F.col("time").cast("timestamp"))), **columns, order_by_time=False, input_order_col="n")
    with pytest.raises(ValueError):
        learner.fit(df, **columns, order_by_time=False)
