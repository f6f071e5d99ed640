import math

import pytest

from lagloom.functions import kernels as K
from lagloom.operators.features import KernelFeatureBuilder, feature_evidence_compact_text, numeric_feature_name
from lagloom.sources.grid import INDEX, duration_text, infer_regular_dt, lag_to_steps, row_index

NAN = float("nan")


def rows(df, *names):
    return [tuple(r[n] for n in names) for r in df.orderBy("t").collect()]


def test_golden_values(spark):
    df = spark.createDataFrame([(t, float(t + 1)) for t in range(5)], "t long, x double")
    k = K.FixedDelayKernel(1, 2, 1.0)
    out = KernelFeatureBuilder({"k": k}, time_col="t", numeric_cols=["x"]).transform(df)
    assert [r[0] for r in rows(out, "k_num_x_wmean")] == [None, None, 2, 3, 4]
    assert out.columns == ["t", "k_num_x_wmean", "k_num_x_wstd", "k_num_x_wsum", "k_age_mean", "k_age_p50", "k_age_p90", "k_age_tail_gt_threshold"]


def test_a_missing_value_under_zero_weight_blanks_the_window(spark):
    df = spark.createDataFrame([(0, 1.0), (1, NAN), (2, 3.0), (3, float("inf")), (4, 5.0), (5, 6.0), (6, 7.0)], "t long, x double")
    out = KernelFeatureBuilder({"k": K.FixedDelayKernel(0, 1, 1.0)}, time_col="t", numeric_cols=["x"]).transform(df)
    assert [r[0] for r in rows(out, "k_num_x_wmean")] == [None, None, None, None, None, 6, 7]


def test_categories_entropy_and_nulls(spark):
    df = spark.createDataFrame([(0, "A"), (1, None), (2, "B"), (3, "B"), (4, "A"), (5, "B")], "t long, cat string")
    out = KernelFeatureBuilder({"k": K.UniformKernel(2, 1.0)}, time_col="t", category_cols=["cat"]).transform(df)
    got = rows(out, "k_cat_cat_A_frac", "k_cat_cat_B_frac", "k_cat_cat_entropy")
    assert got[:4] == [(None, None, None)] * 4
    assert got[4] == pytest.approx((1 / 3, 2 / 3, -(math.log(1 / 3) / 3 + math.log(2 / 3) * 2 / 3)))


def test_weights_and_zero_denominators(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0), (1, 2.0, 3.0), (2, 3.0, 0.0), (3, 4.0, 0.0), (4, 5.0, NAN)], "t long, x double, m double")
    r = KernelFeatureBuilder({"k": K.UniformKernel(1, 1.0)}, time_col="t", numeric_cols=["x"], weight_col="m").transform_result(df)
    assert [x[0] for x in rows(r.features, "k_num_x_wmean")] == [None, 1.75, 2.0, None, None]
    assert r.report.zero_denominator_rows_by_feature["k_num_x_wmean"] == 1
    assert r.report.missing_rows_by_feature["k_num_x_wstd"] == 3
    assert r.report.zero_denominator_rows_by_kernel["k"] == 3
    assert r.report.warmup_unusable_summary["warmup_rows"] == 1


def test_results_do_not_depend_on_chunks(spark):
    df = spark.range(500).selectExpr("id AS t", "id AS _idx", "cast(pmod(id * 37, 101) AS double) AS x")
    k = {"k": K.GammaKernel(2.0, 0.4, 12, 1.0)}
    a = KernelFeatureBuilder(k, time_col="t", numeric_cols=["x"]).transform(df)
    b = KernelFeatureBuilder(k, time_col="t", numeric_cols=["x"], chunk=16).transform(df)
    assert rows(a, *a.columns) == rows(b, *b.columns)


def test_row_index_is_the_order(spark):
    df = spark.range(1000).selectExpr("pmod(id * 7919, 1000) / 3.0 AS v", "id AS tie")
    got = row_index(df, ["v", "tie"], parts=7).orderBy(INDEX).collect()
    assert [r[INDEX] for r in got] == list(range(1000))
    assert [(r.v, r.tie) for r in got] == sorted((r.v, r.tie) for r in got)


def test_odd_names_empty_tables_and_collisions(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0)], "t long, `a.b->c` double")
    out = KernelFeatureBuilder({"k->": K.UniformKernel(1, 1.0)}, time_col="t", numeric_cols=["a.b->c"]).transform(df)
    assert rows(out, "k->_num_a.b->c_wmean") == [(None,), (1.5,)]
    assert KernelFeatureBuilder({"k": K.UniformKernel(1, 1.0)}, time_col="t", numeric_cols=["a.b->c"]).transform(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        KernelFeatureBuilder({"k": K.UniformKernel(1, 1.0)}, time_col="t", numeric_cols=["x"]).transform(df)
    clash = df.selectExpr("t", "1.0D AS x", "2.0D AS k_num_x_wmean")
    with pytest.raises(ValueError):
        KernelFeatureBuilder({"k": K.UniformKernel(1, 1.0)}, time_col="t", numeric_cols=["x"]).transform(clash)


def test_missing_as_nan(spark):
    df = spark.createDataFrame([(0, 1.0)], "t long, x double")
    out = KernelFeatureBuilder({"k": K.UniformKernel(1, 1.0)}, time_col="t", numeric_cols=["x"], missing="nan").transform(df)
    assert math.isnan(out.first()["k_num_x_wmean"])


def test_registry_and_evidence(spark):
    df = spark.createDataFrame([(0, 1.0, "A")], "t long, x double, c string")
    b = KernelFeatureBuilder({"u": K.UniformKernel(1, 1.0), "d": K.FixedDelayKernel(0, 1, 1.0)}, time_col="t", numeric_cols=["x"], category_cols=["c"])
    r = b.transform_result(df)
    assert len(r.registry) == 18 and len(r.registry.filter(kernel_name="u", family="categorical")) == 2
    assert r.registry.to_frame(spark).count() == 18
    text = feature_evidence_compact_text(b.diagnose_feature_evidence(df, candidate_id_by_kernel={"u": "c1"}))
    assert text == "features=18; kernels=2; source_cols=3; evidence=comparison_evidence=9, kernel_only=9"
    with pytest.raises(ValueError):
        numeric_feature_name("k", "x", "median")
    assert [s.category_level for s in b.specs(["u_cat_c_B_frac", "d_num_x_wsum"])] == ["B", None]
    assert len(b.specs()) == 14
    with pytest.raises(ValueError):
        b.specs(["u_num_y_wsum"])


def test_durations():
    assert lag_to_steps("10m", dt=300.0) == 2 and lag_to_steps(3, dt=1.0) == 3 and lag_to_steps("0s", dt=1.0) == 0
    assert (duration_text(90.0), duration_text(7200.0), duration_text(86400.0)) == ("90s", "2h", "1d")
    for bad in ("7s", -1, "x"):
        with pytest.raises(ValueError):
            lag_to_steps(bad, dt=5.0)


@pytest.mark.parametrize("seconds,reason", [([0], "two rows"), ([0, 1, 1], "duplicates"), ([0, 1, 3], "irregular"), ([0, None, 2], "nulls"), ([0, 2, 3, 6], "irregular")])
def test_grid_errors(spark, seconds, reason):
    df = spark.createDataFrame([(s,) for s in seconds], "s int").selectExpr("timestamp_seconds(s) AS t")
    with pytest.raises(ValueError, match=reason):
        infer_regular_dt(df, time_col="t")


def test_grid_step(spark):
    df = spark.range(10).selectExpr("timestamp_seconds(id * 60) AS t")
    assert infer_regular_dt(df, time_col="t") == 60.0
    with pytest.raises(ValueError):
        infer_regular_dt(spark.range(3).selectExpr("id AS t"), time_col="t")
