import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagloom.functions import kernels as K
from lagloom.operators import graph
from lagloom.sources import archives, grid, synthetic
from lagloom.streaming.fir_stream import fir_stream
from lagloom.operators.features import KernelFeatureBuilder


def test_scenarios_have_their_shape():
    for name, (rows, dt, _, _, _) in synthetic.SCENARIOS.items():
        s = synthetic.make_dataset(name)
        assert len(s.data) == rows and s.scenario["dt"] == dt
    s = synthetic.make_dataset("missing_window")
    assert s.data["input_signal"].isna().sum() == 14
    for u in synthetic.UNITS:
        assert len(synthetic.make_unit_dataset(u, 64).data) == 64
    assert {"ore_type", "cleaner_copper_grade"} <= set(synthetic.make_plant_dataset(100).data.columns)


def test_genealogy_closes(spark):
    feed = spark.range(40).selectExpr("id AS _idx", "1000.0D AS feed_mass")
    table = synthetic.genealogy(feed, synthetic._unit("spread", 1.0).to_frame(spark), mass_col="feed_mass", unit="u", path="p")
    sums = synthetic.mass_closure(table).where("NOT is_warmup").collect()
    assert len(sums) == 33 and all(abs(r.total_fraction - 1) < 1e-9 for r in sums)


def test_archive_and_reference_curve(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name, a in (("time.npy", np.arange(5.0)), ("e.npy", np.array([0, 1.0, 2, 1, 0])), ("bad.npy", np.array([[1.0, np.nan]]))):
            b = io.BytesIO()
            np.save(b, a)
            z.writestr(name, b.getvalue())
    found = {r.name: r for r in archives.inspect_archive(spark, str(tmp_path)).collect()}
    assert found["time.npy"].is_regular and not found["bad.npy"].is_finite and found["e.npy"].max == 2
    arrays = archives.read_arrays(spark, str(tmp_path))
    curve = archives.array_rows(arrays, "time.npy", "lag_time").join(archives.array_rows(arrays, "e.npy", "e"), "pos")
    out = archives.reference_curve(curve, curve.selectExpr("pos", "lag_time", "e * 3 AS e"), case="c", source_kind="k", source_archive_path="a").collect()
    assert [r.E_expected_normalized for r in out] == [0, 0.25, 0.5, 0.25, 0] == [r.E_predicted_normalized for r in out]
    moved = archives.reference_curve(curve, curve.selectExpr("pos", "lag_time + 1 AS lag_time", "e"), case="c", source_kind="k", source_archive_path="a").first()
    assert moved.E_predicted_raw is None
    with pytest.raises(ValueError):
        archives.reference_curve(curve.selectExpr("pos", "lag_time", "-e AS e"), curve, case="c", source_kind="k", source_archive_path="a")
    m = archives.write_with_manifest(curve, str(tmp_path / "out"), {"case": "c"})
    assert archives.read_manifest(spark, str(tmp_path / "out"))["rows"] == m["rows"] == 5


GRAPH = [[["", "-->", ""], ["-->", "", "-->"]], [["o-o", "-->", "-->"], ["", "", ""]]]


def test_graph_links(spark):
    with pytest.warns(UserWarning):
        links = graph.parent_pairs(spark, GRAPH, ["a", "b"])
    assert [tuple(r) for r in links.collect()] == [("a", "a", 1, "-->"), ("a", "b", 1, "-->"), ("a", "b", 2, "-->"), ("b", "a", 2, "-->")]
    cs = graph.candidate_set_from_links(links, source="a", target="b", time_col="t", dt=60.0)
    assert [c.family for c in cs.candidates] == [*graph.FAMILIES, "no_lag", "best_single_lag"]
    by = {c.family: c for c in cs.candidates}
    assert (by["gamma"].candidate_type, by["gamma"].parameters) == ("learner", {"init_shape_alpha": 2.0, "init_rate_beta": 1 / 120})
    assert by["fixed_delay"].parameters == {"delay_steps": 1} and by["best_single_lag"].max_lag == 1 and by["erlang"].min_lag == 1
    got = graph.compare_kernel_to_links(spark, K.UniformKernel(3, 1.0), links.where("source = 'a' AND target = 'b'"))
    assert got["mass_inside"] == 0.5 and not got["agrees"]
    assert graph.lag_candidate_dict(links)["a->b"] == [1, 2]


def test_candidates_without_links_are_the_baselines(spark):
    links = graph.parent_pairs(spark, GRAPH, {"0": "a", 1: "b"})
    with pytest.warns(UserWarning, match="LAG_RANGE_EMPTY"):
        cs = graph.candidate_set_from_links(links, source="b", target="b", time_col="t")
    assert [(c.family, c.max_lag) for c in cs.candidates] == [("no_lag", 0), ("best_single_lag", 1)]
    assert all(c.metadata["generated_reason"] == "LAG_RANGE_EMPTY" for c in cs.candidates)


def test_marks_ranges_and_evidence(spark):
    with pytest.warns(UserWarning, match="GRAPH_MARK_UNSUPPORTED"):
        assert graph.parent_pairs(spark, GRAPH, ["a", "b"], marks=("o-o",)).count() == 0
    assert [r.tau for r in graph.parent_pairs(spark, {"graph": GRAPH}, ["a", "b"], lag_step_range=(2, 2)).collect()] == [2, 2]
    p = [[[1.0, 0.01, 0.5], [1.0, 0.5, 0.02]], [[0.9, 0.03, 0.04], [1.0, 0.5, 0.5]]]
    with pytest.warns(UserWarning, match="VALUES_NOT_KERNEL_WEIGHTS"):
        found = graph.link_summary(graph.lag_candidates(spark, GRAPH, ["a", "b"], p_matrix=p, val_matrix={"val_matrix": p})).where("source = 'a' AND target = 'b'").first()
    assert (found.lag_steps, found.median_lag_steps, found.p_value_min, found.value_max, found.graph_marks) == ([1, 2], 1, 0.03, 0.04, ["-->"])
    cs = graph.candidate_set_from_links(graph.lag_candidates(spark, GRAPH, ["a", "b"], p_matrix=p), source="a", target="b", time_col="t", families=("gamma", "odd"), family_defaults={"gamma": {"rate_beta": 7.0}})
    assert [c.family for c in cs.candidates] == ["gamma", "no_lag", "best_single_lag"] and cs.candidates[0].parameters["init_rate_beta"] == 7.0
    assert cs.candidates[0].metadata["lag_evidence_summary"]["p_value_max"] == 0.04
    for names in (["a"], ["a", "a"], {0: "a"}, ["a", ""]):
        with pytest.raises(graph.GraphPayloadError):
            graph.parent_pairs(spark, GRAPH, names)
    with pytest.raises(ValueError):
        graph.parent_pairs(spark, GRAPH, ["a", "b"], lag_step_range=(3, 1))
    with pytest.raises(graph.GraphPayloadError):
        graph.lag_candidates(spark, GRAPH, ["a", "b"], p_matrix=[[[0.1]]])


def test_support_threshold(spark):
    with pytest.warns(UserWarning, match="KERNEL_SUPPORT_THRESHOLD_BREACH"):
        got = graph.compare_kernel_to_links(spark, K.UniformKernel(3, 1.0), [1, 2])
    assert (got["mass_outside"], got["n_shared_lags"], got["agrees"]) == (0.5, 2, False)
    assert graph.compare_kernel_to_links(spark, K.UniformKernel(3, 1.0), [1, 2], 0.5)["agrees"]


@pytest.mark.parametrize("cube", [[], [[["-->"]], [["-->"]]], [[["-->", 1]]], "[[]]", [[["a"], ["b", "c"]], [["a"], ["b"]]]])
def test_bad_cubes_raise(cube):
    with pytest.raises(graph.GraphPayloadError):
        graph.parse_cube(cube)


def test_stream_equals_batch(spark, tmp_path):
    rows = [("s", i, float(i * i % 17)) for i in range(60)] + [("r", i, None if i == 5 else float(i)) for i in range(20)]
    schema = "series string, idx long, value double"
    for k in range(4):
        part = [r for r in rows if r[1] // 15 == k]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    k = K.GammaKernel(2.0, 0.5, 4, 1.0)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = fir_stream(stream, k).writeStream.format("memory").queryName("fir_stream_test").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.series, r.idx): r.wmean for r in spark.table("fir_stream_test").collect()}
    batch = spark.createDataFrame(rows, schema).withColumnRenamed("idx", "_idx").selectExpr("*", "_idx AS t")
    want = KernelFeatureBuilder({"k": k}, time_col="t", numeric_cols=["value"], series_cols=["series"]).transform(batch).collect()
    assert len(got) == 80
    for r in want:
        g = got[r.series, r.t]
        assert g == r["k_num_value_wmean"] or g == pytest.approx(r["k_num_value_wmean"])


def test_row_index_cuts_heavy_values(spark, monkeypatch):
    monkeypatch.setattr(grid, "HEAVY_ROWS", 50)
    rows = [(5 if k % 3 else None if k % 7 == 0 else k, k * 37 % 1000, k) for k in range(1000)]
    df = spark.createDataFrame(rows, "a long, b long, c long").repartition(5)
    parted, sizes = grid._ranges(df, ["a", "b"], 8)
    assert max(n for _, n in sizes) < 300
    want = {c: i for i, (_, _, c) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])))}
    assert {r.c: r["_idx"] for r in grid.row_index(df, ["a", "b"], parts=8).collect()} == want


def test_order_is_checked_in_ranges(spark):
    df = spark.createDataFrame([(k, k // 3) for k in range(500)], "n long, t long").repartition(4)
    assert grid.check_order(df, time_col="t", input_order_col="n") is df
    for at in (0, 250, 499):
        bad = df.withColumn("t", F.when(F.col("n") == at, 250 if at else 1).otherwise(F.col("t")))
        with pytest.raises(ValueError):
            grid.check_order(bad.withColumn("t", F.when(F.col("n") == 251, -1).otherwise(F.col("t"))), time_col="t", input_order_col="n")


def test_closed_loop_masses():
    """Against the mixture over the number of passes; in the long run product is what was fed, but for the last passes."""
    s = synthetic.make_unit_dataset("closed_loop", n_rows=200)
    weights: dict[int, float] = {}
    passed = {0: 1.0}
    for n in range(12):
        passed_next: dict[int, float] = {}
        for k, w in passed.items():
            for lag, v in zip((1, 2, 3), (0.2, 0.6, 0.2)):
                passed_next[k + lag] = passed_next.get(k + lag, 0.0) + w * v
        passed = passed_next
        for k, w in passed.items():
            weights[k] = weights.get(k, 0.0) + 0.65**n * w
    for t in (0, 1, 5, 20, 199):
        want = sum(1000.0 * w for k, w in weights.items() if k <= t)
        row = s.data.iloc[t]
        assert row.crusher_screen_discharge_mass == pytest.approx(want) and row.product_mass == pytest.approx(0.35 * want) and row.recycle_mass == pytest.approx(0.65 * want)
    assert s.data.product_mass.iloc[-1] == pytest.approx(1000 * (1 - 0.65**12))
