"""Registered queries and the SQL that states them.

Doubles are rounded on both sides: to nine decimals, and to six where values
are money, whose ninth decimal is beyond what a double holds.  Queries without SQL are
learned, iterative or random, and are tested in tests/ instead.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagloom.functions import kernels as K
from lagloom.operators import bootstrap, candidates, diagnose, fir, graph, learn, oof, windows
from lagloom.operators.features import KernelFeatureBuilder, build_feature_evidence, feature_evidence_table
from lagloom.operators.fir import ident
from lagloom.plans import signals, statements
from lagloom.plans.statements import num
from lagloom.sources import synthetic
from lagloom.sources.grid import INDEX, grid_stats, regular_grid, row_index

HOUR, DAY = 3600.0, 86400.0
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


def _rounded(df: DataFrame, keep: tuple[str, ...] = ("t",), digits: int = 9) -> DataFrame:
    return df.select(*[ident(c) for c in keep], *[(F.round(ident(c), digits) + F.lit(0.0)).alias(c) for c, kind in df.dtypes if c not in keep and kind == "double"])


def _features(name: str, signal: str, kernels: dict[str, K.Kernel], numeric: list[str] = (), category: dict[str, list[str]] | None = None, mass: str | None = None, ages: bool = False, chunk: int = fir.CHUNK, stated: dict[str, str] | None = None) -> None:
    """Register one use of the builder, and the statement of the same features."""
    make, sql = signals.SIGNALS[signal]
    digits = 9 if signal == "events_hour" else 6

    def query(spark: SparkSession, d: str) -> DataFrame:
        b = KernelFeatureBuilder(kernels, time_col="t", numeric_cols=list(numeric), category_cols=list(category or {}), category_levels=category, weight_col=mass, chunk=chunk)
        out = b.transform(make(spark, d))
        return _rounded(out if ages else out.drop(*[c for c in out.columns if "_age_" in c]), digits=digits)

    _add(name, query, statements.features(sql, kernels, list(numeric), category, mass, ages, digits, stated))


uniform = K.UniformKernel(6, HOUR)
gamma = K.GammaKernel(2.0, 1 / 5400.0, 6, HOUR)
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
FLAGS = ["A", "N", "R"]

_features("fir_uniform", "events_hour", {"u": uniform}, ["x"])
_features("fir_gamma", "events_hour", {"g": gamma}, ["x"], ages=True)
_features("fir_fixed_delay", "orders_day", {"d": K.FixedDelayKernel(3, 5, DAY)}, ["x"])
_features("fir_exponential", "events_hour", {"e": K.ExponentialKernel(1 / 7200.0, 8, HOUR)}, ["x", "n"])
_features("fir_delayed_exponential", "events_hour", {"de": K.DelayedExponentialKernel(7200.0, 1 / 7200.0, 8, HOUR)}, ["x"])
_features("fir_lognormal", "lineitem_day", {"ln": K.LogNormalKernel(12.5, 0.6, 10, DAY, 1)}, ["x"])
_features("fir_erlang", "lineitem_day", {"er": K.ErlangKernel(3, 1 / 86400.0, 10, DAY)}, ["x"])
_features("fir_weighted_mass", "lineitem_day", {"w": K.GammaKernel(2.0, 1 / 129600.0, 7, DAY)}, ["x"], mass="m")
_features("fir_category", "events_hour", {"c": gamma}, [], {"cat": EVENT_TYPES})
_features("fir_category_weighted", "lineitem_day", {"c": K.UniformKernel(5, DAY)}, [], {"cat": FLAGS}, mass="m")
_features("fir_multi_kernel", "events_hour", {"u": uniform, "g": gamma, "d": K.FixedDelayKernel(2, 4, HOUR)}, ["x", "n"], {"cat": EVENT_TYPES}, ages=True, stated={"d": "CASE WHEN k = 2 THEN 1.0 ELSE 0.0 END"})
_features("fir_halo_chunks", "lineitem_day", {"g": K.GammaKernel(3.0, 1 / 172800.0, 20, DAY)}, ["x"], chunk=256)
_features("fir_age_only", "events_hour", {"g": gamma, "u": uniform}, ages=True)


def _zero_denominator(spark, d):
    df = signals.lineitem_day(spark, d).withColumn("m", F.when(F.col(INDEX) % 50 < 12, F.lit(0.0)).otherwise(F.col("m")))
    r = KernelFeatureBuilder({"z": K.UniformKernel(4, DAY)}, time_col="t", numeric_cols=["x"], weight_col="m").transform_result(df)
    return r.report_frame().where("feature_name LIKE '%_num_%'")


_zk = K.UniformKernel(4, DAY)
_zsql = signals.LINEITEM_DAY.replace(", sig AS (", ", sig0 AS (") + ", sig AS (SELECT t, i, x, CASE WHEN i % 50 < 12 THEN 0.0::DOUBLE ELSE m END AS m FROM sig0)"
_zctes = statements.numeric(_zk, "z", "x", "lagged", "m")
_add(
    "fir_zero_denominator",
    _zero_denominator,
    f"WITH {_zsql}, lagged AS ({statements.lags(['x', 'm'], list(_zk.lag_steps))}), "
    + ", ".join(f"{n} AS ({b})" for n, b in _zctes)
    + " SELECT feature_name, 'z' AS kernel_name, count(*)::BIGINT AS row_count, count(*) FILTER (v IS NULL)::BIGINT AS missing_rows, count(*) FILTER (z_num_x_zero)::BIGINT AS zero_denominator_rows FROM ("
    + " UNION ALL ".join(f"SELECT '{f}' AS feature_name, {f} AS v, z_num_x_zero FROM {_zctes[-1][0]}" for f in ("z_num_x_wmean", "z_num_x_wstd", "z_num_x_wsum"))
    + ") GROUP BY 1",
)


def _augment(spark, d):
    b = KernelFeatureBuilder({"u": uniform}, time_col="t", numeric_cols=["x"])
    out = b.augment_cols(signals.events_hour(spark, d))
    return _rounded(out.drop(*[c for c in out.columns if "_age_" in c]), ("t", "cat"))


_u = statements.numeric(uniform, "u", "x", "lagged")
_add("fir_augment", _augment, f"WITH {signals.EVENTS_HOUR}, lagged AS ({statements.lags(['x'], list(uniform.lag_steps), keep='t, i, x, n, cat')}), " + ", ".join(f"{n} AS ({b})" for n, b in _u) + f" SELECT t, cat, {statements.rounded(['x', 'n', 'u_num_x_wmean', 'u_num_x_wstd', 'u_num_x_wsum'])} FROM {_u[-1][0]}")


def _raw_offsets(spark, d):
    df = row_index(spark.read.parquet(f"{d}/events.parquet").select("event_id", "ts", "value"), ["ts", "event_id"], parts=8)
    b = KernelFeatureBuilder({"u": K.UniformKernel(3, 1.0)}, time_col="event_id", numeric_cols=["value"])
    out = b.transform(df)
    return _rounded(out.drop(*[c for c in out.columns if "_age_" in c]), ("event_id",))


_r = statements.numeric(K.UniformKernel(3, 1.0), "u", "value", "lagged")
_add("fir_raw_row_offsets", _raw_offsets, f"WITH sig AS (SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events), lagged AS ({statements.lags(['value'], [0, 1, 2, 3], keep='event_id, i')}), " + ", ".join(f"{n} AS ({b})" for n, b in _r) + f" SELECT event_id, {statements.rounded(['u_num_value_wmean', 'u_num_value_wstd', 'u_num_value_wsum'])} FROM {_r[-1][0]}")


def _multi_series(spark, d):
    df = spark.read.parquet(f"{d}/events.parquet").select("ts", "event_type", F.round(F.col("value") * 100).cast("long").alias("c"))
    per = df.groupBy("event_type", F.date_trunc("hour", "ts").alias("t")).agg((F.sum("c").cast("double") / 100.0).alias("x"))
    spine = regular_grid(df, "ts", "hour", {"n": F.count("*")}).select("t", INDEX)
    kinds = df.select("event_type").distinct().agg(F.collect_list("event_type").alias("k"))
    grid = spine.join(F.broadcast(kinds), F.lit(True)).select("t", INDEX, F.explode("k").alias("event_type"))
    full = grid.join(per.withColumn("t", F.col("t").cast("timestamp_ntz")), ["event_type", "t"], "left")
    b = KernelFeatureBuilder({"g": gamma}, time_col="t", numeric_cols=["x"], series_cols=["event_type"])
    out = b.transform(full)
    return _rounded(out.drop(*[c for c in out.columns if "_age_" in c]), ("event_type", "t"))


_ms = statements.numeric(gamma, "g", "x", "lagged")
_add(
    "fir_multi_series",
    _multi_series,
    "WITH b AS (SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS t, sum(CAST(round(value * 100) AS BIGINT))::DOUBLE / 100.0::DOUBLE AS x FROM events GROUP BY 1, 2), "
    "sp AS (SELECT lo, unnest(generate_series(lo, hi, INTERVAL 1 hour)) AS t FROM (SELECT min(t) AS lo, max(t) AS hi FROM b)), kinds AS (SELECT DISTINCT event_type FROM events), "
    "sig AS (SELECT k.event_type, sp.t, date_diff('hour', sp.lo, sp.t)::BIGINT AS i, b.x FROM sp CROSS JOIN kinds k LEFT JOIN b ON b.t = sp.t AND b.event_type = k.event_type), "
    f"lagged AS ({statements.lags(['x'], list(gamma.lag_steps), keep='event_type, t, i', partition='PARTITION BY event_type ')}), " + ", ".join(f"{n} AS ({b})" for n, b in _ms) + f" SELECT event_type, t, {statements.rounded(['g_num_x_wmean', 'g_num_x_wstd', 'g_num_x_wsum'])} FROM {_ms[-1][0]}",
)


def _report(spark, d):
    b = KernelFeatureBuilder({"u": uniform, "g": gamma}, time_col="t", numeric_cols=["x"])
    return b.transform_result(signals.orders_day(spark, d)).report_frame()


_rep_ctes, _src = [], "lagged"
for _n, _k in (("u", uniform), ("g", gamma)):
    _m = statements.numeric(_k, _n, "x", _src)
    _rep_ctes, _src = _rep_ctes + _m, _m[-1][0]
_rep_rows = [f"SELECT '{n}_num_x_{m}' AS feature_name, '{n}' AS kernel_name, count(*)::BIGINT AS row_count, count(*) FILTER ({n}_num_x_{m} IS NULL)::BIGINT AS missing_rows, count(*) FILTER ({n}_num_x_zero)::BIGINT AS zero_denominator_rows FROM {_src}" for n in ("u", "g") for m in fir.NUMERIC_METRICS]
_rep_rows += [f"SELECT '{n}_age_{m}', '{n}', count(*)::BIGINT, 0::BIGINT, 0::BIGINT FROM {_src}" for n in ("u", "g") for m in fir.AGE_METRICS]
_add("transform_report", _report, f"WITH {signals.ORDERS_DAY}, lagged AS ({statements.lags(['x'], list(gamma.lag_steps))}), " + ", ".join(f"{n} AS ({b})" for n, b in _rep_ctes) + " " + " UNION ALL ".join(_rep_rows))


def _registry(spark, d):
    b = KernelFeatureBuilder({"u": uniform, "g": gamma}, time_col="t", numeric_cols=["x"], category_cols=["cat"], category_levels={"cat": EVENT_TYPES})
    return b.transform_result(signals.events_hour(spark, d)).registry.to_frame(spark).drop("kernel_summary", "lag_steps")


_reg = []
for _n in ("u", "g"):
    _reg += [(f"{_n}_num_x_{m}", _n, "x", "numeric", m, None) for m in fir.NUMERIC_METRICS]
    _reg += [(f"{_n}_cat_cat_{v}_frac", _n, "cat", "categorical", "frac", v) for v in EVENT_TYPES] + [(f"{_n}_cat_cat_entropy", _n, "cat", "categorical", "entropy", None)]
    _reg += [(f"{_n}_age_{m}", _n, "t", "age", m, None) for m in fir.AGE_METRICS]
_add("feature_registry", _registry, "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL::VARCHAR" if v is None else f"'{v}'" for v in r) + ")" for r in _reg) + ") AS r(name, kernel_name, source_col, family, metric, category_level)")


def _evidence(spark, d):
    b = KernelFeatureBuilder({"u": uniform, "g": gamma}, time_col="t", numeric_cols=["x"])
    r = b.transform_result(signals.events_hour(spark, d))
    report = build_feature_evidence(builder=b, feature_registry=r.registry, candidate_id_by_kernel={"g": "gamma_1"})
    return feature_evidence_table(spark, report).groupBy("kernel_name", "evidence_completeness").count().withColumnRenamed("count", "n")


_add("feature_evidence", _evidence, "SELECT * FROM (VALUES ('u', 'kernel_only', 7::BIGINT), ('g', 'comparison_evidence', 7::BIGINT)) AS r(kernel_name, evidence_completeness, n)")

# grids


def _grid(time: str, unit: str, table: str):
    def query(spark, d):
        days = spark.read.parquet(f"{d}/{table}.parquet").select(F.date_trunc(unit, time).alias("t")).distinct()
        return grid_stats(days, "t")

    sql = f"WITH u AS (SELECT DISTINCT date_trunc('{unit}', {time})::TIMESTAMP AS t FROM {table}), s AS (SELECT (epoch_us(t) - lag(epoch_us(t)) OVER (ORDER BY t)) AS step FROM u) SELECT (SELECT count(*) FROM u)::BIGINT AS n_rows, 0::BIGINT AS n_null, (SELECT count(DISTINCT t) FROM u)::BIGINT AS n_distinct, min(step) / 1e6::DOUBLE AS min_step_s, max(step) / 1e6::DOUBLE AS max_step_s, (floor(sum(step) / min(step)) - count(step))::BIGINT AS gap_rows, coalesce(min(step) > 0 AND min(step) = max(step), false) AS is_regular FROM s"
    return query, sql


_add("grid_stats_events", *_grid("ts", "hour", "events"))
_add("grid_stats_orders", *_grid("o_orderdate", "day", "orders"))
_add("grid_stats_lineitem", *_grid("l_shipdate", "day", "lineitem"))
_add("grid_gaps", lambda spark, d: signals.orders_day(spark, d).where("x IS NULL").select("t", F.col(INDEX).alias("i")), f"WITH {signals.ORDERS_DAY} SELECT t, i FROM sig WHERE x IS NULL")

# kernels

FAMILY_KERNELS = [K.FixedDelayKernel(4, 8, 60.0), K.UniformKernel(8, 60.0), K.ExponentialKernel(0.01, 8, 60.0), K.DelayedExponentialKernel(120.0, 0.01, 8, 60.0), K.GammaKernel(2.5, 0.02, 8, 60.0), K.LogNormalKernel(5.0, 0.5, 8, 60.0), K.ErlangKernel(3, 0.02, 8, 60.0), K.tank_kernel(0.7, 8, 60.0)]
#: Kernels that are no density: where their weight lies.
_STATED = {"fixed_delay": "CASE WHEN k = 4 THEN 1.0 ELSE 0.0 END", "tank": "0.3 * pow(0.7, k)", "a": "pow(0.65, k)", "p": "CASE k WHEN 3 THEN 0.25 WHEN 4 THEN 0.5 ELSE 0.25 END", "g": "CASE k WHEN 1 THEN 0.2 WHEN 2 THEN 0.5 ELSE 0.3 END"}
_kc = statements.kernel_cte("k", FAMILY_KERNELS, _STATED)
# the same for the kernels of the feature queries above
USED_KERNELS = {"gamma_hours": gamma, "uniform_hours": uniform, "exponential_hours": K.ExponentialKernel(1 / 7200.0, 8, HOUR), "delayed_hours": K.DelayedExponentialKernel(7200.0, 1 / 7200.0, 8, HOUR), "lognormal_days": K.LogNormalKernel(12.5, 0.6, 10, DAY, 1), "erlang_days": K.ErlangKernel(3, 1 / 86400.0, 10, DAY), "gamma_days": K.GammaKernel(3.0, 1 / 172800.0, 20, DAY), "gamma_mass": K.GammaKernel(2.0, 1 / 129600.0, 7, DAY), "gamma_one": K.GammaKernel(1.0, 1 / 1200.0, 6, HOUR)}
_add("kernel_table_used", lambda spark, d: _rounded(K.kernels_frame(spark, [replace(k, name=n) for n, k in USED_KERNELS.items()]), ("kernel_name", "lag_step")), f"WITH {statements.kernel_cte('k', USED_KERNELS)} SELECT kernel_name, lag_step::INTEGER AS lag_step, {statements.rounded(['lag_time', 'weight'])} FROM k")
_add("kernel_table", lambda spark, d: _rounded(K.kernels_frame(spark, FAMILY_KERNELS), ("kernel_name", "lag_step")), f"WITH {_kc} SELECT kernel_name, lag_step::INTEGER AS lag_step, {statements.rounded(['lag_time', 'weight'])} FROM k")
_add(
    "kernel_summary",
    lambda spark, d: _rounded(K.summary_frame(K.kernels_frame(spark, FAMILY_KERNELS)), ("kernel_name", "n_lags")),
    f"WITH {_kc}, c AS (SELECT *, sum(weight) OVER (PARTITION BY kernel_name ORDER BY lag_step) AS cum, min(lag_time) OVER (PARTITION BY kernel_name) + 0.75 * (max(lag_time) OVER (PARTITION BY kernel_name) - min(lag_time) OVER (PARTITION BY kernel_name)) AS thr FROM k) "
    "SELECT kernel_name, count(*)::BIGINT AS n_lags, round(sum(weight), 9) + 0.0 AS weight_sum, round(sum(weight * lag_time), 9) + 0.0 AS mean_lag, round(coalesce(min(lag_time) FILTER (cum >= 0.5), max(lag_time)), 9) + 0.0 AS p50_lag, round(coalesce(min(lag_time) FILTER (cum >= 0.9), max(lag_time)), 9) + 0.0 AS p90_lag, round(sum(CASE WHEN lag_time >= thr THEN weight ELSE 0 END), 9) + 0.0 AS tail_mass FROM c GROUP BY 1",
)
_add(
    "kernel_shape",
    lambda spark, d: _rounded(K.shape_frame(K.kernels_frame(spark, FAMILY_KERNELS)), ("kernel_name",)),
    f"WITH {_kc} SELECT kernel_name, round(-sum(CASE WHEN weight > 0 THEN weight * ln(weight) ELSE 0 END) / ln(count(*)), 9) + 0.0 AS normalized_entropy, round(max(weight), 9) + 0.0 AS max_weight, round(min(weight), 9) + 0.0 AS min_weight, round(sum(weight * weight), 9) + 0.0 AS concentration_hhi, round(1.0 / sum(weight * weight), 9) + 0.0 AS effective_lag_count FROM k GROUP BY 1",
)
_ca, _cb = K.tank_kernel(0.65, 16, 60.0, "a"), K.GammaKernel(2.0, 0.02, 10, 60.0, name="b")
_add(
    "kernel_convolution",
    lambda spark, d: _rounded(K.convolve_frame(_ca.to_frame(spark), _cb.to_frame(spark)), ("lag_step",)),
    f"WITH {statements.kernel_cte('a', [_ca], _STATED)}, {statements.kernel_cte('b', [_cb])}, c AS (SELECT a.lag_step + b.lag_step AS lag_step, sum(a.weight * b.weight) AS w FROM a, b GROUP BY 1) SELECT lag_step::INTEGER AS lag_step, round(w / (SELECT sum(w) FROM c), 9) + 0.0 AS weight FROM c",
)
_cp = synthetic.discrete([3, 4, 5], [0.25, 0.5, 0.25], 60.0, "p")
_add(
    "kernel_recycle",
    lambda spark, d: _rounded(K.recycle(0.4, _cp, 6, "r").to_frame(spark).select("lag_step", "weight"), ("lag_step",)),
    f"WITH RECURSIVE {statements.kernel_cte('p', [_cp], _STATED)}, r AS (SELECT 0 AS n, lag_step, weight FROM p UNION ALL SELECT n + 1, lag_step, weight FROM (SELECT r.n, r.lag_step + p.lag_step AS lag_step, sum(r.weight * p.weight) AS weight FROM r, p WHERE r.n < 5 GROUP BY 1, 2)), m AS (SELECT lag_step, sum(0.4 * power(0.6, n) * weight) AS w FROM r GROUP BY 1) SELECT lag_step::INTEGER AS lag_step, round(w / (SELECT sum(w) FROM m), 9) + 0.0 AS weight FROM m",
)

# windows, baselines and simple learners

STEPS = list(range(0, 7))
_w = statements.windows(signals.EVENTS_HOUR, "n", "x", STEPS)


def _data(spark, d, **kw):
    return windows.prepare(signals.events_hour(spark, d), input_col="n", target_col="x", lags=STEPS, **kw)


_add("lag_windows", lambda spark, d: windows.lag_windows(signals.events_hour(spark, d), input_col="n", target_col="x", lags=STEPS).select("window_id", *[F.col("x")[k].alias(f"n_{k}") for k in STEPS], "y"), f"WITH {_w} SELECT window_id::BIGINT AS window_id, {', '.join(f'n_{k}' for k in STEPS)}, y0 AS y FROM raw")
_add("train_valid_split", lambda spark, d: _data(spark, d).windows.groupBy("is_train").agg(F.count("*").alias("windows"), F.min("window_id").alias("first_window"), F.max("window_id").alias("last_window")), f"WITH {_w} SELECT is_train, count(*)::BIGINT AS windows, min(window_id)::BIGINT AS first_window, max(window_id)::BIGINT AS last_window FROM win GROUP BY 1")


def _scaling(spark, d):
    f = _data(spark, d)
    return spark.createDataFrame([(round(f.x_scaling.center, 9), round(f.x_scaling.scale, 9), round(f.y_scaling.center, 9), round(f.y_scaling.scale, 9))], "x_center double, x_scale double, y_center double, y_scale double")


_add("robust_scaling", _scaling, f"WITH {_w} SELECT round(xs.c, 9) AS x_center, round(xs.s, 9) AS x_scale, round(ys.c, 9) AS y_center, round(ys.s, 9) AS y_scale FROM xs, ys")
_mean = f"({' + '.join(f'x_{k}' for k in STEPS)}) / {len(STEPS)}"
for _kind in ("huber", "mse"):

    def _baseline(spark, d, kind=_kind):
        return spark.createDataFrame([(k, round(v, 9)) for k, v in windows.baseline_losses(_data(spark, d), kind).items()], "baseline string, validation_loss double")

    _exp = ", ".join(f"avg({statements.loss(' + '.join(f'{num(w)} * x_{k}' for k, w in zip(STEPS, windows.exponential_weights(len(STEPS), a))) + ' - y', _kind)})" for a in windows.EXPONENTIAL_GRID)
    _singles = ", ".join(f"avg({statements.loss(f'x_{k} - y', _kind)})" for k in STEPS)
    _add(
        f"baselines_{_kind}",
        _baseline,
        f"WITH {_w}, v AS (SELECT * FROM win WHERE NOT is_train) SELECT 'no_lag' AS baseline, round(avg({statements.loss('x_0 - y', _kind)}), 9) AS validation_loss FROM v UNION ALL SELECT 'best_single_lag', round(least({_singles}), 9) FROM v UNION ALL SELECT 'uniform', round(avg({statements.loss(f'{_mean} - y', _kind)}), 9) FROM v UNION ALL SELECT 'exponential', round(least({_exp}), 9) FROM v",
    )
_lag_rows = " UNION ALL ".join(f"SELECT {k}::INTEGER AS lag_step, avg({statements.loss(f'x_{k} - y', 'huber')}) FILTER (is_train) AS train_loss, avg({statements.loss(f'x_{k} - y', 'huber')}) FILTER (NOT is_train) AS validation_loss FROM win" for k in STEPS)
_add("single_lag_losses", lambda spark, d: _rounded(windows.single_lag_losses(_data(spark, d)), ("lag_step",)), f"WITH {_w}, l AS ({_lag_rows}) SELECT lag_step, {statements.rounded(['train_loss', 'validation_loss'])} FROM l")


def _fit_row(spark, name, found):
    return spark.createDataFrame([(name, round(found["train_loss"], 9), round(found["validation_loss"], 9))], "learner string, train_loss double, validation_loss double")


_add("fit_fixed_delay", lambda spark, d: _fit_row(spark, "fixed_delay", learn.FixedDelayKernelLearner(6).solve(_data(spark, d), HOUR)), f"WITH {_w}, l AS ({_lag_rows}) SELECT 'fixed_delay' AS learner, round(train_loss, 9) AS train_loss, round(validation_loss, 9) AS validation_loss FROM l ORDER BY l.validation_loss, l.train_loss, lag_step LIMIT 1")
_usum = statements.loss(" + ".join(f"{num(1 / len(STEPS))} * x_{k}" for k in STEPS) + " - y", "huber")
_add("fit_uniform", lambda spark, d: _fit_row(spark, "uniform", learn.UniformKernelLearner(6).solve(_data(spark, d), HOUR)), f"WITH {_w} SELECT 'uniform' AS learner, round(avg({_usum}) FILTER (is_train), 9) AS train_loss, round(avg({_usum}) FILTER (NOT is_train), 9) AS validation_loss FROM win")


# reports on a fit: the uniform kernel, so that every figure is exact


def _uniform_fit(spark, d):
    data = _data(spark, d)
    learner = learn.UniformKernelLearner(6)
    return learn.assemble(learner, data, HOUR, learner.solve(data, HOUR), "n->x", {"input_col": "n", "target_col": "x"})


_ul = f"avg({_usum}) FILTER (NOT is_train)"
_single_valid = ", ".join("avg(" + statements.loss(f"x_{k} - y", "huber") + ") FILTER (NOT is_train)" for k in STEPS)
_exp_valid = ", ".join("avg(" + statements.loss(" + ".join(f"{num(w)} * x_{k}" for k, w in zip(STEPS, windows.exponential_weights(len(STEPS), a))) + " - y", "huber") + ") FILTER (NOT is_train)" for a in windows.EXPONENTIAL_GRID)
_losses = f"losses AS (SELECT {_ul} AS learned, avg({_usum}) FILTER (is_train) AS train, avg({statements.loss('x_0 - y', 'huber')}) FILTER (NOT is_train) AS no_lag, least({_single_valid}) AS best_single_lag, avg({statements.loss(f'{_mean} - y', 'huber')}) FILTER (NOT is_train) AS uniform, least({_exp_valid}) AS exponential FROM win)"
_add(
    "baseline_report",
    lambda spark, d: _rounded(diagnose.fit_result_baseline_summary_table(spark, _uniform_fit(spark, d)).where("baseline <> 'uniform'"), ("baseline", "beats_learned", "is_learned")),
    f"WITH {_w}, {_losses}, r AS (UNPIVOT (SELECT learned, no_lag, best_single_lag, exponential FROM losses) ON learned, no_lag, best_single_lag, exponential INTO NAME baseline VALUE v) SELECT baseline, round(v, 9) + 0.0 AS validation_loss, round(l.learned, 9) + 0.0 AS learned_validation_loss, round((l.learned - v) / greatest(abs(l.learned), 1e-12), 9) + 0.0 AS delta_fraction_vs_learned, baseline <> 'learned' AND v < l.learned AS beats_learned, baseline = 'learned' AS is_learned FROM r, losses l",
)
_add(
    "identifiability",
    lambda spark, d: diagnose.warning_summary_table(spark, _uniform_fit(spark, d).identifiability_report).select("warning_code", "warning_severity"),
    f"WITH {_w}, {_losses}, v AS (SELECT var_pop(x) AS vx, (SELECT var_pop(y) FROM win) AS vy FROM (SELECT unnest([{', '.join(f'x_{k}' for k in STEPS)}]) AS x FROM win)), rules AS ("
    "SELECT 'INPUT_TOO_FLAT' AS c, 'high' AS s, vx < 1e-8 AS hit FROM v UNION ALL SELECT 'TARGET_TOO_FLAT', 'high', vy < 1e-8 FROM v "
    "UNION ALL SELECT 'WEAK_NO_LAG_IMPROVEMENT', 'medium', (no_lag - learned) / greatest(no_lag, 1e-8) < 0.05 FROM losses "
    "UNION ALL SELECT 'LARGE_VALIDATION_GAP', 'high', learned / greatest(train, 1e-8) > 2 FROM losses "
    f"UNION ALL SELECT 'BOUNDARY_PILED_KERNEL', 'medium', {1 / 7 >= 0.35} UNION ALL SELECT 'DIFFUSE_KERNEL', 'medium', true "
    "UNION ALL SELECT 'BEST_SINGLE_LAG_BEATS_LEARNED', 'medium', (learned - best_single_lag) / greatest(learned, 1e-8) >= 0.05 FROM losses "
    "UNION ALL SELECT 'EXPONENTIAL_BASELINE_BEATS_LEARNED', 'medium', (learned - exponential) / greatest(learned, 1e-8) >= 0.05 FROM losses) SELECT c AS warning_code, s AS warning_severity FROM rules WHERE hit",
)

# learned kernels: rows only


def _fits(families: tuple[str, ...], epochs: int = 200):
    def query(spark, d):
        rows, plans = None, {}
        for f, (name, low, high) in families:
            s = synthetic.make_dataset(name)
            data = windows.prepare(s.frame(spark), input_col="input_signal", target_col="target_signal", lags=list(range(low, high + 1)))
            plans[f] = (f, data.lags, s.scenario["dt"], {}, {"loss": "huber", "delta": 1.0, "rate": 0.05, "epochs": epochs, "smoothness": 0.0})
            part = data.windows.select(F.lit(f).alias("fit_id"), "window_id", "x", "y", "is_train")
            rows = part if rows is None else rows.unionByName(part)
        return learn.solve_grouped(rows, plans).select("fit_id", F.size("weights").alias("n_lags"), "train_loss", "validation_loss", "parameters", "error")

    return query


_add("fit_learners", _fits((("simplex", ("spread_delay", 0, 12)), ("exponential", ("exponential_kernel", 1, 8)), ("gamma", ("gamma_kernel", 1, 10)), ("lognormal", ("lognormal_kernel", 1, 12)), ("erlang", ("erlang_kernel", 0, 12)), ("delayed_exponential", ("delayed_exponential_kernel", 0, 10)))))


def _shared(spark, d):
    s = synthetic.make_multi_pair_dataset()
    r = learn.SharedSimplexKernelLearner(8, max_epochs=100).fit(s.frame(spark), pairs=[(f"input_signal_{p}", f"target_signal_{p}") for p in "abc"], time_col="time")
    return spark.createDataFrame([(p.pair_id, p.succeeded, p.fit_result.kernel.mean_lag() if p.succeeded else None) for p in r.pairs], "pair_id string, succeeded boolean, mean_lag double")


_add("fit_shared", _shared)

# candidates: fixed kernels, so the comparison is exact

_CANDIDATES = {"a_delay": ("fixed_delay", {"delay_steps": 0}), "b_uniform": ("uniform", {}), "c_exponential": ("exponential", {"rate_lambda": 1 / 1800.0}), "d_gamma": ("gamma", {"shape_alpha": 1.0, "rate_beta": 1 / 1200.0})}


def _candidate_set():
    made = [candidates.KernelCandidate(k, f, "fixed_kernel", 6, 0, p) for k, (f, p) in _CANDIDATES.items()]
    made += [candidates.KernelCandidate("y_no_lag", "no_lag", "baseline", 6), candidates.KernelCandidate("z_broken", "gamma", "fixed_kernel", 6, 0, {"rate_beta": 1.0})]
    return candidates.KernelCandidateSet("n", "x", "t", tuple(made))


def _compared(spark, d):
    df = signals.events_hour(spark, d)
    return candidates.fit_kernel_candidates(df, _candidate_set())


def _comparison(spark, d):
    table = candidates.comparison_table(spark, _compared(spark, d))
    return table.select("candidate_id", "family", "candidate_type", "succeeded", F.round("validation_loss", 9).alias("validation_loss"), F.round("train_loss", 9).alias("train_loss"), "n_parameters", "beats_no_lag", "beats_best_single_lag")


def _candidate_sql() -> str:
    rows = []
    for k, (f, p) in _CANDIDATES.items():
        kernel = candidates.fixed_kernel(candidates.KernelCandidate(k, f, "fixed_kernel", 6, 0, p), HOUR)
        s = statements.loss(" + ".join(f"{num(w)} * x_{j}" for j, w in zip(STEPS, kernel.weights)) + " - y", "huber")
        rows.append(f"SELECT '{k}' AS candidate_id, '{f}' AS family, 'fixed_kernel' AS candidate_type, true AS succeeded, avg({s}) FILTER (NOT is_train) AS v, avg({s}) FILTER (is_train) AS tr, {len(p)}::BIGINT AS n_parameters FROM win")
    return f"WITH {_w}, base AS (SELECT avg({statements.loss('x_0 - y', 'huber')}) AS no_lag, least({', '.join('avg(' + statements.loss(f'x_{k} - y', 'huber') + ')' for k in STEPS)}) AS single FROM win WHERE NOT is_train), c AS ({' UNION ALL '.join(rows)})"


_add(
    "candidate_comparison",
    _comparison,
    _candidate_sql() + " SELECT candidate_id, family, candidate_type, succeeded, round(v, 9) AS validation_loss, round(tr, 9) AS train_loss, n_parameters, v < no_lag AS beats_no_lag, v < single AS beats_best_single_lag FROM c, base UNION ALL SELECT 'y_no_lag', 'no_lag', 'baseline', true, round(no_lag, 9), NULL, 0::BIGINT, NULL, NULL FROM base UNION ALL SELECT 'z_broken', 'gamma', 'fixed_kernel', false, NULL, NULL, NULL, NULL, NULL",
)
_add(
    "candidate_selection",
    lambda spark, d: candidates.select_frame(candidates.comparison_table(spark, _compared(spark, d))).select("candidate_id", "family", F.round("validation_loss", 9).alias("validation_loss"), "simplicity_rank"),
    _candidate_sql() + ", ok AS (SELECT c.*, min(v) OVER () AS lo FROM c, base WHERE v < no_lag AND v < single) SELECT candidate_id, family, round(v, 9) AS validation_loss, 1::INTEGER AS simplicity_rank FROM ok WHERE (v - lo) / greatest(lo, 1e-12) <= 0.02 ORDER BY v, candidate_id LIMIT 1",
)


def _bootstrap(spark, d):
    df = signals.events_hour(spark, d)
    cs = candidates.KernelCandidateSet("n", "x", "t", (candidates.KernelCandidate("simplex", "simplex", "learner", 4), candidates.KernelCandidate("uniform", "uniform", "fixed_kernel", 4)))
    fitted = candidates.fit_kernel_candidates(df, cs, max_epochs=60)
    r = bootstrap.bootstrap_kernel_candidates(df, fitted, input_col="n", target_col="x", config=bootstrap.BlockedBootstrapConfig(8, 24, 11), max_epochs=60)
    return r.weight_intervals()


_add("bootstrap_intervals", _bootstrap)
#: The block starts that NumPy's default generator draws from seed 3 for five replicates of 200 windows in blocks of 16: fixed values.
_STARTS = [
    [150, 15, 33, 43, 33, 148, 160, 107, 7, 17, 61, 80, 114],
    [88, 48, 29, 127, 135, 6, 21, 83, 72, 164, 95, 77, 79],
    [123, 108, 31, 136, 139, 176, 145, 52, 59, 119, 120, 128, 160],
    [54, 173, 0, 14, 180, 174, 55, 25, 58, 7, 164, 122, 108],
    [45, 87, 35, 143, 87, 5, 47, 130, 96, 69, 46, 16, 112],
]
_add(
    "bootstrap_splits",
    lambda spark, d: bootstrap.splits_frame(spark, 200, bootstrap.BlockedBootstrapConfig(5, 16, 3)),
    "WITH r(b, starts) AS (VALUES " + ", ".join(f"({b}, {s})" for b, s in enumerate(_STARTS)) + "), blocks AS (SELECT b, n, starts[n + 1] AS s FROM r, generate_series(0, 12) AS g(n)), drawn AS (SELECT b, s + k AS w FROM blocks, generate_series(0, 15) AS g(k) WHERE n * 16 + k < 200) SELECT b::BIGINT AS bootstrap_id, w::BIGINT AS window_id, count(*)::BIGINT AS count FROM drawn GROUP BY 1, 2",
)

# bootstrap tables over samples that SQL can make as well
_add(
    "bootstrap_interval_table",
    lambda spark, d: _rounded(bootstrap.interval(spark.range(300).selectExpr("id % 3 AS lag_step", "cast(id * 7919 % 1009 AS double) / 1000 AS weight"), ["lag_step"], "weight", "weight_estimate"), ("lag_step", "n_samples")),
    "WITH s AS (SELECT i % 3 AS lag_step, (i * 7919 % 1009)::DOUBLE / 1000 AS w FROM generate_series(0, 299) AS g(i)) SELECT lag_step, round(avg(w), 9) + 0.0 AS weight_estimate, round(quantile_cont(w, 0.025), 9) + 0.0 AS lower, round(quantile_cont(w, 0.975), 9) + 0.0 AS upper, round(stddev_pop(w), 9) + 0.0 AS bootstrap_std, count(*)::BIGINT AS n_samples FROM s GROUP BY 1",
)
_add(
    "bootstrap_selection",
    lambda spark, d: bootstrap.select_replicates(spark.range(400).selectExpr("id div 4 AS bootstrap_id", "concat('c', id % 4) AS candidate_id", "cast(id % 4 % 3 + 1 AS int) AS simplicity_rank", "1 + cast(id * 31 % 101 AS double) / 2000 AS validation_loss")),
    "WITH s AS (SELECT i // 4 AS b, 'c' || (i % 4) AS c, i % 4 % 3 + 1 AS r, 1 + (i * 31 % 101)::DOUBLE / 2000 AS v FROM generate_series(0, 399) AS g(i)), p AS (SELECT *, min(v) OVER (PARTITION BY b) AS lo FROM s), q AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY r, v, c) AS n FROM p WHERE (v - lo) / greatest(lo, 1e-12) <= 0.02) SELECT b::BIGINT AS bootstrap_id, c AS candidate_id FROM q WHERE n = 1",
)

# out of fold

_SPLIT = oof.ForwardChainingSplitConfig(4, 200, 100, 12, 300)
_FOLDS = oof.forward_chaining(700, _SPLIT)
_add(
    "oof_splits",
    lambda spark, d: oof.folds_frame(spark, _FOLDS),
    "SELECT f::INTEGER AS fold_id, greatest(0, 200 + f * 100 - 300)::BIGINT AS train_start, (200 + f * 100)::BIGINT AS train_end, (212 + f * 100)::BIGINT AS validation_start, (312 + f * 100)::BIGINT AS validation_end, 12::BIGINT AS gap FROM generate_series(0, 3) AS g(f)",
)


def _oof_fixed(spark, d):
    df = signals.events_hour(spark, d).select("t", INDEX, "x")
    # as many folds of 100 rows as the grid holds
    folds = oof.forward_chaining((n := df.count()), replace(_SPLIT, n_folds=max(1, (n - 212) // 100)))
    out = oof.fixed_oof(df, gamma, folds, time_col="t", kernel_name="o", numeric_cols=["x"])
    return _rounded(out.select("t", "fold_id", *[ident(f"o_num_x_{m}") for m in fir.NUMERIC_METRICS]), ("t", "fold_id"))


_of = statements.numeric(gamma, "o", "x", "lagged")
_add(
    "oof_fixed_kernel",
    _oof_fixed,
    f"WITH {signals.EVENTS_HOUR.replace(', sig AS (', ', sig0 AS (')}, folds AS (SELECT f AS fold_id, 212 + f * 100 AS vs, 312 + f * 100 AS ve FROM generate_series(0, (SELECT greatest(1, (count(*) - 212) // 100) - 1 FROM sig0)) AS g(f)), sig AS (SELECT s.t, f.fold_id, s.i - f.vs AS i, s.x FROM sig0 s JOIN folds f ON s.i >= f.vs AND s.i < f.ve), lagged AS ({statements.lags(['x'], list(gamma.lag_steps), keep='t, fold_id, i', partition='PARTITION BY fold_id ')}), " + ", ".join(f"{n} AS ({b})" for n, b in _of) + f" SELECT s.t, e.fold_id::INTEGER AS fold_id, {statements.rounded(['o_num_x_wmean', 'o_num_x_wstd', 'o_num_x_wsum'])} FROM sig0 s LEFT JOIN {_of[-1][0]} e ON e.t = s.t",
)


def _oof_learned(spark, d):
    s = synthetic.make_dataset("spread_delay", n_rows=400)
    r = oof.fit_transform_oof(s.frame(spark), input_col="input_signal", target_col="target_signal", time_col="time", split_config=oof.ForwardChainingSplitConfig(2, 150, 100), learner=learn.SimplexKernelLearner(10, max_epochs=60))
    return r.features.select("time", "fold_id", *[ident(f"oof_num_input_signal_{m}") for m in fir.NUMERIC_METRICS])


_add("oof_learned", _oof_learned)

# simulation and graph evidence

_gk = synthetic.discrete([1, 2, 3], [0.2, 0.5, 0.3], DAY, "g")
_add(
    "genealogy_mass",
    lambda spark, d: _rounded(synthetic.mass_closure(synthetic.genealogy(signals.lineitem_day(spark, d), _gk.to_frame(spark), mass_col="m", unit="mill", path="main")), ("output_time", "is_warmup", "n_sources")),
    f"WITH {signals.LINEITEM_DAY}, {statements.kernel_cte('k', [_gk], _STATED)} SELECT (s.i + k.lag_step)::BIGINT AS output_time, s.i + k.lag_step < 3 AS is_warmup, count(*)::BIGINT AS n_sources, round(sum(k.weight), 9) + 0.0 AS total_fraction, round(sum(s.m * k.weight), 9) + 0.0 AS total_mass FROM sig s, k WHERE s.i + k.lag_step <= (SELECT max(i) FROM sig) GROUP BY 1, 2",
)
_add(
    "partial_fir",
    lambda spark, d: _rounded(fir.partial_fir(signals.events_hour(spark, d).select("t", INDEX, "n"), "n", gamma, "y").select("t", "y")),
    f"WITH {signals.EVENTS_HOUR}, lagged AS ({statements.lags(['n'], list(gamma.lag_steps))}) SELECT t, round({' + '.join(f'coalesce(n_{k}, 0.0::DOUBLE) * {num(w)}' for k, w in zip(gamma.lag_steps, gamma.weights))}, 9) + 0.0 AS y FROM lagged",
)
_GRAPH = [[["", "-->", ""], ["", "", "-->"]], [["o-o", "-->", "-->"], ["", "", ""]]]
_PVAL = [[[1.0, 0.01, 0.5], [1.0, 0.5, 0.02]], [[0.9, 0.03, 0.04], [1.0, 0.5, 0.5]]]
_links = [(s, t, k, m, _PVAL[i][j][k]) for i, t in enumerate("ab") for j, s in enumerate("ab") for k, m in enumerate(_GRAPH[i][j]) if m == "-->" and k]
_lv = ", ".join(f"('{s}', '{t}', {k}, '{m}', {num(p)})" for s, t, k, m, p in _links)
_add("graph_lag_candidates", lambda spark, d: graph.lag_candidates(spark, _GRAPH, ["a", "b"], p_matrix=_PVAL).drop("value"), f"SELECT source, target, tau::INTEGER AS tau, mark, p_value FROM (VALUES {_lv}) AS l(source, target, tau, mark, p_value)")
_add("graph_lag_table", lambda spark, d: graph.lag_candidate_table(graph.lag_candidates(spark, _GRAPH, ["a", "b"])).drop("taus"), f"SELECT source, target, count(*)::BIGINT AS n_links, min(tau)::INTEGER AS min_tau, max(tau)::INTEGER AS max_tau FROM (VALUES {_lv}) AS l(source, target, tau, mark, p_value) GROUP BY 1, 2")
_sk = K.UniformKernel(4, 1.0)
_add("kernel_support_mass", lambda spark, d: _rounded(graph.support_mass(_sk.to_frame(spark), graph.parent_pairs(spark, _GRAPH, ["a", "b"])), ("agrees", "n_shared_lags")), f"WITH {statements.kernel_cte('k', [_sk])}, l(tau) AS (VALUES (1), (2)) SELECT round(coalesce(sum(weight) FILTER (tau IS NOT NULL), 0), 9) + 0.0 AS mass_inside, round(coalesce(sum(weight) FILTER (tau IS NULL), 0), 9) + 0.0 AS mass_outside, coalesce(sum(weight) FILTER (tau IS NULL), 0) <= 0.2 AS agrees, count(tau)::BIGINT AS n_shared_lags FROM k LEFT JOIN l ON l.tau = k.lag_step")
_add(
    "graph_link_summary",
    lambda spark, d: graph.link_summary(graph.lag_candidates(spark, _GRAPH, ["a", "b"], p_matrix=_PVAL)).select("source", "target", F.concat_ws(",", "lag_steps").alias("lag_steps"), "min_lag_steps", "max_lag_steps", "median_lag_steps", F.concat_ws(",", "graph_marks").alias("graph_marks"), "p_value_min", "p_value_max"),
    f"SELECT source, target, string_agg(tau, ',' ORDER BY tau) AS lag_steps, min(tau)::INTEGER AS min_lag_steps, max(tau)::INTEGER AS max_lag_steps, floor(median(tau))::INTEGER AS median_lag_steps, min(mark) AS graph_marks, min(p_value) AS p_value_min, max(p_value) AS p_value_max FROM (VALUES {_lv}) AS l(source, target, tau, mark, p_value) GROUP BY 1, 2",
)
