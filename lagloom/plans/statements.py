"""SQL statements of the feature expressions, written from the definitions and not from the plans."""

from __future__ import annotations

from lagloom.functions.kernels import Kernel


def num(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def lags(columns: list[str], steps: list[int], source: str = "sig", keep: str = "t, i", partition: str = "") -> str:
    w = f"({partition}ORDER BY i)"
    return f"SELECT {keep}, " + ", ".join(f"lag({c}, {k}) OVER {w} AS {c}_{k}" for c in columns for k in steps) + f" FROM {source}"


def _weights(kernel: Kernel, mass: str | None) -> list[str]:
    return [f"{num(w)} * {mass}_{k}" if mass else num(w) for w, k in zip(kernel.weights, kernel.lag_steps)]


def _denominator(kernel: Kernel, mass: str | None) -> str:
    if mass:
        return " + ".join(_weights(kernel, mass))
    total = kernel.weights[0]
    for w in kernel.weights[1:]:
        total += w
    return num(total)


def present(kernel: Kernel, columns: list[str]) -> str:
    return f"i >= {kernel.max_lag_steps} AND " + " AND ".join(f"{c}_{k} IS NOT NULL" for c in columns for k in kernel.lag_steps)


def numeric(kernel: Kernel, name: str, column: str, source: str, mass: str | None = None, keep: str = "*") -> list[tuple[str, str]]:
    """CTEs (name, body) that add the three numeric features to source."""
    p = f"{name}_num_{column}"
    a = _weights(kernel, mass)
    there = present(kernel, [column, *([mass] if mass else [])])
    s = " + ".join(f"{w} * {column}_{k}" for w, k in zip(a, kernel.lag_steps))
    v = " + ".join(f"{w} * (({column}_{k} - {p}_wmean) * ({column}_{k} - {p}_wmean))" for w, k in zip(a, kernel.lag_steps))
    return [
        (f"{p}_a", f"SELECT *, ({there}) AS {p}_there, {_denominator(kernel, mass)} AS {p}_d FROM {source}"),
        (f"{p}_b", f"SELECT *, CASE WHEN {p}_there AND abs({p}_d) > 1e-12 THEN {s} END AS {p}_wsum FROM {p}_a"),
        (f"{p}_c", f"SELECT *, {p}_wsum / {p}_d AS {p}_wmean FROM {p}_b"),
        (f"{p}_e", f"SELECT *, CASE WHEN {p}_wmean IS NOT NULL THEN sqrt(greatest(({v}) / {p}_d, 0.0::DOUBLE)) END AS {p}_wstd, coalesce({p}_there AND abs({p}_d) <= 1e-12, false) AS {p}_zero FROM {p}_c"),
    ]


def categorical(kernel: Kernel, name: str, column: str, levels: list[str], source: str, mass: str | None = None) -> list[tuple[str, str]]:
    p = f"{name}_cat_{column}"
    a = _weights(kernel, mass)
    there = present(kernel, [column, *([mass] if mass else [])])
    shares = []
    for level in levels:
        s = " + ".join(f"CASE WHEN {column}_{k} = '{level}' THEN {w} ELSE 0.0::DOUBLE END" for w, k in zip(a, kernel.lag_steps))
        shares.append(f'CASE WHEN {p}_ok THEN ({s}) / {p}_d END AS "{p}_{level}_frac"')
    terms = " + ".join(f'CASE WHEN "{p}_{v}_frac" > 0 THEN "{p}_{v}_frac" * ln("{p}_{v}_frac") ELSE 0.0::DOUBLE END' for v in levels)
    return [
        (f"{p}_a", f"SELECT *, ({there}) AS {p}_there, {_denominator(kernel, mass)} AS {p}_d FROM {source}"),
        (f"{p}_b", f"SELECT *, {p}_there AND abs({p}_d) > 1e-12 AS {p}_ok FROM {p}_a"),
        (f"{p}_c", f"SELECT *, {', '.join(shares)} FROM {p}_b"),
        (f"{p}_e", f"SELECT *, CASE WHEN {p}_ok THEN -({terms}) + 0.0 END AS {p}_entropy FROM {p}_c"),
    ]


def rounded(columns: list[str], digits: int = 9) -> str:
    return ", ".join(f'round("{c}", {digits}) + 0.0 AS "{c}"' for c in columns)


def features(signal: str, kernels: dict[str, Kernel], numeric_cols: list[str], category: dict[str, list[str]] | None = None, mass: str | None = None, ages: bool = False, digits: int = 9, stated: dict[str, str] | None = None) -> str:
    """The whole statement: t and the rounded features."""
    category = category or {}
    steps = sorted({k for x in kernels.values() for k in x.lag_steps})
    columns = [*numeric_cols, *category, *([mass] if mass else [])]
    ctes, source, names = [("lagged", lags(columns, steps))], "lagged", []
    for kn, k in kernels.items():
        for c in numeric_cols:
            made = numeric(k, kn, c, source, mass)
            ctes, source = ctes + made, made[-1][0]
            names += [f"{kn}_num_{c}_{m}" for m in ("wmean", "wstd", "wsum")]
        for c, levels in category.items():
            made = categorical(k, kn, c, levels, source, mass)
            ctes, source = ctes + made, made[-1][0]
            names += [*(f"{kn}_cat_{c}_{v}_frac" for v in levels), f"{kn}_cat_{c}_entropy"]
    extra = ""
    if ages:
        ctes = [("age", "SELECT kernel_name, sum(weight * lag_time) AS mean, min(lag_time) FILTER (cum >= 0.5) AS p50, min(lag_time) FILTER (cum >= 0.9) AS p90, coalesce(sum(weight) FILTER (lag_time >= threshold), 0) AS tail_gt_threshold FROM (SELECT *, sum(weight) OVER (PARTITION BY kernel_name ORDER BY lag_step) AS cum, min(lag_time) OVER (PARTITION BY kernel_name) + 0.75 * (max(lag_time) OVER (PARTITION BY kernel_name) - min(lag_time) OVER (PARTITION BY kernel_name)) AS threshold FROM kern) GROUP BY 1"), *ctes]
        extra = "".join(f", round((SELECT {m} FROM age WHERE kernel_name = '{kn}'), {digits}) + 0.0 AS {kn}_age_{m}" for kn in kernels for m in ("mean", "p50", "p90", "tail_gt_threshold"))
    head = f"{signal}, {kernel_cte('kern', kernels, stated)}" if ages else signal
    return f"WITH {head}, " + ", ".join(f"{n} AS ({b})" for n, b in ctes) + " SELECT t" + (f", {rounded(names, digits)}" if names else "") + extra + f" FROM {source}"


def density(kernel: Kernel) -> str:
    """The family's density at lag time t (in seconds) and step k, up to a factor: from its definition, not from the weights."""
    p = {k: num(v) for k, v in kernel.parameters.items()}
    gamma = "CASE WHEN t > 0 THEN pow(t, {a} - 1) * exp(-{b} * t) WHEN {a} = 1 THEN 1.0 ELSE 0.0 END"
    return {
        "uniform": lambda: "1.0",
        "exponential": lambda: f"exp(-{p['rate_lambda']} * t)",
        "delayed_exponential": lambda: f"CASE WHEN t < {p['delay']} THEN 0.0 ELSE exp(-{p['rate_lambda']} * (t - {p['delay']})) END",
        "gamma": lambda: gamma.format(a=p["shape_alpha"], b=p["rate_beta"]),
        "erlang": lambda: gamma.format(a=p["shape_k"], b=p["rate_beta"]),
        "lognormal": lambda: f"CASE WHEN t > 0 THEN exp(-pow((ln(t) - {p['log_mu']}) / {p['log_sigma']}, 2) / 2) / t ELSE 0.0 END",
    }[kernel.family]()


def kernel_cte(name: str, kernels: list[Kernel] | dict[str, Kernel], stated: dict[str, str] | None = None) -> str:
    """CTE name(kernel_name, lag_step, lag_time, weight): each density on the kernel's lags, normalised.

    stated: densities in SQL (of t and k) of kernels without a family, by name.
    """
    named = kernels if isinstance(kernels, dict) else {k.name: k for k in kernels}
    rows = " UNION ALL ".join(f"SELECT '{n}' AS kernel_name, k AS lag_step, t AS lag_time, ({(stated or {}).get(n) or density(x)})::DOUBLE AS w FROM (SELECT k::BIGINT AS k, k * {num(x.dt)} AS t FROM generate_series({x.min_lag_steps}, {x.max_lag_steps}) AS g(k))" for n, x in named.items())
    return f"{name}(kernel_name, lag_step, lag_time, weight) AS (SELECT kernel_name, lag_step, lag_time, w / sum(w) OVER (PARTITION BY kernel_name) FROM ({rows}))"


def windows(signal: str, x: str, y: str, steps: list[int]) -> str:
    """CTE win(window_id, x_<k>..., y): complete windows in time order, scaled by the training part."""
    need = " AND ".join(f"{x}_{k} IS NOT NULL" for k in steps)
    xs = ", ".join(f"{x}_{k}" for k in steps)
    return (
        f"{signal}, lagged AS (SELECT t, i, {y} AS y0, {', '.join(f'lag({x}, {k}) OVER (ORDER BY i) AS {x}_{k}' for k in sorted({0, *steps}))} FROM sig), "
        f"raw AS (SELECT row_number() OVER (ORDER BY i) - 1 AS window_id, *, count(*) OVER () AS n FROM lagged WHERE y0 IS NOT NULL AND {need}), "
        "cut AS (SELECT *, window_id < greatest(least(floor(n * 0.8)::BIGINT, n - 1), 1) AS is_train FROM raw), "
        f"flat AS (SELECT unnest([{xs}]) AS v FROM cut WHERE is_train), "
        "xs AS (SELECT quantile_cont(v, 0.5) AS c, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS s FROM flat), "
        "ys AS (SELECT quantile_cont(y0, 0.5) AS c, quantile_cont(y0, 0.75) - quantile_cont(y0, 0.25) AS s FROM cut WHERE is_train), "
        f"win AS (SELECT window_id, is_train, {', '.join(f'({x}_{k} - xs.c) / xs.s AS x_{k}' for k in sorted({0, *steps}))}, (y0 - ys.c) / ys.s AS y FROM cut, xs, ys)"
    )


def loss(residual: str, kind: str, delta: float = 1.0) -> str:
    if kind == "mse":
        return f"({residual}) * ({residual})"
    return f"(0.5 * least(abs({residual}), {num(delta)}) * least(abs({residual}), {num(delta)}) + {num(delta)} * (abs({residual}) - least(abs({residual}), {num(delta)})))"
