"""Lagged windows for fitting: design rows, chronological split, robust scaling, losses and baselines.

All of it is DataFrame work: a window is a row with the array of its lagged
inputs, so data of any length is prepared where it lies.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from lagloom.operators import fir
from lagloom.operators.fir import ident
from lagloom.sources.grid import INDEX

EPS = 1e-12
EXPONENTIAL_GRID = [4.0 * k / 32 for k in range(33)]
MIN_WINDOWS = 8
#: Values that one task may hold, and bins of a counting pass.
FEW, BINS = 200_000, 1024
#: Terms that a sum over lags writes out.
UNROLLED = 16
MARGIN = 0.05


def lag_windows(df: DataFrame, *, input_col: str, target_col: str, lags: list[int]) -> DataFrame:
    """window_id (from 0, in time order), _idx, x (inputs by ascending lag), x0 (input now) and y of every finite window."""
    if input_col == target_col:
        raise ValueError("input and target must be different columns")
    made, cols = fir.with_lags(df.select(INDEX, ident(input_col).alias("_in"), ident(target_col).alias("_out")), {"x": fir.finite(F.col("_in"))}, {0, *lags})
    y = fir.finite(F.col("_out"))
    usable = y.isNotNull()
    for k in lags:
        usable = usable & cols["x"][k].isNotNull()
    rows = made.where(usable).select(INDEX, F.array(*[cols["x"][k] for k in lags]).alias("x"), cols["x"][0].alias("x0"), y.alias("y"))
    return numbered(rows)


def numbered(rows: DataFrame, chunk: int = fir.CHUNK) -> DataFrame:
    """window_id by _idx: counted per chunk of the index, chunks added up, so no task sees all rows."""
    part = F.floor(F.col(INDEX) / chunk)
    sizes = rows.groupBy(part.alias("_part")).count()
    before = F.coalesce(F.sum("count").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    number = F.row_number().over(W.partitionBy("_part").orderBy(INDEX)) - 1
    return rows.withColumn("_part", part).join(offsets, "_part").withColumn("window_id", (number + F.col("_before")).cast("long")).drop("_part", "_before")


@dataclass(frozen=True)
class Scaling:
    center: float
    scale: float


def robust_scaling(values: DataFrame, column: str = "v") -> Scaling:
    """Median and interquartile range; the deviation, then 1, where that is no spread."""
    return robust_scalings(values.select(F.lit("v").alias("kind"), F.col(column).alias("v"))).get("v", Scaling(0.0, 1.0))


def ranked(values: DataFrame, wanted: list[tuple[str, int]]) -> dict[tuple[str, int], float]:
    """The value of each wanted (kind, rank from 0) among the values (kind, v), exactly.

    Every pass counts the values of each open range in ``BINS`` equal bins and goes
    on with the bin that holds the rank, until a bin has one value or few values
    in all.  So no task and no buffer holds more than ``FEW`` values of a kind.
    """
    out, open_ = {}, {}
    edges = {r.kind: (r.lo, r.hi, r.n) for r in values.groupBy("kind").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).collect()}  # a row a kind
    for kind, rank in wanted:
        lo, hi, n = edges[kind]
        open_[kind, rank] = (lo, hi, rank, n)
    while open_:
        few, ranges = {}, {}
        for key, (lo, hi, rank, n) in open_.items():
            if lo == hi:
                out[key] = lo
            else:
                (few if n <= FEW else ranges)[key] = (lo, hi, rank, n)
        if few:
            spans = sorted({(k, lo, hi) for (k, _), (lo, hi, _, _) in few.items()})
            inside = F.explode(F.filter(F.array(*[F.when((F.col("kind") == k) & F.col("v").between(lo, hi), F.lit(n)) for n, (k, lo, hi) in enumerate(spans)]), lambda x: x.isNotNull())).alias("span")
            sets = {r.span: r.vs for r in values.select(inside, "v").groupBy("span").agg(F.array_sort(F.collect_list("v")).alias("vs")).collect()}  # FEW values a span
            for key, (lo, hi, rank, _) in few.items():
                out[key] = sets[spans.index((key[0], lo, hi))][rank]
        open_ = {}
        if ranges:
            spans = sorted({(k, lo, hi) for (k, _), (lo, hi, _, _) in ranges.items()})
            place = [F.when((F.col("kind") == k) & F.col("v").between(lo, hi), F.struct(F.lit(n).alias("span"), F.least(F.lit(BINS - 1), F.floor((F.col("v") / 2 - lo / 2) / (hi / 2 - lo / 2) * BINS)).alias("bin"))) for n, (k, lo, hi) in enumerate(spans)]
            counts = values.select("v", F.explode(F.filter(F.array(*place), lambda x: x.isNotNull())).alias("p")).groupBy("p.span", "p.bin").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()  # BINS rows a span
            bins: dict[int, list] = {}
            for r in sorted(counts, key=lambda r: r.lo):
                bins.setdefault(r.span, []).append(r)
            for key, (lo, hi, rank, _) in ranges.items():
                for r in bins[spans.index((key[0], lo, hi))]:
                    if rank < r.n:
                        open_[key] = (r.lo, r.hi, rank, r.n)
                        break
                    rank -= r.n
    return out


def robust_scalings(values: DataFrame) -> dict[str, Scaling]:
    """The scaling of every kind of the values (kind, v): median and quartile range, exactly and at any size."""
    values, out = values.where("v IS NOT NULL"), {}
    counts = values.groupBy("kind").agg(F.count("*").alias("n"), F.stddev_pop("v").alias("sd")).collect()  # a row a kind
    if max((r.n for r in counts), default=0) <= FEW:
        q = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        quartiles = {r.kind: list(r.q) for r in values.groupBy("kind").agg(q.alias("q")).collect()}
    else:
        at = {r.kind: [q * (r.n - 1) for q in (0.25, 0.5, 0.75)] for r in counts}
        found = ranked(values, sorted({(k, int(f(x))) for k, xs in at.items() for x in xs for f in (math.floor, math.ceil)}))
        quartiles = {k: [(1 - x % 1) * found[k, math.floor(x)] + x % 1 * found[k, math.ceil(x)] for x in xs] for k, xs in at.items()}
    for r in counts:
        low, middle, high = quartiles[r.kind]
        scale = high - low
        if scale <= EPS:
            scale = r.sd if r.sd is not None and r.sd > EPS else 1.0
        out[r.kind] = Scaling(middle, scale)
    return out


def train_end(n: int, validation_fraction: float) -> int:
    """Windows before this one train."""
    return min(max(int(n * (1 - validation_fraction)), 1), n - 1)


@dataclass
class FitData:
    """Scaled windows (window_id, x, x0, y, is_train) and what they were scaled with."""

    windows: DataFrame
    lags: list[int]
    rows: DataFrame
    n_windows: int
    n_train: int
    x_scaling: Scaling
    y_scaling: Scaling
    x0_scaling: Scaling

    held: DataFrame | None = None

    @property
    def n_rows(self) -> int:
        return self.rows.count()

    def release(self) -> None:
        """Give up the stored windows; they are made anew if still asked for."""
        if self.held is not None:
            self.held.unpersist()

    def __enter__(self) -> FitData:
        return self

    def __exit__(self, *_) -> None:
        self.release()


def prepare(df: DataFrame, *, input_col: str, target_col: str, lags: list[int], validation_fraction: float = 0.2, own_x0_scaling: bool = False) -> FitData:
    """Windows split in time and scaled by the statistics of the training part.

    The input now is scaled like the inputs, or, with own_x0_scaling and no lag
    0, by its own statistics.
    """
    raw = lag_windows(df, input_col=input_col, target_col=target_col, lags=lags).persist(StorageLevel.MEMORY_AND_DISK)
    n = raw.count()
    if n < MIN_WINDOWS:
        raw.unpersist()
    if n == 0:
        raise ValueError("no window is complete")
    if n < MIN_WINDOWS:
        raise ValueError(f"{n} complete windows; at least {MIN_WINDOWS} are needed")
    cut = train_end(n, validation_fraction)
    train = raw.where(F.col("window_id") < cut)
    kinds = [F.transform("x", lambda v: F.struct(F.lit("x").alias("kind"), v.alias("v"))), *[F.array(F.struct(F.lit(k).alias("kind"), F.col(k).alias("v"))) for k in ("y", "x0")]]
    found = robust_scalings(train.select(F.explode(F.concat(*kinds)).alias("r")).select("r.*"))
    xs, ys = found["x"], found["y"]
    x0s = xs if 0 in lags or not own_x0_scaling else found.get("x0", Scaling(0.0, 1.0))
    scaled = raw.select("window_id", F.transform("x", lambda v: (v - xs.center) / xs.scale).alias("x"), ((F.col("x0") - x0s.center) / x0s.scale).alias("x0"), ((F.col("y") - ys.center) / ys.scale).alias("y"), (F.col("window_id") < cut).alias("is_train"))
    return FitData(scaled, list(lags), df, n, cut, xs, ys, x0s, raw)


def loss_of(residual: Column, loss: str, delta: float) -> Column:
    """Squared or Huber loss of a residual."""
    if loss == "mse":
        return residual * residual
    r = F.abs(residual)
    q = F.least(r, F.lit(delta))
    return 0.5 * q * q + delta * (r - q)


def loss_sql(residual: str, loss: str, delta: float) -> str:
    """The same of a residual's column, in SQL text."""
    if loss == "mse":
        return f"{residual} * {residual}"
    q, d = f"least(abs({residual}), {fir.number(delta)})", fir.number(delta)
    return f"0.5D * {q} * {q} + {d} * (abs({residual}) - {q})"


def mean_loss(predicted: Column, observed: Column, loss: str, delta: float) -> Column:
    """Mean over finite pairs, infinity if there is none."""
    r = fir.finite(predicted) - fir.finite(observed)
    return F.coalesce(F.avg(loss_of(r, loss, delta)), F.lit(float("inf")))


def dot(column: str, weights: list[float]) -> str:
    """Product sum of an array column with fixed weights in SQL text, first term first; many terms as one higher-order function, which keeps plans small."""
    if len(weights) > UNROLLED:
        return f"aggregate(zip_with({column}, array({', '.join(map(fir.number, weights))}), (x, w) -> x * w), 0.0D, (s, v) -> s + v)"
    return " + ".join(f"{column}[{i}] * {fir.number(w)}" for i, w in enumerate(weights))


def weight_losses(data: FitData, kernels: dict[str, list[float]], loss: str = "huber", delta: float = 1.0) -> dict[str, tuple[float, float]]:
    """(train, validation) loss of every weight vector, in one pass."""
    rows = data.windows.selectExpr("is_train", *[f"{dot('x', w)} - y AS r{n}" for n, w in enumerate(kernels.values())])
    losses = [loss_sql(f"r{n}", loss, delta) for n in range(len(kernels))]
    row = rows.selectExpr(*[f"avg({r}) FILTER (WHERE {part}) AS {c}{n}" for n, r in enumerate(losses) for c, part in (("t", "is_train"), ("v", "NOT is_train"))]).first()
    return {k: (row[f"t{n}"], row[f"v{n}"]) for n, k in enumerate(kernels)}


def single_lag_losses(data: FitData, loss: str = "huber", delta: float = 1.0) -> DataFrame:
    """lag_step, train_loss, validation_loss of each lag alone."""
    rows = data.windows.select("is_train", "y", F.posexplode("x").alias("pos", "v"))
    lag = F.array(*[F.lit(k) for k in data.lags])[F.col("pos")]
    r = loss_of(F.col("v") - F.col("y"), loss, delta)
    return rows.groupBy(lag.alias("lag_step")).agg(F.avg(F.when(F.col("is_train"), r)).alias("train_loss"), F.avg(F.when(~F.col("is_train"), r)).alias("validation_loss"))


def exponential_weights(n: int, alpha: float) -> list[float]:
    w = [math.exp(-alpha * i) for i in range(n)]
    return [x / sum(w) for x in w]


@dataclass(frozen=True)
class BaselineComparison:
    no_lag_validation_loss: float
    best_single_lag_validation_loss: float
    learned_validation_loss: float
    uniform_validation_loss: float | None = None
    exponential_validation_loss: float | None = None
    primary_ranking_metric: str = "validation_loss"
    summary_by_baseline: dict[str, dict[str, float | bool]] | None = None


def baseline_losses(data: FitData, loss: str = "huber", delta: float = 1.0) -> dict[str, float]:
    """Validation losses: no_lag, best_single_lag, uniform (the row mean) and exponential (best of a grid of decays), in one pass."""
    n = len(data.lags)
    predicted = {"no_lag": "x0", "uniform": f"({' + '.join(f'x[{i}]' for i in range(n))}) / {n}.0D"}
    predicted |= {f"l{i}": f"x[{i}]" for i in range(n)} | {f"e{k}": dot("x", exponential_weights(n, a)) for k, a in enumerate(EXPONENTIAL_GRID)}
    rows = data.windows.where("NOT is_train").selectExpr(*[f"{p} - y AS {k}" for k, p in predicted.items()])
    r = rows.selectExpr(*[f"avg({loss_sql(k, loss, delta)}) AS {k}" for k in predicted]).first()
    return {"no_lag": float("inf") if r["no_lag"] is None else r["no_lag"], "best_single_lag": min(r[f"l{i}"] for i in range(n)), "uniform": r["uniform"], "exponential": min(r[f"e{k}"] for k in range(len(EXPONENTIAL_GRID)))}


def compare_baselines(losses: dict[str, float], learned: float) -> BaselineComparison:
    """How each baseline stands to the learned loss; a positive delta means it is better."""
    summary = {}
    for k, v in losses.items():
        d = (learned - v) / max(learned, 1e-8)
        summary[k] = {"validation_loss": v, "delta_fraction_vs_learned": d, "beats_learned": v < learned, "beats_learned_by_margin": d >= MARGIN}
    return BaselineComparison(losses["no_lag"], losses["best_single_lag"], learned, losses.get("uniform"), losses.get("exponential"), summary_by_baseline=summary)
