"""The window aggregate on a stream of regularly sampled series (an extension).

Each series keeps its last max_lag rows as state.  Rows of a batch are put in
order of their index; rows that are older than what was already given out are
late and are left out, as a watermark would.  A gap in the index makes windows
that reach into it incomplete.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from lagloom.functions.kernels import Kernel
from lagloom.operators.fir import ZERO

STATE = "next long, seen array<long>, values array<double>"
OUTPUT = "series string, idx long, wmean double, wstd double, wsum double"


def _windows(kernel: Kernel, at: np.ndarray, values: np.ndarray, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """wmean, wstd and wsum (NaN where a window is not whole) of the rows idx, from the values known at the ascending places."""
    wanted = idx[:, None] - np.array(kernel.lag_steps)
    place = np.minimum(np.searchsorted(at, wanted), len(at) - 1)
    x = np.where(at[place] == wanted, values[place], np.nan)
    there = np.isfinite(x).all(1) & (idx >= kernel.max_lag_steps)
    d, s = 0.0, np.zeros(len(idx))
    for k, w in enumerate(kernel.weights):  # first term first, as in batch
        d, s = d + w, s + w * x[:, k]
    there &= abs(d) > ZERO
    s = np.where(there, s, np.nan)
    m, v = s / (d or 1.0), np.zeros(len(idx))
    for k, w in enumerate(kernel.weights):
        v = v + w * ((x[:, k] - m) * (x[:, k] - m))
    return m, np.sqrt(np.maximum(v / (d or 1.0), 0.0)), s


def fir_stream(stream: DataFrame, kernel: Kernel) -> DataFrame:
    """series, idx, wmean, wstd, wsum for a stream of (series string, idx long, value double)."""

    def step(key, batches, state):
        nxt, at, values = state.get if state.exists else (0, [], [])
        rows = pd.concat(list(batches)).sort_values("idx", kind="stable").drop_duplicates("idx")
        rows = rows[rows["idx"] >= nxt]
        idx = rows["idx"].to_numpy(np.int64)
        at = np.concatenate([np.array(at, np.int64), idx])
        values = np.concatenate([np.array(values, object).astype(float), rows["value"].to_numpy(float)])
        made = _windows(kernel, at, values, idx) if len(idx) else (np.zeros(0),) * 3
        nxt = int(idx[-1]) + 1 if len(idx) else nxt
        kept = at > nxt - 1 - kernel.max_lag_steps
        state.update((nxt, at[kept].tolist(), [None if np.isnan(v) else float(v) for v in values[kept]]))
        yield pd.DataFrame({"series": key[0], "idx": idx, **dict(zip(("wmean", "wstd", "wsum"), made))})

    return stream.groupBy("series").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
