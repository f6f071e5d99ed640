"""Arrays in archives, reference curves, and Parquet sinks with a manifest."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARRAYS = "archive string, name string, shape array<long>, dtype string, n long, min double, max double, is_finite boolean, is_regular boolean, values array<double>"


def _unpack(batches):
    for pdf in batches:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for name in sorted(z.namelist()):
                    if not name.endswith(".npy"):
                        continue
                    a = np.load(io.BytesIO(z.read(name)), allow_pickle=False)
                    v = np.asarray(a, float).ravel()
                    good = v[np.isfinite(v)]
                    step = np.diff(v)
                    regular = bool(a.squeeze().ndim == 1 and len(v) > 1 and (step > 0).all() and np.allclose(step, step[0], atol=1e-9, rtol=0))
                    rows.append((path, name, list(a.shape), str(a.dtype), v.size, float(good.min()) if good.size else None, float(good.max()) if good.size else None, bool(np.isfinite(v).all()), regular, v.tolist()))
        yield pd.DataFrame(rows, columns=["archive", "name", "shape", "dtype", "n", "min", "max", "is_finite", "is_regular", "values"])


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """One row for each .npy array of the zip archives under a path: shape, type, extremes, regularity and values."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_unpack, ARRAYS)


def inspect_archive(spark: SparkSession, path: str) -> DataFrame:
    """The arrays without their values."""
    return read_arrays(spark, path).drop("values").orderBy("archive", "name")


def array_rows(arrays: DataFrame, name: str, column: str) -> DataFrame:
    """One array as rows: pos and the value."""
    return arrays.where(F.col("name") == name).select(F.posexplode("values").alias("pos", column))


def reference_curve(expected: DataFrame, predicted: DataFrame, *, case: str, source_kind: str, source_archive_path: str, tolerance: float = 1e-9) -> DataFrame:
    """A curve (pos, lag_time, e) normalised, with a prediction beside it.

    The prediction counts only if its grid is the curve's within the tolerance,
    and is normalised only if it has no negative value.  A negative or empty
    curve raises.
    """
    r = expected.agg(F.count("*").alias("n"), F.min("e").alias("lo"), F.sum("e").alias("total")).first()
    if not r.n or r.lo < 0 or not r.total > 0:
        raise ValueError("the reference curve must be non-negative with a positive sum")
    p = predicted.select("pos", F.col("lag_time").alias("p_time"), F.col("e").alias("p"))
    both = expected.join(p, "pos", "full")
    q = both.agg(F.count_if(F.coalesce(F.abs(F.col("lag_time") - F.col("p_time")) > tolerance, F.lit(True))).alias("off"), F.min("p").alias("lo"), F.sum("p").alias("total")).first()
    aligned, fine = q.off == 0, q.lo is not None and q.lo >= 0 and q.total > 0
    shown = F.col("p") if aligned else F.lit(None).cast("double")
    out = expected.join(p, "pos", "left")
    return out.select(F.lit(case).alias("case"), F.lit(source_kind).alias("source_kind"), F.lit(source_archive_path).alias("source_archive_path"), "lag_time", F.col("e").alias("E_expected_raw"), (F.col("e") / r.total).alias("E_expected_normalized"), shown.alias("E_predicted_raw"), ((F.col("p") / q.total) if aligned and fine else F.lit(None).cast("double")).alias("E_predicted_normalized")).orderBy("lag_time")


def write_with_manifest(df: DataFrame, path: str, metadata: dict[str, Any] | None = None) -> dict[str, Any]:
    """Write Parquet, and beside it a JSON manifest with schema, rows, and an order-free digest of the rows."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(path)
    back = spark.read.parquet(path)
    row = back.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*back.columns).cast("decimal(38,0)")).alias("h")).first()
    manifest = {"path": path, "schema": json.loads(back.schema.json()), "rows": row.n, "sha256": hashlib.sha256(str(row.h).encode()).hexdigest(), **(metadata or {})}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.manifest")
    return manifest


def read_manifest(spark: SparkSession, path: str) -> dict[str, Any]:
    return json.loads(spark.read.text(f"{path}.manifest").first()[0])
