"""pyspark.ml Estimator and Model around the feature builder, with Params; both can be saved alone and in pipelines."""

from __future__ import annotations

import json
from dataclasses import asdict, fields
from datetime import timedelta

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from lagloom.functions.kernels import Kernel, LearnedKernel
from lagloom.operators import learn
from lagloom.operators.features import KernelFeatureBuilder


def kernel_to_dict(kernel: Kernel) -> dict:
    return {**asdict(kernel), "learned": isinstance(kernel, LearnedKernel)}


def kernel_from_dict(d: dict) -> Kernel:
    kind = LearnedKernel if d.pop("learned") else Kernel
    return kind(**{**d, "weights": tuple(d["weights"]), "lag_steps": tuple(d["lag_steps"])}).validate()


def learner_to_dict(learner: learn.Learner) -> dict:
    """The learner's settings; durations as text."""
    text = lambda v: f"{int(v.total_seconds())}s" if isinstance(v, timedelta) else v
    return {"class": type(learner).__name__, **{f.name: text(getattr(learner, f.name)) for f in fields(learn.Learner)}}


def learner_from_dict(d: dict) -> learn.Learner:
    kind = getattr(learn, d["class"])
    given = {k: v for k, v in d.items() if k not in ("class", "max_lag")}
    if kind is not learn.Learner:
        given.pop("family")
    return kind(d["max_lag"], **given)


class _Settings(Params):
    """What estimator and model share."""

    timeCol = Param(Params._dummy(), "timeCol", "time column", TypeConverters.toString)
    numericCols = Param(Params._dummy(), "numericCols", "columns of numeric features", TypeConverters.toListString)
    categoryCols = Param(Params._dummy(), "categoryCols", "columns of categorical features", TypeConverters.toListString)
    weightCol = Param(Params._dummy(), "weightCol", "column of weights, empty for none", TypeConverters.toString)
    kernels = Param(Params._dummy(), "kernels", "kernels by name, as JSON; empty for none", TypeConverters.toString)
    includeTimeCol = Param(Params._dummy(), "includeTimeCol", "whether the time column is returned", TypeConverters.toBoolean)
    passthrough = Param(Params._dummy(), "passthrough", "whether the columns of the input are returned", TypeConverters.toBoolean)

    def __init__(self):
        super().__init__()
        self._setDefault(numericCols=[], categoryCols=[], weightCol="", kernels="", includeTimeCol=True, passthrough=False)

    def get(self, name: str):
        return self.getOrDefault(self.getParam(name))

    def fixed_kernels(self) -> dict[str, Kernel] | None:
        text = self.get("kernels")
        return {n: kernel_from_dict(d) for n, d in json.loads(text).items()} if text else None

    def builder(self) -> KernelFeatureBuilder:
        return KernelFeatureBuilder(self.fixed_kernels() or {}, time_col=self.get("timeCol"), numeric_cols=self.get("numericCols"), category_cols=self.get("categoryCols"), weight_col=self.get("weightCol") or None)


class KernelFeatureModel(Model, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """Applies fitted kernels: the features, with the time column and the input columns if asked for."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        result = self.builder().transform_result(dataset)
        if self.get("passthrough"):
            return result.augmented
        return result.features if self.get("includeTimeCol") else result.features.drop(self.get("timeCol"))

    def get_feature_names_out(self, dataset: DataFrame) -> tuple[str, ...]:
        return self.builder().transform_result(dataset).registry.names()


class KernelFeatureTransformer(Estimator, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """Fits a learner on (input_col, target_col), or takes fixed kernels, and makes features.

    Exactly one of ``learner`` and ``kernels``.  A learned kernel is called ``kernel_name``.
    """

    learner = Param(Params._dummy(), "learner", "settings of the learner, as JSON; empty for none", TypeConverters.toString)
    inputCol = Param(Params._dummy(), "inputCol", "input of the learner", TypeConverters.toString)
    targetCol = Param(Params._dummy(), "targetCol", "target of the learner", TypeConverters.toString)
    kernelName = Param(Params._dummy(), "kernelName", "name of the learned kernel", TypeConverters.toString)

    def __init__(self, *, time_col: str | None = None, numeric_cols=(), category_cols=(), weight_col: str | None = None, learner: learn.Learner | None = None, kernels: dict[str, Kernel] | None = None, input_col: str | None = None, target_col: str | None = None, kernel_name: str = "learned", include_time_col: bool = True, passthrough: bool = False):
        super().__init__()
        self._setDefault(learner="", inputCol="", targetCol="", kernelName="learned")
        if time_col is None and learner is None and kernels is None:
            return  # to be filled from a saved one
        if time_col is None or (learner is None) == (kernels is None):
            raise ValueError("give time_col and exactly one of learner and kernels")
        if learner is not None and not (input_col and target_col):
            raise ValueError("a learner needs input_col and target_col")
        given = {"timeCol": time_col, "numericCols": list(numeric_cols), "categoryCols": list(category_cols), "weightCol": weight_col or "", "inputCol": input_col or "", "targetCol": target_col or "", "kernelName": kernel_name, "includeTimeCol": include_time_col, "passthrough": passthrough}
        given["learner"] = json.dumps(learner_to_dict(learner)) if learner is not None else ""
        given["kernels"] = json.dumps({n: kernel_to_dict(k) for n, k in kernels.items()}) if kernels is not None else ""
        self._set(**given)

    def _fit(self, dataset: DataFrame) -> KernelFeatureModel:
        text = self.get("kernels")
        if self.get("learner"):
            learner = learner_from_dict(json.loads(self.get("learner")))
            fit = learner.fit(dataset, input_col=self.get("inputCol"), target_col=self.get("targetCol"), time_col=self.get("timeCol"))
            text = json.dumps({self.get("kernelName"): kernel_to_dict(fit.kernel)})
        model = KernelFeatureModel()
        return model._set(kernels=text, **{n: self.get(n) for n in ("timeCol", "numericCols", "categoryCols", "weightCol", "includeTimeCol", "passthrough")})
