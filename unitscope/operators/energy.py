"""Quadratic energy model: fitted once on reference rows, frozen, and applied as column expressions."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1


@dataclass(frozen=True)
class EnergyModel:
    feature_names: list[str]
    mean: list[float]
    covariance: list[list[float]]
    precision: list[list[float]]
    training_rows: int
    ridge: float = 1e-5
    objective: float | None = None
    schema_version: int = field(default=VERSION)


def moments(rows: DataFrame, features: list[str]) -> DataFrame:
    """One row: n, avg_<f> and cov_<f>_<g> (sample covariance) in a single aggregation."""
    pairs = combinations_with_replacement(features, 2)
    return rows.agg(F.count("*").alias("n"), *(F.avg(f).alias(f"avg_{f}") for f in features), *(F.covar_samp(f, g).alias(f"cov_{f}_{g}") for f, g in pairs))


def fit(rows: DataFrame, features: list[str], ridge: float = 1e-5) -> EnergyModel:
    """Mean, covariance plus ridge, and its pseudo-inverse; only the d*d moments reach the driver."""
    row = moments(rows, features).first()
    if not row["n"]:
        raise ValueError("no reference rows")
    d = len(features)
    covariance = np.zeros((d, d))
    for (i, f), (j, g) in combinations_with_replacement(list(enumerate(features)), 2):
        covariance[i, j] = covariance[j, i] = row[f"cov_{f}_{g}"] or 0.0
    covariance += ridge * np.eye(d)
    model = EnergyModel(features, [row[f"avg_{f}"] for f in features], covariance.tolist(), np.linalg.pinv(covariance).tolist(), row["n"], ridge)
    pull = sum(F.pow(g, F.lit(2)) for g in gradient(model))
    objective = rows.agg(F.avg(pull) / 2).first()[0] + float(np.trace(np.array(model.precision)))
    return EnergyModel(**(asdict(model) | {"objective": objective}))


def _off(model: EnergyModel) -> list[Column]:
    return [F.col(f) - F.lit(m) for f, m in zip(model.feature_names, model.mean, strict=True)]


def gradient(model: EnergyModel) -> list[Column]:
    """P(x - mean), a column per feature."""
    return [sum((F.lit(p) * x for p, x in zip(row, _off(model), strict=True)), F.lit(0.0)) for row in model.precision]


def laplacian(model: EnergyModel) -> Column:
    return F.lit(float(np.trace(np.array(model.precision))))


def energy(model: EnergyModel) -> Column:
    """Half the squared distance under the model's precision, as one generated expression."""
    off = _off(model)
    d = len(off)
    terms = [F.lit(model.precision[i][j] * (0.5 if i == j else 1.0)) * off[i] * off[j] for i in range(d) for j in range(i, d)]
    return sum(terms[1:], terms[0])


def array_energy(values: Column, mean: Column, precision: Column) -> Column:
    """The same for a wide feature array; mean and precision are arrays, so code size does not grow with d * d."""
    off = F.zip_with(values.cast("array<double>"), mean, lambda x, m: x - m)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    # Bound once, then used for every row of the precision.
    return F.transform(F.array(off), lambda o: dot(F.transform(precision, lambda row: dot(row, o)), o) / 2)[0]


def dispersion(scored: DataFrame, unit: str | list[str], energy_col: str = "energy") -> DataFrame:
    """Per unit: n_sites, mean energy and D, the population variance of the energies."""
    keys = [unit] if isinstance(unit, str) else unit
    return scored.groupBy(*keys).agg(F.count("*").alias("n_sites"), F.avg(energy_col).alias("mean_energy"), F.var_pop(energy_col).alias("D"))


def save(model: EnergyModel, spark: SparkSession, path: str) -> None:
    spark.createDataFrame([asdict(model)], MODEL_SCHEMA).coalesce(1).write.mode("overwrite").json(path)


MODEL_SCHEMA = "feature_names array<string>, mean array<double>, covariance array<array<double>>, precision array<array<double>>, training_rows long, ridge double, objective double, schema_version int"


def load(spark: SparkSession, path: str) -> EnergyModel:
    """A saved model; raises where its version, keys or shapes do not fit."""
    rows = spark.read.schema(MODEL_SCHEMA).json(path).take(2)
    if len(rows) != 1:
        raise ValueError(f"{path} holds no single model")
    model = EnergyModel(**rows[0].asDict(True))
    d = len(model.feature_names or [])
    shapes_fit = d and len(model.mean or []) == d and all(len(m or []) == d and all(len(r) == d for r in m) for m in (model.covariance, model.precision))
    if model.schema_version != VERSION or not shapes_fit:
        raise ValueError(f"{path} is not a model of version {VERSION}")
    return model
