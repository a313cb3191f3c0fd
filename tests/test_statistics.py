"""Value-level vectors: ranks, q-values, energies and tails."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from unitscope.functions import statistics as S
from unitscope.operators import calibrate, energy, fdr


def q_of(spark, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, p double")
    return [round(r["q"], 9) if r["q"] is not None else None for r in fdr.benjamini_hochberg(rows, "p", "q").orderBy("i").collect()]


def test_q_values(spark):
    assert q_of(spark, [0.01, 0.04, 0.03, 0.002]) == [0.02, 0.04, 0.04, 0.008]
    ps = [0.2, 0.01, None, 0.5, 0.001, 0.07, 0.07]
    qs = q_of(spark, ps)
    assert qs[2] is None and all(q is None or 0 <= p <= q <= 1 for p, q in zip(ps, qs, strict=True))
    assert q_of(spark, []) == []


def ranks(spark, observed, nulls, tail):
    obs = spark.createDataFrame([(1, observed)], "k int, D double")
    null = spark.createDataFrame([(1, x) for x in nulls], "k int, D double")
    if tail == "two":
        return calibrate.two_sided_p_values(obs, null, "k").first()["p_value"]
    return calibrate.rank_p_values(obs, null, "k", tail=tail).first()["p_value"]


def test_rank_tails(spark):
    assert ranks(spark, 0.35, [0.1, 0.2, 0.3, 0.4], "right") == pytest.approx(2 / 5)
    assert ranks(spark, 0.35, [0.1, 0.2, 0.3, 0.4], "left") == pytest.approx(4 / 5)
    assert ranks(spark, 2.0, [1.0, 1.1, 1.2, 1.3], "two") == pytest.approx(1 / 5)
    assert ranks(spark, 0.3, [0.3, 0.3], "right") == 1.0


def test_unit_without_null_fails(spark):
    obs = spark.createDataFrame([(1, 0.5), (2, None)], "k int, D double")
    null = spark.createDataFrame([(2, 0.1)], "k int, D double")
    rows = {r["k"]: r for r in calibrate.rank_p_values(obs, null, "k").collect()}
    assert rows[1]["status"] == rows[2]["status"] == "FAIL" and rows[1]["p_value"] is None and rows[2]["p_value"] is None


def test_energy_derivatives(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(200, 3)) @ np.array([[1, 0.3, 0], [0, 1, 0.2], [0, 0, 2.0]])
    rows = spark.createDataFrame([tuple(map(float, r)) for r in data], "a double, b double, c double")
    model = energy.fit(rows, ["a", "b", "c"])
    assert np.allclose(np.cov(data.T) + 1e-5 * np.eye(3), model.covariance)
    p, m = np.array(model.precision), np.array(model.mean)
    got = rows.select("a", "b", "c", energy.energy(model).alias("e"), *(g.alias(f"g{i}") for i, g in enumerate(energy.gradient(model))), energy.laplacian(model).alias("l")).first()
    x = np.array([got["a"], got["b"], got["c"]])
    e = lambda v: 0.5 * (v - m) @ p @ (v - m)
    assert got["e"] == pytest.approx(e(x))
    for i in range(3):
        h = np.zeros(3)
        h[i] = 1e-5
        assert (e(x + h) - e(x - h)) / 2e-5 == pytest.approx(got[f"g{i}"], abs=1e-6)
    assert got["l"] == pytest.approx(np.trace(p))
    wide = rows.select(energy.array_energy(F.array("a", "b", "c"), F.lit(model.mean), F.lit(model.precision)).alias("e")).first()["e"]
    assert wide == pytest.approx(got["e"])


def test_model_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 5.0)], "a double, b double")
    model = energy.fit(rows, ["a", "b"])
    energy.save(model, spark, str(tmp_path / "m"))
    assert energy.load(spark, str(tmp_path / "m")) == model
    rows.sparkSession.createDataFrame([(["a"], 9)], "feature_names array<string>, schema_version int").write.json(str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        energy.load(spark, str(tmp_path / "bad"))


def test_gaussian_null_is_uniform(spark):
    model = energy.EnergyModel(["a", "b"], [0.0, 0.0], np.eye(2).tolist(), np.eye(2).tolist(), 10)
    sizes = spark.createDataFrame([(40,)], "n_sites int")
    null = calibrate.gaussian_null(sizes, model, 199, 3)
    observed = calibrate.gaussian_null(sizes, model, 200, 91)
    ps = [r["p_value"] for r in calibrate.rank_p_values(observed, null, "n_sites").collect()]
    assert 0.4 <= np.mean(ps) <= 0.6 and 0.01 <= np.mean(np.array(ps) < 0.05) <= 0.10
    assert null.agg(F.avg("D")).first()[0] == pytest.approx(39 / 40, rel=0.1)


def test_tails(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(S.erfc(F.lit(0.5))) == pytest.approx(math.erfc(0.5))
    assert value(S.beta_quantile(F.lit(0.5), F.lit(2.0), F.lit(2.0))) == pytest.approx(0.5)
    assert value(S.beta_quantile(F.lit(0.025), F.lit(3.0), F.lit(8.0))) == pytest.approx(0.0667395, abs=1e-6)
    assert value(S.student_two_sided(F.lit(2.228139), F.lit(10.0))) == pytest.approx(0.05, abs=1e-6)
    assert value(S.kolmogorov_tail(F.lit(0.0), F.lit(5.0))) == 1.0
    assert value(S.number(F.lit("NaN"))) is None and value(S.number(F.lit("x"))) is None and value(S.number(F.lit("1.5"))) == 1.5


def test_tails_of_the_jvm_have_all_digits(spark):
    xs = [-3.0, -0.5, 0.0, 1e-9, 0.1, 0.5, 1.0, 2.0, 2.9, 3.1, 5.0, 9.0, 20.0, 26.0]
    got = [r["y"] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(S.erfc(F.col("x")).alias("y")).collect()]
    assert got == [pytest.approx(math.erfc(x), rel=1e-12) for x in xs]
    want = {(0.1, 100.0): 0.2699996716773, (0.05, 900.0): 0.0222179626165, (0.5, 4.0): 0.2699996716773}
    got = {(r["d"], r["n"]): r["p"] for r in spark.createDataFrame(list(want), "d double, n double").withColumn("p", S.kolmogorov_tail("d", "n")).collect()}
    assert got == {k: pytest.approx(v, abs=1e-10) for k, v in want.items()}


def test_canonical_numbers_are_exact_and_alike_in_both_engines(spark):
    import random

    import duckdb

    rng = random.Random(3)
    xs = [0.0, -0.0, 1.0, -1.5, 0.1, 1e-310, 5e-324, 1.7976931348623157e308, 2.0**-1022, 2.0**52, 2.0**53, float("nan"), float("inf"), -float("inf"), None]
    xs += [2.0**k for k in range(-300, 300, 7)] + [math.nextafter(2.0**k, 0) for k in range(-300, 300, 7)] + [rng.uniform(-1, 1) * 10 ** rng.randrange(-300, 300) for _ in range(400)]
    got = [r["t"] for r in spark.createDataFrame(list(enumerate(xs)), "i int, x double").select("i", S.canonical_number(F.col("x")).alias("t")).orderBy("i").collect()]
    for x, text in zip(xs, got, strict=True):
        if x is not None and math.isfinite(x) and x:
            mantissa, exponent = map(int, text.split("e"))
            assert 2**52 <= abs(mantissa) < 2**53 and math.ldexp(mantissa, exponent) == x
    assert got[:2] == ["0", "0"] and got[11:15] == ["nan", "inf", "-inf", None]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INT, x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(xs)))
    assert [r[0] for r in con.execute(f"SELECT {S.canonical_number_sql('x')} FROM t ORDER BY i").fetchall()] == got
