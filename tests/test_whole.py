"""Queries and operators take all rows of their input, against brute force."""

from __future__ import annotations

import os

import numpy as np
import pytest

from pyspark.sql import functions as F

from unitscope.functions import statistics
from unitscope.operators import alignments as A
from unitscope.operators import calibrate, fdr, ordinals, ranges
from unitscope.plans import registry as queries
from unitscope.plans.views import view

DATA = "/root/testdata/sf0.001"


def test_all_pairs_of_large_and_sparse_units(spark):
    """Every pair of every member counts, whatever the blocks, and sites are matched by position."""
    bases = "ACGT-N"
    seqs = {("u", t): "".join(bases[(t * t * 7 + i * (t + 3) + i // 5) % 6] for i in range(600)) for t in range(1, 42)} | {("v", t): s for t, s in ((1, "AC"), (2, "AGT"))} | {("w", 1): "A", ("x", 1): "N", ("x", 2): "A"}
    rows = A.sites(spark.createDataFrame([(*k, s) for k, s in seqs.items()], "unit_id string, taxon int, seq string"))
    rows = rows.filter("unit_id <> 'u' OR (taxon + pos) % 9 > 0")
    want = {}
    for (u, t), s in seqs.items():
        for (v, o), z in seqs.items():
            if u == v and t < o:
                pairs = [(a, b) for i, (a, b) in enumerate(zip(s, z), 1) if a in "ACGT" and b in "ACGT" and (u != "u" or ((t + i) % 9 and (o + i) % 9))]
                want.setdefault(u, []).extend([sum(a != b for a, b in pairs) / len(pairs)] if pairs else [])
    for block in (1024, 6):
        got = {r["unit_id"]: (r["n_pairs"], r["mean_distance"]) for r in A.pairwise_distance(rows, block=block).collect()}
        assert set(got) == set(want) and got["x"] == (0, None)
        for u in "uv":
            assert got[u] == (len(want[u]), pytest.approx(sum(want[u]) / len(want[u])))


@pytest.mark.parametrize("members", [40, 700])
def test_pairs_of_sequences_are_those_of_their_sites(spark, members):
    """No row to a site; classes of one member and of very many, which come in several batches, missing sequences and taxa."""
    rows = spark.range(members).selectExpr("if(id % 3 = 0, 'u', 'v') AS unit_id", "if(id = 5, NULL, id) AS taxon", "if(id = 7, NULL, translate(concat(if(id % 2 = 0, '012301230', md5(string(id))), md5(string(id div 9))), '0123456789abcdef', if(id % 2 = 0, 'ACGTACGTACGTACGT', 'ACGTACGTACGTACN-'))) AS seq")
    by_rows = A.pairwise_distance_of_sequences(rows, block=7)
    assert by_rows._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = {r["unit_id"]: (r["n_pairs"], r["mean_distance"]) for r in by_rows.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    seqs = [r for r in rows.collect() if r["taxon"] is not None and r["seq"]]
    for i, r in enumerate(seqs):
        for o in seqs[:i]:
            if r["unit_id"] == o["unit_id"] and (pairs := [a != b for a, b in zip(r["seq"], o["seq"]) if a in "ACGT" and b in "ACGT"]):
                want.setdefault(r["unit_id"], []).append(sum(pairs) / len(pairs))
    assert got == {u: (len(x), pytest.approx(sum(x) / len(x))) for u, x in want.items()}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_all_members_are_paired(spark):
    rows = queries.QUERIES["c11_all_pairs_distance"](spark, DATA).collect()
    sizes = {r["c_nationkey"]: r["count"] for r in spark.read.parquet(f"{DATA}/customer.parquet").groupBy("c_nationkey").count().collect()}
    assert {r["unit_id"]: r["n_pairs"] for r in rows} == {u: n * (n - 1) // 2 for u, n in sizes.items() if n > 1}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_audit_judges_all_members(spark):
    """A stop in any member drops its unit, and every unit is judged."""
    members = {}
    for r in view(spark, DATA, "aln").collect():
        members.setdefault(r["unit_id"], []).append(r["seq"])
    stop = {u for u, seqs in members.items() if any(s[i : i + 3] in ("TAA", "TAG", "TGA") for s in seqs for i in range(0, 93, 3))}
    final = {r["unit_id"]: (r["status"], r["reason"]) for r in queries.QUERIES["f32_staged_audit_all"](spark, DATA).filter("stage = 'FINAL_KEEP'").collect()}
    assert set(final) == set(members)
    judged = {u for u, (status, _) in final.items() if status != "SKIP" and u % 11 != 10 and len(members[u]) > 1}
    assert judged & stop and {u for u, x in final.items() if x == ("DROP", "internal_stop")} == judged & stop
    summary = {r["item"]: r["n"] for r in queries.QUERIES["f33_audit_summary_all"](spark, DATA).collect()}
    assert summary["total"] == len(members) and summary["drop:internal_stop"] == len(judged & stop)


def test_resampled_null_is_calibrated(spark):
    """Units drawn from the pool itself, some of more draws than a chunk, have p-values without a trend."""
    rows = spark.range(120_000).select((F.col("id") % 60).alias("unit_id"), F.pow(F.rand(3), F.lit(2)).alias("energy"))
    big = spark.range(20_000).select(F.lit(99).cast("long").alias("unit_id"), F.pow(F.rand(4), F.lit(2)).alias("energy"))
    units = rows.unionByName(big).groupBy("unit_id").agg(F.count("*").alias("n_sites"), F.var_pop("energy").alias("D"))
    got = calibrate.resampled_p_values(units, rows, "unit_id", "n_sites", 199, 5).collect()
    p = [r["p_value"] for r in got]
    assert len(p) == 61 and {r["null_size"] for r in got} == {199} and 0.4 < sum(p) / len(p) < 0.6 and sum(x < 0.05 for x in p) <= 8


@pytest.mark.parametrize("how", ["whole", "runs of replicates", "pieces", "parts of the pool"])
def test_ranks_where_draws_are_made_are_those_of_a_sort(spark, monkeypatch, how):
    """Both tails, moments and odd units (without rows or a statistic, of one row) by every way that the draws can take."""
    rows = spark.range(9000).select((F.col("id") * F.col("id") % 23).alias("unit_id"), F.expr("pow(id * 7919 % 9001 / 9001D, 3)").alias("energy")).filter("unit_id <> 0 OR energy < 0.2")
    units = rows.groupBy("unit_id").agg(F.count("*").alias("n_sites"), F.var_pop("energy").alias("D"))
    units = units.unionByName(spark.createDataFrame([(90, 0, 0.1), (91, 5, None), (92, 1, 0.0), (93, 7, 0.01)], "unit_id long, n_sites long, D double"))
    monkeypatch.setattr(calibrate, "CHUNK", 40)
    if how == "runs of replicates":
        monkeypatch.setattr(calibrate, "RANKED_DRAWS", 2000)
    if how == "pieces":
        monkeypatch.setattr(calibrate, "LARGE_UNIT", 300)
    most = 1000 if how == "parts of the pool" else calibrate.POOL_VALUES
    if how == "parts of the pool":
        monkeypatch.setattr(calibrate, "GROUP_DRAWS", 5000)
    null = calibrate.resampled_null(units.filter("D IS NOT NULL"), rows, "unit_id", "n_sites", 49, 5)
    want = {r["unit_id"]: r for r in calibrate.rank_p_values(units, null, "unit_id", tail="both").collect()}
    got = calibrate.resampled_p_values(units, rows, "unit_id", "n_sites", 49, 5, tail="both", most=most).collect()
    assert len(got) == len(want) > 10
    for r in got:
        own = want[r["unit_id"]]
        assert r.asDict().keys() == own.asDict().keys()
        assert [r[c] for c in ("n_extreme", "null_size", "p_value", "status", "n_extreme_left", "p_left")] == [own[c] for c in ("n_extreme", "null_size", "p_value", "status", "n_extreme_left", "p_left")]
        assert [r[c] for c in ("mu0", "sigma0")] == [own[c] if own[c] is None else pytest.approx(own[c], abs=1e-12) for c in ("mu0", "sigma0")]
    assert want[90]["status"] == want[91]["status"] == "FAIL" and want[92]["sigma0"] == 0


def test_ranks_of_large_pools_are_those_of_sql():
    """SQL takes one number to a draw, modulo the pool's size; two are for pools of which one number doesn't reach all values."""
    x = np.array([0, 35_999_999, 36_000_000, statistics.DRAWS - 1])
    for n in (36_000_000, statistics.DRAWS):
        assert calibrate._uses(n) == 1 and (calibrate._rank(n, x) == x % n).all()
    assert calibrate._uses(statistics.DRAWS + 1) == 2


@pytest.mark.parametrize("uses", [1, 2])
def test_draws_from_a_large_pool_stay_where_they_are_made(spark, monkeypatch, uses):
    """The pool passes through the tasks: no exchange of draws or sums. Statistics are those of each draw by itself, of short and long units, in many messages, slices and groups of units."""
    for name, x in (("MESSAGE_VALUES", 700), ("KEPT_SUMS", 100), ("SENT_UNITS", 9), ("_PLACES", 64), ("_LOOK", 50), ("_uses", lambda n: uses)):
        monkeypatch.setattr(calibrate, name, x)
    rows = spark.range(5000).select(F.expr("if(id % 7 = 0, -0D, pow(id * 7919 % 4999 / 4999D, 3) - 0.2)").alias("energy")).unionByName(spark.createDataFrame([(None,)], "energy double"))
    sizes = {**{f"u{k}": 1 + k * k % 50 for k in range(23)}, "long": 3000, "none": 0}
    units = spark.createDataFrame(list(sizes.items()), "unit string, n long").withColumn("D", F.lit(0.05))
    null = calibrate.resampled_null(units, rows, "unit", "n", 19, 5, most=900)
    plan = null._jdf.queryExecution().toString()
    assert "CoGroup" not in plan and "HashAggregate" not in plan.split("Optimized Logical Plan")[0]
    pool = np.array(sorted(r["energy"] for r in rows.collect() if r["energy"] is not None))
    keys = {r["unit"]: r["k"] for r in units.select("unit", statistics.hash_key(5, F.col("unit")).alias("k")).collect()}
    want = {}
    for u, n in sizes.items():
        for rep in range(19 if n else 0):
            x = [statistics.draws(calibrate._bases(keys[u], np.array([rep])), np.arange(1, n + 1) * uses + j) for j in range(uses)]
            want[u, rep] = pool[calibrate._rank(len(pool), *x)].var()
    got = {(r["unit"], r["rep"]): r["D"] for r in null.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    ranked = {r["unit"]: r for r in calibrate.resampled_p_values(units, rows, "unit", "n", 19, 5, most=900).collect()}
    assert len(ranked) == 25 and ranked["none"]["status"] == "FAIL"
    assert all(ranked[u]["n_extreme"] == sum(want[u, rep] >= 0.05 for rep in range(19)) for u in sizes if u != "none")


@pytest.mark.parametrize("split", [False, True])
def test_null_rows_are_ranked_where_they_lie(spark, monkeypatch, split):
    """No null row is moved, and ranks, sizes and moments are those of a window: ties, keys without nulls, nulls without keys, null keys, missing and odd statistics."""
    odd = [(None, "a", 0.5), (None, "a", None), (7, None, 2.0), (8, "b", None), (1, "a", float("nan")), (1, "a", float("inf")), (9, "z", -0.0), (1, "a", 0.0), (1, "a", 0.0)]
    observed = spark.range(300).select((F.col("id") % 5).alias("k"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("g"), F.expr("id * 37 % 101 / 10D").alias("D")).unionByName(spark.createDataFrame(odd, "k long, g string, D double")).withColumn("x", F.monotonically_increasing_id())
    null = spark.range(4000).select((F.col("id") % 7).alias("k"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("g"), F.expr("id * 7919 % 211 / 20D").alias("D"))
    null = null.unionByName(spark.createDataFrame([(None, "a", 0.5), (None, "a", 0.25), (8, "b", 1.0), (8, "b", None), (9, "z", 0.0), (1, "a", float("nan"))], "k long, g string, D double"))

    def ranked():
        df = calibrate.rank_p_values(observed, null, ["k", "g"], tail="both", split=split)
        return df._jdf.queryExecution().executedPlan().toString(), {r["x"]: r for r in df.collect()}

    plan, got = ranked()
    assert "MapInArrow" in plan and got.keys() == {r["x"] for r in observed.collect()}
    monkeypatch.setattr(calibrate, "PLACED_ROWS", 100)
    plan, want = ranked()
    assert "MapInArrow" not in plan
    for x, r in want.items():
        for c in r.asDict():
            assert got[x][c] == r[c] or repr(got[x][c]) == repr(r[c]) or got[x][c] == pytest.approx(r[c], abs=1e-9), (c, got[x], r)


def test_two_sided_p_values_move_the_null_once(spark):
    observed = spark.createDataFrame([("a", 3.0), ("b", 9.0), ("c", 1.0), ("d", None), (None, 1.0)], "k string, D double")
    null = spark.range(400).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("k"), F.expr("id * 37 % 101 / 10D").alias("D")).unionByName(spark.createDataFrame([("d", 1.0), ("a", None), (None, 2.0)], "k string, D double"))
    df = calibrate.two_sided_p_values(observed, null, "k")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 400") == 1
    got = {r["k"]: r for r in df.collect()}
    for k in "ab":
        x, v = next(r["D"] for r in observed.collect() if r["k"] == k), np.array([r["D"] for r in null.collect() if r["k"] == k and r["D"] is not None])
        middle = np.median(np.append(v, x))
        far = np.round(abs(v - middle), 12)
        n = int((far >= round(abs(x - middle), 12)).sum())
        assert (got[k]["n_extreme"], got[k]["null_size"], got[k]["p_value"], got[k]["status"]) == (n, len(v), (1 + n) / (len(v) + 1), "OK")
        assert (got[k]["mu0"], got[k]["sigma0"]) == (pytest.approx(far.mean()), pytest.approx(far.std()))
    assert [(got[k]["null_size"], got[k]["p_value"], got[k]["status"]) for k in ("c", "d", None)] == [(0, None, "FAIL"), (1, None, "FAIL"), (0, None, "FAIL")]


def test_gaps_that_differ_by_rounding_are_told_apart(spark):
    """A stored q beside its neighbour is no larger error; the tie of the call decides, as the SQL of the audit does."""
    rows = spark.createDataFrame([("m", 10, 0.25, 0.506), ("m", 2000, 0.5, float(np.nextafter(0.506, 0))), ("m", 3000, None, None)], "method string, unit_id long, p_value double, q_value double")
    worst = lambda **how: fdr.recompute_audit(rows, "method", **how).first()["worst_unit"]
    assert worst() == 10 and worst(tie=F.col("unit_id") / 1e9) == 2000


def test_ranges_of_any_number(spark):
    """Ranks range by range are those of one sort, both tails, whatever the sign and size of values."""
    rows = spark.range(3000).select((F.col("id") % 3).alias("k"), F.expr("(id * 7919 % 1000 - 500) * pow(10D, id % 7 - 3)").alias("D"))
    null = rows.withColumn("D", F.when(F.col("D") > -1e5, F.col("D") * 0.9)).filter("k < 2")
    for tail in ("right", "left", "both"):
        one, split = (sorted(map(tuple, calibrate.rank_p_values(rows, null, "k", tail=tail, split=s).drop("mu0", "sigma0").collect()), key=repr) for s in (False, True))
        assert one == split and any(r[2] for r in one)
    p = spark.range(2000).select((F.col("id") % 2).alias("g"), F.pow(F.rand(1), F.lit(9)).alias("p_value")).unionByName(spark.createDataFrame([(0, 0.0), (1, None), (None, 0.5), (None, 1.0)], "g long, p_value double")).cache()
    few, many = (sorted(map(tuple, fdr.benjamini_hochberg(p, by=["g"], few=f).collect()), key=repr) for f in (True, False))
    assert few == many and len(few) == 2004
    p.unpersist()


@pytest.mark.parametrize("inline", [4, 128])
def test_ranges_are_even_whatever_the_values(spark, monkeypatch, inline):
    """Narrow and skewed values, and one that has a third of the rows: no range has over twice the mean but that value's own."""
    monkeypatch.setattr(ranges, "INLINE", inline)
    narrow = spark.range(20_000).select((F.lit(1e6) + F.col("id") / 2).alias("v"))
    skewed = spark.range(20_000).select(F.exp(F.col("id") % 40 + F.rand(1)).alias("v"))
    hot = spark.range(10_000).select(F.lit(7.5).alias("v")).unionByName(spark.range(20_000).select((F.rand(2) * 10).alias("v")))
    for rows in (narrow, skewed, hot):
        at = ranges.bounds(rows, "v", 32, 500)
        placed = rows.withColumn("r", ranges.range_of(F.col("v"), at)).groupBy("r").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("r").collect()
        mean = sum(r["n"] for r in placed) / 32
        assert len(at) > 20 and all(a["high"] < b["low"] for a, b in zip(placed, placed[1:], strict=False))
        assert all(r["n"] <= 2 * mean or r["low"] <= 7.5 <= r["high"] for r in placed)
        bare = [r for r in placed if r["n"] > 2 * mean]
        assert len(bare) <= (1 if rows is hot else 0)
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (-float("inf"),), (0.0,), (-0.0,)], "v double")
    assert ranges.bounds(odd, "v") == [] and ranges.bounds(odd.limit(0), "v") == []
    assert [r["r"] for r in odd.select(ranges.range_of(F.col("v"), [-1.0, 0.0]).alias("r")).collect()] == [None, 2, 2, 0, 1, 1]
    monkeypatch.setattr(ranges, "RANGE_ROWS", 100)
    monkeypatch.setattr(ranges.bounds, "__defaults__", (ranges.RANGES, 100))
    p = spark.range(3000).select((F.col("id") % 5).alias("g"), F.pow(F.rand(1), F.lit(9)).alias("p_value")).cache()
    few, many = (sorted(map(tuple, fdr.benjamini_hochberg(p, by=["g"], few=f).collect()), key=repr) for f in (True, False))
    assert few == many
    p.unpersist()


def test_places_and_quantiles_are_those_of_a_sort(spark):
    rows = spark.range(5000).select(F.col("id"), (F.col("id") * 7919 % 613).alias("v"))
    got = {r["id"]: r["k"] for r in ordinals.numbered(rows, [F.desc("v"), "id"], "k").collect()}
    assert got == {i: k for k, (_, i) in enumerate(sorted((-(i * 7919 % 613), i) for i in range(5000)), 1)}
    assert ordinals.numbered(rows.limit(0), ["v"]).collect() == []
    shares = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]
    for df in (rows, rows.select(F.expr("if(id % 3 = 0, NULL, -v / 7)").alias("v")), rows.limit(1), rows.limit(2)):
        one = ordinals.quantiles(df, "v", shares).first()
        want = df.agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q"), F.count("v").alias("n")).first()
        assert one["quantiles"] == pytest.approx(want["q"]) and one["n"] == want["n"]
    assert tuple(ordinals.quantiles(rows.limit(0), "v", shares).first()) == (None, 0)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_null_of_999(spark):
    p = [r["p_value"] for r in queries.QUERIES["flagship_all"](spark, DATA).collect()]
    assert p and all(round(x * 1000, 6) == round(x * 1000) for x in p) and any(round(x * 1000) % 50 for x in p)
