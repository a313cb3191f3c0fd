"""Sources, sinks, resumable stores, streams and audit tables."""

from __future__ import annotations

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from unitscope.operators import compare, diagnostics, energy, sampling, trees
from unitscope.sources import tables as T
from unitscope.streaming import scoring


def test_fasta(spark, tmp_path):
    folder = tmp_path / "in" / "deep"
    folder.mkdir(parents=True)
    (folder / "u1.fa").write_text(">a x\nac gt\nAC\n>b\nACGTAC\n")
    (folder / "u2.fasta").write_text("ACGT\n>c\n\n")
    (folder / "skip.txt").write_text(">no\nA\n")
    rows = {(r["unit_id"], r["taxon"]): (r["seq"], r["status"]) for r in T.read_fasta(spark, str(tmp_path / "in")).collect()}
    assert rows[("u1", "a x")] == ("ACGTAC", "OK") and rows[("u1", "b")] == ("ACGTAC", "OK")
    assert rows[("u2", "c")][1] == "MISSING_SEQUENCE" and len(rows) == 4
    with pytest.raises(ValueError):
        T.read_fasta(spark, str(tmp_path / "in"), glob="*.none", required=True)
    good = T.read_fasta(spark, str(tmp_path / "in")).filter("status = 'OK'")
    T.write_fasta(good, str(tmp_path / "out"))
    assert "".join(sorted("".join(p.read_text() for p in (tmp_path / "out").rglob("*.txt")))) == "".join(sorted(">a x\nACGTAC\n>b\nACGTAC\n"))


def test_tsv(spark, tmp_path):
    assert T.read_tsv(spark, str(tmp_path / "none"), "a int").count() == 0
    rows = spark.createDataFrame([(1, "x\ty\nz"), (2, None)], "a int, b string")
    T.write_tsv(rows, str(tmp_path / "t"))
    assert sorted((r["a"], r["b"] or "") for r in T.read_tsv(spark, str(tmp_path / "t"), "a int, b string").collect()) == [(1, "x y z"), (2, "")]


def test_manifest(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text('{"schema_version": 1, "tree_path": "t", "genes": [{"gene_id": "g", "alignment_path": "a"}, {"alignment_path": "b"}]}')
    assert [r["gene_id"] for r in T.read_manifest(spark, str(path)).orderBy("pos").collect()] == ["g", "gene_2"]
    path.write_text('{"tree_path": "t"}')
    with pytest.raises(ValueError):
        T.read_manifest(spark, str(path))


def test_checksums_and_bundle(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    assert T.checksums(spark, str(tmp_path)).first()["sha256"].startswith("2d711642b726b044")
    rows = spark.range(10).withColumn("s", F.col("id").cast("string"))
    one = T.manifest({"t": rows}).first()
    assert one == T.manifest({"t": rows.repartition(3).orderBy(F.desc("id"))}).first() and one["n_rows"] == 10


def test_resume_runs_missing_units_only(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    tasks = spark.createDataFrame([(1,), (2,)], "unit_id int")

    def score(df):
        seen.add(df.count())
        return df.withColumn("x", F.col("unit_id") * 2)

    store = str(tmp_path / "store")
    assert T.resume(tasks.filter("unit_id = 1"), score, store, ["unit_id"], "unit_id int, x int").count() == 1
    assert sorted(tuple(r) for r in T.resume(tasks, score, store, ["unit_id"], "unit_id int, x int").collect()) == [(1, 2), (2, 4)]
    assert seen.value == 2


def test_a_broken_append_leaves_nothing_visible(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "x int")
    store = str(tmp_path / "store")
    assert T.read_results(spark, store, "x int").count() == 0
    assert T.append_results(rows(1, 2), store) and T.append_results(rows(3), store, 7)
    # A batch that runs again, and what one leaves that was killed before its commit.
    assert not T.append_results(rows(9), store, 7)
    rows(10).write.parquet(f"{store}/batch-8-killed")
    assert sorted(r["x"] for r in T.read_results(spark, store, "x int").collect()) == [1, 2, 3]
    with pytest.raises(PythonException):
        T.append_results(rows(4, 5).mapInPandas(lambda frames: (f["none"] for f in frames), "x int"), store)
    assert T.append_results(rows(6), store) and {r["number"] for r in T.committed(spark, store).collect()} == {0, 7, 8}
    assert sorted(r["x"] for r in T.read_results(spark, store, "x int").collect()) == [1, 2, 3, 6]


def test_streams(spark, tmp_path):
    """Units in pieces over loads and starts, closed by a marker or by time, equal those of one batch; late rows are counted."""
    data = spark.range(60).selectExpr("id % 4 AS unit_id", "cast(id AS double) AS a", "cast(id * id % 7 AS double) AS b", "id DIV 20 AS load")
    model = energy.fit(data, ["a", "b"])
    whole = {r["unit_id"]: r for r in energy.dispersion(data.withColumn("energy", energy.energy(model)), "unit_id").collect()}
    null = spark.createDataFrame([(0.1,), (0.2,), (0.3,)], "D double")
    source, store, check = (str(tmp_path / x) for x in ("in", "store", "check"))
    schema = "unit_id long, a double, b double, event_time timestamp, last boolean"

    def load(rows, minute, last=None):
        timed = rows.select("unit_id", "a", "b", (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=F.lit(minute))).alias("event_time"), F.lit(last).cast("boolean").alias("last"))
        timed.write.mode("append").parquet(source)
        scoring.score_files(spark, source, schema, store, check, model, null, delay="1 minute", wait_ms=600_000).awaitTermination()
        return sorted(r["unit_id"] for r in scoring.stored(spark, store).collect())

    def marker(unit):
        return spark.createDataFrame([(unit, None, None)], "unit_id long, a double, b double")

    assert load(data.filter("load = 0"), 0) == []
    assert load(data.filter("load = 1").unionByName(spark.createDataFrame([(None, 1.0, 1.0, 1)], data.schema)), 1) == []
    assert load(data.filter("load = 2"), 2) == []
    assert load(marker(0), 3, True) == [0]
    assert load(data.filter("unit_id = 0 AND load = 1"), 3) == [0] and load(marker(0), 3, True) == [0]
    assert [tuple(r) for r in scoring.late_rows(spark, store).collect()] == [(0, 5)]
    # Time passes for the others; a start without new files finds nothing to do.
    assert load(marker(99), 30) == load(marker(99).limit(0), 31) == [0, 1, 2, 3]
    for r in scoring.stored(spark, store).collect():
        assert (r["n_sites"], r["mean_energy"], r["D"]) == (15, pytest.approx(whole[r["unit_id"]]["mean_energy"]), pytest.approx(whole[r["unit_id"]]["D"]))
        assert r["null_size"] == 3 and r["status"] == "OK"
    results = spark.createDataFrame([("m", "OK", 1.0), ("m", "OK", 2.0), ("m", "FAIL", 1.0)], "method string, status string, runtime_sec double")
    results.write.parquet(str(tmp_path / "r"))
    scoring.progress_stream(spark, str(tmp_path / "r"), "method string, status string, runtime_sec double", "live", str(tmp_path / "c2")).awaitTermination()
    assert {(r["status"], r["n"], r["seconds"]) for r in spark.table("live").collect()} == {("OK", 2, 3.0), ("FAIL", 1, 1.0)}


def test_inflated_null_is_severe(spark):
    rows = spark.range(400).select(F.lit(0.001).alias("p"))
    got = diagnostics.null_uniformity(rows, "p", 999).first()
    assert got["severe"] and got["tail_05"] > 0.95
    empty = diagnostics.null_uniformity(rows.limit(0), "p", 999).first()
    assert empty["n"] == 0 and not empty["severe"]


def test_set_metrics_and_ids(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "u string")
    got = compare.set_metrics(ids("g1", "g2"), ids("g1", "g3"), "u").first()
    assert (got["n_both"], got["n_a_only"], got["n_b_only"], got["mismatch"]) == (1, 1, 1, True)
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x_2")], "o int, b string")
    assert len({r["unique_id"] for r in compare.unique_ids(rows, "b", "o").collect()}) == 3


def test_split_of_one_unit(spark):
    one = spark.createDataFrame([("a",)], "u string")
    assert sorted(r["side"] for r in sampling.split_units(one, "u", 1).collect()) == ["test", "train"]


def test_nested_tree(spark):
    rows = spark.createDataFrame([(1, "((A:1,B:2,C:0):1,D:1)R:5;")], "u int, newick string")
    got = trees.described(rows).first()
    assert got["leaves"] == ["A", "B", "C", "D"] and got["tree_length"] == 5.0 and got["bad_length"]
    assert trees.polytomies(rows, "u").first()[1:] == (2, 1)
