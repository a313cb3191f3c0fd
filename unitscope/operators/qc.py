"""Staged quality control with audit rows, region checks and readiness reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unitscope.functions.sequences import has_internal_stop, in_frame

FINAL = "FINAL_KEEP"


def staged_audit(metrics: DataFrame, unit: str, stages: list[tuple[str, Column, str]], order: str | None = None, most: int | None = None, limit_reason: str = "MAX_UNITS_LIMIT") -> DataFrame:
    """(unit, stage_no, stage, status, reason) from metrics that are computed once: each unit passes its stages in order up to the first that
    fails, which is a DROP with its reason, and always ends with FINAL_KEEP.

    A stage is (name, condition that drops, reason). With `most`, units beyond that many kept ones, in order, are a single SKIP."""
    names = [name for name, _, _ in stages]
    first = F.coalesce(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(i + 1)) for i, (_, bad, _) in enumerate(stages)), F.lit(0))
    reasons = F.element_at(F.array(*(F.lit(reason) for _, _, reason in stages)), F.greatest(F.col("_first"), F.lit(1)))
    judged = metrics.withColumn("_first", first).withColumn("_reason", F.when(F.col("_first") > 0, reasons).otherwise("ok"))
    if most is not None:
        # The last unit that may be kept; those beyond it are skipped, if there are so many.
        first = judged.filter("_first = 0").select(F.col(order).alias("_order")).orderBy("_order").limit(most)
        last = first.agg(F.max("_order").alias("_last"), F.count("*").alias("_kept"))
        beyond = F.when(F.col("_kept") >= most, F.coalesce(F.col(order) > F.col("_last"), F.lit(most == 0))).otherwise(False)
        judged = judged.crossJoin(F.broadcast(last)).withColumn("_skip", beyond)
    else:
        judged = judged.withColumn("_skip", F.lit(False))
    n = len(names)
    reached = F.when(F.col("_first") > 0, F.col("_first")).otherwise(n)
    state = lambda i: F.when(i == F.col("_first"), "DROP").otherwise("PASS")
    passed = F.transform(
        F.sequence(F.lit(1), reached),
        lambda i: F.struct(i.alias("stage_no"), F.element_at(F.array(*(F.lit(x) for x in names)), i).alias("stage"), state(i).alias("status"), F.when(i == F.col("_first"), F.col("_reason")).otherwise("ok").alias("reason")),
    )
    final = F.array(F.struct(F.lit(n + 1).alias("stage_no"), F.lit(FINAL).alias("stage"), F.when(F.col("_first") > 0, "DROP").otherwise("KEEP").alias("status"), F.col("_reason").alias("reason")))
    skipped = F.array(F.struct(F.lit(n + 1).alias("stage_no"), F.lit(FINAL).alias("stage"), F.lit("SKIP").alias("status"), F.lit(limit_reason).alias("reason")))
    rows = F.when(F.col("_skip"), skipped).otherwise(F.concat(passed, final))
    return judged.select(unit, F.explode(rows).alias("s")).select(unit, "s.*")


def audit_summary(audit: DataFrame) -> DataFrame:
    """(item, n): all units, kept ones, and drops by reason; skips are left out."""
    final = audit.filter(F.col("stage") == FINAL)
    totals = final.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "KEEP").alias("kept"))
    counts = totals.select(F.explode(F.array(F.struct(F.lit("total").alias("item"), F.col("total").alias("n")), F.struct(F.lit("kept").alias("item"), F.col("kept").alias("n")))).alias("x")).select("x.*")
    drops = final.filter("status = 'DROP'").groupBy(F.concat(F.lit("drop:"), "reason").alias("item")).agg(F.count("*").alias("n"))
    return counts.unionByName(drops)


def region_qc(rows: DataFrame, regions: DataFrame, key: list[str], seq: str, max_n: float) -> DataFrame:
    """rows with `reason`: kept, or the first failure over regions (region, region_order, start from 1, end) in order, each tested for being too short, frame and stop; too many N first.

    regions is a small configured table."""
    part = F.expr(f"substr({seq}, start, end - start + 1)")
    each = rows.crossJoin(F.broadcast(regions))
    short = F.length(seq) < F.col("end")
    rule = F.when(short, 1).when(~in_frame(part), 2).when(has_internal_stop(part), 3)
    failed = each.withColumn("_rule", rule).filter("_rule IS NOT NULL")
    name = F.concat("region", F.element_at(F.array(*(F.lit(x) for x in (":short", ":frame", ":internal_stop"))), F.col("_rule")))
    first = failed.groupBy(*key).agg(F.min_by(name, F.col("region_order") * 10 + F.col("_rule")).alias("_failed"))
    share = (F.length(seq) - F.length(F.translate(seq, "N", ""))) / F.greatest(F.length(seq), F.lit(1))
    return rows.join(first, key, "left").withColumn("reason", F.when(share > max_n, "too_many_n").otherwise(F.coalesce("_failed", F.lit("kept")))).drop("_failed")


def region_units(kept: DataFrame, regions: DataFrame, key: list[str], seq: str) -> DataFrame:
    """One row per kept record and region, with the region's symbols."""
    return kept.crossJoin(F.broadcast(regions)).select("region", *key, F.expr(f"substr({seq}, start, end - start + 1)").alias(seq))


def readiness(rows: DataFrame, rules: dict[str, tuple[Column, str, str]], ident: str, listed: int = 8) -> DataFrame:
    """(name, status, n, offenders, fix) per rule (condition that offends, WARN or FAIL, advice), with the first `listed` offending ids.

    Offences become rows, counted where they arise; of each rule only the first ids leave a task."""
    hits = F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, (bad, _, _) in rules.items())), lambda x: x.isNotNull())
    offences = rows.select(F.explode(hits).alias("name"), F.col(ident).alias("id")).groupBy("name", "id").agg(F.count("*").alias("c"))
    window = Window.partitionBy("name").orderBy("id")
    first = offences.withColumn("_k", F.row_number().over(window)).filter(F.col("_k") <= listed)
    named = first.groupBy("name").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("offenders"))
    found = offences.groupBy("name").agg(F.sum("c").alias("n")).join(named, "name")
    table = rows.sparkSession.createDataFrame([(name, level, fix) for name, (_, level, fix) in rules.items()], "name string, level string, fix string")
    joined = table.join(found, "name", "left")
    return joined.select("name", F.when(F.col("n") > 0, F.col("level")).otherwise("PASS").alias("status"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("offenders", F.lit("")).alias("offenders"), "fix")
