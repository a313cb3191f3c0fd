"""Comparing several methods' results on the same units."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from unitscope.operators.ordinals import numbered


def unique_ids(rows: DataFrame, base: str, order: str, out: str = "unique_id") -> DataFrame:
    """Repeated base ids become id, id_2, id_3 in the given order; where that name is another row's own base id, the number counts on past all its repeats."""
    place = F.row_number().over(Window.partitionBy(base).orderBy(order))
    named = rows.withColumn("_n", place).withColumn(out, F.when(F.col("_n") > 1, F.concat(base, F.lit("_"), F.col("_n").cast("string"))).otherwise(F.col(base)))
    literal = rows.select(F.col(base).alias("_literal")).distinct()
    taken = named.filter("_n > 1").join(literal, F.col(out) == F.col("_literal"), "left_semi").select(F.col(out).alias("_taken")).distinct()
    most = Window.partitionBy(base)
    marked = named.withColumn("_most", F.max("_n").over(most)).join(taken, (F.col(out) == F.col("_taken")) & (F.col("_n") > 1), "left")
    return marked.withColumn(out, F.when(F.col("_taken").isNotNull(), F.concat(base, F.lit("_"), (F.col("_most") + F.col("_n")).cast("string"), F.lit("_"))).otherwise(F.col(out))).drop("_n", "_most", "_taken")


def keep_last(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row per key: that with the largest order."""
    window = Window.partitionBy(*key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")


def keep_first(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    window = Window.partitionBy(*key).orderBy(F.asc(order))
    return rows.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")


def discovery_table(main: DataFrame, methods: DataFrame, names: list[str], unit: str = "unit_id", order: str = "ord") -> DataFrame:
    """main with p, status and reason of every method, the last row of each (unit, method), under names in sorted order."""
    last = keep_last(methods, [unit, "method"], order)
    wide = last.groupBy(unit).pivot("method", sorted(names)).agg(F.first("p_value").alias("p"), F.first("status").alias("status"), F.first("reason").alias("reason"))
    return main.join(wide, unit, "left")


def paired(a: DataFrame, b: DataFrame, unit: str, p: str = "p_value") -> DataFrame:
    """(unit, p_a, p_b) where both methods have a p-value."""
    return a.select(unit, F.col(p).alias("p_a")).join(b.select(unit, F.col(p).alias("p_b")), unit).na.drop(subset=["p_a", "p_b"])


def set_differences(a: DataFrame, b: DataFrame, c: DataFrame, unit: str) -> DataFrame:
    """Ids that do not stand in all of three sets, with an ordered list of reasons."""
    flag = lambda df, name: df.select(unit).distinct().withColumn(name, F.lit(True))
    all_ = flag(a, "in_a").join(flag(b, "in_b"), unit, "full").join(flag(c, "in_c"), unit, "full").na.fill(False)
    reasons = F.array_join(F.array_compact(F.array(*(F.when(~F.col(f"in_{x}"), f"missing_in_{x}") for x in "abc"))), ";")
    return all_.withColumn("reasons", reasons).filter("reasons <> ''")


def set_metrics(a: DataFrame, b: DataFrame, unit: str, listed: int = 20) -> DataFrame:
    """One row: sizes of both sets, of what they share and of what only one has, the first ids of the latter and whether they differ."""
    flag = lambda df, name: df.select(unit).distinct().withColumn(name, F.lit(1))
    both = flag(a, "a").join(flag(b, "b"), unit, "full").na.fill(0, ["a", "b"])
    counts = both.agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum(F.col("a") * F.col("b")).alias("n_both"), F.count_if(F.col("a") > F.col("b")).alias("n_a_only"), F.count_if(F.col("b") > F.col("a")).alias("n_b_only"))
    # The lists are cut before they are gathered.
    first = lambda side: both.filter(side).orderBy(unit).limit(listed).agg(F.array_join(F.sort_array(F.collect_list(unit)), ",").alias("ids"))
    lists = first("a > b").withColumnRenamed("ids", "a_only_ids").crossJoin(first("b > a").withColumnRenamed("ids", "b_only_ids"))
    return counts.crossJoin(lists).withColumn("mismatch", F.col("n_a_only") + F.col("n_b_only") > 0)


def membership(a: DataFrame, b: DataFrame, unit: str, member: str) -> DataFrame:
    """Per unit: members shared, missing in b, extra in b, and whether they differ."""
    flag = lambda df, name: df.select(unit, member).distinct().withColumn(name, F.lit(1))
    both = flag(a, "a").join(flag(b, "b"), [unit, member], "full").na.fill(0, ["a", "b"])
    out = both.groupBy(unit).agg(F.sum(F.col("a") * F.col("b")).alias("n_shared"), F.sum(F.col("a") * (1 - F.col("b"))).alias("n_missing"), F.sum(F.col("b") * (1 - F.col("a"))).alias("n_extra"))
    return out.withColumn("mismatch", F.col("n_missing") + F.col("n_extra") > 0)


def contains_all(rows: DataFrame, core: DataFrame, unit: str, member: str) -> DataFrame:
    """Units that have every member of a core set."""
    size = core.select(member).distinct().agg(F.count("*").alias("_size"))
    held = rows.join(core.select(member).distinct(), member, "left_semi").groupBy(unit).agg(F.count_distinct(member).alias("_n"))
    return held.crossJoin(size).filter("_n = _size").select(unit)


def _member_counts(rows: DataFrame, unit: str, member: str) -> DataFrame:
    return rows.groupBy(member).agg(F.count_distinct(unit).alias("n_units"))


def member_ranking(rows: DataFrame, unit: str, member: str) -> DataFrame:
    """Members by the number of units that have them, ties by name."""
    return numbered(_member_counts(rows, unit, member), [F.desc("n_units"), member], "rank")


def longest_core(rows: DataFrame, unit: str, member: str, target: int) -> DataFrame:
    """The largest k up to target for which some unit has the k most frequent members, and the units that have them: (unit, k).

    A unit's k is the rank before its first missing member, so one pass finds all of them."""
    order = [F.desc("n_units"), F.col(member)]
    top = _member_counts(rows, unit, member).orderBy(*order).limit(target)  # which bounds the window below
    ranking = top.select(member, F.row_number().over(Window.orderBy(*order)).alias("rank"))
    held = rows.select(unit, member).distinct().join(F.broadcast(ranking), member)
    order = Window.partitionBy(unit).orderBy("rank")
    prefix = held.withColumn("_place", F.row_number().over(order)).filter("_place = rank").groupBy(unit).agg(F.max("rank").alias("k"))
    best = prefix.agg(F.max("k").alias("_best"))
    return prefix.crossJoin(F.broadcast(best)).filter("k = _best").select(unit, "k")


def in_every_unit(rows: DataFrame, unit: str, member: str) -> DataFrame:
    """(member, n_units, shared): whether each member stands in all units."""
    total = rows.agg(F.count_distinct(unit).alias("_total"))
    return rows.groupBy(member).agg(F.count_distinct(unit).alias("n_units")).crossJoin(F.broadcast(total)).select(member, "n_units", (F.col("n_units") == F.col("_total")).alias("shared"))


def combination_counts(wide: DataFrame, tests: dict[str, str], testable: str) -> DataFrame:
    """How often each combination of significances occurs on testable rows: a letter per method, upper case where its test holds."""
    letters = [F.when(F.coalesce(F.expr(test), F.lit(False)), letter.upper()).otherwise(letter.lower()) for letter, test in tests.items()]
    return wide.filter(testable).groupBy(F.concat_ws("|", *letters).alias("combination")).agg(F.count("*").alias("n"))


def pair_summary(pairs: DataFrame, q_a: str = "q_a", q_b: str = "q_b", level: float = 0.1) -> DataFrame:
    """One row over testable pairs: significant in each method (q < level), in both, in one only and in neither."""
    a, b = F.coalesce(F.col(q_a) < level, F.lit(False)), F.coalesce(F.col(q_b) < level, F.lit(False))
    return pairs.agg(F.count("*").alias("n"), F.count_if(a).alias("n_a"), F.count_if(b).alias("n_b"), F.count_if(a & b).alias("n_both"), F.count_if(a & ~b).alias("n_a_only"), F.count_if(b & ~a).alias("n_b_only"), F.count_if(~a & ~b).alias("n_neither"))


def prefix_match(left: DataFrame, right: DataFrame, key: str, other: str, order: str, shortest: int = 1) -> DataFrame:
    """Per left key the right value that equals it, else one of which either is a prefix of the other, the first by order.

    Every prefix of either side becomes an equi-join key, so no pairs of unrelated values are compared."""
    heads = lambda df, c: df.withColumn("_prefix", F.explode(F.transform(F.sequence(F.lit(shortest), F.greatest(F.lit(shortest), F.length(c))), lambda n: F.substring(F.col(c), F.lit(1), n))))
    l, r = left.select(key).distinct(), right.select(other, order)
    a = heads(l, key).join(r, F.col("_prefix") == F.col(other))
    b = heads(r, other).join(l, F.col("_prefix") == F.col(key))
    hits = a.select(key, other, order).unionByName(b.select(key, other, order)).distinct()
    best = Window.partitionBy(key).orderBy(F.when(F.col(key) == F.col(other), 0).otherwise(1), order)
    return hits.withColumn("_n", F.row_number().over(best)).filter("_n = 1").select(key, other)


def priority_lookup(rows: DataFrame, name: str, lookup: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Per row the value of the first lookup row whose first matching key column, in the given order of columns, equals its name."""
    long = lookup.select(order, value, F.posexplode(F.array(*keys)).alias("_priority", "_key")).filter("_key IS NOT NULL")
    best = Window.partitionBy("_key").orderBy("_priority", order)
    first = long.withColumn("_n", F.row_number().over(best)).filter("_n = 1").select("_key", value)
    return rows.join(first, F.col(name) == F.col("_key"), "left").drop("_key")


def interleave(a: DataFrame, b: DataFrame, key: list[str], seq: str, block: int) -> DataFrame:
    """Alternating blocks of two aligned sources; null where lengths differ."""
    both = a.select(*key, F.col(seq).alias("_a")).join(b.select(*key, F.col(seq).alias("_b")), key)
    n = F.ceil(F.length("_a") / block).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.substring(F.when(i % 2 == 0, F.col("_a")).otherwise(F.col("_b")), i * block + 1, F.lit(block)))
    return both.select(*key, F.when(F.length("_a") == F.length("_b"), F.array_join(parts, "")).alias(seq))


def concatenated(segments: DataFrame, key: list[str], order: str, seq: str) -> DataFrame:
    """A key's segments joined in order; a key has as many as there are segments of a unit."""
    return segments.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, seq))), lambda s: s[seq]), "").alias(seq))
