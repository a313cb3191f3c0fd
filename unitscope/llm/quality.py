"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each document gets a few counts (`features`). For every language and source the counts' shares are
summarised by a log-linear sketch: values below 32 have a bucket each, larger ones share a bucket
with values that differ by less than 1/32. A sketch is a table (group, metric, bucket, n), so it is
built by a plain map-side combined count and two sketches merge by adding n. A group's limit for a
metric is its third quartile plus the larger of REACH interquartile ranges and the metric's SLACK;
groups of under LEAST_ROWS rows use the merged sketch of their language, small languages that of all
rows. A document that exceeds a limit of its group is rejected, as is one that fails a base rule.

Null and empty texts have no words and fail the base rule. Null languages and sources are groups of
their own. Repeated rows count as often as they occur and are judged alike. 5-word windows are
compared by 64-bit hashes within one text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitscope.llm.durable import durable

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
LEAST_ROWS = 200
#: Rows of limits, of about 100 bytes each, that are sent to all tasks.
BROADCAST_GROUPS = 100_000
REACH = 3
#: metric: (its integer value as SQL over the features, slack above the third quartile)
METRICS = {
    "symbols": ("n_symbols * 1000 div greatest(n_words, 1)", 100),
    "dup_lines": ("n_dup_lines * 1000 div greatest(n_lines, 1)", 300),
    "repeats": ("n_repeat_words * 1000 div greatest(n_words, 1)", 150),
    "word_length": ("word_chars * 100 div greatest(n_words, 1)", 400),
}

_BLANK = r"[\\x20\\x09-\\x0D]"


def let(value: str, name: str, body: str) -> str:
    """SQL for body with name bound to value, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def running(array: str, zero: str, kind: str, emit: Callable[[str, str], str], step: Callable[[str, str], str]) -> str:
    """SQL for the array of emit(state, item), of type kind, over the items of an array; step(state, item) is the state for the next, zero the first.

    An aggregation that appends to an array copies it at each step. Here blocks of blocks are appended to: of n items, blocks of
    the cube root of n each, so an item costs as many copied references and not n."""
    none, nested, n = f"cast(array() AS array<{kind}>)", f"cast(array() AS array<array<{kind}>>)", "int(ceil(cbrt(size(_all))))"
    items = f"aggregate(slice(_all, int(_k * {n} * {n} + _l * {n} + 1), {n}), struct(_c.s AS s, {none} AS out), (_b, _v) -> struct({step('_b.s', '_v')} AS s, concat(_b.out, array({emit('_b.s', '_v')})) AS out), _b -> struct(_b.s AS s, concat(_c.out, array(_b.out)) AS out))"
    blocks = f"aggregate(sequence(0, int((least(size(_all) - _k * {n} * {n}, {n} * {n}) - 1) div {n})), struct(_a.s AS s, {nested} AS out), (_c, _l) -> {items}, _c -> struct(_c.s AS s, concat(_a.out, array(flatten(_c.out))) AS out))"
    return let(array, "_all", f"if(size(_all) = 0, {none}, aggregate(sequence(0, int((size(_all) - 1) div ({n} * {n}))), struct({zero} AS s, {nested} AS out), (_a, _k) -> {blocks}, _a -> flatten(_a.out)))")


def _repeated_words() -> str:
    """Words that stand in a 5-word window found twice or more. Texts without such a window, most of them, need no sorting."""
    windows = "transform(sequence(0, size(w) - 5), i -> xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]))"
    starts = (
        "array_sort(filter(transform(s, (x, k) -> if((k > 0 AND s[greatest(k - 1, 0)].h = x.h)"
        " OR (k + 1 < size(s) AND s[least(k + 1, size(s) - 1)].h = x.h), x.i, NULL)), i -> i IS NOT NULL))"
    )
    covered = f"aggregate({starts}, struct(-5 AS last, 0L AS n), (a, i) -> struct(i AS last, a.n + least(5, i - a.last) AS n)).n"
    slow = let("sort_array(transform(g, (h, i) -> struct(h AS h, i AS i)))", "s", covered)
    return f"if(size(w) < 5, 0L, {let(windows, 'g', f'if(size(array_distinct(g)) = size(g), 0L, {slow})')})"


def features(text_col: str = "text") -> Column:
    """A struct of the counts of one text."""
    text = f"coalesce(`{text_col}`, '')"
    words = f"filter(split({text}, '{_BLANK}+'), x -> x <> '')"
    lines = f"filter(split({text}, '\\n'), l -> l RLIKE '[^{_BLANK[1:-1]}]')"
    of_words = f"named_struct('n_words', cast(size(w) AS bigint), 'word_chars', cast(length(array_join(w, '')) AS bigint), 'n_repeat_words', {_repeated_words()})"
    of_lines = "named_struct('n_lines', cast(size(l) AS bigint), 'n_dup_lines', cast(size(l) - size(array_distinct(l)) AS bigint))"
    return F.expr(
        let(
            let(words, "w", of_words),
            "a",
            let(
                let(lines, "l", of_lines),
                "b",
                f"named_struct('n_words', a.n_words, 'word_chars', a.word_chars, 'n_symbols', cast(length(regexp_replace({text}, '[^#*$%&|<>]+', '')) AS bigint),"
                " 'n_dup_lines', b.n_dup_lines, 'n_repeat_words', a.n_repeat_words, 'n_lines', b.n_lines)",
            ),
        )
    )


def base_failed() -> Column:
    return F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")


def bucket(value: str) -> str:
    """SQL for the bucket of a whole number from 0."""
    exponent = f"(length(bin({value})) - 6)"
    return f"if({value} < 32, {value}, 32 * {exponent} + shiftright({value}, {exponent}))"


def bucket_floor(b: str) -> str:
    """SQL for the smallest value of a bucket."""
    return f"if({b} < 64, {b}, shiftleft({b} % 32 + 32, cast({b} div 32 - 1 AS int)))"


def sketches(counted: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, metric, bucket, n) over rows that have the counts."""
    values = F.explode(F.array(*(F.struct(F.lit(name).alias("metric"), F.expr(sql).cast("bigint").alias("value")) for name, (sql, _) in METRICS.items()))).alias("m")
    return counted.select(*groups, values).select(*groups, "m.metric", F.expr(bucket("m.value")).cast("bigint").alias("bucket")).groupBy(*groups, "metric", "bucket").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """The sketches of coarser groups."""
    return sketch.groupBy(*groups, "metric", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, metric, rows, q1, q3): the values below which a quarter and three quarters of the rows stand, to 1/32."""
    # An ordered running sum within at most a few hundred buckets of one group and metric.
    by = ", ".join([*groups, "metric"])
    running = sketch.selectExpr("*", f"sum(n) OVER (PARTITION BY {by} ORDER BY bucket) AS below", f"sum(n) OVER (PARTITION BY {by}) AS rows")
    value = lambda part: F.expr(f"min(if(4 * below >= {part} * rows, {bucket_floor('bucket')}, NULL))")
    return running.groupBy(*groups, "metric", "rows").agg(value(1).alias("q1"), value(3).alias("q3"))


def limits(sketch: DataFrame, outer: str, inner: str) -> DataFrame:
    """One row per (outer, inner) group with a column per metric: the largest value that is accepted."""
    fine, middle, whole = quartiles(sketch, [outer, inner]), quartiles(merged(sketch, [outer]), [outer]), quartiles(merged(sketch, []), [])
    f, m, w = fine.alias("f"), middle.alias("m"), whole.alias("w")
    on = lambda x, cols: [F.col(f"f.{c}").eqNullSafe(F.col(f"{x}.{c}")) for c in cols]
    all_ = f.join(m, on("m", [outer, "metric"]), "left").join(w, on("w", ["metric"]), "left")
    chosen = lambda c: F.expr(f"CASE WHEN f.rows >= {LEAST_ROWS} THEN f.{c} WHEN m.rows >= {LEAST_ROWS} THEN m.{c} ELSE w.{c} END")
    slack = F.expr("CASE f.metric " + " ".join(f"WHEN '{name}' THEN {slack}" for name, (_, slack) in METRICS.items()) + " END")
    limit = all_.select(F.col(f"f.{outer}").alias(outer), F.col(f"f.{inner}").alias(inner), F.col("f.metric").alias("metric"), (chosen("q3") + F.greatest(REACH * (chosen("q3") - chosen("q1")), slack)).alias("limit"))
    return limit.groupBy(outer, inner).agg(*(F.max(F.when(F.col("metric") == name, F.col("limit"))).alias(f"max_{name}") for name in METRICS))


def judged(counted: DataFrame, limit: DataFrame, outer: str = "lang", inner: str = "source") -> DataFrame:
    """counted with base_failed, exceeded (comma-joined metrics beyond their limits) and kept."""
    # The table of limits has a row per group. It is sent to all tasks while it is small; otherwise Spark splits hot groups of the join.
    named = durable(limit.withColumnsRenamed({outer: "_outer", inner: "_inner"}))
    if named.count() <= BROADCAST_GROUPS:
        named = F.broadcast(named)
    joined = counted.join(named, counted[outer].eqNullSafe(named["_outer"]) & counted[inner].eqNullSafe(named["_inner"]), "left")
    exceeded = F.concat_ws(",", *(F.when(F.expr(sql) > F.col(f"max_{name}"), F.lit(name)) for name, (sql, _) in METRICS.items()))
    return (
        joined.withColumn("base_failed", base_failed())
        .withColumn("exceeded", exceeded)
        .withColumn("kept", ~F.col("base_failed") & (F.col("exceeded") == ""))
        .drop("_outer", "_inner", *(f"max_{name}" for name in METRICS))
    )


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", outer: str = "lang", inner: str = "source") -> DataFrame:
    """One row per row of docs: id, groups, counts, base_failed, exceeded and kept."""
    counted = durable(docs.select(F.col(id_col).alias("doc_id"), F.col(outer).alias("lang"), F.col(inner).alias("source"), features(text_col).alias("f")).select("doc_id", "lang", "source", "f.*"))
    return judged(counted, limits(sketches(counted, ["lang", "source"]), "lang", "source"))


def accepted(docs: DataFrame, text_col: str = "text", outer: str = "lang", inner: str = "source") -> DataFrame:
    """The rows of docs that pass, with their columns. Rows are stored beside their counts, which costs more to take again than to store; no text is shuffled."""
    quoted = ["`" + c.replace("`", "``") + "`" for c in docs.columns]
    counts = F.struct(F.col(outer).alias("lang"), F.col(inner).alias("source"), features(text_col).alias("f"))
    counted = durable(docs.select(F.struct(*quoted).alias("row"), counts.alias("c")).select("row", "c.lang", "c.source", "c.f.*"))
    return judged(counted, limits(sketches(counted, ["lang", "source"]), "lang", "source")).filter("kept").select("row.*")
