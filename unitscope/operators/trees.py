"""Tree strings as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def described(rows: DataFrame, tree: str = "newick") -> DataFrame:
    """rows with leaves, branch lengths (the root's own left out), their sum, whether leaves are unique and whether a length is not positive."""
    body = F.regexp_replace(tree, r"\)[^()]*$", ")")
    leaves = F.transform(F.regexp_extract_all(body, F.lit(r"[(,]\s*([^(),:;]+)"), 1), lambda x: F.trim(x))
    lengths = F.transform(F.regexp_extract_all(body, F.lit(r":\s*([0-9.eE+-]+)"), 1), lambda x: x.try_cast("double"))
    out = rows.withColumns({"leaves": leaves, "lengths": lengths})
    return out.withColumns(
        {
            "n_leaves": F.size("leaves"),
            "tree_length": F.aggregate("lengths", F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))),
            "unique_leaves": F.size(F.array_distinct("leaves")) == F.size("leaves"),
            "bad_length": F.exists("lengths", lambda x: x.isNull() | (x <= 0)),
        }
    )


def internal_nodes(rows: DataFrame, unit: str, tree: str = "newick") -> DataFrame:
    """(unit, node, n_children): per opening bracket the commas at its depth before it closes, plus one."""
    chars = rows.select(unit, F.posexplode(F.split(tree, "")).alias("pos", "c")).filter("c IN ('(', ')', ',')")
    by = f"PARTITION BY {unit} ORDER BY pos"
    deep = chars.selectExpr(unit, "pos", "c", f"sum(CASE c WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER ({by}) AS depth")
    # The node of a comma is the last bracket that opened its depth.
    own = deep.filter("c <> ')'").selectExpr(unit, "c", f"max(if(c = '(', pos, NULL)) OVER (PARTITION BY {unit}, depth ORDER BY pos) AS node")
    return own.groupBy(unit, "node").agg((F.count_if(F.col("c") == ",") + 1).alias("n_children"))


def polytomies(rows: DataFrame, unit: str, tree: str = "newick") -> DataFrame:
    return internal_nodes(rows, unit, tree).groupBy(unit).agg(F.count("*").alias("n_internal"), F.count_if(F.col("n_children") > 2).alias("n_polytomies"))


def star(names: Column, branch: str = "0.1") -> Column:
    """A star tree over an ordered array of names."""
    return F.concat(F.lit("("), F.array_join(F.transform(names, lambda n: F.concat(n, F.lit(f":{branch}"))), ","), F.lit(");"))
