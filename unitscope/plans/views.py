"""Views on the driver tables on which the operators are run, in Spark and as DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_ALN_KEYS = """SELECT c_nationkey AS unit_id, c_custkey AS taxon,
  concat(md5(concat('u0|',c_nationkey)),md5(concat('u1|',c_nationkey)),md5(concat('u2|',c_nationkey))) AS u,
  concat(md5(concat('r0|',c_custkey)),md5(concat('r1|',c_custkey)),md5(concat('r2|',c_custkey))) AS r,
  concat(md5(concat('m0|',c_custkey)),md5(concat('m1|',c_custkey)),md5(concat('m2|',c_custkey))) AS m FROM customer"""

COMMON = {
    "sites": """SELECT l_suppkey AS unit_id, l_orderkey, l_linenumber, l_partkey,
  l_quantity AS f1, l_extendedprice AS f2, l_discount AS f3, l_tax AS f4 FROM lineitem""",
    "methods": """SELECT o_custkey AS unit_id, o_orderpriority AS method, o_orderkey AS ord,
  CASE WHEN o_orderstatus = 'P' THEN 'FAIL' ELSE 'OK' END AS status,
  CASE WHEN o_orderstatus = 'P' THEN 'timeout' ELSE 'ok' END AS reason,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE (1 + floor(o_totalprice) % 1000) / 1000 END AS p_value,
  CAST(day(o_orderdate) AS DOUBLE) AS runtime_sec FROM orders""",
    "grid": """SELECT l_returnflag AS family, l_linestatus AS method, l_linenumber AS taxa,
  CAST(floor(l_quantity / 10) AS INT) * 300 AS L, 999 AS N,
  (1 + floor(l_extendedprice) % 1000) / 1000 AS p,
  CASE WHEN l_tax < 0.01 THEN 'FAIL' ELSE 'OK' END AS status,
  CAST(day(l_shipdate) AS DOUBLE) AS runtime_sec FROM lineitem""",
    "meta": """SELECT concat('s', event_id) AS strain,
  CASE event_id % 4 WHEN 0 THEN substr(CAST(ts AS STRING),1,10) WHEN 1 THEN substr(CAST(ts AS STRING),1,7)
    WHEN 2 THEN substr(CAST(ts AS STRING),1,4) ELSE NULL END AS collection_date,
  event_type AS country, props FROM events""",
    "labelled": """SELECT d.doc_id, l.quality = 1 AS discovered, l.toxic = 1 AS positive, d.lang, d.source
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
}
SPARK = COMMON | {
    "aln": f"""SELECT unit_id, taxon, translate(array_join(transform(sequence(1,96),
  i -> if(substr(m,i,1) IN ('0','1'), substr(r,i,1), substr(u,i,1))),''), '0123456789abcdef','ACGCACGCACGTACN-') AS seq FROM ({_ALN_KEYS})""",
    "trees": """SELECT n_nationkey AS unit_id, concat('(', array_join(array_sort(collect_list(
  concat('S', s_suppkey, ':', 1 + s_suppkey % 7))), ','), ')N', n_nationkey, ':0.5;') AS newick
FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey""",
}
DUCK = COMMON | {
    "aln": f"""SELECT unit_id, taxon, translate(array_to_string(list_transform(range(1,97),
  lambda i: if(substr(m,i,1) IN ('0','1'), substr(r,i,1), substr(u,i,1))),''), '0123456789abcdef','ACGCACGCACGTACN-') AS seq FROM ({_ALN_KEYS})""",
    "trees": """SELECT n_nationkey AS unit_id, concat('(', array_to_string(list_sort(list(
  concat('S', s_suppkey, ':', 1 + s_suppkey % 7))), ','), ')N', n_nationkey, ':0.5;') AS newick
FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey""",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_READ = {"sites": ["lineitem"], "methods": ["orders"], "grid": ["lineitem"], "meta": ["events"], "labelled": ["documents", "labels"], "aln": ["customer"], "trees": ["nation", "supplier"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A view by name, over the tables in sf_dir. With spread, the digests of aln are made once to a row, not once to a symbol, and dealt over all tasks, however few files there are."""
    tables = {t: table(spark, sf_dir, t) for t in _READ[name]}
    text = SPARK[name]
    if spread:
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        text = text.replace("SELECT c_nationkey", f"SELECT /*+ REPARTITION({tasks}) */ c_nationkey")
    for t in tables:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(text, **tables)


def with_views(*names: str) -> str:
    """WITH clause that defines the named views for DuckDB, to be followed by further CTEs or a SELECT."""
    return "WITH RECURSIVE " + ", ".join(f"{name} AS ({DUCK[name]})" for name in names) + " "


def register() -> tuple[dict, dict, Callable]:
    """Queries, their DuckDB texts, and a decorator that adds a function to the first and its text, after the named views, to the second."""
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    oracle: dict[str, str] = {}

    def query(sql: str | None = None, *views: str) -> Callable:
        def add(f: Callable) -> Callable:
            queries[f.__name__] = f
            if sql and views:
                oracle[f.__name__] = with_views(*views).rstrip() + (" " if sql.startswith("SELECT") else ", ") + sql
            elif sql:
                oracle[f.__name__] = sql
            return f

        return add

    return queries, oracle, query
