"""URL filters: host and path rules, and logistic regression on hashed character n-grams for the rest.

The model is trained with Spark's LogisticRegression on a small labelled table (labelled_urls by default)
whose size its caller bounds; features are counts of n-grams of host and path in
BUCKETS hashed buckets over the root of their number.
Its weights are a vector of BUCKETS numbers, so applying it is an expression over each url alone.

Of rules that fit, the longest host and path together wins, of equally long ones that of the longer host, then the
first in order.

A null url, or one without "://", has an empty host and path; the model judges those too. Repeated
rows are judged alike.
"""

from __future__ import annotations

import hashlib

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 2048
SIZES = (3, 4, 5)
THRESHOLD = 0.5
#: (host, path, verdict): a rule fits its host and all subdomains where the path starts with its own; the longest that fits wins.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: A small labelled table: names and paths by hand, and invented clean names, each name under every suffix so that suffixes carry no label. Every HELD_OUT-th name is for measuring.
SUFFIXES = ("example.com", "example.org", "example.net", "com", "org", "net")
HELD_OUT = 4
CLEAN_NAMES = """news docs university library museum weather blog.cooking archive python health school m.journal www.wiki maps recipes science
forum.gardening theatre history thesis transport ship-models hotels pillow-shop betterhomes winter-sports city-council m.choir bakery birdwatching
astronomy www.translation-office bridge-club hospital parliament orchestra railway-times blog.knitting observatory seed-catalogue m.farmersmarket
notary driving-lessons harbour-office blog.fieldnotes www.swimming freelance-editors winery adulteducation trackandfield""".split()
#: Clean names that mean nothing, so that letters of no word speak for neither side: made by a rule, of syllables of these parts.
INVENTED = 64
_STARTS, _VOWELS, _ENDS = "b br d dr f fl g gr h k l m n p pl qu r s sh st t th tr v w z".split(), "a e i o u ai ea io ou".split(), ["", "l", "n", "r", "s", "nd", "ng", "nt", "st", "th"]
SPAM_NAMES = """spam-offers cheap-meds free-casino hot-singles buy-viagra-now best-casino-bonus xxx-videos pills4u replica-watches free-money win-prize
spam-links adult-cams payday-loans-fast crack-keygen porn-free online-poker-win m.pills-direct www.bets-today m.casino-slots blog.cheap-viagra
www.spam-zone sexy-cams fake-bags m.free-spins poker-bets link-farm-seo ads-network click-tracker banner-ads adult-dating adult-zone quick-loans
hot-deals-win xxx-pills betting-tips-free casino-bets www.tracking-ads blog.diet-pills cheap-watches win-free-cash m.adult-chat spam-farms-online
ad-tracker casino-royal-win free-bet-bonus www.cheap-loans popup-ads xxx-adult farm-of-links""".split()
CLEAN_PATHS = ("/", "/about", "/2021/05/article.html", "/wiki/History", "/docs/guide", "/news/local", "/contact/", "/item?id=12")
SPAM_PATHS = ("/", "/about", "/win?id=7", "/buy/cheap/pills.html", "/casino/play-now", "/promo/click-here", "/contact/", "/xxx/videos")


def invented_names() -> list[str]:
    """INVENTED names of two or three syllables, some under the prefixes that sites have."""
    names = []
    for i in range(INVENTED):
        numbers = hashlib.sha256(f"invented {i}".encode()).digest()
        syllables = [_STARTS[numbers[3 * k] % len(_STARTS)] + _VOWELS[numbers[3 * k + 1] % len(_VOWELS)] + _ENDS[numbers[3 * k + 2] % len(_ENDS)] for k in range(2 + numbers[30] % 2)]
        names.append(("", "", "www.", "m.", "blog.")[numbers[31] % 5] + "".join(syllables))
    return names


def labelled_urls(held_out: bool | None = None) -> list[tuple[str, int]]:
    """(url, 1 for block) of all names, of the held-out ones or of the others."""
    return [
        (f"https://{name}.{suffix}{paths[(i + k) % len(paths)]}", label)
        for names, paths, label in (([*CLEAN_NAMES, *invented_names()], CLEAN_PATHS, 0), (SPAM_NAMES, SPAM_PATHS, 1))
        for i, name in enumerate(names)
        for k, suffix in enumerate(SUFFIXES)
        if held_out is None or held_out == (i % HELD_OUT == 0)
    ]


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _buckets() -> str:
    """SQL for the buckets of the n-grams of host and path, whose ends are marked."""
    grams = [f"if(length({t}) < {n}, array(), transform(sequence(1, length({t}) - {n - 1}), i -> substring({t}, i, {n})))" for t in ("concat('^', host, '$')", "concat('|', path, '|')") for n in SIZES]
    return f"transform(concat({', '.join(grams)}), g -> cast(pmod(xxhash64(g), {BUCKETS}) AS int))"


def trained(spark: SparkSession, labelled: DataFrame | None = None) -> tuple[list[float], float]:
    """Weights by bucket and the intercept, from labelled (url, label), 1 for urls to block."""
    if labelled is None:
        labelled = spark.createDataFrame(labelled_urls(), "url string, label int")
    rows = labelled.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("label").cast("double").alias("label"))
    counts = rows.withColumn("b", F.expr(_buckets())).filter("size(b) > 0")
    shares = F.expr(f"transform(sequence(0, {BUCKETS - 1}), k -> size(filter(b, x -> x = k)) / sqrt(size(b)))")
    # Both labels weigh the same, whatever their numbers.
    sizes = counts.groupBy("label").agg((F.lit(1.0) / F.count("*")).alias("weight"))
    ready = counts.join(F.broadcast(sizes), "label").select("label", "weight", array_to_vector(shares).alias("features")).coalesce(1).persist()
    fitted = LogisticRegression(regParam=1e-3, maxIter=60, standardization=False, weightCol="weight").fit(ready)
    ready.unpersist()
    return [float(w) for w in fitted.coefficients], float(fitted.intercept)


def _rule(host: Column, path: Column) -> tuple[Column, Column]:
    """The name and verdict of the longest rule that fits; nulls where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, rule_verdict in sorted(reversed(RULES), key=lambda r: (len(r[0] + r[1]), len(r[0]))):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        name, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name), F.when(fits, F.lit(rule_verdict)).otherwise(verdict)
    return name, verdict


def held_out_figures(spark: SparkSession) -> tuple[float, float, int]:
    """Precision and recall of "block" on the held-out names, and their number of urls, by a model that has seen the others."""
    table = lambda held_out: spark.createDataFrame(labelled_urls(held_out), "url string, label int")
    got = score(table(True), table(False), F.col("label").alias("label")).selectExpr(f"score >= {THRESHOLD} AS block", "label = 1 AS spam")
    n = got.groupBy("block", "spam").count().collect()
    hit = sum(r["count"] for r in n if r["block"] and r["spam"])
    return hit / max(1, sum(r["count"] for r in n if r["block"])), hit / sum(r["count"] for r in n if r["spam"]), sum(r["count"] for r in n)


def score(urls: DataFrame, labelled: DataFrame | None, *columns: Column, url_col: str = "url") -> DataFrame:
    """The columns, host, path and score, the model's probability of "block", per row of urls."""
    weights, intercept = trained(urls.sparkSession, labelled)
    parts = urls.select(*columns, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    table = "array(" + ", ".join(f"{w!r}D" for w in weights) + ")"
    total = f"aggregate(b, 0D, (a, k) -> a + {table}[k])"
    return parts.withColumn("score", F.expr(f"transform(array({_buckets()}), b -> if(size(b) = 0, 0D, 1 / (1 + exp(-({intercept!r}D + {total} / sqrt(size(b)))))))[0]"))


def ruled(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, rule_verdict) per row of pages; nulls where no rule fits."""
    parts = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule, verdict = _rule(F.col("host"), F.col("path"))
    return parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("rule_verdict"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", labelled: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) per row of pages; score is the model's probability of "block"."""
    rule, verdict = _rule(F.col("host"), F.col("path"))
    scored = score(pages, labelled, F.col(id_col).alias("page_id"), url_col=url_col)
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") >= THRESHOLD, "block").otherwise("allow")).alias("verdict"), "score")
