"""License scans: base phrases, and ordered signature rules with suppression of contained detections.

The rules (license_rules.py) are tried on a text only if it holds their keyword. A detection is a
rule's match with its interval of characters. A detection is suppressed if its interval lies in that
of a detection of the same or a better class, of equal intervals of one class the earlier rule
stays. Labels are those of the base phrases and of the detections that stay.

Letters A-Z count as a-z; no other case folding. Null and empty texts have no words, places or
labels and a score of 0. Repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitscope.llm.license_rules import SCORES, needed, rules
from unitscope.llm.quality import let, running

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
BASE_SCORE = 0.95
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _places() -> str:
    """Structs (at, label) of the base phrases over the lower-case words w."""
    found = []
    for phrase, label in PHRASES.items():
        words = phrase.split()
        here = " AND ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(words))
        places = f"filter(sequence(0, size(w) - {len(words)}), i -> {here})"
        found.append(f"if(size(w) < {len(words)}, array(), transform({places}, i -> struct(i AS at, '{label}' AS label)))")
    empty = "cast(array() AS array<struct<at: int, label: string>>)"
    return f"concat({empty}, {', '.join(found)})"


def _detections(low: str) -> str:
    """Structs (start, end, grade, rank, label) of all matches over the text named low, which is lower-cased for keywords only."""
    table = ", ".join(f"struct({grade} AS grade, {k} AS rank, '{label}' AS label, '{keyword}' AS keyword, {_quoted(pattern)} AS pattern)" for k, (grade, label, keyword, pattern) in enumerate(rules()))
    tried = f"filter(array({table}), r -> contains({low}, r.keyword))"
    # The parts between matches and the matches give the intervals: each starts where those before it end.
    interval = "struct<start: int, end: int>"
    start = lambda s, k: f"{s} + length(p[{k}])"
    intervals = running("sequence(0, size(m) - 1)", "0", interval, lambda s, k: f"struct({start(s, k)} AS start, {start(s, k)} + length(m[{k}]) AS end)", lambda s, k: f"{start(s, k)} + length(m[{k}])")
    each = let("regexp_extract_all(`_text`, r.pattern, 0)", "m", f"if(size(m) = 0, cast(array() AS array<{interval}>), {let('split(`_text`, r.pattern, -1)', 'p', intervals)})")
    return f"flatten(transform({tried}, r -> transform({each}, x -> struct(x.start AS start, -x.end AS back, r.grade AS grade, r.rank AS rank, r.label AS label))))"


def _standing() -> str:
    """Of the detections d, sorted by start, then from the longest: the distinct labels that stand and their best grade."""
    grades = sorted(SCORES)
    inside = " OR ".join(f"(x.grade >= {g} AND a.e{g} >= -x.back)" for g in grades)
    ends = ", ".join(f"greatest(a.e{g}, if(x.grade = {g}, -x.back, -1)) AS e{g}" for g in grades)
    start = ", ".join(f"-1 AS e{g}" for g in grades)
    return (
        f"aggregate(sort_array(d), struct({start}, cast(array() AS array<string>) AS labels, 99 AS best),"
        f" (a, x) -> struct({ends}, if({inside}, a.labels, array_union(a.labels, array(x.label))) AS labels, if({inside}, a.best, least(a.best, x.grade)) AS best))"
    )


def _suspect(text: Column) -> Column:
    """Whether a text can hold a base phrase or a rule's match: a necessary condition of all of them."""
    low = F.lower(text)
    words, patterns = needed()
    found = F.lit(False)
    for word in words:
        found = found | F.contains(low, F.lit(word))
    for pattern in patterns:
        found = found | F.rlike(low, F.lit(pattern))
    return found


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) per row of docs."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    words = f"regexp_extract_all(translate(`_text`, '{_UPPER}', '{_LOWER}'), '{_WORD}', 0)"
    base = let(words, "w", _places())
    rule = let("lower(`_text`)", "low", let(_detections("low"), "d", _standing()))
    both = let(base, "b", let(rule, "s", "struct(b AS base, s.labels AS labels, s.best AS best)"))
    # Without this condition the words and rules would be tried on every text.
    found = rows.withColumn("f", F.when(_suspect(F.col("_text")), F.expr(both)))
    scores = "CASE f.best " + " ".join(f"WHEN {g} THEN {s}D" for g, s in SCORES.items()) + " ELSE 0D END"
    return found.select(
        "doc_id",
        F.expr("cast(regexp_count(`_text`, '[0-9A-Za-z[^\\\\x00-\\\\x7F]]+') AS bigint)").alias("n_words"),
        F.expr("cast(coalesce(size(f.base), 0) AS bigint)").alias("n_base"),
        F.expr("cast(array_min(f.base.at) AS bigint)").alias("first_word"),
        F.expr("cast(array_max(f.base.at) AS bigint)").alias("last_word"),
        F.expr("coalesce(array_join(array_sort(array_distinct(f.base.label)), ','), '')").alias("base_labels"),
        F.expr("coalesce(array_join(array_sort(array_union(f.base.label, f.labels)), ','), '')").alias("labels"),
        F.expr(f"greatest({scores}, if(coalesce(size(f.base), 0) > 0, {BASE_SCORE}D, 0D))").alias("score"),
    )
