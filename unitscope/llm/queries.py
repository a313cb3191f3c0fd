"""The registered queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitscope.llm import decontaminate, langid, licenses, mergerounds, minhash, negatives, pii, quality, spelling, tokencount, urlfilter, viterbi, warc
from unitscope.sources.shared import scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_documents(spark, sf_dir))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of whole texts, and whether they decode to the text."""
    return viterbi.tokenised(_documents(spark, sf_dir))


def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_documents(spark, sf_dir), pii.session_key(spark))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per contaminated document and item."""
    return decontaminate.contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exceeded names the limits of the document's group that it is beyond."""
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "exceeded", "kept")
    return quality.quality(_documents(spark, sf_dir)).select(*columns)


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def warc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derivatives of response records that were written as WARC files and read again: what SQL knows of them."""
    warc.write_responses(warc.responses(spark.read.parquet(f"{sf_dir}/pages.parquet")), path := scratch(spark, "warc"))
    made = warc.derivatives(warc.read_records(spark, path))
    return made.select("record_type", "target_uri", F.col("source_headers").alias("headers"), F.col("refers_to").isNotNull().alias("refers"))


def license_base_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op1 that SQL can express."""
    return licenses.scan(_documents(spark, sf_dir)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op7 that SQL can express."""
    return urlfilter.ruled(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "rule_verdict")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(_documents(spark, sf_dir))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vec_id against all vectors; every seventh has the next label."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    labelled = vectors.withColumn("label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)"))
    return negatives.hard_negatives(labelled, F.col("vec_id") % 50 == 0)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of whole texts; one run in 97 loses a letter first."""
    return spelling.variants(_documents(spark, sf_dir), one_in=97)


def op13_bpe_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of whole texts and of what they decode to."""
    return mergerounds.digests(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_pii_pseudonyms": op5_pii_pseudonyms,
    "op6_decontamination": op6_decontamination,
    "op7_url_filter": op7_url_filter,
    "op8_quality_rules": op8_quality_rules,
    "op9_warc_derivatives": op9_warc_derivatives,
    "op10_language_id": op10_language_id,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_bpe_rounds": op13_bpe_rounds,
    "license_base_places": license_base_places,
    "url_rules": url_rules,
    "warc_files": warc_files,
}


def _phrase_places() -> str:
    """Lists of the places, from 1, of each base phrase in words w."""
    return ", ".join(
        f"list_filter(range(1, len(w) - {len(words) - 2}), lambda i: {' AND '.join(f"w[i + {k}] = '{word}'" for k, word in enumerate(words))}) AS p{n}"
        for n, words in enumerate(phrase.split() for phrase in licenses.PHRASES)
    )


def _rule_cases(value: str) -> str:
    longest_first = sorted(urlfilter.RULES, key=lambda r: -len(r[0] + r[1]))
    return " ".join(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{host + path if value == 'rule' else verdict}'" for host, path, verdict in longest_first)


ORACLE: dict[str, str] = {
    "warc_files": """
SELECT unnest(['metadata', 'conversion']) AS record_type, coalesce(url, '') AS target_uri, concat('Content-Type: text/html; charset=utf-8', chr(13), chr(10), 'Content-Length: ', octet_length(encode(coalesce(html, '')))) AS headers, TRUE AS refers FROM pages
""",
    "license_base_places": rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), p AS (
  SELECT doc_id, len(w) AS n, {_phrase_places()} FROM w
), a AS (
  SELECT *, list_concat(list_concat(p0, p1), p2) AS every FROM p
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(every) AS BIGINT) AS n_base, list_min(every) - 1 AS first_word, list_max(every) - 1 AS last_word,
  concat_ws(',', CASE WHEN len(p1) > 0 THEN 'apache-2' END, CASE WHEN len(p2) > 0 THEN 'cc-by-nc' END, CASE WHEN len(p0) > 0 THEN 'mit' END) AS base_labels
FROM a
""",
    "url_rules": rf"""
WITH h AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
)
SELECT page_id, host, path, CASE {_rule_cases("rule")} END AS rule, CASE {_rule_cases("verdict")} END AS rule_verdict FROM h
""",
    "op2_minhash_near_dedup": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM w
), e AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), linked AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM e AS a JOIN e AS b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS component_id FROM s
  UNION
  SELECT linked.b, reach.component_id FROM reach JOIN linked ON linked.a = reach.doc_id
), low AS (
  SELECT doc_id, min(component_id) AS component_id FROM reach GROUP BY doc_id
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, low.component_id, s.doc_id = low.component_id AS kept
FROM s JOIN low ON s.doc_id = low.doc_id
""",
    "op11_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])) AS BIGINT) AS score
  FROM v AS a JOIN v AS b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), n AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
""",
    # The checksum is taken byte by byte with a table that its polynomial gives.
    "op12_spelling_variants": rf"""
WITH RECURSIVE t AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS crc
), r AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents
), d AS (
  SELECT doc_id, run, count(*) AS n, flatten(list_transform(string_split(concat(doc_id, ':', run), ''),
    lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [CAST(192 + ord(c) // 64 AS BIGINT), CAST(128 + ord(c) % 64 AS BIGINT)] END)) AS bytes
  FROM r GROUP BY doc_id, run
), h AS (
  SELECT run, n, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t.crc[CAST(xor(c, b) & 255 AS BIGINT) + 1]), 4294967295), 4294967295) AS h FROM d, t
), w AS (
  SELECT CASE WHEN h % 97 = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word, n FROM h
), v AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), e AS (
  SELECT word, n, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS short FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)
), near AS (
  SELECT a.word, b.word AS other, b.n FROM e AS a JOIN e AS b ON a.i = b.i AND a.short = b.short AND a.word <> b.word
  UNION SELECT e.word, v.word, v.n FROM e JOIN v ON e.short = v.word
  UNION SELECT v.word, e.word, e.n FROM e JOIN v ON e.short = v.word
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS top, max(n) AS top_n FROM near GROUP BY word
), j AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 2 * v.n THEN top END AS form, CASE WHEN top_n >= 2 * v.n THEN top_n END AS form_n
  FROM v LEFT JOIN best ON best.word = v.word
), path AS (
  SELECT word, word AS at FROM j
  UNION ALL
  SELECT path.word, j.form FROM path JOIN j ON j.word = path.at AND j.form IS NOT NULL
), root AS (
  SELECT path.word, path.at AS root FROM path JOIN j ON j.word = path.at AND j.form IS NULL
)
SELECT j.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM j JOIN root ON root.word = j.word
""",
    "op8_quality_rules": rf"""
WITH t AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, lang, source, text,
    list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM t
), g AS (
  SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4])) AS g FROM w WHERE len(w) >= 5
), twice AS (
  SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(5)) AS k) GROUP BY doc_id
), f AS (
  SELECT w.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines
  FROM w LEFT JOIN covered ON covered.doc_id = w.doc_id
), m AS (
  SELECT lang, source, unnest(['symbols', 'dup_lines', 'repeats', 'word_length']) AS metric,
    unnest([n_symbols * 1000 // greatest(n_words, 1), n_dup_lines * 1000 // greatest(n_lines, 1),
      n_repeat_words * 1000 // greatest(n_words, 1), word_chars * 100 // greatest(n_words, 1)]) AS v
  FROM f
), b AS (
  SELECT lang, source, metric, CASE WHEN v < 32 THEN v ELSE 32 * (length(bin(v)) - 6) + (v >> (length(bin(v)) - 6)) END AS bucket, count(*) AS n
  FROM m GROUP BY ALL
), levels AS (
  SELECT 1 AS level, lang, source, metric, bucket, n FROM b
  UNION ALL SELECT 2, lang, NULL, metric, bucket, sum(n) FROM b GROUP BY lang, metric, bucket
  UNION ALL SELECT 3, NULL, NULL, metric, bucket, sum(n) FROM b GROUP BY metric, bucket
), running AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS below,
    sum(n) OVER (PARTITION BY level, lang, source, metric) AS total,
    CASE WHEN bucket < 64 THEN bucket ELSE (bucket % 32 + 32) << CAST(bucket // 32 - 1 AS INT) END AS low
  FROM levels
), q AS (
  SELECT level, lang, source, metric, total, min(CASE WHEN 4 * below >= total THEN low END) AS q1, min(CASE WHEN 4 * below >= 3 * total THEN low END) AS q3
  FROM running GROUP BY ALL
), chosen AS (
  SELECT f.lang, f.source, f.metric,
    CASE WHEN f.total >= {quality.LEAST_ROWS} THEN f.q1 WHEN m.total >= {quality.LEAST_ROWS} THEN m.q1 ELSE w.q1 END AS q1,
    CASE WHEN f.total >= {quality.LEAST_ROWS} THEN f.q3 WHEN m.total >= {quality.LEAST_ROWS} THEN m.q3 ELSE w.q3 END AS q3,
    CASE f.metric WHEN 'symbols' THEN 100 WHEN 'dup_lines' THEN 300 WHEN 'repeats' THEN 150 ELSE 400 END AS slack
  FROM q AS f
  JOIN q AS m ON f.level = 1 AND m.level = 2 AND m.lang IS NOT DISTINCT FROM f.lang AND m.metric = f.metric
  JOIN q AS w ON w.level = 3 AND w.metric = f.metric
), l AS (
  SELECT lang, source, metric, q3 + greatest({quality.REACH} * (q3 - q1), slack) AS top FROM chosen
), judged AS (
  SELECT f.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, concat_ws(',',
    CASE WHEN n_symbols * 1000 // greatest(n_words, 1) > (SELECT max(top) FROM l WHERE l.lang IS NOT DISTINCT FROM f.lang AND l.source IS NOT DISTINCT FROM f.source AND metric = 'symbols') THEN 'symbols' END,
    CASE WHEN n_dup_lines * 1000 // greatest(n_lines, 1) > (SELECT max(top) FROM l WHERE l.lang IS NOT DISTINCT FROM f.lang AND l.source IS NOT DISTINCT FROM f.source AND metric = 'dup_lines') THEN 'dup_lines' END,
    CASE WHEN n_repeat_words * 1000 // greatest(n_words, 1) > (SELECT max(top) FROM l WHERE l.lang IS NOT DISTINCT FROM f.lang AND l.source IS NOT DISTINCT FROM f.source AND metric = 'repeats') THEN 'repeats' END,
    CASE WHEN word_chars * 100 // greatest(n_words, 1) > (SELECT max(top) FROM l WHERE l.lang IS NOT DISTINCT FROM f.lang AND l.source IS NOT DISTINCT FROM f.source AND metric = 'word_length') THEN 'word_length' END) AS exceeded
  FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, exceeded, NOT base_failed AND exceeded = '' AS kept FROM judged
""",
}
