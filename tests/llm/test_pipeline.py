"""The pipeline's stages on a small corpus, each against a brute-force version that shares no code with it."""

from __future__ import annotations

import os
import re

import pytest

import corpus_pipeline
from tests.llm.test_operators import SCHEMA, brute_components, brute_tiles, clashing

DATA = "/root/testdata/sf0.001"
BLANK = re.compile("[\x20\x09-\x0d]+")


def base_passes(text):
    words = [w for w in BLANK.split(text or "") if w]
    windows, covered = {}, set()
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    for places in windows.values():
        if len(places) > 1:
            covered.update(i + k for i in places for k in range(5))
    return len(words) >= 10 and 100 * len(covered) <= 20 * len(words)


def alnum(text):
    return [w for w in re.split("[^0-9a-z\x80-\U0010ffff]+", (text or "").lower()) if w]


def leaks(text, items):
    words = alnum(text)
    seeds = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    for item in items:
        own = [k for k in range(len(item) - 4) if tuple(item[k : k + 5]) in seeds]
        if len({k + j for k in own for j in range(5)}) * 2 >= len(item) and sum(n for _, _, n in brute_tiles(item, words, 5)) * 2 >= len(item):
            return True
    return False


@pytest.fixture(scope="module")
def seen(spark, tmp_path_factory):
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    docs, found, folder = spark.read.parquet(f"{DATA}/documents.parquet"), {}, tmp_path_factory.mktemp("stages")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(path := str(folder / str(k)))
        after = spark.read.parquet(path)
        found[name] = ({r["doc_id"]: r for r in docs.collect()}, {r["doc_id"]: r for r in after.collect()}, docs.columns, after.columns)
        docs = after
    return found


def test_all_but_the_last_keep_the_columns(seen):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        _, _, before, after = seen[name]
        assert before == after


def test_quality_keeps_what_passes_the_base_rules_and_little_less(seen):
    before, after, _, _ = seen["quality rules"]
    passing = {i for i, r in before.items() if base_passes(r["text"])}
    assert set(after) <= passing and len(after) >= 0.9 * len(passing)


def test_one_of_each_group_of_near_copies_stays(seen):
    before, after, _, _ = seen["MinHash near-dedup"]
    ids = sorted(before)
    low, _ = brute_components([before[i]["text"] for i in ids])
    assert set(after) == {ids[k] for k, c in enumerate(low) if k == c}


def test_documents_with_an_item_go_and_all_others_stay(spark, seen):
    before, after, _, _ = seen["benchmark decontamination"]
    items = [own for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() if len(own := alnum(r["text"])) >= 5]
    gone = {i for i, r in before.items() if leaks(r["text"], items)}
    assert gone and set(after) == set(before) - gone


def test_personal_data_changes_and_nothing_else(seen):
    before, after, _, _ = seen["PII pseudonyms"]
    assert set(before) == set(after)
    spot = re.compile(r"[\w.%+-]+@[\w.-]+|[A-Za-z0-9_+/-]{16,}|[+(]?\d[\d ().:/-]{5,}\d")
    luhn = lambda d: 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    for i, r in before.items():
        old, new = r["text"], after[i]["text"]
        # All changes lie in e-mail addresses, long keys and runs of digits.
        assert spot.sub("#", old) == spot.sub("#", new)
        for mail in re.findall(r"(?<![\w.%+-])[\w.%+-]{1,64}@[a-z0-9-]+\.[a-z.]+", old):
            assert mail not in new
        for card in re.findall(r"(?<![\dA-Za-z+-])\d{16}(?![\dA-Za-z-])", old):
            assert (card in new) == (not luhn(card)) or old.count(card) < new.count(card)


def test_ids_decode_to_the_texts(seen):
    import sentencepiece

    from unitscope.llm.tokencount import default_model

    before, after, _, columns = seen["SentencePiece encoding"]
    library = sentencepiece.SentencePieceProcessor(model_file=default_model())
    assert set(before) == set(after) and columns == ["doc_id", "token_ids", "n_tokens", "round_trip"]
    for i, r in after.items():
        assert r["round_trip"] and r["n_tokens"] == len(r["token_ids"])
        assert library.decode(list(r["token_ids"])) == before[i]["text"].replace("\u2581", " ")


def test_odd_and_empty_documents(spark, tmp_path):
    """Nulls, repeats, clashing columns, and no rows at all, stage after stage."""
    bench = str(tmp_path)
    spark.createDataFrame([(1, "one two three four five six seven"), (None, None)], "item_id long, text string").write.parquet(f"{bench}/benchmark.parquet")
    text = "this is a text of some twelve words that passes every single rule"
    rows = [(1, text), (1, text), (None, text), (2, None), (None, None), (3, ""), (4, f"it has one two three four five six seven in it {text}")]
    docs = clashing(spark.createDataFrame([(i, t, None, "s") for i, t in rows], SCHEMA))
    for given, want in ((docs, [1]), (docs.limit(0), [])):
        for name, stage in corpus_pipeline.STAGES:
            given = stage(spark, given, bench)
            assert name == corpus_pipeline.STAGES[-1][0] or given.columns == docs.columns
        assert [r["doc_id"] for r in given.collect()] == want
