"""Hard negatives, spelling variants and merge rounds against brute force and the library."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from unitscope.llm import mergerounds, negatives, spelling

# --- hard negatives


def brute_negatives(rows, anchors, n_positives=5, n_negatives=3, low=50, high=95):
    valid = [(i, label, [math.floor(256.0 * x) for x in v]) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, label, v in {(i, x, tuple(v)) for i, x, v in valid if anchors(i)}:
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, other, w in valid if i != a and len(w) == len(v)]
        for score, positive, _ in sorted(s for s in scored if s[2] == label)[:n_positives]:
            inside = sorted((s, i) for s, i, other in scored if other != label and low * -score <= 100 * -s <= high * -score)[:n_negatives]
            out += [(a, positive, rank, i, -score, -s) for rank, (s, i) in enumerate(inside, 1)]
    return sorted(out)


def mined(spark, rows, kind="float", **how):
    df = spark.createDataFrame(rows, f"vec_id long, label int, embedding array<{kind}>").withColumns({c: F.lit(1) for c in ("id", "anchor", "tile", "part", "score", "dims", "k", "rank")})
    got = negatives.hard_negatives(df, F.col("vec_id") % 3 == 0, **how).collect()
    return sorted(tuple(r) for r in got)


def test_hard_negatives_are_those_of_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(3)), [float(x) for x in rng.normal(size=12).astype(np.float32)]) for i in range(240)]
    # Ties, repeated rows, nulls, other lengths, an empty vector, negative ids.
    rows += [(300 + i, 1, rows[0][2]) for i in range(9)] + [rows[3], rows[3], (-6, 0, rows[7][2])]
    rows += [(401, None, rows[0][2]), (402, 1, None), (None, 1, rows[0][2]), (403, 1, [float("nan")] * 12), (404, 1, [float("inf")] + [1.0] * 11), (405, 1, [None] + [1.0] * 11)]
    rows += [(3 * i + 500, i % 2, [float(x) for x in rng.normal(size=3).astype(np.float32)]) for i in range(9)] + [(600, 1, []), (603, 1, []), (604, 0, [])]
    want = brute_negatives(rows, lambda i: i % 3 == 0)
    assert len(want) > 300 and mined(spark, rows) == want


def test_small_tiles_and_parts_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, int(rng.integers(2)), [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(150)]
    monkeypatch.setattr(negatives, "LEAST_TILE", 20)
    monkeypatch.setattr(negatives, "ANCHOR_TILE", 16)
    assert mined(spark, rows, n_positives=2, n_negatives=4, percent=(10, 80)) == brute_negatives(rows, lambda i: i % 3 == 0, 2, 4, 10, 80)


@pytest.mark.parametrize("size", [40.0, 4e5, 3e9])
def test_scores_beyond_floats_are_exact(spark, size):
    rng = np.random.default_rng(7)
    rows = [(i, int(rng.integers(2)), [float(x) for x in size * rng.normal(size=5)]) for i in range(60)]
    clipped = [(*r[:4], *(max(-(1 << 63), min((1 << 63) - 1, x)) for x in r[4:])) for r in brute_negatives(rows, lambda i: i % 3 == 0)]
    assert mined(spark, rows, "double") == clipped


def test_no_vectors_no_negatives(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, 1, [1.0])]) == [] and mined(spark, [(3, 1, [1.0])]) == []


def test_bounds_shrink_the_bitmap_and_keep_what_is_wanted():
    rng = np.random.default_rng(8)
    columns = np.floor(256 * rng.normal(size=(32, 4000)) * np.geomspace(1, 0.01, 32)[:, None])
    anchors, seen = columns[:, :70], []

    def keep(low, high):
        seen.append(len(low))
        return negatives._best(5)(low, high)

    found = list(negatives.bond(columns, anchors, lambda i: (np.delete(np.arange(4000), i), keep)))
    assert [i for i, _, _ in found] == list(range(70)) and seen[0] == 3999 and min(seen) < 100
    for i, alive, scores in found:
        every = anchors[:, i] @ columns
        best = [x for x in np.argsort(-every, kind="stable") if x != i][:5]
        assert set(best) <= set(alive.tolist()) and np.array_equal(scores, every[alive]) and len(alive) < 1000


# --- spelling variants


def brute_variants(rows, one_in):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % one_in == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    around = {w: [v for v in counts if near(w, v)] for w in counts}
    form = {w: top if vs and counts[top := min(vs, key=lambda v: (-counts[v], v))] >= 2 * counts[w] else None for w, vs in around.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), counts[w], len(around[w]), counts.get(form[w])) for w in counts)


def spelled(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("id", "word", "n", "key", "run", "form", "root")})
    order = ("word", "form", "root", "n", "n_near", "form_n")
    return sorted((tuple(r[c] for c in order) for r in spelling.variants(df, **how).collect()), key=lambda r: r[0])


def noisy(rng, n):
    stems = ["".join(rng.choice("abcdeèéÿÀ÷zaab") for _ in range(rng.randrange(4, 9))) for _ in range(14)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(60):
            w = rng.choice(stems[: rng.choice((2, 5, 14))])
            if rng.random() < 0.4:
                k = rng.randrange(len(w))
                w = w[:k] + rng.choice(["", w[k] + "a", "b", "é"]) + w[k + 1 :]
            words.append(w if rng.random() < 0.8 else w.upper())
        rows.append((rng.choice((None, i)), rng.choice(" ,1_").join(words)))
    return rows + [(1, None), (2, ""), (3, "Zz zzzzz ZZZZZ zzzzzz zzzzzz " * 4), rows[0], rows[0]]


@pytest.mark.parametrize("filter_bytes", [spelling.FILTER_BYTES, 24])
def test_spelling_variants_are_those_of_brute_force(spark, filter_bytes):
    rows = noisy(random.Random(9), 60)
    want = brute_variants(rows, 7)
    assert len(want) > 90 and any(r[1] and r[2] != r[1] for r in want)
    assert spelled(spark, rows, one_in=7, filter_bytes=filter_bytes) == want


def test_long_words_and_no_words(spark):
    long = "".join(random.Random(1).choice("abcdefg") for _ in range(200_000))
    rows = [(i, " ".join([long, long[:77] + "g" + long[77:], long[:-1] + "é"])) for i in range(3)]
    got = spelled(spark, rows)
    assert len(got) == 3 and all(r[3] == 3 for r in got) and [r[4] for r in got if r[0] == long] == [2]
    assert spelled(spark, []) == [] and spelled(spark, [(1, "only once here")]) == []


def test_filters_pass_all_words_and_few_others(spark):
    words = ["".join(random.Random(i).choice("abcdefghij") for _ in range(8)) for i in range(20_000)]
    table = spark.createDataFrame([(i, w, 3) for i, w in enumerate(words)], "id long, word string, n long").mapInArrow(spelling._keyed, "id long, word string, n long, key long")
    filters = spelling._filters(table, {8: len(words)}, 1, 0)
    keys = spelling._Letters(words).keys()
    assert len(filters.passed(keys, np.full(len(keys), 8))) == len(keys)
    other = spelling._Letters(["".join(random.Random(i).choice("klmnopqrst") for _ in range(8)) for i in range(20_000)]).keys()
    assert len(filters.passed(other, np.full(len(other), 8))) < 60


# --- merge rounds


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(mergerounds.default_model())


def odd_texts():
    rng = random.Random(1)
    yield from (None, "", " \n\t", "Hello  World's <|ENDOFTEXT|>foo<|endoftext|>bar 123 é ΑΣ x", "\x1c\x00 ﬁ İ é á  á b\xa0c\x85d", "<|startoftext|><|endoftext|>'s'll", "it's don't!'s !'re, O'Reilly's")
    yield from ("a" * 1001, "😂" * 500, "ab" * 700, "!" * 300 + "?" * 77, "x" * 60_000)
    yield from ("".join(rng.choice("etaoinshr") for _ in range(n)) for n in (300, 5000, 40_000))
    yield from ("".join(rng.choice(["lol", "aaa", "haha", "o", "😂", "!!", "a"]) for _ in range(1500)) for _ in range(10))
    yield from ("".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x3000), rng.randrange(0x1F600, 0x1F650)])) for _ in range(200)) for _ in range(150))


def test_ids_and_texts_are_those_of_the_library(spark):
    model, texts = library(), list(odd_texts())
    ids = [model.encode(t or "", add_special_tokens=False).ids for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit(0) for c in ("token_ids", "n_tokens", "row", "ids")})
    tokens = mergerounds.encoded(df)
    assert {r["doc_id"]: r["token_ids"] for r in tokens.collect()} == dict(enumerate(ids))
    back = {r["doc_id"]: r["text"] for r in mergerounds.decoded(tokens).collect()}
    assert back == {i: model.decode(x, skip_special_tokens=False) for i, x in enumerate(ids)}
    for r in mergerounds.digests(df).collect():
        own = ids[r["doc_id"]]
        assert r["n_tokens"] == len(own) and r["ids_sha256"] == hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(back[r["doc_id"]].encode()).hexdigest()


def test_kept_chunks_change_nothing(monkeypatch):
    monkeypatch.setattr(mergerounds, "KEPT", 3)
    monkeypatch.setattr(mergerounds, "FLAT", 500)
    model, texts = mergerounds._model(mergerounds.default_model()), list(odd_texts())
    texts += texts[:40]
    got = [np.frombuffer(x, "<u4").tolist() for x in mergerounds._id_bytes(model, pa.array(texts), {})]
    assert got == [library().encode(t or "", add_special_tokens=False).ids for t in texts]


def test_odd_ids_and_empty_tables(spark):
    odd = spark.createDataFrame([(1, [0, None, 10**6, -5, 49407]), (2, None), (3, [])], "doc_id long, token_ids array<int>")
    assert {r["doc_id"]: r["text"] for r in mergerounds.decoded(odd).collect()} == {1: "! <|endoftext|>", 2: "", 3: ""}
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert mergerounds.encoded(empty).collect() == mergerounds.digests(empty).collect() == []
    twice = spark.createDataFrame([(None, "a b"), (None, "a b"), ("x", "a")], "doc_id string, text string")
    assert Counter(r["n_tokens"] for r in mergerounds.digests(twice).collect()) == {2: 2, 1: 1}


def test_models_that_rounds_cannot_merge_are_refused(tmp_path):
    import json

    spec = json.loads(open(mergerounds.default_model(), encoding="utf-8").read())
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    path = tmp_path / "model.json"
    path.write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="merge"):
        mergerounds._Model(str(path))
