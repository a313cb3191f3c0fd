"""Card numbers beside other numbers, and secrets that look like them."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from unitscope.llm import pii

CARD = "4845168114407329"
SPACED = "4845 1681 1440 7329"


def replaced(spark, texts, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in pii.pseudonymise(docs, pii.DEMO_KEY, **more).orderBy("doc_id").collect()]


def luhn_ok(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_cards_beside_numbers(spark):
    texts = [CARD, f"{SPACED} 123 exp", f"{CARD} 12/27", f"12 {CARD} x", f"1234 {SPACED} 12", f"{SPACED} {SPACED}", f"{CARD} {CARD}-1", f"{SPACED} 5-12th", "7 " * 4000 + CARD]
    out = replaced(spark, texts)
    made = out[0]
    laid = " ".join(re.findall("....", made))
    assert made != CARD and luhn_ok(made)
    for text, got in zip(texts[:-1], out, strict=False):
        assert got == text.replace(CARD, made).replace(SPACED, laid), text
    assert out[-1].endswith(" " + made)
    assert replaced(spark, out[:4], inverse=True) == texts[:4]


def test_any_number_beside_a_card(spark):
    rng = random.Random(5)
    texts = [f"{rng.randrange(10 ** rng.randrange(1, 5))} {rng.choice((CARD, SPACED))} {rng.randrange(10 ** rng.randrange(1, 5))} end" for _ in range(200)]
    for text, got in zip(texts, replaced(spark, texts), strict=True):
        assert len(got) == len(text) and CARD not in got.replace(" ", ""), text


@pytest.mark.parametrize("other", ["31/12/1999", "1980-02-29", "123-45-6789", "10.0.0.255", "555-123-4567", "+1 (017) 555-7713"])
def test_other_kinds_after_a_card(spark, other):
    both, card, alone = replaced(spark, [f"{SPACED} {other} end", SPACED, f"{other} end"])
    assert both == f"{card} {alone}" and not alone.startswith(other)


def card_spans(run):
    """Brute force: stretches of whole groups of a run with a Luhn sum, usual layouts first, then from the left and the longest."""
    groups = [(m.start(), m.end()) for m in re.finditer(r"\d+", run)]
    found = []
    for i in range(len(groups)):
        for j in range(i, len(groups)):
            digits = re.sub(r"\D", "", run[groups[i][0] : groups[j][1]])
            if 13 <= len(digits) <= 19 and luhn_ok(digits):
                layout = " ".join(str(b - a) for a, b in groups[i : j + 1])
                found.append((i != j and layout not in ("4 4 4 4", "4 6 5", "4 6 4"), groups[i][0], -len(digits), groups[j][1]))
    taken = []
    for _, start, _, end in sorted(found):
        if all(end <= a or b <= start for a, b in taken):
            taken.append((start, end))
    return sorted(taken)


def test_cards_are_those_of_brute_force(spark):
    rng = random.Random(11)
    texts = [rng.choice(" -").join("".join(rng.choice("0123456789") for _ in range(rng.choice((1, 2, 3, 4, 4, 4, 5, 6, 13, 16, 20)))) for _ in range(rng.randrange(3, 60))) for _ in range(300)]
    # Digits in groups of 3-2-4 or 3-3-4 with dashes are of other kinds.
    texts = [t for t in texts if "-" not in t or not re.search(r"\b(\d{3}-\d{2}-\d{4}|\d{3}-\d{3}-\d{4}|\d{4}-\d{2}-\d{2})\b", t)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    many = 0
    for row in pii.report(docs, pii.DEMO_KEY).collect():
        text, spans, at = texts[row["doc_id"]], [], 0
        for m in re.finditer(r"(?=\d(?:[ -]?\d){12})\d+(?:[ -]\d+)*", text):
            spans += [(m.start() + a, m.start() + b) for a, b in card_spans(m[0])]
        assert len(row["text"]) == len(text)
        for start, end in spans:
            assert row["text"][at:start] == text[at:start]
            made = row["text"][start:end]
            assert re.sub(r"\d", "0", made) == re.sub(r"\d", "0", text[start:end]) and luhn_ok(re.sub(r"\D", "", made)) and made != text[start:end]
            at, many = end, many + 1
        assert row["text"][at:] == text[at:]
    assert many > 300


def test_invalid_numbers_stay(spark):
    texts = ["9807915762804490", "bad 9807 9157 6280 4490 x", "1 2 3", "12345678901234567890123", "id 4845168114407329abc", "12 2021-13-01 55"]
    assert replaced(spark, texts) == texts


def test_secrets_of_digits(spark):
    texts = [f"token={n}" for n in (CARD, "9807915762804490", "4845-1681-1440-7329", "98079157628044901")]
    out = replaced(spark, [*texts, f"token={SPACED}", CARD])
    for text, got in zip(texts, out, strict=False):
        assert re.fullmatch("token=[0-9A-Fa-f]{16,}", got) and len(got) == len(text) and got != text
        assert got != "token=" + out[-1]
    assert out[4].replace(" ", "") == "token=" + out[-1]


def test_all_dates_of_some_years(spark):
    """No two dates of one layout become the same, all stay dates of their layout and years, and all invert."""
    days = spark.sql("SELECT explode(flatten(array(sequence(DATE'0001-01-01', DATE'0012-12-31'), sequence(DATE'1968-01-01', DATE'2031-12-31'), sequence(DATE'9990-01-01', DATE'9999-12-31')))) AS d")
    layouts = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd.MM.yyyy")
    dates = days.selectExpr("explode(array(" + ", ".join(f"date_format(d, '{f}')" for f in layouts) + ")) AS text").distinct()
    made = pii.pseudonymise(dates.withColumn("was", F.col("text")), pii.DEMO_KEY)
    back = pii.pseudonymise(made.withColumn("made", F.col("text")), pii.DEMO_KEY, inverse=True).cache()
    n = dates.count()
    assert n > 100_000 and back.select("made").distinct().count() == n
    assert back.filter("text <> was").count() == 0
    month_first = r"'^(0[1-9]|1[0-2])/(1[3-9]|2[0-9]|3[01])/'"
    assert back.filter(f"(was RLIKE {month_first}) <> (made RLIKE {month_first}) OR length(made) <> 10 OR translate(made, '0123456789', '') <> translate(was, '0123456789', '')").count() == 0
    back.unpersist()


def test_addresses_and_other_numbers_invert(spark):
    rng = random.Random(8)
    octets = [[rng.choice((rng.randrange(256), rng.randrange(10))) for _ in range(4)] for _ in range(3000)]
    texts = [".".join(map(str, o)) for o in octets] + [".".join(f"{p:03d}" for p in o) for o in octets]
    texts += [f"{rng.randrange(1, 666):03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10000):04d}" for _ in range(500)] + [f"555-{rng.randrange(1000):03d}-{rng.randrange(10000):04d}" for _ in range(500)]
    texts = sorted(set(texts))
    made = replaced(spark, texts)
    assert len(set(made)) == len(texts) and replaced(spark, made, inverse=True) == texts
    padded = [t for t in texts if re.search(r"\b0\d\d?\.", t)]
    assert padded and all(re.search(r"(^|\.)0\d", m) for t, m in zip(texts, made, strict=True) if re.search(r"(^|\.)0\d", t) and "-" not in t)
    assert replaced(spark, ["1.02.3.4", "300.1.1.1"]) == ["1.02.3.4", "300.1.1.1"]
