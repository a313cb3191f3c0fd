"""What generated expressions leave in the driver."""

from __future__ import annotations

import pytest

from unitscope.llm import pii
from unitscope.llm.parsing import parsed_once


def _learnt(spark, clear: bool = False) -> int:
    """States in the caches that Spark's parser keeps."""
    from py4j.java_gateway import get_field

    interpreter = spark._jvm.org.apache.spark.sql.catalyst.parser.SqlBaseParser(None).getInterpreter()
    if clear:
        interpreter.clearDFA()
    return sum(get_field(dfa, "states").size() for dfa in get_field(interpreter, "decisionToDFA"))


@pytest.mark.parametrize("made", [pii.pseudonymise, pii.report])
def test_pseudonyms_leave_nothing_in_the_parser(spark, made):
    docs = spark.createDataFrame([(1, "write to ann.lee@mail.example or 10.0.0.7")], "doc_id long, text string")
    _learnt(spark, clear=True)
    text = made(docs, key="k").first()["text"]
    assert "ann.lee" not in text and "10.0.0.7" not in text
    assert _learnt(spark) < 1000


def test_settings_return(spark):
    names = ["spark.sql.parser.manageParserCaches", "spark.sql.parser.parserDfaCacheFlushThreshold"]
    before = [spark.conf.get(name) for name in names]
    with pytest.raises(ValueError), parsed_once(spark):
        assert [spark.conf.get(name) for name in names] == ["true", "1"]
        raise ValueError
    assert [spark.conf.get(name) for name in names] == before
    spark.conf.set(names[1], "50")
    try:
        with parsed_once(spark):
            pass
        assert spark.conf.get(names[1]) == "50"
    finally:
        spark.conf.unset(names[1])
