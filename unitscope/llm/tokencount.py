"""Token counts of whole texts without materialising ids.

A SentencePiece BPE model never merges across the start of a run of spaces nor across a line feed,
provided that no piece of its vocabulary does, nor between two characters that stand side by side in
no piece; `_processor` verifies the first for the model and `apart` lists marks of which the second
holds after letters. So a text's tokens are those of its pre-tokens: runs of spaces with the characters
that follow, the marks at the end of a word, and line feeds. Each distinct pre-token of the corpus is counted once with the library, and a text's count is
the sum over its pre-tokens of frequency times pieces.

The pre-tokens that stand most often, at most HEAD_ROWS of at most HEAD_BYTES bytes each, are sent to
every task, which bounds that table; a task sums them at once. All other pre-tokens of a text leave the
task as (text, pre-token, frequency) and are joined with the table of all pre-tokens.

Null and empty texts have no tokens. Rows that repeat one id and text are each counted, as are rows
with a null id.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitscope.llm.quality import bucket, bucket_floor
from unitscope.sources.shared import scratch

LIMIT = 4096
HEAD_ROWS = 1 << 17
HEAD_BYTES = 48
_SPACE = "▁"
FLUSH_ROWS = 300_000
_WORD_END = re.compile("( *[^\\W\\d_]+)([^\\w\\s].*)", re.S)
_PIECES = re.compile(" *[^ \n]+| +|\n")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def _processor(model: str):
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=model)
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        if not (processor.is_byte(i) or processor.is_control(i) or processor.is_unknown(i)) and ("\n" in piece or _SPACE in piece.lstrip(_SPACE)):
            raise ValueError(f"piece {i} of {model} crosses a pre-token; its texts cannot be split")
    if len(processor.encode("\n")) != 2 or len(processor.encode("  a")) == len(processor.encode("a")):
        raise ValueError(f"{model} normalises white space; its texts cannot be split")
    return processor


@lru_cache(maxsize=2)
def apart(model: str) -> frozenset[str]:
    """The ASCII marks that follow a letter in no piece of the model."""
    processor = _processor(model)
    joined = {piece[i + 1] for piece in map(processor.id_to_piece, range(processor.get_piece_size())) for i in range(len(piece) - 1) if piece[i].isalpha()}
    return frozenset(string.punctuation) - joined


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text before marks are split off; the model sets one space before the text."""
    return _PIECES.findall(" " + text.replace(_SPACE, " ")) if text else []


def split(pretoken: str, marks: frozenset[str]) -> tuple[str, ...]:
    """A word and the marks at its end, or the pre-token as it is."""
    if pretoken[-1] in marks and (found := _WORD_END.fullmatch(pretoken)) and found[2][0] in marks:
        return found[1], found[2]
    return (pretoken,)


def pieces(pretoken: list[str], model: str) -> list[int]:
    """How many tokens each pre-token has inside a text."""
    processor = _processor(model)
    # The library puts a space before its input: one less is given, or a line feed, whose two tokens are taken off, where there is none.
    inputs = [p[1:] if p[0] == " " else "\n" + p if p != "\n" else "" for p in pretoken]
    counts = [len(ids) for ids in processor.encode(inputs, num_threads=1)]
    return [1 if p == "\n" or p == " " else n if p[0] == " " else n - 2 for p, n in zip(pretoken, counts, strict=True)]


def _split_counts(counts: Counter[str], marks: frozenset[str]) -> pa.RecordBatch:
    parts: Counter[str] = Counter()
    for pretoken, n in counts.items():
        for part in split(pretoken, marks):
            parts[part] += n
    return pa.RecordBatch.from_arrays([pa.array(parts.keys(), pa.string()), pa.array(parts.values(), pa.int64())], names=["pretoken", "n"])


def vocabulary(docs: DataFrame, text_col: str = "text", model: str | None = None) -> DataFrame:
    """(pretoken, n, pieces) of every distinct pre-token: its frequency in all texts and its count of tokens."""
    model = model or default_model()

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(pretokens(text.as_py()))
                if len(counts) > FLUSH_ROWS:
                    yield _split_counts(counts, apart(model))
                    counts = Counter()
        yield _split_counts(counts, apart(model))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces(batch.column(0).to_pylist(), model), pa.int64())], names=["pretoken", "n", "pieces"])

    found = docs.select(F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(frequencies, "pretoken string, n long")
    return found.groupBy("pretoken").agg(F.sum("n").alias("n")).mapInArrow(counted, "pretoken string, n long, pieces long")


def _frequent(table: DataFrame) -> DataFrame:
    """The most frequent short pre-tokens, HEAD_ROWS at most: those from the smallest frequency on that no more have."""
    short = table.filter(F.octet_length("pretoken") <= HEAD_BYTES)
    sizes = short.groupBy(F.expr(bucket("n")).alias("bucket")).agg(F.count("*").alias("rows")).selectExpr(bucket_floor("bucket") + " AS low", "rows")
    least, total = None, 0
    for row in sorted(sizes.collect(), key=lambda r: -r["low"]):  # a few hundred buckets
        total += row["rows"]
        if total > HEAD_ROWS:
            break
        least = row["low"]
    return short.filter(F.lit(False) if least is None else F.col("n") >= least)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of docs."""
    model = model or default_model()
    # A compressed table takes a third of a checkpoint's space.
    vocabulary(docs, text_col, model).write.parquet(path := scratch(docs.sparkSession, "vocabulary"))
    table = docs.sparkSession.read.parquet(path)
    frequent = _frequent(table)
    head = docs.sparkSession.sparkContext.broadcast({r["pretoken"]: r["pieces"] for r in frequent.select("pretoken", "pieces").collect()})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per text with the sum over its frequent pre-tokens, and one per other pre-token of it."""
        known, marks = head.value, apart(model)
        for batch in batches:
            keys, checks, totals, missing, n_missing = [], [], [], [], []
            for digest, check, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                total, rare = 0, Counter()
                for pretoken, n in Counter(pretokens(text.as_py())).items():
                    if (count := known.get(pretoken)) is not None:
                        total += n * count
                        continue
                    for part in split(pretoken, marks):
                        if (count := known.get(part)) is not None:
                            total += n * count
                        else:
                            rare[part] += n
                # The text's own row has a key of its own that no pre-token is, so that the join spreads such rows.
                keys += [digest] * (1 + len(rare))
                checks += [check] * (1 + len(rare))
                totals += [total] + [0] * len(rare)
                missing += [f"\n{digest}", *rare]
                n_missing += [0, *rare.values()]
                if len(keys) > 100_000:
                    yield _batch(keys, checks, totals, missing, n_missing)
                    keys, checks, totals, missing, n_missing = [], [], [], [], []
            yield _batch(keys, checks, totals, missing, n_missing)

    text = F.coalesce(text_col, F.lit(""))
    # 96 bits of hash tell rows apart.
    key = [F.xxhash64(F.octet_length(text), text, F.col(id_col)).alias("row"), F.hash(text, F.col(id_col)).alias("check")]
    rows = docs.select(*key, text.alias("text"))
    joined = rows.mapInArrow(summed, "row long, check int, total long, pretoken string, n long").join(table.select("pretoken", "pieces"), "pretoken", "left")
    own = F.when(F.col("n") == 0, 1).otherwise(0)
    # Equal rows have one key and were summed together: each has its share.
    per_row = joined.groupBy("row", "check").agg(F.sum(F.col("total") + F.col("n") * F.coalesce("pieces", F.lit(0))).alias("total"), F.sum(own).alias("copies")).selectExpr("row", "check", "total div copies AS n_tokens")
    named = docs.select(*key, F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"))
    return named.join(per_row, ["row", "check"]).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _batch(keys: list[int], checks: list[int], totals: list[int], missing: list[str], n_missing: list[int]) -> pa.RecordBatch:
    arrays = [pa.array(keys, pa.int64()), pa.array(checks, pa.int32()), pa.array(totals, pa.int64()), pa.array(missing, pa.string()), pa.array(n_missing, pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, names=["row", "check", "total", "pretoken", "n"])
