"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text's segmentation is the one with the best sum of piece scores. No piece of the model crosses
from a word into the next word's space mark or from a letter to the marks after it (see tokencount),
so each distinct marked word of a batch is segmented once. The distinct words are sorted, which walks
their trie depth-first: a word keeps the forward scores of the prefix that it shares with the word
before it and only computes the rest. Segmented words are kept for later batches of a task, up to
MEMO_WORDS; after that they are forgotten and computed anew where they occur.

A unigram model's pieces have its own scores, and a character outside all pieces costs UNKNOWN_UNIGRAM
more than the worst of them, as in the library. The one public model is a BPE model, whose scores are ranks
and not log-probabilities. A piece's score then is that of a Zipf law over its rank, -round(64 * log2(2 + rank));
whole numbers make sums exact; an unknown character costs UNKNOWN_COST more than the worst piece. Such ids
decode to their texts but are not those that the library gives with that model. An unknown character becomes
its UTF-8 bytes. Decoding joins pieces and bytes again; it returns the text itself, save that a literal
mark U+2581 comes back as a space.

Null texts have null ids, empty ones none; null ids decode to null. Repeated rows are treated alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from math import log2

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from unitscope.llm.tokencount import _processor, apart, default_model, pretokens, split

UNKNOWN_COST = 640
UNKNOWN_UNIGRAM = 10
SLICE = 1 << 20
MEMO_WORDS = 300_000
_MARK = "▁"


def _is_unigram(model: str) -> bool:
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(model, "rb") as file:
        proto.ParseFromString(file.read())
    return proto.trainer_spec.model_type == proto.trainer_spec.UNIGRAM


class Pieces:
    """Pieces of a model, with spaces for its marks: ids and scores by string, and bytes by id."""

    def __init__(self, model: str) -> None:
        processor, own_scores = _processor(model), _is_unigram(model)
        self.scores: dict[str, tuple[float, int]] = {}
        bytes_of: list[bytes] = []
        first = None
        for i in range(processor.get_piece_size()):
            piece = processor.id_to_piece(i).replace(_MARK, " ")
            if processor.is_byte(i):
                bytes_of.append(bytes([int(piece[1:-1], 16)]))
            elif processor.is_control(i) or processor.is_unknown(i):
                bytes_of.append(b"")
            else:
                first = i if first is None else first
                self.scores[piece] = (processor.get_score(i) if own_scores else -round(64 * log2(2 + i - first)), i)
                bytes_of.append(piece.encode())
        self.byte_ids = {b[0]: i for i, b in reversed(list(enumerate(bytes_of))) if processor.is_byte(i)}
        self.unknown = min(score for score, _ in self.scores.values()) - (UNKNOWN_UNIGRAM if own_scores else UNKNOWN_COST)
        # All ends of pieces: a search backwards from a place stops at the first string that ends no piece.
        self.ends: dict[str, tuple[float, int] | None] = {piece[k:]: None for piece in self.scores for k in range(len(piece))}
        self.ends |= self.scores
        self.flat = np.frombuffer(b"".join(bytes_of), np.uint8)
        self.sizes = np.array([len(b) for b in bytes_of], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def segment(self, words: list[str]) -> list[list[int]]:
        """Ids of each of the sorted distinct words."""
        out: list[list[int]] = []
        best, back = [0], [(0, None)]  # per end of a prefix: its score, and where its last piece starts and which it is
        before, known_end, unknown = "", self.ends.get, self.unknown
        for word in words:
            shared = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :], back[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                # Equal sums keep the earlier start. Without a piece, the last character is unknown.
                top, step = None, None
                for start in range(end - 1, -1, -1):
                    known = known_end(word[start:end], 0)
                    if known:
                        total = best[start] + known[0]
                        if top is None or total >= top:
                            top, step = total, (start, known[1])
                    elif known == 0:
                        break
                if (top is None or best[end - 1] + unknown > top) and word[end - 1] not in self.scores:
                    top, step = best[end - 1] + unknown, (end - 1, None)
                best.append(top)
                back.append(step)
            ids, at = [], len(word)
            while at:
                start, piece = back[at]
                if piece is None:
                    ids += [self.byte_ids[b] for b in reversed(word[start:at].encode())]
                else:
                    ids.append(piece)
                at = start
            ids.reverse()
            out.append(ids)
            before = word
        return out

    def texts(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts of stretches of ids, without the space that stands before a text."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        data = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[ids] - (ends - sizes), sizes)].tobytes()
        cuts = np.concatenate([[0], ends])[bounds]
        return [data[low + (data[low : low + 1] == b" " and low < high) : high].decode("utf-8", "replace") for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


@lru_cache(maxsize=2)
def pieces_of(model: str) -> Pieces:
    return Pieces(model)


class Encoder:
    """Encodes batches of texts, with the segmented words of earlier batches."""

    def __init__(self, model: str) -> None:
        self.pieces, self.marks = pieces_of(model), apart(model)
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.starts = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]

    def _learn(self, words: set[str]) -> None:
        """Segments the distinct pre-tokens that are not yet known."""
        new = sorted(words - self.place.keys())
        if not new:
            return
        parts = [split(pretoken, self.marks) for pretoken in new]
        marked = sorted(set(chain.from_iterable(parts)))
        segmented = dict(zip(marked, self.pieces.segment(marked), strict=True))
        lists = [segmented[own[0]] if len(own) == 1 else segmented[own[0]] + segmented[own[1]] for own in parts]
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
        ends = np.cumsum([len(x) for x in lists]) + self.starts[-1][-1]
        self.ids.append(np.fromiter(chain.from_iterable(lists), np.int32, ends[-1] - self.starts[-1][-1]))
        self.starts.append(ends)

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        words = [pretokens(text) if text else [] for text in texts]
        if len(self.place) > MEMO_WORDS:
            self._forget()
        self._learn(set(chain.from_iterable(words)))
        starts, flat = np.concatenate(self.starts), np.concatenate(self.ids)
        self.ids, self.starts = [flat], [starts]
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(words)), np.int64)
        sizes = (starts[at + 1] - starts[at]) if len(at) else np.zeros(0, np.int64)
        ends = np.cumsum(sizes)
        # Word by word, the stretch of flat ids that it owns.
        index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[at] - (ends - sizes), sizes) if len(at) else np.zeros(0, np.int64)
        per_text = np.concatenate([[0], np.cumsum([len(own) for own in words])]).astype(np.int64)
        bounds = np.concatenate([[0], ends])[per_text].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat[index]), mask=pa.array([text is None for text in texts]))


def _slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose values of a text or list column have about `most` bytes or items; a longer one is a run of its own."""
    sizes = np.array(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)) if pa.types.is_string(batch.column(column).type) else pa.compute.list_value_length(batch.column(column)), 0), np.int64)
    group = np.cumsum(sizes) // most
    for start, end in zip(edges := [0, *np.flatnonzero(np.diff(group)) + 1], [*edges[1:], batch.num_rows], strict=True):
        if end > start:
            yield batch.slice(start, end - start)


def encoded(docs: DataFrame, text_col: str = "text", ids_col: str = "token_ids", model: str | None = None) -> DataFrame:
    """docs with the ids of each text, in place of a column of that name if there is one."""
    model = model or default_model()
    docs = docs.drop(ids_col)
    column, names = docs.columns.index(text_col), [*docs.columns, ids_col]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for batch in batches:
            for part in _slices(batch, column, SLICE):
                yield pa.RecordBatch.from_arrays([*part.columns, encoder.encode(part.column(column).to_pylist())], names=names)

    return docs.mapInArrow(encode, docs.select("*", F.lit(None).cast("array<int>").alias(ids_col)).schema)


def decoded(docs: DataFrame, ids_col: str = "token_ids", text_col: str = "decoded", model: str | None = None) -> DataFrame:
    """docs with the text of each list of ids, in place of a column of that name if there is one."""
    model = model or default_model()
    docs = docs.drop(text_col)
    column, names = docs.columns.index(ids_col), [*docs.columns, text_col]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        for batch in batches:
            for part in _slices(batch, column, SLICE):
                lists = part.column(column)
                bounds = np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(lists), 0))]).astype(np.int64)
                texts = pieces.texts(lists.flatten().to_numpy(zero_copy_only=False), bounds)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string(), mask=lists.is_null().to_numpy(zero_copy_only=False))], names=names)

    return docs.mapInArrow(decode, docs.select("*", F.lit(None).cast("string").alias(text_col)).schema)


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """(doc_id, token_ids, n_tokens, round_trip) per row of docs; round_trip says whether the ids decode to the text. Both ways are gone in one task, so that ids and texts need not be moved in between."""
    model = model or default_model()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = StructType([rows.schema["doc_id"], *StructType.fromDDL("token_ids array<int>, n_tokens long, round_trip boolean")])

    def both_ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for batch in batches:
            for part in _slices(batch, 1, SLICE):
                texts = part.column(1).to_pylist()
                ids = encoder.encode(texts)
                back = encoder.pieces.texts(ids.values.to_numpy(), ids.offsets.to_numpy())
                same = [text is None or text.replace(_MARK, " ") == own for text, own in zip(texts, back, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(np.diff(ids.offsets.to_numpy()).astype(np.int64)), pa.array(same, pa.bool_())], names=schema.names)

    return rows.mapInArrow(both_ways, schema)
