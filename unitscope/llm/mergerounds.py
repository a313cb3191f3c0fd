"""BPE encoding and decoding in batched numpy merge rounds, for models with word ends.

The symbols of many distinct words lie in one flat array. In each round the ranks of all pairs of neighbours are found by
binary search of left * size + right in the sorted keys of the model's merges, and every word merges its pair of the lowest
rank wherever it stands in the word, from the left. That is what merging one pair at a time gives, provided that no pair
holding a new symbol ranks before the merge that makes the symbol; `_Model` verifies this of the model.

In a word of more than LONG symbols a pair is also merged where no pair of a lower rank stands within `reach` symbols
on either side (the longest piece of the vocabulary, in symbols): a symbol formed by merges that come before it is no longer than
`reach`, and so cannot get to it from outside. Runs of overlapping equal pairs ("aaaa") are merged once all pairs of the run may
be. So a long word needs hundreds of rounds, not one for each of its ranks.

Texts are split where the model's normaliser and pre-tokeniser (the library's) split as well, and each distinct chunk of a run of
rows is encoded once; a task keeps the ids of the first KEPT chunks of CHUNK_BYTES at most. Special
strings in a text become their ids, as the library's default does. Decoding sets a space between the pieces of ids.

Null and empty texts have no ids and decode to an empty text. Repeated rows are encoded alike, and ids of rows may have any type.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

#: Symbols of a word from which on pairs are also merged out of turn.
LONG = 256
KEPT, CHUNK_BYTES = 400_000, 64
#: Symbols that merge rounds hold at once; a longer word is a batch of its own.
FLAT = 1 << 20
_NONE = np.iinfo(np.int64).max
_MARKS, _APART = r"!-/:-@\[-`{-~", r" \n\r\t"
#: Where texts are split before the model's own rules, which split there too: at white space and, in texts without special strings, after Latin letters and digits before an ASCII mark.
_COARSE = re.compile(f"[^{_APART}]+")
_CHUNK = re.compile(rf"[{_MARKS}]*+[0-9A-Za-zÀ-ÖØ-öø-ÿ]++(?=[{_MARKS}{_APART}]|\Z)|[^{_APART}]+")
#: What the splits rest on: neither may be joined to what stands beside it, and letters must be split from marks as they are here.
_PROBE = ("ab,cd e1.f é!g'h", ["ab", ",", "cd", "e", "1", ".", "f", "Ã©", "!", "g", "'", "h"])


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Model:
    """What encoding needs of a tokenizers file: a BPE model with end_of_word_suffix, without dropout, unknown tokens or byte fallback."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, self.library = spec["model"], Tokenizer.from_file(path)
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd or spec.get("post_processor") or spec.get("decoder"):
            raise ValueError(f"{path} is not a plain BPE model: {odd}")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens that are not matched as they stand")
        vocabulary: dict[str, int] = model["vocab"]
        if [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(_PROBE[0])] != _PROBE[1] or self.library.normalizer.normalize_str("Ab\n\tÉ") not in ("ab é", "ab\n\té"):
            raise ValueError(f"{path} normalises or splits otherwise than this operator does")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.size = max([*vocabulary.values(), *self.special.values()]) + 1
        self.pieces = np.full(self.size, "", object)
        for piece, i in (vocabulary | self.special).items():
            self.pieces[i] = piece
        self.end = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = {a + b: rank for rank, (a, b) in enumerate(pairs)}
        for rank, (left, right) in enumerate(pairs):
            if max(made.get(left, -1), made.get(right, -1)) >= rank or made[left + right] != rank:
                raise ValueError(f"merge {rank} of {path} comes before a merge that makes its parts, or another makes the same; words cannot be merged in rounds")
        left, right, into = (np.array([vocabulary[p] for p in side], np.int64) for side in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        keys = left * self.size + right
        order = np.argsort(keys)
        # A key above all others, so that every search ends at an entry.
        self.keys, self.ranks, self.into = np.append(keys[order], _NONE), np.append(order, _NONE), into
        #: Ids of letters by code point, inside and at the end of a word; -1 where the model has none.
        self.letters = np.full((2, 0x200), -1, np.int64)
        for piece, i in vocabulary.items():
            for k, letter in enumerate((piece, piece.removesuffix(self.end))):
                if len(letter) == 1 and ord(letter) < 0x200 and (k == 0 or not self.end or piece != letter):
                    self.letters[k, ord(letter)] = i
        self.reach = max((len(p.removesuffix(self.end)) for p in vocabulary), default=1)

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all letters of pre-tokens, the last of each as a word's end, and how many each has. Letters that the model lacks are left out, as the library does."""
        letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        sizes = np.array([len(w) for w in words], np.int64)
        last = np.zeros(len(letters), np.int64)
        last[np.cumsum(sizes) - 1] = 1
        ids = np.where(letters < 0x200, self.letters[last, np.minimum(letters, 0x1FF)], -1)
        return ids[ids >= 0], np.add.reduceat(ids >= 0, np.cumsum(sizes) - sizes, dtype=np.int64)

    def ranked(self, symbols: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The rank of each symbol's pair with its right neighbour; none at a word's end."""
        pair = symbols[:-1] * self.size + symbols[1:]
        at = np.searchsorted(self.keys, pair)
        ranks = np.append(np.where(self.keys[at] == pair, self.ranks[at], _NONE), _NONE)
        ranks[last] = _NONE
        return ranks


@lru_cache(maxsize=2)
def _model(path: str) -> _Model:
    return _Model(path)


def _least_around(ranks: np.ndarray, reach: int) -> np.ndarray:
    """The least of the ranks within `reach` places on either side."""
    padded = np.concatenate([np.full(reach, _NONE), ranks, np.full(reach, _NONE)])
    width, want = 1, 2 * reach + 1
    while 2 * width <= want:
        padded = np.minimum(padded[: len(padded) - width], padded[width:])
        width *= 2
    return np.minimum(padded[: len(ranks)], padded[want - width : want - width + len(ranks)])


def merged(model: _Model, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and sizes of words, one after the other, once no pair of theirs can be merged."""
    word = np.repeat(np.arange(len(sizes)), sizes)
    done_symbols: list[np.ndarray] = []
    done_words: list[np.ndarray] = []
    while len(symbols):
        last = np.append(word[1:] != word[:-1], True)
        ranks = model.ranked(symbols, last)
        starts = np.flatnonzero(np.append(True, last[:-1]))
        lengths = np.diff(np.append(starts, len(symbols)))
        least = np.minimum.reduceat(ranks, starts)
        open_ = np.repeat(least < _NONE, lengths)
        if not open_.all():
            # Words without a pair leave the array.
            done_symbols.append(symbols[~open_])
            done_words.append(word[~open_])
            symbols, word, ranks = symbols[open_], word[open_], ranks[open_]
            least, lengths = least[least < _NONE], lengths[least < _NONE]
            if not len(symbols):
                break
        limit = np.repeat(least, lengths)
        if lengths.max() > LONG:
            limit = np.where(np.repeat(lengths > LONG, lengths), np.maximum(limit, _least_around(ranks, model.reach)), limit)
        may = (ranks == limit) & (ranks < _NONE)
        # Runs of overlapping pairs of one rank: every second one is merged, from the left, once all of the run may be.
        at = np.flatnonzero(ranks < _NONE)
        fresh = np.append(True, (np.diff(at) > 1) | (ranks[at[1:]] != ranks[at[:-1]]))
        first = np.flatnonzero(fresh)
        run = np.cumsum(fresh) - 1
        all_may = np.logical_and.reduceat(may[at], first)
        chosen = at[all_may[run] & ((np.arange(len(at)) - first[run]) % 2 == 0)]
        symbols[chosen] = model.into[ranks[chosen]]
        stays = np.ones(len(symbols), bool)
        stays[chosen + 1] = False
        symbols, word = symbols[stays], word[stays]
    if not done_symbols:
        return symbols, np.zeros(len(sizes), np.int64)
    word = np.concatenate(done_words)
    order = np.argsort(word, kind="stable")
    return np.concatenate(done_symbols)[order], np.bincount(word, minlength=len(sizes))


def _pretokens(model: _Model, chunk: str) -> list[str | int]:
    """The pre-tokens of a chunk of text, and the ids of special strings."""
    if chunk.isascii() and chunk.isalpha():
        return [chunk.lower()]
    out: list[str | int] = []
    for part in model.cut.split(chunk) if model.cut else [chunk]:
        if part in model.special:
            out.append(model.special[part])
        elif part:
            normal = model.library.normalizer.normalize_str(part) if model.library.normalizer else part
            out += [w for w, _ in model.library.pre_tokenizer.pre_tokenize_str(normal)]
    return out


def encode_words(model: _Model, words: list[str]) -> list[bytes]:
    """The ids of each pre-token as little-endian unsigned 32-bit integers, in batches of about FLAT symbols."""
    out: list[bytes] = []
    first = 0
    while first < len(words):
        end = first + 1
        total = len(words[first])
        while end < len(words) and total + len(words[end]) <= FLAT:
            total += len(words[end])
            end += 1
        symbols, sizes = model.symbols(words[first:end])
        symbols, sizes[sizes > 0] = merged(model, symbols, sizes[sizes > 0])
        flat, ends = symbols.astype("<u4").tobytes(), [0, *(4 * np.cumsum(sizes)).tolist()]
        out += [flat[a:b] for a, b in pairwise(ends)]
        first = end
    return out


def _encode_chunks(model: _Model, chunks: list[str]) -> dict[str, bytes]:
    """The ids of distinct chunks."""
    parts = [_pretokens(model, c) for c in chunks]
    words = list(dict.fromkeys(w for own in parts for w in own if isinstance(w, str)))
    ids: dict[str | int, bytes] = dict(zip(words, encode_words(model, words), strict=True))
    ids |= {i: i.to_bytes(4, "little") for i in model.special.values()}
    return {c: b"".join(map(ids.__getitem__, own)) for c, own in zip(chunks, parts, strict=True)}


def _runs(texts: pa.Array) -> Iterator[list[str]]:
    """Runs of texts of about FLAT characters; a longer text is a run of its own."""
    run: list[str] = []
    size = 0
    for value in texts:
        text = value.as_py() or ""
        if run and size + len(text) > FLAT:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


def _id_bytes(model: _Model, texts: pa.Array, kept: dict[str, bytes]) -> Iterator[bytes]:
    """The ids of each text; kept: ids of short chunks, which it adds to until it is full."""
    for run in _runs(texts):
        chunks = [(_COARSE if model.cut and model.cut.search(text) else _CHUNK).findall(text) for text in run]
        made = _encode_chunks(model, list(set(chain.from_iterable(chunks)).difference(kept)))
        kept |= made
        for own in chunks:
            yield b"".join(map(kept.__getitem__, own))
        for c in made:
            if len(kept) > KEPT or len(c) > CHUNK_BYTES:
                del kept[c]


def _by_text(docs: DataFrame, id_col: str, text_col: str, model: str | None, columns: str, row) -> DataFrame:
    """One row per row of docs: its id and what row(model, id bytes) gives."""
    model = model or default_model()
    fields = StructType.fromDDL(columns).fields
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded, kept = _model(model), {}
        for batch in batches:
            made = [row(loaded, ids) for ids in _id_bytes(loaded, batch.column(1), kept)]
            values = [pa.array([m[k] for m in made], _ARROW[type(f.dataType)]) for k, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *values], names=["doc_id", *(f.name for f in fields)])

    return rows.mapInArrow(each, StructType([rows.schema["doc_id"], *fields]))


_ARROW = {LongType: pa.int64(), StringType: pa.string(), ArrayType: pa.list_(pa.int32())}


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """(doc_id, token_ids) per row of docs."""
    return _by_text(docs, id_col, text_col, model, "token_ids array<int>", lambda _, ids: (np.frombuffer(ids, "<u4").astype(np.int32),))


def decoded_text(model: _Model, ids: np.ndarray) -> str:
    """The pieces of ids with spaces between them; ids that the model does not have are left out."""
    known = ids[(ids >= 0) & (ids < model.size)] if len(ids) and (ids.min() < 0 or ids.max() >= model.size) else ids
    return " ".join(filter(None, model.pieces[known].tolist()))


def decoded(tokens: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, token_ids); null ids decode to an empty text."""
    model = model or default_model()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = _model(model)
        for batch in batches:
            texts = [decoded_text(loaded, np.array([i for i in ids.as_py() or [] if i is not None], np.int64)) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = tokens.select("doc_id", F.col("token_ids").cast(ArrayType(IntegerType())))
    return rows.mapInArrow(each, StructType([rows.schema["doc_id"], StructField("text", StringType())]))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row of docs: both ways in one task, so that no ids are moved."""

    def row(loaded: _Model, ids: bytes) -> tuple[int, str, str]:
        text = decoded_text(loaded, np.frombuffer(ids, "<u4"))
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    return _by_text(docs, id_col, text_col, model, "n_tokens long, ids_sha256 string, decoded_sha256 string", row)
