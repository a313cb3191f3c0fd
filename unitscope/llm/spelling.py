"""Groups of spelling variants: Bloom-guided neighbourhoods of a vocabulary.

Words that differ by one inserted, deleted or replaced letter are near. Each word's deletions, and its replacements by a
later letter of the vocabulary's alphabet, are generated as hashes only, in numpy: a word's hash is a polynomial over its
letters, so that an edit's hash follows from the word's prefix sums in a step. Edits are probed against blocked Bloom filters of the
vocabulary, one to each length; only those that a filter lets pass are shuffled, as a few numbers, to an exact join with
the vocabulary by hash, after which the edited word itself is compared. (Insertions are the deletions of the other word,
replacements by an earlier letter those of the other word by a later one.)

The filters are built from bits that tasks have merged, and are sent to every task: 16 bits to a word, FILTER_BYTES at most. A larger vocabulary is
cut by hash into slices, each with filters of its own, and edits are generated once for each slice; so the size of
what is sent is bounded, and the share of edits that pass in error (about one in a thousand) does not grow.

A word's form is its near word of the largest count, of equal ones the first in code-point order, if that count is at
least RATIO times the word's own. Forms are followed by pointer doubling: counts double at every step, so paths are short.

Null and empty texts have no words; repeated rows count each; a null id counts as an empty one where words are damaged; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from unitscope.llm.durable import durable
from unitscope.llm.wordhash import mix, seeds

#: Runs of Latin letters of one byte's code points.
RUN = r"[A-Za-zÀ-ÿ]+"
LEAST_LETTERS, LEAST_COUNT, RATIO = 5, 3, 2
FILTER_BYTES = 32 << 20
WORD_BITS, BLOCK_BITS = 16, 512
#: Letters whose edits are hashed at once.
LETTERS_AT_ONCE = 1 << 14
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BASE = 0x9E3779B97F4A7C15
_LETTER, _LENGTH, _SALT = seeds(256, 21), seeds(1, 22)[0], seeds(8, 23)


def damaged(run: Column, id_col: Column, one_in: int) -> Column:
    """The run without one letter, in one of so many runs, by the checksum of id and run."""
    h = F.crc32(F.encode(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), run), "UTF-8"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int | None = None) -> DataFrame:
    """(word, n): the words of LEAST_LETTERS letters at least that stand LEAST_COUNT times at least in all texts, A-Z as a-z."""
    runs = F.regexp_extract_all(F.translate(F.col(text_col), _UPPER, _LOWER), F.lit(RUN), F.lit(0))
    found = docs.select(F.col(id_col).alias("id"), F.explode(runs).alias("run"))
    words = found.select((damaged(F.col("run"), F.col("id"), one_in) if one_in else F.col("run")).alias("word"))
    return words.filter(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


class _Letters:
    """The letters of many words in one array, and what edits' hashes need of them."""

    def __init__(self, words: list[str]) -> None:
        self.codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.word = np.repeat(np.arange(len(words)), self.sizes)
        self.place = np.arange(len(self.codes)) - self.starts[self.word]
        longest = int(self.sizes.max(initial=0))
        steps = np.full((2, longest + 1), 1, np.uint64)
        steps[0, 1:], steps[1, 1:] = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
        self.power = np.multiply.accumulate(steps[0])[self.place] if longest else np.zeros(0, np.uint64)
        self.back = steps[1, -1]
        total = np.zeros(len(self.codes) + 1, np.uint64)
        np.cumsum(_LETTER[self.codes & 255] * self.power, out=total[1:])
        self.before = total[:-1] - total[self.starts[self.word]]
        self.whole = total[self.starts + self.sizes] - total[self.starts]

    @staticmethod
    def key(polynomial: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return mix(polynomial + sizes.astype(np.uint64) * _LENGTH)

    def keys(self) -> np.ndarray:
        return self.key(self.whole, self.sizes)

    def deletions(self) -> tuple[np.ndarray, np.ndarray]:
        """Places in the array, without those that give the same word as the place before, and the keys of the words without them."""
        same = np.zeros(len(self.codes), bool)
        same[1:] = (self.codes[1:] == self.codes[:-1]) & (self.word[1:] == self.word[:-1])
        at = np.flatnonzero(~same)
        after = self.whole[self.word[at]] - self.before[at] - _LETTER[self.codes[at] & 255] * self.power[at]
        return at, self.key(self.before[at] + after * self.back, self.sizes[self.word[at]] - 1)

    def replacements(self, start: int, end: int, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places from start to end, letters of the alphabet that come after the one there, and the keys of the words with them."""
        row, letter = np.nonzero(alphabet[None, :] > self.codes[start:end, None])
        at, new = row + start, alphabet[letter]
        moved = (_LETTER[new] - _LETTER[self.codes[at] & 255]) * self.power[at]
        return at, new, self.key(self.whole[self.word[at]] + moved, self.sizes[self.word[at]])


class _Filters:
    """Blocks of 8 words of 64 bits for the keys of a slice, those of one length side by side."""

    def __init__(self, counts: dict[int, int], slices: int, k: int) -> None:
        self.slices, self.k = np.uint64(slices), np.uint64(k)
        self.sizes = np.array(sorted(counts), np.int64)
        self.blocks = np.array([-(-counts[size] * WORD_BITS // (BLOCK_BITS * slices)) for size in sorted(counts)], np.uint64)
        self.first = (np.cumsum(self.blocks) - self.blocks).astype(np.uint64)
        self.bits = np.zeros((int(self.blocks.sum()), 8), np.uint64)

    def mine(self, keys: np.ndarray) -> np.ndarray:
        """Whether keys belong to this slice, by bits that nothing else takes."""
        return (keys >> np.uint64(8)) % self.slices == self.k if self.slices > 1 else np.ones(len(keys), bool)

    def block(self, keys: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """The block of each key among those of its length."""
        return (self.first[shard] + ((keys >> np.uint64(32)) * self.blocks[shard] >> np.uint64(32))).astype(np.int64)

    @staticmethod
    def bit(keys: np.ndarray, j: int) -> np.ndarray:
        return np.uint64(1) << ((keys * _SALT[j]) >> np.uint64(58))

    def passed(self, keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Places of the keys that may be in the vocabulary."""
        shard = np.minimum(np.searchsorted(self.sizes, sizes), len(self.sizes) - 1)
        at = np.flatnonzero((self.sizes[shard] == sizes) & self.mine(keys))
        block = self.block(keys[at], shard[at])
        for j in range(8):
            held = (self.bits[block, j] & self.bit(keys[at], j)) != 0
            at, block = at[held], block[held]
        return at


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, _Letters]]:
    """Runs of rows of a batch whose second column's words have about LETTERS_AT_ONCE letters, or one word."""
    words = batch.column(1).to_pylist()
    first = 0
    while first < len(words):
        end, total = first + 1, len(words[first])
        while end < len(words) and total + len(words[end]) <= LETTERS_AT_ONCE:
            total += len(words[end])
            end += 1
        yield first, end, _Letters(words[first:end])
        first = end


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [run.keys() for _, _, run in _runs(batch)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(keys or [np.zeros(0, np.uint64)]).view(np.int64))], names=[*batch.schema.names, "key"])


def _filters(table: DataFrame, counts: dict[int, int], slices: int, k: int) -> _Filters:
    """The filters of one slice of the table; its bits are merged in tasks, then by block, and FILTER_BYTES reach the driver at most."""
    empty = _Filters(counts, slices, k)
    names = [f"w{j}" for j in range(8)]

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(1).to_numpy(zero_copy_only=False)
            own = empty.mine(keys)
            keys, sizes = keys[own], sizes[own]
            block = empty.block(keys, np.searchsorted(empty.sizes, sizes))
            order = np.argsort(block, kind="stable")
            every, first = np.unique(block[order], return_index=True)
            merged = [np.bitwise_or.reduceat(empty.bit(keys[order], j), first).view(np.int64) if len(every) else np.zeros(0, np.int64) for j in range(8)]
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.int64()), *map(pa.array, merged)], names=["block", *names])

    schema = ", ".join(f"{c} long" for c in ["block", *names])
    rows = table.select("key", F.length("word").alias("size")).mapInArrow(bits, schema)
    merged = rows.groupBy("block").agg(*(F.bit_or(c).alias(c) for c in names)).toArrow()
    blocks = merged["block"].to_numpy()
    for j, c in enumerate(names):
        empty.bits[blocks, j] = merged[c].to_numpy().view(np.uint64)
    return empty


def near_words(table: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(a, b): the pairs of ids of near words of the stored table (id, word, n, key), each pair once."""
    spark = table.sparkSession
    counts = {r["size"]: r["count"] for r in table.groupBy(F.length("word").alias("size")).count().collect()}  # one row to each length
    letters = [r["c"] for r in table.select(F.explode(F.split("word", "")).alias("c")).filter("c <> ''").distinct().collect()]  # at most 90
    alphabet = np.array(sorted(map(ord, letters)), np.int64)
    # Rounded up for each length; lengths with few words share slices.
    slices = max(1, -(-sum(counts.values()) * WORD_BITS // (8 * filter_bytes)))
    found = None
    for k in range(slices):
        sent = spark.sparkContext.broadcast(_filters(table, counts, slices, k))

        def positives(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            filters = sent.value
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                for first, _, run in _runs(batch):
                    at, keys = run.deletions()
                    edits = [(at, np.zeros(len(at), np.int64), keys, run.sizes[run.word[at]] - 1)]
                    for start in range(0, len(run.codes), LETTERS_AT_ONCE):
                        at, new, keys = run.replacements(start, min(start + LETTERS_AT_ONCE, len(run.codes)), alphabet)
                        edits.append((at, new, keys, run.sizes[run.word[at]]))
                        for at, new, keys, sizes in edits:
                            passed = filters.passed(keys, sizes)
                            at = at[passed]
                            columns = [ids[first + run.word[at]], run.place[at], new[passed], keys[passed].view(np.int64), sizes[passed]]
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["id", "place", "letter", "key", "size"])
                        edits = []

        passed = durable(table.select("id", "word").mapInArrow(positives, "id long, place long, letter long, key long, size long"))
        sent.unpersist()
        found = passed if found is None else found.unionByName(passed)
    other = table.select(F.col("id").alias("b"), F.col("word").alias("other"), "key", F.length("word").cast("long").alias("size"))
    met = found.join(other, ["key", "size"]).join(table.select("id", "word"), "id")
    place = F.col("place").cast("int")
    edited = F.concat(F.substring("word", F.lit(1), place), F.when(F.col("letter") > 0, F.expr("chr(letter)")).otherwise(""), F.substring("word", place + 2, F.length("word")))
    return met.filter(edited == F.col("other")).select(F.col("id").alias("a"), "b")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words of forms (word, form)."""
    roots, changed = durable(forms.select("word", F.col("form").alias("root"))), 1
    while changed:
        seen = Observation()
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        roots = durable(moved.observe(seen, F.count_if("moved").alias("n"))).drop("moved")
        changed = seen.get["n"]
    return roots


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int | None = None, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary: its form, the last form that forms lead to, or itself, and counts."""
    words = vocabulary(docs, id_col, text_col, one_in).withColumn("id", F.monotonically_increasing_id())
    table = durable(words.select("id", "word", "n").mapInArrow(_keyed, "id long, word string, n long, key long"))
    pairs = near_words(table, filter_bytes)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    named = both.join(table.select(F.col("id").alias("b"), F.struct((-F.col("n")).alias("less"), "word").alias("near")), "b")
    best = named.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n_near"), F.min("near").alias("best"))
    top_n, top = -F.col("best")["less"], F.col("best")["word"]
    able = top_n >= RATIO * F.col("n")
    judged = table.join(best, "id", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(able, top).alias("form"), F.when(able, top_n).alias("form_n"))
    judged = durable(judged)
    roots = _roots(judged.filter("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
