"""Benchmark decontamination by greedy string tiling.

Words are runs of digits, letters and non-ASCII characters in lower case, so case, punctuation and
line breaks do not matter. Runs of MATCH_WORDS words are seeds: a join of the documents' seeds with those
of the benchmark's items gives (document, item) candidates, and where the item's words under shared seeds
could reach the coverage, the two are tiled: the longest common runs of words not yet marked are found by
Karp-Rabin hashes of a running length, marked on both sides, and so on down to MATCH_WORDS. The share of
the item's words under tiles is its coverage, which does not depend on the order in which the document
has the passages. An item is found from COVERAGE on. An item of fewer than MATCH_WORDS words is one seed:
it is found in documents that have the same words and no others.

Before the join, documents drop the seeds that a bitmap of the benchmark's seeds, at most 2**MOST_BITS
bits, excludes; only documents that keep one leave their task, so the benchmark may be of any size and is
never held in one place, and what is moved is about what the two have in common.

Null, empty and blank texts and items are never found. Repeated documents are judged alike; repeated items
are separate items. Ids may be null, repeat and have any type; other columns are not looked at.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from unitscope.llm.durable import durable
from unitscope.llm.wordhash import chunks, shingles, words

MATCH_WORDS = 5
COVERAGE = 0.5
#: With so many bits to a seed, a run of words that is none passes with a chance of 6e-5, up to a million seeds; beyond that more runs pass, and are moved, and no result changes.
BITS_PER_SEED, MOST_BITS = 256, 28
#: Keys of found documents up to this number, 24 bytes each, are sent to the tasks that read the documents.
BROADCAST_ROWS = 200_000

_BASE = np.uint64(0xD6E8FEB86659FD93)
_BASE_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


class _Side:
    """Words with their marks, of which only those in common runs are kept; a gap between two runs is one marked word."""

    def __init__(self, tokens: np.ndarray, common: np.ndarray) -> None:
        at = np.flatnonzero(common)
        gaps = np.flatnonzero(np.diff(at) > 1) + 1
        self.at = np.insert(at, gaps, -1)  # place among all words
        self.free = self.at >= 0
        self.tokens = np.where(self.free, tokens[self.at], np.uint64(0))
        n = len(self.at)
        up, self.down = np.full(n + 1, _BASE), np.full(n + 1, _BASE_INVERSE)
        up[0] = self.down[0] = 1
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.tokens * np.multiply.accumulate(up)[:n], dtype=np.uint64)])
        self.down = np.multiply.accumulate(self.down)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Karp-Rabin hashes of the runs of `size` words without a marked one, and where they start."""
        marked = np.concatenate([[0], np.cumsum(~self.free)])
        at = np.flatnonzero(marked[size:] == marked[: len(marked) - size])
        return (self.total[at + size] - self.total[at]) * self.down[at], at


def _covered(places: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n words stand in a run of `size` words that starts at one of the places."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, places, 1)
    np.add.at(steps, np.minimum(places + size, n), -1)
    return np.cumsum(steps)[:n] > 0


def tiles(item: np.ndarray, text: np.ndarray, least: int = MATCH_WORDS) -> list[tuple[int, int, int]]:
    """(place in item, place in text, length) of the tiles, longest first; of tiles of one length the earliest places first.

    The longest common run is bracketed by hashes, so a round costs a few sorts of what is still common, and there are
    at most as many rounds as tiles have different lengths: about the root of twice the item's words."""
    if len(item) < least or len(text) < least:
        return [(0, 0, len(item))] if len(item) and np.array_equal(item, text) else []
    ours, theirs = (np.lib.stride_tricks.sliding_window_view(x, least) * np.multiply.accumulate(np.full(least, _BASE)) for x in (item, text))
    ours, theirs = ours.sum(axis=1, dtype=np.uint64), theirs.sum(axis=1, dtype=np.uint64)
    both = np.intersect1d(ours, theirs)
    a = _Side(item, _covered(np.flatnonzero(np.isin(ours, both)), least, len(item)))
    b = _Side(text, _covered(np.flatnonzero(np.isin(theirs, both)), least, len(text)))
    found: list[tuple[int, int, int]] = []
    most = min(len(a.at), len(b.at))

    def common(size: int) -> np.ndarray:
        return np.intersect1d(a.windows(size)[0], b.windows(size)[0])

    while most >= least and len(common(least)):
        low, high = least, least + 1
        while high <= most and len(common(high)):
            low, high = high, 2 * high
        high = min(high, most + 1)
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if len(common(middle)) else (low, middle)
        (own, at_a), (other, at_b) = a.windows(low), b.windows(low)
        shared = np.intersect1d(own, other)
        waiting: dict[int, list[int]] = defaultdict(list)
        for h, p in zip(own[hit := np.isin(own, shared)].tolist(), at_a[hit].tolist(), strict=True):
            waiting[h].append(p)
        for places in waiting.values():
            places.reverse()
        for h, t in zip(other[hit := np.isin(other, shared)].tolist(), at_b[hit].tolist(), strict=True):
            places = waiting[h]
            while places and not a.free[places[-1] : places[-1] + low].all():
                places.pop()
            if places and b.free[t : t + low].all() and np.array_equal(a.tokens[(p := places[-1]) : p + low], b.tokens[t : t + low]):
                a.free[p : p + low] = b.free[t : t + low] = False
                found.append((int(a.at[p]), int(b.at[t]), low))
                places.pop()
        most = low - 1
    return found


_ITEM = "words array<long>, seeds array<long>"


def _seeded(batches: Iterator[pa.RecordBatch], bits: tuple[int, np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
    """In place of the last column, a text, its words and its seeds; with bits only texts with a seed in them, and those seeds once."""
    for batch in batches:
        kept, names = batch.columns[:-1], [*batch.schema.names[:-1], "words", "seeds"]
        for first, end, data, offsets in chunks(batch.column(batch.num_columns - 1)):
            hashes, starts, _, _ = words(data, offsets, "alnum")
            runs, at = shingles(hashes, starts, MATCH_WORDS)
            if bits is None:
                rows, own_words, own_seeds = np.arange(end - first), hashes, runs
                ends_w, ends_s = starts, at
            else:
                hits = np.flatnonzero(_inside(runs, *bits))
                row_of = np.searchsorted(at, hits, "right") - 1
                # Each seed once per text.
                order = np.lexsort((runs[hits], row_of))
                row_of, own_seeds = row_of[order], runs[hits][order]
                new = np.ones(len(order), bool)
                new[1:] = (row_of[1:] != row_of[:-1]) | (own_seeds[1:] != own_seeds[:-1])
                row_of, own_seeds = row_of[new], own_seeds[new]
                rows, counts = np.unique(row_of, return_counts=True)
                sizes = np.diff(starts)[rows]
                own_words = np.concatenate([hashes[starts[r] : starts[r + 1]] for r in rows]) if len(rows) else hashes[:0]
                ends_w, ends_s = np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([[0], np.cumsum(counts)])
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.view(np.int64))) for ends, values in ((ends_w, own_words), (ends_s, own_seeds))]
            yield pa.RecordBatch.from_arrays([c.slice(first, end - first).take(pa.array(rows)) for c in kept] + lists, names=names)


def _inside(seeds: np.ndarray, n_bits: int, bitmap: np.ndarray) -> np.ndarray:
    """Whether both bits of each seed are set."""
    place = lambda shift: ((seeds >> np.uint64(shift)) & np.uint64(n_bits - 1)).astype(np.int64)
    test = lambda p: (bitmap[p >> 3] >> (p & 7).astype(np.uint8)) & 1
    return (test(place(0)) & test(place(32))).astype(bool)


def _bitmap(seeds: DataFrame) -> tuple[int, np.ndarray]:
    """The number of bits, from the number of seeds, and the bitmap with two bits set for each."""
    wanted = BITS_PER_SEED * max(1, seeds.count())
    n_bits = 1 << min(MOST_BITS, max(15, (wanted - 1).bit_length()))
    bit = F.explode(F.array(*(F.expr(f"1 + (shiftrightunsigned(seed, {shift}) & {n_bits - 1}L)") for shift in (0, 32)))).alias("bit")
    parts = seeds.select(bit).groupBy(F.expr("bitmap_bucket_number(bit)").alias("part")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("bits"))
    bitmap = np.zeros(n_bits // 8, np.uint8)
    for row in parts.collect():  # at most 2**MOST_BITS bits in all
        start = (row["part"] - 1) * 4096
        bitmap[start : start + 4096] = np.frombuffer(row["bits"], np.uint8)
    return n_bits, bitmap


_TILED = "item_words long, covered_words long, n_tiles long, longest long"


def _tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In place of the last two columns, the words of a document and an item, what _TILED names."""
    for batch in batches:
        out = []
        for text, item in zip(*(batch.column(batch.num_columns - k) for k in (2, 1)), strict=True):
            own = item.values.to_numpy().view(np.uint64)
            marked = tiles(own, text.values.to_numpy().view(np.uint64))
            out.append((len(own), sum(n for _, _, n in marked), len(marked), max((n for _, _, n in marked), default=0)))
        columns = list(zip(*out, strict=True)) or [[]] * 4
        names = [f.split()[0] for f in _TILED.split(", ")]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *(pa.array(c, pa.int64()) for c in columns)], names=[*batch.schema.names[:-2], *names])


def _with(schema: StructType, ddl: str, drop: int) -> StructType:
    return StructType(schema.fields[: len(schema.fields) - drop] + [StructField(f.name, f.dataType) for f in StructType.fromDDL(ddl)])


def _found(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, coverage: float) -> DataFrame:
    """contaminated with a hash of each document's text, text_key."""
    spark = docs.sparkSession
    bench = benchmark.select(F.col(item_col).alias("item_id"), F.lower(item_text_col).alias("text"))
    items = durable(bench.mapInArrow(_seeded, _with(bench.schema, _ITEM, 1)).filter("size(words) > 0").withColumn("number", F.monotonically_increasing_id()))
    seeds = items.select("number", F.posexplode("seeds").alias("place", "seed"))
    bits = spark.sparkContext.broadcast(_bitmap(seeds))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("text_key"), F.lower(text_col).alias("text"))
    hits = durable(rows.mapInArrow(lambda batches: _seeded(batches, bits.value), _with(rows.schema, _ITEM, 1)).withColumn("row", F.monotonically_increasing_id()))
    bits.destroy()
    shared = hits.select("row", F.explode("seeds").alias("seed")).join(seeds, "seed").groupBy("row", "number").agg(F.array_sort(F.collect_set("place")).alias("places"))
    # Tiles lie under shared seeds, so those bound the coverage; a short item is one seed.
    under = F.expr(f"aggregate(places, struct(-{MATCH_WORDS} AS last, 0 AS n), (a, p) -> struct(p AS last, a.n + least({MATCH_WORDS}, p - a.last) AS n)).n")
    able = shared.select("row", "number", under.alias("under")).join(items.select("number", "item_id", F.col("words").alias("item_words")), "number").filter(F.col("under") >= coverage * F.size("item_words"))
    pairs = able.join(hits.select("row", "doc_id", "text_key", "words"), "row").select("doc_id", "text_key", "item_id", "words", "item_words")
    tiled = pairs.mapInArrow(_tiled, _with(pairs.schema, _TILED, 2))
    return tiled.filter((F.col("covered_words") > 0) & (F.col("covered_words") >= coverage * F.col("item_words"))).withColumn("coverage", F.round(F.col("covered_words") / F.col("item_words"), 6))


def text_key(text_col: str) -> Column:
    """Tells the texts of one id apart."""
    return F.xxhash64(F.octet_length(text_col), F.col(text_col))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, item_words, covered_words, n_tiles, longest, coverage) of every row of docs and item with enough coverage."""
    return _found(docs, benchmark, id_col, text_col, item_col, item_text_col, coverage).drop("text_key")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """docs without the rows in which an item is found, with all columns; documents are only moved where more than BROADCAST_ROWS are found."""
    found = durable(_found(docs, benchmark, id_col, text_col, item_col, item_text_col, coverage).select("doc_id", "text_key").distinct())
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    quoted = ["`" + c.replace("`", "``") + "`" for c in docs.columns]
    rows = docs.select(F.struct(*quoted).alias("row"), F.col(id_col).alias("doc_id"), text_key(text_col).alias("text_key"))
    return rows.join(found, rows["doc_id"].eqNullSafe(found["doc_id"]) & (rows["text_key"] == found["text_key"]), "left_anti").select("row.*")
