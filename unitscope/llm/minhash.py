"""MinHash near-dedup with tensored banding.

Two collections of TUPLES small tuples of ROWS minima each are computed per document. A table
key is a pair of one tuple from either collection, so TUPLES**2 tables of 2 * ROWS rows cost only
2 * TUPLES * ROWS minima. Two documents meet in a table if they agree in one tuple of both
collections; at a similarity of 0.75 they fail to with a chance of 1e-4, above it with less.

Documents with the same shingle set are folded into a class first, which one of them stands for (that of
the smallest id), so copies never make pairs. In each bucket all members are held against the smallest.
Buckets that still hold different components after that are open: every pair of candidates from different
components is compared there, unless a bound excludes it: the shingles of a set that stand in no other
open set cannot be in an intersection. These comparisons run inside tasks over pairs of blocks of
BLOCK_ROWS members of one tuple, and only links leave them, so no group's pairs are ever rows. A pair
is compared under the first tuple it shares. So every pair of candidates is compared, already connected
or excluded by the bound.
A candidate becomes a link only by comparing the full shingle sets of its texts.

Each row is judged by its own text: ids may have any type that can be ordered, may be null (then the row
links others but names no component, and where no row of a component has an id it has none) and may
repeat (rows of one id with different texts are different documents). Null, empty and blank texts have an
empty set and are linked with nothing. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from unitscope.llm.components import components
from unitscope.llm.durable import durable
from unitscope.llm.wordhash import chunks, mix, seeds, shingles, words

ROWS = 2
TUPLES = 12
#: Smallest similarity of a link, as a fraction of integers: 100 * intersection >= 75 * union.
SIMILARITY = (75, 100)
BLOCK_ROWS = 1024
BLOCK_BYTES = 8 << 20

_SIGNED = "n_shingles long, set_a long, set_b long, tuples_a array<long>, tuples_b array<long>"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In place of the last column, a text, what _SIGNED names."""
    minima = seeds(2 * ROWS * TUPLES, 11)
    place = seeds(ROWS, 12)
    for batch in batches:
        kept, names = batch.columns[:-1], batch.schema.names[:-1]
        for first, end, data, offsets in chunks(batch.column(batch.num_columns - 1)):
            hashes, starts, _, _ = words(data, offsets)
            runs, at = shingles(hashes, starts)
            n = end - first
            sizes, digest = np.zeros(n, np.int64), np.zeros((2, n), np.uint64)
            for i in np.flatnonzero(np.diff(at)):
                own = np.unique(runs[at[i] : at[i + 1]])
                sizes[i] = len(own)
                digest[0, i] = own.sum(dtype=np.uint64)
                digest[1, i] = mix(own * minima[0] + np.uint64(3)).sum(dtype=np.uint64)
            full = sizes > 0
            tuples = np.zeros((2 * TUPLES, n), np.uint64)
            if full.any():
                cut = at[:-1][full]
                for t in range(2 * TUPLES):
                    for r in range(ROWS):
                        tuples[t, full] += np.minimum.reduceat(runs * minima[t * ROWS + r], cut) * place[r]
            tuples = mix(tuples).view(np.int64)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * TUPLES), pa.array(np.ascontiguousarray(half.T).ravel())) for half in (tuples[:TUPLES], tuples[TUPLES:])]
            signed = [pa.array(sizes), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)), *lists]
            yield pa.RecordBatch.from_arrays([c.slice(first, n) for c in kept] + signed, names=[*names, *(f.split()[0] for f in _SIGNED.split(", "))])


def _text_key(text_col: str) -> Column:
    """Tells the texts of one id apart."""
    return F.xxhash64(F.octet_length(text_col), F.col(text_col))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, a hash of its text, set size, a 128-bit digest of the shingle set and the two collections of tuples."""
    rows = docs.select(F.col(id_col).alias("id"), _text_key(text_col).alias("text_key"), F.col(text_col).alias("text"))
    signed = StructType(rows.schema.fields[:2] + [StructField(f.name, f.dataType) for f in StructType.fromDDL(_SIGNED)])
    return rows.mapInArrow(_signatures, signed)


def classes(signed: DataFrame) -> DataFrame:
    """(node, set_a, set_b, n, tuples_a, tuples_b, low) per distinct shingle set: a number for it and its smallest (no_id, id, text_key)."""
    key = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key")
    # The size and the tuples follow from the set.
    folded = signed.filter("n_shingles > 0").groupBy("set_a", "set_b", F.col("n_shingles").alias("n"), "tuples_a", "tuples_b").agg(F.min(key).alias("low"))
    return durable(folded.withColumn("node", F.monotonically_increasing_id()))


def buckets(sets: DataFrame) -> DataFrame:
    """(key, node, low) of the table buckets with two members or more, and the smallest of each. A pair of tuples can only collide where both tuples do, so only those are paired."""
    own = sets.select("node", F.posexplode(F.concat("tuples_a", "tuples_b")).alias("place", "value"))
    shared = own.groupBy("place", "value").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    # At most 2 * TUPLES to a node.
    left = own.join(shared, ["place", "value"], "left_semi").groupBy("node").agg(F.collect_list(F.struct("place", F.xxhash64("place", "value").alias("h"))).alias("t"))
    pairs = F.expr(f"flatten(transform(filter(t, l -> l.place < {TUPLES}), l -> transform(filter(t, r -> r.place >= {TUPLES}), r -> xxhash64(l.h, r.h))))")
    keyed = left.select("node", F.explode(pairs).alias("key"))
    lead = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").drop("high")
    return keyed.join(lead, "key")


#: Columns that tell a row's id and text apart; none is null, so that joins take them as they are.
_ROW = ["text_key", "id_key", "no_id"]


def _row_key(id_: Column | str) -> list[Column]:
    id_ = F.col(id_) if isinstance(id_, str) else id_
    return [F.coalesce(id_.cast("string"), F.lit("")).alias("id_key"), id_.isNull().alias("no_id")]


def once(docs: DataFrame, id_col: str, text_col: str, *columns: Column) -> DataFrame:
    """_ROW and the columns of the rows of docs that have words, rows that repeat id and text once; they are dropped before they are moved, and lie where a join by _ROW needs them."""
    rows = docs.filter(F.rlike(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]"))).select(_text_key(text_col).alias("text_key"), *_row_key(F.col(id_col)), *columns)
    window = Window.partitionBy(*_ROW).orderBy("text_key")
    return rows.withColumn("copy", F.row_number().over(window)).filter("copy = 1").drop("copy")


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, whole = SIMILARITY
    for batch in batches:
        ids_a, ids_b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        ok = np.zeros(len(ids_a), bool)
        for first, end, data, offsets in chunks(pa.concat_arrays([batch.column(2), batch.column(3)]).take(pa.array(np.arange(2 * len(ids_a)).reshape(2, -1).T.ravel())), 1 << 20) if len(ids_a) else ():
            runs, at = shingles(*words(data, offsets)[:2])
            # Texts alternate; a run of rows may start or end between the two texts of a pair.
            for row in range(first, end):
                own = np.unique(runs[at[row - first] : at[row - first + 1]])
                if row % 2 == 0:
                    left = own
                else:
                    both = len(np.intersect1d(left, own, assume_unique=True))
                    ok[row // 2] = both > 0 and whole * both >= part * (len(left) + len(own) - both)
        yield pa.RecordBatch.from_arrays([pa.array(ids_a[ok]), pa.array(ids_b[ok])], names=["a", "b"])


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) of nodes whose texts' full shingle sets are similar enough."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_linked, "a long, b long")


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes = batch.column(0).to_numpy(zero_copy_only=False)
        for first, end, data, offsets in chunks(batch.column(1), 1 << 20):
            runs, at = shingles(*words(data, offsets)[:2])
            own = [np.unique(runs[low:high]) for low, high in pairwise(at)]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(nodes[first:end], [len(x) for x in own])), pa.array(np.concatenate(own).view(np.int64))], names=["node", "shingle"])


def bounded(open_: DataFrame, texts: DataFrame) -> DataFrame:
    """Of the open nodes (node, n) those that can have a link among them at all, with shared: how many of a set's shingles any other open set has."""
    part, whole = SIMILARITY
    rows = texts.join(open_.select("node"), "node", "left_semi").mapInArrow(_shingle_rows, "node long, shingle long")
    alone = rows.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("high")).filter("node = high").groupBy("node").agg(F.count("*").alias("alone"))
    held = open_.join(alone, "node", "left").withColumn("shared", F.col("n") - F.coalesce("alone", F.lit(0))).drop("alone")
    return held.filter(whole * F.col("shared") >= part * F.col("n"))


def _crossing(members: DataFrame) -> DataFrame:
    """Of (key, node, component, …) the rows of buckets that hold different components."""
    mixed = members.groupBy("key").agg(F.min("component").alias("lowest"), F.max("component").alias("highest")).filter("lowest < highest")
    return members.join(mixed.select("key"), "key", "left_semi")


def _block_links(place: int, sides: np.ndarray, table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs of candidates from different components between two blocks, or within one, of the members of one tuple."""
    part, whole = SIMILARITY
    ids, component, n, shared = (table[c].to_numpy() for c in ("node", "component", "n", "shared"))
    left, right = (table[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), TUPLES) for c in ("tuples_a", "tuples_b"))
    sets: list[np.ndarray] = []
    for _, _, data, offsets in chunks(table["text"]):
        runs, at = shingles(*words(data, offsets)[:2])
        sets += [np.unique(runs[low:high]) for low, high in pairwise(at)]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    every, code = np.unique(np.concatenate(sets), return_inverse=True)
    held = np.zeros(len(every), bool)
    found_a, found_b = [], []
    for x in np.flatnonzero(sides == 0) if (sides == 1).any() else range(len(ids)):
        able = (sides == 1) if (sides == 1).any() else np.arange(len(ids)) > x
        both = np.minimum(shared[x], shared)
        able &= (component != component[x]) & (whole * both >= part * (n[x] + n - both))
        able &= ~(left[:, :place] == left[x, :place]).any(axis=1) & (right == right[x]).any(axis=1)
        if not len(to := np.flatnonzero(able)):
            continue
        held[code[starts[x] : starts[x + 1]]] = True
        met = np.array([np.count_nonzero(held[code[starts[y] : starts[y + 1]]]) for y in to])
        held[code[starts[x] : starts[x + 1]]] = False
        linked = to[whole * met >= part * (len(sets[x]) + np.diff(starts)[to] - met)]
        found_a.append(np.minimum(ids[x], ids[linked]))
        found_b.append(np.maximum(ids[x], ids[linked]))
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _blocks(table: pa.Table) -> pa.Table:
    a, b = _block_links(table["place"][0].as_py(), (table["block"].to_numpy() != table["low"].to_numpy()).astype(int), table)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def open_links(members: DataFrame) -> DataFrame:
    """The links (a, b) between different components of members (node, component, n, shared, tuples_a, tuples_b, text) that share a tuple of either collection."""
    keyed = members.select("node", "component", F.octet_length("text").alias("bytes"), F.posexplode("tuples_a").alias("place", "value"))
    groups = keyed.groupBy("place", "value").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min("component").alias("lowest"), F.max("component").alias("highest")).filter("lowest < highest")
    blocks = groups.select("place", "value", F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    dealt = keyed.join(blocks, ["place", "value"]).withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) AS int)"))
    dealt = dealt.select("node", "place", "value", "block", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    paired = dealt.select("node", "place", "value", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    return paired.join(members, "node").groupBy("place", "value", "low", "high").applyInArrow(_blocks, "a long, b long")


def links(sets: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component) of the nodes of classes that are linked with another."""
    members = durable(buckets(sets))
    stand = sets.join(members.select("node").distinct(), "node", "left_semi").select("node", "low.text_key", *_row_key("low.id"))
    rows = once(docs, id_col, text_col, F.col(text_col).alias("text"))
    texts = durable(rows.join(stand, _ROW).select("node", "text"))
    found = durable(confirm(members.filter("low < node").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct(), texts))
    component = components(found)
    # Bounds hold against the other open members; without those that they exclude, more may be excluded.
    placed = members.select("key", "node").join(component.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = sets.select("node", "n")
    for _ in range(2):
        crossing = durable(_crossing(placed))
        if crossing.isEmpty():
            return component
        open_ = durable(bounded(crossing.select("node", "component").distinct().join(sizes, "node"), texts))
        placed = crossing.join(open_.select("node"), "node", "left_semi")
    left = _crossing(placed).select("node").distinct()
    full = open_.join(left, "node", "left_semi").join(sets.select("node", "tuples_a", "tuples_b"), "node").join(texts, "node")
    further = durable(open_links(durable(full)))
    if further.isEmpty():
        return component
    # A component's node stands for all of its own, which have a link to it.
    return components(durable(further.unionByName(component.filter("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b")))))


def components_of(docs: DataFrame, signed: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The classes of signed rows, (node, set_a, set_b, low, root), and per root its smallest (no_id, id, text_key), lowest."""
    sets = classes(signed)
    linked = links(sets, docs, id_col, text_col).withColumnsRenamed({"id": "node", "component": "root"})
    rooted = sets.select("node", "set_a", "set_b", "low").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return rooted, rooted.groupBy("root").agg(F.min("low").alias("lowest"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of docs: the smallest id of its component, itself included, and whether it is that. Both ids of a row without words are its own."""
    signed = durable(signatures(docs, id_col, text_col))
    rooted, lowest = components_of(docs, signed, id_col, text_col)
    named = rooted.join(lowest, "root").select("set_a", "set_b", F.col("lowest.id").alias("component_id"))
    out = signed.select("id", "n_shingles", "set_a", "set_b").join(named, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near copies: of each component one row, of its smallest id; rows without words all stay, and so do all columns."""
    _, lowest = components_of(docs, durable(signatures(docs, id_col, text_col)), id_col, text_col)
    kept = lowest.select("lowest.text_key", *_row_key("lowest.id"))
    quoted = ["`" + c.replace("`", "``") + "`" for c in docs.columns]
    rows = once(docs, id_col, text_col, F.struct(*quoted).alias("row"))
    stay = rows.join(kept, _ROW, "left_semi").select("row.*")
    blank = docs.filter(~F.coalesce(F.rlike(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]")), F.lit(False)))
    return stay.unionByName(blank)
