"""Hard negatives by vertical scans of vector columns (BOND).

Rows are dealt at random into tiles of at most about ROW_TILE rows, anchors into parts of about ANCHOR_TILE, and each pair
of a tile and a part is one group: both of bounded size, whatever the table. Inside it the tile's vectors lie as columns, one to a
dimension. An anchor reads them in descending magnitude of its own components. What the dimensions not yet read can add
lies between the sums of the least and greatest contributions that the tile's column minima and maxima allow, so each
candidate has a lower and an upper bound; candidates whose bounds show that they are not wanted leave the bitmap, and those that are
left at the end have exact scores.

First pass: an anchor's positives, the best rows of its label. A candidate leaves once its upper bound is below the k-th best
lower bound. Second pass: for each positive a window of scores of other labels. A candidate leaves once it can be in no window, or in
none whose k-th best certain member it can still reach. Tiles return at most k rows for each anchor and window, of which the best stay.

Scores are integers: each component x counts as floor(256 * x), x as double. Sums are exact in 32-bit floats below 2**24, in
64-bit floats below 2**53 and in Python's integers beyond, those beyond 38 digits counting as 38 nines; scores beyond a long come out as the nearest long.

Rows without an id, label or vector, or with a component that is null or not finite (times 256, as double), take no part. Vectors meet
only vectors of their own length. Rows that repeat are rows of their own, but an anchor that repeats is asked
once, and rows with an anchor's id are never its positives or negatives. Further columns are not looked at. Empty tables and anchors
without positives or negatives have no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unitscope.llm.durable import durable

ROW_TILE = 1 << 14
ANCHOR_TILE = 1 << 12
#: Smaller tables still make so many tiles, of LEAST_TILE rows at least, that there is work for all.
TILES, LEAST_TILE = 64, 1 << 12
SCALE = 256
#: Shares of the dimensions after which the bitmap is looked at, and anchors that read the first share together.
STEPS = (0.75, 0.875, 1.0)
BATCH = 64
_LONG, _WIDE = (1 << 63) - 1, 10**38 - 1

Keep = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _columns(table: pa.Table) -> np.ndarray:
    """The vectors of a group as whole numbers, a row to each dimension."""
    vectors = table["embedding"].combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.ascontiguousarray(np.floor(SCALE * flat).reshape(len(table), -1).T)


def _exact(rows: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in the narrowest type in which every sum of products is exact."""
    most = float(np.abs(rows).max(axis=1, initial=0) @ np.abs(anchors).max(axis=1, initial=0))
    if most < 1 << 24:
        return rows.astype(np.float32), anchors.astype(np.float32)
    if most < 1 << 53:
        return rows, anchors
    return tuple(np.array([int(x) for x in side.ravel()], object).reshape(side.shape) for side in (rows, anchors))


def bond(columns: np.ndarray, anchors: np.ndarray, wanted: Callable[[int], tuple[np.ndarray, Keep]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each anchor (a column of anchors) i with wanted(i) = (candidates, keep): i, the candidates that keep(lower bounds, upper bounds) leaves to
    the end, and their exact scores.

    The first dimensions are read for BATCH anchors at once, as one product of their vectors without the other dimensions; what the
    bitmaps leave is read for each anchor on its own."""
    low, high = columns.min(axis=1)[:, None], columns.max(axis=1)[:, None]
    ends = [round(share * len(columns)) for share in STEPS]
    for begin in range(0, anchors.shape[1], BATCH):
        batch = anchors[:, begin : begin + BATCH]
        order = np.argsort(-np.abs(batch), axis=0, kind="stable")
        least, most = (np.take_along_axis(f(batch * low, batch * high), order, axis=0)[::-1] for f in (np.minimum, np.maximum))
        # What the dimensions from each place of the order on can add.
        rest = [np.concatenate([np.cumsum(side, axis=0)[::-1], np.zeros((1, batch.shape[1]), side.dtype)]) for side in (least, most)]
        first = np.zeros_like(batch)
        np.put_along_axis(first, order[: ends[0]], np.take_along_axis(batch, order[: ends[0]], axis=0), axis=0)
        read = first.T @ columns
        for i in range(batch.shape[1]):
            alive, keep = wanted(begin + i)
            score = read[i, alive]
            for at, end in zip(ends, [*ends[1:], ends[-1]], strict=True):
                stays = keep(score + rest[0][at, i], score + rest[1][at, i])
                alive, score = alive[stays], score[stays]
                dims = order[at:end, i]
                if len(dims) and len(alive):
                    score = score + batch[dims, i] @ columns[dims[:, None], alive]
            yield begin + i, alive, score


def _best(k: int) -> Keep:
    def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return high >= np.sort(low)[-k] if len(low) > k else np.ones(len(low), bool)

    return keep


def _windows(limits: list[tuple[int, int]], k: int) -> Keep:
    bottom, top = min(least for least, _ in limits), max(most for _, most in limits)

    def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        wanted = np.zeros(len(low), bool)
        near = np.flatnonzero((high >= bottom) & (low <= top))
        low, high = low[near], high[near]
        for least, most in limits:
            able = (high >= least) & (low <= most)
            sure = np.sort(low[(low >= least) & (high <= most)])
            if len(sure) >= k:
                able &= high >= sure[-k]
            wanted[near[able.astype(bool)]] = True
        return wanted

    return keep


def _wide(scores: np.ndarray) -> list[int]:
    return [max(-_WIDE, min(_WIDE, int(x))) for x in scores.tolist()]


def _long(score: str) -> Column:
    return F.least(F.greatest(F.col(score), F.lit(-_LONG - 1)), F.lit(_LONG)).cast("long").alias(score)


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties by the smaller id."""
    return np.lexsort((ids, -scores))[:k] if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], int)


def _sides(rows: pa.Table, anchors: pa.Table):
    """The tile's columns in order of label, the anchors', the tile's ids, and of each anchor its id and where its label starts and ends."""
    rows = rows.take(pa.array(np.argsort(rows["label"].to_numpy(), kind="stable")))
    columns, asked = _exact(_columns(rows), _columns(anchors))
    labels, own = rows["label"].to_numpy(), anchors["label"].to_numpy()
    places = list(zip(anchors["id"].to_pylist(), np.searchsorted(labels, own).tolist(), np.searchsorted(labels, own, side="right").tolist(), strict=True))
    return columns, asked, rows["id"].to_numpy(), places


_POSITIVE = "anchor long, positive_id long, score decimal(38)"
_NEGATIVE = "anchor long, anchor_id long, place int, positive_id long, positive_score decimal(38), negative_id long, negative_score decimal(38)"


_ARROW = {"long": pa.int64(), "int": pa.int32(), "decimal(38)": pa.decimal128(38, 0)}


def _table(rows: list[tuple], schema: str) -> pa.Table:
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.table([pa.array([Decimal(x) for x in c] if kind == "decimal(38)" else list(c), _ARROW[kind]) for c, kind in zip(columns, kinds, strict=True)], names=list(names))


def _positives(k: int):
    def best(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if len(rows) and len(anchors):
            columns, asked, ids, places = _sides(rows, anchors)
            keys = anchors["anchor"].to_pylist()

            def wanted(i: int) -> tuple[np.ndarray, Keep]:
                own, start, end = places[i]
                return start + np.flatnonzero(ids[start:end] != own), _best(k)

            for i, near, scores in bond(columns, asked, wanted):
                top = _first(ids[near], scores, k)
                out += zip([keys[i]] * len(top), ids[near[top]].tolist(), _wide(scores[top]), strict=True)
        return _table(out, _POSITIVE)

    return best


def _negatives(k: int, part: tuple[int, int]):
    def best(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if len(rows) and len(anchors):
            columns, asked, ids, places = _sides(rows, anchors)
            keys, positives = anchors["anchor"].to_pylist(), anchors["positives"].to_pylist()
            limits = [[(-(-part[0] * int(p["score"]) // 100), part[1] * int(p["score"]) // 100) for p in own] for own in positives]

            def wanted(i: int) -> tuple[np.ndarray, Keep]:
                own, start, end = places[i]
                other = ids != own
                other[start:end] = False
                return np.flatnonzero(other), _windows(limits[i], k)

            for i, far, scores in bond(columns, asked, wanted):
                for place, (p, (least, most)) in enumerate(zip(positives[i], limits[i], strict=True)):
                    inside = np.flatnonzero((scores >= least) & (scores <= most))
                    top = inside[_first(ids[far[inside]], scores[inside], k)]
                    out += [(keys[i], places[i][0], place, p["positive_id"], p["score"], x, s) for x, s in zip(ids[far[top]].tolist(), _wide(scores[top]), strict=True)]
        return _table(out, _NEGATIVE)

    return best


def _finite(vector: str) -> str:
    return f"forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) AND abs({SCALE}D * x) < double('infinity'))"


def hard_negatives(vectors: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 3, percent: tuple[int, int] = (50, 95), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its first positives the first rows
    of other labels whose scores lie between these percents of the positive's."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("embedding"), F.coalesce(is_anchor, F.lit(False)).alias("asked"))
    rows = rows.filter("id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").filter(F.expr(_finite("embedding")))
    count = rows.agg(F.count("*").alias("rows"), F.count_if("asked").alias("anchors")).first()
    tiles = max(-(-count["rows"] // ROW_TILE), min(TILES, -(-count["rows"] // LEAST_TILE)), 1)
    parts = max(-(-count["anchors"] // ANCHOR_TILE), 1)
    # A place in the table, so that rows of one id or vector do not meet in one tile.
    dealt = rows.drop("asked").withColumn("tile", F.expr(f"pmod(xxhash64(monotonically_increasing_id()), {tiles})")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    anchors = durable(rows.filter("asked").select("id", "label", "embedding").distinct().withColumn("anchor", F.monotonically_increasing_id()))
    size, keys = F.size("embedding").alias("dims"), ("dims", "tile", "part")
    tiled = dealt.withColumn("dims", size).groupBy(*keys)

    def to_tiles(df: DataFrame):
        asked = df.withColumns({"dims": size, "part": F.expr(f"int(pmod(xxhash64(anchor), {parts}))"), "tile": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long")))})
        return asked.groupBy(*keys)

    found = tiled.cogroup(to_tiles(anchors)).applyInArrow(_positives(n_positives), _POSITIVE)
    best = found.withColumn("k", F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "positive_id"))).filter(F.col("k") <= n_positives)
    chosen = best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("k", "positive_id", "score"))).alias("positives"))
    windows = tiled.cogroup(to_tiles(durable(anchors.join(chosen, "anchor")))).applyInArrow(_negatives(n_negatives, percent), _NEGATIVE)
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = windows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n_negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", _long("positive_score"), _long("negative_score"))
