"""Language identification by a byte convolutional network.

A text's bytes are cut into windows of WINDOW bytes, the last one padded. Each byte has an embedding;
filters of several widths run over a window, the largest response of each filter is kept, and a dense
layer with softmax gives the languages' probabilities. A text's are the mean over all its windows,
weighted by their bytes. The network is trained with numpy on the driver, on WINDOWS_PER_ROW windows
of each of about SAMPLE_ROWS labelled texts. These are dealt evenly over the languages, at least
LEAST_PER_LANGUAGE to each, and drawn by a hash of the text, so that copies of a text are one; a language
with fewer texts gives all. Of more than MOST_LANGUAGES languages the most frequent are learned. All texts
are then judged in full inside tasks, batch by batch.

Null texts, and texts without a letter, are "und" with a score of 0, as is everything when no row is
labelled. Rows with a null language never train. Repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitscope.llm.wordhash import chunks

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDING = 8
SAMPLE_ROWS = 4000
LEAST_PER_LANGUAGE = 50
MOST_LANGUAGES = 1000
WINDOWS_PER_ROW = 2
EPOCHS = 6
UNKNOWN = "und"


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # byte, dimension
    filters: list[np.ndarray]  # per width: place * dimension, filter
    bias: list[np.ndarray]
    dense: np.ndarray
    offset: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """What a byte at each place adds to each filter's response: the convolution as sums of looked-up rows."""
        return [[np.ascontiguousarray(self.embedding @ w.reshape(width, EMBEDDING, -1)[k], np.float32) for k in range(width)] for width, w in zip(WIDTHS, self.filters, strict=True)]

    def probabilities(self, windows: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        pooled = []
        for table, bias in zip(tables, self.bias, strict=True):
            n = WINDOW - len(table) + 1
            response = table[0][windows[:, :n]]
            for k in range(1, len(table)):
                response += table[k][windows[:, k : n + k]]
            pooled.append(np.maximum(response.max(axis=1) + bias, 0))
        return softmax(np.concatenate(pooled, axis=1) @ self.dense + self.offset)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts, padded with zeros, the text of each window and how many bytes of it the window has."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), counts)
    first = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    held = np.minimum(WINDOW, sizes[text] - first * WINDOW)
    flat = np.zeros(len(text) * WINDOW, np.uint8)
    # Each text moves to the start of its own windows.
    flat[np.arange(len(data)) + np.repeat((np.cumsum(counts) - counts) * WINDOW - offsets[:-1], sizes)] = data
    return flat.reshape(-1, WINDOW), text, held


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 7) -> Network:
    """Adam on mini-batches of the cross entropy; the same input gives the same network."""
    rng = np.random.default_rng(seed)
    net = Network(
        languages,
        rng.normal(0, 0.3, (256, EMBEDDING)),
        [rng.normal(0, (2 / (w * EMBEDDING)) ** 0.5, (w * EMBEDDING, FILTERS)) for w in WIDTHS],
        [np.zeros(FILTERS) for _ in WIDTHS],
        rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(languages))),
        np.zeros(len(languages)),
    )
    params = [net.embedding, *net.filters, *net.bias, net.dense, net.offset]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step, size = 0, 64
    for _ in range(EPOCHS):
        order = rng.permutation(len(windows))
        for start in range(0, len(order), size):
            rows = order[start : start + size]
            x, y = windows[rows], labels[rows]
            embedded = net.embedding[x]
            pooled, patches = [], []
            for width, w, b in zip(WIDTHS, net.filters, net.bias, strict=True):
                runs = np.lib.stride_tricks.sliding_window_view(embedded, width, axis=1).transpose(0, 1, 3, 2).reshape(len(rows), WINDOW - width + 1, -1)
                response = runs @ w
                best = response.argmax(axis=1)
                pooled.append(np.take_along_axis(response, best[:, None, :], 1)[:, 0] + b)
                patches.append((best, runs[np.arange(len(rows))[:, None], best]))
            flat = np.concatenate(pooled, axis=1)
            active = np.maximum(flat, 0)
            error = softmax(active @ net.dense + net.offset)
            error[np.arange(len(rows)), y] -= 1
            error /= len(rows)
            grads = [np.zeros_like(p) for p in params]
            grads[-2][:], grads[-1][:] = active.T @ error, error.sum(axis=0)
            back = (error @ net.dense.T) * (flat > 0)
            for k, width in enumerate(WIDTHS):
                own = back[:, k * FILTERS : (k + 1) * FILTERS]
                best, patch = patches[k]
                grads[1 + k][:] = np.einsum("rf,rfp->pf", own, patch)
                grads[1 + len(WIDTHS) + k][:] = own.sum(axis=0)
                to_bytes = (own[:, :, None] * net.filters[k].T).reshape(len(rows), FILTERS, width, EMBEDDING)
                at = x[np.arange(len(rows))[:, None, None], best[:, :, None] + np.arange(width)]
                np.add.at(grads[0], at, to_bytes)
            step += 1
            for p, g, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def held_out(id_: Column) -> Column:
    """Rows whose language is never learned from."""
    return F.coalesce(F.crc32(id_.cast("string")) % 3 == 1, F.lit(False))


def limit_of(texts: int, n: int) -> int:
    """Below this lie about `texts` of n hashes from 0 to 2**62, or all, however large n is."""
    return min(1 << 62, (texts << 62) // max(1, n))


def fitted(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS) -> Network | None:
    """A network trained on about `rows` texts of labelled; None without labels."""
    known = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang IS NOT NULL AND length(text) > 0").withColumn("h", F.xxhash64("text", F.lit(1)))
    distinct = known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    if not distinct:
        return None
    each = max(LEAST_PER_LANGUAGE, rows // len(distinct))
    limits = labelled.sparkSession.createDataFrame([(r["lang"], limit_of(each, r["n"])) for r in distinct], "lang string, below long")
    taken = known.join(F.broadcast(limits), "lang").filter(F.pmod("h", F.lit(1 << 62)) < F.col("below"))
    # A random stretch of each text, so that a window may come from anywhere in it.
    place = F.expr(f"1 + pmod(xxhash64(text, k), greatest(1, length(text) - {WINDOW // 2}))").cast("int")
    stretches = taken.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(WINDOWS_PER_ROW)))).select("lang", F.substring("text", place, F.lit(WINDOW)).alias("text")).distinct()
    sample = sorted((r["lang"], r["text"]) for r in stretches.collect())
    if not sample:
        return None
    languages = sorted({lang for lang, _ in sample})
    windows = np.zeros((len(sample), WINDOW), np.uint8)
    for row, (_, text) in zip(windows, sample, strict=True):
        data = np.frombuffer(text.encode()[:WINDOW], np.uint8)
        row[: len(data)] = data
    return train(windows, np.array([languages.index(lang) for lang, _ in sample]), languages)


def identify(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) per row of docs."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.when(F.rlike(text_col, F.lit(r"\p{L}")), F.col(text_col)).alias("text"))
    if network is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network = shared.value
        tables = net.tables()
        for batch in batches:
            sums = np.zeros((batch.num_rows, len(net.languages)))
            sizes = np.zeros(batch.num_rows)
            for first, _, data, offsets in chunks(batch.column(1), 1 << 20):
                windows, text, held = cut(data, offsets)
                for start in range(0, len(windows), 512):
                    part = slice(start, start + 512)
                    np.add.at(sums, first + text[part], net.probabilities(windows[part], tables) * held[part, None])
                np.add.at(sizes, first + text, held)
            mean = sums / np.maximum(sizes, 1)[:, None]
            best = mean.argmax(axis=1)
            names = [net.languages[k] if size else UNKNOWN for k, size in zip(best, sizes, strict=True)]
            score = np.clip(np.where(sizes > 0, mean[np.arange(len(best)), best], 0.0), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(judge, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row of docs, learned from the rows that are not held out."""
    network = fitted(docs.filter(~held_out(F.col(id_col))), text_col, lang_col)
    return identify(docs, network, id_col, text_col).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
