"""Quality classifier: a generalised additive model with pairwise interactions.

Spark measures every text. A bounded sample of labelled rows is binned by
quantiles; shallow trees, boosted over the features in turn, add up to one lookup
table per feature, and then to one per chosen pair of features. A score is the
sum of the tables' entries at a row's bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seepage.llm.common import let, words
from seepage.llm.quality_rules import measures

SAMPLE = 20_000  # labelled rows used for fitting, at most
BINS = 32
PAIR_BINS = 8
PAIRS = 6
ROUNDS = 120
PAIR_ROUNDS = 40
LEAVES = 4
RATE = 0.15
SMOOTH = 5.0
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def features(text: Column) -> Column:
    """Struct of doubles from a whole text; a null text counts as an empty one."""
    whole = F.coalesce(text, F.lit(""))

    def count(characters: str) -> Column:
        return F.char_length(whole) - F.char_length(F.translate(whole, characters, ""))

    def ratios(m: Column) -> Column:
        n = F.greatest(m["n_words"], F.lit(1))
        found = {
            "log_words": F.log1p(m["n_words"]),
            "chars_per_word": m["word_chars"] / n,
            "symbols_per_word": m["n_symbols"] / n,
            "stop_word_share": m["n_stop_words"] / n,
            "duplicate_line_share": m["n_dup_lines"] / F.greatest(m["n_lines"], F.lit(1)),
            "repeated_word_share": m["n_repeat_words"] / n,
            "words_per_line": n / F.greatest(m["n_lines"], F.lit(1)),
            "capitals_per_word": count(CAPITALS) / n,
            "digits_per_word": count("0123456789") / n,
            "shouts_per_word": count("!?") / n,
            "stops_per_word": count(".,;:") / n,
            "distinct_word_share": F.size(F.array_distinct(words(text))) / n,
        }
        return F.struct(*[c.cast("double").alias(name) for name, c in found.items()])

    return let(measures(text), ratios)


@dataclass
class Additive:
    """Bin edges and lookup tables; ``score`` is a probability of label 1."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, j], "right")]
        coarse = [np.searchsorted(edges, x[:, j], "right") for j, edges in enumerate(self.pair_edges)]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-total))


def quantile_edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + SMOOTH)


def shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Step function over the bins with at most LEAVES steps, from sums of gradients."""
    out = np.zeros(len(g))
    parts = [(0, len(g))]
    while len(parts) < LEAVES:
        best, which, where = 1e-9, -1, 0
        for p, (lo, hi) in enumerate(parts):
            if hi - lo < 2:
                continue
            gl, hl = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
            gt, ht = g[lo:hi].sum(), h[lo:hi].sum()
            won = gain(gl, hl) + gain(gt - gl, ht - hl) - gain(gt, ht)
            if won.max() > best:
                best, which, where = won.max(), p, lo + 1 + int(won.argmax())
        if which < 0:
            break
        lo, hi = parts[which]
        parts[which : which + 1] = [(lo, where), (where, hi)]
    for lo, hi in parts:
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + SMOOTH)
    return out


def cross_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Four quadrants around the best pair of cuts over a grid of gradient sums."""
    G, H = (np.cumsum(np.cumsum(np.pad(x, ((1, 0), (1, 0))), 0), 1) for x in (g, h))
    out = np.zeros_like(g)
    rows, cols = g.shape
    if rows < 2 or cols < 2:
        return out, 0.0

    def quadrants(S: np.ndarray) -> list[np.ndarray]:
        a = S[1:rows, 1:cols]
        top, left = S[1:rows, -1:], S[-1:, 1:cols]
        return [a, top - a, left - a, S[-1, -1] - top - left + a]

    won = sum(gain(x, y) for x, y in zip(quadrants(G), quadrants(H), strict=True))
    i, j = np.unravel_index(int(won.argmax()), won.shape)
    i, j = i + 1, j + 1
    for r in (slice(0, i), slice(i, None)):
        for c in (slice(0, j), slice(j, None)):
            out[r, c] = g[r, c].sum() / (h[r, c].sum() + SMOOTH)
    return out, float(won.max())


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Cyclic boosting of the logistic loss; an empty sample gives a score of one half."""
    n, width = x.shape
    edges = [quantile_edges(x[:, j], BINS) if n else np.empty(0) for j in range(width)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    coarse = [quantile_edges(x[:, j], PAIR_BINS) if n else np.empty(0) for j in range(width)]
    rate = (y.sum() + 1) / (n + 2)
    base = float(np.log(rate / (1 - rate)))
    model = Additive(base, edges, tables, [], coarse, [])
    if not n:
        return model
    bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]
    total = np.full(n, base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(width):
            g, h = (np.bincount(bins[j], s, len(tables[j])) for s in slopes())
            step = RATE * shallow_tree(g, h)
            tables[j] += step
            total += step[bins[j]]
    grid = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(coarse)]
    shape = [len(e) + 1 for e in coarse]

    def table_of(a: int, b: int, s: np.ndarray) -> np.ndarray:
        return np.bincount(grid[a] * shape[b] + grid[b], s, shape[a] * shape[b]).reshape(shape[a], shape[b])

    g, h = slopes()
    promise = {(a, b): cross_tree(table_of(a, b, g), table_of(a, b, h))[1] for a, b in combinations(range(width), 2)}
    model.pairs = sorted(promise, key=lambda p: (-promise[p], p))[:PAIRS]
    model.pair_tables = [np.zeros((shape[a], shape[b])) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            g, h = slopes()
            step = RATE * cross_tree(table_of(a, b, g), table_of(a, b, h))[0]
            table += step
            total += step[grid[a], grid[b]]
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Additive:
    """Fits on the labelled rows that aren't held out, at most ``sample`` of them by hash.

    Rows without a label, and labels without a row, are left out. The sample's
    features, at most ``sample`` short rows, are the only thing on the driver.
    """
    known = (
        labels.select(F.col(id_col).alias("_id"), F.col("quality").alias("_label"))
        .filter(F.col("_label").isNotNull() & ~held_out(F.col("_id")))
        .orderBy(F.xxhash64("_id"), "_id", "_label")
        .limit(sample)
    )
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    rows = texts.join(F.broadcast(known), F.col("_doc") == F.col("_id")).select(features(F.col("_text")).alias("f"), "_label", "_id")
    found = rows.select("f.*", "_label", "_id").toPandas().sort_values("_id", kind="stable")
    x = found.drop(columns=["_label", "_id"]).to_numpy(np.float64)
    return fit(x, found["_label"].to_numpy(np.float64))


def score(docs: DataFrame, model: Additive, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score), one row per row of ``docs``; null and empty texts are scored like any other."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), features(F.col(text_col)).alias("f")).select("id", "f.*")
    names = rows.columns[1:]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(shared.value.score(x))], ["id", "score"])

    out = rows.mapInArrow(add, f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return out.withColumnRenamed("id", id_col)
