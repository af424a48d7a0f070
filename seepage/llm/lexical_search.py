"""Ranked lexical search by walking two trees at once.

One tree stands over the items, the other over a block of documents. A node of either
holds the maximum of every coordinate below it: of a term's weight for items, of its
saturated frequency for documents. The product of two nodes bounds the score of every
item under one with every document under the other, so where it lies below the weakest
k-th score that an item under the node already has, the whole batch of pairs goes
unscored. What is left is scored in 64-bit integers; the result is exact.

The trees of the items are small and go to every task. Documents are counted once, as
the frequencies of the terms that some item has; each task takes its documents block by
block and keeps the k-th scores that it has reached. The first k-th scores come from a
bounded sample of documents, which can only be too low and so lose nothing.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seepage.llm.common import RowBatches
from seepage.operators.skew import top_per_group
from seepage.session import materialise

BLOCK = 4096  # documents of a tree
LEAF, FAN = 4, 8  # documents of a leaf; children of a node above
ITEM_FAN = 4
SEED_DOCS = 20_000  # documents, about, that give the first k-th scores
ITEM_BYTES = 8 << 20  # text of the items that are sent to the tasks at once
_KEPT = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
CLEAN = bytes(b if b in _KEPT else 0x20 for b in range(256)).lower()


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of anything beyond ASCII; only A-Z lower-cased."""
    return text.translate(CLEAN).split()


class Level:
    """Nodes of a tree: the terms of each, and the maximum that each term has below it."""

    def __init__(self, start: np.ndarray, term: np.ndarray, value: np.ndarray) -> None:
        self.start, self.term, self.value = start, term, value

    @classmethod
    def of(cls, node: np.ndarray, term: np.ndarray, value: np.ndarray, width: int) -> Level:
        key = node * width + term
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        key = key[first]
        node = key // width
        start = np.searchsorted(node, np.arange(node[-1] + 2))
        return cls(start, key % width, np.maximum.reduceat(value, first))

    def __len__(self) -> int:
        return len(self.start) - 1

    def above(self, fan: int, width: int) -> Level:
        node = np.repeat(np.arange(len(self)), np.diff(self.start)) // fan
        return Level.of(node, self.term, self.value, width)

    def products(self, nodes: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Of each of the nodes with the weights, which are zero for absent terms; no node is empty."""
        n = self.start[nodes + 1] - self.start[nodes]
        ends = np.cumsum(n)
        at = np.repeat(self.start[nodes] - (ends - n), n) + np.arange(ends[-1])
        return np.add.reduceat(weight[self.term[at]] * self.value[at], ends - n)


class Items:
    """The tree over the items: each level lists its nodes' terms and children."""

    def __init__(self, texts: list[bytes]) -> None:
        bags = [sorted(set(terms(t))) for t in texts]
        often = Counter(t for bag in bags for t in bag)
        self.words = sorted(often, key=lambda t: (-often[t], t))
        self.number = {t: i for i, t in enumerate(self.words)}
        sets = [np.array(sorted(self.number[t] for t in bag), np.int64) for bag in bags]
        filled = [i for i in range(len(sets)) if len(sets[i])]
        filled.sort(key=lambda i: sets[i].tolist())  # items that share frequent terms stand together
        self.leaves = np.array(filled, np.int64)
        level = [(sets[i], [], k, k + 1) for k, i in enumerate(filled)]
        while len(level) > 1:
            grown = []
            for at in range(0, len(level), ITEM_FAN):
                part = level[at : at + ITEM_FAN]
                grown.append((np.unique(np.concatenate([p[0] for p in part])), part, part[0][2], part[-1][3]))
            level = grown
        self.root = level[0] if level else None

    def weigh(self, n_docs: int, df: dict[int, int]) -> np.ndarray:
        return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(self.words))], np.int64)


class Search:
    """Top k of every item over blocks of documents."""

    def __init__(self, items: Items, weight: np.ndarray, k: int, floor: np.ndarray) -> None:
        self.items, self.weight, self.k = items, weight, k
        self.floor = floor[items.leaves].copy()  # no score below it can be among the best
        n = len(items.leaves)
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in range(n)]
        self.dense = np.zeros(len(items.words), np.int64)
        self.scored = self.pairs = 0

    def block(self, ids: np.ndarray, start: np.ndarray, term: np.ndarray, value: np.ndarray) -> None:
        """Documents as rows of (term, value); none is empty."""
        if not len(ids) or self.items.root is None:
            return
        width = len(self.items.words)
        n = np.diff(start)
        rarest = np.maximum.reduceat(self.weight[term] * width + term, start[:-1])
        order = np.lexsort((rarest, n))  # like lengths stand together, then documents of one rare term
        at = np.repeat(start[:-1][order] - (np.cumsum(n[order]) - n[order]), n[order]) + np.arange(len(term))
        docs = Level(np.concatenate([[0], np.cumsum(n[order])]), term[at], value[at])
        self.ids = ids[order]
        levels = [docs, docs.above(LEAF, width)]
        while len(levels[-1]) > FAN:
            levels.append(levels[-1].above(FAN, width))
        self.levels = levels
        self.pairs += len(ids) * len(self.items.leaves)
        self._walk(self.items.root, len(levels) - 1, np.arange(len(levels[-1])))

    def _products(self, node: tuple, level: int, at: np.ndarray) -> np.ndarray:
        self.dense[node[0]] = self.weight[node[0]]
        out = self.levels[level].products(at, self.dense)
        self.dense[node[0]] = 0
        return out

    def _walk(self, node: tuple, level: int, at: np.ndarray) -> None:
        _, children, lo, hi = node
        bound = self._products(node, level, at)
        keep = bound >= max(1, int(self.floor[lo:hi].min()))
        at, bound = at[keep], bound[keep]
        if not len(at):
            return
        if children:
            if level > 1:
                level, at = level - 1, self._below(level, at)
            for child in children:
                self._walk(child, level, at)
        elif level > 1:
            self._walk(node, level - 1, self._below(level, at))
        else:
            self._leaf(node, at, bound)

    def _below(self, level: int, at: np.ndarray) -> np.ndarray:
        fan = LEAF if level == 1 else FAN
        down = (at[:, None] * fan + np.arange(fan)).ravel()
        return down[down < len(self.levels[level - 1])]

    def _leaf(self, node: tuple, at: np.ndarray, bound: np.ndarray) -> None:
        """Scores the documents of one item, those of the highest bounds first."""
        item = node[2]
        order = np.argsort(-bound, kind="stable")
        at, bound = at[order], bound[order]
        step = 4
        while len(at):
            docs = self._below(1, at[:step])
            self.scored += len(docs)
            self._take(item, self._products(node, 0, docs), self.ids[docs])
            at, bound, step = at[step:], bound[step:], step * 2
            keep = bound >= max(1, self.floor[item])
            at, bound = at[keep], bound[keep]

    def _take(self, item: int, score: np.ndarray, ids: np.ndarray) -> None:
        good = score >= max(1, self.floor[item])
        if not good.any():
            return
        score, ids = np.concatenate([self.best[item][0], score[good]]), np.concatenate([self.best[item][1], ids[good]])
        order = np.lexsort((ids, -score))[: self.k]
        self.best[item] = score[order], ids[order]
        if len(order) == self.k:
            self.floor[item] = max(self.floor[item], score[order[-1]])


def _counted(docs: DataFrame, items: Items) -> DataFrame:
    """(id, n, terms, tfs): the length of each document, and its counts of the items' terms."""
    shared = docs.sparkSession.sparkContext.broadcast(items.number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in RowBatches(batches, "text"):
            lengths, starts, found, tfs = [], [0], [], []
            for raw in batch.column("text"):
                words = terms(raw.as_py() or b"")
                counts = Counter(map(number.get, words))
                counts.pop(None, None)
                lengths.append(len(words))
                found += counts.keys()
                tfs += counts.values()
                starts.append(len(found))
            at = pa.array(starts, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int64() if x is tfs else pa.int32())) for x in (found, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lengths, pa.int64()), *lists], ["id", "n", "terms", "tfs"])

    return docs.mapInArrow(run, "id bigint, n bigint, terms array<int>, tfs array<bigint>")


def _best(vectors: DataFrame, items: Items, names: pa.Array, weight: np.ndarray, k: int, floor: np.ndarray, n_docs: int, length: int) -> DataFrame:
    """(item_id, id, score): candidates of each task, among them the best k of all."""
    shared = vectors.sparkSession.sparkContext.broadcast((items, names, weight, floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, names, weight, floor = shared.value
        search = Search(items, weight, k, floor)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                lists = part.column("terms")
                start = lists.offsets.to_numpy().astype(np.int64)
                start = start - start[0]
                term = lists.flatten().to_numpy().astype(np.int64)
                tf = part.column("tfs").flatten().to_numpy()
                size = np.repeat(part.column("n").to_numpy(), np.diff(start))
                share = 10 + (90 * size * n_docs) // length
                search.block(part.column("id").to_numpy(), start, term, (1_000_000_000 * tf) // (1000 * tf + 8 * share))
        order = [x for i, (score, _) in enumerate(search.best) for x in [search.items.leaves[i]] * len(score)]
        if order:
            scores, ids = (np.concatenate(x) for x in zip(*search.best, strict=True))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(order, pa.int64())), pa.array(ids), pa.array(scores)], ["item_id", "id", "score"])

    return vectors.filter("id IS NOT NULL AND size(terms) > 0").mapInArrow(run, "item_id bigint, id bigint, score bigint")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = [F.col("score").desc(), F.col("id")]
    return top_per_group(found, ["item_id"], order, k, ["id"])


def _search(docs: DataFrame, rows: list, k: int) -> DataFrame:
    spark = docs.sparkSession
    items = Items([bytes(r["text"] or b"") for r in rows])
    names = pa.array([r["id"] for r in rows], pa.int64())
    vectors = materialise(_counted(docs, items), "term-counts")
    whole = vectors.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    if not whole["length"] or items.root is None:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    # as many rows as the items have terms
    df = {r["term"]: r["n"] for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
    weight = items.weigh(whole["docs"], df)
    floor = np.zeros(len(rows), np.int64)

    def best(part: DataFrame) -> DataFrame:
        return _best(part, items, names, weight, k, floor, whole["docs"], whole["length"])

    every = max(1, whole["docs"] // SEED_DOCS)
    if every > 1:
        sample = vectors.filter(F.pmod(F.xxhash64("id"), F.lit(every)) == 0)
        at = {r["id"]: i for i, r in enumerate(rows)}
        for r in _ranked(best(sample), k).filter(F.col("rank") == k).select("item_id", "score").collect():
            floor[at[r["item_id"]]] = r["score"]
    return _ranked(best(vectors), k).select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text"
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, scores above zero.

    Equal scores rank by the smaller id. Ids are integers. Null and empty texts have no
    term. Documents without an id count in the statistics but can't be named, so they
    aren't ranked; each of several rows of one id is a document. Items without an id
    take no part; of several texts of one item the smallest counts. Other columns are
    ignored; empty tables give an empty result.

    Items are sent to the tasks, at most about ``ITEM_BYTES`` of text at once; more
    items go through the documents in several passes. The terms of a single item
    must fit into a task.
    """
    listed = items.filter(F.col(item_col).isNotNull()).groupBy(F.col(item_col).cast("bigint").alias("id")).agg(F.min(text_col).cast("binary").alias("text"))
    listed = materialise(listed, "items")
    size = listed.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("n")).first()["n"]
    passes = 1 + size // ITEM_BYTES
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("text"))
    parts = []
    for k_pass in range(passes):
        part = listed if passes == 1 else listed.filter(F.pmod(F.xxhash64("id"), F.lit(passes)) == k_pass)
        parts.append(_search(rows, part.orderBy("id").collect(), k))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
