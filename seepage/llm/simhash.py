"""SimHash near-duplicates, linked through BK-trees.

Fingerprints are made distinct first, so exact copies cost one entry. Two of them
at distance two or less agree in at least two of four 16-bit blocks; for each pair
of blocks those that agree there form a shard, six in all per fingerprint. Each
shard is indexed by a BK-tree, whose children are keyed by their distance to the
parent, and searched by following only edges within the radius. The trees of a
partition are built and walked level by level as arrays. A shard of more than
``SHARD_ROWS`` is split by two of the four bytes left, which leaves 16 bits and so
at most 65,536 entries in any tree.

All trees together are as large as the corpus, so no task could hold a broadcast
of them; each shard tree goes to the one task that searches it instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seepage.llm.common import RowBatches, released, text_batches
from seepage.llm.components import components
from seepage.operators.skew import lookup
from seepage.session import fits_broadcast, materialise

RADIUS = 2
SHINGLE = 3
SEED = 42
CHUNK = 1 << 16
SHARD_ROWS = 20_000
IDS = 1_000_000  # removed ids up to which they are broadcast
VISITS = 1 << 22  # places of (query, node) pairs held at a time


def shingles(words: list[bytes], shingle: int) -> Iterator[bytes]:
    """Every run of ``shingle`` words; fewer words are one run."""
    if len(words) < shingle:
        return iter([b" ".join(words)])
    return map(b" ".join, zip(*[words[k:] for k in range(shingle)], strict=False))


def fingerprint(text: bytes) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes."""
    words = text.lower().split()  # bytes: only A-Z change, only ASCII blanks split
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    totals = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = words[at : at + CHUNK + SHINGLE - 1]
        hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in shingles(part, SHINGLE)), "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        totals += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(totals * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of every whole text as a long; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            found = pa.array([fingerprint(t.as_py() or b"") for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), found], ["id", "fp"])

    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(released(run), f"id {rows.schema['id'].dataType.simpleString()}, fp bigint")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class Forest:
    """One BK-tree per shard; entries come sorted by shard, and are their own nodes."""

    def __init__(self, shards: np.ndarray, prints: np.ndarray) -> None:
        self.prints = prints
        n = len(prints)
        _, first, inverse, counts = np.unique(shards, return_index=True, return_inverse=True, return_counts=True)
        self.root = first[inverse]
        self.largest = int(counts.max()) if n else 0
        parent = np.full(n, -1, np.int64)
        edge = np.zeros(n, np.int64)
        at = self.root.copy()  # the node that each entry not yet placed stands at
        rest = np.flatnonzero(at != np.arange(n))
        while len(rest):
            d = distances(prints[rest], prints[at[rest]])
            key = at[rest] * 128 + d
            _, lead, back = np.unique(key, return_index=True, return_inverse=True)
            child = rest[lead]  # the first to reach a free edge becomes its node
            parent[child], edge[child] = at[child], d[lead]
            at[rest] = child[back]
            rest = rest[at[rest] != rest]
        self.nodes = np.flatnonzero(parent >= 0)
        keys = parent[self.nodes] * 128 + edge[self.nodes]
        order = np.argsort(keys, kind="stable")
        self.keys, self.nodes = keys[order], self.nodes[order]

    def near(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, entry) of one shard at the radius or nearer, once each."""
        node = self.root[queries]
        steps = np.arange(-radius, radius + 1)
        while len(queries):
            d = distances(self.prints[queries], self.prints[node])
            hit = (d <= radius) & (node < queries)
            yield queries[hit], node[hit]
            want = (node[:, None] * 128 + d[:, None] + steps)[(d[:, None] + steps) >= 0]
            who = np.broadcast_to(queries[:, None], (len(queries), len(steps)))[(d[:, None] + steps) >= 0]
            place = np.searchsorted(self.keys, want)
            ok = place < len(self.keys)
            ok[ok] = self.keys[place[ok]] == want[ok]
            queries, node = who[ok], self.nodes[place[ok]]

    def groups(self, radius: int) -> np.ndarray:
        """For each entry the first entry that it is linked to, through any number of links."""
        n = len(self.prints)
        top = np.arange(n)
        step = max(1, VISITS // max(1, self.largest))
        for at in range(0, n, step):
            for a, b in self.near(np.arange(at, min(n, at + step)), radius):
                while True:
                    ra, rb = top[a], top[b]
                    apart = ra != rb
                    if not apart.any():
                        break
                    a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
                    np.minimum.at(top, np.maximum(ra, rb), np.minimum(ra, rb))
                    while not np.array_equal(up := top[top], top):
                        top = up
        return top


def _linked(shards: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
    top = Forest(shards, prints.view(np.uint64)).groups(RADIUS)
    apart = top != np.arange(len(top))
    return pa.RecordBatch.from_arrays([pa.array(prints[apart]), pa.array(prints[top[apart]])], ["a", "b"])


def _shard_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard; a shard that a batch cuts waits for its rest."""
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        shard, prints = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "fp"))
        if not len(shard):
            continue
        waiting.append((shard, prints))
        if shard[-1] == waiting[0][0][0]:
            continue
        shard, prints = (np.concatenate(x) for x in zip(*waiting, strict=True))
        cut = int(np.searchsorted(shard, shard[-1]))
        yield _linked(shard[:cut], prints[:cut])
        waiting = [(shard[cut:], prints[cut:])]
    if waiting:
        yield _linked(*(np.concatenate(x) for x in zip(*waiting, strict=True)))


def _blocks(value: Column, width: int) -> list[Column]:
    """Every pair of the four blocks of ``width`` bits each, with the number of the pair."""
    mask = F.lit((1 << width) - 1)
    block = [F.shiftrightunsigned(value, width * k).bitwiseAND(mask) for k in range(4)]
    return [
        (F.lit(k << (2 * width)) + F.shiftleft(block[i], width) + block[j])
        for k, (i, j) in enumerate(combinations(range(4), 2))
    ]


def _crowded(rows: DataFrame, key: str) -> DataFrame:
    """Rows with ``n``, the rows of their key, where that is more than one."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
    return rows.join(counts, key)


def links(prints: DataFrame) -> DataFrame:
    """(a, b): edges that join all distinct fingerprints ``fp`` at distance two or less.

    Edges go from each entry to the first of its group within a shard, so they
    number at most six per fingerprint however dense a group is.
    """
    keyed = prints.select("fp", F.explode(F.array(*_blocks(F.col("fp"), 16))).alias("shard"))
    shared = materialise(_crowded(keyed, "shard"), "simhash-shards")
    light = shared.filter(F.col("n") <= SHARD_ROWS).select("shard", "fp")
    # the 32 bits that a shard's pair of blocks leaves, side by side
    pair = F.shiftrightunsigned("shard", 32)
    mask = F.lit(0xFFFF)
    block = [F.shiftrightunsigned("fp", 16 * k).bitwiseAND(mask) for k in range(4)]
    rest = F.lit(None).cast("bigint")
    for k, (i, j) in enumerate(combinations(range(4), 2)):
        left = [x for x in range(4) if x not in (i, j)]
        rest = F.when(pair == k, F.shiftleft(block[left[0]], 16) + block[left[1]]).otherwise(rest)
    finer = (
        shared.filter(F.col("n") > SHARD_ROWS)
        .select("fp", F.col("shard").alias("outer"), F.explode(F.array(*_blocks(rest, 8))).alias("inner"))
        .select("fp", F.xxhash64("outer", "inner").alias("shard"))
    )
    heavy = _crowded(finer, "shard").select("shard", "fp")
    rows = light.unionByName(heavy).repartition("shard").sortWithinPartitions("shard", "fp")
    return rows.mapInArrow(released(_shard_links), "a bigint, b bigint")


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp, rep, component_id), a row per row: ``rep`` stands for the component of a fingerprint."""
    rows = materialise(fingerprints(docs, id_col, text_col), "simhash-rows")
    prints = materialise(rows.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "simhash-prints")
    group = components(links(prints.select("fp"))).select(F.col("v").alias("fp"), "rep")
    named = prints.join(group, "fp", "left").withColumn("rep", F.coalesce("rep", "fp"))
    lowest = named.groupBy("rep").agg(F.min("first").alias("component_id"))
    per_print = materialise(named.join(lowest, "rep").select("fp", "n", "rep", "component_id"), "simhash-groups")
    total = prints.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    return lookup(rows, per_print, "fp", "n", ["rep", "component_id"], total)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id), one row per row of ``docs``.

    ``fingerprint`` is 16 hex digits; ``component_id`` the smallest id reachable
    over links between fingerprints that differ in two bits or fewer. Texts
    without a word have fingerprint zero and are linked like any other. Null ids
    are kept and name no component; repeated rows share one. Other columns are
    ignored; an empty table gives an empty result.
    """
    found = _grouped(docs, id_col, text_col)
    return found.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def broadcast_ids(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if fits_broadcast(ids, IDS) else ids


def _with_print(docs: DataFrame, text_col: str) -> DataFrame:
    """(doc, fp): each row as a struct, beside its fingerprint."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in RowBatches(batches, "text"):
            found = [fingerprint(t.as_py() or b"") for t in batch.column("text").cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(found, pa.int64())], ["doc", "fp"])

    return rows.mapInArrow(released(run), T.StructType([rows.schema["doc"], T.StructField("fp", T.LongType())]))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: that of the smallest id.

    Rows that share an id but not a component are different documents and judged each
    by its own component; of rows that share both, the one of the smallest fingerprint,
    then the smallest text, stays. Rows without an id stay. Columns of any name pass
    through; an empty table gives an empty result.
    """
    found = materialise(_grouped(docs, id_col, text_col).filter("id IS NOT NULL"), "simhash-found")
    gone = found.filter(F.col("id") != F.col("component_id")).select("id").distinct()
    twice = materialise(found.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"), "simhash-twice")
    alone, again = broadcast_ids(gone.unionByName(twice).distinct()), broadcast_ids(twice)
    # ids of one row need no fingerprint here
    once = docs.join(alone, docs[id_col] == alone["id"], "left_anti")
    # the few rows of repeated ids are compared by id and fingerprint
    shared = _with_print(docs.join(again, docs[id_col] == again["id"], "left_semi"), text_col)
    winners = (
        found.join(twice, "id", "left_semi").filter(F.col("id") == F.col("component_id")).groupBy("id", "rep").agg(F.min("fp").alias("fp")).select(F.col("id").alias("best"), F.col("fp").alias("best_fp"))
    )
    of_doc = F.col("doc").getField(id_col)
    kept = shared.join(winners, (of_doc == F.col("best")) & (F.col("fp") == F.col("best_fp"))).groupBy("best", "best_fp")
    first = kept.agg(F.min_by("doc", F.struct(F.col("doc").getField(text_col).isNotNull(), F.col("doc").getField(text_col))).alias("doc"))
    return once.unionByName(first.select("doc.*"))
