"""Exact top-k search by inner product, with a table of distances to pivots.

For integer vectors, the inner product is (|q|^2 + |x|^2 - d(q, x)^2) / 2, and
d(q, x) is at least |d(q, p) - d(x, p)| for any pivot p. The largest of these over
many pivots bounds the score from above. Candidates are grouped by their nearest
pivot into blocks of bounded size; a block none of whose candidates can reach a
query's k-th best score of a fixed sample is never visited, and within a block
candidates are scored in the order of their bounds until the next bound is below
the k-th score. No score above the bound exists, so results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seepage.session import materialise

PIVOTS = 24
SAMPLE = 4096  # vectors on the driver, of which pivots and first thresholds come
BLOCK = 8192
MOST_BLOCKS = 50_000  # beyond, blocks grow instead, so that their table stays small
QUERIES = 2048  # of one group
AT_ONCE = 64  # queries bounded and scored together
FIRST = 256  # candidates of the first round; each later round takes four times as many


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component as a double; null if any isn't finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(scale * x.cast("double"))))


def matrix(column: pa.Array, width: int, kind: type = np.int64) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), kind).reshape(-1, width)


def spread_pivots(vectors: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first choice: each pivot is the vector farthest from those before."""
    near = np.full(len(vectors), np.inf)
    chosen = [0]
    for _ in range(min(n, len(vectors)) - 1):
        near = np.minimum(near, ((vectors - vectors[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(near.argmax()))
    return vectors[chosen]


def to_pivots(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((vectors - p).astype(np.float64) ** 2).sum(axis=1)) for p in pivots], axis=1)


def bounds(q_norm: np.ndarray, q_dist: np.ndarray, c_norm: np.ndarray, c_low: np.ndarray, c_high: np.ndarray) -> np.ndarray:
    """Highest scores possible, query by candidate; a candidate may be a range of distances."""
    gap = np.zeros((len(q_norm), len(c_norm)))
    same = c_low is c_high
    for p in range(q_dist.shape[1]):
        q = q_dist[:, p, None]
        if same:
            np.maximum(gap, np.abs(q - c_low[:, p]), out=gap)
        else:
            np.maximum(gap, np.maximum(c_low[:, p] - q, q - c_high[:, p]), out=gap)
    total = q_norm[:, None] + c_norm
    return (total - gap**2) / 2 + 1e-9 * total + 1e-6  # room for rounding


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products; in floating point only where that is exact."""
    peak = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if peak < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


def search(
    q_ids: np.ndarray, q: np.ndarray, q_dist: np.ndarray, floor: np.ndarray, c_ids: np.ndarray, c: np.ndarray, c_dist: np.ndarray, k: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, candidate ids, scores) within one block, best first."""
    q_norm, c_norm = (q.astype(np.float64) ** 2).sum(axis=1), (c.astype(np.float64) ** 2).sum(axis=1)
    for at in range(0, len(q_ids), AT_ONCE):
        part = slice(at, at + AT_ONCE)
        high = bounds(q_norm[part], q_dist[part], c_norm, c_dist, c_dist)
        high[q_ids[part, None] == c_ids] = -np.inf
        order = np.argsort(-high, axis=1, kind="stable")
        need = floor[part].astype(np.float64).copy()
        alive = np.arange(len(need))
        found = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in alive]
        done, step = 0, FIRST
        while len(alive) and done < len(c_ids):
            upto = len(c_ids) if step > 4 * FIRST else min(done + step, len(c_ids))
            block = order[alive, done:upto]
            if upto - done > 4 * FIRST:
                scores = np.take_along_axis(products(q[part][alive], c), block, axis=1)
            else:
                scores = np.stack([products(q[part][i : i + 1], c[block[n]])[0] for n, i in enumerate(alive)])
            rest = []
            for n, i in enumerate(alive):
                bound = high[i, block[n]]
                ok = (bound >= need[i]) & (bound > -np.inf)  # the query's own row has no bound
                ids = np.concatenate([found[i][0], c_ids[block[n][ok]]])
                values = np.concatenate([found[i][1], scores[n][ok]])
                top = best(ids, values, k)
                found[i] = ids[top], values[top]
                if len(top) == k:
                    need[i] = max(need[i], values[top[-1]])
                if upto < len(c_ids) and high[i, order[i, upto]] >= need[i]:
                    rest.append(i)
            alive, done, step = np.array(rest, np.int64), upto, step * 4
        for i, (ids, scores) in enumerate(found):
            yield int(q_ids[at + i]), ids, scores


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64
) -> DataFrame:
    """(query_id, rank, id, score): the k best candidates of each query row.

    Candidates are all rows but those with the query's own id. Vectors that are
    null, or hold a null or non-finite component, take no part; rows without an
    id neither. Shorter vectors count as padded with zeros. Of rows that repeat
    an id, the largest vector in array order counts. Fewer than k candidates are
    all returned; an empty table gives an empty result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = materialise(
        vectors.select(F.col(id_col).cast("bigint").alias("id"), quantised(F.col(vector_col), scale).alias("v"), is_query.alias("asks"))
        .filter("id IS NOT NULL AND v IS NOT NULL")
        .groupBy("id")
        .agg(F.max("v").alias("v"), F.max("asks").alias("asks")),
        "search-vectors",
    )
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.count_if("asks").alias("asking")).first()
    shape = "query_id bigint, rank int, id bigint, score bigint"
    if not size["n"] or not size["width"]:
        return spark.createDataFrame([], shape)
    width = size["width"]
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("id", "v").toArrow()
    padded = [(x + [0] * width)[:width] for x in sample.column("v").to_pylist()]
    s_ids, s_vectors = np.array(sample.column("id")), np.array(padded, np.int64)
    shared = spark.sparkContext.broadcast((spread_pivots(s_vectors, PIVOTS), s_ids, s_vectors))
    n_pivots = min(PIVOTS, len(s_ids))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, _, _ = shared.value
        for batch in batches:
            values = matrix(batch.column("v"), width)
            dist = to_pivots(values, pivots)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(dist.ravel()), n_pivots).cast(pa.list_(pa.float64()))
            norm = pa.array((values.astype(np.float64) ** 2).sum(axis=1))
            near = pa.array(dist.argmin(axis=1).astype(np.int32)) if len(values) else pa.array([], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, norm, near], [*batch.schema.names, "dist", "norm", "near"])

    pad = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.get("v", i), F.lit(0)))
    table = "id bigint, v array<bigint>, asks boolean, dist array<double>, norm double, near int"
    placed = materialise(rows.select("id", pad.alias("v"), "asks").mapInArrow(place, table), "search-pivots")
    # one row per pivot
    block = max(BLOCK, size["n"] // MOST_BLOCKS)
    cells = placed.groupBy("near").agg(F.ceil(F.count("*") / block).cast("bigint").alias("parts"))
    cells = cells.withColumn("from", F.sum("parts").over(Window.orderBy("near")) - F.col("parts"))
    blocked = placed.join(F.broadcast(cells), "near").withColumn(
        "block", F.col("from") + F.pmod(F.xxhash64("id"), F.col("parts"))
    )
    # at most MOST_BLOCKS + PIVOTS rows
    ranges = (
        blocked.select("block", "norm", F.posexplode("dist").alias("pivot", "d"))
        .groupBy("block", "pivot")
        .agg(F.min("d").alias("low"), F.max("d").alias("high"), F.max("norm").alias("norm"))
        .groupBy("block")
        .agg(F.sort_array(F.collect_list(F.struct("pivot", "low", "high"))).alias("r"), F.max("norm").alias("norm"))
        .select("block", F.col("r.low").alias("low"), F.col("r.high").alias("high"), "norm")
        .toArrow()
    )
    known = spark.sparkContext.broadcast(
        (
            np.array(ranges.column("block")),
            *(matrix(ranges.column(c).combine_chunks(), n_pivots, np.float64) for c in ("low", "high")),
            np.array(ranges.column("norm")),
        )
    )

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each query and block that may hold one of its k best."""
        _, s_ids, s_vectors = shared.value
        blocks, low, high, norm = known.value
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                ids, q = np.array(batch.column("id")), matrix(batch.column("v"), width)
                dist = matrix(batch.column("dist"), n_pivots, np.float64)
                scores = products(q, s_vectors).astype(np.float64)
                scores[ids[:, None] == s_ids] = -np.inf
                floor = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(ids), -np.inf)
                reach = bounds((q.astype(np.float64) ** 2).sum(axis=1), dist, norm, low, high)
                who, where = np.nonzero(reach >= floor[:, None])
                taken = batch.take(pa.array(who))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(floor[who]), pa.array(blocks[where])], [*batch.schema.names, "floor", "block"]
                )

    chunks = size["asking"] // QUERIES + 1
    asked = placed.filter("asks").select("id", "v", "dist")
    visits = materialise(
        asked.mapInArrow(visit, "id bigint, v array<bigint>, dist array<double>, floor double, block bigint").withColumn(
            "chunk", F.pmod(F.xxhash64("id"), F.lit(chunks))
        ),
        "search-visits",
    )
    pairs = visits.select(F.col("block").alias("_block"), F.col("chunk").alias("_chunk")).distinct()
    candidates = blocked.join(pairs, F.col("block") == F.col("_block")).select("id", "v", "dist", "_block", "_chunk")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": [], "id": [], "score": []}, pa.schema([(c, pa.int64()) for c in ("query_id", "id", "score")]))

        def arrays(t: pa.Table) -> tuple[np.ndarray, ...]:
            return (
                np.array(t.column("id")),
                matrix(t.column("v").combine_chunks(), width),
                matrix(t.column("dist").combine_chunks(), n_pivots, np.float64),
            )

        found = list(search(*arrays(left), np.array(left.column("floor")), *arrays(right), k))
        return pa.table(
            {
                "query_id": np.concatenate([np.full(len(ids), q, np.int64) for q, ids, _ in found]),
                "id": np.concatenate([ids for _, ids, _ in found]).astype(np.int64),
                "score": np.concatenate([scores for _, _, scores in found]).astype(np.int64),
            }
        )

    near = (
        visits.groupBy("block", "chunk")
        .cogroup(candidates.groupBy("_block", "_chunk"))
        .applyInArrow(meet, "query_id bigint, id bigint, score bigint")
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "id", "score")
