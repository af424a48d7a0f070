"""How close generated text is to its reference: BLEU, ROUGE, vector matching."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.types import DoubleType as Double

from seepage.functions.stem import stem
from seepage.functions.text import words
from seepage.operators.position import with_position
from seepage.operators.skew import lookup
from seepage.session import fits_broadcast, materialise


def align(refs: DataFrame, plain: DataFrame, dp: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """(pos, reference, plain, dp), cut to what all three hold.

    Each input has ``pos`` and ``text``. With ``order`` the inputs are numbered
    by those columns first, which pairs lines by place.
    """
    named = []
    for df, name in ((refs, "reference"), (plain, "plain"), (dp, "dp")):
        if order:
            places = with_position(df.select(*order), list(order))
            df = df.join(places, list(order))
        named.append(df.select("pos", F.col("text").alias(name)))
    return named[0].join(named[1], "pos").join(named[2], "pos")


def rouge_words(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _gram_array(tokens: Column, n: int) -> Column:
    """All n-grams as strings; fewer than n words give none."""
    last = F.size(tokens) - (n - 1)
    return F.when(
        last >= 1,
        F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(tokens, i, n), " ")),
    ).otherwise(F.array().cast("array<string>"))


def _gram_table(pairs: DataFrame, key: str, sizes: Sequence[int]) -> DataFrame:
    """(key, n, h, r, both): gram totals of each side and their clipped overlap.

    ``pairs`` holds word arrays ``hyp`` and ``ref``. Grams of both sides are
    counted in one shuffle on (key, n, gram), so no word can become hot.
    """
    sides = []
    for side, h, r in (("hyp", 1, 0), ("ref", 0, 1)):
        per_n = F.array(
            *[F.struct(F.lit(n).alias("n"), _gram_array(F.col(side), n).alias("g")) for n in sizes]
        )
        sides.append(
            pairs.select(key, F.explode(per_n).alias("_e"))
            .select(key, F.col("_e.n").alias("n"), F.explode("_e.g").alias("gram"))
            .select(key, "n", "gram", F.lit(h).alias("h"), F.lit(r).alias("r"))
        )
    grams = (
        sides[0]
        .unionByName(sides[1])
        .groupBy(key, "n", "gram")
        .agg(F.sum("h").alias("h"), F.sum("r").alias("r"))
    )
    return grams.groupBy(key, "n").agg(
        F.sum("h").alias("h"), F.sum("r").alias("r"), F.sum(F.least("h", "r")).alias("both")
    )


def corpus_bleu(df: DataFrame, hyp: str, ref: str, key: str = "pos") -> DataFrame:
    """One row ``bleu``: words split on white space, grams of 1 to 4, clipped
    counts over the whole corpus, add-one smoothing from bigrams on."""
    pairs = df.select(key, words(F.col(hyp)).alias("hyp"), words(F.col(ref)).alias("ref"))
    overlap = _gram_table(pairs, key, (1, 2, 3, 4))
    both = overlap.agg(
        *[F.sum(F.when(F.col("n") == n, F.col("both"))).alias(f"m{n}") for n in range(1, 5)]
    )
    # each hypothesis counts at least one gram, as in the sentence-level sums
    sizes = pairs.agg(
        *[F.sum(F.greatest(F.size("hyp") - (n - 1), F.lit(1))).alias(f"t{n}") for n in range(1, 5)],
        F.sum(F.size("hyp")).alias("hyp_len"),
        F.sum(F.size("ref")).alias("ref_len"),
    )
    # one row from each side, put side by side by a last sum
    stacked = both.unionByName(sizes, allowMissingColumns=True)
    joined = stacked.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in stacked.columns])
    logs = F.log(F.col("m1") / F.col("t1"))
    for n in (2, 3, 4):
        logs = logs + F.log((F.col(f"m{n}") + 1) / (F.col(f"t{n}") + 1))
    brevity = F.when(F.col("hyp_len") > F.col("ref_len"), F.lit(1.0)).otherwise(
        F.exp(1 - F.try_divide(F.col("ref_len").cast("double"), F.col("hyp_len").cast("double")))
    )
    return joined.select(
        F.when(F.coalesce("m1", F.lit(0)) == 0, F.lit(0.0)).otherwise(brevity * F.exp(logs / 4)).alias("bleu")
    )


def f_measure(both: Column, hyp: Column, ref: Column) -> Column:
    """Harmonic mean of both/hyp and both/ref; zero without overlap."""
    return F.when(both > 0, 2.0 * both / (hyp + ref)).otherwise(F.lit(0.0))


def stem_tokens(df: DataFrame, column: str = "token") -> DataFrame:
    """Add ``stem``; each distinct word is stemmed once."""
    counts = df.groupBy(column).agg(F.count("*").alias("_n"))
    stems = materialise(counts.withColumn("stem", stem(F.col(column))), "stems")
    if fits_broadcast(stems):
        return df.join(F.broadcast(stems.drop("_n")), column, "left")
    total = stems.agg(F.sum("_n")).first()[0] or 0
    return lookup(df, stems, column, "_n", ["stem"], total)


def word_table(df: DataFrame, columns: Sequence[str], key: str, stemmed: bool) -> DataFrame:
    """(key, one word array per column) for ROUGE, stored once for all of its forms."""
    listed = df.select(key, *[rouge_words(F.col(c)).alias(c) for c in columns])
    if stemmed:
        sides = F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("ws")) for c in columns])
        placed = listed.select(key, F.explode(sides).alias("_s")).select(
            key, F.col("_s.side").alias("side"), F.posexplode_outer("_s.ws").alias("at", "token")
        )
        stems = F.transform(
            F.filter(F.sort_array(F.collect_list(F.struct("at", "stem"))), lambda p: p["stem"].isNotNull()),
            lambda p: p["stem"],
        )
        # a text comes back together: at most one row per text and side
        listed = stem_tokens(placed).groupBy(key).pivot("side", list(columns)).agg(stems)
    return materialise(listed, "rouge-words")


def _sides(listed: DataFrame, hyp: str, ref: str, key: str) -> DataFrame:
    return listed.select(key, F.col(hyp).alias("hyp"), F.col(ref).alias("ref"))


def _rouge_n(pairs: DataFrame, n: int, key: str) -> DataFrame:
    overlap = _gram_table(pairs, key, (n,))
    name = f"rouge{n}"
    scored = overlap.select(key, f_measure(F.col("both"), F.col("h"), F.col("r")).alias(name))
    return pairs.select(key).join(scored, key, "left").select(key, F.coalesce(name, F.lit(0.0)).alias(name))


def rouge_n(
    df: DataFrame, hyp: str, ref: str, n: int = 1, key: str = "pos", stemmed: bool = True
) -> DataFrame:
    """(key, rouge<n>): F-measure of the n-gram overlap of each pair."""
    return _rouge_n(_sides(word_table(df, (hyp, ref), key, stemmed), hyp, ref, key), n, key)


def lcs_length(a: Sequence[str], b: Sequence[str]) -> int:
    """Length of the longest common subsequence, one bit per word of ``a``."""
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & where.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in parts of a few rows, so that a worker holds little beside them."""
    for batch in batches:
        for at in range(0, batch.num_rows, PART_ROWS):
            yield batch.slice(at, PART_ROWS)
        pa.default_memory_pool().release_unused()


def _cells(listed: pa.ListArray) -> np.ndarray:
    """Where each row's items begin and end in the flat column."""
    places = listed.offsets.to_numpy()
    return places - places[0]


def _rouge_l(pairs: DataFrame, key: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            hyp, ref = batch.column("hyp"), batch.column("ref")
            flat = pa.concat_arrays([hyp.flatten(), ref.flatten()]).dictionary_encode().indices.to_pylist()
            h, r = _cells(hyp), _cells(ref) + len(hyp.flatten())
            both = [lcs_length(flat[h[i] : h[i + 1]], flat[r[i] : r[i + 1]]) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(both, pa.int32()), *(pa.array(np.diff(c), pa.int32()) for c in (h, r))], [key, "both", "h", "r"])

    shape = StructType([pairs.schema[key], *[StructField(c, IntegerType()) for c in ("both", "h", "r")]])
    counted = pairs.select(key, "hyp", "ref").mapInArrow(run, shape)
    return counted.select(key, f_measure(F.col("both"), F.col("h"), F.col("r")).alias("rougeL"))


def rouge_l(df: DataFrame, hyp: str, ref: str, key: str = "pos", stemmed: bool = True) -> DataFrame:
    """(key, rougeL): F-measure of the longest common subsequence of each pair."""
    return _rouge_l(_sides(word_table(df, (hyp, ref), key, stemmed), hyp, ref, key), key)


_MATCH = StructType([StructField("precision", Double()), StructField("recall", Double())])
VECTOR_BYTES = 16 << 20  # of a vector table that is broadcast, and of a tile's vectors
PART_ROWS = 500  # pairs that a worker takes at a time
_ROWS = 512  # rows of a similarity matrix held at a time


def _best(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Largest cosine of each row of ``a`` against the rows of ``b``."""
    return np.concatenate([(a[i : i + _ROWS] @ b.T).max(axis=1) for i in range(0, len(a), _ROWS)])


def _pair_match(known: np.ndarray, unit: np.ndarray, sides: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[float, float]:
    """Precision and recall of one pair from the ids and counts of its words; ``known`` is sorted."""
    found = []
    for wanted, count in sides:
        at = np.minimum(np.searchsorted(known, wanted), max(len(known) - 1, 0))
        has = known[at] == wanted if len(known) else np.zeros(len(wanted), bool)
        if not has.any():
            return 0.0, 0.0
        found.append((unit[at[has]], count[has]))
    (hv, hc), (rv, rc) = found
    return float(_best(hv, rv) @ hc / hc.sum()), float(_best(rv, hv) @ rc / rc.sum())


def _unit(matrix: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norm == 0, 1.0, norm)


def _match_ids(listed: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """(key, precision, recall) from ids and counts; one broadcast matrix holds the vectors."""
    spark = listed.sparkSession
    table = vectors.select("vec_id", "vector").toArrow()
    ids = np.array(table.column("vec_id"))
    order = np.argsort(ids)
    flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    matrix = np.asarray(flat, np.float64).reshape(len(ids), -1)[order]
    shared = spark.sparkContext.broadcast((ids[order], _unit(matrix)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, unit = shared.value
        for batch in _parts(batches):
            sides = []
            for name in ("hyp", "ref"):
                flat, cells = batch.column(name).flatten(), _cells(batch.column(name))
                wanted, count = (pc.struct_field(flat, k).to_numpy(zero_copy_only=False).astype(kind) for k, kind in enumerate((np.int64, np.float64)))
                sides.append([(wanted[a:b], count[a:b]) for a, b in zip(cells, cells[1:])])
            out = np.array([_pair_match(known, unit, pair) for pair in zip(*sides)], np.float64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out[:, 0]), pa.array(out[:, 1])], [key, "precision", "recall"])

    return listed.select(key, "hyp", "ref").mapInArrow(run, StructType([listed.schema[key], *_MATCH.fields]))


def _match_tiled(counted: DataFrame, vectors: DataFrame, key: str, numbers: int) -> DataFrame:
    """The same for vectors beyond a broadcast, in tiles of pairs.

    A tile is as many pairs as have about ``VECTOR_BYTES`` of vectors, were all their
    words different. It gets each vector that its pairs need once, however many of
    them and of their words do, and answers all of them.
    """
    counted = materialise(counted, "vector-counts")
    rows = counted.count()
    width = max(1, -(-numbers // max(1, vectors.count())))
    tiles = rows // max(1, VECTOR_BYTES // (8 * width)) + 1
    placed = counted.withColumn("_tile", F.pmod(F.xxhash64(key), F.lit(tiles)))
    needed = materialise(placed.select("_tile", "vec_id").distinct(), "tile-words")
    weights = needed.groupBy("vec_id").agg(F.count("*").alias("_n"))
    weighted = materialise(vectors.join(weights, "vec_id"), "vector-weights")
    total = weighted.agg(F.sum("_n")).first()[0] or 0
    held = lookup(needed, weighted, "vec_id", "_n", ["vector"], total, "inner")

    def answer(words: pa.Table, table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy().astype(np.int64)
        order = np.argsort(ids)
        known, unit = ids[order], np.empty((0, 1))
        if len(known):
            flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            unit = _unit(np.asarray(flat, np.float64).reshape(len(known), -1)[order])
        rows = words.sort_by([(key, "ascending"), ("side", "ascending")])
        code = rows.column(key).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        wanted, count = rows.column("vec_id").to_numpy().astype(np.int64), rows.column("c").to_numpy().astype(np.float64)
        hyp = pc.equal(rows.column("side"), "hyp").to_numpy()
        starts = np.flatnonzero(np.diff(code, prepend=-1))
        out = []
        for a, b in zip(starts, [*starts[1:], len(code)]):
            middle = a + int(hyp[a:b].sum())
            out.append(_pair_match(known, unit, [(wanted[a:middle], count[a:middle]), (wanted[middle:b], count[middle:b])]))
        found = np.array(out, np.float64).reshape(-1, 2)
        names = rows.column(key).take(pa.array(starts, pa.int64()))
        return pa.table({key: names, "precision": found[:, 0], "recall": found[:, 1]})

    shape = StructType([counted.schema[key], *_MATCH.fields])
    return placed.groupBy("_tile").cogroup(held.groupBy("_tile")).applyInArrow(answer, shape)


def greedy_cosine_match(
    df: DataFrame,
    hyp: str,
    ref: str,
    vectors: DataFrame,
    token_id: Column,
    key: str = "pos",
) -> DataFrame:
    """(key, precision, recall, f1): mean of each word's best cosine on the
    other side.

    ``vectors`` has ``vec_id`` and ``vector``; ``token_id`` maps the column
    ``token`` to a vec_id. A repeated word is matched once and weighted by its
    count. Words without a vector are left out.
    """
    sides = F.array(
        F.struct(F.lit("hyp").alias("side"), words(F.col(hyp)).alias("ws")),
        F.struct(F.lit("ref").alias("side"), words(F.col(ref)).alias("ws")),
    )
    counted = (
        df.select(key, F.explode(sides).alias("_s"))
        .select(key, F.col("_s.side").alias("side"), F.explode("_s.ws").alias("token"))
        .select(key, "side", token_id.alias("vec_id"))
        .filter(F.col("vec_id").isNotNull())
        .groupBy(key, "side", "vec_id")
        .agg(F.count("*").alias("c"))
    )
    size = vectors.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("vector")), F.lit(0)).alias("numbers")).first()
    if size["numbers"] * 8 <= VECTOR_BYTES:
        listed = counted.groupBy(key).pivot("side", ["hyp", "ref"]).agg(F.collect_list(F.struct("vec_id", "c")))
        scored = _match_ids(listed, vectors, key)
    else:
        scored = _match_tiled(counted, vectors, key, size["numbers"])
    p, r, zero = F.col("precision"), F.col("recall"), F.lit(0.0)
    return (
        df.select(key)
        .join(scored, key, "left")
        .select(key, F.coalesce(p, zero).alias("precision"), F.coalesce(r, zero).alias("recall"))
        .withColumn("f1", F.when(p + r != 0, 2 * p * r / (p + r)).otherwise(zero))
    )


def metric_report(
    df: DataFrame,
    vectors: DataFrame,
    token_id: Column,
    variants: Sequence[str] = ("plain", "dp"),
    reference: str = "reference",
    stemmed: bool = True,
    key: str = "pos",
) -> DataFrame:
    """(metric, plain, dp): BLEU in percent, ROUGE F-measures, and precision,
    recall and F1 of the vector match, side by side."""
    rows = None
    listed = word_table(df, (reference, *variants), key, stemmed)
    for variant in variants:
        pairs = _sides(listed, variant, reference, key)
        match = greedy_cosine_match(df, variant, reference, vectors, token_id, key)
        parts = [corpus_bleu(df, variant, reference, key).select(F.lit("bleu").alias("metric"), (F.col("bleu") * 100).alias("v"))]
        for name, scored in (
            ("rouge1", _rouge_n(pairs, 1, key)),
            ("rouge2", _rouge_n(pairs, 2, key)),
            ("rougeL", _rouge_l(pairs, key)),
        ):
            parts.append(scored.agg(F.avg(name).alias("v")).select(F.lit(name).alias("metric"), "v"))
        means = match.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])
        parts.append(
            means.selectExpr("stack(3, 'precision', precision, 'recall', recall, 'f1', f1) AS (metric, v)")
        )
        for part in parts:
            part = part.withColumn("variant", F.lit(variant))
            rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("metric").pivot("variant", list(variants)).agg(F.first("v"))
