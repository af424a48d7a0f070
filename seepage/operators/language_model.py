"""N-gram language models counted in Spark, scoring and ranking of samples.

A model is a table of gram counts (ord, context, token, n); ``context`` is the
ord-1 preceding words joined by a space. Probabilities mix each order with the
one below:

    p1(w)   = (n(w) + 1) / (N + V + 1)
    pk(w|c) = (n(c,w) + mu * pk-1(w|c')) / (n(c) + mu)

so an unseen word or context still has a positive probability. Words keep their
case.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from seepage.operators.position import with_position
from seepage.operators.skew import heavy_floor, lookup, top_per_group
from seepage.operators.tokens import END, token_words
from seepage.session import bucketed, fits_broadcast, joined_by_bucket, materialise

GRAM_KEY = ["ord", "context", "token"]
CONTEXT_KEY = ["ord", "context"]

GRAM_WORDS = 1 << 21  # words whose grams a task counts before it hands them on
TEXT_CHARS = 1 << 20  # of text that is split at a time
GRAM_PARTS = 512  # parts that grams are dealt to by context, single words by themselves


def _placed(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """(keys, _ws, at, token): every word with its place, counted from 1."""
    listed = df.select(*keys, token_words(F.col(column)).alias("_ws"))
    # places come from the array itself, and the rows of no word go afterwards: an inner
    # explode makes Spark filter on the array's size, which tokenises each text twice more
    every = listed.select(*keys, "_ws", F.posexplode_outer("_ws").alias("_i", "token"))
    return every.filter(F.col("_i").isNotNull()).withColumn("at", F.col("_i") + 1)


def _before(k: int) -> Column:
    """The k-1 words before the current one; null where there are fewer."""
    at = F.col("at")
    if k == 1:
        return F.lit("")
    if k == 2:
        return F.when(at > 1, F.get("_ws", at - 2))
    return F.when(at >= k, F.array_join(F.slice("_ws", F.greatest(at - (k - 1), F.lit(1)), F.lit(k - 1)), " "))


def grams(df: DataFrame, order: int, keys: Sequence[str] = (), column: str = "text") -> DataFrame:
    """Every gram of orders 1..order: (keys, at, ord, context, token)."""
    options = F.array(
        *[F.struct(F.lit(k).alias("ord"), _before(k).alias("context")) for k in range(1, order + 1)]
    )
    return (
        _placed(df, keys, column)
        .select(*keys, "at", "token", F.explode(options).alias("_g"))
        .select(*keys, "at", F.col("_g.ord").alias("ord"), F.col("_g.context").alias("context"), "token")
        .filter(F.col("context").isNotNull())
    )


def _longest(df: DataFrame, order: int, column: str) -> DataFrame:
    """(ord, context, token, n) of the longest gram at each word, grouped."""
    context = F.coalesce(*[_before(k) for k in range(order, 0, -1)])
    return (
        _placed(df, (), column)
        .select(F.least(F.col("at"), F.lit(order)).alias("ord"), context.alias("context"), "token")
        .groupBy(*GRAM_KEY)
        .agg(F.count("*").alias("n"))
    )


def _by_order(longest: DataFrame, order: int) -> dict[int, DataFrame]:
    """The counts of each order, from those of the longest grams.

    A shorter gram occurs where it is the longest, and in every longer one that ends in it.
    """
    found = {order: longest.filter(F.col("ord") == order)}
    for k in range(order - 1, 0, -1):
        shortened = found[k + 1].select(F.lit(k).alias("ord"), _last_words(k - 1).alias("context"), "token", "n")
        found[k] = (
            longest.filter(F.col("ord") == k)
            .unionByName(shortened)
            .groupBy(*GRAM_KEY)
            .agg(F.sum("n").alias("n"))
        )
    return found


class _Words:
    """Words of many texts as numbers: ids into ``words``, with the place in their text and its row."""

    def __init__(self, texts: Sequence[str | None]):
        parts, lengths, held, size = [], [], [], 0
        for text in itertools.chain(texts, [None]):
            # the words of token_words: both know the same characters as white space
            held.append(text.replace(END, f" {END} ").split() if text else [])
            size += len(text or "")
            if size >= TEXT_CHARS or len(lengths) + len(held) > len(texts):
                lengths += map(len, held)
                parts.append(pa.array([*itertools.chain.from_iterable(held)], pa.string()))
                held, size = [], 0
        coded = pa.concat_arrays(parts).dictionary_encode()
        self.words, self.ids = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        self.row = np.repeat(np.arange(len(lengths)), lengths)
        starts = np.cumsum(lengths) - lengths
        self.at = np.arange(len(self.ids)) - starts[self.row] + 1

    def spots(self, k: int, where: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """Contexts of k-1 words, and which of them stands before each of the places."""
        if k == 1:
            return pa.array([""], pa.string()), np.zeros(len(where), np.int64)
        if k == 2:
            return self.words, self.ids[where - 1]
        # a run of words is the one without its last word, and that word
        run = self.ids[where - (k - 1)]
        for back in range(k - 2, 0, -1):
            run = np.unique(run * len(self.words) + self.ids[where - back], return_inverse=True)[1]
        _, first, which = np.unique(run, return_index=True, return_inverse=True)
        ids = np.stack([self.ids[where[first] - back] for back in range(k - 1, 0, -1)], axis=1)
        listed = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * (k - 1), pa.int32()), self.words.take(pa.array(ids.ravel())))
        return pc.binary_join(listed, " "), which


def _grouped(columns: Sequence[tuple[np.ndarray, int]], weights: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of columns of numbers below a bound each, sorted, and how often each is there or the sum of its weights.

    Rows are sorted as one number with their weight in its last digits, if that has room for them.
    """
    many = len(columns[0][0])
    if not many:
        return [c for c, _ in columns], np.zeros(0, np.int64)
    bits = [(most - 1).bit_length() for _, most in columns]
    low = 0 if weights is None else int(weights.max()).bit_length()
    if sum(bits) + low <= 63:
        rows = np.zeros(many, np.int64)
        for (column, _), width in zip(columns, bits, strict=True):
            rows = (rows << width) | column
        if low:
            rows = (rows << low) | weights
        rows.sort()
        each, rows = (rows & ((1 << low) - 1), rows >> low) if low else (None, rows)
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        rows, found = rows[starts], []
        for width in reversed(bits):
            found.insert(0, rows & ((1 << width) - 1))
            rows = rows >> width
    else:
        order = np.lexsort([c for c, _ in reversed(columns)])
        ordered = [c[order] for c, _ in columns]
        starts = np.flatnonzero(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in ordered])])
        each, found = None if weights is None else weights[order], [c[starts] for c in ordered]
    return found, np.diff(np.r_[starts, many]) if each is None else np.add.reduceat(each, starts)


def _part(key: Column) -> Column:
    """The part that holds a context or a single word."""
    return F.pmod(F.crc32(key), F.lit(GRAM_PARTS)).cast("int")


def _coded(values: pa.Array | pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """Distinct values, null among them, and the number of each row's value."""
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    coded = values.dictionary_encode(null_encoding="encode")
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64)


def _packed(texts: pa.Table, order: int, lowest: int) -> Iterator[pa.RecordBatch]:
    """(part, grams): the counted grams of some texts, a small compressed table for each part."""
    told = _Words(texts.column("text").to_pylist())
    units, unit = _coded(texts.column("_by"))
    weights = texts.column("_times").to_numpy() if "_times" in texts.column_names else None
    if weights is not None and (weights == 1).all():
        weights = None
    word_parts = _parts(told.words)
    for k in range(lowest, order + 1):
        where = np.flatnonzero(told.at >= k)
        contexts, which = (told.words, told.ids[where]) if k == 1 else told.spots(k, where)
        place = word_parts if k < 3 else _parts(contexts)
        by_part = np.argsort(place)
        rank = np.empty(len(by_part), np.int64)
        rank[by_part] = np.arange(len(by_part))
        columns = [(rank[which], len(contexts)), (unit[told.row[where]], len(units))]
        columns += [] if k == 1 else [(told.ids[where], len(told.words))]
        (ranked, of, *last), n = _grouped(columns, None if weights is None else weights[told.row[where]])
        table = pa.table(
            {
                "_by": units.take(pa.array(of)),
                "ord": pa.array(np.full(len(of), k), pa.int32()),
                "key": contexts.take(pa.array(by_part[ranked])),
                "token": told.words.take(pa.array(last[0])) if last else pa.nulls(len(of), pa.string()),
                "n": pa.array(n, pa.int64()),
            }
        )
        cuts = np.searchsorted(place[by_part[ranked]], np.arange(GRAM_PARTS + 1))
        parts = np.flatnonzero(np.diff(cuts))
        blobs = [_written(table.slice(cuts[x], cuts[x + 1] - cuts[x])) for x in parts]
        yield from pa.table({"part": pa.array(parts, pa.int32()), "grams": pa.array(blobs, pa.binary())}).to_batches(256)


def _parts(keys: pa.Array) -> np.ndarray:
    """What ``_part`` gives for each of the keys."""
    return np.array([zlib.crc32(x.encode()) % GRAM_PARTS for x in keys.to_numpy(zero_copy_only=False)], np.int64)


def _written(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _merged(part: int, blobs: Sequence[bytes]) -> pa.Table:
    """The grams of a part, counted over all its tables; the first one of a context has its total."""
    rows = pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in blobs])
    units, unit = _coded(rows.column("_by"))
    keys, key = _coded(rows.column("key"))
    words, word = _coded(rows.column("token"))
    order = rows.column("ord").to_numpy().astype(np.int64)
    columns = [(key, len(keys)), (unit, len(units)), (order, int(order.max()) + 1), (word, len(words))]
    (key, unit, order, word), n = _grouped(columns, rows.column("n").to_numpy())
    first = np.r_[True, (key[1:] != key[:-1]) | (unit[1:] != unit[:-1]) | (order[1:] != order[:-1])]
    totals = np.zeros(len(n), np.int64)
    totals[first] = np.add.reduceat(n, np.flatnonzero(first))
    return pa.table(
        {
            "_by": units.take(pa.array(unit)),
            "part": pa.array(np.full(len(n), part), pa.int32()),
            "ord": pa.array(order, pa.int32()),
            "key": keys.take(pa.array(key)),
            "token": words.take(pa.array(word)),
            "n": pa.array(n, pa.int64()),
            "total": pa.array(totals, pa.int64(), mask=~first | (order == 1)),
        }
    )


def keyed_grams(df: DataFrame, order: int, column: str = "text", by: str | None = None, times: Column | None = None, lowest: int = 1) -> DataFrame:
    """(_by, part, ord, key, token, n, total): grams of the orders ``lowest`` to ``order``, counted by the value of ``by``.

    ``key`` is the context, and of single words the word itself, whose ``token`` is null.
    All grams of a key have one ``part``, a hash of it; a part is in one task, and one of a
    context's grams has the ``total`` of the context. A text counts as often as ``times``
    tells. Tasks count the grams of many texts at a time, and only what they found moves.
    """
    unit = F.col(by) if by else F.lit(None).cast("int")
    texts = df.select(unit.alias("_by"), F.col(column).alias("text"), *([times.cast("bigint").alias("_times")] if times is not None else []))
    kind = texts.schema["_by"].dataType
    out = StructType([StructField("_by", kind), *[StructField(c, IntegerType()) for c in ("part", "ord")], *[StructField(c, StringType()) for c in ("key", "token")], *[StructField(c, LongType()) for c in ("n", "total")]])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, held, size = 6 * GRAM_WORDS, [], 0  # about six bytes a word
        for batch in batches:
            sizes, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()), 0
            while at < batch.num_rows:
                before = sizes[at - 1] if at else 0
                end = min(batch.num_rows, int(np.searchsorted(sizes, before + most - size)) + 1)
                held.append(batch.slice(at, end - at))
                size, at = size + sizes[end - 1] - before, end
                if size >= most:
                    yield from _packed(pa.Table.from_batches(held), order, lowest)
                    held, size = [], 0
        if held:
            yield from _packed(pa.Table.from_batches(held), order, lowest)
        pa.default_memory_pool().release_unused()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for part, grams_of in zip(batch.column("part").to_pylist(), batch.column("grams").to_pylist(), strict=True):
                held.setdefault(part, []).append(grams_of)
        for part in list(held):
            yield from _merged(part, held.pop(part)).to_batches(10_000)
        pa.default_memory_pool().release_unused()

    number = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return texts.mapInArrow(pack, "part int, grams binary").repartition(number, "part").mapInArrow(merge, out)


def unkeyed(df: DataFrame, *more: str) -> DataFrame:
    """(more, ord, context, token, n) of keyed grams."""
    single = F.col("ord") == 1
    context, token = F.when(single, F.lit("")).otherwise(F.col("key")), F.when(single, F.col("key")).otherwise(F.col("token"))
    return df.select(*more, "ord", context.alias("context"), token.alias("token"), "n")


def _together(tables: Mapping[int, DataFrame]) -> DataFrame:
    out = None
    for table in tables.values():
        out = table if out is None else out.unionByName(table)
    return out


def count_grams(df: DataFrame, order: int, column: str = "text") -> DataFrame:
    """(ord, context, token, n) of all orders; only the longest gram at each word is counted from the text."""
    return _together(_by_order(materialise(_longest(df, order, column), "longest-grams"), order))


@dataclass(frozen=True)
class LanguageModel:
    """Gram counts with the settings that turn them into probabilities."""

    counts: DataFrame  # ord, context, token, n
    order: int
    mu: float = 10.0
    context_totals: DataFrame | None = None  # part, ord, context, total
    by_order: Mapping[int, DataFrame] | None = None  # the counts of each order, with their part

    def placed(self, k: int) -> DataFrame:
        """The counts of an order with their ``part``."""
        return self.by_order[k] if self.by_order else self.counts.filter(F.col("ord") == k).withColumn("part", _part(F.col("token" if k == 1 else "context")))

    def of_order(self, k: int) -> DataFrame:
        return self.placed(k).drop("part")

    def small(self) -> LanguageModel:
        """The model of order one over the same counts."""
        return LanguageModel(self.of_order(1), 1, self.mu, None, {1: self.placed(1)})

    def totals(self) -> tuple[float, int]:
        """Words counted and distinct words."""
        row = self.of_order(1).agg(F.sum("n").alias("words"), F.count("*").alias("types")).first()
        return float(row["words"] or 0), row["types"]

    def placed_contexts(self) -> DataFrame:
        """The totals of contexts with their ``part``."""
        if self.context_totals is not None:
            return self.context_totals
        sums = self.counts.filter(F.col("ord") > 1).groupBy(*CONTEXT_KEY).agg(F.sum("n").alias("total"))
        return sums.withColumn("part", _part(F.col("context")))

    def contexts(self) -> DataFrame:
        return self.placed_contexts().drop("part")


def _of_orders(kept: DataFrame, order: int) -> dict[int, DataFrame]:
    """The counts of each order of a table of keyed grams."""
    single = kept.filter(F.col("ord") == 1).select("part", "ord", F.lit("").alias("context"), F.col("key").alias("token"), "n")
    several = {k: kept.filter(F.col("ord") == k).select("part", "ord", F.col("key").alias("context"), "token", "n") for k in range(2, order + 1)}
    return {1: single, **several}


def stored_model(counts: DataFrame, order: int, mu: float = 10.0) -> LanguageModel:
    """The model as tables in buckets by part: scoring moves none of them."""
    single = F.col("ord") == 1
    key = F.when(single, F.col("token")).otherwise(F.col("context"))
    keyed = counts.select(_part(key).alias("part"), "ord", key.alias("key"), F.when(~single, F.col("token")).alias("token"), "n")
    kept = bucketed(keyed, ["part"], "gram-counts")
    totals = None
    if order > 1:
        sums = kept.filter(F.col("ord") > 1).groupBy("part", "ord", F.col("key").alias("context")).agg(F.sum("n").alias("total"))
        totals = bucketed(sums, ["part"], "context-totals", grouped=True)
    return LanguageModel(unkeyed(kept), order, mu, totals, _of_orders(kept, order))


def fit_ngram_lm(df: DataFrame, order: int = 2, mu: float = 10.0, column: str = "text") -> LanguageModel:
    """Count all grams of a corpus; counts are combined before the shuffle."""
    kept = bucketed(keyed_grams(df, order, column).drop("_by"), ["part"], "gram-counts", grouped=True)
    totals = kept.filter(F.col("total").isNotNull()).select("part", "ord", F.col("key").alias("context"), "total")
    return LanguageModel(unkeyed(kept), order, mu, totals if order > 1 else None, _of_orders(kept, order))


def _last_words(n: int) -> Column:
    """The last words of the context; all of them where there are no more."""
    return F.substring_index("context", " ", -n) if n else F.lit("")


def probabilities(lm: LanguageModel) -> DataFrame:
    """(ord, context, token, n, p) for the grams of the model."""
    words, types = lm.totals()
    lower = lm.of_order(1).withColumn("p", (F.col("n") + 1) / F.lit(words + types + 1))
    result = lower
    totals = lm.contexts()
    for k in range(2, lm.order + 1):
        shorter = lower.select(
            F.col("context").alias("_short"), F.col("token"), F.col("p").alias("_below")
        )
        lower = (
            lm.of_order(k)
            .join(totals.filter(F.col("ord") == k).drop("ord"), "context", "left")
            .withColumn("_short", _last_words(k - 2))
            .join(shorter, ["_short", "token"])
            .withColumn(
                "p",
                (F.col("n") + F.lit(lm.mu) * F.col("_below")) / (F.coalesce("total", F.lit(0)) + F.lit(lm.mu)),
            )
            .select(*GRAM_KEY, "n", "p")
        )
        result = result.unionByName(lower)
    return result.select(*GRAM_KEY, "n", "p")


def model_table(lm: LanguageModel) -> DataFrame:
    """Counts and probabilities of every gram in the model."""
    return probabilities(lm)


def _told(wanted: DataFrame, tables: Mapping[str, DataFrame], keys: Sequence[str], value: str, few: bool) -> DataFrame:
    """``wanted`` with a column per model, null where a model's table lacks the row.

    ``few`` wanted rows are broadcast to the tables and what they hit is joined back;
    more move once to the tables' buckets, which stay where they are.
    """
    out = wanted
    for name, table in tables.items():
        named = table.select(*keys, F.col(value).cast("double").alias(f"{value}_{name}"))
        if few:
            named = named.join(F.broadcast(wanted.select(*keys).distinct()), list(keys))
        # the wanted rows are the smaller side, so that the tables need not be sorted
        out = out.hint("shuffle_hash").join(named, list(keys), "left")
    return out


def gram_scores(wanted: DataFrame, models: Mapping[str, LanguageModel], few: bool = False) -> DataFrame:
    """(ord, context, token, p_<model>...) of ``wanted`` grams, seen or not, under every model.

    A gram longer than a model's order has the probability of its longest part that
    the model knows of: counts and totals come from the models' stored tables, and
    what a gram lacks from the grams below it. ``few`` tells that a broadcast holds them.
    """
    top = max(m.order for m in models.values())
    sizes = {n: m.totals() for n, m in models.items()}
    number = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def placed(df: DataFrame, k: int) -> DataFrame:
        # contexts and words lie where the tables' buckets are
        told = df.withColumn("part", _part(F.col("token" if k == 1 else "context")))
        return (told if few else told.repartition(number, "part")).distinct()

    rows = {top: placed(wanted.filter(F.col("ord") == top), top)}
    for k in range(top - 1, 0, -1):
        shortened = rows[k + 1].select(F.lit(k).alias("ord"), _last_words(k - 1).alias("context"), "token").distinct()
        rows[k] = placed(wanted.filter(F.col("ord") == k).unionByName(shortened), k)
    below = _told(rows[1], {n: m.placed(1) for n, m in models.items()}, ["part", "token"], "n", few).select(
        *GRAM_KEY, *[((F.coalesce(f"n_{n}", F.lit(0.0)) + 1) / F.lit(sum(sizes[n]) + 1)).alias(f"p_{n}") for n in models]
    )
    out = below
    for k in range(2, top + 1):
        knowing = {n: m for n, m in models.items() if m.order >= k}
        counted = _told(rows[k], {n: m.placed(k) for n, m in knowing.items()}, ["part", "context", "token"], "n", few)
        totals = {n: m.placed_contexts().filter(F.col("ord") == k) for n, m in knowing.items()}
        counted = _told(counted, totals, ["part", "context"], "total", few)
        shorter = below.select(F.col("context").alias("_short"), F.col("token").alias("_token"), *[F.col(f"p_{n}").alias(f"_b_{n}") for n in models])
        joined = counted.withColumn("_s", _last_words(k - 2)).join(shorter, (F.col("_s") == F.col("_short")) & (F.col("token") == F.col("_token")))
        below = joined.select(*GRAM_KEY, *[_interpolated(n, m, k).alias(f"p_{n}") for n, m in models.items()])
        out = out.unionByName(below)
    return out


def _interpolated(name: str, lm: LanguageModel, k: int) -> Column:
    low = F.col(f"_b_{name}")
    if k > lm.order:
        return low
    return (F.coalesce(f"n_{name}", F.lit(0.0)) + F.lit(lm.mu) * low) / (F.coalesce(f"total_{name}", F.lit(0.0)) + F.lit(lm.mu))


def _own_grams(texts: DataFrame, top: int, keys: Sequence[str]) -> DataFrame:
    """(keys, _gram, _c): the longest gram at each word but the first, counted in each text by itself."""
    kept = [texts.schema[k] for k in keys]
    names = ["ord", "context", "token", "_c"]
    kinds = [IntegerType(), StringType(), StringType(), LongType()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                told = _Words(part.column("text").to_pylist())
                for k in range(min(top, 2), top + 1):
                    where = np.flatnonzero((told.at > 1) & (np.minimum(told.at, top) == k))
                    contexts, which = told.spots(k, where)
                    counted = [(told.row[where], part.num_rows), (which, len(contexts)), (told.ids[where], len(told.words))]
                    (row, context, token), n = _grouped(counted)
                    columns = [part.column(c.name).take(pa.array(row)) for c in kept]
                    columns += [pa.array(np.full(len(n), k), pa.int32()), contexts.take(pa.array(context)), told.words.take(pa.array(token)), pa.array(n, pa.int64())]
                    yield from pa.table(columns, [*keys, *names]).to_batches(10_000)

    rows = texts.select(*keys, "text").mapInArrow(run, StructType([*kept, *[StructField(n, t) for n, t in zip(names, kinds)]]))
    return rows.select(*keys, F.struct(*GRAM_KEY).alias("_gram"), "_c")


def _losses(
    df: DataFrame, models: Mapping[str, LanguageModel], key: str, lower: str | None = None, weight: str | None = None
) -> DataFrame:
    """(key, nll_<model>..., predicted): summed loss over all words but the first.

    Every word counts with the longest gram that some model knows of, once per text
    and gram; grams that very many texts hold are broadcast instead of shuffled. With
    ``lower`` the lower-cased texts go along, and nll_lower and predicted_lower are
    theirs under that model. A text counts ``weight`` times.
    """
    top = max(m.order for m in models.values())
    times = F.col(weight) if weight else F.lit(1)
    texts = df.select(key, F.lit(0).alias("_kind"), times.alias("_times"), "text")
    if lower:
        texts = texts.unionByName(df.select(key, F.lit(1).alias("_kind"), times.alias("_times"), F.lower("text").alias("text")))
    if weight:
        context = F.coalesce(*[_before(k) for k in range(top, 0, -1)])
        spots = _placed(texts, [key, "_kind", "_times"], "text").filter(F.col("at") > 1)
        gram = F.struct(F.least(F.col("at"), F.lit(top)).alias("ord"), context.alias("context"), F.col("token").alias("token"))
        own = spots.groupBy(key, "_kind", gram.alias("_gram")).agg(F.sum("_times").alias("_c"))
    else:
        own = _own_grams(texts.drop("_times"), top, [key, "_kind"])
    own = materialise(own, "sample-grams")
    few = fits_broadcast(own.select("_gram.*"))
    wanted = own
    if not few and not weight:
        wanted = materialise(own.groupBy("_gram").agg(F.count("*").alias("_n")), "wanted-grams")
    scores = gram_scores(wanted.select("_gram.*"), models, few)
    with joined_by_bucket(df.sparkSession):
        scores = materialise(scores.select(F.struct(*GRAM_KEY).alias("_g"), *[f"p_{n}" for n in models]), "gram-probabilities")
    if few:
        scored = own.join(F.broadcast(scores), F.col("_gram") == F.col("_g"))
    elif weight:
        # keys that stand for many texts are few, and so are the rows of a gram
        scored = own.join(scores, F.col("_gram") == F.col("_g"))
    else:
        total = wanted.agg(F.sum("_n")).first()[0] or 0
        # the lookup asks only which grams are heavy
        heavy = F.broadcast(wanted.filter(F.col("_n") > heavy_floor(total)))
        table = scores.join(heavy, F.col("_g") == F.col("_gram"), "left").select(
            F.col("_g").alias("_gram"), F.coalesce("_n", F.lit(0)).alias("_n"), *[f"p_{n}" for n in models]
        )
        # the probabilities are the smaller side, so that the samples' grams need not be sorted
        scored = lookup(own, table.hint("shuffle_hash"), "_gram", "_n", [f"p_{n}" for n in models], total, "inner")
    plain, low = F.col("_kind") == 0, F.col("_kind") == 1
    sums = [F.sum(F.when(plain, -F.log(f"p_{n}") * F.col("_c"))).alias(f"nll_{n}") for n in models]
    sums.append(F.sum(F.when(plain, F.col("_c"))).alias("predicted"))
    if lower:
        sums.append(F.sum(F.when(low, -F.log(f"p_{lower}") * F.col("_c"))).alias("nll_lower"))
        sums.append(F.sum(F.when(low, F.col("_c"))).alias("predicted_lower"))
    return scored.groupBy(key).agg(*sums)


def score_matrix(
    df: DataFrame, models: Mapping[str, LanguageModel], key: str = "sample_id", lower: str | None = None
) -> DataFrame:
    """Perplexity of every sample under every model, one column per model.

    It is exp of the mean loss, and null below two words. With ``lower``, the name of
    a model, the column ``lower`` is the perplexity of the lower-cased text under it.
    """
    losses = _losses(df, models, key, lower)
    columns = [F.exp(F.col(f"nll_{n}") / F.col("predicted")).alias(n) for n in models]
    if lower:
        columns.append(F.exp(F.col("nll_lower") / F.col("predicted_lower")).alias("lower"))
    return df.join(losses.select(key, *columns), key, "left")


def perplexity(df: DataFrame, lm: LanguageModel, key: str = "sample_id") -> DataFrame:
    """(key, perplexity): exp of the mean loss; null below two words."""
    return score_matrix(df.select(key, "text"), {"perplexity": lm}, key).select(key, "perplexity")


def lower_perplexity(df: DataFrame, lm: LanguageModel, key: str = "sample_id") -> DataFrame:
    """Perplexity of the lower-cased text under the same model."""
    lowered = df.select(key, F.lower("text").alias("text"))
    return perplexity(lowered, lm, key).withColumnRenamed("perplexity", "lower")


@F.pandas_udf(IntegerType())
def _zlib_size(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else len(zlib.compress(t.encode("utf-8"))))


def zlib_size(text: Column) -> Column:
    """Bytes of the zlib-compressed UTF-8 text."""
    return _zlib_size(text)


def fill_scores(df: DataFrame, columns: Sequence[str], fallback: float = 1e9) -> DataFrame:
    """Null and non-finite scores become ``fallback``; every row stays."""
    return df.withColumns(
        {
            c: F.when(
                F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c).cast("double")) == math.inf),
                F.lit(fallback),
            ).otherwise(F.col(c))
            for c in columns
        }
    )


def _log(x: Column) -> Column:
    """Natural log with the limit at zero instead of null."""
    x = x.cast("double")
    return F.when(x == 0, F.lit(-math.inf)).otherwise(F.log(x))


def _ratio(num: Column, den: Column) -> Column:
    """IEEE division: x/0 is a signed infinity and 0/0 is NaN."""
    at_zero = (
        F.when(num > 0, F.lit(math.inf)).when(num < 0, F.lit(-math.inf)).otherwise(F.lit(math.nan))
    )
    return F.when(den == 0, at_zero).otherwise(F.try_divide(num, den))


def rank_by_perplexity(df: DataFrame, model: str, n: int = 100, key: str = "sample_id") -> DataFrame:
    """The ``n`` least surprising samples: (metric, rank, key, score1, score2, value)."""
    scored = df.select(
        F.lit(f"{model} perplexity").alias("metric"),
        key,
        F.col(model).cast("double").alias("score1"),
        F.lit(None).cast("double").alias("score2"),
        (-_log(F.col(model))).alias("value"),
    )
    return top_per_group(scored, ["metric"], [F.col("value").desc_nulls_last(), F.col(key)], n, [key])


def rank_by_ratio(
    df: DataFrame, model: str, others: Sequence[str], n: int = 100, key: str = "sample_id"
) -> DataFrame:
    """For each other score, the ``n`` largest log(other)/log(model)."""
    pairs = F.array(
        *[F.struct(F.lit(o).alias("other"), F.col(o).cast("double").alias("score2")) for o in others]
    )
    long = df.select(key, F.col(model).cast("double").alias("score1"), F.explode(pairs).alias("_p"))
    scored = long.select(
        F.concat(F.lit("ratio of "), F.col("_p.other"), F.lit(f" to {model} perplexity")).alias("metric"),
        key,
        "score1",
        F.col("_p.score2").alias("score2"),
        _ratio(_log(F.col("_p.score2")), _log(F.col("score1"))).alias("value"),
    )
    return top_per_group(scored, ["metric"], [F.col("value").desc_nulls_last(), F.col(key)], n, [key])


def _weighed(df: DataFrame, key: str, split: str) -> DataFrame:
    """(split, _times, text): a key that repeats counts in each of its splits as often as it is there."""
    own = df.select(key, split, "text").filter(F.col(key).isNotNull())
    counted = own.groupBy(key).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > 1)
    repeated = materialise(counted.select(key), "repeated-keys")
    listed = F.broadcast(repeated) if fits_broadcast(repeated) else repeated
    again = own.join(listed, key, "left_semi")
    times = again.groupBy(key, split).agg(F.count("*").alias("_times"))
    # texts whose key is there once don't move
    once = own.join(listed, key, "left_anti").select(split, F.lit(1).cast("bigint").alias("_times"), "text")
    return once.unionByName(again.select(key, "text").join(times, key).select(split, "_times", "text"))


def _bigram_losses(texts: DataFrame, lm: LanguageModel, split: str) -> DataFrame:
    """(split, nll_lm, predicted) under a model of order two.

    The log of a probability is that of n + mu * p1 less that of the context's total + mu.
    The latter needs the contexts' counts alone, the former how many words of a kind
    stand in grams of the same count, so that no gram moves to its probability.
    """
    words, types = lm.totals()
    grams_of = keyed_grams(texts, 2, by=split, times=F.col("_times"), lowest=2)
    own = bucketed(grams_of, ["part"], "split-grams", grouped=True).select("_by", "part", F.col("key").alias("context"), "token", F.col("n").alias("_c"), "total")
    told = own.join(lm.placed(2).select("part", "context", "token", "n"), ["part", "context", "token"], "left")
    with joined_by_bucket(texts.sparkSession):
        alike = materialise(told.groupBy("_by", "token", "n").agg(F.sum("_c").alias("_c")), "sample-grams")
    single = lm.of_order(1).select("token", F.col("n").alias("_single"))
    low = F.lit(lm.mu) * (F.coalesce("_single", F.lit(0)) + 1) / F.lit(words + types + 1)
    high = alike.join(single, "token", "left").select(
        "_by", (-F.log(F.coalesce("n", F.lit(0)) + low) * F.col("_c")).alias("_nll"), F.col("_c").alias("_words")
    )
    totals = lm.placed_contexts().filter(F.col("ord") == 2).select("part", "context", F.col("total").alias("_total"))
    under = own.filter(F.col("total").isNotNull()).join(totals, ["part", "context"], "left").select(
        "_by", (F.log(F.coalesce("_total", F.lit(0)) + F.lit(lm.mu)) * F.col("total")).alias("_nll"), F.lit(0).cast("bigint").alias("_words")
    )
    with joined_by_bucket(texts.sparkSession):
        under = materialise(under.groupBy("_by").agg(F.sum("_nll").alias("_nll"), F.sum("_words").alias("_words")), "context-losses")
    both = high.unionByName(under).groupBy(F.col("_by").alias(split))
    return both.agg(F.sum("_nll").alias("nll_lm"), F.sum("_words").alias("predicted"))


def heldout_loss(df: DataFrame, lm: LanguageModel, key: str, split: str = "split") -> DataFrame:
    """Mean loss per predicted word in each split."""
    own = _weighed(df, key, split)
    loss = _bigram_losses(own, lm, split) if lm.order == 2 else _losses(own, {"lm": lm}, split, weight="_times")
    return loss.groupBy(split).agg((F.sum("nll_lm") / F.sum("predicted")).alias("loss"), F.sum("predicted").alias("predicted"))


def next_token_topk(lm: LanguageModel, k: int = 40, temperature: float = 1.0) -> DataFrame:
    """Per context the ``k`` likeliest next words with renormalised probability.

    Dividing log-probabilities by the temperature raises p to 1/temperature.
    """
    seen = model_table(lm).filter(F.col("ord") == lm.order).select("context", "token", "p")
    best = top_per_group(seen, ["context"], [F.col("p").desc(), F.col("token")], k, ["token"])
    warm = best.withColumn("_w", F.pow("p", F.lit(1.0 / temperature)))
    # at most k rows a context after the cut
    mass = warm.groupBy("context").agg(F.sum("_w").alias("_sum"))
    return warm.join(mass, "context").select(
        "context", "token", "rank", (F.col("_w") / F.col("_sum")).alias("prob")
    )


def empty_prompts(spark, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("prompt_id"), F.lit(END).alias("prompt"))


def batch_generate(
    prompts: DataFrame,
    predict: Callable[[list[str], int], list[str]],
    batch_size: int = 100,
    seed: int = 42,
    include_prompt: bool = False,
) -> DataFrame:
    """Run a user's model over a prompt table: (sample_id, prompt, text).

    ``predict`` gets up to ``batch_size`` prompts and a seed and returns one
    continuation each. Batches are runs of consecutive prompt ids, and the seed
    comes from the batch's number, so neither depends on partitions.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        asked = part["prompt"].tolist()
        told = predict(asked, seed + int(part["_batch"].iloc[0]))
        text = [f"{a} {t}" for a, t in zip(asked, told)] if include_prompt else told
        return pd.DataFrame({"sample_id": part["prompt_id"].to_numpy(), "prompt": asked, "text": text})

    placed = with_position(prompts.select("prompt_id", "prompt"), ["prompt_id"])
    return (
        placed.withColumn("_batch", F.expr(f"pos div {batch_size}"))
        .groupBy("_batch")
        .applyInPandas(run, "sample_id bigint, prompt string, text string")
    )


def sample_entropy(df: DataFrame, key: str = "sample_id") -> DataFrame:
    """Shannon entropy in bits of each sample's word histogram; 0 without words."""
    counts = (
        df.select(key, F.explode_outer(token_words(F.col("text"))).alias("token"))
        .groupBy(key, "token")
        .agg(F.count("token").alias("c"))
    )
    # H = log2(N) - sum(c * log2 c) / N needs one pass over the counts
    spread = F.log2(F.sum("c").cast("double")) - F.try_divide(F.sum(F.col("c") * F.log2("c")), F.sum("c"))
    return counts.groupBy(key).agg(F.coalesce(spread, F.lit(0.0)).alias("entropy"))
