"""Vocabulary, token ids, padding, blocks and windows of the token stream."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seepage.functions.text import words
from seepage.operators.position import order_hash, running_totals
from seepage.operators.skew import lookup
from seepage.session import fits_broadcast, materialise, shared_path

# Reserved tokens and their ids.
UNKNOWN, UNKNOWN_ID = "<unk>", 0
END, END_ID = "<|endoftext|>", 1
FIRST_ID = 2

VOCAB_BYTES = 16 << 20  # of the most frequent part of a vocabulary that is broadcast
ID_STEPS = 64  # steps at which that part may end, for each doubling of the ids
BATCH_ROWS = 2_000  # rows that are translated at a time
CHUNK_ITEMS = 1 << 19  # items that meet their rare ones in one call
STREAM_PAGE = 1 << 18  # items of a page of a stored stream
MOST_PAGES = 10_000


def token_words(text: Column) -> Column:
    """Words; the end-of-text mark is always a word of its own."""
    return words(F.replace(text, F.lit(END), F.lit(f" {END} ")))


def build_vocab(df: DataFrame, max_size: int | None = None, column: str = "text") -> DataFrame:
    """(token, token_id, n), most frequent first, ids from 2."""
    counts = (
        df.select(F.explode(token_words(F.col(column))).alias("token"))
        .filter(~F.col("token").isin(UNKNOWN, END))
        .groupBy("token")
        .agg(F.count("*").alias("n"))
        .withColumn("_neg", -F.col("n"))
    )
    ranked = running_totals(counts, ["_neg", "token"])
    if max_size is not None:
        ranked = ranked.filter(F.col("pos") < max_size)
    return ranked.select("token", (F.col("pos") + FIRST_ID).cast("int").alias("token_id"), "n")


def vocab_stats(vocab: DataFrame, encoder: str = "counted-words") -> DataFrame:
    """One row: vocabulary size with the reserved tokens, and the encoder name."""
    return vocab.agg((F.count("*") + FIRST_ID).alias("vocab_size")).withColumn(
        "encoder", F.lit(encoder)
    )


def _frequent(vocab: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The most frequent part of a vocabulary, of bounded size, and the rest of it, if any.

    Ids are dealt by frequency, so that the part is a range of ids, found by their magnitudes.
    """
    step = F.floor(F.log2(F.greatest("token_id", F.lit(1))) * ID_STEPS)
    size = F.sum(F.octet_length("token") + 16).alias("size")
    # at most 31 * ID_STEPS + 1 rows
    sizes = sorted(vocab.groupBy(step.alias("step")).agg(size, F.max("token_id").alias("last")).collect())
    if sum(r["size"] for r in sizes) <= VOCAB_BYTES:
        return vocab, None
    last, held = -1, 0
    for r in sizes:
        held += r["size"]
        if held > VOCAB_BYTES:
            break
        last = r["last"]
    return vocab.filter(F.col("token_id") <= last), vocab.filter(F.col("token_id") > last)


@functools.lru_cache(maxsize=2)
def _shared_table(name: str, shared: Broadcast) -> pa.Table:
    """The two columns of a dictionary, once per worker, over the broadcast bytes themselves."""
    with pa.ipc.open_stream(pa.py_buffer(shared.value)) as reader:
        return reader.read_all().combine_chunks()


def _dictionary(spark: SparkSession, pairs: pa.Table) -> Callable[[], tuple[pa.Array, pa.Array]]:
    """A two-column table sent to the tasks; the result gives its columns there."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pairs.schema) as writer:
        writer.write_table(pairs)
    shared, name, schema = spark.sparkContext.broadcast(sink.getvalue().to_pybytes()), uuid.uuid4().hex, pairs.schema

    def columns() -> tuple[pa.Array, pa.Array]:
        table = _shared_table(name, shared)
        return tuple(table.column(k).combine_chunks() if table.num_rows else pa.array([], schema.field(k).type) for k in (0, 1))

    return columns


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in parts, so that a worker holds the translation of few rows beside them."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS)
        pa.default_memory_pool().release_unused()


def _found(items: pa.DictionaryArray, known: pa.Array, values: pa.Array) -> pa.Array:
    """What each item stands for, null for unknown ones."""
    return values.take(pc.index_in(items.dictionary.cast(known.type), value_set=known)).take(items.indices)


def _value_type(pairs: pa.Table) -> T.DataType:
    return T.IntegerType() if pa.types.is_integer(pairs.schema.field(1).type) else T.StringType()


def _in_rows(df: DataFrame, key: str, column: Column, pairs: pa.Table, missing, name: str) -> DataFrame:
    """(key, name): each array translated inside its row by a two-column table, without a shuffle.

    A batch of arrays is one flat column, looked up as a whole.
    """
    columns = _dictionary(df.sparkSession, pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, values = columns()
        for batch in _slices(batches):
            listed = batch.column("_items")
            places = listed.offsets.to_numpy()
            found = _found(listed.flatten().dictionary_encode(), known, values)
            told = pc.fill_null(found, pa.scalar(missing, values.type))
            where = pa.array(places - places[0], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(where, told)], [key, name])

    items = df.select(key, F.coalesce(column, F.array()).alias("_items"))
    return items.mapInArrow(run, T.StructType([df.schema[key], T.StructField(name, T.ArrayType(_value_type(pairs)))]))


def _in_chunks(
    df: DataFrame, key: str, column: Column, size: Column, pairs: pa.Table, rest: DataFrame, missing, name: str, reserved: list
) -> DataFrame:
    """The same for a vocabulary beyond a broadcast, whose most frequent part are the ``pairs``.

    Rows are dealt to chunks of about ``CHUNK_ITEMS`` items, of which a row has about ``size``, and only the rare items of
    each batch and chunk are looked up in the ``rest`` by a join; a chunk then meets its
    rare items. What is frequent never moves but within its row, as its translation.
    """
    source, value = (pairs.schema.field(k).name for k in (0, 1))
    columns, kind = _dictionary(df.sparkSession, pairs), df.select(column.alias("_items")).schema["_items"].dataType.elementType
    items = df.select(key, F.coalesce(column, F.array()).alias("_items"))
    number = df.agg(F.sum(size)).first()[0] or 0
    chunk = F.pmod(F.xxhash64(key, "_items"), F.lit(int(number) // CHUNK_ITEMS + 1))
    items = items.withColumn("_chunk", chunk)
    shape = T.StructType([T.StructField("_chunk", T.LongType()), df.schema[key], T.StructField("_told", T.ArrayType(_value_type(pairs))), T.StructField("_rare", T.ArrayType(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, values = columns()
        for batch in _slices(batches):
            listed = batch.column("_items")
            places = listed.offsets.to_numpy() - listed.offsets[0].as_py()
            flat = listed.flatten()
            told = _found(flat.dictionary_encode(), known, values)
            lacking = pc.is_null(told)
            ends = np.concatenate([[0], np.cumsum(lacking.to_numpy(zero_copy_only=False))])[places]
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), x) for at, x in ((places, told), (ends, flat.filter(lacking)))]
            yield pa.RecordBatch.from_arrays([batch.column("_chunk"), batch.column(key), *lists], shape.names)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column("_rare")
            owner = batch.column("_chunk").take(pc.list_parent_indices(listed))
            seen = pa.table({"_chunk": owner, source: listed.flatten()}).group_by(["_chunk", source]).aggregate([])
            yield from seen.to_batches()

    def settle(rows: pa.Table, words: pa.Table) -> pa.Table:
        rows, words = rows.combine_chunks(), words.combine_chunks()
        listed, rest_of = (pa.concat_arrays(rows.column(c).chunks) for c in ("_told", "_rare"))
        told, asked = listed.flatten(), rest_of.flatten()
        known, values = (pa.concat_arrays(words.column(c).chunks) if words.num_rows else pa.array([], words.schema.field(c).type) for c in (source, value))
        found = pc.fill_null(_found(asked.dictionary_encode(), known, values), pa.scalar(missing, values.type))
        told = pc.replace_with_mask(told, pc.is_null(told), found)
        places = listed.offsets.to_numpy()
        where = pa.array(places - places[0], pa.int32())
        return pa.table({key: rows.column(key), name: pa.ListArray.from_arrays(where, told)})

    coded = items.mapInArrow(run, shape)
    # one worker a task for both steps
    asked = items.mapInArrow(lambda batches: rare(run(batches)), T.StructType([shape["_chunk"], T.StructField(source, kind)]))
    looked = _by_lookup(materialise(asked, "rare-items"), rest, source, value, reserved)
    held = looked.filter(F.col(value).isNotNull()).select("_chunk", source, value)
    out = T.StructType([df.schema[key], T.StructField(name, T.ArrayType(_value_type(pairs)))])

    def meet(rows: pa.Table, words: pa.Table) -> pa.Table:
        return settle(rows, words) if rows.num_rows else pa.table({f.name: pa.array([], t) for f, t in zip(out.fields, (rows.schema.field(key).type, pa.list_(words.schema.field(value).type)))})

    return coded.groupBy("_chunk").cogroup(held.groupBy("_chunk")).applyInArrow(meet, out)


def _pairs(vocab: DataFrame, *columns: str) -> pa.Table:
    """Two columns of a vocabulary of bounded size, with the end mark."""
    end = {"token": END, "token_id": END_ID}
    kinds = {"token": pa.string(), "token_id": pa.int32()}
    schema = pa.schema([(c, kinds[c]) for c in columns])
    listed = vocab.select("token", F.col("token_id").cast("int").alias("token_id")).select(*columns).toArrow().cast(schema)
    return pa.concat_tables([pa.table({c: pa.array([end[c]], kinds[c]) for c in columns}), listed]).combine_chunks()


def _translated(df: DataFrame, vocab: DataFrame, key: str, items: Column, size: Column, to: tuple[str, str], missing, name: str, reserved: list) -> DataFrame:
    """(key, name): arrays of one column of the vocabulary as arrays of the other."""
    frequent, rest = _frequent(vocab)
    pairs = _pairs(frequent, *to)
    if rest is None:
        return _in_rows(df, key, items, pairs, missing, name)
    return _in_chunks(df, key, items, size, pairs, rest, missing, name, reserved)


def _by_lookup(df: DataFrame, vocab: DataFrame, key: str, value: str, reserved: list) -> DataFrame:
    """Left-join a large vocabulary; reserved values, which it lacks, stay out of the shuffle, and others enter it once a row."""
    total = vocab.agg(F.sum("n")).first()[0] or 0
    lacking = F.col(key).isNull() | F.col(key).isin(reserved)
    looked = lookup(df.filter(~lacking), vocab, key, "n", [value], total)
    return looked.unionByName(df.filter(lacking).withColumn(value, F.lit(None).cast(vocab.schema[value].dataType)))


def encode(df: DataFrame, vocab: DataFrame, key: str, column: str = "text") -> DataFrame:
    """(key, ids): token ids in text order; unknown words get the reserved id.

    The most frequent words, up to a bounded size, are broadcast and every text translated
    in its row; only the rare words of a larger vocabulary are looked up in a join.
    """
    return _translated(df, vocab, key, token_words(F.col(column)), F.octet_length(column) / 6, ("token", "token_id"), UNKNOWN_ID, "ids", [END, UNKNOWN])


def decode(df: DataFrame, vocab: DataFrame, key: str, column: str = "ids") -> DataFrame:
    """(key, text): tokens joined by one space."""
    out = _translated(df, vocab, key, F.col(column), F.size(column), ("token_id", "token"), UNKNOWN, "_tokens", [END_ID, UNKNOWN_ID])
    return out.select(key, F.array_join("_tokens", " ").alias("text"))


def truncate(ids: Column, length: int = 512) -> Column:
    return F.slice(ids, 1, length)


def _missing(ids: Column, length: Column) -> Column:
    return F.greatest(length - F.size(ids), F.lit(0))


def pad(ids: Column, length: Column, pad_id: int = END_ID, left: bool = False) -> Column:
    fill = F.array_repeat(F.lit(pad_id), _missing(ids, length))
    return F.concat(fill, ids) if left else F.concat(ids, fill)


def pad_mask(ids: Column, length: Column, left: bool = False) -> Column:
    ones = F.transform(ids, lambda _: F.lit(1))
    fill = F.array_repeat(F.lit(0), _missing(ids, length))
    return F.concat(fill, ones) if left else F.concat(ones, fill)


def pad_fixed(
    df: DataFrame, length: int = 512, pad_id: int = END_ID, left: bool = False
) -> DataFrame:
    """Truncate and pad ``ids`` to one length: input_ids and attention_mask."""
    ids, size = truncate(F.col("ids"), length), F.lit(length)
    kept = [c for c in df.columns if c != "ids"]
    return df.select(
        *kept,
        pad(ids, size, pad_id, left).alias("input_ids"),
        pad_mask(ids, size, left).alias("attention_mask"),
    )


def collate(
    df: DataFrame, order: str, batch: int = 8, length: int = 512, pad_id: int = END_ID
) -> DataFrame:
    """Batches of consecutive rows, padded to the longest row of each batch.

    Labels equal the padded ids: padding is not masked out of them.
    """
    places = running_totals(df.select(order), [order]).select(order, "pos")
    rows = df.join(places, order).select(
        order,
        F.expr(f"pos div {batch}").alias("batch_id"),
        truncate(F.col("ids"), length).alias("_ids"),
    )
    longest = rows.groupBy("batch_id").agg(F.max(F.size("_ids")).alias("_len"))
    padded = rows.join(longest, "batch_id")
    return padded.select(
        order,
        "batch_id",
        pad(F.col("_ids"), F.col("_len"), pad_id).alias("input_ids"),
        pad_mask(F.col("_ids"), F.col("_len")).alias("attention_mask"),
    ).withColumn("labels", F.col("input_ids"))


def append_end(df: DataFrame) -> DataFrame:
    """End-of-text id after each document, and the new length."""
    return df.withColumn("ids", F.concat("ids", F.array(F.lit(END_ID)))).withColumn(
        "len", F.size("ids")
    )


def with_offsets(df: DataFrame, order: str, column: str = "ids") -> DataFrame:
    """Add ``pos``, ``offset`` (tokens in earlier rows), ``n_rows`` and ``n_tokens``.

    Keys and sizes alone are sorted; the arrays meet them in one join, and stay
    where they are while the keys are few enough to broadcast.
    """
    sizes = df.select(order, F.size(column).alias("_size"))
    totals = running_totals(sizes, [order], "_size").drop("_size").withColumnRenamed("n_measure", "n_tokens")
    return df.join(F.broadcast(totals) if fits_broadcast(totals) else totals, order)


def n_blocks(n_tokens: Column, block: int, stride: int) -> Column:
    """How many blocks a stream gives; the last possible one is left out."""
    return F.greatest(F.lit(0), F.floor((n_tokens - block - 1) / F.lit(stride)))


def pack_blocks(df: DataFrame, order: str, block: int = 512, stride: int = 512) -> DataFrame:
    """(block_id, x, y) over the stream of all ``ids``; y is x one token later.

    Each document is cut into the pieces its blocks need; a block gathers at
    most block+1 pieces.
    """
    stream = with_offsets(df, order).filter(F.size("ids") > 0)
    first, last = F.col("offset"), F.col("offset") + F.size("ids") - 1
    low = F.greatest(F.lit(0), F.ceil((first - block) / F.lit(stride)))
    high = F.least(
        n_blocks(F.col("n_tokens"), block, stride) - 1, F.floor(last / F.lit(stride))
    )
    pieces = (
        stream.select("ids", "offset", low.cast("bigint").alias("_low"), high.cast("bigint").alias("_high"))
        .filter(F.col("_low") <= F.col("_high"))
        .select("ids", "offset", F.explode(F.sequence("_low", "_high")).alias("block_id"))
    )
    begin = F.greatest(F.col("block_id") * stride, F.col("offset"))
    end = F.least(F.col("block_id") * stride + block, F.col("offset") + F.size("ids") - 1)
    cut = pieces.select(
        "block_id",
        begin.alias("_at"),
        F.slice("ids", (begin - F.col("offset") + 1).cast("int"), (end - begin + 1).cast("int")).alias("_ids"),
    )
    whole = cut.groupBy("block_id").agg(
        F.flatten(
            F.transform(F.sort_array(F.collect_list(F.struct("_at", "_ids"))), lambda p: p["_ids"])
        ).alias("_all")
    )
    return whole.select(
        "block_id",
        F.slice("_all", 1, block).alias("x"),
        F.slice("_all", 2, block).alias("y"),
    )


def corpus_stats(
    df: DataFrame, block: int = 512, stride: int = 512, batch: int = 16, column: str = "ids"
) -> DataFrame:
    """Per split: tokens, examples, batches per epoch and tokens per step."""
    totals = df.groupBy("split").agg(F.sum(F.size(column)).cast("bigint").alias("tokens"))
    examples = n_blocks(F.col("tokens"), block, stride)
    return totals.select(
        "split",
        "tokens",
        examples.alias("examples"),
        F.ceil(examples / F.lit(batch)).alias("batches_per_epoch"),
        F.lit(block * batch).cast("bigint").alias("tokens_per_step"),
    )


def concat_stream(df: DataFrame, order: str, shards: int = 1024) -> DataFrame:
    """All ids as one stream: offset of each row and its contiguous shard.

    Rows are dealt to shards as evenly as possible, the first ones one longer.
    """
    placed = with_offsets(df, order)
    base = F.expr(f"n_rows div {shards}")
    extra = F.col("n_rows") % shards
    longer = extra * (base + 1)
    shard = F.when(
        F.col("pos") < longer, F.floor(F.col("pos") / (base + 1))
    ).otherwise(extra + F.floor((F.col("pos") - longer) / F.greatest(base, F.lit(1))))
    return placed.withColumn("shard", shard.cast("bigint"))


MANIFEST = "shard bigint, start bigint, n_rows bigint, n_tokens bigint, checksum bigint, path string"


def _shard_facts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("shard").agg(
        F.min("offset").alias("start"),
        F.count("*").alias("n_rows"),
        F.sum(F.size("ids")).cast("bigint").alias("n_tokens"),
        F.bit_xor(F.xxhash64("offset", "ids")).alias("checksum"),
    )


def write_shards(df: DataFrame, order: str, path: str, shards: int = 1024) -> DataFrame:
    """Writes the stream as exactly one file per shard, and a manifest; returns the manifest.

    A manifest row tells a shard's start in the stream, rows, tokens, checksum and file.
    The files go to a folder of their own and count only once the manifest names them,
    so a run that fails midway leaves what was there before, and a repeat gives the same.
    """
    spark = df.sparkSession
    folder = f"{path}/data-{uuid.uuid4().hex}"
    placed = concat_stream(df, order, shards).select("shard", "pos", "offset", "ids")
    # a partition holds whole shards, so each shard comes from one task
    placed.repartition("shard").sortWithinPartitions("shard", "pos").write.partitionBy("shard").parquet(folder)
    written = spark.read.schema("shard bigint, pos bigint, offset bigint, ids array<int>").parquet(folder)
    # below ``path``, so that the whole can be moved
    place = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+/shard=[^/]+/[^/]+)$", 1)
    files = written.groupBy("shard").agg(F.min(place).alias("path"))
    facts = _shard_facts(written).join(files, "shard").select(*[c.split()[0] for c in MANIFEST.split(", ")])
    # as many rows as there are shards
    facts.coalesce(1).sortWithinPartitions("shard").write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def read_shards(spark: SparkSession, path: str, first: int = 0, last: int | None = None, check: bool = True) -> DataFrame:
    """(shard, pos, offset, ids) of the shards ``first`` to ``last`` that the manifest names.

    With ``check`` a shard whose rows, tokens or checksum differ is an error.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").filter(F.col("shard") >= first)
    if last is not None:
        manifest = manifest.filter(F.col("shard") <= last)
    listed = manifest.select("path").collect()  # as many rows as there are shards
    shape = "shard bigint, pos bigint, offset bigint, ids array<int>"
    if not listed:
        return spark.createDataFrame([], shape)
    base = f"{path}/{listed[0]['path'].split('/')[0]}"
    rows = spark.read.schema(shape).option("basePath", base).parquet(*[f"{path}/{r['path']}" for r in listed])
    if check:
        told, found = manifest.drop("path"), _shard_facts(rows)
        wrong = told.join(found, told.columns, "left_anti").select("shard").limit(10).collect()
        if wrong:
            raise ValueError(f"shards differ from their manifest: {[r['shard'] for r in wrong]}")
    return rows


def random_starts(spark, count: int, span: int, seed: int) -> DataFrame:
    """(win_id, start): ``count`` hash-derived starts in [0, span)."""
    place = F.conv(F.substring(order_hash(seed, "id"), 1, 12), 16, 10).cast("double")
    return spark.range(count).select(
        F.col("id").alias("win_id"),
        F.floor(place / F.lit(float(16**12)) * F.lit(float(span))).cast("bigint").alias("start"),
    )


def _pages(first: Column, last: Column, page: int) -> Column:
    """Numbers of the stream pages that the places first..last lie on."""
    return F.explode(F.sequence(F.floor(first / page), F.floor(last / page)))


def gather_windows(
    df: DataFrame, places: DataFrame, windows: DataFrame, length: int, order: str, column: str
) -> DataFrame:
    """(win_id, start, items): ``length`` consecutive stream items from each start.

    ``places`` holds (order, _size, offset) of every row. The range condition
    becomes an equality on fixed-size pages of the stream, tested on sizes alone;
    the arrays of ``df`` are read only for the rows that a window touches.
    """
    page = max(length, 1024)
    wanted = windows.select(
        "win_id", "start", _pages(F.col("start"), F.col("start") + length - 1, page).alias("_page")
    )
    held = places.filter(F.col("_size") > 0).select(
        order,
        "_size",
        "offset",
        _pages(F.col("offset"), F.col("offset") + F.col("_size") - 1, page).alias("_page"),
    )
    if fits_broadcast(wanted):
        wanted = F.broadcast(wanted)
    begin = F.greatest(F.col("start"), F.col("offset"))
    end = F.least(F.col("start") + length, F.col("offset") + F.col("_size"))
    cuts = (
        held.join(wanted, "_page")
        .filter(begin < end)
        # two rows that share several pages meet once
        .filter(F.col("_page") == F.floor(begin / page))
        .select(
            order,
            "win_id",
            "start",
            begin.alias("_from"),
            (begin - F.col("offset") + 1).cast("int").alias("_at"),
            (end - begin).cast("int").alias("_n"),
        )
    )
    cuts = materialise(cuts, "window-cuts")
    if fits_broadcast(cuts):
        cuts = F.broadcast(cuts)
    parts = df.select(order, column).join(cuts, order).select(
        "win_id", "start", "_from", F.slice(column, F.col("_at"), F.col("_n")).alias("_part")
    )
    return parts.groupBy("win_id", "start").agg(
        F.flatten(
            F.transform(F.sort_array(F.collect_list(F.struct("_from", "_part"))), lambda p: p["_part"])
        ).alias("items")
    )


@dataclass(frozen=True)
class TokenStream:
    """A stream stored by pages: (page, offset, items), a folder per page of consecutive items."""

    rows: DataFrame
    page: int
    total: int


def store_stream(df: DataFrame, order: str, column: str = "ids", path: str | None = None, page: int = STREAM_PAGE) -> TokenStream:
    """All arrays of ``column`` as one stream in the order of ``order``, cut at pages of ``page`` items.

    Each page is one file; pages grow with the stream, so that at most ``MOST_PAGES``
    folders arise. A reader of some places reads their pages only.
    """
    spark = df.sparkSession
    held = df.select(order, F.col(column).alias("items"))
    totals = running_totals(held.select(order, F.size("items").alias("_size")), [order], "_size")
    total = totals.agg(F.max("n_measure")).first()[0] or 0
    page = max(page, -(-total // MOST_PAGES))
    offsets = totals.filter("_size > 0").select(order, "offset")
    placed = held.join(F.broadcast(offsets) if fits_broadcast(offsets) else offsets, order)
    begin = F.greatest(F.col("offset"), F.col("page") * page)
    end = F.least(F.col("offset") + F.size("items"), (F.col("page") + 1) * page)
    cut = placed.select("items", "offset", _pages(F.col("offset"), F.col("offset") + F.size("items") - 1, page).alias("page"))
    rows = cut.select(
        "page", begin.alias("offset"), F.slice("items", (begin - F.col("offset") + 1).cast("int"), (end - begin).cast("int")).alias("items")
    )
    path = path or shared_path(spark, "token-stream")
    rows.repartition("page").sortWithinPartitions("page", "offset").write.mode("overwrite").partitionBy("page").parquet(path)
    shape = T.StructType([f for f in rows.schema.fields if f.name != "page"] + [T.StructField("page", T.LongType())])
    return TokenStream(spark.read.schema(shape).parquet(path), page, total)


def stream_windows(stream: TokenStream, windows: DataFrame, length: int) -> DataFrame:
    """(win_id, start, items): ``length`` consecutive items of a stored stream from each start.

    The windows tell at run time which pages are read; no other folder is opened.
    """
    last = F.col("start") + length - 1
    wanted = windows.filter(F.col("start") >= 0).select("win_id", "start", _pages(F.col("start"), last, stream.page).alias("page"))
    if fits_broadcast(wanted):
        wanted = F.broadcast(wanted)
    begin = F.greatest(F.col("start"), F.col("offset"))
    end = F.least(F.col("start") + length, F.col("offset") + F.size("items"))
    parts = (
        stream.rows.join(wanted, "page")
        .filter(begin < end)
        .select("win_id", "start", begin.alias("_from"), F.slice("items", (begin - F.col("offset") + 1).cast("int"), (end - begin).cast("int")).alias("_part"))
    )
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("_from", "_part"))), lambda p: p["_part"])
    return parts.groupBy("win_id", "start").agg(F.flatten(ordered).alias("items"))


def _random_windows(
    df: DataFrame | TokenStream, order: str, column: str, count: int, length: int, margin: int, seed: int
) -> DataFrame:
    stream = df if isinstance(df, TokenStream) else store_stream(df, order, column)
    starts = random_starts(stream.rows.sparkSession, count, max(stream.total - margin, 0), seed)
    return stream_windows(stream, starts, length)


def random_blocks(df: DataFrame | TokenStream, order: str, block: int, n: int, seed: int) -> DataFrame:
    """(win_id, start, x, y): blocks at ``n`` random places of the stream.

    A stream that is drawn from more than once is stored once and given instead of ``df``.
    """
    windows = _random_windows(df, order, "ids", n, block + 1, block, seed)
    return windows.select(
        "win_id", "start", F.slice("items", 1, block).alias("x"), F.slice("items", 2, block).alias("y")
    )


def random_word_windows(
    df: DataFrame | TokenStream, order: str, n: int, length: int = 10, seed: int = 42, column: str = "text"
) -> DataFrame:
    """(prompt_id, words, prompt): up to ``n`` windows of ``length`` words.

    Twice as many starts are drawn; windows with another length are dropped and
    the first ``n`` kept.
    """
    listed = df if isinstance(df, TokenStream) else df.select(order, token_words(F.col(column)).alias("_words"))
    windows = _random_windows(listed, order, "_words", 2 * n, length, length + 1, seed)
    return (
        windows.filter(F.size("items") == length)
        .orderBy("win_id")
        .limit(n)
        .select(
            F.col("win_id").alias("prompt_id"),
            F.col("items").alias("words"),
            F.array_join("items", " ").alias("prompt"),
        )
    )
