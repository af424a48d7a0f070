"""Readers: raw files to DataFrames.

Text is read split by split, so the order of lines is the order of
(file, start of split, local index); ``_file``, ``_block`` and ``_row`` carry it.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from seepage.functions.mail import unix_lines
from seepage.functions.text import strip
from seepage.session import fits_broadcast, materialise


LINE_ORDER = ["_file", "_block", "_row"]

# Cells that a CSV reader of the usual kind takes as missing.
MISSING = [
    "", "NA", "N/A", "n/a", "NaN", "nan", "-NaN", "-nan", "null", "NULL", "None", "<NA>", "#N/A", "#NA",
    "#N/A N/A", "1.#IND", "-1.#IND", "1.#QNAN", "-1.#QNAN",
]


def _ordered_text(spark: SparkSession, path: str | list[str], separator: str | None = None) -> DataFrame:
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
        F.col("value").alias("text"),
    )


FILE_BYTES = 4 << 20  # of files that a task hands over at a time
LISTED_NAMES = 10_000


def _files_below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, local): the files right in each folder, without those that Spark's readers skip."""

    def told(rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"path": pa.array([p for p, _ in rows], pa.string()), "local": pa.array([x for _, x in rows], pa.binary())})

    rows: list[tuple[str, bytes]] = []
    for batch in batches:
        for folder in batch.column("folder").to_pylist():
            with os.scandir(re.sub(r"^file:/*", "/", folder)) as found:
                for x in found:
                    hidden = x.name.startswith(".") or x.name.startswith("_") and "=" not in x.name or x.name.endswith("._COPYING_")
                    if not hidden and x.is_file():
                        rows.append((f"{folder}/{x.name}".encode(errors="replace").decode(), os.fsencode(x.path)))
                    if len(rows) == LISTED_NAMES:
                        yield told(rows)
                        rows = []
    yield told(rows)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, content) of the files that are not empty."""
    paths: list[str] = []
    held: list[bytes] = []
    size = 0

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "content": pa.array(held, pa.binary())})

    for batch in batches:
        for path, local in zip(*(batch.column(c).to_pylist() for c in ("path", "local")), strict=True):
            with open(local, "rb") as file:
                content = file.read()
            if content:
                paths.append(path)
                held.append(content)
                size += len(content)
            if size >= FILE_BYTES:
                yield told()
                paths, held, size = [], [], 0
    yield told()


def _mail_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, content) of the files in the folders of a pattern, perhaps with those further below.

    On a file system that executors mount, tasks list the folders and read the files, so
    that the driver knows folders only; elsewhere Spark's reader lists every file there.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = list(store.globStatus(place) or ()) if store.getUri().getScheme() == "file" else ()
    if not found:
        # of no folder, Spark's reader says so
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(pattern)
    folders = [(x.getPath().toString(),) for x in found if x.isDirectory()]
    cores = spark.sparkContext.defaultParallelism
    listed = spark.createDataFrame(folders, "folder string").repartition(min(len(folders), 4 * cores) or 1)
    # a folder may hold most files, so they are dealt out before they are read
    files = listed.mapInArrow(_files_below, "path string, local binary").repartition(4 * cores, "path")
    return files.mapInArrow(_contents, "path string, content binary")


def read_maildir(spark: SparkSession, path: str) -> DataFrame:
    """(path, user, folder, raw) for files at exactly user/folder/file, latin-1."""
    files = _mail_files(spark, f"{path.rstrip('/')}/*/*")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()
    depth = root.rstrip("/").count("/") + 1
    # folders may be listed with all below them
    parts = F.split("path", "/")
    return (
        files.filter(F.size(parts) == depth + 3)
        .select("path", F.slice(parts, -3, 3).alias("_p"), "content")
        .select(
            "path",
            F.get("_p", F.lit(0)).alias("user"),
            F.get("_p", F.lit(1)).alias("folder"),
            unix_lines(F.decode("content", "ISO-8859-1")).alias("raw"),
        )
    )


_CLOSE = re.compile(r'(?:[^"]|"")*+"')  # up to the quote that ends a quoted cell


def _outside(line: str, at: int) -> int:
    """1 if the line, from the start of a cell on, ends inside a quoted one."""
    while True:
        if line.startswith('"', at):
            closed = _CLOSE.match(line, at + 1)
            if not closed:
                return 1
            at = closed.end()
        comma = line.find(",", at)
        if comma < 0:
            return 0
        at = comma + 1


def line_states(line: str) -> tuple[int, int]:
    """Whether a line ends inside a quoted cell, if it starts outside and if it starts inside one."""
    if '"' not in line:
        return 0, 1
    closed = _CLOSE.match(line)
    if not closed:
        return _outside(line, 0), 1
    comma = line.find(",", closed.end())
    return _outside(line, 0), _outside(line, comma + 1) if comma >= 0 else 0


def _split_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split of a file and for both states at its start: the state at its end, and whether a record ends in it."""
    found: dict[tuple, list[int]] = {}
    for batch in batches:
        for file, block, text in zip(*(batch.column(c).to_pylist() for c in ("_file", "_block", "text")), strict=True):
            state = found.setdefault((file, block), [0, 1, 0, 0])
            ends = line_states(text)
            for start in (0, 1):
                state[start] = ends[state[start]]
                state[2 + start] |= 1 - state[start]
    rows = [(*place, *state) for place, state in found.items()]
    if rows:
        kinds = [pa.string(), pa.int64(), *[pa.int32()] * 4]
        names = ["_file", "_block", "end0", "end1", "closes0", "closes1"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _starts(splits: DataFrame) -> DataFrame:
    """(_file, _block, inside, owner): the state at the start of each split, and the split whose last record goes on into it.

    The states of neighbouring splits compose, as a running fold over the splits of a file.
    """
    order = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.collect_list(F.struct("end0", "end1")).over(order)  # one row per split
    inside = F.aggregate(before, F.lit(0), lambda state, x: F.when(state == 0, x["end0"]).otherwise(x["end1"]))
    told = splits.withColumn("inside", inside)
    closes = F.when(F.col("inside") == 0, F.col("closes0")).otherwise(F.col("closes1")) == 1
    end = F.when(F.col("inside") == 0, F.col("end0")).otherwise(F.col("end1"))
    opens = (end == 1) & ((F.col("inside") == 0) | closes)
    owner = F.last(F.when(opens, F.col("_block")), ignorenulls=True).over(order)
    return told.select("_file", "_block", "inside", owner.alias("owner"))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(_file, _block, rec, record): the records of CSV files, whose quoted cells may hold line breaks.

    Files are read split by split; a split learns from the ones before it whether it
    starts inside a quoted cell. Only records that cross splits are put together in a
    shuffle. The first record of a file has block 0 and number 0.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.col("value").alias("text"))
    shape = "_file string, _block bigint, end0 int, end1 int, closes0 int, closes1 int"
    starts = materialise(_starts(lines.mapInArrow(_split_states, shape)), "csv-splits")
    # only the splits that a record with line breaks runs into
    known = {(r["_file"], r["_block"]): (1, r["owner"]) for r in starts.filter("inside = 1").toLocalIterator()}
    shared = spark.sparkContext.broadcast(known)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, state, rec, held, part = None, 0, 0, [], None
        rows: list[tuple] = []

        def flush(whole: bool) -> None:
            if held:
                # what came from or goes on to another split is a part of its owner's last record
                owner = part if part is not None else None if whole else place[1]
                rows.append((*place, rec, "\n".join(held), owner))
                held.clear()

        for batch in batches:
            rows = []
            for file, block, text in zip(*(batch.column(c).to_pylist() for c in ("_file", "_block", "text")), strict=True):
                if (file, block) != place:
                    if place:
                        flush(state == 0)
                    place, rec = (file, block), 0
                    state, owner = shared.value.get(place, (0, None))
                    part = owner if state else None
                held.append(text)
                state = line_states(text)[state]
                if not state:
                    flush(True)
                    rec, part = rec + 1, None
            yield _record_batch(rows)
        rows = []
        if place:
            flush(state == 0)
        yield _record_batch(rows)

    pieces = materialise(lines.mapInArrow(cut, "_file string, _block bigint, rec bigint, record string, owner bigint"), "csv-records")
    whole = pieces.filter("owner IS NULL").drop("owner")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_block", "rec", "record"))), lambda p: p["record"]), "\n")
    # the first part of a record is the last one of its own split
    first = F.max(F.when(F.col("_block") == F.col("owner"), F.col("rec")))
    crossing = pieces.filter("owner IS NOT NULL").groupBy("_file", "owner").agg(first.alias("rec"), joined.alias("record"))
    return whole.unionByName(crossing.withColumnRenamed("owner", "_block"))


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["_file", "_block", "rec", "record", "owner"])


def read_pii_csv(
    spark: SparkSession,
    path: str,
    column: str = "Filled Template",
    columns: Sequence[str] | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """One text column of a headed CSV. Rows with too many fields are skipped,
    short rows are padded with nulls, cells may hold line breaks.

    Large files are read in many tasks either way; where no cell holds a line break,
    ``multi_line=False`` saves a pass over them.
    """
    names = list(columns or spark.read.option("header", True).csv(path).columns)
    schema = StructType([StructField(c, StringType()) for c in [*names, "_corrupt_record"]])
    if multi_line:
        records = csv_records(spark, path).filter("(_block > 0 OR rec > 0) AND record <> ''")
        options = {"quote": '"', "escape": '"', "columnNameOfCorruptRecord": "_corrupt_record"}
        rows = records.select(F.from_csv("record", _ddl(schema), options).alias("_r")).select("_r.*")
    else:
        rows = spark.read.schema(schema).options(header=True, quote='"', escape='"').csv(path)
    # a row with another field count keeps its raw form; only commas outside
    # quotes separate fields
    bare = F.regexp_replace("_corrupt_record", r'(?s)"(?:[^"]|"")*+"', "")
    commas = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit("")))
    cell = F.col(f"`{column}`")
    return rows.filter(F.coalesce(commas < len(names), F.lit(True))).select(
        F.when(~cell.isin(MISSING), cell).alias("text")
    )


def _ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` string" for f in schema.fields)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per line with its order columns."""
    return _ordered_text(spark, path)


def read_corpus(
    spark: SparkSession,
    path: str,
    key: str = "doc_id",
    text_column: str = "text",
    split: str | None = None,
) -> DataFrame:
    """(key, text) of a parquet table, optionally one split of it."""
    rows = spark.read.parquet(path)
    if split is not None:
        rows = rows.filter(F.col("split") == split)
    return rows.select(key, F.col(text_column).alias("text"))


def read_marked(spark: SparkSession, path: str, marker: str) -> DataFrame:
    """Samples separated by ``marker`` at line end; a file without it is one."""
    return (
        _ordered_text(spark, path, f"{marker}\n")
        .withColumn("text", strip(F.col("text")))
        .filter(F.col("text") != "")
    )


_MARK = "\x1a"


def valid_text(raw: Column) -> Column:
    """Raw UTF-8 without its bad bytes; a replacement character that was there stays."""
    # bad bytes become replacement characters too, so the genuine ones step aside first
    aside = F.replace(F.replace(raw, F.lit(_MARK), F.lit(_MARK + "0")), F.lit("\ufffd"), F.lit(_MARK + "1"))
    clean = F.replace(F.make_valid_utf8(aside), F.lit("\ufffd"), F.lit(""))
    return F.replace(F.replace(clean, F.lit(_MARK + "1"), F.lit("\ufffd")), F.lit(_MARK + "0"), F.lit(_MARK))


def read_wet(spark: SparkSession, path: str, lang: str = "eng") -> DataFrame:
    """(record_id, language, body) of the records in ``lang``.

    A record starts at a line with WARC/1.0; its language is seven lines on and
    its body ten. The last record of a file is left out, lines keep their break
    and are joined by a space.
    """
    place = F.struct("_block", "_row")
    lines = F.split(unix_lines(valid_text(F.col("text"))), "\n")
    language = F.get("_lines", F.lit(7))
    wanted = F.contains(language, F.lit(f"WARC-Identified-Content-Language: {lang}"))
    # one scan: places of all records and the lines of the wanted ones are stored
    chunks = materialise(
        _ordered_text(spark, path, "WARC/1.0")
        .withColumn("_lines", lines)
        .select("_file", "_block", "_row", F.when(wanted, F.col("_lines")).alias("_lines")),
        "wet",
    )
    # one row per file: text before the first mark, and the last record
    ends = chunks.groupBy("_file").agg(F.min(place).alias("_first"), F.max(place).alias("_last"))
    ends = F.broadcast(ends) if fits_broadcast(ends) else ends
    # the piece after the last break belongs to the line of the next mark
    body = F.slice("_lines", 11, F.greatest(F.size("_lines") - 11, F.lit(0)))
    return (
        chunks.filter("_lines IS NOT NULL")
        .join(ends, "_file")
        .filter((place > F.col("_first")) & (place < F.col("_last")))
        .select(
            F.col("_row").alias("record_id"),
            F.lit(lang).alias("language"),
            F.array_join(F.transform(body, lambda b: F.concat(b, F.lit("\n"))), " ").alias("body"),
        )
    )


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the place of each row in its split of a file, and the headers up to it."""
    split, row, heads = None, 0, 0
    for batch in batches:
        places, seen = [], []
        marks = zip(*[batch.column(c).to_pylist() for c in ("_file", "_block", "_head")], strict=True)
        for file, block, head in marks:
            if (file, block) != split:
                split, row, heads = (file, block), 0, 0
            heads += head
            places.append(row)
            seen.append(heads)
            row += 1
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(places, pa.int64()), pa.array(seen, pa.int64())], [*batch.schema.names, "_place", "_seen"]
        )


def _numbered(lines: DataFrame, head: Column) -> DataFrame:
    """Non-blank stripped lines with ``pos`` and ``heads``, the headers up to each.

    A task reads a split in order, so places within splits are counted there and
    the splits' totals, a small table, give the rest; no text is shuffled.
    """
    kept = lines.withColumn("text", strip(F.col("text"))).filter(F.col("text") != "")
    rows = kept.select("_file", "_block", "text", head.cast("int").alias("_head"))
    placed = materialise(
        rows.mapInArrow(_count_rows, "_file string, _block bigint, text string, _head int, _place bigint, _seen bigint"), "lines"
    )
    totals = placed.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.max("_seen").alias("_h"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    offsets = totals.select(
        "_file",
        "_block",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"),
        F.coalesce(F.sum("_h").over(before), F.lit(0)).alias("_h"),
    )
    side = F.broadcast(offsets) if fits_broadcast(offsets) else offsets
    return placed.join(side, ["_file", "_block"]).select(
        "_file", (F.col("_n") + F.col("_place")).alias("pos"), (F.col("_h") + F.col("_seen")).alias("heads"), "_head", "text"
    )


def read_nonblank_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, text): stripped non-blank lines numbered in order."""
    return _numbered(read_lines(spark, path), F.lit(0)).select("pos", "text")


def read_ranked_report(spark: SparkSession, path: str, clean: bool = False) -> DataFrame:
    """(block_id, text): the samples of a ranked report.

    A line like ``12: ...`` starts a sample; what comes before the first one is
    ignored and the other non-blank lines are joined by spaces. Section banners
    end up in the sample before them and repeats stay, unless ``clean``.
    """
    lines = read_lines(spark, path)
    if clean:
        lines = lines.filter(~strip(F.col("text")).startswith("======== top"))
    placed = _numbered(lines, F.regexp_like("text", F.lit(r"^\p{Nd}+:"))).withColumnRenamed("heads", "block_id")
    # lines before the first header of their file belong to no sample
    starts = placed.filter(F.col("_head") == 1).groupBy("_file").agg(F.min("pos").alias("_start"))
    starts = F.broadcast(starts) if fits_broadcast(starts) else starts
    body = F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda p: p["text"])
    blocks = (
        placed.join(starts, "_file")
        .filter((F.col("pos") > F.col("_start")) & (F.col("_head") == 0))
        .groupBy("block_id")
        .agg(F.array_join(body, " ").alias("text"))
    )
    if clean:
        blocks = blocks.groupBy("text").agg(F.min("block_id").alias("block_id")).select("block_id", "text")
    return blocks


def token_cache(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The table saved at ``path``; computed and saved first if it is not there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # absent, or left without files by a failed job
        compute().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
