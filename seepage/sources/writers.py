"""Writers: DataFrames to the text, token and report files of each stage."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seepage.operators.position import with_position

# What Spark writes as %XX in the name of a folder, and the name for null and empty.
_ESCAPED = re.compile(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""")
_NO_NAME = "__HIVE_DEFAULT_PARTITION__"


def _in_order(df: DataFrame, order: Sequence[str] | None) -> DataFrame:
    """Rows sorted across files: part files in name order read in this order."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df


def escape_breaks(text: Column) -> Column:
    """Line breaks inside a text as backslash-n, so that one row is one line."""
    return F.replace(F.regexp_replace(text, r"\r\n?", "\n"), F.lit("\n"), F.lit("\\n"))


def unescape_breaks(text: Column) -> Column:
    """The text that ``escape_breaks`` made a line of."""
    return F.replace(text, F.lit("\\n"), F.lit("\n"))


def write_lines(df: DataFrame, path: str, column: str = "text", order: Sequence[str] | None = None, skip_empty: bool = False) -> None:
    rows = df.filter(F.length(column) > 0) if skip_empty else df
    _in_order(rows, order).select(escape_breaks(F.col(column)).alias("value")).write.text(path)


def write_samples(df: DataFrame, path: str, column: str = "text", order: Sequence[str] | None = None) -> None:
    """Each sample followed by a blank line."""
    _in_order(df, order).select(F.col(column).alias("value")).write.option("lineSep", "\n\n").text(path)


def _folder(name: str, value: str | None) -> str:
    """The folder that ``partitionBy`` gives a value."""
    return f"{name}={_ESCAPED.sub(lambda m: f'%{ord(m[0]):02X}', value) if value else _NO_NAME}"


def write_file_tree(df: DataFrame, path: str, folders: Sequence[str], column: str = "text") -> None:
    """One file per row at ``folder=value/.../file``, as ``partitionBy`` names folders; a line break ends it.

    On a file system that executors mount, tasks write the files themselves; Spark's
    writer takes several processes and a rename by the driver for each. Names follow
    from partition and place, so a task that runs again writes the same files.
    """
    rows = df.select(*[F.col(f).cast("string").alias(f) for f in folders], F.col(column).alias("value"))
    scheme = re.match(r"([a-z0-9]+):", path)
    if scheme and scheme[1] != "file":
        options = {"maxRecordsPerFile": 1, "mapreduce.fileoutputcommitter.algorithm.version": 2}
        rows.write.options(**options).partitionBy(*folders).text(path)
        return
    root = re.sub(r"^file:/+", "/", path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, part, made, n = fs.LocalFileSystem(), TaskContext.get().partitionId(), set(), 0
        for batch in batches:
            for *values, text in zip(*(c.to_pylist() for c in batch.columns)):
                folder = "/".join([root, *map(_folder, folders, values)])
                if folder not in made:
                    store.create_dir(folder)
                    made.add(folder)
                with store.open_output_stream(f"{folder}/part-{part:05d}-{n:07d}.txt") as out:
                    out.write(f"{'' if text is None else text}\n".encode())
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    rows.mapInArrow(run, "n bigint").agg(F.sum("n")).collect()


def write_email_report(df: DataFrame, path: str, order: str) -> None:
    """``Email #n`` and one ``column: value`` line per field; null prints None."""
    fields = [c for c in df.columns if c != order]
    places = with_position(df.select(order), [order])
    unfolded = [
        F.concat(
            F.lit(f"{c}: "),
            F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"\r?\n[ \t]+", " "), F.lit("None")),
        )
        for c in fields
    ]
    rows = df.join(places, order)
    head = F.concat(F.lit("Email #"), (F.col("pos") + 1).cast("string"))
    lines = rows.select("pos", F.concat_ws("\n", head, *unfolded).alias("value"))
    _in_order(lines, ["pos"]).select("value").write.text(path)


def write_token_table(df: DataFrame, path: str) -> None:
    """Token arrays per line, one folder per split."""
    df.write.partitionBy("split").parquet(path)


def _score(name: Column, value: Column) -> Column:
    return F.format_string("%s=%.3f", name, value)


def report_lines(df: DataFrame, model: str, n: int) -> DataFrame:
    """(metric, rank, value) text blocks of a ranking joined with its texts."""
    other = F.regexp_extract("metric", r"^ratio of (\S+) to ", 1)
    scores = F.concat_ws(
        ", ",
        _score(F.lit(model), F.col("score1")),
        F.when(F.col("score2").isNotNull(), _score(other, F.col("score2"))),
        _score(F.lit("score"), F.col("value")),
    )
    header = F.concat(F.col("rank").cast("string"), F.lit(": "), scores)
    banner = F.concat(F.lit(f"======== top {n} samples by "), F.col("metric"), F.lit(": ========\n"))
    start = F.when(F.col("rank") == 1, banner).otherwise(F.lit(""))
    return df.select(
        "metric", "rank", F.concat(start, header, F.lit("\n\n"), escape_breaks(F.col("text")), F.lit("\n\n")).alias("value")
    )


def write_ranked_report(df: DataFrame, path: str, model: str, n: int = 100) -> None:
    """Sections of at most ``n`` ranked samples each, perplexity first. The
    report is a few sections of n rows, so it is one file."""
    by_ratio = F.col("metric").startswith("ratio").cast("int")
    rows = report_lines(df.filter(F.col("rank") <= n), model, n).withColumn("_ratio", by_ratio)
    rows.repartition(1).sortWithinPartitions("_ratio", "metric", "rank").select("value").write.text(path)


def summary_rows(summary: DataFrame, totals: DataFrame) -> DataFrame:
    """Category rows, a blank row, then the totals; all strings."""
    head = ["Category", "Unique Sample Count", "Total Match Count", "Examples"]
    categories = summary.select(
        F.col("ord").alias("_ord"),
        F.col("category").alias(head[0]),
        F.col("unique_sample_count").cast("string").alias(head[1]),
        F.col("total_match_count").cast("string").alias(head[2]),
        F.col("examples").alias(head[3]),
    )
    sums = totals.select(
        F.when(F.col("metric") == "Total Samples", 10_001)
        .when(F.col("metric") == "Total PII Sample Matches", 10_002)
        .otherwise(10_003)
        .alias("_ord"),
        F.col("metric").alias(head[0]),
        F.col("value").cast("string").alias(head[1]),
        F.lit("").alias(head[2]),
        F.lit("").alias(head[3]),
    )
    blank = sums.filter(F.col("_ord") == 10_001).select(
        F.lit(10_000).alias("_ord"), *[F.lit("").alias(h) for h in head]
    )
    return categories.unionByName(blank).unionByName(sums)


def write_summary_csv(summary: DataFrame, totals: DataFrame, path: str) -> None:
    """One small file: a row per category and three totals."""
    rows = summary_rows(summary, totals).repartition(1).sortWithinPartitions("_ord")
    rows.drop("_ord").write.options(header=True, escape='"', emptyValue="").csv(path)
