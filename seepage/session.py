"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructField

# Size up to which a lookup side may be broadcast.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20


def build_session(app: str = "seepage", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # long alternations and repeated groups recurse inside java.util.regex
        "spark.executor.extraJavaOptions": "-Xss16m",
        "spark.driver.extraJavaOptions": "-Xss16m",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder; a cluster
    session without it is an error, since a machine-local folder would lose
    data with the machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="seepage-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_blocks = threading.local()  # per thread, the paths and tables handed out inside each ``scratch`` block


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh, unused path below the shared folder."""
    path = f"{shared_folder(spark)}/seepage/{label}-{uuid.uuid4().hex}"
    for paths, _ in getattr(_blocks, "open", ()):
        paths.append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the intermediate tables of the block when it ends.

    Write the result inside the block; a DataFrame made in it can't be read after.
    """
    paths: list[str] = []
    tables: list[str] = []
    outer = getattr(_blocks, "open", ())
    _blocks.open = (*outer, (paths, tables))
    try:
        yield
    finally:
        _blocks.open = outer
        for table in tables:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back.

    Computed a single time, survives the loss of executors, and keeps column
    pruning and row-group statistics for whoever reads it next.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, keys: Sequence[str], label: str, grouped: bool = False) -> DataFrame:
    """Like ``materialise``, in buckets by ``keys``: a join on them moves only the other side.

    There are as many buckets as the session has shuffle partitions, so what was just
    ``grouped`` by these keys lies in the right tasks already.
    """
    spark = df.sparkSession
    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"seepage_{label.replace('-', '_')}_{uuid.uuid4().hex}"
    for _, tables in getattr(_blocks, "open", ()):
        tables.append(table)
    placed = df if grouped else df.repartition(number, *keys)
    placed.write.bucketBy(number, *keys).option("path", shared_path(spark, label)).saveAsTable(table)
    return spark.table(table)


@contextlib.contextmanager
def joined_by_bucket(spark: SparkSession) -> Iterator[None]:
    """What is written in the block may join buckets by some of the join's keys, not all of them alone."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _bytes_of(field: StructField) -> Column:
    """About the bytes that a value takes; nested values count by their elements."""
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 8
    if isinstance(field.dataType, (ArrayType, MapType)):
        return F.coalesce(F.size(column), F.lit(0)) * 16 + 8
    return F.lit(8)


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS, limit_bytes: int = BROADCAST_BYTES) -> bool:
    """True when ``df`` has at most ``limit`` rows and about ``limit_bytes``; reads at most limit+1 rows."""
    if limit < 0:
        return False
    size = sum((_bytes_of(f) for f in df.schema.fields), F.lit(0)).cast("bigint")
    found = df.limit(limit + 1).agg(F.count("*").alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return found["rows"] <= limit and found["bytes"] <= limit_bytes


def spread(scan: DataFrame) -> DataFrame:
    """Repartition a bare scan that has fewer partitions than there are cores.

    Files with many row groups are left as they are; a single-row-group file
    would otherwise keep all text work on one core.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
