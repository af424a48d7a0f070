"""Resumable audit: samples arrive as files, progress lives in a checkpoint.

What was looked up is stored once, in ``BUCKETS`` buckets by the hash of the string.
A batch reads the buckets of its own strings only, and a bucket that has gathered
``MOST_PARTS`` parts is written again as one, so the files that a batch reads don't
grow with the number of batches before it.

The files of the corpus are kept with their size and time. Where files were added, what
was found stays found, and strings missed before are looked up in the new files alone.
Where a file has changed or gone, all lookups start anew.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seepage.functions import patterns
from seepage.operators import audit
from seepage.session import materialise, scratch

FOUND_SCHEMA = "sample_id string, category string, match string, batch bigint"
LOOKUP_SCHEMA = "term string, found boolean, epoch bigint"
FILES_SCHEMA = "path string, length bigint, modified timestamp, generation bigint, epoch bigint"
BUCKETS = 256
MOST_PARTS = 8  # parts of a bucket that are read side by side
MOST_PATHS = 1_000  # new corpus files up to which they are read by name


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # nothing written yet
        return spark.createDataFrame([], schema)


def _children(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder; none where it doesn't exist."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in store.listStatus(place)] if store.exists(place) else []


def _remove(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@dataclass(frozen=True)
class Corpus:
    """The texts to search, under a name that changes with everything but added files."""

    texts: DataFrame
    name: str
    epoch: int = 0
    files: DataFrame | None = None  # path, modified, epoch

    def since(self, epoch: int) -> DataFrame:
        """The texts of files that came after an epoch."""
        new = self.files.filter(F.col("epoch") > epoch).select("path", "modified")
        place, time = F.col("_metadata.file_path"), F.col("_metadata.file_modification_time")
        listed = new.limit(MOST_PATHS + 1).collect()
        if len(listed) <= MOST_PATHS:
            return audit.corpus_texts(self.texts.filter(place.isin([r["path"] for r in listed])))
        first = new.agg(F.min("modified")).first()[0]
        late = self.texts.filter(time >= F.lit(first)).withColumn("_path", place)
        return audit.corpus_texts(late.join(new.select(F.col("path").alias("_path")), "_path", "left_semi"))


def corpus_of(corpus: DataFrame, out: str, corpus_id: str | None = None) -> Corpus:
    """The corpus as it is now, compared with the files that the last run saw.

    A given ``corpus_id`` is taken as the name, and the files aren't looked at.
    """
    spark = corpus.sparkSession
    if corpus_id or not corpus.inputFiles():
        return Corpus(corpus, corpus_id or "given")
    told = "_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time"
    now = materialise(corpus.select(*[F.col(c).alias(n) for c, n in zip(told, ("path", "length", "modified"), strict=True)]).distinct(), "corpus-files")
    known = _read(spark, f"{out}/corpus", FILES_SCHEMA)
    generation = known.agg(F.max("generation")).first()[0]
    before = known.filter(F.col("generation") == generation) if generation is not None else known
    same = ["path", "length", "modified"]
    if generation is None or not before.join(now, same, "left_anti").isEmpty():
        generation, epoch, new = (-1 if generation is None else generation) + 1, 0, now
    else:
        epoch, new = before.agg(F.max("epoch")).first()[0] + 1, now.join(before, same, "left_anti")
    if new.isEmpty():
        epoch -= 1
    else:
        new.write.mode("overwrite").parquet(f"{out}/corpus/generation={generation}/epoch={epoch}")
    files = _read(spark, f"{out}/corpus", FILES_SCHEMA).filter(F.col("generation") == generation)
    return Corpus(corpus, f"files-{generation}", epoch, files)


def _bucket(term: str = "term") -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS))


class Lookups:
    """The store of what was looked up: bucket=b/batch=k folders of (term, found, epoch)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def parts(self, buckets: Iterable[int], batch_id: int) -> dict[int, list[str]]:
        """The folders of some buckets that earlier batches wrote, at most BUCKETS lists."""
        out = {}
        for b in buckets:
            names = _children(self.spark, f"{self.path}/bucket={b}")
            out[b] = [f"{self.path}/bucket={b}/{n}" for n in names if n.startswith("batch=") and int(n[6:]) < batch_id]
        return out

    def read(self, parts: dict[int, list[str]]) -> DataFrame:
        paths = [p for listed in parts.values() for p in listed]
        if not paths:
            return self.spark.createDataFrame([], LOOKUP_SCHEMA)
        rows = self.spark.read.schema(LOOKUP_SCHEMA).parquet(*paths)
        return rows.groupBy("term").agg(F.max("found").alias("found"), F.max("epoch").alias("epoch"))

    def write(self, rows: DataFrame, known: DataFrame, parts: dict[int, list[str]], batch_id: int) -> None:
        """Adds a part to each bucket of ``rows``; a bucket with many parts becomes one.

        Facts are true whenever they are read, so a repeat of a batch, or parts that
        are left after the whole was written, change nothing.
        """
        full = [b for b, listed in parts.items() if len(listed) >= MOST_PARTS]
        if full:
            old = known.filter(_bucket().isin(full)).join(rows.select("term"), "term", "left_anti")
            rows = rows.unionByName(old)
        placed = rows.withColumn("bucket", _bucket()).withColumn("batch", F.lit(batch_id)).repartition("bucket")
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(self.path)
        _remove(self.spark, [p for b in full for p in parts[b]])


def audit_batch(
    batch: DataFrame,
    batch_id: int,
    corpus: Corpus,
    out: str,
    registry: tuple[patterns.Extractor, ...],
    names: DataFrame | None,
) -> None:
    """Audit one batch into its own folder; a repeat overwrites that folder."""
    spark = batch.sparkSession
    store = Lookups(spark, f"{out}/lookup/corpus={corpus.name}")
    with scratch(spark):
        cands = materialise(audit.candidates(batch, registry, names), "stream-candidates")
        terms = materialise(audit.distinct_terms(cands), "stream-terms")
        buckets = [r[0] for r in terms.select(_bucket()).distinct().collect()]  # at most BUCKETS
        parts = store.parts(buckets, batch_id)
        known = materialise(store.read(parts), "stream-known")
        state = materialise(terms.join(known, "term", "left"), "stream-state")
        missed = state.filter(~F.col("found") & (F.col("epoch") < corpus.epoch)).select("term", "epoch")
        oldest = missed.agg(F.min("epoch")).first()[0]
        hits = spark.createDataFrame([], "term string")
        new = state.filter("found IS NULL").select("term")
        if not new.isEmpty():
            hits = hits.unionByName(audit.corpus_hits(new, audit.corpus_texts(corpus.texts)))
        if oldest is not None:
            hits = hits.unionByName(audit.corpus_hits(missed.select("term"), corpus.since(oldest)))
        hits = materialise(hits, "stream-hits")
        asked = new.unionByName(missed.select("term"))
        fresh = asked.join(hits.withColumn("found", F.lit(True)), "term", "left").select(
            "term", F.coalesce("found", F.lit(False)).alias("found"), F.lit(corpus.epoch).cast("bigint").alias("epoch")
        )
        if not asked.isEmpty():
            store.write(fresh, known, parts, batch_id)
        leaked = state.filter("found").select("term").unionByName(hits).distinct()
        audit.keep_found(cands, leaked).write.mode("overwrite").parquet(f"{out}/found/batch={batch_id}")


def run_audit_stream(
    samples: DataFrame,
    corpus: DataFrame,
    out: str,
    registry: tuple[patterns.Extractor, ...] = patterns.DEFAULT,
    names: DataFrame | None = None,
    corpus_id: str | None = None,
) -> DataFrame:
    """Process what has arrived, then return all rows found so far.

    ``samples`` is a stream with ``sample_id`` and ``text``. Running again with
    the same ``out`` continues after the last finished batch. ``corpus_id`` names
    the corpus; by default its input files do.
    """
    searched = corpus_of(corpus, out, corpus_id)

    def step(batch: DataFrame, batch_id: int) -> None:
        audit_batch(batch, batch_id, searched, out, registry, names)

    query = (
        samples.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{out}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return found_so_far(samples.sparkSession, out)


def found_so_far(spark: SparkSession, out: str) -> DataFrame:
    return _read(spark, f"{out}/found", FOUND_SCHEMA).drop("batch")
