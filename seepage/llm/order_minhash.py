"""Order MinHash: fingerprints that are sensitive to edit distance.

A text is the list of its k-mers of code points, each numbered by its occurrence, so
that repeats count. Every entry of a fingerprint has a hash order of its own over the
numbered k-mers, takes the ``PICKED`` smallest, puts them back into the order of the
text, and hashes that tuple of k-mers to 16 bits. Two texts share an entry only if
both the k-mers and their order agree there: a moved block lowers the likeness, which
plain MinHash doesn't see.

The hash orders of a stretch of ``STRETCH`` k-mers are computed at once, and only the
smallest of each stretch are kept, so memory is bounded by the text itself. An edited
text repeats its original up to the edit; stretches before it are not hashed again.

Texts meet their successors in one shuffle by ranges of the id. Only the last row of a
range waits for the first row of the next one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seepage.llm.common import RowBatches, typed
from seepage.session import materialise

KMER = 8  # code points; a power of two, as hashes of k-mers double their length
PICKED = 2  # k-mers of an entry
ENTRIES = 64
STRETCH = 1024
SHORT = 1 << 16  # k-mers of a text up to which a hash and its place share 64 bits

_RANDOM = np.random.default_rng(42)
FACTORS = _RANDOM.integers(0, 1 << 32, ENTRIES, np.uint32) | np.uint32(1)
MASKS = _RANDOM.integers(0, 1 << 32, ENTRIES, np.uint32)
BASE, SPREAD, TURN = (np.uint64(int(x)) for x in _RANDOM.integers(1 << 62, 1 << 63, 3) | 1)
LAST = np.uint32(0xFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * SPREAD
    x = (x ^ (x >> np.uint64(29))) * TURN
    return x ^ (x >> np.uint64(32))


def kmers(text: str) -> np.ndarray:
    """A hash of every k-mer in text order; a shorter text is one k-mer, an empty one has none."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    if 0 < len(codes) < KMER:
        codes = np.concatenate([codes, np.zeros(KMER - len(codes), np.uint64)])
    width, power = 1, int(BASE)
    while width < KMER and len(codes):
        codes = codes[:-width] * np.uint64(power) + codes[width:]
        width, power = width * 2, power * power % (1 << 64)
    return _mixed(codes)


def occurrences(hashes: np.ndarray) -> np.ndarray:
    """How often each k-mer occurred before in the text."""
    n = len(hashes)
    if n <= SHORT:
        places = np.arange(n, dtype=np.uint64)
        keys = np.sort((hashes & ~np.uint64(SHORT - 1)) | places)
        order = (keys & np.uint64(SHORT - 1)).astype(np.int64)
        keys = keys >> np.uint64(16)
    else:
        order = np.argsort(hashes, kind="stable")
        keys = hashes[order]
    at = np.arange(n)
    first = np.ones(n, bool)
    first[1:] = keys[1:] != keys[:-1]
    out = np.empty(n, np.int64)
    out[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return out


def _smallest(numbered: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Per entry, the smallest values of a stretch and their places, which start at ``at``."""
    values = numbered[None, :] ^ MASKS[:, None]
    np.multiply(values, FACTORS[:, None], out=values)
    rows = np.arange(ENTRIES)
    low = np.full((ENTRIES, PICKED), LAST)
    place = np.full((ENTRIES, PICKED), -1, np.int64)
    for k in range(min(PICKED, len(numbered))):
        best = values.argmin(axis=1)
        low[:, k], place[:, k] = values[rows, best], best + at
        values[rows, best] = LAST
    return low, place


class Sketch:
    """The fingerprint of one text, able to lend its stretches to an edited text."""

    def __init__(self, text: str, like: Sketch | None = None, same: int = 0) -> None:
        """``same``: code points at the start that the text shares with ``like``."""
        hashes = kmers(text)
        numbered = (_mixed(hashes + occurrences(hashes).view(np.uint64) * BASE) >> np.uint64(32)).astype(np.uint32)
        ready = max(0, same - KMER + 1) // STRETCH if like else 0
        self.found = like.found[:ready] if like else []
        for at in range(ready * STRETCH, len(numbered), STRETCH):
            self.found.append(_smallest(numbered[at : at + STRETCH], at))
        self.entries = self._entries(hashes)

    def _entries(self, hashes: np.ndarray) -> np.ndarray:
        picked = np.full((ENTRIES, PICKED), -1, np.int64)
        if self.found:
            low = np.concatenate([x[0] for x in self.found], axis=1)
            place = np.concatenate([x[1] for x in self.found], axis=1)
            order = np.argsort(low, axis=1, kind="stable")[:, :PICKED]
            picked = np.sort(np.take_along_axis(place, order, axis=1), axis=1)
        out = np.zeros(ENTRIES, np.uint64)
        for k in range(PICKED):
            kmer = np.where(picked[:, k] >= 0, hashes[picked[:, k]], np.uint64(0)) if len(hashes) else np.zeros(ENTRIES, np.uint64)
            out = _mixed(out * BASE + kmer)
        return (out >> np.uint64(48)).astype(">u2")

    def hex(self) -> str:
        return self.entries.tobytes().hex()

    def likeness(self, other: Sketch) -> float:
        return float((self.entries == other.entries).mean())


def edited(text: str, following: str) -> tuple[str, int]:
    """The text whose last quarter gave way to the start of the next one, and what it keeps."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter], len(text) - quarter


def likeness(a: Column, b: Column) -> Column:
    """Share of equal entries of two fingerprints in their text form."""
    equal = [(F.substring(a, 1 + 4 * k, 4) == F.substring(b, 1 + 4 * k, 4)).cast("int") for k in range(ENTRIES)]
    return sum(equal[1:], equal[0]) / F.lit(float(ENTRIES))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint), a row per row: 64 entries of four hex digits for every whole text.

    Null and empty texts have no k-mer and one fingerprint of their own. Equal texts,
    repeated rows included, have equal fingerprints. Null ids are kept. Other columns
    are ignored; an empty table gives an empty result. ``likeness`` compares two.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in RowBatches(batches, "text"):
            found = [Sketch(_text(t)).hex() for t in part.column("text")]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found, pa.string())], ["id", "fingerprint"])

    return rows.mapInArrow(run, f"id {typed(rows, 'id')}, fingerprint string").withColumnRenamed("id", id_col)


def _text(value: pa.Scalar) -> str:
    return (value.as_py() or b"").decode("utf-8", "replace")


MADE = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = [f.split()[0] for f in MADE.split(", ")]


def _row(text: str, sketch: Sketch, following: str, beyond: Sketch) -> tuple:
    new, kept = edited(text, following)
    other = Sketch(new, sketch, kept) if new != text else sketch
    digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
    return len(text), digest, sketch.hex(), other.hex(), sketch.likeness(other), sketch.likeness(beyond)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text, its edited text, and how alike their fingerprints are.

    In the edited text the last quarter of the code points is replaced by as many, or
    all, from the start of the next document by ascending id; the last one is followed
    by the first. Columns: id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, a row per row. Rows without an id come last; rows of one id
    follow each other by their text, null before empty. A single row is followed by
    itself. Null texts count as empty. Other columns are ignored; an empty table gives
    an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    by_id = F.col("id").asc_nulls_last()
    ranged = rows.repartitionByRange(by_id, "tie").sortWithinPartitions(by_id, "tie", "text")
    placed = materialise(ranged.mapInArrow(_follow, f"id {typed(rows, 'id')}, {MADE}, part int, text binary, edge string"), "followed")
    inner = placed.filter("edge = 'inner'").select("id", *NAMES)
    # one row per task; the texts stay out of the window
    starts = placed.filter("edge = 'start'").select("part")
    alone = Window.orderBy("part")
    whole = alone.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = starts.select(F.col("part").alias("at"), F.coalesce(F.lead("part").over(alone), F.first("part").over(whole)).alias("next_part"))
    ends = placed.filter("edge = 'end'").select("id", "part", "text").join(F.broadcast(after), F.col("part") == F.col("at"))
    heads = placed.filter("edge = 'start'").select(F.col("part").alias("head"), F.col("text").alias("following"))
    last = ends.join(heads, F.col("next_part") == F.col("head")).select("id", "text", "following")
    out = inner.unionByName(last.mapInArrow(_finish, f"id {typed(rows, 'id')}, {MADE}"))
    return out.select(F.col("id").alias(id_col), *NAMES)


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range in order: each with the next one, the first and the last also with their texts."""
    context = TaskContext.get()
    part = context.partitionId() if context else 0
    before: tuple[pa.Scalar, str, Sketch, pa.Scalar] | None = None
    names = ["id", *NAMES, "part", "text", "edge"]

    def made(ids: list, rows: list[tuple], texts: list, edges: list[str], kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in NAMES]
        types = [pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
        arrays = [pa.array([i.as_py() for i in ids], kind), *[pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([part] * len(ids), pa.int32()), pa.array(texts, pa.binary()), pa.array(edges, pa.string())], names)

    empty = (None,) * len(NAMES)
    kind = None
    for batch in RowBatches(batches, "text"):
        kind = batch.schema.field("id").type
        ids, rows, texts, edges = [], [], [], []
        for one, raw in zip(batch.column("id"), batch.column("text"), strict=True):
            text = _text(raw)
            if before is None:
                sketch = Sketch(text)
                ids.append(one), rows.append(empty), texts.append(raw.as_py()), edges.append("start")
            else:
                sketch = before[2] if text == before[1] else Sketch(text)
                ids.append(before[0]), rows.append(_row(before[1], before[2], text, sketch)), texts.append(None), edges.append("inner")
            before = (one, text, sketch, raw)
        yield made(ids, rows, texts, edges, kind)
    if before is not None:
        yield made([before[0]], [empty], [before[3].as_py()], ["end"], kind)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in RowBatches(batches, "text"):
        rows = []
        for raw, following in zip(batch.column("text"), batch.column("following"), strict=True):
            text, after = _text(raw), _text(following)
            rows.append(_row(text, Sketch(text), after, Sketch(after)))
        types = [pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in NAMES]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]], ["id", *NAMES])
