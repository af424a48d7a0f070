"""Which of many strings occur in a corpus.

A bounded list of terms goes to the tasks as one search automaton. A longer one meets
the corpus in a shuffle by anchor, a gram of each term, and how well that goes depends
on how often the corpus holds the anchors. So the corpus is read twice: once to count,
in a count-min sketch, the grams that terms hold, and once to find the anchors chosen
by these counts.

* A term one of whose grams the corpus lacks isn't in the corpus, and is done.
* Each term takes the gram that gives the fewest (place, term) pairs by the sketches of
  corpus and terms. Where every gram of 8 bytes is frequent, it takes one of 16 or 32.
* Terms that have frequent grams only join the automaton of the second pass, as do the
  few terms too short for a gram.
* A hit sends the anchor and the bytes around it that its terms can cover, not its line.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seepage.session import materialise

SIZES = (4, 8, 16, 32)  # bytes of a gram
BITS = 1 << 26  # of the filter that corpus grams pass, for each size
DEPTH, WIDTH = 4, 1 << 16  # counters of a sketch, for each size
EXTENTS = 1 << 18  # slots of the bytes around an anchor
LIGHT = 4_096  # places of an anchor that are never too many
LIGHT_SHARE = 2_000  # nor is this part of all places
BATCH_BYTES = 4 << 20  # of text whose grams are held at a time
MIX = np.uint64(0x9E3779B97F4A7C15)
SEEDS = (np.random.default_rng(7).integers(1 << 62, 1 << 63, DEPTH, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


@functools.lru_cache(maxsize=2)
def _automaton(name: str, shared: Broadcast, key: str = "") -> ahocorasick.Automaton:
    """Built once per worker and term list."""
    made = ahocorasick.Automaton()
    for term in shared.value[key] if key else shared.value:
        made.add_word(term, term)
    made.make_automaton()
    return made


def by_automaton(terms: DataFrame, lines: DataFrame) -> DataFrame:
    """Every text goes once through an automaton of all terms; for a bounded list."""
    spark = terms.sparkSession
    listed = [r["term"] for r in terms.toLocalIterator()]
    if not listed:
        return terms.select("term")
    shared, name = spark.sparkContext.broadcast(listed), uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(name, shared)
        seen: set[str] = set()
        for batch in batches:
            new: set[str] = set()
            for line in batch.column("line"):
                new.update(term for _, term in automaton.iter(line.as_py() or ""))
            new -= seen
            if new:
                seen |= new
                yield pa.RecordBatch.from_arrays([pa.array(sorted(new), pa.string())], ["term"])

    return lines.select("line").mapInArrow(scan, "term string").distinct()


def gram_values(data: np.ndarray) -> dict[int, np.ndarray]:
    """For each size the value of every run of so many bytes; beyond 8 bytes a hash."""
    value, size = data.astype(np.uint64), 1
    out = {}
    while size < SIZES[-1]:
        if len(value) <= size:
            value = np.empty(0, np.uint64)
        elif size < 8:
            value = (value[:-size] << np.uint64(8 * size)) | value[size:]
        else:
            value = value[:-size] * MIX + value[size:]
            value = (value ^ (value >> np.uint64(31))) * MIX
            value ^= value >> np.uint64(29)
        size *= 2
        if size in SIZES:
            out[size] = value
    return out


def _bit(grams: np.ndarray) -> np.ndarray:
    return ((grams * MIX) >> np.uint64(64 - (BITS.bit_length() - 1))).astype(np.int64)


def _slots(grams: np.ndarray, row: int) -> np.ndarray:
    mixed = (grams ^ (grams >> np.uint64(32))) * SEEDS[row]
    return (mixed >> np.uint64(64 - (WIDTH.bit_length() - 1))).astype(np.int64)


def _extent(grams: np.ndarray) -> np.ndarray:
    return ((grams * SEEDS[0]) >> np.uint64(64 - (EXTENTS.bit_length() - 1))).astype(np.int64)


def _passing(grams: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = _bit(grams)
    return ((bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)) > 0


@dataclass
class Sketch:
    """Count-min counters per gram size: an estimate is never below the count."""

    counters: np.ndarray  # size, row, slot

    @classmethod
    def empty(cls) -> Sketch:
        return cls(np.zeros((len(SIZES), DEPTH, WIDTH), np.int64))

    def add(self, kind: int, grams: np.ndarray, counts: np.ndarray) -> None:
        for row in range(DEPTH):
            self.counters[kind, row] += np.bincount(_slots(grams, row), counts, WIDTH).astype(np.int64)

    def estimate(self, kind: int, grams: np.ndarray) -> np.ndarray:
        return np.min([self.counters[kind, row][_slots(grams, row)] for row in range(DEPTH)], axis=0)

    def batch(self) -> pa.RecordBatch:
        flat = self.counters.ravel()
        used = np.flatnonzero(flat)
        return pa.RecordBatch.from_arrays([pa.array(used), pa.array(flat[used])], ["slot", "n"])


def _merged(parts: DataFrame) -> Sketch:
    """The sum of the sketches of all tasks; as many rows as there are counters."""
    found = parts.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = Sketch.empty()
    out.counters.ravel()[np.array(found.column("slot"), np.int64)] = np.array(found.column("n"), np.int64)
    return out


class Batch:
    """The texts of an Arrow array side by side, with the grams that lie inside one text."""

    def __init__(self, texts: pa.Array) -> None:
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        self.data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
        self.starts = offsets[:-1] - offsets[0]
        self.ends = offsets[1:] - offsets[0]
        self.grams = gram_values(self.data)

    def places(self, size: int, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Grams of one size that pass a filter, and where they begin."""
        grams = self.grams[size]
        at = np.flatnonzero(_passing(grams, bits))
        text = np.searchsorted(self.ends, at, "right")
        at = at[at + size <= self.ends[text]]
        return grams[at], at

    @classmethod
    def of(cls, batches: Iterator[pa.RecordBatch], column: str) -> Iterator[Batch]:
        for batch in batches:
            texts = batch.column(column)
            step = max(1, len(texts) * BATCH_BYTES // max(1, texts.nbytes))
            for k in range(0, len(texts), step):
                yield cls(texts.slice(k, step))


def _term_grams(term: str) -> dict[int, np.ndarray]:
    return {size: np.unique(g) for size, g in gram_values(np.frombuffer(term.encode(), np.uint8)).items() if len(g)}


def _bitmaps(rows: DataFrame) -> dict[int, np.ndarray]:
    """Bits of (size, at) rows: for each size BITS of them, whatever the number of rows."""
    words = (
        rows.select("size", F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, CAST(at & 63 AS int))").alias("bit"))
        .groupBy("size", "word")
        .agg(F.bit_or("bit").alias("bits"))
    )
    found = words.toArrow()  # at most BITS / 64 rows a size
    sizes, at = (np.array(found.column(c), np.int64) for c in ("size", "word"))
    bits = np.array(found.column("bits"), np.int64).view(np.uint64)
    out = {}
    for size in SIZES:
        out[size] = np.zeros(BITS // 64, np.uint64)
        out[size][at[sizes == size]] = bits[sizes == size]
    return out


def _grams_of_terms(terms: DataFrame) -> tuple[dict[int, np.ndarray], Sketch]:
    """Filter of all grams that terms hold, and how many terms hold each."""

    def grams_of(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        found: dict[int, list[np.ndarray]] = {size: [] for size in SIZES}
        for term in batch.column("term").to_pylist():
            for size, grams in _term_grams(term).items():
                found[size].append(grams)
        return {size: np.unique(np.concatenate(g), return_counts=True) for size, g in found.items() if g}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch.empty()
        for batch in batches:
            for size, (grams, n) in grams_of(batch).items():
                sketch.add(SIZES.index(size), grams, n)
        yield sketch.batch()

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, (grams, _) in grams_of(batch).items():
                at = np.unique(_bit(grams))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), size, np.int32)), pa.array(at)], ["size", "at"])

    return _bitmaps(terms.mapInArrow(bits, "size int, at bigint")), _merged(terms.mapInArrow(count, "slot bigint, n bigint"))


def corpus_sketch(lines: DataFrame, filters: Broadcast) -> Sketch:
    """How often the corpus holds the grams that pass the filters; one pass."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch.empty()
        for part in Batch.of(batches, "line"):
            for kind, size in enumerate(SIZES):
                grams, n = np.unique(part.places(size, filters.value[size])[0], return_counts=True)
                if len(grams):
                    sketch.add(kind, grams, n)
        yield sketch.batch()

    return _merged(lines.select("line").mapInArrow(count, "slot bigint, n bigint"))


def choose_anchors(terms: DataFrame, corpus: Sketch, shared: Sketch, light: int) -> DataFrame:
    """(term, size, gram, at, places): the best anchor of each term that may be in the corpus.

    ``size`` is 0 for terms too short for a gram. The shortest size counts that has a
    gram with at most ``light`` places; without one, the gram with the fewest.
    """
    held = terms.sparkSession.sparkContext.broadcast((corpus, shared))

    def anchor(term: str) -> tuple | None:
        data = np.frombuffer(term.encode(), np.uint8)
        best = None
        first = max((k for k, size in enumerate(SIZES[:2]) if size <= len(data)), default=0)
        for kind, grams in enumerate(gram_values(data).values()):
            if not len(grams) or kind < first:
                continue
            places = held.value[0].estimate(kind, grams)
            if not places.min():
                return None
            at = int(np.argmin(places * np.maximum(1, held.value[1].estimate(kind, grams))))
            if best is None or places[at] < best[3]:
                best = (SIZES[kind], int(grams[at].view(np.int64)), at, int(places[at]))
            if places[at] <= light:
                break
        return best or (0, 0, 0, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(t, *a) for t in batch.column("term").to_pylist() if (a := anchor(t))]
            if rows:
                kinds = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["term", "size", "gram", "at", "places"]
                )

    return terms.select("term").mapInArrow(run, "term string, size int, gram bigint, at int, places bigint")


def _extents(anchors: DataFrame) -> dict[int, np.ndarray]:
    """Per size and slot of a gram, the most bytes of a term before the anchor's start and from it on."""
    slot = F.shiftrightunsigned(F.col("hash"), 64 - (EXTENTS.bit_length() - 1))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column("gram").to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("size"), pa.array((grams * SEEDS[0]).view(np.int64)), batch.column("at"), batch.column("rest")], ["size", "hash", "at", "rest"])

    rows = anchors.select("size", "gram", "at", (F.octet_length("term") - F.col("at")).alias("rest"))
    most = rows.mapInArrow(hashed, "size int, hash bigint, at int, rest int").groupBy("size", slot.alias("slot")).agg(F.max("at").alias("at"), F.max("rest").alias("rest"))
    found = most.toArrow()  # at most EXTENTS rows a size
    sizes, slots = (np.array(found.column(c), np.int64) for c in ("size", "slot"))
    out = {size: np.zeros((2, EXTENTS), np.int64) for size in SIZES}
    for size in SIZES:
        mine = sizes == size
        out[size][0][slots[mine]] = np.array(found.column("at"), np.int64)[mine]
        out[size][1][slots[mine]] = np.array(found.column("rest"), np.int64)[mine]
    return out


def by_anchor(terms: DataFrame, lines: DataFrame, automaton_chars: int) -> DataFrame:
    """Terms and corpus meet by the terms' anchors; for any number of terms.

    Terms with frequent grams only go through an automaton, as long as they have at most
    ``automaton_chars`` characters together; more of them take part in the join, whose
    skewed partitions Spark splits.
    """
    spark = terms.sparkSession
    filters, shared = _grams_of_terms(terms)
    corpus = corpus_sketch(lines, spark.sparkContext.broadcast(filters))
    places = int(corpus.counters[SIZES.index(8)][0].sum() + corpus.counters[SIZES.index(4)][0].sum())
    anchors = materialise(choose_anchors(terms, corpus, shared, max(LIGHT, places // LIGHT_SHARE)), "anchors")
    sent = anchors.filter("size > 0").groupBy("size", "gram").agg(F.max("places").alias("n")).agg(F.sum("n")).first()[0] or 0
    often = (F.col("size") == 0) | (F.col("places") > max(LIGHT, sent // LIGHT_SHARE))
    chars = anchors.filter(often).agg(F.coalesce(F.sum(F.length("term")), F.lit(0))).first()[0]
    if chars > automaton_chars:
        often = F.col("size") == 0
    direct = [r["term"] for r in anchors.filter(often).select("term").toLocalIterator()]
    joined = materialise(anchors.filter(~often), "light-anchors")

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column("gram").to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("size"), pa.array(_bit(grams))], ["size", "at"])

    wanted = _bitmaps(joined.select("size", "gram").mapInArrow(bits, "size int, at bigint"))
    told = spark.sparkContext.broadcast({"bits": wanted, "extents": _extents(joined), "terms": direct})
    name = uuid.uuid4().hex

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(name, told, "terms") if told.value["terms"] else None
        seen: set[str] = set()
        for part in Batch.of(batches, "line"):
            rows: set[tuple] = set()
            raw = part.data.tobytes()
            for size in SIZES:
                grams, at = part.places(size, told.value["bits"][size])
                slot = _extent(grams)
                text = np.searchsorted(part.ends, at, "right")
                before, rest = told.value["extents"][size]
                low = np.maximum(at - before[slot], part.starts[text])
                high = np.minimum(at + rest[slot], part.ends[text])
                rows.update((size, g, raw[a:b]) for g, a, b in zip(grams.view(np.int64).tolist(), low.tolist(), high.tolist(), strict=True))
            new: set[str] = set()
            if automaton:
                for a, b in zip(part.starts.tolist(), part.ends.tolist(), strict=True):
                    new.update(term for _, term in automaton.iter(raw[a:b].decode("utf-8", "replace")))
                new -= seen
                seen |= new
            listed = list(rows)
            n = len(new)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*sorted(new), *[None] * len(listed)], pa.string()),
                    pa.array([None] * n + [r[0] for r in listed], pa.int32()),
                    pa.array([None] * n + [r[1] for r in listed], pa.int64()),
                    pa.array([None] * n + [r[2] for r in listed], pa.binary()),
                ],
                ["term", "size", "gram", "piece"],
            )

    placed = materialise(lines.select("line").mapInArrow(probe, "term string, size int, gram bigint, piece binary"), "pieces")
    found = placed.filter("piece IS NOT NULL").select("size", "gram", "piece").join(joined, ["size", "gram"])
    found = found.filter(F.contains("piece", F.col("term").cast("binary"))).select("term")
    return found.unionByName(placed.filter("term IS NOT NULL").select("term")).distinct()
