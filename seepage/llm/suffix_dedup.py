"""Removal of byte strings that occurred before, in documents of any number and length.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier.
Every such window is known by its anchor: the gram of ``GRAM`` bytes inside it whose
hash is least, leftmost first. Equal windows have equal anchors, so work meets by
anchor. Neighbouring windows with one anchor form a run, stored as two hashes and a
place, about one for 35 bytes:

* runs that repeat as a whole are settled by their hash, first where they are read,
  so that a passage held by any number of documents leaves a row per read partition;
* where one anchor has different runs, the first of each is laid out as text, and a
  Burrows-Wheeler transform of many such runs gives the windows they share: intervals
  are extended backward, breadth first, which finds common prefixes in increasing
  length, and stops at ``LENGTH``; whatever has no boundary by then is one window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seepage.llm.common import released, text_batches
from seepage.session import fits_broadcast, materialise

LENGTH = 100
GRAM = 32
PLACES = 20  # bits for a place within a piece of text, the rest order the hashes
PIECE = (1 << PLACES) - LENGTH
CHUNK = 12 << 20  # bytes of text whose runs are compared before they are sent
LAYOUT = 1 << 19  # bytes of text in one transform, whole anchors aside
MAX_RUNS = 5_000  # different runs of an anchor laid out together
IDS = 1_000_000  # document ids up to which they are broadcast to filter texts
LAST = (1 << 63) - 1  # stands for a null id
DEPTH = 7  # symbols in the first sort key
SEED = 0x9E3779B97F4A7C15
BASE = 0xD6E8FEB86659FD93


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


POWER = _powers(BASE, 1 << PLACES)
INVERSE = _powers(pow(BASE, -1, 1 << 64), 1 << PLACES)
BYTE = np.array([xxhash.xxh64_intdigest(bytes([b]), 1) for b in range(256)], np.uint64)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A mixed rolling hash of every GRAM bytes of at most 2**PLACES bytes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * POWER[: len(data)], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * INVERSE[: len(data) - GRAM + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(SEED)
    h ^= h >> np.uint64(29)
    return h


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, anchor) of every run in a piece of several documents.

    ``ends[i]`` is the end of the document that byte i belongs to.
    """
    if len(data) < LENGTH:
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    hashes = gram_hashes(data)
    mask = np.uint64((1 << PLACES) - 1)
    order = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
    place = (sliding_least(order, LENGTH - GRAM + 1) & mask).astype(np.int64)
    at = np.flatnonzero(ends[: len(place)] - np.arange(len(place)) >= LENGTH)
    if not len(at):
        return at, at, at
    new = np.flatnonzero((np.diff(place[at]) != 0) | (np.diff(at) != 1)) + 1
    first = np.concatenate([[0], new])
    count = np.diff(np.concatenate([first, [len(at)]]))
    start = at[first]
    return start, count, hashes[place[start]].view(np.int64)


def pack(start: np.ndarray, tie: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A run within its document as one long: start, 24 bits of the text's hash, windows."""
    return (start.astype(np.int64) << 32) | (tie.astype(np.int64) << 8) | count.astype(np.int64)


def start_of(packed: np.ndarray) -> np.ndarray:
    return packed >> 32


def pieces(offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(first byte, end of window starts, last byte) of pieces, cut between documents where possible."""
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        stop = int(offsets[np.searchsorted(offsets, at + PIECE, "right") - 1])
        if stop > at:
            yield at, stop, stop
        else:  # one long document: the next piece starts where no window has started yet
            stop = min(at + PIECE, end)
            yield at, stop, min(stop + LENGTH - 1, end)
        at = stop


def _runs_of(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(anchor, run hash, id, packed) of all texts of a batch."""
    texts = batch.column("text").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    ids, ties = (batch.column(c).to_numpy() for c in ("id", "tie"))
    out = []
    for first, stop, last in pieces(offsets):
        part = data[first:last]
        docs = np.searchsorted(offsets, [first, last - 1], "right") - 1
        bounds = np.clip(offsets[docs[0] : docs[1] + 2] - first, 0, None)
        ends = np.repeat(bounds[1:], np.diff(np.minimum(bounds, len(part))))
        start, count, anchor = runs(part, ends)
        keep = start < stop - first
        start, count, anchor = start[keep], np.minimum(count[keep], stop - first - start[keep]), anchor[keep]
        view = memoryview(part)
        hashes = [xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(start.tolist(), (start + count + LENGTH - 1).tolist(), strict=True)]
        doc = np.searchsorted(offsets, start + first, "right") - 1
        place = start + first - offsets[doc]
        out.append((anchor, np.array(hashes, np.uint64).view(np.int64), ids[doc], pack(place, ties[doc], count)))
    if not out:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _leads(anchor: np.ndarray, run: np.ndarray, ids: np.ndarray, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by all four: where an anchor begins, and which rows come first of equal runs.

    A row at the very place of the first, as rows that repeat an id have, isn't later.
    """
    new_anchor = np.concatenate([[True], anchor[1:] != anchor[:-1]])
    new_run = new_anchor | np.concatenate([[True], run[1:] != run[:-1]])
    head = np.maximum.accumulate(np.where(new_run, np.arange(len(run)), 0))
    return new_anchor, (ids == ids[head]) & (start_of(packed) == start_of(packed[head]))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of the texts; those that repeat one of the same chunk are settled here."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        rows = tuple(np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(rows[0], kind="stable")
        sorted_anchor = rows[0][order]
        same = sorted_anchor[1:] == sorted_anchor[:-1]
        shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        settled = np.zeros(len(order), bool)
        some = order[shared] if len(order) else order
        if len(some):
            some = some[np.lexsort([rows[c][some] for c in (3, 2, 1, 0)])]
            settled[some] = ~_leads(*[rows[c][some] for c in range(4)])[1]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (*rows, settled)], ["a", "h", "id", "run", "settled"])

    for batch in batches:
        held.append(_runs_of(batch))
        size += batch.column("text").nbytes
        if size >= CHUNK:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats of runs, and the first of each run where an anchor has several.

    Rows come sorted by anchor, run, id and place. Between batches only the first
    rows of the last run are carried, marked if they are out already.
    """
    names = ("a", "h", "id", "run")
    carry = tuple(np.empty(0, np.int64) for _ in names)
    out = False
    for batch in batches:
        rows = [batch.column(c).to_numpy() for c in names]
        settled = batch.column("settled").to_numpy(zero_copy_only=False)
        if settled.any():
            yield _found(rows[2][settled], rows[3][settled], rows[0][settled], False)
        old = np.concatenate([np.full(len(carry[0]), out), np.zeros((~settled).sum(), bool)])
        rows = [np.concatenate([c, r[~settled]]) for c, r in zip(carry, rows, strict=True)]
        anchor, run, ids, packed = rows
        if not len(anchor):
            continue
        new_anchor, lead = _leads(*rows)
        group = np.cumsum(new_anchor) - 1
        changes = ~new_anchor & np.concatenate([[False], run[1:] != run[:-1]])
        several = np.bincount(group, changes | old) > 0
        later = ~lead
        yield _found(ids[later], packed[later], anchor[later], False)
        first = lead & several[group] & ~old
        yield _found(ids[first], packed[first], anchor[first], True)
        out = bool(several[-1])
        kept = lead & (group == group[-1]) & (run == run[-1])
        carry = tuple(r[kept] for r in rows)


def _found(ids: np.ndarray, packed: np.ndarray, anchor: np.ndarray, mixed: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(ids), pa.array(packed), pa.array(anchor), pa.array(np.full(len(ids), mixed))], ["id", "run", "a", "mixed"]
    )


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffixes by their first 112 symbols, ties in any order; ``symbols`` ends in a unique 0."""
    n = len(symbols)
    key = np.zeros(n, np.int64)
    for k in range(DEPTH):
        key <<= 9
        key[: n - k] |= symbols[k:]
    depth = DEPTH
    while True:
        order = np.argsort(key)
        if depth > LENGTH:
            return order
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        key = rank * (n + 1)
        key[: n - depth] += rank[depth:] + 1
        depth *= 2


def prefix_boundaries(symbols: np.ndarray, order: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """True at i if the suffixes at i-1 and i of ``order`` share fewer than ``length`` symbols.

    Breadth-first backward extension on the Burrows-Wheeler transform: from the
    intervals of all strings of some length, the intervals of these strings with a
    symbol put before them follow by the last-to-first mapping. Where such an
    interval ends and no boundary is known yet, the common prefix there has just
    that length; only such intervals are extended further, so the work in all is
    one step per boundary.
    """
    n = len(order)
    before = symbols[order - 1]
    by_symbol = np.argsort(before, kind="stable")
    forward = np.empty(n, np.int64)
    forward[by_symbol] = np.arange(n)
    same = before[by_symbol[1:]] == before[by_symbol[:-1]]
    previous, following = np.full(n, -1), np.full(n, n)
    previous[by_symbol[1:][same]] = by_symbol[:-1][same]
    following[by_symbol[:-1][same]] = by_symbol[1:][same]
    boundary = np.zeros(n + 1, bool)
    boundary[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(length):
        if not len(low):
            break
        single = high - low == 1
        lows, highs = [forward[low[single]]], [forward[low[single]] + 1]
        lo, hi = low[~single], high[~single]
        if len(lo):
            width = hi - lo
            of = np.repeat(np.arange(len(lo)), width)
            at = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + lo[of]
            opens, closes = previous[at] < lo[of], following[at] >= hi[of]
            # the rows of one interval and symbol map to one interval; sorted, openings and closings pair up
            lows.append(np.sort(forward[at[opens]]))
            highs.append(np.sort(forward[at[closes]]) + 1)
        low, high = np.concatenate(lows), np.concatenate(highs)
        fresh = ~boundary[high]
        low, high = low[fresh], high[fresh]
        boundary[high] = True
    return boundary[:n]


def repeated_windows(texts: list[bytes], counts: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """For each run of windows, which of them also start earlier in another run or the same.

    ``texts[i]`` holds ``counts[i]`` windows and starts at ``starts[i]`` of document ``ids[i]``.
    """
    joined = np.frombuffer(b"".join(t + b"\xff" for t in texts), np.uint8)
    symbols = np.concatenate([joined.astype(np.int64) + 1, [0]])
    order = suffix_order(symbols)
    group = np.cumsum(prefix_boundaries(symbols, order))
    offset = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])[:-1]
    of = np.repeat(np.arange(len(texts)), counts)
    shift = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    place = np.empty(len(symbols), np.int64)
    place[order] = group
    kind = place[offset[of] + shift]
    at = starts[of] + shift
    sort = np.lexsort((at, ids[of], kind))
    head = np.concatenate([[True], kind[sort][1:] != kind[sort][:-1]])
    lead = sort[np.maximum.accumulate(np.where(head, np.arange(len(sort)), 0))]
    later = np.empty(len(sort), bool)
    later[sort] = (ids[of][sort] != ids[of][lead]) | (at[sort] != at[lead])
    return np.split(later, np.cumsum(counts)[:-1])


def _lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shared windows of runs sorted by anchor; an anchor that a batch cuts waits for its rest."""
    waiting: list[tuple[int, int, int, bytes]] = []
    size = 0

    def solve(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        _, ids, packed, texts = zip(*rows, strict=True)
        ids, packed = np.array(ids, np.int64), np.array(packed, np.int64)
        found_ids, found_runs = [], []
        for i, later in enumerate(repeated_windows(list(texts), packed & 0xFF, ids, start_of(packed))):
            edge = np.flatnonzero(np.diff(np.concatenate([[False], later, [False]]).astype(np.int8)))
            for lo, hi in edge.reshape(-1, 2).tolist():
                found_ids.append(ids[i])
                found_runs.append(((packed[i] >> 32) + lo) << 32 | (packed[i] & 0xFFFFFF00) | (hi - lo))
        return pa.RecordBatch.from_arrays([pa.array(found_ids, pa.int64()), pa.array(found_runs, pa.int64())], ["id", "run"])

    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("a", "id", "run", "piece")], strict=True):
            if size >= LAYOUT and row[0] != waiting[-1][0]:
                yield solve(waiting)
                waiting, size = [], 0
            waiting.append(row)
            size += len(row[3])
    if waiting:
        yield solve(waiting)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of every run that its document is asked for."""
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        found: list[tuple[int, int, int, bytes]] = []
        for doc, text, asked in zip(batch.column("id").to_pylist(), texts, batch.column("asked").to_pylist(), strict=True):
            view = memoryview(text.as_py() or b"")
            for one in asked:
                start, count = one["run"] >> 32, one["run"] & 0xFF
                found.append((one["a"], doc, one["run"], bytes(view[start : start + count + LENGTH - 1])))
        columns = list(zip(*found, strict=True)) or [[], [], [], []]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["a", "id", "run", "piece"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the runs by its 128-bit hash."""
    for batch in batches:
        rows = []
        for doc, run, piece in zip(*[batch.column(c).to_pylist() for c in ("id", "run", "piece")], strict=True):
            for k in range(run & 0xFF):
                one = ((run >> 32) + k) << 32 | (run & 0xFFFFFF00) | 1
                rows.append((xxhash.xxh3_128_digest(piece[k : k + LENGTH]), doc, one))
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.int64()), strict=True)], ["digest", "id", "run"]
        )


def _place(run: Column) -> Column:
    return F.shiftright(run, 32)


def _tie(run: Column) -> Column:
    return F.shiftright(run, 8).bitwiseAND(F.lit(0xFFFFFF))


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with ``__seepage_id``, null ids last, and ``__seepage_tie``, which tells rows of one id apart."""
    tie = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).bitwiseAND(F.lit(0xFFFFFF))
    return docs.withColumn("__seepage_id", F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST))).withColumn("__seepage_tie", tie)


def _among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Fewer documents before a shuffle, where their ids are few enough to broadcast."""
    named = ids.select(F.col("id").alias("__seepage_id")).distinct()
    return docs.join(F.broadcast(named), "__seepage_id", "left_semi") if fits_broadcast(named, IDS) else docs


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tie, runs): for every document with repeats, the runs of windows to remove."""
    text_batches(docs.sparkSession)
    rows = _numbered(docs, id_col, text_col).select(
        F.col("__seepage_id").alias("id"), F.col("__seepage_tie").alias("tie"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    read = rows.mapInArrow(released(_read), "a bigint, h bigint, id bigint, run bigint, settled boolean")
    dealt = F.when(F.col("settled"), F.xxhash64("id", "run")).otherwise(F.col("a"))
    met = materialise(
        read.repartition(dealt)
        .sortWithinPartitions("a", "h", "id", "run")
        .mapInArrow(released(_meet), "id bigint, run bigint, a bigint, mixed boolean"),
        "repeats",
    )
    mixed = met.filter("mixed").drop("mixed")
    asked = mixed.groupBy("id", _tie(F.col("run")).alias("tie")).agg(F.collect_list(F.struct("a", "run")).alias("asked"))
    few = _among(rows.withColumnRenamed("id", "__seepage_id"), mixed.select("id")).withColumnRenamed("__seepage_id", "id")
    cut = materialise(
        few.join(asked, ["id", "tie"]).mapInArrow(released(_cut), "a bigint, id bigint, run bigint, piece binary"), "runs"
    )
    crowds = cut.groupBy("a").count().filter(F.col("count") > MAX_RUNS).select("a")
    laid = (
        cut.join(crowds, "a", "left_anti")
        .repartition("a")
        .sortWithinPartitions("a")
        .mapInArrow(released(_lay_out), "id bigint, run bigint")
    )
    windows = cut.join(crowds, "a", "left_semi").mapInArrow(released(_digests), "digest binary, id bigint, run bigint")
    place = F.struct("id", _place(F.col("run")).alias("place"))
    first = windows.groupBy("digest").agg(F.min(place).alias("first"))
    crowded = windows.join(first, "digest").filter(place > F.col("first")).select("id", "run")
    whole = met.filter("NOT mixed").select("id", "run")
    return (
        whole.unionByName(laid)
        .unionByName(crowded)
        .groupBy(F.col("id").alias("__seepage_id"), _tie(F.col("run")).alias("__seepage_tie"))
        .agg(F.collect_list("run").alias("__seepage_runs"))
    )


def removed_bytes(packed: np.ndarray) -> np.ndarray:
    """Maximal removed stretches (start, end) that runs of windows cover, in order."""
    start = start_of(packed)
    sort = np.argsort(start, kind="stable")
    start, end = start[sort], (start + (packed & 0xFF) + LENGTH - 1)[sort]
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    return np.stack([start[new], reach[np.concatenate([new[1:], [True]])]], axis=1)


def _removing(kept: list[str], text_col: str, as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).cast(pa.large_binary())
            rest, removed, spans = [], [], []
            for text, runs_ in zip(texts, batch.column("__seepage_runs"), strict=True):
                view = text.as_py() or b""
                stretches = removed_bytes(runs_.values.to_numpy())
                edges = [0, *stretches.ravel().tolist(), len(view)]
                left = b"".join(view[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rest.append(left.decode("utf-8", "ignore") if as_text else left)
                removed.append(int((stretches[:, 1] - stretches[:, 0]).sum()))
                spans.append(len(stretches))
            columns = [batch.column(c) for c in kept]
            added = [pa.array(rest, pa.string() if as_text else pa.binary()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *added], [*kept, "kept", "n_removed", "n_spans"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False) -> DataFrame:
    """``docs`` with ``kept``, ``n_removed`` and ``n_spans``; columns of these names are replaced.

    ``kept`` is the rest of the UTF-8 bytes, as binary, or as a string without
    the characters that a removal cut. Documents are ordered by id, an integer,
    with null ids last and equal to each other; rows that repeat an id aren't
    earlier than one another except by place. Null texts are empty and keep an
    empty rest. An empty table gives an empty result.
    """
    docs = docs.drop("kept", "n_removed", "n_spans")
    found = materialise(repeats(docs, id_col, text_col), "repeats-by-document")
    numbered = _numbered(docs, id_col, text_col)
    whole = F.coalesce(F.col(text_col), F.lit(""))
    untouched = [whole if as_text else F.encode(whole, "UTF-8"), F.lit(0).cast("bigint"), F.lit(0).cast("bigint")]
    added = [c.alias(n) for c, n in zip(untouched, ("kept", "n_removed", "n_spans"), strict=True)]
    keys = found.select("__seepage_id").distinct()
    extra = [
        T.StructField("kept", T.StringType() if as_text else T.BinaryType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()),
    ]
    schema = T.StructType([*docs.schema.fields, *extra])
    remove = _removing(docs.columns, text_col, as_text)
    if fits_broadcast(keys, IDS):
        touched = numbered.join(F.broadcast(keys), "__seepage_id", "left_semi").join(found, ["__seepage_id", "__seepage_tie"], "left")
        rest = numbered.join(F.broadcast(keys), "__seepage_id", "left_anti")
        changed = touched.filter("__seepage_runs IS NOT NULL").select(*docs.columns, "__seepage_runs").mapInArrow(released(remove), schema)
        rest = rest.select(*docs.columns, *added)
        return changed.unionByName(rest).unionByName(touched.filter("__seepage_runs IS NULL").select(*docs.columns, *added))
    joined = numbered.join(found, ["__seepage_id", "__seepage_tie"], "left")
    changed = joined.filter("__seepage_runs IS NOT NULL").select(*docs.columns, "__seepage_runs").mapInArrow(released(remove), schema)
    return changed.unionByName(joined.filter("__seepage_runs IS NULL").select(*docs.columns, *added))
