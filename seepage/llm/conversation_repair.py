"""Repair of conversations to the role order ``(s?(ua)+)?`` by an integer minimum.

Each turn is kept, given another role or deleted, and empty turns may be inserted; the
cheapest edits win, and among equally cheap ones the edits whose initials come first in
ASCII. Both are one number: high digits are the cost, and below it every row of the
conversation has three octal digits for the letters of its edits, at most two inserts
and then what happens to the row, filled up with zeros at the end. As each row's
letters end with the only one that isn't an insert, no row's letters start another's,
so padded blocks compare as the joined letters do. An edge of the graph over (row, role
state) adds one such number, and an ordinary minimum over integers decides everything.

Rows are sorted by range, not by conversation, and cut into segments of at most
``SEGMENT`` rows. A segment becomes a matrix of the cheapest number from each state to
each other, so that a conversation of any length is solved in many tasks and only the
matrices of its segments meet. Texts stay where they are: a row joins its edits by
segment and place.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seepage.llm.common import BLANKS, typed
from seepage.session import materialise

SEGMENT = 1024  # rows solved at once
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # costs
LETTERS = "0DIKR"  # digits in ASCII order; zero pads
INITIALS = "sua-"  # the last stands for any other
FAULTS = ("", "truncated", "blank", "duplicate")
LEGAL = {"su", "ua", "au"}
START, SYSTEM, USER, ASSISTANT = range(4)  # what the output so far ends with
BITS = 9  # of a row's block: three octal digits
NAMES = {"u": "user", "a": "assistant"}

Matrix = list[list[int | None]]


def _spoken(state: int) -> tuple[str, int]:
    """The only role among user and assistant that may follow, and the state after it."""
    return ("a", ASSISTANT) if state == USER else ("u", USER)


def _kept(state: int, initial: str) -> int | None:
    """The state after a row that keeps its role, if the order allows it."""
    if initial == "s":
        return SYSTEM if state == START else None
    role, after = _spoken(state)
    return after if role == initial else None


def _block(letters: str) -> int:
    return int("".join(str(LETTERS.index(c)) for c in letters.ljust(3, "0")), 8)


@functools.cache
def _edges(code: str) -> tuple[tuple[int, int, int, int], ...]:
    """(from, to, cost, block) of one row, the cheapest for each pair of states."""
    kind, initial = divmod(ord(code) - ord("a"), 4)
    best: dict[tuple[int, int], int] = {}
    for start in range(4):
        state, inserts = start, ""
        for _ in range(3):  # a third insert would only return to a state, at a cost
            cost = INSERT * len(inserts)
            extra = TRUNCATED if FAULTS[min(kind, 2)] == "truncated" else 0
            ways = [(state, cost + DELETE, "D")]
            if kind < 2:
                ways.append((_spoken(state)[1], cost + REROLE + extra, "R"))
                if (after := _kept(state, INITIALS[initial])) is not None:
                    ways.append((after, cost + KEEP + extra, "K"))
            for after, price, letter in ways:
                value = (price << BITS) | _block(inserts + letter)
                if value < best.get((start, after), value + 1):
                    best[start, after] = value
            state, inserts = _spoken(state)[1], inserts + "I"
    return tuple((a, b, v >> BITS, v & ((1 << BITS) - 1)) for (a, b), v in best.items())


ENDS = {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}


@functools.lru_cache(maxsize=4096)
def solve(codes: str) -> Matrix:
    """Cheapest number from each state to each other over the rows of a segment."""
    width = BITS * len(codes)
    rows: Matrix = [[0 if a == b else None for b in range(4)] for a in range(4)]
    for i, code in enumerate(codes):
        left = BITS * (len(codes) - 1 - i)
        edges = [(a, b, (cost << width) + (block << left)) for a, b, cost, block in _edges(code)]
        for k, row in enumerate(rows):
            new: list[int | None] = [None] * 4
            for a, b, weight in edges:
                if row[a] is not None and (new[b] is None or row[a] + weight < new[b]):
                    new[b] = row[a] + weight
            rows[k] = new
    return rows


def chain(first: Matrix, n: int, second: Matrix, m: int) -> Matrix:
    """The matrix of two neighbouring stretches of ``n`` and ``m`` rows."""
    low_n, low_m = (1 << (BITS * n)) - 1, (1 << (BITS * m)) - 1

    def joined(a: int, b: int) -> int:
        cost = (a >> (BITS * n)) + (b >> (BITS * m))
        return (cost << (BITS * (n + m))) | ((a & low_n) << (BITS * m)) | (b & low_m)

    out: Matrix = []
    for row in first:
        ways = [[joined(x, second[k][b]) for k, x in enumerate(row) if x is not None and second[k][b] is not None] for b in range(4)]
        out.append([min(w) if w else None for w in ways])
    return out


def decide(parts: list[tuple[Matrix, int]]) -> tuple[int, list[str]]:
    """Cost, and the letters of each row's edits, then those after the last row."""
    while len(parts) > 1:
        paired = [(chain(*a, *b), a[1] + b[1]) for a, b in zip(parts[::2], parts[1::2], strict=False)]
        parts = paired + ([parts[-1]] if len(parts) % 2 else [])
    matrix, n = parts[0]
    mask = (1 << (BITS * n)) - 1
    best = min(
        (((v >> (BITS * n)) + ENDS[s][0]) << (BITS * (n + 1))) | ((v & mask) << BITS) | _block(ENDS[s][1])
        for s, v in enumerate(matrix[START])
        if v is not None
    )
    low = best & ((1 << (BITS * (n + 1))) - 1)
    digits = format(low, "o").zfill(3 * (n + 1))
    letters = digits.translate(str.maketrans("01234", LETTERS))
    return best >> (BITS * (n + 1)), [letters[i : i + 3].replace("0", "") for i in range(0, len(letters), 3)]


def speak(blocks: list[str], codes: str) -> list[str]:
    """Each letter with the initial of the role that the turn gets, ``-`` for a deleted one."""
    state, out = START, []
    for i, block in enumerate(blocks):
        made = ""
        for letter in block:
            if letter == "D":
                made += "D-"
            elif letter == "K":
                initial = INITIALS[(ord(codes[i]) - ord("a")) % 4]
                state = _kept(state, initial)
                made += "K" + initial
            else:
                role, state = _spoken(state)
                made += letter + role
        out.append(made)
    return out


def _count_illegal(codes: str) -> int:
    initials = "".join(INITIALS[(ord(c) - ord("a")) % 4] for c in codes)
    return sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1))


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the damage that a checksum of each row's key asks for."""
    text_of = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    harm = F.crc32(F.concat(text_of[0], F.lit(":"), text_of[1]).cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), harm.alias("harm")).filter("harm <> 0")
    new_text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    new_role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("harm") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", new_role.alias("role"), new_text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _sorted_rows(turns: DataFrame) -> DataFrame:
    """All rows in order with their first fault, numbered by segment and place."""
    text = F.coalesce("text", F.lit(" "))
    role = F.coalesce("role", F.lit(" "))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    said = F.btrim("text", F.lit(BLANKS))
    rows = rows.select(
        "*",
        F.unhex(F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text"))).alias("same"),
        (said == "").alias("blank"),
        (~F.substring(said, -1, 1).isin(".", "!", "?")).alias("cut"),
    )
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("at"))
    often = rows.groupBy(F.col("conv_id").alias("_conv"), F.col("same").alias("_same")).agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    rows = rows.join(often, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("same") == F.col("_same")), "left")
    rows = rows.select("conv_id", "turn", "role", "text", "same", "blank", "cut", (F.col("first") < place).alias("later"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role")]
    ranged = rows.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    kind = f"conv_id {typed(rows, 'conv_id')}, turn {typed(rows, 'turn')}, role string, text string, seg bigint, idx int, fault int, code string"
    return materialise(ranged.mapInArrow(_number, kind), "turns")


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal rows of one turn stand together, so a copy is one that equals the row before it."""
    context = TaskContext.get()
    seg, idx = ((context.partitionId() if context else 0) << 40) - 1, 0
    conv: object = batches  # equal to no id
    last: tuple | None = None
    for batch in batches:
        names = ("conv_id", "turn", "role", "same", "blank", "cut", "later")
        segs, places, faults, codes = [], [], [], []
        for one, turn, role, same, blank, cut, later in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if one != conv or idx + 1 == SEGMENT:
                seg, idx = seg + 1, 0
            else:
                idx += 1
            copy = last == (one, turn, same)
            conv, last = one, (one, turn, same)
            fault = 2 if blank else 3 if later or copy else 1 if cut else 0
            segs.append(seg), places.append(idx), faults.append(fault)
            initial = max(0, INITIALS.find(role[:1])) if role[:1] in ("s", "u", "a") else 3
            codes.append(chr(ord("a") + 4 * min(fault, 2) + initial))
        arrays = [batch.column(c) for c in ("conv_id", "turn", "role", "text")]
        made = [pa.array(segs, pa.int64()), pa.array(places, pa.int32()), pa.array(faults, pa.int32()), pa.array(codes, pa.string())]
        yield pa.RecordBatch.from_arrays([*arrays, *made], ["conv_id", "turn", "role", "text", "seg", "idx", "fault", "code"])


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for codes in batch.column("codes").to_pylist():
            cells = [c for row in solve(codes) for c in row]
            found.append([None if c is None else c.to_bytes((c.bit_length() + 7) // 8 or 1, "big") for c in cells])
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("conv_id", "seg", "codes")), pa.array(found, pa.list_(pa.binary()))], ["conv_id", "seg", "codes", "matrix"]
        )


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per segment with its edits; the first one carries what holds for the conversation."""
    for batch in batches:
        convs, segs, edits, costs, audits, illegal = [], [], [], [], [], []
        for conv, parts in zip(batch.column("conv_id").to_pylist(), batch.column("parts").to_pylist(), strict=True):
            cells = [[None if c is None else int.from_bytes(c, "big") for c in p["matrix"]] for p in parts]
            matrices = [([m[i : i + 4] for i in range(0, 16, 4)], len(p["codes"])) for m, p in zip(cells, parts, strict=True)]
            cost, blocks = decide(matrices)
            codes = "".join(p["codes"] for p in parts)
            made = speak(blocks, codes)
            at = 0
            for k, p in enumerate(parts):
                upto = at + len(p["codes"]) + (k == len(parts) - 1)
                convs.append(conv), segs.append(p["seg"]), edits.append(",".join(made[at:upto]))
                costs.append(None if k else cost), audits.append(None if k else "".join(blocks)), illegal.append(None if k else _count_illegal(codes))
                at = upto
        kind = batch.schema.field("conv_id").type
        arrays = [pa.array(convs, kind), pa.array(segs, pa.int64()), pa.array(edits, pa.string()), pa.array(costs, pa.int64()), pa.array(audits, pa.string()), pa.array(illegal, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, ["conv_id", "seg", "edits", "cost", "audit", "illegal"])


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) of a table with conv_id, turn, role and text.

    Rows of a conversation stand in the order of turn, nulls first, then role, then
    text. The first fault of a row counts: blank (nothing but white space), duplicate
    (role and text seen earlier), truncated (no end mark at its end). Conversations:
    conv_id, gaps in the turn numbers (null if beyond a long), blank, duplicate,
    truncated, illegal (neighbours whose role initials aren't su, ua or au), cost and
    audit, the initials of the edits in order. Turns: conv_id, seg, idx, step, which
    order them, role and text after repair.

    A null role or text counts as one space; rows without a conv_id are one
    conversation; repeated rows are duplicates. Other columns are ignored; an empty
    table gives two empty ones. An audit is one cell, as long as its conversation.
    """
    rows = _sorted_rows(turns)
    kind = typed(rows, "conv_id")
    codes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "code"))), lambda x: x["code"]), "")
    segments = rows.groupBy("conv_id", "seg").agg(codes.alias("codes"))
    solved = segments.mapInArrow(_solve, f"conv_id {kind}, seg bigint, codes string, matrix array<binary>")
    parts = F.array_sort(F.collect_list(F.struct("seg", "codes", "matrix")), lambda a, b: F.when(a["seg"] < b["seg"], -1).otherwise(1))
    met = solved.groupBy("conv_id").agg(parts.alias("parts"))
    decided = materialise(met.mapInArrow(_decide, f"conv_id {kind}, seg bigint, edits string, cost bigint, audit string, illegal bigint"), "edits")

    span = F.max("turn").cast("decimal(38,0)") - F.min("turn").cast("decimal(38,0)") + 1 - F.count_distinct("turn")
    counted = rows.groupBy("conv_id").agg(
        F.coalesce(span, F.lit(0)).try_cast("bigint").alias("gaps"),
        *[F.count(F.when(F.col("fault") == FAULTS.index(f), 1)).alias(f) for f in ("blank", "duplicate", "truncated")],
    )
    verdict = decided.filter("cost IS NOT NULL").select(F.col("conv_id").alias("_conv"), "illegal", "cost", "audit")
    conversations = counted.join(verdict, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")

    each = decided.select("conv_id", F.col("seg").alias("_seg"), F.posexplode(F.split("edits", ",")).alias("_idx", "made"))
    steps = each.select("conv_id", "_seg", "_idx", F.posexplode(F.regexp_extract_all("made", F.lit("([IKR][sua-])"), 1)).alias("step", "edit"))
    joined = steps.join(rows.select("seg", "idx", "role", "text"), (F.col("_seg") == F.col("seg")) & (F.col("_idx") == F.col("idx")), "left")
    letter, initial = F.substring("edit", 1, 1), F.substring("edit", 2, 1)
    named = F.when(initial == "u", NAMES["u"]).otherwise(NAMES["a"])
    repaired = joined.select(
        "conv_id",
        F.col("_seg").alias("seg"),
        F.col("_idx").alias("idx"),
        "step",
        F.when(letter == "K", F.col("role")).otherwise(named).alias("role"),
        F.when(letter == "I", "").otherwise(F.col("text")).alias("text"),
    )
    return conversations, repaired


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the ``role:text`` of a conversation's turns, a line each.

    The rows of a conversation stream through one task in order, as the digest asks;
    none is held.
    """
    order = ["conv_id", "seg", "idx", "step"]
    lines = turns.select(*order, F.concat_ws(":", "role", "text").cast("binary").alias("line")).repartition("conv_id").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest = None, None
        for batch in batches:
            convs, found = [], []
            for one, line in zip(batch.column("conv_id").to_pylist(), batch.column("line"), strict=True):
                if digest is None or one != conv:
                    if digest is not None:
                        convs.append(conv), found.append(digest.hexdigest())
                    conv, digest = one, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(line.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(convs, batch.schema.field("conv_id").type), pa.array(found, pa.string())], ["conv_id", "repaired_sha256"])
            kind = batch.schema.field("conv_id").type
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([digest.hexdigest()], pa.string())], ["conv_id", "repaired_sha256"])

    return lines.mapInArrow(run, f"conv_id {typed(lines, 'conv_id')}, repaired_sha256 string")
