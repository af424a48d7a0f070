"""Conversation repair against a plain search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from seepage.llm import conversation_repair as cr
from seepage.llm import queries

SHAPE = "conv_id bigint, turn bigint, role string, text string, seg string, cost string, same int"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        harm = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if harm == 0:
            continue
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        role = "user" if harm == 4 else role
        out += [(conv, turn, role, text)] * (2 if harm == 3 else 1)
    return out


def plain_faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        spoken = text.strip(" \t\n\x0b\f\r")
        out.append("blank" if not spoken else "duplicate" if (role, text) in seen else "" if spoken[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plain_edits(rows, faults):
    """Cheapest edits by a search over (cost, letters): the first that ends well is the best."""
    grammar = re.compile(r"(s?(ua)+)?")
    heap = [(0, "", 0, "", ())]
    while heap:
        cost, audit, at, roles, lines = heapq.heappop(heap)
        if at == len(rows) and grammar.fullmatch(roles):
            return cost, audit, lines
        def go(price, letter, step, role=None, text="", cost=cost, audit=audit, at=at, roles=roles, lines=lines):
            new = roles + (role[:1] if role else "")
            if re.fullmatch(r"s?(ua)*u?", new) and price + cost <= 2 * len(rows):
                heapq.heappush(heap, (cost + price, audit + letter, at + step, new, lines if role is None else (*lines, f"{role}:{text}")))

        for role in ("user", "assistant"):
            go(5, "I", 0, role)
        if at < len(rows):
            _, _, role, text = rows[at]
            go(2, "D", 1)
            if faults[at] not in ("blank", "duplicate"):
                extra = 5 if faults[at] else 0
                if role[:1] in ("s", "u", "a"):
                    go(extra, "K", 1, role, text)
                for new in ("user", "assistant"):
                    go(1 + extra, "R", 1, new, text)
    raise AssertionError


def plain_repair(data):
    """{conv: (gaps, blank, duplicate, truncated, illegal, cost, audit, sha)}"""
    out = {}
    for conv in {d[0] for d in data}:
        rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in data if c == conv]
        rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        faults = plain_faults(rows)
        turns = {t for _, t, _, _ in rows if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [r[2][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, lines = plain_edits(rows, faults)
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)
    return out


def conversations(seed=1, n=150):
    rnd = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "usher", "", None]
    texts = ["Hi.", "Yes!", "Why?", "no end", " \t", "", None, "Done. \n", "Élan.", "x. y"]
    out = []
    for conv in range(n):
        turn = 0
        for _ in range(rnd.randint(1, 7)):
            turn += rnd.choice([0, 1, 1, 1, 3])
            out.append((conv if conv else None, turn if rnd.random() > 0.05 else None, rnd.choice(roles), rnd.choice(texts)))
    out += [(n, t, r, x) for t, (r, x) in enumerate([("system", "S."), ("user", "Q?"), ("assistant", "A.")] * 2)]
    out += [(n + 1, None, "user", "Q?"), (n + 1, None, "user", "Q?"), (n + 2, 5, "system", "S.")]
    out += [(n + 3, -(1 << 63), "user", "Q?"), (n + 3, (1 << 63) - 1, "assistant", "A.")]
    rnd.shuffle(out)
    return out


def frame(spark, data):
    return spark.createDataFrame([(*d, "x", "y", 1) for d in data], SHAPE).repartition(4)


def found(conversations_, turns):
    sha = {r.conv_id: r.repaired_sha256 for r in cr.digests(turns).collect()}
    none = hashlib.sha256(b"").hexdigest()
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, sha.get(r.conv_id, none)) for r in conversations_.collect()}


@pytest.mark.parametrize("segment", [1024, 2])
def test_repair_equals_a_plain_search(spark, monkeypatch, segment):
    data = conversations()
    want = plain_repair(data)
    wide = next(i for i, t, _, _ in data if t == (1 << 63) - 1)
    want[wide] = (None, *want[wide][1:])
    if segment == 1024:
        assert found(*cr.repair(frame(spark, data))) == want
        return
    # any cut into segments gives the same edits
    for conv in sorted({d[0] for d in data if d[0] is not None}):
        rows = sorted(((t, " " if r is None else r, " " if x is None else x) for c, t, r, x in data if c == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults = plain_faults([(conv, *r) for r in rows])
        kinds = {"": 0, "truncated": 1, "blank": 2, "duplicate": 2}
        codes = "".join(chr(97 + 4 * kinds[f] + (("sua".index(r[1][:1])) if r[1][:1] in ("s", "u", "a") else 3)) for r, f in zip(rows, faults, strict=True))
        parts = [codes[i : i + segment] for i in range(0, len(codes), segment)]
        cost, blocks = cr.decide([(cr.solve(p), len(p)) for p in parts])
        assert (cost, "".join(blocks)) == want[conv][5:7]


def test_one_long_conversation_over_many_segments(spark):
    rnd = random.Random(4)
    data = [(7, t, rnd.choice(["user", "assistant", "system"]), f"say {t}" + rnd.choice([".", ""])) for t in range(5000)]
    summary, turns = cr.repair(frame(spark, data))
    [row] = summary.collect()
    rows = [(7, t, r, x) for _, t, r, x in data]
    codes = "".join(chr(97 + 4 * (f == "truncated") + "sua".index(r[2][0])) for r, f in zip(rows, plain_faults(rows), strict=True))
    cost, blocks = cr.decide([(cr.solve(codes), len(codes))])
    assert (row.cost, row.audit) == (cost, "".join(blocks)) and row.audit.count("K") > 1000
    order = turns.orderBy("seg", "idx", "step").collect()
    assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in order))


def test_no_rows(spark):
    summary, turns = cr.repair(frame(spark, []))
    assert summary.count() == 0 and turns.count() == 0 and cr.digests(turns).count() == 0


def test_query_over_damaged_rows(spark, tmp_path):
    data = conversations(seed=3)
    spark.createDataFrame([(*d,) for d in data], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in queries.QUERIES["op12_conversation_repair"](spark, str(tmp_path)).collect()}
    want = plain_repair(plain_damage(data))
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    wide = next((i for i, t, _, _ in data if t == (1 << 63) - 1), None)
    if wide in want and want[wide][0] >= 1 << 63:
        want[wide] = (0, *want[wide][1:])
    assert got == {conv: want.get(conv, none) for conv in {d[0] for d in data}}
