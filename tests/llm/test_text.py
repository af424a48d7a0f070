"""SimHash components, byte-pair codec, repeated byte strings."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
import xxhash
from cases import frame, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seepage.llm import bpe, components, simhash, suffix_dedup

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    """Smallest index of each linked group, by all pairs."""
    top = list(range(len(prints)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_components_of_documents(spark):
    data = rows()
    got = simhash.near_duplicates(frame(spark, data)).collect()
    assert len(got) == len(data)
    ordered = sorted((d for d in data if d[0] is not None), key=lambda d: d[0])
    prints = [plain_print(d[1]) for d in ordered]
    groups = plain_groups(prints)
    want = {d[0]: (f"{p:016x}", ordered[g][0]) for d, p, g in zip(ordered, prints, groups, strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got if r.doc_id is not None} == want
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("shard_rows", [20_000, 3])
def test_links_by_trees_equal_all_pairs(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(simhash, "SHARD_ROWS", shard_rows)
    rnd = random.Random(5)
    prints = {rnd.getrandbits(64) for _ in range(40)}
    for _ in range(300):  # chains and dense groups
        prints.add(rnd.choice(sorted(prints)[:60]) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    ordered = sorted(prints)
    signed = [int(np.uint64(p).view(np.int64)) for p in ordered]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp bigint"))
    assert edges.count() <= 6 * len(prints)
    rep = {r.v: r.rep for r in components.components(edges).collect()}
    groups = plain_groups(ordered)
    ours = [rep.get(p, p) for p in signed]
    assert len(set(zip(ours, groups, strict=True))) == len(set(ours)) == len(set(groups))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 501), (7, 7)], "a bigint, b bigint")
    rep = {r.v: r.rep for r in components.components(edges).collect()}
    assert len({rep[i] for i in range(301)}) == 1 and rep[500] == rep[501] != rep[0] and len(rep) == 303


def test_one_document_of_each_group_stays(spark):
    data = rows()
    kept = simhash.keep_one(frame(spark, data)).collect()
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame(spark, data)).collect()}
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    assert sorted(ids) == sorted({c for i, c in found.items() if i is not None})
    assert sum(r.doc_id is None for r in kept) == 2


def test_rows_that_share_an_id_are_judged_by_their_text(spark):
    a, b, c = ("one two three four five six seven", "other words in this text here", "a third text with its own words")
    rows_ = [(3, a), (5, a), (5, b), (9, c), (9, c), (9, c.upper()), (11, c), (None, a), (None, None), (12, None), (12, "")]
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows_], "doc_id bigint, text string, _gone string, id string, fp string")
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    kept = sorted(((r.doc_id, r.text, r._gone) for r in got.collect()), key=repr)
    assert kept == sorted([(3, a, "x"), (5, b, "x"), (9, c.upper(), "x"), (12, None, "x"), (None, a, "x"), (None, None, "x")], key=repr)


def test_unknown_ids_stand_for_nothing(spark):
    ids = bpe.codec_for(open(PATH, "rb").read()).encode("some text").tolist()
    rows_ = [(1, [*ids, 10**9, -1], "a"), (1, [10**9], "a"), (None, None, "b"), (2, [], None), (3, [ids[0], None, *ids[1:]], "a")]
    df = spark.createDataFrame(rows_, "doc_id bigint, ids array<int>, decoded string")
    got = sorted(((r.doc_id, r.decoded) for r in bpe.decode(df, PATH).collect()), key=repr)
    whole = Tokenizer.from_file(PATH).decode(ids, skip_special_tokens=False)
    assert got == sorted([(1, whole), (1, ""), (None, ""), (2, ""), (3, whole)], key=repr)
    clash = spark.createDataFrame([(1, "some text", "old")], "doc_id bigint, text string, ids string")
    assert bpe.encode(clash, PATH).first().ids == ids


@pytest.fixture(scope="module")
def codec():
    return bpe.codec_for(open(PATH, "rb").read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abeinorst  '.!\n\u00a0ΣσİÀé\u0301中1²<|>😀", max_size=200))
def test_codec_equals_the_library(text):
    codec, library = bpe.codec_for(open(PATH, "rb").read()), Tokenizer.from_file(PATH)
    assert codec.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_codec_on_long_words_and_marks(codec, library):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("aeihnorst") for _ in range(3000)), "an" * 2000, "!" * 3000, "a<|endoftext|>B <|startoftext|>", "<|ENDOFTEXT|>", "don't I'LL"]
    for text in texts:
        ids = codec.encode(text).tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids
        decoder = bpe.Decoder(open(PATH, "rb").read())
        assert "".join(decoder.feed(ids[i : i + 3]) for i in range(0, len(ids), 3)) + decoder.finish() == library.decode(ids, skip_special_tokens=False)


def test_segments_change_nothing(codec, monkeypatch):
    text = "Él niño\u0301 über \u0301x " * 50
    whole = codec.encode(text).tolist()
    monkeypatch.setattr(bpe, "SEGMENT", 7)
    assert codec.encode(text).tolist() == whole


def test_transducer_memory_stays_bounded(codec):
    transducer = bpe.Transducer(codec)
    rnd = random.Random(4)
    most = 0
    for _ in range(200):
        transducer.feed("".join(rnd.choice("abcdefghilmnoprst") for _ in range(100)))
        most = max(most, len(transducer.text))
    assert most <= 8 * codec.vocabulary.lookahead


def test_pair_test_equals_merging(codec):
    v, rnd = codec.vocabulary, random.Random(9)
    tokens = sorted(codec.tokens)
    inner = [t for t in tokens if not t.endswith("</w>")]
    for _ in range(5000):
        a, b = rnd.choice(inner), rnd.choice(tokens)
        assert codec._apart(a, b) == (v.merged(v.symbols(a) + v.symbols(b)) == [a, b])


def test_text_of_bytes(codec):
    ids = codec.encode("naïve 中 text").tolist()
    decoder = bpe.Decoder(open(PATH, "rb").read(), text=True)
    assert "".join(decoder.feed([i]) for i in ids) + decoder.finish() == "naïve 中 text "


def test_encode_and_decode_frames(spark, library):
    data = rows()
    encoded = bpe.encode(frame(spark, data), PATH, keep_text=True)
    got = bpe.decode(encoded, PATH).collect()
    assert len(got) == len(data)
    for r in encoded.collect():
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids
    for r in got:
        assert r.decoded == library.decode(library.encode(r.text or "", add_special_tokens=False).ids, skip_special_tokens=False)
    assert bpe.decode(bpe.encode(frame(spark, []), PATH), PATH).count() == 0


def plain_removal(data):
    """By the definition: each 100-byte string against the places of all equal ones."""
    order = [((i is None, i or 0), (t or "").encode()) for i, t in data]
    first = {}
    for place, text in order:
        for k in range(len(text) - 99):
            window = text[k : k + 100]
            first[window] = min(first.get(window, (place, k)), (place, k))
    out = []
    for place, text in order:
        gone = bytearray(len(text))
        for k in range(len(text) - 99):
            if first[text[k : k + 100]] < (place, k):
                gone[k : k + 100] = b"\1" * 100
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((sum(gone), spans, kept))
    return out


@pytest.mark.parametrize("most", [5000, 2])
def test_removal_equals_the_definition(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MAX_RUNS", most)
    rnd = random.Random(11)
    base = ["".join(rnd.choice("abcdé ") for _ in range(400)) for _ in range(3)]
    data = [(d[0], d[1]) for d in rows()]
    for i in range(60):
        a = rnd.choice(base)
        a = a[rnd.randint(0, 100) : rnd.randint(250, 400)]
        k = rnd.randrange(len(a))
        data.append((500 + i, a[:k] + rnd.choice(["", "X", "é"]) + a[k:] + rnd.choice(["", a])))
    data += [(700, "ab" * 300), (701, "ab" * 200), (702, "\0" * 250), (703, "x" * 99), (703, "x" * 150)]
    df = spark.createDataFrame([(i, t, "s", "k", 1) for i, t in data], "doc_id bigint, text string, runs string, kept string, n_spans int").repartition(5)
    got = sorted((r.doc_id, r.text or "", r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(df).collect() if r.doc_id is not None)
    want = sorted((i, t or "", *w) for (i, t), w in zip(data, plain_removal(data), strict=True) if i is not None)
    assert got == want


def test_removal_without_broadcast_and_in_small_pieces(spark, monkeypatch):
    data = [(d[0], d[1]) for d in rows() if d[0] is not None]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    whole = {(r.doc_id, r.n_removed, bytes(r.kept)) for r in suffix_dedup.remove_repeats(df).collect()}
    monkeypatch.setattr(suffix_dedup, "IDS", -1)
    assert {(r.doc_id, r.n_removed, bytes(r.kept)) for r in suffix_dedup.remove_repeats(df).collect()} == whole
    offsets = np.array([0, 50, 400, 400, 1000])
    for piece in (1 << 18, 130):
        monkeypatch.setattr(suffix_dedup, "PIECE", piece)
        cover = [x for a, b, _ in suffix_dedup.pieces(offsets) for x in range(a, b)]
        assert cover == list(range(1000))
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_boundaries_equal_plain_prefixes():
    rnd = random.Random(8)
    text = bytes(rnd.choice(b"ab") for _ in range(700)) * 2
    symbols = np.concatenate([np.frombuffer(text, np.uint8).astype(np.int64) + 1, [0]])
    order = suffix_dedup.suffix_order(symbols)
    found = suffix_dedup.prefix_boundaries(symbols, order)
    for i in range(1, len(order)):
        a, b = text[order[i - 1] : order[i - 1] + 100], text[order[i] : order[i] + 100]
        assert found[i] == (a != b or len(a) < 100)
