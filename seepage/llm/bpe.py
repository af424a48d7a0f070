"""Byte-pair encoding as a bounded-lookahead streaming transducer, and its decoder.

Every prefix of a word has one encoding, and that has one last token. So a word is
read symbol by symbol, and for each prefix only its last token is found: the one
token that ends here and stays apart from the last token of the prefix before it
when the two are merged together. Whatever follows, the next tokens start at one
of the last ``lookahead`` places, ``lookahead`` being the longest token of the
merge list in symbols; a token that the encodings of all these prefixes share is
stable, and is emitted and forgotten. The decoder carries the open bytes of a
character and whether a separator is due, and nothing else.
"""

from __future__ import annotations

import codecs
import functools
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from seepage.llm.common import released, text_batches

WORDS_KEPT = 300_000  # encoded words that a worker remembers
PAIRS_KEPT = 200_000
START, STARTS_KEPT = 6, 100_000  # symbols at the start of a word, and how many of those starts are remembered
LONGEST_KEPT = 64
SEGMENT = 1 << 20  # characters normalised at a time
ROWS = 256  # rows sent back at a time
# classes in the pattern of a tokenizer file, and the characters for which the standard
# classes differ from them or are not known to agree
LETTERS, NUMBER, SIGNS = r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+"
UNUSUAL = re.compile("[^\t-\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]")


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself, or the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in plain else next(free)) for b in range(256)]


@functools.cache
def assigned(pattern: str) -> str:
    """The pattern with letters read as of ``unicodedata``: later ones are no letters yet."""
    late = [m.start() for m in regex.finditer(r"\p{L}", "".join(map(chr, range(0xD800)))) if unicodedata.category(chr(m.start())) == "Cn"]
    members = "".join(f"\\u{c:04x}" for c in late)
    if not members:
        return pattern
    return pattern.replace("[\\p{L}]+", f"[\\p{{L}}--[{members}]]+").replace("[^\\s\\p{L}\\p{N}]+", f"(?:[^\\s\\p{{L}}\\p{{N}}]|[{members}])+")


class Vocabulary:
    """The parts of a tokenizer file that encoding needs."""

    def __init__(self, definition: bytes) -> None:
        spec = json.loads(definition)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.ranks = {tuple(m): r for r, m in enumerate(model["merges"])}
        self.parts = {a + b: (a, b) for a, b in self.ranks}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.alphabet = byte_alphabet()
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(assigned(split), flags=regex.V1)
        self.plain = re.compile(split.replace(LETTERS, r"[^\W\d_]+").replace(NUMBER, r"\d").replace(SIGNS, r"(?:[^\w\s]|_)+")) if all(x in split for x in (LETTERS, NUMBER, SIGNS)) else None
        names = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def symbols(self, token: str) -> list[str]:
        """A token as symbols; the last one of a word carries the end mark."""
        if self.end and token.endswith(self.end) and token != self.end:
            body = list(token[: -len(self.end)])
            body[-1] += self.end
            return body
        return list(token)

    def merged(self, symbols: Sequence[str]) -> list[str]:
        """The merge rules as stated: lowest rank first, leftmost first. For short pieces."""
        out = list(symbols)
        while len(out) > 1:
            ranked = [(self.ranks.get(p, len(self.ranks)), i) for i, p in enumerate(zip(out, out[1:], strict=False))]
            rank, at = min(ranked)
            if rank == len(self.ranks):
                break
            out[at : at + 2] = [out[at] + out[at + 1]]
        return out

    @functools.cached_property
    def reachable(self) -> set[str]:
        """Tokens that merging their own symbols gives back; no others are ever produced."""
        return {
            t for t in self.ids if len(self.symbols(t)) == 1 or (t in self.parts and self.merged(self.symbols(t)) == [t])
        }

    @functools.cached_property
    def lookahead(self) -> int:
        """Places behind the reading head at which a later token can start."""
        return max(len(self.symbols(t)) for t in self.reachable)


class Transducer:
    """Encodes one word, fed in any chunks; memory doesn't grow with the word.

    Holds the symbols behind the last emitted token, and for each place among
    them the last token of the encoding that ends there, with its length.
    """

    def __init__(self, codec: Codec) -> None:
        self.codec = codec
        self.reach = codec.vocabulary.lookahead
        self.text = ""
        self.last = [-1]  # place 0: the token emitted last
        self.size = [0]

    def feed(self, symbols: str, final: bool = False) -> list[int]:
        """Ids that became stable; with ``final`` the last symbol gets the end mark and all are out."""
        out: list[int] = []
        step = 4 * self.reach
        for at in range(0, len(symbols), step):
            self.text += symbols[at : at + step]
            ends = final and at + step >= len(symbols)
            self._read(self.codec.vocabulary.end if ends else "")
            if ends:
                out += self._ids(self._ends(len(self.text)))
            elif len(self.text) > 2 * self.reach:
                out += self._stable()
        return out

    def _read(self, end: str) -> None:
        text, last, size, reach = self.text, self.last, self.size, self.reach
        known, pairs, apart = self.codec.suffixes.get, self.codec.pairs.get, self.codec.apart
        n = len(text)
        for i in range(len(last), n + 1):
            tail = end if i == n else ""
            tokens, starts = [], []  # those that end here, shortest first
            for j in range(i - 1, i - reach - 1 if i > reach else -1, -1):
                token = known(text[j:i] + tail if tail else text[j:i])
                if token is None:  # no longer token ends so
                    break
                if token >= 0:
                    tokens.append(token)
                    starts.append(j)
            while tokens:
                token, j = tokens.pop(), starts.pop()
                left = last[j]
                fits = True if left < 0 else pairs(left << 32 | token)
                if fits or (fits is None and apart(left, token)):
                    last.append(token)
                    size.append(i - j)
                    break

    def _ends(self, place: int) -> list[int]:
        """Where the tokens of the encoding up to a place end."""
        ends = []
        while place > 0:
            ends.append(place)
            place -= self.size[place]
        return ends[::-1]

    def _ids(self, ends: list[int]) -> list[int]:
        return [self.last[e] for e in ends]

    def _stable(self) -> list[int]:
        n = len(self.text)
        shared = self._ends(n)
        for place in range(n - self.reach + 1, n):
            ends = set(self._ends(place))
            shared = [e for e in shared if e in ends]
        if not shared:
            return []
        out, cut = self._ids(shared), shared[-1]
        self.text, self.last, self.size = self.text[cut:], self.last[cut:], self.size[cut:]
        return out


class Codec(dict):
    """Encodes texts; as a dict it maps short words to their ids, as bytes of int32."""

    def __init__(self, definition: bytes) -> None:
        super().__init__()
        self.vocabulary = Vocabulary(definition)
        ids = self.vocabulary.ids
        self.tokens = {t: ids[t] for t in self.vocabulary.reachable}
        self.names = {i: t for t, i in self.tokens.items()}
        self.suffixes: dict[str, int] = {}  # every end of a token: its id if it is a token, else -1
        for token in self.tokens:
            marked = self.vocabulary.symbols(token)
            for k in range(len(marked)):
                part = "".join(marked[k:])
                self.suffixes[part] = self.tokens.get(part, -1)
        self.starts: dict[str, tuple] = {}  # what a transducer holds after the first START symbols
        self.older: dict[str, bytes] = {}  # words kept before this dict was last full
        self.pairs: dict[int, bool] = {}
        self.bytes = dict(enumerate(self.vocabulary.alphabet))
        self.edges: tuple[dict, dict] = ({}, {})  # one entry per token at most

    def apart(self, left: int, right: int) -> bool:
        """True if merging both tokens' symbols together leaves the two as they are.

        Only pieces that touch the border could merge across it: those on the
        right edge of the left token and on the left edge of the right one. Two of
        them do if their rule's turn comes while both are there, and at equal turn
        if the rule meets the border before the right token's own merge.
        """
        if left < 0:
            return True
        pair = left << 32 | right
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            known = self.pairs[pair] = self._apart(self.names[left], self.names[right])
        return known

    def _apart(self, left: str, right: str) -> bool:
        ranks = self.vocabulary.ranks
        for a, a_from, a_to in self._edge(left, 1):
            for b, b_from, b_to in self._edge(right, 0):
                rank = ranks.get((a, b))
                if rank is not None and a_from < rank < a_to and b_from < rank <= b_to:
                    return False
        return True

    def _edge(self, token: str, side: int) -> list[tuple[str, int, int]]:
        """Pieces of a token at its left (0) or right (1) edge: made at one turn, used up at another."""
        known = self.edges[side].get(token)
        if known is None:
            known, used = [], len(self.vocabulary.ranks)
            piece = token
            while True:
                parts = self.vocabulary.parts.get(piece)
                made = self.vocabulary.ranks[parts] if parts else -1
                known.append((piece, made, used))
                if not parts:
                    break
                piece, used = parts[side], made
            self.edges[side][token] = known
        return known

    def symbols(self, part: str) -> str:
        """A byte for a character, in the alphabet of the merge list."""
        return part.encode().decode("latin-1").translate(self.bytes)

    def long_word(self, word: str) -> Iterator[int]:
        transducer = Transducer(self)
        for at in range(0, len(word), SEGMENT):
            yield from transducer.feed(self.symbols(word[at : at + SEGMENT]), at + SEGMENT >= len(word))

    def __missing__(self, word: str) -> bytes:
        if len(word) > LONGEST_KEPT:
            return np.fromiter(self.long_word(word), np.int32).tobytes()
        if 2 * len(self) >= WORDS_KEPT:
            # words that go on being used come back from the older half
            self.older = dict(self)
            self.clear()
        ids = self.older.pop(word, None)
        if ids is None:
            ids = array("i", self.short_word(self.symbols(word))).tobytes()
        self[word] = ids
        return ids

    def short_word(self, symbols: str) -> list[int]:
        """The transducer goes on from where another word with the same start has taken it."""
        transducer = Transducer(self)
        if len(symbols) <= START:
            return transducer.feed(symbols, True)
        start = symbols[:START]
        state = self.starts.get(start)
        if state is None:
            transducer.feed(start)
            if len(self.starts) >= STARTS_KEPT:
                self.starts.clear()
            self.starts[start] = (tuple(transducer.last), tuple(transducer.size))
        else:
            transducer.text, transducer.last, transducer.size = start, list(state[0]), list(state[1])
        return transducer.feed(symbols[START:], True)

    def split(self, text: str) -> list[str]:
        """The words of a normalised text; plain letters and signs need no Unicode classes."""
        if self.vocabulary.plain and not UNUSUAL.search(text):
            return self.vocabulary.plain.findall(text)
        return self.vocabulary.words.findall(text)

    def pieces(self, text: str) -> Iterator[bytes]:
        """Ids of the text, piece by piece, as bytes of int32."""
        v = self.vocabulary
        parts = v.specials.split(text) if v.specials else [text]
        for part in parts:
            if part in v.special:
                yield v.special[part].to_bytes(4, sys.byteorder)
            elif part:
                for piece in segments(part):
                    yield b"".join(map(self.__getitem__, self.split(normalised(piece))))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.pieces(text)), np.int32)


def normalised(text: str) -> str:
    """Composed and in lower case, character by character; white space is never part of a word."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def segments(text: str) -> Iterator[str]:
    """Pieces cut before a blank, which neither composes nor joins words."""
    at = 0
    while len(text) - at > SEGMENT:
        cut = text.find(" ", at + SEGMENT)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


@functools.lru_cache(maxsize=2)
def codec_for(definition: bytes) -> Codec:
    """The codec of a tokenizer file, kept between the tasks of a worker."""
    return Codec(definition)


class Decoder:
    """Ids to text, in any chunks.

    By default as a tokenizer file without decoder asks: token strings with a
    blank between. With ``text=True`` the bytes that the tokens stand for, the
    end mark as a blank.
    """

    def __init__(self, definition: bytes, text: bool = False) -> None:
        v = Vocabulary(definition)
        byte_of = {c: b for b, c in enumerate(v.alphabet)}

        def body(token: str) -> bytes:
            if not text:
                return token.encode()
            ended = v.end and token.endswith(v.end)
            kept = token[: -len(v.end)] if ended else token
            return bytes(byte_of[c] for c in kept) + (b" " if ended else b"")

        self.pieces = {i: body(t) for t, i in v.ids.items()} | {i: t.encode() for t, i in v.special.items()}
        self.between = b"" if text else b" "
        self.reset()

    def reset(self) -> None:
        self.open = codecs.getincrementaldecoder("utf-8")(errors="replace")
        self.due = b""

    def feed(self, ids: Iterable[int]) -> str:
        try:
            joined = self.between.join(map(self.pieces.__getitem__, ids))
        except KeyError:  # an id that no token has stands for nothing
            joined = self.between.join([self.pieces[i] for i in ids if i in self.pieces])
        if not joined:
            return ""
        out = self.open.decode(self.due + joined)
        self.due = self.between
        return out

    def finish(self) -> str:
        rest = self.open.decode(b"", True)
        self.reset()
        return rest


def encode(
    docs: DataFrame, tokenizer: str, text_col: str = "text", out: str = "ids", keep_text: bool = False
) -> DataFrame:
    """``docs`` with the token ids of each whole text as ``out`` array<int>.

    The text column goes unless ``keep_text``; a column named ``out`` is
    replaced. Null and empty texts get an empty array. Rows are encoded one by one,
    so null ids and repeated rows stay as they are, and an empty table stays empty.
    The tokenizer file (a few MB) is read once on the driver and broadcast.
    """
    text_batches(docs.sparkSession)
    with open(tokenizer, "rb") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(definition.value)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                found = [codec.encode(text.as_py() or "") for text in batch.column(text_col)]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                values = np.concatenate(found) if found else np.empty(0, np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [ids], [*kept, out])

    kept = [c for c in docs.columns if c != out and (keep_text or c != text_col)]
    fields = [f for f in docs.schema.fields if f.name in kept]
    schema = T.StructType([*fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    return docs.drop(out).mapInArrow(released(run), schema)


def decode(df: DataFrame, tokenizer: str, ids_col: str = "ids", out: str = "decoded", text: bool = False) -> DataFrame:
    """``df`` with the ids turned back into the string ``out``; the ids go.

    Null and empty arrays give an empty string; null ids and ids that no token has
    stand for nothing. Rows are decoded one by one, so repeated rows and other columns
    stay as they are; a column named ``out`` is replaced.
    """
    text_batches(df.sparkSession)
    with open(tokenizer, "rb") as f:
        definition = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(definition.value, text)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                texts = []
                for ids in batch.column(ids_col):
                    values = ids.values.drop_null().to_numpy() if ids.is_valid else np.empty(0, np.int32)
                    chunks = [decoder.feed(values[i : i + SEGMENT].tolist()) for i in range(0, len(values), SEGMENT)]
                    texts.append("".join(chunks) + decoder.finish())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in kept] + [pa.array(texts, pa.string())], [*kept, out]
                )

    kept = [c for c in df.columns if c not in (ids_col, out)]
    fields = [f for f in df.schema.fields if f.name in kept]
    return df.drop(out).mapInArrow(released(run), T.StructType([*fields, T.StructField(out, T.StringType())]))
