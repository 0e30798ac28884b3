"""Byte-level BPE by a lazily determinised finite-state transducer.

Greedy merging by rank is local: a token sequence is the encoding of its bytes exactly when every two
neighbours, encoded together, stay as they are. So each prefix of a piece has one encoding, and its last token
follows from the bytes behind it. A state of the transducer is the last token whose end can no longer move and
the bytes read since; an arc reads one byte, and emits the tokens on which all continuations agree. No state
holds more bytes than the longest token, so the lookahead is bounded and a piece of any length takes linear time.
States and arcs are made when a text first needs them, and forgotten together when there are too many.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from measurelake.llm.common import held

#: The pre-split of the public rank files (public_tokenizers.PATTERN).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Its alternatives where all code points are under U+0100: letters, numbers and white space there, one by one.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
LATIN = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
REPLACED = "\ufffd".encode()
MAX_ARCS = 300_000
MAX_PIECES = 85_000
MAX_PAIRS = 400_000
CACHED_CHARS = 48
MET = 1 << 20
#: Bits of a state's number in an arc; the state before the first byte.
STATE = 32
MASK = (1 << STATE) - 1
START = array("i", (0, -1, 0)).tobytes()


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Rank file: a base64 token and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class Transducer:
    def __init__(self, ranks: dict[bytes, int], max_arcs: int = MAX_ARCS):
        self.ranks, self.max_arcs = ranks, max_arcs
        self.tokens = {v: k for k, v in ranks.items()}
        tree, at, more = {}, [-1], [True]
        for data, rank in ranks.items():
            node = 0
            for byte in data:
                more[node] = True
                below = tree.setdefault(node << 8 | byte, len(at))
                if below == len(at):
                    at.append(-1)
                    more.append(False)
                node = below
            at[node] = rank
        #: The tokens' bytes as a tree: (node, byte) to the node below, the token that ends there, or -1, and whether longer ones follow.
        self.tree: dict[int, tuple[int, int, bool]] = {k: (node, at[node], more[node]) for k, node in tree.items()}
        self.pairs: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.states: list[bytes] = []
        #: (state, byte) to the next state, and in the bits from STATE on the place of what is emitted.
        self.arcs: dict[int, int] = {}
        self.emits: list[bytes] = [b""]
        self.places: dict[bytes, int] = {b"": 0}
        self.ends: dict[int, bytes] = {}
        self._state(START)

    def _state(self, live: bytes) -> int:
        """live: for each place at which a token to come can start, the node of the bytes since, the token that ends there, and the number and the list of all tokens up to there that aren't emitted yet; as 32-bit integers one behind the other, a quarter of the memory of tuples."""
        k = self.ids.setdefault(live, len(self.states))
        if k == len(self.states):
            self.states.append(live)
        return k

    def _merged(self, data: bytes, below: int) -> list[bytes]:
        """Greedy merging by the ranks under `below`, lowest rank and then leftmost first."""
        parts, get = [data[i : i + 1] for i in range(len(data))], self.ranks.get
        while len(parts) > 1:
            found = [get(a + b, below) for a, b in zip(parts, parts[1:])]
            if (best := min(found)) >= below:
                break
            i = found.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; itself twice for a byte; None if merging never makes it."""
        if token not in self.halves:
            data = self.tokens[token]
            parts = self._merged(data, token)
            self.halves[token] = (token, token) if len(data) == 1 else (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def _fits(self, left: int, right: int) -> bool:
        """Whether the two tokens side by side stay as they are."""
        key = left << 32 | right
        if (ok := self.pairs.get(key)) is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            ok = self.pairs[key] = self._split(right) is not None and (left < 0 or self._apart(left, right))
        return ok

    def _apart(self, left: int, right: int) -> bool:
        """Undo the merges of both sides from the last one on; no pair across the border may have come before the one undone."""
        tokens, get, never = self.tokens, self.ranks.get, 1 << 40
        before = never
        while True:
            if get(tokens[left] + tokens[right], never) < before:
                return False
            a, b = self._split(left)[1], self._split(right)[0]
            if a == left and b == right:
                return True
            # on the left a merge of equal rank goes first, so it must be strictly later than the one across
            if a != left and (b == right or left > right):
                before, left = left, a
            else:
                before, right = right + 1, b

    def _arc(self, k: int, byte: int) -> int:
        get, known = self.tree.get, self.pairs.get
        live, path, flat, i = [], None, memoryview(self.states[k]).cast("i").tolist(), 0
        while i < len(flat):
            node, last, begin = flat[i], flat[i + 1], i + 3
            i = begin + flat[i + 2]
            step = get(node << 8 | byte)
            if step is not None:
                below, token, more = step
                if token >= 0 and path is None:
                    ok = known(last << 32 | token)
                    if self._fits(last, token) if ok is None else ok:
                        path = [*flat[begin:i], token]
                if more:
                    live.append((below, last, flat[begin:i]))
        if path is None:
            raise ValueError("a byte is missing in the ranks")
        # what all continuations have behind them is decided
        decided = len(path)
        for _, _, before in live:
            decided = min(decided, len(before))
            while decided and before[:decided] != path[:decided]:
                decided -= 1
            if not decided:
                break
        live.append((0, path[-1], path))
        flat = []
        for node, last, before in live:
            flat += (node, last, len(before) - decided, *before[decided:])
        to = self._state(array("i", flat).tobytes())
        if not decided:
            return to
        emitted = struct.pack(f"<{decided}I", *path[:decided])
        place = self.places.setdefault(emitted, len(self.emits))
        if place == len(self.emits):
            self.emits.append(emitted)
        return place << STATE | to

    def encode(self, piece: bytes) -> bytes:
        """Ids of one piece, as little-endian unsigned 32-bit integers."""
        if piece in self.ranks:
            return struct.pack("<I", self.ranks[piece])
        if len(self.arcs) > self.max_arcs:
            self._forget()
        arcs, k, out = self.arcs, 0, b""
        for byte in piece:
            step = arcs.get(k << 8 | byte)
            if step is None:
                if len(arcs) > 2 * self.max_arcs:  # a very long piece; go on from the same state
                    here = self.states[k]
                    self._forget()
                    arcs, k = self.arcs, self._state(here)
                step = arcs[k << 8 | byte] = self._arc(k, byte)
            if step > MASK:
                out += self.emits[step >> STATE]
            k = step & MASK
        end = self.ends.get(k)
        if end is None:
            flat, i = memoryview(self.states[k]).cast("i").tolist(), 0
            while (after := i + 3 + flat[i + 2]) < len(flat):
                i = after
            end = self.ends[k] = struct.pack(f"<{after - i - 3}I", *flat[i + 3 :])
        return out + end


class Utf8Machine(dict):
    """Incremental decoder: the state is the start of an unfinished character; arcs are tokens, made when first met.

    `self[token]` is (next state, bytes of the characters completed). Bytes that no character can hold become U+FFFD each.
    """

    def __init__(self, vocabulary: dict[int, bytes], begun: bytes = b"", made: dict | None = None):
        self.vocabulary, self.begun = vocabulary, begun
        self.made = {} if made is None else made
        self.made[begun] = self

    def __missing__(self, token: int) -> tuple[Utf8Machine, bytes]:
        data, out, i = self.begun + self.vocabulary[token], [], 0
        while i < len(data):
            lead = data[i]
            size = 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
            part = data[i : i + size]
            good = size and all(0x80 <= x < 0xC0 for x in part[1:]) and not (len(part) > 1 and (lead == 0xE0 and part[1] < 0xA0 or lead == 0xED and part[1] > 0x9F or lead == 0xF0 and part[1] < 0x90 or lead == 0xF4 and part[1] > 0x8F))
            if good and len(part) < size:
                break
            out.append(part if good else REPLACED)
            i += size if good else 1
        rest = data[i:]
        step = self[token] = (self.made.get(rest) or Utf8Machine(self.vocabulary, rest, self.made), b"".join(out))
        return step


class Pieces(dict):
    """Encoded pieces, in two generations: pieces of the older one that are met again move to the younger.

    Most pieces of a corpus occur once, so one is kept only when it (or one of the same hash) was met before.
    """

    def __init__(self, encode: Callable[[bytes], bytes]):
        self.encode_piece, self.older, self.met = encode, {}, bytearray(MET)

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.encode_piece(piece.encode())
            at = hash(piece) % MET
            if not self.met[at]:
                self.met[at] = 1
                return ids
        if len(piece) <= CACHED_CHARS:
            if len(self) >= MAX_PIECES:
                self.older = dict(self)
                self.clear()
                self.met = bytearray(MET)
            self[piece] = ids
        return ids


class Codec:
    """Texts to packed ids and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.transducer = Transducer(ranks)
        self.vocabulary = {v: k for k, v in ranks.items()}
        self.start = Utf8Machine(self.vocabulary)
        self.split = regex.compile(pattern)
        # the same pattern over code points up to U+00FF, where its classes are few characters
        self.latin = re.compile(LATIN) if pattern == PATTERN else None
        self.pieces = Pieces(self.transducer.encode)

    def encode(self, text: str) -> bytes:
        split = self.split
        if self.latin and (text.isascii() or max(text) < "\u0100"):
            split = self.latin
        pieces = split.findall(text) if len(text) < 1_000_000 else (m.group() for m in split.finditer(text))
        return b"".join(map(self.pieces.__getitem__, pieces))

    def decode(self, packed: bytes) -> bytes:
        """UTF-8 bytes of ids."""
        state, out = self.start, []
        put = out.append
        for token in memoryview(packed).cast("I"):
            state, done = state[token]
            put(done)
        if state.begun:
            put(REPLACED)
        return b"".join(out)


def codec_of(data: bytes, pattern: str) -> Codec:
    """One codec a worker process: what one task has determinised serves the next, until another operator runs there."""
    return held(hashlib.sha256(data + pattern.encode()).digest(), lambda: Codec(parse_ranks(data), pattern))


def read_ranks(path: str) -> bytes:
    """The rank file, read by the driver (under 1 MB); executors needn't have it."""
    with open(path, "rb") as f:
        return f.read()


COLUMNS = {"n_tokens": ("long", pa.int64()), "ids": ("binary", pa.binary()), "decoded": ("string", pa.string()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}


def encode_documents(df: DataFrame, ranks: bytes, text: str = "text", keep: tuple[str, ...] = ("doc_id",), outputs: tuple[str, ...] = ("n_tokens", "ids"), pattern: str = PATTERN, block: int = 256) -> DataFrame:
    """Encode whole texts and decode the ids again: the columns `keep` and `outputs` (of COLUMNS) of each row.

    A null text counts as empty: no ids, the digests of no bytes; texts of any length are read whole. Rows are never
    joined or dropped; repeated rows stay repeated, an empty table stays empty, other columns are not read. Map only:
    no shuffle. A lost executor's part is computed anew.
    """
    fields = [df.schema[c] for c in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"{c} {COLUMNS[c][0]}" for c in outputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(ranks, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, block):
                batch = whole.slice(at, block)
                made: dict[str, list] = {c: [] for c in outputs}
                for value in batch.column(len(keep)):
                    ids = codec.encode(value.as_py() or "")
                    back = codec.decode(ids) if "decoded" in made or "decoded_sha256" in made else b""
                    for c, put in made.items():
                        put.append(len(ids) // 4 if c == "n_tokens" else ids if c == "ids" else back.decode() if c == "decoded" else hashlib.sha256(ids if c == "ids_sha256" else back).hexdigest())
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *(pa.array(made[c], COLUMNS[c][1]) for c in outputs)], [*keep, *outputs])

    return df.select(*keep, text).mapInArrow(run, schema)
