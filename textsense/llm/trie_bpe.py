"""Byte-level BPE encoding and decoding by prefix sharing.

The distinct words (pre-tokens) of a block of texts are walked in byte order, which is the
depth-first order of their trie. For each prefix the walk keeps the last token of the prefix's
encoding; two words share these states up to where they part, so a shared prefix is encoded
once. Texts with characters that Unicode versions class differently are cut into words by the
library's pre-tokenizer, all others by its pattern. The last token of a prefix is the one vocabulary token that ends it and may follow the
last token of what remains in front. The tokens that end a prefix come from an automaton over the
vocabulary's own trie: a step per byte, however long its tokens. A word's ids are then read off backwards.

The vocabulary file's path is a parameter; every task reads it from its own machine. Texts stay
in their partition: nothing is shuffled, and a task keeps a bounded cache of words.

Defined results: a null or empty text has no ids and decodes to the empty text; a special
token's string inside a text gets that token's id, as the tokenizers library does by default;
texts of any length are encoded whole; extra columns pass through, a column of an output's name
is replaced by it.
"""

from __future__ import annotations

import copy
import json
import re
import struct

import numpy as np
from pyspark.sql import DataFrame

from .common import WordCache, append_columns

# Fixed value: the pattern that cuts texts into words for byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_CACHED_BYTES = 40 << 20
MAX_STEPS = 200_000  # steps of the automaton that a worker remembers, checked once a block
SPARE_CACHED_BYTES = 8 << 20  # where memory counts more than time
# Scripts whose letters, digits and blanks are old enough that every Unicode version agrees; a
# text with any other character is cut by the library's own pre-tokenizer.
SETTLED = "\x00-\x1b\x20-\x84\x86-\u0377\u0386-\u052f\u1e00-\u1eff\u2000-\u2027\u202a-\u2063\u20a0-\u20bf\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
# Bytes of ASCII and of U+00C0 to U+00FF: texts of nothing else need no closer look.
_COMMON = bytes([*range(0x1C), *range(0x20, 0xC0), 0xC3])
# The same pattern for those texts.
COMMON_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+"""


def byte_chars() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable Latin-1 bytes stand for
    themselves, the others, in order, for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens of a tokenizers file as bytes, with the merge that forms each."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_chars()
        model = spec["model"]
        self.bytes_of: dict[int, bytes] = {i: bytes(to_byte[c] for c in t) for t, i in model["vocab"].items()}
        self.special: dict[str, int] = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.id_of = {b: i for i, b in self.bytes_of.items() if i not in self.special.values()}
        self.rank: dict[tuple[int, int], int] = {}      # pair of ids -> order of its merge
        self.parts: dict[int, tuple[int, int, int]] = {}  # id -> (order, left id, right id)
        for order, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b = model["vocab"][left], model["vocab"][right]
            self.rank[a, b] = order
            self.parts.setdefault(model["vocab"][left + right], (order, a, b))
        self.prefixes = {b[:k] for b in self.id_of for k in range(len(b) + 1)}
        self._stable: dict[tuple[int, int], bool] = {}
        self._right: dict[int, list] = {}
        self._left: dict[int, list] = {}
        self.forget_states()

    def _edge(self, t: int, side: int) -> list[tuple[int, float]]:
        """The tokens at the right (side 2) or left (side 1) end of ``t`` from one byte up to
        ``t`` itself, each with the order of the merge that absorbs it (infinite for ``t``)."""
        out, until = [], float("inf")
        while True:
            out.append((t, until))
            if t not in self.parts:
                return out[::-1]
            until = self.parts[t][0]
            t = self.parts[t][side]

    def stable(self, a: int, b: int) -> bool:
        """Whether the bytes of ``a`` followed by those of ``b`` are encoded as just these two:
        going through the merges in order, no merge joins their touching ends."""
        known = self._stable.get((a, b))
        if known is not None:
            return known
        if a not in self._right:
            self._right[a] = self._edge(a, 2)
        if b not in self._left:
            self._left[b] = self._edge(b, 1)
        left, right, i, j, ok = self._right[a], self._left[b], 0, 0, True
        while True:
            (x, x_until), (y, y_until) = left[i], right[j]
            m = self.rank.get((x, y))
            # of equal merges the one further left is done first
            if m is not None and m < x_until and m <= y_until:
                ok = False
                break
            if x_until == y_until == float("inf"):
                break
            if x_until <= y_until:
                i += 1
            else:
                j += 1
        if len(self._stable) > 200_000:
            self._stable.clear()
        self._stable[a, b] = ok
        return ok

    def forget_states(self) -> None:
        """Start the automaton: a state is the longest end of what was read that begins a token."""
        self.states: list[bytes] = [b""]
        self.ends: list[tuple] = [()]       # state -> the tokens that end there and their lengths, longest first
        self.steps: dict[int, int] = {}     # 256 * state + byte -> state, as far as met
        self._state_of: dict[bytes, int] = {b"": 0}

    def step(self, state: int, byte: int) -> int:
        """The state after ``byte``, which is remembered."""
        text = self.states[state] + bytes([byte])
        while text not in self.prefixes:
            text = text[1:]
        new = self._state_of.get(text)
        if new is None:
            new = self._state_of[text] = len(self.states)
            self.states.append(text)
            ends = [(self.id_of.get(text[i:]), len(text) - i) for i in range(len(text))]
            self.ends.append(tuple(x for x in ends if x[0] is not None))
        self.steps[256 * state + byte] = new
        return new


def encode_words(vocab: Vocabulary, words: list[bytes]) -> list[bytes]:
    """Ids, as little-endian unsigned 32-bit integers, of each of ``words`` (sorted, distinct)."""
    if len(vocab.steps) > MAX_STEPS:
        vocab.forget_states()
    steps, ends, known, stable = vocab.steps, vocab.ends, vocab._stable, vocab.stable
    before = b""
    last: list[int] = [-1]   # last[d]: last token of the encoding of the first d bytes
    width: list[int] = [0]   # its length
    state: list[int] = [0]   # the automaton's state after them
    out = []
    for word in words:
        n, shared = len(word), 0
        for x, y in zip(before, word):
            if x != y:
                break
            shared += 1
        del last[shared + 1:], width[shared + 1:], state[shared + 1:]
        at, end = state[shared], shared
        for byte in word[shared:]:
            end += 1
            to = steps.get(256 * at + byte)
            at = vocab.step(at, byte) if to is None else to
            for t, size in ends[at]:
                if size == end:
                    break
                a = last[end - size]
                ok = known.get((a, t))
                if stable(a, t) if ok is None else ok:
                    break
            else:
                raise ValueError(f"no token ends {word[:end]!r}")
            last.append(t)
            width.append(size)
            state.append(at)
        ids, at = [], n
        while at:
            ids.append(last[at])
            at -= width[at]
        out.append(struct.pack(f"<{len(ids)}I", *ids[::-1]))
        before = word
    return out


class Codec:
    """Encoder and decoder with a bounded cache of words; one vocabulary per worker process."""

    _loaded: dict[str, Codec] = {}

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer
        self.vocab = Vocabulary(path)
        self.split = regex.compile(PATTERN)
        self.split_common = re.compile(COMMON_PATTERN)
        self.unsettled = re.compile(f"[^{SETTLED}]")
        self.cutter = Tokenizer.from_file(path).pre_tokenizer
        specials = sorted(self.vocab.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")") if specials else None
        self.cache = WordCache(MAX_CACHED_BYTES)
        n = max(self.vocab.bytes_of) + 1
        self.tokens = [self.vocab.bytes_of.get(i, b"") for i in range(n)]

    @classmethod
    def load(cls, path: str) -> Codec:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def cut(self, text: str) -> list[str]:
        if not text.encode().translate(None, _COMMON):
            return self.split_common.findall(text)
        if self.unsettled.search(text) is None:
            return self.split.findall(text)
        return [text[a:b] for _, (a, b) in self.cutter.pre_tokenize_str(text)]

    def words(self, text: str) -> list[str]:
        if self.special is None or not any(s in text for s in self.vocab.special):
            return self.cut(text)
        out = []
        for piece in self.special.split(text):
            out += [piece] if piece in self.vocab.special else self.cut(piece)
        return out

    def for_task(self, max_bytes: int = MAX_CACHED_BYTES) -> Codec:
        """The same vocabulary with a cache of its own, which goes when the task ends."""
        one = copy.copy(self)
        one.cache = WordCache(max_bytes)
        return one

    def encode(self, texts: list) -> list[bytes]:
        """Ids of each text; the new words of all of them go through one walk."""
        split = [self.words(t) if t else [] for t in texts]
        new = self.cache.missing(set().union(*split))
        for s in self.vocab.special.keys() & new:
            self.cache.add(s, np.array([self.vocab.special[s]], dtype="<u4").tobytes())
        new = sorted((w.encode(), w) for w in new if w not in self.vocab.special)
        for (_, w), ids in zip(new, encode_words(self.vocab, [b for b, _ in new])):
            self.cache.add(w, ids)
        return [b"".join(map(self.cache.ids.__getitem__, ws)) for ws in split]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encode(docs: DataFrame, text_col: str, path: str, ids_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of every whole text as binary (little-endian unsigned 32-bit)."""
    def make():
        import pyarrow as pa
        codec = Codec.load(path).for_task()
        return lambda texts: [pa.array(codec.encode(texts), pa.binary())]
    return append_columns(docs, text_col, make, [(ids_col, "binary")])


def encode_and_decode(docs: DataFrame, text_col: str, path: str, ids_col: str = "ids", decoded_col: str = "decoded",
                      spare: bool = False) -> DataFrame:
    """Like ``encode``, and the text that the ids decode to. ``spare`` takes less memory and more
    time: a smaller cache, and a vocabulary that goes with its task instead of staying in the worker."""
    def make():
        import pyarrow as pa
        codec = Codec(path).for_task(SPARE_CACHED_BYTES) if spare else Codec.load(path).for_task()

        def work(texts):
            ids = codec.encode(texts)
            return [pa.array(ids, pa.binary()), pa.array([codec.decode(x) for x in ids], pa.string())]
        return work
    return append_columns(docs, text_col, make, [(ids_col, "binary"), (decoded_col, "string")])
