"""Token-id files: a wavelet matrix per shard.

Texts are tokenised where they lie and an end id closes each; ids are then range-partitioned by
document id and written, in ascending order, to files of about ``FILE_TOKENS`` tokens. A file
holds the documents' ids and offsets (deflated) and the wavelet matrix of its tokens: one bit
plane per bit of an id, in which every plane orders the positions by the bits above, plus rank
samples. Planes are deflated one by one and inflated when first used. The matrix answers token
access, counting and occurrence lookup in one step per plane; reading it whole inverts the planes
from the last to the first.

Tokenising goes through a cache of words (the library's BPE runs once per distinct word and
task), which gives the library's ids for whole texts. Texts of ASCII and U+00C0 to U+00FF are cut
into runs of letters, digits and signs together, a slice at a time: the cache is asked once for
each distinct run of a slice and the ids are gathered by number. A worker remembers runs in two
generations, so that frequent ones stay when it makes room. Other texts are cut one by one; those with characters from
outside the ``SETTLED`` scripts are given to the library whole.

Defined results: a null or empty text has the end id only; documents come in ascending order of
their integer id, null first, rows with equal ids in order of their tokens' hash; a document
larger than a file's size gets a file of its own; an empty table gives no file and no row.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import _TO_LOWER, WordCache, append_columns, folder, release_memory, small_batches, stored, write_file
from .trie_bpe import byte_chars

# Fixed value: the pattern of words in the tokenizer's file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
# Scripts whose letters, cases and compositions are old enough that every Unicode version agrees;
# a text with any other character goes to the library as it is.
SETTLED = "\x00-\x1b\x20-\u052f\u1e00-\u1eff\u2000-\u2063\u20a0-\u20bf\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
FILE_TOKENS = 4 << 20
END_ID = 1
MAGIC = b"WMTX0001"
SAMPLE = 512  # bits between two rank samples
MAX_CACHED_BYTES = 16 << 20
MAX_RUNS = 300_000  # runs in each of the two generations whose ids a worker remembers
BLOCK = 1 << 16  # positions that a plane is ordered by at a time: they stay in the processor's cache
# bytes that the common way of cutting leaves to the others: four controls that are white space
# in Python, and all first bytes of non-ASCII characters but that of U+00C0 to U+00FF
_OTHER = np.zeros(256, dtype=bool)
_OTHER[[*range(0x1C, 0x20), 0xC2, *range(0xC4, 0x100)]] = True
# kind of each byte in the others: blank, letter, digit, sign
_KIND = np.full(256, 3, dtype=np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2


class WaveletMatrix:
    """Bit planes, highest bit first, of a sequence of unsigned ints."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], samples: list[np.ndarray]):
        self.n, self._planes, self.zeros, self.samples = n, planes, zeros, samples

    @property
    def width(self) -> int:
        return len(self._planes)

    def plane(self, p: int) -> np.ndarray:
        """The bits of a plane, packed."""
        if not isinstance(self._planes[p], np.ndarray):
            self._planes[p] = np.frombuffer(zlib.decompress(self._planes[p]), dtype=np.uint8)
        return self._planes[p]

    @classmethod
    def build(cls, values: np.ndarray, width: int) -> WaveletMatrix:
        planes, zeros, samples, spare = [], [], [], None
        for bit in range(width - 1, -1, -1):
            one = (values & values.dtype.type(1 << bit)) != 0
            packed = np.packbits(one, bitorder="little")
            planes.append(packed)
            samples.append(cls._sampled(packed))
            zeros.append(len(values) - int(samples[-1][-1]))
            ordered = np.empty_like(values) if spare is None else spare
            x, y = 0, zeros[-1]
            for a in range(0, len(values), BLOCK):
                some, ones = values[a:a + BLOCK], one[a:a + BLOCK]
                # by position: masks take twice as long
                low, high = some[np.flatnonzero(~ones)], some[np.flatnonzero(ones)]
                ordered[x:x + len(low)] = low
                ordered[y:y + len(high)] = high
                x, y = x + len(low), y + len(high)
            spare = values if planes[1:] else None  # the caller's array is left alone
            values = ordered
        return cls(len(values), planes, zeros, samples)

    @staticmethod
    def _sampled(packed: np.ndarray) -> np.ndarray:
        """Ones before each SAMPLE-th bit."""
        step = SAMPLE // 8
        ones = np.bitwise_count(np.pad(packed, (0, -len(packed) % step))).reshape(-1, step).sum(axis=1, dtype=np.uint32)
        return np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32)

    def _ones(self, plane: int, at: np.ndarray) -> np.ndarray:
        """Ones before each position of ``at`` (0 to n) in a plane: the rank operation."""
        step = SAMPLE // 8
        row = at // SAMPLE
        packed = self.plane(plane)
        index = row[:, None] * step + np.arange(step)
        chunk = np.where(index < len(packed), packed[np.minimum(index, max(len(packed) - 1, 0))] if len(packed) else 0, 0).astype(np.uint8)
        bits = np.clip((at - row * SAMPLE)[:, None] - 8 * np.arange(step), 0, 8)
        return self.samples[plane][row].astype(np.int64) + np.bitwise_count(chunk & ((1 << bits) - 1).astype(np.uint8)).sum(axis=1, dtype=np.int64)

    def _bit(self, plane: int, at: np.ndarray) -> np.ndarray:
        return (self.plane(plane)[at >> 3] >> (at & 7).astype(np.uint8)) & 1

    def access(self, at) -> np.ndarray:
        """The values at the positions ``at``."""
        at = np.asarray(at, dtype=np.int64)
        out = np.zeros(len(at), dtype=np.uint32)
        for p in range(self.width):
            one = self._bit(p, at) != 0
            ones = self._ones(p, at)
            out = (out << np.uint32(1)) | one
            at = np.where(one, self.zeros[p] + ones, at - ones).astype(np.int64)
        return out

    def _range(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the occurrences of ``value`` among positions lo to hi lie after the last plane."""
        if value >> self.width:
            return 0, 0
        for p in range(self.width):
            a, b = self._ones(p, np.array([lo, hi]))
            lo, hi = (self.zeros[p] + a, self.zeros[p] + b) if (value >> (self.width - 1 - p)) & 1 else (lo - a, hi - b)
        return int(lo), int(hi)

    def count(self, value: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of ``value`` in positions lo to hi - 1."""
        a, b = self._range(value, lo, self.n if hi is None else hi)
        return b - a

    def find(self, value: int) -> np.ndarray:
        """All positions of ``value``, ascending: the select operation for each occurrence."""
        a, b = self._range(value, 0, self.n)
        at = np.arange(a, b)
        for p in range(self.width - 1, -1, -1):
            one = (value >> (self.width - 1 - p)) & 1
            at = self._select(p, one, at - self.zeros[p] if one else at)
        return np.sort(at)

    def _select(self, plane: int, one: int, k: np.ndarray) -> np.ndarray:
        """Position of the k-th (from 0) bit equal to ``one``, by bisection on ranks."""
        lo, hi = np.zeros(len(k), dtype=np.int64), np.full(len(k), self.n, dtype=np.int64)
        while len(k) and (lo < hi).any():
            mid = (lo + hi) >> 1
            ones = self._ones(plane, mid + 1)
            have = ones if one else mid + 1 - ones
            up = have <= k
            lo, hi = np.where(up & (lo < hi), mid + 1, lo), np.where(up | (lo >= hi), hi, mid)
        return lo

    def values(self) -> np.ndarray:
        """The whole sequence, from the last plane back to the first."""
        out = np.zeros(self.n, dtype=np.uint16 if self.width <= 16 else np.uint32)
        up = np.empty_like(out)
        for p in range(self.width - 1, -1, -1):
            one = np.unpackbits(self.plane(p), count=self.n, bitorder="little").view(bool)
            x, y = 0, self.zeros[p]
            out[y:] |= out.dtype.type(1 << (self.width - 1 - p))
            for a in range(0, self.n, BLOCK):
                some, ones = up[a:a + BLOCK], one[a:a + BLOCK]
                low, high = np.flatnonzero(~ones), np.flatnonzero(ones)
                some[low] = out[x:x + len(low)]
                some[high] = out[y:y + len(high)]
                x, y = x + len(low), y + len(high)
            out, up = up, out
        return out

    @staticmethod
    def _deflated(plane: np.ndarray) -> bytes:
        """A plane has runs of equal bytes to find, hardly other repeats: those alone take half the time."""
        z = zlib.compressobj(1, strategy=zlib.Z_RLE)
        return z.compress(plane) + z.flush()

    def to_bytes(self) -> bytes:
        packed = [self._deflated(self.plane(p)) for p in range(self.width)]
        steps = [zlib.compress(np.diff(x).astype("<u2").tobytes(), 1) for x in self.samples]
        return b"".join([struct.pack("<QQ", self.n, self.width), np.array(self.zeros, dtype="<u8").tobytes(),
                         np.array([len(x) for x in (*packed, *steps)], dtype="<u8").tobytes(), *packed, *steps])

    @classmethod
    def from_bytes(cls, data: memoryview) -> WaveletMatrix:
        n, width = struct.unpack_from("<QQ", data)
        zeros = np.frombuffer(data, "<u8", width, 16).tolist()
        sizes = np.frombuffer(data, "<u8", 2 * width, 16 + 8 * width).astype(np.int64)
        cut = 16 + 24 * width + np.concatenate([[0], np.cumsum(sizes)])
        parts = [data[x:y] for x, y in zip(cut[:-1], cut[1:])]
        samples = [np.concatenate([[0], np.cumsum(np.frombuffer(zlib.decompress(x), "<u2"), dtype=np.int64)]).astype(np.uint32) for x in parts[width:]]
        return cls(n, parts[:width], zeros, samples)


def pack(part: int, seq: int, ids: list, sizes: np.ndarray, tokens: np.ndarray, width: int) -> bytes:
    """One file: place in the order, document ids (with nulls) and sizes, wavelet matrix."""
    null = np.array([i is None for i in ids], dtype=np.uint8)
    docs = zlib.compress(null.tobytes() + np.array([i or 0 for i in ids], dtype="<i8").tobytes() + sizes.astype("<i8").tobytes(), 1)
    return b"".join([MAGIC, struct.pack("<QQQQ", part, seq, len(ids), len(docs)), docs,
                     WaveletMatrix.build(tokens, width).to_bytes()])


def unpack(data: bytes) -> tuple[int, int, list, np.ndarray, WaveletMatrix]:
    """part, seq, document ids, sizes, matrix."""
    if data[:8] != MAGIC:
        raise ValueError("not a token-id file")
    part, seq, n, size = struct.unpack_from("<QQQQ", data, 8)
    docs = zlib.decompress(data[40:40 + size])
    null, ids = np.frombuffer(docs, np.uint8, n), np.frombuffer(docs, "<i8", n, n)
    return part, seq, [None if x else int(i) for x, i in zip(null, ids)], np.frombuffer(docs, "<i8", n, 9 * n), \
        WaveletMatrix.from_bytes(memoryview(data)[40 + size:])


class Runs:
    """A generation of runs: run -> number, and the numbers' ids one after the other."""

    def __init__(self, dtype: np.dtype):
        self.number: dict[str, int] = {}
        self.held, self.start = np.zeros(1 << 18, dtype=dtype), np.zeros(1, dtype=np.int64)

    def add(self, runs: list[str], ids: np.ndarray, cut: np.ndarray) -> None:
        """Number ``runs``, whose ids lie in ``ids`` between ``cut``'s places."""
        n, used = len(self.start) - 1, int(self.start[-1])
        while used + len(ids) > len(self.held):
            self.held = np.concatenate([self.held, np.zeros_like(self.held)])
        self.held[used:used + len(ids)] = ids
        self.start = np.concatenate([self.start, used + cut[1:]])
        self.number.update(zip(runs, range(n, n + len(runs))))

    def ids(self, number) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the runs of these numbers, and where each run's start (and end)."""
        number = np.asarray(number, dtype=np.int64)
        start = self.start[number]
        size = self.start[number + 1] - start
        many = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(start - many[:-1], size)
        at += np.arange(many[-1])
        return self.held[at], many


class WordTokenizer:
    """Whole-text ids of a word-level BPE file, through the tokenizers library and a bounded
    cache of words."""

    _loaded: dict[str, WordTokenizer] = {}

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.model = Tokenizer(self.whole.model)  # the bare model: words are cut here
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.split = regex.compile(PATTERN)
        self.unsettled = re.compile(f"[^{SETTLED}]")
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.to_chars = {b: c for c, b in byte_chars().items() if b != 32}  # words have no blank
        self.top = max(max(spec["model"]["vocab"].values()), *self.special.values(), END_ID)
        suffix = spec["model"]["end_of_word_suffix"]
        self.ends = np.zeros(self.top + 1, dtype=bool)  # tokens that end a run
        self.ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
        self.dtype = np.dtype("<u2" if self.top < 1 << 16 else "<u4")
        self.cache = WordCache(MAX_CACHED_BYTES)
        self.runs = self.old_runs = Runs(self.dtype)

    @classmethod
    def load(cls, path: str) -> WordTokenizer:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    @property
    def width(self) -> int:
        return self.top.bit_length()

    @staticmethod
    def _plain(text: str) -> list[str]:
        """Runs of characters that are no white space: no word goes past one."""
        # letter by letter: the final sigma is no exception
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower().split()

    def words(self, text: str) -> list:
        if not any(s in text for s in self.special):
            return self._plain(text)
        out = []
        for piece in self.at_special.split(text):
            out += [("special", piece)] if piece in self.special else self._plain(piece)
        return out

    def _ids(self, words: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all of ``words`` (lower-cased), and where each word's start (and end)."""
        # letters alone are one run; the bare model closes each run with a token that ends one
        parts = [1 if w.isalpha() else self.split.findall(w) for w in words]
        many = [1 if p == 1 else len(p) for p in parts]
        joined = " ".join([w if p == 1 else " ".join(p) for w, p in zip(words, parts) if p])
        if not joined.isascii():
            joined = joined.encode().decode("latin-1")
        if not joined.isprintable():
            joined = joined.translate(self.to_chars)
        ids = np.array(self.model.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype=self.dtype)
        run = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
        return ids, run[np.concatenate([[0], np.cumsum(many, dtype=np.int64)])]

    def _learn(self, words: list) -> None:
        for w in [w for w in words if isinstance(w, tuple)]:
            self.cache.add(w, np.array([self.special[w[1]]], dtype=self.dtype).tobytes())
        words = [w for w in words if not isinstance(w, tuple)]
        for a in range(0, len(words), 4000):
            ids, cut = self._ids(words[a:a + 4000])
            for w, x, y in zip(words[a:a + 4000], cut[:-1].tolist(), cut[1:].tolist()):
                self.cache.add(w, ids[x:y].tobytes())

    def _numbers(self, runs: list[str]) -> np.ndarray:
        """The number of each of ``runs`` in the young generation. A run that only the old one
        has moves up with its ids, others are learnt."""
        if len(self.runs.number) > MAX_RUNS:
            self.old_runs, self.runs = self.runs, Runs(self.dtype)
        young, old = self.runs, self.old_runs
        found = list(map(young.number.get, runs))
        new = [w for w, n in zip(runs, found) if n is None]
        if new and old is not young:
            at = list(map(old.number.get, new))
            young.add([w for w, n in zip(new, at) if n is not None], *old.ids([n for n in at if n is not None]))
            new = [w for w, n in zip(new, at) if n is None]
        for a in range(0, len(new), 20_000):
            some = new[a:a + 20_000]
            young.add(some, *self._ids([w if w.isascii() else w.lower() for w in some]))
        if None in found:
            found = [young.number[w] if n is None else n for w, n in zip(runs, found)]
        return np.array(found, dtype=np.int64)

    def encode(self, texts: list) -> list[bytes]:
        """Ids of each text, cut one by one."""
        odd = [bool(t) and self.unsettled.search(t) is not None for t in texts]
        split = [self.words(t) if t and not x else [] for t, x in zip(texts, odd)]
        self._learn(self.cache.missing(set().union(*split)))
        cache = self.cache.ids
        return [np.array(self.whole.encode(t, add_special_tokens=False).ids, dtype=self.dtype).tobytes() if x
                else b"".join(map(cache.__getitem__, ws)) for t, x, ws in zip(texts, odd, split)]

    def encode_together(self, texts: list) -> list[bytes]:
        """Ids of each text; those of common characters are cut together."""
        import pyarrow as pa
        blobs = [(t or "").encode() for t in texts]
        data = np.frombuffer(b" ".join(blobs), dtype=np.uint8)
        off = np.cumsum([0, *[len(b) + 1 for b in blobs]])
        other = np.zeros(len(texts), dtype=bool)
        other[np.searchsorted(off, np.flatnonzero(_OTHER[data]), side="right") - 1] = True
        for i in np.flatnonzero(~other).tolist():
            other[i] = b"<|" in blobs[i] and any(s in texts[i] for s in self.special)
        around = np.zeros(len(data) + 2, dtype=np.uint8)  # a blank in front and behind
        kind = around[1:-1]
        np.take(_KIND, data, out=kind)
        sign = np.flatnonzero((data == 0x97) | (data == 0xB7))  # of those characters two are no letters
        kind[sign] = 3
        kind[sign - 1] = 3
        for i in np.flatnonzero(other).tolist():  # their bytes count as blanks here
            kind[off[i]:off[i + 1] - 1] = 0
        inside = kind != 0
        edge = around[1:] != around[:-1]
        edge[:-1] |= kind == 2  # every digit is a run
        # signs and letters around an apostrophe may belong together: such a word stays whole
        apart = np.flatnonzero((data == 39) & inside)
        if len(apart):
            blank = np.flatnonzero(~inside)
            at = np.searchsorted(blank, apart)
            for x, y in set(zip(np.concatenate([[-1], blank])[at].tolist(), np.append(blank, len(data))[at].tolist())):
                edge[x + 2:y] = False
        edge = np.flatnonzero(edge)
        filled = inside[edge[:-1]]
        start, end = edge[:-1][filled], edge[1:][filled]
        at = np.concatenate([[0], np.cumsum(end - start)])
        words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(_TO_LOWER[data[inside]])).dictionary_encode()
        number = self._numbers(words.dictionary.to_numpy(zero_copy_only=False).tolist())[words.indices.to_numpy()]
        flat, many = self.runs.ids(number)
        cut = many[np.searchsorted(start, off)]
        rest = iter(self.encode([t for t, x in zip(texts, other) if x])) if other.any() else iter(())
        return [next(rest) if x else flat[a:b].tobytes() for x, a, b in zip(other.tolist(), cut[:-1].tolist(), cut[1:].tolist())]


def tokenise(docs: DataFrame, text_col: str, path: str, out: str = "ids", end_id: int = END_ID) -> DataFrame:
    """``docs`` with the ids of every whole text and the end id, as binary (16 bits an id if the
    vocabulary allows, else 32; little-endian)."""
    def make():
        import pyarrow as pa
        tok = WordTokenizer.load(path)
        end = np.array([end_id], dtype=tok.dtype).tobytes()
        return lambda texts: [pa.array([x + end for x in tok.encode_together(texts)], pa.binary())]
    return append_columns(docs, text_col, make, [(out, "binary")], 1 << 21)


def _ranged(ids: DataFrame, bounds: np.ndarray) -> DataFrame:
    """``ids`` with the number of its id range."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            part = np.searchsorted(bounds, batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32))], names=["id", "ids", "part"])
    return ids.mapInArrow(run, "id bigint, ids binary, part int")


def write(docs: DataFrame, id_col: str, text_col: str, path: str, file_tokens: int = FILE_TOKENS) -> tuple[str, DataFrame]:
    """Tokenise and write; the folder and its files (part, seq, n_docs, n_tokens) in order."""
    spark = docs.sparkSession
    small_batches(spark)  # a slice each: memory that the runs' ids may take
    out = folder(spark, "token-files")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # bounds of the id ranges from a scan of the ids alone, so that texts are tokenised just once
    shares = F.array(*[F.lit((i + 1) / parts) for i in range(parts - 1)])
    bounds = src.select(F.percentile_approx("id", shares, 100 * parts).alias("b")).first()["b"] if parts > 1 else None
    bounds = np.array(sorted(set(bounds or [])), dtype=np.int64)  # null ids come first, in range 0
    ids = _ranged(tokenise(src, "t", path).drop("t"), bounds)
    order = ["id", F.xxhash64("ids")]

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        tok = WordTokenizer.load(path)
        part, seq, held, blobs, size = TaskContext.get().partitionId(), 0, [], [], 0
        made = []

        def flush():
            nonlocal seq, held, blobs, size
            tokens = np.frombuffer(b"".join(blobs), dtype=tok.dtype)
            sizes = np.array([len(b) // tok.dtype.itemsize for b in blobs])
            write_file(f"{out}/part-{part:05d}-{seq:05d}.wm", pack(part, seq, held, sizes, tokens, tok.width))
            made.append((part, seq, len(held), len(tokens)))
            seq, held, blobs, size = seq + 1, [], [], 0
        for batch in batches:
            for i, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and size + len(b) > file_tokens * tok.dtype.itemsize:
                    flush()
                held.append(i)
                blobs.append(b)
                size += len(b)
        if held:
            flush()
        release_memory()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*made)], names=["part", "seq", "n_docs", "n_tokens"])

    files = ids.repartitionById(len(bounds) + 1, F.col("part")).drop("part").sortWithinPartitions(*order) \
               .mapInArrow(run, "part bigint, seq bigint, n_docs bigint, n_tokens bigint")
    return out, stored(files, "token-manifest")


def read(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids) of every document, from the files alone; ``files`` tells which
    tokens come before a file."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for data in batch.column(0):
                part, seq, ids, sizes, matrix = unpack(data.as_py())
                tokens = matrix.values().astype("<u4")
                at = np.concatenate([[0], np.cumsum(sizes)])
                for a in range(0, len(ids), 1000):
                    b = min(a + 1000, len(ids))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * (b - a), pa.int64()), pa.array([seq] * (b - a), pa.int64()), pa.array(ids[a:b], pa.int64()),
                         pa.array(at[a:b], pa.int64()), pa.array(sizes[a:b], pa.int64()),
                         pa.array([tokens[x:y].tobytes() for x, y in zip(at[a:b], at[a + 1:b + 1])], pa.binary())],
                        names=["part", "seq", "id", "at", "n_tokens", "ids"])
                del data, matrix, tokens
        release_memory()

    if files.limit(1).count() == 0:
        return spark.createDataFrame([], "id bigint, start bigint, n_tokens bigint, ids binary")
    total = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row per partition
    before, offsets = 0, []
    for r in total:
        offsets.append((r["part"], before))
        before += r["n"]
    offsets = spark.createDataFrame(offsets, "part bigint, part_start bigint")
    w = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    starts = files.withColumn("file_start", F.coalesce(F.sum("n_tokens").over(w), F.lit(0))).join(F.broadcast(offsets), "part") \
                  .select("part", "seq", (F.col("part_start") + F.col("file_start")).alias("file_start"))
    docs = spark.read.format("binaryFile").option("pathGlobFilter", "*.wm").load(path).select("content") \
                .mapInArrow(run, "part bigint, seq bigint, id bigint, at bigint, n_tokens bigint, ids binary")
    return docs.join(stored(starts, "file-starts"), ["part", "seq"]) \
               .select("id", (F.col("file_start") + F.col("at")).alias("start"), "n_tokens", "ids")
