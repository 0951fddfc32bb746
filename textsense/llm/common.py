"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh folder of the shared checkpoint folder and read it back: the
    lineage is cut, every later reader sees the same rows, and a lost executor loses nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(id_col: Column | str, k: int) -> Column:
    """crc32 of the id as text, modulo ``k`` (a null id counts as the empty text)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % k


def free_name(df: DataFrame, want: str) -> str:
    """``want``, lengthened until no column of ``df`` has that name (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    while want.lower() in taken:
        want += "_"
    return want


def keep_where(df: DataFrame, condition: Column) -> DataFrame:
    """``df.where(condition)``, evaluated after the columns that the condition reads. A plain
    filter is pushed below them, with a copy of their costly expressions for each use; it stays
    above a column that is not deterministic."""
    here = free_name(df, "here")
    return df.withColumn(here, F.spark_partition_id()).where(condition & (F.col(here) >= 0)).drop(here)


class WordCache:
    """word -> ids, in bounded memory: two generations of about ``max_bytes`` each. When the
    young one is full it becomes the old one; words met again move up, so frequent words stay."""

    def __init__(self, max_bytes: int):
        self.max_bytes, self.bytes, self.ids, self.old = max_bytes, 0, {}, {}

    def missing(self, words: set) -> list:
        """The words whose ids are not known; room is made first, so ``ids`` holds all of
        ``words`` once those are added."""
        if self.bytes > self.max_bytes:
            self.old, self.ids, self.bytes = self.ids, {}, 0
        out = []
        for w in words - self.ids.keys():
            known = self.old.get(w)
            if known is None:
                out.append(w)
            else:
                self.add(w, known)
        return out

    def add(self, word, ids: bytes) -> None:
        self.ids[word] = ids
        self.bytes += 140 + len(word) + len(ids)


def small_batches(spark: SparkSession, size: str = "2m") -> None:
    """From now on an Arrow batch that this session hands to Python holds ``size`` of rows, not
    64 MB: a task keeps its rows in several places at once (Spark's vectors, the stream, the
    worker), outside the heap. No result depends on it; a caller's own value is left alone."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, size)


# --- numpy text helpers (used inside Arrow tasks) -------------------------------------------

_U = np.uint64
MIX1, MIX2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)  # finaliser constants of splitmix64


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, elementwise on uint64."""
    x = x ^ (x >> _U(30))
    x = x * MIX1
    x = x ^ (x >> _U(27))
    x = x * MIX2
    return x ^ (x >> _U(31))


def seeds(n: int, seed: int) -> np.ndarray:
    """``n`` odd uint64 constants, the same in every process."""
    return mix64(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


_BYTE_CODE = seeds(256, 11)
_BASE = int(seeds(1, 12)[0])
_POW_BLOCK = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(max(n, 1), dtype=_U)
    out[0] = 1
    filled = 1
    while filled < n:
        step = min(filled, n - filled)
        out[filled:filled + step] = out[:step] * _U(pow(base, filled, 1 << 64))
        filled += step
    return out[:n]


_INV_BASE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    up = _powers(_BASE, _POW_BLOCK)
    down = _powers(_INV_BASE, _POW_BLOCK)

    @classmethod
    def get(cls, n: int):
        if n > len(cls.up):
            size = max(n, 2 * len(cls.up))
            cls.up, cls.down = _powers(_BASE, size), _powers(_INV_BASE, size)
        return cls.up, cls.down


SPACE_BYTES = np.zeros(256, dtype=bool)
SPACE_BYTES[[0x20, 9, 10, 11, 12, 13]] = True
_TO_LOWER = np.arange(256, dtype=np.uint8)
_TO_LOWER[65:91] += 32


def word_hashes(data: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the words (runs of bytes other than ASCII white space) of one UTF-8
    text given as a uint8 array; A-Z are lower-cased first if ``lower``. Every byte position
    of the text takes part; the work is linear and vectorised."""
    n = len(data)
    if n == 0:
        return np.empty(0, dtype=_U)
    if lower:
        data = _TO_LOWER[data]
    gap = SPACE_BYTES[data]
    edge = np.flatnonzero(np.diff(gap, prepend=True, append=True))
    start, end = edge[0::2], edge[1::2]
    up, down = _Powers.get(n)
    total = np.empty(n + 1, dtype=_U)
    total[0] = 0
    np.cumsum(_BYTE_CODE[data] * up[:n], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    return mix64(h ^ (end - start).astype(_U))


_GRAM_CODE = seeds(64, 13)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of ``n`` consecutive words; one hash of the whole text when it has
    fewer words (but some)."""
    if len(words) == 0:
        return words
    if len(words) < n:
        n = len(words)
    out = np.zeros(len(words) - n + 1, dtype=_U)
    for j in range(n):
        out += words[j:j + len(out)] * _GRAM_CODE[j]
    return mix64(out + _U(n))


def shingle_set(data: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the text's ``n``-word shingles."""
    return np.unique(gram_hashes(word_hashes(data), n))


def set_id(shingles: np.ndarray) -> bytes:
    """128-bit identity of a sorted shingle set."""
    import hashlib
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def text_arrays(col) -> list:
    """The UTF-8 bytes of each text of an Arrow string array as uint8 arrays (null: empty)."""
    import pyarrow as pa
    import pyarrow.compute as pc
    col = pc.cast(col, pa.large_string()) if not pa.types.is_large_string(col.type) else col
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    _, offs, buf = col.buffers()
    if offs is None or len(col) == 0:
        return []
    o = np.frombuffer(offs, dtype=np.int64, count=col.offset + len(col) + 1)[col.offset:]
    b = np.frombuffer(buf, dtype=np.uint8) if buf is not None and buf.size else np.empty(0, np.uint8)
    null = col.is_null().to_numpy(zero_copy_only=False)
    return [b[:0] if null[i] else b[o[i]:o[i + 1]] for i in range(len(col))]


def slices(batch, col: int, max_bytes: int):
    """Row slices of an Arrow batch with about ``max_bytes`` of text in column ``col`` each (one
    row at least), so that a task holds a bounded part of a batch as Python objects."""
    import pyarrow as pa
    import pyarrow.compute as pc
    size = pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False) \
        if not pa.types.is_null(batch.column(col).type) else np.zeros(batch.num_rows, dtype=np.int64)
    part = np.cumsum(size.astype(np.int64)) // max_bytes
    cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cut, cut[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def release_memory() -> None:
    """At a task's end: what Arrow and the C library hold without need goes back to the machine.
    The worker stays for later tasks, beside the executor's JVM."""
    import ctypes

    import pyarrow as pa
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def append_columns(df: DataFrame, text_col: str, make, fields: list[tuple[str, str]], max_bytes: int = 1 << 20) -> DataFrame:
    """``df`` with the columns ``fields`` (name, Spark type) that ``make()`` computes from the
    texts: it is called once per task and returns a function from a list of texts (None for
    null) to a list of Arrow arrays. All columns of ``df`` pass through, but for those whose
    name (in any case) is a new column's: the new column replaces them."""
    from pyspark.sql import types as T
    at = df.columns.index(text_col)
    taken = {n.lower() for n, _ in fields}
    held = [i for i, f in enumerate(df.schema.fields) if f.name.lower() not in taken]
    schema = T.StructType([df.schema.fields[i] for i in held]
                          + T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in fields)).fields)
    names = [f.name for f in schema.fields]

    def run(batches):
        import pyarrow as pa
        work = make()
        for batch in batches:
            for part in slices(batch, at, max_bytes):
                new = work(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in held], *new], names=names)
        del work
        release_memory()

    return df.mapInArrow(run, schema)


def write_file(uri: str, data: bytes) -> None:
    """Write ``data`` under ``uri`` of a shared store in one step: a task that is run again, or
    twice at a time, leaves the same whole file."""
    import uuid

    from pyarrow import fs
    store, path = fs.FileSystem.from_uri(uri)
    part = f"{path}.{uuid.uuid4().hex}"
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, path)


def folder(spark: SparkSession, name: str) -> str:
    """URI of a fresh folder in the shared checkpoint folder."""
    path = shared_path(spark, name)
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


class HashFilter:
    """A bit per hash bucket: tells for a 64-bit hash whether it may be among those put in. Of
    bounded size (``max_bits``); a fuller filter only says "may be" more often, so it can spare
    rows a shuffle but never decides a result."""

    def __init__(self, hashes: DataFrame, col: str, max_bits: int = 1 << 25):
        n = hashes.count()
        self.bits = int(min(max_bits, max(1 << 12, 1 << (16 * max(n, 1) - 1).bit_length())))
        at = F.pmod(F.col(col), F.lit(self.bits))
        words = hashes.where(F.col(col).isNotNull()).select(at.alias("at")) \
            .groupBy(F.shiftright("at", 5).alias("w")) \
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 32 as int))")).alias("x")).toArrow()  # bits / 32 rows at most
        table = np.zeros(self.bits // 32, dtype=np.uint32)
        if words.num_rows:
            table[words["w"].to_numpy()] = words["x"].to_numpy().astype(np.uint32)
        self.held = hashes.sparkSession.sparkContext.broadcast(table)

    def may_have(self, hashes: np.ndarray) -> np.ndarray:
        """Inside a task: whether each of ``hashes`` may be among them."""
        h = hashes.astype(np.int64) % self.bits
        return (self.held.value[h >> 5] >> (h & 31).astype(np.uint32)) & 1 != 0

    def rows(self, df: DataFrame, col: str, inside: bool) -> DataFrame:
        """The rows of ``df`` whose hash may be among them (``inside``), or all the others."""
        at = df.columns.index(col)

        def run(batches):
            import pyarrow as pa
            for batch in batches:
                hit = self.may_have(batch.column(at).to_numpy(zero_copy_only=False))
                yield batch.filter(pa.array(hit if inside else ~hit))
            release_memory()
        return df.mapInArrow(run, df.schema)
