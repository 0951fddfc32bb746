"""Language-model scoring with a log-frequency Bloom filter.

N-gram counts are quantised to levels 1 + floor(log2 count), and an n-gram of level q is put into
the filter q times, once for each level up to q. A probe asks for level 1, 2, ... until the first
miss; the last hit is the level. The filter is cut into blocks, all bits of an n-gram lie in one
block, so Spark builds the blocks in parallel. It holds every n-gram and grows with them: their
number sets the number of blocks, and each block is as large as its own n-grams need. The blocks
are a stored table; texts ask for their distinct n-grams by block number (``score``).

Counts come from all training texts: words (and one end mark per text), and all pairs of
neighbours. P(w | v) = (c(v w) + MU * P1(w)) /
(c(v .) + MU) with P1(w) = (c(w) + 1) / (N' + V + 1), all c from probes; N' is the sum of all
words' counts as the filter knows them, so that P1 adds up to one. Every word has a right
neighbour, the end mark at least, so that c(v .) is c(v).

Next to the model, every text gets its exact unigram score (``base_score``). Exact counts of the
``HEAD`` most frequent words are broadcast (a fixed bound); the few occurrences of all other
words are joined with the full count table, so no vocabulary, however large, goes to one place.

Defined results: a null or empty text has one token, the end; with nothing to learn from, N and V
are 0; words of equal frequency are either all in the head or all joined; repeated rows each get
their row. Words are counted by a 64-bit hash.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, slices, stored, text_arrays, word_hashes

HEAD = 1 << 20
MU = 1000.0
PROBES = 4
MAX_LEVEL = 48
HELD = 1 << 20  # distinct n-grams that a counting task holds before it emits them
BLOCK_GRAMS = 1 << 20  # n-gram occurrences that come to a block of the stored filter
LEAST_BLOCKS = 1 << 8
KEY_BYTES = 5
SLICE = 4 << 20  # bytes of text that ask the filter together
END = np.uint64(0x5851F42D4C957F2D)
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def tokens(data: np.ndarray) -> np.ndarray:
    """Hashes of a text's words, A-Z lower-cased, and the end mark."""
    return np.append(word_hashes(data), END)


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix64(v * _PAIR + w)


def _signed(x: np.ndarray):
    return x.view(np.int64)


class _Tally:
    """Counts of hashes, merged in bounded memory."""

    def __init__(self):
        self.new, self.size = [], 0

    def add(self, hashes: np.ndarray):
        self.put(*np.unique(hashes, return_counts=True))

    def put(self, h: np.ndarray, c: np.ndarray):
        self.new.append((h, c))
        self.size += len(h)

    def merged(self):
        if not self.new:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        h = np.concatenate([x for x, _ in self.new])
        c = np.concatenate([y for _, y in self.new])
        self.new, self.size = [], 0
        u, at = np.unique(h, return_inverse=True)
        return u, np.bincount(at, weights=c, minlength=len(u)).astype(np.int64)

    def shrink(self, always: bool = False):
        """Merge what is held; returns the merged counts once they are too many to hold on
        (``always``: they are held all the same)."""
        u, c = self.merged()
        if len(u) > HELD // 2 and not always:
            return u, c
        self.new, self.size = [(u, c)], len(u)
        return None


def _tallies(batches, grams):
    """(hashes, counts) of the hashes that ``grams(list of token arrays)`` returns, sorted, in
    parts of bounded size; a hash may be in several parts."""
    tally = _Tally()
    for batch in batches:
        for part in slices(batch, 0, 1 << 20):
            found = grams([tokens(x) for x in text_arrays(part.column(0))])
            if len(found):
                tally.add(found)
            if tally.size > HELD and (full := tally.shrink()):
                yield full
    u, c = tally.merged()
    if len(u):
        yield u, c


def _counts(texts: DataFrame, grams) -> DataFrame:
    """(h, c): summed counts of the hashes that ``grams(list of token arrays)`` returns."""
    def run(batches):
        import pyarrow as pa
        for u, c in _tallies(batches, grams):
            yield pa.RecordBatch.from_arrays([pa.array(_signed(u)), pa.array(c)], names=["h", "c"])
    return texts.mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


def _neighbours(parts: list[np.ndarray]) -> np.ndarray:
    """All pairs of neighbours."""
    joined = np.concatenate(parts)
    ok = joined[:-1] != END  # a text's last token has no neighbour
    return pair_hash(joined[:-1][ok], joined[1:][ok])


def _member(sorted_hashes: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_hashes):
        return np.zeros(len(x), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_hashes, x), len(sorted_hashes) - 1)
    return sorted_hashes[at] == x


def middle(q: np.ndarray) -> np.ndarray:
    """The count that stands for a level: 0, 1, then the geometric middle."""
    return np.where(q <= 1, q, np.exp2(q - 0.5))


@dataclass(frozen=True)
class Filter:
    """``blocks`` rows of bits; all bits of one n-gram lie in the block its hash names."""

    bits: np.ndarray  # uint8, blocks x bytes
    per_block: int

    def level(self, h: np.ndarray, block: np.ndarray | None = None) -> np.ndarray:
        """Largest level up to which every probe hits (0: not in the filter)."""
        out = np.zeros(len(h), dtype=np.int64)
        if self.per_block == 0:
            return out
        live = np.arange(len(h))
        if block is None:
            block = (h >> np.uint64(52)).astype(np.int64)
        for q in range(1, MAX_LEVEL + 1):
            at = positions(h[live], q, self.per_block)
            hit = ((self.bits[block[live][:, None], at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)
            live = live[hit]
            if not len(live):
                break
            out[live] = q
        return out

    def count(self, h: np.ndarray) -> np.ndarray:
        """Counts as the filter knows them."""
        return middle(self.level(h))


def positions(h: np.ndarray, q: int, per_block: int) -> np.ndarray:
    """Bits of level ``q`` inside the block, len(h) x PROBES."""
    a = mix64(h + np.uint64(q * int(_PAIR) % (1 << 64)))
    b = (a >> np.uint64(32)) | np.uint64(1)
    k = np.arange(PROBES, dtype=np.uint64)
    return (((a & np.uint64(0xFFFFFFFF))[:, None] + b[:, None] * k) % np.uint64(per_block)).astype(np.int64)


def _level():
    return (F.floor(F.log2("c")) + 1).cast("int")


def _levels(counts: DataFrame) -> dict[int, int]:
    """Entries of each level."""
    return {r["q"]: r["count"] for r in counts.groupBy(_level().alias("q")).count().collect()}


def block_count(occurrences: int) -> int:
    """Blocks of the stored filter: a power of two, so that BLOCK_GRAMS n-grams come to one."""
    return max(LEAST_BLOCKS, 1 << max(0, -(-occurrences // BLOCK_GRAMS) - 1).bit_length())


def _cuts(sorted_hashes: np.ndarray, blocks: int):
    """(block, from, to) of every block that has some of the hashes."""
    block = (sorted_hashes >> np.uint64(65 - blocks.bit_length())).astype(np.int64)
    edges = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
    return [(int(block[a]), int(a), int(b)) for a, b in zip(edges[:-1], edges[1:])]


def _block_bits(h: np.ndarray, c: np.ndarray) -> bytes:
    """The bits of one block, with room for all its n-grams."""
    q = 1 + np.floor(np.log2(c)).astype(np.int64)
    bits = max(64, 1 << int(np.ceil(np.log2(int(q.sum()) * PROBES / np.log(2)))))
    row = np.zeros(bits, dtype=bool)
    for lv in range(1, int(q.max()) + 1):
        row[positions(h[q >= lv], lv, bits).ravel()] = True
    return np.packbits(row, bitorder="little").tobytes()


def _block_levels(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Level of each n-gram of one block (uint8 array of its bits)."""
    return Filter(bits[None, :], len(bits) * 8).level(h, np.zeros(len(h), dtype=np.int64)) if len(bits) else np.zeros(len(h), dtype=np.int64)


def _keys(h: np.ndarray, blocks: int) -> np.ndarray:
    """What a block knows its n-grams by: the KEY_BYTES bytes of the hash below the block's bits.
    Blocks have about equally many n-grams at any size of the input, so two of them share a key
    (and then the sum of their counts) about once in 2^20, far more seldom than a probe errs."""
    return (h << np.uint64(blocks.bit_length() - 1)) >> np.uint64(64 - 8 * KEY_BYTES)


def _planes(x: np.ndarray, size: int = 8) -> bytes:
    """The ``size`` lowest bytes of the numbers: all first bytes, then all second bytes, ..., since
    those that hardly change compress."""
    return x.view(np.uint8).reshape(len(x), -1)[:, :size].T.tobytes()


def _from_planes(data, size: int = 8, n: int = -1, offset: int = 0) -> np.ndarray:
    x = np.frombuffer(data, np.uint8, n if n < 0 else n * size, offset).reshape(size, -1)
    out = np.zeros((x.shape[1], 8), dtype=np.uint8)
    out[:, :size] = x.T
    return out.view(np.uint64).ravel()


_PARTS = "block int, h binary, c binary"


def _packed(u: np.ndarray, c: np.ndarray, blocks: int):
    import pyarrow as pa
    cuts, key = _cuts(u, blocks), _keys(u, blocks)
    return pa.RecordBatch.from_arrays(
        [pa.array([x for x, _, _ in cuts], pa.int32()), pa.array([_planes(key[a:b], KEY_BYTES) for _, a, b in cuts], pa.binary()),
         pa.array([_planes(c[a:b]) for _, a, b in cuts], pa.binary())], names=["block", "h", "c"])


def store_filter(words: DataFrame, texts: DataFrame, grams, blocks: int) -> DataFrame:
    """(block, bits) of the filter over the word counts (h, c) and the counts of all hashes that
    ``grams`` returns, stored. Each block is as large as its n-grams need."""
    def of_words(batches):
        for batch in batches:
            h, c = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            order = np.argsort(h)
            if len(h):
                yield _packed(h[order], c[order], blocks)

    def of_texts(batches):
        for u, c in _tallies(batches, grams):
            yield _packed(u, c, blocks)

    def fill(batches):
        import pyarrow as pa
        now, tally = None, _Tally()

        def done():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([_block_bits(*tally.merged())], pa.binary())],
                                              names=["block", "bits"])
        for batch in batches:
            for block, h, c in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if block != now:
                    if now is not None:
                        yield done()
                    now = block
                tally.put(_from_planes(h.as_buffer(), KEY_BYTES), _from_planes(c.as_buffer()).view(np.int64))
                if tally.size > HELD:
                    tally.shrink(always=True)
        if now is not None:
            yield done()

    parts = words.select("h", "c").mapInArrow(of_words, _PARTS).unionByName(texts.mapInArrow(of_texts, _PARTS))
    return stored(parts.repartition("block").sortWithinPartitions("block").mapInArrow(fill, "block int, bits binary"), "filter-blocks")


@dataclass(frozen=True)
class Model:
    n: int
    v: int
    head: np.ndarray         # sorted hashes of the most frequent words
    head_count: np.ndarray
    n_filter: float          # sum of all words' counts as the filter knows them
    blocks: int
    filter: DataFrame        # (block, bits), stored


def _arrow_column(table, name):
    return table[name].combine_chunks().to_numpy(zero_copy_only=False)


def train(docs: DataFrame, text_col: str, head: int = HEAD) -> tuple[Model, DataFrame]:
    """The model and the table (h, c) of all word counts."""
    texts = docs.select(F.col(text_col).alias("t"))
    words = stored(_counts(texts, np.concatenate), "word-counts")
    tot = words.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    # a histogram of counts tells from which count on words fit the head: no sort, no top-k task
    fine = F.floor(F.log2("c") * 16).cast("int")
    room, least_bin = head, 0
    for r in words.groupBy(fine.alias("b")).count().orderBy(F.desc("b")).collect():  # 16 rows an octave
        room -= r["count"]
        if room < 0:
            least_bin = r["b"] + 1
            break
    top = words.where(fine >= least_bin).toArrow()  # at most ``head`` rows
    h, c = _arrow_column(top, "h").astype(np.int64).view(np.uint64), _arrow_column(top, "c").astype(np.int64)
    order = np.argsort(h)
    blocks = block_count(2 * tot["n"])  # a word and a pair for each token at most
    held_filter = store_filter(words, texts, _neighbours, blocks)
    n_filter = sum(k * float(middle(np.array(q))) for q, k in _levels(words).items())
    return Model(tot["n"], tot["v"], h[order], c[order], n_filter, blocks, held_filter), words


def _asked(uniq: np.ndarray, code: np.ndarray, start: np.ndarray):
    """What the score of a slice of texts asks of the filter. Tokens are ``uniq[code]``, texts begin
    at ``start``. Returns the sorted hashes; each token's item, an item being a pair (v, w) or a
    text's first word; and per item the places of w, v and the pair among the hashes (-1: none)."""
    v = np.full(len(code), -1, dtype=np.int64)
    v[1:] = code[:-1]
    v[start] = -1
    items, item = np.unique((v + 1) * (len(uniq) + 1) + code, return_inverse=True)
    v, w = items // (len(uniq) + 1) - 1, items % (len(uniq) + 1)
    has = v >= 0
    asked = np.concatenate([uniq, pair_hash(uniq[v[has]], uniq[w[has]])])
    order = np.argsort(asked)
    place = np.empty(len(asked), dtype=np.int64)
    place[order] = np.arange(len(asked))
    pair = np.full(len(items), -1)
    pair[has] = place[len(uniq):]
    return asked[order], item, place[w], np.where(has, place[v], -1), pair


def _log_p(m: Model, level: np.ndarray, word: np.ndarray, ctx: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """log10 of each item's probability; ``level`` of each hash asked for."""
    count = np.append(middle(level), 0.0)  # the last one is for -1
    p1 = (count[word] + 1.0) / (m.n_filter + m.v + 1.0)
    return np.log10((np.minimum(count[pair], count[ctx]) + MU * p1) / (count[ctx] + MU))


def score(docs: DataFrame, id_col: str, text_col: str, model: Model, words: DataFrame) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row.

    A slice of texts asks each block of the filter for its distinct n-grams: one row a slice and
    block. Those rows meet the stored block in its task, and the levels go back to the slice."""
    light = replace(model, filter=None)  # the stored blocks are not broadcast
    held = docs.sparkSession.sparkContext.broadcast(light)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    id_type = src.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        m = held.value
        uid = TaskContext.get().partitionId() << 33
        names = ["id", "uid", "n_tokens", "known", "base", "rare", "times", "block", "data"]
        base_floor = -np.log10(float(m.n + m.v + 1))
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                parts = [tokens(x) for x in text_arrays(part.column(1))]
                n = np.array([len(x) for x in parts])
                start = np.cumsum(n) - n
                uniq, code = np.unique(np.concatenate(parts), return_inverse=True)
                in_head = _member(m.head, uniq)
                exact = np.zeros(len(uniq), dtype=np.int64)
                if in_head.any():
                    exact[in_head] = m.head_count[np.searchsorted(m.head, uniq[in_head])]
                base = np.where(in_head, np.log10(exact + 1.0) + base_floor, 0.0)
                tail = ~in_head[code]
                rare = [np.unique(_signed(uniq[code[a:a + k][tail[a:a + k]]]), return_counts=True) for a, k in zip(start, n)]
                none = [None] * len(n)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.arange(uid, uid + len(n))), pa.array(n, pa.int64()),
                     pa.array(np.add.reduceat(in_head[code].astype(np.int64), start), pa.int64()),
                     pa.array(np.add.reduceat(base[code], start), pa.float64()), pa.array([r[0] for r in rare], pa.list_(pa.int64())),
                     pa.array([r[1] for r in rare], pa.list_(pa.int64())), pa.array(none, pa.int32()), pa.array(none, pa.binary())],
                    names=names)
                often = np.argsort(-np.bincount(code), kind="stable")  # frequent words first: small numbers pack well
                number = np.empty(len(often), dtype=np.int64)
                number[often] = np.arange(len(often))
                data = np.array([len(n), len(uniq)]).tobytes() + n.astype(np.int64).tobytes() + _planes(uniq[often]) + _planes(number[code], 4)
                data = len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, part.column(0).type), pa.array([uid], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()),
                     pa.nulls(1, pa.float64()), pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.list_(pa.int64())),
                     pa.array([-1], pa.int32()), pa.array([data], pa.binary())], names=names)
                uid += len(n)

    # one pass gives the rows of the texts (block null) and of the slices (-1)
    made = stored(src.mapInArrow(run, f"id {id_type}, uid bigint, n_tokens bigint, known bigint, base double, "
                                      "rare array<bigint>, times array<bigint>, block int, data binary"), "lm-rows")
    rows = made.where("block is null")

    def open_slice(data):
        import pyarrow as pa
        data = data.as_buffer()
        data = pa.decompress(data[8:], int.from_bytes(data[:8].to_pybytes(), "little"), "zstd")
        n, u = np.frombuffer(data, np.int64, 2)
        size = np.frombuffer(data, np.int64, n, 16)
        uniq = _from_planes(data, 8, u, 16 + 8 * n)
        return uniq, _from_planes(data, 4, -1, 16 + 8 * (n + u)).astype(np.int64), np.cumsum(size) - size

    def ask(batches):
        import pyarrow as pa
        blocks = held.value.blocks
        for batch in batches:
            for uid, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                asked = _asked(*open_slice(data))[0]
                cuts, key = _cuts(asked, blocks), _keys(asked, blocks)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x for x, _, _ in cuts], pa.int32()), pa.array([uid] * len(cuts), pa.int64()),
                     pa.array([_planes(key[a:b], KEY_BYTES) for _, a, b in cuts], pa.binary())], names=["block", "uid", "data"])

    def answer(batches):
        import pyarrow as pa
        now, bits = None, None
        for batch in batches:
            block, uid, data = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            keep, out = [], []
            for i in range(len(block)):
                if uid[i] < 0:  # the block itself, sorted before all that is asked of it
                    now, bits = block[i], np.frombuffer(data[i].as_py(), np.uint8)
                else:
                    keep.append(i)
                    own = bits if now == block[i] else np.empty(0, np.uint8)
                    out.append(_block_levels(own, _from_planes(data[i].as_buffer(), KEY_BYTES)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(block[keep], pa.int32()), pa.array(uid[keep], pa.int64()), pa.array(out, pa.binary())],
                                             names=["block", "uid", "data"])

    slices_ = made.where("block = -1").select("block", "uid", "data")
    asked = slices_.select("uid", "data").mapInArrow(ask, "block int, uid bigint, data binary").unionByName(
        model.filter.select("block", F.lit(-1).cast("long").alias("uid"), F.col("bits").alias("data")))
    levels = asked.repartition("block").sortWithinPartitions("block", "uid").mapInArrow(answer, "block int, uid bigint, data binary")

    def finish(batches):
        import pyarrow as pa
        m = held.value
        now, slice_, got = None, None, []

        def done():
            uniq, code, start = open_slice(slice_)
            _, item, word, ctx, pair = _asked(uniq, code, start)
            p = _log_p(m, np.frombuffer(b"".join(got), np.uint8).astype(np.int64), word, ctx, pair)
            return pa.RecordBatch.from_arrays([pa.array(np.arange(now, now + len(start))), pa.array(np.add.reduceat(p[item], start))],
                                              names=["uid", "score"])
        for batch in batches:
            block, uid, data = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for i in range(len(block)):
                if uid[i] != now:
                    if now is not None:
                        yield done()
                    now, got = uid[i], []
                if block[i] < 0:
                    slice_ = data[i]
                else:
                    got.append(data[i].as_py())
        if now is not None:
            yield done()

    scores = slices_.unionByName(levels).repartition("uid").sortWithinPartitions("uid", "block").mapInArrow(finish, "uid bigint, score double")
    floor = float(-np.log10(float(model.n + model.v + 1)))
    rare = rows.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("uid", F.col("r.rare").alias("h"), F.col("r.times").alias("k"))
    rest = rare.join(words, "h", "left").groupBy("uid").agg(
        F.sum(F.col("k") * (F.log10(F.coalesce("c", F.lit(0)) + 1.0) + floor)).alias("rest"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0)).alias("rest_known"))
    out = rows.drop("rare", "times", "block", "data").join(rest, "uid", "left").join(scores, "uid")
    return out.select("id", "n_tokens", (F.col("known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
                      F.lit(model.n).cast("long").alias("train_tokens"),
                      (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score")
