"""Source divergence audit: which sources of a language use which terms more than it does.

First pass: documents per (language, term), counted exactly; terms in enough documents are
kept. Kept keys are dealt into shards of about ``shard_keys`` by their hash, and each shard gets
a minimal perfect hash: levels of bit arrays in which a key owns a bit that no other key of its
level meets, its slot being the number of bits before it. The keys are stored by slot.

Second pass: shards are broadcast in rounds of at most ``round_bytes`` (a round is one scan of
the texts), so no broadcast grows with the vocabulary. A task looks up its terms, compares them
with the stored keys (a hash never decides), and adds counts in dense pages of slots for each
group, handed over when ``held_cells`` are in use.

Shares are integers, p = 1 + floor(SCALE * (count + 1) / (N + V)), and all arithmetic is exact:
divisions go digit by digit, so that products stay in 64 bits up to 9e15 terms.

The pairs of sources of a language are as many as the result has rows. Their sums over all kept
terms come from blocks of terms of at most ``block_cells`` counts, added up by Spark.

Defined results: null text, language and source count as ''; repeated rows count each; groups
without terms, and languages without kept terms, appear with value 0; an empty table gives no
rows; ties rank by the item's UTF-8 bytes; texts of any length are read whole; other columns
are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import _BYTE_CODE, _Powers, mix64, seeds, slices, stored

SCALE = 1_000_000_000
MIN_DOCS = 3
TOP = 200
PAGE = 16
LEVELS = 40
_SEED = seeds(LEVELS + 2, 41)

_TERM = np.zeros(256, dtype=np.uint8)  # byte -> byte of a term, lower-cased, or 0
_TERM[97:123] = np.arange(97, 123)
_TERM[65:91] = np.arange(97, 123)
_TERM[128:] = np.arange(128, 256)


@dataclass(frozen=True)
class Limits:
    """Sizes that bound memory; results don't depend on them."""

    shard_keys: int = 1 << 16
    round_bytes: int = 64 << 20
    held_cells: int = 8 << 20
    block_cells: int = 1 << 20


def terms(texts) -> tuple:
    """The terms of a string column, in order, and the row of each."""
    import pyarrow as pa
    import pyarrow.compute as pc
    texts = pc.fill_null(pc.cast(texts, pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64, count=texts.offset + len(texts) + 1)[texts.offset:] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0]:offs[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    raw = _TERM[raw]
    inside = raw != 0
    edge = np.diff(inside, prepend=False, append=False)
    edge[offs[1:-1] - offs[0]] |= inside[np.minimum(offs[1:-1] - offs[0], max(len(raw) - 1, 0))] if len(raw) else False
    start = np.flatnonzero(edge[:-1] & inside) if len(raw) else np.zeros(0, np.int64)
    sizes = np.add.reduceat(inside, start, dtype=np.int64) if len(start) else np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw[inside]))
    return out, np.searchsorted(offs - offs[0], start, side="right") - 1


def string_hashes(col) -> np.ndarray:
    """64-bit hash of each string of a column without nulls."""
    import pyarrow as pa
    import pyarrow.compute as pc
    col = pc.cast(col, pa.large_string())
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if len(col) == 0:
        return np.zeros(0, dtype=np.uint64)
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64, count=col.offset + len(col) + 1)[col.offset:]
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0]:offs[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    offs = offs - offs[0]
    up, down = _Powers.get(len(raw) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE_CODE[raw] * up[:len(raw)])])
    return mix64((total[offs[1:]] - total[offs[:-1]]) * down[offs[:-1]] ^ np.diff(offs).astype(np.uint64))


def key_hashes(langs, words) -> np.ndarray:
    return mix64(string_hashes(words) + string_hashes(langs) * _SEED[LEVELS])


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h * _SEED[LEVELS + 1]) >> np.uint64(32)).astype(np.int64) % shards


def build(h: np.ndarray) -> tuple[list[int], bytes, np.ndarray]:
    """Sizes in bits of the levels, their bits, and the slot of each key. Keys with equal hashes
    find no bit of their own; they have the last slots."""
    slot = np.full(len(h), -1, dtype=np.int64)
    left, sizes, bits, used = np.arange(len(h)), [], [], 0
    for level in range(LEVELS):
        if not len(left):
            break
        size = -(-2 * len(left) // 8) * 8
        at = (mix64(h[left] ^ _SEED[level]) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        mine = alone[at]
        slot[left[mine]] = used + (np.cumsum(alone) - 1)[at[mine]]
        used += int(alone.sum())
        sizes.append(size)
        bits.append(np.packbits(alone, bitorder="little").tobytes())
        left = left[~mine]
    slot[left] = used + np.arange(len(left))
    return sizes, b"".join(bits), slot


class Shards:
    """Some shards of the perfect hash, with their keys by slot."""

    def __init__(self, rows, shards: int):
        """``rows``: an Arrow table (shard, base, n, sizes, bits, langs, words), in order of base."""
        import pyarrow as pa
        self.shards = shards
        self.place = np.full(shards, -1, dtype=np.int64)
        self.place[rows["shard"].to_numpy()] = np.arange(rows.num_rows)
        sizes = rows["sizes"].to_pylist()
        self.size = np.zeros((len(sizes), LEVELS), dtype=np.int64)
        for i, s in enumerate(sizes):
            self.size[i, :len(s)] = s
        blobs = rows["bits"].to_pylist()
        packed = np.frombuffer(b"".join(blobs), dtype=np.uint8)
        start = np.cumsum([0, *map(len, blobs)])[:-1] * 8
        self.off = start[:, None] + np.cumsum(self.size, axis=1) - self.size
        self.bits = packed
        # ones before each byte, and how many slots lie before each shard's own
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
        n = rows["n"].to_numpy()
        self.base = np.concatenate([[0], np.cumsum(n)])
        placed = self.before[(start + self.size.sum(axis=1)) >> 3] - self.before[start >> 3]
        self.shift = self.base[:-1] - self.before[start >> 3]
        self.first_key = int(rows["base"][0].as_py()) if rows.num_rows else 0
        self.words = pa.chunked_array(rows["words"]).combine_chunks().flatten().cast(pa.large_string())
        self.langs = pa.chunked_array(rows["langs"]).combine_chunks().flatten()
        self.rest = {(self.langs[i].as_py(), self.words[i].as_py()): int(i) for s, k, m in zip(self.base[:-1], placed, n) for i in range(int(s + k), int(s + m))}

    def slots(self, langs, words) -> np.ndarray:
        """The slot of each key among these shards, -1 for keys that were not put in."""
        import pyarrow as pa
        import pyarrow.compute as pc
        h = key_hashes(langs, words)
        row = self.place[shard_of(h, self.shards)]
        out = np.full(len(h), -1, dtype=np.int64)
        left = np.flatnonzero(row >= 0)
        for level in range(LEVELS):
            size = self.size[row[left], level]
            left = left[size > 0]
            if not len(left):
                break
            r = row[left]
            at = self.off[r, level] + (mix64(h[left] ^ _SEED[level]) % self.size[r, level].astype(np.uint64)).astype(np.int64)
            byte = self.bits[at >> 3]
            hit = (byte >> (at & 7).astype(np.uint8)) & 1 != 0
            below = np.bitwise_count(byte & ((1 << (at & 7)) - 1).astype(np.uint8)).astype(np.int64)
            out[left[hit]] = (self.before[at >> 3] + below + self.shift[r])[hit]
            left = left[~hit]
        found = np.flatnonzero(out >= 0)
        at = pa.array(out[found])
        same = pc.and_(pc.equal(self.words.take(at), pc.cast(words, pa.large_string()).take(pa.array(found))),
                       pc.equal(self.langs.take(at), langs.take(pa.array(found)))).to_numpy(zero_copy_only=False)
        out[found[~same]] = -1
        if self.rest:
            for i in np.flatnonzero(out < 0):
                out[i] = self.rest.get((langs[int(i)].as_py(), words[int(i)].as_py()), -1)
        return out


class Slots:
    """Counts for each group, in pages of PAGE slots that are made when first met."""

    def __init__(self, n: int, held_cells: int):
        self.pages, self.held = -(-n // PAGE), held_cells
        self.clear()

    def clear(self) -> None:
        self.groups: dict = {}
        self.table = np.empty((0, self.pages), dtype=np.int32)
        self.pool, self.used, self.added = np.zeros((64, PAGE), dtype=np.uint32), 0, 0

    @property
    def full(self) -> bool:
        return self.used * PAGE > self.held or self.table.size > self.held or self.added >= 1 << 31

    def group(self, key) -> int:
        if key not in self.groups:
            if len(self.groups) == len(self.table):
                more = np.full((max(4, len(self.table)), self.pages), -1, dtype=np.int32)
                self.table = np.concatenate([self.table, more])
            self.groups[key] = len(self.groups)
        return self.groups[key]

    def add(self, group: np.ndarray, slot: np.ndarray) -> None:
        """Count one for each (group, slot)."""
        at = group * self.pages + slot // PAGE
        page = self.table.ravel()[at]
        new = np.unique(at[page < 0])
        if len(new):
            if self.used + len(new) > len(self.pool):
                more = max(min(len(self.pool), 1 << 16), self.used + len(new) - len(self.pool))
                self.pool = np.concatenate([self.pool, np.zeros((more, PAGE), dtype=np.uint32)])
            self.table.ravel()[new] = self.used + np.arange(len(new))
            self.used += len(new)
            page = self.table.ravel()[at]
        np.add.at(self.pool.ravel(), page.astype(np.int64) * PAGE + slot % PAGE, np.uint32(1))
        self.added += len(slot)

    def rows(self):
        """(key, slots, counts) of each group."""
        for key, g in self.groups.items():
            page = np.flatnonzero(self.table[g] >= 0)
            held = self.pool[self.table[g, page]]
            i, j = np.nonzero(held)
            yield key, page[i] * PAGE + j, held[i, j].astype(np.int64)


def _source(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    def text(c, name):
        return F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    return docs.select(text(lang_col, "lang"), text(source_col, "source"), F.col(text_col).alias("t"))


def kept_terms(src: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, word): the terms in at least ``min_docs`` documents of a language."""
    def count(batches):
        import pyarrow as pa
        for batch in batches:
            for part in slices(batch, 1, 1 << 22):
                words, row = terms(part.column(1))
                enc = words.dictionary_encode()
                code, size = enc.indices.to_numpy().astype(np.int64), max(len(enc.dictionary), 1)
                pair = np.unique(row * size + code)  # a term counts once in a document
                lang = part.column(0).dictionary_encode()
                both, n = np.unique(lang.indices.to_numpy().astype(np.int64)[pair // size] * size + pair % size, return_counts=True)
                yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(both // size)).cast(pa.string()),
                                                  enc.dictionary.take(pa.array(both % size)).cast(pa.string()), pa.array(n, pa.int64())],
                                                 names=["lang", "word", "n"])
    return src.select("lang", "t").mapInArrow(count, "lang string, word string, n bigint") \
              .groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("lang", "word")


@dataclass
class Index:
    """The stored shards and, on the driver, one entry for each."""

    built: DataFrame
    shards: int
    rounds: list  # of lists of (shard, base)


def index(kept: DataFrame, limits: Limits = Limits()) -> Index:
    shards = 1 + kept.count() // limits.shard_keys

    def deal(batches):
        import pyarrow as pa
        for batch in batches:
            s = shard_of(key_hashes(batch.column(0), batch.column(1)), shards)
            yield pa.RecordBatch.from_arrays([pa.array(s), *batch.columns], names=["shard", "lang", "word"])

    def make(table):
        import pyarrow as pa
        langs, words = table["lang"].combine_chunks(), table["word"].combine_chunks()
        sizes, bits, slot = build(key_hashes(langs, words))
        order = pa.array(np.argsort(slot))
        return pa.table({"shard": table["shard"][:1], "n": pa.array([len(slot)], pa.int64()), "sizes": pa.array([sizes], pa.list_(pa.int64())),
                         "bits": pa.array([bits], pa.binary()), "langs": pa.array([langs.take(order).to_pylist()], pa.list_(pa.string())),
                         "words": pa.array([words.take(order).to_pylist()], pa.list_(pa.string()))})

    schema = "shard bigint, n bigint, sizes array<bigint>, bits binary, langs array<string>, words array<string>"
    built = kept.mapInArrow(deal, "shard bigint, lang string, word string").groupBy("shard").applyInArrow(make, schema)
    built = stored(built, "perfect-hash")
    bytes_of = F.octet_length("bits") + 8 * F.col("n") + F.aggregate("words", F.lit(0), lambda a, x: a + F.octet_length(x))
    rounds, held, base = [], 0, 0
    for r in built.select("shard", "n", bytes_of.alias("b")).orderBy("shard").collect():  # a row for each shard_keys keys
        if not rounds or held + r["b"] > limits.round_bytes:
            rounds.append([])
            held = 0
        rounds[-1].append((r["shard"], base))
        held += r["b"]
        base += r["n"]
    return Index(built, shards, rounds)


def recount(src: DataFrame, idx: Index, limits: Limits = Limits()) -> DataFrame:
    """(lang, source, key, n): occurrences of the kept terms in each group; a key is a kept
    term's place among all. One scan of the texts for each round of shards."""
    import pyarrow as pa
    spark = src.sparkSession
    out = []
    for some in idx.rounds:
        part = idx.built.where(F.col("shard").isin([s for s, _ in some])).toArrow()  # round_bytes at most, or one shard
        base = dict(some)
        part = part.append_column("base", pa.array([base[s] for s in part["shard"].to_pylist()], pa.int64())).sort_by("base")
        held = spark.sparkContext.broadcast(Shards(part, idx.shards))

        def count(batches, held=held):
            import pyarrow as pa
            shards = held.value
            slots = Slots(len(shards.words), limits.held_cells)

            def emit():
                for (lang, source), slot, n in slots.rows():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang], pa.string()).take(pa.array(np.zeros(len(slot), np.int64))),
                         pa.array([source], pa.string()).take(pa.array(np.zeros(len(slot), np.int64))),
                         pa.array(slot + shards.first_key), pa.array(n)], names=["lang", "source", "key", "n"])
                slots.clear()
            for batch in batches:
                for rows in slices(batch, 2, 1 << 21):
                    words, row = terms(rows.column(2))
                    enc = words.dictionary_encode()
                    size = max(len(enc.dictionary), 1)
                    lang, source = (rows.column(i).dictionary_encode() for i in (0, 1))
                    of, width = lang.indices.to_numpy().astype(np.int64), len(source.dictionary)
                    # each (language, term) is looked up once, then its slot is read for each occurrence
                    pair = of[row] * size + enc.indices.to_numpy()
                    met = np.flatnonzero(np.bincount(pair, minlength=1))
                    slot = np.full(size * max(len(lang.dictionary), 1), -1, dtype=np.int64)
                    slot[met] = shards.slots(lang.dictionary.take(pa.array(met // size)).cast(pa.string()), enc.dictionary.take(pa.array(met % size)))
                    slot = slot[pair]
                    group = of * width + source.indices.to_numpy()
                    names, group = np.unique(group, return_inverse=True)
                    number = np.array([slots.group((lang.dictionary[g // width].as_py(), source.dictionary[g % width].as_py())) for g in names.tolist()])
                    ok = slot >= 0
                    if ok.any():
                        slots.add(number[group[row[ok]]], slot[ok])
                    if slots.full:
                        yield from emit()
            yield from emit()

        found = src.mapInArrow(count, "lang string, source string, key bigint, n bigint")
        out.append(stored(found.groupBy("lang", "source", "key").agg(F.sum("n").alias("n")), "recount"))
        held.destroy()
    if not out:
        return spark.createDataFrame([], "lang string, source string, key bigint, n bigint")
    both = out[0]
    for x in out[1:]:
        both = both.union(x)
    return both


def keys(idx: Index) -> DataFrame:
    """(key, lang, word) of every kept term."""
    spark = idx.built.sparkSession
    base = spark.createDataFrame([x for some in idx.rounds for x in some], "shard bigint, base bigint")
    return idx.built.join(base, "shard").select("base", F.posexplode(F.arrays_zip("langs", "words")).alias("slot", "k")) \
              .select((F.col("base") + F.col("slot")).alias("key"), F.col("k.langs").alias("lang"), F.col("k.words").alias("word"))


def shares(count: np.ndarray, mass) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / mass), three decimal digits at a time."""
    q, r = np.divmod(count + 1, mass)
    for _ in range(3):
        d, r = np.divmod(r * 1000, mass)
        q = q * 1000 + d
    return q + 1


def _block_sums(counts: DataFrame, groups: DataFrame, cells: int, top: int) -> DataFrame:
    """Blocks of a language's terms, with the counts of all its sources: (lang, source, item, null,
    sum over the block) of all ordered pairs of sources, and (lang, source, null, key, value) of the
    terms that a group uses more than its language, of which a block hands over no more than the
    ``top`` best and their ties."""
    size = groups.groupBy("lang").agg(F.max("v").alias("v"), F.count(F.lit(1)).alias("s"), F.sum("total").alias("lang_total"))
    size = size.select("lang", (F.col("lang_total") + F.col("v")).alias("lang_mass"),
                       F.greatest(F.lit(1), F.ceil(F.col("v") * F.col("s") / cells)).cast("long").alias("blocks"))
    # every block has all sources of its language, with their totals, and its terms' counts
    heads = groups.join(size, "lang").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source",
                                             F.lit(None).cast("long").alias("key"), F.col("mass").alias("n"), "lang_mass")
    body = counts.join(size, "lang").select("lang", F.pmod("key", "blocks").alias("block"), "source", "key", "n", F.lit(None).cast("long").alias("lang_mass"))

    def add(table):
        import pyarrow as pa
        import pyarrow.compute as pc
        head, rows = table.filter(pc.is_null(table["key"])), table.filter(pc.is_valid(table["key"]))
        names = sorted(head["source"].to_pylist())
        number = {x: i for i, x in enumerate(names)}
        mass = np.ones(len(names), dtype=np.int64)
        for x, m in zip(head["source"].to_pylist(), head["n"].to_pylist()):
            mass[number[x]] = max(m, 1)
        found, col = np.unique(rows["key"].to_numpy(), return_inverse=True)
        n = np.zeros((len(names), len(found)), dtype=np.int64)
        enc = rows["source"].combine_chunks().dictionary_encode()
        at = np.array([number[x] for x in enc.dictionary.to_pylist()], dtype=np.int64)
        n[at[enc.indices.to_numpy()] if len(at) else np.zeros(0, np.int64), col] = rows["n"].to_numpy()
        p = shares(n, mass[:, None])
        q = shares(n.sum(axis=0), max(head["lang_mass"][0].as_py(), 1))
        src, item, key, value = [], [], [], []
        for i in range(len(names)):
            d = p - p[i]
            v = (d * d // p[i]).sum(axis=1)
            other = np.flatnonzero(np.arange(len(names)) != i)
            src.append(other)
            item.append(np.full(len(other), i))
            key.append(np.full(len(other), -1))
            value.append(v[other])
            more = np.flatnonzero((n[i] > 0) & (p[i] > q))
            v = (p[i] - q)[more] ** 2 // q[more]
            best = v >= (np.partition(v, len(v) - top)[len(v) - top] if len(v) > top else 0)
            src.append(np.full(best.sum(), i))
            item.append(np.full(best.sum(), -1))
            key.append(found[more[best]])
            value.append(v[best])
        names = pa.array(names, pa.string())
        src, item, key, value = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (src, item, key, value))
        lang = pa.array([table["lang"][0].as_py()], pa.string())
        return pa.table({"lang": lang.take(pa.array(np.zeros(len(src), np.int64))), "source": names.take(pa.array(src)),
                         "item": names.take(pa.array(item, mask=item < 0)), "key": pa.array(key, pa.int64(), mask=key < 0), "value": pa.array(value, pa.int64())})

    return heads.union(body).groupBy("lang", "block").applyInArrow(add, "lang string, source string, item string, key bigint, value bigint")


def audit(docs: DataFrame, text_col: str, lang_col: str, source_col: str, min_docs: int = MIN_DOCS, top: int = TOP,
          limits: Limits = Limits()) -> DataFrame:
    """(lang, source, part, item, value, rank): for every group, part 'pair' has each other
    source of the language with the divergence of the group's shares from that source's, and
    part 'term' the ``top`` terms that the group uses more than its language."""
    src = _source(docs, text_col, lang_col, source_col)
    idx = index(stored(kept_terms(src, min_docs), "kept-terms"), limits)
    counts = recount(src, idx, limits)
    held = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    v = idx.built.select(F.explode("langs").alias("lang")).groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    zero = F.lit(0).cast("long")
    groups = stored(src.select("lang", "source").distinct().join(held, ["lang", "source"], "left").join(v, "lang", "left")
                    .select("lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("v", zero).alias("v"))
                    .withColumn("mass", F.col("total") + F.col("v")), "groups")
    sums = stored(_block_sums(counts, groups, limits.block_cells, top), "block-sums")
    w = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = sums.where("item is not null").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = stored(pairs, "pairs").withColumn("rank", F.row_number().over(w))
    words = sums.where("key is not null").select("lang", "source", "key", "value").join(keys(idx).select("key", F.col("word").alias("item")), "key")
    ranked = stored(words, "terms").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank") \
                .union(ranked.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
