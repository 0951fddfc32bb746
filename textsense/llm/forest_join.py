"""Near-duplicate join on word shingles: a MinHash LSH forest, then exact verification.

A text's set of distinct word shingles is signed by ``trees`` keys of ``depth`` MinHash values.
In each tree the keys, in sorted order, are a prefix trie; texts under one node of it are
candidates. Matching starts at the full depth in every tree. A text whose recall is below the
target then shortens its prefix by one value in one tree after the other, until the probability
to meet a partner reaches the target (``shortenings``). That partner is taken at the least similarity,
not below the threshold, that sets of its size can have at all: texts of few shingles are done
at the full depth, long ones go on. The order of the trees is fixed, since an order by what a
prefix finds would make the recall depend on the finds. At a shortened prefix a text meets all texts, whether these
went on or not; a trie node that no text still seeks in makes no candidates.

Candidates are then compared exactly on their shingle sets, by matrix products, in tasks of
bounded size. A cluster of candidates that fits a task is compared whole. In a larger one either
all pairs or the pairs under each trie node are compared, whichever is less work, so a chain of
chance candidates costs its own pairs only; a pair under several nodes counts in its first
tree. Classes are the components of verified links. What leaves a task is a row per text (its
number of links and its root), never a row per pair.

Texts with equal sets are one node from the start, so copies, however many, cost one row.
Nothing is capped: a cluster or trie node too large for one task is cut into blocks, and each
pair of blocks is a task of its own.

Defined results: a text without a word (null, empty, blank) has no shingles, no links and is its
own class; one with fewer words than a shingle has one shingle; class_id is the least id of the
class (null only if all its ids are); repeated rows are copies of each other; words are runs of
bytes other than ASCII white space, A-Z lower-cased; recall is null without shingles.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HashFilter, free_name, release_memory, seeds, set_id, shingle_set, slices, small_batches, stored, text_arrays
from .components import components

SHINGLE = 5
THRESHOLD = 0.8
TREES = 24
DEPTH = 6
VALUE_BITS = 10
TARGET_RECALL = 0.9995
BLOCK_NODES = 512
BLOCK_SHINGLES = 1 << 20


FEW = 64  # sets of more shingles are held to the threshold itself


def least_similarity(n: int, threshold: float) -> float:
    """The least Jaccard similarity of at least ``threshold`` between a set of ``n`` elements and
    another, different set (1 if there is none)."""
    if n > FEW:
        return threshold
    best = 1.0
    for m in range(max(1, math.ceil(threshold * n - 1e-9)), math.floor(n / threshold + 1e-9) + 1):
        both = math.ceil(threshold * (n + m) / (1 + threshold) - 1e-9)
        both = min(both, n - 1) if m == n and both == n else both
        if both <= min(n, m) and both >= threshold * (n + m - both) - 1e-9:
            best = min(best, both / (n + m - both))
    return best


def depth_in(tree, steps, trees: int, depth: int):
    """Prefix length in ``tree`` after ``steps`` shortenings, dealt to the trees in turn."""
    return depth - (steps + trees - 1 - tree) // trees


def miss(similarity: float, steps: int, trees: int, depth: int) -> float:
    """Probability that a pair meets in no tree after ``steps`` shortenings."""
    d = depth_in(np.arange(trees), steps, trees, depth)
    return float(np.prod(1 - similarity ** d.astype(float)))


@lru_cache(maxsize=None)
def shortenings(trees: int, depth: int, threshold: float, target: float) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """(shortenings, recall) of a text by its number of shingles, up to FEW + 1 for all larger:
    as many as its recall needs to reach the target, at most down to one value in each tree."""
    steps, recall = [], []
    for n in range(FEW + 2):
        s, k = least_similarity(n, threshold), 0
        while miss(s, k, trees, depth) > 1 - target and k < trees * (depth - 1):
            k += 1
        steps.append(k)
        recall.append(1 - miss(s, k, trees, depth))
    return tuple(steps), tuple(recall)


def signature_keys(sets: list[np.ndarray], trees: int, depth: int) -> np.ndarray:
    """int64 array (texts, trees): ``depth`` MinHash values of VALUE_BITS bits each, the first
    one in the highest bits. ``sets`` must not be empty sets."""
    joined = np.concatenate(sets)
    start = np.cumsum([0, *map(len, sets[:-1])])
    factor = seeds(trees * depth, 21)
    keys = np.zeros((len(sets), trees), dtype=np.uint64)
    for t in range(trees):
        for d in range(depth):
            low = np.minimum.reduceat(joined * factor[t * depth + d], start)
            # the least product's high bits are nearly 0: take bits that its value spreads
            low = (low * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - VALUE_BITS)
            keys[:, t] = (keys[:, t] << np.uint64(VALUE_BITS)) | low
    return keys.astype(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int, trees: int, depth: int) -> DataFrame:
    """(id, text_hash, node, n_shingles, keys) of every row; node identifies the shingle set."""
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("t"))
    id_type = src.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for part in slices(batch, 2, 1 << 20):
                sets = [shingle_set(x, shingle) for x in text_arrays(part.column(2))]
                full = [s for s in sets if len(s)]
                keys = iter(signature_keys(full, trees, depth)) if full else iter(())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([set_id(s) if len(s) else None for s in sets], pa.binary()),
                     pa.array([len(s) for s in sets], pa.int32()),
                     pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                    names=["id", "text_hash", "node", "n_shingles", "keys"])
        release_memory()

    return src.mapInArrow(run, f"id {id_type}, text_hash bigint, node binary, n_shingles int, keys array<bigint>")


def _linked_counts(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs with a Jaccard similarity of ``threshold`` or more."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), size)
    shared = times[code] > 1
    row, code = row[shared], code[shared]
    both = np.zeros((m, m))
    if len(code):
        order = np.argsort(code, kind="stable")
        row, code = row[order], code[order]
        code = np.cumsum(np.diff(code, prepend=code[0]) != 0)
        width = max(256, (4 << 20) // max(m, 1))
        for a in range(0, int(code[-1]) + 1, width):
            lo, hi = np.searchsorted(code, [a, a + width])
            x = np.zeros((m, min(width, int(code[-1]) + 1 - a)), dtype=np.float32)
            x[row[lo:hi], code[lo:hi] - a] = 1
            both += x @ x.T
    return both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9


def _roots(linked: np.ndarray) -> np.ndarray:
    """Least index of each row's component."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _owned(i, j, keys, own, tree: int, level: int, depth: int):
    """Of the linked pairs (i, j) under a trie node, those that count there: the node is where the pair
    meets in this tree, and it met in no tree before."""
    counts = np.minimum(own[i, tree], own[j, tree]) == level
    for t in range(tree):
        shift = (VALUE_BITS * (depth - np.minimum(own[i, t], own[j, t]))).astype(np.uint64)
        counts &= (keys[i, t] >> shift) != (keys[j, t] >> shift)
    return counts


def _verify(threshold: float, trees: int, depth: int, steps: tuple[int, ...]):
    """Function over batches of (branch, label, p, q, nid, mult, block, keys, set) sorted by (branch,
    label, p, q, nid): a whole cluster (branch -1) or a trie node's texts, two blocks at a time."""
    def group(branch, p, q, rows):
        rows = list({r[0]: r for r in rows}.values())  # a repeated row of the table comes twice
        nid, mult, block, keys, sets = zip(*rows)
        linked = _linked_counts(list(sets), threshold)
        np.fill_diagonal(linked, False)
        block = np.array(block)
        if p != q:  # two blocks, one of them perhaps empty: pairs inside one belong to another task
            linked &= block[:, None] != block[None, :]
        roots = _roots(linked)
        if branch >= 0 and linked.any():
            i, j = np.nonzero(linked)
            done = np.array([steps[min(len(s), FEW + 1)] for s in sets])
            own = depth_in(np.arange(trees)[None, :], done[:, None], trees, depth)
            tree, level = divmod(branch, depth + 1)
            off = ~_owned(i, j, np.array(keys, dtype=np.int64).astype(np.uint64), own, tree, level, depth)
            linked[i[off], j[off]] = False
        links = linked.astype(np.int64) @ np.array(mult, dtype=np.int64)
        return [(n, int(k), nid[r]) for n, k, r in zip(nid, links, roots)]

    def run(batches):
        import pyarrow as pa
        key, rows, out = None, [], []

        def batch_of(out):
            a, b, c = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())],
                                              names=["nid", "links", "root"])
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(8)]
            for at, (branch, lab, p, q, nid, mult, block, keys) in enumerate(zip(*cols)):
                if (branch, lab, p, q) != key:
                    if rows:
                        out += group(key[0], *key[2:], rows)
                    key, rows = (branch, lab, p, q), []
                    if len(out) >= 5000:
                        yield batch_of(out)
                        out = []
                rows.append((nid, mult, block, keys, np.frombuffer(batch.column(8)[at].as_py(), dtype=np.uint64)))
        if rows:
            out += group(key[0], *key[2:], rows)
        if out:
            yield batch_of(out)
        del rows, out
        release_memory()
    return run


def _entries(nodes: DataFrame, steps: tuple[int, ...], trees: int, depth: int) -> DataFrame:
    """(nid, branch, prefix, seeks) for every trie node that a text is under: at its own depth
    in a tree, where it seeks, and at the shorter prefixes at which others seek. ``branch`` is tree * (depth + 1) + level."""
    levels = [sorted({int(depth_in(t, k, trees, depth)) for k in steps}) for t in range(trees)]
    done = F.lit(list(steps))[F.least("n_shingles", F.lit(FEW + 1))]
    own = nodes.select("nid", done.alias("done"), F.posexplode("keys").alias("tree", "k")).select(
        "nid", "tree", "k", F.expr(f"{depth} - int((done + {trees - 1} - tree) div {trees})").alias("own"))
    level = F.array(*[F.lit(x) for x in levels])[F.col("tree")]
    return own.select("nid", "tree", "k", "own", F.explode(level).alias("level")).where("level <= own").select(
        "nid", (F.col("tree") * (depth + 1) + F.col("level")).alias("branch"), (F.col("level") == F.col("own")).alias("seeks"),
        F.expr(f"shiftrightunsigned(k, {VALUE_BITS} * ({depth} - level))").alias("prefix"))


def _blocks(n, shingles):
    return F.greatest(F.ceil(n / BLOCK_NODES), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")


def _less_apart():
    """Whether the trie nodes of a cluster (work: their squares) take less than all its pairs."""
    return F.col("work") < F.col("n").cast("double") * F.col("n")


def _places(members: DataFrame, steps: tuple[int, ...], trees: int, depth: int) -> DataFrame:
    """(nid, places) with the tasks of a cluster's member, array<struct(branch, label, blocks, block)>: one for
    the whole cluster, or one for each trie node it shares where that is less to compare."""
    block = F.pmod(F.xxhash64("nid"), "blocks").cast("int").alias("block")
    sizes = stored(members.groupBy("label").agg(F.count(F.lit(1)).alias("n"), _blocks(F.count(F.lit(1)), F.sum("n_shingles")).alias("blocks")),
                   "cluster-sizes")
    large = members.join(sizes.where("blocks > 1").select("label"), "label")
    entries = _entries(large.select("nid", "n_shingles", "keys"), steps, trees, depth)
    of = large.select("nid", "label", "n_shingles")
    shared = stored(entries.join(of, "nid").groupBy("branch", "prefix")
                    .agg(F.count(F.lit(1)).alias("c"), F.max("seeks").alias("sought"), F.min("label").alias("label"),
                         _blocks(F.count(F.lit(1)), F.sum("n_shingles")).alias("blocks")).where("c > 1 and sought"), "trie-nodes")
    work = shared.groupBy("label").agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("work"))
    apart = stored(sizes.where("blocks > 1").join(work, "label").where(_less_apart()).select("label"), "apart")
    whole = members.join(sizes.join(apart, "label", "left_anti"), "label").select(
        "nid", F.array(F.struct(F.lit(-1).alias("branch"), "label", "blocks", block)).alias("places"))
    under = entries.join(shared.join(apart, "label", "left_semi").drop("label"), ["branch", "prefix"])
    under = under.groupBy("nid").agg(F.collect_list(F.struct("branch", F.col("prefix").alias("label"), "blocks", block)).alias("places"))
    return whole.unionByName(under)


def classes(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, threshold: float = THRESHOLD,
            trees: int = TREES, depth: int = DEPTH, target: float = TARGET_RECALL) -> DataFrame:
    """(id, text_hash, n_shingles, class_key, class_id, n_links, recall) of every row of ``docs``:
    the class is the connected component of links, n_links the number of other rows whose
    similarity is at least the threshold, recall the least probability that such a row was met."""
    small_batches(docs.sparkSession)
    steps, recall = shortenings(trees, depth, threshold, target)
    rows = stored(signatures(docs, id_col, text_col, shingle, trees, depth), "signatures")
    nodes = stored(rows.where("node is not null").groupBy("node")
                   .agg(F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("text_hash"))).alias("first"),
                        F.count(F.lit(1)).alias("mult"), F.any_value("n_shingles").alias("n_shingles"),
                        F.any_value("keys").alias("keys"))
                   .withColumn("nid", F.monotonically_increasing_id()), "nodes")
    # the forest: in each tree, texts under a trie node hang on the least of them
    # (sides of a join that are sums by its key are written first: Spark can then split a hot key)
    entries = _entries(nodes, steps, trees, depth)
    heads = stored(entries.groupBy("branch", "prefix").agg(F.min("nid").alias("head"), F.count(F.lit(1)).alias("c"),
                                                           F.max("seeks").alias("sought"))
                   .where("c > 1 and sought").select("branch", "prefix", "head"), "heads")
    # a text's heads (one a trie node at most) hang on the least of them, and it does: most texts of
    # a group share their heads, so few edges are left
    hung = entries.join(heads, ["branch", "prefix"]).groupBy("nid").agg(F.collect_set("head").alias("on"))
    on = hung.select("on", F.array_min("on").alias("b"), F.explode(F.array_union("on", F.array("nid"))).alias("a"))
    clusters = components(on.where("a <> b").select("a", "b"))
    members = clusters.join(nodes.select(F.col("nid").alias("node"), "mult", "n_shingles", "first", "keys"), "node") \
                      .withColumnRenamed("node", "nid")
    members = stored(members, "members")
    wanted = members.join(_places(members, steps, trees, depth), "nid").select(
        "nid", "mult", "places", F.when(F.col("places")[0]["branch"] >= 0, F.col("keys")).alias("keys"),
        F.col("first.id").alias("w_id"), F.col("first.text_hash").alias("w_hash"))
    # texts outside the clusters are spared the shuffle
    texts = docs.select(F.col(id_col).alias("d_id"), F.xxhash64(text_col).alias("d_hash"), F.col(text_col).alias("t"))
    texts = HashFilter(members.select(F.col("first.text_hash").alias("h")), "h").rows(texts, "d_hash", inside=True)
    found = texts.join(wanted, (texts["d_hash"] == wanted["w_hash"]) & texts["d_id"].eqNullSafe(wanted["w_id"])) \
                 .select("nid", "mult", "places", "keys", "t")

    def to_sets(batches):
        import pyarrow as pa
        for batch in batches:
            for part in slices(batch, 4, 2 << 20):
                sets = [shingle_set(x, shingle).tobytes() for x in text_arrays(part.column(4))]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(sets, pa.binary())],
                                                 names=["nid", "mult", "places", "keys", "set"])
        release_memory()
    sets = found.mapInArrow(to_sets, "nid bigint, mult bigint, places array<struct<branch:int,label:bigint,blocks:int,block:int>>, "
                                     "keys array<bigint>, set binary")
    tasks = sets.select("nid", "mult", "keys", "set", F.inline("places")) \
                .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
                .select("branch", "label", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"),
                        "nid", "mult", "block", "keys", "set")
    checked = tasks.repartition("branch", "label", "p", "q").sortWithinPartitions("branch", "label", "p", "q", "nid") \
                   .mapInArrow(_verify(threshold, trees, depth, steps), "nid bigint, links bigint, root bigint")
    checked = stored(checked, "verified")
    links = checked.groupBy("nid").agg(F.sum("links").alias("links"), F.count(F.lit(1)).alias("times"), F.min("root").alias("root"))
    # texts of one task have their classes; the others' parts are joined up by their roots
    split = checked.join(links.where("times > 1").select("nid"), "nid", "left_semi").where("nid <> root")
    joined = components(split.select(F.col("nid").alias("a"), F.col("root").alias("b")))
    links = links.join(joined.withColumnRenamed("node", "nid"), "nid", "left") \
                 .select("nid", "links", F.coalesce("label", F.when(F.col("times") > 1, F.col("nid")).otherwise(F.col("root"))).alias("root"))
    named = nodes.select("node", "nid", "mult", F.col("first.id").alias("id")).join(links, "nid", "left") \
                 .withColumn("class_key", F.coalesce("root", "nid"))
    ids = stored(named.groupBy("class_key").agg(F.min("id").alias("class_id")), "class-ids")
    named = stored(named.join(ids, "class_key").select(
        "node", "class_key", "class_id", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links")), "classes")
    out = rows.join(named, "node", "left")
    return out.select("id", "text_hash", "n_shingles", "class_key",
                      F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
                      F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.when(F.col("node").isNotNull(), F.lit(list(recall))[F.least("n_shingles", F.lit(FEW + 1))]).alias("recall"))


def keep_one(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """``docs`` with one row of each class, the one with the least id; rows without a shingle all
    stay. Columns unchanged."""
    found = stored(classes(docs, id_col, text_col, **options), "class-rows")
    row = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("text_hash"))
    chosen = stored(found.where("class_key is not null").groupBy("class_key").agg(F.min(row).alias("first")), "chosen")
    marked = found.join(chosen, "class_key", "left").withColumn(
        "stays", F.col("class_key").isNull() | (row == F.col("first")) | (F.col("first.none") & F.col("id").isNull()
                                                                      & (F.col("text_hash") == F.col("first.text_hash"))))
    # one decision for an id and text; several such rows of a class are copies of each other
    x_id, x_hash = free_name(docs, "x_id"), free_name(docs, "x_hash")
    decided = stored(marked.groupBy(F.col("id").alias(x_id), F.col("text_hash").alias(x_hash))
                     .agg(F.max("stays").alias("x_stays"),
                          ((F.count(F.lit(1)) > 1) & F.max(F.col("class_key").isNotNull())).alias("x_often")), "decided")
    # rows of classes with one row need no join: only texts that may belong to others are shuffled
    shared = found.groupBy("class_key").count().where("class_key is not null and count > 1")
    shared = HashFilter(found.join(stored(shared, "shared"), "class_key", "left_semi").select("text_hash").distinct(), "text_hash")
    base = docs.withColumn(x_hash, F.xxhash64(text_col))
    names = [F.col(f"`{c}`") for c in docs.columns]
    keep = decided.where("x_stays").drop("x_stays")
    kept = shared.rows(base, x_hash, inside=True) \
        .join(keep.withColumnRenamed(x_hash, "k_hash"), (F.col(x_hash) == F.col("k_hash")) & F.col(f"`{id_col}`").eqNullSafe(F.col(x_id)))
    alone = shared.rows(base, x_hash, inside=False).select(*names)
    if keep.where("x_often").limit(1).count() == 0:
        return alone.unionByName(kept.select(*names))
    once = kept.where("x_often").dropDuplicates([x_hash, x_id])
    return alone.unionByName(kept.where("not x_often").select(*names)).unionByName(once.select(*names))
