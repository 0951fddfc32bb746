"""Sharding by balanced label propagation.

Every document starts in a pseudo-random shard. In each round the documents of a group (linked
documents; in the query: equal texts) move towards the shard that holds most of their group
(the several that do, for a group larger than a shard). Moves are accepted under quotas: swaps between two shards always balance,
and what a shard has free is shared out among the rest of those who want in. A round is one
aggregation to (group, shard) counts, which a hot group passes as one row per shard and task,
and one join back. Documents without a link never need to move; they fill the shards at the
end, so that the counts of any two shards differ by one at most (law ``rows``).

Only narrow rows (id, size, checksum, group) are shuffled. Ranks come from a range partitioning
and one offset per partition; no task holds a shard or a group.

Defined results: a null text has no bytes (size 8, checksum 0) and no links; rows that are
repeated get a slot each; null ids are allowed; an empty table gives an empty result. The result
depends on the rows (id, text, group) alone, not on their order or partitions: every draw is a
hash of id and text, and ties in the final order are rows alike in all that is returned.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SHARDS = 24
MAX_ROUNDS = 10
UNIT = 1_000_000


def _table_get(values: list, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index)


def _quotas(n: int, k: int) -> list[int]:
    """Rows of each shard: counts at most one apart."""
    return [n // k + (s < n % k) for s in range(k)]


def _accepted_shares(flow: dict, size: list[int], quota: list[int], k: int) -> list[float]:
    """Share of the wishes from shard i to shard j that is granted, flattened to k * k."""
    shares = [0.0] * (k * k)
    for j in range(k):
        swaps = {i: min(flow.get((i, j), 0), flow.get((j, i), 0)) for i in range(k)}
        rest = sum(flow.get((i, j), 0) - swaps[i] for i in range(k))
        room = min(1.0, max(0, quota[j] - size[j]) / rest) if rest else 0.0
        for i in range(k):
            if want := flow.get((i, j), 0):
                shares[i * k + j] = (swaps[i] + room * (want - swaps[i])) / want
    return shares


def propagate(linked: DataFrame, quota: list[int], k: int, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """``linked`` (uid, grp, label, ...) with the labels after propagation. Stops when in two
    rounds fewer than one row in a thousand moves."""
    still = 0
    for step in range(max_rounds):
        size = [0] * k
        for r in linked.groupBy("label").count().collect():  # k rows
            size[r["label"]] = r["count"]
        # every other round looks past full shards, where only swaps could bring a row
        open_ = [size[j] < quota[j] or step % 2 == 1 for j in range(k)]
        counts = linked.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("c"))
        # at most k entries per group; ties by a hash, so that wishes go both ways between shards
        ranked = F.transform(F.filter(
            F.sort_array(F.collect_list(F.struct("c", F.xxhash64("grp", "label").alias("tie"), "label")), asc=False),
            lambda x: _table_get(open_, x["label"])), lambda x: x["label"])
        most = F.ceil(F.sum("c") / max(quota[0], 1)).cast("int")  # shards that the group needs
        groups = counts.groupBy("grp").agg(F.slice(ranked, F.lit(1), F.greatest(most, F.lit(1))).alias("homes"),
                                           (most <= 1).alias("small"))
        # (written, so that the join can split a hot group's rows)
        wish = linked.join(stored(groups, "group-homes"), "grp")
        away = (F.size("homes") > 0) & ~F.array_contains("homes", F.col("label"))
        # rows of a group that one shard holds move together, those of a larger one each for itself
        wish = wish.withColumn("mover", F.when(F.col("small"), F.xxhash64("grp", "label")).otherwise(F.col("uid")))
        wish = wish.withColumn("target", F.when(away, F.get("homes", F.pmod(F.xxhash64("uid"), F.size("homes")).cast("int")))).drop("homes")
        wish = stored(wish, "label-wishes")
        flow = {(r["label"], r["target"]): r["count"]  # k * k rows
                for r in wish.where("target is not null").groupBy("label", "target").count().collect()}
        shares = _accepted_shares(flow, size, quota, k)
        moving = sum(n * shares[i * k + j] for (i, j), n in flow.items())
        granted = _table_get(shares, F.col("label") * k + F.col("target"))
        draw = F.pmod(F.xxhash64("mover", F.lit(step)), F.lit(UNIT)) / UNIT
        linked = wish.withColumn("label", F.when(F.col("target").isNotNull() & (draw < granted), F.col("target"))
                                 .otherwise(F.col("label"))).drop("target", "mover", "small")
        still = still + 1 if moving * 1000 < sum(size) or not flow else 0
        if still == 2:
            break
    return linked


def shard(docs: DataFrame, id_col: str, text_col: str, k: int = SHARDS, max_rounds: int = MAX_ROUNDS,
          group: Column | None = None) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row: shard 0 to k - 1, slots gapless from 0.

    ``group``: what links rows (null: no link); the text's digest by default."""
    spark = docs.sparkSession
    text = F.col(text_col)
    group = F.md5(text.cast("binary")) if group is None else group
    base = stored(docs.select(
        F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), group.alias("grp"),
        F.xxhash64(F.col(id_col).cast("string"), F.lit("|"), text).alias("uid")), "shard-base")
    n = base.count()
    quota = _quotas(n, k)
    start_label = F.pmod(F.xxhash64("uid"), F.lit(k)).cast("int")
    groups = stored(base.where("grp is not null").groupBy("grp").count().where("count > 1").select("grp"), "groups")
    flagged = stored(base.join(groups.withColumn("linked", F.lit(True)), "grp", "left")
                     .withColumn("label", start_label).withColumn("linked", F.col("linked").isNotNull()), "shard-linked")
    linked = propagate(flagged.where("linked").drop("linked"), quota, k, max_rounds)
    alone = flagged.where("not linked").drop("linked").withColumn("label", F.lit(k))  # after all labels
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["label", "grp", "uid", "id", "size", "text_crc32"]
    pool = linked.select(*alone.columns).unionByName(alone)
    # position in the partition: the lower 33 bits; partition: the bits above
    ranked = stored(pool.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                    .withColumn("at", F.monotonically_increasing_id()), "shard-order")
    at = ranked.withColumn("part", F.shiftright("at", 33)).withColumn("pos", F.col("at").bitwiseAND((1 << 33) - 1))
    tally = at.groupBy("part").count().orderBy("part").collect()  # a row per partition
    before = accumulate([0, *[r["count"] for r in tally]])
    offsets = spark.createDataFrame([(r["part"], b) for r, b in zip(tally, before)], "part long, before long")
    per_label = [0] * (k + 1)
    for r in at.groupBy("label").count().collect():  # k + 1 rows
        per_label[r["label"]] = r["count"]
    label_start = [0, *accumulate(per_label)]
    held = [min(per_label[j], quota[j]) for j in range(k)]
    over_before = [0, *accumulate(per_label[j] - held[j] for j in range(k))]  # rows beyond a shard's quota
    free_before = [0, *accumulate(quota[j] - held[j] for j in range(k))]
    label = F.col("label")
    g = at.join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + F.col("pos") - _table_get(label_start, label))
    stays = (label < k) & (F.col("rank") < _table_get([*held, 0], label))
    filler = F.when(label < k, _table_get([*over_before[:k], 0], label) + F.col("rank") - _table_get([*held, 0], label)) \
        .otherwise(over_before[k] + F.col("rank"))
    g = g.withColumn("filler", F.when(~stays, filler).cast("long"))
    to = F.lit(0)
    for j in range(1, k):
        to = to + (F.col("filler") >= free_before[j]).cast("int")
    g = g.withColumn("shard", F.when(F.col("filler").isNull(), label).otherwise(to).cast("int"))
    slot = F.when(F.col("filler").isNull(), F.col("rank")) \
        .otherwise(_table_get(held, F.col("shard")) + F.col("filler") - _table_get(free_before[:k], F.col("shard")))
    return g.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", slot.cast("long").alias("slot"))


def cut_links(assigned: DataFrame, group_col: str, shard_col: str) -> DataFrame:
    """One row (links, cut): the pairs of rows of one group, and those of them that lie in two
    shards. Counted from the rows of each (group, shard), so no pair is made; a null group has
    no links."""
    pairs = lambda n: (n * (n - 1) / 2).cast("decimal(38,0)")
    count = F.count(F.lit(1)).cast("decimal(18,0)")
    per = assigned.where(F.col(group_col).isNotNull()).groupBy(F.col(group_col).alias("grp"), F.col(shard_col).alias("at")) \
        .agg(count.alias("n")).groupBy("grp").agg(F.sum("n").cast("decimal(18,0)").alias("n"), F.sum(pairs(F.col("n"))).alias("kept"))
    zero = F.lit(0).cast("decimal(38,0)")
    return per.agg(F.coalesce(F.sum(pairs(F.col("n"))), zero).alias("links"),
                   F.coalesce(F.sum(pairs(F.col("n")) - F.col("kept")), zero).alias("cut"))
