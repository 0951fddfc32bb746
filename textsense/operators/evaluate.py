"""Splits and evaluation reports (ids E6, E9-E12, E14, E15).

E6 stratified split, defined deterministically: within each label, rows are ordered by
``md5(key || ':' || seed)`` (then key) and the first ``round(test * n_label)`` go to test.

Physical plan for E6: a window partitioned by label would put a whole class (here up to
85% of the rows) into one task. Instead the hash prefix (16 bits) buckets every class
uniformly: per-(label, bucket) counts are a small aggregate (at most 65,536 rows per
label) whose running totals give each bucket's offset; a row's rank is its offset plus its
rank inside its (label, bucket) -- a window over a uniformly small partition. Exact, and
no partition holds more than ~n/65,536 of a class.

Reports work on the (true, predicted) pair counts, a table of at most classes^2 rows: the
scored rows are aggregated once and the small table is stored; supports, predicted totals and
hits are three small sums of it, joined on the class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stored
from .filters import sample_key

HASH_BUCKETS_BITS = 16


def stratified_split(df: DataFrame, key: str, label: str, test: float = 0.2, seed: int = 42,
                     out: str = "split") -> DataFrame:
    """``df`` plus ``out`` in {'train', 'test'}."""
    h = sample_key(key, seed)
    nb = 1 << HASH_BUCKETS_BITS
    d = (df.withColumn("__h", h)
           .withColumn("__b", F.conv(F.substring("__h", 1, HASH_BUCKETS_BITS // 4), 16, 10).cast("int")))
    counts = d.groupBy(label, "__b").agg(F.count(F.lit(1)).alias("__c"))
    wl = Window.partitionBy(label).orderBy("__b")
    offsets = (counts
               .withColumn("__before", F.sum("__c").over(wl.rowsBetween(Window.unboundedPreceding, -1)))
               .withColumn("__n", F.sum("__c").over(Window.partitionBy(label)))
               .select(label, "__b", F.coalesce("__before", F.lit(0)).alias("__before"),
                       F.round(F.col("__n") * F.lit(test)).cast("long").alias("__ntest")))
    # (at most labels x 2^16 rows; Spark chooses the join from the sizes it sees)
    wb = Window.partitionBy(label, "__b").orderBy("__h", key)
    r = d.withColumn("__r", F.row_number().over(wb)).join(offsets, [label, "__b"])
    return (r.withColumn(out, F.when(F.col("__before") + F.col("__r") <= F.col("__ntest"), "test")
                         .otherwise("train"))
             .drop("__h", "__b", "__r", "__before", "__ntest"))


def class_labels(df: DataFrame, *cols: str) -> DataFrame:
    """The distinct classes over the given columns, one column ``label``, sorted."""
    labels = F.explode(F.array(*[F.col(c).cast("string") for c in cols]))
    return df.select(labels.alias("label")).where(F.col("label").isNotNull()).distinct().orderBy("label")


def accuracy(df: DataFrame, y: str, p: str) -> DataFrame:
    """Share of rows with prediction == truth, and the row count."""
    return df.agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy"),
                   F.count(F.lit(1)).alias("n"))


def pair_counts(df: DataFrame, y: str, p: str) -> DataFrame:
    """(true, pred, n): the one pass over the scored rows, stored."""
    return stored(df.groupBy(F.col(y).alias("true"), F.col(p).alias("pred")).agg(F.count(F.lit(1)).alias("n")), "pairs")


def confusion(df: DataFrame, y: str, p: str) -> DataFrame:
    """E11 in long form: (true, pred, n) for every pair of classes, zero-filled. Classes are
    those of either column; the matrix has classes^2 cells, which is its definition."""
    pairs = pair_counts(df, y, p)
    labels = class_labels(pairs, "true", "pred").agg(F.sort_array(F.collect_list("label")).alias("all"))
    cells = labels.select(F.explode("all").alias("true"), "all").select("true", F.explode("all").alias("pred"))
    return (cells.join(pairs, ["true", "pred"], "left")
            .select("true", "pred", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def _row(name, p, r, f, n):
    return F.struct(F.lit(name).alias("row_name"), p.cast("double").alias("precision"),
                    r.cast("double").alias("recall"), f.cast("double").alias("f1"), n.cast("long").alias("support"))


def class_report(df: DataFrame, y: str, p: str) -> DataFrame:
    """(row_name, precision, recall, f1, support): one row per class, then 'accuracy'
    (f1 column = accuracy), 'macro avg' and 'weighted avg'; 0 when a denominator is 0."""
    pairs = pair_counts(df, y, p)
    name = lambda c: F.col(c).cast("string").alias("row_name")
    support = pairs.groupBy(name("true")).agg(F.sum("n").alias("support"))
    predicted = pairs.groupBy(name("pred")).agg(F.sum("n").alias("predicted"))
    hits = pairs.where(F.col("true") == F.col("pred")).groupBy(name("true")).agg(F.sum("n").alias("tp"))
    per = (support.join(predicted, "row_name", "full").join(hits, "row_name", "left").where("row_name is not null")
           .na.fill(0, ["support", "predicted", "tp"]))
    per = (per.withColumn("precision", _safe_div(F.col("tp"), F.col("predicted")))
              .withColumn("recall", _safe_div(F.col("tp"), F.col("support"))))
    per = per.withColumn("f1", _safe_div(2 * F.col("precision") * F.col("recall"),
                                         F.col("precision") + F.col("recall")))
    classes = per.select("row_name", "precision", "recall", "f1", F.col("support").cast("long"))
    tot = per.agg(F.sum("support").alias("n"), F.sum("tp").alias("tp"),
                  F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                  F.sum(F.col("precision") * F.col("support")).alias("wp"),
                  F.sum(F.col("recall") * F.col("support")).alias("wr"),
                  F.sum(F.col("f1") * F.col("support")).alias("wf"))
    summary = tot.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("row_name"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), _safe_div(F.col("tp"), F.col("n")).alias("f1"),
                 F.col("n").cast("long").alias("support")),
        _row("macro avg", F.col("mp"), F.col("mr"), F.col("mf"), F.col("n")),
        _row("weighted avg", _safe_div(F.col("wp"), F.col("n")), _safe_div(F.col("wr"), F.col("n")),
             _safe_div(F.col("wf"), F.col("n")), F.col("n")))).alias("r")).select("r.*")
    return classes.unionByName(summary)


def label_counts(df: DataFrame, col: str) -> DataFrame:
    """Counts per label, largest first."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), col)


def step_counts(**tables) -> DataFrame:
    """One row with the row count of each named step (one small job per table)."""
    names = list(tables)
    first = None
    for name in names:
        one = tables[name].select(F.lit(name).alias("step"))
        first = one if first is None else first.unionByName(one)
    agg = first.groupBy().pivot("step", names).count()
    return agg.select(*[F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in names])
