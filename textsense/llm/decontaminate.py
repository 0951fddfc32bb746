"""Benchmark decontamination with DataFrame expressions only.

The benchmark's texts are cut into windows of ``n`` normalised words. A set of window hashes
travels with the plan; every document's word windows are probed against it in the row, a hash
match is verified on the words themselves, and the spans that matched are removed, or the
documents. Documents are neither shuffled nor exploded.

The set is sent along only up to ``max_windows`` windows and as many item ids (checked bounds). A larger benchmark
goes through an equi-join of window hashes that Spark plans by the sizes it finds. Both ways
give the same rows.

Defined results: a null text has no words; null ids stay null; an item with a null id taints
words but is not named among the items; an item with fewer than ``n`` words (but some) is one
window; repeated items count once, repeated documents each get their row; an empty benchmark
taints nothing; extra columns of the documents pass through unchanged.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, keep_where, stored

N_WORDS = 13
MAX_WINDOWS = 50_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# What lies between words once A-Z are lower-cased; words and gaps before that.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone. lower() does just that where no other letter has a lower case; it
    is much cheaper than translate(), which handles the rest: texts with another capital, or with
    a character of a script in which Unicode versions differ on what is one."""
    other = c.rlike(r"[\p{javaUpperCase}\p{javaTitleCase}&&[^A-Z]]|[^\x00-\u052f\u2000-\u2063\u20a0-\u20bf\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]")
    plain = F.octet_length(c) == F.length(c)  # ASCII alone, as most texts are
    return F.when(plain, F.lower(c)).when(other, F.translate(c, _UPPER, _LOWER)).otherwise(F.lower(c))


def words(c: Column) -> Column:
    """Array of normalised words (null: no words). Splitting at the gaps is several times
    faster than extracting the words; a gap at either end leaves an empty piece."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(c, F.lit(""))), GAP, -1), "")


def benchmark_windows(bench: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(win_len, win_hash, win_text, items): distinct windows with the sorted ids, as text."""
    w = (bench.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w"))
         .where(F.size("w") > 0).withColumn("len", F.least(F.size("w"), F.lit(n)))
         .select("item", "len", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("i"))
         .select("item", F.col("len").alias("win_len"), F.slice("w", F.col("i"), F.col("len")).alias("w")))
    return (w.groupBy("win_len", F.array_join("w", " ").alias("win_text"),
                      F.xxhash64("w").alias("win_hash"), _ends_hash(F.get("w", F.lit(0)), F.get("w", F.size("w") - 1)).alias("ends_hash"))
            .agg(F.array_sort(F.collect_set("item")).alias("items")))


def _ends_hash(first: Column, last: Column) -> Column:
    return F.xxhash64(first, last)


def _starts(size: Column, length: int) -> Column:
    """1-based starts of all windows of ``length`` words."""
    return F.when(size >= length, F.sequence(F.lit(1), F.greatest(size - (length - 1), F.lit(1)))) \
        .otherwise(F.array().cast("array<int>"))


def _hits_of_length(w: str, length: int, rows: list) -> Column:
    n_buckets = 1 << max(1, (len(rows) // 2).bit_length())
    table: list[list] = [[] for _ in range(n_buckets)]
    for r in rows:
        table[r["win_hash"] % n_buckets].append({"h": r["win_hash"], "t": r["win_text"], "i": list(r["items"])})
    lookup = F.from_json(F.lit(json.dumps(table)), "array<array<struct<h:bigint,t:string,i:array<string>>>>")
    hashes, ends = [r["win_hash"] for r in rows], sorted({r["ends_hash"] for r in rows})

    def probe(i):
        return F.xxhash64(F.slice(F.col(w), i, F.lit(length)))

    def ends_probe(i):
        return _ends_hash(F.get(F.col(w), i - 1), F.get(F.col(w), i + (length - 2)))

    def verified(i):
        text = F.array_join(F.slice(F.col(w), i, F.lit(length)), " ")
        own = F.filter(F.get(lookup, F.pmod(probe(i), F.lit(n_buckets)).cast("int")), lambda x: x["t"] == text)
        return F.transform(own, lambda x: F.struct((i - 1).cast("int").alias("s"), (i - 1 + length).cast("int").alias("e"),
                                                   x["i"].alias("items")))

    # two cheap words first; only where a window of the benchmark has both, the n-gram's hash
    found = F.filter(_starts(F.size(w), length), lambda i: ends_probe(i).isin(ends) & probe(i).isin(hashes))
    return F.flatten(F.transform(found, verified))


def _hits_in_row(w: str, windows: list) -> Column:
    """Array of (s, e, items) of the verified hits in array column ``w``, in order of s."""
    by_len: dict[int, list] = {}
    for r in windows:
        by_len.setdefault(r["win_len"], []).append(r)
    parts = [_hits_of_length(w, length, rows) for length, rows in sorted(by_len.items())]
    if not parts:
        return F.array().cast("array<struct<s:int,e:int,items:array<string>>>")
    return F.array_sort(F.concat(*parts)) if len(parts) > 1 else parts[0]


def _hits_by_join(df: DataFrame, w: str, windows: DataFrame, lengths: list, out: str) -> DataFrame:
    """The same column through an equi-join on the window hash, for benchmarks of any size."""
    uid = free_name(df, "row_uid")
    base = stored(df.withColumn(uid, F.monotonically_increasing_id()), "decontaminate")
    def probed(length):
        window = lambda i: F.slice(F.col(w), i, F.lit(length))
        each = F.transform(_starts(F.size(w), length), lambda i: F.struct(
            i.alias("i"), F.xxhash64(window(i)).alias("h"), F.array_join(window(i), " ").alias("t")))
        return base.select(uid, F.explode(each).alias("p")).select(
            uid, F.lit(length).alias("win_len"), "p.i", F.col("p.h").alias("win_hash"), F.col("p.t").alias("win_text"))

    probes = None
    for length in lengths:
        probes = probed(length) if probes is None else probes.unionByName(probed(length))
    hits = (probes.join(windows, ["win_len", "win_hash", "win_text"])
            .groupBy(uid).agg(F.array_sort(F.collect_list(F.struct(
                (F.col("i") - 1).cast("int").alias("s"), (F.col("i") - 1 + F.col("win_len")).cast("int").alias("e"),
                "items"))).alias(out)))
    return (base.join(hits, uid, "left").drop(uid)
            .withColumn(out, F.coalesce(F.col(out), F.array().cast("array<struct<s:int,e:int,items:array<string>>>"))))


def find_hits(docs: DataFrame, text_col: str, bench: DataFrame, bench_id: str, bench_text: str,
              n: int = N_WORDS, max_windows: int = MAX_WINDOWS, prefix: str = "dc") -> tuple[DataFrame, str, str]:
    """Add two columns to ``docs``: the words and the verified hits, an array of
    (s, e, items): 0-based word span [s, e) and the ids that have the window. Returns the
    frame and the two names."""
    w = free_name(docs, f"{prefix}_w")
    out = free_name(docs, f"{prefix}_hits")
    found = stored(benchmark_windows(bench, bench_id, bench_text, n), "windows")
    base = docs.withColumn(w, words(F.col(text_col)))
    # a window may belong to many items: their ids count as well
    held = found.agg(F.count(F.lit(1)).alias("windows"), F.coalesce(F.sum(F.size("items")), F.lit(0)).alias("ids")).first()
    if max(held["windows"], held["ids"]) <= max_windows:
        return base.withColumn(out, _hits_in_row(w, found.collect())), w, out
    lengths = [r[0] for r in found.select("win_len").distinct().orderBy("win_len").collect()]  # at most n
    return _hits_by_join(base, w, found, lengths, out), w, out


def covered(hits: Column) -> Column:
    """Number of words inside any of the spans (sorted by start)."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        hits, zero,
        lambda a, h: F.struct((a["n"] + F.greatest(F.lit(0), h["e"] - F.greatest(h["s"], a["end"]))).alias("n"),
                              F.greatest(a["end"], h["e"]).alias("end")),
        lambda a: a["n"])


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least one word in twenty lies in a benchmark window."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def report(docs: DataFrame, id_col: str, text_col: str, bench: DataFrame, bench_id: str, bench_text: str,
           n: int = N_WORDS, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Per document: id, n_words, n_hit, items (sorted ids as text), contaminated, spans."""
    found, w, hits = find_hits(docs.select(id_col, text_col), text_col, bench, bench_id, bench_text, n, max_windows)
    out = found.select(
        F.col(id_col), F.size(w).cast("long").alias("n_words"), covered(F.col(hits)).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda h: h["items"])))).alias("items"),
        F.transform(hits, lambda h: F.struct(h["s"].alias("s"), h["e"].alias("e"))).alias("spans"))
    return out.withColumn("contaminated", is_contaminated(F.col("n_hit"), F.col("n_words")))


def remove_documents(docs: DataFrame, text_col: str, bench: DataFrame, bench_id: str, bench_text: str,
                     n: int = N_WORDS, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``docs`` without the contaminated rows, columns unchanged."""
    found, w, hits = find_hits(docs, text_col, bench, bench_id, bench_text, n, max_windows)
    n_hit = free_name(found, "dc_n")
    return (keep_where(found.withColumn(n_hit, covered(F.col(hits))), ~is_contaminated(F.col(n_hit), F.size(w))).select(*[F.col(f"`{c}`") for c in docs.columns]))


def remove_spans(docs: DataFrame, text_col: str, bench: DataFrame, bench_id: str, bench_text: str,
                 n: int = N_WORDS, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``docs`` with every hit word, and the separators right after it, cut out of the text."""
    found, w, hits = find_hits(docs, text_col, bench, bench_id, bench_text, n, max_windows)
    t = F.col(text_col)
    parts = F.regexp_extract_all(t, F.lit(WORD_ANY_CASE + SEPARATOR), F.lit(0))
    rest = F.filter(parts, lambda p, i: ~F.exists(F.col(hits), lambda h: (i >= h["s"]) & (i < h["e"])))
    cut = F.concat(F.regexp_extract(t, "^" + SEPARATOR, 0), F.array_join(rest, ""))
    return (found.withColumn(text_col, F.when(F.size(hits) > 0, cut).otherwise(t))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
