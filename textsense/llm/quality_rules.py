"""Quality rules on divergence from a language's usual text, with DataFrame expressions only.

A document's histograms of character classes and of common words are compared with its
language's reference by the Jensen-Shannon distance (base 2, 0 to 1). The references are sums
over all long enough documents of a language: one row per listed language plus one for all
others, so they are a few literals in the second pass. Documents are never shuffled.

Short texts have noisy histograms, so each test has a minimum length, below which it leaves a
text alone, and a limit that falls with the root of the length. Base rules (too few words, too many repeated five-word windows) come
first.

Defined results: a null text has no words and fails the base rule; a language that is null or
not listed is compared with the reference of all such documents and has no common-word test; a
language without a long enough document has no reference and rejects nothing; repeated rows
each get their row; extra columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, keep_where, stored
from .decontaminate import covered

# Word and line rules of the base counts.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SYMBOL = r"[^#*$%&|<>]+"
WINDOW = 5
CLASSES = ("lower", "upper", "digit", "stop", "symbol")
#: Very common words of each listed language; a parameter of every function here.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "it", "was", "for", "on"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "ist", "des", "ein"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por"],
}
OTHER = "other"


@dataclass(frozen=True)
class Rules:
    """Thresholds. Distances of clean prose stay far below the limits; see the README."""

    min_words: int = 10              # base: fewer words fail
    max_repeat_pct: int = 20         # base: more repeated words (percent) fail
    min_class_chars: int = 200       # class test needs that many characters in words
    class_distance: float = 0.22     # limit for an endless text ...
    class_noise: float = 1.5         # ... plus this over the root of the characters
    min_common_words: int = 100      # common-word test needs that many words
    common_distance: float = 0.20
    common_noise: float = 1.0        # over the root of the words


def _window_hashes(w: Column) -> Column:
    n = F.size(w)
    return F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, F.lit(WINDOW))))) \
        .otherwise(F.array().cast("array<bigint>"))


def _sorted_windows(h: Column) -> Column:
    """(hash, position) in order where some hash is repeated, else null."""
    return F.when(F.size(F.array_distinct(h)) < F.size(h),
                  F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))


def _covered_by_repeats(pairs: Column) -> Column:
    """Words inside windows whose hash is found twice or more: in order, such a window has an
    equal neighbour. ``pairs`` must be a plain column, as each step reads it."""
    spans = F.filter(F.transform(pairs, lambda x, i: F.struct(
        x["i"].alias("s"), (x["i"] + WINDOW).alias("e"),
        (F.coalesce(F.get(pairs, i - 1)["h"] == x["h"], F.lit(False))
         | F.coalesce(F.get(pairs, i + 1)["h"] == x["h"], F.lit(False))).alias("twice"))), lambda x: x["twice"])
    return F.coalesce(covered(F.array_sort(spans)), F.lit(0)).cast("long")


def _language(lang: Column | None, common: dict) -> Column:
    if lang is None:
        return F.lit(OTHER)
    return F.when(lang.isin(list(common)), lang).otherwise(F.lit(OTHER))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, text_col: str, lang_col: str | None, common: dict | None = None,
            base: bool = True) -> tuple[DataFrame, dict]:
    """Add the measures as columns and return their names: n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words (the last two null unless ``base``), language, classes (counts
    by CLASSES) and common (counts by the language's list, then all other words).

    Plain columns, not a struct: the optimiser would copy a struct's costly fields into every
    expression that reads them."""
    common = COMMON_WORDS if common is None else common
    m = {k: free_name(docs, f"qr_{k}") for k in (*COUNTS, "language", "classes", "common")}
    w, rest, h, up, known, lst = (free_name(docs, f"qr_tmp_{k}") for k in "wrhukl")
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.withColumn(w, F.array_remove(F.split(text, SPACE, -1), "")) \
             .withColumn(rest, F.regexp_replace(text, r"[\p{L}\x20\x09-\x0D]+", ""))
    if base:
        df = df.withColumn(h, _window_hashes(F.col(w)))
        lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        df = df.withColumn(lst, lines)
        dup_lines = (F.size(lst) - F.size(F.array_distinct(lst))).cast("long")
        df = df.withColumn(h, _sorted_windows(F.col(h))).withColumn(m["n_dup_lines"], dup_lines) \
               .withColumn(m["n_repeat_words"], _covered_by_repeats(F.col(h))).drop(lst, h)
    else:
        df = df.withColumn(m["n_dup_lines"], F.lit(None).cast("long")) \
               .withColumn(m["n_repeat_words"], F.lit(None).cast("long"))
    r = F.col(rest)

    def left(pattern, of=r):
        return F.length(F.regexp_replace(of, pattern, ""))

    every = sorted({x for words in common.values() for x in words})
    df = (df.withColumn(m["n_words"], F.size(w).cast("long"))
          .withColumn(m["word_chars"], F.length(F.array_join(w, "")).cast("long"))
          .withColumn(m["n_symbols"], left(NOT_SYMBOL).cast("long"))
          .withColumn(m["language"], _language(F.col(lang_col) if lang_col else None, common))
          .withColumn(up, F.array(left(r"[^\p{Lu}]+", text), left(r"\P{Nd}+"), left(r"[^.,;:!?'\"()\-]+"), F.length(r)))
          .withColumn(known, F.filter(F.transform(w, lambda x: F.lower(x)), lambda x: x.isin(every))))
    u = [F.get(F.col(up), F.lit(k)) for k in range(4)]
    df = df.withColumn(m["classes"], F.array(F.col(m["word_chars"]).cast("int") - u[3] - u[0], u[0], u[1], u[2],
                                             u[3] - u[1] - u[2]).cast("array<double>"))
    lang = F.col(m["language"])
    by_lang = None
    for name, words in common.items():
        c = F.transform(F.array(*[F.lit(x) for x in words]), lambda b: F.size(F.filter(F.col(known), lambda x: x == b)))
        by_lang = F.when(lang == name, c) if by_lang is None else by_lang.when(lang == name, c)
    none = F.array().cast("array<int>")
    df = df.withColumn(lst, by_lang.otherwise(none) if by_lang is not None else none)
    df = df.withColumn(m["common"], F.concat(F.col(lst), F.array(F.size(w) - F.aggregate(lst, F.lit(0), lambda a, x: a + x)))
                       .cast("array<double>"))
    return df.drop(w, rest, up, known, lst), m


def references(measured: DataFrame, m: dict, rules: Rules, common: dict | None = None) -> dict:
    """language -> (class shares, common-word shares) over all long enough documents: one
    partly aggregated group-by whose result has a row per listed language and one more."""
    common = COMMON_WORDS if common is None else common
    width = 1 + max([len(v) for v in common.values()], default=0)
    c = {k: F.col(v) for k, v in m.items()}
    sums = [F.sum(F.get(c["classes"], F.lit(k))).alias(f"a{k}") for k in range(len(CLASSES))] + \
           [F.sum(F.get(c["common"], F.lit(k))).alias(f"b{k}") for k in range(width)]
    long_enough = (c["n_words"] >= rules.min_common_words) & (c["word_chars"] >= rules.min_class_chars)
    rows = measured.where(long_enough).groupBy(c["language"].alias("language")).agg(*sums).collect()
    out = {}
    for r in rows:
        a = [r[f"a{k}"] for k in range(len(CLASSES))]
        b = [r[f"b{k}"] for k in range(1 + len(common.get(r["language"], [])))]
        out[r["language"]] = ([x / sum(a) for x in a], [x / sum(b) for x in b])
    return out


def js_distance(counts: Column, shares: list[float]) -> Column:
    """Jensen-Shannon distance (root of the divergence in bits) of a count array's shares and
    ``shares``; 0 for an empty histogram."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    ref = F.array(*[F.lit(float(x)) for x in shares])

    def term(x, mid):
        return F.when(x > 0, x * F.log2(x / mid)).otherwise(0.0)

    parts = F.zip_with(F.transform(counts, lambda x: x / F.greatest(total, F.lit(1.0))), ref,
                       lambda p, q: term(p, (p + q) / 2) + term(q, (p + q) / 2))
    div = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / 2
    return F.when(total > 0, F.sqrt(F.greatest(div, F.lit(0.0)))).otherwise(0.0)


def verdict(measured: DataFrame, m: dict, refs: dict, rules: Rules) -> tuple[DataFrame, dict]:
    """Add class_distance, common_distance, base_failed, kept; returns the names too."""
    c = {k: F.col(v) for k, v in m.items()}
    names = m | {k: free_name(measured, f"qr_{k}") for k in ("class_distance", "common_distance", "base_failed", "kept")}
    by_class = by_word = None
    for lang, (a, b) in sorted(refs.items()):
        x, y = js_distance(c["classes"], a), (js_distance(c["common"], b) if len(b) > 1 else F.lit(0.0))
        by_class = F.when(c["language"] == lang, x) if by_class is None else by_class.when(c["language"] == lang, x)
        by_word = F.when(c["language"] == lang, y) if by_word is None else by_word.when(c["language"] == lang, y)
    zero = F.lit(0.0)
    df = measured.withColumn(names["class_distance"], zero if by_class is None else by_class.otherwise(zero)) \
                 .withColumn(names["common_distance"], zero if by_word is None else by_word.otherwise(zero)) \
                 .withColumn(names["base_failed"], (c["n_words"] < rules.min_words)
                             | (100 * c["n_repeat_words"] > rules.max_repeat_pct * c["n_words"]))

    def odd_by(n, least, distance, limit, noise):
        return (c[n] >= least) & (F.col(names[distance]) > limit + noise / F.sqrt(c[n]))

    odd = odd_by("word_chars", rules.min_class_chars, "class_distance", rules.class_distance, rules.class_noise) | \
        odd_by("n_words", rules.min_common_words, "common_distance", rules.common_distance, rules.common_noise)
    return df.withColumn(names["kept"], ~F.col(names["base_failed"]) & ~odd), names


def keep(docs: DataFrame, text_col: str, lang_col: str | None, rules: Rules = Rules(), common: dict | None = None) -> DataFrame:
    """The documents that pass, columns unchanged. Every text is measured once: the documents are
    written with their measures, the references are summed from these, then each is judged."""
    measured, m = measure(docs, text_col, lang_col, common)
    measured = stored(measured, "measured")
    judged, names = verdict(measured, m, references(measured, m, rules, common), rules)
    return keep_where(judged, F.col(names["kept"])).select(*[F.col(f"`{x}`") for x in docs.columns])
