"""Column expressions for cleaning, tokenising and formatting text (ids B3-B5, B8, B9, C1-C7,
C9-C14).

Everything here is a built-in Spark expression (regexes are Java regexes, arrays use
higher-order functions), so it stays inside the JVM and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# ---------------------------------------------------------------------------------------
# Fixed values (must equal the reference behaviour)
# ---------------------------------------------------------------------------------------

# Python's str whitespace set (what `\s`, `str.split()` and `str.strip()` use on text),
# spelled out because Java's `\s` is ASCII-only.
WS_CLASS = (r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
# Python's Unicode `\w` (letters, numbers, underscore).
WORD_CLASS = r"\p{L}\p{N}_"

URL_PATTERN = rf"http[^{WS_CLASS}]+|www[^{WS_CLASS}]+|https[^{WS_CLASS}]+"
MENTION_PATTERN = rf"@[{WORD_CLASS}]+"
HASH_PATTERN = "#"
NON_LETTER_PATTERN = rf"[^A-Za-z{WS_CLASS}]+"  # runs: same result as one char at a time
# The same runs with the ranges spelled out: Java takes several times longer over the negated class.
NON_LETTER_RANGES = (r"[\x00-\x08\x0E-\x1B\x21-\x40\x5B-\x60\x7B-\x84\x86-\x9F\xA1-\x{167F}\x{1681}-\x{1FFF}"
                     r"\x{200B}-\x{2027}\x{202A}-\x{202E}\x{2030}-\x{205E}\x{2060}-\x{2FFF}\x{3001}-\x{10FFFF}]+")
TOKEN_PATTERN = rf"[^{WS_CLASS}]+"
INDEX_TOKEN_PATTERN = rf"[{WORD_CLASS}]{{2,}}"
STRIP_PATTERN = rf"^[{WS_CLASS}]+|[{WS_CLASS}]+$"

# English stop words (the widely published 179-word list the reference's cleaner uses).
# Entries with an apostrophe can never match a cleaned token, so only the others matter.
STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours "
    "yourself yourselves he him his himself she she's her hers herself it it's its itself "
    "they them their theirs themselves what which who whom this that that'll these those "
    "am is are was were be been being have has had having do does did doing a an the and "
    "but if or because as until while of at by for with about against between into "
    "through during before after above below to from up down in out on off over under "
    "again further then once here there when where why how all any both each few more "
    "most other some such no nor not only own same so than too very s t can will just "
    "don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn "
    "didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn "
    "mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren "
    "weren't won won't wouldn wouldn't"
).split()

# Display labels of the app (plain label -> label shown to the user).
DISPLAY_LABELS = {"positive": "Positive 😊", "negative": "Negative 😠", "neutral": "Neutral 😐"}
UNTITLED_SOURCE = "Untitled Source"
# Older app: marks in front of the upper-case label.
DISPLAY_V1_MARKS = {"positive": "😊", "negative": "❌", "neutral": "😐", "other": "❓"}

# ---------------------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# B3 ------------------------------------------------------------------------------------
def text_or_empty(col) -> Column:
    """Null (or any non-string) -> text; null becomes the empty string, never 'nan'."""
    return F.coalesce(_c(col).cast("string"), F.lit(""))


# B4 / C14 ------------------------------------------------------------------------------
def strip_ws(col) -> Column:
    """Strip leading/trailing whitespace, Python-style (newlines and Unicode spaces too)."""
    return F.regexp_replace(_c(col), STRIP_PATTERN, "")


def non_blank(col) -> Column:
    """True when the text holds something other than whitespace."""
    return F.coalesce(F.length(strip_ws(col)) > 0, F.lit(False))


# B5 ------------------------------------------------------------------------------------
def prefix(col, n: int) -> Column:
    """First ``n`` characters (code points)."""
    return F.substring(_c(col), 1, n)


# C1-C5 ---------------------------------------------------------------------------------
def strip_urls(col) -> Column:
    """Delete http…/www…/https… runs; case-sensitive and also inside words."""
    return F.regexp_replace(_c(col), URL_PATTERN, "")


def strip_mentions(col) -> Column:
    """Delete @ followed by word characters."""
    return F.regexp_replace(_c(col), MENTION_PATTERN, "")


def strip_hash(col) -> Column:
    """Delete '#' and keep the word."""
    return F.regexp_replace(_c(col), HASH_PATTERN, "")


def letters_only(col) -> Column:
    """C4: keep ASCII letters and whitespace; nothing is replaced by a space."""
    return F.regexp_replace(_c(col), NON_LETTER_RANGES, "")


def lower_text(col) -> Column:
    """C5."""
    return F.lower(_c(col))


def normalise(col) -> Column:
    """C1-C5 in order, null -> ''."""
    return lower_text(letters_only(strip_hash(strip_mentions(strip_urls(text_or_empty(col))))))


# C6, C7, C9 ----------------------------------------------------------------------------
def ws_tokens(col) -> Column:
    """Split on runs of whitespace; no empty tokens."""
    return F.regexp_extract_all(_c(col), F.lit(TOKEN_PATTERN), 0)


def drop_stop_words(tokens, words=None) -> Column:
    """Drop stop words, keeping duplicates and order (a hash-set test per token)."""
    words = list(STOP_WORDS if words is None else words)
    return F.filter(_c(tokens), lambda t: ~t.isin(*words))


def join_tokens(tokens) -> Column:
    """C9."""
    return F.array_join(_c(tokens), " ")


def normalised_tokens(col) -> Column:
    """After C4/C5 only a-z and whitespace are left, so the whitespace tokens are
    exactly the runs of a-z (a much cheaper pattern than the full whitespace class)."""
    return F.regexp_extract_all(normalise(col), F.lit("[a-z]+"), 0)


def clean_tokens(col) -> Column:
    """Cleaned, stop-word-free tokens (no stemming)."""
    return drop_stop_words(normalised_tokens(col))


def clean_text(col) -> Column:
    """C10 without the stemmer: C1-C7 then C9."""
    return join_tokens(clean_tokens(col))


# C11, C12 ------------------------------------------------------------------------------
def index_tokens(col) -> Column:
    """C11: lower-case, then runs of two or more word characters (the index tokeniser)."""
    return F.regexp_extract_all(F.lower(text_or_empty(col)), F.lit(INDEX_TOKEN_PATTERN), 0)


def ngrams(tokens, lo: int = 1, hi: int = 2) -> Column:
    """N-grams from ``lo`` to ``hi`` words joined by one space, shorter ones first.

    Pass a column reference: each n-gram reads its neighbours from ``tokens``, so an
    expression here would be re-evaluated per element."""
    w = _c(tokens)

    def gram(n):
        # n-gram starting at element x (index i): x and the n-1 elements after it
        return lambda x, i: F.concat_ws(" ", x, *[F.get(w, i + j) for j in range(1, n)])

    parts = []
    for n in range(lo, hi + 1):
        if n == 1:
            parts.append(w)
            continue
        count = F.greatest(F.size(w) - (n - 1), F.lit(0))
        parts.append(F.transform(F.slice(w, 1, count), gram(n)))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


# C13 -----------------------------------------------------------------------------------
def sources_json(col) -> Column:
    """Encode a list of source names as JSON text; null -> '[]'."""
    return F.coalesce(F.to_json(_c(col)), F.lit("[]"))


def parse_sources(col) -> Column:
    """Decode JSON text to array<string>; null, empty or '[]' -> empty array."""
    return F.coalesce(F.from_json(F.nullif(strip_ws(col), F.lit("")), "array<string>"),
                      F.array().cast("array<string>"))


# C14 -----------------------------------------------------------------------------------
def title_or_default(col) -> Column:
    return F.coalesce(F.nullif(_c(col), F.lit("")), F.lit(UNTITLED_SOURCE))


# B8, B9, D2 ----------------------------------------------------------------------------
def round3(col, is_average: bool = False) -> Column:
    """Three-decimal rounding. Averages get a 1e-9 nudge away from zero so float
    summation order cannot flip a tie."""
    c = _c(col)
    if is_average:
        c = c + F.signum(c) * F.lit(1e-9)
    return F.round(c, 3)


def sign_label(score) -> Column:
    """D2 on an already-rounded score: >0 positive, <0 negative, else neutral."""
    s = _c(score)
    return F.when(s > 0, "positive").when(s < 0, "negative").otherwise("neutral")


def display_label(label) -> Column:
    """Plain label -> display label; anything unknown -> neutral."""
    lab = F.lower(_c(label))
    out = F.lit(DISPLAY_LABELS["neutral"])
    return (F.when(lab == "positive", DISPLAY_LABELS["positive"])
            .when(lab == "negative", DISPLAY_LABELS["negative"]).otherwise(out))


def explode_structs(df, keep: list, arr: str):
    """Rows of an array<struct> column next to the ``keep`` columns.

    ``inline_outer`` + a null filter instead of ``inline``: for an inner generator Catalyst
    infers a ``size(arr) > 0`` filter and pushes it below the projections, which would inline
    (and re-run per element) the array-building expressions."""
    first = df.schema[arr].dataType.elementType.fieldNames()[0]
    return df.select(*keep, F.inline_outer(arr)).where(F.col(first).isNotNull())


def display_prediction_v1(label, confidence) -> Column:
    """B8, older app form: '<mark> Predicted Sentiment: LABEL (Confidence: 0.87)' for the three
    known classes, '❓ Predicted Label: <raw> (Confidence: ...)' for anything else."""
    lab = _c(label)
    conf = F.format_string("%.2f", _c(confidence))
    known = F.concat(F.lit(" Predicted Sentiment: "), F.upper(lab), F.lit(" (Confidence: "), conf, F.lit(")"))
    low = F.lower(lab)
    return (F.when(low == "positive", F.concat(F.lit(DISPLAY_V1_MARKS["positive"]), known))
            .when(low == "negative", F.concat(F.lit(DISPLAY_V1_MARKS["negative"]), known))
            .when(low == "neutral", F.concat(F.lit(DISPLAY_V1_MARKS["neutral"]), known))
            .otherwise(F.concat(F.lit(DISPLAY_V1_MARKS["other"] + " Predicted Label: "), lab,
                                F.lit(" (Confidence: "), conf, F.lit(")"))))
