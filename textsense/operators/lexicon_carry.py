"""Lexicon polarity, second form (id D1): modifiers and negations reach over short words, and an
exclamation mark strengthens what was said last.

Rules over the lower-cased words (of any length) and ``!`` of a text, read from left to right, with the
lexicon table of ``operators.lexicon``:

1. a word with a polarity ``p`` opens an assessment: ``p``, after a modifier ``m`` ``clamp(p * i_m)``,
   after a negation ``p * -0.5``, after both ``clamp(p / i_m) * -0.5``;
2. a negation waits for a scored word over words of one letter and over modifiers; it forgets a
   modifier before it;
3. a modifier waits over words of one or two letters; a modifier with a polarity is an
   assessment of its own until a scored word takes it up;
4. any longer word without an entry ends the waiting; a scored word that is no modifier ends it too;
5. each ``!`` multiplies the last assessment by 1.25, clamped to [-1, 1]; it ends no waiting;
6. the polarity is the mean of the assessments, 0.0 when there are none, rounded to 3.

Null and empty texts have polarity 0.0 and no assessments; an entry that is neither scored nor a
modifier nor a negation counts as a word without an entry; terms listed more than once as in
``operators.lexicon``.

Physical plan: one ``aggregate`` over the looked-up words inside the row, with a state of fixed
size: no explode, no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from .lexicon import _clamp, _divisor, polarity_from_sum, with_looked_up

WORD_PATTERN = rf"[{T.WORD_CLASS}]+|!"
MARK = "!"
BOOST = 1.25
NEGATION_GAP = 1  # letters of the longest word that a negation reaches over
MODIFIER_GAP = 2  # and a modifier

STATE = "struct<s:double,n:int,v:double,own:boolean,g:boolean,i:double>"


def words_and_marks(col) -> Column:
    """Lower-cased words and exclamation marks in order."""
    return F.regexp_extract_all(F.lower(T.text_or_empty(col)), F.lit(WORD_PATTERN), F.lit(0))


def _step(a: Column, x: Column) -> Column:
    """State after ``x``: closed sum ``s``, number ``n`` and last value ``v`` of the assessments,
    ``own``: the last one is a modifier's that may be taken up; ``g``, ``i``: what waits."""
    state = lambda s, n, v, own, g, i: F.struct(
        s.alias("s"), n.alias("n"), v.alias("v"), own.alias("own"), g.alias("g"), i.alias("i")).cast(STATE)
    yes, no, none = F.lit(True), F.lit(False), F.lit(None).cast("double")
    scored, modifier, negation = x["p"].isNotNull(), F.coalesce(x["m"], no), F.coalesce(x["g"], no)
    p, i = x["p"], a["i"]
    value = (F.when(i.isNotNull(), F.when(a["g"], _clamp(p / _divisor(i)) * -0.5).otherwise(_clamp(p * i)))
             .when(a["g"], p * -0.5).otherwise(p))
    waits = F.when(modifier, F.coalesce(x["i"], F.lit(1.0)))
    taken = a["own"] & i.isNotNull()
    louder = F.when(a["v"].isNotNull(), _clamp(a["v"] * BOOST))  # (least and greatest skip nulls)
    return (F.when(x["mark"], state(a["s"], a["n"], louder, a["own"], a["g"], i))
            .when(scored, state(F.when(taken, a["s"]).otherwise(a["s"] + F.coalesce(a["v"], F.lit(0.0))),
                                F.when(taken, a["n"]).otherwise(a["n"] + 1), value, modifier,
                                F.when(modifier, a["g"]).otherwise(negation), waits))
            .when(modifier, state(a["s"], a["n"], a["v"], no, a["g"] | negation, waits))
            .when(negation, state(a["s"], a["n"], a["v"], no, yes, none))
            .otherwise(state(a["s"], a["n"], a["v"], a["own"] & (x["len"] <= MODIFIER_GAP),
                             a["g"] & (x["len"] <= NEGATION_GAP), F.when(x["len"] <= MODIFIER_GAP, i))))


def with_carried_polarity(df: DataFrame, col: str, lexicon: DataFrame, out: str = "polarity", n_out: str | None = None) -> DataFrame:
    """Adds the polarity (and the number of assessments) to ``df``; every row and column stays."""
    d = with_looked_up(df.withColumn("__words", words_and_marks(col)), F.col("__words"), lexicon, "__lk")
    items = F.zip_with("__words", "__lk", lambda w, x: F.struct(
        (w == MARK).alias("mark"), F.length(w).alias("len"), x["p"].alias("p"), x["i"].alias("i"),
        x["m"].alias("m"), x["g"].alias("g")))
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"), F.lit(None).alias("v"), F.lit(False).alias("own"),
                    F.lit(False).alias("g"), F.lit(None).alias("i")).cast(STATE)
    total = lambda a: F.struct((a["s"] + F.coalesce(a["v"], F.lit(0.0))).alias("s"), a["n"].alias("n"))
    d = d.withColumn("__sum", F.aggregate(items, zero, _step, total)).withColumn(out, polarity_from_sum("__sum"))
    if n_out:
        d = d.withColumn(n_out, F.col("__sum.n").cast("long"))
    return d.drop("__words", "__lk", "__sum")
