"""Lexicon sentiment (ids D1-D3, D6, D9, B10).

D1 rule set, over the index tokens of a text (C11) and a lexicon table
``(term, polarity double nullable, intensity double, is_modifier boolean, is_negation boolean)``:

1. a word with a polarity ``p`` is one assessment worth ``p``;
2. a word right after a modifier ``m`` joins it in one assessment ``clamp(p * i_m)``;
3. a word right after a negation is worth ``p * -0.5``;
4. negation, modifier, word: ``clamp(p / i_m) * -0.5`` (0.7 after 1.3 after a negation -> -0.269);
5. a modifier with a polarity that is not followed by a scored word is its own assessment;
6. the polarity is the mean of the assessments, 0.0 when there are none, rounded to 3.

Physical plan: a lexicon of at most ``MAX_LITERAL_ROWS`` rows is embedded as a bucketed
constant lookup (``functions.lookup``), and every document is scored in place with array
functions -- no explode, no shuffle, all input columns kept. For a larger one the documents'
distinct tokens are joined with the lexicon and gathered back per document; on a stream, where
that would need state, tasks read the stored lexicon past each batch's distinct tokens. The
scoring expressions and the results are the same in all ways.

A term that is listed more than once counts as its greatest row: by polarity, then intensity,
modifier and negation flag (null is least).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..functions.lookup import LookupTable

LEXICON_SCHEMA = "term string, polarity double, intensity double, is_modifier boolean, is_negation boolean"


def _lexicon_rows(lexicon: DataFrame) -> DataFrame:
    """(term, p, i, m, g), one row for each term."""
    rows = lexicon.select(F.col("term"), F.col("polarity").cast("double").alias("p"),
                          F.col("intensity").cast("double").alias("i"),
                          F.coalesce(F.col("is_modifier"), F.lit(False)).alias("m"),
                          F.coalesce(F.col("is_negation"), F.lit(False)).alias("g")).where(F.col("term").isNotNull())
    return rows.groupBy("term").agg(F.max(F.struct("p", "i", "m", "g")).alias("v")).select("term", "v.*")


def _looked_up_in_batches(df: DataFrame, tokens: Column, lx: DataFrame, out: str) -> DataFrame:
    """Stateless form for a lexicon of any size: the lexicon is stored, and a task reads it, a
    piece at a time, for the rows of its batch's distinct tokens."""
    from ..session import shared_path
    path = shared_path(df.sparkSession, "lexicon")
    lx.write.parquet(path)
    df = df.withColumn(out, F.lit(None).cast("array<struct<p:double,i:double,m:boolean,g:boolean>>")).withColumn("__tok", tokens)
    schema = df.drop("__tok").schema
    uri = path if "://" in path else "file://" + path.removeprefix("file:")

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.dataset as ds
        from pyarrow import fs
        store, place = fs.FileSystem.from_uri(uri)
        lexicon = ds.dataset(place, filesystem=store, format="parquet")
        for batch in batches:
            toks = batch.column("__tok")
            flat = toks.flatten()
            wanted = pc.unique(flat)
            known = pa.Table.from_batches([b.filter(pc.is_in(b.column("term"), value_set=wanted))
                                           for b in lexicon.to_batches(columns=["term", "p", "i", "m", "g"], batch_size=1 << 16)],
                                          schema=pa.schema([("term", pa.string()), ("p", pa.float64()), ("i", pa.float64()),
                                                            ("m", pa.bool_()), ("g", pa.bool_())])).combine_chunks()
            values = pa.StructArray.from_arrays([known[c].combine_chunks() if known.num_rows else pa.array([], known.schema.field(c).type)
                                                 for c in ("p", "i", "m", "g")], names=["p", "i", "m", "g"])
            terms = known["term"].combine_chunks() if known.num_rows else pa.array([], pa.string())
            found = values.take(pc.index_in(flat, value_set=terms))
            size = pc.fill_null(pc.list_value_length(toks), 0).to_numpy(zero_copy_only=False)
            offsets = pa.array([0, *size.cumsum().tolist()], pa.int32())
            looked = pa.ListArray.from_arrays(offsets, found)
            yield pa.RecordBatch.from_arrays([looked if f.name == out else batch.column(f.name) for f in schema.fields],
                                             names=schema.names)
    return df.mapInArrow(run, schema)


def with_looked_up(df: DataFrame, tokens: Column, lexicon: DataFrame, out: str, max_rows: int | None = None) -> DataFrame:
    """Adds ``out``: array<struct(p, i, m, g)> aligned with ``tokens`` (null where unknown)."""
    lx = _lexicon_rows(lexicon)
    values = ["p", "i", "m", "g"]
    small = LookupTable.if_small(lx, "term", values, max_rows)
    if small is not None:
        return df.withColumn(out, looked_up(tokens, small))
    if df.isStreaming:
        return _looked_up_in_batches(df, tokens, lx, out)
    from ..session import materialize
    base = materialize(df.withColumn("__tok", tokens).withColumn("__uid", F.monotonically_increasing_id()))
    found = (base.select("__uid", F.explode(F.array_distinct("__tok")).alias("term"))
             .join(lx, "term")
             .groupBy("__uid").agg(F.map_from_entries(F.collect_list(F.struct("term", F.struct(*values)))).alias("__map")))
    return (base.join(found, "__uid", "left")
            .withColumn(out, F.transform("__tok", lambda t: F.col("__map")[t])).drop("__tok", "__uid", "__map"))


def _clamp(c: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))


def _divisor(i: Column) -> Column:
    return F.when(F.coalesce(i, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(i)


def _assessment(p: Column, m1: Column, i1: Column, g1: Column, g2: Column) -> Column:
    """Value of a scored word given the flags of the one/two words before it."""
    return (F.when(m1, F.when(g2, _clamp(p / _divisor(i1)) * -0.5)
                   .otherwise(_clamp(p * F.coalesce(i1, F.lit(1.0)))))
            .when(g1, p * -0.5)
            .otherwise(p))


def looked_up(tokens, table: LookupTable) -> Column:
    """array<struct(p, i, m, g)> aligned with the tokens (null where a token is unknown)."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.transform(tokens, lambda t: table.get(t))


def polarity_of_looked(looked) -> Column:
    """struct(s double, n int): sum and count of the assessments of a looked-up token array.

    ``looked`` must be a column reference (materialised once), since every element reads
    its neighbours from it."""
    looked = F.col(looked) if isinstance(looked, str) else looked

    def one(x, j):
        prev1, prev2, nxt = F.get(looked, j - 1), F.get(looked, j - 2), F.get(looked, j + 1)
        m1 = F.coalesce(prev1["m"], F.lit(False))
        g1 = F.coalesce(prev1["g"], F.lit(False))
        g2 = F.coalesce(prev2["g"], F.lit(False))
        merged_into_next = F.coalesce(x["m"], F.lit(False)) & nxt["p"].isNotNull()
        anchor = x["p"].isNotNull() & ~merged_into_next
        return F.when(anchor, _assessment(x["p"], m1, prev1["i"], g1, g2))

    # one pass over the assessments: (sum, count) of the non-null ones
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"))
    return F.aggregate(F.transform(looked, one), zero,
                       lambda acc, v: F.when(v.isNull(), acc).otherwise(
                           F.struct((acc["s"] + v).alias("s"), (acc["n"] + 1).alias("n"))))


def polarity_from_sum(acc) -> Column:
    """Mean of the assessments rounded to 3 (0.0 when there are none)."""
    acc = F.col(acc) if isinstance(acc, str) else acc
    return F.when(acc["n"] > 0, T.round3(acc["s"] / acc["n"], is_average=True)).otherwise(F.lit(0.0))


def with_lexicon_polarity(df: DataFrame, col: str, lexicon: DataFrame,
                          out: str = "polarity", n_out: str | None = None) -> DataFrame:
    """D1 as columns on ``df`` (narrow: every input row and column kept, no shuffle)."""
    df = (with_looked_up(df, T.index_tokens(col), lexicon, "__lk")
            .withColumn("__lex", polarity_of_looked("__lk"))
            .withColumn(out, polarity_from_sum("__lex")))
    if n_out:
        df = df.withColumn(n_out, F.col("__lex.n"))
    return df.drop("__lex", "__lk")


def lexicon_polarity(df: DataFrame, key, col: str, lexicon: DataFrame) -> DataFrame:
    """(key..., polarity, n)."""
    keys = [key] if isinstance(key, str) else list(key)
    return with_lexicon_polarity(df.select(*keys, col), col, lexicon, "polarity", "n").select(
        *keys, "polarity", "n")


def lexicon_polarity_exploded(df: DataFrame, key: str, col: str, lexicon: DataFrame) -> DataFrame:
    """D1 in join + window form: an independent second form that tests compare with."""
    toks = (df.select(key, F.posexplode_outer(T.index_tokens(col)).alias("pos", "tok"))
              .where(F.col("tok").isNotNull()))
    lex = _lexicon_rows(lexicon).withColumnRenamed("term", "tok")
    j = toks.join(lex, "tok", "left")
    w = Window.partitionBy(key).orderBy("pos")
    j = (j.withColumn("m1", F.coalesce(F.lag("m", 1).over(w), F.lit(False)))
          .withColumn("g1", F.coalesce(F.lag("g", 1).over(w), F.lit(False)))
          .withColumn("g2", F.coalesce(F.lag("g", 2).over(w), F.lit(False)))
          .withColumn("i1", F.lag("i", 1).over(w))
          .withColumn("pn", F.lead("p", 1).over(w)))
    a = (j.where(F.col("p").isNotNull() & ~(F.coalesce("m", F.lit(False)) & F.col("pn").isNotNull()))
          .select(key, _assessment(F.col("p"), F.col("m1"), F.col("i1"), F.col("g1"), F.col("g2")).alias("v")))
    agg = a.groupBy(key).agg(F.avg("v").alias("avg_v"), F.count("*").cast("int").alias("n"))
    return (df.select(key).join(agg, key, "left")
            .select(key, F.coalesce(T.round3(F.col("avg_v"), True), F.lit(0.0)).alias("polarity"),
                    F.coalesce("n", F.lit(0)).alias("n")))


def lexicon_sentiment(df: DataFrame, key, col: str, lexicon: DataFrame) -> DataFrame:
    """D3: (key..., polarity, sentiment) with the sign label taken on the rounded score."""
    keys = [key] if isinstance(key, str) else list(key)
    out = with_lexicon_polarity(df.select(*keys, col), col, lexicon)
    return out.select(*keys, "polarity", T.sign_label("polarity").alias("sentiment"))


def bulk_score(df: DataFrame, col: str, engine: str = "lexicon", lexicon: DataFrame | None = None,
               model=None, display: bool = True) -> DataFrame:
    """Every input row and column plus ``Sentiment`` and the engine's score column
    (``Polarity_Score`` for the lexicon engine, ``Confidence`` for the trained model)."""
    if engine == "lexicon":
        if lexicon is None:
            raise ValueError("the lexicon engine needs a lexicon table")
        out = with_lexicon_polarity(df, col, lexicon, out="Polarity_Score")
        label = T.sign_label("Polarity_Score")
        return out.withColumn("Sentiment", T.display_label(label) if display else label).select(
            *df.columns, "Sentiment", "Polarity_Score")
    if engine == "model":
        from .classify import model_sentiment
        if model is None:
            raise ValueError("the model engine needs a trained model (train first)")
        return model_sentiment(df, col, model, display=display)
    raise ValueError(f"unknown engine {engine!r}")
