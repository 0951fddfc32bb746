"""The question-answering request flow as one batch job (id G6).

Order of the app: blank filter -> rate limiter -> lexicon sentiment of the question ->
answer cache -> retrieval + prompt -> log row. The limiter runs before the cache, so cache
hits still use quota. The remote model call is outside (not built); its prompt is produced.

Requests carry their question's integer id; retrieval, sentiment and prompt are made once per
distinct question text and joined back on that id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..session import stored
from . import limits as LIM
from . import prompts as P
from .lexicon import with_lexicon_polarity
from .retrieve import Index, retrieve


# Fixed value: the cache key's format.
def cache_key(query, use_rag: bool, top_k: int, use_web: bool, web_k: int):
    """The app's cache key: question + every setting that changes the answer."""
    q = F.col(query) if isinstance(query, str) else query
    return F.concat(q, F.lit(f"|rag={use_rag}|k={top_k}|web={use_web}|wk={web_k}"))


def run_requests(reqs: DataFrame, session: str, ts: str, id_col: str, question: str, questions: DataFrame,
                 q_id: str, q_text: str, index: Index | None, docs: DataFrame | None, doc_key: str, doc_text: str,
                 lexicon: DataFrame, max_n: int = 10, window_s: float = 60, use_rag: bool = True, top_k: int = 3,
                 use_web: bool = False, web_k: int = 3, use_cache=True) -> DataFrame:
    """One row per request: (id, session, ts, status, sentiment, score, hit, sources, prompt).
    ``status`` is ``answered``, ``rate_limited`` or ``blank`` (the last two have nulls after it).

    ``reqs`` names its question by id (column ``question``; an unknown id is blank);
    ``questions`` has the texts. Only ids, keys and times go through the limiter; each question
    is scored, retrieved for and made into a prompt once."""
    on = use_cache if isinstance(use_cache, Column) else F.lit(bool(use_cache))
    # questions with equal text share their answers, as the cache key is made of the text
    texts = questions.select(F.col(q_id).alias("__qid"), F.col(q_text).alias("__q")).where(T.non_blank("__q"))
    same = texts.groupBy("__q").agg(F.min("__qid").alias("__same"))
    texts = stored(texts.join(same, "__q"), "questions")
    r = reqs.select(id_col, session, ts, on.alias("__on"), F.col(question).alias("__qid")) \
            .join(texts.select("__qid", "__same"), "__qid", "left").drop("__qid")
    asked = r.where(F.col("__same").isNotNull())
    # read by three branches: written once
    limited = stored(LIM.rate_limit(asked, session, ts, id_col, max_n, window_s), "limited")
    admitted = limited.where("admitted").drop("admitted")
    admitted = LIM.cache_hits(admitted, session, "__same", ts, id_col, "__on").drop("__on")
    distinct = texts.where(F.col("__qid") == F.col("__same")).select("__same", "__q")
    scored = with_lexicon_polarity(distinct, "__q", lexicon, out="score")
    scored = scored.withColumn("sentiment", T.display_label(T.sign_label("score"))).drop("__q")
    ctx = None
    if use_rag and index is not None:
        ctx = P.context_block(retrieve(distinct, "__same", "__q", index, top_k), docs, doc_key, doc_text)
    answers = P.build_prompts(distinct, "__same", "__q", ctx, None, use_rag, use_web) \
        .select(F.col("query_id").alias("__same"), "sources", "prompt")
    answered = admitted.join(scored.join(answers, "__same"), "__same").withColumn("status", F.lit("answered"))
    columns = [id_col, session, ts, "status", "sentiment", "score", "hit", "sources", "prompt"]
    rejected = limited.where("not admitted").withColumn("status", F.lit("rate_limited"))
    blank = r.where(F.col("__same").isNull()).withColumn("status", F.lit("blank"))
    out = answered.select(*columns)
    return out.unionByName(rejected.select(*columns[:4]), allowMissingColumns=True) \
              .unionByName(blank.select(*columns[:4]), allowMissingColumns=True)


def log_turns(flow: DataFrame, questions: DataFrame, q_id: str, q_text: str, reqs: DataFrame, question: str,
              id_col: str, ts: str, answer: str = "") -> DataFrame:
    """The answered requests as chat-log rows for A6 (``files.append_turns``)."""
    asked = reqs.select(id_col, F.col(question).alias("__qid")).join(
        questions.select(F.col(q_id).alias("__qid"), F.col(q_text).alias("user_msg")), "__qid")
    return flow.where("status = 'answered'").join(asked, id_col).select(
        F.col(id_col).alias("id"), F.timestamp_micros(LIM.epoch_micros(flow, ts)).alias("created_at"), "user_msg", F.lit(answer).alias("bot_msg"),
        "sentiment", "score", "sources")
