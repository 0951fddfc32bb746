"""The Java regexes of C1-C7 and C11 against Python's `re` on random text: Unicode spaces,
marks, digits, accents, URLs, mentions. (Python's `\\s`/`\\w` are Unicode; Java's are ASCII,
so the classes are spelled out in functions/text.py.)"""

import random
import re


from textsense.functions import text as T

ALPHABET = (list("abcXYZ019_'.-/:?!") + [" ", " ", "\t", "\n", "\r", "\x0b", "\x0c", "\x1c", "\x85", "\xa0",
            " ", "　", "​", "é", "Ü", "ß", "ç", "ñ", "œ", "€", "́", "٣", "²", "日", "ö"]
            + ["http", "https://", "www.", "HTTP", "@", "@bo", "#", "#tag"])


def py_clean(text):
    t = re.sub(r"http\S+|www\S+|https\S+", "", text)
    t = re.sub(r"@\w+", "", t)
    t = t.replace("#", "")
    t = re.sub(r"[^A-Za-z\s]", "", t)
    words = [w for w in t.lower().split() if w not in set(T.STOP_WORDS)]
    return " ".join(words)


def py_index_tokens(text):
    return re.findall(r"(?u)\b\w\w+\b", text.lower())


def test_random_text_matches_python_re(spark):
    rnd = random.Random(11)
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 40))) for _ in range(600)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = {r["i"]: (r["c"], r["k"]) for r in df.select(
        "i", T.clean_text("t").alias("c"), T.index_tokens("t").alias("k")).collect()}
    bad_clean = [texts[i] for i in got if got[i][0] != py_clean(texts[i])]
    bad_tok = [texts[i] for i in got if got[i][1] != py_index_tokens(texts[i])]
    assert not bad_clean, bad_clean[:3]
    assert not bad_tok, bad_tok[:3]
