"""D1, second form: literal rules, a plain left-to-right reading as brute force, large lexicons."""

import random
import re

import pytest

from textsense.functions import lookup
from textsense.operators import lexicon as L
from textsense.operators.lexicon_carry import with_carried_polarity

ROWS = [("good", 0.7, 1.0, False, False), ("bad", -0.5, 1.0, False, False), ("very", 0.2, 1.3, True, False),
        ("really", None, 1.5, True, False), ("not", None, 1.0, False, True), ("thing", None, 1.0, False, False)]


@pytest.fixture(scope="module")
def lex(spark):
    return spark.createDataFrame(ROWS, L.LEXICON_SCHEMA)


CASES = [
    ("good", 0.7, 1), ("not good", -0.35, 1), ("not a good day", -0.35, 1), ("not so good", 0.7, 1),
    ("really is a good day", 1.0, 1), ("really the good", 0.7, 1), ("not very good", -0.269, 1),
    ("not a very good", -0.269, 1), ("very is good", 0.91, 1), ("very thing good", 0.45, 2), ("very", 0.2, 1),
    ("really not good", -0.35, 1), ("good!", 0.875, 1), ("good!!!", 1.0, 1), ("bad! good", 0.038, 2),
    ("not! good", -0.35, 1), ("!", 0.0, 0), ("", 0.0, 0), (None, 0.0, 0), ("NOT Good", -0.35, 1),
    ("not thing good", 0.7, 1), ("very very good", 0.91, 1),
]


def brute(text):
    clamp = lambda v: max(-1.0, min(1.0, v))
    known = {r[0]: r[1:] for r in ROWS}
    values, own, g, i = [], False, False, None
    for w in re.findall(r"\w+|!", (text or "").lower()):
        p, intensity, m, neg = known.get(w, (None, None, False, False))
        if w == "!":
            values[-1:] = [clamp(v * 1.25) for v in values[-1:]]
        elif p is not None:
            v = (clamp(p / i) * -0.5 if g else clamp(p * i)) if i is not None else p * -0.5 if g else p
            values = (values[:-1] if own and i is not None else values) + [v]
            own, g, i = m, (g if m else neg), (intensity if m else None)
        elif m:
            own, i = False, intensity
        elif neg:
            own, g, i = False, True, None
        else:
            if len(w) > 1:
                g = False
            if len(w) > 2:
                own, i = False, None
    return sum(values) / len(values) if values else 0.0, len(values)


def test_rules(spark, lex):
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(CASES)], "k long, t string")
    for r in with_carried_polarity(df, "t", lex, n_out="n").collect():
        text, polarity, n = CASES[r["k"]]
        assert r["polarity"] == pytest.approx(polarity) and r["n"] == n, text
        assert abs(brute(text)[0] - polarity) <= 5.1e-4 and brute(text)[1] == n, text


@pytest.mark.parametrize("literal", [True, False])
def test_equals_a_plain_reading(spark, lex, monkeypatch, literal):
    if not literal:  # the lexicon is joined with the texts' words
        monkeypatch.setattr(lookup, "MAX_LITERAL_ROWS", 2)
    rng = random.Random(3)
    words = [r[0] for r in ROWS] + ["a", "is", "the", "word", "!"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30))), "x") for k in range(300)]
    rows.append((300, " ".join(rng.choice(words) for _ in range(20_000)), "x"))  # a very long text
    out = with_carried_polarity(spark.createDataFrame(rows, "k long, t string, n string"), "t", lex, "score", "found")
    assert out.columns == ["k", "t", "n", "score", "found"]
    got = {r["k"]: r for r in out.collect()}
    assert len(got) == len(rows)
    for k, t, _ in rows:
        value, n = brute(t)
        assert abs(got[k]["score"] - value) <= 5.1e-4 and got[k]["found"] == n, t[:200]


def test_empty_table(spark, lex):
    assert with_carried_polarity(spark.createDataFrame([], "k long, t string"), "t", lex).count() == 0
