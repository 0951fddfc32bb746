"""Pairs from the published algorithm's description, plus the extensions."""

import pytest

from textsense.functions.porter import stem

PAIRS = {
    "caresses": "caress", "ponies": "poni", "ties": "tie", "caress": "caress", "cats": "cat",
    "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor",
    "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop",
    "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail",
    "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit",
    "rational": "ration", "valenci": "valenc", "hesitanci": "hesit", "digitizer": "digit",
    "differentli": "differ", "vileli": "vile", "analogousli": "analog", "vietnamization": "vietnam",
    "predication": "predic", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis",
    "hopefulness": "hope", "callousness": "callous", "formaliti": "formal", "sensitiviti": "sensit",
    "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form", "formalize": "formal",
    "electriciti": "electr", "electrical": "electr", "hopeful": "hope", "goodness": "good",
    "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin",
    "gyroscopic": "gyroscop", "adjustable": "adjust", "defensible": "defens", "irritant": "irrit",
    "replacement": "replac", "adjustment": "adjust", "dependent": "depend", "adoption": "adopt",
    "homologou": "homolog", "communism": "commun", "activate": "activ", "angulariti": "angular",
    "homologous": "homolog", "effective": "effect", "bowdlerize": "bowdler", "probate": "probat",
    "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "generously": "gener",
    "dying": "die", "lying": "lie", "skies": "sky", "news": "news", "is": "is", "as": "as",
}


@pytest.mark.parametrize("word, expected", sorted(PAIRS.items()))
def test_stem(word, expected):
    assert stem(word) == expected


def test_stem_column_matches_python(spark):
    from textsense.operators.stem import stem_tokens_col, stem_vocabulary
    df = spark.createDataFrame([(list(PAIRS),)], "t array<string>")
    assert df.select(stem_tokens_col("t")).first()[0] == [PAIRS[w] for w in PAIRS]
    voc = {r["token"]: r["stem"] for r in stem_vocabulary(df, "t").collect()}
    assert voc == PAIRS
