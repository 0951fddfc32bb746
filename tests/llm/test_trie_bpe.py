import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from textsense.llm import trie_bpe as B
from textsense.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    piece = lambda: rng.choice(["a", "aa", "aaaa", " ", "   ", "\n", "\t\t", "'s", "'LL", "<|endoftext|>", "<|endof", "123", "é", "中文", "😀",
                                "\x00", "\x1c", "\x85", " ", "====", "The", "ing", "İ", "ß", "½", chr(rng.randrange(1, 0x3000))])
    return ["".join(piece() for _ in range(rng.randrange(60))) for _ in range(n)]


def test_equals_library(library):
    texts = [*odd_texts(800), "", "x" * 5000, "ab" * 3000, " " * 300, "<|endoftext|><|endoftext|>"]
    codec = B.Codec(PATH)
    ids = [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert ids == want
    assert [codec.decode(np.array(i, "<u4").tobytes()) for i in want] == [library.decode(i, skip_special_tokens=False) for i in want]


def test_every_shared_prefix_is_encoded_as_alone():
    vocab = B.Vocabulary(PATH)
    words = sorted({w[:k] for w in (b"internationalisation", b"internment", b"in", b"zzzz") for k in range(1, len(w) + 1)})
    together = B.encode_words(vocab, words)
    assert together == [B.encode_words(vocab, [w])[0] for w in words]


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(B, "MAX_CACHED_BYTES", 1)
    codec = B.Codec(PATH)
    first = codec.encode(["some words here"])
    for _ in range(3):
        codec.encode(["others"])
    assert len(codec.cache.ids) == 1 and codec.encode(["some words here"]) == first


def test_frame_edges(texts, edge_rows, library):
    df = texts(edge_rows)
    got = B.encode_and_decode(df, "text", PATH, "bpe_ids", "bpe_text")
    assert got.columns[:len(df.columns)] == df.columns
    for r in got.collect():
        assert np.frombuffer(r["bpe_ids"], "<u4").tolist() == library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["bpe_text"] == (r["text"] or "")
    assert B.encode(texts([]), "text", PATH, "x").count() == 0
    clash = B.encode(df, "text", PATH)  # the new ids replace the column of that name
    assert clash.columns.count("ids") == 1 and dict(clash.dtypes)["ids"] == "binary"


def test_query(spark, library):
    rows = {r["doc_id"]: r for r in QUERIES["op5_trie_bpe"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        r = rows[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_every_code_point_is_cut_as_the_library_does():
    library = Tokenizer.from_file(PATH)
    codec = B.Codec(PATH)
    points = [c for c in range(0x323B0) if not 0xD800 <= c < 0xE000] + list(range(0xE0000, 0xE01F0))
    texts = [f"ab{chr(c)}'s {chr(c)}{chr(c)}1 {chr(c)} x" for c in points]
    for a in range(0, len(texts), 20_000):
        some = texts[a:a + 20_000]
        want = [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
        got = [np.frombuffer(x, "<u4").tolist() for x in codec.encode(some)]
        wrong = [hex(points[a + i]) for i in range(len(some)) if got[i] != want[i]]
        assert not wrong, wrong[:20]


class Counted(dict):
    gets = 0

    def get(self, *a):
        self.gets += 1
        return super().get(*a)


def test_walk_asks_the_vocabulary_once_a_state_not_once_a_slice(library):
    rng = random.Random(2)
    words = sorted({bytes(rng.choice(b"etaoinshr") for _ in range(rng.randrange(8, 13))) for _ in range(5000)})
    vocab = B.Vocabulary(PATH)
    B.encode_words(vocab, words)
    vocab.id_of = Counted(vocab.id_of)
    again = [w + b"s" for w in words]  # other words over the same letters
    got = B.encode_words(vocab, again)
    assert vocab.id_of.gets < sum(map(len, again)) // 10
    want = library.encode_batch([w.decode() for w in again[:300]], add_special_tokens=False)
    assert [np.frombuffer(x, "<u4").tolist() for x in got[:300]] == [e.ids for e in want]


def test_forgotten_states_change_nothing(monkeypatch):
    words = sorted({t.encode() for t in odd_texts(300, seed=4) if t and "<|" not in t})
    want = B.encode_words(B.Vocabulary(PATH), words)
    monkeypatch.setattr(B, "MAX_STEPS", 0)
    vocab = B.Vocabulary(PATH)
    assert [B.encode_words(vocab, [w])[0] for w in words] == want
    assert len(vocab.steps) <= len(words[-1])


def test_common_texts_are_cut_as_the_library_does():
    codec = B.Codec(PATH)
    rng = random.Random(6)
    points = [chr(c) for c in range(0x100) if not chr(c).encode().translate(None, B._COMMON)]
    piece = lambda: rng.choice([*points, " ", "  ", "\n", "'s", "'ll", "'S", " é", "12", "ab", "÷"])
    for _ in range(3000):
        text = "".join(piece() for _ in range(rng.randrange(30)))
        assert not text.encode().translate(None, B._COMMON)
        assert codec.cut(text) == [text[a:b] for _, (a, b) in codec.cutter.pre_tokenize_str(text)]
