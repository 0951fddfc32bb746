import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from textsense.llm import wavelet as V
from textsense.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n,top", [(0, 8), (1, 8), (7, 2), (3000, 300), (5000, 60000), (513, 1)])
def test_matrix(n, top):
    rng = np.random.default_rng(n)
    x = np.minimum(rng.zipf(1.3, n), top).astype(np.uint16)
    width = int(top).bit_length()
    m = V.WaveletMatrix.from_bytes(memoryview(V.WaveletMatrix.build(x, width).to_bytes()))
    assert (m.values() == x).all() and (m.access(np.arange(n)) == x).all()
    for v in [*np.unique(x)[:6].tolist(), top, 1 << width]:
        assert m.count(v) == (x == v).sum() and m.count(v, n // 3, n // 2) == (x[n // 3:n // 2] == v).sum()
        assert m.find(v).tolist() == np.flatnonzero(x == v).tolist()


def test_tokens_equal_library():
    library = Tokenizer.from_file(PATH)
    rng = random.Random(3)
    piece = lambda: rng.choice(["a", "THE", " ", "\n", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "12", "é", "é", "Σ", "ΑΣ", "İ",
                                "中文", "😀", "½", "\x85", "==", "ǅ", "ﬁ", chr(rng.randrange(1, 0x3000))])
    texts = ["".join(piece() for _ in range(rng.randrange(50))) for _ in range(800)] + ["", " ", "word" * 2000]
    tok = V.WordTokenizer(PATH)
    assert [np.frombuffer(x, tok.dtype).tolist() for x in tok.encode(texts)] == \
        [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def expected(docs):
    library, at, out = Tokenizer.from_file(PATH), 0, []
    for i, t in docs:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_files(spark, texts, edge_rows):
    docs = sorted([*edge_rows, *[(k, f"document number {k} " * (k % 7)) for k in range(100, 160)]], key=lambda d: (d[0] is not None, d[0]))
    path, files = V.write(texts(docs), "doc_id", "text", PATH, file_tokens=200)
    assert files.count() > 5
    rows = V.read(spark, path, files).collect()
    got = sorted([(r["id"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in rows], key=lambda r: r[1])
    assert got == expected(docs)
    path, files = V.write(texts([]), "doc_id", "text", PATH)
    assert V.read(spark, path, files).count() == 0


def test_query(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    rows = QUERIES["op7_wavelet_files"](spark, SF).collect()
    assert sorted(map(tuple, rows)) == expected(docs)


def test_texts_cut_together_equal_the_library():
    library = Tokenizer.from_file(PATH)
    rng = random.Random(5)
    common = ["a", "THE ", " ", "\n", "'s", "'LL", "12", "é", "É", "ÀB ", "ß", "×", "Ÿ", "=="]
    rare = ["<|endoftext|>", "<|", "\x1c", "\x85", "\xa0", "Σ", "中文", "e\u0301", "😀"]
    texts = ["".join(rng.choice(common if k % 3 else common + rare) for _ in range(rng.randrange(40))) for k in range(600)] + ["", None, " ", ""]
    tok = V.WordTokenizer(PATH)
    for some in (texts, texts[:1], [""], [None, None], ["😀"], ["a"]):
        assert [np.frombuffer(x, tok.dtype).tolist() for x in tok.encode_together(some)] == \
            [e.ids for e in library.encode_batch([t or "" for t in some], add_special_tokens=False)]


def test_files_are_smaller_than_raw_ids():
    rng = np.random.default_rng(1)
    share = 1 / np.arange(1, 40_001) ** 1.1
    x = rng.choice(40_000, 400_000, p=share / share.sum()).astype(np.uint16)
    data = V.WaveletMatrix.build(x, 16).to_bytes()
    assert len(data) / len(x) < 2
    m = V.WaveletMatrix.from_bytes(memoryview(data))
    assert (m.access(np.arange(0, len(x), 997)) == x[::997]).all() and m.count(3) == (x == 3).sum()


@pytest.mark.parametrize("n,top,width", [(0, 8, 4), (1, 1, 1), (64, 9, 4), (1000, 60000, 16), (777, 100_000, 17)])
def test_planes_ordered_in_blocks(n, top, width, monkeypatch):
    rng = np.random.default_rng(n)
    x = rng.integers(0, top, n).astype(np.uint16 if width <= 16 else np.uint32)
    kept, whole = x.copy(), V.WaveletMatrix.build(x, width)
    monkeypatch.setattr(V, "BLOCK", 64)
    m = V.WaveletMatrix.from_bytes(memoryview(V.WaveletMatrix.build(x, width).to_bytes()))
    assert (x == kept).all() and m.zeros == whole.zeros
    assert all((m.plane(p) == whole.plane(p)).all() for p in range(width))
    assert (m.values() == x).all() and (m.access(np.arange(n)) == x).all()


def test_frequent_runs_are_learnt_once(monkeypatch):
    monkeypatch.setattr(V, "MAX_RUNS", 3)
    tok, learnt, ids = V.WordTokenizer(PATH), [], V.WordTokenizer._ids
    monkeypatch.setattr(V.WordTokenizer, "_ids", lambda self, words: [learnt.extend(words), ids(self, words)][1])
    library = Tokenizer.from_file(PATH)
    for k in range(6):
        text = f"often alsooften rare{chr(97 + k) * 5} seldom{chr(97 + k) * 4}, \u00c9T\u00c9"
        got = tok.encode_together([text])[0]
        assert np.frombuffer(got, tok.dtype).tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(tok.runs.number) + len(tok.old_runs.number) <= 12
    assert learnt.count("often") == learnt.count("alsooften") == 1 and len(learnt) == 4 + 2 * 6


def test_planes_take_no_more_room_than_before():
    import zlib as z
    rng = np.random.default_rng(2)
    share = 1 / np.arange(1, 40_001) ** 1.1
    m = V.WaveletMatrix.build(rng.choice(40_000, 300_000, p=share / share.sum()).astype(np.uint16), 16)
    assert sum(len(m._deflated(m.plane(p))) for p in range(16)) <= sum(len(z.compress(m.plane(p), 1)) for p in range(16))


def test_files_are_written_from_small_batches(spark, texts):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    V.write(texts([(1, "one two")]), "doc_id", "text", PATH)
    assert spark.conf.get(key) == "2m"
    spark.conf.unset(key)
