import base64
import hashlib

from textsense.llm import warc_chain as C


def expected(rows):
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        last = max(same, default=None)
        revisit = last is not None and len(same) + sum(j is None and (g or "") == (h or "") for j, _, g in rows) > 1 and (i is None or i < last)
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
                    "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, id int")


def test_round_trip_with_records_inside_payloads(spark):
    fake = C.page_record(777, "http://x", b"not a page", 10, "AAAA", None).decode()
    rows = [(k, f"http://e.org/{k}", f"<p>{k}</p>") for k in range(40)]
    rows += [(100, "u", fake), (101, "u", f"WARC/1.1\r\n{fake}WARC/1.1\r\n"), (102, "é \r\nX: 1", fake * 3), (103, None, None), (104, "", ""),
             (105, "c", "same"), (106, "c", "same"), (107, "c", "same"), (107, "c", "same"), (None, "n", "same"), (None, "n", "own"),
             (108, "l", "long " * 40_000), (109, "t", "WARC/1.1\r\n"), (110, "t", "\r\n\r\n")]
    got = C.round_trip(frame(spark, rows), "page_id", "url", "html").collect()
    assert sorted(map(tuple, got), key=repr) == expected(rows)


def test_candidates_inside_payloads_are_proposed_and_rejected(spark):
    fake = C.page_record(777, "http://x", b"x", 1, "AAAA", None).decode()
    path, files = C.write(frame(spark, [(1, "u", fake + fake), (2, "u", "b")]), "page_id", "url", "html")
    found = C.candidates(spark, path)
    assert found.where("id = 777").count() == 2
    assert sorted(r["id"] for r in C.read(spark, path).collect()) == [1, 2]


def test_many_small_files_and_least_bytes(spark):
    rows = [(k, "u", "ab" if k % 2 else f"page {k}") for k in range(60)]
    path, files = C.write(frame(spark, rows), "page_id", "url", "html", min_bytes=3, file_bytes=2000)
    assert files.count() > 5
    got = C.read(spark, path).collect()
    assert len(got) == 60 and {r["record_type"] for r in got} == {"response"}


def test_empty(spark):
    assert C.round_trip(frame(spark, []), "page_id", "url", "html").count() == 0


def test_reachable(spark):
    links = [(1, a, a + 10) for a in range(0, 1000, 10)] + [(1, 5, 15), (1, 15, 25), (2, 7, 9), (3, 0, 4)]
    df = spark.createDataFrame(links, "file bigint, at bigint, next bigint")
    got = sorted(map(tuple, C.reachable(df).collect()))
    assert got == [(1, a) for a in range(0, 1000, 10)] + [(3, 0)]
