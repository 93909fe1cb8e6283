import hashlib
import io
import random
import struct

import pytest
import zstandard

from palimpsest.llm import warc
from palimpsest.llm.warc import WarcError, op9_warc, parse, read_archive, record, train_dictionary, write_archive


def sha(b):
    return hashlib.sha1(b).hexdigest()


def archive(records, dictionary=b""):
    out = io.BytesIO()
    write_archive(out, records, dictionary)
    return out.getvalue()


def samples(n=60):
    r = random.Random(3)
    return [("<html>" + " ".join(r.choice(["eau", "the", "<p>", "und", "casa"]) + str(r.randrange(50)) for _ in range(300))).encode() for _ in range(n)]


@pytest.mark.parametrize("trained", [False, True])
def test_round_trip(trained):
    pages = [*samples(), b"", b"\r\n\r\n", b"x" * 300_000, "é\0".encode()]
    records = [record(i, f"http://a/{i}", p, sha(p)) for i, p in enumerate(pages)]
    dictionary = train_dictionary(records, 4096) if trained else b""
    data = archive(records, dictionary)
    if trained:
        assert struct.unpack_from("<I", data)[0] == warc.DICT_MAGIC
    assert [x.payload for x in read_archive(io.BytesIO(data))] == pages
    if trained:  # as the format allows, the dictionary itself may be compressed
        small = zstandard.ZstdCompressor().compress(dictionary)
        again = struct.pack("<II", warc.DICT_MAGIC, len(small)) + small + data[8 + len(dictionary) :]
        assert [x.payload for x in read_archive(io.BytesIO(again))] == pages


def test_what_is_wrong_is_found():
    p = b"payload"
    good = record(1, "http://a/", p, sha(p))
    assert parse(good).payload == p
    for bad in [good[1:], good[:-1], good + b"x", good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"WARC-Type", b"WARC Type :"), good.replace(b"payload", b"pAyload"), good.replace(b"Content-Length: 7\r\n", b"Content-Length: 8\r\n"), good.replace(b"WARC-Date", b"WARC-Day"), good.replace(b"HTTP/1.1", b"GOPHER/1")]:
        with pytest.raises(WarcError):
            list(read_archive(io.BytesIO(archive([good, bad]))))
    data = archive([good, good])
    for cut in (data[:-3], data[: len(data) // 2 + 5], data + b"garbage!"):
        with pytest.raises(WarcError):
            list(read_archive(io.BytesIO(cut)))
    with pytest.raises(WarcError):
        list(read_archive(io.BytesIO(struct.pack("<II", warc.DICT_MAGIC, 100) + b"abc")))


def test_a_revisit_has_no_payload():
    x = parse(record(3, None, b"p" * 2000, sha(b"p" * 2000), 9, True))
    assert x.payload == b"" and x.http[b"content-length"] == b"2000" and x.fields[b"warc-type"] == b"revisit" and x.fields[b"refers-to-page-id"] == b"9"


def test_query(spark, sf_dir):
    big, other = "<p>é" * 400, "<b>z" * 300
    pages = [(i, f"http://h/{i}", f"<html>{i} " + "word " * (i % 400)) for i in range(300)]
    pages += [(1000 + i, "http://h/big", big) for i in range(90)] + [(2000, None, other), (2001, "u\r\nv", other), (2001, "u", other), (None, "n", other), (3000, "x", None), (3001, "x", ""), (3002, "x", "a" * 999), (3003, "x", "a" * 999), (None, "solo", "q" * 1500), (3004, "y", "a" * 1000), (3005, "y", "a" * 1000), (3006, "long", "lo ng" * 400_000)]
    frame = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, digest string")
    out = sorted(map(str, (tuple(x) for x in op9_warc(spark, sf_dir(pages=frame)).collect())))
    top = {}
    for k, _, h in pages:
        top[h or ""] = max(top.get(h or "", -1), -1 if k is None else k)
    want = []
    for k, _, h in pages:
        b = (h or "").encode()
        again = len(b) >= 1000 and (-1 if k is None else k) != top[h or ""]
        want.append((k, len(b), sha(b), "revisit" if again else "response", top[h or ""] if again else None))
    assert out == sorted(map(str, want))
    assert op9_warc(spark, sf_dir(pages=frame.limit(0))).count() == 0


def test_pages_without_ids_keep_their_payload(spark, sf_dir):
    rows = [(None, "a", "n" * 1200), (None, "b", "n" * 1200), (None, "c", "m" * 1200), (5, "d", "m" * 1200)]
    out = op9_warc(spark, sf_dir(pages=spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    kinds = sorted((x[1], x[2], x[3], x[4]) for x in out if x[3] == "response")
    assert kinds == sorted([(1200, sha(b"n" * 1200), "response", None)] * 2 + [(1200, sha(b"m" * 1200), "response", None)])


@pytest.mark.parametrize("pages", [[(1, "u", "short")], [(i, "u", "same text " * 9) for i in range(40)], [(1, "u", "long " * 9000)]])
def test_small_archives_have_a_dictionary(spark, tmp_path, pages):
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    for x in warc.write_archives(frame, f"file://{tmp_path}/w").collect():
        with open(x.path, "rb") as f:
            data = f.read()
        assert struct.unpack_from("<I", data)[0] == warc.DICT_MAGIC and len(list(read_archive(io.BytesIO(data)))) == x.records


def test_the_sample_is_small_and_the_same(spark):
    frame = spark.createDataFrame([(i % 3000, "u", "p" * (i % 50)) for i in range(6000)] + [(None, "u", "n")] * 3000, "page_id long, url string, html string")
    a = warc.dictionary_sample(frame)
    assert 100 < len(a) <= warc.SAMPLE_PAGES and a == warc.dictionary_sample(frame.repartition(7)) and len(set(a)) == len(a)
