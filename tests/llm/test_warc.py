import base64
import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from elastrain.llm import warc
from elastrain.session import fresh_path

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "p", 1) for i, u, h in rows], "page_id bigint, url string, html string, payload string, n int")


def expected(rows, min_bytes=0):
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(last.get(h or "", i), i)
    groups = [h or "" for _, _, h in rows]
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        sha1 = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        same = groups.count(h or "") > 1 and len(raw) >= min_bytes and (h or "") in last
        refers = last[h or ""] if same and last[h or ""] != i else None
        out.append((i, len(raw), sha1, "revisit" if refers is not None else "response", refers))
    return sorted(out, key=str)


def found(spark, path):
    number = lambda c: F.regexp_extract(c, "<urn:page:(-?[0-9]+)>", 1).try_cast("bigint")
    rows = warc.read_warc(spark, path).select("*", number("record_id").alias("page"), number("refers_to").alias("to")).collect()
    for r in rows:
        if r.type == "response":
            assert r.payload_digest == "sha1:" + base64.b32encode(hashlib.sha1(r.payload).digest()).decode()
    return sorted(((r.page, r.http_length, r.payload_digest[5:], r.type, r.to) for r in rows), key=str)


def test_round_trip(spark):
    draw = random.Random(1)
    bodies = [None, "", "a", "é\r\n\r\nx", FAKE, FAKE * 3, "WARC/1.0\r\n", "x" + FAKE[:40], "WAWARC/1.0\r\nWARC/1.0\r", "long " * 60_000, "\n", "\r\n\r\n"]
    rows = [(i, draw.choice([None, f"http://a/{i}", "bad\r\nurl: x"]), draw.choice(bodies)) for i in range(80)]
    rows += [(7, "u", "twice"), (7, "u", "twice"), (None, "u", "no id")]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "7000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            for least in (0, 3):
                path = fresh_path(spark, "warc-test")
                warc.write_warc(pages(spark, rows).coalesce(2), path, min_bytes=least)
                assert found(spark, path) == expected(rows, least)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_no_rows(spark):
    path = fresh_path(spark, "warc-test")
    warc.write_warc(pages(spark, []), path)
    assert warc.read_warc(spark, path).count() == 0


def test_nothing_follows_a_broken_record(spark):
    path = fresh_path(spark, "warc-test")
    good = FAKE
    spark.createDataFrame([(good + good.replace("Content-Length: 3", "Content-Length: 30") + good,)], "value string").coalesce(1).write.text(path)
    assert warc.read_warc(spark, path).count() == 1


def test_pointer_jumping():
    start = np.array([0, 10, 14, 30, 35, 50])
    successor = np.array([30, 14, 30, 50, 50, 60])
    assert warc.reached(start, successor).tolist() == [True, False, False, True, False, True]
    chain = np.arange(0, 5000, 5)
    assert warc.reached(chain, chain + 5).all()
    assert warc.reached(np.array([], np.int64), np.array([], np.int64)).tolist() == []
    assert not warc.reached(chain[1:], chain[1:] + 5).any()
