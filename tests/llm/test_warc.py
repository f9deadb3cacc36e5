import gzip
import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from docmill.llm import warc
from docmill.llm.common import shared_dir


def brute(rows):
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[(h or "").encode()].append(i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        ids = [x for x in groups[b] if x is not None]
        revisit = len(b) >= 100 and len(groups[b]) > 1 and bool(ids) and i != min(ids)
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", min(ids) if revisit else None))
    return sorted(map(repr, out))


ROWS = [(i, f"http://a.example.com/{i % 7}", "x" * 200 if i % 3 == 0 else "y" * 99 if i % 3 == 1 else f"{i}é" * 60) for i in range(900)]
ROWS += [(5, "http://b.c/\r\nx", None), (5, "http://b.c/\r\nx", None), (None, None, "z" * 300), (None, "u", "z" * 300), (None, None, "x" * 200), (-3, "http://A.B/é", "x" * 200), (0, "http://q/", "x" * 200), (-3, "http://A.B/é", "x" * 200), (9999, "http://long/", "<p>" * 200_000)]


def stored(spark, rows, name):
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, digest string")
    folder = f"{shared_dir(spark)}/{name}"
    shards = warc.write(spark, df, folder)
    return df.select(warc.url_key(F.col("url")).alias("key"), "page_id"), shards, folder


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_ENTRIES", 7)
    wanted, shards, folder = stored(spark, ROWS, "round")
    got = warc.read(spark, shards, wanted, folder).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(ROWS)
    assert warc.read(spark, shards, wanted.where("page_id = -3"), folder).count() == 2
    assert warc.read(spark, shards, wanted.select(F.lit("no such key").alias("key"), "page_id"), folder).count() == 0


def test_files_are_warc(spark):
    _, shards, folder = stored(spark, ROWS[:10], "files")
    row = shards.first()
    store, _ = warc._store(folder)
    raw = gzip.decompress(store.open_input_file(row.archive).read())
    assert raw.startswith(b"WARC/1.1\r\n") and raw.count(b"WARC/1.1\r\n") == row.n
    fields, body = warc.parse(raw)
    assert fields["warc-payload-digest"] == "sha256:" + hashlib.sha256(body).hexdigest() or fields["warc-type"] == "revisit"


def test_no_rows(spark):
    wanted, shards, folder = stored(spark, [], "none")
    assert shards.count() == 0 and warc.read(spark, shards, wanted, folder).count() == 0


def test_keys(spark):
    urls = ["http://WWW.Example.com/a?b#c", "x://h", None, "plain", "http://h/\r\n"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(warc.url_key(F.col("u")).alias("k")).collect()
    assert [r.k for r in got] == ["com,example,www)/a?b#c", "h)", "", "plain", "h)/%%"]
