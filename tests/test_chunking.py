import random
import re

from pyspark.sql import functions as F

from docmill.operators.chunking import chunks, pack, smart_chunk


def brute_pack(units, most, joiner):
    out, held, n = [], [], 0
    for u in units:
        if held and n + len(u) > most:
            out.append(joiner.join(held))
            held, n = held[-1:], len(held[-1])
        held, n = [*held, u], n + len(u)
    return out + ([joiner.join(held)] if held else [])


def brute_chunks(text, most):
    if len(text) <= most:
        return [text]
    units = []
    for p in (p.strip() for p in re.split("\n\n+", text)):
        if p:
            units += [p] if len(p) <= most else brute_pack(re.split("(?<=[。！？；\n])", p), most, "")
    return [c for c in brute_pack(units, most, "\n\n") if c.strip()]


def test_packs_equal_a_plain_fold(spark):
    r = random.Random(1)
    rows = [(i, ["é" * r.randrange(14) for _ in range(r.choice([0, 1, 2, 5, 40, 900]))]) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, u array<string>")
    for most in (1, 8, 50):
        got = dict(df.select("i", pack(F.col("u"), most, "|")).collect())
        assert all(got[i] == brute_pack(u, most, "|") for i, u in rows)


def test_very_long_texts_are_cut_in_time(spark):
    """A copied accumulator took a minute for the second text and hours for the first."""
    rows = [(0, "abcdefg hi\n\n" * 150_000), (1, "ab. cd。\n" * 50_000), (2, "\n" * 50_000 + "x"), (3, ""), (4, None), (5, "x" * 50_000)]
    df = spark.createDataFrame(rows, "i int, text string")
    got = dict(df.select("i", smart_chunk(F.col("text"), 20)).collect())
    for i, t in rows:
        assert got[i] == (brute_chunks(t, 20) if t is not None else got[i])
    assert not got[4]
    assert chunks(df, most=20).where("i = 1").count() == len(brute_chunks(rows[1][1], 20))
