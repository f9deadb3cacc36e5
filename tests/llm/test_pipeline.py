import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

R = random.Random(11)
WORDS = [f"word{i}" for i in range(500)]


def text(n=60):
    return " ".join(R.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    rows, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        t = text() + (" vilest rotten nasty" if bad else "")
        rows.append((i, t, "en", "s", len(t)))
        labels.append((i, 1, int(bad)))
    near = text(200)
    item = text(30)
    planted = {1000: near, 1001: near, 1002: near.replace(near.split()[100], "changed", 1), 1003: f"{text()} {item} {text()}", 1004: f"{text()} mail me at someone@mail.example.com now", 1005: f"{text()} vilest rotten", 1006: "", 1007: None}
    rows += [(i, t, "en", None, len(t or "")) for i, t in planted.items()]
    rows += [(None, text(), None, "s", None), (7, rows[7][1], "en", "s", rows[7][4])]
    spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), rows


def test_stages(spark, folder):
    at, rows = folder
    docs, seen = spark.read.parquet(f"{at}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(spark, stage(spark, docs, at), name)
        seen[name] = docs.cache()
        if name != "byte_bpe":
            assert docs.columns == columns
    ids = {n: [r.doc_id for r in d.select("doc_id").collect()] for n, d in seen.items()}
    clean = [i for i, *_ in rows if i is not None and i < 300 and i % 5]
    toxic = [i for i, *_ in rows if i is not None and i < 300 and i % 5 == 0]
    assert set(clean) <= set(ids["toxicity"]) and not set(toxic) & set(ids["toxicity"]) and 1005 not in ids["toxicity"] and None in ids["toxicity"]
    assert {1000, 1001, 1002} & set(ids["near_duplicates"]) == {1000} and {1006, 1007} & set(ids["near_duplicates"]) == {1006} and ids["near_duplicates"].count(7) == 1
    assert set(ids["near_duplicates"]) - set(ids["decontamination"]) == {1003}
    (pii,) = seen["personal_data"].where("doc_id = 1004").collect()
    assert "mail me at [EMAIL] now" in pii.text and pii.n_chars == len(pii.text) and pii.score == "k"
    other = {r.doc_id: r.text for r in seen["decontamination"].collect()}
    assert all(r.text == other[r.doc_id] for r in seen["personal_data"].collect() if r.doc_id != 1004)
    last = seen["byte_bpe"]
    assert last.count() == len(ids["personal_data"]) and last.where(F.size("ids") != F.col("n_tokens")).count() == 0


def plain_run(spark, at):
    """All rows of the pipeline, by plain Python over lists: every stage's brute force on what the one before it kept."""
    import hashlib
    import zlib

    from docmill.llm import toxicity
    from tests.llm.test_bpe import TOKENS, public_tokenizers, tiktoken
    from tests.llm.test_decontaminate import brute_tiles
    from tests.llm.test_jaccard import brute as linked
    from tests.llm.test_pii import brute as spans
    from tests.llm.test_toxicity import folded, plain_scores

    docs = spark.read.parquet(f"{at}/documents.parquet")
    rows, names = [tuple(r) for r in docs.collect()], docs.columns
    value = lambda r, c: r[names.index(c)]
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{at}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    model = toxicity.fit(docs, spark.read.parquet(f"{at}/labels.parquet"), learn_from=~toxicity.in_fold())
    examples = sorted(((value(r, "doc_id"), value(r, "text") or "", toxic[value(r, "doc_id")]) for r in rows if value(r, "doc_id") in toxic))
    scores = plain_scores(model, [value(r, "text") or "" for r in rows], [e[1:] for e in examples])
    rows = [r for r, s in zip(rows, scores, strict=True) if s < 0.3]

    named = [(value(r, "doc_id"), value(r, "text")) for r in rows if value(r, "doc_id") is not None]
    least = {(d, t): c for (d, t), c in zip(named, classes(linked, named), strict=True)}
    kept, seen = [], set()
    for r in rows:
        key = (value(r, "doc_id"), value(r, "text"))
        if key[0] is None or least[key] == key[0] and key not in seen:
            kept.append(r)
        seen.add(key)
    items = [folded(r.text) for r in spark.read.parquet(f"{at}/benchmark.parquet").collect()]
    windows = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    holds = lambda w, item: bool(windows(w) & windows(item)) and 2 * brute_tiles(item, w, 5) >= len(item)
    rows = [r for r in kept if not any(holds(folded(value(r, "text") or ""), item) for item in items)]

    encoding, out = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(TOKENS)}, special_tokens={}), []
    for r in rows:
        text, told, place = value(r, "text"), "", 0
        found = sorted((start, -end, kind) for kind, start, end in spans(text or ""))
        for start, end, kind in found:
            if start >= place:
                told += f"{text[place:start]}[{kind.upper()}]"
            place = max(place, -end)
        told = told + text[place:] if found else text or ""
        ids = np.array(encoding.encode_ordinary(told), "<u4")
        other = {c: value(r, c) for c in names if c != "text"} | ({"n_chars": len(told)} if found else {})
        out.append(tuple(other[c] for c in names if c != "text") + (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(told.encode()).hexdigest()))
    return out


def classes(linked, rows):
    """The class of each row, from the brute force that counts (id, class, links)."""
    by = {}
    for (d, c, _), n in linked(rows).items():
        by.setdefault(d, []).extend([c] * n)
    return [min(by[d]) for d, _ in rows]


def test_run_gives_all_rows_of_brute_force(spark, folder):
    at, _ = folder
    out = corpus_pipeline.run(spark, at)
    names = [c for c in spark.read.parquet(f"{at}/documents.parquet").columns if c != "text"] + ["n_tokens", "ids_sha256", "decoded_sha256"]
    got = [tuple(r) for r in out.select(*names).collect()]
    want = plain_run(spark, at)
    assert Counter(got) == Counter(want) and len(got) > 200
