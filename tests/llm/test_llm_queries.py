"""Queries against their SQL twins, brute force on the small tables, and the pipeline's decisions."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from check import connect, rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tablewright.llm import queries


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.fixture(scope="module")
def docs(duck):
    return dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    found = duck.execute(queries.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, found.fetchall())


def test_token_counts(spark, sf, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(queries.VOCABULARY))
    for r in queries.op1_token_count(spark, sf).collect():
        n = len(tokenizer.encode(docs[r["doc_id"]], add_special_tokens=False))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(docs[r["doc_id"]].encode()), n, n > 1024)


def test_language(spark, sf, duck):
    true = dict(duck.execute("SELECT doc_id, lang FROM documents").fetchall())
    found = queries.op2_language_id(spark, sf).collect()
    assert len(found) == len(true)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in found)
    held = [r for r in found if r["held_out"]]
    assert sum(r["lang_pred"] == true[r["doc_id"]] for r in held) >= 0.97 * len(held)


def simhash(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    groups = [words[i : i + 3] for i in range(len(words) - 2)] or ([words] if words else [])
    hashes = [xxhash.xxh64(" ".join(g).encode(), seed=42).intdigest() for g in groups]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_and_components(spark, sf, docs):
    prints = {d: simhash(t) for d, t in docs.items()}
    label = {d: d for d in docs}
    changed = True
    while changed:
        changed = False
        for a in docs:
            for b in docs:
                if label[b] < label[a] and (prints[a] ^ prints[b]).bit_count() <= 3:
                    label[a], changed = label[b], True
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op3_simhash(spark, sf).collect()}
    assert found == {d: (f"{prints[d]:016x}", label[d]) for d in docs}


def test_urls(spark, sf, duck):
    urls = dict(duck.execute("SELECT page_id, url FROM pages").fetchall())
    for r in queries.op8_url_filter(spark, sf).collect():
        rest = urls[r["page_id"]].split("://", 1)[1]
        host = __import__("re").match(r"[^/?#]*", rest)[0]
        path = __import__("re").match(r"[^?#]*", rest[len(host) :])[0]
        fits = [
            (len(t), t, kind) for kind, t in queries.url_filter.RULES
            if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith(t[t.index("/") :])
        ]
        assert (r["host"], r["path"]) == (host, path)
        assert r["rule"] == (max(fits)[1] if fits else None)
        assert r["verdict"] == max(fits)[2] if fits else r["verdict"] in ("allow", "block")


def test_quality(spark, sf, duck):
    graded = {r["doc_id"]: r for r in queries.op9_quality(spark, sf).collect()}
    assert len(graded) == duck.execute("SELECT count(*) FROM documents").fetchall()[0][0]
    known = duck.execute("SELECT doc_id, quality + 1 - toxic FROM labels").fetchall()
    assert sum(graded[d]["keep"] == (g == 2) for d, g in known) >= 0.9 * len(known)


def test_nearest(spark, sf, duck):
    vectors = duck.execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    ids = np.array([v[0] for v in vectors])
    base = np.array([v[1] for v in vectors], dtype=np.float64)
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    found = {}
    for r in queries.op10_nearest(spark, sf).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(found) == [int(i) for i in ids if i % 50 == 0]
    hits = 0
    for q, got in found.items():
        at = int(np.flatnonzero(ids == q)[0])
        cosine = unit @ unit[at]
        got.sort()
        assert [g[0] for g in got] == [1, 2, 3, 4, 5]
        assert all(abs(s - cosine[np.flatnonzero(ids == v)[0]]) < 1e-12 for _, v, s in got)
        true = [int(ids[i]) for i in np.lexsort((ids, -cosine)) if ids[i] != q][:5]
        hits += len(set(true) & {v for _, v, _ in got})
    assert hits >= 0.9 * 5 * len(found)


def test_pipeline(spark, sf, duck):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns, name
        assert docs.join(before, columns, "left_anti").count() == 0
        sizes.append(docs.count())
        if name == "simhash_near_dedup":
            kept = {r["doc_id"] for r in docs.collect()}
            groups = {r["doc_id"]: r["component_id"] for r in corpus_pipeline.simhash.near_duplicate_groups(before).collect()}
            assert kept == set(groups.values())
        if name == "decontaminate":
            dirty = {r["doc_id"] for r in queries.op4_decontaminate(spark, sf).filter("contaminated").collect()}
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in before.collect()} - dirty
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] < sizes[0]
    out = corpus_pipeline.run(spark, sf)
    assert Counter(out.select(F.countDistinct("doc_id")).first()) == Counter([sizes[-1]])
    assert out.filter("shard < 0 OR shard > 15 OR shard IS NULL").count() == 0
