"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and odd columns."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

import corpus_pipeline
from tablewright.llm import (
    decontaminate, language_id, line_dedup, mixture, nearest, quality, sharding, simhash, token_count, url_filter,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore".split()
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def odd_rows():
    long = prose(1, 60_000)
    return [
        (1, None, "en", "src1", None), (2, "", "en", None, 0), (3, long, None, "src2", 1), (4, long, "en", "src2", 1),
        (4, long, "en", "src2", 1), (None, "short", "de", "src3", 5), (None, None, None, None, None), (None, "short", "de", "src3", 5),
        (7, "1234 5678 ...", "fr", "src1", 3), (8, "\n\n  \n", "fr", "src1", 3), (9, prose(2, 50), "en", "src0", 3),
        (10, prose(2, 50) + " x", "en", "src0", 3), (11, "ÄÖÜ ß 漢字 \U0001f600 e\u0301", "de", "src9", 2), (12, "x" * 300_000, "en", "src9", 2),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    names = ["fingerprint", "n_tokens", "contaminated", "hit_spans", "shard", "score", "component_id", "n_words", "copies", "verdict", "n_lines"]
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    return df.withColumns({n: F.lit("own") for n in names})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# token counts

_tokenizer = Tokenizer.from_file(BYTE_BPE)
_counter = token_count.PieceCounter(lambda ts: [len(e) for e in _tokenizer.encode_batch_fast(ts, add_special_tokens=False)])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"ab'sZé漢1,.!\n\r\t\x0b\x1c\x85\u00a0\u2003   ", "<|endoftext|>", "don't", "\U0001f600"]), max_size=40).map("".join))
def test_pieces_change_no_count(text):
    whole = len(_tokenizer.encode(text, add_special_tokens=False))
    assert _counter.counts([text]) == [whole]
    assert sum(_counter.counts([p])[0] for p in token_count.sections(text, 3)) == whole


def test_remembered_pieces_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(token_count, "REMEMBERED_BYTES", 1 << 20)
    counter = token_count.PieceCounter(lambda ts: [len(t) for t in ts])
    rng, largest = random.Random(1), 0
    for _ in range(300):  # texts without a space, each a piece of its own
        text = "".join(rng.choice("漢字仮名交文") for _ in range(3000))
        assert counter.counts([text]) == [3000]
        kept = [*counter.first, *counter.later]
        largest = max(largest, sum(len(p.encode()) for p in kept))
    assert largest < 3 << 20 and 300 * 9000 > largest


def test_token_counts_of_odd_rows(odd, none):
    out = token_count.token_counts(odd, BYTE_BPE, limit=5).collect()
    assert len(out) == len(odd_rows())
    for r in out:
        text = r["text"] or ""
        n = len(_tokenizer.encode(text, add_special_tokens=False))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 5)
    assert token_count.token_counts(none, BYTE_BPE).count() == 0


def test_other_vocabularies(spark):
    from sentencepiece import SentencePieceProcessor

    texts = [prose(3, 200), "  two  spaces ", "ÄÖÜ ß", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    model = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pairs = (("piece_bpe_32k.model", lambda t: len(model.encode(t))), ("word_bpe_49k.json", lambda t: len(words.encode(t, add_special_tokens=False))))
    for name, count in pairs:
        found = {r["text"]: r["n_tokens"] for r in token_count.token_counts(df, public_tokenizers.path(name)).collect()}
        assert found == {t: count(t or "") for t in texts}
    with pytest.raises(ValueError):
        token_count.read_vocabulary("words.txt")


# languages

def language_docs():
    rng = random.Random(4)
    sounds = {"aa": "ka lo mi ta ne".split(), "bb": "schu gro pfe wix zat".split(), "cc": "oui eau ais ent que".split()}

    def word(name):
        return "".join(rng.choice(sounds[name]) for _ in range(rng.randrange(1, 4)))

    docs = [(i, " ".join(word(n) for _ in range(60)), n) for i, n in enumerate(["aa", "bb", "cc"] * 30)]
    mixed = " ".join(word("aa") for _ in range(70)) + " " + " ".join(word("bb") for _ in range(30))
    return docs, mixed


def test_language_mixture(spark):
    docs, mixed = language_docs()
    model = language_id.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    (found, words), (single, _) = model.mixtures([mixed.encode()]) + model.mixtures([docs[1][1].encode()])
    assert words == 100 and [n for n, _ in found] == ["aa", "bb"] and abs(found[0][1] - 0.7) < 0.05
    assert single == [("bb", 1.0)]
    # one long text equals the same words in parts
    long = (mixed + " ") * 3000
    (whole, n), = model.mixtures([long.encode()])
    assert n == 300_000 and [x for x, _ in whole] == ["aa", "bb"]


def test_expectation_maximisation_is_plain(spark):
    like = np.array([[0.9, 0.1], [0.2, 0.8], [1.0, 0.5]])
    shares = np.array([[0.5, 0.5]])
    for _ in range(500):
        w = like * shares
        shares = (w / w.sum(axis=1, keepdims=True)).mean(axis=0, keepdims=True)
    found, value = language_id._expectation_maximisation(like, np.ones(3), np.array([3]), np.array([[0.5, 0.5]]))
    assert np.abs(found - shares).max() < 0.05
    assert np.isclose(value[0], np.log((like * found).sum(axis=1)).sum())


def plain_mixture(model, text):
    """One document by itself, word by word, in plain loops."""
    import math

    words = "".join(c if c.isalpha() else " " for c in text).split()
    like = []
    for w in words:
        bucket, _ = language_id._trigrams(np.frombuffer(b" " + w.encode() + b" ", dtype=np.uint8))
        logs = [sum(float(model.scores[b, j]) for b in bucket) for j in range(len(model.names))]
        like.append([math.exp(x - max(logs)) for x in logs])

    def fit(shares):
        for _ in range(language_id.ROUNDS):
            new = [0.0] * len(shares)
            for row in like:
                seen = sum(a * b for a, b in zip(row, shares))
                for j, (a, b) in enumerate(zip(row, shares)):
                    new[j] += a * b / seen / len(like)
            moved = max(abs(a - b) for a, b in zip(new, shares))
            shares = new
            if moved < language_id.SETTLED:
                break
        return shares, sum(math.log(sum(a * b for a, b in zip(row, shares))) for row in like)

    first, _ = fit([1 / len(model.names)] * len(model.names))
    order = sorted(range(len(first)), key=lambda j: -first[j])
    best = [1.0 if j == order[0] else 0.0 for j in range(len(first))]
    top = sum(math.log(row[order[0]]) for row in like)
    for k in range(2, len(first) + 1):
        start = [max(first[j], 1e-3) if j in order[:k] else 0.0 for j in range(len(first))]
        shares, value = fit([s / sum(start) for s in start])
        if value - language_id.PENALTY * math.log(len(like) + 1) <= top:
            break
        best, top = shares, value - language_id.PENALTY * math.log(len(like) + 1)
    return {model.names[j]: s for j, s in enumerate(best) if s > 0}


def test_language_set_by_brute_force(spark):
    docs, mixed = language_docs()
    model = language_id.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    words = {n: [w for _, t, m in docs if m == n for w in t.split()] for n in ("aa", "bb", "cc")}
    rng = random.Random(9)
    texts = [mixed, docs[0][1], "x", "ka"]
    for _ in range(40):
        parts = [rng.choice(words[n]) for n in words for _ in range(rng.choice([0, 1, 5, 40]))]
        texts.append(" ".join(parts) or "oui")
    found = model.mixtures([t.encode() for t in texts])
    assert {len(m) for m, _ in found} == {1, 2, 3}
    for t, (m, n) in zip(texts, found):
        want = plain_mixture(model, t)
        assert n == len(t.split()) and {a for a, _ in m} == set(want)
        assert all(abs(s - want[a]) < 1e-6 for a, s in m)
    # a row's result is its own: alone, in any company and order
    assert [model.mixtures([t.encode()])[0] for t in texts] == found
    assert model.mixtures([t.encode() for t in reversed(texts)]) == found[::-1]


def test_long_text_takes_little_memory(spark, monkeypatch):
    import tracemalloc

    docs, mixed = language_docs()
    model = language_id.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    short = [(mixed + " ") * 30, docs[2][1]]
    plain = model.mixtures([t.encode() for t in short])
    monkeypatch.setattr(language_id, "_WAITING_WORDS", 500)
    monkeypatch.setattr(language_id.LanguageModel, "chunk_bytes", 1000)
    cut = model.mixtures([t.encode() for t in short])
    assert [(n, [a for a, _ in m]) for m, n in cut] == [(n, [a for a, _ in m]) for m, n in plain]
    assert np.allclose([s for m, _ in cut for _, s in m], [s for m, _ in plain for _, s in m])
    monkeypatch.undo()
    peaks = []
    for times in (10_000, 40_000):
        text = ((mixed + " ") * times).encode()
        tracemalloc.start()
        model.mixtures([text])
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0], peaks


def test_language_of_odd_rows(odd, none):
    out = {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"]) for r in language_id.identify(odd).collect()}
    assert out[(1, None)] == out[(2, "")] == out[(7, "1234 5678 ...")] == out[(None, None)] == ("und", 0.0)
    assert all(0 < s <= 1 and p in ("en", "de") for (_, t), (p, s) in out.items() if t and any(c.isalpha() for c in t))
    assert language_id.identify(none).count() == 0
    assert language_id.keep_identified(odd).columns == odd.columns
    blank = language_id.predict(odd, language_id.train(none))
    assert {r["lang_pred"] for r in blank.collect()} == {"und"}


# near duplicates

@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover(radius):
    first, second = simhash.mask_levels(radius)
    rng = random.Random(radius)
    for _ in range(500):
        flips = sum(1 << b for b in rng.sample(range(64), radius))
        tables = [t for t, m in enumerate(first) if not m & flips]
        assert tables
        assert all(any(not m & flips for m in second[t]) for t in tables)
    assert all(64 - m.bit_count() <= 24 for row in second for m in row)


def labels_of(links, nodes):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


@pytest.mark.parametrize("bucket", [2, 2048])
def test_links_join_all_close_pairs(spark, bucket):
    rng = random.Random(9)
    prints = set()
    for _ in range(25):
        centre = rng.getrandbits(64)
        for _ in range(8):
            centre ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(5)))
            prints.add(centre - (1 << 64) if centre >> 63 else centre)
    prints = sorted(prints)
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    found = [tuple(r) for r in simhash.near_links(df, bucket=bucket).collect()]
    close = [(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    assert labels_of(found, prints) == labels_of(close, prints)
    assert {(min(x), max(x)) for x in found} or not close


def test_bucket_links_of_a_tight_group():
    group = np.array([1 << i for i in range(60)] + [0], dtype=np.int64)
    assert len(simhash.bucket_links(group, 3)) == 60


def test_near_duplicates_of_odd_rows(odd, none):
    found = simhash.near_duplicate_groups(odd.drop("fingerprint", "component_id")).collect()
    assert len(found) == len(odd_rows())
    by_id = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert by_id[1]["component_id"] == by_id[2]["component_id"] == by_id[8]["component_id"] == 1  # no words: fingerprint 0
    assert by_id[3]["component_id"] == by_id[4]["component_id"] == 3
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = sorted([(r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()])
    assert ids[0] == (False, 1) and (False, 3) in ids and (False, 4) not in ids and (False, 2) not in ids
    assert sum(i[0] for i in ids) == 1  # "short" twice; the null text goes with row 1
    assert simhash.near_duplicate_groups(none).count() == 0 and simhash.drop_near_duplicates(none).count() == 0


def test_repeated_rows_of_one_id(spark):
    text = prose(5, 40)
    df = spark.createDataFrame([(5, text), (5, text), (5, prose(6, 40)), (6, text)], "doc_id long, text string")
    kept = sorted((r["doc_id"], r["text"]) for r in simhash.drop_near_duplicates(df).collect())
    assert kept == sorted([(5, text), (5, prose(6, 40))])


# test passages

def brute_hits(text, items, window=13):
    import re

    def words(t):
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)

    own, hit, names = words(text), set(), set()
    for name, item in items:
        w = words(item)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            for j in range(len(own) - size + 1):
                if own[j : j + size] == w[i : i + size]:
                    hit |= set(range(j, j + size))
                    names.add(str(name))
    return len(own), len(hit), sorted(names)


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 60])
def test_hits_equal_brute_force(spark, block_bytes):
    rng = random.Random(6)
    items = [(i, prose(100 + i, rng.choice([3, 12, 13, 14, 40]))) for i in range(12)] + [(20, None), (21, "..."), (3, "two words")]
    docs = [(i, prose(200 + i, 30) + ", " + (rng.choice(items)[1] or "").upper() + "; " + prose(300 + i, rng.randrange(50))) for i in range(30)]
    docs += [(90, None), (91, ""), (92, "Two  words"), (92, "Two  words"), (93, (prose(100, 40) + " ") * 40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_hit", F.lit("own"))
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(decontaminate.find_hits(df, table, block_bytes=block_bytes)).collect()
    assert len(found) == len(docs)
    for r in found:
        n, hit, names = brute_hits(r["text"], items)
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, hit, len(names))
        assert r["items_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert r["contaminated"] == (hit > 0 and 20 * hit >= n)


def test_removal(spark, odd, none):
    item = prose(50, 15)
    table = spark.createDataFrame([(1, item)], "item_id long, text string")
    clean = "Before, the start. " + prose(51, 400)
    df = spark.createDataFrame([(1, f"{clean} <{item.upper()}>! after"), (2, clean), (3, None), (4, item)], "doc_id long, text string")
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(df, table).collect()}
    assert cut == {1: f"{clean} <>! after", 2: clean, 3: None, 4: ""}
    assert sorted(r["doc_id"] for r in decontaminate.drop_documents(df, table).collect()) == [1, 2, 3]
    kept = decontaminate.drop_documents(odd, table)
    assert kept.columns == odd.columns and kept.count() == odd.count() and kept.filter("hit_spans = 'own'").count() == odd.count()
    assert decontaminate.drop_documents(none, table).count() == 0
    assert decontaminate.drop_documents(df, table.limit(0)).count() == 4


# mixture

def test_budgets_by_hand(spark):
    leaves = spark.createDataFrame([("a", "x", 10.0), ("a", "y", 1000.0), ("b", "x", 30.0), ("b", None, 10.0)], "d string, s string, supply double")

    def shares(weights, budget, epochs=1):
        out = mixture.leaf_budgets(leaves, ["d", "s"], weights, budget, epochs).collect()
        return {(r["d"], r["s"]): round(r["budget"], 6) for r in out}

    # a and b get 100 each; b can take 40, its 60 go to a; inside a, x is full at 10
    assert shares({}, 200) == {("a", "x"): 10, ("a", "y"): 150, ("b", "x"): 30, ("b", None): 10}
    assert shares({("a",): 3.0}, 40) == {("a", "x"): 10, ("a", "y"): 20, ("b", "x"): 5, ("b", None): 5}
    assert shares({("*", "x"): 0.0, ("a", "x"): 1.0}, 20) == {("a", "x"): 5, ("a", "y"): 5, ("b", "x"): 0, ("b", None): 10}
    assert sum(shares({}, 1e9, 2).values()) == 2100
    assert set(shares({}, 0).values()) == {0}


def test_budget_of_a_leaf_shut_out_goes_to_siblings(spark):
    leaves = spark.createDataFrame([("a", "x", 10.0), ("a", "y", 1000.0), ("b", "x", 30.0), ("b", None, 10.0)], "d string, s string, supply double")
    out = mixture.leaf_budgets(leaves, ["d", "s"], {("a", "y"): 0.0}, 40, 1).collect()
    # a can take 10 in all, so b gets 30
    assert {(r["d"], r["s"]): round(r["budget"], 6) for r in out} == {("a", "x"): 10, ("a", "y"): 0, ("b", "x"): 20, ("b", None): 10}


def test_prefix_of_epochs(spark):
    rows = [(i, "s", i % 7) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, t long")
    supply = sum(r[2] for r in rows)
    out = mixture.mix(df, ["source"], {}, F.col("t"), budget=2.5 * supply).collect()
    order = sorted(rows, key=lambda r: (hashlib.md5(f"42:2:{r[0]}".encode()).hexdigest(), r[0]))
    rest, total, more = int(0.5 * supply), 0, set()
    for r in order:
        total += r[2]
        if total <= rest:
            more.add(r[0])
    assert {r["doc_id"]: r["copies"] for r in out} == {i: 3 if i in more else 2 for i, _, _ in rows}


def test_mixture_of_odd_rows(odd, none):
    out = mixture.mix(odd, ["lang", "source"], {("en",): 2.0}, mixture.token_length(F.col("text")), fraction=0.5)
    got = out.collect()
    assert set(out.columns) == set(odd.columns) and all(r["copies"] > 0 and isinstance(r["n_tokens"], int) for r in got)
    assert mixture.mix(none, ["lang"], {}, mixture.token_length(F.col("text"))).count() == 0


# sharding

def jump(key, shards):
    b, j = -1, 0
    key &= (1 << 64) - 1
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & (1 << 64) - 1
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 16, 17, 1000])
def test_jump_shards(spark, shards):
    rng = random.Random(shards)
    keys = [0, 1, -1, (1 << 63) - 1, -(1 << 63), *[rng.randrange(-(1 << 63), 1 << 63) for _ in range(300)]]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    found = {r["k"]: r["s"] for r in df.select("k", sharding.jump_shard(F.col("k"), shards).alias("s")).collect()}
    assert found == {k: jump(k, shards) for k in keys}


def test_more_jumps_than_the_short_loop(spark, monkeypatch):
    monkeypatch.setattr(sharding, "_JUMPS", 2)
    df = spark.range(200)
    found = {r["id"]: r["s"] for r in df.select("id", sharding.jump_shard(F.col("id"), 40).alias("s")).collect()}
    assert found == {k: jump(k, 40) for k in range(200)}


def test_slots(spark, odd, none, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 3)
    monkeypatch.setattr(sharding, "_RUN", 7)
    rows = [(i, "text" * (i % 5)) for i in range(700)] + [(None, "a")] * 40 + [(3, None)] * 5
    out = sharding.shard_table(spark.createDataFrame(rows, "doc_id long, text string"), shards=4).collect()
    assert len(out) == len(rows)
    by_shard = {}
    for r in out:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 4) and r["size"] >= 1
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert all(r["text_crc32"] == 0 and r["size"] == 1 for r in out if r["doc_id"] == 3 and r["size"] == 1)
    assert sharding.shard_table(odd).count() == len(odd_rows()) and sharding.shard_table(none).count() == 0
    assert {r["shard"] for r in sharding.with_shard(odd).collect()} <= set(range(16))


def test_shards_on_disk(spark, odd, tmp_path):
    sharding.write_shards(odd, f"{tmp_path}/out", shards=3, files=2)
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(odd_rows())


# lines

@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=400))
def test_perfect_hash(keys):
    array = np.array(sorted(keys), dtype=np.uint64)
    perfect = line_dedup.PerfectHash(line_dedup.PerfectHash.build(array))
    assert sorted(perfect.find(array)) == list(range(len(array))) and perfect.size == len(array)


def brute_lines(texts, least):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\r\x0b\x0c"))

    docs = [(t or "").split("\n") for t in texts]
    count = {}
    for d in docs:
        for k in {key(x) for x in d} - {""}:
            count[k] = count.get(k, 0) + 1
    return ["\n".join(x for x in d if count.get(key(x), 0) < least) for d in docs]


@pytest.mark.parametrize("shard_keys,at_once", [(1 << 17, 32), (3, 2)])
def test_lines_equal_brute_force(spark, shard_keys, at_once):
    rng = random.Random(8)
    shared = [prose(i, 4) for i in range(30)]
    texts = ["\n".join(rng.choice([rng.choice(shared), f"  {rng.choice(shared).upper()}\t", prose(rng.random(), 3), "", "ÄB"]) for _ in range(rng.randrange(9))) for _ in range(120)]
    texts += [None, "", "\n", texts[0], texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_lines", F.lit("own"))
    out = {r["doc_id"]: r for r in line_dedup.drop_common_lines(df, min_docs=5, shard_keys=shard_keys, shards_at_once=at_once).collect()}
    expected = brute_lines(texts, 5)
    assert any(e != (t or "") for e, t in zip(expected, texts))
    for i, t in enumerate(texts):
        assert out[i]["text"] == expected[i] and out[i]["n_lines"] == (t or "").count("\n") + 1
        assert (out[i]["n_dropped"] > 0) == (out[i]["most_docs"] >= 5)


def test_twins_in_one_half_of_the_hash(spark):
    keys = spark.createDataFrame([(7, 1, 10), (7, 2, 11), (8, 3, 12)], "h1 long, h2 long, docs long")
    index = line_dedup.ShardIndex(1, line_dedup.build_shards(keys, 1).collect())
    asked = np.array([[7, 1], [7, 2], [8, 3], [8, 4], [9, 9]], dtype=np.uint64)
    assert list(index.counts_of(asked)) == [10, 11, 12, 0, 0]


def test_lines_of_odd_rows(odd, none):
    assert line_dedup.drop_common_lines(odd).count() == len(odd_rows())
    assert line_dedup.drop_common_lines(none).count() == 0


# URLs

def test_url_parts_and_rules(spark):
    urls = [
        ("http://WWW.Example.COM/en/x?a#b", "www.example.com", "/en/x", "www.example.com/en/"), ("https://a.example.com/en/", "a.example.com", "/en/", "example.com/en/"),
        ("x://b.com", "b.com", "", None), ("http://net/es/1", "net", "/es/1", "net/es/"), ("http://xnet/es/1", "xnet", "/es/1", None),
        ("no scheme", "", "", None), ("", "", "", None), (None, "", "", None), ("://?q", "", "", None), ("a://b://c/d", "b:", "//c/d", None),
    ]
    df = spark.createDataFrame([(i, u[0]) for i, u in enumerate(urls)], "page_id long, url string").withColumn("rule", F.lit("own"))
    out = {r["page_id"]: r for r in url_filter.judge(df).collect()}
    for i, (_, host, path, rule) in enumerate(urls):
        assert (out[i]["host"], out[i]["path"], out[i]["rule"]) == (host, path, rule)
        assert out[i]["verdict"] in ("allow", "block")
    assert url_filter.judge(df.limit(0)).count() == 0
    plain = url_filter.judge(df.filter("url = ''")).collect()
    assert [(r["verdict"], r["score"]) for r in plain] == [("allow", 0.0)]


def test_url_model(spark):
    rng = random.Random(2)

    def url(tld, words):
        return f"http://{rng.choice(words)}{rng.randrange(99)}.{tld}/{rng.choice(words)}/{rng.randrange(999)}"

    good, bad = ["paper", "article", "lecture"], ["pills", "casino", "winbig"]
    rules = (("allow", "com/"), ("block", "net/"))
    rows = [(i, url("com", good)) for i in range(300)] + [(i, url("net", bad)) for i in range(300)]
    new = [(1000 + i, url("org", good)) for i in range(50)] + [(2000 + i, url("org", bad)) for i in range(50)]
    out = url_filter.judge(spark.createDataFrame(rows + new, "page_id long, url string"), rules=rules)
    judged = {r["page_id"]: r["verdict"] for r in out.collect()}
    right = sum(judged[1000 + i] == "allow" for i in range(50)) + sum(judged[2000 + i] == "block" for i in range(50))
    assert right >= 95
    assert url_filter.keep_allowed(spark.createDataFrame(rows, "page_id long, url string"), rules=rules).count() == 300


def test_url_score_by_brute_force(spark):
    import math

    seen = [("http://aab.com/x", "allow"), ("http://abab.com/", "allow"), ("http://zzb.net/q", "block")]
    model = url_filter.stored(url_filter.train(spark.createDataFrame(seen, "url string, verdict string")))
    asked = "http://aaz.org/x"
    found = url_filter.ratio(spark.createDataFrame([(asked,)], "url string"), F.col("url"), model).first()["score"]

    def padded(u):
        return "\x02" * 4 + u.split("://")[1] + "\x03"

    def probability(kind, text, at):
        p = 1 / 256
        for o in range(5):
            ctx, follows = text[at - o : at], {}
            for u, v in seen:
                s = padded(u)
                for i in range(4, len(s)):
                    if v == kind and s[i - o : i] == ctx:
                        follows[s[i]] = follows.get(s[i], 0) + 1
            n, t = sum(follows.values()), len(follows)
            if n:
                p = (follows.get(text[at], 0) + t * p) / (n + t)
        return p

    s = padded(asked)
    total = sum(math.log(probability("allow", s, i) / probability("block", s, i)) for i in range(4, len(s)))
    assert math.isclose(found, total / (len(s) - 4), rel_tol=1e-9)


# quality

def test_ordinal_model_recovers_order():
    rng = np.random.default_rng(1)
    cells = rng.integers(0, 50, size=(3000, 6))
    weights = rng.normal(size=50)
    score = weights[cells].sum(axis=1) + rng.logistic(size=3000)
    grades = np.digitize(score, [-2.0, 2.0])
    model = quality._fit(grades, np.repeat(np.arange(3000), 6), cells.ravel())
    assert model.grades == [0, 1, 2] and model.thresholds[0] < model.thresholds[1]
    tails = model.tails(list(cells))
    assert np.all(tails[:, 0] >= tails[:, 1])
    assert np.corrcoef(model.expected(tails), weights[cells].sum(axis=1))[0, 1] > 0.9


def test_quality_of_odd_rows(spark, odd, none):
    graded = quality.grade(odd, quality.fit(odd.withColumn("grade", F.col("doc_id") % 3)))
    assert all(0 <= r["tail_prob"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in graded.collect()) and graded.count() == len(odd_rows())
    blank = quality.fit(none.withColumn("grade", F.lit(1)))
    assert {(r["expected_grade"], r["tail_prob"]) for r in quality.grade(odd, blank).collect()} == {(0.0, 1.0)}
    assert quality.grade(none, blank).count() == 0
    labels = spark.createDataFrame([(9, 1, 0), (9, None, 0), (None, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    assert [(r["doc_id"], r["grade"]) for r in quality.rated_documents(odd, labels).collect()] == [(9, 2)]


def test_fit_sample_is_bounded(spark):
    df = spark.createDataFrame([(f"text {i}", i % 2) for i in range(300)] * 2, "text string, grade int")
    some, whole = quality.fit(df, rows=50), quality.fit(df)
    assert some.grades == whole.grades == [0, 1]


def test_url_scores_of_many_windows(spark):
    import math
    from collections import defaultdict

    rng = random.Random(8)
    letters = {"allow": "abcdefghijklmnopqrstuvwxyz", "block": "0123456789abcdefghijklm"}
    seen = [("x://" + "".join(rng.choice(letters[v]) for _ in range(60)), v) for v in ("allow", "block") for _ in range(2000)]
    counts = {v: defaultdict(lambda: defaultdict(int)) for v in letters}
    for u, v in seen:
        s = "\x02" * 4 + u.split("://")[1] + "\x03"
        for i in range(4, len(s)):
            for o in range(5):
                counts[v][s[i - o : i]][s[i]] += 1
    assert sum(len(t) for v in counts for c, t in counts[v].items() if len(c) == 4) > 150_000

    def probability(v, s, i):
        p = 1 / 256
        for o in range(5):
            if follows := counts[v].get(s[i - o : i]):
                p = (follows.get(s[i], 0) + len(follows) * p) / (sum(follows.values()) + len(follows))
        return p

    asked = [u for u, _ in seen[::400]] + ["x://" + "".join(rng.choice(letters[v]) for _ in range(40)) for v in letters]
    model = url_filter.stored(url_filter.train(spark.createDataFrame(seen, "url string, verdict string")))
    df = spark.createDataFrame([(u,) for u in [*asked, asked[0], None]], "url string")
    found = [(r["url"], r["score"]) for r in url_filter.ratio(df, F.col("url"), model).collect()]
    assert sorted(u or "" for u, _ in found) == sorted([*asked, asked[0], ""])
    for u, score in found:
        s = "\x02" * 4 + (u or "").partition("://")[2] + "\x03"
        total = sum(math.log(probability("allow", s, i) / probability("block", s, i)) for i in range(4, len(s)))
        assert score is None if u is None else math.isclose(score, total / (len(s) - 4), rel_tol=1e-9)


# vectors

def test_scan_keeps_the_nearest():
    rng = np.random.default_rng(3)
    base, points = (nearest._unit(rng.normal(size=(n, 64))) for n in (2000, 20))
    true = np.argsort(((points[:, None, :] - base[None]) ** 2).sum(axis=2), axis=1)[:, :5]
    q, r, _ = nearest.scan(points, base, nearest._bounds(points, base, 5))
    kept = {(int(a), int(b)) for a, b in zip(q, r)}
    assert len(kept) < 0.2 * 20 * 2000  # most candidates are given up early
    assert sum((i, int(t)) in kept for i in range(20) for t in true[i]) >= 98


def test_rotation_keeps_distances():
    turn = nearest.rotation(24)
    assert np.allclose(turn @ turn.T, np.eye(24))


def test_vectors_of_all_kinds(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [2.0, 0.0]), (5, [0.0, 1.0]), (6, [-1.0, 0.5]), (100, [0.0, 3.0])]
    bad = [(7, None), (8, []), (9, [0.0, 0.0]), (150, [nan, 1.0]), (10, [inf, 1.0]), (11, [None, 1.0]), (None, [1.0, 0.0]), (200, [1.0, 2.0, 3.0]), (5, [0.0, 1.0])]
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("rank", T.StringType())])
    df = spark.createDataFrame([(*r, "own") for r in rows + bad], schema)
    asks = F.pmod("vec_id", F.lit(50)) == 0
    found = {}
    for r in nearest.search(df, asks, k=3).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 9)))
    assert found == {0: [(3, 1.0), (4, 1.0), (50, 1.0)], 50: [(0, 1.0), (3, 1.0), (4, 1.0)], 100: [(5, 1.0), (6, round(0.5 / 1.25**0.5, 9)), (0, 0.0)]}
    assert nearest.search(df.limit(0), asks).count() == 0
    assert nearest.search(df.filter("vec_id = 0"), asks).count() == 0


def test_hot_vector_and_parts(spark, monkeypatch):
    monkeypatch.setattr(nearest, "PART", 16)
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 2.0, 3.0, 4.0] if i % 3 == 0 else rng.normal(size=4).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in nearest.search(df, F.pmod("vec_id", F.lit(50)) == 0, target=1.0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    unit = nearest._unit(np.array([r[1] for r in rows], dtype=np.float32))
    for q, ranks in got.items():
        score = np.round(unit @ unit[q], 12)
        true = [int(i) for i in np.lexsort((np.arange(600), -score)) if i != q][:5]
        assert [ranks[i] for i in range(1, 6)] == true


def test_recall_of_a_larger_table(spark):
    base = np.random.default_rng(11).normal(size=(40_000, 64)).astype(np.float32)
    table = pa.table({"vec_id": pa.array(range(len(base)), pa.int64()), "embedding": pa.array(list(base), pa.list_(pa.float32()))})
    df = spark.createDataFrame(table).repartition(8)
    got = {}
    for r in nearest.search(df, F.pmod("vec_id", F.lit(50)) == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    asked = np.arange(0, len(base), 50)
    unit = nearest._unit(base)
    near = unit[asked] @ unit.T
    near[np.arange(len(asked)), asked] = -2
    true = np.argsort(-near, axis=1)[:, :5]
    hits = sum(len(got[int(q)] & set(t.tolist())) for q, t in zip(asked, true))
    print("recall", hits / true.size)
    assert hits >= 0.93 * true.size


# columns named like the operators' own helpers

def clashing(df):
    helpers = [
        "__id", "__hash", "__b", "__h", "__n", "id", "text_hash", "group", "node", "label", "least", "__k1", "__k2", "__host", "__text",
        "__score", "__verdict", "HIT_SPANS", "Hit_Items", "N_WORDS", "__kept_0", "__d0", "d1", "__domain", "__lang", "__source", "LANG_PRED", "SCORE", "languages",
    ]
    return df.select("doc_id", "text", "lang", "source", "n_chars").withColumns({n: F.lit(f"own {n}") for n in helpers})


def test_helper_names_clash_with_nothing(spark, sf):
    rows = [r for r in odd_rows() if r[0] in (1, 2, 9, 10, None)] + [(20, prose(31, 40), "en", "src1", 1), (21, prose(31, 40), "en", "src2", 1)]
    docs = clashing(spark.createDataFrame(rows, SCHEMA))
    own = {c: f"own {c}" for c in docs.columns[5:]}
    items = spark.createDataFrame([(1, prose(31, 40))], "item_id long, text string")
    made = {
        "near": simhash.drop_near_duplicates(docs), "cut": decontaminate.remove_spans(docs, items),
        "dropped": decontaminate.drop_documents(docs, items), "identified": language_id.keep_identified(docs),
        **{name: stage(spark, docs, sf) for name, stage in corpus_pipeline.STAGES[:-1]},
    }
    for name, out in made.items():
        assert out.columns == docs.columns, name
        found = out.collect()
        assert found and all({c: r[c] for c in own} == own for r in found), name
    assert sum(r["text"] == prose(31, 40) for r in made["near"].collect()) == 1
    assert {r["text"] for r in made["cut"].collect() if r["doc_id"] in (20, 21)} == {""}
    assert not {20, 21} & {r["doc_id"] for r in made["dropped"].collect()}


def test_urls_with_helper_names(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (2, None), (3, "http://b.org/y"), (3, "http://b.org/y")], "page_id long, url string")
    pages = pages.withColumns({c: F.lit("own") for c in ("__k1", "__k2", "__host", "__path", "__rule", "__verdict", "__text", "__score", "d0", "HOST")})
    out = url_filter.judge(pages).collect()
    assert len(out) == 4 and all(r["__k1"] == r["__score"] == r["d0"] == "own" for r in out)
    assert {r["page_id"]: r["host"] for r in out} == {1: "a.com", 2: "", 3: "b.org"}
    assert url_filter.keep_allowed(pages).columns == pages.columns


# pipeline

def test_pipeline_of_odd_rows(spark, odd, none, sf):
    for df in (odd, none):
        docs = df.drop("shard")
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = stage(spark, docs, sf).cache()
            assert docs.columns[: len(columns)] == columns, name
        assert docs.count() <= df.count()
