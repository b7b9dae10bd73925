"""The full-text index, leakage and shared spans against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import fmindex, leakage, spans


def test_index_finds_and_locates():
    rng = np.random.default_rng(0)
    for n in (1, 2, 70, 300):
        c = rng.integers(0, 4, n)
        fm = fmindex.FMIndex(c, 4)
        for length in (1, 3):
            patterns = rng.integers(1, 4, (40, length))
            for p, a, b in zip(patterns, *fm.search(patterns)):
                assert sorted(fm.locate(np.arange(a, b))) == [i for i in range(n - length + 1) if (c[i : i + length] == p).all()]


def test_wavelet_ranks():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 11, 500)
    w = fmindex.WaveletMatrix(x, 11)
    i, s = rng.integers(0, 501, 200), rng.integers(0, 11, 200)
    assert (w.rank(s, i) == [(x[:k] == v).sum() for k, v in zip(i, s)]).all()
    symbol, rank = w.access_rank(np.arange(500))
    assert (symbol == x).all() and (rank == [(x[:k] == x[k]).sum() for k in range(500)]).all()


def test_smaller_neighbours():
    rng = np.random.default_rng(2)
    v = np.concatenate([[-1], rng.integers(0, 5, 200), [-1]])
    left, right = fmindex.smaller_neighbours(v)
    for i in range(1, 201):
        assert left[i] == max(j for j in range(i) if v[j] < v[i]) and right[i] == min(j for j in range(i + 1, 202) if v[j] < v[i])


def words(text):
    return [w.lower() for w in re.findall(r"[^\W_]+", text or "")]


def test_leaks_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    voc = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(voc) for _ in range(rng.randrange(5, 40)))) for i in range(12)]
    docs = []
    for i in range(60):
        cut = rng.choice(items)[1].split()
        a = rng.randrange(len(cut))
        body = [rng.choice([*voc, "other", "noise"]) for _ in range(20)] + cut[a : a + rng.randrange(3, 25)] + [rng.choice(voc) for _ in range(10)]
        docs.append((i, rng.choice([" ", ", ", "\n", "_-"]).join(body).upper() if i % 3 else " ".join(body)))
    docs += [(100, None), (101, ""), (102, items[0][1]), (103, items[0][1] + " " + items[1][1])]
    items += [(50, None), (51, ""), (52, items[0][1]), (0, items[0][1])]
    want = set()
    for i, t in items:
        w = words(t)
        for d, x in docs:
            y = words(x)
            if any(w[a : a + 12] == y[b : b + 12] for a in range(len(w) - 11) for b in range(len(y) - 11)):
                want.add((i, d))
    di = spark.createDataFrame([(*x, "c") for x in items], "item_id long, text string, doc_id string")
    dd = spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, item_id string")
    assert len(want) > 10
    assert {tuple(r) for r in leakage.leaks(di, dd).collect()} == want
    monkeypatch.setattr(leakage, "ITEM_BLOCK_CHARS", 300)
    monkeypatch.setattr(leakage, "SHARD_WORDS", 50)
    assert {tuple(r) for r in leakage.leaks(di, dd).collect()} == want
    spans_ = leakage.removal_spans(di, dd).collect()
    assert {r["doc_id"] for r in spans_} == {d for _, d in want}
    assert all(r["word_to"] - r["word_from"] >= 12 for r in spans_)
    assert leakage.leaks(di.limit(0), dd).count() == 0 and leakage.leaks(di, dd.limit(0)).count() == 0


def texts(seed):
    rng = random.Random(seed)
    chars = "abc æ漢😀\r\n."
    new = lambda n: "".join(rng.choice(chars) for _ in range(n))
    stock = [new(n) for n in (149, 150, 151, 200, 400)]
    docs = [(i, new(rng.randrange(0, 200)) + rng.choice(stock)[: rng.choice([100, 149, 150, 500])] + new(rng.randrange(0, 200))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "a" * 500), (103, stock[4] + "x" + stock[4]), (104, new(3000) + stock[3] + new(3000)), (105, "b" * 400 + "c" + "b" * 400)]
    return docs + [(i + 200, t) for i, t in docs[:10]] + docs[:3]


def covered(docs):
    where, out = defaultdict(set), defaultdict(set)
    for d, t in docs:
        for k in range(len(t or "") - 149):
            where[t[k : k + 150]].add(d)
    for d, t in docs:
        out[d] |= {k for k in range(len(t or "") - 149) if len(where[t[k : k + 150]]) > 1}
    return {d: k for d, k in out.items() if k}


@pytest.mark.parametrize("small", [{}, {"HOT_PIECES": 2}, {"SHARD_CHARS": 3000, "CHUNK_CHARS": 700, "BATCH_CHARS": 2000}])
def test_shared_windows_against_brute_force(spark, monkeypatch, small):
    for k, v in small.items():
        monkeypatch.setattr(spans, k, v)
    docs = texts(5)
    df = spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, anchor string")
    got = defaultdict(set)
    for r in spans.shared_windows(df).collect():
        got[r["doc_id"]] |= set(range(r["first"], r["last"] + 1))
    assert dict(got) == covered(docs)


def test_texts_of_equal_code_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(spans, "piece_code", lambda piece: F.lit(7).cast("long"))
    got = defaultdict(set)
    for r in spans.shared_windows(spark.createDataFrame(texts(5), "doc_id long, text string")).collect():
        got[r["doc_id"]] |= set(range(r["first"], r["last"] + 1))
    assert dict(got) == covered(texts(5))


def test_hot_minimizer_is_split(spark, monkeypatch):
    """One stretch of 80 characters stands in all documents, with other characters around it in most."""
    monkeypatch.setattr(spans, "HOT_PIECES", 8)
    rng = random.Random(9)
    new = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    core, sides = new(100), [(new(60), new(60)) for _ in range(6)]
    docs = [(i, new(40) + (a := rng.choice(sides))[0][rng.randrange(40) :] + core + rng.choice([a[1], new(60)])[: rng.randrange(20, 60)] + new(40)) for i in range(80)]
    got = defaultdict(set)
    for r in spans.shared_windows(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        got[r["doc_id"]] |= set(range(r["first"], r["last"] + 1))
    assert dict(got) == covered(docs) and len(got) > 20


def test_negative_ids_share_windows(spark):
    docs = [(-1 - i, t) for i, t in texts(5)]
    got = defaultdict(set)
    for r in spans.shared_windows(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        got[r["doc_id"]] |= set(range(r["first"], r["last"] + 1))
    assert dict(got) == covered(docs)


def test_spans_are_merged(spark):
    df = spark.createDataFrame(texts(6), "doc_id long, text string")
    want = covered(texts(6))
    rows = spans.shared_spans(df).collect()
    for d in want:
        chars = {c for r in rows if r["doc_id"] == d for c in range(r["char_from"], r["char_to"])}
        assert chars == {c for k in want[d] for c in range(k, k + 150)}
    assert spans.shared_spans(df.limit(0)).count() == 0
