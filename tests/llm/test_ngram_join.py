"""The n-gram Jaccard join against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from gaugework.llm import base, ngram_join


def shingles(text, k):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, k, num, den):
    """doc_id -> (size, least linked doc_id)."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, r in sets[:a]:
            if s and r and i is not None and j is not None and den * len(s & r) >= num * len(s | r):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=repr)


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    line = " ".join(rng.choices(vocabulary, k=12))
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            words = rng.choice(texts).split()
            for _ in range(rng.choice([0, 1, 1, 2, 4, 8, 20])):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                words = words[:rng.randrange(len(words) + 1)]
        else:
            words = rng.choices(vocabulary, k=rng.choice([1, 2, 4, 9, 30, 120, 400]))
            if rng.random() < 0.5:
                words += line.split()
        texts.append(" ".join(words))
    return list(enumerate(texts))


@pytest.mark.parametrize(("k", "num", "den"), [(3, 9, 10), (5, 4, 5), (2, 1, 2), (3, 1, 1)])
def test_against_all_pairs(spark, k, num, den):
    rows = corpus(k)
    rows += [(500, None), (501, ""), (502, " \n"), (503, rows[5][1]), (503, rows[5][1]), (None, rows[5][1]), (504, rows[5][1].upper()), (505, "one two"), (506, "One  two")]
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, root long, rep long").repartition(3)
    assert sorted(map(tuple, ngram_join.join(df, k, num, den).collect()), key=repr) == brute(rows, k, num, den)


def test_blocks_of_large_clusters(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 7)
    rows = corpus(9, 90)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.join(df, 3, 4, 5).collect()), key=repr) == brute(rows, 3, 4, 5)


def test_shuffled_instead_of_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    rows = corpus(4, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.join(df).collect()), key=repr) == brute(rows, 5, 4, 5)


def test_empty_table_and_no_links(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l")], "doc_id long, text string")
    assert ngram_join.join(df.limit(0)).collect() == []
    assert sorted(map(tuple, ngram_join.join(df).collect())) == [(1, 2, 1), (2, 2, 2)]


def test_keep_one(spark):
    rows = corpus(2, 50) + [(None, "x"), (70, None)]
    df = spark.createDataFrame([(t, i, "s") for i, t in rows], "text string, doc_id long, source string")
    kept = ngram_join.keep_one(df, 3, 9, 10)
    assert kept.columns == df.columns
    expected = [i for i, _, c in brute(rows, 3, 9, 10) if i == c]
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize(("num", "den"), [(9, 10), (4, 5), (1, 2)])
def test_linked_sets_share_a_signature(num, den):
    rng, t = np.random.default_rng(1), ngram_join.Threshold(num, den)
    for _ in range(400):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = a[rng.random(len(a)) > rng.random() * (1 - num / den)]
        b = np.unique(np.concatenate([b, rng.integers(0, 1 << 63, int(rng.integers(0, 1 + len(a) // 8))).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        if len(a) and len(b) and den * common >= num * (len(a) + len(b) - common) and ngram_join.digest(a) != ngram_join.digest(b):
            (x, hx), (y, hy) = ngram_join.signatures(a, t), ngram_join.signatures(b, t)
            assert len(np.intersect1d(x[hx], y)) or len(np.intersect1d(x, y[hy]))


def test_tree_loses_no_pair():
    rng, t = np.random.default_rng(2), ngram_join.Threshold(4, 5)
    counts = rng.integers(0, 6, (300, 16))
    counts[150:] = np.maximum(counts[:150] + rng.integers(-1, 2, (150, 16)) * (rng.random((150, 16)) < 0.1), 0)
    counts = counts.astype(np.int32)
    sizes = counts.sum(axis=1)
    expected = {(i, j) for i in range(300) for j in range(i) if t.linked(int(np.minimum(counts[i], counts[j]).sum()), int(sizes[i] + sizes[j]))}
    for side in (np.zeros(300, int), (np.arange(300) % 2)):
        got = {(max(i, j), min(i, j)) for p, q in ngram_join.near_pairs(counts, sizes, side, t, np.arange(300)) for i, j in zip(p.tolist(), q.tolist(), strict=True)}
        assert got == {x for x in expected if not side.any() or side[x[0]] != side[x[1]]}


def test_word_hashes():
    texts = [b"", b"  ", b"one two", b" two\x0bone\r\n", b"x" * 200, b"y" + b"x" * 200, "zwölf 🙂".encode()]
    words, counts = base.word_hashes(texts)
    assert counts.tolist() == [len(t.split()) for t in texts]
    flat = [w for t in texts for w in t.split()]
    assert len(set(words.tolist())) == len(set(flat)) and dict(zip(flat, words.tolist(), strict=True))[b"one"] == words[0]
    again, _ = base.word_hashes([b"x" * 200 + b" short"])
    assert again[0] == words[flat.index(b"x" * 200)]
    alone, _ = base.word_hashes([b"short"])
    assert alone[0] == again[1]


@pytest.mark.parametrize("spread", [1, 200, 60_000, 1 << 31, 1 << 62])
def test_packed(spread):
    rng = np.random.default_rng(spread)
    key = rng.integers(0, 1 << 48, 50).astype(np.uint64)
    rep = rng.integers(-spread, spread, 50)
    a, b = ngram_join.unpacked(ngram_join.packed(key, rep))
    assert a.tolist() == key.tolist() and b.tolist() == rep.tolist()


@pytest.mark.parametrize(("k", "num", "den"), [(3, 9, 10), (5, 4, 5), (2, 1, 2)])
def test_parted_clusters_lose_no_link(spark, monkeypatch, k, num, den):
    """All documents as one cluster, repeated rows too."""
    rows = [(i, t) for i, t in corpus(k + 20) if t]
    sets = {i: shingles(t, k) for i, t in rows}
    docs = spark.createDataFrame(rows + rows[:9], "rep long, text string").repartition(3)
    monkeypatch.setattr(ngram_join, "_source", lambda d: d.selectExpr("rep", "CAST(text AS binary) AS text"))
    members = spark.createDataFrame([(i, -5, len(s)) for i, s in sets.items()], "rep long, root long, n long")
    base.ship(spark)
    root = dict(map(tuple, ngram_join.parted(docs, members, k, ngram_join.Threshold(num, den)).collect()))
    linked = [(i, j) for i in sets for j in sets if i < j and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    assert linked and all(root[i] == root[j] for i, j in linked)


def test_shared_passages_make_no_large_cluster(spark, monkeypatch):
    """Texts that share passages alone, in a chain, are one cluster by their signatures; what meets in blocks must not grow with the square of it."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 20)
    rng = random.Random(8)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passages = [words(80) for _ in range(60)]
    rows = [(i, " ".join([words(60), passages[i % 60], words(60), passages[(i + 1 + i // 60) % 60]])) for i in range(180)]
    rows.append((500, rows[3][1] + " more"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    t, source = ngram_join.Threshold(4, 5), ngram_join._source(docs)
    sizes = ngram_join.digests(docs, 5).selectExpr("doc_id AS rep", "n")
    found = ngram_join.components(ngram_join.stars(source, 5, t, 10_000))
    assert max(r["count"] for r in found.groupBy("root").count().collect()) > 100
    left = ngram_join.refined(docs, found, sizes, 5, t)
    assert sorted(map(tuple, left.collect())) == [(3, 3), (500, 3)]
