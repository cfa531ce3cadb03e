"""Quality rules against counts in plain Python."""

from __future__ import annotations

import math
import random
import re
import time
from collections import Counter

from gaugework.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i:i + 3])] > 1:
            repeated |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed


def texts():
    rng = random.Random(8)
    vocabulary = ["alpha", "be", "ga&mma", "délta", "e<f>", "🙂", "#", "x|y", " ", "a b"]
    out = [None, "", " ", "\n\n", "one", "a b", "a b c", "a a a a a a", "a b c a b c", "x\ny\nx\n\n \nx", "\r\nl\r\nl\n", "w " * 120]
    for _ in range(60):
        out.append("".join(rng.choice(vocabulary[:rng.randrange(2, 10)]) + rng.choice([" ", " ", "\n", "\t", "  \n"]) for _ in range(rng.randrange(160))))
    return out


def test_counts(spark):
    rows = list(enumerate(texts())) + [(3, "one"), (3, "one")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, kept int, w string").repartition(3)
    trusted = spark.createDataFrame([(i,) for i in range(20, 60)] + [(20,), (None,)], "doc_id long")
    got = quality.assess(df, trusted).collect()
    assert sorted(tuple(r)[:7] for r in got) == sorted((i, *counts(t)) for i, t in rows)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert all(r["kept"] == (not r["base_failed"] and r["ratio"] >= quality.LEAST_RATIO) for r in got if r["ratio"] is not None)


def test_very_long_texts(spark):
    """One run of three words, many repeated windows, none, and a line repeated very often: whole, and in time n log n."""
    rng = random.Random(3)
    rows = ["one two three " * 60_000, " ".join(rng.choices([f"v{i}" for i in range(25)], k=120_000)), " ".join(f"w{i}" for i in range(150_000)), "a line of words\n" * 40_000, "x" * 500_000, " " * 500_000]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(6)
    began = time.perf_counter()
    got = quality.assess(df, df.select("doc_id").limit(1)).collect()
    assert time.perf_counter() - began < 90
    assert sorted(tuple(r)[:7] for r in got) == [(i, *counts(t)) for i, t in enumerate(rows)]


def _corpus():
    rng = random.Random(2)
    good, junk = [f"good{i}" for i in range(300)], [f"junk{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(good, k=1500))) for i in range(60)]
    return rows + [(i, " ".join(rng.choices(junk, k=1500))) for i in range(60, 75)]


def test_ratio(spark):
    """The ratio against its definition, with buckets and hashes as Spark gives them."""
    rows = _corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    trusted = spark.createDataFrame([(i,) for i in range(30)], "doc_id long")
    grams = {r[0]: r[1] for r in df.select("doc_id", quality.ngram_buckets(quality.word_array(df["text"]))).collect()}
    assert all(len(g) == 2999 for g in grams.values())
    raw, target = Counter(), Counter()
    for i, g in grams.items():
        raw.update(g)
        target.update(g if i < 30 else [])
    prior = lambda b: (raw[b] + 1) / (raw.total() + quality.BUCKETS)
    weight = lambda b: math.log((target[b] + quality.PRIOR * prior(b)) / (target.total() + quality.PRIOR) / prior(b))
    for r in quality.assess(df, trusted).collect():
        expected = sum(map(weight, grams[r["doc_id"]])) / 2999
        assert abs(r["ratio"] - expected) < 1e-9
        assert r["kept"] == (r["doc_id"] < 60)


def test_keep_good(spark, monkeypatch):
    df = spark.createDataFrame([(t, i, "en") for i, t in _corpus()], "text string, doc_id long, lang string")
    trusted = spark.createDataFrame([(i,) for i in range(30)], "doc_id long")
    for most in (quality.BROADCAST_ROWS, 0):
        monkeypatch.setattr(quality, "BROADCAST_ROWS", most)
        kept = quality.keep_good(df, trusted)
        assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == list(range(60))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert quality.assess(df, df.select("doc_id")).collect() == []


def test_native(spark):
    df = spark.createDataFrame(_corpus()[:5], "doc_id long, text string")
    assert "Python" not in quality.assess(df, df.select("doc_id"))._jdf.queryExecution().executedPlan().toString().replace("PythonRDD", "").replace("ExistingRDD", "")


def test_mix_of_languages_and_sources(spark):
    """A source with a third of all rows, unlabelled, and a language with few labels are judged by their junk alone."""
    rng = random.Random(4)
    words = {k: [f"{k}{i}" for i in range(300)] for k in ("en", "fr", "hot", "junk")}
    kinds = [("en", "a", "en", 40), ("fr", "a", "fr", 30), ("en", "b", "hot", 45), ("en", "a", "junk", 10), ("fr", "a", "junk", 5), ("en", "b", "junk", 5)]
    rows = [(" ".join(rng.choices(words[w], k=1500)), lang, source, w) for lang, source, w, n in kinds for _ in range(n)]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    trusted = spark.createDataFrame([(i,) for i in [*range(30), *range(40, 46)]], "doc_id long")
    kept = {r["doc_id"] for r in quality.assess(df, trusted).where("kept").collect()}
    assert kept == {i for i, r in enumerate(rows) if r[3] != "junk"}
    assert {r["doc_id"] for r in quality.keep_good(df, trusted).collect()} == kept
