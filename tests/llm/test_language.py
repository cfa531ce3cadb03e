"""Language profiles: the vectors against their definition, held-out accuracy, and edge cases."""

from __future__ import annotations

import os
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugework.llm import language

DIR = "/root/testdata/sf0.01"


def letter_vector(c):
    """The vector of a letter by its definition, in plain integers."""
    mask = (1 << 64) - 1

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & mask
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    seed = mix((0 if c is None else ord(c)) + 1)
    words = [mix(seed + i * 0x9E3779B97F4A7C15 & mask) for i in range(language.DIMENSIONS // 64)]
    return np.array([2 * (byte >> (7 - i) & 1) - 1 for w in words for byte in w.to_bytes(8, "little") for i in range(8)])


def defined(text, known={}):
    """The bundle of a text, one trigram after the other; letters in lower case, all else a blank."""
    folded = [None, *((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else None for c in text or ""), None]
    for c in set(folded) - known.keys():
        known[c] = letter_vector(c)
    total = np.zeros(language.DIMENSIONS)
    for a, b, c in zip(folded, folded[1:], folded[2:], strict=False):
        if b is not None:
            total += np.roll(known[a], 2) * np.roll(known[b], 1) * known[c]
    return total


TEXTS = ["The cat", "", "a", "...", "Ünïcode, ТЕКСТ 中文字", "x1y2  z", "aaa aaa", " lead", "trail ", "\x00nul\x00", "İI ß"]


def profiles(texts):
    return language.profiles(texts, np.arange(len(texts)), len(texts))


@pytest.mark.parametrize("window", [1 << 20, 3, 1])
def test_bundles_follow_the_definition(monkeypatch, window):
    monkeypatch.setattr(language, "WINDOW", window)
    got, found = profiles(TEXTS)
    assert np.array_equal(got, np.stack([defined(t) for t in TEXTS]))
    assert found.tolist() == [sum(map(str.isalpha, t)) for t in TEXTS]
    grouped, found = language.profiles(TEXTS, np.arange(len(TEXTS)) % 2, 2)
    assert np.array_equal(grouped, np.stack([got[0::2].sum(axis=0), got[1::2].sum(axis=0)])) and found.sum() == sum(map(str.isalpha, "".join(TEXTS)))


def test_large_alphabets_and_blocks(monkeypatch):
    monkeypatch.setattr(language, "TABLE", 1)
    monkeypatch.setattr(language, "BLOCK", 100)
    text = "".join(chr(0x4E00 + i * 7 % 2000) for i in range(1500))
    got, _ = profiles([text, "abc"])
    assert np.array_equal(got[0], defined(text)) and np.array_equal(got[1], defined("abc"))


def test_memory_of_a_long_text_of_distinct_trigrams():
    """1.3 million Han characters (4 MB), nearly all of their trigrams distinct."""
    code = (
        "import random, resource, numpy as np\n"
        "from gaugework.llm import language\n"
        "language.profiles(['warm up'], np.zeros(1, int), 1)\n"
        "text = ''.join(map(chr, random.Random(3).choices(range(0x4E00, 0x9FA5), k=1_300_000)))\n"
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
        "out, found = language.profiles([text], np.zeros(1, int), 1)\n"
        "assert found[0] == len(text)\n"
        "print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)\n"
    )
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert int(done.stdout) < 300


def test_predictions_against_plain_sums(spark):
    rng = random.Random(2)
    alphabets = {"p": "abcdefgh", "q": "abcdefij", "r": "klmnop", "s": "klmnop"}  # r and s get the same texts: ties go to r
    make = lambda letters, n: " ".join("".join(rng.choices(letters, k=rng.randrange(1, 9))) for _ in range(n))
    trained = [(make(alphabets[x], 60), x) for x in "pqr" for _ in range(4)]
    trained += [(t, "s") for t, x in trained if x == "r"] + [(None, "p"), ("zzz", None), ("", "t"), ("123", "u")]
    asked = [make(alphabets[x], k) for x in "pqr" for k in (1, 2, 5, 40)] + [make("abcdefghijklmnop", 30), "", None, "42", "zzz", make("abcdefgh", 20_000)]
    sums = {}
    for t, x in trained:
        if t is not None and x is not None:
            sums[x] = sums.get(x, 0) + defined(t)
    sums = {x: v / np.linalg.norm(v) for x, v in sums.items() if v.any()}
    learned = language.learn(spark.createDataFrame(trained, "text string, lang string").repartition(3))
    assert sorted(learned) == sorted(sums) == ["p", "q", "r", "s"]
    got = language.predict(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), learned, {"doc_id": F.col("doc_id")}).collect()
    for r in got:
        v = defined(asked[r["doc_id"]])
        if not v.any():
            assert tuple(r)[1:] == ("und", 0)
            continue
        scores = [(x, float(v @ sums[x] / np.linalg.norm(v))) for x in sorted(sums)]
        best = max(s for _, s in scores)
        assert r["lang_pred"] == next(x for x, s in scores if s == best or (x in "rs" and s > best - 1e-9)) and abs(r["score"] - max(best, 0)) < 1e-9


def test_vectors_are_functions_of_letters():
    a, b = language.Letters(), language.Letters()
    for table, order in ((a, "za"), (b, "az")):
        for c in order:
            table.numbers(np.array([ord(c)]))
    assert np.array_equal(a.vectors(np.array([2])), b.vectors(np.array([1])))
    v = a.vectors(np.array([1, 2])).astype(int)
    assert set(np.unique(v)) == {-1, 1} and abs(v[0] @ v[1]) < 200


def test_small_tables(spark):
    rows = [(1, "the house and the garden", "en"), (2, "das Haus und der Garten", "de"), (3, None, "en"), (4, "123 !?", "de"), (5, "the the the", None), (5, "the the the", None), (6, "x", None)]
    df = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, lang string, lang_pred string")
    got = language.predict(df, language.learn(df), {"doc_id": F.col("doc_id")}).collect()
    assert [r["doc_id"] for r in got] == [r[0] for r in rows]
    assert [r["lang_pred"] for r in got][:6] == ["en", "de", "und", "und", "en", "en"] and got[6]["lang_pred"] in ("de", "en")
    assert all(0 <= r["score"] <= 1 for r in got) and got[2]["score"] == 0
    assert language.learn(df.limit(0)) == {}
    assert [tuple(r) for r in language.predict(df.limit(2), {}, {}).collect()] == [("und", 0.0)] * 2
    assert language.predict(df.limit(0), {}, {}).collect() == []


def test_held_out_accuracy(spark):
    if not os.path.isdir(DIR):
        pytest.skip("no test data")
    got = language.op4_language_id(spark, DIR).join(spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang"), "doc_id")
    n, right = got.where("held_out").agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 100 and right / n > 0.98
