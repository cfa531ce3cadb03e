"""Byte-level BPE against the tiktoken library and plain merging, and round trips."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugework.llm import byte_bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
EDGE = ["", " ", "\n\n  \t", "a", "don't I'll", "äöü ßñ 中文 🙂🙂 ́x", "x" * 3000, "ab" * 2500 + "!", "12345 67", "\x00\x01", "the the the", "<|endoftext|>", "a b　c", "A" * 401 + " " + "-" * 900]


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(byte_bpe.parse_ranks(byte_bpe.read_vocabulary(PATH)), P.PATTERN)


def test_edges(codec, reference):
    ids = codec.encode(EDGE)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [reference.encode_ordinary(t) for t in EDGE]
    assert codec.decode(ids) == [t.encode() for t in EDGE]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_random(codec, reference, texts):
    ids = codec.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [reference.encode_ordinary(t) for t in texts]
    assert codec.decode(ids) == [t.encode() for t in texts]


def merged(ranks, word, rising=False):
    """One leftmost pair of least rank after the other, in plain Python; and whether the ranks rise."""
    parts, told = [word[i:i + 1] for i in range(len(word))], []
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts] if not rising else told == sorted(told) and len(parts) == 1
        rank, i = min(pairs)
        told.append(rank)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def ids_of(codec, query, words):
    return [x.tolist() for x in codec._run(query, words)]


def test_both_queries_take_the_same_merges(codec):
    words = [("thinrendößation" * 20).encode(), b"a" * 31, b"abab" * 9, b"ababa", b"xyzzy"]
    assert codec.orderly
    for query in (byte_bpe._CONTRACT, byte_bpe._CONTRACT_KEYED.format(single=False), byte_bpe._CONTRACT_KEYED.format(single=True)):
        assert ids_of(codec, query, words) == [merged(codec.ranks, w) for w in words]


@settings(max_examples=25, deadline=None)
@given(st.permutations([b"ab", b"ba", b"aba", b"bab", b"aa", b"aab", b"abab", b"caa", b"bc"]), st.lists(st.text("abc", min_size=1, max_size=40), min_size=1, max_size=5, unique=True))
def test_any_order_of_ranks(tokens, words):
    """Vocabularies whose tokens need not come out by merges of lesser rank."""
    ranks = {bytes([i]): i for i in range(256)} | {t: 300 + i for i, t in enumerate(tokens)}
    own = byte_bpe.Codec(ranks, ".+")
    raw = [w.encode() for w in words]
    expected = [merged(ranks, w) for w in raw]
    assert own.orderly == all(merged(ranks, t, rising=True) for t in ranks)
    for query in (byte_bpe._CONTRACT, byte_bpe._CONTRACT_KEYED.format(single=not own.orderly)):
        assert ids_of(own, query, raw) == expected
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(words)] == [[i for part in own.cuts([w])[0] for i in merged(ranks, part)] for w in raw] == expected


def test_texts_without_blanks(codec, reference):
    """Many pieces of some hundred bytes, and single ones of very many: no step holds more than the bound."""
    rng = random.Random(4)
    han = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n))
    common = "的一是不了人我在有他这为之大来以个中上们到说国和地也子时道出而要于就下得可你年生自会那后能对着事其里所去行过"
    texts = [
        "。".join(han(20) for _ in range(3000)), "，".join("".join(rng.choices(common, k=130)) for _ in range(500)), han(30_000), "".join(rng.choices(common, k=30_000)),
        " ".join("".join(chr(rng.randrange(0xE01, 0xE2F)) for _ in range(60)) for _ in range(500)), base64.b64encode(rng.randbytes(100_000)).decode(),
        "x" * 200_000, "ab" * 20_000, "the" * 5000, "".join(rng.choices("etaoin", k=4000)),
    ]
    ids = codec.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [reference.encode_ordinary(t) for t in texts]
    for some in codec._queries(sorted([p.encode() for t in texts for p in codec.find(t)], key=len)):
        rows = sum(len(w) * (len(w) + 3) // 2 if len(w) <= byte_bpe.COPIED else len(w) for w in some)
        assert len(some) == 1 or rows <= (byte_bpe.COPIED_ROWS if len(some[-1]) <= byte_bpe.COPIED else byte_bpe.KEYED_ROWS)


def test_a_word_beyond_the_rows_of_a_query(codec, reference, monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEYED_ROWS", 1000)
    text = "z" * 5001 + " " + "y" * 999
    assert np.frombuffer(codec.encode([text])[0], "<u4").tolist() == reference.encode_ordinary(text)


def test_forgetting(codec, reference, monkeypatch):
    monkeypatch.setattr(codec.pieces, "most", 3)
    for t in ("alpha beta gamma delta", "epsilon alpha", "zeta beta alphabeta"):
        assert np.frombuffer(codec.encode([t])[0], "<u4").tolist() == reference.encode_ordinary(t)


def test_frames(spark, reference):
    rows = [(1, "one two", "x"), (1, "one two", "x"), (2, None, "y"), (None, "", "z"), (3, "drei " * 50, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = byte_bpe.encode(df, PATH, P.PATTERN, keep=("doc_id",)).collect()
    assert [(r["doc_id"], r["ids"]) for r in got] == [(i, reference.encode_ordinary(t or "")) for i, t, _ in rows]
    back = byte_bpe.decode(spark.createDataFrame(got), PATH, keep=("doc_id",)).collect()
    assert [bytes(r["bytes"]) for r in back] == [(t or "").encode() for _, t, _ in rows]
    digests = byte_bpe.encode_digests(df, PATH, P.PATTERN).collect()
    for r, (i, t, _) in zip(digests, rows, strict=True):
        ids = np.array(reference.encode_ordinary(t or ""), "<u4")
        assert tuple(r) == (i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert byte_bpe.encode_digests(df.limit(0), PATH, P.PATTERN).collect() == []


def test_unknown_id(spark):
    df = spark.createDataFrame([([999_999],)], "ids array<int>")
    with pytest.raises(Exception, match="vocabulary"):
        byte_bpe.decode(df, PATH).collect()
