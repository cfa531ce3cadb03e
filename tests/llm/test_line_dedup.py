"""Winnowing against the same definition in plain Python, and its guarantee."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from gaugework.llm import line_dedup


def hashes(spark, rows):
    lines = sorted({x.strip(" \t\r\x0b\x0c") for _, t in rows if t is not None for x in t.split("\n")})
    df = spark.createDataFrame([(x,) for x in lines], "x string")
    return {r[0]: r[1] for r in df.select("x", F.xxhash64("x")).collect()}


def gram(spark, pairs):
    df = spark.createDataFrame(sorted(pairs), "a long, b long")
    return {(r[0], r[1]): r[2] for r in df.select("a", "b", F.xxhash64("a", "b")).collect()} if pairs else {}


def worded(text):
    return [(n, y) for n, x in enumerate(text.split("\n")) if (y := x.strip(" \t\r\x0b\x0c"))]


def without(text, cut):
    """The text without the word lines of the given numbers, and without the lines between two that go and stand together."""
    at = [n for n, _ in worded(text)]
    gone = {at[q] for q in cut} | {n for q in cut if q + 1 in cut for n in range(at[q], at[q + 1])}
    return "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone)


def brute(spark, rows):
    """doc_id, text of the documents that lose lines (unique doc_ids), by the definition: fingerprints, and what is a line wider, wherever they stand first."""
    h = hashes(spark, rows)
    docs = {i: [h[x] for _, x in worded(t)] for i, t in rows if i is not None and t is not None}
    g = gram(spark, {(a, b) for d in docs.values() for a, b in zip(d, d[1:], strict=False)})
    places = {}
    for i, d in docs.items():
        grams = [g[a, b] for a, b in zip(d, d[1:], strict=False)]
        for s in range(max(len(grams) - 1, 1)):
            for p in [-min((x, -(s + j)) for j, x in enumerate(grams[s:s + 2]))[1]] if grams else []:
                for a, n in ((p, 2), (p - 1, 3), (p, 3)):
                    if a >= 0 and a + n <= len(d):
                        places.setdefault(tuple(d[a:a + n]), set()).add((i, a))
    cut = {}
    for run_, found in places.items():
        for i, p in found - {min(found)}:
            cut.setdefault(i, set()).update(range(p, p + len(run_)))
    texts = dict(rows)
    return sorted((i, without(texts[i], c)) for i, c in cut.items())


def bounds(rows):
    """For each doc_id, the word lines that must go (in runs of three that stand earlier too) and those that may (in runs of two), by comparing all runs."""
    docs = {i: [x for _, x in worded(t)] for i, t in sorted(rows)}
    out = {i: (set(), set()) for i in docs}
    for n, which in ((3, 0), (2, 1)):
        seen = set()
        for i, d in docs.items():
            for p in range(len(d) - n + 1):
                if tuple(d[p:p + n]) in seen:
                    out[i][which].update(range(p, p + n))
                seen.add(tuple(d[p:p + n]))
    return out


def corpus(seed):
    rng = random.Random(seed)
    lines = [f"line {i}" for i in range(30)]
    rows = []
    for i in range(70):
        text = [rng.choice([*lines, "", "  ", f"own {i} {rng.random()}"]) for _ in range(rng.randrange(12))]
        if rows and rng.random() < 0.5:
            other = rng.choice(rows)[1].split("\n")
            a = rng.randrange(len(other))
            text += [x + rng.choice(["", " ", "\r"]) for x in other[a:a + rng.randrange(1, 9)]]
        rows.append((i, "\n".join(text)))
    return rows


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, h int, runs int").repartition(3)
    return sorted((r["doc_id"], r["text"]) for r in line_dedup.deduplicated(df).collect())


def run_spans(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return [(r["doc_id"], [tuple(x) for x in r["removed"]]) for r in line_dedup.deduplicated(df).collect()]


def test_against_the_definition(spark):
    for seed in (1, 2, 3):
        rows = corpus(seed)
        got = run(spark, rows)
        assert got == brute(spark, rows) and got
        texts, cut = dict(rows), dict(run_spans(spark, rows))
        for i, (must, may) in bounds(rows).items():
            at = [n for n, _ in worded(texts[i])]
            gone = {q for q, n in enumerate(at) if any(s <= n < e for s, e in cut.get(i, []))}
            assert must <= gone <= may, i


def test_guarantee(spark):
    rng = random.Random(6)
    for length in (3, 4, 9):
        shared = [f"shared {i} {rng.random()}" for i in range(length)]
        rows = [(1, "\n".join(["a", *shared, "b"])), (2, "\n".join(["c", "d", *shared[:2], "", *shared[2:], "e"])), (3, "f\ng\nh")]
        assert run(spark, rows) == [(2, "c\nd\ne")]


def test_within_a_document_and_edges(spark):
    run_of = "x1\nx2\nx3"
    rows = [(1, f"{run_of}\nmid\n{run_of}"), (2, None), (3, ""), (4, "only"), (5, "only"), (6, "x2"), (None, run_of), (7, "\n\n")]
    assert run(spark, rows) == [(1, f"{run_of}\nmid")]
    assert run(spark, []) == []
    # equal rows are the same place; another text under the same doc_id isn't earlier
    assert run(spark, [(1, run_of), (1, run_of)]) == []
    assert run(spark, [(1, run_of), (2, run_of), (2, run_of)]) == [(2, ""), (2, "")]


def test_edges_stand_first_in_other_documents(spark):
    """A fingerprint's earliest place may share less of a run than a later one."""
    rows = []
    for seed in range(12):
        x, y, z, w = (f"{c} {seed}" for c in "xyzw")
        rows += [(3 * seed, f"a {seed}\n{x}\n{y}"), (3 * seed + 1, f"b {seed}\n{w}\n{x}\n{y}\n{z}"), (3 * seed + 2, f"{w}\n{x}\n{y}\n{z}\nc {seed}")]
    got = dict(run(spark, rows))
    assert [got[3 * seed + 2] for seed in range(12)] == [f"c {seed}" for seed in range(12)]


def test_long_repeating_texts(spark):
    """Work is linear in the lines of a document that repeats itself."""
    same = "\n".join(["again and again"] * 200_000)
    began = time.perf_counter()
    assert run(spark, [(1, same), (2, "x\n" + "\n".join(["a", "b", "c"] * 30_000))]) == [(1, "again and again"), (2, "x\na\nb\nc")]
    assert time.perf_counter() - began < 60


def test_hot_lines(spark, monkeypatch):
    """Keys of very many rows are broadcast, whatever their number."""
    rows = [(i, f"own {i}\nx1\nx2\nx3\nown too {i}\ny{i // 2}\nz{i // 2}\nw{i // 2}") for i in range(3000)]
    got = dict(run(spark, rows))
    assert len(got) == 2999 and all(got[i] == f"own {i}\nown too {i}" + ("" if i % 2 else f"\ny{i // 2}\nz{i // 2}\nw{i // 2}") for i in got)
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    assert dict(run(spark, rows)) == got


def test_long_copy(spark):
    text = "\n".join(f"line {i}" for i in range(20_000))
    assert run(spark, [(1, text), (2, text + "\nmore")]) == [(2, "more")]


def test_keep_first(spark):
    rows = [("x1\nx2\nx3", 8, 1), ("x1\nx2\nx3", 8, 2), ("a\nx1\nx2\nx3", 10, 3), (None, None, 4), ("", 0, 5)]
    df = spark.createDataFrame(rows, "text string, n_chars int, doc_id long")
    got = line_dedup.keep_first(df)
    assert got.columns == df.columns and got.schema["n_chars"].dataType == df.schema["n_chars"].dataType
    assert sorted(map(tuple, got.collect()), key=lambda r: r[2]) == [rows[0], ("a", 1, 3), rows[3], rows[4]]


def test_columns_of_any_name(spark):
    names = ["a.b", "__held", "__runs", "runs", "Text", "removed", "c0", "x`y", "at", "lines"]
    schema = ", ".join(f"`{n.replace('`', '``')}` int" for n in names)
    df = spark.createDataFrame([("x1\nx2\nx3", 1, *range(10)), ("a\nx1\nx2\nx3", 2, *range(10)), (None, None, *range(10))], f"text string, doc_id long, {schema}")
    got = line_dedup.keep_first(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([("x1\nx2\nx3", 1, *range(10)), ("a", 2, *range(10)), (None, None, *range(10))], key=repr)


def test_single_long_lines(spark):
    """A repeated line of eight words goes by itself, in documents of one line too; one of seven stays."""
    long, short = "one two three four five six seven eight", "one two three four five six seven"
    chinese = "没有空格的中文行也有足够多的字可以比较"
    rows = [(1, f"a\n{long}\nb"), (2, f"c\n  {long}\r\nd\n{long}"), (3, long), (4, short), (5, short), (6, chinese), (7, f"e\n{chinese}"), (8, chinese[:15]), (9, chinese[:15])]
    assert run(spark, rows) == [(2, "c\nd"), (3, ""), (7, "e")]
    assert run(spark, [(1, f"{long}\n{long}"), (1, f"{long}\n{long}")]) == [(1, long), (1, long)]


def test_removed_spans_are_joined(spark):
    lines = [f"line {i} with some more words so that there are eight" for i in range(5)]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(["a", *lines, "b", lines[3]]))], "doc_id long, text string")
    (row,) = line_dedup.deduplicated(df).collect()
    assert (row["doc_id"], row["text"], [tuple(x) for x in row["removed"]]) == (2, "a\nb", [(1, 6), (7, 8)])
