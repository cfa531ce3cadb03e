"""Unit deduplication against a loop over all units."""

from __future__ import annotations

import random

from gaugework.llm import substring


def cut_up(text):
    """(start, end, words) of the sentences of all lines, character by character: a sentence ends after marks and the blanks that follow them."""
    blank, out, start, i = " \t\x0b\x0c\r", [], 0, 0
    while i < len(text):
        if text[i] == "\n":
            out.append((start, i))
            start = i + 1
        elif text[i] in ".!?" and i + 1 < len(text) and text[i + 1] in blank:
            while i + 1 < len(text) and text[i + 1] in blank:
                i += 1
            out.append((start, i + 1))
            start = i + 1
        i += 1
    out.append((start, len(text)))
    told = []
    for s, e in out:
        words = [w.strip(".,;:!?\"'()[]").lower() for w in "".join(" " if c in blank else c for c in text[s:e]).split(" ")]
        words = [w for w in words if w]
        if words:
            told.append((s, e, words))
    return told


def plain_units(text, least):
    """(start, end, words) by trying all runs of sentences: those with enough words that have too few without their first or without their last."""
    found, out = cut_up(text), []
    size = lambda i, j: sum(len(x[2]) for x in found[i:j + 1])
    for i in range(len(found)):
        for j in range(i, len(found)):
            if size(i, j) >= least:
                if size(i, j - 1) < least or size(i + 1, j) < least:
                    out.append((found[i][0], found[j][1], [w for x in found[i:j + 1] for w in x[2]]))
                if size(i + 1, j) >= least:
                    break
    if not out and found:
        out = [(found[0][0], found[-1][1], ["\n", *(w for x in found for w in x[2])])]
    return sorted(out)


def brute(rows, least=8):
    """doc_id, text of the documents that lose text: every unit of which an equal one stands earlier goes, but for what that one covers."""
    seen, cut = {}, {}
    for i, t in sorted({(i, t) for i, t in rows if i is not None and t is not None}):
        for s, e, words in plain_units(t, least):
            seen.setdefault(" ".join(words), []).append((i, s, t, e))
    for places in seen.values():
        first = min(places)
        for i, s, t, e in places:
            if (i, s) > first[:2]:
                cut.setdefault((i, t), []).append((max(s, first[3]) if (i, t) == (first[0], first[2]) else s, e))
    out = []
    for i, t in rows:
        if (i, t) in cut:
            gone = {c for s, e in cut[i, t] for c in range(s, e)}
            out.append((i, "".join(x for c, x in enumerate(t) if c not in gone)))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"{c}{i}" for c in "abé" for i in range(60)]
    sentence = lambda n: " ".join(rng.choices(vocabulary, k=n)).capitalize() + rng.choice([".", "!", "?!", ""])
    passages = [" ".join(sentence(rng.randrange(1, 14)) for _ in range(6)) for _ in range(4)]
    rows = []
    for i in range(80):
        text = "".join(rng.choice([sentence(rng.randrange(1, 20)), rng.choice(passages)]) + rng.choice([" ", "\n", "\n\n", "  "]) for _ in range(rng.randrange(1, 8)))
        rows.append((i, rng.choice(rows)[1] if rows and rng.random() < 0.2 else text))
    return rows


def run(spark, rows, least=8):
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, unit int, start int").repartition(4)
    return sorted((r["doc_id"], r["text"]) for r in substring.deduplicated(df, least).collect())


def test_against_a_loop(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        got = run(spark, rows)
        assert got == brute(rows) and got
    long = run(spark, rows, substring.LEAST_WORDS)
    assert long == brute(rows, substring.LEAST_WORDS) and long


def test_texts_are_shuffled_to_very_many_spans(spark, monkeypatch):
    rows = corpus(3)
    expected = run(spark, rows)
    monkeypatch.setattr(substring, "BROADCAST_ROWS", 0)
    assert run(spark, rows) == expected and expected


def test_sentences_that_recur_stay_and_passages_go(spark):
    """By default a sentence or two are no passage; fifty words are, also where their first and last sentence are cut."""
    often = "This sentence of some ten words is found in many documents."
    passage = " ".join(f"Sentence {i} of a passage that goes into several other documents." for i in range(6)).split(" ")
    rows = [(i, f"Document {i} starts here with words of its own {i}. {often} It goes on {i} with others.") for i in range(4)]
    rows += [(10, " ".join(passage)), (11, "Lead in " + " ".join(passage[5:57]) + " and a way out.")]
    (doc, text), = run(spark, rows, substring.LEAST_WORDS)
    assert doc == 11 and len(text.split()) < 20


def test_embedded_passage(spark):
    passage = " ".join(f"Word{i} goes with a sentence of some ten plain words here." for i in range(6))
    rows = [(1, f"Nothing before this one {passage} and nothing after."), (2, f"Some other words that lead into it {passage}\nAnd then more."), (3, "Clean text. " * 3)]
    (doc, text), = [x for x in run(spark, rows) if x[0] != 3]
    assert doc == 2 and "Word3" not in text and text.startswith("Some other words") and text.endswith("And then more.")


def test_short_lines_of_clean_documents_stay(spark):
    rows = [(i, f"The.\nOf.\nUnlike line number {i} here with some words that differ {i}.\nThe.") for i in range(5)]
    assert run(spark, rows) == []


def test_edges(spark):
    line = "one two three four five six seven eight nine"
    rows = [(1, None), (2, ""), (3, line), (3, line), (4, line.upper() + "!"), (5, f"{line}\n{line}"), (None, line), (6, "x " * 20_000)]
    got = run(spark, rows)
    assert got == brute(rows)
    assert dict(got)[4] == "" and dict(got)[5] == "\n"
    assert run(spark, []) == []


def test_offsets_are_those_of_the_original(spark):
    rows = corpus(5)
    texts = dict(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in substring.deduplicated(df, 8).collect():
        at, kept = 0, ""
        for s, e in r["removed"]:
            assert at <= s < e
            kept += texts[r["doc_id"]][at:s]
            at = e
        assert kept + texts[r["doc_id"]][at:] == r["text"]


def test_short_lines_and_unspaced_scripts_go(spark):
    """Texts of short lines, of scripts without blanks, and of few words at all: a copy goes whole."""
    verse = "\n".join(f"six words in line number {i}" for i in range(200))
    chinese = "\n".join(f"这是第{chr(0x4E00 + i)}行没有空格的中文文字内容" for i in range(50))
    thai = "\n".join(f"ภาษาไทยไม่มีช่องว่าง{chr(0x0E01 + i)}ระหว่างคำในประโยคเดียวกัน" for i in range(40))
    texts = [verse, chinese, thai, "Too few words."]
    got = run(spark, [(i + 10 * n, t) for n in (0, 1) for i, t in enumerate(texts)])
    assert [i for i, _ in got] == [10, 11, 12, 13] and not any(t.strip() for _, t in got)
    assert all(all(substring.digests(substring.units(t, 8))) for t in texts)
    # few words that are part of another text aren't its copy
    assert run(spark, [(1, "Too few words. Then some more of them follow here."), (2, "Too few words.")]) == []


def test_passage_of_short_sentences(spark):
    """A repeated passage goes whole, whatever stands before it in its line or above, and whatever its sentences' lengths."""
    rng = random.Random(9)
    for lengths in ([5] * 20, [rng.randrange(1, 12) for _ in range(30)], [2, 10, 3]):
        passage = [" ".join(f"w{i}x{j}" for j in range(n)) + "." for i, n in enumerate(lengths)]
        for gap in (" ", "\n"):
            body = gap.join(passage)
            rows = [(1, body), (2, f"Five words stand before it.{gap}{body}"), (3, f"One more.{gap}And another two.{gap}{body}{gap}Then the end.")]
            words = {i: t.split() for i, t in run(spark, rows)}
            assert words == {2: "Five words stand before it.".split(), 3: "One more. And another two. Then the end.".split()}


def test_overlapping_repeats_leave_a_whole_unit(spark):
    assert run(spark, [(1, "Row your own boat. " * 10)]) == [(1, "Row your own boat. " * 2)]
