"""Chat formatting: exact round trips, the mask, and parts."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gaugework.llm import chat

NASTY = ["", " ", "</s>", "<s>user\n", "&lt;", "&amp;lt;", "&nl;", "<image>", "a\n\nb", "🙂é", "[INST] ok [/INST]", "<", "&", "\\n", "</s></s><s>"]


def frame(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, pos string").repartition(3)
    return df.withColumn("parts", chat.text_part(F.coalesce("text", F.lit(""))))


def back(spark, rows):
    return {r["conv_id"]: r for r in chat.read_back(chat.format_chat(frame(spark, rows))).collect()}


def test_round_trip(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "to\nol", "<s>", "&nl;"]), "".join(rng.choices(NASTY, k=rng.randrange(5)))) for c in range(60) for t in range(rng.randrange(1, 9))]
    got = back(spark, rows)
    for c in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == c), key=lambda r: r[1])
        assert [tuple(t) for t in got[c]["turns"]] == [(r[2], r[3]) for r in turns]
        assert got[c]["loss_text"] == "".join(r[3] for r in turns if r[2] == "assistant")


def test_nulls_ties_and_repeats(spark):
    rows = [(1, 0, None, None), (1, None, "user", "first"), (2, 0, "user", "b"), (2, 0, "user", "a"), (2, 0, "assistant", "z"), (2, 0, "user", "a"), (None, 0, "assistant", "n")]
    got = back(spark, rows)
    assert [tuple(t) for t in got[1]["turns"]] == [("user", "first"), ("", "")]
    assert [tuple(t) for t in got[2]["turns"]] == [("assistant", "z"), ("user", "a"), ("user", "a"), ("user", "b")]
    assert got[None]["loss_text"] == "n"
    assert back(spark, []) == {}


def test_long_text(spark):
    text = "</s>&" * 100_000
    got = back(spark, [(1, 0, "assistant", text)])
    assert got[1]["loss_text"] == text and got[1]["turns"][0]["text"] == text


def test_parts(spark):
    schema = f"conv_id long, turn long, role string, parts {chat.PARTS}"
    rows = [
        (1, 0, "user", [("text", "see <image> ", None, None), ("image", None, "i.png", 9), ("text", None, None, None), ("audio", "ignored", "a.wav", None), ("video", None, "v", None)]),
        (1, 1, "assistant", [("text", "yes", None, None), ("document", None, "d.pdf", 5)]),
        (2, 0, "assistant", None),
    ]
    df = chat.format_chat(spark.createDataFrame(rows, schema))
    got = {r["conv_id"]: r for r in df.collect()}
    assert got[1]["formatted"] == "<s>user\nsee &lt;image> <image><audio><document></s><s>assistant\nyes<document></s>"
    assert [tuple(a) for a in got[1]["attachments"]] == [(1, 1, "image", "i.png", 9), (1, 3, "audio", "a.wav", 750), (1, 4, "document", "v", 1024), (2, 1, "document", "d.pdf", 5)]
    assert got[1]["attachment_tokens"] == 9 + 750 + 1024 + 5 and got[2]["attachments"] == [] and got[2]["attachment_tokens"] == 0
    start, end = got[1]["loss_spans"][0]
    assert got[1]["formatted"][start:end] == "yes<document>"
    read = {r["conv_id"]: r for r in chat.read_back(df).collect()}
    assert [tuple(t) for t in read[1]["turns"]] == [("user", "see <image> "), ("assistant", "yes")] and read[1]["loss_text"] == "yes"


def test_query(spark, tmp_path):
    rows = [(5, 1, "assistant", "ok </s>"), (5, 0, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in chat.op8_chat_format(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    said = "</s>[INST] ok [/INST]"
    assert tuple(got[-1])[:5] == (-1, 2, sha(f"user\n{said}\nassistant\n{said}\n"), len(said), sha(said))
    assert tuple(got[5])[:5] == (5, 2, sha("user\n\nassistant\nok </s>\n"), 7, sha("ok </s>"))


@pytest.mark.parametrize("bad", ["mapInArrow", "pandas", "udf"])
def test_native(bad):
    with open(chat.__file__) as f:
        assert bad not in f.read().replace("pyspark.sql", "")
