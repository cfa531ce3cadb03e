"""Operator 9: substring deduplication by hashing units. Lines are cut into sentences, units are the shortest runs of sentences with enough words from and to every
sentence, normalised and digested, digests are grouped over all documents, the occurrence of the earliest rank stays, and the others are removed; their original
offsets are kept. Units overlap, so an earliest one can lose what repeats in another unit, and every sentence that goes is left where it stood first."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugework.llm import base

#: Fewest words of a unit: shorter sentences and lines are joined with those that follow, over line ends too. Single sentences recur by chance; of a passage of fifty words,
#: whatever sentences its ends cut, as many are left in whole ones.
LEAST_WORDS = 20
#: Documents that lose text are broadcast to the texts up to so many of them, and of their spans (8 bytes); beyond, texts are shuffled to them.
BROADCAST_ROWS, BROADCAST_SPANS = 200_000, 2_000_000

#: The end of a sentence: marks, then blanks; where scripts without blanks between words occur, their own marks too, and in some of them blanks.
_BREAK = re.compile(r"[.!?]+[\x20\x09\x0B-\x0D]+")
_BREAK_UNSPACED = re.compile(r"[.!?]+[\x20\x09\x0B-\x0D]+|[。！？｡]+[」』）]*[\x20\x09\x0B-\x0D]*|(?<=[\u0e00-\u109f\u1780-\u17ff])[\x20\x09\x0B-\x0D]+")
_MARKS = ".,;:!?\"'()[]。！？｡、，；：「」『』（）"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Han and kana, of which two count as a word, and Thai, Lao, Tibetan, Burmese and Khmer, of which four do.
_TWO = re.compile("[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\uff66-\uff9d\U00020000-\U0003ffff]")
_FOUR = re.compile("[\u0e00-\u109f\u1780-\u17ff]")


def sentences(text: str):
    """(start, end, normalised words, number of words) of the sentences with words of all lines, in order. Normalised: words in lower case, stripped of marks at their
    ends, one blank between them. Of scripts without blanks, the number is that of their letters by two or four."""
    unspaced = not text.isascii() and (_TWO.search(text) or _FOUR.search(text))
    search = (_BREAK_UNSPACED if unspaced else _BREAK).search
    for line in re.finditer(r"[^\n]+", text):
        at, end = line.span()
        while at < end:
            m = search(text, at, end)
            stop = m.end() if m else end
            found = [x for w in _WORD.findall(text, at, stop) if (x := w.strip(_MARKS).lower())]
            if found:
                n = sum(max(1, len(_TWO.findall(x)) // 2 + len(_FOUR.findall(x)) // 4) for x in found) if unspaced else len(found)
                yield at, stop, " ".join(found), n
            at = stop


def units(text: str, least: int = LEAST_WORDS) -> list[tuple[int, int, str, bool]]:
    """(start, end, normalised words, whole) of the units of a text, by their place; neither starts nor ends ever fall. From every sentence on, a unit runs to the
    first that gives it `least` words, and back from every sentence likewise, lines on where need be. So a passage of `least` words has units that cover all its
    sentences, the same wherever it stands. A text of fewer words is one short unit (not whole)."""
    found = list(sentences(text))
    ahead, back, first, n = [], [], 0, 0
    # first: where the unit that ends with the sentence i starts, or would start
    for i, x in enumerate(found):
        n += x[3]
        while n - found[first][3] >= least:
            # no later end is nearer to this start
            if not ahead or ahead[-1][0] < first:
                ahead.append((first, i))
            n -= found[first][3]
            first += 1
        if n >= least:
            back.append((first, i))
            if not ahead or ahead[-1][0] < first:
                ahead.append((first, i))
    if not back:
        return [(found[0][0], found[-1][1], " ".join(x[2] for x in found), False)] if found else []
    return [(found[i][0], found[j][1], found[i][2] if i == j else " ".join([x[2] for x in found[i:j + 1]]), True) for i, j in sorted({*ahead, *back})]


def digests(found: list[tuple[int, int, str, bool]]) -> list[bytes]:
    """128 bits of each unit; the only unit of a short text is digested as such, so that it goes only where the whole text repeats."""
    return [hashlib.blake2b((words if whole else f"\n{words}").encode("utf-8", "surrogatepass"), digest_size=16).digest() for _, _, words, whole in found]


def duplicates(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, version, start, end of units of docs (doc_id, text) whose digest occurs at an earlier rank: at a smaller doc_id, or earlier in the document.
    version: a hash of the text, so rows that repeat a doc_id with another text stay apart; exact repeats of a row have equal ranks and don't remove each other.

    Each batch sends one row for a digest to the shuffle, its earliest; the others can't be the earliest of all, so they are known to go, and the batch joins those of a
    document that overlap or meet. A digest that very many documents share is thus combined before the shuffle. Of a unit that overlaps the earliest one with its digest,
    what follows that one goes. Null texts have no units; rows with a null doc_id take no part."""
    names = ["known", "a", "b", "doc_id", "version", "start", "end"]

    def run(batches):
        for batch in batches:
            ids, versions = batch.column("doc_id").to_pylist(), batch.column("version").to_pylist()
            rows, keys = [], []
            for i, text in enumerate(batch.column("text")):
                found = units(text.as_py(), least)
                for unit, key in zip(found, digests(found), strict=True):
                    keys.append(key)
                    rows.append((ids[i], versions[i], *unit[:2]))
            if not rows:
                continue
            key = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            row = np.array(rows, np.int64)
            order = np.lexsort((row[:, 2], row[:, 0], key[:, 1], key[:, 0]))
            key, row = key[order], row[order]
            new = np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1)))
            first = row[np.flatnonzero(new)[np.cumsum(new) - 1]]
            known = (row[:, 0] != first[:, 0]) | (row[:, 2] != first[:, 2])
            within = known & (row[:, :2] == first[:, :2]).all(axis=1)
            row[within, 2] = np.maximum(row[within, 2], first[within, 3])
            told = _joined(row[known])
            key = np.concatenate([key[~known], told[:, [1, 2]]])  # those known are dealt anywhere
            row, known = np.concatenate([row[~known], told]), np.arange(len(key)) >= len(key) - len(told)
            for s in range(0, len(row), 1 << 17):
                e = s + (1 << 17)
                yield pa.RecordBatch.from_arrays([pa.array(known[s:e]), *(pa.array(c[s:e]) for c in (*key.T.copy(), *row.T.copy()))], names)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    rows = source.mapInArrow(run, "known boolean, a long, b long, doc_id long, version long, start long, end long")
    rank = F.struct("doc_id", "start")
    earliest = F.first(rank).over(Window.partitionBy("known", "a", "b").orderBy("doc_id", "start").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("late", F.col("known") | (rank > earliest)).where("late").select("doc_id", "version", "start", "end")


def _joined(rows: np.ndarray) -> np.ndarray:
    """Rows of doc_id, version, start and end, of which those of a document that overlap or meet are one."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))
    # ends so far within a document: documents are set apart by more than any offset
    apart = np.cumsum(new) << 40
    reach = np.maximum.accumulate(rows[:, 3] + apart)
    opens = np.concatenate(([True], rows[1:, 2] + apart[1:] > reach[:-1]))
    at = np.flatnonzero(opens)
    last = np.append(at[1:], len(rows)) - 1
    return np.stack([rows[at, 0], rows[at, 1], rows[at, 2], reach[last] - apart[last]], axis=1)


def removed_spans(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, version and spans (array of start and end, in order; units that overlap or meet are joined) of documents that lose text."""
    text = Window.partitionBy("doc_id", "version").orderBy("start", "end")
    so_far = F.max("end").over(text.rowsBetween(Window.unboundedPreceding, -1))
    late = duplicates(docs, least).withColumn("opens", F.coalesce(F.col("start") > so_far, F.lit(True)).cast("long"))
    numbered = late.withColumn("span", F.sum("opens").over(text.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = numbered.groupBy("doc_id", "version", "span").agg(F.struct(F.min("start").cast("int").alias("start"), F.max("end").cast("int").alias("end")).alias("s"))
    return spans.groupBy("doc_id", "version").agg(F.sort_array(F.collect_list("s")).alias("spans"))


def remaining(text, spans):
    """A text without its spans: what stands before each, and after the last."""
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda x: x["end"]))
    starts = F.concat(F.transform(spans, lambda x: x["start"]), F.array(F.length(text)))
    return F.array_join(F.zip_with(ends, starts, lambda a, b: F.substring(text, a + 1, b - a)), "")


def deduplicated(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, text (what remains), removed (spans of the original text, code points, end exclusive) of the documents that lose text; the others are as they were.

    An empty table, texts without words and null texts lose nothing. Ties: a unit at the same doc_id and place (a repeated row) stays in each. Texts are read whole.
    Extra columns are left out."""
    base.ship(docs.sparkSession)
    docs = base.own_columns(docs, "doc_id", "text")
    spans = base.written(removed_spans(docs, least).withColumnsRenamed({"doc_id": "__doc", "version": "__version"}))
    size = spans.agg(F.count("*").alias("n"), F.sum(F.size("spans")).alias("spans")).first()
    few = size["n"] <= BROADCAST_ROWS and (size["spans"] or 0) <= BROADCAST_SPANS
    hit = docs.join(F.broadcast(spans) if few else spans, (F.col("doc_id") == F.col("__doc")) & (F.xxhash64("text") == F.col("__version")))
    return hit.select("doc_id", remaining(F.col("text"), F.col("spans")).alias("text"), F.col("spans").alias("removed"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document that loses text: doc_id, n_removed, removed_chars, removed (start:end, joined by commas), text."""
    found = deduplicated(base.table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("removed").cast("long").alias("n_removed"),
        F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("removed_chars"),
        F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("removed"),
        "text",
    )
