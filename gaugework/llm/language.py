"""Operator 4: language identification with hyperdimensional profiles. Each letter has a random bipolar vector; a trigram's vector binds (multiplies) the
permuted (rolled) vectors of its letters; a text's vector bundles (sums) those of its trigrams; languages are the bundles of their training texts, and a
document goes to the prototype of largest cosine. All sums are of integers, so the order in which tasks finish changes nothing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.llm import base

DIMENSIONS = 1024
#: What is predicted where there is nothing to go by.
UNKNOWN = "und"
#: Trigram tables up to this size are counted in place; larger alphabets are sorted.
TABLE = 1 << 22
#: Characters that are looked at together, and trigrams and counts (texts by trigrams) of one product: what bounds a task's memory, whatever the texts hold.
WINDOW, BLOCK, COUNTS = 1 << 21, 8192, 1 << 22


class Letters:
    """Code points to small numbers: 0 is whatever is no letter; upper case counts as lower case. Grows with the letters that a worker meets."""

    def __init__(self):
        points = np.arange(0x110000, dtype=np.uint32)
        self.fold = np.zeros(len(points), np.uint32)
        for i in points[(points < 0xD800) | (points > 0xDFFF)].tolist():
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                self.fold[i] = ord(low) if len(low) == 1 else i
        self.number = np.full(len(points), -1, np.int32)
        self.number[0] = 0
        self.points = [0]

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        folded = self.fold[codes]
        out = self.number[folded]
        if (out < 0).any():
            for p in np.unique(folded[out < 0]).tolist():
                self.number[p] = len(self.points)
                self.points.append(p)
            out = self.number[folded]
        return out

    def vectors(self, numbers: np.ndarray) -> np.ndarray:
        """Random bipolar vectors of letters, a function of the code point alone."""
        points = np.array(self.points, np.uint64)[numbers]
        with np.errstate(over="ignore"):
            words = base.mix(base.mix(points[:, None] + np.uint64(1)) + np.arange(DIMENSIONS // 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        bits = np.unpackbits(words.view(np.uint8), axis=1)
        return bits.astype(np.int8) * np.int8(2) - np.int8(1)

    def bound(self, keys: np.ndarray, size: int) -> np.ndarray:
        """The vectors of trigrams (three numbers of letters below size in one): the product of the permuted vectors of their letters."""
        used, parts = np.unique(np.stack([keys // (size * size), keys // size % size, keys % size]), return_inverse=True)
        vectors = self.vectors(used)
        first, second, third = parts.reshape(3, -1)
        return np.roll(vectors, 2, axis=1)[first] * np.roll(vectors, 1, axis=1)[second] * vectors[third]


_LETTERS: list[Letters] = []


def letters() -> Letters:
    if not _LETTERS:
        _LETTERS.append(Letters())
    return _LETTERS[0]


def profiles(texts: list[str], group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sums of the trigram vectors of each of n groups of texts (group: the number of each text's), and how many letters each group has. Each letter has a trigram,
    of itself and of what stands beside it, where any other character, like an end of the text, is the same blank."""
    out, found = np.zeros((n, DIMENSIONS)), np.zeros(n, np.int64)
    codes = np.frombuffer("\0".join(["", *texts, ""]).encode("utf-32-le"), "<u4")
    starts = np.cumsum(np.fromiter((len(t) + 1 for t in ("", *texts)), np.int64, len(texts) + 1))  # after the mark before each text
    table = letters()
    for low in range(1, len(codes) - 1, WINDOW):
        numbers = table.numbers(codes[low - 1:low + WINDOW + 1]).astype(np.int64)
        at = np.flatnonzero(numbers[1:-1])
        if not len(at):
            continue
        size = len(table.points)
        key = (numbers[at] * size + numbers[at + 1]) * size + numbers[at + 2]
        owner = group[np.searchsorted(starts, at + low, side="right") - 1]
        letters_of = np.bincount(owner, minlength=n)
        found += letters_of
        here = np.flatnonzero(letters_of)  # the groups of this window
        owner = (np.cumsum(letters_of > 0) - 1)[owner]
        distinct, which = _distinct(key, size ** 3)
        step = min(BLOCK, max(256, COUNTS // len(here)))
        order = np.argsort(which, kind="stable") if len(distinct) > step else slice(None)
        which, owner = which[order], owner[order]
        for s in range(0, len(distinct), step):
            some = distinct[s:s + step]
            a, b = np.searchsorted(which, (s, s + len(some))) if len(distinct) > step else (0, len(which))
            counts = np.bincount(owner[a:b] * len(some) + which[a:b] - s, minlength=len(here) * len(some)).reshape(len(here), len(some))
            out[here] += _product(counts, table.bound(some, size))
    return out, found


def _distinct(key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers below size, in order, and the place of each among them."""
    if size > TABLE:
        return np.unique(key, return_inverse=True)
    seen = np.zeros(size, bool)
    seen[key] = True
    distinct = np.flatnonzero(seen)
    place = np.zeros(size, np.int32)
    place[distinct] = np.arange(len(distinct), dtype=np.int32)
    return distinct, place[key]


def _product(counts: np.ndarray, bound: np.ndarray) -> np.ndarray:
    kind = np.float32 if counts.sum(axis=1).max(initial=0) < 1 << 24 else np.float64
    return (counts.astype(kind) @ bound.astype(kind)).astype(np.float64)


def learn(df: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """The prototype of each non-null lang, from every row whose text is not null: a vector of DIMENSIONS integers. Rows without letters add nothing; no rows, or
    none with a lang, give no prototypes. Repeated rows count each; extra columns are left out. To the driver come DIMENSIONS numbers (8 KB) for each value of lang, which
    are thus taken to be thousands at most."""
    base.ship(df.sparkSession)
    source = df.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull())

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column("text"), batch.column("lang").to_pylist()
            for s, e in base.slices([len(t.as_buffer()) for t in texts]):
                names = sorted(set(langs[s:e]))
                number = {x: i for i, x in enumerate(names)}
                group = np.array([number[x] for x in langs[s:e]])
                for x, v in zip(names, profiles(texts[s:e].to_pylist(), group, len(names))[0], strict=True):
                    total[x] = total.get(x, 0) + v
        for x, v in total.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([x] * DIMENSIONS), "i": pa.array(range(DIMENSIONS), pa.int32()), "v": pa.array(v.astype(np.int64))})

    rows = source.mapInArrow(run, "lang string, i int, v long").groupBy("lang", "i").agg(F.sum("v").alias("v")).collect()
    out = {r["lang"]: np.zeros(DIMENSIONS) for r in rows}
    for r in rows:
        out[r["lang"]][r["i"]] = r["v"]
    return {x: v for x, v in out.items() if v.any()}


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], keep: dict[str, Column], text: str = "text") -> DataFrame:
    """Columns `keep`, lang_pred and score: the language of largest cosine with the whole text (ties to the first name), and that cosine, at least 0. A null text,
    one without letters, or no prototypes at all, gives UNKNOWN and 0. Rows stay as they are, repeated ones too; other columns are left out. Texts of any length are
    read whole, WINDOW characters after the other."""
    base.ship(df.sparkSession)
    names = sorted(prototypes)
    unit = np.array([prototypes[x] / np.linalg.norm(prototypes[x]) for x in names]).reshape(len(names), DIMENSIONS)
    source = df.select(*(c.alias(n) for n, c in keep.items()), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = source.drop("__text").schema.add("lang_pred", "string").add("score", "double")

    def run(batches):
        for batch in batches:
            texts = batch.column("__text")
            for s, e in base.slices([len(t.as_buffer()) for t in texts]):
                n = e - s
                lang, score = [UNKNOWN] * n, np.zeros(n)
                if len(names):
                    vectors, found = profiles(texts[s:e].to_pylist(), np.arange(n), n)
                    norm = np.linalg.norm(vectors, axis=1)
                    cosine = (vectors @ unit.T) / np.where(norm > 0, norm, 1)[:, None]
                    has = found > 0
                    best = cosine.argmax(axis=1)
                    lang = [names[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)]
                    score = np.where(has, np.clip(cosine[np.arange(n), best], 0, 1), 0)
                part = batch.slice(s, n).drop_columns(["__text"])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score)], [*part.schema.names, "lang_pred", "score"])

    return source.mapInArrow(run, schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    docs = base.table(spark, sf_dir, "documents")
    return predict(docs, learn(docs.where(~held_out)), {"doc_id": F.col("doc_id"), "held_out": held_out})
