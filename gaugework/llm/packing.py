"""Operator 7: vector bin packing. Examples go into sequences under limits on tokens, segments and loss-bearing tokens at once; the next example of an
open sequence is the one with the largest dot product of its needs and of the room that is left."""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.llm import base

#: Limits of a sequence in production: tokens, segments, loss-bearing tokens.
TOKENS, SEGMENTS, LOSS = 4096, 512, 4096
#: Examples that wait in one task for a place; more are packed before others are read.
POOL = 1024
#: Bytes of each of the two generations of words that a Python worker remembers.
REMEMBERED = 56 << 20
#: Bytes of texts that are encoded together.
SLICE = 2 << 20
#: Marks that are no letters, digits or apostrophes.
MARKS = ".,;:!?"
#: Plain words that the model encodes as one text.
TOGETHER = 500
# ---- fixed values: how a tokenizer must prepare texts so that its words can be encoded one by one, in lower case, and marks after a letter apart ----
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The id that ends a document.
END = 2


# ---- where a text in UTF-8 is cut into words, by the classes of neighbouring bytes ----
_SPACE, _LETTER, _DIGIT, _MARK, _APOSTROPHE, _OTHER = range(6)


def _classes() -> np.ndarray:
    kind = np.full(256, _OTHER, np.uint8)
    for i in range(33, 127):
        c = chr(i)
        kind[i] = _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _APOSTROPHE if c == "'" else _MARK
    kind[9:14] = kind[32] = _SPACE
    return kind


def _limits() -> np.ndarray:
    """Whether a word starts between a byte of class a and one of class b, at 8 * a + b. Blanks stand before words. Letters, digits and marks are pieces of their own, but an
    apostrophe can be one with what follows and with marks; what stands beside other bytes may be composed with them, so only blanks part these."""
    cut = np.zeros((8, 8), bool)
    for a in (_LETTER, _DIGIT, _MARK, _APOSTROPHE):
        for b in (_LETTER, _DIGIT, _MARK, _APOSTROPHE):
            cut[a, b] = a != b and {a, b} != {_MARK, _APOSTROPHE} and (a, b) != (_APOSTROPHE, _LETTER)
    cut[:, _SPACE] = True
    return cut.ravel()


CLASSES, LIMITS = _classes(), _limits()


def cut_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Words of texts in UTF-8, most with a blank in front, ASCII letters in lower case where that can't change what they are composed with; and where in them each text starts."""
    buf = np.frombuffer(bytearray(b" " + b" ".join(texts) + b" "), np.uint8)  # the last blank is no word
    kind = CLASSES[buf]
    buf[kind == _SPACE] = 32
    lead = np.flatnonzero(buf == 0xC3)
    lead = lead[(buf[lead + 1] != 0x97) & (buf[lead + 1] != 0xB7)]  # letters of Latin-1, without the signs for times and by
    kind[lead] = kind[lead + 1] = _LETTER
    upper = np.flatnonzero((buf >= 65) & (buf <= 90))
    upper = upper[kind[upper + 1] != _OTHER]
    buf[upper] += 32
    start = np.flatnonzero(LIMITS[(kind[:-1] << 3) | kind[1:]]) + 1
    start = np.concatenate(([0], start)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(start) - 1, [None, pa.py_buffer(start), pa.py_buffer(buf)])
    begin = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return words, np.concatenate(([0], np.searchsorted(start, begin)))


def listed(words: pa.Array) -> list[str]:
    """Words of cut_words, without the blanks before them."""
    offsets, buf = np.frombuffer(words.buffers()[1], np.int64)[:len(words)], np.frombuffer(words.buffers()[2], np.uint8)
    buf = np.insert(buf, offsets[buf[offsets] != 32], 32)
    return buf.tobytes().decode().split(" ")[1:]


def latin(word: str) -> bool:
    """Whether all are letters of Latin-1, which stay what they are in NFC."""
    return word.isalpha() and (word.isascii() or max(word) <= "\xff")


class Words:
    """Ids of texts. By a tokenizer that never looks across blanks and line feeds and takes upper case as lower (told by its file, see NORMALIZERS and SPLIT), each distinct
    run between them is encoded once; by any other, texts are encoded whole."""

    def __init__(self, blob: bytes, by_word: bool, remembered: int = REMEMBERED):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(blob.decode())
        self.words = base.Remembered(remembered)
        self.by_word = by_word
        spec = json.loads(blob)
        special = [t["content"] for t in spec.get("added_tokens") or []]
        self.special = re.compile(b"|".join(re.escape(t.encode().lower()) for t in special) or rb"(?!)")
        # The same model for words of small letters alone, which are one piece each and normal already; it ends each with a token that says so.
        model = spec["model"]
        self.plain, suffix = None, model.get("end_of_word_suffix")
        if by_word and suffix and not model.get("dropout"):
            steps = [{"type": "WhitespaceSplit"}, *spec["pre_tokenizer"]["pretokenizers"][1:]]
            self.plain = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": steps}}))
            self.plain.model._resize_cache(0)  # no word comes twice
            self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
            self.ends[[i for t, i in model["vocab"].items() if t.endswith(suffix)]] = True

    def learn(self, words: set[str]) -> None:
        """Ids of new words. Marks after a last letter are pieces of their own in any word, and case doesn't matter, so what is encoded is the word without them."""
        parts, plain, new = {}, set(), set()
        for w in self.words.missing(words):
            if w.isalpha() and w.islower() and (w.isascii() or latin(w)):
                plain.add(w)
                continue
            core = w.rstrip(MARKS)
            # a letter that isn't one character for ever, or a word that is never read as letters, keeps its marks
            if not core or not core[-1].isalpha() or len(core[-1].lower()) > 1 or not unicodedata.is_normalized("NFC", core[-1]) or self.special.search(w.encode().lower()):
                new.add(w)
                continue
            end = w[len(core):]
            if latin(core):
                core = core.lower()
                plain.add(core)
            else:
                new.add(core)
            new.add(end)
            if end or core != w:
                parts[w] = core, end
        known = self.words.known  # may be another generation now
        self.learn_plain([x for x in plain if x not in known])
        new = [x for x in new if x not in known]
        for i in range(0, len(new), 50_000):
            some = new[i:i + 50_000]
            for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.words.put(w, array("I", e.ids).tobytes())
        for w, (core, end) in parts.items():
            self.words.put(w, known[core] + known[end])

    def learn_plain(self, words: list[str]) -> None:
        """Ids of new words of small letters of Latin-1: many as one text, where the model's tokens tell the last of each."""
        for i in range(0, len(words), TOGETHER):
            some = words[i:i + TOGETHER]
            if self.plain:
                ids = np.array(self.plain.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
                last = np.flatnonzero(self.ends[ids]) + 1
                if len(last) == len(some) and last[-1] == len(ids):
                    data, at = ids.tobytes(), [0, *(4 * last).tolist()]
                    self.words.put_all(some, [data[a:b] for a, b in itertools.pairwise(at)])
                    continue
            for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.words.put(w, array("I", e.ids).tobytes())

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        raw = [t.encode() for t in texts]
        # Special tokens are looked for in texts as they are: such texts are parted by blanks alone.
        whole = {i: texts[i].replace("\n", " ").split(" ") for i, t in enumerate(raw) if self.special.search(t.lower())}
        words, first = cut_words([b"" if i in whole else t for i, t in enumerate(raw)])
        words = words.dictionary_encode()
        distinct = listed(words.dictionary)
        self.learn(set(distinct).union(*whole.values()))
        known = self.words.known
        found = list(map(known.__getitem__, distinct))
        offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))))
        ids = pa.Array.from_buffers(pa.large_binary(), len(found), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(found))]).take(words.indices)
        at, data = np.frombuffer(ids.buffers()[1], np.int64)[first].tolist(), memoryview(ids.buffers()[2] or b"")
        return [b"".join(map(known.__getitem__, whole[i])) if i in whole else bytes(data[a:b]) for i, (a, b) in enumerate(itertools.pairwise(at))]


def word_by_word(spec: dict) -> bool:
    """Whether a tokenizer's file says that blanks and line feeds part all it joins, that case doesn't matter, and that nothing is put before or after a text."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    first = steps[0]
    split = first.get("type") == "Split" and first.get("pattern") == {"Regex": SPLIT} and first.get("behavior") == "Removed" and first.get("invert")
    rest = all(s.get("type") == "ByteLevel" and not s.get("add_prefix_space") and not s.get("use_regex") for s in steps[1:])
    special = all(t.get("special") and not t.get("normalized") and not any(c.isspace() for c in t["content"]) and not any(t.get(k) for k in ("single_word", "lstrip", "rstrip")) for t in spec.get("added_tokens") or [])
    return bool(split and rest and special and (spec.get("normalizer") or {}).get("normalizers") == NORMALIZERS and not spec.get("truncation") and not spec.get("padding"))


_WORDS: dict[str, Words] = {}


def words(blob: bytes, by_word: bool, remembered: int) -> Words:
    key = hashlib.sha256(blob).hexdigest()
    if key not in _WORDS:
        _WORDS[key] = Words(blob, by_word)
    _WORDS[key].words.most = remembered
    return _WORDS[key]


class Packer:
    """Packs examples that are offered one after the other. An example is (key, start, tokens, loss); with `cut`, a piece of one fills what is left of a
    sequence, and a last, partly filled sequence is dealt into sequences of a power of two of tokens, which need no padding."""

    def __init__(self, tokens: int, segments: int, loss: int, cut: bool):
        self.capacity = np.array([tokens, segments, loss], float)
        self.tokens, self.cut, self.pool = tokens, cut, []

    def offer(self, key, tokens: int, loss: int) -> Iterator[list]:
        """Sequences that this example makes full; each a list of (key, start, length)."""
        start = 0
        most = int(min(self.capacity[0], self.capacity[2])) if self.cut else tokens
        if not self.cut and (tokens > self.capacity[0] or loss > self.capacity[2]):
            raise ValueError(f"example {key} alone exceeds a sequence")
        while self.cut and tokens - start >= most:
            yield [(key, start, most)]
            start += most
        if tokens > start or (not self.cut and tokens == 0):
            self.pool.append((key, start, tokens - start, loss if not self.cut else min(loss, tokens - start)))
        if len(self.pool) >= POOL:
            yield from self.pack(POOL // 8)

    def pack(self, leave: int) -> Iterator[list]:
        """Packs until at most `leave` examples, and too few for a whole sequence when cutting, are left."""
        items = self.pool
        need = np.array([(n, 1, loss) for _, _, n, loss in items], float).reshape(-1, 3)
        alive = np.ones(len(items), bool)
        left = int(need[:, 0].sum())
        while alive.sum() > leave and (not self.cut or leave == 0 or left >= self.tokens):
            room, sequence = self.capacity.copy(), []
            while True:
                fits = np.flatnonzero(alive & (need <= room).all(axis=1))
                if not len(fits):
                    break
                score = (need[fits] / self.capacity) @ (room / self.capacity)
                i = int(fits[score.argmax()])
                alive[i] = False
                room -= need[i]
                left -= int(need[i, 0])
                sequence.append(items[i][:3])
            gap = int(min(room[0], room[2]))
            rest = np.flatnonzero(alive)
            if self.cut and gap > 0 and room[1] > 0 and len(rest):
                i = int(rest[need[rest, 0].argmin()])  # no example fits, so every one that waits is longer than the gap
                key, start, n, loss = items[i]
                sequence.append((key, start, gap))
                items[i] = (key, start + gap, n - gap, min(loss, n - gap))
                need[i] = (n - gap, 1, items[i][3])
                left -= gap
                gap = 0
            yield from self.by_powers(sequence) if self.cut and gap > 0 else [sequence]
        self.pool = [items[i] for i in np.flatnonzero(alive)]

    def by_powers(self, sequence: list) -> Iterator[list]:
        total = sum(n for _, _, n in sequence)
        waiting = sequence[::-1]
        while total:
            size = 1 << (total.bit_length() - 1)
            total -= size
            out = []
            while size:
                key, start, n = waiting.pop()
                take = min(n, size)
                out.append((key, start, take))
                size -= take
                if take < n:
                    waiting.append((key, start + take, n - take))
            yield out

    def finish(self) -> Iterator[list]:
        yield from self.pack(0)


def pack_examples(df: DataFrame, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, key: str = "example_id", n_tokens: str = "n_tokens", n_loss: str = "n_loss") -> DataFrame:
    """For instruction data: places whole examples under the three limits. One row per example: key, sequence_id, offset, length.

    Each partition packs its own rows, so nothing is shuffled. Null counts are 0; an example without tokens still takes a segment; one that exceeds a limit
    alone is an error; ties go to the first row; repeated rows are packed each; extra columns are left out."""
    base.ship(df.sparkSession)
    source = df.select(F.col(key).alias("k"), F.coalesce(F.col(n_tokens).cast("long"), F.lit(0)).alias("t"), F.coalesce(F.col(n_loss).cast("long"), F.lit(0)).alias("l"))
    kind = source.schema["k"].dataType.simpleString()

    def run(batches):
        packer, number = Packer(tokens, segments, loss, cut=False), [TaskContext.get().partitionId() << 40]

        def rows(sequences, type_):
            out = [[], [], [], []]
            for s in sequences:
                at = 0
                for k, _, n in s:
                    for column, value in zip(out, (k, number[0], at, n), strict=True):
                        column.append(value)
                    at += n
                number[0] += 1
            return pa.RecordBatch.from_arrays([pa.array(out[0], type_), *(pa.array(c, pa.int64()) for c in out[1:])], ["key", "sequence_id", "offset", "length"])

        type_ = None
        for batch in batches:
            type_ = batch.schema.field("k").type
            d = batch.to_pydict()
            yield rows((s for k, t, n in zip(d["k"], d["t"], d["l"], strict=True) for s in packer.offer(k, t, n)), type_)
        if type_ is not None:
            yield rows(packer.finish(), type_)

    return source.mapInArrow(run, f"key {kind}, sequence_id long, offset long, length long")


def pack_documents(df: DataFrame, tokenizer_path: str, tokens: int = TOKENS, segments: int = SEGMENTS, remembered: int = REMEMBERED) -> DataFrame:
    """Packs whole documents (doc_id, text) into sequences of at most `tokens`, cutting where it fills a sequence. One row per piece: doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and END; a null or empty text is END alone; every token bears loss. Each partition packs its own rows while it reads them: nothing
    is shuffled, and a task holds at most POOL remainders, each shorter than a sequence. Sequence ids are unique over partitions. Repeated rows are packed each;
    a null doc_id stays null; an empty table gives no rows; other columns are left out. Texts are encoded whole, however long. The last sequence of a task, where it isn't full,
    is dealt into sequences of powers of two, at most twelve, which need no padding. remembered: bytes of each of a worker's two generations of words."""
    spark = df.sparkSession
    base.ship(spark)
    with open(tokenizer_path, "rb") as f:
        file = f.read()
    by_word, blob = word_by_word(json.loads(file)), spark.sparkContext.broadcast(file)
    source = df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        encode = words(blob.value, by_word, remembered).encode
        packer, number = Packer(tokens, segments, tokens, cut=True), TaskContext.get().partitionId() << 40
        held: dict[int, list] = {}  # serial number of a document: doc_id, ids, tokens that have no place yet
        serial = 0

        def rows(sequences):
            nonlocal number
            out = [[] for _ in names]
            for s in sequences:
                at = 0
                for k, start, n in s:
                    doc = held[k]
                    row = (doc[0], start, n, zlib.crc32(doc[1][4 * start:4 * (start + n)]), len(doc[1]) // 4, number, at)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    at += n
                    doc[2] -= n
                    if not doc[2]:
                        del held[k]
                number += 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)

        end = END.to_bytes(4, "little")
        for batch in batches:
            texts, ids_of = batch.column("text"), batch.column("doc_id").to_pylist()
            for a, b in base.slices([len(t.as_buffer()) for t in texts], SLICE):
                made = []
                for doc_id, ids in zip(ids_of[a:b], encode(texts[a:b].to_pylist()), strict=True):
                    ids += end
                    held[serial] = [doc_id, ids, len(ids) // 4]
                    made += packer.offer(serial, len(ids) // 4, len(ids) // 4)
                    serial += 1
                yield rows(made)
        yield rows(packer.finish())

    return source.mapInArrow(base.trimmed(run), ", ".join(f"{n} long" for n in names))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(base.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
