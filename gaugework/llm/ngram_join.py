"""Operator 1: n-gram Jaccard self-join, exact. Shingles are hashed into groups and a set becomes the point of its group counts; an R-tree over the points bounds
the overlap of two sets by the sum of coordinate minima, and pairs that survive are verified on the sets.

A pair at the threshold differs in a tenth of its size, more than the spread of group counts of unrelated texts, so one tree over all points would prune little
and compare nearly all. Trees are therefore built over clusters. If two sets differ in at most d shingles, at most d groups of them differ; so if one of the two
has more than d groups of `crowd` shingles or more, the sets are equal in one such group at least. Sets send a signature for each crowded group; only those that
have d or fewer of them send signatures for the other groups too. Sets that share a signature, directly or through others, form a cluster; large clusters are cut
into blocks, and every two blocks of one meet. Groups of a few shingles alone would join all texts that share one frequent line; crowded ones don't, and the
others count only where the larger set of a pair has too few crowded ones, which is rare."""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugework.llm import base
from gaugework.llm.graph import components

#: Growth of the size bands within which sets are dealt into equally many groups.
BAND = 1.2
#: Limits of a block of a cluster: sets, and bytes of their hashes.
BLOCK_SETS, BLOCK_BYTES = 1024, 4 << 20
#: Bytes of texts that are hashed together.
SLICE = 2 << 20
#: Points in a leaf, and children of a node, of the tree.
LEAF, FAN = 32, 8
#: Signatures that one task sorts at a time (14 to 16 bytes each).
BUCKET_ROWS = 1_000_000
#: Ids are broadcast up to this many rows (16 bytes each); beyond, the join is shuffled.
BROADCAST_ROWS = 1_000_000


class Threshold:
    """Jaccard similarity of at least num / den, in integers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        #: Fewest shingles of a crowded group: half of what a group would hold if there were as many as shingles that may differ.
        self.crowd = max(1, (den + num) // (4 * (den - num))) if den > num else 1
        #: Shingles a group on average, such that most groups for the size of the set are crowded.
        self.load = max(np.arange(0.5, 20, 0.01), key=self._crowded)

    def _crowded(self, load: float) -> float:
        few = sum(load ** i / math.factorial(i) for i in range(self.crowd))
        return (1 - math.exp(-load) * few) / load

    def differing(self, size: int) -> int:
        """The most shingles in which two linked sets of at most `size` differ: |A| + |B| - 2|A & B| with |A & B| (den + num) >= num (|A| + |B|)."""
        return 2 * size * (self.den - self.num) // (self.den + self.num)

    def linked(self, common, total):
        """total: |A| + |B|."""
        return common * (self.den + self.num) >= self.num * total

    def bands(self, n: int) -> list[tuple[int, int, int]]:
        """(largest size, differing, groups) of the bands in which a set of n shingles can meet a partner as large or larger, or is the larger one. Equal sets are
        joined by their digest, so bands where linked sets are equal are left out."""
        out, low, high = [], 1, 1
        while low * self.num <= n * self.den:
            if n <= high and (d := self.differing(high)):
                out.append((high, d, max(d + 1, round(high / self.load))))
            low, high = high + 1, max(high + 1, int(high * BAND))
        return out


_BANDS: dict[tuple, list] = {}


def signatures(h: np.ndarray, t: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that stand for (band, group, the shingles of the set in that group), and which of them are hubs: all of crowded groups; of the others, those in the
    band where the set is the larger one. A pair that no crowded group shows shares a hash that is a hub of its larger set."""
    key = (len(h), t.num, t.den)
    if key not in _BANDS:
        if len(_BANDS) > 50_000:
            _BANDS.clear()
        _BANDS[key] = t.bands(len(h))
    low, high = (h & np.uint64(0xFFFFFFFF)).astype(np.float64), (h >> np.uint64(32)).astype(np.float64)
    out, hubs = [np.empty(0, np.uint64)], [np.empty(0, bool)]
    with np.errstate(over="ignore"):
        for own, (band, d, groups) in enumerate(_BANDS[key]):
            g = (h % np.uint64(groups)).astype(np.int64)
            count = np.bincount(g, minlength=groups)
            a = np.bincount(g, weights=low, minlength=groups).astype(np.uint64)
            b = np.bincount(g, weights=high, minlength=groups).astype(np.uint64)
            sent = count >= t.crowd
            if sent.sum() <= d:
                sent = count > 0
                if sent.sum() <= d:  # the group that is equal may be an empty one
                    out.append(base.mix(np.array([band << 1 | 1], np.uint64)))
                    hubs.append(np.array([own == 0]))
            place = base.mix(np.flatnonzero(sent).astype(np.uint64) << np.uint64(1) | np.uint64(band << 33))
            out.append(base.mix(base.mix(a[sent] ^ place) + b[sent]))
            hubs.append((count[sent] >= t.crowd) | (own == 0))
    return np.concatenate(out), np.concatenate(hubs)


def shingle_sets(raw: list[bytes], k: int):
    """The sorted distinct shingle hashes of each text; A-Z count as a-z."""
    words, counts = base.word_hashes([r.lower() for r in raw])
    at = 0
    for n in counts.tolist():
        yield np.unique(base.shingle_hashes(words[at:at + n], k))
        at += n


def digest(h: np.ndarray) -> tuple[int, int]:
    """128 bits of a set; an empty one has none."""
    if not len(h):
        return None, None
    with np.errstate(over="ignore"):
        a = np.bitwise_xor.reduce(base.mix(h))
        b = np.add.reduce(base.mix(h ^ np.uint64(0xD1B54A32D192ED03)))
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _texts(batch: pa.RecordBatch, name: str):
    column = batch.column(name)
    for a, b in base.slices([len(t.as_buffer()) for t in column], SLICE):
        yield a, b, [t.as_buffer().to_pybytes() for t in column[a:b]]


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("rep"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def digests(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n, d1, d2 (digest of the set; null if it is empty) of every row."""

    def run(batches):
        for batch in batches:
            for a, b, raw in _texts(batch, "text"):
                sets = list(shingle_sets(raw, k))
                d = [digest(h) for h in sets]
                yield pa.RecordBatch.from_arrays([batch.column("rep")[a:b], pa.array(map(len, sets), pa.int64(), size=b - a), *(pa.array(x, pa.int64()) for x in zip(*d, strict=True))], ["doc_id", "n", "d1", "d2"])

    return _source(docs).mapInArrow(base.trimmed(run), "doc_id long, n long, d1 long, d2 long")


def _without(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of df whose `column` isn't in ids (one column of another name)."""
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(ids) if few else ids, F.col(column) == F.col(ids.columns[0]), "left_anti")


def packed(key: np.ndarray, rep: np.ndarray, kept: int = 6) -> bytes:
    """Pairs of a signature and a document as bytes: `kept` of the signature (one that agrees by chance joins two clusters more, no more than that), and the document's
    distance from the least in as few as hold them all."""
    low = int(rep.min())
    away = (rep - low).astype(np.uint64)
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(away.max()) < 1 << 8 * w)
    keys = key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :kept]
    return struct.pack("<IBq", len(key), width, low) + keys.tobytes() + away.astype(f"<u{width}").tobytes()


def unpacked(blob: bytes, kept: int = 6) -> tuple[np.ndarray, np.ndarray]:
    n, width, low = struct.unpack_from("<IBq", blob)
    at = struct.calcsize("<IBq")
    keys = np.zeros((n, 8), np.uint8)
    keys[:, :kept] = np.frombuffer(blob, np.uint8, kept * n, at).reshape(n, kept)
    away = np.frombuffer(blob, f"<u{width}", n, at + kept * n)
    return keys.reshape(-1).view("<u8"), away.astype(np.int64) + low


def dealt(key: np.ndarray, rep: np.ndarray, bucket: np.ndarray, kept: int = 6) -> pa.RecordBatch:
    """Rows (bucket, rows), one of packed pairs for each bucket."""
    order = np.argsort(bucket, kind="stable")
    key, rep, bucket = key[order], rep[order], bucket[order]
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    blobs = [packed(key[i:j], rep[i:j], kept) for i, j in zip(cuts, [*cuts[1:], len(key)], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts].astype(np.int64)), pa.array(blobs, pa.binary())], ["bucket", "rows"])


def gathered(batches, kept: int = 6):
    """(key, rep) of each bucket, from rows sorted by bucket."""
    now, waiting = None, []
    for batch in batches:
        for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("rows"), strict=True):
            if bucket != now and waiting:
                yield tuple(np.concatenate(x) for x in zip(*waiting, strict=True))
                waiting = []
            now = bucket
            waiting.append(unpacked(blob.as_buffer().to_pybytes(), kept))
    if waiting:
        yield tuple(np.concatenate(x) for x in zip(*waiting, strict=True))


def centers(key: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, rep) in order, whether a row is joined to a hub, and the hub (the least of its signature). The last bit of a key is 0 for hubs."""
    order = np.lexsort((rep, key))
    key, rep = key[order], rep[order]
    sig = key >> np.uint64(1)
    new = np.concatenate(([True], sig[1:] != sig[:-1]))
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    return key, rep, (key[first] & np.uint64(1) == 0) & ~new, rep[first]


def stars(docs: DataFrame, k: int, t: Threshold, n_rows: int) -> DataFrame:
    """u, v: each document of (rep, text) with the first hub that shares a signature with it; signatures without a hub join nothing.

    Signatures are dealt into buckets of about BUCKET_ROWS (n_rows: about how many there are). Where a slice of a task has a hub, it sends on one row for the
    signature and joins the others to it at once, so a signature that very many sets share is combined before the shuffle."""
    salts, buckets = 64, max(base.parallelism(docs.sparkSession), -(-n_rows // BUCKET_ROWS))

    def combine(batches):
        for batch in batches:
            for s, e, raw in _texts(batch, "text"):
                found = [signatures(h, t) for h in shingle_sets(raw, k)]
                sig, hub = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
                if not len(sig):
                    continue
                rep = np.repeat(batch.column("rep")[s:e].to_numpy(), [len(x) for x, _ in found])
                key, rep, joined, center = centers(sig << np.uint64(1) | (~hub).astype(np.uint64), rep)
                edges = np.unique(np.stack([center[joined], rep[joined]]), axis=1)
                center, other = edges[:, edges[0] != edges[1]]
                # a known star has a signature of its own, of which its center is the hub, dealt by salts as it may be large
                with np.errstate(over="ignore"):
                    star = base.mix(base.mix(center.astype(np.uint64)) + (other % salts).astype(np.uint64)) << np.uint64(1)
                key = np.concatenate([key[~joined], star, star | np.uint64(1)]) & np.uint64((1 << 48) - 1)
                rep = np.concatenate([rep[~joined], center, other])
                yield dealt(key, rep, (key >> np.uint64(1)) % np.uint64(buckets))

    def meet(batches):
        for key, rep in gathered(batches):
            _, rep, joined, center = centers(key, rep)
            edges = np.unique(np.stack([rep[joined], center[joined]]), axis=1)
            u, v = edges[:, edges[0] != edges[1]]
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    rows = docs.mapInArrow(base.trimmed(combine), "bucket long, rows binary")
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(base.trimmed(meet), "u long, v long").distinct()


# ---- the tree ----


class Node:
    __slots__ = ("children", "high", "least", "most", "points")

    def __init__(self, high, least, most, points=None, children=()):
        self.high, self.least, self.most, self.points, self.children = high, least, most, points, children


def build(counts: np.ndarray, sizes: np.ndarray) -> Node:
    """An R-tree packed by sorting and tiling: by size first, then by the coordinate that varies most. Of the boxes, only upper corners bound an overlap."""

    def tiles(index: np.ndarray) -> list[np.ndarray]:
        if len(index) <= LEAF:
            return [index]
        values = counts[index]
        by = sizes[index] if np.ptp(sizes[index]) > 0.2 * sizes[index].max() else values[:, values.var(axis=0).argmax()]
        index = index[np.argsort(by, kind="stable")]
        half = -(-len(index) // LEAF) // 2 * LEAF
        return tiles(index[:half]) + tiles(index[half:])

    nodes = [Node(counts[i].max(axis=0), sizes[i].min(), sizes[i].max(), points=i) for i in tiles(np.arange(len(sizes)))]
    while len(nodes) > 1:
        groups = [nodes[i:i + FAN] for i in range(0, len(nodes), FAN)]
        nodes = [Node(np.max([x.high for x in g], axis=0), min(x.least for x in g), max(x.most for x in g), children=g) for g in groups]
    return nodes[0]


class Forest:
    """Union-find over positions, with labels as an array."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: int, b: int) -> None:
        x, y = sorted((self.label[a], self.label[b]))
        self.label[self.label == y] = x


def near_pairs(counts: np.ndarray, sizes: np.ndarray, side: np.ndarray, t: Threshold, label: np.ndarray):
    """(positions, positions) of pairs whose summed coordinate minima allow a link, leaf by leaf, from a join of two trees; pairs of one label are left out, and
    labels may change between leaves. side: 0 and 1 for two blocks, whose pairs across are wanted; all 0 for one block with itself."""
    index = [np.flatnonzero(side == s) for s in (0, 1)]
    if not len(index[0]):
        return
    one = not len(index[1])
    trees = [build(counts[i], sizes[i]) for i in index if len(i)]
    where = (index[0], index[0] if one else index[1])
    stack = [(trees[0], trees[-1])]
    while stack:
        a, b = stack.pop()
        if a.most * t.den < b.least * t.num or b.most * t.den < a.least * t.num:
            continue
        if not t.linked(int(np.minimum(a.high, b.high).sum()), int(a.least + b.least)):
            continue
        if a.points is None or b.points is None:
            if a is b:
                stack += [(x, y) for i, x in enumerate(a.children) for y in a.children[i:]]
            elif b.points is not None or (a.points is None and a.most - a.least >= b.most - b.least):
                stack += [(x, b) for x in a.children]
            else:
                stack += [(a, y) for y in b.children]
            continue
        p, q = where[0][a.points], where[1][b.points]
        other = label[p][:, None] != label[q][None, :]
        if not other.any():
            continue
        near = other & t.linked(np.minimum(counts[p][:, None, :], counts[q][None, :, :]).sum(axis=2, dtype=np.int64), sizes[p][:, None] + sizes[q][None, :])
        if a is b:
            near &= np.tri(len(p), k=-1, dtype=bool)
        x, y = np.nonzero(near)
        if len(x):
            yield p[x], q[y]


def points(sets: list[np.ndarray], groups: int) -> np.ndarray:
    return np.stack([np.bincount((base.mix(s) % np.uint64(groups)).astype(np.int64), minlength=groups) for s in sets]).astype(np.int32)


def cluster_links(sets: list[np.ndarray], side: np.ndarray, t: Threshold) -> list[tuple[int, int]]:
    """Verified pairs that connect whatever links connect."""
    sizes = np.array([len(s) for s in sets])
    counts = points(sets, 1 << int(np.clip(np.ceil(np.log2(max(np.median(sizes) / 3, 1))), 4, 10)))
    forest, out = Forest(len(sets)), []
    for p, q in near_pairs(counts, sizes, side, t, forest.label):
        for i, j in zip(p.tolist(), q.tolist(), strict=True):
            if forest.label[i] != forest.label[j]:
                small, large = (sets[i], sets[j]) if sizes[i] <= sizes[j] else (sets[j], sets[i])
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                if t.linked(int((large[at] == small).sum()), int(sizes[i] + sizes[j])):
                    out.append((i, j))
                    forest.join(i, j)
    return out


def near_links(counts: np.ndarray, sizes: np.ndarray, side: np.ndarray, t: Threshold) -> list[tuple[int, int]]:
    """Pairs that connect whatever pairs within the bound connect."""
    forest, out = Forest(len(sizes)), []
    for p, q in near_pairs(counts, sizes, side, t, forest.label):
        for i, j in zip(p.tolist(), q.tolist(), strict=True):
            if forest.label[i] != forest.label[j]:
                out.append((i, j))
                forest.join(i, j)
    return out


def _cells(key: tuple[str, ...], solve):
    """A function for mapInArrow over batches sorted by `key`, then rep: solve(values, sides, ns) of each run of equal keys gives pairs of positions, of which the
    reps come out as u and v. Columns: key, side, rep, n, value. A repeated rep (a repeated row) counts once."""

    def run(batches):
        cell, reps, sides, ns, values, found = None, [], [], [], [], []

        def close():
            if len(reps) > 1:
                found.extend((reps[a], reps[b]) for a, b in solve(values, np.array(sides), np.array(ns)))

        def out():
            return pa.RecordBatch.from_pydict({"u": pa.array([x for x, _ in found], pa.int64()), "v": pa.array([x for _, x in found], pa.int64())})

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in key), strict=True)
            for k, rep, side, n, value in zip(keys, *(batch.column(c).to_pylist() for c in ("rep", "side", "n")), batch.column("value"), strict=True):
                if k != cell:
                    close()
                    cell, reps, sides, ns, values = k, [], [], [], []
                if not reps or rep != reps[-1]:
                    reps.append(rep)
                    sides.append(side)
                    ns.append(n)
                    values.append(value.as_buffer().to_pybytes())
            yield out()
            found = []
        close()
        yield out()

    return run


def _chosen(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Texts of the chosen documents (rep and more), which are broadcast if they are few."""
    few = chosen.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return _source(docs).join(F.broadcast(chosen) if few else chosen, "rep")


def _spread(own: int, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, j and side of the cells (i <= j) of a member of block `own` out of `blocks`."""
    other = np.arange(blocks, dtype=np.int32)
    return np.minimum(own, other).astype(np.int32), np.maximum(own, other).astype(np.int32), (own > other).astype(np.int32)


def _blocked(members: DataFrame, key: list[str], bytes_each) -> DataFrame:
    """members with blocks and own: how many blocks their group has, and which of them is theirs."""
    size = members.groupBy(*key).agg(F.count("*").alias("m"), F.sum(bytes_each).alias("b"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK_SETS), F.ceil(F.col("b") / BLOCK_BYTES)).cast("int")
    joined = members.join(size.select(*key, blocks.alias("blocks")), key)
    return joined.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))


def repeated(texts: DataFrame, k: int, n_rows: int) -> DataFrame:
    """rep, h, df: shingles (h, hashed with the cluster) that several of the documents (rep, root, text) of a cluster have, and how many have them. n_rows: about how
    many shingles there are."""
    buckets = max(base.parallelism(texts.sparkSession), -(-n_rows // BUCKET_ROWS))

    def deal(batches):
        for batch in batches:
            for a, b, raw in _texts(batch, "text"):
                sets = list(shingle_sets(raw, k))
                size = [len(h) for h in sets]
                with np.errstate(over="ignore"):
                    h = base.mix(np.concatenate(sets) + base.mix(np.repeat(batch.column("root")[a:b].to_numpy().astype(np.uint64), size)))
                if len(h):
                    yield dealt(h, np.repeat(batch.column("rep")[a:b].to_numpy(), size), h % np.uint64(buckets), 8)

    def count(batches):
        for h, rep in gathered(batches, 8):
            order = np.lexsort((rep, h))
            h, rep = h[order], rep[order]
            once = np.concatenate(([True], (h[1:] != h[:-1]) | (rep[1:] != rep[:-1])))  # a repeated row counts once
            h, rep = h[once], rep[once]
            _, at, df = np.unique(h, return_inverse=True, return_counts=True)
            df = df[at]
            some = df > 1
            yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(h[some].view(np.int64)), pa.array(df[some].astype(np.int64))], ["rep", "h", "df"])

    rows = texts.mapInArrow(base.trimmed(deal), "bucket long, rows binary")
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(base.trimmed(count), "rep long, h long, df long")


def parted(docs: DataFrame, members: DataFrame, k: int, t: Threshold) -> DataFrame:
    """Clusters (node, root) into which links can part those of members (rep, root, n); a document that can't link is left out.

    A document of n shingles shares ceil(n * num / den) of them at least with any that it links with. In one order of all shingles, here that of how many documents of the
    cluster have them, the first shared one is thus among the first n - ceil(n * num / den) + 1 of either. So documents that share a passage alone part, as what very
    many have comes last, and how often a passage recurs doesn't matter. Shingles of one document alone come first and join nothing."""
    total = members.agg(F.sum("n")).first()[0]
    rows = repeated(_chosen(docs, members.select("rep", "root").distinct()), k, total)
    # a row without h brings the size of its document: a join would look it up for each shingle
    rows = rows.unionByName(members.select("rep", F.lit(None).cast("long").alias("h"), F.col("n").alias("df")))
    whole = Window.partitionBy("rep")
    rows = rows.withColumn("have", F.count("h").over(whole)).withColumn("n", F.min(F.when(F.col("h").isNull(), F.col("df"))).over(whole))
    rows = rows.withColumn("least", F.expr(f"(n * {t.num} + {t.den - 1}) div {t.den}")).where("h IS NOT NULL AND have >= least")
    rows = rows.withColumn("place", F.rank().over(whole.orderBy("df", "h"))).where("place <= have - least + 1")
    first = base.written(rows.select("rep", "h"))
    counted = base.written(first.groupBy("h").agg(F.min("rep").alias("v"), F.count("*").alias("n")).where("n > 1"))
    return components(base.join_counted(first, counted, ["h"], first.count()).select(F.col("rep").alias("u"), "v"))


def refined(docs: DataFrame, clusters: DataFrame, sizes: DataFrame, k: int, t: Threshold) -> DataFrame:
    """Clusters (node, root), of which those of more than BLOCK_SETS documents are parted by what links must share, and what is left of that size is cut along pairs beyond
    the bound. Members meet in size bands as points alone, an eighth as many coordinates as shingles, which are far smaller than their sets."""
    found = clusters
    for again in (False, True):
        members = base.written(found.select(F.col("node").alias("rep"), "root").join(sizes, "rep"))
        large = base.written(members.groupBy("root").count().where(F.col("count") > BLOCK_SETS).select("root"))
        if large.isEmpty():
            return found
        if not again:
            small = members.join(large, "root", "left_anti").select(F.col("rep").alias("node"), "root")
            found = base.written(small.unionByName(parted(docs, members.join(large, "root", "left_semi"), k, t)))
            base.release(docs.sparkSession)

    def banded(batches):
        for batch in batches:
            rows = [(rep, root, n, u) for rep, root, n in zip(*(batch.column(c).to_pylist() for c in ("rep", "root", "n")), strict=True) for u, _, _ in t.bands(n)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 4)], ["rep", "root", "n", "band"])

    big = members.join(large, "root", "left_semi")
    cells = _blocked(big.select("rep", "root", "n").mapInArrow(banded, "rep long, root long, n long, band long"), ["root", "band"], F.col("band") / 4)
    chosen = base.written(cells.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("root", "band", "blocks", "own"))).alias("cells")))
    names = ["root", "band", "i", "j", "side", "rep", "n", "value"]

    def pointed(batches):
        for batch in batches:
            for a, b, raw in _texts(batch, "text"):
                for rep, places, h in zip(batch.column("rep")[a:b].to_pylist(), batch.column("cells")[a:b].to_pylist(), shingle_sets(raw, k), strict=True):
                    for x in places:
                        i, j, side = _spread(x["own"], x["blocks"])
                        n = len(i)
                        value = points([h], max(16, x["band"] // 8))[0].astype("<u2" if len(h) < 1 << 16 else "<u4").tobytes()
                        longs = [pa.array([v] * n, pa.int64()) for v in (x["root"], x["band"])]
                        yield pa.RecordBatch.from_arrays([*longs, pa.array(i), pa.array(j), pa.array(side), pa.array([rep] * n, pa.int64()), pa.array([len(h)] * n, pa.int64()), pa.array([value] * n, pa.binary())], names)

    def solve(values, sides, ns):
        counts = np.stack([np.frombuffer(v, "<u2" if n < 1 << 16 else "<u4") for v, n in zip(values, ns.tolist(), strict=True)]).astype(np.int32)
        return near_links(counts, ns, sides, t)

    key = ("root", "band", "i", "j")
    rows = _chosen(docs, chosen).mapInArrow(base.trimmed(pointed), "root long, band long, i int, j int, side int, rep long, n long, value binary")
    edges = rows.repartition(*key).sortWithinPartitions(*key, "rep").mapInArrow(base.trimmed(_cells(key, solve)), "u long, v long")
    small = members.join(large, "root", "left_anti").select(F.col("rep").alias("node"), "root")
    return small.unionByName(components(edges))


def verified(docs: DataFrame, clusters: DataFrame, sizes: DataFrame, k: int, t: Threshold) -> DataFrame:
    """u, v: links that connect what is linked, within clusters (node, root). sizes: rep and n. Texts of clusters alone are hashed again; each set goes once to every
    block of its cluster, which is one but for large clusters."""
    members = clusters.select(F.col("node").alias("rep"), "root").join(sizes, "rep")
    chosen = base.written(_blocked(members, ["root"], F.col("n") * 8).select("rep", "root", "blocks", "own"))
    names = ["root", "i", "j", "side", "rep", "n", "value"]

    def hashed(batches):
        for batch in batches:
            for a, b, raw in _texts(batch, "text"):
                columns = (batch.column(c)[a:b].to_pylist() for c in ("rep", "root", "blocks", "own"))
                for rep, root, blocks, own, h in zip(*columns, shingle_sets(raw, k), strict=True):
                    i, j, side = _spread(own, blocks)
                    n = len(i)
                    longs = [pa.array([v] * n, pa.int64()) for v in (root, rep, len(h))]
                    yield pa.RecordBatch.from_arrays([longs[0], pa.array(i), pa.array(j), pa.array(side), *longs[1:], pa.array([h.tobytes()] * n, pa.binary())], names)

    def solve(values, sides, ns):
        return cluster_links([np.frombuffer(v, np.uint64) for v in values], sides, t)

    key = ("root", "i", "j")
    rows = _chosen(docs, chosen).mapInArrow(base.trimmed(hashed), "root long, i int, j int, side int, rep long, n long, value binary")
    return rows.repartition(*key).sortWithinPartitions(*key, "rep").mapInArrow(base.trimmed(_cells(key, solve)), "u long, v long")


def join(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text): the least doc_id that links reach, itself included, where documents link whose sets of
    k-word shingles have a Jaccard similarity of at least num / den. Exact up to collisions of 64-bit hashes.

    Words are runs without white space, A-Z as a-z. A text of fewer than k words is one shingle; a null text, or one without words, has none and links with
    nothing. Texts are worked on whole. Equal sets are one class, whose copies are never paired; repeated rows with one doc_id are one document; a null doc_id links
    with nothing. An empty table gives no rows. Extra columns are left out."""
    base.ship(docs.sparkSession)
    t = Threshold(num, den)
    docs = base.own_columns(docs, "doc_id", "text")
    prints = base.written(digests(docs, k))
    sets = prints.where("d1 IS NOT NULL AND doc_id IS NOT NULL")
    # copies: how many rows have the set; a class of very many of them is no hot key (see join_counted)
    classes = base.written(sets.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.first("n").alias("n"), F.count("*").alias("copies")))
    n_rows = prints.count()
    counted = base.written(classes.where("rep <> last").select("d1", "d2", "rep", F.col("copies").alias("n")))
    copies = base.join_counted(sets.select("d1", "d2", "doc_id"), counted, ["d1", "d2"], n_rows).where("doc_id <> rep").select(F.col("doc_id").alias("copy"))
    alone = _without(_source(docs).where("rep IS NOT NULL"), base.written(copies), "rep")
    sizes = classes.select("rep", "n")
    total = classes.agg(F.sum("n")).first()[0] or 0  # about one signature for each shingle of a class
    found = components(stars(alone, k, t, total))
    base.release(docs.sparkSession)
    clusters = refined(docs, found, sizes, k, t)
    linked = components(verified(docs, clusters, sizes, k, t))
    named = classes.join(linked.withColumnRenamed("node", "rep"), "rep", "left").where("rep <> last OR root IS NOT NULL")
    named = base.written(named.select("d1", "d2", F.coalesce("root", "rep").alias("root"), F.col("copies").alias("n")))
    found = base.join_counted(prints.withColumnRenamed("n", "n_shingles"), named, ["d1", "d2"], n_rows, "left")
    return found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of docs, with all their columns, whatever they are called, without those of documents that a smaller doc_id of their component stands for. Rows with a null
    doc_id or without words stay, as do rows that repeat a doc_id that stays; an empty table gives no rows."""
    own = base.plain(docs, "doc_id", "text")
    gone = base.written(join(own, k, num, den).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct())
    return _without(own, gone, "doc_id").toDF(*docs.columns)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(base.table(spark, sf_dir, "documents"), k=3, num=9, den=10)
