"""Operator 6: quality rules. Counts that need no model, and a log-likelihood ratio of hashed word 1- and 2-grams between the multinomials of a trusted target
(documents labelled as good) and of the raw corpus (all documents), for each n-gram of a document. The target is weighted to the raw corpus's mix of languages and
sources, so that a document isn't judged by how many of its kind are labelled. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.llm import base

#: Buckets of the n-gram hash; the table of their weights, a number each, is what is sent to the tasks.
BUCKETS = 1 << 14
#: Counts that the raw distribution weighs as the target's prior: with far fewer trusted n-grams than these, every ratio is near 0.
PRIOR = 10 * BUCKETS
#: The columns, where there are any, whose mix the target takes from the raw corpus; each of their groups has its share of PRIOR, and so many counts at least.
STRATA = ("lang", "source")
LEAST_PRIOR = BUCKETS
#: Documents below this log-likelihood ratio an n-gram (nats) are rejected.
LEAST_RATIO = -0.04
#: Fewest words, and the largest share of words in repeated windows (percent), of the base rules.
LEAST_WORDS, MOST_REPEATED = 50, 50
WINDOW = 3
#: Up to so many distinct repeated windows of a text are looked up in a list.
FEW_REPEATS = 8
#: Labelled ids and strata are broadcast up to this many rows (8 bytes each); beyond, the join is shuffled.
BROADCAST_ROWS = 1_000_000
SYMBOLS = r"[#*$%&|<>]"


def word_array(text: Column) -> Column:
    """Hashes of the words of a text, in order."""
    found = F.filter(F.split(text, base.WORD_SPACE + "+"), lambda w: w != "")
    return F.transform(found, lambda w: F.xxhash64(w))


def bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def two_grams(words: Column, of) -> Column:
    """of(hash) for each pair of neighbouring words."""
    return F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), lambda h, i: of(F.xxhash64(h, F.get(words, i + 1))))


def ngram_buckets(words: Column) -> Column:
    """The buckets of all 1-grams and 2-grams, from the word hashes."""
    return F.concat(F.transform(words, bucket), two_grams(words, bucket))


def strata_weights(flagged: DataFrame) -> tuple[DataFrame, float]:
    """The strata of flagged (STRATA, text, good), with `good_weight` and `back_weight` of an n-gram in a good and in any document of theirs, and the sum of the back
    weights by the strata's shares. A stratum's target is its good n-grams, smoothed by its raw ones with its prior; its share is that among the raw ones. Without good
    documents it is thus the raw stratum, which speaks neither for nor against."""
    n = F.greatest(2 * F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long") - 1, F.lit(0))
    rows = base.written(flagged.select(*STRATA, "good", n.alias("n")).groupBy(*STRATA).agg(F.sum("n").alias("raw"), F.sum(F.col("good") * F.col("n")).alias("target")))
    total = rows.agg(F.sum("raw")).first()[0]
    share = F.col("raw") / F.lit(float(total)) if total else F.lit(0.0)
    prior = F.greatest(PRIOR * share, F.lit(float(LEAST_PRIOR)))
    strata = rows.select(*STRATA, share.alias("share"), (share / (F.col("target") + prior)).alias("good_weight"), (prior / (F.col("target") + prior)).alias("back_weight"))
    return strata.drop("share"), strata.agg(F.sum(F.col("share") * F.col("back_weight"))).first()[0] if total else 1.0


def weights(docs: DataFrame, trusted: DataFrame) -> Column:
    """log(target / raw) of every bucket, as an array literal. Raw counts have one added to each bucket; the target's prior is the raw distribution, with the weight of
    PRIOR counts, so that few trusted documents say little rather than speak against all that they lack; both stratum by stratum (see strata_weights). All documents
    are counted; what reaches the driver is one row of BUCKETS numbers. Without documents or trusted ids every weight is 0."""
    ids = trusted.select(F.col("doc_id").alias("__id")).where("__id IS NOT NULL").distinct()
    if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    kinds = [(F.col(c) if c in docs.columns else F.lit(None)).cast("string").alias(c) for c in STRATA]
    flagged = docs.select("doc_id", "text", *kinds).join(ids, F.col("doc_id") == F.col("__id"), "left").withColumn("good", F.col("__id").isNotNull().cast("long"))
    strata, back = strata_weights(flagged)
    strata = strata.withColumnsRenamed({c: f"__{c}" for c in STRATA})
    if strata.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        strata = F.broadcast(strata)
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in STRATA]
    weighed = flagged.join(strata, same).select((F.col("good") * F.col("good_weight")).alias("good_weight"), "back_weight", word_array(F.coalesce("text", F.lit(""))).alias("words"))
    counts = weighed.select("good_weight", "back_weight", F.explode(ngram_buckets(F.col("words"))).alias("b"))
    counts = counts.groupBy("b").agg(F.count("*").alias("raw"), F.sum("good_weight").alias("target"), F.sum("back_weight").alias("back"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left").na.fill(0)
    every = every.groupBy().agg(F.sum("raw").alias("n_raw"), F.sort_array(F.collect_list(F.struct("b", "raw", "target", "back"))).alias("rows"))
    size = F.col("n_raw") + BUCKETS
    ratio = F.transform("rows", lambda r: F.log((r["target"] * size + r["back"] + F.lit(back)) / (r["raw"] + 1)))
    told = every.select(F.array_join(F.transform(ratio, lambda x: x.cast("string")), ",")).first()[0]
    return F.split(F.lit(told), ",").cast("array<double>")


def measured(docs: DataFrame, weight: Column) -> DataFrame:
    """docs (any columns, with text) and, in one struct column `q`: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ratio, base_failed, kept."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    first = docs.select(
        F.struct(*docs.columns).alias("__row"),
        word_array(text).alias("w"),
        (F.length(text) - F.regexp_count(text, F.lit(base.WORD_SPACE))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    n = F.size("w")
    windows = F.transform(F.slice("w", F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(0))), lambda h, i: F.xxhash64(h, *(F.get("w", i + j) for j in range(1, WINDOW))))
    add = lambda t, x: t + x
    score = lambda h: F.get(weight, bucket(h))
    total = F.aggregate("w", F.lit(0.0), lambda t, h: t + score(h)) + F.aggregate(two_grams(F.col("w"), score), F.lit(0.0), add)
    second = first.select(
        "__row", "word_chars", "n_symbols", n.cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.try_divide(total, F.greatest(2 * n - 1, F.lit(0)).cast("double")).alias("ratio"),
        windows.alias("v"),
    )
    kept = ["__row", "word_chars", "n_symbols", "n_words", "n_dup_lines", "ratio"]
    # most texts repeat no window: they are told by their distinct windows, and only the others are sorted
    third = second.select(*kept, "v", F.when(F.size(F.array_distinct("v")) < F.size("v"), F.sort_array("v")).alias("o"))
    repeats = F.array_distinct(F.filter("o", lambda x, j: x == F.get("o", j + 1)))
    fourth = third.select(*kept, "v", repeats.alias("r"))
    # few repeated windows are looked up in a list; many are found by sorting windows with their places
    pairs = F.when(F.size("r") > FEW_REPEATS, F.sort_array(F.transform("v", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    fifth = fourth.select(*kept, "v", "r", pairs.alias("s"))
    same = F.filter("s", lambda x, j: (x["h"] == F.get("s", j + 1)["h"]) | ((j > 0) & (x["h"] == F.get("s", F.greatest(j - 1, F.lit(0)))["h"])))
    listed = F.filter(F.transform("v", lambda h, i: F.when(F.array_contains("r", h), i)), lambda i: i.isNotNull())
    places = F.when(F.col("r").isNull(), F.array().cast("array<int>")).when(F.col("s").isNull(), listed).otherwise(F.sort_array(F.transform(same, lambda x: x["i"])))
    sixth = fifth.select(*kept, places.alias("p"))
    covered = F.aggregate(F.transform("p", lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get("p", j + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), add)
    last = sixth.select(*kept, covered.alias("n_repeat_words"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    good = ~failed & (F.coalesce("ratio", F.lit(0.0)) >= LEAST_RATIO)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio"]
    return last.select("__row.*", F.struct(*names, failed.alias("base_failed"), good.alias("kept")).alias("__q"))


def assess(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ratio of every row.

    trusted holds the doc_id of good documents (repeated and null ids don't matter). A null text counts as empty: no words, base_failed. A text is worked on as a
    whole, in time n log n. Ties: a ratio equal to LEAST_RATIO is kept. Repeated rows are rows of their own; of other columns, only STRATA are used."""
    docs = base.plain(docs, "doc_id", "text", *STRATA)
    return measured(docs.select("doc_id", "text"), weights(docs, trusted)).select(
        "doc_id", "__q.n_words", "__q.word_chars", "__q.n_symbols", "__q.n_dup_lines", "__q.n_repeat_words", "__q.base_failed", "__q.kept", "__q.ratio"
    )


def keep_good(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The rows of docs that every rule keeps, with all their columns, whatever they are called. Nulls, ties, repeated rows and empty tables are as for assess()."""
    own = base.plain(docs, "doc_id", "text", *STRATA)
    return base.where_computed(measured(own, weights(own, trusted)), F.col("__q.kept")).drop("__q").toDF(*docs.columns)


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(base.table(spark, sf_dir, "documents"), trusted_ids(spark, sf_dir))
