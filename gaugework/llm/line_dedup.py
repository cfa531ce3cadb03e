"""Operator 10: line deduplication by winnowing. Runs of GRAM lines are hashed, the minimum of every WINDOW neighbouring runs is a fingerprint, and each later place of
a fingerprint is joined with its earliest one. Matches are extended both ways by joining, for each place, the runs that hold up to WINDOW - 1 lines more before or after it
with the earliest place of the same lines; what repeats goes. Any repeated run of GRAM + WINDOW - 1 lines holds a fingerprint no further than that from either of its
ends, so it goes whole, wherever its lines stood first. A line of ALONE words is compared by itself too. Column expressions only; rows hold places, never lines or texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugework.llm import base

#: Lines of a fingerprint, and neighbouring fingerprints of which the least is kept.
GRAM, WINDOW = 2, 2
#: Fewest words of a line that goes by itself where it repeats; of scripts without blanks, two letters (Han and kana) or four (Thai, Lao, Tibetan, Burmese, Khmer) are a word.
ALONE = 8
_BLANK, _TWO, _FOUR = r"\x20\x09-\x0D", r"぀-ヿ㐀-鿿豈-﫿ｦ-ﾝ\x{20000}-\x{3ffff}", r"฀-႟ក-៿"
#: Documents that lose lines are broadcast to the texts up to so many of them, and of their runs (16 bytes); beyond, texts are shuffled to them.
BROADCAST_ROWS, BROADCAST_RUNS = 200_000, 2_000_000
_ALONE = rf"^[{_BLANK}]*+(?:[^{_BLANK}]++[{_BLANK}]++){{{ALONE - 1}}}[^{_BLANK}]|^(?:[^{_TWO}]*+[{_TWO}]){{{2 * ALONE}}}|^(?:[^{_FOUR}]*+[{_FOUR}]){{{4 * ALONE}}}"


def line_array(text: Column) -> Column:
    return F.split(text, "\n", -1)


def worded(text: Column) -> Column:
    """The lines with a word: x (trimmed), i (their number in the text, from 0)."""
    lines = F.transform(line_array(text), lambda x, i: F.struct(F.trim(x, F.lit(" \t\r\x0b\x0c")).alias("x"), i.alias("i")))
    return F.filter(lines, lambda x: x["x"] != "")


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, version (a hash of the text, so rows that repeat a doc_id with another text stay apart), h (hashes of the lines with a word, trimmed) and alone (the places in
    h of lines of ALONE words). Rows with a null doc_id or text take no part."""
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), worded(F.col("text")).alias("l"))
    rows = base.held(rows)
    alone = F.filter(F.transform("l", lambda x, j: F.when(x["x"].rlike(_ALONE), j)), lambda j: j.isNotNull())
    return rows.select("doc_id", "version", F.transform("l", lambda x: F.xxhash64(x["x"])).alias("h"), alone.alias("alone"))


def fingerprints(lines: DataFrame) -> DataFrame:
    """doc_id, version, g (hash of GRAM lines), p (number of the first of them among the lines with a word), lines (how many) and wider: the runs that hold them and up to
    WINDOW - 1 lines more on one side, each with g, p and lines. Of every WINDOW neighbours the least is a fingerprint, the last of equal ones. Lines of ALONE words have
    rows of their own. Exact repeats of a row give the same places again."""
    h = F.col("h")
    run = lambda p, n: F.xxhash64(*(F.get(h, p + j) for j in range(n)))
    grams = F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - (GRAM - 1), F.lit(0))), lambda x, i: run(i, GRAM))
    rows = base.held(base.held(lines).select("doc_id", "version", "h", "alone", grams.alias("g")))
    g = F.col("g")
    starts = F.sequence(F.lit(0), F.greatest(F.size(g) - WINDOW, F.lit(0)))
    window = lambda s: F.transform(F.slice(g, s + 1, F.lit(WINDOW)), lambda x, j: F.struct(x.alias("g"), (-(s + j)).alias("p")))
    least = F.filter(F.transform(starts, lambda s: F.array_min(window(s))), lambda f: f.isNotNull())
    rows = base.held(rows.select("doc_id", "version", "h", "alone", least.alias("least")))
    chosen = F.filter("least", lambda f, i: (i == 0) | (f["p"] != F.get("least", i - 1)["p"]))  # neighbouring windows may have the same one
    place = lambda g, p, n: F.struct(g.alias("g"), p.alias("p"), F.lit(n).alias("lines"))
    more = lambda p: [F.when(q >= 0, F.when(q + GRAM + j <= F.size(h), place(run(q, GRAM + j), q, GRAM + j))) for j in range(1, WINDOW) for q in (p - j, p)]
    wider = lambda p: F.filter(F.array(*more(p)), lambda x: x.isNotNull())
    none = F.array().cast("array<struct<g: bigint, p: int, lines: int>>")
    runs = F.transform(chosen, lambda f: F.struct(f["g"].alias("g"), (-f["p"]).alias("p"), F.lit(GRAM).alias("lines"), wider(-f["p"]).alias("wider")))
    alone = F.transform("alone", lambda j: F.struct(F.xxhash64(F.get(h, j), F.lit(1)).alias("g"), j.alias("p"), F.lit(1).alias("lines"), none.alias("wider")))
    return rows.select("doc_id", "version", F.explode(F.concat(runs, alone)).alias("f")).select("doc_id", "version", "f.*")


def repeated(places: DataFrame) -> DataFrame:
    """The places (doc_id, version, g, p and more; stored) whose g occurs more than once, with `late`: whether there is an earlier one, at a smaller doc_id or earlier in the
    document. The earliest place is a minimum, combined before the shuffle: a g that a third of all rows hold costs a row a task."""
    first = places.groupBy("g").agg(F.min(F.struct("doc_id", "p", "version")).alias("first"), F.count("*").alias("n")).where("n > 1")
    joined = base.join_counted(places, base.written(first), ["g"], places.count())
    same = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("version") == F.col("first.version"))
    return joined.withColumn("late", (F.col("doc_id") > F.col("first.doc_id")) | (same & (F.col("p") > F.col("first.p")))).drop("first", "n")


def later_runs(docs: DataFrame) -> DataFrame:
    """doc_id, version, runs: (start, end) in numbers of lines with a word, end exclusive, of what repeats an earlier place. In order; runs that overlap or meet are joined."""
    prints = base.written(fingerprints(numbered(docs)))
    matches = base.written(repeated(prints))
    wider = matches.where(F.size("wider") > 0).select("doc_id", "version", F.explode("wider").alias("f")).select("doc_id", "version", "f.*")
    extended = repeated(base.written(wider))
    span = ["doc_id", "version", F.col("p").alias("start"), (F.col("p") + F.col("lines")).alias("end")]
    found = matches.where("late").select(*span).unionByName(extended.where("late").select(*span))
    text = Window.partitionBy("doc_id", "version").orderBy("start", "end")
    so_far = F.max("end").over(text.rowsBetween(Window.unboundedPreceding, -1))
    opened = found.withColumn("opens", F.coalesce(F.col("start") > so_far, F.lit(True)).cast("long"))
    joined = opened.withColumn("run", F.sum("opens").over(text.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    joined = joined.groupBy("doc_id", "version", "run").agg(F.struct(F.min("start").alias("start"), F.max("end").alias("end")).alias("r"))
    return joined.groupBy("doc_id", "version").agg(F.sort_array(F.collect_list("r")).alias("runs"))


def without_runs(docs: DataFrame, how: str) -> DataFrame:
    """The rows and columns of docs (whose names are plain) that lose lines (how: inner) or all (left), with removed (runs as line numbers of the text; null where nothing
    goes) and remains: text without them."""
    runs = base.written(later_runs(docs.select("doc_id", "text")).withColumnsRenamed({"doc_id": "run_doc", "version": "run_version"}))
    size = runs.agg(F.count("*").alias("n"), F.sum(F.size("runs")).alias("runs")).first()
    few = size["n"] <= BROADCAST_ROWS and (size["runs"] or 0) <= BROADCAST_RUNS
    joined = docs.join(F.broadcast(runs) if few else runs, (F.col("doc_id") == F.col("run_doc")) & (F.xxhash64("text") == F.col("run_version")), how)
    joined = joined.withColumn("at", F.when(F.col("runs").isNotNull(), F.transform(worded(F.col("text")), lambda x: x["i"])))
    joined = base.held(joined)
    told = F.transform("runs", lambda r: F.struct(F.get("at", r["start"]).alias("start"), (F.get("at", r["end"] - 1) + 1).alias("end")))
    joined = base.held(joined.withColumn("removed", told).withColumn("lines", F.when(F.col("runs").isNotNull(), line_array(F.col("text")))))
    # the lines before each run, and after the last
    ends = F.concat(F.array(F.lit(0)), F.transform("removed", lambda r: r["end"]))
    starts = F.concat(F.transform("removed", lambda r: r["start"]), F.array(F.size("lines")))
    kept = F.flatten(F.zip_with(ends, starts, lambda a, b: F.slice("lines", a + 1, b - a)))
    return joined.withColumn("remains", F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, removed (array of start and end of line numbers from 0, end exclusive, in order) and text (what remains) of the documents that lose lines.

    Lines are compared without the blanks at their ends; lines without a word are neither compared nor break a run, and go only between lines that go. Documents of fewer
    than GRAM such lines lose only lines of ALONE words; null and empty texts and empty tables lose nothing. The earliest place is by doc_id, then by line; an exact repeat
    of a row, doc_id included, counts as the same place. Texts are read whole; extra columns are left out."""
    rows = without_runs(base.own_columns(docs, "doc_id", "text"), "inner")
    return rows.select("doc_id", "removed", F.col("remains").alias("text"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whatever they are called, without later repeated runs of lines; n_chars (where there is one) is recounted for texts that
    change. Documents of which no word remains go: earlier documents hold all their lines. Nulls, ties, repeated rows and empty tables are as for deduplicated(); rows with
    a null doc_id or text stay as they are."""
    own = base.plain(docs, "doc_id", "text", "n_chars")
    rows = without_runs(own, "left")
    changed = F.col("runs").isNotNull()
    rows = base.where_computed(rows, ~changed | F.col("remains").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("remains")}
    if "n_chars" in own.columns:
        new["n_chars"] = F.when(changed, F.length("remains")).otherwise(F.col("n_chars")).cast(own.schema["n_chars"].dataType)
    return rows.select(*(new.get(c, F.col(c)).alias(c) for c in own.columns)).toDF(*docs.columns)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document that loses lines: doc_id, n_removed (lines), removed (start:end of line numbers, joined by commas), text."""
    found = deduplicated(base.table(spark, sf_dir, "documents"))
    numbers = F.array_distinct(F.flatten(F.transform("removed", lambda r: F.sequence(r["start"], r["end"] - 1))))
    return found.select(
        "doc_id",
        F.size(numbers).cast("long").alias("n_removed"),
        F.array_join(F.transform("removed", lambda r: F.concat_ws(":", r["start"].cast("string"), r["end"].cast("string"))), ",").alias("removed"),
        "text",
    )
