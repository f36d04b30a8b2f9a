"""Quality rules: word rules, then a hashed n-gram log-likelihood ratio.

Every document is compared with two multinomials over hashed word n-grams: one
counted on trusted documents, one on all documents. Its score is the mean log
ratio per n-gram; below a fixed threshold it is rejected. All of it runs as
DataFrame expressions: texts are split twice (to count, to score), n-grams are
counted per task before the shuffle, and the score table has a fixed number of
entries, whatever the corpus size.

Defined cases: a null or empty text has no words and fails the base rule; with
no trusted documents, or no documents at all, every ratio is 0 and the verdict
is the base rule alone; repeated rows are scored like any other row and each
counts; further columns are carried along unless they have a result's name,
then the result replaces them. Null ids are never trusted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words.
BLANKS = " \t\n\x0b\f\r"
WINDOW = 8
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def words_of(text: Column) -> Column:
    """Words of a whole text; none for a null."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, "[\\x20\\x09-\\x0D]+"))


def hashed_ngrams(words: Column, orders: tuple[int, ...], buckets: int) -> Column:
    """Bucket numbers of all n-grams of the given orders, repeats included."""
    if buckets & (buckets - 1):
        raise ValueError("buckets must be a power of two")

    def bucket(*parts: Column) -> Column:
        return F.xxhash64(*parts).bitwiseAND(F.lit(buckets - 1)).cast("int")

    n, found = F.size(words), []
    for order in orders:
        if order == 1:
            found.append(F.transform(words, lambda w: bucket(w)))
        elif order == 2:
            found.append(F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))),
                                    F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: bucket(a, b)))
        else:
            found.append(F.coalesce(windows(words, order, lambda part: bucket(part)), F.array().cast("array<int>")))
    return F.concat(*found)


def windows(words: Column, length: int, of) -> Column:
    """``of(slice)`` for each run of ``length`` words."""
    starts = F.sequence(F.lit(1), F.size(words) - (length - 1))
    return F.when(F.size(words) >= length, F.transform(starts, lambda i: of(F.slice(words, i, length))))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: Column) -> Column:
    """Words that lie in windows of ``WINDOW`` words which the text has twice or more."""
    def covered(at: Column) -> Column:
        steps = F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at), F.lit(1))),
                           lambda a, b: F.when(b - a < WINDOW, b - a).otherwise(WINDOW))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda total, x: total + x)

    def twice(pairs: Column) -> Column:
        found = F.filter(pairs, lambda x, i: ((i > 0) & (F.get(pairs, i - 1)["h"] == x["h"]))
                         | F.coalesce(F.get(pairs, i + 1)["h"] == x["h"], F.lit(False)))
        return F.array_sort(F.transform(found, lambda x: x["at"]))

    def count(hashes: Column) -> Column:
        numbered = F.array_sort(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(
            let(numbered, lambda pairs: let(twice(pairs), covered)))

    return F.coalesce(let(windows(words, WINDOW, lambda x: F.xxhash64(x)), count), F.lit(0).cast("bigint"))


def judged(text: Column, ratios: Column, orders: tuple[int, ...], buckets: int, threshold: float) -> Column:
    """All counts and the verdict on one text as a struct."""
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.translate(x, BLANKS, "") != "")

    def mean(grams: Column) -> Column:
        total = F.aggregate(grams, F.lit(0.0), lambda acc, b: acc + F.get(ratios, b))
        return F.when(F.size(grams) > 0, total / F.size(grams)).otherwise(F.lit(0.0))

    def counts(words: Column) -> Column:
        return F.struct(F.size(words).cast("bigint").alias("n_words"), repeat_words(words).alias("n_repeat_words"),
                        let(hashed_ngrams(words, orders, buckets), mean).alias("score"))

    def verdict(x: Column) -> Column:
        failed = (x["n_words"] < 20) | (100 * x["n_repeat_words"] > 30 * x["n_words"])
        return F.struct(
            x["n_words"].alias("n_words"), F.length(F.translate(body, BLANKS, "")).cast("bigint").alias("word_chars"),
            (F.length(body) - F.length(F.translate(body, "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
            let(lines, lambda y: F.size(y) - F.size(F.array_distinct(y))).cast("bigint").alias("n_dup_lines"),
            x["n_repeat_words"].alias("n_repeat_words"), failed.alias("base_failed"), x["score"].alias("score"),
            (~failed & (x["score"] >= threshold)).alias("kept"))

    return let(let(words_of(text), counts), verdict)


def ratio_table(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text: str = "text",
                orders: tuple[int, ...] = (1,), buckets: int = 1 << 14, smooth: float = 1.0) -> DataFrame:
    """One row with ``ratios``: log p_trusted - log p_raw per bucket.

    ``trusted`` holds ids; a document whose id is among them counts as target.
    Counts cover all documents. Both multinomials get ``smooth`` per bucket.
    """
    good = trusted.select(F.col(id_col).alias("_good")).where("_good is not null").distinct()
    # The trusted ids grow with the corpus: never broadcast them.
    marked = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).join(
        good.hint("merge"), F.col("_id") == F.col("_good"), "left")
    grams = marked.withColumn("words", words_of(F.col("_text"))).select(
        F.explode(hashed_ngrams(F.col("words"), orders, buckets)).alias("bucket"),
        F.col("_good").isNotNull().cast("bigint").alias("target"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("target").alias("target"))
    # One row per bucket, a number fixed by the parameter: they fit one array.
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(counts, "bucket", "left").select(
        F.struct("bucket", F.coalesce("raw", F.lit(0)).alias("raw"),
                 F.coalesce("target", F.lit(0)).alias("target")).alias("entry"))
    table = full.agg(F.sort_array(F.collect_list("entry")).alias("entries"),
                     F.sum("entry.raw").alias("all_raw"), F.sum("entry.target").alias("all_target"))

    def ratio(x: Column) -> Column:
        return (F.log((x["target"] + smooth) / (F.col("all_target") + smooth * buckets))
                - F.log((x["raw"] + smooth) / (F.col("all_raw") + smooth * buckets)))

    ratios = F.transform("entries", ratio)
    return table.select(F.when(F.col("all_target") > 0, ratios)
                        .otherwise(F.transform("entries", lambda x: F.lit(0.0))).alias("ratios"))


def quality_rules(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text: str = "text",
                  orders: tuple[int, ...] = (1,), buckets: int = 1 << 14, smooth: float = 1.0,
                  threshold: float = -0.2) -> DataFrame:
    """Add the base counts, ``base_failed``, ``score`` and ``kept`` to ``docs``.

    ``score`` is the mean log ratio per n-gram (0 without n-grams); a document
    is kept when the base rule holds and ``score >= threshold``. Single words in
    few buckets tell good from bad best on little and much data alike: longer
    n-grams are too rare in a small corpus and pull unseen good texts down.
    """
    table = ratio_table(docs, trusted, id_col, text, orders, buckets, smooth)
    scored = docs.withColumn("_ratios", table.scalar()).withColumn(
        "_judged", judged(F.col(text), F.col("_ratios"), orders, buckets, threshold))
    return scored.withColumns({c: F.col(f"_judged.{c}") for c in RESULTS}).drop("_judged", "_ratios")
