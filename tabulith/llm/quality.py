"""Quality rules: fixed counts of a text, and a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed words and word pairs: that of trusted
documents, smoothed towards the corpus so that little evidence gives ratios near 0, and that of
the whole corpus. Its mean over the n-grams of a document, in millionths of a nat, is compared
with a threshold that trusted documents held out of the fit give; weights and sums are whole
numbers, so the verdict doesn't depend on the order of summing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulith.llm.common import Scratch, let, screen_of, screened, words

#: Buckets that n-grams are hashed to; the table of weights, of this size, is broadcast.
BUCKETS = 1 << 16
#: One in so many trusted documents is held out. The threshold is MARGIN times the score that all of these but a share of LOWEST reach.
HELD_OUT, LOWEST, MARGIN = 5, 0.001, 1.25
#: N-grams of the corpus that the target is smoothed with.
SMOOTHING = BUCKETS


def _windows(w: Column) -> Column:
    """Hashes of the three-word windows of an array of words."""
    return F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))


def _repeated(h: Column) -> Column:
    """Words in the windows whose hash is there twice or more: each place counts up to the next one, three at most."""
    def places(s: Column) -> Column:
        again = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
        return F.sort_array(F.transform(again, lambda x: x["p"]))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)

    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    return F.when(F.size(F.array_distinct(h)) < F.size(h), let(let(pairs, places), covered)).otherwise(F.lit(0).cast("long"))


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with word_chars, n_words, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed.

    All are found within a row, in time linear in the words but for a sort of the windows of
    texts that repeat one. A null text counts as empty; columns of these names are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    symbols = sum((F.length(text) - F.length(F.replace(text, F.lit(c))) for c in "#*$%&|<>"), F.lit(0))
    out = docs.withColumn("_w", words(F.col(text_col)))
    out = out.withColumn("_l", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumns({
        "n_words": F.size("_w").cast("long"), "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": symbols.cast("long"), "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_repeat_words": let(F.col("_w"), lambda w: let(_windows(w), _repeated))}).drop("_w", "_l")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _grams(docs: DataFrame, *keep: str) -> DataFrame:
    """A row for each word and each pair of neighbouring words of ``body``, with its bucket."""
    pairs = docs.select(*keep, words(F.col("body")).alias("w")).select(
        *keep, F.explode(F.expr("arrays_zip(w, slice(w, 2, size(w)))")).alias("g")).select(*keep, "g.*")
    one, two = pairs.columns[-2:]
    both = F.stack(F.lit(2), F.pmod(F.xxhash64(one), F.lit(BUCKETS)),
                   F.when(F.col(two).isNotNull(), F.pmod(F.xxhash64(one, two), F.lit(BUCKETS)))).alias("bucket")
    return pairs.select(*keep, both).filter(F.col("bucket").isNotNull())


def fit_weights(docs: DataFrame, fitted: DataFrame) -> DataFrame:
    """(bucket, weight): the log ratio of target to corpus for each bucket, in millionths of a nat.

    ``docs`` has d and body; the corpus counts are over all of it. ``fitted`` has the ids d, each once and of the type of ``docs``, of the documents that make
    the target, any number of them: a bitmap of fixed size screens out the texts of others, and only those that pass are shuffled to the ids.
    """
    counts = _grams(docs).groupBy("bucket").agg(F.count("*").alias("raw"))
    good = screened(docs, "d", screen_of(fitted, "d")).join(fitted, "d")  # Spark would move a semi join below the screen
    target = _grams(good).groupBy("bucket").agg(F.count("*").alias("target"))
    counts = counts.join(target, "bucket", "left").na.fill(0)
    all_buckets = docs.sparkSession.range(BUCKETS).withColumnRenamed("id", "bucket").join(counts, "bucket", "left").na.fill(0)
    sums = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("r"), F.coalesce(F.sum("target"), F.lit(0)).alias("t"))
    corpus = (F.col("raw") + 1) / (F.col("r") + BUCKETS)
    target = (F.col("target") + SMOOTHING * corpus) / (F.col("t") + SMOOTHING)
    return all_buckets.crossJoin(F.broadcast(sums)).select(  # one row of two sums
        "bucket", F.round(F.log(target / corpus) * 1e6).cast("long").alias("weight"))


def quality_rules(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  threshold: int | None = None) -> DataFrame:
    """Every document with the base counts, ``score`` (long) and the verdict ``kept``.

    ``trusted`` has the ids (``id_col``) of the trusted documents, and all are used: one in HELD_OUT of them, by a hash, is not
    fitted but gives the threshold, unless ``threshold`` is given; the others are the target. Where none is held out the base rules alone decide. ``score`` is the mean weight of a document's n-grams, rounded down, in millionths of a
    nat; null without words. A document is kept unless base_failed or its score is under the
    threshold. Without trusted documents all scores are 0. Null texts count as empty and fail; repeated rows get the same verdict each; other columns are passed
    on, except that those with the names of results are replaced. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    text = F.coalesce(F.col(text_col), F.lit(""))
    body = docs.select(F.col(id_col).alias("d"), text.alias("body"))
    some = trusted.select(F.col(id_col).try_cast(body.schema["d"].dataType).alias("d")).filter("d IS NOT NULL").distinct()
    some = scratch.table(some.withColumn("held", F.pmod(F.xxhash64("d", F.lit(1)), F.lit(HELD_OUT)) == 0), "trusted")
    weights = scratch.table(fit_weights(body, some.filter("NOT held").select("d")), "weights")
    keyed = body.select(F.xxhash64("d", "body").alias("_key"), "d", "body")
    scored = scratch.table(_grams(keyed, "_key", "d").join(F.broadcast(weights), "bucket")  # BUCKETS rows
                           .groupBy("_key").agg(F.floor(F.sum("weight") / F.count("*")).cast("long").alias("score"), F.first("d").alias("d")), "scored")
    if threshold is None:
        held = scored.join(some.filter("held").select("d"), "d", "left_semi")
        low = held.agg(F.percentile_approx("score", LOWEST, 100_000)).first()[0]
        threshold = -(1 << 62) if low is None else math.floor(min(0, low) * MARGIN)
    scratch.close(scored)
    base = base_counts(docs.withColumn("_key", F.xxhash64(F.col(id_col), text)).drop("score", "kept"), text_col)
    out = base.join(scored.select("_key", "score"), "_key", "left").drop("_key")
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("score", F.lit(threshold - 1)) >= threshold))
