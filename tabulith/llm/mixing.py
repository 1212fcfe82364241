"""Mixing sources to target weights by iterative proportional fitting (raking).

Documents fall into cells of source, language and topic. Raking finds a factor for each source,
each language and each topic such that the tokens of the cells, times their factors, have the
target marginals. The product of a cell's factors is the rate at which its documents are drawn.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulith.llm.common import Scratch, words

DIMENSIONS = ("source", "lang", "topic")
#: Rounds of raking at most, and the relative change of the factors that ends them.
ROUNDS, TOLERANCE = 12, 1e-4
#: Cells that are broadcast to the documents; more are joined by a shuffle.
BROADCAST_CELLS = 100_000


def layout_topic(text: Column, n_tokens: Column) -> Column:
    """A topic for tables that have none: the kind of text, by its symbols and its length."""
    body = F.coalesce(text, F.lit(""))
    symbols = sum((F.length(body) - F.length(F.replace(body, F.lit(c))) for c in "#*$%&|<>"), F.lit(0))
    return (F.when(n_tokens == 0, "empty").when(symbols * 10 > n_tokens, "symbols").when(n_tokens < 100, "short")
            .when(n_tokens < 1000, "middle").otherwise("long"))


def draw(seed: int, key: Column) -> Column:
    """A number in [0, 1) made of the first 52 bits of an MD5 digest of seed and key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / 2.0**52


def tempered(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """(value, share): targets in proportion to each value's tokens to the ``power``, summing to 1."""
    sums = cells.groupBy(dim).agg((F.sum("tokens").cast("double") ** F.lit(power)).alias("share"))
    total = sums.agg(F.sum("share").alias("_all"))  # one row
    return sums.crossJoin(F.broadcast(total)).select(F.col(dim).alias("value"), (F.col("share") / F.col("_all")).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], scratch: Scratch, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, float]:
    """``cells`` (dimensions and tokens) with ``rate``, the product of the factors, and the largest change of the last round.

    Each step sums the cells by one dimension (partial sums first), scales them by target over
    sum, through a join on that dimension, and ends in a table in the shared folder. A round is
    a step for each dimension; the rounds end when no factor moves by more than ``tolerance`` or after
    ``rounds`` of them. A value without a target share gets rate 0. Values without tokens keep their rate.
    """
    total = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("double")).first()[0]
    now, moved = cells.withColumns({"rate": F.lit(1.0), "moved": F.lit(0.0)}), 0.0
    for _ in range(rounds):
        for k, (d, share) in enumerate(targets.items()):
            mass = now.groupBy(d).agg(F.sum(F.col("tokens") * F.col("rate")).alias("mass"))
            by = mass.join(share.withColumnRenamed("value", d), d, "left").select(
                d, F.when(F.col("mass") > 0, F.coalesce("share", F.lit(0.0)) * total / F.col("mass")).otherwise(1.0).alias("by"))
            change = F.abs(F.col("by") - 1)
            after = now.join(by, d).withColumns({"rate": F.col("rate") * F.col("by"), "moved": F.greatest("moved", change) if k else change})
            after = scratch.table(after.drop("by"), "raked")
            scratch.drop(now)
            now = after
        moved = now.agg(F.coalesce(F.max("moved"), F.lit(0.0))).first()[0]
        if moved <= tolerance:
            break
    return now.drop("moved"), moved


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: float = 0.5, power: float = 0.5,
        targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, seed: int = 7) -> DataFrame:
    """``docs`` with topic, n_tokens, rate, probability, weight and ``drawn``.

    A document is drawn with probability min(1, keep * rate) by a hash of its id, and weighs
    max(1, keep * rate), so that weighted tokens drawn meet the targets in expectation also
    where a cell is too small to be raised by drawing alone. ``targets`` has (value, share) for
    each dimension; by default shares are tempered by ``power``. Tables without a topic column
    get :func:`layout_topic`. Null values of a dimension are a value of their own, ''. Null and
    empty texts have no tokens, and the rate of their cell. Repeated rows are drawn alike.
    Columns with the names of results are replaced; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    names = [c for c in docs.columns if c not in ("n_tokens", "rate", "probability", "weight", "drawn", "topic")]
    counted = docs.withColumn("n_tokens", F.size(words(F.col(text_col))).cast("long"))
    topic = F.col("topic") if "topic" in docs.columns else layout_topic(F.col(text_col), F.col("n_tokens"))
    keyed = counted.withColumn("topic", topic).select(
        *names, "topic", "n_tokens", *(F.coalesce(F.col(d).cast("string"), F.lit("")).alias(f"_{d}") for d in DIMENSIONS))
    cells = scratch.table(keyed.groupBy(*(F.col(f"_{d}").alias(d) for d in DIMENSIONS)).agg(F.sum("n_tokens").alias("tokens")), "cells")
    targets = targets or {d: scratch.table(tempered(cells, d, power), f"target-{d}") for d in DIMENSIONS}
    raked, moved = rake(cells, targets, scratch, rounds)
    if moved > TOLERANCE:
        warnings.warn(f"raking ended after {rounds} rounds, with factors still moving by {moved:.2g}", stacklevel=2)
    few = cells.count() <= BROADCAST_CELLS
    scratch.close(raked_table := scratch.table(raked, "rates"))
    rated = raked_table.select(*(F.col(d).alias(f"_{d}") for d in DIMENSIONS), "rate")
    rated = F.broadcast(rated) if few else rated
    out = keyed.join(rated, [f"_{d}" for d in DIMENSIONS], "left")
    chance = F.least(F.lit(1.0), F.col("rate") * keep)
    return out.select(*names, "topic", "n_tokens", "rate", chance.alias("probability"),
                      F.greatest(F.lit(1.0), F.col("rate") * keep).alias("weight"), (draw(seed, F.col(id_col)) < chance).alias("drawn"))
