"""Secret scans with corpus-wide ownership frequency.

Patterns give candidate spans. The values of the candidates, as digests, are counted over the
corpus by distinct repositories (documents) and owners (sources): a value that several owners
have or that is in many repositories is an example that people copy; others look live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulith.llm.common import Scratch, join_on_hot_key

#: Base kinds in their order: name, pattern, group of the value, least characters of the value. Runs of
#: under 18 and 16 characters never match: a run holds no longer match than that from its first fitting place.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 0),
    ("hex", r"[0-9a-f]{16,}", 0, 0),
)
#: Kinds that the method adds: fixed formats of well-known credentials.
ADDED = (
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 0),
    ("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 0),
)
KINDS = tuple(k[0] for k in BASE + ADDED)
#: A value that so many owners have, or that is in so many repositories, is an example.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 10


def _matches(docs: DataFrame) -> DataFrame:
    """(k, owner, rank, start, end, value) of the leftmost non-overlapping matches of each kind in ``body``.

    A text is split at the matches of a kind; the lengths of pieces and matches, summed over the
    text, give the places, in code points. Only texts with a match give rows.
    """
    body = F.col("body")
    cut = [F.when(F.regexp_like(body, F.lit(rx)), F.arrays_zip(
        F.transform(F.split(body, rx), F.length).alias("before"), F.regexp_extract_all(body, F.lit(rx), F.lit(0)).alias("match"),
        F.regexp_extract_all(body, F.lit(rx), F.lit(group)).alias("value"))) for _, rx, group, _ in BASE + ADDED]
    kinds = F.array(*(F.struct(F.lit(r).alias("rank"), x.alias("cut")) for r, x in enumerate(cut)))
    rows = (docs.select("k", "repo", "owner", F.explode(F.filter(kinds, lambda x: x["cut"].isNotNull())).alias("x"))
            .select("k", "repo", "owner", "x.rank", F.posexplode("x.cut").alias("i", "c")).filter("c.match IS NOT NULL").distinct())
    so_far = Window.partitionBy("k", "repo", "owner", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("c.match")
    end = F.sum(F.col("c.before") + size).over(so_far).cast("int")
    least = F.element_at(F.array(*(F.lit(x) for *_, x in BASE + ADDED)), F.col("rank") + 1)
    out = rows.select("k", "repo", "owner", "rank", (end - size).alias("start"), end.alias("end"), F.col("c.value").alias("value"))
    return out.filter(F.length("value") >= least)


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
                 example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """Every document with the spans of its secrets and what their values' owners say of them.

    Returns ``id_col`` and ``found``: an array of (start, rank, end, kind, n_repos, n_owners,
    live), by start, then kind as listed in KINDS. n_repos and n_owners count the distinct
    documents and owners of the value over the whole corpus, whatever its kind; it is live
    unless ``example_owners`` or more have it or it is in ``example_repos`` or more. Spans of different kinds may overlap.

    Null and empty texts have no spans; a null owner counts as one owner. Repeated rows give
    repeated results and count once; rows with one id and different texts get their own spans.
    An empty table gives an empty result; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    body = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col), body.alias("body"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"))
    keyed = keyed.withColumn("repo", F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    keyed = keyed.withColumn("k", F.concat_ws(":", "repo", F.xxhash64("body")))
    found = scratch.table(_matches(keyed).withColumn("digest", F.md5("value")).drop("value"), "matches")
    pairs = found.groupBy("digest", "owner", "repo").agg(F.count("*").alias("n"))
    owned = pairs.groupBy("digest").agg(F.sum("n").alias("n"), F.count_distinct("repo").alias("n_repos"), F.count_distinct("owner").alias("n_owners"))
    judged = join_on_hot_key(found, owned, "digest", "n", found.count())
    names = F.element_at(F.array(*(F.lit(k) for k in KINDS)), F.col("rank") + 1)
    span = F.struct("start", "rank", "end", names.alias("kind"), "n_repos", "n_owners", ((F.col("n_owners") < example_owners) & (F.col("n_repos") < example_repos)).alias("live"))
    spans = judged.groupBy("k").agg(F.array_sort(F.collect_set(span)).alias("found"))
    none = F.array().cast(spans.schema["found"].dataType)
    return keyed.select(id_col, "k").join(spans, "k", "left").select(id_col, F.coalesce("found", none).alias("found"))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
