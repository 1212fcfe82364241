"""Line dedup over levelled, sorted runs of line hashes.

A run is a table (line, n_docs, last_doc), bucketed and sorted by line, of one or more batches of
documents: the hash of a normalised line, in how many documents it was found, and the largest id
of these where it was new. Batches come by falling ids. Each is merge-anti-joined to the runs:
a line that none of them has is new, so its last holder is settled; then its own run is added
to level 0. When a level has two runs they are merged into one run of the next level, so that
a batch meets few runs however many came before. Joins and merges read the runs bucket by
bucket, without a shuffle. In the end the lines found in enough documents go, except in
their last holder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.llm.common import Scratch, ascii_lower, join_on_hot_key, let, partitions

#: Stands for a null id: smaller than every other, and all null ids are one document.
NO_ID = -(1 << 63)


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")))


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(d, fp, pos, line) of the lines with keys of ``min_chars`` code points at least."""
    rows = docs.select("d", "fp", F.posexplode(F.split("body", "\n")).alias("pos", "raw"))
    rows = rows.filter(F.length("raw") >= min_chars).select("d", "fp", "pos", line_key(F.col("raw")).alias("key"))
    return rows.filter(F.length("key") >= min_chars).select("d", "fp", "pos", F.md5("key").alias("line"))


def _between(lines: Column, ends: Column) -> Column:
    """The lines between those that go, as slices; ``ends`` has their places and the number of lines."""
    start = lambda i: F.coalesce(F.get(ends, i - 1) + 1, F.lit(0))
    return F.flatten(F.transform(ends, lambda e, i: F.slice(lines, start(i) + 1, e - start(i))))


class LineRuns:
    """The runs of all batches so far, by level, in the shared folder."""

    def __init__(self, spark: SparkSession, scratch: Scratch):
        self.scratch, self.buckets = scratch, partitions(spark)
        self.levels: list[DataFrame | None] = []

    def _write(self, run: DataFrame, level: int) -> DataFrame:
        return self.scratch.bucketed(run, f"run_level{level}", "line", self.buckets)

    def add(self, lines: DataFrame) -> None:
        """Add the lines (line, d) of a batch, whose ids are all smaller than those before; a document's lines are all in one batch."""
        own = lines.select("line", "d").distinct().groupBy("line").agg(F.count("*").alias("n_docs"), F.max("d").alias("last_doc"))
        had = [r for r in self.levels if r is not None]
        for k, run in enumerate(had):  # an anti-join that keeps the counts of the lines it finds
            own = own.join(run.select("line", F.lit(True).alias(f"in{k}")), "line", "left")
        known = F.coalesce(*(F.col(f"in{k}") for k in range(len(had))), F.lit(False))
        run, level = self._write(own.select("line", "n_docs", F.when(~known, F.col("last_doc")).alias("last_doc")), 0), 0
        while level < len(self.levels) and self.levels[level] is not None:
            run, self.levels[level] = self._merged(self.levels[level], run, level + 1), None
            level += 1
        self.levels[level:level + 1] = [run]

    def _merged(self, a: DataFrame, b: DataFrame, level: int) -> DataFrame:
        """One run of two, which are dropped. (A union would be dealt anew: its parts aren't read bucket by bucket.)"""
        other = b.withColumnsRenamed({"n_docs": "n", "last_doc": "last"})
        out = self._write(a.join(other, "line", "full").select(
            "line", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n_docs"), F.greatest("last_doc", "last").alias("last_doc")), level)
        self.scratch.drop(a, b)
        return out

    def total(self) -> DataFrame:
        """(line, n_docs, last_doc) over all runs, which become one."""
        run, top = None, len(self.levels)
        for level, r in enumerate(self.levels):
            run = r if run is None else run if r is None else self._merged(r, run, top)
            self.levels[level] = None
        self.levels.append(run)
        return run


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20,
                min_docs: int = 3, batches: int = 4) -> DataFrame:
    """Drop lines that many documents share, keeping them in the document of largest id.

    A text is split at ``\\n`` (null or empty: one empty line). Lines whose key (see
    :func:`line_key`) has ``min_chars`` code points and is in ``min_docs`` documents or more
    lose all their lines except in the largest id that holds it; the other lines stay, joined
    by ``\\n``. The documents come in ``batches``, ranges of ids of about the same number of rows.

    Returns the columns of ``docs`` with the new text, and n_lines and n_dropped (long; these
    two replace columns of that name). A text that loses every line becomes empty. Rows with
    one id are one document for the counts, and each keeps a row of its own; null ids count as
    one document, smaller than every id. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("d"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("body"), F.struct(*names).alias("row"))
    keyed = keyed.withColumn("fp", F.xxhash64("body"))
    runs = LineRuns(spark, scratch)
    cuts = keyed.agg(F.percentile_approx("d", [k / batches for k in range(1, batches)])).first()[0] if batches > 1 else None
    edges = [None, *sorted(set(cuts or [])), None]
    for low, high in reversed(list(zip(edges, edges[1:], strict=False))):
        inside = (F.lit(True) if low is None else F.col("d") > low) & (F.lit(True) if high is None else F.col("d") <= high)
        runs.add(_lines(keyed.filter(inside), min_chars))
    shared = scratch.table(runs.total().filter(F.col("n_docs") >= min_docs), "shared")
    scratch.close(shared)
    held = shared.agg(F.sum("n_docs")).first()[0] or 0
    found = join_on_hot_key(_lines(keyed, min_chars), shared, "line", "n_docs", held)
    gone = (found.filter(F.col("d") < F.col("last_doc")).groupBy("d", "fp")
            .agg(F.array_sort(F.collect_set("pos")).alias("gone")))
    rows = keyed.join(gone, ["d", "fp"], "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    rows = rows.withColumn("n_lines", F.size(F.split("body", "\n")).cast("long"))
    kept = let(F.split("body", "\n"), lambda x: let(F.concat("gone", F.array(F.size(x))), lambda ends: _between(x, ends)))
    rows = rows.withColumn("kept", F.when(F.size("gone") == 0, F.col("body")).otherwise(F.array_join(kept, "\n")))
    return rows.select(*[F.col("kept").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names],
                       "n_lines", F.size("gone").cast("long").alias("n_dropped"))
