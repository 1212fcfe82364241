"""Exact nearest neighbours by an index of pivots.

Rows of the base belong to the pivot that is nearest to them and are kept in blocks, each a range of
distances to one pivot. By the triangle inequality a row at distance s from a pivot is at least
|q - s| from a query at distance q from it, so a query skips every block whose range is further
off than its second neighbour can be. That bound comes from the pivots, which are rows themselves, and
then from the one block the query falls into; what remains is compared in full. The answer is that of all pairs.

Equal vectors are met once. Of equal base rows as many are kept as can be among the nearest ones, two and one for the query itself, and
equal queries are one query, whose answer each of them gets. So the work follows the different vectors, however many copies there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulith.sources.tables import scratch_path

#: Pivots at most, rows of a block at least, and blocks at most (of which the driver and tasks hold 40 bytes each).
PIVOTS, BLOCK, BLOCKS = 1024, 1024, 1 << 20
#: Queries that meet one block in one task at most, about.
CHUNK = 8192
#: Neighbours asked for: two, and one more that may be the query's own row. No more equal base rows than these matter.
NEAREST = 3
#: Different queries whose answers are sent to every task, a row each; the answers of more are joined as Spark sees fit.
FEW = 1 << 14


def distances(x: np.ndarray, y: np.ndarray, categories: int) -> np.ndarray:
    """All distances between rows of x and y. The last 2 * categories columns are pairs of slot and weight: rows of different slots differ by the weights of both."""
    n = x.shape[1] - 2 * categories
    out = np.zeros((len(x), len(y)))
    for i in range(n):
        out += (x[:, i, None] - y[None, :, i]) ** 2
    for i in range(n, x.shape[1], 2):
        out += (x[:, i, None] != y[None, :, i]) * (x[:, i + 1, None] ** 2 + y[None, :, i + 1] ** 2)
    return np.sqrt(out)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _few_copies(rows: DataFrame) -> DataFrame:
    """(key, v) with keys hashed: of equal vectors two rows, those of the least and the greatest hash, and one more where there are three or more.

    A query that leaves out its own row still finds two of them, whichever it is: the third has the greatest hash again, and only one row of a hash is left out.
    """
    h = F.xxhash64("key")
    groups = rows.groupBy("v").agg(F.min(h).alias("a"), F.max(h).alias("b"), F.count("*").cast("int").alias("n"))
    return groups.select(F.explode(F.slice(F.array("a", "b", "b"), F.lit(1), F.least("n", F.lit(NEAREST)))).alias("key"), "v")


@dataclass(frozen=True)
class PivotIndex:
    """Pivots, the ranges of the blocks (arrays, ordered by pivot and distance), and the blocks themselves, a row each, in the shared folder."""

    pivots: np.ndarray
    block: np.ndarray
    pivot_of: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    size: np.ndarray
    blocks: DataFrame
    categories: int

    @classmethod
    def build(cls, base: DataFrame, *, key: str = "row_key", vector: str = "vector", categories: int = 0, pivots: int | None = None) -> PivotIndex:
        """The index of ``base`` (key, vector), of equal vectors NEAREST rows. As many pivots as the root of these rows, PIVOTS at most, by a hash of the key."""
        spark = base.sparkSession
        rows = _written(_few_copies(base.select(F.col(key).alias("key"), F.col(vector).alias("v"))), "base")
        n = rows.count()
        m = min(PIVOTS, pivots or max(8, int(n**0.5)))
        chosen = rows.orderBy(F.xxhash64("key"), "key", "v").limit(m).select("v").collect()  # m rows, a fixed number at most
        points = np.unique(np.array([r.v for r in chosen], float), axis=0) if chosen else np.empty((0, 0))
        held, size = spark.sparkContext.broadcast(points), max(BLOCK, -(-n // BLOCKS))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(0, b.num_rows, 2048):
                    part = b.slice(i, 2048)
                    d = distances(_matrix(part.column(1)), held.value, categories)
                    near = d.argmin(1)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], ["key", "v", "pivot", "dist"])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            base_id, k, open_ = TaskContext.get().partitionId() << 32, 0, None

            def block(part: pa.RecordBatch) -> pa.RecordBatch:
                nonlocal k
                k += 1
                d = part.column("dist").to_numpy()
                row = {"block": base_id + k, "pivot": part.column("pivot")[0].as_py(), "lo": float(d.min()), "hi": float(d.max()), "n": len(d),
                       "keys": part.column("key").to_pylist(), "m": _matrix(part.column("v")).tobytes()}
                return pa.RecordBatch.from_arrays([pa.array([x], kinds[c]) for c, x in row.items()], list(row))

            kinds = {"block": pa.int64(), "pivot": pa.int32(), "lo": pa.float64(), "hi": pa.float64(), "n": pa.int32(), "m": pa.binary()}
            for b in batches:
                kinds["keys"] = pa.list_(b.column(0).type)
                open_ = b if open_ is None else pa.Table.from_batches([open_, b]).combine_chunks().to_batches()[0]
                while open_ is not None:  # a full block, or one that ends where the pivot changes
                    p = open_.column("pivot").to_numpy()
                    end = min(int(np.searchsorted(p, p[0], "right")), size)
                    if end == len(p) and end < size:
                        break
                    yield block(open_.slice(0, end))
                    open_ = open_.slice(end) if end < len(p) else None
            while open_ is not None:
                p = open_.column("pivot").to_numpy()
                end = min(int(np.searchsorted(p, p[0], "right")), size)
                yield block(open_.slice(0, end))
                open_ = open_.slice(end) if end < len(p) else None

        key_type = "bigint"
        near = rows.mapInArrow(assign, f"key {key_type}, v array<double>, pivot int, dist double")
        parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // size)))
        # sorted ranges of (pivot, distance): a pivot that has many rows is in many tasks; the key parts equal rows
        dealt = near.repartitionByRange(parts, "pivot", "dist", F.xxhash64("key")).sortWithinPartitions("pivot", "dist")
        path = scratch_path(spark, "blocks")
        schema = f"block long, pivot int, lo double, hi double, n int, keys array<{key_type}>, m binary"
        dealt.mapInArrow(pack, schema).write.parquet(path)
        blocks = spark.read.schema(schema).parquet(path)
        about = blocks.select("block", "pivot", "lo", "hi", "n").toPandas().sort_values(["pivot", "lo", "hi", "block"])  # BLOCKS rows at most
        return cls(points, *(about[c].to_numpy() for c in ("block", "pivot", "lo", "hi", "n")), blocks, categories)

    def first(self, x: np.ndarray, exclude_self: bool) -> tuple[np.ndarray, np.ndarray]:
        """For each query the block whose range it is in or next to, at its nearest pivot (-1 without blocks), and a bound of its second neighbour's distance."""
        if not len(self.block):
            return np.full(len(x), -1), np.full(len(x), np.inf)
        d = distances(x, self.pivots, self.categories)
        k = 3 if exclude_self else 2
        bound = np.sort(d, axis=1)[:, k - 1] if d.shape[1] >= k else np.full(len(x), np.inf)
        near = d.argmin(1)
        starts = np.searchsorted(self.pivot_of, near)
        ends = np.searchsorted(self.pivot_of, near, "right")
        own = d[np.arange(len(x)), near]
        at = [min(max(s + int(np.searchsorted(self.lo[s:e], q, "right")) - 1, s), e - 1) for s, e, q in zip(starts.tolist(), ends.tolist(), own.tolist(), strict=True)]
        return np.array(at), bound

    def further(self, x: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, place of block) of all blocks that may hold a row nearer than the query's bound."""
        if not len(self.block):
            return np.empty(0, int), np.empty(0, int)
        d = distances(x, self.pivots, self.categories)
        q, b = [], []
        step = max(1, 4_000_000 // len(self.block))
        for i in range(0, len(x), step):
            own = d[i:i + step][:, self.pivot_of]
            gap = np.maximum(np.maximum(own - self.hi, self.lo - own), 0.0)
            hit = np.nonzero(gap <= (bound[i:i + step, None] * (1 + 1e-9) + 1e-9))
            q.append(hit[0] + i)
            b.append(hit[1])
        return np.concatenate(q), np.concatenate(b)

    def visits(self, asked: DataFrame, exclude_self: bool = False, *, seen: bool = False) -> DataFrame:
        """(block, n, key, v, bound) for asked (key, v), with ``seen`` also (first, bound): the blocks each query must still look at; without, its first."""
        held = asked.sparkSession.sparkContext.broadcast(PivotIndex(self.pivots, self.block, self.pivot_of, self.lo, self.hi, self.size, None, self.categories))

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = held.value
            for b in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
                x = _matrix(b.column(1))
                if not len(x):
                    continue
                if seen:
                    bound = b.column(3).to_numpy(zero_copy_only=False)
                    q, at = index.further(x, bound)
                    keep = index.block[at] != b.column(2).to_numpy()[q] if len(q) else np.empty(0, bool)
                    q, at = q[keep], at[keep]
                else:
                    at, bound = index.first(x, exclude_self)
                    q = np.flatnonzero(at >= 0)
                    at = at[q]
                rows = pa.array(q)
                yield pa.RecordBatch.from_arrays([pa.array(index.block[at].astype(np.int64)), pa.array(index.size[at].astype(np.int32)), b.column(0).take(rows), b.column(1).take(rows), pa.array(bound[q])],
                                                 ["block", "n", "key", "v", "bound"])

        return asked.mapInArrow(visit, f"block long, n int, key {dict(asked.dtypes)['key']}, v array<double>, bound double")

    def compare(self, visits: DataFrame, least: int, chunks: int) -> DataFrame:
        """(key, near): for each query and block it visits the ``least`` nearest rows, each its distance d and the hash k of its key."""
        categories = self.categories
        chunk = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(chunks)).cast("int")
        left = visits.select("block", chunk.alias("chunk"), "key", "v")
        met = left.select(F.col("block").alias("of"), F.col("chunk").alias("to")).distinct()
        right = met.join(self.blocks.select(F.col("block").alias("of"), "keys", "m"), "of")

        def nearest(_, q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(b):
                return pd.DataFrame({"key": [], "d": [], "k": []}, dtype=object)
            keys = np.array(b["keys"].iloc[0])
            y = np.frombuffer(b["m"].iloc[0], float).reshape(len(keys), -1)
            ds, ks = [], []
            for i in range(0, len(q), 1024):
                d = distances(np.stack(q["v"].iloc[i:i + 1024]), y, categories)
                at = np.argpartition(d, least - 1, axis=1)[:, :least] if d.shape[1] > least else np.broadcast_to(np.arange(d.shape[1]), d.shape)
                for row, where in zip(np.take_along_axis(d, at, 1), at, strict=True):
                    fine = np.isfinite(row)
                    ds.append(row[fine])
                    ks.append(keys[where[fine]])
            return pd.DataFrame({"key": q["key"], "d": ds, "k": ks})

        schema = f"key {dict(visits.dtypes)['key']}, d array<double>, k array<bigint>"
        return left.groupBy("block", "chunk").cogroup(right.groupBy("of", "to")).applyInPandas(nearest, schema).select("key", F.arrays_zip("d", "k").alias("near"))


def _written(df: DataFrame, name: str) -> DataFrame:
    """A table in the shared folder: what Python made is made once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def nearest_two(query: DataFrame, base: DataFrame | PivotIndex, *, key: str = "row_key", vector: str = "vector", categories: int = 0, exclude_self: bool = False) -> DataFrame:
    """(key, d1, d2): Euclidean distances of each query row to its two nearest base rows, exactly; null where the base has fewer.

    ``base`` is a table or its :class:`PivotIndex`. The last 2 * ``categories`` entries of a vector are slots and weights (see :func:`distances`).
    With ``exclude_self`` the base row of the same key is left out, keys told apart by 64-bit hashes. Keys are unique in each table. Equal queries are
    compared once, with a few of equal base rows, and the answer is joined back to each row. A query compares itself with the blocks that the index can't rule out; in clustered data few, in data without structure in many dimensions most.
    """
    index = base if isinstance(base, PivotIndex) else PivotIndex.build(base, key=key, vector=vector, categories=categories)
    rows = _written(query.select(F.col(key).alias("key"), F.col(vector).alias("v")), "asked")
    asked = _written(rows.select("v").distinct().select(F.monotonically_increasing_id().alias("key"), "v"), "asked")  # the numbers come from the table
    n = asked.count()
    least, chunks = NEAREST if exclude_self else NEAREST - 1, max(1, -(-n // CHUNK))
    merged = lambda df: df.groupBy("key").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, least).alias("near"))  # noqa: E731  three rows a block at most
    visits = _written(index.visits(asked, exclude_self), "visits")
    best = index.compare(visits, least, chunks)
    start = visits.select("key", "v", F.col("block").alias("first"), "bound").join(best, "key").select(
        "key", "v", "first", F.least("bound", F.coalesce(F.get(F.array_sort("near"), F.lit(least - 1))["d"], F.lit(float("inf")))).alias("bound"), "near")
    start = _written(start, "first")
    more = _written(index.visits(start.select("key", "v", "first", "bound"), seen=True), "visits")
    both = merged(start.select("key", "near").unionByName(index.compare(more, least, chunks)))
    answers = _written(asked.withColumnRenamed("key", "_q").join(both.withColumnRenamed("key", "_q"), "_q").select("v", "near"), "answers")
    out = rows.join(F.broadcast(answers) if n <= FEW else answers, "v", "left")
    own = F.array_position("near.k", F.xxhash64("key")) if exclude_self else F.lit(0)
    out = out.withColumn("_own", own).withColumn("near", F.filter("near", lambda x, i: i + 1 != F.col("_own")))  # one row of that hash
    return out.select(F.col("key").alias(key), F.get("near", F.lit(0))["d"].alias("d1"), F.get("near", F.lit(1))["d"].alias("d2"))
