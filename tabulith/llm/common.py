"""What several of the text operators share: words, hashes, the shared folder and hot-key joins."""

from __future__ import annotations

import gc
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII white space, as everywhere in these operators: space, tab, \n, \v, \f, \r.
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+``; empty for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` also changes letters beyond ASCII)."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, f) -> Column:
    """f(value), with the value computed once: a column used inside a lambda may be inlined and computed for each element."""
    return F.transform(F.array(value), f)[0]


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, where unset, one in the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    return root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/llm-scratch"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark reads."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables of one run in the shared folder. Written tables cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n, self.held, self.names = 0, {}, {}

    def _place(self, name: str) -> str:
        self.n += 1
        return f"{self.path}/{self.n:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back."""
        path = self._place(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held[path] = out
        return out

    def bucketed(self, df: DataFrame, name: str, key: str, n: int) -> DataFrame:
        """Write ``df``, dealt by ``key`` before, in ``n`` sorted buckets of it, so that joins on it don't shuffle again."""
        path, table = self._place(name), f"llm_{name}_{uuid.uuid4().hex[:12]}"
        df.write.option("path", path).bucketBy(n, key).sortBy(key).saveAsTable(table)
        self.names[path] = table
        self.held[path] = out = self.spark.table(table)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete the files and catalog entries of tables that nothing reads any more."""
        for path in [p for p, x in self.held.items() if any(x is t for t in tables)]:
            if path in self.names:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.names.pop(path)}")
            delete(self.spark, path)
            del self.held[path]

    def release(self) -> None:
        """Collect the driver's garbage: until it is, Spark keeps the shuffle files of ended queries, and the driver what it had for them."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def close(self, *keep: DataFrame) -> None:
        """Drop all tables but those that a result still reads."""
        self.drop(*(x for x in self.held.values() if not any(x is k for k in keep)))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key with more than one in so many rows is hot; so there are at most so many hot keys.
HOT_KEYS = 500


def join_on_hot_key(left: DataFrame, right: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Left join of ``left`` to ``right``, which has one row for each ``key`` and in ``count`` its rows in ``left``.

    Keys that hold over 1/HOT_KEYS of the ``total`` rows, at most HOT_KEYS of them, are joined
    by broadcast; the rows of the rest are shuffled by the key, and the hot rows, which don't
    need it, by a random one. Columns of ``right`` other than ``key`` must be new names.
    """
    names = [c for c in right.columns if c != key]
    hot = right.filter(F.col(count) * HOT_KEYS > F.lit(total)).select(
        F.col(key).alias("_hot_key"), F.struct(*names).alias("_hot"))
    cold = right.filter(F.col(count) * HOT_KEYS <= F.lit(total)).select(
        F.col(key).cast("string").alias("_cold_key"), F.struct(*names).alias("_cold"))
    out = left.join(F.broadcast(hot), left[key] == F.col("_hot_key"), "left")
    out = out.withColumn("_key", F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), F.col(key).cast("string"))
                         .otherwise(F.concat(F.lit("\x00"), F.monotonically_increasing_id().cast("string"))))
    out = out.join(cold, F.col("_key") == F.col("_cold_key"), "left")
    got = F.coalesce(F.col("_hot"), F.col("_cold"))
    return out.select(*[left[c] for c in left.columns], *[got[c].alias(c) for c in names])


def join_dealt(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, spread: Column, how: str = "inner") -> DataFrame:
    """Join of ``left`` to ``right``, which has one row for each ``key``, where keys have very many rows in ``left``.

    ``hot`` has these keys and in ``parts`` into how many parts to deal their rows, by ``spread`` (a
    column of ``left``). Each part gets a copy of the row of ``right``. The rest is joined as it is.
    """
    names = [c for c in right.columns if c != key]
    cold = left.join(hot.select(key), key, "left_anti").join(right, key, how)
    dealt = left.withColumn("_spread", spread).join(hot, key).withColumn("_part", F.pmod("_spread", "parts").cast("int"))
    copies = right.join(hot, key).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return cold.unionByName(dealt.drop("parts", "_spread").join(copies, [key, "_part"], how).select(*cold.columns)).select(*left.columns, *names)


#: Bits of a screen; at most 16 MiB are broadcast, whatever the input.
SCREEN_LOG2 = 27
#: Bits of one row of a screen, as the bitmap functions have it.
SCREEN_ROW = 32768


def screen_of(keys: DataFrame, key: str) -> DataFrame:
    """(bucket, bits): a bitmap of 2^SCREEN_LOG2 bits, with that of each key's hash set."""
    at = F.pmod(F.xxhash64(key), F.lit(1 << SCREEN_LOG2))
    return keys.select(at.alias("at")).groupBy(F.floor(F.col("at") / SCREEN_ROW).cast("int").alias("bucket")).agg(
        F.bitmap_construct_agg(F.col("at") % SCREEN_ROW).alias("bits"))


def screened(rows: DataFrame, key: str, screen: DataFrame) -> DataFrame:
    """The rows whose key may be one of the screen's: all that are, and of the others a share that grows with the keys."""
    at = F.pmod(F.xxhash64(key), F.lit(1 << SCREEN_LOG2))
    bit = F.col("_at") % SCREEN_ROW
    byte = F.conv(F.hex(F.substring("bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("_at", at).join(F.broadcast(screen), F.floor(F.col("_at") / SCREEN_ROW).cast("int") == F.col("bucket"))
    return found.filter(F.getbit(byte, (bit % 8).cast("int")) == 1).select(*rows.columns)


# ---- helpers that run inside Arrow tasks -------------------------------------------------


class WordHash(dict):
    """64-bit hashes of words, each computed once for a task."""

    LIMIT = 1 << 18

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


#: Odd multipliers, one for each place in a shingle.
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                  0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads sums over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Words of more bytes are hashed one by one.
LONG_WORD = 256
#: Bytes of a text whose words are hashed at a time, LONG_WORD at least.
BLOCK = 1 << 16
_IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: 64 bits for each byte, A-Z as a-z; powers of an odd number and of its inverse modulo 2^64.
_BYTE = mix(np.frombuffer(bytes(range(256)).lower(), np.uint8) * _MULT[0] + _MULT[1])
_POWER, _INVERSE = (np.cumprod(np.r_[np.uint64(1), np.full(BLOCK - 1, x, np.uint64)]) for x in (int(_MULT[2]), pow(int(_MULT[2]), -1, 1 << 64)))


def word_hashes(text: bytes, cache: WordHash) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` in order, with A-Z as a-z.

    A word's hash is a polynomial of its bytes: the difference of two running sums over the text, divided by the power at its start.
    Words of more than LONG_WORD bytes are looked up in ``cache``.
    """
    a = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(a) + 2, bool)
    inside[1:-1] = ~_IS_SPACE[a]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        at = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, at + BLOCK, "right")))
        part = a[at:min(ends[j - 1], at + BLOCK)]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * _POWER[:len(part)], out=sums[1:])
        s, e = starts[i:j] - at, np.minimum(ends[i:j] - at, len(part))
        out[i:j] = mix((sums[e] - sums[s]) * _INVERSE[s] + (e - s).astype(np.uint64))
        i = j
    for k in np.flatnonzero(ends - starts > LONG_WORD):
        out[k] = cache[text[starts[k]:ends[k]].lower()]
    return out


def shingles(text: str | None, cache: WordHash, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles of a text.

    With fewer words the whole sequence is the one shingle; without words there is none.
    """
    h = word_hashes(text.encode(), cache) if text else ()
    if not len(h):
        return np.empty(0, np.uint64)
    k = min(width, len(h))
    s = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        s += h[i:len(h) - k + 1 + i] * _MULT[i]
    s = np.sort(mix(s))
    new = np.empty(len(s), bool)
    new[0] = True
    np.not_equal(s[1:], s[:-1], out=new[1:])
    return s if new.all() else s[new]
