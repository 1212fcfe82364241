"""Benchmark decontamination: BM25 over test items, asked by every passage of every text.

The index holds the test items. Postings are grouped in blocks of items, each term with its
largest weight in a block. A passage can reach an item's threshold only with enough of the
item's essential terms: the rest of its terms, its least weighted, are together worth less
than SLACK of it. So the sums of block maxima of essential terms over a sliding window, found
for many texts at once, in slices of bounded size, bound what any passage scores in a block; blocks whose
bound stays under their lowest threshold are skipped, and the items of the others are scored
in full. Hits are verified by the overlap of five-word shingles of question and answer.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulith.llm.common import ascii_lower, words

#: Passages: words in each, and words from one to the next.
PASSAGE, STRIDE = 96, 32
K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach, and share that its non-essential terms may hold.
REACH, SLACK = 0.6, 0.25
BLOCK_ITEMS = 16
#: Entries (a word in a block that has it) whose windows are summed at a time, and characters of text that are searched at a time.
ENTRIES, TEXT_CHARS = 1 << 20, 1 << 20
#: Bytes of item text in one index; larger benchmarks are searched index by index.
INDEX_BYTES = 16 << 20
#: Share of an item's shingles that a text must hold; each of question and answer needs HALF of that of its own.
OVERLAP, PART_OVERLAP = 0.75, 0.5


def _words(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def _shingles(w: list[bytes]) -> set[tuple[bytes, ...]]:
    k = min(5, len(w))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()


class Index:
    """BM25 weights of test items by term, in blocks, and what is needed to verify a hit."""

    def __init__(self, items: list[tuple[int, str, str]], n_items: int, mean_len: float, df: dict[bytes, int]):
        """items: (id, question, answer); n_items, mean_len and df describe the whole benchmark."""
        self.ids = [i for i, _, _ in items]
        self.parts = [(_words(q), _words(a)) for _, q, a in items]
        self.weights: list[dict[bytes, float]] = []
        need, postings = [], {}
        for k, (q, a) in enumerate(self.parts):
            tf, size = Counter(q + a), len(q) + len(a)
            w = {t: math.log(1 + (n_items - df[t] + 0.5) / (df[t] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * size / mean_len))
                 for t, n in tf.items()}
            total = sum(w.values())
            held, left = 0.0, set()
            for t in sorted(w, key=lambda t: (w[t], t)):
                if held + w[t] >= SLACK * total:
                    break
                held += w[t]
                left.add(t)
            reach = REACH * total * min(1.0, (PASSAGE - STRIDE) / max(size, 1))
            need.append((reach, max(reach - held, 1e-9)))
            self.weights.append(w)
            for t in w:
                if t not in left:
                    block = postings.setdefault(t, {})
                    block[k // BLOCK_ITEMS] = max(block.get(k // BLOCK_ITEMS, 0.0), w[t])
        self.reach = [r for r, _ in need]
        n_blocks = -(-len(items) // BLOCK_ITEMS)
        self.bound = np.array([min((n for _, n in need[b * BLOCK_ITEMS:(b + 1) * BLOCK_ITEMS]), default=0.0) for b in range(n_blocks)])
        self.terms = {t: i for i, t in enumerate(postings)}
        self.start = np.concatenate([[0], np.cumsum([len(p) for p in postings.values()])]).astype(np.int64)
        self.blocks = np.array([b for p in postings.values() for b in p], np.int64)
        self.maxima = np.array([m for p in postings.values() for m in p.values()], float)

    def open_blocks(self, texts: list[list[bytes]]) -> dict[int, dict[int, set[int]]]:
        """text to block to the places of words where a window's bound reaches the block's threshold."""
        found: dict[int, dict[int, set[int]]] = {}
        if not self.terms:
            return found
        get, gap = self.terms.get, PASSAGE
        sizes = np.array([len(w) for w in texts], np.int64)
        base = np.concatenate([[0], np.cumsum(sizes + gap)])
        term = np.fromiter((get(t, -1) for w in texts for t in w), np.int64, int(sizes.sum()))
        place = np.arange(len(term)) + np.repeat(gap * np.arange(len(texts)), sizes)
        hit = np.flatnonzero(term >= 0)
        term, place = term[hit], place[hit]
        n = self.start[term + 1] - self.start[term]
        ends, i = np.cumsum(n), 0
        while i < len(term):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + ENTRIES, side="right")))
            begin = int(np.searchsorted(place, place[i] - PASSAGE + 1))  # a window that ends in the slice may begin before it
            block, at = self._reached(term[begin:j], place[begin:j], n[begin:j], int(base[-1]) + gap)
            block, at = block[at >= place[i]], at[at >= place[i]]
            doc = np.searchsorted(base, at, side="right") - 1
            for d, b, p in zip(doc.tolist(), block.tolist(), (at - base[doc]).tolist(), strict=True):
                found.setdefault(d, {}).setdefault(b, set()).add(p)
            i = j
        return found

    def _reached(self, term: np.ndarray, place: np.ndarray, n: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
        """(block, place) where the window that ends there reaches the block's threshold; places are under ``span``."""
        at = np.repeat(self.start[term] - np.cumsum(n) + n, n) + np.arange(n.sum())
        block, place, score = self.blocks[at], np.repeat(place, n), self.maxima[at]
        key = block * span + place
        order = np.argsort(key, kind="stable")
        key, block, place, score = key[order], block[order], place[order], score[order]
        total = np.concatenate([[0.0], np.cumsum(score)])
        first = np.maximum(np.searchsorted(key, key - PASSAGE + 1), np.searchsorted(key, block * span))
        reached = np.flatnonzero(total[1:] - total[first] >= self.bound[block] - 1e-6)
        return block[reached], place[reached]

    def search_column(self, texts: pa.Array) -> Iterator[tuple[int, int, float, float, float, float]]:
        """As :meth:`search`, for texts of any number and length: TEXT_CHARS of them, or one text, at a time."""
        begin, held, size = 0, [], 0
        for k, t in enumerate(texts):
            held.append(t.as_py())
            size += len(held[-1] or "")
            if size >= TEXT_CHARS or k + 1 == len(texts):
                for d, *hit in self.search([_words(x) for x in held]):
                    yield begin + d, *hit
                begin, held, size = k + 1, [], 0

    def search(self, texts: list[list[bytes]]) -> Iterator[tuple[int, int, float, float, float, float]]:
        """(text, item, score, overlap, question's overlap, answer's overlap) of the verified hits."""
        for d, blocks in self.open_blocks(texts).items():
            text = texts[d]
            for b, places in blocks.items():
                passages = {s for p in places for s in range(max(0, (p - PASSAGE) // STRIDE + 1), p // STRIDE + 1)}
                bags = {s: set(text[s * STRIDE:s * STRIDE + PASSAGE]) for s in passages}
                for k in range(b * BLOCK_ITEMS, min((b + 1) * BLOCK_ITEMS, len(self.ids))):
                    w = self.weights[k]
                    scores = {s: sum(x for t, x in w.items() if t in bag) for s, bag in bags.items()}
                    good = [s for s, x in scores.items() if x >= self.reach[k] - 1e-6]
                    if not good:
                        continue
                    q, a = self.parts[k]
                    size = len(q) + len(a)
                    near: set[tuple[bytes, ...]] = set()
                    for s in good:  # the passage, and as much around it as the item is long
                        part = text[max(0, s * STRIDE - size):s * STRIDE + PASSAGE + size]
                        k5 = min(5, size)
                        near.update(tuple(part[i:i + k5]) for i in range(len(part) - k5 + 1))
                    whole = _shingles(q + a)
                    share = lambda x, near=near: len(x & near) / len(x) if x else 1.0
                    parts = [share(_shingles(x)) if len(x) >= 5 else share(whole) for x in (q, a)]
                    if share(whole) >= OVERLAP and min(parts) >= PART_OVERLAP:
                        yield d, self.ids[k], max(scores[s] for s in good), share(whole), *parts


def split_item(text: F.Column) -> tuple[F.Column, F.Column]:
    """(question, answer) of an item given as one text: its last sentence is the answer, if it isn't the only one."""
    text = F.trim(F.coalesce(text, F.lit("")))
    cut = F.regexp_extract(text, r"(?s)^(.*[.!?])[\x20\x09-\x0D]+([^.!?]*[.!?]?)$", 1)
    return F.when(cut == "", text).otherwise(cut), F.when(cut == "", F.lit("")).otherwise(
        F.regexp_extract(text, r"(?s)^(.*[.!?])[\x20\x09-\x0D]+([^.!?]*[.!?]?)$", 2))


def _indexes(items: DataFrame) -> Iterator[Index]:
    """Indexes of INDEX_BYTES of items each, with document frequencies over all items."""
    items = items.select(F.col("item_id").cast("long"), F.coalesce("question", F.lit("")).alias("question"),
                         F.coalesce("answer", F.lit("")).alias("answer")).distinct()
    items = items.filter(F.concat("question", "answer").rlike(r"[^\x20\x09-\x0D]"))  # an item without words is in no text
    nbytes = F.octet_length("question") + F.octet_length("answer")
    n, size = items.agg(F.count("*"), F.sum(nbytes)).first()
    shards = -(-(size or 0) // INDEX_BYTES)
    bag = words(ascii_lower(F.concat_ws(" ", "question", "answer")))
    mean = items.agg(F.avg(F.size(bag))).first()[0] or 1.0
    df_all = items.select(F.explode(F.array_distinct(bag)).alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    for k in range(shards):
        part = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == k).orderBy("item_id", "question", "answer")
        rows = [tuple(r) for r in part.collect()]  # INDEX_BYTES or so: the items are a test set, in shards
        terms = {t for _, q, a in rows for t in _words(q) + _words(a)}
        if shards == 1:
            df = {r.t.encode(): r.df for r in df_all.collect()}
        else:
            here = part.select(F.explode(bag).alias("t")).distinct()
            df = {r.t.encode(): r.df for r in df_all.join(here, "t", "left_semi").collect()}
        yield Index(rows, n, mean, {t: df.get(t, 1) for t in terms})


def find_leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Test items (item_id, question, answer) that texts hold.

    Returns a row for each document and item found in it: ``id_col``, item_id (long), score (the
    best BM25 score of a passage), overlap, question_overlap, answer_overlap (double). Documents
    without a hit have no row. Null and empty texts and items never match; repeated documents
    give repeated rows, repeated items count once; empty tables give an empty result. Items of
    under five words match as whole sequences; other columns are not read.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("item_id", T.LongType()),
                           *(T.StructField(c, T.DoubleType()) for c in ("score", "overlap", "question_overlap", "answer_overlap"))])
    out = spark.createDataFrame([], schema)
    for index in _indexes(items):
        shared = spark.sparkContext.broadcast(cloudpickle.dumps(index))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held = cloudpickle.loads(shared.value)
            for batch in batches:
                rows = list(held.search_column(batch.column(1)))
                at = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), pa.array([r[1] for r in rows], pa.int64()),
                     *(pa.array([r[i] for r in rows], pa.float64()) for i in range(2, 6))], names=schema.names)

        out = out.unionByName(docs.select(id_col, text_col).mapInArrow(search, schema))
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows in whose text :func:`find_leaks` finds an item. Nothing is shuffled."""
    for index in _indexes(items):
        shared, at = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(index)), docs.columns.index(text_col)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared, at=at) -> Iterator[pa.RecordBatch]:
            held = cloudpickle.loads(shared.value)
            for batch in batches:
                bad = {r[0] for r in held.search_column(batch.column(at))}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
