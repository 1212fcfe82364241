"""Substring dedup: passages that several documents share.

Paragraphs are found by MinHash banding over their five-word shingles: the bands are tuned for
recall, colliding paragraphs are compared by exact Jaccard similarity, and the similar ones are
clustered by connected components: first each with one head of its bucket, then, as long as that
pays, with other heads, and last all those of one bucket that are in different components and
whose bitmaps let them be similar. A passage can also be pasted into the middle of a paragraph; so
the words of a text are cut as well where a word's hash is the least around it, which cuts a
passage alike wherever it stands, and equal pieces collide in one band of their own. Touching
units of a document that are shared make a passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulith.llm.common import _MULT, Scratch, WordHash, mix
from tabulith.llm.components import components
from tabulith.llm.jaccard_join import _linked

#: Least words of a paragraph that is banded, and of a shared passage that is reported.
MIN_PARAGRAPH, MIN_PASSAGE = 20, 20
#: Words on each side among which a cut has the least hash.
AROUND = 5
#: Words of 64 bits in the bitmap of a paragraph's shingles.
BITMAP = 8
#: Characters of text that are cut into units at a time.
TEXT_CHARS = 1 << 20
#: Open pairs for each place in a bucket beyond which another head is tried before all pairs are compared.
OPEN_PAIRS = 4
UNIT = "key long, piece boolean, doc_id long, start int, end int, fp long"
_POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))


def tune_bands(similarity: float = 0.75, recall: float = 0.98, most: int = 64) -> tuple[int, int]:
    """(bands, rows): the most selective banding of fewest hashes that finds a pair of this similarity with this recall."""
    found = [(b * r, -r, b, r) for r in range(1, 5) for b in range(1, most + 1) if 1 - (1 - similarity**r) ** b >= recall]
    two = [x for x in found if x[3] == 2]  # pairs of minima: one is too easily shared, more need many bands
    *_, b, r = min(two or found)
    return b, r


def _shingle_hashes(h: np.ndarray) -> np.ndarray:
    """Hashes of the five-word shingles at each place of the words of hashes ``h``, five at least."""
    s = np.full(len(h) - 4, 5, np.uint64)
    for i in range(5):
        s += h[i:len(h) - 4 + i] * _MULT[i]
    return mix(s)


def units(texts: list[str | None], cache: WordHash, bands: int, rows: int, min_paragraph: int = MIN_PARAGRAPH) -> tuple[np.ndarray, ...]:
    """(key, piece, text, start, end, fp) columns of the paragraphs (one row a band) and pieces of texts, given by their places in the list."""
    lines = [(d, line.split()) for d, t in enumerate(texts) if t for line in t.encode().lower().split(b"\n")]
    size, doc = np.array([len(w) for _, w in lines], np.int64), np.array([d for d, _ in lines], np.int64)
    n = int(size.sum())
    out = [(np.zeros(0, np.int64), np.zeros(0, bool), *(np.zeros(0, np.int64) for _ in range(4)))]
    h = np.fromiter((cache[w] for _, line in lines for w in line), np.uint64, n)
    first = np.cumsum(size) - size
    words = np.bincount(doc, weights=size, minlength=len(texts)).astype(np.int64)  # of each text
    base = np.cumsum(words) - words
    q = np.flatnonzero(size >= max(5, min_paragraph))
    if len(q):
        count = size[q] - 4
        begin = np.cumsum(count) - count
        s = _shingle_hashes(h)[np.repeat(first[q] - begin, count) + np.arange(count.sum())]
        fp, start = mix(np.add.reduceat(s, begin)).view(np.int64), first[q] - base[doc[q]]
        for b in range(bands):
            key = np.full(len(q), b + 1, np.uint64)
            for r in range(rows):
                key = key * _MULT[0] + np.minimum.reduceat(mix(s ^ _POWERS[b * rows + r]), begin)
            out.append((mix(key).view(np.int64), np.zeros(len(q), bool), doc[q], start, start + size[q], fp))
    v, low = mix(h), np.ones(n, bool)
    for d in range(1, AROUND + 1):
        low[d:] &= v[d:] < v[:-d]
        low[:-d] &= v[:-d] <= v[d:]
    cut = np.flatnonzero(low)
    own = np.repeat(np.arange(len(texts)), words)[cut]
    inside = (cut - base[own] >= AROUND) & (cut - base[own] < words[own] - AROUND)  # all words around it are of its text
    cut, own = cut[inside], own[inside]
    if len(cut) > 1:
        place = np.arange(cut[0], cut[-1]) - np.repeat(cut[:-1], np.diff(cut))
        fp = mix(np.add.reduceat(h[cut[0]:cut[-1]] * _POWERS[place % 4096], cut[:-1] - cut[0]) + np.diff(cut).astype(np.uint64)).view(np.int64)
        one = np.flatnonzero(own[:-1] == own[1:])
        at = base[own[one]]
        out.append((fp[one], np.ones(len(one), bool), own[one], cut[one] - at, cut[one + 1] - at, fp[one]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _unit_rows(bands: int, rows: int, min_paragraph: int):
    def groups(batch: pa.RecordBatch) -> Iterator[tuple[list, list]]:
        """Ids and texts of TEXT_CHARS together, or one text."""
        ids, texts, held = [], [], 0
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(i)
            texts.append(t.as_py())
            held += len(texts[-1] or "")
            if held >= TEXT_CHARS:
                yield ids, texts
                ids, texts, held = [], [], 0
        if ids:
            yield ids, texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for ids, texts in (g for batch in batches for g in groups(batch)):
            key, piece, text, start, end, fp = units(texts, cache, bands, rows, min_paragraph)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(piece), pa.array(np.array(ids, np.int64)[text]), pa.array(start.astype(np.int32)),
                                              pa.array(end.astype(np.int32)), pa.array(fp)], ["key", "piece", "doc_id", "start", "end", "fp"])

    return run


SETS = "fp long, tokens binary, " + ", ".join(f"bits{i} long" for i in range(BITMAP))


def _unit_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(units, text), units of fp, start and end, to SETS: the shingles of the words from start to end, and their bitmap."""
    cache = WordHash()
    for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
        fps, sets, bits = [], [], []
        for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            w = text.encode().lower().split() if text else []
            for u in own:
                part = w[u["start"]:u["end"]]
                s = _shingle_hashes(np.fromiter((cache[x] for x in part), np.uint64, len(part))) if len(part) > 4 else np.zeros(1, np.uint64)
                if int(mix(np.add.reduce(s, keepdims=True)).view(np.int64)[0]) != u["fp"]:
                    continue  # another text of this id
                s = np.unique(s)
                map_ = np.zeros(64 * BITMAP, np.uint8)
                map_[s % np.uint64(64 * BITMAP)] = 1
                fps.append(u["fp"])
                sets.append(s.tobytes())
                bits.append(np.packbits(map_).view(np.int64))
        bits = np.array(bits, np.int64).reshape(-1, BITMAP)
        yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(sets, pa.binary()), *(pa.array(bits[:, i].copy()) for i in range(BITMAP))],
                                         ["fp", "tokens", *(f"bits{i}" for i in range(BITMAP))])


def _places(shared: DataFrame) -> DataFrame:
    """Shared units (doc_id, start, end, cluster, lo) to places: those that touch and have one first document lo.

    Has start_word, end_word, clusters, and run_words: the words of the units that touch, whatever their first document.
    """
    def numbered(df: DataFrame, name: str, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy("start", "end")
        before = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
        new = df.withColumn("new", (F.col("start") > before).cast("int"))
        return new.withColumn(name, F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))

    run = Window.partitionBy("doc_id", "run")
    runs = numbered(shared, "run", "doc_id").withColumn("run_words", F.max("end").over(run) - F.min("start").over(run))
    return numbered(runs, "place", "doc_id", "lo").groupBy("doc_id", "lo", "place").agg(
        F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.max("run_words").alias("run_words"),
        F.collect_set("cluster").alias("clusters"))  # units of one document


def _verified(pairs: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """The similar ones of the distinct pairs (a, b)."""
    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("tokens").alias("s")), "a").join(
        sets.select(F.col("fp").alias("b"), F.col("tokens").alias("t")), "b").select("a", "b", "s", "t")
    return scratch.table(both.mapInArrow(_linked, "a long, b long"), "links")


#: Two sets of n and n' tokens with 7/4 similarity differ in (n + n')/7 tokens at most, and so do their bitmaps.
ALIKE = "7 * (" + " + ".join(f"bit_count(bits{i} ^ bits{i}_b)" for i in range(BITMAP)) + ") <= n + n_b"
FITS = f"comp != comp_b AND 4 * n >= 3 * n_b AND 4 * n_b >= 3 * n AND {ALIKE}"


def _settled(buckets: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) as if in each bucket (key, fp, copies) every two paragraphs were compared.

    Each is compared with one head of its bucket, at first the one of most copies. Buckets of one
    component are done. While the rest has many pairs across components, its buckets are
    compared with one more head, as long as that takes away a quarter of them. What is left is
    then compared but for pairs whose sizes and bitmaps rule a link out, which leaves few.
    """
    bits = [f"bits{i}" for i in range(BITMAP)]
    buckets = scratch.table(buckets.join(sets.select("fp", (F.octet_length("tokens") / 8).cast("long").alias("n"), *bits), "fp"), "buckets")
    comps, links, before, turn = None, None, None, 0
    while True:
        named = buckets.withColumn("comp", F.col("fp")) if comps is None else buckets.join(
            comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("comp", F.coalesce("component", "fp")).drop("component")
        mixed = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("key")
        left = scratch.table(named.join(mixed, "key", "left_semi"), "open")
        per = left.groupBy("key", "comp").agg(F.count("*").cast("double").alias("c")).groupBy("key").agg(
            ((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("pairs"), F.sum("c").alias("places"))
        pairs, places = per.agg(F.coalesce(F.sum("pairs"), F.lit(0.0)), F.coalesce(F.sum("places"), F.lit(0.0))).first()
        if not pairs and comps is not None:
            return comps
        last = pairs <= OPEN_PAIRS * places or (before is not None and pairs > 0.75 * before)
        other = left.select("key", *(F.col(c).alias(f"{c}_b") for c in ("fp", "n", "comp", *bits)))
        if not last:
            turn += 1
            pick = F.struct(*([-F.col("copies")] if turn == 1 else []), F.xxhash64("fp", F.lit(turn)))
            other = left.groupBy("key").agg(F.min_by(F.struct(*(F.col(c).alias(f"{c}_b") for c in ("fp", "n", "comp", *bits))), pick).alias("h")).select("key", "h.*")
        met = left.join(other, "key").filter(f"{FITS} AND fp < fp_b" if last else FITS)
        met = scratch.table(met.select(F.least("fp", "fp_b").alias("a"), F.greatest("fp", "fp_b").alias("b")).distinct(), "met")
        found = _verified(met, sets, scratch)
        links = found if links is None else links.unionByName(found)
        comps = components(links, scratch)
        scratch.drop(left, met)
        if last:
            return comps
        before = pairs


def shared_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_PASSAGE,
                    min_paragraph: int = MIN_PARAGRAPH) -> DataFrame:
    """Passages that stand in several documents, one row for each place.

    Returns ``id_col`` (long), start_word, end_word (places in the text's words, end exclusive),
    n_words (long), cluster (the least of the unit clusters that passages with a unit in common
    reach) and ``first``: whether the document is the one of least id in the cluster, whose copy a
    removal keeps. It holds all units of the cluster, as touching units whose first documents
    differ are places of their own. Shared units that touch must have ``min_words`` words together,
    so such a place can have fewer; the first document's places are given wherever another's are.
    Words are split at ASCII white space and A-Z lower-cased. The ends of a pasted passage may
    be cut by up to a piece, so a passage of 50 words shows with 20 or more. Paragraphs of under
    ``min_paragraph`` words (5 at least) aren't banded; their words are still in pieces.

    Null, empty and short texts give no rows. Rows with one id are one document, so repeats
    within it don't count; null ids are left out. Empty tables give an empty result; other columns
    are not read.
    """
    scratch = Scratch(docs.sparkSession, "passages")
    bands, rows = tune_bands()
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id IS NOT NULL")
    found = scratch.table(docs.mapInArrow(_unit_rows(bands, rows, min_paragraph), UNIT), "units")
    shared = found.groupBy("key", "piece").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo != hi").select("key", "piece")
    met = scratch.table(found.join(shared, ["key", "piece"], "left_semi"), "met")
    scratch.drop(found)

    # Paragraphs that collide and are not equal: their buckets, and their sets from one place of each.
    whole = met.filter("NOT piece")
    mixed = whole.groupBy("key").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).filter("least != most").select("key")
    buckets = scratch.table(whole.join(mixed, "key", "left_semi").groupBy("key", "fp").agg(F.count("*").alias("copies")), "buckets")
    need = whole.join(buckets.select("fp").distinct(), "fp", "left_semi").groupBy("fp").agg(F.min(F.struct("doc_id", "start", "end")).alias("p"))
    need = need.select("p.doc_id", F.struct("fp", "p.start", "p.end").alias("u")).groupBy("doc_id").agg(F.collect_list("u").alias("units"))  # of one document
    sets = scratch.table(docs.join(need, "doc_id").select("units", "text").mapInArrow(_unit_sets, SETS).dropDuplicates(["fp"]), "sets")
    comps = _settled(buckets, sets, scratch)

    # Units whose cluster is in two documents at least, and the passages that they make.
    named = met.select("piece", "doc_id", "start", "end", "fp").distinct().join(comps.withColumnRenamed("node", "fp"), "fp", "left").select(
        "piece", "doc_id", "start", "end", F.coalesce("component", "fp").alias("cluster"))
    named = scratch.table(named, "named")
    ends = named.groupBy("piece", "cluster").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo != hi")
    places = scratch.table(_places(named.join(ends, ["piece", "cluster"])), "places")
    joined = components(places.select(F.array_min("clusters").alias("a"), F.explode("clusters").alias("b")), scratch)
    out = places.withColumn("cluster", F.array_min("clusters")).join(joined.withColumnRenamed("node", "cluster"), "cluster", "left")
    out = out.withColumns({"cluster": F.coalesce("component", "cluster"), "first": F.col("doc_id") == F.col("lo")})
    long = out.filter(F.col("run_words") >= min_words)
    kept = out.filter(F.col("first") & (F.col("run_words") < min_words)).join(long.select("cluster").distinct(), "cluster", "left_semi")
    out = scratch.table(long.unionByName(kept.select(long.columns)), "passages")
    scratch.close(out)
    return out.select(
        F.col("doc_id").alias(id_col), F.col("start_word").cast("long").alias("start_word"), F.col("end_word").cast("long").alias("end_word"),
        (F.col("end_word") - F.col("start_word")).cast("long").alias("n_words"), "cluster", "first")
