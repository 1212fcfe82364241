"""N-gram Jaccard self-join with token-combination prefixes, and the groups that its links make.

Tokens are the distinct five-word shingles of a text. They get one global order: first those
whose counter in a table of counts, of bounded size, is low, then by hash. A set of n tokens and one
similar to it (Jaccard >= 3/4) share t = ceil(3n/4) tokens at least, so the first k of those
they share are among the first n - t + k of each. Each set is posted under these, its extended
prefix, with k = 2 + n/16, and with the place of each token in it.

Rare tokens are indexed one by one and frequent ones as pairs of near neighbours in the prefix
(:func:`_crossing`). There sets that share a passage only are ruled out by their places: tokens of
one's own are rarer and come first, so there are too many of them before those shared. Every
candidate is verified on the whole sets.

Copies don't multiply the work: texts with the same set are one node. First, each posting list
names its most central node, and each node is compared with the centre it meets most often,
which joins most edited copies of a text. Of the rest only pairs in different components are
followed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulith.llm.common import Scratch, WordHash, join_dealt, partitions, shingles
from tabulith.llm.components import components

#: Counters in the table of token counts, least and most; it is broadcast, 4 bytes for each.
COUNTERS_LOG2 = (18, 22)
#: Counters in one row, while they are summed.
SLOTS_A_ROW = 1 << 14
#: Between these, there is a counter for so many bytes of text.
BYTES_A_COUNTER = 3000
#: A posting list of more nodes than this is that of a frequent token.
FREQUENT = 128
#: Frequent tokens are combined with those at most so many places further in a prefix.
NEAR = 6
#: Texts whose postings go into one Arrow batch.
POST_BATCH = 1000
#: Nodes whose texts are picked by a broadcast of their ids; beyond, by a shuffle.
BROADCAST_IDS = 200_000
#: Bits of a token in postings; of a key's other bits, 0 is that of a list in one part and others are one more than the salt.
TOKEN_BITS = 48
#: Rows of one posting list, or pairs of one node, that one task may take before they are dealt to several.
LIST_SPLIT = 20_000


def _fingerprints(log2: int):
    """The function from (doc_id, text) to (doc_id, n, fp), then its task's counts of tokens in 2^log2 slots, as (part, counts): parts of SLOTS_A_ROW slots."""

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, counts = WordHash(), np.zeros(1 << log2, np.int64)
        for batch in batches:
            n, fp, held, size = [], [], [], 0
            for text in batch.column(1).to_pylist():
                s = shingles(text, cache)
                n.append(len(s))
                fp.append(_fp(s))
                held.append(_slots(s, log2))
                size += len(s)
                if size > 1 << 20:
                    counts += np.bincount(np.concatenate(held), minlength=len(counts))
                    held, size = [], 0
            if held:
                counts += np.bincount(np.concatenate(held), minlength=len(counts))
            k = len(n)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(fp, pa.int64()),
                                              pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], ["doc_id", "n", "fp", "part", "counts"])
        parts = [(i, _narrow(c)) for i, c in enumerate(np.minimum(counts, (1 << 31) - 1).reshape(-1, min(len(counts), SLOTS_A_ROW))) if c.any()]
        k = len(parts)
        yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()),
                                          pa.array([i for i, _ in parts], pa.int32()), pa.array([c for _, c in parts], pa.binary())],
                                         ["doc_id", "n", "fp", "part", "counts"])

    return fingerprints


def _narrow(c: np.ndarray) -> bytes:
    """Counts in as few bytes each as the greatest needs, then that number: most tasks meet no slot 256 times, and there is a table for each task."""
    width = 1 if c.max() < 1 << 8 else 2 if c.max() < 1 << 16 else 4
    return c.astype(f"<u{width}").tobytes() + bytes([width])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, counts) to one row for each part, its counts summed: a task holds the table of all counters at most."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, held in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = held.as_py()
            c = np.frombuffer(raw, f"<u{raw[-1]}", (len(raw) - 1) // raw[-1]).astype(np.int64)
            sums[part] = np.minimum(sums[part] + c if part in sums else c, (1 << 31) - 1)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([c.astype(np.int32).tobytes() for c in sums.values()], pa.binary())], ["part", "counts"])


def _table(first: DataFrame, log2: int) -> np.ndarray:
    """The 2^log2 counters, 4 bytes each, of what :func:`_fingerprints` gives; the driver takes one row for SLOTS_A_ROW of them."""
    table = np.zeros(1 << log2, np.int32)
    rows = first.filter(F.col("part").isNotNull()).select("part", "counts").repartition("part").mapInArrow(_summed, "part int, counts binary")
    for part, held in rows.toLocalIterator():
        table[part * SLOTS_A_ROW:(part + 1) * SLOTS_A_ROW] = np.frombuffer(held, np.int32)
    return table


def _slots(s: np.ndarray, log2: int) -> np.ndarray:
    return (s >> np.uint64(64 - log2)).astype(np.int64)


def _counters(size: int) -> int:
    """log2 of the counters for texts of so many bytes."""
    low, high = COUNTERS_LOG2
    return min(high, max(low, (size // BYTES_A_COUNTER).bit_length()))


def _fp(s: np.ndarray) -> int:
    """64 bits that stand for a set: a hash of its sorted tokens and their number."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), seed=len(s) & 0xFFFF)).view(np.int64))


def _poster(counts, split: int):
    """The function that posts each set under its first tokens; ``counts`` is a broadcast array, a power of two long.

    A token has a salt if its counter is over twice the mean of all by ``split`` or more, so that
    the counts of many rare tokens in one counter split no list. A key is the token's first TOKEN_BITS
    bits and the salt: tokens that agree in these share a list, which only adds candidates.
    """

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, table = WordHash(), counts.value
        log2, usual = len(table).bit_length() - 1, 2 * int(table.mean())
        low, rest = np.uint64((1 << 32) - 1), 64 - TOKEN_BITS
        for texts in (b.column(0).slice(i, POST_BATCH).to_pylist() for b in batches for i in range(0, b.num_rows, POST_BATCH)):
            keys, fps, places, seen = [], [], [], set()
            for text in texts:
                s = shingles(text, cache)
                if not len(s) or (fp := _fp(s)) in seen:
                    continue
                seen.add(fp)
                c = table[_slots(s, log2)]
                take = min(len(s), len(s) - -(-3 * len(s) // 4) + 2 + len(s) // 16)
                rank = (c.astype(np.uint64) << np.uint64(32)) | (s & low)  # ties in order of the whole hash: s is sorted
                first = np.argsort(rank, kind="stable")[:take]
                fps.append(np.full(take, fp, np.int64))
                places.append(np.arange(take, dtype=np.int32))
                parts = np.minimum(1 + np.maximum(c[first].astype(np.int64) - usual, 0) // split, (1 << rest) - 1)
                salt = np.where(parts > 1, 1 + abs(fp) % parts, 0).astype(np.uint64)
                keys.append((s[first] >> np.uint64(rest) << np.uint64(rest)) | salt)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(fps)),
                                                  pa.array(np.concatenate(places))], ["key", "fp", "pos"])

    return post


def _sketch(s: np.ndarray) -> bytes:
    """How many of the sorted tokens start with each of the first 2^k bit patterns, a byte for each: there are about two tokens for one."""
    k = max(len(s) - 1, 1).bit_length() - 1
    return np.minimum(np.bincount(_slots(s, k) if k else np.zeros(len(s), np.int64), minlength=1 << k), 255).astype(np.uint8).tobytes()


def _may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, sketch of a, sketch of b): the pairs whose sketches leave room for 100 * intersection >= 75 * union.

    Sets share no more tokens that start alike than the one with fewer has. The longer sketch is folded to the length of the other;
    a byte that is full bounds nothing, so its pairs stay.
    """
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            s, t = (np.frombuffer(v.as_buffer(), np.uint8) for v in (x, y))
            k = min(len(s), len(t))
            p, q = (v.reshape(k, -1).sum(axis=1, dtype=np.int64) for v in (s, t))
            both = int(np.minimum(p, q).sum())
            keep.append(bool(max(s.max(), t.max()) == 255 or 100 * both >= 75 * (p.sum() + q.sum() - both)))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, text) to (fp, tokens, sketch), the sorted tokens as bytes, of the texts that have this fp."""
    cache = WordHash()
    for batch in batches:
        sets = [(fp, s) for fp, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                if _fp(s := shingles(t, cache)) == fp]
        yield pa.RecordBatch.from_arrays([pa.array([fp for fp, _ in sets], pa.int64()),
                                          pa.array([s.tobytes() for _, s in sets], pa.binary()), pa.array([_sketch(s) for _, s in sets], pa.binary())],
                                         ["fp", "tokens", "sketch"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, tokens of a, tokens of b): the pairs with 100 * intersection >= 75 * union."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            small, large = min(len(s), len(t)), max(len(s), len(t))
            if 100 * small < 75 * large:
                keep.append(False)
                continue
            both = len(np.intersect1d(s, t, assume_unique=True))
            keep.append(100 * both >= 75 * (len(s) + len(t) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _sets(nodes: DataFrame, docs: DataFrame, members: DataFrame, scratch: Scratch) -> DataFrame:
    """(fp, tokens, sketch), in buckets of fp: the whole sets of the nodes, made again from the text of one member each."""
    rep = scratch.table(members.filter("n > 0").join(nodes, "fp", "left_semi").groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "rep")
    rep = F.broadcast(rep) if rep.count() <= BROADCAST_IDS else rep
    texts = docs.join(rep, docs.doc_id.eqNullSafe(rep.doc_id)).select("fp", "text")
    n = partitions(docs.sparkSession)
    return scratch.bucketed(texts.mapInArrow(_pack, "fp long, tokens binary, sketch binary").repartition(n, "fp").dropDuplicates(["fp"]), "sets", "fp", n)


def _posted(docs: DataFrame, counts, scratch: Scratch, split: int) -> tuple[DataFrame, DataFrame]:
    """(token, fp, pos): the posting lists with two nodes at least, each node once; long ones are put in order in parts. And the table it reads."""
    posted = docs.select("text").mapInArrow(_poster(counts, split), "key long, fp long, pos int")
    order = Window.partitionBy("key").orderBy("fp")
    once = posted.withColumn("before", F.lag("fp").over(order)).filter("before IS NULL OR before != fp")
    ranked = (once.withColumn("leader", F.first("fp").over(order.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("after", F.lead("fp").over(order)))
    alone = (F.col("leader") == F.col("fp")) & F.col("after").isNull()
    # Of a list in parts, a node that is alone in its part may have others in the next.
    rest = 64 - TOKEN_BITS
    parts = ranked.select(F.shiftrightunsigned("key", rest).alias("token"), "fp", "pos", (F.col("key").bitwiseAND((1 << rest) - 1) > 0).alias("split"),
                          alone.alias("alone"))
    parts = scratch.table(parts.filter("split OR NOT alone"), "parts")
    several = parts.filter("split").groupBy("token").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo != hi").select("token")
    lone = parts.filter("alone").join(several, "token", "left_semi")
    return parts.filter("NOT alone").unionByName(lone).select("token", "fp", "pos"), parts


def _links(pairs: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) that link. Their sketches meet first, an eighth of the sets at most, so that few sets are moved for pairs that don't."""
    near = _with_sets(pairs, sets, "sketch", scratch).mapInArrow(_may_link, "a long, b long")
    return scratch.table(_with_sets(scratch.table(near, "near"), sets, "tokens", scratch).mapInArrow(_linked, "a long, b long"), "links")


def _with_sets(pairs: DataFrame, sets: DataFrame, what: str, scratch: Scratch) -> DataFrame:
    """(a, b, ``what`` of a, ``what`` of b). Only that of ``a`` is moved, but for nodes of over LIST_SPLIT pairs: these are dealt, each part with a copy of it."""
    out = pairs.select("a", "b")
    for node, other, held in (("a", "b", "x"), ("b", "a", "y")):
        hot = pairs.groupBy(node).agg(F.count("*").alias("c")).filter(F.col("c") > LIST_SPLIT)
        hot = scratch.table(hot.select(node, F.ceil(F.col("c") / LIST_SPLIT).cast("int").alias("parts")), "hot")
        n = hot.count()  # a row for LIST_SPLIT pairs at most
        right = sets.select(F.col("fp").alias(node), F.col(what).alias(held))
        out = join_dealt(out, right, node, F.broadcast(hot) if n <= BROADCAST_IDS else hot, F.xxhash64(other)) if n else out.join(right, node)
    return out.select("a", "b", "x", "y")


def _prune(lists: DataFrame, members: DataFrame) -> DataFrame:
    """``lists`` (token, fp, pos) with n, without nodes in too few lists to link with any; dealt by fp. Lists may have one node left.

    A node shares 2 + n'/16 posted tokens with any similar one, of n' >= 3n/4 tokens. Adds ``central``: the share of
    a node's tokens that others have. It is highest for a text that others are edited copies of.
    """
    sizes = members.groupBy("fp").agg(F.max("n").cast("int").alias("n"))
    counted = lists.withColumn("listed", F.count("*").over(Window.partitionBy("fp"))).join(sizes, "fp")  # posted tokens of one text
    return counted.filter("listed >= 2 + floor(ceil(0.75 * n) / 16)").select("token", "fp", "pos", "n", (F.col("listed") / F.col("n")).alias("central"))


def _mixed(lists: DataFrame, comps: DataFrame) -> DataFrame:
    """(token, fp, n, pos, comp) of the lists whose nodes are in different components."""
    labelled = lists.join(comps.withColumnRenamed("node", "fp"), "fp", "left").select(
        "token", "fp", "n", "pos", F.coalesce("component", "fp").alias("comp"))
    mixed = labelled.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("token")
    return labelled.join(mixed, "token", "left_semi")


def _tries(lists: DataFrame) -> DataFrame:
    """(a, b): each node with the central node that it meets in most of its lists."""
    rank = F.struct(-F.col("central"), F.xxhash64("fp"))
    leaders = lists.groupBy("token").agg(F.min_by(F.struct("fp", "n"), rank).alias("l"))
    met = lists.join(leaders, "token").filter("fp != l.fp AND 4L * n >= 3L * l.n AND 4L * l.n >= 3L * n")
    shared = met.groupBy("fp", F.col("l.fp").alias("leader")).agg(F.count("*").alias("shared"))
    return shared.groupBy("fp").agg(F.max_by("leader", F.struct("shared", "leader")).alias("b")).withColumnRenamed("fp", "a")


def _largest(apart: Column, pos: Column) -> Column:
    """Tokens of the largest set that may link with one of n tokens through its token at ``pos``, before which ``apart`` aren't shared.

    Of sets of n and n' tokens that link, o = 3(n + n')/7 are shared at least, so that a set has n - o others at most.
    The r-th shared token is among its first n - o + r; r is up to 2 + n/16 (see _crossing).
    """
    n = F.col("n").cast("long")
    return F.floor(7 * (n - F.greatest(apart, pos - 1 - F.floor(n / 16))) / 3) - n


def _met(both: DataFrame) -> DataFrame:
    """Rows of two nodes (fp, n, rare; fp_b, n_b, rare_b) to a, n_a and b, n_b, the least first.

    Adds seen, their rows, and the greatest rare_a and rare_b of them.
    """
    first = F.col("fp") < F.col("fp_b")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    both = both.select(pick("fp", "fp_b").alias("a"), pick("n", "n_b").alias("n_a"), pick("rare", "rare_b").alias("rare_a"),
                       pick("fp_b", "fp").alias("b"), pick("n_b", "n").alias("n_b"), pick("rare_b", "rare").alias("rare_b"))
    return both.groupBy("a", "n_a", "b", "n_b").agg(F.count("*").alias("seen"), F.max("rare_a").alias("rare_a"), F.max("rare_b").alias("rare_b"))


def _in_lists(rows: DataFrame) -> DataFrame:
    """Pairs of one list, of (token, fp, comp, n, rare, most). One of the two at least may link with a set as large as itself."""
    other = rows.select("token", *(F.col(c).alias(f"{c}_b") for c in ("fp", "comp", "n", "rare", "most")))
    return _met(rows.filter("most >= n").join(other, "token").filter(
        "comp != comp_b AND (fp < fp_b OR most_b < n_b) AND n_b <= most AND n <= most_b"))


def _partnered(rows: DataFrame) -> DataFrame:
    """Rows (token, fp, comp, n, most, ...) that may link with one of another component in their list, with in_top: is theirs the one with most nodes there.

    For that the list must have a set, of another component, that is no larger than ``most`` and may link with one of n tokens. For rows of the
    top component the least size and greatest ``most`` of the others are looked at, for others those of the whole list. So of a large group of
    copies only those stay that are as close to the others as a link asks, and no pair is lost.
    """
    sums = rows.groupBy("token", "comp").agg(F.count("*").alias("c"), F.min("n").alias("least"), F.max("most").alias("open"))
    top = sums.groupBy("token").agg(F.max_by("comp", "c").alias("top"), F.count("*").alias("comps")).filter("comps > 1").select("token", "top")
    bounds = sums.join(top, "token").groupBy("token", "top").agg(
        F.min("least").alias("least"), F.max("open").alias("open"),
        F.min(F.when(F.col("comp") != F.col("top"), F.col("least"))).alias("others_least"),
        F.max(F.when(F.col("comp") != F.col("top"), F.col("open"))).alias("others_open"))
    in_top = F.col("comp") == F.col("top")
    may = (F.when(in_top, F.col("others_least")).otherwise(F.col("least")) <= F.col("most")) & (
        F.when(in_top, F.col("others_open")).otherwise(F.col("open")) >= F.col("n"))
    return rows.join(bounds, "token").filter(may).select(*rows.columns, in_top.alias("in_top"))


def _in_crowds(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """As _in_lists, for lists of any length: a set asks for others by classes of size that grow by a quarter.

    The component with most nodes in a list doesn't ask: the others ask for its sets of any fitting
    size, and among themselves for smaller ones. So a large group of linked copies is only
    looked up, by nodes that are not in it, and copies that have too many tokens of
    their own meet none of its size.
    """
    rows = _partnered(scratch.table(rows, "combos"))
    size = lambda n: F.floor(F.log(n.cast("double")) / math.log(1.25)).cast("int")
    least, own, any_ = F.ceil(0.75 * F.col("n")), F.least("n", "most"), F.least(F.floor(4 * F.col("n") / 3), F.col("most"))
    classes = lambda upto, of_top: F.transform(F.sequence(size(least), size(upto)), lambda c: F.struct(c.alias("size"), F.lit(of_top).alias("in_top")))
    ask = rows.filter(~F.col("in_top") & (F.col("most") >= least)).drop("in_top").select("*", F.inline(F.concat(classes(own, False), classes(any_, True))))
    held = rows.select("token", size(F.col("n")).alias("size"), "in_top", *(F.col(c).alias(f"{c}_b") for c in ("fp", "comp", "n", "rare", "most")))
    return _met(ask.join(held, ["token", "size", "in_top"]).filter(
        "comp != comp_b AND n_b <= most AND n <= most_b AND 4L * n >= 3L * n_b AND 4L * n_b >= 3L * n AND (in_top OR n_b < n OR (n_b = n AND fp < fp_b))"))


def _crossing(lists: DataFrame, scratch: Scratch) -> DataFrame:
    """Candidate pairs (a, b) of nodes in different components, from (token, fp, comp, n, pos).

    Two similar sets of n and n' tokens, n the smaller, share o = 3(n + n')/7 at least, so n - o at most of a set are
    not shared. Both post the first k = 2 + n/16 shared ones. A token posted before one of
    these is shared only if both post it, so there are n - o at most that are in no other list. If

    - one of the k is rare, the pair is in its list. Before the last such one, all rare tokens are shared but n - o.
    - all k are frequent, n - o tokens at most before the k-th are rare, and (n + n')/7 are not shared, in both sets.
      So of the k - 1 pairs of neighbours among the k, (n + n')/(7 NEAR) at most are more than NEAR places
      apart in either set; the others are combinations.
    """
    before = Window.partitionBy("fp").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)  # posted tokens of one text
    sized = lists.join(lists.groupBy("token").agg(F.count("*").alias("size")), "token").withColumn("often", F.col("size") > FREQUENT)
    sized = scratch.table(sized.withColumns({
        "own": F.col("pos") - F.count("*").over(before), "rare": F.col("pos") - F.count_if("often").over(before)}), "sized")
    open_ = 4 * F.col("most") >= 3 * F.col("n")
    few = _in_lists(sized.filter("NOT often").withColumn("most", _largest(F.col("own"), F.col("pos"))).filter(open_).drop("pos", "own", "size", "often"))
    few = few.filter(" AND ".join(f"7L * (n_{z} - rare_{z} + seen - 1) >= 3L * (n_a + n_b)" for z in "ab"))
    # A combination is as open as the later token, and the earlier one is no less open: what may link has both tokens left.
    often = _partnered(sized.filter("often").withColumn("most", _largest(F.col("rare"), F.col("pos"))).filter(open_))
    some = often.groupBy("fp", "comp", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "rare"))).alias("t"))  # of one text
    near = lambda x, i: F.filter(F.slice("t", i + 2, F.lit(NEAR)), lambda y: y["pos"] - x["pos"] <= NEAR)
    combined = F.flatten(F.transform("t", lambda x, i: F.transform(near(x, i), lambda y: F.struct(
        F.shiftrightunsigned(F.xxhash64(x["token"], y["token"]), 64 - TOKEN_BITS).alias("token"), y["pos"].alias("pos"), y["rare"].alias("rare")))))
    combos = some.select("fp", "comp", "n", F.explode(combined).alias("c")).select("c.token", "fp", "comp", "n", "c.rare", "c.pos")
    combos = combos.withColumn("most", _largest(F.col("rare"), F.col("pos"))).filter(open_).drop("pos")
    many = _in_crowds(combos, scratch).filter(f"seen >= 1 + div(least(n_a, n_b), 16) - div(n_a + n_b, {7 * NEAR})")
    return few.unionByName(many).select("a", "b").distinct()


def jaccard_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents linked, directly or through others, by Jaccard similarity >= 0.75.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text's set is that of its distinct
    five-word shingles (with fewer words, of the whole sequence); shingles are held as 64-bit
    hashes. Returns ``id_col`` (long), n_shingles (long), component_id (the least id reachable).

    Null or wordless texts have n_shingles 0 and are their own component. Repeated rows give
    repeated results; rows with one id and different texts belong to the components of each
    text. A null id gives a null component_id unless its group has an id. Empty tables give
    an empty result; other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    log2 = _counters(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    first = scratch.table(docs.mapInArrow(_fingerprints(log2), "doc_id long, n long, fp long, part int, counts binary"), "fingerprints")
    members = first.filter(F.col("part").isNull()).select("doc_id", "n", "fp")
    table = spark.sparkContext.broadcast(_table(first, log2))

    found, parts = _posted(docs, table, scratch, LIST_SPLIT)
    scratch.release()
    lists = scratch.bucketed(_prune(found, members), "lists", "fp", partitions(spark))
    scratch.drop(parts)
    sets = _sets(lists.select("fp").distinct(), docs, members, scratch)
    scratch.release()

    tries = scratch.table(_tries(lists), "tries")
    links = _links(tries, sets, scratch)
    comps = components(links, scratch)
    scratch.release()
    pairs = scratch.table(_crossing(scratch.table(_mixed(lists, comps), "mixed"), scratch), "pairs")
    scratch.release()
    more = _links(pairs, sets, scratch)
    comps = components(links.unionByName(more), scratch)

    named = members.join(comps.withColumnRenamed("node", "fp"), "fp", "left")
    named = scratch.table(named.withColumn("group", F.when(F.col("n") > 0, F.coalesce("component", "fp"))), "named")
    scratch.close(named)
    table.destroy()
    least = named.filter(F.col("group").isNotNull()).groupBy("group").agg(F.min("doc_id").alias("least"))
    out = named.filter(F.col("group").isNotNull()).join(least, "group").select("doc_id", "n", F.col("least").alias("component_id"))
    alone = named.filter(F.col("group").isNull()).select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
