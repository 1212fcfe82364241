"""Alignment of two tokenizers over a corpus, scored by inverted bitmaps of token pairs.

Both tokenizers cut the same bytes. Where both end a token, the text is cut into groups; a token of
one and a token of the other are linked where their byte ranges overlap. For each pair of ids a
posting holds the documents it is linked in: a compressed bitmap, and planes of bits for how
often more than once it is linked in each. Popcounts of the bitmaps give the pair's number of documents in the corpus,
the weighted ones of the planes its links. Then the postings return the pairs' scores to the documents.

Documents are numbered as they are read, in blocks of 65,536. A posting covers one block at
most, so no pair is in one task however many documents have it, and the postings of one pair never share a document: the popcount of all
of them merged is the sum of theirs.

Both tokenizers never join a space to what is before it, so texts are cut at single spaces
and each different word is encoded and aligned once a task. A text whose pieces don't give back its bytes is encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.llm.common import Scratch, partitions

#: Where the vocabularies are, and the files of A (byte-level) and B (pieces with byte fallback).
FOLDER, FILE_A, FILE_B = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Links that a task holds before it writes them as postings; texts that it encodes at a time; words that it remembers.
LINKS_AT_ONCE, TEXTS_AT_ONCE, WORDS_HELD = 2_000_000, 500, 1 << 18
#: Documents in a block, and the numbers from which a bitmap is smaller than a list.
BLOCK, DENSE = 1 << 16, 4096
#: Blocks of one partition have ids that follow each other; this many fit.
BLOCKS = 1 << 20
#: Characters beyond which a word isn't remembered.
LONG_WORD = 200

#: Between a printable character and another, a single space starts a token for both tokenizers.
_CUT = re.compile(r"(?<=[\w!-~])(?= [\w!-~])")
#: Words that are cut from each other in any order, and how many of them are encoded as one text.
_PLAIN, TOGETHER = re.compile(r" [\w!-~](?s:.*[\w!-~])?").fullmatch, 256


class Pairing:
    """Both tokenizers, with the bytes of each of their tokens."""

    def __init__(self, json_a: str, model_b: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(json_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model_b)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # characters that stand for themselves
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        names = {i: t for t, i in self.a.get_vocab().items()}
        self.bytes_a = [bytes(byte_of[c] for c in names[i]) if all(c in byte_of for c in names.get(i, "\0")) else names.get(i, "").encode() for i in range(max(names) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        code = re.compile(r"<0x([0-9A-F]{2})>")
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := code.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.list_a, self.list_b = self.size_a.tolist(), self.size_b.tolist()
        self.names = [f"{i}{c}" for i in range(max(len(self.bytes_a), len(self.bytes_b))) for c in ",|;"]
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        self.known: dict[str, tuple] = {}

    def words(self, text: str) -> list[str]:
        """Space and text, cut where both tokenizers cut."""
        return _CUT.split(" " + text) if self.cuts else [" " + text]

    def align(self, words: list[str], together: int = 1) -> list[tuple | None]:
        """(n_a, n_b, n_groups, groups, pairs) of each word, which starts with a space; None where the tokens' bytes aren't the word's. pairs are 64-bit codes.

        So many words ``together`` are encoded as one text, which must be cut between any two of them (_PLAIN). Where the tokens don't give the
        bytes of each of its words, its words are encoded one by one.
        """
        out: list[tuple | None] = [None] * len(words)
        texts = ["".join(words[i:i + together]) for i in range(0, len(words), together)] if together > 1 else words
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        ids_a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        ids_b = self.b.encode([t[1:] for t in texts], num_threads=1)
        good = self._whole(raw if together == 1 else [b"".join(raw[i:i + together]) for i in range(0, len(raw), together)], ids_a, ids_b)
        at = [i for k, ok in enumerate(good) if ok for i in range(k * together, min((k + 1) * together, len(words)))]
        if at:
            ids_a, ids_b = ([x for x, ok in zip(ids, good, strict=True) if ok] for ids in (ids_a, ids_b))
            found = self._aligned(*(np.array(list(chain.from_iterable(x)), np.int64) for x in (ids_a, ids_b)), np.cumsum([len(raw[i]) for i in at]))
            if found is None:  # a token over two words: none is known, but then they are encoded one by one
                good = [False] * len(good)
            else:
                for i, x in zip(at, found, strict=True):
                    out[i] = x
        if together > 1 and not all(good):
            rest = [i for k, ok in enumerate(good) if not ok for i in range(k * together, min((k + 1) * together, len(words)))]
            for i, x in zip(rest, self.align([words[i] for i in rest]), strict=True):
                out[i] = x
        return out

    def _aligned(self, a: np.ndarray, b: np.ndarray, ends: np.ndarray) -> list[tuple] | None:
        """What :meth:`align` gives, for tokens of the same bytes, cut where words end; None if a word ends inside a token."""
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        to_a, to_b = np.searchsorted(end_a, ends, "right"), np.searchsorted(end_b, ends, "right")
        if not (np.array_equal(end_a[to_a - 1], ends) and np.array_equal(end_b[to_b - 1], ends)):
            return None
        ended_a, ended_b = (np.zeros(ends[-1] + 1, bool) for _ in "ab")
        ended_a[end_a] = ended_b[end_b] = True
        shared_a, shared_b = ended_b[end_a], ended_a[end_b]  # where a group ends
        group_a, group_b = np.cumsum(shared_a) - shared_a, np.cumsum(shared_b) - shared_b
        first = np.searchsorted(end_b, end_a - self.size_a[a], "right")  # of B's tokens, those over an A token
        last = np.searchsorted(end_b - self.size_b[b], end_a)
        count = last - first
        links = np.cumsum(count)
        link_b = np.arange(links[-1]) - np.repeat(links - count - first, count)
        codes = ((np.repeat(a, count).astype(np.uint64) << np.uint64(32)) | b[link_b].astype(np.uint64)).tobytes()
        to_group, to_link = group_a[to_a - 1] + 1, links[to_a - 1]
        # In each group the tokens of A come first; a token's name has what follows it: "," in its side, "|" after A's, ";" after B's.
        name = np.concatenate([3 * a + shared_a, 3 * b + 2 * shared_b])
        place = np.concatenate([np.arange(len(a)) + np.searchsorted(group_b, group_a), np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")])
        order = np.empty_like(name)
        order[place] = name
        names = list(map(self.names.__getitem__, order.tolist()))
        out, i, g, p = [], 0, 0, 0
        for x, y, h, q in zip(to_a.tolist(), to_b.tolist(), to_group.tolist(), (8 * to_link).tolist(), strict=True):
            out.append((x - (i and last_a), y - (i and last_b), h - g, "".join(names[i:x + y])[:-1], codes[p:q]))
            i, last_a, last_b, g, p = x + y, x, y, h, q
        return out

    def _whole(self, raw: list[bytes], ids_a: list[list[int]], ids_b: list[list[int]]) -> list[bool]:
        """Whether the bytes of the tokens of both are the text's. Most are: compared all at once, then, where that fails, one by one."""
        all_of = lambda table, ids: b"".join(map(table.__getitem__, chain.from_iterable(ids)))
        if len(raw) > 1:
            ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
            same_length = all(np.array_equal(np.cumsum(np.fromiter((sum(map(size.__getitem__, x)) for x in ids), np.int64, len(ids))), ends)
                              for size, ids in ((self.list_a, ids_a), (self.list_b, ids_b)))
            if same_length and all_of(self.bytes_a, ids_a) == (joined := b"".join(raw)) == all_of(self.bytes_b, ids_b) and joined:
                return [True] * len(raw)
        return [all_of(self.bytes_a, [i]) == w == all_of(self.bytes_b, [j]) for i, w, j in zip(ids_a, raw, ids_b, strict=True)]

    def texts(self, texts: list[str | None]) -> list[tuple[int, int, int, str, np.ndarray] | None]:
        """What :meth:`align` gives, for whole texts; None for texts that have no tokens."""
        cut = [self.words(t) if t else [] for t in texts]
        if len(self.known) > WORDS_HELD:
            self.known.clear()
        new = list(set().union(*cut).difference(self.known))
        for some, together in ((list(filter(_PLAIN, new)), TOGETHER if self.cuts else 1), (list(filterfalse(_PLAIN, new)), 1)):
            self.known.update(zip(some, self.align(some, together), strict=True) if some else ())
        out: list[tuple | None] = []
        for text, ws in zip(texts, cut, strict=True):
            parts = list(map(self.known.__getitem__, ws))
            if None in parts:  # the pieces of the whole text decide
                parts = self.align([" " + text])
            if not parts or None in parts:
                out.append(None)
                continue
            n_a, n_b, n_groups, groups, pairs = zip(*parts, strict=True)
            out.append((sum(n_a), sum(n_b), sum(n_groups), ";".join(groups), np.frombuffer(b"".join(pairs), np.uint64)))
        for w in new:
            if len(w) > LONG_WORD:
                del self.known[w]
        return out


ENCODED = "doc_id long, block long, low int, n_a long, n_b long, n_groups long, groups_sha256 string, a int, b int, plane int, docs binary"


def _postings(block: int, pairs: np.ndarray, low: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    """One row for each pair and plane: the documents, as sorted 16-bit numbers or, where that is smaller, as a bitmap.

    Plane -1 has all documents of the pair, plane j those in which bit j of its further links is set. Documents of a pair come in order.
    """
    order = np.argsort(pairs, kind="stable")
    pairs, low, more = pairs[order], low[order], times[order] - 1
    cols: tuple[list, list, list] = ([], [], [])
    for plane in range(-1, int(more.max()).bit_length() if len(more) else -1):
        take = slice(None) if plane < 0 else (more >> plane) & 1 == 1
        p, d = pairs[take], low[take]
        if not len(p):
            continue
        start = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
        ends = np.append(start[1:], len(p))
        cols[0].append(p[start])
        cols[1].append(np.full(len(start), plane, np.int32))
        if (ends - start).max() < DENSE:
            offsets = pa.py_buffer((np.append(start, len(p)) * 2).astype(np.int32))
            cols[2].append(pa.Array.from_buffers(pa.binary(), len(start), [None, offsets, pa.py_buffer(d.tobytes())]))
        else:
            cols[2].append(pa.array([_packed(d[i:j]) for i, j in zip(start, ends, strict=True)], pa.binary()))
    p, docs = np.concatenate(cols[0]), pa.concat_arrays(cols[2])
    n = len(p)
    return _row_batch(n, block=pa.array(np.full(n, block, np.int64)), a=pa.array((p >> np.uint64(32)).astype(np.int32)), b=pa.array((p & np.uint64(0xFFFFFFFF)).astype(np.int32)),
                      plane=pa.array(np.concatenate(cols[1])), docs=docs)


def _packed(numbers: np.ndarray) -> bytes:
    if len(numbers) < DENSE:
        return numbers.tobytes()
    bits = np.zeros(BLOCK, np.uint8)
    bits[numbers] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _row_batch(n: int, **columns: pa.Array) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in ENCODED.split(", ")]
    return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, kinds[k])) for c, k in fields], [c for c, _ in fields])


def _encoder(files):
    """The function that aligns texts (doc_id, text) and gives a row for each, then the postings of their links."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        pairing = Pairing(*files.value)
        at, base = 0, TaskContext.get().partitionId() * BLOCKS
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush(block: int) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if held:
                yield _postings(block, *(np.concatenate(x) for x in zip(*held, strict=True)))
            held, size = [], 0

        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(i, TEXTS_AT_ONCE)
                found = pairing.texts(part.column(1).to_pylist())
                number = np.arange(at, at + len(found))
                for k, x in zip(number.tolist(), found, strict=True):
                    if k % BLOCK == 0:
                        yield from flush(base + (k - 1) // BLOCK)
                    if x:
                        links = np.sort(x[4])
                        start = np.flatnonzero(np.append(True, links[1:] != links[:-1]))
                        held.append((links[start], np.full(len(start), k % BLOCK, np.uint16), np.diff(start, append=len(links))))
                        size += len(start)
                        if size > LINKS_AT_ONCE:
                            yield from flush(base + k // BLOCK)
                at += len(found)
                count = lambda j: pa.array([x[j] if x else 0 for x in found], pa.int64())  # noqa: B023, E731
                yield _row_batch(len(found), doc_id=part.column(0).cast(pa.int64()), block=pa.array(base + number // BLOCK), low=pa.array((number % BLOCK).astype(np.int32)),
                                 n_a=count(0), n_b=count(1), n_groups=count(2), groups_sha256=pa.array([hashlib.sha256(x[3].encode()).hexdigest() if x else "" for x in found]))
        yield from flush(base + (at - 1) // BLOCK)

    return encode


def pair_counts(postings: DataFrame) -> DataFrame:
    """(a, b, n_docs, n_links, best): documents and links of each pair in the corpus; best if no other pair of its A id has more documents."""
    size = F.when(F.octet_length("docs") < 2 * DENSE, F.octet_length("docs") / 2).otherwise(F.bitmap_count("docs")).cast("long")
    links = F.when(F.col("plane") < 0, size).otherwise(size * F.pow(F.lit(2), F.col("plane")).cast("long"))
    pairs = postings.groupBy("a", "b").agg(F.sum(F.when(F.col("plane") < 0, size).otherwise(0)).alias("n_docs"), F.sum(links).alias("n_links"))
    most = pairs.groupBy("a").agg(F.max("n_docs").alias("most"))
    return pairs.join(most, "a").select("a", "b", "n_docs", "n_links", (F.col("n_docs") == F.col("most")).alias("best"))


def _returned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, plane, docs, n_docs, best), by block, to (block, low, n_links, n_best, count_sum): the sums of each document."""
    now, sums = None, np.zeros((3, BLOCK), np.int64)

    def done() -> pa.RecordBatch:
        low = np.flatnonzero(sums[0])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(low), now, np.int64)), pa.array(low.astype(np.int32)), *(pa.array(s[low]) for s in sums)],
                                          ["block", "low", "n_links", "n_best", "count_sum"])

    for batch in batches:
        block = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for i, j in zip(edges, edges[1:], strict=False):
            if j == i:
                continue
            if now is not None and block[i] != now:
                yield done()
                sums[:] = 0
            now = int(block[i])
            part = batch.slice(i, j - i)
            times = 1 << np.maximum(part.column(1).to_numpy(), 0).astype(np.int64)
            count, best = part.column(3).to_numpy(), part.column(4).to_numpy(zero_copy_only=False)
            docs = part.column(2)
            size = np.array(pc.binary_length(docs), np.int64)
            listed = size < 2 * DENSE
            low = [np.frombuffer(b"".join(docs.filter(pa.array(listed)).to_pylist()), np.uint16)]
            row = [np.repeat(np.flatnonzero(listed), size[listed] // 2)]
            for k in np.flatnonzero(~listed):
                bits = np.flatnonzero(np.unpackbits(np.frombuffer(docs[int(k)].as_buffer(), np.uint8), bitorder="little"))
                low.append(bits)
                row.append(np.full(len(bits), k))
            at, of = np.concatenate(low), np.concatenate(row)
            np.add.at(sums[0], at, times[of])
            np.add.at(sums[1], at, (times * best)[of])
            np.add.at(sums[2], at, (times * count)[of])
    if now is not None:
        yield done()


def encode_and_post(docs: DataFrame, scratch: Scratch, *, folder: str = FOLDER, file_a: str = FILE_A, file_b: str = FILE_B) -> tuple[DataFrame, DataFrame]:
    """(documents, postings) of docs (doc_id, text): documents have their numbers and counts; postings are (block, a, b, plane, docs).

    The driver reads both files, a few MB by nature of a vocabulary, and broadcasts them.
    """
    with open(f"{folder}/{file_a}") as f, open(f"{folder}/{file_b}", "rb") as g:
        files = docs.sparkSession.sparkContext.broadcast((json.dumps(json.load(f)), g.read()))
    both = scratch.table(docs.mapInArrow(_encoder(files), ENCODED), "encoded")
    files.destroy()
    return (both.filter("plane IS NULL").select("doc_id", "block", "low", "n_a", "n_b", "n_groups", "groups_sha256"),
            both.filter("plane IS NOT NULL").select("block", "a", "b", "plane", "docs"))


def align_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folder: str = FOLDER, file_a: str = FILE_A, file_b: str = FILE_B) -> DataFrame:
    """Every row with its tokens by both tokenizers, their groups and links, and the links' scores in the corpus.

    A encodes space and text, B text, to which it adds the space; special tokens in a text are plain text. Returns ``id_col`` (long), n_a,
    n_b, n_groups, n_links, n_best (links of pairs that no other pair of their A id passes in documents), count_sum
    (documents of the pairs, over the links) and groups_sha256. Null and empty texts, and those whose tokens don't give back their bytes, have
    zeros and ''. Repeated rows are documents each, also in the counts, whatever their ids. Empty tables give an empty result; other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "align")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    documents, postings = encode_and_post(own, scratch, folder=folder, file_a=file_a, file_b=file_b)
    counts = scratch.table(pair_counts(postings), "pairs")
    n = partitions(spark)
    # partitions of documents follow each other in the block ids: deal them out evenly
    place = F.pmod(F.floor(F.col("block") / BLOCKS) + F.pmod("block", F.lit(BLOCKS)), F.lit(n)).cast("int")
    scored = postings.join(counts.select("a", "b", "n_docs", "best"), ["a", "b"]).select("block", "plane", "docs", "n_docs", "best")
    sums = scored.repartitionById(n, place).sortWithinPartitions("block").mapInArrow(_returned, "block long, low int, n_links long, n_best long, count_sum long")
    sums = scratch.table(sums, "sums")
    scratch.drop(counts)
    out = documents.join(sums, ["block", "low"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(F.col("doc_id").alias(id_col), "n_a", "n_b", "n_groups", *(zero(c) for c in ("n_links", "n_best", "count_sum")), "groups_sha256")
