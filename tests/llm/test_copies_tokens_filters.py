"""Exact copies, aligned tokenizers and the filter audit against brute force, and their SQL."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabulith.llm import token_align
from tabulith.llm.common import screen_of, screened
from tabulith.llm.exact_dedup import exact_groups
from tabulith.llm.filter_audit import audit, every_order
from tabulith.llm.queries import ORACLES, QUERIES
from tabulith.llm.token_align import align_tokens, encode_and_post, pair_counts

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, h string, id long, t string, row long, kept boolean, n long"
LONG = "word " * 40_000
TEXTS = [(5, "a  b"), (3, "a b"), (9, "a\t\nb"), (3, "a b"), (4, "a b "), (7, None), (2, ""), (8, " "), (1, LONG), (6, LONG + "x"), (None, "a b"), (None, "only null"), (10, "É é"), (11, "É é")]


def frame(spark, rows, langs=("en", None, "de")):
    return spark.createDataFrame([(i, t, langs[k % len(langs)], "h", 1, "t", 2, False, 3) for k, (i, t) in enumerate(rows)], SCHEMA)


def spaced(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def brute_copies(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(spaced(t), []).append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[spaced(t)] if x is not None]
        out.append((i, min(ids) if ids else None, len(groups[spaced(t)]), hashlib.sha256(spaced(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [F.md5, lambda t: F.substring(F.md5(t), 1, 1), lambda t: F.lit("all the same")])
def test_equal_texts_are_grouped_whatever_the_hash(spark, digest):
    got = exact_groups(frame(spark, TEXTS).repartition(3), digest=digest).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute_copies(TEXTS)
    assert Counter(r.text_sha256 for r in got if r.kept) == dict.fromkeys({r.text_sha256 for r in got}, 1)  # one row of each group, repeated ids too
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_no_rows_no_copies(spark):
    assert exact_groups(frame(spark, TEXTS).filter("false")).count() == 0


def test_a_screen_lets_all_keys_through(spark):
    keys, rows = spark.range(0, 3000, 3).selectExpr("cast(id as string) k"), spark.range(3000).selectExpr("cast(id as string) k", "id")
    got = {r.id for r in screened(rows, "k", screen_of(keys, "k")).collect()}
    assert got >= set(range(0, 3000, 3)) and len(got) < 1010


# ---- tokens --------------------------------------------------------------------------------

A = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")


def byte_table():
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


TABLE = byte_table()


def tokens_of(text):
    """(ids, bytes) of both tokenizers, from the whole text; None where the bytes differ."""
    if not text:
        return None
    a = A.encode(" " + text, add_special_tokens=False)
    bytes_a = [bytes(TABLE[c] for c in t) for t in a.tokens]
    ids = B.encode(text)
    bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(B.id_to_piece, ids)]
    raw = (" " + text).encode()
    return (a.ids, bytes_a, ids, bytes_b) if b"".join(bytes_a) == raw == b"".join(bytes_b) else None


def brute_align(texts):
    links, groups = [], []
    for text in texts:
        found = tokens_of(text)
        if not found:
            links.append([])
            groups.append(("", 0, 0, 0))
            continue
        ids_a, bytes_a, ids_b, bytes_b = found
        spans = lambda parts: [(sum(map(len, parts[:i])), sum(map(len, parts[:i + 1]))) for i in range(len(parts))]
        sa, sb = spans(bytes_a), spans(bytes_b)
        links.append([(x, y) for x, (s, e) in zip(ids_a, sa, strict=True) for y, (p, q) in zip(ids_b, sb, strict=True) if s < q and p < e])
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        parts, low = [], 0
        for cut in cuts:
            parts.append(",".join(str(x) for x, (_, e) in zip(ids_a, sa, strict=True) if low < e <= cut) + "|" + ",".join(str(y) for y, (_, e) in zip(ids_b, sb, strict=True) if low < e <= cut))
            low = cut
        groups.append((hashlib.sha256(";".join(parts).encode()).hexdigest(), len(ids_a), len(ids_b), len(parts)))
    docs = Counter(p for own in links for p in set(own))
    most = {}
    for (a, _), n in docs.items():
        most[a] = max(most.get(a, 0), n)
    return [(na, nb, ng, len(own), sum(docs[p] == most[p[0]] for p in own), sum(docs[p] for p in own), sha) for own, (sha, na, nb, ng) in zip(links, groups, strict=True)], docs, Counter(p for own in links for p in own)


ODD = ["plain words, and more words", None, "", " ", "  two  spaces \n\n lines\t tab ", "<|endoftext|> and <s> </s> [INST] <unk> <0x41>", "lower one eighth ▁ block", "▁", "naïve café — “quoted” 東京タワー 😀😀", "x" * 700 + " y",
       "don't we'll I'd 12345 67,8.9 a1b2", "plain words, and more words", "é combining ​ zero", "nul \x00 byte", "\x1c\x1d separators \x85 nel", "ﬁ ligature ½ ①", "tail space ", "_under_score #$% () {}"]


@pytest.mark.parametrize("at_once, dense", [(2_000_000, 4096), (7, 2)])
def test_tokens_align_as_by_brute_force(spark, monkeypatch, at_once, dense):
    monkeypatch.setattr(token_align, "LINKS_AT_ONCE", at_once)
    monkeypatch.setattr(token_align, "TEXTS_AT_ONCE", 5)
    if dense == 2:  # blocks of four documents, so that bitmaps, lists and several blocks occur
        monkeypatch.setattr(token_align, "BLOCK", 64)
        monkeypatch.setattr(token_align, "DENSE", 4)
    rng = random.Random(3)
    texts = ODD + [" ".join(rng.choice(("the", "of", "tokenization", "Überraschung", "re", "x1", "a\nb")) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    got = align_tokens(frame(spark, list(enumerate(texts))).repartition(2, "doc_id")).orderBy("doc_id").collect()
    want, _, _ = brute_align(texts)
    for r, w, t in zip(got, want, texts, strict=True):
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == w, t


def test_pairs_count_documents_and_links(spark):
    from tabulith.llm.common import Scratch

    texts = [t for t in ODD for _ in range(3)] + ["the the the the the the the"] * 3
    docs = frame(spark, [(1, t) for t in texts]).select("doc_id", "text")  # one id for all: rows are documents
    _, postings = encode_and_post(docs, Scratch(spark, "test"))
    _, n_docs, n_links = brute_align(texts)
    got = {(r.a, r.b): (r.n_docs, r.n_links) for r in pair_counts(postings).collect()}
    assert got == {p: (n, n_links[p]) for p, n in n_docs.items()}


def test_postings_hold_lists_and_bitmaps():
    low = np.concatenate([np.arange(0, 10_000), [5, 9]]).astype(np.uint16)
    pairs = np.array([7 << 32 | 9] * 10_000 + [1] * 2, np.uint64)
    times = np.concatenate([1 + np.arange(10_000) % 6, [1, 3]])
    batch = token_align._postings(3, pairs, low, times)
    full = [pa.array(np.full(batch.num_rows, x)) for x in (10, True)]
    rows = pa.RecordBatch.from_arrays([batch.column("block"), batch.column("plane"), batch.column("docs"), *full], ["block", "plane", "docs", "n_docs", "best"])
    (out,) = token_align._returned(iter([rows]))
    want = Counter(dict(enumerate((1 + np.arange(10_000) % 6).tolist()))) + Counter({5: 1, 9: 3})
    assert dict(zip(out.column("low").to_pylist(), out.column("n_links").to_pylist(), strict=True)) == dict(want)
    assert out.column("count_sum").to_pylist() == [10 * x for x in out.column("n_links").to_pylist()]
    assert {len(x) for x in batch.column("docs").to_pylist()} >= {8192, 4}


def test_new_words_are_encoded_together():
    folder = Path(token_align.FOLDER)
    pairing = token_align.Pairing((folder / token_align.FILE_A).read_text(), (folder / token_align.FILE_B).read_bytes())
    rng, seen, encode = random.Random(8), [], pairing.b.encode
    pairing.b.encode = lambda texts, **k: seen.append(len(texts)) or encode(texts, **k)
    word = lambda: "".join(rng.choice("abcdeéß東_.,'#1-\n") for _ in range(rng.randint(1, 12)))
    words = [" " + w for w in {word() for _ in range(3000)} if token_align._PLAIN(" " + w)]
    alone = pairing.align(words)
    assert seen == [len(words)] and None not in alone
    seen.clear()
    assert pairing.align(words, token_align.TOGETHER) == alone and sum(seen) <= len(words) // 200 + 1
    words[700] = " fi▁ne"  # B doesn't give its bytes back: what was encoded with it is encoded one by one
    seen.clear()
    got = pairing.align(words, token_align.TOGETHER)
    assert got[700] is None and got[:700] + got[701:] == alone[:700] + alone[701:] and sum(seen) <= len(words) // 200 + 1 + token_align.TOGETHER
    seen.clear()
    assert None not in pairing.texts(["".join(words[:700])[1:]]) and sum(seen) < 10


def test_no_texts_no_tokens(spark):
    assert align_tokens(frame(spark, []).select("doc_id", "text")).count() == 0
    zeros = align_tokens(frame(spark, [(1, None), (2, "▁")])).collect()
    assert all((r.n_a, r.n_b, r.n_links, r.count_sum, r.groups_sha256) == (0, 0, 0, 0, "") for r in zeros)


# ---- filters -------------------------------------------------------------------------------


def brute_audit(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    fails = []
    for i, t, part in rows:
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        f = set()
        f |= {"A"} if len(w) < 100 else set()
        f |= {"B"} if 100 * len(set(w)) < 80 * len(w) else set()
        f |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t) else set()
        f |= {"D"} if set(t) & set("#$%&*|") else set()
        f |= {"E"} if i is not None and first[t] < i else set()
        fails.append((part or "", f, *labels.get(i, (0, 0))))
    out = {}
    for part in {p for p, *_ in fails}:
        own, share = [x for x in fails if x[0] == part], Counter()
        for order in permutations("ABCDE"):
            left = list(own)
            for k, letter in enumerate(order):
                gone = [x for x in left if letter in x[1]]
                stay = [x for x in left if letter not in x[1]]
                share[letter] += len(gone)
                out[part, "".join(order), k + 1] = [len(stay), len(gone), sum(letter in x[1] for x in own) - len(gone), sum(x[1] == {letter} for x in own),
                                                   sum(x[2] == 1 for x in gone), sum(x[3] == 1 for x in gone), letter]
                left = stay
        for key, x in out.items():
            if key[0] == part and isinstance(x[-1], str):
                x[-1] = share[x[-1]]
    return out


def test_every_order_of_the_filters(spark):
    rng = random.Random(5)
    base = [None, "", "short", "SHOUT " * 120, "w " * 150, " ".join(f"w{i}" for i in range(130)), " ".join(f"w{i}" for i in range(130)) + " #", "A " * 3 + "$", LONG]
    rows = [(rng.choice([*range(60), None]), rng.choice(base), rng.choice(["en", "de", None, ""])) for _ in range(150)] + [(3, "short", "en")] * 3
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(50)]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, lang string, part string, mask int, n int").repartition(3)
    lab = spark.createDataFrame([(*x, "z") for x in [*labels, labels[1]]], "doc_id long, quality int, toxic int, part string")
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in audit(docs, lab).collect()}
    assert got == brute_audit(rows, {i: (q, t) for i, q, t in labels})
    assert audit(docs.filter("false"), lab).count() == 0


def test_orders_need_combinations_only(spark):
    combos = spark.createDataFrame([("p", 3, 10, 4, 1)], "part string, mask int, n long, good long, toxic long")
    got = {(r.filter_order, r.step): (r.removed, r.redundant, r.shapley) for r in every_order(combos, "AB").collect()}
    assert got == {("AB", 1): (10, 0, 10), ("AB", 2): (0, 10, 10), ("BA", 1): (10, 0, 10), ("BA", 2): (0, 10, 10)}


# ---- queries -------------------------------------------------------------------------------


def test_queries_agree_with_sql(spark):
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    for name in ("op11_exact_dedup", "op13_filter_audit"):
        want = con.sql(ORACLES[name])
        got = QUERIES[name](spark, DATA).select(*want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(want.fetchall()), name


def test_token_query_agrees_with_brute_force(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").filter("length(text) < 3000").orderBy("doc_id").limit(60)
    rows = rows.select("doc_id", "text")
    got = {r.doc_id: r for r in align_tokens(rows).collect()}
    pairs = [(r.doc_id, r.text) for r in rows.collect()]
    want, _, _ = brute_align([t for _, t in pairs])
    for (i, _), w in zip(pairs, want, strict=True):
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == w
