"""The queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.llm.chat import CLOSE, OPEN, format_trees, linear, read_back
from tabulith.llm.common import Scratch
from tabulith.llm.decontam import find_leaks, split_item
from tabulith.llm.exact_dedup import exact_groups
from tabulith.llm.filter_audit import audit
from tabulith.llm.html_extract import extract
from tabulith.llm.jaccard_join import jaccard_groups
from tabulith.llm.line_dedup import dedup_lines
from tabulith.llm.mixing import DIMENSIONS, ROUNDS, TOLERANCE, mix
from tabulith.llm.quality import quality_rules
from tabulith.llm.secrets import ADDED, BASE, EXAMPLE_OWNERS, EXAMPLE_REPOS, scan_secrets, span_text
from tabulith.llm.substring_dedup import shared_passages
from tabulith.llm.token_align import align_tokens
from tabulith.llm.warc import base32, payload_of, read_records, write_archive

_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of a passage that several documents share."""
    return shared_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its shingle set and its component."""
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_AZ}', '{_az}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles,
  least(s.doc_id, coalesce((SELECT min(b) FROM reach WHERE reach.a = s.doc_id), s.doc_id)) AS component_id FROM s
"""

def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its cell, its rate, and whether it is drawn."""
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 9).alias("probability"),
                      F.round("weight", 6).alias("weight"), "drawn")


def _op3_sql(rounds: int = ROUNDS, tolerance: float = TOLERANCE, keep: float = 0.5, power: float = 0.5, seed: int = 7) -> str:
    """Raking as a chain of common tables: one for the factors of a dimension after each step, one for the end of each round."""
    symbols = " + ".join(f"length(t) - length(replace(t, '{c}', ''))" for c in "#*$%&|<>")
    sql = rf"""
WITH w AS (SELECT *, coalesce(text, '') AS t,
    CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS n_tokens FROM documents),
d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, n_tokens,
    CASE WHEN n_tokens = 0 THEN 'empty' WHEN ({symbols}) * 10 > n_tokens THEN 'symbols' WHEN n_tokens < 100 THEN 'short'
      WHEN n_tokens < 1000 THEN 'middle' ELSE 'long' END AS topic FROM w),
cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL)"""
    now = {}
    for x in DIMENSIONS:
        sql += f""",
target_{x} AS MATERIALIZED (SELECT {x}, sum(tokens) ** {power} / sum(sum(tokens) ** {power}) OVER () AS share FROM cells GROUP BY {x}),
{x}_0 AS (SELECT DISTINCT {x}, CAST(1 AS DOUBLE) AS f_{x} FROM cells)"""
        now[x] = f"{x}_0"
    joined = lambda: "cells " + " ".join(f"JOIN (SELECT {x}, f_{x} FROM {now[x]}) USING ({x})" for x in DIMENSIONS)
    rate = " * ".join(f"f_{x}" for x in DIMENSIONS)
    for r in range(1, rounds + 1):
        ended = f"(SELECT ended FROM round_{r - 1})" if r > 1 else "false"
        for x in DIMENSIONS:
            sql += f""",
{x}_{r} AS MATERIALIZED (SELECT {x}, f_{x} * factor AS f_{x}, factor FROM (
  SELECT {x}, f_{x}, CASE WHEN {ended} OR m <= 0 THEN CAST(1 AS DOUBLE) ELSE share * (SELECT sum(tokens) FROM cells) / m END AS factor FROM
  (SELECT {x}, f_{x}, sum(tokens * {rate}) AS m FROM {joined()} GROUP BY {x}, f_{x}) JOIN target_{x} USING ({x})))"""
            now[x] = f"{x}_{r}"
        sql += f""",
round_{r} AS MATERIALIZED (SELECT coalesce(max(abs(factor - 1)), 0) <= {tolerance} AS ended FROM
  ({" UNION ALL ".join(f"SELECT factor FROM {x}_{r}" for x in DIMENSIONS)}))"""
    return sql + f""",
rated AS (SELECT source, lang, topic, {keep} * {rate} AS r FROM {joined()})
SELECT doc_id, source, lang, topic, n_tokens, round(least(1.0, r), 9) AS probability, round(greatest(1.0, r), 6) AS weight,
  CAST('0x' || substr(md5('{seed}:' || doc_id), 1, 13) AS BIGINT) / 4503599627370496.0 < least(1.0, r) AS drawn
FROM d JOIN rated USING (source, lang, topic)
"""


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its main text."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its secrets: counts and digest of the base spans, and all spans."""
    out = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("found", lambda x: x["rank"] < len(BASE))
    count = lambda f: F.size(F.filter("found", f)).cast("long")
    of_rank = lambda r: lambda x: x["rank"] == r
    return out.select("doc_id", *(count(of_rank(r)).alias(f"n_{k}") for r, (k, *_) in enumerate(BASE)),
                      F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("found")).alias("spans"),
                      count(lambda x: x["live"]).alias("n_live"), count(lambda x: ~x["live"]).alias("n_example"))


def _op5_sql() -> str:
    kinds = []
    for rank, (kind, rx, group, least) in enumerate(BASE + ADDED):
        rx = rx.replace("'", "''")
        kinds.append(f"""
  SELECT doc_id, source, {rank} AS rank, '{kind}' AS kind, {least} AS least, unnest(range(len(m))) AS i, unnest(m) AS m, unnest(v) AS v,
    unnest(list_transform(string_split_regex(t, '{rx}')[:len(m)], lambda x: length(x))) AS before
  FROM (SELECT *, regexp_extract_all(t, '{rx}') AS m, regexp_extract_all(t, '{rx}', {group}) AS v FROM d)""")
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
raw AS ({" UNION ALL ".join(kinds)}),
s AS (SELECT *, CAST(sum(before + length(m)) OVER (PARTITION BY doc_id, rank ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM raw),
f AS (SELECT doc_id, source, rank, v, e, e - length(m) AS b, kind || ':' || (e - length(m)) || ':' || e AS span FROM s WHERE length(v) >= least),
o AS (SELECT v, count(DISTINCT source) < {EXAMPLE_OWNERS} AND count(DISTINCT doc_id) < {EXAMPLE_REPOS} AS live FROM f GROUP BY v),
g AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  coalesce(string_agg(span, ',' ORDER BY b, rank) FILTER (rank < {len(BASE)}), '') AS base, string_agg(span, ',' ORDER BY b, rank) AS spans,
  count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example FROM f JOIN o USING (v) GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN g USING (doc_id)
"""


def test_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's items as questions and answers."""
    question, answer = split_item(F.col("text"))
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", question.alias("question"), answer.alias("answer"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a test item, with the item and how much of it."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), test_items(spark, sf_dir))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, written to an archive and read back."""
    path = Scratch(spark, "archive").path
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    records = read_records(spark, path)
    body = payload_of(F.col("record"), F.col("header_bytes"))
    return records.select("page_id", F.octet_length(body).cast("long").alias("payload_bytes"), base32(F.sha1(body)).alias("payload_digest"),
                          "record_type", "refers_to", "verified")


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first, sha1(h) AS x FROM p),
b AS (SELECT *, list_transform(range(4), lambda i: CAST('0x' || substr(x, CAST(i * 10 + 1 AS BIGINT), 10) AS BIGINT)) AS w FROM d)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((w[k // 8 + 1] >> CAST(5 * (7 - k % 8) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to, true AS verified
FROM b
"""


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one that holds control strings, formatted and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = spark.sql("SELECT -7L AS conv_id, CAST(t AS BIGINT) AS turn, r AS role, '</s>[INST] ok [/INST]' AS text "
                       "FROM VALUES (0, 'user'), (1, 'assistant') AS v(t, r)")
    read = read_back(format_trees(*linear(rows.unionByName(tricky))))
    turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join("learned", "")
    return read.select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
                       F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


def _op10_sql() -> str:
    safe = lambda c: f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')"
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS turns,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '') AS loss,
  CAST(sum(length({safe('role')}) + length({safe('text')}) + {len(OPEN) + 1 + len(CLOSE)}) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its lines before, its dropped lines and the digest of the rest."""
    kept = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP8_SQL = rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{_AZ}', '{_az}') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, c.last IS NOT NULL AND doc_id < c.last AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that people labelled good and not toxic."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1 AND toxic = 0").select("doc_id")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its counts and whether it is kept."""
    out = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), trusted_ids(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of those with an equal text."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d
"""


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its tokens by both tokenizers, how they are linked, and what its links score in the corpus."""
    return align_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes in each order of them, by language."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
f AS (SELECT doc_id, part, CAST(len(w) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INT)
    + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS INT) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
    + 16 * CAST(doc_id > min(doc_id) OVER (PARTITION BY t) AS INT) AS mask FROM d),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM f LEFT JOIN labels USING (doc_id) GROUP BY part, mask),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
p AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, CAST(step AS INT) AS step, substr(filter_order, step, 1) AS letter,
    list_sum(list_transform(string_split(left(filter_order, step - 1), ''), lambda x: CASE WHEN x = '' THEN 0 ELSE 1 << (ascii(x) - 65) END)) AS before,
    1 << (ascii(substr(filter_order, step, 1)) - 65) AS own FROM p, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER ((mask & own) = 0 AND (mask & before) = 0), 0) AS kept,
    coalesce(sum(n) FILTER ((mask & own) > 0 AND (mask & before) = 0), 0) AS removed, coalesce(sum(n) FILTER ((mask & own) > 0 AND (mask & before) > 0), 0) AS redundant,
    coalesce(sum(n) FILTER (mask = own), 0) AS unique_fails, coalesce(sum(good) FILTER ((mask & own) > 0 AND (mask & before) = 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER ((mask & own) > 0 AND (mask & before) = 0), 0) AS toxic_lost FROM c, s GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_source_mixing": op3_source_mixing,
    "op4_html_extraction": op4_html_extraction,
    "op5_secret_scan": op5_secret_scan,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_warc": op7_warc,
    "op8_line_dedup": op8_line_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_chat_format": op10_chat_format,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_token_alignment": op12_token_alignment,
    "op13_filter_audit": op13_filter_audit,
}
ORACLES: dict[str, str] = {
    "op2_ngram_jaccard_join": OP2_SQL,
    "op3_source_mixing": _op3_sql(),
    "op5_secret_scan": _op5_sql(),
    "op7_warc": OP7_SQL,
    "op8_line_dedup": OP8_SQL,
    "op10_chat_format": _op10_sql(),
    "op11_exact_dedup": OP11_SQL,
    "op13_filter_audit": OP13_SQL,
}
