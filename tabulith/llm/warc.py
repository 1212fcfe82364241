"""WARC records in a content-addressed archive.

The archive is two Parquet datasets. ``payloads`` holds each distinct payload once, by its
SHA-256; ``headers`` holds the exact header block of every record with the SHA-256 of its
payload. A record is its header block and its payload, put together by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.llm.common import HOT_KEYS, Scratch, join_dealt, join_on_hot_key

#: The alphabet of base32 and the line end of header blocks: fixed values of the formats.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hexes: Column) -> Column:
    """Upper-case base32 of 20 bytes given as hex: 40 bits, or eight letters, at a time."""
    out = []
    for i in range(4):
        bits = F.conv(F.substring(hexes, 10 * i + 1, 10), 16, 10).cast("long")
        out += [F.substring(F.lit(BASE32), F.shiftright(bits, 5 * j).bitwiseAND(31).cast("int") + 1, F.lit(1)) for j in range(7, -1, -1)]
    return F.concat(*out)


def record_uri(page_id: Column) -> Column:
    """A stable urn:uuid made of a digest of the page's id."""
    h = F.md5(F.concat(F.lit("record:"), F.coalesce(page_id.cast("string"), F.lit(""))))
    parts = (F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _header_block(kind: Column, date: str) -> Column:
    """The header block of a record of page_id, url, bytes, sha1 and first_id, with the blank line that ends it."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    refers = F.concat(line("WARC-Refers-To", record_uri(F.col("first_id"))), line("WARC-Profile", F.lit(REVISIT_PROFILE)),
                      line("X-Refers-To-Page", F.coalesce(F.col("first_id").cast("string"), F.lit(""))))
    return F.concat(
        F.lit("WARC/1.1" + END), line("WARC-Type", kind), line("WARC-Record-ID", record_uri(F.col("page_id"))),
        line("WARC-Date", F.lit(date)), line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))), line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.col("bytes").cast("string")), F.when(kind == "revisit", refers).otherwise(""), F.lit(END))


def write_archive(pages: DataFrame, path: str, *, date: str = "2024-01-01T00:00:00Z", min_revisit_bytes: int = 0) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) below ``path``.

    Of the records with one payload of ``min_revisit_bytes`` or more, those of the least page_id
    are responses and the others revisits that refer to it; records with smaller payloads are
    responses. The payload is the html in UTF-8, null being empty; each is stored once. Null
    page_ids come after all others. Rows repeated whole are records of their own, of one type.
    An empty table makes an empty archive; other columns are not read.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.octet_length(html).cast("long").alias("bytes"),
                        F.sha2(html, 256).alias("sha256"), F.sha1(html).alias("sha1"))
    rows = Scratch(pages.sparkSession, "warc").table(rows, "records")  # digests only
    order = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("id"))
    firsts = rows.groupBy("sha256").agg(F.count("*").alias("n"), F.min(order)["id"].alias("first_id"))
    judged = join_on_hot_key(rows, firsts, "sha256", "n", rows.count())
    response = (F.col("bytes") < min_revisit_bytes) | F.col("first_id").eqNullSafe(F.col("page_id"))
    kind = F.when(response, "response").otherwise("revisit")
    judged.select("page_id", _header_block(kind, date).alias("header"), "sha256").write.parquet(f"{path}/headers")
    bodies = pages.select(F.sha2(html, 256).alias("sha256"), html.alias("payload"))
    bodies.dropDuplicates(["sha256"]).write.option("compression", "zstd").parquet(f"{path}/payloads")


def _header(name: str) -> Column:
    return F.nullif(F.regexp_extract("header", rf"(?m)^{name}: ([^\r\n]*)", 1), F.lit(""))


def payload_of(record: Column, header_bytes: Column) -> Column:
    """The payload bytes of a whole record: what follows its header block, without the two line ends of the record."""
    return F.substring(record, header_bytes + 1, F.octet_length(record) - header_bytes - len(END + END))


def read_records(spark: SparkSession, path: str, *, payload: bool = True) -> DataFrame:
    """The records of an archive, from its header blocks, joined to what their payloads are.

    Returns page_id, url, record_type, payload_digest, content_length, refers_to, payload_bytes,
    verified (the stored payload has the digests and the length that the header block and the
    archive give; false where the archive has lost it), header_bytes and, unless ``payload`` is False, record: the bytes of the whole record.
    Payloads are digested where they are stored, once each, before the join. They are never broadcast: those
    that over one record in HOT_KEYS has are joined in parts, each with a copy of the payload.
    """
    heads = spark.read.parquet(f"{path}/headers")
    stored = spark.read.parquet(f"{path}/payloads")
    checked = stored.select("sha256", F.octet_length("payload").cast("long").alias("payload_bytes"), base32(F.sha1("payload")).alias("stored_digest"),
                            (F.sha2("payload", 256) == F.col("sha256")).alias("intact"), *(["payload"] if payload else []))
    parts = F.least("n", F.ceil(F.col("n") * HOT_KEYS / F.lit(max(heads.count(), 1)))).cast("int")
    hot = heads.groupBy("sha256").agg(F.count("*").alias("n")).select("sha256", parts.alias("parts")).filter("parts > 1").collect()  # HOT_KEYS at most
    if hot:
        hot = F.broadcast(spark.createDataFrame(hot, "sha256 string, parts int"))
        joined = join_dealt(heads, checked, "sha256", hot, F.monotonically_increasing_id(), "left")
    else:
        joined = heads.join(checked, "sha256", "left")
    digest = F.substring_index(_header("WARC-Payload-Digest"), ":", -1)
    length = _header("Content-Length").cast("long")
    return joined.select(
        "page_id", _header("WARC-Target-URI").alias("url"), _header("WARC-Type").alias("record_type"), digest.alias("payload_digest"),
        length.alias("content_length"), _header("X-Refers-To-Page").cast("long").alias("refers_to"), "payload_bytes",
        F.coalesce(F.col("intact") & (F.col("stored_digest") == digest) & (F.col("payload_bytes") == length), F.lit(False)).alias("verified"),
        F.octet_length("header").alias("header_bytes"),
        *([F.concat(F.col("header").cast("binary"), F.col("payload"), F.lit(END + END).cast("binary")).alias("record")] if payload else []))
