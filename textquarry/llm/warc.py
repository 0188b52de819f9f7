"""WARC archives in which equal payloads are stored once.

Records go through three steps. ``resolved`` shuffles headers only, by payload digest: each digest's first response becomes
the original, and records of the same digest are joined to it. ``write`` puts out archives with fresh headers, where the
original is a response and the others are revisit records without payload. ``read`` gives records back from archives of
any writer, and ``restored`` joins the payloads of originals to the records that revisit them.

Archives are written by Spark's text writer with the record's end as line separator and read by its reader with the
record's start as one, so tasks commit whole files, plain archives are split, and any file system that Spark knows will do.
A payload that holds a record's start is found by its Content-Length and put together again, file by file.

Defined cases: a null payload equals the empty one; payloads of fewer than ``least`` bytes stay responses; of the records
of one digest the smallest id is the response, null ids last, one row of several with that id; a null id or url writes no
such header and comes back null; line breaks in a url are percent-encoded; of revisits without an original at hand the
digest and the id stand, size and payload are null; ids are integers; empty tables write and read empty archives; further
columns take no part.
"""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, written

# Fixed values of the format.
VERSION = "WARC/1.1"
START, END = "\r\n\r\nWARC/1.", "\r\n\r\n"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Smaller payloads are not worth a revisit record.
LEAST_BYTES = 100


def from_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(uid, id, url, payload, digest, size): a record for each row, numbered once, in a written table."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(bytearray()))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    return written(
        rows.select(F.monotonically_increasing_id().alias("uid"), "*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    )


def resolved(records: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """``records`` with ``original``, a struct (id, uid, url), null unless an equal payload is stored by another record.

    A record holds its payload where ``size`` is not null; revisits read from archives have none.
    """
    holds = F.col("size").isNotNull()
    first = F.struct(F.col("id").isNull().alias("nameless"), "id", "uid", "url", "size")
    headers = records.filter(F.col("digest").isNotNull() & (~holds | (F.col("size") >= least))).select("digest", "size", "id", "uid", "url")
    groups = headers.groupBy("digest").agg(F.min(F.when(holds, first)).alias("original"), F.count(F.lit(1)).alias("n"))
    # Written, so that records of a very common digest meet it through plain shuffles, which can be split.
    originals = written(groups.filter("n > 1 AND original IS NOT NULL").select("digest", "original"))
    return records.join(originals, "digest", "left").withColumn("original", F.when(F.col("original.uid") != F.col("uid"), F.col("original")))


def _header(name: str, value: Column) -> Column:
    """One header line; null, and so left out, where the value is null."""
    return F.concat(F.lit(f"{name}: "), value)


def _record_id(seed: str, uid: Column) -> Column:
    h = F.md5(F.concat(F.lit(f"{seed}:"), uid.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))


def write(records: DataFrame, path: str, date: str | None = None, compression: str = "gzip", seed: str | None = None) -> None:
    """Writes ``resolved`` records as archives under ``path``, one file a task, ids and dates fresh.

    ``seed`` fixes the record ids. Files carry the endings that Spark gives to text (``.txt.gz``); each is one gzip member.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    seed = seed or uuid.uuid4().hex
    again = F.col("original").isNotNull() | F.col("payload").isNull()
    safe = lambda url: F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    size = F.coalesce("size", F.col("original.size"))
    http = F.concat_ws("\r\n", F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), _header("Content-Length", size.cast("string")))
    block = F.concat(http, F.lit(END), F.when(again, F.lit("")).otherwise(F.col("payload").cast("string")))
    only = lambda value: F.when(again, value)
    # What a revisit without its original at hand refers to stays as it was read.
    stated = F.col("refers_to") if "refers_to" in records.columns else F.lit(None).cast("string")
    head = F.concat_ws(
        "\r\n",
        F.lit(VERSION),
        _header("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", _record_id(seed, F.col("uid"))),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", safe(F.col("url"))),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        only(_header("WARC-Profile", F.lit(SAME_PAYLOAD))),
        only(_header("WARC-Refers-To", F.coalesce(_record_id(seed, F.col("original.uid")), stated))),
        only(_header("WARC-Refers-To-Target-URI", safe(F.col("original.url")))),
        only(F.when(F.col("original").isNotNull(), _header("WARC-Refers-To-Date", F.lit(date)))),
        _header("X-Page-Id", F.col("id").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string")),
    )
    rows = records.withColumn("block", block).select(F.concat(head, F.lit(END), F.col("block")).alias("value"))
    rows.write.option("lineSep", END).option("compression", compression).text(path)


def _field(head: str, name: str) -> Column:
    """A header's value, null where the header is missing; names in any case."""
    return F.nullif(F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*$", 1), F.lit(""))


def _cut(fragments: DataFrame) -> DataFrame:
    """head, block and length of each fragment ``value``; a whole record's block has at least ``length`` bytes."""
    head = F.substring_index("value", END, 1)
    block = F.expr("substring(CAST(value AS binary), octet_length(head) + 5)")
    return fragments.withColumn("head", head).withColumn("block", block).withColumn("length", _field("head", "Content-Length").cast("long"))


def _parsed(cut: DataFrame) -> DataFrame:
    """Records of whole fragments."""
    block = F.expr("substring(block, 1, CAST(length AS int))")
    kind = F.lower(_field("head", "WARC-Type"))
    rows = cut.withColumn("block", block).withColumn("http", F.lower(_field("head", "Content-Type")).startswith("application/http"))
    rows = rows.withColumn("http_head", F.when(F.col("http"), F.substring_index(F.col("block").cast("string"), END, 1)))
    payload = F.when(F.col("http"), F.expr("substring(block, octet_length(http_head) + 5)")).otherwise(F.col("block"))
    rows = rows.withColumn("record_type", kind).withColumn("payload", F.when(kind.isin("response", "resource"), payload))
    stated = _field("head", "WARC-Payload-Digest")
    return rows.select(
        "uid",
        _field("head", "X-Page-Id").cast("long").alias("id"),
        _field("head", "WARC-Target-URI").alias("url"),
        "record_type",
        _field("head", "WARC-Record-ID").alias("record_id"),
        _field("head", "WARC-Refers-To").alias("refers_to"),
        # Of what is stored the digest is computed; other algorithms' digests of revisits stay as they are stated.
        F.coalesce(F.sha2("payload", 256), F.regexp_replace(stated, "(?i)^sha256:", "")).alias("digest"),
        F.octet_length("payload").cast("long").alias("size"),
        "payload",
    )


def _joined(fragments: DataFrame) -> DataFrame:
    """The fragments of broken files, put together where a payload holds a record's start.

    Which fragment starts a record is decided by one pass over a file's lengths, in file order; texts stay where they are.
    """
    lengths = fragments.select("uid", "file", "at", F.octet_length("value").alias("n"), F.octet_length("block").alias("held"), "length")
    gap = len(START)

    def starts(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["at", "uid"], kind="stable")
        first, missing, out = -1, 0, []
        for uid, n, held, length in zip(rows["uid"], rows["n"], rows["held"], rows["length"], strict=True):
            if missing > 0:
                missing -= gap + n
            else:
                first, missing = uid, 0 if pd.isna(length) else int(length) - held
            out.append(first)
        return pd.DataFrame({"uid": rows["uid"], "first": out})

    owners = lengths.groupBy("file").applyInPandas(starts, "uid long, first long")
    whole = fragments.select("uid", "at", "value").join(owners, "uid").groupBy("first").agg(F.array_sort(F.collect_list(F.struct("at", "uid", "value"))).alias("parts"))
    return whole.select(F.col("first").alias("uid"), F.array_join(F.col("parts.value"), START).alias("value"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(uid, id, url, record_type, record_id, refers_to, digest, size, payload) of each record of the archives under ``path``.

    Only responses and resources have a size and a payload; ``digest`` is bare and lower-case where it is of SHA-256.
    """
    lines = spark.read.option("lineSep", START).text(path)
    fragments = lines.select(
        F.monotonically_increasing_id().alias("uid"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value"
    )
    cut = _cut(fragments)
    broken = F.coalesce(F.octet_length("block") < F.col("length"), F.lit(True))
    files = written(cut.filter(broken).select("file").distinct())
    if files.isEmpty():
        return _parsed(cut)
    odd = written(fragments.join(files, "file", "left_semi"))
    mended = _cut(_joined(_cut(odd))).filter("length IS NOT NULL")
    return _parsed(cut.join(files, "file", "left_anti").drop("file", "at")).unionByName(_parsed(mended))


def restored(records: DataFrame) -> DataFrame:
    """``records`` with the payload and size of every original also in the records that revisit it."""
    records = resolved(records, 0)
    stored = records.filter("payload IS NOT NULL AND original IS NULL").select("digest", F.col("payload").alias("_payload"))
    wanted = records.join(stored.dropDuplicates(["digest"]), "digest", "left")
    payload = F.coalesce("payload", "_payload")
    return wanted.withColumn("payload", payload).withColumn("size", F.octet_length("payload").cast("long")).drop("_payload", "original")


def archived(pages: DataFrame, path: str | None = None, least: int = LEAST_BYTES, **columns: str) -> DataFrame:
    """Writes the pages' archives and reads them back: id, size, digest, record_type, refers_to (the original's id)."""
    spark = pages.sparkSession
    path = path or scratch(spark)
    write(resolved(from_pages(pages, **columns), least), path)
    back = written(read(spark, path).select("uid", "id", "url", "record_type", "digest", "size"))
    original = F.when(F.col("record_type") == "revisit", F.col("original"))
    return resolved(back, least).select(
        "id", F.coalesce("size", original["size"]).alias("size"), "digest", "record_type", original["id"].alias("refers_to")
    )
