"""WARC archives with revisit records for repeated payloads.

Headers alone (page, URL, date, digest, length) are shuffled by payload digest and pre-aggregated to the response of each digest; a digest that
many pages share is joined in several tasks.  Revisit records are made from headers.  Payloads move once, to meet the headers of the responses, and
in slices by a hash of the header, one after the other: beside the archives, shuffle files hold one slice of the payloads at a time.
Archives are plain WARC/1.1 files written by Spark's text writer, whose line separator is the blank line that ends a record, so they
reach any file system that Spark reaches.  Every record's first header holds a token drawn for the archive; with the version line
before it, it separates records when the archives are read back, which Spark does by ranges of bytes: no archive has to fit into a value or a task.

A record's id comes from its page, URL, date, digest and number among equal ones, so it is its own when rows repeat, and a task that runs again
writes the same bytes.

Defined cases: a null payload is empty; of the rows with the largest page id of a digest one (of the largest URL) is the response, the others revisit it;
a null page id is smaller than any other; white space and control characters in a URL are percent-encoded; equal payloads under ``min_bytes``
are all responses; columns other than those named are not written.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_unique, materialise, scratch_path, shuffles_cleaned, table

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = "WARC/1.1\r\nArchive-Token: "


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: four groups of 40 bits, eight letters each.

    Lambda arguments hold the digest and each group's integer, so that neither is computed again for every letter.
    """
    letter = lambda v, k: F.substring(F.lit(ALPHABET), (F.shiftright(v, 35 - 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))
    group = lambda h, i: F.conv(F.substring(h, F.lit(10 * i + 1), F.lit(10)), 16, 10).cast("long")
    text = lambda h: F.array_join(F.transform(F.array(*[group(h, i) for i in range(4)]), lambda v: F.concat(*[letter(v, k) for k in range(8)])), "")
    return F.transform(F.array(F.sha1(data)), text)[0]


_HEAD = ["page", "url", "date"]


def resolve_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date_col: str | None = None, min_bytes: int = 0) -> DataFrame:
    """One row for each row of ``pages``: page, url, date, nth, payload_digest, payload_bytes, record_type, payload (null in revisits), and
    ``refers_to``, the head of the response (page, url, date), null in responses.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    body = payload.cast("binary")
    date = F.col(date_col).cast("string") if date_col else F.lit(None).cast("string")
    keyed = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), date.alias("date"), payload.alias("payload"), F.octet_length(body).cast("long").alias("payload_bytes"), base32_sha1(body).alias("payload_digest"))
    heads = materialise(keyed.groupBy(*_HEAD, "payload_digest", "payload_bytes").agg(F.count("*").alias("n")), "warc-heads")
    large = heads.where(F.col("payload_bytes") >= min_bytes)
    best = large.groupBy("payload_digest").agg(F.max(F.struct(*_HEAD)).alias("best"), F.count("*").alias("heads"))
    large = join_unique(large, best, "payload_digest", "heads", _HEAD, "inner").withColumn("responses", F.when(F.struct(*_HEAD) == F.col("best"), 1).otherwise(0))
    every = large.unionByName(heads.where(F.col("payload_bytes") < min_bytes).withColumn("best", F.lit(None).cast(best.schema["best"].dataType)).withColumn("responses", F.col("n").cast("int")))
    every = materialise(every, "warc-decided")  # each slice of the archives reads it
    again = every.where(F.col("n") > F.col("responses")).withColumn("nth", F.explode(F.sequence(F.col("responses"), (F.col("n") - 1).cast("int"))))
    again = again.select(*_HEAD, "nth", "payload_digest", "payload_bytes", F.lit("revisit").alias("record_type"), F.lit(None).cast("string").alias("payload"), F.col("best").alias("refers_to"))
    # One struct is the key of the join and of the window, nulls equal: the window finds the payloads where the join left them.
    wanted = every.where("responses > 0").select(F.struct(*_HEAD, "payload_digest").alias("__head"), "responses")
    whole = keyed.select(F.struct(*_HEAD, "payload_digest").alias("__head"), "payload_bytes", "payload").join(wanted, "__head")
    whole = whole.withColumn("nth", F.row_number().over(Window.partitionBy("__head").orderBy("payload_bytes")) - 1).where("nth < responses")
    whole = whole.select("__head.*", "nth", "payload_bytes", F.lit("response").alias("record_type"), "payload", F.lit(None).cast(best.schema["best"].dataType).alias("refers_to"))
    return whole.unionByName(again)


def record_id(head: list[Column], nth: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("/", *[F.coalesce(c.cast("string"), F.lit("null")) for c in head], nth.cast("string"), digest))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-4"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


def sliced(resolved: DataFrame, at: int, slices: int) -> DataFrame:
    """Rows whose head falls into slice ``at``; the filter reaches ``pages``, so only these rows are digested and shuffled."""
    return resolved.where(F.pmod(F.xxhash64(*_HEAD), F.lit(slices)) == at)


def write_archives(resolved: DataFrame, path: str, date: str | None = None, per_file: int = 20_000, slices: int = 4) -> str:
    """One record per row: a response with its payload, or a revisit that carries the HTTP header only and names its response.  Returns the token.

    ``date``: the capture date of pages without one; by default the time of writing.  ``slices``: parts written one after the other.
    """
    token = uuid.uuid4().hex
    unknown = F.lit(date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"))
    revisit = F.col("record_type") == "revisit"
    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("urn:none")), r"[\x00-\x20\x7F]", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    to = record_id([F.col(f"refers_to.{c}") for c in _HEAD], F.lit(0), F.col("payload_digest"))
    named = F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), to, F.lit("\r\nWARC-Refers-To-Date: "), F.coalesce("refers_to.date", unknown))
    head = F.concat(
        F.lit(f"{VERSION}{token}\r\nWARC-Type: "), F.col("record_type"), F.lit("\r\nWARC-Target-URI: "), url, F.lit("\r\nWARC-Date: "), F.coalesce("date", unknown), F.lit("\r\nWARC-Record-ID: "),
        record_id([F.col(c) for c in _HEAD], F.col("nth"), F.col("payload_digest")), F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"), F.when(revisit, named).otherwise(""),
        F.when(F.col("page").isNull(), "").otherwise(F.concat(F.lit("\r\nX-Page-Id: "), F.col("page").cast("string"))),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))).cast("string"), F.lit("\r\n\r\n"),
    )
    record = F.concat(head, http, F.coalesce("payload", F.lit(""))).alias("value")
    with shuffles_cleaned(resolved.sparkSession):
        for at in range(slices):
            sliced(resolved, at, slices).select(record).write.mode("append").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", per_file).text(path)
    return token


_FIELDS = [("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()), ("payload_digest", pa.string()), ("refers_to_id", pa.string()), ("payload_bytes", pa.int64()), ("intact", pa.bool_()), ("payload", pa.binary())]


def parse(record: bytes) -> dict:
    """A record from the end of its token line to its closing blank line."""
    stop = record.index(b"\r\n\r\n")
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in record[:stop].split(b"\r\n"))}
    start, size = stop + 4, int(head[b"content-length"])
    if record[start + size :] != b"\r\n\r\n":
        raise ValueError(f"a record of {size} bytes does not end where its header says: {record[:stop][:300]!r}")
    cut = record.index(b"\r\n\r\n", start) + 4
    payload, digest = record[cut : start + size], head[b"warc-payload-digest"].removeprefix(b"sha1:").decode()
    response = head[b"warc-type"] == b"response"
    return {
        "record_id": head[b"warc-record-id"].decode(), "record_type": head[b"warc-type"].decode(), "target_uri": head[b"warc-target-uri"].decode(),
        "page_id": int(head[b"x-page-id"]) if b"x-page-id" in head else None, "payload_digest": digest,
        "refers_to_id": head[b"warc-refers-to"].decode() if b"warc-refers-to" in head else None,
        "payload_bytes": len(payload) if response else None,
        "intact": base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest if response else None, "payload": payload,
    }


def archive_token(spark: SparkSession, path: str) -> str | None:
    """The token in the second line of the archives under ``path``; null if they are empty."""
    line = spark.read.text(path).where(F.startswith("value", F.lit(VERSION.split("\r\n")[1]))).first()
    return line and line[0].partition(": ")[2].strip()


def read_archives(spark: SparkSession, path: str, payload: bool = True, token: str | None = None) -> DataFrame:
    """Records of the archives under ``path``; a revisit's payload columns are null until ``resolve`` joins them."""
    fields = [f for f in _FIELDS if payload or f[0] != "payload"]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                rows = [parse(x.as_py()) for x in batch.column(0).slice(i, 1000)]
                yield pa.RecordBatch.from_pylist([{k: r[k] for k, _ in fields} for r in rows], schema)

    kinds = {pa.string(): "string", pa.int64(): "long", pa.bool_(): "boolean", pa.binary(): "binary"}
    separator = f"{VERSION}{token or archive_token(spark, path) or '-'}\r\n"
    records = spark.read.option("lineSep", separator).text(path).select(F.col("value").cast("binary").alias("record")).where(F.octet_length("record") > 0)
    return records.mapInArrow(run, ", ".join(f"{k} {kinds[t]}" for k, t in fields))


def resolve(records: DataFrame) -> DataFrame:
    """Revisit records joined to the responses they name: ``refers_to`` and the full payload's length.  Responses that nothing names stay out of the join."""
    named = records.where("record_type = 'revisit'").groupBy("refers_to_id").agg(F.count("*").alias("__n"))
    first = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("__to"), F.col("payload_bytes").alias("__bytes"))
    out = join_unique(records.where("record_type = 'revisit'"), first.join(named, "refers_to_id"), "refers_to_id", "__n", ["record_id"])
    out = out.withColumn("payload_bytes", F.coalesce("payload_bytes", "__bytes")).withColumn("refers_to", F.col("__to")).drop("__to", "__bytes")
    whole = records.where("record_type <> 'revisit' or record_type is null").withColumn("refers_to", F.lit(None).cast("long"))
    return whole.unionByName(out)


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    token = write_archives(resolve_revisits(table(spark, sf_dir, "pages").select("page_id", "url", "html")), path)
    records = materialise(read_archives(spark, path, payload=False, token=token), "warc-records")
    return resolve(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_LETTERS = " || ".join(f"substr('{ALPHABET}', (1 + ((cast('0x' || substr(h, {1 + 10 * g}, 10) as bigint) >> {35 - 5 * k}) & 31))::int, 1)" for g in range(4) for k in range(8))
OP4_SQL = f"""
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as h from pages),
d as (select page_id, cast(payload_bytes as bigint) as payload_bytes, {_LETTERS} as payload_digest, max(page_id) over (partition by h) as best from p)
select page_id, payload_bytes, payload_digest, case when page_id = best then 'response' else 'revisit' end as record_type,
       case when page_id = best then null else best end as refers_to
from d
"""
