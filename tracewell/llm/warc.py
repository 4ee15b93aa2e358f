"""WARC archives: reading, revisit resolution by payload digest, and writing deduplicated archives."""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import bloom
from tracewell.llm.common import SMALL_IDS, beside, need, new_path, open_fs, table, written

RECORD = "record_id string, warc_type string, target_uri string, warc_date string, payload_digest string, http_headers string, payload binary"
INDEX = "record_id string, warc_type string, status string, target_uri string, warc_date string, payload_digest string, refers_to string, block_length bigint, file string, offset bigint, length bigint"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bits and probes of the filter that tells rows whether they are duplicates: about 1 original in 100,000 is taken for one at first.
BITS_PER_KEY, PROBES = 24, 8
#: Originals that the filter takes for duplicates are sent to all workers; with more than so many, the filter gets more bits.
MOST_MISTAKEN = 200_000
#: Content types by record type.
CONTENT = {"response": "application/http; msgtype=response", "revisit": "application/http; msgtype=response", "request": "application/http; msgtype=request", "warcinfo": "application/warc-fields", "metadata": "application/warc-fields", "": "application/octet-stream"}
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


OWN = ("warc_date", "record_id", "target_uri")


def originals(records: DataFrame) -> DataFrame:
    """(payload_digest, refers_to, refers_uri, refers_date, responses, copies, seen) of each digest.

    Only headers are shuffled, by payload digest, and equal ones are counted before each shuffle. The original of a digest is
    its first response by (date, record_id, target_uri), nulls first; refers_* are its headers, ``responses`` counts the
    digest's responses, ``copies`` those of them that have just the original's headers, and ``seen`` responses and revisits.
    A digest without a response has 0 responses. Null digests have no row.
    """
    response = F.col("warc_type") == "response"
    head = records.where("warc_type IN ('response', 'revisit') AND payload_digest IS NOT NULL")
    # A revisit's own headers don't matter, so all of a digest are one group.
    each = head.select("payload_digest", "warc_type", *[F.when(response, F.col(c)).alias(c) for c in OWN]).groupBy("payload_digest", "warc_type", *OWN).agg(F.count("*").alias("copies"))
    first = F.min(F.when(response, F.struct(*OWN, "copies"))).alias("first")
    found = each.groupBy("payload_digest").agg(first, F.sum(F.when(response, F.col("copies")).otherwise(0)).alias("responses"), F.sum("copies").alias("seen"))
    return found.select("payload_digest", F.col("first.record_id").alias("refers_to"), F.col("first.target_uri").alias("refers_uri"), F.col("first.warc_date").alias("refers_date"), "responses", F.coalesce("first.copies", F.lit(0)).alias("copies"), "seen")


def _urn(record_id: str | None, *headers: str | None) -> str:
    """The id written for a record; one without an id gets it from its headers."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, repr(headers) if record_id is None else record_id)}>"


def _record(record_id, kind, uri, date, digest, refers, refers_to, refers_uri, refers_date, http, payload) -> tuple[bytes, int]:
    """(one record with fresh headers, length of its block). ``refers`` says whether there is an original; its id can be null."""
    http = (http or "").encode()
    block = http if kind == "revisit" else http + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(record_id, kind, date, uri, digest)}", f"WARC-Date: {date or '1970-01-01T00:00:00Z'}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", uri))
    if digest is not None:
        lines.append(f"WARC-Payload-Digest: {digest}")
    lines.append(f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}")
    if kind == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
        if refers:
            lines.append(f"WARC-Refers-To: {_urn(refers_to, 'response', refers_date, refers_uri, digest)}")
            if refers_date is not None:
                lines.append(f"WARC-Refers-To-Date: {refers_date}")
            if refers_uri is not None:
                lines.append("WARC-Refers-To-Target-URI: " + re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", refers_uri))
    if record_id is not None:
        lines.append(f"X-Source-Record-ID: {record_id}")
    lines += [f"Content-Type: {CONTENT.get(kind, CONTENT[''])}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", len(block)


def write_deduplicated(records: DataFrame, path: str, level: int = 6) -> DataFrame:
    """Write ``records`` as gzipped WARC files under ``path``, every payload once; give the index of what was written (INDEX).

    Every row is decided by its own headers, whatever other rows share its record_id. ``status`` is "original" for the first
    response of a digest (see originals()) and for a response with a null digest, "duplicate" for further responses of
    that digest, which become revisits of it, "resolved" for revisits whose digest has an original, "unresolved" for those
    that have none (or a null digest), and "other" for further record types. Null record_ids stay null in the index; such
    records are records of their own, written with an id made of their headers, and a revisit of one has a null refers_to.

    Payloads aren't shuffled. A row with a payload learns that it is a duplicate from a Bloom filter of all duplicates'
    headers, mapped from the shared folder; the few originals that the filter takes for duplicates are found beforehand
    among the headers and sent to all. Revisits are made from headers alone. Only of an original that is repeated, headers
    and all, each task sends on one payload, and one stays, with the smallest http_headers that isn't null. Each file is written under a
    task attempt's own name and moved to its partition's name when whole, so a task that runs again leaves one file. Null
    payloads and headers are empty; a record without a date gets 1970, and a revisit doesn't state its original's date where
    that has none. Payloads and headers of any length are written whole. No records give no files and an empty index.
    """
    need(records, *[c.split()[0] for c in RECORD.split(", ")])
    spark = records.sparkSession
    firsts = written(originals(records), "originals")
    refers = ["refers_to", "refers_uri", "refers_date"]
    columns = ["record_id", "target_uri", "warc_date", "payload_digest", "http_headers"]
    out = [*columns, "warc_type", "payload", "status", *refers]
    null = F.lit(None).cast("binary").alias("payload")
    own = F.col("record_id").eqNullSafe(F.col("refers_to")) & F.col("target_uri").eqNullSafe(F.col("refers_uri")) & F.col("warc_date").eqNullSafe(F.col("refers_date"))

    def mark(names=columns[:4]) -> F.Column:
        """A hash of a response's headers, nulls apart from all texts."""
        return F.xxhash64(*[x for c in names for x in (F.col(c).isNull(), F.col(c))])

    # Headers of all responses that aren't the one original of their digest. Numbers are written, so they stay.
    again = beside(records.where("warc_type = 'response' AND payload_digest IS NOT NULL").select(*columns), firsts.where("responses > 1"), "payload_digest", F.col("seen"))
    again = written(again.where(~own | (F.col("copies") > 1)).select(*columns, *refers, own.alias("own"), mark().alias("h")).withColumn("n", F.monotonically_increasing_id()), "duplicates")
    single = firsts.where("copies = 1").select(*[F.col(c).alias(f"its_{k}") for k, c in zip(columns[:4], ("refers_to", "refers_uri", "refers_date", "payload_digest"))])
    bits, keys = BITS_PER_KEY, again.count()
    while True:
        filter_ = bloom.write(again.select("h"), keys, bits, PROBES)
        mistaken = written(single.where(filter_.probe(mark([f"its_{c}" for c in columns[:4]]))), "mistaken")
        if mistaken.count() <= MOST_MISTAKEN:
            break
        bits += 8

    # Rows with payloads, where they are read.
    whole = records.where("NOT warc_type <=> 'revisit'").select(*columns, F.coalesce("warc_type", F.lit("resource")).alias("warc_type"), F.col("payload").cast("binary").alias("payload"))
    response = (F.col("warc_type") == "response") & F.col("payload_digest").isNotNull()
    whole = whole.withColumn("gone", F.when(response, filter_.probe(mark())).otherwise(False))
    if not mistaken.isEmpty():
        same = F.lit(True)
        for c in columns[:4]:
            same = same & F.col(c).eqNullSafe(F.col(f"its_{c}"))
        whole = whole.join(F.broadcast(mistaken), same & F.col("gone"), "left").withColumn("gone", F.col("gone") & F.col("its_payload_digest").isNull())
    status = F.when(F.col("warc_type") == "response", "original").otherwise("other").alias("status")
    full = whole.where(~F.col("gone")).select(*columns, "warc_type", "payload", status, *[F.lit(None).cast("string").alias(c) for c in refers])

    repeated = firsts.where("copies > 1").count()
    if repeated:
        tie = F.struct(F.col("http_headers").isNull(), "http_headers", "n")
        taken = written(again.where("own").groupBy("payload_digest").agg(F.min(tie).alias("best")).select("payload_digest", F.col("best.n").alias("n"), F.col("best.http_headers").alias("http_headers")), "taken")
        few = taken.count() <= SMALL_IDS
        mine = bloom.write(again.where("own").select("h"), repeated, BITS_PER_KEY, PROBES)
        payloads = whole.where("gone").where(mine.probe(mark())).groupBy(*columns[:4]).agg(F.first("payload", ignorenulls=True).alias("payload"))
        ones = taken.select("n").join(again, "n").drop("http_headers", "n").join(taken.select("payload_digest", "http_headers"), "payload_digest").select(*columns)
        named = ones.select(*[F.col(c).alias(f"its_{c}") for c in columns])
        pair = F.lit(True)
        for c in columns[:4]:
            pair = pair & F.col(c).eqNullSafe(F.col(f"its_{c}"))
        kept = named.join(payloads, pair).select(*[F.col(f"its_{c}").alias(c) for c in columns], F.lit("response").alias("warc_type"), "payload", F.lit("original").alias("status"), *[F.lit(None).cast("string").alias(c) for c in refers])
        full = full.unionByName(kept)
        again = again.join(F.broadcast(taken.select("n")) if few else taken.select("n"), "n", "left_anti")

    duplicate = again.select(*columns, F.lit("revisit").alias("warc_type"), null, F.lit("duplicate").alias("status"), *refers)
    revisits = beside(records.where("warc_type = 'revisit'").select(*columns), firsts, "payload_digest", F.col("seen"), "left")
    found = F.coalesce(F.col("responses"), F.lit(0)) > 0
    revisits = revisits.select(*columns, F.lit("revisit").alias("warc_type"), null, F.when(found, "resolved").otherwise("unresolved").alias("status"), *refers)

    def save(batches):
        fs = out = None
        at, task = 0, TaskContext.get()
        name = f"part-{task.partitionId():06d}.warc.gz"
        draft = f".{name}.{task.taskAttemptId()}"
        try:
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    if out is None:
                        fs, folder = open_fs(path)
                        fs.create_dir(folder, recursive=True)
                        out = fs.open_output_stream(f"{folder}/{draft}")
                    body, block = _record(r["record_id"], r["warc_type"], r["target_uri"], r["warc_date"], r["payload_digest"], r["status"] in ("duplicate", "resolved"), r["refers_to"], r["refers_uri"], r["refers_date"], r["http_headers"], r["payload"])
                    member = gzip.compress(body, level, mtime=0)
                    out.write(member)
                    rows.append((r["record_id"], r["warc_type"], r["status"], r["target_uri"], r["warc_date"], r["payload_digest"], r["refers_to"], block, name, at, len(member)))
                    at += len(member)
                if rows:
                    yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*rows), [pa.string()] * 7 + [pa.int64(), pa.string(), pa.int64(), pa.int64()])], names=[c.split()[0] for c in INDEX.split(", ")])
            if out is not None:
                out.close()
                out = None
                fs.move(f"{folder}/{draft}", f"{folder}/{name}")
        finally:
            if out is not None:
                out.close()
                fs.delete_file(f"{folder}/{draft}")

    return written(full.select(*out).unionByName(duplicate).unionByName(revisits).mapInArrow(save, INDEX), "warc-index")


def read_archive(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records (RECORD, and refers_to, the referred record's id) of WARC files, gzipped by record or plain, one task a file; streamed, never whole in memory."""

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, local = open_fs(path)
                with fs.open_input_stream(local, compression=None) as raw_:
                    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw_)) if path.endswith(".gz") else raw_
                    for r in _records(stream):
                        yield pa.record_batch([pa.array([v], pa.binary() if i == 6 else pa.string()) for i, v in enumerate(r)], names=[*[c.split()[0] for c in RECORD.split(", ")], "refers_to"])

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return files.mapInArrow(read, RECORD + ", refers_to string")


def _records(stream):
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        head = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode("utf-8", "replace").partition(":")
            head[key.strip().lower()] = value.strip()
        block = stream.read(int(head.get("content-length", 0)))
        http, gap, payload = block.partition(b"\r\n\r\n") if "http" in head.get("content-type", "") else (b"", b"", block)
        yield (head.get("x-source-record-id", head.get("warc-record-id")), head.get("warc-type"), head.get("warc-target-uri"), head.get("warc-date"), head.get("warc-payload-digest"), (http + gap).decode("utf-8", "replace"), payload, head.get("warc-refers-to"))


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """Crawls of the page table as WARC records: on the first day each page's response. On the second, every fifth page has
    changed (a new response), the others are logged as unchanged, by a revisit without payload, every seventh with a digest
    that no response here has. On the third, every third page comes again under the record id of the first day.

    Pages with a null html have an empty payload; a null page_id counts as none of these numbers."""
    need(pages, "page_id", "url", "html")
    body = F.coalesce("html", F.lit(""))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    every = lambda n: F.coalesce(F.col("page_id") % n == 0, F.lit(False))
    digest = lambda b: F.concat(F.lit("sha256:"), F.sha2(b, 256))

    def records(n: int, kind: str, day: str, sha: F.Column, b: F.Column | None, rows: DataFrame) -> DataFrame:
        http = F.lit("HTTP/1.1 200 OK\r\n\r\n") if b is None else F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(b).cast("string"), F.lit("\r\n\r\n"))
        payload = (F.lit(None) if b is None else b).cast("binary")
        return rows.select(F.concat(page, F.lit(f"/{n}")).alias("record_id"), F.lit(kind).alias("warc_type"), F.col("url").alias("target_uri"), F.lit(f"{day}T00:00:00Z").alias("warc_date"), sha.alias("payload_digest"), http.alias("http_headers"), payload.alias("payload"))

    changed = F.concat(body, F.lit("\n<!-- changed -->"))
    lost = digest(F.concat(F.lit("lost "), page))
    first = records(1, "response", "2024-01-01", digest(body), body, pages)
    new = records(2, "response", "2024-02-01", digest(changed), changed, pages.where(every(5)))
    same = records(2, "revisit", "2024-02-01", F.when(every(7), lost).otherwise(digest(body)), None, pages.where(~every(5)))
    again = records(1, "response", "2024-03-01", digest(body), body, pages.where(every(3)))
    return first.union(new).union(same).union(again)


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deduplicated archives of the crawls of pages: the index, without the places in files, which depend on partitions."""
    index = write_deduplicated(captures_of_pages(table(spark, sf_dir, "pages")), new_path(spark, "warc"))
    return index.drop("file", "offset", "length")


_HEAD = "strlen('HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || CAST(strlen({0}) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10)) AS head, strlen({0}) AS size"
SQL = f"""
WITH p AS (SELECT page_id, coalesce(CAST(page_id AS VARCHAR), '') AS page, url, coalesce(html, '') AS body, coalesce(html, '') || chr(10) || '<!-- changed -->' AS changed FROM pages),
r AS (SELECT page || '/1' AS record_id, 'response' AS kind, url, '2024-01-01T00:00:00Z' AS warc_date, 'sha256:' || sha256(body) AS digest, {_HEAD.format("body")} FROM p
 UNION ALL SELECT page || '/2', 'response', url, '2024-02-01T00:00:00Z', 'sha256:' || sha256(changed), {_HEAD.format("changed")} FROM p WHERE page_id % 5 = 0
 UNION ALL SELECT page || '/2', 'revisit', url, '2024-02-01T00:00:00Z', 'sha256:' || sha256(CASE WHEN page_id % 7 = 0 THEN 'lost ' || page ELSE body END), 19, 0 FROM p WHERE coalesce(page_id % 5 <> 0, TRUE)
 UNION ALL SELECT page || '/1', 'response', url, '2024-03-01T00:00:00Z', 'sha256:' || sha256(body), {_HEAD.format("body")} FROM p WHERE page_id % 3 = 0),
o AS (SELECT *, row_number() OVER w AS n, first_value(CASE WHEN kind = 'response' THEN record_id END) OVER w AS original FROM r WINDOW w AS (PARTITION BY digest ORDER BY (kind <> 'response'), warc_date, record_id, url NULLS FIRST))
SELECT record_id, CASE WHEN n = 1 THEN kind ELSE 'revisit' END AS warc_type,
  CASE WHEN kind = 'revisit' AND original IS NULL THEN 'unresolved' WHEN kind = 'revisit' THEN 'resolved' WHEN n = 1 THEN 'original' ELSE 'duplicate' END AS status,
  url AS target_uri, warc_date, digest AS payload_digest, CASE WHEN n > 1 OR kind = 'revisit' THEN original END AS refers_to,
  CAST(CASE WHEN n = 1 THEN head + size ELSE head END AS BIGINT) AS block_length FROM o
"""
