"""WARC archives: writing pages as records, and reading them back with segments put together again.

A record whose block is longer than a segment goes into the archive as a first record and continuations that name its
identifier, their number and, in the last one, the whole length. Reading groups them by that identifier, orders them by
number, holds their length against the one told, and takes the chunked transfer framing off.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import sized_broadcast, stored
from lodestack.sources.shared import own_dir

#: Groups of equal payloads that are broadcast at most (about 100 bytes each); more are joined by a shuffle.
GROUPS_SENT = 100_000
#: A gzip member without content. Each record is a member of its own; the text writer puts this one after each.
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Bytes of blocks that a reading task hands on at once.
AT_ONCE = 8 << 20
DATE = "1970-01-01T00:00:00Z"
RECORD = "record_id string, kind string, page_id long, refers string, refers_page long, digest string, origin string, number int, total long, block binary, size long, sha1 string"


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id} {digest}')}>"


def _member(fields: dict[str, object], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    raw = b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    return gzip.compress(raw, 6, mtime=0)


def chunked(payload: bytes, size: int) -> bytes:
    """``payload`` in chunked transfer framing, ``size`` bytes a chunk."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes | None:
    """What chunked framing holds; None if the framing is broken. Chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        told = body[at:end].split(b";")[0].rstrip(b" \t")
        if not told or told.strip(b"0123456789ABCDEFabcdef"):
            return None
        size, at = int(told, 16), end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            return None
        out.append(body[at : at + size])
        at += size + 2


def _records(page_id, url, html, digest, first, segment: int, chunk: int) -> Iterator[bytes]:
    told = base64.b32encode(bytes.fromhex(digest)).decode()
    own = _record_id(page_id, digest)
    uri = None if url is None else "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
    fields = {"WARC-Record-ID": own, "WARC-Date": DATE, "WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha1:{told}", "X-Page-ID": page_id}
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    kind = {"Content-Type": "application/http; msgtype=response"}
    if first is not None and first != page_id:
        yield _member({"WARC-Type": "revisit", **fields, **kind, "WARC-Refers-To": _record_id(first, digest), "X-Refers-To-Page-ID": first}, http)
        return
    block = http + chunked((html or "").encode(), chunk)
    if len(block) <= segment:
        yield _member({"WARC-Type": "response", **fields, **kind}, block)
        return
    for number, at in enumerate(range(0, len(block), segment), 1):
        last = {"WARC-Segment-Total-Length": len(block)} if at + segment >= len(block) else {}
        if number == 1:
            part = {"WARC-Type": "response", **fields, **kind}
        else:
            part = {"WARC-Type": "continuation", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{own} {number}')}>", "WARC-Date": DATE, "WARC-Segment-Origin-ID": own}
        yield _member(part | {"WARC-Segment-Number": number} | last, block[at : at + segment])


def write_archives(pages: DataFrame, path: str, least: int = 0, segment: int = 16 << 10, chunk: int = 4 << 10, records_per_file: int = 4000) -> None:
    """Writes a record for each row of ``pages`` (page_id, url, html; other columns are left out) into archives in ``path``.

    A null html is an empty payload, a null url or page_id leaves out its field. Of rows with equal payloads of at least
    ``least`` bytes those with the smallest page_id (nulls count last) are responses, the others revisits of it;
    smaller payloads are all responses. An archive holds ``records_per_file`` records of at most ``segment`` bytes.
    """
    keyed = pages.select("page_id", "url", "html", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")).alias("digest"))
    long_enough = pages.where(F.coalesce(F.octet_length("html"), F.lit(0)) >= least)
    digests = long_enough.select("page_id", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")).alias("digest"))
    equal = stored(digests.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "equal-payloads")
    marked = keyed.join(sized_broadcast(equal, equal.count(), GROUPS_SENT), "digest", "left").select("page_id", "url", "html", "digest", "first")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for member in _records(*row, segment, chunk):
                    out.append(member)
                    size += len(member)
                if size > AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    lines = marked.mapInArrow(members, "value binary").select(F.col("value").cast("string"))
    lines.write.options(encoding="ISO-8859-1", lineSep=EMPTY_MEMBER.decode("latin-1"), maxRecordsPerFile=records_per_file).text(path)


def _parsed(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and block of each record. Where an archive breaks off, within its compression or by a record without length
    or name, one of the type ``broken`` stands for what can't be read."""
    try:
        with gzip.GzipFile(fileobj=io.BytesIO(archive)) as f:
            while line := f.readline():
                if not line.startswith(b"WARC/"):
                    continue
                fields = {}
                while (line := f.readline()) not in (b"\r\n", b"\n", b""):
                    k, _, v = line.decode("utf-8", "replace").partition(":")
                    fields[k.strip().lower()] = v.strip()
                size = fields.get("content-length", "")
                if not re.fullmatch("[0-9]+", size) or not {"warc-type", "warc-record-id"} <= fields.keys() or len(block := f.read(int(size))) < int(size):
                    raise EOFError
                yield fields, block
    except (EOFError, OSError, zlib.error):
        yield {"warc-type": "broken"}, b""


def read_records(spark: SparkSession, path: str, measured: bool = False) -> DataFrame:
    """A row for each record of the archives in ``path`` (see ``RECORD``), and one of the kind ``broken``, without record_id, for each that breaks off.

    With ``measured`` a record that is no segment comes with ``size`` and ``sha1`` (base32) of its payload, null if it can't be
    restored, instead of its block: blocks of whole records needn't leave the task that reads them.
    """
    number = lambda v: None if v is None else int(v)
    names = [c.split(" ")[0] for c in RECORD.split(", ")]
    types = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}.get(c.split(" ")[1], pa.string()) for c in RECORD.split(", ")]
    emitted = lambda rows: pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)], names)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for archive in batch.column(0):
                for f, block in _parsed(archive.as_py()):
                    part = number(f.get("warc-segment-number"))
                    origin = f.get("warc-segment-origin-id") or (f["warc-record-id"] if part else None)
                    digest = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    size = sha1 = None
                    if measured and part is None:
                        size, sha1 = _measured(_payload([block], None))
                        block = None
                    rows.append((f.get("warc-record-id"), f["warc-type"], number(f.get("x-page-id")), f.get("warc-refers-to"), number(f.get("x-refers-to-page-id")), digest, origin, part, number(f.get("warc-segment-total-length")), block, size, sha1))
                    held += len(block or b"") + 200
                    if held > AT_ONCE:
                        yield emitted(rows)
                        rows, held = [], 0
        yield emitted(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, RECORD)


def joined_segments(records: DataFrame) -> DataFrame:
    """The records whose segments are among ``records``, with all ``blocks`` in order and the ``total`` length told.

    Segments are grouped by their origin. Those that the same origin holds more than once, from repeated rows, are counted
    first and stand for as many records. A record lacking a segment has the others' blocks; its total can't be met then.
    """
    same = ["origin", "number", F.xxhash64("block").alias("content")]
    parts = records.where("number is not null").groupBy(*same).agg(F.first("block").alias("block"), F.max("total").alias("total"), *(F.first(c, True).alias(c) for c in ("page_id", "digest")), F.count(F.lit(1)).alias("n"))
    # A group is one record: its size is that of a page.
    joined = parts.groupBy("origin").agg(
        F.first("page_id", True).alias("page_id"), F.first("digest", True).alias("digest"), F.max("total").alias("total"),
        F.sort_array(F.collect_list(F.struct("number", "block"))).alias("sorted"), F.max(F.when(F.col("number") == 1, F.col("n"))).alias("n"),
    )
    gapless = F.forall(F.sequence(F.lit(1), F.size("sorted")), lambda i: F.col("sorted")[i - 1]["number"] == i)
    # Without the first segment it is unknown whose record it is; a gap shows as a total that can't be met.
    return joined.where("n is not null").select(
        F.col("origin").alias("record_id"), F.lit("response").alias("kind"), "page_id", F.lit(None).cast("string").alias("refers"), F.lit(None).cast("long").alias("refers_page"), "digest",
        F.col("sorted.block").alias("blocks"), F.when(gapless, F.coalesce("total", F.lit(-1))).otherwise(-1).alias("total"), "n",
    )


def _payload(blocks: list[bytes], total: int | None) -> bytes | None:
    """The payload of a record's blocks; None if the length or the framing isn't right."""
    block = b"".join(blocks)
    if total is not None and total != len(block):
        return None
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if b"\r\ntransfer-encoding: chunked" in head.lower() else body


def _measured(payload: bytes | None) -> tuple[int | None, str | None]:
    return (None, None) if payload is None else (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """Each response's page_id, record_id and ``payload`` (binary; null if it can't be restored)."""

    @F.arrow_udf("binary")
    def payload(blocks: pa.Array, totals: pa.Array) -> pa.Array:
        return pa.array([_payload(b, t) for b, t in zip(blocks.to_pylist(), totals.to_pylist(), strict=True)], pa.binary())

    records = read_records(spark, path)
    whole = records.where("number is null and kind = 'response'").select("page_id", "record_id", F.array("block").alias("blocks"), F.lit(None).cast("long").alias("total"))
    again = joined_segments(records).select("page_id", "record_id", "blocks", "total", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return whole.unionByName(again.drop("col")).select("page_id", "record_id", payload("blocks", "total").alias("payload"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives in ``path``: page_id, payload_bytes, payload_digest, record_type, refers_to, intact.

    Length and digest are those of the restored payload; a revisit has those of the response that it names. They are
    null, and ``intact`` is false, where the payload can't be restored; ``intact`` also tells that the digest is the one
    that the record names. Of a broken archive the records before the break are given (see ``read_records``).
    """

    @F.arrow_udf("n long, digest string")
    def measured(blocks: pa.Array, totals: pa.Array) -> pa.Array:
        found = [_measured(_payload(b, t)) for b, t in zip(blocks.to_pylist(), totals.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([d for _, d in found], pa.string())], ["n", "digest"])

    # Archives are read once: whole records leave that task measured, and only segments take their blocks along.
    records = stored(read_records(spark, path, measured=True), "warc-records")
    common = ["record_id", "kind", "page_id", "refers", "refers_page", "digest", "got"]
    whole = records.where("number is null").withColumn("got", F.struct(F.col("size").alias("n"), F.col("sha1").alias("digest"))).select(*common)
    # Stored, so that the blocks are joined once though both kinds of record need them.
    again = stored(joined_segments(records).withColumn("got", measured("blocks", "total")).select(*common, "n"), "warc-joined")
    every = whole.unionByName(again.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).select(*common))
    responses = every.where("kind = 'response'")
    # Stored: then both sides of the join are shuffled anew, and Spark can split a response with very many revisits.
    known = stored(responses.groupBy("record_id").agg(F.first("got").alias("got")), "warc-responses")
    revisits = every.where("kind = 'revisit'").drop("got").join(known.withColumnRenamed("record_id", "refers"), "refers", "left")
    both = responses.unionByName(revisits)
    intact = F.coalesce(F.col("got.digest") == F.col("digest"), F.lit(False)).alias("intact")
    return both.select("page_id", F.col("got.n").alias("payload_bytes"), F.col("got.digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("refers_page").alias("refers_to"), intact)


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes ``pages`` into archives in the shared folder and gives what ``read_index`` finds there."""
    path = f"{own_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, least)
    return read_index(pages.sparkSession, path)
