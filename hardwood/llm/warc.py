"""WARC files: a deduplicating writer and a splittable reader of gzip-compressed archives."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hardwood.llm.common import in_small_batches, join_hot, new_folder, table, written

# Fixed values of the formats.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
ID_PREFIX = "urn:hardwood:page:"
BEGIN = b"WARC/1."
#: Bytes read at once; this many groups of equal payloads at most are broadcast.
CHUNK, BROADCAST_GROUPS = 1 << 18, 200_000


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a URI as Hadoop writes it, and the path there."""
    return pafs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member: a response with its payload, or a revisit without."""
    digest = payload_digest(payload)
    name = f"<{ID_PREFIX}{'' if page_id is None else page_id}>"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", _clean(url)))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{ID_PREFIX}{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)]
    block = head if refers_to is not None else head + payload
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in fields)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) into WARC files below ``folder``.

    Of rows with equal payloads of at least ``min_bytes`` bytes the one with the smallest page_id
    is a response and the others are revisits that refer to it; rows with smaller payloads are all
    responses. A null html has an empty payload; a null url is left out; a null page_id never is
    the smallest, and equal payloads that all lack one are all responses. Rows that repeat the
    smallest page_id are responses too. Extra columns are ignored; an empty table gives no files.

    ``folder`` must be one that all executors see. Each task writes its own file under a name of
    its attempt, so a task that runs again does no harm; the returned rows (path, size, records)
    name the files of the tasks that succeeded.
    """
    base = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    base = base.withColumn("sha", F.unhex(F.sha1("payload")))
    # Only digests are grouped. Payloads are shuffled where there are too many groups to broadcast, and
    # then those of the most frequent are not.
    groups = base.where(F.octet_length("payload") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    groups = written(groups, "warc-groups")
    few = groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    rows = base.join(F.broadcast(groups), "sha", "left") if few else join_hot(base, groups, "sha", "left")
    rows = rows.select("page_id", "url", "payload", F.when((F.octet_length("payload") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        files, path = _store(f"{folder}/part-{context.partitionId():05d}-{context.taskAttemptId()}.warc.gz")
        out, size, n = None, 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for r in batch.slice(at, 64).to_pylist():
                    if out is None:
                        files.create_dir(path.rpartition("/")[0], recursive=True)
                        out = files.open_output_stream(path, compression=None)
                    record = warc_record(r["page_id"], r["url"], r["payload"], r["refers_to"])
                    out.write(record)
                    size, n = size + len(record), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{path.rpartition('/')[2]}"]), pa.array([size]), pa.array([n])], ["path", "size", "records"])

    return written(in_small_batches(rows).mapInArrow(run, "path string, size long, records long"), "warc-files")


class Stream:
    """A file from some byte on, read as far as asked."""

    def __init__(self, file, at: int):
        self.file, self.start, self.data = file, at, bytearray()
        file.seek(at)

    def fill(self, upto: int) -> bool:
        """Whether byte ``upto`` is there."""
        while self.start + len(self.data) <= upto:
            more = self.file.read(CHUNK)
            if not more:
                return False
            self.data += more
        return True

    def drop(self, upto: int) -> None:
        del self.data[: max(0, upto - self.start)]
        self.start = max(self.start, upto)


class Damaged(ValueError):
    """A record that begins as one but can't be read to its end, or bytes between records."""


def decode_member(stream: Stream, at: int) -> tuple[bytes, int] | None:
    """Decoded bytes and end of the gzip member at byte ``at``, None if it doesn't hold a WARC record.
    A member that begins like one must decode to its end, else ``Damaged`` is raised."""
    unpacker, out, pos, begun = zlib.decompressobj(31), bytearray(), at, False
    try:
        while not unpacker.eof:
            if not stream.fill(pos):
                break
            chunk = bytes(stream.data[pos - stream.start : pos - stream.start + CHUNK])
            out += unpacker.decompress(chunk)
            pos += len(chunk)
            if not begun and len(out) >= len(BEGIN):
                begun = out.startswith(BEGIN)
                if not begun:
                    return None
    except zlib.error as e:
        if begun or out.startswith(BEGIN):
            raise Damaged(f"record at byte {at}: {e}") from e
        return None
    if not begun:
        return None
    if not unpacker.eof:
        raise Damaged(f"record at byte {at} ends before its last byte")
    return bytes(out), pos - len(unpacker.unused_data)


def begins_record(stream: Stream, at: int) -> bool:
    """Whether a WARC record begins at byte ``at``, or the archive ends there."""
    if not stream.fill(at):
        return True
    stream.fill(at + CHUNK)
    try:
        return zlib.decompressobj(31).decompress(bytes(stream.data[at - stream.start : at - stream.start + CHUNK]), len(BEGIN)) == BEGIN
    except zlib.error:
        return False


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes] | None:
    """Header fields (names lower-cased) and block, or None if there is no end of the header or the length doesn't fit."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        fields[k.strip().lower()] = v.strip()
    size = fields.get("content-length", "")
    if not size.isdigit() or len(rest) != int(size) + 4 or not rest.endswith(b"\r\n\r\n"):
        return None
    return fields, rest[: int(size)]


def scan_range(file, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records that begin at bytes ``start`` to ``end - 1`` of an archive."""
    stream, at = Stream(file, start), start
    while at < end:
        stream.drop(at)
        hit = stream.data.find(MAGIC, at - stream.start)
        if hit < 0:
            # The magic may lie across the end of what has been read.
            at = max(at, stream.start + len(stream.data) - len(MAGIC) + 1)
            if not stream.fill(stream.start + len(stream.data)):
                return
            continue
        at = stream.start + hit
        if at >= end:
            return
        member = decode_member(stream, at)
        if member is None:
            at += 1
            continue
        record = parse_record(member[0])
        if record is None:
            raise Damaged(f"record at byte {at} has not the length that it states")
        yield record
        # Records follow each other without a gap, so that none is passed over for being damaged.
        if not begins_record(stream, member[1]):
            raise Damaged(f"no record at byte {member[1]}, where one ends")
        at = member[1]


def _page(name: str | None) -> int | None:
    value = (name or "").strip("<>").removeprefix(ID_PREFIX)
    return int(value) if value.lstrip("-").isdigit() else None


def read_warc(files: DataFrame, split_bytes: int = 4 << 20, payload: bool = True) -> DataFrame:
    """Records of the archives in ``files`` (path, size), each read by tasks of ``split_bytes``.

    A task looks for gzip magic in its byte range, takes a candidate for a record only if it
    decodes to a WARC header of any length, and owns the records that begin in its range; the last
    may end beyond it. Returns page_id, url, record_type, refers_to,
    payload_bytes, payload_digest and, if asked, payload. A response's digest is computed from what
    was read and must equal the stated one. A revisit's size is the one its HTTP header states.
    A record that is damaged, or has another length or digest than it states, fails the job, and so do
    bytes between two records. Empty or no files give no rows.
    """
    starts = files.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = starts.select("path", "start", F.least(F.col("start") + split_bytes, "size").alias("end"))
    ranges = ranges.repartition(max(8, ranges.sparkSession.sparkContext.defaultParallelism * 4))
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"] + ["payload"] * payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names)

        rows, held = [], 0
        for batch in batches:
            for part in batch.to_pylist():
                store, path = _store(part["path"])
                with store.open_input_file(path) as file:
                    for fields, block in scan_range(file, part["start"], part["end"]):
                        head, _, body = block.partition(b"\r\n\r\n")
                        stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                        kind = fields.get("warc-type")
                        if kind == "response":
                            size, digest = len(body), payload_digest(body)
                            if digest != stated:
                                raise ValueError(f"payload of {fields.get('warc-record-id')} in {path} does not match its digest")
                        else:
                            size = next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
                            digest = stated
                        rows.append((_page(fields.get("warc-record-id")), fields.get("warc-target-uri"), kind, _page(fields.get("warc-refers-to")), size, digest, body))
                        held += len(body)
                        if len(rows) >= 2000 or held > 16 << 20:
                            yield out(rows)
                            rows, held = [], 0
        if rows:
            yield out(rows)

    ddl = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * payload
    return ranges.mapInArrow(run, ddl)


def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_warc(table(spark, sf_dir, "pages"), new_folder(spark, "warc"))
    return read_warc(files, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
