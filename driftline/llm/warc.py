"""WARC archives: written and read as streams of chunks.

Each task writes archives of its own, one gzip member a record, in slices of a payload; a file
counts only once its task's row names it, so files of failed attempts are never read.  Reading
gives the chunk table: one row a chunk with the record's identifier, the chunk's number and the
digest of the payload up to it.  A record is never held as a whole, neither compressed nor plain.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import cut, fresh_path

#: Bytes of a chunk.
CHUNK = 1 << 16
#: Payloads of at least so many bytes are stored once; equal ones revisit it.
LEAST = 1000
#: An archive is closed once it holds so many bytes.
ARCHIVE = 1 << 30
#: Profile of a revisit by payload digest, and the field end of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"
#: Fixed value: WARC dates have second resolution; archives made from tables carry this one unless a column gives another.
NO_DATE = "1970-01-01T00:00:00Z"
CHUNKS = "record_id string, chunk_no int, data binary, chunk_bytes long, bytes_so_far long, sha1_so_far string, is_last boolean"


def plan(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST) -> DataFrame:
    """``pages`` with payload_bytes, payload_digest (bare lower-case hex SHA-1), record_type and refers_to.

    Of rows with equal payloads of at least ``least`` bytes the one with the largest key is the
    response and the others revisit it; rows that share the largest key are all responses.  A null
    payload is an empty one.  A group whose keys are all null has responses only.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1(F.col("payload").cast("binary")))
    large = F.col("payload_bytes") >= least
    winners = rows.where(large).groupBy("payload_digest", "payload_bytes").agg(F.max("key").alias("winner"))
    found = rows.join(winners, ["payload_digest", "payload_bytes"], "left")
    again = large & F.col("winner").isNotNull() & ~F.col("key").eqNullSafe(F.col("winner"))
    return found.select(
        "key", "url", "payload", "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("winner")).alias("refers_to"),
    )


def record_id(key: int | None) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {key}')}"


def header(row: dict) -> bytes:
    """The header of a record.  A revisit has no body; a response's body is the payload."""
    digest = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    uri = "".join(c for c in row["url"] or "" if c.isprintable())
    fields = {
        "WARC-Type": row["record_type"], "WARC-Record-ID": f"<{record_id(row['key'])}>", "WARC-Date": NO_DATE, "WARC-Target-URI": uri,
        "WARC-Payload-Digest": f"sha1:{digest}", "X-Page-Key": "" if row["key"] is None else row["key"],
    }
    if row["record_type"] == "revisit":
        fields |= {"WARC-Refers-To": f"<{record_id(row['refers_to'])}>", "X-Refers-To-Key": row["refers_to"], "WARC-Profile": REVISIT_PROFILE, "Content-Length": 0}
    else:
        fields |= {"Content-Type": "text/html; charset=utf-8", "Content-Length": row["payload_bytes"]}
    return CRLF.join([b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in fields.items()), b"", b""])


def write(planned: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Write the rows of :func:`plan` as archives below ``folder``; returns (path, records), one row a finished archive.

    The returned table is written, so archives are written once and unfinished ones are not in it.
    """

    def run(batches):
        from pyspark import TaskContext

        ctx = TaskContext.get()
        number, out, path, n = 0, None, "", 0
        for batch in batches:
            heads = batch.select([c for c in batch.schema.names if c != "payload"]).to_pylist()
            for k, row in enumerate(heads):
                if out is None:
                    path = f"{folder}/part-{ctx.partitionId():05d}-{ctx.taskAttemptId()}-{number:04d}.warc.gz"
                    number += 1
                    store, inner = pafs.FileSystem.from_uri(path)
                    store.create_dir(inner.rpartition("/")[0], recursive=True)
                    out, n = store.open_output_stream(inner, compression=None), 0
                gz = zlib.compressobj(level, zlib.DEFLATED, 31)
                out.write(gz.compress(header(row)))
                if row["record_type"] == "response":
                    body = memoryview(batch.column("payload")[k].as_buffer())  # a view, not a copy
                    for lo in range(0, len(body), CHUNK):
                        out.write(gz.compress(body[lo : lo + CHUNK]))
                out.write(gz.compress(CRLF + CRLF))
                out.write(gz.flush())
                n += 1
                if out.tell() >= ARCHIVE:
                    out.close()
                    yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([n], pa.int64())})
                    out = None
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([n], pa.int64())})

    return cut(planned.mapInArrow(run, "path string, records long"), "warc-archives")


class Plain:
    """The plain bytes of a file of gzip members or none, as a stream with little read ahead."""

    def __init__(self, raw) -> None:
        self.raw, self.held, self.todo, self.gz, self.ended = raw, bytearray(), b"", None, False

    def more(self) -> bool:
        """Read on; False at the end."""
        if self.ended:
            return False
        data = self.todo or self.raw.read(CHUNK)
        self.todo = b""
        if not data:
            if self.gz is not None and self.gz is not False and not self.gz.eof:
                raise ValueError("an archive ends within a record")
            self.ended = True
            return False
        if self.gz is None:
            self.gz = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else False
        if self.gz is False:
            self.held += data
            return True
        if self.gz.eof:
            self.gz = zlib.decompressobj(31)
        self.held += self.gz.decompress(data, CHUNK)
        self.todo = self.gz.unused_data if self.gz.eof else self.gz.unconsumed_tail
        return True

    def head(self) -> dict[str, str] | None:
        """Fields of the next record's header; None at the end."""
        while (end := self.held.find(CRLF + CRLF)) < 0:
            if not self.more():
                if bytes(self.held).strip():
                    raise ValueError("an archive ends within a header")
                return None
        lines = bytes(self.held[:end]).decode().split("\r\n")
        del self.held[: end + 4]
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:80]!r}")
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}

    def body(self, n: int):
        """The n bytes of a body in chunks, then the record's end."""
        while n:
            while len(self.held) < min(n, CHUNK):
                if not self.more():
                    raise ValueError("an archive ends within a body")
            part = bytes(self.held[: min(n, CHUNK)])
            del self.held[: len(part)]
            n -= len(part)
            yield part
        while len(self.held) < 4:
            if not self.more():
                break
        if self.held[:4] != CRLF + CRLF:
            raise ValueError("a record doesn't end where its length says")
        del self.held[:4]


def stream(raw):
    """(fields, chunks) of each record; the chunks must be read before the next record."""
    plain = Plain(raw)
    while (fields := plain.head()) is not None:
        yield fields, plain.body(int(fields["content-length"]))


HEADS = "record_id string, page_id long, record_type string, refers_to long, target_uri string, header_digest string"


def read_chunks(archives: DataFrame, data: bool = True) -> DataFrame:
    """The chunk table of the archives that (path) names: HEADS' and CHUNKS' columns, at least one row a record.

    sha1_so_far is the digest of the payload up to and with the chunk; the last chunk's is the
    payload's.  A record without a body has one empty chunk.  ``data=False`` leaves the bytes out.
    Archives are read in as many tasks as there are archives.
    """
    shape = pa.schema([
        ("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("header_digest", pa.string()),
        ("chunk_no", pa.int32()), ("data", pa.binary()), ("chunk_bytes", pa.int64()), ("bytes_so_far", pa.int64()), ("sha1_so_far", pa.string()), ("is_last", pa.bool_()),
    ])

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, inner = pafs.FileSystem.from_uri(path)
                with store.open_input_stream(inner, compression=None) as raw:
                    for f, chunks in stream(raw):
                        digest = f.get("warc-payload-digest", "").removeprefix("sha1:")
                        number = lambda x: int(x) if x else None
                        head = {
                            "record_id": f["warc-record-id"].strip("<>"), "page_id": number(f.get("x-page-key")), "record_type": f["warc-type"], "refers_to": number(f.get("x-refers-to-key")),
                            "target_uri": f.get("warc-target-uri"), "header_digest": base64.b32decode(digest).hex() if digest else None,
                        }
                        sha, total, left = hashlib.sha1(), 0, int(f["content-length"])
                        for k, part in enumerate(chunks) if left else [(0, b"")]:
                            sha.update(part)
                            total += len(part)
                            rows.append(head | {
                                "chunk_no": k, "data": part if data else None, "chunk_bytes": len(part), "bytes_so_far": total, "sha1_so_far": sha.copy().hexdigest(), "is_last": total == left,
                            })
                            held += len(part) + 300
                            if held > 32 * CHUNK:
                                yield pa.RecordBatch.from_pylist(rows, shape)
                                rows, held = [], 0
                        if not left:
                            for _ in chunks:
                                pass
        if rows:
            yield pa.RecordBatch.from_pylist(rows, shape)

    # a task an archive; a stated number of partitions is not merged again
    one = archives.select("path").repartitionByRange(max(1, archives.count()), "path")
    return one.mapInArrow(run, f"{HEADS}, {CHUNKS.removeprefix('record_id string, ')}")


def records(chunks: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) per record, from the chunk table.

    A response's figures are those of its last chunk, carried along while it was read; a digest that
    differs from its header's fails.  A revisit's payload is the response's that it refers to.
    """
    last = chunks.where("is_last").select("record_id", "page_id", "record_type", "refers_to", "header_digest", "bytes_so_far", "sha1_so_far")
    same = F.assert_true(F.col("sha1_so_far") == F.col("header_digest"), F.lit("a payload differs from its digest"))
    first = last.where("record_type = 'response'").where(F.coalesce(same.cast("boolean"), F.lit(True)))
    plain = first.select("page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("sha1_so_far").alias("payload_digest"), "record_type", "refers_to")
    again = last.where("record_type <> 'response'").select("page_id", "record_type", "refers_to", "header_digest")
    # of a repeated response one row is enough to look payloads up
    target = plain.groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("header_digest")).agg(F.max("payload_bytes").alias("payload_bytes"))
    back = again.join(target, ["refers_to", "header_digest"], "left").select("page_id", "payload_bytes", F.col("header_digest").alias("payload_digest"), "record_type", "refers_to")
    return plain.unionByName(back)


def round_trip(spark: SparkSession, pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back: one row a page, as :func:`records`.

    Nulls, repeated rows, ties and empty payloads: see :func:`plan`.  No rows: no archive and an
    empty frame.  Columns besides the three aren't read.
    """
    archives = write(plan(pages, key, url, payload), fresh_path(spark, "warc"))
    out = records(cut(read_chunks(archives), "warc-chunks"))
    return out.withColumnRenamed("page_id", key)
