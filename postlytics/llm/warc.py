"""WARC archives written and read as a chunked record table.

Writing: each payload is cut into chunks; the first is a ``response`` record and
each further one a ``continuation`` record of it (the standard's segmentation), so no
record is larger than a chunk.  Records are rows of text, written by Spark as
gzip-compressed files to any store that Spark writes to.

Reading: Spark streams the lines of each file in order (a compressed file is one
split), and a parser driven by Content-Length turns them into rows (record, chunk
number) with the digest of the payload up to that chunk; a payload is never held as a
whole.  The last chunk of a record has its full length and digest."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postlytics.llm.common import slices, small_batches

# fixed values of the format
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD_END = "\r\n\r\n"
CHUNK_TABLE = ("record string, record_type string, refers_to string, uri string, chunk long, start long, data binary, "
               "sha1_so_far string, last boolean, declared_bytes long, declared_sha1 string")


def base32_sha1(data: Column) -> Column:
    """SHA-1 of a binary or string column as bare upper-case base32 (160 bits, no padding)."""
    digest = F.sha1(data)
    letters = F.array(*[F.lit(c) for c in BASE32])
    parts = []
    for i in range(0, 40, 5):  # 5 hex digits are 4 letters
        bits = F.conv(F.substring(digest, i + 1, 5), 16, 10).cast("int")
        parts += [F.element_at(letters, F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def _urn(value: str | None) -> str:
    return f"<urn:record:{'' if value is None else quote(value, safe='')}>"


def _value(urn: str | None) -> str | None:
    if not urn:
        return None
    return unquote(urn.removeprefix("<urn:record:").removesuffix(">")) or None


def text_chunks(data: bytes, size: int) -> list[bytes]:
    """``data`` (UTF-8) in pieces of at most ``size`` bytes, not cut inside a character."""
    out, at = [], 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        out.append(data[at:end])
        at = end
    return out or [b""]


def _records(page: str | None, url: str | None, payload: bytes, digest: str, length: int, refers: str | None, revisit: bool,
             date: str, chunk: int) -> Iterator[str]:
    uri = quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else "urn:none"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    common = f"WARC-Date: {date}\r\nWARC-Target-URI: {uri}\r\n"
    if revisit:
        head = (f"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: {_urn(page)}\r\n{common}WARC-Refers-To: {_urn(refers)}\r\n"
                "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"
                f"WARC-Payload-Digest: sha1:{digest}\r\nContent-Type: application/http; msgtype=response\r\n")
        yield f"{head}Content-Length: {len(http)}\r\n\r\n{http.decode()}"
        return
    parts = text_chunks(payload, chunk)
    for i, part in enumerate(parts):
        if i == 0:
            head = (f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: {_urn(page)}\r\n{common}"
                    f"WARC-Payload-Digest: sha1:{digest}\r\nContent-Type: application/http; msgtype=response\r\n")
            part = http + part
        else:
            head = (f"WARC/1.1\r\nWARC-Type: continuation\r\nWARC-Record-ID: {_urn(f'{page}/{i + 1}')}\r\n{common}"
                    f"WARC-Segment-Origin-ID: {_urn(page)}\r\n")
        if len(parts) > 1:
            head += f"WARC-Segment-Number: {i + 1}\r\n"
            if i == len(parts) - 1:
                head += f"WARC-Segment-Total-Length: {len(http) + len(payload)}\r\n"
        yield f"{head}Content-Length: {len(part)}\r\n\r\n{part.decode()}"


def write_warc(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
               min_revisit_bytes: int = 0, chunk_bytes: int = 1 << 16, date: str = "2000-01-01T00:00:00Z") -> None:
    """Write a record a row of ``df`` to ``path`` as gzip-compressed WARC files.

    Of rows with equal payloads of at least ``min_revisit_bytes`` bytes the one with
    the largest id is the response and the others revisit it; smaller payloads are all
    responses.  A null payload is empty; a null url is ``urn:none``; a null id revisits
    a row with an id, and is a response where no equal row has one; rows that repeat
    the largest id are each written as response.  An empty table writes no record.
    Other columns are not read.  Equal payloads are found on their digests alone;
    the payload travels once, to the join on the digest, whose small side has a row a
    digest, so a hot payload is split by AQE."""
    small_batches(df.sparkSession)
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), payload.alias("payload"),
                     base32_sha1(payload).alias("sha"), F.octet_length(payload).alias("size"))
    groups = (rows.where(F.col("size") >= min_revisit_bytes).groupBy("sha", "size")
              .agg(F.count(F.lit(1)).alias("n"), F.max("page").alias("response")).where("n > 1 AND response IS NOT NULL")
              .select("sha", "size", "response"))
    again = F.col("response").isNotNull() & ~F.col("page").eqNullSafe(F.col("response"))
    decided = rows.join(groups, ["sha", "size"], "left").select(
        F.col("page").cast("string").alias("page"), "url", F.when(again, "").otherwise(F.col("payload")).alias("payload"),
        "sha", F.col("size").cast("long").alias("size"), F.when(again, F.col("response").cast("string")).alias("refers"),
        F.coalesce(again, F.lit(False)).alias("again"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "payload"):
                page, url, payload, sha, size, refers, again = (batch.column(i).to_pylist() for i in range(7))
                out, held = [], 0
                for row in zip(page, url, payload, sha, size, refers, again):
                    for record in _records(row[0], row[1], row[2].encode(), *row[3:], date, chunk_bytes):
                        out.append(record)
                        held += len(record)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
                            out, held = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    decided.mapInArrow(run, "value string").write.option("lineSep", RECORD_END).option("compression", "gzip").text(path)


class Parser:
    """Lines of one archive, in order, to chunk rows.  ``feed`` a line without its
    line end, ``close`` at the file's end; both give the rows that are complete."""

    def __init__(self, chunk_bytes: int):
        self.size, self.rows = chunk_bytes, []
        self.head, self.left, self.http = None, 0, None
        self.record: dict | None = None

    def feed(self, line: bytes) -> None:
        if self.left:
            data = line + b"\n" if len(line) < self.left else line[:self.left]
            self.left -= len(data)
            self.block(data)
            return
        text = line.rstrip(b"\r")
        if self.head is None:
            if text.startswith(b"WARC/"):
                self.head = {}
        elif text:
            key, _, value = text.decode("utf-8", "replace").partition(":")
            self.head[key.strip().lower()] = value.strip()
        else:
            self.begin()

    def begin(self) -> None:
        head, self.head = self.head, None
        self.left, kind = int(head.get("content-length", 0)), head.get("warc-type")
        if kind == "continuation":
            if self.record is None or self.record["urn"] != head.get("warc-segment-origin-id"):
                raise ValueError(f"segment without its record: {head.get('warc-record-id')}")
            return
        self.close()
        if kind not in ("response", "revisit"):
            self.record, self.http = None, False
            return
        self.record = {"urn": head.get("warc-record-id"), "type": kind, "refers": head.get("warc-refers-to"),
                       "uri": head.get("warc-target-uri"), "sha1": head.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                       "bytes": None, "chunk": 0, "start": 0, "held": [], "n": 0, "sum": hashlib.sha1()}
        self.http = b""

    def block(self, data: bytes) -> None:
        if self.record is None:
            return
        if self.http is not False:  # still in the HTTP head
            self.http += data
            head, end, data = self.http.partition(b"\r\n\r\n")
            if not end:
                return
            for line in head.split(b"\r\n"):
                if line.lower().startswith(b"content-length:"):
                    self.record["bytes"] = int(line.split(b":")[1])
            self.http = False
        r = self.record
        while data:
            part = data[:self.size - r["n"]]
            r["held"].append(part)
            r["n"] += len(part)
            data = data[len(part):]
            if r["n"] == self.size and data:
                self.chunk(False)

    def chunk(self, last: bool) -> None:
        r = self.record
        data = b"".join(r["held"])
        r["sum"].update(data)
        self.rows.append((_value(r["urn"]), r["type"], _value(r["refers"]), r["uri"], r["chunk"], r["start"], data,
                          base64.b32encode(r["sum"].copy().digest()).decode(), last, r["bytes"], r["sha1"]))
        r["chunk"] += 1
        r["start"] += len(data)
        r["held"], r["n"] = [], 0

    def close(self) -> None:
        """End the open record: its last chunk, which is empty for an empty payload."""
        if self.record is not None:
            self.chunk(True)
            self.record = None


def read_warc(spark: SparkSession, path: str, chunk_bytes: int = 1 << 16) -> DataFrame:
    """The chunk table of the gzip-compressed archives in ``path``: a row a response or
    revisit record and chunk of at most ``chunk_bytes``, ``chunk`` and ``start`` counted
    from 0, ``sha1_so_far`` the digest of the payload up to this chunk (base32), ``last``
    on the record's last chunk.  A revisit has one empty chunk; ``declared_bytes`` and
    ``declared_sha1`` are what its headers say of the payload.  Other records are left
    out.  A segment whose record does not come before it is an error."""
    small_batches(spark)
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string(),
                 pa.bool_(), pa.int64(), pa.string()]
        cols = list(zip(*rows)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                          [x.split()[0] for x in CHUNK_TABLE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, parser = None, Parser(chunk_bytes)
        for batch in batches:
            for name, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name != file:
                    parser.close()
                    rows, parser, file = parser.rows, Parser(chunk_bytes), name
                    parser.rows = rows
                parser.feed(line)
                if len(parser.rows) >= 128:
                    yield table(parser.rows)
                    parser.rows = []
        parser.close()
        yield table(parser.rows)

    return lines.mapInArrow(run, CHUNK_TABLE)


def warc_digest(chunks: DataFrame, id_type: str = "long") -> DataFrame:
    """One row a record, from its last chunk: the length and digest counted while
    reading for a response, those declared for a revisit; ``intact`` says that the
    digest read equals the declared one."""
    response = F.col("record_type") == "response"
    return chunks.where("last").select(
        F.col("record").cast(id_type).alias("page_id"),
        F.when(response, F.col("start") + F.octet_length("data")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.when(response, F.col("sha1_so_far")).otherwise(F.col("declared_sha1")).alias("payload_digest"), "record_type",
        F.when(~response, F.col("refers_to")).cast(id_type).alias("refers_to"),
        (~response | (F.col("sha1_so_far") == F.col("declared_sha1"))).alias("intact"))


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, html, sha1(html) AS hex, strlen(html) AS n FROM p),
b AS (SELECT page_id, n, hex, list_aggregate(list_transform(range(0, 32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               1 + CAST((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT), 1)),
        'string_agg', '') AS digest FROM h),
g AS (SELECT digest, n, max(page_id) AS response FROM b GROUP BY 1, 2)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> response THEN response END AS refers_to, true AS intact
FROM b JOIN g USING (digest, n)
"""
