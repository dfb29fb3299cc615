"""WARC archives: a writer and a sequential reader over files in the shared folder.

*Format.* WARC/1.1, one gzip member per record. A response record holds an HTTP header and the payload. A revisit record
(identical-payload-digest profile) holds only the HTTP header, whose Content-Length still tells the payload's size, and
refers to its response. Record ids are urn:x-page:<page id>.

*Writer.* Payload digests are grouped (with partial aggregation) to find, for every payload of at least ``MIN_REVISIT``
bytes that occurs more than once, its smallest page id. Pages meet that table by (digest, salt), where repeated payloads
are spread over ``SALTS`` salts, so a payload that a third of all pages share is no hot key. Each task streams records
into archives of about ``ARCHIVE_BYTES``, under names that no other attempt uses, and returns their names; what counts is
the manifest, which Spark commits as a table. A lost or repeated task so leaves at most files that nobody lists.

*Reader.* Each task takes whole archives and reads them front to back in blocks: zlib decompresses incrementally, a
record's header is parsed as soon as it is complete, its content is framed by Content-Length and hashed as it passes,
never held, unless payloads are asked for. The reader raises on a wrong version line, a missing field, a truncated
record, trailing bytes in a member, or a digest that does not match.

``verified`` also holds every revisit against the response it refers to: pairs of page id and digest that no response has are
an error. Pairs are made distinct before they meet the responses, so a page that very many refer to is one row.

Defined results. In a URL, line ends are written as %0D and %0A, and blanks at its ends as their codes, so that it stays one header
value; a null URL is read back as an empty one. A null or empty html is an empty payload. Rows that repeat the smallest page id of a payload are all
responses; a row without a page id is a revisit of one that has one. An empty table gives no archives and no records.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, map_arrow, materialise, new_path, table

MIN_REVISIT, SALTS, ARCHIVE_BYTES, BLOCK = 100, 16, 64 << 20, 1 << 18
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PREFIX = "urn:x-page:"
DATE = "2024-01-01T00:00:00Z"  # of the crawl, where the pages do not tell theirs
MANIFEST = "path string, records long, bytes long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


# ---------------------------------------------------------------- records


def header_value(url: str) -> str:
    """A URL on one line, without blanks at its ends."""
    url = url.replace("\r", "%0D").replace("\n", "%0A")
    inner = url.strip(" \t\x0b\x0c")
    at = url.find(inner) if inner else len(url)
    coded = lambda blanks: "".join(f"%{ord(c):02X}" for c in blanks)
    return coded(url[:at]) + inner + coded(url[at + len(inner) :])


def record(page_id: int | None, url: str | None, payload: bytes, payload_bytes: int, digest: str, refers_to: int | None) -> bytes:
    """One gzip member. refers_to: write a revisit of that page, without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % payload_bytes
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{PREFIX}{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", header_value(url or "")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{PREFIX}{refers_to}>")]
    block = http if refers_to is not None else http + payload
    fields += [("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


class WarcError(ValueError):
    """An archive that breaks the format, or whose digests do not match."""


@dataclass
class Record:
    fields: dict[str, str]
    http: dict[str, str]
    payload_bytes: int  # as HTTP's Content-Length tells it
    payload: bytes | None


def _fields(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise WarcError(f"header line without a colon: {line[:80]!r}")
        out[name.strip().lower().decode()] = value.strip().decode()
    return out


class Reader:
    """Iterates over the records of a stream of gzip members. Bytes are read in blocks, and what is held is one block,
    its decompressed bytes and one header; the payload too if keep is set."""

    def __init__(self, stream, *, keep: bool = False, block: int = BLOCK):
        self.stream, self.keep, self.block, self.raw = stream, keep, block, b""

    def _more(self, z, want: int) -> bytes:
        """Decompressed bytes of the current member, at most want; empty at its end."""
        while not z.eof:
            data = z.unconsumed_tail or self.raw or self.stream.read(self.block)
            if not data:
                raise WarcError("truncated member")
            self.raw = b"" if not z.unconsumed_tail else self.raw
            out = z.decompress(data, want)
            if z.eof:
                self.raw = z.unused_data + self.raw
            if out:
                return out
        return b""

    def __iter__(self) -> Iterator[Record]:
        while True:
            if not self.raw:
                self.raw = self.stream.read(self.block)
            if not self.raw:
                return
            yield self._record(zlib.decompressobj(31))

    def _until(self, z, held: bytearray, mark: bytes) -> bytes:
        at = held.find(mark)
        while at < 0:
            more = self._more(z, 1 << 14)
            if not more:
                raise WarcError("member ends inside a header")
            since = max(0, len(held) - len(mark))
            held += more
            at = held.find(mark, since)
        head = bytes(held[:at])
        del held[: at + len(mark)]
        return head

    def _record(self, z) -> Record:
        held = bytearray()
        lines = self._until(z, held, b"\r\n\r\n").split(b"\r\n")
        if lines[0] != VERSION:
            raise WarcError(f"not a WARC record: {lines[0][:40]!r}")
        fields = _fields(lines[1:])
        try:
            length = int(fields["content-length"])
        except (KeyError, ValueError):
            raise WarcError("record without a Content-Length") from None
        block_hash, payload_hash, left = hashlib.sha256(), hashlib.sha256(), length
        head, in_payload, http, kept, n = bytearray(), False, {}, [], 0
        while left:
            data = bytes(held[:left]) if held else self._more(z, min(left, 1 << 16))
            if not data:
                raise WarcError("member ends inside its content")
            del held[: len(data)]
            left -= len(data)
            block_hash.update(data)
            if not in_payload:
                head += data
                at = head.find(b"\r\n\r\n")
                if at < 0:
                    continue
                http, data, in_payload = _fields(bytes(head[:at]).split(b"\r\n")[1:]), bytes(head[at + 4 :]), True
            payload_hash.update(data)
            n += len(data)
            if self.keep:
                kept.append(data)
        while more := self._more(z, 64):
            held += more
        if bytes(held) != b"\r\n\r\n":
            raise WarcError("record does not end where its Content-Length says")
        if fields.get("warc-block-digest", "").removeprefix("sha256:") != block_hash.hexdigest():
            raise WarcError("block digest does not match")
        told = int(http.get("content-length", -1))
        if fields["warc-type"] == "response":
            if fields.get("warc-payload-digest", "").removeprefix("sha256:") != payload_hash.hexdigest() or n != told:
                raise WarcError("payload digest or length does not match")
        elif n:
            raise WarcError("a revisit with a payload")
        return Record(fields, http, told, b"".join(kept) if self.keep and fields["warc-type"] == "response" else None)


def page_of(urn: str | None) -> int | None:
    tail = urn.strip("<>").removeprefix(PREFIX) if urn else ""
    return int(tail) if tail else None


# ---------------------------------------------------------------- Spark


def write_warc(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES, path: str | None = None) -> DataFrame:
    """Write the archives; the manifest (path, records, bytes) as a committed table."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("n"), F.sha2(html.cast("binary"), 256).alias("digest"))
    repeated = rows.where(F.col("n") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    spread = repeated.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    rows = rows.join(spread, ["digest", "salt"], "left")
    refers = F.when(F.col("first").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("first"), F.lit(False)), F.col("first"))
    rows = rows.select("page_id", "url", "html", "n", "digest", refers.alias("refers_to"))

    def run(batches):
        fs, root = filesystem(path)
        fs.create_dir(root, recursive=True)
        out, name, n, size, done = None, "", 0, 0, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "n", "digest", "refers_to")), strict=True):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None, buffer_size=1 << 20)
                page_id, url, text, length, digest, refers_to = row
                size += out.write(record(page_id, url, text.encode() if refers_to is None else b"", length, digest, refers_to))
                n += 1
                if size >= archive_bytes:
                    out.close()
                    done.append((name, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, n, size))
        if done:
            yield pa.record_batch([pa.array([f"{path}/{x}" for x, _, _ in done]), pa.array([x for _, x, _ in done], pa.int64()), pa.array([x for _, _, x in done], pa.int64())], names=["path", "records", "bytes"])

    return materialise(map_arrow(rows, run, MANIFEST), "warc-manifest")


def read_warc(manifest: DataFrame, *, payloads: bool = False, partitions: int | None = None) -> DataFrame:
    """Every record of the listed archives; the payload column is null unless asked for."""

    def run(batches):
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                fs, at = filesystem(uri)
                rows, held = [], 0
                with fs.open_input_stream(at, compression=None) as stream:
                    for r in Reader(stream, keep=payloads):
                        f = r.fields
                        rows.append((page_of(f["warc-record-id"]), f.get("warc-target-uri"), f["warc-type"], page_of(f.get("warc-refers-to")), r.payload_bytes, f["warc-payload-digest"].removeprefix("sha256:"), r.payload))
                        held += len(r.payload or b"") + 300
                        if held >= 8 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    if partitions is None:
        partitions = max(1, min(10_000, manifest.count()))
    return map_arrow(manifest.select("path").repartition(partitions), run, RECORDS)


def verified(manifest: DataFrame) -> DataFrame:
    """The records of the listed archives, without payloads, once every revisit agrees with a response."""
    records = materialise(read_warc(manifest).drop("payload"), "warc-records", keep=True)
    asked = records.where("record_type <> 'response'").select("refers_to", "payload_digest").distinct()
    held = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest")
    if (bad := asked.join(held, ["refers_to", "payload_digest"], "left_anti").first()) is not None:
        raise WarcError(f"a revisit refers to page {bad['refers_to']} for {bad['payload_digest']}, which no response has")
    return records


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    names = ("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload")
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))


def op1_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return verified(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""
