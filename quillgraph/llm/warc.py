"""WARC archives: written as whole-file gzip streams, normalised to one gzip member per record, with an offset index.

Writing.  Spark's own text writer renders each record as one value and ends it with the two line breaks that end a WARC
record, so it leaves monolithic ``.warc.gz`` streams on whatever file system the shared folder is on.  Of records with
equal payloads, the one with the smallest id is a ``response``; the others are ``revisit`` records that carry the HTTP
header, the payload's digest and the id that they refer to, but no payload.  Records go into streams by their size, so
many to a stream that none holds more than some 64 MB, but for one larger record.

Normalising.  Each stream is inflated once, in pieces; every record is written again as a gzip member of its own as it
comes, and a sidecar index gets a line per record: offset, length, record id, type.  Both files first have a temporary
name, so a task that is run again after a lost executor replaces whole files.  A task holds one compressed stream and one
record.

Reading.  A record is read by its index line alone: seek, inflate one member, parse.

Defined results
* null and empty html: an empty payload, digested like any other; all empty payloads are equal
* a url is percent-escaped where it would break a header line; null is an empty target
* rows that repeat an id are records each; the first of an id and payload is no revisit of itself: equal ids with equal
  payloads are all responses
* null ids are written with an empty id and read back as null; nothing refers to them, and a payload that others have too
  is a response in them
* very long html is one record in a stream of its own
* an empty table gives an empty result; only the id, url and html columns are read
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import qualified, scratch_path, written

CRLF = "\r\n"
#: Bytes inflated at a time.
PIECE = 1 << 20
#: Payload bytes up to which a record goes into streams of so many records; larger ones are alone.
STREAMS = {16 << 10: 4096, 1 << 20: 64}
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of(digits: Column) -> Column:
    """A SHA-1 in hex as upper-case base32: each ten hex digits are eight characters."""
    groups = [F.conv(F.substring(digits, 1 + 10 * i, 10), 16, 10).cast("long") for i in range(4)]
    return F.concat(*[F.substring(F.lit(BASE32), (F.shiftright(g, 35 - 5 * j).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for g in groups for j in range(8)])


def digested(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, payload, size, sha)"""
    html = F.coalesce(F.col(html_col), F.lit(""))
    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), html.alias("payload"), F.octet_length(html).cast("long").alias("size"), F.sha1(html.cast("binary")).alias("sha"))


def repeated(rows: DataFrame, least: int = 0) -> DataFrame:
    """(sha, size, first): payloads of at least ``least`` bytes that occur again, and the smallest id of each."""
    return rows.where(F.col("size") >= least).groupBy("sha", "size").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")


def records(rows: DataFrame, again: DataFrame) -> DataFrame:
    """(id, url, payload, size, digest, of): ``of`` is the id that a revisit refers to.

    ``again`` is a written table without payloads: where it is small Spark broadcasts it, and no payload is shuffled.
    """
    joined = rows.join(again, ["sha", "size"], "left")
    return joined.select("id", "url", "payload", "size", base32_of(F.col("sha")).alias("digest"), F.when(F.col("id") != F.col("first"), F.col("first")).alias("of"))


def rendered(found: DataFrame) -> DataFrame:
    """One text value per record: everything but the two line breaks that end it."""
    text = F.coalesce(F.col("id").cast("string"), F.lit(""))
    revisit = F.col("of").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size"), F.lit(CRLF + CRLF))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\x00-\x20\x7F]", "%20")
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{CRLF}WARC-Record-ID: <urn:page:"), text, F.lit(f">{CRLF}WARC-Target-URI: "), url,
        F.lit(f"{CRLF}WARC-Date: 1970-01-01T00:00:00Z{CRLF}WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: <urn:page:"), F.col("of").cast("string"), F.lit(">"))).otherwise(F.lit("")),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF),
    )
    return found.select(F.concat(head, block).alias("value"))


def write_streams(pages: DataFrame, path: str, least: int = 0, **names: str) -> list[str]:
    """Write the pages' records as gzip streams, each one member over the whole file, into the folders below ``path`` that are returned."""
    rows = digested(pages, **names)
    again = written(repeated(rows, least), "warc-digests")
    classes = [*STREAMS.items(), (None, 1)]
    counts = rows.select("size").agg(*[F.count_if(_between(i, classes)).alias(str(i)) for i in range(len(classes))]).first()
    folders = []
    for i, (_, most) in enumerate(classes):
        if counts[i] or i == 0:
            folders.append(f"{path}/{i}")
            kept = rendered(records(rows.where(_between(i, classes)), again))
            kept.write.option("compression", "gzip").option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", most).text(folders[-1])
    return folders


def _between(i: int, classes: list[tuple[int | None, int]]) -> Column:
    low, high = classes[i - 1][0] if i else -1, classes[i][0]
    return F.col("size") > low if high is None else (F.col("size") > low) & (F.col("size") <= high)


class Reader:
    """Records of a decompressed stream, one at a time, from pieces of it."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, bytearray()

    def _until(self, n: int) -> bool:
        while len(self.held) < n:
            piece = next(self.pieces, None)
            if piece is None:
                return False
            self.held += piece
        return True

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        """Header fields and all bytes of each record."""
        while self._until(1):
            end = -1
            while (end := self.held.find(b"\r\n\r\n")) < 0:
                if not self._until(len(self.held) + 1):
                    raise ValueError("a record's header breaks off")
            fields = header_fields(bytes(self.held[:end]))
            whole = end + 4 + int(fields["content-length"]) + 4
            if not self._until(whole):
                raise ValueError("a record's block breaks off")
            yield fields, bytes(self.held[:whole])
            del self.held[:whole]


def header_fields(head: bytes) -> dict[str, str]:
    """Fields of a WARC or HTTP header by lower-case name."""
    lines = head.decode("utf-8", "replace").split(CRLF)[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def inflated(data: bytes | memoryview) -> Iterator[bytes]:
    """Pieces of a gzip file of one or several members, inflated once."""
    view = memoryview(data)
    while len(view):
        z = zlib.decompressobj(31)
        while not z.eof:
            fed = z.unconsumed_tail or view[:PIECE]
            if not len(fed):
                raise ValueError("the stream breaks off")
            if not z.unconsumed_tail:
                view = view[PIECE:]
            if piece := z.decompress(fed, PIECE):
                yield piece
        if z.unused_data:
            view = memoryview(z.unused_data + bytes(view))


def member(record: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or URI, and the path on it; Spark's names for S3 become the one that Arrow knows."""
    path = re.sub(r"\As3[an]://", "s3://", path)
    if "://" not in path and not path.startswith("file:"):
        return pa.fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pa.fs.FileSystem.from_uri(path)


def put(path: str, data: Iterable[bytes]) -> None:
    """Write a file under a temporary name of its own, then give it its name, in place of one from an earlier attempt."""
    fs, at = file_system(path)
    part = f"{at}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part, compression=None) as out:
        for piece in data:
            out.write(piece)
    try:
        fs.move(part, at)
    except OSError:  # a file system that doesn't move onto a file that is there
        fs.delete_file(at)
        fs.move(part, at)


def normalise(streams: DataFrame, target: str) -> DataFrame:
    """(archive, index, records): rewrites each gzip stream (columns path, content) below ``target``.

    Lazy: files are written when the result is.  Each has a name made from its stream's path.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                name = f"{target}/{hashlib.sha1(path.encode()).hexdigest()}"
                lines: list[str] = []

                def members(stream=memoryview(content.as_buffer()), lines=lines) -> Iterator[bytes]:
                    at = 0
                    for fields, record in Reader(inflated(stream)):
                        data = member(record)
                        lines.append(json.dumps({"offset": at, "length": len(data), "id": fields["warc-record-id"], "type": fields["warc-type"]}) + "\n")
                        at += len(data)
                        yield data

                put(f"{name}.warc.gz", members())
                put(f"{name}.index.jsonl", (x.encode() for x in lines))
                yield pa.RecordBatch.from_pydict({"archive": [f"{name}.warc.gz"], "index": [f"{name}.index.jsonl"], "records": pa.array([len(lines)], pa.int64())})

    fs, at = file_system(target)
    fs.create_dir(at, recursive=True)
    return streams.select("path", "content").mapInArrow(run, "archive string, index string, records long")


def number_of(urn: str | None) -> int | None:
    """The id in ``<urn:page:id>``."""
    digits = (urn or "").strip("<>").rpartition(":")[2]
    return int(digits) if digits else None


def parse(record: bytes) -> tuple[int | None, int, str, str, int | None]:
    """Id, payload bytes, payload digest, type and the id referred to, from one record's bytes.

    A response's size and digest are those of the payload that it holds; a revisit's are in its headers.
    """
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = header_fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["warc-type"]
    if kind == "revisit":
        return number_of(fields["warc-record-id"]), int(header_fields(http)["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:"), kind, number_of(fields["warc-refers-to"])
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if f"sha1:{digest}" != fields["warc-payload-digest"]:
        raise ValueError("a payload doesn't have its record's digest")
    return number_of(fields["warc-record-id"]), len(payload), digest, kind, None


#: Records that are read into one batch.
READ = 4096


def read(archives: DataFrame) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) of every record that the indexes of ``archives`` name."""
    names = ["id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, at = file_system(index)
                with fs.open_input_stream(at, compression=None) as f:
                    lines = [json.loads(x) for x in f.read().decode().splitlines()]
                fs, at = file_system(archive)
                with fs.open_input_file(at) as f:
                    for i in range(0, len(lines), READ):
                        rows = []
                        for x in lines[i : i + READ]:
                            f.seek(x["offset"])
                            rows.append(parse(zlib.decompress(f.read(x["length"]), 31)))
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return archives.select("archive", "index").mapInArrow(run, "id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, folder: str | None = None, **names: str) -> DataFrame:
    """Write, normalise and index the pages' archives below ``folder`` (by default in the shared one); (archive, index, records)."""
    spark = pages.sparkSession
    folder = qualified(spark, folder) if folder else scratch_path(spark, "warc")
    folders = write_streams(pages, f"{folder}/streams", **names)
    streams = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folders)
    normalise(streams, f"{folder}/archives").write.parquet(f"{folder}/catalog")
    return spark.read.schema("archive string, index string, records long").parquet(f"{folder}/catalog")
