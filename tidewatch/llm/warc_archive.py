"""WARC archives: a writer that stores equal payloads once, and a splittable reader.

Each record is a gzip member of its own. A reading task gets a byte range of a file, looks in it for gzip's
first bytes, checks a candidate by decoding its first bytes and its header, and owns the records that start
inside the range; it reads past the range's end to finish the last of them.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import shared

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
GZIP = 31
READ = 256 * 1024
FILES = "file string, bytes bigint, warcinfo string"
RECORDS = (
    "record_id string, record_type string, target_uri string, refers_to string, payload binary, "
    "payload_bytes bigint, payload_digest string"
)


def _packed(block: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, GZIP)
    return packer.compress(block) + packer.flush()


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    # header values hold no line ends: those would start a field of their own
    head = "".join(f"{k}: {v}\r\n" for k, v in (*fields, ("Content-Length", str(len(block)))))
    return VERSION + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _one_line(text: str | None) -> str:
    return "".join(f"%{ord(c):02X}" if c in "\r\n%" else c for c in text or "")


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", least_bytes: int = 1000, level: int = 6) -> DataFrame:
    """Write one record per row of pages; one row per archive file: file, bytes, warcinfo.

    Of records with equal payloads of least_bytes or more, those with the largest id are responses and the
    others revisits, which hold no payload. Payloads are UTF-8; null ones are empty. A null id is below all
    others; rows of equal id and payload are responses alike. Files have names of their own for each attempt
    of a task, and only those of finished tasks are in the result. An empty table gives no files.
    """
    spark = pages.sparkSession
    shared.prepare(spark)
    payload = F.encode(shared.text_or_empty(payload_col), "UTF-8")
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    stored = shared.written(
        rows.where(F.length("payload") >= least_bytes).groupBy(F.col("digest").alias("of")).agg(
            F.max("id").alias("stored"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "stored")
    placed = rows.join(stored, F.col("digest") == F.col("of"), "left").withColumn(
        "refers", F.when(F.coalesce(F.col("id") < F.col("stored"), F.col("id").isNull() & F.col("stored").isNotNull()),
                         F.col("stored")))
    ready = placed.select("id", "url", "digest", "refers", F.length("payload").alias("size"),
                          F.when(F.col("refers").isNull(), F.col("payload")).alias("payload"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, file, size, info = None, "", 0, f"<urn:uuid:{uuid.uuid4()}>"
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    filesystem, path = pafs.FileSystem.from_uri(folder)
                    filesystem.create_dir(path, recursive=True)
                    file = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                    out = filesystem.open_output_stream(f"{path}/{file}", compression=None)
                    member = _packed(_record(
                        [("WARC-Type", "warcinfo"), ("WARC-Record-ID", info), ("Content-Type", "application/warc-fields")],
                        b"format: WARC File Format 1.1\r\n"), level)
                    out.write(member)
                    size += len(member)
                member = _packed(_page_record(row, info), level)
                out.write(member)
                size += len(member)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [file], "bytes": [size], "warcinfo": [info]})

    return shared.written(ready.mapInArrow(write, FILES), "archives")


def _page_record(row: dict, info: str) -> bytes:
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['size']}\r\n\r\n").encode()
    fields = [
        ("WARC-Type", "response" if row["refers"] is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if row['id'] is None else row['id']}>"), ("WARC-Warcinfo-ID", info),
        ("WARC-Target-URI", _one_line(row["url"])), ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{row['digest']}"), ("Content-Type", "application/http; msgtype=response")]
    if row["refers"] is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{row['refers']}>"),
                   ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        return _record(fields, http)
    return _record(fields, http + row["payload"])


def _member(source: pa.NativeFile, at: int, most: int | None = None) -> tuple[bytes, int] | None:
    """The gzip member that starts at a byte, and where it ends; only most bytes of it where that is given."""
    unpack, parts, got = zlib.decompressobj(GZIP), [], 0
    source.seek(at)
    while not unpack.eof:
        data = source.read(READ if most is None else 4096)
        if not data:
            return None
        try:
            part = unpack.decompress(data, 0 if most is None else most - got)
        except zlib.error:
            return None
        parts.append(part)
        got += len(part)
        at += len(data)
        if most is not None and got >= most:
            break
    return b"".join(parts), at - len(unpack.unused_data)


def _header(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = block.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    return fields, rest


def _starts_record(source: pa.NativeFile, at: int, info: str) -> bool:
    """Whether a member of this archive starts here: its header decodes and names the archive.

    The header is compared as bytes, for the part read may end within a character, and read on until it ends.
    """
    names = {f"{field}: {info}".encode() for field in ("WARC-Warcinfo-ID", "WARC-Record-ID")}
    most = 4096
    while True:
        got = _member(source, at, most)
        if got is None or not got[0].startswith(b"WARC/1."):
            return False
        head, end, _ = got[0].partition(b"\r\n\r\n")
        lines = head.split(b"\r\n")
        if names.intersection(lines if end else lines[:-1]):
            return True
        if end or len(got[0]) < most:
            return False
        most *= 4


def _first_record(source: pa.NativeFile, start: int, stop: int, info: str) -> int | None:
    at = start
    while at < stop:
        source.seek(at)
        data = source.read(min(READ, stop - at) + len(MAGIC) - 1)
        place = data.find(MAGIC)
        while place >= 0:
            if at + place < stop and _starts_record(source, at + place, info):
                return at + place
            place = data.find(MAGIC, place + 1)
        at += READ
    return None


def records_in(source: pa.NativeFile, start: int, stop: int, info: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and block of the records that start in a byte range."""
    at = _first_record(source, start, stop, info)
    while at is not None and at < stop:
        got = _member(source, at)
        if got is None:
            raise ValueError(f"broken record at byte {at}")
        fields, rest = _header(got[0])
        yield fields, rest[: int(fields["Content-Length"])]
        at = got[1]


def _parsed(fields: dict[str, str], block: bytes) -> dict:
    http, _, body = block.partition(b"\r\n\r\n")
    response = fields["WARC-Type"] == "response"
    said = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    return {
        "record_id": fields["WARC-Record-ID"], "record_type": fields["WARC-Type"],
        "target_uri": fields.get("WARC-Target-URI"), "refers_to": fields.get("WARC-Refers-To"),
        "payload": body if response else None, "payload_bytes": len(body) if response else said,
        "payload_digest": hashlib.sha1(body).hexdigest() if response
        else fields.get("WARC-Payload-Digest", "").removeprefix("sha1:"),
    }


def read_archives(files: DataFrame, folder: str, *, split_bytes: int = 8 * 2**20, payloads: bool = True) -> DataFrame:
    """The response and revisit records of the files, one row each; files are cut into ranges of split_bytes.

    payloads: whether to return the payloads too; a revisit has none, and its length and digest are those
    that its header states.
    """
    spark = files.sparkSession
    shared.prepare(spark)
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long")))
    splits = files.where("bytes > 0").select("file", "warcinfo", "bytes", starts.alias("start")).select(
        "file", "warcinfo", "start", F.least(F.col("start") + split_bytes, "bytes").alias("stop"))
    spread = splits.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    schema = shared.arrow_schema(RECORDS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for split in batch.to_pylist():
                filesystem, path = pafs.FileSystem.from_uri(folder)
                held, weight = [], 0
                with filesystem.open_input_file(f"{path}/{split['file']}") as source:
                    for fields, block in records_in(source, split["start"], split["stop"], split["warcinfo"]):
                        if fields["WARC-Type"] not in ("response", "revisit"):
                            continue
                        row = _parsed(fields, block)
                        if not payloads:
                            row["payload"] = None
                        held.append(row)
                        weight += 200 + len(row["payload"] or b"")
                        if weight >= 8 * 2**20:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, weight = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return spread.mapInArrow(read, RECORDS)
