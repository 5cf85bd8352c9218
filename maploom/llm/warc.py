"""A Python data source for WARC archives, and payload deduplication into revisit records.

Reading. The driver plans one partition per group of files, and several for a gzipped file of more than
partition_bytes: each takes the records that begin in its range of bytes, the first of which is found by trying what
looks like a gzip member. Within a task each record's headers are parsed first; filters on record_type, target_uri,
date, record_id, refers_to and payload_digest are pushed down to them (spark.sql.python.filterPushdown.enabled), and
those on source to the plan of files. A record that they reject, or whose payload is not asked for (option
payload=false), is passed over by its length without inflating or decoding it. Plain files, gzipped records with a
skip-length extra field ("sl", as the standard's annex describes) and other gzipped records are read; of the last kind
only the length makes inflating necessary.

The payload of a record is its block, of an HTTP message what follows the HTTP headers; revisits have none, and their
payload_length is what their HTTP headers say. Names of headers are read in any case, bytes that are no UTF-8 are
replaced, and a header that goes on in a line with leading white space is joined.

Writing. Each task writes files of its own under names of its attempt; the driver gives the files of
successful attempts their final names on commit and deletes the others of the same job, so lost executors leave no
records. mode("overwrite") deletes the archives that were there once the new ones are complete. A file ends at
max_bytes.

Paths are local or of any store that pyarrow reaches by URI.

Defined results: a null payload counts as empty; a null id is written as such and is smaller than any other;
line breaks in an address are percent-encoded; rows that repeat the id and payload of a response are responses
too; an empty table gives archives without records. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from maploom.llm.shared import row_salt, salted_group, scratch_dir

SCHEMA = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, payload_length long, payload binary, source string, position long"
COLUMNS = [part.split()[0] for part in SCHEMA.split(", ")]
ARROW = pa.schema([(n, pa.int64() if n in ("payload_length", "position") else pa.binary() if n == "payload" else pa.string()) for n in COLUMNS])
HEADERS = {"WARC-Record-ID": "record_id", "WARC-Type": "record_type", "WARC-Target-URI": "target_uri", "WARC-Date": "date", "WARC-Refers-To": "refers_to", "WARC-Payload-Digest": "payload_digest"}
BATCH_BYTES = 8 << 20
PEEK = 4096
GZIP = b"\x1f\x8b\x08"


def store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":" in path else (pafs.LocalFileSystem(), path)


def record_bytes(row: dict) -> bytes:
    """A response or revisit record: headers and an HTTP block; a revisit's block ends with its headers."""
    body = row["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_length']}\r\n\r\n".encode()
    block = http + (body if row["record_type"] == "response" else b"")
    lines = ["WARC/1.1", *(f"{h}: {row[c]}" for h, c in HEADERS.items() if row[c] is not None)]
    if row["record_type"] == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def gzipped(record: bytes, level: int) -> bytes:
    """A gzip member whose extra field holds its own length and the record's."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size if size < 1 << 32 else 0, len(record) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


class _Plain:
    """An uncompressed record at the file's position."""

    def __init__(self, file):
        self.file, self.at = file, file.tell()
        self.head = b""

    def more(self) -> bytes:
        return self.file.read(PEEK)

    def rest(self, have: bytes, size: int) -> bytes:
        return have + self.file.read(max(0, size - len(have)))

    def skip(self, size: int) -> None:
        self.file.seek(self.at + size)


class _Member:
    """A gzip member at the file's position; inflated as far as asked for."""

    def __init__(self, file):
        self.file, self.at, self.size = file, file.tell(), 0
        head = file.read(12)
        if head[:4] == b"\x1f\x8b\x08\x04":
            extra = file.read(struct.unpack("<H", head[10:12])[0])
            while len(extra) >= 4:
                kind, n = struct.unpack("<2sH", extra[:4])
                if kind == b"sl" and n == 8:
                    self.size = struct.unpack("<I", extra[4:8])[0]
                extra = extra[4 + n :]
        self.inflate = zlib.decompressobj(-15)
        if not self.size:  # no length to go by: the library reads the whole member
            file.seek(self.at)
            self.inflate = zlib.decompressobj(31)

    def more(self) -> bytes:
        out = b""
        while not out and not self.inflate.eof and (data := self.inflate.unconsumed_tail or self.file.read(PEEK)):
            out = self.inflate.decompress(data, PEEK)
        return out

    def rest(self, have: bytes, size: int) -> bytes:
        parts, n = [have], len(have)
        while n < size and not self.inflate.eof and (data := self.inflate.unconsumed_tail or self.file.read(1 << 16)):
            parts.append(self.inflate.decompress(data, size - n))
            n += len(parts[-1])
        return b"".join(parts)

    def skip(self, size: int) -> None:
        if self.size:
            self.file.seek(self.at + self.size)
            return
        while not self.inflate.eof and (data := self.inflate.unconsumed_tail or self.file.read(1 << 16)):
            self.inflate.decompress(data, 1 << 20)
        self.file.seek(self.file.tell() - len(self.inflate.unused_data))


def _fields(head: bytes) -> dict[str, str]:
    """Header lines by their names in small letters; lines that go on are joined."""
    lines: list[str] = []
    for line in re.split(r"\r?\n", head.decode(errors="replace"))[1:]:
        if line[:1] in (" ", "\t") and lines:
            lines[-1] += " " + line.strip()
        else:
            lines.append(line)
    return {name.strip().lower(): value.strip() for name, colon, value in (x.partition(":") for x in lines) if colon}


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"[0-9]+", text) else None


def records(file, start: int, end: int, wanted, payload: bool) -> Iterator[dict]:
    """The records of an open file from start, which must begin one, that begin before end and whose headers pass
    wanted; payload: whether to inflate theirs."""
    file.seek(start)
    while (at := file.tell()) < end:
        magic = file.read(2)
        file.seek(at)
        source = _Member(file) if magic == b"\x1f\x8b" else _Plain(file)
        data = b""
        while b"\r\n\r\n" not in data and (more := source.more()):
            data += more
        head, found, have = data.partition(b"\r\n\r\n")
        if not head.startswith(b"WARC/") or not found:
            raise ValueError(f"no WARC record at byte {at}")
        fields = _fields(head)
        row = {c: fields.get(h.lower()) for h, c in HEADERS.items()} | {"position": at, "payload": None, "payload_length": None}
        size = _number(fields.get("content-length")) or 0
        if wanted(row):
            lead = 0
            if fields.get("content-type", "").lower().replace(" ", "").startswith("application/http"):
                while b"\r\n\r\n" not in have[:size] and len(have) < size and (more := source.more()):
                    have += more
                http, blank, _ = have[:size].partition(b"\r\n\r\n")
                lead = len(http) + len(blank)
                row["payload_length"] = _number(_fields(http).get("content-length"))
            if row["record_type"] != "revisit":
                row["payload_length"] = size - lead
                if payload:
                    row["payload"] = source.rest(have, size)[lead:size]
            yield row
        source.skip(len(head) + 4 + size + 4)


def first_record(file, start: int, end: int) -> int:
    """Where the first gzipped record at or after start begins; end if there is none before."""
    at = start
    while at < end:
        file.seek(at)
        data = file.read(min(1 << 20, end - at) + len(GZIP) - 1)
        place = data.find(GZIP)
        while 0 <= place < 1 << 20:
            if at + place >= end:
                return end
            file.seek(at + place)
            try:
                if _Member(file).more().startswith(b"WARC/"):
                    return at + place
            except (zlib.error, struct.error):
                pass
            place = data.find(GZIP, place + 1)
        at += 1 << 20
    return end


@dataclass
class Files(InputPartition):
    paths: list[tuple[str, int, int]]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.partition_bytes = int(options.get("partition_bytes", 64 << 20))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what headers and names of files decide; the rest stays with Spark."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            known = name == "source" or name in HEADERS.values()
            if known and isinstance(f, EqualTo):
                self.tests.append((name, "in", (f.value,)))
            elif known and isinstance(f, In):
                self.tests.append((name, "in", tuple(f.value)))
            elif known and isinstance(f, StringStartsWith):
                self.tests.append((name, "starts", f.value))
            elif known and isinstance(f, IsNotNull):
                self.tests.append((name, "there", None))
            else:
                yield f

    def wanted(self, row: dict) -> bool:
        for name, how, value in self.tests:
            if name not in row:
                continue
            own = row[name]
            if own is None or how == "in" and own not in value or how == "starts" and not own.startswith(value):
                return False
        return True

    def partitions(self) -> list[Files]:
        fs, path = store(self.path)
        found = fs.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))
        out: list[Files] = []
        room = self.partition_bytes
        for info in sorted((f for f in found if f.is_file and f.base_name.endswith((".warc", ".warc.gz")) and not f.base_name.startswith(("_", "."))), key=lambda f: f.path):
            if not self.wanted({"source": info.path}):
                continue
            # members of a gzipped file can be found from anywhere; records of a plain one follow by their lengths alone
            step = self.partition_bytes if info.base_name.endswith(".gz") else max(info.size, 1)
            for at in range(0, info.size, step):
                end = min(at + step, info.size)
                if room + end - at > self.partition_bytes:
                    out.append(Files([]))
                    room = 0
                out[-1].paths.append((info.path, at, end))
                room += end - at
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = store(self.path)
        rows: list[dict] = []
        size = 0
        for path, start, end in partition.paths:
            with fs.open_input_file(path) as file:
                for row in records(file, first_record(file, start, end) if start else 0, end, self.wanted, self.payload):
                    rows.append(row | {"source": path})
                    size += 500 + len(row["payload"] or b"")
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool = False):
        self.path = options["path"]
        self.level = int(options.get("level", 1))
        self.max_bytes = int(options.get("max_bytes", 1 << 30))
        self.overwrite = overwrite
        self.job = uuid.uuid4().hex[:12]  # names this job's files, as others may write here at the same time

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        fs, path = store(self.path)
        task = TaskContext.get()
        fs.create_dir(path, recursive=True)
        names: list[str] = []
        file = None
        for batch in iterator:
            for row in batch.to_pylist():
                if file is None:
                    names.append(f"part-{self.job}-{task.partitionId():06d}-{task.taskAttemptId()}-{len(names):04d}.warc{'.gz' if self.level else ''}")
                    file = fs.open_output_stream(f"{path}/_{names[-1]}", compression=None)
                record = record_bytes(row)
                file.write(gzipped(record, self.level) if self.level else record)
                if file.tell() >= self.max_bytes:
                    file.close()
                    file = None
        if file is not None:
            file.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = store(self.path)
        new = {name for message in messages if message for name in message.names}
        for name in sorted(new):
            fs.move(f"{path}/_{name}", f"{path}/{name}")
        for info in fs.get_file_info(pafs.FileSelector(path, recursive=self.overwrite, allow_not_found=True)):
            old = self.overwrite and info.is_file and info.base_name.endswith((".warc", ".warc.gz")) and not info.base_name.startswith(("_", ".")) and info.base_name not in new
            if old or info.base_name.startswith(f"_part-{self.job}-"):
                fs.delete_file(info.path)

    def abort(self, messages: list[Written | None]) -> None:
        fs, path = store(self.path)
        for info in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
            if info.base_name.startswith(f"_part-{self.job}-"):
                fs.delete_file(info.path)


class WarcDataSource(DataSource):
    """format("warc"); options: path, payload, partition_bytes; for writing path, level (0: plain), max_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def as_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """A record for each page; copies of a payload of at least min_bytes are revisits of the one with the largest id."""
    body = F.coalesce(F.encode(F.col(payload_col).cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("body"), row_salt(id_col).alias("salt"))
    rows = rows.select("*", F.octet_length("body").cast("long").alias("n"), F.sha1("body").alias("sha"), F.xxhash64("body").alias("x"))
    first = salted_group(rows.select("id", "sha", "x", "n", "salt"), ["sha", "x", "n"], [F.max("id").alias("first")])
    joined = rows.join(first, ["sha", "x", "n", "salt"])
    revisit = (F.col("n") >= min_bytes) & ~F.col("id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:x-row:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    return joined.select(
        name(F.col("id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A").alias("target_uri"),
        F.lit(date).alias("date"),
        F.when(revisit, name(F.col("first"))).alias("refers_to"),
        F.concat(F.lit("sha1:"), base32(F.col("sha"))).alias("payload_digest"),
        F.col("n").alias("payload_length"),
        F.when(~revisit, F.col("body")).alias("payload"),
    )


def base32(hexes):
    """Upper-case base32 of a digest of 40 hexadecimal digits."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    # 10 hexadecimal digits are 8 letters
    groups = [F.conv(F.substring(hexes, 1 + 10 * g, 10), 16, 10).cast("long") for g in range(4)]
    digit = lambda n, k: F.substring(F.lit(letters), 1 + F.shiftright(n, 35 - 5 * k).bitwiseAND(F.lit(31)).cast("int"), F.lit(1))
    return F.concat(*(digit(n, k) for n in groups for k in range(8)))


def write_archives(records: DataFrame, path: str, mode: str = "append", **options) -> None:
    register(records.sparkSession)
    records.write.format("warc").options(**options).mode(mode).save(path)


def read_archives(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(**options).load(path)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def op2_warc(spark, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark) + "/warc"
    write_archives(as_records(spark.read.parquet(f"{sf_dir}/pages.parquet")), path)
    row_id = lambda c: F.regexp_extract(c, r"<urn:x-row:(-?\d+)>", 1).try_cast("long")
    found = read_archives(spark, path)
    kept = F.col("record_type") == "response"
    return found.select(
        row_id("record_id").alias("page_id"),
        F.when(kept, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(kept, base32(F.sha1("payload"))).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type",
        row_id("refers_to").alias("refers_to"),
    )


OP2_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
     g AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS sha, max(page_id) OVER (PARTITION BY body) AS first FROM p),
     b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', substr(sha, i, 1))]), '') AS bits FROM g)
SELECT page_id, n AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda j: CASE WHEN substr(bits, 1 + 5 * k + j, 1) = '1' THEN 1 << (4 - j) ELSE 0 END))::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b
"""
