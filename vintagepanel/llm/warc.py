"""WARC archives as a Python data source of Spark, for reading and writing.

Files written here hold one gzip member per record. Each member carries its compressed
length in the 'sl' extra field, so a reader that is told by the headers that it does not
want a record goes to the next one without inflating the payload. Archives of other
writers are read too: gzip members without the field, several records in a member, plain
files. Files are read through buffers of bounded size. Reading plans whole files into
partitions of about equal size, parses WARC headers first, checks record type, id and address against the pushed
filters, and only then decodes the payload (or never, with option payload=false).

A writing task closes its file and reports its name; each commit lists the files of the
tasks that won in a manifest of its own, and readers read what all manifests list. Files of
lost or repeated attempts are so never read, and appending keeps what is there. A commit
that overwrites names the manifests and foreign archives it replaces: from then on these
are not read, whether or not they could be deleted. Archives of other writers, which no
manifest lists, are read as they stand.
"""

import json
import posixpath
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from vintagepanel.llm.common import salted_join, scratch_path, scratch_table

SCHEMA = "record_type string, record_id string, target_uri string, warc_date string, payload_digest string, refers_to string, page_id long, content_length long, payload binary"
_ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in SCHEMA.split(", "))])
#: Beginnings of the names of manifests and of the archives that they list.
MANIFEST, OWN = "_manifest-", "spark-"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEADER_OF = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "page_id": "X-Page-Id"}
#: Bytes of payload in a batch, of a file when it is closed for the next, and of files in a read partition at most and at least.
BATCH_BYTES, FILE_BYTES, PARTITION_BYTES, LEAST_BYTES = 8 << 20, 64 << 20, 64 << 20, 1 << 20
#: Bytes read at a time and inflated at a time.
READ_BYTES, PIECE_BYTES = 1 << 20, 1 << 15
#: Rows of revisited payloads that are broadcast; more are shuffled.
BROADCAST_ROWS = 200_000


_ESCAPED = {"%": "%25", "\r": "%0D", "\n": "%0A", " ": "%20", "\t": "%09"}
_UNESCAPED = {v: k for k, v in _ESCAPED.items()}
#: Marks records some of whose values are escaped; the values of other records are taken as they stand.
ESCAPES = "X-Escaped"


def _one_line(value: str) -> str:
    """Header values hold no line breaks and no blanks at their ends: these are written as %XX, and so is %."""
    body = value.strip(" \t")
    ends = value[: len(value) - len(value.lstrip(" \t"))], value[len(value.rstrip(" \t")) :] if body else ""
    return "".join(_ESCAPED[c] for c in ends[0]) + re.sub("[%\r\n]", lambda m: _ESCAPED[m[0]], body) + "".join(_ESCAPED[c] for c in ends[1])


def _plain(value: str) -> str:
    return re.sub("%(?:25|0D|0A|20|09)", lambda m: _UNESCAPED[m[0]], value)


def record(record_type: str, payload: bytes, headers: dict[str, str]) -> bytes:
    """One record as a gzip member. A revisit holds the HTTP head alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if record_type == "revisit" else http + payload
    written = {k: _one_line(v) for k, v in headers.items()}
    if any(_plain(v) != v for v in written.values()):
        written[ESCAPES] = "1"
    else:
        written = headers
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", *(f"{k}: {v}" for k, v in written.items()), "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    head = ("\r\n".join(lines) + "\r\n\r\n").encode()
    squeeze = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = squeeze.compress(head) + squeeze.compress(block) + squeeze.compress(b"\r\n\r\n") + squeeze.flush()
    whole = head + block + b"\r\n\r\n"
    extra = b"sl" + struct.pack("<HII", 8, len(body) + 32, len(whole) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04" + b"\0\0\0\0\x00\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(whole), len(whole) & 0xFFFFFFFF)


def _parse_head(text: bytes) -> dict[str, str]:
    found: dict[str, str] = {}
    last = ""
    for line in re.split("\r?\n", text.decode("utf-8", "replace"))[1:]:
        if line[:1] in (" ", "\t") and last:  # a value that goes on in the next line
            found[last] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            last = name.strip().lower()
            found[last] = value.strip()
    return {k: _plain(v) for k, v in found.items()} if ESCAPES.lower() in found else found


class _Archive:
    """The content of an archive, inflated where it is gzip (of any number of members, with any number of records each), from buffers of bounded size."""

    def __init__(self, f: pa.NativeFile):
        self.f = f
        self.block, self.begin, self.at = b"", 0, 0  # bytes read, where they begin in the file, the next of them
        self.out = bytearray()
        self.inflate = None
        self.member: int | None = None  # where the member begins whose first bytes are the next of out
        self.length = 0  # its length, if it says so
        head = self._peek(2)
        self.gzip = head == b"\x1f\x8b"

    def _peek(self, n: int) -> bytes:
        if len(self.block) - self.at < n:
            rest = self.block[self.at :]
            more = self.f.read(READ_BYTES)
            self.begin += self.at
            self.block, self.at = rest + more, 0
        return self.block[self.at : self.at + n]

    def _seek(self, to: int) -> None:
        if self.begin <= to <= self.begin + len(self.block):
            self.at = to - self.begin
        else:
            self.f.seek(to)
            self.block, self.begin, self.at = b"", to, 0
        self.out.clear()
        self.inflate = None

    def _member_length(self) -> int:
        """The length that the member ahead gives in its 'sl' field, or 0."""
        head = self._peek(12)
        if len(head) < 12 or not head[3] & 4:
            return 0
        extra = self._peek(12 + struct.unpack_from("<H", head, 10)[0])[12:]
        k = 0
        while k + 4 <= len(extra):
            name, n = extra[k : k + 2], struct.unpack_from("<H", extra, k + 2)[0]
            if name == b"sl" and n >= 4:
                return struct.unpack_from("<I", extra, k + 4)[0]
            k += 4 + n
        return 0

    def _more(self) -> bool:
        """Add some bytes to out; False at the end of the file."""
        piece = self._peek(PIECE_BYTES)
        if not piece:
            if self.inflate is not None:
                raise EOFError("an archive ends within a gzip member")
            return False
        if not self.gzip:
            self.out += piece
            self.at += len(piece)
            return True
        if self.inflate is None:
            self.inflate = zlib.decompressobj(31)
            if not self.out:
                self.member, self.length = self.begin + self.at, self._member_length()
                piece = self._peek(PIECE_BYTES)
            else:
                self.member = None
        data = self.inflate.decompress(piece, PIECE_BYTES)
        self.at += len(piece) - len(self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail)
        if self.inflate.eof:
            self.inflate = None
        self.out += data
        return True

    def head(self) -> bytes | None:
        """The head of the next record, without the empty line that ends it; None at the end."""
        self.member = None
        start = scanned = 0
        while True:
            while start < len(self.out) and self.out[start] in b"\r\n":  # what ends the record before
                start += 1
                scanned = start
            del self.out[:start]
            scanned -= start
            start = 0
            if not self.out and not self._more():
                return None
            if self.out[:1] in (b"\r", b"\n"):
                continue
            end = self.out.find(b"\r\n\r\n", max(0, scanned - 3))
            if end >= 0:
                found = bytes(self.out[:end])
                del self.out[: end + 4]
                return found
            scanned = len(self.out)
            if not self._more():
                raise ValueError("an archive holds a record without an end of its head")

    def block_of(self, n: int, keep: bool) -> bytes | None:
        """The next n bytes; if not to be kept, they are passed over, and not inflated where their member gives its length."""
        if not keep and self.gzip and self.member is not None and self.length:
            self._seek(self.member + self.length)
            return None
        if not keep and not self.gzip and n > len(self.out):
            self._seek(self.begin + self.at + n - len(self.out))
            return None
        parts: list[bytes] = []
        while n > 0:
            if not self.out and not self._more():
                raise EOFError("an archive ends within a record")
            take = min(n, len(self.out))
            if keep:
                parts.append(bytes(self.out[:take]))
            del self.out[:take]
            n -= take
        return b"".join(parts) if keep else None


def records(f: pa.NativeFile, wanted: Callable[[dict[str, str]], bool], payloads: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, payload) of the records of an archive, gzip or plain, whose headers pass wanted(); payload is None where not asked for.

    An archive that ends within a record, or holds a record whose head does not end, is an error.
    """
    archive = _Archive(f)
    while (head := archive.head()) is not None:
        headers = _parse_head(head)
        take = wanted(headers)
        block = archive.block_of(int(headers.get("content-length", 0)), take and payloads)
        if take and block is not None and "http" in headers.get("content-type", ""):
            block = block[block.find(b"\r\n\r\n") + 4 :] if b"\r\n\r\n" in block else b""
        if take:
            yield headers, block


def _manifests(fs: pafs.FileSystem, root: str, names: list[str]) -> dict[str, dict]:
    """The manifests among the names of a folder that no other replaces."""
    read = {}
    for name in names:
        if name.startswith(MANIFEST):
            with fs.open_input_stream(posixpath.join(root, name)) as f:
                read[name] = json.loads(f.read())
    gone = {r for m in read.values() for r in m["replaces"]}
    return {n: m for n, m in read.items() if n not in gone}


def _listed(fs: pafs.FileSystem, root: str, names: list[str]) -> list[str]:
    """The archives of a folder that are to be read: those of its manifests, and those of other writers."""
    manifests = _manifests(fs, root, names)
    gone = {r for m in manifests.values() for r in m["replaces"]}
    foreign = [n for n in names if ".warc" in n and not n.startswith((OWN, MANIFEST)) and n not in gone]
    return [*(f for m in manifests.values() for f in m["files"]), *foreign]


@dataclass
class Files(InputPartition):
    names: list[str]


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payloads = options.get("payload", "true").lower() == "true"
        self.partition_bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.least = int(options.get("partitions", 1))
        self.equal: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and membership on what headers hold; the rest stays with Spark."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column not in _HEADER_OF:
                yield f
                continue
            values = {str(v) for v in ([f.value] if isinstance(f, EqualTo) else f.value) if v is not None}
            header = _HEADER_OF[column].lower()
            self.equal[header] = self.equal.get(header, values) & values

    def partitions(self) -> list[InputPartition]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        found = {i.base_name: i.size for i in fs.get_file_info(pafs.FileSelector(root)) if i.is_file}
        names = [n for n in _listed(fs, root, list(found)) if n in found]
        # as many partitions as asked for, while they are not very small
        size = min(self.partition_bytes, max(LEAST_BYTES, sum(found[n] for n in names) // self.least))
        out: list[InputPartition] = []
        room = 0
        for name in sorted(names):
            if room <= 0:
                out.append(Files([]))
                room = size
            out[-1].names.append(name)
            room -= found[name]
        return out

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        """Spark passes no partition where there are no files."""
        fs, root = pafs.FileSystem.from_uri(self.path)
        wanted = lambda h: all(h.get(k) in values for k, values in self.equal.items())
        rows: list[tuple] = []
        size = 0
        for name in partition.names if partition else []:
            with fs.open_input_file(posixpath.join(root, name)) as f:
                for h, payload in records(f, wanted, self.payloads):
                    page = h.get("x-page-id")
                    rows.append((h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-payload-digest"), h.get("warc-refers-to"), int(page) if page else None, int(h.get("content-length", 0)), payload))
                    size += len(payload or b"") + 200
                    if size >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class WarcWriter(DataSourceArrowWriter):
    """Writes rows with the columns of SCHEMA; content_length is set by the writer."""

    def __init__(self, options: dict[str, str], overwrite: bool = False):
        self.path, self.overwrite = options["path"], overwrite
        self.file_bytes = int(options.get("fileBytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        names: list[str] = []
        out, size = None, 0
        for batch in iterator:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                row = {n: c[i].as_py() for n, c in columns.items()}
                headers = {h: str(row[c]) for c, h in _HEADER_OF.items() if c != "record_type" and row.get(c) is not None}
                if row["record_type"] == "revisit":
                    headers["WARC-Profile"] = PROFILE
                if out is None:
                    names.append(f"{OWN}{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(posixpath.join(root, names[-1]), compression=None), 0
                member = record(row["record_type"], row["payload"] or b"", headers)
                out.write(member)
                size += len(member)
                if size >= self.file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        there = [i.base_name for i in fs.get_file_info(pafs.FileSelector(root)) if i.is_file] if self.overwrite else []
        old = [n for n in there if n.startswith(MANIFEST)]
        replaced = [*old, *{*_listed(fs, root, there), *(n for n in there if ".warc" in n and not n.startswith(OWN))}]
        with fs.open_output_stream(posixpath.join(root, f"{MANIFEST}{uuid.uuid4().hex}"), compression=None) as f:
            f.write(json.dumps({"files": [n for m in messages if m for n in m.names], "replaces": replaced}).encode())
        # archives first: a manifest that is left without its files is not read either
        for name in [*(n for n in replaced if n not in old), *old]:
            if name in there:
                fs.delete_file(posixpath.join(root, name))

    def abort(self, messages: list[Written]) -> None:
        """Nothing is listed, so nothing is read."""


class WarcDataSource(DataSource):
    """spark.read.format("warc") and df.write.format("warc"), once registered."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of the archives (.warc.gz and .warc) of a folder, columns as in SCHEMA.

    Headers that a record lacks are null; a folder without archives gives no rows; empty
    files hold no records. Payloads are null for payload=False. Lengths in the 'sl' field
    let unwanted records be passed over; other archives are inflated through.
    """
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("partitions", 2 * spark.sparkContext.defaultParallelism).load(path)


def write_pages(pages: DataFrame, path: str, min_revisit_bytes: int = 100, date: str = "2024-01-01T00:00:00Z", broadcast_rows: int = BROADCAST_ROWS, mode: str = "append") -> None:
    """Write a record per row of pages (page_id, url, html) to the archives of a folder; mode: append or overwrite.

    Payload is the html in UTF-8 (null: empty). Of equal payloads of at least
    min_revisit_bytes, that of the smallest page_id is the response and the others are
    revisits of it; a null page_id is never smallest if there is another, and repeated
    rows of the smallest id are all responses. A null url has no address header. Other
    columns are not read.
    """
    spark = pages.sparkSession
    register(spark)
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("target_uri"), F.encode(F.coalesce(pages["html"], F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = rows.filter(F.octet_length("payload") >= min_revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    shared = scratch_table(large.filter("n > 1").select("digest", "first"), "shared-payloads")
    found = salted_join(rows, shared, "digest", shared.count(), broadcast_rows)
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    uri = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    out = found.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), uri(F.col("page_id")).alias("record_id"), "target_uri", F.lit(date).alias("warc_date"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"), F.when(revisit, uri(F.col("first"))).alias("refers_to"), "page_id", F.lit(0).cast("long").alias("content_length"), "payload",
    )
    out.write.format("warc").mode(mode).save(path)


def page_records(spark: SparkSession, path: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per record read back: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri.

    Size and digest are those of the full payload as decoded; a revisit has those of the
    response that it refers to, found by record id and digest. It has null ones where there
    is none. Records without an id have a null page_id, an absent address gives null, and
    an empty payload 0 bytes. Repeated records are rows each; of responses that repeat an id
    with the same payload one stands for all. A folder without archives gives no rows.
    """
    id_of = F.try_element_at(F.split(F.rtrim(F.col("refers_to"), F.lit(">")), ":"), F.lit(-1)).cast("long")
    responses = read_warc(spark, path).filter("record_type = 'response'").select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"), "target_uri")
    key = lambda page, digest: F.concat_ws(":", F.coalesce(page.cast("string"), F.lit("")), digest).alias("key")
    revisits = read_warc(spark, path, payload=False).filter("record_type = 'revisit'").select("page_id", "record_type", id_of.alias("refers_to"), "target_uri", key(id_of, F.regexp_replace("payload_digest", "^sha256:", "")))
    whole = scratch_table(responses, "responses")
    referred = scratch_table(revisits.select("key").distinct(), "referred")
    n = referred.count()
    targets = salted_join(whole.select(key(F.col("page_id"), F.col("payload_digest")), "payload_bytes", "payload_digest"), referred, "key", n, broadcast_rows, "inner").dropDuplicates(["key"])
    found = salted_join(revisits, targets, "key", n, broadcast_rows)
    return whole.unionByName(found.select(*whole.columns))


def op1(spark: SparkSession, pages: DataFrame) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_pages(pages, path)
    return page_records(spark, path)


ORACLE = """
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE octet_length(b) >= 100 GROUP BY payload_digest)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to, url AS target_uri
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""
