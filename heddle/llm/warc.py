"""WARC archives: a writer with revisit records, and a salvage reader.

The reader walks gzip members (or bare records) of an archive. When a member doesn't inflate, its
version line or length doesn't hold, or its payload doesn't match its digest, the reader searches for
the next member or version line that is valid, goes on from there, and logs the bytes between as a
quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import bounded_batches, looked_up, materialise, working_path

#: An archive is closed once it holds so many bytes, the size that archives commonly have; readers stream it.
ARCHIVE_BYTES = 1 << 30
#: What a reader holds of an archive beside one record, and what a reading task gets at least if there are many archives.
READ_BYTES, TASK_BYTES = 1 << 20, 128 << 20
#: The registered query tears the records of pages whose ids this divides, and so reads damaged archives.
TORN_EVERY = 50
LEVEL = 6
_GZIP = b"\x1f\x8b\x08"
_VERSION = b"WARC/1."
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(s: str | None) -> str:
    """A header value on one line of ASCII."""
    return "".join(c if "\x20" < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in s or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, size: int | None = None) -> bytes:
    """One WARC record: response with its payload, or revisit without, whose HTTP headers may tell the payload's size."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % (len(payload) if size is None else size)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {_clean(url)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <urn:x-page:{'' if refers_to is None else refers_to}>"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = LEVEL) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def payload_of(headers: dict, block: bytes) -> bytes:
    """The payload of a record's block: what follows the HTTP headers, or, of other content, the block."""
    return block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block


def _headers(lines: list[bytes]) -> dict | None:
    """Names, in lower case, and values; None if the version line or a line's form doesn't hold."""
    if not re.fullmatch(rb"WARC/1\.[0-9]", lines[0]) or any(b":" not in x for x in lines[1:]):
        return None
    pairs = (x.decode("latin-1").split(":", 1) for x in lines[1:])
    return {name.strip().lower(): value.strip() for name, value in pairs}


def _length(headers: dict) -> int | None:
    """The declared length of the block; None if there is none."""
    n = headers.get("content-length", "")
    return int(n) if re.fullmatch("[0-9]{1,18}", n, re.ASCII) else None


def _sound(headers: dict, block: bytes) -> bool:
    """If the payload matches its declared SHA-1, where the record has both."""
    declared = headers.get("warc-payload-digest", "")
    return headers.get("warc-type") != "response" or not declared.startswith("sha1:") or payload_digest(payload_of(headers, block)) == declared[5:]


def parse_record(data: bytes) -> tuple[dict, bytes] | None:
    """(headers, block) of the one record that is `data`; None if its checks fail."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    if not blank or (headers := _headers(head.split(b"\r\n"))) is None or (n := _length(headers)) is None:
        return None
    block = rest[:n]
    return (headers, block) if rest[n:] == b"\r\n\r\n" and len(block) == n and _sound(headers, block) else None


class _Archive:
    """Bytes of a seekable file by position, of which a part is held."""

    def __init__(self, file, size: int):
        self.file, self.size, self.start, self.held = file, size, 0, b""

    def read(self, at: int, n: int) -> bytes:
        """`n` bytes from `at`; fewer at the end."""
        n = max(0, min(n, self.size - at))
        if not self.start <= at <= at + n <= self.start + len(self.held):
            self.file.seek(at)
            self.start, self.held = at, self.file.read(max(n, min(READ_BYTES, self.size - at)))
        return self.held[at - self.start : at - self.start + n]

    def find(self, at: int) -> int:
        """Where, from `at` on, a member or a version line may start; the archive's end if nowhere."""
        while at < self.size:
            if m := _START.search(self.read(at, READ_BYTES)):
                return at + m.start()
            at = at + READ_BYTES - len(_VERSION) + 1 if at + READ_BYTES < self.size else self.size
        return self.size

    def member(self, at: int) -> tuple[dict, bytes, int] | None:
        """The record of the gzip member at `at`, and where the member ends. It is fed by growing steps, so that what is read twice stays in proportion."""
        z, out, head, end, step = zlib.decompressobj(31), [], b"", at, 4096
        try:
            while not z.eof:
                if not (data := self.read(end, step)):
                    return None
                out.append(z.decompress(data))
                head = (head + out[-1])[: len(_VERSION)]
                if not _VERSION.startswith(head):
                    return None
                end += len(data)
                step = min(2 * step, READ_BYTES)
        except zlib.error:
            return None
        got = parse_record(b"".join(out))
        return None if got is None else (*got, end - len(z.unused_data))

    def bare(self, at: int) -> tuple[dict, bytes, int] | None:
        """The record whose version line is at `at`, and its end. Its headers are read only as far as their lines hold, its block only if it ends as a block does."""
        n = 4096
        while (end := (data := self.read(at, n)).find(b"\r\n\r\n")) < 0:
            lines = data.split(b"\r\n")[:-1]
            if len(data) < n or not lines or _headers(lines) is None:
                return None
            n *= 2
        headers = _headers(data[:end].split(b"\r\n"))
        if headers is None or (size := _length(headers)) is None:
            return None
        start = at + end + 4
        if self.read(start + size, 4) != b"\r\n\r\n":
            return None
        block = self.read(start, size)
        return (headers, block, start + size + 4) if _sound(headers, block) else None


def salvage(file, size: int) -> Iterator[tuple[str, int, int, dict, bytes]]:
    """("record", start, end, headers, block) of each valid record of an archive of `size` bytes, ("gap", start, end, {}, b"") of bytes between.

    Members and bare records may alternate. An empty archive yields nothing; one without a valid
    record yields one gap. One record and a few MB are held at a time, and time is linear in the archive.
    """
    archive = _Archive(file, size)
    at, gap = 0, None
    while at < size:
        head, got = archive.read(at, len(_VERSION)), None
        if head.startswith(_GZIP):
            got = archive.member(at)
        elif head == _VERSION:
            got = archive.bare(at)
        if got is None:
            gap = at if gap is None else gap
            at = archive.find(at + 1)
            continue
        if gap is not None:
            yield "gap", gap, at, {}, b""
            gap = None
        yield "record", at, got[2], got[0], got[1]
        at = got[2]
    if gap is not None:
        yield "gap", gap, size, {}, b""


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, torn_every: int = 0) -> DataFrame:
    """Write a record for every row (page_id, url, payload, size, digest, revisit, refers_to) to archives below `path`; return (archive, records, bytes).

    An archive appears under its name only when whole (written aside, then moved), and its name comes
    from the task attempt. A task that is run again may leave whole archives of its earlier attempt
    beside its own, so readers take only the archives of the result, once stored. `path` is a URI that
    pyarrow's file systems know, shared by all executors. Members go to the file as they are made.
    `torn_every` rehearses a crawler that dies and starts again: the record of every page whose id it
    divides is first written by half.
    """
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        name, made, out = f"part-{task.partitionId():06d}-{task.taskAttemptId()}", [], None

        def close() -> None:
            nonlocal out
            out.close()
            store.move(f"{base}/{made[-1][0]}.open", f"{base}/{made[-1][0]}")
            out = None

        for b in batches:
            for row in zip(*(b.column(i) for i in range(b.num_columns)), strict=True):
                page_id, url, payload, n, digest, revisit, refers_to = (x.as_py() for x in row)
                member = gzip_member(record(page_id, url, payload or b"", digest, refers_to, revisit, n))
                if torn_every and page_id is not None and page_id % torn_every == 0:
                    member = member[: len(member) // 2] + member
                if out is None:
                    made.append([f"{name}-{len(made):05d}.warc.gz", 0, 0])
                    out = store.open_output_stream(f"{base}/{made[-1][0]}.open", compression=None)
                out.write(member)
                made[-1][1] += 1
                made[-1][2] += len(member)
                if made[-1][2] >= archive_bytes:
                    close()
        if out is not None:
            close()
        rows = [(f"{path.rstrip('/')}/{at}", n, held) for at, n, held in made]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True) if rows else [[]] * 3, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["archive", "records", "bytes"])

    return pages.select("page_id", "url", "payload", "size", "digest", "revisit", "refers_to").mapInArrow(run, "archive string, records long, bytes long")


RECORDS = "archive string, kind string, start long, end long, after_gap boolean, headers map<string,string>, payload_digest string, payload_bytes long, block binary"


def find_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, bytes) of the files *.warc and *.warc.gz in `path`; their content isn't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc,warc.gz}").load(path).select(F.col("path").alias("archive"), F.col("length").alias("bytes"))


def read_archives(archives: DataFrame, blocks: bool = True) -> DataFrame:
    """Every record and gap of `archives` (archive: URI): archive, kind, start, end, after_gap, headers, payload_digest, payload_bytes, block.

    Digest and size are those of the payload that was read; a revisit has no payload, so its size is
    null and its digest the declared one. `after_gap`: bytes right before the record are quarantined
    (a gap row tells which). Without `blocks` the block is null. Tasks get paths and stream the files.
    """
    bounded_batches(archives.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        names = ["archive", "kind", "start", "end", "after_gap", "headers", "payload_digest", "payload_bytes", "block"]
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.map_(pa.string(), pa.string()), pa.string(), pa.int64(), pa.binary()]
        rows, held = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal rows, held
            out, rows, held = rows, [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        for where in (x for b in batches for x in b.column(0).to_pylist()):
            store, at = fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", where))
            after = False
            with store.open_input_file(at) as f:
                for kind, start, end, headers, block in salvage(f, f.size()):
                    digest = n = None
                    if headers.get("warc-type") == "revisit":
                        digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    elif kind == "record":
                        payload = payload_of(headers, block)
                        digest, n = payload_digest(payload), len(payload)
                    rows.append((where, kind, start, end, after and kind == "record", list(headers.items()), digest, n, block if blocks and kind == "record" else None))
                    after = kind == "gap"
                    held += 500 + (len(block) if blocks else 0)
                    if held >= 1 << 20:
                        yield flush()
        if rows:
            yield flush()

    return archives.select("archive").mapInArrow(run, RECORDS)


def archive_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", torn_every: int = 0) -> DataFrame:
    """Write `pages` to archives below `path`; of equal payloads the largest page_id is the response. Returns the archives.

    Which pages are revisits is found on ids and digests alone. Pages are then looked up by both, a key
    that only repeated rows share; payloads move only if the revisits are too many to broadcast.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha1"))
    digests = materialise(rows.select(F.col("page_id").alias("__id"), F.col("sha1").alias("__sha1")), "warc-digests")
    last = digests.groupBy(F.col("__sha1").alias("__of")).agg(F.max("__id").alias("__last"))
    revisits = digests.join(last, F.col("__sha1") == F.col("__of")).where(~F.col("__id").eqNullSafe(F.col("__last")))
    revisits = materialise(revisits.select("__id", "__sha1", "__last").distinct(), "warc-revisits")
    told = looked_up(rows, revisits, {"page_id": "__id", "sha1": "__sha1"}, salts=1).withColumn("revisit", F.col("__sha1").isNotNull())
    return write_archives(told.select("page_id", "url", F.when(~F.col("revisit"), F.col("payload")).alias("payload"), F.octet_length("payload").alias("size"), base32(F.col("sha1")).alias("digest"), "revisit", F.col("__last").alias("refers_to")), path, torn_every=torn_every)


def base32(hex_):
    """Upper-case base 32 of 40 hex digits: each 5 digits, 20 bits, are 4 letters."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    out = []
    for i in range(8):
        n = F.conv(F.substring(hex_, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(alphabet), F.shiftright(n, 15 - 5 * k).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for k in range(4)]
    return F.concat(*out)


def archived(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", torn_every: int = 0) -> DataFrame:
    """Write `pages` and read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to, after_gap.

    Sizes and digests are those of what was read; a revisit's size is that of the response of its
    digest. A null html has an empty payload, a null or odd url is written as far as a header can hold
    it; a null page_id is never the response unless its whole group is null; repeated rows of the
    response give repeated responses; an empty table gives an empty result; other columns are ignored.
    """
    spark = pages.sparkSession
    path = path or working_path(spark, "warc")
    written = materialise(archive_pages(pages, path, id_col, url_col, html_col, torn_every), "warc-archives")
    n, held = written.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    tasks = max(1, min(n, max(spark.sparkContext.defaultParallelism, (held or 0) // TASK_BYTES)))
    h = F.col("headers")
    number = lambda name: F.regexp_extract(h[name], "urn:x-page:(-?[0-9]+)", 1).try_cast("long")
    read = read_archives(written.repartition(tasks), blocks=False)
    read = read.select("archive", "kind", "start", "end", "after_gap", number("warc-record-id").alias("page_id"), "payload_bytes", "payload_digest", h["warc-type"].alias("record_type"), number("warc-refers-to").alias("refers_to"))
    read = materialise(read, "warc-records").where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "after_gap")
    sizes = read.where("record_type = 'response'").groupBy(F.col("payload_digest").alias("__of")).agg(F.max("payload_bytes").alias("__bytes"))
    revisits = read.where("record_type = 'revisit'").join(sizes, F.col("payload_digest") == F.col("__of"), "left")
    return read.where("record_type = 'response'").unionByName(revisits.withColumn("payload_bytes", F.col("__bytes")).select(*read.columns))


SQL = """
WITH digests AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), lasts AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM digests
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, 1 + 5 * (k // 4)::INT, 5))::INT >> (15 - 5 * (k % 4))::INT) & 31), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to, page_id % 50 = 0 AS after_gap
FROM lasts
"""


def op6_warc_salvage(spark, sf_dir):
    return archived(spark.read.parquet(f"{sf_dir}/pages.parquet"), torn_every=TORN_EVERY)
