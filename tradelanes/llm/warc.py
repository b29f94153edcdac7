"""Web archives: written as gzip members, read back by byte ranges."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelanes.llm.common import arrow, shared_address
from tradelanes.session import materialise, scratch_folder

#: Payloads below this size are never written as revisits.
LEAST_SHARED = 100
_MAGIC = b"\x1f\x8b\x08"
_READ = 1 << 20
#: Bytes of a member that are unpacked in one go.
_PIECE = 1 << 16
_FLUSH = 8 << 20
#: Archive bytes that a task reads where there are more than four tasks a core.
_TASK = 256 << 20
#: Copies of a repeated row that one step writes.
_COPIES = 4096
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"


def record(
    page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False, digest: str | None = None, size: int | None = None
) -> bytes:
    """One record as a gzip member of its own. A revisit has the digest and the size of its payload, not the payload.

    Given ``digest`` and ``size``, a revisit is written without its payload at hand.
    """
    digest = hashlib.sha256(payload).hexdigest() if digest is None else digest
    block = _HTTP.format(size=len(payload) if size is None else size).encode() + (b"" if revisit else payload)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        fields.append(("WARC-Record-ID", f"<urn:page:{page_id}>"))
    if revisit:
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        if refers_to is not None:
            fields.append(("WARC-Refers-To", f"<urn:page:{refers_to}>"))
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields) + "\r\n"
    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
    return pack.compress(head.encode()) + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def planned(pages: DataFrame) -> DataFrame:
    """Every page with its record's type and the page it refers to.

    Of pages with equal payloads the one with the smallest identifier, of
    these the one with the smallest address, is the response. Rows that repeat
    page, address and payload are told apart by number: the first is it.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("_digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("_size", F.octet_length("html"))
    # one key that is never missing; a missing address adds no part, an empty one an empty part
    rows = rows.withColumn(
        "_key",
        F.sha2(
            F.concat_ws("/", F.coalesce(F.col("page_id").cast("string"), F.lit("none")), "_digest", F.hex("url")), 256
        ),
    )
    own = ["page_id", "url", "_digest", "_size"]
    least = F.when(F.col("_size") < LEAST_SHARED, F.col("html"))
    members = materialise(
        rows.groupBy("_key", *own).agg(F.count(F.lit(1)).alias("_rows"), F.min(least).alias("_small"))
    )
    rank = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("url").isNull().alias("blank"), "url")
    first = (
        members.where(F.col("_size") >= LEAST_SHARED)
        .groupBy("_digest")
        .agg(F.min(rank).alias("_first"), F.sum("_rows").alias("_group"))
        .where("_group > 1")
    )
    noted = members.join(first, "_digest", "left").select(
        "_key",
        *own,
        "_rows",
        "_small",
        F.col("_first.page_id").alias("_to"),
        (F.col("_first").isNotNull() & ~rank.eqNullSafe(F.col("_first"))).alias("_revisit"),
        F.col("_first").isNotNull().alias("_shared"),
    )
    # texts move once, those of repeated rows as one
    texts = rows.groupBy("_key").agg(F.first("html").alias("html"))
    once = texts.join(noted, "_key").select(*own, "html", "_to", "_revisit")
    # further copies need no text but a short one; they are dealt in blocks, so no task makes them all
    again = (
        noted.where("_rows > 1")
        .withColumn("_from", F.explode(F.sequence(F.lit(2).cast("long"), F.col("_rows"), F.lit(_COPIES).cast("long"))))
        .repartition("_key", "_from")
        .withColumn("_copy", F.explode(F.sequence("_from", F.least(F.col("_from") + (_COPIES - 1), F.col("_rows")))))
        .select(*own, F.col("_small").alias("html"), "_to", F.col("_shared").alias("_revisit"))
    )
    return once.unionByName(again)


_FILE = "path string, size long, records long"


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes one archive per task below ``folder`` and returns ``path``, ``size`` and number of ``records`` of each.

    A task's name for its file has the attempt in it, so a task that runs
    twice leaves a file that nothing reads.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        size, many = 0, 0
        with store.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in batches:
                for row in batch.to_pylist():
                    payload = (row["html"] or "").encode()
                    data = record(row["page_id"], row["url"], payload, row["_to"], row["_revisit"], row["_digest"], row["_size"])
                    out.write(data)
                    size += len(data)
                    many += 1
        yield arrow(_FILE, {"path": [f"{folder}/{name}"], "size": [size], "records": [many]})

    return materialise(planned(pages).mapInArrow(work, _FILE))


class _Range:
    """Bytes of a file from a position on, read as they are asked for."""

    def __init__(self, file, at: int):
        self.file, self.at, self.data = file, at, bytearray()

    def more(self) -> bool:
        self.file.seek(self.at + len(self.data))
        got = self.file.read(_READ)
        self.data += got
        return bool(got)

    def skip(self, n: int) -> None:
        self.at += n
        del self.data[:n]


def _is_member(span: _Range, offset: int) -> bool:
    """Whether a member that starts there decodes to the beginning of a record, however long its header is."""
    unpack, head, at = zlib.decompressobj(31), bytearray(), offset
    while not unpack.eof:
        if at >= len(span.data) and not span.more():
            break
        seen = max(0, len(head) - 3)
        try:
            head += unpack.decompress(span.data[at : at + 4096])
        except zlib.error:
            return False
        at += 4096
        if not b"WARC/1.".startswith(head[:7]):
            return False
        if head.find(b"\r\n\r\n", seen) >= 0:
            break
    return head.startswith(b"WARC/1.") and b"\r\n\r\n" in head and b"\r\nWARC-Type:" in head


def members(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Offset and content of every gzip member that begins in [``start``, ``end``).

    The first is sought by the magic number and confirmed by decoding its
    header; each further one begins where the one before ends. A member that
    begins before ``end`` is read beyond it.
    """
    span = _Range(file, start)
    chained = False
    while span.at < end:
        while len(span.data) < len(_MAGIC) and span.more():
            pass
        if not (chained and span.data.startswith(_MAGIC)):
            at = span.data.find(_MAGIC)
            if at < 0:
                span.skip(max(0, len(span.data) - len(_MAGIC) + 1))
                if not span.more():
                    return
                continue
            span.skip(at)
            if span.at >= end:
                return
            if not _is_member(span, 0):
                span.skip(1)
                continue
        unpack, content = zlib.decompressobj(31), []
        offset, used = span.at, 0
        while not unpack.eof:
            if used >= len(span.data) and not span.more():
                raise EOFError(f"the member at {offset} is cut off")
            piece = span.data[used : used + _PIECE]
            content.append(unpack.decompress(piece))
            used += len(piece)
        span.skip(used - len(unpack.unused_data))
        chained = True
        yield offset, b"".join(content)


def parsed(content: bytes) -> dict:
    """Fields of a record, and its payload without the HTTP header."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page = re.fullmatch(r"<urn:page:(-?\d+)>", fields.get("WARC-Record-ID", ""))
    to = re.fullmatch(r"<urn:page:(-?\d+)>", fields.get("WARC-Refers-To", ""))
    return {
        "page_id": int(page[1]) if page else None,
        "url": fields["WARC-Target-URI"],
        "record_type": fields["WARC-Type"],
        "refers_to": int(to[1]) if to else None,
        "digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"),
        "full_size": int(re.search(rb"Content-Length: (\d+)", http)[1]),
        "payload": payload,
    }


_RECORD = "path string, at long, page_id long, url string, record_type string, refers_to long, digest string, full_size long, payload binary"


def read_archives(spark: SparkSession, files: DataFrame, split: int = 4 << 20) -> DataFrame:
    """Records of all ``files`` (``path``, ``size``), whose byte ranges of ``split`` bytes are read independently."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in _RECORD.split(",")]
        for batch in batches:
            for part in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(part["path"])
                rows, held = [], 0
                with store.open_input_file(path) as file:
                    for offset, content in members(file, part["begin"], part["end"]):
                        rows.append({"path": part["path"], "at": offset, **parsed(content)})
                        held += len(content)
                        if held >= _FLUSH:
                            yield arrow(_RECORD, {n: [r[n] for r in rows] for n in names})
                            rows, held = [], 0
                if rows:
                    yield arrow(_RECORD, {n: [r[n] for r in rows] for n in names})

    whole = files.where("size > 0").agg(
        F.sum(F.ceil(F.col("size") / split)).alias("ranges"), F.sum("size").alias("bytes")
    ).first()
    # ranges are a few bytes each, so tasks are counted by what lies behind them
    tasks = max(4 * spark.sparkContext.defaultParallelism, (whole["bytes"] or 0) // _TASK)
    ranges = (
        files.where("size > 0")
        .withColumn("begin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))))
        .withColumn("end", F.least(F.col("begin") + split, F.col("size")))
        .repartition(int(max(1, min(tasks, whole["ranges"] or 1))), "path", "begin")
    )
    return ranges.mapInArrow(work, _RECORD)


def archived_pages(pages: DataFrame, split: int = 4 << 20) -> DataFrame:
    """Writes all pages to archives and returns what reading them gives: one row per page.

    Defined cases: a missing page text is empty, a missing address too; pages
    without identifier come last and refer to nothing by it; repeated rows are
    records of their own. An empty table gives no rows. Other columns aren't
    read. Bytes and digest of a response are those of the payload read, those
    of a revisit stand in its header. Another number of records read than
    written is an error.
    """
    spark = pages.sparkSession
    folder = shared_address(spark, scratch_folder(spark, "warc"))
    files = write_archives(pages, folder)
    records = read_archives(spark, files, split)
    response = F.col("record_type") == "response"
    found = records.select(
        "page_id",
        F.when(response, F.octet_length("payload")).otherwise(F.col("full_size")).cast("long").alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
    found = materialise(found)
    read, written = found.count(), files.agg(F.sum("records")).first()[0] or 0
    if read != written:
        raise RuntimeError(f"{written} records were written to the archives and {read} read from them")
    return found
