"""Tables of pages as WARC archives, with equal payloads stored once, and archives as tables again.

Writing: only digests are shuffled to find equal payloads. The page with the largest id keeps the payload in a response
record, the others become revisit records that name it. Every task packs its records as gzip members into archives
of bounded size, and Spark's own writer puts each of them into a file: a task that is run again leaves no halves.

Reading: a file is one row of Spark's binary source. Damage costs only the records it lies in (``warc_salvage``).
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tugboard.llm import warc_salvage
from tugboard.llm.shared import stored

# Marks of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAME = "urn:page:"
PRINTABLE = "".join(map(chr, range(0x21, 0x7F)))


@dataclass(frozen=True)
class WarcRule:
    archive_bytes: int = 4 << 20         # an archive ends with the record that reaches this size
    gzip_level: int = 3
    least_revisit_bytes: int = 0         # equal payloads shorter than this are all stored
    date: str = "1970-01-01T00:00:00Z"   # of every record, as pages carry no time
    broadcast_rows: int = 200_000        # more repeated payloads than this are joined by a shuffle
    salts: int = 16                      # tasks that the pages of one payload are dealt to in that shuffle


def _name(page: object) -> str:
    return f"<{NAME}{'null' if page is None else quote(str(page), safe='')}>"


def _lines(*pairs: tuple[str, str]) -> bytes:
    return "".join(f"{name}: {value}\r\n" for name, value in pairs).encode()


def packed_record(page: object, owner: object, is_revisit: bool, url: str | None, payload: bytes, sha1: bytes, rule: WarcRule) -> bytes:
    """One gzip member that holds the page's record."""
    digest = base64.b32encode(sha1).decode()
    block = b"HTTP/1.1 200 OK\r\n" + _lines(("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))) + b"\r\n"
    kind = [("WARC-Type", "response")]
    if is_revisit:
        kind = [("WARC-Type", "revisit"), ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _name(owner))]
    else:
        block += payload
    if url is not None:
        kind.append(("WARC-Target-URI", quote(url, safe=PRINTABLE)))
    head = _lines(
        *kind, ("WARC-Record-ID", _name(page)), ("WARC-Date", rule.date), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{warc_salvage.base32_sha1(block)}"), ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    )
    member = zlib.compressobj(rule.gzip_level, zlib.DEFLATED, 31)
    return member.compress(f"{VERSION}\r\n".encode() + head + b"\r\n" + block + warc_salvage.END) + member.flush()


def _with_owners(pages: DataFrame, id: str, payload: str, rule: WarcRule) -> DataFrame:
    """``pages`` with ``sha1`` and, where several have it, ``owner``: the largest id of the payload."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    named = pages.withColumn("sha1", F.unhex(F.sha1(body)))
    long_enough = F.octet_length(body) >= rule.least_revisit_bytes
    repeated = stored(
        named.where(long_enough).groupBy("sha1").agg(F.max(id).alias("owner"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select(F.col("sha1").alias("of"), "owner")
    )
    if repeated.count() <= rule.broadcast_rows:
        return named.join(F.broadcast(repeated), F.col("sha1") == F.col("of"), "left")
    dealt = repeated.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(rule.salts - 1))))
    salt = F.pmod(F.xxhash64(id), F.lit(rule.salts)).cast("int")
    return named.withColumn("salt", salt).join(dealt, (F.col("sha1") == F.col("of")) & (F.col("salt") == F.col("to")), "left")


def write_archives(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", payload: str = "html", rule: WarcRule = WarcRule()) -> None:
    """Writes a record per row of ``pages`` into archives below ``folder``, which must not exist.

    Null payloads are empty, null urls are left out, blanks and signs beyond ASCII in urls are escaped. Of rows that share
    payload and largest id each is a response; null ids come before all others, and are responses where a payload has no
    other. A table without rows gives an empty folder, other columns are not looked at, a long payload makes an archive
    of its own length.
    """
    needed = pages.select(F.col(id).alias("page"), F.col(url).cast("string").alias("url"), F.col(payload).alias("payload"))
    owned = _with_owners(needed, "page", "payload", rule)
    revisit = F.col("of").isNotNull() & ~F.col("page").eqNullSafe(F.col("owner"))
    rows = owned.select("page", "owner", revisit.alias("revisit"), "url", F.coalesce(F.col("payload").cast("binary"), F.lit(b"")).alias("payload"), "sha1")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def archive(members: list[bytes]) -> pa.RecordBatch:
            # The writer ends each file with a zero byte: mostly the last byte of the last member, else padding.
            return pa.RecordBatch.from_arrays([pa.array([b"".join(members).removesuffix(b"\0")], pa.binary())], ["archive"])

        members, size = [], 0
        for batch in batches:
            columns = [batch[c] for c in ("page", "owner", "revisit", "url", "payload", "sha1")]
            for k in range(batch.num_rows):
                members.append(packed_record(*[column[k].as_py() for column in columns], rule))
                size += len(members[-1])
                if size >= rule.archive_bytes:
                    yield archive(members)
                    members, size = [], 0
        if members:
            yield archive(members)

    archives = rows.mapInArrow(pack, "archive binary").select(F.col("archive").cast("string").alias("value"))
    archives.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(folder)


_FIELDS = {
    "file": "string", "begin": "bigint", "end": "bigint", "gap": "string", "record_type": "string", "record_id": "string", "refers_to": "string",
    "target_uri": "string", "date": "string", "payload_digest": "string", "payload_bytes": "bigint",
}


def _named(uri: str | None) -> str | None:
    text = (uri or "").removeprefix("<").removesuffix(">")
    return unquote(text.removeprefix(NAME)) if text.startswith(NAME) else text or None


def _row(path: str, found: warc_salvage.Record | warc_salvage.Gap) -> tuple:
    if isinstance(found, warc_salvage.Gap):
        return (path, found.start, found.end, found.reason, *[None] * 7)
    get = found.headers.get
    length = found.http.get("content-length") if get("warc-type") == "revisit" else str(len(found.payload))
    return (
        path, found.start, found.end, None, get("warc-type"), _named(get("warc-record-id")), _named(get("warc-refers-to")),
        get("warc-target-uri"), get("warc-date"), (get("warc-payload-digest") or "").rpartition(":")[2] or None,
        int(length) if length and length.isdecimal() else None,
    )


def read_archives(spark: SparkSession, folder: str, with_payloads: bool = False) -> DataFrame:
    """A row per record, and one per gap with the reason in ``gap``: file and bytes from ``begin`` to ``end``.

    Payloads are left out unless asked for; a revisit's length is the one its HTTP headers state. Archives may be gzip
    members or plain, of any writer; each file is one row of Spark's binary source and must fit in a task.
    """
    kinds = _FIELDS | ({"payload": "binary"} if with_payloads else {})
    types = [{"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[kind] for kind in kinds.values()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                path = batch["path"][k].as_py()
                rows, size = [], 0
                for found in warc_salvage.salvage(batch["content"][k].as_py()):
                    row = _row(path, found)
                    if with_payloads:
                        row = (*row, found.payload if isinstance(found, warc_salvage.Record) else None)
                        size += len(row[-1] or b"")
                    rows.append(row)
                    if len(rows) == 10_000 or size > 1 << 25:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], list(kinds))
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], list(kinds))

    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(read, ", ".join(f"`{name}` {kind}" for name, kind in kinds.items()))
