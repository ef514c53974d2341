"""Reading the bytes of one WARC archive, also a damaged one: every whole record, and the gaps between them.

A record counts if its version line, headers, length, end and digests are right, and if it is in a gzip member, if
that member is. After a failed check the reader looks for the next place where a member begins or a version line
stands and everything after it is right, goes on there, and reports what lies between as a gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

MAGIC = b"\x1f\x8b\x08"
BEGIN = re.compile(rb"\x1f\x8b\x08|WARC/\d+\.\d+\r\n")
VERSION = re.compile(rb"WARC/\d+\.\d+\r\n")
END = b"\r\n\r\n"
LONGEST_HEAD = 1 << 20
_CHUNK = 1 << 16


class Damaged(Exception):
    """A check failed; the message says which."""


class Record(NamedTuple):
    start: int             # in the file; of the member, where the record is in one
    end: int
    headers: dict[str, str]
    http: dict[str, str]   # empty unless the block is an HTTP message
    payload: bytes


class Gap(NamedTuple):
    start: int
    end: int
    reason: str


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _headers(text: bytes) -> dict[str, str]:
    found, name = {}, None
    for line in text.split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and name:
            found[name] += " " + line.strip().decode("utf-8", "replace")
            continue
        before, colon, value = line.partition(b":")
        if not colon or not before.strip():
            raise Damaged("bad header line")
        name = before.strip().decode("utf-8", "replace").lower()
        found[name] = value.strip().decode("utf-8", "replace")
    return found


def _check_digest(said: str | None, data: bytes, what: str) -> None:
    """Compares SHA-1 digests in base32 or hex; other kinds are taken as they are."""
    kind, _, value = (said or "").partition(":")
    if kind.lower() == "sha1" and value.upper() != base32_sha1(data) and value.lower() != hashlib.sha1(data).hexdigest():
        raise Damaged(f"wrong {what} digest")


def parse_record(data: bytes, at: int) -> tuple[Record, int]:
    """The record that begins at ``at`` and the place after it."""
    version = VERSION.match(data, at)
    if not version:
        raise Damaged("no version line")
    head_end = data.find(END, at, at + LONGEST_HEAD)
    if head_end < 0:
        raise Damaged("no end of headers")
    headers = _headers(data[version.end(): head_end])
    length = headers.get("content-length", "")
    if not length.isdecimal():
        raise Damaged("no length")
    begin = head_end + len(END)
    end = begin + int(length)
    if data[end: end + len(END)] != END:
        raise Damaged("record cut short" if end + len(END) > len(data) else "no end of record")
    block = data[begin:end]
    _check_digest(headers.get("warc-block-digest"), block, "block")
    http, payload = {}, block
    if headers.get("content-type", "").startswith("application/http"):
        first = block.partition(END)
        lines = first[0].partition(b"\r\n")[2]
        http, payload = (_headers(lines) if lines else {}), first[2]
    if headers.get("warc-type") != "revisit":
        _check_digest(headers.get("warc-payload-digest"), payload, "payload")
    return Record(at, end + len(END), headers, http, payload), end + len(END)


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """What the gzip member at ``at`` holds, the place after it, and what was wrong with it."""
    member, parts, place = zlib.decompressobj(31), [], at
    try:
        while not member.eof:
            chunk = data[place: place + _CHUNK]
            if not chunk:
                return b"".join(parts), place, "member cut short"
            parts.append(member.decompress(chunk))
            place += len(chunk)
    except zlib.error as error:
        return b"".join(parts), place, f"bad member: {error}"
    return b"".join(parts), place - len(member.unused_data), None


def _plain(data: bytes) -> Iterator[Record | Gap]:
    """Records that stand one after another in what a member holds, and gaps between them."""
    at, broken, why = 0, None, ""
    while at < len(data):
        try:
            record, after = parse_record(data, at)
        except Damaged as error:
            if broken is None:
                broken, why = at, str(error)
            following = VERSION.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if broken is not None:
            yield Gap(broken, at, why)
            broken = None
        yield record
        at = after
    if broken is not None:
        yield Gap(broken, len(data), why)


def _begun(data: bytes, at: int) -> tuple[list[Record], int, str | None]:
    """All records that begin at ``at``: the place after them, and what is wrong, if something is."""
    if not data.startswith(MAGIC, at):
        try:
            record, after = parse_record(data, at)
        except Damaged as error:
            return [], at, str(error)
        return [record], after, None
    text, after, wrong = _inflate(data, at)
    found = list(_plain(text))
    records = [x._replace(start=at, end=after) for x in found if isinstance(x, Record)]
    gaps = [x for x in found if isinstance(x, Gap)]
    return records, after, wrong or (gaps[0].reason if gaps else None if records else "member without a record")


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """Every record of an archive in order, and the gaps. Zero bytes behind a record are padding.

    A member that is damaged, or holds damage, is a gap whole; records in it that are right are given all the same,
    and not once more where a member holds its text as it is.
    """
    at, broken, why, given, until = 0, None, "", [], 0
    while at < len(data):
        records, after, wrong = _begun(data, at)
        if wrong is None and at < until and any(x[2:] == records[0][2:] for x in given):
            at = after
            continue
        if wrong is None:
            if broken is not None:
                yield Gap(broken, at, why)
                broken = None
            yield from records
            at = after
            while data[at: at + 1] == b"\0":
                at += 1
            continue
        if broken is None:
            broken, why = at, wrong
        yield from records
        if records:
            given, until = records, after
        intact_member = data.startswith(MAGIC, at) and not wrong.startswith(("bad member", "member cut"))
        following = None if intact_member else BEGIN.search(data, at + 1)
        at = after if intact_member else following.start() if following else len(data)
    if broken is not None:
        yield Gap(broken, len(data), why)
