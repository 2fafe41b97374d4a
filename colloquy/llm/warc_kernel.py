"""WARC records as bytes: writing with segments and chunked framing, reading, and reassembly."""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from urllib.parse import quote, unquote

CRLF, END = b"\r\n", b"\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive that breaks the format, or whose records do not add up."""


def chunked(payload: bytes, size: int) -> bytes:
    """payload in HTTP/1.1 chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        parts += [b"%x" % len(piece), CRLF, piece, CRLF]
    return b"".join([*parts, b"0", END])


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        stop = body.find(CRLF, at)
        if stop < 0:
            raise WarcError("chunk size missing")
        try:
            n = int(body[at:stop].split(b";")[0], 16)
        except ValueError:
            raise WarcError("chunk size unreadable") from None
        at = stop + 2
        if not n:
            return b"".join(out)
        if body[at + n : at + n + 2] != CRLF:
            raise WarcError("chunk does not end where its size says")
        out.append(body[at : at + n])
        at += n + 2


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without its closing blank lines, which the file writer puts after each."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block


def _clean(url: str | None) -> str | None:
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def records(row: tuple, job: str, apart: str, segment_bytes: int, chunk_bytes: int):
    """The records of one page: (page_id, url, html, digest, bytes, alone, refers_to, its url, whether that is alone); ids are texts.

    A page whose id and payload no other row has is `alone`: its record id follows from these,
    so that revisits can name it; `apart` tells the others apart.
    """
    page_id, url, html, digest, n, alone, refers_to, target, target_alone = row
    ids = lambda page, own, k: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{job}/{page}/{digest}/{own}/{k}')}>"
    own = "" if alone else apart
    head = [("WARC-Date", DATE), ("WARC-Target-URI", _clean(url)), ("Page-Id", _safe(page_id)), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if html is None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n
        more = [("WARC-Profile", PROFILE), ("WARC-Refers-To", ids(refers_to, "", 1) if target_alone else None), ("WARC-Refers-To-Target-URI", _clean(target)),
                ("WARC-Refers-To-Date", DATE), ("Refers-To-Page-Id", _safe(refers_to))]
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", ids(page_id, apart, 1)), *head, *more, ("Content-Type", "application/http; msgtype=response")], block)
        return
    payload = html.encode("utf-8", "surrogatepass")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
    n = max(1, -(-len(block) // segment_bytes))
    for k in range(1, n + 1):
        part = block[(k - 1) * segment_bytes : k * segment_bytes]
        fields = [("WARC-Type", "response" if k == 1 else "continuation"), ("WARC-Record-ID", ids(page_id, own, k))]
        fields += head if k == 1 else [("WARC-Date", DATE), ("WARC-Segment-Origin-ID", ids(page_id, own, 1))]
        if n > 1:
            fields.append(("WARC-Segment-Number", k))
        if n > 1 and k == n:
            fields.append(("WARC-Segment-Total-Length", len(block)))
        yield _record([*fields, ("Content-Type", "application/http; msgtype=response" if k == 1 else None)], part)


def _safe(ident: str | None) -> str | None:
    return None if ident is None else quote(ident, safe=":/@+,;=")


def member(record: bytes) -> bytes:
    """A record as a gzip member of its own, without its last byte, which is zero and which the file writer puts after each.

    That byte is the highest of the record's length, so a record has less than 2**24 bytes.
    """
    packed = gzip.compress(record + END, 6, mtime=0)
    assert packed[-1] == 0
    return packed[:-1]


def write(rows, job: str, segment_bytes: int, chunk_bytes: int):
    from pyspark import TaskContext

    task = TaskContext.get()
    where = f"{task.stageId()}.{task.partitionId()}" if task else "0"
    for i, row in enumerate(rows):
        for record in records(row, job, f"{where}.{i}", segment_bytes, chunk_bytes):
            yield (member(record),)


def parse(data: bytes):
    """(fields, block) of each record of an archive, gzipped as a whole, by records, or not at all."""
    pull = _pieces(data)
    buffer = bytearray()

    def need(n: int) -> bool:
        while len(buffer) < n:
            piece = next(pull, None)
            if piece is None:
                return False
            buffer.extend(piece)
        return True

    while need(1):
        stop, seen = -1, 0
        while (stop := buffer.find(END, max(0, seen - 3))) < 0:
            seen = len(buffer)
            if not need(seen + 1):
                raise WarcError("archive ends within a header")
        lines = bytes(buffer[:stop]).decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise WarcError("record does not begin with a version line")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        if not fields.get("content-length", "").isdigit():
            raise WarcError("record without a length")
        n = int(fields["content-length"])
        if not need(stop + 4 + n + 4) or buffer[stop + 4 + n : stop + 8 + n] != END:
            raise WarcError("record does not end where its length says")
        yield fields, bytes(buffer[stop + 4 : stop + 4 + n])
        del buffer[: stop + 8 + n]


def _pieces(data: bytes, size: int = 1 << 20):
    if data[:2] != b"\x1f\x8b":
        for at in range(0, len(data), size):
            yield data[at : at + size]
        return
    while data:
        member = zlib.decompressobj(31)
        while not member.eof:
            piece = member.decompress(data, size)
            data = member.unconsumed_tail if not member.eof else member.unused_data
            if not piece and not member.eof and not data:
                raise WarcError("archive ends within a compressed member")
            yield piece


def http_payload(block: bytes) -> tuple[bytes, int | None]:
    """(payload, Content-Length) of an HTTP response."""
    head, end, body = block.partition(END)
    if not end:
        raise WarcError("HTTP header does not end")
    fields = dict(x.lower().split(b":", 1) for x in head.split(CRLF)[1:])
    if fields.get(b"transfer-encoding", b"").strip() == b"chunked":
        return dechunked(body), None
    return body, int(fields[b"content-length"]) if b"content-length" in fields else None


def _whole(kind: str, declared: str | None, block: bytes) -> tuple[int, str, bytes]:
    """(payload bytes, digest, payload) of a complete record, checked against its header."""
    payload, length = http_payload(block)
    wanted = (declared or "").removeprefix("sha256:")
    if kind == "revisit":
        return length if length is not None else len(payload), wanted, payload
    digest = hashlib.sha256(payload).hexdigest()
    if wanted and wanted != digest:
        raise WarcError(f"payload digest is {digest}, header says {wanted}")
    return len(payload), digest, payload


def read(contents, payloads: bool):
    """A row for each record of (path, data); segments keep their block, other records are decoded at once.

    What is broken gives a row with an error, and the records after it are read on; after a
    record whose own bounds are broken the rest of its file is lost, which its row says.
    """
    for path, data in contents:
        pull, number = parse(data), 0
        while True:
            number += 1
            try:
                fields, block = next(pull)
            except StopIteration:
                break
            except (WarcError, zlib.error, UnicodeDecodeError) as e:
                yield f"{path}#{number}", 0, None, None, None, None, None, None, None, None, None, f"{path}, record {number} and what follows: {e}"
                break
            yield _row(fields, block, payloads, f"{path}#{number}", f"{path}, record {number}")


def _row(f: dict[str, str], block: bytes, payloads: bool, place: str, name: str) -> tuple:
    kind, number, total = f.get("warc-type"), f.get("warc-segment-number"), f.get("warc-segment-total-length")
    origin = f.get("warc-segment-origin-id") or f.get("warc-record-id")
    page, refers = (unquote(x) if (x := f.get(k)) is not None else None for k in ("page-id", "refers-to-page-id"))
    declared, url = f.get("warc-payload-digest"), f.get("warc-target-uri")
    own = (None if kind == "continuation" else kind, page, url, declared, refers)
    if not kind or not origin or not all(x is None or x.isdigit() for x in (number, total)):
        return place, 0, None, *own, None, None, None, f"{name}: type, id or segment fields are missing or unreadable"
    row = (origin, int(number or 0), int(total) if total else None, *own)
    if number is not None:
        return *row, None, None, block, None
    try:
        n, digest, payload = _whole(kind, declared, block)
    except (WarcError, ValueError) as e:
        return place, *row[1:], None, None, None, f"{name}: {e}"
    return *row, n, digest, payload if payloads else None, None


def assemble(rows, payloads: bool):
    """Join the segments of each origin, in order, and check them.

    rows: (kind, page, url, declared, refers, bytes, digest, error, segments), the segments as (number, total, block) in order.
    """
    for kind, page, url, declared, refers, n, digest, error, segments in rows:
        payload = segments[0]["block"]
        if error is None and segments[0]["number"]:
            try:
                n, digest, payload = _joined(kind, declared, segments)
            except (WarcError, ValueError) as e:
                error, payload = str(e), None
        elif error is None and len(segments) > 1:
            error = "several records have one id"
        yield page, url, n, digest, kind, refers, payload if payloads else None, error


def _joined(kind: str | None, declared: str | None, segments) -> tuple[int, str, bytes]:
    if [s["number"] for s in segments] != list(range(1, len(segments) + 1)):
        raise WarcError(f"segments are not 1 to {len(segments)}")
    block = b"".join(s["block"] for s in segments)
    if segments[-1]["total"] != len(block):
        raise WarcError(f"segments have {len(block)} bytes, not {segments[-1]['total']}")
    return _whole(kind, declared, block)
