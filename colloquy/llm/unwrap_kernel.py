"""Secret rules, and the worklist that unwraps encoded layers and maps what it finds back."""

from __future__ import annotations

import binascii
import bz2
import hashlib
import html.entities
import itertools
import lzma
import re
import zlib
from array import array
from bisect import bisect_right

#: The rules, in the order that ties are told in.
_ASSIGN = re.compile(
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex")

_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(
    r"\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|\\[0-3][0-7]{2}|%u[0-9A-Fa-f]{4}"
    r"|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&[A-Za-z][A-Za-z0-9]{1,31};"
)
_PACKED = re.compile(r"[A-Za-z0-9+/_-]{16,}")
_NEXT_LINE = re.compile(r"\r?\n[\x20\t]*([A-Za-z0-9+/_-]+)(={0,2})(?=[\x20\t]*(?:\r?\n|\Z|[\"'<\x60\\)]))")
_PLAIN = str.maketrans("-_", "+/")

#: How zlib streams begin, by the rule of their header: method 8, a window of at most 32 K, no dictionary, a multiple of 31.
_ZLIB = [(c, [f for f in range(256) if not f & 0x20 and (c * 256 + f) % 31 == 0]) for c in range(0x08, 0x80, 0x10)]

#: How compressed streams begin: gzip, bz2, xz, zstd, zlib.
_MAGIC = r"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\(\xb5/\xfd|" + "|".join(rf"\x{c:02x}[{''.join(rf'\x{f:02x}' for f in own)}]" for c, own in _ZLIB)
_STREAM, _STREAM_BYTES = re.compile(_MAGIC), re.compile(_MAGIC.encode("latin-1"))

#: What decoded bytes must hold to be worth a layer: the beginning of a rule or of a further encoding.
_HINT = re.compile(
    rb"(?i:passw|secret|token|api_?key)|AKIA|[A-Za-z0-9+/_-]{16}|%u?[0-9A-Fa-f]{2}|\\[uUx]\{?[0-9A-Fa-f]{1,2}|\\[0-3][0-7]{2}|&#[0-9xX]|&[A-Za-z]{2,31};|" + _MAGIC.encode("latin-1")
)

#: An unpacked layer is taken in blocks of BLOCK bytes that share OVERLAP bytes.
BLOCK, OVERLAP = 1 << 24, 1 << 20

#: Bytes that a stream is fed first, and later on; and a zstd stream at a time.
FIRST, STEP, NIBBLE = 1 << 12, 1 << 20, 1 << 9

#: Whole-text copies in a row after which each further layer of a tower of escapes holds only the parts of the text that still change.
COPIES = 8

#: Characters that no rule and no encoding of text has, where such parts end.
_BREAK = re.compile(r"[,()<>!?*|$@^~\[\]]")

#: Bytes behind a raw deflate stream that base64 may add to it; how far in front a name or path may reach, and how its parts end.
TAIL, FRONT, _FRONT = 3, 128, re.compile("[/+_-]")

#: Streams that are unpacked straight out of one another; a deeper one is a layer of its own.
DEPTH = 32

#: Against decompression bombs: characters of all layers of a document, which PER_CHAR adds to for each of its own; memory of an unpacker.
TOTAL_CHARS, PER_CHAR, UNPACKER = 1 << 30, 1 << 10, 1 << 27


def rules(text: str):
    """(kind, start, end) of every base match, leftmost and non-overlapping within a kind."""
    lowered = text.lower()
    if "passw" in lowered or "secret" in lowered or "token" in lowered or "key" in lowered:
        for m in _ASSIGN.finditer(text):
            if m.end(1) - m.start(1) >= 12:
                yield "assign", m.start(), m.end()
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if m.end() - m.start() >= 18:
                yield "access", m.start(), m.end()
    for m in _HEX.finditer(text):
        yield "hex", m.start(), m.end()


# ---- where the characters of a layer come from ------------------------------------------------


class Whole:
    """Every character comes from the same span of the layer above."""

    def __init__(self, above, how: str, start: int, end: int):
        self.above, self.how, self.start, self.end = above, how, start, end

    def up(self, i: int) -> tuple[int, int]:
        return self.start, self.end


class Pieces:
    """Characters from at[k] on come one by one from start[k] on, or all from start[k] to end[k]; end is -1 for the former."""

    def __init__(self, above, how: str):
        self.above, self.how, self.steps = above, how, [(how, 1)]
        self.at, self.start, self.end = array("q"), array("q"), array("q")

    def add(self, at: int, start: int, end: int) -> None:
        self.at.append(at)
        self.start.append(start)
        self.end.append(end)

    def up(self, i: int) -> tuple[int, int]:
        k = bisect_right(self.at, i) - 1
        if self.end[k] < 0:
            start = self.start[k] + i - self.at[k]
            return start, start + 1
        return self.start[k], self.end[k]

    def onto(self, length: int) -> Pieces:
        """The same characters, length of them, straight from where the layer above has its own from."""
        above, out = self.above, Pieces(self.above.above, self.how)
        out.steps = [*above.steps[:-1], (self.how, above.steps[-1][1] + 1)] if above.steps[-1][0] == self.how else [*above.steps, (self.how, 1)]
        for k, (at, start, end) in enumerate(zip(self.at, self.start, self.end, strict=True)):
            if end >= 0:
                out.add(at, above.up(start)[0], above.up(end - 1)[1])
                continue
            stop = start + (self.at[k + 1] if k + 1 < len(self.at) else length) - at
            i, j = start, bisect_right(above.at, start) - 1
            while i < stop:
                out.add(at + i - start, above.start[j] + (i - above.at[j] if above.end[j] < 0 else 0), above.end[j])
                j += 1
                i = above.at[j] if j < len(above.at) else stop
        return out

    def decoded(self, start: int, end: int) -> bool:
        """Whether any character from start to end is new in this layer."""
        k = bisect_right(self.at, start) - 1
        while k < len(self.at) and self.at[k] < end:
            if self.end[k] >= 0:
                return True
            k += 1
        return False


class Packed:
    """Characters of base64 text that lies in spans, from its character `skip` on; sizes holds where each one's bytes begin, if not one each."""

    def __init__(self, above, how: str, spans: list[tuple[int, int]], skip: int, sizes: array | None):
        self.above, self.how, self.spans, self.skip, self.sizes = above, how, spans, skip, sizes
        self.begins = list(itertools.accumulate((b - a for a, b in spans), initial=0))

    def _place(self, i: int) -> int:
        i = min(i, self.begins[-1] - 1)
        k = bisect_right(self.begins, i) - 1
        return self.spans[k][0] + i - self.begins[k]

    def up(self, i: int) -> tuple[int, int]:
        first, last = (i, i + 1) if self.sizes is None else (self.sizes[i], self.sizes[i + 1])
        return self._place(self.skip + first * 4 // 3), self._place(self.skip + -(-last * 4 // 3) - 1) + 1


class Layer:
    """fresh is where the characters come from in the layer above, if they were decoded from it one by one."""

    def __init__(self, text: str, place=None, copies: int = 0, fresh: Pieces | None = None):
        self.text, self.place, self.copies, self.fresh = text, place, copies, fresh


def origin(place, start: int, end: int) -> tuple[int, int]:
    """The span of the document that start to end of a layer comes from."""
    while place is not None:
        start, end = place.up(start)[0], place.up(end - 1)[1]
        place = place.above
    return start, end


def path(place) -> str:
    """How a layer was reached, outermost step first; more than COPIES equal steps in a row are one with their number."""
    steps: list[tuple[str, int]] = []
    while place is not None:
        for how, n in reversed(place.steps if isinstance(place, Pieces) else [(place.how, 1)]):
            if steps and steps[-1][0] == how:
                steps[-1] = (how, steps[-1][1] + n)
            else:
                steps.append((how, n))
        place = place.above
    return ">".join(how if n == 1 else ">".join([how] * n) if n <= COPIES else f"{how}*{n}" for how, n in reversed(steps))


# ---- URL and Unicode escapes --------------------------------------------------------------------


def _replaced(layer: Layer, pattern: re.Pattern, decode, how: str, begin: int = 0, stop: int | None = None) -> Layer | None:
    """The text from begin to stop with every match of pattern decoded once; decode gives (characters, source length) pairs."""
    place, out, at, last = Pieces(layer.place, how), [], 0, begin
    stop = len(layer.text) if stop is None else stop
    for m in pattern.finditer(layer.text, begin, stop):
        if m.start() > last:
            out.append(layer.text[last : m.start()])
            place.add(at, last, -1)
            at += m.start() - last
        source = m.start()
        for chars, n in decode(m[0]):
            out.append(chars)
            place.add(at, source, source + n)
            at, source = at + len(chars), source + n
        last = m.end()
    if not out:
        return None
    out.append(layer.text[last:stop])
    place.add(at, last, -1)
    text = "".join(out)
    # deep in a tower a place names its origin at once, so that no span has to climb it
    deep = layer.copies >= COPIES and isinstance(layer.place, Pieces)
    return Layer(text, place.onto(len(text)) if deep else place, layer.copies + 1, place)


def _percent(run: str):
    raw = bytes.fromhex(run.replace("%", ""))
    try:
        for c in raw.decode():
            yield c, 3 * len(c.encode())
    except UnicodeDecodeError:
        yield from _percent_bytes(run)


def _percent_bytes(run: str):
    for b in bytes.fromhex(run.replace("%", "")):
        yield chr(b), 3


def _character(escape: str) -> str:
    """What an escape stands for; itself where it is a name that no character has."""
    if escape[0] == "&" and escape[1] != "#":
        return html.entities.html5.get(escape[1:], escape)
    if escape[0] == "&":
        code = int(escape[3:-1], 16) if escape[2] in "xX" else int(escape[2:-1])
    elif escape[1].isdigit():
        code = int(escape[1:], 8)
    else:
        code = int(escape[2:].strip("{}"), 16)
    return chr(code) if code < 0xD800 or 0xDFFF < code <= 0x10FFFF else "\ufffd"


def _escaped(run: str):
    yield _character(run), len(run)


def _changing(layer: Layer):
    """(start, end) of the parts of a layer that hold escapes, each up to characters that nothing goes across."""
    borders = [-1, *(m.start() for m in _BREAK.finditer(layer.text)), len(layer.text)]
    at = 0
    while found := [m for p in (_ESCAPE, _URL) if (m := p.search(layer.text, at))]:
        k = bisect_right(borders, min(m.start() for m in found))
        start, end = borders[k - 1] + 1, borders[k]
        yield start, end
        at = end + 1


# ---- compressed streams -------------------------------------------------------------------------


class _Zlib:
    """zlib with the interface of the bz2 and lzma decompressors."""

    def __init__(self, wbits: int):
        self.inner = zlib.decompressobj(wbits)

    def decompress(self, data: bytes, most: int) -> bytes:
        return self.inner.decompress(self.inner.unconsumed_tail + data, most)

    eof = property(lambda self: self.inner.eof)
    unused_data = property(lambda self: self.inner.unused_data)
    needs_input = property(lambda self: not self.inner.unconsumed_tail)


class _Zstd:
    """The same for zstd. It takes NIBBLE bytes at a time, as what they unpack to cannot be limited otherwise."""

    def __init__(self):
        import zstandard

        self.inner, self.held = zstandard.ZstdDecompressor(max_window_size=UNPACKER).decompressobj(), b""

    def decompress(self, data: bytes, most: int) -> bytes:
        self.held += data
        out, size = [], 0
        while self.held and not self.inner.eof and size < most:
            part, self.held = self.held[:NIBBLE], self.held[NIBBLE:]
            out.append(self.inner.decompress(part))
            size += len(out[-1])
        return b"".join(out)

    eof = property(lambda self: self.inner.eof)
    unused_data = property(lambda self: self.inner.unused_data + self.held)
    needs_input = property(lambda self: not self.held)


class Bounds:
    """The characters that layers of a document may still have (None: any number), and whether a bound was hit."""

    def __init__(self, text: str, total: int | None = TOTAL_CHARS):
        self.left, self.hit = None if total is None else total + PER_CHAR * len(text), False

    def take(self, n: int) -> bool:
        if self.left is not None:
            self.hit = self.hit or self.left < 0
            self.left -= n
        return not (self.left is not None and self.left + n < 0)


class _Feed:
    """Bytes from a place on, in chunks; `fed` is how many were given and `spare` how many of those the stream left over."""

    def __init__(self, source: bytes | str, at: int):
        self.source, self.at, self.fed, self.spare = source, at, 0, 0

    def __iter__(self):
        step = FIRST
        while chunk := self.source[self.at + self.fed : self.at + self.fed + step]:
            if isinstance(chunk, str):
                try:
                    chunk = chunk.encode("latin-1")
                except UnicodeEncodeError as e:
                    if e.start:
                        self.fed += e.start
                        yield chunk[: e.start].encode("latin-1")
                    return
            self.fed += len(chunk)
            yield chunk
            step = STEP


def _kind(head: bytes) -> str | None:
    if not _STREAM_BYTES.match(head):
        return None
    return {0x1F: "gzip", 0x42: "bz2", 0xFD: "xz"}.get(head[0]) or ("zstd" if head[:2] == b"(\xb5" else "zlib")


_NEW = {"gzip": lambda: _Zlib(31), "zlib": lambda: _Zlib(15), "bz2": bz2.BZ2Decompressor, "xz": lambda: lzma.LZMADecompressor(memlimit=UNPACKER), "zstd": _Zstd}


def _inflated(chunks, kind: str, feed: _Feed | None):
    """What the stream in chunks unpacks to, all its members, in pieces of at most STEP bytes."""
    one, data = _NEW[kind](), b""
    while True:
        piece, data = one.decompress(data, STEP), b""
        if piece:
            yield piece
        if one.eof:
            data = one.unused_data
            while len(data) < 10 and (more := next(chunks, b"")):
                data += more
            if _kind(data) != kind:
                if feed:
                    feed.spare = len(data)
                return
            one = _NEW[kind]()
        elif one.needs_input and len(piece) < STEP and not (data := next(chunks, b"")):
            return


def _ends(chunks, wbits: int) -> int | None:
    """How many bytes follow the end of the zlib or deflate stream in chunks; None where it is broken, empty, or does not end."""
    one, size = zlib.decompressobj(wbits), 0
    try:
        for data in chunks:
            while data:
                size += len(one.decompress(data, STEP))
                if one.eof:
                    return len(one.unused_data) if size else None
                data = one.unconsumed_tail
    except zlib.error:
        pass
    return None


def _until_broken(pieces, bounds: Bounds):
    """pieces up to where the stream breaks off; what it holds before that counts."""
    try:
        yield from pieces
    except Exception as e:  # noqa: BLE001  each decompressor has errors of its own
        bounds.hit = bounds.hit or "memory" in str(e).lower()


def _opened(feed: _Feed, bounds: Bounds):
    """(pieces, times) of the stream that begins in feed, unpacked as often as it begins like one; 0 times if it is none."""
    chunks, depth = iter(feed), 0
    head = next(chunks, b"")
    chunks = itertools.chain([head], chunks)
    while depth < DEPTH and (kind := _kind(head)):
        if kind == "zlib" and head[0] != 0x78 and (depth or _ends(_Feed(feed.source, feed.at), 15) is None):
            break  # two such bytes are common, so only a whole stream counts
        before, after = itertools.tee(chunks) if depth else (None, chunks)
        pieces = _until_broken(_inflated(after, kind, None if depth else feed), bounds)
        inner = next(pieces, b"")
        if not inner:  # bytes that only look like a stream
            chunks = before or iter(())
            break
        head, chunks, depth = inner, itertools.chain([inner], pieces), depth + 1
    return chunks, depth


def _blocks(pieces):
    """The pieces as texts of about BLOCK bytes: UTF-8, or else a character for each byte."""
    held = bytearray()
    for piece in pieces:
        held += piece
        if len(held) >= BLOCK:
            text, _ = _as_text(bytes(held))
            yield text
            del held[:-OVERLAP]
            while held and 0x80 <= held[0] < 0xC0:
                del held[:1]
    if held:
        yield _as_text(bytes(held))[0]


def _wide(raw: bytes) -> str | None:
    """The byte order of text in UTF-16 that is mostly Latin: every other byte is zero."""
    if len(raw) < 8 or raw.count(0) * 3 < len(raw):
        return None
    odd, even = raw[1::2].count(0), raw[::2].count(0)
    return "utf-16-le" if odd > even else "utf-16-be"


def _tells(raw: bytes) -> bool:
    """Whether bytes hold the beginning of a rule or of a further encoding."""
    return bool(_HINT.search(raw) or _wide(raw) and _HINT.search(raw.replace(b"\0", b"")))


def _as_text(raw: bytes) -> tuple[str, array | None]:
    """raw as text, and where each character's bytes begin if they are not one each; bytes cut off at the end are left out."""
    if order := _wide(raw):
        text = raw[: len(raw) // 2 * 2].decode(order, "replace")
        return text, array("q", itertools.accumulate((2 if c < "\U00010000" else 4 for c in text), initial=0))
    for cut in range(4):
        try:
            text = raw[: len(raw) - cut].decode()
        except UnicodeDecodeError as e:
            if e.start < len(raw) - cut - 4:
                break
            continue
        if text.isascii():
            return text, None
        sizes = array("q", itertools.accumulate((1 if c < "\x80" else 2 if c < "ࠀ" else 3 if c < "\U00010000" else 4 for c in text), initial=0))
        return text, sizes
    return raw.decode("latin-1"), None


def _streams(source: bytes | str, bounds: Bounds):
    """(start, end, texts, times unpacked) of every compressed stream in bytes, or in characters that stand for bytes."""
    pattern, at = (_STREAM if isinstance(source, str) else _STREAM_BYTES), 0
    while m := pattern.search(source, at):
        feed = _Feed(source, m.start())
        pieces, depth = _opened(feed, bounds)
        if not depth:
            at = m.start() + 1
            continue
        texts = _blocks(pieces)
        first = next(texts, "")  # by then a stream of one block has ended
        at = max(m.start() + 1, m.start() + feed.fed - feed.spare)
        yield m.start(), at, itertools.chain([first], texts), depth


# ---- base64 -------------------------------------------------------------------------------------


def _lines(text: str, m: re.Match) -> list[tuple[int, int]]:
    """The spans of the lines that the run m goes on in: whole lines of one length, and a shorter last one."""
    lines, at = [m.span()], m.end()
    while n := _NEXT_LINE.match(text, at):
        width = lines[1][1] - lines[1][0] if len(lines) > 1 else None
        size = n.end(1) - n.start(1)
        if size > (width or max(76, len(m[0]))):
            break
        lines.append(n.span(1))
        at = n.end()
        if (width and size < width) or n[2]:
            break
    return lines


def _runs(text: str):
    """Spans of base64 text: runs that go on over line breaks, and every run by itself."""
    done = 0
    for m in _PACKED.finditer(text):
        if m.start() >= done and len(lines := _lines(text, m)) > 1:
            done = lines[-1][1]
            yield lines
        yield [m.span()]


def _decoded(body: str) -> bytes:
    n = len(body) - (len(body) % 4 == 1)
    return binascii.a2b_base64(body[:n].translate(_PLAIN) + "=" * (-n % 4))


def _deflated(raw: bytes):
    one, data = zlib.decompressobj(-15), raw
    while data and not one.eof:
        yield one.decompress(data, STEP)
        data = one.unconsumed_tail


def _raw_streams(layer: Layer, spans: list[tuple[int, int]], body: str, bounds: Bounds):
    """Layers in deflate streams without a header. They have no mark, so they must start a run, or follow a name or path in front, and end with it."""
    for skip in sorted({0, 1, 2, 3, *(m.end() for m in _FRONT.finditer(body[:FRONT]))}):
        raw = _decoded(body[skip:]) if len(body) - skip > 1 else b""
        if raw and (left := _ends([raw], -15)) is not None and left <= TAIL:
            edge = Packed(layer.place, "base64", spans, skip, None)
            place = Whole(layer.place, "base64>compressed", edge.up(0)[0], edge.up(len(raw) - 1)[1])
            yield from (Layer(t, place) for t in _blocks(_until_broken(_deflated(raw), bounds)) if _tells(t.encode("utf-8", "surrogatepass")))


def _unpacked(layer: Layer, bounds: Bounds):
    """Layers hidden in base64 runs, compressed or plain.

    Each run is decoded from its first four characters on, one of which has the layer's
    alignment whatever word, path or name stands in front of it. Bytes that are no text at
    that end, or all of them, do no harm: a rule or a stream shows in what remains. Bytes of a
    stream are not taken for text as well. A run that was copied whole from the layer above is
    part of one there, at one of the same alignments, and is passed over.
    """
    for spans in _runs(layer.text):
        if layer.fresh and not layer.fresh.decoded(spans[0][0], spans[-1][1]):
            continue
        body = "".join(layer.text[a:b] for a, b in spans)
        yield from _raw_streams(layer, spans, body, bounds)
        for skip in range(4):
            raw = _decoded(body[skip:])
            if not _tells(raw):
                continue
            rest = bytearray(raw)
            for start, end, texts, depth in _streams(raw, bounds):
                rest[start:end] = b" " * (end - start)
                edge = Packed(layer.place, "base64", spans, skip, None)
                place = Whole(layer.place, "base64" + ">compressed" * depth, edge.up(start)[0], edge.up(end - 1)[1])
                yield from (Layer(t, place) for t in texts)
            if not _tells(bytes(rest)):
                continue
            for odd in (0, 1) if _wide(bytes(rest)) else (0,):  # of UTF-16 the first byte may be half a character
                text, sizes = _as_text(bytes(rest[odd:]))
                if odd and sizes:
                    sizes = array("q", (n + odd for n in sizes))
                yield Layer(text, Packed(layer.place, "base64", spans, skip, sizes))


# ---- the worklist ---------------------------------------------------------------------------------


def _inner(layer: Layer, bounds: Bounds):
    yield from _unpacked(layer, bounds)
    for start, end, texts, depth in _streams(layer.text, bounds):
        place = Whole(layer.place, ">".join(["compressed"] * depth), start, end)
        yield from (Layer(t, place) for t in texts)
    for start, end in _changing(layer) if layer.copies >= COPIES else [(0, len(layer.text))]:
        yield from _once(layer, start, end)


def _once(layer: Layer, start: int = 0, end: int | None = None):
    """The layer from start to end with its escapes of each kind decoded once."""
    has = lambda c: layer.text.find(c, start, end) >= 0
    if (has("\\") or has("&") or has("%u")) and (found := _replaced(layer, _ESCAPE, _escaped, "unicode", start, end)):
        yield found
    if has("%") and (found := _replaced(layer, _URL, _percent, "url", start, end)):
        if not found.text.isascii():  # bytes of a stream may look like UTF-8
            other = _replaced(layer, _URL, _percent_bytes, "url", start, end)
            if _STREAM.search(other.text):
                yield other
        yield found


def unwrap(text: str, bounds: Bounds | None = None):
    """Every distinct layer of text, itself first; ends because a text that was seen is not taken up again.

    The next layer is made before the one at hand is gone into, so a tower of layers with
    one inside each holds two of them at a time.
    """
    bounds = bounds or Bounds(text)
    work, seen = [(Layer(text), iter(()))], set()
    while work:
        layer, more = work.pop()
        following = next(more, None)
        if following is not None:
            work.append((following, more))
        mark = hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if layer.place is not None and not bounds.take(len(layer.text)):
            return
        if mark in seen:
            continue
        seen.add(mark)
        yield layer
        inner = _inner(layer, bounds)
        first = next(inner, None)
        if first is not None:
            work.append((first, inner))


def secrets(text: str | None, bounds: Bounds | None = None):
    """((kind, start, end, layers, value) sorted by start, kind and end, number of inner layers).

    layers is '' for base matches; a place that two layers show counts once, the base one first.
    """
    found, layers = {}, -1
    for layer in unwrap(text or "", bounds):
        layers += 1
        for kind, start, end in rules(layer.text):
            found.setdefault((*origin(layer.place, start, end), kind), (path(layer.place), layer.text[start:end]))
    spans = sorted(((s, KINDS.index(k), e, k, *more) for (s, e, k), more in found.items()))
    return [(k, s, e, how, value) for s, _, e, k, how, value in spans], layers


def scan(rows, total: int | None = TOTAL_CHARS):
    for doc_id, text in rows:
        bounds = Bounds(text or "", total)
        spans, layers = secrets(text, bounds)
        yield doc_id, [dict(zip(("kind", "start", "end", "layers", "value"), s, strict=True)) for s in spans], layers, bounds.hit
