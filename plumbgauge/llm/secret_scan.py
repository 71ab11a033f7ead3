"""Secrets in texts and in what is encoded in them.

The text is the first layer. Every layer is scanned, and whatever in it can be unwrapped, URL or Unicode
escapes, base64, compressed data, makes a further layer, until no new layer appears. A layer seen
before at the same place of the text is not taken up again, so cycles end. Base64 is read on over single line breaks and from each of four
characters on, since what stands before it may look like base64 too; its bytes are scanned whether readable or not, a character a byte, also as UTF-16. A layer knows how its positions map to the text's:
escapes one by one, base64 by its six-bit characters, compressed data as a whole.

Defined results: a null text is empty, an empty one has no spans; repeated rows are scanned one by one; an empty table gives
no rows; other columns are ignored. Texts are scanned whole, in time in proportion to their length. Unpacked data is scanned whole as well, in overlapping windows
that are made one at a time; only an encoded run of more than 8 MB inside compressed data can be cut by a window's end.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbgauge.llm.common import ship

#: The patterns of the base kinds, in their order.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f][0-9a-f]{23,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

# written so that each begins with a character or a class, which the search looks for first
_URL = re.compile(r"%[0-9A-Fa-f]{2}(?:%[0-9A-Fa-f]{2})*")
_ESCAPE = r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)"
_ESCAPES = re.compile(f"{_ESCAPE}{_ESCAPE}*")
_ONE_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]+)\}|\\[uUx]([0-9A-Fa-f]+)|&#[xX]([0-9A-Fa-f]+);|&#([0-9]+);")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-][A-Za-z0-9+/_-]{15,}={0,2}")
# from the start of a run only, and possessive, so that a long run is read once
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[A-Za-z0-9+/_-]++)++={0,2}")
_IN_RUN = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=\r\n"
_BREAK = re.compile(r"[\r\n]+")
_MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\0|\x78[\x01\x5e\x9c\xda]|\]\0\0", re.DOTALL)
_WINDOW, _OVERLAP, _CHUNK = 1 << 23, 1 << 16, 1 << 16


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds: leftmost, not overlapping within a kind."""
    out, low = [], text.lower()
    if ("=" in text or ":" in text) and ("passw" in low or "secret" in low or "token" in low or "api" in low):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


class _Pieces:
    """Text made of copied and decoded stretches, and the way back from its positions."""

    def __init__(self):
        self.parts, self._at, self._from, self._exact, self.length = [], [], [], [], 0

    def add(self, part: str, start: int, end: int, copied: bool) -> None:
        if part:
            self.parts.append(part)
            self._at.append(self.length)
            self._from.append((start, end))
            self._exact.append(copied)
            self.length += len(part)

    def back(self, start: int, end: int) -> tuple[int, int]:
        i, j = bisect_right(self._at, start) - 1, bisect_right(self._at, end - 1) - 1
        first = self._from[i][0] + (start - self._at[i]) if self._exact[i] else self._from[i][0]
        last = self._from[j][0] + (end - self._at[j]) if self._exact[j] else self._from[j][1]
        return first, last


def _replaced(text: str, pattern: re.Pattern, decode) -> tuple[str, _Pieces] | None:
    """``text`` with what ``decode`` makes of the matches: (part, start, end) triples, or nothing to leave them."""
    pieces, done, changed = _Pieces(), 0, False
    for m in pattern.finditer(text):
        got = decode(m)
        if got:
            changed = True
            pieces.add(text[done:m.start()], done, m.start(), True)
            for part, start, end in got:
                pieces.add(part, start, end, False)
            done = m.end()
    if not changed:
        return None
    pieces.add(text[done:], done, len(text), True)
    return "".join(pieces.parts), pieces


def _url(m: re.Match):
    raw = bytes.fromhex(m[0].replace("%", ""))
    try:
        part = raw.decode()
    except UnicodeDecodeError:
        return [(chr(b), m.start() + 3 * i, m.start() + 3 * i + 3) for i, b in enumerate(raw)]
    out, at = [], m.start()
    for c in part:
        width = 3 * len(c.encode())
        out.append((c, at, at + width))
        at += width
    return out


def _escapes(m: re.Match):
    out = []
    for one in _ONE_ESCAPE.finditer(m[0]):
        code = int(one[4]) if one[4] else int(one[1] or one[2] or one[3], 16)
        if code > 0x10FFFF:
            return None
        out.append((chr(code), m.start() + one.start(), m.start() + one.end()))
    joined = "".join(c for c, _, _ in out)
    if any("\ud800" <= c <= "\udfff" for c in joined):  # surrogate pairs, as UTF-16 escapes have them
        merged, i = [], 0
        while i < len(out):
            c, start, end = out[i]
            if "\ud800" <= c <= "\udbff" and i + 1 < len(out) and "\udc00" <= out[i + 1][0] <= "\udfff":
                c = chr(0x10000 + ((ord(c) - 0xD800) << 10) + ord(out[i + 1][0]) - 0xDC00)
                end, i = out[i + 1][2], i + 1
            merged.append(("\ufffd" if "\ud800" <= c <= "\udfff" else c, start, end))
            i += 1
        return merged
    return out


_STANDARD = str.maketrans("-_", "+/")


def _unbase64(body: str) -> bytes:
    """What ``body`` holds without the last character if that gives no byte."""
    body = body[:len(body) - (len(body) % 4 == 1)].translate(_STANDARD)
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _inflaters(raw) -> list:
    """Readers that may open compressed data, by its first bytes."""
    head, out = bytes(raw[:6]), []
    if head[:2] == b"\x1f\x8b" or (len(head) > 2 and head[0] & 15 == 8 and (head[0] << 8 | head[1]) % 31 == 0):
        out.append(lambda: zlib.decompressobj(47))
    if head[:3] == b"BZh":
        out.append(bz2.BZ2Decompressor)
    if head == b"\xfd7zXZ\0" or head[:3] == b"]\0\0":
        out.append(lzma.LZMADecompressor)
    return out


def _member(reader, raw):
    """What one compressed member at the start of ``raw`` holds, in parts of at most _WINDOW bytes; the last thing yielded is the number of bytes it took."""
    at = 0
    while at < len(raw) and not reader.eof:
        data = raw[at:at + _CHUNK]
        at += len(data)
        while True:
            part = reader.decompress(data, _WINDOW)
            if part:
                yield part
            data = getattr(reader, "unconsumed_tail", b"")  # zlib hands back what it has not read, the others keep it
            if reader.eof or not (data or (part and not getattr(reader, "needs_input", True))):
                break
    yield at - len(reader.unused_data) if reader.eof else len(raw)


def _inflated(raw):
    """What ``raw`` holds if it is compressed, in overlapping windows of bounded size. A run that may be base64 goes into the next window whole, up to _WINDOW."""
    for make in _inflaters(raw):
        reader, left, kept = make(), memoryview(raw), b""
        try:
            while reader:
                for part in _member(reader, left):
                    if isinstance(part, int):
                        left = left[part:]
                        continue
                    part = kept + part
                    yield part
                    run = len(part) - len(part.rstrip(_IN_RUN))
                    kept = part[-max(_OVERLAP, min(run, _WINDOW)):]
                reader = _inflaters(left)[0]() if reader.eof and _inflaters(left) else None  # the next of several members
        except (zlib.error, OSError, EOFError, lzma.LZMAError):
            continue


def _wide(raw: bytes):
    """(text, offset): the bytes at even or odd places, as UTF-16 has those of ASCII characters."""
    if b"\0" in raw:
        for offset in (0, 1):
            yield raw[offset::2].decode("latin-1"), offset


def _unpacked(raw: bytes):
    """Layers of what is compressed in ``raw``, from its first byte or from where compressed data seems to begin."""
    for at in sorted({0, *(m.start() for m in _MAGIC.finditer(raw))}):
        for part in _inflated(memoryview(raw)[at:]):
            yield part.decode("latin-1")
            for text, _ in _wide(part):
                yield text


def _base64_layers(text: str):
    runs = [(m.start(), m.end()) for m in _BASE64.finditer(text)] + [(m.start(), m.end()) for m in _WRAPPED.finditer(text)]
    for begin, end in runs:
        pieces, done = _Pieces(), begin
        for m in _BREAK.finditer(text, begin, end):
            pieces.add(text[done:m.start()], done, m.start(), True)
            done = m.end()
        pieces.add(text[done:end], done, end, True)
        body = "".join(pieces.parts).rstrip("=")
        for skip in range(4):
            raw = _unbase64(body[skip:])

            def back(s, e, step=1, offset=0, skip=skip, pieces=pieces):
                first, last = offset + step * s, offset + step * (e - 1) + 1
                return pieces.back(skip + 8 * first // 6, skip - -8 * last // 6)
            yield raw.decode("latin-1"), back
            for inner, offset in _wide(raw):
                yield inner, lambda s, e, back=back, offset=offset: back(s, e, 2, offset)
            for inner in _unpacked(raw):
                yield inner, lambda s, e, begin=begin, end=end: (begin, end)


def _layers(text: str):
    """(layer, way back to positions in ``text``) of everything that can be unwrapped in ``text``."""
    if "%" in text and (got := _replaced(text, _URL, _url)):
        yield got[0], got[1].back
    if ("\\" in text or "&#" in text) and (got := _replaced(text, _ESCAPES, _escapes)):
        yield got[0], got[1].back
    yield from _base64_layers(text)


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans including those of unwrapped layers, as (start, kind number, end) in positions of ``text``."""
    base = scan(text)
    found, seen, own = set(base), set(), _digest(text)
    work = [(_layers(text), ())]  # a layer is made when its turn comes, so few are held at a time
    while work:
        made, outer = work[-1]
        layer, back = next(made, (None, None))
        if back is None:
            work.pop()
            continue
        if not layer:
            continue
        path = (*outer, back)
        start, end = 0, len(layer)
        for back in reversed(path):
            start, end = back(start, end)
        mark = (_digest(layer), start, end)
        if mark in seen or mark[0] == own:
            continue
        seen.add(mark)
        for start, kind, end in scan(layer):
            for back in reversed(path):
                start, end = back(start, end)
            found.add((start, kind, end))
        work.append((_layers(layer), path))
    return base, sorted(found)


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, number of base spans by kind, checksum of the base spans, and all spans."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for value in batch.column(1):
                base, every = spans(value.as_py() or "")
                for i in range(3):
                    columns[i].append(sum(k == i for _, k, _ in base))
                columns[3].append(hashlib.sha256(written(base).encode()).hexdigest())
                columns[4].append(written(every))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.string()) for c in columns[3:])], names=names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
