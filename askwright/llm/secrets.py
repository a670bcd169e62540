"""Secret scans with a recursive decoding worklist.

A text is a layer.  Each layer is scanned, and what it holds in URL, Unicode or base64 form, compressed or not, becomes
further layers, until no new layer appears.  Layers under URL and Unicode escapes are opened level by level, each of them
scanned.  Levels that only take an escape off an escaped escape (%252541 to %2541) show nothing new and are opened together,
so what is escaped a thousand times is a few layers.  Should layers of escapes still come to LEVELS times the text, as only
thousands of alternating forms make them, what is left is decoded to its fixpoint in one pass.  Every character of a layer
knows the characters of the document that it came from, so findings of any depth map to spans of the document.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections import deque
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askwright.llm.common import slices

KINDS = ["assign", "access", "hex"]
ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I)
WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile("AKIA[A-Z0-9]+")
URL = re.compile("(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\U000[0-9A-Fa-f]{5}|\\U0010[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,5}\}|\\x[0-7][0-9A-Fa-f]|&#[xX][0-9A-Fa-f]{1,5};|&#[0-9]{1,6};")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX, LEAST_BASE64 = 6, 20, 24, 16
#: A compressed layer that grows beyond this is reported as a finding of its own ("oversize"), not unpacked.
MOST_UNPACKED = 32 << 20
LEVELS, SHORT = 512, 1 << 20  # layers of escapes opened one by one: so many times the text, and so many characters
#: What a percent-coded archive looks like, and the first bytes of the archives.
CODED = re.compile(r"(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~/-])+")
HIGH = re.compile("%[89A-Fa-f][0-9A-Fa-f]")
MAGIC = re.compile(rb"\x1f\x8b|BZh|\xfd7zXZ\0|\x28\xb5\x2f\xfd|x[\x01\x5e\x9c\xda]")
MOST_MEMORY, MOST_WINDOW = 1 << 28, 1 << 27  # so is one whose unpacking needs more
#: Runs of base64 characters with nothing but line ends (also written ones, as in JSON) and indents between them.
WRAPPED = re.compile(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+(?:\r?\n|\r|(?:\\r)?\\n)[ \t>]*+[A-Za-z0-9+/_-]++)+")
LINE = re.compile(rb"[ \t]*(?:\r?\n|\r|(?:\\r)?\\n)[ \t>]*")


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_HEX = _mask(b"0123456789abcdef")
_ALNUM = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_BASE64 = _mask(_ALNUM + b"+/-_")
_PRINTED = _mask(bytes(range(32, 127)) + b"\t\r\n")


def _runs(raw: np.ndarray, mask: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Byte spans of the maximal runs of a class that are long enough."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = mask[raw]
    edge = np.diff(inside)
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = ends - begins >= least
    return list(zip(begins[long].tolist(), ends[long].tolist()))


class _Layer:
    """A text with the document span of each of its characters (None: it is the document)."""

    def __init__(self, text: str, begins: np.ndarray | None = None, ends: np.ndarray | None = None, path: tuple = ()):
        self.text, self.begins, self.ends, self.path = text, begins, ends, path
        self.raw = text.encode("utf-8", "surrogatepass")
        self.bytes = np.frombuffer(self.raw, np.uint8)
        self._points = None

    def point(self, byte: int) -> int:
        """Code points before a byte."""
        if len(self.raw) == len(self.text):
            return byte
        if self._points is None:
            self._points = np.concatenate([[0], np.cumsum((self.bytes & 0xC0) != 0x80)])
        return int(self._points[byte])

    def span(self, a: int, b: int) -> tuple[int, int]:
        if self.begins is None:
            return a, b
        return int(self.begins[a:b].min()), int(self.ends[a:b].max())

    def origins(self) -> tuple[np.ndarray, np.ndarray]:
        if self.begins is None:
            at = np.arange(len(self.text))
            return at, at + 1
        return self.begins, self.ends


def scan(layer: _Layer) -> list[tuple[str, int, int]]:
    """(kind, start, end) in the layer: leftmost, non-overlapping for each kind."""
    out = []
    low = layer.raw.lower()
    if any(w in low for w in WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(layer.text) if len(m[1]) >= LEAST_ASSIGN]
    if b"AKIA" in layer.raw:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(layer.text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [("hex", layer.point(a), layer.point(b)) for a, b in _runs(layer.bytes, _HEX, LEAST_HEX)]
    return out


def _replaced(layer: _Layer, pattern: re.Pattern, decode, name: str) -> _Layer | None:
    """The layer with all escapes of a form decoded; None if nothing changes."""
    texts, begins, ends, at, changed = [], [], [], 0, False
    own_b, own_e = layer.origins()
    for m in pattern.finditer(layer.text):
        new = decode(m[0])
        if new is None or new == m[0]:
            continue
        changed = True
        a, b = layer.span(m.start(), m.end())
        texts += [layer.text[at : m.start()], new]
        begins += [own_b[at : m.start()], np.full(len(new), a)]
        ends += [own_e[at : m.start()], np.full(len(new), b)]
        at = m.end()
    if not changed:
        return None
    return _Layer("".join(texts) + layer.text[at:], np.concatenate([*begins, own_b[at:]]), np.concatenate([*ends, own_e[at:]]), (*layer.path, name))


def _url(escape: str) -> str | None:
    try:
        return binascii.unhexlify(escape.replace("%", "")).decode("utf-8")
    except UnicodeDecodeError:
        return None


def _point(code: int) -> str | None:
    return chr(code) if code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else None


def _unicode(escape: str) -> str | None:
    if escape.startswith("&#"):
        return _point(int(escape[3:-1], 16) if escape[2] in "xX" else int(escape[2:-1]))
    if escape.startswith(r"\u{"):
        return _point(int(escape[3:-1], 16))
    if escape.startswith(r"\u"):
        units = b"".join(int(x, 16).to_bytes(2, "little") for x in escape.split(r"\u")[1:])
        try:
            return units.decode("utf-16-le")
        except UnicodeDecodeError:
            return None
    return _point(int(escape[2:], 16))


_HEX_DIGITS = frozenset("0123456789abcdefABCDEF")


def _escape_at_end(chars: list[str]) -> tuple[int, str] | None:
    """Length and meaning of the escape that ends here; None if none does."""
    c = chars[-1]
    if c in _HEX_DIGITS:
        if len(chars) > 2 and chars[-3] == "%" and chars[-2] in _HEX_DIGITS:
            for k in (1, 2, 3, 4):  # bytes of a character
                part = "".join(chars[-3 * k :])
                if URL.fullmatch(part) is None:
                    break
                if len(new := _url(part) or "") == 1:
                    return 3 * k, new
        for n in (12, 6, 4, 10):  # a pair of units, a unit, a byte, a code point
            if len(chars) >= n and chars[-n] == "\\":
                part = "".join(chars[-n:])
                if ESCAPE.fullmatch(part) and len(new := _unicode(part) or "") == 1:
                    return n, new
    elif c == "}" or c == ";":
        for n in range(4, 10):
            if len(chars) >= n and chars[-n] in "\\&":
                part = "".join(chars[-n:])
                if ESCAPE.fullmatch(part) and (new := _unicode(part)) is not None:
                    return n, new
    return None


def _settled(layer: _Layer) -> _Layer | None:
    """The layer with all escapes of both forms decoded until none is left: what is decoded may begin another escape with what
    follows it, and a read character is looked at once for each escape that it ends."""
    own_b, own_e = layer.origins()
    chars, begins, ends, changed = [], [], [], False
    for c, b, e in zip(layer.text, own_b.tolist(), own_e.tolist()):
        chars.append(c)
        begins.append(b)
        ends.append(e)
        while (found := _escape_at_end(chars)) is not None:
            n, new = found
            b, e = min(begins[-n:]), max(ends[-n:])
            del chars[-n:], begins[-n:], ends[-n:]
            chars.append(new)
            begins.append(b)
            ends.append(e)
            changed = True
    return _Layer("".join(chars), np.array(begins), np.array(ends), (*layer.path, "escapes")) if changed else None


#: Escaped escapes of each form, not behind an escape that they would be decoded with, and the length of one escaping.
CHAINS = {
    "url": (re.compile(r"(?<!%[0-9A-Fa-f]{2})%((?:25){2,})"), URL, _url),
    "unicode": (re.compile(r"(?<!\\u[0-9A-Fa-f]{4})\\((?:u005[cC]){2,})|&((?:#38;){2,})"), ESCAPE, _unicode),
}
ESCAPING = {"%": 2, "\\": 5, "&": 4}


def _level(layer: _Layer, form: str) -> _Layer | None:
    """The next level of a form that shows something new; None if nothing changes.

    Where escaped escapes are all that a level would change, each loses as many escapings as the least deep one has, but one.
    What stands between is told by the layers around it: the digits and letters that go are part of no finding, beyond those of
    the layer itself, and begin no archive.
    """
    chain, pattern, decode = CHAINS[form]
    depths = [(m.end() - m.start() - 1) // ESCAPING[m[0][0]] for m in chain.finditer(layer.text)]
    several = min(depths, default=0) - 1
    if several < 1 or any(decode(m[0]) not in (None, m[0]) for m in pattern.finditer(chain.sub("\0", layer.text))):
        return _replaced(layer, pattern, decode, form)

    # the escapings that go belong to the sign before them; what is left of a chain keeps its own places
    texts, begins, ends, at = [], [], [], 0
    own_b, own_e = layer.origins()
    for m in chain.finditer(layer.text):
        cut = m.start() + 1 + several * ESCAPING[m[0][0]]
        a, b = layer.span(m.start(), cut)
        texts += [layer.text[at : m.start()], m[0][0]]
        begins += [own_b[at : m.start()], np.array([a])]
        ends += [own_e[at : m.start()], np.array([b])]
        at = cut
    return _Layer("".join(texts) + layer.text[at:], np.concatenate([*begins, own_b[at:]]), np.concatenate([*ends, own_e[at:]]), (*layer.path, *[form] * several))


def _coded_archives(layer: _Layer):
    """Yield the layers behind compressed bytes in URL form, and the spans of those that grow too large."""
    if HIGH.search(layer.text) is None:
        return
    for m in CODED.finditer(layer.text):
        if "%" not in m[0]:
            continue
        data = unquote_to_bytes(m[0])
        for at in MAGIC.finditer(data):
            found = _unwrap(data[at.start() :])
            if found is None or not found[0]:
                continue
            start, stop = layer.span(m.start(), m.end())
            path = (*layer.path, "url", *found[0])
            if found[1] is None:
                yield None, ("oversize@" + ".".join(path), start, stop)
            else:
                yield _Layer(found[1], np.full(len(found[1]), start), np.full(len(found[1]), stop), path), None
            break


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _members(make, data: bytes) -> bytes:
    """The content of all members of a compressed stream, up to a byte more than MOST_UNPACKED; what follows the last whole
    or broken member is not part of it."""
    parts, room = [], MOST_UNPACKED + 1
    while data and room > 0:
        unpack = make()
        try:
            got = unpack.decompress(data, room)
        except (zlib.error, OSError, EOFError, lzma.LZMAError) as e:
            if not parts or "emory" in str(e):
                raise
            break
        parts.append(got)
        room -= len(got)
        data = unpack.unused_data.lstrip(b"\0")  # padding between members
    return b"".join(parts)


def _inflate(data: bytes) -> tuple[str, bytes | None] | None:
    """(form, content) of compressed bytes, content None beyond MOST_UNPACKED or the memory limit; None if they are not
    compressed."""
    form = ""
    try:
        if data[:2] == b"\x1f\x8b" or len(data) > 6 and data[0] == 0x78 and (data[0] << 8 | data[1]) % 31 == 0:
            form, content = "zlib", _members(lambda: zlib.decompressobj(47), data)
        elif data[:3] == b"BZh":
            form, content = "bz2", _members(bz2.BZ2Decompressor, data)
        elif data[:6] == b"\xfd7zXZ\0":
            form = "xz"
            content = _members(lambda: lzma.LZMADecompressor(memlimit=MOST_MEMORY), data)
        elif data[:4] == b"\x28\xb5\x2f\xfd":
            form, parts, room = "zstd", [], MOST_UNPACKED + 1
            with zstandard.ZstdDecompressor(max_window_size=MOST_WINDOW).stream_reader(data, read_across_frames=True) as reader:
                try:
                    while room > 0 and (got := reader.read(min(room, 1 << 20))):
                        parts.append(got)
                        room -= len(got)
                except zstandard.ZstdError as e:
                    if not parts or "memory" in str(e):
                        raise
            content = b"".join(parts)
        else:
            return None
        return form, content if len(content) <= MOST_UNPACKED else None
    except (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError, ValueError) as e:
        return (form, None) if form in ("xz", "zstd") and "emory" in str(e) else None


def _unwrap(data: bytes) -> tuple[tuple, str | None] | None:
    """The forms and the text of decoded bytes: compressed layers are opened until none is left; None if it is no text."""
    forms, seen = [], {_digest(data)}
    while (inner := _inflate(data)) is not None:
        forms.append(inner[0])
        if inner[1] is None:
            return tuple(forms), None
        data = inner[1]
        if _digest(data) in seen:  # a cycle: an archive that holds itself
            return None
        seen.add(_digest(data))
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    raw = np.frombuffer(data, np.uint8)
    if not len(raw) or not (_PRINTED[raw] | (raw >= 0x80)).all():
        return None
    return tuple(forms), text


def _tokens(layer: _Layer):
    """Yield (begin, end, characters) of base64 runs: single ones, and the lines of wrapped ones together."""
    for a, b in _runs(layer.bytes, _BASE64, LEAST_BASE64):
        yield a, b, layer.raw[a:b]
    if b"\n" not in layer.raw and b"\r" not in layer.raw and b"\\n" not in layer.raw:
        return
    for m in WRAPPED.finditer(layer.raw):
        if m.end() - m.start() < LEAST_BASE64:
            continue
        lines, at = [], m.start()
        for gap in LINE.finditer(layer.raw, m.start(), m.end()):
            lines.append((at, gap.start()))
            at = gap.end()
        lines.append((at, m.end()))
        n = len(lines)
        # a word of the text before or after may stand at the first or last line's place
        blocks = {(0, n), (1, n), (0, n - 1), (1, n - 1)}
        first = 0
        for i in range(1, n):  # lines of one length, and a last one that is no longer
            long, this = lines[first][1] - lines[first][0], lines[i][1] - lines[i][0]
            if this != long:
                blocks |= {(first, i), (first, i + 1)} if this < long else {(first, i)}
                first = i
        blocks.add((first, n))
        for i, j in sorted(blocks):
            if j - i > 1:
                token = b"".join(layer.raw[x:y] for x, y in lines[i:j])
                if len(token) >= LEAST_BASE64:
                    yield lines[i][0], lines[j - 1][1], token


def _base64(layer: _Layer):
    """Yield the layers behind base64 runs, and the spans of those that grow too large."""
    for a, b, token in _tokens(layer):
        if b"-" in token or b"_" in token:
            token = token.replace(b"-", b"+").replace(b"_", b"/")
        token = token[: len(token) - (len(token) % 4 == 1)]
        try:
            found = _unwrap(base64.b64decode(token + b"=" * (-len(token) % 4)))
        except binascii.Error:
            continue
        if found is None:
            continue
        forms, text = found
        end = b
        while end < len(layer.raw) and end < b + 2 and layer.raw[end : end + 1] == b"=":
            end += 1
        start, stop = layer.span(layer.point(a), layer.point(end))
        path = (*layer.path, "base64", *forms)
        if text is None:
            yield None, ("oversize@" + ".".join(path), start, stop)
        else:
            yield _Layer(text, np.full(len(text), start), np.full(len(text), stop), path), None


def find(text: str) -> list[tuple[str, int, int]]:
    """All findings: base kinds of the text itself, and kind@form.form... for what its layers hold beyond them."""
    root = _Layer(text)
    base = scan(root)
    known = set(base)
    seen = {(_digest(root.raw), 0, len(text))}
    work = deque([root])
    room = LEVELS * len(text) + SHORT
    while work:
        layer = work.popleft()
        children = []
        if room > 0:
            if "%" in layer.text:
                children.append(_level(layer, "url"))
            if "\\" in layer.text or "&#" in layer.text:
                children.append(_level(layer, "unicode"))
            room -= sum(len(c.text) for c in children if c is not None)
        elif "%" in layer.text or "\\" in layer.text or "&#" in layer.text:
            children.append(_settled(layer))
        for child, large in (*_coded_archives(layer), *_base64(layer)):
            children.append(child)
            if large:
                known.add(large)
        for child in children:
            if child is None or not child.text:
                continue
            key = (_digest(child.raw), *child.span(0, len(child.text)))
            if key in seen:  # the same content from the same place: a cycle or another way to it
                continue
            seen.add(key)
            work.append(child)
            for kind, a, b in scan(child):
                s, e = child.span(a, b)
                if not any(k == kind and x <= s and e <= y for k, x, y in base):
                    known.add((f"{kind}@{'.'.join(child.path)}", s, e))
    order = lambda k: (KINDS.index(k) if k in KINDS else len(KINDS), k)
    return sorted(known, key=lambda x: (x[1], order(x[0]), x[2]))


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, spans array<struct<kind,start,end>>), one per input row; code points of the text, end exclusive.

    Null or empty text has no spans.  Null and repeated ids are kept as they are; long texts are read whole; an empty table
    gives an empty result; other columns are ignored.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                found = [[{"kind": k, "start": a, "end": b} for k, a, b in find(t)] if t else [] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], ["id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>").withColumnRenamed("id", id_col)


def report(found: DataFrame) -> DataFrame:
    """Counts and digests of scan_documents()'s rows."""
    base = F.filter("spans", lambda s: s["kind"].isin(KINDS))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
