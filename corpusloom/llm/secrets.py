"""Secret scan with a recursive decoding worklist (operator 5).

A text is layer 0. From each layer, decoders make further ones where they change anything: URL percent escapes, Unicode
and hex escapes, base64 runs, and gzip, zlib, bzip2, xz or Zstandard data in base64, percent or hex escapes. A decoder
replaces what it unwraps in place, so keywords before an encoded value stay before it. Layers go through a
worklist until nothing new appears; a layer whose text was seen before is not taken up again, which ends cycles.
Every layer is scanned with the same patterns, and what is found is mapped to the code points of the text that it
was unwrapped from: escapes map one by one, base64 runs and packed data as a whole.

A base64 run is decoded at each of the four alignments, so encoded data is found behind any prefix (``a/b-<base64>``); a run may
also go on over line breaks, as mail and key files wrap it. Decoded bytes count as text if they hold ``PLAIN`` printable
ASCII characters in a row (all of them, where they are fewer) or are readable altogether, as UTF-8 or UTF-16; single bytes that are no
UTF-8 become U+FFFD and hide nothing else. Packed data is unpacked member by member, also packed data in packed data.

Unpacked data of any size is scanned: up to ``IN_PLACE`` characters it is a layer like any other; beyond that it goes by in
overlapping windows of about ``WINDOW`` characters, each unwrapped and scanned in turn, whose spans map to the whole run. A
window is extended to the end of an encoded run, so memory is bounded by the window and the longest encoded run.

Patterns, all leftmost and non-overlapping per kind: ``assign`` (a keyword, a separator and a value of 12 or more
characters), ``access`` (an access key id of 18 or more) and ``hex`` (16 or more). Matches that are too short are
dropped, but what they cover is not matched again.

Defined results: a null text counts as empty and has no spans; texts are scanned whole; repeated rows are scanned
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import io
import itertools
import lzma
import re
import urllib.parse
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The patterns of each kind, in order of listing, and the least length of what they match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex")
IN_PLACE, WINDOW, OVERLAP, PIECE, CONTEXT, PLAIN = 1 << 20, 1 << 20, 1 << 16, 1 << 18, 256, 16

_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]++)+={0,2}")
_URL_BYTES = re.compile(r"(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~+/-])+")
_HEX_BYTES = re.compile(r"(?:\\x[0-9A-Fa-f]{2}|\\[nrt0'\"\\]|[\x20-\x5b\x5d-\x7e])+")
_MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\x78[\x01\x5e\x9c\xda]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
_ENCODED_END = re.compile(r"[A-Za-z0-9+/_=%\\-]{20,}\Z")


def scan(text: str) -> list[tuple[int, int, int]]:
    """``(start, end, kind number)`` of the patterns' matches."""
    found = []
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "apikey", "api_key")):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found)


# --- bytes


def _wide(data: bytes) -> int | None:
    """Where UTF-16 with the low byte first may begin in ``data`` (0 or 1), None if nothing looks like it."""
    if data[:2] == b"\xff\xfe":
        return 0
    found = re.search(rb"(?:[\t\n\r\x20-\x7e]\x00){%d}" % max(4, min(PLAIN, len(data) // 2)), data)
    return None if found is None else found.start() % 2


def _plain(data: bytes) -> str | None:
    """The text that bytes hold, None where they hold none."""
    if (wide := _wide(data)) is not None:
        return data[wide:].decode("utf-16-le", "replace")
    if re.search(rb"[\t\n\r\x20-\x7e]{%d}" % max(1, min(PLAIN, len(data))), data):
        return data.decode("utf-8", "replace")
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    return text if text and all(c.isprintable() or c in "\t\n\r" for c in text) else None


def _aligned(body: str, k: int) -> bytes:
    """The bytes of a base64 run from its ``k``-th character on, without what does not fill a byte."""
    body = body[k:]
    body = body[: len(body) - (len(body) % 4 == 1)]
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), b"+/")
    except (binascii.Error, ValueError):
        return b""


def _member(data: bytes, at: int) -> Iterator[bytes | int]:
    """Pieces of the packed data that begins at ``at``, then the position behind it."""
    if data[at : at + 4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        try:
            reader = zstandard.ZstdDecompressor(max_window_size=1 << 31).stream_reader(io.BytesIO(data[at:]))
            while piece := reader.read(PIECE):
                yield piece
        except zstandard.ZstdError:
            pass
        yield at + 4
        return
    try:
        if data[at] in b"\x1f\x78":
            unpacker, rest = zlib.decompressobj(47), data[at:]
            while not unpacker.eof:
                piece = unpacker.decompress(rest, PIECE)
                rest = unpacker.unconsumed_tail
                if not piece:
                    break
                yield piece
        else:
            unpacker, rest = bz2.BZ2Decompressor() if data[at] == 0x42 else lzma.LZMADecompressor(), data[at:]
            while not unpacker.eof and not (unpacker.needs_input and not rest):
                piece, rest = unpacker.decompress(rest, PIECE), b""
                if piece:
                    yield piece
        yield len(data) - len(unpacker.unused_data) if unpacker.eof else at + 1
    except (OSError, ValueError, EOFError, zlib.error, lzma.LZMAError):
        yield at + 1


def _inflate(data: bytes, above: frozenset[bytes] = frozenset()) -> Iterator[bytes]:
    """Pieces of all packed data in ``data``, members one after the other; packed data that unpacks to packed data is unpacked on."""
    above, at = above | {hashlib.blake2b(data).digest()}, 0
    while m := _MAGIC.search(data, at):
        parts = _member(data, m.start())
        head = next(parts)
        inner = [head] if isinstance(head, bytes) and _MAGIC.match(head) else None
        for part in itertools.chain([head], parts):
            if isinstance(part, int):
                at = part
            elif inner is None:
                yield part
            elif part is not head:
                inner.append(part)
        if inner:
            whole = b"".join(inner)
            if hashlib.blake2b(whole).digest() not in above:  # else it unpacks to itself
                yield from _inflate(whole, above)


def _texts(pieces: Iterator[bytes]) -> Iterator[str]:
    first = next(pieces, b"")
    wide = _wide(first)
    decoder = codecs.getincrementaldecoder("utf-8" if wide is None else "utf-16-le")("replace")
    for piece in itertools.chain([first[wide or 0 :]], pieces):
        if text := decoder.decode(piece):
            yield text
    if text := decoder.decode(b"", True):
        yield text


# --- runs: ``(start, end, replacement)``, where a replacement is units, a text or the pieces of a long text

Units = list[tuple[int, int, str]]


def _code(m: str) -> str | None:
    digits = m.strip("\\uUxX{}&#;")
    value = int(digits, 10 if m[:2] == "&#" and m[2] not in "xX" else 16)
    return chr(value) if value < 0x110000 else None


def _url_units(run: str) -> Units:
    """Decoded characters of a run with the part of the run that each stands for; a byte that is no UTF-8 stands alone."""
    data, out, i = bytes.fromhex(run.replace("%", "")), [], 0
    while i < len(data):
        n = 1 if data[i] < 0x80 else 2 if data[i] >> 5 == 6 else 3 if data[i] >> 4 == 14 else 4 if data[i] >> 3 == 30 else 0
        try:
            char = data[i : i + n].decode() if n else "\ufffd"
        except UnicodeDecodeError:
            n, char = 1, "\ufffd"
        n = max(1, n)
        out.append((3 * i, 3 * min(i + n, len(data)), char))
        i += n
    return out


def _packed(data: bytes) -> str | Iterator[str] | None:
    """The text of packed data in ``data``, as pieces where it is long, None without any."""
    if not _MAGIC.search(data):
        return None
    pieces = _texts(_inflate(data))
    held, size = [], 0
    for piece in pieces:
        held.append(piece)
        size += len(piece)
        if size > IN_PLACE:
            return itertools.chain(held, pieces)
    return "".join(held) or None


def _replacements(text: str) -> Iterator[list[tuple[int, int, Units | str | Iterator[str]]]]:
    """What each decoder would replace, one list per decoder that finds anything."""
    if "%" in text:
        yield [(m.start(), m.end(), _url_units(m[0])) for m in _URL.finditer(text)]
        yield [(m.start(), m.end(), out) for m in _URL_BYTES.finditer(text) if "%" in m[0] and (out := _packed(urllib.parse.unquote_to_bytes(m[0]))) is not None]
    if "\\" in text or "&#" in text:
        yield [(m.start(), m.end(), [(0, len(m[0]), c)]) for m in _ESCAPE.finditer(text) if (c := _code(m[0])) is not None]
    if "\\x" in text:
        raw = lambda run: run.encode("ascii").decode("unicode_escape").encode("latin-1", "replace")
        yield [(m.start(), m.end(), out) for m in _HEX_BYTES.finditer(text) if "\\x" in m[0] and (out := _packed(raw(m[0]))) is not None]
    for pattern in (_BASE64, _WRAPPED):
        if pattern is _WRAPPED and "\n" not in text:
            continue
        runs = [(m.start(), m.end(), re.sub(r"[\r\n\t =]+", "", m[0]).replace("-", "+").replace("_", "/")) for m in pattern.finditer(text)]
        for k in range(4) if runs else ():
            decoded = [(a, b, _aligned(body, k)) for a, b, body in runs]
            yield [(a, b, out) for a, b, data in decoded if data and (out := _plain(data)) is not None]
            yield [(a, b, out) for a, b, data in decoded if data and (out := _packed(data)) is not None]


class Layer:
    """A text and, for each of its characters, the code points of the original that it comes from."""

    def __init__(self, text: str, start: np.ndarray, end: np.ndarray):
        self.text, self.start, self.end = text, start, end

    @classmethod
    def original(cls, text: str) -> Layer:
        at = np.arange(len(text), dtype=np.int64)
        return cls(text, at, at + 1)

    def replaced(self, runs: list[tuple[int, int, Units | str]]) -> Layer:
        texts, starts, ends, at = [], [], [], 0
        for a, b, made in runs:
            units = [(0, b - a, made)] if isinstance(made, str) else made
            texts += [self.text[at:a], *(c for *_, c in units)]
            sizes = [len(c) for *_, c in units]
            low, high = np.array([u[0] for u in units], np.int64) + a, np.array([u[1] for u in units], np.int64) + a - 1
            starts += [self.start[at:a], np.repeat(self.start[low], sizes)]
            ends += [self.end[at:a], np.repeat(self.end[high], sizes)]
            at = b
        return Layer("".join(texts) + self.text[at:], np.concatenate([*starts, self.start[at:]]), np.concatenate([*ends, self.end[at:]]))


def _windows(pieces: Iterator[str], before: str, after: str) -> Iterator[tuple[str, int, int]]:
    """Overlapping windows of ``before + pieces + after``, each with the lengths of the context at its two ends."""
    held, lead, pieces = before, len(before), iter(pieces)
    squeeze = lambda text: re.sub(r"\x20{1024,}", " " * 1024, text)  # noqa: E731  (no pattern counts blanks)
    while True:
        piece = next(pieces, None)
        if piece is not None:
            cut = max(lead, len(held) - 2048)
            held = held[:cut] + squeeze(held[cut:] + piece)
            if len(held) < WINDOW or _ENCODED_END.search(held, max(lead, len(held) - 24)):
                continue
            yield held, lead, 0
            held, lead = held[-OVERLAP:], 0
        else:
            yield held + after, lead, len(after)
            return


def _scan_long(layer: Layer, a: int, b: int, pieces: Iterator[str]) -> set[tuple[int, int, int]]:
    """Spans of a long text that stands for ``layer.text[a:b]``."""
    first, last, found = max(0, a - CONTEXT), min(len(layer.text), b + CONTEXT), set()
    low, high = int(layer.start[a]), int(layer.end[b - 1])
    for text, lead, trail in _windows(pieces, layer.text[first:a], layer.text[b:last]):
        for start, end, kind in _spans(text):
            stop = len(text) - trail
            if end <= lead or start >= stop:  # the context's own
                continue
            begins = int(layer.start[first + start]) if start < lead else low
            ends = int(layer.end[b + end - stop - 1]) if end > stop else high
            found.add((begins, ends, kind))
    return found


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _spans(text: str) -> set[tuple[int, int, int]]:
    """``(start, end, kind number)`` in ``text`` and all layers below it."""
    found, seen, work = set(scan(text)), {_digest(text)}, [Layer.original(text)] if _may_unwrap(text) else []
    while work:
        layer = work.pop()
        for runs in _replacements(layer.text):
            short = [r for r in runs if isinstance(r[2], (str, list))]
            for a, b, pieces in runs:
                if not isinstance(pieces, (str, list)):
                    found |= _scan_long(layer, a, b, pieces)
            if not short:
                continue
            child = layer.replaced(short)
            digest = _digest(child.text)
            if digest in seen:
                continue
            seen.add(digest)
            for a, b, kind in scan(child.text):
                found.add((int(child.start[a]), int(child.end[b - 1]), kind))
            work.append(child)
    return found


def _may_unwrap(text: str) -> bool:
    return "%" in text or "\\" in text or "&#" in text or _BASE64.search(text) is not None


def find_secrets(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans after unwrapping, both sorted by start, then kind."""
    order = lambda spans: sorted(spans, key=lambda s: (s[0], s[2], s[1]))
    return order(scan(text)), order(_spans(text))


def _scan_rows(batches):
    for batch in batches:
        both = [find_secrets(t or "") for t in batch.column(1).to_pylist()]
        flat = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for a, b, k in spans]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([flat(b) for b, _ in both], kind), pa.array([flat(s) for _, s in both], kind)],
            ["id", "base", "spans"],
        )


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and arrays ``base`` and ``spans`` of ``(kind, start, end)``."""
    kind = docs.schema[id_col].dataType.simpleString()
    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select(id_col, text_col).mapInArrow(_scan_rows, f"id {kind}, base {span}, spans {span}").withColumnRenamed("id", id_col)


def digest_columns(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base spans per kind, their digest, and the listing of all spans."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return scanned.select(id_col, *(count(k) for k in KINDS), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
