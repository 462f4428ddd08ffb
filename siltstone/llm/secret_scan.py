"""Secret scans with a recursive decoding worklist.

A document is the first layer. Layers are taken from a worklist until none is left: a layer is scanned, then every way
of unwrapping it (URL escapes, Unicode escapes, base64 at each alignment and over line ends, hex, gzip or zlib inside
those; bytes that are no UTF-8 are read one by one, and as UTF-16 if some are zero) gives new layers, each
with a map of its characters to the span of the document they came from (one span, where all of the layer came from
one place). A layer text that was seen over the same span is not taken again, which ends cycles.

Compressed layers are unpacked as streams, whatever they unpack to: up to WINDOW bytes are one layer, more are taken in
windows that overlap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, pieces, prepared, texts

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run of 16 or more is what is left of all runs
HINT = re.compile(r"passw(?:or)?d|secret|token|api_?key", re.I | re.A)

URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"(?:\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#x[0-9A-Fa-f]{1,6};)+")
ONE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#x([0-9A-Fa-f]{1,6});")
BLOB = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: A blob that goes on in the lines that follow.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]+)+={0,2}")
#: Where base64 of gzip or zlib can begin: at the start of a line, or behind what may be a separator.
PACKED = re.compile(r"(?:^|(?<=[/_\-\n]))(?:H4sI|e[A-P])")
HEX_BLOB = re.compile(r"[0-9A-Fa-f]{16,}")
#: Bytes of an unpacked layer that are held at once, and those that a window shares with the next.
WINDOW, OVERLAP = 16 << 20, 1 << 20
#: Bytes that a step of unpacking gives at most.
STEP = 1 << 18

#: A text, and the starts and ends of the spans of its characters: none (the document itself), one for all, or one for each.
Layer = tuple[str, "np.ndarray | int | None", "np.ndarray | int | None"]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of secrets that stand in the text, leftmost and non-overlapping for each kind."""
    found = []
    if HINT.search(text):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return found


def _packed(data: bytes) -> int:
    """zlib's number for the format that data begins like, 0 if like none."""
    if data[:2] == b"\x1f\x8b":
        return 31
    return 15 if len(data) > 5 and data[0] == 0x78 and (data[0] * 256 + data[1]) % 31 == 0 else 0


class Stream:
    """Chunks of bytes of which the first can be looked at, and which can be given back."""

    def __init__(self, chunks: Iterable[bytes]) -> None:
        self.chunks, self.held = iter(chunks), b""

    def peek(self, n: int) -> bytes:
        while len(self.held) < n and (more := next(self.chunks, None)) is not None:
            self.held += more
        return self.held

    def __iter__(self) -> Iterator[bytes]:
        if self.held:
            held, self.held = self.held, b""
            yield held
        for chunk in self.chunks:
            if self.held:  # given back on the way
                raise RuntimeError("a stream is read by one reader at a time")
            yield chunk


def _inflated(source: Stream, kind: int) -> Iterator[bytes]:
    """What the compressed members at the head of the source unpack to, in steps; source is left at what follows them.

    Raises zlib.error, with the source as it was, if its head is not compressed after all.
    """
    first = True
    while kind:
        step, fed, out = zlib.decompressobj(kind), b"", b""
        for chunk in source:
            rest = step.unconsumed_tail + chunk
            fed = fed + chunk if not out and len(fed) < STEP else fed
            while rest and not step.eof:
                try:
                    new = step.decompress(rest, STEP)
                except zlib.error:
                    if not out and first:
                        source.held = fed
                        raise
                    return  # broken further on: what was read before stays
                if new:
                    yield new
                    out = b"1"
                rest = step.unconsumed_tail
                if not new and not rest:
                    break
            if step.eof:
                source.held = step.unused_data
                break
        first = False
        if not step.eof:
            return
        while (head := source.peek(6)) and not head.lstrip(b"\0"):
            source.held = b""
        source.held = source.held.lstrip(b"\0")
        kind = _packed(source.peek(6))


def _windows(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The bytes in windows of up to WINDOW, each with the last OVERLAP of the one before; characters of UTF-8 stay whole."""
    held, fresh = bytearray(), False
    for chunk in chunks:
        held += chunk
        fresh = True
        if len(held) >= WINDOW:
            cut = len(held)
            while cut > len(held) - 4 and held[cut - 1] & 0xC0 == 0x80:
                cut -= 1
            cut -= held[cut - 1] >= 0xC0
            yield bytes(held[:cut])
            at = cut - OVERLAP
            while at < cut and held[at] & 0xC0 == 0x80 and at < cut - OVERLAP + 4:
                at += 1
            del held[:at]
            fresh = len(held) > cut - at
    if fresh:
        yield bytes(held)


def _unpacked(chunks: Iterable[bytes], seen: frozenset[bytes] = frozenset()) -> Iterator[bytes]:
    """The bytes, unpacked as often as they are compressed unless they unpack to themselves, and what stands behind compressed layers."""
    todo = [(Stream(chunks), seen)]
    while todo:
        source, seen = todo.pop()
        kind = _packed(source.peek(6))
        mark = hashlib.sha256(source.peek(4096)).digest() if kind else b""
        if mark in seen:  # unpacks to itself
            continue
        stream = _inflated(source, kind)
        try:
            head = _taken(stream, WINDOW) if kind else b""
        except zlib.error:  # text can begin like a compressed layer
            kind = 0
        if not kind:
            yield from _windows(source)
            continue
        seen |= {mark}
        if len(head) < WINDOW:
            todo.append((Stream([head]), seen))
        else:
            yield from _unpacked(chain([head], stream), seen)
        if source.peek(1):
            todo.append((source, seen))


def _taken(stream: Iterator[bytes], most: int) -> bytes:
    out = bytearray()
    for chunk in stream:
        out += chunk
        if len(out) >= most:
            break
    return bytes(out)


def _legible(data: bytes) -> Iterator[str]:
    """What decoded bytes may be as text: UTF-8, else a character for each byte; with zero bytes, also UTF-16 of either order."""
    for layer in _unpacked([data]):
        if not layer:
            continue
        try:
            yield layer.decode("utf-8")
        except UnicodeDecodeError:
            yield layer.decode("latin-1")
        if b"\0" in layer:
            for k in (0, 1):
                yield layer[k : len(layer) - (len(layer) - k) % 2].decode("utf-16-le", "replace")


def _base64(digits: str) -> bytes:
    """The bytes of base64 digits of either alphabet; a single digit at the end has none."""
    digits = digits[: len(digits) - (len(digits) % 4 == 1)].replace("-", "+").replace("_", "/")
    return base64.b64decode(digits + "=" * (-len(digits) % 4))


def _blob(blob: str) -> Iterator[str]:
    """Texts of a blob, which may be wrapped: base64 at each alignment and from each packed layer on, and hex."""
    lines = re.sub(r"[ \t\r=]", "", blob)
    bare = lines.replace("\n", "")
    for k in range(4):
        yield from _legible(_base64(bare[k:]))
    for m in PACKED.finditer(lines):
        if m.start() and _packed(_base64(lines[m.start() : m.start() + 12].replace("\n", ""))):
            yield from _legible(_base64(lines[m.start() :].replace("\n", "")))
    for m in HEX_BLOB.finditer(bare):
        for k in (0, 1):
            yield from _legible(bytes.fromhex(m[0][k : len(m[0]) - (len(m[0]) - k) % 2]))


def _point(m: re.Match) -> str:
    code = int(m[4]) if m[4] else int(m[1] or m[2] or m[3] or m[5], 16)
    return chr(code) if code < 0x110000 else m[0]


def _joined(text: str) -> str:
    """Surrogate pairs put together; a lone surrogate becomes U+FFFD."""
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def _substituted(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The whole layer with each run of escapes decoded; a decoded character stands for the span of its run."""
    text, starts, ends = layer
    if isinstance(starts, int):
        new, n = pattern.subn(lambda m: m[0] if (own := decode(m[0])) is None else own, text)
        return (new, starts, ends) if n and new != text else None
    out, lo, hi, last = [], [], [], 0
    at = np.arange(len(text)) if starts is None else starts
    to = np.arange(1, len(text) + 1) if ends is None else ends
    for m in pattern.finditer(text):
        new = decode(m[0])
        if new is None:
            continue
        a, b = m.span()
        out += [text[last:a], new]
        lo += [at[last:a], np.full(len(new), at[a])]
        hi += [to[last:a], np.full(len(new), to[a:b].max())]
        last = b
    if not out:
        return None
    return "".join([*out, text[last:]]), np.concatenate([*lo, at[last:]]), np.concatenate([*hi, to[last:]])


def _url(run: str) -> str | None:
    try:
        return unquote_to_bytes(run).decode("utf-8")
    except UnicodeDecodeError:
        return None


def unwrapped(layer: Layer) -> Iterator[Layer]:
    text, starts, ends = layer
    if "%" in text and (new := _substituted(layer, URL, _url)):
        yield new
    if ("\\" in text or "&#" in text) and (new := _substituted(layer, UNICODE, lambda run: _joined(ONE.sub(_point, run)))):
        yield new
    for m in chain(BLOB.finditer(text), WRAPPED.finditer(text)):
        a, b = m.span()
        lo, hi = _span(layer, a, b)
        for new in _blob(m[0]):
            yield new, lo, hi


def _span(layer: Layer, a: int, b: int) -> tuple[int, int]:
    """The span of the document that the characters [a, b) of a layer came from."""
    _, starts, ends = layer
    if starts is None:
        return a, b
    return (starts, ends) if isinstance(starts, int) else (int(starts[a:b].min()), int(ends[a:b].max()))


def scan(text: str) -> tuple[list[tuple[int, int, str]], set[tuple[int, int, str]]]:
    """Base spans, and all spans: those of decoded layers are the span of the text that they came from."""
    base = base_spans(text)
    found, seen = set(base), set()
    # Depth first, with a layer's own layers taken one after the other: one layer of each depth is held.
    todo = [unwrapped((text, None, None))]
    while todo:
        layer = next(todo[-1], None)
        if layer is None:
            todo.pop()
            continue
        body = layer[0]
        if not body:
            continue
        key = (hashlib.sha256(body.encode("utf-8", "surrogatepass")).digest(), *_span(layer, 0, len(body)))
        if key in seen:
            continue
        seen.add(key)
        for a, b, kind in base_spans(body):
            found.add((*_span(layer, a, b), kind))
        todo.append(unwrapped(layer))
    return base, found


def listed(spans: Iterable[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted((a, KINDS.index(k), b, k) for a, b, k in spans))


def secrets(docs: DataFrame) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_layered.

    The counts and base_sha256 are of the secrets in the text itself, spans of all with those of decoded layers
    (n_layered more), by start, then kind, then end, in code points. A compressed layer is read to its end; beyond
    WINDOW bytes it is read in windows that share OVERLAP bytes, so that only a secret, or a layer inside it, that is longer
    than those can be cut at their edge. Null text counts as empty and has none. Rows that
    repeat a doc_id are given as often as they come, a null doc_id stays null, other columns are ignored, no rows give none.
    """
    prepared(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            rows = []
            for t in texts(part):
                base, every = scan(t.decode("utf-8", "replace"))
                n = [sum(k == kind for *_, k in base) for kind in KINDS]
                rows.append((*n, hashlib.sha256(listed(base).encode()).hexdigest(), listed(every), len(every) - len(set(base))))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layered"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layered long")
