"""Secret scans with a recursive decoding worklist (operator 1).

A text is the first layer of a worklist. Each layer is scanned by all rules, and each encoded
region of it (percent-encoding, Unicode escapes and character references, base64, compressed bytes)
becomes a further layer, until no layer gives a new one. A layer whose content was already decoded
from the same place of the text, by whatever decoders, is dropped: that closes cycles, and several
orders of decoding that lead to one content go on as one. Every layer maps its characters to the
layer above, so findings carry the span of the original text that they come from.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import bz2
import hashlib
import lzma
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import slices

#: Bytes that one compressed region may unfold to. Of a larger one (a bomb, as a rule) the first so many bytes are scanned, and the rule
#: "oversized_layer" reports that there is more.
MAX_INFLATED = 64 << 20

RULES: dict[str, re.Pattern] = {
    "aws_access_key": re.compile(r"(?<![A-Za-z0-9])((?:AKIA|ASIA)[0-9A-Z]{16})(?![A-Za-z0-9])"),
    "github_token": re.compile(r"(?<![A-Za-z0-9])(gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9])"),
    "slack_token": re.compile(r"(?<![A-Za-z0-9])(xox[abeoprs]-[A-Za-z0-9-]{12,})"),
    "google_api_key": re.compile(r"(?<![A-Za-z0-9])(AIza[0-9A-Za-z_-]{35})(?![A-Za-z0-9_-])"),
    "payment_key": re.compile(r"(?<![A-Za-z0-9])([sr]k_(?:live|test)_[0-9A-Za-z]{16,})"),
    "model_api_key": re.compile(r"(?<![A-Za-z0-9_-])(sk-[A-Za-z0-9_-]{20,})"),
    "json_web_token": re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{14,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})"),
    "private_key": re.compile(r"(-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----)"),
    "url_credentials": re.compile(r"(?<![A-Za-z0-9])[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s/:@]{1,64}:([^\s/@]{3,128})@[A-Za-z0-9]"),
    "assigned_secret": re.compile(r"(?i)(?<![A-Za-z0-9])(?:[A-Za-z0-9]{1,24}[_.-]){0,3}(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?[ \t]{0,4}(?:=>|:=|[:=])[ \t]{0,4}[\"']?([^\s\"'`,;<>]{8,256})"),
}
#: A finding needs a long run of key characters or one of these; the quick look at whole slices uses it.
_LITERALS = re.compile(rb"-----BEGIN|://|%[0-9A-Fa-f]{2}|\\[uUx][0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]|&#[0-9xX]")
_KEYWORDS = (b"passw", b"pwd", b"secret", b"token", b"api_key", b"api-key", b"apikey", b"access_key", b"access-key", b"accesskey")
_RUN = 16
_IS_KEY = np.zeros(256, bool)
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-":
    _IS_KEY[_c] = True

_PERCENT = re.compile(r"%[0-9A-Fa-f]{2}")
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
#: Lines of 16 characters or more, and a shorter one after them: the end of a wrapped block, or a word that doesn't belong to it.
_BASE64 = re.compile(r"([A-Za-z0-9+/_-]{16,}(?:\r?\n[A-Za-z0-9+/_-]{16,})*)((?:\r?\n[A-Za-z0-9+/_-]{1,15})?)={0,2}")
_MAGIC = {b"\x1f\x8b": "gzip", b"BZh": "bzip2", b"\xfd7zXZ\x00": "xz", b"\x28\xb5\x2f\xfd": "zstd", b"\x78\x01": "zlib", b"\x78\x5e": "zlib", b"\x78\x9c": "zlib", b"\x78\xda": "zlib"}

_SKIPPED = re.compile(rb"[\x50-\x5f]\x2a\x4d\x18", re.S)

Span = tuple[int, int]


class Layer:
    """A decoded text (or bytes still to be unfolded) and the places of its characters in the layer above."""

    __slots__ = ("content", "path", "to_root")

    def __init__(self, content: str | bytes, path: tuple[str, ...], to_root: Callable[[int, int], Span]):
        self.content, self.path, self.to_root = content, path, to_root

    def key(self) -> tuple[bytes, Span]:
        """What is decoded, and from which place of the text."""
        raw = self.content if isinstance(self.content, bytes) else b"t" + self.content.encode("utf-8", "surrogatepass")
        return hashlib.blake2b(raw, digest_size=16).digest(), self.to_root(0, len(self.content))


def _through(starts: list[int], ends: list[int], up: Callable[[int, int], Span]) -> Callable[[int, int], Span]:
    return lambda a, b: up(starts[a], ends[b - 1])


def _word_runs(text: str, found: list[re.Match]) -> Iterator[tuple[int, int, list[re.Match]]]:
    """(start, end, matches) of the runs without white space around the matches."""
    i = 0
    while i < len(found):
        a = found[i].start()
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        b, j = found[i].end(), i
        while True:
            while j < len(found) and found[j].start() < b:
                b = max(b, found[j].end())
                j += 1
            if b >= len(text) or text[b].isspace():
                break
            b += 1
        yield a, b, found[i:j]
        i = j


def _percent(text: str) -> Iterator[tuple[str, str | bytes, list[int], list[int]]]:
    for a, b, found in _word_runs(text, list(_PERCENT.finditer(text))):
        out, starts, ends, at = bytearray(), [], [], a
        for m in [*found, None]:
            for p in range(at, m.start() if m else b):
                raw = text[p].encode("utf-8", "surrogatepass")
                out += raw
                starts += [p] * len(raw)
                ends += [p + 1] * len(raw)
            if m:
                out.append(int(m.group()[1:], 16))
                starts.append(m.start())
                ends.append(m.end())
                at = m.end()
        yield "url", *_as_text(bytes(out), starts, ends)


def _as_text(raw: bytes, starts: list[int], ends: list[int]) -> tuple[str | bytes, list[int], list[int]]:
    """Bytes as text with places by character; compressed bytes stay bytes."""
    if any(raw.startswith(m) for m in _MAGIC):
        return raw, starts, ends
    text, s, e, i = raw.decode("utf-8", "replace"), [], [], 0
    for c in text:
        n = len(c.encode()) if c != "\ufffd" else 1
        i = min(i, len(starts) - 1)
        s.append(starts[i])
        e.append(ends[min(i + n, len(ends)) - 1])
        i += n
    return text, s, e


def _escapes(text: str) -> Iterator[tuple[str, str, list[int], list[int]]]:
    """Runs without white space that hold escapes: one layer a run."""
    for a, b, found in _word_runs(text, list(_ESCAPE.finditer(text))):
        out, starts, ends, at = [], [], [], a
        for m in [*found, None]:
            for p in range(at, m.start() if m else b):
                out.append(text[p])
                starts.append(p)
                ends.append(p + 1)
            if m is None:
                continue
            digits = next(g for g in m.groups() if g is not None)
            code = int(digits, 10 if m.lastindex == 6 else 16)
            if out and 0xDC00 <= code < 0xE000 and 0xD800 <= ord(out[-1]) < 0xDC00:
                out[-1] = chr(0x10000 + ((ord(out[-1]) - 0xD800) << 10) + code - 0xDC00)
                ends[-1] = m.end()
            else:
                out.append(chr(code) if code < 0x110000 else "\ufffd")
                starts.append(m.start())
                ends.append(m.end())
            at = m.end()
        yield "unicode", "".join(out), starts, ends


def _plausible(raw: bytes) -> bool:
    if any(raw.startswith(m) for m in _MAGIC):
        return True
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return False
    return bool(text) and sum(c.isprintable() or c in "\t\r\n" for c in text) >= 0.95 * len(text)


def _decode64(run: str) -> bytes | None:
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    body = body[: len(body) - 1] if len(body) % 4 == 1 else body
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _base64(text: str) -> Iterator[tuple[str, str | bytes, list[int], list[int]]]:
    """The whole run, or its rest after one to three characters, or else each part between / _ and -, whichever decodes first.

    A run with a short last line is read with it, and once more without it unless padding or full lines before it show that it
    belongs there: it may as well be the next word. After a line that is shorter than the one before no further line is read.
    """
    for m in _BASE64.finditer(text):
        done = set()
        lines = [len(x.rstrip("\r")) for x in m.group(1).split("\n")]
        ended = len(lines) > 2 and lines[-1] < lines[-2]
        for end in (m.end(1),) if m.group(2) and ended else (m.end(), m.end(1)):
            kept = [i for i in range(m.start(), end) if text[i] not in "\r\n"]
            run = "".join(text[i] for i in kept)
            tries = [(k, run[k:]) for k in range(4)] + [(x.start(), x.group()) for x in re.finditer(r"[A-Za-z0-9+]{16,}={0,2}", run)]
            whole = False
            for k, part in tries:
                if (k, part) in done:
                    continue
                done.add((k, part))
                raw = _decode64(part)
                if raw and _plausible(raw):
                    place = kept[k:]
                    starts = [place[min(i * 8 // 6, len(place) - 1)] for i in range(len(raw))]
                    ends = [place[min((i * 8 + 7) // 6, len(place) - 1)] + 1 for i in range(len(raw))]
                    yield "base64", *_as_text(raw, starts, ends)
                    if k < 4 and len(part) == len(run) - k:
                        whole = any(raw.startswith(x) for x in _MAGIC) or len(part) % 4 == 0 and (part.endswith("=") or len(lines) > 1 and len(set(lines)) == 1)
                        break
            if whole or not m.group(2):
                break


def _inflate(raw: bytes, limit: int) -> tuple[str, bytes | None, bool]:
    """(kind of the first member, content of all of them or None, whether it is too large)."""
    first, out, rest = None, bytearray(), raw
    while len(out) <= limit and (kind := next((v for k, v in _MAGIC.items() if rest.startswith(k)), None)):
        first = first or kind
        try:
            member, rest = _member(kind, rest, limit + 1 - len(out))
        except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError):
            break
        out += member
        # zeros pad members; a frame of zstd that holds no data is skipped
        rest = rest.lstrip(b"\0")
        while _SKIPPED.match(rest):
            rest = rest[8 + int.from_bytes(rest[4:8], "little") :]
    return first, bytes(out[:limit]) if out else None, len(out) > limit


def _member(kind: str, raw: bytes, most: int) -> tuple[bytes, bytes]:
    """(content of the first member of a compressed region, up to ``most`` bytes or a little more, and what follows it)."""
    if kind == "zstd":
        d, out = zstandard.ZstdDecompressor().decompressobj(), bytearray()
        # at most 128 KB come from four bytes: small pieces keep a bomb from unfolding at once
        for at in range(0, len(raw), 256):
            out += d.decompress(raw[at : at + 256])
            if d.eof or len(out) >= most:
                return bytes(out), d.unused_data + raw[at + 256 :] if d.eof else b""
        return bytes(out), b""
    d = zlib.decompressobj(47) if kind in ("gzip", "zlib") else bz2.BZ2Decompressor() if kind == "bzip2" else lzma.LZMADecompressor()
    out = d.decompress(raw, most)
    return out, d.unused_data if d.eof else b""


def _children(layer: Layer, limit: int) -> Iterator[Layer | tuple[str, tuple[str, ...], Span]]:
    if isinstance(layer.content, bytes):
        kind, raw, large = _inflate(layer.content, limit)
        whole = layer.to_root(0, len(layer.content))
        if large:
            yield "oversized_layer", (*layer.path, kind), whole
        if raw:
            content = raw if any(raw.startswith(m) for m in _MAGIC) else raw.decode("utf-8", "replace")
            yield Layer(content, (*layer.path, kind), lambda a, b: whole)
        return
    for decoder in (_percent, _escapes, _base64):
        for kind, content, starts, ends in decoder(layer.content):
            if content:
                yield Layer(content, (*layer.path, kind), _through(starts, ends, layer.to_root))


def scan(text: str, limit: int = MAX_INFLATED) -> list[tuple[str, int, int, str, str]]:
    """(rule, start, end, layers, secret) of all findings; spans in characters of ``text``.

    A secret that several ways of decoding lead to at places that overlap counts once, by the
    shortest way.
    """
    todo, found = deque([Layer(text, (), lambda a, b: (a, b))]), []
    seen = {todo[0].key()}
    while todo:
        layer = todo.popleft()
        if isinstance(layer.content, str):
            for rule, pattern in RULES.items():
                for m in pattern.finditer(layer.content):
                    start, end = layer.to_root(m.start(1), m.end(1))
                    found.append((rule, start, end, layer.path, m.group(1)))
        for child in _children(layer, limit):
            if isinstance(child, Layer):
                if (key := child.key()) not in seen:
                    seen.add(key)
                    todo.append(child)
            else:
                rule, path, (start, end) = child
                found.append((rule, start, end, path, ""))
    kept: dict[tuple[str, str], list[tuple[int, int]]] = {}
    out = []
    for rule, start, end, path, secret in sorted(found, key=lambda x: (len(x[3]), x[1], x[2], x[0], x[3])):
        places = kept.setdefault((rule, secret), [])  # in order, without overlaps
        at = bisect.bisect_left(places, (start, end))
        if (at == 0 or places[at - 1][1] <= start) and (at == len(places) or end <= places[at][0]):
            places.insert(at, (start, end))
            out.append((rule, start, end, ">".join(path), secret))
    return sorted(out)


def suspects(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The documents of a slice in which a rule or a decoder can fire at all."""
    n = len(offsets) - 1
    rows = [np.zeros(0, np.int64)]
    edge = np.concatenate([[-1], np.flatnonzero(~_IS_KEY[raw]), [len(raw)]])
    long = np.flatnonzero(np.diff(edge) > _RUN)
    rows.append(np.searchsorted(offsets, edge[long] + 1, "right") - 1)
    # a run may go on over a document's end: both sides are suspects
    rows.append(np.searchsorted(offsets, np.minimum(edge[long + 1], len(raw)) - 1, "right") - 1)
    for a, b in zip(edge[long] + 1, edge[long + 1], strict=True):
        inner = offsets[np.searchsorted(offsets, a, "right") : np.searchsorted(offsets, b, "left")]
        if len(inner):
            rows.append(np.searchsorted(offsets, inner, "right") - 1)
    data = raw.tobytes()
    places = [m.start() for m in _LITERALS.finditer(data)]
    low = data.lower()
    for word in _KEYWORDS:
        at = low.find(word)
        while at >= 0:
            places.append(at)
            at = low.find(word, at + 1)
    rows.append(np.searchsorted(offsets, np.array(places, np.int64), "right") - 1)
    every = np.unique(np.concatenate(rows))
    return every[(every >= 0) & (every < n)]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_inflated: int = MAX_INFLATED) -> DataFrame:
    """(doc_id, rule, start, end, layers, digest): every secret, where it stands in the text, and the decoders that lead to it.

    ``start`` and ``end`` count characters of the text; ``layers`` names decoders from the outside
    ("" for plain text); ``digest`` is the secret's SHA-256, so that reports don't repeat secrets.

    One pass without a shuffle. Each row is scanned by itself, so rows that repeat give their
    findings again, and null ids are kept. Null and empty texts have none. Texts of any length are
    scanned whole; of a compressed region that unfolds to more than ``max_inflated`` bytes the first
    ones are scanned, and a finding of the rule "oversized_layer" marks it. Layers that are nested
    in several encodings at once are decoded once each, whatever the orders that lead to them. Other
    columns, whatever their names, are not read. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for a, _, raw, offsets in slices(batch.column(1)):
                for i in suspects(raw, offsets).tolist():
                    text = raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
                    found += [(a + i, *x) for x in scan(text, max_inflated)]
            if found:
                row, rule, start, end, layers, secret = zip(*found, strict=True)
                digest = [hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest() for s in secret]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array(rule), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(layers), pa.array(digest)],
                    ["doc_id", "rule", "start", "end", "layers", "digest"],
                )

    return rows.mapInArrow(run, "doc_id long, rule string, start int, end int, layers string, digest string")
