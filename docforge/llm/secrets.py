"""Secret scans through nested encodings: a worklist of decoded layers, each scanned and mapped back."""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import mmap
import re
import tempfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import kernel
from .common import documents

KINDS = ("assign", "access", "hex")
#: The least length of group 2 of an assignment, of an access key and of a hex run.
LEAST = {"assign": 6, "access": 20, "hex": 24}
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
ESCAPE = re.compile(rb"%[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#x[0-9A-Fa-f]{1,6};|&#[0-9]{1,7};")
BASE64_RUN = re.compile(rb"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 over several lines, and what no layer that matters lacks, but for a compressed stream: as many printable bytes as the shortest match.
WRAPPED = re.compile(rb"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}+\r?\n[\x20\t]*+)+[A-Za-z0-9+/_-]++={0,2}")
PRINTED = re.compile(rb"[\t-\r\x20-\x7e]{12}")
#: The heads of zlib streams: deflate with a window of 256 bytes to 32 KB, no preset dictionary, divisible by 31.
ZLIB = [bytes([a, b]) for a in range(0x08, 0x80, 0x10) for b in range(256) if not b & 0x20 and (a << 8 | b) % 31 == 0]
#: Where a gzip, bzip2, xz or zlib stream may begin.
STREAM = re.compile(rb"(?=[B\x1f\xfd\x08\x18(8HXhx])(?=\x1f\x8b\x08|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\x00|" + b"|".join(map(re.escape, ZLIB)) + rb")", re.S)
#: Compressed bytes taken, and bytes made of them, at a time; a decoded layer larger than PIECE lies in a temporary file.
STEP, PIECE = 1 << 14, 1 << 20
FAULTS = (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError)
#: Runs of ASCII in two or four bytes a character, either end first: pattern, width, place of the character.
WIDE = [(re.compile(rb"(?:" + b"\\0" * at + rb"[\t-\r\x20-\x7e]" + b"\\0" * (width - 1 - at) + rb"){6,}"), width, at) for width, at in ((2, 0), (2, 1), (4, 0), (4, 3))]

URL_SAFE = bytes.maketrans(b"-_", b"+/")
_HEX = np.zeros(256, bool)
_HEX[[*range(48, 58), *range(97, 103)]] = True
_B64 = np.zeros(256, bool)
_B64[[*range(48, 58), *range(65, 91), *range(97, 123), 43, 47, 45, 95]] = True


def _matches(text: bytes):
    yield from (("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"])
    yield from (("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"])
    yield from (("hex", *m.span()) for m in HEX.finditer(text))


def base_matches(text: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes; leftmost, non-overlapping for each kind."""
    return list(_matches(text))


def _decoder(data: bytes, at: int):
    """A decoder for the gzip, zlib, bzip2 or xz stream that may begin at ``at``; None where none can."""
    head = data[at : at + 10]
    if head[:3] == b"\x1f\x8b\x08" or (len(head) > 2 and head[:2] in ZLIB):
        return zlib.decompressobj(47)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


def _fed(out, data: bytes, at: int, stop: list):
    """Chunks that ``out`` makes of the bytes from ``at``; ``stop`` gets where it ended, and whether at an end of stream."""
    while at < len(data) and not out.eof:
        rest = data[at : at + STEP]
        at += len(rest)
        try:
            while True:
                was = out.copy() if hasattr(out, "copy") else None
                yield (got := out.decompress(rest, PIECE))
                rest = getattr(out, "unconsumed_tail", b"")
                if out.eof or not (rest or (len(got) == PIECE if was is not None else not out.needs_input)):
                    break
        except FAULTS:
            for k in range(len(rest) if was is not None else 0):  # what comes before the fault
                try:
                    yield was.decompress(rest[k : k + 1])
                except FAULTS:
                    break
            stop[:] = at, False
            return
    stop[:] = at - len(out.unused_data), out.eof


def _stream(data: bytes, at: int, stop: list):
    """The content of the streams that follow each other from ``at``, as far as they can be decoded."""
    while (out := _decoder(data, at)) is not None:
        yield from _fed(out, data, at, stop)
        if not stop[1]:
            return
        at = stop[0]
        pad = at
        while data[pad : pad + 1] == b"\0":
            pad += 1
        at = pad if _decoder(data, pad) is not None else at


def _whole(chunks):
    """All chunks as one layer: bytes, or a mapped temporary file where they are more than PIECE."""
    held, size, file = [], 0, None
    for chunk in chunks:
        held.append(chunk)
        size += len(chunk)
        if size > PIECE:
            file = file or tempfile.TemporaryFile()
            file.write(b"".join(held))
            held, size = [], 0
    if file is None:
        return b"".join(held)
    with file:
        file.write(b"".join(held))
        file.flush()
        return mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)


def _spread(low: np.ndarray, high: np.ndarray, n: int):
    """The source range of some bytes, for each of ``n`` bytes made of them; takes no memory for each."""
    return np.broadcast_to(low[0] if _one(low) else low.min(), n), np.broadcast_to(high[0] if _one(high) else high.max(), n)


def _one(places: np.ndarray) -> bool:
    """Whether all bytes stand for the same place, as those of a compressed stream do."""
    return places.strides == (0,)


def _inflate(data: bytes, low: np.ndarray, high: np.ndarray):
    """The content of compressed streams anywhere in a layer."""
    done = 0
    for m in STREAM.finditer(data):
        at = m.start()
        if at < done or _decoder(data, at) is None:
            continue
        stop = [at, False]
        got = _whole(_stream(data, at, stop))
        if got:
            yield got, *_spread(low[at : max(stop[0], at + 1)], high[at : max(stop[0], at + 1)], len(got))
        if stop[1]:
            done = stop[0]


def _spaced(data: bytes) -> bool:
    """Whether six zero bytes stand two or four bytes apart, as all wide ASCII has them."""
    for k in range(0, len(data), PIECE):
        zero = np.frombuffer(data[k : k + PIECE + 24], np.uint8) == 0
        if any(len(zero) > 5 * w and np.logical_and.reduce([zero[i * w : len(zero) - (5 - i) * w] for i in range(6)]).any() for w in (2, 4)):
            return True
    return False


def _narrow(data: bytes, low: np.ndarray, high: np.ndarray):
    """ASCII that is written with zero bytes between, as UTF-16 and UTF-32 do."""
    for pattern, width, at in WIDE if _spaced(data) else ():
        for m in pattern.finditer(data):
            a, b = m.span()
            got = _whole(data[k + at : min(k + PIECE, b) : width] for k in range(a, b, PIECE))
            yield got, low[a:b:width], high[a + width - 1 : b : width]


def _plain(s: bytes) -> bytes | None:
    """What an escape stands for; None if for nothing."""
    if s[:1] == b"%":
        return bytes([int(s[1:], 16)])
    code = int(s[2:-1]) if s[:2] == b"&#" and s[2:3] != b"x" else int(re.sub(rb"[^0-9A-Fa-f]", b"", s[3:] if s[:3] == b"&#x" else s[2:]), 16)
    if s[:2] == b"\\x" and code >= 128:
        return bytes([code])
    return None if code > 0x10FFFF or 0xD800 <= code <= 0xDFFF else chr(code).encode()


def _unescape(data: bytes, low: np.ndarray, high: np.ndarray):
    """One pass over URL and Unicode escapes; the new bytes and, for each, the source range it stands for."""
    if _one(low):
        changed = [False]

        def chunks():
            at = 0
            for m in ESCAPE.finditer(data):
                if (got := _plain(m[0])) is not None:
                    changed[0] = True
                    yield from (data[k : min(k + PIECE, m.start())] for k in range(at, m.start(), PIECE))
                    yield got
                    at = m.end()
            if changed[0]:
                yield from (data[k : k + PIECE] for k in range(at, len(data), PIECE))

        whole = _whole(chunks())
        return (whole, *_spread(low, high, len(whole))) if changed[0] else None
    parts, lows, highs, at = [], [], [], 0
    for m in ESCAPE.finditer(data):
        if (got := _plain(m[0])) is None:
            continue
        parts += [data[at : m.start()], got]
        lows += [low[at : m.start()], np.full(len(got), low[m.start()])]
        highs += [high[at : m.start()], np.full(len(got), high[m.end() - 1])]
        at = m.end()
    if not parts:
        return None
    return b"".join([*parts, data[at:]]), np.concatenate([*lows, low[at:]]), np.concatenate([*highs, high[at:]])


def _joined(data: bytes, low: np.ndarray, high: np.ndarray):
    """Base64 that is broken into lines, as one run."""
    for m in WRAPPED.finditer(data):
        a, b = m.span()
        got = m[0].translate(None, b" \t\r\n")
        if _one(low):
            yield got, *_spread(low, high, len(got))
        else:
            at = a + np.flatnonzero(_B64[np.frombuffer(m[0], np.uint8)])
            yield got[: len(at)], low[at], high[at]  # without the padding


def _promising(data: bytes) -> bool:
    """Whether a layer can hold a match or another layer; a stream has to yield at least one byte."""
    return bool(PRINTED.search(data) or _spaced(data) or any(any(_stream(data, m.start(), [0, False])) for m in STREAM.finditer(data)))


def _unpack(data: bytes, low: np.ndarray, high: np.ndarray):
    """Layers inside base64 runs, be they text or not; a run may begin with up to three letters of something else, or any more."""
    for m in BASE64_RUN.finditer(data):
        start, b = m.span()
        for a in range(start, start + 4):
            n = b - a - (data[b - 1 : b] == b"=") - (data[b - 2 : b] == b"==")
            n -= n % 4 == 1
            yield from _decoded(data, low, high, a, n, b)


def _decoded(data: bytes, low: np.ndarray, high: np.ndarray, a: int, n: int, b: int):
    """The layer of ``n`` base64 letters from ``a``, of a run that ends at ``b``."""
    got = _whole(base64.b64decode(data[k : min(k + PIECE, a + n)].translate(URL_SAFE) + b"=" * (-(min(k + PIECE, a + n) - k) % 4)) for k in range(a, a + n, PIECE))
    if not _promising(got):
        return
    if _one(low):
        yield got, *_spread(low, high, len(got))
    else:
        group = a + np.arange(len(got)) // 3 * 4
        yield got, low[group], high[np.minimum(group + 3, b - 1)]


def _nested(data: bytes, low: np.ndarray, high: np.ndarray):
    """Every layer one encoding below."""
    yield from _inflate(data, low, high)
    yield from _narrow(data, low, high)
    yield from _unpack(data, low, high)
    yield from _joined(data, low, high)
    if (plain := _unescape(data, low, high)) is not None:
        yield plain


def deep_matches(text: bytes) -> list[tuple[str, int, int]]:
    """Matches of the text and of every layer nested in it, at the bytes of the text that carry them.

    The worklist holds layers still to unwrap: each is searched for compressed streams, wide ASCII, base64 runs and
    escapes, whether it is clean text or not; base64 may be broken into lines or follow other letters without a gap. A layer whose content and place were met before is not
    taken again, which ends cycles; every other step takes off one encoding, so the fixpoint is reached.
    Layers are unwrapped one at a time, and one of any size is scanned whole: above PIECE it lies in a
    temporary file of the task, so that disk, not memory, grows with it.
    """
    found = dict.fromkeys(base_matches(text))
    n = np.arange(len(text))
    work, met = [iter([(text, n, n + 1)])], set()
    while work:
        if (layer := next(work[-1], None)) is None:
            work.pop()
            continue
        data, low, high = layer
        key = (hashlib.sha256(data).digest(), int(low[0]) if len(low) else 0, int(high[-1]) if len(high) else 0)
        if key in met:
            continue
        met.add(key)
        if len(work) > 1:
            for kind, a, b in _matches(data):
                x, y = (low[a:b], high[a:b]) if not _one(low) else (low[:1], high[:1])
                found.setdefault((kind, int(x.min()), int(y.max())))
        work.append(_nested(*layer))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(found, key=lambda x: (x[1], order[x[0]], x[2]))


def _suspects(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of a slice that can hold a match or an encoded layer, from a few passes over all its bytes; all that ``deep_matches`` finds is in one."""
    raw = data.tobytes()
    low = raw.lower()
    hits: list[int] = []
    for body, needles in ((low, (b"passw", b"secret", b"token", b"apikey", b"api_key")), (raw, (b"AKIA", b"\\u", b"\\U", b"\\x", b"&#"))):
        for needle in needles:
            at = body.find(needle)
            while at >= 0:
                hits.append(at)
                at = body.find(needle, at + 1)
    spots = [np.array(hits, np.int64), np.flatnonzero(data == 0), np.fromiter((m.start() for m in STREAM.finditer(raw)), np.int64)]
    percent = np.flatnonzero(data[:-2] == 37) if len(data) > 2 else np.zeros(0, np.int64)
    both = b"0123456789ABCDEFabcdef"
    digit = np.isin(data, np.frombuffer(both, np.uint8)) if len(percent) else None
    if digit is not None:
        spots.append(percent[digit[percent + 1] & digit[percent + 2]])
    for kind, least in ((_HEX, LEAST["hex"]), (_B64, 16)):
        starts, ends, _ = kernel.word_bounds(data, offsets, kind)
        spots.append(starts[ends - starts >= least])
    return np.unique(np.searchsorted(offsets, np.concatenate(spots), "right") - 1)


def scan_batches(batches):
    """Arrow batches (doc_id, text) to (doc_id, counts, digest, spans); see ``scan_secrets``."""
    empty = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        n = batch.num_rows
        counts = {k: np.zeros(n, np.int64) for k in KINDS}
        shas, spans = [empty] * n, [""] * n
        for row, data, offsets in kernel.slices(batch.column(1)):
            for r in _suspects(data, offsets).tolist():
                text = data[offsets[r] : offsets[r + 1]].tobytes()
                every = deep_matches(text)
                if not every:
                    continue
                own = set(base_matches(text))
                point = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
                said = [(f"{k}:{point[a]}:{point[b]}", (k, a, b) in own, k) for k, a, b in every]
                for _, is_base, k in said:
                    counts[k][row + r] += is_base
                shas[row + r] = hashlib.sha256(",".join(s for s, is_base, _ in said if is_base).encode()).hexdigest()
                spans[row + r] = ",".join(s for s, _, _ in said)
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(counts[k]) for k in KINDS], pa.array(shas), pa.array(spans)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row's whole text.

    The counts and the digest cover matches in the text itself; ``spans`` adds those found in URL, Unicode, base64
    and compressed layers, at the characters that carry them. One pass, no shuffle; memory follows the
    slice and the longest text. Null and empty texts have no match (counts 0, spans ''). Null ids, ties
    and repeated rows each give their row; no rows give none.
    """
    return docs.select("doc_id", "text").mapInArrow(scan_batches, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """The table with every found span of ``text`` replaced by [REDACTED]; overlapping spans become one.

    ``n_chars``, where the table has it, becomes the new length. Rows without a match are unchanged, as are null and empty
    texts; null ids and repeated rows each give their row, no rows none.
    """
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def cleaned(batches):
        for batch in batches:
            texts = batch.column(at)
            changed: dict[int, str] = {}
            for row, data, offsets in kernel.slices(texts):
                for r in _suspects(data, offsets).tolist():
                    text = data[offsets[r] : offsets[r + 1]].tobytes()
                    spans: list[list[int]] = []
                    for _, a, b in deep_matches(text):
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = max(b, spans[-1][1])
                        else:
                            spans.append([a, b])
                    if spans:
                        out, last = [], 0
                        for a, b in spans:
                            out += [text[last:a], b"[REDACTED]"]
                            last = b
                        changed[row + r] = b"".join([*out, text[last:]]).decode("utf-8", "replace")
            columns = list(batch.columns)
            if changed:
                values = texts.to_pylist()
                for r, v in changed.items():
                    values[r] = v
                columns[at] = pa.array(values, texts.type)
                if size is not None:
                    sizes = columns[size].to_pylist()
                    for r, v in changed.items():
                        sizes[r] = len(v)
                    columns[size] = pa.array(sizes, columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(cleaned, docs.schema)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scanned."""
    return scan_secrets(documents(spark, sf_dir))
