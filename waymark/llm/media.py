"""Media columns: signature sniffing, validation, type correction and carving.

One Aho-Corasick automaton locates the magic bytes of all formats in one pass
over a binary value. A validator per format then confirms structure and lengths,
so a signature that occurs by chance is dropped. A format confirmed at byte 0
corrects the declared type; a declared type of these formats that isn't confirmed
becomes unknown, and one of other formats stays. Those confirmed further in are
embedded media, which are carved out by the confirmed length.

A null value counts as empty: type `application/octet-stream`, nothing embedded; an
empty table gives no rows. Repeated rows give equal results. Of several formats at one
place the one with the longest signature counts. A very long value is held once, with
what is carved from it. Extra columns pass through unless they have the name of a
result column.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import carried, extended, quoted, text_of, unused
from ._workers import batchwise

UNKNOWN = "application/octet-stream"
#: Fixed values of the formats: magic bytes by type.
MAGIC = {
    "image/png": [b"\x89PNG\r\n\x1a\n"],
    "image/jpeg": [b"\xff\xd8\xff"],
    "image/gif": [b"GIF87a", b"GIF89a"],
    "image/bmp": [b"BM"],
    "audio/wav": [b"RIFF"],
    "audio/flac": [b"fLaC"],
    "application/ogg": [b"OggS"],
    "application/pdf": [b"%PDF-"],
    "application/zip": [b"PK\x03\x04"],
    "application/gzip": [b"\x1f\x8b\x08"],
}
RATE = 8000


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, marks in MAGIC.items():
        for mark in marks:
            found.add_word(mark.decode("latin-1"), (len(mark), kind))
    found.make_automaton()
    return found


def _png(data, at):
    p = at + 8
    first = True
    while p + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, p)
        if first and (kind != b"IHDR" or size != 13) or p + 12 + size > len(data):
            return 0
        if zlib.crc32(data[p + 4 : p + 8 + size]) != struct.unpack_from(">I", data, p + 8 + size)[0]:
            return 0
        p, first = p + 12 + size, False
        if kind == b"IEND":
            return p - at
    return 0


def _jpeg(data, at):
    p, seen_scan = at + 2, False
    while p + 4 <= len(data):
        if data[p] != 0xFF:
            return 0
        mark = data[p + 1]
        if mark == 0xD9:
            return p + 2 - at if seen_scan else 0
        size = struct.unpack_from(">H", data, p + 2)[0]
        if size < 2 or p + 2 + size > len(data):
            return 0
        p += 2 + size
        if mark == 0xDA:
            seen_scan = True
            while (p := data.find(b"\xff", p)) >= 0 and p + 1 < len(data) and (data[p + 1] == 0 or 0xD0 <= data[p + 1] <= 0xD7):
                p += 2
            if p < 0 or p + 1 >= len(data):
                return 0
            if data[p + 1] == 0xD9:
                return p + 2 - at
    return 0


def _gif(data, at):
    if at + 13 > len(data):
        return 0
    p = at + 13 + (3 << ((data[at + 10] & 7) + 1) if data[at + 10] & 0x80 else 0)

    def blocks(p):
        while p < len(data) and data[p]:
            p += data[p] + 1
        return p + 1

    while p < len(data):
        if data[p] == 0x3B:
            return p + 1 - at
        if data[p] == 0x21:
            p = blocks(p + 2)
        elif data[p] == 0x2C and p + 10 <= len(data):
            p = blocks(p + 10 + (3 << ((data[p + 9] & 7) + 1) if data[p + 9] & 0x80 else 0) + 1)
        else:
            return 0
    return 0


def _bmp(data, at):
    if at + 54 > len(data):
        return 0
    size, zero, start, header, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", data, at + 2)
    fits = 54 <= size <= len(data) - at and zero == 0 and header in (40, 108, 124) and 14 + header <= start <= size
    row = (width * bits + 31) // 32 * 4
    whole = planes == 1 and bits in (1, 4, 8, 16, 24, 32) and width > 0 and height != 0 and start + row * abs(height) <= size
    return size if fits and whole else 0


def _wav(data, at):
    if at + 12 > len(data) or data[at + 8 : at + 12] != b"WAVE":
        return 0
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    if end > len(data):
        return 0
    p, form, samples = at + 12, False, False
    while p + 8 <= end:
        kind, size = struct.unpack_from("<4sI", data, p)
        if p + 8 + size > end:
            return 0
        form, samples, p = form or kind == b"fmt " and size >= 16, samples or form and kind == b"data", p + 8 + size + size % 2
    return end - at if form and samples and p == end else 0


def _crc_table(poly: int, bits: int) -> list[int]:
    out = []
    for n in range(256):
        n <<= bits - 8
        for _ in range(8):
            n = n << 1 ^ (poly if n >> bits - 1 else 0)
            n &= (1 << bits) - 1
        out.append(n)
    return out


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _flac_frame(data, at, depth):
    """Length and samples of the frame at `at`, read bit by bit as its residuals have no lengths; 0, 0 if it isn't one."""
    if at + 6 > len(data) or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8 or data[at + 3] & 1:
        return 0, 0
    size, rate, channels, bits = data[at + 2] >> 4, data[at + 2] & 15, data[at + 3] >> 4, data[at + 3] >> 1 & 7
    depth = (depth, 8, 12, 0, 16, 20, 24, 32)[bits]
    if not size or rate == 15 or channels > 10 or not depth:
        return 0, 0
    p = at + 5
    lead = data[at + 4]
    if lead & 0x80:
        more = 8 - (lead ^ 0xFF).bit_length() - 1
        if not 1 <= more <= 6:
            return 0, 0
        p += more
    if p + 5 > len(data):
        return 0, 0
    if size == 6:
        n, p = data[p] + 1, p + 1
    elif size == 7:
        n, p = struct.unpack_from(">H", data, p)[0] + 1, p + 2
    else:
        n = 192 if size == 1 else 576 << size - 2 if size < 6 else 256 << size - 8
    p += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    crc = 0
    for b in data[at : p + 1]:
        crc = CRC8[crc ^ b]
    if crc or p >= len(data):
        return 0, 0
    count = channels + 1 if channels < 8 else 2
    most = 64 + count * (n * (depth + 2) // 8 + 64)
    while True:
        part = data[p + 1 : p + 1 + most]
        end = _flac_subframes(bin(int.from_bytes(b"\1" + part, "big"))[3:], n, [depth + (channels == 9 and c == 0 or channels in (8, 10) and c == 1) for c in range(count)])
        if end is not None or p + 1 + most >= len(data):
            break
        most *= 2
    if not end:
        return 0, 0
    end = p + 1 + -(-end // 8) + 2
    if end > len(data):
        return 0, 0
    crc = 0
    for b in data[at:end]:
        crc = (crc << 8 & 0xFFFF) ^ CRC16[crc >> 8 ^ b]
    return (0, 0) if crc else (end - at, n)


def _flac_subframes(bits, n, depths):
    """The number of bits that the subframes take; 0 if they aren't valid, None if the bits don't reach."""
    p = 0
    try:
        for depth in depths:
            kind = int(bits[p + 1 : p + 7], 2)
            if bits[p] == "1":
                return 0
            p += 8
            if bits[p - 1] == "1":
                q = bits.index("1", p)
                depth, p = depth - (q - p + 1), q + 1
            if depth < 1:
                return 0
            if kind == 0:
                p += depth
            elif kind == 1:
                p += depth * n
            elif 8 <= kind <= 12 or kind >= 32:
                order = kind - 8 if kind < 32 else kind - 31
                p += order * depth
                if kind >= 32:
                    width = int(bits[p : p + 4], 2) + 1
                    p += 9 + width * order
                method, parts = int(bits[p : p + 2], 2), 1 << int(bits[p + 2 : p + 6], 2)
                if method > 1 or n % parts or n // parts < order:
                    return 0
                p, wide = p + 6, 4 + method
                for k in range(parts):
                    rice, p = int(bits[p : p + wide], 2), p + wide
                    left = n // parts - (order if k == 0 else 0)
                    if rice == (1 << wide) - 1:
                        p += 5 + left * int(bits[p : p + 5], 2)
                        continue
                    for _ in range(left):
                        p = bits.index("1", p) + 1 + rice
            else:
                return 0
    except (ValueError, IndexError):
        return None
    return p if p <= len(bits) else None


def _flac(data, at):
    if at + 42 > len(data) or data[at + 4] & 0x7F or data[at + 5 : at + 8] != b"\0\0\x22":
        return 0
    depth = (data[at + 20] & 1) << 4 | data[at + 21] >> 4
    total = int.from_bytes(data[at + 21 : at + 26], "big") & (1 << 36) - 1
    p, last = at + 4, 0
    while not last:
        if p + 4 > len(data) or data[p] & 0x7F == 0x7F:
            return 0
        last, p = data[p] & 0x80, p + 4 + int.from_bytes(data[p + 1 : p + 4], "big")
    if p > len(data):
        return 0
    samples = 0
    while not total or samples < total:
        size, n = _flac_frame(data, p, depth + 1)
        if not size:
            break
        p, samples = p + size, samples + n
    return p - at if samples >= total else 0


def _ogg(data, at):
    """To the end of all streams that begin together; without a last page, to the end of the pages."""
    p, streams, beginning = at, set(), True
    while data[p : p + 4] == b"OggS" and p + 27 <= len(data) and data[p + 4] == 0 and data[p + 5] < 8:
        table = data[p + 27 : p + 27 + data[p + 26]]
        end = p + 27 + len(table) + sum(table)
        if len(table) < data[p + 26] or end > len(data):
            return 0
        flags, serial = data[p + 5], data[p + 14 : p + 18]
        beginning = beginning and bool(flags & 2)
        if p == at and not flags & 2 or not streams and not beginning:
            break
        if flags & 2:
            streams.add(serial)
        if flags & 4:
            streams.discard(serial)
        p = end
    return p - at


_PDF_HEAD, _PDF_END, _PDF_TABLE = re.compile(rb"%PDF-\d\.\d[\r\n]"), re.compile(rb"startxref\s+(\d{1,19})\s+%%EOF"), re.compile(rb"\s*(xref\s|\d+\s+\d+\s+obj)")


class Marks:
    """Where PDF heads and ends and zip ends lie in a value, found once for all of its signatures."""

    def __init__(self, data: bytes):
        self.data = data

    @cached_property
    def heads(self) -> list[int]:
        return [m.start() for m in _PDF_HEAD.finditer(self.data)]

    @cached_property
    def ends(self) -> np.ndarray:
        """Start, end and startxref of each PDF end."""
        return np.array([(m.start(), m.end(), int(m[1])) for m in _PDF_END.finditer(self.data) if int(m[1]) < len(self.data)], np.int64).reshape(-1, 3)

    @cached_property
    def zips(self) -> dict[int, int]:
        """Where an archive ends that begins at a place: at the first end record that fits."""
        out, data, end = {}, self.data, -1
        while (end := data.find(b"PK\x05\x06", end + 1)) >= 0 and end + 22 <= len(data):
            size, start, note = struct.unpack_from("<IIH", data, end + 12)
            tail = end
            begin = tail - size - start
            if end >= 20 and data[end - 20 : end - 16] == b"PK\x06\x07":
                tail = data.rfind(b"PK\x06\x06", 0, end - 20)
                if tail < 0 or tail + 56 > end:
                    continue
                size, start = struct.unpack_from("<QQ", data, tail + 40)
                begin = tail - size - start
                if begin + struct.unpack_from("<Q", data, end - 12)[0] != tail:
                    continue
            if begin >= 0 and data[begin + start : begin + start + 4] == b"PK\x01\x02" and end + 22 + note <= len(data):
                out.setdefault(begin, end + 22 + note)
        return out


def _pdf(marks, at):
    """To the last %%EOF whose startxref points into the file, or else the last one with a startxref before the next file's head."""
    k = bisect_left(marks.heads, at)
    if k == len(marks.heads) or marks.heads[k] != at:
        return 0
    after = marks.heads[k + 1] if k + 1 < len(marks.heads) else len(marks.data)
    start, end, target = marks.ends.T
    target = target + at
    # past another head, only what points past it belongs to this file and not to the other
    fits = (at < target) & (target < start) & ((after <= target) | (start < after))
    for j in np.flatnonzero(fits)[::-1].tolist():
        if _PDF_TABLE.match(marks.data, int(target[j])):
            return int(end[j]) - at
    loose = np.flatnonzero((start >= at) & (end <= after))
    return int(end[loose[-1]]) - at if len(loose) else 0


def _zip(marks, at):
    return marks.zips.get(at, at) - at


def _gzip(data, at):
    """All members that follow each other."""
    p = at
    while data[p : p + 3] == b"\x1f\x8b\x08" and (size := _member(data, p)):
        p += size
    return p - at


def _member(data, at):
    try:
        work = zlib.decompressobj(31)
        step, p = 1 << 16, at
        while p < len(data) and not work.eof:
            rest = data[p : p + step]
            while rest and not work.eof:
                work.decompress(rest, step)
                rest = work.unconsumed_tail
            p += step
        return min(p, len(data)) - len(work.unused_data) - at if work.eof else 0
    except zlib.error:
        return 0


VALID = {"image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "audio/wav": _wav, "audio/flac": _flac, "application/ogg": _ogg, "application/gzip": _gzip}
#: Those that look at marks far behind the signature.
VALID_BY_MARKS = {"application/pdf": _pdf, "application/zip": _zip}


#: Formats whose parts begin like the whole.
CHAINED = ("application/ogg", "application/gzip")


def sniff(data: bytes) -> list[tuple[int, int, str]]:
    """Start, length and type of each confirmed format, in order; those inside a carved one are left out."""
    found, past, marks = [], 0, Marks(data)
    for last, (size, kind) in sorted((x for x in automaton().iter(data.decode("latin-1"))), key=lambda x: (x[0] - x[1][0], -x[1][0])):
        at = last + 1 - size
        if at < past or found and found[0][0] == 0 and kind == found[0][2] in CHAINED and at < found[0][1]:
            continue
        if length := VALID[kind](data, at) if kind in VALID else VALID_BY_MARKS[kind](marks, at):
            found.append((at, length, kind))
            past = at + length if at else 0  # what a whole-value format holds is looked at too
    return found


def to_wav(payload: bytes) -> bytes:
    """The payload as the samples of an 8-bit mono PCM file."""
    pad = len(payload) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * pad


def wav_samples(media: bytes) -> bytes:
    """The samples of a confirmed file, found by walking its chunks."""
    p = 12
    while p + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, p)
        if kind == b"data":
            return media[p + 8 : p + 8 + size]
        p += 8 + size + size % 2
    raise ValueError("no data chunk")


def media_columns(df: DataFrame, value: str, declared: str | None = None) -> DataFrame:
    """df with media_type, type_corrected (it differs from the declared one) and embedded.

    value: a binary column. embedded: offset, length, type, sha256 and bytes of each carved file.
    Columns of df with these names are replaced.
    """
    own = ["media_type", "type_corrected", "embedded"]
    kept = carried(df, own)
    kinds = "media_type string, type_corrected boolean, embedded array<struct<offset:bigint,length:bigint,type:string,sha256:string,content:binary>>"
    schema = extended(df.select(*quoted(kept)).schema, kinds)
    kind_of_embedded = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("sha256", pa.string()), ("content", pa.binary())]))

    def run(batches):
        for batch in batches:
            values = batch.column(kept.index(value))
            claims = batch.column(kept.index(declared)).to_pylist() if declared else [None] * len(values)
            types, inner = [], []
            for v in values:
                data = v.as_py() or b""
                found = sniff(data)
                claim = claims[len(types)]
                # a declared type without a validator here can't be refuted
                types.append(found[0][2] if found and found[0][0] == 0 else UNKNOWN if claim is None or claim in MAGIC else claim)
                inner.append([{"offset": a, "length": n, "type": k, "sha256": hashlib.sha256(data[a : a + n]).hexdigest(), "content": data[a : a + n]} for a, n, k in found if a])
            columns = [pa.array(types), pa.array([c is not None and c != t for c, t in zip(claims, types, strict=True)]), pa.array(inner, kind_of_embedded)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*kept, *own])

    return df.select(*quoted(kept)).mapInArrow(batchwise(run), schema)


def texts_as_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text stored as sampled sound, sniffed, read back, with figures of what came back.

    The feature names the sniffed type, the samples, how many distinct values they
    take, their mean, and the types embedded; equal texts give equal features.
    """
    schema = f"`{key}` {dict(df.dtypes)[key]}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches):
        for batch in batches:
            rows = []
            for v in batch.column(1):
                raw = v.as_buffer()
                raw = bytes(raw) if raw is not None else b""
                media = to_wav(raw + b"\0" * (-len(raw) % 64 if raw else 64))
                found = sniff(media)
                if not found or found[0] != (0, len(media), "audio/wav"):
                    raise ValueError("the stored form isn't confirmed")
                back = wav_samples(media)
                counts = np.bincount(np.frombuffer(back, np.uint8), minlength=256)
                mean = int((counts * np.arange(256)).sum()) * 1000 // len(back)
                inner = ",".join(k for a, _, k in found if a)
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), f"audio/wav;samples={len(back)};values={int((counts > 0).sum())};mean_milli={mean};embedded={inner}"))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=[key, *(x.split(" ")[0] for x in schema.split(", ")[1:])])

    return df.select(F.col(f"`{key}`"), text_of(text).alias(unused("text", [key]))).mapInArrow(batchwise(run), schema)
