"""FLAC in numpy: metadata blocks, frames with their checksums, a decoder, and an encoder with fixed predictors.

An encoder's choices do not show after decoding: any FLAC stream decodes to the samples it was made from, and
that, with the MD5 of the samples, is what restoring relies on.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.sources import pcm

BLOCK, MAX_BLOCK = 4096, (1 << 24) - 1
FOREIGN = ("riff", "aiff", "w64 ")
STREAMINFO, PADDING, APPLICATION, COMMENT = 0, 1, 2, 4


def _table(width: int, polynomial: int) -> list[int]:
    out, top, mask = [], 1 << (width - 1), (1 << width) - 1
    for byte in range(256):
        c = byte << (width - 8)
        for _ in range(8):
            c = (c << 1 ^ polynomial if c & top else c << 1) & mask
        out.append(c)
    return out


_CRC8, _CRC16 = _table(8, 0x07), _table(16, 0x8005)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8[c ^ b]
    return c


def _advance(state: np.ndarray) -> np.ndarray:
    """CRC-16 states after one more zero byte."""
    table = np.array(_CRC16, np.uint16)
    return (state << np.uint16(8)) ^ table[state >> np.uint16(8)]


def _crc16_tables(width: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What each byte at each of `width` places adds to a checksum, and what the state before them becomes (by its high and low byte)."""
    added = np.empty((width, 256), np.uint16)
    added[-1] = _CRC16
    for k in range(width - 1, 0, -1):
        added[k - 1] = _advance(added[k])
    high, low = np.arange(256, dtype=np.uint16) << np.uint16(8), np.arange(256, dtype=np.uint16)
    for _ in range(width):
        high, low = _advance(high), _advance(low)
    return added, high, low


_ADDED, _HIGH, _LOW = _crc16_tables()


def crc16(data: bytes) -> int:
    """A checksum is linear in its bytes: 256 places at a time are looked up at once."""
    width = len(_ADDED)
    padded = np.frombuffer(bytes(-len(data) % width) + bytes(data), np.uint8).reshape(-1, width)
    blocks = np.bitwise_xor.reduce(_ADDED[np.arange(width), padded], axis=1).tolist()
    c = 0
    for block in blocks:
        c = int(_HIGH[c >> 8]) ^ int(_LOW[c & 255]) ^ block
    return c


class FlacError(ValueError):
    """A stream that cannot be read."""


@dataclass
class StreamInfo:
    min_block: int = BLOCK
    max_block: int = BLOCK
    min_frame: int = 0
    max_frame: int = 0
    rate: int = 0
    channels: int = 0
    bits: int = 0
    total: int = 0
    md5: bytes = bytes(16)

    def pack(self) -> bytes:
        packed = self.rate << 44 | (self.channels - 1) << 41 | (self.bits - 1) << 36 | self.total
        return struct.pack(">HH", self.min_block, self.max_block) + self.min_frame.to_bytes(3, "big") + self.max_frame.to_bytes(3, "big") + packed.to_bytes(8, "big") + self.md5

    @classmethod
    def unpack(cls, b: bytes) -> StreamInfo:
        if len(b) < 34:
            raise FlacError("short STREAMINFO")
        v = int.from_bytes(b[10:18], "big")
        return cls(*struct.unpack_from(">HH", b), int.from_bytes(b[4:7], "big"), int.from_bytes(b[7:10], "big"), v >> 44, (v >> 41 & 7) + 1, (v >> 36 & 31) + 1, v & (1 << 36) - 1, b[18:34])


@dataclass
class Header:
    info: StreamInfo
    comments: list[tuple[str, str]] = field(default_factory=list)
    vendor: str = ""
    applications: list[tuple[str, bytes]] = field(default_factory=list)
    size: int = 0

    def get(self, key: str) -> str | None:
        """The first value of a key, whatever its case."""
        return next((v for k, v in self.comments if k.upper() == key.upper()), None)


def read_header(data: bytes) -> Header:
    if data[:4] != b"fLaC":
        raise FlacError("no fLaC marker")
    at, head = 4, None
    while True:
        if at + 4 > len(data):
            raise FlacError("metadata is cut off")
        kind, n = data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + n]
        if len(body) < n:
            raise FlacError("metadata is cut off")
        if head is None:
            if kind != STREAMINFO:
                raise FlacError("STREAMINFO must come first")
            head = Header(StreamInfo.unpack(body))
        elif kind == APPLICATION and n >= 4:
            head.applications.append((body[:4].decode("latin-1"), body[4:]))
        elif kind == COMMENT:
            head.vendor, head.comments = _comments(body)
        last, at = data[at] & 128, at + 4 + n
        if last:
            head.size = at
            return head


def _comments(b: bytes) -> tuple[str, list[tuple[str, str]]]:
    def piece(at: int) -> tuple[str, int]:
        n = struct.unpack_from("<I", b, at)[0]
        if at + 4 + n > len(b):
            raise FlacError("a comment is cut off")
        return b[at + 4 : at + 4 + n].decode("utf-8", "replace"), at + 4 + n

    try:
        vendor, at = piece(0)
        out, count = [], struct.unpack_from("<I", b, at)[0]
        at += 4
        for _ in range(count):
            text, at = piece(at)
            key, _, value = text.partition("=")
            out.append((key, value))
        return vendor, out
    except struct.error as e:
        raise FlacError("a comment is cut off") from e


def write_header(info: StreamInfo, comments: list[tuple[str, str]], applications: list[tuple[str, bytes]], vendor: str = "shelfmark") -> bytes:
    """Blocks in fixed order: stream, comments, applications."""
    piece = lambda s: struct.pack("<I", len(s)) + s
    text = piece(vendor.encode()) + struct.pack("<I", len(comments)) + b"".join(piece(f"{k}={v}".encode()) for k, v in comments)
    blocks = [(STREAMINFO, info.pack()), (COMMENT, text), *[(APPLICATION, i.encode("latin-1") + b) for i, b in applications]]
    if any(len(b) > MAX_BLOCK for _, b in blocks):
        raise FlacError("a metadata block is too large")
    return b"fLaC" + b"".join(bytes([k | (128 if n == len(blocks) - 1 else 0)]) + len(b).to_bytes(3, "big") + b for n, (k, b) in enumerate(blocks))


def coded_number(n: int) -> bytes:
    """A frame number in the bytes of UTF-8, extended to 36 bits."""
    if n < 0x80:
        return bytes([n])
    size = next(k for k in range(2, 8) if n < 1 << (5 * k + 1 if k < 7 else 36))
    head = (0xFF << (8 - size) & 0xFF) | (n >> 6 * (size - 1) if size < 7 else 0)
    return bytes([head, *[0x80 | n >> 6 * k & 63 for k in range(size - 2, -1, -1)]])


def read_number(b: bytes, at: int) -> tuple[int, int]:
    first = b[at]
    if first < 0x80:
        return first, at + 1
    size = 8 - (first ^ 0xFF).bit_length()
    if size < 2 or size > 7 or at + size > len(b) or any(x & 0xC0 != 0x80 for x in b[at + 1 : at + size]):
        raise FlacError("bad frame number")
    n = first & (1 << (7 - size)) - 1 if size < 7 else 0
    for x in b[at + 1 : at + size]:
        n = n << 6 | x & 63
    return n, at + size


class _Bits:
    """Bits written as pieces of zeros and ones."""

    def __init__(self) -> None:
        self.parts: list[np.ndarray] = []

    def put(self, value: int, n: int) -> None:
        self.parts.append(np.array([value >> k & 1 for k in range(n - 1, -1, -1)], np.uint8))

    def signed(self, values: np.ndarray, n: int) -> None:
        v = values.astype(np.int64)[:, None] >> np.arange(n - 1, -1, -1) & 1
        self.parts.append(v.astype(np.uint8).ravel())

    def rice(self, values: np.ndarray, k: int) -> None:
        u = (values << 1) ^ (values >> 63)
        q = u >> k
        ends = np.cumsum(q + 1 + k)
        bits = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
        stop = ends - k - 1
        bits[stop] = 1
        for j in range(k):
            bits[stop + 1 + j] = u >> (k - 1 - j) & 1
        self.parts.append(bits)

    def bytes(self) -> bytes:
        return np.packbits(np.concatenate(self.parts)).tobytes() if self.parts else b""


def _rice_parameter(r: np.ndarray) -> tuple[int, int]:
    u = (r << 1) ^ (r >> 63)
    costs = [(int((u >> k).sum()) + len(u) * (1 + k), k) for k in range(15)]
    return min(costs)[::-1]


def encode_frame(x: np.ndarray, number: int, rate_code: int, bits: int) -> bytes:
    """One frame of samples (n x channels) with independent channels."""
    n, channels = x.shape
    size = {8: 1, 12: 2, 16: 4, 20: 5, 24: 6, 32: 7}.get(bits, 0)
    head = bytes([0xFF, 0xF8, (12 if n == BLOCK else 7) << 4 | rate_code, (channels - 1) << 4 | size << 1]) + coded_number(number)
    if n != BLOCK:
        head += struct.pack(">H", n - 1)
    head += bytes([crc8(head)])
    out = _Bits()
    for c in range(channels):
        s = x[:, c].astype(np.int64)
        if (s == s[0]).all():
            out.put(0, 8)
            out.signed(s[:1], bits)
            continue
        best = None
        for order in range(min(5, n)):
            r = np.diff(s, order) if order else s
            if len(r) and np.abs(r).max() < 1 << 30:
                k, cost = _rice_parameter(r)
                cost += order * bits
                if best is None or cost < best[0]:
                    best = (cost, order, k, r)
        if best is None or best[0] >= n * bits:
            out.put(1 << 1, 8)
            out.signed(s, bits)
            continue
        _, order, k, r = best
        out.put((8 | order) << 1, 8)
        out.signed(s[:order], bits)
        out.put(0, 2)
        out.put(0, 4)
        out.put(k, 4)
        out.rice(r, k)
    body = head + out.bytes()
    return body + struct.pack(">H", crc16(body))


def encode_frames(x: np.ndarray, first_frame: int, bits: int) -> list[bytes]:
    """Frames of a segment; frames do not depend on each other, so segments are encoded anywhere."""
    return [encode_frame(x[a : a + BLOCK], first_frame + k, 0, bits) for k, a in enumerate(range(0, len(x), BLOCK))]


def renumber(frame: bytes, number: int) -> bytes:
    """The same frame with another number and its checksums."""
    _, at = read_number(frame, 4)
    extra = {6: 1, 7: 2}.get(frame[2] >> 4, 0) + {12: 1, 13: 2, 14: 2}.get(frame[2] & 15, 0)
    head = frame[:4] + coded_number(number) + frame[at : at + extra]
    body = head + bytes([crc8(head)]) + frame[at + extra + 1 : -2]
    return body + struct.pack(">H", crc16(body))


def encode(x: np.ndarray, rate: int, bits: int, comments: list[tuple[str, str]] = (), applications: list[tuple[str, bytes]] = ()) -> bytes:
    frames = encode_frames(x, 0, bits)
    sizes = [len(f) for f in frames] or [0]
    info = StreamInfo(BLOCK, BLOCK, min(sizes), max(sizes), rate, x.shape[1], bits, len(x), hashlib.md5(pcm.canonical_bytes(x, bits)).digest())
    return write_header(info, list(comments), list(applications)) + b"".join(frames)


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        n = len(self.bits)
        # for each place the next bit that is set; n: none
        self.next_one = memoryview(np.minimum.accumulate(np.where(self.bits, np.arange(n, dtype=np.int32), np.int32(n))[::-1])[::-1].copy()) if n else memoryview(b"")
        self.at = 0

    def take(self, n: int) -> int:
        if self.at + n > len(self.bits):
            raise FlacError("a frame is cut off")
        v = 0
        for b in self.bits[self.at : self.at + n].tolist():
            v = v << 1 | b
        self.at += n
        return v

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def signed_many(self, count: int, n: int) -> np.ndarray:
        if self.at + count * n > len(self.bits):
            raise FlacError("a frame is cut off")
        if not n:
            return np.zeros(count, np.int64)
        b = self.bits[self.at : self.at + count * n].reshape(count, n).astype(np.int64)
        self.at += count * n
        v = b @ (1 << np.arange(n - 1, -1, -1, dtype=np.int64))
        return np.where(b[:, 0] == 1, v - (1 << n), v)

    def rice(self, count: int, k: int) -> np.ndarray:
        """Quotients are runs of zeros; the end of each number tells where the next begins."""
        at, step, next_one, stops = self.at, k + 1, self.next_one, []
        try:
            for _ in range(count):
                stop = next_one[at]
                stops.append(stop)
                at = stop + step
        except IndexError:
            raise FlacError("a frame is cut off") from None
        if at > len(self.bits):
            raise FlacError("a frame is cut off")
        starts = np.array(stops, np.int64) + 1
        quotients = starts - 1 - np.concatenate(([self.at], starts[:-1] + k))[:count]
        self.at = at
        low = np.zeros(count, np.int64)
        for b in range(k):
            low = low << 1 | self.bits[starts + b]
        u = quotients << k | low
        return (u >> 1) ^ -(u & 1)


def _residual(r: _Reader, n: int, order: int) -> np.ndarray:
    method, partitions = r.take(2), r.take(4)
    if method > 1 or n % (1 << partitions) or n >> partitions < order:
        raise FlacError("bad residual")
    width, out = 4 + method, []
    for p in range(1 << partitions):
        count = (n >> partitions) - (order if p == 0 else 0)
        k = r.take(width)
        out.append(r.signed_many(count, r.take(5)) if k == (1 << width) - 1 else r.rice(count, k))
    return np.concatenate(out)


def _subframe(r: _Reader, n: int, bits: int) -> np.ndarray:
    kind = r.take(8)
    wasted = 0
    if kind & 1:
        wasted = 1
        while not r.take(1):
            wasted += 1
        bits -= wasted
    kind = kind >> 1 & 63
    if kind == 0:
        out = np.full(n, r.signed(bits), np.int64)
    elif kind == 1:
        out = r.signed_many(n, bits)
    elif 8 <= kind <= 12:
        order = kind - 8
        warm = r.signed_many(order, bits)
        out = _residual(r, n, order)
        for k in range(order):  # undo differences: each sum starts from the last known difference
            level = order - 1 - k
            out = np.cumsum(np.concatenate((np.diff(warm, level)[-1:] if level else warm[-1:], out)))[1:]
        out = np.concatenate((warm, out))
    elif kind >= 32:
        order = kind - 31
        warm = r.signed_many(order, bits).tolist()
        precision, shift = r.take(4) + 1, r.signed(5)
        weights = r.signed_many(order, precision).tolist()[::-1]
        for e in _residual(r, n, order).tolist():
            warm.append(e + (sum(w * v for w, v in zip(weights, warm[-order:], strict=True)) >> shift))
        out = np.array(warm, np.int64)
    else:
        raise FlacError("reserved subframe")
    return out << wasted


def decode_frame(data: bytes, info: StreamInfo) -> tuple[np.ndarray, int, int]:
    """Samples, frame number and length in bytes of the frame that data starts with; both checksums must be right."""
    if len(data) < 6 or data[0] != 0xFF or data[1] & 0xFC != 0xF8:
        raise FlacError("no frame")
    number, at = read_number(data, 4)
    block, rate, mode, size = data[2] >> 4, data[2] & 15, data[3] >> 4, data[3] >> 1 & 7
    n = {1: 192, 6: 0, 7: 0}.get(block, 576 << (block - 2) if 2 <= block <= 5 else 256 << (block - 8) if block >= 8 else -1)
    if n == 0:
        width = 1 if block == 6 else 2
        n = int.from_bytes(data[at : at + width], "big") + 1
        at += width
    at += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if n < 1 or mode > 10 or crc8(data[:at]) != data[at]:
        raise FlacError("bad frame header")
    bits = {0: info.bits, 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}.get(size, 0)
    r = _Reader(data[at + 1 :])
    channels = mode + 1 if mode < 8 else 2
    s = [_subframe(r, n, bits + (mode in (8, 10) and c == 1 or mode == 9 and c == 0)) for c in range(channels)]
    if mode == 8:
        s[1] = s[0] - s[1]
    elif mode == 9:
        s[0] = s[0] + s[1]
    elif mode == 10:
        mid = s[0] << 1 | s[1] & 1
        s = [mid + s[1] >> 1, mid - s[1] >> 1]
    end = at + 1 + (r.at + 7) // 8
    if len(data) < end + 2 or crc16(data[:end]) != struct.unpack_from(">H", data, end)[0]:
        raise FlacError("frame checksum")
    return np.stack(s, 1).astype(np.int32), number, end + 2


def decode(data: bytes) -> tuple[Header, np.ndarray]:
    head = read_header(data)
    at, parts = head.size, []
    longest = (head.info.max_frame or 1 << 14) + 64
    while at < len(data):
        while True:
            try:
                x, _, used = decode_frame(data[at : at + longest], head.info)
                break
            except (FlacError, IndexError) as e:
                if at + longest >= len(data):
                    raise FlacError(str(e)) from e
                longest *= 4  # the largest frame is not stated, or wrongly
        parts.append(x)
        at += used
    x = np.concatenate(parts) if parts else np.zeros((0, head.info.channels), np.int32)
    if head.info.total and len(x) != head.info.total:
        raise FlacError("sample count")
    if any(head.info.md5) and hashlib.md5(pcm.canonical_bytes(x, head.info.bits)).digest() != head.info.md5:
        raise FlacError("MD5 of the samples")
    return head, x


def split_frames(data: bytes, info: StreamInfo, start: int) -> list[tuple[int, int, int]]:
    """(number, from, to) of frames, found by headers whose checksum and expected number are right, without decoding."""
    out, at, expected, begin = [], start, 0, None
    while at + 6 <= len(data):
        at = data.find(b"\xff", at)
        if at < 0 or at + 6 > len(data):
            break
        if data[at + 1] & 0xFE == 0xF8:
            try:
                number, k = read_number(data, at + 4)
                k += {6: 1, 7: 2}.get(data[at + 2] >> 4, 0) + {12: 1, 13: 2, 14: 2}.get(data[at + 2] & 15, 0)
                if number == expected and k < len(data) and crc8(data[at:k]) == data[k]:
                    if begin is not None:
                        out.append((expected - 1, begin, at))
                    begin, expected = at, expected + 1
                    at = k
                    continue
            except (FlacError, IndexError):
                pass
        at += 1
    if begin is not None:
        out.append((expected - 1, begin, len(data)))
    return out


#: Channels that one stream can hold.
MOST_CHANNELS = 8


def _parts(data: bytes) -> tuple[pcm.Layout, np.ndarray, list[tuple[str, bytes]]]:
    """Layout and samples of a PCM file, and the application blocks that it is restored from."""
    l = pcm.scan(data).layout
    if l is None:
        raise FlacError("not a PCM file to convert")
    records = pcm.foreign_records(data, l)
    audio = next(k for k, c in enumerate(l.chunks) if c[3])
    layout = struct.pack(">HHIBBB", len(records), audio, l.padding, l.width, l.big, l.unsigned8) + hashlib.sha256(data).digest() + data[l.end :]
    return l, pcm.samples(data, l), [("shlf", layout), ("shlr", pack_records(records))]


def archive_audio(data: bytes, extension: str = "") -> bytes:
    """A PCM file as FLAC that restores to the same bytes: its other blocks, what follows it, its digest and its extension travel in application blocks."""
    l, x, blocks = _parts(data)
    if l.channels > MOST_CHANNELS:
        raise FlacError("more channels than a stream can hold")
    return encode(x, l.rate, l.bits, pcm.tags(data, l), [*blocks, ("shle", extension.encode())])


def archive_channels(data: bytes, extension: str = "") -> list[bytes]:
    """A PCM file of any number of channels as one stream each; the first also holds what the file is restored from."""
    l, x, blocks = _parts(data)
    digest = hashlib.sha256(data).digest()
    group = lambda c: ("shlg", struct.pack(">II", c, l.channels) + digest)
    return [encode(x[:, c - 1 : c], l.rate, l.bits, pcm.tags(data, l, c), [group(c), ("shle", extension.encode()), *(blocks if c == 1 else [])]) for c in range(1, l.channels + 1)]


def member_of(head: Header) -> tuple[int, int, bytes] | None:
    """Channel, channels and the digest of the whole file, of a stream that is one channel of it."""
    b = dict(head.applications).get("shlg")
    return (*struct.unpack_from(">II", b), b[8:40]) if b is not None and len(b) >= 40 else None


def restore_channels(members: list[bytes]) -> bytes:
    """The file whose channels these streams are, in any order."""
    found = [decode(bytes(m)) for m in members]
    named = [member_of(h) for h, _ in found]
    if None in named or len({(n, d) for _, n, d in named}) != 1 or named[0][1] != len(members):
        raise FlacError("incomplete group")
    x = interleave([(c, x) for (c, _, _), (_, x) in zip(named, found, strict=True)])
    first = next(dict(h.applications) for (c, _, _), (h, _) in zip(named, found, strict=True) if c == 1)
    return _rebuilt(first, x)


def pack_records(records: list[tuple[str, bytes]]) -> bytes:
    return zlib.compress(b"".join(struct.pack(">4sI", i.encode("latin-1")[:4], len(b)) + b for i, b in records), 9)


def unpack_records(packed: bytes) -> list[tuple[str, bytes]]:
    data, at, out = zlib.decompress(packed), 0, []
    while at < len(data):
        i, n = struct.unpack_from(">4sI", data, at)
        out.append((i.decode("latin-1"), data[at + 8 : at + 8 + n]))
        at += 8 + n
    return out


def restore(data: bytes) -> bytes:
    head, x = decode(data)
    if member_of(head):
        raise FlacError("one channel of a group")
    return _rebuilt(dict(head.applications), x)


def _rebuilt(found: dict[str, bytes], x: np.ndarray) -> bytes:
    if "shlf" not in found or "shlr" not in found:
        raise FlacError("nothing to restore from")
    b = found["shlf"]
    _, audio, padding, width, big, unsigned8 = struct.unpack_from(">HHIBBB", b)
    l = pcm.Layout("", width=width, big=bool(big), unsigned8=bool(unsigned8), channels=x.shape[1])
    out = pcm.rebuild(unpack_records(found["shlr"]), pcm.sample_bytes(x, l), audio, padding, b[43:])
    if hashlib.sha256(out).digest() != b[11:43]:
        raise FlacError("digest of the restored file")
    return out


def original_size(head: Header) -> int | None:
    """Size of the restored file from metadata alone."""
    found = dict(head.applications)
    if "shlf" not in found or "shlr" not in found:
        return None
    _, _, padding, width, _, _ = struct.unpack_from(">HHIBBB", found["shlf"])
    channels = member_of(head)[1] if member_of(head) else head.info.channels
    return sum(len(b) for _, b in unpack_records(found["shlr"])) + head.info.total * channels * width + padding + len(found["shlf"]) - 43


def interleave(members: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Channels (index, samples) of a group as one array; indices must be 1 to n without a gap."""
    members = sorted(members, key=lambda m: m[0])
    if [i for i, _ in members] != list(range(1, len(members) + 1)) or len({len(x) for _, x in members}) > 1:
        raise FlacError("incomplete group")
    return np.concatenate([x.reshape(-1, 1) for _, x in members], axis=1)


_HEADER = T.StructType([
    T.StructField("rate", T.LongType()), T.StructField("channels", T.IntegerType()), T.StructField("bits", T.IntegerType()), T.StructField("samples", T.LongType()), T.StructField("md5", T.StringType()),
    T.StructField("comments", T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]))), T.StructField("original_size", T.LongType()),
    T.StructField("original_extension", T.StringType()), T.StructField("group_id", T.StringType()), T.StructField("channel_index", T.IntegerType()), T.StructField("channel_count", T.IntegerType()), T.StructField("error", T.StringType()),
])


def _origin(h: Header) -> dict:
    """Extension of the file a stream comes from, as it says or as its first block tells, and which channel it is."""
    found, member = dict(h.applications), member_of(h)
    extension = found["shle"].decode("utf-8", "replace") if "shle" in found else ""
    if not extension and "shlr" in found:
        first = unpack_records(found["shlr"])[:1]
        extension = {b"FORM": ".aif", b"caff": ".caf", b"riff": ".w64"}.get(first[0][1][:4], ".wav") if first else ""
    return {"original_extension": extension or None, "group_id": member[2].hex() if member else None, "channel_index": member[0] if member else None, "channel_count": member[1] if member else None}


def header_rows(files: DataFrame, prefix: int = 1 << 20) -> DataFrame:
    """path, flac (struct): metadata of files (path, content) from the first MiB where that is enough."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    data = bytes(data)
                    try:
                        h = read_header(data[:prefix])
                    except FlacError:
                        h = read_header(data)
                    i = h.info
                    rows.append((p, {"rate": i.rate, "channels": i.channels, "bits": i.bits, "samples": i.total, "md5": i.md5.hex(), "comments": [{"key": k, "value": v} for k, v in h.comments], "original_size": original_size(h), **_origin(h), "error": None}))
                except FlacError as e:
                    rows.append((p, dict.fromkeys(f.name for f in _HEADER) | {"error": str(e)}))
            yield pd.DataFrame(rows, columns=["path", "flac"])

    return files.select("path", "content").mapInPandas(run, T.StructType([T.StructField("path", T.StringType()), T.StructField("flac", _HEADER)]))


def _each(kernel, failure: str, given=bytes):
    def run(content: pd.Series) -> pd.DataFrame:
        out = []
        for data in content:
            try:
                out.append((kernel(given(data)), "ok") if data is not None else (None, failure))
            except (FlacError, IndexError, zlib.error, struct.error):
                out.append((None, failure))
        return pd.DataFrame(out, columns=["content", "status"])

    return run


_RESULT = T.StructType([T.StructField("content", T.BinaryType()), T.StructField("status", T.StringType())])


def to_flac(content: Column, extension: Column | None = None) -> Column:
    """struct<content, status> of a PCM file's bytes."""
    def run(content: pd.Series, extension: pd.Series) -> pd.DataFrame:
        pairs = zip(content, extension, strict=True)
        return _each(lambda pair: archive_audio(bytes(pair[0]), pair[1] or ""), "not_parsable", lambda pair: pair)(pd.Series([None if c is None else (c, e) for c, e in pairs], dtype=object))

    return F.pandas_udf(run, _RESULT)(content, F.lit("") if extension is None else extension)


def from_flac(content: Column) -> Column:
    return F.pandas_udf(_each(restore, "corrupt_archive"), _RESULT)(content)


def to_members(content: Column, extension: Column) -> Column:
    """array<binary>: one stream for each channel of a PCM file's bytes; null if it is none."""
    def run(content: pd.Series, extension: pd.Series) -> pd.Series:
        out = []
        for data, ext in zip(content, extension, strict=True):
            try:
                out.append(None if data is None else archive_channels(bytes(data), ext or ""))
            except FlacError:
                out.append(None)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, T.ArrayType(T.BinaryType()))(content, extension)


def from_members(members: Column) -> Column:
    """struct<content, status> of the file that an array of streams is."""
    return F.pandas_udf(_each(restore_channels, "corrupt_archive", list), _RESULT)(members)
