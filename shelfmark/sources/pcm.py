"""PCM containers: recognised by their first bytes, walked chunk by chunk, their samples as integers.

A layout tiles its file: metadata blocks, audio, padding, bytes after the container. What is not audio is kept
as it is, so that the file can be put together again.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BLOCK, MAX_RATE, MAX_FRAMES = 16_777_211, 1_048_575, 1 << 36

# Fixed values of the formats.
_W64_RIFF = bytes.fromhex("726966662e91cf11a5d628db04c10000")
_W64_WAVE = bytes.fromhex("77617665f3acd3118cd100c04f8edb8a")
_W64_FMT = bytes.fromhex("666d7420f3acd3118cd100c04f8edb8a")
_W64_DATA = bytes.fromhex("64617461f3acd3118cd100c04f8edb8a")
_PCM_TAIL = bytes.fromhex("000000001000800000aa00389b71")


class Reject(Exception):
    """Recognised, but not something to convert: reason and detail."""

    def __init__(self, reason: str, detail: str) -> None:
        super().__init__(detail)
        self.reason = reason


@dataclass
class Layout:
    container: str
    channels: int = 0
    rate: int = 0
    bits: int = 0
    width: int = 0  # bytes of a sample
    big: bool = False
    unsigned8: bool = False
    frames: int = 0
    audio_at: int = 0
    audio_size: int = 0
    padding: int = 0
    end: int = 0  # of the container; what follows is trailing
    chunks: list[tuple[str, int, int, bool]] = field(default_factory=list)  # id, offset, length of header and body (of the header, for audio), audio


@dataclass
class Scan:
    recognised: bool
    layout: Layout | None = None
    reason: str | None = None
    detail: str = ""


def wave_format(body: bytes, l: Layout) -> None:
    if len(body) < 16:
        raise Reject("not_parsable", "short format chunk")
    tag, l.channels, l.rate, _, align, bits = struct.unpack_from("<HHIIHH", body)
    valid = bits
    if tag == 0xFFFE:
        if len(body) < 40:
            raise Reject("not_parsable", "short extensible format")
        valid = struct.unpack_from("<H", body, 18)[0] or bits
        tag = struct.unpack_from("<H", body, 24)[0] if body[26:40] == _PCM_TAIL else 0
    if tag == 3:
        raise Reject("float_samples", "floating point")
    if tag != 1:
        raise Reject("unsupported_encoding", f"format {tag}")
    l.bits, l.width = valid, (bits + 7) // 8
    l.unsigned8 = l.width == 1
    if align != l.channels * l.width:
        raise Reject("not_parsable", "block align does not fit")


def extended(b: bytes) -> int:
    """The whole number in an 80-bit float; a fraction is refused."""
    exponent, mantissa = struct.unpack(">HQ", b)
    shift = 16383 + 63 - (exponent & 0x7FFF)
    if exponent & 0x8000 or shift < 0 or shift > 63 or mantissa & ((1 << shift) - 1):
        raise Reject("not_parsable", "sample rate is not a whole number")
    return mantissa >> shift


def _chunks(data: bytes, at: int, end: int, big: bool, sizes: dict[str, int], audio: str) -> Iterator[tuple[str, int, int]]:
    """id, offset of the body, size; padded to even lengths. A 32-bit size of all ones is looked up in sizes."""
    while at < end:
        if at + 8 > end:
            raise Reject("not_parsable", "a chunk header is cut off")
        id_ = data[at : at + 4].decode("latin-1")
        n = struct.unpack_from(">I" if big else "<I", data, at + 4)[0]
        n = sizes.get(id_, n) if n == 0xFFFFFFFF or (id_ == audio and n == 0 and id_ in sizes) else n
        if at + 8 + n > end:
            raise Reject("not_parsable", f"chunk {id_!r} runs past the end")
        yield id_, at + 8, n
        at += 8 + n + (n & 1)


def _riff(data: bytes) -> Layout:
    wide = data[:4] != b"RIFF"
    l, sizes, start = Layout("RF64" if wide else "WAVE"), {}, 12
    end = 8 + struct.unpack_from("<I", data, 4)[0]
    if data[8:12] != b"WAVE":
        raise Reject("not_parsable", "not a WAVE form")
    if wide:
        if data[12:16] != b"ds64" or len(data) < 48:
            raise Reject("not_parsable", "ds64 must come first")
        total, audio, _ = struct.unpack_from("<QQQ", data, 20)
        end, sizes = 8 + total, {"data": audio}
    elif end - 8 in (0, 0xFFFFFFFF):  # placeholder of a writer that did not finish: up to the end of the file
        end = len(data)
        sizes = {"data": -1}
    if end > len(data):
        raise Reject("not_parsable", "the file is cut off")
    l.end, l.chunks = end, [("head", 0, 12, False)]
    seen = False
    if sizes.get("data") == -1:
        at = data.find(b"data", 12)
        sizes = {"data": max(0, len(data) - at - 8)} if at > 0 else {}
    for id_, body, n in _chunks(data, start, end, False, sizes, "data"):
        if id_ == "fmt ":
            wave_format(data[body : body + n], l)
            seen = True
        if id_ == "data":
            if l.audio_at:
                raise Reject("not_parsable", "two data chunks")
            l.audio_at, l.audio_size = body, n
            l.chunks.append((id_, body - 8, 8, True))
        else:
            l.chunks.append((id_, body - 8, min(8 + n + (n & 1), end - body + 8), False))
    if not seen:
        raise Reject("not_parsable", "no format chunk")
    return l


def _aiff(data: bytes) -> Layout:
    l = Layout(data[8:12].decode("latin-1").replace("AIFC", "AIFF-C"), big=True)
    end = 8 + struct.unpack_from(">I", data, 4)[0]
    if end > len(data):
        raise Reject("not_parsable", "the file is cut off")
    l.end, l.chunks, seen = end, [("head", 0, 12, False)], False
    for id_, body, n in _chunks(data, 12, end, True, {}, "SSND"):
        if id_ == "COMM":
            if n < 18:
                raise Reject("not_parsable", "short COMM chunk")
            l.channels, _, l.bits = struct.unpack_from(">hIh", data, body)
            l.rate, l.width, seen = extended(data[body + 8 : body + 18]), (l.bits + 7) // 8, True
            if l.container == "AIFF-C":
                kind = data[body + 18 : body + 22]
                if kind in (b"fl32", b"FL32", b"fl64", b"FL64"):
                    raise Reject("float_samples", "floating point")
                if kind not in (b"NONE", b"twos", b"sowt"):
                    raise Reject("unsupported_encoding", kind.decode("latin-1"))
                l.big = kind != b"sowt"
        if id_ == "SSND":
            if n < 8 or struct.unpack_from(">I", data, body)[0]:
                raise Reject("not_parsable", "an offset before the samples")
            l.audio_at, l.audio_size = body + 8, n - 8
            l.chunks.append((id_, body - 8, 16, True))
        else:
            l.chunks.append((id_, body - 8, min(8 + n + (n & 1), end - body + 8), False))
    if not seen:
        raise Reject("not_parsable", "no COMM chunk")
    return l


def _caf(data: bytes) -> Layout:
    l, at = Layout("CAF", big=True), 8
    l.chunks, l.end, seen = [("head", 0, 8, False)], len(data), False
    while at < len(data):
        if at + 12 > len(data):
            raise Reject("not_parsable", "a chunk header is cut off")
        id_, n = data[at : at + 4].decode("latin-1"), struct.unpack_from(">q", data, at + 4)[0]
        if n == -1 and id_ == "data":
            n = len(data) - at - 12
        body = at + 12
        if n < 0 or body + n > len(data):
            raise Reject("not_parsable", f"chunk {id_!r} runs past the end")
        if id_ == "desc":
            rate, kind, flags, packet, frames, l.channels, l.bits = struct.unpack_from(">d4sIIIII", data, body)
            if kind != b"lpcm":
                raise Reject("unsupported_encoding", kind.decode("latin-1"))
            if flags & 1:
                raise Reject("float_samples", "floating point")
            if rate != int(rate) or frames != 1 or not l.channels or packet % l.channels:
                raise Reject("not_parsable", "packets are not single frames")
            l.rate, l.big, l.width, seen = int(rate), not flags & 2, packet // l.channels, True
        if id_ == "data":
            if n < 4:
                raise Reject("not_parsable", "short data chunk")
            l.audio_at, l.audio_size = body + 4, n - 4
            l.chunks.append((id_, at, 16, True))
        else:
            l.chunks.append((id_, at, 12 + n, False))
        at = body + n
    if not seen:
        raise Reject("not_parsable", "no desc chunk")
    return l


def _wave64(data: bytes) -> Layout:
    l = Layout("Wave64")
    if len(data) < 40 or data[24:40] != _W64_WAVE:
        raise Reject("not_parsable", "not a WAVE form")
    end, at, seen = struct.unpack_from("<Q", data, 16)[0], 40, False
    if end > len(data):
        raise Reject("not_parsable", "the file is cut off")
    l.end, l.chunks = end, [("head", 0, 40, False)]
    while at < end:
        if at + 24 > end:
            raise Reject("not_parsable", "a chunk header is cut off")
        id_, n = data[at : at + 16], struct.unpack_from("<Q", data, at + 16)[0]
        if n < 24 or at + n > end:
            raise Reject("not_parsable", "a chunk runs past the end")
        step = min((n + 7) // 8 * 8, end - at)
        if id_ == _W64_FMT:
            wave_format(data[at + 24 : at + n], l)
            seen = True
        if id_ == _W64_DATA:
            l.audio_at, l.audio_size = at + 24, n - 24
            l.chunks.append(("data", at, 24, True))
        else:
            l.chunks.append((id_[:4].decode("latin-1"), at, step, False))
        at += step
    if not seen:
        raise Reject("not_parsable", "no format chunk")
    return l


def _finish(data: bytes, l: Layout) -> None:
    if not l.audio_at:
        raise Reject("not_parsable", "no audio")
    if l.channels < 1:
        raise Reject("not_parsable", "no channels")
    if not 1 <= l.width <= 4 or not 4 <= l.bits <= min(32, 8 * l.width):
        raise Reject("bit_depth", f"{l.bits} bits in {l.width} bytes")
    if not 1 <= l.rate <= MAX_RATE:
        raise Reject("sample_rate", f"{l.rate} Hz")
    frame = l.channels * l.width
    if l.audio_size % frame:
        raise Reject("not_parsable", "a partial frame at the end")
    l.frames = l.audio_size // frame
    if l.frames >= MAX_FRAMES:
        raise Reject("too_many_samples", f"{l.frames} samples")
    stop = l.audio_at + l.audio_size
    after = min([c[1] for c in l.chunks if c[1] >= stop], default=l.end)
    l.padding = after - stop
    if l.padding > 7 or any(data[stop:after]):
        raise Reject("not_parsable", "unexpected bytes after the audio")
    at = 0
    for id_, offset, length, audio in l.chunks:
        if offset != at:
            raise Reject("not_parsable", "chunks do not cover the file")
        if length > MAX_BLOCK:
            raise Reject("chunk_too_large", id_)
        at = offset + length + (l.audio_size + l.padding if audio else 0)
    if at != l.end:
        raise Reject("not_parsable", "chunks do not cover the container")
    if len(data) - l.end > MAX_BLOCK:
        raise Reject("chunk_too_large", "after the container")


def scan(data: bytes) -> Scan:
    """Dispatch by the first bytes, whatever the name; anything shorter than 12 bytes is not recognised."""
    head = data[:16]
    if len(data) < 12:
        return Scan(False)
    walk = {b"RIFF": _riff, b"RF64": _riff, b"BW64": _riff, b"caff": _caf}.get(head[:4])
    if head[:4] == b"FORM" and head[8:12] in (b"AIFF", b"AIFC"):
        walk = _aiff
    elif head == _W64_RIFF:
        walk = _wave64
    if walk is None or (walk is _riff and head[8:12] != b"WAVE"):
        return Scan(False)
    try:
        layout = walk(data)
        _finish(data, layout)
        return Scan(True, layout)
    except Reject as e:
        return Scan(True, None, e.reason, str(e))
    except struct.error:
        return Scan(True, None, "not_parsable", "a field is cut off")


def samples(data: bytes, l: Layout) -> np.ndarray:
    """frames x channels as int32."""
    raw = np.frombuffer(data, np.uint8, l.audio_size, l.audio_at).reshape(-1, l.width)
    if not l.big:
        raw = raw[:, ::-1]
    if l.unsigned8:
        raw = raw ^ 0x80
    wide = np.zeros((len(raw), 4), np.uint8)
    wide[:, : l.width] = raw
    return (wide.view(">i4").astype(np.int32).ravel() >> (32 - 8 * l.width)).reshape(-1, l.channels)


def sample_bytes(values: np.ndarray, l: Layout) -> bytes:
    wide = (values.astype(np.int64).ravel() << (32 - 8 * l.width)).astype(">i4").view(np.uint8).reshape(-1, 4)[:, : l.width]
    if l.unsigned8:
        wide = wide ^ 0x80
    return (wide if l.big else wide[:, ::-1]).tobytes()


def canonical_bytes(values: np.ndarray, bits: int) -> bytes:
    """What a stream's MD5 is over: signed little-endian samples in the fewest bytes."""
    return values.astype("<i4").reshape(-1, 1).view(np.uint8).reshape(-1, 4)[:, : (bits + 7) // 8].tobytes()


def foreign_records(data: bytes, l: Layout) -> list[tuple[str, bytes]]:
    """Everything of the container that is not audio, in order."""
    return [(id_, data[a : a + n]) for id_, a, n, _ in l.chunks]


def rebuild(records: list[tuple[str, bytes]], audio: bytes, audio_index: int, padding: int, trailing: bytes) -> bytes:
    out = []
    for k, (_, block) in enumerate(records):
        out.append(block)
        if k == audio_index:
            out += [audio, bytes(padding)]
    return b"".join([*out, trailing])


def text_of(b: bytes) -> str:
    b = b.split(b"\0")[0]
    try:
        s = b.decode()
    except UnicodeDecodeError:
        s = b.decode("latin-1")
    return s.rstrip(" \t\r\n")


def _xml(source: str, element: str) -> str:
    m = re.search(f"<{element}>(.*?)</{element}>", source, re.S)
    if not m:
        return ""
    s = m[1]
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        s = s.replace(a, b)
    return s.strip(" \t\r\n")


def tags(data: bytes, l: Layout, channel: int | None = None) -> list[tuple[str, str]]:
    """Descriptions in chunks as pairs in order: broadcast fields, iXML, LIST-INFO, AIFF texts, track names last."""
    out: list[tuple[str, str]] = []
    tracks: dict[int, str] = {}
    for id_, offset, length, _ in l.chunks:
        body = data[offset + (24 if l.container == "Wave64" else 12 if l.container == "CAF" else 8) : offset + length]
        if id_ == "bext" and len(body) >= 346:
            out += [("DESCRIPTION", text_of(body[:256])), ("ORIGINATOR", text_of(body[256:288])), ("ORIGINATOR_REFERENCE", text_of(body[288:320]))]
            date, clock = text_of(body[320:330]), text_of(body[330:338])
            if len(date) == 10:
                iso = f"{date[:4]}-{date[5:7]}-{date[8:]}"
                out.append(("DATE", f"{iso}T{clock[:2]}:{clock[3:5]}:{clock[6:]}" if len(clock) == 8 else iso))
            out += [("ORIGINATION_DATE", date), ("ORIGINATION_TIME", clock), ("TIME_REFERENCE", str(struct.unpack_from("<Q", body, 338)[0]))]
        elif id_ in ("iXML", "ixml"):
            xml = body.decode("utf-8", "replace")
            out += [(f, _xml(xml, f)) for f in ("PROJECT", "SCENE", "TAKE", "TAPE", "NOTE", "CIRCLED")]
            for part in re.findall(r"<TRACK>(.*?)</TRACK>", xml, re.S):
                index, name = _xml(part, "CHANNEL_INDEX"), _xml(part, "NAME")
                if re.fullmatch(r"[0-9]{1,5}", index) and name:
                    tracks[int(index)] = name
        elif id_ == "LIST" and body[:4] == b"INFO":
            at, known = 4, {b"INAM": "TITLE", b"IART": "ARTIST", b"ICMT": "COMMENT"}
            while at + 8 <= len(body):
                n = struct.unpack_from("<I", body, at + 4)[0]
                if at + 8 + n > len(body):
                    break
                if body[at : at + 4] in known:
                    out.append((known[body[at : at + 4]], text_of(body[at + 8 : at + 8 + n])))
                at += 8 + n + (n & 1)
        elif id_ in ("NAME", "AUTH", "ANNO"):
            n = min(struct.unpack_from(">I", data, offset + 4)[0], len(body))
            out.append(({"NAME": "TITLE", "AUTH": "ARTIST", "ANNO": "COMMENT"}[id_], text_of(body[:n])))
    if channel is not None:
        out += [("TRACK_NAME", tracks.get(channel, "")), ("CHANNEL", str(channel)), ("CHANNELS", str(l.channels))]
    else:
        out += [(f"TRACK_NAME_{k:02}", tracks[k]) for k in sorted(tracks) if 1 <= k <= l.channels]
    return [t for t in out if t[1]]


_SCAN = T.StructType([
    T.StructField("recognised", T.BooleanType()), T.StructField("reason", T.StringType()), T.StructField("detail", T.StringType()), T.StructField("container", T.StringType()),
    T.StructField("channels", T.IntegerType()), T.StructField("rate", T.LongType()), T.StructField("bits", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("frames", T.LongType()),
])


def _scan_rows(content: pd.Series) -> pd.DataFrame:
    rows = []
    for data in content:
        s = scan(bytes(data)) if data is not None else Scan(False)
        l = s.layout
        rows.append((s.recognised, s.reason, s.detail, *((l.container, l.channels, l.rate, l.bits, l.width, l.frames) if l else (None,) * 6)))
    out = pd.DataFrame(rows, columns=[f.name for f in _SCAN])
    return out.astype({c: "Int64" for c in ("channels", "rate", "bits", "width", "frames")})


def scan_column(content: Column) -> Column:
    """struct of what scan() finds; only contents that start like a container reach Python."""
    head = F.hex(F.substring(content, 1, 12))
    likely = head.rlike("^(52494646|52463634|42573634).{8}57415645$|^464F524D.{8}4149464[36]$|^63616666|^72696666")
    return F.pandas_udf(_scan_rows, _SCAN)(F.when((F.octet_length(content) >= 12) & likely, content))


def chunk_rows(files: DataFrame) -> DataFrame:
    """path, pos, id, first, length, audio: one row per block of each recognised file (path, content)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, k, *c) for p, data in zip(pdf["path"], pdf["content"], strict=True) if (s := scan(bytes(data))).layout for k, c in enumerate(s.layout.chunks)]
            yield pd.DataFrame(rows, columns=["path", "pos", "id", "first", "length", "audio"])

    return files.select("path", "content").mapInPandas(run, "path string, pos int, id string, first long, length long, audio boolean")


def tag_rows(files: DataFrame) -> DataFrame:
    """path, pos, key, value: mirrored tags of each recognised file."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, k, *t) for p, data in zip(pdf["path"], pdf["content"], strict=True) if (s := scan(bytes(data))).layout for k, t in enumerate(tags(bytes(data), s.layout))]
            yield pd.DataFrame(rows, columns=["path", "pos", "key", "value"])

    return files.select("path", "content").mapInPandas(run, "path string, pos int, key string, value string")
