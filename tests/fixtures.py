"""Audio files and archives made from parameters."""

import struct
import zlib

import numpy as np


def tone(frames=5000, channels=2, bits=16, seed=1):
    rng = np.random.default_rng(seed)
    t = np.arange(frames)[:, None]
    x = np.sin(t / (20 + 7 * np.arange(channels))) * (1 << (bits - 2)) + rng.normal(0, 1 << max(bits - 10, 0), (frames, channels))
    return np.clip(x, -(1 << (bits - 1)), (1 << (bits - 1)) - 1).astype(np.int32)


def raw(x, width, big=False, unsigned8=False):
    b = x.astype(">i4").reshape(-1, 1).view(np.uint8).reshape(-1, 4)[:, 4 - width :]
    if unsigned8:
        b = b ^ 0x80
    return (b if big else b[:, ::-1]).tobytes()


def chunk(id_, body, big=False):
    return id_ + struct.pack(">I" if big else "<I", len(body)) + body + b"\0" * (len(body) & 1)


def wav(x, bits=16, rate=48000, before=b"", after=b"", trailing=b"", tag=1):
    width = (bits + 7) // 8
    channels = x.shape[1]
    fmt = struct.pack("<HHIIHH", tag, channels, rate, rate * channels * width, channels * width, bits)
    body = b"WAVE" + chunk(b"fmt ", fmt) + before + chunk(b"data", raw(x, width, unsigned8=width == 1)) + after
    return b"RIFF" + struct.pack("<I", len(body)) + body + trailing


def rf64(x, bits=24, rate=96000):
    width, channels = (bits + 7) // 8, x.shape[1]
    audio = raw(x, width)
    fmt = struct.pack("<HHIIHH", 1, channels, rate, rate * channels * width, channels * width, bits)
    rest = chunk(b"fmt ", fmt) + b"data" + struct.pack("<I", 0xFFFFFFFF) + audio + b"\0" * (len(audio) & 1)
    total = 4 + 36 + len(rest)
    return b"RF64" + struct.pack("<I", 0xFFFFFFFF) + b"WAVE" + chunk(b"ds64", struct.pack("<QQQI", total, len(audio), len(x), 0)) + rest


def aiff(x, bits=24, rate=44100, kind=None):
    width = (bits + 7) // 8
    comm = struct.pack(">hIh", x.shape[1], len(x), bits) + struct.pack(">HQ", 16383 + rate.bit_length() - 1, rate << (64 - rate.bit_length()))
    if kind:
        comm += kind + b"\0\0"
    body = (b"AIFC" if kind else b"AIFF") + chunk(b"COMM", comm, True) + chunk(b"NAME", b"A title", True) + chunk(b"SSND", struct.pack(">II", 0, 0) + raw(x, width, kind != b"sowt"), True)
    return b"FORM" + struct.pack(">I", len(body)) + body


def caf(x, bits=16, rate=48000.0, little=False, unknown=False):
    width, channels = (bits + 7) // 8, x.shape[1]
    audio = struct.pack(">I", 0) + raw(x, width, not little)
    desc = struct.pack(">d4sIIIII", rate, b"lpcm", 2 if little else 0, width * channels, 1, channels, bits)
    return b"caff" + struct.pack(">HH", 1, 0) + b"desc" + struct.pack(">q", len(desc)) + desc + b"data" + struct.pack(">q", -1 if unknown else len(audio)) + audio


def w64(x, bits=16, rate=48000):
    from shelfmark.sources import pcm

    width, channels = (bits + 7) // 8, x.shape[1]
    fmt = struct.pack("<HHIIHH", 1, channels, rate, rate * channels * width, channels * width, bits)
    pad = lambda b: b + bytes(-len(b) % 8)
    audio = raw(x, width)
    body = pcm._W64_WAVE + pad(pcm._W64_FMT + struct.pack("<Q", 24 + len(fmt)) + fmt) + pad(pcm._W64_DATA + struct.pack("<Q", 24 + len(audio)) + audio)
    return pcm._W64_RIFF + struct.pack("<Q", 24 + len(body)) + body


def bext(description="A scene", originator="Deck", reference=123456):
    return chunk(b"bext", description.encode().ljust(256, b"\0") + originator.encode().ljust(32, b"\0") + b"ref".ljust(32, b"\0") + b"2024-05-06" + b"07-08-09" + struct.pack("<Q", reference) + bytes(256))


def crafted_zip(entries, comment=b"", truncate=0):
    """entries: dicts of name (bytes), data, method, flags, made, attributes, extra, crc."""
    out, directory = b"", b""
    for e in entries:
        name, data, method = e["name"], e.get("data", b""), e.get("method", 0)
        stored = data if method != 8 else zlib.compress(data, 6)[2:-4]
        crc = e.get("crc", zlib.crc32(data))
        extra = e.get("extra", b"")
        at = len(out)
        out += b"PK\x03\x04" + struct.pack("<HHHHHIIIHH", 20, e.get("flags", 0), method, 0, 33, crc, len(stored), len(data), len(name), 0) + name + stored
        directory += b"PK\x01\x02" + struct.pack("<HHHHHHIIIHHHHHII", e.get("made", 20), 20, e.get("flags", 0), method, 0, 33, crc, len(stored), len(data), len(name), len(extra), 0, 0, 0, e.get("attributes", 0), at) + name + extra
    end = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, len(entries), len(entries), len(directory), len(out), len(comment)) + comment
    whole = out + directory + end
    return whole[: len(whole) - truncate] if truncate else whole
