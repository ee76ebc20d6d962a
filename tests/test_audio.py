import struct

import numpy as np
import pytest
from fixtures import aiff, bext, caf, chunk, rf64, tone, w64, wav
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.sources import flac, pcm

FILES = {
    "wav8": wav(tone(bits=8), 8), "wav16": wav(tone(), 16), "wav24": wav(tone(bits=24), 24), "wav32": wav(tone(bits=32), 32), "odd": wav(tone(frames=3, channels=1, bits=8), 8, after=chunk(b"junk", b"abc"), trailing=b"tail"), "rf64": rf64(tone(bits=24)),
    "aiff": aiff(tone(bits=24)), "sowt": aiff(tone(), 16, kind=b"sowt"), "caf": caf(tone()), "caf_unknown": caf(tone(bits=24), 24, little=True, unknown=True), "w64": w64(tone()), "mono": wav(tone(channels=1), 16), "empty": wav(tone(frames=0), 16), "many": wav(tone(frames=300, channels=8, bits=24), 24),
}


@pytest.mark.parametrize("name", FILES)
def test_layouts_tile_the_file_and_samples_come_back(name):
    data = FILES[name]
    s = pcm.scan(data)
    assert s.recognised and s.reason is None, s.detail
    l = s.layout
    x = pcm.samples(data, l)
    assert x.shape == (l.frames, l.channels)
    audio = next(k for k, c in enumerate(l.chunks) if c[3])
    assert pcm.rebuild(pcm.foreign_records(data, l), pcm.sample_bytes(x, l), audio, l.padding, data[l.end :]) == data


@pytest.mark.parametrize("name", FILES)
def test_flac_restores_the_same_bytes(name):
    made = flac.archive_audio(FILES[name])
    assert flac.restore(made) == FILES[name]
    assert flac.original_size(flac.read_header(made)) == len(FILES[name])


def test_samples_are_the_ones_written():
    x = tone(bits=24)
    for data in (wav(x, 24), aiff(x, 24), caf(x, 24), rf64(x, 24), w64(x, 24)):
        assert (pcm.samples(data, pcm.scan(data).layout) == x).all()


@pytest.mark.parametrize(("data", "reason"), [(wav(tone(), 16, tag=3), "float_samples"), (wav(tone(), 16, tag=85), "unsupported_encoding"), (wav(tone(), 16, rate=2_000_000), "sample_rate"), (aiff(tone(), 16, kind=b"fl32"), "float_samples"), (wav(tone(), 16)[:-7], "not_parsable")])
def test_reasons(data, reason):
    s = pcm.scan(data)
    assert s.recognised and s.layout is None and s.reason == reason


def test_not_recognised():
    assert not pcm.scan(b"").recognised
    assert not pcm.scan(b"RIFF\0\0\0\0AVI ....").recognised
    assert not pcm.scan(b"x" * 100).recognised


def test_tags():
    ixml = b"<BWFXML><PROJECT>A &amp; B</PROJECT><TAKE> 3 </TAKE><TRACK_LIST><TRACK><CHANNEL_INDEX>2</CHANNEL_INDEX><NAME>Boom</NAME></TRACK></TRACK_LIST></BWFXML>"
    info = b"INFO" + b"INAM" + struct.pack("<I", 3) + b"Hi\0\0" + b"IART" + struct.pack("<I", 2) + b"Me"
    data = wav(tone(), 16, before=bext() + chunk(b"iXML", ixml) + chunk(b"LIST", info))
    t = pcm.tags(data, pcm.scan(data).layout)
    assert ("DESCRIPTION", "A scene") in t and ("DATE", "2024-05-06T07:08:09") in t and ("TIME_REFERENCE", "123456") in t
    assert ("PROJECT", "A & B") in t and ("TAKE", "3") in t and ("TITLE", "Hi") in t and ("ARTIST", "Me") in t
    assert t[-1] == ("TRACK_NAME_02", "Boom")
    assert pcm.tags(data, pcm.scan(data).layout, channel=2)[-3:] == [("TRACK_NAME", "Boom"), ("CHANNEL", "2"), ("CHANNELS", "2")]
    head = flac.read_header(flac.archive_audio(data))
    assert head.get("project") == "A & B"


def test_checksums_and_numbers():
    assert flac.crc8(b"123456789") == 0xF4
    assert flac.crc16(b"123456789") == 0xFEE8
    for n in (0, 127, 128, 2047, 2048, 65535, 65536, (1 << 21) - 1, 1 << 21, (1 << 31) - 1, 1 << 31, (1 << 36) - 1):
        assert flac.read_number(flac.coded_number(n), 0) == (n, len(flac.coded_number(n)))


def test_frames_are_split_and_renumbered():
    x = tone(frames=20_000, bits=16)
    data = flac.encode(x, 48_000, 16)
    head = flac.read_header(data)
    frames = flac.split_frames(data, head.info, head.size)
    assert [f[0] for f in frames] == list(range(5))
    parts = [flac.decode_frame(data[a:b], head.info)[0] for _, a, b in frames]
    assert (np.concatenate(parts) == x).all()
    moved = flac.renumber(data[frames[1][1] : frames[1][2]], 70_000)
    again, number, used = flac.decode_frame(moved, head.info)
    assert number == 70_000 and used == len(moved) and (again == parts[1]).all()
    # segments encoded apart give the same frames
    assert b"".join(flac.encode_frames(x[:8192], 0, 16) + flac.encode_frames(x[8192:], 2, 16)) == data[head.size :]


def test_damage_is_noticed():
    data = bytearray(flac.archive_audio(FILES["wav16"]))
    data[-100] ^= 1
    with pytest.raises(flac.FlacError):
        flac.restore(bytes(data))
    with pytest.raises(flac.FlacError):
        flac.decode(bytes(data[:-5]))
    with pytest.raises(flac.FlacError):
        flac.read_header(b"OggS")


def test_groups_need_every_channel():
    x = tone(channels=3)
    members = [(k + 1, x[:, k]) for k in (2, 0, 1)]
    assert (flac.interleave(members) == x).all()
    for broken in (members[:2], [*members[:2], (2, x[:-1, 1])], [*members[:2], (1, x[:, 1])]):
        with pytest.raises(flac.FlacError):
            flac.interleave(broken)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(-(1 << 15), (1 << 15) - 1), min_size=1, max_size=200), st.integers(1, 3))
def test_any_samples_survive(values, channels):
    x = np.array(values[: len(values) // channels * channels], np.int32).reshape(-1, channels)
    assert (flac.decode(flac.encode(x, 8000, 16))[1] == x).all()


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=200), st.sampled_from([b"RIFF\x40\0\0\0WAVE", b"FORM\0\0\0\x40AIFF", b"caff\0\x01\0\0desc", b"RF64\xff\xff\xff\xffWAVEds64", b"fLaC"]))
def test_any_bytes_are_refused_without_failing(data, head):
    pcm.scan(head + data)
    try:
        flac.read_header(head + data)
    except flac.FlacError:
        pass


def test_checksums_of_any_length_equal_the_plain_loop():
    data = bytes(range(256)) * 5 + b"odd"
    for n in (0, 1, 2, 255, 256, 257, 700, len(data)):
        c = 0
        for b in data[:n]:
            c = (c << 8 & 0xFFFF) ^ flac._CRC16[c >> 8 ^ b]
        assert flac.crc16(data[:n]) == c


def test_a_stream_holds_eight_channels():
    with pytest.raises(flac.FlacError):
        flac.archive_audio(wav(tone(channels=9, frames=10), 16))
    data = wav(tone(channels=8, frames=10), 16)
    assert flac.restore(flac.archive_audio(data, ".wav")) == data


def test_channels_of_a_file_restore_it_in_any_order():
    data = wav(tone(channels=11, frames=5000), 24, trailing=b"end")
    members = flac.archive_channels(data, ".wav")
    assert len(members) == 11 and flac.restore_channels(members[::-1]) == data
    assert flac.original_size(flac.read_header(members[0])) == len(data) and flac.original_size(flac.read_header(members[1])) is None
    other = flac.archive_channels(wav(tone(channels=11, frames=5000, seed=2), 24), ".wav")
    for bad in (members[:-1], [*members[:-1], members[0]], [*members[:-1], other[-1]], [flac.archive_audio(data := wav(tone(), 16))]):
        with pytest.raises(flac.FlacError):
            flac.restore_channels(bad)
    with pytest.raises(flac.FlacError):
        flac.restore(members[0])


def test_largest_frame_need_not_be_stated():
    x = tone(frames=9000)
    data = flac.encode(x, 48000, 16)
    at = data.index(b"fLaC") + 8
    blind = data[: at + 4] + bytes(6) + data[at + 10 :]
    assert (flac.decode(blind)[1] == flac.decode(data)[1]).all()
