"""Byte kernels as Arrow UDFs: deflate, inflate, sampling, checksums that combine."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.operators import segments as S

DICTIONARY = 32 << 10
SYNC = b"\x00\x00\xff\xff"


def deflate_segment(data: bytes, level: int, before: bytes = b"", last: bool = True) -> bytes:
    """One raw deflate segment; joined in order with those before it (whose end is its dictionary) it is one stream."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15, 8, zlib.Z_DEFAULT_STRATEGY, before[-DICTIONARY:]) if before else zlib.compressobj(level, zlib.DEFLATED, -15)
    return c.compress(data) + c.flush(zlib.Z_FINISH if last else zlib.Z_SYNC_FLUSH)


def inflate(data: bytes) -> tuple[bytes | None, str]:
    d = zlib.decompressobj(-15)
    try:
        out = d.decompress(data) + d.flush()
    except zlib.error:
        return None, "corrupt_archive"
    return (out, "ok") if d.eof else (None, "corrupt_archive")


#: Encoders and decoders by method; others are unsupported.
CODECS = {0: (lambda data, level: data, lambda data: (data, "ok")), 8: (lambda data, level: deflate_segment(data, level), inflate)}


def encode(method: int, data: Column, level: int = 6) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else CODECS[method][0](x, level))

    if method not in CODECS:
        raise ValueError("unsupported_method")
    return F.pandas_udf(run, T.BinaryType())(data)


_DECODED = T.StructType([T.StructField("content", T.BinaryType()), T.StructField("status", T.StringType())])


def _decode(raw: pd.Series, method: pd.Series) -> pd.DataFrame:
    out = [(None, "unsupported_method") if m not in CODECS else (None, "corrupt_archive") if r is None else CODECS[m][1](r) for r, m in zip(raw, method, strict=True)]
    return pd.DataFrame(out, columns=["content", "status"])


def decode(raw: Column, method: Column) -> Column:
    """struct<content, status>."""
    return F.pandas_udf(_decode, _DECODED)(raw, method)


def deflated_size(data: Column, level: int = 6) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: len(deflate_segment(x, level)) if x is not None else 0).astype("int64")

    return F.pandas_udf(run, T.LongType())(data)


def sampled_store(content: Column, size: Column, window: int = 64 << 10, level: int = 6) -> Column:
    """Whether compressing the sample windows would not pay off; false for empty entries."""
    starts = S.sample_windows(size, window)
    pieces = F.array_join(F.transform(starts, lambda a: F.hex(F.substring(content, (a + 1).cast("int"), F.lit(window)))), ",")

    def run(s: pd.Series) -> pd.Series:
        def size_of(x: str) -> int:
            return sum(len(deflate_segment(bytes.fromhex(p), level)) for p in x.split(","))

        return s.map(lambda x: size_of(x) if x else 0).astype("int64")

    taken = F.least(size, F.lit(window)) * F.size(starts)
    return F.when(size == 0, False).otherwise(~S.pays_off(F.pandas_udf(run, T.LongType())(pieces), taken))


def predict_store(plan: DataFrame) -> DataFrame:
    """entry, stored: yes for audio that fell back, no for folders, empty and converted entries, else as sampled."""
    fixed = F.when(F.col("fallback_reason").isNotNull(), True).when((F.col("codec") != "general") | (F.col("kind") == "directory") | (F.col("size") == 0), False)
    return plan.select("entry", F.coalesce(fixed, sampled_store(F.col("content"), F.col("size"))).alias("stored"))


def crc_shift(crc: int, length: int) -> int:
    """What a CRC-32 register becomes after so many zero bytes: multiplication by a power of x modulo the polynomial."""
    def times(a: int, b: int) -> int:
        out = 0
        for _ in range(32):
            if a & 0x80000000:
                out ^= b
            b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
            a = (a << 1) & 0xFFFFFFFF
        return out

    base, power = 0x00800000, 0x80000000  # x^8 and 1, lowest power in the highest bit
    while length:
        if length & 1:
            power = times(power, base)
        base = times(base, base)
        length >>= 1
    return times(power, crc)


def crc_combine(first: int, second: int, second_length: int) -> int:
    return crc_shift(first, second_length) ^ second


def combine_crcs(segments: DataFrame) -> DataFrame:
    """entry, crc32, size from segments (entry, seg, crc32, size) in their order."""
    def run(crcs: pd.Series, sizes: pd.Series) -> pd.Series:
        out = []
        for cs, ns in zip(crcs, sizes, strict=True):
            total = 0
            for c, n in zip(cs, ns, strict=True):
                total = crc_combine(total, int(c), int(n))
            out.append(total)
        return pd.Series(out, dtype="int64")

    parts = segments.groupBy("entry").agg(F.array_sort(F.collect_list(F.struct("seg", "crc32", "size"))).alias("p"), F.sum("size").alias("size"))
    crc = F.pandas_udf(run, T.LongType())(F.transform("p", lambda x: x["crc32"]), F.transform("p", lambda x: x["size"]))
    return parts.select("entry", crc.alias("crc32"), "size")


def encode_segments(entries: DataFrame, level: int = 6) -> DataFrame:
    """entry, seg, method, size, crc32, raw for entries (entry, method, size, content), each segment a row of its own.

    A segment carries the 32 KiB before it, so segments are encoded in any order on any executor.
    """
    def run(batches):
        for pdf in batches:
            raw = [deflate_segment(d, level, b or b"", bool(last)) if m == 8 else d for d, b, m, last in zip(pdf["data"], pdf["before"], pdf["method"], pdf["is_last"], strict=True)]
            yield pd.DataFrame({"entry": pdf["entry"], "seg": pdf["seg"], "method": pdf["method"], "size": [len(d) for d in pdf["data"]], "crc32": [zlib.crc32(d) for d in pdf["data"]], "raw": raw})

    cut = S.segments(entries.select("entry", "size", "method"), small=S.DEFLATE_SEGMENT).join(entries.select("entry", "method", "content", F.col("size").alias("total")), "entry")
    piece = F.expr("substring(content, cast(first + 1 as int), cast(last - first as int))")
    before = F.expr(f"substring(content, cast(greatest(first - {DICTIONARY}, 0) + 1 as int), cast(least(first, {DICTIONARY}) as int))")
    rows = cut.select("entry", "seg", "method", piece.alias("data"), before.alias("before"), (F.col("last") >= F.col("total")).alias("is_last"))
    return rows.mapInPandas(run, "entry long, seg int, method int, size long, crc32 long, raw binary")


def join_segments(encoded: DataFrame) -> DataFrame:
    """entry, method, size, packed, crc32, raw: segments of an entry put together in order."""
    grouped = encoded.groupBy("entry").agg(F.max("method").alias("method"), F.array_sort(F.collect_list(F.struct("seg", "raw"))).alias("p"))
    raw = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["raw"])), ""))
    return grouped.select("entry", "method", raw.alias("raw")).join(combine_crcs(encoded), "entry").withColumn("packed", F.octet_length("raw").cast("long"))
