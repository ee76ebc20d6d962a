"""Archive paths as columns: normal form, collision key, checks, names derived from other names."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_NAME_BYTES = 65_535


def nfc(path: Column) -> Column:
    """Canonical composition, which Spark has no function for."""
    return F.pandas_udf(_nfc, T.StringType())(path)


def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def fold_text(text: str) -> str:
    """Full case folding in composed form: strasse and STRASSE with a sharp s are one."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).casefold())


def fold(path: Column) -> Column:
    return F.pandas_udf(_fold, T.StringType())(path)


def _fold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else fold_text(x))


def normalize(path: Column, compose: bool = True) -> Column:
    """Forward slashes, no leading ./, no trailing slash (except of "/" itself); null if it holds a NUL."""
    s = F.translate(nfc(path) if compose else path, "\\", "/")
    s = F.regexp_replace(s, r"^(?:\./)+", "")
    s = F.when(s.rlike(r"^/+$"), F.lit("/")).otherwise(F.regexp_replace(s, r"/+$", ""))
    return F.when(~F.contains(path, F.lit("\0")), s)


def collision_key(path: Column) -> Column:
    return fold(normalize(path, compose=False))


def has_drive(s: Column) -> Column:
    return s.rlike(r"^[A-Za-z]:")


def archive_name_problem(s: Column) -> Column:
    """Why a normalised name cannot be written; null if it can. The first reason counts."""
    parts = F.split(s, "/")
    return (
        F.when(s.isNull() | (s == ""), "empty name")
        .when(F.octet_length(s) > MAX_NAME_BYTES, "name too long")
        .when(~F.is_valid_utf8(s), "not UTF-8")
        .when(F.contains(s, F.lit("\0")), "NUL character")
        .when(F.contains(s, F.lit("\\")), "backslash")
        .when(s.startswith("/"), "absolute path")
        .when(has_drive(s), "drive letter")
        .when(F.array_contains(parts, ""), "empty segment")
        .when(F.arrays_overlap(parts, F.array(F.lit("."), F.lit(".."))), "dot segment")
    )


def extraction_problem(name: Column) -> Column:
    """Why an entry's name is unsafe to extract; null if it is safe. Segments are judged in order."""
    s = F.translate(name, "\\", "/")
    parts = F.filter(F.split(s, "/"), lambda x: (x != "") & (x != "."))
    bad = F.element_at(F.filter(parts, lambda x: (x == "..") | F.contains(x, F.lit(":"))), 1)
    first = F.when(F.exists(parts, lambda x: (x == "..") | F.contains(x, F.lit(":"))), bad)
    return (
        F.when(F.contains(name, F.lit("\0")), "NUL character")
        .when(s.startswith("/"), "absolute path")
        .when(has_drive(s), "drive letter")
        .when(first == "..", "escapes the destination")
        .when(first.isNotNull(), "contains a colon")
        .when(F.size(parts) == 0, "no usable name")
    )


def extraction_path(name: Column) -> Column:
    """The name cleaned of empty and . segments; null where extraction_problem() has a reason."""
    parts = F.filter(F.split(F.translate(name, "\\", "/"), "/"), lambda x: (x != "") & (x != "."))
    return F.when(extraction_problem(name).isNull(), F.array_join(parts, "/"))


def under(root: Column, name: Column) -> Column:
    """Where an entry lands below a folder: safe names cannot leave it, whatever the folder is called."""
    return F.concat(F.regexp_replace(root, r"/+$", ""), F.lit("/"), extraction_path(name))


def stem(path: Column) -> Column:
    """The path without its extension; a dot that starts the last segment starts no extension."""
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")


def extension(path: Column) -> Column:
    """From the last dot of the last segment, which must not start with it; may be empty."""
    return F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)


def parent(path: Column) -> Column:
    """The folder of a path without a trailing slash; empty at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/?$", 1)


def flac_stem(output_name: Column, mono: Column) -> Column:
    plain = F.regexp_replace(output_name, r"(?i)\.flac$", "")
    return F.when(mono, F.regexp_replace(plain, r"_ch[0-9]+$", "")).otherwise(plain)


def member_name(stem_: Column, channel: Column, channels: Column) -> Column:
    width = F.greatest(F.lit(2), F.length(channels.cast("string")))
    digits = channel.cast("string")
    padded = F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))
    return F.concat(stem_, F.lit("_ch"), padded, F.lit(".flac"))


def restored_name(output_name: Column, mono: Column, original_extension: Column, kept_name: Column) -> Column:
    """What extraction makes of an encoded entry: its stem with the extension it had, or the stored name in its folder."""
    folder = F.regexp_extract(output_name, r"^(.*/)[^/]*$", 1)
    return F.when(kept_name.isNotNull(), F.concat(folder, kept_name)).otherwise(F.concat(flac_stem(output_name, mono), original_extension))


def group_id(stem_: Column, size: Column, mtime_ns: Column, prefix: str = "channel group\n") -> Column:
    """Sixteen bytes that depend on nothing but the arguments, with the bits of a version 8 UUID."""
    little = lambda v: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.lpad(F.hex(F.call_function("shiftrightunsigned", v, k * 8).bitwiseAND(F.lit(255))), 2, "0")), "")
    data = F.concat(F.encode(F.concat(F.lit(prefix), stem_), "UTF-8"), F.unhex(little(size.cast("long"))), F.unhex(little(mtime_ns.cast("long"))))
    digest = F.sha2(data, 256)
    nibble = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("long").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.unhex(F.concat(F.substring(digest, 1, 12), F.lit("8"), F.substring(digest, 14, 3), nibble, F.substring(digest, 18, 15)))


def with_prefix(folder: Column, path: Column) -> Column:
    return F.when(F.coalesce(folder, F.lit("")) == "", path).otherwise(F.concat(F.regexp_replace(folder, r"/+$", ""), F.lit("/"), path))


def ancestors(path: Column) -> Column:
    """All proper folder prefixes, shortest first; an empty array at the top level."""
    parts = F.split(F.regexp_replace(path, r"/+$", ""), "/")
    none = F.array().cast("array<string>")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(none)


def archive_output_name(names: Column) -> Column:
    """For an array of selected paths: the one item's name, or their common parent's, or Archive; with .zip."""
    parents = F.array_distinct(F.transform(names, lambda x: F.regexp_extract(x, r"([^/]*)/[^/]*$", 1)))
    one = F.regexp_extract(names[0], r"([^/]*)/?$", 1)
    many = F.when((F.size(parents) == 1) & (parents[0] != ""), parents[0]).otherwise(F.lit("Archive"))
    return F.concat(F.when(F.size(names) == 1, one).otherwise(many), F.lit(".zip"))


def valid_utf8(raw: Column) -> Column:
    """Whether bytes are UTF-8: the shortest forms only, no surrogates, nothing beyond U+10FFFF."""
    return F.is_valid_utf8(raw.cast("string"))
