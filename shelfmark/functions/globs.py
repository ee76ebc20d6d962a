"""File name patterns: checked once on the driver, translated to anchored regular expressions for Spark."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.paths import fold_text

# Names that systems and audio programs leave behind.
PRESETS = {
    "system": (".DS_Store", "._*", "__MACOSX/", ".Spotlight-V100/", ".Trashes/", ".fseventsd/", ".TemporaryItems/", ".DocumentRevisions-V100/", "Icon\r", "Thumbs.db", "ehthumbs.db", "desktop.ini", "$RECYCLE.BIN/", "System Volume Information/", "~$*", ".~lock.*#"),
    "daw_cache": ("WaveCache.wfm", "*.asd", "*.reapeaks", "*.pkf", "*.gpk", "*.sfk"),
}


class PatternError(ValueError):
    """A pattern that cannot match a single name."""


@dataclass(frozen=True)
class Glob:
    """One pattern; a trailing slash means folders only. Matching ignores case in full (after folding both sides)."""

    regex: str
    folders_only: bool

    @classmethod
    def parse(cls, pattern: str) -> Glob:
        body = pattern[:-1] if pattern.endswith("/") else pattern
        if not body:
            raise PatternError("empty pattern")
        if "/" in body:
            raise PatternError("a pattern is one name, without a slash inside")
        if "\0" in body:
            raise PatternError("NUL character")
        return cls(_translate(fold_text(body)), pattern.endswith("/"))

    def matches(self, name: str, is_folder: bool) -> bool:
        return (is_folder or not self.folders_only) and re.fullmatch(self.regex, fold_text(name), re.S) is not None


def _translate(body: str) -> str:
    out, at = [], 0
    while at < len(body):
        c = body[at]
        at += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "\\":
            if at == len(body):
                raise PatternError("nothing after the last backslash")
            out.append(_literal(body[at]))
            at += 1
        elif c == "[":
            piece, at = _set(body, at)
            out.append(piece)
        else:
            out.append(_literal(c))
    return "".join(out)


def _literal(c: str) -> str:
    return c if c.isalnum() or c in "_ " or ord(c) > 127 else f"\\x{ord(c):02x}"


def _set(body: str, at: int) -> tuple[str, int]:
    """A set from after its bracket; a closing bracket in first place stands for itself."""
    negate = at < len(body) and body[at] in "!^"
    at += negate
    members, first = [], True
    while True:
        if at >= len(body):
            raise PatternError("a set is not closed")
        c = body[at]
        if c == "]" and not first:
            break
        first = False
        if c == "\\" and at + 1 < len(body):
            at += 1
            c = body[at]
        at += 1
        if at + 1 < len(body) and body[at] == "-" and body[at + 1] != "]":
            end = body[at + 1]
            at += 2
            if end == "\\" and at < len(body):
                end = body[at]
                at += 1
            if c <= end:
                members.append(f"{_literal(c)}-{_literal(end)}")
        else:
            members.append(_literal(c))
    at += 1
    if not members:  # only a range the wrong way round: nothing matches, or everything
        return ("." if negate else "(?!)"), at
    return f"[{'^' * negate}{''.join(members)}]", at


def compile_patterns(patterns: list[str] | tuple[str, ...], presets: tuple[str, ...] = ()) -> list[Glob]:
    return [Glob.parse(p) for name in presets for p in PRESETS[name]] + [Glob.parse(p) for p in patterns]


def matches(folded: Column, is_folder: Column, globs: list[Glob]) -> Column:
    """Whether a folded name matches any pattern: two regular expressions, however many patterns."""
    def any_of(chosen: list[Glob]) -> Column:
        return folded.rlike(f"(?s)^(?:{'|'.join(g.regex for g in chosen)})\\z") if chosen else F.lit(False)

    return any_of([g for g in globs if not g.folders_only]) | (is_folder & any_of([g for g in globs if g.folders_only]))
