"""Text that people read: sizes, savings, durations, timecode, labels, escapes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KB", "MB", "GB", "TB")


def div(a: Column, b: Column) -> Column:
    """Whole-number quotient of columns."""
    return F.call_function("div", a, b)


def two(v: Column) -> Column:
    return F.lpad(v.cast("string"), 2, "0")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once, however often use mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tenths(x: Column) -> Column:
    """A double of zero or more with one decimal, by its exact binary value: 0.25 gives 0.2, 0.35 gives 0.3.

    Twenty times the value is compared with the odd number at the middle; the value is split into two halves
    whose products are exact, so the comparison is.
    """
    n = F.floor(x * 10.0).cast("long")
    spread = x * 134217729.0
    high = spread - (spread - x)
    past = (high * 20.0 - (n * 2 + 1).cast("double")) + (x - high) * 20.0
    n = (n + F.when((past > 0) | ((past == 0) & (F.pmod(n, F.lit(2)) == 1)), 1).otherwise(0)).cast("long")
    return F.concat(div(n, F.lit(10)).cast("string"), F.lit("."), F.pmod(n, F.lit(10)).cast("string"))


def human_size(size: Column) -> Column:
    """Decimal units, one decimal above bytes."""
    out, value = F.concat(size.cast("string"), F.lit(" B")), size.cast("double")
    for k in range(1, len(UNITS)):
        value = value / 1000.0
        out = F.when(size >= 1000**k, F.concat(tenths(value), F.lit(f" {UNITS[k]}"))).otherwise(out)
    return out


def percent_saved(size: Column, packed: Column) -> Column:
    """Halves away from zero; 0 for an empty entry."""
    return F.when(size == 0, 0).otherwise(F.round((1.0 - packed.cast("double") / size.cast("double")) * 100.0, 0)).cast("int")


def percent_text(size: Column, packed: Column) -> Column:
    """For previews: halves to even, and a word for the sign."""
    change = (1.0 - packed.cast("double") / size.cast("double")) * 100.0
    number = F.bround(F.abs(change), 0).cast("long").cast("string")
    return F.when(size == 0, "").otherwise(F.concat(number, F.when(packed <= size, "% smaller").otherwise("% larger")))


def savings_text(size: Column, packed: Column) -> Column:
    saved = percent_saved(size, packed)
    return F.concat(human_size(size), F.lit(" → "), human_size(packed), F.lit(", "), F.abs(saved).cast("string"), F.lit("% "), F.when(saved >= 0, "smaller").otherwise("larger"))


def duration(samples: Column, rate: Column) -> Column:
    """m:ss.mmm, from an hour on h:mm:ss.mmm; empty without a rate."""
    ms = div(samples * 1000, F.when(rate > 0, rate).otherwise(1))
    s = div(ms, F.lit(1000))
    tail = F.concat(two(F.pmod(s, F.lit(60))), F.lit("."), F.lpad(F.pmod(ms, F.lit(1000)).cast("string"), 3, "0"))
    minutes, hours = F.pmod(div(s, F.lit(60)), F.lit(60)), div(s, F.lit(3600))
    text = F.when(hours > 0, F.concat(hours.cast("string"), F.lit(":"), two(minutes), F.lit(":"), tail)).otherwise(F.concat(minutes.cast("string"), F.lit(":"), tail))
    return F.when(F.coalesce(rate, F.lit(0)) <= 0, "").otherwise(text)


def timecode(samples: Column, rate: Column, num: Column, den: Column, drop: Column) -> Column:
    """HH:MM:SS:FF at num/den frames a second, with dropped numbers at 30 and 60; milliseconds without a frame rate. Hours wrap at a day."""
    ms = div(samples * 1000, F.when(rate > 0, rate).otherwise(F.lit(1)))
    clock = lambda t: F.concat(two(F.pmod(div(t, F.lit(3600)), F.lit(24))), F.lit(":"), two(F.pmod(div(t, F.lit(60)), F.lit(60))), F.lit(":"), two(F.pmod(t, F.lit(60))))
    plain = F.concat(bind(div(ms, F.lit(1000)), clock), F.lit("."), F.lpad(F.pmod(ms, F.lit(1000)).cast("string"), 3, "0"))
    safe_num, safe_den = F.when(num > 0, num).otherwise(F.lit(1)), F.when(den > 0, den).otherwise(F.lit(1))
    nominal = F.greatest(F.round(safe_num.cast("double") / safe_den, 0).cast("long"), F.lit(1))
    frames = div(samples * safe_num, F.when(rate > 0, rate).otherwise(F.lit(1)) * safe_den)

    def skipped(at: Column, gone: int, nominal: int) -> Column:
        """Frame numbers with those that are dropped in every minute but the tenth."""
        per_ten, per_one = nominal * 600 - gone * 9, nominal * 60 - gone
        rest = F.pmod(at, F.lit(per_ten))
        return at + div(at, F.lit(per_ten)) * (gone * 9) + F.when(rest > gone, div(rest - gone, F.lit(per_one)) * gone).otherwise(F.lit(0))

    counted = bind(frames, lambda n: F.when(drop & (nominal == 30), skipped(n, 2, 30)).when(drop & (nominal == 60), skipped(n, 4, 60)).otherwise(n))
    framed = bind(F.struct(counted.alias("n"), nominal.alias("by")), lambda x: F.concat(bind(div(x["n"], x["by"]), clock), F.when(drop, ";").otherwise(":"), two(F.pmod(x["n"], x["by"]))))
    return F.when(F.coalesce(rate, F.lit(0)) <= 0, "").when((F.coalesce(num, F.lit(0)) <= 0) | (F.coalesce(den, F.lit(0)) <= 0), plain).otherwise(framed)


def frame_rate(text: Column) -> tuple[Column, Column, Column]:
    """(num, den, drop) of a rate such as `30000/1001 DF`; 0 where it does not start with a number."""
    upper = F.upper(F.coalesce(text, F.lit("")))
    number = F.regexp_extract(upper, r"^\s*(\d+)", 1)
    rate = F.split(upper, " ")[0]
    den = F.regexp_extract(rate, r"/(\d+)", 1)
    drop = F.contains(upper, F.lit(" DF")) | (upper.endswith("DF") & ~upper.endswith("NDF"))
    zero = F.lit(0).cast("long")
    return F.when(number == "", zero).otherwise(number.cast("long")), F.when(~F.contains(rate, F.lit("/")), F.lit(1).cast("long")).when(den == "", zero).otherwise(den.cast("long")), drop


def minute_text(mtime: Column) -> Column:
    """Seconds since 1970 as a UTC minute in any session's time zone; years have four digits, or as many as they need (10000, -1)."""
    second = F.pmod(mtime, F.lit(86_400))
    day = F.date_from_unix_date(div(mtime - second, F.lit(86_400)).cast("int"))
    year = F.when(F.year(day).between(0, 9999), F.lpad(F.year(day).cast("string"), 4, "0")).otherwise(F.year(day).cast("string"))
    return F.concat(year, F.lit("-"), two(F.month(day)), F.lit("-"), two(F.dayofmonth(day)), F.lit(" "), two(div(second, F.lit(3600))), F.lit(":"), two(F.pmod(div(second, F.lit(60)), F.lit(60))))


def mtime_seconds(mtime_ns: Column) -> Column:
    """Whole seconds, rounded down also before 1970."""
    return div(mtime_ns - F.pmod(mtime_ns, F.lit(1_000_000_000)), F.lit(1_000_000_000))


def pick(code: Column, names: dict, otherwise: Column | None = None) -> Column:
    out = None
    for k, v in names.items():
        out = F.when(code == k, v) if out is None else out.when(code == k, v)
    return out.otherwise(otherwise) if otherwise is not None else out


# The words for codes.
CONFLICTS = {0: "collision", 1: "invalid_name", 2: "parent_clash"}
DECISIONS = {0: "undecided", 1: "replace", 2: "skip"}
ISSUES = {0: "unsafe_path", 1: "collision", 2: "incomplete_group", 3: "exists", 4: "unsupported", 5: "parent_clash"}
METHODS = {0: "stored", 8: "deflated"}


def cli_method(method: Column, restorable: Column, channels: Column) -> Column:
    return F.when(restorable & (channels > 1), "flac-mono").when(restorable, "flac").when(method == 0, "store").when(method == 8, "deflate").otherwise(F.concat(F.lit("unsupported("), method.cast("string"), F.lit(")")))


def browser_method(kind: Column, method: Column, restorable: Column, channels: Column) -> Column:
    return F.when(kind == "symlink", "Symlink").when(restorable & (channels > 1), "FLAC multi-mono").when(restorable, "FLAC").when(method == 0, "Store").when(method == 8, "Deflate").otherwise("Unsupported")


def summary_method(label: Column) -> Column:
    return F.when(label.isin("Store", "Deflate", "FLAC", "FLAC multi-mono"), label).otherwise("Other")


def preview_method(method: Column, flac_header: Column) -> Column:
    return F.when(flac_header, "FLAC").when(method == 0, "Stored").when(method == 8, "Deflate").otherwise(F.concat(F.lit("Method "), method.cast("string")))


def method_key(label: Column) -> Column:
    return F.when(F.contains(label, F.lit("multi")), "flac-mono").when(label.startswith("FLAC"), "flac").otherwise(F.lower(label))


def planned_method(kind: Column, codec: Column, channel: Column, channels: Column, stored: Column) -> Column:
    return (
        F.when(kind == "directory", "Folder")
        .when(codec == "kept", F.lit(None).cast("string"))
        .when(codec == "generated", "Readme")
        .when(codec == "flac", "FLAC")
        .when(codec == "flac_mono", F.concat(F.lit("FLAC channel "), channel.cast("string"), F.lit("/"), channels.cast("string")))
        .when(stored, "Store")
        .otherwise("Deflate")
    )


def container(head: Column) -> Column:
    """Name of an audio container from its first bytes as upper-case hex."""
    return (
        F.when(head.startswith("52463634") | head.startswith("42573634"), "RF64")
        .when(head.startswith("52494646"), "WAVE")
        .when(head.startswith("464F524D") & (F.substring(head, 17, 8) == "41494643"), "AIFF-C")
        .when(head.startswith("464F524D"), "AIFF")
        .when(head.startswith("63616666"), "CAF")
        .when(head.startswith("72696666"), "Wave64")
    )


def html_escape(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def xml_text(source: Column, element: str) -> Column:
    """Trimmed text of the first <element>…</element>, its five named characters decoded; null without one."""
    raw = F.regexp_extract(source, f"(?s)<{element}>(.*?)</{element}>", 1)
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        raw = F.replace(raw, F.lit(a), F.lit(b))
    return F.when(source.rlike(f"(?s)<{element}>.*?</{element}>"), F.regexp_replace(raw, r"^[ \t\r\n]+|[ \t\r\n]+$", ""))


def throughput(done: Column, total: Column, seconds: Column) -> tuple[Column, Column]:
    """(bytes a second, time left as m:ss), null before half a second or the first byte."""
    known = (seconds >= 0.5) & (done > 0)
    rate = F.when(known, done / seconds)
    left = F.ceil((total - done) / rate).cast("long")
    return rate, F.when(known, F.concat(div(left, F.lit(60)).cast("string"), F.lit(":"), two(F.pmod(left, F.lit(60)))))


def latin1_or_utf8(data: Column) -> Column:
    """Bytes up to the first NUL, as UTF-8 if they are, else as Latin-1, without white space at the end."""
    cut = F.unhex(F.regexp_extract(F.hex(data), r"^((?:(?!00)..)*)", 1))
    text = F.when(F.is_valid_utf8(cut.cast("string")), F.decode(cut, "UTF-8")).otherwise(F.decode(cut, "ISO-8859-1"))
    return F.regexp_replace(text, r"[ \t\r\n]+$", "")


def render(template: Column, values: dict[str, Column]) -> Column:
    """A text with {name} placeholders filled in, each value as it is, and lines ended as archives' texts are (CR LF)."""
    # one pass over the template's pieces, so that a value that looks like a placeholder stays what it is
    names = "|".join(values)
    pieces = F.split(F.regexp_replace(template, f"\\{{({names})\\}}", "\u0000$1\u0000"), "\u0000")
    filled = F.transform(pieces, lambda x, k: F.when(k % 2 == 1, pick(x, values)).otherwise(x))
    return F.replace(F.array_join(filled, ""), F.lit("\n"), F.lit("\r\n"))
