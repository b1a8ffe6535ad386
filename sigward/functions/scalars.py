"""Scalar helpers: every function takes and returns Columns and stays inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigward.functions import fixed

KIB = 1024


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def strip(c) -> Column:
    """Both ends free of white space, line ends included."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def split_fields(c, n: int) -> Column:
    """White-space separated field n (from 1); empty text when there is none."""
    return F.coalesce(F.get(F.split(strip(c), r"\s+"), F.lit(n - 1)), F.lit(""))


def clean_path(c) -> Column:
    """Drop one trailing literal backslash-n, every CR and LF, then trailing blanks."""
    c = F.regexp_replace(col(c), r"\\n$", "")
    return F.regexp_replace(F.translate(c, "\n\r", ""), r"\s+$", "")


def basename(c) -> Column:
    return F.element_at(F.split(col(c), "/"), -1)


def dirname(c) -> Column:
    return F.regexp_replace(col(c), r"/[^/]*$", "")


def truncate_label(c, longest: int, keep: int) -> Column:
    """Text over `longest` characters becomes its first `keep` characters and three dots."""
    c = col(c)
    return F.when(F.length(c) > longest, F.concat(F.substring(c, 1, keep), F.lit("..."))).otherwise(c)


def penultimate_segment(c) -> Column:
    """Dot segment before the last; the whole text when there is no dot."""
    parts = F.split(col(c), "[.]")
    return F.when(F.size(parts) < 2, col(c)).otherwise(F.get(parts, F.size(parts) - 2))


def quarantine_suffix(c) -> Column:
    """X of a name ending `.X.YYYYMMDD_HHMMSS`; null for other names."""
    return F.nullif(F.regexp_extract(col(c), r"\.([^.]*)\.[0-9]{8}_[0-9]{6}$", 1), F.lit(""))


def date_from_path(c, as_of) -> Column:
    """First run of eight digits as YYYY-MM-DD, else the day of `as_of`."""
    d = F.nullif(F.regexp_extract(col(c), r"[0-9]{8}", 0), F.lit(""))
    iso = F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2))
    return F.when(d.isNotNull(), iso).otherwise(F.date_format(as_of, "yyyy-MM-dd"))


def kv_value(c) -> Column:
    """Text after the first colon, trimmed; the whole text when there is no colon."""
    c = col(c)
    return strip(F.substr(c, F.instr(c, ":") + 1))


def sha256_hex(c) -> Column:
    return F.sha2(col(c), 256)


def sha256_short(c) -> Column:
    return F.substring(sha256_hex(c), 1, 16)


def quarantine_name(base, ts, ident) -> Column:
    """`{base}.quarantine.{HHMMSS}_{id}`."""
    return F.format_string("%s.quarantine.%s_%s", col(base), F.date_format(ts, "HHmmss"), col(ident).cast("string"))


def quarantine_name_epoch(base, ts, rule) -> Column:
    """`{base}.{epoch}.{rule}`."""
    return F.concat_ws(".", col(base), to_epoch(ts).cast("string"), col(rule))


def html_escape(c) -> Column:
    return F.replace(F.replace(col(c), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def digits_only(c) -> Column:
    """The digits of a text as a number; 0 when there are none, null when they exceed a bigint."""
    digits = F.regexp_replace(col(c), "[^0-9]", "")
    return F.when(digits == "", F.lit(0).cast("bigint")).otherwise(digits.try_cast("bigint"))


def glob_regex(glob: str) -> str:
    """Anchored regex of a shell glob with `*`, `?` and `[...]`.

    What stands between two stars is taken where it first occurs and never tried again, so a long text costs no recursion.
    """
    pieces, start, i = [], 0, 0
    while i < len(glob):
        close = glob.find("]", i + 2)
        if glob[i] == "[" and close > 0:
            i = close
        elif glob[i] == "*":
            pieces.append(glob[start:i])
            start = i + 1
        i += 1
    first, *rest = [piece_regex(p) for p in [*pieces, glob[start:]]]
    middle = "".join(f"(?>.*?{p})" for p in rest[:-1] if p)
    return f"(?s)^{first}{middle}{'.*' + rest[-1] if rest else ''}(?![\\s\\S])"


def piece_regex(glob: str) -> str:
    """Regex of a glob without stars."""
    out, i = "", 0
    while i < len(glob):
        ch = glob[i]
        close = glob.find("]", i + 2)
        if ch == "[" and close > 0:
            body = glob[i + 1 : close]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            i = close
        else:
            out += {"?": "."}.get(ch, re.escape(ch))
        i += 1
    return out


def glob_match(c, glob: str) -> Column:
    """Shell glob test; plain shapes become string comparisons that stay cheap and can be pushed down."""
    c = col(c)
    inner = glob.strip("*")
    if not re.search(r"[*?\[]", inner):
        if glob == inner:
            return c == glob
        if glob == "*" + inner:
            return F.endswith(c, F.lit(inner))
        if glob == inner + "*":
            return F.startswith(c, F.lit(inner))
        if glob == "*" + inner + "*":
            return F.contains(c, F.lit(inner))
    return c.rlike(glob_regex(glob))


def display_status(c, limit, danger=None) -> Column:
    """ok up to `limit`, warning above it, danger above `danger`."""
    band = F.when(col(c) > limit, "warning").otherwise("ok")
    if danger is None:
        return band
    return F.when(col(c) > danger, "danger").otherwise(band)


def default_value(c, default) -> Column:
    """The default for null or empty text."""
    return F.coalesce(F.nullif(col(c), F.lit("")), F.lit(default))


def extract_between(c, start: str, end: str | None = None) -> Column:
    """Text after the first `start`, up to the next `end` (or to the end of the text); null without markers."""
    c = col(c)
    tail = F.substr(c, F.instr(c, start) + F.lit(len(start)))
    found = F.instr(c, start) > 0
    if end is None:
        return F.when(found, tail)
    return F.when(found & F.contains(tail, F.lit(end)), F.substring_index(tail, end, 1))


def list_to_array(c, sep: str) -> Column:
    """Separated text as a trimmed array without empty items."""
    items = F.transform(F.split(col(c), re.escape(sep)), lambda x: strip(x))
    return F.filter(items, lambda x: x != "")


def array_to_list(a, sep: str) -> Column:
    return F.array_join(col(a), sep)


def map_lookup(m, k) -> Column:
    """Value of a key, null when absent."""
    return F.try_element_at(col(m), col(k))


def literal_map(pairs) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])


def json_field(c, path: str) -> Column:
    return F.get_json_object(col(c), path)


def json_array_has(c, path: str, value: str) -> Column:
    """Whether the text array at `path` holds `value`."""
    items = F.from_json(F.get_json_object(col(c), path), "array<string>")
    return F.coalesce(F.array_contains(items, value), F.lit(False))


def xml_attr(c, name: str) -> Column:
    """Value of the first attribute called `name`; null when absent."""
    return F.nullif(F.regexp_extract(col(c), rf'{name}="([^"]*)"', 1), F.lit(""))


def xml_body(c, tag: str) -> Column:
    """Text of the first element `tag` that holds no other element."""
    return F.nullif(F.regexp_extract(col(c), rf"<{tag}[^>]*>([^<]*)</{tag}>", 1), F.lit(""))


def days_ago(d, n: int) -> Column:
    return F.date_sub(col(d), n)


def date_fmt(d, fmt: str) -> Column:
    return F.date_format(col(d), fmt)


def to_epoch(ts) -> Column:
    return F.unix_seconds(col(ts).cast("timestamp"))


def from_epoch(n) -> Column:
    return F.timestamp_seconds(col(n))


def minutes_to_reset(ts) -> Column:
    return F.lit(60) - F.pmod(F.minute(col(ts)), F.lit(60))


def int_div(a, b) -> Column:
    """Whole-number division cut off towards zero, exact over the whole bigint range."""
    a, b = col(a).cast("bigint"), col(b).cast("bigint")
    return ((a - a % b).cast("decimal(19,0)") / b.cast("decimal(19,0)")).cast("bigint")


def version_format_ok(c) -> Column:
    return col(c).rlike(r"^[0-9]+(\.[0-9]+)?$")


def strip_ansi(c) -> Column:
    return F.regexp_replace(col(c), "\x1b\\[[0-9;]*m", "")


def pad(c, width: int, side: str = "right") -> Column:
    """Fixed width without cutting longer text, as printf does."""
    c = col(c)
    padded = F.rpad(c, width, " ") if side == "right" else F.lpad(c, width, " ")
    return F.when(F.length(c) < width, padded).otherwise(c)


def friendly_threat(c) -> Column:
    c = col(c)
    return F.coalesce(map_lookup(literal_map(fixed.FRIENDLY_NAMES), c), c)


def human_size(b) -> Column:
    """Bytes as 512, 4.0K, 12M, 1.5G, 5.0T, 2.0P: rounded up, one decimal below ten."""
    b = col(b)

    def unit(power: int, letter: str) -> Column:
        v = b / F.lit(float(KIB**power))
        tenths = F.ceil(v * 10) / 10
        return F.when(tenths < 10, F.format_string("%.1f" + letter, tenths)).otherwise(
            F.concat(F.ceil(v).cast("string"), F.lit(letter))
        )

    return (
        F.when(b > 1023 * KIB**4, unit(5, "P"))
        .when(b > 1023 * KIB**3, unit(4, "T"))
        .when(b > 1023 * KIB * KIB, unit(3, "G"))
        .when(b > 1023 * KIB, unit(2, "M"))
        .when(b > 1023, unit(1, "K"))
        .otherwise(b.cast("string"))
    )


def pct(used, total) -> Column:
    """Share in percent with one decimal; null for a zero total."""
    return F.round(F.try_divide(col(used) * F.lit(100.0), col(total)), 1)


def contains_any(c, words) -> Column:
    """Any of the given literals occurs (case kept)."""
    test = F.lit(False)
    for w in words:
        test = test | F.contains(col(c), F.lit(w))
    return test


def contains_ci(c, word: str) -> Column:
    return F.contains(F.lower(col(c)), F.lit(word.lower()))


def glob_case(c, pairs, default) -> Column:
    """Value of the first glob that fits, else `default`."""
    out = None
    for glob, value in pairs:
        out = F.when(glob_match(c, glob), value) if out is None else out.when(glob_match(c, glob), value)
    return out.otherwise(default)


def bare_alert(line) -> Column:
    """An alert line without the time stamp it may begin with."""
    return F.regexp_replace(col(line), r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2} ", "")
