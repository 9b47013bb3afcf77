"""Scalar functions as Column expressions; all stay inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latest time a commit may carry, and the size below which a file is inline (fixed values).
MAX_TIME = (1 << 34) - 1
INLINE_LIMIT = 65_536
HEX_ID = "^[0-9a-f]{64}$"


def clamp_time(seconds: Column) -> Column:
    return F.greatest(F.lit(0), F.least(seconds, F.lit(MAX_TIME)))


def is_id(c: Column) -> Column:
    return c.rlike(HEX_ID)


def is_inline(size: Column) -> Column:
    return size < INLINE_LIMIT


def _ladder(n: Column, base: int, units: list[str], shown) -> Column:
    """The largest unit that does not exceed the number."""
    out = shown(n, 0)
    for i in range(1, len(units)):
        out = F.when(n >= F.lit(base) ** i, shown(n, i)).otherwise(out)
    return out


def _one_decimal(value: Column) -> Column:
    """A double of at least 1 as ``%.1f`` prints it: its exact value, to the even digit if that is a tie."""
    whole = F.floor(value)
    rest = ((value - whole.cast("double")) * F.lit(float(1 << 52))).cast("bigint") * 10  # exact: 52 binary digits
    tenth = F.shiftright(rest, 52)
    over, half = rest.bitwiseAND(F.lit((1 << 52) - 1)), F.lit(1 << 51)
    up = (over > half) | ((over == half) & (tenth % 2 == 1))
    tenth = tenth + up.cast("bigint")
    return F.concat((whole + F.when(tenth == 10, 1).otherwise(0)).cast("string"), F.lit("."), (tenth % 10).cast("string"))


def format_bytes(n: Column, largest: str = "PB") -> Column:
    """1024-based, one decimal: ``1.5 KB``; plain bytes below that, no unit above the ``largest``."""
    units = ["B", "KB", "MB", "GB", "TB", "PB"]

    def shown(x: Column, i: int) -> Column:
        number = _one_decimal(x.cast("double") / F.lit(float(1024**i))) if i else x.cast("string")
        return F.concat(number, F.lit(f" {units[i]}"))

    return _ladder(n, 1024, units[: units.index(largest) + 1], shown)


def format_count(n: Column) -> Column:
    return F.format_number(n, 0)


def format_decimal_bytes(n: Column, largest: str = "TB") -> Column:
    """1000-based: ``1.5 MB``; one decimal, which is dropped if it is 0. No unit above the ``largest``."""
    units = ["B", "KB", "MB", "GB", "TB"]

    def shown(x: Column, i: int) -> Column:
        number = _one_decimal(x.cast("double") / F.lit(float(1000**i))) if i else x.cast("string")
        return F.concat(F.regexp_replace(number, r"\.0$", ""), F.lit(f" {units[i]}"))

    return _ladder(n, 1000, units[: units.index(largest) + 1], shown)


def parse_bytes(text: Column) -> Column:
    """``5kb``, ``2 GB``; a bare ``0`` is zero, anything else without a unit is null."""
    clean = F.lower(F.trim(text))
    number = F.regexp_extract(clean, r"^([0-9]+)\s*(kb|mb|gb|tb)$", 1)
    unit = F.regexp_extract(clean, r"^([0-9]+)\s*(kb|mb|gb|tb)$", 2)
    scale = F.when(unit == "kb", 10**3).when(unit == "mb", 10**6).when(unit == "gb", 10**9).otherwise(10**12)
    value = F.try_multiply(number.try_cast("bigint"), scale.cast("bigint"))
    return F.when(clean == "0", F.lit(0).cast("bigint")).when(unit != "", value)


def parse_quota(text: Column) -> Column:
    """-1 removes the quota (``none``, ``unlimited``); null is refused."""
    clean = F.lower(F.trim(text))
    size = parse_bytes(text)
    return F.when(clean.isin("none", "unlimited"), F.lit(-1).cast("bigint")).when(size > 0, size)


def parse_fraction(text: Column) -> Column:
    value = F.trim(text).try_cast("double")
    return F.when((value >= 0) & (value <= 1), value)


def _whole(text: Column) -> Column:
    clean = F.trim(text)
    return F.when(clean.rlike("^[+-]?[0-9]+$"), clean.try_cast("bigint"))


def parse_count(text: Column) -> Column:
    """A whole number of at least 1; null is refused."""
    return F.when(_whole(text) >= 1, _whole(text))


def parse_days(text: Column) -> Column:
    """Whole days, 0 keeps everything; null is refused."""
    return F.when(_whole(text) >= 0, _whole(text))


#: Units of a duration in nanoseconds (fixed values).
DURATIONS = {"ns": 1, "us": 10**3, "µs": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9}


def parse_duration(text: Column) -> Column:
    """Nanoseconds of ``1h30m``, ``1.5s``, ``300ms``; null unless positive and with units."""
    clean = F.regexp_replace(F.trim(text), r"^\+", "")
    number = r"(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)"
    parts = F.regexp_extract_all(clean, F.lit(rf"({number}(?:ns|us|µs|ms|s|m|h))"), F.lit(1))

    def nanos(part: Column) -> Column:
        unit = F.regexp_extract(part, "([a-zµ]+)$", 1)
        scale = F.element_at(F.create_map(*[F.lit(x) for k, v in DURATIONS.items() for x in (k, v)]), unit)
        return F.regexp_extract(part, f"^({number})", 1).cast("decimal(28,9)") * scale

    total = F.aggregate(parts, F.lit(0).cast("decimal(38,9)"), lambda a, p: (a + nanos(p)).cast("decimal(38,9)"))
    ok = clean.rlike(rf"^(?:{number}(?:ns|us|µs|ms|s|m|h))+$")
    value = F.when(ok, F.floor(total).cast("bigint"))
    return F.when(value > 0, value)


#: Variable parts of a message, in the order in which they are replaced (fixed values). Words end
#: between ASCII word characters and others.
_BEGIN, _END = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"
VARIABLE_PARTS = [
    ('"[^"]*"', '"<str>"'),
    (r"[\w.+-]+@[\w-]+\.[\w.-]+", "<email>"),
    (_BEGIN + "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}" + _END, "<id>"),
    (_BEGIN + "[0-9a-fA-F]{8,}" + _END, "<hash>"),
    (_BEGIN + "[0-9]+" + _END, "<n>"),
]


def normalise_message(text: Column) -> Column:
    """Variable parts of a message become placeholders."""
    return reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), VARIABLE_PARTS, text)


def size_bucket(n: Column) -> Column:
    """The name of a size's class (names and bounds are fixed values)."""
    return (
        F.when(n == 0, "empty").when(n < 4 << 10, "under-4kb").when(n < 64 << 10, "4kb-64kb")
        .when(n < 1 << 20, "64kb-1mb").when(n < 16 << 20, "1mb-16mb").otherwise("over-16mb")
    )


def valid_params(least: Column, target: Column, most: Column, level: Column) -> Column:
    """Whether chunks can be cut by these bounds and this level (as :meth:`Params.check` has it)."""
    bits = F.floor(F.log2(target))
    return (least > 0) & (least <= target) & (target <= most) & level.between(0, 3) & (bits - level >= 1) & (bits + level <= 63)


def top_mask(bits: Column) -> Column:
    """A 64-bit mask of the top ``bits`` bits."""
    return F.call_function("shiftleft", F.lit(-1).cast("long"), (F.lit(64) - bits).cast("int"))


def checked_sum(values: Column) -> Column:
    """A sum of longs, null if it does not fit 64 bits."""
    return F.sum(values.cast("decimal(38,0)")).try_cast("bigint")


def call_site(frames: Column) -> Column:
    return F.when(F.size(frames) > 0, F.element_at(frames, -1))


def byte_range(header: Column, size: Column) -> Column:
    """(first, last) of ``bytes=a-b``, ``bytes=a-`` or ``bytes=-n``; null if it can't be met, as
    when the last ``n`` bytes of a shorter file are asked for."""
    pattern = r"^(?:[^=-]*=)?([0-9]*)-([0-9]*)$"
    a, b = F.regexp_extract(header, pattern, 1), F.regexp_extract(header, pattern, 2)
    first, last = a.try_cast("bigint"), b.try_cast("bigint")
    start = F.when(a != "", first).otherwise(size - last)
    end = F.when((a != "") & (b != ""), F.least(last, size - 1)).otherwise(size - 1)
    ok = ((a != "") | (last > 0)) & (start >= 0) & (start <= end)
    return F.when(ok, F.struct(start.alias("first"), end.alias("last")))


#: File name extensions and their media types (fixed values).
MEDIA_TYPES = {
    "html": "text/html", "txt": "text/plain", "md": "text/markdown", "json": "application/json",
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif",
    "pdf": "application/pdf", "mp4": "video/mp4", "mp3": "audio/mpeg", "zip": "application/zip",
}


def content_type(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    return F.coalesce(F.element_at(table, ext), F.lit("application/octet-stream"))


def normalise_address(text: Column) -> Column:
    return F.lower(F.trim(text))


def principal_kind(text: Column) -> Column:
    return F.split_part(text, F.lit(":"), F.lit(1))


def next_link(header: Column) -> Column:
    """The target of the ``rel="next"`` link of a Link header; null without one."""
    found = F.regexp_extract(header, r'<([^>]*)>\s*;[^,<]*rel="?next"?', 1)
    return F.when(found != "", found)


def dead_bytes(frame: Column, live: Column) -> Column:
    return frame - live


def dead_fraction(frame: Column, live: Column) -> Column:
    return F.coalesce(F.try_divide((frame - live).cast("double"), frame.cast("double")), F.lit(0.0))


#: The alphabet of codes, and the characters of a recovery code (fixed values).
CODE_ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
CODE_LENGTH = 32


def recovery_code(text: Column) -> Column:
    """A code as it is compared: spaces, tabs and hyphens dropped, upper case, look-alikes folded;
    null if a character is no code character or the length is wrong."""
    folded = F.translate(F.regexp_replace(text, "[ \t-]", ""), "abcdefghijklmnopqrstuvwxyzILO", "ABCDEFGH1JK1MN0PQRSTUVWXYZ110")
    return F.when(folded.rlike(f"^[{CODE_ALPHABET}]{{{CODE_LENGTH}}}$"), folded)


def shown_code(code: Column) -> Column:
    """A code in groups of four."""
    return F.regexp_replace(F.regexp_replace(code, "(.{4})", "$1-"), "-$", "")


def redact(text: Column, prefix: str, symbols: int = 16) -> Column:
    """Setup tokens (a prefix and groups of four code characters) are blanked."""
    groups = f"(?:-[{CODE_ALPHABET}]{{4}}){{{symbols // 4}}}"
    return F.regexp_replace(text, _BEGIN + prefix + groups + _END, f"{prefix}-[redacted]")


def redact_event(message: Column, tags: Column, exceptions: Column, breadcrumbs: Column, prefix: str) -> Column:
    """All places of an event that a token can reach: the message, the values of the tags, and
    the texts of exceptions and breadcrumbs."""
    return F.struct(
        redact(message, prefix).alias("message"),
        F.transform_values(tags, lambda _, v: redact(v, prefix)).alias("tags"),
        F.transform(exceptions, lambda v: redact(v, prefix)).alias("exceptions"),
        F.transform(breadcrumbs, lambda v: redact(v, prefix)).alias("breadcrumbs"),
    )


def render_name(name: Column, hidden: Column) -> Column:
    """The plain name, or unpadded base64url of the sealed one."""
    sealed = F.regexp_replace(F.translate(F.base64(name.cast("binary")), "+/", "-_"), r"[=\r\n]", "")
    return F.when(hidden, sealed).otherwise(name)


def path_segments(path: Column) -> Column:
    """Non-empty segments; null if one of them is ``.`` or ``..``."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.when(~F.exists(parts, lambda x: x.isin(".", "..")), parts)


def path_join(a: Column, b: Column) -> Column:
    return F.when(a == "", b).otherwise(F.concat_ws("/", a, b))


def path_base(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def path_dir(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_H = "[0-9a-fA-F]{1,4}"
_IPV6 = (
    rf"(?:(?:{_H}:){{7}}{_H}|(?=(?:[^:]*:){{2,7}}[^:]*$)(?!.*::.*::)(?:{_H}(?::{_H})*)?::(?:{_H}(?::{_H})*)?)"
)


def address(text: Column) -> Column:
    """An IP address, trimmed; null if it is none. IPv6 is lower-cased, not shortened."""
    clean = F.trim(text)
    return F.when(clean.rlike(f"^{_IPV4}$"), clean).when(clean.rlike(f"^{_IPV6}$"), F.lower(clean))


def client_ip(forwarded: Column, real: Column, remote: Column, hops: int, trusted: bool = True) -> Column:
    """The address a trusted number of hops (1 at least) from the right of the list; else the proxy's
    single value; else the peer's host. An entry that is no address is not skipped over."""
    host = F.coalesce(
        F.nullif(F.regexp_extract(remote, r"^\[([^\]]*)\]:[0-9]+$", 1), F.lit("")),
        F.nullif(F.regexp_extract(remote, r"^([^:\[\]]*):[0-9]+$", 1), F.lit("")), remote,
    )
    if not trusted:
        return host
    hops = max(1, hops)
    parts = F.split(F.coalesce(forwarded, F.lit("")), ",")
    listed = F.when(F.size(parts) >= hops, address(F.try_element_at(parts, F.lit(-hops))))
    return F.coalesce(listed, address(real), host)


def backoff_window(attempt: Column) -> Column:
    """Milliseconds: 50 doubled per attempt up to the fifth, one second at most."""
    return F.least(F.lit(50) * F.pow(F.lit(2), F.least(attempt, F.lit(5))), F.lit(1000)).cast("long")


def lane_of(path: Column) -> Column:
    bulk = path.contains("/chunks") | path.contains("/objects") | path.contains("/entries")
    return F.when(bulk, "bulk").otherwise("control")


def covers(scope: Column, library: Column, path: Column) -> Column:
    """Whether a scope (all, a library, or ``library:path``) covers a path of a library."""
    lib = F.split_part(scope, F.lit(":"), F.lit(1))
    sub = F.when(scope.contains(":"), F.regexp_replace(scope, "^[^:]*:", "")).otherwise("")
    inside = (sub == "") | (path == sub) | path.startswith(F.concat(sub, F.lit("/")))
    return (scope == "") | ((lib == library) & inside)


def valid_name(name: Column) -> Column:
    """No empty name, no path bytes; the length is bounded where directories are checked."""
    return (F.octet_length(name) > 0) & ~name.isin(".", "..") & ~name.contains("/") & ~name.contains("\x00")


def sampled(key: Column, per_mille: int) -> Column:
    """Whether a key is in a sample, by the leading bits of its MD5, so that every system can tell."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % 1000 < per_mille
