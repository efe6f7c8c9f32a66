"""Scalar functions of the catalogue as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What each category's media types and file extensions are, in the order they are tried.
CATEGORIES = [
    ("image", r"^image/", r"\.(png|jpe?g|webp|gif|avif|svg|bmp|heic)$"),
    ("video", r"^video/", r"\.(mp4|webm|mkv|mov|avi|m4v)$"),
    ("audio", r"^audio/", r"\.(mp3|ogg|opus|wav|flac|aac|m4a)$"),
    ("archive", r"^application/(zip|gzip|x-7z-compressed|x-tar)$", r"\.(zip|gz|7z|rar|tar|zst)$"),
    ("document", r"^(text/|application/pdf$)", r"\.(pdf|txt|md|json|csv|html?|xml|docx?|xlsx?|pptx?)$"),
]
# Seconds and bytes of a quantity's unit.
SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}
BYTES = {"B": 1, "KiB": 1 << 10, "MiB": 1 << 20, "GiB": 1 << 30, "TiB": 1 << 40}


def category(key: Column, mime: Column) -> Column:
    """Category of an object by media type or extension; the first that matches wins, ``other`` if none does."""
    out = F.lit("other")
    for name, types, extensions in reversed(CATEGORIES):
        hit = F.coalesce(mime, F.lit("")).rlike(types) | key.rlike("(?i)" + extensions)
        out = F.when(hit, name).otherwise(out)
    return out


def basename(key: Column) -> Column:
    return F.substring_index(key, "/", -1)


def percent_encode(key: Column) -> Column:
    """Everything but A-Z a-z 0-9 - _ . ~ / as %XX of its UTF-8 bytes."""
    out = F.url_encode(key)
    for found, wanted in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%7E", "~")):
        out = F.replace(out, F.lit(found), F.lit(wanted))
    return out


def common_prefix(key: Column, prefix: str, delimiter: str = "/") -> Column:
    """The folder right below ``prefix`` that a key falls into, or the key itself where no delimiter follows."""
    rest = F.substring(key, F.lit(len(prefix) + 1), F.length(key))
    at = F.instr(rest, delimiter)
    return F.when(at > 0, F.concat(F.lit(prefix), F.substring(rest, F.lit(1), at + len(delimiter) - 1))).otherwise(key)


def ancestors(key: Column, delimiter: str = "/") -> Column:
    """Proper ancestor paths of a key, without the trailing delimiter."""
    parts = F.split(key, delimiter)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), delimiter))


def quantity(text: Column, units: dict[str, int]) -> Column:
    """A positive whole number with a unit, in the smallest unit; null for anything else."""
    names = "|".join(sorted(units, key=len, reverse=True))
    number, unit = F.regexp_extract(text, rf"^([0-9]+)({names})$", 1), F.regexp_extract(text, rf"^([0-9]+)({names})$", 2)
    factor = F.lit(None).cast("long")
    for name, size in units.items():
        factor = F.when(unit == name, F.lit(size)).otherwise(factor)
    value = F.try_multiply(number.try_cast("long"), factor.cast("long"))
    return F.when(value > 0, value)


def seconds(text: Column) -> Column:
    return quantity(text, SECONDS)


def size_bytes(text: Column) -> Column:
    return quantity(text, BYTES)


def successor(prefix: str) -> str | None:
    """The least string above every string that starts with ``prefix``; none if there is no such string."""
    for cut in range(len(prefix) - 1, -1, -1):
        code = ord(prefix[cut]) + 1
        if code == 0xD800:
            code = 0xE000
        if code <= 0x10FFFF:
            return prefix[:cut] + chr(code)
    return None


def contains(key: Column, query: str, names_only: bool = False) -> Column:
    """Case-insensitive literal containment; a query without three alphanumerics in a row only matches as a prefix."""
    run, long_run = 0, False
    for ch in query:
        run = run + 1 if ch.isalnum() else 0
        long_run |= run >= 3
    within = F.lower(basename(key) if names_only else key)
    wanted = F.lower(F.lit(query))
    return F.contains(within, wanted) if long_run else F.startswith(within, wanted)


def slot(key: Column) -> Column:
    """Snapshot slot of a current key: one that starts with a tilde gets another."""
    return F.when(key.startswith("~"), F.concat(F.lit("~"), key)).otherwise(key)


def backoff(attempts: Column, base: int = 2, most: int = 300, doublings: int = 8) -> Column:
    return F.least(F.lit(most), F.pow(F.lit(base), F.least(attempts, F.lit(doublings)))).cast("long")


def multipart_etag(parts: Column) -> Column:
    """MD5 of the parts' binary MD5s, with the number of parts behind it."""
    joined = F.array_join(F.transform(parts, lambda p: F.md5(p.cast("binary"))), "")
    return F.concat(F.md5(F.unhex(joined)), F.lit("-"), F.size(parts).cast("string"))


def range_digest(parts: Column) -> Column:
    """A chained digest over an ordered array: each link hashes the one before it and the next element."""
    return F.aggregate(parts, F.lit(""), lambda acc, p: F.sha2(F.concat(acc, p).cast("binary"), 256))
