"""Columns over file names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HIDDEN = "."


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """The folder part; empty at the top."""
    return F.regexp_extract(path, "(?s)^(.*)/[^/]*$", 1)


def relative(path: Column, root: str) -> Column:
    return F.when(F.startswith(path, F.lit(root + "/")), F.substring(path, len(root) + 2, 1 << 30)).otherwise(path)


def suffix(file_name: Column) -> Column:
    """Lower-case extension with its dot: from a last dot that is neither first nor last; else empty."""
    return F.lower(F.regexp_extract(file_name, r"(?s)^.+(\.[^.]+)$", 1))


def extension(file_name: Column) -> Column:
    """What numbering keeps at the end: from the last dot on, unless only dots stand before it."""
    return F.regexp_extract(file_name, r"(?s)^\.*[^.].*?(\.[^.]*)$", 1)


def stem(file_name: Column) -> Column:
    ext = extension(file_name)
    return F.substring(file_name, F.lit(1), F.char_length(file_name) - F.char_length(ext))


def numbered(file_name: Column, n: Column) -> Column:
    """``photo.jpg`` and 2 give ``photo (2).jpg``."""
    return F.concat(stem(file_name), F.lit(" ("), n.cast("string"), F.lit(")"), extension(file_name))


#: What case folding makes of characters that lower-casing leaves: of one for one, and of one for several.
_FOLDS = {c: c.casefold() for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x1F000))) if c.lower() == c != c.casefold()}
_ONE = {c: f for c, f in _FOLDS.items() if len(f) == 1}


def folded(text: Column) -> Column:
    """Full Unicode case folding, as ``str.casefold``: what names are compared by, so that ß meets SS."""
    lower = F.translate(F.lower(text), "".join(_ONE), "".join(_ONE.values()))
    several = {c: f for c, f in _FOLDS.items() if c not in _ONE}
    table = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])  # a constant, so code stays small
    whole = F.array_join(F.transform(F.split(lower, ""), lambda c: F.coalesce(F.element_at(table, c), c)), "")
    some = F.when(lower.rlike("[" + "".join(several) + "]"), whole).otherwise(lower)
    return F.when(text.rlike(r"[^\x00-\x7F]"), some).otherwise(F.lower(text))


def clash_root(file_name: Column) -> Column:
    """What a folded name and all its numberings have in common: names of different roots never meet."""
    root = lambda fold: F.concat(F.regexp_replace(stem(fold), r"( \(\d+\))+$", ""), F.lit("\0"), extension(fold))
    return F.transform(F.array(folded(file_name)), root)[0]  # folded once


def scan_order(path: Column) -> Column:
    """Sorts as a pre-order walk does: a folder's files before those of its subfolders, each by name."""
    return F.translate(parent(path), "/", "\x01")


def _rounded(value: Column, digits: int, bits: int) -> Column:
    """``value`` to ``digits`` decimals as an integer, by its exact binary value, halves to even.

    ``value`` times 2**``bits`` must be a whole number, and ten times that a BIGINT.
    """
    whole, unit = (value * float(1 << bits)).cast("long") * 10**digits, 1 << bits
    below = F.floor(F.shiftright(whole, bits)).cast("long")
    rest = whole.bitwiseAND(F.lit(unit - 1))
    return below + F.when((rest > unit // 2) | ((rest == unit // 2) & (below % 2 == 1)), 1).otherwise(0)


def human_size(size: Column) -> Column:
    """Decimal units; one decimal below 100, none from there on. Beyond a thousand of the largest unit still that unit."""
    out = F.when(size == 1, F.lit("1 byte")).when(size < 1000, F.concat(size.cast("string"), F.lit(" bytes")))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        value = size / F.lit(1000.0**power)
        tenths = _rounded(value, 1, 52)
        small = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
        text = F.concat(F.when(value < 100, small).otherwise(_rounded(value, 0, 46).cast("string")), F.lit(f" {unit}"))
        out = out.when(size < 1000 ** (power + 1), text) if power < 4 else out.otherwise(text)
    return out


def short_path(path: Column, home: str) -> Column:
    """The home folder as ``~``."""
    return F.when(path == home, "~").when(F.startswith(path, F.lit(home + "/")), F.concat(F.lit("~"), F.substring(path, len(home) + 1, 1 << 30))).otherwise(path)


def percent(share: Column) -> Column:
    """Whole per cent, halves to even."""
    return F.concat(F.bround(share * 100, 0).cast("int").cast("string"), F.lit("%"))
