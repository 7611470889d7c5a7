"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tags(text: Column) -> Column:
    """Comma-separated tags: trimmed, blanks dropped, first ones kept, joined by a comma and a space."""
    parts = F.transform(F.split(text, ","), lambda t: F.trim(t))
    return F.array_join(F.array_distinct(F.filter(parts, lambda t: t != "")), ", ")


def truth(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("1", "true", "yes", "y", "on"), F.lit(False))


def seconds(duration: Column) -> Column:
    """``D-HH:MM:SS``, ``HH:MM:SS``, ``MM:SS`` or ``MM`` as seconds; null if it is none of them."""
    day = F.coalesce(F.regexp_extract(duration, r"^(\d+)-", 1).try_cast("long"), F.lit(0))
    parts = F.split(F.regexp_replace(duration, r"^\d+-", ""), ":")
    number = lambda i: F.get(parts, i).try_cast("long")
    clock = F.when(F.size(parts) == 3, number(F.lit(0)) * 3600 + number(F.lit(1)) * 60 + number(F.lit(2))).when(F.size(parts) == 2, number(F.lit(0)) * 60 + number(F.lit(1))).when(F.size(parts) == 1, number(F.lit(0)) * 60)
    return day * 86400 + clock


def megabytes(size: Column) -> Column:
    """``512``, ``4G``, ``1.5T``, ``2048K`` as MB."""
    n = F.regexp_extract(size, r"^([0-9.]+)", 1).try_cast("double")
    unit = F.upper(F.regexp_extract(size, r"([KMGTkmgt])[Bb]?$", 1))
    return n * F.when(unit == "K", 1 / 1024).when(unit == "G", 1024.0).when(unit == "T", 1024.0 * 1024).otherwise(1.0)


def merged_json(old: Column, new: Column) -> Column:
    """Shallow merge of two JSON objects; the new one's entries win, values keep their types."""
    kind = "map<string,variant>"
    empty = F.from_json(F.lit("{}"), kind)
    a, b = (F.coalesce(F.from_json(c, kind), empty) for c in (old, new))
    keys = F.array_sort(F.array_distinct(F.concat(F.map_keys(a), F.map_keys(b))))
    entry = lambda k: F.concat(F.to_json(F.struct(k.alias("k"))).substr(F.lit(6), F.char_length(F.to_json(F.struct(k.alias("k")))) - 6), F.lit(":"), F.coalesce(F.to_json(F.when(F.array_contains(F.map_keys(b), k), b[k]).otherwise(a[k])), F.lit("null")))
    return F.concat(F.lit("{"), F.array_join(F.transform(keys, entry), ","), F.lit("}"))


def slice_bytes(raw: Column, offset: Column, length: Column) -> Column:
    return F.substring(raw, offset + 1, length)


def label(template: str, columns: dict[str, Column]) -> Column:
    """A template such as ``dock-R{receptor}`` with columns' values in place of names; null values are empty."""
    parts, rest = [], template
    while "{" in rest:
        text, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        parts += [F.lit(text), F.coalesce(columns[name].cast("string"), F.lit(""))]
    return F.concat(*parts, F.lit(rest))


def identity(*parts: Column) -> Column:
    """sha256 of the parts' texts, each with its length before it, so that parts can't run together; null differs from empty."""
    texts = [F.coalesce(F.concat(F.octet_length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts]
    return F.sha2(F.concat(*texts), 256)


def stage_key(path: Column, modified: Column, size: Column) -> Column:
    """What names a staged copy of a file: path, time and size joined by bars, hashed, the first 16 digits."""
    return F.substring(F.sha2(F.concat_ws("|", path, modified.cast("string"), size.cast("string")), 256), 1, 16)


def units(amount: Column, unit: Column | int, most: Column | int, least: int = 1) -> Column:
    """Whole units in an amount, rounded up, within bounds."""
    return F.least(F.greatest(F.ceil(amount / unit), F.lit(least)), F.lit(most) if isinstance(most, int) else most).cast("long")


def gpus(resources: Column) -> Column:
    """GPUs in a resource list such as ``cpu=4,gres/gpu:a100=2,gpu:1``: the numbers of all its gpu entries, summed."""
    found = F.regexp_extract_all(resources, F.lit(r"gpu(?::[A-Za-z_][A-Za-z0-9_]*)?[:=](\d+)"), 1)
    return F.aggregate(found, F.lit(0).cast("long"), lambda n, x: n + x.cast("long"))


def partition_name(name: Column) -> Column:
    """Without the star that marks the default partition."""
    return F.rtrim(name, F.lit("*"))


def part_number(path: Column) -> Column:
    """The number of a part file ``<stem>_00001.ext``; null without one."""
    return F.regexp_extract(path, r"_(\d+)\.[^./]+$", 1).try_cast("long")


def suffix(path: Column) -> Column:
    """The extension with its dot, in lower case; empty for none or a name that begins with its only dot."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]+)$", 1))


def iso(at: Column) -> Column:
    """A time in UTC as ISO text with its zone."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")


def scaled(duration: Column, factor: float) -> Column:
    """Seconds times a factor, rounded up to whole minutes, one at least."""
    return F.greatest(F.ceil(duration * factor / 60), F.lit(1)).cast("long") * 60


def canonical(*columns: str) -> Column:
    """JSON of the columns by name, nulls kept; equal rows give equal texts whatever their columns' order."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def replaced(value: Column, marks: dict[str, str]) -> Column:
    """A text, or the texts of an array, with marks replaced, the longest first."""
    for mark in sorted(marks, key=len, reverse=True):
        value = F.replace(value, F.lit(mark), F.lit(marks[mark]))
    return value


def waits(first: Column, attempt: Column) -> Column:
    """The wait before a repeated try: the first one's, twice as long each time."""
    return first * F.pow(F.lit(2.0), attempt - 1)
