"""Column functions; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = " \t\n\r\f\v"


def strip(c: Column) -> Column:
    """Without white space at either end (trim() alone only knows spaces; a regular expression is several times slower)."""
    return F.trim(c, F.lit(_SPACE))


def first_filled(*cols: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.when(c != "", c) for c in cols))


def fingerprint(summary: Column, name: Column) -> Column:
    """SHA-1 of the stripped summary, or of the name where there is none."""
    return F.sha1(strip(F.coalesce(first_filled(summary, name), F.lit(""))))


def input_hash(fields: Mapping[str, Column], extra: Mapping[str, Column] | None = None) -> Column:
    """SHA-256 over key=value lines: fields in the given order, then extras by key.

    Locations are not to be among the fields: the same content elsewhere is the same input.
    """
    extra = extra or {}
    lines = [(k, c) for k, c in fields.items()] + [(f"extra.{k}", extra[k]) for k in sorted(extra)]
    return F.sha2(F.concat_ws("\n", *(F.concat(F.lit(f"{k}="), F.coalesce(c.cast("string"), F.lit(""))) for k, c in lines)), 256)


def cache_key(*parts: Column) -> Column:
    """16 hex digits that name a cached extraction."""
    return F.substring(F.sha1(F.concat_ws("\n", *parts)), 1, 16)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hash_embedding(text: Column, dim: int) -> Column:
    """A deterministic unit vector: the first MD5 byte of "text:i" for each dimension, centred and normalised."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.conv(F.substring(F.md5(F.concat(text, F.lit(":"), i.cast("string"))), 1, 2), 16, 10).cast("double") - 128.0) / 128.0)
    return unit(raw)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector over its length; a zero vector stays as it is."""
    scaled = lambda raw, length: F.transform(raw, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(x.cast("double")))
    # Both are used for every component: neither may be computed again for each.
    return let(v, lambda raw: let(F.sqrt(dot(raw, raw)), lambda length: scaled(raw, length)))


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def label(c: Column, aliases: Mapping[str, str], default: str) -> Column:
    """Lower case, blanks and hyphens as underscores, aliases applied, default where nothing is left."""
    value = F.translate(F.lower(strip(c)), "- ", "__")
    out = value
    for alias, meant in aliases.items():
        out = F.when(value == alias, F.lit(meant)).otherwise(out)
    return F.coalesce(F.when(out != "", out), F.lit(default))


def string_list(c: Column) -> Column:
    """Stripped entries that are not empty."""
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), strip), lambda x: x != "")


def page_number(raw: Column) -> Column:
    """A page from JSON text: integers as they are, strings by all their digits, anything else null."""
    quoted = raw.startswith('"')
    digits = F.regexp_replace(raw, r"[^0-9]", "")
    whole = F.when(raw.rlike(r"^-?[0-9]+$"), raw)
    return F.when(quoted, F.when(digits != "", digits)).otherwise(whole).try_cast("bigint")


def strip_fence(c: Column) -> Column:
    """A model's answer without the code fence around its JSON."""
    return strip(F.regexp_replace(strip(c), r"^```[a-zA-Z]*\s*|\s*```$", ""))


def redact(c: Column, date_patterns: Sequence[tuple[str, str]], units: Sequence[str], number_mark: str, names: str, suffixes: Sequence[str], name_mark: str) -> Column:
    """Facts out, wording kept: dates (longest pattern first), numbers before a unit, names before a suffix.

    date_patterns: (pattern, placeholder); names: character class of a name; the vocabulary is the caller's.
    The order matters: a date is no number with a unit.
    """
    out = c
    for pattern, mark in date_patterns:
        out = F.regexp_replace(out, pattern, mark)
    if units:
        out = F.regexp_replace(out, rf"[0-9]+(?:\.[0-9]+)?({'|'.join(units)})", rf"{number_mark}$1")
    if suffixes:
        out = F.regexp_replace(out, rf"{names}{{2,12}}(?:{'|'.join(suffixes)})", name_mark)
    return out


def code(prefix: str, number: Column) -> Column:
    return F.format_string(f"{prefix}%03d", number)


def slices(c: Column, size: int) -> Column:
    """The text in pieces of ``size`` characters."""
    n = F.greatest(F.lit(1), F.ceil(F.length(c) / size)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(c, i * size + 1, F.lit(size)))


def agreed(*values: Column, name: str) -> Column:
    """The value all given aliases agree on; an error where they differ."""
    filled = F.array_distinct(F.filter(F.array(*values), lambda x: x.isNotNull()))
    return F.when(F.size(filled) > 1, F.raise_error(F.lit(f"{name}: conflicting values"))).otherwise(F.get(filled, F.lit(0)))


def index_version(version: Column, alias: Column) -> Column:
    """Both names of a version must agree; the default is 1; below 1 is an error."""
    v = F.coalesce(agreed(version, alias, name="index_version"), F.lit(1).cast("bigint"))
    return F.when(v <= 0, F.raise_error(F.lit("index_version must be positive"))).otherwise(v)


def mask_url(url: str) -> str:
    """A connection URL without its password, for logs."""
    import re

    return re.sub(r"(://[^:/@]+):[^@]*@", r"\1:***@", url)
