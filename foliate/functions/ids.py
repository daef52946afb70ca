"""Identifiers from content, and cache keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(x: Column) -> Column:
    return F.md5(x.cast("binary"))


def prefixed(prefix: str, x: Column) -> Column:
    """A prefix and the digest: ``doc-``, ``chunk-``, ``ent-`` or ``rel-`` ids."""
    return F.concat(F.lit(prefix), digest(x))


def relation_id(src: Column, tgt: Column) -> Column:
    return prefixed("rel-", F.concat(src, tgt))


def block_signature(type_: Column, text: Column, path: Column | None = None, table: Column | None = None) -> Column:
    """What a block adds to its document's id."""
    other = F.concat(type_, F.lit(":"), F.coalesce(text, F.lit("")))
    return (
        F.when(type_ == "text", F.btrim(text))
        .when(type_ == "image", F.concat(F.lit("image:"), F.coalesce(path if path is not None else text, F.lit(""))))
        .when(type_ == "table", F.concat(F.lit("table:"), F.coalesce(table if table is not None else text, F.lit(""))))
        .when(type_ == "equation", F.concat(F.lit("equation:"), F.coalesce(text, F.lit(""))))
        .otherwise(other)
    )


def canonical(pairs: dict[str, Column]) -> Column:
    """key=value pairs in the order of their keys, parted by line feeds; null values are left out."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in sorted(pairs.items())])


def cache_key(pairs: dict[str, Column], prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), digest(canonical(pairs)))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def suffix(path: Column) -> Column:
    """Lower-cased suffix with its dot, or nothing."""
    return F.lower(F.regexp_extract(basename(path), r"[^.](\.[^.]+)$", 1))


def output_name(path: Column) -> Column:
    """Stem and the start of the path's digest: one folder a file, whatever its name."""
    return F.concat(stem(path), F.lit("_"), F.substring(digest(path), 1, 8))


#: The options that the cache key of a parse depends on.
PARSE_OPTIONS = ("lang", "device", "start_page", "end_page", "formula", "table", "backend", "source")


def parse_key(path: Column, mtime: Column, parser: Column, method: Column, options: Column) -> Column:
    """Cache key of a parsed file: path, time, parser, method and those options (a map) that change what it gives."""
    kept = {name: F.try_element_at(options, F.lit(name)) for name in PARSE_OPTIONS}
    return cache_key({"file_path": path, "mtime": mtime, "parser": parser, "parse_method": method, **kept})
