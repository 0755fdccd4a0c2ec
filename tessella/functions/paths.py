"""Column functions over paths, names and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def resolve_path(path: Column, root: str) -> Column:
    """Absolute paths stay; others are put below root."""
    return F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", F.lit(root.rstrip("/")), path))


def real_path(path: Column) -> Column:
    """The path without `.`, `..` and doubled slashes; links are not followed, for paths may be in any store."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    step = lambda acc, p: F.when(p != "..", F.concat(acc, F.array(p))).otherwise(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))


# Keys of an item's metadata that hold paths of masks.
MASK_PATH_KEYS = ("mask_path", "masks_path", "segmentation_path", "segmentations_path")


def resolve_metadata(metadata: Column, root: str) -> Column:
    """A map of strings whose mask paths are resolved below root."""
    fixed = lambda k, v: F.when(k.isin(*MASK_PATH_KEYS) & ~v.startswith("/"), real_path(resolve_path(v, root))).otherwise(v)
    return F.transform_values(metadata, fixed)


def safe_id(text: Column) -> Column:
    """An id that can be a file name: anything but letters, digits, dot, dash and underscore becomes an underscore."""
    return F.regexp_replace(text, "[^A-Za-z0-9._-]", "_")


def relpath_suffix(path: Column, parts: int = 2) -> Column:
    """The last parts of a path (all, if it has fewer)."""
    split = F.split(path, "/")
    return F.array_join(F.slice(split, F.greatest(F.size(split) - parts + 1, F.lit(1)), F.lit(parts)), "/")


def utm_from_path(path: Column) -> tuple[Column, Column]:
    """Easting and northing: fields 1 and 2 between @ signs."""
    parts = F.split(path, "@")
    return F.try_element_at(parts, F.lit(2)).cast("double"), F.try_element_at(parts, F.lit(3)).cast("double")


def parse_row_col(name: Column) -> tuple[Column, Column]:
    """Row and column of names with r<digits>_c<digits>; null without them."""
    hit = name.rlike(r"r(\d+)_c(\d+)")
    return tuple(F.when(hit, F.regexp_extract(name, r"r(\d+)_c(\d+)", g).cast("int")) for g in (1, 2))


def parse_size(size: Column) -> tuple[Column, Column]:
    """HxW or H,W."""
    parts = F.split(F.regexp_replace(F.lower(size), "x", ","), ",")
    return F.trim(parts[0]).cast("int"), F.trim(parts[1]).cast("int")


def checked_size(h: Column, w: Column, expected: tuple[int, int] | None = None, parts_of: tuple[int, int] | None = None) -> Column:
    """True, or an error: a size that differs from the one expected, or that does not divide evenly."""
    ok = F.lit(True)
    if expected is not None:
        ok = ok & (h == expected[0]) & (w == expected[1])
    if parts_of is not None:
        ok = ok & (F.lit(parts_of[0]) % h == 0) & (F.lit(parts_of[1]) % w == 0)
    told = F.concat(F.lit("size mismatch: "), h.cast("string"), F.lit("x"), w.cast("string"))
    return F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(told).cast("boolean"))


def natural_key(name: Column, width: int = 12) -> Column:
    """A sort key that compares runs of digits as numbers."""
    marked = F.regexp_replace(name, r"(\d+)", "\u0001$1\u0001")
    padded = F.transform(F.split(marked, "\u0001"), lambda p: F.when(p.rlike(r"^\d+$") & (F.length(p) < width), F.lpad(p, width, "0")).otherwise(p))
    return F.array_join(padded, "")


def mask_cache_name(path: Column) -> Column:
    """Slashes become double underscores; the first 16 digits of the SHA-1 follow."""
    return F.concat(F.replace(path, F.lit("/"), F.lit("__")), F.lit("__"), F.substring(F.sha1(path), 1, 16), F.lit(".npz"))


def mask_cache_path(name: Column) -> Column:
    """The path back from mask_cache_name."""
    return F.replace(F.regexp_replace(name, r"__[0-9a-f]{16}\.npz$", ""), F.lit("__"), F.lit("/"))


def cache_id(*parts: Column, digits: int = 12) -> Column:
    return F.substring(F.sha1(F.concat_ws("::", *parts)), 1, digits)


def keyword_class(text: Column, classes: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    """The first class of which a keyword occurs, in any case; else null."""
    low, out = F.lower(text), None
    for name, words in classes:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


# The disaster classes and their keywords.
DISASTERS = (("wildfire", ("wildfire", "fire")), ("tornado", ("tornado",)), ("earthquake", ("earthquake", "quake")))
