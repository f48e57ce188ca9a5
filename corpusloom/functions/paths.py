"""Path expressions; paths are project-relative with '/' between segments."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def extension(path: Column) -> Column:
    """Last extension of the base name; '' for names such as .bashrc."""
    return F.regexp_extract(path, r"(?:^|/)[^/]+?(\.[^/.]*)\z", 1)


def extension_lower(path: Column) -> Column:
    return F.lower(extension(path))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    """Folder of a path, '' at the top."""
    return F.substr(path, F.lit(1), F.length(path) - F.length(base_name(path)) - 1)


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def prefixes(path: Column) -> Column:
    """a/b/c -> [a, a/b, a/b/c]"""
    return F.transform(F.sequence(F.lit(1), depth(path)), lambda n: F.call_function("substring_index", path, F.lit("/"), n))


def fold_dots(path: Column) -> Column:
    """Remove '.' and apply '..'; NULL when the path leaves the project."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    up = F.lit("..")
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(
            p == up,
            F.when((F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != up),
                   F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .otherwise(F.concat(acc, F.array(p))),
        ).otherwise(F.concat(acc, F.array(p))),
    )
    return F.when(F.coalesce(F.try_element_at(folded, F.lit(1)), F.lit("")) != up, F.array_join(folded, "/"))


def resolve_path(target: Column, base_dir: Column) -> Column:
    """A target as seen from base_dir; a leading '/' means the project root.

    Most targets only have dots in front. These are resolved by cutting base_dir, which stays in
    generated code; dots further inside take the slower fold.
    """
    lead = F.regexp_extract(target, r"\A(?:\.{1,2}/)*", 0)
    rest = F.substr(target, F.length(lead) + 1)
    ups = F.length(lead) - F.length(F.replace(lead, F.lit("../"), F.lit("..")))
    left = F.when(base_dir == "", 0).otherwise(depth(base_dir)) - ups
    whole = F.when(F.startswith(target, F.lit("/")), target).otherwise(F.concat_ws("/", base_dir, target))
    return (
        F.when(F.rlike(rest, F.lit(r"(?:\A|/)\.{0,2}(?:/|\z)")), fold_dots(whole))
        .when(left == 0, rest)
        .when(left > 0, F.concat(F.call_function("substring_index", base_dir, F.lit("/"), left), F.lit("/"), rest))
    )


def clean_root(root: str) -> str | None:
    """Normal form of a scan root on the driver: '' is the project; None is outside of it."""
    folded = posixpath.normpath((root or "./").replace("\\", "/"))
    if folded == ".":
        return ""
    if folded.startswith("/") or folded == ".." or folded.startswith("../"):
        return None
    return folded


def under(path: Column, root: str) -> Column:
    return F.lit(True) if root == "" else F.startswith(path, F.lit(root + "/"))
