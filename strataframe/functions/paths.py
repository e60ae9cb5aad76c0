"""Relative paths: parts, parents, ancestors, prefixes. ``.`` is the root of a scope."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(path: Column) -> Column:
    """Segments of the path; none for ``.``."""
    return F.when(path == ".", F.array().cast("array<string>")).otherwise(F.split(path, "/"))


def depth(path: Column) -> Column:
    return F.size(parts(path))


def _first(p: Column, n: Column) -> Column:
    return F.when(n == 0, F.lit(".")).otherwise(F.array_join(F.slice(p, 1, n), "/"))


def parent(path: Column) -> Column:
    """The directory that holds the path; ``.`` for a top-level one and for ``.`` itself."""
    p = parts(path)
    return _first(p, F.greatest(F.size(p) - 1, F.lit(0)))


def ancestors_or_self(path: Column) -> Column:
    """``.``, every directory above the path, and the path."""
    p = parts(path)
    return F.transform(F.sequence(F.lit(0), F.size(p)), lambda n: _first(p, n))


def strict_ancestors(path: Column) -> Column:
    """``.`` and every directory above the path; ``.`` alone for ``.``."""
    p = parts(path)
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(p) - 1, F.lit(0))), lambda n: _first(p, n))


def below(path: Column, root: Column | str | None) -> Column:
    """Exact prefix test: everything for null or ``.``, else the root itself and what is below it."""
    if root is None or isinstance(root, str):
        return F.lit(True) if root in (None, ".") else (path == root) | path.startswith(root + "/")
    return root.isNull() | (root == ".") | (path == root) | path.startswith(F.concat(root, F.lit("/")))


def below_ascii_folded(path: Column, root: str | None) -> Column:
    """Prefix test whose descendants match without regard to ASCII case, while the root itself must be equal."""
    if root in (None, "."):
        return F.lit(True)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    fold = lambda c: F.translate(c, upper, lower)
    return (path == root) | fold(path).startswith(fold(F.lit(root + "/")))


def is_valid(path: Column) -> Column:
    """False for empty, ``.`` or ``..`` segments and a leading slash; ``.`` alone is valid, null is not."""
    return F.coalesce((path == ".") | ~path.rlike(r"(^|/)(\.{0,2})(/|$)"), F.lit(False))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Extension in lower case with its dot; empty without one. A leading dot makes no extension."""
    return F.lower(F.regexp_extract(basename(path), r"[^.](\.[^./]+)$", 1))
