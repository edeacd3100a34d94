"""Path expressions. All are built-in functions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPAQUE, WHITEOUT = ".wh..wh..opq", ".wh."


def normalise(path: Column) -> Column:
    """Without ONE leading "./" or "/" and without all trailing "/"."""
    return F.regexp_replace(F.regexp_replace(path, r"^(?:\./|/)", ""), r"/+$", "")


def components(path: Column) -> Column:
    """The order of paths: by components, so that a/b comes before a-b."""
    return F.split(path, "/")


def basename(path: Column) -> Column:
    return F.element_at(components(path), -1)


def depth(path: Column) -> Column:
    return F.size(components(path))


def parent(path: Column) -> Column:
    """The path without its last component; "" at the top."""
    p = components(path)
    return F.when(F.size(p) > 1, F.array_join(F.slice(p, 1, F.size(p) - 1), "/")).otherwise(F.lit(""))


def strict_ancestors(path: Column) -> Column:
    """All ancestors, nearest first, without the path itself and without ""."""
    p = components(path)
    return F.when(F.size(p) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.size(p) - 1, F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(p, 1, i), "/")))


def self_and_ancestors(path: Column) -> Column:
    return F.concat(F.array(path), strict_ancestors(path))


def is_strict_descendant(path: Column, ancestor: Column) -> Column:
    """By components: etc/host is no ancestor of etc/hostname. Everything is below ""."""
    return F.when(ancestor == "", path != "").otherwise(F.startswith(path, F.concat(ancestor, F.lit("/"))))


def marker_action(path: Column) -> Column:
    """"opaque", "remove", or null for an ordinary entry; a bare ".wh." is an ordinary entry."""
    name = basename(path)
    return F.when(name == OPAQUE, F.lit("opaque")).when(F.startswith(name, F.lit(WHITEOUT)) & (F.length(name) > len(WHITEOUT)), F.lit("remove"))


def marker_target(path: Column) -> Column:
    """The directory that an opaque marker clears, or the path that a whiteout removes."""
    name, folder = basename(path), parent(path)
    victim = F.substring(name, len(WHITEOUT) + 1, 1 << 30)
    return F.when(name == OPAQUE, folder).otherwise(F.when(folder == "", victim).otherwise(F.concat(folder, F.lit("/"), victim)))
