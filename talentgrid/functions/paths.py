"""Paths inside an archive or a storage folder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNSAFE = ".."


def normalize_path(name: Column) -> Column:
    """Resolve ``.``, ``..`` and empty parts. A path that leaves its root comes back as ``..``."""
    plain = ~name.rlike(r"(?:^|/)\.{0,2}(?:/|$)")
    resolved = _resolve(name, F.array(F.lit(UNSAFE)))
    return F.when(plain, name).when(name.startswith("/"), F.lit(UNSAFE)).otherwise(resolved)


def normalize_absolute(path: Column) -> Column:
    """Resolve an absolute path, without its leading slash; ``..`` at the root stays at the root."""
    return _resolve(path, F.array().cast("array<string>"))


def _resolve(name: Column, above_root: Column) -> Column:
    parts = F.split(name, "/", -1)

    def step(done: Column, part: Column) -> Column:
        return (
            F.when(part.isin("", "."), done)
            .when(F.get(done, F.lit(0)) == UNSAFE, done)
            .when(part != "..", F.array_append(done, part))
            .when(F.size(done) == 0, above_root)
            .otherwise(F.slice(done, F.lit(1), F.size(done) - 1))
        )

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def parents(path: Column) -> Column:
    """Every folder above a normalised path, nearest last: ``a/b/c`` gives ``a`` and ``a/b``."""
    parts = F.split(path, "/", -1)
    depth = F.size(parts) - 1
    return F.when(
        depth > 0,
        F.transform(
            F.sequence(F.lit(1), depth), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")
        ),
    ).otherwise(F.array().cast("array<string>"))


def is_cv_name(path: Column) -> Column:
    low = F.lower(path)
    return low.endswith(".pdf") | low.endswith(".docx")
