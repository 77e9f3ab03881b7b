"""Paths as expressions: exclusion, safety, prefixes, canonical form."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Base names that are never mirrored, wherever they occur.
ALWAYS_EXCLUDED = (".mirror", ".DS_Store", "Thumbs.db", "desktop.ini")


def included(path: Column) -> Column:
    """No component of the path is an excluded name (exact case)."""
    return ~F.exists(F.split(path, "/"), lambda part: part.isin(*ALWAYS_EXCLUDED))


def safe(path: Column) -> Column:
    """Relative, without empty, `.` or `..` components at the start or anywhere a walk could leave the root.

    Repeated slashes and inner or trailing `.` are harmless; a leading `.`, any `..` and a leading slash aren't.
    """
    parts = F.split(path, "/")
    return (path != "") & ~path.startswith("/") & (F.get(parts, F.lit(0)) != ".") & ~F.exists(parts, lambda part: part == "..")


def assert_safe(path: Column) -> Column:
    return F.when(safe(path), path).otherwise(F.raise_error(F.concat(F.lit("unsafe path: "), path)).cast("string"))


def under(key: Column, prefix: str) -> Column:
    return key.startswith(prefix)


def normalised(path: str) -> str:
    """Each component in NFC, joined by slashes."""
    return "/".join(unicodedata.normalize("NFC", part) for part in path.split("/"))


@F.pandas_udf(T.StringType())
def canonical(path: pd.Series) -> pd.Series:
    return path.map(normalised, na_action="ignore")
