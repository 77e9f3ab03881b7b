"""The content digest: SHA-256 as 64 lower-case hexadecimal digits."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

NAME = "sha256"


def digest(content: Column) -> Column:
    return F.sha2(content, 256)


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, NAME).hexdigest()


def checked(hash_: Column) -> Column:
    """The digest, or an error that fails the read where it isn't one; null stays null."""
    wrong = F.raise_error(F.concat(F.lit("not a digest: "), hash_)).cast("string")
    return F.when(hash_.isNull() | hash_.rlike("^[0-9a-f]{64}$"), hash_).otherwise(wrong)


def non_negative(n: Column) -> Column:
    """Sizes and generations that were stored out of range read as 0."""
    return F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)).cast("long")


def saturated(n: Column) -> Column:
    """A decimal number as a long: what is out of its range becomes the nearest long."""
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    return F.greatest(F.least(n.cast("decimal(38,0)"), most), -most - 1).cast("long")


def parsed(hash_: Column) -> Column:
    """The 32 bytes that 64 hexadecimal digits of either case stand for; null for anything else."""
    return F.when(hash_.rlike("^[0-9A-Fa-f]{64}$"), F.unhex(hash_))


def formatted(value: Column) -> Column:
    """Bytes as lower-case hexadecimal digits."""
    return F.lower(F.hex(value))
