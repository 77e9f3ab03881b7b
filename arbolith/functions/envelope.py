"""Authenticated envelopes: generation prefix, AES-256-GCM with associated data, frames."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FRAME_BYTES = 1 << 20
VERSION = 1


def generation_bytes(generation: Column) -> Column:
    """Eight bytes, big-endian."""
    return F.unhex(F.lpad(F.hex(generation), 16, "0"))


def generation_of(payload: Column) -> Column:
    """The generation in front of a payload; an error if there aren't eight bytes."""
    short = F.raise_error(F.lit("payload is shorter than its generation")).cast("long")
    value = F.conv(F.hex(F.substring(payload, 1, 8)), 16, 10).cast("decimal(20,0)").cast("long")
    return F.when(F.octet_length(payload) < 8, short).otherwise(value)


def accepted_generation(payload: Column) -> Column:
    """The generation in front of a payload, null where there aren't eight bytes: to tell bad payloads from good ones in a table."""
    return F.when(F.octet_length(payload) >= 8, generation_of(payload))


def body_of(payload: Column) -> Column:
    return F.substring(payload, 9, 1 << 30)


def manifest_context(key: str, generation: Column) -> Column:
    """Associated data of a manifest: its key and generation."""
    return F.concat(F.lit(f"{key}:"), generation.cast("string"))


def frame_context(object_key: Column, frame: Column, last: Column) -> Column:
    """Associated data of a content frame: version, object key, place, and whether it is the last one."""
    return F.concat_ws(":", F.lit(str(VERSION)), object_key, frame.cast("string"), last.cast("string"))


def secret_column(provider: Callable[[], bytes]) -> Callable[[Column], Column]:
    """A column with the key that each task asks `provider` for; a literal would show in plans and logs."""

    @F.pandas_udf("binary")
    def key(any_column: pd.Series) -> pd.Series:
        value = provider()
        return any_column.map(lambda _: value)

    return key


def sealed(content: Column, key: Column, context: Column) -> Column:
    """Nonce, ciphertext and tag; an empty content has a tag too."""
    return F.aes_encrypt(content, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), context.cast("binary"))


def opened(box: Column, key: Column, context: Column) -> Column:
    """The content, or null if the box, the key or the context isn't the one that was sealed."""
    return F.try_aes_decrypt(box, key, F.lit("GCM"), F.lit("DEFAULT"), context.cast("binary"))
