"""Key derivation on the driver, and opaque object keys as expressions.

Passphrases become a master secret by scrypt, and the master secret four keys by HKDF-SHA256, each for one purpose.
Object keys are HMAC-SHA256 of the path in base 32, cut to 26 characters and dealt to two levels of folders.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import secrets
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BASE32, DIGITS32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
PURPOSES = ("content", "name", "manifest", "keycheck")
KNOWN_TEXT = b"arbolith vault passphrase check"


def hkdf(secret: bytes, salt: bytes, info: bytes, size: int = 32) -> bytes:
    """RFC 5869 with SHA-256."""
    extracted = hmac.digest(salt or bytes(32), secret, "sha256")
    out = block = b""
    for i in range(1, -(-size // 32) + 1):
        block = hmac.digest(extracted, block + info + bytes([i]), "sha256")
        out += block
    return out[:size]


@dataclass(frozen=True)
class Keys:
    """Four secrets that never enter a plan or a column of results; `repr` hides them."""

    content: bytes = field(repr=False)
    name: bytes = field(repr=False)
    manifest: bytes = field(repr=False)
    keycheck: bytes = field(repr=False)


def derive_keys(passphrase: str, salt: bytes, n: int = 1 << 15, r: int = 8, p: int = 1) -> Keys:
    master = hashlib.scrypt(passphrase.encode(), salt=salt, n=n, r=r, p=p, maxmem=256 << 20, dklen=32)
    return Keys(*(hkdf(master, salt, f"arbolith:v1:{purpose}".encode()) for purpose in PURPOSES))


def new_salt() -> bytes:
    return secrets.token_bytes(16)


def key_check(keys: Keys) -> str:
    """A value that tells, without revealing it, whether a passphrase is the vault's."""
    return hmac.new(keys.keycheck, KNOWN_TEXT, "sha256").hexdigest()


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC as an expression: 64 hexadecimal digits. The key's pads are literals of the plan: for test keys only."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in block).hex())) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def base32_of_hex(digits: Column, length: int) -> Column:
    """The first `length` base 32 characters (RFC 4648) of a number given in hexadecimal."""
    groups = [F.lpad(F.conv(F.substring(digits, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(-(-length // 8))]
    return F.substring(F.translate(F.concat(*groups), DIGITS32, BASE32), 1, length)


def sharded(name: Column) -> Column:
    """AB/CD/rest."""
    return F.concat_ws("/", F.substring(name, 1, 2), F.substring(name, 3, 2), F.substring(name, 5, 1 << 20))


def object_key(key: bytes, path: Column) -> Column:
    return sharded(base32_of_hex(hmac_sha256(key, path), 26))


def object_name(key: bytes, path: str) -> str:
    name = base64.b32encode(hmac.digest(key, path.encode(), "sha256")).decode()[:26]
    return f"{name[:2]}/{name[2:4]}/{name[4:]}"


def object_key_from(provider: Callable[[], bytes]) -> Callable[[Column], Column]:
    """object_key with a key that each task asks `provider` for, so that no plan shows it."""

    @F.pandas_udf("string")
    def name(path: pd.Series) -> pd.Series:
        key = provider()
        return path.map(lambda p: object_name(key, p), na_action="ignore")

    return name
