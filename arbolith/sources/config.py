"""Configuration, vault header and secrets of the driver."""

from __future__ import annotations

import base64
import json
import os
import tomllib
from dataclasses import asdict, dataclass
from typing import Protocol

from arbolith.functions.keys import Keys, derive_keys, key_check, new_salt


@dataclass(frozen=True)
class Remote:
    bucket: str
    endpoint: str | None = None
    region: str = "us-east-1"
    prefix: str = ""
    path_style: bool = False


@dataclass(frozen=True)
class Local:
    root: str
    ignore_file: str = ".mirrorignore"


@dataclass(frozen=True)
class Config:
    remote: Remote
    local: Local

    @classmethod
    def load(cls, path: str) -> Config:
        """Reads TOML; all problems are reported together."""
        with open(path, "rb") as f:
            data = tomllib.load(f)
        problems, parts = [], {}
        for section, kind, needed in (("remote", Remote, "bucket"), ("local", Local, "root")):
            given = data.get(section, {})
            unknown = sorted(set(given) - set(kind.__dataclass_fields__))
            problems += [f"unknown setting {section}.{name}" for name in unknown]
            if not given.get(needed):
                problems.append(f"{section}.{needed} is missing")
            else:
                parts[section] = kind(**{k: v for k, v in given.items() if k not in unknown})
        if "local" in parts and not os.path.isdir(os.path.expanduser(parts["local"].root)):
            problems.append(f"local.root is no folder: {parts['local'].root}")
        if problems:
            raise ValueError("; ".join(problems))
        return cls(**parts)


@dataclass(frozen=True)
class VaultHeader:
    """Public facts from which a passphrase gives the keys, and a check value."""

    salt: str
    key_check: str
    format_version: int = 1
    kdf: str = "scrypt"
    n: int = 1 << 15
    r: int = 8
    p: int = 1

    @classmethod
    def create(cls, passphrase: str, **cost: int) -> tuple[VaultHeader, Keys]:
        salt = new_salt()
        keys = derive_keys(passphrase, salt, **cost)
        return cls(base64.b64encode(salt).decode(), key_check(keys), **cost), keys

    def unlock(self, passphrase: str) -> Keys:
        if (self.format_version, self.kdf) != (1, "scrypt"):
            raise ValueError(f"unknown vault format: {self.format_version}, {self.kdf}")
        keys = derive_keys(passphrase, base64.b64decode(self.salt), self.n, self.r, self.p)
        if key_check(keys) != self.key_check:
            raise PermissionError("wrong passphrase")
        return keys

    def dump(self) -> bytes:
        return json.dumps(asdict(self)).encode()

    @classmethod
    def parse(cls, data: bytes) -> VaultHeader:
        return cls(**json.loads(data))


class SecretProvider(Protocol):
    def store(self, name: str, secret: bytes) -> None: ...
    def load(self, name: str) -> bytes: ...


class FileSecrets:
    """Secrets of 32 bytes in files that only their owner can read, in a folder that tasks see too."""

    def __init__(self, folder: str):
        self.folder = folder

    def store(self, name: str, secret: bytes) -> None:
        os.makedirs(self.folder, mode=0o700, exist_ok=True)
        with open(os.open(self._path(name), os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "wb") as f:
            f.write(secret)

    def load(self, name: str) -> bytes:
        try:
            with open(self._path(name), "rb") as f:
                secret = f.read()
        except FileNotFoundError:
            raise PermissionError(f"no key {name}: unlock the vault first") from None
        if len(secret) != 32:
            raise ValueError(f"key {name} has {len(secret)} bytes, not 32")
        return secret

    def _path(self, name: str) -> str:
        return os.path.join(self.folder, base64.urlsafe_b64encode(name.encode()).decode())
