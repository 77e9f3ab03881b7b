"""Ignore rules in the syntax of gitignore: per directory, last match wins, the deepest file decides."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    pattern: re.Pattern
    negated: bool
    directories_only: bool


def _translate(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif glob[i:] == "**" and (i == 0 or glob[i - 1] == "/"):
            out, i = out + ".+", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "(?!/)[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
        elif c == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


def parse(text: str) -> list[Rule]:
    """The rules of one ignore file; paths are relative to its directory."""
    rules = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated else line
        only = line.endswith("/")
        line = line.rstrip("/") if only else line
        anchored = "/" in line
        body = _translate(line.lstrip("/"))
        if body:
            rules.append(Rule(re.compile(body if anchored else f"(?:.*/)?{body}"), negated, only))
    return rules


def ignored(chain: Sequence[tuple[str, list[Rule]]], path: str, is_directory: bool) -> bool:
    """Whether rules exclude `path`; `chain` has (directory, rules) from the root downwards, "" for the root."""
    for directory, rules in reversed(chain):
        inside = path[len(directory) + 1 :] if directory else path
        for rule in reversed(rules):
            if (is_directory or not rule.directories_only) and rule.pattern.fullmatch(inside):
                return not rule.negated
    return False
