"""``KEY=value`` files for the driver: secrets are read here and never put in Spark's configuration."""

from __future__ import annotations

import os
from collections.abc import Mapping


def parse_env(text: str, *, strict: bool = True) -> dict[str, str]:
    """Values by key. ``strict``: a line without ``=`` is an error, and `` #`` ends an unquoted value; else such lines are passed over and ``#`` is kept."""
    found: dict[str, str] = {}
    for number, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        key, equals, value = line.removeprefix("export ").partition("=")
        if not equals:
            if strict:
                raise ValueError(f"line {number}: no = in it")
            continue
        value = value.strip()
        if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"":
            value = value[1:-1]
        elif strict:
            value = value.split(" #")[0].rstrip()
        found[key.strip()] = value
    return found


def setting(name: str, values: Mapping[str, str] | None = None, *, required: bool = True) -> str | None:
    """The environment's value, else the file's."""
    value = os.environ.get(name) or (values or {}).get(name)
    if required and not value:
        raise ValueError(f"{name} is not set")
    return value
