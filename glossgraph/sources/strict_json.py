"""Strict JSON: duplicate keys, NaN and depth beyond a limit are errors. For metadata on the driver."""

from __future__ import annotations

import json

from glossgraph.functions.digests import DEEPEST, DigestError, normalize_text


class SourceError(ValueError):
    """Metadata that isn't strict JSON."""


def _pairs(pairs: list[tuple[str, object]]) -> dict:
    out: dict = {}
    for k, v in pairs:
        if k in out:
            raise SourceError(f"key {k!r} twice")
        out[k] = v
    return out


def _refuse(name: str):
    raise SourceError(f"{name} isn't JSON")


def _depth(value: object, at: int = 0) -> None:
    if at > DEEPEST:
        raise SourceError("too deep")
    for x in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
        _depth(x, at + 1)


def loads(raw: bytes) -> object:
    """Parse UTF-8 bytes."""
    try:
        value = json.loads(normalize_text(raw), object_pairs_hook=_pairs, parse_constant=_refuse)
    except (UnicodeDecodeError, json.JSONDecodeError, RecursionError, DigestError) as e:
        raise SourceError(str(e)) from e
    _depth(value)
    return value
