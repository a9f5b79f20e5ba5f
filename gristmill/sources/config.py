"""Secrets by reference, and schemas that come with a package."""

from __future__ import annotations

import hashlib
import os
from importlib import resources
from pathlib import Path

from . import schema


class SecretError(ValueError):
    """A reference that leads to no secret."""


def _file(path: Path) -> str:
    try:
        text = path.expanduser().read_text(encoding="utf-8").strip()
    except OSError as error:
        raise SecretError(f"cannot read {path}") from error
    if not text:
        raise SecretError(f"{path} is empty")
    return text


def secret(reference: str | None, defaults: tuple[str, ...] = ()) -> str:
    """A literal, `env:NAME`, `file:PATH` or the path of a file; without a reference the first default variable that is set."""
    if not reference or not reference.strip():
        found = next((os.environ[n] for n in defaults if os.environ.get(n)), None)
        if not found:
            raise SecretError(f"none of {', '.join(defaults) or 'no variables'} is set")
        return found
    reference = reference.strip()
    if reference.startswith("env:"):
        value = os.environ.get(reference[4:])
        if not value:
            raise SecretError(f"{reference[4:]} is not set")
        return value
    if reference.startswith("file:"):
        return _file(Path(reference[5:]))
    return _file(Path(reference)) if Path(reference).expanduser().is_file() else reference


def fingerprint(value: str) -> str:
    """What may be shown of a secret."""
    return hashlib.sha256(value.encode()).hexdigest()[:8]


def bundled(package: str, suffixes: tuple[str, ...] = (".json", ".yaml", ".yml")) -> list[tuple[str, schema.Schema]]:
    """(key, schema) of the schema files of a package, by name."""
    found = sorted((f for f in resources.files(package).iterdir() if f.name.endswith(suffixes)), key=lambda f: f.name)
    return [(f.name.rsplit(".", 1)[0], schema.parse(f.read_text(encoding="utf-8"), f.name)) for f in found]
