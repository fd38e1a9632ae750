"""Settings: nested JSON with dotted keys, kept beside the data and queried as columns where needed."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F


class Settings:
    """A JSON file over defaults. An unreadable file is set aside and the defaults hold."""

    def __init__(self, path: str, defaults: dict):
        self.path, self.defaults = Path(path), defaults
        self.values = self._load()

    def _load(self) -> dict:
        try:
            return _merged(self.defaults, json.loads(self.path.read_text()))
        except FileNotFoundError:
            return _merged(self.defaults, {})
        except (ValueError, AttributeError):
            os.replace(self.path, self.path.with_suffix(".bak"))
            return _merged(self.defaults, {})

    def get(self, key: str, default=None):
        at = self.values
        for part in key.split("."):
            if not isinstance(at, dict) or part not in at:
                return default
            at = at[part]
        return at

    def set(self, key: str, value) -> None:
        *parents, last = key.split(".")
        at = self.values
        for part in parents:
            if not isinstance(at.get(part), dict):
                at[part] = {}
            at = at[part]
        at[last] = value

    def save(self, path: str | None = None) -> None:
        """Write to a file that appears whole."""
        to = Path(path) if path else self.path
        temporary = to.with_suffix(".part")
        temporary.write_text(json.dumps(self.values, indent=2, sort_keys=True))
        os.replace(temporary, to)

    def read_from(self, path: str) -> None:
        """Take over another file, which must have every top-level key of the defaults."""
        values = json.loads(Path(path).read_text())
        absent = sorted(set(self.defaults) - set(values))
        if absent:
            raise ValueError(f"missing settings: {', '.join(absent)}")
        self.values = _merged(self.defaults, values)


def _merged(defaults: dict, values: dict) -> dict:
    out = {k: _merged(v, {}) if isinstance(v, dict) else v for k, v in defaults.items()}
    for k, v in values.items():
        out[k] = _merged(out[k], v) if isinstance(out.get(k), dict) and isinstance(v, dict) else v
    return out


def setting(document: Column, key: str) -> Column:
    """A setting of a column of JSON documents, by dotted key; null where it is absent."""
    return F.get_json_object(document, f"$.{key}")
