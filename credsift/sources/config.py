"""Configuration of a scan: loading, defaults, validation."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

#: In the order of a folder's search; the first has JSON or YAML in it.
NAMES = (".credsiftrc", ".credsiftrc.json", ".credsiftrc.yaml", ".credsiftrc.yml", "credsift.config.json", "credsift.config.yaml", "credsift.config.yml", "credsift.toml")
SEVERITIES = ("critical", "high", "medium", "low")


@dataclass(frozen=True)
class Config:
    ignore: tuple[str, ...] = ()
    customPatterns: str | None = None  # noqa: N815  (the file's own field names)
    failOn: str = "medium"  # noqa: N815
    include: tuple[str, ...] | None = field(default=None)


def validated(raw: object) -> Config:
    """Defaults filled in; unknown keys dropped; wrong types and values are errors."""
    if raw is None:
        return Config()
    if not isinstance(raw, dict):
        raise ValueError("expected an object")
    texts = lambda v: isinstance(v, list) and all(isinstance(x, str) for x in v)
    for key in ("ignore", "include"):
        if key in raw and not texts(raw[key]):
            raise ValueError(f"{key}: expected an array of strings")
    custom = raw.get("customPatterns")
    if "customPatterns" in raw and (not isinstance(custom, str) or not custom):
        raise ValueError("customPatterns: expected a string of at least one character")
    if "failOn" in raw and raw["failOn"] not in SEVERITIES:
        raise ValueError(f"failOn: expected one of {', '.join(SEVERITIES)}")
    return Config(tuple(raw.get("ignore", ())), custom, raw.get("failOn", "medium"), tuple(raw["include"]) if "include" in raw else None)


def parsed(name: str, text: str) -> object:
    """What a configuration file says; YAML needs PyYAML, which is not required otherwise."""
    if name.endswith(".toml"):
        return tomllib.loads(text)
    if not name.endswith((".yaml", ".yml")):
        try:
            return json.loads(text)
        except ValueError:
            if name.endswith(".json"):
                raise
    try:
        import yaml
    except ImportError as e:
        raise ValueError("YAML needs PyYAML, which is not installed") from e
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ValueError(str(e)) from e


def load_config(folder: str | Path = ".") -> Config:
    """The first configuration file in the folder or the nearest of its parents; none or an empty one gives the defaults."""
    start = Path(folder).resolve()
    for path in (Path(place, name) for place in (start, *start.parents) for name in NAMES):
        try:
            if not path.is_file():
                continue
            text = path.read_text(encoding="utf-8")
            return validated(parsed(path.name, text) if text.strip() else None)
        except (OSError, ValueError) as e:
            raise ValueError(f"{path}: not a configuration: {e}") from e
    return Config()
