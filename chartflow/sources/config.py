"""Settings from JSON or YAML files, and logging."""

from __future__ import annotations

import json
import logging
import os
import sys

import yaml

NEEDED = ("data_directory", "filetype", "timezone")


def read_config(path: str) -> dict:
    """A JSON or YAML file; tables_path is another name for data_directory."""
    with open(path) as f:
        found = json.load(f) if path.endswith(".json") else yaml.safe_load(f)
    if "tables_path" in found and "data_directory" not in found:
        found["data_directory"] = found.pop("tables_path")
    return found


def check_config(config: dict) -> dict:
    if missing := [k for k in NEEDED if not config.get(k)]:
        raise ValueError(f"settings lack {missing}")
    return config


def resolve(path: str | None = None, **given) -> dict:
    """Given values first; a file only for what they lack, config.json or .yaml of this folder if none is named."""
    given = {k: v for k, v in given.items() if v is not None}
    if all(k in given for k in NEEDED):
        return given
    path = path or next((p for p in ("config.json", "config.yaml", "config.yml") if os.path.exists(p)), None)
    if not path:
        raise FileNotFoundError(f"give {NEEDED} or a settings file")
    return check_config({**read_config(path), **given})


def example_config(path: str) -> None:
    with open(path, "w") as f:
        json.dump({"data_directory": "/path/to/tables", "filetype": "parquet", "timezone": "UTC", "output_directory": "output"}, f, indent=2)


def logger(name: str = "chartflow", level: str | int = "INFO", file: str | None = None) -> logging.Logger:
    """A logger to standard error and, if wanted, a file; asking twice adds nothing twice."""
    log = logging.getLogger(name)
    log.setLevel(level.upper() if isinstance(level, str) else level)
    form = logging.Formatter("%(asctime)s %(name)s %(levelname)s %(message)s")
    wanted = [("stderr", lambda: logging.StreamHandler(sys.stderr)), *([(file, lambda: logging.FileHandler(file))] if file else [])]
    for key, make in wanted:
        if not any(getattr(h, "_key", None) == key for h in log.handlers):
            h = make()
            h._key = key
            h.setFormatter(form)
            log.addHandler(h)
    return log
