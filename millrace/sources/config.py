"""Repository defaults: a JSON file found from a folder upwards, below what a caller gives."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields

NAME = "millrace.json"


@dataclass
class Config:
    rules: str | None = None
    target: str | None = None
    properties: dict[str, str] = field(default_factory=dict)
    ignore: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)


def find(folder: str) -> str | None:
    """The nearest file at or above a folder."""
    folder = os.path.abspath(folder)
    while True:
        path = os.path.join(folder, NAME)
        if os.path.isfile(path):
            return path
        above = os.path.dirname(folder)
        if above == folder:
            return None
        folder = above


def load(folder: str, **given) -> Config:
    """Defaults, below the file's values, below those given; an unknown name is an error."""
    values: dict = {}
    if (path := find(folder)) is not None:
        with open(path, encoding="utf-8") as f:
            values = json.load(f)
    known = {f.name for f in fields(Config)}
    for name in values:
        if name not in known:
            raise ValueError(f"{path}: {name} is not a setting")
    return Config(**(values | {k: v for k, v in given.items() if v is not None}))
