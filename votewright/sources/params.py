"""Model parameters as JSON files."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any


def write_params(path: str, params: dict[str, Any]) -> None:
    Path(path).write_text(json.dumps(params))


def read_params(path: str) -> dict[str, Any]:
    return json.loads(Path(path).read_text())
