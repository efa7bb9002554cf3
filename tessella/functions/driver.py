"""Small helpers that run on the driver: settings and target specs."""

from __future__ import annotations

import hashlib
import json
import math
import re
from datetime import date, datetime
from pathlib import Path


def json_safe(value):
    """value with only JSON types: paths and times as texts, sets sorted, tuples as lists, NaN and infinity as null."""
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, (set, frozenset)):
        return sorted((json_safe(v) for v in value), key=str)
    if isinstance(value, (list, tuple)):
        return [json_safe(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if value is None or isinstance(value, (str, int, float, bool)):
        return value
    if isinstance(value, (Path, date, datetime)):
        return str(value)
    if hasattr(value, "item"):
        return json_safe(value.item())
    return json_safe(value.tolist()) if hasattr(value, "tolist") else str(value)


def settings_hash(settings: dict) -> str:
    """MD5 of the key-sorted JSON of settings."""
    return hashlib.md5(json.dumps(json_safe(settings), sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def parse_target_spec(raw: str | None) -> tuple[str, list[str]]:
    """('none' | 'regex' | 'list' | 'single', items) of a target spec.

    're:' and texts with marks of a regular expression give a regex, 'list:' one
    literal item, JSON arrays and commas a list.
    """
    spec = (raw or "").strip()
    if not spec or spec.lower() == "none":
        return "none", []
    if spec.startswith("re:"):
        return "regex", [spec[3:]]
    if spec.startswith("list:"):
        return "list", [spec[5:]]
    if spec.startswith("["):
        return "list", [str(x) for x in json.loads(spec)]
    if "," in spec:
        return "list", [x.strip() for x in spec.split(",") if x.strip()]
    return ("regex", [spec]) if re.search(r"[|()^$*+?\\]", spec) else ("single", [spec])
