"""Paths into records: ``a.b``, ``a[0].b``, ``a[*].b``, ``*`` for any key; a leading dot or ``$.`` is allowed."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

Step = tuple[str, object]
_STEP = re.compile(r"(?P<key>[^\[\]\s]+?)(?:\[(?P<index>\d+|\*)\])?\Z")


def parse_path(path: str) -> list[Step]:
    """(key, index) steps; index is None, a number or ``*``. ValueError for a malformed path."""
    body = path[2:] if path.startswith("$.") else path[1:] if path.startswith(".") else path
    if not body:
        raise ValueError("empty path")
    steps: list[Step] = []
    for part in body.split("."):
        m = _STEP.match(part)
        if not m:
            raise ValueError(f"malformed step {part!r} in {path!r}")
        i = m["index"]
        steps.append((m["key"], None if i is None else "*" if i == "*" else int(i)))
    return steps


def path_kind(path: str) -> str:
    """simple, array, wildcard or wildcard_array."""
    steps = parse_path(path)
    wild = any(k == "*" for k, _ in steps)
    if any(i == "*" for _, i in steps):
        return "wildcard_array"
    return "wildcard" if wild else "array" if any(i is not None for _, i in steps) else "simple"


def path_complexity(path: str) -> str:
    """very_complex above one wildcard, complex with one wildcard or more than ten steps, else simple."""
    steps = parse_path(path)
    wild = sum((k == "*") + (i == "*") for k, i in steps)
    return "very_complex" if wild > 1 else "complex" if wild == 1 or len(steps) > 10 else "simple"


def find(o: object, steps: list[Step], at: str = "") -> list[tuple[str, object]]:
    """Every (concrete path, value) a path leads to."""
    if not steps:
        return [(at, o)]
    if not isinstance(o, dict):
        return []
    (key, index), rest = steps[0], steps[1:]
    out: list[tuple[str, object]] = []
    for k in list(o) if key == "*" else [key] if key in o else []:
        here = f"{at}.{k}" if at else k
        if index is None:
            out += find(o[k], rest, here)
        elif isinstance(o[k], list):
            chosen = range(len(o[k])) if index == "*" else [index]
            for i in chosen:
                if i < len(o[k]):
                    out += find(o[k][i], rest, f"{here}[{i}]")
    return out


def lookup(o: dict, field: str) -> tuple[bool, object, str]:
    """(found, value, top-level key used): the literal key first, then the path; ``[*]`` takes the first element that resolves."""
    if field in o:
        return True, o[field], field
    try:
        steps = parse_path(field)
    except ValueError:
        return False, None, ""
    found = find(o, steps)
    return (True, found[0][1], steps[0][0]) if found else (False, None, "")


def column_at(data: Column, path: str, as_type: str = "string") -> Column:
    """Native lookup of a path without wildcards in a variant column."""
    out = "$"
    for k, i in parse_path(path):
        if k == "*" or i == "*":
            raise ValueError("wildcards need explode")
        out += "['" + k.replace("'", "\\'") + "']" + ("" if i is None else f"[{i}]")
    return F.try_variant_get(data, out, as_type)
