"""Schemaless JSON values: number lexemes are kept, values have one text form, and mutations are explicit.

These are the plain functions behind the Arrow functions of the record operators. Where a table has a schema
the operators use native expressions instead.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable


class Number(str):
    """A JSON number as it was written."""


def _refuse(x: str) -> None:
    raise ValueError(f"not JSON: {x}")


def parse(text: str) -> object:
    """Exactly one JSON value; ValueError for anything else."""
    try:
        return json.loads(text, parse_int=Number, parse_float=Number, parse_constant=_refuse)
    except RecursionError as e:
        raise ValueError("nested too deeply") from e


def dump(v: object, sort: bool = False) -> str:
    """Compact JSON with numbers as they were written."""
    if isinstance(v, Number):
        return str.__str__(v)
    if isinstance(v, dict):
        items = sorted(v.items()) if sort else v.items()
        return "{" + ",".join(json.dumps(k, ensure_ascii=False) + ":" + dump(x, sort) for k, x in items) + "}"
    if isinstance(v, list):
        return "[" + ",".join(dump(x, sort) for x in v) + "]"
    return json.dumps(v, ensure_ascii=False)


def text_of(v: object) -> str:
    """The text by which values are compared: strings and lexemes as they are, ``<nil>``, ``map[k:v]``, ``[a b]``."""
    if isinstance(v, str):
        return str.__str__(v)
    if v is None:
        return "<nil>"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, dict):
        return "map[" + " ".join(f"{k}:{text_of(x)}" for k, x in sorted(v.items())) + "]"
    if isinstance(v, list):
        return "[" + " ".join(map(text_of, v)) + "]"
    return str(v)


def scalar_text(v: object) -> str | None:
    """The text ingest stores: null dropped, nested values as compact JSON."""
    if v is None:
        return None
    if isinstance(v, str):
        return str.__str__(v)
    return dump(v)


def type_name(v: object, strict: bool = False) -> str:
    """null, string, integer, number, boolean, array or object; with ``strict`` numbers are strings."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, Number):
        return "string" if strict else ("integer" if re.fullmatch(r"-?\d+", v) else "number")
    return "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object" if isinstance(v, dict) else "string"


def fnv1a64(data: bytes) -> int:
    """The public 64-bit FNV-1a hash."""
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


# ---- mutations; each returns whether anything changed -------------------------------------------------


def coerce(new: str, old: object) -> object:
    """Replacement text in the type of the value it replaces, if it can be read so."""
    if isinstance(old, bool):
        low = new.strip().lower()
        return True if low in ("true", "t", "1") else False if low in ("false", "f", "0") else new
    if isinstance(old, Number):
        try:
            parse(new)
            return Number(new) if re.fullmatch(r"-?\d+(\.\d+)?([eE][+-]?\d+)?", new) else new
        except ValueError:
            return new
    return new


def update_values(o: dict, key: str, old: str, new: str) -> bool:
    """Replace the value of ``key`` wherever it equals ``old``, in nested objects and arrays of objects."""
    changed = False
    for k, v in list(o.items()):
        if k == key and text_of(v) == old:
            o[k] = coerce(new, v)
            changed = True
        elif isinstance(v, dict):
            changed |= update_values(v, key, old, new)
        elif isinstance(v, list):
            for x in v:
                if isinstance(x, dict):
                    changed |= update_values(x, key, old, new)
    return changed


def matches(o: dict, key: str, values: Iterable[str], state_key: str = "", state_value: str = "") -> bool:
    if not key or not values or key not in o or text_of(o[key]) not in values:
        return False
    return not (state_key and state_value) or (state_key in o and text_of(o[state_key]) == state_value)


def delete_items(o: dict, array_key: str, key: str, values: Iterable[str], state_key: str = "", state_value: str = "") -> bool:
    """Remove matching objects from an array, or from the single repeated child of a wrapper object."""
    v = o.get(array_key)
    if isinstance(v, list):
        kept = [x for x in v if not (isinstance(x, dict) and matches(x, key, values, state_key, state_value))]
        o[array_key] = kept
        return len(kept) < len(v)
    if isinstance(v, dict):
        child = next((k for k in v if not k.startswith("@") and k not in ("#text", "#content")), None)
        if child is None:
            return False
        items = v[child] if isinstance(v[child], list) else [v[child]]
        kept = [x for x in items if not (isinstance(x, dict) and matches(x, key, values, state_key, state_value))]
        if len(kept) == len(items):
            return False
        if kept:
            v[child] = kept[0] if len(kept) == 1 else kept
        else:
            del v[child]
        return True
    return False


def delete_path(o: object, keys: list[str]) -> bool:
    """Remove the value at a dotted path of objects."""
    for k in keys[:-1]:
        if not isinstance(o, dict) or k not in o:
            return False
        o = o[k]
    if isinstance(o, dict) and keys and keys[-1] in o:
        del o[keys[-1]]
        return True
    return False


def delete_sub_key(o: object, steps: list[tuple[str, object]], values: set[str]) -> bool:
    """Remove values at a parsed path if their text is in ``values`` (all if empty); ``[*]`` also drops objects left empty."""
    if not steps or not isinstance(o, dict):
        return False
    (key, index), rest = steps[0], steps[1:]
    if key == "*":
        return any([delete_sub_key(o, [(k, index), *rest], values) for k in list(o)])
    if key not in o:
        return False
    if index is None:
        if rest:
            return delete_sub_key(o[key], rest, values)
        v = o[key]
        if isinstance(v, list):
            kept = [x for x in v if values and text_of(x) not in values]
            if not values:
                del o[key]
                return True
            o[key] = kept
            return len(kept) < len(v)
        if values and text_of(v) not in values:
            return False
        del o[key]
        return True
    arr = o[key]
    if not isinstance(arr, list):
        return False
    chosen = range(len(arr)) if index == "*" else [index] if index < len(arr) else []
    changed, drop = False, set()
    for i in chosen:
        if rest:
            changed |= delete_sub_key(arr[i], rest, values)
            if index == "*" and arr[i] == {}:
                drop.add(i)
        elif not values or text_of(arr[i]) in values:
            drop.add(i)
    if drop:
        o[key] = [x for i, x in enumerate(arr) if i not in drop]
    return changed or bool(drop)


def repair(text: str) -> str | None:
    """Text with trailing commas dropped and single quotes made double, if that makes it JSON; else None."""
    for fixed in (text, re.sub(r",(\s*[}\]])", r"\1", text), re.sub(r",(\s*[}\]])", r"\1", text.replace("'", '"'))):
        try:
            parse(fixed)
            return fixed
        except ValueError:
            continue
    return None


def completeness(o: dict) -> int:
    """Top-level values that are neither null nor empty text."""
    return sum(v is not None and v != "" for v in o.values())


def normalise_semantic(v: object) -> object:
    """Lower case with blanks collapsed, recursively."""
    if isinstance(v, Number):
        return v
    if isinstance(v, str):
        return re.sub(r"\s+", " ", v.lower(), flags=re.ASCII).strip()
    if isinstance(v, dict):
        return {k: normalise_semantic(x) for k, x in v.items()}
    return [normalise_semantic(x) for x in v] if isinstance(v, list) else v
