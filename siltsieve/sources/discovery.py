"""Finding input files and telling their formats."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass

#: Extensions by use, and names by which a format may be given.
JSON_FORMATS = ("json", "ndjson", "jsonl")
ANALYSIS_FORMATS = ("csv", "tsv", "xlsx", "xml", *JSON_FORMATS)
REWRITE_FORMATS = ("xml", *JSON_FORMATS)
ALIASES = {"json-lines": "jsonl", "jsonlines": "jsonl", "json_lines": "jsonl", "nd-json": "ndjson", "tab": "tsv", "excel": "xlsx"}


@dataclass(frozen=True)
class Source:
    path: str
    folder: str
    format: str
    size: int
    mtime: float


def normalise_format(name: str) -> str:
    f = name.strip().lower().lstrip(".")
    f = ALIASES.get(f, f)
    if f not in ANALYSIS_FORMATS:
        raise ValueError(f"unsupported format {name!r}")
    return f


def format_of(path: str) -> str | None:
    ext = os.path.splitext(path)[1].lower().lstrip(".")
    return ext if ext in ANALYSIS_FORMATS else None


def is_remote(path: str) -> bool:
    return "://" in path and not path.startswith("file://")


def discover(paths: str | list[str], formats: tuple[str, ...] = ANALYSIS_FORMATS, spark: object | None = None) -> list[Source]:
    """Files of the given formats under comma-separated or listed paths, each once; no file at all is an error.

    Remote paths are listed through the session's file system, local ones directly.
    """
    wanted = [p.strip() for p in (paths.split(",") if isinstance(paths, str) else paths)]
    found: dict[str, Source] = {}
    for p in [x for x in wanted if x]:
        for s in _remote(spark, p, formats) if is_remote(p) else _local(re.sub("^file:/+", "/", p), formats):
            found.setdefault(s.path, s)
    if not found:
        raise FileNotFoundError(f"no input files in {paths!r}")
    return [found[k] for k in sorted(found)]


def _local(path: str, formats: tuple[str, ...]) -> list[Source]:
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    if os.path.isfile(path):
        if format_of(path) not in formats:
            raise ValueError(f"unsupported file {path}")
        files = [path]
    else:
        files = [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if format_of(f) in formats]
        if not files:
            raise FileNotFoundError(f"no supported files in {path}")
    out = []
    for f in files:
        real = os.path.realpath(f)
        st = os.stat(real)
        out.append(Source(real, os.path.dirname(real), format_of(real) or "", st.st_size, st.st_mtime))
    return out


def _remote(spark: object, path: str, formats: tuple[str, ...]) -> list[Source]:
    if spark is None:
        raise ValueError("a session is needed to list remote paths")
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    out, it = [], fs.listFiles(p, True)
    while it.hasNext():
        s = it.next()
        name = s.getPath().toString()
        if (f := format_of(name)) in formats:
            out.append(Source(name, name.rsplit("/", 1)[0], f, s.getLen(), s.getModificationTime() / 1000))
    return out


def sniff_json(path: str, lines: int = 100) -> str:
    """``ndjson`` if the first lines each hold one value, else ``json``."""
    with open(path, encoding="utf-8-sig", errors="replace") as f:
        head = [x for x, _ in zip(f, range(lines), strict=False) if x.strip()]
    for x in head:
        try:
            json.loads(x)
        except ValueError:
            return "json"
    return "json" if len(head) == 1 and head[0].lstrip().startswith("[") else "ndjson"
