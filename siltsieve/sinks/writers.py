"""Writers: staged single files, unified records, artefacts of analysis, purged rows, and write guards."""

from __future__ import annotations

import csv
import datetime
import json
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager, suppress
from typing import IO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltsieve.operators.ingest import TARGETS

CSV_COLUMNS = [*TARGETS, "SourceFile", "BQInsertedDate"]


class WriteRefused(PermissionError):
    pass


def guard(paths: Iterable[str], approved_root: str | None, trusted: bool = False) -> None:
    """Refuse targets outside the approved root, without one outside the working folder; links are resolved first."""
    if trusted:
        return
    root = os.path.realpath(approved_root or os.getcwd())
    for p in paths:
        if p and os.path.commonpath([root, os.path.realpath(p)]) != root:
            raise WriteRefused(f"{p} lies outside {root}; name an approved output root")


def contained(base: str, relative: str) -> str:
    """A path below base; traversal is refused."""
    out = os.path.realpath(os.path.join(base, relative.lstrip("/")))
    if os.path.commonpath([os.path.realpath(base), out]) != os.path.realpath(base):
        raise WriteRefused(f"{relative} leaves {base}")
    return out


def suffixed(path: str, suffix: str) -> str:
    """``a/b.jsonl`` with ``_id_purged`` is ``a/b_id_purged.jsonl``."""
    stem, ext = os.path.splitext(path)
    return f"{stem}{suffix}{ext}"


@contextmanager
def staged(path: str) -> Iterator[IO[str]]:
    """A file that appears under its name only when it is complete; the mode of an existing file is kept."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), prefix=".staged-")
    try:
        with os.fdopen(fd, "w", encoding="utf-8", newline="") as f:
            yield f
        if os.path.exists(path):
            shutil.copymode(path, tmp)
        else:
            os.chmod(tmp, 0o644)
        # a checksum written beside the old contents would make the new ones unreadable
        with suppress(FileNotFoundError):
            os.unlink(os.path.join(os.path.dirname(os.path.abspath(path)), f".{os.path.basename(path)}.crc"))
        os.replace(tmp, path)
    except BaseException:
        if os.path.exists(tmp):
            os.unlink(tmp)
        raise


def output_format(path: str) -> str:
    return {".csv": "csv", ".json": "json", ".ndjson": "ndjson"}.get(os.path.splitext(path)[1].lower(), "jsonl")


def write_table(df: DataFrame, path: str, fmt: str, by: tuple[str, ...] = ()) -> None:
    """Distributed output: a folder of part files, for results of any size, in subfolders by the columns ``by``."""
    w = df.write.mode("overwrite").partitionBy(*by) if by else df.write.mode("overwrite")
    if fmt == "csv":
        w.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    else:
        w.option("ignoreNullFields", False).json(path)


def write_unified(df: DataFrame, path: str) -> int:
    """Unified records as one file; rows are streamed from the executors, never held together."""
    fmt = output_format(path)
    if fmt == "csv" and df.filter(F.size("Attributes") > 0).limit(1).count():
        raise ValueError("CSV cannot hold attributes; choose a JSON output")
    rows = df.select(*(CSV_COLUMNS if fmt == "csv" else [*TARGETS, "SourceFile", "Attributes", "BQInsertedDate"])).toLocalIterator(prefetchPartitions=True)
    n = 0
    with staged(path) as f:
        if fmt == "csv":
            out = csv.writer(f, lineterminator="\n")
            out.writerow(CSV_COLUMNS)
            for r in rows:
                out.writerow(["" if v is None else v for v in r])
                n += 1
        else:
            if fmt == "json":
                f.write("[")
            for r in rows:
                f.write(("" if fmt != "json" else ",\n" if n else "\n") + json.dumps(r.asDict(recursive=True), ensure_ascii=False) + ("" if fmt == "json" else "\n"))
                n += 1
            if fmt == "json":
                f.write("\n]\n")
    return n


def write_json(value: object, path: str) -> None:
    with staged(path) as f:
        json.dump(value, f, indent=2, ensure_ascii=False)
        f.write("\n")


def write_json_lists(head: dict, lists: Iterable[tuple[str, Iterable[object]]], path: str) -> None:
    """``head`` with a last member ``results`` of named lists, which are streamed."""
    with staged(path) as f:
        f.write("{\n" + "".join(f"  {json.dumps(k)}: {json.dumps(v, ensure_ascii=False)},\n" for k, v in head.items()) + '  "results": {')
        for n, (name, items) in enumerate(lists):
            f.write(("," if n else "") + f"\n    {json.dumps(name, ensure_ascii=False)}: ")
            _stream_list(items, f)
        f.write("\n  }\n}\n")


def write_json_list(items: Iterable[object], path: str) -> None:
    with staged(path) as f:
        _stream_list(items, f)
        f.write("\n")


def _stream_list(items: Iterable[object], f: IO[str]) -> None:
    f.write("[")
    for n, x in enumerate(items):
        f.write((",\n" if n else "\n") + json.dumps(x, ensure_ascii=False))
    f.write("\n]")


def write_text(text: str, path: str) -> None:
    with staged(path) as f:
        f.write(text)


def write_lines(lines: Iterable[str], path: str) -> None:
    with staged(path) as f:
        f.writelines(x + "\n" for x in lines)


def keep_newest(folder: str, prefix: str, most: int) -> list[str]:
    """Remove all but the newest ``most`` files of a history whose names sort by time; returns the removed."""
    old = sorted((n for n in os.listdir(folder) if n.startswith(prefix)), reverse=True)[most:]
    for n in old:
        os.unlink(os.path.join(folder, n))
    return sorted(old)


def write_rows_csv(header: list[str], rows: Iterable[Iterable[object]], path: str) -> None:
    with staged(path) as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(header)
        out.writerows(rows)


def to_yaml(value: object, depth: int = 0) -> str:
    """Valid YAML of plain values: mappings, lists and JSON scalars."""
    pad = "  " * depth
    if isinstance(value, dict):
        return "".join(f"{pad}{json.dumps(str(k))}:" + (f" {json.dumps(v, ensure_ascii=False)}\n" if not isinstance(v, (dict, list)) or not v else "\n" + to_yaml(v, depth + 1)) for k, v in value.items())
    if isinstance(value, list):
        return "".join(f"{pad}- {json.dumps(v, ensure_ascii=False)}\n" if not isinstance(v, (dict, list)) or not v else f"{pad}-\n" + to_yaml(v, depth + 1) for v in value)
    return f"{pad}{json.dumps(value, ensure_ascii=False)}\n"


def run_stamp() -> str:
    """The name of one run's backups."""
    return datetime.datetime.now(datetime.timezone.utc).strftime("%Y%m%dT%H%M%S.%fZ")


def backup_path(path: str, backup_dir: str, stamp: str) -> str:
    return contained(os.path.join(backup_dir, stamp, "local"), os.path.abspath(path))


def backup(path: str, backup_dir: str, stamp: str) -> str:
    """A copy of a file under backup_dir/<stamp of the run>/local/<absolute path>, made once: a second attempt keeps the first copy."""
    target = backup_path(path, backup_dir, stamp)
    os.makedirs(os.path.dirname(target), exist_ok=True)
    if not os.path.exists(target):
        tmp = f"{target}.{uuid.uuid4().hex}"
        shutil.copy2(path, tmp)
        os.replace(tmp, target)
    return target


def store_purged(entries: Iterable[dict], source_path: str, directory: str, reason: str, details: dict | None = None) -> tuple[str, int]:
    """Removed rows with their location and reason, as a JSON array or lines by the source's extension, with a metadata file."""
    now = datetime.datetime.now(datetime.timezone.utc).isoformat()
    path = contained(directory, suffixed(os.path.abspath(source_path), f"_{reason}"))  # files of one name in two folders stay apart
    array = source_path.lower().endswith(".json")
    n = 0
    with staged(path) as f:
        if array:
            f.write("[")
        for e in entries:
            row = {"originalRow": e["row"], "location": {"filePath": source_path, "lineNumber": e["line"]}, "reason": reason, "details": details or {}, "timestamp": now}
            f.write(("" if not array else ",\n" if n else "\n") + json.dumps(row, ensure_ascii=False) + ("" if array else "\n"))
            n += 1
        if array:
            f.write("\n]\n")
    write_json({"sourceFile": source_path, "reason": reason, "rows": n, "createdAt": now}, path + ".metadata.json")
    return path, n


def restore_purged(path: str) -> list[dict]:
    """The entries of a purged-row file."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    return json.loads(text) if text.lstrip().startswith("[") else [json.loads(x) for x in text.splitlines() if x.strip()]
