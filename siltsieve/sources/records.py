"""Files of every supported format as one canonical record table.

Columns: source_path, folder, file_size, file_mtime, format, record_index, line_number, raw, data, decode_error.
``data`` is JSON text with number lexemes kept. Line formats are read by the splittable text source, in any number
of tasks a file, with exact line numbers; formats that need a whole document for parsing are one task a file.
"""

from __future__ import annotations

import csv
import functools
import io
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltsieve.functions import jsontext as J
from siltsieve.sources import xlsx, xmlio
from siltsieve.session import cut, dim_join
from siltsieve.sources.discovery import ANALYSIS_FORMATS, JSON_FORMATS, Source, discover

#: Bytes a JSON line may have unless a caller says otherwise.
MAX_LINE = 10 * 1024 * 1024
SCHEMA = "source_path string, folder string, file_size bigint, file_mtime timestamp, format string, record_index int, line_number int, raw string, data string, decode_error string"


def header_names(cells: list[str]) -> list[str]:
    """Header cells without byte order mark and outer blanks; an empty one is column_N, a repeated one gets the next free number."""
    out: list[str] = []
    for i, c in enumerate(cells, 1):
        name = base = c.lstrip("﻿").strip() or f"column_{i}"
        k = 2
        while name in out:
            name, k = f"{base}_{k}", k + 1
        out.append(name)
    return out


def _table(rows: Iterator[tuple[int, list[str]]]) -> Iterator[tuple[int, str | None, str, str | None]]:
    """Rows under a header: missing cells are empty, extra ones dropped, blank rows skipped."""
    names: list[str] | None = None
    for line, cells in rows:
        if names is None:
            names = header_names(cells)
        elif any(c.strip() for c in cells):
            yield line, None, J.dump(dict(zip(names, [*cells, *[""] * len(names)], strict=False))), None


def _csv(text: str, sep: str) -> Iterator[tuple[int, list[str]]]:
    csv.field_size_limit(1 << 30)
    reader = csv.reader(io.StringIO(text, newline=""), delimiter=sep)
    before = 0
    for cells in reader:
        yield before + 1, cells
        before = reader.line_num


def _line(line: str, max_bytes: int) -> tuple[str | None, str | None]:
    """(data, decode_error) of one line."""
    if len(line) > max_bytes or len(line.encode("utf-8", "replace")) > max_bytes:
        return None, f"line longer than {max_bytes} bytes"
    try:
        o = J.parse(line)
    except ValueError as e:
        return None, str(e)
    return (J.dump(o), None) if isinstance(o, dict) else (None, "not a JSON object")


def _lines(text: str, max_bytes: int) -> Iterator[tuple[int, str | None, str | None, str | None]]:
    """One JSON value per line; blank lines count but are no records; other text is a decode error."""
    for n, line in enumerate(text.split("\n"), 1):
        line = line.rstrip("\r").lstrip("﻿") if n == 1 else line.rstrip("\r")
        if line.strip():
            yield n, line, *_line(line, max_bytes)


def _document(text: str) -> Iterator[tuple[int, str | None, str | None, str | None]]:
    """One JSON object, or an array of objects; anything after it is an error."""
    try:
        o = J.parse(text.lstrip("﻿"))
    except ValueError as e:
        yield 1, None, None, str(e)
        return
    for i, x in enumerate(o if isinstance(o, list) else [o], 1):
        ok = isinstance(x, dict)
        yield i, None, J.dump(x) if ok else None, None if ok else "not a JSON object"


def _safely(rows: Iterator[tuple]) -> Iterator[tuple[int, str | None, str | None, str | None]]:
    """A file that cannot be read on becomes one record with the error; the other files are not affected."""
    try:
        yield from rows
    except Exception as e:  # noqa: BLE001
        yield 1, None, None, f"{type(e).__name__}: {e}"


def decode(fmt: str, content: bytes, json_mode: str = "lines", xml_path: str = "", sheet: str = "", max_line: int = MAX_LINE) -> Iterator[tuple[int, str | None, str | None, str | None]]:
    """(line_number, raw, data, decode_error) of one file."""
    if fmt == "xlsx":
        yield from _table(xlsx.sheet_rows(content, sheet))
        return
    text = content.decode("utf-8", "replace")
    if fmt in ("csv", "tsv"):
        yield from _table(_csv(text, "\t" if fmt == "tsv" else ","))
    elif fmt == "xml":
        for e, _ in xmlio.records(xmlio.parse(text.lstrip("﻿")), xml_path):
            yield e.line, None, J.dump(xmlio.record_value(e, not xml_path)), None
    elif fmt == "json" and json_mode == "document":
        yield from _document(text)
    else:
        yield from _lines(text, max_line)


def read_records(spark: SparkSession, paths: str | list[str] | list[Source], formats: tuple[str, ...] = ANALYSIS_FORMATS, json_mode: str = "lines", xml_path: str = "", sheet: str = "", max_line: int = MAX_LINE) -> DataFrame:
    """The canonical record table of all files."""
    sources = paths if paths and isinstance(paths[0], Source) else discover(paths, formats, spark)
    by_line = [s for s in sources if s.format in JSON_FORMATS and not (s.format == "json" and json_mode == "document")]
    whole = [s for s in sources if s not in set(by_line)]
    parts = ([_read_lines(spark, [s.path for s in by_line], max_line)] if by_line else []) + ([_read_files(spark, whole, json_mode, xml_path, sheet)] if whole else [])
    return functools.reduce(DataFrame.unionByName, parts)


def numbered_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source_path, file_size, file_mtime, line_number, raw) of text files of any size, read in splits.

    A split holds consecutive lines in order, so a line's number is its place in its split plus the lines of the splits
    before it; only the counts of the splits are gathered, one row a split.
    """
    meta = [F.col(f"_metadata.{c}").alias(a) for c, a in (("file_path", "path"), ("file_size", "file_size"), ("file_modification_time", "file_mtime"), ("file_block_start", "split"))]
    t = spark.read.option("lineSep", "\n").text(paths).select(*meta, F.col("value").alias("raw"), F.monotonically_increasing_id().alias("at"))
    splits = cut(t.groupBy("path", "split").agg(F.count("*").alias("n"), F.min("at").alias("first")))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("path", "split", (F.coalesce(before, F.lit(0)) + 1 - F.col("first")).alias("shift"))
    path = F.regexp_replace("path", "^file:/+", "/")
    return dim_join(t, splits, ["path", "split"]).select(path.alias("source_path"), "file_size", "file_mtime", (F.col("at") + F.col("shift")).alias("line_number"), "raw")


def _read_lines(spark: SparkSession, paths: list[str], max_line: int) -> DataFrame:
    first = F.col("line_number") == 1
    raw = F.regexp_replace(F.when(first, F.regexp_replace("raw", "^\ufeff", "")).otherwise(F.col("raw")), "\r+$", "")
    lines = numbered_lines(spark, paths).withColumn("raw", raw).filter(F.col("raw").rlike(r"\S"))

    @F.pandas_udf("data string, decode_error string")
    def decoded(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_line(x, max_line) for x in s], columns=["data", "decode_error"])

    n = F.col("line_number").cast("int")
    folder = F.regexp_replace("source_path", "/[^/]*$", "")
    d = lines.withColumn("d", decoded("raw"))
    return d.select("source_path", folder.alias("folder"), "file_size", "file_mtime", F.lower(F.substring_index("source_path", ".", -1)).alias("format"), (n - 1).alias("record_index"), n.alias("line_number"), "raw", "d.data", "d.decode_error")


def _read_files(spark: SparkSession, sources: list[Source], json_mode: str, xml_path: str, sheet: str) -> DataFrame:
    files = spark.read.format("binaryFile").load([s.path for s in sources])
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.timestamp("us", tz="UTC"), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, mtime, size, content in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                path = path.removeprefix("file:")
                path = "/" + path.lstrip("/") if "://" not in path else path
                fmt = path.rsplit(".", 1)[-1].lower()
                cols: list[list] = [[] for _ in names]
                for i, (line, raw, data, error) in enumerate(_safely(decode(fmt, content, json_mode, xml_path, sheet))):
                    for c, x in zip(cols, (path, path.rsplit("/", 1)[0], size, mtime, fmt, i, line, raw, data, error), strict=True):
                        c.append(x)
                    if len(cols[0]) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
                        cols = [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return files.select("path", "modificationTime", "length", "content").mapInArrow(run, SCHEMA)


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Line formats without line numbers: splittable, for files of any size."""
    bad = [p for p in paths if p.rsplit(".", 1)[-1].lower() not in JSON_FORMATS]
    if bad:
        raise ValueError(f"not a line format: {bad[0]}")
    t = spark.read.text(paths).select(F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("raw"))
    return t.filter(F.trim("raw") != "")
