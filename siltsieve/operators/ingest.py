"""Mapping of heterogeneous tables and files to the unified record of 12 fields."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltsieve.functions import jsontext as J
from siltsieve.functions.paths import lookup

TARGETS = ["Id", "FirstName", "LastName", "Email", "Mobile", "PostCode", "DataSource", "SourceCreatedDate", "SourceModifiedDate"]
#: Texts that count as null unless a mapping says otherwise, compared in lower case.
NULL_VALUES = ["", "null", "NULL", "n/a", "N/A"]
UNIFIED = ", ".join(f"{t} string" for t in TARGETS) + ", SourceFile string, Attributes array<struct<Key:string,Value:string>>, BQInsertedDate string"


@dataclass(frozen=True)
class Mapping:
    """How the files that match are read into the unified record."""

    name: str = ""
    glob: str = ""
    format: str = ""
    columns: dict[str, str] = field(default_factory=dict)
    attributes: dict[str, str] = field(default_factory=dict)
    defaults: dict[str, str] = field(default_factory=dict)
    data_source: str = ""
    sheet: str = ""
    xml_record_path: str = ""
    source_created_date_field: str = ""
    source_modified_date_field: str = ""
    include_unmapped: bool = False
    null_values: tuple[str, ...] = tuple(NULL_VALUES)
    trim: bool = True

    def __post_init__(self) -> None:
        for t in [*self.columns.values(), *self.defaults]:
            if t not in TARGETS:
                raise ValueError(f"unknown target field {t!r}")

    def fits(self, basename: str, fmt: str) -> bool:
        if self.format and self.format != fmt:
            return False
        low = basename.lower()
        if not self.name and not self.glob:
            return bool(self.format)
        return bool((self.name and low == self.name.lower()) or (self.glob and fnmatch.fnmatchcase(low, self.glob.lower())))


def resolve(mappings: list[Mapping], basename: str, fmt: str) -> Mapping | None:
    """The first mapping that fits a file."""
    return next((m for m in mappings if m.fits(basename, fmt)), None)


def cleaned(c: Column, m: Mapping) -> Column:
    c = c.cast("string")
    c = F.trim(c) if m.trim else c
    return F.when(~F.lower(c).isin([v.lower() for v in m.null_values]), c)


def unify_table(df: DataFrame, m: Mapping, source_file: str, inserted: str, modified: str | None = None) -> DataFrame:
    """A typed table as unified records: native projections only.

    Columns apply in sorted order of their source, the last that holds something wins; columns beat the
    modified-date field, that beats defaults, those beat the file's time.
    """
    used = set()
    values: dict[str, list[Column]] = {t: [] for t in TARGETS}
    for src in sorted(m.columns):
        values[m.columns[src]].insert(0, cleaned(F.col(src), m))
        used.add(src.split(".")[0])
    for f, t in ((m.source_created_date_field, "SourceCreatedDate"), (m.source_modified_date_field, "SourceModifiedDate")):
        if f:
            values[t].append(cleaned(F.col(f), m))
            used.add(f.split(".")[0])
    for t, v in m.defaults.items():
        values[t].append(F.lit(v))
    if m.data_source:
        values["DataSource"].append(F.lit(m.data_source))
    if modified is not None:
        values["SourceModifiedDate"].append(F.lit(modified))
    attrs = [(k, src) for src, k in m.attributes.items()]
    used |= {s.split(".")[0] for s in m.attributes}
    if m.include_unmapped:
        attrs += [(c, c) for c in df.columns if c not in used]
    pairs = F.array(*[F.struct(F.lit(k).alias("Key"), cleaned(F.col(s), m).alias("Value")) for k, s in attrs]) if attrs else F.array().cast("array<struct<Key:string,Value:string>>")
    return df.select(
        *[F.coalesce(*values[t], F.lit(None).cast("string")).alias(t) for t in TARGETS], F.lit(source_file).alias("SourceFile"),
        F.array_sort(F.filter(pairs, lambda x: x["Value"].isNotNull())).alias("Attributes"), F.lit(inserted).alias("BQInsertedDate"),
    )


def unify_record(o: dict, m: Mapping, modified: str | None) -> tuple[dict[str, str | None], list[tuple[str, str]], list[str]]:
    """(values, attributes, source fields not found) of one schemaless record."""
    nulls = {v.lower() for v in m.null_values}

    def text(v: object) -> str | None:
        s = J.scalar_text(v)
        s = s.strip() if s is not None and m.trim else s
        return None if s is None or s.lower() in nulls else s

    values: dict[str, str | None] = dict.fromkeys(TARGETS)
    values["SourceModifiedDate"] = modified
    if m.data_source:
        values["DataSource"] = m.data_source
    values |= m.defaults
    missing, used = [], set()
    dates = [(f, t) for f, t in ((m.source_created_date_field, "SourceCreatedDate"), (m.source_modified_date_field, "SourceModifiedDate")) if f]
    for src, target in [*dates, *sorted(m.columns.items())]:
        found, v, root = lookup(o, src)
        if not found:
            missing.append(src)
            continue
        used.add(root)
        if (s := text(v)) is not None:
            values[target] = s
    attributes = []
    for src, key in sorted(m.attributes.items()):
        found, v, root = lookup(o, src)
        if not found:
            missing.append(src)
            continue
        used.add(root)
        if (s := text(v)) is not None:
            attributes.append((key, s))
    if m.include_unmapped:
        attributes += [(k, s) for k in o if k not in used and (s := text(o[k])) is not None]
    return values, sorted(attributes), missing


def unify_records(records: DataFrame, m: Mapping, inserted: str) -> DataFrame:
    """Schemaless records (source_path, file_mtime, data) as unified records plus the ``missing`` source fields of each."""
    kinds = [*[pa.string()] * 10, pa.list_(pa.struct([("Key", pa.string()), ("Value", pa.string())])), pa.string(), pa.string(), pa.list_(pa.string())]
    names = [*TARGETS, "SourceFile", "Attributes", "BQInsertedDate", "source_path", "missing"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in names]
            for path, mtime, data in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                o = J.parse(data) if data else {}
                values, attributes, missing = unify_record(o if isinstance(o, dict) else {}, m, mtime)
                row = [*[values[t] for t in TARGETS], path.rsplit("/", 1)[-1], [{"Key": k, "Value": v} for k, v in attributes], inserted, path, missing]
                for c, x in zip(cols, row, strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    stamp = F.date_format("file_mtime", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return records.select("source_path", stamp, "data").mapInArrow(run, UNIFIED + ", source_path string, missing array<string>")


def unmatched_warnings(unified: DataFrame) -> DataFrame:
    """Distinct warnings per file about source fields that were not found."""
    return unified.select("source_path", F.explode("missing").alias("f")).distinct().select("source_path", F.concat(F.lit('source field "'), F.col("f"), F.lit('" was not found')).alias("warning"))
