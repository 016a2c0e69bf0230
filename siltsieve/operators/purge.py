"""Purges: surplus members of duplicate groups by location, rows by id, items of nested arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltsieve.functions import jsontext as J


def surplus(rows: DataFrame, key: str, keep: str = "first") -> DataFrame:
    """(source_path, line_number) of all but one row of each duplicate group; the policy names the one kept.

    The location kept is found by a mergeable aggregate, so a group of any size is never gathered.
    """
    loc = F.struct("source_path", "line_number")
    agg = {"first": F.min, "last": F.max}[keep]
    g = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), agg(loc).alias("kept")).filter("n > 1").select(key, "kept")
    return rows.join(g, key).filter(loc != F.col("kept")).select("source_path", "line_number")


def without(rows: DataFrame, locations: DataFrame) -> DataFrame:
    return rows.join(locations, ["source_path", "line_number"], "left_anti")


@dataclass(frozen=True)
class Purge:
    """``id_purge``: rows whose value at ``path`` is listed. ``array_purge``: items of the array at ``path`` whose ``item_path`` is."""

    kind: str
    path: str
    values: frozenset[str]
    item_path: str = ""

    def __post_init__(self) -> None:
        if self.kind not in ("id_purge", "array_purge"):
            raise ValueError(f"unknown purge {self.kind!r}")
        if self.kind == "array_purge" and not self.item_path:
            raise ValueError("array_purge needs item_path")


def _at(o: object, path: str) -> tuple[bool, object]:
    for k in path.split("."):
        if not isinstance(o, dict) or k not in o:
            return False, None
        o = o[k]
    return True, o


def purge_record(o: dict, p: Purge) -> tuple[bool, int]:
    """(row deleted, items removed)."""
    found, v = _at(o, p.path)
    if p.kind == "id_purge":
        return found and J.text_of(v) in p.values, 0
    if not isinstance(v, list):
        return False, 0

    def hit(x: object) -> bool:
        ok, t = _at(x, p.item_path)
        return ok and J.text_of(t) in p.values

    kept = [x for x in v if not hit(x)]
    n = len(v) - len(kept)
    v[:] = kept
    return False, n


def purge_lines(df: DataFrame, purges: list[Purge], raw: str = "raw") -> DataFrame:
    """df plus new_raw, deleted, items_removed and malformed, after all purges of a batch."""

    def one(line: str | None) -> tuple:
        try:
            o = J.parse(line or "")
        except ValueError:
            return line, False, 0, True
        if not isinstance(o, dict):
            return line, False, 0, True
        removed = 0
        for p in purges:
            gone, n = purge_record(o, p)
            removed += n
            if gone:
                return None, True, removed, False
        return J.dump(o) if removed else line, False, removed, False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [one(x) for x in b.column(b.schema.get_field_index(raw)).to_pylist()]
            more = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.bool_(), pa.int32(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "new_raw", "deleted", "items_removed", "malformed"])

    extra = [T.StructField("new_raw", T.StringType()), T.StructField("deleted", T.BooleanType()), T.StructField("items_removed", T.IntegerType()), T.StructField("malformed", T.BooleanType())]
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *extra]))


def number_duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Rows of duplicate groups with their rank in the group, for a selection policy of the caller."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("source_path", "line_number")))
