"""Row deletion, array item deletion and guarded value updates on tables, and the same on raw JSON lines.

Typed tables use native expressions and anti joins. Raw lines use one Arrow function that leaves untouched
lines byte for byte as they were.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltsieve.functions import jsontext as J
from siltsieve.session import BROADCAST_ROWS


@dataclass(frozen=True)
class Rewrite:
    """One rewrite job; empty keys switch a step off."""

    top_level_key: str = ""
    top_level_values: frozenset[str] = frozenset()
    array_key: str = ""
    array_delete_key: str = ""
    array_delete_values: frozenset[str] = frozenset()
    state_key: str = ""
    state_value: str = ""
    update_key: str = ""
    update_old_value: str = ""
    update_new_value: str = ""
    update_id_key: str = ""
    update_id_values: frozenset[str] = field(default_factory=frozenset)
    update_state_key: str = ""
    update_state_value: str = ""

    def __post_init__(self) -> None:
        pairs = [("top_level_key", "top_level_values"), ("array_delete_key", "array_delete_values"), ("state_key", "state_value"), ("update_id_key", "update_id_values"), ("update_state_key", "update_state_value")]
        for a, b in pairs:
            if bool(getattr(self, a)) != bool(getattr(self, b)):
                raise ValueError(f"{a} and {b} go together")
        if self.array_delete_key and not self.array_key:
            raise ValueError("array_delete_key needs array_key")
        if not (self.top_level_key or self.array_delete_key or self.update_key):
            raise ValueError("nothing to do: give a deletion or an update")


def apply_to(o: dict, job: Rewrite) -> tuple[bool, bool, bool]:
    """(deleted, modified, updated) of one record, changed in place; a deleted record is not looked at further."""
    if J.matches(o, job.top_level_key, job.top_level_values, job.state_key, job.state_value):
        return True, False, False
    modified = bool(job.array_key and job.array_delete_key) and J.delete_items(o, job.array_key, job.array_delete_key, job.array_delete_values, job.state_key, job.state_value)
    wanted = bool(job.update_key)
    if wanted and job.update_id_key:
        wanted = job.update_id_key in o and J.text_of(o[job.update_id_key]) in job.update_id_values
    if wanted and job.update_state_key:
        wanted = job.update_state_key in o and J.text_of(o[job.update_state_key]) == job.update_state_value
    return False, modified, wanted and J.update_values(o, job.update_key, job.update_old_value, job.update_new_value)


def rewrite_lines(df: DataFrame, job: Rewrite, raw: str = "raw") -> DataFrame:
    """df plus new_raw, deleted, modified, updated, malformed. Malformed lines stay as they are and are counted."""
    extra = [("new_raw", pa.string()), ("deleted", pa.bool_()), ("modified", pa.bool_()), ("updated", pa.bool_()), ("malformed", pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(raw)
            cols: list[list] = [[] for _ in extra]
            for line in b.column(at).to_pylist():
                row = (line, False, False, False, False)
                if line:
                    try:
                        o = J.parse(line)
                        if not isinstance(o, dict):
                            raise ValueError
                        deleted, modified, updated = apply_to(o, job)
                        row = (None if deleted else J.dump(o) if modified or updated else line, deleted, modified, updated, False)
                    except ValueError:
                        row = (line, False, False, False, True)
                for c, x in zip(cols, row, strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c, t) for c, (_, t) in zip(cols, extra, strict=True)]], names=[*b.schema.names, *[n for n, _ in extra]])

    flags = [T.StructField(n, T.StringType() if n == "new_raw" else T.BooleanType()) for n, _ in extra]
    schema = T.StructType([*df.schema.fields, *flags])
    return df.mapInArrow(run, schema)


def counters(rewritten: DataFrame, file: str = "source_path") -> DataFrame:
    n = lambda c: F.sum(F.col(c).cast("bigint")).alias
    return rewritten.groupBy(file).agg(F.count("*").alias("lines_read"), n("deleted")("lines_deleted"), n("modified")("lines_modified"), n("updated")("lines_updated"), n("malformed")("errors"))


def matches_list(df: DataFrame, key: str, values: DataFrame, state: Column | None = None, keep: bool = True) -> DataFrame:
    """Rows kept (or, with keep=False, removed) by a list of key values and an optional state.

    The list is a one-column table: counted, broadcast when small, shuffled otherwise.
    """
    v = values.select(F.col(values.columns[0]).cast("string").alias("__value")).filter("__value is not null").distinct()
    if v.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        v = F.broadcast(v)
    cond = F.col(key).cast("string") == F.col("__value")
    if state is not None:
        cond = cond & F.coalesce(state, F.lit(False))
    return df.join(v, cond, "left_anti" if keep else "left_semi")


def drop_items(array: str, key: str, values: list[str], state: tuple[str, str] | None = None) -> Column:
    """The array of structs without the items whose key is in values and whose state, if given, is as said."""
    def keep(x: Column) -> Column:
        hit = F.coalesce(x.getField(key).cast("string").isin(values), F.lit(False))
        if state:
            hit = hit & F.coalesce(x.getField(state[0]).cast("string") == state[1], F.lit(False))
        return ~hit

    return F.filter(array, keep)


def guarded_update(column: str, old: str, new: str, *guards: Column) -> Column:
    hit = F.col(column).cast("string") == old
    for g in guards:
        hit = hit & F.coalesce(g, F.lit(False))
    return F.when(hit, F.lit(new)).otherwise(F.col(column))
