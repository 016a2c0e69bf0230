"""Deletion rules: artefacts derived from search matches, on raw JSON records.

A rule names a target and an action. Matches are those of the row itself, so rules do not see other rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltsieve.functions import jsontext as J
from siltsieve.functions.paths import find, parse_path
from siltsieve.operators.search import Target

ACTIONS = ("delete_row", "delete_matches", "mark_for_deletion", "delete_sub_key")


@dataclass(frozen=True)
class Rule:
    search_target: str
    action: str
    output_path: str = ""
    sub_key_path: str = ""
    sub_key_values: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.action not in ACTIONS:
            raise ValueError(f"unknown action {self.action!r}")
        if self.action == "delete_sub_key" and not self.sub_key_path:
            raise ValueError("delete_sub_key needs sub_key_path")


def matches_of(o: dict, t: Target) -> list[tuple[str, str, str]]:
    """(path, value text, matched target value) of one record; a bag over the target's values."""
    spots: list[tuple[str, object]] = []
    if t.kind == "direct":
        spots = [(t.path, o[t.path])] if t.path in o else []
    elif t.kind == "nested_array":
        head, _, rest = t.path.partition("[*].")
        arr = o.get(head)
        if isinstance(arr, list):
            spots = [(f"{head}[{i}].{rest}", x[rest]) for i, x in enumerate(arr) if isinstance(x, dict) and rest in x]
    elif t.kind in ("nested_object", "jsonpath"):  # keys as they are written; * is any key of an object
        level: list[tuple[str, object]] = [("", o)]
        for key in t.path.split("."):
            level = [(f"{p}.{k}" if p else k, v[k]) for p, v in level if isinstance(v, dict) for k in (list(v) if key == "*" and t.kind == "jsonpath" else [key]) if k in v]
        spots = level
    else:
        spots = find(o, parse_path(t.path))
    texts = [(p, J.text_of(v)) for p, v in spots]
    return [(p, text, want) for p, text in texts for want in t.by_text.get(t.fold(text), ())]


def apply_rules(df: DataFrame, targets: list[Target], rules: list[Rule], raw: str = "raw") -> DataFrame:
    """df plus ``matches`` (array), ``new_raw`` (record after the rules) and ``actions`` (array of those that took effect).

    Search sees the record as read; key and row checks should use ``new_raw``. A row deleted by one rule is
    still judged by the next ones.
    """
    by = {t.name: t for t in targets}
    for r in rules:
        if r.search_target not in by:
            raise ValueError(f"rule names unknown target {r.search_target!r}")
    match_t = pa.list_(pa.struct([("target", pa.string()), ("path", pa.string()), ("value", pa.string()), ("matched_value", pa.string())]))
    act_t = pa.list_(pa.struct([("rule", pa.string()), ("action", pa.string()), ("matches", pa.int32()), ("record", pa.string())]))

    def one(line: str | None) -> tuple:
        try:
            o = J.parse(line or "")
        except ValueError:
            return [], line, [], True
        if not isinstance(o, dict):
            return [], line, [], True
        found = {n: matches_of(o, t) for n, t in by.items()}
        said = [{"target": n, "path": p, "value": v, "matched_value": w} for n, ms in found.items() for p, v, w in ms]
        acts, changed = [], False
        for r in rules:
            ms = found[r.search_target]
            if not ms:
                continue
            effect = True
            if r.action == "delete_matches":
                effect = any([J.delete_path(o, p.split(".")) for p, _, _ in ms])
                changed |= effect
            elif r.action == "mark_for_deletion":
                o |= {"_marked_for_deletion": True, "_deletion_reason": r.search_target, "_deletion_matches": J.Number(len(ms))}
                changed = True
            elif r.action == "delete_sub_key":
                effect = J.delete_sub_key(o, parse_path(r.sub_key_path), set(r.sub_key_values))
                changed |= effect
            if effect:
                acts.append({"rule": r.search_target, "action": r.action, "matches": len(ms), "record": J.dump(o)})
        return said, J.dump(o) if changed else line, acts, False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [one(x) for x in b.column(b.schema.get_field_index(raw)).to_pylist()]
            more = [pa.array([r[i] for r in rows], t) for i, t in enumerate((match_t, pa.string(), act_t, pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "matches", "new_raw", "actions", "malformed"])

    strings = lambda *n: [T.StructField(x, T.StringType()) for x in n]
    match = T.ArrayType(T.StructType(strings("target", "path", "value", "matched_value")))
    act = T.ArrayType(T.StructType([*strings("rule", "action"), T.StructField("matches", T.IntegerType()), *strings("record")]))
    schema = T.StructType([*df.schema.fields, T.StructField("matches", match), *strings("new_raw"), T.StructField("actions", act), T.StructField("malformed", T.BooleanType())])
    return df.mapInArrow(run, schema)


def rule_statistics(applied: DataFrame) -> DataFrame:
    """total, deleted and modified rows and errors, exact and in one pass."""
    has = lambda *a: F.exists("actions", lambda x: x["action"].isin(*a)).cast("bigint")
    return applied.agg(F.count("*").alias("total_rows"), F.sum(has("delete_row")).alias("deleted_rows"), F.sum(has("delete_matches", "mark_for_deletion", "delete_sub_key")).alias("modified_rows"), F.sum(F.size("matches")).cast("bigint").alias("matches"), F.sum(F.col("malformed").cast("bigint")).alias("errors"))


def batch_report(applied: DataFrame, by: str = "source_path") -> DataFrame:
    """The statistics of a deletion run for each input of a batch."""
    has = lambda *a: F.exists("actions", lambda x: x["action"].isin(*a)).cast("bigint")
    return applied.groupBy(by).agg(F.count("*").alias("total_rows"), F.sum(has("delete_row")).alias("deleted_rows"), F.sum(has("delete_matches", "mark_for_deletion", "delete_sub_key")).alias("modified_rows"), F.sum(F.size("matches")).cast("bigint").alias("matches"), F.sum(F.col("malformed").cast("bigint")).alias("errors"))


def rule_output(applied: DataFrame, rule: str, action: str) -> DataFrame:
    """The derived artefact of one rule: every record it acted on."""
    return applied.select("*", F.explode("actions").alias("a")).filter((F.col("a.rule") == rule) & (F.col("a.action") == action)).select(*[c for c in ("source_path", "line_number") if c in applied.columns], "a.action", "a.rule", "a.record", "matches")
