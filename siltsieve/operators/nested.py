"""Deeply nested records to related flat tables with parent links.

Method: shared inlining. The schema graph (which element occurs under which, how often, as what) is
collected over all records; singleton descendants are inlined as dotted columns of their nearest relation;
repeated, shared and recursive elements become relations of their own. Each row carries its number in its
relation (reading order, a node before its descendants) and foreign keys to its parent.

Defined edge cases: a null or unparsable document has no rows; nulls and scalars in a relation of objects
are no rows; an array, a single object, an object keyed by position and JSON text holding one of these are
four writings of the same repeated element; an object with no fields inside an array is a row with no values.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Distinct edges a schema graph may have; it is a schema, not data.
MAX_EDGES = 100_000
#: Share of common fields from which two nested elements are one type.
SAME_FIELDS = 0.6
NODE_SCHEMA = "record_no bigint, relation string, node_no int, parent_relation string, parent_no int, same_parent_no int, fields map<string,string>"


class _Num(str):
    """The lexeme of a JSON number."""


def _load(text: str | None) -> object:
    if text is None:
        return None
    try:
        return json.loads(text, parse_int=_Num, parse_float=_Num)
    except (ValueError, RecursionError):
        return None


def _scalar(v: object) -> str:
    s = v if isinstance(v, str) else "true" if v is True else "false" if v is False else json.dumps(v)
    return s.encode("utf-8", "replace").decode()


def entries(v: object, known: frozenset[str]) -> list[object] | None:
    """The entries of a repeated element in any of its writings; None if it is one plain scalar."""
    if isinstance(v, str) and not isinstance(v, _Num) and v.lstrip()[:1] in ("[", "{"):
        inner = _load(v)
        if isinstance(inner, (list, dict)):
            v = inner
    if v is None:
        return []
    if isinstance(v, list):
        flat: list[object] = []
        for x in v:
            flat.extend(entries(x, known) or []) if isinstance(x, list) else flat.append(x)
        return flat
    if isinstance(v, dict):
        positional = bool(v) and all(k.isdigit() for k in v)
        keyed = all(x is None or isinstance(x, dict) for x in v.values()) and (positional or (bool(known) and not (known & v.keys())))
        return list(v.values()) if keyed else [v]
    return None


def edges_of(o: object, parent: str, out: set[tuple[str, str, str]]) -> None:
    """(parent, child, kind) of each element; kind is scalar, object, array of objects or of scalars."""
    if isinstance(o, dict):
        for k, v in o.items():
            if isinstance(v, dict):
                positional = bool(v) and all(x.isdigit() for x in v)
                out.add((parent, k, "objects" if positional else "object"))
                for x in v.values() if positional else [v]:
                    edges_of(x, k, out)
            elif isinstance(v, list):
                if any(isinstance(x, dict) for x in v):
                    out.add((parent, k, "objects"))
                elif any(x is not None and not isinstance(x, list) for x in v):
                    out.add((parent, k, "scalars"))
                for x in v:
                    edges_of(x, k, out)
            elif v is not None:
                out.add((parent, k, "scalar"))


def schema_graph(docs: DataFrame, text: str) -> list[tuple[str, str, str]]:
    """Distinct edges over all documents; each task sends only its own distinct edges."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, str, str]] = set()
        for b in batches:
            for t in b.column(0).to_pylist():
                edges_of(_load(t), "", seen)
        rows = sorted(seen)
        yield pa.record_batch([pa.array([r[i].encode("utf-8", "replace").decode() for r in rows], pa.string()) for i in range(3)], names=["parent", "child", "kind"])

    edges = docs.select(text).mapInArrow(collect, "parent string, child string, kind string").distinct().limit(MAX_EDGES + 1).collect()
    if len(edges) > MAX_EDGES:
        raise ValueError("documents use data as field names; name the positional elements")
    return sorted(tuple(e) for e in edges)


@dataclass(frozen=True)
class Relation:
    """Where the entries of an element go: the relation's name, the fields its objects have, and whether it holds objects only."""

    name: str
    fields: frozenset[str]
    objects: bool


def decide_relations(edges: list[tuple[str, str, str]]) -> dict[str, Relation]:
    """Element -> relation for repeated, shared (several parents, as object) and recursive elements.

    Elements that reach each other's relation and have mostly the same fields are one type written under two names; they
    share a relation, named after the outermost of them.
    """
    parents: dict[str, set[str]] = {}
    below: dict[str, set[str]] = {}
    kinds: dict[str, set[str]] = {}
    for p, c, kind in edges:
        below.setdefault(p, set()).add(c)
        kinds.setdefault(c, set()).add(kind)
        if kind in ("object", "objects"):
            parents.setdefault(c, set()).add(p)

    def reaches(a: str, b: str) -> bool:
        todo, seen = [a], set()
        while todo:
            for x in below.get(todo.pop(), ()):
                if x == b:
                    return True
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return False

    chosen = sorted(c for c, k in kinds.items() if k & {"objects", "scalars"} or len(parents.get(c, ())) > 1 or (c in parents and reaches(c, c)))
    same: dict[str, str] = {}
    for a in chosen:
        for b in chosen:
            fa, fb = below.get(a, set()), below.get(b, set())
            if a != b and fa and fb and len(fa & fb) >= SAME_FIELDS * len(fa | fb) and reaches(a, b) and not (reaches(b, a) and b < a):
                same[b] = a
    out = {}
    for c in chosen:
        name, seen = c, {c}
        while name in same and same[name] not in seen:
            name = same[name]
            seen.add(name)
        alike = [x for x in chosen if x == c or same.get(x) == name or same.get(c) == x or x == name]
        out[c] = Relation(name, frozenset().union(*(below.get(x, set()) for x in alike)), bool(kinds[c] & {"object", "objects"}))
    return out


def inlined_paths(edges: list[tuple[str, str, str]], relations: dict[str, Relation], relation: str) -> list[str]:
    """Dotted paths of the scalars that a relation's rows hold."""
    paths: set[str] = set()

    def walk(element: str, prefix: str, seen: frozenset[str]) -> None:
        for p, c, kind in edges:
            if p != element or c in seen or c in relations:
                continue
            if kind == "scalar":
                paths.add(prefix + c)
            elif kind == "object":
                walk(c, f"{prefix}{c}.", seen | {c})

    for element in [""] if relation == "" else [c for c, r in relations.items() if r.name == relation]:
        walk(element, "", frozenset([element]))
    return sorted(paths)


def shred_document(doc: object, relations: dict[str, Relation]) -> list[tuple]:
    """Rows (relation, node_no, parent_relation, parent_no, same_parent_no, fields) in reading order; the root is relation ''."""
    counts: dict[str, int] = {}
    rows: list[tuple] = []

    def node(o: object, relation: str, parent: tuple[str, int], same: dict[str, int]) -> None:
        counts[relation] = no = counts.get(relation, 0) + 1
        fields: dict[str, str] = {}
        rows.append((relation, no, parent[0], parent[1], same.get(relation, 0), fields))
        if isinstance(o, dict):
            inline(o, "", fields, (relation, no), {**same, relation: no})
        else:
            fields["value"] = _scalar(o)

    def inline(o: dict, prefix: str, fields: dict[str, str], me: tuple[str, int], same: dict[str, int]) -> None:
        for k, v in o.items():
            r = relations.get(k)
            found = entries(v, r.fields) if r is not None else None
            if found is not None:
                for x in found:
                    if isinstance(x, dict) or (x is not None and not r.objects):
                        node(x, r.name, me, same)
            elif isinstance(v, dict):
                inline(v, prefix + k + ".", fields, me, same)
            elif v is not None:
                fields[prefix + k] = _scalar(v)

    if isinstance(doc, dict):
        node(doc, "", ("", 0), {})
    return rows


def shred(docs: DataFrame, record: str, text: str, relations: dict[str, Relation]) -> DataFrame:
    """All relations of all documents as one long table of nodes (NODE_SCHEMA); filter on ``relation`` for one table."""
    names = ["record_no", "relation", "node_no", "parent_relation", "parent_no", "same_parent_no", "fields"]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.map_(pa.string(), pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in names]
            for no, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for r in shred_document(_load(t), relations):
                    for c, x in zip(cols, (no, *r[:5], list(r[5].items())), strict=True):
                        c.append(x)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return docs.select(F.col(record).cast("bigint"), F.col(text)).mapInArrow(run, NODE_SCHEMA)


def relation_table(nodes: DataFrame, relation: str, columns: list[str]) -> DataFrame:
    """One relation as a flat table: record_no, node_no, its parent's relation and number, and its columns as text."""
    columns = columns or ["value"]  # entries that are plain values
    named = [F.col("fields")[c].alias(c.replace(".", "_")) for c in columns]
    return nodes.filter(F.col("relation") == relation).select("record_no", "node_no", "parent_relation", "parent_no", "same_parent_no", *named)


def inline_struct(df: DataFrame, sep: str = "_") -> DataFrame:
    """Inline singleton structs of any depth as columns named by their path; a clash gets a number appended."""
    out, used = [], set()

    def walk(field: T.StructField, path: list[str]) -> None:
        if isinstance(field.dataType, T.StructType):
            for f in field.dataType.fields:
                walk(f, [*path, f.name])
            return
        name = base = sep.join(path)
        k = 2
        while name.lower() in used:
            name, k = f"{base}{sep}{k}", k + 1
        used.add(name.lower())
        col = F.col("`" + path[0] + "`")
        for p in path[1:]:
            col = col.getField(p)
        out.append(col.alias(name))

    for f in df.schema.fields:
        walk(f, [f.name])
    return df.select(*out)
