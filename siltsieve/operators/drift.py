"""Schemas that drift between the files of a feed: a change log and one consistent table.

Method: each file has a schema fingerprint (paths, JSON types); a run of files of one fingerprint is a version, and
only files whose fingerprint differs from the one before are compared. A removed and an added path are one rename if linked members keep their values. Members are
linked by the key-like paths (mostly distinct in the file) whose values they share: each shared value is a
vote for a pair of rows, weighted by the path's distinctness, so no id name is assumed. The changes are stored as
the migration steps of their version (rename, cast, default, keep; see ``Drift.steps``): chaining the renames back to a
feed's first version gives each path its stable name, to which known mappings, their defaults and casts to the type of
the first version are applied; fields without a mapping stay under their stable name.

Defined edge cases: files without rows are no versions; an unparsable or non-object payload has no fields;
empty objects have no path; an array is one value; equal values compare as text apart from outer blanks,
letter case excepted, numbers without sign and leading zeros; a type is that of most non-null values and a
path that is null everywhere has none; ties of types go to the alphabetically first.
"""

from __future__ import annotations

import fnmatch
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltsieve.session import cut, dim_join, is_small

#: Share of members with both values that must agree for a rename.
RENAME_AGREEMENT = 0.75
MAX_MAPPINGS = 100_000
CELL_SCHEMA = "file_id bigint, row_id bigint, path string, json_type string, value string, head boolean"


def _flatten(o: dict, prefix: str, out: list[tuple[str, str, str | None]]) -> None:
    for k, v in o.items():
        if isinstance(v, dict):
            _flatten(v, f"{prefix}{k}.", out)
        elif v is None:
            out.append((prefix + k, "null", None))
        elif isinstance(v, bool):
            out.append((prefix + k, "boolean", "true" if v else "false"))
        elif isinstance(v, _Lexeme):
            out.append((prefix + k, "number", str(v)))
        elif isinstance(v, str):
            out.append((prefix + k, "string", v))
        else:
            out.append((prefix + k, "array", json.dumps(v, ensure_ascii=True)))


class _Lexeme(str):
    pass


def cells_of(rows: DataFrame) -> DataFrame:
    """One row per (row, dotted path): JSON type and text of the value; ``head`` marks the first of its row."""
    names = ["file_id", "row_id", "path", "json_type", "value", "head"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
    clean = lambda s: s if s is None else s.encode("utf-8", "replace").decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in names]
            for f, r, p in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    o = json.loads(p or "", parse_int=_Lexeme, parse_float=_Lexeme)
                except (ValueError, RecursionError):
                    continue
                if isinstance(o, dict):
                    flat: list = []
                    _flatten(o, "", flat)
                    for n, (path, kind, v) in enumerate(flat):
                        for c, x in zip(cols, (f, r, clean(path), kind, clean(v), n == 0), strict=True):
                            c.append(x)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return rows.select("file_id", "row_id", "payload").mapInArrow(run, CELL_SCHEMA)


def _comparable(c: str) -> F.Column:
    t = F.trim(F.col(c))
    return F.when(t.rlike(r"^[+]?[0-9]+(\.0+)?$"), F.regexp_replace(F.regexp_replace(t, r"\.0+$", ""), r"^[+]?0*(?=[0-9])", "")).otherwise(t)


class Drift:
    """The compared versions of all feeds; ``changes`` and ``names`` are the results, ``versions`` the fingerprints."""

    def __init__(self, rows: DataFrame, files: DataFrame) -> None:
        meta = files.select("file_id", "feed_id", "seq_no", "source_path", "file_format").dropDuplicates(["file_id"])
        self.rows = rows.select("file_id", "row_id")
        # once materialised, the cells feed every comparison; rows are not parsed again
        self.cells = cut(cells_of(rows).withColumn("cmp", _comparable("value")))
        typed = self.cells.groupBy("file_id", "path", "json_type").agg(F.count("*").alias("n"), F.count_if("head").alias("heads"))
        best = F.max(F.when(F.col("json_type") != "null", F.struct("n", F.col("json_type").alias("t"))))
        fields = typed.groupBy("file_id", "path").agg(best.alias("b"), F.sum("n").alias("filled"), F.sum("heads").alias("heads")).select("file_id", "path", F.col("b.t").alias("json_type"), "filled", "heads")
        self.fields = cut(fields)
        shape = F.array_sort(F.collect_list(F.concat_ws(":", "path", F.coalesce("json_type", F.lit("null")))))  # the paths of one file, a schema
        prints = self.fields.groupBy("file_id").agg(F.sha2(F.concat_ws("\n", shape), 256).alias("fingerprint"), F.sum("heads").alias("lines"))
        order = Window.partitionBy("feed_id").orderBy("seq_no", "file_id")
        seq = meta.join(prints, "file_id").withColumns({"prev_id": F.lag("file_id").over(order), "first_id": F.first("file_id").over(order), "__before": F.lag("fingerprint").over(order)})
        changed = F.coalesce(F.col("fingerprint") != F.col("__before"), F.lit(True))
        # a version is a run of files with one fingerprint
        self.files = cut(seq.withColumn("changed", changed).withColumn("version", F.sum(F.col("changed").cast("int")).over(order)).drop("__before"))
        self.versions = self.files
        self._compare()

    def _compare(self) -> None:
        # what is joined below has at most a row per field of a file: if those are few, no part of them is counted again
        few = is_small(self.fields)
        meet = lambda big, dim, keys, how: big.join(F.broadcast(dim), keys, how) if few else dim_join(big, dim, keys, how)
        # files of equal fingerprints have no change between them and are not compared
        pairs = self.files.filter("prev_id is not null and changed").select("file_id", "prev_id")
        cur = self.fields.join(pairs, "file_id").select("file_id", "prev_id", "path", F.col("json_type").alias("t1"))
        old = self.fields.select(F.col("file_id").alias("prev_id"), "path", F.col("json_type").alias("t0")).join(pairs, "prev_id").select("file_id", "prev_id", "path", "t0")
        both = cur.withColumn("in1", F.lit(True)).join(old.withColumn("in0", F.lit(True)), ["file_id", "prev_id", "path"], "full")
        kind = F.when(F.col("in0").isNull(), "added").when(F.col("in1").isNull(), "removed").when(F.col("t0") != F.col("t1"), "retyped")
        diff = cut(both.select("file_id", "prev_id", "path", kind.alias("change"), F.col("t0").alias("old_type"), F.col("t1").alias("new_type")).filter("change is not null"))
        # only files that lost and gained a path need links between their members
        todo = cut(diff.groupBy("file_id", "prev_id").agg(F.max(F.col("change") == "added").alias("a"), F.max(F.col("change") == "removed").alias("r")).filter("a and r").select("file_id", "prev_id"))
        need = todo.select("file_id").unionByName(todo.select(F.col("prev_id").alias("file_id"))).distinct()
        own = meet(self.cells.filter("value is not null"), cut(need), ["file_id"], "inner")
        # members of both files share values of key-like paths
        values = cut(own.filter("json_type <> 'array'").groupBy("file_id", "path", "cmp").agg(F.min("row_id").alias("row"), F.count("*").alias("n")))
        spread = values.groupBy("file_id", "path").agg(F.count("*").alias("values"), F.sum("n").alias("held")).join(self.files.select("file_id", "lines"), "file_id")
        keyish = cut(spread.filter((F.col("held") >= 0.3 * F.col("lines")) & (F.col("values") >= 0.5 * F.col("held"))).select("file_id", "path", (F.col("values") / F.col("held")).alias("w")))
        keys = meet(values, keyish, ["file_id", "path"], "inner")
        now = meet(keys, todo, ["file_id"], "inner").select("file_id", "prev_id", "cmp", F.col("row").alias("row1"), "w")
        before = keys.select(F.col("file_id").alias("prev_id"), "cmp", F.col("row").alias("row0"))
        # the same member shares most key values, two members of one name share few: pairs are elected by votes
        votes = cut(now.join(before, ["prev_id", "cmp"]).groupBy("file_id", "prev_id", "row0", "row1").agg(F.sum("w").alias("v")))
        most = votes.groupBy("file_id").agg(F.max("v").alias("most"))
        elected = Window.partitionBy("file_id", "row1").orderBy(F.desc("v"), "row0")
        links = meet(votes, most, ["file_id"], "inner").filter(F.col("v") * 2 >= F.col("most")).withColumn("r", F.row_number().over(elected)).filter("r = 1").select("file_id", "prev_id", "row0", "row1")
        gone = diff.filter("change = 'removed'").select(F.col("prev_id").alias("file_id"), "path")
        new = diff.filter("change = 'added'").select("file_id", "path")
        was = meet(own.select("file_id", "row_id", "path", "cmp"), gone, ["file_id", "path"], "inner").select(F.col("file_id").alias("prev_id"), F.col("row_id").alias("row0"), F.col("path").alias("p0"), F.col("cmp").alias("v0"))
        now1 = meet(own.select("file_id", "row_id", "path", "cmp"), new, ["file_id", "path"], "inner").select("file_id", F.col("row_id").alias("row1"), F.col("path").alias("p1"), F.col("cmp").alias("v1"))
        votes = links.join(was, ["prev_id", "row0"]).join(now1, ["file_id", "row1"]).groupBy("file_id", "p0", "p1").agg(F.count("*").alias("n"), F.sum((F.col("v0") == F.col("v1")).cast("int")).alias("same"))
        votes = votes.filter((F.col("same") > 0) & (F.col("same") >= RENAME_AGREEMENT * F.col("n")))
        rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.col("same") / F.col("n")), F.desc("same"), "p0", "p1"))
        renames = votes.withColumns({"r0": rank("file_id", "p0"), "r1": rank("file_id", "p1")}).filter("r0 = 1 and r1 = 1").select("file_id", "p0", "p1")
        self.renames = cut(renames)
        used0, used1 = self.renames.select("file_id", F.col("p0").alias("path")), self.renames.select("file_id", F.col("p1").alias("path"))
        log = self.renames.select("file_id", F.lit("renamed").alias("change_kind"), F.col("p0").alias("old_field"), F.col("p1").alias("new_field"))
        log = log.unionByName(diff.filter("change = 'added'").join(used1, ["file_id", "path"], "left_anti").select("file_id", F.lit("added").alias("change_kind"), F.lit("").alias("old_field"), F.col("path").alias("new_field")))
        log = log.unionByName(diff.filter("change = 'removed'").join(used0, ["file_id", "path"], "left_anti").select("file_id", F.lit("removed").alias("change_kind"), F.col("path").alias("old_field"), F.lit("").alias("new_field")))
        self._diff = diff
        self.changes = log.unionByName(diff.filter("change = 'retyped'").select("file_id", F.lit("retyped").alias("change_kind"), F.col("path").alias("old_field"), F.col("path").alias("new_field")))

    def steps(self) -> DataFrame:
        """The stored migration of every version: (feed_id, version, file_id, step_no, step, path, to), applied in order.

        Each version is led back to the one before it: ``rename`` gives a path its former name, ``cast`` its former type,
        ``default`` fills a path that is gone with null, ``keep`` takes a new path on. ``names`` composes the renames of a
        chain, ``contacts`` applies the casts to the type of the first version.
        """
        kept = lambda kind, col: self._diff.filter(F.col("change") == kind).join(self.renames.select("file_id", F.col(col).alias("path")), ["file_id", "path"], "left_anti")
        one = lambda d, step, path, to: d.select("file_id", F.lit(step).alias("step"), path.alias("path"), to.cast("string").alias("to"))
        p, none = F.col("path"), F.lit(None)
        d = one(self.renames, "rename", F.col("p1"), F.col("p0")).unionByName(one(self._diff.filter("change = 'retyped'"), "cast", p, F.col("old_type")))
        d = d.unionByName(one(kept("removed", "p0"), "default", p, none)).unionByName(one(kept("added", "p1"), "keep", p, none))
        rank = F.row_number().over(Window.partitionBy("file_id").orderBy(F.array_position(F.array(*map(F.lit, ("rename", "cast", "default", "keep"))), F.col("step")), "path"))
        return d.join(self.files.select("file_id", "feed_id", "version"), "file_id").select("feed_id", "version", "file_id", rank.alias("step_no"), "step", "path", "to")

    def names(self) -> DataFrame:
        """(file_id, path, stable) where stable is the path's name in its feed's first version that has it.

        Chains are followed by pointer jumping: the number of rounds is the logarithm of the longest chain.
        """
        node = self.fields.select("file_id", "path").join(self.files.select("file_id", "prev_id"), "file_id")
        node = node.join(self.renames.select("file_id", F.col("p1").alias("path"), "p0"), ["file_id", "path"], "left")
        node = node.withColumn("up_path", F.coalesce("p0", "path"))
        had = self.fields.select(F.col("file_id").alias("prev_id"), F.col("path").alias("up_path"), F.lit(True).alias("had"))
        node = node.join(had, ["prev_id", "up_path"], "left")
        at = cut(node.select("file_id", "path", F.when(F.col("had"), F.col("prev_id")).otherwise(F.col("file_id")).alias("to_file"), F.when(F.col("had"), F.col("up_path")).otherwise(F.col("path")).alias("to_path")))
        while True:
            nxt = at.select(F.col("file_id").alias("to_file"), F.col("path").alias("to_path"), F.col("to_file").alias("f2"), F.col("to_path").alias("p2"))
            jumped = cut(at.join(nxt, ["to_file", "to_path"]).select("file_id", "path", F.col("f2").alias("to_file"), F.col("p2").alias("to_path"), ((F.col("f2") != F.col("to_file")) | (F.col("p2") != F.col("to_path"))).alias("moved")))
            at = jumped.drop("moved")
            if not jumped.filter("moved").limit(1).count():
                return at.select("file_id", "path", "to_file", F.col("to_path").alias("stable"))

    def contacts(self, mappings: DataFrame, targets: list[str]) -> DataFrame:
        """One row per input row: the target fields as text, every other field in ``fields`` under its stable name.

        Unknown paths inherit the target of their rename chain. A value of another JSON type than its stable name is cast;
        values without a cast stand in ``cast_failures``. Of several paths with one name the first mapped that holds a
        value counts, differing values of the others stand in ``conflicts``. A ``default_value`` of the mappings fills
        targets a row has no value for. Rows without cells come out with their ids alone.
        """
        wanted = ["match_name", "file_format", "source_field", "target_field"]
        given = "default_value" in mappings.columns
        ordered = mappings.orderBy("mapping_id") if "mapping_id" in mappings.columns else mappings
        rules = ordered.select(*wanted, F.col("default_value") if given else F.lit(None).cast("string")).limit(MAX_MAPPINGS + 1).collect()
        if len(rules) > MAX_MAPPINGS:
            raise ValueError("too many mappings")
        known = default = F.lit(None)
        base = F.element_at(F.split("source_path", "/"), -1)
        named = self.fields.select("file_id", "path").join(self.files.select("file_id", "source_path", "file_format"), "file_id")
        for glob in sorted({(r[0], r[1]) for r in rules}, key=str):
            table = {r[2]: (r[3], n) for n, r in enumerate(rules) if (r[0], r[1]) == glob}
            ok = F.lower(base).rlike(fnmatch.translate(glob[0].lower())) & (F.lit(True) if glob[1] is None else F.col("file_format") == glob[1])
            made = F.create_map(*[x for k, (t, n) in table.items() for x in (F.lit(k), F.struct(F.lit(t).alias("target"), F.lit(n).alias("n")))])
            known = F.coalesce(known, F.when(ok, made[F.col("path")]))
            if fixed := {r[3]: r[4] for r in rules if (r[0], r[1]) == glob and r[4] is not None}:
                default = F.coalesce(default, F.when(ok, F.create_map(*[F.lit(x) for kv in fixed.items() for x in kv])))
        named = named.withColumn("known", known.cast("struct<target:string,n:int>")).select("file_id", "path", F.col("known.target").alias("target"), F.col("known.n").alias("n"))
        names = self.names().join(named, ["file_id", "path"]).join(self.fields.select("file_id", "path", "json_type"), ["file_id", "path"])
        born = self.files.select(F.col("file_id").alias("to_file"), F.col("seq_no").alias("born"))
        names = cut(names.join(born, "to_file").join(self.files.select("file_id", "seq_no"), "file_id"))
        chain = names.groupBy("to_file", "stable").agg(F.min("target").alias("inherited"), F.min_by("json_type", F.when(F.col("json_type").isNotNull(), F.col("seq_no"))).alias("wanted"))
        # a path that came back after its first owner was renamed is another field
        rank = F.row_number().over(Window.partitionBy("file_id", "stable").orderBy("born", "to_file"))
        second = names.withColumn("r", rank).filter("r > 1").select("to_file", "stable").distinct().withColumn("second", F.lit(True))
        resolved = names.join(chain, ["to_file", "stable"]).join(second, ["to_file", "stable"], "left")
        own = F.when(F.col("second"), F.concat_ws("@", "stable", F.col("born").cast("string"))).otherwise(F.col("stable"))
        target = F.coalesce("target", "inherited")
        target = F.when(target.isin(targets), target)
        resolved = resolved.select("file_id", "path", target.alias("target"), F.coalesce("n", F.lit(MAX_MAPPINGS)).alias("n"), own.alias("stable"), "wanted")
        wide = dim_join(self.cells.select("file_id", "row_id", "path", "json_type", "value"), resolved, ["file_id", "path"])
        wide = wide.groupBy("row_id").agg(F.collect_list(F.struct("n", "path", "target", "stable", "json_type", "wanted", "value")).alias("cells"))
        fill = self.files.select("file_id", default.cast("map<string,string>").alias("defaults")) if given else None
        rows = self.rows if fill is None else dim_join(self.rows, fill, ["file_id"])
        rows = (rows if fill is not None else rows.withColumn("defaults", F.lit(None).cast("map<string,string>"))).join(wide, "row_id", "left")
        columns = [t.lower() for t in targets]
        schema = f"file_id bigint, row_id bigint, {''.join(f'`{c}` string, ' for c in columns)}fields map<string,struct<json_type:string,value:string>>, cast_failures array<struct<name:string,path:string,json_type:string,wanted:string,value:string>>, conflicts array<struct<name:string,path:string,value:string>>"
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * len(columns), pa.map_(pa.string(), _struct("json_type", "value")), pa.list_(_struct("name", "path", "json_type", "wanted", "value")), pa.list_(_struct("name", "path", "value"))]
        heads = ["file_id", "row_id", *columns, "fields", "cast_failures", "conflicts"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out: list[list] = [[] for _ in kinds]
                for f, r, d, cells in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                    mapped, *rest = _assemble(cells or [])
                    mapped = dict(d or []) | {k: v for k, v in mapped.items() if v is not None}
                    for c, x in zip(out, (f, r, *[mapped.get(t) for t in targets], *rest), strict=True):
                        c.append(x)
                yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=heads)

        return rows.select("file_id", "row_id", "defaults", "cells").mapInArrow(run, schema)


def _struct(*names: str) -> pa.DataType:
    return pa.struct([(n, pa.string()) for n in names])


_NUMBER = re.compile(r"[+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")


def cast_text(value: str, actual: str, wanted: str | None) -> str | None:
    """The text of a value as the wanted JSON type; null if it has none."""
    if wanted in (None, actual, "string"):
        return value
    text = value.strip()
    if actual == "string" and wanted == "number" and _NUMBER.fullmatch(text):
        return text.removeprefix("+")
    if actual == "string" and wanted == "boolean" and text.lower() in ("true", "false"):
        return text.lower()
    return None


def _assemble(cells: list[dict]) -> tuple[dict, dict, list[dict], list[dict]]:
    """Targets, other fields, failed casts and conflicting values of one row."""
    mapped: dict = {}
    fields: dict = {}
    failed, conflicts = [], []
    order = lambda c: (c["value"] is None, MAX_MAPPINGS if c["n"] is None else c["n"], c["path"], c["value"] or "")
    for c in sorted(cells, key=order):
        target, name, value = c["target"], c["stable"] or c["path"], c["value"]
        if target is None and value is not None:
            value = cast_text(value, c["json_type"], c["wanted"])
            if value is None:
                failed.append({"name": name, "path": c["path"], "json_type": c["json_type"], "wanted": c["wanted"], "value": c["value"]})
        have = mapped if target is not None else fields
        key, new = (target, value) if target is not None else (name, {"json_type": c["wanted"] or c["json_type"], "value": value})
        old = have.setdefault(key, new)
        if value is not None and old != new:
            if (old if target is not None else old["value"]) is None:
                have[key] = new
            else:
                conflicts.append({"name": key, "path": c["path"], "value": c["value"]})
    return mapped, fields, failed, conflicts
