"""The three commands over files: analysis, ingest and rewrite, and the purge of duplicates."""

from __future__ import annotations

import datetime
import functools
import itertools
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltsieve import report as reporting
from siltsieve.functions import jsontext as J
from siltsieve.operators import ingest, profile, purge
from siltsieve.operators import rules as R
from siltsieve.operators.rewrite import Rewrite, apply_to, counters, rewrite_lines
from siltsieve.session import cut
from siltsieve.sinks import writers as W
from siltsieve.sources import xmlio
from siltsieve.sources.discovery import JSON_FORMATS, REWRITE_FORMATS, Source, discover
from siltsieve.sources.records import read_lines, read_records


def run_analysis(spark: SparkSession, paths: str, job: reporting.Analysis, xml_path: str = "", json_mode: str = "lines", tables: dict | None = None) -> dict:
    sources = discover(paths, spark=spark)
    return reporting.analyse(read_records(spark, sources, json_mode=json_mode, xml_path=xml_path), sources, job, tables)


def write_tables(tables: dict, folder: str) -> list[str]:
    """Every match and duplicate member as a folder of JSON lines; members of one key or row stand together."""
    out = []
    for name, (df, n) in tables.items():
        if n:
            column = df.columns[0]
            path = W.contained(folder, name)
            if name == "search_matches":
                W.write_table(df, path, "jsonl", ("target",))
            else:
                W.write_table(df.repartitionByRange(column).sortWithinPartitions(column, "source_path", "line_number"), path, "jsonl")
            out.append(path)
    return out


def schema_report(spark: SparkSession, paths: str, fraction: float = 0.1, max_samples: int = 100_000, max_depth: int = 10, by_folder: bool = False, xml_path: str = "", seed: int = 17) -> DataFrame:
    """Field profile of a seeded sample of the records, of all together (folder null) and, if wanted, by folder."""
    rows = read_records(spark, paths, xml_path=xml_path).filter("data is not null").select("folder", "data")
    some = profile.sampled(rows, fraction, seed, max_samples)
    some = some if fraction >= 1 and not max_samples else cut(some)
    rate = profile.sample_rate(some, rows).select("sample_rate")
    return profile.profile_json(some, "data", ["folder"] if by_folder else [], max_depth, overall=True).join(F.broadcast(rate))


SCHEMA_COLUMNS = ["path", "type", "element_type", "occurrences", "percentage", "nullable", "unique_values", "min_length", "max_length", "examples", "sample_rate"]


def write_rule_outputs(spark: SparkSession, paths: str, job: reporting.Analysis, xml_path: str = "") -> dict[str, str]:
    """The derived artefact of each rule that names an output, as a folder of JSON lines; rule -> folder."""
    wanted = [r for r in job.rules if r.output_path]
    if not wanted:
        return {}
    applied = R.apply_rules(read_records(spark, paths, xml_path=xml_path).filter("data is not null"), job.targets, job.rules, "data")
    for r in wanted:
        W.write_table(R.rule_output(applied, r.search_target, r.action), r.output_path, "jsonl")
    return {r.search_target: r.output_path for r in wanted}


def write_artifacts(report: dict, folder: str, schema: list[dict] | None = None, formats: tuple[str, ...] = ("json",), tables: dict | None = None) -> list[str]:
    """Search results (whole, per target and as CSV), deletion statistics and the schema report as files.

    Search results are streamed from the ``tables`` of the analysis; without them only the report's preview is known.
    """
    out: list[str] = []

    def put(name: str, write) -> None:
        path = W.contained(folder, name)
        write(path)
        out.append(path)

    if (s := report.get("searchResults")) is not None:
        names = sorted(t for t, n in s["matchesByTarget"].items() if n)
        full = (tables or {}).get("search_matches")

        def of(t: str) -> Iterator[dict]:
            if full is None:
                return iter(s["results"].get(t, []))
            rows = full[0].filter(F.col("target") == t).orderBy("source_path", "line_number", "path")
            return map(reporting.match_entry, rows.toLocalIterator())

        put("search_results.json", lambda p: W.write_json_lists({k: v for k, v in s.items() if k != "results"}, ((t, of(t)) for t in names), p))
        for t in names:
            safe = "".join(c if c.isalnum() or c in "-_" else "_" for c in t)
            put(f"search_target_{safe}.json", lambda p, t=t: W.write_json_list(of(t), p))
        put("search_results.txt", lambda p: W.write_lines((f"{t}: {m['Path']} = {m['MatchedValue']} at {m['Location']['filePath']}:{m['Location']['lineNumber']}" for t in names for m in of(t)), p))
        rows = ((t, m["Path"], m["MatchedValue"], m["Location"]["filePath"], m["Location"]["lineNumber"]) for t in names for m in of(t))
        put("search_results.csv", lambda p: W.write_rows_csv(["target", "path", "matched_value", "file_path", "line_number"], rows, p))
    if (d := report.get("deletionStats")) is not None:
        put("deletion_stats.json", lambda p: W.write_json(d, p))
        put("deletion_stats.csv", lambda p: W.write_rows_csv(["metric", "value"], [x for k, v in d.items() for x in ([(f"{k}.{t}", n) for t, n in v.items()] if isinstance(v, dict) else [(k, v)])], p))
        put("deletion_summary.txt", lambda p: W.write_text("".join(f"{k}: {v}\n" for k, v in d.items()), p))
    if schema is not None:
        scope = lambda r: r.get("folder") or "global"
        ordered = sorted(schema, key=lambda r: (scope(r), r["path"]))
        if "json" in formats:
            put("schema_report.json", lambda p: W.write_json(ordered, p))
        if "csv" in formats:
            cells = lambda r: ["; ".join(v) if isinstance(v := r.get(c), list) else v for c in SCHEMA_COLUMNS]
            put("schema_report.csv", lambda p: W.write_rows_csv(["scope", *SCHEMA_COLUMNS], [[scope(r), *cells(r)] for r in ordered], p))
            put("schema_paths.csv", lambda p: W.write_rows_csv(SCHEMA_COLUMNS, [[f"{scope(r)}:{r['path']}", *cells(r)[1:]] for r in ordered], p))
        if "yaml" in formats:
            put("schema_report.yaml", lambda p: W.write_text(W.to_yaml(ordered), p))
    return out


def run_ingest(spark: SparkSession, paths: str, mappings: list[ingest.Mapping], output: str, stats_output: str = "", require_mappings: bool = False) -> dict:
    """Every file by its first fitting mapping into one output; files without mapping are skipped or refused.

    An output with an extension is one file, streamed through the driver; one without is a folder of part files.
    """
    sources = discover(paths, spark=spark)
    now = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    stats: dict[str, dict] = {s.path: {"path": s.path, "format": s.format, "rowsRead": 0, "rowsWritten": 0, "status": "success", "warnings": [], "errorMessage": ""} for s in sources}
    groups: dict[int, list[Source]] = {}
    for s in sources:
        m = ingest.resolve(mappings, os.path.basename(s.path), s.format)
        if m is None:
            stats[s.path] |= {"status": "failed", "errorMessage": "no mapping"} if require_mappings else {"status": "skipped", "warnings": ["no mapping matched"]}
        else:
            groups.setdefault(mappings.index(m), []).append(s)
    parts = []
    for i, own in groups.items():  # one plan per mapping, not per file
        m = mappings[i]
        rec = cut(read_records(spark, own, json_mode="document", xml_path=m.xml_record_path, sheet=m.sheet))
        bad = {r["source_path"]: r["e"] for r in rec.filter("decode_error is not null").groupBy("source_path").agg(F.min("decode_error").alias("e")).collect()}
        for r in rec.groupBy("source_path").agg(F.count("*").alias("n")).collect():
            stats[r["source_path"]]["rowsRead"] = r["n"]
        for p, e in bad.items():  # a file is written whole or not at all
            stats[p] |= {"status": "failed", "errorMessage": e}
        good = rec.filter(~F.col("source_path").isin(list(bad))) if bad else rec
        parts.append(ingest.unify_records(good, m, now))
    written = 0
    if parts:
        every = cut(functools.reduce(DataFrame.unionByName, parts))
        for r in every.groupBy("source_path").agg(F.count("*").alias("n")).collect():
            stats[r["source_path"]]["rowsWritten"] = r["n"]
        for r in ingest.unmatched_warnings(every).collect():
            stats[r["source_path"]]["warnings"].append(r["warning"])
        rows = every.drop("source_path", "missing")
        if os.path.splitext(output)[1]:
            written = W.write_unified(rows, output)
        else:  # a folder of part files, written by the executors
            W.write_table(rows, output, "jsonl")
            written = sum(s["rowsWritten"] for s in stats.values())
    files = sorted(stats.values(), key=lambda x: x["path"])
    summary = {"filesDiscovered": len(sources), "filesProcessed": sum(f["status"] != "skipped" for f in files), "rowsWritten": written, "outputPath": output, "files": files}
    if stats_output:
        W.write_json(summary, stats_output)
    return summary


def _rewrite_json(path: str, job: Rewrite, apply: bool, backup_dir: str, stamp: str) -> dict:
    """One line file, streamed: memory does not grow with the file. A repeated attempt starts from the run's backup."""
    source = W.backup_path(path, backup_dir, stamp) if apply else path
    source = source if os.path.exists(source) else path
    c = {"source_path": path, "lines_read": 0, "lines_deleted": 0, "lines_modified": 0, "lines_updated": 0, "errors": 0}

    def lines() -> Iterator[str]:
        with open(source, encoding="utf-8", newline="") as f:
            for line in f:
                line = line.rstrip("\r\n")
                if not line.strip():
                    continue
                c["lines_read"] += 1
                try:
                    o = J.parse(line)
                    if not isinstance(o, dict):
                        raise ValueError
                    deleted, modified, updated = apply_to(o, job)
                except ValueError:
                    c["errors"] += 1
                    yield line
                    continue
                c["lines_deleted"] += deleted
                c["lines_modified"] += modified
                c["lines_updated"] += updated
                if not deleted:
                    yield J.dump(o) if modified or updated else line

    changed = lambda: c["lines_deleted"] + c["lines_modified"] + c["lines_updated"] > 0
    if not apply:
        for _ in lines():
            pass
        return c
    try:
        with W.staged(path) as out:
            for line in lines():
                out.write(line + "\n")
            if not changed():
                raise _Unchanged
            W.backup(path, backup_dir, stamp)
    except _Unchanged:
        pass
    return c


class _Unchanged(Exception):
    pass


def _rewrite_xml(path: str, job: Rewrite, apply: bool, backup_dir: str, stamp: str, record_path: str) -> dict:
    source = W.backup_path(path, backup_dir, stamp) if apply else path
    with open(source if os.path.exists(source) else path, encoding="utf-8-sig") as f:
        root = xmlio.parse(f.read())
    c = {"source_path": path, "lines_read": 0, "lines_deleted": 0, "lines_modified": 0, "lines_updated": 0, "errors": 0}
    for e, parent in reversed(xmlio.records(root, record_path)):
        c["lines_read"] += 1
        v = xmlio.normalise(e)
        if not isinstance(v, dict):
            continue
        deleted, modified, updated = apply_to(v, job)
        c["lines_deleted"] += deleted
        c["lines_modified"] += modified
        c["lines_updated"] += updated
        if deleted:
            xmlio.remove(root, e, parent)
        elif modified or updated:
            xmlio.replace(e, v)
    if apply and c["lines_deleted"] + c["lines_modified"] + c["lines_updated"]:
        W.backup(path, backup_dir, stamp)
        W.write_text(xmlio.serialise(root), path)
    return c


def run_rewrite(spark: SparkSession, paths: str, job: Rewrite, mode: str = "preview", backup_dir: str = "", xml_path: str = "") -> dict:
    """Preview counts only; apply writes the files that change, each after a backup, one file per task."""
    if mode not in ("preview", "apply"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "apply" and not backup_dir:
        raise ValueError("apply needs a backup folder")
    sources = discover(paths, REWRITE_FORMATS, spark)
    if any(s.format == "xml" for s in sources) and not xml_path:
        raise ValueError("XML files need a record path")
    if mode == "preview" and all(s.format in JSON_FORMATS for s in sources):
        rows = [r.asDict() for r in counters(rewrite_lines(read_lines(spark, [s.path for s in sources]), job)).collect()]
    else:
        stamp = W.run_stamp()

        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                out = [_rewrite_xml(p, job, mode == "apply", backup_dir, stamp, xml_path) if p.lower().endswith(".xml") else _rewrite_json(p, job, mode == "apply", backup_dir, stamp) for p in pdf["path"]]
                yield pd.DataFrame(out)

        schema = "source_path string, lines_read bigint, lines_deleted bigint, lines_modified bigint, lines_updated bigint, errors bigint"
        files = spark.createDataFrame([(s.path,) for s in sources], "path string").repartition(min(len(sources), 1000), "path")
        rows = [r.asDict() for r in files.mapInPandas(work, schema).collect()]
    total = {k: sum(r[k] or 0 for r in rows) for k in ("lines_read", "lines_deleted", "lines_modified", "lines_updated", "errors")}
    return {"mode": mode, "files_discovered": len(sources), "files_modified": sum((r["lines_deleted"] or 0) + (r["lines_modified"] or 0) + (r["lines_updated"] or 0) > 0 for r in rows), **total, "files": sorted(rows, key=lambda r: r["source_path"])}


def run_purge(spark: SparkSession, paths: str, key: str, by: str = "id", keep: str = "first", purged_dir: str = "purged", backup_dir: str = "backups") -> dict:
    """Remove the surplus rows of duplicate ids or rows from local line files, keeping the removed rows."""
    sources = discover(paths, JSON_FORMATS, spark)
    rec = read_records(spark, sources).filter("data is not null")
    f = reporting._facts(key, "full_row", [], [])("data")
    rows = rec.select("source_path", "line_number", f.alias("f")).select("source_path", "line_number", F.col("f.key" if by == "id" else "f.row").alias("k"))
    doomed = purge.surplus(rows, "k", keep).repartition("source_path").sortWithinPartitions("source_path", "line_number")
    stamp, reason = W.run_stamp(), "id_purged" if by == "id" else "row_purged"

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lines = ((p, n) for pdf in frames for p, n in zip(pdf["source_path"], pdf["line_number"], strict=True))
        for path, own in itertools.groupby(lines, key=lambda x: x[0]):
            yield pd.DataFrame([(path, _purge_file(path, (n for _, n in own), purged_dir, backup_dir, stamp, reason, key))], columns=["source_path", "removed"])

    # a file is rewritten by one task; its lines to remove arrive in order and are never held together
    done = doomed.mapInPandas(work, "source_path string, removed bigint").agg(F.coalesce(F.sum("removed"), F.lit(0)).alias("n")).first()
    return {"rowsRemoved": done["n"]}


def _purge_file(path: str, doomed: Iterator[int], purged_dir: str, backup_dir: str, stamp: str, reason: str, key: str) -> int:
    """Rewrite one line file without the lines ``doomed`` (ascending); a repeated attempt starts from the run's backup."""
    source = W.backup(path, backup_dir, stamp)
    with W.staged(path) as out:

        def gone() -> Iterator[dict]:
            wanted = next(doomed, None)
            with open(source, encoding="utf-8", newline="") as src:
                for n, line in enumerate(src, 1):
                    if n == wanted:
                        yield {"row": _plain(line), "line": n}
                        wanted = next(doomed, None)
                    elif line.strip():
                        out.write(line if line.endswith("\n") else line + "\n")

        return W.store_purged(gone(), path, purged_dir, reason, {"key": key})[1]


def _plain(line: str) -> object:
    import json

    return json.loads(line)
