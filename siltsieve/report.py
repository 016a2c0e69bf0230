"""The analysis report: a few aggregates put together, as JSON or text."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltsieve.functions import jsontext as J
from siltsieve.operators import rules as R
from siltsieve.operators.dedupe import row_hash
from siltsieve.operators.search import Target
from siltsieve.session import cut

#: Locations a report lists as a preview; counts, and the tables and artefacts beside it, are always complete.
MAX_GROUPS = 100_000


def human_size(n: int) -> str:
    x = float(n)
    for unit in ("B", "KiB", "MiB", "GiB", "TiB"):
        if x < 1024 or unit == "TiB":
            return f"{n} B" if unit == "B" else f"{x:.1f} {unit}"
        x /= 1024
    return str(n)


@dataclass
class Analysis:
    key: str = "id"
    check_key: bool = True
    check_row: bool = True
    validate_only: bool = False
    hashing: str = "full_row"
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    #: sha256, md5 or fnv; ``normalise`` compares texts in lower case with blanks collapsed
    algorithm: str = "sha256"
    normalise: bool = False
    targets: list[Target] = field(default_factory=list)
    rules: list[R.Rule] = field(default_factory=list)


def _facts(key: str, hashing: str, include: list[str], exclude: list[str], normalise: bool = False):
    """Key text (null if absent) and canonical row of a record's JSON."""

    def one(data: str | None) -> tuple[str | None, str | None]:
        if data is None:
            return None, None
        o = J.parse(data)
        k = J.text_of(o[key]) if key in o else None
        if hashing == "selective":
            o = {x: o[x] for x in include if x in o}
        elif hashing == "exclude_keys":
            o = {x: v for x, v in o.items() if x not in exclude}
        return k, J.dump(J.normalise_semantic(o) if normalise else o, sort=True)

    @F.pandas_udf(T.StructType([T.StructField("key", T.StringType()), T.StructField("row", T.StringType())]))
    def udf(s):
        import pandas as pd

        return pd.DataFrame([one(x) for x in s], columns=["key", "row"])

    return udf


def match_entry(r: Row) -> dict:
    return {"Found": True, "Path": r["path"], "Value": r["value"], "MatchedValue": r["matched_value"], "Target": r["target"], "Location": {"filePath": r["source_path"], "lineNumber": r["line_number"]}}


def analyse(records: DataFrame, sources: list, job: Analysis, tables: dict[str, tuple[DataFrame, int]] | None = None) -> dict:
    """The report of a canonical record table.

    The report lists at most MAX_GROUPS locations of a kind; ``tables`` receives them all with their numbers, as
    ``search_matches``, ``duplicate_ids`` and ``duplicate_rows``.
    """
    tables = {} if tables is None else tables
    began = time.time()
    ok = records.filter("data is not null")
    search = deletion = None
    if job.targets:
        applied = cut(R.apply_rules(ok, job.targets, job.rules, "data"))
        m = applied.select("source_path", "line_number", F.explode("matches").alias("m")).select("source_path", "line_number", *[F.col(f"m.{c}").alias(c) for c in ("target", "path", "value", "matched_value")])
        by = {r["target"]: r["n"] for r in m.groupBy("target").agg(F.count("*").alias("n")).collect()}
        tables["search_matches"] = m, sum(by.values())
        found = m.orderBy("source_path", "line_number", "path").limit(MAX_GROUPS).collect()
        search = {"totalMatches": sum(by.values()), "matchesByTarget": {t.name: by.get(t.name, 0) for t in job.targets}, "results": {}}
        for r in found:
            search["results"].setdefault(r["target"], []).append(match_entry(r))
        if job.rules:
            s = R.rule_statistics(applied).first()
            deletion = {"totalRows": s["total_rows"], "processedRows": s["total_rows"], "deletedRows": s["deleted_rows"] or 0, "modifiedRows": s["modified_rows"] or 0, "matchesByTarget": search["matchesByTarget"], "errors": s["errors"] or 0}
        ok = applied.withColumn("data", F.col("new_raw"))
    f = _facts(job.key, job.hashing, job.include, job.exclude, job.normalise)("data")
    rows = cut(ok.select("source_path", "folder", "file_size", "line_number", f.alias("f")).select("source_path", "folder", "file_size", "line_number", F.col("f.key").alias("key"), F.when(F.lit(job.check_row and not job.validate_only), row_hash(F.col("f.row"), job.algorithm)).alias("hash")))
    folders = rows.groupBy("folder").agg(F.count("*").alias("rows"), F.count("key").alias("keys"), F.count_distinct("source_path").alias("files")).collect()
    per = {r["folder"]: r for r in folders}

    def duplicates(column: str) -> tuple[dict, dict, int, int]:
        n = rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).filter("n > 1")
        members = cut(rows.join(n, column).select(column, "folder", "source_path", "line_number"))
        by_folder = {r["folder"]: r["n"] for r in members.groupBy("folder").agg(F.count("*").alias("n")).collect()}
        groups, instances = n.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        tables[{"key": "duplicate_ids", "hash": "duplicate_rows"}[column]] = members, instances
        shown: dict[str, list] = {}
        for r in members.orderBy(column, "source_path", "line_number").limit(MAX_GROUPS).collect():
            shown.setdefault(r[column], []).append({"filePath": r["source_path"], "lineNumber": r["line_number"]})
        return shown, by_folder, groups, instances

    empty = ({}, {}, 0, 0)
    ids, ids_by, n_ids, _ = duplicates("key") if job.check_key and not job.validate_only else empty
    dups, rows_by, _, row_instances = duplicates("hash") if job.check_row and not job.validate_only else empty
    details = {}
    for s in sources:
        d = details.setdefault(s.folder, {"processedSizeBytes": 0, "totalSizeBytes": 0, "filesProcessed": 0, "totalFiles": 0, "keysFound": 0, "rowsProcessed": 0})
        d["totalSizeBytes"] += s.size
        d["totalFiles"] += 1
    for folder, d in details.items():
        if (r := per.get(folder)) is not None:
            d |= {"keysFound": r["keys"], "rowsProcessed": r["rows"], "filesProcessed": r["files"], "processedSizeBytes": d["totalSizeBytes"]}
    total, keys, files = sum(r["rows"] for r in folders), sum(r["keys"] for r in folders), len(sources)
    size = sum(s.size for s in sources)
    summary = {
        "isValidationReport": job.validate_only, "isPartialReport": False, "filesProcessed": files, "totalFiles": files,
        "processedDataSizeBytes": sum(d["processedSizeBytes"] for d in details.values()), "totalDataSizeOverallBytes": size,
        "processedDataSizeHuman": human_size(sum(d["processedSizeBytes"] for d in details.values())), "totalDataSizeOverallHuman": human_size(size),
        "totalElapsedTime": f"{time.time() - began:.3f}s", "totalRowsProcessed": total, "uniqueKey": job.key, "totalKeyOccurrences": keys if job.check_key else 0,
        "uniqueKeysDuplicated": n_ids, "duplicateRowInstances": row_instances, "averageRowsPerFile": total / files if files else 0.0,
        "averageFilesPerFolder": files / len(details) if details else 0.0, "duplicateIDsPerFolder": ids_by, "duplicateRowsPerFolder": rows_by, "folderDetails": details,
    }
    out = {"summary": summary, "duplicateIds": ids, "duplicateRows": dups}
    return out | ({"searchResults": search} if search is not None else {}) | ({"deletionStats": deletion} if deletion is not None else {})


def render(report: dict, show_folders: bool = True) -> str:
    """The report as text."""
    s = report["summary"]
    lines = ["Validation report" if s["isValidationReport"] else "Analysis report", ""]
    lines += [f"Files: {s['filesProcessed']} of {s['totalFiles']} ({s['processedDataSizeHuman']} of {s['totalDataSizeOverallHuman']})", f"Rows: {s['totalRowsProcessed']}", f"Key: {s['uniqueKey']}, occurrences {s['totalKeyOccurrences']}"]
    if not s["isValidationReport"]:
        lines += [f"Duplicated keys: {s['uniqueKeysDuplicated']}", f"Duplicate row instances: {s['duplicateRowInstances']}"]
    if show_folders:
        lines += ["", "Folders:"]
        for f in sorted(s["folderDetails"]):
            d = s["folderDetails"][f]
            lines.append(f"  {f}: files {d['filesProcessed']}/{d['totalFiles']}, rows {d['rowsProcessed']}, keys {d['keysFound']}, duplicate ids {s['duplicateIDsPerFolder'].get(f, 0)}, duplicate rows {s['duplicateRowsPerFolder'].get(f, 0)}")
    for title, groups in (("Duplicate ids", report["duplicateIds"]), ("Duplicate rows", report["duplicateRows"])):
        if groups:
            lines += ["", f"{title}:"]
            for k in sorted(groups):
                lines.append(f"  {k}")
                lines += [f"    {x['filePath']}:{x['lineNumber']}" for x in groups[k]]
    if "searchResults" in report:
        lines += ["", f"Search matches: {report['searchResults']['totalMatches']}", *[f"  {t}: {n}" for t, n in sorted(report["searchResults"]["matchesByTarget"].items())]]
    return "\n".join(lines) + "\n"
