"""Queries of the whole commands over files: reports, artefacts, ingest, rewrite and purge, each with its SQL equivalent.

The files are written below the shared folder, changed or read by the command, and read back.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltsieve import workflows
from siltsieve.functions.paths import column_at
from siltsieve.operators.ingest import Mapping
from siltsieve.operators.rewrite import Rewrite
from siltsieve.operators.rules import Rule
from siltsieve.operators.search import Target
from siltsieve.report import Analysis, render
from siltsieve.session import shared_folder, table
from siltsieve.sinks import writers as W
from siltsieve.sources.records import read_records

QUERIES = {}
ORACLES = {}


def _query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


def _local(s: SparkSession, name: str) -> str:
    """A new folder below the shared one, as the commands that change files in place take it."""
    return re.sub("^file:/+", "/", shared_folder(s, name))


def _customers(s: SparkSession, d: str) -> str:
    """Customers as lines of JSON in a folder per nation."""
    c, path = table(s, d, "customer"), _local(s, "customers")
    W.write_table(c.select("c_nationkey", F.col("c_mktsegment").alias("id"), (F.col("c_custkey") % 50).alias("n")), path, "jsonl", ("c_nationkey",))
    return path


_T = "WITH t AS (SELECT c_nationkey, c_mktsegment AS id, c_custkey % 50 AS n, count(*) OVER (PARTITION BY c_mktsegment) AS ids, count(*) OVER (PARTITION BY c_mktsegment, c_custkey % 50) AS rows FROM customer) "


@_query(_T + "SELECT c_nationkey, count(*) AS rows_processed, count(*) AS keys_found, count(*) FILTER (WHERE ids > 1) AS duplicate_ids, count(*) FILTER (WHERE rows > 1) AS duplicate_rows FROM t GROUP BY c_nationkey")
def report_folders(s: SparkSession, d: str) -> DataFrame:
    out = workflows.run_analysis(s, _customers(s, d), Analysis("id"))["summary"]
    rows = [(int(f.rsplit("=", 1)[1]), x["rowsProcessed"], x["keysFound"], out["duplicateIDsPerFolder"].get(f, 0), out["duplicateRowsPerFolder"].get(f, 0)) for f, x in out["folderDetails"].items()]
    return s.createDataFrame(rows, "c_nationkey int, rows_processed bigint, keys_found bigint, duplicate_ids bigint, duplicate_rows bigint")


@_query(_T + "SELECT count(*) AS total_rows, count(DISTINCT CASE WHEN ids > 1 THEN id END) AS duplicated_keys, count(*) FILTER (WHERE rows > 1) AS duplicate_row_instances, count(DISTINCT c_nationkey) AS folders, 0::BIGINT AS validated_duplicates, count(*) AS validated_keys, 'Rows: ' || count(*) AS line FROM t")
def report_totals(s: SparkSession, d: str) -> DataFrame:
    """The report's summary, its text form, and validation mode, which counts keys only."""
    path = _customers(s, d)
    full = workflows.run_analysis(s, path, Analysis("id", algorithm="md5"))
    plain = workflows.run_analysis(s, path, Analysis("id", validate_only=True))["summary"]
    x = full["summary"]
    line = next(t for t in render(full).splitlines() if t.startswith("Rows: "))
    row = (x["totalRowsProcessed"], x["uniqueKeysDuplicated"], x["duplicateRowInstances"], len(x["folderDetails"]), plain["uniqueKeysDuplicated"], plain["totalKeyOccurrences"], line)
    return s.createDataFrame([row], "total_rows bigint, duplicated_keys bigint, duplicate_row_instances bigint, folders bigint, validated_duplicates bigint, validated_keys bigint, line string")


@_query("SELECT 'segment' AS target, 'id' AS path, c_mktsegment AS matched_value, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY c_mktsegment UNION ALL SELECT 'seven', 'n', '7', count(*) FROM customer WHERE c_custkey % 50 = 7 HAVING count(*) > 0")
def artefact_matches(s: SparkSession, d: str) -> DataFrame:
    """Search results as the table beside the report."""
    tables: dict = {}
    job = Analysis("id", check_key=False, check_row=False, targets=[Target("segment", "id", ["BUILDING", "MACHINERY"]), Target("seven", "n", ["7"])])
    workflows.run_analysis(s, _customers(s, d), job, tables=tables)
    out = _local(s, "artefacts")
    workflows.write_tables(tables, out)
    return s.read.json(os.path.join(out, "search_matches")).groupBy("target", "path", "matched_value").agg(F.count("*").alias("n"))


@_query("SELECT count(*) AS total_rows, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS deleted_rows, 0::BIGINT AS modified_rows, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS csv_matches FROM customer")
def artefact_deletions(s: SparkSession, d: str) -> DataFrame:
    """Deletion statistics as written."""
    job = Analysis("id", check_key=False, check_row=False, targets=[Target("segment", "id", ["building"])], rules=[Rule("segment", "delete_row")])
    tables: dict = {}
    report = workflows.run_analysis(s, _customers(s, d), job, tables=tables)
    out = _local(s, "deletions")
    report["searchResults"]["matchesByTarget"]["segment"] = report["searchResults"]["matchesByTarget"].get("segment", 0)
    workflows.write_artifacts(report, out, tables=tables)
    csv = s.read.option("header", True).csv(os.path.join(out, "deletion_stats.csv"))
    value = lambda m: F.max(F.when(F.col("metric") == m, F.col("value").cast("bigint")))
    return csv.agg(value("totalRows").alias("total_rows"), value("deletedRows").alias("deleted_rows"), value("modifiedRows").alias("modified_rows"), value("matchesByTarget.segment").alias("csv_matches"))


@_query("SELECT 'global:id' AS path, 'string' AS type, count(*) AS occurrences, count(DISTINCT c_mktsegment) AS unique_values, array_to_string(list_slice(list_sort(list(DISTINCT c_mktsegment)), 1, 5), '; ') AS examples, 1.0::DOUBLE AS sample_rate FROM customer UNION ALL SELECT 'global:n', 'integer', count(*), count(DISTINCT c_custkey % 50), array_to_string(list_slice(list_sort(list(DISTINCT (c_custkey % 50)::VARCHAR)), 1, 5), '; '), 1.0 FROM customer")
def artefact_schema(s: SparkSession, d: str) -> DataFrame:
    """The schema report as CSV with scope and path in one column."""
    p = workflows.schema_report(s, _customers(s, d), 1.0, 0)
    out = _local(s, "schema")
    workflows.write_artifacts({}, out, [r.asDict() for r in p.collect()], ("csv", "yaml"))  # one row a field
    csv = s.read.option("header", True).csv(os.path.join(out, "schema_paths.csv"))
    return csv.select("path", "type", F.col("occurrences").cast("bigint").alias("occurrences"), F.col("unique_values").cast("bigint").alias("unique_values"), "examples", F.col("sample_rate").cast("double").alias("sample_rate"))


@_query("""SELECT c_custkey::VARCHAR AS "Id", c_name AS "LastName", 'shop' AS "DataSource", 'Nation=' || c_nationkey AS attributes FROM customer UNION ALL SELECT s_suppkey::VARCHAR, s_name, 'supply', 'Nation=' || s_nationkey FROM supplier""")
def ingest_files(s: SparkSession, d: str) -> DataFrame:
    """CSV and XML files by their mappings into one unified output."""
    path, out = _local(s, "ingest"), _local(s, "unified")
    W.write_table(table(s, d, "customer").select("c_custkey", "c_name", "c_nationkey"), f"{path}/csv", "csv")
    sup = table(s, d, "supplier").select(F.col("s_suppkey").alias("_key"), "s_name", F.struct(F.col("s_nationkey").alias("nation")).alias("home"))
    sup.write.format("xml").option("rootTag", "suppliers").option("rowTag", "supplier").save(f"{path}/xml")
    maps = [Mapping(format="csv", columns={"c_custkey": "Id", "c_name": "LastName"}, attributes={"c_nationkey": "Nation"}, data_source="shop"), Mapping(format="xml", xml_record_path="suppliers.supplier", columns={"@key": "Id", "s_name": "LastName"}, attributes={"home.nation": "Nation"}, data_source="supply")]
    workflows.run_ingest(s, path, maps, out)
    u = s.read.schema("Id string, LastName string, DataSource string, Attributes array<struct<Key:string,Value:string>>").json(out)
    return u.select("Id", "LastName", "DataSource", F.array_join(F.transform("Attributes", lambda a: F.concat(a["Key"], F.lit("="), a["Value"])), ";").alias("attributes"))


@_query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN '0-NOW' ELSE o_orderpriority END AS priority, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS deleted FROM orders WHERE o_orderstatus <> 'F'""")
def rewrite_files(s: SparkSession, d: str) -> DataFrame:
    """Line files rewritten in place after a backup; the counters come with the rows."""
    path = _local(s, "rewrite")
    W.write_table(table(s, d, "orders").select("o_orderkey", "o_orderstatus", F.struct(F.col("o_orderpriority").alias("level")).alias("meta")), path, "jsonl")
    job = Rewrite("o_orderstatus", frozenset(["F"]), update_key="level", update_old_value="1-URGENT", update_new_value="0-NOW")
    preview = workflows.run_rewrite(s, path, job)
    applied = workflows.run_rewrite(s, path, job, "apply", _local(s, "rewrite-backup"))
    if any(preview[k] != applied[k] for k in ("lines_read", "lines_deleted", "lines_updated")):
        raise ValueError("preview and apply differ")
    v = F.try_parse_json("data")
    return read_records(s, path).select(column_at(v, "o_orderkey", "bigint").alias("o_orderkey"), column_at(v, "meta.level").alias("priority"), F.lit(applied["lines_deleted"]).cast("bigint").alias("deleted"))


@_query("SELECT s_suppkey::VARCHAR AS s_suppkey, CASE WHEN s_nationkey = 7 THEN '99' ELSE s_nationkey::VARCHAR END AS nation FROM supplier WHERE s_nationkey <> 3")
def rewrite_xml_files(s: SparkSession, d: str) -> DataFrame:
    """XML documents rewritten in place: records deleted, values replaced."""
    path = _local(s, "rewrite-xml")
    t = table(s, d, "supplier").select(F.col("s_suppkey").alias("_key"), F.col("s_nationkey").alias("drop"), F.struct(F.col("s_nationkey").alias("nation")).alias("home"))
    t.write.format("xml").option("rootTag", "suppliers").option("rowTag", "supplier").save(path)
    job = Rewrite("drop", frozenset(["3"]), update_key="nation", update_old_value="7", update_new_value="99")
    workflows.run_rewrite(s, path, job, "apply", _local(s, "rewrite-xml-backup"), "suppliers.supplier")
    v = F.try_parse_json("data")
    return read_records(s, path, xml_path="suppliers.supplier").filter("data is not null").select(column_at(v, "@key").alias("s_suppkey"), column_at(v, "home.nation").alias("nation"))


@_query("SELECT min(c_custkey) AS c_custkey, c_mktsegment AS id, (SELECT count(*) - count(DISTINCT c_mktsegment) FROM customer) AS removed FROM customer GROUP BY c_mktsegment")
def purge_files(s: SparkSession, d: str) -> DataFrame:
    """Surplus rows of duplicate keys removed from files, the removed ones kept and counted."""
    path, gone = _local(s, "purge"), _local(s, "purged")
    W.write_table(table(s, d, "customer").orderBy("c_custkey").select("c_custkey", F.col("c_mktsegment").alias("id")), path, "jsonl")
    workflows.run_purge(s, path, "id", purged_dir=gone, backup_dir=_local(s, "purge-backup"))
    kept = s.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*_id_purged.json").option("multiLine", True).schema("reason string").json(gone).count() if os.path.isdir(gone) else 0
    v = F.try_parse_json("data")
    return read_records(s, path).select(column_at(v, "c_custkey", "bigint").alias("c_custkey"), column_at(v, "id").alias("id"), F.lit(kept).cast("bigint").alias("removed"))
