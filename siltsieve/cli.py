"""Command line: analysis (default), ingest and rewrite."""

from __future__ import annotations

import argparse
import json
import os
import sys

from siltsieve import config as C
from siltsieve import workflows as X
from siltsieve.operators.rewrite import Rewrite
from siltsieve.report import MAX_GROUPS, Analysis, render
from siltsieve.session import get_session, ship
from siltsieve.sinks import writers as W

COMMANDS = {"analysis": "analysis", "analyse": "analysis", "analyze": "analysis", "ingest": "ingest", "normalize": "ingest", "normalise": "ingest", "rewrite": "rewrite"}


def _flag(v: str) -> bool:
    return v.strip().lower() in ("1", "true", "t", "yes")


def _parser(command: str) -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog=f"siltsieve {command}")
    add = p.add_argument
    add("--path", default="")
    add("--config", "--app-config", dest="config", default="")
    add("--approved-output-root", default=None)
    add("--trust-config", action="store_true", help="write where the configuration says")
    add("--workers", type=int, default=8)
    add("--log-path", default="logs")
    if command == "analysis":
        add("--key", default="id")
        add("--xml-record-path", default="")
        add("--json-mode", choices=("lines", "document"), default="lines")
        for n, d in (("check.key", True), ("check.row", True), ("show.folders", True), ("output.txt", False), ("output.json", False), ("purge-ids", False), ("purge-rows", False), ("headless", True), ("validate", False)):
            add(f"--{n}", dest=n.replace(".", "_").replace("-", "_"), type=_flag, nargs="?", const=True, default=d)
        add("--output", choices=("txt", "json"), default="txt")
    elif command == "ingest":
        add("--mapping-file", default="")
        add("--output-path", default="")
        add("--stats-output-path", default="")
        add("--require-mappings", action="store_true")
    else:
        for n in ("backup-dir", "xml-record-path", "top-level-key", "top-level-vals", "array-key", "array-del-key", "array-del-vals", "state-key", "state-value", "update-key", "update-old-value", "update-new-value", "update-id-key", "update-id-vals", "update-state-key", "update-state-value"):
            add(f"--{n}", default="")
        add("--mode", choices=("preview", "apply"), default="preview")
    return p


def main(argv: list[str] | None = None, spark: object | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    command = COMMANDS.get(argv[0], "") if argv and not argv[0].startswith("-") else "analysis"
    if not command:
        print(f"unknown command {argv[0]!r}", file=sys.stderr)
        return 2
    if argv and not argv[0].startswith("-"):
        argv = argv[1:]
    a = _parser(command).parse_args(argv)
    conf = C.load_structured(a.config) if a.config else {}
    a.path = a.path or conf.get("path", "")
    if not a.path:
        print("a path is needed", file=sys.stderr)
        return 2
    spark = ship(spark or get_session(master=None if os.environ.get("SPARK_REMOTE") else f"local[{a.workers}]"))
    guard = lambda *p: W.guard([x for x in p if x], a.approved_output_root, a.trust_config)
    if command == "analysis":
        adv = C.advanced(conf)
        if not (a.check_key or a.check_row or a.validate):
            print("nothing to check", file=sys.stderr)
            return 2
        guard(a.log_path)
        job = Analysis(a.key, a.check_key, a.check_row, a.validate, adv.hashing, adv.include, adv.exclude, adv.algorithm, adv.normalise, adv.targets, adv.rules)
        tables: dict = {}
        out = X.run_analysis(spark, a.path, job, a.xml_record_path, a.json_mode, tables)
        if adv.schema.enabled:
            s = X.schema_report(spark, a.path, adv.schema.sample_percent, adv.schema.max_samples, adv.schema.max_depth, adv.schema.group_by_folder, a.xml_record_path, adv.schema.seed)
            out["schemaReport"] = [r.asDict() for r in s.orderBy("path").collect()]
        if adv.targets or adv.schema.enabled:
            X.write_artifacts(out, a.log_path, out.get("schemaReport"), tuple(adv.schema.output_formats), tables)
        if a.output_json or a.output_txt or any(n > MAX_GROUPS for _, n in tables.values()):
            X.write_tables(tables, a.log_path)
        if any(r.output_path for r in adv.rules):
            guard(*[r.output_path for r in adv.rules])
            X.write_rule_outputs(spark, a.path, job, a.xml_record_path)
        text = json.dumps(out, indent=2, ensure_ascii=False, default=str) if a.output == "json" else render(out, a.show_folders)
        print(text)
        if a.output_json:
            W.write_json(out, os.path.join(a.log_path, "report.json"))
        if a.output_txt:
            W.write_text(render(out, a.show_folders), os.path.join(a.log_path, "report.txt"))
        for by, wanted in (("id", a.purge_ids), ("row", a.purge_rows)):
            if wanted:
                print(json.dumps(X.run_purge(spark, a.path, a.key, by, purged_dir=os.path.join(a.log_path, "purged"), backup_dir=os.path.join(a.log_path, "backups"))))
    elif command == "ingest":
        mapping, output = a.mapping_file or conf.get("mappingFile", ""), a.output_path or conf.get("outputPath", "")
        base = os.path.dirname(os.path.abspath(a.config)) if a.config else ""
        mapping = mapping if not base or os.path.isabs(mapping) or os.path.exists(mapping) else os.path.join(base, mapping)
        if not mapping or not output:
            print("a mapping file and an output path are needed", file=sys.stderr)
            return 2
        stats = a.stats_output_path or conf.get("statsOutputPath", "")
        guard(output, stats)
        print(json.dumps(X.run_ingest(spark, a.path, C.mappings(C.load_structured(mapping)), output, stats, a.require_mappings or bool(conf.get("requireMappings", False))), indent=2))
    else:
        guard(a.backup_dir if a.mode == "apply" else "", *(a.path.split(",") if a.mode == "apply" else []))
        job = Rewrite(a.top_level_key, C.value_list(a.top_level_vals), a.array_key, a.array_del_key, C.value_list(a.array_del_vals), a.state_key, a.state_value, a.update_key, a.update_old_value, a.update_new_value, a.update_id_key, C.value_list(a.update_id_vals), a.update_state_key, a.update_state_value)
        print(json.dumps(X.run_rewrite(spark, a.path, job, a.mode, a.backup_dir, a.xml_record_path), indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
