"""Configuration of the commands: analysis blocks, ingest mappings and rewrite lists."""

from __future__ import annotations

import csv
import json
from dataclasses import dataclass, field

from siltsieve.operators.ingest import Mapping
from siltsieve.operators.rules import Rule
from siltsieve.operators.search import Target


@dataclass
class SchemaDiscovery:
    enabled: bool = False
    sample_percent: float = 0.1
    max_depth: int = 10
    max_samples: int = 100_000
    output_formats: list[str] = field(default_factory=lambda: ["json"])
    group_by_folder: bool = False
    seed: int = 17


@dataclass
class Advanced:
    targets: list[Target] = field(default_factory=list)
    rules: list[Rule] = field(default_factory=list)
    hashing: str = "full_row"
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    algorithm: str = "sha256"
    normalise: bool = False
    schema: SchemaDiscovery = field(default_factory=SchemaDiscovery)


def load_structured(path: str) -> dict:
    """A JSON or YAML mapping."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.lower().endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("YAML needs the yaml module; give the file as JSON") from e
        out = yaml.safe_load(text)
    else:
        out = json.loads(text)
    if not isinstance(out, dict):
        raise ValueError(f"{path} holds no mapping")
    return out


def advanced(conf: dict) -> Advanced:
    a = conf.get("advanced", conf)
    targets = [Target(t.get("name", ""), t.get("path", ""), [str(v) for v in t.get("targetValues", [])], bool(t.get("caseSensitive", False)), t.get("type", "direct")) for t in a.get("searchTargets", [])]
    if len({t.name for t in targets}) < len(targets):
        raise ValueError("search targets need unique names")
    rules = [Rule(r.get("searchTarget", ""), r.get("action", ""), r.get("outputPath", ""), r.get("subKeyPath", ""), [str(v) for v in r.get("subKeyValues", [])]) for r in a.get("deletionRules", [])]
    for r in rules:
        if r.search_target not in {t.name for t in targets}:
            raise ValueError(f"rule names unknown target {r.search_target!r}")
    h, s = a.get("hashingStrategy", {}), a.get("schemaDiscovery", {})
    mode = h.get("mode", "full_row")
    if mode not in ("full_row", "selective", "exclude_keys"):
        raise ValueError(f"unknown hashing mode {mode!r}")
    if (h.get("algorithm") or "sha256") not in ("sha256", "md5", "fnv"):
        raise ValueError(f"unknown hash algorithm {h['algorithm']!r}")
    if (mode == "selective" and not h.get("includeKeys")) or (mode == "exclude_keys" and not h.get("excludeKeys")):
        raise ValueError(f"hashing mode {mode} needs keys")
    schema = SchemaDiscovery(bool(s.get("enabled", False)), float(s.get("samplePercent", 0.1)), int(s.get("maxDepth", 10)), int(s.get("maxSamples", 100_000)), list(s.get("outputFormats", ["json"])), bool(s.get("groupByFolder", False)))
    return Advanced(targets, rules, mode, list(h.get("includeKeys", [])), list(h.get("excludeKeys", [])), h.get("algorithm") or "sha256", bool(h.get("normalize", False)), schema)


def mappings(conf: dict) -> list[Mapping]:
    """Structured mappings, or the older form keyed by file name."""
    base = conf.get("defaults", {}) if "files" in conf else {}
    files = conf.get("files")
    if files is None:
        files = [{"match": {"name": name}, **body} for name, body in conf.items()]
    out = []
    for f in files:
        m = f.get("match", {})
        pick = lambda k, d, f=f: f.get(k, base.get(k, d))
        out.append(Mapping(
            name=m.get("name", ""), glob=m.get("glob", ""), format=(m.get("format") or "").lower(), columns=dict(f.get("columns", {})), attributes=dict(f.get("attributes", {})),
            defaults={k: str(v) for k, v in f.get("defaults", {}).items()}, data_source=f.get("dataSource", f.get("data_source", "")), sheet=f.get("sheet", ""), xml_record_path=f.get("xmlRecordPath", ""),
            source_created_date_field=f.get("sourceCreatedDateField", ""), source_modified_date_field=f.get("sourceModifiedDateField", ""), include_unmapped=bool(pick("includeUnmappedAsAttributes", False)),
            null_values=tuple(pick("nullValues", Mapping.null_values)), trim=bool(pick("trimWhitespace", True)),
        ))
    return out


def value_list(text: str) -> frozenset[str]:
    """A comma-separated list, or the values of a one-column CSV file with a header."""
    if text.lower().endswith(".csv"):
        with open(text, encoding="utf-8-sig", newline="") as f:
            rows = list(csv.reader(f))
        if any(len(r) > 1 for r in rows):
            raise ValueError(f"{text} has more than one column")
        return frozenset(r[0].strip() for r in rows[1:] if r and r[0].strip())
    return frozenset(v.strip() for v in text.split(",") if v.strip())
