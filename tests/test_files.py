"""Commands over files: formats, line numbers, reports, ingest, rewrite and purge."""

import json
import os
import zipfile

import pytest

from siltsieve import config, workflows
from siltsieve.cli import main
from siltsieve.operators.ingest import Mapping
from siltsieve.operators.rewrite import Rewrite
from siltsieve.operators.rules import Rule
from siltsieve.operators.search import Target
from siltsieve.report import Analysis, human_size
from siltsieve.sinks import writers
from siltsieve.sources import xmlio
from siltsieve.sources.discovery import discover
from siltsieve.sources.records import decode, read_records


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return path


def xlsx(path, rows):
    cell = lambda v: f'<c t="inlineStr"><is><t>{v}</t></is></c>'
    body = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows)
    m = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{m}" xmlns:r="{r}"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{m}"><sheetData>{body}</sheetData></worksheet>')


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    put(d / "a.csv", "﻿id,name,\n1,Ann,x\n\n2,Bob\n1,Ann,x,extra\n")
    put(d / "b.tsv", "id\tname\n1\tAnn\n3\tCy\n")
    put(d / "c.jsonl", '{"id":"4","n":1.0}\n\nbroken\n{"id":"4","n":1.0}\n')
    put(d / "d.xml", '<r><c s="x"><id>1</id><t>a</t><t>b</t></c><c><id>5</id></c></r>')
    xlsx(d / "e.xlsx", [["id", "name"], ["1", "Ann"], ["6", "Flo"]])
    return d


def test_line_numbers_and_ragged_rows(folder):
    rows = list(decode("csv", (folder / "a.csv").read_bytes()))
    assert [r[0] for r in rows] == [2, 4, 5]
    assert json.loads(rows[1][2]) == {"id": "2", "name": "Bob", "column_3": ""}
    assert [r[0] for r in decode("xlsx", (folder / "e.xlsx").read_bytes())] == [2, 3]
    quoted = list(decode("csv", b'id,n\n1,"a\nb"\n2,c\n'))
    assert [r[0] for r in quoted] == [2, 4]
    assert [r[0] for r in decode("json", b'[{"a":1},{"a":2}] ', "document")] == [1, 2]
    assert next(iter(decode("json", b'{"a":1} {"b":2}', "document")))[3]


def test_records_of_all_formats(spark, folder):
    df = read_records(spark, str(folder), xml_path="r.c")
    by = {r["format"]: r["n"] for r in df.filter("data is not null").groupBy("format").count().withColumnRenamed("count", "n").collect()}
    assert by == {"csv": 3, "tsv": 2, "jsonl": 2, "xml": 2, "xlsx": 2}
    assert df.filter("decode_error is not null").select("line_number").first()[0] == 3
    assert json.loads(df.filter("format = 'xml'").orderBy("record_index").first()["data"]) == {"@s": "x", "id": "1", "t": ["a", "b"]}
    assert '"n":1.0' in df.filter("format = 'jsonl' and data is not null").first()["data"]


def test_report(spark, folder):
    job = Analysis(targets=[Target("ann", "name", ["ANN"])], rules=[Rule("ann", "mark_for_deletion")])
    out = workflows.run_analysis(spark, str(folder), job, "r.c")
    s = out["summary"]
    assert s["totalRowsProcessed"] == 11 and s["uniqueKeysDuplicated"] == 2
    assert len(out["duplicateIds"]["1"]) == 5 and s["duplicateRowInstances"] >= 4
    assert out["searchResults"]["matchesByTarget"] == {"ann": 4} and out["deletionStats"]["modifiedRows"] == 4
    plain = workflows.run_analysis(spark, str(folder), Analysis(validate_only=True), "r.c")
    assert plain["summary"]["totalKeyOccurrences"] == 11 and not plain["duplicateIds"]
    assert human_size(1536) == "1.5 KiB"


def test_artefacts_are_whole_beyond_the_preview(spark, folder, tmp_path, monkeypatch):
    from siltsieve import report

    monkeypatch.setattr(report, "MAX_GROUPS", 2)
    tables = {}
    out = workflows.run_analysis(spark, str(folder), Analysis(targets=[Target("ann", "name", ["ANN"])]), "r.c", tables=tables)
    assert sum(map(len, out["duplicateIds"].values())) == len(out["searchResults"]["results"]["ann"]) == 2
    workflows.write_artifacts(out, str(tmp_path), tables=tables)
    whole = json.loads((tmp_path / "search_results.json").read_text())
    assert whole["totalMatches"] == len(whole["results"]["ann"]) == 4 and len(json.loads((tmp_path / "search_target_ann.json").read_text())) == 4
    assert len((tmp_path / "search_results.csv").read_text().splitlines()) == 5
    workflows.write_tables(tables, str(tmp_path))
    held = {n: [json.loads(x) for f in (tmp_path / n).rglob("part-*.json") for x in f.read_text().splitlines()] for n in tables}
    assert len(held["search_matches"]) == 4 and {n: len(x) for n, x in held.items()} == {n: k for n, (_, k) in tables.items()}
    assert sum(r["key"] == "1" for r in held["duplicate_ids"]) == 5


def test_ingest(spark, folder, tmp_path):
    maps = [Mapping(name="a.csv", columns={"id": "Id", "name": "FirstName"}, data_source="csv"), Mapping(format="xml", xml_record_path="r.c", columns={"id": "Id"}, attributes={"@s": "State"}, include_unmapped=True)]
    out = tmp_path / "u.ndjson"
    s = workflows.run_ingest(spark, str(folder), maps, str(out))
    rows = [json.loads(x) for x in out.read_text().splitlines()]
    assert s["rowsWritten"] == len(rows) == 5
    assert sorted(r["Id"] for r in rows if r["DataSource"] == "csv") == ["1", "1", "2"]
    xml = [r for r in rows if r["SourceFile"] == "d.xml"]
    assert {"Key": "State", "Value": "x"} in [a for r in xml for a in r["Attributes"]]
    warned = next(f for f in s["files"] if f["path"].endswith("d.xml"))
    assert warned["warnings"] == ['source field "@s" was not found']
    with pytest.raises(ValueError):
        workflows.run_ingest(spark, str(folder), maps, str(tmp_path / "u.csv"))
    assert not (tmp_path / "u.csv").exists()
    workflows.run_ingest(spark, str(folder), maps[:1], str(tmp_path / "u.csv"))
    assert len((tmp_path / "u.csv").read_text().splitlines()) == 4
    wide = workflows.run_ingest(spark, str(folder), maps[:1], str(tmp_path / "u"))
    assert wide["rowsWritten"] == sum(len(f.read_text().splitlines()) for f in (tmp_path / "u").glob("part-*.json")) == 3
    workflows.run_ingest(spark, str(folder), maps[:1], str(tmp_path / "u.json"))
    assert len(json.loads((tmp_path / "u.json").read_text())) == 3


def test_rewrite(spark, tmp_path):
    lines = ['{"id":"a","state":"x","items":[{"k":"1"},{"k":"2"}]}', "oops", '{"id":"b", "deep":[{"v":"old"}], "n":1000000}', '{"id":"c"}']
    f = put(tmp_path / "o.jsonl", "\n".join(lines) + "\n")
    job = Rewrite("id", frozenset(["c"]), "items", "k", frozenset(["1"]), update_key="v", update_old_value="old", update_new_value="new")
    p = workflows.run_rewrite(spark, str(f), job)
    assert (p["lines_deleted"], p["lines_modified"], p["lines_updated"], p["errors"]) == (1, 1, 1, 1)
    assert f.read_text().splitlines() == lines
    a = workflows.run_rewrite(spark, str(f), job, "apply", str(tmp_path / "bak"))
    assert a["files_modified"] == 1 and [x for _, _, n in os.walk(tmp_path / "bak") for x in n] == ["o.jsonl"]
    assert f.read_text().splitlines() == ['{"id":"a","state":"x","items":[{"k":"2"}]}', "oops", '{"id":"b","deep":[{"v":"new"}],"n":1000000}']
    again = workflows.run_rewrite(spark, str(f), job, "apply", str(tmp_path / "bak"))
    assert again["files_modified"] == 0
    with pytest.raises(ValueError):
        workflows.run_rewrite(spark, str(f), job, "apply")


def test_rewrite_survives_a_second_attempt(tmp_path):
    f = put(tmp_path / "o.jsonl", '{"id":"a"}\n{"id":"c"}\n')
    job = Rewrite("id", frozenset(["c"]))
    first, second = (workflows._rewrite_json(str(f), job, True, str(tmp_path / "bak"), "run") for _ in range(2))
    assert first == second and f.read_text() == '{"id":"a"}\n'
    g = put(tmp_path / "p.jsonl", "".join(f'{{"n":{i}}}\n' for i in range(5)))
    for _ in range(2):
        assert workflows._purge_file(str(g), iter([2, 4]), str(tmp_path / "gone"), str(tmp_path / "bak"), "run", "id_purged", "n") == 2
    assert g.read_text() == '{"n":0}\n{"n":2}\n{"n":4}\n'


def test_lines_of_split_files(spark, tmp_path):
    lines = ["" if i % 7 == 3 else json.dumps({"i": i, "pad": "x" * (i % 50)}) for i in range(1, 6000)]
    d = tmp_path / "in"
    d.mkdir()
    put(d / "a.jsonl", "\n".join(lines))
    put(d / "b.ndjson", "\ufeff" + "\r\n".join(lines[:100]) + "\r\n")
    put(d / "c.json", "{}\n" + '{"a":"' + "y" * 5000 + '"}\n[1]\n{"a":1\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = read_records(spark, str(d), max_line=2000)
        assert df.rdd.getNumPartitions() > 10
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name, n in (("a.jsonl", 5999), ("b.ndjson", 100)):
        own = {r["line_number"]: json.loads(r["data"])["i"] for r in rows if r["source_path"].endswith(name)}
        assert own == {i: i for i in range(1, n + 1) if i % 7 != 3}
    c = {r["line_number"]: (r["data"], r["decode_error"]) for r in rows if r["source_path"].endswith("c.json")}
    assert c[1] == ("{}", None) and c[2] == (None, "line longer than 2000 bytes") and c[3] == (None, "not a JSON object") and c[4][0] is None and c[4][1]


def test_equal_header_names_keep_their_columns():
    rows = list(decode("csv", b"a,a,,a_2\n1,2,3,4\n"))
    assert json.loads(rows[0][2]) == {"a": "1", "a_2": "2", "column_3": "3", "a_2_2": "4"}


def test_rewrite_xml_with_mixed_content(spark, tmp_path):
    f = put(tmp_path / "m.xml", "<r><o>before <v>old</v> between <v>old</v> after<id>a</id></o></r>")
    job = Rewrite(update_key="v", update_old_value="old", update_new_value="new")
    f.write_text(f.read_text().replace("<v>old</v> after", "<v><w>x</w></v> after").replace("<v>old</v> between", "<v><v>old</v></v> between"))
    out = workflows.run_rewrite(spark, str(f), job, "apply", str(tmp_path / "bak"), "r.o")
    assert out["lines_updated"] == 1 and "<v>new</v>" in f.read_text() and "old" not in f.read_text()
    text = f.read_text()
    assert text.index("before") < text.index("<v>new</v>") < text.index("between") < text.index("<w>x</w>") < text.index("after") < text.index("<id>a</id>")


def test_rewrite_xml(spark, tmp_path):
    f = put(tmp_path / "o.xml", "<os>\n  <o n='1'><id>a</id><items><i><k>1</k></i><i><k>2</k></i></items></o>\n  <o><id>c</id></o>\n</os>")
    job = Rewrite("id", frozenset(["c"]), "items", "k", frozenset(["1"]))
    out = workflows.run_rewrite(spark, str(f), job, "apply", str(tmp_path / "bak"), "os.o")
    assert (out["lines_deleted"], out["lines_modified"]) == (1, 1)
    root = xmlio.parse(f.read_text())
    assert xmlio.normalise(root) == {"o": {"@n": "1", "id": "a", "items": {"i": {"k": "2"}}}}
    with pytest.raises(ValueError):
        xmlio.remove(root, root, None)


def test_purge_and_restore(spark, tmp_path):
    f = put(tmp_path / "p.jsonl", '{"id":"a","v":1}\n{"id":"b"}\n{"id":"a","v":2}\n')
    out = workflows.run_purge(spark, str(f), "id", purged_dir=str(tmp_path / "gone"), backup_dir=str(tmp_path / "bak"))
    assert out == {"rowsRemoved": 1} and len(f.read_text().splitlines()) == 2
    back = writers.restore_purged(str(tmp_path / "gone" / str(tmp_path)[1:] / "p_id_purged.jsonl"))
    assert back[0]["originalRow"] == {"id": "a", "v": 2} and back[0]["location"]["lineNumber"] == 3


def test_guards_and_discovery(tmp_path):
    with pytest.raises(writers.WriteRefused):
        writers.guard([str(tmp_path / "x")], str(tmp_path / "root"))
    with pytest.raises(writers.WriteRefused):
        writers.guard([str(tmp_path / "x")], None)  # without a root the working folder is it
    with pytest.raises(writers.WriteRefused):
        writers.contained(str(tmp_path), "../x")
    with pytest.raises(FileNotFoundError):
        discover(str(tmp_path))
    put(tmp_path / "x.txt", "")
    with pytest.raises(ValueError):
        discover(str(tmp_path / "x.txt"))
    put(tmp_path / "y.json", "{}")
    assert len(discover(f"{tmp_path},{tmp_path}/y.json")) == 1
    assert writers.suffixed("a/b.jsonl", "_x") == "a/b_x.jsonl"
    put(tmp_path / "l.csv", "id\n1\n2\n")
    assert config.value_list(str(tmp_path / "l.csv")) == {"1", "2"} and config.value_list("a, b") == {"a", "b"}


def test_command_line(spark, folder, tmp_path, capsys):
    assert main(["--path", str(folder / "c.jsonl"), "--output", "json", "--output.json", "--log-path", str(tmp_path / "logs"), "--approved-output-root", str(tmp_path)], spark) == 0
    assert json.loads(capsys.readouterr().out)["summary"]["uniqueKeysDuplicated"] == 1
    assert (tmp_path / "logs" / "report.json").exists()
    put(tmp_path / "m.json", json.dumps({"files": [{"match": {"glob": "*.csv"}, "columns": {"id": "Id"}}]}))
    assert main(["ingest", "--path", str(folder), "--mapping-file", str(tmp_path / "m.json"), "--output-path", str(tmp_path / "o.ndjson"), "--approved-output-root", str(tmp_path)], spark) == 0
    assert len((tmp_path / "o.ndjson").read_text().splitlines()) == 3
    assert main(["rewrite", "--path", str(folder / "c.jsonl"), "--top-level-key", "id", "--top-level-vals", "4"], spark) == 0
    assert '"lines_deleted": 2' in capsys.readouterr().out
    assert main(["nonsense"], spark) == 2


def test_artifacts(spark, folder, tmp_path, capsys):
    conf = {"advanced": {
        "searchTargets": [{"name": "four", "type": "direct", "path": "id", "targetValues": ["4"]}],
        "deletionRules": [{"searchTarget": "four", "action": "mark_for_deletion", "outputPath": str(tmp_path / "marked")}],
        "schemaDiscovery": {"enabled": True, "samplePercent": 1, "outputFormats": ["json", "csv", "yaml"]},
    }}
    put(tmp_path / "conf.json", json.dumps(conf))
    logs = tmp_path / "logs"
    assert main(["--path", str(folder / "c.jsonl"), "--config", str(tmp_path / "conf.json"), "--log-path", str(logs), "--approved-output-root", str(tmp_path)], spark) == 0
    assert "Search matches: 2" in capsys.readouterr().out
    names = {p.name for p in logs.iterdir()}
    assert names == {"search_results.json", "search_target_four.json", "search_results.csv", "search_results.txt", "deletion_stats.csv", "schema_paths.csv", "deletion_stats.json", "deletion_summary.txt", "schema_report.json", "schema_report.csv", "schema_report.yaml"}
    assert (logs / "search_results.csv").read_text().splitlines()[1].startswith("four,id,4,")
    assert [r["path"] for r in json.loads((logs / "schema_report.json").read_text())] == ["id", "n"]
    marked = [json.loads(x) for f in (tmp_path / "marked").glob("*.json") for x in f.read_text().splitlines()]
    assert len(marked) == 2 and json.loads(marked[0]["record"])["_deletion_reason"] == "four"
    put(tmp_path / "bad.json", json.dumps({"advanced": {"deletionRules": [{"searchTarget": "none", "action": "delete_row"}]}}))
    with pytest.raises(ValueError):
        config.advanced(config.load_structured(str(tmp_path / "bad.json")))
